"""Token shards, telephony audio, the classifier, the pipeline."""

import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from statera.llm import mixing, packing, parity_join, quality, repair, shared, telephony
from statera.llm.textblocks import flat

from .conftest import prose

tokenizers = pytest.importorskip("public_tokenizers")
tokenizers_library = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    return repair.Encoder(tokenizers.path("byte_bpe_50k.json"))


def twins():
    """Thue-Morse texts and their complements, which hashes that are sums of powers do not tell apart."""
    for n in (1024, 2048, 4096):
        bits = [bin(k).count("1") & 1 for k in range(n)]
        yield from ("".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits))


def test_encoder_tells_pieces_of_one_hash_apart(encoder, monkeypatch):
    one = repair.Encoder(tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(repair, "mix", lambda x: x & np.uint64(7))
    texts = [prose(k, 30) for k in range(40)]
    for _ in range(2):
        ids, at = one(*flat(pa.array(texts)))
        for k, e in enumerate(one.tokenizer.encode_batch(texts, add_special_tokens=False)):
            assert ids[at[k] : at[k + 1]].tolist() == e.ids + [0]


def test_encoder_refuses_other_tokenizers(tmp_path):
    import json

    with open(tokenizers.path("byte_bpe_50k.json")) as f:
        spec = json.load(f)
    spec["pre_tokenizer"] = {"type": "Whitespace"}
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        repair.Encoder(str(tmp_path / "other.json"))


def test_encoder_equals_whole_texts(encoder):
    r = random.Random(1)
    letters = list("ab.,;!? \n'stéÿ»×3÷中—’\t \x1c-_$*()@#/rev\u3000\u2003\u00a0\x85\u1680\u2028")
    texts = [*twins(), "日本語の文章です。" * 40, "ключ " * 30 + "ОченьДлинноеСловоБезПробелов" * 3, "a" * 16, "a" * 17, "a" * 15 + "\0", "a" * 15,"", " ", "\n", "a  b", "it's. 's 'll", "<|endoftext|> x", *["".join(r.choice(letters) for _ in range(r.randint(1, 30))) for _ in range(1500)], prose(1, 400)]
    data, offsets = flat(pa.array(texts))
    for _ in range(2):  # the second time all pieces are known
        ids, at = encoder(data, offsets)
        for k, e in enumerate(encoder.tokenizer.encode_batch(texts, add_special_tokens=False)):
            assert ids[at[k] : at[k + 1]].tolist() == e.ids + [0]
    encoder._shrink()
    assert (encoder(data, offsets)[0] == ids).all()


def test_encoder_equals_the_tokenizer_as_loaded(encoder):
    loaded = tokenizers_library.Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    texts = ["", "a <|endoftext|> b", "plain", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "a <|endoftext", "|> b", "end <|endoftext|>"]
    ids, at = encoder(*flat(pa.array(texts)))
    found = [ids[at[k] : at[k + 1] - 1].tolist() for k in range(len(texts))]
    assert found == [loaded.encode(t, add_special_tokens=False).ids for t in texts]
    assert found[1] == [64, 220, 50256, 275]


@pytest.mark.parametrize("least", [2, 5, 1000])
def test_compression_round_trip(least):
    r = np.random.default_rng(least)
    for ids in (r.integers(0, 5, 4000), np.zeros(3000, int), np.tile(np.arange(7), 500), np.zeros(0, int), np.array([3]), r.integers(0, 50_000, 2000)):
        ids = ids.astype(np.uint32)
        symbols, rules, lengths = repair.compress(ids, least)
        assert (repair.expand(symbols, rules, lengths) == ids).all()
        for lo, hi in ((0, len(ids)), (len(ids) // 3, len(ids) // 2)):
            if hi > lo:
                assert (repair.decode(symbols, rules, lengths, lo, hi) == ids[lo:hi]).all()
        if least == 2 and len(ids) == 3000:
            assert len(symbols) < 30


def uses(symbols, rules):
    """How often each rule occurs where it was made: in the sequence or in later rules, as often as those occur."""
    counts = dict.fromkeys(range(len(rules)), 0)
    for s in symbols.tolist():
        if s >= repair.BASE:
            counts[s - repair.BASE] += 1
    for k in range(len(rules) - 1, -1, -1):
        for s in rules[k].tolist():
            if s >= repair.BASE:
                counts[s - repair.BASE] += counts[k]
    return counts


@pytest.mark.parametrize("least", [2, 4, 64])
def test_compression_leaves_no_frequent_pair(least):
    r = np.random.default_rng(least)
    passages = [r.integers(0, 50_000, int(r.integers(5, 60))) for _ in range(6)]
    for ids in (np.concatenate([passages[k] for k in r.integers(0, 6, 6 * least)]), r.integers(0, 12, 100 * least), np.zeros(5000, int), np.tile([1, 2], least)):
        ids = ids.astype(np.uint32)
        symbols, rules, lengths = repair.compress(ids, least)
        assert (repair.expand(symbols, rules, lengths) == ids).all()
        counts, last = {}, {}
        for k, pair in enumerate(zip(symbols[:-1].tolist(), symbols[1:].tolist())):
            if pair[0] != pair[1] or last.get(pair) != k - 1:  # overlapping ones count once
                counts[pair], last[pair] = counts.get(pair, 0) + 1, k
        assert max(counts.values(), default=0) < least
        assert all(n >= least for n in uses(symbols, rules).values())


@pytest.mark.parametrize("dense", [0, 3, 1 << 40])
def test_sorted_and_linked_rounds_compress_alike(dense, monkeypatch):
    monkeypatch.setattr(repair, "DENSE", dense)
    for least in (2, 4, 64):
        test_compression_leaves_no_frequent_pair(least)
        test_compression_round_trip(least)


def test_half_a_million_ids_take_few_linked_rounds(monkeypatch):
    """The rounds over most of a shard sort its pairs; the hash tables of the others see a small rest of it."""
    seen, may = [], repair._may_be_frequent
    monkeypatch.setattr(repair, "_may_be_frequent", lambda pair, least: (seen.append(len(pair)), may(pair, least))[1])
    ids = (np.random.default_rng(5).pareto(0.4, 1 << 17) % 50_000).astype(np.uint32)
    symbols, rules, lengths = repair.compress(ids)
    assert (repair.expand(symbols, rules, lengths) == ids).all()
    assert sum(seen) < len(ids) // 4


def test_pieces_of_one_word_go_past_the_split(encoder, monkeypatch):
    one = repair.Encoder(tokenizers.path("byte_bpe_50k.json"))
    split = []
    others = one._others
    monkeypatch.setattr(one, "_others", lambda pieces: (split.extend(pieces), others(pieces))[1])
    texts = ["Straßenübung naïveté zzyzx\nQwertyuiop 1234567\n99 Ævar x", "a1b2 ключ it's 5×6 ÷ x² ªº ĸ \x00q qé́"]
    ids, at = one(*flat(pa.array(texts)))
    for k, e in enumerate(encoder.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[k] : at[k + 1]].tolist() == e.ids + [0]
    assert not {p.strip() for p in split} & {w.encode() for w in texts[0].split()}
    assert {" ключ".encode(), b" a1b2", " 5×6".encode()} <= {b" " + p.strip() for p in split}


def test_shards(spark, docs, texts, none, encoder):
    path = shared.new_path(spark, "ids")
    repair.write(docs, path, tokenizers.path("byte_bpe_50k.json"), 3)
    shards = repair.read(spark, path)
    rows = repair.checksums(shards).join(repair.shard_starts(shards), ["shard", "part"]).collect()
    at = 0
    for (i, t), r in zip(sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1])), sorted(rows, key=lambda r: r.shard_start + r.offset)):
        ids = np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4")
        assert (r.doc_id, r.shard_start + r.offset, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids))
        at += len(ids)
    empty = shared.new_path(spark, "ids")
    repair.write(none, empty, tokenizers.path("byte_bpe_50k.json"), 2)
    assert repair.checksums(repair.read(spark, empty)).count() == 0


def adpcm(block):
    sample, index, out = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88), []
    out.append(sample)
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            change = (step >> 3) + (step if n & 4 else 0) + (step >> 1 if n & 2 else 0) + (step >> 2 if n & 1 else 0)
            sample = max(-32768, min(32767, sample - change if n & 8 else sample + change))
            index = max(0, min(88, index + int(telephony.INDEX_CHANGE[n & 7])))
            out.append(sample)
    return out


def test_audio_decoders():
    data = np.random.default_rng(1).integers(0, 256, (6, 196)).astype(np.uint8)
    assert telephony.decode_adpcm(data).tolist() == [adpcm(bytes(b)) for b in data]
    # fixed points of G.711
    assert telephony.MULAW[[0x00, 0x80, 0xFF, 0x7F]].tolist() == [-32124, 32124, 0, 0]
    assert telephony.ALAW[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    assert len(set(telephony.ALAW.tolist())) == 256
    pcm = np.array([0, 100, -100, 7], np.int16)
    assert telephony.resample(pcm, 8000, 16000).tolist() == [0, 50, 100, 0, -100, -47, 7, 7]
    assert telephony.resample(pcm, 8000, 4000).tolist() == [50, -47]
    assert len(telephony.resample(pcm, 8000, 6000)) == 3 and telephony.read_wav(b"RIFFxxxxWAVEjunk") is None and telephony.read_wav(None) is None


def test_telephony(spark, docs, texts, none):
    media = shared.stored(telephony.with_pcm(telephony.encode(docs)), "media")
    rows = telephony.describe(media).collect()
    for r in media.collect():  # the PCM that is stored is that of the file, decoded and resampled
        codec, data = telephony.read_wav(bytes(r.media))
        (pcm,) = telephony.decode_files([(codec, data)])
        assert r.codec == codec and np.frombuffer(r.pcm, "<i2").tolist() == [int(np.floor(pcm[k : k + 4].astype(int).sum() / 4)) for k in range(0, len(pcm) // 4 * 4, 4)]
    assert len(rows) == len(texts)
    want = {}
    for i, t in texts:
        b = t.encode()
        p = b.ljust(max(192, -(-len(b) // 192) * 192))
        want[i] = (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    files = {r.doc_id: bytes(r.media) for r in media.collect()}
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want[r.doc_id]
        assert (r.media_bytes, r.media_sha256) == (len(files[r.doc_id]), hashlib.sha256(files[r.doc_id]).hexdigest())
    assert len({r.feature for r in rows if r.doc_id in (7, 8)}) == 1
    path = shared.new_path(spark, "pcm")
    telephony.store_pcm(media, path)
    assert {r.codec for r in spark.read.parquet(path).collect()} <= set(telephony.CODECS)
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"no"))], "doc_id long, media binary")
    assert [(r.codec, r.pcm) for r in telephony.decode(odd).collect()] == [(None, None)] * 2
    assert telephony.encode(none).count() == 0


def test_classifier(spark, docs, none):
    train = [(k, prose(k, 60) if k % 2 else prose(k, 60).upper().replace(" ", "!! ")) for k in range(400)]
    frame = spark.createDataFrame(train, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)] + [(7, None), (None, 1), (9999, 0)], "doc_id long, quality int")
    weights = quality.train(frame, labels)
    scored = quality.score(frame, weights).withColumn("held", quality.held_out()).collect()
    assert all(0 <= r.score <= 1 and r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in scored)
    held = [r for r in scored if r.held]
    assert sum((r.score >= 0.5) == bool(r.doc_id % 2) for r in held) / len(held) > 0.97
    # labels of held-out rows are not learnt
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    assert (quality.train(frame, flipped) == weights).all()
    assert quality.score(docs, weights).count() == docs.count()
    kept = quality.keep_good(docs.unionByName(docs), labels)
    assert kept.columns == docs.columns
    no_labels = quality.train(frame, labels.limit(0))
    assert not no_labels.any() and {r.score for r in quality.score(frame, no_labels).collect()} == {0.5}
    assert quality.score(none, weights).count() == 0


def test_updates_follow_the_formula():
    """Weights against follow-the-regularised-leader written out for one slot at a time."""
    import math

    rows = [(k % 2, k, prose(k, 12) + (" good sound text" if k % 2 else " BUY now!! now")) for k in range(30)]
    table = pa.table({"label": pa.array([r[0] for r in rows], pa.int32()), "order": pa.array([r[1] for r in rows], pa.int64()), "text": [r[2] for r in rows]})
    found = np.frombuffer(quality._train(table)["weights"][0].as_py(), np.float32)
    z, n = {}, {}

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(zi) <= quality.L1 else -(zi - math.copysign(quality.L1, zi)) / ((quality.BETA + math.sqrt(ni)) / quality.ALPHA + quality.L2)

    vectors = [list(zip(i.tolist(), x.tolist())) for i, x in quality.features(table["text"].combine_chunks())]
    for _ in range(quality.EPOCHS):
        for (label, _, _), vector in zip(rows, vectors):
            p = 1 / (1 + math.exp(-sum(weight(i) * x for i, x in vector)))
            for i, x in vector:
                g, w = (p - label) * x, weight(i)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA * w
                n[i] = n.get(i, 0.0) + g * g
    want = np.zeros(len(found))
    for i in z:
        want[i] = weight(i)
    assert np.count_nonzero(want) > 100 and np.allclose(found, want, atol=1e-5)


@pytest.fixture(scope="module")
def odd_tables(spark, docs, tmp_path_factory):
    """Driver tables of the fixture's rows: null and repeated ids, null, empty and long texts, clashing names."""
    path = str(tmp_path_factory.mktemp("odd"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(k, k % 2, 0) for k in range(1, 19)] + [(None, 1, 0), (13, 0, 0), (7, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    turns = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (None, None, None, None), (2, 3, "tool", "")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(scope="module")
def empty_tables(spark, none, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    none.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


#: queries whose rows are not documents, and the column whose values all appear
PER_GROUP = {"op12_divergence": "source", "op13_conversation_repair": "conv_id"}


def test_queries_over_odd_rows(spark, odd_tables, empty_tables, texts):
    from statera.llm import registry

    for name, query in registry.QUERIES.items():
        rows = query(spark, odd_tables).collect()
        if name in PER_GROUP:
            assert len({r[PER_GROUP[name]] for r in rows}) > 2 and query(spark, empty_tables).count() == 0, name
            continue
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in texts), name
        assert query(spark, empty_tables).count() == 0, name


def test_pipeline_over_odd_rows(spark, odd_tables, empty_tables):
    import corpus_pipeline as p

    columns = ["doc_id", "n_tokens", "bucket", "padded_length", "batch", "slot"]
    found = p.run(spark, odd_tables)
    assert found.columns == columns and {r.doc_id for r in found.collect()} <= {None, *range(1, 19)}
    empty = p.run(spark, empty_tables)
    assert empty.columns == columns and empty.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_pipeline(spark):
    import corpus_pipeline as p

    docs = start = spark.read.parquet(f"{SF}/documents.parquet")
    after = {}
    for name, stage in p.STAGES:
        docs = shared.stored(stage(spark, docs, SF), name)
        after[name] = docs
    for name, _ in p.STAGES[:-1]:
        assert after[name].columns == start.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after["quality_classifier"].collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) / len(good) > 0.97
    texts = [r.text for r in after["exact_copies"].select("text").collect()]
    assert len({"".join(t.split(" ")) for t in texts}) == len(texts)
    near = {r.doc_id for r in after["near_copies"].collect()}
    same = parity_join.classes(after["exact_copies"]).collect()
    assert near == {r.doc_id for r in same if r.doc_id == r.component_id}
    sized = shared.stored(after["near_copies"].select("doc_id", "source", shared.n_words().alias("size")), "t")
    copies = {r.doc_id: -(-r.taken // r.size) for r in mixing.taken(sized, mixing.plan(sized)).collect() if r.taken}
    counts = {r.doc_id: r["count"] for r in after["source_mixture"].groupBy("doc_id").count().collect()}
    assert counts == copies
    assert docs.count() == sum(copies.values()) and docs.columns == ["doc_id", "n_tokens", "bucket", "padded_length", "batch", "slot"]
    assert packing.BUDGET >= docs.agg({"padded_length": "max"}).collect()[0][0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_oracles(spark):
    import duckdb

    from statera.llm import registry

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name, sql in registry.ORACLES.items():
        df = registry.QUERIES[name](spark, SF).toPandas()
        want = c.execute(sql).df()
        columns = sorted(want.columns)
        assert columns == sorted(df.columns)
        a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (df, want))
        assert a.equals(b), name
