"""Near copies, chunk and suffix-array dedup against brute force; property tests of their kernels."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from statera.llm import chunks, components, parity_join, spread, suffix, suffix_dedup
from statera.llm.textblocks import blocks, flat, shingle_sets, word_hashes

from .conftest import WORDS, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORDS.findall(text.translate(LOWER))
    return set(zip(*[w[j:] for j in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(texts):
    sets, parent = {}, {}
    for i, t in texts:
        sets.setdefault(i, []).append(shingles(t))
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    low = lambda x: (x is not None, x or 0)
    for (i, a), (j, b) in itertools.combinations([(i, s) for i, ss in sets.items() for s in ss], 2):
        if a and b and i != j and 100 * len(a & b) >= 80 * len(a | b):
            p, q = sorted((root(i), root(j)), key=low)
            parent[q] = p
    return {i: root(i) for i in parent}


def test_parity_join(docs, texts, none):
    want = classes(texts)
    found = parity_join.classes(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == sorted((str(i), len(shingles(t)), str(want[i])) for i, t in texts)
    kept = parity_join.keep_one(docs)
    assert kept.columns == docs.columns
    order = sorted(texts, key=lambda r: (r[0] is None, r[0] or 0))  # rows by their own numbers: the first of a component stays
    one = classes([(k, t) for k, (_, t) in enumerate(order)])
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(order[k][0]) for k in one if one[k] == k)
    assert parity_join.classes(none).count() == 0


def test_parity_join_at_the_threshold(spark):
    """Many pairs on either side of 0.8, of all sizes, and a passage that unrelated texts share."""
    r, rows, passage = random.Random(7), [], prose(99, 70)
    for k in range(120):
        n = r.choice((5, 6, 8, 11, 20, 40, 90, 200))
        w = prose(1000 + k, n).split(" ")
        v = list(w)
        for _ in range(max(1, round(n * r.uniform(0, 0.05)))):
            v[r.randrange(len(v))] = "z" + str(r.randrange(10**6))
        rows += [(3 * k, " ".join(w)), (3 * k + 1, " ".join(v)), (3 * k + 2, passage + " " + " ".join(w[:30]))]
    found = parity_join.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = classes(rows)
    assert {r.doc_id: r.component_id for r in found} == want
    assert 40 < len(set(want.values())) < 360


def test_parity_join_reads_copies_out_of_id_order(spark):
    """A task meets larger ids first, and ids that stand for several texts."""
    w = prose(41, 80).split(" ")
    near, other = " ".join(w[:40] + ["x"] + w[41:]), prose(42, 90)
    v = other.split(" ")
    rows = [(700, " ".join(w)), (300, " ".join(w)), (500, near)]
    rows += [(950, other), (950, prose(43, 30)), (900, " ".join(v[:50] + ["y"] + v[51:])), (800, prose(43, 30)), (920, other), (850, "one two three")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = parity_join.classes(frame).collect()
    want = classes(rows)
    assert want[500] == 300 and want[900] == 800
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted((i, len(shingles(t)), want[i]) for i, t in rows)


def test_sketch_distance_is_a_lower_bound():
    r = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 400, 300).astype(np.uint64)) for _ in "ab")
        d = len(np.setxor1d(a, b))
        for bits in (64, 512):
            x, y = parity_join.parity_sketch(a, bits), parity_join.parity_sketch(b, 64)
            assert parity_join._distances(x, y[None])[0] <= d


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 95), (200, 201), (201, 200), (5, 5)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{k: 1 for k in range(1, 41)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_of_patterns_do_not_link(spark):
    """Thue-Morse words and their complements, alike to hashes that are sums of powers, are different words."""
    def word(n, letters):
        return "".join(letters[bin(k).count("1") & 1] for k in range(n))

    rows = [(1, word(2048, "ab")), (2, word(2048, "ba")), (3, word(4096, "ab") + " x"), (4, word(4096, "ba") + " x"), (5, word(2048, "AB"))]
    found = {r.doc_id: r.component_id for r in parity_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_sets_of_words():
    for t in ("", "  ", "A b", "a b c d e", "a b c d e\tF\x0bg  é É", "x " * 20):
        assert parity_join.shingles(t.encode(), 5) == {tuple(w.encode() for w in s) for s in shingles(t)}


def test_word_hashes_follow_words():
    texts = ["Ab  cD\te", "", "ab cd e ", None, "x" * 3000, "é É"]
    data, offsets = flat(pa.array(texts))
    seen = {}
    for lo, hi in blocks(offsets, 10):
        part = offsets[lo : hi + 1] - offsets[lo]
        h, at = word_hashes(data[offsets[lo] : offsets[hi]], part)
        for k in range(hi - lo):
            seen[lo + k] = h[at[k] : at[k + 1]].tolist()
    assert seen[0] == seen[2] and len(seen[0]) == 3 and seen[1] == seen[3] == [] and len(set(seen[5])) == 2
    assert [len(s) for s in shingle_sets(pa.array(["a b c d e f", "a b", ""]))] == [2, 1, 0]


def in_order(texts):
    """Indexes of (id, text) pairs as the operators order them, null ids first; rows of one id keep their order."""
    return sorted(range(len(texts)), key=lambda k: (texts[k][0] is not None, texts[k][0] or 0))


def windows_removed(texts, length=100):
    seen, out = {}, []
    for k in in_order(texts):
        i, t = texts[k]
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen.setdefault(b[p : p + length], (k, p)) != (k, p):
                gone[p : p + length] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out.append((str(i), len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def digests(found):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in spread.digest_columns(found).collect())


@pytest.mark.parametrize("hot, whole, shard", [(64, 1024, 4096), (0, 0, 0), (1, 300, 200), (2, 0, 4096), (64, 4096, 4096)])
def test_suffix_dedup(docs, texts, none, hot, whole, shard):
    assert digests(suffix_dedup.deduplicate(docs, hot, whole, shard)) == windows_removed(texts)
    if shard == 200:
        assert suffix_dedup.deduplicate(none).count() == 0


def shared_id_rows():
    """1,500 rows without an id, two texts of one id, repeated rows, and a line in many surroundings."""
    line = "this line of more than a hundred letters stands in very many texts of this corpus, in ever new surroundings of words"
    rows = [(None, prose(k, 6) + " " + line + " " + prose(k + 5000, 6)) for k in range(1500)]
    rows += [(7, prose(1, 60)), (7, prose(2, 60)), (8, prose(2, 60) + " x"), (9, prose(3, 40)), (9, prose(3, 40)), (9, prose(3, 40))]
    return rows


@pytest.mark.parametrize("parts", [1, 3])
def test_rows_that_share_an_id_are_told_apart(spark, parts):
    rows = shared_id_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame = frame.coalesce(1) if parts == 1 else frame.repartition(parts)
    # which row of an id comes first follows from where it is read
    read = [(r.doc_id, r.text) for r in frame.collect()]
    assert digests(suffix_dedup.deduplicate(frame)) == windows_removed(read)
    found = chunks.deduplicate(frame).collect()
    assert sorted((str(r.doc_id), [(s.start, s.stop) for s in r.spans]) for r in found) == chunks_removed(read)


def test_arrays_decide_what_is_fetched():
    """Windows of many anchors in shared lanes, whatever their sizes."""
    r = random.Random(5)
    text, counts, shard = [], [], []
    for k in range(60):
        base = prose(k, 40).encode()
        for _ in range(r.randint(2, 12)):
            a, n = r.randint(0, 20), r.randint(1, 69)
            text.append(base[a : a + n + 99])
            counts.append(n)
            shard.append(k)
    found = set(zip(*(x.tolist() for x in suffix_dedup.shard_repeats(text, np.array(counts, np.uint8), np.array(shard)))))
    seen, want = set(), set()
    for k, (t, n) in enumerate(zip(text, counts)):
        for p in range(n):
            (want if t[p : p + 100] in seen else set()).add((k, p))
            seen.add(t[p : p + 100])
    assert found == want


def test_suffix_arrays():
    r = np.random.default_rng(0)
    for lanes, n, k in [(1, 1, 3), (30, 30, 2), (20, 120, 3), (7, 300, 20), *[(1, n, k) for n in range(2, 18) for k in (1, 2, 3)]]:
        t = np.zeros((lanes, n + 1), np.int32)
        t[:, :n] = r.integers(1, k + 1, (lanes, n))
        t[0, :n] = 1 if lanes > 1 else t[0, :n]
        t[-1, : n // 4] = k + 1  # padding
        sa = suffix.suffix_arrays(t, k + 2)
        for row, found in zip(t.tolist(), sa.tolist()):
            assert found == sorted(range(n + 1), key=lambda i: row[i:])  # noqa: B023
    assert suffix.suffix_arrays(np.array([[2, 1, 2, 1, 2, 0]], np.int32), 3).tolist() == [[5, 3, 1, 4, 2, 0]]


def test_suffix_arrays_take_one_scan_each_way(monkeypatch):
    """Long substrings, those that begin alike, wide alphabets and deep repeats need no arrays of reduced strings."""
    calls, whole = [], suffix._suffix_arrays
    monkeypatch.setattr(suffix, "_suffix_arrays", lambda *args: (calls.append(1), whole(*args))[1])
    r = np.random.default_rng(3)
    falls = np.concatenate([np.arange(k, 0, -1) for k in r.integers(1, 60, 40)])[:600]
    rises = np.concatenate([np.arange(1, k) for k in r.integers(2, 40, 80)])[:600]
    flat = np.where(r.random(600) < 0.03, 2, 1)
    deep = np.tile(np.array([3, 1, 2, 2, 1]), 120)
    wide = r.integers(1, 257, 600)
    wide[300:450] = wide[50:200]
    steps = np.repeat(r.integers(1, 3, 60), 10)
    t = np.zeros((6, 601), np.int32)
    for lane, row in enumerate((falls, rises, flat, deep, wide, steps)):
        t[lane, :600] = np.concatenate([np.full(600 - len(row), 257), row])
    for symbols, lanes in ((258, t), (62, t[[0, 2, 3, 5]]), (4, t[[2, 3, 5]])):
        for row, found in zip(lanes.tolist(), suffix.suffix_arrays(lanes, max(symbols, int(lanes.max()) + 1)).tolist()):
            assert found == sorted(range(601), key=lambda i: row[i:])  # noqa: B023
    assert len(calls) == 3


def test_columns_too_wide_for_a_word_sort_alike():
    r = np.random.default_rng(4)
    for wide in (8, 1 << 40):
        a, b = r.integers(0, 5, 300) * wide, r.integers(0, wide, 300)
        found = suffix._sorted(a, b, np.arange(300))
        assert list(zip(*(c.tolist() for c in found))) == sorted(zip(a.tolist(), b.tolist(), range(300)))


def test_permuted_common_prefixes():
    r = np.random.default_rng(1)
    for lanes, n, k in [(1, 40, 1), (6, 150, 2), (4, 90, 5)]:
        text = r.integers(1, k + 1, (lanes, n)).astype(np.uint8)
        text[0, 50:80] = text[0, 5:35] if n > 80 else text[0, 50:80]
        sa = np.array([sorted(range(n), key=lambda i: row[i:].tobytes()) for row in text], np.int32)  # noqa: B023
        found = suffix.permuted_common_prefixes(text, sa)
        for lane in range(lanes):
            for a, b in zip(sa[lane, 1:].tolist(), sa[lane, :-1].tolist()):
                same = 0
                while max(a, b) + same < n and text[lane, a + same] == text[lane, b + same]:
                    same += 1
                assert found[lane, a] == same


def scalar_cuts(b):
    value = []
    for i in range(len(b)):
        h = sum(int(chunks.GEAR[x]) << k for k, x in enumerate(reversed(b[max(0, i - chunks.WINDOW + 1) : i + 1]))) & 0xFFFF
        value.append(0 if i + 1 < len(b) and b[i + 1] & 0xC0 == 0x80 else int(chunks.ORDER[h]))
    out, lo, w = [], 0, chunks.REACH

    def forced(upto):
        nonlocal lo
        while upto - lo > chunks.MOST:
            lo += chunks.MOST
            while b[lo] & 0xC0 == 0x80:
                lo -= 1
            out.append(lo)

    for i in range(w + chunks.WINDOW - 1, len(b) - w):
        if value[i] > max(value[i - w : i]) and value[i] == max(value[i : i + w + 1]):
            forced(i + 1)
            out.append(i + 1)
            lo = i + 1
    forced(len(b))
    return out + [len(b)] * (len(b) > lo)


def chunks_removed(texts):
    seen, want = {}, []
    for n in in_order(texts):
        i, t = texts[n]
        b = t.encode()
        ends = scalar_cuts(b)
        starts = [0, *ends[:-1]]
        again = [seen.setdefault(b[s:e], (n, s)) != (n, s) for s, e in zip(starts, ends)]
        spans = []
        for dup, run in itertools.groupby(range(len(ends)), key=lambda k: again[k]):  # noqa: B023
            run = list(run)
            if dup:
                spans.append((starts[run[0]], ends[run[-1]]))
        want.append((str(i), spans))
    return sorted(want)


def test_chunks(docs, texts, none):
    found = chunks.deduplicate(docs).collect()
    assert sorted((str(r.doc_id), [(s.start, s.stop) for s in r.spans]) for r in found) == chunks_removed(texts)
    assert all(r.kept.decode() is not None for r in found)
    assert chunks.deduplicate(none).count() == 0


def test_short_repeats_go(spark):
    line = "all rights reserved by the owner of this page"
    rows = [(1, "short text"), (2, "short text"), (3, line), (4, line), (5, line)]
    found = {r.doc_id: r.kept for r in chunks.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: b"short text", 2: b"", 3: line.encode(), 4: b"", 5: b""}


def test_insertion_moves_few_chunks():
    b = prose(5, 3000).encode()
    c = b[:7000] + b"inserted " + b[7000:]
    def pieces(x):
        ends, _ = chunks.cuts(np.frombuffer(x, np.uint8), np.array([0, len(x)]))
        return {x[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist())}
    assert len(pieces(b) - pieces(c)) <= 4


def test_passages_are_found_and_chance_repeats_are_not():
    """Of 200 passages of 51 words in two texts each nearly all lose a chunk; texts that share 40 bytes lose none."""
    r, words = random.Random(8), [w for k in range(40) for w in prose(900 + k, 200).split(" ")]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))

    def common(a, b):
        both = []
        for x in (a.encode(), b.encode()):
            ends, _ = chunks.cuts(np.frombuffer(x, np.uint8), np.array([0, len(x)]))
            both.append({x[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist())})
        return both[0] & both[1]

    found = 0
    for _ in range(200):
        passage, short = some(51), some(30)[:40]
        found += bool(common(f"{some(r.randint(20, 60))} {passage} {some(30)}", f"{some(r.randint(20, 60))} {passage} {some(30)}"))
        assert not common(f"{some(40)} {short} {some(40)}", f"{some(40)} {short} {some(40)}")
    assert found > 190


def test_near_copies_are_judged_row_by_row(spark):
    """A row goes for its own text only: an unlike text that shares an id with a near copy stays, and so do rows without an id."""
    w = prose(61, 80).split(" ")
    near = " ".join(w[:40] + ["x"] + w[41:])
    v = prose(62, 70).split(" ")
    rows = [(3, " ".join(w)), (5, near), (5, prose(63, 60)), (None, " ".join(v)), (None, prose(64, 50)), (None, prose(65, 50)), (9, " ".join(v[:30] + ["y"] + v[31:])), (7, near), (7, near), (8, ""), (8, "")]
    frame = spark.createDataFrame([(*r, "r") for r in rows], "doc_id long, text string, row string")
    kept = parity_join.keep_one(frame)
    assert kept.columns == frame.columns
    found = sorted((str(r.doc_id), r.text) for r in kept.collect())
    want = [rows[0], rows[2], rows[4], rows[5], rows[6], rows[9], rows[10]]  # 9 rather than the row without an id
    assert found == sorted((str(i), t) for i, t in want)
