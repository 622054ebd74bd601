"""Word-shingle Jaccard join by parity sketches.

A text's set is its distinct 5-word shingles (lower-cased).  Sets of a size band are hashed into one long bit sketch,
each shingle flipping one bit, so the Hamming distance of two sketches never exceeds the symmetric difference of the
sets.  A Jaccard similarity of 0.8 or more allows a symmetric difference of at most D = (a + b) / 9 for sizes a and b.
The sketch is cut into m > D slices; two linked sets agree in at least m - D of them.  A text therefore emits its D + 1
slices with the most bits (ties by content): of two linked texts, the one with the higher cut emits more slices than
can differ, so one slice it emits is equal in the other, which then emits it too.  Slices with few bits, which
unrelated texts share by chance, are thus hardly ever emitted.  Bands span a factor of 2.5; texts within a factor of
1.25 of a band's edge also take part in a band of their own around that edge, so every pair meets in one band.

Slice digests travel as packed arrays per bucket, each text's own sketch once.  Texts that share a slice are paired
with the smallest of them as candidates (a star, not all pairs); candidates whose sketches are within D are verified
exactly on their shingle sets.  Slices whose texts are then not all in one component are taken up again, large ones in
blocks: only members of different components whose sketches are within D become candidates and are verified too.  So
components are those of all links.  Copies of one text are linked to the smallest of them by digest; each task that
reads texts emits a text once, under a key of the text that all its copies share, however many copies it holds.

Defined results: null, empty and blank texts have no shingles and link with nothing, not even each other; fewer than
five words form one shingle; rows that share a ``doc_id`` are one node of the graph (a null ``doc_id`` too, its
component_id is null as it counts as the smallest id); an empty table gives an empty
result; other columns are ignored by :func:`classes` and carried by :func:`keep_one`, which judges every row by itself;
ids are whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .components import components
from .textblocks import keep_pages, mix, shingle_sets

WIDTH = 5
BUCKET_BYTES = 2 << 20  # text whose slices make about as many bytes; a task gets several such buckets
FLUSH_BYTES = 48 << 20
BLOCK = 1024
NULL_ID = -(2**63)
_U = np.uint64


def bands(upto: int) -> list[tuple[int, int]]:
    """Half-open ranges of set sizes, each about 2.5 times as long as the one before."""
    out, lo = [], 1
    while lo <= upto:
        hi = max(lo + 2, lo * 5 // 2)
        out.append((lo, hi))
        lo = hi
    return out


BANDS = bands(1 << 40)
EDGES = np.array([hi for _, hi in BANDS])


def schemes(size: int) -> list[tuple[int, int, int]]:
    """(scheme, slices, needed) of each band that a set of this size takes part in; needed is D + 1.

    Scheme 2k is band k; scheme 2k + 1 is for pairs across the upper edge of band k.
    """
    k = int(np.searchsorted(EDGES, size, "right"))
    lo, hi = BANDS[k]
    most = min(size * 5 // 4, hi - 1)
    out = [(2 * k, slices(2 * k), (size + most) // 9 + 1)]
    if size * 5 // 4 >= hi:  # may link with a larger set across the upper edge
        out.append((2 * k + 1, slices(2 * k + 1), (size + size * 5 // 4) // 9 + 1))
    if k and (size * 4 + 4) // 5 <= lo - 1:  # or with a smaller one across the lower edge
        out.append((2 * k - 1, slices(2 * k - 1), (size + lo - 1) // 9 + 1))
    return out


def slices(scheme: int) -> int:
    lo, hi = BANDS[scheme // 2]
    largest = 2 * (hi - 1) // 9 if scheme % 2 == 0 else (hi - 1 + (hi - 1) * 5 // 4) // 9
    wanted = -(-lo * 65 // 100) if scheme % 2 == 0 else -(-hi * 32 // 100)
    return max(largest + 1, wanted + 2)


def sketch_bits(size: int) -> int:
    """At least twice the size, a power of two: a longer sketch can be folded to a shorter one."""
    return 1 << max(6, (2 * size - 1).bit_length())


def emitted(shingles: np.ndarray, scheme: int, m: int, needed: int) -> np.ndarray:
    """64-bit digests of the slices that a set emits; shingles ascend, so each slice is a run."""
    piece = ((shingles >> _U(32)) * _U(m)) >> _U(32)
    first = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
    parity = np.bitwise_xor.reduceat(mix(shingles & _U(0xFFFFFFFF)), first)
    count = np.diff(np.append(first, len(shingles))).astype(np.uint64)
    at = piece[first]
    if len(first) < needed:  # empty slices take part as well
        empty = np.setdiff1d(np.arange(m, dtype=np.uint64), at)
        parity, count, at = np.append(parity, np.zeros(len(empty), np.uint64)), np.append(count, np.zeros(len(empty), np.uint64)), np.append(at, empty)
    digest = mix(parity ^ mix(at + _U(scheme << 48)))
    if len(digest) > needed:
        rank = (np.minimum(count, _U(255)) << _U(56)) | (digest >> _U(8))
        digest = digest[np.argpartition(rank, len(rank) - needed)[len(rank) - needed :]]
    return digest


def parity_sketch(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Each shingle flips one of ``bits`` bits."""
    flips = np.bincount((shingles & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.uint64)


_PACKED = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("keys", "ids", "texts", "who", "sizes", "sketches")]])
_PACKED_DDL = "bucket int, keys binary, ids binary, texts binary, who binary, sizes binary, sketches binary"


def _emit(n_buckets: int, width: int):
    def run(batches):
        keep_pages()
        keys, ids, texts, who, sizes, sketches = [], [], [], [], [], []

        def flush():
            k = np.concatenate([np.zeros(0, np.uint64), *keys])
            i, t = (np.repeat(np.array(x, np.int64), [len(x) for x in keys]) for x in (ids, texts))
            # a text's size and sketch go to the bucket of its key, where those from other tasks meet them
            w, n = np.array(who, np.int64), np.array(sizes, np.int64)
            bucket, own_bucket = (((x >> _U(32)) * _U(n_buckets) >> _U(32)).astype(np.int32) for x in (k, w.view(np.uint64)))
            order, own_order = np.argsort(bucket, kind="stable"), np.argsort(own_bucket, kind="stable")
            k, i, t, bucket, own_bucket = k[order], i[order], t[order], bucket[order], own_bucket[own_order]
            there = np.unique(np.concatenate((bucket, own_bucket)))  # however many buckets there are, only these get rows
            lows, highs = np.searchsorted(bucket, there), np.searchsorted(bucket, there, "right")
            own_lows, own_highs = np.searchsorted(own_bucket, there), np.searchsorted(own_bucket, there, "right")
            rows = []
            for b, lo, hi, own_lo, own_hi in zip(*(x.tolist() for x in (there, lows, highs, own_lows, own_highs))):
                own = own_order[own_lo:own_hi]
                rows.append((b, k[lo:hi].tobytes(), i[lo:hi].tobytes(), t[lo:hi].tobytes(), w[own].tobytes(), n[own].tobytes(), b"".join(sketches[j] for j in own.tolist())))
            for held in (keys, ids, texts, who, sizes, sketches):
                held.clear()
            for lo in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[lo : lo + 64]), _PACKED)], schema=_PACKED)

        held, seen = 0, set()
        for batch in batches:
            new = []
            for x in batch.column(3).to_pylist():
                new.append(x not in seen)
                seen.add(x)
            batch = batch.filter(pa.array(new, pa.bool_()))
            for doc, key, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2), width)):
                size = len(shingles)
                who.append(key)
                sizes.append(size)
                sketches.append(parity_sketch(shingles, sketch_bits(size)).tobytes())
                for scheme, m, needed in schemes(size):
                    keys.append(emitted(shingles, scheme, m, needed))
                    ids.append(doc)
                    texts.append(key)
                    held += 24 * needed
                if held > FLUSH_BYTES:
                    yield from flush()
                    held = 0
        yield from flush()

    return run


_MET = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("sketch", pa.binary())])
_MET_DDL = "kind byte, a long, b long, sketch binary"


def _met(table: pa.Table) -> pa.Table:
    """Kind 0: (text, set size, sketch). 1: candidate (smallest text of a slice, other text). 2: (group, text) of slices with three texts or more."""
    joined = lambda c, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in table[c].to_pylist())])
    keys, ids, texts, who, sizes = joined("keys", np.uint64), *(joined(c, np.int64) for c in ("ids", "texts", "who", "sizes"))
    ends = np.cumsum([sketch_bits(n) // 8 for n in sizes.tolist()], dtype=np.int64)
    raw = b"".join(table["sketches"].to_pylist())
    sketches = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
    once = list(dict(zip(zip(who.tolist(), sketches), range(len(who)))).values())  # tasks that read copies send the same
    who, sizes, sketches = who[once], sizes[once], [sketches[k] for k in once]
    order = np.argsort(keys, kind="stable")
    keys, ids, texts = keys[order], ids[order], texts[order]
    run = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    length = np.diff(np.append(run, len(keys)))
    many = np.repeat(length > 1, length)
    keys, ids, texts = keys[many], ids[many], texts[many]
    stars = groups = np.zeros((0, 2), np.int64)
    if len(keys):
        # each text once, with the smallest id that a task met it under; then by that id: originals tend to come first
        order = np.lexsort((ids, texts, keys))
        keys, ids, texts = keys[order], ids[order], texts[order]
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])))
        keys, ids, texts = keys[new], ids[new], texts[new]
        order = np.lexsort((texts, ids, keys))
        keys, ids = keys[order], texts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        length = np.diff(np.append(first, len(keys)))
        lead = np.repeat(ids[first], length)
        stars = np.unique(np.stack([lead, ids], 1)[lead != ids], axis=0)
        group = np.add.reduceat(mix(ids.view(np.uint64)), first)  # the same members have the same sum
        keep = np.zeros(len(first), bool)
        keep[np.unique(group, return_index=True)[1]] = True
        wide = np.repeat(keep & (length > 2), length)
        groups = np.stack([np.repeat(group.view(np.int64), length)[wide], ids[wide]], 1)
    rows = np.concatenate([np.stack([who, sizes], 1), stars, groups])
    kind = np.repeat(np.array([0, 1, 2], np.int8), [len(who), len(stars), len(groups)])
    sketches = pa.array(sketches + [None] * (len(rows) - len(who)), pa.binary())
    return pa.table([kind, np.ascontiguousarray(rows[:, 0]), np.ascontiguousarray(rows[:, 1]), sketches], schema=_MET)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hamming distances of one sketch to sketches of one length; the longer kind is folded to the shorter first."""
    while len(x) < y.shape[1]:
        y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
    while len(x) > y.shape[1]:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64)


def _may_link(a, b, distance, percent: int):
    """Sizes a and b and a lower bound of the symmetric difference do not rule a link out."""
    return (distance * (100 + percent) <= (a + b) * (100 - percent)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))


def _close(percent: int):
    def run(batches):
        """Pairs (a, b, size and sketch of each) that may link."""
        for batch in batches:
            a, b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            distance = np.array([_distances(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)[None])[0] for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], np.int64)
            keep = pa.array(_may_link(a, b, distance, percent), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)

    return run


def shingles(text: bytes, width: int) -> set[tuple[bytes, ...]]:
    """The set itself; ASCII capitals count as small, and words end at the same bytes as everywhere here."""
    words = text.lower().split()
    return set(zip(*(words[j:] for j in range(width)))) if len(words) >= width else {tuple(words)} - {()}


def _verify(width: int, percent: int):
    def run(batches):
        """The pairs whose sets of words, compared as bytes, are similar enough."""
        for batch in batches:
            keep, last, x = [], None, set()
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if a != last:  # pairs of one star tend to follow each other
                    last, x = a, shingles(a, width)
                y = shingles(b, width)
                both = len(x & y)
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _near(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Pairs of the block pairs of one bucket that are in different components and may link."""
        t = table.combine_chunks().sort_by([("grp", "ascending"), ("i", "ascending"), ("j", "ascending")])
        grp, i, j, side = (t[c].to_numpy() for c in ("grp", "i", "j", "side"))
        ids, size, label, sketch = t["id"].to_numpy(), t["size"].to_numpy(), t["label"].to_numpy(), t["sketch"].to_pylist()
        new = np.concatenate(([True], (grp[1:] != grp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        cuts = np.append(np.flatnonzero(new), len(grp)).tolist()
        out: set[tuple[int, int]] = set()
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            rows = np.arange(lo, hi)
            x = rows[side[lo:hi] == 0]
            y = x if i[lo] == j[lo] else rows[side[lo:hi] == 1]
            by_length: dict[int, list[int]] = {}
            for r in y.tolist():
                by_length.setdefault(len(sketch[r]), []).append(r)
            for some in by_length.values():
                grid = np.frombuffer(b"".join(sketch[r] for r in some), np.uint64).reshape(len(some), -1)
                some = np.array(some)
                for r in x.tolist():
                    other = (label[some] != label[r]) & (ids[some] != ids[r])
                    if x is y:
                        other &= some > r
                    if other.any():
                        at = some[other]
                        at = at[_may_link(size[at], size[r], _distances(np.frombuffer(sketch[r], np.uint64), grid[other]), percent)]
                        out.update((min(k, ids[r]), max(k, ids[r])) for k in ids[at].tolist())
        pairs = np.array(sorted(out), np.int64).reshape(-1, 2)
        return pa.table({"a": np.ascontiguousarray(pairs[:, 0]), "b": np.ascontiguousarray(pairs[:, 1])})

    return run


def classes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``: components of the links of similarity 0.8 or more."""
    percent = 80  # slices() and schemes() are derived from it
    node, text = F.coalesce("doc_id", F.lit(NULL_ID)), shared.whole_text()
    whole = docs.select(node.alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    narrow = shared.stored(whole.select("id", "digest", F.col("text").rlike(shared.WORD).alias("words"), F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    total = narrow.agg(F.sum("n_bytes")).collect()[0][0] or 0
    n_buckets = max(2 * shared.shuffle_partitions(docs.sparkSession), total // BUCKET_BYTES)
    # aggregates are stored before they are joined: a digest with very many copies then is a skewed join that Spark splits
    heads = shared.stored(narrow.where("words").groupBy("digest").agg(F.min("id").alias("head")), "heads")
    copies = shared.stored(narrow.where("words").join(heads, "digest").where("id != head").select("id", "head"), "copies")
    # a text's key stands for it until the smallest of its copies does: what a task reads first need not be that one
    keys = shared.stored(heads.select(F.xxhash64("digest").alias("key"), "digest", "head"), "keys")
    packed = whole.where(F.col("text").rlike(shared.WORD)).select("id", F.xxhash64("digest").alias("key"), "text", "digest").mapInArrow(_emit(n_buckets, width), _PACKED_DDL)
    met = shared.stored(packed.groupBy("bucket").applyInArrow(_met, _MET_DDL), "met")
    texts_met = met.where("kind = 0").select(F.col("a").alias("key"), F.col("b").alias("size"), "sketch").join(keys, "key")
    texts_met = shared.stored(texts_met, "sketches")
    sketches = texts_met.select(F.col("head").alias("id"), "size", "sketch")
    sizes = shared.stored(texts_met.groupBy("digest").agg(F.max("size").alias("size")), "sizes")

    def to_heads(rows: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            rows = rows.join(keys.select(F.col("key").alias(c), "head"), c).withColumn(c, F.col("head")).drop("head")
        return rows

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b), a < b, whose texts link; only the texts of these candidates move."""
        pairs = shared.stored(pairs, "pairs")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        ids = shared.stored(ids.repartitionByRange(1 + shared.shuffle_partitions(docs.sparkSession) // 16, "id").sortWithinPartitions("id"), "ids")
        texts = shared.stored(whole.select("id", "text").join(ids, "id", "left_semi"), "texts")
        x, y = (texts.select(F.col("id").alias(c), F.col("text").cast("binary").alias(c + "_text")) for c in "ab")
        full = pairs.join(x, "a").join(y, "b").select("a", "b", "a_text", "b_text")
        return shared.stored(full.mapInArrow(_verify(width, percent), "a long, b long"), "verified")

    def sides(pairs: DataFrame) -> DataFrame:
        for c in "ab":
            pairs = pairs.join(sketches.select(F.col("id").alias(c), F.col("size").alias(c + "_size"), F.col("sketch").alias(c + "_sketch")), c)
        return pairs.select("a", "b", "a_size", "b_size", "a_sketch", "b_sketch")

    stars = to_heads(met.where("kind = 1").select("a", "b").distinct(), "a", "b")
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    links = linked(sides(stars).mapInArrow(_close(percent), "a long, b long").distinct())
    same = copies.select(F.col("id").alias("a"), F.col("head").alias("b"))
    label = components(links.union(same))

    groups = to_heads(met.where("kind = 2").select(F.col("a").alias("grp"), F.col("b").alias("id")).distinct(), "id").distinct()
    groups = groups.join(label.withColumnRenamed("node", "id"), "id", "left").select("grp", "id", F.coalesce("component", "id").alias("label"))
    groups = shared.stored(groups, "groups")
    open_groups = groups.groupBy("grp").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members")).where("lo < hi AND members > 2")
    open_groups = shared.stored(open_groups.select("grp", "members"), "open")
    if not open_groups.isEmpty():
        n = F.ceil(F.col("members") / BLOCK).cast("int")
        members = groups.join(open_groups, "grp").select("grp", "id", "label", n.alias("n"), F.pmod(F.xxhash64("id"), n).cast("int").alias("home"))
        members = members.select("*", F.explode(F.expr("sequence(0, n - 1)")).alias("other")).join(sketches, "id")
        members = members.select(
            "grp", "id", "label", "size", "sketch", F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j"), (F.col("home") > F.col("other")).cast("int").alias("side")
        ).withColumn("bucket", F.pmod(F.xxhash64("grp", "i", "j"), F.lit(2 * n_buckets)))
        near = members.groupBy("bucket").applyInArrow(_near(percent), "a long, b long").distinct()
        label = components(links.union(same).union(linked(near)))

    out = narrow.join(sizes, "digest", "left").join(label.withColumnRenamed("node", "id"), "id", "left")
    out = out.select("id", F.when(F.col("words"), F.col("size")).otherwise(0).cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component"))
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(back("id").alias("doc_id"), "n_shingles", back("component").alias("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` without those that link to a row that stays, with all their columns.

    Rows that share a ``doc_id``, or have none, are told apart by numbers of their own, so each is judged by its own text; of a component of rows the one with the smallest ``doc_id`` stays (null last, then the row read first).
    """
    node = shared.fresh("node", docs)
    repeated = docs.groupBy(F.col("doc_id").alias("own_id")).agg(F.count("*").alias("n")).where("n > 1 OR own_id IS NULL")
    repeated = shared.stored(repeated.select("own_id", F.lit(True).alias("again")), "repeated")
    if repeated.isEmpty():
        rows = docs.withColumn(node, F.col("doc_id").cast("long"))
    else:  # rows whose id is not theirs alone get numbers above all ids
        most = docs.agg(F.max(F.col("doc_id").cast("long"))).collect()[0][0]
        row, again = shared.fresh("row", docs), shared.fresh("again", docs)
        numbered = shared.stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        marked = numbered.join(repeated.withColumnRenamed("again", again), numbered["doc_id"].eqNullSafe(repeated["own_id"]), "left")
        number = F.when(F.col(again), F.lit(max(most or 0, 0) + 1) + F.col(row)).otherwise(F.col("doc_id").cast("long"))
        rows = shared.stored(marked.select(*docs.columns, number.alias(node)), "nodes")
    found = classes(rows.select(F.col(node).alias("doc_id"), "text"), width)
    members = found.where("doc_id <> component_id").select(F.col("doc_id").alias("node"), "component_id")
    members = shared.stored(members.union(members.select("component_id", "component_id").distinct()), "members")
    named = members.join(rows.select(F.col(node).alias("node"), F.col("doc_id").alias("own_id")), "node")
    stays = named.groupBy("component_id").agg(F.min(F.struct(F.col("own_id").isNull(), "own_id", "node")).alias("least"))
    dropped = members.join(stays.select(F.col("least.node").alias("node")), "node", "left_anti").select(F.col("node").alias(node))
    return rows.join(shared.stored(dropped, "dropped"), node, "left_anti").select(*docs.columns)


def op6_parity_join(spark, sf_dir: str) -> DataFrame:
    return classes(shared.documents(spark, sf_dir))
