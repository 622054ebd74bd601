"""Source divergence audit: how the sources of a language differ in their words, by dense blocks of terms.

Tasks count terms per (lang, source) in one pass over the texts and pack what they found by buckets of (lang, term), where
sums are taken.  Terms in at least ``least`` documents of their
language are dealt by hash into blocks of about ``BLOCK_TERMS``.  A block of a language is one dense int64 tile, a row
a source and a column a term; all pairs of its rows are taken at once by broadcasting, and every tile gives a partial
matrix of pair values and, for each source, its ``top`` terms of the block.  Partial matrices are summed by Spark, the
blocks' term lists merged by one ranked window.  Languages of many sources are cut into tiles of about ``TILE_SOURCES``
sources, and tiles meet in pairs, so no task holds more than two of them.

Probabilities are integers, 1 + floor(10^9 (count + 5) / (N + 5 V)), taken by long division in steps of a thousand, so
totals up to 9 * 10^15 stay exact.

Defined results: null texts, languages and sources are empty strings; every row is a document of its own, whatever its
id; a source without terms still takes part with counts of 0; a language without kept terms has pair values of 0 and no
term rows; a language of one source has no pairs; other columns are ignored; no documents, no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

LEAST = 30
TOP = 50
BLOCK_TERMS = 512
TILE_SOURCES = 128
PAIR_CELLS = 1 << 21  # cells that are broadcast at once
HELD_TERMS = 1 << 19  # entries that a task holds before it gives them on
TEXT_BYTES = 4 << 20  # of a text that are split into terms at once
BUCKET_BYTES = 8 << 20  # text whose terms meet in one bucket, on average
#: bytes as they separate terms: space for all ASCII but letters
APART = bytes(i if i >= 0x80 or 0x41 <= i <= 0x5A or 0x61 <= i <= 0x7A else 0x20 for i in range(256))
PACKED = pa.schema([("bucket", pa.int64()), ("langs", pa.list_(pa.string())), ("sources", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("n", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])
PACKED_DDL = "bucket long, langs array<string>, sources array<string>, sizes array<long>, terms array<binary>, n array<long>, docs array<long>"
COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("lang_n", pa.int64()), ("first", pa.bool_())])


def terms(text: bytes):
    """Lists of the terms of one text, each of some megabytes at most unless one term is longer."""
    text = text.lower().translate(APART)  # of bytes, lower() changes A to Z only
    at = 0
    while at < len(text):
        end = len(text) if at + TEXT_BYTES >= len(text) else text.find(b" ", at + TEXT_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def packed_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """Terms, occurrences and documents of each (lang, source) as far as a task has seen them, packed by a bucket of (lang, term)."""

    def run(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def flush():
            """A row a bucket: its (lang, source) pairs, how many terms of each, and those terms one pair after the other."""
            if not held:
                return
            pairs = list(held)
            keys, salts = [], [zlib.crc32((lang + "\0").encode()) for lang, _ in pairs]
            bucket, pair = [], []
            for k, (n, _) in enumerate(held.values()):
                keys += n
                bucket.append(np.array([zlib.crc32(t, salts[k]) for t in n], np.int64) % buckets)
                pair.append(np.full(len(n), k))
            bucket, pair = np.concatenate(bucket), np.concatenate(pair)
            order = np.lexsort((pair, bucket))
            bucket, pair, taken = bucket[order], pair[order], pa.array(order)
            new = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), (bucket[1:] != bucket[:-1]) | (pair[1:] != pair[:-1]))))
            quiet = np.array([k for k, (n, _) in enumerate(held.values()) if not n], np.int64)  # known all the same
            of, run = np.append(pair[new], quiet), np.append(bucket[new], np.array(salts, np.int64)[quiet] % buckets)
            sizes = np.append(np.diff(np.append(new, len(order))), np.zeros(len(quiet), np.int64))
            runs = np.argsort(run, kind="stable")
            of, run, sizes = of[runs], run[runs], sizes[runs]
            found, first = np.unique(run, return_index=True)
            by_run = pa.array(np.append(first, len(run)), pa.int32())
            by_term = pa.array(np.concatenate(([0], np.cumsum(sizes)))[np.append(first, len(run))], pa.int32())
            names = [pa.array([p[j] for p in pairs], pa.string()).take(pa.array(of)) for j in (0, 1)]
            values = [pa.array(keys, pa.binary()), pa.array([c for n, _ in held.values() for c in n.values()], pa.int64()), pa.array([d[t] for n, d in held.values() for t in n], pa.int64())]
            lists = [pa.ListArray.from_arrays(by_run, c) for c in (*names, pa.array(sizes))] + [pa.ListArray.from_arrays(by_term, c.take(taken)) for c in values]
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(found), *lists], schema=PACKED)

        size = 0
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, text in enumerate(batch.column(2)):
                n, d = held.setdefault((langs[k], sources[k]), (Counter(), Counter()))
                before, own = len(n), set()
                for some in terms(text.as_py()):
                    n.update(some)
                    own.update(some)
                d.update(own)
                size += len(n) - before
                if size > HELD_TERMS:
                    yield from flush()
                    size = 0
        yield from flush()

    empty = F.lit("")
    rows = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), shared.whole_text().cast("binary").alias("text"))
    return rows.mapInArrow(run, PACKED_DDL)


def _counted(table: pa.Table, least: int) -> pa.Table:
    """The kept terms of a bucket with their counts in each (lang, source) and in the language; a null term for each (lang, source)."""
    table = table.combine_chunks()
    langs, sources, sizes, words, n, docs = (table[c].combine_chunks().flatten() for c in PACKED.names[1:])
    of = pa.array(np.repeat(np.arange(len(langs)), sizes.to_numpy()))
    flat = pa.table({"lang": langs.take(of), "source": sources.take(of), "term": words, "n": n, "docs": docs})
    each = flat.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    whole = each.group_by(["lang", "term"]).aggregate([("n_sum", "sum"), ("docs_sum", "sum"), ("source", "min")])
    whole = whole.filter(pc.greater_equal(whole["docs_sum_sum"], least))
    kept = each.join(whole, ["lang", "term"], join_type="inner")
    columns = [kept["lang"], kept["source"], kept["term"], kept["n_sum"], kept["n_sum_sum"], pc.equal(kept["source"], kept["source_min"])]
    groups = pa.table({"lang": langs, "source": sources}).group_by(["lang", "source"]).aggregate([])
    zeros = pa.array(np.zeros(len(groups), np.int64))
    marks = [groups["lang"], groups["source"], pa.nulls(len(groups), pa.binary()), zeros, zeros, pa.array(np.zeros(len(groups), bool))]
    return pa.concat_tables([pa.Table.from_arrays(c, schema=COUNTED) for c in (columns, marks)])


def counts(docs: DataFrame, least: int) -> DataFrame:
    """lang, source, term, n, lang_n, first (once a term) for every term in ``least`` documents of its language; null terms name the sources."""
    total = docs.agg(F.sum(F.octet_length(shared.whole_text()).cast("long"))).collect()[0][0] or 0
    buckets = max(16, total // BUCKET_BYTES) | 1
    return packed_counts(docs, buckets).groupBy("bucket").applyInArrow(lambda t: _counted(t, least), "lang string, source string, term binary, n long, lang_n long, `first` boolean")


def probabilities(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 n / total), exactly."""
    out, rest = np.zeros(np.broadcast(n, total).shape, np.int64), np.broadcast_to(n, np.broadcast(n, total).shape)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


TILE = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _tile(table: pa.Table, top: int) -> pa.Table:
    """Partial pair values and the top terms of each source for one block and one pair of source tiles."""
    lang, a, b = table["lang"][0].as_py(), table["a"][0].as_py(), table["b"][0].as_py()
    heads = table.filter(pc.is_null(table["term"]))
    cells = table.filter(pc.is_valid(table["term"]))
    names = heads["source"].to_pylist()
    side = heads["tile"].to_numpy()
    v5 = 5 * heads["terms"][0].as_py()
    totals = heads["total"].to_numpy() + v5
    words = pc.unique(cells["term"])
    order = pc.index_in(cells["term"], words).to_numpy(zero_copy_only=False).astype(np.int64)
    row = pc.index_in(cells["source"], pa.array(names)).to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.zeros((len(names), len(words)), np.int64)
    n[row, order] = cells["n"].to_numpy()
    p = probabilities(n + 5, np.maximum(totals, 1)[:, None])
    out = []
    # a term that none of these sources has still counts in every pair: all terms are taken as absent once, in block 0,
    # and the terms seen here add what they change
    zero = probabilities(np.int64(5), np.maximum(totals, 1))
    absent = np.abs(zero[:, None] - zero[None, :])
    pair = absent * ((v5 // 5 if table["block"][0].as_py() == 0 else 0) - len(words))
    left, right = np.flatnonzero(side == a), np.flatnonzero(side == b)
    step = max(1, PAIR_CELLS // max(1, len(left) * len(right)))
    for lo in range(0, len(words), step):
        part = p[:, lo : lo + step]
        pair[np.ix_(left, right)] += np.abs(part[left][:, None, :] - part[right][None, :, :]).sum(2)
    one, two = np.nonzero((side == a)[:, None] & (side == b)[None, :])
    if a == b:
        one, two = one[one != two], two[one != two]
        ways = [(one, two)]
    else:
        ways = [(one, two), (two, one)]
        pair[np.ix_(right, left)] = pair[np.ix_(left, right)].T
    arr = np.array(names, object)
    for x, y in ways:
        out.append(pa.Table.from_arrays([pa.array([lang] * len(x), pa.string()), pa.array(arr[x], pa.string()), pa.array(["pair"] * len(x), pa.string()), pa.array(arr[y], pa.string()), pa.array(pair[x, y])], schema=TILE))
    if a == b and len(words):
        # what the whole language counts of each term stands beside every cell of it
        whole = np.zeros(len(words), np.int64)
        whole[order] = cells["lang_n"].to_numpy()
        q = probabilities(whole + 5, np.int64(heads["lang_total"][0].as_py() + v5))
        places = pc.sort_indices(words.cast(pa.binary())).to_numpy()
        rank = np.empty(len(words), np.int64)
        rank[places] = np.arange(len(words))
        for s in range(len(names)):
            which = np.flatnonzero((n[s] > 0) & (p[s] > q))
            value = p[s][which] - q[which]
            best = np.lexsort((rank[which], -value))[:top]
            m = len(best)
            out.append(pa.Table.from_arrays([pa.array([lang] * m, pa.string()), pa.array([names[s]] * m, pa.string()), pa.array(["term"] * m, pa.string()), words.take(pa.array(which[best])).cast(pa.string()), pa.array(value[best])], schema=TILE))
    return pa.concat_tables(out)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, block_terms: int = BLOCK_TERMS, tile_sources: int = TILE_SOURCES) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank."""
    kept = shared.stored(counts(docs, least), "terms")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(F.col("first") & F.col("term").isNotNull()).alias("mine"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("mine").alias("terms"), F.count("*").alias("sources"))
    size = {"blocks": F.greatest(F.lit(1), F.ceil(F.col("terms") / block_terms)).cast("long"), "tiles": F.ceil(F.col("sources") / tile_sources).cast("long")}
    langs = shared.stored(langs.withColumns(size), "langs")
    tile = F.pmod(F.xxhash64("source"), F.col("tiles"))
    heads = groups.drop("mine").join(langs, "lang").withColumns({"tile": tile, "block": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))})
    heads = heads.select("lang", "source", "tile", "tiles", "block", F.lit(None).cast("binary").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("lang_n"), "total", "lang_total", "terms")
    none = F.lit(None).cast("long")
    cells = kept.where("term IS NOT NULL").join(langs, "lang").withColumns({"tile": tile, "block": F.pmod(F.xxhash64("term"), F.col("blocks"))})
    cells = cells.select("lang", "source", "tile", "tiles", "block", "term", "n", "lang_n", none.alias("total"), none.alias("lang_total"), none.alias("terms"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    rows = heads.unionByName(cells).withColumn("other", other).withColumns({"a": F.least("tile", "other"), "b": F.greatest("tile", "other")}).drop("tiles", "other")
    schema = "lang string, source string, part string, item string, value long"
    found = rows.groupBy("lang", "block", "a", "b").applyInArrow(lambda t: _tile(t, top), schema)
    found = shared.stored(found, "tiles")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    best = found.where("part = 'term'").select("*", rank).where(F.col("rank") <= top)
    return pairs.select("*", rank).unionByName(best)


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(shared.documents(spark, sf_dir))


_TERM = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
OP12_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= {LEAST}),
found AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM docs),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
sums AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM found GROUP BY lang, source),
every AS (SELECT g.lang, g.source, k.term, coalesce(f.n, 0)::HUGEINT AS n, coalesce(s.total, 0)::HUGEINT AS total, v.v
          FROM groups g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source),
probs AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (total + 5 * v) AS p FROM every),
whole AS (SELECT lang, term, 1 + (1000000000 * (sum(n) + 5)) // (any_value(all_n) + 5 * any_value(v)) AS q
          FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS all_n FROM every) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(p1 - p2)), 0) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source AS s1, y.source AS s2, x.p AS p1, y.p AS p2 FROM probs x JOIN probs y ON x.lang = y.lang AND x.term = y.term) z ON z.lang = a.lang AND z.s1 = a.source AND z.s2 = b.source
          GROUP BY a.lang, a.source, b.source),
best AS (SELECT p.lang, p.source, p.term AS item, p.p - w.q AS value FROM probs p JOIN whole w USING (lang, term) WHERE p.n > 0 AND p.p > w.q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
           UNION ALL SELECT lang, source, 'term', item, value::BIGINT, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT FROM best)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
