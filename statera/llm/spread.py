"""Many small entries about places in texts through one shuffle: packed arrays per bucket instead of a row each.

A row holds the arrays of one bucket's entries and their kind.  Entries meet by a bucket of their key; what is then
decided about documents is packed by a bucket of the document and meets the texts there.  Tasks flush what they hold
every ``FLUSH_BYTES``, so their memory is bounded; before a flush, ``fold`` may settle entries that meet inside the
task already, so that a key with a third of all entries reaches its bucket once a flush.

A document is a row: :func:`numbered` stores every row once under a number of its own, and entries carry that number
beside the doc_id, so rows that share an id, or have none, never meet each other's entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import xxhash

from . import shared
from .textblocks import blocks, flat, keep_pages

FLUSH_BYTES = 48 << 20
GROUP_BYTES = 4 << 20  # text of a bucket of documents; its entries take about as much
NULL_ID = -(2**63)
#: kinds of rows: those in BY_DOCUMENT are packed by document, all others by key
MARK, ENTRY, ASK = 0, 1, 3
BY_DOCUMENT = (MARK, ASK)
TYPES = {"keys": np.uint64, "hashes": np.uint64, "docs": np.int64, "rows": np.int64, "places": np.uint32, "counts": np.uint8}
_U = np.uint64
Arrays = dict[str, np.ndarray]


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """A stored table (row, id, text, n_bytes) of all rows, and a number of buckets in which texts take some megabytes.

    ``row`` is unique; ``id`` is doc_id, the least number for null; null texts are empty.
    """
    text = shared.whole_text()
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    table = shared.stored(docs.select(F.monotonically_increasing_id().alias("row"), id_.alias("id"), text.alias("text"), F.octet_length(text).alias("n_bytes")), "numbered")
    total = table.agg(F.sum(F.col("n_bytes").cast("long"))).collect()[0][0] or 0
    return table, max(shared.shuffle_partitions(docs.sparkSession), total // GROUP_BYTES) | 1


def digests(raw: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of slices, as two columns of 64 bits."""
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(starts.tolist(), stops.tolist())]), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def ddl(columns: tuple[str, ...]) -> str:
    return "bucket int, kind int, " + ", ".join(f"{c} binary" for c in columns)


def schema(columns) -> pa.Schema:
    return pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *[(c, pa.binary()) for c in columns]])


def of_key(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return (((keys >> _U(32)) * _U(n_buckets)) >> _U(32)).astype(np.int32)


def of_row(rows: np.ndarray, n_buckets: int) -> np.ndarray:
    u = rows.view(np.uint64)
    return ((u ^ (u >> _U(17)) ^ (u >> _U(31))).view(np.int64) % n_buckets).astype(np.int32)


def bucket_of(row: str, n_buckets: int) -> Column:
    """of_row as a column."""
    folded = F.col(row).bitwiseXOR(F.shiftrightunsigned(row, 17)).bitwiseXOR(F.shiftrightunsigned(row, 31))
    return F.pmod(folded, F.lit(n_buckets)).cast("int")


def pack(kind: int, arrays: Arrays, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows for the buckets that have entries; a bucket's entries keep their order."""
    bucket = of_row(arrays["rows"], n_buckets) if kind in BY_DOCUMENT else of_key(arrays["keys"], n_buckets)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    ends = np.append(first[1:], len(order))
    arrays = {c: a[order] for c, a in arrays.items()}
    for lo in range(0, len(found), 64):
        parts = [slice(a, b) for a, b in zip(first[lo : lo + 64], ends[lo : lo + 64])]
        columns = [pa.array(found[lo : lo + 64], pa.int32()), pa.array([kind] * len(parts), pa.int32())]
        yield pa.RecordBatch.from_arrays(columns + [pa.array([a[p].tobytes() for p in parts], pa.binary()) for a in arrays.values()], schema=schema(arrays))


def unpack(table: pa.Table, columns: tuple[str, ...]) -> Arrays:
    return {c: np.concatenate([np.zeros(0, TYPES[c]), *(np.frombuffer(x, TYPES[c]) for x in table[c].to_pylist())]) for c in columns}


def of_kind(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pc.equal(table["kind"], kind))


def take(arrays: Arrays, which) -> Arrays:
    return {c: a[which] for c, a in arrays.items()}


def entries(table: DataFrame, find: Callable, fold: Callable, n_buckets: int, columns: tuple[str, ...]) -> DataFrame:
    """Packed entries of every text of a :func:`numbered` table.

    find(data, offsets) gets the bytes of some texts and their n + 1 offsets; it returns the arrays of their entries
    without docs and rows, and the n + 1 offsets of each text's entries.  fold(arrays) returns (kind, arrays) pairs.
    """

    def run(batches):
        keep_pages()
        held: list[Arrays] = []

        def flush():
            arrays = {c: np.concatenate([h[c] for h in held]).astype(TYPES[c], copy=False) for c in columns}
            held.clear()
            for kind, part in fold(arrays):
                yield from pack(kind, part, n_buckets)

        size = 0
        for batch in batches:
            rows, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = flat(batch.column(2))
            for lo, hi in blocks(offsets):
                found, cuts = find(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                n = np.diff(cuts)
                held.append({**found, "docs": np.repeat(ids[lo:hi], n), "rows": np.repeat(rows[lo:hi], n)})
                size += sum(TYPES[c](0).nbytes for c in columns) * int(cuts[-1])
                if size > FLUSH_BYTES:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return table.select("row", "id", "text").mapInArrow(run, ddl(columns))


def with_texts(table: DataFrame, packed: DataFrame, n_buckets: int, apply: Callable, out: str, columns: tuple[str, ...]) -> DataFrame:
    """apply(doc_ids, rows, texts, found) for buckets of documents, where found(row) gives the arrays packed for it.

    A bucket's documents and what was found in them meet in one task; documents are spread evenly by their numbers.
    """

    def run(table: pa.Table, marks: pa.Table) -> pa.Table:
        keep_pages()
        m = unpack(marks, columns)
        m = take(m, np.lexsort((m["places"], m["rows"])))
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(m["rows"])), bool), m["rows"][1:] != m["rows"][:-1])))
        ends = np.append(first[1:], len(m["rows"]))
        index = dict(zip(m["rows"][first].tolist(), zip(first.tolist(), ends.tolist())))

        def found(row: int) -> Arrays:
            lo, hi = index.get(row, (0, 0))
            return {c: a[lo:hi] for c, a in m.items()}

        return apply(table["id"].to_pylist(), table["row"].to_pylist(), table["text"].to_pylist(), found)

    texts = table.select(bucket_of("row", n_buckets).alias("bucket"), "row", "id", F.col("text").cast("binary").alias("text"))
    return texts.groupBy("bucket").cogroup(packed.groupBy("bucket")).applyInArrow(run, out)


REMOVED = "id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"
_REMOVED = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])


def without(ids: list[int], texts: list[bytes], spans: list[list[tuple[int, int]]]) -> pa.Table:
    """The texts without their spans (ascending, apart from each other), as rows of ``REMOVED``."""
    rest = []
    for text, cuts in zip(texts, spans):
        ends = [0, *(stop for _, stop in cuts)]
        rest.append(b"".join(text[a:b] for a, b in zip(ends, [*(start for start, _ in cuts), len(text)])))
    columns = [ids, [len(t) for t in texts], [[{"start": int(a), "stop": int(b)} for a, b in s] for s in spans], rest]
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _REMOVED)], schema=_REMOVED)


def to_documents(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges), kept (the rest of the text, UTF-8 bytes)."""
    return removed.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "n_bytes", "spans", "kept")


def digest_columns(result: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.stop - s.start)
    return result.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
