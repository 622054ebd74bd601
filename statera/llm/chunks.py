"""Substring dedup by content-defined chunks.

A gear hash rolls over the 16 bytes before each position.  A text is cut after a position whose scrambled hash is above
those of the ``REACH`` positions before it and not below those of the ``REACH`` after it, where a character begins.
Cuts thus depend on nothing but the bytes within ``REACH + WINDOW`` of them: an insertion moves only the chunks it
touches, and two texts that share a passage cut it alike from its second chunk on, with no search for a common cut.
Chunks have more than ``REACH`` bytes and about twice as many; runs without a cut are cut every ``MOST`` bytes.  Their
128-bit digests travel packed; the first chunk with a digest, by document and position, stays, later ones are repeats.
A document loses all of them.

Defined results: null counts as empty, and an empty text has no chunk; a short text is one chunk;
order is by doc_id (null first), then the number of the row (rows of one id are documents of their own, in the order
in which they are read), then position; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared, spread
from .textblocks import blocks, mix

WINDOW = 16
REACH = 48
MOST = 512
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)
#: the order in which hashes are compared: 1 and more, so that 0 is left for places that cannot be cut
ORDER = (mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64)) >> np.uint64(33)).astype(np.uint32) + np.uint32(1)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the codes of the last 16 bytes, each shifted by its distance; by doubling."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint16(width))
        width *= 2
    return h


def sliding_max(x: np.ndarray, width: int) -> np.ndarray:
    """The largest of ``width`` values from each place on, or of those that are left; by doubling."""
    x, n = x.copy(), 1
    while n < width:
        step = min(n, width - n)
        x[:-step] = np.maximum(x[:-step], x[step:])
        n += step
    return x


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks (positions in ``data``) and the n + 1 offsets of each text's chunks."""
    inside = (data & 0xC0) == 0x80  # bytes that continue a character
    value = ORDER[gear_hash(data)]
    value[:-1][inside[1:]] = 0
    before = sliding_max(np.concatenate((np.zeros(REACH, np.uint32), value)), REACH)[: len(data)]
    may = np.flatnonzero(((value > before) & (value == sliding_max(value, REACH + 1)))[:-1]) + 1
    text = np.searchsorted(offsets, may, "right") - 1
    may = may[(may - offsets[text] >= REACH + WINDOW) & (offsets[text + 1] - may >= REACH)]
    ends = np.sort(np.concatenate((may, offsets[1:][offsets[1:] > offsets[:-1]])))
    begins = np.concatenate((np.zeros(min(1, len(ends)), np.int64), ends[:-1]))
    forced = []
    for k in np.flatnonzero(ends - begins > MOST).tolist():
        lo, hi = int(begins[k]), int(ends[k])
        while hi - lo > MOST:
            lo = _back(inside, lo + MOST)
            forced.append(lo)
    ends = np.sort(np.concatenate((ends, np.array(forced, np.int64))))
    return ends, np.searchsorted(ends, offsets, "right")


def _back(inside: np.ndarray, at: int) -> int:
    while inside[at]:
        at -= 1
    return at


def starts(ends: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.concatenate((np.zeros(min(1, len(ends)), np.int64), ends[:-1]))
    some = at[1:] > at[:-1]
    out[at[:-1][some]] = offsets[:-1][some]
    return out


COLUMNS = ("keys", "hashes", "docs", "rows", "places")


def chunk_keys(data: np.ndarray, offsets: np.ndarray):
    """Digest (keys) and number (places) of every chunk of every text, and the n + 1 offsets of each text's chunks."""
    ends, at = cuts(data, offsets)
    begins = starts(ends, at, offsets)
    keys, hashes = spread.digests(data.tobytes(), begins, ends)
    return {"keys": keys, "hashes": hashes, "places": np.arange(len(ends)) - np.repeat(at[:-1], np.diff(at))}, at


def split_repeats(e: spread.Arrays) -> tuple[spread.Arrays, spread.Arrays]:
    """The first entry of each digest (keys and hashes), and the others but for repeats of the very same place."""
    e = spread.take(e, np.lexsort((e["places"], e["rows"], e["docs"], e["hashes"], e["keys"])))
    n = len(e["keys"])
    new = np.concatenate((np.ones(min(1, n), bool), (e["keys"][1:] != e["keys"][:-1]) | (e["hashes"][1:] != e["hashes"][:-1])))
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    again = (e["rows"] != e["rows"][head]) | (e["places"] != e["places"][head])
    return spread.take(e, new), spread.take(e, again)


def _fold(e: spread.Arrays):
    first, again = split_repeats(e)
    return [(spread.ENTRY, first), (spread.MARK, again)]


def _settle(n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """Marks the chunks that are not the first with their digest; marks made before pass through."""
        _, again = split_repeats(spread.unpack(spread.of_kind(table, spread.ENTRY), COLUMNS))
        made = pa.Table.from_batches(list(spread.pack(spread.MARK, again, n_buckets)), spread.schema(COLUMNS))
        return pa.concat_tables([spread.of_kind(table, spread.MARK).cast(made.schema), made])

    return run


def _remove(ids, rows, texts, found) -> pa.Table:
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    spans = []
    for lo, hi in blocks(offsets):
        part = offsets[lo : hi + 1] - offsets[lo]
        ends, at = cuts(np.frombuffer(b"".join(texts[lo:hi]), np.uint8), part)
        begins = starts(ends, at, part)
        for k in range(lo, hi):
            a, b = at[k - lo], at[k - lo + 1]
            s, e = begins[a:b] - part[k - lo], ends[a:b] - part[k - lo]
            mark = np.zeros(b - a + 2, bool)
            mark[found(rows[k])["places"].astype(np.int64) + 1] = True
            edge = np.flatnonzero(mark[1:] != mark[:-1])
            spans.append([(int(s[x]), int(e[y - 1])) for x, y in zip(edge[::2], edge[1::2])])
    return spread.without(ids, texts, spans)


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges), kept (the rest of the text as UTF-8)."""
    table, n = spread.numbered(docs)
    found = spread.entries(table, chunk_keys, _fold, n, COLUMNS).groupBy("bucket").applyInArrow(_settle(n), spread.ddl(COLUMNS))
    return spread.to_documents(spread.with_texts(table, found, n, _remove, spread.REMOVED, COLUMNS))


def op9_gear_chunks(spark, sf_dir: str) -> DataFrame:
    return spread.digest_columns(deduplicate(shared.documents(spark, sf_dir)))
