"""Suffix-array dedup: remove every byte covered by a ``LENGTH``-byte string that also starts earlier in the corpus.

Two equal 100-byte strings have equal 32-byte strings of least hash at the same place inside (leftmost on ties).  That
anchor names the only strings a given one can equal, so each text is cut into stretches of neighbouring 100-byte
windows with one anchor, at most 69 windows a stretch, and stretches are routed by their anchor's digest:

1. Stretches travel as places with digests of their bytes; those whose anchor no other stretch has are done.
2. Of the others the bytes are fetched from the texts and laid side by side, anchor after anchor, in shards.  Suffix
   arrays of all lanes of a shard are built by induced sorting (``suffix``), permuted common prefixes tell which
   neighbours share 100 bytes, and of the windows that are equal, the first stays.
3. A text loses the union of the repeated windows' bytes.

Anchors with more than ``whole`` bytes of stretches (many copies) send one stretch of each kind: those of one anchor
with equal length and equal 64-bit digests of all their bytes are repeats from end to end.  Anchors with more than ``shard`` bytes of different
stretches (a common line in ever new surroundings) have their windows routed one by one, by 128-bit digests of their
100 bytes, and settled by sorting those.  Tasks that find an anchor in more than ``hot`` stretches among what they hold
do both at once; where that leaves more than ``hot`` different ones, they send one marker to the anchor's bucket, upon
which the other tasks' stretches of that anchor are spread as well.

Defined results: texts are compared as UTF-8 bytes, nulls are empty, matches never cross texts, texts of fewer than
100 bytes lose nothing; earlier means smaller doc_id (null first), then number of the row (rows of one id, repeated
ones too, are documents of their own, in the order in which they are read), then place; what is left of a text may cut
characters apart, so it is binary; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from . import shared, spread
from .chunks import gear_hash, split_repeats
from .suffix import permuted_common_prefixes, suffix_arrays
from .textblocks import keep_pages

LENGTH = 100
ANCHOR = 32
WIDE = LENGTH - ANCHOR + 1  # anchors to choose from in a window
HOT = 64
WHOLE_BYTES = 512
SHARD_BYTES = 4096
LANES_BYTES = 1 << 20  # of the lanes that are sorted side by side
COLUMNS = ("keys", "hashes", "docs", "rows", "places", "counts")
FETCHED = (*COLUMNS, "bytes")
#: kinds besides spread.MARK (repeated windows) and spread.ENTRY (stretches); what is asked for is by document
WINDOW, ASK, BYTES = 2, spread.ASK, 4
_U = np.uint64


def stretches(data: np.ndarray, offsets: np.ndarray):
    """keys (of the anchor), hashes (of all bytes), places and counts of windows, and each text's offsets."""
    n = len(data)
    if n < LENGTH:
        return {c: np.zeros(0, np.int64) for c in ("keys", "hashes", "places", "counts")}, np.zeros(len(offsets), np.int64)
    # least hash and, in the low half, leftmost position of the anchors in each window, by doubling
    least = (gear_hash(data)[ANCHOR - 1 :].astype(np.uint64) << _U(32)) | np.arange(n - ANCHOR + 1, dtype=np.uint64)
    width = 1
    while width * 2 <= WIDE:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < WIDE:
        least = np.minimum(least[: width - WIDE], least[WIDE - width :])
    anchor = (least & _U(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(len(anchor) + 2, bool)
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if hi - lo >= LENGTH:
            valid[lo + 1 : hi - LENGTH + 2] = True
    turn = np.concatenate(([True], anchor[1:] != anchor[:-1], [True]))
    first = np.flatnonzero(valid[1:-1] & (turn[:-1] | ~valid[:-2]))
    last = np.flatnonzero(valid[1:-1] & (turn[1:] | ~valid[2:]))
    at = anchor[first]
    cuts = np.searchsorted(first, offsets)
    owner = np.repeat(offsets[:-1], np.diff(cuts))
    raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    keys = np.array([digest(raw[a : a + ANCHOR]) for a in at.tolist()], np.uint64)
    hashes = np.array([digest(raw[a:b]) for a, b in zip(first.tolist(), (last + LENGTH).tolist())], np.uint64)
    return {"keys": keys, "hashes": hashes, "places": first - owner, "counts": last - first + 1}, cuts


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1])))
    return first, np.diff(np.append(first, len(values)))


def by_anchor(e: spread.Arrays) -> tuple[spread.Arrays, np.ndarray]:
    """Entries by anchor, equal stretches side by side in the order of the corpus; which are the first of their kind."""
    order = np.argsort(e["keys"])
    _, length = runs(e["keys"][order])
    shared_by = np.repeat(length > 1, length)
    some = order[shared_by]  # most anchors have one entry and need no further keys
    order[shared_by] = some[np.lexsort([e[c][some] for c in ("places", "rows", "docs", "counts", "hashes", "keys")])]
    e = spread.take(e, order)
    new = np.ones(len(e["keys"]), bool)
    new[1:] = np.any([e[c][1:] != e[c][:-1] for c in ("keys", "hashes", "counts")], 0)
    return e, new


def per_anchor(e: spread.Arrays, *values: np.ndarray) -> list[np.ndarray]:
    """For each entry the sum of each of the values over its anchor."""
    first, length = runs(e["keys"])
    return [np.repeat(np.add.reduceat(v.astype(np.int64), first), length) if len(first) else np.zeros(0, np.int64) for v in values]


def _fold(limit: int):
    def fold(e: spread.Arrays):
        """What one task holds: anchors with more than ``limit`` entries keep one of each kind, or ask for windows."""
        e, new = by_anchor(e)
        n, kinds = per_anchor(e, np.ones(len(new)), new)
        many, hot = n > limit, kinds > limit
        marker = spread.take(e, hot)
        marker = spread.take(marker, runs(marker["keys"])[0])
        marker = {**marker, "hashes": np.zeros_like(marker["hashes"]), "counts": np.zeros_like(marker["counts"])}
        entries = {c: np.concatenate([a, marker[c]]) for c, a in spread.take(e, ~hot & (new | ~many)).items()}
        return [(spread.ENTRY, entries), (spread.MARK, spread.take(e, many & ~new)), (ASK, asked(spread.take(e, hot & new), windows=True))]

    return fold


def asked(e: spread.Arrays, windows: bool) -> spread.Arrays:
    """Entries to ask for: hashes say whether their windows' digests (1) or their bytes (0) are wanted."""
    return {**e, "hashes": np.full(len(e["keys"]), int(windows), np.uint64)}


def _settle(n_buckets: int, whole_bytes: int, shard_bytes: int):
    def run(table: pa.Table) -> pa.Table:
        """The stretches of a bucket's anchors are asked for as bytes or windows; other rows pass through."""
        keep_pages()
        e, new = by_anchor(spread.unpack(spread.of_kind(table, spread.ENTRY), COLUMNS))
        size = np.where(e["counts"] > 0, e["counts"].astype(np.int64) + LENGTH - 1, 0)
        n, kinds, total, different, marked = per_anchor(e, np.ones(len(new)), new, size, size * new, e["counts"] == 0)
        whole = (n > 1) & (marked == 0) & (total <= whole_bytes)
        windows = ~whole & ((marked > 0) | (kinds > 1) & (different > shard_bytes))
        real = e["counts"] > 0
        parts = [
            (spread.MARK, spread.take(e, real & ~whole & ~new)),
            (ASK, asked(spread.take(e, whole | ~windows & (kinds > 1) & new), windows=False)),
            (ASK, asked(spread.take(e, windows & real & new), windows=True)),
        ]
        made = [b for kind, part in parts for b in spread.pack(kind, part, n_buckets)]
        out = spread.schema(COLUMNS)
        passed = table.filter(pc.not_equal(table["kind"], spread.ENTRY))
        return pa.concat_tables([passed.cast(out), pa.Table.from_batches(made, out)])

    return run


def _fetch(n_buckets: int):
    """What was asked for of a bucket's texts: the bytes of stretches and the digests of windows, packed by key."""

    def run(ids, rows, texts, found) -> pa.Table:
        stretch, pieces, window = [], [], []
        for row, text in zip(rows, texts):
            e = found(row)
            if not len(e["keys"]):
                continue
            spread_out = e["hashes"] == 1
            plain = spread.take(e, ~spread_out)
            stretch.append(plain)
            pieces += [text[a : a + c + LENGTH - 1] for a, c in zip(plain["places"].tolist(), plain["counts"].tolist())]
            e = spread.take(e, spread_out)
            if len(e["keys"]):
                n = e["counts"].astype(np.int64)
                at = np.repeat(e["places"].astype(np.int64) - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                keys, hashes = spread.digests(text, at, at + LENGTH)
                window.append({"keys": keys, "hashes": hashes, "docs": np.repeat(e["docs"], n), "rows": np.repeat(e["rows"], n), "places": at.astype(np.uint32), "counts": np.ones(len(at), np.uint8)})
        out = spread.schema(FETCHED)
        made = []
        if window:
            first, again = split_repeats({c: np.concatenate([w[c] for w in window]) for c in COLUMNS})
            made += [b for kind, part in ((WINDOW, first), (spread.MARK, again)) for b in spread.pack(kind, part, n_buckets)]
        made = [pa.RecordBatch.from_arrays([*b.columns, pa.nulls(len(b), pa.binary())], schema=out) for b in made]
        if pieces:
            e = {c: np.concatenate([x[c] for x in stretch]) for c in COLUMNS}
            bucket = spread.of_key(e["keys"], n_buckets)
            order = np.argsort(bucket, kind="stable")
            blobs = iter(b"".join(pieces[k] for k in order[a : a + n]) for a, n in zip(*runs(bucket[order])))
            made += [pa.RecordBatch.from_arrays([*b.columns, pa.array([next(blobs) for _ in range(len(b))], pa.binary())], schema=out) for b in spread.pack(BYTES, e, n_buckets)]
        return pa.Table.from_batches(made, out)

    return run


def lanes_of(size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Lane and place of each of some strings, laid one after another into lanes of ``length``; none is longer."""
    lane, place, k, at = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), 0, 0
    for j, n in enumerate(size.tolist()):
        if at + n > length:
            k, at = k + 1, 0
        lane[j], place[j] = k, at
        at += n
    return lane, place


def shard_repeats(text: list[bytes], counts: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of stretches that repeat one of an earlier stretch of the same anchor: (stretch, window) pairs.

    ``shard`` numbers the anchor of each stretch, ascending; stretches of an anchor are in the order of the corpus.
    Windows of different anchors differ, so any anchors may share a lane.
    """
    first, length = runs(shard)
    size = np.array([len(t) for t in text], np.int64)
    total = np.add.reduceat(size, first) if len(first) else np.zeros(0, np.int64)
    out_stretch, out_window = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lower, upper in ((0, SHARD_BYTES // 2), (SHARD_BYTES // 2, int(max(total, default=0)))):
        some = np.flatnonzero((total > lower) & (total <= upper))
        if not len(some):
            continue
        # lanes are short where there is little to sort, so that a step of the scan has many of them
        n = max(int(total[some].max()), min(SHARD_BYTES // 2, int(total[some].sum()) // 512))
        lane, place = lanes_of(total[some], n)
        per = max(1, LANES_BYTES // n)
        for lo in range(0, int(lane[-1]) + 1, per):
            mine = (lane >= lo) & (lane < lo + per)
            again = _repeats(text, counts, size, first[some[mine]], length[some[mine]], lane[mine] - lo, place[mine], n)
            out_stretch.append(again[0])
            out_window.append(again[1])
    return np.concatenate(out_stretch), np.concatenate(out_window)


def _repeats(text, counts, size, first, length, lane, place, n) -> tuple[np.ndarray, np.ndarray]:
    """shard_repeats of the anchors with these first stretches and numbers of stretches, at these places of lanes."""
    data = np.zeros((int(lane.max()) + 1, n), np.uint8)
    used = np.zeros(len(data), np.int64)
    members = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    before = np.cumsum(size[members]) - size[members]
    start = np.repeat(lane * n + place - before[np.cumsum(length) - length], length) + before
    blob = np.frombuffer(b"".join([text[k] for k in members.tolist()]), np.uint8)
    n_bytes = size[members]
    data.reshape(-1)[np.repeat(start - before, n_bytes) + np.arange(len(blob))] = blob
    np.maximum.at(used, np.repeat(lane, length), start + n_bytes - np.repeat(lane, length) * n)
    # strings end their lanes: the padding is in front
    shift = n - used
    rolled = np.zeros_like(data)
    occurring = np.flatnonzero(np.bincount(blob, minlength=256))
    number = np.zeros(256, np.int32)
    number[occurring] = np.arange(1, len(occurring) + 1)
    symbols = np.full((len(data), n + 1), len(occurring) + 1, np.int32)
    symbols[:, n] = 0
    for k, by in enumerate(shift.tolist()):
        rolled[k, by:] = data[k, : n - by]
        symbols[k, by:n] = number[rolled[k, by:]]
    start = start + shift[np.repeat(lane, length)]
    sa = suffix_arrays(symbols, len(occurring) + 2)[:, 1:]
    same = permuted_common_prefixes(rolled, sa) >= LENGTH
    flat_sa = (sa + (np.arange(len(data), dtype=np.int64) * n)[:, None]).reshape(-1)
    group = np.empty(len(flat_sa), np.int64)
    group[flat_sa] = np.cumsum(~same.reshape(-1)[flat_sa])
    windows = counts[members].astype(np.int64)
    inner = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    where = np.repeat(start, windows) + inner
    member = np.repeat(members, windows)
    by = np.lexsort((inner, member, group[where]))
    g = group[where][by]
    again = by[np.flatnonzero(np.concatenate(([False], g[1:] == g[:-1])))]
    return member[again], inner[again]


def _resolve(n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        keep_pages()
        _, again = split_repeats(spread.unpack(spread.of_kind(table, WINDOW), COLUMNS))
        parts = [again]
        some = spread.of_kind(table, BYTES)
        e = spread.unpack(some, COLUMNS)
        if len(e["keys"]):
            blob = b"".join(some["bytes"].to_pylist())
            ends = np.cumsum(e["counts"].astype(np.int64) + LENGTH - 1)
            order = np.lexsort((e["places"], e["rows"], e["docs"], e["keys"]))
            stops = ends[order].tolist()
            text = [blob[b - c - LENGTH + 1 : b] for b, c in zip(stops, e["counts"][order].tolist())]
            e = spread.take(e, order)
            first, length = runs(e["keys"])
            stretch, window = shard_repeats(text, e["counts"], np.repeat(np.arange(len(first)), length))
            by = np.lexsort((window, stretch))
            stretch, window = stretch[by], window[by]
            begin, count = runs(stretch * 256 + window - np.arange(len(stretch)))
            marks = spread.take(e, stretch[begin])
            parts.append({**marks, "places": marks["places"] + window[begin].astype(np.uint32), "counts": count.astype(np.uint8)})
        out = spread.schema(COLUMNS)
        passed = spread.of_kind(table, spread.MARK).select(out.names)
        made = [b for part in parts for b in spread.pack(spread.MARK, part, n_buckets)]
        return pa.concat_tables([passed.cast(out), pa.Table.from_batches(made, out)])

    return run


def _cut(ids, rows, texts, found) -> pa.Table:
    spans = []
    for row in rows:
        e = found(row)
        if not len(e["places"]):
            spans.append([])
            continue
        start = e["places"].astype(np.int64)
        stop = np.maximum.accumulate(start + e["counts"] + LENGTH - 1)
        new = np.flatnonzero(np.concatenate(([True], start[1:] > stop[:-1])))
        spans.append(list(zip(start[new].tolist(), stop[np.append(new[1:], len(start)) - 1].tolist())))
    return spread.without(ids, texts, spans)


def deduplicate(docs: DataFrame, hot: int = HOT, whole: int = WHOLE_BYTES, shard: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges), kept (the remaining bytes) of every row.

    ``hot``, ``whole`` and ``shard`` decide where windows are settled, not which: results do not depend on them.
    """
    table, n = spread.numbered(docs)
    met = spread.entries(table, stretches, _fold(hot), n, COLUMNS).groupBy("bucket").applyInArrow(_settle(n, whole, shard), spread.ddl(COLUMNS))
    met = shared.stored(met, "stretches")
    fetched = spread.with_texts(table, met.where(f"kind = {ASK}"), n, _fetch(n), spread.ddl(FETCHED), COLUMNS)
    # marks among what was fetched are by document already; they only pass through
    settled = shared.stored(fetched.groupBy("bucket").applyInArrow(_resolve(n), spread.ddl(COLUMNS)), "windows")
    marks = met.where(f"kind = {spread.MARK}").unionByName(settled)
    return spread.to_documents(spread.with_texts(table, marks, n, _cut, spread.REMOVED, COLUMNS))


def op4_suffix_array(spark, sf_dir: str) -> DataFrame:
    return spread.digest_columns(deduplicate(shared.documents(spark, sf_dir)))
