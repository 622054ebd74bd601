"""Token ids in Re-Pair compressed shards.

Texts are encoded in ascending ``doc_id`` order and cut into shards of about ``SHARD_TOKENS`` ids.  Inside a shard
frequent pairs of neighbouring ids are replaced by new symbols, round after round, until no pair occurs ``LEAST`` times
(occurrences that overlap, as in a run of one symbol, count once); the rules and the number of ids that each symbol
expands to are stored with the shortened sequence, so any run of ids can be decoded without decoding what stands before
it.  A round counts all pairs exactly and ranks them by count: an occurrence is taken where its pair ranks above those
that overlap it, so the most frequent pair gets all of its occurrences and many pairs are replaced at once.  Later
rounds look only at pairs that were frequent before or hold a symbol of the round before.

A shard is one row of a Parquet table (the format below), written by Spark's committer: a task that is lost writes its
shards again, and readers see whole shards only.

shard: int                     number of the range of doc_ids
part: int                      number of the shard in its range
symbols: binary                uint32 LE, the shortened sequence
rules: binary                  uint32 LE pairs, rule k is symbol BASE + k
lengths: binary                uint32 LE, ids that symbol BASE + k expands to
docs: array<struct<doc_id, n_tokens>>  the documents of the shard in order

Defined results: null and empty texts are only the end id; rows are ordered by doc_id (null first), then text (rows
without an id by a hash of it before), so repeated rows stand next to each other; a text of any length is in one shard; an empty table writes no shard; other
columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .textblocks import blocks, flat, keep_pages, mix

END = 0
BASE = 1 << 17  # the first symbol of a rule; every vocabulary here is smaller
SHARD_TOKENS = 1 << 19
LEAST = 4  # a pair is replaced while it occurs so often in a shard
DENSE = 32  # a round sorts pairs and closes up the sequence while one in so many of its places may be replaced
PIECES = 1_500_000
LONG_PIECES = 200_000
SLOT_BITS = 22
TEXT_BYTES = 1 << 18  # a block of texts for the encoder; its arrays take some 100 times that
SLOTS = 1 << SLOT_BITS
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_U = np.uint64

SHARD_DDL = "shard int, part int, symbols binary, rules binary, lengths binary, docs array<struct<doc_id:long,n_tokens:long>>"


def compress(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, lengths) of a sequence of ids below BASE.

    While many places may be replaced, a round sorts their pairs and closes up the sequence; then it is a linked list
    while it shrinks.
    """
    rules, lengths = [np.zeros((0, 2), np.uint32)], np.zeros(0, np.uint32)
    seq = ids.astype(np.uint64)
    at = np.arange(max(len(seq) - 1, 0))  # left ends of the pairs that may be replaced
    while len(at) >= least and len(at) * DENSE > len(seq) and _bits(seq, lengths)[2] <= 64:
        seq, at, rule = _replaced(seq, at, least, lengths)
        rules.append(rule)
        lengths = np.concatenate([lengths, expansion(rule[:, 0], lengths) + expansion(rule[:, 1], lengths)])
    seq = seq.astype(np.int64)
    if len(at) < least:
        return seq.astype(np.uint32), np.concatenate(rules), lengths
    n = len(seq)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    rank, taken, gone = np.zeros(n + 1, np.int64), np.zeros(n + 1, bool), np.zeros(n, bool)
    pair = (seq[at] << 32) | seq[at + 1]
    while len(at) >= least:
        may = _may_be_frequent(pair, least)
        at, pair = at[may], pair[may]
        alike = _alike(pair.view(np.uint64))
        weight = np.bincount(alike, minlength=len(at))
        run = np.flatnonzero(pair >> 32 == pair & 0xFFFFFFFF)
        if len(run):  # every second occurrence in a run of one symbol overlaps the one before it
            run = run[np.argsort(at[run])]
            step = np.arange(len(run))
            goes_on = np.append(False, after[at[run[:-1]]] == at[run[1:]])
            run = run[(step - np.maximum.accumulate(np.where(goes_on, 0, step))) % 2 == 1]
            np.subtract.at(weight, alike[run], 1)
        weight = weight[alike]
        score = (weight << 32) | alike
        score[run] = 0
        often = np.flatnonzero(weight >= least)
        if not len(often):
            break
        found, at, kind, score = pair, at[often], alike[often], score[often]
        left, right = before[at], after[at]
        rank[at] = score
        chosen = (score > rank[left]) & (score > rank[right])
        taken[at[chosen]] = True
        for _ in range(2):  # what is left after that waits for the next round
            closed = chosen | taken[left] | taken[right]
            rank[at[closed]] = 0
            some = np.flatnonzero(~closed)
            some = some[(score[some] > rank[left[some]]) & (score[some] > rank[right[some]])]
            if not len(some):
                break
            chosen[some] = True
            taken[at[some]] = True
        rank[at] = 0
        first = at[chosen]
        taken[first] = False
        count = np.bincount(kind[chosen], minlength=len(found))
        chosen &= count[kind] >= least
        first, second = at[chosen], right[chosen]
        taken[first] = True
        free = np.flatnonzero(~(chosen | taken[left] | taken[right]))
        taken[first] = False
        new = np.flatnonzero(count >= least)
        fresh = BASE + len(lengths)
        number = np.zeros(len(found), np.int64)
        number[new] = fresh + np.arange(len(new))
        third = after[second]
        seq[first], gone[second] = number[kind[chosen]], True
        after[first], before[third] = third, first
        rule = np.stack([found[new] >> 32, found[new] & 0xFFFFFFFF], 1).astype(np.uint32)
        rules.append(rule)
        lengths = np.concatenate([lengths, expansion(rule[:, 0], lengths) + expansion(rule[:, 1], lengths)])
        left = before[first]
        left = left[left >= 0]
        changed = np.concatenate([first[third < n], left[seq[left] < fresh]])
        at = np.concatenate([at[free], changed])
        pair = np.concatenate([found[kind[free]], (seq[changed] << 32) | seq[after[changed]]])
    return seq[~gone].astype(np.uint32), np.concatenate(rules), lengths


def _bits(seq: np.ndarray, lengths: np.ndarray) -> tuple[int, int, int]:
    """How many bits a symbol takes, a place, and two symbols with a place."""
    symbol, place = (BASE + len(lengths)).bit_length(), len(seq).bit_length()
    return symbol, place, 2 * symbol + place


def _replaced(seq: np.ndarray, at: np.ndarray, least: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round over the pairs at ``at`` (ascending): the shorter sequence, the places left for a next round, the rules."""
    n, fresh = len(seq), BASE + len(lengths)
    symbol, place, _ = _bits(seq, lengths)
    s, p = _U(symbol), _U(place)
    first = seq[at]
    second = seq[at + 1]
    run = at[first == second]
    where = (((first << s) | second) << p) | at.view(np.uint64)
    where.sort()
    pair = where >> p
    edge = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    size = np.diff(np.append(edge, len(pair)))
    pair, weight = pair[edge], size.copy()
    if len(run):  # every second occurrence in a run of one symbol overlaps the one before it
        step = np.arange(len(run))
        goes_on = np.append(False, run[1:] == run[:-1] + 1)
        run = run[(step - np.maximum.accumulate(np.where(goes_on, 0, step))) % 2 == 1]
        np.subtract.at(weight, np.searchsorted(pair, (seq[run] << s) | seq[run]), 1)
    often = weight >= least
    where = (where[np.repeat(often, size)] & _U((1 << place) - 1)).view(np.int64)
    pair, size, weight = pair[often], size[often], weight[often]
    none = np.zeros((0, 2), np.uint32)
    if not len(pair):
        return seq, at[:0], none
    # ranks from 1, so that the most frequent pair has the highest; rank[i + 1] is that of the pair at i
    order = np.argsort(weight, kind="stable")
    ordinal = np.empty(len(pair), np.int32)
    ordinal[order] = np.arange(1, len(pair) + 1, dtype=np.int32)
    rank = np.zeros(n + 1, np.int32)
    rank[where + 1] = np.repeat(ordinal, size)
    may = rank[1:-1] > 0
    rank[run + 1] = 0
    left = rank.copy()
    chosen = (left[1:-1] > left[:-2]) & (left[1:-1] > left[2:])
    for _ in range(2):  # what is left after that waits for the next round
        left[1:-1] *= ~_near(chosen)
        more = (left[1:-1] > left[:-2]) & (left[1:-1] > left[2:])
        if not more.any():
            break
        chosen |= more
    first = np.flatnonzero(chosen)
    kind = rank[first + 1]
    enough = np.bincount(kind, minlength=len(pair) + 1) >= least
    stays = enough[kind]
    chosen[first[~stays]] = False
    first, kind = first[stays], kind[stays]
    new = np.flatnonzero(enough)
    number = np.zeros(len(enough), np.uint64)
    number[new] = np.arange(fresh, fresh + len(new), dtype=np.uint64)
    made = pair[order[new - 1]]
    seq[first] = number[kind]
    # pairs that were frequent and are untouched, and all with a new symbol
    may &= ~_near(chosen)
    may |= chosen
    may[first[first > 0] - 1] = True
    keep = np.ones(n, bool)
    keep[first + 1] = False
    at = np.flatnonzero(may[keep[:-1]])
    seq = seq[keep]
    return seq, at[at < len(seq) - 1], np.stack([made >> s, made & _U((1 << symbol) - 1)], 1).astype(np.uint32)


def _near(chosen: np.ndarray) -> np.ndarray:
    """Places that are chosen or stand next to one that is."""
    out = chosen.copy()
    out[1:] |= chosen[:-1]
    out[:-1] |= chosen[1:]
    return out


def _slots(pair: np.ndarray, bits: int, turn: int) -> np.ndarray:
    return (pair * _U(MULTIPLIERS[turn]) >> _U(64 - bits)).view(np.int64)


def _may_be_frequent(pair: np.ndarray, least: int) -> np.ndarray:
    """Where the slots of a hash table are used so often; no pair that is frequent is missing."""
    bits = max(8, len(pair).bit_length())
    slot = _slots(pair.view(np.uint64), bits, 0)
    return np.flatnonzero((np.bincount(slot, minlength=1 << bits) >= least)[slot])


def _alike(pair: np.ndarray, turn: int = 1) -> np.ndarray:
    """For each value the index of an equal one, the same for all equal ones; by a table of hashes, exactly."""
    n = len(pair)
    bits = max(8, n.bit_length() + 1)
    slot = _slots(pair, bits, turn)
    one = np.empty(1 << bits, np.int32)
    one[slot] = np.arange(n, dtype=np.int32)
    out = one[slot]
    rest = np.flatnonzero(pair[out] != pair)
    if len(rest):
        if turn + 1 < len(MULTIPLIERS):
            inner = _alike(pair[rest], turn + 1)
        else:
            _, first, of = np.unique(pair[rest], return_index=True, return_inverse=True)
            inner = first[of]
        out[rest] = rest[inner]
    return out


def expansion(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many ids each symbol stands for."""
    out = np.ones(len(symbols), np.uint32)
    rule = symbols >= BASE
    out[rule] = lengths[symbols[rule] - BASE]
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids that a sequence of symbols stands for."""
    if not len(rules):
        return symbols
    # what each rule stands for, level by level, then one gather for the sequence
    size = lengths.astype(np.int64)
    start = np.cumsum(size) - size
    ids = np.repeat(rules[:, 0], size)
    ids[start + expansion(rules[:, 0], lengths)] = rules[:, 1]
    open_at = np.flatnonzero((ids >= BASE) & _begins(ids, start, rules, lengths))
    while len(open_at):
        rule = ids[open_at] - BASE
        ids[open_at] = rules[rule, 0]
        right = open_at + expansion(rules[rule, 0], lengths)
        ids[right] = rules[rule, 1]
        open_at = np.concatenate([open_at, right])
        open_at = open_at[ids[open_at] >= BASE]
    width = np.ones(len(symbols), np.int32)
    at = np.flatnonzero(symbols >= BASE)
    rule = symbols[at] - BASE
    wide = lengths[rule].astype(np.int32)
    width[at] = wide
    out = np.repeat(symbols, width)
    # most symbols are ids and are in place; only the rules' stretches are written over
    begin = at + np.cumsum(wide - 1) - (wide - 1)
    before = np.cumsum(wide) - wide
    k = np.arange(int(wide.sum()))
    out[k + np.repeat(begin - before, wide)] = ids[k + np.repeat(start[rule] - before, wide)]
    return out


def _begins(ids, start, rules, lengths) -> np.ndarray:
    """Where the left or the right side of a rule begins in the table of expansions."""
    out = np.zeros(len(ids), bool)
    out[start] = True
    out[start + expansion(rules[:, 0], lengths)] = True
    return out


def decode(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, start: int, stop: int) -> np.ndarray:
    """ids[start:stop] of a shard; only the symbols that cover the range are expanded."""
    ends = np.cumsum(expansion(symbols, lengths).astype(np.int64))
    lo, hi = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
    skipped = int(ends[lo - 1]) if lo else 0
    return expand(symbols[lo:hi], rules, lengths)[start - skipped : stop - skipped]


# bytes of ASCII letters and of U+00C0 to U+00FF without the two signs among them
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[0x30:0x3A] = True


def one_word(pieces: list[bytes], size: np.ndarray) -> np.ndarray:
    """Which pieces the tokenizer's split leaves whole but for a line end in front: words of these letters, or digits."""
    raw = b"".join(pieces)
    start = np.cumsum(size) - size
    first = np.frombuffer(raw, np.uint8)[start]
    rest = size - ((first == 0x20) | (first == 0x0A))
    letters, digits = (np.add.reduceat(marked(raw, table), start, dtype=np.int64) for table in (_LETTERS, _DIGITS))
    return (rest > 0) & ((letters == rest) | (digits == rest))


def marked(raw: bytes, table: np.ndarray) -> np.ndarray:
    """table[byte] of each byte."""
    return np.frombuffer(raw.translate(table.tobytes()), bool)


_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
CHARS = np.zeros(256, "<u4")  # the character that stands for each byte in a byte-level vocabulary; a blank for 0xFF
CHARS[_PRINTED] = _PRINTED
CHARS[[k for k in range(256) if k not in _PRINTED]] = range(0x100, 0x200 - len(_PRINTED))
CHARS[0xFF] = 0x20

SHORT = 15  # bytes of a piece that is known by two words, the last byte of which is its length
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


class Encoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct piece once.

    The byte-level tokenizer splits a text before each white space that stands alone between other characters, and
    between a Latin letter or ASCII digit and the ASCII punctuation that follows.  Pieces between such places are
    known by their bytes: those of up to 15 bytes by two words, found in an open-addressing table of hashes and compared
    as words, longer ones as keys of a dictionary; unknown ones are encoded, joined to one text, and their ids kept.
    Texts with other white space or with an added token's content are encoded whole.

    Only byte-level tokenizers of that kind with at most 65,536 ids are taken.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        split = spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
        if not plain or self.tokenizer.get_vocab_size(True) > 1 << 16:
            raise ValueError("a byte-level tokenizer with the usual split, no normalizer and at most 65,536 ids is needed")
        self.added = [token.content.encode() for token in self.tokenizer.get_added_tokens_decoder().values() if token.content]
        self.tokenizer.model._resize_cache(0)  # pieces that it sees are new by construction
        self.of_words = Tokenizer(self.tokenizer.model)  # for pieces whose split is known, in the vocabulary's characters
        self.of_words.pre_tokenizer = CharDelimiterSplit(" ")
        # in a byte-level vocabulary a character stands for a byte
        self.n_bytes = np.zeros(self.tokenizer.get_vocab_size(True), np.int64)
        for token, k in self.tokenizer.get_vocab(True).items():
            self.n_bytes[k] = len(token)
        self.forget()

    def forget(self) -> None:
        self.hashes, self.numbers = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.ids, self.used, self.known = np.zeros(1 << 18, np.uint16), 0, 0
        # of each piece: begin << 20 | number of ids, hash (0: it is in the dictionary), bytes and length as two words
        self.piece = {c: np.zeros(1 << 18, t) for c, t in (("span", np.int64), ("hash", np.uint64), ("low", np.uint64), ("high", np.uint64), ("uses", np.uint8))}
        self.long: dict[bytes, int] = {}

    def _with_added(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Numbers of the texts that hold the content of an added token (or seem to, across the end of a text)."""
        raw, found = data.tobytes(), []
        for content in self.added:
            at = raw.find(content)
            while at >= 0:
                found.append(int(np.searchsorted(offsets, at, "right")) - 1)
                at = raw.find(content, at + 1)
        return found

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of pieces by hash, -1 for unknown ones."""
        out = np.full(len(h), -1, np.int32)
        slot = (h >> _U(64 - SLOT_BITS)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            there = self.hashes[slot]
            hit = there == h[left]
            out[left[hit]] = self.numbers[slot[hit]]
            more = ~hit & (there != 0)
            left, slot = left[more], (slot[more] + 1) & (SLOTS - 1)
        return out

    def _insert(self, h: np.ndarray, number: np.ndarray) -> None:
        slot = (h >> _U(64 - SLOT_BITS)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.hashes[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            placed = free[one]
            self.hashes[slot[placed]], self.numbers[slot[placed]] = h[placed], number[placed]
            left = np.ones(len(h), bool)
            left[placed] = False
            h, number, slot = h[left], number[left], (slot[left] + 1) & (SLOTS - 1)

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and where those of each begin and end; those of one word go past the library's own split."""
        word = one_word(pieces, np.fromiter(map(len, pieces), np.int64, len(pieces)))
        ids, spans = np.zeros(0, np.uint16), np.zeros((len(pieces), 2), np.int64)
        for encode, mine in ((self._words, np.flatnonzero(word)), (self._others, np.flatnonzero(~word))):
            if len(mine):
                found, cuts = encode([pieces[k] for k in mine.tolist()])
                spans[mine] = cuts + len(ids)
                ids = np.concatenate([ids, found])
        return ids, spans

    def _words(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """_encoded of pieces of one word; 0xFF is no byte of UTF-8 and sets them and line ends off."""
        chars = CHARS[np.frombuffer(b"\xff".join(pieces).replace(b"\n", b"\n\xff"), np.uint8)]
        found = self.of_words.encode_batch_fast([chars.tobytes().decode("utf-32-le")], add_special_tokens=False)
        ids = np.array(found[0].ids, np.uint16)
        stops = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), stops, "left") + 1
        return ids, np.stack([np.concatenate(([0], ends[:-1])), ends], 1)

    def _others(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """_encoded of any pieces, as one text that is cut where their bytes end."""
        # a piece without white space in front of it is set off by a line end, whose id is left out again
        bare = np.array([p[0] != 32 and p[0] != 10 for p in pieces])
        joined = b"".join([b"\n" + p if b else p for p, b in zip(pieces, bare.tolist())])
        found = self.tokenizer.encode_batch_fast([joined.decode()], add_special_tokens=False)
        ids = np.array(found[0].ids, np.uint16)
        stops = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + bare)
        ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), stops, "left") + 1
        return ids, np.stack([np.concatenate(([0], ends[:-1])) + bare, ends], 1)

    def _learn(self, pieces: list[bytes], **columns: np.ndarray) -> None:
        """Encode pieces; ``columns`` has hash, low and high of those at the front, the others are long."""
        ids, spans = self._encoded(pieces)
        size = spans[:, 1] - spans[:, 0]
        ids = ids[np.repeat(spans[:, 0] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + len(pieces) > len(self.piece["span"]):
            self.piece = {c: np.concatenate([a, np.zeros_like(a)]) for c, a in self.piece.items()}
        self.ids[self.used : self.used + len(ids)] = ids
        part = slice(self.known, self.known + len(pieces))
        self.piece["span"][part] = ((self.used + np.cumsum(size) - size) << 20) | size
        n_short = len(columns["hash"])
        for c, values in columns.items():
            self.piece[c][self.known : self.known + n_short] = values
            self.piece[c][self.known + n_short : part.stop] = 0
        self.piece["uses"][part] = 0
        self._insert(columns["hash"], np.arange(self.known, self.known + n_short, dtype=np.int32))
        self.long.update(zip(pieces[n_short:], range(self.known + n_short, part.stop)))
        self.used, self.known = self.used + len(ids), part.stop

    def _shrink(self) -> None:
        """Forget the pieces met in one block only; all of them where that leaves too many."""
        keep = np.flatnonzero(self.piece["uses"][: self.known] > 1)
        keep = keep if len(keep) < PIECES // 2 and len(self.long) < LONG_PIECES // 2 else keep[:0]
        old, ids, long = {c: a[keep] for c, a in self.piece.items()}, self.ids, self.long
        self.forget()
        begin, size = old["span"] >> 20, old["span"] & 0xFFFFF
        used, self.known = int(size.sum()), len(keep)
        ids = ids[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(used)]
        self.ids, self.used = np.concatenate([ids, self.ids]), used
        old["span"] = ((np.cumsum(size) - size) << 20) | size
        self.piece = {c: np.concatenate([old[c], a]) for c, a in self.piece.items()}
        short = np.flatnonzero(old["hash"] > 0)
        self._insert(old["hash"][short], short.astype(np.int32))
        moved = dict(zip(keep.tolist(), range(len(keep))))
        self.long = {piece: moved[k] for piece, k in long.items() if k in moved}

    def _numbers(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each piece, and which have another piece's: two short pieces with one hash."""
        size = stop - start
        words = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(16, np.uint8)]), 8)
        low = words[start].view("<u8")[:, 0] & _MASK[np.minimum(size, 8)]
        high = size.astype(np.uint64) << _U(56)
        more = np.flatnonzero(size > 8)
        high[more] |= words[start[more] + 8].view("<u8")[:, 0] & _MASK[np.minimum(size[more] - 8, 7)]
        h = mix(low ^ mix(high)) | _U(1)
        number = self._find(h)
        long, raw = np.flatnonzero(size > SHORT), data.tobytes()
        text = [raw[a:b] for a, b in zip(start[long].tolist(), stop[long].tolist())]
        number[long] = [self.long.get(t, -1) for t in text]
        new = np.flatnonzero((number < 0) & (size <= SHORT))
        new_long = dict.fromkeys(t for t, k in zip(text, number[long].tolist()) if k < 0)
        if len(new) or new_long:
            at = new[np.unique(h[new], return_index=True)[1]]
            self._learn([*(raw[a:b] for a, b in zip(start[at].tolist(), stop[at].tolist())), *new_long], hash=h[at], low=low[at], high=high[at])
            number[new] = self._find(h[new])
            number[long] = [self.long[t] for t in text]
        known = self.piece
        other = (known["low"][number] != low) | (known["high"][number] != high)
        return number, other & (size <= SHORT)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in ``data``, each text followed by the end id, and the n + 1 offsets of their ids."""
        n = len(offsets) - 1
        if self.known > PIECES or len(self.long) > LONG_PIECES:
            self._shrink()
        odd = odd_texts(data, offsets) | (np.diff(offsets) >= 1 << 20)  # a piece must have fewer ids than that
        odd[self._with_added(data, offsets)] = True
        begins = piece_starts(data, offsets)
        if odd.any():
            begins &= np.repeat(~odd, np.diff(offsets))
        start = np.flatnonzero(begins)
        owner = np.repeat(np.arange(n), np.diff(np.searchsorted(start, offsets)))
        # a piece ends where the next begins, or with its text
        stop = np.minimum(np.append(start[1:], len(data))[: len(start)], offsets[owner + 1])
        number, other = self._numbers(data, start, stop)
        if other.any():
            odd[owner[other]] = True
            stays = ~odd[owner]
            start, owner, number = start[stays], owner[stays], number[stays]
        whole = [bytes(data[offsets[k] : offsets[k + 1]]).decode() for k in np.flatnonzero(odd)]
        whole = self.tokenizer.encode_batch_fast(whole, add_special_tokens=False) if whole else []
        self.piece["uses"][number] = np.minimum(self.piece["uses"][number], 1) + 1
        span = self.piece["span"][number]
        begin, size = span >> 20, span & 0xFFFFF
        tokens = np.bincount(owner, size, n).astype(np.int64) + 1
        tokens[odd] += np.array([len(e.ids) for e in whole], np.int64)
        out_at = np.concatenate(([0], np.cumsum(tokens)))
        out = np.full(int(out_at[-1]), END, np.uint32)
        size = size.astype(np.int32)
        before = np.cumsum(size, dtype=np.int32) - size
        of_text = np.searchsorted(start, offsets[:-1])  # the first piece of each text
        shift = out_at[:-1] - np.append(before, np.int32(size.sum()))[of_text]  # of each text's ids from pieces to output
        k = np.arange(int(size.sum()), dtype=np.int32)
        out[k + np.repeat(shift.astype(np.int32)[owner], size)] = self.ids[k + np.repeat((begin - before).astype(np.int32), size)]
        for t, e in zip(np.flatnonzero(odd), whole):
            out[out_at[t] : out_at[t] + len(e.ids)] = e.ids
        return out, out_at


_STOPS = np.zeros(256, bool)
_STOPS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True  # ASCII punctuation and symbols
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_ODD = np.zeros(256, bool)
_ODD[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at white space, at punctuation after a letter or digit, and at the start of a text."""
    out = (data == 0x20) | (data == 0x0A)
    stop = np.flatnonzero(marked(data.tobytes(), _STOPS))
    stop = stop[stop > 1]
    last, lead = data[stop - 1], data[stop - 2]
    # a digit, an ASCII letter, or U+00C0 to U+00FF without the two signs among them
    out[stop[_ALNUM[last] | ((lead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))]] = True
    out[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return out


def odd_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with white space that is not a single blank or line end between other characters."""
    n = len(data)
    odd = np.zeros(len(offsets) - 1, bool)
    if not n:
        return odd
    space = (data == 0x20) | (data == 0x0A)
    bad = np.zeros(n, bool)
    bad[1:] = space[1:] & space[:-1]
    filled = offsets[:-1] < offsets[1:]
    bad[offsets[:-1][filled]] |= space[offsets[:-1][filled]]
    bad[offsets[1:][filled] - 1] |= space[offsets[1:][filled] - 1]
    k = np.flatnonzero(marked(data.tobytes(), _ODD))
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = padded[k], padded[k + 1], padded[k + 2]
    wide = (a == 0xE2) & (((b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | np.isin(c, (0xA8, 0xA9, 0xAF)))) | ((b == 0x81) & (c == 0x9F)))
    wide |= ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    bad[k] |= (a < 0x20) | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | wide
    odd[np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1] = True
    return odd


_encoders: dict[str, Encoder] = {}


def _shards(path: str):
    def run(batches):
        from pyspark import TaskContext

        keep_pages()
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encode = _encoders[path]
        shard, part = TaskContext.get().partitionId(), 0
        ids, docs, held = [], [], 0

        def close():
            symbols, rules, lengths = compress(np.concatenate(ids))
            row = {"shard": shard, "part": part, "symbols": symbols.astype("<u4").tobytes(), "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "docs": docs}
            return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

        for batch in batches:
            who = batch.column(0).to_pylist()
            data, offsets = flat(batch.column(1))
            for lo, hi in blocks(offsets, TEXT_BYTES):
                found, at = encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                done = 0
                for k, doc in enumerate(who[lo:hi]):
                    docs.append({"doc_id": doc, "n_tokens": int(at[k + 1] - at[k])})
                    if held + at[k + 1] - at[done] >= SHARD_TOKENS:
                        ids.append(found[at[done] : at[k + 1]])
                        yield close()
                        part, held, done, ids, docs = part + 1, 0, k + 1, [], []
                ids.append(found[at[done] :])
                held += len(ids[-1])
        if docs:
            yield close()

    return run


_SCHEMA = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("symbols", pa.binary()), ("rules", pa.binary()), ("lengths", pa.binary()), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64())])))])


def write(docs: DataFrame, path: str, tokenizer: str, partitions: int | None = None) -> None:
    """Encode ``docs`` and write their shards to ``path``; numbers of shards ascend with doc_id."""
    n = partitions or shared.shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.whole_text().alias("text"))
    tie = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))  # rows without an id are spread too
    rows = rows.repartitionByRange(n, "doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    # the symbols are already short; a codec only takes the slack of their fixed width
    rows.mapInArrow(_shards(tokenizer), SHARD_DDL).write.option("compression", "zstd").parquet(path)


def read(spark, path: str) -> DataFrame:
    return spark.read.schema(SHARD_DDL).parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(shard, part, shard_start): ids in all shards before; one narrow row per shard of about half a million ids."""
    sizes = shards.select("shard", "part", F.aggregate("docs", F.lit(0).cast("long"), lambda a, d: a + d.n_tokens).alias("tokens"))
    ranges = sizes.groupBy("shard").agg(F.sum("tokens").alias("tokens"))
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("shard", before(Window.orderBy("shard")).alias("range_start"))
    sizes = sizes.select("shard", "part", before(Window.partitionBy("shard").orderBy("part")).alias("start_in_range"))
    return sizes.join(ranges, "shard").select("shard", "part", (F.col("range_start") + F.col("start_in_range")).alias("shard_start"))


_READ = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def checksums(shards: DataFrame) -> DataFrame:
    """shard, part, doc_id, offset in the shard, n_tokens and CRC of the ids of each document, decoded from the shards."""

    def run(batches):
        keep_pages()
        for batch in batches:
            for row in batch.to_pylist():
                symbols, rules, lengths = (np.frombuffer(row[c], "<u4") for c in ("symbols", "rules", "lengths"))
                ids = np.ascontiguousarray(expand(symbols, rules.reshape(-1, 2), lengths), "<u4")
                at, rows = 0, []
                for d in row["docs"]:
                    end = at + d["n_tokens"]
                    rows.append((row["shard"], row["part"], d["doc_id"], at, d["n_tokens"], zlib.crc32(ids[at:end])))
                    at = end
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _READ)], schema=_READ)

    return shards.mapInArrow(run, "shard int, part int, doc_id long, offset long, n_tokens long, ids_crc32 long")


def op1_repair(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared.new_path(spark, "ids")
    write(shared.documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    shards = read(spark, path)
    starts = shared.stored(shard_starts(shards), "starts")
    found = checksums(shards).join(starts, ["shard", "part"])
    return found.select("doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
