"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Features are word unigrams and bigrams as written, bigrams that repeat a word, and unigrams to trigrams of word shapes
(runs of capitals, small letters, digits; other characters as they are), hashed into 2^18 slots; a text is its vector
of square roots of counts scaled to unit length, plus a small constant.  Training takes a bounded sample of labelled rows, about ``train_rows`` of them chosen by a
hash of doc_id, so what one task trains on does not grow with the corpus; the model (one float per slot) is broadcast
and every whole text is scored as a sparse dot product.

Defined results: null and empty texts have the constant only and get the score of the bias; labelled rows without a
text or without a label are not trained on, labels that disagree on an id count as the lower one; without any usable
label all weights are 0 and all scores 0.5; of several texts of a labelled id the least is learnt; repeated rows get equal scores; a null ``doc_id`` hashes as the empty
string; other columns are ignored by :func:`score` and carried by :func:`keep_good`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .textblocks import IS_SPACE, blocks, flat, keep_pages, word_hashes

BITS = 18
TRAIN_ROWS = 20_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-4
CONSTANT = 0.1  # small beside the unit vector, so that few words can still outweigh it
_U = np.uint64

SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[0x41:0x5B] = ord("A")
SHAPE[0x61:0x7B] = ord("a")
SHAPE[0x80:] = ord("a")
SHAPE[0x30:0x3A] = ord("0")


def held_out() -> Column:
    return shared.word_crc() % 3 == 1


def _slots(words: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Slots of the n-grams of one text's words."""
    if len(words) < n:
        return np.zeros(0, np.int64)
    h = words[: len(words) - n + 1] + _U(salt)
    for j in range(1, n):
        h = h * _U(0x9E3779B97F4A7C15) + words[j : len(words) - n + 1 + j]
    return ((h * _U(0xD1342543DE82EF95)) >> _U(64 - BITS)).astype(np.int64)


def features(column: pa.Array):
    """Slots (distinct) and values of each text; slot 2^BITS is the constant."""
    data, offsets = flat(column)
    bias = np.array([1 << BITS]), np.array([CONSTANT])
    for lo, hi in blocks(offsets):
        part = offsets[lo : hi + 1] - offsets[lo]
        block = data[offsets[lo] : offsets[hi]]
        words, at = word_hashes(block, part, lower=False)
        shape = SHAPE[block]
        stays = np.ones(len(shape), bool)
        stays[1:] = (shape[1:] != shape[:-1]) | IS_SPACE[block[1:]]
        stays[part[:-1][part[:-1] < len(shape)]] = True
        kept = np.concatenate(([0], np.cumsum(stays)))
        shapes, at2 = word_hashes(shape[stays], kept[part], lower=False)
        for k in range(hi - lo):
            w, s = words[at[k] : at[k + 1]], shapes[at2[k] : at2[k + 1]]
            again = np.full(np.count_nonzero(w[1:] == w[:-1]), 6)  # bigrams of one word twice share a slot
            slots = np.concatenate([_slots(w, 1, 1), _slots(w, 2, 2), _slots(s, 1, 3), _slots(s, 2, 4), _slots(s, 3, 5), again])
            if not len(slots):
                yield bias
                continue
            slots.sort()
            first = np.flatnonzero(np.concatenate(([True], slots[1:] != slots[:-1])))
            counts = np.sqrt(np.diff(np.append(first, len(slots))))
            yield np.append(slots[first], 1 << BITS), np.append(counts / np.sqrt(np.dot(counts, counts)), CONSTANT)


def _train(table: pa.Table) -> pa.Table:
    """FTRL-proximal over the rows in the order of their hash, ``EPOCHS`` times; returns the weights."""
    table = table.sort_by([("order", "ascending"), ("text", "ascending")])
    y = table["label"].to_numpy().astype(np.float64)
    rows = list(features(table["text"]))
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for (i, x), label in zip(rows, y):
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            more = ni + g * g
            z[i] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[i] = more
    return pa.table({"weights": pa.array([weights(z, n).astype(np.float32).tobytes()], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learnt from about ``train_rows`` labelled rows that are not held out."""
    usable = labels.where(~held_out() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("label"))
    rows = usable.count()
    order = F.xxhash64("doc_id")
    share = min(1.0, train_rows / max(rows, 1))
    sample = usable.where(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20))).select("doc_id", F.col("label").cast("int"), order.alias("order"))
    sample = shared.stored(sample, "sample")  # about train_rows narrow rows at most, so it may be broadcast
    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "label", "order").agg(F.min("text").alias("text"))  # one row of an id that many rows have
    found = texts.groupBy((F.col("order") * 0).alias("all")).applyInArrow(lambda _, t: _train(t), "weights binary").collect()
    return np.frombuffer(found[0]["weights"], np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, *keep: str) -> DataFrame:
    """doc_id, the columns ``keep`` and score of every row."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(weights)
    names = ["doc_id", *keep]

    def run(batches):
        keep_pages()
        w = model.value.astype(np.float64)
        for batch in batches:
            logits = np.array([w[i] @ x for i, x in features(batch.column(len(names)))])
            columns = [batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(1 / (1 + np.exp(-np.clip(logits, -35, 35))), pa.float64())], names=[*names, "score"])

    inner = docs.select(*names, shared.whole_text().alias("whole_text"))
    types = dict(inner.dtypes)
    return inner.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names) + ", score double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with all their columns."""
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    return score(whole, train(docs, labels), "row").where(F.col("score") >= least).select("row.*")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    weights = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, weights)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
