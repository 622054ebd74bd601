"""Language identification by a string kernel.

The kernel of two texts is the blended spectrum kernel on presence: the number of n-grams of one to ``LONGEST``
characters that both have, over the root of the product of their numbers of n-grams.  N-grams are those of the
lower-cased text, in ``SLOTS`` hashed slots.  A Nyström map on ``LANDMARKS`` landmark texts turns it into vectors, and
ridge regression of one language against the rest on those vectors gives one column of coefficients a language.

What is learnt from is bounded: about ``ROWS`` texts in all, the same number of each language by a hash of the row, each
as its bitmap of ``SLOTS`` bits, so the one task that solves the small systems never sees a text.  Every whole text is
scored by two products for a batch of texts: presence times landmarks (counts, exact in any order), then kernel times
coefficients.

Defined results: ``und`` and 0 for null texts and texts without a letter; a row without a language, or held out, is
not learnt from; without any language learnt all are ``und``; equal scores go to the language that is less as UTF-8;
the score is the regression's value within 0 and 1; null ids hash as the empty string; copies and repeated rows get
equal results; of equal bitmaps of one language one is learnt; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .textblocks import keep_pages

LONGEST = 3
SLOT_BITS = 13
SLOTS = 1 << SLOT_BITS
ROWS = 4096
LANDMARKS = 256
RIDGE = 1e-3
BATCH = 128
BLOCK_CHARS = 1 << 18
UND = "und"
_U = np.uint64


def held_out() -> Column:
    return shared.word_crc() % 5 == 0


def has_letter(text: Column | str = "text") -> Column:
    return F.coalesce(F.col(text).rlike("\\p{L}") if isinstance(text, str) else text.rlike("\\p{L}"), F.lit(False))


def slots(text: str) -> np.ndarray:
    """Which slots the n-grams of a text fall into, as a vector of booleans; long texts go block by block."""
    out = np.zeros(SLOTS, bool)
    text = text.lower()
    for lo in range(0, max(1, len(text)), BLOCK_CHARS):
        part = text[lo : lo + BLOCK_CHARS + LONGEST - 1]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + _U(1)
        h = np.zeros(len(codes), np.uint64)
        for n in range(min(LONGEST, len(codes))):
            h = h[: len(codes) - n] * _U(0x9E3779B97F4A7C15) + codes[n:]
            out[(h * _U(0xD1342543DE82EF95) ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9) >> _U(64 - SLOT_BITS)] = True
    return out


def bitmaps(docs: DataFrame) -> DataFrame:
    """lang, order and the packed slots of every text of (lang, order, text)."""

    def run(batches):
        keep_pages()
        for batch in batches:
            packed = [np.packbits(slots(t or "")).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["lang", "order", "slots"])

    return docs.select("lang", "order", "text").mapInArrow(run, "lang string, `order` long, slots binary")


def kernel(present: np.ndarray, marks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Kernel of texts (rows of 0 and 1) with landmarks (columns of 0 and 1, of ``sizes`` n-grams)."""
    both = present @ marks  # whole numbers below 2^24, so exact as 32-bit floats
    own = np.sqrt(np.maximum(present.sum(1, dtype=np.float64), 1))
    return both.astype(np.float64) / own[:, None] / np.sqrt(np.maximum(sizes, 1))[None, :]


class Model:
    """Landmarks and coefficients, and the languages they stand for in order."""

    def __init__(self, langs: list[str], marks: np.ndarray, weights: np.ndarray):
        self.langs, self.marks, self.weights = langs, marks, weights
        self.sizes = marks.sum(0, dtype=np.float64)

    def scores(self, present: np.ndarray) -> np.ndarray:
        k = kernel(present, self.marks, self.sizes)
        return np.round(np.column_stack([k, np.ones(len(k))]) @ self.weights, 9)


def solve(langs: list[str], bits: np.ndarray, landmarks: int) -> Model:
    """Nyström map and ridge regression on rows ordered by their hash; landmarks are dealt over the languages in turn."""
    names = sorted(set(langs), key=lambda x: x.encode())
    index = np.array([names.index(x) for x in langs])
    turn = np.zeros(len(index), np.int64)
    for k in range(len(names)):
        turn[index == k] = np.arange((index == k).sum())
    chosen = np.lexsort((index, turn))[:landmarks]
    present = bits.astype(np.float32)
    marks = np.ascontiguousarray(present[chosen].T)
    k_all = kernel(present, marks, marks.sum(0, dtype=np.float64))
    values, vectors = np.linalg.eigh(k_all[chosen])
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])  # K_mm^(-1/2) on its range
    phi = np.column_stack([k_all @ root, np.ones(len(index))])
    weight = 1 / np.bincount(index, minlength=len(names))[index] / len(names)  # every language counts alike
    y = (index[:, None] == np.arange(len(names))).astype(np.float64)
    ridge = RIDGE * np.eye(phi.shape[1])
    ridge[-1, -1] = 0
    solved = np.linalg.solve((phi * weight[:, None]).T @ phi + ridge + 1e-12 * np.eye(len(ridge)), (phi * weight[:, None]).T @ y)
    return Model(names, marks, np.vstack([root @ solved[:-1], solved[-1:]]))


def train(docs: DataFrame, rows: int = ROWS, landmarks: int = LANDMARKS) -> Model | None:
    """The model learnt from about ``rows`` rows of ``docs`` that have a language and a letter and are not held out."""
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & has_letter())
    usable = usable.select("lang", F.xxhash64("doc_id", "text").alias("order"), "text")
    sizes = usable.groupBy("lang").agg(F.count("*").alias("all"))
    sizes = shared.stored(sizes, "sizes")
    n_langs = sizes.count()
    if not n_langs:
        return None
    each = max(1, rows // n_langs)
    # twice as many as needed pass the threshold of their hash, so that the exact cut meets few rows
    below = F.pmod(F.col("order"), F.lit(1 << 30)) * F.col("all") <= F.lit(2.0 * each * (1 << 30))
    near = usable.join(sizes, "lang").where(below)
    first = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    packed = bitmaps(near).dropDuplicates(["lang", "slots"]).withColumn("rank", first).where(F.col("rank") <= each)
    table = shared.stored(packed, "bitmaps").toArrow().sort_by([("lang", "ascending"), ("order", "ascending"), ("slots", "ascending")])
    bits = np.unpackbits(np.frombuffer(b"".join(table["slots"].to_pylist()), np.uint8).reshape(-1, SLOTS // 8), axis=1)
    return solve(table["lang"].to_pylist(), bits, landmarks)


def predict(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """The columns ``keep``, lang_pred and score of every row."""
    types = dict(docs.dtypes)
    if model is None:
        return docs.select(*keep, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        keep_pages()
        m = shipped.value
        names = np.array(m.langs, object)
        present = np.zeros((BATCH, SLOTS), np.float32)
        for batch in batches:
            texts, letters = batch.column(len(keep)), batch.column(len(keep) + 1).to_pylist()
            langs, scores = [UND] * len(texts), np.zeros(len(texts))
            which = [k for k, x in enumerate(letters) if x]
            for lo in range(0, len(which), BATCH):
                part = which[lo : lo + BATCH]
                for k, i in enumerate(part):
                    present[k] = slots(texts[i].as_py())
                s = m.scores(present[: len(part)])
                best = s.argmax(1)
                scores[part] = np.clip(s[np.arange(len(part)), best], 0, 1)
                for i, name in zip(part, names[best]):
                    langs[i] = name
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(langs, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    rows = docs.select(*keep, F.col("text").alias("whole_text"), has_letter().alias("has_letter"))
    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", lang_pred string, score double")


def op11_language_kernel(spark, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    return predict(docs, train(docs), "doc_id").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
