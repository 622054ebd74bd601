"""Personal data by bootstrapped contextual extraction, DataFrame functions only.

Seeds are four kinds of entities found by fixed patterns (email, ip, card, phone).  Words that look like identifiers
(with a digit or an at sign) are instances; the two words before one, or the word before and the shape of the word
itself, are its lexical patterns.  Spark scores the graph of patterns and instances in rounds: a pattern's score is
the share of its distinct instances that are personal, weighted by their scores and smoothed by its support; an
instance that is no seed gets the noisy-or of its patterns.  Patterns of enough support and score then take further
identifiers, kind ``id``, wherever they occur; seeds stay as they are.  Scores are aggregated with map-side combine;
a pattern with a third of all instances is one row after it.

Matches are leftmost and do not overlap within a kind; those that fail the check of their kind (numbers of an ip at
most 255; a card's 12 to 19 digits pass Luhn; a phone has 9 to 15 digits) are dropped.  The regular expressions are
the plain ones with possessive repeats and, where a match can only begin at the start of a run of characters, a look
back that says so, which keeps them linear on long runs.

Constants that shape the extra spans: ``ROUNDS`` of scoring, ``LEAST_SUPPORT`` distinct personal instances and a grade
of ``LEAST_SCORE`` for a pattern, whose support is smoothed by ``SMOOTH``; shapes of words are cut to 24 characters.
Words are taken as instances whatever their length; what surrounds their letters and digits is left off.

Defined results: null and empty texts have no spans; positions count code points; repeated rows get equal results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

KINDS = ("email", "ip", "card", "phone", "id")
ROUNDS = 3
LEAST_SUPPORT = 5
LEAST_SCORE = 0.6
SMOOTH = 2.0

_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_S, _W = "[\\x20\\x09-\\x0D]", "[^\\x20\\x09-\\x0D]"
#: the last two words of a text
LAST_TWO = rf"(?<!{_W})(?:{_W}++{_S}++)?{_W}++{_S}*+\z"
LOOKS = rf"(?<!{_W}){_W}*?[0-9@]{_W}*+"

SPAN = "array<struct<start:int,kind:int,end:int>>"
EDGE = "\u0001"  # set around matches; one that a text holds counts as the next character, which no pattern tells from it


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = _digits(match)
    n = F.char_length(digits)

    def digit(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + digit(i))
    return F.when(n.between(12, 19), total % 10 == 0).otherwise(False)


#: kind, pattern, what a text must have for a match, check of a match
BASE = (
    (0, EMAIL, lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True)),
    (1, IP, lambda t: F.contains(t, F.lit(".")) & t.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
    (2, CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), _luhn),
    (3, PHONE, lambda t: F.contains(t, F.lit("+")), lambda m: F.char_length(_digits(m)).between(9, 15)),
)


def _cut(text: Column, pattern: str, may: Column) -> Column:
    """The text cut at the ends of its matches: gaps and matches by turns, beginning with a gap; empty without a match.

    A gap is its length, its leading white space and its last two words; a match is kept whole.
    """
    parts = F.split(F.regexp_replace(F.translate(text, EDGE, "\u0002"), pattern, EDGE + "$0" + EDGE), EDGE, -1)

    def piece(x: Column, i: Column) -> Column:
        match = i % 2 == 1
        head, tail = F.regexp_extract(x, rf"^{_S}*+", 0), F.regexp_extract(x, LAST_TWO, 0)
        return F.struct(F.char_length(x).alias("n"), F.when(match, x).alias("match"), F.when(~match, head).alias("head"), F.when(~match, tail).alias("tail"))

    return F.transform(F.when(may, parts).otherwise(F.array().cast("array<string>")), piece)


def pieces(docs: DataFrame) -> DataFrame:
    """row_id, doc_id and cuts, (kind, parts) of each kind with a match; kind 4 are words with a digit or an at sign."""
    text = shared.whole_text()
    cut = [(kind, _cut(text, pattern, may(text))) for kind, pattern, may, _ in BASE] + [(4, _cut(text, LOOKS, text.rlike("[0-9@]")))]
    cuts = F.array(*[F.struct(F.lit(kind).alias("kind"), parts.alias("parts")) for kind, parts in cut])
    return docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.filter(cuts, lambda c: F.size(c["parts"]) > 1).alias("cuts"))


def matches(cuts: DataFrame) -> DataFrame:
    """row_id, kind, start, end, match, and the two words before it, of every match that passes the check of its kind.

    Starts are running sums over the pieces of a text, so the work is in proportion to them however long the text is.
    """
    rows = cuts.select("row_id", F.explode("cuts").alias("c")).select("row_id", "c.kind", F.posexplode("c.parts").alias("i", "p")).select("row_id", "kind", "i", "p.*")
    order = Window.partitionBy("row_id", "kind").orderBy("i")
    back = lambda c, k: F.coalesce(F.lag(c, k).over(order), F.lit(""))
    before = F.concat(back("match", 4), back("head", 3), back("tail", 3), back("match", 2), back("head", 1), back("tail", 1))
    rows = rows.repartition("row_id").select("row_id", "kind", "i", "n", "match", F.sum("n").over(order).alias("end"), F.when(F.col("kind") == 4, before).alias("before"))
    ok = F.lit(True)
    for kind, _, _, check in BASE:
        ok = F.when(F.col("kind") == kind, check(F.col("match"))).otherwise(ok)
    rows = rows.where(F.col("match").isNotNull()).where(ok)
    return rows.select("row_id", "kind", (F.col("end") - F.col("n")).cast("int").alias("start"), F.col("end").cast("int").alias("end"), "match", F.regexp_extract("before", LAST_TWO, 0).alias("before"))


def _shape(word: Column) -> Column:
    for of, to in (("[0-9]+", "0"), ("[A-Z]+", "A"), ("[a-z]+", "a")):
        word = F.regexp_replace(word, of, to)
    return F.left(word, F.lit(24))


def instances(found: DataFrame) -> DataFrame:
    """``found`` with patterns and seed: words lose what surrounds their letters and digits; those inside a seed are left out."""
    word = F.col("kind") == 4
    body = F.regexp_replace(F.when(F.col("match").rlike("[A-Za-z0-9]"), F.col("match")).otherwise(""), "^[^A-Za-z0-9+@]++", "")
    core = F.regexp_replace(body, "(?<=[A-Za-z0-9])[^A-Za-z0-9]++$", "")
    lead = F.char_length("match") - F.char_length(body)
    rows = found.select("row_id", "kind", F.when(word, F.col("start") + lead).otherwise(F.col("start")).alias("start"), "end", F.when(word, core).alias("instance"), F.lower(F.regexp_replace("before", rf"(?<={_W}){_S}++\z", "")).alias("before"))
    rows = rows.where(~word | (F.col("instance") != "")).withColumn("end", F.when(word, F.col("start") + F.char_length("instance")).otherwise(F.col("end")))
    # the nearest seeds on either side; of equal starts, the word comes first in one order and last in the other
    up = Window.partitionBy("row_id").orderBy("start", F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("row_id").orderBy(F.desc("start"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    seed = lambda c: F.when(F.col("kind") < 4, F.col(c))
    rows = rows.withColumn("upto", F.max(seed("end")).over(up)).withColumn("next", F.min(seed("start")).over(down))
    begins = F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    inside = F.coalesce(F.col("upto") > F.col("start"), F.lit(False))
    first = F.regexp_extract("before", rf"(?<!{_W})({_W}++)\z", 1)
    two = F.regexp_extract("before", rf"(?<!{_W})({_W}++{_S}++{_W}++)\z", 1)
    keys = F.array(F.when(two != "", F.concat(F.lit("2 "), two)), F.when(first != "", F.concat_ws(" ", F.lit("1"), first, _shape(F.col("instance")))))
    return rows.where(~word | begins | ~inside).select("row_id", "kind", "start", "end", "instance", F.when(word, F.array_compact(keys)).alias("patterns"), F.when(word, begins).alias("seed"))


def patterns(words: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, score) of the patterns that are trusted; ``words`` are the rows of kind 4 of a stored table of :func:`instances`."""
    edges = words.select(F.explode("patterns").alias("pattern"), "instance", "seed").groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    # a pattern with few distinct instances can never be trusted: it takes no part in any round
    support = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SUPPORT)
    edges = shared.stored(edges.join(support, "pattern").select("pattern", "instance", "seed"), "edges")
    score = edges.select("pattern", "instance", F.col("seed").cast("double").alias("score"))
    for k in range(rounds):
        graded = score.groupBy("pattern").agg((F.sum("score") / (F.count("*") + SMOOTH)).alias("grade"), F.sum(F.when(F.col("score") > 0.5, 1).otherwise(0)).alias("support"))
        graded = shared.stored(graded, "patterns")
        if k + 1 < rounds:
            share = F.when(F.col("support") >= LEAST_SUPPORT, F.col("grade")).otherwise(0.0)
            each = edges.join(graded, "pattern").groupBy("instance").agg((1 - F.product(1 - share)).alias("or"))
            score = edges.join(each, "instance").select("pattern", "instance", F.when(F.col("seed"), 1.0).otherwise(F.col("or")).alias("score"))
    return graded.where((F.col("support") >= LEAST_SUPPORT) & (F.col("grade") >= LEAST_SCORE)).select("pattern", F.col("grade").alias("score"))


def find(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, base and extra (arrays of start, kind, end) of every row."""
    cuts = shared.stored(pieces(docs), "pieces")
    found = shared.stored(instances(matches(cuts)), "instances")
    words = found.where("kind = 4")
    trusted = patterns(words)
    new = words.where("NOT seed").select("row_id", "kind", "start", "end", F.explode("patterns").alias("pattern")).join(trusted, "pattern", "left_semi")
    span, kept = F.struct("start", "kind", "end"), found.where("kind < 4").select("row_id", "kind", "start", "end").unionByName(new.select("row_id", "kind", "start", "end"))
    spans = kept.groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") < 4, span))).alias("base"), F.array_sort(F.collect_set(F.when(F.col("kind") == 4, span))).alias("extra")
    )
    out = cuts.select("row_id", "doc_id").join(shared.stored(spans, "spans"), "row_id", "left")
    return out.select("row_id", "doc_id", *[F.coalesce(c, F.array()).cast(SPAN).alias(c) for c in ("base", "extra")])


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op10_contextual_pii(spark, sf_dir: str) -> DataFrame:
    found = find(shared.documents(spark, sf_dir))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == F.lit(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "extra"))).alias("spans"))
