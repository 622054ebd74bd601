"""Rows of printed transaction tables from the lines of documents: gaps and islands, by window functions alone.

A row ends at its anchor, a line with two dates side by side after a type token and before an amount.  Lines of text
before it, wherever pages break, are the cell of its asset; labelled lines after it are its own.  Every line is given a
class, a running number of anchors makes islands, and islands are joined back to rows.  A document that breaks the
grammar anywhere is rejected whole, with its first breach.  All windows are by document and so share one shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

# Fixed values of the source: what a page prints between rows, section names, labels (short form, letters, full name),
# what a checkbox leaves in the text, and the owner codes of the first cell.
HEADING = ("T", "TRANSACTIONS")
FOOTNOTE = "* For the complete list"
NEXT_SECTIONS = ("I V D", "C", "I P O", "C S")
NEXT_SECTIONS_FULL = ("INVESTMENT VEHICLE DETAILS", "COMMENTS", "INITIAL PUBLIC OFFERINGS", "CERTIFICATION AND SIGNATURE")
FOOTER = "Filing ID #"
HEADER = ("ID Owner Asset Transaction", "Type Date Notification", "Date Amount Cap.", "Gains >", "$200?")
HEADER_SHORT = ("ID Owner Asset Transaction", "Type Date Notification", "Date Amount")
LABELS = {
    "filing_status": ("F S:", "FS", "FILING STATUS"),
    "subholding": ("S O:", "SO", "SUBHOLDING OF"),
    "description": ("D:", "D", "DESCRIPTION"),
    "comments": ("C:", "C", "COMMENTS"),
    "location": ("L:", "L", "LOCATION"),
}
CHECKBOX = ("gfedc", "gfedcb")
OWNERS = ("SP", "DC", "JT")

_DATE = "([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})"
_PAIR = rf"(?U)^(|.*?\s){_DATE}\s+{_DATE}(?:\s+(.*))?$"
_TYPE = r"(?iU)^(|.*\s)(p|e|s(?:\s+\(partial\))?)$"


def _plain(line: Column) -> Column:
    """Lower case, white space collapsed: how headings and header lines are compared."""
    return F.lower(F.trim(F.regexp_replace(line, r"(?U)\s+", " ")))


def _is_any(plain: Column, names) -> Column:
    return plain.isin(*{n.lower() for n in names})


def region(lines: DataFrame) -> DataFrame:
    """document, position and line between the heading of the transactions and the footnote or the next section.

    A document without both ends keeps its lines under an error of its own (column ``outside``).
    """
    line = F.regexp_replace(F.replace(F.coalesce("line", F.lit("")), F.lit("\0"), F.lit("")), r"(?U)^\s+|\s+$", "")
    rows = lines.select("document", "position", line.alias("line"))
    plain, whole = _plain(F.col("line")), Window.partitionBy("document")
    by = whole.orderBy("position")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = (F.trim(F.regexp_replace("line", r"(?U)\s+", " ")) == HEADING[0]) | (plain == HEADING[1].lower())
    rows = rows.withColumn("begun", F.max(heading).over(so_far))
    ends = F.col("begun") & (F.startswith("line", F.lit(FOOTNOTE)) | F.regexp_replace("line", r"(?U)\s+", " ").isin(*NEXT_SECTIONS) | _is_any(plain, NEXT_SECTIONS_FULL))
    rows = rows.withColumn("ended", F.max(ends).over(so_far)).withColumn("starts", F.col("begun") & ~F.coalesce(F.lag("begun").over(by), F.lit(False)))
    outside = F.when(~F.max("begun").over(whole), "no_heading").when(~F.max("ended").over(whole), "no_end")
    rows = rows.withColumns({"outside": outside, "first": F.row_number().over(by) == 1})
    return rows.where((F.col("outside").isNotNull() & F.col("first")) | (F.col("outside").isNull() & F.col("begun") & ~F.col("starts") & ~F.col("ended"))).select("document", "position", "line", "outside")


def _label() -> tuple[Column, Column, Column]:
    """Label, content and whether it was printed loosely; nulls for a line without a label."""
    label, content, loose = (F.lit(None).cast(t) for t in ("string", "string", "boolean"))
    for name, (strict, letters, full) in reversed(LABELS.items()):
        tight = rf"(?U)^{strict}\s*(\S.*)$"
        wide = [rf"(?U)^{r'\s*'.join(letters)}\s*:\s*(\S.*)$", rf"(?iU)^\s*{r'\s+'.join(full.split(' '))}\s*:\s*(\S.*)$"]
        for pattern, is_loose in [(wide[1], True), (wide[0], True), (tight, False)]:
            hit = F.col("line").rlike(pattern)
            label = F.when(hit, name).otherwise(label)
            content = F.when(hit, F.regexp_extract("line", pattern, 1)).otherwise(content)
            loose = F.when(hit, is_loose).otherwise(loose)
    return label, content, loose


def classified(lines: DataFrame) -> DataFrame:
    """Every line of a region with its class, the row it belongs to, its label or anchor, and its breach of the grammar."""
    by = Window.partitionBy("document").orderBy("position")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(1, Window.unboundedFollowing)
    rows = region(lines).withColumn("plain", _plain(F.col("line")))
    # header blocks: five lines, or three in the older form
    ahead = [F.lead("plain", k).over(by) for k in range(5)]
    matches = lambda block: reduce(lambda a, b: a & b, [F.coalesce(ahead[k] == t.lower(), F.lit(False)) for k, t in enumerate(block)])
    starts = F.col("plain") == HEADER[0].lower()
    rows = rows.withColumn("header", F.when(matches(HEADER_SHORT), len(HEADER_SHORT)).when(matches(HEADER), len(HEADER)).when(starts, 1).otherwise(0))
    rows = rows.withColumn("broken", starts & ~matches(HEADER_SHORT) & ~matches(HEADER))
    inside = reduce(lambda a, b: a | b, [F.coalesce(F.lag("header", k).over(by) > k, F.lit(False)) for k in range(1, 5)], F.col("header") > 0)
    furniture = (F.col("line") == "") | F.startswith("line", F.lit(FOOTER)) | _is_any(F.col("plain"), (*HEADER, *HEADER_SHORT))
    pair = F.col("line").rlike(_PAIR)
    amount = F.trim(F.regexp_extract("line", _PAIR, 4))
    rows = rows.withColumns({"inside": inside, "furniture": furniture, "pair": pair, "wraps": pair & F.endswith(amount, F.lit("-"))})
    rows = rows.withColumns({
        "wrapped": F.coalesce(F.last(F.when(~F.col("furniture"), F.col("wraps")), ignorenulls=True).over(before), F.lit(False)),
        "following": F.first(F.when(~F.col("furniture"), F.col("line")), ignorenulls=True).over(after),
    })
    label, content, loose = _label()
    band = F.col("wrapped") & ~F.col("furniture") & F.startswith("line", F.lit("$"))
    kind = (
        F.when(band, "band").when(F.col("line") == "", "blank").when(F.startswith("line", F.lit(FOOTER)), "footer").when(F.col("inside"), "header")
        .when(label.isNotNull(), "label").when(F.col("pair"), "anchor").otherwise("text")
    )
    rows = rows.withColumns({"label": label, "content": content, "loose": loose, "kind": kind})
    last = F.last(F.when(F.col("kind") != "text", F.struct("kind", "label")), ignorenulls=True).over(before)
    rows = rows.withColumns({"last": last, "anchors": F.coalesce(F.count_if(F.col("kind") == "anchor").over(before), F.lit(0))})
    more = (F.col("kind") == "text") & F.coalesce(F.col("last.kind") == "label", F.lit(False))
    rows = rows.withColumns({
        "kind": F.when(more, "more").otherwise(F.col("kind")),
        "label": F.when(more, F.col("last.label")).otherwise(F.when(F.col("kind") == "label", F.col("label"))),
        "content": F.when(more, F.col("line")).otherwise(F.col("content")),
    })
    own = F.col("kind").isin("label", "more", "band")
    rows = rows.withColumn("row", F.col("anchors") + F.when(own, 0).otherwise(1))
    island = Window.partitionBy("document", "anchors").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("texts", F.coalesce(F.count_if(F.col("kind") == "text").over(island), F.lit(0)))
    head = F.trim(F.regexp_extract("line", _PAIR, 1))
    is_label, is_anchor = F.col("kind") == "label", F.col("kind") == "anchor"
    good = F.startswith(amount, F.lit("$")) | F.startswith(amount, F.lit("Over $"))
    lost = F.col("wraps") & ~F.coalesce(F.startswith("following", F.lit("$")), F.lit(False))
    breach = (
        F.when(F.col("outside").isNotNull(), F.col("outside")).when(F.col("broken") & (F.col("kind") == "header") & ~F.col("wrapped"), "broken_header")
        .when(is_label & (F.col("texts") > 0), "label_amid_text").when(is_label & (F.col("anchors") == 0), "label_before_row")
        .when(is_anchor & ~good, "dates_without_amount").when(is_anchor & ~head.rlike(_TYPE), "unknown_type").when(is_anchor & lost, "amount_not_continued")
    )
    token = F.upper(F.substring(F.regexp_extract(head, _TYPE, 2), F.lit(1), F.lit(1)))
    found = F.struct(
        F.trim(F.regexp_extract(head, _TYPE, 1)).alias("head"),
        F.concat(token, F.when(F.lower(head).rlike(r"\(partial\)$"), " (partial)").otherwise("")).alias("type"),
        *[F.regexp_extract("line", _PAIR, k).alias(n) for k, n in ((2, "traded"), (3, "notified"))], amount.alias("amount"),
    )
    return rows.select("document", "position", "line", "kind", "row", "label", "content", "loose", "texts", F.when(is_anchor, found).alias("anchor"), breach.alias("breach"))


def joined(rows: DataFrame) -> DataFrame:
    """One row per (document, row) of classified lines, with ``reason``, the first breach of its document or null."""
    part = lambda when, what: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("position", what)))), lambda x: x[what]), " ")
    is_ = lambda k: F.col("kind") == k
    out = rows.groupBy("document", "row").agg(
        part(is_("text"), "line").alias("cell"), F.max("anchor").alias("anchor"), F.max(F.when(is_("band"), F.col("line"))).alias("band"),
        F.bool_or(is_("footer") & (F.col("texts") > 0)).alias("page_break"), F.bool_or(F.coalesce("loose", F.lit(False)) & is_("label")).alias("loose"),
        *[F.when(F.count_if(F.col("label") == n) > 0, part(F.col("label") == n, "content")).alias(n) for n in LABELS],
        F.greatest(*[F.count_if(is_("label") & (F.col("label") == n)) for n in LABELS]).alias("labels"),
        F.min(F.when(F.col("breach").isNotNull(), F.struct("position", "breach"))).alias("breach"), F.min("position").alias("position"), F.max(is_("text")).alias("any_text"),
    )
    amount = F.concat_ws(" ", "anchor.amount", "band")
    amount = F.regexp_replace(amount, rf"(?U)\s+(?:{'|'.join(CHECKBOX)})$", "")
    cell = F.trim(F.concat_ws(" ", F.nullif("cell", F.lit("")), F.nullif(F.col("anchor.head"), F.lit(""))))
    row_id = F.nullif(F.regexp_extract(cell, "^([0-9]{10}) ", 1), F.lit(""))
    rest = F.ltrim(F.regexp_replace(cell, "^[0-9]{10} ", ""))
    owner = F.nullif(F.regexp_extract(rest, f"^({'|'.join(OWNERS)}) ", 1), F.lit(""))
    out = out.withColumns({"amount": amount, "row_id": row_id, "owner_code": owner, "asset": F.ltrim(F.regexp_replace(rest, f"^({'|'.join(OWNERS)}) ", ""))})
    low = F.coalesce(*[F.when(F.col("amount") == b, F.lit(lo)) for b, lo, _ in S.BANDS])
    high = F.coalesce(*[F.when(F.col("amount") == b, F.lit(hi).cast("long")) for b, _, hi in S.BANDS])
    out = out.withColumns({"traded": S.us_date(F.col("anchor.traded")), "notified": S.us_date(F.col("anchor.notified")), "low_cents": low, "high_cents": high})
    has = F.col("anchor").isNotNull()
    late = (
        F.when(has & F.col("low_cents").isNull(), "unknown_amount").when(has & (F.col("traded").isNull() | F.col("notified").isNull()), "unknown_date")
        .when(has & (F.col("asset") == ""), "no_asset").when(F.col("labels") > 1, "repeated_label").when(~has & F.col("any_text"), "unattached_text")
    )
    first = F.coalesce("breach", F.when(late.isNotNull(), F.struct("position", late.alias("breach"))))
    out = out.withColumn("reason", F.min(first).over(Window.partitionBy("document"))["breach"])
    code = F.nullif(F.regexp_extract("asset", r"\[([A-Z0-9]{2})\]$", 1), F.lit(""))
    return out.where(has | F.col("reason").isNotNull()).select(
        "document", "row", "row_id", "owner_code", "asset", code.alias("asset_code"), F.col("anchor.type").alias("type"), "traded", "notified", "low_cents", "high_cents", "page_break", "loose", *LABELS, "reason"
    )


def stitch(lines: DataFrame) -> DataFrame:
    """Rows of all documents (document, position, line) that keep to the grammar."""
    return joined(classified(lines)).where("reason IS NULL").drop("reason")


def rejected(lines: DataFrame) -> DataFrame:
    """document and reason of those that do not."""
    return joined(classified(lines)).where("reason IS NOT NULL").groupBy("document").agg(F.min("reason").alias("reason"))
