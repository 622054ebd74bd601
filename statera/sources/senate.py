"""Periodic reports on one HTML page: heading, filing stamp, summary of counts, and one table of nine cells a row.

A page is read by built-in functions only, one row of the plan per page, and is rejected whole for its first fault: a
part that is missing or there twice, a cell outside the grammar, or counts of the summary that the rows do not bear out.

Defined results: a null or empty page has the fault ``title``.  A fault inside a row is named with the row, as in
``row 2: owner``.  Comments and scripts are no part of a page; tables inside cells are not understood and reject it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .base import SourceAdapter

# Classes of asset words, all others are filed under other; words of the summary in its order.
CLASSES = {"Stock": "equity", "Corporate Bond": "bond"}
SUMMARY = {"Self": "Self", "Joint": "Joint", "Spouse": "Spouse", "Dependent Child": "Child"}
CELLS = ("row_number_raw", "transaction_date_raw", "owner_raw", "ticker_raw", "asset_name_raw", "asset_type_raw", "transaction_type_raw", "amount_raw", "comment_raw")
NOTHING = "--"


def elements(html: Column, tag: str, cls: str | None = None) -> Column:
    """What is inside the elements of a tag, of a class if one is given, in document order."""
    has = rf"(?=[^>]*?\sclass\s*=\s*[\"'][^\"'>]*(?<![\w-]){cls}(?![\w-]))" if cls else ""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b{has}[^>]*+>(.*?)</{tag}\s*>"), F.lit(1))


def text_of(html: Column) -> Column:
    """The text of a piece of a page: tags part words, entities are decoded, white space is collapsed."""
    return S.collapsed(S.unescaped(F.regexp_replace(html, "<[^>]*+>", " ")))


def _one(found: Column) -> Column:
    """The text of the only element, null if there is none, several, or one without text."""
    return F.when(F.size(found) == 1, F.nullif(text_of(F.get(found, 0)), F.lit("")))


def _whole(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def _kept(df: DataFrame, key: str, **columns: Column) -> DataFrame:
    """key and the columns as evaluated once a page: a generator stands between them and whatever uses them."""
    return df.select(key, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_v")).select(key, "_v.*")


def _row(td: Column) -> Column:
    """Struct of a row (its cells as they stand in the page): texts, the detail below an asset's name, and the first fault."""
    muted = r"(?is)<div\b(?=[^>]*?\sclass\s*=\s*[\"'][^\"'>]*(?<![\w-])text-muted(?![\w-]))[^>]*+>.*?</div\s*>"
    read_ = F.struct(F.transform(td, text_of).alias("texts"), F.transform(elements(F.get(td, 3), "a"), text_of).alias("links"), text_of(F.regexp_replace(F.get(td, 4), muted, " ")).alias("name"), F.transform(elements(F.get(td, 4), "div", "text-muted"), text_of).alias("notes"))

    def judged(v: Column) -> Column:
        cell = lambda k: F.get(v.texts, k)
        ticker, detail = F.when(F.size(v.links) > 0, F.get(v.links, 0)).when(cell(3) != NOTHING, F.lit("")), F.get(v.notes, 0)
        fault = (
            F.when(F.size(v.texts) != len(CELLS), "width")
            .when(~cell(0).rlike("^[0-9]+$"), "number")
            .when(S.us_date(cell(1)).isNull(), "date")
            .when(~cell(2).isin(*S.OWNER_WORDS), "owner")
            .when(ticker == "", "ticker")
            .when((v["name"] == "") | F.coalesce(detail == "", F.lit(False)), "asset")
            .when(cell(5) == "", "asset_type")
            .when(~cell(6).isin(*S.SIDES), "side")
            .when(~cell(7).isin(*[b[0] for b in S.BANDS]), "band")
            .when(cell(8) == "", "comment")
        )
        values = [cell(0), cell(1), cell(2), ticker, v["name"], cell(5), cell(6), cell(7), F.nullif(cell(8), F.lit(NOTHING))]
        return F.struct(*[x.alias(n) for x, n in zip(values, CELLS)], detail.alias("asset_detail_raw"), fault.alias("fault"))

    return _once(read_, judged)


def read(pages: DataFrame, key: str = "sha256", html: str = "text") -> DataFrame:
    """key, title, filer, filed_at, rows and reason (null where the page is sound), one row a page."""
    p = F.col("plain")
    plain = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    lists = F.flatten(F.transform(elements(p, "section", "card"), lambda s: elements(s, "ul")))
    page = _kept(pages, key, plain=plain)
    page = _kept(
        page, key, title=_one(elements(p, "h1", "mb-2")), filer=_one(elements(p, "h2", "filedReport")), stamp=_one(F.flatten(F.transform(elements(p, "p", "muted"), lambda x: elements(x, "strong")))),
        said=F.transform(F.flatten(F.transform(lists, lambda u: elements(u, "li"))), text_of), tables=elements(p, "table", "table"),
    )
    lines = F.flatten(F.transform(elements(F.get("tables", 0), "tbody"), lambda b: F.transform(elements(b, "tr"), lambda r: elements(r, "td"))))
    page = _kept(page, key, title=F.col("title"), filer=F.col("filer"), stamp=F.col("stamp"), said=F.col("said"), tables=F.size("tables"), rows=F.transform(lines, _row))
    total = _whole(F.get("said", 0), r"^\(([0-9]+) transactions? total\)$")
    noun = F.when(total == 1, F.lit(" transaction ")).otherwise(" transactions ")
    filed_at = F.regexp_extract("stamp", "^Filed (.*)$", 1)
    counts = [_whole(F.get("said", k), rf"^([0-9]+)\s*{label}$") for k, label in enumerate(SUMMARY, 1)]
    owners = F.transform("rows", lambda r: r.owner_raw)
    of_owner = [F.size(owners) - F.size(F.array_remove(owners, word)) for word in SUMMARY.values()]
    summary_ok, owners_ok = F.coalesce(total.isNotNull() & F.contains(F.get("said", 0), noun), F.lit(False)), F.lit(True)
    for said, found in zip(counts, of_owner):
        summary_ok, owners_ok = summary_ok & said.isNotNull(), owners_ok & (said == found)
    faults = F.filter(F.transform("rows", lambda r, k: F.when(r.fault.isNotNull(), F.concat(F.lit("row "), (k + 1).cast("string"), F.lit(": "), r.fault))), lambda f: f.isNotNull())
    in_turn = F.forall(F.transform("rows", lambda r, k: r.row_number_raw.try_cast("int") == F.size("rows") - k), lambda ok: F.coalesce(ok, F.lit(False)))
    reason = (
        F.when(S.report_title(F.col("title"))[0].isNull(), "title")
        .when(F.col("filer").isNull(), "filer")
        .when(F.col("stamp").isNull() | (filed_at == ""), "stamp")
        .when((F.size("said") != 5) | ~summary_ok, "summary")
        .when(F.col("tables") != 1, "table")
        .when(F.size(faults) > 0, F.get(faults, 0))
        .when(F.coalesce(F.size("rows"), F.lit(0)) < 1, "no_rows")
        .when(F.size("rows") != total, "count")
        .when(~in_turn, "sequence")
        .when(~owners_ok, "owners")
    )
    return _kept(page, key, title=F.col("title"), filer=F.col("filer"), filed_at=filed_at, rows=F.col("rows"), reason=reason)


def rejected(pages: DataFrame, key: str = "sha256", html: str = "text") -> DataFrame:
    """key and reason of pages with a fault."""
    return read(pages, key, html).where("reason is not null").select(key, "reason")


class Senate(SourceAdapter):
    """Periodic reports; pages with a fault give no rows (``rejected`` has them)."""

    regime = "us_senate"
    identity_columns = ("sha256",)

    def parse(self, bronze: DataFrame) -> DataFrame:
        rows = read(bronze).where("reason is null").select("sha256", "title", "filer", "filed_at", F.posexplode("rows").alias("k", "r"))
        loss = S.confidence((~F.col("r.asset_type_raw").isin(*CLASSES), 0.05), (F.col("r.asset_detail_raw").isNotNull(), 0.02))
        return rows.select(
            "sha256", (F.col("k") + 1).alias("row_ordinal"), F.col("title").alias("report_title_raw"), F.col("filer").alias("filer_name_raw"), F.col("filed_at").alias("filed_at_raw"),
            *[F.col(f"r.{c}").alias(c) for c in (*CELLS, "asset_detail_raw")], loss.alias("confidence"),
        )

    def normalize(self, silver: DataFrame) -> DataFrame:
        kind = F.col("transaction_type_raw")
        bound = lambda k: S.mapped(F.col("amount_raw"), {b[0]: str(b[k]) for b in S.BANDS if b[k] is not None}).cast("long")
        details = F.struct(
            F.col("sha256").alias("report_uuid"), "row_ordinal", F.col("row_number_raw").alias("row_number"), F.col("ticker_raw").alias("ticker"), "asset_type_raw", F.col("asset_detail_raw").alias("asset_detail"), F.col("amount_raw").alias("amount_band_raw"),
            "transaction_type_raw", (kind == "Sale (Partial)").alias("partial_sale"), F.col("comment_raw").alias("comment"), S.report_title(F.col("report_title_raw"))[1].alias("amendment_number"), "filed_at_raw",
        )
        return silver.select(
            "sha256", "row_ordinal", F.lit("transaction").alias("record_type"), S.mapped(F.col("asset_type_raw"), CLASSES, "other").alias("asset_class"), F.col("asset_name_raw").alias("asset_description_raw"),
            S.mapped(kind, S.SIDES).alias("side"), S.mapped(F.col("owner_raw"), S.OWNER_WORDS).alias("owner"), S.us_date(F.col("transaction_date_raw")).alias("transaction_date"),
            bound(1).alias("low_cents"), bound(2).alias("high_cents"), F.lit("USD").alias("currency"), F.col("confidence").alias("extraction_confidence"), F.to_json(details, {"ignoreNullFields": "false"}).alias("details"),
        )
