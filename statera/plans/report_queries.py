"""Printed reports: lines laid out from the paragraphs of pages, and the rows that come back from them."""

from __future__ import annotations

import csv
import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import conformance, stitch
from ..sources import archives, declarations, senate
from ..sources.adapters import ADAPTERS
from .catalog import query

# Both engines take the paragraphs of a page as assets of a report: what a row says follows from its page and number.
# DuckDB states the rows; Spark prints them as lines, with wraps, page breaks and faults, and stitches them again.
_ROWS = """
    SELECT id AS document, CAST(id AS BIGINT) AS page, n, words FROM (
      SELECT id, CAST(k - 1 AS BIGINT) AS n, trim(regexp_replace(p, '\\s+', ' ', 'g')) AS words
      FROM (SELECT id, unnest(regexp_extract_all(body, '<p>([^<]+)', 1)) AS p, generate_subscripts(regexp_extract_all(body, '<p>([^<]+)', 1), 1) AS k FROM raw_document) a
      WHERE trim(regexp_replace(p, '\\s+', ' ', 'g')) <> '') b"""
FAULTS = {3: "unattached_text", 5: "unknown_type", 7: "broken_header", 9: "label_before_row", 11: "amount_not_continued", 13: "repeated_label", 15: "no_heading"}


def report_rows(d) -> DataFrame:
    """document, page, n, words: one row of a report for each paragraph of a page."""
    found = d.raw_document.select(F.col("id").alias("document"), F.posexplode(F.regexp_extract_all("body", F.lit("<p>([^<]+)"), F.lit(1))).alias("n", "p"))
    words = F.trim(F.regexp_replace("p", r"\s+", " "))
    return found.select("document", F.col("document").cast("long").alias("page"), F.col("n").cast("long").alias("n"), words.alias("words")).where("words <> ''")


def report_lines(d) -> DataFrame:
    """document, position, line: the rows as a printed report."""
    rows = report_rows(d).withColumn("first", F.col("n") == F.min("n").over(Window.partitionBy("document")))
    n, page = F.col("n"), F.col("page")
    fault = lambda k: (page % 16 == k) & F.col("first")
    lines = lambda *x: F.array(*[F.lit(v) for v in x])
    header = lambda: F.when(page % 4 == 0, lines("iD  owner asset transaction", "type Date Notification", "Date Amount")).otherwise(lines(*stitch.HEADER))
    footer = F.array(F.concat(F.lit("Filing ID #"), page.cast("string")))
    none = F.array().cast("array<string>")
    chunks = F.expr("transform(sequence(0, cast((size(split(words, ' ')) - 1) div 6 as int)), i -> array_join(slice(split(words, ' '), i * 6 + 1, 6), ' '))")
    rows = rows.withColumn("chunks", chunks)
    opening = F.concat(F.when(n % 9 == 4, F.concat(F.lpad((page * 1000 + n).cast("string"), 10, "0"), F.lit(" "))).otherwise(""), F.get(lines("", "SP ", "DC ", "JT "), (n % 4).cast("int")))
    code = F.get(lines(" [ST]", " [OP]", "", " [ZZ]"), (n % 4).cast("int"))
    day = lambda k: F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), ((page * 7 + n) % 365 + k).cast("int")), "M/d/yyyy")
    kind = F.when(fault(5), "Q").otherwise(F.get(lines("P", "s (partial)", "E", "S"), (n % 4).cast("int")))
    wraps = n % 3 == 1
    amount = F.when(wraps | fault(11), "$100,001 -").otherwise("$1,001 - $15,000")
    box = F.when(n % 7 == 3, " gfedcb").otherwise("")
    anchor = F.concat(code, F.lit(" "), kind, F.lit(" "), day(0), F.lit("  "), day(4), F.lit(" "), amount, F.when(wraps | fault(11), "").otherwise(box))
    last = F.size("chunks") - 1
    text = F.transform("chunks", lambda c, i: F.concat(F.when(i == 0, opening).otherwise(""), c, F.when(i == last, anchor).otherwise("")))
    broken = (n % 5 == 2) & (F.size("chunks") > 1)
    text = F.when(broken, F.concat(F.slice(text, 1, 1), footer, header(), F.slice(text, 2, F.greatest(last, F.lit(1))))).otherwise(text)
    rest = F.when(fault(11), lines("no amount here")).when(wraps & (n % 6 == 4), F.concat(lines(""), footer, header(), F.array(F.concat(F.lit("$250,000"), box)))).when(wraps, F.array(F.concat(F.lit("$250,000"), box))).otherwise(none)
    labels = F.concat(
        F.when(n % 4 != 3, lines("F S: New")).otherwise(none), F.when(n % 4 == 1, F.concat(F.array(F.concat(F.lit("dEscription:  "), F.get("chunks", 0))), lines("and more", "of it"))).otherwise(none),
        F.when(n % 4 == 2, lines("L : Here")).otherwise(none), F.when(fault(13), lines("F S: New", "F S: Old")).otherwise(none), lines(""),
    )
    front = F.concat(
        F.when(F.col("first") & ~fault(15), F.concat(lines("noise before 1/1/2020 1/2/2020"), F.array(F.when(page % 2 == 0, "T").otherwise("tranSactionS")))).otherwise(none),
        F.when(fault(7), lines("ID Owner Asset Transaction", "Gains >")).when(F.col("first"), header()).otherwise(none), F.when(fault(9), lines("F S: New")).otherwise(none),
    )
    body = rows.select("document", "n", F.posexplode(F.concat(front, text, rest, labels)).alias("k", "line"))
    ends = rows.where("first").select("document", F.lit(1 << 20).cast("long").alias("n"), F.posexplode(F.concat(F.when(page % 16 == 3, lines("left over")).otherwise(none), lines("* For the complete list of codes", "noise after"))).alias("k", "line"))
    return body.union(ends).select("document", (F.col("n") * (1 << 20) + F.col("k")).alias("position"), "line")


@query(
    "w7_stitch",
    f"""SELECT document, row_number() OVER (PARTITION BY document ORDER BY n) AS row, CASE WHEN n % 9 = 4 THEN lpad(CAST(page * 1000 + n AS VARCHAR), 10, '0') END AS row_id,
               CASE n % 4 WHEN 1 THEN 'SP' WHEN 2 THEN 'DC' WHEN 3 THEN 'JT' END AS owner_code, words || CASE n % 4 WHEN 0 THEN ' [ST]' WHEN 1 THEN ' [OP]' WHEN 3 THEN ' [ZZ]' ELSE '' END AS asset,
               CASE n % 4 WHEN 0 THEN 'ST' WHEN 1 THEN 'OP' WHEN 3 THEN 'ZZ' END AS asset_code, CASE n % 4 WHEN 0 THEN 'P' WHEN 1 THEN 'S (partial)' WHEN 2 THEN 'E' ELSE 'S' END AS type,
               DATE '2020-01-01' + CAST((page * 7 + n) % 365 AS INTEGER) AS traded, DATE '2020-01-01' + CAST((page * 7 + n) % 365 + 4 AS INTEGER) AS notified,
               CASE WHEN n % 3 = 1 THEN 10000100 ELSE 100100 END AS low_cents, CASE WHEN n % 3 = 1 THEN 25000000 ELSE 1500000 END AS high_cents,
               n % 5 = 2 AND len(string_split(words, ' ')) > 6 AS page_break, n % 4 IN (1, 2) AS loose, CASE WHEN n % 4 <> 3 THEN 'New' END AS filing_status,
               CASE WHEN n % 4 = 1 THEN array_to_string(string_split(words, ' ')[1:6], ' ') || ' and more of it' END AS description, CASE WHEN n % 4 = 2 THEN 'Here' END AS location
        FROM ({_ROWS}) r WHERE page % 16 NOT IN ({', '.join(map(str, FAULTS))})""",
)
def w7(d):
    """Reports printed from pages, stitched back to their rows; reports with a fault give none."""
    return stitch.stitch(report_lines(d)).drop("subholding", "comments")


@query("w7_rejected", f"SELECT DISTINCT document, CASE page % 16 {' '.join(f'WHEN {k} THEN {v!r}' for k, v in FAULTS.items())} END AS reason FROM ({_ROWS}) r WHERE page % 16 IN ({', '.join(map(str, FAULTS))})")
def w7_rejected(d):
    """Every report with a fault, and the first thing wrong with it."""
    return stitch.rejected(report_lines(d))


# Declarations: a section for each line of a filing, with one entry or two; filings of some numbers have a fault.
_READ = [k for k, v in declarations.PRIMARY.items() if v]
XML_FAULTS = {3: "unknown_section:autreDto", 5: "malformed", 7: "no_general", 9: "nested_field", 11: "unreadable_year", 13: "no_name"}
_ENTRIES_SQL = f"""SELECT l.filing_id AS document, l.ordinal, k, CAST(l.filing_id AS BIGINT) AS n, ({_READ!r})[l.ordinal % {len(_READ)} + 1] AS section, l.asset_description_raw || ' & co' || CASE WHEN k = 1 THEN ' again' ELSE '' END AS name,
       l.currency, '00' || l.ordinal AS code, l.ordinal % 2 = 0 AS paid FROM line l, (VALUES (0), (1)) AS t(k) WHERE k = 0 OR l.ordinal % 3 = 0"""


def declaration_xml(d) -> DataFrame:
    """document and xml: the lines of each filing as a nested declaration."""
    n, ordinal = F.col("filing_id").cast("long"), F.col("ordinal")
    at = (ordinal % len(_READ)).cast("int")
    section = F.get(F.array(*map(F.lit, _READ)), at)
    field = F.get(F.array(*[F.lit(declarations.PRIMARY[k]) for k in _READ]), at)
    fault = lambda k: (n % 16 == k) & (ordinal == 1)
    tag = lambda name, text: F.concat(F.lit("<"), name, F.lit(">"), text, F.lit("</"), name, F.lit(">"))
    year = F.when(fault(11), "MMXX").otherwise("2020")
    pay = F.concat(F.lit("<remuneration><brutNet> Net </brutNet><montant><montant><annee>"), year, F.lit("</annee><montant>1  200</montant></montant><montant><annee>2021</annee><montant>"), ordinal.cast("string"), F.lit("</montant></montant></montant></remuneration>"))
    entry = lambda again: tag(F.lit("items"), F.concat(
        F.lit("<motif><id>"), "currency", F.lit("</id><label>x</label></motif><code>00"), ordinal.cast("string"), F.lit("</code><empty/>"), F.when(fault(13), "").otherwise(tag(field, F.concat(F.lit("  "), F.replace("asset_description_raw", F.lit(" "), F.lit("  ")), F.lit(" &amp; co"), F.lit(again)))),
        F.when(fault(9), "<inner><x>1</x></inner>").otherwise(""), F.when((ordinal % 2 == 0) | fault(11), pay).otherwise(""),
    ))
    both = F.concat(entry(""), F.when(ordinal % 3 == 0, entry(" again")).otherwise(""))
    xml = F.concat(tag(section, F.concat(tag(F.lit("items"), both), F.lit("<neant>false</neant>"))), F.when(fault(3), "<autreDto><neant>true</neant></autreDto>").otherwise("<observationInteretDto/>"))
    parts = d.line_by_filing().select("filing_id", "ordinal", xml.alias("xml")).groupBy(F.col("filing_id").alias("document")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "xml"))), lambda x: x.xml), "\n").alias("body"))
    of = F.col("document").cast("long") % 16
    general = F.when(of == 7, "").otherwise("<general><organe>o</organe></general>")
    return parts.select("document", F.concat(F.lit('<?xml version="1.0"?>\n<!-- made --><declaration>'), general, "body", F.when(of == 5, "").otherwise("</declaration>")).alias("xml"))


@query(
    "s10_sections",
    f"""SELECT document, row_number() OVER (PARTITION BY document ORDER BY ordinal, k) AS row, section, name, currency AS motif, code, CASE WHEN paid THEN 'Net' ELSE '' END AS gross_or_net,
               CASE WHEN paid THEN '2020:1 200,2021:' || ordinal END AS pays FROM ({_ENTRIES_SQL}) e WHERE n % 16 NOT IN ({', '.join(map(str, XML_FAULTS))})""",
)
def s10(d):
    """Entries of all declarations in document order."""
    out = declarations.sections(declaration_xml(d))
    pays = F.array_join(F.transform("pays", lambda p: F.concat_ws(":", p.year.cast("string"), p.amount)), ",")
    return out.select("document", "row", "section", "name", "motif", F.col("fields")["code"].alias("code"), "gross_or_net", pays.alias("pays"))


@query("s10_rejected", f"SELECT DISTINCT document, CASE n % 16 {' '.join(f'WHEN {k} THEN {v!r}' for k, v in XML_FAULTS.items())} END AS reason FROM ({_ENTRIES_SQL}) e WHERE n % 16 IN ({', '.join(map(str, XML_FAULTS))})")
def s10_rejected(d):
    """Declarations with a fault, and why they are rejected whole."""
    return declarations.rejected(declaration_xml(d))


# Archives: the lines of a thousand filings each, by state, in the headers of two eras; some archives have a fault.
_ARCHIVE_LINES = f"""SELECT CAST(l.filing_id AS BIGINT) // 1000 AS archive, ({list(archives.STATES)!r})[CAST(f.regime_id AS INTEGER) + 1] AS uf, l.filing_id, l.ordinal, l.asset_description_raw,
       l.low_cents, f.filed_date FROM line l JOIN filing f ON l.filing_id = f.id"""
ARCHIVE_FAULTS = {3: "width", 6: "columns"}


def _archive(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One archive of at most a thousand filings: a table for each state, one for all of them, and a note."""
    number, out = int(key[0]), io.BytesIO()
    header = [names[-1] if number % 2 else names[0] for names in archives.ASSETS.values()]
    if number % 8 == 6:
        header[7] = "DS_OUTRO"

    def table(part: pd.DataFrame, torn: bool) -> bytes:
        text = io.StringIO()
        lines = csv.writer(text, delimiter=";", quoting=csv.QUOTE_ALL if number % 3 else csv.QUOTE_MINIMAL)
        lines.writerow(header)
        for r in part.sort_values(["filing_id", "ordinal"]).itertuples():
            cells = [r.filing_id, r.uf, r.day, r.day[6:], str(r.ordinal), "12", "Imóvel", r.words, r.value, r.day, "12:00:00"]
            lines.writerow(cells[:-1] if torn else cells)
            torn = False
        return text.getvalue().encode("latin-1")

    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
        made.writestr("leiame.pdf", b"%PDF-")
        made.writestr("bem_candidato_BRASIL.csv", table(rows, False))
        for k, (uf, part) in enumerate(rows.groupby("uf")):
            made.writestr(f"bem_candidato_{uf}.csv", table(part, k == 0 and number % 8 == 3))
    return pd.DataFrame({"path": [str(number)], "content": [out.getvalue()]})


def asset_archives(d) -> DataFrame:
    """path and content of archives of declared assets."""
    lines = d.line.join(d.filing.select(F.col("id").alias("filing_id"), "regime_id", "filed_date"), "filing_id")
    cents = F.col("low_cents")
    value = F.coalesce(F.concat(F.expr("low_cents div 100").cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0")), F.lit(""))
    words = F.concat(F.lit('ação "'), "asset_description_raw", F.lit('"; lote\n'), F.col("ordinal").cast("string"))
    rows = lines.select(
        F.floor(F.col("filing_id").cast("long") / 1000).cast("long").alias("archive"), F.get(F.array(*map(F.lit, archives.STATES)), F.col("regime_id").cast("int")).alias("uf"),
        "filing_id", "ordinal", words.alias("words"), value.alias("value"), F.date_format("filed_date", "dd/MM/yyyy").alias("day"),
    )
    return rows.groupBy("archive").applyInPandas(_archive, "path string, content binary")


@query(
    "s12_archives",
    f"""SELECT archive, uf, filing_id AS candidate, CAST(ordinal AS INTEGER) AS ordinal, 'ação "' || asset_description_raw || '"; lote' || chr(10) || ordinal AS description, low_cents AS cents, filed_date AS elected
        FROM ({_ARCHIVE_LINES}) q WHERE archive % 8 NOT IN ({', '.join(map(str, ARCHIVE_FAULTS))})""",
)
def s12(d):
    """Declared assets of the states' tables, in the headers of both eras; archives with a fault are left out whole."""
    rows = archives.sound(archives.declared_assets(asset_archives(d)))
    cents = (S.comma_decimal(F.col("VR_BEM_CANDIDATO")) * 100).cast("long")
    return rows.select(
        F.col("path").cast("long").alias("archive"), F.col("SG_UF").alias("uf"), F.col("SQ_CANDIDATO").alias("candidate"), F.col("NR_ORDEM_BEM_CANDIDATO").cast("int").alias("ordinal"),
        F.col("DS_BEM_CANDIDATO").alias("description"), cents.alias("cents"), S.day_first_date(F.col("DT_ELEICAO")).alias("elected"),
    )


@query(
    "s12_rejected",
    f"""SELECT archive, fault, count(*) AS n FROM (SELECT archive, uf, filing_id, ordinal, CASE archive % 8 {' '.join(f'WHEN {k} THEN {v!r}' for k, v in ARCHIVE_FAULTS.items())} END AS fault,
               row_number() OVER (PARTITION BY archive ORDER BY uf, filing_id, ordinal) AS r FROM ({_ARCHIVE_LINES}) q) w WHERE fault = 'columns' OR fault = 'width' AND r = 1 GROUP BY 1, 2""",
)
def s12_rejected(d):
    """Archives with a fault, and how many of their rows have it."""
    rows = archives.declared_assets(asset_archives(d)).where("fault is not null")
    return rows.groupBy(F.col("path").cast("long").alias("archive"), "fault").agg(F.count("*").alias("n"))


# Report pages: the transactions of a filing as rows of a page; pages of some numbers have a fault.
_SEC_OWNERS, _SEC_SIDES = ("Self", "Spouse", "Child", "Joint"), ("Purchase", "Sale (Full)", "Sale (Partial)", "Exchange")
PAGE_FAULTS = {2: "title", 4: "row 1: band", 6: "count", 8: "sequence", 10: "owners", 12: "row 1: width"}
_PAGE_ROWS = """SELECT filing_id AS page, CAST(filing_id AS BIGINT) AS n, row_number() OVER (PARTITION BY filing_id ORDER BY ordinal) AS row, ordinal, asset_description_raw, low_cents, transaction_date
       FROM line WHERE record_type = 'transaction'"""


def report_pages(d) -> DataFrame:
    """sha256 (the filing) and text: each filing's transactions on a page of its own."""
    rows = d.line.where("record_type = 'transaction'").groupBy("filing_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "asset_description_raw", "low_cents", "transaction_date"))).alias("rows"))
    n = F.col("filing_id").cast("long")
    fault = lambda k: n % 16 == k
    pick = lambda words, at: F.get(F.array(*map(F.lit, words)), at.cast("int"))
    td = lambda *cells: F.concat(*[F.concat(F.lit("<td> "), c, F.lit("\n</td>")) for c in cells])

    def line(r, k):
        number = F.size("rows") - k + F.when(fault(8), 1).otherwise(0)
        ticker = F.when(r.ordinal % 3 == 0, F.concat(F.lit('<a href="?q=1">T'), r.ordinal.cast("string"), F.lit("</a>"))).otherwise("--")
        note = F.when(r.ordinal % 4 == 1, F.lit('<div class="small text-muted">Rate/Coupon:\n 5%</div>')).otherwise("")
        band = F.when(fault(4), F.lit("$1 - $2")).when(r.low_cents.isNull(), "Over $50,000,000").otherwise("$1,001 - $15,000")
        cells = [number.cast("string"), F.date_format(r.transaction_date, "MM/dd/yyyy"), pick(_SEC_OWNERS, r.ordinal % 4), ticker, F.concat(F.replace(r.asset_description_raw, F.lit(" "), F.lit(" &amp; ")), note), pick(("Stock", "Corporate Bond", "Other"), r.ordinal % 3), pick(_SEC_SIDES, r.ordinal % 4)]
        return F.concat(F.lit("<tr>"), td(*cells, band), F.when(fault(12), "").otherwise(td(F.lit("--"))), F.lit("</tr>"))

    body = F.array_join(F.transform("rows", line), "")
    total = F.size("rows") + F.when(fault(6), 1).otherwise(0)
    owners = F.transform("rows", lambda r: (r.ordinal % 4).cast("int"))
    said = lambda k, label: F.concat(F.lit("<li>"), (F.size(owners) - F.size(F.array_remove(owners, k)) + F.when(fault(10), 1).otherwise(0)).cast("string"), F.lit(f" {label}</li>"))
    summary = F.concat(F.lit("<li>("), total.cast("string"), F.when(total == 1, " transaction").otherwise(" transactions"), F.lit(" total)</li>"), said(0, "Self"), said(3, "Joint"), said(1, "Spouse"), said(2, "Dependent Child"))
    title = F.when(fault(2), "Annual Report").otherwise(F.concat(F.lit("Periodic Transaction Report for 03/09/2024"), F.when(n % 3 == 0, " (Amendment 2)").otherwise("")))
    text = F.concat(F.lit("<html><h1 class='mb-2'>"), title, F.lit("</h1><h2 class='filedReport'>A (B, C)</h2><p class='muted'><strong>Filed 03/09/2024 @ 1:23 PM</strong></p><section class='card'><ul>"), summary, F.lit('</ul></section><table class="table x"><thead><tr><th>#</th></tr></thead><tbody>'), body, F.lit("</tbody></table></html>"))
    return rows.select(F.col("filing_id").alias("sha256"), text.alias("text"))


@query(
    "s7_report_pages",
    f"""SELECT page, row, count(*) OVER (PARTITION BY page) - row + 1 AS printed, (['buy', 'sell', 'sell', 'exchange'])[ordinal % 4 + 1] AS side, (['self', 'spouse', 'dependent', 'joint'])[ordinal % 4 + 1] AS owner,
               replace(asset_description_raw, ' ', ' & ') AS asset, (['equity', 'bond', 'other'])[ordinal % 3 + 1] AS class, transaction_date AS traded, CASE WHEN low_cents IS NULL THEN 5000000000 ELSE 100100 END AS low_cents,
               CASE WHEN low_cents IS NOT NULL THEN 1500000 END AS high_cents, CASE WHEN ordinal % 3 = 0 THEN 'T' || ordinal END AS ticker, CASE WHEN ordinal % 4 = 1 THEN 'Rate/Coupon: 5%' END AS detail, CASE WHEN n % 3 = 0 THEN 2 END AS amendment,
               ordinal % 4 = 2 AS partial, CAST(100 - CASE WHEN ordinal % 3 = 2 THEN 5 ELSE 0 END - CASE WHEN ordinal % 4 = 1 THEN 2 ELSE 0 END AS INTEGER) AS confidence
        FROM ({_PAGE_ROWS}) r WHERE n % 16 NOT IN ({', '.join(map(str, PAGE_FAULTS))})""",
)
def s7(d):
    """Gold rows of all report pages; pages with a fault give none."""
    rows = ADAPTERS["us_senate"].normalize(ADAPTERS["us_senate"].parse(report_pages(d)))
    part = lambda name, kind: F.from_json("details", f"{name} {kind}")[name]
    return rows.select(
        F.col("sha256").alias("page"), F.col("row_ordinal").cast("long").alias("row"), part("row_number", "string").cast("long").alias("printed"), "side", "owner", F.col("asset_description_raw").alias("asset"), F.col("asset_class").alias("class"), F.col("transaction_date").alias("traded"),
        "low_cents", "high_cents", part("ticker", "string").alias("ticker"), part("asset_detail", "string").alias("detail"), part("amendment_number", "int").alias("amendment"), part("partial_sale", "boolean").alias("partial"), F.round(F.col("extraction_confidence") * 100).cast("int").alias("confidence"),
    )


@query("s7_rejected", f"SELECT DISTINCT page, CASE n % 16 {' '.join(f'WHEN {k} THEN {v!r}' for k, v in PAGE_FAULTS.items())} END AS reason FROM ({_PAGE_ROWS}) r WHERE n % 16 IN ({', '.join(map(str, PAGE_FAULTS))})")
def s7_rejected(d):
    """Report pages with a fault, and why they are rejected whole."""
    return senate.rejected(report_pages(d)).select(F.col("sha256").alias("page"), "reason")


# Conformance: declarations of each filing's holdings against the rows expected of them, of which some are wrong.
_HOLDINGS = "SELECT filing_id, ordinal, CAST(filing_id AS BIGINT) + ordinal AS n, row_number() OVER (PARTITION BY filing_id ORDER BY ordinal) - 1 AS position FROM line WHERE record_type = 'holding'"


def _holdings(d) -> DataFrame:
    rows = d.line.where("record_type = 'holding'")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("filing_id").orderBy("ordinal")) - 1).withColumn("n", F.col("filing_id").cast("long") + F.col("ordinal"))


@query(
    "x1_conformance",
    f"""SELECT filing_id AS "case", 'silver' AS stage, position, CASE WHEN n % 11 = 3 THEN 'unexpected' WHEN n % 11 = 5 THEN 'missing' ELSE 'differs' END AS problem, CASE n % 11 WHEN 7 THEN '$.asset_description_raw' WHEN 9 THEN '$.asset_type_code_raw $.value_raw' ELSE '' END AS paths
        FROM ({_HOLDINGS}) h WHERE n % 11 IN (3, 5, 7, 9)
        UNION ALL SELECT filing_id, 'silver', NULL, 'zero_rows', '' FROM ({_HOLDINGS}) h GROUP BY filing_id HAVING bool_and(n % 11 = 5)""",
)
def x1(d):
    """Where an adapter's rows are not as expected, with the paths that differ."""
    held = _holdings(d)
    words = F.concat(F.lit("Casa "), "asset_description_raw")
    asset = F.struct(F.col("ordinal").cast("string").alias("NR_ORDEM_BEM_CANDIDATO"), F.lit("12").alias("CD_TIPO_BEM_CANDIDATO"), F.lit("Casa").alias("DS_TIPO_BEM_CANDIDATO"), words.alias("DS_BEM_CANDIDATO"), F.lit("1.000,50").alias("VR_BEM_CANDIDATO"), F.lit("02/10/2022").alias("DT_ULT_ATUAL_BEM_CANDIDATO"), F.lit("12:00:00").alias("HH_ULT_ATUAL_BEM_CANDIDATO"))
    who = F.struct(F.col("filing_id").alias("SQ_CANDIDATO"), F.lit("N").alias("NM_CANDIDATO"), F.lit("AC").alias("SG_UF"), F.lit("02/10/2022").alias("DT_ELEICAO"), F.lit("2022").alias("ANO_ELEICAO"))
    # a document has no row where one is missing; positions of those behind it are then its own
    bronze = held.groupBy("filing_id").agg(F.array_sort(F.collect_list(F.struct("position", asset.alias("asset"), (F.col("n") % 11 == 5).alias("gone")))).alias("rows"))
    bronze = bronze.select(F.col("filing_id").alias("sha256"), F.to_json(F.struct(who.alias("consulta_cand"), F.transform("rows", lambda r: F.when(~r.gone, r.asset)).alias("bem_candidato")), {"ignoreNullFields": "false"}).alias("text"))
    adapter = ADAPTERS["br"]
    got = adapter.parse(bronze).where("asset_description_raw IS NOT NULL")
    n = F.col("n") % 11
    wrong = {"asset_description_raw": F.when(n == 7, F.lit("?")).otherwise(words), "asset_type_code_raw": F.when(n == 9, F.lit("13")).otherwise("12"), "value_raw": F.when(n == 9, F.lit(None)).otherwise("1.000,50")}
    given = {"sha256": F.col("filing_id"), "position": F.col("position"), "sq_candidato": F.col("filing_id"), "nm_candidato": F.lit("N"), "sg_uf": F.lit("AC"), "dt_eleicao_raw": F.lit("02/10/2022"), "election_year_raw": F.lit("2022"), "line_item_ordinal_raw": F.col("ordinal").cast("string"), "asset_type_label_raw": F.lit("Casa"), "last_updated_date_raw": F.lit("02/10/2022"), "last_updated_time_raw": F.lit("12:00:00")}
    expected = held.where(n != 3).select(*[({**given, **wrong})[f.name].cast(f.dataType).alias(f.name) for f in got.schema])
    report = conformance.differences(got, expected, "sha256", "position", "silver").unionByName(conformance.empty_cases(got, expected, "sha256"))
    return report.select("case", "stage", "position", "problem", F.array_join("paths", " ").alias("paths"))
