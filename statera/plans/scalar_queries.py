"""Scalar functions and document scans over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources import scans
from .catalog import query


@query("f1_fingerprint", "SELECT id, sha256(encode(filing_id) || unhex('00') || unhex(lpad(hex(ordinal), 8, '0')) || unhex('00') || encode(asset_description_raw)) AS fingerprint FROM line")
def f1(d):
    return d.line.select("id", S.fingerprint(F.col("filing_id"), F.col("ordinal"), F.col("asset_description_raw")).alias("fingerprint"))


@query("f2_canonical_json", "SELECT id, concat('{\"a\":', json_extract_string(stats, '$.k'), ',\"z\":[1,\"', stage, '\"]}') AS canonical FROM pipeline_run WHERE status = 'failed'")
def f2(d):
    raw = F.concat(F.lit('{ "z": [1, "'), F.col("stage"), F.lit('"], "a" : '), F.get_json_object("stats", "$.k"), F.lit("}"))
    return d.pipeline_run.where("status = 'failed'").select("id", S.canonical_json(raw).alias("canonical"))


@query("f5_hashes", "SELECT id, sha256(url) AS url_hash FROM raw_document")
def f5(d):
    return d.raw_document.select("id", F.sha2("url", 256).alias("url_hash"))


@query(
    "f6_skeleton",
    r"""SELECT id, array_to_string(list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(body, '<([A-Za-z][A-Za-z0-9-]*)', 1), lambda t: 't:' || t),
          list_transform(list_filter(flatten(list_transform(regexp_extract_all(body, 'class="([^"]*)"', 1), lambda c: regexp_split_to_array(c, '\s+'))), lambda c: c <> ''), lambda c: 'c:' || c)))), ';') AS skeleton FROM raw_document""",
)
def f6(d):
    return d.raw_document.select("id", S.skeleton(F.col("body")).alias("skeleton"))


@query("f7_count_substring", "SELECT id, CAST((length(body) - length(replace(body, '<p>', ''))) // 3 AS BIGINT) AS n FROM raw_document")
def f7(d):
    return d.raw_document.select("id", S.occurrences(F.col("body"), "<p>").alias("n"))


@query("f8_coalesce", "SELECT id, coalesce(nullif(identifier, '7'), concat('t', id)) AS identifier FROM politician")
def f8(d):
    return d.politician.select("id", F.coalesce(F.nullif("identifier", F.lit("7")), F.concat(F.lit("t"), "id")).alias("identifier"))


@query("f9_split_part", "SELECT id, split_part(url, '://', 1) AS scheme, CAST(position('/' IN url) AS INTEGER) AS slash FROM raw_document")
def f9(d):
    return d.raw_document.select("id", F.split_part("url", F.lit("://"), F.lit(1)).alias("scheme"), F.position(F.lit("/"), "url").alias("slash"))


@query("f10_epoch", "SELECT id, (epoch_us(started_at) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000000.0::DOUBLE AS seconds FROM pipeline_run WHERE status = 'failed'")
def f10(d):
    micros = F.unix_micros(F.col("started_at").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return d.pipeline_run.where("status = 'failed'").select("id", (micros / 1e6).alias("seconds"))


@query("f11_month_text", "SELECT id, strftime(filed_date, '%Y-%m') AS month FROM filing")
def f11(d):
    return d.filing.select("id", F.date_format("filed_date", "yyyy-MM").alias("month"))


_BAND_ROWS = ", ".join(f"({k}, '{b}', {lo}, {'NULL' if hi is None else hi})" for k, (b, lo, hi) in enumerate(S.BANDS))


@query("f14_bands", f"SELECT l.id, v.low, v.high FROM line l LEFT JOIN (VALUES {_BAND_ROWS}) AS v(k, band, low, high) ON v.k = l.ordinal % 11")
def f14(d):
    bands = S.band_table(d.line.sparkSession)
    name = F.get(F.array(*[F.lit(b) for b, _, _ in S.BANDS]), F.col("ordinal") % 11)
    return d.line.select("id", name.alias("band")).join(bands, "band", "left").select("id", F.col("low_cents").alias("low"), F.col("high_cents").alias("high"))


@query("f15_midpoint", "SELECT id, CAST((low_cents + high_cents) / 2 AS DECIMAL(20,1)) AS middle FROM line")
def f15(d):
    return d.line.select("id", S.midpoint(F.col("low_cents"), F.col("high_cents")).alias("middle"))


@query(
    "f16_format",
    """SELECT id, CASE WHEN low_cents IS NULL THEN NULL WHEN high_cents IS NULL THEN m(currency, low_cents) || ' or more' WHEN low_cents = high_cents THEN m(currency, low_cents)
         ELSE m(currency, low_cents) || ' – ' || m(currency, high_cents) END AS value FROM line""".replace("m(currency, low_cents)", "(currency || ' ' || format('{:,.2f}', low_cents / 100.0))").replace("m(currency, high_cents)", "(currency || ' ' || format('{:,.2f}', high_cents / 100.0))"),
)
def f16(d):
    return d.line.select("id", S.value_text(F.col("low_cents"), F.col("high_cents"), F.col("currency")).alias("value"))


@query(
    "f17_dates",
    """SELECT id, CAST(try_strptime(strftime(filed_date, '%m/%d/%Y'), '%m/%d/%Y') AS DATE) AS us, filed_date AS day_first,
              CASE WHEN year(filed_date) >= 2000 THEN filed_date ELSE CAST(filed_date + INTERVAL 100 YEAR AS DATE) END AS short FROM filing WHERE NOT (month(filed_date) = 2 AND day(filed_date) = 29)""",
)
def f17(d):
    f = d.filing.where("NOT (month(filed_date) = 2 AND day(filed_date) = 29)")
    text = lambda form: F.date_format("filed_date", form)
    return f.select("id", S.us_date(text("MM/dd/yyyy")).alias("us"), S.day_first_date(text("d/M/yyyy")).alias("day_first"), S.short_year_date(text("d/M/yy")).alias("short"))


@query("f18_decimals", "SELECT id, CAST(low_cents / 100.0 AS DECIMAL(16,2)) AS value FROM line WHERE low_cents IS NOT NULL")
def f18(d):
    cents = F.col("low_cents")
    raw = F.concat(F.replace(F.format_number((cents / 100).cast("long"), 0), F.lit(","), F.lit(".")), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    return d.line.where("low_cents IS NOT NULL").select("id", S.comma_decimal(raw).alias("value"))


@query("f19_currency", "SELECT id, CASE WHEN ordinal % 3 = 0 THEN currency END AS currency FROM line")
def f19(d):
    raw = F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit("1.000 "), "currency")).when(F.col("ordinal") % 3 == 1, F.concat(F.lit("1.000 X"), "currency")).otherwise(F.lower(F.concat(F.lit("5 "), "currency")))
    return d.line.select("id", S.currency_token(raw).alias("currency"))


@query("f20_cadence", "SELECT id, CASE ordinal % 5 WHEN 0 THEN 'monthly' WHEN 1 THEN 'annual' WHEN 2 THEN 'other' WHEN 3 THEN NULL ELSE 'one_off' END AS cadence FROM line")
def f20(d):
    raw = F.get(F.array(*map(F.lit, (" Mensuel", "JÄHRLICH", "sometimes", "  ", "einmalig "))), F.col("ordinal") % 5)
    return d.line.select("id", S.cadence(raw).alias("cadence"))


@query("f22_code_maps", "SELECT id, CASE ordinal % 4 WHEN 0 THEN 'equity' WHEN 1 THEN 'fund' WHEN 2 THEN 'real_estate' ELSE 'other' END AS class, ordinal % 4 = 3 AS unknown_code, CASE ordinal % 3 WHEN 0 THEN 'spouse' WHEN 1 THEN 'joint' END AS owner FROM line")
def f22(d):
    code = F.get(F.array(*map(F.lit, ("ST", "5P", "RP", "??"))), F.col("ordinal") % 4)
    owner = F.get(F.array(*map(F.lit, ("SP", "JT", "ZZ"))), F.col("ordinal") % 3)
    return d.line.select("id", F.coalesce(S.asset_class(code), F.lit("other")).alias("class"), S.asset_class(code).isNull().alias("unknown_code"), S.mapped(owner, S.OWNER_CODES).alias("owner"))


@query("f25_confidence", "SELECT id, CAST(greatest(least(CASE WHEN low_cents IS NULL THEN (CASE WHEN owner IS NULL THEN 1.0::FLOAT - 0.1::FLOAT ELSE 1.0::FLOAT END) - 0.05::FLOAT ELSE (CASE WHEN owner IS NULL THEN 1.0::FLOAT - 0.1::FLOAT ELSE 1.0::FLOAT END) END, 1.0::FLOAT), 0.0::FLOAT) AS DOUBLE) AS confidence FROM line")
def f25(d):
    return d.line.select("id", S.confidence((F.col("owner").isNull(), 0.1), (F.col("low_cents").isNull(), 0.05)).cast("double").alias("confidence"))


@query("f26_title", "SELECT id, filed_date AS report_date, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN CAST(CAST(id AS BIGINT) % 5 AS INTEGER) END AS amendment FROM filing")
def f26(d):
    number = F.col("id").cast("long")
    suffix = F.when(number % 2 == 0, F.concat(F.lit(" (Amendment "), (number % 5).cast("string"), F.lit(")"))).otherwise("")
    date, amendment = S.report_title(F.concat(F.lit("Periodic Transaction Report for "), F.date_format("filed_date", "MM/dd/yyyy"), suffix))
    return d.filing.select("id", date.alias("report_date"), amendment.alias("amendment"))


@query("f29_collapse", r"SELECT id, trim(regexp_replace(replace(canonical_name, '#', '  # '), '\s+', ' ', 'g')) AS name FROM politician")
def f29(d):
    return d.politician.select("id", S.collapsed(F.replace("canonical_name", F.lit("#"), F.lit("  # "))).alias("name"))


@query("f30_ulid", "SELECT id, regexp_matches('01ARZ3NDEKTSV4RRFFQ6' || substr(id, 5, 6), '^[0-7][0-9A-HJKMNP-TV-Z]{25}$') AS valid, regexp_matches('81ARZ3NDEKTSV4RRFFQ6' || substr(id, 5, 6), '^[0-7][0-9A-HJKMNP-TV-Z]{25}$') AS invalid FROM filing")
def f30(d):
    tail = F.substring("id", 5, 6)
    return d.filing.select("id", F.concat(F.lit("01ARZ3NDEKTSV4RRFFQ6"), tail).rlike(S.ULID).alias("valid"), F.concat(F.lit("81ARZ3NDEKTSV4RRFFQ6"), tail).rlike(S.ULID).alias("invalid"))


@query("f33_watchlist", "SELECT l.filing_id, bool_or(coalesce(low_cents >= 8000000, TRUE)) OR bool_or(coalesce(CAST(f.politician_id AS BIGINT) % 10 = 3, FALSE)) AS high FROM line l JOIN filing f ON l.filing_id = f.id GROUP BY 1")
def f33_watchlist(d):
    """Filings with a high or unknown value, or of a filer on the watchlist."""
    watched = d.politician.where("cast(id AS bigint) % 10 = 3").select(F.col("id").alias("politician_id"), F.lit(True).alias("watched"))
    filer = d.filing.select(F.col("id").alias("filing_id"), "politician_id").join(watched, "politician_id", "left")
    return d.line.select("filing_id", "low_cents").join(filer, "filing_id").groupBy("filing_id").agg(S.high_impact(F.col("low_cents"), 8000000, F.col("watched")).alias("high"))


_MARKED = r"regexp_replace(body, '&(amp|lt|gt|quot|apos);', chr(1) || '\1;', 'g')"
_ENTITIES = f"replace(replace(replace(replace(replace({_MARKED}, chr(1) || 'lt;', '<'), chr(1) || 'gt;', '>'), chr(1) || 'quot;', chr(34)), chr(1) || 'apos;', chr(39)), chr(1) || 'amp;', '&')"


@query("f29_entities", f"SELECT id, sha256({_ENTITIES}) AS digest, len({_ENTITIES}) AS n FROM (SELECT id, replace(replace(body, '&', '&amp;'), '<', '&lt;') || ' &quot;' || id || '&apos; &gt;&amp;lt; &bogus; &' AS body FROM raw_document) q")
def f29_entities(d):
    """Escaped pages decoded once: what was escaped twice stays escaped once."""
    body = F.concat(F.replace(F.replace("body", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(" &quot;"), "id", F.lit("&apos; &gt;&amp;lt; &bogus; &"))
    text = d.raw_document.select("id", S.unescaped(body).alias("text"))
    return text.select("id", F.sha2("text", 256).alias("digest"), F.char_length("text").cast("long").alias("n"))


@query("f33_high_impact", "SELECT filing_id, bool_or(coalesce(low_cents >= 8000000, TRUE)) AS high FROM line GROUP BY 1")
def f33(d):
    return d.line.groupBy("filing_id").agg(S.high_impact(F.col("low_cents"), 8_000_000).alias("high"))


@query("s3_mime", "SELECT id, CASE WHEN starts_with(b, '%PDF-') THEN 'application/pdf' WHEN starts_with(b, '<!DOCTYPE') OR starts_with(b, '<!doctype') OR starts_with(b, '<html') OR starts_with(b, '<HTML') THEN 'text/html' WHEN left(b, 1) IN ('{', '[') THEN 'application/json' ELSE 'application/octet-stream' END AS mime FROM (SELECT id, regexp_replace(body, '^[\\t\\n\\f\\r ]+', '') AS b FROM raw_document)")
def s3(d):
    return d.raw_document.select("id", S.mime(F.col("body")).alias("mime"))


@query("r22_mime_diff", "SELECT doc_id, 'application/octet-stream' AS mime FROM documents WHERE NOT regexp_matches(text, '^[\\t\\n\\f\\r ]*[\\{\\[]') AND doc_id % 4 = 0")
def r22(d):
    stored = F.when(F.col("doc_id") % 4 == 0, "text/plain").otherwise(S.mime(F.col("text")))
    rows = d.documents.select("doc_id", stored.alias("stored"), S.mime(F.col("text")).alias("mime"))
    return rows.where("stored <> mime AND mime = 'application/octet-stream'").select("doc_id", "mime")


@query(
    "s13_hrefs",
    """SELECT id, stem, arg_min(href, pos) AS href FROM (
         SELECT id, h AS href, pos, regexp_extract(regexp_extract(h, '^[^?#]*'), '([^/]+)e$', 1) AS stem FROM (
           SELECT id, unnest(hs) AS h, generate_subscripts(hs, 1) AS pos FROM (SELECT id, regexp_extract_all(body, 'href="([^"]*)"', 1) AS hs FROM raw_document)) WHERE contains(h, '/'))
       WHERE stem <> '' GROUP BY id, stem""",
)
def s13(d):
    return scans.document_links(d.raw_document, "id", "body", "/", "e").select("id", "stem", "href")


@query("s18_source_sniff", "SELECT id, CASE WHEN starts_with(left(body, 8192), '%PDF-') THEN 'eu' WHEN contains(left(body, 8192), '<declaration') THEN 'fr' WHEN contains(lower(left(body, 8192)), '<html') THEN 'de' END AS source FROM raw_document")
def s18(d):
    return d.raw_document.select("id", S.source_of(F.col("body")).alias("source"))


@query("s19_cache_lookup", "SELECT x.id AS sha256, 't' AS tag, 'm' AS model, coalesce(CASE WHEN CAST(id AS INTEGER) % 3 = 0 THEN 'file' END, CASE WHEN CAST(id AS INTEGER) % 2 = 0 THEN 'table' END) AS rows, CAST(id AS INTEGER) % 3 <> 0 AND CAST(id AS INTEGER) % 2 <> 0 AS missing FROM raw_document x")
def s19(d):
    key = lambda df: df.select(F.col("id").alias("sha256"), F.lit("t").alias("tag"), F.lit("m").alias("model"))
    n = F.col("id").cast("int")
    files = key(d.raw_document.where(n % 3 == 0)).withColumn("rows", F.lit("file"))
    table = key(d.raw_document.where(n % 2 == 0)).withColumn("rows", F.lit("table"))
    return scans.cached_rows(key(d.raw_document), files, table)


@query("f13_json_path", "SELECT id, json_extract_string(stats, '$.k') AS k, json_extract_string(stats, '$.none') IS NOT NULL AS has_none FROM pipeline_run WHERE stage = 'publish'")
def f13(d):
    return d.pipeline_run.where("stage = 'publish'").select("id", F.get_json_object("stats", "$.k").alias("k"), F.get_json_object("stats", "$.none").isNotNull().alias("has_none"))


LINES = [
    ("Rat, monatlich, 1.250,43 EUR", "Rat", "monatlich, 1.250,43 EUR", "monthly", None, "1250.43"),
    ("Rat, Ort, 2021, 5.400 Euro", "Rat, Ort, 2021, 5.400 Euro", None, None, None, None),
    ("jährlich, 900 EUR, zuzüglich 10 EUR", "", "jährlich, 900 EUR, zuzüglich 10 EUR", "annual", None, "900.00"),
    ("zuzüglich 5 EUR", "", "zuzüglich 5 EUR", None, None, "5.00"),
    ("Rat, halbjährlich, ohne Angabe", "Rat", "halbjährlich, ohne Angabe", None, None, None),
    ("Vorstand ,  einmalig, 12..5 EUR", "Vorstand ,  einmalig, 12..5 EUR", None, None, None, None),
    ("Beirat, einmalig, 7.000,5 EUR, jährlich, 3 EUR", "Beirat", "einmalig, 7.000,5 EUR, jährlich, 3 EUR", "one_off", None, "7000.50"),
]


@query(
    "f21_cadence_split",
    "SELECT l.id, v.role, v.income, v.period, CAST(v.amount AS DECIMAL(16,2)) AS amount FROM line l JOIN (VALUES "
    + ", ".join("(" + ", ".join([str(k), *("NULL" if x is None else f"'{x}'" for x in (r[1], r[2], r[3], r[5]))]) + ")" for k, r in enumerate(LINES))
    + f") AS v(k, role, income, period, amount) ON v.k = l.ordinal % {len(LINES)}",
)
def f21(d):
    text = F.get(F.array(*[F.lit(r[0]) for r in LINES]), F.col("ordinal") % len(LINES))
    found = d.line.select("id", S.income_split(text).alias("s")).select("id", "s.*").withColumn("p", S.income_parts(F.col("income")))
    return found.select("id", "role", "income", "p.period", "p.amount")


DATES = [
    ("05/06/2026", "2026-05-06", "2026-06-05", None), ("2026 MAY -6", "2026-05-06", None, None), ("2026 MAY 16", "2026-05-16", None, None), ("2026 FEB 30", None, None, None),
    ("2026 MAI 6", None, None, None), ("13/02/2024 10:11:12", None, "2024-02-13", None), ("02/30/2024", None, None, None), ("Date of change: 2024/03/09 (late)", None, None, "2024-03-09"),
    ("Date of change: none", None, None, None), ("", None, None, None), ("7/4/2021", "2021-07-04", "2021-04-07", None),
]


@query(
    "f17_source_dates",
    "SELECT l.id, CAST(v.a AS DATE) AS source_date, CAST(v.b AS DATE) AS stamped_day, CAST(v.c AS DATE) AS change_date FROM line l JOIN (VALUES "
    + ", ".join("(" + ", ".join([str(k), *("NULL" if x is None else f"'{x}'" for x in r[1:])]) + ")" for k, r in enumerate(DATES))
    + f") AS v(k, a, b, c) ON v.k = l.ordinal % {len(DATES)}",
)
def f17_source(d):
    """Written dates, malformed ones among them, by every parser of the sources."""
    raw = F.get(F.array(*[F.lit(r[0]) for r in DATES]), F.col("ordinal") % len(DATES))
    return d.line.select("id", S.source_date(raw).alias("source_date"), S.stamped_day(raw).alias("stamped_day"), S.change_date(raw).alias("change_date"))


@query(
    "f31_display",
    """SELECT id, coalesce(CAST(CAST(round(CAST(CASE WHEN CAST(id AS BIGINT) % 7 <> 0 THEN CAST(id AS BIGINT) * 977 END AS DECIMAL(20,3)) / 86400, 1) AS DECIMAL(20,1)) AS VARCHAR) || 'd', '—') AS took,
              CASE WHEN m < 60 THEN m || 'm' WHEN m // 60 < 48 THEN (m // 60) || 'h' ELSE (m // 1440) || 'd' END AS age, format('{:,}', CAST(id AS BIGINT) * 1234) AS n,
              strftime(started_at, '%Y-%m-%d %H:%M UTC') AS at FROM (SELECT *, greatest(epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(started_at), 0) // 60000000 AS m FROM pipeline_run)""",
)
def f31(d):
    n = F.col("id").cast("long")
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    at = F.col("started_at").cast("timestamp")
    return d.pipeline_run.select("id", S.days_text(F.when(n % 7 != 0, n * 977)).alias("took"), S.age_text(at, now).alias("age"), S.count_text(n * 1234).alias("n"), S.minute_text(at).alias("at"))


@query("f12_interval", "SELECT count(*) FILTER (WHERE started_at >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 36 HOUR) AS recent, count(*) FILTER (WHERE started_at < TIMESTAMP '2024-02-29 00:00:00' - INTERVAL 1 MONTH) AS old FROM pipeline_run")
def f12(d):
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    c = F.col("started_at")
    return d.pipeline_run.agg(F.count_if(c >= S.before(at("2024-01-20 00:00:00"), hours=36)).alias("recent"), F.count_if(c < S.before(at("2024-02-29 00:00:00"), months=1)).alias("old"))


@query("f23_owner_precedence", "SELECT id, coalesce(owner, CASE WHEN ordinal % 2 = 0 THEN 'joint' END, 'self') AS owner, CASE WHEN owner IS NOT NULL THEN 'row' WHEN ordinal % 2 = 0 THEN 'vehicle' ELSE 'default' END AS origin FROM line")
def f23(d):
    owner, origin = S.owner_of(F.col("owner"), F.when(F.col("ordinal") % 2 == 0, "joint"))
    return d.line.select("id", owner.alias("owner"), origin.alias("origin"))


@query("f27_row_anchor", "SELECT id, 'S' AS side, strftime(filed_date, '%m/%d/%Y') AS traded, '$1,001 - $15,000' AS band FROM filing WHERE status = 'P'")
def f27(d):
    day = F.date_format("filed_date", "MM/dd/yyyy")
    found = S.row_anchor(F.concat(F.lit("Acme Corp (ACM) [ST] S (partial) "), day, F.lit(" "), day, F.lit(" $1,001 - $15,000")))
    return d.filing.where("status = 'P'").select("id", found["side"].alias("side"), found["traded"].alias("traded"), found["band"].alias("band"))


@query("f28_date_range", "SELECT id, filed_date AS first_day, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN filed_date WHEN CAST(id AS BIGINT) % 3 = 1 THEN CAST(filed_date + INTERVAL 9 DAY AS DATE) END AS last_day FROM filing")
def f28(d):
    day = lambda c: F.date_format(c, "yyyy/MM/dd")
    n = F.col("id").cast("long") % 3
    first, last = S.date_range(F.when(n == 0, day("filed_date")).when(n == 1, F.concat(day("filed_date"), F.lit(" – "), day(F.date_add("filed_date", 9)))).otherwise(F.concat(day("filed_date"), F.lit(" — later"))))
    return d.filing.select("id", first.alias("first_day"), last.alias("last_day"))


@query("f32_band_parser", "SELECT id, CASE WHEN low_cents <= high_cents AND ordinal % 4 <> 0 THEN low_cents END AS low, CASE WHEN low_cents <= high_cents AND ordinal % 4 <> 0 THEN high_cents END AS high FROM line WHERE low_cents IS NOT NULL AND high_cents IS NOT NULL")
def f32(d):
    money = lambda c: F.concat(F.lit("$"), F.format_number((F.col(c) / 100).cast("decimal(16,2)"), 2))
    raw = F.when(F.col("ordinal") % 4 == 0, F.concat(money("low_cents"), F.lit(" to "), money("high_cents"))).otherwise(F.concat(money("low_cents"), F.lit(" - "), money("high_cents")))
    low, high = S.parsed_band(raw)
    return d.line.where("low_cents IS NOT NULL AND high_cents IS NOT NULL").select("id", low.alias("low"), high.alias("high"))
