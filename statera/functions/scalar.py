"""Scalar functions of the domain as column builders; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values of the domain: value bands in cents, the last one open
BANDS = (
    ("$1,001 - $15,000", 100100, 1500000),
    ("$15,001 - $50,000", 1500100, 5000000),
    ("$50,001 - $100,000", 5000100, 10000000),
    ("$100,001 - $250,000", 10000100, 25000000),
    ("$250,001 - $500,000", 25000100, 50000000),
    ("$500,001 - $1,000,000", 50000100, 100000000),
    ("$1,000,001 - $5,000,000", 100000100, 500000000),
    ("$5,000,001 - $25,000,000", 500000100, 2500000000),
    ("$25,000,001 - $50,000,000", 2500000100, 5000000000),
    ("Over $50,000,000", 5000000000, None),
)

#: fixed values of the domain: periodicity words by cadence
CADENCES = {
    "monthly": ("μηνιαίως", "miesięcznie", "monthly", "mensuel", "mensuellement", "monatlich"),
    "quarterly": ("kwartalnie", "quarterly", "trimestriel", "vierteljährlich"),
    "annual": ("rocznie", "ετησίως", "annually", "annual", "annuel", "annuellement", "jährlich"),
    "one_off": ("jednorazowo", "one-off", "one_off", "einmalig", "ponctuel"),
}

#: fixed values of the domain: owner codes and words
OWNER_CODES = {"SP": "spouse", "DC": "dependent", "JT": "joint"}
OWNER_WORDS = {"Self": "self", "Spouse": "spouse", "Joint": "joint", "Child": "dependent"}

#: fixed values of the domain: sides of a transaction by its printed type
SIDES = {"Purchase": "buy", "Sale (Full)": "sell", "Sale (Partial)": "sell", "Exchange": "exchange"}

#: fixed values of the domain: asset classes by code
ASSET_CLASSES = {
    "equity": ("ST", "PS", "RS", "SA"),
    "bond": ("CS", "GS", "AB", "ET"),
    "fund": ("EF", "MF", "HE", "HN", "RF", "RE", "RN", "5C", "5F", "5P", "4K", "IR", "IH", "IC", "MA", "BK"),
    "option": ("OP",),
    "crypto": ("CT",),
    "commodity": ("PM", "FU", "FE", "CO"),
    "real_estate": ("RP", "FA", "MO", "DS"),
    "private": ("OI", "OL"),
    "other": ("OT", "BA", "TR", "EQ", "DB", "PE", "DO", "IP", "FN", "VA", "VI", "WU"),
}

#: fixed values of the domain: Brazilian asset codes
BR_ASSET_CLASSES = {"12": "real_estate", "13": "real_estate", "21": "other", "97": "other", "32": "private"}

ULID = "^[0-7][0-9A-HJKMNP-TV-Z]{25}$"


def mapped(value: Column, names: dict[str, str], otherwise: str | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, value), F.lit(otherwise))


def inverted(groups: dict[str, tuple[str, ...]]) -> dict[str, str]:
    return {member: name for name, members in groups.items() for member in members}


def cadence(raw: Column) -> Column:
    """Cadence of a periodicity word in any language known; other for an unknown word, null for none."""
    word = F.lower(F.trim(raw))
    return F.when(word != "", mapped(word, inverted(CADENCES), "other"))


def asset_class(code: Column) -> Column:
    """Class of an asset code; null for a code that is not in the legend, which callers file under other, at a loss of confidence."""
    return mapped(code, inverted(ASSET_CLASSES))


def band_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BANDS), "band string, low_cents long, high_cents long")


def fingerprint(scope: Column, ordinal: Column, content: Column) -> Column:
    """SHA-256 of scope, zero byte, ordinal as 4 big-endian bytes, zero byte, content."""
    number = F.unhex(F.lpad(F.hex(ordinal.cast("long")), 8, "0"))
    zero = F.unhex(F.lit("00"))
    return F.sha2(F.concat(scope.cast("binary"), zero, number, zero, content.cast("binary")), 256)


def canonical_json(text: Column) -> Column:
    """Compact JSON with sorted keys at every level."""
    return F.to_json(F.parse_json(text))


def without_keys(details: Column, *keys: str) -> Column:
    return F.map_filter(details, lambda k, _: ~k.isin(*keys))


def skeleton(html: Column) -> Column:
    """Sorted distinct tags and classes of a page: equal for more rows of one layout, different for a changed one."""
    tags = F.transform(F.regexp_extract_all(html, F.lit("<([A-Za-z][A-Za-z0-9-]*)"), F.lit(1)), lambda t: F.concat(F.lit("t:"), t))
    lists = F.regexp_extract_all(html, F.lit('class="([^"]*)"'), F.lit(1))
    names = F.filter(F.flatten(F.transform(lists, lambda c: F.split(c, r"\s+"))), lambda c: c != "")
    return F.array_join(F.array_sort(F.array_distinct(F.concat(tags, F.transform(names, lambda c: F.concat(F.lit("c:"), c))))), ";")


def occurrences(text: Column, marker: str) -> Column:
    """Non-overlapping occurrences of a marker."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(marker), F.lit("")))) / len(marker)).cast("long")


def mime(text: Column) -> Column:
    """Media type by leading characters after ASCII white space."""
    lead = F.regexp_replace(text, r"^[\t\n\f\r ]+", "")
    page = F.startswith(lead, F.lit("<!DOCTYPE")) | F.startswith(lead, F.lit("<!doctype")) | F.startswith(lead, F.lit("<html")) | F.startswith(lead, F.lit("<HTML"))
    return F.when(F.startswith(lead, F.lit("%PDF-")), "application/pdf").when(page, "text/html").when(F.left(lead, F.lit(1)).isin("{", "["), "application/json").otherwise("application/octet-stream")


def source_of(text: Column) -> Column:
    """Which annual-declaration source a document comes from, by its first 8192 characters."""
    head = F.left(text, F.lit(8192))
    return F.when(F.startswith(head, F.lit("%PDF-")), "eu").when(F.contains(head, F.lit("<declaration")), "fr").when(F.contains(F.lower(head), F.lit("<html")), "de")


def midpoint(low: Column, high: Column) -> Column:
    """Middle of a closed interval in cents, exact to half a cent."""
    return ((low + high).cast("decimal(20,1)") / 2).cast("decimal(20,1)")


def _money(cents: Column, currency: Column) -> Column:
    return F.concat_ws(" ", currency, F.format_number((cents.cast("decimal(20,2)") / 100).cast("decimal(20,2)"), 2))


def value_text(low: Column, high: Column, currency: Column) -> Column:
    """An interval for readers: or more, exact, or both ends."""
    return F.when(low.isNull(), None).when(high.isNull(), F.concat(_money(low, currency), F.lit(" or more"))).when(low == high, _money(low, currency)).otherwise(F.concat_ws(" – ", _money(low, currency), _money(high, currency)))


def us_date(raw: Column) -> Column:
    return F.try_to_date(raw, "M/d/yyyy")


def day_first_date(raw: Column) -> Column:
    return F.try_to_date(raw, "d/M/yyyy")


def short_year_date(raw: Column) -> Column:
    """d/m/yy of this century, null if it is none."""
    parts = F.regexp_extract_all(raw, F.lit(r"^(\d{1,2})/(\d{1,2})/(\d{2})$"), F.lit(0))
    padded = F.regexp_replace(raw, r"^(\d{1,2})/(\d{1,2})/(\d{2})$", "$1/$2/20$3")
    return F.when(F.size(parts) == 1, F.try_to_date(padded, "d/M/yyyy"))


def comma_decimal(raw: Column) -> Column:
    """1.234,56 as a number; null for anything else."""
    plain = F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(plain.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), plain.cast("decimal(16,2)"))


def digits_amount(raw: Column, comma: bool) -> Column:
    """Digits with an optional leading minus; a comma separates decimals if ``comma``; everything else is dropped."""
    kept = F.regexp_replace(raw, "[^0-9,-]" if comma else "[^0-9-]", "")
    kept = F.concat(F.when(F.startswith(kept, F.lit("-")), "-").otherwise(""), F.replace(kept, F.lit("-"), F.lit("")))
    return F.replace(kept, F.lit(","), F.lit(".")).try_cast("decimal(16,2)")


def currency_token(raw: Column) -> Column:
    """The last word if it is three capital letters."""
    found = F.regexp_extract(F.concat(F.lit(" "), raw), r"\s([A-Z]{3})\s*$", 1)
    return F.nullif(found, F.lit(""))


def confidence(*penalties: tuple[Column, float]) -> Column:
    """1 less the penalties that apply, within 0 and 1, in single precision."""
    out = F.lit(1.0).cast("float")
    for applies, loss in penalties:
        out = F.when(applies, out - F.lit(loss).cast("float")).otherwise(out)
    return F.greatest(F.least(out, F.lit(1.0).cast("float")), F.lit(0.0).cast("float"))


def report_title(title: Column) -> tuple[Column, Column]:
    """Date and amendment number of a periodic report's title, both null if it is none."""
    pattern = r"^Periodic Transaction Report for (\d{1,2}/\d{1,2}/\d{4})(?: \(Amendment (\d+)\))?$"
    return us_date(F.nullif(F.regexp_extract(title, pattern, 1), F.lit(""))), F.nullif(F.regexp_extract(title, pattern, 2), F.lit("")).cast("int")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: fixed values: named character references
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\u00a0"}


def unescaped(text: Column) -> Column:
    """Character references decoded once, from left to right; unknown names and numbers that are no character stay as they are."""
    pieces = F.regexp_extract_all(text, F.lit("(?s)&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-z]{2,4});|[^&]++|&"), F.lit(0))

    def decoded(piece: Column) -> Column:
        digits = F.regexp_extract(piece, "^&#[xX]?([0-9a-fA-F]+);$", 1)
        point = F.when(F.lower(F.left(piece, F.lit(3))) == "&#x", F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        valid = ((point > 0) & (point < 0xD800)) | ((point > 0xDFFF) & (point <= 0x10FFFF))
        sign = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, point).otherwise(F.lit(32)).cast("long")), 8, "0")), "UTF-32")
        return F.coalesce(mapped(piece, ENTITIES), F.when(F.startswith(piece, F.lit("&#")) & valid, sign), piece)

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, decoded), "")).otherwise(text)


def high_impact(low: Column, floor_cents: int = 50_000_100, watched: Column | None = None) -> Column:
    """Aggregate: any value of the document reaches the floor, is unknown, or the filer is watched (null is not)."""
    high = F.coalesce(low >= floor_cents, F.lit(True))
    return F.bool_or(high if watched is None else high | F.coalesce(watched, F.lit(False)))


def owner_of(row: Column, vehicle: Column) -> tuple[Column, Column]:
    """Owner by precedence row, vehicle, self; and which of them it came from."""
    return F.coalesce(row, vehicle, F.lit("self")), F.when(row.isNotNull(), "row").when(vehicle.isNotNull(), "vehicle").otherwise("default")


def row_anchor(line: Column) -> Column:
    """Side token, two dates and the band of a printed transaction line, as a struct; empty parts where it is no such line."""
    pattern = r"(?i)\b(P|S|E)(?: \(partial\))?\s+(\d{1,2}/\d{1,2}/\d{4})\s+(\d{1,2}/\d{1,2}/\d{4})\s+(\$[0-9,]+ - \$[0-9,]+|Over \$[0-9,]+)\s*$"
    return F.struct(*[F.regexp_extract(line, pattern, k).alias(n) for k, n in enumerate(("side", "traded", "notified", "band"), 1)])


def date_range(raw: Column) -> tuple[Column, Column]:
    """Both ends of dates joined by an en or em dash; a single date is both; what is no date is null."""
    parts = F.split(raw, r"\s*[\u2013\u2014]\s*")
    return F.try_to_date(F.get(parts, 0), "yyyy/MM/dd"), F.try_to_date(F.element_at(parts, -1), "yyyy/MM/dd")


def parsed_band(raw: Column) -> tuple[Column, Column]:
    """Ends of a "$a - $b" band in cents; both null for an inverted band or anything else."""
    pattern = r"^\$([0-9,]+(?:\.[0-9]{1,2})?) - \$([0-9,]+(?:\.[0-9]{1,2})?)$"
    low, high = ((F.replace(F.regexp_extract(raw, pattern, k), F.lit(","), F.lit("")).try_cast("decimal(16,2)") * 100).cast("long") for k in (1, 2))
    return F.when(low <= high, low), F.when(low <= high, high)


# Cadence words of German income lines, and the word that marks a supplement.
CADENCE_WORDS = ("monatlich", "jährlich", "einmalig", "vierteljährlich", "halbjährlich")
SUPPLEMENT = "zuzüglich"


def income_split(text: Column) -> Column:
    """Role and income of a line, as a struct: the income begins at the first cadence word after a comma, or is the whole line."""
    words = "|".join(CADENCE_WORDS)
    cut = F.regexp_instr(text, F.lit(f", ({words})"))
    whole = text.rlike(f"^({words}|{SUPPLEMENT})")
    role = F.when(whole, "").when(cut > 0, F.trim(F.substring(text, F.lit(1), cut - 1))).otherwise(F.trim(text))
    return F.struct(role.alias("role"), F.when(whole, text).when(cut > 0, F.trim(F.substring(text, cut + 2, F.char_length(text)))).alias("income"))


def income_parts(income: Column) -> Column:
    """period, year and amount of an income, as a struct; a leading year makes it a single payment."""
    text = F.trim(income)
    year = F.nullif(F.regexp_extract(text, "^([0-9]{4})(?![0-9])", 1), F.lit(""))
    period = F.when(F.startswith(text, F.lit("monatlich")), "monthly").when(F.startswith(text, F.lit("jährlich")), "annual").when(F.startswith(text, F.lit("einmalig")) | year.isNotNull(), "one_off")
    return F.struct(period.alias("period"), year.cast("int").alias("year"), first_euro_amount(text).alias("amount"))


def first_euro_amount(text: Column) -> Column:
    """The number right before the first EUR or Euro, as written in German; null without one."""
    before = F.regexp_extract(text, "(?s)^(?:(?!EUR|Euro).)*?([0-9.,]*) *(?:EUR|Euro)", 1)
    return comma_decimal(before)


# Month names of received stamps.
STAMP_MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def stamp_date(raw: Column) -> Column:
    """A received stamp, year, month name and day, whose single digits follow a hyphen; null for anything else."""
    part = lambda k: F.regexp_extract(raw, r"^\s*([0-9]{4})\s+([A-Z]{3})\s+-*([0-9]{1,2})\s*$", k)
    month = F.array_position(F.array(*map(F.lit, STAMP_MONTHS)), part(2))
    return F.when(month > 0, F.try_to_date(F.concat_ws("-", part(1), month.cast("string"), part(3)), "yyyy-M-d"))


def source_date(raw: Column) -> Column:
    """Month first with slashes, or a received stamp."""
    return F.coalesce(us_date(raw), stamp_date(raw))


def change_date(line: Column) -> Column:
    """The date after ``Date of change:``, year first with slashes; null if the line has none."""
    return F.try_to_date(F.nullif(F.regexp_extract(line, r"^Date of change:\s*(\S+)", 1), F.lit("")), "yyyy/M/d")


def stamped_day(raw: Column) -> Column:
    """Day first with slashes, whatever follows the first white space."""
    return F.try_to_date(F.regexp_extract(raw, r"^\s*(\S+)", 1), "d/M/yyyy")


def days_text(seconds: Column) -> Column:
    """A duration in days with one decimal, a dash where it is unknown."""
    return F.coalesce(F.concat(F.round(seconds.cast("decimal(20,3)") / 86400, 1).cast("decimal(20,1)").cast("string"), F.lit("d")), F.lit("—"))


def age_text(at: Column, now: Column) -> Column:
    """How long ago: minutes below an hour, hours below two days, then days; never negative."""
    minutes = F.greatest(F.floor((F.unix_micros(now) - F.unix_micros(at)) / 60_000_000), F.lit(0)).cast("long")
    hours, days = F.floor(minutes / 60).cast("long"), F.floor(minutes / 1440).cast("long")
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).when(hours < 48, F.concat(hours.cast("string"), F.lit("h"))).otherwise(F.concat(days.cast("string"), F.lit("d")))


def share_text(share: Column) -> Column:
    return F.concat(F.floor(share * 100 + 0.5).cast("long").cast("string"), F.lit("%"))


def count_text(n: Column) -> Column:
    return F.format_number(n, 0)


def minute_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm 'UTC'")


def before(as_of: Column, hours: int = 0, months: int = 0) -> Column:
    """A stated instant minus an interval; the clock is never read."""
    return as_of - F.make_interval(months=F.lit(months), hours=F.lit(hours))
