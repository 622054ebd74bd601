"""Nested XML declarations: sections walked as data, in document order, by built-in functions alone.

Sections are the elements whose names end in ``Dto``; their entries become maps of text, in which nested parts stay
XML until they are asked for, so numbers keep the form they were written in.  A document that is not well-formed, or
has anything outside the vocabulary, is rejected whole: nothing of it is guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the source: the field that names an entry, by section, and sections that are not read.
PRIMARY = {
    "activCollaborateursDto": None,
    "activConsultantDto": "description",
    "activProfCinqDerniereDto": "description",
    "activProfConjointDto": "activiteProf",
    "fonctionBenevoleDto": "nomStructure",
    "mandatElectifDto": "descriptionMandat",
    "observationInteretDto": None,
    "participationDirigeantDto": "nomSociete",
    "participationFinanciereDto": "nomSociete",
}
DEPTH = 10  # of elements in a document
_NAME = "[A-Za-z_][A-Za-z0-9_.-]*"
_SECTION = rf"(?s)<({_NAME}Dto)(?:\s[^<>]*)?(?:/>|>(.*?)</\1\s*>)"
_ENTRIES = "items STRUCT<items: ARRAY<MAP<STRING, STRING>>>"
_PAY = "brutNet STRING, montant STRUCT<montant: ARRAY<STRUCT<annee: STRING, montant: STRING>>>"


def _nested(name: str, levels: int, group: int, attributes: str = "") -> str:
    """Pattern of an element of up to so many levels, without comments and empty tags with attributes; ``group`` is the number of its own."""
    inside = rf"[^<>]*(?:{_nested(_PLAIN_NAME, levels - 1, group + 1)}[^<>]*)*+" if levels > 1 else "[^<>]*"
    return rf"<({name}){attributes}(?:/>|>{inside}</\{group}>)"


# Documents in their usual form are cut by one pattern into sections, plain elements themselves, and the tags and text
# around them, which name no section.  What the patterns match is well-formed too: sections of up to _SECTION_DEPTH
# levels inside a rest that has up to the others.
_SECTION_DEPTH = 7
_PLAIN_NAME = r"[A-Za-z_]\w*(?<!Dto)"
_PARTS = rf"{_nested(r'[A-Za-z_]\w*+(?<=Dto)', _SECTION_DEPTH, 1, r'(?:\s[^<>/]*)?')}|(?!<?[^<]*Dto)(?:<[^<>]*>[^<>]*|[^<>]+)"
_AROUND = rf"\A(?:[^<>]+|<\?[^<>]*\?>|<!--[^<>]*-->|{_nested(_PLAIN_NAME, DEPTH - _SECTION_DEPTH, 1)})*+\z"


def well_formed(xml: Column) -> Column:
    """Whether elements of up to ``DEPTH`` levels close as they open: innermost ones are taken away level by level."""
    rest = F.regexp_replace(xml, r"(?s)<\?.*?\?>|<!--.*?-->", "")
    rest = F.regexp_replace(rest, rf"<{_NAME}(?:\s[^<>]*)?/>", "")
    for _ in range(DEPTH):
        rest = F.regexp_replace(rest, rf"<({_NAME})(?:\s[^<>]*)?>[^<>]*</\1\s*>", "")
    return ~F.contains(rest, F.lit("<")) & ~F.contains(rest, F.lit(">"))


def _text(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))


def _inside(xml: Column, name: str) -> Column:
    """Text of the first element of a name, white space collapsed, entities read; empty where there is none."""
    text = F.regexp_extract(xml, rf"(?s)<{name}>([^<]*)</{name}>", 1)
    read = F.from_xml(F.concat(F.lit("<r><v>"), text, F.lit("</v></r>")), "v STRING", {"rowTag": "r"})["v"]
    return _text(F.when(F.contains(text, F.lit("&")) | F.contains(text, F.lit("]]>")), read).otherwise(text))


def _cut(documents: DataFrame) -> DataFrame:
    """document, xml, ``broken`` (why it is rejected as a whole) and ``parts``, its sections in order.

    Documents that leave the usual form are checked level by level and searched for sections on their own.
    """
    docs = documents.select("document", "xml", F.regexp_extract_all("xml", F.lit(_PARTS), F.lit(0)).alias("cut"))
    is_section = lambda x: F.contains(x, F.lit("Dto"))
    around = F.array_join(F.filter("cut", lambda x: ~is_section(x)), "")
    usual = F.coalesce((F.array_join("cut", "") == F.col("xml")) & around.rlike(_AROUND), F.lit(False))
    docs = docs.select("document", "xml", F.filter("cut", is_section).alias("parts"), usual.alias("usual"))
    fine = F.coalesce(well_formed(F.when(F.col("usual"), "").otherwise(F.col("xml"))), F.lit(False))  # nothing is left to check in usual ones
    broken = F.when(~fine, "malformed").when(~F.col("xml").rlike(r"<declaration[\s>]"), "no_declaration").when(~F.col("xml").rlike(r"<general[\s>]"), "no_general")
    docs = docs.withColumn("broken", broken)
    parts = F.when(F.col("usual"), F.col("parts")).otherwise(F.regexp_extract_all("xml", F.lit(_SECTION), F.lit(0)))
    return docs.select("document", "broken", F.when(F.col("broken").isNull(), parts).alias("parts"))


def entries(documents: DataFrame) -> DataFrame:
    """document, row, section, name, motif, fields (map), gross_or_net, pays (year, amount) and ``reason``, why its document is rejected.

    ``documents``: document and xml.  A document without a row has one with a null row number.
    """
    rows = _cut(documents).select("document", "broken", F.posexplode_outer("parts").alias("at", "xml"))
    rows = rows.withColumn("section", F.regexp_extract("xml", rf"^<({_NAME})", 1))
    unknown = F.col("section").isNotNull() & ~F.col("section").isin(*PRIMARY)
    read = F.col("section").isin(*[k for k, v in PRIMARY.items() if v])
    found = F.when(read, F.from_xml("xml", _ENTRIES, {"rowTag": "section"})["items"]["items"])
    rows = rows.withColumn("broken", F.coalesce("broken", F.when(unknown, F.concat(F.lit("unknown_section:"), F.col("section")))))
    rows = rows.select("document", "broken", "at", "section", F.posexplode_outer(found).alias("k", "entry"))
    nested = F.exists(F.map_entries("entry"), lambda e: ~e.key.isin("motif", "remuneration") & e.value.rlike(rf"^\s*<{_NAME}"))
    fields = F.map_filter(F.transform_values(F.map_filter("entry", lambda k, v: ~k.isin("motif", "remuneration")), lambda k, v: _text(v)), lambda k, v: v != "")
    pay = F.from_xml(F.concat(F.lit("<r>"), F.coalesce(F.col("entry")["remuneration"], F.lit("")), F.lit("</r>")), _PAY, {"rowTag": "r"})
    rows = rows.select(
        "document", "broken", "at", "section", "k", F.col("entry").isNotNull().alias("is_entry"), fields.alias("fields"), nested.alias("nested"),
        _inside(F.col("entry")["motif"], "id").alias("motif"), F.when(F.col("entry")["remuneration"].rlike("<"), pay).alias("pay"),
    )
    pays = F.transform("pay.montant.montant", lambda m: F.struct(_text(m.annee).try_cast("int").alias("year"), _text(m.montant).alias("amount")))
    primary = F.create_map(*[F.lit(x) for k, v in PRIMARY.items() if v for x in (k, v)])
    entry_name = F.try_element_at("fields", F.try_element_at(primary, F.col("section")))
    rows = rows.withColumns({"pays": pays, "name": entry_name, "gross_or_net": _text(F.col("pay.brutNet"))}).drop("pay")
    no_year = F.exists("pays", lambda p: p.year.isNull())
    late = F.when(F.col("is_entry"), F.when(F.col("nested"), "nested_field").when(no_year, "unreadable_year").when(F.col("name").isNull(), "no_name"))
    rows = rows.withColumn("broken", F.coalesce("broken", late)).drop("nested")
    whole = Window.partitionBy("document")
    order = whole.orderBy("at", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # in order first, so that what is asked of whole documents finds them sorted
    rows = rows.withColumns({"row": F.count_if("is_entry").over(order), "first": F.row_number().over(whole.orderBy("at", "k"))})
    # the first fault in document order is the reason; a document without any entry has one of its own
    fault = F.min(F.when(F.col("broken").isNotNull(), F.struct("at", "k", "broken"))).over(whole)["broken"]
    rows = rows.withColumn("reason", F.coalesce(fault, F.when(F.max("is_entry").over(whole), None).otherwise("no_entries")))
    return rows.where(F.col("is_entry") | ((F.col("first") == 1) & F.col("reason").isNotNull())).select(
        "document", F.when(F.col("is_entry"), F.col("row")).alias("row"), "section", "name", "motif", "fields", "gross_or_net", "pays", "reason"
    )


def sections(documents: DataFrame) -> DataFrame:
    """Entries of all documents that are not rejected."""
    return entries(documents).where("reason IS NULL").drop("reason")


def rejected(documents: DataFrame) -> DataFrame:
    return entries(documents).where("reason IS NOT NULL").groupBy("document").agg(F.min("reason").alias("reason"))
