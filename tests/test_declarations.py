"""Nested declarations: entries in order, text as written, and whole documents rejected."""

from pyspark.sql import functions as F

from statera.plans import report_queries
from statera.plans.domain import Domain
from statera.sources import declarations

ITEM = "<items><motif><id>CREATION</id><label>x</label></motif><nomSociete> A  &amp; B\n C </nomSociete><number>007</number><empty/><remuneration><brutNet>Brut</brutNet><montant><montant><annee>2020</annee><montant>1 000,50</montant></montant></montant></remuneration></items>"
OTHER = "<items><descriptionMandat>mayor</descriptionMandat></items>"


def document(*sections, general="<general><a>1</a></general>"):
    return f'<?xml version="1.0"?><declaration><uuid>u</uuid>{general}{"".join(sections)}</declaration>'


def section(name, *items):
    return f"<{name}><items>{''.join(items)}</items><neant>false</neant></{name}>"


def test_entries_and_rejects(spark):
    fine = document(section("participationFinanciereDto", ITEM, ITEM.replace("CREATION", "MODIFICATION")), "<activCollaborateursDto><items><items><odd><x>1</x></odd></items></items></activCollaborateursDto>", section("mandatElectifDto", OTHER), "<fonctionBenevoleDto><neant>true</neant></fonctionBenevoleDto>", "<!-- <oddDto> -->")
    cases = {
        "malformed": fine.replace("</declaration>", ""), "no_general": document(section("mandatElectifDto", OTHER), general=""), "no_entries": document("<mandatElectifDto><neant>true</neant></mandatElectifDto>"),
        "unknown_section:newDto": document(section("mandatElectifDto", OTHER), "<newDto/>"), "nested_field": document(section("mandatElectifDto", OTHER.replace("mayor", "mayor<b>x</b>"), "<items><descriptionMandat>a</descriptionMandat><c><d>1</d></c></items>").replace("mayor<b>x</b>", "mayor")),
        "unreadable_year": document(section("participationFinanciereDto", ITEM.replace("2020", "20x0"))), "no_name": document(section("mandatElectifDto", "<items><a>1</a></items>")), "no_declaration": "<other><general>1</general></other>",
    }
    frame = spark.createDataFrame([*cases.items(), ("fine", fine), ("crossed", "<declaration><a><b></a></b></declaration>"), ("null", None), ("empty", "")], "document string, xml string").repartition(3)
    found = declarations.sections(frame).orderBy("row").collect()
    assert {r.document for r in found} == {"fine"}
    assert [(r.row, r.section, r.name, r.motif, r.gross_or_net) for r in found] == [(1, "participationFinanciereDto", "A & B C", "CREATION", "Brut"), (2, "participationFinanciereDto", "A & B C", "MODIFICATION", "Brut"), (3, "mandatElectifDto", "mayor", "", "")]
    assert found[0].fields == {"nomSociete": "A & B C", "number": "007"} and [tuple(p) for p in found[0].pays] == [(2020, "1 000,50")] and found[2].pays is None
    reasons = {r.document: r.reason for r in declarations.rejected(frame).collect()}
    assert reasons == {**{k: k for k in cases}, "crossed": "malformed", "null": "malformed", "empty": "no_declaration"}
    assert declarations.entries(frame.limit(0)).count() == 0


def test_usual_and_other_forms_are_cut_alike(spark):
    """One pattern cuts documents in their usual form; the others are checked level by level, with the same sections."""
    usual = document(section("participationFinanciereDto", ITEM), section("mandatElectifDto", OTHER), "<observationInteretDto/>")
    other = [
        usual.replace("<descriptionMandat>", '<descriptionMandat a="b/c">'), usual.replace("<mandatElectifDto>", '<mandatElectifDto a="b/c">'), usual.replace("mayor", "mayor<!-- > -->"), usual.replace("mayor", "<xDto>1</xDto>"),
        usual.replace("mayor", "<![CDATA[<]]>"), usual.replace("mayor", "<mandatElectifDto/></items></mandatElectifDto><items>"), usual.replace("<uuid>", "<uuid >"), usual.replace("<uuid>u", "<!-- a -<xDto/>-><uuid>u"),
        usual.replace("<uuid>u</uuid>", "<a<xDto/>b></a>"), usual.replace("<uuid>u</uuid>", "<!-- <mandatElectifDto/> -->"), usual.replace("mayor", "<a>" * 9 + "</a>" * 9), usual.replace("mayor", "a > b"), usual.replace("</declaration>", ""), "", None,
        usual.replace("</declaration>", "<xDto></declaration>"), usual.replace("</declaration>", "</xDto></declaration>"), usual + "<xDto <b/>>", usual.replace("<uuid>u", "<uuid>xDto"), usual.replace("</declaration>", "<xDto"), usual + "xDto>",
    ]
    frame = spark.createDataFrame([(str(k), x) for k, x in enumerate([usual, *other])], "document string, xml string")
    found = {r.document: (r.broken == "malformed", r.parts) for r in declarations._cut(frame).collect()}
    by_level = frame.select("document", "xml", F.coalesce(declarations.well_formed(F.col("xml")), F.lit(False)).alias("fine"), F.regexp_extract_all("xml", F.lit(declarations._SECTION), F.lit(0)).alias("parts")).collect()
    assert len(found) == len(by_level) == len(other) + 1 and len(found["0"][1]) == 3
    for r in by_level:
        malformed, parts = found[r.document]
        assert malformed == (not r.fine)
        assert parts is None or parts == r.parts


def test_lines_of_a_filing_move_once(spark):
    """The numbering of lines and the printing of declarations share one shuffle."""
    lineitem = spark.createDataFrame([(o, n) for o in range(20) for n in range(3)], "l_orderkey long, l_linenumber int")
    lineitem = lineitem.selectExpr("l_orderkey", "5L AS l_partkey", "7L AS l_suppkey", "l_linenumber", *[f"1.5D AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")], "'N' AS l_returnflag", "'O' AS l_linestatus", "timestamp_ntz'2020-01-01' AS l_shipdate")
    d = Domain(spark, "")
    d._made["lineitem"] = lineitem
    xml = report_queries.declaration_xml(d)
    assert xml._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert declarations.sections(xml)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {r.document: r.n for r in declarations.sections(xml).groupBy("document").agg(F.count("*").alias("n")).collect()} == {f"{k:010}": 4 for k in range(20) if k % 16 not in report_queries.XML_FAULTS}
    assert sorted(map(str, d.line_by_filing().collect())) == sorted(map(str, d.line.select(d.line_by_filing().columns).collect()))
