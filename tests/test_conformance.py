"""Report pages, entities, and adapters against the rows expected of their documents."""

import json

import pytest
from pyspark.sql import functions as F

from statera.functions import scalar as S
from statera.functions.details import CONTRACTS
from statera.operators import conformance
from statera.sources import senate
from statera.sources.adapters import ADAPTERS

ROW = ("2", "03/04/2024", "Spouse", "--", "<b>Acme</b> Inc &amp; Co<div class='text-muted small'>Rate/Coupon: 5%</div>", "Corporate Bond", "Sale (Partial)", "$1,001 - $15,000", "--")
NEXT = ("1", "3/5/2024", "Child", '<a href="#">ACM</a>', "Acme", "Stock", "Purchase", "Over $50,000,000", "a comment")
COUNTS = ("(2 transactions total)", "0 Self", "0 Joint", "1 Spouse", "1 Dependent Child")


def page(rows=(ROW, NEXT), counts=COUNTS, title="Periodic Transaction Report for 03/09/2024 (Amendment 2)", filer="X (Y, Z)", stamp="Filed 03/09/2024 @ 1:23 PM", tables=1):
    table = "<table border='0' class=\"table table-striped\"><thead><tr><th>#</th></tr></thead><tbody>" + "".join("<tr class='r'>" + "".join(f"<td>\n {c} </td>" for c in r) + "</tr>" for r in rows) + "</tbody></table>"
    items = "".join(f"<li>{c}</li>" for c in counts)
    return f"<html><!-- <h1 class='mb-2'>no</h1> --><script>'<table class=\"table\">'</script><h1 class='mb-2'>{title}</h1><h2 class='filedReport x'>{filer}</h2><p class='muted'><strong>{stamp}</strong></p><table class='tables'></table><section class='card'><ul>{items}</ul></section>{table * tables}</html>"


def changed(row, k, value):
    return row[:k] + (value,) + row[k + 1 :]


FAULTS = [
    (None, "title"), ("", "title"), ("<html>", "title"), (page(title="Report"), "title"), (page(filer=""), "filer"), (page(stamp="03/09/2024"), "stamp"), (page(counts=COUNTS[:4]), "summary"), (page(counts=("(2 transaction total)", *COUNTS[1:])), "summary"),
    (page(counts=(COUNTS[0], "0 Joint", *COUNTS[2:])), "summary"), (page(tables=2), "table"), (page(tables=0), "table"), (page((ROW[:8], NEXT)), "row 1: width"), (page((ROW, (*NEXT, "x"))), "row 2: width"), (page((ROW, ("x",))), "row 2: width"),
    (page((changed(ROW, 0, "b"), NEXT)), "row 1: number"), (page((ROW, changed(NEXT, 1, "2024-03-05"))), "row 2: date"), (page((ROW, changed(NEXT, 2, "Dog"))), "row 2: owner"), (page((ROW, changed(NEXT, 3, "ACM"))), "row 2: ticker"), (page((ROW, changed(NEXT, 4, ""))), "row 2: asset"),
    (page((ROW, changed(NEXT, 5, ""))), "row 2: asset_type"), (page((ROW, changed(NEXT, 6, "Gift"))), "row 2: side"), (page((ROW, changed(NEXT, 7, "$1 - $2"))), "row 2: band"), (page((ROW, changed(NEXT, 8, ""))), "row 2: comment"), (page(()), "no_rows"), (page((ROW,)), "count"),
    (page((NEXT, ROW)), "sequence"), (page((ROW, changed(NEXT, 2, "Self"))), "owners"), (page(), None),
]


def test_pages_are_rejected_whole(spark):
    docs = spark.createDataFrame([(str(k), p) for k, (p, _) in enumerate(FAULTS)], "sha256 string, text string")
    got = {int(r.sha256): r.reason for r in senate.rejected(docs).collect()}
    assert got == {k: f for k, (_, f) in enumerate(FAULTS) if f}
    assert {r.sha256 for r in ADAPTERS["us_senate"].parse(docs).collect()} == {str(len(FAULTS) - 1)}


def test_unescaped(spark):
    cases = {"a &amp; b": "a & b", "&amp;lt;": "&lt;", "&#233;&#xE9;&#X1F600;": "éé😀", "&bad; & &#0; &#xD800; &#1114112;": "&bad; & &#0; &#xD800; &#1114112;", "&lt;&gt;&quot;&apos;&nbsp;": "<>\"' ", "&#38;#38;": "&#38;", "none": "none", "&": "&", "": ""}
    rows = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert [(r.t, r.got) for r in rows.withColumn("got", S.unescaped(F.col("t"))).where("not (got <=> want)").collect()] == []
    long = "x" * 300_000 + "&amp;" * 20_000
    assert spark.createDataFrame([(long,)], "t string").select(S.unescaped(F.col("t")).alias("u")).collect()[0].u == "x" * 300_000 + "&" * 20_000


SENATE_SILVER = [
    ("s", 1, "Periodic Transaction Report for 03/09/2024 (Amendment 2)", "X (Y, Z)", "03/09/2024 @ 1:23 PM", "2", "03/04/2024", "Spouse", None, "Acme Inc & Co", "Corporate Bond", "Sale (Partial)", "$1,001 - $15,000", None, "Rate/Coupon: 5%", 0.98),
    ("s", 2, "Periodic Transaction Report for 03/09/2024 (Amendment 2)", "X (Y, Z)", "03/09/2024 @ 1:23 PM", "1", "3/5/2024", "Child", "ACM", "Acme", "Stock", "Purchase", "Over $50,000,000", "a comment", None, 1.0),
]
SENATE_GOLD = [
    ("s", 1, "transaction", "bond", "Acme Inc & Co", "sell", "spouse", "2024-03-04", 100100, 1500000, "USD", 0.98, {"report_uuid": "s", "row_ordinal": 1, "row_number": "2", "ticker": None, "asset_type_raw": "Corporate Bond", "asset_detail": "Rate/Coupon: 5%", "amount_band_raw": "$1,001 - $15,000", "transaction_type_raw": "Sale (Partial)", "partial_sale": True, "comment": None, "amendment_number": 2, "filed_at_raw": "03/09/2024 @ 1:23 PM"}),
    ("s", 2, "transaction", "equity", "Acme", "buy", "dependent", "2024-03-05", 5000000000, None, "USD", 1.0, {"report_uuid": "s", "row_ordinal": 2, "row_number": "1", "ticker": "ACM", "asset_type_raw": "Stock", "asset_detail": None, "amount_band_raw": "Over $50,000,000", "transaction_type_raw": "Purchase", "partial_sale": False, "comment": "a comment", "amendment_number": 2, "filed_at_raw": "03/09/2024 @ 1:23 PM"}),
]
BRAZIL_DOC = {
    "consulta_cand": {"SQ_CANDIDATO": "9", "NM_CANDIDATO": "N", "SG_UF": "AC", "DT_ELEICAO": "02/10/2022", "ANO_ELEICAO": "2022"},
    "bem_candidato": [{"NR_ORDEM_BEM_CANDIDATO": "3", "CD_TIPO_BEM_CANDIDATO": "12", "DS_TIPO_BEM_CANDIDATO": "Casa", "DS_BEM_CANDIDATO": "Casa em Xapuri", "VR_BEM_CANDIDATO": "10000,00", "DT_ULT_ATUAL_BEM_CANDIDATO": "02/10/2022", "HH_ULT_ATUAL_BEM_CANDIDATO": "23:21:28"}],
}
BRAZIL_SILVER = [("s", 0, "9", "N", "AC", "02/10/2022", "2022", "3", "12", "Casa", "Casa em Xapuri", "10000,00", "02/10/2022", "23:21:28")]
BRAZIL_GOLD = [
    ("s", "2022:AC:9", "holding", "real_estate", "Casa em Xapuri", "2022-10-02", "10000.00", "10000.00", "BRL", 3, {"asset_type_code_raw": "12", "asset_type_label_raw": "Casa", "asset_class": "real_estate", "asset_description_raw": "Casa em Xapuri", "value_raw": "10000,00", "election_year": 2022, "line_item_ordinal": 3, "last_updated_date_raw": "02/10/2022", "last_updated_time_raw": "23:21:28"})
]
UK_DOC = {
    "id": 7, "summary": "A gift", "registrationDate": "2026-06-28", "category": {"id": 3, "number": "2", "name": "D"}, "member": {"id": 1, "nameDisplayAs": "M"},
    "fields": [{"name": "Value", "type": "Decimal", "typeInfo": {"currencyCode": "GBP"}, "value": "3400.00"}],
}


def typed(spark, rows, schema):
    """Rows of plain values as a schema has them: dates, decimals and JSON come as texts."""
    plain = [tuple(json.dumps(v, separators=(",", ":")) if isinstance(v, dict) else v for v in r) for r in rows]
    names = [f.name for f in schema]
    raw = spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in plain], ", ".join(f"{n} string" for n in names))
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def case(spark, regime, text, silver, gold, change=None):
    a = ADAPTERS[regime]
    bronze = spark.createDataFrame([("s", text)], "sha256 string, text string")
    shape = a.parse(bronze)
    return a, bronze, typed(spark, silver, shape.schema), typed(spark, gold, a.normalize(shape).schema)


def test_senate_conforms(spark):
    run = lambda silver, gold: sorted((r.stage, r.position, r.problem, tuple(r.paths)) for r in conformance.run(*case(spark, "us_senate", page(), silver, gold), "row_ordinal", "row_ordinal", schemas=CONTRACTS).collect())
    assert run(SENATE_SILVER, SENATE_GOLD) == []
    wrong = [SENATE_SILVER[0][:9] + ("Acme", *SENATE_SILVER[0][10:])]
    assert run(wrong, [changed(SENATE_GOLD[0], 8, None), *SENATE_GOLD]) == [("gold", 1, "missing", ()), ("silver", 1, "differs", ("$.asset_name_raw",)), ("silver", 2, "unexpected", ())]


def test_brazil_conforms(spark):
    run = lambda doc, silver, gold: sorted((r.stage, r.position, r.problem, tuple(r.paths)) for r in conformance.run(*case(spark, "br", json.dumps(doc), silver, gold), "position", "ordinal", schemas=CONTRACTS).collect())
    assert run(BRAZIL_DOC, BRAZIL_SILVER, BRAZIL_GOLD) == []
    none = {**BRAZIL_DOC, "bem_candidato": []}
    assert run(none, [], []) == []  # nothing declared and nothing expected
    got = conformance.run(*case(spark, "br", json.dumps(none), BRAZIL_SILVER, BRAZIL_GOLD), "position", "ordinal").collect()
    assert sorted((r.stage, r.problem) for r in got) == [("gold", "missing"), ("silver", "missing"), ("silver", "zero_rows")]
    timeless = {**BRAZIL_DOC, "bem_candidato": [{k: v for k, v in BRAZIL_DOC["bem_candidato"][0].items() if not k.startswith("HH")}]}
    got = run(timeless, [changed(BRAZIL_SILVER[0], 13, None)], BRAZIL_GOLD)
    assert [g[:3] for g in got] == [("contract", 3, "breach"), ("gold", 3, "differs")] and got[1][3] == ("$.details",)


def test_united_kingdom_conforms(spark):
    fields = F.array(F.struct(F.lit("Value").alias("name"), F.lit("Decimal").alias("type"), F.struct(F.lit("GBP").alias("currencyCode")).alias("typeInfo"), F.lit("3400.00").alias("value"), F.lit(None).cast("array<array<struct<name:string,type:string,typeInfo:struct<currencyCode:string>,value:string>>>").alias("values")))
    a = ADAPTERS["uk_commons_register"]
    bronze = spark.createDataFrame([("s", json.dumps(UK_DOC))], "sha256 string, text string")
    silver = typed(spark, [("s", 7, 0, 3, "2", 1, "M", "A gift", "2026-06-28")], [f for f in a.parse(bronze).schema if f.name != "fields_raw"]).withColumn("fields_raw", fields)
    gold = typed(spark, [("s", "7@0", "interest", "A gift", "2026-06-28", "3400.00", "3400.00", "GBP", "value_field", "false")], a.normalize(silver).schema)
    numbered = lambda s, g: sorted((r.stage, r.problem, tuple(r.paths)) for r in [*conformance.differences(a.parse(bronze), s, "sha256", "interest_id", "silver").collect(), *conformance.differences(a.normalize(a.parse(bronze)).withColumn("n", F.lit(0)), g.withColumn("n", F.lit(0)), "sha256", "n", "gold").collect()])
    assert numbered(silver, gold) == []
    other = silver.withColumn("fields_raw", F.transform("fields_raw", lambda f: f.withField("typeInfo.currencyCode", F.lit("EUR"))))
    assert numbered(other, gold.withColumn("value_low", F.lit(None).cast("decimal(16,2)"))) == [("gold", "differs", ("$.value_low",)), ("silver", "differs", ("$.fields_raw[0].typeInfo.currencyCode",))]
    assert numbered(silver.withColumn("fields_raw", F.concat("fields_raw", "fields_raw")), gold) == [("silver", "differs", ("$.fields_raw.length",))]
    assert numbered(silver.withColumn("fields_raw", F.lit(None).cast(silver.schema["fields_raw"].dataType)), gold) == [("silver", "differs", ("$.fields_raw",))]


def test_nothing_to_test_is_refused(spark):
    a, bronze, silver, gold = case(spark, "br", "{}", [], [])
    with pytest.raises(ValueError, match="no documents"):
        conformance.run(a, bronze.where("false"), silver, gold, "position", "ordinal")
    with pytest.raises(ValueError, match="columns differ"):
        conformance.differences(silver.drop("value_raw"), silver, "sha256", "position", "silver")
