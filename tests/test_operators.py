"""Properties that a table comparison does not show."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from statera.functions import scalar as S
from statera.operators import aggregates, chains, consensus, exports, filters, idempotent, paging, publish, trust, windows
from statera.sources import adapters, scans


def test_filter_rejects_inverted_bounds():
    with pytest.raises(ValueError):
        filters.RecordFilter(min_cents=2, max_cents=1)


def test_adding_a_clause_never_adds_rows(spark):
    rows = spark.createDataFrame([(1, "holding", 10, None), (2, "holding", None, None), (3, "interest", 5, 9)], "id int, record_type string, low_cents long, high_cents long")
    wide = {r.id for r in rows.where(filters.RecordFilter(min_cents=6).column()).collect()}
    narrow = {r.id for r in rows.where(filters.RecordFilter(min_cents=6, record_type="holding").column()).collect()}
    assert wide == {1, 3} and narrow == {1}


def test_pages_walk_all_rows(spark):
    rows = spark.range(23).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("id"))
    seen, after = [], None
    while True:
        found = paging.page(rows, 5, after).collect()
        seen += [r.id for r in found[:5]]
        after = paging.next_cursor(found, 5)
        if after is None:
            break
    assert seen == sorted(r.id for r in rows.collect())
    with pytest.raises(ValueError):
        paging.limit_of(201)


def test_mixed_pages_walk_all_rows(spark):
    rows = spark.range(30).select((F.col("id") % 4).alias("p"), (F.col("id") % 3).alias("c"), "id")
    order = [("p", True), ("c", False), ("id", False)]
    seen, anchor = [], None
    while True:
        found = paging.mixed_page(rows, order, anchor, 7).collect()
        seen += [tuple(r) for r in found[:7]]
        if len(found) <= 7:
            break
        anchor = found[6].asDict()
    assert seen == sorted((tuple(r) for r in rows.collect()), key=lambda r: (-r[0], r[1], r[2]))


def test_mixed_pages_walk_rows_without_keys(spark):
    rows = spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate([(1, None), (None, 2), (None, None), (1, 5), (2, None), (2, 1), (None, 1), (1, None)])], "id int, p int, c int")
    order = [("p", True), ("c", False), ("id", False)]
    for size in (1, 3):
        seen, anchor = [], None
        while True:
            found = paging.mixed_page(rows, order, anchor, size).collect()
            seen += [r.id for r in found[:size]]
            if len(found) <= size:
                break
            anchor = paging.anchor(rows, found[size - 1].id, ["p", "c", "id"])
        none_last = lambda x, sign: (x is None, sign * (x or 0))
        assert seen == [r.id for r in sorted(rows.collect(), key=lambda r: (none_last(r.p, -1), none_last(r.c, 1), r.id))]
    with pytest.raises(ValueError):
        paging.anchor(rows, 99, ["id"])


def test_insert_twice_inserts_nothing(spark):
    target = spark.createDataFrame([(1, "a", 0)], "k int, v string, o int")
    batch = spark.createDataFrame([(1, "b", 1), (2, "d", 3), (2, "c", 2)], "k int, v string, o int")
    first = idempotent.insert_if_absent(target, batch, ["k"], "o")
    assert [(r.k, r.v) for r in first.collect()] == [(2, "c")]
    assert idempotent.insert_if_absent(target.unionByName(first), batch, ["k"], "o").count() == 0


def test_publish_switches_all_tables_at_once(spark, tmp_path):
    root = f"file://{tmp_path}/gold"
    for k in (1, 2):
        idempotent.publish({"a": spark.range(k), "b": spark.range(10 * k)}, root, f"batch{k}")
        assert idempotent.current(spark, root, "a").count() == k
        assert idempotent.current(spark, root, "b").count() == 10 * k


def test_sample_does_not_depend_on_order(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("id"))
    a = {tuple(r) for r in windows.seeded_sample(rows, "g", "id", 7, 1).collect()}
    b = {tuple(r) for r in windows.seeded_sample(rows.orderBy(F.desc("id")).repartition(5), "g", "id", 7, 1).collect()}
    c = {tuple(r) for r in windows.seeded_sample(rows, "g", "id", 7, 2).collect()}
    assert a == b != c and len(a) == 21


def test_deep_chain(spark):
    rows = spark.range(150).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("supersedes_record_id"))
    up = chains.chain_up(rows, rows.where("id = '149'"))
    assert up.agg(F.max("depth"), F.count("*")).collect()[0][:] == (149, 150)
    assert chains.chain_down(rows, rows.where("id = '0'")).count() == 150


def test_chains_branch_and_hide_members(spark):
    rows = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "b"), ("e", "gone"), ("f", "d")], "id string, supersedes_record_id string")
    up = {(r.start_id, r.id, r.depth) for r in chains.chain_up(rows, rows.where("id IN ('f', 'e')")).collect()}
    assert up == {("f", "f", 0), ("f", "d", 1), ("f", "b", 2), ("f", "a", 3), ("e", "e", 0)}
    down = {(r.id, r.depth) for r in chains.chain_down(rows, rows.where("id = 'b'")).collect()}
    assert down == {("b", 0), ("c", 1), ("d", 1), ("f", 2)}
    seen = rows.withColumn("verification_state", F.when(F.col("id") == "b", "rejected").otherwise("verified"))
    chain = chains.chain_up(rows, rows.where("id = 'f'"))
    assert {(r.id, r.depth) for r in chains.visible(chain, seen, filters.RecordFilter(verification_state="verified")).collect()} == {("d", 1), ("a", 3)}


def test_chains_refuse_cycles(spark):
    rows = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b"), ("d", "a"), ("x", None), ("y", "x")], "id string, supersedes_record_id string")
    with pytest.raises(ValueError, match="cycle"):
        chains.chain_up(rows, rows)
    with pytest.raises(ValueError, match="cycle"):
        chains.chain_down(spark.createDataFrame([("a", "a")], rows.schema), rows)


def test_chains_of_many_starts(spark):
    """More rows than a recursive query may make."""
    rows = spark.range(700_000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 > 0, (F.col("id") - 1).cast("string")).alias("supersedes_record_id"))
    assert chains.chain_up(rows, rows).count() == sum(1 + k % 3 for k in range(700_000))


def test_drift_by_cases(spark):
    """Any shrinkage counts, to zero only from more; each part of a baseline may be missing."""
    cases = [
        (None, True, 1, "a", None, None, "probe_error"), (304, False, 0, "b", 9, "a", "none"), (503, True, 9, "a", 9, "a", "status_error"), (200, False, 9, "a", 9, "a", "regime_change"),
        (200, True, 0, "b", 9, "a", "count_zero"), (200, True, 0, "a", 0, "a", "none"), (200, True, 8, "b", 9, "a", "layout_shift"), (200, True, 8, "a", 9, "a", "count_delta"),
        (200, True, 8, "a", 9, None, "count_delta"), (200, True, 8, "b", None, "a", "layout_shift"), (200, True, -1, "a", 9, "a", "none"), (200, True, 12, "a", 9, "a", "none"), (200, True, 0, "z", None, None, "none"),
    ]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "id int, status int, markers boolean, n int, layout string, base int, base_layout string, want string")
    c = F.col
    kind = trust.drift(c("status"), c("markers"), c("n"), c("layout"), c("base"), c("base_layout"))
    found = rows.select("*", kind.alias("kind")).select("*", *trust.drift_report(c("kind"), F.lit("r"), c("status"), c("layout"))).collect()
    assert [r.kind for r in found] == [r.want for r in found]
    assert {r.dedup_key for r in found} == {None, "r:probe_error:transport", "r:status_error:503", "r:regime_change:markers", "r:count_zero:zero", "r:layout_shift:b", "r:count_delta:shrink"}
    assert {r.kind: r.freeze for r in found if r.freeze} == {"regime_change": True, "count_zero": True, "layout_shift": True}


def test_sample_ranks_by_seed_bytes(spark):
    import hashlib

    ids = [f"rec{k}" for k in range(40)]
    want = sorted(ids, key=lambda i: (hashlib.sha256((7).to_bytes(8, "big") + b":" + i.encode()).digest(), i))[:5]
    rows = spark.createDataFrame([("g", i) for i in ids], "g string, id string")
    assert {r.id for r in windows.seeded_sample(rows, "g", "id", 5, 7).collect()} == set(want)


def test_a_mention_without_a_year_may_mean_any(spark):
    ddl = "mention_id int, name string, identifier string, year int"
    mentions = spark.createDataFrame([(1, "n", None, None), (2, "n", "x", None), (3, "n", None, 1990), (4, "m", None, None)], ddl)
    aliases = spark.createDataFrame([("e1", "n", "y", 1900), ("e2", "m", None, 1800), ("e3", "m", None, 2000)], "entity_id string, name string, identifier string, first_year int")
    assert {r.mention_id: (r.entity_id, r.candidates) for r in trust.resolve(mentions, aliases, ["name"]).collect()} == {1: ("e1", 1), 2: (None, 0), 3: (None, 0), 4: (None, 2)}


def test_on_a_tie_the_lesser_identifier_moves(spark):
    rows = spark.createDataFrame([("e", "B9", "f1"), ("e", "A10", "f2"), ("g", "x", "f3"), ("g", "y", "f4"), ("g", "y", "f4"), ("h", "z", "f5")], "entity_id string, identifier string, filing_id string")
    assert {r.entity_id: r.moves for r in trust.split_identity(rows).collect()} == {"e": "A10", "g": "x"}


def test_a_broken_candidate_rejects_its_filing(spark):
    ddl = "filing_id string, ordinal int, regime_code string, backfill boolean, details map<string,string>, v int"
    rows = [("f1", 0, "uk", False, {"a": "1"}, 1), ("f1", 1, "uk", False, {}, None), ("f2", 0, "us_senate", True, {"counsel_name": "C", "k": "1"}, 2), ("f3", 0, "fr_hatvp_dia", False, {"type_declaration": "dspm2"}, None), ("f3", 1, "fr_hatvp_dia", False, {"type_declaration": "dia"}, 3), ("f4", 0, "ca", False, {}, 4)]
    c = spark.createDataFrame(rows, ddl)
    frozen, none = spark.createDataFrame([("ca",)], "regime_code string"), spark.createDataFrame([], "fingerprint string")
    checks, reviews = [(F.col("v").isNotNull(), "no_value")], [(F.col("v") > 1, "large")]
    out = publish.publish(c, ["v"], frozen, none, checks, reviews)
    assert {(r.filing_id, r.ordinal): r.outcome for r in out.outcome.collect()} == {("f1", 0): "filing_rejected", ("f1", 1): "filing_rejected", ("f2", 0): "inserted", ("f3", 0): "suppressed", ("f3", 1): "inserted", ("f4", 0): "frozen"}
    records = out.records.collect()
    assert {r.filing_id: dict(r.details) for r in records} == {"f2": {"k": "1"}, "f3": {"type_declaration": "dia"}}
    assert {(r.target_kind, r.reason) for r in out.reviews.collect()} == {("disclosure_record", "large"), ("filing", "redaction_fr_patrimony_unrepublishable"), ("regime", "publish_blocked_frozen")}
    assert {r.filing_id: r.suppressed for r in out.events.collect()} == {"f2": True, "f3": False}
    again = publish.publish(c, ["v"], frozen, out.records, checks, reviews)
    assert again.records.count() == 0 and {r.filing_id: r.replayed for r in again.counters.collect()} == {"f1": 0, "f2": 1, "f3": 1, "f4": 0}


def test_a_publication_read_once_is_not_stored(spark):
    """Each output of a plan that is not stored is what the stored one gives, and nothing is written for it."""
    ddl = "filing_id string, ordinal int, regime_code string, backfill boolean, details map<string,string>, v int"
    rows = [(f"f{k % 9}" if k % 10 else None, k // 9, ("uk", "ca", "us_senate", "fr_hatvp_dia", "br")[k % 9 % 5], k % 9 == 2, {"type_declaration": "dspm" if k % 4 == 0 else "dia", "counsel_name": "C"}, None if k == 45 else k) for k in range(60)]
    c = spark.createDataFrame(rows, ddl)
    frozen, none = spark.createDataFrame([("ca",), ("nowhere",)], "regime_code string"), spark.createDataFrame([], "fingerprint string")
    checks, reviews = [(F.col("v").isNotNull(), "no_value")], [(F.col("v") > 20, "large")]
    known = spark.createDataFrame(publish.publish(c.where("ordinal = 1"), ["v"], frozen, none, checks, reviews).records.select("fingerprint").collect(), "fingerprint string")
    kept, read = publish.publish(c, ["v"], frozen, known, checks, reviews), publish.publish(c, ["v"], frozen, known, checks, reviews, keep=False)
    for name in ("outcome", "records", "events", "reviews", "counters"):
        ours, theirs = getattr(read, name), getattr(kept, name)
        assert ours.columns == theirs.columns and sorted(map(str, ours.collect())) == sorted(map(str, theirs.collect()))
    assert {r.outcome for r in read.outcome.collect()} == {"frozen", "filing_rejected", "suppressed", "replay", "inserted"}
    plan = read.events._jdf.queryExecution().executedPlan().toString()
    assert "published-" not in plan and "published-" in kept.events._jdf.queryExecution().executedPlan().toString()


def test_a_filing_is_numbered_whole_or_not_at_all(spark):
    from statera.plans.domain import Domain

    lineitem = spark.createDataFrame([(o, 9 - n // 2, n) for o in (1, 2, 3, 12345678901, 12345678902) for n in range(4)], "l_orderkey long, l_linenumber int, l_partkey long")
    d = Domain(spark, "")
    d._made["lineitem"] = lineitem.selectExpr("l_orderkey", "l_partkey", "7L AS l_suppkey", "l_linenumber", *[f"1.5D AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")], "'N' AS l_returnflag", "'O' AS l_linestatus", "timestamp_ntz'2020-01-01' AS l_shipdate")
    some = spark.createDataFrame([("0000000002",), ("1234567890",), ("1234567890",), (None,)], "filing_id string")
    found = d.line_by_filing(some).select(d.line.columns)
    assert found.count() == 12 and sorted(map(str, found.collect())) == sorted(map(str, d.line.join(some.distinct(), "filing_id", "left_semi").select(d.line.columns).collect()))


def test_differing_paths_are_capped(spark):
    import json

    a, b = {f"k{k}": k for k in range(12)}, {f"k{k}": k + 1 for k in range(12)}
    rows = spark.createDataFrame([(json.dumps(a), json.dumps(b)), ('{"a":{"b":[1,2]}}', '{"a":{"b":[1,3],"c":null}}'), ("no", "{}")], "a string, b string")
    found = [r[0] for r in rows.select(consensus.differing_paths("a", "b")).collect()]
    assert found == [["$.k0", "$.k1", "$.k10", "$.k11", "$.k2", "$.k3", "$.k4", "$.k5"], ["$.a.b[1]", "$.a.c"], None]


def test_verdict_takes_the_first_failure_and_null_fails(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, -1)], "id int, v int")
    checks = [(F.col("v").isNotNull(), "missing"), (F.col("v") > 0, "negative")]
    assert {r.id: r.x for r in rows.select("id", trust.verdict(checks).alias("x")).collect()} == {1: "missing", 2: "ok", 3: "negative"}


def test_percent_of_nothing_is_null(spark):
    row = spark.createDataFrame([(1, 0), (1, 4)], "p int, t int").select(aggregates.percent(F.col("p"), "t").alias("x")).collect()
    assert [r.x for r in row] == [None, 25.0]


def test_scalars(spark):
    one = spark.createDataFrame([("1.234,56", "01ARZ3NDEKTSV4RRFFQ69G5FAV", "9/7/24", "12 000,5 EUR", "ABCD")], "a string, b string, c string, d string, e string")
    row = one.select(
        S.comma_decimal(F.col("a")).alias("a"), F.col("b").rlike(S.ULID).alias("b"), S.short_year_date(F.col("c")).alias("c"),
        S.digits_amount(F.col("d"), True).alias("d"), S.currency_token(F.col("d")).alias("e"), S.currency_token(F.col("e")).alias("f"),
    ).collect()[0]
    assert (str(row.a), row.b, row.c, str(row.d), row.e, row.f) == ("1234.56", True, dt.date(2024, 7, 9), "12000.50", "EUR", None)


def test_canonical_json_ignores_key_order(spark):
    rows = spark.createDataFrame([('{"b":[1,2],"a":{"d":null,"c":"é"}}',), ('{ "a": {"c":"é","d":null}, "b":[1, 2] }',)], "j string")
    found = {r[0] for r in rows.select(S.canonical_json(F.col("j"))).collect()}
    assert found == {'{"a":{"c":"é","d":null},"b":[1,2]}'}


def test_zip_index(spark, tmp_path):
    xml = "﻿<FinancialDisclosure><Member><DocID>1</DocID><FilingType>P</FilingType><Year>2024</Year><Last> Doe </Last></Member><Member><DocID>2</DocID><FilingType>O</FilingType><Year>2024</Year><DisclosureType>PTR</DisclosureType></Member><Member><DocID></DocID><FilingType>P</FilingType><Year>2024</Year></Member></FinancialDisclosure>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("2024FD.xml", xml)
        z.writestr("2024FD.txt", "no")
    (tmp_path / "2024.zip").write_bytes(data.getvalue())
    members = scans.index_members(scans.zip_members(scans.blobs(spark, f"file://{tmp_path}"), "FD.xml"))
    assert [(r.DocID, r.Last) for r in members.orderBy("position").collect()] == [("1", "Doe"), ("2", ""), ("", "")]
    assert {r.DocID for r in members.where(scans.is_transaction_report()).collect()} == {"1", "2"}


def test_delimited_with_aliases(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('"OLD_NAME";"V"\n"Jos\xe9";"1,5"\n'.encode("latin-1"))
    rows = scans.delimited(spark, f"file://{tmp_path}/a.csv", "NAME string, V string, W string", {"NAME": ("OLD_NAME",)}).collect()
    assert [tuple(r) for r in rows] == [("José", "1,5", None)]


def test_strict_json_refuses_unknown_keys(spark):
    rows = spark.createDataFrame([('{"id":1}',), ('{"id":2,"x":0}',)], "t string")
    ok = rows.where("t NOT LIKE '%x%'").select(scans.strict_json(F.col("t"), "id INT", ["id"]).alias("d")).collect()
    assert ok[0].d.id == 1
    with pytest.raises(Exception, match="unknown keys"):
        rows.select(scans.strict_json(F.col("t"), "id INT", ["id"])).collect()


def test_brazil(spark):
    doc = '{"consulta_cand":{"SQ_CANDIDATO":"9","NM_CANDIDATO":"N","SG_UF":"AC","DT_ELEICAO":"02/10/2022","ANO_ELEICAO":"2022"},"bem_candidato":[{"NR_ORDEM_BEM_CANDIDATO":"3","CD_TIPO_BEM_CANDIDATO":"12","DS_BEM_CANDIDATO":"Casa","VR_BEM_CANDIDATO":"1.000,50"}]}'
    a = adapters.ADAPTERS["br"]
    row = a.normalize(a.parse(spark.createDataFrame([("s", doc)], "sha256 string, text string"))).collect()[0]
    assert (row.asset_class, str(row.value_low), row.as_of_date, row.ordinal, row.filing_key) == ("real_estate", "1000.50", dt.date(2022, 10, 2), 3, "2022:AC:9")


def test_united_kingdom(spark):
    doc = '{"id":7,"summary":"A gift","registrationDate":"2026-06-28","category":{"id":3,"number":"2","name":"D"},"member":{"id":1,"nameDisplayAs":"M"},"fields":[{"name":"Sole","type":"Boolean","value":true},{"name":"Value","type":"Decimal","typeInfo":{"currencyCode":"GBP"},"value":"3400.00"}]}'
    a = adapters.ADAPTERS["uk_commons_register"]
    row = a.normalize(a.parse(spark.createDataFrame([("s", doc)], "sha256 string, text string"))).collect()[0]
    assert (row.filing_key, str(row.value_low), row.currency, row.notified_date) == ("7@0", "3400.00", "GBP", dt.date(2026, 6, 28))


def test_united_kingdom_values(spark):
    import json

    money = lambda v, c="GBP": {"name": "Value", "type": "Decimal", "typeInfo": {"currencyCode": c}, "value": v}
    text = lambda v: {"name": "ShareholdingThreshold", "type": "String", "value": v}
    donors = lambda *rows: {"name": "Donors", "type": "Donor[]", "values": [[{"name": "Name", "type": "String", "value": "D"}, *r] for r in rows]}
    cases = {
        "exact": (8, [text(adapters.PERCENTAGE), money("12.50")]),
        "open": (8, [text(adapters.OPEN_ENDED)]),
        "share": (8, [text(adapters.PERCENTAGE)]),
        "other": (8, [text("(iii) more")]),
        "bare": (8, []),
        "visit": (5, [donors([money("100.25")], [money("0.75")], [])]),
        "mixed": (5, [donors([money("1")], [money("1", "EUR")])]),
        "free": (5, [donors([])]),
        "donors elsewhere": (3, [donors([money("9")])]),
    }
    docs = [(k, json.dumps({"id": 1, "updatedDates": ["2026-01-01", "2026-02-01"], "category": {"id": c, "number": "1", "name": "n"}, "fields": f})) for k, (c, f) in cases.items()]
    a = adapters.ADAPTERS["uk_commons_register"]
    rows = a.normalize(a.parse(spark.createDataFrame(docs, "sha256 string, text string"))).collect()
    plain = lambda v: None if v is None else str(v)
    assert {r.filing_key for r in rows} == {"1@2"}
    assert {r.sha256: (plain(r.value_low), plain(r.value_high), r.currency, r.value_source, r.rejected) for r in rows} == {
        "exact": ("12.50", "12.50", "GBP", "value_field", False), "open": ("70000.00", None, "GBP", "shareholding_threshold", False),
        "share": (None, None, None, "none", False), "other": (None, None, None, "none", True), "bare": (None, None, None, "none", True),
        "visit": ("101.00", "101.00", "GBP", "sum_of_donors", False), "mixed": ("2.00", "2.00", "GBP", "sum_of_donors", True),
        "free": (None, None, None, "none", False), "donors elsewhere": (None, None, None, "none", False),
    }
    with pytest.raises(Exception, match="unknown keys"):
        a.parse(spark.createDataFrame([("s", '{"id":1,"news":2}')], "sha256 string, text string")).collect()


def test_listed_fields(spark):
    page = "<h2>Gifts</h2><dl><dt>From</dt><dd>A  B</dd></dl><h2>Posts</h2><ul><li>Chair</li></ul>"
    rows = spark.createDataFrame([(page,)], "t string").select(F.explode(scans.listed_fields("t")).alias("f")).select("f.*").collect()
    assert [tuple(r) for r in rows] == [("Gifts", "From", "A B"), ("Posts", None, "Chair")]


def test_exports_read_back(spark, tmp_path):
    import gzip
    import hashlib
    import json

    rows = spark.createDataFrame([("a", None, 1, {"k": "v"}), ("b", "x,y", 2, None)], "id string, note string, n int, details map<string,string>")
    rows = rows.withColumn("money", F.lit("1.50").cast("decimal(16,2)")).withColumn("at", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    exports.export_csv(rows.coalesce(1), f"file://{tmp_path}/csv")
    (file,) = (tmp_path / "csv").glob("part-*")
    assert gzip.decompress(file.read_bytes()).decode().splitlines()[1].startswith('a,,1,"{\\"k\\":\\"v\\"}",1.50,2024-01-02T03:04:05')
    exports.export_jsonl(rows.coalesce(1), f"file://{tmp_path}/json")
    (lines,) = (tmp_path / "json").glob("part-*")
    first = json.loads(gzip.decompress(lines.read_bytes()).decode().splitlines()[0])
    assert first["money"] == "1.50" and first["note"] is None and first["details"] == {"k": "v"}
    listed = exports.manifest(spark, f"file://{tmp_path}/csv", "2024-01-01", "CC0").collect()
    assert [(r.name, r.bytes, r.sha256) for r in listed] == [(file.name, file.stat().st_size, hashlib.sha256(file.read_bytes()).hexdigest())]


def test_signature_is_hmac(spark):
    import hashlib
    import hmac

    found = spark.createDataFrame([("payload é",)], "p string").select(exports.signed(F.col("p"), "secret")).collect()[0][0]
    assert found == hmac.new(b"secret", "payload é".encode(), hashlib.sha256).hexdigest()


def test_record_details_compose(spark):
    from statera.operators import filters, reads

    day = dt.datetime(2024, 1, 1)
    rows = [(f"r{k}", f"r{k - 1}" if k % 4 else None, "verified" if k != 2 else "unverified", day + dt.timedelta(days=k), "f", "g") for k in range(8)]
    records = spark.createDataFrame(rows, "id string, supersedes_record_id string, verification_state string, discovered_at timestamp, filing_id string, regime_id string")
    filings = spark.createDataFrame([("f", day.date(), "d")], "id string, filed_date date, raw_document_id string")
    documents, regimes = spark.createDataFrame([("d", "u", "s")], "id string, url string, sha string"), spark.createDataFrame([("g", "c")], "id string, code string")
    reader = filters.RecordFilter(verification_state="verified")
    out = {r.id: r for r in reads.record_details(records, records.where("id IN ('r1', 'r2', 'r3', 'r4')"), filings, documents, regimes, reader).collect()}
    chains_of = {k: ([m.id for m in r.supersedes], [m.id for m in r.superseded_by]) for k, r in out.items()}
    assert chains_of == {"r1": (["r0"], ["r3"]), "r3": (["r1", "r0"], []), "r4": ([], ["r5", "r6", "r7"])}  # r2 is hidden and walked through
    assert out["r1"].filing.filed_date == day.date() and out["r1"].document.sha == "s" and out["r1"].regime.code == "c"
    with pytest.raises(Exception, match="record without provenance"):
        reads.record_details(records, records, filings.limit(0), documents, regimes, reader).collect()
    circle = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "id string, supersedes_record_id string")
    with pytest.raises(ValueError, match="comes back"):
        reads.chain_of_few(circle, circle.where("id = 'a'"))
