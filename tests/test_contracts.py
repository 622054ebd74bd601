"""Compiled contracts: every contract with a case that keeps it and cases that do not."""

import json

import pytest
from pyspark.sql import functions as F

from statera.functions.details import CONTRACTS
from statera.operators import contracts


def found(spark, cases):
    rows = [(k, *key, text if isinstance(text, str) else json.dumps(text)) for k, (key, text) in enumerate(cases)]
    frame = spark.createDataFrame(rows, "k int, regime string, kind string, details string").repartition(2)
    out = frame.select("k", contracts.checked(CONTRACTS, F.col("regime"), F.col("kind"), F.col("details")).alias("breach")).collect()
    return [r.breach for r in sorted(out)]


SENATE = {"report_uuid": "u", "row_ordinal": 1, "row_number": "1", "asset_type_raw": "x", "amount_band_raw": "b", "transaction_type_raw": "t", "partial_sale": False, "filed_at_raw": "f"}
FRANCE = {
    "declaration_stem": "d", "declaration_uuid": "u", "entry_fields": {"a": "b"}, "is_modificative": False, "language": "fr", "montants": [{"amount": "1", "year": 2020}], "motif": "CREATION", "row_ordinal": 1, "section_tag": "s",
    "type_declaration": "dia", "value_source": "none",
}
UK = {"category_id": 1, "category_name": "c", "category_number": "1", "fields": [], "interest_id": 1, "member_id": 1, "published_date": "d", "rectified": True, "updated_dates": ["a"], "value_source": "none", "version": 1}


def nested(n):
    field = {"name": "n", "type": "t"}
    for _ in range(n):
        field = {"name": "n", "type": "t", "values": [[field]]}
    return [field]


def test_contracts(spark):
    senate, france, uk, fake = (k for k in (("us_senate", "transaction"), ("fr_hatvp_dia", "interest"), ("uk_commons_register", "interest"), ("fixture_fake", "transaction")))
    cases = [
        (senate, SENATE, "ok"), (senate, SENATE | {"ticker": None, "amendment_number": 2, "more": [1]}, "ok"), (senate, SENATE | {"row_ordinal": 1.0}, "ok"), (senate, SENATE | {"row_ordinal": 1.5}, "$.row_ordinal type"),
        (senate, SENATE | {"row_ordinal": 0}, "$.row_ordinal minimum"), (senate, SENATE | {"partial_sale": 0}, "$.partial_sale type"), (senate, SENATE | {"ticker": True}, "$.ticker type"), (senate, {}, "$.amount_band_raw required"), (senate, "null", "$ type"), (senate, "{", "$ json"),
        (("us_senate", "holding"), SENATE, "unregistered"), (france, FRANCE, "ok"), (france, FRANCE | {"motif": "creation"}, "$.motif enum"), (france, FRANCE | {"entry_fields": {"a": "b", "c": 1}}, "$.entry_fields.* type"),
        (france, FRANCE | {"montants": [{"amount": "1", "year": 1}, {"amount": "1"}]}, "$.montants[].year required"), (france, FRANCE | {"montants": {}}, "$.montants type"), (uk, UK, "ok"), (uk, UK | {"fields": nested(2)}, "ok"), (uk, UK | {"updated_dates": ["a", 1]}, "$.updated_dates[] type"),
        (uk, UK | {"fields": nested(3)}, "$.fields[].values[][].values[][].values[][] depth"), (uk, UK | {"fields": [{"name": "n"}]}, "$.fields[].type required"), (fake, {"amount_band_raw": "x", "source_ordinal": 0}, "ok"), (fake, {"amount_band_raw": "", "source_ordinal": 0}, "$.amount_band_raw minLength"),
        (fake, {"amount_band_raw": "x", "source_ordinal": 0, "z": 1}, "$.z unknown"),
    ]
    assert found(spark, [c[:2] for c in cases]) == [c[2] for c in cases]


def test_unknown_words_are_refused():
    with pytest.raises(ValueError, match="pattern"):
        contracts.breach({"type": "string", "pattern": "a"}, F.col("x"))
