"""Contracts of the details of records by regime and record type, in the JSON Schema words that contracts.py compiles."""

from __future__ import annotations

_TEXT, _FLAG, _LIST = {"type": "string"}, {"type": "boolean"}, {"type": "array"}
_TEXT_OR_NULL, _FLAG_OR_NULL = {"type": ["string", "null"]}, {"type": ["boolean", "null"]}
_FROM_0, _FROM_1 = {"type": "integer", "minimum": 0}, {"type": "integer", "minimum": 1}
_FROM_0_OR_NULL, _WHOLE_OR_NULL = {"type": ["integer", "null"], "minimum": 0}, {"type": ["integer", "null"]}
_TEXTS = {"type": "object", "additionalProperties": _TEXT}


def _upto(most: int) -> dict:
    return {"type": "integer", "minimum": 1, "maximum": most}


def _one_of(*values: str) -> dict:
    return {"type": "string", "enum": list(values)}


def _one_of_or_null(*values: str) -> dict:
    return {"anyOf": [_one_of(*values), {"type": "null"}]}


def _object(optional: tuple[str, ...] = (), **properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": [k for k in properties if k not in optional]}


# Fixed values of the domain: the keys of each contract, their types and ranges, and which may be absent.
_AUSTRALIA = dict(
    category_name=_TEXT, category_number=_upto(14), document_filename=_TEXT, electoral_division=_TEXT, entry_fields=_TEXTS, entry_text=_TEXT, language=_TEXT, owner_band=_one_of_or_null("self", "spouse", "dependent"),
    page_ordinal=_FROM_1, parliament_no=_FROM_0, row_ordinal=_FROM_1, source_flavour=_one_of("text_layer", "scanned_vision"), state=_TEXT, statement_date=_TEXT_OR_NULL,
)
_CANADA = dict(
    client_id=_TEXT, client_title=_TEXT_OR_NULL, declaration_id=_TEXT, declaration_type_raw=_TEXT, fields=_TEXTS, gift_circumstance=_TEXT_OR_NULL, gift_received_date=_TEXT_OR_NULL, gift_source=_TEXT_OR_NULL, h1_title=_TEXT, item_id=_TEXT_OR_NULL, language=_TEXT, law=_TEXT,
    no_longer_applicable=_FLAG, ociec_translation=_FLAG, row_ordinal=_FROM_1, section_label=_TEXT_OR_NULL, travel_dates_raw=_TEXT_OR_NULL, travel_destination=_TEXT_OR_NULL, travel_end=_TEXT_OR_NULL, travel_sponsor=_TEXT_OR_NULL, travel_start=_TEXT_OR_NULL,
)
_CANADA_OPTIONAL = ("client_title", "gift_circumstance", "gift_received_date", "gift_source", "item_id", "section_label", "travel_dates_raw", "travel_destination", "travel_end", "travel_sponsor", "travel_start")
_UK_FIELD = _object(("currency_code", "description", "value", "values"), currency_code=_TEXT_OR_NULL, description=_TEXT_OR_NULL, name=_TEXT, type=_TEXT, value={}, values={"type": ["array", "null"], "items": {"type": "array", "items": {"$ref": "#/$defs/field"}}})
CONTRACTS = {
    ("australia_register", "change_notification"): _object(("owner_band", "parliament_stamp", "statement_date", "submitted_date"), addition_deletion=_one_of("addition", "deletion"), **_AUSTRALIA, parliament_stamp=_TEXT_OR_NULL, submitted_date=_TEXT_OR_NULL),
    ("australia_register", "interest"): _object(("owner_band", "statement_date"), **_AUSTRALIA),
    ("br", "holding"): _object(
        asset_class=_one_of("equity", "bond", "fund", "option", "crypto", "commodity", "real_estate", "private", "other"), asset_description_raw=_TEXT, asset_type_code_raw=_TEXT, asset_type_label_raw=_TEXT,
        election_year={"type": "integer", "minimum": 0, "maximum": 65535}, last_updated_date_raw=_TEXT, last_updated_time_raw=_TEXT, line_item_ordinal=_FROM_1, value_raw=_TEXT,
    ),
    ("canada_ciec", "change_notification"): _object((*_CANADA_OPTIONAL, "date_of_change"), **_CANADA, date_of_change=_TEXT_OR_NULL),
    ("canada_ciec", "interest"): _object(_CANADA_OPTIONAL, **_CANADA),
    ("de_bundestag", "interest"): _object(
        ("amount_raw", "amount_year", "partner", "period"), amount_raw=_TEXT_OR_NULL, amount_year=_WHOLE_OR_NULL, category_name=_TEXT, category_number=_upto(8), ehrenamtlich=_FLAG, entry_text=_TEXT, language=_TEXT, mdb_id=_FROM_0, non_quantifiable=_FLAG, partner=_TEXT_OR_NULL,
        period=_one_of_or_null("monthly", "annual", "one_off"), profit_before_tax=_FLAG, row_ordinal=_FROM_1, value_source=_one_of("betragsgenau", "stufe_historical", "none"), wahlperiode=_FROM_1,
    ),
    ("eu_parliament_dpi", "interest"): _object(
        ("benefit_nature", "income_amount_raw", "income_currency", "periodicity"), benefit_nature=_TEXT_OR_NULL, declaration_date=_TEXT, dpi_uuid=_TEXT, entry_text=_TEXT, income_amount_raw=_TEXT_OR_NULL, income_currency=_TEXT_OR_NULL, language=_TEXT, mep_id=_FROM_0,
        parliamentary_term=_FROM_1, periodicity=_one_of_or_null("monthly", "quarterly", "annual", "one_off", "other"), row_ordinal=_FROM_1, section=_TEXT, value_source=_one_of("income_amount", "none", "unmapped_currency"), version_ts=_TEXT,
    ),
    ("fixture_fake", "transaction"): {**_object(amount_band_raw={"type": "string", "minLength": 1}, source_ordinal=_FROM_0), "additionalProperties": False},
    ("fr_hatvp_dia", "interest"): _object(
        ("brut_net", "organe"), brut_net=_TEXT_OR_NULL, declaration_stem=_TEXT, declaration_uuid=_TEXT, entry_fields=_TEXTS, is_modificative=_FLAG, language=_TEXT, montants={"type": "array", "items": _object(amount=_TEXT, year={"type": "integer"})},
        motif=_one_of("CREATION", "MODIFICATION", "SUPPRESSION"), organe=_TEXT_OR_NULL, row_ordinal=_FROM_1, section_tag=_TEXT, type_declaration=_TEXT, value_source=_one_of("montant_latest_year", "none"),
    ),
    ("uk_commons_register", "interest"): {
        **_object(
            ("parent_interest_id", "rectified_details", "registration_date", "shareholding_threshold_raw"), category_id=_FROM_0, category_name=_TEXT, category_number=_TEXT, fields={"type": "array", "items": {"$ref": "#/$defs/field"}}, interest_id=_FROM_1, member_id=_FROM_0,
            parent_interest_id=_FROM_0_OR_NULL, published_date=_TEXT, rectified=_FLAG, rectified_details=_TEXT_OR_NULL, registration_date=_TEXT_OR_NULL, shareholding_threshold_raw=_TEXT_OR_NULL, updated_dates={"type": "array", "items": _TEXT},
            value_source=_one_of("value_field", "shareholding_threshold", "sum_of_donors", "none"), version=_FROM_0,
        ),
        "$defs": {"field": _UK_FIELD},
    },
    ("us_house", "transaction"): _object(
        ("asset_type_code", "cap_gains_over_200", "comments", "description", "owner_source", "row_id", "subholding_of", "vehicle_location", "vehicle_owner_code"), amount_band_raw=_TEXT, asset_type_code=_TEXT_OR_NULL, cap_gains_over_200=_FLAG_OR_NULL, comments=_TEXT_OR_NULL,
        description=_TEXT_OR_NULL, doc_id=_TEXT, filing_status_raw=_TEXT, owner_source=_one_of_or_null("row", "vehicle", "default_self"), partial_sale=_FLAG, row_id=_TEXT_OR_NULL, row_ordinal=_FROM_1, signed_date=_TEXT, subholding_of=_TEXT_OR_NULL, transaction_type_raw=_TEXT,
        vehicle_location=_TEXT_OR_NULL, vehicle_owner_code=_TEXT_OR_NULL,
    ),
    ("us_senate", "transaction"): _object(
        ("amendment_number", "asset_detail", "comment", "ticker"), amendment_number=_FROM_0_OR_NULL, amount_band_raw=_TEXT, asset_detail=_TEXT_OR_NULL, asset_type_raw=_TEXT, comment=_TEXT_OR_NULL, filed_at_raw=_TEXT, partial_sale=_FLAG, report_uuid=_TEXT, row_number=_TEXT,
        row_ordinal=_FROM_1, ticker=_TEXT_OR_NULL, transaction_type_raw=_TEXT,
    ),
}
