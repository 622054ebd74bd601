"""Source adapters: bronze documents to silver rows to gold candidates, for the sources whose documents are text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import scans
from .base import SourceAdapter
from .senate import Senate


class Brazil(SourceAdapter):
    """Candidates' assets: one JSON document of a candidate and the assets declared."""

    regime = "br"
    identity_columns = ("sq_candidato", "sg_uf", "election_year_raw")
    _SCHEMA = (
        "consulta_cand STRUCT<SQ_CANDIDATO: STRING, NM_CANDIDATO: STRING, SG_UF: STRING, DT_ELEICAO: STRING, ANO_ELEICAO: STRING>, "
        "bem_candidato ARRAY<STRUCT<NR_ORDEM_BEM_CANDIDATO: STRING, CD_TIPO_BEM_CANDIDATO: STRING, DS_TIPO_BEM_CANDIDATO: STRING, "
        "DS_BEM_CANDIDATO: STRING, VR_BEM_CANDIDATO: STRING, DT_ULT_ATUAL_BEM_CANDIDATO: STRING, HH_ULT_ATUAL_BEM_CANDIDATO: STRING>>"
    )

    def parse(self, bronze: DataFrame) -> DataFrame:
        d = bronze.select("sha256", F.from_json("text", self._SCHEMA).alias("d"))
        d = d.select("sha256", "d.consulta_cand", F.posexplode("d.bem_candidato").alias("position", "b"))
        return d.select(
            "sha256",
            "position",
            F.col("consulta_cand.SQ_CANDIDATO").alias("sq_candidato"),
            F.col("consulta_cand.NM_CANDIDATO").alias("nm_candidato"),
            F.col("consulta_cand.SG_UF").alias("sg_uf"),
            F.col("consulta_cand.DT_ELEICAO").alias("dt_eleicao_raw"),
            F.col("consulta_cand.ANO_ELEICAO").alias("election_year_raw"),
            F.col("b.NR_ORDEM_BEM_CANDIDATO").alias("line_item_ordinal_raw"),
            F.col("b.CD_TIPO_BEM_CANDIDATO").alias("asset_type_code_raw"),
            F.col("b.DS_TIPO_BEM_CANDIDATO").alias("asset_type_label_raw"),
            F.col("b.DS_BEM_CANDIDATO").alias("asset_description_raw"),
            F.col("b.VR_BEM_CANDIDATO").alias("value_raw"),
            F.col("b.DT_ULT_ATUAL_BEM_CANDIDATO").alias("last_updated_date_raw"),
            F.col("b.HH_ULT_ATUAL_BEM_CANDIDATO").alias("last_updated_time_raw"),
        )

    def normalize(self, silver: DataFrame) -> DataFrame:
        value = S.comma_decimal(F.col("value_raw"))
        kind = S.mapped(F.col("asset_type_code_raw"), S.BR_ASSET_CLASSES, "other")
        ordinal = F.col("line_item_ordinal_raw").try_cast("int")
        details = F.struct(
            "asset_type_code_raw", "asset_type_label_raw", kind.alias("asset_class"), "asset_description_raw", "value_raw", F.col("election_year_raw").try_cast("int").alias("election_year"), ordinal.alias("line_item_ordinal"),
            "last_updated_date_raw", "last_updated_time_raw",
        )
        return silver.select(
            "sha256",
            F.concat_ws(":", "election_year_raw", "sg_uf", "sq_candidato").alias("filing_key"),
            F.lit("holding").alias("record_type"),
            kind.alias("asset_class"),
            "asset_description_raw",
            S.day_first_date(F.col("dt_eleicao_raw")).alias("as_of_date"),
            value.alias("value_low"),
            value.alias("value_high"),
            F.lit("BRL").alias("currency"),
            ordinal.alias("ordinal"),
            F.to_json(details, {"ignoreNullFields": "false"}).alias("details"),
        )


# Categories of registered interests with value rules of their own, and the two threshold texts.
VISITS, SHAREHOLDINGS = 5, 8
OPEN_ENDED, OPEN_ENDED_LOW = "(ii) Other shareholdings, valued at more than £70,000", "70000.00"
PERCENTAGE = "(i) Shareholdings: over 15% of issued share capital"


class UnitedKingdom(SourceAdapter):
    """Registered interests: one JSON document per interest with named fields.

    Values: the money field named Value, exact; shareholdings without one by their threshold text, of which one is an
    open interval and one says nothing of value; visits by the sum of what each donor gave, in one currency.  A
    document with unknown keys fails the query; one whose threshold or donors fit no rule is ``rejected``.
    """

    regime = "uk_commons_register"
    identity_columns = ("interest_id",)
    _FIELD = "name: STRING, type: STRING, typeInfo: STRUCT<currencyCode: STRING>, value: STRING"
    _SCHEMA = (
        "id INT, summary STRING, registrationDate STRING, updatedDates ARRAY<STRING>, category STRUCT<id: INT, number: STRING, name: STRING>, "
        f"member STRUCT<id: INT, nameDisplayAs: STRING>, fields ARRAY<STRUCT<{_FIELD}, values: ARRAY<ARRAY<STRUCT<{_FIELD}>>>>>"
    )
    #: top-level keys of a document
    _KEYS = ("id", "summary", "parentInterestId", "registrationDate", "publishedDate", "updatedDates", "category", "member", "fields", "links", "rectified", "rectifiedDetails")

    def parse(self, bronze: DataFrame) -> DataFrame:
        d = bronze.select("sha256", scans.strict_json(F.col("text"), self._SCHEMA, list(self._KEYS)).alias("d"))
        return d.select(
            "sha256",
            F.col("d.id").alias("interest_id"),
            F.coalesce(F.size("d.updatedDates"), F.lit(0)).alias("version"),
            F.col("d.category.id").alias("category_id"),
            F.col("d.category.number").alias("category_number_raw"),
            F.col("d.member.id").alias("member_id"),
            F.col("d.member.nameDisplayAs").alias("member_name_raw"),
            F.col("d.summary").alias("summary_raw"),
            F.col("d.registrationDate").alias("registration_date_raw"),
            F.col("d.fields").alias("fields_raw"),
        )

    def normalize(self, silver: DataFrame) -> DataFrame:
        is_money = lambda f: (f["name"] == "Value") & f["value"].isNotNull() & f["typeInfo"]["currencyCode"].isNotNull()
        money = F.get(F.filter("fields_raw", is_money), 0)
        threshold = F.get(F.filter("fields_raw", lambda f: (f["name"] == "ShareholdingThreshold") & f["value"].isNotNull()), 0)["value"]
        donors = F.flatten(F.flatten(F.transform(F.filter("fields_raw", lambda f: f["type"] == "Donor[]"), lambda f: F.coalesce(f["values"], F.array()))))
        given = F.filter(donors, is_money)
        amounts = F.transform(given, lambda f: f["value"].try_cast("decimal(16,2)"))
        total = F.aggregate(amounts, F.lit(0).cast("decimal(16,2)"), lambda a, x: (a + x).cast("decimal(16,2)"))
        currencies = F.array_distinct(F.transform(given, lambda f: f["typeInfo"]["currencyCode"]))
        silver = silver.withColumns({"_exact": money["value"].try_cast("decimal(16,2)"), "_currency": money["typeInfo"]["currencyCode"], "_threshold": threshold, "_given": F.size(given), "_total": total, "_currencies": currencies})
        plain, share, visit = money.isNotNull(), F.col("category_id") == SHAREHOLDINGS, (F.col("category_id") == VISITS) & (F.col("_given") > 0)
        open_low = F.when(F.col("_threshold") == OPEN_ENDED, F.lit(OPEN_ENDED_LOW).cast("decimal(16,2)"))
        exact = F.when(plain, F.col("_exact")).when(~share & visit, F.col("_total"))
        source = F.when(plain, "value_field").when(share & open_low.isNotNull(), "shareholding_threshold").when(share, "none").when(visit, "sum_of_donors").otherwise("none")
        broken = F.when(plain, F.col("_exact").isNull()).when(share, ~F.coalesce(F.col("_threshold").isin(OPEN_ENDED, PERCENTAGE), F.lit(False))).when(visit, (F.size("_currencies") > 1) | F.col("_total").isNull()).otherwise(False)
        return silver.select(
            "sha256",
            F.concat_ws("@", F.col("interest_id").cast("string"), F.col("version").cast("string")).alias("filing_key"),
            F.lit("interest").alias("record_type"),
            F.col("summary_raw").alias("asset_description_raw"),
            F.try_to_date("registration_date_raw", "yyyy-MM-dd").alias("notified_date"),
            F.coalesce(exact, F.when(~plain & share, open_low)).alias("value_low"),
            exact.alias("value_high"),
            F.when(plain, F.col("_currency")).when(share, F.when(open_low.isNotNull(), "GBP")).when(visit, F.get("_currencies", 0)).alias("currency"),
            source.alias("value_source"),
            broken.alias("rejected"),
        )


ADAPTERS = {a.regime: a for a in (Brazil(), UnitedKingdom(), Senate())}
