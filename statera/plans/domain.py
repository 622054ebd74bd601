"""Domain relations over the driver's tables, one SQL text for both engines.

Each view is a plain projection or join in the SQL that Spark and DuckDB share.  ``views`` gives them as DataFrames
(lazy: a view that no query reads is never planned), ``oracle`` as common table expressions before a DuckDB query.
Money is integer cents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: closed vocabularies (fixed values of the domain)
RECORD_TYPES = ("transaction", "holding", "interest", "change_notification")
SIDES = ("buy", "sell", "exchange")
STATES = ("unverified", "verified", "corrected", "disputed")

VIEWS = {
    "jurisdiction": "SELECT cast(r_regionkey AS string) AS id, r_name AS name FROM {region}",
    "regime": "SELECT cast(n_nationkey AS string) AS id, n_name AS code, cast(n_regionkey AS string) AS jurisdiction_id FROM {nation}",
    "politician": """
        SELECT lpad(cast(c_custkey AS string), 8, '0') AS id, c_name AS canonical_name, c_mktsegment AS body,
               cast(c_nationkey AS string) AS regime_id, cast(c_custkey % 400 AS string) AS identifier,
               cast(1950 + c_custkey % 70 AS int) AS birth_year
        FROM {customer}""",
    "politician_alias": """
        SELECT lpad(cast(c_custkey AS string), 8, '0') AS politician_id,
               concat(lower(c_mktsegment), ' ', cast(c_custkey % 97 AS string)) AS alias
        FROM {customer} WHERE c_custkey % 3 <> 0""",
    "filing": """
        SELECT lpad(cast(o_orderkey AS string), 10, '0') AS id, lpad(cast(o_custkey AS string), 8, '0') AS politician_id,
               cast(c_nationkey AS string) AS regime_id, o_orderstatus AS status, cast(o_orderdate AS date) AS filed_date,
               o_orderdate AS discovered_at, lpad(cast(o_orderkey % 977 AS string), 6, '0') AS raw_document_id,
               o_orderpriority AS priority
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "numbered_line": """
        SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
                 l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn,
               cast(round(l_extendedprice * 100) AS bigint) AS cents
        FROM {lineitem} l""",
    "line": """
        SELECT concat(lpad(cast(l_orderkey AS string), 10, '0'), lpad(cast(rn AS string), 3, '0')) AS id,
               lpad(cast(l_orderkey AS string), 10, '0') AS filing_id, cast(rn AS int) AS ordinal,
               concat('asset ', cast(l_partkey AS string)) AS asset_description_raw, lpad(cast(l_partkey AS string), 8, '0') AS instrument_id,
               CASE l_linenumber % 4 WHEN 0 THEN 'holding' WHEN 1 THEN 'interest' WHEN 2 THEN 'change_notification'
                    ELSE 'transaction' END AS record_type,
               concat('class', cast(l_partkey % 9 AS string)) AS asset_class,
               CASE WHEN l_linenumber % 4 = 3 THEN CASE l_returnflag WHEN 'R' THEN 'sell' WHEN 'A' THEN 'buy'
                    ELSE 'exchange' END END AS side,
               CASE WHEN l_linenumber % 4 = 3 THEN cast(l_shipdate AS date) END AS transaction_date,
               CASE WHEN l_linenumber % 4 = 0 THEN cast(l_shipdate AS date) END AS as_of_date,
               CASE WHEN l_partkey % 13 <> 0 THEN cents - cents % 100000 END AS low_cents,
               CASE WHEN l_partkey % 13 <> 0 AND l_partkey % 10 <> 0 THEN
                    CASE WHEN l_partkey % 7 = 0 THEN cents - cents % 100000 ELSE cents - cents % 100000 + 1500000 END END AS high_cents,
               CASE l_suppkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' WHEN 2 THEN 'USD' ELSE 'BRL' END AS currency,
               CASE l_suppkey % 5 WHEN 0 THEN 'self' WHEN 1 THEN 'spouse' WHEN 2 THEN 'child' WHEN 3 THEN 'joint' END AS owner,
               CASE l_returnflag WHEN 'N' THEN 'unverified' WHEN 'A' THEN 'verified' ELSE 'disputed' END AS verification_state,
               cast(round(l_discount * 100) AS int) AS confidence_loss
        FROM numbered_line""",
    "record": """
        SELECT l.*, f.politician_id, f.regime_id, f.filed_date AS notified_date, f.discovered_at,
               coalesce(l.transaction_date, f.filed_date, l.as_of_date) AS event_date,
               lag(l.id) OVER (PARTITION BY l.filing_id ORDER BY l.id) AS supersedes_record_id
        FROM line l JOIN filing f ON l.filing_id = f.id""",
    "pipeline_run": """
        SELECT lpad(cast(event_id AS string), 10, '0') AS id, concat('adapter', cast(user_id % 7 AS string)) AS adapter,
               cast(user_id % 25 AS string) AS regime_id,
               CASE event_type WHEN 'view' THEN 'discover' WHEN 'click' THEN 'fetch' WHEN 'purchase' THEN 'parse'
                    WHEN 'signup' THEN 'normalize' ELSE 'publish' END AS stage,
               CASE WHEN event_id % 11 = 0 THEN 'failed' WHEN event_id % 17 = 0 THEN 'running' ELSE 'succeeded' END AS status,
               ts AS started_at, value AS seconds, props AS stats
        FROM {events}""",
    "usage_event": "SELECT event_id AS id, user_id, ts AS at, cast(event_id % 5 = 0 AS boolean) AS billed FROM {events}",
    "review_task": """
        SELECT lpad(cast(event_id AS string), 10, '0') AS id,
               CASE event_id % 3 WHEN 0 THEN 'disclosure_record' WHEN 1 THEN 'filing' ELSE 'regime' END AS target_kind,
               CASE event_id % 3 WHEN 0 THEN concat(lpad(cast(1 + user_id % 1000 AS string), 10, '0'), '001')
                    WHEN 1 THEN lpad(cast(1 + user_id % 1000 AS string), 10, '0')
                    ELSE concat(cast(user_id % 25 AS string), ':drift') END AS target_id,
               concat('reason_', event_type) AS reason, cast(event_id % 4 AS int) AS priority,
               CASE WHEN event_id % 5 < 2 THEN 'open' ELSE 'resolved' END AS status, ts AS created_at,
               CASE WHEN event_id % 5 >= 2 THEN cast(user_id % 96 AS int) END AS hours
        FROM {events}""",
    "attempt": """
        SELECT concat(id, '.1') AS attempt_id, id AS task_id, status AS task_status, target_id AS record_id, created_at AS at,
               CASE priority WHEN 0 THEN 'confirm' WHEN 1 THEN 'reject' ELSE 'edit' END AS verdict, cast(id AS bigint) AS n
        FROM review_task WHERE target_kind = 'disclosure_record'
        UNION ALL SELECT concat(id, '.2'), id, status, target_id, created_at, CASE priority WHEN 2 THEN 'confirm' WHEN 3 THEN 'reject' ELSE 'edit' END, cast(id AS bigint) + 1
        FROM review_task WHERE target_kind = 'disclosure_record' AND cast(id AS bigint) % 4 = 0""",
    "raw_document": """
        SELECT lpad(cast(page_id AS string), 6, '0') AS id, url, html AS body, sha256 AS sha FROM (
          SELECT page_id, url, html, {sha256}(html{bits}) AS sha256 FROM {pages}) p""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "documents")
NTZ = {"orders": ["o_orderdate"], "lineitem": ["l_shipdate"], "events": ["ts"]}


class Domain:
    """Tables and domain views of one data directory, each loaded or planned when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS and name not in TABLES:
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._view(name) if name in VIEWS else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]

    def line_by_filing(self, filings: DataFrame | None = None) -> DataFrame:
        """``line``, dealt by filing before its lines are numbered: one shuffle for the numbering and for what groups or joins by filing_id.

        With ``filings`` (filing_id) only their lines are numbered: those of a filing are kept or left out together.
        """
        key = "lpad(cast(l_orderkey AS string), 10, '0')"
        lineitem = self.lineitem.repartition(F.expr(key)).withColumn("filing_id", F.expr(key))
        if filings is not None:
            lineitem = lineitem.join(filings.select("filing_id").hint("shuffle_hash"), "filing_id", "left_semi")
        numbered = VIEWS["numbered_line"].replace("PARTITION BY l_orderkey", "PARTITION BY filing_id, l_orderkey")  # an order has one filing_id
        numbered_line = self.spark.sql(numbered, lineitem=lineitem)
        return self.spark.sql(VIEWS["line"].replace(f"{key} AS filing_id", "filing_id").replace("FROM numbered_line", "FROM {numbered_line}"), numbered_line=numbered_line)

    def _view(self, name: str) -> DataFrame:
        text = VIEWS[name].replace("{sha256}", "sha2").replace("{bits}", ", 256")
        for inner in ("numbered_line", "line", "filing", "review_task"):
            text = text.replace(f"FROM {inner}", f"FROM {{{inner}}}").replace(f"JOIN {inner} ", f"JOIN {{{inner}}} ")
        used = {t: getattr(self, t) for t in (*TABLES, *VIEWS) if f"{{{t}}}" in text}
        return self.spark.sql(text, **used)


def oracle(query: str) -> str:
    """DuckDB SQL: the domain views as common table expressions, then the query."""
    parts = []
    for name, text in VIEWS.items():
        for t in TABLES:
            text = text.replace(f"{{{t}}}", t)
        parts.append(f"{name} AS ({text.replace('{sha256}', 'sha256').replace('{bits}', '')})")
    return "WITH RECURSIVE " + ",\n".join(parts) + ("," if query.lstrip().upper().startswith("WITH ") else "\n") + query.lstrip().removeprefix("WITH ").removeprefix("WITH")
