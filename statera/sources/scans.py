"""Document scans: archives, XML and CSV members, JSON and HTML documents, links, content addresses.

Files come in through Spark's readers (``binaryFile``, ``csv``, ``json``); Python only opens one archive or page of a
row at a time, inside tasks.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMBER = T.StructType([T.StructField(n, T.StringType()) for n in ("DocID", "FilingType", "Year", "Prefix", "First", "Last", "Suffix", "StateDst", "DisclosureType")])


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a path as sha256, path, length and content."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("sha256"), "path", "length", "content")


def archived(blobs_: DataFrame, uri: Column) -> Column:
    """The scheme must be one that Spark's readers open here; anything else fails the row's query."""
    return F.when(F.split_part(uri, F.lit("://"), F.lit(1)).isin("file", "hdfs", "s3a", "viewfs"), uri).otherwise(F.raise_error(F.concat(F.lit("unsupported document address: "), uri)))


def zip_members(files: DataFrame, suffix: str, encoding: str = "utf-8") -> DataFrame:
    """(path, member, text) of the members of each archive whose name ends in the suffix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        if name.endswith(suffix):
                            yield pd.DataFrame({"path": [path], "member": [name], "text": [archive.read(name).decode(encoding).lstrip("﻿")]})

    return files.select("path", "content").mapInPandas(run, "path string, member string, text string")


def index_members(index: DataFrame) -> DataFrame:
    """The members of index documents (column text), fields trimmed, absent ones empty."""
    parts = F.regexp_extract_all("text", F.lit(r"(?s)<Member>(.*?)</Member>"), F.lit(0))
    parsed = index.select(F.posexplode(parts).alias("position", "xml")).select("position", F.from_xml("xml", MEMBER, {"rowTag": "Member"}).alias("m"))
    return parsed.select("position", *[F.trim(F.coalesce(f"m.{f.name}", F.lit(""))).alias(f.name) for f in MEMBER])


def is_transaction_report(filing_type: str = "FilingType", disclosure_type: str = "DisclosureType") -> Column:
    """A periodic transaction report in either of the two eras of the index."""
    named = (F.col("DocID") != "") & (F.col("Year") != "")
    return named & ((F.col(filing_type) == "P") | ((F.col(disclosure_type) == "PTR") & F.col(filing_type).isin("O", "A")))


def delimited(spark: SparkSession, path: str, schema: str, aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Latin-1 files with semicolons and a header; a column may have other names in other years."""
    rows = spark.read.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    have = set(rows.columns)
    wanted = T.StructType.fromDDL(schema)
    pick = lambda n: F.coalesce(*[F.col(c) for c in (n, *(aliases or {}).get(n, ())) if c in have] or [F.lit(None)])
    return rows.select(*[pick(f.name).cast(f.dataType).alias(f.name) for f in wanted])


def strict_json(text: Column, schema: str, keys: list[str]) -> Column:
    """The document by its schema; one with a key that is not listed fails the query rather than losing it."""
    unknown = F.array_except(F.json_object_keys(text), F.array(*map(F.lit, keys)))
    return F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown keys: "), F.array_join(unknown, ",")))).otherwise(F.from_json(text, schema, {"mode": "FAILFAST"}))


def document_links(pages: DataFrame, key: str, html: str = "html", folder: str = "/Register/", suffix: str = ".pdf") -> DataFrame:
    """key, href and stem of each page's links into ``folder`` to files with ``suffix``: the first of each file name without it.

    ``key`` tells pages apart; nothing else of a page goes along with its links.
    """
    found = F.regexp_extract_all(html, F.lit("href=([\"'])(.*?)\\1"), F.lit(2))
    rows = pages.select(key, F.posexplode(found).alias("position", "href")).where(F.contains("href", F.lit(folder)))
    file = F.element_at(F.split(F.regexp_extract("href", "^[^?#]*", 0), "/"), -1)
    rows = rows.withColumn("stem", F.when(F.endswith(file, F.lit(suffix)), F.substring(file, F.lit(1), F.char_length(file) - len(suffix)))).where("stem <> ''")
    return rows.groupBy(key, "stem").agg(F.min_by("href", "position").alias("href")).select(key, "href", "stem")


class _Fields(HTMLParser):
    """(section, term, text) of definition lists and list items; a heading holds until the next one."""

    def __init__(self):
        super().__init__()
        self.found, self.section, self.term, self.tag, self.text = [], None, None, None, []

    def handle_starttag(self, tag, attrs):
        if tag in ("h1", "h2", "h3", "dt", "dd", "li"):
            self.tag, self.text = tag, []

    def handle_endtag(self, tag):
        if tag != self.tag:
            return
        text, self.tag = " ".join("".join(self.text).split()), None
        if tag in ("h1", "h2", "h3"):
            self.section = text
        elif tag == "dt":
            self.term = text
        else:
            self.found.append({"section": self.section, "term": self.term if tag == "dd" else None, "text": text})

    def handle_data(self, data):
        if self.tag is not None:
            self.text.append(data)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("section", "term", "text")])))
def listed_fields(html: pd.Series) -> pd.Series:
    def fields(page):
        parser = _Fields()
        parser.feed(page or "")
        return parser.found

    return html.map(fields)


def cached_rows(wanted: DataFrame, files: DataFrame, table: DataFrame) -> DataFrame:
    """Cached extractions by (sha256, tag, model): from files first, then the table; missing ones are flagged, never made up."""
    key = ["sha256", "tag", "model"]
    out = wanted.join(files.withColumnRenamed("rows", "file_rows"), key, "left").join(table.withColumnRenamed("rows", "table_rows"), key, "left")
    return out.select(*key, F.coalesce("file_rows", "table_rows").alias("rows"), F.coalesce("file_rows", "table_rows").isNull().alias("missing"))
