"""Archives of delimited tables: members stream out as blocks of records, headers say where each column stands.

A member is never held whole, whatever its size; records are cut where a line ends outside a quoted cell.  Python only
unpacks and finds these ends; cells are split and named by built-in functions.

Defined results: members whose name does not match, blank lines and members without a header line give no rows.  An
archive that cannot be opened, or a member that breaks off, is one row with fault ``unreadable``; its checksum stands at
its end, so rows before the break may be damaged too, and ``sound`` leaves out the archive whole.  A record of other width than its header has fault ``width``, a member without a wanted column ``columns``
(each of its records); cells of such rows are null, so nothing is filed under a wrong name.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.staging import stored

#: a block ends with the record that reaches either
BLOCK_CHARS, BLOCK_RECORDS = 1 << 20, 4096

_BLOCK = pa.schema([("path", pa.string()), ("member", pa.string()), ("first", pa.int64()), ("header", pa.string()), ("records", pa.list_(pa.string())), ("fault", pa.string())])
_BLOCK_DDL = "path string, member string, first long, header string, records array<string>, fault string"


def _open_after(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted cell is open after a line; a quote opens a cell only where the cell begins."""
    at, end = 0, len(line)
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            inside = False
        elif line.startswith('"', at):
            at, inside = at + 1, True
            continue
        at = line.find(sep, at)
        if at < 0 or at >= end:
            return False
        at += 1


def _records(lines: Iterator[str], sep: str) -> Iterator[str]:
    parts, inside = [], False
    for line in lines:
        inside = _open_after(line, inside, sep) if inside or '"' in line else False
        parts.append(line)
        if not inside:
            record = "".join(parts).rstrip("\r\n")
            parts = []
            if record:
                yield record
    if parts:
        yield "".join(parts).rstrip("\r\n")


def blocks(files: DataFrame, member: str, encoding: str = "ISO-8859-1", sep: str = ";") -> DataFrame:
    """path, member, first (number of the block's first record), header, records and fault of members that match a pattern whole.

    ``files`` has path and content (``binaryFile``); member names are matched from their start to their end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = re.compile(member)
        row = lambda *v: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(v, _BLOCK.types)], schema=_BLOCK)
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                path, name, first, header = path.as_py(), None, 0, None
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_buffer() or b"")) as archive:
                        for name in archive.namelist():
                            if not wanted.fullmatch(name):
                                continue
                            first, header, held, size = 0, None, [], 0
                            with archive.open(name) as raw:
                                for record in _records(io.TextIOWrapper(raw, encoding=encoding, newline=""), sep):
                                    if header is None:
                                        header = record
                                        continue
                                    held.append(record)
                                    size += len(record)
                                    if size >= BLOCK_CHARS or len(held) == BLOCK_RECORDS:
                                        yield row(path, name, first, header, held, None)
                                        first, held, size = first + len(held), [], 0
                            if held:
                                yield row(path, name, first, header, held, None)
                        name = None
                except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, UnicodeDecodeError):
                    yield row(path, name, first, header, None, "unreadable")

    return files.select("path", "content").mapInArrow(run, _BLOCK_DDL)


def cells(record: Column, sep: str = ";") -> Column:
    """The cells of a record, quotes around a cell removed and doubled ones inside halved; empty cells are empty texts."""
    s = re.escape(sep)
    found = F.regexp_extract_all(F.concat(F.lit(sep), record), F.lit(f'(?s){s}("[^"]*+(?:""[^"]*+)*+"(?={s}|$)|[^{s}]*+)'), F.lit(1))
    quoted = lambda c: F.startswith(c, F.lit('"')) & F.endswith(c, F.lit('"')) & (F.char_length(c) > 1)
    return F.transform(found, lambda c: F.when(quoted(c), F.replace(F.substring(c, F.lit(2), F.char_length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def tables(files: DataFrame, member: str, columns: dict[str, tuple[str, ...]], encoding: str = "ISO-8859-1", sep: str = ";") -> DataFrame:
    """path, member, position, the wanted columns as texts, and fault (null where the row is sound).

    ``columns`` has for each wanted column the names it goes by in one year or another; the first that a header has counts.
    """
    found = blocks(files, member, encoding, sep).withColumn("_names", cells(F.col("header"), sep))
    places = {}
    for k, names in enumerate(columns.values()):
        at = F.lit(0)
        for n in reversed(names):
            here = F.array_position("_names", n)
            at = F.when(here > 0, here).otherwise(at)
        places[f"_at{k}"] = at.cast("int")
    found = found.withColumns(places)
    lacking = F.coalesce(F.least(*[F.col(p) for p in places], F.lit(1)) == 0, F.lit(False))
    rows = found.withColumn("_lacking", lacking).select(
        "path", "member", "first", "fault", "_lacking", F.size("_names").alias("_width"), *places, F.posexplode_outer("records").alias("_k", "_record")
    )
    rows = rows.withColumn("_cells", cells(F.col("_record"), sep))
    fault = F.coalesce(F.col("fault"), F.when(F.col("_lacking"), "columns").when(F.size("_cells") != F.col("_width"), "width"))
    rows = rows.withColumn("fault", fault)
    value = lambda p: F.when(F.col("fault").isNull(), F.get("_cells", F.col(p) - 1))
    return rows.select("path", "member", (F.col("first") + F.coalesce("_k", F.lit(0))).alias("position"), *[value(p).alias(c) for p, c in zip(places, columns)], "fault")


def sound(rows: DataFrame) -> DataFrame:
    """Rows of archives without any fault: one bad row rejects its archive, so no part of a damaged table is filed.

    The rows are stored, so archives are unpacked once.
    """
    rows = stored(rows, "archive_rows")
    return rows.join(rows.where("fault is not null").select("path").distinct(), "path", "left_anti").drop("fault")


# States that have a file of their own, and the columns of their tables of declared assets with the
# names of other years.
STATES = ("AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO", "MA", "MT", "MS", "MG", "PA", "PB", "PR", "PE", "PI", "RJ", "RN", "RS", "RO", "RR", "SC", "SP", "SE", "TO")
ASSETS = {
    "SQ_CANDIDATO": ("SQ_CANDIDATO",),
    "SG_UF": ("SG_UF",),
    "DT_ELEICAO": ("DT_ELEICAO",),
    "ANO_ELEICAO": ("ANO_ELEICAO",),
    "NR_ORDEM_BEM_CANDIDATO": ("NR_ORDEM_BEM_CANDIDATO", "NR_ORDEM_CANDIDATO"),
    "CD_TIPO_BEM_CANDIDATO": ("CD_TIPO_BEM_CANDIDATO",),
    "DS_TIPO_BEM_CANDIDATO": ("DS_TIPO_BEM_CANDIDATO",),
    "DS_BEM_CANDIDATO": ("DS_BEM_CANDIDATO",),
    "VR_BEM_CANDIDATO": ("VR_BEM_CANDIDATO",),
    "DT_ULT_ATUAL_BEM_CANDIDATO": ("DT_ULT_ATUAL_BEM_CANDIDATO", "DT_ULTIMA_ATUALIZACAO"),
    "HH_ULT_ATUAL_BEM_CANDIDATO": ("HH_ULT_ATUAL_BEM_CANDIDATO", "HH_ULTIMA_ATUALIZACAO"),
}


def declared_assets(files: DataFrame) -> DataFrame:
    """Rows of the tables of the states; the nationwide table and other members of an archive are left alone.

    A candidate's number means different people in different states: group by it together with SG_UF.
    """
    return tables(files, rf"(?:.*_)?(?:{'|'.join(STATES)})\.csv", ASSETS)
