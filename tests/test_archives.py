"""Archives of delimited tables: blocks, quoting, aliases, faults."""

import csv
import io
import zipfile

import pytest

from statera.sources import archives


def packed(members, cut=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text.encode("latin-1"))
    return out.getvalue()[:cut]


def files(spark, *contents):
    return spark.createDataFrame([(f"a{k}", c) for k, c in enumerate(contents)], "path string, content binary")


def written(rows, quoting=csv.QUOTE_ALL, end="\r\n"):
    out = io.StringIO()
    csv.writer(out, delimiter=";", quoting=quoting, lineterminator=end).writerows(rows)
    return out.getvalue()


COLUMNS = {"A": ("A",), "B": ("B", "OLD_B")}


def test_cells_and_aliases(spark):
    odd = [["1", 'say "x"; y'], ["2", "two\r\nlines\n\nand more"], ["3", ""], ["4", 'in"side'], ["5", '"'], ["6", "çã"], ["7", '""'], ["8", ";"]]
    new = written([["A", "B"], *odd])
    old = written([["OLD_B", "x", "A"], *[[b, "-", a] for a, b in odd]], csv.QUOTE_MINIMAL, "\n")
    found = archives.tables(files(spark, packed({"t_SP.csv": new, "t_RJ.csv": old, "t_BRASIL.csv": new, "leiame.pdf": "x"})), r".*_(?:SP|RJ)\.csv", COLUMNS)
    got = sorted((r.member, r.position, r.A, r.B, r.fault) for r in found.collect())
    assert got == sorted((m, k, a, b, None) for m in ("t_SP.csv", "t_RJ.csv") for k, (a, b) in enumerate(odd))


def test_bare_quotes_and_blank_lines(spark):
    text = 'A;B\n\n1;in"side;x\n2;a"b\n\n3;"ab"c\n4;"open;5\n6;7\n'
    got = [(r.position, r.A, r.B, r.fault) for r in archives.tables(files(spark, packed({"m.csv": text})), r"m\.csv", COLUMNS).orderBy("position").collect()]
    assert got == [(0, None, None, "width"), (1, "2", 'a"b', None), (2, "3", '"ab"c', None), (3, None, None, "width")]


def test_blocks_keep_numbers(spark, monkeypatch):
    rows = [[str(k), f"{k}\n;{k}" * (k % 7)] for k in range(20000)]
    blocks = archives.blocks(files(spark, packed({"m.csv": written([["A", "B"], *rows])})), r"m\.csv")
    assert blocks.count() >= 5
    assert max(len(r.records) for r in blocks.collect()) <= archives.BLOCK_RECORDS
    got = archives.tables(files(spark, packed({"m.csv": written([["A", "B"], *rows])})), r"m\.csv", COLUMNS).orderBy("position").collect()
    assert [[r.A, r.B] for r in got] == rows and [r.position for r in got] == list(range(20000))


def test_faults(spark):
    whole = packed({"m.csv": written([["A", "C"], ["1", "2"]])})
    broken = packed({"m.csv": written([["A", "B"], *[[str(k), str(k * 7919 % 10007)] for k in range(50000)]])})
    torn = bytearray(broken)
    torn[len(torn) // 2] ^= 0xFF
    empty = packed({"m.csv": ""})
    only = packed({"m.csv": "A;B\n"})
    got = archives.tables(files(spark, whole, b"no archive", bytes(torn), empty, only, None, b""), r"m\.csv", COLUMNS)
    faults = {(r.path, r.fault) for r in got.where("fault is not null").select("path", "fault").collect()}
    # the checksum of a torn member comes last, so what stands before it may be odd as well
    assert faults - {("a2", "width")} == {("a0", "columns"), ("a1", "unreadable"), ("a2", "unreadable"), ("a5", "unreadable"), ("a6", "unreadable")}
    assert got.where("path in ('a3', 'a4')").count() == 0
    assert {r.path for r in archives.sound(got).collect()} == set()
    assert got.where("fault is not null and (A is not null or B is not null)").count() == 0


def test_states_only(spark):
    header = [list(archives.ASSETS)]
    older = [[n[-1] for n in archives.ASSETS.values()]]
    row = [["10549", "BA", "01/10/2006", "2006", "1", "12", "Casa", "Casa", "1000,00", "01/10/2006", "12:00:00"]]
    made = packed({"bem_2006_BA.csv": written(older + row), "bem_2006_PE.csv": written(header + row), "bem_2006_BRASIL.csv": written(header + row), "bem_2006_ba.csv": written(header + row), "SP.csv": written(header + row), "leiame_SP.pdf": "x"})
    got = archives.declared_assets(files(spark, made)).collect()
    assert sorted(r.member for r in got) == ["SP.csv", "bem_2006_BA.csv", "bem_2006_PE.csv"]
    assert all([r[c] for c in archives.ASSETS] == row[0] and r.fault is None for r in got)


@pytest.mark.parametrize("line, inside, after", [('a;"b', False, True), ('x";y', True, False), ('x"";y', True, True), ('a"b;"', False, True), ('"";""', False, False), ("", True, True)])
def test_open_after(line, inside, after):
    assert archives._open_after(line, inside, ";") is after
