"""Attribute rows, drifting headers, broken lines and packed fields on small fixtures."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readloom.functions import values as V
from readloom.operators import badrows, drift, eav, packed
from readloom.plans import general

T0 = dt.datetime(2024, 1, 1)
ROWS = "entity_id long, attribute string, value string, loaded_at timestamp, extra string, __text string"
ATTRIBUTES = [
    eav.Attribute("DP", "Integer"), eav.Attribute("CI", "Float", 2), eav.Attribute("DB", "Flag", 0),
    eav.Attribute("ST", "Character"), eav.Attribute("NOTE", "String"), eav.Attribute("GONE", "Integer"),
]


def rows(spark, data):
    return spark.createDataFrame([(e, a, v, T0 + dt.timedelta(hours=h), "x", "y") for e, a, v, h in data], ROWS)


@pytest.mark.parametrize("text, integer, number", [
    ("+007", "7", "7.0000"), ("-0", "0", "-0.0000"), (" 12\t", "12", "12.0000"), ("1.", None, "1.0000"),
    (".5", None, "0.5000"), ("1e3q", None, None), ("-inf", None, "-Inf"), ("+NaN", None, "NaN"), ("٥١", None, None),
    ("99999999999999999999999", "99999999999999999999999", None), ("0x10", None, None), ("1d", None, None), ("", None, None),
])
def test_numbers(spark, text, integer, number):
    row = spark.createDataFrame([(text,)], "v string").select(
        V.canonical_integer(F.col("v")).alias("i"), V.canonical_float(F.col("v")).alias("f")
    ).first()
    assert row.i == integer
    assert number is None or row.f == number


def test_pivot_types_duplicates_and_bad_values(spark):
    data = [
        (1, "dp", "5", 0), (1, "INFO/DP", "x7", 5), (1, " Dp\t", "+06", 2), (1, "DP", "+06", 2), (1, "ci", "1, nan", 0),
        (1, "CI", "1,2,3", 9), (1, "db", None, 0), (1, "DB", "maybe", 3), (1, "ST", "-", 0), (1, "ST", "++", 1),
        (1, "NOTE", "  a,b ", 0), (1, "NOTE", "n/A", 4), (1, None, "1", 0), (1, "odd", "1", 0), (2, "odd", "1", 0),
        (None, "dp", "1", 0), (3, "DP", "99999999999999999999", 0), (3, "DB", "f", 0),
    ]
    wide = eav.pivot_attributes(rows(spark, data), ATTRIBUTES, prefix="info/").orderBy("entity_id").collect()
    assert [r.entity_id for r in wide] == [1, 2, 3]
    one = wide[0]
    assert (one.DP, one.DB, one.ST, one.NOTE, one.GONE) == (6, True, None, "a,b", None)
    assert one.CI[0] == 1.0 and one.CI[1] != one.CI[1]
    assert wide[1].DP is None and wide[1].uncast == []
    assert wide[2].DP is None and wide[2].uncast == ["DP"] and wide[2].DB is False
    plain = eav.pivot_attributes(rows(spark, data), ATTRIBUTES, prefix="info/", typed=False)
    cells = {tuple(r) for r in eav.filled_cells(plain, "entity_id").collect()}
    assert (3, "DP", "99999999999999999999") in cells and (1, "CI", "1.0000,NaN") in cells and len(cells) == 6


def test_pivot_without_declarations_and_empty(spark):
    wide = eav.pivot_attributes(rows(spark, [(1, "a", "1", 0), (1, "b", "x", 0), (2, "a", "2.5", 0)]), None)
    assert wide.schema["a"].dataType.simpleString() == "double" and wide.count() == 2
    with pytest.raises(ValueError):
        eav.pivot_attributes(rows(spark, [(1, "a", "1", 0), (1, "b", "1", 0)]), None, max_attributes=1)
    empty = rows(spark, [])
    assert eav.pivot_attributes(empty, ATTRIBUTES).count() == 0
    assert eav.discover_attributes(empty).count() == 0


def test_discovery(spark):
    found = {r.attribute_key: r for r in eav.discover_attributes(
        rows(spark, [(1, "A", "1", 0), (1, "a ", "2", 0), (1, "b", "1.5", 0), (1, "b", "?", 0), (1, None, "1", 0), (1, "f", None, 0)])
    ).collect()}
    assert (found["a"].n_rows, found["a"].inferred_type) == (2, "Integer")
    assert (found["b"].n_missing, found["b"].inferred_type) == (1, "Float")
    assert None in found and found["f"].inferred_type == "Flag"


LINES = [
    '##INFO=<ID=DP,Number=1,Type=Integer,Description="Reads, all">',
    '##INFO=<ID=DP,Number=1,Type=integer,Description="Reads, all">',
    '##INFO=<Number=1, Type="Float", Description="a \\"b\\" ID=Z,", ID="AF">\r',
    "##FORMAT=<ID=GT,Type=String,Description=Alleles of it>",
    "##INFO=<Type=Integer>", "##contig=<ID=1>", "#CHROM", None, "",
]


def test_declarations(spark):
    headers = spark.createDataFrame([(1, i, line, "z") for i, line in enumerate(LINES)], "file_id long, line_no int, line string, type string")
    found = {(r.column_name, r.field_id): r.declared for r in drift.declared_fields(headers).collect()}
    assert set(found) == {("INFO", "DP"), ("INFO", "AF"), ("FORMAT", "GT")}
    assert found["INFO", "AF"]["description"] == 'a "b" ID=Z,' and found["INFO", "AF"]["type"] == "Float"
    assert found["FORMAT", "GT"]["description"] == "Alleles of it" and found["INFO", "DP"]["type"] == "Integer"


def test_changes(spark):
    def line(i, kind, about):
        return f'##INFO=<ID={i},Type={kind},Description="{about}">'

    headers = spark.createDataFrame(
        [(10, 1, line("A", "Integer", "depth")), (10, 2, line("B", "Float", "freq!")), (10, 3, line("C", "Float", "gone")),
         (11, 1, line("A", "FLOAT", "Depth")), (11, 2, line("B2", "Integer", "Freq")), (11, 3, line("N", "Flag", "")),
         (12, 1, line("A", "Float", "other words")), (12, 2, line("B2", "integer", "freq")), (12, 3, line("n", "Flag", ""))],
        "file_id long, line_no int, line string",
    )
    files = spark.createDataFrame(
        [(12, "s", T0 + dt.timedelta(2)), (10, "s", T0), (11, "s", T0 + dt.timedelta(1)), (11, "s", T0 + dt.timedelta(1)), (13, None, T0)],
        "file_id long, series_id string, created_at timestamp",
    )
    changes = drift.field_changes(drift.declared_fields(headers), drift.file_pairs(files))
    assert {tuple(r) for r in changes.collect()} == {
        (11, "INFO", "type", "A", ""), (11, "INFO", "renamed", "B", "B2"), (11, "INFO", "type", "B2", ""),
        (11, "INFO", "removed", "C", ""), (11, "INFO", "added", "N", ""), (12, "INFO", "removed", "N", ""),
        (12, "INFO", "added", "n", ""),
    }
    none = drift.field_changes(drift.declared_fields(headers.limit(0)), drift.file_pairs(files.limit(0)))
    assert none.count() == 0


def test_typed_projection_reports_failed_casts(spark):
    paths = spark.createDataFrame(
        [(1, 5, "INFO", "DP", "7"), (1, 5, "INFO", "XQ", "x"), (1, 6, "INFO", "DP", "many"), (1, 6, "INFO", "OLD", "1.5"), (1, 6, None, None, None)],
        "file_id long, record_id long, column_name string, field_id string, value string",
    )
    ids = spark.createDataFrame([(1, "INFO", "OLD", "AF")], "file_id long, column_name string, field_id string, canonical_id string")
    out = drift.project_typed(paths, ids, [eav.Attribute("DP", "Integer"), eav.Attribute("AF", "Float")]).orderBy("record_id").collect()
    assert (out[0].DP, out[0].others, out[0].failed_casts) == (7, {"XQ": "x"}, {})
    assert (out[1].DP, out[1].AF, out[1].failed_casts) == (None, 1.5, {"DP": "many"})
    headers = spark.createDataFrame([(1, 1, '##INFO=<ID=DP,Type=Integer,Description="Depth">'), (1, 2, '##INFO=<ID=NONE,Type=Flag>')], "file_id long, line_no int, line string")
    stats = drift.path_type_statistics(drift.path_statistics(drift.declaration_paths(headers), paths))
    assert {(r.path, r.declared_type, r.raw_type): r.n_values for r in stats.collect()} == {
        ("INFO/DP", "Integer", "Integer"): 1, ("INFO/DP", "Integer", "String"): 1, ("INFO/XQ", None, "String"): 1, ("INFO/OLD", None, "Float"): 1,
    }


def variant_tables(spark, folder, records):
    """The tables of problem 2 with one file; ``records`` are record_id, info, format and samples."""
    header = [
        '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">', '##INFO=<ID=OLD,Number=1,Type=Float,Description="Share">',
        '##FORMAT=<ID=GT,Number=1,Type=String,Description="Alleles">', '##FORMAT=<ID=Reads,Number=1,Type=Integer,Description="Bases, good">',
    ]
    declared = [
        ("INFO", "DP", 1, "Integer", "Depth"), ("INFO", "AF", 1, "Float", "Share"), ("FORMAT", "GT", 1, "String", "Alleles"),
        ("FORMAT", "DP", 1, "Integer", "Bases good"), ("FORMAT", "PL", 3, "Integer", "Likelihoods"),
    ]
    for name, data, schema in (
        ("vcf_headers", [(1, i, line) for i, line in enumerate(header)], "file_id long, line_no int, line string"),
        ("column_fields", declared, "column_name string, field_id string, number_of_values int, type string, description string"),
        ("vcf_records", [(1, *r) for r in records], "file_id long, record_id long, info string, format string, samples array<string>"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_records_without_info_keep_their_row(spark, tmp_path):
    folder = variant_tables(spark, tmp_path, [
        (1, "DP=7;OLD=0.5", None, []), (2, None, None, []), (3, "", None, []), (4, ".", None, []), (5, " ", None, None),
        *[(i, f"DP={i};OLD=0.{i}", None, []) for i in range(10, 70)],
    ])
    out = {r.record_id: r for r in general.p2_table(spark, folder).collect()}
    assert sorted(out) == [1, 2, 3, 4, 5, *range(10, 70)]
    assert (out[1].DP, out[1].AF) == (7, 0.5)
    assert all((out[i].file_id, out[i].DP, out[i].AF, out[i].others, out[i].failed_casts) == (1, None, None, {}, {}) for i in (2, 3, 4, 5))


def test_format_values_of_every_sample(spark, tmp_path):
    folder = variant_tables(spark, tmp_path, [
        (1, "DP=7", "GT:Reads:PL:XQ", ["0/1:3:1,2,3:a", "1/1:many:4:b", None]), (2, None, "GT;Reads", ["0/0"]), (3, "DP=8", ".", ["0/1:5"]),
        *[(i, f"DP={i}", "GT:Reads", [f"0/1:{i}"]) for i in range(10, 70)],
    ])
    out = {r.record_id: r for r in general.p2_table(spark, folder).collect()}
    assert len(out) == 63
    one = out[1]
    assert (one.DP, one["FORMAT/GT"], one["FORMAT/DP"], one["FORMAT/PL"]) == (7, ["0/1", "1/1", None], [3, None, None], [[1, 2, 3], None, None])
    assert one.others == {"FORMAT/XQ/1": "a", "FORMAT/XQ/2": "b", "FORMAT/XQ/3": ""}
    assert one.failed_casts == {"FORMAT/DP/2": "many", "FORMAT/PL/2": "4"}
    assert (out[2].DP, out[2]["FORMAT/GT"], out[2]["FORMAT/DP"]) == (None, ["0/0"], [None])
    assert (out[3].DP, out[3]["FORMAT/GT"], out[3].others) == (8, [None], {"FORMAT/#1/1": "0/1", "FORMAT/#2/1": "5"})
    assert (out[10].DP, out[10]["FORMAT/DP"]) == (10, [10])
    stats = {(r.path, r.raw_type): r.n_values for r in general.p2_types(spark, folder).collect()}
    assert (stats["FORMAT/Reads", "Integer"], stats["FORMAT/Reads", "String"], stats["FORMAT/Reads", "Missing"]) == (61, 1, 2)
    assert stats["INFO/DP", "Integer"] == 62


COLUMNS = [badrows.FileColumn("id", "String", True), badrows.FileColumn("n", "Integer", True), badrows.FileColumn("x", "Float", False)]
CASES = [
    ("id\tn\tx", "none"), ("﻿id\tn\tx\r", "none"), ("# hi", "none"), (None, "none"), ("\t \t\r", "none"), ("a\t1\t2.5", None),
    ("a\t1\t2.5\r", None), ('"a\tb"\t"1"\t', None), ('"a ""q"""\t+1\tNaN', None), ('a"\t1\t1', "quoting"), ('"a"x\t1', "quoting"),
    ('"a\t1\t1', "quoting"), (' "a"\t1\t1', "quoting"), ("a\t1", "column_count"), ("a\t1\t2\t3", "column_count"), ("a\t\t1", "invalid_value"),
    ("a\tone\t1", "invalid_value"), (".\t1\t1", "invalid_value"), ("a\t1\t1,5", "invalid_value"), ("a\t1 1\t", "invalid_value"),
    ("a\nb\t1\t-inf", None), ("a\rb\t1\tn/a", None), ("\t" * 30000, "none"), ("a" + "\t1" * 30000, "column_count"),
    ("x" * 100000 + "\t1\t1", None), ('"' + "y\t" * 50000 + '"\t1\t1', None), ('"' * 5 + "\t1\t", "quoting"),
]


def test_lines(spark):
    lines = spark.createDataFrame([(i, c[0], "f", "r") for i, c in enumerate(CASES)], "line_id int, c0 string, fields string, reason string")
    judged = {r.line_id: r for r in badrows.classify_lines(lines, COLUMNS).collect()}
    assert {i: judged[i].reason if i in judged else "none" for i in range(len(CASES))} == {i: c[1] for i, c in enumerate(CASES)}
    good = {r.line_id: r for r in badrows.typed_rows(badrows.classify_lines(lines, COLUMNS), COLUMNS, ["line_id"]).collect()}
    assert good[7].id == "a\tb" and good[7].n == 1 and good[7].x is None
    assert good[8].id == 'a "q"' and good[20].id == "a\nb" and good[21].id == "a\rb" and good[20].x == float("-inf")
    assert badrows.classify_lines(lines.limit(0), COLUMNS).count() == 0


def _fields_by_hand(line):
    out, field, i = [], "", 0
    while True:
        if i < len(line) and line[i] == '"':
            i += 1
            while True:
                end = line.find('"', i)
                if end < 0:
                    return None
                field += line[i:end]
                i = end + 1
                if i < len(line) and line[i] == '"':
                    field += '"'
                    i += 1
                else:
                    break
            if i < len(line) and line[i] != "\t":
                return None
        else:
            while i < len(line) and line[i] != "\t":
                if line[i] == '"':
                    return None
                field += line[i]
                i += 1
        out.append(field)
        if i >= len(line):
            return out
        field, i = "", i + 1


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet='a1"\t .\r\n,', max_size=14), min_size=40, max_size=120))
def test_lines_against_a_plain_reader(spark, texts):
    columns = [badrows.FileColumn(f"k{i}", "String", False) for i in range(3)]
    frame = spark.createDataFrame(list(enumerate(texts)), "line_id int, c0 string")
    judged = {r.line_id: r for r in badrows.classify_lines(frame, columns).collect()}
    for i, text in enumerate(texts):
        if not text.strip(" \t\r\n") or text.startswith("#"):
            assert i not in judged
            continue
        expected = _fields_by_hand(text.removesuffix("\r"))
        if expected is None:
            assert judged[i].reason == "quoting", text
        elif len(expected) != 3:
            assert judged[i].reason == "column_count", text
        else:
            assert judged[i].reason is None and judged[i].fields == expected, text


def test_unpack(spark):
    plain = [(i, f"DP={i};NOTE=word{i % 3};DB", "GT:GQ:PL", "A,C") for i in range(60)]
    odd = [
        (100, 'NOTE="low; high" DP=3 DB', "GT ; GQ", '"A","<DEL>"'), (101, "DB;|DP=4\tNOTE=word1", '"GT":"PL"', "A/C"), (102, None, "", "."),
        (103, ";;DP=5;.;", ":GT:", "A,,C[1:2["), (104, "DP=6 ;'NOTE=a; b'; DB", "GT/GQ", "C A"), (None, "DP=1", None, None), (100, "DB", None, None),
        (105, 'NOTE="say ""hi""; now";DP=1', "GT", "*|A"), (106, "x" * 50000, "GT", "A" * 50000),
    ]
    frame = spark.createDataFrame(plain + odd, "record_id long, info string, format string, alt string").withColumn("item", F.lit(1))
    got = {}
    for r in packed.unpack(frame, "record_id", packed.VCF_PACKINGS).collect():
        got.setdefault((r.record_id, r.column_name), {})[r.item_pos, r.item] = 1
    read = {k: [i for _, i in sorted(v)] for k, v in got.items()}
    assert read[7, "info"] == ["DP=7", "NOTE=word1", "DB"] and read[7, "format"] == ["GT", "GQ", "PL"]
    assert read[101, "info"] == ["DB", "DP=4", "NOTE=word1"] and read[101, "format"] == ["GT", "PL"] and read[101, "alt"] == ["A", "C"]
    assert read[100, "alt"] == ["A", "<DEL>"] and read[100, "format"] == ["GT", "GQ"]
    assert (102, "info") not in read and (102, "alt") not in read
    assert read[103, "info"] == ["DP=5"] and read[103, "alt"] == ["A", "C[1:2["] and read[103, "format"] == ["GT"]
    assert read[104, "info"] == ["DP=6", "NOTE=a; b", "DB"] and read[104, "alt"] == ["C", "A"]
    assert read[105, "info"] == ['NOTE=say "hi"; now', "DP=1"] and read[None, "info"] == ["DP=1"]
    assert read[106, "info"] == ["x" * 50000]
    assert packed.unpack(frame.limit(0), "record_id", packed.VCF_PACKINGS).count() == 0
