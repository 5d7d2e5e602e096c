"""Indels, reads and annotated elements on small fixtures."""

import datetime as dt
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from readloom.operators import annotation, indels, reads
from readloom.plans import reference


def placements(genome, start, from_, to):
    """Every (start, bases) at which an indel of the same size gives the same sequence."""
    gone = len(from_.replace("-", ""))
    cut = start + 1
    edited = genome[:cut] + to.replace("-", "") + genome[cut + gone :]
    k = max(len(from_), len(to))
    out = []
    for s in range(-1, len(genome)):
        if from_.startswith("-"):
            if genome[: s + 1] + edited[s + 1 : s + 1 + k] + genome[s + 1 :] == edited:
                out.append(s)
        elif s + 1 + k <= len(genome) and genome[: s + 1] + genome[s + 1 + k :] == edited:
            out.append(s)
    return out


def test_equivalent_regions_span_all_placements():
    draw = random.Random(6)
    for _ in range(400):
        genome = "".join(draw.choice("AC") for _ in range(24))
        start = draw.randrange(4, 16)
        if draw.random() < 0.5:
            unit = "".join(draw.choice("AC") for _ in range(draw.randint(1, 3)))
            from_, to = "-" * len(unit), unit
        else:
            k = draw.randint(1, 3)
            from_, to = genome[start + 1 : start + 1 + k], "-" * k
        region = indels.equivalent_region(genome, 0, start, from_, to)
        where = placements(genome, start, from_, to)
        assert region["start"] == min(where), (genome, start, from_, to)
        reach = max(where) + 1 + (0 if from_.startswith("-") else len(from_))
        assert region["end"] == reach
        left, right = region["start"] + 1, region["end"]
        assert region["from"].replace("-", "") == genome[left:right]
        gone = len(from_.replace("-", ""))
        edited = genome[: start + 1] + to.replace("-", "") + genome[start + 1 + gone :]
        assert genome[:left] + region["to"].replace("-", "") + genome[right:] == edited


def test_equivalent_indels_over_blocks(spark):
    genome = spark.createDataFrame([("c", "ACGT" * 4 + "GGGGGG" + "TACG" * 4)], "target string, sequence string")
    blocks = indels.genome_blocks(genome, 8)
    assert blocks.count() == 5
    rows = spark.createDataFrame([("c", 17, "G", "-"), ("c", 17, "-", "G"), ("x", 5, "A", "-"), ("c", 900, "A", "-")], "target string, start long, `from` string, `to` string")
    got = {(r.target, r.start, r["from"]): r.region for r in indels.equivalent_indels(rows, blocks, 8).collect()}
    assert (got["c", 17, "G"].start, got["c", 17, "G"].end, got["c", 17, "G"]["from"], got["c", 17, "G"].to) == (15, 22, "GGGGGG", "-GGGGG")
    assert (got["c", 17, "-"]["from"], got["c", 17, "-"].to) == ("-GGGGGG", "GGGGGGG")
    assert got["x", 5, "A"] is None and got["c", 900, "A"] is None


def test_realignment(spark):
    genome = "ACGTACGTTTGACCATGCATCCGA"
    blocks = indels.genome_blocks(spark.createDataFrame([("c", genome)], "target string, sequence string"), 16)
    # The read lacks GA after the tenth base, aligned without a gap it differs behind it.
    read = genome[4:10] + genome[12:20]
    told = [{"at": i, "to": b} for i, b in enumerate(read) if genome[4 + i] != b]
    frame = spark.createDataFrame([(1, "c", 4, 14, told), (2, "c", 0, 8, [])], "read_id int, target string, position long, length long, variations array<struct<at:int,`to`:string>>")
    found = indels.realign(frame, spark.createDataFrame([("c", 10, 2), ("c", 12, 1)], "target string, start long, length long"), blocks, 16, 16).collect()
    assert [(r.read_id, r.start, r.length, r.forward, r.score) for r in found] == [(1, 10, 2, True, len(told))]


def test_entropic_filter(spark):
    rows = [("t", 1, s, f"A{i}", "-", 3) for s in "xy" for i in range(2)] + [("t", 2, "x", "A", "-", 1), ("t", 2, "y", "A", "-", 1)]
    df = spark.createDataFrame(rows, "target string, position int, sample string, `from` string, `to` string, n int")
    assert {r.position for r in indels.entropic_filter(df).collect()} == {2}
    got = spark.createDataFrame([("AA-ACC",)], "s string").select(indels.repeat_length(F.col("s")).alias("r"), indels.gap_length(F.col("s")).alias("g")).first()
    assert (got.r, got.g) == (2, 1)


def test_gene_counts_and_shared_segments(spark):
    segments = spark.createDataFrame([("t", "g", 0, 10), ("t", "g", 30, 40), ("t", "h", 35, 45), ("t", "h", 60, 70)], "target string, annotation_id string, start long, end long")
    reads_ = spark.createDataFrame([("t", 5, 8), ("t", 12, 20), ("t", 8, 12), ("t", 39, 50), ("t", 100, 110)], "target string, start long, end long")
    got = {r.annotation_id: r.n for r in annotation.gene_counts(reads_, segments, 16, 8).collect()}
    assert got == {"g": 3, "h": 1}
    assert {(r.annotation_id, r.start) for r in annotation.shared_segments(segments, 16).collect()} == {("g", 0), ("h", 60)}


def test_formulas(spark):
    value = annotation.combine_by_formula(F.col("r"), F.col("w"), "FORMULA2")
    got = [r.v for r in spark.createDataFrame([(0.0, 5.0), (7.0, 0.0), (10.0, 10.0)], "r double, w double").select(value.alias("v")).collect()]
    assert got[:2] == [0.0, 7.0] and got[2] == pytest.approx(10 * 2.718281828 ** -1.57361718748031)


def test_informative_and_pairs(spark):
    df = spark.createDataFrame([(0.0, float("nan"), 0.0), (0.0, 0.0, 2.0)], "a double, b double, c double")
    assert annotation.informative_columns(df, ["a", "b", "c"]) == ["c"]
    s = spark.createDataFrame([("s1", "A"), ("s2", "A"), ("s3", "B")], "sample string, grp string")
    assert {tuple(r) for r in annotation.sample_pairs(s).collect()} == {("s1", "s2", "within"), ("s1", "s3", "between"), ("s2", "s3", "between")}
    with pytest.raises(ValueError):
        annotation.sample_pairs(s, 2)


def test_read_operators(spark):
    df = spark.createDataFrame([("q", "ACGTACGT", [1, 2, 3, 4, 5, 6, 7, 8]), ("e", "", []), ("n", None, None)], "id string, s string, q array<int>")
    cut = {r.id: (r.s, r.q) for r in reads.trim_to(df, "s", "q", 2, 3).collect()}
    assert cut["q"] == ("CGT", [2, 3, 4]) and cut["e"] == ("", [])
    changed = df.select("id", reads.mutate(F.col("s"), F.col("id"), 1).alias("m"), "s").where("id = 'q'").first()
    assert sum(a != b for a, b in zip(changed.m, changed.s)) == 1 and len(changed.m) == 8
    genes = spark.createDataFrame([(g, f"{g}{i}") for g in "abc" for i in range(3)], "gene string, transcript string")
    files = reads.split_by_gene(genes, "gene", "transcript", 2).collect()
    assert len(files) == 9
    for f in {r.file for r in files}:
        inside = [r.gene for r in files if r.file == f]
        assert len(inside) == len(set(inside)) <= 2
    quality = spark.createDataFrame([("IIII",), ("!!",), (None,), ("",)], "t string")
    assert reads.guess_encoding(quality, "t").first().encoding == "Sanger"
    sex = spark.createDataFrame([("f", "X")] * 3 + [("m", "chrX"), ("m", "Y")], "sample string, target string")
    assert {r["sample"]: r.sex for r in reads.infer_sex(sex, "sample", "target").collect()} == {"f": "female", "m": "male"}


def test_genotype_codes(spark):
    code = annotation.code_genotype(F.col("g"), F.lit("A"), F.array(F.lit("C"), F.lit("G")))
    got = [r.c for r in spark.createDataFrame([("A/C",), ("G",), ("T/A",)], "g string").select(code.alias("c")).collect()]
    assert got == ["0/1", "2/2", "./0"]


def test_gene_counts_of_every_annotation_against_brute_force(spark, tmp_path):
    draw = random.Random(8)
    items = [(k, n, draw.randrange(40), draw.randrange(200), draw.randint(1, 50), draw.choice("ANR")) for k in range(1, 61) for n in range(1, 5)]
    epoch = dt.date(1970, 1, 1)
    spark.createDataFrame(
        [(k, n, s, epoch + dt.timedelta(d), float(q), f, 0.0) for k, n, s, d, q, f in items],
        "l_orderkey long, l_linenumber int, l_suppkey long, l_shipdate date, l_quantity double, l_returnflag string, l_discount double",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    hits = [(s % 10, d, d + 2) for _, _, s, d, _, f in items if f == "A"]
    expected = {}
    for gene in range(1, 61):
        segments = sorted({(d, d + 5) for k, n, _, d, _, _ in items if k == gene and n <= 3})
        reach = [max(e for _, e in segments[: i + 1]) for i in range(len(segments))]
        gaps = [(reach[i], segments[i + 1][0]) for i in range(len(segments) - 1) if segments[i + 1][0] > reach[i]]
        mine = [(s, e) for t, s, e in hits if t == gene % 10]
        expected[gene] = sum(s < reach[-1] and e > segments[0][0] for s, e in mine) - sum(a <= s and e <= b for s, e in mine for a, b in gaps)
    got = {r.annotation_id: r.n for r in reference.gene_counts(spark, str(tmp_path)).collect()}
    assert got == expected


def test_shared_segments_against_brute_force(spark):
    draw = random.Random(5)
    rows = []
    for target, span, genes in (("t", 60, 4), ("u", 3000, 12), ("v", 3000, 2)):
        for _ in range(90):
            start = draw.randrange(span)
            rows.append((target, f"g{draw.randrange(genes)}", start, start + draw.choice([0, 1, 2, 5, 5, 40, 700 if draw.random() < 0.1 else 3])))
    rows += [(None, "g1", 1, 9), ("t", None, 1, 9), ("t", "g1", None, 9), ("t", "g1", 5, None)] + rows[:7]
    plain = [r for r in rows if None not in r and r[2] < r[3]]
    shared = {a for a in plain if any(a[0] == b[0] and a[1] != b[1] and a[2] < b[3] and b[2] < a[3] for b in plain)}
    expected = [a for a in rows if a not in shared]
    assert 20 < len(expected) < len(rows)
    df = spark.createDataFrame(rows, "target string, annotation_id string, start long, end long")
    for block in (8, 1 << 16):
        assert Counter(tuple(r) for r in annotation.shared_segments(df, block).collect()) == Counter(expected)
    named = annotation.shared_segments(df.withColumn("name", F.upper("annotation_id")), 8).collect()
    assert Counter(tuple(r) for r in named) == Counter((*r, r[1] and r[1].upper()) for r in expected)


def test_shared_segments_of_a_crowded_place_make_no_pairs(spark):
    n = 200_000
    crowd = spark.range(n).select(F.lit("t").alias("target"), F.col("id").alias("annotation_id"), (F.col("id") % 50).alias("start"), (F.col("id") % 50 + 5).alias("end"))
    lone = spark.createDataFrame([("t", -1, 53, 60), ("t", -2, 70, 80)], "target string, annotation_id long, start long, end long")
    began = time.monotonic()
    assert [r.annotation_id for r in annotation.shared_segments(crowd.union(lone), 16).collect()] == [-2]
    # Pairs would be about 7 thousand million.
    assert time.monotonic() - began < 60


def test_gene_counts_of_reads_across_introns_against_brute_force(spark):
    draw = random.Random(3)
    segments = [("t" if g % 3 else "u", f"g{g}", a, a + draw.choice([1, 3, 10])) for g in range(40) for a in [draw.randrange(300) for _ in range(draw.randint(1, 5))]]
    segments += segments[:9] + [("t", "none", None, None), ("t", "start", 5, None), ("t", "end", None, 50), ("t", "two", None, 5), ("t", "two", None, 8), ("t", "two", 90, 95), ("t", "half", 5, None), ("t", "half", 90, 95), (None, "g1", 1, 9), ("w", "g1", 1, 9), ("t", None, 10, 20), ("t", None, 60, 70)]
    spans = [(draw.choice("tu"), a, a + draw.choice([0, 1, 2, 3, 4, 8, 30, 120])) for a in [draw.randrange(-20, 320) for _ in range(400)]]
    spans += spans[:50] + [(None, 1, 9), ("t", None, 9), ("t", 4, None), ("t", 30, 20)]
    expected = {}
    for key in {s[:2] for s in segments}:
        mine = sorted({s[2:] for s in segments if s[:2] == key and s[2] is not None}, key=lambda s: (s[0], s[1] or 0))
        near = [(a, b) for t, a, b in spans if t == key[0] is not None and None not in (a, b) and a < b]
        reach = [max((e for _, e in mine[: i + 1] if e is not None), default=None) for i in range(len(mine))]
        gaps = [(r, s) for r, (s, _) in zip(reach, mine[1:]) if r is not None and s > r and key[1] is not None]
        expected[key] = sum(a < reach[-1] and b > mine[0][0] for a, b in near) - sum(r <= a and b <= s for a, b in near for r, s in gaps) if mine and reach[-1] is not None else 0
    reads_ = spark.createDataFrame(spans, "target string, start long, end long")
    df = spark.createDataFrame(segments, "target string, annotation_id string, start long, end long")
    for block, most in ((8, 1 << 17), (1 << 16, 0)):
        assert {(r.target, r.annotation_id): r.n for r in annotation.gene_counts(reads_, df, 16, block, most).collect()} == expected


def test_gene_counts_of_a_crowded_target_make_no_pairs(spark):
    n = 200_000
    reads_ = spark.range(n).select(F.lit("t").alias("target"), (F.col("id") % 1000).alias("start"), (F.col("id") % 1000 + 2).alias("end"))
    genes = spark.range(n).select(F.lit("t").alias("target"), F.col("id").alias("annotation_id"), F.explode(F.array(F.lit(100).cast("long"), F.lit(900).cast("long"))).alias("start"))
    began = time.monotonic()
    got = annotation.gene_counts(reads_, genes.withColumn("end", F.col("start") + 5), 512, 1 << 10).agg(F.count("n").alias("genes"), F.min("n").alias("low"), F.max("n").alias("high")).first()
    # Six starts touch either segment, each 200 times. Pairs of reads and introns would be 32 thousand million.
    assert (got.genes, got.low, got.high) == (n, 2400, 2400)
    assert time.monotonic() - began < 60
