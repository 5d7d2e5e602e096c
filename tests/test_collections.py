"""Collections, capture, expression, calls, methylation, records and the registry against brute force on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from readloom import registry
from readloom.functions import numeric, sequence
from readloom.operators import calls, capture, entries, expression, indels, intervals, methylation, stats, variants
from readloom.sources import lines, records

RUNS = "target string, position long, length long, depth long"


def test_concatenation_shifts_queries(spark):
    a = spark.createDataFrame([(0, "x"), (2, "y"), (None, "z")], "q long, v string")
    b = spark.createDataFrame([(0, "x")], "q long, v string")
    got = sorted((r.source, r.q, r.v) for r in entries.concatenate([a, b, b.limit(0), b], "q").where("q is not null").collect())
    assert got == [(0, 0, "x"), (0, 2, "y"), (1, 3, "x"), (3, 4, "x")]
    assert entries.concatenate([a, b]).count() == 4


def test_top_and_capped_rows_of_a_hot_key(spark):
    draw = random.Random(1)
    rows = [("hot", i, draw.random()) for i in range(900)] + [("a", 1, 0.5), ("a", 1, 0.5), (None, 3, None)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(6)
    top = entries.top_per_key(df, ["k"], [F.col("v").desc_nulls_last()], 3).collect()
    assert sorted(r.v for r in top if r.k == "hot") == sorted(sorted(v for k, _, v in rows if k == "hot")[-3:])
    assert len([r for r in top if r.k == "a"]) == 2 and len([r for r in top if r.k is None]) == 1
    capped = entries.capped_sites(df, ["k"], 10)
    assert {r.k: r["count"] for r in capped.groupBy("k").count().collect()} == {"hot": 10, "a": 2, None: 1}
    assert sorted(map(str, capped.collect())) == sorted(map(str, entries.capped_sites(df.repartition(3), ["k"], 10).collect()))
    assert 0 < entries.sampled(df, F.col("i"), 0.2).count() < 400 and entries.top_per_key(df.limit(0), ["k"], [F.col("v")], 3).count() == 0


def test_slices(spark):
    df = spark.createDataFrame([("1", 5), ("1", 9), ("2", 1), ("3", 4), ("3", 8), (None, 1)], "t string, p int")
    told = lambda *a, **k: sorted((tuple(r) for r in entries.in_slice(df, "t", "p", *a, **k).collect()), key=str)
    assert told("1:6", "3,4", ["1", "2", "3"]) == [("1", 9), ("2", 1), ("3", 4)] and told("3:5", "3:8", ["1", "2", "3"]) == [("3", 8)]
    assert told("1:6", "3:4") == [("1", 9), ("2", 1), ("3", 4)] and len(told(None, None)) == 6
    with pytest.raises(ValueError):
        entries.in_slice(df, "t", "p", "1:6", None)
    with pytest.raises(ValueError):
        entries.parse_place("12")
    assert entries.only_targets(df, "t", "1, 3").count() == 4 and entries.without_flap(df, "t", "p", "1", 6).where("t is not null").count() == 4


def test_ranges_hold_and_depths(spark):
    ranges = spark.createDataFrame([("a", 0, 10, "r0"), ("a", 20, 30, "r1"), ("b", 5, 6, "r2")], "t string, s long, e long, id string")
    points = spark.createDataFrame([("a", 1, 9), ("a", 1, 11), ("a", 12, 13), ("a", 20, 30), ("b", 5, 6), ("c", 1, 2), (None, 1, 2)], "t string, x long, y long")
    got = {(r.t, r.x, r.y): r.id for r in entries.containing_range(points, ranges, "t", "x", "y", "id", "s", "e").collect()}
    assert got == {("a", 1, 9): "r0", ("a", 1, 11): None, ("a", 12, 13): None, ("a", 20, 30): "r1", ("b", 5, 6): "r2", ("c", 1, 2): None, (None, 1, 2): None}


def test_captured_depths_and_bins(spark):
    draw = random.Random(3)
    reads = [(t, s := draw.randint(0, 120), s + draw.randint(1, 9)) for t in "ab" for _ in range(60)]
    regions = [("a", 10, 40), ("a", 30, 50), ("b", 100, 130)]
    frame = lambda rows: spark.createDataFrame(rows, "target string, start long, end long")
    runs = intervals.coverage(frame(reads), "target", "start", "end", block=16)
    depth = {(t, p): 0 for t in "ab" for p in range(0, 140)}
    for t, s, e in reads:
        for p in range(s, e):
            depth[t, p] += 1
    inside = {(t, p) for t, s, e in regions for p in range(s, e)}
    one = capture.capture_statistics(capture.captured_depths(runs, frame(regions), 16)).first()
    captured = sum(d for k, d in depth.items() if k in inside)
    assert one.enrichment_efficiency == pytest.approx(captured / sum(depth.values()))
    covered = sum(d > 0 for d in depth.values())
    least = next(x for x in range(100) if x == max(depth.values()) or sum(d >= x for k, d in depth.items() if d or x == 0) <= covered * 0.5)
    assert one.depth_50 == least
    got = {(r.target, r.start): (r.length, round(r.average, 6), r.greatest) for r in capture.fixed_site_bins(runs, 20, 16).collect()}
    want = {}
    for t in "ab":
        ordered = sorted((r for r in runs.collect() if r.target == t), key=lambda r: r.position)
        i = 0
        while i < len(ordered):
            taken, sites = [], 0
            while i < len(ordered) and sites < 20:
                taken.append(ordered[i])
                sites += ordered[i].length if ordered[i].depth else 0
                i += 1
            full = [r for r in taken if r.depth]
            if full:
                want[t, full[0].position] = (taken[-1].position + taken[-1].length - full[0].position, round(sum(r.depth * r.length for r in taken) / sites, 6), max(r.depth for r in taken))
    assert got == want
    assert capture.merge_runs([runs.limit(0), runs.limit(0)]).count() == 0 and capture.fixed_site_bins(runs.limit(0), 5).count() == 0


def test_expression_counts_absent_cells(spark):
    cells = [("e1", "a1", 10), ("e1", "a2", 30), ("e1", "b1", 5), ("e2", "b2", 7), ("e2", "x", 99), (None, "a1", 2)]
    matrix = spark.createDataFrame(cells, "element string, sample string, count long")
    groups = stats.parse_groups("A=a1,a2/B=b1,b2")
    out = {r.element: r for r in expression.differential_expression(matrix, groups, [("A", "B")], methods=("aligned-count", "bullard-upper-quartile")).collect()}
    total = {"a1": 12, "a2": 30, "b1": 5, "b2": 7}
    value = lambda c, s: (c + 1) / (total[s] / 1e6)
    mean_a, mean_b = (value(10, "a1") + value(30, "a2")) / 2, (value(5, "b1") + value(0, "b2")) / 2
    assert out["e1"]["average RPKM group B(AC)"] == pytest.approx(mean_b) and out["e1"]["fold-change A/B(AC)"] == pytest.approx(mean_a / mean_b)
    assert out["e2"]["average count group A"] == 0 and out["e1"]["count sample b2"] == 0
    assert out["e1"]["fisher-exact-test A/B(AC)"] == pytest.approx(numeric.fisher_two_sided(40, 2, 5, 7))
    assert {"t-test A/B(AC)-BH-FDR-q-value", "fisher-exact-test A/B(BUQ)-Bonferroni-adjusted"} <= set(out["e1"].asDict())
    with pytest.raises(ValueError):
        expression.differential_expression(matrix, groups, [("A", "C")])
    within = {(r.element, r.a, r.b): r.p for r in expression.within_group_variability(matrix.where("element is not null"), groups).collect()}
    assert within["e1", "a1", "a2"] == pytest.approx(numeric.fisher_two_sided(10, 0, 30, 0)) and len(within) == 4


def test_tails_over_arrays():
    draw = random.Random(5)
    for _ in range(200):
        a, b, c, d = (draw.randint(0, 12) for _ in range(4))
        row, column, n = a + b, a + c, a + b + c + d
        ways = lambda x: numeric.math.comb(column, x) * numeric.math.comb(n - column, row - x)
        all_ = {x: ways(x) for x in range(max(0, row + column - n), min(row, column) + 1)}
        whole = sum(all_.values())
        assert numeric.fisher_two_sided(a, b, c, d) == pytest.approx(sum(w for w in all_.values() if w <= all_[a]) / whole)
        assert numeric.fisher_greater(a, b, c, d) == pytest.approx(sum(w for x, w in all_.items() if x >= a) / whole)


def test_calls_with_indels_as_records(spark, tmp_path):
    counts = spark.createDataFrame(
        [("c", 9, "s1", "A", 8, True), ("c", 9, "s1", "T", 7, False), ("c", 9, "s2", "A", 5, True), ("c", 20, "s1", "G", 4, True)],
        "target string, position long, sample string, allele string, n long, is_ref boolean",
    )
    found = spark.createDataFrame([("c", 20, "s2", "---", "CAG", 6), ("c", 9, "s2", "-", "G", 1)], "target string, position long, sample string, `from` string, `to` string, n long")
    both = calls.with_indels(counts, found)
    rows = {(r.position, r.sample, r.allele): r.n for r in both.collect()}
    assert rows[20, "s2", "GCAG"] == 6 and rows[9, "s2", "AG"] == 1 and rows[20, "s1", "G"] == 4
    made = calls.genotype_records(both, ["s1", "s2"])
    got = {r.pos: r for r in made.collect()}
    assert got[21].ref == "G" and got[21].alt == ["GCAG"] and got[21].samples == ["0/0:G=4,GCAG=0:4:0:homozygous", "1/1:G=0,GCAG=6:6:0:homozygous"]
    assert got[10].alt == ["AG", "T"] and got[10].samples[0] == "0/2:A=8,T=7,AG=0:15:0:heterozygous"
    header = records.VcfHeader(["s1", "s2"]).declare("FORMAT", "GT", 1, "String", 'Genotype "coded"')
    with pytest.raises(ValueError):
        header.declare("FORMAT", "GT", 1, "String", "again")
    records.write_vcf(made, header, str(tmp_path / "v"))
    text = [r.value for r in spark.read.text(str(tmp_path / "v")).collect()]
    assert '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype \\"coded\\"">' in text
    heads, back = lines.read_vcf(spark, str(tmp_path / "v"))
    assert {(r.chrom, r.pos, r.ref, tuple(r.alt)) for r in back.collect()} == {("c", 10, "A", ("AG", "T")), ("c", 21, "G", ("GCAG",))} and heads.count() == 3
    gaps = spark.createDataFrame([("c", 20, "s2", "-"), ("c", 20, "s1", "-"), ("c", 20, "s2", "A")], "target string, position long, sample string, allele string")
    assert calls.without_gap_bases(gaps, found).count() == 2


def test_covariates_give_controls(spark, tmp_path):
    path = tmp_path / "c.tsv"
    path.write_text("sample-id\tpatient-id\tgender\tkind-of-sample\tparents\nt\tp1\tMale\tSomatic\tp2|p3\ng\tp1\tMale\tGermline\tN/A\nf\tp2\tMale\tGermline\tN/A\nm\tp3\tFemale\tGermline\t\n")
    got = {tuple(r) for r in calls.controls_of(records.read_covariates(spark, str(path))).collect()}
    assert got == {("t", "g", "germline"), ("t", "f", "parent"), ("t", "m", "parent")}
    assert {tuple(r) for r in records.covariate_values(records.read_covariates(spark, str(path)), "sample-id", "parents").collect()} == {("t", "p2"), ("t", "p3")}


def test_contexts_and_conversion(spark):
    genome = spark.createDataFrame([("c", "ACGTCATC"), ("none", "")], "target string, sequence string")
    blocks = indels.genome_blocks(genome, 4)
    assert {(r.block, r.bases) for r in blocks.collect()} == {(0, "ACGT"), (1, "CATC")}
    sites = spark.createDataFrame(
        [("c", 1, "+", "s", 1, 9), ("c", 2, "-", "s", 0, 10), ("c", 4, "+", "s", 30, 10), ("c", 7, "+", "s", 1, 1), ("c", 99, "+", "s", 1, 1), ("c", 0, "-", "s", 1, 1)],
        "target string, position long, strand string, sample string, c long, cm long",
    )
    told = methylation.with_context(sites, blocks, size=4)
    assert {(r.position): r.context for r in told.collect()} == {1: "CG", 2: "CG", 4: "CA", 7: None, 99: None, 0: None}
    one = methylation.context_statistics(told).first()
    assert (one.n_sites, one.n_cpg, one.m_cpg, one.n_cpa, one.m_cpa) == (3, 20, 19, 40, 10) and one.conversion_rate == pytest.approx(75.0)
    reads = methylation.simulated_reads(genome.withColumnRenamed("target", "region"), 4, 20, F.lit(0.0)).collect()
    assert len(reads) == 20 and all("C" not in r.sequence for r in reads)
    assert methylation.context_statistics(told.limit(0)).count() == 0


def test_fasta_blocks(spark, tmp_path):
    draw = random.Random(7)
    bases = {n: "".join(draw.choice("ACGT") for _ in range(k)) for n, k in (("a", 23), ("b", 8), ("e", 0), ("z", 1))}
    text = ";made\n" + "".join(f">{n} about it\n" + "".join(s[i : i + 5] + "\n" for i in range(0, len(s), 5)) + "\n" for n, s in bases.items())
    (tmp_path / "g.fa").write_text(text)
    got = {}
    for r in lines.read_fasta_blocks(spark, str(tmp_path / "g.fa"), 4).collect():
        got.setdefault(r.target, {})[r.block] = r.bases
    assert {n: "".join(v for _, v in sorted(b.items())) for n, b in got.items()} == {n: s for n, s in bases.items() if s}
    assert all(len(v) == 4 for b in got.values() for k, v in b.items() if k < max(b))


def test_alignment_blocks(spark, tmp_path):
    path = tmp_path / "x.maf"
    path.write_text("# last\na score=27\ns chr1 10 5 + 100 ACG-T\ns r1 0 5 - 9 ACGTT\n\na score=x\ns only 1 1 + 1 A\n\n")
    row = records.read_maf(spark, str(path)).withColumn("v", records.maf_variations(F.col("target_bases"), F.col("query_bases"))).collect()
    assert len(row) == 1 and (row[0].score, row[0].target, row[0].target_start, row[0].query_strand) == (27.0, "chr1", 10, "-")
    assert [(v["place"], v["from"], v["to"]) for v in row[0].v] == [(4, "-", "T")]


def test_ends_and_names(spark):
    df = spark.createDataFrame([("AAAATACG",), ("GGGATCC",), ("TTTT",), ("",), (None,)], "s string")
    got = [r.b for r in df.select(sequence.best_end_barcode(F.col("s"), ["TACGCT", "GGATCC"], 0, 4).alias("b")).collect()]
    assert (got[0].barcode_index, got[0].length) == (0, 4) and (got[1].barcode_index, got[1].length) == (1, 6) and got[2:] == [None, None, None]
    names = spark.createDataFrame([("dir-a-b.txt",)], "n string").select(sequence.name_attributes(F.col("n"), ["x", "y", "z", "w"]).alias("a")).first().a
    assert tuple(names) == ("dir", "a", "b", None)


def test_registry():
    assert registry.named("genotype_filter", "diploid") is variants.diploid
    mine = registry.register("genotype_filter", "mine", lambda c: c)
    assert registry.named("genotype_filter", "mine") is mine
    with pytest.raises(ValueError):
        registry.register("genotype_filter", "mine", lambda c: c)
    registry.unregister("genotype_filter", "mine")
    for kind, name in (("genotype_filter", "mine"), ("statistic", "none")):
        with pytest.raises(ValueError):
            registry.named(kind, name)
    with pytest.raises(ValueError):
        registry.register("kind", "x", 1)


def test_state_is_kept_and_given_up(spark, tmp_path):
    from readloom.streaming.state import complete_groups

    schema = "name string, ts timestamp, v int"
    parts = [
        [("a", "2024-01-01 00:00:00", 1), ("b", "2024-01-01 00:00:01", 2)], [("a", "2024-01-01 00:00:02", 3), (None, "2024-01-01 00:00:02", 9)],
        [("late", "2024-01-01 05:00:00", 4)], [("late", "2024-01-01 05:00:01", 5)],
    ]
    for i, rows in enumerate(parts):
        frame = spark.createDataFrame(rows, "name string, ts string, v int").withColumn("ts", F.col("ts").cast("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = complete_groups(stream, "name", "ts", 2, "1 minute", 60_000).writeStream.outputMode("append").format("memory").queryName("mates").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.key, r.complete): sorted(json.loads(x)["v"] for x in r.rows) for r in spark.table("mates").collect()}
    assert got == {("a", True): [1, 3], ("b", False): [2], ("late", True): [4, 5]}
