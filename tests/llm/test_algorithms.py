"""Frequent values and rank summaries against exact counts."""

import random


import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("readloom.llm")
from readloom.llm import heavy, ranks  # noqa: E402


def test_frequent_values_with_a_hot_one_and_ties(spark):
    draw = random.Random(3)
    data = ["hot"] * 4000 + ["warm"] * 120 + ["tie1"] * 61 + ["tie2"] * 61 + ["just not"] * 60 + [None] * 500
    data += [f"rare{i}" for i in range(7698)]
    draw.shuffle(data)
    df = spark.createDataFrame([(v, "x", 1) for v in data], "s string, h string, value int").repartition(5)
    got = {r.value: r.n_rows for r in heavy.frequent_values(df, F.col("s"), 1 / 200).collect()}
    assert got == {"hot": 4000, "warm": 120, "tie1": 61, "tie2": 61}
    for row in heavy.frequent_values(df, F.col("s"), 1 / 200).collect():
        assert abs(row.n_estimated - row.n_rows) <= 60


def test_frequent_values_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "s string")
    assert heavy.frequent_values(df, F.col("s"), 0.1).count() == 0
    assert heavy.frequent_values(df.limit(0), F.col("s"), 0.1).count() == 0
    one = spark.createDataFrame([("a" * 100_000,), ("",), ("",)], "s string")
    assert {r.value: r.n_rows for r in heavy.frequent_values(one, F.col("s"), 0.4).collect()} == {"": 2}
    with pytest.raises(ValueError):
        heavy.frequent_values(one, F.col("s"), 0.0)


def test_sketches_are_linear():
    draw = np.random.default_rng(1)
    h = draw.integers(0, 2**63, 5000, dtype=np.uint64)
    whole, a, b = heavy.PrefixSketch(8, 3), heavy.PrefixSketch(8, 3), heavy.PrefixSketch(8, 3)
    whole.add(h)
    a.add(h[:2000])
    b.add(h[2000:])
    assert (whole.flat() == a.flat() + b.flat()).all() and whole.total == a.total + b.total


@pytest.mark.parametrize("one_in", [200, 2000, 20_000])
def test_recall_when_all_heavy_values_are_just_heavy(one_in):
    """As many values as can be heavy, each just above the share: all are found, with a bounded number of candidates."""
    draw = np.random.default_rng(one_in)
    share, n = 1 / one_in, 2_000_000
    k = int(one_in * 0.9)
    hot, rest = (draw.integers(0, 2**63, m, dtype=np.uint64) * np.uint64(2) for m in (k, n // 20))
    sketch = heavy.PrefixSketch(heavy.width_bits_for(share))
    sketch.add(hot, np.full(k, int(n * share) + 1))
    sketch.add(rest)
    most = int(4 / (share * 0.5)) + 16
    prefixes, _ = sketch.heavy(sketch.total * share * 0.5, most)
    known = set((hot >> np.uint64(24)).tolist())
    assert known <= set(prefixes.tolist()) and len(prefixes) <= 1.1 * k


def test_a_sketch_too_narrow_counts_every_value(spark):
    data = [f"v{i % 900}" for i in range(9000)] + [f"rare{i}" for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in data], "s string")
    with pytest.raises(heavy.TooManyPrefixes):
        sketch = heavy.PrefixSketch(4, 1)
        sketch.add(np.random.default_rng(2).integers(0, 2**63, 10_000, dtype=np.uint64) * np.uint64(2))
        sketch.heavy(1, 20)
    for options in ({"width_bits": 4, "depth": 1}, {"most_counters": 10}, {}):
        got = {r.value: r.n_rows for r in heavy.frequent_values(df, F.col("s"), 1 / 1500, **options).collect()}
        assert got == {f"v{i}": 10 for i in range(900)}


def exact(values, pct):
    values = sorted(values)
    return values[max(1, -(-pct * len(values) // 100)) - 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-50, 50), min_size=1, max_size=200), min_size=1, max_size=8), st.sampled_from([0.01, 0.05, 0.2]))
def test_merged_bounds_hold(parts, epsilon):
    summary = ranks.Summary(*(np.array([], dtype=t) for t in (float, int, int, int)))
    for part in parts:
        v, n = np.unique(part, return_counts=True)
        one = ranks.compress(ranks.exact_summary(v, n), epsilon * len(part))
        summary = ranks.merge(summary, one)
    summary = ranks.compress(summary, 2 * epsilon * summary.n)
    values = np.sort(np.concatenate([np.array(p) for p in parts]))
    assert summary.n == len(values)
    for v, w, low, high in zip(*summary):
        below, upto = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
        assert low <= below and upto <= high and w <= upto - below
    assert ranks.uncertainty(summary) <= 2 * epsilon * summary.n + 1
    for pct in (1, 25, 50, 75, 99):
        found = ranks.percentile(summary, pct)
        rank = max(1, -(-pct * len(values) // 100))
        error = 2 * ranks.uncertainty(summary) + 1
        assert np.searchsorted(values, found, "left") + 1 - error <= rank <= np.searchsorted(values, found, "right") + error


def test_percentiles_by_group(spark):
    draw = random.Random(5)
    rows = []
    for i in range(3000):
        scores = draw.choice([None, [], [draw.randint(0, 93) for _ in range(draw.randint(1, 9))], [127, -1, 5]])
        rows.append((draw.choice(["hot"] * 5 + ["b", None]), scores, draw.choice([None, -1, 0, 36, 50, 75]), "extra"))
    df = spark.createDataFrame(rows, "grp string, q array<tinyint>, n int, value string").repartition(6)
    measures = {"q": ranks.Measure(F.col("q"), 0, 93), "n": ranks.Measure(F.col("n"), 1)}
    got = {(r.grp, r.measure, r.pct): r.pct_value for r in ranks.percentiles(ranks.summaries(df, F.col("grp"), measures), (5, 50, 95)).collect()}
    for g in ("hot", "b"):
        q = [x for a, s, _, _ in rows if a == g for x in s or [] if 0 <= x <= 93]
        n = [x for a, _, x, _ in rows if a == g and x and x > 0]
        for p in (5, 50, 95):
            assert got[g, "q", p] == exact(q, p) and got[g, "n", p] == exact(n, p)
    assert len(got) == 12


def test_many_different_values_stay_within_the_error(spark):
    df = spark.range(0, 60_000, 1, 7).select(F.lit("g").alias("g"), (F.hash("id") / 1000.0).alias("v"))
    found = ranks.summaries(df, F.col("g"), {"v": ranks.Measure(F.col("v"))}, epsilon=0.01)
    row = found.first()
    assert len(row.value) < 1500 and row.error <= 0.04 * 60_000
    values = sorted(r.v for r in df.collect())
    for r in ranks.percentiles(found, (10, 50, 90)).collect():
        at = np.searchsorted(values, r.pct_value)
        assert abs(at - r.pct * 600) <= 0.04 * 60_000


def test_days_merge_later(spark):
    days = [spark.createDataFrame([("g", float(x))], "g string, v double") for x in (1, 2, 3)]
    parts = [ranks.summaries(d, F.col("g"), {"v": ranks.Measure(F.col("v"))}) for d in days]
    whole = ranks.merge_summaries(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert [r.pct_value for r in ranks.percentiles(whole, (50,)).collect()] == [2.0]
    none = ranks.summaries(days[0].limit(0), F.col("g"), {"v": ranks.Measure(F.col("v"))})
    assert ranks.percentiles(none, (50,)).count() == 0
    odd = spark.createDataFrame([("g", float("nan")), ("g", None), (None, 1.0)], "g string, v double")
    assert ranks.percentiles(ranks.summaries(odd, F.col("g"), {"v": ranks.Measure(F.col("v"))}), (50,)).count() == 0

