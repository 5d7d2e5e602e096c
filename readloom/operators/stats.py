"""Count matrices in long form: normalisation, group statistics, adjustment and combination of p-values.

A matrix has ``element``, ``sample``, ``grp`` and ``count``; absent cells are zero counts that
have no row unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom import registry
from readloom.functions import numeric
from readloom.operators.prefix import running
from readloom.session import cut_lineage


def parse_groups(text: str) -> dict[str, list[str]]:
    """``A=s1,s2/B=s3`` as samples by group."""
    out = {}
    for part in filter(None, text.split("/")):
        name, equals, samples = part.partition("=")
        if not equals:
            raise ValueError(f"no samples in group definition {part!r}")
        out[name.strip()] = [s.strip() for s in samples.split(",") if s.strip()]
    return out


def parse_comparisons(text: str) -> list[tuple[str, str]]:
    """``A/B,A/C`` as pairs; single names are skipped."""
    pairs = [tuple(p.strip() for p in part.split("/")) for part in text.split(",")]
    return [p for p in pairs if len(p) == 2]  # type: ignore[misc]


def known_samples(matrix: DataFrame, most: int = 20_000) -> list[tuple[str, str]]:
    """Samples with their groups, a dimension of one row a library; more than ``most`` are an error."""
    rows = matrix.select("sample", "grp").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the matrix has more than {most} samples")
    return sorted((r["sample"], r["grp"]) for r in rows if r["sample"] is not None)


def complete(matrix: DataFrame, samples: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """``element, sample, grp, count`` for every element and sample, 0 where nothing was counted.

    ``samples`` are those of ``known_samples`` unless told. The cells of an element stay where they were
    aggregated, so that an aggregation by element needs no other shuffle.
    """
    samples = known_samples(matrix) if samples is None else list(samples)
    one = matrix.sparkSession.createDataFrame([(1, list(samples))], "one int, all array<struct<sample:string,grp:string>>")
    counts = matrix.where("sample is not null").groupBy("element", "sample").agg(F.sum("count").alias("count"))
    cells = counts.groupBy("element").agg(F.map_from_entries(F.collect_list(F.struct("sample", "count"))).alias("m"))
    # One row of at most ``most`` samples is broadcast.
    spread = cells.withColumn("one", F.lit(1)).join(F.broadcast(one), "one")
    return spread.select("element", F.explode("all").alias("s"), "m").select(
        "element", "s.sample", "s.grp", F.coalesce(F.element_at("m", F.col("s.sample")), F.lit(0)).alias("count")
    )


def sample_totals(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("sample").agg(F.sum("count").alias("total"))


def upper_quartiles(matrix: DataFrame) -> DataFrame:
    """``sample, factor``: the count at 3/4 of each sample's elements, scaled to the sum of totals, at least 1.

    Elements count if any sample has them. The value sits at index ``int(n * 0.75)`` from 0 of the
    sorted counts; counts are first counted, so that what is ordered is as small as the
    number of different counts.
    """
    full = complete(matrix.where("count > 0"))
    by_count = full.groupBy("sample", "count").agg(F.count(F.lit(1)).alias("m"))
    upto = Window.partitionBy("sample").orderBy("count")
    whole = Window.partitionBy("sample")
    at = by_count.select(
        "sample", "count", F.sum("m").over(upto).alias("upto"), F.sum("m").over(whole).alias("n"),
    ).where(F.col("upto") > F.floor(F.col("n") * 0.75))
    quartile = at.groupBy("sample").agg(F.min("count").alias("quartile")).join(sample_totals(matrix), "sample")
    everything = Window.partitionBy(F.lit(1))
    ratio = F.sum("total").over(everything) / F.sum("quartile").over(everything)
    return quartile.select("sample", F.greatest(F.lit(1.0), F.col("quartile") * ratio).alias("factor"))


def rpkm(count: Column, length: Column, total: Column, pseudo: int = 0) -> Column:
    return (count + pseudo) / (length / 1000.0) / (total / 1e6)


def log2_plus(x: Column) -> Column:
    """The reported logarithm: log1p(x) / log(2)."""
    return F.log1p(x) / F.log(F.lit(2.0))


def normalised(matrix: DataFrame, denominators: DataFrame, lengths: DataFrame | None = None, pseudo: int = 1, length: float = 1000.0) -> DataFrame:
    """The complete matrix with ``value``, its RPKM with ``pseudo`` added to every count, absent cells too.

    ``denominators`` has ``sample, denominator``, ``lengths`` ``element, length`` (``length`` where it tells none).
    """
    whole = complete(matrix).join(F.broadcast(denominators), "sample")
    if lengths is not None:
        whole = whole.join(lengths.select("element", F.col("length").alias("__length")), "element", "left")
    bases = F.coalesce("__length", F.lit(length)) if lengths is not None else F.lit(length)
    return whole.select("element", "sample", "grp", "count", rpkm(F.col("count"), bases, F.col("denominator"), pseudo).alias("value"))


def group_statistics(normalised: DataFrame, a: str, b: str) -> DataFrame:
    """Per element means of both groups, fold changes and t of ``value`` (columns element, grp, value).

    The values must be those of all samples of the groups (see ``normalised``): absent cells are values, not gaps.

    ``t`` is of unequal variances, ``t_equal`` and ``df`` of equal ones, both on log1p of the value.
    Needs two values a group; else they are null.
    """
    log = F.log1p("value")
    sums = []
    for name, grp in (("a", a), ("b", b)):
        here = F.col("grp") == grp
        sums += [
            F.avg(F.when(here, F.col("value"))).alias(f"mean_{name}"), F.count_if(here).alias(f"n_{name}"),
            F.avg(F.when(here, log)).alias(f"log_{name}"), F.var_samp(F.when(here, log)).alias(f"var_{name}"),
        ]
    s = normalised.where(F.col("grp").isin(a, b)).groupBy("element").agg(*sums)
    shift = F.lit(1e-6)
    ratio = (F.col("mean_a") + shift) / (F.col("mean_b") + shift)
    df = F.col("n_a") + F.col("n_b") - 2
    pooled = ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / F.nullif(df, F.lit(0))
    difference = F.col("log_a") - F.col("log_b")
    safe = lambda top, square: F.when(square > 0, top / F.sqrt(square))
    return s.select(
        "element", "mean_a", "mean_b",
        F.when(F.col("mean_b") != 0, F.col("mean_a") / F.col("mean_b")).alias("fold_change"),
        (log2_plus(F.col("mean_a")) - log2_plus(F.col("mean_b"))).alias("log2_fold_change"),
        F.greatest(ratio, 1 / ratio).alias("fold_change_magnitude"),
        safe(difference, F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b")).alias("t"),
        safe(difference, pooled * (1 / F.col("n_a") + 1 / F.col("n_b"))).alias("t_equal"), df.alias("df"),
    )


def with_t_p(statistics: DataFrame) -> DataFrame:
    return statistics.withColumn("p", numeric.t_p(F.col("t_equal").cast("double"), F.col("df").cast("double")))


def chi_square(matrix: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``element, chi_square, df``: observed group counts against shares of the groups' totals; NaN with a zero."""
    mine = matrix.where(F.col("grp").isin(*groups))
    observed = mine.groupBy("element").agg(*[F.sum(F.when(F.col("grp") == g, F.col("count")).otherwise(0)).alias(f"o{i}") for i, g in enumerate(groups)])
    totals = mine.agg(*[F.sum(F.when(F.col("grp") == g, F.col("count")).otherwise(0)).alias(f"t{i}") for i, g in enumerate(groups)])
    both = observed.withColumn("one", F.lit(1)).join(F.broadcast(totals.withColumn("one", F.lit(1))), "one")
    n = sum((F.col(f"o{i}") for i in range(1, len(groups))), F.col("o0"))
    t = sum((F.col(f"t{i}") for i in range(1, len(groups))), F.col("t0"))
    terms = [F.pow(F.col(f"o{i}") - n * F.col(f"t{i}") / t, 2) / (n * F.col(f"t{i}") / t) for i in range(len(groups))]
    zero = F.least(*[F.col(f"o{i}") for i in range(len(groups))]) == 0
    value = F.when(zero, F.lit(float("nan"))).otherwise(sum(terms[1:], terms[0]))
    return both.select("element", value.alias("chi_square"), F.lit(len(groups) - 1).alias("df"))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """Log2 odds ratio with one added to each count, and its standard error (null below 10)."""
    ratio = (a + 1) * (d + 1) / ((b + 1) * (c + 1))
    few = F.least(a, b, c, d) < 10
    return F.log2(ratio), F.when(~few, F.sqrt(1 / a + 1 / b + 1 / c + 1 / d))


def adjust_bh(df: DataFrame, p: str, q: str = "q", ignored: int = 0) -> DataFrame:
    """``df`` with Benjamini-Hochberg ``q``: p * n / rank, made monotone from the greatest p down.

    All rows count in n, those with null or NaN p too (their q is 1), and ``ignored`` more. Equal
    p share a q. Different p are spread by range over the tasks, as evenly where most are tiny as elsewhere;
    ranks and minima of a task go on from those of the tasks before and after it.
    """
    known = F.col(f"`{p}`").isNotNull() & ~F.isnan(F.col(f"`{p}`").cast("double"))
    n = df.agg(F.count(F.lit(1)).alias("__all")).withColumn("__one", F.lit(1))
    by_p = df.where(known).groupBy(F.col(f"`{p}`").cast("double").alias("__p")).agg(F.count(F.lit(1)).alias("__m"))
    # Range bounds are sampled, so the parts are written once.
    spread = cut_lineage(by_p.repartitionByRange("__p").withColumn("__part", F.spark_partition_id()))
    upto, after = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.col("__part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    parts = spread.groupBy("__part").agg(F.sum("__m").alias("__s")).select("__part", F.coalesce(F.sum("__s").over(upto), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part")
    rank = F.col("__before") + F.sum("__m").over(inside.orderBy("__p"))
    # One row a task and one row are broadcast.
    ranked = spread.withColumn("__one", F.lit(1)).join(F.broadcast(parts), "__part").join(F.broadcast(n), "__one").withColumn("__raw", F.col("__p") * (F.col("__all") + ignored) / rank)
    lows = ranked.groupBy("__part").agg(F.min("__raw").alias("__low")).select("__part", F.min("__low").over(after).alias("__later"))
    least = F.least(F.lit(1.0), F.min("__raw").over(inside.orderBy(F.col("__p").desc())), F.col("__later"))
    adjusted = ranked.join(F.broadcast(lows), "__part").select("__p", least.alias("__q"))
    out = df.withColumn("__own", F.when(known, F.col(f"`{p}`").cast("double"))).join(adjusted, F.col("__own") == F.col("__p"), "left")
    return out.withColumn(q, F.coalesce("__q", F.lit(1.0))).select(*[F.col(f"`{c}`") for c in df.columns], F.col(f"`{q}`"))


def adjust_bonferroni(df: DataFrame, p: str, informative: Column | None = None, q: str = "q") -> DataFrame:
    """``df`` with min(1, p * n), n the rows for which ``informative`` holds (all by default)."""
    count = df.agg((F.count(F.lit(1)) if informative is None else F.count_if(informative)).alias("__n")).withColumn("__one", F.lit(1))
    out = df.withColumn("__one", F.lit(1)).join(F.broadcast(count), "__one")
    return out.withColumn(q, F.least(F.lit(1.0), F.col(f"`{p}`") * F.col("__n"))).select(*[F.col(f"`{c}`") for c in df.columns], F.col(f"`{q}`"))


def combine(df: DataFrame, keys: Sequence[str], p: str, full_series: bool = False) -> DataFrame:
    """Evidence of several p-values by key: greatest, least, upper median, sum, and tail of the product.

    ``p_product`` is the tail of the product of n uniform values by its series; a zero gives
    zero. The series has n - 1 terms, with ``full_series`` the n of the published formula.
    Medians are taken over counted values.
    """
    known = df.where(F.col(p).isNotNull())
    base = known.groupBy(*keys).agg(
        F.max(p).alias("p_max"), F.min(p).alias("p_min"), F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col(p) > 0, -F.log(F.col(p)))).alias("x"), F.count_if(F.col(p) <= 0).alias("zeros"), F.sum(p).alias("p_sum"),
    )
    counted = known.groupBy(*keys, F.col(p).alias("v")).agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy(*keys)
    upto = counted.withColumn("upto", F.sum("m").over(w.orderBy("v"))).withColumn("n", F.sum("m").over(w))
    median = upto.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(*keys).agg(F.min("v").alias("p_median"))
    x, n = F.coalesce("x", F.lit(0.0)), F.col("n")
    # The series is the upper tail of a sum of exponential values, with a term less that of one value less.
    terms = n if full_series else F.greatest(n - 1, F.lit(1))
    tail = F.when(F.col("zeros") > 0, 0.0).when(x == 0, 1.0).otherwise(numeric.gamma_tail_p(terms.cast("double"), x))
    return base.join(median, list(keys)).select(*keys, "n", "p_max", "p_min", "p_median", "p_sum", tail.alias("p_product"))


def pair_statistics(cma: Column, ca: Column, cmb: Column, cb: Column, bound: float = 1e6) -> dict[str, Column]:
    """Statistics of two samples' counts (methylated and not): how far they differ."""
    a, b = cma - ca, cmb - cb
    same = a * b > 0
    rate = lambda m, u: F.when(m + u > 0, m / (m + u))
    pooled = (cma + cmb) / (cma + cmb + ca + cb)
    z = (rate(cma, ca) - rate(cmb, cb)) / F.sqrt(F.nullif(pooled * (1 - pooled) * (1 / (cma + ca) + 1 / (cmb + cb)), F.lit(0.0)))
    return {
        "delta": F.least(F.abs(a) + F.abs(b), F.lit(bound)),
        "dmr": F.abs(rate(cma, ca) - rate(cmb, cb)) * 100,
        "stat3": F.least(F.when(same, F.greatest(F.abs(a), F.abs(b))).otherwise(F.abs(a) + F.abs(b)), F.lit(bound)),
        "stat5": F.when(same, F.greatest(F.abs(cma - cmb), F.abs(ca - cb))).otherwise(F.abs(cma - cmb) + F.abs(ca - cb)),
        "ptest": F.coalesce(F.abs(z), F.lit(0.0)),
    }


def empirical_p(null: DataFrame, tests: DataFrame, keys: Sequence[str], statistic: str, scale: float = 100.0) -> DataFrame:
    """``tests`` with ``empirical_p``: (N - cum(s) + 1) / (N + 1) under the null rows of the same keys.

    Statistics are scaled and rounded to whole bins; cum counts null values up to the bin
    before. Only counts by bin are ordered.
    """
    scaled = lambda c: F.round(c * scale).cast("long")
    keys = list(keys)
    null_bins = null.groupBy(*keys, scaled(F.col(statistic)).alias("__bin")).agg(F.count(F.lit(1)).alias("__m")).where("__bin is not null")
    asked = tests.withColumn("__bin", scaled(F.col(statistic)))
    ask_bins = asked.where("__bin is not null").select(*keys, "__bin").distinct().withColumn("__m", F.lit(0).cast("long"))
    every = null_bins.unionByName(ask_bins).groupBy(*keys, "__bin").agg(F.sum("__m").alias("__m"))
    cum = running(every, keys, "__bin", {"__cum": ("sum", "__m")}, 1 << 12, strict=True)
    total = null_bins.groupBy(*keys).agg(F.sum("__m").alias("__n"))
    known = cum.join(total, keys, "left").select(*keys, "__bin", "__cum", F.coalesce("__n", F.lit(0)).alias("__n"))
    p = (F.col("__n") - F.col("__cum") + 1) / (F.col("__n") + 1)
    return asked.join(known, [*keys, "__bin"], "left").withColumn("empirical_p", p).select(*tests.columns, "empirical_p")


for _name in ("max", "min", "median", "sum", "product"):
    registry.register("combinator", _name, lambda df, keys, p, _column=f"p_{_name}": combine(df, keys, p).select(*keys, F.col(_column).alias("p")))
for _name in ("delta", "dmr", "stat3", "stat5", "ptest"):
    registry.register("pair_statistic", _name, lambda cma, ca, cmb, cb, _name=_name: pair_statistics(cma, ca, cmb, cb)[_name])
