"""Differential expression as one operator: counts, normalised values, group statistics, tests and adjusted p-values in one row per element."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom import registry
from readloom.functions import numeric
from readloom.operators import stats

# The short names of normalisations in column names.
SHORT = {"aligned-count": "AC", "bullard-upper-quartile": "BUQ"}


@registry.register("normalisation", "aligned-count")
def aligned_count(matrix: DataFrame) -> DataFrame:
    return stats.sample_totals(matrix).select("sample", F.col("total").cast("double").alias("denominator"))


@registry.register("normalisation", "bullard-upper-quartile")
def bullard_upper_quartile(matrix: DataFrame) -> DataFrame:
    return stats.upper_quartiles(matrix).select("sample", F.col("factor").alias("denominator"))


class Pair:
    """Two groups of one normalisation in a row of aggregates: means, sums and variances by group number."""

    def __init__(self, a: int, b: int, method: int, totals: dict[int, int]):
        self.a, self.b, self.method, self.totals = a, b, method, totals

    def mean(self, g: int) -> Column:
        return F.col(f"__m{self.method}_{g}")

    def log(self, g: int) -> Column:
        return F.col(f"__l{self.method}_{g}")

    def variance(self, g: int) -> Column:
        return F.col(f"__v{self.method}_{g}")

    def n(self, g: int) -> Column:
        return F.col(f"__n{g}")

    def count(self, g: int) -> Column:
        return F.col(f"__c{g}")


@registry.register("statistic", "fold-change")
def fold_change(p: Pair) -> dict[str, Column]:
    return {"fold-change": F.when(p.mean(p.b) != 0, p.mean(p.a) / p.mean(p.b))}


@registry.register("statistic", "fold-change-magnitude")
def fold_change_magnitude(p: Pair) -> dict[str, Column]:
    ratio = (p.mean(p.a) + 1e-6) / (p.mean(p.b) + 1e-6)
    return {"fold-change-magnitude": F.greatest(ratio, 1 / ratio)}


@registry.register("statistic", "log2-fold-change")
def log2_fold_change(p: Pair) -> dict[str, Column]:
    return {"log2-fold-change": stats.log2_plus(p.mean(p.a)) - stats.log2_plus(p.mean(p.b))}


@registry.register("statistic", "t-test")
def t_test(p: Pair) -> dict[str, Column]:
    """Equal variances for the p-value, unequal ones for the statistic; null with less than two samples a group."""
    na, nb, difference = p.n(p.a), p.n(p.b), p.log(p.a) - p.log(p.b)
    safe = lambda square: F.when(square > 0, difference / F.sqrt(square))
    df = na + nb - 2
    pooled = ((na - 1) * p.variance(p.a) + (nb - 1) * p.variance(p.b)) / F.nullif(df, F.lit(0)) * (1 / na + 1 / nb)
    enough = F.least(na, nb) >= 2
    return {
        "t-test": F.when(enough, numeric.t_p(safe(pooled).cast("double"), df.cast("double"))),
        "t-statistic": F.when(enough, safe(p.variance(p.a) / na + p.variance(p.b) / nb)),
    }


@registry.register("statistic", "fisher")
def fisher(p: Pair) -> dict[str, Column]:
    """The element's share of the reads of both groups."""
    cells = [p.count(p.a), F.lit(p.totals[p.a]) - p.count(p.a), p.count(p.b), F.lit(p.totals[p.b]) - p.count(p.b)]
    return {"fisher-exact-test": numeric.fisher_p(*[c.cast("double") for c in cells])}


@registry.register("statistic", "chi-square")
def chi_square(p: Pair) -> dict[str, Column]:
    """Against shares of the groups' totals; NaN with a zero."""
    n, t = p.count(p.a) + p.count(p.b), p.totals[p.a] + p.totals[p.b]
    term = lambda g: F.pow(p.count(g) - n * (p.totals[g] / max(t, 1)), 2) / (n * (p.totals[g] / max(t, 1)))
    x = F.when(F.least(p.count(p.a), p.count(p.b)) == 0, F.lit(float("nan"))).otherwise(term(p.a) + term(p.b))
    return {"chi-square-test": numeric.chi_square_p(x.cast("double"), F.lit(1.0))}


#: Statistics that are p-values, which are adjusted.
P_VALUES = ("t-test", "fisher-exact-test", "chi-square-test")
DEFAULT = (
    "samples", "counts", "group-averages", "fold-change", "fold-change-magnitude", "log2-fold-change", "t-test", "fisher", "chi-square", "Bonferroni", "BH",
)


@registry.register("mode", "differential-expression")
def differential_expression(
    matrix: DataFrame, groups: dict[str, list[str]], comparisons: Sequence[tuple[str, str]], lengths: DataFrame | None = None,
    methods: Sequence[str] = ("aligned-count",), evaluate: Sequence[str] = DEFAULT, most_samples: int = 500,
) -> DataFrame:
    """One row per element with a column for every sample, group and comparison that ``evaluate`` names.

    ``matrix`` has ``element, sample, count``; ``groups`` are samples by group (see ``stats.parse_groups``). Absent cells are
    zero counts of which the normalised value is the pseudo count's, so that a group's mean is over all its samples. An element
    of length 1000 where ``lengths`` (``element, length``) tells none. Names: ``count sample s``, ``RPKM sample s(AC)``,
    ``average RPKM group g(AC)``, ``average count group g``, ``fold-change a/b(AC)`` and so on; adjusted p-values have
    ``-BH-FDR-q-value`` or ``-Bonferroni-adjusted`` at the end of their name. Statistics and normalisations are
    those registered under these names.

    All cells of an element are aggregated at once, whatever the number of comparisons; totals by sample and group are the
    only other numbers. More than ``most_samples`` samples with columns of their own are an error.
    """
    listed = [(s, g) for g, members in groups.items() for s in members]
    if len(listed) > most_samples and ("samples" in evaluate or "counts" in evaluate):
        raise ValueError(f"more than {most_samples} samples would have columns of their own")
    numbers = {g: i for i, g in enumerate(groups)}
    for a, b in comparisons:
        if a not in numbers or b not in numbers or a == b:
            raise ValueError(f"no comparison of two groups: {a}/{b}")
    spark = matrix.sparkSession
    members = spark.createDataFrame(listed, "sample string, grp string")
    mine = matrix.select("element", "sample", "count").join(F.broadcast(members), "sample")
    whole = stats.complete(mine, listed)
    for i, method in enumerate(methods):
        denominators = registry.named("normalisation", method)(mine).select("sample", F.col("denominator").alias(f"__d{i}"))
        whole = whole.join(F.broadcast(denominators), "sample", "left")
    if lengths is not None:
        whole = whole.join(lengths.select("element", F.col("length").alias("__length")), "element", "left")
    length = F.coalesce("__length", F.lit(1000.0)) if lengths is not None else F.lit(1000.0)
    whole = whole.withColumns({f"__x{i}": stats.rpkm(F.col("count"), length, F.greatest(F.coalesce(f"__d{i}", F.lit(1.0)), F.lit(1.0)), 1) for i in range(len(methods))})
    aggregates: list[Column] = []
    if {"samples", "counts", "raw-counts"} & set(evaluate):
        for k, (s, _) in enumerate(listed):
            here = F.col("sample") == s
            aggregates.append(F.sum(F.when(here, F.col("count")).otherwise(0)).alias(f"__s{k}"))
            aggregates += [F.max(F.when(here, F.col(f"__x{i}"))).alias(f"__s{k}_{i}") for i in range(len(methods))]
    for g, k in numbers.items():
        here = F.col("grp") == g
        aggregates += [F.sum(F.when(here, F.col("count")).otherwise(0)).alias(f"__c{k}"), F.count_if(here).alias(f"__n{k}")]
        for i in range(len(methods)):
            x = F.when(here, F.col(f"__x{i}"))
            aggregates += [F.avg(x).alias(f"__m{i}_{k}"), F.avg(F.log1p(x)).alias(f"__l{i}_{k}"), F.var_samp(F.log1p(x)).alias(f"__v{i}_{k}")]
    rows = whole.groupBy("element").agg(*aggregates)
    totals = {r["grp"]: int(r["t"] or 0) for r in mine.groupBy("grp").agg(F.sum("count").alias("t")).collect()}
    by_number = {k: totals.get(g, 0) for g, k in numbers.items()}
    columns: dict[str, Column] = {}
    log2 = lambda c: F.log2(F.nullif(c, F.lit(0.0)))
    for k, (s, g) in enumerate(listed):
        if "raw-counts" in evaluate:
            columns[s] = F.col(f"__s{k}")
        if "samples" in evaluate:
            columns[f"count sample {s}"] = F.col(f"__s{k}")
            for i, method in enumerate(methods):
                columns[f"RPKM sample {s}({SHORT.get(method, method)})"] = F.col(f"__s{k}_{i}")
                columns[f"log2_RPKM sample {s}({SHORT.get(method, method)})"] = log2(F.col(f"__s{k}_{i}"))
        if "counts" in evaluate:
            columns[f"count sample {s} [{g}]"] = F.col(f"__s{k}")
    adjusted: list[str] = []
    for i, method in enumerate(methods):
        short = SHORT.get(method, method)
        if "group-averages" in evaluate:
            for g, k in numbers.items():
                columns[f"average RPKM group {g}({short})"] = F.col(f"__m{i}_{k}")
                columns[f"average log2_RPKM group {g}({short})"] = log2(F.col(f"__m{i}_{k}"))
                columns[f"average count group {g}"] = F.col(f"__c{k}") / F.nullif(F.col(f"__n{k}"), F.lit(0))
        for a, b in comparisons:
            pair = Pair(numbers[a], numbers[b], i, by_number)
            for name in evaluate:
                if name in registry.names("statistic"):
                    for told, value in registry.named("statistic", name)(pair).items():
                        columns[f"{told} {a}/{b}({short})"] = value
                        if told in P_VALUES:
                            adjusted.append(f"{told} {a}/{b}({short})")
    out = rows.select("element", *[c.alias(name) for name, c in columns.items()])
    return adjust(out, adjusted, [m for m in ("Bonferroni", "BH") if m in evaluate])


registry.register("adjustment", "BH", lambda df, p: stats.adjust_bh(df, p, f"{p}-BH-FDR-q-value"))
registry.register("adjustment", "Bonferroni", lambda df, p: _bonferroni(df, p))


def _bonferroni(df: DataFrame, p: str) -> DataFrame:
    told = F.col(f"`{p}`")
    return stats.adjust_bonferroni(df, p, told.isNotNull() & ~F.isnan(told), f"{p}-Bonferroni-adjusted")


def adjust(df: DataFrame, columns: Sequence[str], methods: Sequence[str], key: str = "element") -> DataFrame:
    """``df`` with an adjusted column for each p-value column and method, both by name; ``key`` is unique.

    Each is computed from the key and its own column of the table as it is, and joined: plans don't grow into each other.
    """
    from readloom.session import cut_lineage

    if not columns or not methods:
        return df
    base = cut_lineage(df)
    out = base
    for method in methods:
        for p in columns:
            mine = registry.named("adjustment", method)(base.select(key, F.col(f"`{p}`")), p)
            out = out.join(mine.drop(p), key, "left")
    return out


def informative(df: DataFrame, keep: Sequence[str] = ("element",)) -> DataFrame:
    """Without columns that hold nothing but zeros, NaN and nulls."""
    from readloom.operators.annotation import informative_columns

    told = informative_columns(df, [c for c in df.columns if c not in keep])
    return df.select(*keep, *[F.col(f"`{c}`") for c in told])


def within_group_variability(matrix: DataFrame, groups: dict[str, list[str]], most_pairs: int = 2000) -> DataFrame:
    """``element, a, b, p``: Fisher p of an element's share in each pair of samples of a group, from the complete matrix.

    Pairs of samples are a bounded list; elements are exploded over it, so no cells are joined.
    """
    pairs = [(a, b) for members in groups.values() for i, a in enumerate(sorted(members)) for b in sorted(members)[i + 1 :]]
    if len(pairs) > most_pairs:
        raise ValueError(f"more than {most_pairs} pairs of samples")
    samples = sorted({s for p in pairs for s in p})
    mine = matrix.where(F.col("sample").isin(samples))
    totals = {r["sample"]: int(r["total"]) for r in stats.sample_totals(mine).collect()}
    cells = mine.groupBy("element").agg(*[F.sum(F.when(F.col("sample") == s, F.col("count")).otherwise(0)).cast("double").alias(f"__{i}") for i, s in enumerate(samples)])
    at = {s: F.col(f"__{i}") for i, s in enumerate(samples)}
    rest = {s: F.lit(float(totals.get(s, 0))) - at[s] for s in samples}
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), at[a].alias("x"), rest[a].alias("y"), at[b].alias("u"), rest[b].alias("v")) for a, b in pairs])
    spread = cells.select("element", F.inline(rows))
    return spread.select("element", "a", "b", numeric.fisher_p("x", "y", "u", "v").alias("p"))
