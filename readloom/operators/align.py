"""Alignment rows: best hits, ambiguity, read sets, mates, differences and tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom import registry
from readloom.session import cut_lineage


def best_score(df: DataFrame, query: str, score: str, most: int | None = None, least: float = 1.4e-45) -> DataFrame:
    """Rows whose score is the best of their query; with ``most``, of queries with at most so many such rows.

    Queries without a score above ``least`` have no rows. The best score is aggregated before
    the join back, so a query of any number of rows is no burden; null queries have no rows.
    """
    best = df.where(F.col(query).isNotNull()).groupBy(F.col(query).alias("__q")).agg(F.max(score).alias("__best")).where(F.col("__best") > least)
    kept = df.join(best, (F.col(query) == F.col("__q")) & (F.col(score) == F.col("__best")))
    if most is not None:
        few = kept.groupBy(F.col("__q").alias("__f")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") <= most)
        kept = kept.join(few, F.col("__q") == F.col("__f"), "left_semi")
    return kept.select(*df.columns)


def gene_ambiguity(df: DataFrame, genes: DataFrame, query: str, target: str, gene: str, most: int) -> DataFrame:
    """Rows of queries that hit at most ``most`` different genes; targets without gene don't count."""
    named = df.join(genes.select(F.col(target), F.col(gene).alias("__gene")).distinct(), target, "left")
    few = named.groupBy(F.col(query).alias("__q")).agg(F.count_distinct("__gene").alias("__n")).where(F.col("__n") <= most)
    return df.join(few, F.col(query) == F.col("__q"), "left_semi")


def without_ambiguous(df: DataFrame, too_many_hits: DataFrame, query: str, k: int) -> DataFrame:
    """Rows whose query is not known to hit ``k`` places or more."""
    many = too_many_hits.where(F.col("at_least_hits") >= k).select(F.col(query).alias("__q"))
    return df.join(many, F.col(query) == F.col("__q"), "left_anti")


def in_read_set(df: DataFrame, read_set: DataFrame, query: str, keep: bool = True) -> DataFrame:
    ids = read_set.select(F.col(query).alias("__q"))
    return df.join(ids, F.col(query) == F.col("__q"), "left_semi" if keep else "left_anti")


def few_mismatches(mismatches: Column, indels: Column, query_length: Column, share: float = 0.05) -> Column:
    return F.coalesce(mismatches, F.lit(0)) + F.coalesce(indels, F.lit(0)) <= F.round(query_length * share)


def good_mapping(quality: Column, least: int) -> Column:
    """A missing mapping quality is kept."""
    return quality.isNull() | (quality >= least)


def within_range(target: Column, position: Column, first: tuple[int, int], last: tuple[int, int]) -> Column:
    """Target and position between two places, both included, in lexicographic order."""
    here = F.struct(target.cast("long").alias("t"), position.cast("long").alias("p"))
    at = lambda place: F.struct(F.lit(place[0]).cast("long").alias("t"), F.lit(place[1]).cast("long").alias("p"))
    return (here >= at(first)) & (here <= at(last))


def flags(bits: Column) -> Column:
    """Pair flags by name."""
    # SAM flag bits in order.
    names = (
        "paired", "proper_pair", "unmapped", "mate_unmapped", "reverse", "mate_reverse",
        "first_in_pair", "second_in_pair", "not_primary", "failed_quality", "duplicate",
    )
    return F.struct(*[(bits.bitwiseAND(1 << i) != 0).alias(n) for i, n in enumerate(names)])


def join_mates(first: DataFrame, second: DataFrame, query: str, position: str, target: str) -> DataFrame:
    """Rows of two files that share a query, unique in both, as pairs."""
    def once(df: DataFrame, side: str) -> DataFrame:
        counted = df.groupBy(query).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col(target).alias("t"), F.col(position).alias("p"))).alias("e"))
        return counted.where("n = 1").select(query, F.col("e.t").alias(f"target_{side}"), F.col("e.p").alias(f"position_{side}"))

    return once(first, "a").join(once(second, "b"), query)


def difference(first: DataFrame, second: DataFrame, query: str, compared: list[str], order: str) -> DataFrame:
    """``query, only_in, differs``: queries of one side only, or whose last rows differ in ``compared``."""
    def last(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(query).agg(F.max_by(F.struct(*compared), F.struct(order, *compared)).alias(side))

    both = last(first, "a").join(last(second, "b"), query, "full")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in compared]))
    told = both.select(
        query,
        F.when(F.col("b").isNull(), "first").when(F.col("a").isNull(), "second").alias("only_in"),
        F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.array_join(changed, ",")).alias("differs"),
    )
    return told.where("only_in is not null or differs <> ''")


def tally(df: DataFrame, value: str, index: str) -> DataFrame:
    """``value, multiplicity, first``: exact duplicates with how often and first where."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("multiplicity"), F.min(index).alias("first"))


def letter_counts(df: DataFrame, text: str, n: int = 1) -> DataFrame:
    """``gram, n``: how often each sequence of ``n`` letters occurs in all texts."""
    t = F.col(text)
    grams = F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substr(t, i, F.lit(n)))
    return df.where(F.length(t) >= n).select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def dense_index(df: DataFrame, name: str, index: str = "index") -> DataFrame:
    """``name, index``: different names numbered from 0 in order, without ordering them in one task.

    Names are spread by range; counts before each part are summed over the parts.
    """
    names = df.where(F.col(name).isNotNull()).select(name).distinct()
    # Range bounds are sampled, so the parts are written once.
    spread = cut_lineage(names.repartitionByRange(F.col(name)).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy(name)
    return spread.join(F.broadcast(parts), F.col("__part") == F.col("__p")).select(
        name, (F.row_number().over(inside) - 1 + F.col("__before")).alias(index)
    )


registry.register("alignment_filter", "best_score", best_score)
registry.register("alignment_filter", "mismatches", lambda df, share=0.05: df.where(few_mismatches(F.col("mismatches"), F.col("indels"), F.col("query_length"), share)))
registry.register("alignment_filter", "mapping_quality", lambda df, least: df.where(good_mapping(F.col("mapping_quality"), least)))
