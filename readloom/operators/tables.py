"""Relational utilities over variant and tab-delimited tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import values as V
from readloom.operators.stats import adjust_bh


def keep_records(df: DataFrame, info: str, required: Sequence[str], genotypes: str | None = None) -> DataFrame:
    """Records whose map ``info`` has all required keys non-empty, and, if told, some genotype off the reference."""
    told = [F.coalesce(F.col(info)[k], F.lit("")) != "" for k in required]
    keep = reduce(Column.__and__, told, F.lit(True))
    if genotypes:
        keep = keep & F.exists(genotypes, lambda g: ~F.coalesce(g, F.lit("")).rlike(r"^(?:0[/|]0|\./\.|\.|)$"))
    return df.where(keep)


def flatten(df: DataFrame, info: str, fields: Sequence[str], samples: str | None = None, sample_names: Sequence[str] = (), sample_fields: Sequence[str] = ()) -> DataFrame:
    """Map entries as columns, and those of each sample's map as ``sample[field]``."""
    columns = [F.col(info)[f].alias(f) for f in fields]
    columns += [F.col(samples)[s][f].alias(f"{s}[{f}]") for s in sample_names for f in sample_fields]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (info, samples)], *columns)


def infer_types(df: DataFrame) -> DataFrame:
    """``column_name, type`` of string columns: Unknown, Integer, Float or String, by the widest cell.

    Empty cells change nothing.
    """
    def rank(c: str) -> Column:
        t = V.trimmed(F.col(f"`{c}`"))
        return F.when(F.coalesce(t, F.lit("")) == "", 0).when(t.rlike(V.INTEGER), 1).when(V.is_float(t), 2).otherwise(3)

    ranks = df.agg(*[F.max(rank(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    names = F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(f"c{i}", F.lit(0)).alias("r")) for i, c in enumerate(df.columns)])
    kinds = F.array(*[F.lit(k) for k in ("Unknown", "Integer", "Float", "String")])
    return ranks.select(F.inline(names)).select("column_name", F.get(kinds, F.col("r")).alias("type"))


def common_positions(files: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Positions that all files have, once each."""
    return reduce(DataFrame.intersect, [f.select(*keys) for f in files])


def positions_only_in(files: Sequence[DataFrame], index: int, keys: Sequence[str]) -> DataFrame:
    """Positions of one file that no other has."""
    mine = files[index].select(*keys).distinct()
    return reduce(lambda d, o: d.join(o.select(*keys), list(keys), "left_anti"), [f for i, f in enumerate(files) if i != index], mine)


def concordance(first: DataFrame, second: DataFrame, keys: Sequence[str], genotype: str) -> DataFrame:
    """How genotypes of common positions agree: same, one or two alleles missed, other differences."""
    both = first.select(*keys, F.col(genotype).alias("a")).join(second.select(*keys, F.col(genotype).alias("b")), list(keys))
    a, b = F.split("a", "[/|]"), F.split("b", "[/|]")
    n = F.least(F.size(a), F.size(b))
    differing = F.filter(F.slice(F.arrays_zip(a.alias("x"), b.alias("y")), F.lit(1), n), lambda z: z["x"] != z["y"])
    missed = F.size(F.filter(differing, lambda z: z["x"].isin("0", "ref") | z["y"].isin("0", "ref"))) + F.abs(F.size(a) - F.size(b))
    other = F.size(differing) - F.size(F.filter(differing, lambda z: z["x"].isin("0", "ref") | z["y"].isin("0", "ref")))
    kind = (
        F.when((missed == 0) & (other == 0), "same").when(missed == 1, "missed_one").when(missed == 2, "missed_two")
        .when(missed > 2, "missed_more").otherwise("other")
    )
    return both.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def transitions(df: DataFrame, ref: Column, alt: Column) -> DataFrame:
    pair = F.concat(F.upper(ref), F.upper(alt))
    ti = pair.isin("AG", "GA", "CT", "TC")
    tv = pair.rlike("^[ACGT]{2}$") & (F.upper(ref) != F.upper(alt)) & ~ti
    return df.agg(F.count_if(ti).alias("transitions"), F.count_if(tv).alias("transversions"))


def combine_fdr(files: Sequence[DataFrame], p: str, most: float = 1.0, q: str = "q") -> DataFrame:
    """Rows of all files with a joint Benjamini-Hochberg ``q`` of at most ``most``; ``source`` counts the files."""
    rows = reduce(DataFrame.unionByName, [f.withColumn("source", F.lit(i)) for i, f in enumerate(files)])
    return adjust_bh(rows, p, q).where(F.col(q) <= most)
