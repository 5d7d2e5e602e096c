"""Whole collections of alignment entries or reads: concatenated, ordered, numbered, sliced, sampled, compared."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom import registry
from readloom.operators.align import dense_index
from readloom.operators.prefix import running


def concatenate(files: Sequence[DataFrame], query: str | None = None, source: str = "source") -> DataFrame:
    """All rows of all files with ``source``, the number of their file.

    With ``query``, an index from 0 within each file, indices are shifted by those of the files before, so that
    no two files share one; null indices stay null. One row a file is broadcast.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn(source, F.lit(i)) for i, f in enumerate(files)])
    if query is None:
        return rows
    before = Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(F.col(source).alias("__s")).agg((F.max(query) + 1).alias("__n"))
    shifts = sizes.select("__s", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    shifted = rows.join(F.broadcast(shifts), F.col(source) == F.col("__s")).withColumn(query, F.col(query) + F.col("__shift"))
    return shifted.select(*rows.columns)


def by_position(df: DataFrame, target: str, position: str, *ties: str) -> DataFrame:
    """Rows in order of target and position, then of ``ties``: ranges are sampled, and each is sorted by one task, which spills."""
    return df.orderBy(target, position, *ties)


def top_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of an order: every task keeps ``n``, so nothing is sorted as a whole."""
    return df.orderBy(*order).limit(n)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, parts: int = 64) -> DataFrame:
    """The first ``n`` rows of each key (ties by all columns).

    A key's rows are first cut to ``n`` in each of ``parts`` by a hash, so that a key with most rows
    is not ordered by one task.
    """
    ties = [F.col(f"`{c}`") for c in df.columns if not df.schema[c].dataType.typeName().startswith(("map", "variant"))]
    salted = df.withColumn("__part", F.pmod(F.xxhash64(*ties), F.lit(parts)))
    first = Window.partitionBy(*keys, "__part").orderBy(*order, *ties)
    kept = salted.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= n)
    return kept.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *ties))).where(F.col("__r") <= n).drop("__r", "__part")


def capped_sites(df: DataFrame, keys: Sequence[str], cap: int, seed: int = 37) -> DataFrame:
    """At most ``cap`` rows of each site, drawn by a hash of the row: the same on every run."""
    told = [F.col(f"`{c}`") for c in df.columns if not df.schema[c].dataType.typeName().startswith(("map", "variant"))]
    return top_per_key(df, keys, [F.xxhash64(*told, F.lit(seed))], cap)


def sampled(df: DataFrame, key: Column, share: float = 0.01, seed: int = 37) -> DataFrame:
    """Rows whose hashed key falls into ``share`` of all hashes: the same rows on every run, all of a key or none."""
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))


def renumbered(df: DataFrame, query: str, index: str = "small_index") -> tuple[DataFrame, DataFrame]:
    """``df`` with its different queries numbered from 0 in order, and the table that tells them apart again."""
    known = dense_index(df, query, index)
    return df.join(known, query, "left"), known


def merged_targets(files: Sequence[DataFrame], name: str, length: str) -> DataFrame:
    """``target_index, name, length, lengths_agree``: targets of all files by name, numbered in order of names."""
    rows = reduce(DataFrame.unionByName, [f.select(F.col(name).alias("name"), F.col(length).alias("length")) for f in files])
    known = rows.where("name is not null").groupBy("name").agg(F.max("length").alias("length"), (F.min("length").eqNullSafe(F.max("length"))).alias("lengths_agree"))
    return known.join(dense_index(known, "name", "target_index"), "name")


def position_slices(df: DataFrame, target: str, position: str, n: int, step: int) -> DataFrame:
    """``target, slice, start, end, n``: stretches of about ``n`` rows that end at multiples of ``step``.

    Rows are counted by step before anything is ordered; a step with more rows is a slice of its own.
    """
    bins = df.where(F.col(position).isNotNull() & F.col(target).isNotNull()).groupBy(
        F.col(target).alias("target"), F.floor(F.col(position) / step).alias("bin")
    ).agg(F.count(F.lit(1)).alias("m"))
    upto = running(bins, ["target"], "bin", {"before": ("sum", "m")}, 1 << 12, strict=True)
    cut = upto.withColumn("slice", F.floor(F.coalesce("before", F.lit(0)) / n))
    return cut.groupBy("target", "slice").agg(
        (F.min("bin") * step).alias("start"), ((F.max("bin") + 1) * step).alias("end"), F.sum("m").alias("n")
    )


def parse_place(text: str) -> tuple[str, int]:
    """``target:position`` or ``target,position``."""
    name, _, position = text.replace(",", ":").rpartition(":")
    if not name or not position.strip().isdigit():
        raise ValueError(f"no place of the form target:position: {text!r}")
    return name.strip(), int(position)


def in_slice(df: DataFrame, target: str, position: str, first: str | None, last: str | None, order: Sequence[str] | None = None) -> DataFrame:
    """Rows from ``first`` to ``last`` (both or none; see ``parse_place``), both included.

    ``order`` lists the targets as the file has them; without it they are in order of their names. Both tests are on
    plain columns, so that the scan skips what lies outside.
    """
    if (first is None) != (last is None):
        raise ValueError("a slice needs both its ends")
    if first is None or last is None:
        return df
    (ta, pa), (tb, pb) = parse_place(first), parse_place(last)
    if order is None:
        inside, t = F.lit(True), F.col(target)
        return df.where(inside & ((t > ta) | (t == ta) & (F.col(position) >= pa)) & ((t < tb) | (t == tb) & (F.col(position) <= pb)))
    if ta not in order or tb not in order:
        raise ValueError("a slice begins or ends on a target that is not there")
    whole = list(order)[list(order).index(ta) + 1 : list(order).index(tb)]
    here = lambda name, test: (F.col(target) == name) & test
    ends = here(ta, F.col(position) >= pa) & F.lit(ta != tb) | here(tb, F.col(position) <= pb) & F.lit(ta != tb)
    same = here(ta, F.col(position).between(pa, pb)) & F.lit(ta == tb)
    return df.where(ends | same | (F.col(target).isin(whole) if whole else F.lit(False)))


def only_targets(df: DataFrame, target: str, listed: str | None) -> DataFrame:
    """Rows on the targets of a comma list; without a list all."""
    names = [n.strip() for n in (listed or "").split(",") if n.strip()]
    return df.where(F.col(target).isin(names)) if names else df


def without_flap(df: DataFrame, target: str, position: str, first_target: str, start: int) -> DataFrame:
    """Rows but those before ``start`` on the slice's first target, which are read to warm up only."""
    return df.where(~((F.col(target) == first_target) & (F.col(position) < start)))


def header_of(df: DataFrame, query: str, target: str, length: str | None = None, position: str | None = None) -> DataFrame:
    """One row: ``n_entries, n_queries, n_targets, least_query, greatest_query`` and, of read lengths, ``shortest, longest``."""
    extra = [F.min(length).alias("shortest"), F.max(length).alias("longest")] if length else []
    return df.agg(
        F.count(F.lit(1)).alias("n_entries"), F.count_distinct(query).alias("n_queries"), F.count_distinct(target).alias("n_targets"),
        F.min(query).alias("least_query"), F.max(query).alias("greatest_query"), *extra,
    )


def compare_records(first: DataFrame, second: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``field, n_compared, n_different``: how often the fields of records with equal keys differ.

    The rows ``(only in first)`` and ``(only in second)`` count keys without partner. Keys must be unique in each file;
    repeated ones are compared by their greatest record. Nulls equal each other.
    """
    def once(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.max(F.struct(*fields)).alias(side))

    both = once(first, "a").join(once(second, "b"), list(keys), "full")
    met = F.col("a").isNotNull() & F.col("b").isNotNull()
    counts = both.agg(
        F.count_if(met).alias("met"), F.count_if(F.col("b").isNull()).alias("first"), F.count_if(F.col("a").isNull()).alias("second"),
        *[F.count_if(met & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(f"d{i}") for i, c in enumerate(fields)],
    )
    row = lambda name, n, d: F.struct(F.lit(name).alias("field"), n.alias("n_compared"), d.alias("n_different"))
    rows = [row(c, F.col("met"), F.col(f"d{i}")) for i, c in enumerate(fields)]
    alone = [row("(only in first)", F.col("first"), F.col("first")), row("(only in second)", F.col("second"), F.col("second"))]
    return counts.select(F.inline(F.array(*rows, *alone)))


def compare_positions(first: DataFrame, second: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``keys, n_first, n_second, n_common`` of positions at which the bags of records differ."""
    bag = lambda df, c: df.groupBy(*keys, *fields).agg(F.count(F.lit(1)).alias(c))
    both = bag(first.select(*keys, *fields), "a").unionByName(bag(second.select(*keys, *fields), "b"), allowMissingColumns=True)
    met = both.groupBy(*keys, *fields).agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
    counted = met.groupBy(*keys).agg(F.sum("a").alias("n_first"), F.sum("b").alias("n_second"), F.sum(F.least("a", "b")).alias("n_common"))
    return counted.where("n_first <> n_common or n_second <> n_common")


def read_index_variations(entries: DataFrame, sample: str = "sample", length: str = "query_length", variations: str = "variations") -> DataFrame:
    """``sample, read_index, n_variant, n_reference``: what reads show at each of their places.

    Places that agree with the reference are not written out: reads are counted by length, and summed from the
    longest down, less the places with variations (an array with ``read_index`` and ``to``; insertions and deletions
    take a place for each base of the read they hold).
    """
    rows = entries.where(F.col(length) > 0)
    lengths = rows.groupBy(F.col(sample).alias("sample"), F.col(length).alias("length")).agg(F.count(F.lit(1)).alias("m"))
    # As many rows as there are different read lengths.
    down = Window.partitionBy("sample").orderBy(F.col("read_index").desc())
    most = lengths.groupBy("sample").agg(F.max("length").alias("most"))
    places = most.select("sample", F.explode(F.sequence(F.lit(1), F.col("most"))).alias("read_index"))
    reach = places.join(lengths.withColumnRenamed("length", "read_index"), ["sample", "read_index"], "left").select(
        "sample", "read_index", F.sum(F.coalesce("m", F.lit(0))).over(down).alias("n")
    )
    told = rows.select(F.col(sample).alias("sample"), F.explode(variations).alias("v")).where("v.read_index >= 1")
    varied = told.groupBy("sample", F.col("v.read_index").alias("read_index")).agg(F.count(F.lit(1)).alias("n_variant"))
    joined = reach.join(varied, ["sample", "read_index"], "left").na.fill(0, ["n_variant"])
    return joined.select("sample", "read_index", "n_variant", F.greatest(F.col("n") - F.col("n_variant"), F.lit(0)).alias("n_reference"))


def base_table(df: DataFrame, sequence: Column) -> DataFrame:
    """``place, a, c, g, t, other``: letters by place (from 0) over all sequences, counted before the shuffle."""
    letters = df.select(F.posexplode(F.split(F.upper(sequence), "")).alias("place", "letter")).where("letter <> ''")
    one = lambda b: F.count_if(F.col("letter") == b)
    return letters.groupBy("place").agg(*[one(b).alias(b.lower()) for b in "ACGT"], F.count_if(~F.col("letter").isin(*"ACGT")).alias("other"))


def splice_counts(entries: DataFrame) -> DataFrame:
    """``target, first_base, last_base, strand, n``: how many spliced parts jump from where to where (first and last base of the gap, from 1)."""
    jumps = entries.where("next_position is not null").select(
        "target", (F.col("position") + F.col("target_length") + 1).alias("first_base"), F.col("next_position").alias("last_base"),
        F.when(F.col("reverse"), "-").otherwise("+").alias("strand"),
    )
    return jumps.groupBy("target", "first_base", "last_base", "strand").agg(F.count(F.lit(1)).alias("n"))


def last_before(points: DataFrame, ranges: DataFrame, target: str, position: str, start: str, carried: Sequence[str], block: int = 1 << 16) -> DataFrame:
    """``points`` with the ``carried`` columns of the last range (greatest ``start``) that starts at or before ``position``.

    Both are ordered together in blocks, so that no pairs are made; points without such a range have nulls.
    """
    told = ranges.where(F.col(target).isNotNull() & F.col(start).isNotNull()).select(
        F.col(target), F.col(start).cast("long").alias("__at"), F.struct(F.col(start).cast("long").alias("__s"), *[F.col(c).alias(f"__{c}") for c in carried]).alias("__range")
    )
    asked = points.select(F.col(target), F.col(position).cast("long").alias("__at"), F.struct(*points.columns).alias("__point"))
    events = told.unionByName(asked, allowMissingColumns=True)
    found = running(events, [target], "__at", {"__last": ("max", "__range")}, block).where("__point is not null")
    return found.select("__point.*", *[F.col(f"__last.__{c}").alias(c) for c in carried])


def containing_range(points: DataFrame, ranges: DataFrame, target: str, start: str, end: str, range_id: str, range_start: str, range_end: str) -> DataFrame:
    """``points`` with the id of the range that holds them from ``start`` to ``end``; ranges do not overlap each other."""
    named = ranges.select(target, F.col(range_start).alias("__rs"), F.col(range_end).alias("__re"), F.col(range_id).alias("__id"))
    found = last_before(points, named.withColumnsRenamed({"__rs": "rs", "__re": "re", "__id": "rid"}), target, start, "rs", ["re", "rid"])
    return found.withColumn(range_id, F.when(F.col("re") >= F.col(end), F.col("rid"))).drop("re", "rid")


def depth_at(points: DataFrame, runs: DataFrame, target: str, position: str, block: int = 1 << 16) -> DataFrame:
    """``points`` with ``depth``, that of the run they lie in, 0 outside."""
    r = runs.select(F.col("target").alias(target), F.col("position").alias("rs"), (F.col("position") + F.col("length")).alias("re"), F.col("depth").alias("rd"))
    found = last_before(points, r, target, position, "rs", ["re", "rd"], block)
    return found.withColumn("depth", F.when(F.col("re") > F.col(position), F.col("rd")).otherwise(0)).drop("re", "rd")


def chunks(df: DataFrame, index: str, n: int) -> DataFrame:
    """``df`` with ``file``: rows in order of ``index``, ``n`` different ones a file."""
    numbered = dense_index(df, index, "__i")
    return df.join(numbered, index).withColumn("file", F.floor(F.col("__i") / n)).drop("__i")


for _name, _filter in (
    ("positive_length", lambda df: df.where("query_length > 0")),
    ("unspliced", lambda df: df.where("next_position is null and previous_position is null")),
):
    registry.register("alignment_filter", _name, _filter)
registry.register("position_aggregate", "start_counts", lambda df, target, position: df.groupBy(target, position).agg(F.count(F.lit(1)).alias("n")))
registry.register("row_processor", "capped_sites", capped_sites)
