"""Coverage, peaks, range joins and consolidation of intervals on targets.

Intervals are half open: ``start`` up to but without ``end``. Rows with a null target,
start or end, and empty intervals, cover nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.operators.prefix import neighbours, running
from readloom.session import cut_lineage


def _plain(df: DataFrame, target: str, start: Column | str, end: Column | str, weight: Column | None = None) -> DataFrame:
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    weight = F.lit(1) if weight is None else weight
    return df.select(
        F.col(target).alias("target"), start.cast("long").alias("start"), end.cast("long").alias("end"), weight.alias("weight")
    ).where("target is not null and start < end")


def coverage(df: DataFrame, target: str, start, end, weight: Column | None = None, block: int = 1 << 16) -> DataFrame:
    """``target, position, length, depth``: runs of equal depth, runs of depth 0 between others too.

    Start and end events are summed by position before anything is ordered; with ``weight``
    the depth is the sum of weights. Positions where the depth doesn't change begin no run.
    """
    spans = _plain(df, target, start, end, weight)
    # Read twice, for the blocks and for their rows.
    events = cut_lineage(
        spans.select("target", F.inline(F.array(
            F.struct(F.col("start").alias("position"), F.col("weight").alias("change")),
            F.struct(F.col("end").alias("position"), (-F.col("weight")).alias("change")),
        )))
        .groupBy("target", "position").agg(F.sum("change").alias("change")).where("change <> 0")
    )
    runs = running(events, ["target"], "position", {"depth": ("sum", "change")}, block, carry=["position"])
    return runs.where("next_position is not null").select(
        "target", "position", (F.col("next_position") - F.col("position")).alias("length"), "depth"
    )


def start_counts(df: DataFrame, target: str, start, end, reverse: Column | None = None, strand: str = "both") -> DataFrame:
    """``target, position, n``: how many reads begin where; a reverse read begins at its last base."""
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    back = F.lit(False) if reverse is None else F.coalesce(reverse, F.lit(False))
    rows = df.where(F.lit(True) if strand == "both" else back if strand == "reverse" else ~back)
    return (
        rows.select(F.col(target).alias("target"), F.when(back, end - 1).otherwise(start).cast("long").alias("position"))
        .where("target is not null and position is not null")
        .groupBy("target", "position").agg(F.count(F.lit(1)).alias("n"))
    )


def islands(df: DataFrame, keys: Sequence[str], position: str, begins: Column, block: int = 1 << 16) -> DataFrame:
    """``df`` with ``island``, the number of rows up to this one at which ``begins`` holds."""
    marked = df.withColumn("__begins", F.coalesce(begins, F.lit(False)).cast("long"))
    return running(marked, keys, position, {"island": ("sum", "__begins")}, block).drop("__begins")


def peaks(runs: DataFrame, threshold: float, block: int = 1 << 16) -> DataFrame:
    """``target, start, length, count``: maximal stretches of runs deeper than ``threshold``.

    ``count`` adds up the depths of the runs, whatever their lengths.
    """
    above = F.col("depth") > threshold
    near = cut_lineage(neighbours(cut_lineage(runs), ["target"], "position", ["position", "length", "depth"], block).where(above))
    joins = (F.col("previous_depth") > threshold) & (F.col("previous_position") + F.col("previous_length") == F.col("position"))
    numbered = islands(near, ["target"], "position", ~F.coalesce(joins, F.lit(False)), block)
    return (
        numbered.groupBy("target", "island")
        .agg(F.min("position").alias("start"), F.sum("length").alias("length"), F.sum("depth").alias("count"))
        .drop("island")
    )


def merge_overlaps(df: DataFrame, target: str, start, end, gap: int = 0, block: int = 1 << 16) -> DataFrame:
    """``target, start, end, n``: intervals that overlap, or lie within ``gap``, as one; ``n`` went in."""
    spans = cut_lineage(_plain(df, target, start, end).groupBy("target", "start").agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("n")))
    reach = running(spans, ["target"], "start", {"reach": ("max", "end")}, block, strict=True)
    fresh = F.col("reach").isNull() | (F.col("start") > F.col("reach") + gap)
    return (
        islands(reach, ["target"], "start", fresh, block)
        .groupBy("target", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
        .drop("island")
    )


_LEVELS = 16


def _level(size: Column, width: int) -> Column:
    """The first level whose bins, 4 times as wide on each level, are at least as wide as ``size``."""
    return sum(((size > width * 4**k).cast("int") for k in range(_LEVELS - 1)), F.lit(0))


def _bin_width(width: int) -> Column:
    return (F.lit(width) * F.pow(F.lit(4), F.col("__level"))).cast("long")


def _levels_of(sides: Sequence[tuple[DataFrame, str, str]], width: int) -> list[list[int]]:
    """The levels that occur on each side, at most 16 of them, in one job."""
    sizes = [df.select(F.lit(i).alias("side"), (F.col(e) - F.col(s)).cast("long").alias("size")) for i, (df, s, e) in enumerate(sides)]
    every = sizes[0]
    for more in sizes[1:]:
        every = every.unionByName(more)
    told = every.groupBy("side").agg(F.bit_or(F.pow(F.lit(2), _level(F.col("size"), width)).cast("long")).alias("levels")).collect()
    found = {r["side"]: r["levels"] for r in told}
    return [[k for k in range(_LEVELS) if found.get(i, 0) >> k & 1] for i in range(len(sides))]


def range_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], width: int, how: str = "overlap",
    bounds: tuple[str, str, str, str] = ("l_start", "l_end", "r_start", "r_end"),
) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose intervals overlap (or, ``contained``: left within right).

    Each interval is at home on the level whose bins (``width`` on the first, 4 times as wide on each further one) are as wide as it is, so
    that it lies in two bins at most however long it is. It meets longer intervals in the bins of their level; only levels that
    the other side has are visited. A pair that meets in several bins is kept in the first. ``width`` should be
    about the usual length. Column names of both sides but the keys must differ.
    """
    ls, le, rs, re_ = bounds
    a, b = left.where(F.col(ls) < F.col(le)), right.where(F.col(rs) < F.col(re_))
    left_levels, right_levels = _levels_of([(a, ls, le), (b, rs, re_)], width)
    test = (F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le))
    if how == "contained":
        test = (F.col(ls) >= F.col(rs)) & (F.col(le) <= F.col(re_))
        # What is longer than any interval of the other side lies in none.
        most = max(right_levels, default=0)
        left_levels, a = [k for k in left_levels if k <= most], a.where(F.col(le) - F.col(ls) <= width * 4**most)
    if len({*left_levels, *right_levels}) <= 1:
        size = width * 4 ** max([*left_levels, *right_levels, 0])
        bins = lambda start, end: F.explode(F.sequence(F.floor(F.col(start) / size), F.floor((F.col(end) - 1) / size)))
        met = a.withColumn("__bin", bins(ls, le)).join(b.withColumn("__bin", bins(rs, re_)), [*keys, "__bin"])
        return met.where(test & (F.floor(F.greatest(F.col(ls), F.col(rs)) / size) == F.col("__bin"))).drop("__bin")

    def spread(df: DataFrame, start: str, end: str, visited: list[int], side: str) -> DataFrame:
        home = _level(F.col(end) - F.col(start), width)
        levels = F.filter(F.array(*[F.lit(k) for k in visited]).cast("array<int>"), lambda k: k > home)
        size = _bin_width(width)
        placed = df.withColumn(f"__home_{side}", home).withColumn("__level", F.explode(F.array_union(F.array(home), levels)))
        return placed.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor((F.col(end) - 1) / size))))

    x, y = spread(a, ls, le, right_levels, "l"), spread(b, rs, re_, left_levels if how != "contained" else [], "r")
    on = [*keys, "__level", "__bin"]
    at_home_l, at_home_r = F.col("__home_l") == F.col("__level"), F.col("__home_r") == F.col("__level")
    # Two that only visit a level don't meet there.
    met = x.where(at_home_l).join(y, on)
    if any(k > min(left_levels, default=_LEVELS) for k in right_levels):
        met = met.unionByName(x.where(~at_home_l).join(y.where(at_home_r), on))
    first = F.floor(F.greatest(F.col(ls), F.col(rs)) / _bin_width(width)) == F.col("__bin")
    return met.where(test & first).drop("__bin", "__level", "__home_l", "__home_r")


def trailing_counts(df: DataFrame, keys: Sequence[str], position: str, width: int, name: str = "n", block: int = 1 << 16) -> DataFrame:
    """``df`` with ``name``, the rows of its key from ``position - width`` to its position, both included.

    Rows are counted by place; the number is the difference of two running counts, so that a key with most rows is
    not ordered by one task. Rows with a null position or key have none.
    """
    keys = list(keys)
    places = cut_lineage(df.where(F.col(position).isNotNull()).groupBy(*keys, F.col(position).cast("long").alias("__p")).agg(F.count(F.lit(1)).alias("__m")))
    ask = lambda at, sign: places.select(*keys, at.alias("__at"), F.lit(0).cast("long").alias("__m"), F.col("__p"), F.lit(sign).alias("__sign"))
    events = (
        places.select(*keys, F.col("__p").alias("__at"), "__m").unionByName(ask(F.col("__p") + 1, 1), allowMissingColumns=True)
        .unionByName(ask(F.col("__p") - width, -1), allowMissingColumns=True)
    )
    read = running(events, keys, "__at", {"__c": ("sum", "__m")}, block, strict=True).where("__sign is not null")
    told = read.groupBy(*keys, "__p").agg(F.sum(F.col("__sign") * F.coalesce("__c", F.lit(0))).alias(name))
    return df.withColumn("__p", F.col(position).cast("long")).join(told, [*keys, "__p"], "left").select(*df.columns, name)


def overlap_counts(reads: DataFrame, regions: DataFrame, target: str, block: int = 1 << 16) -> DataFrame:
    """``regions`` with ``n_overlapping`` reads: starts before its end less ends up to its start.

    Both have ``start`` and ``end``; no pairs are made: reads and region bounds are ordered
    together, and running counts are read off at the bounds.
    """
    spans = _plain(reads, target, "start", "end")
    marked = regions.withColumn("__id", F.struct(*regions.columns))
    bounds = marked.select(
        F.col(target).alias("target"), "__id",
        F.inline(F.array(
            F.struct(F.col("end").cast("long").alias("position"), F.lit(1).alias("side")),
            F.struct((F.col("start") + 1).cast("long").alias("position"), F.lit(-1).alias("side")),
        )),
    ).distinct()
    zero, none, kind = F.lit(0).cast("long"), F.lit(None), marked.schema["__id"].dataType
    events = (
        spans.groupBy("target", F.col("start").alias("position")).agg(F.count(F.lit(1)).alias("s"))
        .select("target", "position", "s", zero.alias("e"), none.cast(kind).alias("__id"), none.cast("int").alias("side"))
        .unionByName(
            spans.groupBy("target", F.col("end").alias("position")).agg(F.count(F.lit(1)).alias("e"))
            .select("target", "position", zero.alias("s"), "e", none.cast(kind).alias("__id"), none.cast("int").alias("side"))
        )
        .unionByName(bounds.select("target", "position", zero.alias("s"), zero.alias("e"), "__id", "side"))
    )
    read = running(events, ["target"], "position", {"starts": ("sum", "s"), "ends": ("sum", "e")}, block, strict=True)
    counted = read.where("side is not null").groupBy("__id").agg(
        F.sum(F.when(F.col("side") == 1, F.col("starts")).otherwise(-F.col("ends"))).alias("n_overlapping")
    )
    return marked.join(counted, "__id", "left").drop("__id").na.fill(0, ["n_overlapping"])


def average_depth(runs: DataFrame, regions: DataFrame, target: str, width: int) -> DataFrame:
    """``regions`` (with ``start``, ``end``) with ``average_depth``: depth times length inside over the size."""
    r = runs.select(F.col("target").alias(target), F.col("position").alias("l_start"), (F.col("position") + F.col("length")).alias("l_end"), "depth")
    g = regions.withColumn("r_start", F.col("start")).withColumn("r_end", F.col("end"))
    pairs = range_join(r.where("depth <> 0"), g, [target], width)
    inside = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    names = {c: f"__g_{c}" for c in regions.columns}
    sums = pairs.groupBy(*regions.columns).agg(F.sum(F.col("depth") * inside).alias("__covered")).withColumnsRenamed(names)
    on = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    mean = F.coalesce("__covered", F.lit(0)) / (F.col("end") - F.col("start"))
    return regions.join(sums, on, "left").select(*regions.columns, mean.alias("average_depth"))


def _after(places, threshold):
    """For each place (in order) the number of the first one more than ``threshold`` after it."""
    import numpy as np

    return np.searchsorted(places, places + threshold, "right")


def _block_exits(threshold: float, width: int):
    """Per block: the places at which a chain may enter it, and the last anchor of the chain from each."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        places = np.sort(table.column("p").to_numpy())
        start, n = table.column("b")[0].as_py() * width, len(places)
        # From each place to the last anchor before the block's end, from the last place down.
        step, last = _after(places, threshold).tolist(), list(range(n))
        for i in range(n - 1, -1, -1):
            if step[i] < n:
                last[i] = last[step[i]]
        entries = min(int(np.searchsorted(places, start + threshold, "right")) + 1, n)
        return pa.table({
            "t": table.column("t").slice(0, 1), "b": table.column("b").slice(0, 1),
            "entries": pa.array([places[:entries].tolist()], pa.list_(table.column("p").type)), "exits": pa.array([places[np.array(last[:entries])].tolist()], pa.list_(table.column("p").type)),
        })

    return run


def _chain(threshold: float):
    """Per target: the anchor in force where each block begins, from the blocks' entries and exits in order."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("b")
        anchor, came = None, []
        for entries, exits in zip(table.column("entries").to_pylist(), table.column("exits").to_pylist()):
            came.append(anchor)
            at = 0 if anchor is None else int(np.searchsorted(entries, anchor + threshold, "right"))
            if at < len(entries):
                anchor = exits[at]
        return pa.table({"t": table.column("t"), "b": table.column("b"), "came": pa.array(came, table.schema.field("entries").type.value_type)})

    return run


def _anchors(threshold: float):
    """Per block: the anchor of each place, from the one in force where the block begins."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("p")
        places, came = table.column("p").to_numpy(), table.column("came")[0].as_py()
        step, n = _after(places, threshold), len(places)
        at = 0 if came is None else int(np.searchsorted(places, came + threshold, "right"))
        visited = []
        first = at
        while at < n:
            visited.append(at)
            at = int(step[at])
        anchors = np.empty(n, dtype=places.dtype)
        anchors[:first] = 0 if came is None else came
        if visited:
            number = np.searchsorted(np.array(visited), np.arange(first, n), "right") - 1
            anchors[first:] = places[np.array(visited)][number]
        return pa.table({"t": table.column("t"), "p": table.column("p"), "anchor": pa.array(anchors, table.column("p").type)})

    return run


def anchor_clusters(df: DataFrame, target: str, position: str, threshold: float, block: int = 1 << 16) -> DataFrame:
    """``df`` with ``anchor``: the first position of its greedy cluster along a target.

    A row joins the cluster while its distance to the cluster's **first** row is at most
    ``threshold``. Positions are whole numbers. They are cut into blocks; each block tells for the few places at which a chain of
    clusters may enter it where that chain leaves it, the blocks of a target are then followed one after another (a row a block), and
    each block sets its anchors. Rows with a null position or target have a null anchor.
    """
    width = int(max(block, 64 * threshold))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    t, p = kinds[target], kinds[position]
    told = F.col(target).isNotNull() & F.col(position).isNotNull()
    places = cut_lineage(
        df.where(told).select(F.col(target).alias("t"), F.col(position).alias("p")).distinct().withColumn("b", F.floor(F.col("p") / width).cast("long"))
    )
    exits = places.groupBy("t", "b").applyInArrow(_block_exits(threshold, width), f"t {t}, b long, entries array<{p}>, exits array<{p}>")
    came = exits.groupBy("t").applyInArrow(_chain(threshold), f"t {t}, b long, came {p}")
    found = places.join(came, ["t", "b"]).groupBy("t", "b").applyInArrow(_anchors(threshold), f"t {t}, p {p}, anchor {p}")
    named = found.select(F.col("t").alias(target), F.col("p").alias(position), F.col("anchor").alias("__anchor"))
    return df.join(named, [target, position], "left").select(*df.columns, F.col("__anchor").alias("anchor"))


def depth_tally(runs: DataFrame) -> DataFrame:
    """``depth, sites, bases, sites_upto``: positions and bases at each depth, and at least that depth."""
    from pyspark.sql import Window

    by = runs.groupBy("depth").agg(F.sum("length").alias("sites"), F.sum(F.col("depth") * F.col("length")).alias("bases"))
    # One row a depth: small whatever the runs.
    down = Window.partitionBy(F.lit(1)).orderBy(F.col("depth").desc())
    return by.withColumn("sites_upto", F.sum("sites").over(down))
