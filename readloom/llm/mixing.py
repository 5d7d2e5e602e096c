"""Mixing sources to target shares of tokens by entropy balancing.

Each document gets a rate between 0 and its source's cap. Of all rates that meet the token
constraints the ones nearest to the base rate in (bounded) entropy are exponential tilts of
it: the odds of a rate against its cap are multiplied by ``exp(tilt * tokens)``. The tilts
solve a convex dual, one number a source, by Newton steps whose sums are aggregated over all
documents. Rates are then rounded to whole copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.session import cut_lineage

WHITE = " \t\r\n"


def source_key(source: Column) -> Column:
    """Sources are compared trimmed and in lower case."""
    return F.lower(F.btrim(source, F.lit(WHITE)))


def read_targets(
    targets: DataFrame, source: str = "source", share: str = "target_share", repeats: str = "max_repeats", most: int = 10_000
) -> dict[str, tuple[float, int]]:
    """Target share and cap of each source; more than ``most`` sources are an error.

    A source that is listed twice gets the sum of its shares and its greatest cap; null
    sources, shares and caps below one are no targets.
    """
    rows = (
        targets.select(source_key(F.col(source)).alias("s"), F.col(share).cast("double").alias("t"), F.col(repeats).cast("int").alias("r"))
        .where("s is not null and t >= 0 and r >= 1").limit(most + 1).collect()
    )
    if len(rows) > most:
        raise ValueError(f"more than {most} sources have targets")
    out: dict[str, tuple[float, int]] = {}
    for row in sorted(rows):
        t, r = out.get(row.s, (0.0, 0))
        out[row.s] = (t + row.t, max(r, row.r))
    return out


def _rate(base: Column, cap: Column, tilt: Column, x: Column) -> Column:
    """cap * odds / (1 + odds) with odds base / (cap - base) * exp(tilt * x)."""
    logit = F.log(base / (cap - base)) + tilt * x
    return cap / (F.lit(1.0) + F.exp(-logit))


class _Dual:
    """One source's part of the dual: a tilt with a bracket that Newton steps must stay in."""

    def __init__(self, goal: float, scale: float):
        self.goal, self.scale = goal, scale
        self.tilt, self.low, self.high = 0.0, -math.inf, math.inf
        self.done = goal <= 0
        self.steps = 0

    def step(self, reached: float, slope: float, tolerance: float) -> None:
        if self.done or abs(reached - self.goal) <= tolerance * max(self.goal, 1.0):
            self.done = True
            return
        self.steps += 1
        if reached < self.goal:
            self.low = self.tilt
        else:
            self.high = self.tilt
        new = self.tilt + (self.goal - reached) / slope if slope > 0 else math.nan
        if not self.low < new < self.high:
            if math.isinf(self.low) or math.isinf(self.high):
                far = 2.0 * max(abs(self.tilt), 1.0 / self.scale)
                new = self.tilt + far if math.isinf(self.high) else self.tilt - far
            else:
                new = (self.low + self.high) / 2
        self.tilt = new


_BINS = 4096


def _rounding_cuts(drawn: DataFrame, goals: dict[str, float]) -> DataFrame:
    """``source, cut``: documents whose margin lies below the cut are rounded up.

    A cut of 0 meets the goal on average; the cut that meets it best is found on the tokens
    counted by source and 1/4096 of the margin.
    """
    known = drawn.sparkSession.createDataFrame(list(goals.items()), "source string, goal double")
    down = F.floor("rate") * F.col("n_tokens")
    bins = (
        drawn.join(F.broadcast(known), "source")
        .groupBy("source", "goal", F.floor((F.col("margin") + 1) / 2 * _BINS).alias("bin"))
        .agg(F.sum(down).alias("down"), F.sum(F.when(F.col("part") > 0, F.col("n_tokens")).otherwise(0)).alias("up"))
    )
    by_bin = Window.partitionBy("source").orderBy("bin")
    reached = F.sum("down").over(Window.partitionBy("source")) + F.sum("up").over(by_bin)
    return (
        bins.withColumn("miss", F.abs(reached - F.col("goal")))
        .groupBy("source").agg(F.min_by("bin", F.struct("miss", "bin")).alias("bin"))
        .select("source", ((F.col("bin") + 1) / _BINS * 2 - 1).alias("cut"))
    )


def mix_total(total: float, targets: dict[str, tuple[float, int]], held: dict[str, float], absent: float) -> float:
    """The size of the mix in which sources that can reach their share have it.

    Short sources (share of ``total`` above cap times tokens) give U tokens at most; the others, with
    shares that add up to R, have theirs in a mix of M = U / (1 - R) tokens, for M = R * M + U. Short sources that
    can't give ``absent`` of their goal are left out of this, or one nearly empty source would empty
    the mix; shares are then those among the rest.
    """
    given = rest = 0.0
    short = False
    for source, (share, cap) in targets.items():
        goal, most = share * total, cap * held.get(source, 0.0)
        if goal > most:
            if most >= absent * goal:
                short, given, rest = True, given + most, rest + share
    return min(total, given / rest) if short else total


def balance(
    sizes: DataFrame,
    targets: dict[str, tuple[float, int]],
    keep: str = "shares",
    absent: float = 0.1,
    tolerance: float = 1e-6,
    max_steps: int = 60,
    seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """Copies of each document, and what each source reaches.

    ``sizes`` has ``doc_id``, ``source`` (any spelling) and ``n_tokens``; the total T is the tokens
    of all documents whose source has a target. The first result is ``doc_id, source, n_tokens,
    rate, copies`` of all these documents, the second one row per target with ``source,
    target_share, max_repeats, n_docs, n_tokens, goal_tokens, reachable, mix_goal, tilt, steps,
    expected_tokens, mixed_tokens, actual_share``. A source whose goal (share times T) is above its cap times
    its tokens, where the dual has no solution, is not reachable and gives all copies it may.
    The mix is then smaller than T: with ``keep="shares"`` the others get their share of the mix as
    it is (``mix_goal``, see ``mix_total``), with ``keep="size"`` their share of T, which is more than
    their share of the mix. Where all sources are reachable both are the same.

    Only sums by source reach the driver. Newton steps run on documents counted by source and
    size; a source with most documents is combined before every shuffle. A rate is rounded up
    or down by a hash of the document, with one threshold a source that meets its goal best. Documents without
    tokens, with null source or of sources without target have no copies. Repeated documents
    count each; empty tables give empty copies and a report of zeros.
    """
    spark = sizes.sparkSession
    schema = "source string, target_share double, cap double"
    goals = spark.createDataFrame([(s, t, float(r)) for s, (t, r) in targets.items()], schema)
    docs = cut_lineage(
        sizes.select("doc_id", source_key(F.col("source")).alias("source"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens"))
        .where(F.col("source").isin(list(targets)) if targets else F.lit(False))
    )
    by_size = cut_lineage(docs.where("n_tokens > 0").groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("m")))
    sums = {
        r.source: (r.n, r.s)
        for r in docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("s")).collect()
    }
    total = sum(s for _, s in sums.values())
    if keep not in ("shares", "size"):
        raise ValueError("keep must be shares or size")
    mixed = mix_total(total, targets, {k: s for k, (_, s) in sums.items()}, absent) if keep == "shares" else total
    duals: dict[str, _Dual] = {}
    for source, (share, cap) in targets.items():
        n, held = sums.get(source, (0, 0))
        # Who can't reach the share of all tokens gives all there is, also where the mix is small.
        if held and 0 < share * total <= cap * held and share * mixed < cap * held:
            duals[source] = _Dual(share * mixed, held / n)

    def tilted(frame: DataFrame) -> DataFrame:
        state = spark.createDataFrame(
            [(s, float(targets[s][1]), min(1.0, targets[s][1] / 2), d.tilt) for s, d in duals.items()],
            "source string, cap double, base double, tilt double",
        )
        return frame.join(F.broadcast(state), "source", "left")

    x, rate = F.col("n_tokens").cast("double"), _rate(F.col("base"), F.col("cap"), F.col("tilt"), F.col("n_tokens"))
    for _ in range(max_steps):
        if all(d.done for d in duals.values()):
            break
        step = (
            tilted(by_size).where("cap is not null").withColumn("rate", rate).groupBy("source")
            .agg(
                F.sum(F.col("m") * x * F.col("rate")).alias("reached"),
                F.sum(F.col("m") * x * x * F.col("rate") * (1 - F.col("rate") / F.col("cap"))).alias("slope"),
            )
        )
        for row in step.collect():
            duals[row.source].step(row.reached, row.slope, tolerance)
    full = spark.createDataFrame([(s, float(r)) for s, (t, r) in targets.items() if t > 0 and s not in duals], "source string, full double")
    uniform = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    rated = (
        tilted(docs).join(F.broadcast(full), "source", "left")
        .withColumn("rate", F.when(F.col("n_tokens") <= 0, 0.0).otherwise(F.coalesce(rate, F.col("full"), F.lit(0.0))))
    )
    part = F.col("rate") - F.floor("rate")
    drawn = rated.select("doc_id", "source", "n_tokens", "rate", part.alias("part"), (uniform - part).alias("margin"))
    cut = _rounding_cuts(drawn, {s: d.goal for s, d in duals.items()})
    up = (F.col("part") > 0) & (F.col("margin") < F.coalesce("cut", F.lit(0.0)))
    copies = drawn.join(F.broadcast(cut), "source", "left").select(
        "doc_id", "source", "n_tokens", "rate", (F.floor("rate") + up.cast("int")).cast("int").alias("copies")
    )
    reached = copies.groupBy("source").agg(
        F.sum(F.col("rate") * F.col("n_tokens")).alias("expected_tokens"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens")
    )
    told = spark.createDataFrame(
        [
            (s, t, r, sums.get(s, (0, 0))[0], sums.get(s, (0, 0))[1], t * total, t * total <= r * sums.get(s, (0, 0))[1], t * mixed,
             duals[s].tilt if s in duals else None, duals[s].steps if s in duals else 0)
            for s, (t, r) in targets.items()
        ],
        "source string, target_share double, max_repeats int, n_docs long, n_tokens long, goal_tokens double, reachable boolean, mix_goal double, tilt double, steps int",
    )
    report = told.join(reached, "source", "left").na.fill(0, ["expected_tokens", "mixed_tokens"])
    everything = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))
    # One row a target: the window is as small as the table of targets.
    share = F.when(everything > 0, F.col("mixed_tokens") / everything).otherwise(0.0)
    return copies, report.withColumn("actual_share", share)
