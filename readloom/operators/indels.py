"""Indels: equivalent placements against the genome, artifact filters and realignment scores.

A genome is a table ``target, block, bases`` of blocks of equal length, so that a row needs the
blocks around it only and no task holds a chromosome.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.variants import SITE


def genome_blocks(genome: DataFrame, size: int = 4096) -> DataFrame:
    """``target, block, bases`` of a table ``target, sequence``: each sequence is cut once, in a stream.

    For files whose sequences are too long for a row see ``sources.lines.read_fasta_blocks``.
    """
    kind = genome.schema["target"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                bases = batch.column(1)[row].as_py()
                for at in range(0, len(bases), size * 1024):
                    starts = range(at, min(at + size * 1024, len(bases)), size)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[row].as_py()] * len(starts), batch.column(0).type), pa.array([s // size for s in starts], pa.int64()), pa.array([bases[s : s + size] for s in starts])],
                        names=["target", "block", "bases"],
                    )

    return genome.where("length(sequence) > 0").select("target", "sequence").mapInArrow(run, f"target {kind}, block long, bases string")


def with_window(df: DataFrame, blocks: DataFrame, position: str, size: int = 4096) -> DataFrame:
    """``df`` with ``window``, the bases of the block of ``position`` and its neighbours, and ``window_start``."""
    near = blocks.select("target", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("__home"), "block", "bases")
    joined = near.groupBy("target", "__home").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "bases"))), lambda b: b["bases"]), "").alias("window"), F.min("block").alias("__first"))
    return (
        df.withColumn("__home", F.floor(F.col(position) / size)).join(joined, ["target", "__home"], "left")
        .withColumn("window_start", F.col("__first") * size).drop("__home", "__first")
    )


def equivalent_region(window: str, offset: int, start: int, from_: str, to: str, flank: int = 4) -> dict:
    """All places at which an indel reads the same: bounds, alleles over them and flanks.

    ``start`` is the last base before the indel, ``-`` marks the missing side; ``window`` holds
    the genome from ``offset`` on. ``open`` tells that the run goes on beyond the window.
    """
    insertion = set(from_) <= {"-"}
    unit = to if insertion else from_
    k = len(unit)
    left, right = start - offset, start - offset + (1 if insertion else k + 1)
    steps = 0
    while left >= 0 and window[left] == unit[(k - 1 - steps) % k]:
        left, steps = left - 1, steps + 1
    ahead = 0
    while right < len(window) and window[right] == unit[ahead % k]:
        right, ahead = right + 1, ahead + 1
    inner = window[left + 1 : right]
    shift = steps % k
    if insertion:
        rolled = unit[k - shift :] + unit[: k - shift]
        alleles = "-" * k + inner, rolled + inner
    else:
        alleles = inner, "-" * k + inner[k:]
    return {
        "start": left + offset, "end": right + offset, "from": alleles[0], "to": alleles[1],
        "flank_left": window[max(0, left - flank + 1) : left + 1], "flank_right": window[right : right + flank],
        "open": left < 0 and offset > 0 or right >= len(window),
    }


def equivalent_indels(indels: DataFrame, blocks: DataFrame, size: int = 4096, flank: int = 4) -> DataFrame:
    """``indels`` (``target, start, from, to``) with their ``region``; outside the genome it is null.

    Alleles are the missing bases as ``-`` and the bases on the other side.
    """
    placed = with_window(indels, blocks, "start", size)
    schema = "struct<start:long,end:long,`from`:string,`to`:string,flank_left:string,flank_right:string,open:boolean>"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in indels.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            regions = [
                equivalent_region(w, int(o), int(s), f, t, flank) if isinstance(w, str) and 0 <= s - o < len(w) else None
                for w, o, s, f, t in zip(pdf["window"], pdf["window_start"], pdf["start"], pdf["from"], pdf["to"])
            ]
            yield pdf.drop(columns=["window", "window_start"]).assign(region=regions)

    return placed.select(*indels.columns, "window", "window_start").mapInPandas(run, f"{kinds}, region {schema}")


def entropic_filter(indels: DataFrame, most: int = 10, share: float = 0.25) -> DataFrame:
    """Rows of ``target, position, sample, from, to, n`` of sites without a crowd of indels.

    A site goes if it has more than ``most`` different indels, or at least ``share`` of its
    samples have more than one.
    """
    seen = indels.where("n > 0").groupBy(*SITE, "sample").agg(F.count_distinct("from", "to").alias("k"))
    many = indels.where("n > 0").groupBy(*SITE).agg(F.count_distinct("from", "to").alias("different"))
    crowd = seen.groupBy(*SITE).agg(F.count_if(F.col("k") > 1).alias("busy"), F.count(F.lit(1)).alias("samples"))
    bad = many.join(crowd, SITE).where((F.col("different") > most) | (F.col("busy") >= F.col("samples") * share) & (F.col("busy") > 0))
    return indels.join(bad, SITE, "left_anti")


def repeat_length(bases: Column) -> Column:
    """Adjacent equal bases, gaps apart."""
    n = F.length(bases)
    same = lambda i: (F.substr(bases, i, F.lit(1)) == F.substr(bases, i + 1, F.lit(1))) & (F.substr(bases, i, F.lit(1)) != "-")
    return F.when(n < 2, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), same)))


def gap_length(bases: Column) -> Column:
    return F.length(bases) - F.length(F.translate(bases, "-", ""))


def realignment_score(window: str, offset: int, position: int, length: int, variations: list[tuple[int, str]], indel_start: int, indel_length: int, forward: bool) -> int:
    """Change of agreement with the genome if a read took up an indel.

    Variations (offset from 0 in the read's span, base) that the shift explains count 1, bases
    that matched and no longer do -1, bases shifted off the genome -10.
    """
    step = indel_length if forward else -indel_length
    base = lambda p: window[p - offset] if 0 <= p - offset < len(window) else None
    varied = {position + at for at, _ in variations}
    score = 0
    for at, to in variations:
        there = base(position + at + step)
        score += -10 if there is None else int(there == to)
    first, last = (indel_start, position + length) if forward else (position, indel_start + step)
    for p in range(first, last):
        if p not in varied:
            there = base(p + step)
            score += -10 if there is None else -int(there != base(p))
    return score


def realign(reads: DataFrame, indels: DataFrame, blocks: DataFrame, width: int = 256, size: int = 4096) -> DataFrame:
    """``read_id, start, length, forward, score``: the best indel that improves each read.

    ``reads`` have ``read_id, target, position, length, variations`` (array of at, to), ``indels``
    ``target, start, length``; pairs come from a range join, ties go to the first indel, forward.
    """
    from readloom.operators.intervals import range_join

    a = reads.withColumn("l_start", F.col("position")).withColumn("l_end", F.col("position") + F.col("length")).withColumnRenamed("length", "span")
    b = indels.select("target", "start", "length", F.col("start").alias("r_start"), (F.col("start") + 1).alias("r_end"))
    met = range_join(a, b, ["target"], width)
    # All blocks from an indel's length before the read to one after it.
    first, last = (F.floor(x / size) for x in (F.greatest(F.col("position") - F.col("length"), F.lit(0)), F.col("position") + F.col("span") + F.col("length")))
    near = met.withColumn("block", F.explode(F.sequence(first, last))).join(blocks, ["target", "block"])
    pairs = near.groupBy("read_id", "position", "span", "start", "length").agg(
        F.first("variations").alias("variations"), F.array_join(F.array_sort(F.collect_list(F.struct("block", "bases")))["bases"], "").alias("window"),
        (F.min("block") * size).alias("window_start"),
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                told = [(int(v["at"]), v["to"]) for v in (r.variations if r.variations is not None else [])]
                for forward in (True, False):
                    score = realignment_score(r.window, int(r.window_start), int(r.position), int(r.span), told, int(r.start), int(r.length), forward)
                    rows.append((r.read_id, int(r.start), int(r.length), forward, score))
            yield pd.DataFrame(rows, columns=["read_id", "start", "length", "forward", "score"])

    kind = reads.schema["read_id"].dataType.simpleString()
    scored = pairs.select("read_id", "position", "span", "variations", "start", "length", "window", "window_start").mapInPandas(
        run, f"read_id {kind}, start long, length long, forward boolean, score int"
    )
    best = F.max_by(F.struct("start", "length", "forward", "score"), F.struct("score", -F.col("start"), -F.col("length"), "forward"))
    return scored.where("score > 0").groupBy("read_id").agg(best.alias("b")).select("read_id", "b.*")


def indel_support(indels: DataFrame) -> DataFrame:
    """Indels of ``target, position, sample, from, to`` rows with their number, best first within the sample."""
    counted = indels.groupBy(*SITE, "sample", "from", "to").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*SITE, "sample").orderBy(F.col("n").desc(), "from", "to")
    return counted.withColumn("rank", F.row_number().over(order))
