"""Read collections: reformatting, weights, successors of k-mers, encodings, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import sequence as S


def length_between(df: DataFrame, length: str, least: int | None = None, most: int | None = None) -> DataFrame:
    keep = F.col(length).isNotNull()
    if least is not None:
        keep = keep & (F.col(length) >= least)
    if most is not None:
        keep = keep & (F.col(length) <= most)
    return df.where(keep)


def trim_to(df: DataFrame, sequence: str, quality: str, start: int, length: int) -> DataFrame:
    """Reads cut to ``length`` bases from ``start`` (from 1), their qualities in step."""
    return df.withColumn(sequence, F.substr(F.col(sequence), F.lit(start), F.lit(length))).withColumn(quality, F.slice(quality, start, length))


def mutate(sequence: Column, key: Column, n: int, seed: int = 1) -> Column:
    """``n`` bases replaced by others at places drawn by a hash of ``key``."""
    out = sequence
    for i in range(n):
        h = F.xxhash64(key, F.lit(seed), F.lit(i))
        at = (F.pmod(h, F.greatest(F.length(sequence), F.lit(1))) + 1).cast("int")
        old = F.substr(out, at, F.lit(1))
        # The next base in a fixed turn is never the same.
        turn = (F.pmod(F.shiftright(h, 32), F.lit(3)) + 1).cast("int")
        place = F.instr(F.lit("ACGT"), old)
        new = F.when(place > 0, F.substr(F.lit("ACGTACG"), place + turn, F.lit(1))).otherwise(old)
        out = F.when(F.length(sequence) > 0, F.overlay(out, new, at, F.lit(1))).otherwise(out)
    return out


def heptamer_weights(df: DataFrame, sequence: str, ends: int = 6, k: int = 7) -> DataFrame:
    """``kmer, weight``: mean share of a k-mer late in reads over its share at their first two places.

    Places are 0, 1 and the ``ends`` ones from 23 on; k-mers that never begin a read have no weight.
    """
    s = F.col(sequence)
    spots = [0, 1, *range(23, 23 + ends)]
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(p).alias("at"), F.substr(s, F.lit(p + 1), F.lit(k)).alias("kmer")) for p in spots])))
    counted = rows.where(F.col("kmer").rlike(f"^[ACGT]{{{k}}}$")).groupBy("kmer", "at").agg(F.count(F.lit(1)).alias("n"))
    whole = counted.groupBy("at").agg(F.sum("n").alias("all"))
    share = counted.join(F.broadcast(whole), "at").withColumn("p", F.col("n") / F.col("all"))
    early, late = F.col("at") < 2, F.col("at") >= 2
    total = lambda c: F.sum(F.when(c, F.col("p")).otherwise(0.0))
    return share.groupBy("kmer").agg((total(late) / ends).alias("late"), (total(early) / 2).alias("early")).where("early > 0").select("kmer", (F.col("late") / F.col("early")).alias("weight"))


def successors(df: DataFrame, sequence: str, group: str, k: int, approximate: bool = True) -> DataFrame:
    """``kmer, grp, n``: how many different bases follow a k-mer in each group."""
    pairs = df.select(F.col(group).alias("grp"), F.explode(S.kmers(F.col(sequence), k + 1)).alias("m"))
    kmer, following = F.substr("m", F.lit(1), F.lit(k)), F.substr("m", F.lit(k + 1), F.lit(1))
    count = F.approx_count_distinct("next") if approximate else F.count_distinct("next")
    return pairs.select("grp", kmer.alias("kmer"), following.alias("next")).groupBy("kmer", "grp").agg(count.alias("n"))


def guess_encoding(df: DataFrame, text: str) -> DataFrame:
    """``least, greatest, mean, encoding`` of ASCII quality strings: by the mean code."""
    codes = df.where(F.length(text) > 0).select(F.explode(F.split(text, "")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    a = F.ascii("c")
    told = codes.agg(F.min(a).alias("least"), F.max(a).alias("greatest"), (F.sum(a * F.col("n")) / F.sum("n")).alias("mean"))
    return told.withColumn("encoding", F.when(F.col("mean") <= 41, "Phred").when(F.col("mean") <= 83, "Sanger").otherwise("Illumina/Solexa"))


def infer_sex(df: DataFrame, sample: str, target: str) -> DataFrame:
    """``sample, hits_x, hits_y, sex``: female at a hundred times as many hits on X as on Y."""
    on = lambda c: F.count_if(F.col(target).isin(c, f"chr{c}"))
    counted = df.groupBy(F.col(sample).alias("sample")).agg(on("X").alias("hits_x"), on("Y").alias("hits_y"))
    many = (F.col("hits_x") >= 100 * F.col("hits_y")) & (F.col("hits_x") > 0)
    return counted.withColumn("sex", F.when(many, "female").otherwise("male"))


def split_by_gene(df: DataFrame, gene: str, transcript: str, most: int) -> DataFrame:
    """``df`` with ``file``: no file has two transcripts of a gene, none more than ``most`` rows.

    Transcripts of a gene are numbered; those of one number fill files in order of the gene's
    hash, counted by blocks so that no task orders them all.
    """
    from readloom.operators.prefix import running

    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(gene).orderBy(transcript)) - 1).withColumn("__h", F.pmod(F.xxhash64(gene, transcript), F.lit(1 << 40)))
    placed = running(ranked.withColumn("__one", F.lit(1)), ["__r"], "__h", {"__n": ("sum", "__one")}, 1 << 30, strict=True)
    return placed.select(*df.columns, F.concat_ws("-", F.col("__r").cast("string"), F.floor(F.col("__n") / most).cast("string")).alias("file"))


def color_codes(df: DataFrame, sequence: str) -> DataFrame:
    return df.withColumn("colors", S.color_space(F.col(sequence)))
