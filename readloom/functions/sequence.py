"""Column expressions for sequences and qualities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom import registry


def complement(s: Column) -> Column:
    return F.translate(s, "ACGTacgt", "TGCAtgca")


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def bisulfite(s: Column) -> Column:
    """Every C reads as T."""
    return F.translate(s, "Cc", "Tt")


def gc_share(s: Column) -> Column:
    n = F.length(s)
    return F.when(n > 0, (n - F.length(F.translate(s, "GCgc", ""))) / n)


def at_share(s: Column) -> Column:
    n = F.length(s)
    return F.when(n > 0, (n - F.length(F.translate(s, "ATat", ""))) / n)


def base_share(s: Column, base: str) -> Column:
    n = F.length(s)
    return F.when(n > 0, (n - F.length(F.translate(s, base, ""))) / n)


# Intercept and slope of the linear correction.
LINEAR_CORRECTION = (10.4436, 8.266972)


def gc_correction_weight(s: Column) -> Column:
    """Linear correction of coverage by the share of G and C among A, C, G, T."""
    known = F.length(s) - F.length(F.translate(s, "ACGTacgt", ""))
    gc = F.length(s) - F.length(F.translate(s, "GCgc", ""))
    return F.when(known > 0, F.lit(LINEAR_CORRECTION[0]) - F.lit(LINEAR_CORRECTION[1]) * gc / known)


def log_gc_weight(s: Column) -> Column:
    """Logarithm of the linear correction's reciprocal."""
    return -F.log(gc_correction_weight(s))


for _name, _weight in (("gc", gc_share), ("at", at_share), ("atgc", gc_correction_weight), ("log-gc", log_gc_weight)):
    registry.register("weight", _name, _weight)


def color_space(s: Column) -> Column:
    """First base, then a digit per pair of bases; pairs with other letters give 4."""
    bases = "ACGT"
    code = F.create_map(*[F.lit(x) for a in bases for b in bases for x in (a + b, str(bases.index(a) ^ bases.index(b)))])
    pairs = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.coalesce(code[F.upper(F.substr(s, i, F.lit(2)))], F.lit("4")))
    return F.when(F.length(s) < 2, s).otherwise(F.concat(F.substr(s, F.lit(1), F.lit(1)), F.array_join(pairs, "")))


def kmers(s: Column, k: int) -> Column:
    """All substrings of length ``k`` without letters other than A, C, G, T."""
    n = F.length(s)
    all_ = F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.upper(F.substr(s, i, F.lit(k)))))
    return F.filter(F.coalesce(all_, F.array().cast("array<string>")), lambda m: m.rlike("^[ACGT]+$"))


def motif_count(s: Column, motif: str) -> Column:
    """Occurrences of ``motif``, overlapping ones too."""
    n = F.length(s) - len(motif) + 1
    return F.when(n < 1, 0).otherwise(
        F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(s, i, F.lit(len(motif))) == motif))
    )


def mismatches(a: Column, b: Column) -> Column:
    """Positions at which two strings differ, the surplus of the longer one included."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1)))
    return F.greatest(F.length(a), F.length(b)) - F.when(n < 1, 0).otherwise(F.size(same))


# ASCII offsets of quality encodings.
OFFSETS = {"sanger": 33, "phred": 0, "illumina": 64, "solexa": 64, "bam": 0}


def decode_quality(text: Column, encoding: str = "sanger") -> Column:
    """Phred scores of an ASCII quality string."""
    offset = OFFSETS[encoding]

    def one(c: Column) -> Column:
        q = F.ascii(c) - offset
        if encoding == "solexa":
            q = F.round(F.lit(10.0) * F.log10(F.pow(F.lit(10.0), q / 10.0) + 1)).cast("int")
        return q.cast("tinyint")

    return F.when(F.length(text) == 0, F.array().cast("array<tinyint>")).otherwise(F.transform(F.split(text, ""), one))


def encode_quality(scores: Column, encoding: str = "sanger") -> Column:
    offset = OFFSETS[encoding]

    def one(q: Column) -> Column:
        q = q.cast("int")
        if encoding == "solexa":
            q = F.round(F.lit(10.0) * F.log10(F.greatest(F.pow(F.lit(10.0), q / 10.0) - 1, F.lit(1e-5)))).cast("int")
        return F.char(q + offset)

    return F.array_join(F.transform(scores, one), "")


def trim_adapter(sequence: Column, adapter: str, min_left: int = 4, min_right: int = 4) -> Column:
    """``(start, length)`` of what is left of a read, to cut its qualities by too.

    An adapter inside the read cuts the shorter side away; else the longest adapter end that
    begins the read and the longest adapter start that ends it are cut.
    """
    n, at = F.length(sequence), F.locate(adapter, sequence)
    after = at + len(adapter)
    keep_left = (at - 1) >= (n - after + 1)
    inside = F.struct(F.when(keep_left, 1).otherwise(after).alias("start"), F.when(keep_left, at - 1).otherwise(n - after + 1).alias("length"))
    left = F.lit(0)
    for k in range(min_left, len(adapter)):
        left = F.when(sequence.startswith(adapter[-k:]), k).otherwise(left)
    right = F.lit(0)
    for k in range(min_right, len(adapter)):
        right = F.when(sequence.endswith(adapter[:k]), k).otherwise(right)
    ends = F.struct((left + 1).alias("start"), F.greatest(n - left - right, F.lit(0)).alias("length"))
    return F.when(at > 0, inside).otherwise(ends)


def best_barcode(sequence: Column, barcodes: list[str], allowed: int) -> Column:
    """``(barcode_index, differences, ambiguous)`` of the barcode nearest to the read's start, or null."""
    found = F.array(*[
        F.struct(mismatches(F.substr(sequence, F.lit(1), F.lit(len(b))), F.lit(b)).alias("differences"), F.lit(i).alias("barcode_index"))
        for i, b in enumerate(barcodes)
    ])
    best = F.array_min(found)
    ties = F.size(F.filter(found, lambda f: f["differences"] == best["differences"]))
    return F.when(best["differences"] <= allowed, F.struct(best["barcode_index"].alias("barcode_index"), best["differences"].alias("differences"), (ties > 1).alias("ambiguous")))


def best_end_barcode(sequence: Column, barcodes: list[str], allowed: int, least: int = 5) -> Column:
    """``(barcode_index, length, differences, ambiguous)`` of the barcode whose beginning fits the read's end best, or null.

    At least ``least`` bases of a barcode (all of a shorter one) must be there; fewer differences win, then the longer fit.
    """
    found = F.array(*[
        F.struct(
            mismatches(F.substr(sequence, F.greatest(F.length(sequence) - k + 1, F.lit(1)), F.lit(k)), F.lit(b[:k])).alias("differences"),
            F.lit(-k).alias("shortness"), F.lit(i).alias("barcode_index"),
        )
        for i, b in enumerate(barcodes) for k in range(min(least, len(b)), len(b) + 1)
    ])
    fits = F.filter(found, lambda f: (f["differences"] <= allowed) & (F.length(sequence) >= -f["shortness"]))
    best = F.array_min(fits)
    ties = F.filter(fits, lambda f: (f["differences"] == best["differences"]) & (f["shortness"] == best["shortness"]))
    return F.when(F.size(fits) > 0, F.struct(
        best["barcode_index"].alias("barcode_index"), (-best["shortness"]).alias("length"), best["differences"].alias("differences"), (F.size(ties) > 1).alias("ambiguous")
    ))


def arcsine_root(share: Column) -> Column:
    return F.asin(F.sqrt(share))


def base_index(base: Column) -> Column:
    """A, T, C, G and others as 0 to 4."""
    at = F.instr(F.lit("ATCG"), F.upper(base))
    return F.when((F.length(base) == 1) & (at > 0), at - 1).otherwise(4)


def rounded_length(length: Column, step: int) -> Column:
    """The next multiple of ``step``."""
    return F.ceil(length / step) * step


def absolute_position(target_offset: Column, position: Column) -> Column:
    return target_offset.cast("long") + position


def quality_in_range(scores: Column, least: int = 0, most: int = 93) -> Column:
    return F.forall(F.coalesce(scores, F.array().cast("array<tinyint>")), lambda q: q.between(least, most))


def name_attributes(name: Column, names: list[str], delimiter: str = "-") -> Column:
    """Parts of a file name between delimiters as a struct; missing parts are null, the extension is dropped."""
    parts = F.split(F.regexp_replace(name, r"\.[^./]*$", ""), delimiter)
    return F.struct(*[F.get(parts, i).alias(n) for i, n in enumerate(names)])
