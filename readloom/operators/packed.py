"""Several values packed in one field: pick each field's dialect by description length.

A dialect is a set of delimiters and a set of quotes. A field is parsed under every dialect
of its column that can make a difference; what a parse costs is the sum of the code lengths
of its symbols. Code lengths come from counts over all different fields: in how many of them
a symbol occurs, in round one under any parse, later under the cheapest. A symbol's own
spelling is shared among its uses. The cheapest parse gives the items.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.session import cut_lineage

WHITE = " \t\r\n"
HASHES = 4
#: Bits of a letter, digit, point or sign, of any other character, and of saying that a symbol is spelled.
LETTER_BITS, MARK_BITS, SPELLED_BITS = 5.0, 12.0, 4.0
_MEMO = 200_000
# What delimits nothing and quotes nothing.
_PLAIN = str.maketrans("", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.+-_=")


class Dialect(NamedTuple):
    delimiters: str
    quotes: str


class Packing(NamedTuple):
    """How a column may be packed: delimiters that occur alone or mixed, and quotes.

    ``valued`` items look like ``ID`` or ``ID=values``.
    """

    delimiters: tuple[str, ...]
    mixed: tuple[str, ...] = ()
    quotes: tuple[str, ...] = ("", '"', "'", "\"'")
    valued: bool = False

    def dialects(self) -> list[Dialect]:
        return [Dialect(d, q) for d, q in product((*self.delimiters, *self.mixed), self.quotes)]


# How the packed columns of variant files may be written.
VCF_PACKINGS = {
    "info": Packing((";", "|", "\t", " "), (";|\t",), valued=True),
    "format": Packing((":", ";", ",", "/", "|", " ", "\t"), (":;", ":;,/|\t")),
    "alt": Packing((",", ";", "/", "|", " ", "\t"), (",;/|\t",)),
}


class _Parser:
    """Items of a field under one dialect: unquoted, trimmed, in order, without empty ones.

    Quotes count only around a whole item or, if ``valued``, around the value after ``=``; a
    doubled quote inside stands for one.
    """

    def __init__(self, dialect: Dialect, valued: bool):
        self.dialect, self.valued = dialect, valued
        self.split = re.compile(f"[{re.escape(dialect.delimiters)}]").split
        stop, quotes = re.escape(dialect.delimiters), re.escape(dialect.quotes)
        pattern = f"[^{stop}]++"
        if quotes:
            # Blanks around a quoted item, unless they delimit.
            gap = "[" + "".join(re.escape(c) for c in WHITE if c not in dialect.delimiters) + "]*+"
            head = f"(?:[^{stop}={quotes}]*+=)?{gap}" if valued else ""
            body = "|".join(f"{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}" for q in dialect.quotes)
            pattern = f"{gap}{head}(?:{body}){gap}(?=[{stop}]|\\Z)|{pattern}"
        self.find = re.compile(pattern).findall

    def _bare(self, text: str) -> str:
        q = text[:1]
        if len(text) > 1 and q and q in self.dialect.quotes and text[-1] == q:
            inner = text[1:-1].replace(q + q, "")
            if q not in inner:
                return text[1:-1].replace(q + q, q).strip(WHITE)
        return text

    def whole(self, field: str) -> list[str]:
        """The parse if neither a delimiter nor a quote occurs."""
        return [field] if field != "." else []

    def bare(self, field: str) -> list[str]:
        """The parse if no quote and no white space occurs."""
        parts = field.split(self.dialect.delimiters) if len(self.dialect.delimiters) == 1 else self.split(field)
        return [part for part in parts if part and part != "."]

    def plain(self, field: str) -> list[str]:
        """The parse if no quote occurs."""
        parts = field.split(self.dialect.delimiters) if len(self.dialect.delimiters) == 1 else self.split(field)
        return [item for part in parts if (item := part.strip(WHITE)) and item != "."]

    def __call__(self, field: str) -> list[str]:
        out = []
        for item in self.find(field):
            item = item.strip(WHITE)
            if item:
                whole = self._bare(item)
                if whole == item and self.valued and "=" in item:
                    name, value = item.split("=", 1)
                    whole = f"{name}={self._bare(value.strip(WHITE))}"
                item = whole
            if item and item != ".":
                out.append(item)
        return out

    def on(self, here: frozenset) -> Callable[[str], list[str]]:
        """The fastest way to parse fields in which of all marks and white space ``here`` occurs."""
        delimiters, quotes = self.dialect
        if here & set(quotes):
            return self
        if not here & set(delimiters):
            return self.whole
        return self.plain if here & set(WHITE) else self.bare


class Parses(NamedTuple):
    """Parses of many fields, a field's one after another.

    Of each parse its field, length and the bits of its dialect; of each of their items its number; of each different item
    the numbers of its symbols (the second -1 if it has one only); of each symbol its hash and the bits to spell it.
    """

    owner: np.ndarray
    sizes: np.ndarray
    fixed: np.ndarray
    ids: np.ndarray
    first: np.ndarray
    second: np.ndarray
    hashes: np.ndarray
    spelled: np.ndarray


# The types of these arrays where they are stored.
_STORED = ("<i4", "<i4", "<f8", "<i4", "<i4", "<i4", "<u8", "<f4")


def _spelling_bits(symbols: pa.Array) -> np.ndarray:
    length = pc.utf8_length(symbols).to_numpy(zero_copy_only=False).astype(float)
    marks = pc.utf8_length(pc.replace_substring_regex(symbols, r"[A-Za-z0-9.+\-]+", "")).to_numpy(zero_copy_only=False)
    return SPELLED_BITS + LETTER_BITS * (length - marks) + MARK_BITS * marks


class Unpacker:
    """Parses fields of one column; with counts, picks the cheapest parse of each."""

    def __init__(self, packing: Packing, counts: np.ndarray | None = None, slots: int = 1 << 16):
        self.valued = packing.valued
        self.parsers = [_Parser(d, packing.valued) for d in packing.dialects()]
        self.marks = frozenset("".join(p.dialect.delimiters + p.dialect.quotes for p in self.parsers) + WHITE)
        self.useful: dict[str, list[tuple[float, float, Callable[[str], list[str]]]]] = {}
        # At most one entry for each set of marks, whatever the data.
        self.by_marks: dict[frozenset, list[tuple[float, float, Callable[[str], list[str]]]]] = {}
        self.slots = slots
        if counts is not None:
            total = counts.sum(axis=1, keepdims=True)
            # What falls into a slot by chance is no sign of its symbol.
            self.counts = np.maximum(counts - total / slots, 0.0)
            self.total = float(total.mean()) + 0.5 * slots

    def _useful(self, rest: str) -> list[tuple[float, float, Callable[[str], list[str]]]]:
        """For fields with these marks: the bits of a dialect, its bits an item, and its parser.

        One for each dialect that no smaller one equals on them.
        """
        here = frozenset(rest) & self.marks
        useful = self.by_marks.get(here)
        if useful is None:
            least: dict[Dialect, _Parser] = {}
            for parser in self.parsers:
                d = parser.dialect
                least.setdefault(Dialect("".join(sorted(here & set(d.delimiters))), "".join(sorted(here & set(d.quotes)))), parser)
            useful = self.by_marks[here] = [
                (float(len(p.dialect.quotes)), float(np.log2(len(p.dialect.delimiters) + 1)), p.on(here)) for p in least.values()
            ]
        if len(self.useful) >= _MEMO:
            self.useful.clear()
        self.useful[rest] = useful
        return useful

    def parses(self, fields: list[str]) -> tuple[list[list[str]], Parses]:
        """The parses of different fields as lists, and all about them."""
        lists, owner, fixed, useful = [], [], [], self.useful
        for i, field in enumerate(fields):
            rest = field.translate(_PLAIN)
            for bits, per_item, parse in useful.get(rest) or self._useful(rest):
                lists.append(found := parse(field))
                owner.append(i)
                fixed.append(bits + per_item * len(found))
        items = pa.array([item for found in lists for item in found], pa.string()).dictionary_encode()
        symbols, first, second = self.symbols(items.dictionary)
        return lists, Parses(
            np.array(owner, dtype=np.int64), np.array([len(x) for x in lists], dtype=np.int64), np.array(fixed), items.indices.to_numpy(),
            first, second, np.array([xxhash.xxh3_64_intdigest(x) for x in symbols.cast(pa.binary()).to_pylist()], dtype=np.uint64), _spelling_bits(symbols),
        )

    def symbols(self, items: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """What is coded: the whole item, or its id and its value after ``=``."""
        if not self.valued:
            return items, np.arange(len(items)), np.full(len(items), -1)
        at = pc.find_substring(items, "=").to_numpy(zero_copy_only=False)
        has = pa.array(at >= 0)
        name = pc.utf8_rtrim(pc.replace_substring_regex(items, "(?s)=.*$", ""), WHITE)
        value = pc.replace_substring_regex(items.filter(has), "(?s)^[^=]*=", "=")
        names = pc.if_else(has, name, items)
        coded = pa.concat_arrays([names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names, value]).dictionary_encode()
        ids = coded.indices.to_numpy()
        second = np.full(len(items), -1)
        second[at >= 0] = ids[len(items) :]
        return coded.dictionary, ids[: len(items)], second

    def places(self, k: int, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(16 * k)) % np.uint64(self.slots)).astype(np.int64)

    def cheapest(self, found: Parses) -> np.ndarray:
        """The parse of least cost of each field; of equal ones the first."""
        n = np.min([self.counts[k, self.places(k, found.hashes)] for k in range(HASHES)], axis=0)
        often = np.maximum(n, 2.0)
        bits = np.where(n >= 2.0, np.minimum(found.spelled + 2.0, np.log2(self.total / often) + found.spelled / often), found.spelled + 2.0)
        item_bits = (bits[found.first] + np.where(found.second >= 0, bits[found.second], 0.0)) if len(bits) else bits
        upto, ends = np.concatenate(([0.0], np.cumsum(item_bits[found.ids]))), np.cumsum(found.sizes)
        cost = found.fixed + upto[ends] - upto[ends - found.sizes]
        starts = np.flatnonzero(np.diff(found.owner, prepend=-1))
        least = np.repeat(np.minimum.reduceat(cost, starts), np.diff(np.append(starts, len(cost))))
        best = np.flatnonzero(cost <= least + 1e-6)
        return best[np.flatnonzero(np.diff(found.owner[best], prepend=-1))]

    def count(self, found: Parses, use: np.ndarray | None, into: np.ndarray) -> None:
        """Add to ``into`` in how many fields each symbol occurs, under all parses or those of ``use``."""
        if not len(found.hashes):
            return
        parse, n = np.repeat(np.arange(len(found.sizes)), found.sizes), len(found.hashes)
        ids, field = found.ids, found.owner[parse]
        if use is not None:
            chosen = np.zeros(len(found.sizes), dtype=bool)
            chosen[use] = True
            ids, field = ids[chosen[parse]], field[chosen[parse]]
        symbol, field = np.concatenate((found.first[ids], found.second[ids])).astype(np.int64), np.concatenate((field, field)).astype(np.int64)
        key = np.unique(field[symbol >= 0] * n + symbol[symbol >= 0])
        times = np.bincount(key % n, minlength=n)
        for k in range(HASHES):
            into[k] += np.bincount(self.places(k, found.hashes), times, self.slots).astype(np.int64)


def _parse_fields(packings: list[Packing]):
    """Per batch and column: its fields' parses as they are needed to count and to choose, a binary value each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpackers = [Unpacker(p) for p in packings]
        for batch in batches:
            column = batch.column(0).to_numpy(zero_copy_only=False)
            for c, u in enumerate(unpackers):
                found = u.parses(batch.column(1).filter(pa.array(column == c)).to_pylist())[1]
                values = [pa.array([v.astype(t).tobytes()], pa.binary()) for v, t in zip(found, _STORED)]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), *values], names=["c", *Parses._fields])

    return run


def _count_symbols(packings: list[Packing], counts: np.ndarray | None, slots: int):
    """Per task: in how many of its fields each hashed symbol occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpackers = [Unpacker(p, None if counts is None else counts[c], slots) for c, p in enumerate(packings)]
        flat = np.zeros((len(packings), HASHES, slots), dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                c = batch.column(0)[row].as_py()
                found = Parses(*(np.frombuffer(batch.column(i + 1)[row].as_buffer(), dtype=t) for i, t in enumerate(_STORED)))
                if len(found.sizes):
                    unpackers[c].count(found, None if counts is None else unpackers[c].cheapest(found), flat[c])
        flat = flat.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["slot", "n"])

    return run


def _parse_rows(names: list[str], packings: list[Packing], counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpackers = [Unpacker(p, counts[c], counts.shape[2]) for c, p in enumerate(packings)]
        for batch in batches:
            parts = []
            for c, u in enumerate(unpackers):
                fields = batch.column(c + 1)
                fields = fields.filter(keep := pc.not_equal(pc.fill_null(fields, ""), "")).dictionary_encode()
                lists, found = u.parses(fields.dictionary.to_pylist())
                if not lists:
                    continue
                chosen = pa.array([lists[i] for i in u.cheapest(found)], pa.list_(pa.string())).take(fields.indices)
                sizes = pc.list_value_length(chosen).to_numpy(zero_copy_only=False)
                keys = batch.column(0).filter(keep).take(pc.list_parent_indices(chosen))
                position = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
                parts.append(pa.RecordBatch.from_arrays(
                    [keys, pa.DictionaryArray.from_arrays(np.full(len(position), c, dtype=np.int8), names).cast(pa.string()),
                     pa.array(position, pa.int32()), pc.list_flatten(chosen)],
                    names=["k", "column_name", "item_pos", "item"],
                ))
            yield from parts

    return run


def unpack(rows: DataFrame, key: str, packings: dict[str, Packing], slots: int = 1 << 16, rounds: int = 3) -> DataFrame:
    """``key, column_name, item_pos, item``: one row per packed value of the columns ``packings`` names.

    The different fields are gathered and parsed once, under all dialects that matter; what counts and
    choices need of the parses (numbers, hashes and lengths) is written to the checkpoint folder, and each round counts
    hashed symbols over all of it. Only those counts reach the driver and go back to the tasks: at most
    ``4 * slots`` numbers a column, whatever the data. A rare symbol costs its letters, so
    collisions among rare symbols don't matter.

    Positions count from 1 over real items; null, blank and ``.`` fields have none. Equal
    costs go to the dialect listed first. Rows with a null or repeated key are unpacked like
    others; an empty table gives no rows; extra columns are ignored.
    """
    names, chosen = list(packings), list(packings.values())
    fields = rows.select(
        F.col(key).alias("k"), *[F.btrim(F.col(f"`{n}`"), F.lit(WHITE)).alias(f"f{c}") for c, n in enumerate(names)]
    )
    different = reduce(
        DataFrame.unionByName,
        [fields.select(F.lit(c).alias("c"), F.col(f"f{c}").alias("field")) for c in range(len(names))],
    ).where("field is not null and field not in ('', '.')").distinct()
    stored = ", ".join(f"{f} binary" for f in Parses._fields)
    parsed = cut_lineage(different.mapInArrow(_parse_fields(chosen), f"c int, {stored}"))
    counts: np.ndarray | None = None
    for _ in range(rounds):
        parts = parsed.mapInArrow(_count_symbols(chosen, counts, slots), "slot int, n long")
        summed = parts.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
        flat = np.zeros(len(names) * HASHES * slots, dtype=np.float32)
        flat[summed.column("slot").to_numpy()] = summed.column("n").to_numpy()
        counts = flat.reshape(len(names), HASHES, slots)
    kind = fields.schema["k"].dataType.simpleString()
    found = fields.mapInArrow(
        _parse_rows(names, chosen, counts), f"k {kind}, column_name string, item_pos int, item string"
    )
    return found.withColumnRenamed("k", key)
