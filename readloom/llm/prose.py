"""Pages of repeated keywords, link lists and product tags, found by their perplexity.

A page is read as a sequence of symbols: function words stand for themselves, all other
tokens for a class (how widespread the word is and how it is written, the shape of what is no
word, the number of digits, the mark). An n-gram model over these symbols is trained on the
pages that papers print, and every page is scored by it: the median over its characters of
the surprisal of the symbols around them tells how unlike print more than half of the page
is. Links, tags and repeats have no symbols of their own: they only keep pages out of training.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.session import cut_lineage

# What a token is; the rest of its code is a hash, a number of digits or the number of a mark.
LOWER, CAPITAL, CAPITALS, NUMBER, MARK, SHAPE, OTHER_SCRIPT = range(1, 8)
_HASH_BITS = 28
_MASK = (1 << _HASH_BITS) - 1
# Marks that are symbols of their own.
MARKS = ".,;:!?-—()[]\"'/|#&%£$*·•»«=_@<>+"
_BREAK = re.compile(r"[-=¬­]\s*\n\s*")
# From letter or digit to letter or digit without a blank, or one mark. Longer ones come in pieces.
_TOKENS = re.compile(r"[^\W_](?:\S{0,198}[^\W_])?|\S").findall
_RUNS = re.compile(r"[^\W\d_]+|\d+")
_AGAIN = re.compile(r"(..?)\1+")
_WORD_SHAPES = frozenset(("a", "a'a", "a’a"))
# Runs of 3 to 30 letters and digits; longer ones are no words.
_READABLE = re.compile(r"(?<![^\W_])[^\W_]{3,30}(?![^\W_])").findall
# Which tokens keep a page out of training.
_LINK = re.compile(r"://|^www\b|\bwww\.|href=|\]\(|[a-z0-9]{2}\.[a-z]{4,}(?:[/)\]>?]|$)", re.I).search
_TAG = re.compile(r"^\w{2,}[:=_]\w").search
_SEPARATORS = frozenset("|/>»·•→<\\")


class Settings(NamedTuple):
    """Parameters; shares and counts are relative, so that a page scores alike in a larger corpus.

    The ``function_words`` most frequent words of at least ``function_pages`` of the training
    pages are symbols, like the ``shapes`` most widespread shapes of at least ``shape_pages``. Other words fall
    into bands by their share of pages; at most ``most_words`` reach the lowest band but one.
    Training pages have a share of at most ``marks`` of links, tags, separators within
    ``close`` and words that stand three times within ``span``, and are legible: a share of
    ``legible`` of their characters stands in runs of 3 to 30 letters or digits. A context
    seen in a share of ``pair`` (one symbol) or ``triple`` (two) of all places has half of the weight.
    Surprisal is averaged over ``window`` symbols to either side. Pages are odd beyond ``high``
    deviations above or ``low`` below the median.
    """

    function_words: int = 160
    function_pages: float = 0.01
    shapes: int = 40
    shape_pages: float = 0.005
    bands: tuple[float, ...] = (0.05, 0.01, 0.0015)
    most_words: int = 100_000
    span: int = 12
    close: int = 4
    marks: float = 0.05
    legible: float = 0.45
    pair: float = 2e-3
    triple: float = 4e-4
    window: int = 10
    high: float = 5.5
    low: float = 5.5


def word_hash(word: str) -> int:
    """28 bits that are the same in every process."""
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) & _MASK


def shape_of(token: str) -> str:
    """Letters as ``a``, digits as ``0``, marks as they are; repetitions once, six characters at most."""
    return _AGAIN.sub(r"\1", _RUNS.sub(lambda m: "0" if m[0][0].isdecimal() else "a", token))[:6]


class _Tokens(dict):
    """Numbers of tokens as written, with what is known of each; starts anew when full."""

    def __init__(self) -> None:
        super().__init__()
        self.start()

    def start(self) -> None:
        self.clear()
        self.code: list[int] = []
        self.size: list[int] = []
        self.stem: list[int] = []
        self.kind: list[int] = []

    def __missing__(self, token: str) -> int:
        number = self[token] = len(self.code)
        shape = "" if len(token) == 1 and not token.isalnum() else shape_of(token)
        stem = 0
        if not shape:
            kind, told = MARK, MARKS.find(token) + 1
        elif shape == "0":
            kind, told = NUMBER, min(len(token), 4) - 1
        elif shape in _WORD_SHAPES:
            low = token.lower()
            kind = CAPITALS if len(token) > 1 and token.isupper() else CAPITAL if token[0].isupper() else LOWER
            kind, told = (OTHER_SCRIPT, 0) if token[0] > "ɏ" else (kind, word_hash(low))
            # Repeats are of content words; a plural is the same word.
            stem = word_hash(low.rstrip("s")) if len(token) > 3 and kind != CAPITALS else 0
        else:
            kind, told = SHAPE, word_hash(shape)
        self.code.append(kind << _HASH_BITS | told)
        self.size.append(len(token))
        self.stem.append(stem)
        letters = len(token) > 3 or token.lower() == "www"
        self.kind.append(1 if token == "#" or letters and (_LINK(token) or _TAG(token)) else 2 if token in _SEPARATORS else 0)
        return number


def _marked(stem: np.ndarray, kind: np.ndarray, page: np.ndarray, s: Settings) -> np.ndarray:
    """Links, tags, separators of lists, and one of three equal content words."""
    n = len(stem)
    back, ahead = np.zeros(n, dtype=np.int16), np.zeros(n, dtype=np.int16)
    last, next_ = np.full(n, 99, dtype=np.int16), np.full(n, 99, dtype=np.int16)
    out, separates = kind == 1, kind == 2
    for d in range(min(s.span, n - 1), 0, -1):
        here = page[d:] == page[:-d]
        alike = (stem[d:] == stem[:-d]) & (stem[d:] != 0) & here
        back[d:] += alike
        ahead[:-d] += alike
        last[d:][alike] = d
        next_[:-d][alike] = d
        if d <= s.close:
            both = separates[d:] & separates[:-d] & here
            out[d:] |= both
            out[:-d] |= both
    return out | (back >= 2) | (ahead >= 2) | (last + next_ <= s.span)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``most`` bytes of text, each of one row at least."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // most
        cuts = [*np.flatnonzero(np.diff(part, prepend=-1)), len(part)]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def _encode(s: Settings):
    """Per page its codes (4 bytes a token) and sizes (1 byte), and whether it is legible and to be trained on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens()
        look = tokens.__getitem__
        for batch in slices(batches, 1):
            if len(tokens) > 500_000:
                tokens.start()
            numbers: list[int] = []
            lengths, legible = [], []
            for text in batch.column(1).to_pylist():
                before, share = len(numbers), 1.0
                if text:
                    plain = " ".join((_BREAK.sub("", text) if "\n" in text else text).split())
                    numbers += map(look, _TOKENS(plain))
                    share = sum(map(len, _READABLE(plain))) / max(len(plain) - plain.count(" "), 1)
                lengths.append(len(numbers) - before)
                legible.append(share)
            at, page = np.array(numbers, dtype=np.int64), np.repeat(np.arange(len(lengths)), lengths)
            marked = _marked(*(np.array(v, dtype=np.int64)[at] for v in (tokens.stem, tokens.kind)), page, s)
            count = np.array(lengths)
            share = np.bincount(page[marked], minlength=len(count)) / np.maximum(count, 1)
            legible = np.array(legible) >= s.legible
            ends = np.concatenate(([0], np.cumsum(count)))
            codes, sizes = np.array(tokens.code, dtype="<u4")[at], np.array(tokens.size, dtype=np.uint8)[at]
            binary = lambda v, width: pa.Array.from_buffers(
                pa.large_binary(), len(count), [None, pa.py_buffer(ends * width), pa.py_buffer(v.tobytes())]
            ).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), binary(codes, 4), binary(sizes, 1), pa.array(legible), pa.array(legible & (share <= s.marks) & (count > 0))],
                names=["k", "codes", "sizes", "legible", "prose"],
            )

    return run


def _arrays(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column one after another, and each one's number."""
    parts = column.to_pylist()
    values = np.frombuffer(b"".join(parts), dtype=dtype)
    width = np.dtype(dtype).itemsize
    return values, np.array([len(p) // width for p in parts], dtype=np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many pages, and how often, each word and each shape occurs; key -1 counts pages."""
    for batch in slices(batches, 0, 4_000_000):
        codes, lengths = _arrays(batch.column(0), "<u4")
        kind, page = codes >> _HASH_BITS, np.repeat(np.arange(len(lengths)), lengths)
        use = (kind <= CAPITALS) | (kind == SHAPE)
        key = np.where(kind[use] == SHAPE, 1 << _HASH_BITS, 0) + (codes[use] & _MASK).astype(np.int64)
        once, times = np.unique(page[use] << 30 | key, return_counts=True)
        word, at = np.unique(once & (1 << 30) - 1, return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(word, -1), pa.int64()), pa.array(np.append(np.bincount(at, minlength=len(word)), len(lengths)), pa.int64()),
                pa.array(np.append(np.bincount(at, times, len(word)), 0).astype(np.int64)),
            ],
            names=["word", "pages", "n"],
        )


class Lexicon:
    """Symbols of codes: 0 begins a page; function words, shapes, marks, numbers and classes of words follow."""

    def __init__(self, words: np.ndarray, pages: np.ndarray, n: np.ndarray, total: int, s: Settings):
        order = np.lexsort((words, -n))
        shape = words >> _HASH_BITS == 1
        functions = [i for i in order if not shape[i] and pages[i] >= s.function_pages * total][: s.function_words]
        widespread = np.lexsort((words, -pages))
        shapes = [i for i in widespread if shape[i] and pages[i] >= s.shape_pages * total][: s.shapes]
        self.n_functions = len(functions)
        self.shape_hash = np.sort(words[shapes] & _MASK)
        plain = np.flatnonzero(~shape)
        plain = plain[np.argsort(words[plain])]
        self.word_hash = words[plain]
        self.band = (pages[plain, None] < np.array(s.bands) * total).sum(axis=1)
        place = np.zeros(len(words), dtype=np.int64)
        place[functions] = np.arange(1, len(functions) + 1)
        self.function = place[plain]
        self.bands = len(s.bands) + 1
        self.shapes_from = 1 + self.n_functions
        self.marks_from = self.shapes_from + len(self.shape_hash) + 2
        self.numbers_from = self.marks_from + len(MARKS) + 1
        self.words_from = self.numbers_from + 5
        self.size = self.words_from + 3 * self.bands

    @staticmethod
    def _find(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(known):
            return np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=bool)
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        return at, known[at] == values

    def symbols(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        kind, told = codes >> _HASH_BITS, (codes & _MASK).astype(np.int64)
        out = np.full(len(codes), self.numbers_from + 4, dtype=np.int64)
        out[kind == NUMBER] = self.numbers_from + told[kind == NUMBER]
        out[kind == MARK] = self.marks_from + told[kind == MARK]
        of = np.flatnonzero(kind == SHAPE)
        at, known = self._find(self.shape_hash, told[of])
        # Shapes that few pages have are short or long.
        out[of] = np.where(known, self.shapes_from + 2 + at, self.shapes_from + (sizes[of] >= 8))
        of = np.flatnonzero(kind <= CAPITALS)
        at, known = self._find(self.word_hash, told[of])
        band, function = np.full(len(of), self.bands - 1), np.zeros(len(of), dtype=np.int64)
        if len(self.word_hash):
            band, function = np.where(known, self.band[at], band), np.where(known, self.function[at], 0)
        classes = self.words_from + band * 3 + kind[of].astype(np.int64) - LOWER
        out[of] = np.where((function > 0) & (kind[of] != CAPITALS), function, classes)
        return out


def _sequence(batch: pa.RecordBatch, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, their sizes and their pages; each page begins with two zeros."""
    codes, lengths = _arrays(batch.column("codes"), "<u4")
    sizes, _ = _arrays(batch.column("sizes"), "u1")
    page = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(codes)) + 2 * (page + 1)
    symbol, size = np.zeros((2, len(codes) + 2 * len(lengths)), dtype=np.int64)
    symbol[at], size[at] = lexicon.symbols(codes, sizes), sizes
    return symbol, size, np.repeat(np.arange(len(lengths)), lengths + 2)


def _contexts(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one = np.concatenate(([0], symbol[:-1]))
    return one, np.concatenate(([0], one[:-1]))


def _count_triples(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in slices(batches, 0, 4_000_000):
            symbol, _, _ = _sequence(batch, lexicon)
            one, two = _contexts(symbol)
            new, n = np.unique(((two * lexicon.size + one) * lexicon.size + symbol)[symbol > 0], return_counts=True)
            keys, at = np.unique(np.concatenate((keys, new)), return_inverse=True)
            counts = np.bincount(at, np.concatenate((counts, n)), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["triple", "n"])

    return run


class Model:
    """Interpolated one-, two- and three-symbol model; all counts are exact.

    A context's own counts weigh ``share / (share + pair)`` (or ``triple``), its share being
    that of all places. What is rarer than that in print is judged by the shorter
    context, however large the corpus. No symbol costs more than ``log2(size / 0.05)`` bits
    and what the discounts of the longer contexts add.
    """

    def __init__(self, size: int, triples: np.ndarray, counts: np.ndarray, pair: float, triple: float):
        order = np.argsort(triples)
        self.size, self.triples, n = size, triples[order], counts[order].astype(np.float64)
        total = max(n.sum(), 1.0)
        two = np.bincount(self.triples % size**2, n, size**2)
        one, before = np.bincount(self.triples % size, n, size), two.reshape(size, size).sum(axis=1)
        seen = np.bincount(self.triples // size, n, size**2)
        trust = 0.9 * (before / (before + pair * total))[:, None]
        base = 0.95 * one / total + 0.05 / size
        self.shorter = (trust * two.reshape(size, size) / np.maximum(before, 1.0)[:, None] + (1 - trust) * base).ravel()
        self.trust = 0.8 * seen / (seen + triple * total)
        self.own = (self.trust[self.triples // size] * n / np.maximum(seen[self.triples // size], 1.0)).astype(np.float32)

    def surprisal(self, symbol: np.ndarray) -> np.ndarray:
        """Bits of each symbol after the two before it; 0 where a page begins."""
        one, two = _contexts(symbol)
        context = two * self.size + one
        at, known = Lexicon._find(self.triples, context * self.size + symbol)
        own = np.where(known, self.own[at], 0.0) if len(self.own) else 0.0
        bits = -np.log2(own + (1 - self.trust[context]) * self.shorter[one * self.size + symbol])
        return np.where(symbol > 0, bits, 0.0)


def page_medians(bits: np.ndarray, symbol: np.ndarray, size: np.ndarray, page: np.ndarray, n: int, window: int) -> np.ndarray:
    """Per page the median over characters of the mean surprisal of the symbols around; NaN without symbols."""
    told = symbol > 0
    run = lambda v: np.concatenate(([0.0], np.cumsum(v)))
    starts, ends = (np.searchsorted(page, np.arange(n), side) for side in ("left", "right"))
    here = np.arange(len(bits))
    low, high = np.maximum(here - window, starts[page]), np.minimum(here + window + 1, ends[page])
    total, count = run(bits), run(told)
    mean = ((total[high] - total[low]) / np.maximum(count[high] - count[low], 1.0))[told]
    page, size = page[told], size[told].astype(float)
    order = np.lexsort((mean, page))
    mean, upto = mean[order], np.cumsum(size[order])
    first, last = (np.searchsorted(page, np.arange(n), side) for side in ("left", "right"))
    base, whole = np.concatenate(([0.0], upto))[first], np.concatenate(([0.0], upto))[last]
    middle = np.searchsorted(upto, (base + whole) / 2, "left")
    out, full = np.full(n, np.nan), last > first
    out[full] = mean[np.minimum(middle[full], last[full] - 1)]
    return out


def _score(shared, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, model = shared.value
        for batch in slices(batches, 1, 4_000_000):
            symbol, size, page = _sequence(batch, lexicon)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k"), pa.array(np.bincount(page[symbol > 0], minlength=n), pa.int64()),
                    pa.array(page_medians(model.surprisal(symbol), symbol, size, page, n, s.window), pa.float64()),
                    batch.column("prose"), batch.column("legible"),
                ],
                names=["k", "n_tokens", "bits", "prose", "legible"],
            )

    return run


def score_pages(df: DataFrame, key: str, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``key, n_tokens, bits, prose, legible, odd``: each page with its median surprisal and verdict.

    Texts are read once: codes of 4 bytes and sizes of 1 byte a token are written to the
    checkpoint folder. Over them run the counts of words and shapes, of triples of symbols, and the scores.
    The driver gets at most ``most_words`` words and the triples that occur, of some 270 symbols (at
    most their cube, however much text). ``odd`` pages lie more than ``high`` deviations above
    or ``low`` below the median of the training pages (``prose``) and are legible. A deviation is 1.4826 times
    the median absolute one.

    Null, empty and blank pages have no tokens, null bits and are not odd; repeated keys are
    judged each; an empty table gives no rows. Whole texts are read.
    """
    s = settings
    kind = df.schema[key].dataType.simpleString()
    pages = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    coded = cut_lineage(pages.mapInArrow(_encode(s), f"k {kind}, codes binary, sizes binary, legible boolean, prose boolean"))
    training = coded.where("prose").select("codes", "sizes")
    words = training.select("codes").mapInArrow(_count_words, "word long, pages long, n long").groupBy("word").agg(
        F.sum("pages").alias("pages"), F.sum("n").alias("n")
    )
    # A page has few different words: at most (words a page) / x of them are on a share x of the pages.
    common = words.orderBy(F.col("word") != -1, F.col("pages").desc(), "word").limit(s.most_words + 1).toArrow()
    word, n_pages, n = (common.column(c).to_numpy() for c in ("word", "pages", "n"))
    total = int(n_pages[word == -1].sum())
    use = (word >= 0) & (n_pages >= max(min(s.bands) * total, 2.0))
    lexicon = Lexicon(word[use], n_pages[use], n[use], total, s)
    triples = training.mapInArrow(_count_triples(lexicon), "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n")).toArrow()
    model = Model(lexicon.size, triples.column("triple").to_numpy(), triples.column("n").to_numpy(), s.pair, s.triple)
    shared = df.sparkSession.sparkContext.broadcast((lexicon, model))
    scored = cut_lineage(
        coded.mapInArrow(_score(shared, s), f"k {kind}, n_tokens long, bits double, prose boolean, legible boolean")
        .withColumn("bits", F.nanvl("bits", F.lit(None).cast("double")))
    )
    known = scored.where("prose and bits is not null")
    middle = known.agg(F.percentile_approx("bits", 0.5, 10000)).first()[0]
    odd = F.lit(False)
    if middle is not None:
        away = known.agg(F.percentile_approx(F.abs(F.col("bits") - F.lit(middle)), 0.5, 10000)).first()[0]
        spread = max(1.4826 * away, 1e-6)
        odd = (F.col("bits") > middle + s.high * spread) | (F.col("bits") < middle - s.low * spread)
    return scored.withColumn("odd", F.coalesce(odd & F.col("legible"), F.lit(False))).withColumnRenamed("k", key)
