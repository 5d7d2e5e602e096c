"""Encoding with a public byte-level BPE vocabulary by a tokenization automaton.

The automaton's arcs are labelled with tokens; a sequence of tokens is a path exactly if it
is the BPE encoding of its bytes. It starts as one state with a loop for each byte. Each
merge (u, v) adds an arc uv beside every path u, v and lets u lead to a copy of its target
that lacks the arc v. All arcs with one label lead to one state, so that a state is stored
as (older state, merge number, missing label) and a token as (merge number, left part,
target), which together decide for any state and label whether the arc exists.

A pre-split word is encoded by walking from the start along existing arcs whose labels spell
its bytes, longest first; as only one path spells it, a place that led nowhere is never
visited again. Decoding writes down the labels.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

#: Where the vocabulary files of public tokenizers lie.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
# Fixed value: how byte-level BPE splits text into words (see the vocabulary's documentation).
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?{L}+| ?{N}+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"


def read_ranks(name: str = "byte_bpe_50k", folder: str = TOKENIZERS, most: int = 1 << 20) -> dict[bytes, int]:
    """Tokens and their ids from ``folder/name.tiktoken``; more than ``most`` is an error."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if len(ranks) > most:
        raise ValueError(f"{name} has more than {most} tokens")
    return ranks


def _merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that the merges before it make of a token."""
    parts = [token[i : i + 1] for i in range(len(token))]
    bound = ranks[token]
    while len(parts) > 2:
        found = [(ranks.get(a + b, bound), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(found)
        if rank >= bound:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


class Automaton:
    """The tokenization automaton of a vocabulary, and encoding and decoding with it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.labels = {rank: token for token, rank in ranks.items()}
        size = max(self.labels, default=-1) + 1
        # Tokens: merge number (bytes: -1), left part and target state; target -1: on no path.
        self.born = np.full(size, -1, dtype=np.int32)
        self.left = np.full(size, -1, dtype=np.int32)
        self.target = np.full(size, -1, dtype=np.int32)
        # States: the state each is a copy of, the merge that made it, the label it lost.
        older, made, lost = [-1], [-1], [-1]
        self.born_l, self.left_l, self.target_l = self.born.tolist(), self.left.tolist(), self.target.tolist()
        self.older, self.made, self.lost = older, made, lost
        self.arcs: dict[int, bool] = {}
        for rank in sorted(self.labels):
            token = self.labels[rank]
            if len(token) == 1:
                self.target_l[rank] = 0
        number = 0
        for rank in sorted(self.labels):
            token = self.labels[rank]
            pair = _merge_of(token, ranks) if len(token) > 1 else None
            if pair is None:
                continue
            u, v = ranks[pair[0]], ranks[pair[1]]
            p, r = self.target_l[u], self.target_l[v]
            if p < 0 or r < 0 or not self._arc(p, v):
                continue
            self.born_l[rank], self.left_l[rank], self.target_l[rank] = number, u, r
            older.append(p)
            made.append(number)
            lost.append(v)
            self.target_l[u] = len(older) - 1
            number += 1
        self._finish(ranks)

    def _finish(self, ranks: dict[bytes, int]) -> None:
        self.arcs = {}
        # A trie of the labels; node * 256 + byte leads on, ends has the token of a node.
        self.next: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for token, rank in ranks.items():
            if self.target_l[rank] < 0:
                continue
            node = 0
            for byte in token:
                at = node * 256 + byte
                node = self.next.get(at, -1)
                if node < 0:
                    node = self.next[at] = len(self.ends)
                    self.ends.append(-1)
            self.ends[node] = rank

    def _arc(self, state: int, token: int) -> bool:
        """Whether an arc labelled ``token`` leaves ``state``."""
        born, left, older, made, lost = self.born_l, self.left_l, self.older, self.made, self.lost
        while state:
            if born[token] >= made[state]:
                token = left[token]
            elif token == lost[state]:
                return False
            else:
                state = older[state]
        return True

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The ids along the only path that spells ``word``."""
        step, ends, target, arcs, n = self.next, self.ends, self.target_l, self.arcs, len(word)
        path: list[tuple[int, list[tuple[int, int]]]] = []
        ids: list[int] = []
        dead = bytearray(n + 1)
        at = state = 0
        while at < n:
            node, choices = 0, []
            for i in range(at, n):
                node = step.get(node * 256 + word[i], -1)
                if node < 0:
                    break
                if ends[node] >= 0 and not dead[i + 1]:
                    choices.append((ends[node], i + 1))
            while True:
                while choices:
                    token, end = choices.pop()
                    if dead[end]:
                        continue
                    key = state << 24 | token
                    there = arcs.get(key)
                    if there is None:
                        if len(arcs) > 1_000_000:
                            arcs.clear()
                        there = arcs[key] = self._arc(state, token)
                    if there:
                        break
                else:
                    # Nothing leads on from here: take back the last arc.
                    dead[at] = 1
                    if not path:
                        raise ValueError("the vocabulary can't spell this text")
                    at, state, choices = path.pop()
                    ids.pop()
                    continue
                break
            path.append((at, state, choices))
            ids.append(token)
            at, state = end, target[token]
        return tuple(ids)

    def decode(self, ids: list[int]) -> bytes:
        labels = self.labels
        return b"".join(labels[i] for i in ids)


def _classes(top: int) -> tuple[str, str]:
    """Regular expression ranges of the letters and the numbers below ``top``."""
    out = []
    for kind in "LN":
        inside = [unicodedata.category(chr(c))[0] == kind for c in range(top)]
        edges = [c for c in range(top) if inside[c] != (c > 0 and inside[c - 1])] + [top] * inside[-1]
        out.append("".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in zip(edges[::2], edges[1::2])))
    return out[0], out[1]


@lru_cache(maxsize=1)
def _splitters():
    """Splitting texts of the basic plane, and any: the same words, one faster."""
    import regex

    letters, numbers = _classes(0x10000)
    fast = WORDS.replace(r"[^\s{L}{N}]", rf"[^\s{letters}{numbers}]").replace("{L}", f"[{letters}]").replace("{N}", f"[{numbers}]")
    full = WORDS.replace(r"[^\s{L}{N}]", r"[^\s\p{L}\p{N}]").replace("{L}", r"\p{L}").replace("{N}", r"\p{N}")
    return re.compile(fast).findall, regex.compile(full).findall


class Words(dict):
    """Ids of words, encoded when first met; forgets all when it holds too many."""

    def __init__(self, automaton: Automaton, most: int = 300_000, longest: int = 200):
        super().__init__()
        self.automaton, self.most, self.longest = automaton, most, longest

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.automaton.encode_word(word.encode("utf-8", "surrogatepass"))
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids


def split_words(text: str) -> list[str]:
    fast, full = _splitters()
    return fast(text) if text.isascii() or max(text) < "\U00010000" else full(text)


@lru_cache(maxsize=2)
def _automaton(name: str, folder: str) -> Automaton:
    return Automaton(read_ranks(name, folder))


def _shared(df: DataFrame, name: str, folder: str):
    """The compiled automaton for all tasks; its size is bounded by the vocabulary's."""
    return df.sparkSession.sparkContext.broadcast(_automaton(name, folder))


def _encode(shared, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Words(shared.value).__getitem__
        for batch in batches:
            told, lengths = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                parts = list(map(ids_of, split_words(text))) if text else ()
                n = sum(map(len, parts))
                lengths.append(n)
                if not counted:
                    told.append(np.fromiter(chain.from_iterable(parts), np.int32, n))
            if counted:
                out = pa.array(lengths, pa.int64())
            else:
                offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
                np.cumsum(lengths, out=offsets[1:])
                flat = np.concatenate(told) if told else np.zeros(0, np.int32)
                if offsets[-1] < 2**31:
                    out = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                else:
                    out = pa.array([list(t) for t in told], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], out], names=[*batch.schema.names[:-1], "n_tokens" if counted else "ids"]
            )

    return run


def encode(df: DataFrame, text: Column, keep: dict[str, Column], name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The columns ``keep`` and ``ids``: the token ids of ``text``, without special tokens.

    One row per row, duplicates included; null and empty texts have the empty list. Strings
    that look like special tokens are ordinary text; texts of any length are encoded whole.
    Nothing is shuffled; the vocabulary of at most 2**20 tokens is broadcast.
    """
    return _run(df, text, keep, name, folder, False, "ids array<int>")


def count_tokens(df: DataFrame, text: Column, keep: dict[str, Column], name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``: how many ids ``encode`` gives, 0 for null texts."""
    return _run(df, text, keep, name, folder, True, "n_tokens long")


def _run(df, text, keep, name, folder, counted, out) -> DataFrame:
    rows = df.select(*[c.alias(n) for n, c in keep.items()], text.cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), out])
    return rows.mapInArrow(_encode(_shared(df, name, folder), counted), schema)


def decode(df: DataFrame, ids: Column, keep: dict[str, Column], name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The columns ``keep`` and ``text``, spelled by the labels of ``ids``; null lists have null texts.

    Bytes that are no UTF-8 (lists that were cut) come out as replacement characters.
    """
    rows = df.select(*[c.alias(n) for n, c in keep.items()], ids.alias("__ids"))
    shared = _shared(df, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = shared.value.decode
        for batch in batches:
            texts = [None if i is None else spell(i).decode("utf-8", "replace") for i in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "text string"])
    return rows.mapInArrow(run, schema)



