"""Tokens against the public libraries, mixes against their constraints, pages against their kind."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("readloom.llm")
from readloom.llm import mixing, prose, tokenizer  # noqa: E402

needs_files = pytest.mark.skipif(not os.path.exists(f"{tokenizer.TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")
TINY = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"aa": 257, b"aab": 258, b"ba": 259, b"abab": 260, b"bab": 261, b"aaaa": 262}


def by_rank(word, ranks):
    """BPE by definition: the adjacent pair of lowest rank merges, leftmost first."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 30:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return tuple(ranks[p] for p in parts)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abc", max_size=40))
def test_automaton_is_bpe(word):
    automaton = tokenizer.Automaton(TINY)
    word = word.encode()
    ids = automaton.encode_word(word)
    assert automaton.decode(list(ids)) == word
    # Merging by the listed merges: the same as by rank where each token has one way to arise.
    merges = {t: tokenizer._merge_of(t, TINY) for t in TINY if len(t) > 1}
    parts = [word[i : i + 1] for i in range(len(word))]
    for token in sorted(merges, key=TINY.get):
        a, b = merges[token]
        i, out = 0, []
        while i < len(parts):
            if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                out.append(token)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    assert ids == tuple(TINY[p] for p in parts)


SAMPLES = [
    "", "Plain words, it's 25 o'clock.\n\n  Next", "<|endoftext|> is text", " " * 70 + "x", "naïve Straße ﬁ ½² ٥١", "😀 𝒜𝟙 中文" * 20,
    "a" * 3000, "ab" * 50_000, "don't I'LL he'll 've", "\r\n\t mixed   spaces ", "=" * 500, "é é",
]


@needs_files
@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_encoding_is_the_library_s(name):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = tokenizer.read_ranks(name)
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    words = tokenizer.Words(tokenizer._automaton(name, tokenizer.TOKENIZERS))
    draw = random.Random(11)
    letters = "aeiou etaoin shrdlu THE .,-'\n0123456789éüñß中😀_\t"
    for text in SAMPLES + ["".join(draw.choice(letters) for _ in range(draw.randint(1, 200))) for _ in range(500)]:
        ids = [i for w in tokenizer.split_words(text) for i in words[w]]
        assert ids == library.encode_ordinary(text)
        assert words.automaton.decode(ids).decode() == text


@needs_files
def test_encode_and_decode_frames(spark):
    rows = [(i, t, "x", [1]) for i, t in enumerate([*SAMPLES, None])] + [(0, "again", "y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __text string, ids array<int>")
    out = tokenizer.encode(df, F.col("text"), {"doc_id": F.col("doc_id")})
    assert out.count() == len(rows)
    got = {(r.doc_id, len(r.ids)): r.ids for r in out.collect()}
    assert got[len(SAMPLES), 0] == [] and got[0, 0] == []
    back = tokenizer.decode(out, F.col("ids"), {"doc_id": F.col("doc_id")})
    assert {(r.doc_id, r.text) for r in back.collect()} == {(i, t or "") for i, t, _, _ in rows}
    counts = tokenizer.count_tokens(df, F.col("text"), {"doc_id": F.col("doc_id")})
    assert sum(r.n_tokens for r in counts.collect()) == sum(n for _, n in got)
    assert tokenizer.encode(df.limit(0), F.col("text"), {"doc_id": F.col("doc_id")}).count() == 0


def test_unknown_bytes_are_an_error():
    with pytest.raises(ValueError):
        tokenizer.Automaton({b"a": 0}).encode_word(b"ab")


def test_mix_meets_targets(spark):
    draw = random.Random(2)
    docs, n = [], {"big": 4000, "mid": 700, "small": 60}
    for name, k in n.items():
        docs += [(f"{name}{i}", draw.choice([name, f" {name.upper()}\t"]), draw.choice([0, 40, 100, 300, 800])) for i in range(k)]
    docs += [("n", None, 50), ("o", "other", 50), ("t", "tiny", 10), ("z", "mid", None), ("mid1", "mid", 100)]
    df = spark.createDataFrame(docs, "doc_id string, source string, n_tokens long").withColumn("copies", F.lit("clash"))
    targets = {"big": (0.6, 1), "mid": (0.3, 4), "small": (0.04, 9), "tiny": (0.05, 3), "none": (0.01, 2)}
    copies, report = mixing.balance(df, targets)
    got = {r.source: r for r in report.collect()}
    total = sum(r.n_tokens for r in got.values())
    for name in ("big", "mid", "small"):
        r = got[name]
        assert r.reachable and r.goal_tokens == pytest.approx(targets[name][0] * total)
        assert r.expected_tokens == pytest.approx(r.goal_tokens, rel=1e-4) and r.mixed_tokens == pytest.approx(r.goal_tokens, rel=0.03)
    assert not got["tiny"].reachable and got["tiny"].mixed_tokens == 30
    assert not got["none"].reachable and got["none"].mixed_tokens == 0
    assert sum(r.actual_share for r in got.values()) == pytest.approx(1.0)
    rows = copies.collect()
    assert len(rows) == len(docs) - 2 and all(0 <= r.copies <= targets[r.source][1] for r in rows)
    assert all(r.copies == 0 for r in rows if not r.n_tokens)


def test_short_source_leaves_shares_of_others(spark):
    draw = random.Random(12)
    docs = [(f"{name}{i}", name, draw.choice([5, 40, 100, 300])) for name, k in (("a", 3000), ("b", 2000), ("short", 150)) for i in range(k)]
    df = spark.createDataFrame(docs, "doc_id string, source string, n_tokens long")
    targets = {"a": (0.5, 2), "b": (0.4, 2), "short": (0.1, 2)}
    got = {r.source: r for r in mixing.balance(df, targets)[1].collect()}
    assert [got[k].reachable for k in ("a", "b", "short")] == [True, True, False]
    for name in targets:
        assert got[name].actual_share == pytest.approx(targets[name][0], rel=0.02)
        assert got[name].mixed_tokens == pytest.approx(got[name].mix_goal, rel=0.02)
    sized = {r.source: r for r in mixing.balance(df, targets, keep="size")[1].collect()}
    assert sized["a"].mixed_tokens == pytest.approx(sized["a"].goal_tokens, rel=0.02) and sized["a"].actual_share > 0.51
    with pytest.raises(ValueError):
        mixing.balance(df, targets, keep="both")


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    copies, report = mixing.balance(empty, {"a": (1.0, 2)})
    assert copies.count() == 0 and [(r.n_tokens, r.mixed_tokens, r.actual_share) for r in report.collect()] == [(0, 0, 0.0)]
    copies, report = mixing.balance(spark.createDataFrame([(1, "a", 5)], "doc_id long, source string, n_tokens long"), {})
    assert copies.count() == 0 and report.count() == 0


def test_targets(spark):
    rows = [("A ", 0.2, 3), ("a", 0.1, 5), (None, 0.5, 1), ("b", None, 2), ("c", 0.3, 0)]
    assert mixing.read_targets(spark.createDataFrame(rows, "source string, target_share double, max_repeats int")) == {"a": (pytest.approx(0.3), 5)}
    with pytest.raises(ValueError):
        mixing.read_targets(spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 1)], "source string, target_share double, max_repeats int"), most=1)


PEOPLE, THINGS = ["miller", "baker", "vicar", "nurse", "farmer", "clerk"], ["bridge", "school", "market", "well", "road", "hall", "mill"]


def sentence(draw):
    return draw.choice([
        f"The {draw.choice(PEOPLE)} of {draw.choice('ABCD')}ton said that the {draw.choice(THINGS)} was to be opened on Monday.",
        f"A letter from the {draw.choice(PEOPLE)} on the state of the {draw.choice(THINGS)} was read to the meeting.",
        f"It was resolved that £{draw.randint(2, 90)} be spent on the {draw.choice(THINGS)}, and the {draw.choice(PEOPLE)} thanked all.",
        f"Whether the {draw.choice(THINGS)} ought to be moved is a question on which the {draw.choice(PEOPLE)} does not agree.",
    ])


def test_pages(spark):
    draw = random.Random(4)
    text = lambda n: "\n".join(sentence(draw) for _ in range(n))
    pages = [(i, text(12)) for i in range(300)]
    keywords = "cheap boots cheap boots! buy cheap boots online boots cheap boots best boots "
    links = "\n".join(f"http://shop{i}.example/boots?q={i}" for i in range(30))
    tags = "\n".join(f"type:boots, size:{i} cat=shoes color:red" for i in range(30))
    odd = {900: keywords * 12, 901: links, 902: tags, 903: keywords * 12 + text(2), 904: "#boots #cheapboots #shoes " * 30}
    fine = {800: keywords + text(12), 801: None, 802: "", 803: " \n ", 804: text(400), 805: "\n".join(f"{n}ton dep. {i}.15 arr. {i}.40" for i, n in enumerate("ABCDEFGH"))}
    fine[806] = "".join(draw.choice("|/<>*;_^~ ") for _ in range(600))
    table = [(k, v) for k, v in pages] + list(odd.items()) + list(fine.items()) + [(900, odd[900])]
    table += [(1000 + i, fine[805].replace("15", str(i + 10))) for i in range(20)] + [(1100 + i, "".join(draw.choice("|/<>*;_^~ ") for _ in range(600))) for i in range(20)]
    df = spark.createDataFrame(table, "doc_id long, text string").withColumn("bits", F.lit("clash")).repartition(4)
    found = prose.score_pages(df, "doc_id")
    rows = found.collect()
    assert len(rows) == len(table)
    assert sorted(r.doc_id for r in rows if r.odd) == [900, 900, 901, 902, 903, 904]
    blank = {r.doc_id: r.bits for r in rows if r.doc_id in (801, 802, 803)}
    assert blank == {801: None, 802: None, 803: None}


def test_pages_too_easy_to_guess(spark):
    """What is printed over and over is guessed at once: perplexity is abnormally low."""
    draw = random.Random(8)
    rows = [(i, "\n".join(sentence(draw) for _ in range(12))) for i in range(300)]
    rows += [(1000 + i, "and so it was and so it is " * 60) for i in range(25)]
    found = prose.score_pages(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").where("odd").collect()
    assert sorted(r.doc_id for r in found) == list(range(1000, 1025))
    assert all(r.bits < 1 for r in found)


def test_model_decides(spark):
    """Pages whose tokens are all of ordinary words, without any link, tag, repeat or separator, are told by their sequences."""
    draw = random.Random(9)
    names = [f"{a}{b}" for a in ("boot", "lamp", "sofa", "tyre", "wig", "loan", "pond", "dog", "tea") for b in ("house", "shop", "seller", "light", "wood", "land")]
    rows = [(i, "\n".join(sentence(draw) for _ in range(12))) for i in range(300)]
    rows += [(1000 + i, " ".join(draw.sample(names, len(names)))) for i in range(4)]
    scored = prose.score_pages(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", settings=prose.Settings(marks=0.9))
    assert sorted(r.doc_id for r in scored.where("odd").collect()) == [1000, 1001, 1002, 1003]


def test_same_page_same_score_in_larger_corpus():
    """The model's estimates follow shares, not counts."""
    draw = np.random.default_rng(3)
    triples, counts = np.unique(draw.integers(0, 8**3, 400), return_counts=True)
    small, large = (prose.Model(8, triples, counts * k, 2e-3, 2e-4) for k in (1, 1000))
    symbol = draw.integers(1, 8, 500)
    assert np.allclose(small.surprisal(symbol), large.surprisal(symbol), atol=1e-4)


def test_symbols_follow_a_slow_reading():
    s = prose.Settings(function_words=2, shapes=1)
    tokens = prose._Tokens()
    numbers = [tokens[t] for t in prose._TOKENS("The well, the a-b well x.y.z 1850 # Well")]
    codes, sizes = np.array(tokens.code, dtype="<u4")[numbers], np.array(tokens.size, dtype=np.uint8)[numbers]
    kind = codes >> 28
    assert kind.tolist() == [prose.CAPITAL, prose.LOWER, prose.MARK, prose.LOWER, prose.SHAPE, prose.LOWER, prose.SHAPE, prose.NUMBER, prose.MARK, prose.CAPITAL]
    words = np.array([prose.word_hash("the"), prose.word_hash("well"), 1 << 28 | prose.word_hash("a-a")])
    lexicon = prose.Lexicon(words, np.array([10, 4, 5]), np.array([30, 5, 5]), 10, s)
    got = lexicon.symbols(codes, sizes)
    assert got[0] == got[3] == 1 and got[1] == got[5] == got[9] == 2
    assert len(set(got.tolist())) == 7 and got.max() < lexicon.size


def test_pages_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert prose.score_pages(empty, "doc_id").count() == 0
    nulls = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r.odd for r in prose.score_pages(nulls, "doc_id").collect()] == [False, False]
