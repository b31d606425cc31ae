"""p6 against the encoder run on whole texts."""

import os
import random

import numpy as np
import pytest

from ledgerlens.llm import encoding as e

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(e.TOKENIZERS, e.VOCABULARY)), reason="no vocabulary here")
SIGNS = ["a", "b", " ", "  ", "\n", "\r\n", "'s", "'", "'re", "r", "1", "²", "é", "\u3000", "\xa0", "\x1c", "\x85", "!", "\t", "👍", "\u200d", "<|endoftext|>", "ll", "中文", "。", "、", "ｶ", "！", "я", "ё", "가", "ぁ", "_", "(", "]", "0", "٣", "ǆ", "'ve", "d", "def f(x):\n    return x\n"]


@pytest.fixture(scope="module")
def encode():
    return e.Vocabulary().encoder().encode_ordinary


def test_joints(encode):
    rnd = random.Random(3)
    for _ in range(3000):
        text = "".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 40)))
        at = sorted(rnd.sample(range(len(text) + 1), min(len(text), rnd.randint(0, 6))))
        parts = [p for p in (text[a:b] for a, b in zip([0, *at], [*at, len(text)])) if p]
        pieces = [(h, None if m is None else np.array(encode(m), dtype=np.uint16), t) for h, m, t in map(e.split_at_syncs, parts)]
        assert list(e.assemble(pieces, encode)) == encode(text)


def test_cuts_are_the_text_and_survive_a_shift():
    rnd = random.Random(4)
    body = "".join(rnd.choice("abcdefgh \n") for _ in range(30000))
    chunks = e.cut(body)
    assert "".join(chunks) == body and len(chunks) > 10 and max(map(len, chunks)) <= e.MOST
    shared = set(chunks) & set(e.cut("a new first line\n" + body))
    assert len(shared) > len(chunks) * 0.9
    assert "".join(e.cut("x" * 100000)) == "x" * 100000 and max(map(len, e.cut("x" * 100000))) <= e.MOST


def test_text_without_blanks_is_shared(spark, encode):
    """A minified file and a text of Chinese: nearly all of it lies between sync points, and copies of it are cut alike."""
    rnd = random.Random(7)
    minified = "".join(f"function a{rnd.randint(0, 999)}(b,c){{return b+c*{rnd.randint(0, 99)};}}" for _ in range(3000))
    chinese = "".join("".join(chr(rnd.randint(0x4E00, 0x9FA0)) for _ in range(rnd.randint(3, 12))) + rnd.choice("，。！、") for _ in range(6000))
    for text in (minified, chinese):
        pieces = [e.split_at_syncs(c) for c in e.cut(text)]
        assert len(pieces) > 20 and sum(len(m or "") for _, m, _ in pieces) > 0.9 * len(text)
        assert len(set(e.cut(text)) & set(e.cut("x" + text[:20000] + "CHANGED" + text[20000:]))) > 0.8 * len(pieces)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([minified, "1" + minified, chinese, chinese])], "doc_id bigint, text string")
    assert {r["doc_id"]: list(r["ids"]) for r in e.encode_corpus(df).collect()} == {0: encode(minified), 1: encode("1" + minified), 2: encode(chinese), 3: encode(chinese)}


def test_a_chunk_of_most_texts_is_spread(spark, encode, monkeypatch):
    monkeypatch.setattr(e, "HOT", 3)
    base = "".join(f"line {i} of a licence\n" for i in range(200))
    texts = [base + f"own {i}" for i in range(300)] + [""] * 50 + [None] * 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert {r["doc_id"]: list(r["ids"]) for r in e.encode_corpus(df).collect()} == {i: encode(t) if t else [] for i, t in enumerate(texts)}


def test_corpus(spark, encode):
    rnd = random.Random(5)
    base = "".join(rnd.choice(SIGNS) for _ in range(4000))
    texts = [base, base, base[:5000] + "CHANGED" + base[5000:], "", None, " ", "a", "<|endoftext|>", "z" * 60000, base * 20, "\n" * 5000]
    data = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(0, base, "x", 1), (None, "null key", "y", 2), (1, "other text of the same id", "y", 2)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, digest string, seq int").repartition(4)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, list(r["ids"])) for r in e.encode_corpus(df).collect()))
    assert got == sorted((i is None, i or 0, encode(t) if t else []) for i, t, *_ in data)


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    out = e.encode_corpus(df)
    assert out.collect() == [] and out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
