"""p7 against a search over word lists."""

import random
import re

from ledgerlens.llm import leaks
from ledgerlens.llm.codepoints import forms

WORDS = re.compile(r"[^\W_]+")
DOCS, ITEMS = "doc_id bigint, text string, item_id int, part string", "item_id bigint, prompt string, answer string, doc_id int"


def words(text):
    return WORDS.findall(forms([text])[0].lower())


def brute(docs, items, k=12):
    grams = {}
    for i, p, a, _ in items:
        for t in (p, a):
            w = words(t or "")
            for j in range(len(w) - k + 1):
                grams.setdefault(tuple(w[j : j + k]), set()).add(i)
    out = set()
    for d, t, *_ in docs:
        w = words(t or "")
        out |= {(d, i) for j in range(len(w) - k + 1) for i in grams.get(tuple(w[j : j + k]), ()) if d is not None and i is not None}
    return out


def corpus():
    rnd = random.Random(6)
    vocabulary = ["w%d" % i for i in range(60)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(8, 40))), " ".join(rnd.choice(vocabulary) for _ in range(20)), 9) for i in range(20)]
    items += [(20, None, "", 9), (21, "too short", None, 9), (None, items[0][1], None, 9), (22, "loop " * 30, None, 9), items[3]]
    docs = []
    for d in range(120):
        t = " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 200)))
        if d % 3 == 0:
            w = rnd.choice(items[:20])[1 + d % 2].split()
            n = rnd.choice([11, 12, 13, len(w)])
            at = rnd.randint(0, max(0, len(w) - n))
            piece = rnd.choice([" ", "_", "\n\t", " -- ", "."]).join(w[at : at + n])
            t = t[: len(t) // 2] + " | " + rnd.choice([piece, piece.upper(), piece.replace("w", "ｗ"), piece.replace("w", "w\u200b")]) + " | " + t[len(t) // 2 :]
        docs.append((d, t, 1, "p"))
    return docs + [(200, None, 1, "p"), (201, "", 1, "p"), (202, "   \n", 1, "p"), (203, "loop " * 40, 1, "p"), docs[0], (None, items[0][1], 1, "p"), (204, ("x " * 50000) + items[1][1], 1, "p")], items


def test_found(spark):
    docs, items = corpus()
    got = leaks.leaked_items(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, ITEMS))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(docs, items) and len(rows) > 20


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    docs, items = corpus()
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    whole = sorted(map(tuple, leaks.leaks(d, i).collect()))
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 1500)
    got = leaks.leaked_items(d, i)
    assert {tuple(r) for r in got.collect()} == brute(docs, items)
    assert sorted(map(tuple, leaks.leaks(d, i).collect())) == whole and len(whole) > 20
    assert leaks.leaks(d.limit(0), i).collect() == []


def test_reordered_passage(spark):
    p = ["word%d" % i for i in range(30)]
    parts = [p[18:24], p[0:6], p[24:30], p[12:18], p[6:12]]
    docs = [(1, " filler stuff ".join(" ".join(x) for x in parts), 0, ""), (2, " ".join(p[:10]), 0, ""), (3, " ".join(p), 0, "")]
    got = {r["doc_id"]: r for r in leaks.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, " ".join(p), None, 0)], ITEMS)).collect()}
    assert set(got) == {1, 3}
    assert (got[1]["n_tiles"], got[1]["longest"], got[1]["coverage"]) == (5, 6, 1.0) and (got[3]["n_tiles"], got[3]["longest"]) == (1, 30)


def test_tiles_do_not_overlap():
    import numpy as np

    d, p = np.array([1, 2, 3, 4, 5, 6, 9, 1, 2, 3, 4, 5]), np.array([1, 2, 3, 4, 5, 6])
    assert leaks.tile(d, p) == [(0, 0, 6)]


def greedy(d, p, least):
    """Greedy string tiling as it is defined."""
    out, left_d, left_p = [], [True] * len(d), [True] * len(p)
    while True:
        best = None
        for j in range(len(p)):
            for i in range(len(d)):
                n = 0
                while i + n < len(d) and j + n < len(p) and d[i + n] == p[j + n] and left_d[i + n] and left_p[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        out.append(best)
        for x in range(best[2]):
            left_d[best[0] + x] = left_p[best[1] + x] = False


def test_tiles_against_the_definition():
    import numpy as np

    rnd = random.Random(11)
    for _ in range(150):
        k = rnd.choice([1, 2, 3, 6])
        d, p = ([rnd.randint(1, k) for _ in range(rnd.randint(0, 40))] for _ in range(2))
        if rnd.random() < 0.5 and len(p) > 12:
            d = d[:10] + p[6:] + d[10:15] + p[:6]
        least = rnd.choice([2, 3, 5])
        assert leaks.tile(np.array(d, dtype=np.uint64), np.array(p, dtype=np.uint64), least) == greedy(d, p, least)


def test_a_million_repeated_words(spark):
    """No product of places: a table of a million zeros against passages that repeat themselves."""
    import time

    docs = [(1, "0 " * 1_000_000, 0, ""), (2, "0 1 " * 200_000, 0, "")]
    items = [(1, "0 " * 2000, None, 0), (2, None, "1 0 " * 1000, 0), (3, "1 1 " * 1000, None, 0)]
    began = time.time()
    got = sorted((r["doc_id"], r["item_id"], r["n_tiles"], r["longest"]) for r in leaks.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect())
    assert got == [(1, 1, 1, 2000), (2, 2, 1, 2000)] and time.time() - began < 60


def test_nothing(spark):
    docs, items = corpus()
    assert leaks.leaked_items(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).collect() == []
    assert leaks.leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).collect() == []
