"""Names of many words, and of words with many forms, meet all that they agree with."""

import random

import pytest

from ledgerlens.llm import names
from ledgerlens.llm.names import Forms, link_names, paired

RNG = random.Random(11)
WORDS = sorted({"".join(RNG.choice("bdgjklmprstv") + RNG.choice("aiou") for _ in range(5)) for _ in range(60)})


def linked(spark, rows, short=()):
    forms = spark.createDataFrame([("Bikko", "Bikadak", "given"), *short], "short_form string, full_form string, form_kind string")
    out = {}
    for k, h in link_names(spark.createDataFrame(list(enumerate(rows)), "account_id bigint, name string"), forms).collect():
        out.setdefault(h, set()).add(k)
    return sorted(map(sorted, out.values()))


def test_long_names_are_compared(spark):
    person, other = WORDS[:30], WORDS[30:]
    slip = [*person[:9], person[9][:-1] + "e", *person[10:]]
    company = ["Traders", *other]
    worse = ["Traders", *other[:5], other[5][:-1] + "e", *other[6:]]
    rows = [" ".join(person), " ".join(slip), " ".join(reversed(person[:29])), " ".join(company), " ".join(worse), " ".join(person[3:5])]
    assert linked(spark, rows) == [[0, 1, 2, 5], [3, 4]]


def test_many_forms_meet_few(spark, monkeypatch):
    """One side has more forms than are joined, the other has not."""
    monkeypatch.setattr(names, "MOST_JOINED", 1)
    f = Forms([])
    many = ("company", [("lilpavi", frozenset({"lilpavi", "lilpati"})), ("tea", frozenset({"tea"})), ("works", frozenset({"works"}))], [])
    few = ("company", [("lilpati", frozenset({"lilpati"})), ("tea", frozenset({"tea"})), ("works", frozenset({"works"}))], [])
    mine = {k[1:] for k in names.block_keys(*many, f) if k[0] == "w"}
    assert mine & names.wide_keys(*few) and names.agree(many, few, f) == ""
    alone = ("company", [("tealeaf", frozenset({"tealeaf", "teabag"}))], [])
    assert {k[1:] for k in names.block_keys(*alone, f) if k[0] == "w"} & names.wide_keys(*alone)
    assert linked(spark, ["Lilpavidok Tea Works", "Lilpavidok Tea Works Ltd", "Lilpavidaok Tea Works"]) == [[0, 1, 2]]


def test_a_way_through_all_words():
    """Each word agrees with its own and the one before; the last one moves all others on."""
    n = 1200
    left, right = paired([("a", i) for i in range(n)], [("b", i) for i in range(n)], lambda x, y: y[1] == 0 if x[1] == n - 1 else y[1] in (x[1], x[1] + 1))
    assert left == right == []


@pytest.mark.parametrize("seed", range(5))
def test_pairing_is_the_largest(seed):
    from itertools import permutations

    rng = random.Random(seed)
    ok = {(i, j) for i in range(6) for j in range(6) if rng.random() < 0.35}
    left, right = paired([("a", i) for i in range(6)], [("b", j) for j in range(6)], lambda x, y: (x[1], y[1]) in ok)
    most = max(sum((i, p[i]) in ok for i in range(6)) for p in permutations(range(6)))
    assert len(left) == len(right) == 6 - most
