"""p3: parsing, comparison and clustering of names."""

import pytest

from ledgerlens.llm import names
from ledgerlens.llm.names import Forms, agree, holder_pairs, link_names, parse

FORMS = [
    ("Bikko", "Bikadak", "given"), ("Kadi", "Bikadak", "given"), ("Bahi", "Bahidon", "given"), ("Bapii", "Bapitta", "given"),
    ("Svcs.", "Services", "business"), ("F&B", "Food & Beverage", "business"), ("S/W", "Software", "business"), ("Co-op Soc.", "Cooperative Society", "business"),
    (None, "X", "given"), ("Y", None, "business"),
]
SAME = [
    ("Phivihek Khovalra", "KHOVALRA, PHIVIHEK"), ("Phivihek Khovalra", "Dr. Phivihek Kohvalra."), ("Bikadak Marok Mirabam", "Bikko M. Mirabam"), ("Bikadak Mirabam", "Mirabam Kadi"),
    ("Hirrazor Gopakvi Khovalra", "H. Gopakvi Khovalra"), ("Kherobrut Hasuphir", "Kherobrut Jidel Hasuphir"), ("Davabhil Thekipil", "Dawabhil Theekipil"), ("JuvazashKakhiphugho", "Juvazash Kakhiphugho"),
    ("juvazashkakhiphugho", "Juvazash Kakhiphugho"), ("Yashpagu Software Services Ltd", "M/s Yashpagu S/W Svcs. Private Limited"), ("Jebrekre Food and Beverage House No. 2", "The Jebrekre F&B House #2 Ltd."),
    ("Lilpavi Tea Cooperative Society", "Tea Co-op Soc. Lilpavi"), ("Shihadok Timber Works", "Shihdaok Timber Works (P) Ltd"),
]
DIFFERENT = [
    ("Phivihek Khovalra", "Phichuchu Khovalra"), ("Hirrazor Gopakvi Khovalra", "Tripak Gopakvi Khovalra"), ("K. Khovalra", "Kosashu Khovalra"), ("K. Khovalra", "Khovalra"), ("Bahi Trubrukrish", "Bapii Trubrukrish"),
    ("Phivihek K. Khovalra", "Phivihek M. Khovalra"), ("Phivihek Marok Khovalra", "Phivihek Jidel Khovalra"), ("Jebrekre Tea House No 2", "Jebrekre Tea House No 12"), ("Jebrekre Tea House", "Jebrekre Tea House No 2"),
    ("Lilpavi Tea Works", "Lilpavi Tea Traders"), ("Lilpavi Metal Works", "Lilpavi Medical Works"), ("Lilpavi Tea Works", "Lilpavi Tea"),
]


def read(a, b, f):
    """Two names with what their tokens lead to, in a world where there are no others."""
    parsed = [parse(x, f) for x in (a, b)]
    stated = {"person": {*f.full, *f.short}, "company": f.trade}
    out = []
    for kind, full, rest in parsed:
        others = {t for k, g, _ in parsed if k == kind for t in g}
        leads = {t: sorted(u for u in others | stated[kind] if u != t and (u in stated[kind] or u > t) and t not in stated[kind] and names.alike(t, u, kind, f)) for t in full}
        out.append((kind, [(t, names.meanings(t, kind, leads[t], f)) for t in full], rest))
    return out


MEETS = {"=": "=", "b": "bt", "t": "b", "x": "y", "y": "x", "j": "k", "k": "j"}


def meet(x, y, f):
    other = {}
    for k in names.block_keys(*y, f):
        other.setdefault(k[1:], set()).add(k[0])
    return any(set(MEETS[k[0]]) & other.get(k[1:], set()) for k in names.block_keys(*x, f))


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    f = Forms(FORMS)
    x, y = read(a, b, f)
    assert agree(x, y, f) is not None and agree(y, x, f) is not None
    assert meet(x, y, f) or x == y
    for t, u in zip(x[1], y[1]):
        assert names.opened(names.written(x)) == x


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    f = Forms(FORMS)
    assert agree(*read(a, b, f), f) is None


@pytest.mark.parametrize("a,b", [("Zenith Optics", "Zenith Optics Ltd"), ("Himal Ventures Pvt Ltd", "himal ventures"), ("M/s Zenith Optics", "Optics Zenith")])
def test_a_legal_form_does_not_separate(spark, a, b):
    accounts = spark.createDataFrame([(1, a), (2, b), (3, "Zenith Opera")], "account_id bigint, name string")
    forms = spark.createDataFrame(FORMS, "short_form string, full_form string, form_kind string")
    assert [tuple(r) for r in holder_pairs(link_names(accounts, forms)).collect()] == [(1, 2)]


def test_two_slips_of_a_more_frequent_name(spark):
    """Each is a slip of a name that others bear, though they are no slips of each other."""
    people = ["Pherhtoo Chabakrim", "Pherhaoto Chabakrim", "Pherhoto Dasesam", "Pherhoto Nozipen"]
    accounts = spark.createDataFrame(list(enumerate(people)), "account_id bigint, name string")
    forms = spark.createDataFrame(FORMS, "short_form string, full_form string, form_kind string")
    assert [tuple(r) for r in holder_pairs(link_names(accounts, forms)).collect()] == [(0, 1)]


@pytest.mark.parametrize("a,b,same", [("thashimaso", "thashimmaso", True), ("voyilam", "voyilaam", True), ("kramrakri", "kranrakri", True), ("bahi", "bapo", False), ("ghakhahun", "ghakhu", False),
                                      ("abc", "abd", False), ("x" * 5000 + "abcdef", "x" * 5000 + "abdef", True), ("ab" * 3000, "cd" * 3000, False)])
def test_slips(a, b, same):
    assert names.misspelt(a, b) is same and names.misspelt(b, a) is same


def test_edits_within_a_band():
    import random

    def whole(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rnd = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 8))) for _ in range(2))
        for most in (1, 2, 3):
            assert names.edits(a, b, most) == min(whole(a, b), most + 1)


def test_codes_of_any_length_share_what_is_left():
    import random

    rnd = random.Random(5)
    for n in (3, 62, 63, 64, 65, 66, 200):
        c = "".join(rnd.choice("bdfgk") for _ in range(n))
        i = rnd.randrange(n)
        assert names.near(c) & names.near(c[:i] + c[i + 1 :]) and names.near(c) & names.near(c[:i] + "m" + c[i + 1 :])


@pytest.mark.parametrize("a,b", [("juvazashkakhpiphugho", "Juvazash Kakhiphugho"), ("juvazashkakiphugho", "Kakhiphugho Juvazash"), ("juvazashkakhiphughjo", "Juvazash Kakhiphugho"), ("жувазашкакипуго", "Жувазаш Какирпуго"), ("juvazash" * 9 + "kal", "juvazash" * 9 + " kral")])
def test_two_names_as_one_word_with_a_slip(a, b):
    f = Forms(FORMS)
    x, y = read(a, b, f)
    if agree(x, y, f) is not None:
        assert meet(x, y, f) and meet(y, x, f)
    assert agree(*read("Juvazashkakhiphugho", "Juvazash Kakhiphugho", f), f) is not None


def test_pairing_does_not_depend_on_order():
    near = {("a1", "b1"), ("a1", "b2"), ("a2", "b1")}
    for left in (["a1", "a2"], ["a2", "a1"]):
        for right in (["b1", "b2"], ["b2", "b1"]):
            assert names.paired(left, right, lambda x, y: (x, y) in near) == ([], [])


@pytest.mark.parametrize("name", [None, "", "  ", "-", "N/A", "unknown", "TBC", "Test Account", "12345", "..."])
def test_nobody(name):
    assert parse(name, Forms(FORMS)) is None


def test_jaro_winkler():
    assert names.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and names.jaro_winkler("abc", "xyz") == 0


def test_clusters(spark):
    people = ["Phivihek Khovalra", "KHOVALRA, PHIVIHEK", "Phivihek Khovalra", "Tripak Khovalra", None, "N/A", "n/a", "x" * 20000, "Khovalra", "Bikko Marok Mirabam", "Bikadak Mirabam", "Bikadak M Mirabam",
              "Gita Marok Zutnalin", "Gita Jidel Zutnalin", "Gita Zutnalin", "K. Zutnalin", "Zutnalin K", "K. Zutnalin"]
    data = [(i, n, "a", "b", 1) for i, n in enumerate(people)]
    data += [data[0], (None, "Phivihek Khovalra", "a", "b", 1)]
    accounts = spark.createDataFrame(data, "account_id bigint, name string, sig string, kind string, cluster int")
    forms = spark.createDataFrame(FORMS, "short_form string, full_form string, form_kind string")
    members = {r[0]: r[1] for r in link_names(accounts, forms).collect()}
    assert members == {0: 0, 1: 0, 2: 0, 3: 3, 7: 7, 8: 8, 9: 9, 10: 9, 11: 9, 12: 12, 13: 13, 14: 14, 15: 15, 16: 16, 17: 15}
    pairs = sorted(map(tuple, holder_pairs(link_names(accounts, forms)).collect()))
    assert pairs == [(0, 1), (0, 2), (1, 2), (9, 10), (9, 11), (10, 11), (15, 17)]


def test_nothing(spark):
    accounts = spark.createDataFrame([], "account_id bigint, name string")
    forms = spark.createDataFrame([], "short_form string, full_form string, form_kind string")
    assert link_names(accounts, forms).collect() == [] and holder_pairs(link_names(accounts, forms)).collect() == []


@pytest.mark.parametrize("a,b", [("Citakreguk, Zashopel", "Chitakreguk, Zashoptel"), ("Yashpagu Zilmetor Works", "Yashpgau Zilmtor Works")])
def test_slips_in_both_names(spark, a, b):
    accounts = spark.createDataFrame([(1, a), (2, b)], "account_id bigint, name string")
    forms = spark.createDataFrame(FORMS, "short_form string, full_form string, form_kind string")
    assert [tuple(r) for r in holder_pairs(link_names(accounts, forms)).collect()] == [(1, 2)]
