"""p8: the form of texts, and pairs of texts that look the same."""

import random
import unicodedata

import pytest

from ledgerlens.llm.codepoints import LOOK_ALIKES, forms, tables
from ledgerlens.llm.same_look import consistent_forms, look_classes, same_look_pairs

SAME = [
    ("ａＢ３（", "aB3("), ("e\u0301", "é"), ("a\u0323\u0302", "a\u0302\u0323"), ("суrsοr", "cyrsor"), ("a\u200bb\u2060c\ufeff", "abc"), ("a\xa0b\u202fc\u2007d", "a b c d"),
    ("\u212a", "K"), ("x\u037e", "x;"), ("\u1fef", "`"), ("M\ufe0eN", "MN"), ("a\u034fb", "ab"), ("е\u0301", "é"), ("a\u2010b\u2011c", "a-b-c"), ("가", "\u1100\u1161"), ("a\u200db", "ab"), ("क\u200c", "क"),
    ("\ua4f2", "I"), ("\u13a2\u13ac\u13b3\u13bb\u13da\u13df", "TEWHSC"), ("\u2ca4\u2c9f\u2ca2", "CoP"), ("\u0251", "a"), ("\u04c0", "I"), ("\u057d\u0578", "un"),
    ("\u3000", " "), ("іԁ", "id"), ("क़", "क\u093c"), ("\u2126", "Ω"),
]
DIFFERENT = [
    ("ñ", "n"), ("x³", "x3"), ("①", "1"), ("½", "1/2"), ("H₂O", "H2O"), ("A", "a"), ("é", "è"), ("™", "TM"), ("\U0001f469\u200d\U0001f4bb", "\U0001f469\U0001f4bb"), ("a  b", "a b"), ("a\tb", "a b"), ("a\r\nb", "a\nb"),
    ("l", "1"), ("O", "0"), ("ﬁ", "fi"), ("क\u094d\u200dष", "क\u094dष"), ("\U0001f44d\U0001f3fd", "\U0001f44d"), ("≠", "="), ("Ⅳ", "IV"), ("\u0131", "i"), ("\u0440", "q"),
    ("\U0001f3f4\U000e0067\U000e007f", "\U0001f3f4"), ("\u2764\ufe0f", "\u2764"), ("\U0001f469\u200d\u2764\ufe0f\u200d\U0001f469", "\U0001f469\u2764\ufe0f\U0001f469"), ("\u0628\u200c\u0628", "\u0628\u0628"),
]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    x, y = forms([a, b])
    assert x == y


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    x, y = forms([a, b])
    assert x != y


def brute(s):
    plain = {x: k for signs, alike in LOOK_ALIKES.values() for k, x in zip(signs, alike)}
    out = []
    for ch in unicodedata.normalize("NFD", s):
        d = unicodedata.decomposition(ch)
        if d.startswith(("<wide>", "<narrow>")):
            ch = chr(int(d.split()[1], 16))
        if unicodedata.category(ch) == "Zs" and ch != "\u1680":
            ch = " "
        out.append(plain.get(ch, ch))
    return unicodedata.normalize("NFC", "".join(out))


def test_against_normalisation():
    rnd = random.Random(1)
    pool = [c for c in range(0x20, 0x3100) if unicodedata.category(chr(c)) != "Cn" and not tables().may_vanish[c]]
    pool += [*range(0xAC00, 0xAC40), *[0x1100, 0x1161, 0x11A8] * 50, *[0x301, 0x308, 0x323, 0x327, 0x31B, 0x345] * 60, *range(0x61, 0x7B)] * 3
    texts = ["".join(chr(rnd.choice(pool)) for _ in range(30)) for _ in range(1500)] + ["", "\u0301", "a" * 100000 + "е"]
    made = forms(texts)
    assert made == [brute(t) for t in texts] and forms(made) == made
    assert sum(len(a) for _, a in LOOK_ALIKES.values()) < 200


def test_a_million_joiners():
    """Time goes by the length of the text, whatever hides in a row."""
    import time

    began = time.time()
    made = forms(["a" + "\u200d" * 1_000_000 + "b", "\u0628" + "\u200c" * 200_000 + "\u0628", "\U0001f469" + "\ufe0f" * 300_000, "\U0001f3f4" + "\U000e0067" * 300_000])
    assert made[0] == "ab" and made[1] == "\u0628\u200c\u0628" and made[2] == "\U0001f469" and made[3] == "\U0001f3f4" + "\U000e0067" * 300_000
    assert time.time() - began < 30


def test_pairs(spark):
    texts = ["abc", "abc", "ab\u200bc", "ａbc", None, "", "  ", "\u200b", "\xa0\xa0", "Abc", "long " * 50000, "long " * 49999 + "lоng ", "solo"]
    data = [(i, t, "x", b"y") for i, t in enumerate(texts)]
    data += [data[0], (None, "abc", "x", b"y"), (None, "ａbc", "x", b"y")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, form string, string binary").repartition(3)
    assert sorted(map(tuple, same_look_pairs(df, salts=3).collect())) == [(0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (10, 11)]
    classes = {r[0]: tuple(r)[1:] for r in look_classes(df, salts=3).collect()}
    assert classes == {0: (0, 4, 3), 1: (0, 4, 3), 2: (0, 4, 3), 3: (0, 4, 3), 9: (9, 1, 1), 10: (10, 2, 2), 11: (10, 2, 2), 12: (12, 1, 1)}
    made = {r[0]: r[1] for r in consistent_forms(df.where("doc_id IS NOT NULL")).collect()}
    assert made[3] == "abc" and made[4] is None and made[5] == "" and made[8] == "  " and len(made) == len(texts)


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert same_look_pairs(df).collect() == [] and consistent_forms(df).collect() == [] and look_classes(df).collect() == []
