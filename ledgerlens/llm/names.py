"""Variant spellings of names that belong to one holder.

Names are parsed into tokens. The different tokens of all names, a small vocabulary however
many names there are, are blocked by phonetic codes and compared with Jaro-Winkler; a token
leads to those more frequent ones it is a slip of, and through the table of short forms to
full forms. Names are then blocked by the phonetic codes of their sorted tokens, in every
form a token leads to, and two names agree where enough of their tokens lead to a common
form. Accepted pairs are clustered by connected components. Equal parses are collapsed
first, so a name borne by any share of all rows is compared once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, combinations, islice, product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.components import components
from ledgerlens.session import materialise

#: More rows than this of short forms would not be sent to every task.
MOST_FORMS = 200_000
#: Beyond so many words a name's blocks leave the further names open.
MOST_WORDS = 24
#: Beyond so many joined forms of its words a name's blocks are the wide ones.
MOST_JOINED = 512
#: Rows of a frame of blocks, of which a long name has many.
FRAME = 100_000
#: Beyond so many signs a code is kept as its hash.
LONG_CODE = 64
#: Jaro-Winkler from which two words are one, and the edits that may lie between: by the letters of the shorter one.
ACCEPTED = ((9, 0.95, None), (7, 0.88, 2), (4, 0.75, 1))

# Fixed values.
PLACEHOLDERS = frozenset(
    "customer|n a|na|nil|none|null|xxx|xx|x|unknown|not known|tbc|tba|test|test account|no name|name not given|not given|not available|do not use|anonymous|dummy".split("|")
)
TITLES = frozenset("mr mrs ms miss dr er shri sri smt prof late".split())
LEGAL = frozenset("limited ltd private pvt llc inc plc gmbh".split())
ARTICLES = frozenset("the and of".split())
NUMBER_WORDS = frozenset("no nr num number unit".split())
TRADE = frozenset(
    """agency agricultural associates automobile beverage brick brothers carpet cement centre chemical company construction cooperative
    corporation courier dairy distributors education electrical energy engineering enterprises exporters food footwear foundation furniture
    gems glass grease group handicraft hardware holdings hospitality house importers industries insurance international jewellery laboratory
    logistics manufacturing medical metal mills oil packaging paper pharmaceutical plastic poultry seed services society software solutions
    stationery store suppliers tea textile tile timber tour traders transport travel workshop works""".split()
)

_TOKEN = re.compile(r"[^\W\d_]+|\d+")
_CAMEL = re.compile(r"(?<=[^\W\d_A-Z])(?=[A-Z])")
_MESSRS = re.compile(r"^\s*m\s*/\s*s\b\.?", re.IGNORECASE)


class Forms:
    """Short forms of given names and of words in company names."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        self.full: dict[str, set[str]] = defaultdict(set)
        self.short: dict[str, set[str]] = defaultdict(set)
        self.business: list[tuple[tuple[str, ...], tuple[str, ...]]] = []
        self.trade = set(TRADE)
        for short, full, kind in rows:
            if not short or not full:
                continue
            if kind == "given":
                self.full[short.lower()].add(full.lower())
                self.short[full.lower()].add(short.lower())
            else:
                short_tokens, full_tokens = words(short), words(full)
                if short_tokens and full_tokens:
                    self.business.append((short_tokens, full_tokens))
                    self.trade.update(full_tokens)
        self.business.sort(key=lambda x: -len(x[0]))
        self.one = {s[0]: f for s, f in self.business if len(s) == 1}
        self.more = [(s, f) for s, f in self.business if len(s) > 1]

    def expand(self, tokens: list[str]) -> list[str]:
        out, i = [], 0
        while i < len(tokens):
            for short, full in self.more:
                if tuple(tokens[i : i + len(short)]) == short:
                    out += full
                    i += len(short)
                    break
            else:
                out += self.one.get(tokens[i], (tokens[i],))
                i += 1
        return out


def words(text: str) -> tuple[str, ...]:
    return tuple(t for t in _TOKEN.findall(text.lower()) if t not in ARTICLES)


def parse(name: str | None, forms: Forms) -> tuple[str, list[str], list[str]] | None:
    """(kind, full tokens sorted, initials or numbers sorted), or None where the name names nobody.

    kind is ``person`` (initials are single letters) or ``company`` (numbers in place of
    initials; legal forms, articles and number words are dropped).
    """
    if name is None:
        return None
    messrs = bool(_MESSRS.match(name))
    text = _MESSRS.sub(" ", name)
    raw = [t.lower() for t in _TOKEN.findall(_CAMEL.sub(" ", text))]
    if not raw or not any(t.isalpha() for t in raw) or " ".join(raw) in PLACEHOLDERS or "".join(raw) in PLACEHOLDERS:
        return None
    digits = [t for t in raw if not t.isalpha()]
    plain = [t for t in raw if t.isalpha()]
    expanded = forms.expand([t for t in plain if t not in ARTICLES])
    company = (
        messrs or bool(digits) or "&" in name or "the" in plain or any(t in LEGAL for t in plain)
        or any(t in forms.trade for t in expanded) or any(t in forms.trade for t in plain)
    )
    if company:
        kept = [t for t in expanded if t not in LEGAL and t not in NUMBER_WORDS and t not in ARTICLES]
        core = [t for t in kept if len(t) > 1] or kept
        if core:
            return "company", sorted(core), sorted(str(int(d)) for d in digits)
        return "company", sorted(plain), sorted(str(int(d)) for d in digits)
    while len(plain) > 1 and plain[0] in TITLES:
        plain = plain[1:]
    full = sorted(t for t in plain if len(t) > 1)
    return "person", full, sorted(t for t in plain if len(t) == 1)


def sound(token: str) -> str:
    """The spelling brought to one form per sound: digraphs, doubled letters and long vowels."""
    t = token.replace("ph", "f").replace("w", "v").replace("ee", "i").replace("oo", "u").replace("q", "k").replace("z", "j").replace("x", "ks")
    t = re.sub(r"c(?!h)", "k", t)
    return re.sub(r"(.)\1+", r"\1", t)


def code(token: str) -> str:
    """Phonetic code: the consonants, one sign for those that sound alike, led by an a where the token begins with a vowel.

    An aspirate keeps its h as a sign of its own, so that a slip within it stays one edit.
    """
    return _skeleton(token.replace("f", "ph"))


def codes(token: str) -> set[str]:
    """The code, and for a token with an f the one in which it is a slip for another letter."""
    return {code(token), _skeleton(token)}


def _skeleton(token: str) -> str:
    t = token.replace("w", "v").replace("q", "k").replace("c", "k").replace("z", "j").replace("x", "ks")
    t = re.sub(r"(.)\1+", r"\1", t)
    return ("a" if t[:1] in "aeiou" else "") + re.sub("[aeiouy]", "", t)


def initials(token: str) -> set[str]:
    """Letters that can stand for the token: its first as written, and as other spellings of the sound begin."""
    return {token[0], sound(token)[0]} | ({"p"} if token[0] == "f" else set())


_PRIME = (1 << 61) - 1


def _power_sums(c: str) -> tuple[list[int], list[int]]:
    sums, powers = [0], [1]
    for x in c:
        sums.append((sums[-1] * 1_000_003 + ord(x)) % _PRIME)
        powers.append(powers[-1] * 1_000_003 % _PRIME)
    return sums, powers


def short(c: str) -> str:
    """The code itself, or its hash where it is long."""
    return c if len(c) < LONG_CODE else f"#{len(c)}:{_power_sums(c)[0][-1]}"


def near(c: str) -> set[str]:
    """The code and all codes with one sign less: two codes one edit apart share one. Of a long code the hashes, in time that grows with its length."""
    if len(c) <= LONG_CODE:
        return {short(c)} | ({c[:i] + c[i + 1 :] for i in range(len(c))} if len(c) > 1 else set())
    sums, powers = _power_sums(c)
    n, whole = len(c), sums[-1]
    tails = ((whole - sums[i + 1] * powers[n - i - 1]) % _PRIME for i in range(n))
    return {short(c)} | {f"#{n - 1}:{(sums[i] * powers[n - i - 1] + tail) % _PRIME}" for i, tail in enumerate(tails)}


#: Signs of the codes of words in ASCII letters.
SIGNS = "abdghjklmnprstv"


def around(c: str) -> set[str]:
    """The code, the codes with one sign less, and with one sign of ``SIGNS`` more or in place of another: all codes one edit away."""
    out = near(c)
    if len(c) < LONG_CODE - 1:
        out |= {c[:i] + x + c[i + k :] for i in range(len(c) + 1) for x in SIGNS for k in (0, 1)}
    return out


def token_keys(token: str) -> set[str]:
    """Blocks of a token: words a slip apart share one. The spelling and the sound with up to one letter left out, and the codes, those of four signs or more with up to one left out. Words of fewer than four letters have no slips."""
    if len(token) < 4:
        return set()
    out = {f"~{x}" for x in near(sound(token)) | near(token)}
    for c in codes(token):
        out |= near(c) if len(c) >= 4 else {short(c)}
    return out


Word = tuple[str, frozenset]  # a token and the forms it leads to


def meanings(token: str, kind: str, leads: list[str], forms: Forms) -> frozenset:
    """The forms that stand for a token: itself, what it is a slip of, and for names of persons the full forms of both (of a slip from five letters on)."""
    out = {token, *leads}
    if kind == "person":
        out |= forms.full.get(token, set())
        for x in leads:
            if len(x) >= 5:
                out |= forms.full.get(x, set())
    return frozenset(out)


def _codes_of(full: list[Word]) -> list[list[str]]:
    return [sorted({short(code(m)) for m in ms}) for _, ms in full]


def wide_keys(kind: str, full: list[Word], rest: list[str]) -> set[str]:
    """Blocks of a parse that it shares with every other of which all words agree with its own, whatever number of forms there are: the codes of any two words, of names with one word or more than ``MOST_WORDS`` of any one; with the numbers (=), or without (x)."""
    of = _codes_of(full)
    if 1 < len(of) <= MOST_WORDS:
        parts = {" ".join(sorted((a, b))) for x, y in combinations(of, 2) for a in x for b in y}
    else:
        parts = {a for x in of for a in x}
    marks = {f"=c{len(of)}|{','.join(rest)}|"} if kind == "company" else set()
    if not rest:
        marks.add(f"xc{len(of)}||")
    return {m + p for m in marks for p in parts}


def block_keys(kind: str, full: list[Word], rest: list[str], forms: Forms) -> Iterable[str]:
    """Blocks of a parse, each with a mark that says what it is compared with.

    A person's key joins the codes of two forms, sorted, and ends with the initial of a third
    name (mark =), or with * where that is open: b for names without a third name, t for
    those with one, and only b-b and b-t pairs are compared, so that many names with the
    same two parts do not pair with each other over an open third. A name of more than
    ``MOST_WORDS`` words, of which there are few, has * keys only, l: it pairs with b, t and
    l, as spelling out every third would take the cube of its words. A company's key joins the
    codes of all its words and its numbers (=), or, where too many forms would be joined, is
    w, one of ``wide_keys``, which are made of the other names only if there are any such. A name of two words without letters may be a
    company's that left out its legal form: x pairs with y, companies known as such by
    nothing but that. Two names written as one word: j, of which there are few, with all
    codes an edit away, pairs with k, the code of the two names in either order.
    """
    forms_of = _codes_of(full)

    def whole(mark: str, numbers: str) -> set[str]:
        size = 1
        for f in forms_of:
            size *= len(f)
        if size <= MOST_JOINED:
            return {mark + "c|" + " ".join(sorted(x)) + "|" + numbers for x in product(*forms_of)}
        return {f"w{k}" for k in wide_keys(kind, full, rest) if k[0] == ("=" if mark == "=" else "x")}

    if kind == "company":
        numbers = ",".join(rest)
        known = any(m in forms.trade for _, ms in full for m in ms)
        return sorted(whole("=", numbers) | (set() if known or numbers else whole("y", numbers)))
    keys = set()
    if len(full) >= 2 and not rest:
        keys |= whole("x", "")
    if len(full) == 1 and not rest and len(full[0][0]) >= 8:
        keys |= {f"jj|{d}" for d in around(code(full[0][0]))}
    if len(full) == 2 and not rest:
        for pair in (full, full[::-1]):
            joined = "".join(t for t, _ in pair)
            plain = joined.isascii() and len(joined) < LONG_CODE - 1
            keys |= {f"kj|{d}" for d in ({code(joined)} if plain else near(code(joined)))}
    if len(full) > MOST_WORDS:
        every = [(i, f) for i, fs in enumerate(forms_of) for f in fs]
        return chain(sorted(keys), ("lp|" + " ".join(sorted((f, g))) + "|*" for (i, f), (j, g) in combinations(every, 2) if i != j))
    for i, j in combinations(range(len(full)), 2):
        third = set()
        for k, (t, ms) in enumerate(full):
            if k not in (i, j):
                third |= {x for m in ms | forms.short.get(t, set()) for x in initials(m)}
        third |= {x for t in rest for x in initials(t)}
        for a in forms_of[i]:
            for b in forms_of[j]:
                two = " ".join(sorted((a, b)))
                keys |= {f"=p|{two}|{x}" for x in third}
                keys.add(("t" if third else "b") + f"p|{two}|*")
    return sorted(keys)


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    taken = [False] * len(b)
    mine = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                mine.append(x)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [y for y, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(mine, theirs)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours; most + 1 where there are more. Only the band that ``most`` allows is filled."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    before: list[int] = []
    last = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        row = [far] * (len(b) + 1)
        if i <= most:
            row[0] = i
        for j in range(low, high + 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != b[j - 1]))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before[j - 2] + 1)
            row[j] = min(d, far)
        before, last = last, row
    return last[-1]


def misspelt(a: str, b: str) -> bool:
    """The same word but for a slip, by the Jaro-Winkler likeness of the spellings or of their sounds, with the edits between them as a guard (``ACCEPTED``). Beyond 100 letters two edits are always likeness enough, and nothing else is tried."""
    n = min(len(a), len(b))
    if n < 4:
        return False
    for x, y, m in ((sound(a), sound(b), n), (a, b, n)):
        if x == y:
            return True
        if m > 100:
            if edits(x, y, 2) <= 2:
                return True
            continue
        like = jaro_winkler(x, y)
        for letters, least, most in ACCEPTED:
            if m >= letters and min(len(x), len(y)) >= min(letters, 7) and like >= least and (most is None or edits(x, y, most) <= most):
                return True
    return False


def alike(a: str, b: str, kind: str, forms: Forms) -> bool:
    """Whether one of two different tokens can be a slip of the other. Two that both stand in the table of short forms, or among the words of trades, are words of their own."""
    known = (lambda t: t in forms.trade) if kind == "company" else (lambda t: t in forms.full or t in forms.short)
    return not (known(a) and known(b)) and misspelt(a, b)


def paired(a: list, b: list, agree) -> tuple[list, list]:
    """What is left of both sides when as many as possible that agree are paired, equal ones first; the order of the tokens does not matter."""
    a, b = sorted(a), sorted(b)
    for x in list(a):
        if x in b:
            a.remove(x)
            b.remove(x)
    near = [[j for j, y in enumerate(b) if agree(x, y)] for x in a]
    of: dict[int, int] = {}

    for i in range(len(a)):  # a way that ends at a free one moves all on it; its steps are kept here, as names may be long
        seen: set[int] = set()
        way, tries = [i], [iter(near[i])]
        took: list[int] = []
        while way:
            j = next((j for j in tries[-1] if j not in seen), None)
            if j is None:
                way.pop()
                tries.pop()
                if took:
                    took.pop()
                continue
            seen.add(j)
            took.append(j)
            if j not in of:
                for k, m in zip(way, took):
                    of[m] = k
                break
            way.append(of[j])
            tries.append(iter(near[of[j]]))
    taken = set(of.values())
    return [x for i, x in enumerate(a) if i not in taken], [y for j, y in enumerate(b) if j not in of]


Parsed = tuple[str, list[Word], list[str]]


def agree(a: Parsed, b: Parsed, forms: Forms) -> str | None:
    """None where two parses cannot be one holder; otherwise the codes of the names that only one of them gives in full.

    See TESTDATA.md, p3_found. A person's name without letters and a company's may be one:
    all words have to agree.
    """

    def common(x: Word, y: Word) -> bool:
        return not x[1].isdisjoint(y[1])

    if "company" in (a[0], b[0]):
        if a[2] != b[2] or len(a[1]) != len(b[1]):
            return None
        left = paired(a[1], b[1], common)
        return None if left[0] or left[1] else ""
    for one, other in ((a, b), (b, a)):
        if len(one[1]) == 1 and not one[2] and len(other[1]) == 2 and not other[2]:
            x, y = (t for t, _ in other[1])
            return "" if any(edits(one[1][0][0], z, 1) <= 1 for z in (x + y, y + x)) else None
    full_a, full_b = paired(a[1], b[1], common)
    if len(a[1]) - len(full_a) < 2:
        return None
    extra = " ".join(sorted(min(map(code, ms)) for _, ms in full_a + full_b))
    letters_a, letters_b = list(a[2]), list(b[2])
    for letters, full in ((letters_a, full_b), (letters_b, full_a)):
        for x in list(letters):
            hit = next((w for w in full if any(x in initials(n) for n in w[1] | forms.short.get(w[0], set()))), None)
            if hit is not None:
                full.remove(hit)
                letters.remove(x)
    for x in list(letters_a):
        if x in letters_b:
            letters_a.remove(x)
            letters_b.remove(x)
    return None if (full_a or letters_a) and (full_b or letters_b) else extra


def level(kind: str, full: list, rest: list[str]) -> int:
    """How much a name tells: 3 a company or three names, 2 two names and a letter, 1 two names."""
    return 3 if kind == "company" or len(full) > 2 else 2 if rest else 1


def signature(p: tuple[str, list[str], list[str]], name: str) -> str:
    """What equal parses share. A person with fewer than two names in full is known by the name as written: one name and letters link nobody."""
    alone = p[0] == "person" and len(p[1]) < 2
    return "|".join((p[0], " ".join(p[1]), " ".join(p[2]), *([name] if alone else [])))


def written(p: Parsed) -> str:
    """A parse with the forms of its tokens, as it travels to where names are compared."""
    return "|".join((p[0], " ".join("/".join((t, *sorted(ms - {t}))) for t, ms in p[1]), " ".join(p[2])))


def opened(face: str) -> Parsed:
    kind, full, rest = face.split("|")[:3]
    return kind, [(w.split("/")[0], frozenset(w.split("/"))) for w in full.split()], rest.split()


_PARSE = "sig string, kind string, full array<string>, rest array<string>"


def _forms(name_forms: DataFrame) -> Forms:
    rows = name_forms.select("short_form", "full_form", "form_kind").limit(MOST_FORMS + 1).collect()
    if len(rows) > MOST_FORMS:
        raise ValueError(f"more than {MOST_FORMS} short forms")
    return Forms(sorted((r[0] or "", r[1] or "", r[2] or "") for r in rows))


def _attach(edges: DataFrame, weak: DataFrame, up: list[int]) -> DataFrame:
    """Edges and those weak links that lead a cluster to one fuller cluster, or to several that give the same further name; a name that fits different holders joins none."""
    label = components(edges)
    links = weak.where(F.col("low").isin(up))
    for end in ("u", "v"):
        links = links.join(label.select(F.col("vertex").alias(end), F.col("component").alias(f"{end}_c")).hint("merge"), end, "left").withColumn(
            f"{end}_c", F.coalesce(f"{end}_c", end)
        )
    one = (
        links.groupBy("u_c")
        .agg(*(f(c).alias(f"{n}_{c}") for c in ("v_c", "extra") for n, f in (("a", F.min), ("b", F.max))))
        .where("a_v_c = b_v_c OR a_extra = b_extra").select("u_c")
    )
    return edges.unionByName(links.join(one.hint("merge"), "u_c", "left_semi").select("u", "v"))


def _leads(sigs: DataFrame, forms: Forms, shared) -> DataFrame:
    """(kind, token, leads): of each token that may be a slip the more frequent ones, ties by spelling, that it may stand for.

    The words of the tables count as the most frequent of all.
    """
    spark = sigs.sparkSession
    table = [("person", t) for t in sorted({*forms.full, *forms.short})] + [("company", t) for t in sorted(forms.trade)]
    stated = spark.createDataFrame(table, "kind string, token string").withColumn("n", F.lit(1 << 60))
    seen = sigs.select("kind", F.explode(F.array_distinct("full")).alias("token")).groupBy("kind", "token").agg(F.count("*").alias("n"))
    tokens = materialise(seen.unionByName(stated).groupBy("kind", "token").agg(F.max("n").alias("n")))

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(kind, t, n, k) for kind, t, n in frame.itertuples(index=False) for k in token_keys(t)]
            yield pd.DataFrame(rows, columns=["kind", "token", "n", "key"])

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[alike(a, b, kind, shared.value) for kind, a, b in frame.itertuples(index=False)]]

    keys = materialise(tokens.mapInPandas(keyed, "kind string, token string, n bigint, key string").withColumn("key", F.xxhash64("kind", "key")))
    less, more = keys.select("key", "kind", "token", "n"), keys.select("key", F.col("token").alias("lead"), F.col("n").alias("m"))
    near = less.join(more.hint("merge"), "key").where("n < m OR (n = m AND token < lead)")
    pairs = near.where("abs(length(token) - length(lead)) <= 4").select("kind", "token", "lead").distinct()
    found = pairs.mapInPandas(compared, "kind string, token string, lead string")
    return found.groupBy("kind", "token").agg(F.array_sort(F.collect_list("lead")).alias("leads"))  # words a slip away


def _with_faces(sigs: DataFrame, forms: Forms, shared) -> DataFrame:
    """(sig, face, kind): the different parses with the forms their tokens lead to."""
    leads = materialise(_leads(sigs, forms, shared))
    words_ = sigs.select("sig", "kind", F.explode(F.array_distinct("full")).alias("token"))
    known = words_.join(leads, ["kind", "token"]).groupBy("sig").agg(F.map_from_entries(F.collect_list(F.struct("token", "leads"))).alias("leads"))
    joined = sigs.join(known.hint("merge"), "sig", "left")

    @F.pandas_udf("string")
    def face(kind: pd.Series, full: pd.Series, rest: pd.Series, leads: pd.Series) -> pd.Series:
        table = shared.value
        out = []
        for k, f, r, m in zip(kind, full, rest, leads):
            of = dict(m) if m is not None else {}
            out.append(written((k, [(t, meanings(t, k, list(of.get(t, ())), table)) for t in f], list(r))))
        return pd.Series(out)

    return joined.select("sig", face("kind", "full", "rest", "leads").alias("face"))


def link_names(accounts: DataFrame, name_forms: DataFrame, key: str = "account_id", name: str = "name") -> DataFrame:
    """(key, holder): the accounts that name somebody, each with the least key of its holder.

    NULL names, names without letters and placeholders are left out. Rows with a NULL key
    are left out; repeated rows count once. Names that fit several different holders only by
    a left-out or abbreviated part stay on their own.
    """
    forms = _forms(name_forms)
    spark = accounts.sparkSession
    shared = spark.sparkContext.broadcast(forms)  # at most MOST_FORMS rows

    @F.pandas_udf(_PARSE)
    def parsed(names: pd.Series) -> pd.DataFrame:
        table = shared.value
        memo: dict = {}
        out = []
        for n in names:
            if n not in memo:
                p = parse(n, table)
                memo[n] = (None, None, None, None) if p is None else (signature(p, n), *p)
            out.append(memo[n])
        return pd.DataFrame(out, columns=["sig", "kind", "full", "rest"])

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for frame in frames:
            rows = ((s, k[0], k[1:]) for s, f in frame.itertuples(index=False) for k in block_keys(*opened(f), table))
            while part := list(islice(rows, FRAME)):
                yield pd.DataFrame(part, columns=["sig", "role", "block"])

    def widely(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(s, "v", k) for s, f in frame.itertuples(index=False) for k in wide_keys(*opened(f))], columns=["sig", "role", "block"])

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for frame in frames:
            out = []
            for a, face_a, b, face_b in frame.itertuples(index=False):
                x, y = opened(face_a), opened(face_b)
                extra = agree(x, y, table)
                if extra is not None:
                    la, lb = level(*x), level(*y)
                    if len(x[1]) == 1 or len(y[1]) == 1 or x[0] != y[0]:
                        la = lb
                    if la > lb:
                        a, b, la, lb = b, a, lb, la
                    out.append((a, b, la, lb, extra))
            yield pd.DataFrame(out, columns=["u", "v", "low", "high", "extra"])

    rows = materialise(
        accounts.select(F.col(key).alias("key"), parsed(F.col(name)).alias("p")).where("key IS NOT NULL AND p.sig IS NOT NULL").select("key", "p.*")
    )
    sigs = rows.groupBy("sig").agg(F.first("kind").alias("kind"), F.first("full").alias("full"), F.first("rest").alias("rest"))
    faces = materialise(_with_faces(sigs, forms, shared))
    hashed = [F.xxhash64("sig").alias("id"), "role", F.xxhash64("block").alias("block")]
    blocks = materialise(faces.mapInPandas(keyed, "sig string, role string, block string").select(*hashed))
    if not blocks.where("role = 'w'").isEmpty():
        blocks = blocks.unionByName(faces.mapInPandas(widely, "sig string, role string, block string").select(*hashed))
    left = blocks.where("role IN ('=', 'b', 'x', 'j', 'l', 'w')").select("block", "role", F.col("id").alias("a"))
    right = blocks.select("block", F.col("role").alias("role_b"), F.col("id").alias("b"))
    met = "(role = '=' AND role_b = '=' AND a < b) OR (role = 'b' AND (role_b = 't' OR (role_b = 'b' AND a < b))) OR (role = 'x' AND role_b = 'y') OR (role = 'j' AND role_b = 'k') OR (role = 'l' AND (role_b IN ('b', 't') OR (role_b = 'l' AND a < b))) OR (role = 'w' AND role_b = 'v')"
    pairs = left.join(right.hint("merge"), "block").where(met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    named = faces.select(F.xxhash64("sig").alias("id"), "sig", "face")
    both = pairs.join(named.selectExpr("id AS a", "sig AS sig_a", "face AS face_a").hint("merge"), "a").join(named.selectExpr("id AS b", "sig AS sig_b", "face AS face_b").hint("merge"), "b")
    links = materialise(both.select("sig_a", "face_a", "sig_b", "face_b").mapInPandas(compared, "u string, v string, low int, high int, extra string"))
    edges = links.where("low = high").select("u", "v")
    weak = links.where("low < high")
    edges = materialise(_attach(edges, weak.where("high = 3"), [2]))
    edges = materialise(_attach(edges, weak, [1]))
    label = components(edges)
    held = rows.join(label.hint("merge"), rows["sig"] == label["vertex"], "left").select("key", F.coalesce("component", "sig").alias("cluster"))
    least = held.groupBy("cluster").agg(F.min("key").alias("holder"))
    return held.join(least.hint("merge"), "cluster").select("key", "holder").distinct()


def holder_pairs(members: DataFrame, key: str = "account_id") -> DataFrame:
    """(key_1, key_2), smaller first: every pair of accounts of one holder, as the result is defined."""
    a = members.select("holder", F.col("key").alias(f"{key}_1"))
    b = members.select("holder", F.col("key").alias(f"{key}_2"))
    return a.join(b.hint("merge"), "holder").where(F.col(f"{key}_1") < F.col(f"{key}_2")).select(f"{key}_1", f"{key}_2")
