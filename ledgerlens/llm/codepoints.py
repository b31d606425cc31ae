"""One consistent form of texts, by which texts that look the same are equal.

Texts are exploded into a column of positioned code points (one array per Arrow batch, the
position being the index and the document a parallel array). Decompositions and
look-alikes are joined from broadcast tables, combining marks are ordered by class and
recomposed, and the strings are rebuilt. The explosion stays inside the batch: a row per
character would multiply the corpus by its length before the first shuffle, for nothing
that crosses a document.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import regex

# Letters and signs drawn like another in the same weight, script by script: what stands for the sign, and the
# signs that look like it. Left out is whatever a reader can tell: a missing dot or stroke, another height, small capitals
# of letters that have another small form, bold, raised and circled letters.
LOOK_ALIKES = {
    "latin": ("acgosuvwz|!", "ɑᴄɡᴏꜱᴜᴠᴡᴢǀǃ"),
    "roman numerals": ("cdilmvxCDILMVX", "ⅽⅾⅰⅼⅿⅴⅹⅭⅮⅠⅬⅯⅤⅩ"),
    "greek": ("copvjABCEHIJKMNOPTXYZμ", "ϲορνϳΑΒϹΕΗΙͿΚΜΝΟΡΤΧΥΖµ"),
    "cyrillic": ("acdehijlopqsvwxyyABCEGHIIJKMOPQSTVWXY", "асԁеһіјӏорԛѕѵԝхуүАВСЕԌНІӀЈКМОРԚЅТѴԜХҮ"),
    "armenian": ("ghnoquOSU:", "ցհոօզսՕՏՍ։"),
    "coptic": ("copBHIKMNOPCTYX", "ⲥⲟⲣⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬ"),
    "cherokee": ("bdhiABCDEGGHJKLMPRRSSTVWWYYZ", "ᏏᏧᏂᎥᎪᏴᏟᎠᎬᏀᏳᎻᎫᏦᏞᎷᏢᎡᏒᏕᏚᎢᏙᎳᏔᎩᎽᏃ"),
    "lisu": ("ABCDEFGHIJKLMNOPRSTUVWXYZ", "ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ"),
    "signs": ("--.::/\\|’", "‐‑․∶꞉∕∖∣ʼ"),
}
INVISIBLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x2060, 0x2064),
    (0x206A, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
#: Blanks that are drawn as something, and so are no blanks.
DRAWN_BLANKS = {0x1680}
TAG_BASE, ZWNJ, ZWJ, VS15, VS16 = 0x1F3F4, 0x200C, 0x200D, 0xFE0E, 0xFE0F

SIZE = 0x110000
_PICTURE = regex.compile(r"\p{Extended_Pictographic}")
_EMOJI_STYLE = regex.compile(r"\p{Emoji_Presentation}")
_JOINING = regex.compile(r"\p{Joining_Type=Dual_Joining}|\p{Joining_Type=Right_Joining}|\p{Script=Arabic}")


class Tables:
    """What is joined to each code point: its class, whether it may vanish, and its decomposition with look-alikes replaced."""

    def __init__(self) -> None:
        plain = {ord(x): ord(k) for plain, alike in LOOK_ALIKES.values() for k, x in zip(plain, alike, strict=True)}
        self.may_vanish = np.zeros(SIZE, dtype=bool)
        for low, high in INVISIBLE:
            self.may_vanish[low : high + 1] = True
        self.to = np.arange(SIZE, dtype=np.uint32)  # of a decomposition into several: its number
        self.several = np.zeros(SIZE, dtype=bool)
        self.combining = np.zeros(SIZE, dtype=np.uint8)
        self.second = np.zeros(SIZE, dtype=bool)  # can follow its starter into one sign
        self.pairs: dict[tuple[int, int], int] = {}
        pieces: list[list[int]] = []

        def single(c: int) -> int:
            tag, _, rest = unicodedata.decomposition(chr(c)).partition(" ")
            if tag in ("<wide>", "<narrow>"):
                c = int(rest, 16)
            if unicodedata.category(chr(c)) == "Zs" and c not in DRAWN_BLANKS:
                return 0x20
            return plain.get(c, c)

        for c in range(0x80, 0x30000):
            ch = chr(c)
            self.combining[c] = unicodedata.combining(ch)
            if 0xD800 <= c < 0xE000:
                continue
            parts = [ord(y) for x in unicodedata.normalize("NFD", ch) for y in unicodedata.normalize("NFD", chr(single(ord(x))))]
            parts = [plain.get(x, x) for x in parts]
            if len(parts) > 1:
                self.several[c] = True
                self.to[c] = len(pieces)
                pieces.append(parts)
            elif parts[0] != c:
                self.to[c] = parts[0]
            two = unicodedata.decomposition(ch)
            if two and two[0] != "<" and " " in two and unicodedata.normalize("NFC", ch) == ch:
                a, b = (int(x, 16) for x in two.split())
                self.pairs[a, b] = c
                self.second[b] = True
        self.second[0x1161:0x1176] = True
        self.second[0x11A8:0x11C3] = True
        self.second |= self.combining > 0
        self.length = np.array([len(p) for p in pieces], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64)
        self.pieces = np.array([x for p in pieces for x in p], dtype=np.uint32)

    def compose(self, a: int, b: int) -> int | None:
        if 0x1100 <= a < 0x1113 and 0x1161 <= b < 0x1176:
            return 0xAC00 + ((a - 0x1100) * 21 + (b - 0x1161)) * 28
        if 0xAC00 <= a < 0xD7A4 and (a - 0xAC00) % 28 == 0 and 0x11A8 <= b < 0x11C3:
            return a + b - 0x11A7
        return self.pairs.get((a, b))

    def recompose(self, run: tuple[int, ...]) -> list[int]:
        """A starter and what follows it, marks already in order: each that is not blocked and has a composite joins the starter."""
        out = [run[0]]
        at, last = 0, 0
        for x in run[1:]:
            cls = int(self.combining[x])
            free = (last == 0 and len(out) - 1 == at) or (cls > last and cls > 0)
            joined = self.compose(out[at], x) if free else None
            if joined is not None:
                out[at] = joined
                continue
            out.append(x)
            last = cls
            if cls == 0:
                at, last = len(out) - 1, 0
        return out


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def explode(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, document of each), in order of document and position."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    return points, np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def rebuild(points: np.ndarray, document: np.ndarray, n: int) -> list[str]:
    whole = points.astype("<u4").tobytes().decode("utf-32-le")
    ends = np.cumsum(np.bincount(document, minlength=n))
    return [whole[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


@lru_cache(1 << 16)
def _joins(c: int) -> bool:
    return bool(_JOINING.match(chr(c)))


@lru_cache(1 << 16)
def _is_picture(c: int) -> bool:
    return c > 0x7F and bool(_PICTURE.match(chr(c)))


def _shown(points: np.ndarray, document: np.ndarray, t: Tables) -> np.ndarray:
    """False where a code point is invisible in its place.

    Joiners stay where they change what is drawn (between emoji, after a virama, a
    non-joiner between joining letters), style selectors where they change the style of an
    emoji, tags after the flag they belong to. One pass over the signs that can go either
    way: the nearest sign that shows is known on both sides of each.
    """
    keep = ~t.may_vanish[points]
    n = len(points)
    at = np.arange(n)
    begins = np.flatnonzero(np.diff(document, prepend=-1))
    first = begins[np.searchsorted(begins, at, "right") - 1] if n else at
    before = np.maximum.accumulate(np.where(keep, at, -1)) if n else at
    after = np.minimum.accumulate(np.where(keep, at, n)[::-1])[::-1] if n else at
    open_ones = np.flatnonzero(~keep & (np.isin(points, (ZWNJ, ZWJ, VS15, VS16)) | ((points >= 0xE0020) & (points <= 0xE007F))))
    held = -1  # the last of them that stays
    for i, c, begin, p, q in zip(*(x.tolist() for x in (open_ones, points[open_ones], first[open_ones], before[open_ones], after[open_ones]))):
        p = max(p, held)
        if p < begin:
            continue
        left = int(points[p])
        right = int(points[q]) if q < n and document[q] == document[i] else None
        if c in (VS15, VS16):
            colourful = bool(_EMOJI_STYLE.match(chr(left)))
            stays = left > 0x7F and p == i - 1 and (colourful if c == VS15 else not colourful and _is_picture(left))
        elif c in (ZWNJ, ZWJ):
            base = int(points[p - 1]) if left in (VS15, VS16) and p > begin else left
            if t.combining[left] == 9:
                stays = right is not None and unicodedata.category(chr(right))[0] == "L"
            elif c == ZWJ:
                stays = right is not None and (_is_picture(base) or 0x1F3FB <= base <= 0x1F3FF) and _is_picture(right)
            else:
                stays = right is not None and _joins(left) and _joins(right)
        else:
            stays = left == TAG_BASE or 0xE0020 <= left <= 0xE007F
        if stays:
            keep[i] = True
            held = i
    return keep


def _expand(points: np.ndarray, document: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Each code point replaced by its decomposition, look-alikes replaced."""
    to, several = t.to[points], t.several[points]
    if not several.any():
        return to, document
    count = np.ones(len(points), dtype=np.int64)
    count[several] = t.length[to[several]]
    at = np.cumsum(count) - count
    out = np.repeat(to, count)
    inner = np.arange(len(out)) - np.repeat(at, count)
    wide = np.repeat(several, count)
    out[wide] = t.pieces[t.start[out[wide]] + inner[wide]]
    return out, np.repeat(document, count)


def _compose(points: np.ndarray, document: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Combining marks ordered by class behind their starter, then recomposed."""
    follows = t.second[points]
    if len(points):
        follows = follows & (np.diff(document, prepend=-1) == 0)
    if not follows.any():
        return points, document
    run = np.cumsum(~follows) - 1
    cls = t.combining[points]
    # marks move only between two neighbours of class 0
    block = np.cumsum(cls == 0)
    order = np.lexsort((np.arange(len(points)), cls, block, run)) if (cls > 0).any() else np.arange(len(points))
    points = points[order]
    begins = np.flatnonzero(~follows)
    ends = np.append(begins[1:], len(points))
    busy = np.flatnonzero(ends - begins > 1)
    memo: dict[tuple[int, ...], list[int]] = {}
    keep = np.ones(len(points), dtype=bool)
    out = points.copy()
    for b, e in zip(begins[busy].tolist(), ends[busy].tolist()):
        signs = tuple(points[b:e].tolist())
        made = memo.get(signs)
        if made is None:
            made = memo[signs] = t.recompose(signs)
        out[b : b + len(made)] = made
        keep[b + len(made) : e] = False
    return out[keep], document[keep]


def forms(texts: Sequence[str]) -> list[str]:
    """The form of each text. Line ends, tabs and the number of blanks stay; case, accents and raised, circled or joined signs do too."""
    out = list(texts)
    strange = [i for i, x in enumerate(out) if not x.isascii()]  # an ASCII text is its own form
    if strange:
        t = tables()
        points, document = explode([out[i] for i in strange])
        keep = _shown(points, document, t)
        points, document = _expand(points[keep], document[keep], t)
        points, document = _compose(points, document, t)
        for i, x in zip(strange, rebuild(points, document, len(strange))):
            out[i] = x
    return out


def in_pieces(texts: Sequence[str], most: int = 2_000_000):
    """Slices of a batch whose texts hold about ``most`` characters together; a longer text is a slice of its own."""
    begin, held = 0, 0
    for i, x in enumerate(texts):
        if held and held + len(x) > most:
            yield slice(begin, i)
            begin, held = i, 0
        held += len(x)
    if begin < len(texts):
        yield slice(begin, len(texts))


assert sys.maxunicode == SIZE - 1
