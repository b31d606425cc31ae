"""Evaluation passages inside a corpus, by greedy string tiling.

Words of all documents are hashed as columns; Karp-Rabin hashes over windows of ``SEED``
and of ``RUN`` words are joined with those of the protected passages, each hash of a text
once, however often it is repeated there. Pairs that share enough are tiled: the longest match of
unmarked words, found by running Karp-Rabin over window lengths, is marked, again and again,
until none of ``SEED`` words is left, which finds passages in any order of their parts.

Passages up to ``BLOCK_CHARS`` characters together are sent to every task, and the corpus
is scanned once without a shuffle. Beyond that the hashes are joined by a shuffle and only
the pairs that share enough meet their texts again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.codepoints import SIZE, explode, forms, in_pieces

SEED = 5
RUN = 12
COVERAGE = 0.8
#: Characters of protected passages up to which they are sent to every task.
BLOCK_CHARS = 8_000_000

_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _inverse(x: np.uint64) -> np.uint64:
    return np.uint64(pow(int(x), -1, 1 << 64))


@lru_cache(4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, base, dtype=np.uint64), np.full(n, _inverse(np.uint64(base)), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _sized(n: int) -> int:
    return 1 << max(20, int(n).bit_length())


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: whether it is a letter or a digit, and its lower case."""
    inside, lower = np.zeros(SIZE, dtype=bool), np.arange(SIZE, dtype=np.uint32)
    for c in range(0x40000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        inside[c] = unicodedata.category(ch)[0] == "L" or unicodedata.category(ch) == "Nd"
        small = ch.lower()
        if len(small) == 1:
            lower[c] = ord(small)
    return inside, lower


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word, in order: the longest runs of letters and digits of the text's form, in lower case."""
    points, owner = explode([x + "\n" for x in forms(texts)])
    inside, lower = _letters()
    word = inside[points]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(int(_BASE), _sized(len(points)))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((lower[points].astype(np.uint64) + np.uint64(1)) * up[: len(points)])])
        h = (sums[end] - sums[start]) * down[start]
        return _mix(h + (end - start).astype(np.uint64) * _STEP), owner[start] if len(start) else np.zeros(0, dtype=int)


def windows(words: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every window of k words within one text."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, int)
    up, down = _powers(int(_STEP), _sized(len(words)))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])])
        h = _mix((sums[k:] - sums[:-k])[:n] * down[:n])
    first = np.flatnonzero(owner[:n] == owner[k - 1 :])
    return h[first], first


class Shared:
    """Hashes of the windows of k words of all passages: sorted, each with the passages it is in and the number of its places there."""

    def __init__(self, words: np.ndarray, owner: np.ndarray, k: int):
        hashes, first = windows(words, owner, k)
        passage = owner[first] if len(first) else first
        order = np.lexsort((passage, hashes))
        hashes, passage = hashes[order], passage[order]
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (passage[1:] != passage[:-1])
        at = np.flatnonzero(new)
        self.weight = np.diff(np.append(at, len(hashes)))
        self.passage = passage[at]
        self.known, start = np.unique(hashes[at], return_index=True)
        self.start = np.append(start, len(at))

    def meet(self, hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, passage, places in the passage) for each different hash that a text and a passage share."""
        if not len(hashes) or not len(self.known):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        hit = self.known[at] == hashes
        both = np.unique(text[hit].astype(np.int64) * len(self.known) + at[hit])
        text, at = both // len(self.known), both % len(self.known)
        count = self.start[at + 1] - self.start[at]
        row = np.repeat(self.start[at], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(text, count), self.passage[row], self.weight[row]


class Passages:
    """The protected passages: their words, and which windows of ``SEED`` and of ``RUN`` words they have."""

    def __init__(self, rows: list[tuple]):
        self.names, texts = [], []
        for item, prompt, answer in rows:
            for part, text in (("prompt", prompt), ("answer", answer)):
                if text:
                    self.names.append((item, part))
                    texts.append(text)
        words, owner = word_hashes(texts) if texts else (np.zeros(0, np.uint64), np.zeros(0, int))
        ends = np.cumsum(np.bincount(owner, minlength=len(texts))) if texts else np.zeros(0, int)
        begins = np.concatenate([[0], ends[:-1]]).astype(int) if len(ends) else ends
        self.words = [words[b:e] for b, e in zip(begins, ends)]
        self.size = ends - begins
        self.seeds, self.runs = Shared(words, owner, SEED), Shared(words, owner, RUN)


class _Side:
    """Words of one side of a tiling, marked or not, and the hashes of its unmarked windows of any length."""

    def __init__(self, words: np.ndarray, marked: np.ndarray):
        self.words, self.marked = words, marked
        self.until = np.zeros(len(words), dtype=np.int64)  # of a marked word: where its tile ends
        up, self.down = _powers(int(_STEP), _sized(len(words)))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])])
        self.count()

    def count(self) -> None:
        self.before = np.concatenate([[0], np.cumsum(self.marked)])

    def free(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of the windows of k unmarked words."""
        n = len(self.words) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, int)
        first = np.flatnonzero(self.before[k:] == self.before[:-k])
        with np.errstate(over="ignore"):
            return (self.sums[first + k] - self.sums[first]) * self.down[first], first

    def mark(self, first: int, k: int) -> None:
        self.marked[first : first + k] = True
        self.until[first : first + k] = first + k


def _is_in(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(hashes), dtype=bool)
    known = np.unique(known)
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    return known[at] == hashes


def _level(d: _Side, p: _Side, k: int) -> list[tuple[int, int]]:
    """Mark matches of k unmarked words, by place in the passage, then in the document; (document word, passage word) of each."""
    hashes, first = d.free(k)
    order = np.argsort(hashes, kind="stable")
    hashes, first = hashes[order], first[order]
    wanted, places = p.free(k)
    low, high = np.searchsorted(hashes, wanted, "left"), np.searchsorted(hashes, wanted, "right")
    at: dict[int, int] = {}  # of a hash's places in the document, the first that may be free: marks only grow
    out = []
    for j, a, b in zip(places[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist()):
        if p.marked[j] or p.marked[j + k - 1]:  # all tiles of this level are k words long
            continue
        x = at.get(a, a)
        while x < b:
            i = int(first[x])
            taken = i if d.marked[i] else i + k - 1 if d.marked[i + k - 1] else None
            if taken is not None:
                x += int(np.searchsorted(first[x:b], d.until[taken]))
            elif (d.words[i : i + k] == p.words[j : j + k]).all():
                d.mark(i, k)
                p.mark(j, k)
                out.append((i, j))
                break
            else:
                x += 1
        at[a] = x
    d.count()
    p.count()
    return out


def tile(document: np.ndarray, passage: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (document word, passage word, length) of the tiles, longest first; ties by passage, then document order.

    Only words in windows of ``least`` words that both have are looked at again. The length
    of the longest match is searched by halving: where k unmarked words agree, so do k - 1.
    There are at most as many different lengths as add up to the passage.
    """
    document, passage = document.astype(np.uint64, copy=False), passage.astype(np.uint64, copy=False)
    seeds, _ = windows(document, np.zeros(len(document), dtype=int), least)
    hit = np.flatnonzero(_is_in(seeds, windows(passage, np.zeros(len(passage), dtype=int), least)[0]))
    if not len(hit):
        return []
    edge = np.bincount(hit, minlength=len(document) + 1)[: len(document) + 1] - np.bincount(hit + least, minlength=len(document) + 1)[: len(document) + 1]
    origin = np.flatnonzero(np.cumsum(edge)[: len(document)])
    stops = np.flatnonzero(np.diff(origin) > 1) + 1  # a word that matches nothing stands for what is left out
    words, origin = np.insert(document[origin], stops, 0), np.insert(origin, stops, -1)
    d, p = _Side(words, origin < 0), _Side(passage, np.zeros(len(passage), dtype=bool))
    tiles, most = [], min(len(words), len(passage))

    def agree(k: int) -> bool:
        return bool(_is_in(d.free(k)[0], p.free(k)[0]).any())

    while most >= least and agree(least):
        low, high = least, most
        while low < high:
            k = (low + high + 1) // 2
            if agree(k):
                low = k
            else:
                high = k - 1
        tiles += [(int(origin[i]), j, low) for i, j in _level(d, p, low)]
        most = low - 1
    return tiles


def _candidates(words: np.ndarray, owner: np.ndarray, table: Passages, longest: bool) -> list[tuple[int, int]]:
    """(text, passage) of the pairs that share a window of ``RUN`` words or (not with longest) seeds at so many places of the passage that they can cover ``COVERAGE`` of it."""
    many = len(table.words)

    def windows_of(k: int) -> tuple[np.ndarray, np.ndarray]:
        hashes, first = windows(words, owner, k)
        return hashes, owner[first] if len(first) else first

    text, passage, _ = table.runs.meet(*windows_of(RUN))
    found = np.unique(text * many + passage)
    if not longest:
        text, passage, places = table.seeds.meet(*windows_of(SEED))
        pair, at = np.unique(text * many + passage, return_inverse=True)
        enough = np.bincount(at, weights=places, minlength=len(pair)) * SEED >= COVERAGE * table.size[pair % many] if len(pair) else []
        found = np.union1d(found, pair[enough])
    return [(int(x) // many, int(x) % many) for x in found]


def _measures(tiles: list[tuple[int, int, int]], passage: np.ndarray) -> tuple[int, int, int, float]:
    covered = sum(t[2] for t in tiles)
    return len(tiles), max(t[2] for t in tiles), covered, covered / len(passage)


def _tiled(texts: list[str], table: Passages, longest: bool) -> Iterator[tuple[int, object, str, int, int, int, float]]:
    """(text, item, part, tiles, longest tile, words covered, coverage) of the candidates."""
    words, owner = word_hashes(texts)
    begin = np.searchsorted(owner, np.arange(len(texts) + 1))
    for text, p in _candidates(words, owner, table, longest):
        tiles = tile(words[begin[text] : begin[text + 1]], table.words[p])
        if tiles:
            yield text, *table.names[p], *_measures(tiles, table.words[p])


_MEASURES = "part string, n_tiles int, longest int, covered int, coverage double"
_COLUMNS = ["doc_id", "item_id", "part", "n_tiles", "longest", "covered", "coverage"]


def _sent(documents: DataFrame, rows: DataFrame, kinds: str, longest_only: bool) -> DataFrame:
    """Passages of bounded size are sent to every task."""
    table = documents.sparkSession.sparkContext.broadcast(Passages(sorted(map(tuple, rows.collect()), key=str)))  # at most BLOCK_CHARS characters

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, texts = frame["doc_id"].tolist(), frame["text"].tolist()
            for piece in in_pieces(texts, 1_000_000):
                found = [(ids[piece][t], *rest) for t, *rest in _tiled(texts[piece], table.value, longest_only)]
                yield pd.DataFrame(found, columns=_COLUMNS)

    return documents.mapInPandas(run, f"{kinds}, {_MEASURES}")


def _window_rows(texts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, hash, places, n_words): each window of k words of each text once."""
    ddl = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held = frame["text"].tolist()
            for piece in in_pieces(held, 1_000_000):
                words, owner = word_hashes(held[piece])
                hashes, first = windows(words, owner, k)
                own = owner[first] if len(first) else first
                rows = pd.DataFrame({"_row": own, "hash": hashes.view(np.int64)}).value_counts(sort=False).rename("places").reset_index()
                out = frame.iloc[piece][keys].iloc[rows["_row"]].reset_index(drop=True)
                sizes = np.bincount(owner, minlength=piece.stop - piece.start)
                yield out.assign(hash=rows["hash"].to_numpy(), places=rows["places"].to_numpy(), n_words=sizes[rows["_row"]])

    return texts.select(*keys, "text").mapInPandas(run, f"{ddl}, hash bigint, places int, n_words int")


def _joined(documents: DataFrame, rows: DataFrame, kinds: str, longest_only: bool) -> DataFrame:
    """Passages of any size: hashes meet in a shuffle, pairs that share enough meet their texts."""
    parts = F.inline(F.array(*(F.struct(F.lit(x).alias("part"), F.col(x).alias("text")) for x in ("prompt", "answer"))))
    passages = rows.distinct().select("item_id", parts).where("text <> ''")
    of = ["doc_id", "item_id", "part"]

    def met(k: int) -> DataFrame:
        own = _window_rows(documents, ["doc_id"], k).select("doc_id", "hash").distinct()
        return own.join(_window_rows(passages, ["item_id", "part"], k), "hash")

    pairs = met(RUN).select(*of)
    if not longest_only:
        seeds = met(SEED).groupBy(*of).agg(F.sum("places").alias("places"), F.max("n_words").alias("n_words"))
        pairs = pairs.unionByName(seeds.where(F.col("places") * SEED >= COVERAGE * F.col("n_words")).select(*of))
    both = documents.join(pairs.distinct(), "doc_id").join(passages.withColumnRenamed("text", "passage"), ["item_id", "part"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, item, part, text, passage in zip(*(frame[c].tolist() for c in (*of, "text", "passage"))):
                words = word_hashes([passage])[0]
                tiles = tile(word_hashes([text])[0], words)
                if tiles:
                    out.append((doc, item, part, *_measures(tiles, words)))
            yield pd.DataFrame(out, columns=_COLUMNS)

    return both.select(*of, "text", "passage").mapInPandas(run, f"{kinds}, {_MEASURES}")


def leaks(documents: DataFrame, items: DataFrame, longest_only: bool = False) -> DataFrame:
    """(doc_id, item_id, part, n_tiles, longest, covered, coverage): documents that hold ``RUN`` words of a prompt or answer in one piece, or ``COVERAGE`` of it in pieces of at least ``SEED`` words in any order.

    longest_only leaves out the second kind. NULL, empty and blank texts and passages match
    nothing; a passage of fewer than ``SEED`` words cannot match. Rows with a NULL doc_id or
    item_id are left out; repeated documents come out as often as they are there, repeated
    items once.
    """
    rows = items.select("item_id", "prompt", "answer").where("item_id IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.coalesce(F.length("prompt"), F.lit(0)) + F.coalesce(F.length("answer"), F.lit(0)))).first()[0] or 0
    kinds = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}"
    texts = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text <> ''")
    out = (_sent if size <= BLOCK_CHARS else _joined)(texts, rows, kinds, longest_only)
    return out.where((F.col("longest") >= RUN) | (F.lit(not longest_only) & (F.col("coverage") >= COVERAGE)))


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id), each once: the documents with at least ``RUN`` consecutive words of a prompt or an answer."""
    return leaks(documents, items, longest_only=True).select("doc_id", "item_id").distinct()
