"""Ids of a whole corpus in a public vocabulary, with the work on shared passages done once.

Texts are cut where a rolling hash of the last ``WINDOW`` bytes has ``CUT_BITS`` zero bits,
so a passage copied into another text is cut alike inside. Chunks are brought together by
digest, each is encoded once, and its ids go back to every place it came from. A chunk is
cut off from its neighbours, so its ids hold only between its first and its last sync
point: a place where the tokenizer's pattern breaks whatever stands around, as before white
space or between a letter and a sign. What lies between the last sync point of a chunk and the first of
the next is encoded anew with the joint in its middle, which makes the whole agree with an
encoding of the whole text exactly.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("TOKENIZER_FILES", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the public pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

WINDOW = 48
CUT_BITS = 9
LEAST, MOST = 128, 16_384

#: Places of a chunk in one task beyond which it is spread over ``SALTS`` groups.
HOT, SALTS = 100, 64

#: White space as the pattern knows it; letters, digits and other signs that all Unicode versions class alike (the apostrophe
#: is none of these: it joins the letters of a contraction).
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER = "A-Za-zÀ-ÖØ-öø-ƿЀ-ҁぁ-ゖァ-ヺ一-龥가-힣"
_OTHER = r"!-&(-/:-@\[-`{-~\u3001\u3002\uff01-\uff0f\uff1a-\uff20"
#: A sync point is behind a sign that no token can hold together with the next one.
SYNC = re.compile(f"[^{_BLANK}](?=[{_BLANK}])|[{_LETTER}](?=[{_OTHER}'0-9])|[0-9](?=[{_LETTER}{_OTHER}'])|[{_OTHER}](?=[{_LETTER}0-9])")
_BASE = 0x9E3779B97F4A7C15
_encoders: dict[bytes, object] = {}


class Vocabulary:
    """The ranks file's bytes, read where the query is planned, and the encoder made of them once per process."""

    def __init__(self, folder: str = TOKENIZERS, name: str = VOCABULARY):
        with open(os.path.join(folder, name), "rb") as file:
            self.ranks = file.read()
        self.mark = hashlib.blake2b(self.ranks, digest_size=8).digest()
        self.width = "<u2" if len(self.ranks.splitlines()) <= 1 << 16 else "<u4"  # of an id between the stages

    def encoder(self):
        made = _encoders.get(self.mark)
        if made is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
            made = _encoders[self.mark] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return made


def _powers(n: int, _kept: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    size = 1 << max(16, n.bit_length())
    if size not in _kept:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _kept.clear()
        _kept[size] = np.cumprod(up), np.cumprod(down)
    return _kept[size]


def cut(text: str) -> list[str]:
    """The chunks of a text, in order; together they are the text.

    Where no cut is found for ``MOST`` signs one is made there, so a text without an end to
    its repetition stays in bounded chunks.
    """
    n = len(text)
    if n <= LEAST:
        return [text]
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points + np.uint64(1)) * up[:n])])
        h = (sums[WINDOW:] - sums[:-WINDOW]) * down[: n - WINDOW + 1]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    marks = np.flatnonzero(h >> np.uint64(64 - CUT_BITS) == 0) + WINDOW
    chunks, at = [], 0
    for m in marks.tolist():
        while m - at > MOST:
            chunks.append(text[at : at + MOST])
            at += MOST
        if m - at >= LEAST and m < n:
            chunks.append(text[at:m])
            at = m
    while n - at > MOST:
        chunks.append(text[at : at + MOST])
        at += MOST
    chunks.append(text[at:])
    return chunks


def split_at_syncs(chunk: str) -> tuple[str, str | None, str]:
    """(before the first sync point, between first and last, after the last); without any: (chunk, None, empty)."""
    first = SYNC.search(chunk)
    if first is None:
        return chunk, None, ""
    y = first.end()
    x = y
    for size in (64, 1024, len(chunk)):
        begin = max(y, len(chunk) - size)
        last = None
        for last in SYNC.finditer(chunk, max(0, begin - 1)):
            pass
        if last is not None:
            x = last.end()
            break
        if begin == y:
            break
    return chunk[:y], chunk[y:x], chunk[x:]


def assemble(pieces, encode) -> np.ndarray:
    """The ids of a text from its chunks' (head, ids of the middle or None, tail), joints encoded anew."""
    out: list = []
    pending = ""
    for head, middle, tail in pieces:
        pending += head
        if middle is None:
            continue
        out += [np.array(encode(pending), dtype=np.int32), middle]
        pending = tail
    if pending:
        out.append(np.array(encode(pending), dtype=np.int32))
    return np.concatenate(out).astype(np.int32, copy=False) if out else np.zeros(0, np.int32)


def _digest(text: str, size: int = 16) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=size).digest()


def encode_corpus(documents: DataFrame, vocabulary: Vocabulary | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of every text, without special tokens; strings that look like special tokens are ordinary text.

    An empty and a NULL text give an empty list. Every row of the input comes out, repeated
    rows and rows with a NULL key too. The corpus is read and cut once. A task sends the
    text of a chunk once and its other places as references of some 50 bytes; a chunk with
    more than ``HOT`` places in a task, as one that a third of all texts share, is spread
    over ``SALTS`` groups by its places, each of which encodes it once.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary or Vocabulary())  # the size of the vocabulary's file
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def typed(made: pd.DataFrame, like: pd.Series) -> pd.DataFrame:
        return made.astype({"key": like.dtype}) if like.dtype != object else made

    def chunked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places: dict[bytes, int] = {}  # of the chunks of a split
        sent: set[tuple[bytes, int]] = set()
        for frame in frames:
            out = []
            for k, t in zip(frame["key"].tolist(), frame["text"].tolist()):
                mark = int.from_bytes(_digest(t, 8), "little", signed=True)
                for i, c in enumerate(cut(t)):
                    d = _digest(c)
                    n = places[d] = places.get(d, 0) + 1
                    salt = 0 if n <= HOT else 1 + n % SALTS
                    new = (d, salt) not in sent
                    if new:
                        sent.add((d, salt))
                    out.append((k, mark, i, d, salt, c if new else None))
            yield typed(pd.DataFrame(out, columns=["key", "mark", "seq", "digest", "salt", "chunk"]), frame["key"])

    def encoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, width = shared.value.encoder().encode_ordinary, shared.value.width
        name, made = None, ("", None, "")
        for frame in frames:
            out = []
            for digest, salt, chunk in zip(frame["digest"].tolist(), frame["salt"].tolist(), frame["chunk"].tolist()):
                if (digest, salt) != name:  # its text comes first
                    head, middle, tail = split_at_syncs(chunk)
                    made = head, None if middle is None else np.array(encode(middle), dtype=width).tobytes(), tail
                    name = digest, salt
                out.append(made)
            yield frame[["key", "mark", "seq"]].join(pd.DataFrame(out, columns=["head", "middle", "tail"], index=frame.index))

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, width = shared.value.encoder().encode_ordinary, shared.value.width
        name, pieces, copies = None, [], 0

        def finish():
            ids = assemble([(h, None if m is None else np.frombuffer(m, width), t) for h, m, t in pieces], encode)
            return [(None if pd.isna(name[0]) else name[0], ids)] * copies

        for frame in frames:
            out = []
            for k, mark, seq, head, middle, tail in zip(*(frame[c].tolist() for c in ("key", "mark", "seq", "head", "middle", "tail"))):
                this = (k, mark)
                if name is None or (this != name and not (mark == name[1] and pd.isna(k) and pd.isna(name[0]))):
                    if name is not None:
                        out += finish()
                    name, pieces, copies = this, [], 0
                if seq == len(pieces):  # a repeated row repeats every piece
                    pieces.append((head, middle, tail))
                if seq == 0:
                    copies += 1
            yield pd.DataFrame(out, columns=["key", "ids"])
        if name is not None:
            yield pd.DataFrame(finish(), columns=["key", "ids"])

    cuts = rows.mapInPandas(chunked, f"key {kind}, mark bigint, seq int, digest binary, salt int, chunk string")
    together = cuts.repartition("digest", "salt").sortWithinPartitions("digest", "salt", F.col("chunk").isNull())
    pieces = together.mapInPandas(encoded, f"key {kind}, mark bigint, seq int, head string, middle binary, tail string")
    ids = pieces.repartition("key", "mark").sortWithinPartitions("key", "mark", "seq").mapInPandas(whole, f"key {kind}, ids array<int>")
    return ids.withColumnRenamed("key", key)
