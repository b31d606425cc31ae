"""Documents whose texts look the same but are not the same string."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.codepoints import forms, in_pieces
from ledgerlens.session import materialise

SALTS = 16


def consistent_forms(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form); the form of NULL is NULL, of an empty text empty. Other columns do not travel; repeated rows come out as often."""
    kind = documents.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["_text"].tolist()
            made: list = []
            for piece in in_pieces([x or "" for x in texts]):
                made += [None if x is None else y for x, y in zip(texts[piece], forms([x or "" for x in texts[piece]]))]
            yield pd.DataFrame({key: frame[key], "form": pd.Series(made, dtype=object, index=frame.index)})

    return documents.select(key, F.col(text).alias("_text")).mapInPandas(run, f"{key} {kind}, form string")


def _digest(x: str) -> bytes:
    return hashlib.blake2b(x.encode(), digest_size=16).digest()


def form_digests(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form, text) as 128-bit digests, of the texts that show something."""
    kind = documents.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, texts = frame[key].tolist(), frame["_text"].tolist()
            rows = []
            for piece in in_pieces(texts):
                for i, x, y in zip(ids[piece], texts[piece], forms(texts[piece])):
                    if y.strip():
                        d = _digest(x)
                        rows.append((i, d if x is y or x == y else _digest(y), d))
            yield pd.DataFrame(rows, columns=[key, "form", "string"])

    rows = documents.select(key, F.col(text).alias("_text")).where(f"{key} IS NOT NULL AND _text <> ''")
    return rows.mapInPandas(run, f"{key} {kind}, form binary, string binary")


def same_look_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """(key_1, key_2), smaller first: texts of one form that are different strings.

    NULL, empty and blank texts take no part, nor do rows with a NULL key; repeated rows
    count once. Strings of one form are paired first, whatever number of documents holds
    each; the documents of a string are then spread over salts, so a string of a third of
    all rows is no single task.
    """
    rows = materialise(form_digests(documents, key, text).distinct())
    strings = rows.groupBy("form", "string").agg(F.count("*").alias("n"))
    mixed = strings.groupBy("form").agg(F.count("*").alias("k")).where("k > 1").select("form")
    strings = strings.join(mixed.hint("merge"), "form", "left_semi").select("form", "string")
    two = strings.select("form", F.col("string").alias("s1")).join(strings.select("form", F.col("string").alias("s2")).hint("merge"), "form").where("s1 < s2").select("s1", "s2")
    members = rows.select("string", key).withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    one = two.withColumn("salt", every).join(members.select(F.col("string").alias("s1"), F.col(key).alias("a"), "salt").hint("merge"), ["s1", "salt"]).select("s2", "a")
    both = one.withColumn("salt", every).join(members.select(F.col("string").alias("s2"), F.col(key).alias("b"), "salt").hint("merge"), ["s2", "salt"])
    return both.where("a <> b").select(F.least("a", "b").alias(f"{key}_1"), F.greatest("a", "b").alias(f"{key}_2")).distinct()


def look_classes(documents: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """(key, class_id, n_documents, n_strings): each document that shows something with the least key of its form, and how many documents and different strings the form has.

    Rows with a NULL key are left out; repeated rows count once. The forms are made once.
    Classes are counted from partial counts of their strings; documents are spread over
    salts where they meet their class, so a form of a third of all rows is no single task.
    """
    rows = materialise(form_digests(documents, key, text).distinct())
    strings = rows.groupBy("form", "string").agg(F.min(key).alias("least"))
    documents_of = rows.select("form", key).distinct().groupBy("form").agg(F.count("*").alias("n_documents"))
    classes = strings.groupBy("form").agg(F.min("least").alias("class_id"), F.count("*").alias("n_strings")).join(documents_of.hint("merge"), "form")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    own = rows.select("form", key).distinct().withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    return own.join(classes.withColumn("salt", every).hint("merge"), ["form", "salt"]).select(key, "class_id", "n_documents", "n_strings")
