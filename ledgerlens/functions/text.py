"""Entities of report narratives, extractive summaries and how faithful a summary is, as columns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of entities (with the group taken), weights of their kinds, grades.
ACCOUNT_PATTERNS = ((r"[Aa]ccount\s*(?:#|no\.?|number)?\s*([A-Za-z0-9]+)", 1), (r"\b(NP\d{3,})\b", 1), (r"\b(A\d+)\b", 1))
AMOUNT_PATTERNS = (
    (r"(?i)(?:NPR|USD|EUR|GBP|\$|€|£)\s*[\d,]+(?:\.\d+)?(?:\s*(?:K|M|B|million|billion|thousand))?", 0),
    (r"(?i)[\d,]+(?:\.\d+)?\s*(?:K|M|B|million|billion|thousand)\s*(?:NPR|USD|EUR|GBP)?", 0),
)
DATE_PATTERNS = (
    (r"\d{4}-\d{2}-\d{2}", 0), (r"\d{1,2}/\d{1,2}/\d{4}", 0),
    (r"(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}(?:,?\s*\d{4})?", 0),
)
WEIGHTS = {"amounts": 3.0, "accounts": 2.0, "dates": 1.5, "parties": 1.0}
GRADES = (("A", 90.0), ("B", 70.0), ("C", 50.0))
FAITHFUL = 95.0


def _found(text: Column, patterns) -> Column:
    return F.array_distinct(F.concat(*(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(g)), lambda x: F.trim(x)) for p, g in patterns)))


def accounts_in(text: Column) -> Column:
    """Account numbers in order of pattern and place, each once."""
    return _found(text, ACCOUNT_PATTERNS)


def amounts_in(text: Column) -> Column:
    return _found(text, AMOUNT_PATTERNS)


def dates_in(text: Column) -> Column:
    return _found(text, DATE_PATTERNS)


def entities(df: DataFrame, text: str) -> DataFrame:
    """df with accounts, amounts, dates (arrays; empty for NULL text) and parties, jurisdictions (empty: no name recogniser is at hand)."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    return df.withColumns({"accounts": accounts_in(t), "amounts": amounts_in(t), "dates": dates_in(t), "parties": none, "jurisdictions": none})


def amount_value(text: Column) -> Column:
    """The amount as a number: currency and commas off, K, M or B applied; NULL where it is none. Words such as million are not understood."""
    s = F.regexp_replace(F.regexp_replace(F.upper(F.trim(text)), r"(NPR|USD|EUR|GBP|\$|€|£)\s*", ""), ",", "")
    factor = F.when(s.endswith("K"), 1e3).when(s.endswith("M"), 1e6).when(s.endswith("B"), 1e9)
    digits = F.when(factor.isNotNull(), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)
    return F.when(digits.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$"), F.trim(digits).try_cast("double") * F.coalesce(factor, F.lit(1.0)))


def date_parts(text: Column) -> Column:
    """struct(year, month, day) of the first year-month-day or, failing that, day/month/year; NULL without one."""
    iso, slash = r"(\d{4})-(\d{2})-(\d{2})", r"(\d{1,2})/(\d{1,2})/(\d{4})"

    def part(p: str, g: int) -> Column:
        return F.regexp_extract(text, p, g).try_cast("int")

    def parts(p: str, *groups: int) -> Column:
        return F.struct(*(part(p, g).alias(n) for g, n in zip(groups, ("year", "month", "day"))))

    return F.when(text.rlike(iso), parts(iso, 1, 2, 3)).when(text.rlike(slash), parts(slash, 3, 2, 1))


def summary(df: DataFrame, text: str, context: str = "", sentences: int = 3, out: str = "summary") -> DataFrame:
    """df with the sentences that hold most entities, best first, ties in order of place. Needs the columns of ``entities``."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\."), lambda s: F.trim(s)), lambda s: s != "")
    every = F.concat("accounts", "amounts", "dates", "parties", "jurisdictions")
    scored = F.transform(parts, lambda s, i: F.struct((-F.size(F.filter(every, lambda e: F.contains(F.lower(s), F.lower(e))))).alias("n"), i.alias("i"), s.alias("s")))
    best = F.transform(F.slice(F.array_sort(scored), 1, sentences), lambda x: x["s"])
    return df.withColumn(out, F.concat(F.lit(f"[{context}] " if context else ""), F.array_join(best, ". "), F.lit(".")))


def _stretches(entity: str, text: str, least: float) -> Iterator[str]:
    """The stretches of the entity's length that share enough letters with it to be as alike as ``least``: the count of shared letters moves on with the window and bounds the likeness from above."""
    n = len(entity)
    lack = Counter(entity)  # of each letter what the window is short of; below zero what it has too many
    shared = 0
    for i, x in enumerate(text):
        shared += lack[x] > 0
        lack[x] -= 1
        if i >= n:
            y = text[i - n]
            lack[y] += 1
            shared -= lack[y] > 0
        if i >= n - 1 and shared >= least * n:
            yield text[i - n + 1 : i + 1]


@F.pandas_udf(T.BooleanType())
def _similar(entity: pd.Series, text: pd.Series, threshold: pd.Series) -> pd.Series:
    def one(e: str | None, t: str | None, least: float) -> bool:
        return bool(e) and bool(t) and any(SequenceMatcher(None, e, w).ratio() >= least for w in _stretches(e, t, least))

    return pd.Series([one(*x) for x in zip(entity, text, threshold)])


def similar(entity: Column, text: Column, threshold: float = 0.75) -> Column:
    """Whether the entity stands in the text, or a stretch of its length is as alike; FALSE for NULL. Only rows without the entity as it is go to Python, for the one comparison built-in functions cannot make."""
    e, t = F.lower(entity), F.lower(text)
    stands = F.coalesce(F.contains(t, e), F.lit(False))
    return stands | F.coalesce(_similar(F.when(~stands, e), F.when(~stands, t), F.lit(threshold)), F.lit(False))


def faithfulness(df: DataFrame, summary_text: str = "summary") -> DataFrame:
    """df with faithfulness (0..100, 100 without entities), grade and faithful: which entities of the narrative the summary keeps, by weight of their kind."""
    s, low = F.coalesce(F.col(summary_text), F.lit("")), F.lower(F.coalesce(F.col(summary_text), F.lit("")))
    numbers = F.transform(F.regexp_extract_all(s, F.lit(r"[\d,]+\.?\d*[KMBkmb]?"), F.lit(0)), amount_value)

    def kept_amount(a: Column) -> Column:
        v = amount_value(a)
        close = F.exists(numbers, lambda x: x.isNotNull() & (F.abs(x - v) / F.greatest(v, F.lit(1.0)) < 0.01))
        return F.contains(low, F.lower(a)) | F.coalesce(v.isNotNull() & close, F.lit(False))

    def kept_date(d: Column) -> Column:
        p = date_parts(d)
        return F.contains(low, F.lower(d)) | F.coalesce(F.contains(s, p["year"].cast("string")) & F.contains(s, p["day"].cast("string")), F.lit(False))

    kept = {
        "amounts": F.size(F.filter("amounts", kept_amount)), "accounts": F.size(F.filter("accounts", lambda a: F.contains(low, F.lower(a)))),
        "dates": F.size(F.filter("dates", kept_date)), "parties": F.size(F.filter("parties", lambda p: F.contains(low, F.lower(p)))),
    }
    total = sum((w * F.size(k) for k, w in WEIGHTS.items()), F.lit(0.0))
    got = sum((w * kept[k] for k, w in WEIGHTS.items()), F.lit(0.0))
    out = df.withColumn("faithfulness", F.when(total > 0, got / F.when(total > 0, total) * 100).otherwise(100.0))
    grade = F.lit("F")
    for name, least in reversed(GRADES):
        grade = F.when(F.col("faithfulness") >= least, name).otherwise(grade)
    return out.withColumn("grade", grade).withColumn("faithful", F.col("faithfulness") >= FAITHFUL)


def case_report(columns: dict[str, str]) -> Column:
    """A Markdown report of one row: a line for each label and column."""
    return F.concat_ws("\n", F.lit("# Case report"), *(F.concat(F.lit(f"- **{label}**: "), F.coalesce(F.col(c).cast("string"), F.lit("unknown"))) for label, c in columns.items()))


