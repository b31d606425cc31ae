"""Queries of the operators of this subpackage, with the SQL that must agree where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.encoding import encode_corpus
from ledgerlens.llm.leaks import leaked_items, leaks
from ledgerlens.llm.names import holder_pairs, link_names
from ledgerlens.llm.same_look import consistent_forms, look_classes, same_look_pairs
from ledgerlens.llm.top_items import top_items
from ledgerlens.sources.tables import table

TOP = 5


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each sender's five transactions with the highest valid tx_score."""
    return p2_ranked(spark, folder).select("Sender_account", "row_index")


def p2_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The same with score and rank."""
    tx = table(spark, folder, "transactions").where("tx_score BETWEEN 0.0 AND 1.0")
    return top_items(tx, "Sender_account", "row_index", "tx_score", TOP)


def _holders(spark: SparkSession, folder: str) -> DataFrame:
    return link_names(table(spark, folder, "accounts"), table(spark, folder, "name_forms"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of accounts of one holder."""
    return holder_pairs(_holders(spark, folder))


def p3_holders(spark: SparkSession, folder: str) -> DataFrame:
    """Each named account with its holder, the least account of its class, and the size of the class."""
    members = _holders(spark, folder)
    sizes = members.groupBy("holder").agg(F.count("*").alias("n_accounts"))
    return members.join(sizes, "holder").select(F.col("key").alias("account_id"), F.col("holder").alias("holder_id"), "n_accounts")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every document's text in the vocabulary byte_bpe_50k."""
    return encode_corpus(table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with at least 12 consecutive words of an item's prompt or answer."""
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """The tiles of every leaked passage, those whose parts come in another order included."""
    found = leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.withColumn("coverage", F.round("coverage", 4))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of documents whose texts look the same but are not the same string."""
    return same_look_pairs(table(spark, folder, "documents"))


def p8_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every text."""
    return consistent_forms(table(spark, folder, "documents"))


def p8_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each document that shows something with the class of its form."""
    return look_classes(table(spark, folder, "documents"))


QUERIES = {
    "p6_ids": p6_ids, "p7_found": p7_found, "p7_report": p7_report, "p8_found": p8_found, "p8_forms": p8_forms, "p8_classes": p8_classes,
    "p2_found": p2_found, "p2_ranked": p2_ranked, "p3_found": p3_found, "p3_holders": p3_holders,
}

_RANKED = """WITH tx AS (SELECT DISTINCT ON (row_index) * FROM transactions),
r AS (SELECT Sender_account, row_index, tx_score, row_number() OVER (PARTITION BY Sender_account ORDER BY tx_score DESC, row_index) AS rank
FROM tx WHERE Sender_account IS NOT NULL AND tx_score BETWEEN 0 AND 1 AND CAST(tx_score AS VARCHAR) <> 'nan')"""

ORACLES = {
    "p2_found": f"{_RANKED} SELECT Sender_account, row_index FROM r WHERE rank <= 5",
    "p2_ranked": f"{_RANKED} SELECT Sender_account, row_index, tx_score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5",
}
