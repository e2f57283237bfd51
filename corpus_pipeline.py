"""A corpus pipeline of five operators: reject toxic texts, keep one of each near-duplicate group, mask personal data, mix the sources, pack.

Every stage reads what the one before it wrote, works on all of it, and hands
on rows with the columns of `documents`; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pantrylens.llm import jaccard, mixing, packing, pii, toxicity
from pantrylens.llm.shared import stored, stored_alone, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score stays below 0.5; null and empty texts stay, and all do without labels of both classes."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn("_toxicity", toxicity.toxicity(docs, model)).filter(F.col("_toxicity") < 0.5).drop("_toxicity")


#: Near copies: word shingles of five, similarity 0.8 (op5 keeps its own contract of three and 0.9).
NEAR_PERCENT, NEAR_GRAM = 80, 5


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of the Jaccard join, one text of it where ids repeat; equal rows leave one."""
    rows = jaccard.classes(docs, NEAR_PERCENT, NEAR_GRAM).groupBy("root", "doc_id", "tk").agg(F.count("*").alias("n"))
    first = rows.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tk", "n")).alias("k"))
    kept = first.select("k.doc_id", "k.tk", "k.n").unionByName(rows.filter("root is null").select("doc_id", "tk", "n"))
    kept = stored(kept.toDF("_id", "_tk", "_n"), "kept")
    side = F.broadcast(kept) if kept.count() <= jaccard.BROADCAST_ROWS else kept
    out = docs.join(side, docs["doc_id"].eqNullSafe(side["_id"]) & (F.xxhash64(docs["text"]) == side["_tk"]), "left_semi")
    return out.dropDuplicates(["doc_id", "text"]) if kept.filter("_n > 1").limit(1).count() else out


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data masked; null texts stay null."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, the last time perhaps in part; texts without a word are not taken."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows; a null or empty text is the closing id alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("jaccard_join", keep_one_of_each),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models, tokens and verified links cannot be said in SQL; tests hold all stages but the toxicity stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return docs
