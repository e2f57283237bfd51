"""Mixing sources to target weights.

Hash-random keys put every source in a fixed random order; distributed prefix
sums of sizes over that order say where the source's budget cuts it.  Prefix
sums are hierarchical: rows within a fine key range, fine ranges within a
coarse one, coarse ranges within a source - so a source that holds most rows
is spread over many tasks, and no window sees more than its range.

Defined cases: null texts have size 0; a null source is a source of its own,
last in order; rows with the same id and size are interchangeable; ties of the
key are cut in the order of id and size; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, stored

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
#: Hex digits of the key that name its coarse and its fine range.
DIGITS = 2
PREFIX = "mix:"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT) -> DataFrame:
    """(source, source_size) with `target`: percent of all sizes shared by weight, capped at twice the size.

    One row per source stands in one window; sources are a dimension, and no
    row of a document gets here.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    x = sizes.withColumn("weight", pick.cast("long"))
    # ascending in the level at which a source reaches its cap
    fill = W.orderBy(F.col("cap_level"), F.col("source").isNull(), F.col("source"))
    x = x.withColumn("cap_level", 2 * F.col("source_size") / F.col("weight"))
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0))
    x = (
        x.withColumn("total", F.sum("source_size").over(every))
        .withColumn("rest_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("rest", percent * F.col("total") - 200 * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    )
    # with level = rest / (100 rest_weight): capped while 2 size <= weight * level
    open_ = 200 * F.col("source_size") * F.col("rest_weight") > F.col("weight") * F.col("rest")
    x = x.withColumn("open", open_)
    first = lambda c: F.min(F.when(F.col("open"), F.struct("cap_level", F.col("source").isNull(), "source", "rest", "rest_weight"))).over(every)[c]
    shared = (F.col("weight") * first("rest")).cast("double") / (100 * first("rest_weight")).cast("double")
    return x.select("source", "source_size", F.when(F.col("open"), shared).otherwise((2 * F.col("source_size")).cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: size, source_size, target of its source, and the words taken from it over all epochs; with the columns to carry."""
    key = F.md5(F.concat(F.lit(PREFIX), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    meta = stored(
        docs.select(
            *carry,
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            key.alias("key"),
            F.col("source").isNull().alias("s0"),
            F.coalesce("source", F.lit("")).alias("s1"),
            F.substring(key, 1, DIGITS).alias("coarse"),
            F.substring(key, 1, 2 * DIGITS).alias("fine"),
        ),
        "mix",
    )
    fine = meta.groupBy("s0", "s1", "coarse", "fine").agg(F.sum("size").alias("size"))
    coarse = fine.groupBy("s0", "s1", "coarse").agg(F.sum("size").alias("size"))
    earlier = lambda over, by: F.coalesce(F.sum("size").over(over.orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    coarse = coarse.select("s0", "s1", "coarse", earlier(W.partitionBy("s0", "s1"), "coarse").alias("before_coarse"), F.sum("size").over(W.partitionBy("s0", "s1")).alias("source_size"))
    sizes = coarse.groupBy("s0", "s1").agg(F.max("source_size").alias("source_size")).select(F.when(~F.col("s0"), F.col("s1")).alias("source"), "source_size")
    targets = source_targets(sizes, weights, percent).select(F.col("source").isNull().alias("s0"), F.coalesce("source", F.lit("")).alias("s1"), "target")
    coarse = coarse.join(targets, ["s0", "s1"])
    fine = fine.select("s0", "s1", "coarse", "fine", earlier(W.partitionBy("s0", "s1", "coarse"), "fine").alias("before_fine"))
    ranges = fine.join(coarse, ["s0", "s1", "coarse"]).select("s0", "s1", "fine", "source_size", "target", (F.col("before_coarse") + F.col("before_fine")).alias("before_range"))
    within = W.partitionBy("s0", "s1", "fine").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = meta.join(ranges, ["s0", "s1", "fine"]).withColumn("before", F.col("before_range") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return rows.select(*carry, "doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT) -> DataFrame:
    """The mix itself: each document as often as it is taken whole, and the words of a document that its source's budget cuts (joined by one space)."""
    keyed = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    taken = mix(keyed, weights, percent, ("_row",)).filter("taken > 0").select("_row", "size", "taken")
    x = keyed.join(taken, "_row")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    part = (F.col("taken") % F.col("size")).cast("int")
    x = x.withColumn("_part", F.explode(F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    x = x.withColumn("text", F.when(F.col("_part") > 0, F.concat_ws(" ", F.slice(words, F.lit(1), F.greatest(F.col("_part"), F.lit(1))))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        x = x.withColumn("n_chars", F.length("text").cast("long"))
    return x.select(*docs.columns)
