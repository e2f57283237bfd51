"""Label tables made of the star schema: one label per order, its terms from the parts of its lines.

The noun of a part name gives the ingredient, its adjective the way the text is
damaged; since the text is made of rows, SQL over the rows can say what any
operator on the text must find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOUNS = {"anvil": "WHEAT FLOUR", "bolt": "SOY LECITHIN", "gear": "MILK", "gizmo": "SUGAR", "plate": "SUNFLOWER OIL", "ring": "WHEY", "rod": "SALT", "widget": "RICE FLOUR"}
TAILS = {"F": " CONTAINS: MILK, SOY.", "P": " DISTRIBUTED BY ACME FOODS NET WT 40"}
#: What each adjective makes of an ingredient i, as SQL that both engines read.
DAMAGE = {
    "blue": "i", "cold": "replace(i, ' ', '')", "hot": "concat(substring(i, 1, 2), substring(i, 4))", "large": "concat('5% ', i)",
    "new": "concat('BLEND (', i, ', SALT)')", "old": "concat('MIX {', i, '}')", "red": "concat('ONION ', i)", "small": "'XYLOQUIN'",
}
ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate"
TERM = "CASE a " + " ".join(f"WHEN '{a}' THEN {x}" for a, x in DAMAGE.items()) + " END"
NOUN = "CASE n " + " ".join(f"WHEN '{n}' THEN '{x}'" for n, x in NOUNS.items()) + " END"

#: The same tables as common table expressions of the oracle SQL.
CTE = f"""
parts AS (SELECT p_partkey, a, i, {TERM} AS term FROM (SELECT p_partkey, a, {NOUN} AS i FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS n FROM part))),
terms AS (SELECT o_orderkey, o_custkey, o_orderstatus, a, i, term, row_number() OVER (PARTITION BY o_orderkey ORDER BY {ORDER}) AS pos
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN parts ON l_partkey = p_partkey),
labels AS (SELECT o_orderkey AS label_id, any_value(o_custkey) AS user_id, any_value(o_orderstatus) AS kind, string_agg(term, ', ' ORDER BY pos) AS listing,
                  'INGREDIENTS: ' || string_agg(term, ', ' ORDER BY pos) || CASE any_value(o_orderstatus) WHEN 'F' THEN '{TAILS["F"]}' WHEN 'P' THEN '{TAILS["P"]}' ELSE '' END AS text
           FROM terms GROUP BY o_orderkey)
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("a"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("n"))
    p = p.select("p_partkey", "a", F.expr(NOUN).alias("i"))
    return p.select("p_partkey", "a", "i", F.expr(TERM).alias("term"))


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").join(part_terms(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    return lines.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label_id, user_id, kind, listing, text); a label's lines are few, so its list is bounded."""
    keys = [c.strip() for c in ORDER.split(",")]
    x = label_lines(spark, sf_dir).groupBy("o_orderkey").agg(F.first("o_custkey").alias("user_id"), F.first("o_orderstatus").alias("kind"), F.sort_array(F.collect_list(F.struct(*keys, "term"))).alias("t"))
    listing = F.array_join(F.transform("t", lambda s: s["term"]), ", ")
    tail = F.when(F.col("kind") == "F", TAILS["F"]).when(F.col("kind") == "P", TAILS["P"]).otherwise("")
    return x.select(F.col("o_orderkey").alias("label_id"), "user_id", "kind", listing.alias("listing"), F.concat(F.lit("INGREDIENTS: "), listing, tail).alias("text"))
