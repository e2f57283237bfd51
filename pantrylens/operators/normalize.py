"""Entity resolution of ingredient terms: curated, vocabulary and segmentation stages.

Terms are reduced to distinct ones first; each stage takes only what the
stages before left over.  The vocabulary is blocked by shared tokens (else by
first character), so the similarity function sees blocked pairs only.  Whatever is broadcast is the fixed index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.similarity import weighted_similarity

ACCEPT, CANDIDATE, BEST = 0.90, 0.70, 5
SPACING = 0.95


def curated(terms: DataFrame, index: DataFrame, key: str = "cleaned") -> DataFrame:
    """Left equi-join with the fixed index: concept and allergen of exact matches."""
    return terms.join(F.broadcast(index.withColumnRenamed("surface", key)), key, "left")


def vocabulary_index(vocabulary: DataFrame) -> DataFrame:
    """(candidate, frequency, squeezed, token): one row per token of a term."""
    v = vocabulary.filter("raw_term is not null").select(F.lower(F.btrim("raw_term")).alias("candidate"), "frequency")
    return v.withColumn("squeezed", tx.compact(F.col("candidate"))).withColumn("token", F.explode(F.split("candidate", " ")))


def blocked_pairs(terms: DataFrame, index: DataFrame) -> DataFrame:
    """(cleaned, candidate, frequency): terms that share a token; for terms without one, the same first character."""
    tokens = terms.select("cleaned", F.explode(F.array_distinct(F.split("cleaned", " "))).alias("token"))
    shared = tokens.join(index, "token").select("cleaned", "candidate", "frequency").distinct()
    rest = terms.join(shared.select("cleaned").distinct(), "cleaned", "left_anti").select("cleaned", F.substring("cleaned", 1, 1).alias("c"))
    by_char = index.select(F.substring("candidate", 1, 1).alias("c"), "candidate", "frequency").distinct()
    return shared.unionByName(rest.join(by_char, "c").select("cleaned", "candidate", "frequency"))


def candidates(terms: DataFrame, index: DataFrame) -> DataFrame:
    """The BEST vocabulary terms of each term: similarity, then frequency, then name; an equal squeezed form scores 1."""
    exact = terms.withColumn("squeezed", tx.compact(F.col("cleaned"))).join(index.select("candidate", "frequency", "squeezed").distinct(), "squeezed")
    exact = exact.withColumn("r", F.row_number().over(W.partitionBy("cleaned").orderBy("candidate"))).filter("r = 1").select("cleaned", "candidate", F.lit(1.0).alias("similarity"), "frequency", F.lit("compact_exact").alias("match_method"))
    rest = terms.join(exact.select("cleaned"), "cleaned", "left_anti")
    fuzzy = blocked_pairs(rest, index).withColumn("similarity", weighted_similarity(F.col("cleaned"), F.col("candidate"))).withColumn("match_method", F.lit("dataset_fuzzy"))
    top = W.partitionBy("cleaned").orderBy(F.desc("similarity"), F.desc("frequency"), "candidate")
    return exact.unionByName(fuzzy.select(exact.columns)).withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= BEST)


def segments(terms: DataFrame, index: DataFrame) -> DataFrame:
    """Known word groups inside a term, longest first from the left, not overlapping: (cleaned, start, end, segment, known, confidence).

    All word groups that are no longer without spaces than the longest index
    term are joined with the (fixed, small) index: as they are, or without
    white space.  The greedy scan then runs over a term's few hits.
    """
    names = index.select("surface", F.regexp_replace("surface", tx.SPACE, "").alias("tight"))
    longest = names.agg(F.coalesce(F.max(F.length("tight")), F.lit(0))).first()[0]
    words = terms.withColumn("w", F.split("cleaned", " "))
    spans = words.select("cleaned", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("start")).select("*", F.explode(F.sequence(F.col("start") + 1, F.size("w"))).alias("end"))
    spans = spans.withColumn("segment", F.array_join(F.slice("w", F.col("start") + 1, F.col("end") - F.col("start")), " ")).drop("w")
    spans = spans.withColumn("tight", F.regexp_replace("segment", tx.SPACE, "")).filter(F.length("tight") <= longest)
    hits = spans.join(F.broadcast(names), "tight").withColumn("exact", F.col("segment") == F.col("surface"))
    hits = hits.withColumn("r", F.row_number().over(W.partitionBy("cleaned", "start").orderBy(F.desc("end"), F.desc("exact"), "surface"))).filter("r = 1")
    ordered = hits.groupBy("cleaned").agg(F.sort_array(F.collect_list(F.struct("start", "end", "segment", F.col("surface").alias("known"), F.when(F.col("exact"), 1.0).otherwise(SPACING).alias("confidence")))).alias("h"))
    none = F.array().cast("array<struct<start:int,end:int,segment:string,known:string,confidence:double>>")
    kept = F.aggregate("h", none, lambda acc, s: F.when((F.size(acc) == 0) | (F.element_at(acc, -1)["end"] <= s["start"]), F.concat(acc, F.array(s))).otherwise(acc))
    return ordered.select("cleaned", F.explode(kept).alias("s")).select("cleaned", "s.*")


def dataset_match(terms: DataFrame, index: DataFrame, threshold: float = ACCEPT) -> DataFrame:
    """The best vocabulary term of each term, whether it is accepted, and the alternatives in order."""
    c = candidates(terms, index)
    g = c.groupBy("cleaned").agg(F.sort_array(F.collect_list(F.struct("rank", "candidate", "similarity", "frequency", "match_method"))).alias("all"))
    best = F.col("all")[0]
    return g.select("cleaned", best["candidate"].alias("candidate"), best["similarity"].alias("similarity"), best["match_method"].alias("match_method"), ((best["match_method"] == "compact_exact") | (best["similarity"] >= threshold)).alias("accepted"), F.transform(F.slice("all", 2, BEST), lambda x: x["candidate"]).alias("alternatives"))


def normalize(raw: DataFrame, index: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row per distinct raw_term: the decision of all stages."""
    terms = raw.select("raw_term").distinct().withColumn("cleaned", tx.normal_form(F.col("raw_term")))
    distinct = curated(terms.select("cleaned").distinct().filter("cleaned <> ''"), index)
    known = distinct.filter("concept is not null")
    left = distinct.filter("concept is null").select("cleaned")
    best = candidates(left, vocabulary_index(vocabulary)).filter("rank = 1").select("cleaned", "candidate", "similarity", "match_method")
    seg = segments(left, index).groupBy("cleaned").agg(F.max((F.col("end") - F.col("start") >= 2).cast("int")).alias("multi"), F.max("confidence").alias("surest"), F.sort_array(F.collect_list(F.struct("start", "segment"))).alias("parts"))
    rows = terms.join(known, "cleaned", "left").join(best, "cleaned", "left").join(seg, "cleaned", "left")
    accepted = F.col("similarity") >= ACCEPT
    partial = F.coalesce(F.col("multi"), F.lit(0)) == 1
    stage = (
        F.when(F.col("concept").isNotNull(), "curated_exact").when(accepted, F.when(F.col("match_method") == "compact_exact", "dataset_exact").otherwise("dataset_fuzzy"))
        .when(partial, "partial_match").when(F.col("similarity") >= CANDIDATE, "dataset_candidate").otherwise("no_match")
    )
    rows = rows.withColumn("match_type", stage)
    term = F.when(F.col("match_type") == "curated_exact", F.col("cleaned")).when(F.col("match_type").startswith("dataset"), F.col("candidate"))
    lookup = F.broadcast(index.select(F.col("surface").alias("normalized_term"), F.col("concept").alias("c2"), F.col("allergen").alias("a2")))
    rows = rows.withColumn("normalized_term", term).join(lookup, "normalized_term", "left")
    status = F.when(F.col("match_type").isin("curated_exact", "dataset_exact", "dataset_fuzzy"), "known").when(F.col("match_type") == "partial_match", "ambiguous").when(F.col("match_type") == "dataset_candidate", "candidate").otherwise("unknown")
    confidence = F.when(F.col("match_type") == "curated_exact", 1.0).when(F.col("match_type") == "partial_match", F.col("surest")).when(F.col("match_type").startswith("dataset"), F.col("similarity")).otherwise(0.0)
    return rows.select(
        "raw_term", "cleaned", "normalized_term", F.coalesce("c2", "normalized_term").alias("canonical_concept"), "match_type", confidence.alias("confidence"), status.alias("status"), F.col("a2").alias("allergen"),
        F.when(F.col("match_type") == "partial_match", F.transform("parts", lambda p: p["segment"])).alias("segments"), F.when(F.col("match_type").isin("partial_match", "no_match"), F.col("raw_term")).alias("unresolved_text"),
    )
