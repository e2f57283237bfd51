"""The nine-allergen engine: synonyms in text, status, messages and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..dims import NAMES, NINE
from ..functions.similarity import token_sort_similarity
from .evidence import mapped

#: Least similarity of a match that is not exact, and confidence of recognized text that is relied upon.
FUZZY, RELIABLE = 82.0, 0.6
#: Fixed texts of the messages.
HEADLINES = {
    "DETECTED": "\U0001f534 Allergen found",
    "POTENTIAL": "\U0001f7e0 Please check the label",
    "NOT_DETECTED": "\U0001f7e2 No known match found",
    "INSUFFICIENT_EVIDENCE": "⚪ Can't determine",
}
SEVERE_FOUND = (
    "You've flagged this as a severe allergy — treat this result with extra caution and consider avoiding the product "
    "unless you can verify the ingredients another way."
)
SEVERE_UNCLEAR = "Because this is a severe allergy, we recommend not relying on an unclear image — please recheck with a clearer photo or the printed label."
MILD_POSSIBLE = "Given this is a mild allergy, you may choose to check the label yourself before deciding."
WORST_FIRST = ("DETECTED", "POTENTIAL", "INSUFFICIENT_EVIDENCE", "NOT_DETECTED")


def exact_synonym(text: Column, allergen: str) -> Column:
    """The first synonym of the allergen that the upper-cased text contains, be it inside a word; null if none."""
    return F.coalesce(*[F.when(text.contains(s), F.lit(s)) for s in NINE[allergen]])


def exact_matches(texts: DataFrame, text: Column, *keys: str) -> DataFrame:
    """(keys, allergen, synonym) of exact matches: one projection, no join."""
    found = F.array(*[F.struct(F.lit(a).alias("allergen"), exact_synonym(F.col("_u"), a).alias("synonym")) for a in NINE])
    x = texts.select(*keys, F.upper(text).alias("_u")).select(*keys, F.explode(found).alias("f"))
    return x.filter("f.synonym is not null").select(*keys, "f.allergen", "f.synonym")


def matches(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(term, allergen, synonym, score, is_exact) of distinct terms: exact, else the most similar window of one to three words.

    A similarity of FUZZY or more bounds the lengths of both sides, so windows
    meet only synonyms of about their length before they are scored; ties go to
    the earlier synonym, then to the shorter and earlier window.
    """
    terms = terms.select("term").distinct()
    exact = exact_matches(terms, F.col("term"), "term").select("term", "allergen", "synonym", F.lit(100.0).alias("score"), F.lit(True).alias("is_exact"))
    words = terms.withColumn("w", F.filter(F.split(F.upper("term"), r"\s+"), lambda s: s != ""))
    starts = words.filter(F.size("w") > 0).select("term", "w", F.posexplode(F.col("w")).alias("at", "first"))
    windows = starts.select("term", "w", "at", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("size")).filter(F.col("at") + F.col("size") <= F.size("w"))
    windows = windows.select("term", "at", "size", F.array_join(F.slice("w", F.col("at") + 1, F.col("size")), " ").alias("phrase"))
    a, b = F.length("phrase"), F.length("synonym")
    pairs = windows.select("phrase").distinct().join(F.broadcast(synonyms), 200 * F.least(a, b) >= FUZZY * (a + b))
    pairs = pairs.withColumn("score", token_sort_similarity(F.col("phrase"), F.col("synonym"))).filter(F.col("score") >= FUZZY)
    order = F.struct(F.col("score"), (-F.col("pos")).alias("p"), (-F.col("size")).alias("s"), (-F.col("at")).alias("i"))
    best = windows.join(pairs, "phrase").groupBy("term", "allergen").agg(F.max_by(F.struct("synonym", "score"), order).alias("m"))
    fuzzy = best.select("term", "allergen", "m.synonym", "m.score", F.lit(False).alias("is_exact")).join(exact, ["term", "allergen"], "left_anti")
    return exact.unionByName(fuzzy)


def evidence(terms: DataFrame, found: DataFrame) -> DataFrame:
    """(label_id, allergen, synonym, term, match_type, score, confidence) of (label_id, term, stated), stated for terms of a CONTAINS statement."""
    x = terms.join(found, "term")
    kind = F.when(F.col("stated"), "explicit_contains").when(F.col("is_exact"), "exact_ingredient").otherwise("fuzzy_ingredient")
    sure = F.when(F.col("stated"), F.when(F.col("is_exact"), 0.99).otherwise(0.90)).when(F.col("is_exact"), 0.90).otherwise(F.greatest(F.lit(0.4), F.col("score") / 150))
    return x.select("label_id", "allergen", "synonym", "term", kind.alias("match_type"), "score", sure.alias("confidence"))


def assessed(labels: DataFrame, evidence: DataFrame) -> DataFrame:
    """(label_id, allergen, status, synonyms, n_evidence) of every label (label_id, has_text, ocr_confidence) and allergen."""
    grid = labels.select("label_id", "has_text", "ocr_confidence", F.explode(F.array(*[F.lit(a) for a in NINE])).alias("allergen"))
    has = lambda kind: F.max(F.col("match_type") == kind)
    per = evidence.groupBy("label_id", "allergen").agg(
        has("explicit_contains").alias("stated"), has("exact_ingredient").alias("exact"), F.count("*").alias("n_evidence"), F.sort_array(F.collect_set(F.initcap("synonym"))).alias("synonyms"))
    unclear = F.coalesce(F.col("ocr_confidence") < RELIABLE, F.lit(False))
    status = (
        F.when(F.col("stated"), "DETECTED").when(F.col("exact") & ~unclear, "DETECTED").when(F.col("n_evidence").isNotNull(), F.when(unclear, "INSUFFICIENT_EVIDENCE").otherwise("POTENTIAL"))
        .when(~F.col("has_text"), "INSUFFICIENT_EVIDENCE").otherwise("NOT_DETECTED")
    )
    return grid.join(per, ["label_id", "allergen"], "left").select("label_id", "allergen", status.alias("status"), F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"), F.coalesce("n_evidence", F.lit(0)).cast("long").alias("n_evidence"))


def detail(allergen: Column, status: Column, synonyms: Column) -> Column:
    """The sentence of a message; synonyms are sorted, distinct and in title case."""
    name, low = mapped(allergen, NAMES), F.lower(mapped(allergen, NAMES))
    possible = F.when(F.size(synonyms) > 0, F.array_join(F.slice(synonyms, 1, 3), ", ")).otherwise("a possible match")
    return (
        F.when(status == "DETECTED", F.concat(name, F.lit(" was found in the visible ingredient information ("), F.array_join(F.slice(synonyms, 1, 4), ", "), F.lit(").")))
        .when(status == "POTENTIAL", F.concat(F.lit("We found text that may indicate "), low, F.lit(" ("), possible, F.lit("), but the image isn't clear enough to confirm it.")))
        .when(status == "NOT_DETECTED", F.concat(F.lit("No mention of "), low, F.lit(" was found in the visible ingredient information. This does not guarantee the product is free of it.")))
        .otherwise(F.concat(F.lit("We couldn't read enough of the ingredient information to check for "), low, F.lit(". Try a clearer, closer photo of the ingredient list.")))
    )


def severity_note(status: Column, severity: Column) -> Column:
    return (
        F.when(status.isin("DETECTED", "POTENTIAL") & (severity == "severe"), SEVERE_FOUND)
        .when((status == "INSUFFICIENT_EVIDENCE") & (severity == "severe"), SEVERE_UNCLEAR)
        .when((status == "POTENTIAL") & (severity == "mild"), MILD_POSSIBLE)
    )


def messages(assessments: DataFrame, interests: DataFrame) -> DataFrame:
    """(user_id, label_id, allergen, status, headline, detail, severity_note) for allergens of interest (user_id, label_id, allergen, severity) that were assessed."""
    x = interests.join(assessments, ["label_id", "allergen"])
    status = F.col("status")
    return x.select("user_id", "label_id", "allergen", "status", mapped(status, HEADLINES).alias("headline"), detail(F.col("allergen"), status, F.col("synonyms")).alias("detail"), severity_note(status, F.col("severity")).alias("severity_note"))


def worst(status: Column) -> Column:
    """Aggregate: the worst status of a group; NOT_DETECTED for none."""
    rank = mapped(status, {s: i for i, s in enumerate(WORST_FIRST)})
    return F.element_at(F.array(*[F.lit(s) for s in WORST_FIRST]), F.coalesce(F.min(rank), F.lit(len(WORST_FIRST) - 1)) + 1)


def report(told: DataFrame) -> DataFrame:
    """(user_id, label_id, overall_status, per_allergen) of messages, allergens by name."""
    one = F.struct(mapped(F.col("allergen"), NAMES).alias("allergen"), "status", "headline", "detail", "severity_note")
    return told.groupBy("user_id", "label_id").agg(worst(F.col("status")).alias("overall_status"), F.sort_array(F.collect_list(one)).alias("per_allergen"))


def first_match(left: DataFrame, right: DataFrame, on: str, order: str) -> DataFrame:
    """Inner join with the first row of `right` (by `order`) of each key; rows of `left` without one are left out."""
    r = right.withColumn("_r", F.row_number().over(W.partitionBy(on).orderBy(order))).filter("_r = 1").drop("_r")
    return left.join(r, on)
