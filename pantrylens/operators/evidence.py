"""Evidence, fusion and personal risk.  Categories are screening results, not medical advice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..dims import ALLERGENS
from ..functions import text as tx


def contains_evidence(labels: DataFrame, index: DataFrame) -> DataFrame:
    """Exact dictionary terms of the CONTAINS statement."""
    items = labels.select("label_id", F.posexplode(F.split(tx.contains_statement(F.col("text")), "[,;]")).alias("pos", "item"))
    items = items.withColumn("supporting_text", F.btrim("item")).withColumn("surface", F.lower(F.btrim("item")))
    x = items.join(F.broadcast(index.filter("allergen is not null")), "surface")
    return x.select("label_id", F.lit(0).alias("stage"), "pos", "allergen", F.col("surface").alias("ingredient"), F.lit("CONTAINS_STATEMENT").alias("evidence_type"), F.lit("label_contains_statement").alias("source"), F.lit(1.0).alias("confidence"), F.lit("strong").alias("strength"), "supporting_text")


def ingredient_evidence(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Evidence of normalized ingredient rows (label_id, pos, level and the normalization's columns)."""
    kind = F.when(F.col("level") == "nested", "NESTED_INGREDIENT").when(F.col("normalized_term") == F.col("canonical_concept"), "DIRECT_INGREDIENT").otherwise("NORMALIZED_INGREDIENT")
    plain = rows.filter("allergen is not null and status in ('known', 'candidate')").select(
        "label_id", F.lit(1).alias("stage"), "pos", "allergen", F.col("normalized_term").alias("ingredient"), F.when(F.col("status") == "known", kind).otherwise("FUZZY_NORMALIZATION").alias("evidence_type"),
        F.lit("ingredient_list").alias("source"), "confidence", F.when(F.col("status") == "known", "strong").otherwise("weak").alias("strength"), F.col("raw_term").alias("supporting_text"),
    )
    parts = rows.filter("status = 'ambiguous'").select("label_id", "pos", "confidence", "raw_term", F.explode("segments").alias("surface")).join(F.broadcast(index.filter("allergen is not null")), "surface")
    partial = parts.select("label_id", F.lit(1).alias("stage"), "pos", "allergen", F.col("surface").alias("ingredient"), F.lit("PARTIAL_MATCH").alias("evidence_type"), F.lit("ingredient_list").alias("source"), F.least(F.col("confidence"), F.lit(0.75)).alias("confidence"), F.lit("weak").alias("strength"), F.col("raw_term").alias("supporting_text"))
    return plain.unionByName(partial)


def collected(*parts: DataFrame) -> DataFrame:
    """All evidence, the first of equal (allergen, ingredient, text, source) of a label."""
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    first = W.partitionBy("label_id", "allergen", "ingredient", F.lower("supporting_text"), "source").orderBy("stage", "pos")
    return x.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")


def fused(label_status: DataFrame, evidence: DataFrame) -> DataFrame:
    """(label_id, allergen, status, confidence, n_evidence) for every label and fused allergen; label_status has (label_id, any_known)."""
    per = evidence.groupBy("label_id", "allergen").agg(
        F.count("*").alias("n_evidence"), F.max("confidence").alias("top"), F.count_distinct("ingredient", "source").alias("kinds"), F.max((F.col("strength") == "strong") & (F.col("confidence") >= 0.95)).alias("sure"))
    grid = label_status.select("label_id", "any_known", F.explode(F.array(*[F.lit(a) for a in ALLERGENS])).alias("allergen"))
    x = grid.join(per, ["label_id", "allergen"], "left")
    status = F.when(F.col("sure"), "DETECTED").when(F.col("n_evidence").isNotNull(), "POTENTIAL").when(F.col("any_known"), "NOT_DETECTED").otherwise("INSUFFICIENT_EVIDENCE")
    confidence = F.coalesce(F.least(F.lit(1.0), F.col("top") + 0.02 * (F.col("kinds") - 1)), F.lit(0.0))
    return x.select("label_id", "allergen", status.alias("status"), confidence.alias("confidence"), F.coalesce("n_evidence", F.lit(0)).cast("long").alias("n_evidence"))


RANK = {"DETECTED": 4, "POTENTIAL": 3, "INSUFFICIENT_EVIDENCE": 2, "NOT_DETECTED": 1}
LEVELS = (("HIGH", 5), ("MEDIUM", 4), ("INSUFFICIENT_EVIDENCE", 3), ("LOW", 2), ("NO_MATCH", 1))
RISK = {"DETECTED": "HIGH", "POTENTIAL": "MEDIUM", "INSUFFICIENT_EVIDENCE": "INSUFFICIENT_EVIDENCE", "NOT_DETECTED": "LOW"}


def mapped(column, table: dict, other=None):
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def selected(assessments: DataFrame) -> DataFrame:
    """The strongest assessment of each (label_id, allergen); conflict where statuses differ."""
    over = W.partitionBy("label_id", "allergen")
    x = assessments.withColumn("rank", mapped(F.col("status"), RANK, 0))
    x = x.withColumn("r", F.row_number().over(over.orderBy(F.desc("rank"), "pos"))).withColumn("conflict", F.min("status").over(over) != F.max("status").over(over))
    return x.filter("r = 1").drop("r", "rank")


#: Fixed texts: reasons by risk level, {} for the allergen.
REASONS = {
    "HIGH": "{} is associated with the user's allergy profile and was detected from available ingredient evidence.",
    "MEDIUM": "{} may be present based on uncertain ingredient evidence; manual verification is recommended.",
    "LOW": "No known {} allergen was detected from available evidence.",
    "INSUFFICIENT_EVIDENCE": "Available evidence is insufficient to determine whether {} is present.",
    "NO_MATCH": "No product allergen assessment is available for this profile allergen.",
}
#: Fixed texts: the warning of a product by its overall risk.
WARNINGS = {
    "HIGH": "Potentially relevant allergen detected for this user. Manual verification is recommended.",
    "MEDIUM": "Potential allergen evidence was found, but the evidence is uncertain. Manual verification is recommended.",
    "INSUFFICIENT_EVIDENCE": "Available evidence is insufficient to determine whether the relevant allergen is present.",
    "LOW": "No known allergen detected from available evidence.",
    "NO_MATCH": "No product allergen assessment matched this user profile.",
}


def reason(allergen, level):
    out = F.lit(None)
    for name, text in REASONS.items():
        before, _, after = text.partition("{}")
        who = F.initcap(allergen) if name in ("HIGH", "MEDIUM") else F.lower(allergen)
        out = F.when(level == name, F.concat(F.lit(before), who, F.lit(after)) if after else F.lit(text)).otherwise(out)
    return out


def in_order(evidence: DataFrame) -> DataFrame:
    """(label_id, allergen, ingredients, evidence_types, sources, unresolved): ordered distinct lists; a label's evidence is a few rows."""
    rows = F.sort_array(F.collect_list(F.struct("stage", "pos", "ingredient", "evidence_type", "source", "supporting_text"))).alias("e")
    pick = lambda c: F.array_distinct(F.transform("e", lambda x: x[c]))
    open_ = F.array_distinct(F.transform(F.filter("e", lambda x: x["evidence_type"] == "PARTIAL_MATCH"), lambda x: x["supporting_text"]))
    return evidence.groupBy("label_id", "allergen").agg(rows).select("label_id", "allergen", pick("ingredient").alias("ingredients"), pick("evidence_type").alias("evidence_types"), pick("source").alias("sources"), open_.alias("unresolved"))


def personal_risk(pairs: DataFrame, assessments: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Risk level and reason of every (user_id, label_id, allergen) of interest, with the evidence's lists if it is given.

    NO_MATCH where the allergen was not assessed, INSUFFICIENT_EVIDENCE where
    nothing of the label was.
    """
    known = assessments.select("label_id").distinct().withColumn("any", F.lit(True))
    x = pairs.join(assessments.select("label_id", "allergen", "status", "confidence"), ["label_id", "allergen"], "left").join(known, "label_id", "left")
    status = F.coalesce("status", F.when(F.col("any"), "NOT_ASSESSED").otherwise("INSUFFICIENT_EVIDENCE"))
    x = x.withColumn("status", status).withColumn("risk_level", F.when(F.col("status") == "NOT_ASSESSED", "NO_MATCH").otherwise(mapped(F.col("status"), RISK, "INSUFFICIENT_EVIDENCE")))
    x = x.select("user_id", "label_id", "allergen", "status", "risk_level", reason(F.col("allergen"), F.col("risk_level")).alias("reason"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    if evidence is None:
        return x
    x = x.join(in_order(evidence), ["label_id", "allergen"], "left")
    none = F.array().cast("array<string>")
    return x.select("user_id", "label_id", "allergen", "status", "risk_level", "reason", "confidence", *[F.coalesce(c, none).alias(c) for c in ("ingredients", "evidence_types", "sources", "unresolved")])


def product_risk(risks: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """(user_id, label_id, overall_risk, matched, warning): the highest level, the allergens of HIGH and MEDIUM by name.

    products holds all (user_id, label_id); those without an allergen of
    interest are NO_MATCH.
    """
    x = risks.withColumn("p", mapped(F.col("risk_level"), dict(LEVELS), 1))
    g = x.groupBy("user_id", "label_id").agg(F.max("p").alias("p"), F.sort_array(F.collect_list(F.when(F.col("risk_level").isin("HIGH", "MEDIUM"), F.col("allergen")))).alias("matched"))
    if products is not None:
        g = products.select("user_id", "label_id").join(g, ["user_id", "label_id"], "left")
    level = mapped(F.coalesce("p", F.lit(1)), {v: k for k, v in LEVELS})
    return g.select("user_id", "label_id", level.alias("overall_risk"), F.coalesce("matched", F.array().cast("array<string>")).alias("matched"), mapped(level, WARNINGS).alias("warning"))


# --- what the service answers ---------------------------------------------------------

#: Fixed texts: level and reason of a selected allergen by its status, {} for the allergen.
ANSWERS = {
    "DETECTED": ("ALLERGEN_FOUND", "{} was detected in the available allergen evidence."),
    "POTENTIAL": ("POSSIBLE_ALLERGEN", "There is potential evidence for {} in the available evidence."),
    "NOT_DETECTED": ("NO_MATCH", "{} was not found in the available ingredient evidence."),
    "INSUFFICIENT_EVIDENCE": ("INSUFFICIENT_EVIDENCE", "There is insufficient evidence to determine whether {} is present."),
}
#: Fixed texts: message of the overall level.
OVERALL = {
    "ALLERGEN_FOUND": "A selected allergen was detected in the available product evidence.",
    "POSSIBLE_ALLERGEN": "Potential evidence for a selected allergen was found.",
    "INSUFFICIENT_EVIDENCE": "There is insufficient evidence to determine whether the selected allergens are present.",
    "NO_MATCH": "No selected allergen was found in the available ingredient evidence.",
}


def selected_results(selection: DataFrame, assessments: DataFrame, labels: DataFrame) -> DataFrame:
    """(user_id, label_id, allergen, status, confidence) of selected allergens; what was not assessed is NOT_DETECTED with 1.0 if the label (label_id, any_ingredient) has an ingredient, else INSUFFICIENT_EVIDENCE."""
    x = selection.withColumn("allergen", F.upper("allergen")).distinct().join(labels, "label_id").join(assessments.select("label_id", "allergen", "status", "confidence"), ["label_id", "allergen"], "left")
    status = F.coalesce("status", F.when(F.col("any_ingredient"), "NOT_DETECTED").otherwise("INSUFFICIENT_EVIDENCE"))
    return x.select("user_id", "label_id", "allergen", status.alias("status"), F.round(F.coalesce("confidence", F.when(F.col("any_ingredient"), 1.0).otherwise(0.0)), 4).alias("confidence"))


def answers(results: DataFrame) -> DataFrame:
    """The results with risk_level and reason."""
    why = F.lit(None)
    for status, (_, text) in ANSWERS.items():
        before, _, after = text.partition("{}")
        why = F.when(F.col("status") == status, F.concat(F.lit(before), F.col("allergen"), F.lit(after))).otherwise(why)
    return results.select("*", mapped(F.col("status"), {s: a[0] for s, a in ANSWERS.items()}, "INSUFFICIENT_EVIDENCE").alias("risk_level"), why.alias("reason"))


def overall_answer(products: DataFrame, told: DataFrame) -> DataFrame:
    """(user_id, label_id, level, message) of every product; an empty selection is INSUFFICIENT_EVIDENCE."""
    order = ("ALLERGEN_FOUND", "POSSIBLE_ALLERGEN", "INSUFFICIENT_EVIDENCE", "NO_MATCH")
    g = told.groupBy("user_id", "label_id").agg(F.min(mapped(F.col("risk_level"), {s: i for i, s in enumerate(order)})).alias("r"))
    level = F.element_at(F.array(*[F.lit(s) for s in order]), F.coalesce("r", F.lit(2)) + 1)
    empty = "The available evidence was insufficient to determine the selected allergens."
    x = products.select("user_id", "label_id").join(g, ["user_id", "label_id"], "left")
    return x.select("user_id", "label_id", level.alias("level"), F.when(F.col("r").isNull(), empty).otherwise(mapped(level, OVERALL)).alias("message"))
