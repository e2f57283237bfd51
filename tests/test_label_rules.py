from pyspark.sql import functions as F

from pantrylens import dims
from pantrylens.functions import similarity as sim
from pantrylens.functions import text as tx
from pantrylens.operators import evidence as ev
from pantrylens.operators import normalize as nz
from pantrylens.operators import parse


def cleaned(text):
    return [(c, p, lv) for _, c, p, lv, _ in parse.ingredients(text)]


def test_flat_and_nested():
    assert [c for c, _, _ in cleaned("INGREDIENTS: MILK, SUGAR, WHEAT FLOUR CONTAINS: MILK")] == ["MILK", "SUGAR", "WHEAT FLOUR"]
    got = cleaned("INGREDIENTS: FLOUR (WHEAT FLOUR, NIACIN), SALT")
    assert ("WHEAT FLOUR", "FLOUR", "nested") in got and ("SALT", None, "top_level") in got
    assert [c for c, _, _ in cleaned("INGREDIENTS: A (B (C, D), E)")] == ["A", "B", "C", "D", "E"]


def test_malformed_and_empty():
    assert {"BREAD", "WHEAT", "MILK"} <= {c for c, _, _ in cleaned("INGREDIENTS: BREAD (WHEAT, MILK")}
    assert cleaned("CONTAINS: MILK") == [] and cleaned(None) == [] and cleaned("nan") == []
    assert [c for c, _, _ in cleaned("INGREDIENTS: SUGAR, SALT DISTRIBUTED BY X SKU # 4")] == ["SUGAR", "SALT"]
    # what follows the last bracket is dropped; a missing parent is inherited
    assert [c for c, _, _ in cleaned("INGREDIENTS: A (B) TAIL")] == ["A", "B"]


def test_alternatives():
    assert [c for c, _, _ in cleaned("INGREDIENTS: SUNFLOWER AND/OR SAFFLOWER AND/OR CANOLA OIL")] == ["SUNFLOWER OIL", "SAFFLOWER OIL", "CANOLA OIL"]


def test_vocabulary_terms():
    assert parse.flattened("lecithin (emulsifier)") == ["lecithin"]
    assert parse.flattened("flour [wheat (durum), niacin]") == ["flour", "wheat", "durum", "niacin"]


def test_similarity_is_indel():
    assert sim.lcs("soy leotain", "soy lecithin") == 9
    assert sim.weighted("soy leotain", "soy lecithin") == 0.7774


def test_decisions(spark):
    raw = spark.createDataFrame([("  SOY    LECITHIN  ",), ("soy leotain",), ("onion sunflower oil",), ("completelyunknowningredientxyz",), ("thiaminmononitrate",), ("  ",)], "raw_term string")
    vocabulary = spark.createDataFrame([("soy lecithin", 5), ("thiamin mononitrate", 2)], "raw_term string, frequency int")
    got = {r.raw_term: r for r in nz.normalize(raw, dims.exact_index(spark), vocabulary).collect()}
    assert got["  SOY    LECITHIN  "].allergen == "SOY" and got["  SOY    LECITHIN  "].confidence == 1.0
    assert (got["soy leotain"].status, got["soy leotain"].confidence) == ("candidate", 0.7774)
    assert got["onion sunflower oil"].status == "ambiguous" and got["onion sunflower oil"].segments == ["sunflower oil"]
    assert got["completelyunknowningredientxyz"].status == "unknown" and got["  "].status == "unknown"
    assert got["thiaminmononitrate"].match_type == "dataset_exact"


def test_text_expressions(spark):
    one = lambda x, f: spark.createDataFrame([(x,)], "t string").select(f(F.col("t"))).first()[0]
    assert one("É\tMILK [x]", tx.normal_form) == "é milk"
    assert one("BEST BY WHEAT", tx.strip_prefix) == "WHEAT"
    assert one("CONTAINS: MILK, SOY. more", tx.contains_statement) == "MILK, SOY"
    assert one(None, tx.ingredient_section) == ""


def test_fusion_statuses(spark):
    status = spark.createDataFrame([(1, True), (2, False)], "label_id long, any_known boolean")
    e = spark.createDataFrame([(1, 1, 0, "SOY", "soy", "t", "s", 0.8, "weak", "x")], "label_id long, stage int, pos int, allergen string, ingredient string, evidence_type string, source string, confidence double, strength string, supporting_text string")
    got = {(r.label_id, r.allergen): r.status for r in ev.fused(status, e).collect()}
    assert got[1, "SOY"] == "POTENTIAL" and got[1, "MILK"] == "NOT_DETECTED" and got[2, "WHEAT"] == "INSUFFICIENT_EVIDENCE"
