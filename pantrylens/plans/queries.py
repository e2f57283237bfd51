"""Registered queries of the label operators, each with DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as tx
from ..operators import evidence as ev
from ..operators import normalize as nz
from ..operators import parse
from ..sources.files import stored
from .labels import CTE, label_lines, labels, part_terms, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
L = f"WITH {CTE}"
INDEX = f"idx(surface, concept, allergen) AS ({dims.sql_values(dims.exact_index_rows())})"
NINE = f"syn(allergen, pos, synonym) AS ({dims.sql_values([(a, i, s) for a, t in dims.NINE.items() for i, s in enumerate(t)])})"
BASE = f"rule(allergen, keyword) AS ({dims.sql_values([(a, s) for a, t in dims.BASELINE.items() for s in t])})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"{L} SELECT kind, count(*) AS n, sum(length(text))::BIGINT AS chars, max(length(text))::BIGINT AS longest FROM labels GROUP BY kind")
def o02_inspect_corpus(spark, sf):
    return labels(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).cast("long").alias("longest"))


TILES = "h, h * 2 // 5 AS tile, h * 2 // 5 - h // 10 AS step"


@query(f"""WITH g AS (SELECT p_partkey, {TILES} FROM (SELECT p_partkey, p_size * 100 AS h FROM part)),
n AS (SELECT *, CASE WHEN tile >= h THEN 0 ELSE -((tile - h) // step) END AS last FROM g)
SELECT p_partkey, k::BIGINT AS tile_no, (k * step)::BIGINT AS y0, least(h, k * step + tile)::BIGINT AS y1 FROM (SELECT *, unnest(range(0, (ceil((h - tile) / step))::BIGINT + 1)) AS k FROM n)""")
def o13_tile_geometry(spark, sf):
    """Tiles of 40 % height that overlap by 10 %, the last one cut at the image's end."""
    g = read(spark, sf, "part").select("p_partkey", (F.col("p_size") * 100).alias("h"))
    g = g.withColumn("tile", F.floor(F.col("h") * 2 / 5)).withColumn("step", F.col("tile") - F.floor(F.col("h") / 10))
    last = F.greatest(F.lit(0), F.ceil((F.col("h") - F.col("tile")) / F.col("step")))
    g = g.withColumn("tile_no", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return g.select("p_partkey", "tile_no", (F.col("tile_no") * F.col("step")).alias("y0"), F.least(F.col("h"), F.col("tile_no") * F.col("step") + F.col("tile")).cast("long").alias("y1"))


@query("SELECT user_id, string_agg(event_type, ' ' ORDER BY ts, event_id) AS text, count(*) AS regions, round(avg(value), 4) AS confidence FROM events WHERE event_type <> '' GROUP BY user_id")
def o14_flatten_regions(spark, sf):
    g = read(spark, sf, "events").filter("event_type <> ''").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("r"), F.count("*").alias("regions"), F.round(F.avg("value"), 4).alias("confidence"))
    return g.select("user_id", F.array_join(F.transform("r", lambda x: x["event_type"]), " ").alias("text"), "regions", "confidence")


HITS = " + ".join(f"contains(upper(text), '{w}')::INT" for w in dims.OCR_WORDS)
SCORE = f"""50 * ((label_id % 100) / 100.0)::DOUBLE + 15 * least(length(text) / 500.0::DOUBLE, 1.0) + least(5 * ({HITS}), 25) + 15 + CASE WHEN contains(upper(text), 'CONTAINS') THEN 15 ELSE 0 END
- CASE WHEN length(text) < 30 THEN 10 ELSE 0 END - CASE WHEN length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')) / length(text) < 0.65 THEN 10 ELSE 0 END + 5 * least((label_id % 50) / 100.0::DOUBLE, 1.0)"""


def scored(spark, sf):
    x = labels(spark, sf)
    return x.withColumn("score", tx.ocr_score(F.col("text"), F.col("label_id") % 100 / 100, F.col("label_id") % 50))


@query(f"{L} SELECT label_id, round({SCORE}, 6) AS score FROM labels")
def o15_ocr_quality_score(spark, sf):
    return scored(spark, sf).select("label_id", F.round("score", 6).alias("score"))


@query(f"{L}, s AS (SELECT *, round({SCORE}, 6) AS score FROM labels) SELECT user_id, label_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, label_id) AS r FROM s WHERE score > 0) WHERE r = 1")
def o16_best_candidate(spark, sf):
    x = scored(spark, sf).withColumn("score", F.round("score", 6)).filter("score > 0")
    # the best of a user by one aggregate: no sort of a user's candidates
    g = x.groupBy("user_id").agg(F.max_by(F.struct("label_id", "score"), F.struct("score", (-F.col("label_id")).alias("l"))).alias("b"))
    return g.select("user_id", "b.label_id", "b.score")


@query(f"{L} SELECT kind, count_if(contains(upper(text), 'INGREDIENTS')) AS ingredients_detected, count_if(contains(upper(text), 'CONTAINS')) AS contains_detected FROM labels GROUP BY kind")
def o18_detection_flags(spark, sf):
    return labels(spark, sf).groupBy("kind").agg(F.count_if(F.upper("text").contains("INGREDIENTS")).alias("ingredients_detected"), F.count_if(F.upper("text").contains("CONTAINS")).alias("contains_detected"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS lowest, max(value) AS highest FROM events GROUP BY event_type")
def o19_confidence_stats(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


@query(f"{L} SELECT label_id, CASE kind WHEN 'P' THEN 'INGREDIENTS: ' || listing ELSE text END AS cut FROM labels")
def o20_packaging_cut(spark, sf):
    return labels(spark, sf).select("label_id", tx.strip_packaging(F.col("text")).alias("cut"))


@query(f"{L} SELECT label_id, listing AS section FROM labels")
def o21_ingredient_section(spark, sf):
    return labels(spark, sf).select("label_id", tx.ingredient_section(F.col("text")).alias("section"))


@query(f"{L} SELECT DISTINCT p_partkey, replace(replace(term, '{{', '('), '}}', ')') AS repaired FROM parts")
def o22_bracket_repair(spark, sf):
    return part_terms(spark, sf).select("p_partkey", tx.repair_brackets(F.col("term")).alias("repaired"))


@query(f"{L} SELECT p_partkey, CASE WHEN a = 'large' THEN i WHEN a = 'old' THEN 'MIX (' || i || ')' ELSE term END AS cleaned FROM parts")
def o23_clean_text(spark, sf):
    return part_terms(spark, sf).select("p_partkey", tx.clean_text(F.col("term")).alias("cleaned"))


@query(f"{L} SELECT p_partkey, CASE WHEN a = 'large' THEN i WHEN a = 'old' THEN 'MIX (' || i || ')' ELSE term END AS cleaned FROM parts")
def o25_clean_term(spark, sf):
    return part_terms(spark, sf).select("p_partkey", tx.clean_term(F.concat(F.lit("- "), F.col("term"), F.lit(";"))).alias("cleaned"))


EXPECTED = """
rows_(label_id, raw_text, cleaned_text, parent, level) AS (
  SELECT o_orderkey, term, CASE a WHEN 'large' THEN i WHEN 'new' THEN 'BLEND' WHEN 'old' THEN 'MIX' ELSE term END, NULL, 'top_level' FROM terms
  UNION ALL SELECT o_orderkey, i, i, CASE a WHEN 'new' THEN 'BLEND' ELSE 'MIX' END, 'nested' FROM terms WHERE a IN ('new', 'old')
  UNION ALL SELECT o_orderkey, 'SALT', 'SALT', 'BLEND', 'nested' FROM terms WHERE a = 'new'),
found AS (SELECT label_id, cleaned_text, parent, level, CASE WHEN level = 'top_level' AND cleaned_text NOT IN ('BLEND', 'MIX') THEN cleaned_text ELSE raw_text END AS raw_text FROM rows_)"""


@query(f"{L}, {EXPECTED} SELECT DISTINCT label_id, cleaned_text, parent, level FROM found")
def o29_hierarchical_extraction(spark, sf):
    return parse.extract(labels(spark, sf), F.col("text"), "label_id").select("label_id", "cleaned_text", "parent", "level").distinct()


@query(f"{L}, {EXPECTED} SELECT cleaned_text AS nested_term, count(DISTINCT label_id) AS labels FROM found WHERE level = 'nested' GROUP BY 1")
def o30_nested_view(spark, sf):
    return parse.extract(labels(spark, sf), F.col("text"), "label_id").filter("level = 'nested'").groupBy(F.col("cleaned_text").alias("nested_term")).agg(F.count_distinct("label_id").alias("labels"))


@query(f"{L} SELECT p_partkey, CASE WHEN a = 'large' THEN lower(i) ELSE lower(term) END AS cleaned FROM parts")
def o32_vocabulary_clean(spark, sf):
    return part_terms(spark, sf).select("p_partkey", tx.vocabulary_term(F.col("term")).alias("cleaned"))


VOCABULARY = """w AS (SELECT o_orderkey AS o, pos, unnest(CASE a WHEN 'large' THEN [i] WHEN 'new' THEN CASE WHEN i = 'SALT' THEN ['BLEND', 'SALT'] ELSE ['BLEND', i, 'SALT'] END ELSE [term] END) AS t FROM terms),
vocab AS (SELECT lower(t) AS raw_term, count(*) AS frequency FROM w GROUP BY 1)"""


@query(f"{L}, {VOCABULARY} SELECT raw_term, frequency FROM vocab")
def o38_build_vocabulary(spark, sf):
    return parse.build_vocabulary(labels(spark, sf), F.col("listing"))


@query(f"{L} SELECT p_partkey, CASE a WHEN 'cold' THEN regexp_replace(lower(term), '([a-z])(flour|chips|oil)\\b', '\\1 \\2') WHEN 'new' THEN 'blend' WHEN 'old' THEN 'mix' WHEN 'large' THEN '5 ' || lower(i) ELSE lower(term) END AS cleaned FROM parts")
def o39_normal_form(spark, sf):
    return part_terms(spark, sf).select("p_partkey", tx.normal_form(F.col("term")).alias("cleaned"))


@query(f"{L}, {INDEX} SELECT p_partkey, lower(i) AS term, coalesce(concept, lower(i)) AS concept, allergen FROM parts LEFT JOIN idx ON surface = lower(i)")
def o40_resolve_concept(spark, sf):
    x = part_terms(spark, sf).select("p_partkey", F.lower("i").alias("term"))
    return nz.curated(x, dims.exact_index(spark), "term").select("p_partkey", "term", F.coalesce("concept", "term").alias("concept"), "allergen")


@query(f"WITH {INDEX} SELECT coalesce(allergen, 'NONE') AS allergen, count(*) AS surfaces, count(DISTINCT concept) AS concepts FROM idx GROUP BY 1")
def o41_exact_index(spark, sf):
    return dims.exact_index(spark).groupBy(F.coalesce("allergen", F.lit("NONE")).alias("allergen")).agg(F.count("*").alias("surfaces"), F.count_distinct("concept").alias("concepts"))


@query(f"{L} SELECT p_partkey, regexp_replace(lower(term), '[^a-z0-9]', '', 'g') AS squeezed FROM parts")
def o43_compact_key(spark, sf):
    return part_terms(spark, sf).select("p_partkey", tx.compact(F.col("term")).alias("squeezed"))


def vocabulary(spark) -> DataFrame:
    """The curated surfaces as vocabulary, beside one corpus term."""
    return spark.createDataFrame([(s, 1) for s, _, _ in dims.exact_index_rows()] + [("thiamin mononitrate", 2)], "raw_term string, frequency int")


def normalized(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels, their parsed rows, and the decision on every distinct term: each made once and stored, as several branches read it."""
    lab = stored(labels(spark, sf), "labels")
    rows = stored(parse.extract(lab, F.col("text"), "label_id").withColumnRenamed("cleaned_text", "raw_term"), "rows")
    return lab, rows, stored(nz.normalize(rows, dims.exact_index(spark), vocabulary(spark)), "normalized")


@query()
def o52_normalize(spark, sf):
    n = normalized(spark, sf)[2]
    return n.select("raw_term", "normalized_term", "canonical_concept", "match_type", "confidence", "status", "allergen")


CONTAINS = "c(label_id, allergen, ingredient) AS (SELECT label_id, unnest(['MILK', 'SOY']), unnest(['milk', 'soy']) FROM labels WHERE kind = 'F')"


@query(f"{L}, {CONTAINS} SELECT label_id, allergen, ingredient FROM c")
def o55_contains_statement(spark, sf):
    return ev.contains_evidence(labels(spark, sf), dims.exact_index(spark)).select("label_id", "allergen", "ingredient")


def all_evidence(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels, their rows with the decisions, and all evidence."""
    index = dims.exact_index(spark)
    lab, rows, n = normalized(spark, sf)
    rows = rows.join(n, "raw_term")
    return lab, rows, stored(ev.collected(ev.contains_evidence(lab, index), ev.ingredient_evidence(rows, index)), "evidence")


def assessed(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels, all evidence, and the assessment of every label and fused allergen."""
    lab, rows, e = all_evidence(spark, sf)
    status = lab.select("label_id").join(rows.groupBy("label_id").agg(F.max(F.col("status") == "known").alias("any_known")), "label_id", "left").withColumn("any_known", F.coalesce("any_known", F.lit(False)))
    return lab, e, stored(ev.fused(status, e), "assessed")


#: What the rows say: bases that stay recognizable, be it with one letter missing, against those that only part of a term shows.
STRONG = f"""{INDEX}, strong AS (
  SELECT DISTINCT o_orderkey AS label_id, allergen FROM terms JOIN idx ON surface = lower(i) WHERE allergen IS NOT NULL AND (a IN ('blue', 'cold', 'large', 'new', 'old') OR a = 'hot' AND
    round(0.75 * 2 * (length(i) - 1) / (2 * length(i) - 1) + 0.25 * 2 * (length(replace(i, ' ', '')) - 1) / (2 * length(replace(i, ' ', '')) - 1), 4) >= 0.95)
  UNION SELECT label_id, allergen FROM c)"""


@query(f"{L}, {CONTAINS}, {STRONG} SELECT label_id, allergen FROM strong")
def o58_detected(spark, sf):
    return assessed(spark, sf)[2].filter("status = 'DETECTED'").select("label_id", "allergen")


@query()
def o57_collect_evidence(spark, sf):
    e = all_evidence(spark, sf)[2]
    return e.groupBy("allergen", "evidence_type", "strength").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query()
def o59_assess_allergens(spark, sf):
    return assessed(spark, sf)[2].groupBy("allergen", "status").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS user_id, allergen FROM (SELECT c_custkey, unnest(CASE c_custkey % 4 WHEN 0 THEN ['MILK'] WHEN 1 THEN ['SOY', 'WHEAT'] WHEN 2 THEN ['WHEAT', 'MILK', 'EGG'] ELSE []::VARCHAR[] END) AS allergen FROM customer)")
def o60_profiles(spark, sf):
    """Profiles from messy input: trimmed, upper-cased, blanks skipped."""
    raw = F.when(F.col("c_custkey") % 4 == 0, " milk ").when(F.col("c_custkey") % 4 == 1, "Soy, ,wheat").when(F.col("c_custkey") % 4 == 2, "WHEAT,milk,egg,").otherwise("")
    x = read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.explode(F.split(raw, ",")).alias("a"))
    return x.select("user_id", F.upper(F.btrim("a")).alias("allergen")).filter("allergen <> ''")


@query("""WITH s AS (SELECT p_partkey AS label_id, 'MILK' AS allergen, pos, status FROM part, (VALUES (0, 'NOT_DETECTED'), (1, 'POTENTIAL'), (2, 'DETECTED')) v(pos, status) WHERE pos <= p_partkey % 3)
SELECT label_id, max_by(status, pos) AS status, count(DISTINCT status) > 1 AS conflict FROM s GROUP BY label_id""")
def o61_conflicting_assessments(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("label_id"), F.lit("MILK").alias("allergen"))
    v = F.posexplode(F.array(F.lit("NOT_DETECTED"), F.lit("POTENTIAL"), F.lit("DETECTED"))).alias("pos", "status")
    return ev.selected(p.select("*", v).filter(F.col("pos") <= F.col("label_id") % 3)).select("label_id", "status", "conflict")


def risks(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Products (user_id, label_id) and the risk of every allergen of a user's profile, with its evidence."""
    lab, e, a = assessed(spark, sf)
    products = lab.select("user_id", "label_id")
    return products, ev.personal_risk(products.join(o60_profiles(spark, sf), "user_id"), a, e)


@query()
def o62_personal_risk(spark, sf):
    x = risks(spark, sf)[1]
    return x.select("user_id", "label_id", "allergen", "status", "risk_level", "reason", F.round("confidence", 6).alias("confidence"), "ingredients", "evidence_types", "sources", "unresolved")


@query(f"""{L}, {CONTAINS}, {STRONG}, prof AS ({ORACLES["o60_profiles"]}),
m AS (SELECT l.user_id, l.label_id, count(*) AS k FROM labels l JOIN prof p ON p.user_id = l.user_id JOIN strong s ON s.label_id = l.label_id AND s.allergen = p.allergen GROUP BY ALL)
SELECT user_id, label_id FROM m""")
def o63_high_risk_products(spark, sf):
    products, x = risks(spark, sf)
    return ev.product_risk(x, products).filter("overall_risk = 'HIGH'").select("user_id", "label_id")


@query(f"{L} SELECT user_id, label_id, 'NO_MATCH' AS overall_risk, []::VARCHAR[] AS matched, '{ev.WARNINGS['NO_MATCH']}' AS warning FROM labels WHERE user_id % 4 = 3")
def o63_empty_profiles(spark, sf):
    """Products whose user has no profile, or nothing of it assessed."""
    products, x = risks(spark, sf)
    return ev.product_risk(x, products).filter("overall_risk = 'NO_MATCH'").select("user_id", "label_id", "overall_risk", "matched", "warning")


@query(f"{L} SELECT label_id, CASE WHEN kind = 'F' THEN listing || '' ELSE regexp_replace(substring(text, 14), '[ :.-]+$', '') END AS section FROM labels")
def o72_baseline_section(spark, sf):
    u = F.upper("text")
    body = F.expr("substring(text, locate('INGREDIENTS', upper(text)) + 11)")
    x = labels(spark, sf).filter(u.contains("INGREDIENTS")).select("label_id", F.regexp_replace(body, r"(?is)CONTAINS.*$", "").alias("b"))
    return x.select("label_id", F.btrim(F.regexp_replace("b", r"\s+", " "), F.lit(" :.-")).alias("section"))


@query(f"{L} SELECT label_id, allergen FROM labels, (VALUES ('SOY'), ('MILK')) v(allergen) WHERE kind = 'F'")
def o73_baseline_contains(spark, sf):
    stated = F.regexp_extract("text", r"(?i)CONTAINS\s*:\s*(.*?)(?:\.|$)", 1)
    x = labels(spark, sf).select("label_id", stated.alias("s"), F.explode(F.array(*[F.lit(a) for a in ("WHEAT", "SOY", "MILK")])).alias("allergen"))
    return x.filter(F.expr(r"s rlike concat('(?i)\\b', allergen, '\\b')")).select("label_id", "allergen")


KEYWORDS = rf"k AS (SELECT DISTINCT label_id, allergen, keyword FROM labels JOIN rule ON regexp_matches(upper(listing), '\b' || keyword || '\b'))"


def keyword_hits(spark, sf):
    rules = F.broadcast(dims.synonyms(spark, dims.BASELINE).select("allergen", F.col("synonym").alias("keyword")))
    return labels(spark, sf).join(rules, F.expr(r"upper(listing) rlike concat('\\b', keyword, '\\b')"))


@query(f"{L}, {BASE}, {KEYWORDS} SELECT label_id, allergen, string_agg(keyword, ',' ORDER BY keyword) AS matches FROM k GROUP BY label_id, allergen")
def o74_baseline_keywords(spark, sf):
    g = keyword_hits(spark, sf).groupBy("label_id", "allergen").agg(F.sort_array(F.collect_set("keyword")).alias("k"))
    return g.select("label_id", "allergen", F.array_join("k", ",").alias("matches"))


def baseline(spark, sf):
    hits = keyword_hits(spark, sf).select("label_id", "allergen").union(o73_baseline_contains(spark, sf)).distinct().withColumn("hit", F.lit(True))
    x = labels(spark, sf).select("label_id", F.explode(F.array(*[F.lit(a) for a in dims.BASELINE])).alias("allergen"))
    return x.join(hits, ["label_id", "allergen"], "left").select("label_id", "allergen", F.when(F.col("hit"), "CONFIRMED").otherwise("NOT_DETECTED").alias("status"))


CONFIRMED = f"{BASE}, {KEYWORDS}, conf AS (SELECT label_id, allergen FROM k UNION SELECT label_id, allergen FROM labels, (VALUES ('SOY'), ('MILK')) v(allergen) WHERE kind = 'F')"


@query(f"{L}, {CONFIRMED} SELECT allergen, count(*) AS confirmed FROM conf GROUP BY allergen")
def o75_baseline_status(spark, sf):
    return baseline(spark, sf).filter("status = 'CONFIRMED'").groupBy("allergen").agg(F.count("*").alias("confirmed"))


WIDE = ", ".join(f"CASE WHEN bool_or(conf.allergen = '{a}') THEN 'CONFIRMED' ELSE 'NOT_DETECTED' END AS {a}_status" for a in dims.BASELINE)


@query(f"{L}, {CONFIRMED} SELECT labels.label_id, {WIDE} FROM labels LEFT JOIN conf ON conf.label_id = labels.label_id GROUP BY labels.label_id")
def o76_wide_status(spark, sf):
    x = baseline(spark, sf).groupBy("label_id").pivot("allergen", list(dims.BASELINE)).agg(F.first("status"))
    return x.select("label_id", *[F.col(a).alias(f"{a}_status") for a in dims.BASELINE])


def truth(spark, sf):
    """(label_id, allergen): base allergens of a label's parts."""
    x = label_lines(spark, sf).select(F.col("o_orderkey").alias("label_id"), F.lower("i").alias("surface"))
    return x.join(F.broadcast(dims.exact_index(spark).filter("allergen is not null")), "surface").select("label_id", "allergen").distinct()


def judged(spark, sf):
    t = truth(spark, sf).withColumn("truth", F.lit(True))
    return baseline(spark, sf).join(t, ["label_id", "allergen"], "left").select("label_id", "allergen", (F.col("status") == "CONFIRMED").alias("p"), F.coalesce("truth", F.lit(False)).alias("t"))


JUDGED = f"""{CONFIRMED}, {INDEX}, tr AS (SELECT DISTINCT o_orderkey AS label_id, allergen FROM terms JOIN idx ON surface = lower(i) WHERE allergen IS NOT NULL),
g AS (SELECT label_id, allergen FROM labels, (VALUES ('WHEAT'), ('SOY'), ('MILK')) v(allergen)),
j AS (SELECT g.label_id, g.allergen, conf.label_id IS NOT NULL AS p, tr.label_id IS NOT NULL AS t FROM g LEFT JOIN conf ON conf.label_id = g.label_id AND conf.allergen = g.allergen LEFT JOIN tr ON tr.label_id = g.label_id AND tr.allergen = g.allergen)"""
COUNTS = "count_if(p AND t) AS tp, count_if(NOT p AND NOT t) AS tn, count_if(p AND NOT t) AS fp, count_if(NOT p AND t) AS fn"
RATES = "round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 4) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 4) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 4) AS f1"


def confusion():
    c = lambda e: F.count_if(F.expr(e))
    return [c("p and t").alias("tp"), c("not p and not t").alias("tn"), c("p and not t").alias("fp"), c("not p and t").alias("fn")]


def rates(x: DataFrame) -> DataFrame:
    part = lambda a, b: F.round(F.when(b == 0, 0.0).otherwise(a / b), 4)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return x.select("*", part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query(f"{L}, {JUDGED} SELECT *, {RATES} FROM (SELECT allergen, {COUNTS} FROM j GROUP BY allergen)")
def o82_confusion_per_allergen(spark, sf):
    return rates(judged(spark, sf).groupBy("allergen").agg(*confusion()))


@query(f"{L}, {JUDGED} SELECT *, {RATES} FROM (SELECT coalesce(allergen, 'OVERALL') AS allergen, {COUNTS} FROM j GROUP BY GROUPING SETS ((allergen), ()))")
def o83_micro_metrics(spark, sf):
    x = judged(spark, sf).rollup("allergen").agg(*confusion())
    return rates(x.withColumn("allergen", F.coalesce("allergen", F.lit("OVERALL"))))


@query(f"{L}, {JUDGED} SELECT round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(f1), 4) AS f1 FROM (SELECT *, {RATES} FROM (SELECT allergen, {COUNTS} FROM j GROUP BY allergen))")
def o84_macro_average(spark, sf):
    return o82_confusion_per_allergen(spark, sf).agg(*[F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1")])


@query()
def o85_normalization_coverage(spark, sf):
    _, rows, n = normalized(spark, sf)
    g = rows.join(n, "raw_term").groupBy("status", "match_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    return g.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))), 4))


from . import more  # noqa: E402, F401  (registers the other queries)
