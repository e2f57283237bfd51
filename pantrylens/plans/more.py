"""Registered queries of sources, sinks, parser steps, the nine-allergen engine, the service and the evaluation.

Row-level steps are given awkward inputs: every part takes one of a few fixed
cases by its key, and the SQL states the outcome of every case.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..functions import text as tx
from ..functions.similarity import ratio, token_sort_similarity, weighted_similarity
from ..operators import evidence as ev
from ..operators import nine, parse
from ..operators import normalize as nz
from ..sources import files
from .labels import label_lines, labels, part_terms, read
from .queries import INDEX, NINE, ORACLES, QUERIES, L, o60_profiles, query, vocabulary


def by_case(spark, sf, inputs: list) -> DataFrame:
    """(p_partkey, x): every part with one of the inputs, by its key."""
    x = F.element_at(F.array(*[F.lit(i) for i in inputs]), (F.col("p_partkey") % len(inputs) + 1).cast("int"))
    return read(spark, sf, "part").select("p_partkey", x.alias("x"))


def cases(rows: list[tuple], *columns: str) -> str:
    """CTE k of one row per case: c and the expected columns; None stands for no row."""
    return f"k(c, {', '.join(columns)}) AS ({dims.sql_values([(i, *r) for i, r in enumerate(rows)])})"


def listed(name: str, inputs: list, expected: list, function) -> None:
    """A query p_partkey, items of a list function over cases."""

    def run(spark, sf):
        return by_case(spark, sf, inputs).select("p_partkey", function(F.col("x")).alias("items"))

    run.__name__ = name
    query(f"WITH {cases([(e,) for e in expected], 'items')} SELECT p_partkey, items FROM part JOIN k ON c = p_partkey % {len(inputs)}")(run)


# --- sources and sinks ------------------------------------------------------------------


@query(f"{L} SELECT p_partkey, term AS text FROM parts")
def o01_corpus_load(spark, sf):
    x = part_terms(spark, sf).select(F.col("p_partkey").cast("string"), F.col("term").alias(" Ingredients_Text "))
    corpus = files.load_corpus(spark, files.write_csv(x, files.new_file(spark, "corpus")))
    return corpus.select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col(f"`{files.text_column(corpus.columns)}`").alias("text"))


@query(f"{L}, v AS (SELECT CASE WHEN a = 'small' THEN NULL ELSE lower(term) END AS raw_term FROM parts) SELECT raw_term, count(*) AS frequency FROM v WHERE raw_term IS NOT NULL GROUP BY 1")
def o03_vocabulary_terms(spark, sf):
    x = part_terms(spark, sf).groupBy(F.when(F.col("a") != "small", F.lower("term")).alias("raw_term")).agg(F.count("*").cast("int").alias("frequency"))
    v = files.load_vocabulary(spark, files.write_csv(x, files.new_file(spark, "vocabulary")))
    return v.join(files.vocabulary_terms(v), "raw_term").select("raw_term", F.col("frequency").cast("long").alias("frequency"))


TRUTHS = [None, "", "  ", "milk", " Soy , ,wheat,", "MILK,milk"]


def ground_truth(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    x = by_case(spark, sf, TRUTHS).select(
        F.concat(F.lit('a "b",\n'), k.cast("string")).alias("image"), (k % 2 == 0).alias("valid_food_label"), (k % 3 == 0).alias("ingredient_list_available"), (k % 5 == 0).alias("contains_statement_available"),
        F.col("x").alias("ground_truth_allergens"), F.element_at(F.array(*[F.lit(s) for s in ("VERIFIED", "UNCERTAIN", "EXCLUDED")]), (k % 3 + 1).cast("int")).alias("annotation_status"), F.lit("seen, by hand").alias("annotation_source"),
    )
    return files.load_ground_truth(spark, files.write_csv(x, files.new_file(spark, "truth")))


TRUTH_SQL = f"""{cases([([],), ([],), ([],), (["MILK"],), (["SOY", "WHEAT"],), (["MILK", "MILK"],)], "allergens")},
g AS (SELECT 'a "b",' || chr(10) || p_partkey AS image, p_partkey % 2 = 0 AS valid_food_label, p_partkey % 3 = 0 AS ingredient_list_available, p_partkey % 5 = 0 AS contains_statement_available,
  CASE p_partkey % 3 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'UNCERTAIN' ELSE 'EXCLUDED' END AS annotation_status, 'seen, by hand' AS annotation_source, allergens, p_partkey FROM part JOIN k ON c = p_partkey % 6)"""


@query(f"WITH {TRUTH_SQL} SELECT * EXCLUDE (p_partkey) FROM g")
def o04_ground_truth(spark, sf):
    return ground_truth(spark, sf)


def ocr_results(spark, sf) -> DataFrame:
    e = F.col("event_id")
    x = read(spark, sf, "events").select(e.cast("string").alias("image"), (e % 90).cast("int").alias("ocr_regions"), F.round(e % 1000 / 1000, 4).alias("avg_confidence"), (e % 2 == 0).alias("ingredients_detected"), F.lit(False).alias("contains_detected"), F.col("props").alias("ocr_text"))
    return files.load_ocr_results(spark, files.write_csv(x, files.new_file(spark, "ocr")))


@query("SELECT event_id::VARCHAR AS image, (event_id % 90)::INT AS ocr_regions, round((event_id % 1000) / 1000, 4) AS avg_confidence, event_id % 2 = 0 AS ingredients_detected, false AS contains_detected, props AS ocr_text FROM events")
def o05_result_tables(spark, sf):
    return ocr_results(spark, sf)


@query(f"{L}, v AS (SELECT lower(term) AS raw_term, count(*)::INT AS frequency FROM parts GROUP BY 1) SELECT '\"' || raw_term || '\",\"' || frequency || '\"' AS line FROM v UNION ALL SELECT '\"raw_term\",\"frequency\"'")
def o06_csv_sink(spark, sf):
    """The lines of the vocabulary file; its header comes with every part file and counts once."""
    v = part_terms(spark, sf).groupBy(F.lower("term").alias("raw_term")).agg(F.count("*").cast("int").alias("frequency"))
    lines = spark.read.text(files.save_vocabulary(v, files.new_file(spark, "saved"))).select(F.col("value").alias("line"))
    header = '"raw_term","frequency"'
    return lines.filter(F.col("line") != header).unionByName(lines.filter(F.col("line") == header).distinct())


def predictions(spark, sf) -> str:
    x = part_terms(spark, sf)
    one = F.struct(F.lit("MILK").alias("allergen"), F.when(F.col("i") == "MILK", "DETECTED").otherwise("NOT_DETECTED").alias("status"), F.when(F.col("i") == "MILK", 1.0).otherwise(0.5).alias("confidence"))
    x = x.select(F.col("p_partkey").cast("string").alias("image"), F.col("term").alias("ocr_text"), F.split("i", " ").alias("ingredients"), F.array(one).alias("allergen_assessments"))
    return files.write_json(x, files.new_file(spark, "predictions"))


@query(f"""{L} SELECT '{{"image":"' || p_partkey || '","ocr_text":"' || term || '","ingredients":["' || replace(i, ' ', '","') || '"],"allergen_assessments":[{{"allergen":"MILK","status":"'
  || CASE i WHEN 'MILK' THEN 'DETECTED","confidence":1.0' ELSE 'NOT_DETECTED","confidence":0.5' END || '}}]}}' AS line FROM parts""")
def o07_json_sink(spark, sf):
    return spark.read.text(predictions(spark, sf)).select(F.col("value").alias("line"))


@query(f"{L} SELECT p_partkey::VARCHAR AS image, len(string_split(i, ' '))::BIGINT AS n_ingredients, 'MILK' AS allergen, CASE i WHEN 'MILK' THEN 'DETECTED' ELSE 'NOT_DETECTED' END AS status FROM parts")
def o08_json_source(spark, sf):
    x = files.load_predictions(spark, predictions(spark, sf)).withColumn("a", F.explode("allergen_assessments"))
    return x.select("image", F.size("ingredients").cast("long").alias("n_ingredients"), "a.allergen", "a.status")


@query(f"""WITH m AS ({ORACLES["o82_confusion_per_allergen"]}), r AS (SELECT row_number() OVER (ORDER BY allergen) + 1 AS pos, * FROM m)
SELECT pos::INT AS pos, '| ' || concat_ws(' | ', allergen, tp, tn, fp, fn, precision, recall, f1) || ' |' AS line FROM r
UNION ALL SELECT 0, '| allergen | tp | tn | fp | fn | precision | recall | f1 |' UNION ALL SELECT 1, '|---|---|---|---|---|---|---|---|'""")
def o09_markdown_report(spark, sf):
    return files.markdown_table(QUERIES["o82_confusion_per_allergen"](spark, sf), "allergen")


MAPS = ["{'MILK': ['whey', 'milk'], 'SOY': ['soy lecithin']}", None, "not a map", "{}", "{'WHEAT': []}"]


@query(f"WITH {cases([(['MILK', 'SOY'], 3), ([], 0), ([], 0), ([], 0), (['WHEAT'], 0)], 'allergens', 'n')} SELECT p_partkey, allergens, n::INT AS n_terms FROM part JOIN k ON c = p_partkey % 5")
def o11_evidence_map_parse(spark, sf):
    m = F.coalesce(F.from_json("x", "map<string,array<string>>"), F.create_map().cast("map<string,array<string>>"))
    return by_case(spark, sf, MAPS).select("p_partkey", F.sort_array(F.map_keys(m)).alias("allergens"), F.size(F.flatten(F.map_values(m))).alias("n_terms"))


@query("SELECT user_id, round(avg(value), 4) AS avg_confidence, count(*) AS region_count, 'user ' || user_id AS selected_image FROM events GROUP BY user_id")
def o17_ocr_summary(spark, sf):
    g = read(spark, sf, "events").groupBy("user_id").agg(F.avg("value").alias("confidence"), F.count("*").alias("region_count"))
    return g.select("user_id", F.round("confidence", 4).alias("avg_confidence"), "region_count", F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("selected_image"))


# --- parser and vocabulary steps ----------------------------------------------------------

listed("o24_comma_split", ["A, B (C, D), E", "A), B, C", "A (B, C", " , ,A,, ", "A [B, C], D", ""], [["A", "B (C, D)", "E"], ["A)", "B", "C"], ["A (B, C"], ["A"], ["A [B", "C]", "D"], []], parse.split_round)
listed("o28_and_or_expansion", ["SUNFLOWER AND/OR SAFFLOWER and/or CANOLA OIL", "A AND/OR B", "SALT", "PALM OIL"], [["SUNFLOWER OIL", "SAFFLOWER OIL", "CANOLA OIL"], ["A", "B"], ["SALT"], ["PALM OIL"]], parse.either)
listed("o33_split_outside_brackets", ["A [B, C], D", "A (B], C), D", "A, [B (C, D), E], F", "A], B", ""], [["A [B, C]", "D"], ["A (B], C)", "D"], ["A", "[B (C, D), E]", "F"], ["A]", "B"], []], parse.split_any)
listed("o34_balanced_groups", ["a (b [c, d]) e [f]", "a (b", "a) b", "((a))", "a"], [["(b [c, d])", "[f]"], [], [], ["((a))"], []], parse.groups)
listed("o36_recursive_flatten", ["Enriched Flour (Wheat Flour, Niacin)", "soy lecithin (emulsifier)", "a (b [c, d], a)", "5 % milk;", "folic acid (vitamin b9)"], [["enriched flour", "wheat flour", "niacin"], ["soy lecithin"], ["a", "b", "c", "d"], ["milk"], ["folic acid"]], parse.flat_terms)

PREFIXED = ["BEST BY MILK.", "FOR BEST WHEN USED BY 5 % FLOUR:", "SELL BY SUGAR", "5 % SALT ;", "SALT", "BEST BY SELL BY X"]


@query(f"WITH {cases([('MILK',), ('FLOUR',), ('SUGAR',), ('SALT',), ('SALT',), ('SELL BY X',)], 'stripped')} SELECT p_partkey, stripped FROM part JOIN k ON c = p_partkey % 6")
def o26_packaging_prefix(spark, sf):
    return by_case(spark, sf, PREFIXED).select("p_partkey", tx.strip_prefix(F.col("x")).alias("stripped"))


NESTED = ["FLOUR: (WHEAT, NIACIN)", "A (B) C (D)", "BEST BY MILK. (X)", "(B, C)", "A (B (C, D), E", "SALT"]
ROWS = [
    ["FLOUR<", "WHEAT<FLOUR", "NIACIN<FLOUR"], ["A<", "B) C<A", "D<B) C"], ["MILK<", "X<MILK"], ["B<", "C<"], ["A<", "B<A", "C<B", "D<B"], ["SALT<"],
]


@query(f"WITH {cases([(r,) for r in ROWS], 'items')} SELECT p_partkey, unnest(items) AS item FROM part JOIN k ON c = p_partkey % 6")
def o27_parent_child_parse(spark, sf):
    x = by_case(spark, sf, NESTED).select("p_partkey", F.explode(parse.parsed_term(F.col("x"))).alias("r"))
    return x.select("p_partkey", F.concat("r.cleaned_text", F.lit("<"), F.coalesce("r.parent", F.lit(""))).alias("item"))


HEADERS = [["id", " Ingredients "], ["ingredient", "INGREDIENTS_TEXT"], ["Ingredient_List", "ingredients_list"]]


@query("SELECT * FROM (VALUES (' Ingredients ', 1), ('INGREDIENTS_TEXT', 1), ('Ingredient_List', 1)) v(found, n)")
def o31_text_column(spark, sf):
    one = read(spark, sf, "part").limit(1).select(F.col("p_name").alias("x"))
    frames = [one.select(*[F.col("x").alias(c) for c in h]) for h in HEADERS]
    return spark.createDataFrame([(files.text_column(f.columns), 1) for f in frames], "found string, n int")


@query(f"WITH {cases([(True,), (True,), (True,), (False,), (False,)], 'remark')} SELECT p_partkey, remark FROM part JOIN k ON c = p_partkey % 5")
def o35_explanatory(spark, sf):
    x = F.col("x")
    return by_case(spark, sf, ["emulsifier", "vitamin c", "source of iron", "soy", "provitamin"]).select("p_partkey", (x.isin(list(dims.REMARKS)) | x.startswith("vitamin ") | x.startswith("source of ")).alias("remark"))


TEXTS = ["", "x" * 201, "x" * 200, "milk", "distributed by acme", "see www.acme.example", "skus"]


@query(f"WITH {cases([(False,), (False,), (True,), (True,), (False,), (False,), (True,)], 'kept')} SELECT p_partkey, kept FROM part JOIN k ON c = p_partkey % 7")
def o37_metadata_filter(spark, sf):
    return by_case(spark, sf, TEXTS).select("p_partkey", tx.looks_like_ingredient(F.col("x")).alias("kept"))


# --- normalization ------------------------------------------------------------------------


@query(f"{L}, {INDEX} SELECT concept, allergen, count(*) AS n FROM terms JOIN idx ON surface = lower(i) WHERE a IN ('blue', 'large') OR a = 'cold' AND i <> 'SOY LECITHIN' GROUP BY ALL")
def o42_curated_exact(spark, sf):
    """All terms; those that match are the whole ones, and squeezed ones that end in flour or oil."""
    x = label_lines(spark, sf).select(tx.normal_form(tx.clean_term(F.col("term"))).alias("cleaned"))
    return nz.curated(x, dims.exact_index(spark)).filter("concept is not null").groupBy("concept", "allergen").agg(F.count("*").alias("n"))


VOCAB = f"{INDEX}, vocab AS (SELECT surface AS candidate, 1 AS frequency FROM idx UNION ALL SELECT 'thiamin mononitrate', 2)"
SQUEEZE = "regexp_replace({}, '[^a-z0-9]', '', 'g')"


@query(f"WITH {VOCAB} SELECT candidate, frequency, {SQUEEZE.format('candidate')} AS squeezed, unnest(string_split(candidate, ' ')) AS token FROM vocab")
def o44_vocabulary_index(spark, sf):
    """The index of a vocabulary file, beside that of a file that isn't there, which is empty."""
    path = files.save_vocabulary(vocabulary(spark), files.new_file(spark, "vocabulary"))
    absent = nz.vocabulary_index(files.load_vocabulary(spark, path + "-absent", missing_ok=True))
    return nz.vocabulary_index(files.load_vocabulary(spark, path)).unionByName(absent).select("candidate", "frequency", "squeezed", "token")


@query(f"{L}, {INDEX} SELECT DISTINCT lower(term) AS cleaned, surface AS candidate FROM parts JOIN idx ON replace(surface, ' ', '') = replace(lower(term), ' ', '')")
def o45_compact_exact(spark, sf):
    x = part_terms(spark, sf).select(F.lower("term").alias("cleaned")).distinct()
    return nz.candidates(x, nz.vocabulary_index(vocabulary(spark))).filter("match_method = 'compact_exact'").select("cleaned", "candidate")


WHOLE = "t AS (SELECT DISTINCT lower(term) AS cleaned FROM parts)"
BLOCKS = f"""{VOCAB}, {WHOLE}, tok AS (SELECT DISTINCT candidate, unnest(string_split(candidate, ' ')) AS token FROM vocab),
sh AS (SELECT DISTINCT cleaned, candidate FROM (SELECT cleaned, unnest(string_split(cleaned, ' ')) AS token FROM t) JOIN tok USING (token)),
blk AS (SELECT * FROM sh UNION SELECT cleaned, candidate FROM t JOIN vocab ON cleaned[1] = candidate[1] WHERE cleaned NOT IN (SELECT cleaned FROM sh))"""


@query(f"{L}, {BLOCKS} SELECT cleaned, candidate FROM blk")
def o46_blocking(spark, sf):
    x = part_terms(spark, sf).select(F.lower("term").alias("cleaned")).distinct()
    return nz.blocked_pairs(x, nz.vocabulary_index(vocabulary(spark))).select("cleaned", "candidate")


def similar(pairs: str) -> str:
    """CTEs that give sim(a, b, w, t): the weighted and the token-sort similarity of the pairs (a, b), by the table of common subsequences, a row a character."""
    sort = "array_to_string(list_sort(string_split({}, ' ')), ' ')"
    return f"""prs AS ({pairs}),
every AS (SELECT a AS p, b AS q FROM prs UNION SELECT {sort.format("a")}, {sort.format("b")} FROM prs UNION SELECT {SQUEEZE.format("lower(a)")}, {SQUEEZE.format("lower(b)")} FROM prs),
step AS (SELECT p, q, 0 AS i, list_transform(range(0, length(q) + 1), lambda x: 0::BIGINT) AS r FROM every UNION ALL
  SELECT p, q, i + 1, list_reduce(list_prepend([0::BIGINT], list_transform(range(1, length(q) + 1), lambda j: [j])), lambda acc, e: list_append(acc, greatest(acc[-1], r[e[1] + 1], r[e[1]] + CASE WHEN p[i + 1] = q[e[1]] THEN 1 ELSE 0 END))) FROM step WHERE i < length(p)),
rt AS (SELECT p, q, CASE WHEN length(p) + length(q) = 0 THEN 1.0::DOUBLE ELSE 2 * r[-1] / (length(p) + length(q))::DOUBLE END AS x FROM step WHERE i = length(p)),
sim AS (SELECT a, b, round(0.45::DOUBLE * u.x + 0.30::DOUBLE * v.x + 0.25::DOUBLE * w.x, 4) AS w, CASE WHEN a = b THEN 100.0::DOUBLE ELSE 100 * v.x END AS t FROM prs JOIN rt u ON u.p = a AND u.q = b
  JOIN rt v ON v.p = {sort.format("a")} AND v.q = {sort.format("b")} JOIN rt w ON w.p = {SQUEEZE.format("lower(a)")} AND w.q = {SQUEEZE.format("lower(b)")})"""


R = L.replace("WITH", "WITH RECURSIVE", 1)


@query(f"{R}, {similar('SELECT DISTINCT lower(term) AS a, lower(i) AS b FROM parts')} SELECT a, b, w AS similarity FROM sim")
def o47_weighted_similarity(spark, sf):
    x = part_terms(spark, sf).select(F.lower("term").alias("a"), F.lower("i").alias("b")).distinct()
    return x.select("a", "b", weighted_similarity(F.col("a"), F.col("b")).alias("similarity"))


TOP = f"""{BLOCKS}, ex AS (SELECT cleaned, min(candidate) AS candidate FROM t JOIN vocab ON {SQUEEZE.format("cleaned")} = {SQUEEZE.format("candidate")} GROUP BY cleaned),
{similar("SELECT cleaned AS a, candidate AS b FROM blk WHERE cleaned NOT IN (SELECT cleaned FROM ex)")},
top AS (SELECT a AS cleaned, b AS candidate, w AS similarity, row_number() OVER (PARTITION BY a ORDER BY w DESC, frequency DESC, b) AS rank FROM sim JOIN vocab ON candidate = b
  UNION ALL SELECT cleaned, candidate, 1.0, 1 FROM ex)"""


@query(f"{R}, {TOP} SELECT cleaned, candidate, similarity, rank::INT AS rank FROM top WHERE rank <= 5")
def o48_blocked_top_candidates(spark, sf):
    x = part_terms(spark, sf).select(F.lower("term").alias("cleaned")).distinct()
    return nz.candidates(x, nz.vocabulary_index(vocabulary(spark))).select("cleaned", "candidate", "similarity", "rank")


@query(f"{R}, {TOP} SELECT cleaned, max(CASE rank WHEN 1 THEN candidate END) AS candidate, max(CASE rank WHEN 1 THEN similarity END) AS similarity, max(CASE rank WHEN 1 THEN similarity END) >= 0.9 AS accepted, coalesce(list(candidate ORDER BY rank) FILTER (rank > 1), []) AS alternatives FROM top WHERE rank <= 5 GROUP BY cleaned")
def o49_dataset_match(spark, sf):
    x = part_terms(spark, sf).select(F.lower("term").alias("cleaned")).distinct()
    return nz.dataset_match(x, nz.vocabulary_index(vocabulary(spark))).select("cleaned", "candidate", "similarity", "accepted", "alternatives")


#: Rows of every label with their order, the decision on every distinct one, and the evidence, all from the rows that make the labels.
NORMAL = "trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(raw_term), '[\\[({].*$', ''), '[^\\w\\s-]', ' ', 'g')), '([a-z])(flour|chips|oil)\\b', '\\1 \\2', 'g'), '\\s+', ' ', 'g'))"
DECIDED = f"""rowp AS (SELECT o_orderkey AS label_id, pos * 10 AS o, CASE a WHEN 'large' THEN i WHEN 'new' THEN 'BLEND' WHEN 'old' THEN 'MIX' ELSE term END AS raw_term, 'top_level' AS level FROM terms
  UNION ALL SELECT o_orderkey, pos * 10 + 1, i, 'nested' FROM terms WHERE a IN ('new', 'old') UNION ALL SELECT o_orderkey, pos * 10 + 2, 'SALT', 'nested' FROM terms WHERE a = 'new'),
cl AS (SELECT raw_term, {NORMAL} AS cl FROM (SELECT DISTINCT raw_term FROM rowp)),
{TOP.replace(WHOLE, "t AS (SELECT DISTINCT cl AS cleaned FROM cl WHERE cl NOT IN (SELECT surface FROM idx))")},
sg AS (SELECT cl, arg_max(surface, length(surface)) AS segment FROM cl JOIN idx ON contains(' ' || cl || ' ', ' ' || surface || ' ') AND contains(surface, ' ') GROUP BY cl),
m AS (SELECT raw_term, cl, segment, candidate, similarity, CASE WHEN surface IS NOT NULL THEN 'curated_exact' WHEN candidate IN (SELECT candidate FROM ex WHERE cleaned = cl) THEN 'dataset_exact' WHEN similarity >= 0.9 THEN 'dataset_fuzzy'
  WHEN segment IS NOT NULL THEN 'partial_match' WHEN similarity >= 0.7 THEN 'dataset_candidate' ELSE 'no_match' END AS match_type FROM cl LEFT JOIN idx ON surface = cl LEFT JOIN top ON cleaned = cl AND rank = 1 LEFT JOIN sg USING (cl)),
nm AS (SELECT raw_term, match_type, segment, CASE WHEN match_type = 'curated_exact' THEN cl WHEN match_type LIKE 'dataset%' THEN candidate END AS normalized_term, CASE WHEN match_type IN ('curated_exact', 'partial_match') THEN 1.0 WHEN match_type LIKE 'dataset%' THEN similarity ELSE 0.0 END::DOUBLE AS confidence,
  CASE match_type WHEN 'partial_match' THEN 'ambiguous' WHEN 'dataset_candidate' THEN 'candidate' WHEN 'no_match' THEN 'unknown' ELSE 'known' END AS status FROM m),
dec AS (SELECT nm.*, coalesce(concept, normalized_term) AS canonical_concept, allergen FROM nm LEFT JOIN idx ON surface = normalized_term),
eviden AS (SELECT label_id, 0 AS stage, o, allergen, ingredient, 'CONTAINS_STATEMENT' AS evidence_type, 'label_contains_statement' AS source, 1.0::DOUBLE AS confidence, 'strong' AS strength, allergen AS supporting_text FROM (SELECT label_id, unnest([0, 1]) AS o, unnest(['MILK', 'SOY']) AS allergen, unnest(['milk', 'soy']) AS ingredient FROM labels WHERE kind = 'F')
  UNION ALL SELECT label_id, 1, min(o), allergen, normalized_term, CASE WHEN status = 'candidate' THEN 'FUZZY_NORMALIZATION' WHEN arg_min(level, o) = 'nested' THEN 'NESTED_INGREDIENT' WHEN normalized_term = canonical_concept THEN 'DIRECT_INGREDIENT' ELSE 'NORMALIZED_INGREDIENT' END, 'ingredient_list', confidence,
    CASE status WHEN 'known' THEN 'strong' ELSE 'weak' END, raw_term FROM rowp JOIN dec USING (raw_term) WHERE allergen IS NOT NULL AND status IN ('known', 'candidate') GROUP BY label_id, allergen, normalized_term, canonical_concept, status, confidence, raw_term
  UNION ALL SELECT label_id, 1, min(o), idx.allergen, segment, 'PARTIAL_MATCH', 'ingredient_list', 0.75, 'weak', raw_term FROM rowp JOIN dec USING (raw_term) JOIN idx ON surface = segment WHERE status = 'ambiguous' AND idx.allergen IS NOT NULL GROUP BY label_id, idx.allergen, segment, raw_term),
knows AS (SELECT label_id, bool_or(status = 'known') AS any_known FROM rowp JOIN dec USING (raw_term) GROUP BY label_id),
fuse AS (SELECT label_id, allergen, count(*) AS n, max(confidence) AS top_c, count(DISTINCT ingredient || '|' || source) AS kinds, bool_or(strength = 'strong' AND confidence >= 0.95) AS sure FROM eviden GROUP BY ALL),
assess AS (SELECT label_id, g.allergen, CASE WHEN sure THEN 'DETECTED' WHEN n IS NOT NULL THEN 'POTENTIAL' WHEN any_known THEN 'NOT_DETECTED' ELSE 'INSUFFICIENT_EVIDENCE' END AS status, coalesce(least(1.0, top_c + 0.02 * (kinds - 1)), 0.0)::DOUBLE AS confidence
  FROM labels LEFT JOIN knows USING (label_id) CROSS JOIN (SELECT unnest(['MILK', 'SOY', 'WHEAT']) AS allergen) g LEFT JOIN fuse USING (label_id, allergen))"""


def in_order(column: str, condition: str = "true") -> str:
    """CTE l_column: the distinct values of a label's and allergen's evidence in order."""
    return f"l_{column} AS (SELECT label_id, allergen, list({column} ORDER BY x) AS {column} FROM (SELECT label_id, allergen, {column}, min((stage, o)) AS x FROM eviden WHERE {condition} GROUP BY ALL) GROUP BY ALL)"


def reason_sql() -> str:
    who = lambda level: "upper(p.allergen[1]) || lower(p.allergen[2:])" if level in ("HIGH", "MEDIUM") else "lower(p.allergen)"
    return "CASE risk_level " + " ".join(f"WHEN '{k}' THEN '" + v.replace("'", "''").replace("{}", f"' || {who(k)} || '") + "'" for k, v in ev.REASONS.items()) + " END"


DECISIONS = {
    "o52_normalize": f"{R}, {DECIDED} SELECT raw_term, normalized_term, canonical_concept, match_type, confidence, status, allergen FROM dec",
    "o57_collect_evidence": f"{R}, {DECIDED} SELECT allergen, evidence_type, strength, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM eviden GROUP BY ALL",
    "o59_assess_allergens": f"{R}, {DECIDED} SELECT allergen, status, count(*) AS n FROM assess GROUP BY ALL",
    "o62_personal_risk": f"""{R}, {DECIDED}, prof AS ({ORACLES["o60_profiles"]}), {in_order("ingredient")}, {in_order("evidence_type")}, {in_order("source")}, {in_order("supporting_text", "evidence_type = 'PARTIAL_MATCH'")},
p AS (SELECT user_id, label_id, prof.allergen, coalesce(status, 'NOT_ASSESSED') AS status, coalesce(round(confidence, 6), 0.0)::DOUBLE AS confidence, CASE status WHEN 'DETECTED' THEN 'HIGH' WHEN 'POTENTIAL' THEN 'MEDIUM' WHEN 'NOT_DETECTED' THEN 'LOW' WHEN 'INSUFFICIENT_EVIDENCE' THEN 'INSUFFICIENT_EVIDENCE' ELSE 'NO_MATCH' END AS risk_level
  FROM labels JOIN prof USING (user_id) LEFT JOIN assess USING (label_id, allergen))
SELECT user_id, label_id, allergen, status, risk_level, {reason_sql()} AS reason, confidence, coalesce(ingredient, []) AS ingredients, coalesce(evidence_type, []) AS evidence_types, coalesce(source, []) AS sources, coalesce(supporting_text, []) AS unresolved
FROM p LEFT JOIN l_ingredient USING (label_id, allergen) LEFT JOIN l_evidence_type USING (label_id, allergen) LEFT JOIN l_source USING (label_id, allergen) LEFT JOIN l_supporting_text USING (label_id, allergen)""",
    "o85_normalization_coverage": f"""{R}, {DECIDED}, u AS (SELECT DISTINCT label_id, raw_term, level, CASE WHEN level = 'nested' AND raw_term = 'SALT' AND o % 10 = 2 THEN 'BLEND' WHEN level = 'nested' THEN a END AS parent, src
  FROM (SELECT rowp.*, CASE terms.a WHEN 'new' THEN 'BLEND' WHEN 'old' THEN 'MIX' END AS a, CASE WHEN level = 'top_level' AND terms.a IN ('new', 'old') THEN term ELSE '' END AS src FROM rowp JOIN terms ON o_orderkey = label_id AND pos = o // 10))
SELECT status, match_type, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(100 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM u JOIN dec USING (raw_term) GROUP BY status, match_type""",
}
ORACLES |= DECISIONS

FORMS = [(s.lower(), a) for a, names in dims.ALLERGEN_FORMS.items() for s in names]
CLOSE = f"""{similar("SELECT DISTINCT lower(term) AS a, form AS b FROM parts, forms")}"""


@query(f"{R}, forms(form, allergen) AS ({dims.sql_values(FORMS)}), {CLOSE}, c AS (SELECT a, b, x FROM sim JOIN rt ON p = a AND q = b WHERE 100 * x >= 85) SELECT a AS term, arg_max(b, (x, b)) AS matched_term, round(100 * max(x), 6) AS score FROM c GROUP BY a")
def o50_curated_fuzzy(spark, sf):
    """The most similar of the fixed allergen forms, at 85 of 100 or more; ties go to the last by name."""
    forms = F.broadcast(spark.createDataFrame(FORMS, "form string, allergen string"))
    a, b = F.length("term"), F.length("form")
    x = part_terms(spark, sf).select(F.lower("term").alias("term")).distinct().join(forms, 200 * F.least(a, b) >= 85 * (a + b))

    @F.arrow_udf(T.DoubleType())
    def score(p: pa.Array, q: pa.Array) -> pa.Array:
        return pa.array([100 * ratio(u, v) for u, v in zip(p.to_pylist(), q.to_pylist(), strict=True)], pa.float64())

    x = x.withColumn("score", score(F.col("term"), F.col("form"))).filter("score >= 85")
    return x.groupBy("term").agg(F.max_by("form", F.struct("score", "form")).alias("matched_term"), F.round(F.max("score"), 6).alias("score"))


@query(f"{L} SELECT DISTINCT lower(term) AS cleaned, CASE WHEN a IN ('large', 'red') THEN 1 ELSE 0 END AS s, CASE a WHEN 'cold' THEN lower(term) ELSE lower(i) END AS segment, lower(i) AS known, CASE WHEN a = 'cold' AND contains(i, ' ') THEN 0.95 ELSE 1.0 END::DOUBLE AS confidence FROM parts WHERE a IN ('blue', 'cold', 'large', 'red')")
def o51_segmentation(spark, sf):
    x = part_terms(spark, sf).select(F.lower("term").alias("cleaned")).distinct()
    return nz.segments(x, dims.exact_index(spark)).select("cleaned", F.col("start").alias("s"), "segment", "known", "confidence")


PARTLY = [
    ("onion sunflower oil", 1.0, ["sunflower oil"]), ("brown semisweetchocolate chips", 0.95, ["semisweetchocolate chips"]),
    ("sun dried soylecithin and corn syrup", 1.0, ["soylecithin", "corn syrup"]), ("very fine one two three high fructose corn syrup", 1.0, ["high fructose corn syrup"]),
]


@query(dims.sql_values(PARTLY).join(["SELECT * FROM (", ") v(raw_term, confidence, segments)"]).replace("SELECT * FROM", "SELECT raw_term, confidence::DOUBLE AS confidence, segments, raw_term AS unresolved_text FROM"))
def o53_partial_match(spark, sf):
    """Terms that only partly match: the surest segment's confidence, the segments as they stand, and the whole term as unresolved."""
    raw = spark.createDataFrame([(t,) for t, _, _ in PARTLY], "raw_term string")
    return nz.normalize(raw, dims.exact_index(spark), spark.createDataFrame([], "raw_term string, frequency int")).filter("match_type = 'partial_match'").select("raw_term", "confidence", "segments", "unresolved_text")


@query(f"WITH {cases([(['MILK', 'MILK', 'SOY'], ['whey', 'milk', 'soy lecithin'], ['milk', 'milk', 'soy']), ([], [], []), ([], [], []), ([], [], []), ([], [], [])], 's', 'r', 'cc')} SELECT p_partkey, unnest(s) AS source_allergen, unnest(r) AS raw_term, unnest(cc) AS canonical_concept FROM part JOIN k ON c = p_partkey % 5")
def o54_evidence_export(spark, sf):
    m = F.coalesce(F.from_json("x", "map<string,array<string>>"), F.create_map().cast("map<string,array<string>>"))
    x = by_case(spark, sf, MAPS).select("p_partkey", F.explode(m).alias("source_allergen", "terms")).select("p_partkey", "source_allergen", F.explode("terms").alias("raw_term"))
    n = nz.normalize(x, dims.exact_index(spark), vocabulary(spark))
    return x.join(n, "raw_term").select("p_partkey", "source_allergen", "raw_term", "canonical_concept")


@query(f"{R}, {similar('SELECT DISTINCT term AS a, i AS b FROM parts')} SELECT a AS term, b AS i, t AS similarity FROM sim")
def o64_token_sort_similarity(spark, sf):
    x = part_terms(spark, sf).select("term", "i").distinct()
    return x.select("term", "i", token_sort_similarity(F.col("term"), F.col("i")).alias("similarity"))


# --- the nine allergens -------------------------------------------------------------------

NINE_SQL = f"""{NINE}, tt AS (SELECT DISTINCT term FROM terms UNION SELECT 'MILK' UNION SELECT 'SOY'),
exm AS (SELECT term, allergen, min(pos) AS pos FROM tt JOIN syn ON contains(upper(term), synonym) GROUP BY ALL),
wd AS (SELECT term, list_filter(string_split(upper(term), ' '), lambda x: x <> '') AS w FROM tt), win AS (SELECT term, a AS k, s AS size, array_to_string(w[a : a + s - 1], ' ') AS phrase FROM wd, range(1, 40) r(a), range(1, 4) z(s) WHERE a + s - 1 <= len(w)),
{similar("SELECT DISTINCT phrase AS a, synonym AS b FROM win, syn")},
fz AS (SELECT term, syn.allergen, arg_max(synonym, (t, -pos, -size, -k)) AS synonym, max(t) AS score FROM win JOIN sim ON a = phrase JOIN syn ON synonym = b WHERE t >= 82 GROUP BY ALL),
fd AS (SELECT term, exm.allergen, synonym, 100.0::DOUBLE AS score, true AS is_exact FROM exm JOIN syn USING (allergen, pos) UNION ALL SELECT term, allergen, synonym, score, false FROM fz ANTI JOIN exm USING (term, allergen)),
said AS (SELECT o_orderkey AS label_id, term, false AS stated FROM terms UNION SELECT label_id, unnest(['MILK', 'SOY']), true FROM labels WHERE kind = 'F'),
evd AS (SELECT label_id, allergen, synonym, term, CASE WHEN stated THEN 'explicit_contains' WHEN is_exact THEN 'exact_ingredient' ELSE 'fuzzy_ingredient' END AS match_type,
  CASE WHEN stated THEN CASE WHEN is_exact THEN 0.99 ELSE 0.9 END WHEN is_exact THEN 0.9 ELSE greatest(0.4, score / 150) END::DOUBLE AS confidence FROM said JOIN fd USING (term)),
per AS (SELECT label_id, allergen, bool_or(match_type = 'explicit_contains') AS st, bool_or(match_type = 'exact_ingredient') AS ex, list_sort(list(DISTINCT array_to_string(list_transform(string_split(lower(synonym), ' '), lambda x: upper(x[1]) || x[2:]), ' '))) AS syns FROM evd GROUP BY ALL),
nine AS (SELECT label_id, user_id, g.allergen, coalesce(syns, []) AS syns, CASE WHEN st THEN 'DETECTED' WHEN ex AND label_id % 100 >= 60 THEN 'DETECTED' WHEN per.label_id IS NOT NULL THEN CASE WHEN label_id % 100 < 60 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'POTENTIAL' END ELSE 'NOT_DETECTED' END AS status
  FROM labels CROSS JOIN (SELECT DISTINCT allergen FROM syn) g LEFT JOIN per USING (label_id, allergen))"""


def nine_parts(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels, the evidence of their terms, and their assessment; recognized with confidence label_id % 100 / 100."""
    lab = files.stored(labels(spark, sf), "labels").withColumn("ocr_confidence", F.col("label_id") % 100 / 100).withColumn("has_text", F.length("text") > 0)
    stated = lab.select("label_id", F.explode(F.split(tx.contains_statement(F.col("text")), "[,;]")).alias("term")).select("label_id", F.btrim("term").alias("term"), F.lit(True).alias("stated")).filter("term <> ''")
    terms = label_lines(spark, sf).select(F.col("o_orderkey").alias("label_id"), "term", F.lit(False).alias("stated")).unionByName(stated).distinct()
    found = files.stored(nine.matches(terms, dims.synonyms(spark)), "matches")
    e = files.stored(nine.evidence(terms, found), "evidence")
    return lab, e, nine.assessed(lab, e)


@query(f"{R}, {NINE_SQL} SELECT label_id, allergen, synonym, match_type, round(max(confidence), 6) AS confidence, count(*) AS n FROM evd GROUP BY ALL")
def o65_best_synonyms(spark, sf):
    _, e, _ = nine_parts(spark, sf)
    return e.groupBy("label_id", "allergen", "synonym", "match_type").agg(F.round(F.max("confidence"), 6).alias("confidence"), F.count("*").alias("n"))


@query(f"{R}, {NINE_SQL} SELECT label_id, allergen, status FROM nine")
def o66_nine_allergen_status(spark, sf):
    return nine_parts(spark, sf)[2].select("label_id", "allergen", "status")


def _text(status: str, text: str) -> str:
    return f"WHEN '{status}' THEN {text}"


NAME_SQL = "CASE allergen " + " ".join(f"WHEN '{a}' THEN '{n}'" for a, n in dims.NAMES.items()) + " END"
DETAIL_SQL = f"""CASE status WHEN 'DETECTED' THEN {NAME_SQL} || ' was found in the visible ingredient information (' || array_to_string(syns[1:4], ', ') || ').'
WHEN 'POTENTIAL' THEN 'We found text that may indicate ' || lower({NAME_SQL}) || ' (' || array_to_string(syns[1:3], ', ') || '), but the image isn''t clear enough to confirm it.'
WHEN 'NOT_DETECTED' THEN 'No mention of ' || lower({NAME_SQL}) || ' was found in the visible ingredient information. This does not guarantee the product is free of it.'
ELSE 'We couldn''t read enough of the ingredient information to check for ' || lower({NAME_SQL}) || '. Try a clearer, closer photo of the ingredient list.' END"""


@query(f"{R}, {NINE_SQL} SELECT label_id, allergen, {DETAIL_SQL} AS detail FROM nine")
def o67_message_detail(spark, sf):
    x = nine_parts(spark, sf)[2]
    return x.select("label_id", "allergen", nine.detail(F.col("allergen"), F.col("status"), F.col("synonyms")).alias("detail"))


STATES, SEVERITIES = list(nine.WORST_FIRST), ["severe", "moderate", "mild", None, "grave"]
quote = lambda s: "'" + s.replace("'", "''") + "'"
NOTE_SQL = f"""CASE WHEN status IN ('DETECTED', 'POTENTIAL') AND severity = 'severe' THEN {quote(nine.SEVERE_FOUND)} WHEN status = 'INSUFFICIENT_EVIDENCE' AND severity = 'severe' THEN {quote(nine.SEVERE_UNCLEAR)}
WHEN status = 'POTENTIAL' AND severity = 'mild' THEN {quote(nine.MILD_POSSIBLE)} END"""


@query(f"SELECT p_partkey, {NOTE_SQL} AS note FROM (SELECT p_partkey, ({dims.sql_values([(STATES,)])[8:-1]})[1 + p_partkey % 4] AS status, ({dims.sql_values([(SEVERITIES,)])[8:-1]})[1 + p_partkey % 5] AS severity FROM part)")
def o68_severity_note(spark, sf):
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("p_partkey") % len(values) + 1).cast("int"))
    return read(spark, sf, "part").select("p_partkey", nine.severity_note(pick(STATES), pick(SEVERITIES)).alias("note"))


PROFILE = ORACLES["o60_profiles"]
SEVERE_SQL = "CASE user_id % 3 WHEN 0 THEN 'severe' WHEN 1 THEN 'mild' END"
TOLD_SQL = f"""prof AS ({PROFILE}), told AS (SELECT n.user_id, label_id, n.allergen, status, CASE status {" ".join(_text(s, quote(h)) for s, h in nine.HEADLINES.items())} END AS headline, {DETAIL_SQL.replace(" allergen ", " n.allergen ")} AS detail,
{NOTE_SQL.replace("severity", "(" + SEVERE_SQL.replace("user_id", "n.user_id") + ")")} AS severity_note FROM nine n JOIN prof USING (user_id, allergen))"""


def told(spark, sf) -> DataFrame:
    lab, _, a = nine_parts(spark, sf)
    severity = F.when(F.col("user_id") % 3 == 0, "severe").when(F.col("user_id") % 3 == 1, "mild")
    return nine.messages(a, lab.select("user_id", "label_id").join(o60_profiles(spark, sf), "user_id").withColumn("severity", severity))


@query(f"{R}, {NINE_SQL}, {TOLD_SQL} SELECT user_id, label_id, allergen, status, headline, detail, severity_note FROM told")
def o69_user_messages(spark, sf):
    return told(spark, sf)


WORST_SQL = "CASE min(CASE status WHEN 'DETECTED' THEN 0 WHEN 'POTENTIAL' THEN 1 WHEN 'INSUFFICIENT_EVIDENCE' THEN 2 ELSE 3 END) WHEN 0 THEN 'DETECTED' WHEN 1 THEN 'POTENTIAL' WHEN 2 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'NOT_DETECTED' END"


@query(f"{R}, {NINE_SQL}, {TOLD_SQL} SELECT user_id, label_id, {WORST_SQL} AS overall_status, list({NAME_SQL} || ': ' || headline ORDER BY {NAME_SQL}) AS headlines FROM told GROUP BY user_id, label_id")
def o70_report(spark, sf):
    r = nine.report(told(spark, sf))
    return r.select("user_id", "label_id", "overall_status", F.transform("per_allergen", lambda p: F.concat(p["allergen"], F.lit(": "), p["headline"])).alias("headlines"))


DEMO = [
    (1, "INGREDIENTS: ENRICHED FLOUR (WHEAT FLOUR, NIACIN), SUGAR, SOY LECITHIN CONTAINS: WHEAT, SOY", 0.9545, "DETECTED"), (2, "INGREDIENTS: SUGAR, MILK POWDER", 0.5954, "INSUFFICIENT_EVIDENCE"),
    (3, "INGREDIENTS: RICE, SALT", 0.93, "NOT_DETECTED"), (4, "INGREDIENTS: CASHEUS, SALT", 0.93, "POTENTIAL"), (5, "", 0.1, "INSUFFICIENT_EVIDENCE"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{s}')" for i, _, _, s in DEMO) + ") v(label_id, overall_status)")
def o71_demo(spark, sf):
    """Texts to worst status of all nine allergens, through parser, engine and report."""
    lab = spark.createDataFrame([(i, t, c) for i, t, c, _ in DEMO], "label_id long, text string, ocr_confidence double").withColumn("has_text", F.length("text") > 0)
    rows = parse.extract(lab, F.col("text"), "label_id").select("label_id", F.col("cleaned_text").alias("term"), F.lit(False).alias("stated"))
    stated = lab.select("label_id", F.explode(F.split(tx.contains_statement(F.col("text")), "[,;]")).alias("term")).select("label_id", F.btrim("term").alias("term"), F.lit(True).alias("stated")).filter("term <> ''")
    terms = rows.unionByName(stated).distinct()
    a = nine.assessed(lab, nine.evidence(terms, nine.matches(terms, dims.synonyms(spark))))
    return a.groupBy("label_id").agg(nine.worst(F.col("status")).alias("overall_status"))


# --- evaluation ---------------------------------------------------------------------------


@query(f"WITH {TRUTH_SQL} SELECT p_partkey AS key, allergens FROM g")
def o77_parse_allergens(spark, sf):
    return by_case(spark, sf, TRUTHS).select(F.col("p_partkey").alias("key"), files.allergen_list(F.col("x")).alias("allergens"))


@query("SELECT CASE p_partkey % 3 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'UNCERTAIN' ELSE 'EXCLUDED' END AS annotation_status, count(*) AS n, count_if(p_partkey % 2 = 0) AS valid FROM part GROUP BY 1")
def o78_annotation_status(spark, sf):
    g = ground_truth(spark, sf)
    part = lambda s: g.filter(F.col("annotation_status") == s).groupBy("annotation_status").agg(F.count("*").alias("n"), F.count_if("valid_food_label").alias("valid"))
    return part("VERIFIED").unionByName(part("UNCERTAIN")).unionByName(part("EXCLUDED"))


PRED = "pred AS (SELECT l_partkey AS p_partkey, l_orderkey, l_linenumber, l_suppkey, l_returnflag FROM lineitem WHERE l_partkey % 6 <> 0)"


def verified(spark, sf) -> DataFrame:
    return read(spark, sf, "part").filter(F.col("p_partkey") % 3 == 0).select("p_partkey", "p_size")


def predicted(spark, sf) -> DataFrame:
    return read(spark, sf, "lineitem").filter(F.col("l_partkey") % 6 != 0).select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")


@query(f"WITH {PRED} SELECT p_partkey, p_size, count(l_orderkey) AS n, count(*) AS n_rows FROM part LEFT JOIN pred USING (p_partkey) WHERE p_partkey % 3 = 0 GROUP BY ALL")
def o79_verified_left_join(spark, sf):
    """Verified rows with all their predictions, those without any included."""
    x = verified(spark, sf).join(predicted(spark, sf), "p_partkey", "left")
    return x.groupBy("p_partkey", "p_size").agg(F.count("l_orderkey").alias("n"), F.count("*").alias("n_rows"))


@query(f"WITH {PRED}, f AS (SELECT p_partkey, min((l_orderkey, l_linenumber, l_suppkey)) AS m FROM pred GROUP BY ALL) SELECT p_partkey, p_size, m[1] AS l_orderkey, m[2] AS l_linenumber FROM part JOIN f USING (p_partkey) WHERE p_partkey % 3 = 0".replace("m[1]", "struct_extract(m, 1)").replace("m[2]", "struct_extract(m, 2)"))
def o80_first_match_join(spark, sf):
    p = predicted(spark, sf).withColumn("o", F.struct("l_orderkey", "l_linenumber", "l_suppkey"))
    return nine.first_match(verified(spark, sf), p, "p_partkey", "o").select("p_partkey", "p_size", "l_orderkey", "l_linenumber")


@query(f"WITH w AS ({ORACLES['o76_wide_status']}) SELECT label_id, allergen, status, status IN ('CONFIRMED', 'DETECTED') AS positive FROM (UNPIVOT (SELECT label_id, WHEAT_status AS WHEAT, SOY_status AS SOY, MILK_status AS MILK FROM w) ON WHEAT, SOY, MILK INTO NAME allergen VALUE status)")
def o81_wide_to_long(spark, sf):
    w = QUERIES["o76_wide_status"](spark, sf)
    w = w.select("label_id", *[F.coalesce(f"{a}_status", F.lit("NOT_DETECTED")).alias(a) for a in dims.BASELINE])
    x = w.unpivot("label_id", list(dims.BASELINE), "allergen", "status")
    return x.select("label_id", "allergen", "status", F.upper("status").isin("CONFIRMED", "DETECTED").alias("positive"))


@query(f"{R}, {NINE_SQL} SELECT match_type AS kind, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM evd GROUP BY 1 UNION ALL SELECT status, count(*), NULL FROM nine GROUP BY 1")
def o86_evidence_coverage(spark, sf):
    _, e, a = nine_parts(spark, sf)
    kinds = e.groupBy(F.col("match_type").alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    return kinds.unionByName(a.groupBy(F.col("status").alias("kind")).agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("mean_confidence")))


#: Fixed scenarios: name, allergen of the profile, assessed allergen, its status, expected risk.
SCENARIOS = [
    ("detected", "MILK", "MILK", "DETECTED", "HIGH"), ("potential", "SOY", "SOY", "POTENTIAL", "MEDIUM"), ("not_detected", "WHEAT", "WHEAT", "NOT_DETECTED", "LOW"),
    ("insufficient", "MILK", "MILK", "INSUFFICIENT_EVIDENCE", "INSUFFICIENT_EVIDENCE"), ("no_match", "PEANUT", "WHEAT", "DETECTED", "NO_MATCH"),
]


@query(f"SELECT name AS label_id, expected AS overall_risk, true AS passed FROM ({dims.sql_values(SCENARIOS)}) v(name, wanted, allergen, status, expected) UNION ALL SELECT 'unassessed', 'INSUFFICIENT_EVIDENCE', true UNION ALL SELECT 'no_profile', 'NO_MATCH', true")
def o87_risk_scenarios(spark, sf):
    """The fixed scenarios, beside a label that was not assessed and an empty profile."""
    rows = spark.createDataFrame(SCENARIOS, "label_id string, wanted string, allergen string, status string, expected string")
    pairs = rows.select(F.lit(1).alias("user_id"), "label_id", F.col("wanted").alias("allergen")).union(spark.createDataFrame([(1, "unassessed", "MILK")], "user_id int, label_id string, allergen string"))
    expected = rows.select("label_id", "expected").union(spark.createDataFrame([("unassessed", "INSUFFICIENT_EVIDENCE"), ("no_profile", "NO_MATCH")], "label_id string, expected string"))
    risk = ev.product_risk(ev.personal_risk(pairs, rows.withColumn("confidence", F.lit(1.0))), expected.select(F.lit(1).alias("user_id"), "label_id"))
    return risk.join(expected, "label_id").select("label_id", "overall_risk", (F.col("overall_risk") == F.col("expected")).alias("passed"))


ANALYSED = [
    ("  SOY    LECITHIN  ", "curated_exact", "known"), ("soy leotain", "dataset_candidate", "candidate"), ("onion sunflower oil", "partial_match", "ambiguous"), ("thiaminmononitrate", "dataset_exact", "known"),
    ("completelyunknowningredientxyz", "no_match", "unknown"), ("unbleached wheat flour", "curated_exact", "known"),
]


@query(f"SELECT * FROM ({dims.sql_values(ANALYSED)}) v(raw_term, match_type, status)")
def o88_error_cases(spark, sf):
    raw = spark.createDataFrame([(t,) for t, _, _ in ANALYSED], "raw_term string")
    return nz.normalize(raw, dims.exact_index(spark), vocabulary(spark)).select("raw_term", "match_type", "status")


SEEN = ["Sliced Chicken Breast,", " lime wedges", "Diced, Tomatoes", "rice", "QUINOA "]


@query(f"WITH {cases([('chicken',), ('lime',), ('tomato',), ('rice',), ('quinoa',)], 'concept')} SELECT p_partkey, concept FROM part JOIN k ON c = p_partkey % 5")
def o89_observation_align(spark, sf):
    """The concept of an observation, or the observation itself; the map is fixed and small."""
    names = spark.createDataFrame(list(dims.CONCEPTS.items()), "observation string, concept string")
    x = by_case(spark, sf, SEEN).select("p_partkey", F.btrim(F.replace(F.lower("x"), F.lit(","), F.lit(""))).alias("observation"))
    return x.join(F.broadcast(names), "observation", "left").select("p_partkey", F.coalesce("concept", "observation").alias("concept"))


def observed(spark, sf, odd: int) -> DataFrame:
    """Observations of the suppliers with odd or even keys; the second source misses terms of large parts, so that each has its own."""
    x = read(spark, sf, "lineitem").filter(F.col("l_suppkey") % 2 == odd).join(part_terms(spark, sf), F.col("l_partkey") == F.col("p_partkey"))
    x = x.filter(F.col("a") != ("old" if odd else "large"))
    return x.select(F.btrim(F.lower(F.regexp_replace("term", ",", ""))).alias("observation")).distinct()


OBSERVED = "obs AS (SELECT DISTINCT l_suppkey % 2 AS s, trim(lower(replace(term, ',', ''))) AS observation FROM lineitem JOIN parts ON l_partkey = p_partkey WHERE a <> CASE l_suppkey % 2 WHEN 1 THEN 'old' ELSE 'large' END)"


@query(f"{L}, {OBSERVED} SELECT observation FROM obs WHERE s = 1 INTERSECT SELECT observation FROM obs WHERE s = 0")
def o90_intersect_sources(spark, sf):
    return observed(spark, sf, 1).intersect(observed(spark, sf, 0))


@query(f"{L}, {OBSERVED} SELECT 'odd' AS side, observation FROM (SELECT observation FROM obs WHERE s = 1 EXCEPT SELECT observation FROM obs WHERE s = 0) UNION ALL SELECT 'even', observation FROM (SELECT observation FROM obs WHERE s = 0 EXCEPT SELECT observation FROM obs WHERE s = 1)")
def o91_except_both_ways(spark, sf):
    a, b = observed(spark, sf, 1), observed(spark, sf, 0)
    return a.subtract(b).select(F.lit("odd").alias("side"), "observation").unionByName(b.subtract(a).select(F.lit("even").alias("side"), "observation"))


@query(f"{L}, {OBSERVED} SELECT CASE s WHEN 1 THEN 'odd' ELSE 'even' END AS source, observation FROM obs")
def o92_union_sources(spark, sf):
    return observed(spark, sf, 1).select(F.lit("odd").alias("source"), "observation").unionByName(observed(spark, sf, 0).select(F.lit("even").alias("source"), "observation"))


# --- the service --------------------------------------------------------------------------

SERVICE = f"""{NINE_SQL}, prof AS ({PROFILE}), ask AS (SELECT user_id, allergen FROM prof UNION SELECT c_custkey, 'MUSTARD' FROM customer WHERE c_custkey % 4 = 2), lb AS (SELECT user_id, label_id, label_id % 7 <> 0 AS any_ingredient FROM labels),
res AS (SELECT lb.user_id, lb.label_id, ask.allergen, coalesce(status, CASE WHEN any_ingredient THEN 'NOT_DETECTED' ELSE 'INSUFFICIENT_EVIDENCE' END) AS status, CASE WHEN status IS NOT NULL THEN 0.5 WHEN any_ingredient THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence
  FROM lb JOIN ask USING (user_id) LEFT JOIN nine ON nine.label_id = lb.label_id AND nine.allergen = ask.allergen),
ans AS (SELECT *, CASE status {" ".join(f"WHEN '{s}' THEN '{a[0]}'" for s, a in ev.ANSWERS.items())} END AS risk_level, CASE status {" ".join("WHEN '" + s + "' THEN " + "'" + a[1].replace("{}", "' || allergen || '") + "'" for s, a in ev.ANSWERS.items())} END AS reason FROM res)"""


def service(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Products and the results of what their users selected; one selected allergen is unknown to the engine."""
    lab, _, a = nine_parts(spark, sf)
    asked = o60_profiles(spark, sf).unionByName(read(spark, sf, "customer").filter("c_custkey % 4 = 2").select(F.col("c_custkey").alias("user_id"), F.lit("mustard").alias("allergen")))
    products = lab.select("user_id", "label_id", (F.col("label_id") % 7 != 0).alias("any_ingredient"))
    chosen = products.select("user_id", "label_id").join(asked, "user_id")
    return products, ev.selected_results(chosen, a.withColumn("confidence", F.lit(0.5)), products.select("label_id", "any_ingredient"))


@query(f"{R}, {SERVICE} SELECT user_id, label_id, allergen, status, confidence FROM res")
def o93_selected_results(spark, sf):
    return service(spark, sf)[1]


@query(f"{R}, {SERVICE} SELECT user_id, label_id, allergen, risk_level, reason FROM ans")
def o94_answer_levels(spark, sf):
    return ev.answers(service(spark, sf)[1]).select("user_id", "label_id", "allergen", "risk_level", "reason")


LADDER = "CASE min(CASE risk_level WHEN 'ALLERGEN_FOUND' THEN 0 WHEN 'POSSIBLE_ALLERGEN' THEN 1 WHEN 'INSUFFICIENT_EVIDENCE' THEN 2 ELSE 3 END) WHEN 0 THEN 'ALLERGEN_FOUND' WHEN 1 THEN 'POSSIBLE_ALLERGEN' WHEN 2 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'NO_MATCH' END"
ANSWER_SQL = f"{SERVICE}, lvl AS (SELECT user_id, label_id, {LADDER} AS level FROM ans GROUP BY ALL)"


@query(f"""{R}, {ANSWER_SQL} SELECT lb.user_id, lb.label_id, coalesce(level, 'INSUFFICIENT_EVIDENCE') AS level, CASE WHEN level IS NULL THEN 'The available evidence was insufficient to determine the selected allergens.' ELSE
CASE level {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ev.OVERALL.items())} END END AS message FROM lb LEFT JOIN lvl USING (user_id, label_id)""")
def o95_overall_answer(spark, sf):
    products, results = service(spark, sf)
    return ev.overall_answer(products, ev.answers(results))


FILES = [("a.gif", 5, "mild"), ("b.JPG", 5, "severe"), ("c.webp", 0, "mild"), ("", 5, "mild"), ("d.bmp", 1, "grave"), ("noext", 9, "mild"), ("e.tar.png", 1, None)]


@query(f"WITH {cases([(400,), (200,), (400,), (400,), (500,), (400,), (200,)], 'code')} SELECT p_partkey, code::INT AS code FROM part JOIN k ON c = p_partkey % 7")
def o96_input_validation(spark, sf):
    """The answer's code: a name with one of five extensions and a file that is not empty, then a known severity (or none)."""
    x = by_case(spark, sf, [f"{n}|{s}|{v or ''}" for n, s, v in FILES]).select("p_partkey", F.split("x", r"\|").alias("f"))
    ok = F.lower(F.regexp_extract(F.col("f")[0], r"(\.[^.]+)$", 1)).isin(".jpg", ".jpeg", ".png", ".webp", ".bmp") & (F.col("f")[1] != "0")
    return x.select("p_partkey", F.when(~ok, 400).when(~F.col("f")[2].isin("", "mild", "moderate", "severe"), 500).otherwise(200).alias("code"))


@query(f"{R}, {NINE_SQL} SELECT label_id, list(allergen || '=' || status ORDER BY allergen) AS allergen_assessments, (SELECT count(*) FROM evd WHERE evd.label_id = nine.label_id) AS n_evidence FROM nine GROUP BY label_id")
def o97_older_response(spark, sf):
    """One row a label: every allergen's status and the size of the evidence."""
    _, e, a = nine_parts(spark, sf)
    g = a.groupBy("label_id").agg(F.sort_array(F.collect_list(F.concat("allergen", F.lit("="), "status"))).alias("allergen_assessments"))
    n = e.groupBy("label_id").agg(F.count("*").alias("n"))
    return g.join(n, "label_id", "left").select("label_id", "allergen_assessments", F.coalesce("n", F.lit(0)).alias("n_evidence"))
