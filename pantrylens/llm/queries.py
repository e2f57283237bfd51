"""The registered queries of the operators, each over its whole table, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import html_text, jaccard, line_crf, media, mixing, packing, pii, rules, span_index, toxicity
from .shared import table


def op1_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_span_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_index.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op6_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_blocks, op2_webp_media, op3_source_mix, op4_span_index, op5_jaccard_join, op6_line_crf, op7_quality_rules, op8_toxicity_cnn, op9_mixture_packing, op10_pii_tagger)}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3 = rf"""
WITH s AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
z AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::BIGINT AS weight FROM z),
l AS (SELECT *, 2 * source_size / weight AS cap_level FROM w),
r AS (SELECT *, (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::BIGINT AS rest_weight,
             (150 * sum(source_size) OVER () - 200 * coalesce(sum(source_size) OVER f, 0))::BIGINT AS rest
      FROM l WINDOW f AS (ORDER BY cap_level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, 200::HUGEINT * source_size * rest_weight > weight::HUGEINT * rest AS is_open FROM r),
u AS (SELECT rest AS open_rest, rest_weight AS open_weight FROM o WHERE is_open ORDER BY cap_level, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN is_open THEN (weight * open_rest)::DOUBLE / (100 * open_weight)::DOUBLE ELSE (2 * source_size)::DOUBLE END AS target
      FROM o LEFT JOIN u ON true),
b AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs,
             coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken FROM b
"""

OP4 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
i AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) AS k FROM i),
m AS (SELECT k, min(doc_id) AS lo FROM h GROUP BY k),
f AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM h JOIN m USING (k) WHERE doc_id > lo),
g AS (SELECT doc_id, list(q) AS gone FROM f GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(gone, x)), lambda x: w[x]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

OP5 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT DISTINCT doc_id, sh FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * n_both >= 90 * (p.n + q.n - n_both)),
s AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS a, x AS b FROM s UNION SELECT r.a, s.y FROM r JOIN s ON s.x = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(k.lo, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS lo FROM r GROUP BY a) k ON k.a = d.doc_id
"""


def _rule_sql() -> str:
    parts = []
    for r in rules.RULES:
        x = f"{r.numerator}::DOUBLE" + (f" / greatest({r.denominator}, 1)::DOUBLE" if r.denominator else "")
        parts += [f"{x} >= {float(r.low)}"] if r.low is not None else []
        parts += [f"{x} <= {float(r.high)}"] if r.high is not None else []
    return " AND ".join(parts)


OP7 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
i AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM d WHERE len(w) >= 3),
k AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM i),
v AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM k),
q AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS x FROM v WHERE c >= 2) GROUP BY doc_id),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT l.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(q.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
             len(list_filter(ls, lambda x: x LIKE '%...' OR x LIKE '%…')) AS n_ellipsis_lines, len(list_filter(ls, lambda x: ltrim(x)[1] IN ('-', '*', '•'))) AS n_bullet_lines,
             len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in dict.fromkeys(rules.STOP_WORDS))}))) AS n_stop_words,
             length(t) - length(replace(t, '!', '')) AS n_exclamations, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_capitals
      FROM l LEFT JOIN q ON q.doc_id = l.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_rule_sql()} AS kept FROM b
"""

ORACLES = {"op3_source_mix": OP3, "op4_span_index": OP4, "op5_jaccard_join": OP5, "op7_quality_rules": OP7}
