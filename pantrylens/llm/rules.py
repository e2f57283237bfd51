"""Quality rules: a threshold table compiled into one projection.

No user functions: words, ratios and verdicts are built-in expressions, so the
whole operator is one scan without a shuffle.  Windows of three words are
compared by their 64-bit hash within one text.

Defined cases: null and empty texts have no words and fail the base rule; a
null id is carried along; extra columns are ignored; repeated rows each get
their own verdict; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the languages that the corpus is expected in.
STOP_WORDS = (
    "the of and to in is that it for with as on be at by this are was from or an "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de des et un une du en que qui est dans pour pas sur au avec par "
    "el los las y que del se por con una para su al lo como más no es"
).split()


@dataclass(frozen=True)
class Rule:
    """Passes while low <= numerator / denominator <= high; a zero denominator counts as one."""

    name: str
    numerator: str
    denominator: str | None = None
    low: float | None = None
    high: float | None = None


#: Fixed thresholds over the measured counts.
RULES = (
    Rule("length", "n_words", low=50),
    Rule("mean_word_length", "word_chars", "n_words", low=2, high=14),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.1),
    Rule("stop_words_per_word", "n_stop_words", "n_words", low=0.01),
    Rule("capitals_per_character", "n_capitals", "word_chars", high=0.5),
    Rule("exclamations_per_word", "n_exclamations", "n_words", high=0.2),
    Rule("duplicate_lines_per_line", "n_dup_lines", "n_lines", high=0.5),
    Rule("ellipsis_lines_per_line", "n_ellipsis_lines", "n_lines", high=0.3),
    Rule("bullet_lines_per_line", "n_bullet_lines", "n_lines", high=0.9),
)


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The conjunction of all rules as one boolean expression."""
    out = F.lit(True)
    for r in rules:
        x = F.col(r.numerator).cast("double")
        if r.denominator:
            x = x / F.greatest(F.col(r.denominator), F.lit(1)).cast("double")
        if r.low is not None:
            out = out & (x >= F.lit(float(r.low)))
        if r.high is not None:
            out = out & (x <= F.lit(float(r.high)))
    return out


def words(text: Column) -> Column:
    """Runs of anything but space and 0x09-0x0D; the only character that is searched for is a space, which needs no regex."""
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def repeated_words(window_hashes: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more; n log n in the windows of a text."""
    at = F.sort_array(F.transform(window_hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    # a one-element array binds the sorted windows to a name, so they are sorted once
    twice = F.get(F.transform(F.array(at), lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))), F.lit(0))
    starts = F.sort_array(F.transform(twice, lambda x: x["p"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(
        starts,
        start,
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules can name."""
    x = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    x = x.select("doc_id", "_t", words(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    hashes = F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    x = x.select("doc_id", "_t", "_w", "_l", hashes.alias("_h"))
    return x.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_w")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), repeated_words(F.col("_h"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.filter("_l", lambda s: s.endswith("...") | s.endswith("…"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("_l", lambda s: F.substring(F.ltrim(s), 1, 1).isin("-", "*", "•"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        (F.length("_t") - F.length(F.replace(F.col("_t"), F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
    )


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: the counts, base_failed and kept."""
    m = measure(docs)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.select("*", base.alias("base_failed"), (~base & compiled(rules)).alias("kept"))
