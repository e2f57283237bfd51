"""Column expressions of the label domain; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import OCR_WORDS

SPACE = r"(?U)\s+"
#: Fixed patterns: where packaging text begins.
PACKAGING = r"(?is)(\bDIST\.\s*&\s*SOLD\b|\bDISTRIBUTED\s+BY\b|\bSOLD\s+EXCLUSIVELY\b|\bSTORE\s+IN\s+A\s+COOL\b|\bKEEP\s+REFRIGERATED\b|\bKEEP\s+FROZEN\b|\bNET\s+WT\b|\bSKU\s*#).*$"
#: Fixed patterns and replacements of the clean-up, in order.
CLEANUP = (
    (r"\b\d+\s*%", ""),
    (r"(?iu)\b\d+\s*g\b", ""),
    (r"(?iu)enriched\s*(?:f\s*l\s*o\s*u\s*r|flour)", "ENRICHED FLOUR"),
    (r"(?iu)chocolate\s*(?:c\s*h\s*i\s*p\s*s|chips)", "CHOCOLATE CHIPS"),
    (r"(?iuU)\bchocolaté\b", "CHOCOLATE"),
    (r"(?iu)\bcottonseed\b(?:\s+\d+[A-Z0-9/]+)*(?:\s+\d+\s*g)?\s+\boil\b", "COTTONSEED OIL"),
    (r"(?iu)\bsunflowerand/\s*or\s*safflower\s+and/\s*or\s+canola\s+oil\b", "SUNFLOWER AND/OR SAFFLOWER AND/OR CANOLA OIL"),
    (r"(?iu)\bplease\s+see\s+date\s+printed\s+", ""),
)
#: Fixed patterns: packaging phrases in front of a parent; the first that applies is removed.
PREFIXES = (
    r"(?i)^(?:FOR\s+BEST\s+WHEN\s+USED\s+BY\s+|BEST\s+WHEN\s+USED\s+BY\s+|FOR\s+BEST\s+BY\s+|USE\s+BY\s+|BEST\s+BY\s+)\s*(?:\d+\s*%\s*)?",
    r"(?i)^(?:PACKED\s+ON\s+|SELL\s+BY\s+|BEST\s+BEFORE\s+|EXP\s*\.\s*|EXPIRATION\s+DATE\s+)",
    r"^\d+\s*%\s*",
)
#: Fixed patterns: text that is about the package, not in it.
METADATA = r"(?i)\bdistributed\b|\bmanufactured by\b|\bmanufactured for\b|\bstore in\b|\bkeep refrigerated\b|\bkeep frozen\b|\bnet weight\b|\bsku\b|\bwww\.|\bhttps?://"


def squeeze(x: Column) -> Column:
    return F.btrim(F.regexp_replace(x, SPACE, " "))


def strip_packaging(x: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(x, F.lit("")), PACKAGING, ""))


def ingredient_section(x: Column) -> Column:
    body = F.regexp_extract(squeeze(F.coalesce(x, F.lit(""))), r"(?is)^.*?\bINGREDIENTS?\s*:\s*(.*)$", 1)
    return strip_packaging(F.regexp_replace(body, r"(?is)\bCONTAINS?\s*:.*$", ""))


def repair_brackets(x: Column) -> Column:
    return F.translate(x, "{}", "()")


def clean_text(x: Column) -> Column:
    x = repair_brackets(F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(" ")))
    for pattern, to in CLEANUP:
        x = F.regexp_replace(x, pattern, to)
    return F.btrim(F.regexp_replace(x, SPACE, " "), F.lit(" ,.;:"))


def clean_term(x: Column) -> Column:
    return F.btrim(F.regexp_replace(clean_text(x), r"^\s*[-•*]+\s*", ""), F.lit(" ,.;:"))


def strip_prefix(x: Column) -> Column:
    x = F.btrim(x)
    out = x
    for p in reversed(PREFIXES):
        out = F.when(x.rlike(p), F.regexp_replace(x, p, "")).otherwise(out)
    return F.btrim(out, F.lit(" ,.;:"))


def vocabulary_term(x: Column) -> Column:
    x = F.regexp_replace(F.lower(x), SPACE, " ")
    x = F.regexp_replace(x, r"\b\d+(?:\.\d+)?\s*%", "")
    return F.btrim(F.regexp_replace(F.translate(x, ";", ","), SPACE, " "), F.lit(" ,.;:-"))


def looks_like_ingredient(x: Column) -> Column:
    return (F.length(x) > 0) & (F.length(x) <= 200) & ~x.rlike(METADATA)


def normal_form(x: Column) -> Column:
    """The key of curated matches: text before the first bracket, words only, a space before a trailing flour, chips or oil."""
    x = F.regexp_replace(squeeze(F.lower(F.coalesce(x, F.lit("")))), r"(?s)[\[({].*$", "")
    x = squeeze(F.regexp_replace(x, r"(?U)[^\w\s-]", " "))
    return F.regexp_replace(squeeze(F.regexp_replace(x, r"(?<=[a-z])(flour|chips|oil)\b", " $1")), r"^unbleached\s+", "")


def compact(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "")


def contains_statement(x: Column) -> Column:
    return F.regexp_extract(F.coalesce(x, F.lit("")), r"(?i)\bCONTAINS?\s*:\s*([^.\n]+)", 1)


def ocr_score(text: Column, confidence: Column, regions: Column) -> Column:
    """Quality of recognized text: confidence, length, known words, headings, less what looks like noise."""
    t, n = F.coalesce(F.btrim(text), F.lit("")), F.length(F.coalesce(F.btrim(text), F.lit("")))
    u = F.upper(t)
    hits = reduce(lambda a, b: a + b, [u.contains(w).cast("int") for w in OCR_WORDS])
    readable = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}\s]", "")) / F.greatest(n, F.lit(1))
    score = 50 * confidence + 15 * F.least(n / 500.0, F.lit(1.0)) + F.least(5 * hits, F.lit(25)) + F.when(u.contains("INGREDIENTS"), 15).otherwise(0) + F.when(u.contains("CONTAINS"), 15).otherwise(0)
    score = score - F.when(n < 30, 10).otherwise(0) - F.when(readable < 0.65, 10).otherwise(0) + 5 * F.least(regions / 100.0, F.lit(1.0))
    return F.when(n == 0, F.lit(0.0)).otherwise(score)
