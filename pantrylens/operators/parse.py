"""The one parser of bracketed ingredient text, used through Arrow."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dims import REMARKS
from ..functions import text as tx

_CLEANUP = [(re.compile(p.replace("(?iuU)", "(?i)").replace("(?iu)", "(?i)")), to) for p, to in tx.CLEANUP]
_PREFIXES = [re.compile(p) for p in tx.PREFIXES]
_PACKAGING = re.compile(tx.PACKAGING)


def outside_commas(text: str, pairs: dict[str, str]) -> list[str]:
    """Pieces between commas that no bracket encloses; a closing bracket without its opening one is text."""
    out, open_, start = [], [], 0
    for i, c in enumerate(text):
        if c in pairs.values():
            open_.append(c)
        elif c in pairs and open_ and open_[-1] == pairs[c]:
            open_.pop()
        elif c == "," and not open_:
            out.append(text[start:i])
            start = i + 1
    return [p for x in [*out, text[start:]] if (p := x.strip())]


ROUND, ANY = {")": "("}, {")": "(", "]": "["}


def tidy(text: str) -> str:
    x = text.replace("\n", " ").translate(str.maketrans("{}", "()"))
    for p, to in _CLEANUP:
        x = p.sub(to, x)
    return re.sub(r"\s+", " ", x).strip(" ,.;:")


def tidy_term(text: str) -> str:
    return re.sub(r"^\s*[-•*]+\s*", "", tidy(text)).strip(" ,.;:")


def without_prefix(text: str) -> str:
    hit = next((p for p in _PREFIXES if p.search(text)), None)
    return (hit.sub("", text) if hit else text).strip(" ,.;:")


_EITHER = re.compile(r"(?i)\s+AND/OR\s+")


def alternatives(term: str) -> list[str]:
    """A AND/OR B OIL stands for A OIL and B OIL."""
    if not _EITHER.search(term):
        return [term]
    shared = " OIL" if term.rstrip().upper().endswith("OIL") else ""
    body = re.sub(r"(?i)\s+OIL\s*\Z", "", term) if shared else term
    return [name.strip() + shared for name in _EITHER.split(body)]


Row = tuple[str, str, str | None, str, str]


def tree_rows(term: str, raw: str) -> Iterator[Row]:
    """(raw_text, cleaned_text, parent, level, method) of a term and all it encloses, in reading order.

    Children lie between the first opening and the last closing bracket (or the
    end, if that one is missing); what follows is dropped.
    """
    todo: list[tuple[str, str, str | None]] = [(term, raw, None)]
    while todo:
        text, origin, parent = todo.pop()
        cleaned = tidy_term(text)
        if not cleaned:
            continue
        level = "top_level" if parent is None else "nested"
        at = cleaned.find("(")
        if at < 0:
            yield (text if parent is None else origin), cleaned, parent, level, "comma_split" if parent is None else "nested_parentheses"
            continue
        name = without_prefix(cleaned[:at].strip()) or parent
        if name:
            yield origin, name, parent, level, "nested_parentheses"
        end = cleaned.rfind(")")
        inner = cleaned[at + 1 : end if end > at else None].strip()
        for piece in reversed(outside_commas(inner, ROUND)):
            child = tidy_term(piece)
            todo.append((child, child if "(" in child else piece, name))


def ingredients(text: str | None) -> list[Row]:
    """All ingredient rows of a label, ordered, without repeats."""
    if text is None or not text.strip() or text.strip().lower() == "nan":
        return []
    flat = re.sub(r"\s+", " ", text).strip()
    head = re.search(r"(?i)\bINGREDIENTS?\s*:\s*", flat)
    section = ""
    if head:
        section = _PACKAGING.sub("", re.split(r"(?i)\bCONTAINS?\s*:", flat[head.end() :])[0]).strip()
    if not section and not re.search(r"(?i)\bCONTAINS?\s*:", text):
        section = _PACKAGING.sub("", text.strip()).strip()
    cleaned = tidy(section)
    terms, raws = outside_commas(cleaned, ROUND), outside_commas(section, ROUND)
    rows = [r for i, t in enumerate(terms) for a in alternatives(t) for r in tree_rows(a, raws[i] if i < len(raws) else t)]
    return list(dict.fromkeys(rows))


FIELDS = ("raw_text", "cleaned_text", "parent", "level", "extraction_method")
ROWS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in FIELDS]))


@F.arrow_udf(ROWS)
def _parsed(text: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([(n, pa.string()) for n in FIELDS]))
    return pa.array([[dict(zip(FIELDS, r, strict=True)) for r in ingredients(t)] for t in text.to_pylist()], kind)


def extract(labels: DataFrame, text: Column, *keys: str) -> DataFrame:
    """One row per ingredient with its position; a narrow stage, no shuffle."""
    x = labels.select(*keys, F.posexplode(_parsed(text)).alias("pos", "i"))
    return x.select(*keys, "pos", "i.*")


# --- vocabulary -------------------------------------------------------------------


def vocabulary_form(text: str) -> str:
    x = re.sub(r"\s+", " ", text.lower())
    x = re.sub(r"\b\d+(?:\.\d+)?\s*%", "", x).replace(";", ",")
    return re.sub(r"\s+", " ", x).strip(" ,.;:-")


def outer_groups(text: str) -> list[tuple[int, int]]:
    """Balanced groups of round or square brackets that no other group encloses."""
    found, stack = [], []
    for i, c in enumerate(text):
        if c in "([":
            stack.append(i)
        elif c in ANY and stack and text[stack[-1]] == ANY[c]:
            a = stack.pop()
            found = [g for g in found if g[0] < a] + [(a, i)]
    return sorted(found)


def flattened(text: str) -> list[str]:
    """A term and the terms it encloses, each once; single remarks in brackets are left out."""
    cleaned = vocabulary_form(text)
    groups = outer_groups(cleaned)
    cuts = [0, *[x for a, b in groups for x in (a, b + 1)], len(cleaned)]
    out = [vocabulary_form(" ".join(cleaned[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))]
    for a, b in groups:
        items = outside_commas(vocabulary_form(cleaned[a + 1 : b]), ANY)
        word = vocabulary_form(items[0]) if len(items) == 1 else ""
        if len(items) == 1 and remark(word):
            continue
        for item in items:
            out += flattened(item)
    return [x for x in dict.fromkeys(out) if x]


def lists(function):
    """A column function that gives function(text), a list of strings, of every text (nulls count as empty)."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def column(text: pa.Array) -> pa.Array:
        return pa.array([function(x or "") for x in text.to_pylist()], pa.list_(pa.string()))

    return column


def remark(word: str) -> bool:
    """Whether a bracketed item explains an ingredient and is none itself."""
    return word in REMARKS or word.startswith(("vitamin ", "source of "))


split_round = lists(lambda x: outside_commas(x, ROUND))
split_any = lists(lambda x: outside_commas(x, ANY))
either = lists(alternatives)
groups = lists(lambda x: [x[a : b + 1] for a, b in outer_groups(x)])


@F.arrow_udf(T.ArrayType(T.StringType()))
def vocabulary_terms(text: pa.Array) -> pa.Array:
    return pa.array([[w for t in outside_commas(vocabulary_form(x or ""), ANY) for w in flattened(t)] for x in text.to_pylist()], pa.list_(pa.string()))


flat_terms = lists(flattened)


def parsed_term(term: Column) -> Column:
    """All rows of one term with its brackets, in reading order."""
    return _term_rows(term)


@F.arrow_udf(ROWS)
def _term_rows(text: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([(n, pa.string()) for n in FIELDS]))
    return pa.array([[dict(zip(FIELDS, r, strict=True)) for r in tree_rows(t or "", t or "")] for t in text.to_pylist()], kind)


def build_vocabulary(corpus: DataFrame, text: Column) -> DataFrame:
    """(raw_term, frequency); counts are pre-aggregated before the shuffle."""
    terms = corpus.select(F.explode(vocabulary_terms(text)).alias("raw_term")).filter(tx.looks_like_ingredient(F.col("raw_term")))
    return terms.groupBy("raw_term").agg(F.count("*").alias("frequency"))
