"""CSV and JSON sources and sinks of the label domain.

Every CSV has a header and may quote commas, quotes and line feeds.  Schemas
are declared, never inferred, so a load is one scan.  A missing file is an
error, but for the vocabulary index, where it means an empty one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Names under which a corpus may hold its text, first to last.
TEXT_COLUMNS = ("ingredients", "ingredients_text", "ingredient", "ingredient_list", "ingredients_list")
GROUND_TRUTH = (
    "image string, valid_food_label boolean, ingredient_list_available boolean, contains_statement_available boolean, "
    "ground_truth_allergens string, annotation_status string, annotation_source string"
)
OCR_RESULTS = "image string, ocr_regions int, avg_confidence double, ingredients_detected boolean, contains_detected boolean, ocr_text string"
VOCABULARY = "raw_term string, frequency int"
PREDICTIONS = "image string, ocr_text string, ingredients array<string>, allergen_assessments array<struct<allergen:string,status:string,confidence:double>>"


#: How a null is written, so that it stays apart from an empty text.
NULL = "\\N"


def new_file(spark: SparkSession, name: str) -> str:
    """A path in the folder that the executors share; on one machine without such a folder, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="pantrylens-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read again, for what several branches of a query use."""
    path = new_file(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.option("header", True).option("escape", '"').option("quoteAll", True).option("nullValue", NULL).option("emptyValue", "").csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", NULL).option("emptyValue", "")
    return (reader.schema(schema) if schema else reader).csv(path)


def text_column(columns: list[str]) -> str:
    """The column that holds a corpus's text, by name without regard to case and outer space; earlier names win."""
    found = {c.lower().strip(): c for c in columns}
    for name in TEXT_COLUMNS:
        if name in found:
            return found[name]
    raise ValueError(f"no text column among {columns}")


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a corpus CSV, all columns as text; the text column is found by text_column."""
    return read_csv(spark, path)


def inspect(df: DataFrame, sample: int = 5) -> tuple[list[tuple[str, str]], int, DataFrame]:
    """Columns with their types, the number of rows, and the first rows by all columns."""
    return df.dtypes, df.count(), df.orderBy(*df.columns).limit(sample)


def load_vocabulary(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """(raw_term, frequency); an absent file is an error, or an empty vocabulary if missing_ok."""
    try:
        return read_csv(spark, path, VOCABULARY)
    except AnalysisException:
        if not missing_ok:
            raise
        return spark.createDataFrame([], VOCABULARY)


def vocabulary_terms(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.select("raw_term").na.drop()


def save_vocabulary(vocabulary: DataFrame, path: str) -> str:
    """Most frequent terms first, then by name."""
    return write_csv(vocabulary.select("raw_term", "frequency").orderBy(F.desc("frequency"), "raw_term"), path)


def allergen_list(text: Column) -> Column:
    """A comma list, trimmed and upper-cased; null or blank gives an empty list: no label, not free of allergens."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda s: F.upper(F.btrim(s)))
    return F.filter(items, lambda s: s != "")


def load_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth with its allergens as a list; a missing column is an error."""
    wanted = [c.split()[0] for c in GROUND_TRUTH.split(", ")]
    missing = sorted(set(wanted) - set(read_csv(spark, path).columns))
    if missing:
        raise ValueError(f"the ground truth lacks the columns {missing}")
    return read_csv(spark, path, GROUND_TRUTH).withColumn("allergens", allergen_list(F.col("ground_truth_allergens"))).drop("ground_truth_allergens")


def load_ocr_results(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, OCR_RESULTS)


def write_json(df: DataFrame, path: str) -> str:
    """One JSON object a row, nested structures as they are."""
    df.write.json(path)
    return path


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTIONS).json(path)


def markdown_table(df: DataFrame, order: str) -> DataFrame:
    """(pos, line) of a table in Markdown: header, rule, and a row for every row of a small aggregate, by `order`."""
    spark, names = df.sparkSession, df.columns
    head = spark.createDataFrame([(0, "| " + " | ".join(names) + " |"), (1, "|" + "---|" * len(names))], "pos int, line string")
    body = df.select((F.row_number().over(W.orderBy(order)) + 1).alias("pos"), F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in names]), F.lit(" |")).alias("line"))
    return head.unionByName(body)
