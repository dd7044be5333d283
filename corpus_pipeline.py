"""Corpus pipeline: each stage keeps, drops or changes documents for the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm import language, leaks, near, packing, pii
from tidewatch.llm.common import carried, table, written
from tidewatch.llm.queries import byte_vocabulary

#: The columns that stages work on; all others travel along.
ID, TEXT = "doc_id", "text"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold no language (no letter, or no text), also where no label teaches one."""
    model = language.learned(docs)
    if not model.labels:  # one language without a name
        model = language.fit([("a", "")])
    tagged = language.tag(carried(docs), model)
    return tagged.filter(F.col("lang_pred") != language.UNDECIDED).select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate class; of rows that repeat its id, one for each text."""
    # read four times below: ids and classes are written once, so that the plan is not repeated
    classes = written(near.classes(docs))
    gone = classes.filter(F.col("class_id") < F.col(ID)).select(ID)
    again = classes.filter(F.col(ID).isNotNull()).groupBy(ID).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(ID)
    once = docs.join(gone.unionByName(again).distinct(), ID, "left_anti")
    repeated = docs.join(again.join(gone, ID, "left_anti"), ID, "left_semi").dropDuplicates([ID, TEXT])
    return once.unionByName(repeated).select(*docs.columns)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that repeat a benchmark item."""
    leaked = leaks.contaminated(docs, table(spark, sf_dir, "benchmark")).select(ID).distinct()
    return docs.join(leaked, ID, "left_anti").select(*docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; n_chars follows where the column is there."""
    out = pii.find(carried(docs), redact=True)
    changed = {TEXT: F.coalesce("clean", f"row.{TEXT}")}
    if "n_chars" in docs.columns:
        size = F.length("clean").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("clean").isNotNull(), size).otherwise(F.col("row.n_chars"))
    return out.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, one row per piece."""
    vocabulary, pattern = byte_vocabulary()
    return packing.pack(docs, vocabulary, pattern)


STAGES: list[tuple[str, Callable]] = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", no_leaks),
    ("personal_data", redacted),
    ("packing", packed),
]

#: The field models, signatures and tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each read from what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
