"""Documents to training tokens: toxicity, near-duplicates, personal data, source mix, token ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from accountgraph.llm import mixing, personal, pieces, simhash, toxicity
from accountgraph.storage import stored


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifiers trained on the labelled ones don't find toxic.

    Null and empty texts have no features and stay; equal texts are decided
    alike, so repeated rows stay or go together. Whole texts count. An empty
    table stays empty, and other columns pass through whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.train_from_labels(docs, labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component of fingerprints within two bits, of 3-word shingles.

    Texts without words (null, empty, blanks) are one component. Repeated rows
    leave one; of different texts under one id, the least by hash. A row
    without an id stays only where its component has no id. An empty table
    stays empty, and other columns pass through.
    """
    return simhash.representatives(docs)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind.

    Null texts stay null and empty ones empty; every row stays, repeated or
    not, with its other columns. Whole texts are searched however long.
    """
    return personal.masked(docs, personal.train(personal.labelled_table(spark)))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, repeated or left out as the mix of sources asks.

    Texts without words (null, empty, blanks) have no share in it and go. Null
    sources form a source. Rows that agree in id and text lie next to each other
    in their source's stream. An empty table stays empty.
    """
    return mixing.curriculum(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with token ids, and as text what the ids decode to.

    Null and empty texts have no ids. Equal texts have equal ids; every row
    stays. An empty table stays empty, and other columns pass through.
    """
    return pieces.tokenized(docs, pieces.load())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", not_toxic),
    ("near duplicates", one_of_each),
    ("personal data", masked),
    ("source mix", mixed),
    ("tokens", tokens),
]

# Hashing, learned models and tokenizers have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each but the last written as Parquet and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        written = stored(stage(spark, docs, sf_dir), "stage")
        if before is not None:
            before.free()
        docs, before = written.df, written
    return STAGES[-1][1](spark, docs, sf_dir)
