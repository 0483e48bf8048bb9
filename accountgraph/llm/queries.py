"""Registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accountgraph.llm import (
    fertility,
    fingerprint,
    language,
    lexical,
    licences,
    merges,
    mixing,
    negatives,
    personal,
    pieces,
    quality,
    simhash,
    toxicity,
)
from accountgraph.llm.common import in_fold


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def _learned(scores: DataFrame, threshold: float) -> DataFrame:
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return scores.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", predicted)


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = documents(spark, folder), _labels(spark, folder)
    learned = ~in_fold(F.col("doc_id"), 5, 0)
    model = toxicity.train_from_labels(docs.where(learned), labels.where(learned))
    return _learned(toxicity.scored(docs, model), 0.5)


def op2_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    pairs = fingerprint.beside_next(docs, buckets=3 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_chars = F.length("text")
    third = F.floor(n_chars / 3).cast("int")
    edited = F.concat(F.left("text", n_chars - third), F.left("next_text", third))
    both = pairs.select(
        "doc_id", n_chars.cast("bigint").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited")
    ).withColumn("edited_sketch", fingerprint.sketch(F.col("edited")))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.serialised(F.col("sketch")).alias("fingerprint"),
        fingerprint.serialised(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprint.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        fingerprint.containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_in_text"),
        fingerprint.distinct_count(F.col("sketch")).alias("n_shingles"),
    )


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.schedule(documents(spark, folder).select("doc_id", "text", "source"))
    out = mixed.select("doc_id", "mix.*").withColumn("first_time", F.get("times", F.lit(0)))
    return out.orderBy(F.col("first_time").asc_nulls_last(), "doc_id")


def op4_personal(spark: SparkSession, folder: str) -> DataFrame:
    field = personal.train(personal.labelled_table(spark))
    return personal.found(documents(spark, folder), field)


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = documents(spark, folder), _labels(spark, folder)
    learned = ~in_fold(F.col("doc_id"), 5, 0)
    space = quality.train(docs.where(learned), labels.where(learned))
    return _learned(quality.scored(docs, space), 0.3)


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, folder))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    out, name = pieces.encoded(docs, pieces.load())
    same = F.col(f"{name}.decoded") == F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", f"{name}.n_tokens", f"{name}.n_bytes", f"{name}.ids",
        F.sha2(f"{name}.decoded", 256).alias("decoded_sha256"), same.alias("round_trip"),
    )


def op8_fertility(spark: SparkSession, folder: str) -> DataFrame:
    return fertility.judged(documents(spark, folder), fertility.load())


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    held_out = in_fold(F.col("doc_id"), 4, 2)
    network = language.train(docs.where(~held_out).select("doc_id", "text", "lang"))
    return language.predicted(docs, network).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scanned(documents(spark, folder)).drop("span_labels", "span_starts", "span_ends")


def op11_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    mislabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(negatives.whole_numbers(vectors, mislabelled), every=100)


def op12_merges(spark: SparkSession, folder: str) -> DataFrame:
    out, name = merges.encoded(documents(spark, folder).select("doc_id", "text"), merges.load())
    return out.select(
        "doc_id",
        f"{name}.n_tokens",
        F.sha2(f"{name}.packed", 256).alias("ids_sha256"),
        F.sha2(f"{name}.decoded", 256).alias("decoded_sha256"),
    )


def op13_lexical(spark: SparkSession, folder: str) -> DataFrame:
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return lexical.ranked(documents(spark, folder), items)


# Scores of anchors against all rows, in whole numbers that doubles hold exactly.
_NEGATIVES = f"""WITH rows AS MATERIALIZED (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor({negatives.SCALE} * x::DOUBLE)) AS q
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS MATERIALIZED (
        SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
               list_dot_product(a.q, r.q)::BIGINT AS score
        FROM rows a, rows r WHERE a.vec_id % 100 = 0),
    positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored
        WHERE same AND vec_id <> anchor_id
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {negatives.POSITIVES}),
    near AS (
        SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
               row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
        FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
         AND 100 * s.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score)
    SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
    FROM near WHERE rank <= {negatives.NEGATIVES}"""

_TERMS = """list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '')"""
_LEXICAL = f"""WITH texts AS MATERIALIZED (SELECT doc_id, {_TERMS} AS terms FROM documents),
    facts AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM texts WHERE len(terms) > 0),
    sizes AS (SELECT doc_id, 25 + (75 * len(terms) * n) // l AS m FROM texts, facts WHERE len(terms) > 0),
    counts AS MATERIALIZED (
        SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM texts) GROUP BY doc_id, term),
    weights AS (
        SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
        FROM counts, facts GROUP BY term, n),
    asked AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
    scores AS (
        SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
        FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (doc_id) GROUP BY item_id, doc_id),
    places AS (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM places WHERE rank <= {lexical.BEST}"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_fingerprint": op2_fingerprint,
        "op3_mixing": op3_mixing,
        "op4_personal": op4_personal,
        "op5_quality": op5_quality,
        "op6_simhash": op6_simhash,
        "op7_pieces": op7_pieces,
        "op8_fertility": op8_fertility,
        "op9_language": op9_language,
        "op10_licences": op10_licences,
        "op11_negatives": op11_negatives,
        "op12_merges": op12_merges,
        "op13_lexical": op13_lexical,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_negatives": _NEGATIVES, "op13_lexical": _LEXICAL}
