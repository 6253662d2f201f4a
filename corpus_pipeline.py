"""From raw documents to tokens: the stages, each a function of (spark, docs, folder of the tables).

Every stage but the last returns the columns it was given. ``run`` applies them to the
documents table, each stage's result written to the shared folder and read again.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import bpe, decontaminate, jaccard_join, pii, quality
from scanloom.llm.queries import table, vocabulary
from scanloom.llm.shared import free, ship, stored


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones among ``docs``."""
    ship(spark)
    vectored = stored(quality.vectors(docs), "vectors")
    model = quality.fit(vectored.where(~quality.held_out(F.col("key"))), table(spark, folder, "labels"))
    name, = free(docs, "score")
    return quality.with_score(docs, model, name=name).where(F.col(name) >= quality.THRESHOLD).drop(name)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of every group of near-duplicates the document with the least id, once; others that share its id stay if they are unlike."""
    ship(spark)
    return jaccard_join.one_of_each(docs).select(docs.columns)


def _recounted(docs: DataFrame) -> DataFrame:
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def decontaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Contaminated documents go; from the others every occurrence of a benchmark window is cut."""
    names = free(docs, "n_words", "n_hit", "items", "spans")
    found = decontaminate.hits(docs, table(spark, folder, "benchmark"), names=names, cut=True)
    clean = found.where(~decontaminate.contaminated(F.col(names[1]), F.col(names[0])))
    return _recounted(clean.drop(*names))


def without_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Personal data replaced by the name of its kind."""
    ship(spark)
    return _recounted(pii.masked(docs, pii.fit(docs)))


def encoded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every document, their number, and digests of the ids and of the text decoded from them."""
    ship(spark)
    coded = bpe.encode(docs, vocabulary(), decoded=True, keep=["lang", "source"])
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each_group), ("decontamination", decontaminated),
          ("personal_data", without_personal_data), ("tokens", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models, a graph's components and a tokenizer: the stages are tested against brute force instead.
ORACLE_SQL = None
