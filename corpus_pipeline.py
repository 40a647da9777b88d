"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

toxicity -> near duplicates -> repeated passages -> benchmark passages -> mixing
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewatch.llm import decontaminate, mixing, neardup, substring_dedup, toxicity
from framewatch.llm.common import bucket_of, kept, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; the lexicon is learned from labelled ones whose bucket of three is not 1."""
    lexicon = toxicity.fit(toxicity.labelled_sample(docs.filter(bucket_of("doc_id", 3) != 1), table(spark, sf_dir, "labels")))
    return toxicity.score(docs, lexicon, out="__toxicity").filter(F.col("__toxicity") < toxicity.THRESHOLD).drop("__toxicity").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least doc_id."""
    return neardup.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 13 words and more that an earlier document has; n_chars follows a changed text."""
    cut = substring_dedup.remove_repeats(docs.withColumn("__was", F.md5("text")))
    return cut.withColumn("n_chars", F.when(F.md5("text") == F.col("__was"), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document left, with its tokens, likeliest domain, posterior and the rate at which to draw it."""
    model = mixing.fit(mixing.labelled_domains(docs, table(spark, sf_dir, "labels")))
    return mixing.mix_to_targets(docs, model, mixing.even_languages(model.domains))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_domains),
]

#: Learned scores have no SQL form; tests/llm holds the rows that each stage keeps, and the mixing totals, against brute force on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name)
    return docs
