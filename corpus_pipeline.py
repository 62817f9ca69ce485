"""Corpus pipeline: language ID, near and substring de-duplication, decontamination, tokenising.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame,
which is written as Parquet and read again as the next one's documents. All stages but the last return the
columns of their input. Rows stand for themselves: a repeated or missing doc_id loses no document, except that
near-duplicate groups keep one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceweft.llm import decontam, langid, near_dup, substring, unigram
from traceweft.llm.durable import Tables, mark, release
from traceweft.llm.queries import PIECES

#: Similarity of near duplicates, as a percentage.
NEAR = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: empty, without letters, or not likely enough in any."""
    return langid.identify(docs, rows_too=True).where("accepted").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least doc_id, of each group of near duplicates."""
    return near_dup.one_of_each(docs, percent=NEAR)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 50 words or more that an earlier document holds out of the texts; n_chars follows.

    A document of which nothing is left stays, with an empty text.
    """
    out = substring.remove_repeats(docs, rows_too=True)
    text = F.coalesce("kept_text", "row.text")
    new = {"text": text, "n_chars": F.when(F.col("kept_text").isNull(), F.col("row.n_chars")).otherwise(F.length(text)).cast("long")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Each row is judged by its own text, so of rows that share a doc_id, or have none, only those that hold an
    item go. Null and empty texts hold none; long texts are searched whole; without a benchmark all stay.
    """
    key = F.struct("doc_id", F.xxhash64("text").alias("h"))
    pairs = decontam.contaminated(docs.select(key.alias("key"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="key")
    bad = pairs.select(F.col("doc_id").alias("bad")).distinct()
    return docs.join(bad, key.eqNullSafe(F.col("bad")), "left_anti")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, and the text that they decode to.

    Every row gives one, repeated or not; a null or empty text has no pieces and decodes to an empty one.
    """
    return unigram.encoded(docs, unigram.Model.load(PIECES))


STAGES = [
    ("language_id", language),
    ("minhash_near_dup", near_duplicates),
    ("substring_dedup", substrings),
    ("benchmark_decontamination", decontaminate),
    ("sentencepiece", tokenise),
]

#: SQL cannot express the language and tokenising stages; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the table ``documents``; a stage's working tables go as soon as its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = Tables(spark, "pipeline")
    done = None
    for name, stage in STAGES[:-1]:
        since = mark()
        docs = t.keep(name, stage(spark, docs, sf_dir))
        release(since, but=t)
        if done:
            t.drop(done)
        done = name
    return STAGES[-1][1](spark, docs, sf_dir)
