"""From raw documents to token ids, in five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and judges all rows that its predecessor kept. The first four
return rows with the columns of documents; the last returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import bpe, decontamination, jaccard, substrings, toxicity
from tidewater.llm.queries import PATTERN, RANKS
from tidewater.llm.scratch import Scratch


_open: list[Scratch] = []


def _scratch(spark: SparkSession, docs: DataFrame, name: str) -> Scratch:
    """A place for one stage's tables; those of earlier stages go once docs is read from files that are not among them."""
    files = docs.inputFiles()
    for old in [s for s in _open if files and not any(s.root.split("://")[-1] in f for f in files)]:
        old.close()
        _open.remove(old)
    _open.append(Scratch(spark, name))
    return _open[-1]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; labels of held-out documents are not learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~toxicity.held_out())
    entries, beta = toxicity.fit(docs, labels)
    return toxicity.scores(docs, entries, beta).where("NOT toxic").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five-word n-grams, similarity 0.8 or more."""
    return jaccard.one_of_each(docs, n=5, p=80, q=100, scratch=_scratch(spark, docs, "ngram_jaccard"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 50-word windows that an earlier document has too; n_chars follows the text."""
    return substrings.without_repeats(docs, window=50, scratch=_scratch(spark, docs, "substring_dedup")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), _scratch(spark, docs, "decontamination"))


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids_sha256 and token_ids (little-endian unsigned 32-bit integers)."""
    _scratch(spark, docs, "byte_bpe")
    ids = F.col("token_ids")
    return bpe.encode_column(docs, RANKS, PATTERN).select("doc_id", "lang", "source", (F.length(ids) / 4).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), ids)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_each),
    ("substring_dedup", drop_repeats),
    ("decontamination", drop_leaks),
    ("byte_bpe", to_token_ids),
]

#: The first stage learns weights, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
