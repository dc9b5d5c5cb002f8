"""From raw documents to token ids in five stages, each a training-data operator over what the one before it kept.

Every stage but the last returns the columns of documents. ``run`` writes each stage's result as Parquet in the
shared folder, rereads it for the next stage, and deletes it once the next one is written.

Defined results: a null, empty or blank text fails the base rules and goes in the first stage. A null id is an id of its own
to the first stage and the last one everywhere else, and a null source is a source. Rows alike in id and text are treated
alike by the first two stages and are one document to the third; the mix takes a document once for each pass, so ids repeat
after it. Texts are used whole, however long. Further columns pass through all stages but the last, whatever their
names; without rows every stage returns its columns and no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from creditloom.llm import line_dedup, minhash_dedup, mixing, quality_rules, sentencepiece_fst
from creditloom.llm.base import table
from creditloom.session import fresh_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line frequencies of their host don't reject."""
    return quality_rules.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line equals or nearly equals; documents left without a word go."""
    return line_dedup.without_repeats(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return minhash_dedup.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each pass over them."""
    return mixing.mix_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip."""
    return sentencepiece_fst.encoded(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_dedup", near_duplicate_stage),
    ("source_mixing", mixing_stage),
    ("sentencepiece", token_stage),
]

# SQL can express neither the hashed draws of the mix nor the shortest paths of the encoder; the tests hold run()'s
# rows against a brute-force version.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        written = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(written)
        if path:
            _delete(spark, path)
        docs, path = spark.read.parquet(written), written
    return docs
