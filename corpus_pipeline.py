"""A training corpus from `documents`: language ID, line dedup, SimHash near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and rereads it as the next stage's docs. All but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelens.llm import language_id, line_dedup, packing, simhash, substring_dedup
from placelens.llm.shared import Scratch, unpacked


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without an n-gram of any learned language, go."""
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    out = language_id.predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") > 0))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 code points or more that 3 documents or more hold stay in one of them."""
    return unpacked(line_dedup.line_dedup(docs), docs.columns, "text", F.col("kept"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash.simhash_dedup(docs)


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document of smaller id holds are cut out."""
    return substring_dedup.substring_dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids: a row for each piece, with its ids."""
    return packing.pack(docs)


STAGES = [("language_id", identify), ("line_dedup", dedup_lines), ("simhash_dedup", dedup_near), ("substring_dedup", dedup_substrings), ("packing", pack)]

#: Language ID, SimHash and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = spark.read.parquet(scratch.write(stage(spark, docs, sf_dir)))
    return docs
