"""Corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, packing.

Each stage works on all its predecessor kept, and its decisions take effect: texts in no learned language go (those
without a letter, those that no language explains better than pieces drawn evenly do, and those of which no language
has a posterior of ``MIN_SCORE``), and a missing language is filled in; shared lines are cut out of the texts, one
document of each near-duplicate class stays (that with the smallest id), documents with a benchmark passage go, and
what is left is packed. All stages but the last return the columns they were given; columns named like a result of an
operator keep their own values.

Defined results: rows with a null id are never near-duplicates of others; of rows that repeat an id one stays, that
with the least hash of its text; where no row has a language none is learned, so no document stays; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.llm.common import shared_dir, table
from strataspan.llm.decontaminate import find_spans
from strataspan.llm.language_id import identify
from strataspan.llm.line_dedup import line_dedup
from strataspan.llm.minhash import near_duplicate_classes
from strataspan.llm.packing import pack_corpus


MIN_SCORE = 0.5


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = identify(docs.withColumn("__row", F.struct(*docs.columns)))
    kept = found.where(F.col("lang_known") & (F.col("score") >= MIN_SCORE))
    return kept.select(*[F.coalesce("__row.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = near_duplicate_classes(docs).where("doc_id <> class_id").select("doc_id")
    kept = docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    again = kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return kept
    # only rows whose id is found more than once are gathered, by id
    best = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("row")).select("row.*")
    return kept.join(again, "doc_id", "left_anti").unionByName(best).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return find_spans(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_corpus(docs).drop("loss_tokens")


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]
#: Language ID, weighted sampling and packing have no SQL form; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):  # the next stage reads its input several times
            docs.write.parquet(f"{path}/{k}-{name}")
            docs = spark.read.parquet(f"{path}/{k}-{name}")
    return docs
