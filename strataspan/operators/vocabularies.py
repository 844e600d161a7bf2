"""Metrics over the ids of a tokenizer's vocabulary: the rows of the matrix are tokens, and their texts are looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.functions.scripts import dominant_script
from strataspan.operators.orthography import sampled_similarity
from strataspan.operators.scripts import counts_by_script, entropies
from strataspan.plans.registry import query
from strataspan.sources.tables import partition
from strataspan.sources.vocabularies import read_vocabulary, with_texts

#: The vocabulary whose ids the rows of the given matrix stand for.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Text of a row beyond the vocabulary: matrices may have more rows than there are tokens, and such an id decodes to nothing.
NO_TEXT = ""


def vocabulary_scripts(spark: SparkSession, tokenizer: str = TOKENIZER) -> DataFrame:
    """(token_id, script) of every id of the vocabulary, special ones too."""
    return read_vocabulary(spark, tokenizer, "token_id long, token_str string").select("token_id", dominant_script(F.col("token_str")).alias("script"))


@query("vocabulary_entropy")
def vocabulary_entropy(spark, sf_dir, tokenizer: str = TOKENIZER):
    """Script entropy of the clusters of token ids; h_norm is by the scripts of the whole vocabulary, ids without a row
    in the matrix included. Rows beyond the vocabulary have no text, and count as Other."""
    scripts = vocabulary_scripts(spark, tokenizer)
    rows = with_texts(partition(spark, sf_dir).select("token_id", "cluster_id"), read_vocabulary(spark, tokenizer, "token_id long, token_str string"), NO_TEXT)
    tokens = rows.withColumn("script", dominant_script(F.col("token_str")))
    counted = counts_by_script(tokens)
    kinds = scripts.select("script").unionByName(tokens.select("script").distinct()).agg(F.count_distinct("script").alias("k"))
    return entropies(counted, kinds).select("cluster_id", "cluster_size", F.round("h", 6).alias("h"), F.round("h_norm", 6).alias("h_norm"))


@query("vocabulary_similarity")
def vocabulary_similarity(spark, sf_dir, tokenizer: str = TOKENIZER):
    """Orthographic similarity of the clusters of token ids, over the tokens as the vocabulary's file writes them.
    Rows beyond the vocabulary have empty texts."""
    pieces = read_vocabulary(spark, tokenizer, "token_id long, piece string").withColumnRenamed("piece", "token_str")
    rows = with_texts(partition(spark, sf_dir).where("cluster_id >= 0").select("token_id", "cluster_id"), pieces, NO_TEXT)
    return sampled_similarity(rows).select("cluster_id", "cluster_size", F.round("score", 6).alias("score"))
