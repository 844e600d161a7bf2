"""Preparation of token tables: text forms, numbers as text, dates, maps, heads and orders of first appearance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataspan.operators.spectrum import _S, spectrum
from strataspan.plans.registry import query
from strataspan.sources.tables import NAMES_SQL, VOCAB_SQL, matrix, names, read, vocab

BOUNDARY = "##"


def prepared(text):
    """A token as the distance is prepared for: two boundary marks, then the token in lower case."""
    return F.concat(F.lit(BOUNDARY), F.lower(F.coalesce(text, F.lit(""))))


@query("prepared_tokens", f"WITH {NAMES_SQL} SELECT cluster_id, '{BOUNDARY}' || lower(token_str) AS prepared, replace(token_str, ' ', '_') AS file_name, token_str LIKE 's%' AS starts, token_str LIKE '%e' AS ends FROM names")
def prepared_tokens(spark, sf_dir):
    t = F.col("token_str")
    return names(spark, sf_dir).select("cluster_id", prepared(t).alias("prepared"), F.replace(t, F.lit(" "), F.lit("_")).alias("file_name"), t.startswith("s").alias("starts"), t.endswith("e").alias("ends"))


def standardised(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(token_id, cluster_id, token_str): the text from the row where it has one, else by its id; an id without text is an error."""
    found = rows.join(texts.select("token_id", F.col("token_str").alias("by_id")), "token_id", "left")
    missing = F.raise_error(F.concat(F.lit("no text for token "), F.col("token_id").cast("string")))
    return found.select("token_id", "cluster_id", F.coalesce("token_str", "by_id", missing).alias("token_str"))


@query("standardised_input", f"WITH {VOCAB_SQL} SELECT token_id, cluster_id, token_str FROM vocab WHERE token_id IN (SELECT vec_id FROM embeddings)")
def standardised_input(spark, sf_dir):
    """Rows of which every third lacks its text, completed from the vocabulary."""
    texts = vocab(spark, sf_dir).join(matrix(spark, sf_dir).select(F.col("row_id").alias("token_id")), "token_id", "left_semi")
    return standardised(texts.withColumn("token_str", F.when(F.col("token_id") % 3 > 0, F.col("token_str"))), texts.select("token_id", "token_str"))


@query("number_texts", _S + "SELECT idx, 'dim' || lpad(CAST(scale AS VARCHAR), 4, '0') AS name, CAST(CAST(round(100 * energy / sum(energy) OVER ()) AS BIGINT) AS VARCHAR) || '%' AS share FROM sp")
def number_texts(spark, sf_dir):
    """Widths and shares as they stand in file names and tables."""
    s = spectrum(spark, sf_dir)
    total = s.agg(F.sum("energy").alias("total"))
    share = F.round(100 * F.col("energy") / F.col("total")).cast("long").cast("string")
    return s.join(total).select("idx", F.concat(F.lit("dim"), F.lpad(F.col("scale").cast("string"), 4, "0")).alias("name"), F.concat(share, F.lit("%")).alias("share"))


@query("run_dates", "SELECT strftime(CAST(o_orderdate AS DATE), '%Y%m') AS month, count(*) AS n_runs, CAST(date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS INT) AS span_days FROM orders GROUP BY 1")
def run_dates(spark, sf_dir):
    """Records by month, as run folders are named by date."""
    day = F.col("o_orderdate").cast("date")
    return read(spark, sf_dir, "orders").groupBy(F.date_format(day, "yyyyMM").alias("month")).agg(F.count(F.lit(1)).alias("n_runs"), F.date_diff(F.max(day), F.min(day)).alias("span_days"))


@query("cluster_maps", f"WITH {NAMES_SQL}, l AS (SELECT cluster_id, length(token_str) AS len, count(*) AS n FROM names GROUP BY ALL) SELECT cluster_id, CAST(count(*) AS INT) AS n_lengths, CAST(max(n) AS BIGINT) AS most, CAST(coalesce(max(n) FILTER (WHERE len = 10), 0) AS BIGINT) AS of_ten FROM l GROUP BY cluster_id")
def cluster_maps(spark, sf_dir):
    """Counts by length as a map for each cluster, and what is looked up in it."""
    n = names(spark, sf_dir).groupBy("cluster_id", F.char_length("token_str").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("cluster_id").agg(F.map_from_entries(F.collect_list(F.struct("len", "n"))).alias("m"))
    return m.select("cluster_id", F.size("m").alias("n_lengths"), F.array_max(F.map_values("m")).alias("most"), F.coalesce(F.try_element_at("m", F.lit(10)), F.lit(0)).cast("long").alias("of_ten"))


@query("spectrum_head", _S + "SELECT idx, round(value, 6) AS value FROM sp ORDER BY idx LIMIT 5")
def spectrum_head(spark, sf_dir):
    """A report: the five largest singular values."""
    return spectrum(spark, sf_dir).orderBy("idx").limit(5).select("idx", F.round("value", 6).alias("value"))


@query("first_seen_order", "WITH f AS (SELECT lang, min(doc_id) AS first FROM documents WHERE lang IS NOT NULL GROUP BY lang) SELECT lang, first, CAST(row_number() OVER (ORDER BY first) - 1 AS INT) AS ordinal FROM f")
def first_seen_order(spark, sf_dir):
    """Kinds in the order in which they are first seen; kinds are a bounded number."""
    first = read(spark, sf_dir, "documents").where("lang IS NOT NULL").groupBy("lang").agg(F.min("doc_id").alias("first"))
    return first.withColumn("ordinal", F.row_number().over(W.orderBy("first")) - 1)


def coerced(rows: DataFrame) -> DataFrame:
    """(row_id, features as array<float>, n_columns); rows of unequal sizes, or null or non-finite entries, are an error."""
    width = rows.agg(F.max(F.size("features")).alias("width"))
    x = F.transform("features", lambda v: v.cast("float"))
    ok = (F.size("features") == F.col("width")) & F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    bad = F.raise_error(F.concat(F.lit("row does not fit the matrix: "), F.col("row_id").cast("string"))).cast("int")
    return rows.join(F.broadcast(width)).select("row_id", x.alias("features"), F.when(ok, F.col("width")).otherwise(bad).alias("n_columns"))


@query("matrix_shape", "SELECT count(*) AS n_rows, CAST(max(len(embedding)) AS INT) AS n_columns, round(sum(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE)))), 3) + 0.0 AS total FROM embeddings")
def matrix_shape(spark, sf_dir):
    """The matrix brought to one form, and its shape."""
    rows = coerced(matrix(spark, sf_dir))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.max("n_columns").alias("n_columns"), (F.round(F.sum(F.aggregate("features", F.lit(0.0), lambda a, v: a + v.cast("double"))), 3) + 0.0).alias("total"))
