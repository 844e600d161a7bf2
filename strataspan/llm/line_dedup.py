"""Line dedup with DataFrame functions only: explode normalised lines, hash, count distinct documents, reassemble.

Lines that many documents share are removed everywhere but in the document with the largest id. A line's key is the
line without surrounding white space, A-Z lower-cased; only keys of ``min_chars`` code points or more count.

Defined results: a null or empty text is one empty line and stays as it is; a repeated line inside one document
counts once for that document, and all its occurrences stay or go together; rows that repeat a doc_id are one
document for the counts and for the choice of the keeper, but each row loses its own lines only; a null doc_id counts
as one document and never wins over an id; an empty table gives an empty result; any further columns of the input are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.llm.common import table

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The input's columns with ``text_col`` replaced by the kept lines, plus ``n_lines`` and ``n_dropped``.

    Two scans, three shuffles: hashes of each document's lines (partial counts first), the same lines with their
    positions against the keys to drop, and texts by row. A key is a 128-bit pair of hashes and its length: keys are
    counted by the hashes and joined by all three, so that the counts get an exchange of their own and the adaptive skew
    join can split the lines of a hot key. A row is known by its id and a 128-bit pair of hashes of its text, which survive
    reading the input again; rows equal in both lose the same lines. The columns ``n_lines`` and ``n_dropped`` replace input columns of that name.
    """
    carried = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    inner = docs.select(F.col(id_col).alias("__id"), F.struct(*carried).alias("__row"), F.col(text_col).alias("__text"))
    # a null text is one empty line, and loses none
    inner = inner.withColumns({"__t1": F.xxhash64("__text"), "__t2": F.xxhash64(F.lit(11), F.col("__text"), F.char_length("__text"))})
    keyed = (
        inner.select("__id", "__t1", "__t2", F.posexplode(_lines("__text")).alias("pos", "line"))
        .select("__id", "__t1", "__t2", "pos", _key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("__id", "__t1", "__t2", "pos", F.char_length("key").alias("n_key"), F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(11), F.col("key"), F.char_length("key")).alias("h2"))
    )
    # one row for a document and key first, so that a repeated line counts once
    seen = (
        keyed.groupBy("h1", "h2", "__id").agg(F.max("n_key").alias("n_key"))
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("__id").alias("last"), F.max("n_key").alias("n_key"))
        .where(F.col("n") >= min_docs).select("h1", "h2", "n_key", "last")
    )
    gone = (
        keyed.join(seen, ["h1", "h2", "n_key"]).where(~F.col("__id").eqNullSafe(F.col("last")))
        .groupBy(F.col("__id").alias("__gone"), F.col("__t1").alias("__g1"), F.col("__t2").alias("__g2")).agg(F.collect_set("pos").alias("at"))
    )
    lines = _lines("__text")
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.coalesce("at", F.array().cast("array<int>")))
    own_row = F.col("__id").eqNullSafe(F.col("__gone")) & (F.col("__t1") == F.col("__g1")) & (F.col("__t2") == F.col("__g2"))
    out = (
        inner.join(gone, own_row, "left")
        .withColumn("__lines", lines)
        .withColumn("__kept", F.when(F.col("at").isNull(), F.col("__text")).otherwise(
            F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")))
        .select("__row", "__kept", F.size("__lines").cast("long").alias("n_lines"), F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n_dropped"))
    )
    return out.select(*[F.col("__kept").alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in carried], "n_lines", "n_dropped")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
bad AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT q.doc_id, q.pos, q.line, b.k IS NOT NULL AND q.doc_id <> b.last AS gone
  FROM keyed q LEFT JOIN bad b ON q.k = b.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
