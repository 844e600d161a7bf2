"""Unicode scripts of characters and tokens: one sorted table of code-point ranges, looked up by binary search.

The table holds every script that the JVM's Unicode version knows. It is made once a session from
``Character.UnicodeScript``, by a job over all code points (about two seconds), and goes to the tasks in the closure of
an Arrow function: some 1,600 ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OTHER, MIXED = "Other", "Mixed"
#: Scripts of the property that count as no script.
NO_SCRIPT = ("COMMON", "INHERITED", "UNKNOWN")
CODE_POINTS = 0x110000
#: Code points of a block: ranges are found inside blocks, in parallel, and joined across their borders.
BLOCK_BITS = 12


@dataclass(frozen=True)
class ScriptRanges:
    """``starts`` ascend from 0; the range that begins there has script ``names[ids[k]]``, Other being the last name."""

    starts: np.ndarray
    ids: np.ndarray
    names: tuple[str, ...]

    def of(self, code_points: np.ndarray) -> np.ndarray:
        """The number of each code point's script."""
        return self.ids[np.searchsorted(self.starts, code_points, side="right") - 1]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Characters of each script (columns) in each text (rows); a null or empty text has one of Other."""
        words = texts.to_pylist()
        lengths = np.array([len(w) if w else 0 for w in words], np.int64)
        chars = np.frombuffer("".join(w for w in words if w).encode("utf-32-le", "surrogatepass"), "<u4")
        key = np.repeat(np.arange(len(words)), lengths) * len(self.names) + self.of(chars)
        found = np.bincount(key, minlength=len(words) * len(self.names)).reshape(len(words), len(self.names))
        found[lengths == 0, -1] = 1
        return found

    def dominant(self, texts: pa.Array) -> pa.Array:
        """The script with most characters; in a tie Other yields to one real script, and several real ones are Mixed."""
        found = self.counts(texts)
        best = found == found.max(axis=1, keepdims=True)
        single = best.sum(1) == 1
        best[~single, -1] = False
        names = np.array([*self.names, MIXED], object)
        return pa.array(names[np.where(best.sum(1) == 1, best.argmax(1), len(self.names))], pa.string())


def name_of(script: str) -> str:
    """A script's name as Unicode writes it: words with capitals."""
    return OTHER if script in NO_SCRIPT else "_".join(w.capitalize() for w in script.split("_"))


_made: dict[str, ScriptRanges] = {}


def script_ranges(spark: SparkSession | None = None) -> ScriptRanges:
    spark = spark or SparkSession.active()
    app = spark.sparkContext.applicationId
    if app not in _made:
        cp = F.col("cp")
        scripts = spark.range(CODE_POINTS).select(F.col("id").cast("int").alias("cp")).withColumn("script", F.call_function("java_method", F.lit("java.lang.Character$UnicodeScript"), F.lit("of"), cp))
        before = F.lag("script").over(W.partitionBy(F.shiftright(cp, BLOCK_BITS)).orderBy("cp"))
        borders = scripts.withColumn("before", before).where("before IS NULL OR before <> script").select("cp", "script").collect()
        starts, names = [], []
        for start, name in sorted((r["cp"], name_of(r["script"])) for r in borders):
            if not names or names[-1] != name:
                starts.append(start)
                names.append(name)
        known = (*sorted(set(names) - {OTHER}), OTHER)
        _made[app] = ScriptRanges(np.array(starts), np.array([known.index(n) for n in names]), known)
    return _made[app]


def script_counts(text: Column) -> Column:
    """array<struct<script, n>> of the scripts in a text, Other for the rest; a null or empty text has one Other."""
    ranges = script_ranges()

    @F.arrow_udf("array<struct<script: string, n: int>>")
    def counts(texts: pa.Array) -> pa.Array:
        found = ranges.counts(texts)
        at, script = np.nonzero(found)
        items = pa.StructArray.from_arrays([pa.array(np.array(ranges.names, object)[script], pa.string()), pa.array(found[at, script].astype(np.int32))], ["script", "n"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum((found > 0).sum(1)))).astype(np.int32)), items)

    return counts(text)


def dominant_script(text: Column) -> Column:
    """The script of a text, see :meth:`ScriptRanges.dominant`."""
    ranges = script_ranges()

    @F.arrow_udf("string")
    def dominant(texts: pa.Array) -> pa.Array:
        return ranges.dominant(texts)

    return dominant(text)


def length_bucket(text: Column) -> Column:
    """Buckets of a text's code points: 1-2 (an empty text too), 3-5, 6-10, 11+."""
    n = F.char_length(text)
    return F.when(n <= 2, "1-2").when(n <= 5, "3-5").when(n <= 10, "6-10").otherwise("11+")


#: Scripts that the SQL beside the queries tells apart; all that the given tables have are among them.
SQL_SCRIPTS = (
    "Arabic", "Armenian", "Bengali", "Cyrillic", "Devanagari", "Ethiopic", "Georgian", "Greek", "Gujarati", "Gurmukhi", "Han", "Hangul", "Hebrew",
    "Hiragana", "Kannada", "Katakana", "Khmer", "Lao", "Latin", "Malayalam", "Mongolian", "Myanmar", "Oriya", "Sinhala", "Tamil", "Telugu", "Thai", "Tibetan",
)
SCRIPT_SQL = {s: f"length(regexp_replace(token_str, '[^\\p{{{s}}}]', '', 'g'))" for s in SQL_SCRIPTS}
#: (token_id, token_str, cluster_id, script) in SQL, from vocab.
DOMINANT_SQL = (
    "counts AS (SELECT *, " + ", ".join(f"{e} AS n_{s}" for s, e in SCRIPT_SQL.items()) + " FROM vocab),\n"
    "cand AS (SELECT token_id, token_str, cluster_id, list_filter([" + ", ".join(f"{{'script': '{s}', 'n': n_{s}}}" for s in SQL_SCRIPTS)
    + ", {'script': 'Other', 'n': CASE WHEN token_str = '' THEN 1 ELSE length(token_str) - (" + " + ".join(f"n_{s}" for s in SQL_SCRIPTS) + ") END}], lambda x: x.n > 0) AS c FROM counts),\n"
    "best AS (SELECT *, list_transform(list_filter(c, lambda x: x.n = list_max(list_transform(c, lambda y: y.n))), lambda x: x.script) AS b FROM cand),\n"
    "scripted AS (SELECT token_id, token_str, cluster_id, CASE WHEN len(b) = 1 THEN b[1] WHEN len(list_filter(b, lambda s: s <> 'Other')) = 1 THEN list_filter(b, lambda s: s <> 'Other')[1] ELSE 'Mixed' END AS script FROM best)"
)
