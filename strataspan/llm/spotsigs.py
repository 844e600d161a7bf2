"""Document fingerprints by spot signatures, with DataFrame functions only.

Every common word (an anchor) of a text opens a chain of the next ``CHAIN`` content words, skipping common ones, within
``REACH`` words; the hash of anchor and chain is a signature, and the sorted set of them is the fingerprint. A text
without any chain uses all its words as they stand. Likeness is the Jaccard similarity of two sets.

``spot_matches`` finds classes of alike sets in a corpus: likeness of t needs set lengths within a factor t, so sets are
dealt to length partitions of which neighbours alone are compared; inside, sets meet by the rarest signatures, of
which any two sets alike enough share one. Equal sets are one node.

Defined results: null and empty texts have the empty fingerprint, and likeness of two empty sets is 1, of one empty
set 0; ties of ids are broken by nothing (rows that repeat an id are each joined to the one neighbour of that id); an
empty table gives an empty result; a table of one document has itself as its neighbour; a row with a null id has no
neighbour, so its tail is lost and its likeness to the next is that to the empty set; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataspan.llm.common import Settled, parts, table
from strataspan.llm.components import classes_of_buckets

CHAIN, REACH, THRESHOLD = 2, 8, 0.8
#: Common words of English, French, German and Spanish: the anchors.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you "
    "au aux ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous par pas pour que qui sa se ses son sur un une vous "
    "als am auch auf aus bei das dass dem den der die ein eine einem einen einer er es für hat ich im ist mit nach nicht sich sie sind so und von war wie wird zu zum zur "
    "al con del el ella ese esta este ha las lo los más me mi muy no para pero por si sin sobre su sus todo y ya"
).split()


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def signatures(text: Column) -> Column:
    """The sorted set of a text's signatures: 32 bits of md5 in hexadecimal."""
    w = words(text)
    anchor = lambda x: x.isin(ANCHORS)

    def ahead(t: Column, i: Column) -> Column:
        # word by word: a slice of t would copy all of t for every anchor
        return F.array(*[F.get(t, i + k) for k in range(1, REACH + 1)])

    def chain(t: Column) -> Column:
        # (anchor, its chain) of every anchor, where the chain is complete
        opened = F.filter(F.transform(t, lambda x, i: F.when(anchor(x), F.concat(
            F.array(x), F.slice(F.filter(ahead(t, i), lambda y: ~anchor(y)), 1, CHAIN)))), lambda c: c.isNotNull() & (F.size(c) == CHAIN + 1))
        plain = F.transform(t, lambda x: F.array(x))
        either = F.element_at(F.transform(F.array(opened), lambda o: F.when(F.size(o) > 0, o).otherwise(plain)), 1)
        return F.sort_array(F.array_distinct(F.transform(either, lambda c: F.substring(F.md5(F.array_join(c, " ")), 1, 8))))

    # a one-row lambda binds the words once
    return F.element_at(F.transform(F.array(w), chain), 1)


def packed(sigs: Column) -> Column:
    return F.unhex(F.array_join(sigs, ""))


def unpacked(raw: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.hex(raw)), F.lit(".{8}"), F.lit(0))


def numbers(sigs: Column) -> Column:
    """Signatures as 32-bit numbers in the same order, which take less room where sets are exploded."""
    return F.transform(sigs, lambda s: (F.conv(s, 16, 10).cast("long") - (1 << 31)).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both)).cast("double")


def neighbours(ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, next_id): for every id the next smaller one, for the smallest the largest.

    Ids are dealt to ranges by approximate quantiles; a window in each range and one over the ranges' ends (one row
    a range) give the neighbours, so that no task sees all ids.
    """
    spark = ids.sparkSession
    own = ids.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()
    n = max(2, parts(spark))
    cuts = own.agg(F.percentile_approx("id", F.array(*[F.lit(i / n) for i in range(1, n)]), 1000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    # the place of an id among the cuts, by halving
    place = _place("id", cuts)
    ranged = own.withColumn("r", place)
    inner = ranged.withColumn("next_id", F.lag("id").over(W.partitionBy("r").orderBy("id")))
    ends = ranged.groupBy("r").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    order = W.orderBy("r")  # one row for each range
    ends = ends.withColumn("before", F.lag("hi").over(order)).withColumn("top", F.max("hi").over(W.partitionBy()))
    first = ends.select(F.col("lo").alias("id"), F.coalesce("before", "top").alias("wrap"))
    return inner.join(F.broadcast(first), "id", "left").select("id", F.coalesce("next_id", "wrap").alias("next_id"))


def _place(column: str, cuts: list) -> Column:
    if not cuts:
        return F.lit(0)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(column) <= F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and the likeness to the edited and to the next text.

    The texts are shuffled once; what a neighbour lends (as many characters as are replaced, and its set) is sent to
    the document that borrows them.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sized = own.select("id", F.char_length("text").cast("long").alias("n_chars"))
    link = neighbours(own, "id")
    # for each document the one that borrows from it, and how many characters at most
    need = sized.groupBy("id").agg(F.max("n_chars").alias("n"))
    borrow = link.join(need, "id").select(F.col("next_id").alias("id"), F.col("id").alias("borrower"), F.floor(F.col("n") / 3).cast("int").alias("most"))
    # sets travel as bytes, four for a signature; both uses below read one exchange
    signed = own.withColumn("sigs", packed(signatures(F.col("text"))))
    full = signed.join(borrow, "id", "left")
    lent = full.groupBy("borrower").agg(F.min(F.struct(F.substring(F.col("text"), F.lit(1), F.col("most")).alias("head"), F.col("sigs").alias("next_sigs"))).alias("x")).select(F.col("borrower").alias("id"), "x.*")
    joined = full.select("id", "text", "sigs").join(lent, "id", "left")
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - cut).cast("int")), F.coalesce(F.substring(F.col("head"), F.lit(1), cut), F.lit("")))
    out = joined.select(
        "id", n.cast("long").alias("n_chars"), edited.alias("edited"), unpacked(F.col("sigs")).alias("sigs"), unpacked(F.coalesce("next_sigs", F.lit(b""))).alias("next_sigs"))
    out = out.withColumn("edited_sigs", signatures(F.col("edited")))
    return out.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.array_join("sigs", "").alias("fingerprint"),
        F.array_join("edited_sigs", "").alias("edited_fingerprint"), likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def ranked_sets(each: DataFrame, often: DataFrame) -> DataFrame:
    """(rep, n, x): each set's signatures with their counts, rarest first, from (rep, n, s) and (s, c). ``often`` is a
    written table, so that it has an exchange of its own and the adaptive join can split the sets of a hot signature."""
    return each.join(often, "s").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("x"))


def spot_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id) of rows whose signature sets are linked by a likeness of ``threshold`` or more.

    Signatures are ranked by how many sets hold them, rarest first. Two sets that are alike enough share one of the
    first n - ceil(t n) + 1 signatures of each; sets meet in the buckets of these and of the length partitions that
    can match, one leader of a bucket at a time, and are compared whole. A signature that one set alone holds comes
    before all others and makes no bucket, so only its number is kept; a set that has too many of them is like no other.
    """
    spark = docs.sparkSession
    sets = docs.select(F.col(id_col).alias("id"), numbers(signatures(F.col(text_col))).alias("sigs")).where("id IS NOT NULL")
    settled = Settled(spark)
    signed = settled(sets.withColumn("h", F.sha2(F.array_join(F.col("sigs").cast("array<string>"), " "), 256)))
    nodes = settled(signed.groupBy("h").agg(F.min("id").alias("rep"), F.first("sigs").alias("sigs")))
    each = nodes.select("rep", F.size("sigs").alias("n"), F.explode("sigs").alias("s"))
    # an equal set is one node, so a signature is common when two nodes hold it
    often = settled(each.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    least = F.ceil(F.col("n") * threshold - 1e-9)
    ranked = settled(ranked_sets(each, often).where(F.size("x") >= least))
    prefix = F.slice("x", 1, (F.size("x") - least + 1).cast("int"))
    # sets of lengths within a factor t lie in one length partition or in two neighbouring ones
    part = F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold)).cast("int")
    rows = settled(ranked.select(F.col("rep").alias("a"), part.alias("l"), F.explode(prefix).alias("p")).select("a", F.explode(F.array("l", F.col("l") + 1)).alias("band"), F.col("p.s").alias("sig")))
    lead = settled(rows.groupBy("band", "sig").agg(F.min("a").alias("b"), F.max("a").alias("z")).where("b <> z").drop("z"))
    shared = settled(rows.join(lead, ["band", "sig"]))
    whole = settled(nodes.join(shared.select(F.col("a").alias("rep")).distinct(), "rep", "left_semi").select("rep", "sigs"))

    def verify(pairs: DataFrame) -> DataFrame:
        one, two = whole.select(F.col("rep").alias("a"), F.col("sigs").alias("sa")), whole.select(F.col("rep").alias("b"), F.col("sigs").alias("sb"))
        wide = pairs.join(one, "a").join(two, "b")
        # lengths first: they bound the likeness
        near = F.least(F.size("sa"), F.size("sb")) >= threshold * F.greatest(F.size("sa"), F.size("sb"))
        return wide.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("double").alias("overlap"), (near & (likeness(F.col("sa"), F.col("sb")) >= threshold)).alias("linked"))

    shares = settled(ranked.select(F.col("rep").alias("a"), F.col("n").cast("double").alias("total"), F.size("x").cast("double").alias("common")))
    labels = classes_of_buckets(shared, lead, verify, lambda some: shares.join(some, "a", "left_semi"), threshold)
    classes = signed.select("id", "h").join(nodes.select("h", "rep"), "h").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    return classes.groupBy("id").agg(F.min(F.coalesce("label", "rep")).alias("class_id")).withColumnRenamed("id", id_col)


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def spot_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of alike signature sets over all documents, by length partitions and pruned Jaccard."""
    return spot_matches(table(spark, sf_dir, "documents"))


_LIST = ", ".join(f"'{w}'" for w in dict.fromkeys(ANCHORS))


def _sql_sigs(text: str) -> str:
    return f"""(SELECT list_sort(list_distinct(list_transform(CASE WHEN len(o) > 0 THEN o ELSE list_transform(t, lambda x: [x]) END,
      lambda c: substr(md5(array_to_string(c, ' ')), 1, 8))))
    FROM (SELECT t, list_filter(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN t[i] IN ({_LIST}) THEN
        list_concat([t[i]], list_filter(t[i + 1 : i + {REACH}], lambda y: y NOT IN ({_LIST}))[1:{CHAIN}]) END),
        lambda c: c IS NOT NULL AND len(c) = {CHAIN + 1}) AS o
      FROM (SELECT list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS t)))"""


OP4_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
l AS (SELECT doc_id, text, n, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nxt FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT doc_id, n, text, nxt, substr(text, 1, CAST(n - n // 3 AS INT)) || substr(nxt, 1, CAST(n // 3 AS INT)) AS edited FROM l),
s AS (SELECT doc_id, n, edited, {_sql_sigs('text')} AS a, {_sql_sigs('edited')} AS b, {_sql_sigs('nxt')} AS c FROM e)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
  CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END::DOUBLE AS near_edited,
  CASE WHEN len(a) = 0 AND len(c) = 0 THEN 1.0 ELSE len(list_intersect(a, c))::DOUBLE / (len(a) + len(c) - len(list_intersect(a, c))) END::DOUBLE AS near_next
FROM s
"""
