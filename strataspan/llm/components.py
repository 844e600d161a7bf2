"""Connected components by minimum labels and pointer jumping, and classes of documents that share buckets.

Intermediate tables are written to the shared folder, so a lost executor costs no recomputation of earlier rounds and
plans do not grow with the rounds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataspan.llm.common import Settled

#: Leaders of a bucket in one round.
LEADERS = 256
#: Room for rounding in sums of weights.
SLACK = 1e-6


def components(links: DataFrame, a: str = "a", b: str = "b", settled: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, label) of all nodes in ``links`` (pairs of ids), label the smallest id of the component.

    Each round is two joins and an aggregation over links and labels. Star-shaped groups settle in two rounds, a chain
    of n links in about log n.
    """
    settled = settled or partial(Settled(links.sparkSession), narrow=True)
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = settled(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = settled(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"))
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.u).select("node", "label", F.least("label", "near").alias("to"))
        far = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        new = settled(step.join(far, "to", "left").select("node", F.least("to", "far").alias("new"), (F.least("to", "far") < F.col("label")).alias("moved")))
        labels = new.select("node", F.col("new").alias("label"))
        if new.where("moved").isEmpty():
            return labels


def classes_of_buckets(
    shared: DataFrame, lead: DataFrame, verify: Callable[[DataFrame], DataFrame], bounds: Callable[[DataFrame], DataFrame], threshold: float, sigs: DataFrame | None = None,
) -> DataFrame:
    """(node, label) of the components of all links between members of a bucket.

    ``shared``: (band, sig, a, b), a row for each member a of a bucket (band, sig) and its first leader b; ``lead``:
    (band, sig, b). ``verify`` gives (a, b, overlap, linked) of some pairs (a, b): the weight that their sets share,
    and whether their Jaccard similarity is ``threshold`` or more. A bucket of n members makes n pairs a leader, and
    takes further leaders until all its components have met.

    Most members that stay apart never need to: ``bounds`` gives (a, total, common) of some nodes, the weight of their
    sets and what of it any other of these nodes has too. Two sets share at most the smaller of their overlaps with
    the bucket's first leader, and the smaller of what they have in common with others besides. That rules out links
    without looking; a member that is barred from all links leaves its buckets. So no link is missed, and a large
    group of texts that are all somewhat alike makes few pairs.

    ``sigs``: (a, sigs) with the buckets of each node by band, if each has one in every band: then two nodes meet in
    the first band only that holds both.
    """
    settled = partial(Settled(shared.sparkSession), narrow=True)
    leads = lead.select("band", "sig", "b")
    met = settled(shared.where("a <> b").select("a", "b").distinct())
    first = settled(verify(met))
    labels = components(first.where("linked"), settled=settled)
    apart = _apart(shared.select("band", "sig", "a", "b"), labels, settled)
    bound = bounds(apart.select("a").distinct()).where(F.col("common") >= threshold * F.col("total") - SLACK)
    overlap = F.when(F.col("a") == F.col("b"), F.col("total")).otherwise(F.coalesce("overlap", F.lit(0.0)))
    members = settled(apart.join(bound, "a").join(first.select("a", "b", "overlap"), ["a", "b"], "left").select("band", "sig", "a", "total", "common", overlap.alias("overlap")))
    # a over (x + y - a) >= t, for the largest a
    share = threshold / (1 + threshold)
    moved, turn = True, 0
    while True:
        turn += 1
        # tables that only grow are united from what was written; now and then they are written as one
        whole = settled if turn % 8 == 0 else lambda df: df
        members = _apart(members, labels, settled) if moved else members
        new, members = _leaders(members, leads, settled)
        if new.isEmpty():
            return labels
        leads = whole(leads.unionByName(new.select("band", "sig", "b")))
        left = members
        own = members.select(F.col("band").alias("bband"), F.col("sig").alias("bsig"), F.col("a").alias("b"), F.col("total").alias("btotal"), F.col("common").alias("bcommon"), F.col("overlap").alias("boverlap"))
        new = new.withColumnsRenamed({"band": "bband", "sig": "bsig", "comp": "bcomp"}).join(own, ["bband", "bsig", "b"])
        most = F.least("overlap", "boverlap") + F.least(F.col("common") - F.col("overlap"), F.col("bcommon") - F.col("boverlap"))
        meet = (F.col("comp") != F.col("bcomp")) & (F.least(most, "common", "bcommon") >= share * (F.col("total") + F.col("btotal")) - SLACK)
        if sigs is not None:
            left = left.join(sigs.withColumnRenamed("sigs", "asigs"), "a")
            new = new.join(sigs.select(F.col("a").alias("b"), F.col("sigs").alias("bsigs")), "b")
            meet &= F.array_position(F.zip_with("asigs", "bsigs", lambda x, y: x == y), True) == F.col("band") + 1
        pairs = left.join(new, (F.col("band") == F.col("bband")) & (F.col("sig") == F.col("bsig")) & meet).select("a", "b").distinct()
        seen = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pairs = settled(pairs.join(seen, ["a", "b"], "left_anti"))
        links = None
        if not pairs.isEmpty():
            met = whole(met.unionByName(pairs))
            links = settled(verify(pairs).where("linked"))
        moved = links is not None and not links.isEmpty()
        if not moved:
            continue
        # links between components move their labels
        of = lambda x, y: labels.select(F.col("node").alias(x), F.col("label").alias(y))
        merged = links.join(of("a", "la"), "a", "left").join(of("b", "lb"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).distinct()
        joined = components(merged, settled=settled)
        old = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        fresh = joined.join(labels.select("node"), "node", "left_anti")
        labels = settled(old.unionByName(fresh.select("node", "label")))


def _apart(members: DataFrame, labels: DataFrame, settled: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The members of buckets that hold two components or more, each with its component as ``comp``."""
    own = labels.select(F.col("node").alias("a"), F.col("label").alias("own"))
    named = members.drop("comp").join(own, "a", "left").withColumn("comp", F.coalesce("own", "a")).drop("own")
    mixed = named.groupBy("band", "sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band", "sig")
    return settled(named.join(mixed, ["band", "sig"]))


def _leaders(members: DataFrame, leads: DataFrame, settled: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(band, sig, b, comp): the next leaders of buckets in which members of two components have not led; and the
    members of these buckets. Other buckets are finished for good, so later rounds leave them out.

    Two components have met when all members of one have led. So the component with the most members left needs no
    leader, and of up to LEADERS others, those with the fewest left first, the smallest member leads next.
    """
    left = members.join(leads.withColumnRenamed("b", "a"), ["band", "sig", "a"], "left_anti")
    groups = settled(left.groupBy("band", "sig", "comp").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")))
    several = groups.groupBy("band", "sig").agg(F.count(F.lit(1)).alias("comps")).where("comps > 1")
    rank = F.row_number().over(W.partitionBy("band", "sig").orderBy("n", "b"))
    new = settled(groups.withColumn("rank", rank).where(F.col("rank") <= LEADERS).join(several, ["band", "sig"])
                   .where("rank < comps").select("band", "sig", "b", "comp"))
    return new, settled(members.join(several.select("band", "sig"), ["band", "sig"], "left_semi"))
