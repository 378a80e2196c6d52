"""Connected components by hooking and shortcutting, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stash


def _any(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def _flattened(hooks: DataFrame) -> DataFrame:
    """(id, up) with every ``up`` a root: each pass doubles the way that a node sees."""
    while True:
        above = hooks.select(F.col("id").alias("up"), F.col("up").alias("above"))
        jumped = hooks.join(above, "up", "left").select("id", F.coalesce("above", "up").alias("up"), (F.col("above") != F.col("up")).alias("moved"))
        jumped = stash(jumped, "cc-jumped")
        hooks = jumped.select("id", "up")
        if not _any(jumped.where("moved")):
            return hooks


def components(edges: DataFrame, seen: list[DataFrame] | None = None) -> DataFrame:
    """(id, label) for every node of ``edges`` (a long, b long); label: the smallest id reachable.

    A round hooks every root to the least root among its neighbours, flattens the
    trees that arise, and puts roots in place of the edges' ends. A root that stays
    has either taken a neighbour or stands beside a smaller root afterwards, so two
    rounds halve the roots at least: the rounds follow the logarithm of the nodes,
    however long the chains. ``seen`` collects the rounds' hooks.

    Minima are combined before the shuffle; joins read stored tables on both
    sides, so adaptive execution splits a hub's rows. Every step is a table in the
    shared folder: a lost executor costs no earlier one. Self-loops and repeated
    edges are harmless; no edges give no rows.
    """
    rounds = [] if seen is None else seen
    links = stash(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
    while _any(links):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stash(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("up")), "cc-hooks")
        hooks = _flattened(hooks)
        rounds.append(hooks)
        moved = links
        for end in ("a", "b"):
            moved = moved.join(hooks.select(F.col("id").alias(end), F.col("up").alias(f"{end}_up")), end)
        ends = moved.where("a_up <> b_up").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"))
        links = stash(ends.distinct(), "cc-links")
    if not rounds:
        return links.select(F.col("a").alias("id"), F.col("b").alias("label"))
    labels = rounds[0].select("id", F.col("up").alias("label"))
    for hooks in rounds[1:]:
        above = hooks.select(F.col("id").alias("label"), "up")
        labels = labels.join(above, "label", "left").select("id", F.coalesce("up", "label").alias("label"))
    return labels
