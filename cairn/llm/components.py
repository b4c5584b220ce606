"""Connected components of a link table, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """id, label: the smallest id reachable, for every id that has a link. links: x, y (longs, in either order).

    Each round an id takes the smallest label among its neighbours, and so does the id that is its label (the root is
    hooked); then each takes its label's own label. Every tree next to one of smaller root is joined to it, so that rounds
    grow with the logarithm of a chain's length. Rounds end when no label changes; labels only fall, so they do. Labels are
    written after each round; nothing is collected but whether one changed.
    """
    both = cut(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = cut(both.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("y"), "label"), "y").groupBy(F.col("x").alias("id")).agg(F.min("label").alias("near"))
        met = labels.join(near, "id")
        own = met.select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        roots = met.groupBy(F.col("label").alias("id")).agg(F.min("near").alias("label")).select("id", F.lit(None).cast("long").alias("was"), "label")
        lower = own.unionByName(roots).groupBy("id").agg(F.max("was").alias("was"), F.min("label").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = cut(lower.join(up, "label").select("id", "was", F.least("label", "up").alias("label")), "labels")
        labels = new.select("id", "label")
        if new.filter(F.col("was") != F.col("label")).isEmpty():
            return labels


def rejoined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, label) after the links (x, y) between labels; a label that labels doesn't have is an id of its own."""
    if links.isEmpty():
        return labels
    moved = components(links)
    to = moved.select(F.col("id").alias("label"), F.col("label").alias("to"))
    old = labels.join(to, "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    return cut(old.unionByName(moved.join(labels, "id", "left_anti")), "labels")
