"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, durable


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): the smallest node reachable. nodes: (id); links: (src, dst), any order and repeats.

    Each round hangs every node's larger neighbours under its smallest one (large star), then its
    smaller neighbours under its smallest one (small star). Both use aggregates with map-side
    combine and a join on the node, by broadcast while there are few links; the neighbour lists are never gathered. Rounds end when a round changes nothing;
    each round's links are written to the shared folder.
    """
    edges = durable(links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(), "links")
    mark = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first())
        if now == mark or not now[0]:
            break
        mark = now
        few = F.broadcast if 2 * now[0] <= FEW else lambda df: df
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(few(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(few(low), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = durable(small.where("u <> v").distinct(), "links")
    found = edges.groupBy("u").agg(F.min("v").alias("c"))
    found = F.broadcast(found) if (mark or now)[0] <= FEW else found
    return nodes.join(found, nodes.id == found.u, "left").select("id", F.coalesce("c", "id").alias("component"))
