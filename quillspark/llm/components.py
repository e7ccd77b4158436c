"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is a grouped minimum (combined before the shuffle) and an equi join; nothing is gathered in one task or on
the driver but a few numbers that tell when to stop. A node with very many links is not joined in one task: see
`spread_join`. Each round's links are checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut

#: Keys that are broadcast at most, and rows that any key may have without being one.
MOST_HOT, LEAST_HOT = 10_000, 256


def hot_from(total: int) -> int:
    """Rows from which on a key is hot; of `total` rows, fewer than MOST_HOT keys can have more."""
    return max(LEAST_HOT, total // MOST_HOT)


def spread_join(rows: DataFrame, summary: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the columns of their key's row in `summary`, whose column n counts the rows of each key (`total` in all).

    Rows of hot keys meet a broadcast of MOST_HOT rows at most, so they stay where they are; the others are shuffled.
    """
    hot = F.col("n") > hot_from(total)
    often, seldom = summary.filter(hot).drop("n"), summary.filter(~hot).drop("n")
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti")
    return rows.join(F.broadcast(often), key).unionByName(rest.join(seldom, key))


def _star(links: DataFrame, large: bool, total: int) -> DataFrame:
    """Links (u, v) with u > v; large: each larger neighbour of a node to the node's least; small: the others."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links.select("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
    joined = spread_join(both, least, "u", 2 * total)
    if large:
        made = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return made.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (a, b); component is the least node that can be reached.

    Links of a node with itself and repeated links change nothing; nulls on a side drop the link; no links, no rows.
    """
    now = cut(
        links.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    mark, total = None, now.count()
    while total:
        now = cut(_star(cut(_star(now, True, total)), False, total))
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark, total = tuple(seen), seen[0]
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
