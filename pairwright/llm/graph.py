"""Connected components of links of any number, and of components of any size.

Random contraction: in each round every node joins the neighbour (or itself) with the smallest
pseudo-random number of the round, links are rewritten to the nodes joined, and links inside one
node go. The expected number of nodes falls by a constant factor each round whatever the shape, so
long chains take a logarithmic number of rounds. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b); component is its smallest node.

    Links may repeat, run either way or join a node with itself; nodes are not NULL.
    """
    links = materialize(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "links",
    )
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    rounds: list[DataFrame] = []
    rest = links.filter("a <> b")
    while not rest.isEmpty():
        salt = F.lit(len(rounds))

        def lot(name: str, salt=salt):
            return F.struct(F.xxhash64(name, salt).alias("lot"), F.col(name).alias("id"))

        seen = rest.select("a", lot("b").alias("other")).union(
            rest.select(F.col("b").alias("a"), lot("a").alias("other"))
        )
        joined = materialize(
            seen.groupBy("a")
            .agg(F.min("other").alias("other"))
            .select("a", F.least("other", lot("a"))["id"].alias("to")),
            "joined",
        )
        rounds.append(joined)
        rest = materialize(
            rest.join(joined.withColumnRenamed("to", "ta"), "a")
            .join(joined.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .filter("a <> b")
            .distinct(),
            "links",
        )
    root = None
    for joined in reversed(rounds):
        if root is None:
            root = joined.select(F.col("a").alias("node"), F.col("to").alias("root"))
            continue
        later = root.select(F.col("node").alias("to"), F.col("root").alias("later"))
        root = joined.join(later, "to", "left").select(
            F.col("a").alias("node"), F.coalesce("later", "to").alias("root")
        )
    if root is None:
        return nodes.select("node", F.col("node").alias("component"))
    root = nodes.join(root, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )
    root = materialize(root, "roots")
    smallest = root.groupBy("root").agg(F.min("node").alias("component"))
    return materialize(root.join(smallest, "root").select("node", "component"), "components")
