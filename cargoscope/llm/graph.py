"""Connected components of a link table, by rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoscope import session

MAX_ROUNDS = 60  # each round at least halves the depth of every tree; a graph needing more is an error


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; ``component`` is the least node reachable.

    Every node points at a smaller node of its component.  A round hooks each root to the least
    root seen across a link and halves the paths.  Minima are map-side combined, so a node of very
    many links costs one row per task, and the state of a round is written to the shared folder.
    Null ends and self links are ignored; repeated links count once.  An empty table gives an
    empty result.
    """
    links = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y").select(
        F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    links = session.stored(links, "links")
    state = links.select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.col("node").alias("root"))
    for _ in range(MAX_ROUNDS):
        # Links between roots: ends are replaced by the roots of their trees.
        at = lambda name: state.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
        links = session.stored(
            links.join(at("x"), "x").join(at("y"), "y").where("x_root <> y_root")
            .select(F.greatest("x_root", "y_root").alias("x"), F.least("x_root", "y_root").alias("y")).distinct(), "links")
        if links.isEmpty():
            return state.select("node", F.col("root").alias("component"))
        hook = links.groupBy("x").agg(F.min("y").alias("to"))
        # Roots that hooked form chains; two halvings shorten them before the next round.
        up = session.stored(hook, "hook")
        for _ in range(MAX_ROUNDS):
            over = up.select(F.col("x").alias("to"), F.col("to").alias("over"))
            longer = session.stored(up.join(over, "to", "left").select(
                "x", F.coalesce("over", "to").alias("to"), F.col("over").isNotNull().alias("moved")), "hook")
            up = longer.select("x", "to")
            if longer.where("moved").isEmpty():
                break
        else:
            raise RuntimeError("chains of links did not settle")
        state = session.stored(
            state.join(up.select(F.col("x").alias("root"), "to"), "root", "left")
            .select("node", F.coalesce("to", "root").alias("root")), "roots")
    raise RuntimeError("components did not settle")
