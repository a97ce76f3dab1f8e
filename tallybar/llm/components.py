"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def connected_components(edges: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """(node, component) for every node on an edge; the component is its smallest node.

    edges: columns u and v. The result is a table below ``name`` in the workspace. Each round hooks every node to its smallest neighbour, follows hooks once more,
    and contracts the edges; the smallest node of a component is never hooked. Tables shrink round by
    round, and each round's go when the next has its own. Minima are combined before the shuffle and the joins' sides are plain exchanges, so that a node
    with very many edges is split by adaptive execution.
    """
    at = lambda table, step: f"{name}/{table}-{step}"
    edge = ws.save(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), at("edges", 0))
    label = None
    for step in range(1, 200):
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = ws.save(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), at("hook", step))
        up = hook.select(F.col("u").alias("p"), F.col("p").alias("q"))
        hook = ws.save(hook.join(up, "p").select("u", F.col("q").alias("p")), at("jump", step))
        if label is None:
            label = hook.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            moved = hook.select(F.col("u").alias("component"), "p")
            label = label.join(moved, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        label = ws.save(label, at("label", step))
        a = hook.select("u", F.col("p").alias("pu"))
        b = hook.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        rest = edge.join(a, "u").join(b, "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        edge = ws.save(rest, at("edges", step))
        ws.drop(at("hook", step), at("jump", step), at("label", step - 1), at("edges", step - 1))
        if edge.isEmpty():
            return label
    raise RuntimeError("the components did not settle")
