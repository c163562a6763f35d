"""Connected components of a links table by min-label hooking and pointer jumping, all of it in DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strandline.llm.shared import written


def _counted(df: DataFrame, what: Column, folder: str, name: str) -> tuple[DataFrame, int]:
    """df as a table in the shared folder and how many of its rows are `what`, counted as it is written."""
    seen = Observation()
    table = written(df.observe(seen, F.count_if(what).alias("n")), folder, name)
    return table, seen.get["n"]


def components(links: DataFrame, folder: str, name: str = "components") -> DataFrame:
    """node, component (the smallest node reachable) of every node in links (a, b); nodes in no link are not there.

    Each round takes every node's smallest label among its neighbours and then that label's own label; minima are combined
    before the shuffle, so a node with many links isn't gathered anywhere. Rounds end when no label changes; the labels of each
    round are a table in the shared folder.
    """
    both, found = _counted(links.select(F.col("a"), F.col("b")).union(links.select("b", "a")).where("a <> b").distinct(), F.lit(True), folder, f"{name}-links")
    if not found:
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), folder, f"{name}-0")
    for k in range(1, 100):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = hooked.join(jump, "label", "left").select("node", "old", F.coalesce(F.least("label", "further"), "label").alias("label"))
        table, moved = _counted(jumped, F.col("old") != F.col("label"), folder, f"{name}-{k}")
        labels = table.select("node", "label")
        if not moved:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("labels did not settle")


def grown_components(labels: DataFrame | None, links: DataFrame, folder: str, name: str) -> DataFrame:
    """node, component after `links` (a, b) are added to the components in `labels` (null: none yet).

    Links are put between components first, so that those within one fall away and only components that meet are labelled anew.
    """
    if labels is None:
        return components(links, folder, name)
    for side in ("a", "b"):
        own = labels.select(F.col("node").alias(side), F.col("component").alias("_component"))
        links = links.join(own, side, "left").withColumn(side, F.coalesce("_component", side)).drop("_component")
    fresh = components(links.select("a", "b"), folder, name)
    moved = labels.join(fresh.select(F.col("node").alias("component"), F.col("component").alias("further")), "component", "left")
    added = fresh.join(labels.select("node"), "node", "left_anti").select("node", "component")
    return written(moved.select("node", F.coalesce("further", "component").alias("component")).union(added), folder, f"{name}-grown")
