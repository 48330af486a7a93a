"""Connected components: in one task where the links are few, else by label propagation with hooking and pointer jumping, all in tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm import textbuf
from cartulary.llm.workspace import Workspace

#: Links, of 16 bytes each, that one task connects at most; beyond, rounds of joins do.
LINKS = 1_000_000


def labelled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, and the smallest node that each of them reaches."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = back[: len(a)], back[len(a) :], np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
        # Links between trees go on as links between their roots.
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[label]


def _in_one_task(edges: DataFrame) -> DataFrame:
    @textbuf.frugal
    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if held:
            nodes, label = labelled(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(label)], ["node", "label"])

    return edges.select("a", "b").coalesce(1).mapInArrow(connect, "node long, label long")


def components(work: Workspace, links: DataFrame, name: str) -> DataFrame:
    """node, label of every node in links (a, b); label is the smallest node that can be reached.

    A hub of any degree is safe: neighbours meet in partial aggregates, and joins
    on a hub are sort-merge joins whose large partitions can be split.  Each round
    is a table of its own, so a lost executor costs at most one round.
    """
    given = work.table(f"{name}-links", links.select("a", "b").distinct())
    if given.count() <= LINKS:
        return work.table(name, _in_one_task(given))
    edges = work.table(f"{name}-edges", given.union(given.select("b", "a")).distinct())
    labels = work.table(f"{name}-0", edges.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")))
    turn = 0
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        # What any node of a label has met goes to the node that gave the label, so whole trees move at once.
        hooks = step.where("to < was").groupBy(F.col("was").alias("node")).agg(F.min("to").alias("hook"))
        hooked = step.join(hooks, "node", "left").select("node", F.least("to", "hook").alias("to"), "was")
        jump = hooked.select(F.col("node").alias("to"), F.col("to").alias("far"))
        moved = hooked.join(jump, "to").select("node", F.col("far").alias("label"), (F.col("far") != F.col("was")).alias("moved"))
        turn += 1
        after = work.table(f"{name}-{turn}", moved)
        still = after.where("moved").limit(1).count()
        work.drop(f"{name}-{turn - 1}")
        labels = after.select("node", "label")
        if not still:
            work.drop(f"{name}-edges", f"{name}-links")
            return labels
