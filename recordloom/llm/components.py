"""Connected components of a distributed edge list."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

EDGES = "a long, b long"


def forest(pairs: np.ndarray) -> np.ndarray:
    """A spanning forest of ``pairs`` (n x 2) as (node, smallest node) stars."""
    nodes, flat = np.unique(pairs.ravel(), return_inverse=True)
    a, b = flat[0::2].copy(), flat[1::2].copy()
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return np.stack([nodes[keep], nodes[label[keep]]], axis=1)


def _contract(batches):
    """Replace the edges of each batch run by a spanning forest of stars."""
    held: list[np.ndarray] = []
    n = 0

    def flush():
        out = forest(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1))
            n += batch.num_rows
            if n >= 1_000_000:
                yield flush()
                held, n = [], 0
    if held:
        yield flush()


def connected(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b long), root the smallest node.

    Large-star and small-star steps in turn until nothing changes; each is an
    aggregation and an equi-join, so a hub's edges are split, never gathered.
    The minima are staged by themselves: a join of two shuffled tables is what
    Spark can split at a hub. Every round is staged in the shared folder. No edges: an empty table.
    Loops, repeated edges and nulls are ignored.
    """
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    e = staged(e.mapInArrow(_contract, EDGES), f"{name}-0")
    before = None
    for k in range(1, rounds):
        # large star: every larger neighbour of a node hangs on the node's minimum
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-{k}-low")
        big = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        big = staged(big.distinct(), f"{name}-{k}-large")
        # small star: every smaller neighbour, and the node, hang on the minimum
        low = staged(big.groupBy("a").agg(F.min("b").alias("m")), f"{name}-{k}-least")
        small = big.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = staged(small.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), f"{name}-{k}")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
