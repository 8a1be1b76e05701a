"""Connected components of links, distributed.

Each partition first contracts its own links to stars. Then large-star and
small-star rounds alternate: every node passes its larger, then its smaller
neighbours to the smallest node it sees, until all links of a component point
to its smallest node. Rounds grow with the logarithm of a component's size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinegrain.llm import scratch
from kinegrain.llm import textkernel as tk

#: Links up to which one task finishes alone; they are counted first.
ONE_TASK_LINKS = 2_000_000


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component) of an edge list."""
    nodes, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        # The roots of both ends take the smaller label, then paths are halved.
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, root = local_components(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    keep = nodes != root
    nodes, root = nodes[keep], root[keep]
    for k in range(0, len(nodes), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[k: k + 10_000]), pa.array(root[k: k + 10_000])], names=["node", "root"])
    tk.trim()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of (u, v) bigint links that is not its component's smallest.

    Links are counted after the first contraction. A few are finished in one
    task, which holds no more than the count says; any number goes through the
    distributed rounds.
    """
    links = scratch.keep(edges.where("u <> v").mapInArrow(_stars, "node bigint, root bigint").distinct().toDF("u", "v"), "links")
    if links.count() <= ONE_TASK_LINKS:
        return scratch.keep(links.coalesce(1).mapInArrow(_stars, "node bigint, root bigint"), "components")
    mark = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        links = scratch.keep(small.where("u <> v").distinct(), "links")
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark or not now[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
