"""Connected components of a link table: tasks contract links first, each those that it reads; what several tasks have left is
joined by alternating large-star and small-star steps on DataFrames.

Links that one task can hold need no step. A step is ten stages, and of small links, which are most, that is more work for
the driver (plans, tasks, broadcasts) than for the executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, store

MOST_ROUNDS = 64
#: Links that a task contracts at a time. They are held in arrays: about 50 MB.
TASK_LINKS = 1 << 19


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that links join to a smaller one, and the smallest that they join it to."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))  # of each node a root, which is its own
    while True:
        a, b = label[a], label[b]
        apart = a != b
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up
    joined = label < np.arange(len(ids))
    return ids[joined], ids[label[joined]]


def contracted(links: DataFrame, rows: int) -> DataFrame:
    """links: u, v, stored, so many rows. Links that join the same nodes, with each u above its v, as a stored table: of TASK_LINKS
    rows or fewer, the components themselves. links is discarded."""
    most = TASK_LINKS

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, most):
                part = batch.slice(first, most)
                held, n = [*held, part], n + part.num_rows
                if n >= most:
                    yield shrunk(held)
                    held, n = [], 0
        if held:
            yield shrunk(held)

    def shrunk(held):
        u, v = forest(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("u", "v")))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    out = store(links.coalesce(-(-rows // TASK_LINKS)).mapInArrow(run, "u long, v long"))
    discard(links)
    return out


def _pairs(links: DataFrame, *ends: tuple[Column, Column]) -> DataFrame:
    """u, v for each link and each of ends, but not u, u."""
    each = F.explode(F.array(*[F.struct(u.alias("u"), v.alias("v")) for u, v in ends]))
    return links.select(each.alias("link")).select("link.u", "link.v").where("u <> v")


def _to_minimum(links: DataFrame) -> DataFrame:
    """links with m, the smallest node among u and all its v. A hub's links are many rows that meet one: a join that Spark splits."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return links.join(least, "u")


def _settled(links: DataFrame) -> bool:
    """Whether each u has one v, which is no u itself."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("root")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("root")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("root").alias("root")).where("out > 1 OR (out = 1 AND root = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links: u, v (long ids, any direction, repeats allowed). Returns node, component: its smallest reachable node.

    The smallest node of a component, and nodes without a link to another node, do not appear. No links: an empty result.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    now = store(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    for k in range(MOST_ROUNDS):
        rows = now.count()
        if rows and (not k or rows <= TASK_LINKS):
            now = contracted(now, rows)
        if rows <= TASK_LINKS or _settled(now):
            out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out.stored_in = now.stored_in
            return out
        large = _to_minimum(_pairs(now, (u, v), (v, u))).where("v > u").select(v.alias("u"), m.alias("v"))
        small = _pairs(_to_minimum(large), (u, m), (v, m)).distinct()
        before, now = now, store(small)
        discard(before)
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
