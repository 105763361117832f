"""Connected components by alternating large-star and small-star rounds.

Every round replaces the edges of a node by edges to the least node it sees, so
chains shorten by half; a round writes its edges to the checkpoint folder. Least
neighbours are aggregates (combined before the shuffle) joined back to the
edges, so no list of neighbours is ever gathered. The edges of a node are dealt
over SALTS keys, so those of a hub never meet in one task. A round runs in as many
tasks as its edges need: each task leaves files for each of its shuffles, and rounds over few edges would
leave more disk in files than in rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROUNDS = 60
SALTS = 64
#: Edges of a task, and the fewest tasks of a round.
TASK_EDGES = 100_000
TASKS = 8


def _tasks(edges: int) -> int:
    return max(TASKS, math.ceil(edges / TASK_EDGES))


def with_least(edges: DataFrame, key: str, value: str, tasks: int | None = None) -> DataFrame:
    """Adds ``m``, the least ``value`` of all rows of the same ``key``, however many they are; in at most so many tasks."""
    few = lambda df: df.coalesce(tasks) if tasks else df
    salted = edges.withColumn("s", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))
    parts = few(salted.groupBy(key, "s").agg(F.min(value).alias("m")))
    whole = few(parts.groupBy(key).agg(F.min("m").alias("m")))
    return few(salted.join(few(parts.select(key, "s").join(whole, key)), [key, "s"]).drop("s"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for each node that has an edge (a, b)."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    e, state = _settled(e)
    for _ in range(ROUNDS):
        if not state[0]:
            break
        tasks = _tasks(state[0])
        e = e.coalesce(tasks)
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = with_least(both, "v", "u", tasks).where("u > v").select(F.col("u").alias("v"), F.least("v", "m").alias("u")).distinct().coalesce(tasks)
        small = with_least(large, "v", "u", tasks)
        small = small.select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u")).distinct().coalesce(tasks)
        e, after = _settled(small)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def _settled(e: DataFrame) -> tuple[DataFrame, tuple]:
    e = common.checkpoint(e)
    return e, tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u")), F.sum(F.col("u").cast("decimal(38,0)"))).first())
