"""Placement by a lookup table that the shards fill in turns.

Each shard has a preference order over the slots of a table of prime size: a start and
a step, both hashed from its name. The shards take turns; each claims its next slot
that is still free, until all are taken. So every shard holds as many slots as any
other, give or take one, and when a shard comes or goes few other slots change hands. A
row's slot is the hash of its key modulo the table's size; the table has a fixed,
stated number of rows, is broadcast, and placement takes one look and no shuffle. Writing
the shards moves each row once, to a task of its shard.

Edge cases: rows with equal keys, null among them, go to one shard; an empty table
stays empty; all columns of the input are kept, and the added ones get free names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.llm.common import free_name

#: A prime; about 250 slots for each of 256 shards keep loads within one percent.
TABLE_SIZE = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> np.ndarray:
    """For each slot the index of its shard."""
    if not is_prime(size) or size < len(shards) or not shards or len(set(shards)) < len(shards):
        raise ValueError("a prime size, at least the number of shards, and distinct names are needed")
    starts = [xxhash.xxh64_intdigest(name, seed=1) % size for name in shards]
    steps = [xxhash.xxh64_intdigest(name, seed=2) % (size - 1) + 1 for name in shards]
    owner = np.full(size, -1, dtype=np.int32)
    taken = 0
    while True:
        for shard, step in enumerate(steps):
            slot = starts[shard]
            while owner[slot] >= 0:
                slot = (slot + step) % size
            owner[slot] = shard
            starts[shard] = (slot + step) % size
            taken += 1
            if taken == size:
                return owner


def placed(frame: DataFrame, key: str, shards: Sequence[str], *, size: int = TABLE_SIZE,
           slot: str = "slot", shard: str = "shard") -> DataFrame:
    """The frame with each row's slot and shard."""
    slot, shard = free_name(frame, slot), free_name(frame, shard)
    owner = lookup_table(shards, size)
    rows = pd.DataFrame({slot: np.arange(size, dtype=np.int64), shard: [shards[i] for i in owner]})
    table = frame.sparkSession.createDataFrame(rows)
    hashed = frame.withColumn(slot, F.pmod(F.xxhash64(key), F.lit(size)))
    return hashed.join(F.broadcast(table), slot).select(*frame.columns, slot, shard)


def write_shards(frame: DataFrame, path: str, shard: str = "shard") -> None:
    """The rows as they are, one folder per shard; large shards are written by several tasks."""
    frame.hint("rebalance", F.col(shard)).write.partitionBy(shard).parquet(path)


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all shards; ``schema`` is that of the frame that was written."""
    return spark.read.schema(schema).parquet(path)
