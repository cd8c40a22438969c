"""Chunks of a table's rows, the unit in which operators ask for and get values.

A chunk is a run of rows within one input partition. Its distinct keys are sent out
once, whatever the number of rows that hold them, and the answers come back to the
chunk; so a word or pair that a third of all rows hold is as many rows as there are
chunks. A chunk must have the same rows when it is read again: read the input from
files or a work table. Chunks carry a digest of their keys, and one that has changed
ends the job rather than mix up answers.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a chunk, about; one longer text is a chunk of its own.
CHUNK = 8_000_000


def chunks(batches: Iterator[pa.RecordBatch], text: int, size: int = CHUNK) -> Iterator[tuple[int, list[pa.Array]]]:
    """``(chunk, columns)`` for the rows of a partition.

    ``text`` is the column whose bytes count. The last column is ``spark_partition_id()``,
    the input's own, whatever stage the task belongs to.
    """
    held: list[pa.RecordBatch] = []
    weight, number = 0, 0

    def made() -> tuple[int, list[pa.Array]]:
        return (held[0].column(held[0].num_columns - 1)[0].as_py() << 24) + number, [pa.concat_arrays([b.column(i) for b in held]) for i in range(held[0].num_columns)]

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) + weight) // size
        edges = np.flatnonzero(np.diff(part, prepend=0))
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            if a and held:
                yield made()
                held, number = [], number + 1
            if b > a:
                held.append(batch.slice(a, b - a))
        weight = (weight + int(sizes.sum())) % size
    if held:
        yield made()


def one_thread() -> None:
    """A task has one core: keep libraries from starting threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
