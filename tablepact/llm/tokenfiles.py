"""Files of token ids: frequency ranks in byte-aligned variable-length coding.

Ids are replaced by their rank of frequency, so common ids are small numbers. A number
takes one to four bytes; its length less one is two bits of a control byte, which holds
four numbers' lengths. Control bytes and data bytes are apart, so a block is decoded
without a loop over its ids: a table of 256 rows gives the lengths, their running sum
the places, and the bytes are gathered.

A file is a Parquet file of blocks, in ascending key order over files and blocks:
``part, block, before`` (ids of the part's earlier blocks), ``n_ids``, ``keys``
and ``lengths`` of its rows, ``control`` and ``data`` bytes. Beside them lies the table
of ranks, which has the vocabulary's size. Keys are sorted by ranges, so no task has
the whole table; equal keys are split by their contents.

Edge cases: a null or empty text is the end id alone; a null key comes first; rows of
equal keys follow each other in the order of their ids' hash and bytes. An empty table gives no
blocks and reads back as no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.llm.bytecode import packed, unpacked
from tablepact.llm.chunks import chunks
from tablepact.llm.common import materialized, text_of
from tablepact.llm.tokens import BATCH, REMEMBERED, Numbered, gathered, loaded, word_ids

#: Ids in a block, about; a longer row is a block of its own.
BLOCK = 1_000_000
#: Bytes of text that a task encodes at a time, about; a longer text is encoded alone.
ENCODED = 4_000_000


class WordIds:
    """Ids of whole texts; the ids of words seen before are remembered while there is room.

    The end of a text is a word of its own, which no text holds.
    """

    END = b" "

    def __init__(self, tokenizer_json: str, end: int) -> None:
        self.tokenizer, self.end = loaded(tokenizer_json), end
        self.kind = id_type(max(end, self.tokenizer.get_vocab_size(with_added_tokens=True) - 1))
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbered({self.END: 0})
        self.flat, self.starts = np.array([self.end], self.kind), np.array([0, 1])

    def learn(self, words: list[bytes]) -> None:
        found = [word_ids(self.tokenizer, words[a:a + BATCH]) for a in range(0, len(words), BATCH)]
        self.flat = np.concatenate([self.flat, *[ids.astype(self.kind) for ids, _ in found]])
        ends = np.concatenate([n for _, n in found]).cumsum() + self.starts[-1]
        self.starts = np.concatenate([self.starts, ends])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each with its end, and where each text's begin."""
        if len(self.numbers) > REMEMBERED:
            self.clear()
        known = len(self.numbers)
        split = [t.split() for t in texts]
        for words in split:
            words.append(self.END)
        last = np.cumsum([len(words) for words in split])
        places = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), np.int64, last[-1])
        if len(self.numbers) > known:
            self.learn(list(islice(self.numbers, known, None)))
        ends = np.cumsum(self.starts[places + 1] - self.starts[places])[last - 1]
        return gathered(self.flat, self.starts, places), np.concatenate([[0], ends])


def id_type(largest: int) -> np.dtype:
    """The narrowest type in which work tables hold ids."""
    return np.dtype("<u2" if largest < 1 << 16 else "<u4")


@lru_cache(maxsize=1)
def worker_words(tokenizer_json: str, end: int) -> WordIds:
    """The words of this Python worker, which later tasks on it use again."""
    return WordIds(tokenizer_json, end)


def _encoded(docs: DataFrame, tokenizer_json: str, key: str, text: str, end: int) -> DataFrame:
    """``key, ids, width``: ids of so many bytes each.

    A last row of each task, of width 0, has in ``ids`` how often the task met each id.
    """
    told = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a file of fixed size
    source = docs.select(F.col(key).alias("key"), text_of(text).cast("binary").alias("t"), F.spark_partition_id().alias("part"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words(told.value, end)
        width = words.kind.itemsize
        met = np.zeros(0, np.int64)
        for _, (keys, texts, _) in chunks(batches, 1, ENCODED):
            ids, edges = words.encode(texts.to_pylist())
            found = np.bincount(ids, minlength=len(met))
            found[:len(met)] += met
            met = found
            held = ids.tobytes()
            at = (edges * width).tolist()
            yield pa.RecordBatch.from_arrays(
                [keys.cast(pa.int64()), pa.array([held[a:b] for a, b in zip(at, at[1:])], pa.binary()),
                 pa.array([width] * len(keys), pa.int32())], names=["key", "ids", "width"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([met.tobytes()], pa.binary()), pa.array([0], pa.int32())],
                                         names=["key", "ids", "width"])

    return materialized(source.mapInArrow(encode, "key bigint, ids binary, width int"), "token-ids")


def _ranks(encoded: DataFrame) -> DataFrame:
    """``id, rank``, most frequent first, of equal counts the smaller id."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for met in batch.column(0).to_pylist():
                found = np.frombuffer(met, np.int64)
                if len(found) > len(total):
                    total = np.pad(total, (0, len(found) - len(total)))
                total[:len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    counts = encoded.where("width = 0").select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counts.toPandas().sort_values(["n", "id"], ascending=[False, True])  # a vocabulary at most
    rows["rank"] = np.arange(len(rows))
    return encoded.sparkSession.createDataFrame(rows[["id", "rank"]], "id bigint, rank bigint")


def _known(ranks: DataFrame, by: str, to: str) -> np.ndarray:
    rows = ranks.toPandas()
    table = np.zeros(int(rows[by].max()) + 1 if len(rows) else 0, id_type(int(rows[to].max()) if len(rows) else 0))
    table[rows[by].to_numpy()] = rows[to].to_numpy()
    return table


def write_token_files(docs: DataFrame, path: str, tokenizer_json: str, *, key: str = "doc_id", text: str = "text",
                      end: int = 2, block: int = BLOCK) -> None:
    """Write ``path/ids`` and ``path/ranks``."""
    encoded = _encoded(docs, tokenizer_json, key, text, end)
    ranks = _ranks(encoded)
    ranks.coalesce(1).write.parquet(f"{path}/ranks")
    told = docs.sparkSession.sparkContext.broadcast(_known(ranks, "id", "rank"))
    ordered = encoded.where("width > 0").withColumn("print", F.xxhash64("ids"))
    ordered = ordered.repartitionByRange("key", "print").sortWithinPartitions("key", "print", "ids")
    ordered = ordered.select("key", "ids", "width", F.spark_partition_id().alias("part"))
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()),
                        ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int] = []
        ids: list[np.ndarray] = []
        size, number, before, part = 0, 0, 0, 0

        def made() -> pa.RecordBatch:
            control, data = packed(told.value[np.concatenate(ids)])
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
                (part, number, before, size, keys, [len(i) for i in ids], control, data), schema.types)], schema=schema)

        for batch in batches:
            for k, i, width, p in zip(*(c.to_pylist() for c in batch.columns)):
                keys.append(k)
                ids.append(np.frombuffer(i, f"<u{width}"))
                size, part = size + len(ids[-1]), p
                if size >= block:
                    yield made()
                    before, number = before + size, number + 1
                    keys, ids, size = [], [], 0
        if keys:
            yield made()

    made = ordered.mapInArrow(
        blocks, "part int, block bigint, before bigint, n_ids bigint, keys array<bigint>, lengths array<bigint>, control binary, data binary")
    made.write.option("compression", "none").parquet(f"{path}/ids")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``key, start, ids``: ids as little-endian unsigned 32-bit integers, ``start`` the ids before the row."""
    files = spark.read.parquet(f"{path}/ids")
    told = spark.sparkContext.broadcast(_known(spark.read.parquet(f"{path}/ranks"), "rank", "id"))
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n")).toPandas().sort_values("part")  # a row per written partition
    first = dict(zip(sizes["part"].tolist(), (sizes["n"].cumsum() - sizes["n"]).tolist()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, before, n, keys, lengths, control, data in zip(*(c.to_pylist() for c in batch.columns)):
                ids = told.value[unpacked(control, data, n)].astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.int64()), pa.array(starts + first[part] + before, pa.int64()),
                    pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], names=["key", "start", "ids"])

    ordered = files.select("part", "block", "before", "n_ids", "keys", "lengths", "control", "data")
    return ordered.mapInArrow(rows, "key bigint, start bigint, ids binary")
