"""Documents linked by the Jaccard similarity of their sets of five-word shingles.

Every text's set is sketched by MinHash in bands; bands and rows follow from the recall
asked for at the threshold. Texts with equal sets are one class, and classes take part
once, however many copies they have. Classes are shuffled on their band hashes; those
that meet in a bucket are joined to the bucket's least class only. All links lie within
the components of these meetings, so each component's classes are brought together with
their whole shingle sets and every pair is verified, in blocks: a large component is
parted into blocks, and each pair of blocks is a group of bounded size of its own. A
block pair returns each class's number of links and one link to its local component,
not the links themselves. The links of a class are summed, the local components joined.

``linked_documents`` returns a row per document: the least ``doc_id`` of its group (all
that links lead to), and its number of links to other documents, copies included.

Edge cases: words are parted by ASCII blanks and compared as they are. A text with one
to four words is one shingle. A text without words, null among them, has no set: it is
a group of its own with no links. Equal rows are copies of each other; a null ``doc_id``
is the least of a group only where all its ids are null. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablepact.llm.common import materialized, text_of
from tablepact.llm.components import components
from tablepact.llm.shingles import (
    WordHashes, band_hashes, bands_for, least_reached, linked, set_digest, shingle_sets,
)

THRESHOLD = 0.8
#: Probability of finding a pair right at the threshold; more similar ones are surer.
RECALL = 0.9999
#: A block has about so many classes, and so many shingles, at most.
BLOCK_CLASSES = 256
BLOCK_SHINGLES = 1_000_000
#: Bytes of text that are worked on at a time.
PIECE = 4_000_000


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about PIECE bytes."""
    sizes = np.array([len(x) for x in batch.column(column).to_pylist()], np.int64)
    part = np.cumsum(sizes) // PIECE
    edges = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(edges, [*edges[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def _signed(docs: DataFrame, key: str, text: str, threshold: float, recall: float) -> DataFrame:
    bands, rows = bands_for(threshold, recall)
    source = docs.select(F.col(key).alias("doc"), text_of(text).alias("t"))
    source = source.select("doc", F.xxhash64("t").alias("print"), F.col("t").cast("binary").alias("t"))
    schema = pa.schema([("doc", pa.int64()), ("print", pa.int64()), ("set", pa.binary()), ("n", pa.int32()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for whole in batches:
            for batch in _pieces(whole, 2):
                values, starts = shingle_sets(batch.column(2).to_pylist(), known)
                sizes = np.diff(starts)
                full = sizes > 0
                sketches = band_hashes(values, starts, bands, rows)
                offsets = np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)
                digests = [set_digest(values[a:b]) if b > a else None for a, b in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).cast(pa.int64()), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(sketches.reshape(-1))),
                ], schema=schema)

    return materialized(source.mapInArrow(sign, "doc bigint, print bigint, set binary, n int, bands array<bigint>"), "jaccard-signed")


def _classes(signed: DataFrame) -> DataFrame:
    """One row per distinct set, with a number; ``first`` is the row that stands for it."""
    grouped = signed.where("set is not null").groupBy("set").agg(
        F.min(F.struct(F.col("doc").isNull().alias("late"), "doc", "print")).alias("first"),
        F.count(F.lit(1)).alias("copies"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    return materialized(grouped.withColumn("class", F.monotonically_increasing_id()), "jaccard-classes")


def _meetings(classes: DataFrame) -> DataFrame:
    buckets = classes.select("class", F.explode("bands").alias("bucket"))
    least = buckets.groupBy("bucket").agg(F.min("class").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return buckets.join(least, "bucket").where("class != hub").select(F.col("class").alias("a"), F.col("hub").alias("b")).distinct()


def _verified(docs: DataFrame, classes: DataFrame, met: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """``(class, links, hub)`` from each pair of blocks: partial link counts and local components."""
    met = materialized(met, "jaccard-met")
    member = classes.join(met, classes["class"] == met["node"]).select("root", "class", "copies", "n", "first")
    blocks = member.groupBy("root").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    wanted = materialized(member.join(blocks, "root").select(
        "root", "class", "copies", "blocks", F.col("first.doc").alias("doc"), F.col("first.print").alias("print"),
        F.pmod(F.xxhash64("class"), "blocks").cast("int").alias("block")), "jaccard-wanted")
    source = docs.select(F.col(key).alias("_doc"), text_of(text).alias("_t"))
    # A merge join at every size: whether the wanted rows could be broadcast must not change the plan.
    held = source.join(
        wanted.hint("merge"), source["_doc"].eqNullSafe(wanted["doc"]) & (F.xxhash64(source["_t"]) == wanted["print"]))
    held = held.select("root", "class", "copies", "blocks", "block", F.col("_t").cast("binary").alias("t"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for whole in batches:
            for batch in _pieces(whole, 5):
                values, starts = shingle_sets(batch.column(5).to_pylist(), known)
                sets = [values[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sets, pa.binary())], names=[*batch.schema.names[:5], "set"])

    sets = held.mapInArrow(gather, "root bigint, class bigint, copies bigint, blocks int, block int, set binary")
    paired = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        (F.col("block") > F.col("other")).alias("side"), "class", "copies", "set")
    dealt = paired.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[int, tuple] = {}
        at, rows = None, []

        def settle() -> None:
            if len(group) < 2:
                return
            names = list(group)
            side, copies, sets = (np.array([g[0] for g in group.values()]), np.array([g[1] for g in group.values()]),
                                  [np.frombuffer(g[2], np.uint64) for g in group.values()])
            if at[1] != at[2] and (side.all() or not side.any()):
                return
            found = linked(sets, side if at[1] != at[2] else np.zeros(len(side), bool), threshold)
            if found.any():
                hub, links = least_reached(found), found @ copies
                rows.extend((names[i], int(links[i]), names[hub[i]]) for i in np.flatnonzero(links))

        def out() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))],
                                              names=["class", "links", "hub"])
            rows.clear()
            return done

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:6]]
            for i, (root, low, high, side, name, copies) in enumerate(zip(*columns)):
                if (root, low, high) != at:
                    settle()
                    group, at = {}, (root, low, high)
                group[name] = (side, copies, batch.column(6)[i].as_py())
            yield out()
        settle()
        yield out()

    return materialized(dealt.mapInArrow(verify, "class bigint, links bigint, hub bigint"), "jaccard-links")


def linked_rows(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """A row per document: ``doc, print`` (id and text hash), ``group`` (the group's first ``(late, doc, print)``,
    null for texts without words), ``links``, ``copies``."""
    signed = _signed(docs, key, text, threshold, recall)
    classes = _classes(signed)
    met = components(_meetings(classes))
    links = _verified(docs, classes, met, key, text, threshold)
    roots = components(links.select(F.col("class").alias("a"), F.col("hub").alias("b")))
    counts = links.groupBy("class").agg(F.sum("links").alias("links"))
    rooted = classes.select("class", "set", "first", "copies").join(roots.withColumnRenamed("node", "class"), "class", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "class"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("group"))
    told = rooted.join(firsts, "root").join(counts, "class", "left").select(
        "set", "group", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    told = materialized(told, "jaccard-told")
    return signed.select("doc", "print", "set").join(told, "set", "left").select(
        "doc", "print", "group", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"),
        F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))


def linked_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                     threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    rows = linked_rows(docs, key=key, text=text, threshold=threshold, recall=recall)
    return rows.select(
        F.col("doc").alias(key), F.when(F.col("group").isNull(), F.col("doc")).otherwise(F.col("group.doc")).alias("class_id"),
        F.col("links").alias("n_links"), F.col("copies").alias("n_copies"))


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The documents without all but the first of each group; all columns as they are."""
    rows = linked_rows(docs, key=key, text=text, threshold=threshold, recall=recall)
    first = F.col("group").isNull() | (F.col("group.doc").eqNullSafe(F.col("doc")) & (F.col("group.print") == F.col("print")))
    kept = materialized(rows.where(first).groupBy("doc", "print").agg(
        F.count(F.lit(1)).alias("times"), F.max(F.col("group").isNotNull()).alias("worded")), "jaccard-kept")
    own = docs[key].eqNullSafe(kept["doc"]) & (F.xxhash64(text_of(text)) == kept["print"])
    if kept.where("times > 1 and worded").isEmpty():
        return docs.join(kept, own, "left_semi")
    single = docs.join(kept.where("times = 1 or not worded"), own, "left_semi")
    return single.unionByName(docs.join(kept.where("times > 1 and worded"), own, "left_semi").dropDuplicates([key, text]))
