"""Conversations in reply order, their quotations linked and taken out.

A line's quote level is the number of ``>`` before its text. Lines of level 0 are the
message's own words. Quoted blocks and own words are cut into passages: paragraphs,
lines, and sentences over the lines of a paragraph, so a quotation is found however it
was wrapped; own words before and after a quotation are apart. Passages are compared by
a hash of their lower-case letters and digits. The original of a passage is the first
message of the conversation that says it in own words; a quotation refers to it if it
is later. A message replies to the latest original among its quotations of the
shallowest level that has one: deeper levels are what the quoted message quoted itself.
Lines that announce a quotation ("... wrote:" before a quoted line) go with it.

Messages without a resolved quotation open a thread of their own. Threads stand in
the order of their first message, messages in a thread by turn; so every reply comes
after what it answers. ``position`` counts from 0 in this order.

No conversation is gathered anywhere: originals are found by aggregation, threads by
following links in doubling steps, positions by a range sort, whose partitions a long
conversation may fill, and the counts of each conversation in the earlier partitions.

Edge cases: a null text is empty. Passages of fewer than ``SHORTEST`` characters link
only where they are a whole message and a whole quoted block. A message with a null
conversation or turn links nothing and is a thread of its own. Messages with equal conversation and turn count as one for links, and each
keeps its row; so do equal rows. Quotations of nobody are taken out as well, and
counted. Other columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablepact.llm.common import materialized, text_of

SHORTEST = 8
#: Rows that a task parses at a time.
ROWS = 1000
_QUOTE = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
_WROTE = re.compile(r"(?:wrote|writes|schrieb|écrit|escribió)\s*:\s*$")
_PLAIN = re.compile(r"[\W_]+")


def levels(text: str) -> list[tuple[int, str]]:
    """Each line's quote level and what it says."""
    found = []
    for line in text.split("\n"):
        marks = _QUOTE.match(line)
        found.append((marks[1].count(">"), line[marks.end():]) if marks else (0, line))
    return found


def parted(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotations, and the quoted blocks with their levels."""
    kept, _, blocks = parted_apart(text)
    return kept, blocks


def parted_apart(text: str) -> tuple[str, list[str], list[tuple[int, str]]]:
    """As ``parted``, and the own words between quotations."""
    own: list[str] = []
    breaks: list[int] = []
    blocks: list[tuple[int, list[str]]] = []
    before = 0
    for level, line in levels(text):
        if level:
            if level != before:
                blocks.append((level, []))
                while not before and own and (not own[-1].strip() or _WROTE.search(own[-1])):
                    if own.pop().strip():
                        break
                if not before:
                    breaks.append(len(own))
            blocks[-1][1].append(line)
        else:
            own.append(line)
        before = level
    kept = "\n".join(own).strip("\n") if blocks else text
    parts = ["\n".join(own[a:b]) for a, b in zip([0, *breaks], [*breaks, len(own)])]
    return kept, parts, [(level, "\n".join(lines)) for level, lines in blocks]


def passage_hashes(text: str) -> list[int]:
    """Hashes of a text's paragraphs, lines and sentences, and of a whole text that is short."""
    found = {}
    for paragraph in _PARAGRAPH.split(text):
        lines = [x for x in paragraph.split("\n") if x.strip()]
        for passage in (" ".join(lines), *lines, *_SENTENCE.split(" ".join(paragraph.split())),
                        *(x for line in lines for x in _SENTENCE.split(line.strip()))):
            plain = _PLAIN.sub("", passage).lower()
            if len(plain) >= SHORTEST:
                found[_hash(plain)] = None
    whole = _PLAIN.sub("", text).lower()
    if 0 < len(whole) < SHORTEST:
        found[_hash(whole)] = None
    return list(found)


def said_hashes(parts: list[str]) -> list[int]:
    """Hashes of own words; those between quotations are short only if nothing else is said."""
    spoken = [p for p in parts if p.strip()]
    found = dict.fromkeys(h for p in spoken for h in passage_hashes(p))
    if len(spoken) > 1:
        for p in spoken:
            whole = _PLAIN.sub("", p).lower()
            if 0 < len(whole) < SHORTEST:
                found.pop(_hash(whole), None)
    return list(found)


def _hash(plain: str) -> int:
    return xxhash.xxh3_64_intdigest(plain.encode("utf-8", "replace")) - 2**63


def _parsed(messages: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    schema = pa.schema([("conv", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("own", pa.string()), ("n_quotes", pa.int64()),
                        ("said", pa.list_(pa.int64())), ("quoted", pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64())])))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                own, n, said, quoted = [], [], [], []
                for value in batch.column(3).to_pylist():
                    kept, parts, blocks = parted_apart(value)
                    own.append(kept)
                    n.append(len(blocks))
                    said.append(said_hashes(parts))
                    quoted.append([{"level": level, "hash": h} for level, block in blocks for h in passage_hashes(block)])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).cast(schema.types[i]) for i in range(3)), *(pa.array(v, t) for v, t in zip((own, n, said, quoted), schema.types[3:]))],
                    schema=schema)

    source = messages.select(F.col(conversation).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"),
                             F.col(role).alias("role"), text_of(text).alias("t"))
    return materialized(source.mapInArrow(
        parse, "conv bigint, turn bigint, role string, own string, n_quotes bigint, said array<bigint>, quoted array<struct<level:int,hash:bigint>>"),
        "quotes-parsed")


def reply_links(parsed: DataFrame) -> DataFrame:
    """``conv, turn, parent, linked``: the turn replied to, and how many quoted passages are linked."""
    asked = parsed.select("conv", "turn", F.inline("quoted")).where("conv is not null and turn is not null").distinct()
    said = parsed.select("conv", "turn", F.explode("said").alias("hash"))
    # Only what is quoted at all needs an original.
    said = said.join(asked.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi")
    originals = said.groupBy("conv", "hash").agg(F.min("turn").alias("original"))
    linked = asked.join(originals, ["conv", "hash"]).where("original < turn")
    by_level = linked.groupBy("conv", "turn", "level").agg(F.max("original").alias("parent"), F.count_distinct("hash").alias("linked"))
    return materialized(by_level.groupBy("conv", "turn").agg(
        F.min_by("parent", "level").alias("parent"), F.sum("linked").alias("linked")), "quotes-links")


def thread_roots(links: DataFrame) -> DataFrame:
    """``conv, turn, root, depth``, by following parents twice as far in each round."""
    reach = links.select("conv", "turn", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("depth"))
    while True:
        reach = materialized(reach, "quotes-reach")
        next_up = reach.select("conv", F.col("turn").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        step = reach.join(next_up, ["conv", "up"], "left")
        if step.where("further is not null").isEmpty():
            return reach.withColumnRenamed("up", "root")
        reach = step.select("conv", "turn", F.coalesce("further", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))


def conversations_in_reply_order(messages: DataFrame, *, conversation: str = "conv_id", turn: str = "turn",
                                 role: str = "role", text: str = "text") -> DataFrame:
    """A row per message: ``conv, turn, role, text, parent, thread, depth, position, n_quotes, n_linked``."""
    parsed = _parsed(messages, conversation, turn, role, text)
    links = reply_links(parsed)
    roots = thread_roots(links)
    told = links.join(roots, ["conv", "turn"])
    rows = parsed.select("conv", "turn", "role", "own", "n_quotes").join(told, ["conv", "turn"], "left").select(
        "conv", "turn", "role", F.col("own").alias("text"), "parent", F.coalesce("root", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"), "n_quotes", F.coalesce("linked", F.lit(0)).cast("bigint").alias("n_linked"))
    order = ["conv", "thread", "turn", "role", "text"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialized(ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "quotes-ordered")
    # A conversation that spans partitions: each of its parts starts where those before it end.
    parts = placed.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select(
        F.col("conv").alias("c"), F.col("part").alias("p"), "first", "start")
    joined = placed.join(starts, placed["conv"].eqNullSafe(starts["c"]) & (placed["part"] == starts["p"]))
    return joined.select("conv", "turn", "role", "text", "parent", "thread", "depth",
                         (F.col("start") + F.col("at") - F.col("first")).alias("position"), "n_quotes", "n_linked")
