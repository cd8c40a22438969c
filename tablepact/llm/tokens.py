"""Token ids of whole texts, with a public tokenizer's file.

``encoded_by_words`` keeps a table of distinct words: texts are split in Spark, every
distinct word is encoded once, and its ids come back by position. For that each chunk
of rows sends its distinct words, parted by ranges of their hashes, and gets back their
ids; equal words of all chunks meet in a range and are encoded once. The number of
ranges follows from the bytes of all texts, so a range has bounded size.
Ids are decoded through a table from id to piece, which has the vocabulary's size.

Splitting at ASCII blanks is exact for a tokenizer whose normalizer and pre-tokenizer
never join what a blank parts, as the word tokenizer's; ``parts_at_blanks`` tests it.

Edge cases: a null or empty text has no ids and decodes to the empty text. Equal rows
are each encoded. A very long text is a chunk of its own. A null ``doc_id`` stays null.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablepact.llm.bytecode import packed, unpacked
from tablepact.llm.chunks import CHUNK, chunks, one_thread
from tablepact.llm.common import text_of

#: Bytes of text whose words, parted by their hashes, make up a range, about.
RANGE_TEXT = 8_000_000
# Kinds of rows that pass between chunks and ranges, in the order a chunk gets them.
ANSWERED, LAID, TEXT, ASKED = range(4)
#: Words a task encodes at a time, and words whose ids a task remembers.
BATCH = 20_000
REMEMBERED = 800_000
#: Words that make up one text for the tokenizer, and the mark between them.
TOGETHER = 20
MARK = b"\x01"


def parts_at_blanks(tokenizer_json: str, samples: list[str]) -> bool:
    """Whether the ids of the samples are the ids of their words in a row."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    return all(
        tokenizer.encode(s, add_special_tokens=False).ids
        == [i for w in s.encode().split() for i in tokenizer.encode(w.decode(), add_special_tokens=False).ids]
        for s in samples
    )


def loaded(tokenizer_json: str):
    one_thread()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def pieces_of(tokenizer_json: str) -> list[str | None]:
    """For each id its piece: the table that decoding joins."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_str(tokenizer_json).get_vocab(with_added_tokens=True)
    pieces: list[str | None] = [None] * (max(vocabulary.values()) + 1)
    for piece, number in vocabulary.items():
        pieces[number] = piece
    return pieces


def word_ids(tokenizer, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in a row, and the number of ids of each.

    Some words go through the tokenizer as one text, with a mark between them that has
    one id of its own; words that hold the mark themselves go one by one.
    """
    mark = tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
    if len(mark) == 1 and MARK not in b" ".join(words):
        between = b" " + MARK + b" "
        texts = [between.join(words[a:a + TOGETHER]).decode("utf-8", "replace") for a in range(0, len(words), TOGETHER)]
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        marked = np.fromiter((i for e in found for i in (*e.ids, mark[0])), np.uint32)
        ends = np.flatnonzero(marked == mark[0])
        if len(ends) == len(words):
            return marked[marked != mark[0]], np.diff(ends, prepend=-1) - 1
    single = [e.ids for e in tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
    return np.fromiter((i for ids in single for i in ids), np.uint32), np.fromiter(map(len, single), np.int64, len(single))


class Numbered(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number


def numbered_words(texts: list[bytes | None]) -> tuple[list[bytes], list[np.ndarray]]:
    """The distinct words, most frequent first, and each text as their numbers."""
    numbers = Numbered()
    places = [np.fromiter(map(numbers.__getitem__, (t or b"").split()), np.uint32) for t in texts]
    counts = np.bincount(np.concatenate(places), minlength=len(numbers)) if places else np.empty(0, np.int64)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    first = list(numbers)
    return [first[i] for i in order.tolist()], [rank[p] for p in places]


def by_range(words: list[bytes], bits: int) -> tuple[np.ndarray, list[tuple[int, list[bytes]]]]:
    """Each word's range of hashes, and the words of each range that has some, in their order."""
    ranges = (np.fromiter(map(zlib.crc32, words), np.uint32, len(words)).astype(np.uint64) << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
    order = np.argsort(ranges, kind="stable")
    edges = np.flatnonzero(np.diff(ranges[order].astype(np.int64), prepend=-1)).tolist()
    numbers = order.tolist()
    return ranges, [(int(ranges[numbers[a]]), [words[i] for i in numbers[a:b]]) for a, b in zip(edges, [*edges[1:], len(words)])]


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=8).digest()


def gathered(flat: np.ndarray, starts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The values of all places in a row, where ``flat[starts[p]:starts[p + 1]]`` are those of p."""
    lengths = starts[places + 1] - starts[places]
    shift = np.repeat(starts[places] - (np.cumsum(lengths) - lengths), lengths)
    return flat[np.arange(len(shift)) + shift]


def encoded_by_words(docs: DataFrame, tokenizer_json: str, *, key: str = "doc_id", text: str = "text",
                     chunk: int = 2 * CHUNK) -> DataFrame:
    """``doc, ids, decoded``: ids as little-endian unsigned 32-bit integers in a row."""
    source = docs.select(F.col(key).alias("doc"), text_of(text).cast("binary").alias("t"), F.spark_partition_id().alias("part"))
    told = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a file of fixed size
    size = docs.agg(F.sum(F.octet_length(text_of(text)))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / RANGE_TEXT))))
    names = ["chunk", "kind", "place", "value", "extra", "doc"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
    columns = "chunk bigint, kind int, place int, value binary, extra binary, doc bigint"

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        parts = list(zip(*rows)) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(p, t) for p, t in zip(parts, types)], names=names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for number, (_, texts, _) in chunks(batches, 1, chunk):
            words, _ = numbered_words(texts.to_pylist())
            yield rows_of([(number, ASKED, r, squeeze(b" ".join(part)), digest(part), None) for r, part in by_range(words, bits)[1]])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze, expand = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        tokenizer, at, held = loaded(told.value), None, []

        def settled() -> pa.RecordBatch:
            asked = [(number, expand(value).split(b" "), mark) for number, value, mark in held]
            distinct = list(dict.fromkeys(w for _, words, _ in asked for w in words))
            number_of = dict(zip(distinct, range(len(distinct))))
            found = [word_ids(tokenizer, distinct[a:a + BATCH]) for a in range(0, len(distinct), BATCH)]
            ids = np.concatenate([np.empty(0, np.uint32), *[f for f, _ in found]])
            starts = np.concatenate([[0], *[n for _, n in found]]).cumsum(dtype=np.int64)
            out = []
            for number, words, mark in asked:
                own = np.fromiter(map(number_of.__getitem__, words), np.int64, len(words))
                sizes = (starts[own + 1] - starts[own]).astype("<u4")
                out.append((number, ANSWERED, at, squeeze(sizes.tobytes() + gathered(ids, starts, own).astype("<u4").tobytes()),
                            mark + len(words).to_bytes(8, "little"), None))
            return rows_of(out)

        for batch in batches:
            for number, _, place, value, mark, _ in zip(*(c.to_pylist() for c in batch.columns)):
                if place != at:
                    if held:
                        yield settled()
                    at, held = place, []
                held.append((number, value, mark))
        if held:
            yield settled()

    asked = source.mapInArrow(ask, columns).repartition("place").sortWithinPartitions("place", "chunk")
    answers = asked.mapInArrow(answer, columns)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for number, (ids, texts, _) in chunks(batches, 1, chunk):
            words, places = numbered_words(texts.to_pylist())
            ranges, parts = by_range(words, bits)
            yield rows_of([(number, LAID, 0, squeeze(ranges.astype("<u4").tobytes()), b"".join(digest(p) for _, p in parts), None)])
            keys = ids.cast(pa.int64()).to_pylist()
            for a in range(0, len(places), 2000):
                yield rows_of([(number, TEXT, k, squeeze(b"".join(packed(p))), len(p).to_bytes(8, "little"), doc)
                               for k, (p, doc) in enumerate(zip(places[a:a + 2000], keys[a:a + 2000]))])

    laid = source.mapInArrow(lay, columns)
    together = answers.union(laid).repartition("chunk").sortWithinPartitions("chunk", "kind", "place")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        pieces = pieces_of(told.value)
        flat, starts, at = np.empty(0, np.uint32), np.zeros(1, np.int64), None
        sizes, ids, marks = [], [], []
        for batch in batches:
            out: list[tuple] = []
            weight = 0
            for number, kind, value, extra, doc in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))):
                if number != at:
                    at, sizes, ids, marks = number, [], [], []
                if kind == ANSWERED:
                    n, held = int.from_bytes(extra[8:], "little"), np.frombuffer(expand(value), "<u4")
                    sizes.append(held[:n])
                    ids.append(held[n:])
                    marks.append(extra[:8])
                elif kind == LAID:
                    if b"".join(marks) != extra:
                        raise ValueError("the input changed between two reads; read it from files or a work table")
                    # Answers are by range, and in each range by rank; words are numbered by rank.
                    order = np.argsort(np.frombuffer(expand(value), "<u4"), kind="stable")
                    if len(order):
                        every = np.concatenate(sizes).astype(np.int64)
                        begin = np.cumsum(every) - every
                        by_rank = np.empty(len(order), np.int64)
                        by_rank[order] = np.arange(len(order))
                        flat = gathered(np.concatenate(ids), np.append(begin, every.sum()), by_rank)
                        starts = np.concatenate([[0], np.cumsum(every[by_rank])])
                else:
                    n = int.from_bytes(extra, "little")
                    held = expand(value)
                    found = gathered(flat, starts, unpacked(held[:-(-n // 4)], held[-(-n // 4):], n)) if n else flat[:0]
                    out.append((doc, found.astype("<u4").tobytes(), " ".join([pieces[i] for i in found.tolist()])))
                    weight += len(out[-1][1])
                if weight > 8_000_000:
                    yield decoded_rows(out)
                    out, weight = [], 0
            yield decoded_rows(out)

    return together.mapInArrow(fill, "doc bigint, ids binary, decoded string")


def decoded_rows(rows: list[tuple]) -> pa.RecordBatch:
    doc, ids, decoded = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                                      names=["doc", "ids", "decoded"])


def bpe_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        F.col("doc").alias("doc_id"), (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """The public tokenizer's file, read where the driver runs and sent with the tasks."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")
