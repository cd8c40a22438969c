"""Log probability of texts under an n-gram model with deleted interpolation.

The model mixes the maximum-likelihood estimates of pairs and of single tokens with a
uniform one: ``l2 c(h, w) / c(h) + l1 c(w) / N + l0 / (V + 1)``. The weights depend on
the bucket of the context's frequency, a power of two. They are learned by expectation
maximisation on a fold of the training texts that is deleted from the counts meanwhile;
the final counts are those of all training texts.

A chunk of texts sends each of its distinct tokens and pairs once, with their count in
the chunk, parted by ranges of their hashes. Each range is summed over all chunks and
answered chunk by chunk; so frequent tokens are as many entries as there are chunks, and
a text's score needs no row per token. The number of ranges follows from the bytes of
all texts, so a range has bounded size. EM runs on a histogram of the deleted fold:
bucket by the two estimates in steps of an eighth of an octave, a table whose size does
not depend on the corpus.

Tokens are words in lower case (A-Z only), then one end, which is also the context of a
text's first word. A null or empty text is the end alone. Equal rows count as often as
they occur. A null id belongs to fold 0. Without training texts the model is uniform.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepact.llm.chunks import CHUNK, chunks
from tablepact.llm.common import materialized, text_of
from tablepact.llm.shingles import WordHashes, mixed

#: Folds by crc32 of the id: the one that is scored only, and the one that EM uses.
FOLDS, SCORED, DELETED = 7, 2, 3
#: Bytes of text whose hashes make up a range, about.
RANGE_TEXT = 8_000_000
BUCKETS = 48
STEPS = 8  # of the histogram, in an octave
NEVER = -(10**6)
_END = np.uint64(0x9E3779B97F4A7C15)
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def fold_of(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(FOLDS)), F.lit(0)).cast("int")


def tokens_of(texts: list[bytes], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' tokens in a row, and each text's number of tokens."""
    split = [t.lower().split() for t in texts]  # of bytes: A-Z and ASCII blanks only
    counts = np.fromiter((len(s) + 1 for s in split), np.int64, len(split))
    hashes = np.empty(counts.sum(), np.uint64)
    ends = np.cumsum(counts) - 1
    word = np.ones(len(hashes), bool)
    word[ends] = False
    hashes[ends] = _END
    hashes[word] = np.fromiter((known[w] for words in split for w in words), np.uint64, int(word.sum()))
    return hashes, counts


def pairs_of(hashes: np.ndarray) -> np.ndarray:
    before = np.concatenate([[_END], hashes[:-1]]) if len(hashes) else hashes
    return mixed(before * _PAIR + hashes)


def _squeezed(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _expanded(value: bytes, dtype: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(value), dtype)


def _asked(source: DataFrame, bits: int, chunk: int) -> DataFrame:
    """Each chunk's distinct keys by range, with their training counts. Odd chunks are of the deleted fold."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for number, (_, texts, folds, _) in chunks(batches, 1, chunk):
            fold = folds.to_numpy(zero_copy_only=False)
            for part in (0, 1):
                mine = np.flatnonzero((fold == DELETED) == bool(part))
                if not len(mine):
                    continue
                hashes, counts = tokens_of(texts.take(pa.array(mine)).to_pylist(), known)
                counted = np.repeat(fold[mine] != SCORED, counts)
                for kind, keys in ((1, hashes), (2, pairs_of(hashes))):
                    own, inverse = np.unique(keys, return_inverse=True)
                    count = np.bincount(inverse, counted, len(own)).astype("<u4")
                    edges = np.searchsorted(own >> np.uint64(64 - bits), np.arange(2**bits + 1, dtype=np.uint64)) if bits else [0, len(own)]
                    full = [(r, a, b) for r, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([2 * number + part] * len(full), pa.int64()), pa.array([kind] * len(full), pa.int32()),
                        pa.array([r for r, _, _ in full], pa.int32()), pa.array([own[a:b].tobytes() for _, a, b in full], pa.binary()),
                        pa.array([_squeezed(count[a:b]) for _, a, b in full], pa.binary())],
                        names=["chunk", "kind", "range", "keys", "counts"])

    return source.mapInArrow(ask, "chunk bigint, kind int, range int, keys binary, counts binary")


def _answered(asked: DataFrame) -> DataFrame:
    """For each chunk and range the sums over all chunks; a row with the range's totals besides."""
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def settled() -> pa.RecordBatch:
            numbers = np.array([h[0] for h in held])
            keys = [np.frombuffer(h[1], "<u8") for h in held]
            sizes = np.array([len(k) for k in keys])
            _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.concatenate([_expanded(h[2], "<u4") for h in held]).astype(np.float64)
            rest = np.repeat(numbers % 2 == 0, sizes)
            main, every = np.bincount(inverse, count * rest), np.bincount(inverse, count)
            values = [_squeezed(np.concatenate([main[i], every[i]]).astype("<u8")) for i in np.split(inverse, np.cumsum(sizes)[:-1])]
            n = len(held)
            totals = [int(main.sum()), int((main > 0).sum()), int(every.sum()), int((every > 0).sum())]
            return pa.RecordBatch.from_arrays([
                pa.array([*numbers.tolist(), -1], pa.int64()), pa.array([at[0]] * (n + 1), pa.int32()), pa.array([at[1]] * (n + 1), pa.int32()),
                pa.array([*values, None], pa.binary()), *[pa.array([None] * n + [t], pa.int64()) for t in totals]],
                names=["chunk", "kind", "range", "value", "n_main", "v_main", "n_all", "v_all"])

        for batch in batches:
            for number, kind, own, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if (kind, own) != at:
                    if held:
                        yield settled()
                    at, held = (kind, own), []
                held.append((number, keys, counts))
        if held:
            yield settled()

    dealt = asked.repartition("kind", "range").sortWithinPartitions("kind", "range", "chunk")
    return materialized(dealt.mapInArrow(
        answer, "chunk bigint, kind int, range int, value binary, n_main bigint, v_main bigint, n_all bigint, v_all bigint"), "lm-counts")


def _together(source: DataFrame, answers: DataFrame, chunk: int, deleted_only: bool) -> DataFrame:
    """Answers and texts of each chunk in one partition, the answers first."""
    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for number, (ids, texts, folds, _) in chunks(batches, 1, chunk):
            fold = folds.to_numpy(zero_copy_only=False)
            mine = np.flatnonzero(fold == DELETED) if deleted_only else np.arange(len(fold))
            take = pa.array(mine)
            yield pa.RecordBatch.from_arrays([
                pa.array(2 * number + (fold[mine] == DELETED)), pa.array(np.full(len(mine), 3, np.int32)), pa.array(fold[mine].astype(np.int32)),
                pa.array([squeeze(t) for t in texts.take(take).to_pylist()], pa.binary()), ids.cast(pa.int64()).take(take)],
                names=["chunk", "kind", "range", "value", "doc"])

    laid = source.mapInArrow(lay, "chunk bigint, kind int, range int, value binary, doc bigint")
    wanted = answers.where("chunk >= 0 and chunk % 2 = 1" if deleted_only else "chunk >= 0")
    both = wanted.select("chunk", "kind", "range", "value", F.lit(None).cast("bigint").alias("doc")).union(laid)
    return both.repartition("chunk").sortWithinPartitions("chunk", "kind", "range")


def _chunk_counts(batches: Iterator[pa.RecordBatch], which: int) -> Iterator[tuple]:
    """For each chunk: ids, folds, numbers of tokens; c(w) and c(h, w) of all tokens in a row."""
    known = WordHashes()
    at, answers, rows = None, {1: [], 2: []}, []

    def settled() -> tuple:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        texts = [expand(r.pop()) for r in rows]
        hashes, counts = tokens_of(texts, known)
        del texts
        found = []
        for kind, keys in ((1, hashes), (2, pairs_of(hashes))):
            own, inverse = np.unique(keys, return_inverse=True)
            parts = [_expanded(v, "<u8").reshape(2, -1)[which] for v in answers[kind]]
            values = np.concatenate(parts) if parts else np.empty(0, np.uint64)
            if len(values) != len(own):
                raise ValueError("the input changed between two reads; read it from files or a work table")
            found.append(values[inverse].astype(np.float64))
        return [r[0] for r in rows], np.array([r[1] for r in rows]), counts, *found

    for batch in batches:
        for number, kind, own, value, doc in zip(*(c.to_pylist() for c in batch.columns)):
            if number != at:
                if rows:
                    yield settled()
                at, answers, rows = number, {1: [], 2: []}, []
            if kind == 3:
                rows.append([doc, own, value])
            else:
                answers[kind].append(value)
    if rows:
        yield settled()


def _estimates(single: np.ndarray, pair: np.ndarray, counts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each token's context, and the two estimates."""
    ends = np.cumsum(counts) - 1
    context = np.concatenate([[single[ends[0]]], single[:-1]])  # what precedes a text is an end, its first context
    bucket = np.where(context > 0, np.frexp(np.maximum(context, 1))[1], 0).clip(max=BUCKETS - 1)
    return bucket, pair / np.maximum(context, 1), single / max(1, total)


def learned_weights(histogram: np.ndarray, weight: np.ndarray, rounds: int = 200) -> np.ndarray:
    """``BUCKETS x 3`` weights by expectation maximisation.

    ``histogram``: rows of bucket and of the logarithms of both estimates over the
    uniform one, in steps. A bucket without held-out tokens keeps equal weights, or for
    contexts never seen, which have no pairs, those of the other two.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    for b in np.unique(histogram[:, 0]) if len(histogram) else ():
        own = histogram[:, 0] == b
        steps = histogram[own, 1:]
        density = np.column_stack([np.where(steps > NEVER, np.exp2(np.maximum(steps, -1000) / STEPS), 0), np.ones(own.sum())])
        n, mix = weight[own], weights[b]
        for _ in range(rounds):
            part = density * mix
            mix = (part / part.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum()
        weights[b] = mix if mix[2] > 0 else np.array([*(mix[:2] * (1 - 1e-9)), 1e-9])
    return weights


def scored(docs: DataFrame, *, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``doc, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row."""
    source = docs.select(F.col(key).alias("doc"), text_of(text).cast("binary").alias("t"),
                         fold_of(F.col(key)).alias("fold"), F.spark_partition_id().alias("part"))
    size = docs.agg(F.sum(F.octet_length(text_of(text)))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, size / RANGE_TEXT)))))
    answers = _answered(_asked(source, bits, chunk))
    totals = answers.where("chunk = -1 and kind = 1").agg(*[F.sum(c) for c in ("n_main", "v_main", "n_all", "v_all")]).first()
    n_main, v_main, n_all, v_all = (t or 0 for t in totals)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, counts, single, pair in _chunk_counts(batches, 0):
            bucket, p2, p1 = _estimates(single, pair, counts, n_main)
            with np.errstate(divide="ignore"):
                steps = [np.where(p > 0, np.rint(np.log2(p * (v_main + 1)) * STEPS), NEVER).astype(np.int64) for p in (p2, p1)]
            rows, n = np.unique(np.column_stack([bucket, *steps]), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, i].astype(np.int64)) for i in range(3)), pa.array(n)],
                                             names=["bucket", "pair", "single", "n"])

    histogram = _together(source, answers, chunk, True).mapInArrow(measure, "bucket bigint, pair bigint, single bigint, n bigint")
    rows = histogram.groupBy("bucket", "pair", "single").agg(F.sum("n").alias("n")).toPandas().sort_values(["bucket", "pair", "single"])
    weights = learned_weights(rows[["bucket", "pair", "single"]].to_numpy(), rows["n"].to_numpy(np.float64))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, folds, counts, single, pair in _chunk_counts(batches, 1):
            bucket, p2, p1 = _estimates(single, pair, counts, n_all)
            mix = weights[bucket]
            logs = np.log10(mix[:, 0] * p2 + mix[:, 1] * p1 + mix[:, 2] / (v_all + 1))
            base = np.log10((single + 1) / (n_all + v_all + 1))
            begins = np.cumsum(counts) - counts
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(folds == SCORED), pa.array(counts),
                pa.array(np.add.reduceat((single > 0).astype(np.int64), begins)), pa.array(np.full(len(ids), n_all, np.int64)),
                pa.array(np.add.reduceat(base, begins)), pa.array(np.add.reduceat(logs, begins))],
                names=["doc", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return _together(source, answers, chunk, False).mapInArrow(
        score, "doc bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
