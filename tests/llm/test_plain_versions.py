"""The language model's score and the whole pipeline against plain versions, stage by stage."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

public = pytest.importorskip("public_tokenizers")

from tablepact.llm import oracles  # noqa: E402
from tablepact.llm.common import materialized  # noqa: E402
from tablepact.llm.lmscore import scored  # noqa: E402
from tablepact.llm.tokens import tokenizer  # noqa: E402

RNG = random.Random(33)
WORDS = ["".join(RNG.choices("abcdefgh", k=RNG.randint(2, 6))) for _ in range(300)]


def prose(n):
    return " ".join(RNG.choices(WORDS, k=n))


# -- deleted interpolation -------------------------------------------------------


def plain_scores(rows):
    """Counts in dictionaries; EM over the deleted fold; estimates in steps of an eighth of an octave."""
    fold = [0 if i is None else zlib.crc32(str(i).encode()) % 7 for i, _ in rows]
    texts = [(t or "").encode().lower().split() + [None] for _, t in rows]

    def counted(folds):
        single, pair = collections.Counter(), collections.Counter()
        for words, f in zip(texts, fold):
            if f in folds:
                single.update(words)
                pair.update(zip([None, *words[:-1]], words))
        return single, pair

    def estimates(words, single, pair):
        total = sum(single.values())
        for h, w in zip([None, *words[:-1]], words):
            c = single[h]
            yield (min(47, int(c).bit_length()), pair[h, w] / max(c, 1), single[w] / max(total, 1))

    single, pair = counted({0, 1, 4, 5, 6})
    size = len(single) + 1
    seen = collections.defaultdict(collections.Counter)
    for words, f in zip(texts, fold):
        if f == 3:
            for b, p2, p1 in estimates(words, single, pair):
                seen[b][tuple(2 ** (round(math.log2(p * size) * 8) / 8) if p else 0.0 for p in (p2, p1))] += 1
    weights = collections.defaultdict(lambda: [1 / 3, 1 / 3, 1 / 3], {0: [0, 0.5, 0.5]})
    for b, pairs in seen.items():
        mix = list(weights[b])
        for _ in range(200):
            new = [0.0, 0.0, 0.0]
            for (p2, p1), n in pairs.items():
                parts = [mix[0] * p2, mix[1] * p1, mix[2]]
                for k in range(3):
                    new[k] += n * parts[k] / sum(parts)
            mix = [x / sum(pairs.values()) for x in new]
        weights[b] = mix if mix[2] > 0 else [mix[0] * (1 - 1e-9), mix[1] * (1 - 1e-9), 1e-9]
    single, pair = counted({0, 1, 3, 4, 5, 6})
    size = len(single) + 1
    return [sum(math.log10(weights[b][0] * p2 + weights[b][1] * p1 + weights[b][2] / size) for b, p2, p1 in estimates(words, single, pair)) for words in texts]


def test_scores_equal_a_plain_model(spark):
    phrases = [prose(6) for _ in range(40)]
    rows = [(i, " ".join(RNG.choices(phrases, k=RNG.randint(1, 9)) + RNG.choices(WORDS, k=RNG.randint(0, 9)))) for i in range(300)]
    rows += [(None, phrases[0]), (400, None), (401, ""), (402, "never seen words"), (5, "Again " + phrases[1]), (5, "Again " + phrases[1])]
    frame = materialized(spark.createDataFrame(rows, "doc_id bigint, text string"), "docs")
    found = sorted((str(r.doc), r.n_tokens, r.score) for r in scored(frame, chunk=3000).collect())
    want = sorted((str(i), len((t or "").split()) + 1, s) for (i, t), s in zip(rows, plain_scores(rows)))
    assert [f[:2] for f in found] == [w[:2] for w in want]
    assert [f[2] for f in found] == pytest.approx([w[2] for w in want], rel=1e-6)


# -- the pipeline ----------------------------------------------------------------


def near_duplicates_gone(docs):
    """The least id of each group of documents whose sets of five words are at least 0.8 alike."""
    sets = {}
    for i, text in docs.items():
        words = (text or "").encode().split()
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else None
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for a in range(len(ids)):
        for b in range(a):
            one, two = sets[ids[a]], sets[ids[b]]
            if one and two and len(one & two) >= 0.8 * len(one | two):
                low, high = sorted((find(ids[a]), find(ids[b])))
                root[high] = low
    return {i: t for i, t in docs.items() if find(i) == i}


def redacted(text, spans):
    """Overlapping spans go together, under the kind of the one that starts first, the longest of these."""
    found = sorted((int(a), -int(b), kind) for kind, a, b in (s.split(":") for s in spans.split(",") if s))
    merged = []
    for a, b, kind in found:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], -b)
        else:
            merged.append([a, -b, kind])
    for a, b, kind in reversed(merged):
        text = text[:a] + f"[{kind.upper()}]" + text[b:]
    return text


def in_sql(sql, docs, **tables):
    """Rows of a query's SQL over the given documents."""
    con = duckdb.connect()
    held = {"documents": pa.table({"doc_id": pa.array(list(docs), pa.int64()), "text": pa.array([t for t, _ in docs.values()], pa.string()), "lang": pa.array([x for _, x in docs.values()], pa.string())}), **tables}
    for name, table in held.items():
        con.register(name, table)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return [dict(zip(names, r)) for r in result.fetchall()]


def test_pipeline_equals_its_stages_in_plain(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    good = [prose(RNG.randint(30, 120)) for _ in range(520)]
    noisy = [" ".join(w + "##" for w in prose(40).split()) for _ in range(60)]
    items = [prose(30), "Compute 12 + 34 - 56 * 78", "If Anna Berg rides 120 km in 3 hours how far does Anna Berg ride in 7 hours today"]
    private = ["write to ann@x.org now", "SSN 123-45-6789 and 10.0.0.1", "pay DE89 3704 0044 0532 0130 00 soon", "card 4111 1111 1111 1111"]
    texts = good + noisy + [None, "", "short", "a b c d e " * 9]
    texts += [" ".join(t.split()[:-1] + ["changed"]) for t in good[:40] if len(t.split()) > 60] + good[40:60]
    texts += [f"{prose(20)} {RNG.choice(items)} {prose(20)}" for _ in range(25)] + [f"{prose(25)} {RNG.choice(private)} {prose(25)}" for _ in range(40)]
    texts += [f"{prose(20)} If Tom rides 85 km in 4 hours how far does Tom ride in 9 hours today"]
    docs = {i: (t, "en" if i < 580 else RNG.choice(["en", "de"])) for i, t in enumerate(texts)}
    labels = pa.table({"doc_id": pa.array(range(580), pa.int64()), "quality": pa.array([1] * 520 + [0] * 60, pa.int32())})
    benchmark = pa.table({"item_id": pa.array(range(3), pa.int64()), "text": pa.array(items)})
    for name, table in (("labels", labels), ("benchmark", benchmark), ("documents", pa.table({
            "doc_id": pa.array(list(docs), pa.int64()), "text": pa.array([t for t, _ in docs.values()], pa.string()), "lang": pa.array([x for _, x in docs.values()])}))):
        pq.write_table(table, tmp_path / f"{name}.parquet")

    judged = in_sql(oracles.quality(), docs, labels=labels)
    kept = {r["doc_id"]: docs[r["doc_id"]] for r in judged if r["kept"]}
    assert any(not r["kept"] and not r["base_failed"] for r in judged)  # a certified cutoff rejects
    single = near_duplicates_gone({i: t for i, (t, _) in kept.items()})
    assert len(single) < len(kept)
    held = {r["doc_id"] for r in in_sql(oracles.decontamination(), {i: kept[i] for i in single}, benchmark=benchmark)}
    clean = {i: kept[i] for i in single if i not in held}
    assert held
    masked = {r["doc_id"]: redacted(clean[r["doc_id"]][0], r["spans"]) for r in in_sql(oracles.pii(), clean)}
    assert any("[IBAN]" in t for t in masked.values())
    plain, expected = Tokenizer.from_str(tokenizer()), {}
    for i, text in masked.items():
        ids = plain.encode(text, add_special_tokens=False).ids
        decoded = plain.decode(ids, skip_special_tokens=False)
        expected[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == expected


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name, fields in (("labels", [("doc_id", pa.int64()), ("quality", pa.int32())]), ("benchmark", [("item_id", pa.int64()), ("text", pa.string())]),
                         ("documents", [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string())])):
        pq.write_table(pa.schema(fields).empty_table(), tmp_path / f"{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()
