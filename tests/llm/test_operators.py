"""The operators against plain versions on small tables, and on awkward rows."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")

from tablepact.llm.bytecode import packed, unpacked  # noqa: E402
from tablepact.llm.common import materialized  # noqa: E402
from tablepact.llm.components import components  # noqa: E402
from tablepact.llm.decontaminate import contained_items, without_contained  # noqa: E402
from tablepact.llm.jaccard import linked_documents, one_of_each  # noqa: E402
from tablepact.llm.lmscore import learned_weights, scored  # noqa: E402
from tablepact.llm.passages import chains_of, edit_distance, repeated_passages  # noqa: E402
from tablepact.llm.pii import redacted, spans_text, with_spans  # noqa: E402
from tablepact.llm.quality import Limits, base_failed, binomial_tail, judged_by_rules  # noqa: E402
from tablepact.llm.quotes import conversations_in_reply_order, parted  # noqa: E402
from tablepact.llm.sharding import lookup_table, placed, read_shards, write_shards  # noqa: E402
from tablepact.llm.shingles import bands_for  # noqa: E402
from tablepact.llm.tokenfiles import read_token_files, write_token_files  # noqa: E402
from tablepact.llm.tokens import encoded_by_words, loaded, parts_at_blanks, tokenizer, word_ids  # noqa: E402

RNG = random.Random(5)
WORDS = ["".join(RNG.choices("abcdefgh", k=RNG.randint(2, 6))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(RNG.choices(WORDS, k=n))


def docs_of(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    return materialized(frame.withColumns({"kept": F.lit("mine"), "class": F.lit(1), "lang": F.lit("en"), "slot": F.lit(3)}), "docs")


LONG = prose(30_000)
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "two words"), (7, LONG), (8, LONG), (9, "ä ö <|endoftext|> 5km")]


@pytest.fixture(scope="module")
def near(spark):
    """Documents with exact and near copies."""
    rows = [(i, prose(RNG.randint(3, 200))) for i in range(60)]
    for i in range(0, 30, 3):
        words = rows[i][1].split()
        for k in range(4):
            copy = list(words)
            if k and len(copy) > 60:
                copy[RNG.randrange(len(copy))] = f"new{k}"
            rows.append((100 + 10 * i + k, " ".join(copy)))
    return rows + AWKWARD


def test_jaccard_equals_brute_force(spark, near):
    sets = []
    for i, text in near:
        words = (text or "").encode().split()
        sets.append({tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    links, parent = collections.Counter(), list(range(len(near)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(near)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for a in range(len(near)):
        groups[find(a)].append(near[a][0])
    expected = sorted((str(near[a][0]), str(min((i for i in groups[find(a)] if i is not None), default=None)), links[a]) for a in range(len(near)))
    found = linked_documents(docs_of(spark, near)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in found) == expected
    kept = one_of_each(docs_of(spark, near)).collect()
    worded = {a for a in range(len(near)) if sets[a]}
    assert len(kept) == len({find(a) for a in worded}) + len(near) - len(worded)


def test_bands_reach_the_recall():
    bands, rows = bands_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128


def test_components(spark):
    edges = [(RNG.randrange(200), RNG.randrange(200)) for _ in range(120)] + [(1000, k) for k in range(1001, 1100)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_passages(spark):
    shared, fuzzy = prose(70), prose(90)
    changed = fuzzy.split()
    changed[30], changed[60] = "other", "words"
    rows = [(i, f"{prose(40)} {shared} {prose(40)}") for i in range(6)]
    rows += [(20, f"{prose(30)} {fuzzy}"), (21, f"{' '.join(changed)} {prose(80)}")] + [(i, prose(120)) for i in range(30, 40)] + AWKWARD
    found = collections.defaultdict(list)
    for r in repeated_passages(docs_of(spark, rows)).collect():
        found[r.doc].append((r.start, r.end))
    assert set(found) == {0, 1, 2, 3, 4, 5, 7, 8, 20, 21}
    assert all(abs(found[i][0][0] - 40) <= 2 and abs(found[i][0][1] - 110) <= 2 for i in range(6))
    assert found[7] == [(0, 30_000)] and abs(found[21][0][1] - 90) <= 2


def changed(words, share):
    """So many of the words replaced, left out or followed by another one, at random places."""
    out = list(words)
    for k in sorted(RNG.sample(range(1, len(words) - 1), round(share * len(words))), reverse=True):
        out[k:k + 1] = RNG.choice([["other"], ["other"], [], [words[k], "more"]])
    return out


def passages_by_document(spark, rows):
    found = collections.defaultdict(list)
    for r in repeated_passages(materialized(spark.createDataFrame(rows, "doc_id bigint, text string"), "docs")).collect():
        found[r.doc].append((r.start, r.end))
    return found


def test_passages_with_many_changes(spark):
    rows, alike = [], {}
    for n, share in [(n, share) for n in (52, 60, 100) for share in (0.05, 0.1, 0.15, 0.2) for _ in range(12)]:
        words = prose(n).split()
        other = changed(words, share)
        ids = {w: k for k, w in enumerate(dict.fromkeys(words + other))}
        far = edit_distance(*(np.array([ids[w] for w in x], np.uint32) for x in (words, other)))
        runs = [{tuple(x[k:k + 8]) for k in range(len(x) - 7)} for x in (words, other)]
        # A run of 8 equal words has a seed for certain; from 52 words on a few may be lost at the ends.
        alike[len(rows)] = bool(runs[0] & runs[1]) and far <= 0.2 * max(len(words), len(other)) - 1 and min(len(words), len(other)) >= 52
        for x in (words, other):
            rows.append((len(rows), f"{prose(30)} {' '.join(x)} {prose(30)}"))
    found = passages_by_document(spark, rows)
    certain = [i for i, yes in alike.items() if yes]
    assert len(certain) > 90
    assert [i for i in certain if not (found[i] and found[i + 1])] == []


def test_copies_made_of_frequent_sentences(spark):
    rows, pairs = [], []
    for parts, size in [(3, 18), (2, 26), (4, 13), (4, 25)] * 12:
        sentences = [prose(size) for _ in range(parts)]
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows) + k, f"{prose(20)} {' '.join(sentences)} {prose(20)}") for k in (0, 1)]
        rows += [(len(rows) + k, f"{prose(30)} {x} {prose(30)}") for _ in range(3) for k, x in enumerate(sentences)]
    found = passages_by_document(spark, [(i, t) for i, (_, t) in enumerate(rows)])
    copies = {i for pair in pairs for i in pair}
    assert set(found) == copies
    assert all(b - a >= 50 for i in copies for a, b in found[i])


def test_chains_look_past_what_is_too_far(spark):
    assert sorted(chains_of([(0, 0, 200), (300, 300, 14), (320, 321, 14), (340, 342, 14)])) == [[0], [1, 2, 3]]
    # Two good passages, an insertion in each, and 50 foreign words between them.
    one, two = prose(70).split(), prose(70).split()
    more = one[:35] + ["more"] + one[35:], two[:35] + ["more"] + two[35:]
    found = passages_by_document(spark, [(1, " ".join([*one, prose(50), *two])), (2, " ".join([*more[0], prose(50), *more[1]]))])
    assert all(len(v) == 2 and all(b - a >= 68 for a, b in v) for v in found.values()) and set(found) == {1, 2}


def plain_scores(anchors):
    """The best score of a chain that ends in each anchor, from every anchor before it."""
    score = {}
    for i in sorted(range(len(anchors)), key=lambda i: anchors[i]):
        start, pstart, words = anchors[i]
        gaps = {j: (start - s - w, pstart - p - w) for j, (s, p, w) in enumerate(anchors) if j in score}
        gains = [score[j] - 0.1 * (a + b) for j, (a, b) in gaps.items() if 0 <= a <= 60 and 0 <= b <= 60]
        score[i] = words + max([0, *gains])
    return score


def test_chains_equal_all_pairs_of_anchors():
    for _ in range(300):
        far = RNG.choice([40, 300, 1500])
        anchors = [(RNG.randrange(far), RNG.randrange(far), RNG.randint(1, 30)) for _ in range(RNG.randint(2, 60))]
        scores = plain_scores(anchors)
        chains = chains_of(anchors)
        assert sorted(i for c in chains for i in c) == list(range(len(anchors)))
        for chain in chains:
            for (s, p, w), (t, q, _) in zip((anchors[i] for i in chain), (anchors[i] for i in chain[1:])):
                assert 0 <= t - s - w <= 60 and 0 <= q - p - w <= 60
        best = chains[0]
        gaps = sum(anchors[b][0] + anchors[b][1] - anchors[a][0] - anchors[a][1] - 2 * anchors[a][2] for a, b in zip(best, best[1:]))
        assert sum(anchors[i][2] for i in best) - 0.1 * gaps == pytest.approx(max(scores.values()))


def test_chains_and_distance():
    assert chains_of([(0, 0, 10), (15, 14, 10), (18, 500, 9), (40, 41, 10)])[0] == [0, 1, 3]
    for _ in range(40):
        a, b = (np.array(RNG.choices(range(4), k=RNG.randint(0, 12)), np.uint32) for _ in range(2))
        table = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + int(a[i - 1] != b[j - 1]))
        assert edit_distance(a, b) == table[-1][-1]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_spans(text):
    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(p) < 256 for p in m[0].split(".")) if kind == "ip" else 0,
                "card": 13 <= len(digits) <= 19 and luhn(digits or "0"), "phone": 9 <= len(digits) <= 15}[kind]:
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(found)


def test_pii_equals_plain_patterns(spark):
    pieces = ["a", "b.c", "@", ".", "x-y", "1", "255", "4111111111111111", " ", "+49 (30) 12345-678", "ä", "\n", "-", "10.0.0.1", "é@x.org"]
    texts = ["".join(RNG.choices(pieces, k=RNG.randint(1, 14))) for _ in range(800)] + [t or "" for _, t in AWKWARD] + ["a" * 50_000 + "@", "1" * 50_000]
    frame = materialized(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "pii")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    got = dict(with_spans(frame, "text", "spans").select("doc_id", spans_text(base)).collect())
    assert {i: t for i, t in got.items() if t != plain_spans(texts[i])} == {}


def test_added_kinds_and_redaction(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00"), (2, "my SSN is 123-45-6789"), (3, "part 123-45-6789"),
            (4, "mail x@y.org or 10.0.0.1!"), (5, None), (6, "")]
    frame = docs_of(spark, rows)
    said = dict(with_spans(frame, "text", "spans").select("doc_id", spans_text(F.col("spans"))).collect())
    assert said == {1: "iban:5:32", 2: "ssn:10:21", 3: "", 4: "email:5:12,ip:16:24", 5: "", 6: ""}
    out = redacted(frame)
    assert out.columns == frame.columns
    texts = dict(out.select("doc_id", "text").collect())
    assert texts[4] == "mail [EMAIL] or [IP]!" and texts[5] is None and texts[1].startswith("IBAN [IBAN], not")


def test_spans_that_stand_close_together(spark):
    rows = [(1, "SSN 123-45-6789, 234-56-7890"), (2, "SSN (1-2-3) 123-45-6789"), (3, "pay BE68 5390 0754 7034 BIC GKCCBEBB"),
            (4, "AT61 1904 3002 3457 3201 EUR 50"), (5, "ES91 2100 0418 4502 0005 1332 DE89 3704 0044 0532 0130 00"),
            (6, "NO12 BE68 5390 0754 7034"), (7, "ä PL61109010140000071219812874 IN"), (8, f"SSN {'x' * 37} 123-45-6789"), (9, "BE69 5390 0754 7034 BIC")]
    frame = docs_of(spark, rows)
    said = dict(with_spans(frame, "text", "spans").select("doc_id", spans_text(F.col("spans"))).collect())
    assert said == {1: "ssn:4:15,ssn:17:28", 2: "ssn:12:23", 3: "iban:4:23", 4: "iban:0:24", 5: "iban:0:29,iban:30:57",
                    6: "iban:5:24", 7: "iban:2:30", 8: "", 9: ""}
    assert dict(redacted(frame).select("doc_id", "text").collect())[3] == "pay [IBAN] BIC GKCCBEBB"


def test_quality(spark):
    good = [(i, prose(40)) for i in range(900)]
    bad = [(1000 + i, " ".join(w + "###" for w in prose(40).split())) for i in range(100)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad[:50]] + [(None, 1), (3, None), (5, 0)], "doc_id bigint, quality int")
    judged, m, kept = judged_by_rules(docs_of(spark, good + bad + AWKWARD), labels)
    assert m == "measures" and kept == "kept_"
    rows = {(r.doc_id, r.text): r for r in judged.withColumn("failed", base_failed(F.col(m))).collect()}
    assert all(rows[x].kept_ for x in good) and not any(rows[x].kept_ for x in bad)
    assert all(rows[x].failed and not rows[x].kept_ for x in AWKWARD if len((x[1] or "").split()) < 10)
    judged, _, _ = judged_by_rules(docs_of(spark, good[:20] + bad[:20]), labels.where("false"))
    assert judged.where("kept_").count() == 40  # nothing can be certified


def test_binomial_tail(spark):
    p = Limits().risk
    got = spark.range(0, 30).select("id", binomial_tail(F.col("id"), F.lit(500).cast("bigint"), p)).collect()
    for k, value in got:
        exact = sum(math.comb(500, i) * p**i * (1 - p) ** (500 - i) for i in range(k + 1)) if k < 500 * p else 1
        assert value == pytest.approx(exact, rel=1e-9)


ITEM = "If a train with Anna Berg travels 120 km in 3 hours how far does the same train with Anna Berg travel in 7 hours"


def test_decontamination(spark):
    other = ITEM.replace("120", "85").replace("Anna Berg", "Tom").replace("7 hours", "9 days")
    mixed = ITEM.replace("with Anna Berg travels", "with Tom travels").replace("Anna Berg travel in", "Eva travel in").replace("120", "3").replace("3 hours", "4 hours")
    rows = [(1, f"{prose(20)} {ITEM} {prose(20)}"), (2, f"{prose(30)} {other}."), (3, prose(90)), (4, mixed)] + AWKWARD
    items = spark.createDataFrame([(0, ITEM), (1, "too short"), (2, None), (None, ITEM), (3, "five words make one window")], "item_id bigint, text string")
    frame = docs_of(spark, rows)
    found = {(r.doc, r.item): r for r in contained_items(frame, items).collect()}
    assert set(found) - {(4, 0)} == {(1, 0), (2, 0)} and found[1, 0].n_changed == 0 and found[2, 0].n_changed >= 3
    kept = without_contained(frame, items)
    assert kept.columns == frame.columns and kept.where("doc_id in (1, 2) and length(text) > 0").isEmpty() and kept.where("doc_id is null").count() == 1
    assert contained_items(frame, items.where("false")).isEmpty() and contained_items(frame.where("false"), items).isEmpty()


def test_decontamination_of_runs_and_slots(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(37)]
    two = words[:14] + ["xx"] + words[15:22] + ["yy"] + words[23:]
    sums, short, one = "Compute 12 + 34 - 56 * 78", "red blue green", "Give seven good reasons for rain"
    items = spark.createDataFrame([(0, " ".join(words)), (1, sums), (2, short), (3, one)], "item_id bigint, text string")
    texts = [" ".join(two), f"{prose(30)} {' '.join(words[8:28])} {prose(30)}", f"{prose(9)} {sums} {prose(9)}", "so compute 12 + 34 - 56 * 79",
             f"{prose(9)} Red, blue, green {prose(9)}", "blue green red", f"{prose(9)} {one} {prose(9)}", " ".join(words[8:20])]
    found = contained_items(docs_of(spark, list(enumerate(texts))), items).collect()
    assert sorted((r.doc, r.item) for r in found) == [(0, 0), (1, 0), (2, 1), (4, 2), (6, 3)]


def test_token_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    plain, rows = Tokenizer.from_str(tokenizer()), [(i, prose(50)) for i in range(20)] + AWKWARD
    assert parts_at_blanks(tokenizer(), [t or "" for _, t in rows] + ["á ̈b it's 12"])
    ids = [plain.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    expected = sorted((str(i), x, plain.decode(x, skip_special_tokens=False)) for (i, _), x in zip(rows, ids))
    for chunk in (300, 10**7):
        found = encoded_by_words(docs_of(spark, rows), tokenizer(), chunk=chunk).collect()
        assert sorted((str(r.doc), np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in found) == expected
    write_token_files(docs_of(spark, rows), str(tmp_path / "files"), tokenizer(), block=100)
    back = read_token_files(spark, str(tmp_path / "files")).orderBy("start").collect()
    assert [(r.key is not None, r.key) for r in back] == sorted((r.key is not None, r.key) for r in back)
    assert [r.start for r in back] == np.cumsum([0] + [len(r.ids) // 4 for r in back[:-1]]).tolist()
    assert sorted((str(r.key), np.frombuffer(r.ids, "<u4").tolist()) for r in back) == sorted((str(i), x + [2]) for (i, _), x in zip(rows, ids))
    empty = docs_of(spark, rows).where("false")
    assert encoded_by_words(empty, tokenizer()).isEmpty()
    write_token_files(empty, str(tmp_path / "none"), tokenizer())
    assert read_token_files(spark, str(tmp_path / "none")).isEmpty()


def test_byte_coding():
    numbers = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1] + RNG.choices(range(10**6), k=1000), np.uint32)
    for n in (0, 1, 4, 5, len(numbers)):
        assert unpacked(*packed(numbers[:n]), n).tolist() == numbers[:n].tolist()


def test_scores(spark):
    rows = [(i, prose(60)) for i in range(200)] + AWKWARD
    tokens = [(t or "").encode().lower().split() + [None] for _, t in rows]
    fold = [zlib.crc32(str(i).encode()) % 7 if i is not None else 0 for i, _ in rows]
    count = collections.Counter(w for t, f in zip(tokens, fold) if f != 2 for w in t)
    n, v = sum(count.values()), len(count)
    results = []
    for chunk in (2000, 10**7):
        found = scored(docs_of(spark, rows), chunk=chunk).collect()
        got = sorted((str(r.doc), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found)
        assert got == sorted((str(i), f == 2, len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 6))
                             for (i, _), t, f in zip(rows, tokens, fold))
        results.append(sorted((str(r.doc), round(r.score, 9)) for r in found))
    assert results[0] == results[1]
    assert scored(docs_of(spark, rows).where("false")).isEmpty()
    weights = learned_weights(np.array([[3, 40, 8], [3, -10**6, 8]]), np.array([9.0, 1.0]))
    assert weights[3].sum() == pytest.approx(1) and weights[3, 0] > 0.5


def plain_lookup(names, size):
    """Slot by slot: every shard in turn takes the first free slot of its own order."""
    orders = [[(xxhash.xxh64_intdigest(n, seed=1) + k * (xxhash.xxh64_intdigest(n, seed=2) % (size - 1) + 1)) % size for k in range(size)] for n in names]
    owner = {}
    while len(owner) < size:
        for name, order in zip(names, orders):
            free = next((s for s in order if s not in owner), None)
            if free is not None:
                owner[free] = name
    return owner


def test_sharding(spark, tmp_path):
    names = [f"s{i}" for i in range(10)]
    owner = lookup_table(names, 211)
    assert {slot: names[i] for slot, i in enumerate(owner)} == plain_lookup(names, 211)
    assert np.ptp(np.bincount(lookup_table(names, 1009))) <= 1
    fewer = lookup_table(names[:-1], 1009)
    assert (lookup_table(names, 1009) != fewer).mean() < 0.25  # a tenth has to move
    rows = AWKWARD + [(i * i - 50, prose(20)) for i in range(200)]
    frame = docs_of(spark, rows)
    dealt = placed(frame, "doc_id", names, size=211)
    write_shards(dealt, str(tmp_path / "shards"))
    back = read_shards(spark, str(tmp_path / "shards"), dealt.schema)
    assert back.columns == [*frame.columns, "slot_", "shard"]
    plain = plain_lookup(names, 211)

    def slot(i):
        value = 42 if i is None else xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42)  # a null leaves the seed as it is
        return (value - (value >= 2**63) * 2**64) % 211

    expected = sorted(((str(i), t or "", slot(i), plain[slot(i)]) for i, t in rows))
    assert sorted((str(r.doc_id), r.text or "", r.slot_, r.shard) for r in back.collect()) == expected
    assert sorted(str(r.text) for r in back.collect()) == sorted(str(t) for _, t in rows)
    write_shards(dealt.where("false"), str(tmp_path / "none"))
    assert read_shards(spark, str(tmp_path / "none"), dealt.schema).isEmpty()
    with pytest.raises(ValueError):
        lookup_table(names, 1000)


def test_quotes(spark):
    first, second = "We met on Monday. The talk was long and dull.", "I liked the talk a lot. Who spoke?"
    rows = [(1, 0, "a", first), (1, 1, "b", "Something else entirely here."), (1, 2, "c", f"On Monday a wrote:\n> The talk was\n> long and dull.\n{second}"),
            (1, 3, "a", f"c wrote:\n>> The talk was long and dull.\n> Who spoke?\nI do not know him."), (1, 4, "b", "> never said by anybody\nNo."),
            (2, 0, "a", "> The talk was long and dull.\nYes."), (2, 0, "a", "> The talk was long and dull.\nYes."), (None, 1, "a", first), (3, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("parent", F.lit(9))
    found = conversations_in_reply_order(frame).collect()
    assert len(found) == len(rows)
    one = sorted((r for r in found if r.conv == 1), key=lambda r: r.position)
    assert [(r.turn, r.parent, r.thread, r.depth) for r in one] == [(0, None, 0, 0), (2, 0, 0, 1), (3, 2, 0, 2), (1, None, 1, 0), (4, None, 4, 0)]
    assert [r.position for r in one] == list(range(5)) and one[1].text == second and one[4].text == "No."
    assert sorted(r.position for r in found if r.conv == 2) == [0, 1]
    assert parted("no quote\n\n") == ("no quote\n\n", [])
    assert conversations_in_reply_order(frame.where("false")).isEmpty()


def test_quotes_of_lines_and_short_messages(spark):
    texts = ["Hello Bob,\n\nI liked the talk.", "> I liked the talk.\nMe too.", "- buy some apples\n- sell some pears", "> - sell some pears\nWhy pears",
             "Why?", "> Why?\nBecause.", "First half of it\n> - buy some apples\nsecond half of it", "> second half of it\nYes."]
    rows = [(1, k, "a", t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = {r.turn: r.parent for r in conversations_in_reply_order(frame).collect()}
    assert found == {0: None, 1: 0, 2: None, 3: 2, 4: None, 5: 4, 6: 2, 7: 6}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    text, item = prose(60), prose(30)
    rows = [(1, text), (2, text), (3, prose(20) + " x@y.org " + prose(20)), (4, f"{prose(10)} {item}"), (5, "short"), (6, None)]
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(found) == {1, 3}
    from tokenizers import Tokenizer

    masked = rows[2][1].replace("x@y.org", "[EMAIL]")
    ids = Tokenizer.from_str(tokenizer()).encode(masked, add_special_tokens=False).ids
    assert found[3].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_word_ids_equal_those_of_single_words():
    plain = loaded(tokenizer())
    odd = ["\x01", "a\x01b", "\u0301e", "\u00a0", "<|endoftext|>x", "e\u0301", "H\u0331", "don't", "a"] * 5
    for words in (odd, [w for w in odd if "\x01" not in w], []):
        want = [plain.encode(w, add_special_tokens=False).ids for w in words]
        ids, sizes = word_ids(plain, [w.encode() for w in words])
        assert ids.tolist() == [i for w in want for i in w]
        assert sizes.tolist() == [len(w) for w in want]


def test_decontamination_of_very_long_runs(spark):
    """Runs of names, parts of numbers and an item that would each overflow a matcher that recurses."""
    names, number = " ".join(["Anna Berg"] * 10_000), ".".join(["12"] * 14_000)
    item = prose(6_000) + " " + " ".join(["Tom Long"] * 2_000)
    rows = [(1, f"{prose(30)} {names} end"), (2, f"{prose(30)} {number} km"), (3, f"{prose(50)} {item} {prose(50)}"), (4, prose(40)), (5, names), (6, number)]
    items = spark.createDataFrame([(0, item), (1, number)], "item_id bigint, text string")
    frame = docs_of(spark, rows)
    assert (3, 0) in {(r.doc, r.item) for r in contained_items(frame, items).collect()}
    kept = {r.doc_id for r in without_contained(frame, items).collect()}
    assert 3 not in kept and 4 in kept
