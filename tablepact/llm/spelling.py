"""Spelling variants: words one edit apart, by composing finite-state machines.

Two words are near if they differ by one inserted, deleted or replaced code point. The
near pairs are what ``A o E o A`` accepts, where ``A`` is the minimised acceptor of the
vocabulary and ``E`` the transducer that makes one edit. A state of the composition is a
state of each acceptor and whether the edit has been made. Before the edit both acceptors
are in the same state; the machines are composed part by part: a part holds all words
that agree before some place and after another, so that its pairs start from the state
that the shared beginning leads to, and the edit lies in between.

Every pair is found in one part. Its class is the length of the longer word; its place is
that of the first code point that differs. A word goes to the classes of its own length
and of the next, and there to two parts, one for an edit in either half; the other half
is shared. A part with more than ``MOST`` words is cut again at the middle of the free
stretch, which adds half of it to what is shared, until the stretch is one code point,
where a part has no more words than the alphabet letters. So no key gathers without
bound, and a word is a small number of rows.

A task reads its parts sorted, one after the other, and gives for each word of a part how
many near words the part has and the most frequent of them; the sums over a word's parts
are one aggregation.

Edge cases: a null text has no words. Rows with equal id and text count as often as they
occur. A null id counts as an empty text where words are altered by id. Words of any
length are compared whole. Ties among near words go to the smallest in code-point order.
An empty table gives no rows. Columns that are not asked for may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepact.llm.common import materialized

#: Words of a part from which it is cut.
MOST = 20_000
# The letters of a word.
LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, OCCURRENCES = 7, 2
#: One form of a word is that much more frequent, at least.
RATIO = 10


def vocabulary(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST,
               occurrences: int = OCCURRENCES, altered: int | None = None) -> DataFrame:
    """``word, n``: maximal runs of letters, A-Z in lower case.

    ``altered``: where the crc32 of id, colon and run is divisible by it, the run lacks
    the code point at that crc32 modulo its length.
    """
    # Runs that are shorter cannot become long enough, and stay behind here.
    runs = F.regexp_extract_all(F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                                F.lit(f"([{LETTERS}]{{{shortest},}})"), F.lit(1))
    named = docs.select(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":")).alias("name"), F.explode(runs).alias("run"))
    word = F.col("run")
    if altered:
        named = named.select("run", F.crc32(F.concat("name", "run").cast("binary")).alias("h"))
        at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
        less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substr(F.col("run"), at + 2))
        word = F.when(F.col("h") % altered == 0, less).otherwise(F.col("run"))
    words = named.select(word.alias("word")).where(F.char_length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= occurrences)


class Acceptor:
    """The minimal acceptor of some words, built from them in sorted order.

    ``arcs[s]`` are a state's arcs by symbol, ``final[s]`` says whether a word ends there.
    """

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        open_states: list[tuple[dict[str, int], list[bool]]] = [({}, [False])]
        last = ""
        for word in words:
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            self._close(open_states, last, shared)
            open_states.extend(({}, [False]) for _ in range(len(word) - shared))
            open_states[-1][1][0] = True
            last = word
        self._close(open_states, last, 0)
        self.start = self._registered(*open_states[0])

    def _close(self, open_states: list, last: str, keep: int) -> None:
        for depth in range(len(last), keep, -1):
            arcs, final = open_states.pop()
            open_states[-1][0][last[depth - 1]] = self._registered(arcs, final)

    def _registered(self, arcs: dict[str, int], final: list[bool]) -> int:
        mark = (final[0], *arcs.items())  # arcs are met in sorted order
        state = self._known.get(mark)
        if state is None:
            state = self._known[mark] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final[0])
        return state


def common(acceptor: Acceptor, p: int, q: int, known: dict[tuple[int, int], tuple[str, ...]]) -> tuple[str, ...]:
    """The words that both states accept, when the edit has been made."""
    stack = [(p, q)]
    while stack:
        pair = stack[-1]
        if pair in known:
            stack.pop()
            continue
        one, two = acceptor.arcs[pair[0]], acceptor.arcs[pair[1]]
        both = [(s, (t, two[s])) for s, t in one.items() if s in two]
        open_pairs = [x for _, x in both if x not in known]
        if open_pairs:
            stack.extend(open_pairs)
            continue
        own = ("",) if acceptor.final[pair[0]] and acceptor.final[pair[1]] else ()
        known[pair] = own + tuple(s + rest for s, x in both for rest in known[x])
        stack.pop()
    return known[p, q]


def near_pairs(words: list[str], after: str, length: int) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart among sorted words that are all followed by ``after``.

    The longer word of a pair has ``length`` code points. A pair whose words differ only
    from ``after`` on belongs to another part.
    """
    acceptor = Acceptor(words)
    arcs, known = acceptor.arcs, {}
    reached = [("", acceptor.start)]
    while reached:
        begin, state = reached.pop()
        ways = list(arcs[state].items())
        if len(begin) < length - 1:
            reached.extend((begin + s, t) for s, t in ways)
        for i, (s, t) in enumerate(ways):
            for s2, t2 in ways[i + 1:]:  # one replaced: both words are of the full length
                if t == t2 or not arcs[t].keys().isdisjoint(arcs[t2]) or acceptor.final[t] and acceptor.final[t2]:
                    for rest in common(acceptor, t, t2, known):
                        if len(begin) + 1 + len(rest) == length:
                            yield begin + s + rest, begin + s2 + rest
            # One inserted: the next symbol differs, else the place would be further on.
            if acceptor.final[t] and acceptor.final[state] and s != after and len(begin) + 1 == length:
                yield begin + s, begin
            if not arcs[t].keys().isdisjoint(arcs[state]):
                for rest in common(acceptor, t, state, known):
                    if rest and rest[0] != s and len(begin) + 1 + len(rest) == length:
                        yield begin + s + rest, begin + rest


def _parts(words: DataFrame) -> DataFrame:
    """Each word in the parts that it is in: class, free stretch, what is shared, the free code points."""
    size = F.char_length("word")
    classes = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("class"))
    return _halved(classes.withColumns({"low": F.lit(0), "high": F.col("class")}))


def _halved(frame: DataFrame) -> DataFrame:
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.explode(F.array(
        F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high")))).alias("h")
    cut = frame.select("word", "n", "class", halves).select("word", "n", "class", F.col("h.low").alias("low"), F.col("h.high").alias("high"))
    tail = F.col("class") - F.col("high")
    return cut.select(
        "word", "n", "class", "low", "high", F.substring(F.col("word"), F.lit(1), F.col("low")).alias("before"),
        F.substr(F.col("word"), F.char_length("word") - tail + 1, tail).alias("after"),
        F.substr(F.col("word"), F.col("low") + 1, F.char_length("word") - tail - F.col("low")).alias("free"))


def near_counts(words: DataFrame, most: int = MOST) -> DataFrame:
    """``word, n, n_near, best_n, best``: near words, and the most frequent of them."""
    words = materialized(words, "vocabulary")
    part = ["class", "low", "high", "before", "after"]
    parts, done = _parts(words), []
    while True:
        counts = parts.groupBy(*part).agg(F.count(F.lit(1)).alias("words"))
        large = materialized(counts.where((F.col("words") > most) & (F.col("high") - F.col("low") > 1)).select(*part), "large-parts")
        if large.isEmpty():
            done.append(parts)
            break
        done.append(parts.join(large, part, "left_anti"))
        parts = _halved(materialized(parts.join(large, part, "left_semi"), "cut-parts"))
    dealt = done[0]
    for more in done[1:]:
        dealt = dealt.unionByName(more)
    dealt = dealt.select(*part, "free", "n").repartition(*part).sortWithinPartitions(*part, "free")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, free, counts = None, [], []
        out: list[tuple[str, int, int, str]] = []

        def settle() -> None:
            if len(free) < 2:
                return
            _, low, high, before, after = at
            n = dict(zip(free, counts))
            near: dict[str, list] = {}
            for pair in near_pairs(free, after[:1], high - low):
                for a, b in (pair, pair[::-1]):
                    told = near.get(a)
                    if told is None:
                        near[a] = [1, -n[b], b]
                    else:
                        told[0] += 1
                        if (-n[b], b) < (told[1], told[2]):
                            told[1:] = -n[b], b
            out.extend((before + a + after, count, -less, before + b + after) for a, (count, less, b) in near.items())

        def written() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*out)] if out else [[], [], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                              names=["word", "n_near", "best_n", "best"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *key, word, n in zip(*columns):
                if key != at:
                    settle()
                    at, free, counts = key, [], []
                    if len(out) > 20_000:
                        yield written()
                free.append(word)
                counts.append(n)
        settle()
        yield written()

    found = dealt.mapInArrow(compose, "word string, n_near bigint, best_n bigint, best string")
    nothing = F.lit(None)
    every = words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), nothing.cast("bigint").alias("best_n"), nothing.cast("string").alias("best"))
    summed = every.unionByName(found.withColumn("n", nothing.cast("bigint"))).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("n_near").alias("n_near"),
        F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))).alias("b"))
    return summed.select("word", "n", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def _rooted(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: forms are followed to the last, in steps that double."""
    links = materialized(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = materialized(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        links = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return links


def variant_groups(words: DataFrame, *, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of each word of a vocabulary.

    A form is the most frequent near word, if it is ``ratio`` times as frequent at least;
    the root is where a word's forms end. Frequencies grow by that factor at each step,
    so forms never run in a circle, and there are few of them in a row.
    """
    is_form: Column = F.col("best_n") >= ratio * F.col("n")
    counted = materialized(near_counts(words, most), "near-words").select(
        "word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    roots = _rooted(counted.where(F.col("form").isNotNull()))
    return counted.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
