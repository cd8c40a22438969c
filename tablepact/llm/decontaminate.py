"""Benchmark passages in documents, also with other numbers, names and units.

Texts are made canonical: numbers, units after a number, and runs of capitalised words
inside a sentence become typed placeholders, each a token of its own; the rest is lower
case without punctuation. Documents are joined with the benchmark on hashes of windows
of ``WIDTH`` canonical tokens. Where an item lies in a document, its windows match at
one offset; per offset the slots are then compared: an item's value must stand for one
value of the document throughout, in at least ``CONSISTENT`` of the values, as it does
when somebody has changed the parameters of a question, and as it does not when two
texts merely share a form. A document holds an item if windows at consistent offsets
cover at least ``COVERED`` of the item's windows, or a run of ``RUN`` tokens at one
offset. An item is looked for in the form that it has by itself and in that after another
word, where its capitalised first word counts as a name.

Items of fewer than ``WIDTH`` tokens, but at least ``SHORTEST``, are one window of their
own length. Windows with fewer than ``LITERAL`` tokens that are not placeholders are too
common to tell anything. Shorter items, and those that have no other windows, are
compared by their words and numbers as they are; a single word matches nothing, and so
does an item without an id. A null text is empty; equal rows are found alike; a null ``doc_id`` is an id like any other. Characters
U+E000 to U+E002 in a text count as placeholders. Other columns are not looked at. An item
that repeats one stretch over and over matches a document that does the same at every
pair of places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablepact.llm.common import free_name, materialized, text_of, words_of

WIDTH = 8
SHORTEST = 5
LITERAL = 4
COVERED = 0.5
CONSISTENT = 0.8
RUN = 13
#: An item by itself, after another word, and with its words and numbers as they are.
ALONE, INSIDE, PLAIN = range(3)

# Placeholders and what they stand for.
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
# Groups that repeat never give back what they took: the matcher would go one call deeper for each repetition.
NUMBERS = "[0-9]++(?:[.,:/][0-9]++)*+"
UNITS = (
    "(" + NUMBER + " +)(kilometers|kilometres|kilograms|centimeters|centimetres|meters|metres|grams|liters|litres|"
    "hours|hour|minutes|minute|seconds|days|day|weeks|months|years|dollars|euros|cents|percent|miles|feet|inches|"
    "pounds|degrees|km|kg|cm|mm|ml|mg|lb|oz|ft|mph|[%$€£])"
)
NAMES = r"([\p{L}\p{N}" + NUMBER + UNIT + r",;] +)\p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)*+"


def _numbered(text: Column) -> Column:
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, NUMBERS, f" {NUMBER} ")).otherwise(text)


def _with_units(text: Column) -> Column:
    return F.when(text.contains(NUMBER), F.regexp_replace(text, UNITS, f"$1 {UNIT} ")).otherwise(text)


def canonical(text: Column) -> Column:
    """The text with placeholders, in lower case, without punctuation."""
    named = F.regexp_replace(_with_units(_numbered(text)), NAMES, f"$1 {NAME} ")
    return F.regexp_replace(F.lower(named), rf"[^\p{{L}}\p{{N}}{NUMBER}{NAME}{UNIT}\x20\x09-\x0D]+", "")


def _plain_words(text: Column) -> Column:
    """Words and numbers in lower case, without punctuation."""
    return words_of(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\x20\x09-\x0D]+", ""))


def _slot_values(text: Column) -> dict[str, Column]:
    """The values of each kind in the order of their placeholders."""
    numbered = _numbered(text)
    with_units = _with_units(numbered)
    return {
        NUMBER: F.regexp_extract_all(text, F.lit(f"({NUMBERS}|{NUMBER})"), F.lit(1)),
        UNIT: F.transform(F.regexp_extract_all(numbered, F.lit(f"{UNITS}|({UNIT})"), F.lit(2)), F.lower),
        NAME: F.transform(
            F.regexp_extract_all(with_units, F.lit(f"{NAMES}|{NAME}"), F.lit(0)),
            lambda v: F.lower(F.regexp_extract(v, r"\p{Lu}.*$", 0))),
    }


def _window_hash(tokens: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(tokens, at + k) for k in range(width)])


def _forms(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """Items with the forms in which placeholders count; that inside a text has a word before it, to be left out."""
    items = benchmark.select(F.col(key).alias("_item"), text_of(text).alias("_text"))
    alone = items.withColumn("_form", F.lit(ALONE))
    inside = items.select("_item", F.concat(F.lit("a "), "_text").alias("_text"), F.lit(INSIDE).alias("_form"))
    return alone.select("_item", "_text", "_form").union(inside)


def _benchmark_windows(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """Windows of all items: form, width, hash, item, position, number of the item's windows in that form."""
    tokens = F.col("_tokens")
    known = words_of(canonical(F.col("_text")))
    items = _forms(benchmark, key, text).select(
        "_item", "_form", F.when(F.col("_form") == INSIDE, F.slice(known, F.lit(2), F.size(known))).otherwise(known).alias("_tokens"))

    def placed(items: DataFrame) -> DataFrame:
        sized = items.withColumn("_width", F.least(F.lit(WIDTH), F.size(tokens)))
        return sized.select("_item", "_form", "_tokens", "_width", F.explode(F.sequence(F.lit(0), F.size(tokens) - F.col("_width"))).alias("_at"))

    literal = F.size(F.filter(F.slice(tokens, F.col("_at") + 1, F.col("_width")),
                              lambda t: ~t.isin(NUMBER, NAME, UNIT)))
    own_hash = reduce(
        lambda rest, w: F.when(F.col("_width") == w, _window_hash(tokens, F.col("_at"), w)).otherwise(rest),
        range(2, WIDTH + 1), F.lit(None).cast("bigint"))
    columns = ["_item", "_form", "_width", "_at", own_hash.alias("_hash")]
    typed = placed(items.where(F.size(tokens) >= SHORTEST)).where(literal >= LITERAL).select(*columns)
    told = typed.where(F.col("_form") == ALONE).select("_item").distinct()
    rest = benchmark.select(F.col(key).alias("_item"), F.lit(PLAIN).alias("_form"), _plain_words(text_of(text)).alias("_tokens"))
    plain = placed(rest.join(told, "_item", "left_anti").where(F.size(tokens) >= 2)).select(*columns)
    windows = typed.union(plain)
    counted = windows.groupBy("_item", "_form").agg(F.count_distinct("_at").alias("_of"))
    return windows.distinct().join(counted, ["_item", "_form"]).withColumn("_plain", F.col("_form") == PLAIN)


def _slots(frame: DataFrame, text: Column, *keys: str) -> DataFrame:
    """A row per placeholder: keys, position among the canonical tokens, kind, value."""
    tokens, values = free_name(frame, "_tokens"), free_name(frame, "_values")
    held = frame.withColumns({
        tokens: F.transform(words_of(canonical(text)), lambda t, i: F.struct(i.alias("at"), t.alias("token"))),
        values: F.struct(*[v.alias(f"v{k}") for k, v in enumerate(_slot_values(text).values())]),
    })
    kinds = list(_slot_values(text))

    def of_kind(k: int) -> Column:
        places = F.filter(F.col(tokens), lambda t: t["token"] == kinds[k])
        return F.transform(
            F.arrays_zip(places.alias("t"), F.col(values)[f"v{k}"].alias("v")),
            lambda z: F.struct(z["t"]["at"].alias("at"), F.lit(k).alias("kind"), z["v"].alias("value")))

    zipped = F.concat(*map(of_kind, range(len(kinds))))
    return held.select(*keys, F.inline_outer(zipped).alias("_slot_at", "_kind", "_value")).where("_slot_at is not null")


def contained_items(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text",
                    item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document and item that it holds.

    ``doc, doc_print, item``: ``doc_print`` hashes id and text, so rows that share an
    id stay apart. ``n_windows`` of ``item_windows`` matched; ``n_slots`` slots compared,
    ``n_changed`` of them with another value than the item's; ``copies`` equal rows.
    """
    windows = materialized(_benchmark_windows(benchmark, item_key, item_text), "benchmark-windows")
    widths = sorted(tuple(r) for r in windows.select("_plain", "_width").distinct().collect())  # at most 11 values
    source = docs.select(F.col(key).alias("_doc"), text_of(text).alias("_text"))
    source = source.select("_doc", "_text", F.xxhash64("_doc", "_text").alias("_print"))
    plain = _plain_words(F.col("_text")) if any(p for p, _ in widths) else F.lit(None).cast("array<string>")
    tokenized = source.select("_doc", "_print", words_of(canonical(F.col("_text"))).alias("_tokens"), plain.alias("_plain_tokens"))

    def of_width(kind: tuple[bool, int]) -> Column:
        as_is, w = kind
        tokens = F.col("_plain_tokens" if as_is else "_tokens")
        return F.when(F.size(tokens) >= w, F.transform(
            F.sequence(F.lit(0), F.size(tokens) - w),
            lambda i: F.struct(F.lit(as_is).alias("_plain"), F.lit(w).alias("_width"), i.alias("_at"), _window_hash(tokens, i, w).alias("_hash")),
        )).otherwise(nothing)

    nothing = F.array().cast("array<struct<_plain:boolean,_width:int,_at:int,_hash:bigint>>")
    hashed = tokenized.select("_doc", "_print", F.concat(nothing, *map(of_width, widths)).alias("_windows"))
    # Not inline(): the optimizer would test each array for rows before, and so make it twice.
    spread = hashed.select("_doc", "_print", F.inline_outer("_windows").alias("_plain", "_width", "_doc_at", "_hash"))
    matches = materialized(
        spread.join(windows.withColumnRenamed("_at", "_item_at"), ["_plain", "_width", "_hash"])
        .groupBy("_doc", "_print", "_item", "_form", "_item_at", "_doc_at", "_width", "_of").agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_shift", F.col("_doc_at") - F.col("_item_at")),
        "benchmark-matches",
    )
    pair = ["_print", "_item", "_form"]
    # Slots of matched windows only: first the item's, then the document's at the same offset.
    item_slots = _slots(_forms(benchmark, item_key, item_text), F.col("_text"), "_item", "_form").withColumn(
        "_slot_at", F.col("_slot_at") - F.when(F.col("_form") == INSIDE, 1).otherwise(0)).distinct()
    inside = F.col("_slot_at").between(F.col("_item_at"), F.col("_item_at") + F.col("_width") - 1)
    wanted = materialized(
        matches.join(item_slots.withColumnRenamed("_value", "_item_value"), ["_item", "_form"]).where(inside)
        .select(*pair, "_shift", (F.col("_slot_at") + F.col("_shift")).alias("_slot_at"), "_kind", "_item_value").distinct(),
        "benchmark-slots",
    )
    holders = source.join(wanted.select("_print").distinct(), "_print", "left_semi")
    doc_slots = _slots(holders, F.col("_text"), "_print").distinct().withColumnRenamed("_value", "_doc_value")
    by_value = (
        wanted.join(doc_slots, ["_print", "_slot_at", "_kind"])
        .groupBy(*pair, "_shift", "_kind", "_item_value").agg(
            F.count_distinct("_doc_value").alias("_values"), F.count(F.lit(1)).alias("_slots"),
            F.count_if(F.lower("_doc_value") != F.lower("_item_value")).alias("_changed"))
    )
    by_shift = materialized(by_value.groupBy(*pair, "_shift").agg(
        F.sum("_slots").alias("_slots"), F.sum("_changed").alias("_changed"),
        (F.count_if(F.col("_values") == 1) >= CONSISTENT * F.count(F.lit(1))).alias("_consistent"),
    ), "benchmark-offsets")
    refuted = by_shift.where(~F.col("_consistent")).select(*pair, "_shift")
    left = matches.join(refuted, [*pair, "_shift"], "left_anti")
    # Windows one after the other at one offset are a run; an offset has no more windows than the item.
    at_offset = Window.partitionBy("_doc", *pair, "_shift").orderBy("_item_at")
    of_run = Window.partitionBy("_doc", *pair, "_shift", "_run")
    runs = left.withColumn("_run", F.col("_item_at") - F.dense_rank().over(at_offset)).withColumn(
        "_length", F.max("_item_at").over(of_run) - F.min("_item_at").over(of_run) + F.col("_width"))
    share = F.col("n_windows") >= COVERED * F.col("item_windows")
    covered = (
        runs.groupBy("_doc", *pair)
        .agg(F.count_distinct("_item_at").alias("n_windows"), F.max("_of").alias("item_windows"), F.max("_copies").alias("copies"),
             F.max("_length").alias("_longest"))
        .where(share | (F.col("_longest") >= RUN))
    )
    # One form of an item: the first that has the share, else the first that has the run.
    best = F.min_by(F.struct("_form", "n_windows", "item_windows", "copies"), F.struct(~share, F.col("_form")))
    covered = covered.groupBy("_doc", "_print", "_item").agg(best.alias("_best")).select("_doc", "_print", "_item", "_best.*")
    compared = by_shift.where("_consistent").groupBy(*pair).agg(
        F.sum("_slots").alias("n_slots"), F.sum("_changed").alias("n_changed"))
    return covered.join(compared, pair, "left").select(
        F.col("_doc").alias("doc"), F.col("_print").alias("doc_print"), F.col("_item").alias("item"), "n_windows", "item_windows",
        F.coalesce("n_slots", F.lit(0)).cast("bigint").alias("n_slots"),
        F.coalesce("n_changed", F.lit(0)).cast("bigint").alias("n_changed"), "copies")


def without_contained(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text",
                      item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no item, all columns as they are."""
    found = contained_items(docs, benchmark, key=key, text=text, item_key=item_key, item_text=item_text)
    bad = materialized(found.select(F.col("doc").alias("_bad"), F.col("doc_print").alias("_bad_print")).distinct(), "benchmark-bad")
    own = F.xxhash64(F.col(key), text_of(text))
    return docs.join(bad, docs[key].eqNullSafe(bad["_bad"]) & (own == bad["_bad_print"]), "left_anti")
