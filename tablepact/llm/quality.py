"""Quality rules with cutoffs that carry a guarantee on false rejections.

Each rule rejects a document whose measure is above a cutoff. Cutoffs are selected on
a labelled holdout, by stratum: a cutoff counts as certified when the exact binomial
tail of the good documents that it rejects, ``P(Bin(n, risk) <= k)``, is at most the
test level. Within one rule and stratum the cutoffs are tested from the most lenient
one on until one fails (a fixed sequence, which needs no correction); over rules and
strata the level is divided by their number (Bonferroni). So with probability of at
least ``1 - error`` no rule, in no stratum, rejects more than its risk of the good
documents, and all rules together at most ``Limits.risk``. Of the certified cutoffs
the one is taken that rejects most bad documents, where each good one rejected counts
as ``price`` bad ones; a rule without gain stays off, and so does every rule in a
stratum with too few labels to certify anything.

Edge cases: a null text is empty, and like every text with under ten words it fails
the base rules. A null stratum is a stratum of its own. A label that is null does not
count; where a document has several labels, it counts as good if any says so. Without
labels, only the base rules decide. Repeated rows are judged one by one. Columns that
are not asked for may have any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepact.llm.common import free_name, materialized, text_of, windows_of, words_of

#: Window of words whose repetition within a text counts.
WINDOW = 5

#: For each rule its candidate cutoffs, from the most lenient to the strictest.
CUTOFFS: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (2.0, 1.5, 1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1),
    "dup_line_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2),
    "chars_per_word": (20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.0),
}


@dataclass(frozen=True)
class Limits:
    """``risk``: share of good documents all rules may reject in a stratum;
    ``error``: probability with which that may not hold; ``price``: bad documents
    that one good document is worth when a certified cutoff is chosen."""

    risk: float = 0.05
    error: float = 0.05
    price: float = 100.0


def with_measures(docs: DataFrame, text: str, into: str) -> DataFrame:
    """The frame with a struct of measures of each whole text; the text stays."""
    words, hashes, order, places, other = (free_name(docs, f"_{x}") for x in ("w", "h", "o", "p", "m"))
    source = text_of(text)
    lines = F.filter(F.split(source, "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    step = docs.withColumn(words, words_of(source))
    step = step.withColumns({
        other: F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            F.length(F.regexp_replace(source, "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
            F.size(lines).cast("bigint").alias("n_lines"),
            F.size(F.array_distinct(lines)).cast("bigint").alias("n_own_lines"),
        ),
        hashes: windows_of(F.col(words), WINDOW),
    }).drop(words)
    # Only a text that has a window twice needs the order of its windows.
    step = step.withColumn(
        order,
        F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes),
            F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop(hashes)
    step = step.withColumn(
        places,
        F.sort_array(F.filter(
            F.transform(order, lambda x, k: F.when(
                x["h"].eqNullSafe(F.get(order, k - 1)["h"]) | x["h"].eqNullSafe(F.get(order, k + 1)["h"]),
                x["i"],
            )),
            lambda i: i.isNotNull(),
        )),
    ).drop(order)
    covered = F.aggregate(
        F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("bigint"), lambda total, n: total + n,
    )
    m = F.col(other)
    return step.withColumn(into, F.struct(
        m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"),
        m["n_lines"].alias("n_lines"), (m["n_lines"] - m["n_own_lines"]).alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("bigint")).alias("n_repeat_words"),
    )).drop(places, other)


def base_failed(measures: Column) -> Column:
    return (measures["n_words"] < 10) | (100 * measures["n_repeat_words"] > 20 * measures["n_words"])


def rule_values(measures: Column) -> dict[str, Column]:
    """The measure that each rule compares with its cutoff."""

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(measures[a].cast("double"), measures[b].cast("double")), F.lit(0.0))

    return {
        "symbols_per_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "chars_per_word": share("word_chars", "n_words"),
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """Exact P(Bin(n, p) <= k) for k below n * p, else 1, which no test level reaches.

    The terms are summed relative to the last one, whose logarithm is carried along,
    so nothing underflows however many trials there are.
    """
    odds = F.lit(p / (1 - p))
    below = F.aggregate(
        F.when((k > 0) & (k < n * p), F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct((n * F.lit(math.log(1 - p))).alias("log_term"), F.lit(1.0).alias("rel")),
        lambda acc, i: F.struct(
            (acc["log_term"] + F.ln((n - i + 1) / i * odds)).alias("log_term"),
            (1.0 + acc["rel"] * (i / ((n - i + 1) * odds))).alias("rel"),
        ),
        lambda acc: F.exp(acc["log_term"]) * acc["rel"],
    )
    return F.when(k < n * p, below).otherwise(F.lit(1.0))


def fit_cutoffs(judged: DataFrame, labels: DataFrame, *, key: str, stratum: str, measures: str,
                label: str, limits: Limits = Limits()) -> DataFrame:
    """One row per stratum: the chosen cutoff of each rule, null where it stays off."""
    known = (
        labels.groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_good"))
        .where("_key is not null and _good is not null")
    )
    holdout = (
        judged.select(F.col(key).alias("_key"), F.col(stratum).alias("_stratum"), F.col(measures).alias("_m"))
        .where(~base_failed(F.col("_m"))).join(known, "_key")
    )
    values = rule_values(F.col("_m"))
    good, bad = F.col("_good") > 0, F.col("_good") <= 0
    counts = materialized(holdout.groupBy("_stratum").agg(
        F.count_if(good).alias("n"),
        *[F.array(*[F.struct(
            F.count_if(good & (values[rule] > cut)).alias("k"),
            F.count_if(bad & (values[rule] > cut)).alias("hits"),
        ) for cut in cuts]).alias(rule) for rule, cuts in CUTOFFS.items()],
    ), "quality-counts")
    risk = limits.risk / len(CUTOFFS)
    level = limits.error / (len(CUTOFFS) * max(1, counts.count()))

    def chosen(rule: str) -> Column:
        cuts = F.array(*[F.lit(c) for c in CUTOFFS[rule]])
        failed = F.transform(F.col(rule), lambda x: binomial_tail(x["k"], F.col("n"), risk) > level)
        first = F.array_position(failed, True)
        certified = F.when(first == 0, F.lit(len(CUTOFFS[rule]))).otherwise(first - 1).cast("int")
        gains = F.transform(
            F.slice(F.arrays_zip(F.col(rule).alias("c"), cuts.alias("cut")), F.lit(1), certified),
            lambda x: F.struct(
                (x["c"]["hits"] - limits.price * x["c"]["k"]).alias("gain"), x["cut"].alias("cut")),
        )
        best = F.array_max(F.filter(gains, lambda g: g["gain"] > 0))  # of equal gains the most lenient
        return best["cut"].alias(rule)

    return counts.select("_stratum", *[chosen(rule) for rule in CUTOFFS])


def judged_by_rules(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text",
                    stratum: str = "lang", label: str = "quality", keep_text: bool = True,
                    limits: Limits = Limits()) -> tuple[DataFrame, str, str]:
    """The documents with a struct of measures and the verdict, and those columns' names.

    The texts are read once: their measures go to a work table, from which both the
    cutoffs and the verdicts come. The cutoffs are one row per stratum; they are read
    back from a table, so Spark broadcasts them only below its own limit.
    """
    measures, kept = free_name(docs, "measures"), free_name(docs, "kept")
    measured = with_measures(docs, text, measures)
    measured = materialized(measured if keep_text else measured.drop(text), "quality")
    cutoffs = materialized(
        fit_cutoffs(measured, labels, key=key, stratum=stratum, measures=measures, label=label, limits=limits),
        "quality-cutoffs",
    )
    values = rule_values(F.col(measures))
    own = {rule: free_name(docs, f"_cut_{rule}") for rule in CUTOFFS}
    cut = cutoffs.select(F.col("_stratum").alias(free_name(docs, "_stratum")),
                         *[F.col(rule).alias(name) for rule, name in own.items()])
    joined = measured.join(cut, measured[stratum].eqNullSafe(cut[cut.columns[0]]), "left")
    rejected = F.lit(False)
    for rule, name in own.items():
        rejected |= F.coalesce(values[rule] > F.col(name), F.lit(False))
    verdict = ~base_failed(F.col(measures)) & ~rejected
    return joined.withColumn(kept, verdict).select(*measured.columns, kept), measures, kept
