"""Fingerprints of groups, and what changed between two snapshots.

Two snapshots of a large table are compared by trees of fingerprints: a leaf stands for a
range of keys, a node for its leaves. A node's fingerprint is the sum of its rows'
digests, so a tree is one aggregation, made when a snapshot is written, and upper nodes
are sums of leaves. Two trees are compared from the top down; only ranges whose leaves
differ are read again, and compared key by key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.functions.digests import byte_hash, json_value
from tablepact.sources.pruning import with_partition_bounds

# A digest is cut into limbs, whose sums make up a group's fold.
LIMBS, LIMB_DIGITS = 13, 5
#: Differing leaves that are looked at one by one, and runs of them that become conditions.
MOST_LEAVES, MOST_RUNS = 100_000, 64
#: Partitions that a table laid out by ranges of keys has at most; each costs a folder, a file and a catalog entry.
MOST_PARTITIONS = 64


def _limbs(digest: Expr) -> list[Expr]:
    """The limbs of a hex digest; three of them are parsed at a time."""
    words = [F.conv(F.substring(digest, 1 + at, 15), 16, 10).cast("bigint") for at in range(0, 64, 15)]
    mask = F.lit(16**LIMB_DIGITS - 1)
    split = [F.shiftright(w, bits).bitwiseAND(mask) for w in words[:-1] for bits in (40, 20, 0)]
    return [*split, words[-1]]


def _digest_sums(rows: DataFrame, by: Sequence[str], digest: str) -> DataFrame:
    """Number of members and sums of limbs by group: bigints, which overflow from 2 ** 43 members on, with an error."""
    cut = rows.select(*by, digest, F.array(*_limbs(F.col(digest))).alias("limbs"))
    return cut.groupBy(*by).agg(F.count(digest).alias("members"), *[F.sum(F.col("limbs")[i]).alias(f"s{i}") for i in range(LIMBS)])


def group_fold(df: DataFrame, keys: Sequence[str], member: Expr) -> DataFrame:
    """Fingerprint of each group that does not depend on the order of its members.

    SHA-256 over the number of members and, for each limb of their SHA-256 digests, the
    sum over all members; ``""`` for a group without any. The sums merge, so a group of
    any size is one partial aggregation and one exchange, and its state has constant size.
    """
    names = [f"__pact_key_{i}" for i in range(len(keys))]
    digests = df.select(*[F.col(_quoted(key)).alias(n) for key, n in zip(keys, names)], byte_hash(member).alias("__pact_digest"))
    sums = _digest_sums(digests, names, "__pact_digest")
    listed = F.concat_ws(",", "members", *[F.col(f"s{i}").cast("string") for i in range(LIMBS)])
    return sums.select(
        *[F.col(n).alias(key) for key, n in zip(keys, names)], "members",
        F.when(F.col("members") == 0, "").otherwise(byte_hash(listed)).alias("fold"))


def array_fold(members: Expr) -> Expr:
    """Fingerprint of an array's members in any order: SHA-256 over their sorted hex digests."""
    digests = F.transform(F.filter(members, lambda m: m.isNotNull()), byte_hash)
    return F.when(F.size(digests) == 0, "").otherwise(byte_hash(F.array_join(F.sort_array(digests), "")))


def snapshot_changes(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Each key with ``added``, ``removed``, ``changed`` or ``unchanged``.

    Only keys and fingerprints are shuffled. Rows that share a key are compared as
    a multiset of fingerprints: counted, never paired. Columns of either side count;
    where only one side has a column, all keys that stay have changed.
    """
    by = [F.col(_quoted(key)) for key in keys]
    compared = list(columns) if columns is not None else [
        c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys
    ]
    if unknown := set(compared) - {*old.columns, *new.columns}:
        raise ValueError(f"neither snapshot has the columns {sorted(unknown)}")

    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*by, _mark(df, compared).alias("mark"), F.lit(sign).cast("bigint").alias("sign"))

    marks = side(old, -1).unionByName(side(new, 1)).groupBy(*by, "mark").agg(
        F.sum("sign").alias("surplus"),
        F.bool_or(F.col("sign") < 0).alias("was"),
        F.bool_or(F.col("sign") > 0).alias("is"),
    )
    found = marks.groupBy(*by).agg(
        F.bool_or("was").alias("was"),
        F.bool_or("is").alias("is"),
        F.bool_or(F.col("surplus") != 0).alias("differs"),
    )
    status = (
        F.when(~F.col("was"), "added").when(~F.col("is"), "removed")
        .when(F.col("differs"), "changed").otherwise("unchanged")
    )
    return found.select(*by, status.alias("status"))


def _mark(df: DataFrame, columns: Sequence[str]) -> Expr:
    """Digest of a row's values under the names of those columns that it has.

    A value is written with its length before it, so no two rows of values look alike;
    texts go in as they are.
    """
    parts = []
    for field in sorted((f for f in df.schema.fields if f.name in columns), key=lambda f: f.name):
        value = F.col(_quoted(field.name))
        plain = isinstance(field.dataType, (T.StringType, T.BooleanType, T.IntegralType, T.DateType))
        text = value.cast("string") if plain else json_value(value, field.dataType)
        parts.append(F.concat(F.lit(f"{len(field.name)}:{field.name}"), F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))))
    return F.unhex(byte_hash(F.concat(F.lit(""), *parts)))


# -- trees ----------------------------------------------------------------------


@dataclass(frozen=True)
class Ranges:
    """Leaves of ``width`` values of an integer key each; ``fanout`` nodes make up one of the next of ``levels``."""

    key: str
    width: int
    fanout: int = 64
    levels: int = 4

    def leaf(self) -> Expr:
        return _floor_div(F.col(_quoted(self.key)).cast("bigint"), self.width)


def partition_width(df: DataFrame, ranges: Ranges) -> int:
    """Values of the key in a partition: whole leaves, twice as many until the keys fill at most ``MOST_PARTITIONS``.

    The number of partitions does not grow with the table then, only the rows in each. A
    leaf never lies in two partitions.
    """
    key = F.col(_quoted(ranges.key)).cast("bigint")
    low, high = df.agg(F.min(key), F.max(key)).first()
    width = ranges.width
    while low is not None and high // width - low // width >= MOST_PARTITIONS:
        width *= 2
    return width


def _floor_div(value: Expr, width: int) -> Expr:
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))


def fold_tree(df: DataFrame, ranges: Ranges, columns: Sequence[str] | None = None) -> DataFrame:
    """``level, node, members`` and sums of digests for each range of keys and each node above.

    Rows without a key are a node of their own at every level.
    """
    compared = list(columns) if columns is not None else list(df.columns)
    rows = df.select(ranges.leaf().alias("node"), F.hex(_mark(df, list(dict.fromkeys([ranges.key, *compared])))).alias("digest"))
    sums = ["members", *[f"s{i}" for i in range(LIMBS)]]
    leaves = _digest_sums(rows, ["node"], "digest")
    above = F.explode(F.array(*[
        F.struct(F.lit(k).alias("level"), _floor_div(F.col("node"), ranges.fanout**k).alias("node")) for k in range(ranges.levels)]))
    return leaves.select(above.alias("n"), *sums).groupBy(F.col("n.level").alias("level"), F.col("n.node").alias("node")).agg(
        *[F.sum(c).alias(c) for c in sums])


def differing_leaves(old: DataFrame, new: DataFrame, ranges: Ranges) -> DataFrame:
    """The leaves in which two trees differ; below nodes that agree nothing is looked at."""
    sums = ["members", *[f"s{i}" for i in range(LIMBS)]]
    signed = old.select("level", "node", *sums).union(new.select("level", "node", *[(-F.col(c)).alias(c) for c in sums]))
    apart = F.lit(False)
    for c in sums:
        apart = apart | (F.sum(c) != 0)
    found = None
    for level in reversed(range(ranges.levels)):
        rows = signed.where(F.col("level") == level)
        if found is not None:
            parents = found.select(F.col("node").alias("parent"))
            rows = rows.join(parents, _floor_div(F.col("node"), ranges.fanout).eqNullSafe(F.col("parent")), "left_semi")
        found = rows.groupBy("node").agg(apart.alias("apart")).where("apart").select("node")
    return found


def changed_keys(
    old: DataFrame, new: DataFrame, keys: Sequence[str], ranges: Ranges, old_tree: DataFrame, new_tree: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """Each key that was ``added``, ``removed`` or ``changed``, as ``snapshot_changes`` tells them.

    The trees are those of the snapshots, by ``fold_tree`` with the same ranges and
    columns, as a rule read from where they were written. Of the snapshots only ranges of
    keys whose leaves differ are read: where they are partitioned by such ranges, only
    these partitions. Far more than ``MOST_RUNS`` runs of ranges are joined to wider ones,
    which costs reading and changes nothing else.
    """
    if ranges.key not in keys:
        raise ValueError(f"ranges of {ranges.key!r} need it among the keys {list(keys)}")
    leaves = [r.node for r in differing_leaves(old_tree, new_tree, ranges).limit(MOST_LEAVES + 1).collect()]
    key = F.col(_quoted(ranges.key))
    if len(leaves) <= MOST_LEAVES:
        inside = F.lit(False)
        for first, last in _runs(sorted(n for n in leaves if n is not None)):
            inside = inside | ((key >= F.lit(first * ranges.width)) & (key <= F.lit((last + 1) * ranges.width - 1)))
        if None in leaves:
            inside = inside | key.isNull()
        old, new = (with_partition_bounds(df.sparkSession, df.where(inside)) for df in (old, new))
    return snapshot_changes(old, new, keys, columns).where("status <> 'unchanged'")


def _runs(leaves: Sequence[int]) -> list[tuple[int, int]]:
    """Leaves that follow one another as runs, the closest joined until they are few."""
    gaps = sorted(((b - a, i) for i, (a, b) in enumerate(zip(leaves, leaves[1:])) if b - a > 1), reverse=True)[:MOST_RUNS - 1]
    cuts = sorted(i + 1 for _, i in gaps)
    return [(leaves[a], leaves[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(leaves)]) if b > a]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
