"""Difference of two snapshots whose keys may have changed: counted order-statistic trees of each content, sharded by key range.

1. Equal keys pair. One aggregation by key, combined before it moves, puts the rows of a key side by side; only digests of the
   content and the columns to compare move, never the content.
2. The other rows go into trees, one for each side of each content. A range partitioning by (content, side, key) cuts them into
   shards, whose sorted rows are written with their addresses; a leaf is what a content's side has in one shard, with the address of
   its first row and its count. Most contents are one leaf; a giant one has as many leaves as shards, and inner nodes over FANOUT
   leaves each, whose counts give every leaf the number of keys before it.
3. rank: an earlier row's i is the count before its leaf plus its place in the leaf. select: the later tree's node of rank i names the
   leaf that holds it, and the address is that leaf's first plus what is left of i. Leaves of both trees are paired by the nodes of
   ranks that they reach into, so selects are decided once for a stretch of ranks; rows then meet by one address.

So no content's rows ever meet in one task. What is broadcast has at most two rows a shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, discard, pick

#: Leaves of an inner node.
FANOUT = 64
#: Bits of an address below the shard's number, as monotonically_increasing_id has them.
SHARD_BITS = 33
#: Of a content's SHA-256, which stands for it.
DIGEST_BYTES = 16


def _leaves(ordered: DataFrame) -> DataFrame:
    """(g, later, shard, first, n, before): the leaves of all trees; before counts the keys in the tree's leaves to the left."""
    leaves = ordered.groupBy("g", "later", F.shiftright("at", SHARD_BITS).alias("shard")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    leaves = cut(leaves, "leaves")
    # A tree of several leaves has one that begins its shard, so there are no more such trees than shards.
    begins = F.col("first").bitwiseAND((1 << SHARD_BITS) - 1) == 0
    wide = leaves.where(begins).select(F.col("g").alias("wg"), F.col("later").alias("wl")).distinct()
    several = leaves.join(F.broadcast(wide), F.col("g").eqNullSafe(F.col("wg")) & (F.col("later") == F.col("wl")), "left_semi")
    several = cut(several.withColumn("node", F.floor(F.col("shard") / FANOUT)), "nodes")
    left = lambda *by: Window.partitionBy("g", "later", *by).rowsBetween(Window.unboundedPreceding, -1)
    nodes = several.groupBy("g", "later", "node").agg(F.sum("n").alias("n"))
    nodes = nodes.select(F.col("g").alias("ng"), F.col("later").alias("nl"), F.col("node").alias("nn"), F.coalesce(F.sum("n").over(left().orderBy("node")), F.lit(0)).alias("of_nodes"))
    within = several.withColumn("of_leaves", F.coalesce(F.sum("n").over(left("node").orderBy("shard")), F.lit(0)))
    counted = within.join(nodes, F.col("g").eqNullSafe(F.col("ng")) & (F.col("later") == F.col("nl")) & (F.col("node") == F.col("nn")))
    counted = cut(counted.select(F.col("g").alias("cg"), F.col("later").alias("cl"), F.col("shard").alias("cs"), (F.col("of_nodes") + F.col("of_leaves")).alias("before")), "before")
    own = F.col("g").eqNullSafe(F.col("cg")) & (F.col("later") == F.col("cl")) & (F.col("shard") == F.col("cs"))
    return leaves.join(F.broadcast(counted), own, "left").select("g", "later", "shard", "first", "n", F.coalesce("before", F.lit(0).cast("long")).alias("before"))


def _selects(leaves: DataFrame) -> DataFrame:
    """(sg, shard, low, high, shift): earlier rows of a leaf with low <= at < high select the later row with the address at + shift."""
    # Ranks are cut into nodes as wide as the largest leaf, so that a leaf reaches into two of them at most.
    leaves = cut(leaves, "counted")
    width = max(1, leaves.agg(F.max("n")).first()[0] or 0)
    node = lambda c: F.floor(c / F.lit(width))
    reach = leaves.withColumn("node", F.explode(F.sequence(node(F.col("before")), node(F.col("before") + F.col("n") - 1))))
    side = lambda later, p: reach.where(F.col("later") == F.lit(later)).select(*[F.col(c).alias(f"{p}_{c}") for c in ("g", "shard", "first", "n", "before", "node")])
    start = F.greatest("e_before", "l_before")
    end = F.least(F.col("e_before") + F.col("e_n"), F.col("l_before") + F.col("l_n"))
    met = side(False, "e").join(side(True, "l"), F.col("e_g").eqNullSafe(F.col("l_g")) & (F.col("e_node") == F.col("l_node")))
    # Leaves that meet in two nodes are paired in the one where their common ranks start.
    met = met.where((start < end) & (F.col("e_node") == node(start)))
    at = F.col("e_first") - F.col("e_before")
    return met.select(
        F.col("e_g").alias("sg"), F.col("e_shard").alias("s_shard"), (at + start).alias("low"), (at + end).alias("high"), (F.col("l_first") - F.col("l_before") - at).alias("shift")
    )


def match_in_order(rows: DataFrame, group: str, order: Sequence[str], ties: bool = True) -> DataFrame:
    """(e, l): structs of the i-th earlier and the i-th later row of a group in the given order; null where a side has none.

    rows: later (boolean), the group's column and others. Null groups are one group, null values come first. Rows that repeat one
    another in all of ``order``, which there are none of without ``ties``, take turns in any order. No two rows of a side share a
    place, so no row is lost or met twice. Shards are cut by a sample of Spark's own, some 300 keys of ``order`` a shard.
    """
    columns = rows.columns
    keyed = rows.select(F.col(group).alias("g"), "later", *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*columns).alias("row"))
    by = ["g", "later", *[f"o{i}" for i in range(len(order))]]
    if ties:
        # Rows alike in everything are told apart by where they stand, so that even they are split over shards.
        keyed, by = keyed.withColumn("salt", F.monotonically_increasing_id()), [*by, "salt"]
    ordered = keyed.repartitionByRange(*by).sortWithinPartitions(*by).select("g", "later", "row", F.monotonically_increasing_id().alias("at"))
    ordered = cut(ordered, "ordered")
    selects = _selects(_leaves(ordered))
    earlier = ordered.where("NOT later").withColumn("shard", F.shiftright("at", SHARD_BITS))
    inside = F.col("g").eqNullSafe(F.col("sg")) & (F.col("shard") == F.col("s_shard")) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))
    # An address of no later row, and one of its own, where the later tree ends before that rank.
    asked = earlier.join(selects, inside, "left").select(F.coalesce(F.col("at") + F.col("shift"), -1 - F.col("at")).alias("asks"), F.col("row").alias("e"))
    later = ordered.where("later").select("at", F.col("row").alias("l"))
    return asked.join(later, F.col("asks") == F.col("at"), "full_outer").select("e", "l")


def snapshot_diff(earlier: DataFrame, later: DataFrame, key: str = "doc_id", content: str = "text", compared: Sequence[str] = ("text", "lang", "source"), carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per pair or unpaired row: key (later, else earlier), old_key (earlier, else null), op, changed, and carry's columns.

    Equal keys pair first: op is same, or update where a column of ``compared`` differs. Then, of the rows left over, the i-th smallest
    earlier key of a content pairs with the i-th smallest later one: rekey. What is left is delete or insert. changed names a pair's
    differing columns in the order of ``compared``, joined by commas, else it is empty. ``carry`` has expressions over the later row,
    null for a delete.

    Nulls equal only nulls, keys and contents too; null keys sort first. Where a key is on several rows, its i-th earlier row pairs with
    its i-th later row, in the order of the contents' digests and the compared values, so that equal rows pair as far as they stand at
    equal places; the rest is unpaired. Empty tables are all insert, or all delete. Other columns are ignored, whatever their names.
    """
    carry = carry or {}
    values = [c for c in compared if c != content]
    nested = [f"v{i}" for i in range(len(values))]

    def side(df: DataFrame, is_later: bool) -> DataFrame:
        digest = F.coalesce(F.substring(F.unhex(F.sha2(F.col(content).cast("string"), 256)), 1, DIGEST_BYTES), F.lit(b""))
        carried = [(expr if is_later else F.lit(None).cast(kinds[i])).alias(f"x{i}") for i, expr in enumerate(carry.values())]
        return df.select(F.lit(is_later).alias("later"), F.col(key).alias("k"), digest.alias("c"), *[F.col(v).alias(n) for v, n in zip(values, nested, strict=True)], *carried)

    kinds = [kind for _, kind in later.select(*[expr.alias(f"x{i}") for i, expr in enumerate(carry.values())]).dtypes] if carry else []
    rows = side(earlier, False).unionByName(side(later, True))
    whole = F.struct(*rows.columns)
    of = lambda is_later: F.col("later") == F.lit(is_later)
    by_key = rows.groupBy("k").agg(
        F.count(F.when(of(False), 1)).alias("ne"),
        F.count(F.when(of(True), 1)).alias("nl"),
        F.first(F.when(of(False), whole), ignorenulls=True).alias("e"),
        F.first(F.when(of(True), whole), ignorenulls=True).alias("l"),
    )
    by_key = cut(by_key, "keys")
    sole = by_key.where("ne <= 1 AND nl <= 1")
    pairs = sole.where("ne = 1 AND nl = 1").select("e", "l")
    rest = sole.where("ne + nl = 1").select(F.coalesce("e", "l").alias("r")).select("r.*")
    repeated = by_key.where("ne > 1 OR nl > 1").select(F.col("k").alias("rk"))
    ties = bool(repeated.take(1))
    if ties:
        again = pick(rows, F.col("k").eqNullSafe(F.col("rk")), repeated)
        met = cut(match_in_order(again, "k", ["c", *nested]), "repeated")
        pairs = pairs.unionByName(met.where("e IS NOT NULL AND l IS NOT NULL"))
        rest = rest.unionByName(met.where("e IS NULL OR l IS NULL").select(F.coalesce("e", "l").alias("r")).select("r.*"))
    matched = match_in_order(rest, "c", ["k", *nested] if ties else ["k"], ties)

    inner = {content: "c", **dict(zip(values, nested, strict=True))}
    differs = F.concat_ws(",", *[F.when(~F.col(f"e.{inner[c]}").eqNullSafe(F.col(f"l.{inner[c]}")), c) for c in compared])
    both = F.col("e").isNotNull() & F.col("l").isNotNull()
    shown = [F.col(f"l.x{i}").alias(name) for i, name in enumerate(carry)]
    told = F.when(both, differs).otherwise("")
    head = [F.when(F.col("l").isNotNull(), F.col("l.k")).otherwise(F.col("e.k")).alias("key"), F.col("e.k").alias("old_key")]
    by_keys = pairs.select(*head, F.when(differs == "", "same").otherwise("update").alias("op"), told.alias("changed"), *shown)
    by_content = matched.select(*head, F.when(both, "rekey").when(F.col("l").isNotNull(), "insert").otherwise("delete").alias("op"), told.alias("changed"), *shown)
    return by_keys.unionByName(by_content)
