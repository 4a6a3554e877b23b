"""Shards of near-equal bytes: sampled splitters, range partitioning and subdivision of overfull ranges, with DataFrame operations only.

Records are ordered by (hash of the text, id), so equal texts stand together and no order of ids or sources shows in the shards.
A size-weighted sample of the keys gives quantile boundaries of FINE ranges per shard; ranges that turn out overfull are sampled
again and subdivided, where one text's copies fill a range by their ids. Within the ranges a running sum gives every record its
place in the whole order, and the shard is read off that place. Only the id, size and checksum of a record are shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate, count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: Ranges per shard, and sampled keys per range: the driver holds this many keys times the shards, whatever the input.
FINE, SAMPLED = 8, 32
#: A range with more rows is subdivided, as is one with twice its share of the bytes.
RANGE_ROWS = 4_000_000
#: Equal texts stay in one shard up to this share of a shard; larger groups are cut where a shard is full.
WHOLE_GROUP = 1 / 32
RECORD_BYTES = 16
LOWEST = -(2**63)

Key = tuple[int, int]


def _keys(points: list[Key]) -> str:
    """SQL for an array of keys: one expression to parse, however many keys there are."""
    own = ", ".join(f"struct(cast('{a}' as bigint) as k, cast('{b}' as bigint) as d)" for a, b in points)
    return f"cast(array({own}) as array<struct<k:bigint,d:bigint>>)"


def _range_of(bounds: list[Key]) -> Column:
    """How many boundaries are at or below the record's key: first among every so many boundaries, then among those between."""
    if not bounds:
        return F.lit(0)
    key = F.struct(F.col("k"), F.col("d"))
    step = max(1, int(len(bounds) ** 0.5))
    tops = bounds[::step]
    below = F.size(F.filter(F.expr(_keys(tops)), lambda b: b <= key))
    groups = F.expr(f"array({', '.join([_keys([]), *(_keys(bounds[i + 1 : i + step]) for i in range(0, len(bounds), step))])})")
    inner = F.size(F.filter(F.get(groups, below), lambda b: b <= key))
    return F.when(below == 0, 0).otherwise((below - 1) * step + 1 + inner)


def _quantiles(points: list[tuple[int, int, float]], n: int) -> list[Key]:
    """n - 1 boundaries of equal weight; one text's boundary stands before its first copy unless the text fills a range."""
    points = sorted(points)
    sums = list(accumulate(p[2] for p in points))
    bounds: list[Key] = []
    for i in range(1, n):
        k, d, _ = points[min(len(points) - 1, bisect_left(sums, sums[-1] * i / n))]
        bound = (k, d) if bounds and bounds[-1][0] == k else (k, LOWEST)
        if not bounds or bound > bounds[-1]:
            bounds.append(bound)
    return bounds


def _sample(recs: DataFrame, rate: Column, seed: int) -> list[tuple[int, int, float]]:
    """Keys drawn with a probability that follows the size; the same on each run. Rows that repeat a key are one, with their weight."""
    u = F.pmod(F.xxhash64("k", "d", F.lit(seed)), F.lit(2**40)) / float(2**40)
    drawn = recs.withColumn("rate", rate).where(u < F.col("rate")).groupBy("k", "d").agg(F.sum(F.greatest(F.lit(1.0), "rate")).alias("w"))
    return [tuple(r) for r in drawn.collect()]


def _stats(recs: DataFrame, bounds: list[Key]) -> dict[int, tuple[int, int]]:
    rows = recs.groupBy(_range_of(bounds).alias("r")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return {r["r"]: (r["b"], r["n"]) for r in rows}


def splitters(recs: DataFrame, total: int, n_ranges: int, seed: int) -> tuple[list[Key], dict[int, tuple[int, int]]]:
    """Boundaries, and bytes and rows of every range; overfull ranges are subdivided until none can be, which is one key's rows."""
    points = _sample(recs, F.col("size") * (n_ranges * SAMPLED / max(total, 1)), seed)
    bounds = _quantiles(points, n_ranges) if points else []
    stats = _stats(recs, bounds)
    for again in count(1):
        share = total / n_ranges
        parts = {r: int(max(b // share + 1, n // RANGE_ROWS + 1)) for r, (b, n) in stats.items() if n > 1 and (b > 2 * share or n > RANGE_ROWS)}
        if not parts:
            break
        inside = recs.withColumn("r", _range_of(bounds)).where(F.col("r").isin(list(parts)))
        rates = F.element_at(F.create_map(*[F.lit(x) for r, p in parts.items() for x in (r, p * SAMPLED / stats[r][0])]), F.col("r"))
        points = _sample(inside, F.col("size") * rates, seed + again)
        before = bounds
        edges = [(LOWEST, LOWEST), *bounds, (2**63 - 1, 2**63 - 1)]
        for r, p in parts.items():
            own = [x for x in points if edges[r] <= x[:2] < edges[r + 1]]
            if own:
                found = _quantiles(own, p)
                bounds = sorted({*bounds, *(b if b > edges[r] else (own[len(own) // 2][:2]) for b in found)})
        if bounds == before:
            break
        stats = _stats(recs, bounds)
    return bounds, stats


def shard_by_bytes(docs: DataFrame, n_shards: int, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard (0 to n_shards - 1), slot (gapless from 0 in each shard).

    size: UTF-8 bytes of the text (null: none) plus 16. The shards' bytes are near equal: a shard differs from its share by less
    than WHOLE_GROUP of it plus one record. Null ids sort before all others; rows that repeat one another have places of their
    own, in any order. An empty table gives an empty table, few rows leave shards empty. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    recs = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("k"),
    )
    recs = cut(recs.withColumn("d", F.coalesce("doc_id", F.lit(LOWEST))), "records")
    total = recs.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bounds, stats = splitters(recs, total, n_shards * FINE, seed)
    last = max(stats, default=0)
    before = [0, *accumulate(stats.get(r, (0, 0))[0] for r in range(last + 1))]
    in_range = Window.partitionBy("r")
    placed = recs.withColumn("r", _range_of(bounds))
    placed = placed.select(
        "*",
        F.sum("size").over(in_range.orderBy("k")).alias("through_group"),
        F.sum("size").over(Window.partitionBy("r", "k")).alias("group_bytes"),
        F.sum("size").over(in_range.orderBy("k", "d").rowsBetween(Window.unboundedPreceding, 0)).alias("through"),
    )
    offset = F.get(F.lit(before), F.col("r"))
    middle = F.when(F.col("group_bytes") > WHOLE_GROUP * total / n_shards, F.col("through") - F.col("size") / 2).otherwise(F.col("through_group") - F.col("group_bytes") / 2)
    shard = F.least(F.lit(n_shards - 1), F.floor((offset + middle) * n_shards / F.lit(float(max(total, 1)))).cast("int"))
    placed = placed.withColumn("shard", shard)
    numbered = placed.withColumn("place", F.row_number().over(Window.partitionBy("r", "shard").orderBy("k", "d")) - 1)
    numbered = cut(numbered.select("doc_id", "size", "text_crc32", "r", "shard", "place"), "placed")
    # At most one row for each range and each cut of it: as bounded as the ranges are.
    pieces = numbered.groupBy("shard", "r").agg(F.count("*").alias("n"))
    starts = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.broadcast(pieces.select("shard", "r", starts.alias("first")))
    return numbered.join(first, ["shard", "r"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"))
