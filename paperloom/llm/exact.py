"""Exact dedup through an extendible-hash index, with DataFrame operations only.

1. Count: the 64-bit hashes of the normalised texts are counted in the shared folder; that is 16 bytes a distinct hash.
2. Directory: from the counts of the hashes' leading bits a directory of depth 0 doubles, and overfull buckets split on their next
   bit. Its slots, and so what the driver and the broadcast hold, are bounded by MAX_DEPTH; a bucket that is overfull at that depth
   splits into as many more by the bits that follow, so there is no depth at which buckets grow.
3. Route: every row looks its bucket up, and each owner task takes a range of buckets in key order.
4. Chains: an owner sorts its buckets by (bucket, hash, text), so texts of one hash form a chain in which the bytes are compared;
   equal ones decide keep_id and group_size there and then.
5. Hot hashes, those with more than HOT_SHARE of an owner's rows, don't go to an owner as rows: their copies are counted before they
   move, which gives their chains, and rows look them up there: by (bucket, hash) where the chain has one entry, which the count has
   found to be every row's text, and by their bytes where texts collide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, free_names, pick

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: At most 2**MAX_DEPTH directory slots.
MAX_DEPTH = 14
#: Entries of a bucket before it splits.
BUCKET_ENTRIES = 50_000
#: Rows of an owner task, at most about so many on average; and the share of them above which one hash is hot.
OWNER_ROWS, HOT_SHARE = 500_000, 1 / 16


def ascii_lower(text: Column) -> Column:
    """text with A-Z only lower-cased; null counts as empty. Pure ASCII texts take the fast path."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def slot_of(h: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a 64-bit hash."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def grow_directory(counts: dict[int, int], depth: int, capacity: int) -> tuple[int, list[tuple[int, int]]]:
    """(global depth, for each slot (bucket, local depth)) from the counts of the leading ``depth`` bits.

    Starts with one bucket; an overfull bucket splits on its next bit, and the directory doubles when that bucket was as deep
    as the directory. Buckets are numbered by the first slot at full depth that they cover, so their numbers keep key order.
    """

    def full(prefix: int, local: int) -> int:
        first = prefix << (depth - local)
        return sum(counts.get(s, 0) for s in range(first, first + (1 << (depth - local)))) if local else sum(counts.values())

    global_depth, directory, todo = 0, [(0, 0)], [(0, 0)]
    while todo:
        prefix, local = todo.pop()
        if local == depth or full(prefix, local) <= capacity:
            continue
        if local == global_depth:
            directory = [b for b in directory for _ in range(2)]
            global_depth += 1
        wide = global_depth - local - 1
        for half in (0, 1):
            child = (prefix << 1) | half
            bucket = (child << (depth - local - 1), local + 1)
            directory[child << wide : (child + 1) << wide] = [bucket] * (1 << wide)
            todo.append((child, local + 1))
    return global_depth, directory


def number_buckets(counts: dict[int, int], depth: int, capacity: int) -> tuple[int, list[tuple[int, int, int]], int]:
    """(global depth, for each slot (slot, first bucket, more bits), buckets): numbers are dense and in key order.

    A bucket that is overfull at full depth is 2**more buckets, told apart by the bits that follow the slot's.
    """
    global_depth, directory = grow_directory(counts, depth, capacity)
    slots, number, last = [], -1, None
    width = 0
    for slot, bucket in enumerate(directory):
        if bucket != last:
            number, last = number + (1 << width if last is not None else 1), bucket
            prefix, local = bucket
            held = sum(counts.get(s, 0) for s in range(prefix, prefix + (1 << (depth - local))))
            width = max(0, -(-held // capacity) - 1).bit_length() if local == depth else 0
        slots.append((slot, number, width))
    return global_depth, slots, number + (1 << width)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ENTRIES, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, bucket, row_hash (of the raw text).

    Texts are equal when identical after lower-casing A-Z only; null counts as empty, and all empty texts form a group. The row
    with the largest doc_id of a group stays; rows that repeat it are kept as often as they occur. A null doc_id stays only in a
    group that has no other. An empty table gives an empty one. Other columns are ignored, whatever their names. ``hash_of`` may be
    any 64-bit hash: texts that collide are told apart by their bytes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row_hash"), ascii_lower(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("h", hash_of(F.col("norm")))
    hashes = cut(rows.groupBy("h").agg(F.count("*").alias("n")), "hashes")
    entries, total = hashes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // OWNER_ROWS))
    # Buckets are the pieces that owners take, so there are some for each.
    capacity = max(1, min(capacity, entries // (4 * owners)))
    depth = min(MAX_DEPTH, max(1, (entries // capacity).bit_length() + 2))
    counts = {r["slot"]: r["n"] for r in hashes.groupBy(slot_of(F.col("h"), depth).alias("slot")).agg(F.count("*").alias("n")).collect()}
    global_depth, slots, buckets = number_buckets(counts, depth, capacity)
    directory = F.broadcast(spark.createDataFrame(slots, "slot long, number long, more int"))
    after = F.expr(f"CASE WHEN more = 0 THEN 0L ELSE shiftrightunsigned(shiftleft(h, {global_depth}), 64 - more) END")
    routed = rows.withColumn("slot", slot_of(F.col("h"), global_depth)).join(directory, "slot")
    routed = routed.withColumn("bucket", F.col("number") + after).select("doc_id", "row_hash", "norm", "h", "bucket")
    found = ["doc_id", "row_hash", "norm", "bucket", "keep_id", "group_size"]

    # At most owners / HOT_SHARE hashes of 8 bytes: they and their chains' lengths can be broadcast.
    hot = cut(hashes.where(F.col("n") > max(1.0, total / owners * HOT_SHARE)).select(F.col("h").alias("hot_h")), "hot")
    is_hot = F.col("h") == F.col("hot_h")
    some = bool(hot.take(1))
    cold = routed.join(F.broadcast(hot), is_hot, "left_anti") if some else routed
    owned = cold.withColumn("owner", F.floor(F.col("bucket") * owners / F.lit(buckets)).cast("int")).repartitionById(owners, F.col("owner"))
    equal = Window.partitionBy("owner", "bucket", "h", "norm")
    decided = owned.withColumns({"keep_id": F.max("doc_id").over(equal), "group_size": F.count("*").over(equal)}).select(*found)
    if some:
        warm = routed.join(F.broadcast(hot), is_hot, "left_semi")
        chains = warm.groupBy("bucket", "h", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        chains = cut(chains, "chains")
        lengths = cut(chains.groupBy(F.col("bucket").alias("b"), F.col("h").alias("ch")).agg(F.count("*").alias("links"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")), "lengths")
        at = (F.col("bucket") == F.col("b")) & (F.col("h") == F.col("ch"))
        decided = decided.unionByName(warm.join(F.broadcast(lengths.where("links = 1")), at).select(*found))
        if lengths.where("links > 1").take(1):
            apart = chains.join(lengths.where("links > 1").select("b", "ch"), at, "left_semi").select(F.col("bucket").alias("b"), F.col("h").alias("ch"), F.col("norm").alias("text"), "keep_id", "group_size")
            decided = decided.unionByName(warm.join(apart, at & (F.col("norm") == F.col("text"))).select(*found))
    return decided.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.sha2("norm", 256).alias("text_sha256"), "bucket", "row_hash")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text another row with a larger id has; of rows that repeat the id that stays, one stays.

    Null texts count as empty ones; a row with a null id stays only where its text has no other. The texts don't move to meet the
    decisions, which go by (id, hash of the raw text) and leave out texts that occur once. All columns stay, whatever their names.
    """
    row, own_id, own_hash, stays = free_names(docs.columns, "row", "id", "hash", "stays")
    groups = cut(exact_groups(docs, id_col, text_col).where("group_size > 1"), "groups")
    marked = docs.withColumn(row, F.xxhash64(text_col))
    key = [F.col("doc_id").alias(own_id), F.col("row_hash").alias(own_hash)]
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(row) == F.col(own_hash))
    rest = pick(marked, same, groups.where("NOT kept").select(*key).distinct(), "left_anti")
    again = groups.where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"), F.collect_set("row_hash").alias("hashes")).where("n > 1")
    again = cut(again.select(F.col("doc_id").alias(own_id), F.explode("hashes").alias(own_hash), F.array_min("hashes").alias(stays)), "again")
    if not again.take(1):
        return rest.drop(row)
    once = pick(rest, same, again.select(own_id, own_hash), "left_anti")
    repeated = pick(rest, same, again.where(F.col(own_hash) == F.col(stays)).select(own_id, own_hash), "left_semi").dropDuplicates([id_col, row])
    return once.unionByName(repeated).drop(row)
