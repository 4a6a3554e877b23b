"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

Targets: every source has a weight's share of the budget, but at most MAX_EPOCHS times its own size. Handing a clamped source's
excess to the others in proportion to their weights, again and again until none is above its cap, ends where each source has
min(cap, level x weight). With the sources in the order of cap / weight the clamped ones are a prefix, so two running sums over
the sources give that level at once, without a loop.

Repetitions: target / size is a whole number of passes over a source and a fraction. The fraction is a seeded subset: documents
have a uniform hash of id and text, the hashes fall in bins of BIN_ROWS rows or fewer, and whole bins are taken while they fit; in
the bin where the target ends, documents are taken in the order of the hash. So a source misses its target by at most half a
document, and no source is ever sorted or gathered as a whole, not even where its rows have one id or none. How many bins there are
changes the work alone, not what is taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, free_names

MAX_EPOCHS = 3
#: Bins of all hashes at least, and rows of all sources to a bin.
BINS, BIN_ROWS = 4096, 65_536
BROADCAST_ROWS = 500_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, skey, source_size, target: one row per source. Weights repeat over the sources by code point, null last."""
    stats = sizes.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = stats.withColumn("weight", F.get(F.lit([float(w) for w in weights]), F.pmod(turn, F.lit(len(weights)))))
    weighted = weighted.withColumn("cap", F.col("source_size") * F.lit(max_epochs)).withColumn("total", F.sum("source_size").over(everything))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    clamped = weighted.withColumn("clamped", F.col("cap") * after <= (F.col("total") - before) * F.col("weight"))
    spent = F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("clamped"), F.col("weight"))).over(everything)
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise((F.col("total") - spent) * F.col("weight") / open_weight)
    return clamped.select("source", "skey", "source_size", target.alias("target"))


def _draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A document's uniform number: 40 bits of an MD5 of seed, id and the text's MD5, which any engine can tell; nulls are left out."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"), F.md5(text))), 1, 10), 16, 10).cast("long") / float(2**40)


def _source_key(source: Column) -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _small(df: DataFrame) -> DataFrame:
    """A written table, broadcast up to BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _planned(docs: DataFrame, weights: Sequence[float], seed: int, max_epochs: int, id_col: str, text_col: str, source_col: str) -> tuple[int, DataFrame, DataFrame, DataFrame]:
    """(bins, plan, planned, edge): the number of bins; per source whole passes, the last bin that is taken once more, and the bin where the target ends; per
    row its size, bin and plan; and the (skey, id, text hash) that are taken once more in the bins where targets end."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _source_key(F.col(source_col)).alias("skey"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_hash"), _draw(F.col(id_col), F.col(text_col), seed).alias("u")
    )
    sizes = cut(rows, "sizes")
    number = max(BINS, 1 << (sizes.count() // BIN_ROWS).bit_length())
    sizes = sizes.withColumn("bin", F.floor(F.col("u") * number).cast("int"))
    targets = source_targets(sizes, weights, max_epochs)
    bins = sizes.groupBy("skey", "bin").agg(F.sum("size").alias("words"))
    through = F.sum("words").over(Window.partitionBy("skey").orderBy("bin"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = targets.withColumn("whole", whole).withColumn("more", F.col("target") - F.col("whole") * F.col("source_size"))
    filled = bins.withColumn("through", through).join(plan.select("skey", "more"), "skey")
    ends = filled.where(F.col("through") <= F.col("more")).groupBy("skey").agg(F.max("bin").alias("last_bin"), F.max("through").alias("spent"))
    # The bin where the target ends is the next one of that source.
    edge = filled.where(F.col("through") > F.col("more")).groupBy("skey").agg(F.min("bin").alias("edge"))
    plan = plan.join(ends, "skey", "left").join(edge, "skey", "left")
    plan = plan.select("skey", "source_size", "target", "whole", F.coalesce("last_bin", F.lit(-1)).alias("last_bin"), (F.col("more") - F.coalesce("spent", F.lit(0))).alias("rest"), "edge")
    plan = cut(plan, "plan")
    planned = sizes.join(_small(plan), "skey")
    # Rows that repeat an id and its text are taken together or not at all.
    units = planned.where((F.col("bin") == F.col("edge")) & (F.col("whole") < max_epochs)).groupBy("skey", "u", "doc_id", "text_hash", "rest").agg(F.sum("size").alias("size"))
    run = F.sum("size").over(Window.partitionBy("skey").orderBy("u", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0))
    taken = units.withColumn("run", run).where(F.col("run") - F.col("size") / 2 <= F.col("rest"))
    return number, plan, planned, cut(taken.select("skey", "doc_id", "text_hash"), "edge")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), seed: int = 23, max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken.

    size: words of the text (null: 0). The budget is the sum of all sizes. Sources whose words are none have target 0. A null
    source is a source of its own, and null ids draw by their text. Rows that repeat id and text are taken alike. Empty tables
    give empty tables; other columns are ignored, whatever their names.
    """
    _, _, planned, edge = _planned(docs, weights, seed, max_epochs, id_col, text_col, source_col)
    at_edge = F.col("edge").isNotNull() & (F.col("bin") == F.col("edge"))
    rows = planned.join(_small(edge.select(F.col("skey").alias("k"), F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.lit(1).alias("drawn"))), at_edge & (F.col("skey") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    extra = F.when(at_edge, F.coalesce("drawn", F.lit(0))).when((F.col("bin") <= F.col("last_bin")) & (F.col("whole") < max_epochs), 1).otherwise(0)
    copies = (F.col("whole") + extra).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def repeat_docs(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), seed: int = 23, max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of docs as often as ``mix`` takes it, with all its columns, whatever their names.

    The texts don't move: a row's copies follow from its source's plan, and the few rows that are taken once more where a target
    ends are looked up by source, id and hash of the text. Both tables are broadcast up to BROADCAST_ROWS rows, else joined.
    """
    number, plan, _, edge = _planned(docs, weights, seed, max_epochs, id_col, text_col, source_col)
    key, draw, text_hash, own, whole, last, ends, k, d, t, drawn, copies, copy = free_names(docs.columns, "key", "draw", "text_hash", "own", "whole", "last", "ends", "k", "d", "t", "drawn", "copies", "copy")
    rows = docs.withColumns({key: _source_key(F.col(source_col)), draw: F.floor(_draw(F.col(id_col), F.col(text_col), seed) * number), text_hash: F.xxhash64(text_col)})
    plan = plan.select(F.col("skey").alias(own), F.col("whole").alias(whole), F.col("last_bin").alias(last), F.col("edge").alias(ends))
    edge = edge.select(F.col("skey").alias(k), F.col("doc_id").alias(d), F.col("text_hash").alias(t), F.lit(1).alias(drawn))
    at_edge = F.col(ends).isNotNull() & (F.col(draw) == F.col(ends))
    rows = rows.join(_small(plan), F.col(key) == F.col(own))
    rows = rows.join(_small(edge), at_edge & (F.col(key) == F.col(k)) & F.col(id_col).eqNullSafe(F.col(d)) & (F.col(text_hash) == F.col(t)), "left")
    extra = F.when(at_edge, F.coalesce(drawn, F.lit(0))).when((F.col(draw) <= F.col(last)) & (F.col(whole) < max_epochs), 1).otherwise(0)
    rows = rows.withColumn(copies, (F.col(whole) + extra).cast("int")).where(F.col(copies) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
