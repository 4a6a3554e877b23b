"""Chat formatting with Spark expressions only.

A message is a run of adjacent turns with one role. It is written as

    ###ROLE: TEXT</turn>TEXT</turn>\\n

so one header serves the run, and every turn keeps its own end mark. The control strings ``###`` and ``</turn>`` are escaped
inside roles and texts, as is the escape character itself, and ``:`` inside roles; so no text can close its turn or open a
header, and ``parse_chat`` gives back exactly the turns that went in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER, TURN_END, ROLE_END = "###", "</turn>", ": "
#: The escape character comes first when escaping and last when undoing it.
TEXT_ESCAPES = (("\\", "\\s"), (HEADER, "\\h"), (TURN_END, "\\e"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (":", "\\c"))


def _escape(c: Column, pairs: tuple[tuple[str, str], ...] = TEXT_ESCAPES) -> Column:
    for plain, mark in pairs:
        c = F.replace(c, F.lit(plain), F.lit(mark))
    return c


def _unescape(c: Column, pairs: tuple[tuple[str, str], ...] = TEXT_ESCAPES) -> Column:
    for plain, mark in reversed(pairs):
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return c


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often a lambda inside it looks at it."""
    return F.get(F.transform(F.array(value), body), 0)


def _before(sizes: Column) -> Column:
    """For each of an array of sizes (chars, bytes) the sum of those to its left.

    A fold that grows its result copies it at each step, so it runs within blocks as long as the root of the array, then over the
    blocks: n turns cost n times the root of n small steps, where one fold would cost n times n.
    """
    zero = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("bytes"))
    none = F.array().cast("array<struct<chars:int,bytes:int>>")
    plus = lambda x, y: F.struct((x["chars"] + y["chars"]).alias("chars"), (x["bytes"] + y["bytes"]).alias("bytes"))

    def fold(items: Column, size: Callable[[Column], Column]) -> Column:
        start = F.struct(zero.alias("at"), none.alias("starts"))
        return F.aggregate(items, start, lambda acc, x: F.struct(plus(acc["at"], size(x)).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")))

    def of(items: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(1))
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), width), lambda s: fold(F.slice(items, s + 1, width), lambda x: x))
        return _let(blocks, lambda bs: F.flatten(F.zip_with(bs, fold(bs, lambda b: b["at"])["starts"], lambda b, more: F.transform(b["starts"], lambda x: plus(x, more)))))

    return _let(sizes, of)


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    turns: conv_id, turn, role, text; other columns are ignored, whatever their names. loss_spans are (start, length) in
    characters of ``formatted``, and (byte_start, byte_length) in its UTF-8 bytes: the escaped text of each turn of ``loss_role``,
    without marks.

    Null texts and roles count as empty. Turns sort by number, null first; equal numbers sort by role, then text, and repeated
    rows stay as turns of their own. Rows with a null conv_id form one conversation. An empty table gives an empty table.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def messages(ts: Column) -> Column:
        """Runs of one role: (role, texts)."""
        starts = F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: (i == 0) | (F.get(ts, i)["role"] != F.get(ts, i - 1)["role"]))
        texts = lambda at, s, j: F.transform(F.slice(ts, s + 1, F.coalesce(F.get(at, j + 1), F.size(ts)) - s), lambda t: _escape(t["text"]))
        return _let(starts, lambda at: F.transform(at, lambda s, j: F.struct(F.get(ts, s)["role"].alias("role"), texts(at, s, j).alias("texts"))))

    header = lambda m: F.concat(F.lit(HEADER), _escape(m["role"], ROLE_ESCAPES), F.lit(ROLE_END))
    write = lambda m: F.concat(header(m), F.array_join(F.transform(m["texts"], lambda t: F.concat(t, F.lit(TURN_END))), ""), F.lit("\n"))

    def pieces(ms: Column) -> Column:
        """For each turn what stands before its text, the text, and all of it with its marks, each in characters and bytes."""

        def of_turn(m: Column, h: Column, t: Column, k: Column) -> Column:
            more = len(TURN_END) + F.when(k == F.size(m["texts"]) - 1, 1).otherwise(0)
            lead = lambda size: F.when(k == 0, size(h)).otherwise(0)
            both = lambda f: F.struct(f(F.length).cast("int").alias("chars"), f(F.octet_length).cast("int").alias("bytes"))
            return F.struct(both(lead).alias("lead"), both(lambda size: size(t)).alias("text"), both(lambda size: lead(size) + size(t) + more).alias("whole"), (m["role"] == loss_role).alias("loss"))

        return F.flatten(F.transform(ms, lambda m: _let(header(m), lambda h: F.transform(m["texts"], lambda t, k: of_turn(m, h, t, k)))))

    def spans(ps: Column) -> Column:
        placed = F.zip_with(ps, _before(F.transform(ps, lambda p: p["whole"])), lambda p, at: F.struct(p.alias("p"), at.alias("at")))
        of = lambda x, unit: ((x["at"][unit] + x["p"]["lead"][unit]), x["p"]["text"][unit])
        names = (("chars", "start", "length"), ("bytes", "byte_start", "byte_length"))
        span = lambda x: F.struct(*[c.alias(n) for unit, *own in names for c, n in zip(of(x, unit), own, strict=True)])
        return F.transform(F.filter(placed, lambda x: x["p"]["loss"]), span)

    written = lambda ms: F.struct(F.array_join(F.transform(ms, write), "").alias("formatted"), _let(pieces(ms), spans).alias("loss_spans"))
    return sorted_turns.select("conv_id", _let(F.col("ts"), lambda ts: _let(messages(ts), written)).alias("out")).select("conv_id", "out.formatted", "out.loss_spans")


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text); empty for an empty text, null for null.

    Empty roles and texts come back as empty, which is also what null ones have become.
    """
    blocks = F.slice(F.split(formatted, HEADER, -1), 2, F.length(formatted))

    def turns(b: Column) -> Column:
        role = F.substring_index(b, ROLE_END, 1)
        texts = F.split(F.substr(b, F.length(role) + len(ROLE_END) + 1), TURN_END, -1)
        return F.transform(F.slice(texts, 1, F.size(texts) - 1), lambda t: F.struct(_unescape(role, ROLE_ESCAPES).alias("role"), _unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, without escapes; empty where there are no spans, null where either is null.

    Spans are cut by their bytes, which are found at once, where characters would be counted from the start for each.
    """
    cut = lambda b: F.array_join(F.transform(loss_spans, lambda s: _unescape(F.substr(b, s["byte_start"] + 1, s["byte_length"]).cast("string"))), "")
    return F.when(loss_spans.isNotNull(), _let(formatted.cast("binary"), cut))
