"""Tokens and term weights."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.store import BROADCAST_ROWS, cut, small

#: The range of ideographs that are read as pairs.
IDEOGRAPHS = "[一-鿿]+"
#: Bytes of text that are counted at once, if one text has no more.
PIECE = 8 << 20
#: The letter or digit, in lower case, that a byte is; else 0.
LETTERS = np.array([ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else 0 for i in range(256)], np.uint8)


def ascii_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z0-9]+)"), 1)


def keyword_terms(c: Column) -> Column:
    return F.array_distinct(F.filter(ascii_words(c), lambda t: F.length(t) >= 2))


def mixed_tokens(c: Column) -> Column:
    """ASCII words, then runs of ideographs as overlapping pairs; a single ideograph stands alone."""
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({IDEOGRAPHS})"), 1)
    pairs = F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))))
    return F.concat(ascii_words(c), F.flatten(pairs))


def _bytes_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the texts begin and end, and their bytes."""
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    return ends, np.frombuffer(text.buffers()[2], np.uint8)[ends[0] : ends[-1]]


def _tokens(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row and the text of each of ``mixed_tokens``. Every text ends in a byte that is no letter."""
    ends, data = _bytes_of(text)
    # The two characters that lower-casing turns into ASCII letters.
    known = data.tobytes()
    for c, to in (("\u0130", "i\u0307"), ("\u212a", "k")):
        if c.encode() in known:
            text = pc.replace_substring(text, c, to)
    ends, data = _bytes_of(text)
    low = LETTERS[data]
    inside = low != 0
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, stops = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(low[inside]))
    row = np.repeat(np.arange(len(text)), np.diff(np.searchsorted(starts, ends - ends[0])))
    at, pairs = [], []
    # Only rows with a byte that an ideograph starts with are looked at as characters.
    firsts = np.flatnonzero((data >= 0xE4) & (data <= 0xE9))
    for i in np.unique(np.searchsorted(ends - ends[0], firsts, "right") - 1) if len(firsts) else ():
        for r in re.findall(IDEOGRAPHS, text[int(i)].as_py()):
            found = [r] if len(r) == 1 else list(map("".join, zip(r, r[1:], strict=False)))
            at.extend([i] * len(found))
            pairs.extend(found)
    return np.concatenate([row, np.array(at, np.int64)]), pa.concat_arrays([words, pa.array(pairs, pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch], texts: int) -> Iterator[pa.RecordBatch]:
    """The batches with some PIECE bytes of text each in their last ``texts`` columns, or one longer text."""
    held, have = [], 0
    for batch in batches:
        size = sum(pc.binary_length(c).to_numpy().astype(np.int64) for c in batch.columns[-texts:])
        cuts = np.flatnonzero(np.diff((have + np.cumsum(size)) // PIECE, prepend=have // PIECE))
        for at, (i, j) in enumerate(zip([0, *cuts], [*cuts, batch.num_rows], strict=True)):
            if at and held:
                yield pa.concat_batches(held)
                held = []
            if i < j:
                held.append(batch.slice(i, j - i))
        have += int(size.sum())
    if held:
        yield pa.concat_batches(held)


def _counted(texts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The last ``texts`` columns of each batch as (field, tokens, tfs), a row for each: ``mixed_tokens``, counted, and a null token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches, texts):
            keys, names, n = b.columns[:-texts], b.schema.names[:-texts], b.num_rows
            for i in range(texts):
                row, tokens = _tokens(b.columns[len(keys) + i])
                coded = tokens.dictionary_encode()
                known = pa.concat_arrays([coded.dictionary, pa.nulls(1, pa.string())])
                one = np.concatenate([row * len(known) + coded.indices.to_numpy(), np.arange(1, n + 1) * len(known) - 1])
                each, tf = np.unique(one, return_counts=True)
                ends = pa.array(np.searchsorted(each, np.arange(n + 1) * len(known)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, v) for v in (known.take(pa.array(each % len(known))), pa.array(tf, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*keys, pa.array([i] * n, pa.int32()), *lists], names=[*names, "field", "tokens", "tfs"])

    return count


def _types(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema.fields)


def _moved(df: DataFrame, texts: list[str], key: str, by: list[str] | None) -> DataFrame:
    """(by, key, text0, text1, ..): texts with an end, in the task of their key."""
    ended = [F.make_valid_utf8(F.concat(F.coalesce(F.col(t), F.lit("")), F.lit("\n"))).alias(f"text{i}") for i, t in enumerate(texts)]
    return df.select(*(by or []), key, *ended).repartition(key)


def counted_texts(df: DataFrame, texts: list[str], key: str = "pos", by: list[str] | None = None) -> DataFrame:
    """(by, key, field, tokens, tfs): the tokens of each of the text columns, whose number is the field, counted once and written.

    Every text has a null token too, so that texts without tokens are not lost. Texts move once, to the task of their key, where Arrow
    and numpy count them, and are one row each; tokens never move, but where several rows share a key.
    """
    own, rows = [*(by or []), key], _moved(df, texts, key, by)
    counted = cut(rows.mapInArrow(_counted(len(texts)), f"{_types(rows, *own)}, field int, tokens array<string>, tfs array<long>"), "tf")
    if not counted.where("field = 0").groupBy(*own).agg(F.count("*").alias("n")).where("n > 1").take(1):
        return counted
    added = _each(counted, own).groupBy(*own, "field", "token").agg(F.sum("tf").alias("tf"))
    lists = added.groupBy(*own, "field").agg(F.collect_list(F.struct("token", "tf")).alias("l"))
    return cut(lists.select(*own, "field", F.col("l.token").alias("tokens"), F.col("l.tf").alias("tfs")), "tf")


def _each(counted: DataFrame, own: list[str]) -> DataFrame:
    return counted.select(*own, "field", F.inline(F.arrays_zip("tokens", "tfs"))).withColumnsRenamed({"tokens": "token", "tfs": "tf"})


@dataclass(frozen=True)
class Held:
    """(group, token, df) of frequent tokens and of the rest, if there is any, and (group, n)."""

    frequent: DataFrame
    rest: DataFrame | None
    sizes: DataFrame


def _frequencies(group: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(group, token, df) of each batch of texts by themselves, from their groups and tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = b.column("tokens")
            at = pc.list_parent_indices(tokens)
            t = pa.table({**{g: b.column(g).take(at) for g in group}, "token": pc.list_flatten(tokens)})
            yield from t.group_by([*group, "token"]).aggregate([([], "count_all")]).select([*group, "token", "count_all"]).rename_columns([*group, "token", "df"]).to_batches()

    return count


def _held(counted: DataFrame, group: list[str], most: int | None = None) -> Held:
    """Document frequencies of one written table, in which the null token of every text counts the texts, empty ones too.

    The frequent tokens, ``most`` at most and down to a frequency of a power of two, are broadcast, which is nearly all rows of
    the table; those of the rest are joined by both sides' keys.
    """
    return _split(counted.select(*group, "tokens").mapInArrow(_frequencies(group), f"{_types(counted, *group)}, token string, df long"), group, most)


def _split(partial: DataFrame, group: list[str], most: int | None = None) -> Held:
    """The same of partial frequencies (group, token, df)."""
    most = BROADCAST_ROWS if most is None else most
    held = cut(partial.groupBy(*group, "token").agg(F.sum("df").alias("df")), "df")
    counts = held.agg(*[F.count(F.when(F.col("df") >= 1 << k, 1)).alias(f"c{k}") for k in range(63)]).first()
    least = next((k for k in range(63) if counts[k] <= most), 63)
    sides = held.where("token IS NOT NULL"), small(cut(held.where("token IS NULL").select(*group, F.col("df").alias("n")), "sizes"))
    bound = F.lit(1 << min(least, 62))
    return Held(F.broadcast(sides[0].where(F.col("df") >= bound)), sides[0].where(F.col("df") < bound) if least else None, sides[1])


def _idf() -> Column:
    return F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1


def term_weights(df: DataFrame, text: str, key: str = "pos", by: list[str] | None = None) -> DataFrame:
    """(by, key, token, tf, df, n, idf, weight) of every token of every text; ``by`` makes each group a corpus of its own."""
    group, counted = [*(by or []), "field"], counted_texts(df, [text], key, by)
    held, tf = _held(counted, group), _each(counted, [*(by or []), key]).where("token IS NOT NULL")
    joined = tf.join(held.frequent, [*group, "token"], "left")
    if held.rest is not None:
        joined = joined.where("df IS NOT NULL").unionByName(joined.where("df IS NULL").drop("df").join(held.rest, [*group, "token"]))
    return joined.join(held.sizes, group).withColumn("idf", _idf()).withColumn("weight", F.col("tf") * F.col("idf")).drop("field")


#: The columns of a block, a piece of texts with a list of terms of its own: groups, the number of texts of each, the keys of the texts, the terms as one string, each term's group and
#: frequency, where each text's entries end, and the entries' terms and counts. Numbers are bytes: a row is a few values for Spark, however many tokens it has.
BLOCK = "field int, groups array<struct<{by}>>, sizes binary, keys array<struct<{key}>>, terms string, term_group binary, dfs binary, ends binary, codes binary, tfs binary"


def _ints(a: np.ndarray) -> pa.Array:
    return pa.array([a.astype(np.min_scalar_type(int(a.max(initial=0)))).tobytes()], pa.binary())


def _read(b: pa.RecordBatch, name: str, i: int, n: int) -> np.ndarray:
    """The n numbers of a row, whose width follows from their bytes."""
    data = b.column(name)[i].as_buffer()
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _block(by: list[pa.Array], key: pa.Array, field: int, row: np.ndarray, tokens: pa.Array, tf: np.ndarray | None = None) -> list[pa.Array]:
    """A block of texts from the row and the token of each of their entries; without counts, entries are counted."""
    n, group = len(key), np.zeros(len(key), np.int64)
    for c in by:
        coded = c.dictionary_encode("encode")
        group = np.unique(group * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)[1]
    first = np.unique(group, return_index=True)[1]
    coded = tokens.dictionary_encode()
    many = max(len(coded.dictionary), 1)
    one = row * many + coded.indices.to_numpy()
    if tf is None:
        one, tf = np.unique(one, return_counts=True)
    else:
        at = np.argsort(one)
        one, tf = one[at], tf[at]
    row = one // many
    pair = group[row] * many + one % many
    if len(first) * many <= 8 * len(pair) + 1024:
        count = np.bincount(pair, minlength=len(first) * many)
        terms = np.flatnonzero(count)
        dfs, codes = count[terms], (np.cumsum(count > 0) - 1)[pair]
    else:
        terms, codes, dfs = np.unique(pair, return_inverse=True, return_counts=True)
    names = coded.dictionary.take(pa.array(terms % many)) if len(terms) else pa.array([], pa.string())
    structs = pa.StructArray.from_arrays([*[c.take(pa.array(first)) for c in by], pa.array([field] * len(first), pa.int32())], [*[f"g{i}" for i in range(len(by))], "f"])
    keys = pa.StructArray.from_arrays([*by, key], [*[f"g{i}" for i in range(len(by))], "k"])
    whole = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
    joined = pc.binary_join(whole(names), " ")
    numbers = [_ints(x) for x in (terms // many, dfs, np.searchsorted(row, np.arange(1, n + 1)), codes, tf)]
    return [pa.array([field], pa.int32()), whole(structs), _ints(np.bincount(group)), whole(keys), joined, *numbers]


#: What a worker has made of the last broadcast.
_LAST: dict[str, object] = {}
_NAMES = ("field", "groups", "sizes", "keys", "terms", "term_group", "dfs", "ends", "codes", "tfs")


def _blocks(texts: int, by: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of the last ``texts`` columns of each piece, of ``mixed_tokens``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches, texts):
            for i in range(texts):
                yield pa.RecordBatch.from_arrays(_block(b.columns[:by], b.column(by), i, *_tokens(b.column(by + 1 + i))), names=_NAMES)

    return count


def _blocks_of_counted(by: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of (by, key, field, tokens, tfs)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for field in pc.unique(b.column("field")).to_pylist():
                f = b.filter(pc.equal(b.column("field"), field))
                tokens, at, tf = pc.list_flatten(f.column("tokens")), pc.list_parent_indices(f.column("tokens")), pc.list_flatten(f.column("tfs"))
                have = pc.is_valid(tokens)
                row, tf = (x.filter(have).to_numpy().astype(np.int64) for x in (at, tf))
                yield pa.RecordBatch.from_arrays(_block(f.columns[:by], f.column(by), field, row, tokens.filter(have), tf), names=_NAMES)

    return count


def _terms_of(b: pa.RecordBatch, i: int) -> tuple[pa.Array, np.ndarray]:
    """The terms of a block and their groups."""
    joined = b.column("terms").slice(i, 1)
    names = pc.list_flatten(pc.split_pattern(joined, " ")) if joined[0].as_py() else pa.array([], pa.string())
    return names, _read(b, "term_group", i, len(names))


def _block_frequencies(group: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(group, token, df) of each block, and a null token for its texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = []
            for i in range(b.num_rows):
                names, of = _terms_of(b, i)
                groups = b.column("groups")[i].values
                texts = _read(b, "sizes", i, len(groups))
                at = pa.array(np.concatenate([of, np.arange(len(groups))]))
                tokens, df = pa.concat_arrays([names, pa.nulls(len(groups), pa.string())]), np.concatenate([_read(b, "dfs", i, len(names)), texts])
                each.append(pa.RecordBatch.from_arrays([*[c.take(at) for c in groups.flatten()], tokens, pa.array(df, pa.int64())], names=[*group, "token", "df"]))
            if each:
                t = pa.Table.from_batches(each).group_by([*group, "token"]).aggregate([("df", "sum")])
                yield from t.select([*group, "token", "df_sum"]).rename_columns([*group, "token", "df"]).to_batches(max_chunksize=1 << 16)

    return count


def _places(known: pa.Table) -> tuple[dict[str, dict[str, int]], np.ndarray, np.ndarray, np.ndarray]:
    """The place of each token of each group, and the other columns with what an unknown token has at their end.

    A worker hashes the tokens once for all its tasks; Arrow's look-up would for each call.
    """
    if _LAST.get("known") is not known:
        places: dict[str, dict[str, int]] = {}
        for i, (of, token) in enumerate(zip(*[known.column(c).to_pylist() for c in ("of", "token")], strict=True)):
            places.setdefault(of, {})[token] = i
        _LAST.update(known=known, places=(places, *[np.append(known.column(c).to_numpy(), 0.0) for c in ("idf", "asked", "term")]))
    return _LAST["places"]


def _sums(known: Broadcast, keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(keys, d, n, h, tokens, tfs) of the texts of blocks: what their known tokens give to dot product and norm, how many of them are terms of the query, and the other tokens with their counts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, idf, asked, is_term = _places(known.value)
        for b in batches:
            for i in range(b.num_rows):
                terms, of = _terms_of(b, i)
                # The terms stand in the order of their groups.
                listed, cuts = (b.column("terms")[i].as_py() or "").split(" "), np.searchsorted(of, np.arange(len(b.column("names")[i]) + 1))
                code = np.empty(len(terms), np.int64)
                for name, lo, hi in zip(b.column("names")[i].as_py(), cuts, cuts[1:], strict=False):
                    code[lo:hi] = np.fromiter(map(places.get(name, {}).get, listed[lo:hi], repeat(-1)), np.int64, hi - lo)
                shown = b.column("keys")[i].values.flatten()
                n = len(shown[0])
                ends = _read(b, "ends", i, n)
                entries = int(ends[-1]) if n else 0
                codes, tf = _read(b, "codes", i, entries), _read(b, "tfs", i, entries)
                row = np.repeat(np.arange(n), np.diff(ends, prepend=0))
                w = tf * idf[code][codes]
                rest = np.flatnonzero((code < 0)[codes])
                at = pa.array(np.searchsorted(row[rest], np.arange(n + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(at, v) for v in (terms.take(pa.array(codes[rest])), pa.array(tf[rest], pa.int64()))]
                ask = np.flatnonzero((asked[code] > 0)[codes])
                met = code[codes[ask]]
                sums = [np.bincount(row[ask], asked[met] * idf[met] * w[ask], n), np.bincount(row, w * w, n), np.bincount(row[ask], is_term[met], n)]
                field = pa.array(np.full(n, b.column("field")[i].as_py()), pa.int32())
                yield pa.RecordBatch.from_arrays([*shown, field, *[pa.array(s.astype(float)) for s in sums], *lists], names=[*keys, "d", "n", "h", "tokens", "tfs"])

    return add


def _block_table(df: DataFrame, texts: list[str], key: str, by: list[str]) -> DataFrame:
    """The texts as written blocks. Texts move once, to the task of their key; the tokens of rows that share a key and group are added."""
    types = {f.name: f.dataType.simpleString() for f in df.select(*by, key).schema.fields}
    of = [f"g{i}: {types[c]}" for i, c in enumerate(by)]
    schema = BLOCK.format(by=", ".join([*of, "f: int"]), key=", ".join([*of, f"k: {types[key]}"]))
    blocks = cut(_moved(df, texts, key, by).mapInArrow(_blocks(len(texts), len(by)), schema), "tf")
    if not blocks.where("field = 0").select(F.inline("keys")).groupBy(*[f"g{i}" for i in range(len(by))], "k").agg(F.count("*").alias("n")).where("n > 1").take(1):
        return blocks
    return cut(counted_texts(df, texts, key, by).mapInArrow(_blocks_of_counted(len(by)), schema), "tf")


def query_similarities(df: DataFrame, texts: list[str], query: str | Mapping[str, str], key: str = "pos", by: list[str] | None = None) -> DataFrame:
    """(by, key, s0, s1, .., h0, h1, ..): cosine of each text column with the query, whose words outside that column's corpus don't count, and how many of the query's terms it has.

    A mapping has a query of its own for each value of the one column of ``by``. Terms are those of ``keyword_terms``.

    Only the query's few tokens get a share of the dot product; norms are a sum for each text, and one row a document is left.
    """
    by = by or []
    group, blocks = [*by, "field"], _block_table(df, texts, key, by)
    held = _split(blocks.select("groups", "sizes", "terms", "term_group", "dfs").mapInArrow(_block_frequencies(group), f"{_types(df, *by)}{', ' if by else ''}field int, token string, df long"), group)
    if isinstance(query, str):
        on, queries = ["token"], df.sparkSession.range(1).select(F.lit(query).alias("query"))
    else:
        on, queries = [*by, "token"], df.sparkSession.createDataFrame(list(query.items()), f"{by[0]} string, query string")
    asked = F.broadcast(queries.select(*on[:-1], F.explode(mixed_tokens(F.col("query"))).alias("token")).groupBy(*on).agg(F.count("*").alias("asked")))
    of_field = lambda i, value: F.sum(F.when(F.col("field") == i, value))

    def valued(rows: DataFrame) -> DataFrame:
        return rows.join(held.sizes, group).join(asked, on, "left").select(*rows.columns, _idf().alias("idf"), F.coalesce("asked", F.lit(0)).cast("double").alias("asked"))

    # The frequent tokens, a bounded number, and those of the query go to all tasks, and the table of texts is gone through once; its other tokens are joined.
    named = lambda *cs: F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in cs])
    own = named(*[F.col(g) for g in group])
    sent = held.frequent if held.rest is None else held.frequent.unionByName(held.rest.join(asked, on, "left_semi").select(held.frequent.columns))
    term = ((F.col("asked") > 0) & F.col("token").rlike("^[a-z0-9]{2,}$")).cast("double").alias("term")
    known = df.sparkSession.sparkContext.broadcast(valued(sent).select(own.alias("of"), "token", "idf", "asked", term).toArrow())
    keys = [*by, key, "field"]
    named_blocks = blocks.select("field", F.transform("groups", lambda g: named(*[g[f"g{i}"] for i in range(len(by))], g["f"])).alias("names"), "keys", "terms", "term_group", "ends", "codes", "tfs")
    once = named_blocks.mapInArrow(_sums(known, keys), f"{_types(df, *by, key)}, field int, d double, n double, h double, tokens array<string>, tfs array<long>")
    if held.rest is not None:
        once = cut(once, "sums")
        rare = _each(once, [*by, key]).join(held.rest.hint("shuffle_hash"), [*group, "token"]).join(held.sizes, group)
        w = F.col("tf") * _idf()
        once = once.select(*keys, "d", "n", "h").unionByName(rare.select(*keys, F.lit(0.0).alias("d"), (w * w).alias("n"), F.lit(0.0).alias("h")))
    sums = once.groupBy(*by, key).agg(*[of_field(i, F.col(p)).alias(f"{p}{i}") for p in "dnh" for i in range(len(texts))])
    # The query's norms need its tokens' frequencies alone, and no text.
    known = held.frequent if held.rest is None else held.frequent.unionByName(held.rest)
    terms = known.join(asked, on).join(held.sizes, group).withColumn("q", F.col("asked") * _idf())
    norms = terms.groupBy(*by).agg(*[of_field(i, F.col("q") * F.col("q")).alias(f"q{i}") for i in range(len(texts))])
    joined = sums.join(small(cut(norms, "norms")), by, "left") if by else sums.crossJoin(F.broadcast(norms))
    value = lambda i: F.coalesce(F.try_divide(F.col(f"d{i}"), F.sqrt(f"n{i}") * F.sqrt(f"q{i}")), F.lit(0.0))
    return joined.select(*by, key, *[value(i).alias(f"s{i}") for i in range(len(texts))], *[F.col(f"h{i}").cast("int").alias(f"h{i}") for i in range(len(texts))])


def query_similarity(df: DataFrame, text: str, query: str, key: str = "pos", by: list[str] | None = None) -> DataFrame:
    """(by, key, similarity) of one text column."""
    return query_similarities(df, [text], query, key, by).withColumnRenamed("s0", "similarity").drop("h0")
