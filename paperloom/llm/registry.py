"""The queries of this folder and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.store import small

from . import bpe, chat, codes, exact, lines, mixing, ngram, quality, sharding, snapshot, sstable, urls, vectors
from .shared import cut, table

Query = Callable[[SparkSession, str], DataFrame]
SHARDS = 40
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


URL_RULES = [
    (urls.ALLOW, "com", "/"),
    (urls.BLOCK, "example.com", "/en/"),
    (urls.ALLOW, "www.example.com", "/en/"),
    (urls.BLOCK, "net", "/es/"),
    (urls.BLOCK, "net", "/fr/"),
]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text")
    )
    out = chat.format_chat(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    out = out.withColumn("turns", chat.parse_chat(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), o AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS previous,
    replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\e') AS e,
    replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\e'), ':', '\c') AS r
  FROM t
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length(e) + 7 + CASE WHEN previous IS NULL OR previous <> role THEN length(r) + 6 ELSE 0 END) AS formatted_chars
  FROM o GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


#: By brute force, which the index equals where it finds every pair.
OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, reached) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r AS (
  SELECT *, '.' || host AS h FROM p
)
SELECT page_id, host, path,
  CASE WHEN ends_with(h, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ends_with(h, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ends_with(h, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ends_with(h, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ends_with(h, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
  CASE WHEN ends_with(h, '.www.example.com') AND starts_with(path, '/en/') THEN 'allow'
    WHEN ends_with(h, '.example.com') AND starts_with(path, '/en/') THEN 'block'
    WHEN ends_with(h, '.net') AND (starts_with(path, '/es/') OR starts_with(path, '/fr/')) THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""


def op8_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.read_tokens(spark, sstable.write_tokens(table(spark, sf_dir, "documents"), vocabulary_path()))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    ('0x' || substr(md5(concat_ws(':', '23', CAST(doc_id AS VARCHAR), md5(text))), 1, 10))::BIGINT / 1099511627776.0::DOUBLE AS u FROM documents),
b AS (SELECT *, CAST(floor(u * 4096) AS INTEGER) AS bin, coalesce('=' || source, '') AS skey FROM s),
t AS (SELECT skey, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM b GROUP BY skey),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 3 AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM t),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM w),
c AS (SELECT *, cap * after <= (total - before) * weight AS clamped FROM o),
g AS (SELECT skey, source_size, CASE WHEN clamped THEN CAST(cap AS DOUBLE) ELSE (total - coalesce(sum(cap) FILTER (clamped) OVER (), 0)) * weight / sum(weight) FILTER (NOT clamped) OVER () END AS target FROM c),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g),
m AS (SELECT *, target - whole * source_size AS more FROM p),
f AS (SELECT skey, bin, sum(words) OVER (PARTITION BY skey ORDER BY bin) AS through FROM (SELECT skey, bin, sum(size) AS words FROM b GROUP BY skey, bin)),
a AS (SELECT skey, max(bin) FILTER (through <= more) AS last_bin, max(through) FILTER (through <= more) AS spent, min(bin) FILTER (through > more) AS edge FROM m JOIN f USING (skey) GROUP BY skey),
e AS (SELECT m.skey, source_size, target, whole, coalesce(last_bin, -1) AS last_bin, more - coalesce(spent, 0) AS rest, edge FROM m LEFT JOIN a USING (skey)),
j AS (SELECT b.doc_id, b.size, b.bin, e.*, sum(b.size) OVER (PARTITION BY b.skey, b.bin ORDER BY b.u, b.doc_id ROWS UNBOUNDED PRECEDING) AS run FROM b JOIN e USING (skey))
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN whole < 3 AND (CASE WHEN edge IS NOT NULL AND bin = edge THEN run - size / 2.0 <= rest ELSE bin <= last_bin END) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM j
"""


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""


def later_snapshot(docs: DataFrame) -> DataFrame:
    """The later snapshot of the contract: crc32 of the decimal doc_id modulo 16 changes rows; a null id changes nothing."""
    rows = docs.select("doc_id", "text", "lang", "source").withColumn("m", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 16, F.lit(-1)))
    moved = -1 - F.col("doc_id")
    keys = F.when(F.col("m") == 0, F.array().cast("array<long>")).when(F.col("m").isin(3, 4), F.array(moved)).when(F.col("m") == 5, F.array(F.col("doc_id"), moved)).otherwise(F.array("doc_id"))
    return rows.select(
        F.explode(keys).alias("doc_id"),
        F.when(F.col("m") == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(F.col("m") == 2, F.col("source")).otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("m") == 2, F.col("lang")).when(F.col("m") != 4, F.col("source")).alias("source"),
    )


def op11_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    shown = F.concat_ws("\n", *[F.coalesce(c, F.lit("~")) for c in ("text", "lang", "source")])
    found = snapshot.snapshot_diff(docs, later_snapshot(docs), carry={"row_sha": F.unhex(F.sha2(shown, 256))})
    return found.select("key", "old_key", "op", "changed", F.lower(F.hex("row_sha")).alias("row_sha256"))


OP11_SQL = r"""
WITH steps AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
m AS (SELECT doc_id, text, lang, source, coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 16, -1) AS m FROM documents, steps),
later AS (
  SELECT CASE WHEN m IN (3, 4) THEN -1 - doc_id ELSE doc_id END AS k, CASE WHEN m = 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
    CASE WHEN m = 2 THEN source ELSE lang END AS lang, CASE WHEN m = 2 THEN lang WHEN m = 4 THEN NULL ELSE source END AS source FROM m WHERE m <> 0
  UNION ALL SELECT -1 - doc_id, text, lang, source FROM m WHERE m = 5),
earlier AS (SELECT doc_id AS k, text, lang, source FROM documents),
same AS (SELECT l.k AS key, e.k AS old_key, e.text AS t0, e.lang AS l0, e.source AS s0, l.text, l.lang, l.source FROM earlier e JOIN later l ON e.k IS NOT DISTINCT FROM l.k),
e AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY k) AS i FROM earlier WHERE k NOT IN (SELECT k FROM later WHERE k IS NOT NULL)),
l AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY k) AS i FROM later WHERE k NOT IN (SELECT k FROM earlier WHERE k IS NOT NULL)),
met AS (SELECT l.k AS key, e.k AS old_key, e.text AS t0, e.lang AS l0, e.source AS s0, l.text, l.lang, l.source FROM e FULL JOIN l ON e.text IS NOT DISTINCT FROM l.text AND e.i = l.i),
u AS (SELECT *, true AS by_key FROM same UNION ALL SELECT *, false FROM met),
c AS (SELECT *, CASE WHEN key IS NULL OR old_key IS NULL THEN '' ELSE concat_ws(',', CASE WHEN t0 IS DISTINCT FROM text THEN 'text' END, CASE WHEN l0 IS DISTINCT FROM lang THEN 'lang' END,
    CASE WHEN s0 IS DISTINCT FROM source THEN 'source' END) END AS changed FROM u)
SELECT coalesce(key, old_key) AS key, old_key, CASE WHEN by_key AND changed = '' THEN 'same' WHEN by_key THEN 'update' WHEN key IS NULL THEN 'delete' WHEN old_key IS NULL THEN 'insert' ELSE 'rekey' END AS op, changed,
  CASE WHEN key IS NOT NULL THEN sha256(coalesce(text, '~') || chr(10) || coalesce(lang, '~') || chr(10) || coalesce(source, '~')) END AS row_sha256
FROM c
"""


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (holder <> doc_id) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (holder IS NULL OR holder = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codes.compress(table(spark, sf_dir, "embeddings"))
    rows = cut(found.rows, "codes")
    by_label = cut(rows.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")), "label-errors")
    books = hashlib.sha256(codes.books_text(found.books).encode()).hexdigest()
    return rows.join(small(by_label), F.col("label").eqNullSafe(F.col("l"))).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books).alias("codebooks_sha256"))


def _op13_sql() -> str:
    """Rounds are written out: near{r} assigns by book{r}, book{r + 1} follows from it."""
    steps = []
    for r in range(codes.ROUNDS + 1):
        steps.append(
            f"far{r} AS (SELECT q.vec_id, q.p, min(list_sum(list_transform(range(1, len(q.x) + 1), lambda j: (q.x[j] - b.c[j]) * (q.x[j] - b.c[j]))) * 256 + b.i)::BIGINT AS best FROM q JOIN book{r} b ON b.p = q.p GROUP BY q.vec_id, q.p)"
        )
        steps.append(f"near{r} AS MATERIALIZED (SELECT vec_id, p, best % 256 AS i, best // 256 AS error FROM far{r})")
        if r < codes.ROUNDS:
            steps.append(f"comps{r} AS (SELECT n.p, n.i, unnest(q.x) AS v, generate_subscripts(q.x, 1) AS j FROM near{r} n JOIN q ON q.vec_id = n.vec_id AND q.p = n.p)")
            steps.append(f"means{r} AS (SELECT p, i, list(m ORDER BY j) AS c FROM (SELECT p, i, j, CAST(floor(sum(v)::DOUBLE / count(*)) AS BIGINT) AS m FROM comps{r} GROUP BY p, i, j) GROUP BY p, i)")
            steps.append(f"book{r + 1} AS MATERIALIZED (SELECT b.p, b.i, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN means{r} m ON m.p = b.p AND m.i = b.i)")
    end = codes.ROUNDS
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 1024) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT vec_id, p, e[p * len(e) // 4 + 1 : (p + 1) * len(e) // 4] AS x FROM v, range(4) r(p)),
seed AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM v QUALIFY i < 256),
book0 AS MATERIALIZED (SELECT q.p, s.i, q.x AS c FROM seed s JOIN q USING (vec_id)),
{", ".join(steps)},
told AS (SELECT vec_id, string_agg(printf('%02x', i), '' ORDER BY p) AS code, CAST(sum(error) AS BIGINT) AS error FROM near{end} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, i)) FROM book{end}) AS codebooks_sha256
FROM told JOIN v USING (vec_id)
"""


OP13_SQL = _op13_sql()


def queries() -> dict[str, Query]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_bpe": op3_bpe,
        "op4_quality": op4_quality,
        "op5_embedding_near_dedup": op5_embedding_near_dedup,
        "op6_sharding": op6_sharding,
        "op7_url_filter": op7_url_filter,
        "op8_token_table": op8_token_table,
        "op9_mixing": op9_mixing,
        "op10_ngram_jaccard": op10_ngram_jaccard,
        "op11_snapshot_diff": op11_snapshot_diff,
        "op12_line_dedup": op12_line_dedup,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": OP1_SQL,
        "op2_exact_dedup": OP2_SQL,
        "op5_embedding_near_dedup": OP5_SQL,
        "op7_url_filter": OP7_SQL,
        "op9_mixing": OP9_SQL,
        "op10_ngram_jaccard": OP10_SQL,
        "op11_snapshot_diff": OP11_SQL,
        "op12_line_dedup": OP12_SQL,
        "op13_vector_codes": OP13_SQL,
    }
