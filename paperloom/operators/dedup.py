"""Exact and suspected duplicates of paper records.

Records are rows with pos, openalex_id, doi, title, authors and publication_year; the smallest pos stands for "first seen".
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from paperloom.functions import alike, norm
from paperloom.operators.components import components
from paperloom.store import cut, discard, free_names, small

#: Fixed values of the rule for suspected pairs.
AUTHOR_LEAST, TITLE_SURE, YEARS_APART, YEARS_UNKNOWN = 0.3, 0.80, 2, 999
#: Records of a component that one task decides in one pass.
REPLAYED = 100_000
#: Records of one title or surname that are compared with one another in a block.
SPREAD = 2_048
#: Pairs of records that one task compares, or so.
PAIRS_A_TASK = 4_000_000
#: All characters of a strict title key.
TITLE_CHARACTERS = " abcdefghijklmnopqrstuvwxyz0123456789"


def baseline(papers: DataFrame) -> DataFrame:
    """papers with kept_pos, kept_title and duplicate_reason (null for rows that stay).

    A record with a DOI is compared by DOI alone, one without by its title among those without; the first one stays. A group's
    first row is found by partial aggregation and joined back, so copies by the million need no window.
    """
    doi, title = norm.normalize_doi(F.col("doi")), norm.title_key(F.col("title"))
    key = F.when(doi != "", F.concat(F.lit("d:"), doi)).when(title != "", F.concat(F.lit("t:"), title)).otherwise(F.concat(F.lit("p:"), F.col("pos").cast("string")))
    own, first = free_names(papers.columns, "key", "first")
    keyed = papers.withColumn(own, key)
    firsts = keyed.groupBy(own).agg(F.min_by(F.struct(F.col("pos").alias("kept_pos"), F.col("title").alias("kept_title")), "pos").alias(first))
    joined = keyed.join(firsts, own).select(*papers.columns, own, f"{first}.*")
    reason = F.when(F.col("pos") == F.col("kept_pos"), None).when(F.startswith(F.col(own), F.lit("d:")), "same_doi").otherwise("same_title_no_doi")
    return joined.withColumn("duplicate_reason", reason).drop(own)


def counts(decided: DataFrame, raw: int) -> DataFrame:
    """(metric, value) of ``baseline``'s rows: raw, kept, each reason, and conserved (1 if kept and removed make up raw)."""
    by = cut(decided.groupBy(F.coalesce("duplicate_reason", F.lit("kept")).alias("metric")).agg(F.count("*").alias("value")), "counts")
    whole = by.agg((F.coalesce(F.sum("value"), F.lit(0)) == raw).cast("long").alias("value")).select(F.lit("conserved").alias("metric"), "value")
    first = by.sparkSession.range(1).select(F.lit("raw").alias("metric"), F.lit(raw).cast("long").alias("value"))
    return first.unionByName(by).unionByName(whole)


def keys_of(papers: DataFrame) -> DataFrame:
    """(pos, kind, key): the identifiers by which a record can equal another; a title only where it has no other."""
    oid, doi, title = norm.clean_text(F.col("openalex_id")), norm.normalize_doi(F.col("doi")), norm.strict_title_key(F.col("title"))
    entries = F.array(F.struct(F.lit("same_openalex_id").alias("kind"), oid.alias("key")), F.struct(F.lit("same_doi").alias("kind"), doi.alias("key")))
    entries = F.when((oid == "") & (doi == ""), F.array(F.struct(F.lit("same_title_no_id").alias("kind"), title.alias("key")))).otherwise(entries)
    return papers.select("pos", F.explode(F.filter(entries, lambda e: e["key"] != "")).alias("e")).select("pos", "e.*")


def _stars(links: DataFrame) -> DataFrame:
    """(a, b): an edge from each record of a key to the key's first one."""
    first = links.groupBy("kind", "key").agg(F.min("pos").alias("first"))
    return links.join(first, ["kind", "key"]).where("first < pos").select(F.col("pos").alias("a"), F.col("first").alias("b"))


def clusters(papers: DataFrame) -> DataFrame:
    """(pos, cluster): the smallest pos that shared identifiers reach, in rounds that grow with the logarithm of the longest path."""
    found = components(_stars(keys_of(papers)))
    return papers.select("pos").join(found, F.col("pos") == F.col("node"), "left").select("pos", F.coalesce("component", "pos").alias("cluster"))


def exact_merge(papers: DataFrame) -> DataFrame:
    """(pos, cluster, kept_pos, reason, conflict): transitive duplicates, where all records of a cluster are one.

    A record whose every key is first seen with it founds an entity; a cluster with two founders is a conflict, as some record
    names both. reason is null for the record that stays.
    """
    links = keys_of(papers)
    first = links.groupBy("kind", "key").agg(F.min("pos").alias("first"))
    seen = links.join(first, ["kind", "key"])
    per_row = seen.groupBy("pos").agg(
        F.min((F.col("first") == F.col("pos")).cast("int")).alias("founder"),
        F.max(F.when(F.col("first") < F.col("pos"), F.when(F.col("kind") == "same_openalex_id", 3).when(F.col("kind") == "same_doi", 2).otherwise(1))).alias("why"),
    )
    rows = clusters(papers).join(per_row, "pos", "left").withColumn("founder", F.coalesce("founder", F.lit(1)))
    founders = rows.groupBy("cluster").agg(F.sum("founder").alias("founders"))
    reason = F.when(F.col("pos") == F.col("cluster"), None).when(F.col("why") == 3, "same_openalex_id").when(F.col("why") == 2, "same_doi").when(F.col("why") == 1, "same_title_no_id")
    return rows.join(founders, "cluster").select("pos", "cluster", F.col("cluster").alias("kept_pos"), reason.alias("reason"), (F.col("founders") > 1).alias("conflict"))


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Decisions over rows (cluster, pos, kinds, keys) that come sorted by cluster and pos; only the cluster at hand is kept."""
    cluster, owners = None, {}
    for b in batches:
        kept, reason = [], []
        for c, pos, kinds, keys in zip(b["cluster"], b["pos"], b["kinds"], b["keys"], strict=True):
            if c != cluster:
                cluster, owners = c, {}
            own = list(zip(kinds, keys, strict=True))
            hit = next((k for k in own if k in owners), None)
            if hit is None:
                owners.update(dict.fromkeys(own, pos))
            kept.append(owners[hit] if hit else pos)
            reason.append(hit[0] if hit else None)
        yield pd.DataFrame({"pos": b["pos"], "kept_pos": kept, "reason": reason})


def _in_rounds(links: DataFrame) -> DataFrame:
    """(pos, kept_pos, reason) of the records of links, all at once.

    A record stays when it comes first among the undecided ones under each of its keys, and goes when a record that stays has one
    of them; so each round decides all records that wait for no earlier one, an aggregate of each key.
    """
    open_, kept = links, []
    while True:
        first = open_.groupBy("kind", "key").agg(F.min("pos").alias("first"))
        waits = open_.join(first, ["kind", "key"]).groupBy("pos").agg(F.max(F.col("first") < F.col("pos")).alias("waits"))
        staying = cut(open_.join(waits.where("NOT waits").select("pos"), "pos", "left_semi"), "staying")
        kept.append(staying)
        gone = open_.join(staying.select("kind", "key"), ["kind", "key"], "left_semi").select("pos").distinct()
        left = cut(open_.join(gone, "pos", "left_anti"), "open")
        if open_ is not links:
            discard(open_)
        open_ = left
        if not open_.take(1):
            break
        if len(kept) == 64:
            kept = [cut(reduce(DataFrame.unionByName, kept), "kept")]
    # A key belongs to one record that stays, which may come after one that went for another key.
    owners = reduce(DataFrame.unionByName, kept).select("kind", "key", F.col("pos").alias("owner"))
    met = links.join(owners, ["kind", "key"]).where("owner <= pos")
    best = met.groupBy("pos").agg(F.min(F.struct(_turn(F.col("kind")).alias("o"), "owner", "kind")).alias("b"))
    stays = F.col("b.owner") == F.col("pos")
    return best.select("pos", F.col("b.owner").alias("kept_pos"), F.when(~stays, F.col("b.kind")).alias("reason"))


def _turn(kind: Column) -> Column:
    """The order in which a record's keys are asked for."""
    return F.when(kind == "same_openalex_id", 1).when(kind == "same_doi", 2).otherwise(3)


def exact_default(papers: DataFrame, replayed: int = REPLAYED) -> DataFrame:
    """(pos, kept_pos, reason): greedy duplicates in the order of pos, where a duplicate doesn't lend its other identifiers.

    Only records that identifiers connect can decide over one another. Components of up to ``replayed`` records are each gone through
    in one pass of a task, which holds no more than the one at hand; larger ones are decided in rounds that gather nothing, as
    many as records wait for one another in a chain.
    """
    links = cut(keys_of(papers), "links")
    joined = cut(components(_stars(links)), "clusters")
    sizes = joined.groupBy(F.col("component").alias("c")).agg(F.count("*").alias("n"))
    sized = cut(joined.join(sizes, F.col("component") == F.col("c")).select(F.col("node"), F.col("component").alias("cluster"), (F.col("n") > replayed).alias("large")), "sized")
    linked = links.join(sized, F.col("pos") == F.col("node"))
    small = linked.where("NOT large").groupBy("cluster", "pos").agg(F.array_sort(F.collect_list(F.struct(_turn(F.col("kind")).alias("o"), "kind", "key"))).alias("ks"))
    small = small.repartition("cluster").sortWithinPartitions("cluster", "pos").select("cluster", "pos", F.col("ks.kind").alias("kinds"), F.col("ks.key").alias("keys"))
    decided = small.mapInPandas(_replay, "pos long, kept_pos long, reason string")
    if sized.where("large").take(1):
        decided = decided.unionByName(_in_rounds(cut(linked.where("large").select("pos", "kind", "key"), "large")))
    decided = decided.select(F.col("pos").alias("p"), F.col("kept_pos").alias("k"), "reason")
    return papers.select("pos").join(decided, F.col("pos") == F.col("p"), "left").select("pos", F.coalesce("k", "pos").alias("kept_pos"), "reason")


def duplicate_records(papers: DataFrame, decided: DataFrame, merged_at: str) -> DataFrame:
    """A record for each row that goes: rule, kept and merged id and title, keywords and runs of both (kept first), and the time.

    papers: pos, openalex_id, title, keyword, run_id. decided: pos, kept_pos, reason.
    """
    of = lambda side: papers.select(F.struct("pos", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("openalex_id", "title", "keyword", "run_id")]).alias(side))
    gone = decided.where("reason IS NOT NULL").select(F.col("pos").alias("gone"), "kept_pos", "reason")
    both = gone.join(of("m"), F.col("gone") == F.col("m.pos")).join(of("k"), F.col("kept_pos") == F.col("k.pos"))
    return both.select(
        F.col("reason").alias("rule"),
        F.col("k.openalex_id").alias("kept_openalex_id"),
        F.col("k.title").alias("kept_title"),
        F.col("m.openalex_id").alias("merged_openalex_id"),
        F.col("m.title").alias("merged_title"),
        F.array("k.keyword", "m.keyword").alias("source_keyword"),
        F.array("k.run_id", "m.run_id").alias("source_run_id"),
        F.lit(merged_at).alias("merged_at"),
    )


def merge_provenance(papers: DataFrame, entity: str, column: str) -> DataFrame:
    """(entity, column): the distinct non-blank values of an array column in the order in which they were first seen."""
    values = papers.select(entity, "pos", F.posexplode(column).alias("i", "v")).where(~norm.is_missing(F.col("v")))
    first = values.groupBy(entity, "v").agg(F.min(F.struct("pos", "i")).alias("at"))
    ordered = first.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("vs"))
    return papers.select(entity).distinct().join(ordered, entity, "left").select(entity, F.coalesce(F.transform("vs", lambda s: s["v"]), F.array().cast("array<string>")).alias(column))


def doi_relation(a: Column, b: Column) -> Column:
    archive = lambda c: F.startswith(c, F.lit("10.48550/")) | F.contains(c, F.lit("arxiv"))
    return (
        F.when((a == "") & (b == ""), "both_missing")
        .when((a == "") | (b == ""), "one_missing")
        .when(a == b, "both_present_same")
        .when(archive(a) != archive(b), "one_arxiv_one_publisher")
        .otherwise("both_present_different")
    )


#: The tags of a pair, by title, authors, years and DOIs.
TAGS = (
    ("title_very_high_similarity", "title_high_similarity", "title_moderate_similarity"),
    ("author_high_overlap", "author_moderate_overlap", "author_low_overlap"),
    ("year_close", "year_nearby", "year_uncertain"),
    ("", "preprint_publisher_pair"),
)


def pair_reason(jaccard: Column, sequence: Column, authors: Column, years: Column, relation: Column) -> Column:
    # The bounds of the tags. All texts are made beforehand, as pairs are many.
    title = F.when((jaccard >= 0.90) | (sequence >= 0.95), 0).when((jaccard >= 0.70) | (sequence >= 0.85), 1).otherwise(2)
    author = F.when(authors >= 0.70, 0).when(authors >= 0.30, 1).otherwise(2)
    year = F.when(years <= 1, 0).when(years <= 2, 1).otherwise(2)
    told = F.array(*[F.lit("|".join(t for t in tags if t)) for tags in product(*TAGS)])
    return F.get(told, ((title * 3 + author) * 3 + year) * 2 + F.when(relation == "one_arxiv_one_publisher", 1).otherwise(0))


def _all_fields(papers: DataFrame) -> DataFrame:
    key = norm.strict_title_key(F.col("title"))
    return papers.select(
        "pos",
        norm.clean_text(F.col("openalex_id")).alias("oid"),
        norm.normalize_doi(F.col("doi")).alias("doi"),
        F.col("publication_year").alias("year"),
        key.alias("title"),
        norm.title_tokens(key).alias("tokens"),
        norm.surnames(F.col("authors")).alias("surnames"),
    )


def _fields(papers: DataFrame) -> DataFrame:
    return _all_fields(papers).where("title <> ''")


@F.pandas_udf(DoubleType())
def sequence_similarity(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Matching-blocks similarity of (earlier, later) titles, which isn't symmetric, where it is ``least`` at least; else 0."""
    for left, right, least in batches:
        yield pd.Series(alike.ratios(left, right, least))


def _prefix(least: float) -> Column:
    """The rarest tokens of a title, of which sets with a Jaccard similarity of ``least`` have one in common; rare ones come first."""
    n = F.size("rare")
    # Less by a hair, for products of doubles that a whole number should be.
    return F.slice("rare", F.lit(1), F.greatest(F.lit(0), F.least(n, n - F.ceil(n * F.lit(least) - 1e-9) + 1)).cast("int"))


def _with_rare(titles: DataFrame) -> DataFrame:
    """(tid, rare): the tokens of each title in the order of their rarity among titles, ties by the token."""
    tokens = titles.select("tid", F.explode(norm.title_tokens(F.col("title"))).alias("token"))
    rarity = tokens.groupBy("token").agg(F.count("*").alias("df"))
    listed = tokens.join(rarity, "token").groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("r"))
    return listed.select("tid", F.col("r.token").alias("rare"))


def _shared(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeats; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both), F.lit(0.0))


def _mark(names: Column) -> Column:
    """64 bits, of which each name sets one: names are in common only where bits are."""
    return F.aggregate(names, F.lit(0).cast("long"), lambda t, v: t.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(v), F.lit(64)).cast("int"))))


def _may_pair(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    """The rules on ids, DOIs and years."""
    same_id = (x("oid") != "") & (x("oid") == y("oid"))
    dois = (x("doi") == "") | (y("doi") == "") | (x("doi") == y("doi"))
    # Numbers first, as they cost least.
    return (x("year").isNull() | y("year").isNull() | (F.abs(x("year") - y("year")) <= YEARS_APART)) & dois & ~same_id


def characters_in_common(a: Column, b: Column) -> Column:
    """Characters that two texts share, each as often as in both, from their counts; the matching blocks hold no more."""
    return F.aggregate(F.zip_with(a, b, lambda u, v: F.least(u, v)), F.lit(0), lambda t, v: t + v)


def _dealt(rows: DataFrame, n: str) -> DataFrame:
    """rows with ``block``, one of as many as the key's ``n`` rows need, and their number."""
    blocks = F.ceil(F.col(n) / SPREAD).cast("int")
    return rows.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("pos"), blocks).cast("int")})


def _tasks(rows: DataFrame, pairs: float | None) -> int:
    """Tasks for so many pairs of rows: exchanges are even in pairs, not in bytes, so their sizes tell nothing."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil((pairs or 0) / PAIRS_A_TASK))


def _within(rows: DataFrame, key: str, on: Column, tasks: int) -> DataFrame:
    """All pairs a, b of dealt rows that share the key, each once and in either order; two blocks meet in one place, so a key with most of the rows is many tasks."""
    one = rows.withColumns({"low": F.col("block"), "high": F.explode(F.sequence("block", F.col("blocks") - 1))})
    two = rows.withColumns({"high": F.col("block"), "low": F.explode(F.sequence(F.lit(0), F.col("block")))})
    met = [key, "low", "high"]
    one, two = (t.repartition(tasks, *met).alias(n) for t, n in ((one, "a"), (two, "b")))
    once = (F.col("a.low") < F.col("a.high")) | (F.col("a.pos") < F.col("b.pos"))
    return one.join(two, reduce(lambda u, v: u & v, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in met]) & once & on)


#: What is told of a record of a pair.
SHOWN = ("pos", "oid", "doi", "year")


def _told(jaccard: Column, authors: Column, sequence: Column | None) -> list[Column]:
    """The columns of a pair of a and b, the earlier record first: its ratio, or both titles where that is still to be worked out."""
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    ordered = x("pos") < y("pos")
    shown = [*SHOWN, *(["title"] if sequence is None else [])]
    side = lambda p, first: [F.when(ordered == first, x(c)).otherwise(y(c)).alias(f"{p}_{c}") for c in shown]
    years = F.coalesce(F.abs(x("year") - y("year")), F.lit(YEARS_UNKNOWN)).alias("year_difference")
    return [*side("l", F.lit(True)), *side("r", F.lit(False)), years, jaccard.alias("jaccard"), authors.alias("author_overlap"), *([] if sequence is None else [sequence.alias("sequence")])]


def _asked(jaccard_least: float, sequence_least: float) -> Column:
    """The ratio from which on it matters to a pair, as one below the Jaccard similarity changes nothing."""
    return F.when(F.col("jaccard") >= jaccard_least, F.col("jaccard")).otherwise(F.lit(float(sequence_least)))


def candidate_pairs(papers: DataFrame, jaccard_least: float = 0.5, sequence_least: float = 0.65) -> DataFrame:
    """All pairs that the rules on years, ids, DOIs and authors let through and whose titles may be alike enough, each once.

    Columns: l_ and r_ with the fields of the earlier and the later record, year_difference, jaccard, author_overlap, sequence (0 where it
    changes nothing). Titles are compared once, whatever their copies; only numbers and short fields move by the tokens of a title, and its
    text once for each pair of titles that may be alike, never with their records. A pair comes by one of four ways, so none comes twice:

    1. one title: its records meet in blocks of SPREAD rows;
    2. a title Jaccard of TITLE_SURE: titles have a token in common among the rarest of both; then their records meet, in blocks too;
    3. less than that, but ``jaccard_least``, and an author overlap: records share a surname and a rare token;
    4. less than that too, an author overlap, and a matching-blocks ratio of ``sequence_least``. The ratio is at most 2 x characters in
       common / length of both, hence lengths are alike. Records of a surname are compared in blocks: by rules and lengths, then many titles
       at once by their bounds (see ``alike.ratios``).

    Nothing is dropped for a frequent title, surname or token.
    """
    # Written, as the key of a title is several regular expressions, which both readers and a test for blank ones would work out again.
    f = cut(_all_fields(papers).select(*SHOWN, "title", F.array_distinct("surnames").alias("names")), "fields").where("title <> ''").withColumn("digest", F.substring(F.unhex(F.sha2("title", 256)), 1, 16))
    titles = f.groupBy("digest").agg(F.first("title").alias("title"), F.count("*").alias("copies")).withColumn("tid", F.monotonically_increasing_id())
    titles = cut(titles, "titles")
    of_title = titles.select("digest", "tid", "copies", (F.size(norm.title_tokens(F.col("title"))) > 0).alias("told"))
    records = cut(_dealt(f.select(*SHOWN, "names", _mark(F.col("names")).alias("mark"), "digest").join(of_title, "digest").drop("digest"), "copies"), "records")
    titles = titles.select("tid", "title", "copies")
    prefixes = cut(_with_rare(titles), "rare")
    anything = jaccard_least <= 0 or sequence_least <= 0
    texts = sequence_least <= 1 or anything
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    other = _may_pair(x, y)
    authors = F.when(x("mark").bitwiseAND(y("mark")) == 0, 0.0).otherwise(_shared(x("names"), y("names")))

    # One title: its tokens are in common, or it has none and the ratio of 1 decides, which asks for authors.
    wordless = (authors >= AUTHOR_LEAST) if texts else F.lit(False)
    copies = titles.where("copies > 1").agg(F.sum(F.col("copies").cast("double") * F.col("copies") / 2)).collect()[0][0]
    same = _within(records.where("copies > 1"), "tid", other & (x("told") | wordless), _tasks(records, copies)).select(*_told(x("told").cast("double"), authors, F.lit(1.0)))

    # Two titles as alike as TITLE_SURE, each pair of titles once with its ratio in either order; then their records, those of the rarer title sent to the other's blocks.
    n = F.size("rare")
    head = lambda least: prefixes.select("tid", n.cast("int").alias("n"), F.posexplode(_prefix(least)).alias("i", "token"))

    def near(least: float) -> Column:
        # The shared token's places bound what the sets have in common.
        most = 1 + F.least(x("n") - 1 - x("i"), y("n") - 1 - y("i"))
        return (F.least(x("n"), y("n")) >= F.greatest(x("n"), y("n")) * F.lit(least) - 1e-9) & (most >= (x("n") + y("n")) * F.lit(least / (1 + least)) - 1e-6)

    sure = head(TITLE_SURE)
    met = sure.alias("a").join(sure.alias("b"), (x("token") == y("token")) & (x("tid") < y("tid")) & near(TITLE_SURE)).select(x("tid").alias("ta"), y("tid").alias("tb")).distinct()
    of = lambda p: titles.select(F.col("tid").alias(f"t{p}"), F.col("title").alias(f"title_{p}"), F.col("copies").alias(f"n{p}"))
    token_overlap = _shared(norm.title_tokens(F.col("title_a")), norm.title_tokens(F.col("title_b")))
    turned = F.col("na") > F.col("nb")
    pick = lambda p, q, c: F.when(turned, F.col(q)).otherwise(F.col(p)).alias(c)
    twins = met.join(of("a"), "ta").join(of("b"), "tb").withColumn("jaccard", token_overlap).where(F.col("jaccard") >= TITLE_SURE)
    twins = cut(twins.select(pick("ta", "tb", "few"), pick("tb", "ta", "many"), F.greatest("na", "nb").alias("n_many"), "jaccard"), "twins")

    def crossed(twins: DataFrame) -> DataFrame:
        rare = twins.join(records.drop("block", "blocks", "copies"), F.col("few") == F.col("tid"))
        rare = rare.withColumn("to", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_many") / SPREAD).cast("int") - 1)))
        return rare.alias("a").join(records.alias("b"), (x("many") == y("tid")) & (x("to") == y("block")) & other)

    if texts:
        # The ratio is asked for only in an order in which the rules let records of both titles meet.
        ways = crossed(twins).groupBy("few", "many", "jaccard", "n_many").agg(*[F.max(F.col("a.pos") < F.col("b.pos")).alias("forth"), F.max(F.col("a.pos") > F.col("b.pos")).alias("back")])
        ways = ways.join(titles.select(F.col("tid").alias("few"), F.col("title").alias("title_few")), "few").join(titles.select(F.col("tid").alias("many"), F.col("title").alias("title_many")), "many")
        least = lambda way: F.when(F.col(way), _asked(jaccard_least, sequence_least)).otherwise(F.lit(2.0))
        told = {"few_first": sequence_similarity("title_few", "title_many", least("forth")), "many_first": sequence_similarity("title_many", "title_few", least("back"))}
        twins = cut(ways.withColumns(told).drop("title_few", "title_many", "forth", "back"), "ratios")
    else:
        twins = twins.withColumns({"few_first": F.lit(0.0), "many_first": F.lit(0.0)})
    cross = crossed(twins)
    known = [same, cross.select(*_told(x("jaccard"), authors, F.when(x("pos") < y("pos"), x("few_first")).otherwise(x("many_first"))))]

    if not anything:
        # Less alike, but with an author in common: a surname and a rare token meet, by numbers alone; what they are is asked again.
        short = records.select("pos", "tid", "year", "names", *[F.when(F.col(c) != "", F.xxhash64(c)).otherwise(F.lit(0)).alias(c) for c in ("oid", "doi")])
        named = short.join(head(jaccard_least), "tid").select("pos", "tid", "year", "oid", "doi", "n", "i", F.explode("names").alias("surname"), "token")
        named = named.select("pos", "tid", "year", "oid", "doi", "n", "i", F.xxhash64("surname", "token").alias("key"))
        may = ((x("oid") == 0) | (x("oid") != y("oid"))) & ((x("doi") == 0) | (y("doi") == 0) | (x("doi") == y("doi"))) & (x("year").isNull() | y("year").isNull() | (F.abs(x("year") - y("year")) <= YEARS_APART))
        met = named.alias("a").join(named.alias("b"), (x("key") == y("key")) & (x("pos") < y("pos")) & (x("tid") != y("tid")) & may & near(min(jaccard_least, TITLE_SURE)))
        met = cut(met.select(x("pos").alias("pa"), x("tid").alias("ta"), y("pos").alias("pb"), y("tid").alias("tb")).distinct(), "met")
        full = lambda p: titles.select(F.col("tid").alias(f"t{p}"), F.col("title").alias(f"title_{p}"))
        token_sets = met.select("ta", "tb").distinct().join(full("a"), "ta").join(full("b"), "tb").withColumn("jaccard", token_overlap).where((F.col("jaccard") >= jaccard_least) & (F.col("jaccard") < TITLE_SURE))
        sequence = sequence_similarity("title_a", "title_b", _asked(jaccard_least, sequence_least)) if texts else F.lit(0.0)
        token_sets = cut(token_sets.withColumn("sequence", sequence).select("ta", "tb", "jaccard", "sequence"), "token_sets")
        side = lambda p: records.select(F.col("pos").alias(f"p{p}"), F.struct(*SHOWN, "names", "mark").alias(p))
        both = met.join(token_sets, ["ta", "tb"]).join(side("a"), "pa").join(side("b"), "pb")
        known.append(both.where(other & (authors >= AUTHOR_LEAST)).select(*_told(F.col("jaccard"), authors, F.col("sequence"))))
    if texts:
        rows = records.select(*SHOWN, "tid", "names", "mark", F.explode("names").alias("surname")).join(titles.select("tid", "title"), "tid").withColumn("n", F.length("title"))
        sizes = cut(rows.groupBy(F.col("surname").alias("s")).agg(F.count("*").alias("rows")), "surnames")
        rows = cut(_dealt(rows.join(small(sizes), F.col("surname") == F.col("s")), "rows").drop("s", "rows"), "named")
        fits = F.lit(True) if anything else 2.0 * F.least(x("n"), y("n")) / (x("n") + y("n")) >= sequence_least
        least_name = F.array_min(F.array_intersect(x("names"), y("names"))) == x("surname")
        met = sizes.agg(F.sum(F.col("rows").cast("double") * F.col("rows") / 2)).collect()[0][0]
        apart = _within(rows, "surname", (x("tid") != y("tid")) & other & fits & (authors >= AUTHOR_LEAST) & least_name, _tasks(records, met))
        apart = apart.select(*_told(F.lit(None).cast("double"), authors, None))
        overlap = _shared(norm.title_tokens(F.col("l_title")), norm.title_tokens(F.col("r_title")))
        sequence = lambda least: sequence_similarity("l_title", "r_title", least)
        if anything:
            apart = apart.withColumn("jaccard", overlap).withColumn("sequence", sequence(_asked(jaccard_least, sequence_least))).where(F.col("jaccard") < TITLE_SURE)
        else:
            # Tokens are looked at only where the ratio suffices, which is seldom.
            apart = apart.withColumn("sequence", sequence(F.lit(float(sequence_least)))).withColumn("jaccard", F.when(F.col("sequence") >= sequence_least, overlap))
            apart = apart.where(F.col("jaccard") < min(jaccard_least, TITLE_SURE))
        known.append(apart.drop("l_title", "r_title"))
    return reduce(DataFrame.unionByName, known)


def suspected(papers: DataFrame, jaccard_least: float = 0.5, sequence_least: float = 0.65, with_sequence: bool = True) -> DataFrame:
    """Pairs for review: pair_id, i, j, title_similarity, author_overlap, year_difference, doi_relation, reason.

    The matching-blocks ratio, which is Python, runs once on each pair of titles that are alike by their tokens, whatever their copies and only
    where the rules let records of both meet, and else only on pairs that all other rules and its bounds let through.
    """
    pairs = candidate_pairs(papers, jaccard_least, sequence_least if with_sequence else 2.0)
    if with_sequence:
        pairs = pairs.where((F.col("jaccard") >= jaccard_least) | (F.col("sequence") >= sequence_least))
    else:
        pairs = pairs.where(F.col("jaccard") >= jaccard_least).withColumn("sequence", F.lit(0.0))
    return pairs.select(
        norm.pair_id(F.coalesce(F.nullif(F.col("l_oid"), F.lit("")), F.col("l_pos").cast("string")), F.coalesce(F.nullif(F.col("r_oid"), F.lit("")), F.col("r_pos").cast("string"))).alias("pair_id"),
        F.col("l_pos").alias("i"),
        F.col("r_pos").alias("j"),
        F.greatest("jaccard", "sequence").alias("title_similarity"),
        "author_overlap",
        "year_difference",
        doi_relation(F.col("l_doi"), F.col("r_doi")).alias("doi_relation"),
        pair_reason(F.col("jaccard"), F.col("sequence"), F.col("author_overlap"), F.col("year_difference"), doi_relation(F.col("l_doi"), F.col("r_doi"))).alias("reason"),
    )


def apply_reviews(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """queue (pair_id, review_status, action) after decisions (pair_id, decision, seq): y confirms, n parts, others skip; the last counts."""
    last = decisions.where(F.lower("decision").isin("y", "n")).groupBy("pair_id").agg(F.max_by(F.lower("decision"), "seq").alias("d"))
    joined = queue.join(last, "pair_id", "left")
    pending = F.col("review_status") == "pending"
    status = F.when(pending & (F.col("d") == "y"), "confirmed").when(pending & (F.col("d") == "n"), "distinct").otherwise(F.col("review_status"))
    action = F.when(pending & (F.col("d") == "y"), "merge").when(pending & (F.col("d") == "n"), "keep_separate").otherwise(F.col("action"))
    return joined.withColumns({"review_status": status, "action": action}).drop("d")
