"""Rule-based scores and two-stage ranking."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.norm import floor4, is_missing
from paperloom.functions.text import ascii_words, keyword_terms, query_similarities
from paperloom.operators.rank import ranked
from paperloom.store import cut, small


@dataclass(frozen=True)
class Weights:
    """Fixed values of the scoring rules."""

    title: float = 0.7
    abstract: float = 0.3
    relevance: float = 0.40
    impact: float = 0.30
    recency: float = 0.20
    completeness: float = 0.10
    combined2: float = 0.50
    impact2: float = 0.25
    recency2: float = 0.15
    completeness2: float = 0.10
    high: float = 0.20
    medium: float = 0.05
    gates: tuple[float, float, float] = (1.0, 0.8, 0.5)
    recent_years: int = 10


W = Weights()
#: What a complete record has.
COMPLETE = ("doi", "abstract", "authors", "publication_year", "source_name", "landing_page_url")


def _terms(keyword: str) -> list[str]:
    """``keyword_terms`` on the driver."""
    return list(dict.fromkeys(t for t in re.findall("[a-z0-9]+", keyword.lower()) if len(t) >= 2))


def _share(n: Column, title: Column, abstract: Column) -> Column:
    """Relevance from how many of the n terms are in title and abstract."""
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), W.title * title / n + W.abstract * abstract / n))


def relevance(keyword: str | Column, title: Column, abstract: Column) -> Column:
    if isinstance(keyword, str):
        # Only the terms are taken out of a text, not all of its words.
        known = _terms(keyword)
        n, words = F.lit(len(known)), F.lit(f"(?<![a-z0-9])({'|'.join(known)})(?![a-z0-9])")
        hits = lambda c: F.size(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), words, 1)))
    else:
        terms = keyword_terms(keyword)
        n = F.size(terms)
        hits = lambda c: F.size(F.array_intersect(terms, ascii_words(c)))
    return _share(n, hits(title), hits(abstract))


def citations_log(c: Column) -> Column:
    return F.log1p(F.greatest(F.lit(0), F.coalesce(c, F.lit(0))))


def recency(year: Column, reference_year: int) -> Column:
    if not 1000 <= reference_year <= 9999:
        raise ValueError("reference_year has four digits")
    age = F.lit(reference_year) - year
    return F.when(year.isNull(), 0.0).when(age <= 0, 1.0).when(age >= W.recent_years, 0.0).otherwise((W.recent_years - age) / float(W.recent_years))


def completeness(columns: tuple[str, ...] = COMPLETE) -> Column:
    present = [(~is_missing(F.col(c))).cast("int") for c in columns]
    total = present[0]
    for p in present[1:]:
        total = total + p
    return total / float(len(columns))


def _of_group(values: Mapping[str, str] | Mapping[str, int], by: list[str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(by[0]))


def _parts(papers: DataFrame, reference_year: int, by: list[str] | None) -> DataFrame:
    """papers with the three parts that no keyword bears on.

    The largest impact is a one-row aggregate for each corpus, joined back; no row is sorted or gathered for it.
    """
    logged = citations_log(F.col("cited_by_count"))
    most = papers.groupBy(*(by or [])).agg(F.max(logged).alias("_most"))
    joined = papers.join(small(cut(most, "most")), by) if by else papers.crossJoin(F.broadcast(most))
    part = F.when(F.col("_most") <= 0, 0.0).otherwise(logged / F.col("_most"))
    return joined.withColumns({"impact_raw": part, "recency_raw": recency(F.col("publication_year"), reference_year), "completeness_raw": completeness()}).drop("_most")


def with_scores(papers: DataFrame, keyword: str | Mapping[str, str], reference_year: int, by: list[str] | None = None) -> DataFrame:
    """papers with the four parts and the preliminary score, which weighs the parts as they are and not as they are shown.

    A mapping has a keyword for each value of the one column of ``by``.
    """
    asked = keyword if isinstance(keyword, str) else _of_group(keyword, by)
    return _shown(_parts(papers, reference_year, by).withColumn("relevance_raw", relevance(asked, F.col("title"), F.col("abstract"))))


def _shown(scored: DataFrame) -> DataFrame:
    total = W.relevance * F.col("relevance_raw") + W.impact * F.col("impact_raw") + W.recency * F.col("recency_raw") + W.completeness * F.col("completeness_raw")
    return scored.withColumns(
        {
            "relevance_score": floor4(F.col("relevance_raw")),
            "impact_score": floor4(F.col("impact_raw")),
            "recency_score": floor4(F.col("recency_raw")),
            "completeness_score": floor4(F.col("completeness_raw")),
            "preliminary_score": floor4(total),
        }
    )


def baseline_order() -> list[Column]:
    return [F.desc("preliminary_score"), F.coalesce("cited_by_count", F.lit(0)).desc(), F.coalesce("publication_year", F.lit(0)).desc(), F.asc("pos")]


def text_relevance(papers: DataFrame, keyword: str | Mapping[str, str], by: list[str] | None = None) -> DataFrame:
    """(by, pos, title_similarity, abstract_similarity, combined_relevance): titles and abstracts are corpora of their own."""
    by = by or []
    return _similar(query_similarities(papers, ["title", "abstract"], keyword, "pos", by)).drop("h0", "h1")


def _similar(both: DataFrame) -> DataFrame:
    shown = {"title_similarity": floor4(F.col("s0")), "abstract_similarity": floor4(F.col("s1")), "combined_relevance": floor4(W.title * F.col("s0") + W.abstract * F.col("s1"))}
    return both.withColumns(shown).drop("s0", "s1")


def level(combined: Column) -> Column:
    return F.when(combined >= W.high, "high").when(combined >= W.medium, "medium").otherwise("low")


#: What the two orders read of a scored record.
RANKED_BY = ("pos", "cited_by_count", "publication_year", "preliminary_score", "impact_score", "recency_score", "completeness_score")


def two_stage(scored: DataFrame, keyword: str | Mapping[str, str], by: list[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(by, what the orders read, keep) with relevance level, second-stage score, old and new rank and their difference.

    Nothing is filtered. Long columns are not carried through the sorts: ``keep`` names those that the caller wants besides.
    """
    by = by or []
    narrow = list(dict.fromkeys([*by, *RANKED_BY, *keep]))
    # Written, as a sort looks at its rows twice and the scores read whole texts.
    old = ranked(cut(scored.select(*narrow), "scored"), "old_rank", baseline_order(), by)
    return _second(old.join(text_relevance(scored, keyword, by).drop(*by), "pos"), by)


def two_stage_of(papers: DataFrame, keyword: str | Mapping[str, str], reference_year: int, by: list[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``two_stage`` of papers that have no scores yet.

    Tokens are counted once for text relevance, and the terms of the keyword are found among them, so no expression goes over texts for them.
    Tokens of rows that share a position are added, so such papers are scored row by row.
    """
    by = by or []
    if papers.groupBy("pos").agg(F.count("*").alias("n")).where("n > 1").take(1):
        return two_stage(with_scores(papers, keyword, reference_year, by), keyword, by, keep)
    both = _similar(query_similarities(papers, ["title", "abstract"], keyword, "pos", by)).drop(*by)
    narrow = _parts(papers, reference_year, by).select(*dict.fromkeys([*by, "pos", "cited_by_count", "publication_year", *keep, "impact_raw", "recency_raw", "completeness_raw"]))
    n = F.lit(len(_terms(keyword))) if isinstance(keyword, str) else F.coalesce(_of_group({k: len(_terms(v)) for k, v in keyword.items()}, by), F.lit(0))
    scored = _shown(narrow.join(both, "pos").withColumn("relevance_raw", _share(n, F.col("h0"), F.col("h1"))))
    wanted = [*by, *RANKED_BY, "title_similarity", "abstract_similarity", "combined_relevance", *keep]
    return _second(ranked(cut(scored.select(*dict.fromkeys(wanted)), "scored"), "old_rank", baseline_order(), by), by)


def _second(joined: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their old rank and text relevance, with level, second-stage score, new rank and the difference of the ranks."""
    lv = level(F.col("combined_relevance"))
    gate = F.when(lv == "high", W.gates[0]).when(lv == "medium", W.gates[1]).otherwise(W.gates[2])
    inner = W.combined2 * F.col("combined_relevance") + W.impact2 * F.col("impact_score") + W.recency2 * F.col("recency_score") + W.completeness2 * F.col("completeness_score")
    scored2 = joined.withColumns({"relevance_level": lv, "stage2_score": floor4(gate * inner)})
    order = [F.desc("stage2_score"), F.desc("combined_relevance"), F.coalesce("cited_by_count", F.lit(0)).desc(), F.coalesce("publication_year", F.lit(0)).desc(), F.asc("old_rank")]
    return ranked(scored2, "new_rank", order, by).withColumn("rank_change", F.col("old_rank") - F.col("new_rank"))


def explain_change() -> Column:
    """Why a record's rank changed, in the words that readers of the reports know (fixed values)."""
    change, combined, lv = F.col("rank_change"), F.format_string("%.4f", F.col("combined_relevance")), F.col("relevance_level")
    gate = F.when(lv == "high", "1.0").when(lv == "medium", "0.8").otherwise("0.5")
    cited = F.coalesce("cited_by_count", F.lit(0)).cast("string")
    down = F.concat(
        F.lit("排名下降 "), (-change).cast("string"), F.lit(" 位：引用量 "), cited, F.lit(" 支撑了旧版高分，但词法相关性 combined="), combined, F.lit("（"), lv, F.lit(" 层），第一阶段降权系数 "), gate, F.lit(" 生效")
    )
    up = F.concat(F.lit("排名上升 "), change.cast("string"), F.lit(" 位：词法相关性 combined="), combined, F.lit("（"), lv, F.lit(" 层）在新权重 0.50 下贡献超过引用影响"))
    return F.when(change < 0, down).when(change > 0, up).otherwise(F.lit("排名不变：两阶段相对位置未改变"))


def top_movers(moved: DataFrame, k: int) -> DataFrame:
    return moved.orderBy(F.abs("rank_change").desc(), F.asc("old_rank")).limit(max(k, 1))
