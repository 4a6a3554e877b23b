import json
import random

import pytest
from pyspark.sql import functions as F

from paperloom import cli
from paperloom.operators import checks, contracts, sampling, score
from paperloom.plans import pool
from paperloom.sources import files

YEAR = 2026
QUERIES = [{"research_query_id": f"RQ{i}", "acquisition_query_ids": [f"a{i}"], "ranking_keyword": k, "question_zh": f"问{i}", "question_en": f"q{i}", "scope_in": ["x"], "scope_out": ["y"]} for i, k in enumerate(("deep sea", "star light", "soil"), 1)]


def rows(n=90):
    rng = random.Random(11)
    words = "deep sea star light soil model data survey fish water".split()
    return [
        dict(openalex_id=f"W{i:03d}", title=" ".join(rng.choices(words, k=5)), abstract=" ".join(rng.choices(words, k=20)), landing_page_url="u", publication_year=str(2010 + i % 15), doi=f"10.1/{i}", source_query_ids=json.dumps([f"a{1 + i % 3}"] + (["a2"] if i % 3 == 0 and i < 12 else [])),
             source_run_ids='["r"]', cited_by_count=str(rng.randint(0, 500)), authors="A", source_name="S")
        for i in range(n)
    ]


def frame(spark, given):
    df = spark.createDataFrame([tuple(r.values()) for r in given], ", ".join(f"{c} string" for c in given[0]))
    return files.decode_arrays(df, ("source_query_ids", "source_run_ids"))


def test_a_pool_of_three_queries(spark):
    given = rows()
    made = pool.build(frame(spark, given), QUERIES, "v9", YEAR).collect()
    assert len(made) == 60 and len({r["pair_id"] for r in made}) == 60 and {r["pair_id"][:8] for r in made} == {"w4_rq01_", "w4_rq02_", "w4_rq03_"}
    for i, q in enumerate(QUERIES, 1):
        own = sorted((r for r in made if r["research_query_id"] == q["research_query_id"]), key=lambda r: r["pair_id"])
        assert [r["pair_id"] for r in own] == [f"w4_rq{i:02d}_{n:03d}" for n in range(1, 21)]
        assert sorted(r["selection_bucket"] for r in own) == sorted(["top", "middle", "bottom", "mover"] * 5)
        hashed = [spark.sql(f"SELECT sha2('v9|{q['research_query_id']}|{r['openalex_id']}', 256)").first()[0] for r in own[:3]]
        assert hashed == sorted(hashed)
        # One query alone, by its own keyword and in one group, ranks alike.
        found = sorted((r for r in given if q["acquisition_query_ids"][0] in json.loads(r["source_query_ids"])), key=lambda r: (r["openalex_id"], r["title"]))
        df = spark.createDataFrame([(n, r["openalex_id"], r["title"], r["abstract"], int(r["publication_year"]), r["doi"], int(r["cited_by_count"]), "A", "S", "u") for n, r in enumerate(found)], "pos long, openalex_id string, title string, abstract string, publication_year int, doi string, cited_by_count long, authors string, source_name string, landing_page_url string")
        alone = score.two_stage(score.with_scores(df, q["ranking_keyword"], YEAR), q["ranking_keyword"], keep=("openalex_id", "title"))
        want = sampling.stratified(alone.withColumn("g", F.lit(1)), ["g"]).select("openalex_id", "bucket").collect()
        assert {(r["openalex_id"], r["selection_bucket"]) for r in own} == {tuple(r) for r in want}
    assert {r["source_query_ids"] for r in made} <= {'["a1"]', '["a2"]', '["a3"]', '["a1","a2"]'}
    protocol = contracts.Protocol({"a": "A"}, "v9")
    assert contracts.pool_violations(spark.createDataFrame(made), protocol).collect() == []


@pytest.mark.parametrize(
    "change, fault",
    [
        (lambda g, q: [r.update(label="2") for r in g], "columns of judgements: label"),
        (lambda g, q: [r.pop("doi") for r in g], "lacks doi"),
        (lambda g, q: q[1].update(acquisition_query_ids=["a1", "a2"]), "RQ2: one acquisition"),
        (lambda g, q: q[2].update(acquisition_query_ids=["none"]), "RQ3: 0 rows"),
        (lambda g, q: g.append(dict(g[0])), "RQ1 finds W000 twice"),
    ],
)
def test_what_a_pool_refuses(spark, change, fault):
    given, queries = rows(), [dict(q) for q in QUERIES]
    change(given, queries)
    with pytest.raises(checks.ContractError, match=fault):
        pool.build(frame(spark, given), queries, "v9", YEAR)


def test_pool_command(spark, tmp_path, capsys):
    import csv

    with open(tmp_path / "s.csv", "w", newline="") as f:
        out = csv.DictWriter(f, list(rows()[0]))
        out.writeheader()
        out.writerows(rows())
    (tmp_path / "q.json").write_text(json.dumps({"queries": QUERIES}), encoding="utf-8")
    args = ["pool", "--research-queries", str(tmp_path / "q.json"), "--source", str(tmp_path / "s.csv"), "--pool-version", "v9", "--reference-year", "2026", "--output", str(tmp_path / "p.csv")]
    assert cli.main(args) == 0 and capsys.readouterr().out.splitlines()[-1] == "60"
    got = files.read_strict_csv(spark, str(tmp_path / "p.csv"), pool.POOL)
    assert got.count() == 60 and tuple(got.columns) == pool.POOL
    with pytest.raises(FileExistsError):
        cli.main(args)


def test_evaluation_inputs(spark):
    schema = "pair_id string, research_query_id string, openalex_id string"
    good = [("p1", "q1", "w1"), ("p2", "q2", "w1")]
    labels = spark.createDataFrame([(" p1",), ("p9",), ("p9",)], "pair_id string")
    found = lambda given: sorted((r["rule"], r["key"]) for r in contracts.benchmark_input_violations(spark.createDataFrame(given, schema), labels, ["q1", "q2"]).collect())
    assert found(good) == [("label_unknown", "p9")]
    assert found([*good, ("p1", "q1", "w1"), (None, "q3", " ")]) == [("label_unknown", "p9"), ("pair_blank", ""), ("pair_twice", "p1"), ("query_unknown", ""), ("work_blank", ""), ("work_twice", "q1|w1")]
    assert found(good[:1]) == [("label_unknown", "p9"), ("query_missing", "q2")]
    with pytest.raises(ValueError, match="openalex_id"):
        contracts.benchmark_input_violations(labels.withColumn("research_query_id", F.lit("q1")), labels, ["q1"])
