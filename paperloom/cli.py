"""Command line: python -m paperloom COMMAND."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import functions as F

from paperloom.operators import agreement, checks, contracts, dedup, evaluate, gate, terms
from paperloom.plans import benchmark, package, pool, reviews, runs
from paperloom.session import local_session
from paperloom.sources import files, rest


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="paperloom")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="records to ranking")
    run.add_argument("--queries", required=True, help="JSON file {id: keyword}")
    run.add_argument("--ranking-keyword", required=True)
    run.add_argument("--offline", help="JSON file {queries: {id: {papers: []}}}")
    run.add_argument("--url", help="address of the REST service")
    run.add_argument("--max-results", type=int, default=20)
    run.add_argument("--reference-year", type=int, default=datetime.now(UTC).year)
    run.add_argument("--labels", help="CSV file openalex_id,label")
    run.add_argument("--k", type=int, default=10)
    run.add_argument("--output-root", default="outputs")
    run.add_argument("--run-name", default="")
    run.add_argument("--from-year", type=int)
    run.add_argument("--to-year", type=int)
    run.add_argument("--allow-unreviewed-labels", action="store_true", help="take the last label of an id, drafts too")
    batch = sub.add_parser("batch", help="several runs")
    batch.add_argument("--config", required=True)
    batch.add_argument("--offline", required=True)
    batch.add_argument("--reference-year", type=int, required=True)
    batch.add_argument("--output-root", default="outputs")
    review = sub.add_parser("review", help="decide about suspected pairs")
    review.add_argument("--queue", help="Parquet folder of a run's suspected pairs")
    review.add_argument("--store", help="folder of a review that goes on; begun from --queue where there is none")
    review.add_argument("--reviewer", default="", help="with --store: ask for each pair that waits, and keep each answer at once")
    review.add_argument("--decisions", help="CSV file pair_id,decision,seq")
    review.add_argument("--output", help="where the decided queue goes")
    table = sub.add_parser("gate", help="ids, labels and secrets of a CSV file")
    table.add_argument("--csv", required=True)
    table.add_argument("--id", required=True)
    table.add_argument("--label")
    table.add_argument("--allowed", nargs="*", default=[])
    method = sub.add_parser("method", help="check a method's manifest and ranking")
    method.add_argument("--manifest", required=True)
    method.add_argument("--pool", required=True)
    method.add_argument("--per-query", type=int, default=20)
    fetch = sub.add_parser("fetch", help="records of one query from the REST service")
    fetch.add_argument("--url", required=True)
    fetch.add_argument("--keyword", required=True)
    fetch.add_argument("--max-results", type=int, default=20)
    fetch.add_argument("--from-year", type=int)
    fetch.add_argument("--to-year", type=int)
    fetch.add_argument("--output", required=True, help="JSON file of the records; a summary in CSV stands beside it")
    words = sub.add_parser("terms", help="queries from a term dictionary and a blueprint")
    words.add_argument("--terms", required=True)
    words.add_argument("--blueprint", required=True, help="JSON list of {query_id, terms: []}")
    words.add_argument("--output", required=True)
    score = sub.add_parser("evaluate", help="metrics of a ranking")
    score.add_argument("--ranking", required=True, help="CSV file openalex_id,rank")
    score.add_argument("--labels", required=True)
    score.add_argument("--k", type=int, nargs="+", default=[5, 10])
    agree = sub.add_parser("agreement", help="agreement of pairs with two annotations")
    agree.add_argument("--assignments", required=True)
    agree.add_argument("--annotations", required=True, nargs="+", help="CSV files of the annotators")
    picked = sub.add_parser("pool", help="pairs to be judged, out of retrieved records")
    picked.add_argument("--research-queries", required=True, help="JSON file {queries: []}")
    picked.add_argument("--source", required=True, help="CSV file of records with source_query_ids and source_run_ids as JSON")
    picked.add_argument("--pool-version", required=True)
    picked.add_argument("--reference-year", type=int, required=True)
    picked.add_argument("--queries", type=int, default=3, help="research queries that there must be")
    picked.add_argument("--output", required=True)
    picked.add_argument("--force", action="store_true", help="replace a pool that is there")
    drafted = sub.add_parser("draft", help="judgements and proposals of a package before any review")
    drafted.add_argument("--pool", required=True)
    drafted.add_argument("--assignments", required=True)
    drafted.add_argument("--annotations", required=True, nargs="+", help="CSV files of the annotators")
    drafted.add_argument("--suggestions", help="CSV file with a proposal for each disagreement")
    drafted.add_argument("--version", required=True)
    drafted.add_argument("--output-dir", required=True)
    drafted.add_argument("--force", action="store_true", help="replace a draft that is there")
    task = sub.add_parser("task", help="an annotator's empty file")
    check = sub.add_parser("check-task", help="check an annotator's file")
    for s in (task, check):
        s.add_argument("--pool", required=True)
        s.add_argument("--assignments", required=True)
        s.add_argument("--annotator", required=True)
        s.add_argument("--file", required=True)
    task.add_argument("--force", action="store_true")
    judged = sub.add_parser("benchmark", help="check a judged package; with rankings, evaluate them on it")
    judged.add_argument("--manifest", required=True)
    judged.add_argument("--annotators", required=True, help="JSON file {slug: name}")
    judged.add_argument("--pool-version", required=True)
    judged.add_argument("--review", action="store_true", help="accept a draft")
    judged.add_argument("--rankings", help="CSV file method,pair_id,research_query_id,rank")
    judged.add_argument("--output")
    judged.add_argument("--pool", help="candidate pool, which must be the one that the package pins")
    judged.add_argument("--assignments", help="assignments, likewise")
    secrets = sub.add_parser("files", help="the quality gate of a project's files")
    secrets.add_argument("--root", default=".")
    secrets.add_argument("--level", choices=(gate.BASIC, gate.FULL), default=gate.BASIC)
    secrets.add_argument("--folders", nargs="*", default=[], help="folders that must be there")
    freeze = sub.add_parser("freeze", help="pin the files of a package")
    freeze.add_argument("--root", required=True)
    freeze.add_argument("files", nargs="+")
    return p


def _offline(path: str):
    def fetch(spark, q):
        rows = files.read_offline_queries(spark, path, q["limit"], runs.now()).where(F.col("query_id") == q["query_id"])
        return rows.drop("query_id").withColumn("keyword", F.lit(q["keyword"]))

    return fetch


def _remote(url: str, from_year: int | None = None, to_year: int | None = None):
    def fetch(spark, q):
        rest.register(spark)
        read = spark.read.format("scholarly_works").option("url", url).option("queries", json.dumps({q["query_id"]: q["keyword"]})).option("max_results", q["limit"])
        for name, value in (("from_year", from_year), ("to_year", to_year), ("api_key", os.environ.get("WORKS_API_KEY"))):
            if value:
                read = read.option(name, value)
        raw = read.load()
        works = raw.select(F.col("at").cast("long").alias("pos"), F.from_json("work", files.WORK).alias("w")).select("pos", "w.*")
        return files.clean(files.project_works(works, q["keyword"]), q["keyword"], runs.now())

    return fetch


def _show(found, most: int = 1000) -> int:
    """Print the first violations and how many there are; 1 if there are any."""
    n = found.count()
    for r in found.limit(most).collect():
        print(r["rule"], r["key"], r["detail"] if r["rule"] != "secret" else "")
    if n > most:
        print(f"{n - most} more")
    return int(n > 0)


def _fetch(a) -> int:
    key = os.environ.get("WORKS_API_KEY")
    found = rest.fetch(a.url, a.keyword, a.max_results, from_year=a.from_year, to_year=a.to_year, api_key=key)
    files.write_json(found.works, a.output)
    asked = {"keyword": a.keyword, "max_results": a.max_results, "from_year": a.from_year, "to_year": a.to_year}
    print(json.dumps(rest.write_summary(found, asked, str(Path(a.output).with_suffix(".summary.csv"))), ensure_ascii=False))
    return int(found.stop_reason in rest.FAILED)


def _terms(spark, a) -> int:
    blueprint = json.loads(Path(a.blueprint).read_text(encoding="utf-8"))
    rows = [(q["query_id"], i, t) for q in blueprint for i, t in enumerate(q["terms"])]
    asked = spark.createDataFrame(rows, "query_id string, at int, term string")
    queries, missing = terms.query_sets(asked, files.read_terms(spark, a.terms))
    if missing.take(1):
        return _show(missing)
    files.write_json({"queries": [r.asDict() for r in queries.orderBy("query_id").collect()]}, a.output)
    return 0


def _evaluate(spark, a) -> int:
    ranking = files.read_strict_csv(spark, a.ranking, ("openalex_id", "rank")).select("openalex_id", F.col("rank").cast("int").alias("rank"), F.lit("ranking").alias("method"))
    labels = files.read_labels(spark, a.labels).select(F.col("openalex_id").alias("l"), evaluate.grade(F.col("label")).alias("grade"))
    joined = ranking.join(labels, F.col("openalex_id") == F.col("l"), "left")
    print(json.dumps([r.asDict() for r in evaluate.metrics(joined, ["method"], a.k).orderBy("k").collect()]))
    return 0


def _agreement(spark, a) -> int:
    said = checks.union([files.read_strict_csv(spark, p, ("pair_id", "research_query_id", "annotator", "label")).select("pair_id", "research_query_id", "annotator", F.trim("label").alias("label")) for p in a.annotations])
    assigned = files.read_strict_csv(spark, a.assignments, ("pair_id", "annotator_slug", "assignment_role"))
    side = lambda role, x: assigned.where(F.col("assignment_role") == role).join(said.withColumnRenamed("pair_id", "p"), (F.col("pair_id") == F.col("p")) & (F.col("annotator_slug") == F.col("annotator"))).select("pair_id", F.col("research_query_id").alias(f"rq_{x}"), F.col("label").alias(f"label_{x}"))
    pairs = side("primary", "a").join(side("secondary", "b"), "pair_id")
    for by in ([], ["rq_a"]):
        print(json.dumps([r.asDict() for r in agreement.kappas(pairs, by).collect()], ensure_ascii=False))
    for r in contracts.coverage(assigned, said).orderBy("annotator_slug").collect():
        print(*r)
    return 0


def _task(spark, a) -> int:
    pool, assigned = files.read_strict_csv(spark, a.pool, ("pair_id",)), files.read_strict_csv(spark, a.assignments, ("pair_id", "annotator_slug"))
    print(benchmark.create_task(pool, assigned, a.annotator, a.file, a.force))
    return 0


def _check_task(spark, a) -> int:
    pool, assigned = files.read_strict_csv(spark, a.pool, ("pair_id",)), files.read_strict_csv(spark, a.assignments, ("pair_id", "annotator_slug"))
    task = files.read_strict_csv(spark, a.file, (*contracts.READ_ONLY, "annotator", *benchmark.ANSWERS))
    return _show(contracts.annotation_violations(task, pool, assigned, a.annotator))


def _free(path: Path, force: bool) -> Path:
    if path.exists() and not force:
        raise FileExistsError(f"{path} is there")
    return path


def _pool(spark, a) -> int:
    path = _free(Path(a.output), a.force)
    source = files.decode_arrays(files.read_strict_csv(spark, a.source, pool.NEEDED), ("source_query_ids", "source_run_ids"))
    made = pool.build(source, files.read_research_queries(a.research_queries, a.queries), a.pool_version, a.reference_year)
    print(files.write_csv_file(made.orderBy("pair_id"), str(path), list(pool.POOL), bom=False))
    return 0


def _draft(spark, a) -> int:
    folder = Path(a.output_dir)
    paths = [_free(folder / name, a.force) for name in ("judgements.csv", "adjudication_proposals.csv")]
    said = checks.union([files.read_strict_csv(spark, p, (*contracts.READ_ONLY, "annotator", *benchmark.ANSWERS)) for p in a.annotations])
    given = files.read_strict_csv(spark, a.suggestions, ("pair_id", "proposed_final_label")) if a.suggestions else None
    candidates, assigned = files.read_strict_csv(spark, a.pool, ("pair_id",)), files.read_strict_csv(spark, a.assignments, ("pair_id", "annotator_slug"))
    folder.mkdir(parents=True, exist_ok=True)
    for df, path, columns in zip(benchmark.draft(candidates, assigned, said, given, a.version), paths, (benchmark.JUDGEMENT, benchmark.PROPOSAL), strict=True):
        print(path.name, files.write_csv_file(df.orderBy("pair_id"), str(path), list(columns), bom=False))
    return 0


def _benchmark(spark, a) -> int:
    package.same_inputs(Path(a.manifest), candidate_pool=a.pool, assignments=a.assignments)
    protocol = contracts.Protocol(json.loads(Path(a.annotators).read_text(encoding="utf-8")), a.pool_version)
    if not a.rankings:
        return _show(benchmark.validate(spark, a.manifest, protocol, not a.review)[2])
    rankings = files.read_strict_csv(spark, a.rankings, ("method", "pair_id", "research_query_id", "rank")).withColumn("rank", F.col("rank").cast("int"))
    print(json.dumps(benchmark.evaluate_package(spark, a.manifest, rankings, protocol, a.output or "experiment.json"), ensure_ascii=False))
    return 0


def _files(spark, a) -> int:
    """1 if anything but warnings is found."""
    found = gate.gate(files.read_files(spark, a.root), a.level, a.folders)
    for r in found.where(F.col("severity") == gate.WARNING).limit(1000).collect():
        print("warning", r["rule"], r["key"], r["detail"])
    return _show(found.where(F.col("severity") == gate.ERROR))


def _review(spark, a) -> int:
    store = reviews.ReviewStore(spark, a.store)
    if not store.log.is_dir():
        store = reviews.ReviewStore.create(spark.read.parquet(a.queue), a.store)
    if a.reviewer:
        reviews.review(store, lambda pair: input(f"{reviews.shown(pair)}\n[y/n/s/q] "), reviewer=a.reviewer)
    for r in store.table().groupBy("review_status").count().orderBy("review_status").collect():
        print(r["review_status"], r["count"])
    return 0


COMMANDS = {"terms": _terms, "evaluate": _evaluate, "agreement": _agreement, "task": _task, "check-task": _check_task, "benchmark": _benchmark, "files": _files, "pool": _pool, "draft": _draft}


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "freeze":
        print(json.dumps(package.freeze(Path(a.root), a.files), indent=2))
        return 0
    if a.command == "fetch":
        return _fetch(a)
    spark = local_session("paperloom")
    if a.command == "run":
        if bool(a.offline) == bool(a.url):
            print("give --offline or --url", file=sys.stderr)
            return 2
        queries = tuple(json.loads(Path(a.queries).read_text(encoding="utf-8")).items())
        settings = runs.Settings(a.ranking_keyword, queries, a.reference_year, "offline" if a.offline else "live", a.max_results, evaluation_k=a.k, output_root=a.output_root, run_name=a.run_name, from_year=a.from_year, to_year=a.to_year)
        labels = None
        if a.labels:
            labels = files.read_labels(spark, a.labels) if a.allow_unreviewed_labels else files.read_reviewed_labels(spark, a.labels)[0]
        try:
            run = runs.run_pipeline(spark, settings, _offline(a.offline) if a.offline else _remote(a.url, a.from_year, a.to_year), labels)
        except runs.RunError as e:
            print(e, file=sys.stderr)
            return 1
        print(json.dumps(run.config["counts"]))
        return 0
    if a.command == "batch":
        rows = runs.run_batch(spark, json.loads(Path(a.config).read_text(encoding="utf-8")), _offline(a.offline), a.reference_year, a.output_root)
        print(json.dumps(rows, ensure_ascii=False))
        return int(any(r["status"] not in ("success", "skipped") for r in rows))
    if a.command == "review" and a.store:
        return _review(spark, a)
    if a.command == "review":
        queue = spark.read.parquet(a.queue)
        if a.decisions:
            said = files.read_strict_csv(spark, a.decisions, ("pair_id", "decision", "seq")).withColumn("seq", F.col("seq").cast("int"))
            queue = dedup.apply_reviews(queue, said)
            if a.output:
                queue.write.mode("overwrite").parquet(a.output)
        for r in queue.groupBy("review_status").count().orderBy("review_status").collect():
            print(r["review_status"], r["count"])
        return 0
    if a.command == "gate":
        df = files.read_strict_csv(spark, a.csv, [a.id, *([a.label] if a.label else [])])
        parts = [checks.duplicates(df, a.id)] + [checks.violations(df, "secret", checks.has_secret(F.col(c)), F.col(a.id)) for c in df.columns]
        if a.label:
            parts.append(checks.allowed(df, a.label, a.allowed, a.id))
        return _show(checks.union(parts))
    if a.command in COMMANDS:
        return COMMANDS[a.command](spark, a)
    manifest = package.check_manifest(Path(a.manifest))
    rows = files.read_strict_csv(spark, str(Path(a.manifest).parent / manifest["ranking_file"]), package.RANKING)
    found = package.ranking_violations(rows, files.read_strict_csv(spark, a.pool, ("pair_id", "research_query_id")), manifest["method_id"], a.per_query)
    return _show(found)
