"""Benchmark packages and method outputs: manifests that pin their files, and rankings that keep a contract."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators import checks
from paperloom.operators.rank import ranked

#: Columns of a ranking, keys of a manifest, and columns that a method may never have seen.
RANKING = ("pair_id", "research_query_id", "method_id", "score", "rank")
MANIFEST_KEYS = {"schema_version", "method_id", "family", "ranking_file", "ranking_sha256", "created_at"}
FAMILIES = {"baseline", "sparse", "dense", "neural", "hybrid"}
FORBIDDEN = {"label", "human_label", "final_label", "grade", "relevance_label"}


def file_sha256(path: Path) -> str:
    h = hashlib.sha256()
    with path.open("rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def inside(root: Path, name: str) -> Path:
    """A relative path under root; anything that leads out of it is an error."""
    path = (root / name).resolve()
    if Path(name).is_absolute() or root.resolve() not in path.parents:
        raise checks.ContractError(f"{name} leads out of the package")
    return path


def same_inputs(manifest: Path, **supplied: str | None) -> None:
    """Raise unless each supplied path is that of the input of this name that the manifest pins; those that are None are left out."""
    inputs = json.loads(manifest.read_text(encoding="utf-8-sig")).get("inputs") or {}
    for name, path in supplied.items():
        if path is not None and Path(path).resolve() != inside(manifest.resolve().parent, str((inputs.get(name) or {}).get("path"))):
            raise checks.ContractError(f"{path} is not the {name} that the package pins")


def freeze(root: Path, names: list[str], **more: object) -> dict:
    """A manifest with the size and digest of every file."""
    pinned = {n: {"bytes": (p := inside(root, n)).stat().st_size, "sha256": file_sha256(p)} for n in sorted(names)}
    return {"files": pinned, **more}


def drift(root: Path, manifest: dict) -> list[str]:
    """Pinned files that are missing or changed."""
    out = []
    for name, pin in manifest["files"].items():
        path = inside(root, name)
        if not path.is_file():
            out.append(f"missing {name}")
        elif file_sha256(path) != pin["sha256"]:
            out.append(f"changed {name}")
    return out


def check_manifest(path: Path) -> dict:
    """A method's manifest: exactly its keys, a known family, a pinned ranking, and a time with its zone."""
    from datetime import datetime

    m = json.loads(path.read_text(encoding="utf-8"))
    if set(m) != MANIFEST_KEYS:
        raise checks.ContractError(f"keys {sorted(set(m) ^ MANIFEST_KEYS)}")
    if m["family"] not in FAMILIES:
        raise checks.ContractError(f"family {m['family']}")
    if datetime.fromisoformat(m["created_at"]).tzinfo is None:
        raise checks.ContractError("created_at has no zone")
    ranking = inside(path.parent, m["ranking_file"])
    if file_sha256(ranking) != m["ranking_sha256"]:
        raise checks.ContractError("the ranking changed")
    return m


def ranking_violations(rows: DataFrame, pool: DataFrame, method_id: str, per_query: int) -> DataFrame:
    """Violations of a ranking (all columns as text) against its pool (pair_id, research_query_id)."""
    if set(rows.columns) & FORBIDDEN:
        raise checks.ContractError("the ranking has label columns")
    if tuple(rows.columns) != RANKING:
        raise checks.ContractError(f"columns {rows.columns}")
    score, rank = F.col("score").try_cast("double"), F.col("rank").try_cast("int")
    typed = rows.withColumns({"_score": score, "_rank": rank})
    ordered = ranked(typed, "_due", [F.desc("_score"), F.asc("pair_id")], ["research_query_id"])
    sizes = rows.groupBy("research_query_id").agg(F.count("*").alias("n"))
    known = pool.select(F.col("pair_id").alias("p"), F.col("research_query_id").alias("q"))
    identity = rows.join(known, F.col("pair_id") == F.col("p"), "full_outer")
    v = checks.violations
    return checks.union(
        [
            v(typed, "method", F.col("method_id") != method_id, F.col("pair_id"), F.col("method_id")),
            v(typed, "score_not_finite", F.col("_score").isNull() | F.isnan("_score") | (F.abs("_score") == float("inf")), F.col("pair_id"), F.col("score")),
            v(typed, "rank_not_canonical", F.col("_rank").isNull() | (F.col("_rank").cast("string") != F.col("rank")), F.col("pair_id"), F.col("rank")),
            v(ordered, "rank_not_by_score", F.col("_rank") != F.col("_due"), F.col("pair_id"), F.col("rank")),
            v(sizes, "query_size", F.col("n") != per_query, F.col("research_query_id"), F.col("n")),
            v(identity, "pair_missing", F.col("pair_id").isNull(), F.col("p")),
            v(identity, "pair_unknown", F.col("p").isNull(), F.col("pair_id")),
            v(identity, "pair_of_other_query", F.col("research_query_id") != F.col("q"), F.col("pair_id")),
            checks.duplicates(rows, "pair_id", "pair_twice"),
        ]
    )
