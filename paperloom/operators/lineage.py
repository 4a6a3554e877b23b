"""Where packages come from: chains of parents of any depth, and what an approved package must keep of the draft before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.store import cut, discard

from .contracts import by_row, counted, differs

#: How an audited package was made, and the files that its audit leaves.
AUDIT = "human annotation + independent blind AI evidence audit + independent human review/adjudication"
AUDIT_FILES = ("blind_manifest", "blind_audit", "human_ai_comparison", "review_queue", "comparison_summary")


def lineage(packages: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """(id, root, depth, state) of packages (id, parent): rooted, parent_missing or cycle; the last has neither root nor depth.

    A package without a parent, or whose parent isn't there, is a root. Each package knows an ancestor and how far it is; in a round
    it takes its ancestor's ancestor, so the reach doubles, and a chain of n packages takes log n rounds. Both sides of a round are as large as the table, so neither is ever broadcast. What has not
    reached a root by then never will: it is on a cycle or leads into one. Of rows that repeat an id the smallest parent counts;
    null ids are left out.
    """
    rows = packages.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(parent).alias("parent"))
    known = rows.select(F.col("id").alias("k"))
    first = rows.join(known.hint("merge"), F.col("parent") == F.col("k"), "left")
    first = first.select("id", F.coalesce("k", "id").alias("up"), F.col("k").isNotNull().cast("long").alias("depth"), F.when(F.col("k").isNotNull(), "open").when(F.col("parent").isNull(), "rooted").otherwise("parent_missing").alias("state"))
    reach = cut(first, "lineage")
    n, open_ = reach.agg(F.count("*"), F.count(F.when(F.col("state") == "open", 1))).first()
    for _ in range(n.bit_length() + 1):
        if not open_:
            break
        further = reach.select(F.col("id").alias("a"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("state").alias("then"))
        moved = reach.join(further.hint("merge"), F.col("up") == F.col("a"))
        moved = cut(moved.select("id", F.col("next").alias("up"), F.when(F.col("state") == "open", F.col("depth") + F.col("more")).otherwise(F.col("depth")).alias("depth"), F.when(F.col("state") == "open", F.col("then")).otherwise(F.col("state")).alias("state")), "lineage")
        discard(reach)
        reach = moved
        open_ = reach.where("state = 'open'").count()
    lost = F.col("state") == "open"
    return reach.select("id", F.when(~lost, F.col("up")).alias("root"), F.when(~lost, F.col("depth")).alias("depth"), F.when(lost, "cycle").otherwise(F.col("state")).alias("state"))


def package_violations(packages: DataFrame) -> DataFrame:
    """(rule, key, detail) of packages against their parents, and of the audits of approved ones.

    packages: id, status, version, inputs, judgements, proposals (digests or paths), parent (id), parent_version and parent_inputs (as
    the package names them), and audit, a struct of description, blind_first, reviewers_checked, required, completed and
    files (names); null where there is none.
    """
    before = packages.select(F.struct("id", "status", "version", "inputs", "judgements", "proposals").alias("p"))
    rows = packages.join(before, F.col("parent") == F.col("p.id"), "left")
    approved, proposed, claimed, there = F.col("status") == "approved", F.col("status") == "proposed", F.col("parent").isNotNull(), F.col("p").isNotNull()
    bound = approved & there
    audit = F.col("audit")
    wanted = F.array(*[F.lit(f) for f in sorted(AUDIT_FILES)])
    rules = [
        ("status", ~F.coalesce(approved | proposed, F.lit(False))),
        ("parent_needed", approved & ~claimed),
        ("parent_invented", proposed & claimed),
        ("parent_unknown", claimed & ~there),
        ("own_parent", F.col("parent") == F.col("id")),
        ("parent_no_draft", bound & (differs(F.col("p.status"), F.lit("proposed")) | ~F.coalesce(F.contains(F.lower("p.version"), F.lit("draft")), F.lit(False)))),
        ("approved_draft", approved & F.contains(F.lower("version"), F.lit("draft"))),
        ("parent_version", bound & differs(F.col("parent_version"), F.col("p.version"))),
        ("parent_inputs", bound & differs(F.col("parent_inputs"), F.col("p.inputs"))),
        ("inputs_drift", bound & differs(F.col("inputs"), F.col("p.inputs"))),
        *[(f"{c}_not_new", bound & F.col(c).eqNullSafe(F.col(f"p.{c}"))) for c in ("judgements", "proposals")],
        ("audit_missing", approved & audit.isNull()),
        ("audit_description", approved & audit.isNotNull() & differs(audit["description"], F.lit(AUDIT))),
        ("audit_not_blind", approved & audit.isNotNull() & ~F.coalesce(audit["blind_first"] & audit["reviewers_checked"], F.lit(False))),
        ("audit_reviews", approved & audit.isNotNull() & ~F.coalesce((audit["required"] > 0) & (audit["completed"] == audit["required"]), F.lit(False))),
        ("audit_files", approved & audit.isNotNull() & ~F.coalesce(F.array_sort(audit["files"]) == wanted, F.lit(False))),
    ]
    return by_row(rows, F.col("id"), rules).unionByName(counted(packages, "id_twice", ["id"], F.col("n") > 1))
