"""A store of suspected duplicates under review: a versioned table, one commit for each decision.

A version is a file of the log, named by its number, which appears whole or not at all and can be made only once; so a crash between
two decisions loses none, and of two reviewers who commit the same version one is told to look again. An entry is a decision, or
names a base: the queue as a Spark table that holds all decisions before it. The table at a version is the last base with the
decisions after it. Decisions are made by people and few; the queue may be of any size and is only read and written by Spark.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import dedup

from .runs import now

#: What a reviewer may say, and the columns of the queue that a decision changes.
ANSWERS = {"y", "n", "s"}
STATE = ("review_status", "action")


class ConflictError(RuntimeError):
    """Somebody else has committed this version."""


class ReviewStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Path(folder).resolve()
        self.log = self.folder / "_log"

    @classmethod
    def create(cls, queue: DataFrame, folder: str) -> ReviewStore:
        """A store whose first version is the queue: pair_id, review_status, action and what a reviewer is shown."""
        store = cls(queue.sparkSession, folder)
        store.log.mkdir(parents=True)
        store._rebase(queue, 0)
        return store

    def versions(self) -> list[int]:
        return sorted(int(p.stem) for p in self.log.glob("[0-9]*.json"))

    def latest(self) -> int:
        return self.versions()[-1]

    def _entry(self, version: int) -> dict:
        return json.loads((self.log / f"{version:08d}.json").read_text(encoding="utf-8"))

    def _commit(self, version: int, entry: dict) -> None:
        part = self.log / f".{uuid.uuid4().hex}"
        with part.open("w", encoding="utf-8") as f:
            f.write(json.dumps(entry | {"at": now()}, ensure_ascii=False))
            f.flush()
            os.fsync(f.fileno())
        try:
            # A link to a name that is there fails, so a version is made once.
            os.link(part, self.log / f"{version:08d}.json")
        except FileExistsError as e:
            raise ConflictError(f"version {version} is there") from e
        finally:
            part.unlink()

    def _rebase(self, queue: DataFrame, version: int) -> None:
        name = f"base-{uuid.uuid4().hex}"
        queue.write.parquet(str(self.folder / name))
        self._commit(version, {"base": name})

    def _since_base(self, version: int | None) -> tuple[str, list[tuple[int, dict]]]:
        """(folder of the last base, decisions after it) up to a version."""
        decisions: list[tuple[int, dict]] = []
        for v in reversed([v for v in self.versions() if version is None or v <= version]):
            entry = self._entry(v)
            if "base" in entry:
                return str(self.folder / entry["base"]), decisions[::-1]
            decisions.append((v, entry))
        raise ValueError(f"no version {version}")

    def table(self, version: int | None = None) -> DataFrame:
        """The queue as it is, or as it was at a version."""
        base, decisions = self._since_base(version)
        # A pair is decided once; after that it doesn't wait any more, here and in a later base alike.
        said = self.spark.createDataFrame([(e["pair_id"], e["decision"], -v) for v, e in decisions], "pair_id string, decision string, seq int")
        return dedup.apply_reviews(self.spark.read.parquet(base), said)

    def decide(self, pair_id: str, decision: str, reviewer: str = "", note: str = "", version: int | None = None) -> int:
        """Commit one decision and return its version; ``version`` is the one that was looked at, the latest if none is named."""
        if decision.lower() not in ANSWERS:
            raise ValueError(f"decision {decision}")
        following = (self.latest() if version is None else version) + 1
        self._commit(following, {"pair_id": pair_id, "decision": decision.lower(), "reviewer": reviewer, "note": note})
        return following

    def compact(self) -> int:
        """A new base with all decisions so far; earlier versions can still be read."""
        version = self.latest()
        self._rebase(self.table(version), version + 1)
        return version + 1

    def pending(self, page: int = 200) -> Iterator[dict]:
        """Pairs that wait for a decision, in the order of pair_id, a page of them at a time."""
        after = None
        while True:
            rows = self.table().where(F.col("review_status") == "pending")
            rows = rows if after is None else rows.where(F.col("pair_id") > after)
            found = [r.asDict() for r in rows.orderBy("pair_id").limit(page).collect()]
            yield from found
            if len(found) < page:
                return
            after = found[-1]["pair_id"]


def review(store: ReviewStore, ask: Callable[[dict], str], tell: Callable[[str], None] = print, reviewer: str = "") -> int:
    """Ask for each pair that waits, and commit each answer before the next is asked for; ``q`` ends, and n made are returned.

    An answer that isn't one is asked for again; ``s`` leaves the pair as it is and isn't noted.
    """
    made = 0
    for pair in store.pending():
        answer = ""
        while answer not in ANSWERS | {"q"}:
            answer = ask(pair).strip().lower()[:1]
        if answer == "q":
            break
        if answer != "s":
            version = store.decide(pair["pair_id"], answer, reviewer)
            tell(f"{pair['pair_id']}: {answer} ({version})")
            made += 1
    return made


def shown(pair: dict, columns: Iterable[str] = ()) -> str:
    """A pair as lines of text for a reviewer."""
    return "\n".join(f"  {c}: {pair.get(c)}" for c in (list(columns) or [c for c in pair if c not in STATE]))
