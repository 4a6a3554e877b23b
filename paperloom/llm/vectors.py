"""Embedding near-dedup over an inverted multi-index.

Each half of a vector has a codebook of its own, and the pairs of codewords form the grid's cells. Every distinct vector is listed
in its own cell and visits the cells nearest to it, in the order of the multi-sequence traversal, as many as reach TARGET_RECALL
for pairs just at the threshold; a pair is found if either vector visits the other's cell. What is found is verified by cosine
in double precision. Codebooks are fitted on a sample that grows with the codewords, the number of visits on other rows, which no
codebook has seen, and up to all cells; the index and the visits take all rows.

Equal vectors are counted before they move and take part once. A cell with many vectors is cut into blocks, and so are its
visitors, so the comparisons of a hot cell are even pieces; a block hands on counts and a spanning forest, never its pairs.

What is copied to the visited cells are codes, a byte a component. A code's distance from its vector is known, so the cosine of two
codes bounds that of their vectors, and no pair at the threshold is passed over. The vectors themselves move to those blocks alone
where a code has a partner within that bound, and decide there.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import small_batches
from .components import components
from .shared import cut

THRESHOLD = 0.95
#: Rows on which codebooks are fitted: about so many, or so many a codeword of a half if that is more.
SAMPLE_ROWS, WORD_ROWS = 8192, 64
#: Rows held out from them, about, on which visits are fitted; with fewer than the least every cell is visited.
HELD_ROWS, LEAST_HELD = 4096, 64
#: Vectors that a cell holds on average; codewords of a half at least and at most. Finer cells are visited in greater number.
CELL_ROWS, LEAST_WORDS, MOST_WORDS = 1024, 4, 1024
TARGET_RECALL = 0.995
#: Vectors of a block, on either side.
BLOCK_ROWS = 4096


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    # By the largest component first, or squares of finite numbers would be none.
    v = v / np.abs(v).max(axis=1)[:, None]
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


class MultiIndex:
    """Two codebooks; the cell (i, j) has the number i x words + j."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.books, self.half = (first, second), first.shape[1]

    @classmethod
    def fit(cls, sample: np.ndarray, words: int, rounds: int = 8) -> MultiIndex:
        half = max(1, sample.shape[1] // 2)
        return cls(*(cls._means(part, words, rounds) for part in (sample[:, :half], sample[:, half:])))

    @staticmethod
    def _means(rows: np.ndarray, words: int, rounds: int) -> np.ndarray:
        if not rows.shape[1]:
            return rows[:1]
        centres = rows[np.linspace(0, len(rows) - 1, words).astype(int)].copy()
        for _ in range(rounds):
            at = range(0, len(rows), 4096)
            near = np.concatenate([((centres * centres).sum(axis=1) - 2 * rows[k : k + 4096] @ centres.T).argmin(axis=1) for k in at])
            size = np.bincount(near, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, near, rows)
            # A codeword without rows, such as a second one at the same place, would only add empty cells.
            centres = sums[size > 0] / size[size > 0, None]
        return centres

    def visits(self, rows: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of every row, nearest first."""
        parts = rows[:, : self.half], rows[:, self.half :]
        far = [(b * b).sum(axis=1) - 2 * p @ b.T for p, b in zip(parts, self.books, strict=True)]
        order = [np.argsort(f, axis=1, kind="stable") for f in far]
        ranked = [np.take_along_axis(f, o, axis=1) for f, o in zip(far, order, strict=True)]
        words = len(self.books[1])
        out = np.empty((len(rows), n), np.int64)
        for r in range(len(rows)):
            d1, d2, o1, o2 = ranked[0][r].tolist(), ranked[1][r].tolist(), order[0][r], order[1][r]
            heap, seen = [(d1[0] + d2[0], 0, 0)], {(0, 0)}
            for k in range(n):
                _, i, j = heapq.heappop(heap)
                out[r, k] = o1[i] * words + o2[j]
                for a, b in ((i + 1, j), (i, j + 1)):
                    if a < len(d1) and b < len(d2) and (a, b) not in seen:
                        seen.add((a, b))
                        heapq.heappush(heap, (d1[a] + d2[b], a, b))
        return out

    def cells(self) -> int:
        return len(self.books[0]) * len(self.books[1])

    def _met(self, rows: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The visits after which each of the rows has met the home cell of its ``other``."""
        parts = (rows[:, : self.half], other[:, : self.half]), (rows[:, self.half :], other[:, self.half :])
        far, home = [], []
        for (r, o), b in zip(parts, self.books, strict=True):
            norm = (b * b).sum(axis=1)
            f = norm - 2 * r @ b.T
            home.append(f[np.arange(len(f)), (norm - 2 * o @ b.T).argmin(axis=1)])
            far.append(np.sort(f, axis=1))
        # Ties, and sums that differ by rounding, count as visited before.
        limit = home[0] + home[1] + 1e-12
        return np.array([np.searchsorted(far[1][k], limit[k] - far[0][k], side="right").sum() for k in range(len(rows))])

    def visits_for(self, held: np.ndarray, threshold: float, recall: float, seed: int = 5) -> tuple[int, float]:
        """(visits that find ``recall`` of the pairs of held rows with rows exactly ``threshold`` away, the share that they find).

        All cells find any pair, and are visited where too few rows are held to tell.
        """
        if len(held) < LEAST_HELD:
            return self.cells(), 1.0
        rng = np.random.default_rng(seed)
        rows = np.resize(held, (max(len(held), HELD_ROWS), held.shape[1]))
        noise = rng.normal(size=rows.shape)
        noise -= (noise * rows).sum(axis=1)[:, None] * rows
        length = np.sqrt((noise * noise).sum(axis=1))
        other = threshold * rows + np.sqrt(1 - threshold**2) * noise / np.where(length > 0, length, 1)[:, None]
        met = []
        for k in range(0, len(rows), 1024):
            a, b = rows[k : k + 1024], other[k : k + 1024]
            met.append(np.minimum(self._met(a, b), self._met(b, a)))
        met = np.sort(np.concatenate(met))
        n = int(min(met[int(np.ceil(recall * len(met))) - 1], self.cells()))
        return n, 1.0 if n == self.cells() else float((met <= n).mean())


def coded(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of a byte a component, the step of each row's code, its distance from the row at most)."""
    step = np.abs(units).max(axis=1) / 127
    codes = np.rint(units / step[:, None]).astype(np.int8)
    gap = units - codes * step[:, None]
    return codes, step, np.sqrt((gap * gap).sum(axis=1)) + 1e-12


def _sides(cell: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The members and the visitors of a block pair."""
    return cell[~cell["visitor"]], cell[cell["visitor"]]


def _once(members: pd.DataFrame, visitors: pd.DataFrame) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Tells which pairs of visitors i and members j count here: a pair that both sides find counts where the smaller visits the larger."""
    vid, mid = visitors["vec_id"].to_numpy(), members["vec_id"].to_numpy()
    homes, home = np.unique(visitors["home"].to_numpy(), return_inverse=True)
    cells = np.stack(members["cells"].to_numpy())
    place = np.searchsorted(homes, cells).clip(max=len(homes) - 1)
    sees = np.zeros((len(members), len(homes)), bool)
    row, k = np.nonzero(homes[place] == cells)
    sees[row, place[row, k]] = True
    return lambda i, j: (vid[i] < mid[j]) | ((vid[i] > mid[j]) & ~sees[j, home[i]])


def _block_partners(key: tuple, cell: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The vectors of a block pair whose codes allow a link that counts here."""
    members, visitors = _sides(cell)
    none = pd.DataFrame({"cell": [], "m": [], "v": [], "vec_id": [], "part": [], "visitor": []})
    if not len(members) or not len(visitors):
        return none
    floats = lambda side: np.frombuffer(b"".join(side["code"]), np.int8).reshape(len(side), -1).astype(np.float32)
    m, v = floats(members), floats(visitors)
    # Sums of single-precision products are off by no more than this.
    least = threshold - m.shape[1] * 2.0**-22 - 1e-6
    m_step, v_step, m_gap, v_gap = (side[c].to_numpy() for c in ("step", "gap") for side in (members, visitors))
    partner_m, partner_v = np.zeros(len(m), bool), np.zeros(len(v), bool)
    counts = _once(members, visitors)
    for at in range(0, len(v), 512):
        rows = slice(at, at + 512)
        # u.v is at most the codes' product, plus the gaps, plus their product.
        bound = (v[rows] @ m.T) * v_step[rows, None] * m_step + v_gap[rows, None] + m_gap + v_gap[rows, None] * m_gap
        i, j = np.nonzero(bound >= least)
        i += at
        once = counts(i, j)
        partner_v[i[once]] = True
        partner_m[j[once]] = True
    if not partner_m.any():
        return none
    taken = pd.concat([members[partner_m], visitors[partner_v]])
    return taken[["vec_id", "part", "visitor"]].assign(cell=key[0], m=key[1], v=key[2])[list(none.columns)]


def _block_links(cell: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """For each vector of a block pair: links counted here, and the smallest vector that these links reach."""
    members, visitors = _sides(cell)
    out = {"vec_id": [], "links": [], "reached": []}
    if not len(members) or not len(visitors):
        return pd.DataFrame(out).astype("int64")
    m, v = unit(np.stack(members["embedding"].to_numpy())), unit(np.stack(visitors["embedding"].to_numpy()))
    mid, vid = members["vec_id"].to_numpy(), visitors["vec_id"].to_numpy()
    m_mult, v_mult = members["copies"].to_numpy(), visitors["copies"].to_numpy()
    x, y = [], []
    for at in range(0, len(v), 512):
        i, j = np.nonzero(v[at : at + 512] @ m.T >= threshold)
        x.append(i + at)
        y.append(j)
    i, j = np.concatenate(x), np.concatenate(y)
    once = _once(members, visitors)(i, j)
    i, j = i[once], j[once]
    if not len(i):
        return pd.DataFrame(out).astype("int64")
    ids, at = np.unique(np.concatenate([vid[i], mid[j]]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, a, m_mult[j])
    np.add.at(links, b, v_mult[i])
    low = np.arange(len(ids))
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, new[a])
        new = new[new]
        if (new == low).all():
            break
        low = new
    return pd.DataFrame({"vec_id": ids, "links": links, "reached": ids[low]})


def fitted(classes: DataFrame, n: int, threshold: float) -> tuple[MultiIndex, int, float]:
    """The index for the n vectors of classes, which are of one length, how many cells each of them visits, and the recall of that."""
    words = int(min(max(LEAST_WORDS, round((n / CELL_ROWS) ** 0.5)), MOST_WORDS))
    share = min(1.0, (max(SAMPLE_ROWS, WORD_ROWS * words) + HELD_ROWS) / n)
    out = min(HELD_ROWS / n, share / 5)
    drawn = classes.select("embedding", (F.pmod(F.xxhash64("node", F.lit(3)), F.lit(2**30)) / 2**30).alias("draw")).where(F.col("draw") < share)
    sample = drawn.toArrow()
    apart = sample.column("draw").to_numpy() < out
    if apart.all():
        sample, apart = classes.select("embedding", F.lit(1.0).alias("draw")).limit(SAMPLE_ROWS).toArrow(), np.zeros(min(n, SAMPLE_ROWS), bool)
    points = unit(sample.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(apart), -1))
    # In an order that is the same on each run.
    order = np.lexsort((points[:, 0], sample.column("draw").to_numpy()))
    points, apart = points[order], apart[order]
    held, points = points[apart], points[~apart]
    index = MultiIndex.fit(points, min(words, len(points)))
    return index, *index.visits_for(held, threshold, TARGET_RECALL)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links (other vectors linked directly), component_id, kept, recall.

    recall is the share of pairs just at the threshold that the index of the vector's length finds, measured on rows that fitted no
    codebook; 1 where all pairs are compared, and for vectors that link with nothing.

    Vectors that are null, zero or empty, or hold a null or a non-finite component link with nothing, and so are components of
    their own; vectors of different lengths never link. The most frequent length, and each with more than BLOCK_ROWS vectors, has
    an index of its own; a length with fewer is one cell, in which all pairs are compared. Rows that repeat a vector count as vectors
    of their own, rows that repeat an id too; a null id has links but takes the component of its links' ids. Few rows, and none, work as many do. Other columns,
    labels too, are ignored.
    """

    e = F.col(vector_col)
    rows = cut(vectors.select(F.col(id_col).cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")), "vectors")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    # Minus zero groups with zero.
    good = rows.withColumn("good", F.coalesce(sound, F.lit(False)))
    classes = good.where("good").groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("node", F.coalesce("vec_id", F.xxhash64("embedding"))).select("node", "copies", "embedding"), "classes")
    lengths = cut(classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")), "lengths")
    first = lengths.orderBy(F.desc("n"), "d").limit(1).collect()
    if not first:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1.0).alias("recall"))
    large = {r["d"]: r["n"] for r in [*first, *lengths.where(F.col("n") > BLOCK_ROWS).collect()]}
    # Cells of an index start at a number of its own; the cell of a length without one is minus the length.
    indexes = {d: (*fitted(classes.where(F.size("embedding") == d), large[d], threshold), k * MOST_WORDS**2) for k, d in enumerate(sorted(large))}

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1024):
            vectors = b.column(2).to_pylist()
            of_length: dict[int, list[int]] = {}
            for at, v in enumerate(vectors):
                of_length.setdefault(len(v), []).append(at)
            cells = [np.zeros(0, np.int64)] * len(vectors)
            codes, steps, gaps = [b""] * len(vectors), np.zeros(len(vectors)), np.zeros(len(vectors))
            for d, ats in of_length.items():
                index, n_visits, _, base = indexes.get(d, (None, 1, 1.0, -d))
                units = unit(np.array([vectors[at] for at in ats]))
                visited = index.visits(units, n_visits) if index else np.zeros((len(ats), 1), np.int64)
                code, steps[ats], gaps[ats] = coded(units)
                for at, row, c in zip(ats, visited + base, code, strict=True):
                    cells[at], codes[at] = row, c.tobytes()
            home = pa.array([c[0] for c in cells], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, home, pa.array(cells, pa.list_(pa.int64())), pa.array(codes, pa.binary()), pa.array(steps), pa.array(gaps)], names=names)

    # Classes of one smallest id are told apart by a hash of the vector.
    kinds = {"node": "long", "copies": "long", "embedding": "array<double>", "part": "long", "home": "long", "cells": "array<long>", "code": "binary", "step": "double", "gap": "double"}
    names = list(kinds)
    placed = cut(classes.withColumn("part", F.xxhash64("embedding")).mapInArrow(visit, ", ".join(f"{c} {k}" for c, k in kinds.items())), "placed")
    # At most one row per cell of a grid, and a grid is bounded by MOST_WORDS.
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_ROWS).cast("int")
    held = placed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("members"))
    came = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("visitors"))
    grid = cut(held.join(came, "cell").select("cell", blocks("members").alias("mb"), blocks("visitors").alias("vb")), "grid")
    own = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    upto = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    columns = ["node", "part", "code", "step", "gap", "home"]
    as_member = placed.join(grid, F.col("home") == F.col("cell")).select("cell", own("mb").alias("m"), upto("vb").alias("v"), *columns, "cells", F.lit(False).alias("visitor"))
    as_visitor = placed.select(*columns, F.explode("cells").alias("at")).join(grid, F.col("at") == F.col("cell"))
    as_visitor = as_visitor.select("cell", upto("mb").alias("m"), own("vb").alias("v"), *columns, F.lit(None).cast("array<long>").alias("cells"), F.lit(True).alias("visitor"))
    pieces = as_member.unionByName(as_visitor).withColumnRenamed("node", "vec_id")
    partners = pieces.groupBy("cell", "m", "v").applyInPandas(lambda key, cell: _block_partners(key, cell, threshold), "cell long, m int, v int, vec_id long, part long, visitor boolean")
    partners = cut(partners, "partners")
    close = placed.select(F.col("node").alias("vec_id"), "part", "copies", "embedding", "home", "cells").join(partners, ["vec_id", "part"])
    found = close.groupBy("cell", "m", "v").applyInPandas(lambda cell: _block_links(cell, threshold), "vec_id long, links long, reached long")
    found = cut(found, "found")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    joined = cut(components(found.select(F.col("vec_id").alias("a"), F.col("reached").alias("b"))), "components")
    told = classes.join(links.withColumnRenamed("vec_id", "l"), F.col("node") == F.col("l"), "left").join(joined.withColumnRenamed("node", "c"), F.col("node") == F.col("c"), "left")
    told = told.where("copies > 1 OR links IS NOT NULL").select(F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    told = cut(told, "told")
    out = good.join(told, (F.col("embedding") == F.col("e")) & F.col("good"), "left")
    component = F.coalesce("component", "vec_id")
    reached = F.lit(1.0)
    for d, (_, _, recall, _) in indexes.items():
        reached = F.when(F.col("good") & (F.size("embedding") == d), recall).otherwise(reached)
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"), reached.alias("recall"))
