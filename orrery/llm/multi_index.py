"""Embedding near-duplicates through an inverted multi-index.

Vectors are cut in halves, each with a codebook of its own; a cell is a pair of
codewords. Every vector lies in its nearest cell and visits further cells in the
order of summed distances (multi-sequence traversal of the product grid), as many as
reach the target recall for neighbours at the threshold. All vectors of a visited
cell are then verified in double precision.

Codebooks and the number of visits are fitted on a bounded sample (16 rows a codeword,
``fit_rows`` at least and ``most_fit_rows`` at most, first in hash order); every vector is
indexed. A cell holds about ``cell_rows`` vectors up to ``most_codes`` squared cells, that
is, 1.6 billion vectors; beyond, cells grow. Visits are as many as the target recall
needs, up to the whole grid. Rows with equal vectors are one node.
A cell is dealt in parts of residents against parts of visitors, so a full cell is
many bounded tasks; a task compares its two sides as matrices and gives out counts
and a spanning forest, never the pairs.

Every vector length present has an index of its own; vectors of one component link by
their sign.

Edge cases: vectors that are null, zero, empty, or hold null or non-finite parts link
with nothing; rows that share a vec_id are one node; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import bounded, cut
from .components import components, smallest_linked


@dataclass(frozen=True)
class IndexRules:
    threshold: float = 0.9
    target_recall: float = 0.98
    fit_rows: int = 8192
    most_fit_rows: int = 65_536
    cell_rows: int = 96
    most_codes: int = 4096
    rounds: int = 12
    block: int = 512


@dataclass(frozen=True)
class Index:
    """Two codebooks and the number of cells each vector visits; of bounded size."""

    books: tuple[np.ndarray, np.ndarray]
    visits: int
    width: int

    @property
    def codes(self) -> int:
        return len(self.books[0])

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.width // 2
        return tuple(((part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)[None]) for part, book in zip((x[:, :half], x[:, half:]), self.books, strict=True))

    def cells(self, x: np.ndarray, visits: int | None = None) -> np.ndarray:
        """The nearest cells of each vector, nearest first."""
        visits = visits or self.visits
        d, e = self.distances(x)
        return np.array([multi_sequence(a, b, visits) for a, b in zip(d, e, strict=True)], np.int64).reshape(len(x), -1)


def multi_sequence(d: np.ndarray, e: np.ndarray, visits: int) -> list[int]:
    """Cells of the grid in the order of d[i] + e[j], the first ``visits`` of them."""
    p, q = np.argsort(d, kind="stable"), np.argsort(e, kind="stable")
    ds, es = d[p].tolist(), e[q].tolist()
    out, heap, done = [], [(ds[0] + es[0], 0, 0)], [0] * len(ds)
    n, m = len(ds), len(es)
    seen = {(0, 0)}
    while heap and len(out) < visits:
        _, i, j = heapq.heappop(heap)
        out.append(int(p[i]) * m + int(q[j]))
        done[i] = j + 1
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < n and b < m and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (ds[a] + es[b], a, b))
    return out


def codebook(x: np.ndarray, k: int, rounds: int, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((c**2).sum(1)[None] - 2 * x @ c.T).argmin(1)
        size = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def codes_for(n_rows: int, rules: IndexRules) -> int:
    """Codewords of a half that give cells of about ``cell_rows`` vectors."""
    return min(rules.most_codes, max(2, round(math.sqrt(n_rows / rules.cell_rows))))


def fit(sample: np.ndarray, n_rows: int, rules: IndexRules) -> Index:
    """Codebooks from unit vectors, sized for ``n_rows``; visits from made neighbours at the threshold.

    A neighbour at exactly the threshold is the hardest; either end of a pair may find the other.
    """
    width = sample.shape[1]
    sample = np.unique(np.round(sample, 9), axis=0)
    k = int(min(codes_for(n_rows, rules), max(1, len(sample) // 8)))
    half = max(1, width // 2)
    index = Index((codebook(sample[:, :half], k, rules.rounds), codebook(sample[:, half:], k, rules.rounds, 8)), 1, width)
    rng = np.random.default_rng(9)
    x = sample[rng.choice(len(sample), min(1000, len(sample)), replace=False)]
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    t = rules.threshold
    y = t * x + math.sqrt(max(0.0, 1 - t * t)) * noise
    grid = len(index.books[0]) * len(index.books[1])

    def ranks(depth: int) -> np.ndarray:
        """Visits that find each made neighbour; beyond ``depth``, ``depth``."""
        cx, cy = index.cells(x, depth), index.cells(y, depth)
        found = []
        for cells, of in ((cx, cy[:, 0]), (cy, cx[:, 0])):
            hit = cells == of[:, None]
            found.append(np.where(hit.any(1), hit.argmax(1), depth))
        return np.sort(np.minimum(*found))

    depth = min(grid, 1024)
    best = ranks(depth)
    at = min(len(best) - 1, math.ceil(rules.target_recall * len(best)) - 1)
    while best[at] >= depth < grid:
        depth = min(grid, 4 * depth)
        best = ranks(depth)
    return Index(index.books, min(int(best[at]) + 1, grid), width)


def unit_rows(batch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the valid rows, and which rows are valid."""
    lists = batch.column("embedding")
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lists = lists.cast(pa.list_(pa.float64()))
    good = np.zeros(len(lists), bool)
    sizes = np.array([-1 if v is None else v for v in lists.value_lengths().to_pylist()], np.int64)
    fit_ = sizes == width
    flat = lists.filter(pa.array(fit_)).flatten()
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, width) if width else np.empty((0, 0))
    top = np.abs(x).max(1, initial=0)
    ok = np.isfinite(top) & (top > 0)
    good[np.flatnonzero(fit_)[ok]] = True
    x = x[ok] / top[ok, None]
    return x / np.linalg.norm(x, axis=1, keepdims=True), good


def index_for(vectors: DataFrame, n: int, width: int, rules: IndexRules) -> Index:
    """An index for the ``n`` sound vectors of length ``width``."""
    drawn = vectors.where(valid(width)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(rules.most_fit_rows, max(rules.fit_rows, 16 * codes_for(n, rules)))).select("embedding").toArrow()
    return fit(unit_rows(drawn, width)[0], n, rules)


def valid(width: int | None = None):
    """Rows whose vector is sound and, where given, of that length."""
    e = F.col("embedding")
    long = F.size(e) == width if width else F.size(e) > 0
    sound = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    return F.coalesce(F.col("vec_id").isNotNull() & long & sound, F.lit(False))


PLACED = "vec_id long, copies long, home long, cell long, visits array<long>, embedding"


def placed(nodes: DataFrame, index: Index) -> DataFrame:
    """A row for every cell a vector lies in or visits; visits are listed on the row of its own cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                x, good = unit_rows(b, index.width)
                who = np.flatnonzero(good)
                if not len(who):
                    continue
                cells = index.cells(x)
                v = cells.shape[1]
                row = pa.array(np.repeat(who, v))
                own = np.tile(np.arange(v) == 0, len(who))
                ends = np.concatenate([[0], np.cumsum(np.where(own, v, 0))]).astype(np.int32)
                columns = [b.column("vec_id").take(row), b.column("copies").take(row), pa.array(np.repeat(cells[:, 0], v)), pa.array(cells.reshape(-1)),
                           pa.ListArray.from_arrays(pa.array(ends), pa.array(cells.reshape(-1))), b.column("embedding").take(row)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "copies", "home", "cell", "visits", "embedding"])

    kind = nodes.schema["embedding"].dataType.simpleString()  # vectors travel as they came, and meet in double precision
    return nodes.select("vec_id", "copies", "embedding").mapInArrow(run, f"{PLACED} {kind}")


def cell_links(placements: DataFrame, index: Index, rules: IndexRules) -> DataFrame:
    """(vec_id, n, least): links a task found for a vector, weighted by copies, and the least id it reached."""
    home = F.col("home") == F.col("cell")
    load = placements.groupBy("cell").agg(F.count(F.when(home, 1)).alias("own"), F.count("*").alias("all")).where("own > 0")
    load = load.select("cell", F.ceil(F.col("own") / rules.block).cast("int").alias("parts"), F.ceil(F.col("all") / (4 * rules.block)).cast("int").alias("vparts"))
    x = placements.join(load, "cell")
    h = F.xxhash64("vec_id")
    part, vpart = F.pmod(h, F.col("parts")).cast("int"), F.pmod(F.shiftright(h, 17), F.col("vparts")).cast("int")
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    residents = x.where(home).select("cell", part.alias("part"), F.explode(span("vparts")).alias("vpart"), F.lit(True).alias("resident"), "vec_id", "copies", "home", "visits", part.alias("own_part"), "embedding")
    visitors = x.select("cell", F.explode(span("parts")).alias("part"), vpart.alias("vpart"), F.lit(False).alias("resident"), "vec_id", "copies", "home", F.lit(None).cast("array<long>").alias("visits"), F.when(home, part).otherwise(F.lit(-1)).alias("own_part"), "embedding")

    def meet(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        there = t.column("resident").to_numpy(zero_copy_only=False).astype(bool)
        x, _ = unit_rows(t, index.width)
        col = lambda k: t.column(k).to_numpy(zero_copy_only=False).astype(np.int64)
        ids, copies, homes, own = col("vec_id"), col("copies"), col("home"), col("own_part")
        r, v = np.flatnonzero(there), np.flatnonzero(~there)
        out: list[tuple] = []
        if len(r) and len(v):
            here, part = homes[r[0]], own[r[0]]
            near = (x[r] @ x[v].T >= rules.threshold - 1e-12) & (ids[r][:, None] != ids[v][None])
            if near.any():
                i, j = np.nonzero(near)
                exact = np.einsum("ij,ij->i", x[r[i]], x[v[j]]) >= rules.threshold
                near[i[~exact], j[~exact]] = False
            least_r, least_v = smallest_linked(near, ids[r], ids[v])
            n_v = (near * copies[r][:, None]).sum(0)
            # a resident gets what visitors from other cells found unless it visits their cell itself;
            # pairs of one cell come up in both directions, so there only the visitor counts
            foreign = homes[v] != here
            lists = t.column("visits").to_pylist()
            n_r = np.zeros(len(r), np.int64)
            for k in np.flatnonzero(near.any(1)).tolist():
                mine = near[k] & foreign
                if mine.any():
                    n_r[k] = (copies[v] * (mine & ~np.isin(homes[v], lists[r[k]]))).sum()
            for group, n, least in ((r, n_r, least_r), (v, n_v, least_v)):
                hit = (n > 0) | (least != ids[group])
                out += zip(ids[group][hit].tolist(), n[hit].tolist(), least[hit].tolist(), strict=True)
        a, n, b = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(b, pa.int64())], ["vec_id", "n", "least"])

    return residents.unionByName(visitors).groupBy("cell", "part", "vpart").applyInArrow(meet, "vec_id long, n long, least long")


def nodes_of(rows: DataFrame, n: int, width: int, rules: IndexRules) -> DataFrame:
    """key, node, copies, n, component of the ``n`` sound vectors of length ``width``."""
    sound = rows.where(valid(width)).select("vec_id", "key", "embedding")
    if width == 1:  # rows of one sign are copies of one node
        return sound.groupBy("key").agg(F.min("vec_id").alias("node"), F.countDistinct("vec_id").alias("copies")).withColumns({"n": F.lit(0).cast("long"), "component": F.lit(None).cast("long")})
    index = index_for(sound, n, width, rules)
    nodes = cut(sound.select("vec_id", "embedding").distinct().groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    found = cut(cell_links(placed(nodes.select(F.col("node").alias("vec_id"), "copies", "embedding"), index), index, rules))
    counts = found.groupBy(F.col("vec_id").alias("node")).agg(F.sum("n").alias("n"))
    labels = components(found.select(F.col("vec_id").alias("a"), F.col("least").alias("b")))
    return nodes.join(counts, "node", "left").join(labels, "node", "left").select(F.col("embedding").alias("key"), "node", "copies", F.coalesce("n", F.lit(0)).alias("n"), "component")


def near_vectors(vectors: DataFrame, rules: IndexRules | None = None) -> DataFrame:
    """vec_id, n_links, component_id for every row of ``vectors`` (vec_id, embedding)."""
    rules = rules or IndexRules()
    rows = bounded(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sizes = rows.where(valid()).groupBy(F.size("embedding").alias("width")).count().collect()
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    e, kind = F.col("embedding"), rows.schema["embedding"].dataType
    rows = rows.withColumn("key", F.when(valid(), F.when(F.size(e) == 1, F.transform(e, F.signum).cast(kind)).otherwise(e)))
    per_node = reduce(DataFrame.unionByName, [nodes_of(rows, r["count"], r["width"], rules) for r in sorted(sizes)])
    per_vector = rows.join(per_node, "key", "left")
    return per_vector.select("vec_id", F.coalesce(F.col("n") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "node", "vec_id").alias("component_id"))
