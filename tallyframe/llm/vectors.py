"""Near-duplicate vectors through an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.common import components, pin

THRESHOLD = 0.95
CELL_ROWS = 32  # vectors of a cell that the size of the codebooks aims at
MAX_CODES = 1_024  # codewords of a half, at most
SAMPLE_PER_CODE = 64  # vectors of the sample for each codeword; bounds the sample
TARGET_RECALL = 0.9999
MIN_CELLS = 8  # cells visited in any case
PAIRS_EACH = 4  # linked pairs of one sampled vector that the number of visits is taken from
BLOCK_ROWS = 4_096  # members or visitors of a cell compared in one go

EMPTY = pa.array([], pa.int64())


def _units(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of length 1 as little-endian doubles; null where there is no direction."""
    for batch in rows:
        made = []
        for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = None if vec_id is None or not vector.is_valid else np.array(vector.as_py(), np.float64)
            size = np.linalg.norm(x / (np.abs(x).max() or 1)) * (np.abs(x).max() or 1) if x is not None and len(x) and np.isfinite(x).all() else 0
            made.append((x / size + 0.0).astype("<f8").tobytes() if size > 0 and np.isfinite(size) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["vec_id", "unit"])


def _matrix(units: pa.ChunkedArray) -> np.ndarray:
    return np.array([np.frombuffer(u, "<f8") for u in units.to_pylist()])


def _distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] + (codes * codes).sum(1)[None, :] - 2 * x @ codes.T)


def codebook(x: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """k-means of the sample's half vectors; starts from distinct rows spread by rank."""
    start = np.unique(x, axis=0)
    size = min(size, len(start))
    codes = start[np.linspace(0, len(start) - 1, size).astype(int)]
    for _ in range(rounds):
        near = _distances(x, codes).argmin(1)
        sums = np.zeros_like(codes)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=size)[:, None]
        codes = np.where(n > 0, sums / np.maximum(n, 1), codes)
    return codes


def traverse(one: np.ndarray, two: np.ndarray) -> Iterator[tuple[int, int]]:
    """Multi-sequence traversal: cells in order of the sum of their halves' distances."""
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    heap, pushed = [(one[a[0]] + two[b[0]], 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j])
        for k, m in ((i + 1, j), (i, j + 1)):
            if k < len(a) and m < len(b) and (k, m) not in pushed:
                pushed.add((k, m))
                heapq.heappush(heap, (one[a[k]] + two[b[m]], k, m))


class Index:
    """Two codebooks and the number of cells a search visits."""

    def __init__(self, first: np.ndarray, second: np.ndarray, visits: int):
        self.first, self.second, self.visits = first, second, visits

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _distances(x[:, :half], self.first), _distances(x[:, half:], self.second)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Each vector's own cell, and the cells that its search visits, nearest first."""
        one, two = self.distances(x)
        wide = len(self.second)
        own = one.argmin(1) * wide + two.argmin(1)
        seen = []
        for a, b in zip(one, two):
            walk = traverse(a, b)
            seen.append([i * wide + j for (i, j), _ in zip(walk, range(self.visits))])
        return own, seen

    def rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Cells that the search of each x visits until it has been at the cell of its y."""
        (one, two), (to_one, to_two) = self.distances(x), self.distances(y)
        out = np.empty(len(x), np.int64)
        for n, (a, b, i, j) in enumerate(zip(one, two, to_one.argmin(1), to_two.argmin(1))):
            out[n] = np.searchsorted(np.sort(b), a[i] + b[j] - a, side="right").sum()
        return np.maximum(out, 1)


def fit(sample: np.ndarray, rows: int, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> Index:
    """Codebooks from a bounded sample, and as many visits as reach the target recall.

    Recall is measured on pairs of the sample that link, a few of each vector so that no
    group outweighs the rest, and on as many made up to lie at the threshold itself. The
    target is met on both, however many cells that takes.
    """
    half = sample.shape[1] // 2
    size = max(1, min(MAX_CODES, round(math.sqrt(rows / CELL_ROWS))))
    index = Index(codebook(sample[:, :half], size), codebook(sample[:, half:], size), 1)
    tried, pick = sample[:2000], np.random.default_rng(42)
    linked = tried @ tried.T >= threshold
    np.fill_diagonal(linked, False)
    pairs = [(a, b) for a, row in enumerate(linked) for b in pick.permutation(np.flatnonzero(row))[:PAIRS_EACH]]
    made = pick.normal(size=tried.shape)
    made -= (made * tried).sum(1, keepdims=True) * tried
    made /= np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)
    # a pair is found from either end
    either = lambda x, y: np.minimum(index.rank(x, y), index.rank(y, x))
    needed = [either(tried, threshold * tried + math.sqrt(1 - threshold ** 2) * made)]
    if pairs:
        a, b = np.array(pairs).T
        needed.append(either(tried[a], tried[b]))
    index.visits = max(MIN_CELLS, *(int(np.quantile(n, target, method="higher")) for n in needed))
    return index


def _placed(rows: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        if batch.num_rows:
            own, seen = Index(*index.value).cells(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own, pa.int64()), pa.array(seen, pa.list_(pa.int64()))],
                names=["node", "unit", "n", "own", "seen"])


def _block(members: pa.Table, visitors: pa.Table, threshold: float) -> pa.Table:
    """Links between a cell's members and its visitors: what each gains, and a spanning forest.

    A pair whose search would find it from both ends is met twice, each time for the
    visitor; one found from one end only counts for both here.
    """
    if not members.num_rows or not visitors.num_rows:
        return pa.table({"node": EMPTY, "links": EMPTY, "root": EMPTY})
    x, y = _matrix(visitors["unit"]), _matrix(members["unit"])
    ids = np.concatenate([visitors["node"].to_numpy(), members["node"].to_numpy()])
    q, m = np.nonzero(x @ y.T >= threshold)
    apart = ids[q] != ids[len(x) + m]
    q, m = q[apart], m[apart]
    own = visitors["own"].to_numpy()
    back = [frozenset(s) for s in members["seen"].to_pylist()]
    once = np.fromiter((own[a] not in back[b] for a, b in zip(q, m)), bool, len(q))
    gained = np.zeros(len(ids), np.int64)
    np.add.at(gained, q, members["n"].to_numpy()[m])
    np.add.at(gained, len(x) + m[once], visitors["n"].to_numpy()[q[once]])
    root, ends = ids.copy(), np.concatenate([q, len(x) + m])
    others = np.concatenate([len(x) + m, q])
    while True:
        lower = root.copy()
        np.minimum.at(lower, ends, root[others])
        if (lower == root).all():
            break
        root = lower
    kept = np.unique(ends)
    return pa.table({"node": ids[kept], "links": gained[kept], "root": root[kept]})


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors of equal direction are one node, so copies make no pairs. All nodes are
    indexed in a grid of cells and search the nearest of them; pairs found are linked
    if their cosine is at least ``threshold`` in double precision. A cell of many
    vectors is compared in blocks, each of which returns counts and a spanning forest.
    Vectors of different lengths have no cosine: each length has an index of its own.
    Vectors that are null, empty, zero or not finite link with nothing and are their own
    component. A row without vec_id links with nothing either; its component is null.
    """
    spark = embeddings.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCK_ROWS))
    units = pin(embeddings.select("vec_id", "embedding").mapInArrow(_units, "vec_id bigint, unit binary"))
    nodes = pin(units.where("unit IS NOT NULL").groupBy("unit").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))
                .select("node", "unit", "n"))
    # a number per length that occurs
    wide = sorted(r[0] for r in nodes.select(F.octet_length("unit")).distinct().collect())
    if not wide:
        return units.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"),
                            F.col("vec_id").isNotNull().alias("kept"))
    of = lambda size: nodes if len(wide) == 1 else nodes.where(F.octet_length("unit") == size)
    found = reduce(DataFrame.unionByName, [_linked(of(size), size, threshold) for size in wide])
    return units.join(found, "unit", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("root", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("root", "vec_id"), F.lit(False)).alias("kept"))


def _linked(nodes: DataFrame, size: int, threshold: float) -> DataFrame:
    """``unit``, ``links`` and ``root`` of the nodes (node, unit, n) of one length, of ``size`` bytes."""
    spark, rows = nodes.sparkSession, nodes.count()
    if rows < 2 or size == 8:  # of one number there are two directions, which face each other
        return nodes.select("unit", (F.col("n") - 1).alias("links"), F.col("node").alias("root"))
    codes = max(1, min(MAX_CODES, round(math.sqrt(rows / CELL_ROWS))))
    chosen = nodes.select("node", "unit").orderBy(F.xxhash64("node"), "unit").limit(SAMPLE_PER_CODE * codes + 2000).collect()
    fitted = fit(np.array([np.frombuffer(r[1], "<f8") for r in chosen]), rows, threshold)
    # MAX_CODES rows for either half at most
    index = spark.sparkContext.broadcast((fitted.first, fitted.second, fitted.visits))
    placed = pin(nodes.mapInArrow(partial(_placed, index=index),
                                  "node bigint, unit binary, n bigint, own bigint, seen array<bigint>"))
    visits = placed.select(*(F.col(c).alias(c) for c in ("node", "unit", "n", "own")), F.explode("seen").alias("cell"))
    parts = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("int")
    sizes = pin(placed.groupBy(F.col("own").alias("cell")).agg(F.count("*").alias("inside"))
                .join(visits.groupBy("cell").agg(F.count("*").alias("coming")), "cell")
                .select("cell", parts("inside").alias("m"), parts("coming").alias("v")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    salt = F.xxhash64("node")
    members = (placed.join(sizes, placed["own"] == sizes["cell"])
               .select("cell", F.pmod(salt, "m").cast("int").alias("mk"), every("v").alias("vk"), "node", "unit", "n", "seen"))
    visitors = (visits.join(sizes, "cell")
                .select("cell", every("m").alias("mk"), F.pmod(salt, "v").cast("int").alias("vk"), "node", "unit", "n", "own"))
    met = pin(members.groupBy("cell", "mk", "vk").cogroup(visitors.groupBy("cell", "mk", "vk")).applyInArrow(
        partial(_block, threshold=threshold), "node bigint, links bigint, root bigint"))
    roots = components(met.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = met.groupBy("node").agg(F.sum("links").alias("links"))
    return pin(nodes.join(linked, "node", "left").join(roots, "node", "left").select(
        "unit", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "node").alias("root")))
