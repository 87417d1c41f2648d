"""Near-duplicate vectors by spherical-cap filters of a structured random product code."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.components import components
from marketloom.llm.scratch import drop, put

SIMILARITY = 0.98
# Sums that are held at a time while codes grow.
CELLS = 1 << 20


@dataclass(frozen=True)
class Caps:
    """A product code of ``blocks`` blocks whose filters follow the number of vectors that may meet.

    Of n vectors each lies in about ``caps`` caps in each of ``turns`` independently turned codes, and meets about ``met`` unrelated ones:
    a cap takes the share met / (n * caps * turns) of all directions, and the code has as many filters as that needs. So filters grow with
    n, and vectors that meet with n as well, not with its square. n is taken as a power of two, ``least`` or more.

    Pairs at cosine 0.9801 that were missed, of 600 at 2^10, 2^13 and 2^16 vectors and of 150 at 2^20: at 64 dimensions 0, 0, 1, 0 (and 0 of 150 at
    2^24); at 384 none; at 8, where unrelated vectors lie close as well and meet in thousands, 0, 4, 2, 3.
    """

    blocks: int = 2
    caps: float = 24.0
    met: float = 24.0
    turns: int = 4
    least: int = 10
    seed: int = 11

    def share(self, level: int) -> float:
        return self.met / (2.0 ** max(level, self.least) * self.caps * self.turns)

    def reach(self, level: int) -> float:
        """Standard deviations that a filter's sum of block products must reach at 2 ** level vectors."""
        return NormalDist().inv_cdf(1 - self.share(level))

    def words(self, level: int) -> int:
        """Directions in each block."""
        return math.ceil((self.caps / self.share(level)) ** (1 / self.blocks))


@lru_cache(maxsize=4)
def code(size: int, caps: Caps, level: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """For each turn: a random rotation of the space and the directions of each block, of unit variance on rotated unit vectors."""
    r = np.random.default_rng(caps.seed)
    out = []
    for _ in range(caps.turns):
        turn, _ = np.linalg.qr(r.normal(size=(size, size)))
        parts = np.array_split(np.arange(size), caps.blocks)
        out.append((turn, [r.normal(size=(len(p), caps.words(level))) for p in parts]))
    return out


def decode(unit: np.ndarray, caps: Caps, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters that each unit vector exceeds. Partial codes grow block by block, from the directions that can still
    reach the cap with the best of the blocks to come; the other filters are not visited."""
    rows, filters = [], []
    words, reach = caps.words(level), caps.reach(level)
    for number, (turn, directions) in enumerate(code(unit.shape[1], caps, level)):
        cuts = np.cumsum([0, *[len(d) for d in directions]])
        x = unit @ turn
        scores = [x[:, a:b] @ d for a, b, d in zip(cuts[:-1], cuts[1:], directions)]
        best = [s.max(axis=1) for s in scores]
        row = np.arange(len(unit))
        value, prefix = np.zeros(len(unit)), np.zeros(len(unit), np.int64)
        for k, score in enumerate(scores):
            rest = sum(best[k + 1:]) if k + 1 < len(scores) else np.zeros(len(unit))
            grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            step = max(1, CELLS // words)
            for lo in range(0, len(row), step):
                r = row[lo: lo + step]
                total = value[lo: lo + step, None] + score[r]
                i, word = np.nonzero(total >= (reach - rest[r])[:, None])
                grown.append((r[i], total[i, word], prefix[lo: lo + step][i] * words + word))
            row, value, prefix = (np.concatenate(g) for g in zip(*grown)) if grown else (row, value, prefix)
        rows.append(row)
        filters.append(prefix + number * words ** caps.blocks)
    return np.concatenate(rows), np.concatenate(filters)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.cast(pa.list_(pa.float64())).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 1))


def filters_of(vectors: DataFrame, caps: Caps) -> DataFrame:
    """(node, label, size, cap) for every cap that a vector lies in; ``vectors`` has node, label, vector and level, the binary logarithm of
    how many vectors of its label and length there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            levels = batch.column("level").to_numpy(zero_copy_only=False)
            for size, level in sorted(set(zip(sizes.tolist(), levels.tolist()))):
                place = np.flatnonzero((sizes == size) & (levels == level))
                for lo in range(0, len(place), 512):
                    part = batch.take(pa.array(place[lo: lo + 512]))
                    x = _matrix(part.column("vector"), part.num_rows)
                    # Scaled by the largest component first, so that squares neither overflow nor vanish.
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    row, cap = decode(x / np.linalg.norm(x, axis=1, keepdims=True), caps, level)
                    own = part.select(["node", "label", "size"]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cap)], ["node", "label", "size", "cap"])

    return vectors.select("node", "label", "size", "level", "vector").mapInArrow(run, "node long, label long, size int, cap long")


def verified(pairs: DataFrame, vectors: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose vectors have at least this cosine in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
            cosine = np.empty(batch.num_rows)
            for size in np.unique(sizes):
                place = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(place))
                x, y = _matrix(part.column("x"), len(place)), _matrix(part.column("y"), len(place))
                x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
                cosine[place] = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1)) / np.sqrt((y * y).sum(axis=1))
            out = batch.select(["a", "b"])
            yield out.filter(pa.array(cosine >= similarity))

    left = vectors.select(F.col("node").alias("a"), F.col("vector").alias("x"))
    right = vectors.select(F.col("node").alias("b"), F.col("vector").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(embeddings: DataFrame, similarity: float = SIMILARITY, caps: Caps = Caps()) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: links join rows of equal, non-null labels at ``similarity`` or more.

    Equal vectors of a label are one node with a weight, so copies never meet pair by pair. Vectors that are null, empty, zero or hold a
    null or a non-finite component, and rows with a null label, have no links. Rows that repeat a vec_id count as rows of their own. Vectors of
    different lengths never link. Null ids neither name a component of others nor are kept.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                             F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("vector", lambda v: v != 0), F.lit(False))
    # Minus zero equals zero.
    rows = rows.withColumn("vector", F.when(usable, F.transform("vector", lambda v: v + F.lit(0.0))))
    rows = rows.withColumn("key", F.when(usable, F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.to_json("vector")), 256)))
    rows, _ = put(rows, "vectors")
    classes = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.first("label").alias("label"),
                                                               F.first("vector").alias("vector"))
    classes, _ = put(classes.withColumn("node", F.xxhash64("key")), "vector-classes")
    sized = classes.withColumn("size", F.size("vector"))
    level = F.greatest(F.ceil(F.log2(F.count("*"))), F.lit(caps.least)).cast("int")
    in_caps, caps_at = put(filters_of(sized.join(sized.groupBy("label", "size").agg(level.alias("level")), ["label", "size"]), caps), "vector-caps")
    left = in_caps.select(F.col("node").alias("a"), "label", "size", "cap")
    right = in_caps.select(F.col("node").alias("b"), "label", "size", "cap")
    met = left.join(right, ["label", "size", "cap"]).where("a < b").select("a", "b").distinct()
    links, _ = put(verified(met, classes, similarity), "vector-links")
    drop(embeddings.sparkSession, caps_at)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weights = classes.select(F.col("node").alias("b"), "copies")
    degree = both.join(weights, "b").groupBy("a").agg(F.sum("copies").alias("linked"))
    nodes = components(links, "caps")
    told = classes.select("key", "node", "copies", "first").join(degree, F.col("node") == F.col("a"), "left").drop("a") \
        .join(nodes, "node", "left").withColumn("root", F.coalesce("component", "node"))
    smallest = told.groupBy("root").agg(F.min("first").alias("component_id"))
    told = told.join(smallest, "root").select("key", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"), "component_id")
    out = rows.select("vec_id", "key").join(told, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
