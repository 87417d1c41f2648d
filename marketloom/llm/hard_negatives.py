"""Hard negatives of anchors by a vertical scan: dimensions are read column by column, in the order in which they matter to an anchor.

Rows lie in slabs, dimension by dimension, with the smallest and largest component of each dimension in zones of rows. After some
dimensions, what the others can still add lies between two sums of those extremes; rows whose score can no longer fall in a wanted window
leave the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.scratch import put


@dataclass(frozen=True)
class Mining:
    """``positives`` of each anchor and ``negatives`` of each positive; a negative has at least ``share`` percent of the positive's score.
    Rows are worked on in slabs, anchors in blocks, dimensions ``step`` at a time. ``scale`` makes components integers, and rows with one
    of ``limit`` or more in magnitude, whose scores a long might not hold, take no part."""

    positives: int = 5
    negatives: int = 5
    share: int = 80
    slab: int = 8192
    zone: int = 1024
    block: int = 512
    step: int = 8
    scale: int = 256
    limit: int = 1 << 20


_SLAB = "n int, ids binary, labels binary, vectors binary"
_BLOCK = "b_n int, b_keys binary, b_ids binary, b_labels binary, b_vectors binary, b_tops binary"


def _integers(column: pa.Array, scale: int) -> np.ndarray:
    """Vectors of a batch as rows of floored components; shorter ones end in zeros."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False) * float(scale)).astype(np.int32)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task in batches of ``rows``, the last one smaller."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            held.append(part)
            n, batch = n + part.num_rows, batch.slice(part.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _slabs(rows: DataFrame, mining: Mining) -> DataFrame:
    """Rows (vec_id, label, vector) of each task as slabs, sorted by label, one dimension after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, mining.slab):
            labels = _numbers(batch, "label")
            order = np.argsort(labels, kind="stable")
            vectors = _integers(batch.column("vector"), mining.scale)[order]
            cells = [[len(order)], [_numbers(batch, "vec_id")[order].tobytes()], [labels[order].tobytes()], [np.ascontiguousarray(vectors.T).tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cells[1:])], ["n", "ids", "labels", "vectors"])

    return rows.select("vec_id", "label", "vector").mapInArrow(run, _SLAB)


def _blocks(anchors: DataFrame, mining: Mining) -> DataFrame:
    """Anchors (key, vec_id, label, vector, tops) as blocks; ``tops`` are the scores below which negatives are sought."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, mining.block):
            vectors = _integers(batch.column("vector"), mining.scale)
            tops = np.full((batch.num_rows, mining.positives), -1, np.int64)
            for i, found in enumerate(batch.column("tops").to_pylist()):
                tops[i, : len(found)] = found
            cells = [_numbers(batch, "key"), _numbers(batch, "vec_id"), _numbers(batch, "label"), vectors, tops]
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int32()), *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cells)],
                                             ["b_n", "b_keys", "b_ids", "b_labels", "b_vectors", "b_tops"])

    return anchors.select("key", "vec_id", "label", "vector", "tops").mapInArrow(run, _BLOCK)


class Slab:
    """Columns of some rows, and the extremes of each dimension in each zone."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray, mining: Mining):
        self.ids, self.labels, self.mining = ids, labels, mining
        self.columns = columns.astype(np.float64)
        cuts = np.arange(0, len(ids), mining.zone)
        self.zone = np.arange(len(ids)) // mining.zone
        self.low, self.high = np.minimum.reduceat(self.columns, cuts, axis=1), np.maximum.reduceat(self.columns, cuts, axis=1)
        self.most = float(np.abs(self.columns).max(initial=0))

    def scan(self, q: np.ndarray, rows: np.ndarray, floors: np.ndarray, tops: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of the candidates that may be among the ``wanted`` highest of a window, from ``floors`` to ``tops``.

        Every row of a window that belongs to its ``wanted`` highest is returned, and possibly others.
        """
        d = min(len(q), len(self.columns))
        q = q[:d]
        exact = np.abs(q).sum() * self.most < 2.0 ** 53
        kind = np.float64 if exact else np.int64
        columns, low, high = ((self.columns, self.low, self.high) if exact else (x.astype(np.int64) for x in (self.columns, self.low, self.high)))
        q = q.astype(kind)
        order = np.argsort(-np.abs(q), kind="stable")
        least, most = np.minimum(q[:, None] * low[:d], q[:, None] * high[:d])[order], np.maximum(q[:, None] * low[:d], q[:, None] * high[:d])[order]
        least, most = (np.concatenate([np.cumsum(x[::-1], axis=0)[::-1], np.zeros((1, x.shape[1]), kind)]) for x in (least, most))
        floors, score = floors.astype(kind), np.zeros(len(rows), kind)
        for at in range(0, d, self.mining.step):
            dims = order[at: at + self.mining.step]
            part = columns[dims] if len(rows) == columns.shape[1] else columns[np.ix_(dims, rows)]
            score = score + q[dims] @ part
            zone, after = self.zone[rows], min(at + self.mining.step, d)
            lower, upper = score + least[after][zone], score + most[after][zone]
            for w, top in enumerate(tops):
                sure = lower[upper <= top]
                if len(sure) >= wanted:
                    floors[w] = max(floors[w], np.partition(sure, len(sure) - wanted)[len(sure) - wanted])
            stay = np.zeros(len(rows), bool)
            for floor, top in zip(floors, tops):
                stay |= (upper >= floor) & (lower <= top)
            if not stay.all():
                rows, score = rows[stay], score[stay]
            if not len(rows):
                break
        return rows, score.astype(np.int64)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k different (score, id): higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores))
    scores, ids = scores[order], ids[order]
    fresh = np.r_[True, (scores[1:] != scores[:-1]) | (ids[1:] != ids[:-1])][: len(ids)]
    return scores[fresh][:k], ids[fresh][:k]


#: Below every score, above every score.
LOWEST, HIGHEST = -(1 << 62), 1 << 62


class Best:
    """What a task has found so far for the anchors of a block, window by window."""

    def __init__(self, row: dict, mining: Mining, positives: bool):
        n = row["b_n"]
        self.mining, self.positives = mining, positives
        self.keys, self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("b_keys", "b_ids", "b_labels"))
        self.vectors = np.frombuffer(row["b_vectors"], np.int32).reshape(n, -1).astype(np.int64)
        tops = np.frombuffer(row["b_tops"], np.int64).reshape(n, -1)
        self.wanted = mining.positives if positives else mining.negatives
        self.tops = [np.array([HIGHEST]) if positives else t[t >= 0] for t in tops]
        self.floors = [np.full(len(t), LOWEST) if positives else -(-t * mining.share // 100) for t in self.tops]
        none = np.zeros(0, np.int64)
        self.found = [[(none, none)] * len(t) for t in self.tops]

    def add(self, slab: Slab) -> None:
        for a, q in enumerate(self.vectors):
            lo, hi = np.searchsorted(slab.labels, self.labels[a], "left"), np.searchsorted(slab.labels, self.labels[a], "right")
            rows = np.arange(lo, hi) if self.positives else np.r_[0:lo, hi:len(slab.ids)]
            rows = rows[slab.ids[rows] != self.ids[a]]
            if not len(rows):
                continue
            tops, floors = self.tops[a], self.floors[a]
            rows, scores = slab.scan(q, rows, floors, tops, self.wanted)
            for w, top in enumerate(tops):
                inside = (scores >= floors[w]) & (scores <= top)
                if inside.any():
                    old = self.found[a][w]
                    best = _first(np.concatenate([old[0], scores[inside]]), np.concatenate([old[1], slab.ids[rows[inside]]]), self.wanted)
                    self.found[a][w] = best
                    if len(best[0]) == self.wanted:
                        floors[w] = max(floors[w], best[0][-1])

    def rows(self) -> pa.RecordBatch:
        key, top, score, other = [], [], [], []
        for k, tops, found in zip(self.keys.tolist(), self.tops, self.found):
            for t, (scores, ids) in zip(tops.tolist(), found):
                key += [k] * len(ids)
                top += [t] * len(ids)
                score += scores.tolist()
                other += ids.tolist()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, top, score, other)], ["key", "top", "score", "other"])


def _search(slabs: DataFrame, blocks: DataFrame, mining: Mining, positives: bool) -> DataFrame:
    """(key, top, score, other): the first rows of each anchor's windows over all slabs, equal ones once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                name = row["b_keys"]
                if name not in held:
                    if len(held) == 8:
                        yield held.pop(next(iter(held))).rows()
                    held[name] = Best(row, mining, positives)
                columns = np.frombuffer(row["vectors"], np.int32).reshape(-1, row["n"])
                held[name].add(Slab(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), columns, mining))
        for best in held.values():
            yield best.rows()

    # The query set, in blocks, against all slabs: each task holds one slab and one block at a time.
    met = slabs.crossJoin(blocks).mapInArrow(run, "key long, top long, score long, other long")
    place = Window.partitionBy("key", "top").orderBy(F.desc("score"), "other")
    best = met.withColumn("rank", F.dense_rank().over(place)).where(F.col("rank") <= (mining.positives if positives else mining.negatives))
    return best.dropDuplicates(["key", "top", "rank"])


def mine(vectors: DataFrame, is_anchor: Column, mining: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for ``vectors`` (vec_id, label, vector of doubles).

    Scores are inner products of floored components; where lengths differ, missing components count as zero. Positives are the first rows
    of the anchor's label, negatives the first ones of other labels from ``share`` percent of the positive's score up to that score; higher
    scores come first, then smaller ids. Rows with a null id, label or vector, a null or non-finite component, or one beyond the limit take no
    part. Equal rows count once; rows that share an id are never positives or negatives of each other. A positive with a score below
    zero has no negatives, as no score lies in its window.
    """
    fits = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * mining.scale) < mining.limit))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector")) \
        .where(F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fits, F.lit(False)))
    anchors = rows.where(is_anchor).distinct().withColumn("key", F.xxhash64("vec_id", "label", F.transform("vector", lambda x: x + F.lit(0.0))))
    anchors, _ = put(anchors.withColumn("tops", F.array().cast("array<long>")), "anchors")
    slabs = _slabs(rows, mining)
    blocks, _ = put(_blocks(anchors, mining), "anchor-blocks")
    positives, _ = put(_search(slabs, blocks, mining, True).select("key", "other", "score"), "positives")
    tops = positives.where("score >= 0").groupBy("key").agg(F.collect_set("score").alias("tops"))
    blocks, _ = put(_blocks(anchors.drop("tops").join(tops, "key"), mining), "positive-blocks")
    negatives = _search(slabs, blocks, mining, False).select("key", F.col("top").alias("score"), "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    named = positives.join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key")
    return named.join(negatives, ["key", "score"]).select(
        "anchor_id", F.col("other").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id",
        F.col("score").alias("positive_score"), "negative_score")


def hard_negatives(embeddings: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """``mine`` over embeddings (vec_id, embedding, label): anchors have ids divisible by 100; labels of ids divisible by 7 move up by one, modulo 10."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(embeddings.select("vec_id", moved.alias("label"), F.col("embedding").alias("vector")), F.col("vec_id") % 100 == 0, mining)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
