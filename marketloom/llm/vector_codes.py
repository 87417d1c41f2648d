"""Product codes of vectors: a codebook for each part, refined by rounds of nearest entries, which a tree over the entries finds.

The tree (GNAT) has split points; for each split point and each child it stores between which distances from the point the child's entries
lie. A query whose distance to a split point shows that a child has nothing as near as the best entry so far leaves that whole subtree out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.scratch import put


@dataclass(frozen=True)
class Coding:
    """``parts`` of a vector, ``entries`` of a codebook (at most 256), ``rounds`` of refinement. Components are floored multiples of
    1 / ``scale``; rows with one of ``limit`` or more in magnitude, whose distances a long might not hold, are left out. ``fan`` split points a
    node, ``leaf`` entries at most without one."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    limit: int = 1 << 24
    fan: int = 8
    leaf: int = 6


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to y, exact: the caller sees to it that they fit."""
    apart = x - y
    return np.einsum("ij,ij->i", apart, apart)


class Node:
    """A subtree over the entries ``numbers`` (ascending)."""

    def __init__(self, entries: np.ndarray, numbers: np.ndarray, coding: Coding):
        self.numbers, self.entries = numbers, entries[numbers]
        self.splits: list[int] = []
        if len(numbers) <= coding.leaf:
            return
        # Split points far from each other, beginning with the first entry.
        own = self.entries
        apart = [_squares(own, own[0])]
        picks = [0]
        while len(picks) < min(coding.fan, len(numbers)):
            far = int(np.argmax(np.minimum.reduce(apart)))
            if far in picks:
                break
            picks.append(far)
            apart.append(_squares(own, own[far]))
        if len(picks) == 1:
            return
        squares = np.stack(apart)
        child = np.argmin(squares, axis=0)
        child[picks] = np.arange(len(picks))
        far = np.sqrt(squares.astype(np.float64))
        self.splits = picks
        self.near = np.array([[far[i, child == j].min() for j in range(len(picks))] for i in range(len(picks))])
        self.wide = np.array([[far[i, child == j].max() for j in range(len(picks))] for i in range(len(picks))])
        self.children = []
        for j, pick in enumerate(picks):
            rest = numbers[(child == j) & (np.arange(len(numbers)) != pick)]
            self.children.append(Node(entries, rest, coding) if len(rest) else None)


class Gnat:
    """Nearest entries of many vectors at once; of equally near ones the lowest number."""

    def __init__(self, entries: np.ndarray, coding: Coding = Coding()):
        self.most = float(np.abs(entries).max(initial=0))
        self.entries = entries.astype(np.int64)
        self.root = Node(self.entries, np.arange(len(entries)), coding)
        self.compared = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of integers."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        entry = np.full(len(x), len(self.entries))
        if len(x):
            self._visit(self.root, x, np.arange(len(x)), best, entry)
        return entry, best

    def _take(self, rows: np.ndarray, square: np.ndarray, number: int, best: np.ndarray, entry: np.ndarray) -> None:
        self.compared += len(rows)
        better = (square < best[rows]) | ((square == best[rows]) & (number < entry[rows]))
        best[rows[better]], entry[rows[better]] = square[better], number

    def _visit(self, node: Node, x: np.ndarray, rows: np.ndarray, best: np.ndarray, entry: np.ndarray) -> None:
        if not node.splits:
            for number, point in zip(node.numbers.tolist(), node.entries):
                self._take(rows, _squares(x[rows], point), number, best, entry)
            return
        alive = np.ones((len(rows), len(node.splits)), bool)
        for i, split in enumerate(node.splits):
            at = np.flatnonzero(alive[:, i])
            if not len(at):
                continue
            mine = rows[at]
            square = _squares(x[mine], node.entries[split])
            self._take(mine, square, int(node.numbers[split]), best, entry)
            far, reach = np.sqrt(square.astype(np.float64)), np.sqrt(best[mine].astype(np.float64))
            # Only what is strictly farther goes, with room for the rounding of the roots: an equally near entry may have a lower number.
            room = reach + 1e-9 * (1.0 + far + reach)
            alive[at] &= (far[:, None] - node.wide[i] <= room[:, None]) & (node.near[i] - far[:, None] <= room[:, None])
        for j, child in enumerate(node.children):
            at = rows[alive[:, j]]
            if child is not None and len(at):
                self._visit(child, x, at, best, entry)


def _borders(length: int, coding: Coding) -> list[int]:
    """Where the parts begin and end; parts are equal where the length divides."""
    return [length * k // coding.parts for k in range(coding.parts + 1)]


def _integers(column: pa.Array, length: int, coding: Coding) -> np.ndarray:
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False) * float(coding.scale)).astype(np.int64)
    out = np.zeros((len(sizes), length), np.int64)
    out[np.arange(length) < sizes[:, None]] = flat
    return out


def _assign(x: np.ndarray, trees: list[Gnat], borders: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (row, part) and the squared distances summed over parts."""
    found = [tree.nearest(np.ascontiguousarray(x[:, lo:hi])) for tree, lo, hi in zip(trees, borders, borders[1:])]
    return np.stack([entry for entry, _ in found], 1), sum(square for _, square in found)


def _kept(embeddings: DataFrame, coding: Coding) -> DataFrame:
    fits = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * coding.scale) < coding.limit))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.where(F.coalesce(F.col("vector").isNotNull() & fits, F.lit(False)))


BATCH = 4096


def train(rows: DataFrame, length: int, coding: Coding = Coding()) -> list[np.ndarray]:
    """A codebook (entry, component) for each part. Each round is a pass over the rows that returns sums and counts of the entries; what comes to
    the driver is as large as the codebooks."""
    borders = _borders(length, coding)
    start = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(coding.entries).select("vector").toArrow().combine_chunks()
    first = _integers(start.column("vector").combine_chunks(), length, coding)
    books = [first[:, lo:hi].copy() for lo, hi in zip(borders, borders[1:])]
    width = max(hi - lo for lo, hi in zip(borders, borders[1:]))
    for _ in range(coding.rounds):
        trees = [Gnat(b, coding) for b in books]

        def run(batches: Iterator[pa.RecordBatch], trees=trees) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((coding.parts, len(first), width), np.int64)
            counts = np.zeros((coding.parts, len(first)), np.int64)
            for batch in batches:
                for lo in range(0, batch.num_rows, BATCH):
                    x = _integers(batch.column("vector").slice(lo, BATCH), length, coding)
                    codes, _ = _assign(x, trees, borders)
                    for k, (a, b) in enumerate(zip(borders, borders[1:])):
                        order = np.argsort(codes[:, k], kind="stable")
                        entry = codes[order, k]
                        begin = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]])
                        sums[k, entry[begin], : b - a] += np.add.reduceat(x[order, a:b], begin, axis=0)
                        counts[k] += np.bincount(entry, minlength=len(first))
            part, entry = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]),
                                              pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

        told = rows.select("vector").mapInArrow(run, "part int, entry int, n long, sums array<long>").groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
        for r in told.collect():
            book = books[r["part"]]
            book[r["entry"]] = [s // r["n"] for s in r["sums"][: book.shape[1]]]
    return books


def encode(rows: DataFrame, books: list[np.ndarray], length: int, coding: Coding = Coding()) -> DataFrame:
    """vec_id, label, code (two hex digits for each part) and error (squared distances summed over parts) of every row."""
    borders, trees = _borders(length, coding), [Gnat(b, coding) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                codes, error = _assign(_integers(part.column("vector"), length, coding), trees, borders)
                digits, wide = codes.astype(np.uint8).tobytes().hex(), 2 * coding.parts
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array([digits[i: i + wide] for i in range(0, len(digits), wide)], pa.string()),
                                                  pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, "vec_id long, label long, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


#: A label with more than this share of the rows is joined by broadcast, of which there are at most 1 / share.
HEAVY = 1000


def compress(embeddings: DataFrame, coding: Coding = Coding()) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row whose vector can be coded.

    Rows whose vector is null or holds a null or non-finite component, or one beyond the limit, are left out. Shorter vectors than the
    longest count as ending in zeros, and parts differ by a component where the length does not divide. Fewer kept rows than entries
    make smaller codebooks. Rows that repeat an id are rows of their own; null ids come last. Equal labels, nulls together, share ``label_error``.
    """
    rows = _kept(embeddings, coding)
    length = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    books = train(rows, length, coding)
    coded, _ = put(encode(rows, books, length, coding), "coded")
    totals, _ = put(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    share = (totals.agg(F.sum("n")).first()[0] or 0) / HEAVY
    heavy, light = F.broadcast(totals.where(F.col("n") > share)), totals.where(F.col("n") <= share)
    same = F.col("label").eqNullSafe(F.col("of"))
    told = coded.join(heavy, same).unionByName(coded.join(heavy, same, "left_anti").join(light, same))
    return told.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Plain SQL of the same rounds: all distances, the least of ``distance * entries + entry``."""
    ctes = [f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            f"""p AS MATERIALIZED (SELECT vec_id, label, part, q[part * len(q) // {parts} + 1 : (part + 1) * len(q) // {parts}] AS x FROM v, range({parts}) t(part))""",
            f"""c0 AS MATERIALIZED (SELECT part, entry, x AS y FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v) USING (vec_id)
  WHERE entry < {entries})"""]
    for k in range(rounds + 1):
        ctes.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, label, part, x, least % {entries} AS entry, least // {entries} AS error FROM (
  SELECT vec_id, p.label, part, any_value(x) AS x, min((list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y))::BIGINT * {entries} + entry) AS least
  FROM p JOIN c{k} USING (part) GROUP BY vec_id, p.label, part))""")
        if k < rounds:
            ctes.append(f"""c{k + 1} AS MATERIALIZED (SELECT c{k}.part, c{k}.entry, coalesce(m.y, c{k}.y) AS y FROM c{k} LEFT JOIN (
  SELECT part, entry, list(mean ORDER BY place) AS y FROM (
    SELECT part, entry, place, floor(sum(value) / count(*)) AS mean FROM (SELECT part, entry, unnest(x) AS value, generate_subscripts(x, 1) AS place FROM a{k})
    GROUP BY part, entry, place) GROUP BY part, entry) m USING (part, entry))""")
    return "WITH " + ", ".join(ctes) + f""", r AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', entry::INTEGER)), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(y, lambda z: z::BIGINT), ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256 FROM r"""


ORACLE = _oracle()
