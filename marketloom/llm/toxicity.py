"""Toxicity of texts: a small convolutional classifier on hashed word embeddings, trained by tasks over shards of the labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.scratch import drop, free_name, put
from marketloom.llm.textscan import FOLD, WORD_LIKE, Substrings, small_batches, text_bytes, words
from marketloom.session import light_batches

#: Rows of the id 0 begin a text, rows of the id 1 pad its end; words are hashed to the ids above.
BEGIN, PAD, FIRST = 0, 1, 2
BLOCK = 1 << 14
#: Places of a learning step in memory at a time; changes of weights are whole multiples of 2 ** -FRACTION, logits of thresholds of 2 ** -GRID.
STEP_BLOCK, FRACTION, GRID = 1 << 16, 40, 10
#: Labelled numbers that are broadcast, some 100 MB.
BROADCAST_LABELS = 6_000_000


@dataclass(frozen=True)
class Settings:
    """Every labelled row of every length is learnt from, and every row is scored. ``shard_rows`` is the least number of rows between two
    averages of the weights and ``most_shards`` the largest number of shards. A step of ``batch`` rows is cut where their word ids exceed
    ``sample_bytes`` (0 learns nothing). A bucket has a vector of its own if at least ``least_rows`` of the learnt rows hold it, else the zero vector."""

    buckets: int = 1 << 20
    least_rows: int = 3
    size: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 12
    stem: int = 5
    shard_rows: int = 4096
    most_shards: int = 8
    sample_bytes: int = 64_000_000
    epochs: int = 8
    batch: int = 32
    rate: float = 0.1
    seed: int = 7
    least_by_language: int = 30


@dataclass
class Model:
    """Weights, and the score from which a text of a language is rejected; ``None`` holds for other languages."""

    settings: Settings
    lookup: np.ndarray
    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    constant: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str | None, float] = field(default_factory=lambda: {None: 0.5})

    def score(self, pooled: np.ndarray) -> np.ndarray:
        return _logistic(self.scale * self.logits(pooled) + self.shift)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return (np.maximum(pooled + self.bias, 0) * self.dense).sum(axis=1) + self.constant

    def steady(self) -> Model:
        """Weights rounded to binary fractions whose products and sums are exact in double precision, so the score of a text does not
        depend on the texts beside it in a batch."""
        table = (np.round(self.table * 2.0**12) / 2.0**12).astype(np.float32)
        return replace(self, table=table, filters=[np.round(f.astype(np.float64) * 2.0**14) / 2.0**14 for f in self.filters])

    def pool(self, ids: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Largest answer of each filter over all places of each text; places behind the words of a text do not count."""
        s = self.settings
        reach = max(s.widths) - 1
        flat = np.concatenate([w.transpose(1, 0, 2).reshape(s.size, -1) for w in self.filters], axis=1)
        pooled = np.full((rows, len(s.widths) * s.filters), -np.inf, np.float32)
        for lo in range(0, len(row), BLOCK):
            hi = min(lo + BLOCK, len(row))
            part = ids[lo: min(hi + reach, len(row))]
            x = self.table[self.lookup[part]].sum(axis=1)
            if hi + reach > len(row):
                x = np.concatenate([x, np.zeros((hi + reach - len(row), s.size), np.float32)])
            y = x @ flat
            here = np.flatnonzero(part[: hi - lo, 0] != PAD)
            of = row[lo:hi][here]
            if not len(here):
                continue
            cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            at = 0
            for k, width in enumerate(s.widths):
                z = y[: hi - lo, at: at + s.filters]
                for j in range(1, width):
                    z = z + y[j: hi - lo + j, at + j * s.filters: at + (j + 1) * s.filters]
                at += width * s.filters
                best = np.maximum.reduceat(z[here], cuts, axis=0)
                span = slice(k * s.filters, (k + 1) * s.filters)
                pooled[of[cuts], span] = np.maximum(pooled[of[cuts], span], best)
        return pooled


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def token_ids(data: np.ndarray, offsets: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(ids, row): two ids for each word, of the word and of its first bytes; every text begins with BEGIN and ends with PADs."""
    rows, pads = len(offsets) - 1, max(settings.widths) - 1
    parts, owners = [np.zeros((0, 2), np.int32)], [np.zeros(0, np.int64)]
    half = np.uint64(settings.buckets)
    for chunk in words(offsets, data, WORD_LIKE, FOLD):
        sub = Substrings(chunk.data)
        whole = sub.hash(chunk.start, chunk.end) % half
        stem = sub.hash(chunk.start, np.minimum(chunk.end, chunk.start + settings.stem)) % half + half
        parts.append(np.stack([whole, stem], axis=1).astype(np.int32) + FIRST)
        owners.append(chunk.row)
    found, owner = np.concatenate(parts), np.concatenate(owners)
    count = np.bincount(owner, minlength=rows)
    start = np.cumsum(count + 1 + pads) - count - 1 - pads
    ids = np.full((len(found) + rows * (1 + pads), 2), PAD, np.int32)
    ids[start] = BEGIN
    ids[start[owner] + 1 + np.arange(len(found)) - (np.cumsum(count) - count)[owner]] = found
    return ids, np.repeat(np.arange(rows), count + 1 + pads)


def untrained(settings: Settings, constant: float = -60.0, texts: list[np.ndarray] = []) -> Model:
    """A model before its first step, with vectors for the buckets that enough of ``texts`` hold."""
    seen = np.zeros(2 * settings.buckets + FIRST, np.int64)
    for ids in texts:
        seen[np.unique(ids)] += 1
    return _untrained(settings, constant, seen)


def _untrained(settings: Settings, constant: float, seen: np.ndarray) -> Model:
    """``seen``: the number of rows that hold a bucket."""
    r = np.random.default_rng(settings.seed)
    seen[BEGIN] = settings.least_rows
    own = np.flatnonzero(seen >= settings.least_rows)
    lookup = np.zeros(len(seen), np.int32)
    lookup[own] = np.arange(1, len(own) + 1)
    table = r.normal(0, 0.3, (len(own) + 1, settings.size)).astype(np.float32)
    table[0] = 0
    filters = [r.normal(0, (settings.size * w) ** -0.5, (w, settings.size, settings.filters)).astype(np.float32) for w in settings.widths]
    n = len(settings.widths) * settings.filters
    return Model(settings, lookup, table, filters, np.zeros(n, np.float32), np.zeros(n, np.float32), constant)


class Learner:
    """A model in training: gradient steps with per-weight rates; ``speed`` and ``table_speed`` are the sums of squares behind the rates."""

    def __init__(self, model: Model, flat: np.ndarray | None = None, table_speed: np.ndarray | None = None):
        self.model = model
        self.weights = [*model.filters, model.bias, model.dense]
        self.speed = [np.full_like(w, 1e-6) for w in self.weights]
        self.constant_speed = 1e-6
        self.table_speed = np.full(len(model.table), 1e-6, np.float32) if table_speed is None else table_speed
        if flat is not None:
            self.load(flat)

    def flat(self) -> np.ndarray:
        """All weights but the table, with their speeds."""
        ends = np.array([self.model.constant, self.constant_speed])
        return np.concatenate([*[w.ravel() for w in (*self.weights, *self.speed)], ends]).astype(np.float64)

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for w in (*self.weights, *self.speed):
            w[...] = flat[at: at + w.size].reshape(w.shape)
            at += w.size
        self.model.constant, self.constant_speed = float(flat[at]), float(flat[at + 1])

    def tops(self, ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each width the largest answers of every text and filter, and their places; a block of places is in memory at a time."""
        s, model = self.model.settings, self.model
        reach = max(s.widths) - 1
        tops = [np.full((len(begin), s.filters), -np.inf, np.float32) for _ in s.widths]
        places = [np.zeros((len(begin), s.filters), np.int64) for _ in s.widths]
        for lo in range(0, len(ids), STEP_BLOCK):
            hi = min(lo + STEP_BLOCK, len(ids))
            x = model.table[ids[lo: hi + reach]].sum(axis=1)
            x = np.concatenate([x, np.zeros((hi - lo + reach - len(x), s.size), np.float32)])
            inside = [(k, max(b, lo) - lo, min(b + n, hi) - lo) for k, (b, n) in enumerate(zip(begin, size)) if b < hi and b + n > lo]
            for top, at, w, filters in zip(tops, places, s.widths, model.filters):
                z = sum(x[j: hi - lo + j] @ filters[j] for j in range(w))
                for k, a, b in inside:
                    best = z[a:b].argmax(axis=0)
                    value = np.take_along_axis(z[a:b], best[None], axis=0)[0]
                    more = value > top[k]
                    top[k][more], at[k][more] = value[more], (lo + a + best)[more]
        return tops, places

    def step(self, texts: list[np.ndarray], toxic: np.ndarray) -> None:
        """One step over a few texts, given as rows of the table (without BEGIN and PAD)."""
        s, model = self.model.settings, self.model
        reach = max(s.widths) - 1
        head, tail = np.full((1, 2), model.lookup[BEGIN], np.int32), np.full((reach, 2), model.lookup[PAD], np.int32)
        ids = np.concatenate([p for t in texts for p in (head, t, tail)])
        size = np.array([len(t) + 1 for t in texts])
        begin = np.cumsum(size + reach) - size - reach
        tops, places = self.tops(ids, begin, size)
        raw = np.concatenate(tops, axis=1) + model.bias
        hidden = np.maximum(raw, 0)
        error = (_logistic(hidden @ model.dense + model.constant) - toxic) / len(texts)
        back = error[:, None] * model.dense * (raw > 0)
        steps: list[np.ndarray] = []
        rows, moves = [], []
        for k, (w, filters) in enumerate(zip(s.widths, model.filters)):
            g = back[:, k * s.filters: (k + 1) * s.filters]
            step = np.zeros_like(filters)
            for j in range(w):
                hit = ids[np.minimum(places[k] + j, len(ids) - 1)]
                step[j] = np.einsum("bfd,bf->df", model.table[hit].sum(axis=2), g)
                rows.append(hit.reshape(-1, 2))
                moves.append((g[:, :, None] * filters[j].T[None]).reshape(-1, s.size))
            steps.append(step)
        steps += [back.sum(axis=0), hidden.T @ error]
        for w, v, step in zip(self.weights, self.speed, steps):
            v += step * step
            w -= (s.rate * step / np.sqrt(v)).astype(np.float32)
        self.constant_speed += float(error.sum()) ** 2
        model.constant -= s.rate * float(error.sum()) / self.constant_speed ** 0.5
        _move(model.table, self.table_speed, np.concatenate(rows), np.concatenate(moves), s.rate)


def learn_shard(model: Model, flat: np.ndarray, table_speed: np.ndarray, rows: Iterator[tuple[np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
    """One pass over a shard from the shared weights: what it changes, as whole multiples of a small fraction, so that sums are exact.

    A row of the result is a row of the table (its vector, then its speed) or, behind those, a piece of the other weights. Changes are
    made exact and given out ``BLOCK`` rows at a time, so a task holds the table and its own copy but no further ones.
    """
    s = model.settings
    own = replace(model, table=model.table.copy(), filters=[f.copy() for f in model.filters], bias=model.bias.copy(), dense=model.dense.copy())
    learner = Learner(own, flat, table_speed.copy())
    texts: list[np.ndarray] = []
    marks: list[int] = []
    held = 0

    def step() -> None:
        learner.step(texts, np.array(marks, np.float32))
        texts.clear()
        marks.clear()

    for ids, mark in rows:
        if texts and (len(texts) == s.batch or held + ids.nbytes > s.sample_bytes):
            step()
            held = 0
        texts.append(own.lookup[ids])
        marks.append(mark)
        held += ids.nbytes
    if texts:
        step()
    moved = np.flatnonzero((own.table != model.table).any(axis=1) | (learner.table_speed != table_speed))
    rest = learner.flat() - flat
    rest = np.concatenate([rest, np.zeros(-len(rest) % s.size)]).reshape(-1, s.size)

    def batch(place: np.ndarray, vector: np.ndarray, speed: np.ndarray) -> pa.RecordBatch:
        cells = np.concatenate([vector, speed[:, None]], axis=1)
        exact = np.round(cells * 2.0**FRACTION).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), *[pa.array(c) for c in exact.T]], ["place", *[f"c{k}" for k in range(s.size + 1)]])

    for lo in range(0, len(moved), BLOCK):
        at = moved[lo: lo + BLOCK]
        yield batch(at, own.table[at] - model.table[at].astype(np.float64), learner.table_speed[at] - table_speed[at].astype(np.float64))
    yield batch(len(model.table) + np.arange(len(rest)), rest, np.zeros(len(rest)))


def fit(rows: DataFrame, shards: int, seen: np.ndarray, settings: Settings) -> Model:
    """Learns from all ``rows`` (shard, toxic, ids), whose shards lie together and in order.

    In each epoch every shard makes a pass of steps from the same weights, and the weights become the average over the shards; a vector
    is averaged over the shards that moved it. Weights go to the tasks and changes come back, never rows.
    """
    s, r = settings, np.random.default_rng(settings.seed)
    model = _untrained(s, 0.0, seen)
    model.dense[:] = r.normal(0, 0.3, len(model.dense))
    learner, names = Learner(model), [f"c{k}" for k in range(s.size + 1)]
    context = rows.sparkSession.sparkContext
    for _ in range(s.epochs):
        shared = context.broadcast((model, learner.flat(), learner.table_speed))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            each = ((shard, np.frombuffer(ids.as_buffer(), np.int32).reshape(-1, 2), mark) for b in batches
                    for shard, ids, mark in zip(b.column("shard").to_pylist(), b.column("ids"), b.column("toxic").to_pylist()))
            for _, own in groupby(each, key=lambda x: x[0]):
                yield from learn_shard(*shared.value, ((ids, mark) for _, ids, mark in own))

        moved = rows.select("shard", "toxic", "ids").mapInArrow(run, "place long, " + ", ".join(f"{c} long" for c in names))
        mean = [(F.sum(c) / F.count(F.lit(1)) / F.lit(2.0**FRACTION)).alias(c) for c in names]
        got = moved.groupBy("place").agg(*mean).toArrow()
        place = got.column("place").to_numpy()
        cells = np.stack([got.column(c).to_numpy() for c in names], axis=1)
        vector = place < len(model.table)
        model.table[place[vector]] += cells[vector, :-1].astype(np.float32)
        learner.table_speed[place[vector]] += cells[vector, -1].astype(np.float32)
        rest = cells[~vector][np.argsort(place[~vector]), :-1].ravel()
        flat = learner.flat()
        learner.load(flat + rest[: len(flat)])
        shared.destroy()
    return model


def _move(table: np.ndarray, speed: np.ndarray, rows: np.ndarray, moves: np.ndarray, rate: float) -> None:
    hit, inverse = np.unique(rows.ravel(), return_inverse=True)
    step = np.zeros((len(hit), table.shape[1]), np.float32)
    np.add.at(step, inverse, np.repeat(moves, 2, axis=0))
    step[hit == 0] = 0
    speed[hit] += (step * step).mean(axis=1)
    table[hit] -= rate * step / np.sqrt(speed[hit])[:, None]


def calibrate(model: Model, logits: np.ndarray, toxic: np.ndarray, lang: list[str | None], weight: np.ndarray) -> Model:
    """Sets scale and shift of the scores, and for each language the threshold of fewest errors; ``weight`` is the number of rows of a logit.

    Languages with fewer than ``least_by_language`` rows or without both classes take the threshold found over all rows. Ties take the
    threshold nearest one half.
    """
    toxic, weight = np.asarray(toxic, float), np.asarray(weight, float)
    if len(toxic) and 0 < toxic.mean() < 1:
        a, b = 1.0, 0.0
        # The same sums in the same order, whatever the languages are.
        (x, t), at = np.unique(np.stack([logits, toxic]), axis=1, return_inverse=True)
        n = np.bincount(at.ravel(), weight)
        for _ in range(200):
            p = _logistic(a * x + b)
            e, h = n * (p - t), n * np.maximum(p * (1 - p), 1e-6)
            grad = np.array([e @ x, e.sum()]) + np.array([1e-2 * (a - 1), 1e-3 * b])
            curve = np.array([[h @ (x * x) + 1e-2, h @ x], [h @ x, h.sum() + 1e-3]])
            step = np.linalg.solve(curve, grad)
            a, b = max(0.05, a - np.clip(step[0], -0.5, 0.5)), b - np.clip(step[1], -0.5, 0.5)
        model.scale, model.shift = float(a), float(b)
    score = _logistic(model.scale * logits + model.shift)
    model.thresholds = {None: _threshold(score, toxic, weight)}
    named = np.array([x if x is not None else "" for x in lang], object)
    for language in sorted({x for x in lang if x is not None}):
        own = named == language
        if weight[own].sum() >= model.settings.least_by_language and 0 < toxic[own].mean() < 1:
            model.thresholds[language] = _threshold(score[own], toxic[own], weight[own])
    return model


def _threshold(score: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    if not len(score) or toxic.min() == toxic.max():
        return 0.5
    order = np.sort(np.unique(score))
    cuts = np.concatenate([[0.5], (order[1:] + order[:-1]) / 2])
    by = np.argsort(score)
    s, t, w = score[by], toxic[by], weight[by]
    missed = np.r_[0, np.cumsum(w * t)]
    alarms = np.r_[np.cumsum((w * (1 - t))[::-1])[::-1], 0]
    wrong = (missed + alarms)[np.searchsorted(s, cuts, "left")]
    best = cuts[wrong <= wrong.min() + 1e-12]
    return float(best[np.argmin(np.abs(best - 0.5))])


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from; a null id is not held out but has no label either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fits on all labelled rows outside the held-out part, whole texts of any length.

    Of rows that repeat a doc_id in ``labels`` the largest label counts; null labels are no labels. Rows of ``docs`` that repeat a labelled
    number are learnt from each. A fifth of the rows is kept for scores and thresholds. Rows stay in the tasks: counts of buckets, changes of
    weights and counts of rounded logits come to the driver. With one class or no rows, every score is 0 (no toxic rows) or 1 (only toxic rows).
    """
    s, spark = settings, docs.sparkSession
    light_batches(spark)
    if s.sample_bytes <= 0:
        return untrained(s)
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.where(F.col("toxic").isin(0, 1))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    marked = own.count()
    # Texts stay where they are while the labelled numbers have a bounded size; beyond it both sides are shuffled.
    chosen = narrow.where(~held_out(F.col("doc_id"))).join(F.broadcast(own) if marked <= BROADCAST_LABELS else own, "doc_id")
    # Shards are equal parts of the hash of the number; a label stands for about one row.
    shards = max(1, min(s.most_shards, marked // s.shard_rows))
    place = lambda seed: F.xxhash64("doc_id", F.lit(s.seed + seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pads = max(s.widths) - 1
        for batch in small_batches(batches):
            ids, row = token_ids(*text_bytes(batch.column("text")), s)
            sizes = np.bincount(row, minlength=batch.num_rows)
            lists = [ids[e - n + 1: e - pads].ravel().tobytes() for n, e in zip(sizes, np.cumsum(sizes))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "lang", "toxic")], pa.array(lists, pa.binary())],
                                             ["doc_id", "lang", "toxic", "ids"])

    coded = chosen.select("doc_id", "lang", "toxic", "text").mapInArrow(run, "doc_id long, lang string, toxic int, ids binary")
    dealt = coded.withColumns({"shard": F.pmod(place(0), F.lit(shards)).cast("int"), "kept": F.pmod(place(1), F.lit(5)) == 0})
    rows, where = put(dealt.repartition(shards, "shard").sortWithinPartitions("shard", place(2), "doc_id", "ids"), "toxic-rows")
    try:
        return _trained(rows, shards, s)
    finally:
        drop(spark, where)


def _cut(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``limit`` bytes of ids."""
    for batch in batches:
        group = np.cumsum([len(ids.as_buffer()) for ids in batch.column("ids")]) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(lo, hi - lo) for lo, hi in zip(cuts[:-1], cuts[1:]) if hi > lo)


def _trained(rows: DataFrame, shards: int, settings: Settings) -> Model:
    count = {(r["kept"], r["toxic"] == 1): r["n"] for r in rows.groupBy("kept", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = {toxic for _, toxic in count}
    if len(classes) < 2:
        return untrained(settings, 60.0 if True in classes else -60.0)
    spare = len(count) == 4
    learnt = rows.where(~F.col("kept")) if spare else rows

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(2 * settings.buckets + FIRST, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                seen[np.unique(np.frombuffer(ids.as_buffer(), np.int32))] += 1
        hit = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(seen[hit])], ["bucket", "n"])

    often = learnt.select("ids").mapInArrow(buckets, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= settings.least_rows).toArrow()
    seen = np.zeros(2 * settings.buckets + FIRST, np.int64)
    seen[often.column("bucket").to_numpy()] = often.column("n").to_numpy()
    model = fit(learnt, shards, seen, settings).steady()
    if not spare:
        return model

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pads = max(settings.widths) - 1
        for batch in _cut(batches, 1 << 22):
            texts = [np.frombuffer(t.as_buffer(), np.int32).reshape(-1, 2) for t in batch.column("ids")]
            ids = np.concatenate([p for t in texts for p in (np.full((1, 2), BEGIN, np.int32), t, np.full((pads, 2), PAD, np.int32))])
            row = np.repeat(np.arange(len(texts)), [len(t) + 1 + pads for t in texts])
            cell = np.round(model.logits(model.pool(ids, row, len(texts))).astype(float) * 2.0**GRID).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("toxic"), pa.array(cell)], ["lang", "toxic", "cell"])

    cells = rows.where("kept").select("lang", "toxic", "ids").mapInArrow(logits, "lang string, toxic int, cell long")
    got = cells.groupBy("lang", "toxic", "cell").agg(F.count(F.lit(1)).alias("n")).orderBy("lang", "toxic", "cell").toArrow()
    return calibrate(model, got.column("cell").to_numpy() / 2.0**GRID, got.column("toxic").to_numpy(), got.column("lang").to_pylist(), got.column("n").to_numpy())


def score_texts(docs: DataFrame, model: Model, column: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) of every whole text; null texts are scored as empty. A column named ``out`` is replaced."""
    light_batches(docs.sparkSession)
    kept = docs.drop(out)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + f", `{out}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1 << 22, column):
            ids, row = token_ids(*text_bytes(batch.column(column)), model.settings)
            scores = model.score(model.pool(ids, row, batch.num_rows)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, out])

    return kept.mapInArrow(run, schema)


def threshold(model: Model, lang: Column) -> Column:
    """The threshold of each row's language."""
    out = F.lit(model.thresholds[None])
    for language, value in sorted((k, v) for k, v in model.thresholds.items() if k is not None):
        out = F.when(lang == language, F.lit(value)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted (score at least 0.5), and lang_threshold and rejected by the threshold of the language.

    The score is made from the text alone; the language only chooses the threshold of ``rejected``.
    """
    model = train(docs, labels, settings)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    scored = score_texts(narrow, model).drop("text").withColumn("lang_threshold", threshold(model, F.col("lang")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         "lang_threshold", (F.col("score") >= F.col("lang_threshold")).alias("rejected"))


def keep_clean(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows of ``docs`` below the threshold of their language, with their columns as they came."""
    model = train(docs, labels, settings)
    score = free_name(docs, "_toxicity")
    return score_texts(docs, model, out=score).where(F.col(score) < threshold(model, F.col("lang"))).drop(score)
