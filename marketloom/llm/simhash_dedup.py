"""Near-duplicates by SimHash of word shingles and multi-index hashing of the fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.components import components
from marketloom.llm.hashing import bit_counts, majority, xxh64
from marketloom.llm.scratch import free_name, put
from marketloom.llm.textscan import FOLD, NOT_WHITE, pieces, text_bytes, small_batches

SHINGLE, SEED, RADIUS = 3, 42, 3


def simhash(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprints (uint64) of many texts that lie behind each other.

    ASCII letters are lower-cased; a text of fewer words than a shingle is one shingle, one without words has fingerprint zero.
    """
    texts = len(offsets) - 1
    counts = np.zeros((texts, 64), np.int64)
    totals = np.zeros(texts, np.int64)
    # Words with one space behind each, and where each begins and whose it is.
    text, sizes, row = [], [], []
    for lo, hi in pieces(offsets, data, NOT_WHITE):
        part = FOLD[data[lo:hi]]
        inside = NOT_WHITE[part]
        a, b = np.searchsorted(offsets, (lo, hi))
        edge = np.zeros(hi - lo + 1, bool)
        edge[[0, -1]] = True
        edge[offsets[a:b] - lo] = True
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | edge[1:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | edge[1:-1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        sizes.append(end - start)
        row.append(np.searchsorted(offsets[:-1], start + lo, "right") - 1)
        where = np.cumsum(inside)[inside] - 1 + np.repeat(np.arange(len(start)), end - start)
        spaced = np.full(int((end - start).sum()) + len(start), 32, np.uint8)
        spaced[where] = part[inside]
        text.append(spaced)
    spaced, size, row = np.concatenate(text or [data]), np.concatenate(sizes or [offsets[:0]]), np.concatenate(row or [offsets[:0]])
    begin = np.cumsum(size + 1) - size - 1
    words = np.bincount(row, minlength=texts)
    first = np.cumsum(words) - words
    # A shingle begins at each word that has enough words of its text from it on, or at the first word of a short text.
    left = words[row] - (np.arange(len(row)) - first[row])
    at = np.flatnonzero((left >= shingle) | ((words[row] < shingle) & (left == words[row])))
    last = at + np.minimum(shingle, words[row[at]]) - 1
    hashes = xxh64(spaced, begin[at], begin[last] + size[last], seed)
    counts = bit_counts(hashes, row[at], texts)
    totals = np.bincount(row[at], minlength=texts)
    return majority(counts, totals)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the SimHash of every whole text as a signed long; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1 << 22):
            data, offsets = text_bytes(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(simhash(data, offsets, shingle, seed).view(np.int64))],
                                             ["doc_id", "fp"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def distance(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two fingerprints."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def close_pairs(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: pairs of distinct fingerprints of ``fps`` (column fp) at ``radius`` or fewer differing bits.

    A fingerprint is cut into segments so few that one of them differs in at most one bit; each fingerprint is entered once for every
    segment and looked up under every value of the Hamming ball of radius one around its segments. Pairs that meet in several segments
    are kept from the first only.
    """
    segments = radius // 2 + 1
    width = -(-64 // segments)
    cuts = [(i * width, min(width, 64 - i * width)) for i in range(segments)]

    def signed(bits: int) -> Column:
        return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")

    def segment(c: str, i: int) -> Column:
        at, n = cuts[i]
        return F.shiftrightunsigned(F.col(c), at).bitwiseAND(signed((1 << n) - 1))

    # A distinct table may come in few partitions; its rows grow many times here. By another key, as one by the same would be left out.
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    table = fps.select(F.col("fp").alias("b"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("s"), segment("fp", i).alias("k")) for i in range(segments)])).alias("e")).select("b", "e.s", "e.k")
    ball = fps.select(F.col("fp").alias("a"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("s"), segment("fp", i).bitwiseXOR(signed(flip)).alias("k"))
        for i, (_, n) in enumerate(cuts) for flip in [0, *(1 << j for j in range(n))]])).alias("e")).select("a", "e.s", "e.k")
    found = ball.join(table, ["s", "k"]).where("a < b").where(distance("a", "b") <= radius)
    earlier = F.lit(False)
    for i in range(segments - 1):
        earlier = earlier | ((F.col("s") > i) & (F.bit_count(segment("a", i).bitwiseXOR(segment("b", i))) <= 1))
    return found.where(~earlier).select("a", "b")


def _classes(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, root) for every distinct fingerprint; root names its component."""
    classes = fps.select("fp").distinct()
    nodes = components(close_pairs(classes, radius), "simhash")
    return classes.join(nodes, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the component) of every document row.

    Texts of equal fingerprints are one node, so copies never meet pair by pair. Repeated rows keep their number and share a component;
    a null doc_id is grouped like others but never names a component that has an id.
    """
    fps, _ = put(fingerprints(docs, shingle, seed), "fingerprints")
    named = _classes(fps, radius).join(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(smallest, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row of ``docs`` for each component, that of the smallest doc_id (null last), with its columns as they came.

    Empty and null texts share the fingerprint zero, so one of them stays. Of rows that repeat a number and a fingerprint one stays. An
    empty table gives an empty one.
    """
    own, number, keeper, keeper_fp = (free_name(docs, n) for n in ("_own_fp", "_own_number", "_keeper", "_keeper_fp"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{own}` long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1 << 22):
            data, offsets = text_bytes(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(simhash(data, offsets, shingle, seed).view(np.int64))], [*batch.schema.names, own])

    def named(doc_id: Column) -> Column:
        return F.coalesce(doc_id.cast("long").cast("string"), F.lit("none"))

    fps, _ = put(fingerprints(docs, shingle, seed), "fingerprints")
    # The smallest of each group of copies first, so that no group meets in one task.
    copies = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least"))
    ids = _classes(fps, radius).join(copies, "fp")
    first = ids.groupBy("root").agg(F.min(F.struct("least", "fp")).alias("first"))
    keepers = first.select(named(F.col("first.least.doc_id")).alias(keeper), F.col("first.fp").alias(keeper_fp))
    # Texts are dealt once, by fingerprint and number, which also serves to keep one of repeated rows.
    met = docs.mapInArrow(run, schema).withColumn(number, named(F.col("doc_id")))
    met = met.join(keepers, (F.col(own) == F.col(keeper_fp)) & (F.col(number) == F.col(keeper)))
    return met.dropDuplicates([own, number]).select(*[F.col(f"`{c}`") for c in docs.columns])
