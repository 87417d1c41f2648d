"""Removal of long byte strings that occur earlier in the corpus, by bucket-pointer refinement of suffix buckets.

Starts of strings are held in buckets that are refined until they tell 100-byte strings apart:

1. The initial bucket of a start is the q-gram at its anchor, a place that its string chooses by content, so equal strings share it. Starts
   with one anchor form a cell, and a cell is one row. A bucket of one member is settled: its strings occur once.
2. A bucket is refined by the identifier of all that the cell's strings cover, made of the identifiers at later offsets. Members of one
   refined bucket agree at all their starts, so all but the first repeat an earlier text.
3. Cells that are first in a refined bucket, while their q-gram bucket holds other refined buckets, are opened: each start goes into the
   bucket of its whole string, whose identifier again comes from the prefix sums that gave the shorter ones.

Identifiers are 64-bit; strings are taken as equal where the identifiers of gram and cover, or of the whole string, agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.scratch import drop, put
from marketloom.llm.textscan import Substrings, small_batches, text_bytes

LENGTH = 100
GRAM, SEED_GRAM = 56, 11
CHUNK = 1 << 20
BATCH = 1 << 23
NO_ID = -(1 << 63)
PLACE = 31
GROUPS, SALTS = 1 << 16, 64


def cells(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, seed_gram: int = SEED_GRAM) -> dict[str, np.ndarray]:
    """Cells of neighbouring starts of ``length``-byte strings that share an anchor: row, first and last start (in ``data``), the
    identifiers of the anchor's gram and of all bytes that the cell's strings cover.

    The anchor of a string is chosen by its bytes alone: from the place x of its smallest short gram, the anchor is x modulo
    (length - gram + 1) behind its start. Equal strings therefore have equal anchors at equal distances.
    """
    span = length - gram + 1
    sizes = np.diff(offsets)
    sub = Substrings(data)
    n = len(data) - length + 1
    if n <= 0:
        return {k: np.zeros(0, np.int64) for k in ("row", "first", "last")} | {k: np.zeros(0, np.uint64) for k in ("gram_id", "cover_id")}
    width = length - seed_gram + 1
    # Smallest of ``width`` short grams from each start on, leftmost first: minima over doubling windows.
    small = sub.all_of(seed_gram)
    low = (small & ~np.uint64(0xFFFFFFF)) | (np.arange(len(small), dtype=np.uint64) & np.uint64(0xFFFFFFF))
    reach = 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    low = np.minimum(low[:n], low[width - reach: width - reach + n])
    start = np.arange(n)
    at = start + ((low & np.uint64(0xFFFFFFF)).astype(np.int64) - (start & 0xFFFFFFF)) % span
    whole = np.zeros(n, bool)
    for row in np.flatnonzero(sizes >= length):
        whole[offsets[row]: offsets[row] + sizes[row] - length + 1] = True
    fresh = np.r_[True, at[1:] != at[:-1]] | np.r_[True, ~whole[:-1]]
    first = np.flatnonzero(fresh & whole)
    stop = np.flatnonzero(whole & np.r_[fresh[1:] | ~whole[1:], True])
    anchor = at[first]
    return {"row": np.searchsorted(offsets, first, "right") - 1, "first": first, "last": stop,
            "gram_id": sub.hash(anchor, anchor + gram), "cover_id": sub.hash(first, stop + length)}


def _chunks(data: np.ndarray, offsets: np.ndarray, length: int, limit: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, first row, bytes of that row before these): groups of whole texts, or overlapping pieces of one long text."""
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        if hi > lo:
            yield data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo], lo, 0
            lo = hi
            continue
        begin, size = int(offsets[lo]), int(offsets[lo + 1] - offsets[lo])
        for at in range(0, size - length + 1, limit):
            piece = data[begin + at: begin + min(size, at + limit + length - 1)]
            yield piece, np.array([0, len(piece)]), lo, at
        lo += 1


def _identity(docs: DataFrame) -> DataFrame:
    """doc, crc, text: rows that repeat both number and text are one document; a null number comes before all others."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .select("doc", F.crc32("text").alias("crc"), "text")


def _settle(keys: list[np.ndarray], doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which rows have an earlier row of the same keys among these."""
    order = np.lexsort((place, doc, *reversed(keys)))
    same = np.ones(len(order), bool)
    same[:1] = False
    for key in keys:
        k = key[order]
        same[1:] &= k[1:] == k[:-1]
    leader = np.maximum.accumulate(np.where(~same, np.arange(len(order)), 0))
    first = order[leader]
    out = np.zeros(len(order), bool)
    out[order] = same & ((doc[first] != doc[order]) | (place[first] != place[order]))
    return out


def _batch(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names)


CELL = "gram long, cover long, doc long, place long, size int, done boolean"


def bucket_cells(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Cells of all texts. ``done`` marks cells that repeat an earlier one of the same batch, so a cell that stands in very many texts goes
    on once for each batch only."""
    names = ["gram", "cover", "doc", "place", "size", "done"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, BATCH):
            data, offsets = text_bytes(batch.column("text"))
            docs, crc = batch.column("doc").to_numpy(), batch.column("crc").to_numpy()
            parts: list[list[np.ndarray]] = []
            for piece, own, row, before in _chunks(data, offsets, length):
                c = cells(piece, own, length)
                r = c["row"] + row
                parts.append([c["gram_id"], c["cover_id"], docs[r], (crc[r] << PLACE) | (c["first"] - own[c["row"]] + before),
                              (c["last"] - c["first"] + 1).astype(np.int32)])
            if parts:
                columns = [np.concatenate(x) for x in zip(*parts)]
                yield _batch(names, [*columns, _settle(columns[:2], columns[2], columns[3])])

    return texts.mapInArrow(run, CELL)


def open_cells(texts: DataFrame, unsettled: DataFrame, length: int = LENGTH) -> DataFrame:
    """(string, doc, place, done): every start of the given cells with the identifier of its whole string."""
    by_doc = unsettled.groupBy("doc", F.shiftright("place", PLACE).alias("crc")).agg(
        F.collect_set((F.col("place").bitwiseAND(F.lit((1 << PLACE) - 1)) * 1024 + F.col("size"))).alias("cells"))
    joined = texts.join(by_doc, ["doc", "crc"])
    names = ["string", "doc", "place", "done"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, BATCH):
            data, offsets = text_bytes(batch.column("text"))
            docs, crc = batch.column("doc").to_numpy(), batch.column("crc").to_numpy()
            lists = batch.column("cells")
            count = lists.value_lengths().to_numpy()
            packed = lists.flatten().to_numpy()
            at = np.repeat(offsets[:-1], count) + packed // 1024
            starts = np.repeat(at, packed % 1024) + _counting(packed % 1024)
            starts.sort()
            parts: list[list[np.ndarray]] = []
            for piece, own, row, before in _chunks(data, offsets, length):
                base = int(offsets[row]) + before
                # A piece of a long text owns the starts of its own limit only.
                a, b = np.searchsorted(starts, (base, base + (min(len(piece), CHUNK) if len(own) == 2 and before + len(piece) < offsets[row + 1] - offsets[row] else len(piece))))
                mine = starts[a:b]
                if not len(mine):
                    continue
                r = np.searchsorted(offsets, mine, "right") - 1
                parts.append([Substrings(piece).hash(mine - base, mine - base + length), docs[r], (crc[r] << PLACE) | (mine - offsets[r])])
            if parts:
                columns = [np.concatenate(x) for x in zip(*parts)]
                yield _batch(names, [*columns, _settle(columns[:1], columns[1], columns[2])])

    return joined.select("doc", "crc", "text", "cells").mapInArrow(run, "string long, doc long, place long, done boolean")


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. up to each size, behind each other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, place, size): runs of starts whose ``length``-byte string also starts earlier, by number of the document, then place."""
    spark = docs.sparkSession
    texts = _identity(docs)
    cut, cut_at = put(bucket_cells(texts, length), "suffix-cells")
    rows = cut.where("not done")
    group = F.pmod("gram", F.lit(GROUPS))
    # Buckets that hold far more cells than others are dealt to several tasks; their grams count as having several covers.
    counted = rows.groupBy(group.alias("g")).agg(F.count("*").alias("n"))
    level = counted.agg((F.sum("n") / GROUPS * 4 + 200).alias("level"))
    # At most a quarter of GROUPS rows exceed four times the mean, so the broadcast is bounded.
    heavy = counted.join(F.broadcast(level)).where("n > level").select("g", F.lit(True).alias("heavy"))
    rows = rows.withColumn("g", group).join(F.broadcast(heavy), "g", "left").withColumn(
        "salt", F.when(F.col("heavy"), F.pmod("cover", F.lit(SALTS))).otherwise(F.lit(0)))
    bucket = Window.partitionBy("gram", "salt")
    place = bucket.orderBy("cover", "doc", "place")
    fresh = F.coalesce(F.lag("cover").over(place) != F.col("cover"), F.lit(True))
    told = rows.withColumn("fresh", fresh).withColumn("several", F.col("heavy").isNotNull() | (F.min("cover").over(bucket) != F.max("cover").over(bucket)))
    # Rows of one document that are equal in all (repeated rows) stand for one cell: they repeat nothing.
    before = F.lag(F.struct("cover", "doc", "place")).over(place)
    told = told.withColumn("twin", F.coalesce(before == F.struct("cover", "doc", "place"), F.lit(False)))
    judged = told.select("doc", "place", "size", (~F.col("fresh") & ~F.col("twin")).alias("done"), "several").where("done or several")
    judged, judged_at = put(judged, "suffix-judged")
    early = cut.where("done").select("doc", "place", "size")
    opened, opened_at = put(open_cells(texts, judged.where("not done"), length), "suffix-starts")
    order = Window.partitionBy("string").orderBy("doc", "place")
    late = opened.where("not done").withColumn("rank", F.rank().over(order)).where("rank > 1")
    found = early.unionByName(judged.where("done").select("doc", "place", "size"))
    single = opened.where("done").select("doc", "place").unionByName(late.select("doc", "place"))
    out, _ = put(found.unionByName(single.withColumn("size", F.lit(1))), "suffix-repeated")
    drop(spark, cut_at, judged_at, opened_at)
    return out


def _spans(packed: np.ndarray, size: int, length: int) -> np.ndarray:
    """Maximal removed byte ranges from runs of starts (start * 2048 + run)."""
    if not len(packed):
        return np.zeros((0, 2), np.int64)
    lo = packed // 2048
    hi = np.minimum(lo + packed % 2048 + length - 1, size)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    cut = np.r_[True, lo[1:] > hi[:-1]]
    return np.stack([lo[cut], hi[np.r_[np.flatnonzero(cut)[1:] - 1, len(hi) - 1]]], axis=1)


def _with_runs(docs: DataFrame, length: int) -> DataFrame:
    runs = repeated(docs, length).groupBy("doc", F.shiftright("place", PLACE).alias("crc")).agg(
        F.collect_set(F.col("place").bitwiseAND(F.lit((1 << PLACE) - 1)) * 2048 + F.col("size")).alias("runs"))
    return _identity(docs).join(runs, ["doc", "crc"], "left")


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, ``with_text``, kept (the remaining bytes, as binary) of every row of ``docs``.

    A byte goes if a ``length``-byte string that covers it also starts earlier: in a document of smaller number (of equal numbers the one of
    smaller checksum), or earlier in the same one, overlaps included. Null texts count as empty; texts shorter than ``length`` stay whole; rows
    that repeat number and text are one document and get equal results.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, BATCH):
            data, offsets = text_bytes(batch.column("text"))
            lists = batch.column("runs").to_pylist() if batch.column("runs").null_count == batch.num_rows else batch.column("runs")
            sizes = np.diff(offsets)
            removed, spans, digests, kept = [], [], [], []
            for i in range(batch.num_rows):
                own = lists[i]
                values = own.values.to_numpy() if own is not None and hasattr(own, "values") and own.is_valid else np.zeros(0, np.int64)
                gone = _spans(values, int(sizes[i]), length)
                text = data[offsets[i]: offsets[i + 1]]
                edges = np.r_[0, gone.ravel(), len(text)].reshape(-1, 2)
                rest = b"".join(text[a:b].tobytes() for a, b in edges)
                removed.append(len(text) - len(rest))
                spans.append(len(gone))
                digests.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    kept.append(rest)
            ids = batch.column("doc").to_numpy()
            columns = [pa.array(ids, mask=ids == NO_ID), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()),
                       *([pa.array(kept, pa.binary())] if with_text else [])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns)])

    told = _with_runs(docs, length).select("doc", "text", "runs")
    return told.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
