"""Benchmark passages in documents, by Wu-Manber search over words for many test strings at once.

The symbols are words and the blocks are two words. A shift table tells for the block in front of each position how far the next possible
end of a test string lies; where it tells 0, the buckets of that block as a suffix, and of the first block as a prefix, select test strings,
and their bytes are compared with the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.scratch import put
from marketloom.llm.textscan import FOLD, WORD_LIKE, Substrings, mix, small_batches, text_bytes, words


@dataclass(frozen=True)
class Search:
    """``window`` consecutive words of an item are a test string. Items are searched in groups of about ``group_bytes`` bytes of words, each
    of which is sent to the executors; a larger benchmark takes several passes. An item is cut every ``segment`` windows."""

    window: int = 10
    group_bytes: int = 8 << 20
    segment: int = 4096
    lanes: int = 4096


class ShiftTable:
    """Test strings of one number of words: shifts by block, and buckets by suffix and prefix block."""

    def __init__(self, hashes: np.ndarray):
        """``hashes``: a row of word hashes for each test string."""
        n, self.size = hashes.shape
        self.block = min(2, self.size)
        blocks = np.stack([self.blocks_at(hashes.ravel(), np.arange(n) * self.size + j) for j in range(self.block - 1, self.size)], 1)
        bits = max(12, int(blocks.size * 16).bit_length())
        self.mask = np.uint64((1 << min(bits, 26)) - 1)
        self.shift = np.full(int(self.mask) + 1, self.size - self.block + 1, np.uint16)
        for j in range(blocks.shape[1]):
            # A block that ends j blocks after the first one lies this far before the end of its string.
            np.minimum.at(self.shift, (blocks[:, j] & self.mask).astype(np.int64), np.uint16(blocks.shape[1] - 1 - j))
        keys = self.bucket(blocks[:, -1], blocks[:, 0])
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def blocks_at(self, hashes: np.ndarray, end: np.ndarray) -> np.ndarray:
        last = hashes[end]
        return last if self.block == 1 else mix(hashes[end - 1] * np.uint64(0x9E3779B97F4A7C15) + last)

    @staticmethod
    def bucket(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        return mix(suffix + (prefix << np.uint64(1)) + (prefix >> np.uint64(63)))

    def candidates(self, hashes: np.ndarray, row: np.ndarray, fresh: int, lanes: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, test string) where a string may stand; only strings that end at word ``fresh`` or later.

        The text is cut into lanes that are searched at once, each jumping ahead by its own shifts.
        """
        lo, hi = max(fresh, self.size - 1), len(hashes)
        if lo >= hi:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        stride = max(64, -(-(hi - lo) // lanes))
        at = np.arange(lo, hi, stride)
        stop = np.minimum(at + stride, hi)
        ends = []
        while len(at):
            step = self.shift[(self.blocks_at(hashes, at) & self.mask).astype(np.int64)]
            ends.append(at[step == 0])
            at = at + np.maximum(step, 1)
            stay = at < stop
            at, stop = at[stay], stop[stay]
        end = np.concatenate(ends)
        begin = end - self.size + 1
        inside = row[begin] == row[end]
        end, begin = end[inside], begin[inside]
        keys = self.bucket(self.blocks_at(hashes, end), self.blocks_at(hashes, begin + self.block - 1))
        left, right = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        count = right - left
        which = np.repeat(left, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(begin, count), self.order[which]


def same_ranges(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether ``a[a_start:][:length]`` equals ``b[b_start:][:length]``, for each of the (positive) lengths."""
    if not len(length):
        return np.zeros(0, bool)
    first = np.cumsum(length) - length
    inner = np.arange(int(length.sum())) - np.repeat(first, length)
    differs = a[np.repeat(a_start, length) + inner] != b[np.repeat(b_start, length) + inner]
    return np.add.reduceat(differs, first, dtype=np.int64) == 0


class TestStrings:
    """The distinct windows of a group of items, and the items of each."""

    __test__ = False

    def __init__(self, segments: list[tuple[int | None, int, bytes]]):
        """``segments``: item, words a window, and words joined by one space."""
        known: dict[bytes, int] = {}
        self.items = sorted({item for item, _, _ in segments if item is not None})
        number = {item: i for i, item in enumerate(self.items)}
        found: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for item, size, text in segments:
            ids = np.array([known.setdefault(w, len(known)) for w in text.split(b" ")], np.int64)
            windows = np.lib.stride_tricks.sliding_window_view(ids, size)
            found.setdefault(size, []).append(windows)
            owners.setdefault(size, []).append(np.full(len(windows), number.get(item, -1)))
        vocabulary = list(known)
        self.bytes = np.frombuffer(b"".join(vocabulary), np.uint8)
        self.length = np.array([len(w) for w in vocabulary], np.int64)
        self.start = np.cumsum(self.length) - self.length
        hashes = Substrings(self.bytes).hash(self.start, self.start + self.length)
        self.tables: list[tuple[ShiftTable, np.ndarray, np.ndarray, np.ndarray]] = []
        for size, parts in found.items():
            spelled, which = np.unique(np.concatenate(parts), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.concatenate(owners[size])], 1), axis=0)
            pairs = pairs[pairs[:, 1] >= 0]
            bounds = np.searchsorted(pairs[:, 0], np.arange(len(spelled) + 1))
            self.tables.append((ShiftTable(hashes[spelled]), spelled, bounds, pairs[:, 1]))

    def occurrences(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, fresh: int, lanes: int):
        """(first words, words a string, rows of items, items) of every occurrence that ends at word ``fresh`` or later, table by table."""
        if not len(start):
            return
        hashes = Substrings(data).hash(start, end)
        for table, spelled, bounds, owner in self.tables:
            begin, string = table.candidates(hashes, row, fresh, lanes)
            for j in range(table.size):
                word = spelled[string, j]
                same = end[begin + j] - start[begin + j] == self.length[word]
                begin, string, word = begin[same], string[same], word[same]
                same = same_ranges(data, start[begin + j], self.bytes, self.start[word], self.length[word])
                begin, string = begin[same], string[same]
            if len(begin):
                # Items once for each text and string.
                pairs = np.unique(np.stack([row[begin], string], 1), axis=0)
                count = bounds[pairs[:, 1] + 1] - bounds[pairs[:, 1]]
                which = np.repeat(bounds[pairs[:, 1]], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                yield begin, table.size, np.repeat(pairs[:, 0], count), owner[which]


def _segments(items: DataFrame, search: Search) -> DataFrame:
    """(item, size, words) of all windows of the items: ``words`` joined by one space, ``size`` of which are a test string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1 << 22):
            data, offsets = text_bytes(batch.column("text"))
            item, size, cut = [], [], []
            of: dict[int, list[bytes]] = {}
            for c in words(offsets, data, WORD_LIKE, FOLD):
                raw = c.data.tobytes()
                for r, s, e in zip(c.row.tolist(), c.start.tolist(), c.end.tolist()):
                    of.setdefault(r, []).append(raw[s:e])
            names = batch.column("item").to_pylist()
            for r, spelled in of.items():
                k = min(search.window, len(spelled))
                for lo in range(0, len(spelled) - k + 1, search.segment):
                    item.append(names[r])
                    size.append(k)
                    cut.append(b" ".join(spelled[lo: lo + search.segment + k - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(size, pa.int32()), pa.array(cut, pa.binary())], ["item", "size", "words"])

    narrow = items.select(F.col("item_id").cast("long").alias("item"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "item long, size int, words binary").distinct()


_FOUND = "row long, doc_id long, n_words long, items array<long>, spans array<struct<first:long,last:long>>"


def _search(rows: DataFrame, group: list[tuple[int | None, int, bytes]], search: Search) -> DataFrame:
    """Items and hit word spans of every row (row, doc_id, text) for one group of segments."""
    sent = rows.sparkSession.sparkContext.broadcast(TestStrings(group)) if group else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1 << 22):
            n_words, items, spans = _scan(batch.column("text"), sent.value if sent else None, search)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(n_words, pa.int64()), items, spans],
                                             ["row", "doc_id", "n_words", "items", "spans"])

    return rows.mapInArrow(run, _FOUND)


def _lists(row: np.ndarray, rows: int) -> pa.Array:
    return pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32())


def _scan(column: pa.Array, strings: TestStrings | None, search: Search) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Words, items and hit spans of each text. The last words of a chunk stay for the next one, so no window is lost between chunks."""
    data, offsets = text_bytes(column)
    rows = len(column)
    n_words = np.zeros(rows, np.int64)
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    owned = [np.zeros((0, 2), np.int64)]
    kept = search.window - 1
    tail = np.zeros(0, np.uint8)
    t_start = t_end = t_row = t_place = np.zeros(0, np.int64)
    t_hit = np.zeros(0, bool)
    for c in words(offsets, data, WORD_LIKE, FOLD):
        firsts = np.searchsorted(c.row, c.row)
        place = n_words[c.row] + np.arange(len(c.row)) - firsts
        n_words += np.bincount(c.row, minlength=rows)
        if strings is None:
            continue
        fresh, shift = len(t_row), len(tail)
        part = np.concatenate([tail, c.data])
        start, end = np.concatenate([t_start, c.start + shift]), np.concatenate([t_end, c.end + shift])
        row, place = np.concatenate([t_row, c.row]), np.concatenate([t_place, place])
        marks = np.zeros(len(row) + 1, np.int64)
        for begin, size, of, item in strings.occurrences(part, start, end, row, fresh, search.lanes):
            np.add.at(marks, begin, 1)
            np.add.at(marks, begin + size, -1)
            owned.append(np.unique(np.stack([of, np.asarray(strings.items, np.int64)[item]], 1), axis=0))
        hit = np.cumsum(marks[:-1]) > 0
        hit[:fresh] |= t_hit
        done = max(0, len(row) - kept)
        at = np.flatnonzero(hit[:done])
        hits.append((row[at], place[at]))
        t_row, t_place, t_hit = row[done:], place[done:], hit[done:]
        low = int(start[done]) if len(t_row) else len(part)
        tail, t_start, t_end = part[low:].copy(), start[done:] - low, end[done:] - low
    hits.append((t_row[t_hit], t_place[t_hit]))
    row, place = np.concatenate([r for r, _ in hits]), np.concatenate([p for _, p in hits])
    fresh = np.r_[True, (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)][: len(row)]
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:], len(row)][: len(first)] - 1
    spans = pa.ListArray.from_arrays(_lists(row[first], rows), pa.StructArray.from_arrays([pa.array(place[first]), pa.array(place[last])], ["first", "last"]))
    pairs = np.unique(np.concatenate(owned), axis=0)
    return n_words, pa.ListArray.from_arrays(_lists(pairs[:, 0], rows), pa.array(pairs[:, 1], pa.int64())), spans


def find_benchmark(docs: DataFrame, benchmark: DataFrame, search: Search = Search()) -> DataFrame:
    """doc_id, n_words, items (ids of the items with occurring windows, ascending) and spans (first and last hit word, from 0) of every row.

    Words are runs of ASCII letters, ASCII digits and all characters beyond ASCII, with A-Z lower-cased. An item of fewer words than a
    window is one test string; one without words is none. Null texts have no words. Repeated documents are rows of their own, repeated items
    count once, and an item without a number marks words without being listed. Rows are never gathered unless the benchmark
    needs several passes; then their numbers and findings are, without their texts.
    """
    spark = docs.sparkSession
    cut, _ = put(_segments(benchmark, search), "test-strings")
    total = cut.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    groups = -(-total // search.group_bytes)
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if groups <= 1:
        return _search(narrow, [tuple(r) for r in cut.collect()], search).drop("row")
    rows, _ = put(narrow, "numbered-texts")
    base, found = _search(rows, [], search).select("row", "doc_id", "n_words"), []
    for k in range(groups):
        group = cut.where(F.pmod(F.xxhash64("item", "words"), F.lit(groups)) == k).collect()
        told, _ = put(_search(rows, [tuple(r) for r in group], search).where("size(spans) > 0").select("row", "items", "spans"), "found-strings")
        found.append(told)
    merged = spark.createDataFrame([], found[0].schema)
    for told in found:
        merged = merged.unionByName(told)
    merged = merged.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
                                       _joined(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"))
    none = base.join(merged, "row", "left").drop("row")
    return none.withColumns({c: F.coalesce(F.col(c), F.array().cast(none.schema[c].dataType)) for c in ("items", "spans")})


def _joined(spans: Column) -> Column:
    """Overlapping and adjoining spans (sorted by their first word) as one."""
    kind = "array<struct<first:bigint,last:bigint>>"

    def add(done: Column, s: Column) -> Column:
        end = F.try_element_at(done, F.lit(-1))
        grown = F.struct(end["first"].alias("first"), F.greatest(end["last"], s["last"]).alias("last"))
        apart = (F.size(done) == 0) | (s["first"] > end["last"] + 1)
        return F.when(apart, F.concat(done, F.array(s))).otherwise(F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown)))

    return F.aggregate(spans, F.array().cast(kind), add)


def contamination(docs: DataFrame, benchmark: DataFrame, search: Search = Search()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row; see ``find_benchmark``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return find_benchmark(docs, benchmark, search).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, search: Search = Search()) -> DataFrame:
    """The documents without any hit word, with all their columns; rows without a number stay, and one row of a number decides for all."""
    leaked = find_benchmark(docs, benchmark, search).where("size(spans) > 0 and doc_id is not null").select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(leaked, docs["doc_id"].cast("long") == leaked["_leaked"], "left_anti")


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
t AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM
        (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
o AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM
        (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM t) WHERE len(w) >= k)),
m AS MATERIALIZED (SELECT doc_id, item_id, o.k, i FROM o JOIN t ON o.k = t.k AND o.s = t.s),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
