"""License notices in texts by an exact set-similarity join of text blocks with templates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.textscan import FOLD, WORD_LIKE, Substrings, small_batches, text_bytes, words

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices as they are usually worded, and their labels; a block that holds ``CONTAINMENT`` of the words of one is marked.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-notice",
    "released under the mit license": "mit-notice",
    "licensed under the apache license version 2 0": "apache-notice",
    "you may not use this file except in compliance with the license": "apache-notice",
    "licensed under the gnu general public license version 3": "gpl-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-notice",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-notice",
    "this work is licensed under a creative commons attribution license": "cc-notice",
    "licensed under cc by nc 4 0": "cc-notice",
    "this source code form is subject to the terms of the mozilla public license": "mpl-notice",
}
CONTAINMENT = 0.8
STRIDE = 32


@dataclass(frozen=True)
class Template:
    """A phrase (all its words, in order and adjoining) or a notice (a share of its words in any order within a block)."""

    words: tuple[str, ...]
    label: str
    phrase: bool
    share: float


def templates(phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, containment: float = CONTAINMENT) -> list[Template]:
    return [*(Template(tuple(t.split()), label, True, 1.0) for t, label in phrases.items()),
            *(Template(tuple(t.split()), label, False, containment) for t, label in notices.items())]


class Index:
    """Templates as sets of token ranks, rarest token first, with an inverted list over their prefixes.

    Tokens of no template never add to an overlap, so blocks are compared by their template tokens alone. A template of n tokens that
    must share a = ceil(share * n) of them shares one of its first n - a + 1 tokens with every block it matches.
    """

    def __init__(self, wanted: list[Template], counts: dict[str, int]):
        vocabulary = sorted({w for t in wanted for w in t.words}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.text = [w.encode() for w in vocabulary]
        hashes = word_hashes(vocabulary)
        order = np.argsort(hashes)
        self.hashes, self.ranks = hashes[order], order
        self.near = np.zeros(1 << 16, bool)
        self.near[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.sets = [sorted({self.rank[w] for w in t.words}) for t in wanted]
        self.need = [max(1, math.ceil(t.share * len(s) - 1e-9)) for t, s in zip(wanted, self.sets)]
        self.templates = wanted
        self.lists: dict[int, list[tuple[int, int]]] = {}
        for number, (tokens, need) in enumerate(zip(self.sets, self.need)):
            for place, token in enumerate(tokens[: len(tokens) - need + 1]):
                self.lists.setdefault(token, []).append((number, place))
        self.prefix = np.zeros(len(vocabulary), bool)
        self.prefix[list(self.lists)] = True

    def matches(self, block: list[int]) -> list[tuple[int, float]]:
        """(template, containment) for every template that a block, given as ascending ranks, contains up to its share."""
        tried, out = set(), []
        for j, token in enumerate(block):
            for number, i in self.lists.get(token, ()):
                if number in tried:
                    continue
                tried.add(number)
                tokens, need = self.sets[number], self.need[number]
                # At the first shared token nothing before it is shared, so this bounds the overlap.
                if len(block) < need or 1 + min(len(tokens) - 1 - i, len(block) - 1 - j) < need:
                    continue
                overlap = len(set(tokens).intersection(block))
                if overlap >= need:
                    out.append((number, overlap / len(tokens)))
        return out

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of template tokens among word hashes, and their ranks."""
        place = np.flatnonzero(self.near[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[place]), len(self.hashes) - 1)
        same = self.hashes[at] == hashes[place]
        return place[same], self.ranks[at[same]]


def word_hashes(texts: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    return Substrings(data).hash(np.r_[0, ends[:-1]], ends)


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(batch.column("text"))
    found = [(c.hashes(), c.row) for c in words(offsets, data, WORD_LIKE, FOLD)]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([h for h, _ in found]), np.concatenate([r for _, r in found])


def token_counts(docs: DataFrame, wanted: list[Template]) -> dict[str, int]:
    """How often each template token stands in all texts; only these counts come to the driver."""
    index = Index(wanted, {})
    names = [t.decode() for t in index.text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), np.int64)
        for batch in small_batches(batches, 1 << 22):
            total += np.bincount(index.hits(_words(batch)[0])[1], minlength=len(names))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names))), pa.array(total)], ["token", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {names[r["token"]]: r["n"] for r in rows.collect()}


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, containment: float = CONTAINMENT,
         stride: int = STRIDE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and places (array of word starts of the phrases).

    Blocks are ``2 * stride`` words long and begin every ``stride`` words, so what spans at most ``stride + 1`` words lies within one.
    Blocks and templates meet over template prefixes in order of global rarity, pass a length and a positional filter, and are verified;
    in matching blocks phrases are then located word by word. The score is 1 with a phrase, else the largest containment of a notice that
    matched, else 0. Null texts count as empty; such rows and empty ones have no words, null starts, empty labels and score 0.
    """
    wanted = templates(phrases, notices, containment)
    if max(len(t.words) for t in wanted) > stride + 1:
        raise ValueError("a template is longer than the blocks overlap")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = Index(wanted, token_counts(narrow, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1 << 22):
            hashes, row = _words(batch)
            n_words = np.bincount(row, minlength=batch.num_rows)
            found = _scan_batch(index, hashes, n_words, stride)
            told = [found.get(i, _NOTHING) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array([len(p) for p, _, _ in told], pa.int64()),
                 pa.array([min(p, default=None) for p, _, _ in told], pa.int64()), pa.array([max(p, default=None) for p, _, _ in told], pa.int64()),
                 pa.array([",".join(sorted(b)) for _, b, _ in told]), pa.array([",".join(sorted({*b, *m})) for _, b, m in told]),
                 pa.array([1.0 if b else max(m.values(), default=0.0) for _, b, m in told], pa.float64()),
                 pa.array([sorted(p) for p, _, _ in told], pa.list_(pa.int64()))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"])

    return narrow.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
                                  "score double, places array<long>")


_NOTHING: tuple[list[int], set[str], dict[str, float]] = ([], set(), {})


def _scan_batch(index: Index, hashes: np.ndarray, n_words: np.ndarray, stride: int) -> dict[int, tuple[list[int], set[str], dict[str, float]]]:
    """For each text with a match: starts of phrases, labels of phrases, and labels of notices with their containment."""
    first = np.cumsum(n_words) - n_words
    place, rank = index.hits(hashes)
    likely = place[index.prefix[rank]]
    row = np.searchsorted(first, likely, "right") - 1
    block = (likely - first[row]) // stride
    pairs = np.concatenate([np.stack([row, block], 1), np.stack([row, block - 1], 1)])
    out: dict[int, tuple[list[int], set[str], dict[str, float]]] = {}
    for r, k in np.unique(pairs[pairs[:, 1] >= 0], axis=0).tolist() if len(pairs) else []:
        lo = int(first[r]) + k * stride
        hi = min(lo + 2 * stride, int(first[r] + n_words[r]))
        a, b = np.searchsorted(place, (lo, hi))
        for number, share in index.matches(np.unique(rank[a:b]).tolist()):
            template = index.templates[number]
            if not template.phrase:
                notes = out.setdefault(r, ([], set(), {}))[2]
                notes[template.label] = max(share, notes.get(template.label, 0.0))
                continue
            spelled = [index.rank[w] for w in template.words]
            # A phrase belongs to the block in whose first half it begins.
            for i in range(a, b):
                if place[i] - lo < stride and i + len(spelled) <= len(place) and place[i] + len(spelled) <= first[r] + n_words[r] \
                        and place[i + len(spelled) - 1] - place[i] == len(spelled) - 1 and rank[i: i + len(spelled)].tolist() == spelled:
                    starts, labels, _ = out.setdefault(r, ([], set(), {}))
                    starts.append(int(place[i] - first[r]))
                    labels.add(template.label)
    return out
