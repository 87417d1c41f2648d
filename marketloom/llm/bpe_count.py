"""Token counts of a word-level BPE vocabulary by merging ragged arrays of symbols."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.textscan import small_batches

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
PIECE = 1 << 20
REMEMBERED = 1 << 19
#: Up to here (Latin, Greek, Cyrillic) letters and their cases are the same in all Unicode versions in use.
SETTLED = "\u052f"
NONE = np.int64(1) << 40


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where visible, else from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merger:
    """Symbols and merge ranks of a vocabulary file; counts the symbols that survive in many words at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        vocabulary, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocabulary[letters[b] + self.suffix] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(vocabulary[a] << 32) | vocabulary[b] for a, b in merges], np.int64)
        made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        # A pair listed twice keeps its later rank.
        rank = {int(k): i for i, k in enumerate(keys)}
        order = np.array(sorted(rank), np.int64)
        self.keys, self.ranks = order, np.array([rank[int(k)] for k in order], np.int64)
        self.made = made
        self.specials = [t["content"] for t in told["added_tokens"]]
        self.split_specials = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.pattern = regex.compile(told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.library = tokenizers.Tokenizer.from_file(path)
        self.letters = {c: b for b, c in letters.items()}
        self.known: dict[str, int] = {}

    def ranks_of(self, pairs: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.ranks[at], NONE)

    def survivors(self, words: list[str]) -> np.ndarray:
        """Symbols left of each (non-empty) word after all merges.

        All words lie behind each other in one array. In each round every word applies its own lowest rank, at all places of that rank
        from the left without overlap; words without a rank are done and leave the array.
        """
        parts = [w.encode() for w in words]
        size = np.array([len(p) for p in parts], np.int64)
        counts = size.copy()
        flat = np.frombuffer(b"".join(parts), np.uint8)
        symbol = self.inner[flat]
        ends = np.cumsum(size) - 1
        symbol[ends] = self.last[flat[ends]]
        row = np.repeat(np.arange(len(words)), size)
        while len(symbol) > 1:
            rank = np.full(len(symbol), NONE)
            rank[:-1] = self.ranks_of((symbol[:-1] << 32) | symbol[1:])
            rank[:-1][row[:-1] != row[1:]] = NONE
            firsts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            lowest = np.minimum.reduceat(rank, firsts)
            spans = np.diff(np.r_[firsts, len(row)])
            hit = (rank == np.repeat(lowest, spans)) & (rank < NONE)
            # In a run of adjoining hits (one symbol repeated) every second one is applied.
            place = np.flatnonzero(hit)
            if not len(place):
                break
            fresh = np.r_[True, np.diff(place) > 1]
            begin = np.maximum.accumulate(np.where(fresh, place, 0))
            place = place[(place - begin) % 2 == 0]
            symbol[place] = self.made[rank[place]]
            stay = np.ones(len(symbol), bool)
            stay[place + 1] = False
            counts -= np.bincount(row[place + 1], minlength=len(words))
            stay &= np.repeat(lowest < NONE, spans)
            symbol, row = symbol[stay], row[stay]
        return counts

    def normal(self, text: str) -> str:
        """Composed and lower-cased letter by letter; white space only separates, so it may stay."""
        if text.isascii():
            return text.lower()
        # Lower-casing a whole string treats a final sigma apart; letter by letter it does not.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text and how many special strings stand in it."""
        specials = 0
        runs = [text]
        if self.split_specials and "<|" in text:
            runs = self.split_specials.split(text)
            specials = len(runs) - 1
        out: list[str] = []
        for run in runs:
            if run.isascii() or max(run) <= SETTLED:
                out += self.pattern.findall(self.normal(run))
            else:
                # Young scripts: character classes as the library's own Unicode version has them.
                normal = self.library.normalizer.normalize_str(run)
                found = self.library.pre_tokenizer.pre_tokenize_str(normal)
                out += [bytes(map(self.letters.__getitem__, w)).decode() for w, _ in found]
        return out, specials

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        told = [self.pre_tokens(text) for text in texts]
        new = [w for w in {w for found, _ in told for w in found} if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list({w for found, _ in told for w in found})
        if new:
            self.known.update(zip(new, self.survivors(new).tolist()))
        known = self.known
        return [sum([known[w] for w in found]) + specials for found, specials in told]


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


_SPACE = regex.compile(r"\s")


def parts(text: str, size: int = PIECE) -> list[str]:
    """Pieces of a long text that end before white space; pre-tokens never hold white space, and composing never crosses it to the left."""
    out, lo = [], 0
    while len(text) - lo > size:
        border = _SPACE.search(text, lo + size)
        if border is None:
            break
        out.append(text[lo: border.start()])
        lo = border.start()
    out.append(text[lo:])
    return out


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row; null texts count as empty.

    Equal rows give equal rows. What a worker remembers of words is bounded by ``REMEMBERED``.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = merger(path)
        for batch in small_batches(batches, 1 << 21):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            cut = [parts(t) for t in texts]
            if max(map(len, cut)) == 1:
                n_tokens = tool.count(texts)
            else:
                n_tokens = [sum(tool.count([p])[0] for p in c) for c in cut]
            n_bytes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
                                              pa.array([n > limit for n in n_tokens], pa.bool_())],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
