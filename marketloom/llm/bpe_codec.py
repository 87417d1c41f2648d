"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.textscan import small_batches

RANKS = "byte_bpe_50k.tiktoken"
PIECE = 1 << 16
BATCH, ROWS = 1 << 21, 64
#: A space between two characters that are not white space always begins a match of the pattern.
_BORDER = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """Encoding of a rank file; read once per worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def split_safely(text: str, size: int = PIECE) -> list[str]:
    """Pieces of about ``size`` characters whose encodings joined are the encoding of the text.

    A text without a safe border stays longer, however long it is.
    """
    out, lo = [], 0
    while len(text) - lo > size:
        border = _BORDER.search(text, lo + size)
        if border is None:
            break
        out.append(text[lo: border.start()])
        lo = border.start()
    out.append(text[lo:])
    return out


def encode(coder: tiktoken.Encoding, text: str) -> list[int]:
    ids: list[int] = []
    for piece in split_safely(text):
        ids += coder.encode_ordinary(piece)
    return ids


def decode(coder: tiktoken.Encoding, ids: list[int]) -> bytes:
    """The bytes of the tokens; they need not be whole characters."""
    return coder.decode_bytes(ids)


def encode_texts(docs: DataFrame, column: str = "text", out: str = "token_ids", round_trip: str | None = None, path: str | None = None,
                 pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``docs`` with the token ids of every whole text as array<int>; null texts count as empty, other columns pass through.

    With ``round_trip``, a column of that name says whether the decoded ids are the bytes of the text again. Input columns of these names
    are replaced.
    """
    names = [(out, "array<int>", pa.list_(pa.int32())), *([(round_trip, "boolean", pa.bool_())] if round_trip else [])]

    def coded(coder, ids, text):
        row = (np.array(ids, np.int32),)
        return (*row, decode(coder, ids) == text.encode()) if round_trip else row

    return _mapped(docs.drop(*[n for n, _, _ in names]), column, names, path, pattern, coded)


def decode_ids(docs: DataFrame, column: str = "token_ids", out: str = "decoded", path: str | None = None,
               pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``docs`` with the decoded bytes of an array of ids as binary; a null array counts as empty. Unknown ids raise."""
    path = path or public_tokenizers.path(RANKS)
    kept = docs.drop(out)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + [f"`{out}` binary"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                values = pa.array([decode(coder, ids.as_py() or []) for ids in part.column(column)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, values], [*part.schema.names, out])

    return kept.mapInArrow(run, ", ".join(fields))


def token_digests(docs: DataFrame, column: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 of every whole text, ids never leaving the task."""

    def digest(coder, ids, text):
        told = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        return len(ids), told, hashlib.sha256(decode(coder, ids)).hexdigest()

    names = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return _mapped(docs.drop(*[n for n, _, _ in names]), column, names, path, pattern, digest)


def _mapped(docs: DataFrame, column: str, added, path: str | None, pattern: str, derive) -> DataFrame:
    path = path or public_tokenizers.path(RANKS)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{n}` {kind}" for n, kind, _ in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path, pattern)
        for batch in small_batches(batches, BATCH, column):
            rows = [derive(coder, encode(coder, text or ""), text or "") for text in batch.column(column).to_pylist()]
            values = [pa.array([r[i] for r in rows], kind) for i, (_, _, kind) in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *values], [*batch.schema.names, *[n for n, _, _ in added]])

    return docs.mapInArrow(run, ", ".join(fields))


def document_tokens(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_tokens, ids_sha256, decoded_sha256. Null and empty texts have no tokens."""
    return token_digests(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).select("doc_id", "text")).drop("text")
