"""Byte scanning, XXH64, token counts, byte BPE and license notices against plain versions."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import tokenizers
import xxhash

from marketloom.llm import bpe_codec, bpe_count, license_scan, textscan
from marketloom.llm.hashing import bit_counts, xxh64

LETTERS = "aAzZ éÉΣσςİß1²Ⅳ́e\t\n'’s't<|endoftext|>😀漢字か한ﬁ..!--​\x00"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_words_of_many_chunks(monkeypatch):
    sample = [*texts(200), None, "", "x" * 500, "one two " * 90]
    data, offsets = textscan.text_bytes(pa.array(sample))
    for inside, pattern in ((textscan.NOT_WHITE, r"[^\x20\x09-\x0D]+"), (textscan.WORD_LIKE, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        expected = [(i, w) for i, t in enumerate(sample) for w in re.findall(pattern, t or "")]
        for limit in (50, 1 << 20):
            monkeypatch.setattr(textscan.pieces, "__defaults__", (limit,))
            got = [(int(r), bytes(c.data[s:e]).decode()) for c in textscan.words(offsets, data, inside) for s, e, r in zip(c.start, c.end, c.row)]
            assert got == expected


def test_xxh64_and_bits():
    r = random.Random(3)
    data = np.frombuffer(r.randbytes(9000), np.uint8)
    start = np.array([r.randrange(6000) for _ in range(500)])
    end = start + np.array([r.choice([0, 1, 3, 4, 7, 8, 31, 32, 33, 64, 100, r.randrange(3000)]) for _ in range(500)])
    got = xxh64(data, start, end)
    assert [int(h) for h in got] == [xxhash.xxh64_intdigest(data[a:b].tobytes(), seed=42) for a, b in zip(start, end)]
    run = np.sort(np.array([r.choice([0, 2]) for _ in range(500)]))
    counts = bit_counts(got, run, 3)
    assert counts.tolist() == [[sum(int(h) >> k & 1 for h, i in zip(got, run) if i == row) for k in range(64)] for row in range(3)]


def test_token_counts_equal_the_library():
    path = public_tokenizers.path(bpe_count.VOCABULARY)
    sample = [*texts(3000), "<|endoftext|>a<|startoftext|>", "a" * 5000, "ab" * 400, "<|endoftext"]
    own = bpe_count.Merger(path)
    expected = [len(e.ids) for e in tokenizers.Tokenizer.from_file(path).encode_batch(sample, add_special_tokens=False)]
    assert own.count(sample) == expected


def test_parts_keep_counts():
    own = bpe_count.Merger(public_tokenizers.path(bpe_count.VOCABULARY))
    for text in ["the quick brown fox " * 20, "á b" * 30, "x" * 300]:
        assert sum(own.count(bpe_count.parts(text, 25))) == own.count([text])[0]


def test_token_count_rows(edges, nothing):
    rows = bpe_count.token_counts(edges).collect()
    assert len(rows) == edges.count() and bpe_count.token_counts(nothing).count() == 0
    of = {r.doc_id: r for r in rows}
    assert (of[1].n_tokens, of[2].n_tokens, of[3].n_tokens, of[4].n_tokens) == (0, 0, 0, 1)
    assert of[5].over_limit and not of[4].over_limit and of[7].n_bytes == len("Ünïcödé 漢字 😀 text".encode())


def test_byte_bpe_splits_safely_and_decodes():
    coder = bpe_codec.encoding(public_tokenizers.path(bpe_codec.RANKS), public_tokenizers.PATTERN)
    for text in texts(2000, 7):
        ids = [i for piece in bpe_codec.split_safely(text, 7) for i in coder.encode_ordinary(piece)]
        assert ids == coder.encode_ordinary(text) and bpe_codec.decode(coder, ids) == text.encode()


def test_byte_bpe_rows(edges, nothing):
    coder = bpe_codec.encoding(public_tokenizers.path(bpe_codec.RANKS), public_tokenizers.PATTERN)
    coded = bpe_codec.encode_texts(edges, round_trip="whole")
    rows = coded.collect()
    assert len(rows) == edges.count() and all(r.whole and r.score == "kept" for r in rows)
    assert all(list(r.token_ids) == coder.encode_ordinary(r.text or "") for r in rows)
    back = bpe_codec.decode_ids(coded).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    told = {r.doc_id: r for r in bpe_codec.document_tokens(edges).collect()}
    assert told[7].ids_sha256 == hashlib.sha256(" ".join(map(str, coder.encode_ordinary("Ünïcödé 漢字 😀 text"))).encode()).hexdigest()
    assert told[1].n_tokens == 0 and told[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe_codec.document_tokens(nothing).count() == 0


def plain_licenses(text, stride=32):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text or ""))
    places, base, notices = [], set(), {}
    for phrase, label in license_scan.PHRASES.items():
        spelled = phrase.split()
        found = [i for i in range(len(words)) if words[i: i + len(spelled)] == spelled]
        places += found
        base |= {label} if found else set()
    for lo in range(0, max(1, len(words)), stride):
        block = set(words[lo: lo + 2 * stride])
        for notice, label in license_scan.NOTICES.items():
            wanted = set(notice.split())
            share = len(wanted & block) / len(wanted)
            if share >= license_scan.CONTAINMENT - 1e-12:
                notices[label] = max(share, notices.get(label, 0))
    score = 1.0 if base else max(notices.values(), default=0.0)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(notices))), score)


def test_license_scan(documents, edges, nothing):
    r = random.Random(5)
    stock = " ".join([*license_scan.PHRASES, *license_scan.NOTICES]).split() + ["MIT", "License,", "cc-by", "filler", "thé"]
    rows = []
    for i in range(120):
        words = [r.choice(stock) for _ in range(r.randint(0, 150))]
        if i % 3:
            spelled = r.choice([*license_scan.PHRASES, *license_scan.NOTICES]).split()
            if i % 2:
                spelled[r.randrange(len(spelled))] = "other"
            at = r.randint(0, len(words))
            words[at:at] = spelled
        rows.append((i, r.choice([" ", "-", ". "]).join(words)))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    for docs in (documents(rows), edges):
        text = {r.doc_id: r.text for r in docs.collect()}
        for row in license_scan.scan(docs).collect():
            if row.doc_id != 10:
                assert tuple(row[n] for n in names) == plain_licenses(text[row.doc_id]), row
    assert license_scan.scan(nothing).count() == 0
