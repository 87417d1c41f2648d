"""Benchmark passages, hard negatives and vector codes against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import compare
from marketloom.llm import decontaminate, hard_negatives, queries, textscan, vector_codes

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id string, n_words string, row string"


def spelled(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(text, items, window=10):
    """(words, hit words, items with a window in the text)"""
    w, hit, found = spelled(text), set(), set()
    for item, told in items:
        own = spelled(told)
        k = min(window, len(own))
        wanted = {tuple(own[i: i + k]) for i in range(len(own) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i: i + k]) in wanted:
                hit |= set(range(i, i + k))
                found.add(item)
    return len(w), sorted(hit), sorted(i for i in found if i is not None)


def passages(seed=3):
    """Items with shared windows, short ones, one word, none; texts that hold whole items, parts of them and near misses."""
    r = random.Random(seed)
    some = lambda n: [r.choice(["the", "of", "and", "köln", "漢字", "a1", "x", "y", "zz"]) for _ in range(n)]
    items = [(i, " ".join(some(r.choice([11, 25, 40])))) for i in range(12)]
    items += [(50, "The, OF; and!"), (51, "unique"), (52, ""), (53, None), (54, items[0][1]), (55, items[0][1][:80]), (None, items[1][1]), (0, items[0][1]),
              (-7, " ".join(f"n{i}" for i in range(60))), (10, " ".join(some(9)))]
    rows = []
    for i in range(80):
        w = some(r.randint(0, 30))
        for _ in range(r.randint(0, 3)):
            own = spelled(r.choice(items)[1])
            a = r.randint(0, max(0, len(own) - 8))
            part = own[a: a + r.randint(5, 30)]
            if part and r.random() < 0.3:
                part[r.randrange(len(part))] = "other"
            w += [*(x.upper() if x.isascii() and r.random() < 0.2 else x for x in part), *some(r.randint(0, 3))]
        rows.append((i, r.choice([" ", ", ", "\n"]).join(w)))
    return items, rows


def test_texts_in_small_chunks(monkeypatch):
    items, rows = passages()
    own = decontaminate.Search(lanes=3)
    segments = []
    for item, text in items:
        w = [x.encode() for x in spelled(text)]
        if w:
            segments.append((item, min(10, len(w)), b" ".join(w)))
    strings = decontaminate.TestStrings(segments)
    texts = [t for _, t in rows] + [None, "", "long " * 500 + items[0][1]]
    for limit in (40, 200, 1 << 20):
        monkeypatch.setattr(textscan.pieces, "__defaults__", (limit,))
        n_words, found, spans = decontaminate._scan(pa.array(texts), strings, own)
        for text, n, ids, parts in zip(texts, n_words.tolist(), found.to_pylist(), spans.to_pylist()):
            hit = [i for s in parts for i in range(s["first"], s["last"] + 1)]
            assert (n, hit, ids) == plain_hits(text, items)
            assert all(b["first"] > a["last"] + 1 for a, b in zip(parts, parts[1:]))


def test_shifts_skip_most_positions():
    r = np.random.default_rng(1)
    strings = decontaminate.TestStrings([(1, 10, b" ".join(f"w{i}".encode() for i in range(200)))])
    table = strings.tables[0][0]
    hashes = r.integers(0, 1 << 63, 100_000).astype(np.uint64)
    seen = []
    table.blocks_at, plain = lambda h, e: (seen.append(len(e)), plain(h, e))[1], table.blocks_at
    begin, _ = table.candidates(hashes, np.zeros(len(hashes), int), 0, 64)
    assert not len(begin) and sum(seen) < len(hashes) / 8


@pytest.mark.parametrize("search", [decontaminate.Search(), decontaminate.Search(group_bytes=700, segment=7)])
def test_benchmark_passages(spark, documents, edges, nothing, search):
    items, rows = passages()
    bench = spark.createDataFrame([(*i, "kept", "kept", "kept") for i in items], ITEMS).repartition(3)
    docs = documents(rows + [(200, items[3][1]), (200, items[4][1]), (None, items[5][1]), (201, None)]).withColumns({c: F.lit("kept") for c in ("row", "items", "spans", "n_words", "item_id")})
    expected = sorted((str(d), *_digest(plain_hits(t, items))) for d, t in docs.select("doc_id", "text").collect())
    got = decontaminate.contamination(docs, bench, search)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((str(r.doc_id), *r[1:]) for r in got.collect()) == expected
    clean = decontaminate.without_benchmark(docs, bench, search)
    leaked = {d for d, *rest in expected if rest[-1] and d != "None"}
    assert clean.columns == docs.columns and {str(r.doc_id) for r in clean.collect()} == {str(r.doc_id) for r in docs.collect()} - leaked
    assert decontaminate.contamination(edges, bench, search).count() == edges.count() and decontaminate.contamination(nothing, bench, search).count() == 0
    assert all(r.n_hit == 0 and r.items_sha256 == hashlib.sha256(b"").hexdigest() for r in decontaminate.contamination(edges, bench.limit(0), search).collect())


def _digest(found):
    n, hit, ids = found
    return n, len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)


def vectors(n=700, d=12, seed=5, labels=4):
    """Clustered vectors with copies, ties, repeated ids and rows that take no part."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(labels, d))
    rows = [(i, [float(np.float32(x)) for x in (centres[i % labels] + r.normal(size=d)) / 4], i % labels) for i in range(n)]
    rows += [(n + i, rows[n // 7][1], i % 3) for i in range(30)]
    rows += [rows[0], rows[0], (200, rows[5][1], 1), (200, rows[6][1], 2)]
    rows += [(None, rows[1][1], 1), (900, None, 1), (1000, [0.0] * d, 0), (1100, [math.nan] * d, 1), (1200, [math.inf] * d, 1), (1300, rows[3][1], None), (1400, [None] * d, 1),
             (1500, rows[4][1][:5], 1), (1600, [], 2), (1700, [1e30] * d, 2)]
    return rows


@pytest.fixture(scope="session")
def embeddings(spark):
    def build(rows, parts=3):
        schema = "vec_id long, embedding array<double>, label int"
        return spark.createDataFrame(rows, schema).repartition(parts).withColumns({c: F.lit("kept") for c in ("key", "vector", "tops", "n", "part", "of", "score")})

    return build


def plain_negatives(rows, limit=1 << 20):
    seen = set()
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) or abs(x * 256) >= limit for x in v):
            continue
        seen.add((i, (y + 1) % 10 if i % 7 == 0 else y, tuple(math.floor(256 * x) for x in v)))
    out = []
    for a, y, q in sorted(seen):
        if a % 100:
            continue
        scores = sorted({(-sum(x * z for x, z in zip(q, v)), i, label == y) for i, label, v in seen if i != a})
        for s, p, _ in [x for x in scores if x[2]][:5]:
            fit = [(s2, i) for s2, i, same in scores if not same and 80 * -s <= 100 * -s2 <= 100 * -s][:5]
            out += [(a, p, k + 1, i, -s, -s2) for k, (s2, i) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("mining", [hard_negatives.Mining(), hard_negatives.Mining(slab=37, zone=10, block=2, step=3)])
def test_hard_negatives(embeddings, mining):
    rows = vectors()
    got = hard_negatives.hard_negatives(embeddings(rows), mining)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = plain_negatives(rows)
    assert len(expected) > 20 and sorted(map(tuple, got.collect())) == expected
    assert hard_negatives.hard_negatives(embeddings([]), mining).count() == 0


def test_candidates_leave_early():
    mining, r = hard_negatives.Mining(step=2), np.random.default_rng(2)
    columns = r.integers(-100, 100, (16, 3000))
    slab = hard_negatives.Slab(np.arange(3000), np.zeros(3000, int), columns, mining)
    q = np.r_[900, 400, r.integers(-9, 9, 14)]
    rows, scores = slab.scan(q, np.arange(3000), np.array([-(1 << 62)]), np.array([1 << 62]), 5)
    exact = q @ columns
    assert len(rows) < 50 and (exact[rows] == scores).all() and set(np.argsort(-exact)[:5]) <= set(rows)


def test_tree_finds_the_nearest_entry():
    r = np.random.default_rng(4)
    for entries in (r.integers(-50, 50, (256, 6)), r.integers(0, 2, (200, 5)), np.zeros((30, 3), int), r.integers(0, 9, (1, 4)), r.integers(0, 9, (5, 0))):
        x = np.concatenate([r.integers(-60, 60, (500, entries.shape[1])), entries])
        tree = vector_codes.Gnat(entries)
        entry, square = tree.nearest(x)
        apart = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (entry == apart.argmin(1)).all() and (square == apart.min(1)).all()
    clustered = np.repeat(r.integers(-9000, 9000, (16, 6)), 16, 0) + r.integers(-40, 40, (256, 6))
    tree = vector_codes.Gnat(clustered)
    tree.nearest(clustered + 3)
    assert tree.compared < 256 * 256 / 4


def plain_codes(rows, limit=1 << 24):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) and abs(x * 1024) < limit for x in r[1])]
    if not kept:
        return []
    length = max(len(r[1]) for r in kept)
    x = np.array([[math.floor(1024 * c) for c in r[1]] + [0] * (length - len(r[1])) for r in kept]).reshape(len(kept), length)
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:256]
    cuts = [length * k // 4 for k in range(5)]
    books, codes, error = [], [], 0
    for a, b in zip(cuts, cuts[1:]):
        part = x[:, a:b]
        book = part[order]
        for turn in range(5):
            apart = ((part[:, None] - book[None]) ** 2).sum(2)
            entry = apart.argmin(1)
            if turn < 4:
                book = np.array([part[entry == e].sum(0) // (entry == e).sum() if (entry == e).any() else book[e] for e in range(len(book))])
        books.append(book)
        codes.append(entry)
        error = error + apart.min(1)
    sha = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()
    of = {}
    for r, e in zip(kept, error):
        of[r[2]] = of.get(r[2], 0) + int(e)
    return sorted((str(r[0]), "".join(f"{c[k]:02x}" for c in codes), int(error[k]), of[r[2]], sha) for k, r in enumerate(kept))


@pytest.mark.parametrize("rows", [vectors(), vectors(60, 10), vectors(400, 3), [(1, None, 1)], [(i, [float(i % 3)] * 4, None) for i in range(40)]])
def test_vector_codes(embeddings, rows):
    got = vector_codes.compress(embeddings(rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((str(r.vec_id), *r[1:]) for r in got.collect()) == plain_codes(rows)


def test_vector_codes_of_nothing_and_many_labels(embeddings, monkeypatch):
    assert vector_codes.compress(embeddings([])).count() == 0
    monkeypatch.setattr(vector_codes, "HEAVY", 5)
    rows = [(i, [float(np.sin(i * k)) for k in range(8)], None if i % 3 == 0 else i) for i in range(120)]
    assert sorted((str(r.vec_id), *r[1:]) for r in vector_codes.compress(embeddings(rows)).collect()) == plain_codes(rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    problem, _, _, _ = compare.compare(spark, compare.connect(folder), folder, queries.QUERIES[name], queries.ORACLES[name])
    assert problem is None, problem
