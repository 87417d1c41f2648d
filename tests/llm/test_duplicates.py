"""Near-duplicates, repeated lines, repeated byte strings, fingerprints and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from marketloom.llm import cap_dedup, components, fingerprints, line_dedup, simhash_dedup, suffix_dedup


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    r = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 100) for i in range(1, 30)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(30)] + [(7, 7), (500, 500)]
    nodes = {n for p in pairs for n in p}
    got = {x.node: x.component for x in components.components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
    assert got == groups(pairs, nodes)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", fold(text or ""))
    shingles = [" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash_components(documents, edges, nothing):
    r = random.Random(8)
    base = [[f"w{r.randrange(300)}" for _ in range(r.randint(1, 120))] for _ in range(25)]
    rows = []
    for i in range(150):
        words = list(r.choice(base))
        if i % 3 == 0:
            words[r.randrange(len(words))] = "Other"
        rows.append((i * 7, "  ".join(words)))
    for docs in (documents(rows), edges):
        data = [(x.doc_id, plain_simhash(x.text)) for x in docs.collect()]
        fps = {f for _, f in data}
        root = groups([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3], fps)
        first = {}
        for i, f in data:
            first[root[f]] = min((x for x in (first.get(root[f]), i) if x is not None), default=None)
        got = sorted(((x.doc_id, x.fingerprint, x.component_id) for x in simhash_dedup.near_duplicates(docs).collect()), key=str)
        assert got == sorted(((i, f"{f:016x}", first[root[f]]) for i, f in data), key=str)
        kept = simhash_dedup.keep_one(docs)
        assert kept.columns == docs.columns
        assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == sorted(v for v in first.values() if v is not None)
    assert simhash_dedup.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_close_pairs_of_both_indexes(spark, radius):
    r = random.Random(radius)
    fps = set()
    for _ in range(12):
        base = r.getrandbits(64)
        for _ in range(12):
            fps.add(base ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    expected = sorted((min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[i + 1:] if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= radius)
    assert sorted(tuple(x) for x in simhash_dedup.close_pairs(table, radius).collect()) == expected
    assert sorted(tuple(x) for x in fingerprints.near_pairs(table, radius, radius + 2).collect()) == expected


def test_fingerprints(documents, edges, nothing):
    rows = [(3, "alpha beta gamma delta " * 5), (1, "alpha beta gamma delta " * 5), (9, "éa" * 7), (4, ""), (6, None), (12, "one")]
    docs = documents(rows)
    got = {x.doc_id: x for x in fingerprints.fingerprint_documents(docs).collect()}
    ordered = sorted(rows)
    for i, (number, text) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row = got[number]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        same = 64 - (int(row.fingerprint, 16) ^ int(row.edited_fingerprint, 16)).bit_count()
        assert row.near_edited == same / 64
        following = int(got[ordered[(i + 1) % len(ordered)][0]].fingerprint, 16)
        assert row.near_next == 1 - (int(row.fingerprint, 16) ^ following).bit_count() / 64
        others = [int(got[n].fingerprint, 16) for n, _ in rows if n != number]
        assert row.near_docs == sum((int(row.fingerprint, 16) ^ o).bit_count() <= 3 for o in others)
    assert got[3].fingerprint == got[1].fingerprint and got[4].fingerprint == "0" * 16
    assert fingerprints.fingerprint_documents(edges).count() == edges.count()
    assert fingerprints.fingerprint_documents(nothing).count() == 0


def plain_lines(rows):
    seen, out = [], []
    for number, text in rows:
        kept, lines = [], (text or "").split("\n")
        for line in lines:
            words = frozenset(fold(w) for w in re.findall(r"[^\x20\x09-\x0D]+", line))
            if words and any(5 * len(words & s) >= 4 * len(words | s) for s in seen):
                seen.append(words)
                continue
            if words:
                seen.append(words)
            kept.append(line)
        out.append((number, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("full", [1, 2048])
def test_line_dedup(documents, monkeypatch, full):
    monkeypatch.setattr(line_dedup, "FULL", full)
    monkeypatch.setattr(line_dedup, "KEEP", min(full, 4))
    monkeypatch.setattr(line_dedup, "STEP", 50)
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["the", "of"] * 5
    base = [[r.choice(words) for _ in range(r.randint(3, 25))] for _ in range(10)]
    rows = []
    for i in range(110):
        lines = []
        for _ in range(r.randint(0, 6)):
            line = list(r.choice(base)) if r.random() < 0.7 else [r.choice(words) for _ in range(r.randint(0, 6))]
            for _ in range(r.randint(0, 3) if line else 0):
                line[r.randrange(len(line))] = r.choice(words)
            lines.append(r.choice([" ", "  ", "\t"]).join(line))
        rows.append((i * 2, "\n".join(lines) if i % 17 else None))
    assert sorted(tuple(x) for x in line_dedup.line_report(documents(rows)).collect()) == plain_lines(rows)


def test_line_dedup_edges(edges, nothing):
    out = line_dedup.strip_lines(edges)
    assert out.columns == [*edges.columns, "_lines", "_removed"] and out.count() == edges.count()
    text = {x.doc_id: x for x in out.collect()}
    assert text[9].text == "" and text[9].n_chars == 0 and text[3].text == " \t\n " and text[1].text == "" and text[9].score == "kept"
    assert [x.text for x in out.where("doc_id = 6").collect()] == ["same row twice, same row twice"] * 2
    assert line_dedup.line_report(nothing).count() == 0


def test_tokens_are_sorted_by_one_number(monkeypatch):
    """line and token are one key, also where different tokens share its bits; only then both columns are sorted."""
    r = np.random.default_rng(5)
    sorts = []
    monkeypatch.setattr(line_dedup.np, "lexsort", lambda keys, whole=np.lexsort: sorts.append(1) or whole(keys))
    for lines, tokens, tied in ((1, 50, 0), (300, 4000, 0), (70_000, 90_000, 0), (0, 0, 0), (300, 4000, 1)):
        line = np.sort(r.integers(0, lines, tokens)) if lines else np.zeros(0, np.int64)
        token = r.integers(0, 1 << 64, tokens, np.uint64)
        token[::7] = token[: len(token[::7])]
        if tied:
            line[5:8], token[5:8] = line[5], [(1 << 60) + 3, (1 << 60) + 1, (1 << 60) + 3]
        expected = sorted(zip(line.tolist(), token.tolist()))
        sorts.clear()
        got_token, got_line = line_dedup._by_line(token, line)
        assert list(zip(got_line.tolist(), got_token.tolist())) == expected and len(sorts) == tied


def test_line_dedup_tells_long_lines_apart(spark, documents):
    # 40 lines of 100 to 200 words share one word that is rare, and every fourth is a near copy of the line before it. A sketch of 64 bits
    # lets nearly all of them meet.
    r = random.Random(5)
    rows, line = [], []
    for i in range(40):
        if i % 4 == 3:
            line = [*line[:-4], f"x{i}"]
        else:
            line = ["rare", *(f"w{i}_{j}" for j in range(r.randint(99, 199)))]
        rows.append((i, " ".join(line)))
    docs = documents(rows)
    found = line_dedup.prefix_rows(docs.select(*line_dedup._identity(docs)), np.ones(1 << line_dedup.BUCKET_BITS, np.uint8), 0.8)
    met = line_dedup.meet(found.coalesce(1).sortWithinPartitions("token", "doc", "place"), 0.8).where("kind = 'pair'").select("doc", "a_doc").distinct()
    assert {(x.doc, x.a_doc) for x in met.collect()} == {(i, i - 1) for i in range(3, 40, 4)}
    assert sorted(tuple(x) for x in line_dedup.line_report(docs).collect()) == plain_lines(rows)


def test_line_dedup_shuffles_texts_of_candidates_only(spark, documents):
    docs = documents([(i, f"text number {i}") for i in range(500)])
    texts = docs.select(*line_dedup._identity(docs))
    by_doc = texts.where("doc in (3, 77, 410)").select("doc", "crc")
    left = [x.doc for x in line_dedup._likely(texts, by_doc).collect()]
    assert {3, 77, 410} <= set(left) and len(left) < 10
    assert line_dedup._likely(texts, by_doc.limit(0)).count() == 0


def plain_repeats(rows, length):
    seen, out = set(), []
    for number, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - length + 1):
            string = data[p: p + length]
            if string in seen:
                gone[p: p + length] = True
            seen.add(string)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((number, len(data), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("chunk", [700, 1 << 20])
def test_suffix_dedup(documents, monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    r = random.Random(5)
    base = ["".join(r.choice("abcdé xyz") for _ in range(400)) for _ in range(5)]
    rows = []
    for i in range(50):
        text = ""
        for _ in range(r.randint(0, 6)):
            kind, at = r.random(), r.randint(0, 300)
            text += r.choice(base)[at: at + r.randint(20, 300)] if kind < 0.5 else r.choice("ab") * r.randint(1, 250) if kind < 0.7 else "".join(r.choice("pqrs") for _ in range(99))
        rows.append((i * 3, text or None))
    assert sorted((*x[:5], bytes(x[5])) for x in suffix_dedup.remove_repeats(documents(rows)).collect()) == plain_repeats(rows, 100)


def test_suffix_dedup_edges(edges, nothing):
    got = {x.doc_id: x for x in suffix_dedup.remove_repeats(edges, with_text=False).collect()}
    assert got[9].n_removed == got[9].n_bytes > 0 and got[8].n_removed == 30_000 - 1 and got[1].n_bytes == 0 and got[None].n_removed == 0
    assert suffix_dedup.remove_repeats(edges).count() == edges.count() and suffix_dedup.remove_repeats(nothing).count() == 0


def test_cap_dedup(spark):
    r = np.random.default_rng(6)
    rows, number = [], 0
    for label in (0, 1, None):
        for _ in range(40):
            base = r.normal(size=64)
            for _ in range(int(r.integers(1, 6))):
                rows.append((number, [float(x) for x in np.float32(base + r.normal(size=64) * r.choice([0, 0.05, 0.12]))], label))
                number += 1
    odd = [(number, None, 0), (number + 1, [0.0] * 64, 0), (number + 2, [float("nan")] * 64, 0), (number + 3, [None] + [1.0] * 63, 0), (number + 4, [], 0),
           (number + 5, [1.0, 2.0], 0), (number + 6, [2.0, 4.0], 0), (number + 7, [float("inf")] + [1.0] * 63, 0), (None, rows[0][1], 0), (3, rows[3][1], rows[3][2])]
    rows += odd
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    unit = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2]
              and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98]
    root = groups(linked, range(len(rows)))
    first = {}
    for i, (number, _, _) in enumerate(rows):
        first[root[i]] = min((x for x in (first.get(root[i]), number) if x is not None), default=None)
    degree = [sum(i in p for p in linked) for i in range(len(rows))]
    expected = sorted(((n, degree[i], first[root[i]], n is not None and n == first[root[i]]) for i, (n, _, _) in enumerate(rows)), key=str)
    assert sorted((tuple(x) for x in cap_dedup.near_duplicates(table).collect()), key=str) == expected
    assert cap_dedup.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("size", [64, 384])
def test_caps_by_number(size):
    """Pairs at the threshold share a cap at every size of the code; unrelated vectors meet far less than in proportion."""
    r, pairs, cosine, met = np.random.default_rng(size), 400, 0.9801, {}
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in r.normal(size=(2, pairs, size)))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = cosine * x + np.sqrt(1 - cosine ** 2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    caps = cap_dedup.Caps()
    for level in (10, 13, 16):
        (rows, of), (others, to) = cap_dedup.decode(x, caps, level), cap_dedup.decode(y, caps, level)
        mine = set(zip(rows.tolist(), of.tolist()))
        assert len({a for a, f in zip(others.tolist(), to.tolist()) if (a, f) in mine}) >= pairs - 1
        assert 0.5 < len(rows) / pairs / caps.caps / caps.turns < 2
        lists = {}
        for a, f in mine:
            lists.setdefault(f, set()).add(a)
        met[level] = len({(a, b) for v in lists.values() for a in v for b in v if a < b}) * 2 ** level
    assert met[16] < 10 * met[10]


def test_caps_are_exact_sums():
    """Decoding finds the filters that a visit of all of them finds."""
    caps, level = cap_dedup.Caps(caps=12.0), 4
    x = np.random.default_rng(3).normal(size=(30, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    words, plain = caps.words(level), set()
    for number, (turn, (first, second)) in enumerate(cap_dedup.code(12, caps, level)):
        turned = x @ turn
        sums = (turned[:, :6] @ first)[:, :, None] + (turned[:, 6:] @ second)[:, None, :]
        plain |= {(int(a), int(i * words + j + number * words ** 2)) for a, i, j in zip(*np.nonzero(sums >= caps.reach(level)))}
    assert set(zip(*(v.tolist() for v in cap_dedup.decode(x, caps, level)))) == plain
