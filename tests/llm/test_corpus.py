"""Mixing, the toxicity classifier and the pipeline."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from marketloom.llm import line_dedup, mixing, simhash_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5, 2, 1), repeats=3):
    """Targets by repeated resharing; sources in code point order, None last."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(repeats * sizes[s] for s in stopped)
        open_ = [s for s in names if s not in stopped]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > repeats * sizes[s]}
        if not above:
            return {s: repeats * sizes[s] if s in stopped else share[s] for s in names}
        stopped |= above


def plain_seats(targets, house, most):
    """Sainte-Laguë seats, one highest quotient after the other."""
    seats = dict.fromkeys(targets, 0)
    names = sorted(targets, key=lambda s: (s is None, s or ""))
    for _ in range(house):
        able = [s for s in names if seats[s] < most[s] and targets[s] > 0]
        if not able:
            break
        best = max(able, key=lambda s: (targets[s] / (2 * seats[s] + 1), -names.index(s)))
        seats[best] += 1
    return seats


ROWS = [(i, " ".join(f"w{j}" for j in range(1 + i * 7 % 90)), "en", [None, "b", "a", "ä", "big", "big", "big", "tiny"][i % 8]) for i in range(160) if i % 8 != 7 or i < 8]


def test_mix(documents):
    docs, mix = documents(ROWS), mixing.Mix(block=4)
    got = mixing.mix_sizes(docs, mix).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sizes(documents(ROWS, 7), mix).collect()), key=str)
    source, sizes = {r[0]: r[3] for r in ROWS}, {}
    for r in ROWS:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1]))
    targets = plain_targets(sizes)
    most = {s: 3 * -(-n // mix.block) for s, n in sizes.items()}
    for r in got:
        assert r.size == len(WORD.findall(dict((x[0], x[1]) for x in ROWS)[r.doc_id])) and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(targets[source[r.doc_id]]) and 0 <= r.taken <= 3 * r.size
    for s in sizes:
        assert abs(sum(r.taken for r in got if source[r.doc_id] == s) - targets[s]) <= 4 * mix.block
    quotas = mixing.shard_quotas(mixing.source_targets(mixing._narrow(docs), mix), mix).collect()
    total = sum(targets.values())
    for shard in range(1, mix.shards + 1):
        expected = plain_seats(targets, int(total / mix.block * shard / mix.shards + 0.5), most)
        assert {r.group: r.seats for r in quotas if r.shard == shard} == {"1" if s is None else "0" + s: n for s, n in expected.items()}
    assert all(r.quota >= 0 for r in quotas)
    # Each shard takes exactly its quota of blocks of each source, no block more often in one pass than once, and none beyond its source.
    blocks, picked, often = {r.group: r.blocks for r in quotas}, {}, {}
    for r in mixing.block_picks(mixing.shard_quotas(mixing.source_targets(mixing._narrow(docs), mix), mix), mix).collect():
        picked[r.group, r.shard] = picked.get((r.group, r.shard), 0) + r.blocks_hi - r.blocks_lo
        for k in range(r.blocks_lo, r.blocks_hi):
            often[r.group, k] = often.get((r.group, k), 0) + 1
    assert picked == {(r.group, r.shard): r.quota for r in quotas if r.quota}
    for r in quotas:
        if r.shard == mix.shards and r.blocks:
            counts = [often.get((r.group, k), 0) for k in range(r.blocks)]
            assert sum(counts) == sum(n for (g, _), n in often.items() if g == r.group) == r.seats and max(counts) - min(counts) <= 1 and max(counts) <= mix.repeats
    # Words by shard are those blocks; only the last block of a source may be short.
    quota = {(r.group, r.shard): r.quota for r in quotas}
    dealt = {}
    for r in got:
        assert sum(r.shard_words.values()) == r.taken
        name = "1" if source[r.doc_id] is None else "0" + source[r.doc_id]
        for shard, n in r.shard_words.items():
            dealt[name, shard] = dealt.get((name, shard), 0) + n
    for key, n in quota.items():
        short = -sizes[None if key[0] == "1" else key[0][1:]] % mix.block
        assert n * mix.block - mix.repeats * short <= dealt.get(key, 0) <= n * mix.block
    # Another seed picks other blocks.
    assert {(r.doc_id, r.taken) for r in mixing.mix_sizes(docs, mixing.Mix(block=4, seed=6)).collect()} != {(r.doc_id, r.taken) for r in got}


def test_mixed_texts(documents, edges, nothing):
    for docs in (documents(ROWS), edges):
        taken = {}
        for r in mixing.mix_sizes(docs).collect():
            taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
        out = mixing.mix_documents(docs)
        assert out.columns == docs.columns
        words = dict.fromkeys(taken, 0)
        for r in out.collect():
            words[r.doc_id] += len(WORD.findall(r.text))
            assert r.n_chars == len(r.text)
        assert words == taken
    by_shard, expected = {}, {}
    for r in mixing.mix_documents(documents(ROWS), shard_name="shard").collect():
        by_shard[r.doc_id, r.shard] = by_shard.get((r.doc_id, r.shard), 0) + len(WORD.findall(r.text))
    for r in mixing.mix_sizes(documents(ROWS)).collect():
        expected |= {(r.doc_id, s): n for s, n in r.shard_words.items()}
    assert by_shard == expected
    assert mixing.mix_sizes(nothing).count() == 0 and mixing.mix_documents(nothing).count() == 0


def labelled(n=400):
    r = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{k}" for k in r.zipf(1.6, int(r.integers(5, 60))) % 500]
        toxic = bool(i % 4 == 0)
        if toxic:
            words.insert(int(r.integers(0, len(words))), str(r.choice(["vile", "Rotten", "nasty"])))
        rows.append((i, " ".join(words), "en" if i % 3 else "de"))
        if i % 10 < 7 or zlib.crc32(str(i).encode()) % 5 == 0:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark, documents, edges, nothing):
    rows, labels = labelled()
    docs, marks = documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.judge(docs, marks).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(got[i].predicted, t) for i, _, t in labels if got[i].held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    assert sum(r.predicted == (i % 4 == 0) for i, r in got.items()) / len(got) > 0.95
    # Neither labels of the held-out part nor language, source or number change a score.
    spoilt = spark.createDataFrame([(i, q, 1 - t if got[i].held_out else t) for i, q, t in labels], marks.schema)
    moved = documents([(i, t, "fr", "elsewhere") for i, t, _ in rows])
    assert {r.doc_id: r.score for r in toxicity.judge(moved, spoilt).collect()} == {i: r.score for i, r in got.items()}
    kept = toxicity.keep_clean(docs, marks)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.rejected}
    assert toxicity.judge(edges, marks).count() == edges.count() and toxicity.judge(nothing, marks).count() == 0
    assert all(r.score < 0.01 for r in toxicity.judge(docs, marks.limit(0)).collect())
    # A sum of ids that holds no row leaves the model untrained; one that holds all rows changes nothing.
    assert all(r.score < 0.01 for r in toxicity.judge(docs, marks, toxicity.Settings(sample_bytes=0)).collect())
    whole = toxicity.judge(docs, marks, toxicity.Settings(sample_bytes=1 << 40))
    assert {r.doc_id: r.score for r in whole.collect()} == {i: r.score for i, r in got.items()}


def test_toxicity_tasks_hold_little_at_a_time(spark, documents, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 50)
    settings = toxicity.Settings(least_rows=1)
    r = np.random.default_rng(3)
    texts = [r.integers(toxicity.FIRST, 2 * settings.buckets, (40, 2)).astype(np.int32) for _ in range(20)]
    learner = toxicity.Learner(toxicity.untrained(settings, 0.0, texts))
    learner.model.dense[:] = 1
    flat, speed = learner.flat(), learner.table_speed.copy()
    batches = list(toxicity.learn_shard(learner.model, flat, speed, ((t, i % 2) for i, t in enumerate(texts))))
    place = np.concatenate([b.column("place").to_numpy() for b in batches])
    assert len(batches) > 2 and max(b.num_rows for b in batches[:-1]) == 50 and len(np.unique(place)) == len(place)
    # Rows go to Python in batches of a few MB, not 10,000 texts at a time.
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    marks = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    toxicity.judge(documents([(1, "some text")]), marks).collect()
    assert int(spark.conf.get(name).rstrip("b")) <= 4 << 20
    spark.conf.set(name, "1000")
    toxicity.judge(documents([(1, "some text")]), marks).collect()
    assert spark.conf.get(name).rstrip("b") == "1000"
    spark.conf.unset(name)


def test_toxicity_learns_from_all_labelled_rows(spark, documents):
    # Ten toxic words stand in ten rows each; only a learner that reads all rows knows all of them. One text has more than 50,000 words.
    r, rows, labels = np.random.default_rng(5), [], []
    for i in range(9000):
        words = [f"plain{int(k)}" for k in r.integers(0, 40, 12)]
        toxic = i % 10 == 0
        if toxic:
            words[int(r.integers(0, 12))] = f"bad{i // 10 % 90}"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(9000 + i, "long " * 50_001 + " enormous" + f" plain{i}") for i in range(12)]
    labels += [(9000 + i, 1, 1) for i in range(12)]
    learnt = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    steps = toxicity.Settings(shard_rows=2000)
    model = toxicity.train(documents(rows), marks, steps)
    # The words of every class and the words of the long texts have vectors, and several shards agree on one model.
    from marketloom.llm.textscan import text_bytes
    import pyarrow as pa

    ids, _ = toxicity.token_ids(*text_bytes(pa.array([" ".join([*[f"bad{k}" for k in range(90)], "enormous"])])), steps)
    known = model.lookup[ids[1:-2, 0]] > 0
    assert len(learnt) > 6000 and known.mean() > 0.95 and known[-1]
    got = {r.doc_id: r.predicted for r in toxicity.judge(documents(rows), marks, steps).collect()}
    assert sum(got[i] == t for i, _, t in labels) / len(labels) > 0.95
    again = toxicity.train(documents(rows, 5), marks, steps)
    assert np.array_equal(again.table, model.table) and (again.scale, again.shift, again.thresholds) == (model.scale, model.shift, model.thresholds)


def test_a_long_step_is_cut_into_blocks(monkeypatch):
    settings = toxicity.Settings(least_rows=1)
    texts = [np.random.default_rng(k).integers(2, 90, (k, 2)).astype(np.int32) for k in (1, 13, 40)]
    models = []
    for block in (1 << 16, 5):
        monkeypatch.setattr(toxicity, "STEP_BLOCK", block)
        learner = toxicity.Learner(toxicity.untrained(settings, 0.0, texts))
        learner.model.dense[:] = 0.1
        learner.step([learner.model.lookup[t] for t in texts], np.array([1, 0, 1], np.float32))
        models.append(learner.model)
    assert np.allclose(models[0].table, models[1].table, atol=1e-5) and np.allclose(models[0].dense, models[1].dense, atol=1e-5)


def test_pools_over_block_borders(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    settings = toxicity.Settings(least_rows=1)
    texts = [np.array([[2 + i, 900 + j]], np.int32).repeat(3, 0) + k for i, j, k in ((1, 2, 0), (3, 4, 1))]
    model = toxicity.untrained(settings, 0.0, texts)
    pads = np.full((2, 2), toxicity.PAD, np.int32)
    ids = np.concatenate([p for t in texts for p in (np.full((1, 2), toxicity.BEGIN, np.int32), t, pads)])
    row = np.repeat([0, 1], 6)
    small = model.pool(ids, row, 2)
    monkeypatch.setattr(toxicity, "BLOCK", 1000)
    assert np.allclose(small, model.pool(ids, row, 2))


def test_pipeline(spark, documents, tmp_path):
    rows, labels = labelled(200)
    rows += [(1000 + i, rows[i][1] + "\n" + " ".join(f"line{j}" for j in range(20)), "en") for i in range(30)] + [(2000, None), (2001, "")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, own = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    marks = spark.read.parquet(f"{tmp_path}/labels.parquet")
    plain = [lambda d: toxicity.keep_clean(d, marks), lambda d: line_dedup.strip_lines(d).drop("_lines", "_removed"), simhash_dedup.keep_one, mixing.mix_documents]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/stage-{name}"
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if k < len(plain):
            assert after.columns == docs.columns
            assert sorted(map(str, after.collect())) == sorted(map(str, plain[k](docs).collect()))
        own.append(after.count())
        docs = after
    assert own[0] < len(rows) and own[2] < own[1] and docs.where("not round_trip").count() == 0
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))
