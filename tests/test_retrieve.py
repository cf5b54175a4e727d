"""Searches against brute force in plain Python."""

import difflib
import random

import numpy as np
from pyspark.sql import functions as F

from lexweft.operators import dense, retrieve

KB = "entity_id long, label string, label_norm string, label_ord long"


def labels(spark, rng, n):
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 6)))
    rows = [(i // 3, x := f"{word()} {word()}", x, i) for i in range(n)]
    return rows, spark.createDataFrame(rows, KB).repartition(3)


def best(scored, k):
    """(score, entity) of the best label of each entity, ties by entity."""
    per = {}
    for e, s in scored:
        per[e] = max(per.get(e, -1), s)
    return [(e, s) for s, e in sorted(((-s, e) for e, s in per.items()))][:k]


def test_difflib_equals_brute_force(spark):
    rng = random.Random(1)
    rows, df = labels(spark, rng, 90)
    queries = [rng.choice(rows)[1][::-1] for _ in range(5)] + [rows[7][1], "", None]
    out = retrieve.difflib_topk(spark.createDataFrame([(q,) for q in queries], "mention string"), df, 4).collect()
    for q in {q for q in queries if q is not None}:
        want = best([(e, 100 * difflib.SequenceMatcher(None, q, x).ratio()) for e, x, _, _ in rows], 4)
        got = sorted((r["rank"], r["entity_id"], r["score"]) for r in out if r["query"] == q)
        assert [g[1] for g in got] == [e for e, _ in want] and np.allclose([g[2] for g in got], [-s for _, s in want])


def test_dense_in_blocks_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v, q = rng.normal(size=(120, 8)), rng.normal(size=(25, 8))
    index = spark.createDataFrame([(i % 40, i, x.tolist()) for i, x in enumerate(v)], "entity_id long, label_ord long, embedding array<float>").repartition(4)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query long, embedding array<float>")
    one = sorted(map(tuple, retrieve.dense_topk(queries, index, 3).collect()))
    monkeypatch.setattr(retrieve, "DENSE_BLOCK", 10)
    monkeypatch.setattr(retrieve, "BLOCK", 50)
    assert sorted(map(tuple, retrieve.dense_topk(queries, index, 3).collect())) == one
    s = q.astype(np.float32).astype(float) @ v.astype(np.float32).astype(float).T
    for i in range(25):
        top = np.argsort(-s[i])[:9]
        assert [r[1] for r in one if r[0] == i and r[3] == 1] == [top[0] % 40]
    assert retrieve.dense_topk(queries.limit(0), index, 3).count() == 0


def test_near_terms_equal_brute_force(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(150)})
    out = retrieve.near_terms(spark.createDataFrame([(w,) for w in words[::3]], "qterm string"), spark.createDataFrame([(w,) for w in words], "term string"))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(a, b) for a in words[::3] for b in words if distance(a, b) <= (0 if len(a) <= 2 else 1 if len(a) <= 5 else 2)}
    assert {tuple(r) for r in out.collect()} == want


def test_dense_index_equals_brute_force(spark):
    names = ["heart failure", "liver failure", "lung disease", "renal failure", "heart attack"]
    e = spark.createDataFrame([(i, n, [n[::-1]]) for i, n in enumerate(names)], "entity_id long, preferred_label string, synonyms array<string>")
    load = dense.hashed_trigrams()
    q = e.select(F.col("entity_id").alias("query"), F.upper("preferred_label").alias("mention"))
    out = dense.retrieve(q, dense.build_index(e, load), load, 3).collect()
    m = load()([*names, *[n[::-1] for n in names]])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i, n in enumerate(names):
        s = np.round((m @ m[i]).astype(float), 5)
        want = best([(j % 5, x) for j, x in enumerate(s)], 3)
        got = sorted((r["rank"], r["entity_id"], r["score"]) for r in out if r["query"] == i)
        assert got[0][1] == i and np.allclose([g[2] for g in got], [-x for _, x in want], atol=1e-4)


def test_bm25_by_slices_equals_the_join(spark, monkeypatch):
    """Documents scored slice by slice: same rows as all scores by the join, with ties, empty and null texts, other letters and keys as strings."""
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "x1", "été", "42", "delta", "KELVIN", "eta"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(300)] + [(300, None), (301, ""), (302, "--")]
    docs += [(1000 + i, docs[i][1]) for i in range(60)]  # ties
    queries = spark.createDataFrame([("alpha beta beta",), ("Gamma, ÉTÉ",), ("nothing here",), ("42 x1 delta",), ("",), (None,), ("KELVIN",)], "mention string")

    def scan(*_):
        raise AssertionError("the join was taken")

    for kind, df in (("long", spark.createDataFrame(docs, "doc long, text string")), ("string", spark.createDataFrame([(f"d{i}", t) for i, t in docs], "doc string, text string"))):
        want = {}
        for r in retrieve.bm25_scores(queries, df, "doc", "text").collect():
            want.setdefault(r["query"], []).append((-r["score"], r["doc"]))
        want = sorted((q, d, -s, i + 1) for q, x in want.items() for i, (s, d) in enumerate(sorted(x)[:7]))
        with monkeypatch.context() as m:
            m.setattr(retrieve, "bm25_scores", scan)
            got = retrieve.bm25_topk(queries, df.repartition(3), "doc", "text", 7)
            assert sorted(map(tuple, got.collect())) == want and len(want) > 20, kind
    # a key that is not unique takes the join, and the searches without terms or documents have no rows
    twice = spark.createDataFrame([(1, "alpha"), (1, "beta")], "doc long, text string")
    assert retrieve.bm25_topk(queries, twice, "doc", "text").count() == 1
    assert retrieve.bm25_topk(queries, twice.filter("false"), "doc", "text").count() == 0
    assert retrieve.bm25_topk(queries.filter("mention = ''"), twice, "doc", "text").count() == 0


def test_bm25_slices_are_bounded(monkeypatch):
    """A slice's hits are added a bounded number at a time, with the same scores."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(["a b c " * (i + 1) for i in range(40)])], names=["key", "text"])
    queries, number = [f"q{i}" for i in range(30)], {b"a": 0, b"b": 1, b"c": 2}
    run = lambda: [b.to_pylist() for b in retrieve._score_documents(queries, number, np.array([0, 30, 60, 90]), np.tile(np.arange(30), 3), np.full(3, 40.0), 40, 60.0, 5, 1.2, 0.75, "key")(iter([batch]))]
    one = run()
    monkeypatch.setattr(retrieve, "HITS", 35)
    assert run() == one and len(one[0]) == 150


def test_dense_tiles_are_bounded(monkeypatch):
    """A block of queries meets a batch in tiles of bounded size; all rows of every tile come out."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(500, 8)).astype(np.float32), rng.normal(size=(70, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(range(500)), pa.array(list(v))], names=["entity_id", "label_ord", "embedding"])
    monkeypatch.setattr(retrieve, "CELLS", 5_000)
    sizes, plain = [], np.round

    def seen(x, n):
        sizes.append(x.size)
        return plain(x, n)

    monkeypatch.setattr(retrieve.np, "round", seen)
    rows = [r for b in retrieve._dense_block(np.arange(70), q, batch, 4) for r in b.to_pylist()]
    s = plain(q @ v.T.astype(np.float64), 6)
    assert max(sizes) <= 5_000 and len(rows) == 280
    assert {(r["query"], r["entity_id"]) for r in rows} == {(i, j) for i in range(70) for j in np.argsort(-s[i])[:4]}
