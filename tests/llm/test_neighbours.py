import os
import tracemalloc

import numpy as np

from colophon.llm.neighbours import CentroidGraph, balanced_centroids, codes_of, distances, search_list, similar_pairs

SCHEMA = "id string, embedding array<float>, q string, nid int"


def pairs(spark, rows, **kw):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "extra", 7) for i, v in rows], SCHEMA)
    return {(r[0], r[1]) for r in similar_pairs(df, **kw).collect()}


def brute(ids, x, k=5):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {tuple(sorted((ids[i], ids[j]))) for i in range(len(ids)) for j in np.argsort(-s[i], kind="stable")[:k]}


def test_recall_on_uneven_clusters(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 64))
    label = rng.choice(12, 4000, p=np.r_[0.4, np.full(11, 0.6 / 11)])
    x = (centres[label] + rng.normal(scale=0.7, size=(4000, 64))) * rng.uniform(0.1, 9, size=(4000, 1))
    ids = [f"v{i:05d}" for i in range(4000)]
    got, want = pairs(spark, list(zip(ids, x.tolist()))), brute(ids, x.astype(np.float32).astype(float))
    assert len(got & want) / len(want) >= 0.9
    assert len(got & want) / len(got) >= 0.9


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(2)
    good = [(f"g{i}", rng.normal(size=64)) for i in range(8)]
    bad = [("null", None), ("empty", []), ("short", [1.0] * 63), ("zero", [0.0] * 64), ("nan", [float("nan")] + [1.0] * 63), ("inf", [float("inf")] + [1.0] * 63), ("hole", [None] + [1.0] * 63), (None, [1.0] * 64)]
    got = pairs(spark, good + bad + [good[0]])
    ids, x = [g[0] for g in good], np.array([g[1] for g in good])
    assert got == brute(ids, x.astype(np.float32).astype(float))
    assert pairs(spark, []) == set() and pairs(spark, bad) == set()
    assert pairs(spark, good[:1]) == set()


def test_large_group_of_equal_vectors(spark):
    one = np.ones(64)
    rng = np.random.default_rng(3)
    rows = [(f"same{i:03d}", one * (1 + i % 3)) for i in range(300)] + [(f"v{i}", rng.normal(size=64)) for i in range(30)]
    got = pairs(spark, rows)
    per = {}
    for a, b in got:
        for p, q in ((a, b), (b, a)):
            per.setdefault(p, set()).add(q)
    assert all(len([q for q in per[f"same{i:03d}"] if q.startswith("same")]) >= 5 for i in range(300))
    assert len(got) < 300 * 5 + 30 * 5 + 10  # k partners each, not all pairs


def test_small_groups_fill_up_with_others(spark):
    rng = np.random.default_rng(4)
    x = [rng.normal(size=64) for _ in range(20)]
    rows = [(f"a{i:02d}", v) for i, v in enumerate(x)] + [("b00", x[0]), ("c00", x[0] * 2)]
    got = pairs(spark, rows)
    assert {("a00", "b00"), ("a00", "c00"), ("b00", "c00")} <= got
    assert len({p for p in got if "b00" in p}) >= 5


def test_balance_and_graph():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(scale=0.05, size=(3000, 16)) + 1, rng.normal(size=(1000, 16))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, sizes = balanced_centroids(x, 32)
    assert sizes.sum() == 4000 and sizes.max() <= 64
    graph = CentroidGraph(c)
    found, sims = graph.search(x[::7], 6)
    best = (x[::7] @ c.T).argmax(1)
    assert (found[:, 0] == best).mean() >= 0.95
    same, size = balanced_centroids(np.ones((500, 16), np.float32) / 4, 32)
    assert len(same) == 1 and size[0] == 500


def test_lists_that_outgrow_the_fit_are_divided_again(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(9, 64))
    x = centres[rng.choice(9, 8000, p=np.r_[0.4, np.full(8, 0.6 / 8)])] + rng.normal(scale=0.7, size=(8000, 64))
    ids = [f"v{i:05d}" for i in range(8000)]
    want = brute(ids, x.astype(np.float32).astype(float))
    for sample in (24 * 4, 24):  # four lists and one, in place of 32
        got = pairs(spark, list(zip(ids, x.tolist())), sample_rows=sample)
        assert len(got & want) / len(want) >= 0.97
        assert len(got & want) / len(got) >= 0.97


def test_divided_list_against_all_pairs():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 64)) + 2 * rng.normal(size=(10, 64))[rng.integers(0, 10, 3000)]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    nid = np.arange(3000)
    whole = set(zip(*[v.tolist() for v in search_list(x, nid, nid, nid, 5, divide=10_000)[:2]]))
    parts = set(zip(*[v.tolist() for v in search_list(x, nid, nid, nid, 5, divide=500)[:2]]))
    assert len(whole) == len(parts) == 15_000 and len(whole & parts) / len(whole) >= 0.97
    same = np.tile(x[:1], (2000, 1))
    assert len(search_list(same, np.arange(2000), np.arange(2000), np.arange(2000), 5, divide=500)[0]) == 10_000  # undividable


def test_a_pair_met_in_several_lists_takes_one_place(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3, 64))[rng.integers(0, 3, 1200)] + rng.normal(scale=0.3, size=(1200, 64))
    ids = [f"v{i:05d}" for i in range(1200)]
    got, want = pairs(spark, list(zip(ids, x.tolist())), sample_rows=24 * 8), brute(ids, x.astype(np.float32).astype(float))
    per = {i: 0 for i in ids}
    for a, b in got:
        per[a] += 1
        per[b] += 1
    assert min(per.values()) >= 5
    assert len(got & want) / len(want) >= 0.995


def test_distance_of_a_pair_is_the_same_wherever_it_stands():
    rng = np.random.default_rng(9)
    q = codes_of(rng.normal(size=(40, 64)) + 3)
    a, b = (z.ravel() for z in np.meshgrid(np.arange(40), np.arange(40)))
    x = q.astype(np.float64) / np.linalg.norm(q.astype(np.float64), axis=1, keepdims=True)
    far = distances(q, a, b)
    assert np.abs(far - (1 - x @ x.T)[a, b]).max() < 1e-8
    back = rng.permutation(40)
    assert (distances(q[back], np.argsort(back)[b], np.argsort(back)[a]) == far).all()


def test_building_the_graph_holds_few_cosines_at_a_time():
    rng = np.random.default_rng(10)
    c = rng.normal(size=(12_000, 8)).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    tracemalloc.start()
    got = CentroidGraph._nearest(c, c, 24)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6  # more than 1 GB where the order of all rows is kept
    assert got.shape == (12_000, 24) and (got == np.arange(12_000)[:, None]).any(axis=1).all()


def test_the_driver_holds_no_sample(spark, monkeypatch):
    here = os.getpid()
    monkeypatch.setattr("colophon.llm.neighbours.balanced_centroids", lambda *a, **k: 1 / 0 if os.getpid() == here else balanced_centroids(*a, **k))
    rng = np.random.default_rng(11)
    ids, x = [f"v{i}" for i in range(20)], rng.normal(size=(20, 64))
    assert pairs(spark, list(zip(ids, x.tolist()))) == brute(ids, x.astype(np.float32).astype(float))
