"""Distances, coordinates and node vectors against numpy."""

import random
from collections import deque

import numpy as np
import pytest

from tesserae.operators import distances, embedding, spectral
from tesserae.plans.durable import shared_path


def ring_with_chords(n, seed=0):
    g = random.Random(seed)
    return [(i, (i + 1) % n) for i in range(n)] + [(g.randrange(n), g.randrange(n)) for _ in range(n // 4)]


def plain_distances(edges, sources):
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = set()
    for s in sources:
        seen, todo = {s: 0}, deque([s])
        while todo:
            a = todo.popleft()
            for b in near.get(a, ()):
                if b not in seen:
                    seen[b] = seen[a] + 1
                    todo.append(b)
        out |= {(s, n, d) for n, d in seen.items()}
    return out


def test_long_paths_have_no_limit(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (5, None), (7, 7)]
    df = spark.createDataFrame(edges, "source long, target long")
    start = spark.createDataFrame([(0,), (101,), (500,), (0,)], "node long")
    assert {tuple(r) for r in distances.shortest_paths(df, start).collect()} == plain_distances(edges, [0, 101, 500])


def test_all_pairs_and_the_stored_matrix(spark):
    edges = [*ring_with_chords(90), (200, 201)]
    df = spark.createDataFrame(edges, "source long, target long")
    nodes = spark.createDataFrame([(i,) for i in [*range(90), 200, 201]], "node long")
    found = distances.shortest_paths(df, nodes)
    want = plain_distances(edges, [*range(90), 200, 201])
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    path = shared_path(spark, "matrix")
    distances.write_distances(found, path)
    assert {tuple(r) for r in distances.read_distances(spark, path, [3, 200]).collect()} == {x for x in want if x[0] in (3, 200)}
    assert distances.shortest_paths(df.limit(0), nodes.limit(0)).collect() == []


def test_coordinates_by_landmarks(spark):
    edges = ring_with_chords(60, 3)
    df = spark.createDataFrame(edges, "source long, target long")
    d = {(a, b): x for a, b, x in plain_distances(edges, range(60))}
    full = np.array([[-np.cosh(d[a, b]) for b in range(60)] for a in range(60)])
    centred = full - full.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred)
    want = full @ vectors[:, ::-1][:, :3]
    got = np.array([r.components for r in distances.hyperbolic_coordinates(df, 3, 60).orderBy("node").collect()])
    for i in range(3):
        assert min(np.abs(got[:, i] - s * want[:, i]).max() for s in (1, -1)) < 1e-6 * np.abs(want[:, i]).max()
    all_, some = (distances.hyperbolic_coordinates(df, 3, n) for n in (60, 25))
    report = distances.stress(some, all_).first()
    assert report.pairs > 0 and report.mean_error < 0.35, report
    assert distances.stress(all_, all_).first().mean_error < 1e-9


def adjacency(edges, n):
    a = np.zeros((n, n))
    for i, j in edges:
        if i != j:
            a[i, j] = a[j, i] = 1
    d = a.sum(axis=1)
    return a / np.sqrt(np.outer(d, d))


def test_spectral_vectors(spark):
    edges = ring_with_chords(50, 7) + [(0, i) for i in range(2, 40)]
    m = adjacency(edges, 50)
    df = spark.createDataFrame(edges, "source long, target long").repartition(3)
    values, vectors = np.linalg.eigh(m)
    got = np.array([r.vector for r in spectral.spectral_vectors(df, 3, more=24, steps=5).orderBy("node").collect()])
    want = vectors[:, ::-1][:, :3] * np.sqrt(values[::-1][:3])
    for i in range(3):
        assert min(np.abs(got[:, i] - s * want[:, i]).max() for s in (1, -1)) < 1e-3
        assert got[np.argmax(np.abs(got[:, i])), i] > 0
    assert spectral.spectral_vectors(df.limit(0), 3).collect() == []


def test_smoothing(spark):
    edges = ring_with_chords(30, 9)
    m = adjacency(edges, 30)
    x = np.random.default_rng(1).normal(size=(30, 2))
    values, vectors = np.linalg.eigh(np.eye(30) - m)
    want = vectors @ np.diag(np.exp(-0.8 * values)) @ vectors.T @ x
    df = spark.createDataFrame(edges, "source long, target long")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, [1.0, 1.0])], "node long, vector array<double>")
    got = np.array([r.vector for r in spectral.smoothed(df, rows, 2, 0.8, order=10).orderBy("node").collect()])
    assert got == pytest.approx(want, abs=1e-8)


def test_walks_follow_edges(spark):
    edges = [(f"h{i}", "hub") for i in range(40)] + [("hub", f"h{i}") for i in range(40)] + [("h1", "end")]
    df = spark.createDataFrame(edges, "source string, target string")
    rows = embedding.walks(df, per_node=3, length=5, seed=2).collect()
    assert len(rows) == 42 * 3 and {(r.node, r.walk) for r in rows} == {(n, w) for n in [*(f"h{i}" for i in range(40)), "hub", "end"] for w in range(3)}
    known = set(edges)
    for r in rows:
        assert r.path[0] == r.node and all(p in known for p in zip(r.path, r.path[1:]))
        assert len(r.path) == 5 or r.path[-1] == "end"
    assert rows != embedding.walks(df, per_node=3, length=5, seed=3).collect()
