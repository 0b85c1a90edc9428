import random
import re

import numpy as np
import pytest

from tesserae.llm import ngram_join
from tesserae.llm.components import components


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 10 * min(len(x), len(y)) >= 8 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    ra, rb = find(a), find(b)
                    up[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), find(d)) for d in sets}


def corpus(seed):
    r = random.Random(seed)
    rows, passage = [], " ".join(f"p{i}" for i in range(60))

    def text(n):
        return [f"w{r.randint(0, 5000)}" for _ in range(n)]

    for _ in range(12):
        base = text(r.choice([3, 4, 5, 9, 40, 170, 600, 1500]))
        for _ in range(r.choice([1, 2, 6, 15])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, len(t) // 60, len(t) // 40])):
                t[r.randrange(len(t))] = f"x{r.randint(0, 99)}"
            rows.append(" ".join(t).replace("w1", "W1"))
    rows += [passage + " " + " ".join(text(n)) for n in (3, 5, 8, 12, 14, 30, 200) for _ in range(3)]
    long = text(700)
    rows += [" ".join(long[: 700 - 7 * i]) for i in range(25)]  # a chain of links
    rows += [None, "", " \n\t", "one", "one", "One two three", "one two three four five", "one two three four five six"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("often,least", [(0.0005, 16), (0.0, 2), (0.0, 5)])
def test_join_is_exact(spark, often, least):
    rows = corpus(int(often * 1e4) + least)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as component_id").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df, often=often, least_often=least, per_part=2000).collect()}
    want = brute(rows)
    assert {d: g for d, g in got.items() if g != want[d]} == {}
    kept = ngram_join.one_of_each(df, often=often, least_often=least)
    assert {r.doc_id for r in kept.collect()} == {c for _, c in want.values()} and kept.columns == df.columns


def test_null_and_repeated_ids_and_no_rows(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (5, "other words"), (9, t + " x"), (7, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.join(df).collect())
    assert got == [(0, 26, 0), (5, 1, 5), (5, 26, 5), (5, 26, 5), (7, 0, 7), (9, 27, 5)]
    assert ngram_join.join(df.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [(130, 140), (500, 620), (100, 120), (2000, 2300)])
def test_prefixes_share_a_signature(sizes):
    """Whatever is frequent, sets that link share a signature."""
    r = np.random.default_rng(sum(sizes))
    for _ in range(60):
        n, m = int(r.integers(*sizes)), int(r.integers(*sizes))
        pool = np.unique(r.integers(0, 2**63, 4 * max(n, m)).astype(np.uint64) * np.uint64(2))
        r.shuffle(pool)
        need = -(-80 * (n + m) // 180)
        if need > min(n, m):
            continue
        x, y = np.sort(pool[:n]), np.sort(np.concatenate([pool[:need], pool[n : n + m - need]]))
        frequent = np.sort(r.choice(pool, int(r.choice([0.0, 0.3, 0.8, 1.0]) * len(pool)), replace=False))
        a, b = (set(ngram_join.signatures(s, np.isin(s, frequent))[0].tolist()) for s in (x, y))
        assert a & b


@pytest.mark.parametrize("sizes", [(16, 20), (60, 75), (130, 140), (500, 620), (2000, 2300)])
def test_shared_signatures_reach_their_bound(sizes):
    """Of sets that link, in all tiers of tokens, at least as many as the filter asks for."""
    r = np.random.default_rng(sum(sizes))
    for _ in range(60):
        n, m = int(r.integers(*sizes)), int(r.integers(*sizes))
        need = -(-80 * (n + m) // 180)
        if need > min(n, m):
            continue
        pool = np.unique(r.integers(0, 2**63, 4 * max(n, m)).astype(np.uint64) * np.uint64(2))
        r.shuffle(pool)
        x, y = np.sort(pool[:n]), np.sort(np.concatenate([pool[:need], pool[n : n + m - need]]))
        tier = r.choice([0, 1, 2], len(pool), p=r.dirichlet([0.5, 0.5, 0.5]))
        level = dict(zip(pool.tolist(), tier.tolist()))
        a, b = (set(ngram_join.signatures(s, *(np.array([level[t] >= k for t in s.tolist()]) for k in (1, 2)))[0].tolist()) for s in (x, y))
        assert len(a & b) + max(-(-80 * n // 100), -(-80 * m // 100)) - 1 >= need


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 300 + i) for i in range(200)] + [(r.randint(1000, 1200), r.randint(1000, 1200)) for _ in range(120)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        up[max(ra, rb)] = min(ra, rb)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in up if any(x in e for e in edges if e[0] != e[1])}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("block", [512, 7])
def test_every_link_is_counted(spark, monkeypatch, block):
    """Dense groups, chains and copies: links within a component too, in one block and over many."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus(11)
    r = random.Random(4)
    base = [f"d{i}" for i in range(200)]
    for _ in range(40):  # near copies, each with a word of its own
        t = list(base)
        t[r.randrange(200)] = f"y{r.randint(0, 10**6)}"
        rows.append((len(rows), " ".join(t)))
    sets = {d: shingles(t) for d, t in rows}

    def link(x, y):
        both = len(x & y)
        return both > 0 and 100 * both >= 80 * (len(x) + len(y) - both)

    want = {d: sum(link(x, y) for e, y in sets.items() if e != d) for d, x in sets.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {g.doc_id: g for g in ngram_join.join(df, least_often=2, per_part=2000).collect()}
    assert {d: (got[d].n_links, n) for d, n in want.items() if got[d].n_links != n} == {}
    assert {d: got[d].component_id for d in got} == {d: c for d, (_, c) in brute(rows).items()}
    assert max(want.values()) >= 39 and sum(want.values()) > 40 * 39


def test_links_of_null_and_repeated_ids(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (5, "other words"), (9, t + " x"), (7, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_shingles, r.n_links) for r in ngram_join.join(df).collect()) == [(0, 26, 0), (5, 1, 0), (5, 26, 2), (5, 26, 2), (7, 0, 0), (9, 27, 2)]


@pytest.mark.parametrize("own", [12, 16])
def test_a_shared_passage_is_no_meeting(spark, monkeypatch, own):
    """Documents that share a passage, which is too small a part of them for a link, are not held against each other pair by pair; copies among them are still found."""
    met = []
    meetings = ngram_join._meetings

    def counted(member):
        out = meetings(member)
        met.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_meetings", counted)
    monkeypatch.setattr(ngram_join, "LARGE", 128)
    r = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(52))
    for m in (300, 1200):
        met.clear()
        rows = [(i, f"{passage} {' '.join(f'o{i}x{j}' for j in range(own))}") for i in range(m)]
        rows += [(m + i, rows[i][1] + f" more{i}") for i in range(0, 40)]  # one word more than another one: linked
        rows += [(2 * m + i, " ".join(r.choices(passage.split(), k=30))) for i in range(20)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {g.doc_id: g.component_id for g in ngram_join.join(df, per_part=2000).collect()}
        assert got == {d: d - m if m <= d < m + 40 else d for d, _ in rows}
        assert sum(met) <= 20 * m, (m, met)
