import random

import numpy as np

from tesserae.operators import stats


def test_kendall_beyond_the_rows_of_a_range(spark):
    r = random.Random(3)
    rows = [(g, r.choice([1, 1, 1, 2, r.random() * 9]), r.choice([4, r.randint(0, 40)])) for g in ("a", "b", None) for _ in range(250)] + [("one", 1.0, 1)]
    rows = [(g, float(x), float(x + y if g == "b" else y)) for g, x, y in rows]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    for by in ([], ["g"]):
        got = {(t.g if by else 0): (t.tau, t.n) for t in stats.kendall(df, "x", "y", by, most=20).collect()}
        for g in {t[0] if by else 0 for t in rows}:
            a, b = np.array([t[1:] for t in rows if not by or t[0] == g]).T
            s, p, q = np.sign(a[:, None] - a) * np.sign(b[:, None] - b), a[:, None] != a, b[:, None] != b
            base = np.sqrt(float(p.sum()) * float(q.sum()))
            tau, n = got[g]
            assert n == len(a) and (abs(tau - s.sum() / base) < 1e-12 if base else tau != tau)
        assert len(got) == (4 if by else 1)
    assert stats.kendall(df.limit(0), "x", "y").count() == 0
