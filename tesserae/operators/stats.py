"""Statistical comparisons. Ranks, counts and sums are DataFrame aggregates; normal tails come from a closed form in SQL."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.udf import vectorized
from tesserae.operators import ranks


@vectorized("double")
def _erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc)


def normal_tail(z: Column) -> Column:
    """P(Z > z)."""
    return _erfc(z / math.sqrt(2)) / 2


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """rho and n over the rows that have both values."""
    by = by or []
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    cells = rows.groupBy(*by, "_x", "_y").agg(F.count("*").alias("_c"))
    for c in ("_x", "_y"):
        # the mean rank is known, so ranks are centred exactly
        centred = ranks.running(cells, c, by, {"n": F.sum("_c")}).select(*by, c, (F.col("n_before") + (F.col("n") - F.col("n_total")) / 2).alias(f"{c}r"))
        cells = ranks.beside(cells, centred, [*by, c])
    a, b, n = F.col("_xr"), F.col("_yr"), F.col("_c")
    sums = cells.groupBy(*by).agg(F.sum(n * a * b).alias("_ab"), F.sum(n * a * a).alias("_aa"), F.sum(n * b * b).alias("_bb"), F.sum(n).alias("n"))
    base = F.sqrt(F.col("_aa")) * F.sqrt(F.col("_bb"))
    return sums.select(*by, F.when(base > 0, F.col("_ab") / base).otherwise(F.lit(float("nan"))).alias("rho"), "n")


def correlation_table(df: DataFrame, left: list[str], right: list[str], method: str = "spearman") -> DataFrame:
    """(left, right, value) for each pair of columns, in one pass after ranking."""
    cols = list(dict.fromkeys([*left, *right]))
    base = df.select(*cols)
    if method == "spearman":
        for i, c in enumerate(cols):
            base = ranks.with_rank(base, c, f"_rank{i}")
        base = base.select(*(F.col(f"_rank{i}").alias(c) for i, c in enumerate(cols)))
    got = base.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a in left for b in right))
    return got.unpivot([], got.columns, "pair", "value").select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("left"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("right"), "value")


def _concordance(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> int:
    """Sum of sign(a - a') * sign(b - b') * c * c' over all pairs: by each bit of a's rank, halves that differ in it are counted against each other in the order of b."""
    rank, level = np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]
    order = np.argsort(level, kind="stable")
    rank, level, c, total = rank[order], level[order], c[order].astype(np.int64), 0
    for bit in range(int(rank.max()).bit_length()):
        by = np.argsort(rank >> (bit + 1), kind="stable")
        node, y, w, high = (rank >> (bit + 1))[by], level[by], c[by], (rank[by] >> bit & 1).astype(bool)
        run = np.concatenate([[0], np.cumsum(np.where(high, 0, w))])
        key = node * (int(level.max()) + 1) + y
        at = key[high]
        begin, end = np.searchsorted(node, node[high], "left"), np.searchsorted(node, node[high], "right")
        less, upto = np.searchsorted(key, at, "left"), np.searchsorted(key, at, "right")
        total += sum(((run[less] - run[begin] - run[end] + run[upto]).astype(object) * w[high]).tolist())
    return total


def kendall(df: DataFrame, x: str, y: str, by: list[str] | None = None, most: int = 100_000) -> DataFrame:
    """tau-b by group, exact for any number of rows. Values fall into ranges of about `most` rows of a group: pairs within a range of x or of y are counted
    in a task for each range, all other pairs from the numbers of rows in the ranges' cells."""
    by = by or []
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    cells = cells.groupBy(*by, "_x", "_y").agg(F.count("*").alias("_c"))
    size = cells.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = -(-size // most)
    cells = cells.withColumns({"_p": F.lit(0), "_q": F.lit(0)})
    if parts > 1:
        at = [i / parts for i in range(1, parts)]
        bounds = cells.groupBy(*by).agg(*(F.array_distinct(F.percentile_approx(c, at, 10 * parts)).alias(f"{c}b") for c in ("_x", "_y")))
        bounds = bounds.withColumnsRenamed({c: f"{c}_of" for c in by})
        cells = cells.join(F.broadcast(bounds) if not by else bounds, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in by] or F.lit(True))
        # a bound is a range by itself, in which all pairs tie, so a frequent value is never counted against itself
        cells = cells.withColumns({p: F.expr(f"2 * size(filter({c}b, v -> v < {c})) + cast(array_contains({c}b, {c}) as int)") for p, c in (("_p", "_x"), ("_q", "_y"))})

    def unit(kind: int, part, a: str, b: str, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*by, F.lit(kind).alias("_k"), part.cast("int").alias("_r"), F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")).agg(F.sum("_c").alias("_c"))

    work = unit(0, F.col("_p"), "_x", "_y", cells.where("_p % 2 = 0"))
    if parts > 1:
        work = work.unionAll(unit(1, F.col("_q"), "_p", "_y", cells.where("_q % 2 = 0"))).unionAll(unit(2, F.lit(0), "_p", "_q", cells))

    def count(f: pd.DataFrame) -> pd.DataFrame:
        s = _concordance(f["_a"].to_numpy(), f["_b"].to_numpy(), f["_c"].to_numpy())
        return pd.DataFrame([[*[f[c].iloc[0] for c in by], str(s)]], columns=[*by, "_s"])

    kinds = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in by)
    wide, names, zero = "decimal(38,0)", ("_s", "_n", "_t", "_u"), F.lit(0).cast("decimal(38,0)")
    c = F.col("_c").cast("decimal(19,0)")

    def part(rows: DataFrame, name: str, value) -> DataFrame:
        return rows.select(*by, *((value.cast(wide) if n == name else zero).alias(n) for n in names))

    found = part(work.groupBy(*by, "_k", "_r").applyInPandas(count, kinds + "_s string"), "_s", F.col("_s"))
    found = found.unionAll(part(cells.groupBy(*by).agg(F.sum("_c").alias("_c")), "_n", c))
    for column, name in (("_x", "_t"), ("_y", "_u")):
        found = found.unionAll(part(cells.groupBy(*by, column).agg(F.sum("_c").alias("_c")), name, c * (c - 1) / 2))
    got = found.groupBy(*by).agg(*(F.sum(n).cast("double" if n != "_n" else "long").alias(n) for n in names)).where("_n > 0")
    pairs = F.col("_n").cast("double") * (F.col("_n") - 1) / 2
    base = F.sqrt((pairs - F.col("_t")) * (pairs - F.col("_u")))
    return got.select(*by, F.when(base > 0, F.col("_s") / base).otherwise(F.lit(float("nan"))).alias("tau"), F.col("_n").alias("n"))


def mann_whitney(df: DataFrame, value: str, group: str, first, second, by: list[str] | None = None) -> DataFrame:
    """u of the first group, z with tie correction and continuity, p (two-sided) and p_less (first smaller), by normal approximation."""
    by = by or []
    values = ranks.running(df.where(F.col(group).isin(first, second)), value, by, {"n": F.count("*"), "f": F.count_if(F.col(group) == first)})
    n, f = F.col("n").cast("double"), F.col("f")
    a = values.groupBy(*by).agg(F.sum(f * (F.col("n_before") + (n + 1) / 2)).alias("r"), F.sum("f").alias("n1"), F.sum(F.col("n") - f).alias("n2"), F.sum(n * (n * n - 1)).alias("t"))
    n1, n2, n = F.col("n1"), F.col("n2"), F.col("n1") + F.col("n2")
    a = a.withColumn("u", F.col("r") - n1 * (n1 + 1) / 2)
    a = a.withColumn("_d", F.sqrt(n1 * n2 / 12.0 * (n + 1 - F.col("t") / (n * (n - 1.0)))))
    mean = n1 * n2 / 2.0
    a = a.withColumn("z", (F.col("u") - mean) / F.col("_d"))
    p = F.least(F.lit(1.0), 2 * normal_tail((F.abs(F.col("u") - mean) - 0.5) / F.col("_d")))
    return a.select(*by, "n1", "n2", "u", "z", p.alias("p"), normal_tail(-(F.col("u") - mean + 0.5) / F.col("_d")).alias("p_less"))


def wilcoxon(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Signed ranks of x - y without zeros: w (the smaller sum), n, z and two-sided p by normal approximation with tie correction."""
    by = by or []
    d = df.select(*by, (F.col(x) - F.col(y)).alias("_d")).where("_d <> 0").withColumn("_a", F.abs("_d"))
    values = ranks.running(d, "_a", by, {"n": F.count("*"), "up": F.count_if(F.col("_d") > 0)})
    n, rank = F.col("n").cast("double"), F.col("n_before") + (F.col("n") + 1) / 2
    a = values.groupBy(*by).agg(F.sum(F.col("up") * rank).alias("up"), F.sum((F.col("n") - F.col("up")) * rank).alias("down"), F.sum("n").alias("n"), F.sum(n * (n * n - 1)).alias("t"))
    n = F.col("n")
    a = a.withColumn("w", F.least("up", "down")).withColumn("z", (F.col("w") - n * (n + 1) / 4.0) / F.sqrt((n * (n + 1.0) * (2 * n + 1) - F.col("t") / 2.0) / 24))
    return a.select(*by, "n", "w", "z", F.least(F.lit(1.0), 2 * normal_tail(-F.col("z"))).alias("p"))


def kolmogorov_smirnov(df: DataFrame, value: str, group: str, first, second, by: list[str] | None = None) -> DataFrame:
    """The largest distance of the two groups' distribution functions, with n1, n2 and the asymptotic p."""
    by = by or []
    values = ranks.running(df.where(F.col(group).isin(first, second)), value, by, {"a": F.count_if(F.col(group) == first), "b": F.count_if(F.col(group) == second)})
    gap = F.abs((F.col("a") + F.col("a_before")) / F.col("a_total") - (F.col("b") + F.col("b_before")) / F.col("b_total"))
    out = values.groupBy(*by).agg(F.max(gap).alias("d"), F.max("a_total").alias("n1"), F.max("b_total").alias("n2"))
    x = F.col("d") * F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")).cast("double"))
    p = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + 2 * F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * x * x))
    return out.select(*by, "d", "n1", "n2", F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)).alias("p"))


def _drawn(r: np.random.Generator, colours: np.ndarray, k: np.ndarray) -> Iterator[np.ndarray]:
    """Colour by colour how many are among k drawn without replacement, for each k. Numbers beyond what numpy draws exactly, a thousand million, come from the normal
    distribution of the same mean and variance, whose error is below their own spread by a factor of thousands."""
    left, k = int(colours.sum()), k.astype(np.int64)
    for c in colours.tolist():
        if left < 10**9:
            n = r.hypergeometric(c, left - c, k)
        else:
            share = c / left
            n = np.rint(r.normal(k * share, np.sqrt(k * share * (1 - share) * (left - k) / (left - 1))))
            n = np.clip(n, np.maximum(0, k - (left - c)), np.minimum(c, k)).astype(np.int64)
        yield n
        left, k = left - c, k - n


def permutation_test(df: DataFrame, value: str, group: str, first, second, by: list[str], rounds: int = 1000, seed: int = 0, parts: int = 64) -> DataFrame:
    """difference of means, and the share of `rounds` seeded shufflings with one as large or larger.

    Rows are summed up by value and values dealt to `parts` by hash. What a shuffling gives the first group is drawn in two steps, which together are a draw without replacement from all rows: how
    many rows of each part, then which values within it. So no task holds a group, and only counts of parts are exchanged.
    """
    rows = df.where(F.col(group).isin(first, second) & F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), (F.col(group) == first).alias("_f"))
    values = rows.groupBy(*by, "_v").agg(F.count("*").alias("_c"), F.count_if("_f").alias("_a")).withColumn("_p", F.pmod(F.xxhash64("_v"), F.lit(parts)).cast("int"))
    sizes = values.groupBy(*by, "_p").agg(F.sum("_c").alias("_s"), F.sum("_a").alias("_t")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_p", "_s"))).alias("_sizes"), F.sum("_t").alias("_n1"))
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)

    def draw(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("_v")
        dealt, n1, own = [(s["_p"], int(s["_s"])) for s in f["_sizes"].iloc[0]], int(f["_n1"].iloc[0]), int(f["_p"].iloc[0])
        at = [p for p, _ in dealt].index(own)
        r = np.random.default_rng([seed, 0])
        total = sum(s for _, s in dealt)
        mine = next(itertools.islice(_drawn(r, np.array([s for _, s in dealt]), np.full(rounds, n1)), at, None)) if 0 < n1 < total else np.zeros(rounds, np.int64)
        r, v, c = np.random.default_rng([seed, 1, own]), f["_v"].to_numpy(float), f["_c"].to_numpy(np.int64)
        sums = sum((n * x for n, x in zip(_drawn(r, c, mine), v)), np.zeros(rounds))
        return pd.DataFrame({**{c: f[c].iloc[0] for c in by}, "_round": np.arange(rounds), "_x": sums})

    drawn = ranks.beside(values, sizes, by).groupBy(*by, "_p").applyInPandas(draw, kinds + "_round int, _x double").groupBy(*by, "_round").agg(F.sum("_x").alias("_x"))
    v, a, b = F.col("_v"), F.col("_a"), F.col("_c") - F.col("_a")
    seen = values.groupBy(*by).agg(F.sum(v * a).alias("_sa"), F.sum(v * b).alias("_sb"), F.sum(a).alias("_na"), F.sum(b).alias("_nb"))
    both = ranks.beside(drawn, seen, by)
    difference = F.try_divide("_sa", "_na") - F.try_divide("_sb", "_nb")
    shuffled = F.try_divide("_x", "_na") - F.try_divide(F.col("_sa") + F.col("_sb") - F.col("_x"), "_nb")
    out = both.groupBy(*by).agg(F.first(difference).alias("difference"), F.count_if(shuffled >= difference - 1e-12).alias("_hits"))
    return out.select(*by, F.coalesce("difference", F.lit(float("nan"))).alias("difference"), ((F.col("_hits") + 1) / (rounds + 1)).alias("p"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2 and degrees of freedom of the contingency table of two columns. Over the observed cells only, as the sum over all is n * (sum of o² / (r * c) - 1)."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("o"))
    rows, columns = cells.groupBy(a).agg(F.sum("o").alias("r")), cells.groupBy(b).agg(F.sum("o").alias("c"))
    o = F.col("o").cast("double")
    share = cells.join(rows, a).join(columns, b).agg(F.sum(o * o / (F.col("r") * F.col("c").cast("double"))).alias("s"), F.sum("o").alias("n"), F.count_distinct(a).alias("_a"), F.count_distinct(b).alias("_b"))
    return share.select((F.col("n") * (F.col("s") - 1)).alias("chi2"), ((F.col("_a") - 1) * (F.col("_b") - 1)).alias("dof"))


def proportions_chi_square(df: DataFrame, successes: str, trials: str) -> DataFrame:
    """chi2 and degrees of freedom for equal shares over the rows."""
    share = df.agg((F.sum(successes) / F.sum(trials)).alias("_p"), F.count("*").alias("_k"))
    d = F.col(successes) - F.col(trials) * F.col("_p")
    return df.join(F.broadcast(share)).agg(F.sum(d * d / (F.col(trials) * F.col("_p") * (1 - F.col("_p")))).alias("chi2"), (F.max("_k") - 1).alias("dof"))


def percentile_of(df: DataFrame, column: str, score: Column) -> Column:
    """Percentage of the values below the score, equal ones counted half, as an aggregate."""
    c = F.col(column)
    return 100.0 * (F.count_if(c < score) + F.count_if(c <= score)) / (2.0 * F.count(c))


def quantile_grid(df: DataFrame, column: str, n: int) -> DataFrame:
    """(q, value) for n + 1 quantiles from 0 to 1."""
    qs = [i / n for i in range(n + 1)]
    got = ranks.quantiles(df, column, qs, target="v")
    return got.select(F.posexplode("v").alias("i", "value")).select((F.col("i") / n).alias("q"), "value")


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """(value, share at or below it), a row for each distinct value."""
    return ranks.running(df, column).select(F.col(column).alias("value"), ((F.col("n") + F.col("n_before")) / F.col("n_total")).alias("share"))


def qq(a: DataFrame, b: DataFrame, column: str, n: int) -> DataFrame:
    return quantile_grid(a, column, n).withColumnRenamed("value", "a").join(quantile_grid(b, column, n).withColumnRenamed("value", "b"), "q")


def positive_hmean(columns: list[Column]) -> Column:
    """Harmonic mean of values held at 0 from below; 0 if one is 0."""
    low = [F.greatest(c, F.lit(0.0)) for c in columns]
    total = low[0] * 0
    for c in low:
        total = total + 1 / F.nullif(c, F.lit(0.0))
    return F.coalesce(len(low) / total, F.lit(0.0))


def group_differences(df: DataFrame, by: list[str], mark: Column, metrics: list[str]) -> DataFrame:
    """Of each metric the mean of the marked rows, of all, their difference and it in percent of all, by group: worst queries against the rest."""
    cols = []
    for m in metrics:
        some, every = F.avg(F.when(mark, F.col(m))), F.avg(m)
        cols += [some.alias(f"{m}_marked"), every.alias(f"{m}_all"), (some - every).alias(f"{m}_diff"), (100 * (some - every) / every).alias(f"{m}_percent")]
    return df.groupBy(*by).agg(*cols)


def compare_describes(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(statistic, a, b, difference, relative) of two tables' describe(); relative to the first."""
    from tesserae.operators.relational import describe

    names = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    x, y = (describe(d, column).select(*(F.col(n).cast("double").alias(n) for n in names)).unpivot([], names, "statistic", v) for d, v in ((a, "a"), (b, "b")))
    return x.join(y, "statistic").select("statistic", "a", "b", (F.col("a") - F.col("b")).alias("difference"), F.try_divide(F.col("a") - F.col("b"), F.col("a")).alias("relative"))


def token_price(df: DataFrame, text: str, price: float, tokens=None) -> DataFrame:
    """rows, mean number of tokens (words, unless told otherwise), and the price of all."""
    from tesserae.functions.text import word_count

    n = (tokens or word_count)(F.col(text))
    return df.agg(F.count("*").alias("rows"), F.avg(n).alias("mean_tokens"), (F.sum(n) * price).alias("price"))


def _features(df: DataFrame, features: list[str], label: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.select("*", array_to_vector(F.array(*(F.col(f).cast("double") for f in features))).alias("_x"), F.col(label).cast("double").alias("_y")).na.drop(subset=[*features, label])


def logistic_regression(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, coefficient), the constant as `intercept`."""
    from pyspark.ml.classification import LogisticRegression

    m = LogisticRegression(featuresCol="_x", labelCol="_y").fit(_features(df, features, label))
    return df.sparkSession.createDataFrame([*zip(features, m.coefficients.toArray().tolist()), ("intercept", float(m.intercept))], "feature string, coefficient double")


def random_forest(df: DataFrame, features: list[str], label: str, trees: int = 10, depth: int = 10, seed: int = 0) -> DataFrame:
    """df with probability, that of label 1 by a random forest fitted on it."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    rows = _features(df, features, label)
    m = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)
    return m.transform(rows).select(*df.columns, vector_to_array("probability")[1].alias("probability"))


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, fpr, tpr): shares of the rows with label 0 and 1 that score the threshold or more, for each distinct score."""
    rows = df.select(F.col(score).alias("threshold"), (F.col(label) == 1).alias("_y"))
    v = ranks.running(rows, "threshold", measures={"p": F.count_if("_y"), "n": F.count_if(~F.col("_y"))})
    return v.select("threshold", *(F.try_divide(F.col(f"{c}_total") - F.col(f"{c}_before"), F.col(f"{c}_total")).alias(name) for c, name in (("n", "fpr"), ("p", "tpr"))))


def roc_area(df: DataFrame, score: str, label: str) -> DataFrame:
    """auc: the chance that a row of label 1 scores more than one of label 0, ties counted half."""
    rows = df.select(F.col(score).alias("_s"), (F.col(label) == 1).alias("_y"))
    v = ranks.running(rows, "_s", measures={"p": F.count_if("_y"), "n": F.count_if(~F.col("_y"))})
    won = F.sum(F.col("p").cast("double") * (F.col("n_before") + F.col("n") / 2))
    return v.agg(F.try_divide(won, F.sum("p").cast("double") * F.sum("n")).alias("auc"))
