"""Filters, joins, aggregates, rankings and set operations of the repository pipeline, as DataFrame to DataFrame functions.

Where input order matters it is a column (`order`), and ties are broken by it, so that results don't depend on partitioning.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators import ranks
from tesserae.plans.durable import materialize

#: Rows of a table that is sent to every task, at most; rows of a task where tables are dealt by their size.
FEW_ROWS, TASK_ROWS = 1 << 20, 1 << 19
#: Pairs that a task of co_occurring_pairs meets, about.
MET_ROWS = 1 << 22


def few(df: DataFrame, tag: str = "few") -> DataFrame:
    """df made durable, to be sent to every task where it has FEW_ROWS rows or less: the other side of a join then stays where it lies."""
    df = materialize(df, tag)
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by hashes of the keys in as many parts as its rows (about so many) need, so that a part doesn't grow with the table."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)), *keys)


# filters


def without_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose column doesn't begin with the prefix; null goes."""
    return df.where(~F.col(column).startswith(prefix))


def with_list_size(df: DataFrame, column: str, least: int = 0, most: int | None = None) -> DataFrame:
    size = F.size(F.col(column))
    return df.where(F.col(column).isNotNull() & (size >= least) & (F.lit(True) if most is None else size <= most))


def with_member(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.array_contains(column, value))


def with_any(df: DataFrame, column: str, allowed: DataFrame, key: str, id_column: str) -> DataFrame:
    """Rows whose list holds a value of allowed[key]. id_column tells the rows apart."""
    hit = df.select(id_column, F.explode(column).alias("_v")).join(allowed.select(F.col(key).alias("_v")), "_v", "left_semi").select(id_column).distinct()
    return df.join(hit, id_column, "left_semi")


def keep_members(df: DataFrame, column: str, allowed: DataFrame, key: str, id_column: str, target: str | None = None, drop_empty: bool = False) -> DataFrame:
    """The lists without values that aren't in allowed[key]; order and repeats stay."""
    items = df.select(id_column, F.posexplode(column).alias("_p", "_v")).join(few(allowed.select(F.col(key).alias("_v")).distinct()), "_v", "left_semi")
    kept = items.groupBy(id_column).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_v"))), lambda s: s["_v"]).alias("_kept"))
    out = df.join(kept, id_column, "left").withColumn(target or column, F.coalesce("_kept", F.array().cast(df.schema[column].dataType))).drop("_kept")
    return with_list_size(out, target or column, 1) if drop_empty else out


def forward_fill(df: DataFrame, column: str, order: str, by: list[str] | None = None) -> DataFrame:
    """Nulls replaced by the last value before in the order. Without `by`, ranges of the order are filled each by itself, and what they begin with comes from the last value of those before, so that no task has all rows."""
    if by:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(column, F.last(column, ignorenulls=True).over(w))
    parts = max(2, min(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    bounds = df.agg(F.percentile_approx(F.col(order).cast("double"), [i / parts for i in range(1, parts)], 100 * parts).alias("_bounds"))
    placed = df.join(F.broadcast(bounds)).withColumn("_range", F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col(order).cast("double"))), F.lit(0))).drop("_bounds")
    ends = placed.groupBy("_range").agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias("_end"))
    before = ends.select("_range", F.last("_end", ignorenulls=True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = F.last(column, ignorenulls=True).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn(column, own).join(F.broadcast(before), "_range").withColumn(column, F.coalesce(column, "_before")).select(*df.columns)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def drop_vectors(df: DataFrame) -> DataFrame:
    return df.drop(*[f.name for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType)])


def clip_infinite(df: DataFrame, column: str) -> DataFrame:
    """Infinity replaced by the largest finite value."""
    c = F.col(column)
    top = df.where(c < float("inf")).agg(F.max(c).alias("_top"))
    # one row
    return df.join(F.broadcast(top)).withColumn(column, F.when(c == float("inf"), F.col("_top")).otherwise(c)).drop("_top")


def every_nth(df: DataFrame, order: Column, n: int, most: int, by: list[str]) -> DataFrame:
    """Rows 1, n + 1, 2n + 1 … of each group, `most` of them."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w) - 1).where((F.col("_r") % n == 0) & (F.col("_r") < n * most)).drop("_r")


# joins


def join_suffixed(left: DataFrame, right: DataFrame, on: str, suffix: str, how: str = "inner") -> DataFrame:
    """Join; the right side's columns that clash get the suffix, others keep their names."""
    clash = {c: c + suffix for c in right.columns if c in left.columns and c != on}
    return left.join(right.withColumnsRenamed(clash), on, how)


def filter_in(tables: list[DataFrame], column: str, keys: DataFrame) -> list[DataFrame]:
    """Semi-join of each table with the keys."""
    keys = keys.select(column).distinct()
    return [t.join(keys, column, "left_semi") for t in tables]


def common_keys(tables: list[DataFrame], column: str) -> DataFrame:
    return functools.reduce(lambda a, b: a.join(b, column, "left_semi"), [t.select(column).where(F.col(column).isNotNull()).distinct() for t in tables])


def co_occurring_pairs(df: DataFrame, key: str, items: str, block: int = 256) -> DataFrame:
    """(a, b), a < b, of keys whose lists share an item: each unordered pair once.

    The keys of an item are dealt to blocks of about `block`, and each pair of blocks is a unit of work of its own, so that a hot item is spread over many tasks; its pairs, which are the
    result, stay the square of its keys. Units are dealt to so many tasks that each meets about MET_ROWS pairs.
    """
    lists = materialize(df.select(F.col(key).alias("a"), F.col(items).alias("_l")), "lists")
    rows, n = lists.agg(F.sum(F.greatest(F.size("_l"), F.lit(0)))).first()[0] or 0, F.count("*")
    long = dealt(materialize(dealt(lists.select("a", F.explode("_l").alias("_i")), rows, "a", "_i").distinct(), "items"), rows, "_i")
    size = long.groupBy("_i").agg(F.ceil(n / block).cast("int").alias("_k"), n.alias("_n")).where("_n > 1")
    met = size.agg(F.sum(F.col("_n") * F.col("_n") / 2)).first()[0] or 0
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(met / MET_ROWS))
    placed = long.join(size.drop("_n"), "_i").withColumn("_b", F.pmod(F.xxhash64("a"), F.col("_k")).cast("int"))
    cell = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda o: F.struct(F.least("_b", o).alias("x"), F.greatest("_b", o).alias("y")))
    on = ["_i", "_x", "_y"]
    one = placed.select("a", "_i", "_b", F.inline(cell).alias("_x", "_y")).repartition(parts, *on)
    other = one.select(F.col("a").alias("b"), "_i", F.col("_b").alias("_c"), "_x", "_y")
    # within a cell of two blocks only pairs across them: those within a block have a cell of their own
    pairs = one.join(other, on).where("a < b and (_x = _y or _b <> _c)")
    return pairs.select("a", "b").distinct()


def stack_relations(df: DataFrame, id_column: str, relation: str, values: list[str], relations: list[str] | None = None) -> DataFrame:
    """A row for each id with value_relation columns, of ids that have every relation; an id with several rows of a relation gives each combination."""
    relations = relations or [r[0] for r in df.select(relation).distinct().orderBy(relation).collect()]
    parts = [df.where(F.col(relation) == r).select(id_column, *(F.col(v).alias(f"{v}_{r}") for v in values)) for r in relations]
    return functools.reduce(lambda a, b: a.join(b, id_column), parts)


def align(df: DataFrame, key: str, order: DataFrame) -> DataFrame:
    """df in the order of `order` (key, ord); raises KeyError if a key of it has no row."""
    missing = order.join(df, key, "left_anti").select(key).limit(5).collect()
    if missing:
        raise KeyError(f"no rows for {[r[0] for r in missing]}")
    return order.join(df, key).orderBy("ord")


def papers_with_repos(papers: DataFrame, links: DataFrame, key: str = "paper_url") -> DataFrame:
    """Links with the columns of their paper that they don't have."""
    own = [key, *[c for c in papers.columns if c not in links.columns]]
    return links.join(papers.select(*own), key)


def enrich(df: DataFrame, lookup: DataFrame, key: str, added: list[str]) -> DataFrame:
    return df.join(lookup.select(key, *added), key).select(*df.columns, *added)


def repo_dimension(repos: DataFrame, areas: DataFrame) -> DataFrame:
    """(repo, task, area) of repos (repo, tasks), by each's first task that has an area; the first area in order wins."""
    first = areas.groupBy("task").agg(F.min("area").alias("area"))
    long = repos.select("repo", F.posexplode("tasks").alias("pos", "task")).join(first, "task")
    w = Window.partitionBy("repo").orderBy("pos")
    return long.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("repo", "task", "area")


def star(tables: list[DataFrame], key: str) -> DataFrame:
    """Inner joins of all on the key."""
    return functools.reduce(lambda a, b: a.join(b, key), tables)


# aggregates


def value_counts(df: DataFrame, items: str, name: str = "task", count: str = "count") -> DataFrame:
    """(item, count) of the values of a list column without null."""
    return df.select(F.explode(items).alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias(count))


def frequent_values(df: DataFrame, items: str, least: int, strict: bool = False, name: str = "task") -> DataFrame:
    c = F.col("count")
    return value_counts(df, items, name).where(c > least if strict else c >= least)


def top_values(df: DataFrame, items: str, n: int, name: str = "task") -> DataFrame:
    return value_counts(df, items, name).orderBy(F.desc("count"), name).limit(n)


def group_text(df: DataFrame, by: list[str], text: str, order: list[str], separator: str, target: str | None = None) -> DataFrame:
    """Texts of a group joined in order; null counts as empty."""
    item = F.struct(*(F.col(o).alias(f"o{i}") for i, o in enumerate(order)), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return df.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["t"]), separator).alias(target or text))


def group_union(df: DataFrame, by: list[str], items: str, target: str | None = None) -> DataFrame:
    """The distinct values of a group's lists, sorted."""
    return df.groupBy(*by).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(items)))).alias(target or items))


def group_map(df: DataFrame, by: list[str], key: str, value: str, order: str, target: str = "map") -> DataFrame:
    """key -> list of values, by group, lists in order."""
    lists = df.groupBy(*by, key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("_l"))
    return lists.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(key, "_l"))).alias(target))


def plural(column: str) -> str:
    return (column + "s").replace("ss", "s")


def merge_metadata(df: DataFrame, key: str, order: str, listed: list[str], united: str) -> DataFrame:
    """A row for each key: lists of the columns' values in order, nulls kept, under their plural; and the union of the `united` lists."""

    def values(c: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda s: s[c]).alias(plural(c))

    lists = [values(c) for c in listed]
    return df.groupBy(key).agg(*lists, F.array_sort(F.array_distinct(F.flatten(F.collect_list(united)))).alias(united))


def first_of_group(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group by the order, which should leave no ties."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def describe(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles (exact, interpolated) and max."""
    by, c = by or [], F.col(column)
    sums = df.groupBy(*by).agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    q = ranks.quantiles(df, column, [0.25, 0.5, 0.75], by, "_q")
    # without groups one row on either side
    out = ranks.beside(sums, q, by, "left") if by else sums.join(F.broadcast(q), how="left")
    return out.select(*by, "count", "mean", "std", "min", *(F.col("_q")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75))), "max")


def unique_in_order(df: DataFrame, column: str, order: str) -> DataFrame:
    return df.groupBy(column).agg(F.min(order).alias("ord")).orderBy("ord")


def cumulative_share(counts: DataFrame, name: str, count: str = "count") -> DataFrame:
    """counts with the share of all that it and the more frequent ones have. A row for each value: one task orders them."""
    w = Window.orderBy(F.desc(count), name)
    total = F.sum(count).over(Window.partitionBy())
    return counts.withColumn("share", F.sum(count).over(w.rowsBetween(Window.unboundedPreceding, 0)) / total)


def crosstab(df: DataFrame, rows: str, columns: str, values: list) -> DataFrame:
    return df.groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1))).na.fill(0)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, degree) over rows of source, target."""
    ends = edges.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count("*").alias("degree"))


def descriptions(edges: DataFrame, most: int | None = 1000) -> DataFrame:
    """(source, description): the distinct ones of at most `most` targets, chosen by digest, joined in order; None: of all targets."""
    some = edges.select("source", "target")
    if most is not None:
        w = Window.partitionBy("source").orderBy(F.md5("target"), "target")
        some = some.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return some.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("target")), " ").alias("description"))


def integer_ids(df: DataFrame, column: str) -> DataFrame:
    """(column, id) with dense numbers from 0 in order. Ranges are numbered apart and offset, so no task sees all values."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    dealt = values.withColumn("_b", F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 3), 16, 10).cast("int"))
    sizes = dealt.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy(column)) - 1
    return dealt.withColumn("_r", own).join(before, "_b").select(column, (F.col("_r") + F.col("_o")).alias("id"))


def recode(edges: DataFrame) -> DataFrame:
    """Edges by integer ids of their nodes."""
    nodes = edges.select(F.col("source").alias("node")).union(edges.select(F.col("target").alias("node")))
    ids = integer_ids(nodes, "node")
    s, t = (ids.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id")) for c in ("source", "target"))
    return edges.join(s, "source").join(t, "target").select("source_id", "target_id").distinct()


# rankings


def head(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each group; rank: a column for their place from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn(rank or "_r", F.row_number().over(w)).where(F.col(rank or "_r") <= n)
    return out if rank else out.drop("_r")


def first_hit(ranked: Column, wanted: Column) -> Column:
    """Place from 0 of the first wanted element in a ranked list, -1 without one."""
    at = F.transform(wanted, lambda x: F.nullif(F.array_position(ranked, x), F.lit(0)))
    return F.coalesce(F.array_min(at) - 1, F.lit(-1))


def quantile_split(df: DataFrame, column: str, q: float, side: str = "low", strict: bool = False) -> DataFrame:
    """Rows up to (low) or beyond (high) the interpolated quantile: low is <= (strict: <), high is > (strict=False: >=)."""
    edge = ranks.quantiles(df, column, [q], target="_q")
    c, e = F.col(column), F.col("_q")[0]
    test = (c < e if strict else c <= e) if side == "low" else (c > e if strict else c >= e)
    return df.join(F.broadcast(edge)).where(test).drop("_q")


def quantile_bins(df: DataFrame, column: str, bins: int = 10, target: str = "bin") -> DataFrame:
    """Bins between interpolated quantiles, the upper edge inside: ties share a bin."""
    edges = ranks.quantiles(df, column, [i / bins for i in range(1, bins)], target="_e")
    at = F.size(F.filter(F.col("_e"), lambda e: e < F.col(column)))
    return df.join(F.broadcast(edges)).withColumn(target, at).drop("_e")


def mean_in_order(df: DataFrame, by: list[str], column: str, order: list[str], mean: str = "mean", rows: str = "n") -> DataFrame:
    """The mean of each group's values and its number of rows. Values are added one by one in this order, so that the last bit, by which a mean between two rounded ones goes up or down, doesn't depend on partitioning."""
    upto = Window.partitionBy(*by).orderBy(*order, column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = df.select(*by, column, F.sum(column).over(upto).alias("_sum"), F.count("*").over(upto).alias("_at"))
    return sums.groupBy(*by).agg((F.max_by("_sum", "_at") / F.count(column)).alias(mean), F.count("*").alias(rows))


def borda(df: DataFrame, metrics: list[str], target: str = "borda") -> DataFrame:
    """Sum over the metrics of how many rows are worse, ties counted half; null is worse than any value."""
    for i, m in enumerate(metrics):
        df = ranks.with_rank(df, m, f"_rank{i}", nulls=True)
    score = sum((F.col(f"_rank{i}") - 1 for i in range(len(metrics))), F.lit(0.0))
    return df.withColumn(target, score).drop(*(f"_rank{i}" for i in range(len(metrics))))


# sets


def union_all(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def except_keys(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_anti")


def side_by_side(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "full_outer")


def merge_scores(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sums of two result tables' scores, a missing one as 0."""
    return a.unionByName(b).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def columns_without(df: DataFrame, other: DataFrame) -> DataFrame:
    """df without the columns that `other` has too."""
    return df.select(*(c for c in df.columns if c not in other.columns))


def by_position(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Columns side by side: the i-th row of one by its order beside the i-th of the other; position from 0. Orders are unique; rows without a partner are left out."""
    a = left.join(integer_ranks(left, left_order), left_order)
    b = right.join(integer_ranks(right, right_order), right_order)
    return join_suffixed(a, b, "position", "_right")


def integer_ranks(df: DataFrame, order: str) -> DataFrame:
    """(order, position): place of each distinct value from 0."""
    return ranks.running(df, order, measures={"n": F.lit(1) * F.count_distinct(order)}).select(order, F.col("n_before").alias("position"))


def per_key(left: DataFrame, right: DataFrame, key: str, test: Callable, schema: str) -> DataFrame:
    """test(left rows, right rows) of each key as pandas frames, for tests that SQL has no form for."""
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(test, schema)
