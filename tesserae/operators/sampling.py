"""Samples and splits that depend on the rows alone: order comes from digests of keys."""

from __future__ import annotations

import functools
import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import clean_task_name
from tesserae.functions.udf import vectorized
from tesserae.operators import relational as R
from tesserae.plans.durable import materialize, steps


@vectorized("string")
def shake(values: pd.Series) -> pd.Series:
    """16 bytes of SHAKE-256, in hexadecimal: Spark has no such digest of its own."""
    return values.map(lambda s: None if s is None else hashlib.shake_256(s.encode()).hexdigest(16))


def deterministic_sample(df: DataFrame, column: str, n: int, digest=shake) -> DataFrame:
    """The n values (all, if fewer) first by digest. digest: Column -> Column."""
    return df.withColumn("_h", digest(F.col(column))).orderBy("_h", column).limit(n).drop("_h")


def sample_per_group(df: DataFrame, by: str, column: str, n: int, digest=shake) -> DataFrame:
    w = Window.partitionBy(by).orderBy("_h", column)
    return df.withColumn("_h", digest(F.col(column))).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_h", "_r")


def sample_tasks(repos: DataFrame, n: int, least: int, most: int, digest=shake) -> DataFrame:
    """n tasks, by digest, of those with a count between least and most."""
    return deterministic_sample(R.value_counts(repos, "tasks").where(F.col("count").between(least, most)), "task", n, digest)


def sample_repos(repos: DataFrame, tasks: DataFrame, per_task: int, least_tasks: int = 1, digest=shake) -> DataFrame:
    """Rows of the repos that are, for some of the `tasks`, among the per_task first by digest of the repos that have it and whose own list holds least_tasks or more; of fewer repos all are taken."""
    usable = R.with_list_size(repos, "tasks", least_tasks)
    long = usable.select("repo", F.explode("tasks").alias("task")).distinct().join(tasks.select("task").distinct(), "task", "left_semi")
    chosen = sample_per_group(long, "task", "repo", per_task, digest)
    return repos.join(chosen.select("repo").distinct(), "repo", "left_semi")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows drawn by a seeded digest of the key."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


#: Candidates of a task that a round of the greedy sample brings to its loop, in times of those that it needs.
SPARE = 32


def greedy_sample(repos: DataFrame, least_repos: int, per_task: int, most_per_task: int) -> DataFrame:
    """(task, repo, position) taken task by task from the rarest (ties by name).

    A repo is a candidate of a task if none of its tasks has been given more than most_per_task times; a task with least_repos candidates or more gets the
    first per_task of them (by repo), and all their tasks count once more. A task's choice depends on the ones before it, so one task runs the loop. It gets only the first
    candidates of each task, SPARE times as many as are needed. Candidates only become fewer, so what it chooses from these is right as long as enough of them are left; where not, the loop stops before
    that task, repos of tasks that have been given too often go, and the next round begins with it. The counts, a number for each task given, pass from round to round.
    """
    with steps(repos.sparkSession) as step:
        rows = repos.select("repo", F.array_sort(F.array_distinct("tasks")).alias("tasks")).withColumn("_row", F.monotonically_increasing_id())
        counts = R.value_counts(rows, "tasks").withColumn("_i", F.row_number().over(Window.orderBy("count", "task")) - 1)  # a row for each distinct task
        counts = step(counts, "counts")
        # tasks by their numbers in the order of the loop; null, which is nobody's turn but counts like a task, is -1
        numbers = R.few(counts.select("task", "_i"), "numbers")
        long = rows.select("repo", "_row", F.explode("tasks").alias("task")).join(numbers, "task", "left")
        left = step(long.groupBy("repo", "_row").agg(F.array_sort(F.collect_list(F.coalesce("_i", F.lit(-1)))).alias("ids")).drop("_row"), "left")
        first = counts.where(F.col("count") >= least_repos).agg(F.min("_i")).first()[0]
        need, given, parts = max(per_task, least_repos), {}, []
        kind = repos.schema["repo"].dataType.simpleString()
        while first is not None:
            turn = left.select("repo", "ids", F.explode("ids").alias("i")).where(F.col("i") >= first)
            order = Window.partitionBy("i").orderBy("repo", "ids")
            some = turn.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= SPARE * need + 1)
            some = some.repartition(1).sortWithinPartitions("i", "repo", "ids").select("i", "repo", "ids")
            chosen = step(some.mapInPandas(_loop(dict(given), least_repos, per_task, most_per_task, need, SPARE * need), f"i int, repo {kind}, position int, ids array<int>, stop int"), "chosen")
            parts.append(materialize(chosen.where("stop IS NULL").join(counts.select(F.col("_i").alias("i"), "task"), "i").select("task", "repo", "position"), "sampled"))
            before = {i for i, n in given.items() if n > most_per_task}
            for r in chosen.select(F.explode("ids").alias("i")).groupBy("i").count().collect():
                given[r.i] = given.get(r.i, 0) + r["count"]
            full = [i for i, n in given.items() if n > most_per_task and i not in before]
            first = chosen.agg(F.max("stop")).first()[0]
            if full and first is not None:
                left = step(left.where(~F.exists("ids", lambda x: x.isin(full))), "left")
    return functools.reduce(DataFrame.unionAll, parts) if parts else repos.select(F.lit("").alias("task"), "repo", F.lit(0).alias("position")).limit(0)


def _loop(given: dict[int, int], least: int, per: int, most: int, need: int, brought: int):
    """Of candidates by task and repo the chosen ones, until a task of which more than `brought` came hasn't enough left: then a row with its number as `stop`."""

    def loop(frames):
        task, seen, found, stopped = None, 0, [], False

        def close():
            nonlocal stopped
            if task is None or stopped:
                return
            if len(found) < need and seen > brought:
                stopped = True
                yield None, None, None, None, task
            elif len(found) >= least:
                for i, (repo, ids) in enumerate(found[:per]):
                    for t in ids:
                        given[t] = given.get(t, 0) + 1
                    yield task, repo, i, ids, None

        columns = ["i", "repo", "position", "ids", "stop"]
        for frame in frames:
            out = []
            for t, repo, ids in zip(frame["i"], frame["repo"], frame["ids"]):
                if stopped:
                    break
                if t != task:
                    out += close()
                    task, seen, found = t, 0, []
                seen += 1
                if seen <= brought and len(found) < need and all(given.get(x, 0) <= most for x in ids):
                    found.append((repo, list(ids)))
            yield pd.DataFrame(out, columns=columns).astype({"i": "Int32", "position": "Int32", "stop": "Int32"})
        yield pd.DataFrame(list(close()), columns=columns).astype({"i": "Int32", "position": "Int32", "stop": "Int32"})

    return loop


def add_valid_tasks(sampled: DataFrame, repos: DataFrame, least: int) -> DataFrame:
    """The sampled tasks, and those that the sampled repos have `least` times or more."""
    own = repos.join(sampled.select("repo").distinct(), "repo", "left_semi")
    more = R.value_counts(own, "tasks").where(F.col("count") >= least).select("task")
    return sampled.select("task").distinct().union(more).distinct()


def with_query_tasks(repos: DataFrame, sampled: DataFrame, tasks: DataFrame) -> DataFrame:
    """Rows of the sampled repos with query_tasks: their tasks that are among `tasks`, in their order."""
    own = repos.join(sampled.select("repo").distinct(), "repo", "left_semi")
    return R.keep_members(own, "tasks", tasks, "task", "repo", target="query_tasks")


def random_hit_probability(total: Column, relevant: Column, k: int = 10) -> Column:
    """Chance that k of `total` documents drawn without replacement have a relevant one."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda p, i: p * (total - relevant - i) / (total - i))
    return F.when(total - relevant < k, F.lit(1.0)).otherwise(1 - miss)


def without_easy_tasks(counts: DataFrame, total: Column, most: float, k: int = 10) -> DataFrame:
    """Tasks (task, count) that random retrieval meets with less than that chance."""
    return counts.withColumn("random_score", random_hit_probability(total, F.col("count"), k)).where(F.col("random_score") < most)


def sample_pipeline(repos: DataFrame, code: DataFrame, most_tasks: int = 10, least_repos: int = 10, per_task: int = 10, most_per_task: int = 20, most_random: float = 0.3) -> DataFrame:
    """Repos with code and few enough tasks, sampled greedily, with their query tasks: all steps in order."""
    # every step below begins with these rows
    usable = materialize(R.with_list_size(repos, "tasks", 0, most_tasks).join(code.select("repo").distinct(), "repo", "left_semi"), "usable")
    sampled = greedy_sample(usable, least_repos, per_task, most_per_task)
    tasks = add_valid_tasks(sampled, usable, least_repos)
    chosen = usable.join(sampled.select("repo").distinct(), "repo", "left_semi")
    total = chosen.agg(F.count("*").alias("_total"))
    counts = R.value_counts(chosen, "tasks").join(tasks, "task", "left_semi").join(F.broadcast(total))
    kept = without_easy_tasks(counts, F.col("_total"), most_random).select("task")
    return R.with_list_size(with_query_tasks(usable, sampled, kept), "query_tasks", 1)


def stratified_split(df: DataFrame, strata: list[str], key: str, fraction: float, target: str = "test") -> DataFrame:
    """Marks the first part of each stratum by digest."""
    w = Window.partitionBy(*strata).orderBy(F.md5(F.col(key).cast("string")), key)
    n = F.count("*").over(Window.partitionBy(*strata))
    return df.withColumn(target, F.row_number().over(w) <= F.round(n * fraction))


def split_by_tasks(repos: DataFrame, test_tasks: DataFrame, target: str = "train") -> DataFrame:
    """train: none of the repo's tasks is a test task."""
    hit = repos.select("repo", F.explode("tasks").alias("task")).join(test_tasks.select("task"), "task", "left_semi").select("repo").distinct().withColumn("_hit", F.lit(True))
    return repos.join(hit, "repo", "left").withColumn(target, F.col("_hit").isNull()).drop("_hit")


def sample_queries(df: DataFrame, query: str, by: str, size: float) -> DataFrame:
    """A share of each group's queries, rounded up, ordered by first and last letter."""
    key = F.concat(F.substring(query, 2, 1), F.substring(query, -1, 1))
    w = Window.partitionBy(by).orderBy(key, query)
    n = F.count("*").over(Window.partitionBy(by))
    return df.withColumns({"_r": F.row_number().over(w), "_n": n}).where(F.col("_r") <= F.ceil(F.col("_n") * size)).drop("_r", "_n")


def _draw(seed: int, *columns: str) -> Column:
    """A number from 0 to 2 ** 32 - 1 by a seeded digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns))), 1, 8), 16, 10).cast("long")


def few_shot_context(repos: DataFrame, shots: int, seed: int = 0) -> DataFrame:
    """(repo, position, context): `shots` other repos for each, by numbers drawn from a seeded digest, without meeting all pairs."""
    ids = R.integer_ids(repos, "repo")
    n = ids.agg(F.count("*").alias("n"))
    # distinct places on the ring of the others: a start and a stride of one
    drawn = ids.join(F.broadcast(n)).select("repo", "id", "n", F.explode(F.sequence(F.lit(0), F.lit(shots - 1))).alias("position"), _draw(seed, "repo").alias("s")).where("position < n - 1")
    drawn = drawn.withColumn("at", F.pmod(F.col("id") + 1 + F.pmod(F.col("s") + F.col("position"), F.col("n") - 1), F.col("n")))
    return drawn.join(ids.select(F.col("id").alias("at"), F.col("repo").alias("context")), "at").select("repo", "position", "context")


def task_of_another_area(rows: DataFrame, areas: DataFrame, seed: int = 0) -> DataFrame:
    """rows (repo, task) with other_task, a task of an area that isn't the row's task's. One number is drawn for each row among the tasks outside."""
    # a row for each distinct task of an area
    numbered = areas.select("area", "task").distinct().withColumn("_i", F.row_number().over(Window.orderBy("area", "task")) - 1)
    span = numbered.groupBy("area").agg(F.min("_i").alias("_lo"), F.count("*").alias("_k"))
    total = numbered.agg(F.count("*").alias("_n"))
    own = areas.groupBy("task").agg(F.min("area").alias("area"))
    placed = rows.join(own, "task").join(span, "area").join(F.broadcast(total)).where("_n > _k")
    placed = placed.withColumn("_d", F.pmod(_draw(seed, "repo", "task"), F.col("_n") - F.col("_k")))
    placed = placed.withColumn("_i", F.when(F.col("_d") < F.col("_lo"), F.col("_d")).otherwise(F.col("_d") + F.col("_k")))
    return placed.join(numbered.select("_i", F.col("task").alias("other_task")), "_i").select("repo", "task", "other_task")


def biggest_tasks(papers: DataFrame, n: int) -> DataFrame:
    """Papers with one of the n most frequent tasks, and most_common_task: the list's element with the largest count, the first of equals."""
    counts = R.few(R.value_counts(papers, "tasks"), "counts")
    top = counts.orderBy(F.desc("count"), "task").limit(n)
    long = papers.select("paper", F.posexplode("tasks").alias("pos", "task")).join(counts, "task")
    most = R.first_of_group(long, ["paper"], [F.desc("count"), F.col("pos")]).select("paper", F.col("task").alias("most_common_task"))
    return R.with_any(papers, "tasks", top, "task", "paper").join(most, "paper")


def least_common_task(papers: DataFrame, least: int, compat: bool = True) -> DataFrame:
    """papers with least_common_task, of tasks counted more than `least` times; null without one. compat: the list's first such task, which is what the
    original gives, in place of the rarest."""
    counts = R.few(R.value_counts(papers, "tasks").where(F.col("count") > least), "counts")
    long = papers.select("paper", F.posexplode("tasks").alias("pos", "task")).join(counts, "task")
    order = [F.col("pos")] if compat else [F.col("count"), F.col("pos")]
    return papers.join(R.first_of_group(long, ["paper"], order).select("paper", F.col("task").alias("least_common_task")), "paper", "left")


def task_table(papers: DataFrame, links: DataFrame, least: int) -> DataFrame:
    """repo, tasks, least_common_task: tasks cleaned and counted, joined by title, a repo's paper with most tasks, then only tasks that are somebody's least.

    Names are cleaned once for each distinct task, papers are compared by the number of their tasks, and lists are made only for those that a repo has.
    """
    papers = materialize(papers.select("title", "tasks"), "papers")
    names = R.value_counts(papers, "tasks", "name").withColumn("task", clean_task_name(F.col("name")))
    names = names.withColumn("_n", F.sum("count").over(Window.partitionBy("task"))).where(F.col("_n") >= least)
    names = R.few(names.select("name", "task"), "names")

    def valid(some: DataFrame) -> DataFrame:
        return some.select("title", F.posexplode("tasks").alias("_p", "name")).join(names, "name")

    sizes = valid(papers).groupBy("title").agg(F.count("*").alias("_n"))
    joined = links.join(sizes, links["paper_title"] == sizes["title"]).select("repo", "title", "_n")
    chosen = materialize(R.first_of_group(joined, ["repo"], [F.desc("_n"), F.col("title")]).select("repo", "title"), "chosen")
    lists = valid(papers.join(chosen.select("title"), "title", "left_semi")).groupBy("title").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "task"))), lambda s: s["task"]).alias("tasks"))
    best = materialize(chosen.join(lists, "title").select("repo", "tasks"), "best")
    named = least_common_task(best.withColumn("paper", F.col("repo")), least).where("least_common_task is not null")
    named = materialize(named.select("repo", "tasks", "least_common_task"), "named")
    return R.keep_members(named, "tasks", named.select("least_common_task"), "least_common_task", "repo")


def area_tasks(areas: DataFrame) -> DataFrame:
    """(area, task) cleaned, without nulls, of areas with more than one row."""
    rows = areas.na.drop(subset=["area", "task"]).withColumn("task", clean_task_name(F.col("task")))
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy("area"))).where("_n > 1").drop("_n")


def titles_by_task(papers: DataFrame) -> DataFrame:
    return papers.select(F.explode("tasks").alias("task"), "title").groupBy("task").agg(F.array_sort(F.collect_set("title")).alias("titles"))


def frequent_queries(qrels: DataFrame, least: int) -> DataFrame:
    """Judgements of the queries that have `least` results or more."""
    return qrels.join(qrels.groupBy("query_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("query_id"), "query_id", "left_semi")


def relevance(results: DataFrame) -> DataFrame:
    """(query_id, results): a map document -> 1 for each query."""
    return results.select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("doc_id", F.lit(1).alias("rel"))))).alias("results"))


def filter_queries(qrels: DataFrame, test: Column) -> DataFrame:
    return qrels.where(test)


def small_tasks_dropped(papers: DataFrame, least: int, column: str = "least_common_task") -> DataFrame:
    """Rows whose value of the column occurs `least` times or more."""
    kept = papers.groupBy(column).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(column)
    return papers.join(kept, column, "left_semi")


def with_features(papers: DataFrame, nodes: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """Papers (repo, tasks, least_common_task, readme, abstract) whose repo, or its name behind the slash, is a node, with dependency_records, the texts of its edges' targets; only tasks
    that occur `least` times or more, and only rows whose least common task does."""
    names = nodes.select(F.col("node").alias("_n")).distinct()
    own = papers.select("repo", F.explode(F.array("repo", F.split_part("repo", F.lit("/"), F.lit(2)))).alias("_n")).join(names, "_n", "left_semi").select("repo").distinct()
    rows = papers.join(own, "repo", "left_semi").na.drop(subset=["readme", "abstract"])
    records = R.descriptions(edges, 1000).select(F.col("source").alias("repo"), F.col("description").alias("dependency_records"))
    rows = small_tasks_dropped(R.with_list_size(rows.join(records, "repo"), "tasks", 1), least)
    return R.keep_members(rows, "tasks", R.value_counts(rows, "tasks").where(F.col("count") >= least), "task", "repo")
