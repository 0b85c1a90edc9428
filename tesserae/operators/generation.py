"""Prompts and text generation. A generator is any function from a list of prompts to a list of texts, called once for each Arrow batch on the executors.

The default one is deterministic and offline; a hosted model goes behind the same function. A failure becomes a row with an error, never a lost one.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import file_block, file_lines

#: Headings of the sections of a prompt for tags, the last of the target's.
SECTION_HEADINGS = ("## repository", "## files", "## tags", "## 3 tags")

Generator = Callable[[list[str]], list[str]]


def echo(prompts: list[str]) -> list[str]:
    """The last line of each prompt that isn't blank, at most 80 characters."""
    return [next((x.strip() for x in reversed(p.splitlines()) if x.strip()), "")[:80] for p in prompts]


def generate(df: DataFrame, prompt: str, generator: Generator = echo, target: str = "answer") -> DataFrame:
    """df with target and error; a batch that fails is tried prompt by prompt."""

    def one(p: str) -> tuple[str | None, str | None]:
        try:
            return generator([p])[0], None
        except Exception as e:  # a generator may raise anything
            return None, f"{type(e).__name__}: {e}"

    @F.pandas_udf("struct<value: string, error: string>")
    def run(prompts: pd.Series) -> pd.DataFrame:
        some = prompts.fillna("").tolist()
        try:
            got = [(v, None) for v in generator(some)]
            if len(got) != len(some):
                raise ValueError("as many texts as prompts are needed")
        except Exception:
            got = [one(p) for p in some]
        return pd.DataFrame(got, columns=["value", "error"])

    return df.withColumn("_g", run(prompt)).select(*df.columns, F.col("_g.value").alias(target), F.col("_g.error").alias("error"))


def failures(generated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a text, and rows that failed."""
    return generated.where("error is null").drop("error"), generated.where("error is not null")


def generations(df: DataFrame, n: int, prompt: str, generator: Generator = echo) -> DataFrame:
    """n texts for each row, with generation from 0."""
    return generate(df.withColumn("generation", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), prompt, generator, "generated_text")


def few_shot_prompt(context: Column, target: Column, instruction: str) -> Column:
    """An instruction, examples (array of struct<signature, tasks>) with their tasks, and the target's signature without."""
    shown = F.transform(context, lambda c: F.concat(c["signature"], F.lit("\ntasks:\n"), c["tasks"]))
    return F.concat_ws("\n\n", F.lit(instruction), F.array_join(shown, "\n\n"), F.concat(target, F.lit("\ntasks:\n")))


def tagged_prompt(context: Column, name: Column, content: Column) -> Column:
    """Examples (array of struct<name, content, true_text>) as sections of a document, and the target's sections up to its open list of tags."""
    first, second, tags, asked = SECTION_HEADINGS

    def block(name: Column, content: Column, heading: str) -> Column:
        return F.concat(F.lit(f"{first}\n"), name, F.lit(f"\n{second}\n"), content, F.lit(f"\n{heading}\n["))

    shown = F.transform(context, lambda c: F.concat(block(c["name"], c["content"], tags), c["true_text"], F.lit("]")))
    return F.array_join(F.concat(shown, F.array(block(name, content, asked))), "\n")


def with_context(shots: DataFrame, records: DataFrame, fields: list[str]) -> DataFrame:
    """(repo, context): the records of the repos in `shots` (repo, position, context), as an array of structs in order."""
    r = records.select(F.col("repo").alias("context"), F.struct(*fields).alias("_s"))
    got = shots.join(r, "context").groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("position", "_s"))).alias("_l"))
    return got.select("repo", F.transform("_l", lambda x: x["_s"]).alias("context"))


def file_summaries(files: DataFrame, most: int, code: str = "content") -> DataFrame:
    """(repo_name, filenames, n_files, text): blocks of the first files of each repo by path."""
    w = Window.partitionBy("repo_name").orderBy("path")
    some = files.where(F.col(code).isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    item = F.array_sort(F.collect_list(F.struct("_r", "path", file_block(F.col("path"), F.col(code)).alias("b"))))
    return some.groupBy("repo_name").agg(item.alias("_l")).select("repo_name", F.transform("_l", lambda x: x["path"]).alias("filenames"), F.size("_l").alias("n_files"), F.array_join(F.transform("_l", lambda x: x["b"]), "\n\n").alias("text"))


def map_summaries(maps: DataFrame) -> DataFrame:
    """The same from repository maps (repo, text)."""
    names = file_lines(F.col("text"))
    return maps.select(F.col("repo").alias("repo_name"), names.alias("filenames"), F.size(names).alias("n_files"), "text")


def readmes(summaries: DataFrame, generator: Generator = echo, flat: bool = False) -> DataFrame:
    """(repo_name, answer, context_history, filenames, n_files, error): a text for each repo, from a summary of its files, or flat from the files themselves."""
    if flat:
        rows = summaries.withColumn("context_history", F.lit(None).cast("string")).withColumn("_p", F.concat(F.lit("Write the documentation of this repository.\n\n"), "text"))
    else:
        first = summaries.withColumn("_q", F.concat(F.lit("Summarise these files.\n\n"), "text"))
        rows = generate(first, "_q", generator, "context_history").withColumnRenamed("error", "_e").withColumn("_p", F.concat(F.lit("Write the documentation of a repository from this summary.\n\n"), F.coalesce("context_history", F.lit(""))))
    out = generate(rows, "_p", generator)
    error = F.col("error") if flat else F.coalesce("_e", "error")
    return out.select("repo_name", "answer", "context_history", "filenames", "n_files", error.alias("error"))


def signature_summaries(signatures: DataFrame) -> DataFrame:
    """The same as file_summaries() from dependency signatures (repo, dependency_signature), whose files are those of the section repo-file."""
    section = F.regexp_extract("dependency_signature", r"(?:^|\n)repo-file:\n([^\n]*)", 1)
    names = F.filter(F.split(section, ", "), lambda x: x != "")
    return signatures.select(F.col("repo").alias("repo_name"), names.alias("filenames"), F.size(names).alias("n_files"), F.col("dependency_signature").alias("text"))


def readme_variants(files: DataFrame, maps: DataFrame, signatures: DataFrame, most: int = 10, generator: Generator = echo, code: str = "content") -> DataFrame:
    """(variant, repo_name, answer, …): texts from selected code, repository maps and dependency signatures, each by a summary first and flat: six for each repo that has all."""
    from tesserae.operators.relational import union_all

    summaries = {"code": file_summaries(files, most, code), "map": map_summaries(maps), "signature": signature_summaries(signatures)}
    return union_all([readmes(s, generator, flat).withColumn("variant", F.lit(f"{name}_{'flat' if flat else 'summary'}")) for name, s in summaries.items() for flat in (False, True)])


def typed_tags(answer: Column) -> Column:
    """The list `tasks` of a JSON answer; null if it isn't one."""
    return F.from_json(answer, "tasks array<string>")["tasks"]
