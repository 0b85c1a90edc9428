"""Readers and writers of the pipeline's files. Paths are any that Spark reads; schemas are declared, never inferred, where the tables are known."""

from __future__ import annotations

import itertools
import json
import os
import uuid

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import schemas
from tesserae.functions.text import parse_list_literal

#: Bytes of a feather file, which a task reads whole, unless a row has more.
FILE_BYTES = 1 << 24
#: Of CSV files: quotes are doubled, and nothing else is escaped; without the last option NUL would be.
CSV = {"header": True, "escape": '"', "charToEscapeQuoteEscaping": '"'}


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By ending: .parquet, .csv, .json, .jsonl (each with .gz too), .feather. ValueError for others."""
    bare = path.removesuffix("/").removesuffix(".gz")
    reader = spark.read.schema(schema) if schema else spark.read
    if bare.endswith(".parquet"):
        return reader.parquet(path)
    if bare.endswith(".csv"):
        # an empty field is null, and "" the empty text: what the parser takes null for must be no text
        return reader.options(**CSV, multiLine=True, nullValue=uuid.uuid4().hex).csv(path)
    if bare.endswith(".jsonl"):
        return reader.json(path)
    if bare.endswith(".json"):
        return reader.option("multiLine", True).json(path)
    if bare.endswith(".feather"):
        return read_feather(spark, [path], schema)
    raise ValueError(f"no reader for {path}: .parquet, .csv, .json, .jsonl or .feather")


def read_feather(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """Arrow files, one task each; their bytes are read by Spark, so any of its file systems will do. A file has to fit in a task's memory."""
    import pyarrow as pa
    import pyarrow.feather as feather

    raw = spark.read.format("binaryFile").load(paths).select("content")

    if schema is None:
        from pyspark.sql import types as T
        from pyspark.sql.pandas.types import from_arrow_schema

        def kinds(batches):
            for batch in batches:
                for content in batch.column(0):
                    yield pa.RecordBatch.from_pydict({"schema": [from_arrow_schema(pa.ipc.open_file(pa.BufferReader(content.as_buffer())).schema).json()]})

        # of all files: columns that some lack are null there
        fields: dict[str, T.StructField] = {}
        for r in raw.mapInArrow(kinds, "schema string").distinct().orderBy("schema").collect():
            for f in T.StructType.fromJson(json.loads(r.schema)):
                if fields.setdefault(f.name, f).dataType != f.dataType:
                    raise ValueError(f"{f.name} is {f.dataType.simpleString()} in one file and {fields[f.name].dataType.simpleString()} in another")
        schema = T.StructType(list(fields.values()))
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(schemas.struct(schema) if isinstance(schema, str) else schema)

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                for b in feather.read_table(pa.BufferReader(content.as_buffer())).to_batches(max_chunksize=10_000):
                    yield pa.RecordBatch.from_arrays([b.column(f.name).cast(f.type) if f.name in b.schema.names else pa.nulls(b.num_rows, f.type) for f in wanted], schema=wanted)

    return raw.mapInArrow(parse, schema)


def read_all(spark: SparkSession, paths: list[str], keys: list[str] = ()) -> DataFrame:
    """Files of several paths, by the ending of each, as one table without null keys; columns that some lack are null there."""
    from tesserae.operators.relational import union_all

    feathers = [p for p in paths if p.endswith(".feather")]
    parts = [read(spark, p) for p in paths if p not in feathers] + ([read_feather(spark, feathers)] if feathers else [])
    df = union_all(parts)
    return df.na.drop(subset=list(keys)) if keys else df


def python_files(spark: SparkSession, path: str) -> DataFrame:
    """python_files by repo; rows without content or repo are dropped."""
    df = schemas.require(read(spark, path), schemas.PYTHON_FILES)
    return df.select("path", "content", "repo_name").na.drop(subset=["content", "repo_name"]).orderBy("repo_name", "path")


def file_statistics(files: DataFrame) -> DataFrame:
    """n_files, n_repos, mean_files."""
    return files.agg(F.count("*").alias("n_files"), F.count_distinct("repo_name").alias("n_repos"), (F.count("*") / F.count_distinct("repo_name")).alias("mean_files"))


def repo_of_path(c: Column) -> Column:
    """The first underscore becomes a slash."""
    return F.regexp_replace(c, "^([^_]*)_", "$1/")


def python_directory(spark: SparkSession, root: str) -> DataFrame:
    """All .py files below root that are UTF-8 and not empty; repo_name from the directory just below root."""
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").options(pathGlobFilter="*.py", recursiveFileLookup=True).load(root)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    inner = F.regexp_extract("path", "^.*?" + _quoted("/" + root.split(":", 1)[-1].lstrip("/")) + "/(.*)$", 1)
    rows = files.select(inner.alias("path"), text.alias("content")).where("content <> ''")
    return rows.select("path", "content", repo_of_path(F.split_part("path", F.lit("/"), F.lit(1))).alias("repo_name"))


def _quoted(s: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in s)


def papers(spark: SparkSession, path: str, list_columns: list[str] = ("tasks",), drop_null: list[str] = ("tasks",)) -> DataFrame:
    """A table of papers from .csv or .json; columns of list literals become arrays."""
    df = read(spark, path).na.drop(subset=list(drop_null))
    kinds = dict(df.dtypes)
    return df.withColumns({c: parse_list_literal(F.col(c)) for c in list_columns if kinds[c] == "string"})


def paper_dumps(spark: SparkSession, links: str, papers_path: str) -> tuple[DataFrame, DataFrame]:
    """Links with repo, the URL without its host, and papers."""
    found = spark.read.schema(schemas.PAPER_LINKS).option("multiLine", True).json(links)
    found = found.withColumn("repo", F.replace("repo_url", F.lit("https://github.com/"), F.lit("")))
    return found, spark.read.schema(schemas.PAPERS).option("multiLine", True).json(papers_path)


def repos_with_code(repos: DataFrame, code: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repos with a readme that have code, and files with selected_code."""
    from tesserae.operators.code import selected_code

    kept = repos.where("readme is not null").join(code.select(F.col("repo_name").alias("repo")).distinct(), "repo", "left_semi")
    return kept, code.withColumn("selected_code", selected_code("content"))


def repo_map(spark: SparkSession, path: str) -> DataFrame:
    """(repo, text) of a file that holds one JSON object."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("repo", "text"))


def generated_traces(spark: SparkSession, path: str, span: str, inputs: str, outputs: str) -> DataFrame:
    """Inputs and outputs of the successful spans of that name, side by side; inputs and outputs: schemas of their JSON."""
    ok = spark.read.parquet(path).where((F.col("status_code") == "OK") & (F.col("name") == span))
    return ok.select(F.from_json("`attributes.input.value`", inputs).alias("i"), F.from_json("`attributes.output.value`", outputs).alias("o")).select("i.*", "o.*")


def search_results(raw: DataFrame) -> DataFrame:
    """Rows of a repository search, one for each name, topics joined, descriptions filled. raw: items array<struct<name, description, topics, …>>."""
    from tesserae.operators.relational import first_of_group

    rows = raw.select(F.posexplode("items").alias("pos", "s")).select("pos", "s.*")
    rows = rows.withColumns({"topics": F.array_join("topics", " "), "description": F.coalesce("description", F.lit(""))})
    return first_of_group(rows, ["name"], [F.col("pos")]).drop("pos")


def splits(spark: SparkSession, paths: list[str], schema: str, keys: list[str] = ()) -> DataFrame:
    """JSON lines of several files or patterns as one table, without null keys."""
    df = spark.read.schema(schema).json(paths)
    return df.na.drop(subset=list(keys)) if keys else df


def align_by_repo(first: DataFrame, *others: DataFrame, key: str = "repo") -> list[DataFrame]:
    """The tables without keys that some table lacks; the first one's `ord` column, if any, gives the order."""
    from tesserae.operators.relational import common_keys, filter_in

    return filter_in([first, *others], key, common_keys([first, *others], key))


# writers


def write(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "overwrite") -> None:
    """By ending: .parquet, .csv, .json, .jsonl or .feather. An empty table gives an empty dataset with its schema."""
    if path.endswith(".feather"):
        if partition_by:
            raise ValueError("feather files aren't partitioned")
        return write_feather(df, path, mode)
    w = df.write.mode(mode)
    w = w.partitionBy(*partition_by) if partition_by else w
    if path.endswith(".parquet"):
        w.parquet(path)
    elif path.endswith(".csv"):
        # white space at the ends is part of a text
        w.options(**CSV, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    elif path.endswith((".json", ".jsonl")):
        w.json(path)
    else:
        raise ValueError(f"no writer for {path}: .parquet, .csv, .json, .jsonl or .feather")


def write_feather(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of Arrow files of about FILE_BYTES at most, one or more for each partition that has rows, written by the tasks through Arrow's file systems (local or mounted, HDFS, object stores). mode: overwrite, or error if there is something.

    Each attempt of a task writes a file of its own; only those of attempts that succeeded stay, so lost executors and repeated tasks leave nothing behind.
    """
    import pyarrow as pa
    from pyarrow import fs as stores
    from pyspark.sql.pandas.types import to_arrow_schema

    uri = path if "://" in path else f"file://{os.path.abspath(path)}"
    kind = to_arrow_schema(df.schema)

    def put(name: str, batches) -> int:
        store, root = stores.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        n = 0
        with store.open_output_stream(f"{root}/{name}") as sink, pa.ipc.new_file(sink, kind) as w:
            for b in batches:
                w.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, kind)], schema=kind))
                n += b.num_rows
        return n

    def pieces(batches):
        """Batches of FILE_BYTES or less, unless a row has more."""
        for b in batches:
            rows = max(1, b.num_rows * FILE_BYTES // max(b.nbytes, 1))
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                if part.nbytes <= FILE_BYTES or part.num_rows == 1:
                    yield part
                else:
                    half = part.num_rows // 2
                    yield from pieces([part.slice(0, half), part.slice(half)])

    def save(batches):
        start, held, size = f"part-{TaskContext.get().partitionId():05}-{uuid.uuid4().hex}", [], 0
        number = itertools.count()

        def close():
            name = f"{start}-{next(number):05}.feather"
            return pa.RecordBatch.from_pydict({"name": [name], "n": pa.array([put(name, held)], pa.int64())})

        for b in pieces(batches):
            if held and size + b.nbytes > FILE_BYTES:
                yield close()
                held, size = [], 0
            held.append(b)
            size += b.nbytes
        if held:
            yield close()

    store, root = stores.FileSystem.from_uri(uri)
    if store.get_file_info(root).type != stores.FileType.NotFound:
        if mode != "overwrite":
            raise FileExistsError(path)
        store.delete_dir(root)
    # a name for each file
    kept = {r.name for r in df.mapInArrow(save, "name string, n long").collect() if r.n}
    if not kept:
        kept = {"part-00000.feather"}
        put(*kept, [])
    for f in store.get_file_info(stores.FileSelector(root)):
        if f.base_name not in kept:
            store.delete_file(f.path)


def word_vectors(df: DataFrame, word: str = "word", vector: str = "vector") -> DataFrame:
    """Lines `word v1 v2 …` with five digits, in a column value, for write.text."""
    return df.select(F.concat_ws(" ", F.col(word), F.array_join(F.transform(vector, lambda x: F.format_string("%.5f", x.cast("double"))), " ")).alias("value"))


def table_text(df: DataFrame, style: str = "markdown", digits: int = 3, most: int = 1000) -> str:
    """A small table as markdown or LaTeX; ValueError beyond `most` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: sum up first")
    cells = [[f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in rows]
    if style == "latex":
        body = " \\\\\n".join(" & ".join(c.replace("_", "\\_") for c in r) for r in [df.columns, *cells])
        return "\\begin{tabular}{" + "l" * len(df.columns) + "}\n" + body + " \\\\\n\\end{tabular}"
    lines = [df.columns, ["---"] * len(df.columns), *cells]
    return "\n".join("| " + " | ".join(r) + " |" for r in lines)
