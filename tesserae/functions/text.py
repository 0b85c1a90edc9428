"""Scalar functions on text, lists and maps, as column expressions. Null in, null out unless said otherwise."""

from __future__ import annotations

import ast
import functools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.udf import vectorized

#: White space as Python's str.strip takes it, as a Java class.
WHITE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


#: Fixed pattern: the words of a camelCase name.
CAMEL = r".+?(?:(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|$)"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def clean_task_name(c: Column) -> Column:
    """Digits with a small d go, hyphens become spaces, then lower case and strip: `3D` stays, as it is lower-cased too late."""
    return strip(F.lower(F.replace(F.regexp_replace(c, r"(?U)\d+d", ""), F.lit("-"), F.lit(" "))))


def lower_all(c: Column) -> Column:
    return F.transform(c, F.lower)


def strip_dimensions(c: Column) -> Column:
    for d in ("2D", "3D", "4D", "6D"):
        c = F.replace(c, F.lit(d), F.lit(""))
    return strip(c)


def collapse_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, f"{WHITE}+", " ")


def tokenize(c: Column) -> Column:
    """The pieces between white space."""
    return F.filter(F.split(c, f"{WHITE}+"), lambda t: t != "")


def split_identifier(c: Column) -> Column:
    """snake_case at underscores, else camelCase before capitals; lower case."""
    camel = F.regexp_extract_all(c, F.lit("(?s)" + CAMEL), 0)
    return lower_all(F.when(c.contains("_"), F.split(c, "_")).otherwise(camel))


def public_modules(c: Column) -> Column:
    """Names that don't begin with an underscore, joined by spaces."""
    return F.array_join(F.filter(c, lambda x: ~x.startswith("_")), " ")


def sanitize_generated(raw: Column, prompt: Column) -> Column:
    """A generated list of tags without the prompt, cut at the first ##, its brackets and runs of commas made plain."""
    text = strip(F.split_part(F.replace(raw, prompt, F.lit("")), F.lit("##"), F.lit(1)))
    text = F.replace(text, F.lit("]"), F.lit(", "))
    text = F.replace(F.regexp_replace(text, f",{WHITE}*,", ", "), F.lit("\n"), F.lit(" "))
    return F.regexp_replace(text, r"(?U),\W+", ", ")


def first_line_plain(c: Column) -> Column:
    """The first line without [ ] , and '."""
    return F.translate(F.split_part(strip(c), F.lit("\n"), F.lit(1)), "[],'", "")


def join_tags(c: Column, separator: str = " ; ") -> Column:
    return F.array_join(F.transform(F.split(c, ","), strip), separator)


def select_dependencies(c: Column, n: int) -> Column:
    """Base names of the first n that don't have __init__ in them."""
    return F.slice(F.transform(F.filter(c, lambda x: ~x.contains("__init__")), lambda x: F.regexp_extract(x, "[^/]*$", 0)), 1, n)


def names_text(c: Column) -> Column:
    """The name field of an array of structs, joined by spaces."""
    return F.array_join(F.transform(c, lambda x: x["name"]), " ")


@vectorized("array<string>")
def _literal(values: pd.Series) -> pd.Series:
    def parse(s):
        try:
            v = ast.literal_eval(s)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None
        return [None if x is None else str(x) for x in v] if isinstance(v, (list, tuple, set)) else None

    return values.map(parse)


def parse_list_literal(c: Column) -> Column:
    """A Python list literal of strings. Plain ones are read as JSON; only those with backslashes, mixed quotes or prefixes go to Python."""
    plain = r"^\s*\[\s*(?:(?:'[^'\"\\]*'|\"[^'\"\\]*\")\s*(?:,\s*(?:'[^'\"\\]*'|\"[^'\"\\]*\")\s*)*)?\]\s*$"
    return F.when(c.rlike(plain), F.from_json(c, "array<string>", {"allowSingleQuotes": "true"})).otherwise(_literal(F.when(~c.rlike(plain), c)))


def select_elements(lists: list[Column], each: int = 5, total: int = 15) -> Column:
    return F.slice(F.concat(*(F.slice(c, 1, each) for c in lists)), 1, total)


def merge_first_wins(maps: list[Column]) -> Column:
    """One map; of a key in several the first map's value."""
    return functools.reduce(lambda known, m: F.map_concat(known, F.map_filter(m, lambda k, _: ~F.map_contains_key(known, k))), maps)


def line_count(c: Column) -> Column:
    return F.size(F.split(c, "\n", -1)).cast("long")


def word_count(c: Column) -> Column:
    return F.size(tokenize(c)).cast("long")


def reciprocal(c: Column) -> Column:
    """1 / x, infinite at 0."""
    return F.when(c == 0, F.lit(float("inf"))).otherwise(F.lit(1.0) / c)


def magnitude_bucket(c: Column, top: int = 2) -> Column:
    """Whole part of log10, held between 0 and top."""
    return F.least(F.greatest(F.log10(c).cast("int"), F.lit(0)), F.lit(top))


def any_of(words: list[str]) -> str:
    """A pattern for any of the words, taken literally."""
    return "(" + "|".join("".join(x if x.isalnum() or x.isspace() else "\\" + x for x in w) for w in words) + ")"


def highlight(c: Column, words: list[str], before: str = "**", after: str = "**") -> Column:
    return F.regexp_replace(c, any_of(words), before.replace("$", r"\$") + "$1" + after.replace("$", r"\$"))


def chunks(c: Column, n: int) -> Column:
    """n pieces of equal length, the last shorter."""
    size = F.greatest(F.ceil(F.length(c) / n), F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(c, (i * size + 1).cast("int"), size.cast("int")))


def file_lines(c: Column) -> Column:
    """File names of a repository map: lines that begin with something ending in `.py:`, without colons around."""
    return F.transform(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x.rlike(r"^.*\.py:")), lambda x: F.btrim(x, F.lit(":")))


def file_block(path: Column, code: Column) -> Column:
    return F.concat(F.lit("file "), path, F.lit("\n```\n"), code, F.lit("\n```"))


def document_text(columns: list[Column]) -> Column:
    return F.replace(F.concat_ws(" ", *columns), F.lit("/"), F.lit(" "))


def clean_content(c: Column) -> Column:
    """Null for the text of a refused download and for blank."""
    return F.nullif(strip(F.replace(c, F.lit("429: Too Many Requests"), F.lit(""))), F.lit(""))


def piece_after(c: Column, mark: str, k: int = -1) -> Column:
    """The k-th piece between marks, from 1, or from the end if negative."""
    return F.try_element_at(F.split(c, any_of([mark])), F.lit(k))


def outcome(value: Column, error: Column | None = None) -> Column:
    """A result that may be a failure: whether it is there, the value, and what went wrong."""
    return F.struct(value.isNotNull().alias("ok"), value.alias("value"), F.when(value.isNull(), error if error is not None else F.lit("no value")).alias("error"))


#: Names of retrievers as shown, by what they contain, and colours of corpora.
RETRIEVER_NAMES = (("all-mpnet-base-v2", "MPNet"), ("all-MiniLM-L12-v2", "MiniLM"), ("embeddinggemma", "gemma embedder"), ("static-retrieval", "static embedder"))
CORPUS_COLOURS = (("signature", "red"), ("dep_sig", "blue"), ("repomap", "cyan"), ("code2doc", "green"))
#: Parts of corpus names that go behind the name in brackets, and whole names as shown.
CORPUS_SOURCES = ("dep_sig", "repomap")
CORPUS_NAMES = (("code2doc_generated_readme", "code2doc_generated_readme (selected code)"), ("code2doc_files_summary", "code2doc_files_summary(selected code)"))
CORPUS_WORDS = (("generation_context", "code summary"), ("dep_sig", "dependency signature"))


def retriever_label(c: Column) -> Column:
    out = F.when(c == "bm25", F.lit("BM25"))
    for part, name in RETRIEVER_NAMES:
        out = out.when(c.contains(part), F.lit(name))
    return F.replace(out.otherwise(c), F.lit("_"), F.lit(" "))


def corpus_colour(c: Column) -> Column:
    out = F
    for part, colour in CORPUS_COLOURS:
        out = out.when(c.contains(part), F.lit(colour))
    return out


def corpus_label(c: Column) -> Column:
    """A corpus's name as shown: which source it is of goes behind, in brackets."""
    (first, first_shown), (last, last_shown) = CORPUS_WORDS
    name = F.replace(c, F.lit(first), F.lit(first_shown))
    shown = F
    for part in CORPUS_SOURCES:
        shown = shown.when(name.contains(part), F.concat(F.replace(name, F.lit(part + "_"), F.lit("")), F.lit(f" ({part})")))
    for whole, as_shown in CORPUS_NAMES:
        shown = shown.when(name == whole, F.lit(as_shown))
    colour = corpus_colour(c)
    text = F.replace(shown.otherwise(name), F.lit(last), F.lit(last_shown))
    return F.when(colour.isNull(), c).otherwise(F.concat(F.lit("{\\color{"), colour, F.lit("} "), text, F.lit("}")))


def round_nested(c: Column, kind: T.DataType, digits: int = 3, compat: bool = True) -> Column:
    """Numbers rounded, in maps and structs at any depth too. compat: below the top three digits whatever is asked for, as the original does."""
    below = 3 if compat else digits
    if isinstance(kind, T.StructType):
        return F.struct(*(round_nested(c[f.name], f.dataType, below, compat).alias(f.name) for f in kind))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: round_nested(v, kind.valueType, below, compat))
    return F.round(c.cast("double"), digits) if isinstance(kind, T.NumericType) else c


def concat_columns(df: DataFrame, columns: list[str], target: str, separator: str = " ") -> DataFrame:
    """Null if any of the columns is."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.lit(separator), F.col(c).cast("string")]
    return df.withColumn(target, F.concat(*parts[1:]))


def flatten_lists(df: DataFrame, columns: list[str]) -> DataFrame:
    """List columns, or lists kept as literals, as text joined by spaces."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.array_join(F.col(c) if kinds[c].startswith("array") else parse_list_literal(F.col(c)), " ") for c in columns})
