"""Sources that give their rows page by page, as an online interface does, read by Spark's Python data source interface."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: fetch(options, page, per_page): the items of a page, from 1, each a mapping; an empty list after the last one.
Fetch = Callable[[dict, int, int], list]


class NoRows(RuntimeError):
    """The first page is empty: most likely the server has turned the request down."""


class _Pages(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__(first)
        self.first, self.last = first, last


def _cell(item: dict, name: str, kind: str):
    """An item's field; what isn't a plain value becomes JSON where the column is a string."""
    value = item.get(name)
    return json.dumps(value, ensure_ascii=False, sort_keys=True) if kind == "string" and isinstance(value, (dict, list)) else value


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict, fetch: Fetch):
        self._fields, self._options, self._fetch = [(f.name, f.dataType.simpleString()) for f in schema], dict(options), fetch
        self._pages, self._per_page, self._run = (int(options.get(k, d)) for k, d in (("pages", 10), ("per_page", 100), ("pages_a_task", 4)))
        self._tries, self._wait = int(options.get("tries", 4)), float(options.get("wait", 0.5))

    def partitions(self) -> list[InputPartition]:
        return [_Pages(a, min(a + self._run - 1, self._pages)) for a in range(1, self._pages + 1, self._run)]

    def _page(self, page: int) -> list:
        """A page is fetched whole before any row of it goes on, so a failed try leaves nothing behind."""
        for left in reversed(range(self._tries)):
            try:
                return list(self._fetch(self._options, page, self._per_page))
            except Exception:
                if not left:
                    raise
                time.sleep(self._wait * (self._tries - left))
        return []

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for page in range(partition.first, partition.last + 1):
            items = self._page(page)
            if not items:
                if page == 1:
                    raise NoRows("no rows on the first page")
                return
            for item in items:
                yield tuple(_cell(item, n, k) for n, k in self._fields)


def paged_source(short_name: str, schema: str, fetch: Fetch) -> type[DataSource]:
    """A data source to register: spark.dataSource.register(paged_source(...)), then spark.read.format(short_name).

    Options: pages (10 at most are read unless more are asked for), per_page (100), pages_a_task (4: each task reads a run of pages), tries (4) and wait (seconds, growing, between tries); all options are handed to fetch. A page
    that fails for good fails its task, which Spark starts again from the run's first page; rows of a failed task are not kept, so none come twice. An empty page ends its run; an empty first page raises NoRows.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return short_name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(schema, self.options, fetch)

    return Paged
