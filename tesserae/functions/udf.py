"""Vectorised Python functions as column functions."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorized(schema: str) -> Callable:
    """Like pandas_udf, but made when it is called: modules with such functions can be imported where no session is, as on executors."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def call(*columns) -> Column:
            return F.pandas_udf(f, schema)(*columns)

        return call

    return wrap
