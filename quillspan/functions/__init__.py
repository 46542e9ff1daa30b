"""Column expressions and Arrow functions for text, geometry and tables."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F


def arrow(return_type: str):
    """pandas_udf that is made when it is used: its type is parsed by a running session, which an import must not need."""

    def wrap(f):
        @functools.wraps(f)
        def call(*columns):
            return F.pandas_udf(f, return_type)(*columns)

        return call

    return wrap


def arrow_rows(return_type: str):
    """arrow_udf that is made when it is used, for large values: the function gets Arrow arrays, whose values it can look at one by one."""

    def wrap(f):
        @functools.wraps(f)
        def call(*columns):
            return F.arrow_udf(f, return_type)(*columns)

        return call

    return wrap
