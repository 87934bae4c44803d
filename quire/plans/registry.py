"""Registration of queries: a function of the derived corpus, and the SQL that it must agree with."""

from collections.abc import Callable

from pyspark.sql import DataFrame

from quire.sources.corpus import Corpus, with_tables

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name; sql None: no SQL expresses it."""

    def add(function: Callable[[Corpus], DataFrame]):
        name = function.__name__.rstrip("_")
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: function(Corpus(spark, sf_dir))
        if sql:
            SQL[name] = with_tables(sql)
        return function

    return add
