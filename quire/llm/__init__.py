"""Operators for training-data pipelines, with the queries that apply them.

Nothing else in the library imports this subpackage.
"""


def queries():
    """name -> callable(spark, sf_dir) of every query of this subpackage."""
    from quire.llm import registry

    return registry.queries()


def oracle_sql():
    """name -> DuckDB SQL, for the queries that SQL can express."""
    from quire.llm import registry

    return registry.oracle_sql()
