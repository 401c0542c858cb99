"""The core library's registered queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "runs_query"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


from limnos.plans import q_audits, q_binding, q_conditions, q_feeds, q_fitting, q_labels, q_legs, q_lines, q_more, q_ordered, q_polygons, q_relational, q_scalars, q_sources, q_spatial, q_streaming, q_structure, q_text  # noqa: E402, F401
