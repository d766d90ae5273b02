"""Named queries over the synthetic tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.survey import survey, survey_oracle

Query = Callable[[SparkSession, str], DataFrame]

#: The moment that "future" is counted from, so that runs repeat.
NOW = datetime(1998, 6, 1)

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` may use the relation ``survey``."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            text = sql.strip()
            if "survey" in text or "readings" in text:
                text = f"WITH {survey_oracle()}, {text}" if not text.upper().startswith("SELECT") else f"WITH {survey_oracle()} {text}"
            elif not text.upper().startswith("SELECT"):
                text = f"WITH {text}"
            ORACLE_SQL[name] = text
        return f

    return register


__all__ = ["QUERIES", "ORACLE_SQL", "NOW", "query", "survey"]
