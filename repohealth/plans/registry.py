"""Registry of named queries: a Spark job and, where SQL can say it, its oracle text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from repohealth.sources.views import VIEWS, Tables, oracle_ctes

Job = Callable[[Tables], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    job: Job
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.job(Tables(spark, folder))


REGISTRY: dict[str, Query] = {}


def oracle(body: str) -> str:
    """Prefix ``body`` with the adapter views it mentions."""
    used = tuple(name for name in VIEWS if re.search(rf"\b{name}\b", body))
    ctes = oracle_ctes(used)
    body = body.strip()
    recursive = re.match(r"WITH\s+RECURSIVE\s", body, re.I)
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    if own:
        head = ",\n".join(ctes + [body[own.end():]])
        return f"WITH {'RECURSIVE ' if recursive else ''}{head}"
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    """Register a job under ``name`` with its oracle text."""

    def add(job: Job) -> Job:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, job, oracle(sql) if sql else None)
        return job

    return add
