"""Independent jobs side by side."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from uuid import uuid4

from pyspark.sql import SparkSession


def run_all(spark: SparkSession, jobs: dict[str, Callable[[], object]]) -> dict[str, object]:
    """What the jobs give, by name, run at once, as one for each protocol. The first that fails cancels the others and is raised."""
    tags = {name: f"run-{uuid4().hex}" for name in jobs}

    def one(name: str) -> object:
        spark.addTag(tags[name])
        try:
            return jobs[name]()
        finally:
            spark.removeTag(tags[name])

    if not jobs:
        return {}
    with ThreadPoolExecutor(len(jobs)) as pool:
        futures = {name: pool.submit(one, name) for name in jobs}
        done, rest = wait(futures.values(), return_when=FIRST_EXCEPTION)
        if any(f.exception() for f in done):
            for name, f in futures.items():
                if f in rest:
                    spark.interruptTag(tags[name])
            raise next(f.exception() for f in done if f.exception())
        return {name: f.result() for name, f in futures.items()}
