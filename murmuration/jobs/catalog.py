"""Every registered query of the transcript and evaluation jobs, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from murmuration.jobs import evaluation, fusion, grading, placing, transcripts

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in (evaluation, transcripts, fusion, grading, placing):
        out |= {name: query for name, (query, _) in module.JOBS.items()}
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in (evaluation, transcripts, fusion, grading, placing):
        out |= {name: sql for name, (_, sql) in module.JOBS.items() if sql}
    return out
