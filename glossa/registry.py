"""Named queries: a builder over the annotation views, and the same question in SQL."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import fixtures

Views = fixtures.Loader


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Views], DataFrame]
    sql: str | None
    summary: str

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(fixtures.Loader(spark, sf_dir))

    def oracle(self) -> str | None:
        return self.sql and fixtures.with_views(self.sql)


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``build(views)``, where ``views(name)`` is a table or a derived view."""
    def register(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, build, sql, (build.__doc__ or "").strip().split("\n")[0])
        return build
    return register


def available() -> list[str]:
    load_all()
    return sorted(REGISTRY)


def get(name: str) -> Query:
    load_all()
    if name not in REGISTRY:
        raise KeyError(f"unknown query {name}")
    return REGISTRY[name]


def load_all() -> dict[str, Query]:
    from . import catalogue, catalogue_annotator, catalogue_assertions, catalogue_attributes, catalogue_enrich, catalogue_entities, catalogue_events, catalogue_links, catalogue_merging, catalogue_nominals, catalogue_refine, catalogue_reports, catalogue_scores, catalogue_signals  # noqa: F401

    return REGISTRY
