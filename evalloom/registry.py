"""Names for user functions: Column functions of documents, group aggregations and tasks written as classes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.filters import FILTERS, register_filter
from evalloom.operators.aggregates import AGGREGATIONS, register_aggregation
from evalloom.operators.fewshot import SAMPLERS, register_sampler

FUNCTIONS: dict[str, Callable[..., Column]] = {}
GROUP_AGGREGATIONS: dict[str, Callable[[Column, Column], Column]] = {
    "difference": lambda values, sizes: F.get(values, F.lit(0)) - F.get(values, F.lit(1)),
    "mean": lambda values, sizes: F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values),
}
TASKS: dict[str, type[Task]] = {}


def register_function(name: str):
    """Make a Column function (or a vectorised UDF) available under ``module.name``."""
    def add(fn):
        if name in FUNCTIONS:
            raise ValueError(f"function {name} registered twice")
        FUNCTIONS[name] = fn
        return fn

    return add


def call(name: str, *columns: Column | str) -> Column:
    if name not in FUNCTIONS:
        raise KeyError(f"unknown function {name}")
    return FUNCTIONS[name](*[F.col(c) if isinstance(c, str) else c for c in columns])


class Task:
    """A task with its own documents, requests, scores and aggregation; every step is a DataFrame."""

    name = ""

    def docs(self, source: DataFrame) -> DataFrame:
        raise NotImplementedError

    def requests(self, docs: DataFrame) -> DataFrame:
        raise NotImplementedError

    def score(self, docs: DataFrame, responses: DataFrame) -> DataFrame:
        raise NotImplementedError

    def aggregate(self, scores: DataFrame) -> DataFrame:
        raise NotImplementedError

    def evaluate(self, source: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Documents to metrics; ``answer`` turns requests into responses (a table join, or a model outside)."""
        docs = self.docs(source)
        return self.aggregate(self.score(docs, answer(self.requests(docs))))


def register_task(cls: type[Task]) -> type[Task]:
    if cls.name in TASKS:
        raise ValueError(f"task {cls.name} registered twice")
    TASKS[cls.name] = cls
    return cls


__all__ = [
    "AGGREGATIONS", "FILTERS", "FUNCTIONS", "GROUP_AGGREGATIONS", "SAMPLERS", "TASKS", "Task", "call", "register_aggregation",
    "register_filter", "register_function", "register_sampler", "register_task",
]
