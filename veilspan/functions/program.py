"""Record a chain of projections once, replay it on other tables.

Detection is a long chain of `select`s whose column expressions depend only on a few input columns.
Building those expressions costs far more driver time than analysing them, so a chain is recorded
on an empty template table and then replayed wherever the same rules are applied: to the next text
field, to the gate, to the next query of the session.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

_INPUTS = {
    "__text": "string", "__employer": "string", "__own": "string", "__keep": "array<string>",
    "__names": "array<string>", "__amounts": "array<double>",
}
_cache: dict[tuple, tuple[list, str]] = {}


class Recorder:
    """The small part of the DataFrame surface a chain may use."""

    def __init__(self, df: DataFrame, steps: list):
        self._df, self.steps = df, steps

    @property
    def columns(self) -> list[str]:
        return self._df.columns

    def select(self, *args):
        return Recorder(self._df.select(*args), [*self.steps, args])

    def withColumn(self, name: str, col: Column):
        rest = [c for c in self.columns if c != name]
        return self.select(*rest, col.alias(name))

    def drop(self, *names: str):
        return self.select(*[c for c in self.columns if c not in names])


def _record(spark: SparkSession, key: tuple, inputs: list[str], build) -> tuple[list, str]:
    full = (id(spark._jsparkSession), *key)
    if full not in _cache:
        template = spark.createDataFrame([], ", ".join(f"{c} {_INPUTS[c]}" for c in inputs))
        done = build(Recorder(template, []), "__out")
        _cache[full] = done.steps
    return _cache[full]


def apply(df: DataFrame, key: tuple, columns: dict[str, str | None], build, out: str) -> DataFrame:
    """Replay the chain `build` (recorded under `key`) with `columns` bound to its inputs."""
    used = {k: v for k, v in columns.items() if v is not None}
    steps = _record(df.sparkSession, (*key, *sorted(used)), list(used), build)
    base = [c for c in df.columns if c != out]
    ref = [f"`{c}`" for c in base]
    d = df.select(*ref, *[df[f"`{v}`"].cast(_INPUTS[k]).alias(k) for k, v in used.items()])
    for args in steps:
        d = d.select(*args) if args and args[0] == "*" and isinstance(args[0], str) else d.select(*ref, *args)
    return d.select(*ref, d["__out"].alias(out))
