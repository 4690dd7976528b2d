"""Query registry and the binding of driver tables to operator inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BINDINGS: dict[str, Callable[["Dialect"], str]] = {}


class Dialect:
    """The few spellings on which Spark SQL and the checking engine differ."""

    def __init__(self, spark: bool):
        self.spark = spark

    def sha(self, text: str) -> str:
        return f"sha2({text}, 256)" if self.spark else f"sha256({text})"

    def hexnum(self, text: str) -> str:
        return (f"CAST(conv({text}, 16, 10) AS BIGINT)" if self.spark
                else f"CAST('0x' || {text} AS BIGINT)")

    def micros(self, ts: str) -> str:
        return (f"unix_micros(CAST({ts} AS TIMESTAMP))" if self.spark
                else f"epoch_us({ts})")


SPARK, CHECK = Dialect(True), Dialect(False)


def binding(fn):
    """Register a table binding: a SELECT whose inputs are {name} references."""
    BINDINGS[fn.__name__] = fn
    return fn


def _inputs(text: str) -> list[str]:
    seen: list[str] = []
    for name in [*TABLES, *BINDINGS]:
        if "{" + name + "}" in text:
            seen.append(name)
    return seen


class Tables:
    """Lazy readers of one scale-factor directory."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in TABLES:
                df = self.spark.read.parquet(f"{self.path}/{name}.parquet")
                for field in df.schema:  # NTZ columns are UTC instants
                    if field.dataType.typeName() == "timestamp_ntz":
                        df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
            elif name in BINDINGS:
                text = BINDINGS[name](SPARK)
                df = self.spark.sql(text, **{i: getattr(self, i) for i in _inputs(text)})
            else:
                raise AttributeError(name)
            self._cache[name] = df
        return self._cache[name]


def _needed(name: str, order: list[str]) -> None:
    if name in TABLES or name in order:
        return
    for child in _inputs(BINDINGS[name](CHECK)):
        _needed(child, order)
    order.append(name)


def check_sql(body: str) -> str:
    """Prefix a check query with the bindings it names as {binding}."""
    order: list[str] = []
    for name in _inputs(body):
        _needed(name, order)
    names = {n: n for n in [*TABLES, *BINDINGS]}
    ctes = [f"{n} AS ({BINDINGS[n](CHECK).format(**names)})" for n in order]
    body = body.format(**names).strip()
    if not ctes:
        return body
    head = "WITH RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else "WITH "
    if body.upper().startswith("WITH"):
        rest = body[len("WITH RECURSIVE"):] if head == "WITH RECURSIVE " else body[len("WITH"):]
        return head + ",\n".join(ctes) + ",\n" + rest.strip()
    return head + ",\n".join(ctes) + "\n" + body


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` and its check query."""

    def wrap(fn):
        def run(spark: SparkSession, path: str) -> DataFrame:
            from ..session import tune
            return fn(Tables(tune(spark), path))

        run.__name__ = name
        run._home = fn.__module__.rsplit(".", 1)[-1]
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def oracle_sql() -> dict[str, str]:
    return {name: check_sql(text) for name, text in ORACLES.items()}


from . import bindings as _bindings  # noqa: E402,F401  (fills BINDINGS)
