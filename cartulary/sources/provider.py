"""Keyed enrichment from a pluggable provider, as a Python data source, with failover."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A provider maps a key to (payload as JSON, None) or (None, error class).
Provider = Callable[[str], tuple[str | None, str | None]]

FAILURES = {401: "unauthorised", 429: "quota", 503: "overloaded"}


def fixture(key: str) -> tuple[str | None, str | None]:
    """An offline provider: three eras a key; keys that end in 7 are over quota, those that end in 9 send no eras."""
    if key.endswith("7"):
        return None, FAILURES[429]
    eras = [] if key.endswith("9") else [{"title": f"Era {i} of {key}", "period": f"{i}00", "hook": None} for i in (1, 2, 3)]
    return json.dumps({"country": key, "eras": eras}), None


PROVIDERS: dict[str, Provider] = {"fixture": fixture}


def call(provider: Provider, key: str) -> tuple[str, str | None, str | None]:
    """A payload or the class of what went wrong; nothing escapes as an exception."""
    try:
        payload, error = provider(key)
    except TimeoutError:
        return key, None, "timeout"
    except OSError:
        return key, None, "network"
    except Exception as other:  # noqa: BLE001  any other failure of a provider is an error row
        return key, None, f"error: {type(other).__name__}"
    if error is None:
        try:
            json.loads(payload or "")
        except ValueError:
            return key, None, "bad json"
    return key, payload, error


class ProviderSource(DataSource):
    """spark.read.format("keyed_provider").option("provider", name).option("keys", json list): key, payload, error."""

    @classmethod
    def name(cls) -> str:
        return "keyed_provider"

    def schema(self) -> str:
        return "key string, payload string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["provider"], json.loads(self.options["keys"]), int(self.options.get("partitions", "8")))


class _Reader(DataSourceReader):
    def __init__(self, provider: str, keys: list[str], partitions: int):
        self.provider, self.keys, self.n = provider, keys, max(1, min(partitions, len(keys)))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.keys[k :: self.n]) for k in range(self.n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for key in partition.value:
            yield call(PROVIDERS[self.provider], key)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ProviderSource)


def enrich(keys: DataFrame, provider: Provider) -> DataFrame:
    """(key, payload, error) of the distinct keys: each is asked for once.  Tasks may run again, so providers must give the same answer twice."""

    def ask(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [call(provider, key) for key in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["key", "payload", "error"])

    return keys.select(F.col("key").cast("string")).where("key is not null").distinct().mapInArrow(ask, "key string, payload string, error string")


def valid(answers: DataFrame, schema: str, check: str) -> tuple[DataFrame, DataFrame]:
    """Answers that parse and satisfy check, with the parsed column data; and the rest with why."""
    parsed = answers.withColumn("data", F.from_json("payload", schema))
    good = F.coalesce(F.col("error").isNull() & F.expr(check), F.lit(False))
    return parsed.where(good), parsed.where(~good).select("key", F.coalesce("error", F.lit("empty")).alias("error"))


def failover(primary: DataFrame, secondary: DataFrame, use_primary: bool = True) -> DataFrame:
    """One value a key (key, value): of the primary where it is neither null nor empty, else of the secondary.  The switch is a setting of the run, not state of a process."""
    joined = primary.select("key", F.col("value").alias("p")).join(secondary.select("key", F.col("value").alias("s")), "key", "full")
    own = F.when(F.lit(use_primary), F.nullif("p", F.lit("")))
    return joined.select("key", F.coalesce(own, "s").alias("value"), F.when(own.isNotNull(), "primary").when(F.col("s").isNotNull(), "secondary").alias("provider"))
