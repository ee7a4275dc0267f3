"""Append-only layers: folders ``<key>=<number>`` that appear whole.

Rows are written beside the layer and moved into place by one rename, so a
file stream over the layer sees whole deliveries only.  A delivery whose number
is there already is skipped: that is what makes a replay write nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.sources.files import Files


class Drops:
    def __init__(self, spark: SparkSession, path: str, key: str = "seq"):
        self.spark, self.path, self.key, self.files = spark, path.rstrip("/"), key, Files(spark)

    def numbers(self) -> list[int]:
        found = [n.partition("=")[2] for n in self.files.names(self.path) if n.startswith(f"{self.key}=")]
        return sorted(int(n) for n in found if n.isdigit())

    @property
    def exists(self) -> bool:
        return bool(self.numbers())

    def append(self, df: DataFrame, number: int) -> int | None:
        """The rows written; None if the number is there already."""
        target = f"{self.path}/{self.key}={number}"
        if self.files.exists(target):
            return None
        draft = f"{self.path}/_staging/{uuid.uuid4().hex}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(draft)
        rows = seen.get["rows"]
        if not self.files.move(draft, target):
            return None
        self.files.publish(f"{self.path}/_schemas/{number}.json", self.schema().json())
        return rows

    def schema(self) -> T.StructType | None:
        """The columns of all deliveries, in the order in which they came.

        Each delivery leaves the schema so far beside the layer; only one whose
        writer was stopped right before that has to be looked at.
        """
        there = self.numbers()
        told = [int(n[:-5]) for n in self.files.names(f"{self.path}/_schemas") if n[:-5].isdigit()]
        known = [T.StructType.fromJson(json.loads(self.files.read(f"{self.path}/_schemas/{max(told)}.json")))] if told else []
        untold = [self.spark.read.parquet(f"{self.path}/{self.key}={n}").schema for n in there if n not in set(told)]
        fields: dict[str, T.StructField] = {}
        for schema in [*known, *untold]:
            for f in schema.fields:
                fields.setdefault(f.name, T.StructField(f.name, f.dataType, True))
        return T.StructType([*fields.values()]) if fields else None

    def types(self) -> dict[str, str] | None:
        schema = self.schema()
        return {f.name: f.dataType.simpleString() for f in schema.fields} if schema else None

    def read(self, numbers: list[int] | None = None) -> DataFrame:
        there = self.numbers()
        chosen = [n for n in (there if numbers is None else numbers) if n in set(there)]
        schema = self.schema()
        if schema is None:
            raise ValueError(f"nothing in {self.path}")
        if not chosen:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{self.key}={n}" for n in chosen))

    def stream(self, per_trigger: int | None = None) -> DataFrame:
        """The deliveries as a stream of files, each of them once."""
        reader = self.spark.readStream.schema(self.schema()).option("maxFileAge", "36500d").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
        if per_trigger:
            reader = reader.option("maxFilesPerTrigger", per_trigger)
        return reader.parquet(f"{self.path}/{self.key}=*")
