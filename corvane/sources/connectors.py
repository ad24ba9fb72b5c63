"""Connectors: external systems as a Spark data source. A connector lists its partitions and reads one of them."""

from __future__ import annotations

import base64
import importlib
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "uri string, mime string, text string"


class Connector:
    """What a connector implements; options are those given to the reader."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[str]:
        raise NotImplementedError

    def read(self, partition: str) -> Iterator[tuple[str, str, str]]:
        raise NotImplementedError


class Counting(Connector):
    """Generates ``parts`` × ``items`` small texts; the smallest connector there is, for tests and as an example."""

    def partitions(self) -> list[str]:
        return [str(i) for i in range(int(self.options.get("parts", "2")))]

    def read(self, partition: str) -> Iterator[tuple[str, str, str]]:
        for i in range(int(self.options.get("items", "3"))):
            yield f"counting:///{partition}/{i}.md", "text/markdown;kind=markdown.doc", f"item {i} of part {partition}"


class _Part(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)


class _Reader(DataSourceReader):
    def __init__(self, connector: Connector):
        self.connector = connector

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.connector.partitions()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.connector.read(partition.value)


class ConnectorSource(DataSource):
    """``spark.read.format("corvane").option("connector", "package.module:Class")``."""

    @classmethod
    def name(cls) -> str:
        return "corvane"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        sent = options.pop("pickled", None)
        return _Reader((cloudpickle.loads(base64.b64decode(sent)) if sent else _named(options["connector"]))(options))


def _named(name: str) -> type[Connector]:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def connector(spark: SparkSession, name: str, **options: str) -> DataFrame:
    """uri, mime, text of an external system, read in the connector's own partitions."""
    spark.dataSource.register(ConnectorSource)
    sent = base64.b64encode(cloudpickle.dumps(_named(name))).decode()  # found here, so that workers need not
    return spark.read.format("corvane").option("connector", name).option("pickled", sent).options(**options).load()
