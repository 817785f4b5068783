"""Paged question and article APIs as a Spark data source.

The request itself is a function named by an option (`module:function`, taking
a topic and a page number and returning a list of items), so that the engine
has no network code of its own and tests bring theirs. Each topic is a
partition; pages are read until one is empty or the limit is reached. Topics named by the option `skip`, which are there already, are not asked for.

As a stream, each micro-batch is the next page of every topic, and the offset is the page that each topic has reached; so a restart asks
for no page again, but for those of a batch that was not committed. An empty page leaves its topic where it is, to be asked again
in a later batch. Pages are few and their rate is limited, so they are fetched one after the other by the driver.

    spark.dataSource.register(ApiSource)
    spark.read.format("topic_api").option("topics", "python,linux").option("fetch", "my.client:questions").load()
    spark.readStream.format("topic_api").option("topics", "python,linux").option("fetch", "my.client:questions").load()
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


class TopicPartition(InputPartition):
    def __init__(self, topic: str):
        super().__init__(topic)
        self.topic = topic


def _topics(options) -> list[str]:
    skip = set(options.get("skip", "").split(","))
    return list(dict.fromkeys(t for t in options.get("topics", "").split(",") if t and t not in skip))


def _items(fetch: str, topic: str, page: int) -> list[tuple]:
    """A page as rows; none if it is empty."""
    module, _, name = fetch.partition(":")
    found = getattr(importlib.import_module(module), name)(topic, page) or ()
    return [(topic, i.get("title"), i.get("tags") or [], i.get("body"), i.get("votes"), json.dumps(i)) for i in found]


class ApiReader(DataSourceReader):
    def __init__(self, options):
        self.topics = _topics(options)
        self.fetch, self.pages = options["fetch"], int(options.get("pages", "30"))

    def partitions(self) -> list[InputPartition]:
        return [TopicPartition(t) for t in self.topics]

    def read(self, partition: TopicPartition) -> Iterator[tuple]:
        for page in range(1, self.pages + 1):
            rows = _items(self.fetch, partition.topic, page)
            if not rows:
                return
            yield from rows


class ApiStreamReader(SimpleDataSourceStreamReader):
    """The offset has the last page of each topic that was read; a topic that it does not name begins with its first."""

    def __init__(self, options):
        self.topics = _topics(options)
        self.fetch, self.pages = options["fetch"], int(options.get("pages", "30"))

    def initialOffset(self) -> dict:
        return {}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], dict(start)
        for topic in self.topics:
            page = start.get(topic, 0) + 1
            if page <= self.pages and (found := _items(self.fetch, topic, page)):
                rows += found
                end[topic] = page
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A batch whose offsets were logged and that did not end: its pages again."""
        for topic, last in end.items():
            for page in range(start.get(topic, 0) + 1, last + 1):
                yield from _items(self.fetch, topic, page)


class ApiSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "topic_api"

    def schema(self) -> str:
        return "topic string, title string, tags array<string>, body string, votes long, raw string"

    def reader(self, schema) -> ApiReader:
        return ApiReader(self.options)

    def simpleStreamReader(self, schema) -> ApiStreamReader:
        return ApiStreamReader(self.options)


def best_of_topic(items: DataFrame, n: int = 20, votes: Column | None = None) -> DataFrame:
    """The n items of each topic with the most votes, ties by title."""
    order = F.desc("votes") if votes is None else votes.desc()
    rank = F.row_number().over(W.partitionBy("topic").orderBy(order, "title"))
    return items.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")
