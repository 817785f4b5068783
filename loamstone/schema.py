"""The tables of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

CHUNK = T.StructType(
    [
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

HIT = T.StructType([*CHUNK.fields, T.StructField("_distance", T.DoubleType())])

TENANT = T.StructType(
    [
        T.StructField("tenant_id", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("api_key_hash", T.StringType()),
        T.StructField("max_requests_per_min", T.IntegerType()),
        T.StructField("max_chunks", T.LongType()),
        T.StructField("max_concurrent", T.IntegerType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("created", T.DoubleType()),
        T.StructField("table_suffix", T.StringType()),
    ]
)

#: What a tenant without limits of its own has.
TENANT_DEFAULTS = {"max_requests_per_min": 60, "max_chunks": 500_000, "max_concurrent": 50, "enabled": True}

FINDING = T.StructType(
    [T.StructField("severity", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("excerpt", T.StringType())]
)

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])

WIKI_PAGE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("revision", T.StructType([T.StructField("text", T.StringType())])),
    ]
)

#: Attributes of a post; the XML source prefixes attributes with an underscore.
POST = T.StructType([T.StructField(f"_{n}", T.StringType()) for n in ("Id", "PostTypeId", "Score", "Title", "Body", "Tags")])

API_ITEM = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("body", T.StringType()),
        T.StructField("votes", T.LongType()),
    ]
)

COLLECTOR_STATE = T.StructType(
    [
        T.StructField("wiki_queue", T.ArrayType(T.StringType())),
        T.StructField("wiki_done", T.ArrayType(T.StringType())),
        T.StructField("so_progress", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("man_done", T.ArrayType(T.StringType())),
        T.StructField("mdn_done", T.BooleanType()),
        T.StructField("so_key", T.StringType()),
        T.StructField("processed_dumps", T.ArrayType(T.StringType())),
        T.StructField("processed_se", T.ArrayType(T.StringType())),
        T.StructField("data_dir", T.StringType()),
    ]
)
