"""Profiles and ground truth from CSV, JSON lines, Parquet or any DataFrame.

A profile is ``(id, source_id, original_id, attributes)``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import with_position

PREVIEW = 100


def to_attributes(df: DataFrame, exclude: tuple[str, ...] = (), explode: bool = False, separator: str = ",") -> Column:
    """Every column with a value as an attribute; list columns and, if asked for, separated strings give one each value."""
    parts = []
    for field in df.schema.fields:
        if field.name.lower() in exclude:
            continue
        column, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        if kind == "array":
            values = F.transform(column, lambda v: v.cast("string"))
        elif explode and kind == "string":
            values = F.split(column, f"\\Q{separator}\\E")
        else:
            values = F.array(column.cast("string"))
        one = lambda name: lambda v: F.struct(F.lit(name).alias("key"), v.alias("value"))
        parts.append(F.when(column.isNull(), F.array().cast("array<struct<key:string,value:string>>")).otherwise(F.transform(F.filter(values, lambda v: v.isNotNull()), one(field.name))))
    return F.concat(*parts) if parts else F.array().cast("array<struct<key:string,value:string>>")


def to_profiles(df: DataFrame, id_column: str | None = None, real_id: str | None = None, source_id: int = 0, start: int = 0, explode: bool = False, separator: str = ",") -> DataFrame:
    """Profiles of a table. ``id_column`` is a unique number; without one, rows are numbered in the order of their contents."""
    names = {c.lower(): c for c in df.columns}
    real = names.get((real_id or "").lower())
    skip = tuple(c.lower() for c in (id_column, real) if c)
    rows = df.select(
        *([F.col(f"`{id_column}`").cast("long").alias("id")] if id_column else []),
        F.lit(source_id).alias("source_id"),
        (F.trim(F.col(f"`{real}`").cast("string")) if real else F.lit("")).alias("original_id"),
        to_attributes(df, skip, explode, separator).alias("attributes"),
    )
    if not id_column:
        rows = with_position(rows, ["original_id", F.to_json("attributes")], "id").withColumn("id", F.col("id") + start)
    return rows.select("id", "source_id", "original_id", "attributes")


def read_csv(spark: SparkSession, path: str, separator: str = ",", header: bool = False, real_id: str = "", source_id: int = 0, start: int = 0, explode: bool = False, inner_separator: str = ",", id_column: str | None = None) -> DataFrame:
    df = spark.read.csv(path, sep=separator, header=header)
    return to_profiles(df, id_column, real_id or None, source_id, start, explode, inner_separator)


def json_depth(text: Column) -> Column:
    """How many objects and arrays are open at once at most; brackets inside strings don't count."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    zero = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["open"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("open"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(marks, zero, step, lambda acc: acc["most"])


def flatten_json(text: Column, keep: tuple[str, ...] = ()) -> Column:
    """Leaves of a JSON object as attributes named by the nearest object key, at any depth.

    ``keep`` picks top-level fields. Each round opens every object and array that is there, in place; a text takes
    as many rounds as it is deep.
    """

    def opened(e: Column) -> Column:
        kind = F.schema_of_variant(e["value"])
        fields = F.transform(F.map_entries(F.try_variant_get(e["value"], "$", "map<string,variant>")), lambda f: F.struct(f["key"].alias("key"), f["value"].alias("value")))
        items = F.transform(F.try_variant_get(e["value"], "$", "array<variant>"), lambda v: F.struct(e["key"].alias("key"), v.alias("value")))
        return F.when(kind.startswith("OBJECT"), fields).when(kind.startswith("ARRAY"), items).otherwise(F.array(e))

    top = F.transform(F.map_entries(F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")), lambda f: F.struct(f["key"].alias("key"), f["value"].alias("value")))
    chosen = F.filter(top, lambda e: e["key"].isin(list(keep))) if keep else top
    rounds = F.when(json_depth(text) > 1, F.sequence(F.lit(2), F.greatest(json_depth(text), F.lit(2)))).otherwise(F.array().cast("array<int>"))
    leaves = F.aggregate(rounds, chosen, lambda acc, _: F.flatten(F.transform(acc, opened)))
    return F.transform(leaves, lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.try_variant_get(e["value"], "$", "string"), F.lit("null")).alias("value")))


def read_json(spark: SparkSession, path: str, real_id: str = "", source_id: int = 0, start: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Profiles of a file with one JSON object a line."""
    rows = spark.read.text(path).select(flatten_json(F.col("value"), (*keep, real_id) if keep and real_id else keep).alias("a"))
    real = F.array_join(F.transform(F.filter("a", lambda x: x["key"] == real_id), lambda x: x["value"]), "") if real_id else F.lit("")
    rows = rows.select(F.lit(source_id).alias("source_id"), real.alias("original_id"), F.filter("a", lambda x: x["key"] != real_id).alias("attributes"))
    rows = with_position(rows, ["original_id", F.to_json("attributes")], "id")
    return rows.select((F.col("id") + start).alias("id"), "source_id", "original_id", "attributes")


def read_parquet(spark: SparkSession, path: str, source_id: int = 0, start: int = 0, **options) -> DataFrame:
    return to_profiles(spark.read.parquet(path), source_id=source_id, start=start, **options)


def read_ground_truth_csv(spark: SparkSession, path: str, separator: str = ",", header: bool = True) -> DataFrame:
    df = spark.read.csv(path, sep=separator, header=header)
    a, b = df.columns[:2]
    return df.select(F.col(f"`{a}`").alias("original_id1"), F.col(f"`{b}`").alias("original_id2"))


def read_ground_truth_json(spark: SparkSession, path: str, first: str, second: str) -> DataFrame:
    value = lambda f: F.get_json_object("value", f"$.{f}")
    return spark.read.text(path).select(value(first).alias("original_id1"), value(second).alias("original_id2"))


def field_text(profiles: DataFrame, field: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, text): the values of one field, or of all, in lower case; blank ones are left out. ``keep`` names columns that stay beside them."""
    from ..functions.keys import attribute_values

    every = F.array_join(F.transform("attributes", lambda a: a["value"]), " ")
    text = F.lower(attribute_values(F.col("attributes"), field) if field else every)
    return profiles.select("id", *keep, text.alias("text")).where(F.trim("text") != "")


def preview(spark: SparkSession, path: str, rows: int = PREVIEW, **options) -> DataFrame:
    """The first profiles of a file, by its ending."""
    kind = os.path.splitext(path.rstrip("/"))[1]
    reader = {".csv": read_csv, ".json": read_json, ".parquet": read_parquet}.get(kind)
    if reader is None:
        raise ValueError(f"no reader for {path}")
    return reader(spark, path, **options).orderBy("id").limit(rows)


def preview_ground_truth(spark: SparkSession, path: str, rows: int = PREVIEW, **options) -> DataFrame:
    """The first pairs of a ground truth file, by its ending and in the order of their ids; JSON takes the names of its two fields."""
    kind = os.path.splitext(path.rstrip("/"))[1]
    reader = {".csv": read_ground_truth_csv, ".json": read_ground_truth_json}.get(kind)
    if reader is None:
        raise ValueError(f"no reader for {path}")
    return reader(spark, path, **options).orderBy("original_id1", "original_id2").limit(rows)


def union_sources(*profiles: DataFrame) -> DataFrame:
    """Profiles of several sources; each gets its place as source_id, and ids that follow the ones before."""
    out, start = None, 0
    for n, p in enumerate(profiles):
        q = p.withColumns({"source_id": F.lit(n), "id": F.col("id") + start})
        top = q.agg(F.max("id")).first()[0]
        start = start if top is None else top + 1
        out = q if out is None else out.unionByName(q)
    return out


