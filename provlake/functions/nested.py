"""Leaves of nested values: typed ones by a walk over the schema on the driver, VARIANT ones by bounded explosion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provlake.errors import ConfigError
from provlake.schema import DEFAULT_DEPTH, MOST_DEPTH

LEAVES = (T.StringType, T.BinaryType)


def depth_of(text: str | None) -> int:
    """The recursion depth of a setting: 1 to 10, 4 by default."""
    if text is None or text == "":
        return DEFAULT_DEPTH
    if not text.isdigit() or not 1 <= int(text) <= MOST_DEPTH:
        raise ConfigError(f"depth {text!r} is not a whole number from 1 to {MOST_DEPTH}")
    return int(text)


def is_container(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.ArrayType, T.MapType))


def leaf_paths(kind: T.DataType, depth: int | None = DEFAULT_DEPTH) -> Iterator[tuple[str, ...]]:
    """Paths of the text and bytes leaves of a type; [] an element, {} a value and {k} a key of a map. A container at
    depth 0 yields nothing; None has no bound."""
    if not is_container(kind):
        if isinstance(kind, LEAVES):
            yield ()
        return
    if depth is not None and depth <= 0:
        return
    below = None if depth is None else depth - 1
    if isinstance(kind, T.StructType):
        parts = [(f.name, f.dataType) for f in kind.fields]
    elif isinstance(kind, T.ArrayType):
        parts = [("[]", kind.elementType)]
    else:
        parts = [("{k}", kind.keyType), ("{}", kind.valueType)]
    for name, part in parts:
        for rest in leaf_paths(part, below):
            yield (name, *rest)


def collect_leaves(value: Column, kind: T.DataType, depth: int | None = DEFAULT_DEPTH) -> Column:
    """The text leaves of a typed value as one array, in walk order: keys before values, fields as declared."""
    empty = F.array().cast("array<string>")
    if not is_container(kind):
        if isinstance(kind, LEAVES):
            return F.when(value.isNotNull(), F.array(value.cast("string"))).otherwise(empty)
        return empty
    if depth is not None and depth <= 0:
        return empty
    below = None if depth is None else depth - 1
    if isinstance(kind, T.StructType):
        parts = [collect_leaves(value[f.name], f.dataType, below) for f in kind.fields]
        got = F.concat(*parts) if parts else empty
    elif isinstance(kind, T.ArrayType):
        got = F.flatten(F.transform(value, lambda x: collect_leaves(x, kind.elementType, below)))
    else:
        got = F.flatten(
            F.transform(
                F.map_entries(value),
                lambda e: F.concat(collect_leaves(e["key"], kind.keyType, below), collect_leaves(e["value"], kind.valueType, below)),
            )
        )
    return F.coalesce(got, empty)


def map_leaves(value: Column, kind: T.DataType, fn: Callable[[Column], Column], depth: int | None = DEFAULT_DEPTH) -> Column:
    """The same shape with fn applied to each text or bytes leaf; what lies below the bound stays unchanged."""
    if not is_container(kind):
        return fn(value) if isinstance(kind, LEAVES) else value
    if depth is not None and depth <= 0:
        return value
    below = None if depth is None else depth - 1
    if isinstance(kind, T.StructType):
        made = F.struct(*[map_leaves(value[f.name], f.dataType, fn, below).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: map_leaves(x, kind.elementType, fn, below))
    return F.map_from_entries(
        F.transform(
            F.map_entries(value),
            lambda e: F.struct(map_leaves(e["key"], kind.keyType, fn, below), map_leaves(e["value"], kind.valueType, fn, below)),
        )
    )


def path_step(key: Column) -> Column:
    """A key as a step of a path: .key, or quoted where it is no plain name, so that no two places share a path. (A key
    with quotes of both kinds has none that VARIANT functions can follow.)"""
    double, single = F.contains(key, F.lit('"')), F.contains(key, F.lit("'"))
    quoted = F.when(~double, F.concat(F.lit('["'), key, F.lit('"]'))).when(~single, F.concat(F.lit("['"), key, F.lit("']")))
    quoted = quoted.otherwise(F.concat(F.lit('["'), F.replace(key, F.lit('"'), F.lit('\\"')), F.lit('"]')))
    return F.when(key.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z"), F.concat(F.lit("."), key)).otherwise(quoted)


NODES = "array<struct<path:string,v:variant>>"


def _below(node: Column) -> Column:
    """The members of an object or the elements of a list, with their paths; none of anything else."""
    stated = F.schema_of_variant(node["v"])
    members = F.map_entries(F.when(stated.startswith("OBJECT"), F.try_variant_get(node["v"], "$", "map<string,variant>")))
    members = F.transform(members, lambda e: F.struct(F.concat(node["path"], path_step(e["key"])).alias("path"), e["value"].alias("v")))
    elements = F.when(stated.startswith("ARRAY"), F.try_variant_get(node["v"], "$", "array<variant>"))
    place = lambda x, k: F.struct(F.concat(node["path"], F.lit("["), k.cast("string"), F.lit("]")).alias("path"), x.alias("v"))
    return F.coalesce(members, F.transform(elements, place), F.array().cast(NODES))


def with_leaves(df: DataFrame, column: str, name: str, depth: int = DEFAULT_DEPTH) -> DataFrame:
    """df with `name`, ARRAY<STRUCT<path, text>>: the text leaves of a VARIANT column, down to so many container levels."""
    out = df.withColumn("__level", F.array(F.struct(F.lit("$").alias("path"), F.col(column).alias("v"))).cast(NODES))
    out = out.withColumn(name, F.array().cast("array<struct<path:string,text:string>>"))
    for k in range(min(depth, MOST_DEPTH) + 1):
        texts = F.filter("__level", lambda n: F.coalesce(F.schema_of_variant(n["v"]) == "STRING", F.lit(False)))
        leaf = lambda n: F.struct(n["path"].alias("path"), F.try_variant_get(n["v"], "$", "string").alias("text"))
        out = out.withColumn(name, F.concat(name, F.transform(texts, leaf)))
        if k < min(depth, MOST_DEPTH):
            out = out.withColumn("__level", F.flatten(F.transform("__level", _below)))
    return out.drop("__level")


def explode_variant(df: DataFrame, column: str, keys: list[str], depth: int = DEFAULT_DEPTH) -> DataFrame:
    """(keys, path, text) for each text leaf of a VARIANT column, down to so many container levels, in one scan."""
    found = with_leaves(df.select(*keys, F.col(column).alias("__v")), "__v", "__leaves", depth)
    return found.select(*keys, F.explode("__leaves").alias("__leaf")).select(*keys, "__leaf.path", "__leaf.text")


def replace_at(document: Column, path: list[str | int], value: Column) -> Column:
    """A JSON text with the value (JSON text) put at a path of keys and positions; NULL where the path leads nowhere."""

    def put(v: Column, steps: list[str | int]) -> Column:
        if not steps:
            return F.try_parse_json(value)
        step, rest = steps[0], steps[1:]
        if isinstance(step, int):
            items = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
            put_one = F.transform(items, lambda x, k: F.when(k == step, put(x, rest)).otherwise(x))
            return F.when(F.size(items) > step, F.when(put(F.get(items, F.lit(step)), rest).isNotNull(), put_one.cast("variant")))
        members = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>"))
        inner = put(F.element_at(members, F.lit(step)), rest)
        changed = F.transform_values(members, lambda k, x: F.when(k == step, put(x, rest)).otherwise(x))
        return F.when(F.map_contains_key(members, F.lit(step)) & inner.isNotNull(), F.to_variant_object(changed))

    return F.to_json(put(F.try_parse_json(document), path))
