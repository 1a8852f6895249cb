"""Nested text to typed tables: JSON objects, Python-literal lists, hits, custom dimensions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlab.functions.columns import ColumnLike, col
from sessionlab.functions.literals import parse_pyliteral, pyliteral_variant, strip_sentinel
from sessionlab.operators.cleaning import quoted


# --- JSON object columns ----------------------------------------------------------------------------

def json_flatten(df: DataFrame, schemas: Mapping[str, T.StructType], sep: str = ".",
                 prefixed: bool = False) -> DataFrame:
    """Parse JSON text columns, put their keys in as columns and drop the sources. Nested keys are joined
    with ``sep``; with ``prefixed`` each name starts with its source column."""
    parsed = df.withColumns({c: F.from_json(quoted(c), s) for c, s in schemas.items()})
    keep = [quoted(c) for c in df.columns if c not in schemas]
    leaves = []
    for c, schema in schemas.items():
        leaves += _leaves(quoted(c), schema, c if prefixed else "", sep)
    return parsed.select(*keep, *[value.alias(name) for name, value in leaves])


def json_flatten_prefixed(df: DataFrame, schemas: Mapping[str, T.StructType], sep: str = "_") -> DataFrame:
    return json_flatten(df, schemas, sep, prefixed=True)


def struct_flatten(df: DataFrame, column: str, sep: str = "_", prefix: str | None = None) -> DataFrame:
    """Replace a struct column by its leaf fields, at any depth."""
    leaves = _leaves(quoted(column), df.schema[column].dataType, column if prefix is None else prefix, sep)
    keep = [quoted(c) for c in df.columns if c != column]
    return df.select(*keep, *[value.alias(name) for name, value in leaves])


def json_normalize(df: DataFrame, column: str) -> DataFrame:
    """Recursive flatten with dotted names and no prefix; arrays stay arrays."""
    return struct_flatten(df, column, sep=".", prefix="")


def _leaves(value: Column, schema: T.StructType, prefix: str, sep: str) -> list[tuple[str, Column]]:
    out = []
    for field in schema.fields:
        name = f"{prefix}{sep}{field.name}" if prefix else field.name
        child = value.getField(field.name)
        if isinstance(field.dataType, T.StructType):
            out += _leaves(child, field.dataType, name, sep)
        else:
            out.append((name, child))
    return out


def json_infer_schema(df: DataFrame, column: str) -> T.StructType:
    """Union of all keys seen in the whole column, with merged types: one mergeable aggregate."""
    text = df.agg(F.schema_of_variant_agg(F.try_parse_json(quoted(column))).alias("s")).first()["s"]
    return _json_types(T.DataType.fromDDL(_VARIANT_TYPES.sub(lambda m: _AS_DDL.get(m[0], m[0]), text)))


# Type names of the variant schema, apart from the same words as keys: keys are quoted or stand before a colon.
_VARIANT_TYPES = re.compile(r"`(?:[^`]|``)*`|\b(?:OBJECT|VOID|VARIANT)\b(?!\s*:)")
_AS_DDL = {"OBJECT": "STRUCT", "VOID": "STRING", "VARIANT": "STRING"}


def _json_types(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _json_types(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_json_types(kind.elementType))
    return T.DoubleType() if isinstance(kind, T.DecimalType) else kind


def json_strip_sentinel(df: DataFrame, columns: Sequence[str], sentinel: str) -> DataFrame:
    return df.withColumns({c: strip_sentinel(quoted(c), sentinel) for c in columns})


def infer_sentinel_stripped(df: DataFrame, column: str, sentinel: str) -> DataFrame:
    """Strip placeholder pairs, then parse with the schema that is left."""
    cleaned = json_strip_sentinel(df, [column], sentinel)
    return json_flatten(cleaned, {column: json_infer_schema(cleaned, column)})


# --- Python literals --------------------------------------------------------------------------------

def literal_eval(df: DataFrame, column: str, schema: T.DataType) -> DataFrame:
    """Text holding a Python literal to a typed column."""
    return df.withColumn(column, parse_pyliteral(quoted(column), schema))


def literal_infer_schema(df: DataFrame, column: str) -> T.DataType:
    """Union of all keys in a whole column of Python literals, with merged types: one mergeable aggregate. Lists and objects
    that are empty in all rows are left out; a key that is always None is text."""
    return variant_kind(df.agg(F.schema_of_variant_agg(pyliteral_variant(quoted(column))).alias("s")).first()["s"])


def variant_kind(schema: str | None) -> T.DataType:
    """The type that ``schema_of_variant_agg`` describes; what has no content in any row is left out, or text as a whole."""
    words = _AS_DDL | {"VOID": "VOID"}
    kind = T.DataType.fromDDL(_VARIANT_TYPES.sub(lambda m: words.get(m[0], m[0]), schema or "VOID"))
    return _with_content(kind) or T.StringType()


def variant_as(c: ColumnLike, kind: T.DataType) -> Column:
    """A VARIANT as a typed value; a part that does not fit its type is NULL."""
    return F.try_variant_get(col(c), "$", kind.simpleString())


def leaf_columns(value: Column, schema: T.StructType, taken: set[str], source: str, sep: str = "_") -> list[Column]:
    """The leaves of a struct as columns named by their keys. A name that is taken gets the source's name in front; lists
    are left out. ``taken`` grows by the names."""
    out = []
    for name, leaf in _leaves(value, schema, "", sep):
        named = name if name not in taken else f"{source}{sep}{name}"
        if named not in taken and not isinstance(_leaf_type(schema, name, sep), T.ArrayType):
            taken.add(named)
            out.append(leaf.alias(named))
    return out


def _leaf_type(schema: T.StructType, name: str, sep: str) -> T.DataType | None:
    for f in schema.fields:
        if f.name == name and not isinstance(f.dataType, T.StructType):
            return f.dataType
        if isinstance(f.dataType, T.StructType) and name.startswith(f.name + sep):
            found = _leaf_type(f.dataType, name[len(f.name) + len(sep):], sep)
            if found is not None:
                return found
    return None


def _with_content(kind: T.DataType) -> T.DataType | None:
    if isinstance(kind, T.StructType):
        kinds = {f.name: T.StringType() if isinstance(f.dataType, T.NullType) else _with_content(f.dataType) for f in kind.fields}
        return T.StructType([T.StructField(n, k) for n, k in kinds.items() if k is not None]) if any(kinds.values()) else None
    if isinstance(kind, T.ArrayType):
        inner = _with_content(kind.elementType)
        return None if inner is None else T.ArrayType(inner)
    return None if isinstance(kind, T.NullType) else _json_types(kind)


def merged_schema(declared: T.DataType, seen: T.DataType) -> T.DataType:
    """Declared fields with their declared types, then the other fields seen, at every depth."""
    if isinstance(declared, T.ArrayType) and isinstance(seen, T.ArrayType):
        return T.ArrayType(merged_schema(declared.elementType, seen.elementType))
    if not (isinstance(declared, T.StructType) and isinstance(seen, T.StructType)):
        return declared
    more = {f.name: f.dataType for f in seen.fields}
    both = [T.StructField(f.name, merged_schema(f.dataType, more.pop(f.name, f.dataType))) for f in declared.fields]
    return T.StructType(both + [T.StructField(n, k) for n, k in more.items()])


def json_normalize_union(df: DataFrame, column: str) -> DataFrame:
    """``json_normalize`` of Python-literal text by all keys that occur in any row; a row without a key has NULL."""
    return json_normalize(literal_eval(df, column, literal_infer_schema(df, column)), column)


def empty_array_default(c: ColumnLike) -> Column:
    """``[]`` as ``[{}]``: an array with one empty element, so that every row survives an explode."""
    c = col(c)
    return F.when(F.size(c) == 0, F.array(F.get(c, F.lit(0)))).otherwise(c)


def array_first(c: ColumnLike) -> Column:
    """First element, or NULL for an empty or missing array."""
    return F.get(col(c), F.lit(0))


def array_field_list(c: ColumnLike, field: str) -> Column:
    """One field of every element; an empty array when the input is missing."""
    return F.coalesce(F.transform(col(c), lambda e: e.getField(field)), F.array().cast("array<string>"))


def drop_null_nested(df: DataFrame, *columns: str) -> DataFrame:
    """Keep rows whose listed arrays all have a first element."""
    for c in columns:
        df = df.filter(F.size(quoted(c)) > 0)
    return df


# --- hits and custom dimensions ---------------------------------------------------------------------

# Hit fields collected per session, result name -> path inside a hit.
HIT_PATHS = {
    "page_title": "page.pageTitle",
    "page_path_2": "page.pagePathLevel2",
    "page_path_3": "page.pagePathLevel3",
    "hit_number": "hitNumber",
    "hit_time": "time",
    "hit_hour": "hour",
    "hit_minute": "minute",
    "hit_interaction": "isInteraction",
    "hit_entrance": "isEntrance",
    "hit_exit": "isExit",
    "hit_type": "type",
    "hit_data_source": "dataSource",
    "screen_name": "appInfo.screenName",
    "landing_screen_name": "appInfo.landingScreenName",
    "exit_screen_name": "appInfo.exitScreenName",
    "transaction_currency": "transaction.currencyCode",
    "item_currency": "item.currencyCode",
    "social_network": "social.socialNetwork",
    "social_referral": "social.hasSocialSourceReferral",
    "social_action": "social.socialInteractionNetworkAction",
    "action_type": "eCommerceAction.action_type",
    "action_step": "eCommerceAction.step",
}


def hits_explode(df: DataFrame, hits: str, keys: Sequence[str], prefix: str = "hits_") -> DataFrame:
    """One row per hit: ``key`` (the key columns joined with _), ``hit_pos`` and the hit's own fields with
    a prefix, nested ones dotted into the name with _. Sessions without hits keep one row. Rows multiply
    inside the scan task; nothing is shuffled."""
    key = F.concat_ws("_", *[quoted(k).cast("string") for k in keys]).alias("key")
    rows = df.select(key, F.posexplode_outer(quoted(hits)).alias("hit_pos", "_hit"))
    flat = _leaves(F.col("_hit"), df.schema[hits].dataType.elementType, "", "_")
    return rows.select("key", "hit_pos", *[value.alias(prefix + name) for name, value in flat])


def hits_pluck(df: DataFrame, hits: str, paths: Mapping[str, str] = HIT_PATHS) -> DataFrame:
    """Per session, one array per hit field."""
    out = {}
    for name, path in paths.items():
        value = quoted(hits)
        for part in path.split("."):
            value = value.getField(part)
        out[name] = value
    return df.withColumns(out)


def product_pluck(df: DataFrame, hits: str, fields: Sequence[str], prefix: str = "product_",
                  inner: str = "product", flat: bool = False) -> DataFrame:
    """Per session, an array (over hits) of arrays (over products); flattened on request."""
    out = {}
    for field in fields:
        nested = F.transform(quoted(hits), _inner_field(inner, field))
        if flat:
            nested = F.flatten(F.filter(nested, lambda a: a.isNotNull()))
        out[prefix + field] = nested
    return df.withColumns(out)


def _inner_field(inner: str, field: str):
    # one argument only: a second one would receive the element's position
    return lambda hit: hit.getField(inner).getField(field)


def promotion_pluck(df: DataFrame, hits: str, fields: Sequence[str], flat: bool = False) -> DataFrame:
    return product_pluck(df, hits, fields, "promotion_", "promotion", flat)


def dimension_explode(df: DataFrame, column: str, index: str = "cD_index", value: str = "cD_value") -> DataFrame:
    """One row per custom dimension; sessions without any keep one row with NULLs."""
    rows = df.select("*", F.explode_outer(quoted(column)).alias("_d"))
    return rows.withColumns({index: F.col("_d.index"), value: F.col("_d.value")}).drop("_d", column)


def dimension_first(df: DataFrame, column: str, index: str = "cD_index", value: str = "cD_value") -> DataFrame:
    """First custom dimension in place of the array; the row count does not change."""
    first = array_first(quoted(column))
    return df.withColumns({index: first.getField("index"), value: first.getField("value")}).drop(column)
