"""Walking one JSON value inside a task: leaves and records with their paths.

A walk keeps its own stack, so depth has no limit but the parser's.  It holds one document.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

ROWS = 256  # documents turned into Python values at once


class Number(str):
    """A number that is not whole, as it is spelled."""


def parse(text: str):
    return json.loads(text, parse_float=Number, parse_constant=Number)


def kind(value) -> str:
    """object, array, void, or the scalar type."""
    if isinstance(value, Number):
        return "double" if "E" in value or "e" in value else "decimal"
    names = {dict: "object", list: "array", type(None): "void", bool: "boolean", int: "bigint", str: "string"}
    return names[type(value)]


def spelled(value) -> str:
    """JSON text of a value."""
    out, todo = [], [(value, False)]
    while todo:
        v, ready = todo.pop()
        if ready or isinstance(v, Number):
            out.append(v)
        elif isinstance(v, (dict, list)):
            parts = []
            for item in v.items() if isinstance(v, dict) else ((None, x) for x in v):
                if parts:
                    parts.append((",", True))
                if item[0] is not None:
                    parts.append((json.dumps(item[0], ensure_ascii=False) + ":", True))
                parts.append((item[1], False))
            ends = "{}" if isinstance(v, dict) else "[]"
            todo += [(ends[1], True), *reversed(parts), (ends[0], True)]
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


def plain(value) -> str | None:
    """Text of a scalar without quotes; JSON text of a list or object; None for null."""
    if value is None or isinstance(value, str):
        return value
    return spelled(value)


def _inner(path: str, value) -> Iterator[tuple[str, object]]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield (f"{path}.{k}" if path else k), v
    else:
        for i, v in enumerate(value):
            yield f"{path}[{i}]", v


def leaves(value, max_list: int) -> Iterator[tuple[str, str | None, str]]:
    """(path, text, type) of scalars, and of lists of at most max_list scalars."""
    todo = [("", value)]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            todo += _inner(path, v)
        elif not isinstance(v, list) or len(v) <= max_list and not any(isinstance(x, (dict, list)) for x in v):
            yield path, plain(v), kind(v)


def records(value, names: list[list[str]], required: list[int]) -> Iterator[tuple]:
    """(path, texts of the named fields) of each object whose required fields are not null.

    names: the keys of each field; the first that the object has counts.
    """
    todo = [("", value)]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            found = [next((v[k] for k in keys if k in v), None) for keys in names]
            if all(found[i] is not None for i in required):
                yield path, *map(plain, found)
        if isinstance(v, (dict, list)):
            todo += _inner(path, v)


def _udf(walk, fields: list[str]):
    """Arrow UDF from JSON texts to arrays of structs of strings."""
    item = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    inner = pa.struct([pa.field(f, pa.string()) for f in fields])

    @arrow_udf(T.ArrayType(item))
    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(texts), ROWS):
            found = [[] if t is None else list(walk(parse(t))) for t in texts.slice(at, ROWS).to_pylist()]
            flat = [x for rows in found for x in rows]
            columns = [pa.array([x[i] for x in flat], pa.string()) for i in range(len(fields))]
            ends = [0]
            for rows in found:
                ends.append(ends[-1] + len(rows))
            parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(inner))))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(inner))

    return run


def leaves_udf(max_list: int):
    return _udf(lambda v: leaves(v, max_list), ["key", "value", "type"])


def records_udf(names: dict[str, list[str]], required: list[str]):
    keys, at = list(names.values()), [list(names).index(r) for r in required]
    return _udf(lambda v: records(v, keys, at), ["json_path", *names])
