"""Nested records to related flat tables: one depth-first pass emits table tag, key, parent key and payload, for objects and array members."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.packing import map_units, unpack


class Members(list):
    """The members of one object in order, repeated keys included."""


class Number(str):
    """A number as it is written: no digit is lost on the way."""


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(object_pairs_hook=Members, parse_constant=_refuse, parse_int=Number, parse_float=Number)
_WS = " \t\n\r"


def read_strict(text: str):
    """The value of a strictly valid JSON text, else ValueError. Objects come as Members, numbers as Number.

    Nesting beyond the interpreter's stack is read by the iterative reader below.
    """
    try:
        value, end = _DECODER.raw_decode(text, len(text) - len(text.lstrip(_WS)))
    except RecursionError:
        return _read_deep(text)
    if text[end:].strip(_WS):
        raise ValueError("text after the value")
    return value


def _read_deep(text: str):
    """As read_strict, with a stack of its own: any depth."""
    scalar, n, i = json.JSONDecoder(parse_constant=_refuse, parse_int=Number, parse_float=Number), len(text), 0
    root: list = []
    stack: list[tuple[object, str]] = [(root, "")]  # open containers, with the key that waits for a value
    want = "value"  # value, first (value or ]), name (name or }), next (, or close), more (name after comma)

    def skip(k: int) -> int:
        while k < n and text[k] in _WS:
            k += 1
        return k

    while True:
        i = skip(i)
        box, key = stack[-1]
        if want == "next" and len(stack) == 1:
            if i < n:
                raise ValueError("text after the value")
            return root[0]
        if i >= n:
            raise ValueError("text ends too early")
        c = text[i]
        if want in ("name", "more"):
            if c == "}" and want == "name":
                stack.pop()
                want, i = "next", i + 1
                continue
            if c != '"':
                raise ValueError("a name is missing")
            name, i = scalar.raw_decode(text, i)
            i = skip(i)
            if text[i : i + 1] != ":":
                raise ValueError("a colon is missing")
            stack[-1] = (box, name)
            want, i = "value", i + 1
        elif want == "next":
            closing = "}" if isinstance(box, Members) else "]"
            if c == closing:
                stack.pop()
            elif c == ",":
                want = "more" if closing == "}" else "value"
            else:
                raise ValueError("a comma is missing")
            i += 1
        elif want == "first" and c == "]":
            stack.pop()
            want, i = "next", i + 1
        else:
            if c in "{[":
                value: object = Members() if c == "{" else []
                i += 1
            else:
                value, i = scalar.raw_decode(text, i)
            box.append((key, value) if isinstance(box, Members) else value)
            want = "next"
            if c == "{":
                stack.append((value, ""))
                want = "name"
            elif c == "[":
                stack.append((value, ""))
                want = "first"


def _flat(value) -> bool:
    """Whether a value holds no object."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, Members):
            return False
        if isinstance(v, list):
            todo.extend(v)
    return True


def written(value) -> str:
    """A value without objects as JSON, numbers as they stood; any depth."""
    if not isinstance(value, list):
        return value if isinstance(value, Number) else json.dumps(value, ensure_ascii=False)
    out: list[str] = []
    todo: list = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            out.append("[")
            inner: list = [_Text("]")]
            for i, x in enumerate(reversed(v)):
                inner += [x, _Text(",")] if i + 1 < len(v) else [x]
            todo += inner
        else:
            out.append(v if isinstance(v, (Number, _Text)) else json.dumps(v, ensure_ascii=False))
    return "".join(out)


class _Text(str):
    """A sign of the notation."""


def _tag(members: Members, field: str) -> str:
    """The table of an object: its own @type (the first one), else the field it stands in."""
    kind = next((x for k, x in members if k == "@type"), None)
    if isinstance(kind, list) and not isinstance(kind, Members):
        kind = next((x for x in kind if type(x) is str), None)
    return kind if type(kind) is str and kind else field


def visit(value) -> Iterator[tuple]:
    """(node, parent node, tag, path, parent path, place, object, payload) of every object and every scalar in an array, depth first.

    node: number in the block; parent node: that of the nearest enclosing object. place: place in the innermost array. An object's payload
    holds its members without objects in them, a repeated key's last value; a scalar's is {"value": …}, its tag the object's and the field's.
    """
    stack, node = [(value, "$", "", None, "root", "root", None)], 0
    while stack:
        v, path, parent, above, field, tag, place = stack.pop()
        if isinstance(v, Members):
            own = _tag(v, field)
            kept = {k: x for k, x in v if _flat(x)}
            yield node, above, own, path, parent, place, True, "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{written(x)}" for k, x in kept.items()) + "}"
            stack.extend((x, f"{path}.{k}", path, node, k, f"{own}.{k}", None) for k, x in reversed(v) if isinstance(x, list))
            node += 1
        elif isinstance(v, list):
            stack.extend((x, f"{path}[{i}]", parent, above, field, tag, i) for i, x in reversed(list(enumerate(v))))
        else:
            yield node, above, tag, path, parent, place, False, f'{{"value":{written(v)}}}'
            node += 1


FIELDS = {"block": "int", "node": "int", "parent": "int", "tag": "string", "path": "string", "parent_path": "string", "place": "int", "object": "boolean", "payload": "string"}


def object_rows(blocks: list[str | None] | None) -> list[tuple]:
    """The rows of visit of all valid blocks, the block's place first; null and unreadable blocks give nothing."""
    out = []
    for b, text in enumerate(blocks or ()):
        if not text:
            continue
        try:
            value = read_strict(text)
        except ValueError:
            continue
        escaped = "\\ud" in text.lower()  # an escaped lone surrogate has no UTF-8 form
        for row in visit(value):
            out.append((b, *((x.encode("utf-8", "replace").decode() if isinstance(x, str) else x) for x in row)) if escaped else (b, *row))
    return out


def flatten_records(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row (key, block, node, parent, tag, path, parent_path, place, object, payload) per JSON object, and per scalar in an array, of an
    array column of JSON texts.

    (key, block, node) is the primary key, (key, block, parent) that of the object above. Null rows, null blocks and blocks that aren't
    strict JSON give no rows; empty objects give one; other columns are not read. Repeated deliveries count once; different deliveries
    under one key keep the rows of each.
    """
    rows = map_units(df.select(F.col(key).cast("bigint").alias(key), F.col(column)), key, FIELDS, lambda: object_rows)
    return unpack(rows, key)


def write_tables(records: DataFrame, path: str) -> None:
    """The flat tables, one folder a tag (partitioned write, no collecting of tags)."""
    records.write.partitionBy("tag").mode("overwrite").parquet(path)


def read_table(records: DataFrame, tag: str, schema: str) -> DataFrame:
    """One flat table: the rows of a tag with the payload read by a schema; its keys and its parent's stay beside it."""
    own = records.where(F.col("tag") == tag).withColumn("_p", F.from_json("payload", schema))
    return own.select(*[c for c in records.columns if c not in ("tag", "payload")], "_p.*")
