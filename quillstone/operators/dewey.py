"""Shredding of nested JSON records into related flat tables by Dewey labels.

Every node of a record gets the path of ordinals that leads to it (its Dewey label): the place of a field among
its object's fields, the place of an element in its array.  A parent's label is its child's label cut by one, so
parent-child links need no bookkeeping; nodes of one schema path (field names, ``[]`` for any array element) form
one flat table.  Dots, brackets and backslashes inside a field name are written with a backslash, so a path has one meaning.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_FIELDS = "label array<int>, path string, kind string, members int, value string"


class _Number(str):
    """A number as it was written: no overflow, no rounding."""

    __slots__ = ()


def _constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(parse_float=_Number, parse_int=_Number, parse_constant=_constant)


_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|true|false|null")
_WORDS = {"true": True, "false": False, "null": None}


def read_deep(text: str) -> object:
    """The value of a JSON text nested to any depth, read with a stack of its own; ValueError where it isn't valid."""
    at, end = _SPACE.match(text, 0).end(), len(text)
    open_: list[tuple[object, str | None]] = []  # containers and the key each is waiting to fill
    key: str | None = None
    box: object = None
    while True:
        # A value begins at ``at``.
        c = text[at : at + 1]
        if c in ("{", "["):
            open_.append((box, key))
            box, key = ({} if c == "{" else []), None
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                value: object = box
                box, key = open_.pop()
                at += 1
            elif c == "[":
                continue
            else:
                key, at = _read_key(text, at)
                continue
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        else:
            m = _SCALAR.match(text, at)
            if not m:
                raise ValueError(f"no value at {at}")
            value, at = (_Number(m[1]) if m[1] else _WORDS[m[0]]), m.end()
        # The value is whole: put it away, and close what ends after it.
        while True:
            if box is None:
                if _SPACE.match(text, at).end() != end:
                    raise ValueError(f"more text at {at}")
                return value
            if isinstance(box, dict):
                box[key] = value
            else:
                box.append(value)
            at = _SPACE.match(text, at).end()
            c = text[at : at + 1]
            if c == ",":
                at = _SPACE.match(text, at + 1).end()
                if isinstance(box, dict):
                    key, at = _read_key(text, at)
                break
            if c != ("}" if isinstance(box, dict) else "]"):
                raise ValueError(f"no end at {at}")
            value, at = box, at + 1
            box, key = open_.pop()


def _read_key(text: str, at: int) -> tuple[str, int]:
    """A member's name and where its value begins."""
    if text[at : at + 1] != '"':
        raise ValueError(f"no name at {at}")
    key, at = scanstring(text, at + 1, True)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    return key, _SPACE.match(text, at + 1).end()


def parse_record(text: str | None) -> dict | None:
    """The object a text holds, nested to any depth, taken out of any number of JSON strings around it; None for anything else."""
    value: object = text
    while type(value) is str:
        bare = value.lstrip("\ufeff")
        try:
            value = _DECODER.decode(bare)
        except RecursionError:
            try:
                value = read_deep(bare)
            except ValueError:
                return None
        except ValueError:
            return None
    return value if isinstance(value, dict) else None


_SPECIAL = re.compile(r"[.\[\]\\]")


def step(path: str, key: str) -> str:
    """The schema path of a field of the object at ``path``."""
    return f"{path}.{_SPECIAL.sub(_escaped, key)}" if _SPECIAL.search(key) else f"{path}.{key}"


def _escaped(m: re.Match) -> str:
    return "\\" + m[0]


def walk(root: dict, wanted: frozenset[str] | None = None) -> Iterator[tuple[list[int], str, str, int, str | None]]:
    """(label, path, kind, members, value) of each node, depth first without recursion.

    ``wanted``: schema paths to emit; branches that lead to none of them are not entered.
    """
    opened = None if wanted is None else {p[:k] for p in wanted for k in range(len(p) + 1)}
    todo: list[tuple[list[int], str, object]] = [([], "$", root)]
    while todo:
        label, path, v = todo.pop()
        children: list[tuple[list[int], str, object]] = []
        if isinstance(v, dict):
            kind, members, value = "object", len(v), None
            for i, (k, x) in enumerate(v.items()):
                below = step(path, k)
                if opened is None or below in opened:
                    children.append(([*label, i], below, x))
        elif isinstance(v, list):
            kind, members, value = "array", len(v), None
            below = f"{path}[]"
            if opened is None or below in opened:
                children = [([*label, i], below, x) for i, x in enumerate(v)]
        else:
            members = 0
            if v is None:
                kind, value = "null", None
            elif isinstance(v, bool):
                kind, value = "boolean", "true" if v else "false"
            else:
                kind, value = ("number" if isinstance(v, _Number) else "string"), str(v)
        if wanted is None or path in wanted:
            yield label, path, kind, members, value
        todo.extend(reversed(children))


def shred(df: DataFrame, id_col: str, json_col: str, paths: Sequence[str] | None = None) -> DataFrame:
    """The node table (id, label, path, kind, members, value) of a JSON column.

    Records that hold no valid JSON object (null, empty, damaged, another type) give no nodes; JSON strings holding
    JSON are unwrapped however often.  A repeated key keeps its last value.  ``paths`` restricts the output to
    these schema paths and prunes the walk.  One pass, no shuffle; the nodes of a record stay in its partition.
    """
    wanted = None if paths is None else frozenset(paths)
    out = T.StructType([df.schema[id_col], *T._parse_datatype_string(NODE_FIELDS).fields])
    id_name = id_col

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            rows, nodes, size = [], [], 0

            def flush() -> pa.RecordBatch:
                label, path, kind, members, value = zip(*nodes)
                return pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int32())), pa.array(label, pa.list_(pa.int32())), pa.array(path, pa.string()), pa.array(kind, pa.string()), pa.array(members, pa.int32()), pa.array(value, pa.string())],
                    names=[id_name, "label", "path", "kind", "members", "value"],
                )

            for i, text in enumerate(texts):
                record = parse_record(text)
                for node in walk(record, wanted) if record is not None else ():
                    rows.append(i)
                    nodes.append(node)
                    size += 8 + len(node[0])
                    if size > 500_000:
                        yield flush()
                        rows, nodes, size = [], [], 0
            if nodes:
                yield flush()

    return df.select(F.col(id_col), F.col(json_col).cast("string").alias("_json")).mapInArrow(run, out)


def parent_label(label: Column) -> Column:
    """The parent's label: the node's own, cut by one (null for the root)."""
    return F.when(F.size(label) > 0, F.slice(label, 1, F.size(label) - 1))


def place(label: Column) -> Column:
    """The node's place among its siblings."""
    return F.element_at(label, -1)


def node_table(nodes: DataFrame, id_col: str, path: str, fields: Sequence[str]) -> DataFrame:
    """The flat table of one schema path's objects: id, label, parent, pos and one column a scalar field.

    Fields that are missing, null or no scalar are null.  The one shuffle groups by (id, parent label).
    """
    leaf = {f"{path}.{f}": f for f in fields}
    own = (F.col("path") == path) & (F.col("kind") == "object")
    scalar = F.col("path").isin(list(leaf)) & F.col("kind").isin("string", "number", "boolean")
    key = F.when(own, F.col("label")).otherwise(parent_label(F.col("label")))
    picked = nodes.filter(own | scalar).select(F.col(id_col), key.alias("label"), "path", "value", own.alias("own"))
    return (
        picked.groupBy(id_col, "label")
        .agg(F.max("own").alias("own"), *[F.max(F.when(F.col("path") == p, F.col("value"))).alias(f) for p, f in leaf.items()])
        .filter("own")
        .select(id_col, "label", parent_label(F.col("label")).alias("parent"), place(F.col("label")).alias("pos"), *fields)
    )


#: Child objects of a search response: node name, then the path of an element and that of a bare object.
CHILDREN = {
    "applicant": "$.applicant",
    "inventors": "$.inventors",
    "publishedDocuments": "$.publishedDocuments",
    "inventionTitle": "$.bibliographicData.inventionTitle",
    "ipcrClassification": "$.bibliographicData.ipcrClassification",
}


def child_objects(df: DataFrame, id_col: str = "rec_id", json_col: str = "response") -> DataFrame:
    """(id, node, pos) of the child objects with at least one member; pos counts every element of the array."""
    by_path = {p: (n, False) for n, p in CHILDREN.items()} | {f"{p}[]": (n, True) for n, p in CHILDREN.items()}
    nodes = shred(df, id_col, json_col, list(by_path)).filter("kind = 'object' AND members > 0")
    name = F.create_map(*[F.lit(x) for p, (n, _) in by_path.items() for x in (p, n)])
    return nodes.select(F.col(id_col), name[F.col("path")].alias("node"), F.when(F.col("path").endswith("[]"), place(F.col("label"))).otherwise(0).cast("long").alias("pos"))


#: Scalar fields of the child objects, and of the records by their path below the root.
FIELDS = {
    "applicant": ["legalEntityName"],
    "inventors": ["legalEntityName"],
    "publishedDocuments": ["documentTypeCode", "fileName", "abstractText", "claimsText"],
    "inventionTitle": ["title", "language"],
    "ipcrClassification": ["classificationText", "sequenceNumber"],
}
RECORD = ["ipRightStatusCode", "filedDate", "priorityDate", "expiryDate", "bibliographicData.applicationNumber", "bibliographicData.patentApplicationType"]


def child_table(df: DataFrame, node: str, id_col: str = "rec_id", json_col: str = "response") -> DataFrame:
    """The flat table of a child node's objects, empty ones too: id, label, parent, pos and its scalar fields.

    A field that holds an object itself counts as an array of it: pos 0, and its parent is the object it is in.
    """
    bare = CHILDREN[node]
    nodes = shred(df, id_col, json_col, [f"{p}{f}" for p in (bare, f"{bare}[]") for f in ("", *[f".{x}" for x in FIELDS[node]])])
    inside = F.substr("path", F.lit(len(bare) + 1))
    as_element = F.when(inside.startswith("[]"), F.col("path")).otherwise(F.concat(F.lit(f"{bare}[]"), inside))
    table = node_table(nodes.withColumn("path", as_element), id_col, f"{bare}[]", FIELDS[node])
    return table.withColumn("pos", F.when(F.size("label") > bare.count("."), F.col("pos")).otherwise(0))


def record_table(df: DataFrame, id_col: str = "rec_id", json_col: str = "response") -> DataFrame:
    """The flat table of the records that hold a JSON object: id and scalar fields, those of bibliographicData included."""
    leaf = {f"$.{f}": f.rpartition(".")[2] for f in RECORD}
    nodes = shred(df, id_col, json_col, ["$", *leaf])
    value = F.when(F.col("kind").isin("string", "number", "boolean"), F.col("value"))
    return nodes.groupBy(id_col).agg(*[F.max(F.when(F.col("path") == p, value)).alias(f) for p, f in leaf.items()])
