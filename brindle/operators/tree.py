"""Trees of nodes: a document's nested nodes as rows, and back.

A tree arrives as VARIANT or JSON in one row for each document.  A table function walks it once
with its own stack, so that trees may be of any depth and nothing is shuffled; every later step
(count, lookup, structure) works on rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import udtf

#: Fields of a node besides its children.
FIELDS = (("node_id", "string"), ("title", "string"), ("summary", "string"), ("source_locator", "string"), ("start_turn", "long"), ("end_turn", "long"), ("text", "string"))
PLACE = "position int, parent_position int, parent_id string, depth int, path array<int>"
NODE = PLACE + ", " + ", ".join(f"{n} {t}" for n, t in FIELDS)


@udtf(returnType=NODE)
class Walk:
    """Nodes of a JSON list in depth-first order, parents first; a node without a field raises."""

    def eval(self, nodes: str, name: str):
        if nodes is None:
            return
        roots, position = json.loads(nodes), 0
        if not isinstance(roots, list):
            raise ValueError(f"nodes of {name} are no list")
        stack = [(n, -1, None, (k,)) for k, n in reversed(list(enumerate(roots)))]
        while stack:
            node, parent, parent_id, path = stack.pop()
            missing = [f for f, _ in FIELDS if not isinstance(node, dict) or node.get(f) is None]
            if missing or not isinstance(node.get("nodes"), list):
                raise ValueError(f"a node of {name} has no {(missing or ['nodes'])[0]}")
            yield (position, parent, parent_id, len(path), list(path), *[node[f] for f, _ in FIELDS])
            children = list(enumerate(node["nodes"]))
            stack += [(n, position, node["node_id"], (*path, k)) for k, n in reversed(children)]
            position += 1


def flatten(docs: DataFrame, nodes: str = "nodes", key: str = "doc_id") -> DataFrame:
    """(key, position, parent_position, parent_id, depth, path, fields of a node) of all nodes.

    ``position`` is the depth-first place from 0, ``path`` the place among the siblings on each
    level, ``depth`` starts at 1; a root's parent has position -1 and no id.
    """
    kind = dict(docs.dtypes)[nodes]
    text = F.col(nodes) if kind == "string" else F.to_json(F.col(nodes))
    rows = docs.select(F.col(key).alias("_key"), text.alias("_nodes"))
    return rows.lateralJoin(Walk(F.col("_nodes").outer(), F.col("_key").cast("string").outer())).drop("_nodes").withColumnRenamed("_key", key)


def count(flat: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, nodes, depth): nodes of all levels and the deepest one."""
    return flat.groupBy(key).agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"))


def find(flat: DataFrame, node_id: str, key: str = "doc_id") -> DataFrame:
    """The first node with this id in each document, depth first."""
    rest = [c for c in flat.columns if c != key]
    first = F.min_by(F.struct(*rest), "position").alias("n")
    return flat.where(F.col("node_id") == node_id).groupBy(key).agg(first).select(key, "n.*")


def below(flat: DataFrame, node_id: str, key: str = "doc_id") -> DataFrame:
    """The node that ``find`` gives and all nodes below it."""
    top = find(flat, node_id, key).select(F.col(key).alias("_k"), F.col("path").alias("_p"))
    inside = F.slice("path", F.lit(1), F.size("_p")) == F.col("_p")
    return flat.join(top, (flat[key].eqNullSafe(F.col("_k"))) & inside).drop("_k", "_p")


def nested(flat: DataFrame, fields: tuple[str, ...], key: str = "doc_id") -> DataFrame:
    """(key, nodes): the trees as JSON again, with these fields of the nodes."""
    rows = F.array_sort(F.collect_list(F.struct("position", "parent_position", *fields)))
    return flat.groupBy(key).agg(rows.alias("rows")).select(key, grown(F.to_json("rows"), F.lit(json.dumps(fields))).alias("nodes"))


def structure(flat: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, nodes): the trees without texts."""
    return nested(flat, tuple(f for f, _ in FIELDS if f != "text"), key)


def grow(rows: str, fields: str) -> str:
    made, roots = {}, []
    for row in json.loads(rows):
        node = {f: row.get(f) for f in json.loads(fields)} | {"nodes": []}
        made[row["position"]] = node
        (roots if row["parent_position"] < 0 else made[row["parent_position"]]["nodes"]).append(node)
    return json.dumps(roots, ensure_ascii=False)


def grown(rows: Column, fields: Column) -> Column:
    """A list of rows in depth-first order as nested JSON: one Arrow call for each batch of documents."""
    return F.udf(grow, "string", useArrow=True)(rows, fields)
