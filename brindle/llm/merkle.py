"""Merkle manifest of a dataset: built bottom-up, proofs pushed top-down.

Leaves are digests of rows.  Within a group (here a language) they ascend by key; every two
consecutive nodes (the last run: fewer, even one) become their digest until one is left, the
group's subroot.  The subroots, in order of their groups, make the root likewise.

Upwards, ``STEP`` tree levels are built for each persisted table: its rows are blocks of
``2 ** STEP`` consecutive nodes, so a group of any size meets in blocks only, and no window or
task sees a whole group.  Downwards, the rows of a table join those of the table above: a block
takes over the proof suffix of its own node, and each child prepends its siblings inside of the
block.  Everything is Column expressions.

Defined results: a null value counts as ``-``, a null key or group comes first, equal keys go by
their leaf (so equal rows are neighbours with equal leaves and proofs of their own), an empty
table gives no rows.  Columns other than the named ones are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut, drop

#: Tree levels for each persisted table.
STEP = 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns, changed: dict[str, Column] | None = None) -> Column:
    """The digest of a row; ``changed`` has other values for some of its columns."""
    return digest(*[field((changed or {}).get(c, F.col(c))) for c in columns])


def places(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds ``pos``, the place of a row in its group from 0, and ``n``, the rows of the group.

    Rows are dealt by ranges and sorted there; a row's place is that in its range and what the
    ranges before hold of its group.  The table of these counts has at most one row for each
    range and each group.  ``rows`` has been written, so its ranges come from narrow rows.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ranged = cut(ranged.withColumn("_at", F.monotonically_increasing_id()), "merkle-sorted")
    part = F.shiftright("_at", 33)
    held = ranged.groupBy(F.col(group).alias("_g"), part.alias("_p")).agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
    own = W.partitionBy("_g")
    before = F.sum("_c").over(own.orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    held = held.select("_g", "_p", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_c").over(own).alias("n"))
    both = ranged.join(held, ranged[group].eqNullSafe(held["_g"]) & (part == held["_p"]))
    out = both.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n")
    out.cut_path = ranged.cut_path
    return out


def above(nodes: Column) -> Column:
    """The digests of every two consecutive nodes."""
    pairs = F.sequence(F.lit(0), F.shiftright(F.size(nodes) - 1, 1))
    return F.transform(pairs, lambda k: digest(F.get(nodes, 2 * k), F.coalesce(F.get(nodes, 2 * k + 1), F.lit(""))))


def with_levels(blocks: DataFrame, step: int) -> DataFrame:
    """Adds ``l0`` … ``l<step>``: the nodes of a block and the levels above them."""
    out = blocks.withColumn("l0", F.transform("nodes", lambda x: x["node"]))
    for k in range(step):
        out = out.withColumn(f"l{k + 1}", above(F.col(f"l{k}")))
    return out


def blocks_of(rows: DataFrame, step: int, *carried: str) -> DataFrame:
    """(g, block, n, levels, nodes, up): runs of ``2 ** step`` places with their common node.

    ``levels`` is how many tree levels the block climbs: fewer than ``step`` only where a
    group ends in one node.
    """
    nodes = F.array_sort(F.collect_list(F.struct("pos", "node", *carried)))
    grouped = rows.groupBy("g", F.shiftright("pos", step).alias("block")).agg(F.first("n").alias("n"), nodes.alias("nodes"))
    depth = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    grouped = grouped.withColumn("levels", F.least(depth, F.lit(step)).cast("int"))
    up = F.get(F.element_at(F.array(*[F.col(f"l{k}") for k in range(step + 1)]), F.col("levels") + 1), F.lit(0))
    return with_levels(grouped, step).select("g", "block", "n", "levels", "nodes", up.alias("up"))


def climb(rows: DataFrame, step: int, *carried: str) -> tuple[list[DataFrame], DataFrame]:
    """The persisted tables from the leaves up, and (g, top): the last node of each group.

    ``rows`` has (g, pos, n, node); ``carried`` columns stay with the leaves.
    """
    tables, tops, most = [], [], None
    while most is None or most > 1:
        table = cut(blocks_of(rows, step, *(carried if not tables else ())), "merkle-level")
        tables.append(table)
        tops.append(table.where(F.col("n") <= (1 << step)).select("g", F.col("up").alias("top")))
        rows = table.where(F.col("n") > (1 << step)).select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / (1 << step)).alias("n"), F.col("up").alias("node"))
        most = rows.agg(F.max("n")).first()[0] or 0
    return tables, reduce(DataFrame.unionByName, tops)


def pushed(blocks: DataFrame, step: int) -> DataFrame:
    """One row for each child of blocks that have a proof suffix: its siblings go before it.

    A proof is a list of (left, right): the sibling's digest on its side, empty elsewhere.
    """
    rest = [c for c in blocks.columns if c not in ("g", "block", "n", "levels", "nodes", "up", "proof")]
    held = with_levels(blocks, step).select("g", "proof", "levels", *rest, *[f"l{k}" for k in range(step)], F.posexplode("nodes").alias("i", "x"))

    def pair(k: int) -> Column:
        mine = F.shiftright("i", k)
        other = F.coalesce(F.get(F.col(f"l{k}"), mine.bitwiseXOR(F.lit(1))), F.lit(""))
        right = mine.bitwiseAND(F.lit(1)) == 0
        return F.struct(F.when(right, "").otherwise(other).alias("left"), F.when(right, other).otherwise("").alias("right"))

    own = F.slice(F.array(*[pair(k) for k in range(step)]), F.lit(1), F.col("levels"))
    return held.select("g", F.col("x.*"), F.concat(own, "proof").alias("proof"), *rest)


def descend(tables: list[DataFrame], start: DataFrame, step: int) -> DataFrame:
    """(g, pos, node, carried…, proof, …) of every leaf; ``start`` has (g, proof, …) of the tops."""
    own = start
    for k, table in reversed(list(enumerate(tables))):
        t = table.alias("t")
        rest = [F.col(f"o.{c}") for c in start.columns if c != "g"]
        # A group's topmost block takes the suffix of its top, every other that of its node.
        top = t.where(F.col("n") <= (1 << step)).join(start.alias("o"), F.col("t.g").eqNullSafe(F.col("o.g"))).select("t.*", *rest)
        if k < len(tables) - 1:
            lower = t.where(F.col("n") > (1 << step)).join(own.alias("o"), F.col("t.g").eqNullSafe(F.col("o.g")) & (F.col("t.block") == F.col("o.pos")))
            top = top.unionByName(lower.select("t.*", *rest))
        own = pushed(top, step)
    return own


def fold(node: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, node, lambda acc, p: digest(p["left"], acc, p["right"]))


def prove(leaves: DataFrame, key: str, group: str, *carried: str, step: int = STEP) -> DataFrame:
    """(group, key, leaf, carried…, proof, subroot, root) for rows (group, key, leaf, carried…).

    ``proof`` is the list of siblings from the leaf to the root.
    """
    flat = cut(leaves.select(F.col(group).alias("g"), F.col(key).alias("key"), F.col("leaf").alias("node"), *carried), "merkle-leaves")
    placed = places(flat, "g", "key", "node", *carried)
    tables, tops = climb(placed, step, "key", *carried)
    drop(placed, flat)
    tops = cut(tops, "merkle-tops")
    # The subroots are the leaves of one more tree.
    above_all = places(tops.select(F.lit(0).alias("g"), F.col("g").alias("name"), F.col("top").alias("node")), "g", "name")
    upper, roots = climb(above_all, step, "name")
    drop(above_all)
    ends = roots.select("g", F.expr("array()").cast("array<struct<left:string,right:string>>").alias("proof"), F.col("top").alias("root"))
    groups = descend(upper, ends, step).select(F.col("name").alias("g"), "proof", F.col("node").alias("subroot"), "root")
    out = descend(tables, cut(groups, "merkle-groups"), step)
    return out.select(F.col("g").alias(group), F.col("key").alias(key), F.col("node").alias("leaf"), *carried, "proof", "subroot", "root")


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", columns=COLUMNS, tampered: dict[str, Column] | None = None, where: Column | None = None, step: int = STEP) -> DataFrame:
    """Leaf, proof, subroot and root of every row, and the root that its present values lead to.

    ``tampered`` has values that rows differ in, where ``where`` holds; ``verified`` tells
    whether a row's present values still lead to the root.
    """
    original = leaf(columns)
    now = F.when(F.coalesce(where, F.lit(False)), leaf(columns, tampered)) if tampered and where is not None else F.lit(None).cast("string")
    rows = docs.select(F.col(group).alias("_g"), F.col(key).alias("_k"), original.alias("leaf"), now.alias("_now"))
    proved = prove(rows, "_k", "_g", "_now", step=step)
    folded = fold(F.coalesce("_now", "leaf"), F.col("proof"))
    out = proved.select(F.col("_k").alias(key), F.col("_g").alias(group), "leaf", "subroot", "root", "proof", folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def result(docs: DataFrame, step: int = STEP) -> DataFrame:
    """The digest columns of the registered query: every seventh checksum has its n_chars raised."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = manifest(docs, tampered={"n_chars": F.col("n_chars") + 1}, where=hit, step=step)
    siblings = F.array_join(F.transform("proof", lambda p: F.concat(p["left"], p["right"])), "")
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")


ORACLE = """
WITH RECURSIVE crc_table AS (
    SELECT list(v ORDER BY n) AS tab FROM (
        SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS n))
), keyed AS (
    SELECT *, 4294967295 - list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                                       lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])) AS crc FROM documents, crc_table
), fields AS (
    SELECT doc_id, lang, n_chars, coalesce(crc % 7 = 0 AND n_chars IS NOT NULL, false) AS bad,
           coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
           coalesce(strlen(text) || ':' || text, '-') AS tail FROM keyed
), leaves AS (
    SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
           CASE WHEN bad THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS tampered FROM fields
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, coalesce('l' || lang, '-') AS g FROM leaves
), tree AS (
    SELECT g, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM placed
    UNION ALL
    SELECT g, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (min(n) + 1) // 2 FROM tree WHERE n > 1 GROUP BY g, lvl, pos // 2
), subroots AS (
    SELECT g, h AS subroot, lvl AS depth, row_number() OVER (ORDER BY g) - 1 AS pos FROM tree WHERE n = 1
), top AS (
    SELECT 0 AS lvl, pos, subroot AS h, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (min(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, pos // 2
), steps AS (
    SELECT p.g, p.pos, t.lvl AS lvl, p.pos >> t.lvl AS mine, t.h AS h, t.pos AS other
    FROM placed p JOIN subroots s USING (g) JOIN tree t ON t.g = p.g AND t.lvl < s.depth AND t.pos = xor(p.pos >> t.lvl, 1)
    UNION ALL
    SELECT p.g, p.pos, 1000 + t.lvl, s.pos >> t.lvl, t.h, t.pos FROM placed p JOIN subroots s USING (g) JOIN top t ON t.pos = xor(s.pos >> t.lvl, 1) AND t.n > 1
), lone AS (
    SELECT p.g, p.pos, t.lvl, NULL AS h, false AS before FROM placed p JOIN subroots s USING (g) JOIN (SELECT g, lvl, max(pos) AS last FROM tree GROUP BY ALL) t
        ON t.g = p.g AND t.lvl < s.depth AND p.pos >> t.lvl = t.last AND t.last % 2 = 0
    UNION ALL
    SELECT p.g, p.pos, 1000 + t.lvl, NULL, false FROM placed p JOIN subroots s USING (g) JOIN (SELECT lvl, max(pos) AS last, max(n) AS n FROM top GROUP BY lvl) t ON t.n > 1 AND s.pos >> t.lvl = t.last AND t.last % 2 = 0
), proofs AS (
    SELECT g, pos, list(CASE WHEN h IS NULL THEN 'N' WHEN before THEN 'L' || h ELSE 'R' || h END ORDER BY lvl) AS proof
    FROM (SELECT g, pos, lvl, h, other < mine AS before FROM steps UNION ALL SELECT g, pos, lvl, h, before FROM lone) GROUP BY g, pos
), folded AS (
    SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(array_to_string(list_transform(proof, lambda x: x[2:]), ''), '')) AS proof_sha256,
           list_reduce(list_prepend(coalesce(tampered, leaf), coalesce(proof, [])), lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a WHEN 'R' THEN a || x[2:] ELSE a END)) AS folded_root
    FROM placed JOIN subroots USING (g) LEFT JOIN proofs ON proofs.g = placed.g AND proofs.pos = placed.pos
)
SELECT *, folded_root = root AS verified FROM folded
"""
