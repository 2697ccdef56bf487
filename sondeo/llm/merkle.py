"""A Merkle manifest of a dataset: a tree of digests for each source, a tree over the sources, a proof for every row.

Leaves are cut into superblocks of ``SPAN`` consecutive ones. A superblock is reduced by itself, its root becomes a
node of the level above, and so on until each tree is one node. On the way back, the nodes of each superblock are
cogrouped with the nodes outside it that their proofs need; one function finishes the reduction inside, joins both
parts of every proof, and folds it.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondeo.llm.support import fold, stored

FAN = 16
#: Levels within a superblock, and the nodes that it holds at most.
DEPTH = 3
SPAN = FAN ** DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def runs(nodes: list[str]) -> list[str]:
    """The level above: the digest of every ``FAN`` consecutive nodes."""
    return [digest("".join(nodes[i : i + FAN])) for i in range(0, len(nodes), FAN)]


def levels_inside(nodes: list[str], size: int) -> list[list[str]]:
    """The levels of one superblock of a tree of ``size`` nodes, itself first: up to the tree's root, or ``DEPTH`` up."""
    out = [nodes]
    while (len(out[-1]) > 1) if size <= SPAN else (len(out) <= DEPTH):
        out.append(runs(out[-1]))
    return out


def paths_inside(levels: list[list[str]]) -> list[str]:
    """For each node of the lowest level its siblings, level by level: ``before|after``, joined by semicolons."""
    out = [""] * len(levels[0])
    for depth, nodes in enumerate(levels[:-1]):
        sides = []
        for at in range(len(nodes)):
            low = at - at % FAN
            sides.append("".join(nodes[low:at]) + "|" + "".join(nodes[at + 1 : low + FAN]))
        out = [(p + ";" if depth else "") + sides[i // FAN ** depth] for i, p in enumerate(out)]
    return out


def joined_path(inside: str, outside: str) -> str:
    return f"{inside};{outside}" if inside and outside else inside or outside


def folded(leaf: str, path: str) -> str:
    """The root that ``leaf`` and the siblings of ``path`` lead to."""
    for level in path.split(";") if path else ():
        before, _, after = level.partition("|")
        leaf = digest(before + leaf + after)
    return leaf


def leaf_digest(docs: DataFrame, fields: tuple[str, ...], changed: dict[str, Column] | None = None) -> Column:
    """sha256 in hex of the fields, each ``-`` where null, else its number of UTF-8 bytes, a colon and itself."""
    parts = []
    for name in fields:
        value = (changed or {}).get(name, docs[name]).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` (with a column ``tree``) and ``pos``, a row's number in its tree by ``order``, and ``size``, the tree's rows.

    Rows are dealt by ranges of (tree, order) and numbered where they lie; what moves besides is a count for each range
    and tree, so a tree holding most rows is spread over many tasks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    numbered = stored(dealt.withColumn("_id", F.monotonically_increasing_id()))
    here = numbered.withColumn("_slice", F.shiftright("_id", 33))
    counts = here.groupBy("tree", "_slice").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(tree.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select(
        F.col("tree").alias("_tree"), F.col("_slice").alias("_range"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("size"))
    found = here.join(places, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("_slice") == F.col("_range")))
    return found.withColumn("pos", F.col("_id") + F.col("_shift")).drop("_id", "_slice", "_tree", "_range", "_shift")


def superblock() -> Column:
    return F.floor(F.col("pos") / SPAN).cast("long").alias("block")


def forest(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Levels of superblock nodes (tree, pos, node, size), lowest first, and the root of each tree (tree, node).

    A round divides the nodes by ``SPAN``; three rounds do for 10^10 rows of one tree.
    """
    def reduce(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        top = levels_inside(block["node"].tolist(), int(block["size"].iloc[0]))[-1][0]
        return pd.DataFrame({"tree": block["tree"].iloc[:1], "pos": [int(block["pos"].iloc[0]) // SPAN], "node": [top], "size": [-(-int(block["size"].iloc[0]) // SPAN)]})

    levels, roots = [nodes], None
    while True:
        grouped = levels[-1].select("tree", "pos", "node", "size", superblock()).groupBy("tree", "block")
        above = stored(grouped.applyInPandas(reduce, "tree long, pos long, node string, size long"))
        done = above.filter("size = 1").select("tree", "node")
        roots = done if roots is None else roots.unionByName(done)
        rest = above.filter("size > 1")
        if rest.isEmpty():
            return levels, roots
        levels.append(rest)


def descend(levels: list[DataFrame], roots: DataFrame, lowest) -> DataFrame:
    """From the roots (tree, path, root: the proof above each tree and the tree's root) down to the lowest level.

    At each level the nodes of a superblock are cogrouped with the one row of outer nodes that it needs;
    ``lowest`` says what becomes of the lowest.
    """
    def extend(inner: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("pos")
        inside = paths_inside(levels_inside(inner["node"].tolist(), int(inner["size"].iloc[0])))
        path, root = outer["path"].iloc[0], outer["root"].iloc[0]
        return pd.DataFrame({"tree": inner["tree"], "block": inner["pos"], "path": [joined_path(p, path) for p in inside], "root": root})

    above = None
    for k in range(len(levels) - 1, -1, -1):
        here = levels[k].withColumn("block", superblock())
        # a tree of one superblock at this level starts here; the others go on from the level above
        if k:
            tops = roots.join(here.filter(F.col("size") <= SPAN).select("tree").distinct(), "tree", "left_semi")
        else:
            tops = roots.join(levels[1].select("tree").distinct(), "tree", "left_anti") if len(levels) > 1 else roots
        outer = tops.select(F.col("tree").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("path").alias("path"), F.col("root").alias("root"))
        outer = outer if above is None else outer.unionByName(above)
        both = here.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
        if not k:
            return both.applyInPandas(*lowest)
        above = stored(both.applyInPandas(extend, "tree long, block long, path string, root string"))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, source: str = "source", key: str = "doc_id",
             tampered: Column | None = None, changed: dict[str, Column] | None = None, keep_path: bool = False) -> DataFrame:
    """One row per row of ``docs``: the key, its ``leaf``, the ``subroot`` of its source, the ``root`` of all, the digest
    ``proof_sha256`` of its proof, ``folded_root`` (from leaf and proof) and ``verified`` (is that the root?).

    ``tampered`` marks rows whose leaf is made anew from ``fields`` as ``changed`` gives them before the proof is folded;
    everything else stays as the untampered rows make it. With ``keep_path``, the column ``path`` holds the proof
    itself: for each level the siblings ``before|after``, levels joined by semicolons; :func:`folded` reads it.

    Within a source, rows go by key, nulls first, rows of one key by leaf; repeated rows are leaves each. A null source
    is a source of its own, before all others. Columns beside the fields are ignored, whatever their names. A table
    without rows gives none.
    """
    kind = docs.schema[key].dataType.simpleString()
    again = F.when(tampered, leaf_digest(docs, fields, changed)) if tampered is not None else F.lit(None).cast("string")
    digests = docs.select(docs[source].cast("string").alias("tree"), docs[key].alias("key"), leaf_digest(docs, fields).alias("node"), again.alias("other"))
    placed = ranked(stored(digests), ["key", "node"])

    sources = stored(placed.groupBy(F.col("tree").alias("name")).agg(F.max("size").alias("size")))
    names = stored(ranked(sources.select(F.lit(0).cast("long").alias("tree"), "name"), ["name"]).withColumnRenamed("size", "trees"))
    called = names.select(F.col("name"), F.col("pos").alias("number"))
    leaves = stored(placed.join(called, F.col("tree").eqNullSafe(F.col("name"))).select(F.col("number").alias("tree"), "pos", "size", "key", "node", "other"))

    levels, roots = forest(leaves)
    top = roots.join(names.select(F.col("pos").alias("tree"), "trees"), "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "node", F.col("trees").alias("size"))
    top = stored(top)
    top_levels, top_root = forest(top)
    root = next((r["node"] for r in top_root.collect()), None)          # one digest

    def name_of(inner: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("pos")
        inside = paths_inside(levels_inside(inner["node"].tolist(), int(inner["size"].iloc[0])))
        return pd.DataFrame({"tree": inner["pos"], "path": [joined_path(p, outer["path"].iloc[0]) for p in inside], "root": inner["node"]})

    nothing = top_root.select("tree", F.lit("").alias("path"), F.col("node").alias("root"))
    starts = stored(descend(top_levels, nothing, (name_of, "tree long, path string, root string")))

    def finish(inner: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("pos")
        path = outer["path"].iloc[0]
        paths = [joined_path(p, path) for p in paths_inside(levels_inside(inner["node"].tolist(), int(inner["size"].iloc[0])))]
        ends = [folded(other if isinstance(other, str) else node, p) for node, other, p in zip(inner["node"], inner["other"], paths)]
        out = {key: inner["key"], "leaf": inner["node"], "subroot": outer["root"].iloc[0], "root": root,
               "proof_sha256": [digest(p.replace("|", "").replace(";", "")) for p in paths], "folded_root": ends, "verified": [x == root for x in ends]}
        return pd.DataFrame(out | ({"path": paths} if keep_path else {}))

    schema = f"`{key}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return descend(levels, starts, (finish, schema + (", path string" if keep_path else "")))


def lowered(column: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(column, UPPER, LOWER)


def tampered_rows(key: str = "doc_id", every: int = 5) -> Column:
    """The rows that the query tampers with; a row without a key is left alone."""
    return F.col(key).isNotNull() & (fold(F.col(key), every) == 0)


def manifest_sql() -> str:
    """The query in SQL: levels by recursion, siblings by windows, proofs folded by recursion, crc32 bit by bit."""
    def leaf(text: str) -> str:
        values = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    codes = "list_transform(regexp_extract_all(CAST(doc_id AS VARCHAR), '.'), lambda x: ascii(x)::BIGINT)"
    return f"""
WITH RECURSIVE crc(doc_id, bytes, step, c) AS (
  SELECT DISTINCT doc_id, {codes}, 0, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, bytes, step + 1, CASE WHEN step % 9 = 0 THEN xor(c, bytes[step // 9 + 1]) ELSE xor(c >> 1, (c & 1) * 3988292384) END
  FROM crc WHERE step < 9 * len(bytes)
), bad AS (
  SELECT doc_id FROM crc WHERE step = 9 * len(bytes) AND xor(c, 4294967295) % 5 = 0
), digests AS (
  SELECT doc_id, source, {leaf("text")} AS leaf,
    CASE WHEN doc_id IN (SELECT doc_id FROM bad) THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size
  FROM digests
), up(source, level, pos, node, size) AS (
  SELECT source, 0, pos, leaf, size FROM leaves
  UNION ALL
  SELECT source, level + 1, pos // {FAN}, sha256(string_agg(node, '' ORDER BY pos)), (size + {FAN - 1}) // {FAN}
  FROM up WHERE size > 1 GROUP BY source, level, pos // {FAN}, size
), subroots AS (
  SELECT source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS number, count(*) OVER () AS size FROM up WHERE size = 1
), top(level, pos, node, size) AS (
  SELECT 0, number, node, size FROM subroots
  UNION ALL
  SELECT level + 1, pos // {FAN}, sha256(string_agg(node, '' ORDER BY pos)), (size + {FAN - 1}) // {FAN}
  FROM top WHERE size > 1 GROUP BY level, pos // {FAN}, size
), heights AS (
  SELECT source, max(level) AS height FROM up GROUP BY source
), nodes AS (
  SELECT s.number AS tree, u.level, u.pos, u.node FROM up u JOIN subroots s ON u.source IS NOT DISTINCT FROM s.source WHERE u.size > 1
  UNION ALL SELECT -1, level, pos, node FROM top WHERE size > 1
), sides AS (
  SELECT tree, level, pos,
    coalesce(string_agg(node, '') OVER (PARTITION BY tree, level, pos // {FAN} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS ahead,
    coalesce(string_agg(node, '') OVER (PARTITION BY tree, level, pos // {FAN} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind
  FROM nodes
), numbered AS (
  SELECT l.*, s.number, s.node AS subroot, h.height, row_number() OVER () AS item
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN heights h ON l.source IS NOT DISTINCT FROM h.source
), steps AS (
  SELECT n.item, x.level, x.ahead, x.behind FROM numbered n JOIN sides x ON x.tree = n.number AND x.pos = n.pos // CAST(power({FAN}, x.level) AS BIGINT)
  UNION ALL
  SELECT n.item, n.height + x.level, x.ahead, x.behind FROM numbered n JOIN sides x ON x.tree = -1 AND x.pos = n.number // CAST(power({FAN}, x.level) AS BIGINT)
), proofs AS (
  SELECT item, sha256(string_agg(ahead || behind, '' ORDER BY level)) AS proof, count(*) AS height FROM steps GROUP BY item
), folding(item, level, node) AS (
  SELECT item, 0, coalesce(other, leaf) FROM numbered
  UNION ALL
  SELECT f.item, f.level + 1, sha256(s.ahead || f.node || s.behind) FROM folding f JOIN steps s ON s.item = f.item AND s.level = f.level
), ends AS (
  SELECT item, arg_max(node, level) AS node FROM folding GROUP BY item
)
SELECT n.doc_id, n.leaf, n.subroot, t.node AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.node AS folded_root, e.node = t.node AS verified
FROM numbered n JOIN ends e ON e.item = n.item LEFT JOIN proofs p ON p.item = n.item CROSS JOIN (SELECT node FROM top WHERE size = 1) t
"""
