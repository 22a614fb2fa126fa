"""Merkle manifest of a dataset by cogrouped subtree exchange.

Leaves are SHA-256 digests of rows. Within a group (``lang``) leaves ascend by id;
while a group has several nodes, each run of ``FAN`` consecutive nodes (the last one
may be shorter, even one node) becomes the digest of their joined hex digests. What remains is
the group's subroot; the subroots, ordered by group (null first), form a tree of the
same kind, whose last node is the root.

Execution. Digests of rows are taken by Spark's own functions and written once; from
there on only digests move. A tree is cut into superblocks of ``FAN ** DEPTH``
consecutive nodes, which any task can hold:

* up: superblocks reduce to one node each (``applyInPandas``); these nodes are numbered by
  their superblock, so a next, ``FAN ** DEPTH`` times smaller layer needs no sorting;
  this repeats until every group has one node;
* down: from the top layer to the leaves, the nodes of a superblock and the outer nodes that its
  proofs require (the siblings of every higher level, handed down by the layer above) are
  cogrouped by superblock, and one ``applyInPandas`` call finishes the
  local reduction, joins local and outer siblings into each node's proof, and folds
  the node's observed digest up to the root. A layer hands its nodes' proofs down as
  the outer nodes of the superblocks below.

A proof row of a superblock is one row, a superblock at most ``FAN ** DEPTH`` rows, so no group
grows with the data and a group with a third of all rows is cut like others.

Positions in a group come from a range-partitioned sort by group, id and digest, written
once; running totals over (partition, group) counts give each row its number.

Rows: a null group is a group of its own (the first); null ids come first; rows
that share an id stand in the order of their digests; equal rows are leaves of their own. A null field
counts as ``-``. No rows give no result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crmlake.llm.common import documents, shuffle_partitions, written

FAN = 8
DEPTH = 4                   # levels per superblock: FAN ** DEPTH nodes at most
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NODE = "g long, pos long, node string"
STEPS = "steps array<struct<before:string,after:string>>"
OUTER = f"g long, block long, {STEPS}, subroot string, root string"
PROOF = f"{NODE}, tag string, subroot string, root string, {STEPS}, proof_sha256 string, folded_root string"


def field(column: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:``, value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_left(n: int) -> int:
    """Levels above ``n`` nodes."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
    return k


def reduce_levels(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level, ``levels`` + 1 lists."""
    out = [nodes]
    for _ in range(levels):
        nodes = [h("".join(nodes[i:i + FAN])) for i in range(0, len(nodes), FAN)]
        out.append(nodes)
    return out


def numbered(rows: DataFrame, group: str, order: list[str], spread: list[str]) -> DataFrame:
    """``rows`` with g (number of the group from 0, nulls first), pos (place in the group) and n (rows of the group).

    ``spread``: narrow columns in the same order as ``order``, whose ranges deal the rows out."""
    spark = rows.sparkSession
    parts = max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)
    placed = (rows.repartitionByRange(parts, group, *spread).sortWithinPartitions(group, *order)
              .withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    placed = written(placed, "merkle-order")
    # one row per partition and group: at most partitions + groups rows, each partition holds a range of groups
    runs = placed.groupBy("part", F.col(group).alias("__g")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    in_group = Window.partitionBy("__g")
    runs = runs.withColumns({
        "base": F.coalesce(F.sum("n").over(in_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "total": F.sum("n").over(in_group)})
    groups = group_numbers(runs.select("__g").distinct())
    runs = (runs.join(groups, runs["__g"].eqNullSafe(groups["__k"]))
            .select(F.col("part").alias("__part"), runs["__g"], "g", "first", "base", "total"))
    return (placed.join(runs, (placed["part"] == runs["__part"]) & placed[group].eqNullSafe(runs["__g"]))
            .select(*rows.columns, "g", (F.col("base") + F.col("at") - F.col("first")).alias("pos"), F.col("total").alias("n")))


def group_numbers(groups: DataFrame) -> DataFrame:
    """(__k, g): numbers of the distinct groups in order, nulls first."""
    spark = groups.sparkSession
    parts = max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)
    placed = written(groups.select(F.col("__g").alias("__k")).repartitionByRange(parts, "__k").sortWithinPartitions("__k")
                     .withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "merkle-groups")
    # one row per partition
    counts = placed.groupBy("part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))
    before = counts.select("part", "first", F.coalesce(F.sum("c").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return placed.join(F.broadcast(before), "part").select("__k", (F.col("base") + F.col("at") - F.col("first")).alias("g"))


def superblock(depth: int) -> Column:
    return F.expr(f"pos div {FAN ** depth}")


def reduce_block(depth: int):
    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        """A superblock's one node; its place is the number of the superblock."""
        block, n = block.sort_values("pos"), int(block["n"].iloc[0])
        top = reduce_levels(block["node"].tolist(), min(depth, levels_left(n)))[-1]
        return pd.DataFrame({"g": [key[0]], "pos": [key[1]], "node": top, "n": [-(-n // FAN ** depth)]})
    return run


def exchange(depth: int, keep_steps: bool):
    def run(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        """Proofs and folds of a superblock's nodes. ``outer``: none at the top, else one row."""
        block = block.sort_values("pos")
        levels = reduce_levels(block["node"].tolist(), min(depth, levels_left(int(block["n"].iloc[0]))))
        above = [(s["before"], s["after"]) for s in outer["steps"].iloc[0]] if len(outer) else []
        steps, folded, proofs = [], [], []
        for i, value in enumerate(block["seen"].tolist()):
            mine = []
            for level in levels[:-1]:
                lo = i // FAN * FAN
                mine.append(("".join(level[lo:i]), "".join(level[i + 1:lo + FAN])))
                i //= FAN
            mine += above
            for before, after in mine:
                value = h(before + value + after)
            folded.append(value)
            proofs.append(h("".join(map("".join, mine))))
            steps.append([{"before": b, "after": a} for b, a in mine] if keep_steps else None)
        return block[["g", "pos", "node", "tag"]].assign(
            subroot=outer["subroot"].iloc[0] if len(outer) else None, root=outer["root"].iloc[0] if len(outer) else levels[-1][0],
            steps=steps, proof_sha256=proofs, folded_root=folded)
    return run


def exchanged(layer: DataFrame, outer: DataFrame, keep_steps: bool, depth: int) -> DataFrame:
    """Proof and fold of every node of ``layer`` (g, pos, node, n, seen, tag); ``outer``: (g, block, steps, subroot, root)."""
    return (layer.withColumn("block", superblock(depth)).groupBy("g", "block")
            .cogroup(outer.groupBy("g", "block")).applyInPandas(exchange(depth, keep_steps), PROOF))


def layers_of(nodes: DataFrame, largest: int, depth: int) -> list[DataFrame]:
    """``nodes`` (g, pos, node, n) and the layers above, each ``FAN ** DEPTH`` times smaller, up to one node a group."""
    out = [nodes]
    while largest > 1:
        largest = -(-largest // FAN ** depth)
        out.append(written(out[-1].groupBy("g", superblock(depth).alias("block"))
                           .applyInPandas(reduce_block(depth), f"{NODE}, n long"), "merkle-up"))
    return out


def merkle_proofs(rows: DataFrame, group: str = "lang", id_col: str = "doc_id", keep_steps: bool = False,
                  depth: int = DEPTH) -> DataFrame:
    """Proofs of all leaves. ``rows``: ``id_col``, ``group``, leaf, seen (the digest found later; the leaf if nothing changed).

    Returns ``id_col``, leaf, subroot, root, proof_sha256 (digest of all siblings, left to right, level by level),
    folded_root (from seen and the siblings), steps (the siblings before and after, a level each; null unless kept)."""
    kind = rows.schema[id_col].dataType
    # head: the first 60 bits of the leaf; tie: equal rows may be dealt to several partitions
    own = written(rows.select(F.col(id_col).alias("id"), F.col(group).alias("grp"), "leaf", "seen")
                  .withColumns({"head": F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long"),
                                "tie": F.monotonically_increasing_id()}), "merkle-leaves")
    placed = written(numbered(own, "grp", ["id", "leaf", "tie"], ["id", "head", "tie"])
                     .select("g", "pos", F.col("leaf").alias("node"), "n", "seen", F.col("id").cast("string").alias("tag")), "merkle-placed")
    # two numbers: the largest group and the number of groups
    largest, groups = placed.agg(F.max("n"), F.max("g") + 1).first()
    lower = layers_of(placed, largest or 0, depth)
    tops = lower[-1].select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), "node", F.lit(groups or 0).cast("long").alias("n"))
    upper = layers_of(tops, groups or 0, depth)

    def bare(layer: DataFrame) -> DataFrame:
        return layer.withColumns({"seen": F.col("node"), "tag": F.lit(None).cast("string")})

    outer = rows.sparkSession.createDataFrame([], OUTER)
    for layer in reversed(upper[:-1] or upper):
        down = written(exchanged(bare(layer), outer, True, depth), "merkle-down")
        outer = down.select("g", F.col("pos").alias("block"), "steps", "subroot", "root")
    # a subroot's proof goes to its group, whose top superblock is the first
    outer = down.select(F.col("pos").alias("g"), F.lit(0).cast("long").alias("block"), "steps", F.col("node").alias("subroot"), "root")
    for layer in reversed(lower[1:-1]):
        outer = written(exchanged(bare(layer), outer, True, depth), "merkle-down") \
            .select("g", F.col("pos").alias("block"), "steps", "subroot", "root")
    return (exchanged(lower[0], outer, keep_steps, depth)
            .select(F.col("tag").cast(kind).alias(id_col), F.col("node").alias("leaf"), "subroot", "root", "proof_sha256",
                    "folded_root", "steps"))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``; rows whose id's crc32 is divisible by 3 are seen with their text in lower case."""
    docs = documents(spark, sf_dir)
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    whole = leaf(*map(F.col, FIELDS))
    low = leaf(*[F.translate("text", A_TO_Z, A_TO_Z.lower()) if c == "text" else F.col(c) for c in FIELDS])
    out = merkle_proofs(docs.select("doc_id", "lang", whole.alias("leaf"), F.when(changed, low).otherwise(whole).alias("seen")))
    return out.drop("steps").withColumn("verified", F.col("folded_root") == F.col("root"))



def _sql_field(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || {column}, '-')"


def _sql_tree(name: str, base: str) -> str:
    """Nodes of all levels, and the siblings before and after each."""
    side = "coalesce(string_agg(node, '') OVER (PARTITION BY lvl, g, idx // 8 ORDER BY idx ROWS BETWEEN {}), '')"
    return f"""{name} AS (
  SELECT 0 AS lvl, g, idx, node, count(*) OVER (PARTITION BY g) AS n FROM {base}
  UNION ALL
  SELECT lvl + 1, g, idx // 8, sha256(string_agg(node, '' ORDER BY idx)), (min(n) + 7) // 8
  FROM {name} WHERE n > 1 GROUP BY lvl, g, idx // 8),
{name}_sides AS (
  SELECT lvl, g, idx, {side.format("UNBOUNDED PRECEDING AND 1 PRECEDING")} AS a,
         {side.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")} AS b
  FROM {name} WHERE n > 1)"""


_LEAF = " || ".join(map(_sql_field, FIELDS))
_LOW = _LEAF.replace(_sql_field("text"), _sql_field(f"translate(text, '{A_TO_Z}', '{A_TO_Z.lower()}')"))
OP12_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT *, list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)),
    lambda crc, byte: list_reduce([xor(crc, byte)] || range(8), lambda r, i: xor(r >> 1, (r & 1) * 3988292384))) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256({_LEAF}) AS node,
         CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256({_LOW}) ELSE sha256({_LEAF}) END AS seen FROM bits),
placed AS (
  SELECT doc_id, node, seen, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, node) - 1 AS idx FROM leaves),
{_sql_tree("low", "placed")},
tops AS (SELECT 0 AS g, g AS idx, node FROM low WHERE n = 1),
{_sql_tree("high", "tops")},
low_fold AS (
  SELECT 0 AS lvl, g, idx, idx AS leaf_idx, seen AS v, '' AS proof FROM placed
  UNION ALL
  SELECT f.lvl + 1, f.g, f.idx // 8, f.leaf_idx, sha256(a || v || b), proof || a || b
  FROM low_fold f JOIN low_sides s ON s.lvl = f.lvl AND s.g = f.g AND s.idx = f.idx),
high_fold AS (
  SELECT 0 AS lvl, g AS idx, g AS leaf_g, leaf_idx, v, proof
  FROM low_fold QUALIFY row_number() OVER (PARTITION BY g, leaf_idx ORDER BY lvl DESC) = 1
  UNION ALL
  SELECT f.lvl + 1, f.idx // 8, leaf_g, leaf_idx, sha256(a || v || b), proof || a || b
  FROM high_fold f JOIN high_sides s ON s.lvl = f.lvl AND s.idx = f.idx),
folded AS (
  SELECT leaf_g, leaf_idx, v, proof FROM high_fold
  QUALIFY row_number() OVER (PARTITION BY leaf_g, leaf_idx ORDER BY lvl DESC) = 1)
SELECT p.doc_id, p.node AS leaf, t.node AS subroot, r.node AS root, sha256(f.proof) AS proof_sha256,
       f.v AS folded_root, f.v = r.node AS verified
FROM placed p JOIN folded f ON f.leaf_g = p.g AND f.leaf_idx = p.idx JOIN tops t ON t.idx = p.g
JOIN (SELECT node FROM high WHERE n = 1) r ON true
"""
