"""Merkle manifest of a dataset: one tree for each value of a column, one over their roots, and proofs.

Rows are hashed where they are read, so texts are never shuffled. Leaves get their place within the tree
by ranges with offsets, and each aligned bucket of 4,096 of them (four levels of eight) goes to DuckDB in
an executor as an Arrow table: a level is one query of an ordered `string_agg` and `sha256`. The roots of
the buckets are the next round's leaves, in Spark, until each tree has one node; rounds grow with the
logarithm to base 4,096. Proofs come back down the same way: a bucket meets the proof of its root, one
row, by a co-group.

Hashes are lower-case hex, and an inner node is the hash of its children's hex joined. A run of eight may
be shorter at the end of a level, and counts as a node even with one child while the level has more.

Defined cases: a null value of a column is `-`, an empty one `0:`; a null id comes first, a null tree
value is the first tree; rows with equal ids are ordered by their hash, equal rows are leaves of their own;
a tree of one leaf has that leaf as its root, one tree's root is the root of all; an empty table has no
rows; a long text is hashed by itself in the task that reads it; other columns count for nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import core

FAN = 8
#: Levels that a bucket folds, and so its leaves.
LEVELS = 4
BUCKET = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The steps of a node up to the root, with the roots that it leads to.
_PATHS = "tree string, place long, before array<string>, after array<string>, subroot string, root string"


def leaf(*columns: Column) -> Column:
    """The hash of a row: each value by its length in bytes, a colon and itself."""
    texts = [c.cast("string") for c in columns]
    told = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def tree_key(column: Column) -> Column:
    """A tree's name that orders as its value does, null first."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def levels(n: Column) -> Column:
    """How many levels a bucket folds in a tree of n nodes: no more than the tree needs."""
    out = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        out = F.when(n <= FAN**k, k).otherwise(out)
    return out


def placed(leaves: DataFrame, *order: str) -> DataFrame:
    """leaves (tree, ...) with place (from 0, in order) and n (of the tree), without ordering a tree in one task."""
    ranged = core.cut(leaves.repartitionByRange("tree", *order).withColumn("range_", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("tree", "range_").agg(F.count("*").alias("own_"))
    whole = Window.partitionBy("tree")
    offsets = counts.select("tree", "range_", F.sum("own_").over(whole).alias("n"), (F.sum("own_").over(whole.orderBy("range_")) - F.col("own_")).alias("start_"))
    within = F.row_number().over(Window.partitionBy("tree", "range_").orderBy(*order))
    return ranged.join(offsets, ["tree", "range_"]).withColumn("place", F.col("start_") + within - 1).drop("range_", "start_")


# ---- blocks in DuckDB ------------------------------------------------------------------------


def _folded(con: duckdb.DuckDBPyConnection, nodes: pa.Table) -> tuple[int, str]:
    """Tables r0, r1, ... of the runs of each level from nodes (place, hash, n); (levels, root)."""
    n = nodes.column("n")[0].as_py()
    depth = next((k for k in range(LEVELS) if n <= FAN**k), LEVELS)
    con.register("given", nodes)
    con.execute(f"CREATE TEMP TABLE n0 AS SELECT place % {BUCKET} AS i, hash FROM given")
    for k in range(depth):
        con.execute(f"CREATE TEMP TABLE r{k} AS SELECT i // {FAN} AS i, list(hash ORDER BY i) AS h, sha256(string_agg(hash, '' ORDER BY i)) AS hash FROM n{k} GROUP BY ALL")
        con.execute(f"CREATE TEMP VIEW n{k + 1} AS SELECT i, hash FROM r{k}")
    return depth, con.execute(f"SELECT hash FROM n{depth}").fetchall()[0][0]


def _walk(depth: int) -> tuple[str, str, str]:
    """SQL of the steps up a bucket's levels: the siblings before and after the node of each level, and the joins."""
    at = [f"(l.i // {FAN**k} % {FAN})" for k in range(depth)]
    before = ", ".join(f"array_to_string(r{k}.h[1:{p}], '')" for k, p in enumerate(at))
    after = ", ".join(f"array_to_string(r{k}.h[({p} + 2):{FAN}], '')" for k, p in enumerate(at))
    joins = " ".join(f"JOIN r{k} ON r{k}.i = l.i // {FAN ** (k + 1)}" for k in range(depth))
    return before, after, joins


def _duck() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})


def _root_of(key: tuple, nodes: pa.Table) -> pa.Table:
    with _duck() as con:
        _, root = _folded(con, nodes)
    return pa.table({"tree": [key[0].as_py()], "place": pa.array([key[1].as_py()], pa.int64()), "hash": [root], "n": pa.array([-(-nodes.column("n")[0].as_py() // BUCKET)], pa.int64())})


def _paths_of(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
    """The steps of each node: those within its bucket, then those of the bucket's root."""
    with _duck() as con:
        depth, _ = _folded(con, nodes)
        before, after, joins = _walk(depth)
        outer = [above.column(c)[0].as_py() for c in ("before", "after")]
        sql = f"SELECT l.i + {key[1].as_py() * BUCKET} AS place, list_concat([{before}]::VARCHAR[], ?::VARCHAR[]) AS before, list_concat([{after}]::VARCHAR[], ?::VARCHAR[]) AS after FROM n0 l {joins}"
        out = con.sql(sql, params=outer).to_arrow_table()
    carried = {c: pa.array([above.column(c)[0].as_py()] * out.num_rows, pa.string()) for c in ("subroot", "root")}
    return pa.table({"tree": pa.array([key[0].as_py()] * out.num_rows, pa.string()), "place": out.column("place").cast(pa.int64()), "before": out.column("before"), "after": out.column("after"), **carried})


def _audit_of(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
    """For each leaf: the hash of its proof, and the root that another hash of it (claim) would have."""
    with _duck() as con:
        depth, _ = _folded(con, nodes)
        before, after, joins = _walk(depth)
        outer = [above.column(c)[0].as_py() for c in ("before", "after")]
        con.execute(f"CREATE TEMP TABLE p AS SELECT l.i, list_concat([{before}]::VARCHAR[], ?::VARCHAR[]) AS b, list_concat([{after}]::VARCHAR[], ?::VARCHAR[]) AS a FROM n0 l {joins}", outer)
        con.execute("CREATE TEMP TABLE f0 AS SELECT p.i, p.b, p.a, g.id, g.hash AS leaf, g.claim AS h FROM p JOIN given g ON g.place % ? = p.i", [BUCKET])
        steps = depth + len(outer[0])
        for k in range(steps):
            con.execute(f"CREATE TEMP TABLE f{k + 1} AS SELECT i, b, a, id, leaf, sha256(b[{k + 1}] || h || a[{k + 1}]) AS h FROM f{k}")
            con.execute(f"DROP TABLE f{k}")
        proof = " || ".join(f"b[{k + 1}] || a[{k + 1}]" for k in range(steps)) or "''"
        out = con.sql(f"SELECT id, leaf, sha256({proof}) AS proof_sha256, h AS folded_root FROM f{steps}").to_arrow_table()
    carried = {c: pa.array([above.column(c)[0].as_py()] * out.num_rows, pa.string()) for c in ("subroot", "root")}
    return pa.table({"id": out.column("id").cast(nodes.schema.field("id").type), "leaf": out.column("leaf"), **carried, "proof_sha256": out.column("proof_sha256"), "folded_root": out.column("folded_root")})


# ---- rounds in Spark ---------------------------------------------------------------------------


def _bucketed(nodes: DataFrame):
    return nodes.withColumn("bucket", F.floor(F.col("place") / BUCKET)).groupBy("tree", "bucket")


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """nodes (tree, place, hash, n) and those of each round above, one at least, the last with one node for each tree."""
    out = [nodes]
    while len(out) == 1 or (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(core.cut(_bucketed(out[-1].select("tree", "place", "hash", "n")).applyInArrow(_root_of, "tree string, place long, hash string, n long"), "roots"))
    return out


def _down(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """top: the paths (see _PATHS) of the last round's nodes -> those of rounds[1], which are the roots of the buckets of rounds[0]."""
    paths = top
    for nodes in reversed(rounds[1:-1]):
        paths = core.cut(_met(nodes, paths, _paths_of, _PATHS), "paths")
    return paths


def _met(nodes: DataFrame, above: DataFrame, use, schema: str) -> DataFrame:
    """Each bucket of nodes with the path of its root, one row."""
    return _bucketed(nodes).cogroup(above.withColumnRenamed("place", "bucket").groupBy("tree", "bucket")).applyInArrow(lambda k, a, b: use(k, a, b), schema)


@dataclass
class Manifest:
    """A built manifest: leaves (tree, place, n, id, hash, claim), subroots (tree, hash), the root of all, and the paths of the buckets' roots."""

    leaves: DataFrame
    subroots: DataFrame
    root: str | None
    paths: DataFrame

    def proofs(self) -> DataFrame:
        """(tree, place, before, after, subroot, root) of each leaf: what stands left and right of it in each level up to the root."""
        return _met(self.leaves.select("tree", "place", "hash", "n"), self.paths, _paths_of, _PATHS)

    def audit(self) -> DataFrame:
        """(id, leaf, subroot, root, proof_sha256, folded_root): each claim folded with its leaf's siblings up to a root."""
        kind = self.leaves.schema["id"].dataType.simpleString()
        schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
        return _met(self.leaves.select("tree", "place", "hash", "n", "id", "claim"), self.paths, _audit_of, schema)


def build(docs: DataFrame, claim: Column | None = None, id: str = "doc_id", by: str = "lang", fields: tuple[str, ...] = FIELDS) -> Manifest:
    """The manifest of docs. claim: a column of hashes to be proved in place of the leaves' own (see leaf); null or absent: the own ones."""
    own = leaf(*(F.col(c) for c in fields))
    claimed = F.lit(None).cast("string") if claim is None else claim
    hashed = core.cut(docs.select(tree_key(F.col(by)).alias("tree"), F.col(id).alias("id"), own.alias("hash"), claimed.alias("claim")), "leaves")
    numbered = placed(hashed.withColumn("tie", F.monotonically_increasing_id()), "id", "hash", "tie").drop("tie")
    leaves = core.cut(numbered.withColumn("claim", F.coalesce("claim", "hash")), "placed")
    core.discard(hashed)
    inner = _rounds(leaves)
    subroots = inner[-1].select("tree", "hash")
    # The trees' roots are the leaves of one more tree, in the order of the trees.
    tops = core.cut(placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("own"), "hash"), "own"), "subroots")
    outer = _rounds(tops)
    found = outer[-1].select("hash").first()
    root = found[0] if found else None
    none = F.array().cast("array<string>")
    start = outer[-1].select("tree", "place", none.alias("before"), none.alias("after"), F.lit("").alias("subroot"), F.lit(root).cast("string").alias("root"))
    down = _met(tops.select("tree", "place", "hash", "n"), _down(outer, start), _paths_of, _PATHS).select("place", "before", "after", "root")
    top = tops.select("place", "own", "hash").join(down, "place")
    top = top.select(F.col("own").alias("tree"), F.lit(0).cast("long").alias("place"), "before", "after", F.col("hash").alias("subroot"), "root")
    return Manifest(leaves, subroots, root, _down(inner, core.cut(top, "paths")))
