"""Merkle manifests of a dataset: a tree of hashes for each group of rows, and one over the groups' roots.

A row's leaf is a hash of its columns. Within a group leaves stand in the order of their key;
as long as there are several nodes, every ARITY consecutive ones become their hash, and the
last run may be shorter. What remains is the group's subroot, and the subroots, in the order
of their groups, make the root in the same way.

How it is built: leaves are dealt by ranges of (group, key), so that a leaf's index is its
place in its range and the rows of its group in the ranges before. Blocks of ARITY**depth
leaves, aligned to the tree, are hashed by themselves and leave one node each; these become
fragments of a sparse forest: unresolved nodes keyed by group, level and index. Fragments form
a monoid: merging puts nodes together, and a run of siblings whose size is known from its
group's and that is complete becomes its parent at once. treeReduce merges the fragments of
all partitions. As `depth` grows with the table, the driver gets BLOCKS nodes and those above
them at most, whatever the number of rows or groups: a group that fits in one block never
leaves its task. With those nodes each block states its leaves' proofs.

A proof is an array of steps from the leaf to the root, each with the number of siblings
before the node and all siblings' digests joined; folded() recomputes the root from it.

Results in special cases: nulls have an encoding of their own in every column; the null group
comes first, and a null key first in its group; of rows with one key the one of the lesser
leaf comes first, and rows that agree in all have equal leaves, each with its own place; a
group of one row has its leaf as subroot, a table of one group its subroot as root; an empty
text is not a null one; texts of any length are hashed whole; an empty table has an empty
manifest; other columns pass through manifest() unless they have the names of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wordweave.llm.shared import documents, written
from wordweave.session import released, ship

ARITY = 8
#: Levels of a block at least, and blocks at most where a table allows a choice.
DEPTH, BLOCKS = 3, 1 << 17
STEP = "struct<before:int,siblings:string>"


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    """A row's hash, of its values in order."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def group_key(group: Column) -> Column:
    """A group as a string that is never null and keeps the order, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def digest(nodes: Iterable[str]) -> str:
    return hashlib.sha256("".join(nodes).encode("ascii")).hexdigest()


def _shrunk(n: int, levels: int = 1) -> int:
    return -(-n // ARITY**levels)


@dataclass
class Forest:
    """Unresolved nodes by run of siblings, nodes that were there, and roots. merged() is associative and commutative."""

    open: dict[tuple[str, int, int], tuple[int, dict[int, str]]] = field(default_factory=dict)
    seen: dict[tuple[str, int, int], str] = field(default_factory=dict)
    roots: dict[str, str] = field(default_factory=dict)

    def put(self, group: str, leaves: int, level: int, index: int, node: str) -> Forest:
        """Adds a node of a group of so many leaves; complete runs become their parents."""
        while True:
            self.seen[group, level, index] = node
            size = _shrunk(leaves, level)
            if size == 1:
                self.roots[group] = node
                return self
            run = (group, level, index // ARITY)
            nodes = self.open.setdefault(run, (leaves, {}))[1]
            nodes[index % ARITY] = node
            if len(nodes) < min(ARITY, size - run[2] * ARITY):
                return self
            del self.open[run]
            level, index, node = level + 1, run[2], digest(nodes[i] for i in sorted(nodes))

    def merged(self, other: Forest) -> Forest:
        self.seen |= other.seen
        self.roots |= other.roots
        for (group, level, run), (leaves, nodes) in other.open.items():
            for at, node in nodes.items():
                self.put(group, leaves, level, run * ARITY + at, node)
        return self

    def path(self, group: str, leaves: int, level: int, index: int) -> list[tuple[int, str]]:
        """Steps from a node to its group's root."""
        out = []
        while (size := _shrunk(leaves, level)) > 1:
            first = index // ARITY * ARITY
            run = [self.seen[group, level, i] for i in range(first, min(first + ARITY, size))]
            out.append((index - first, "".join(run[: index - first] + run[index - first + 1 :])))
            level, index = level + 1, index // ARITY
        return out


def placed(leaves: DataFrame) -> DataFrame:
    """leaves (g, key, leaf, ..) with `i`, a leaf's index in its group, and `n`, the group's leaves. Equal rows are told apart, so that many of them make no large range."""
    rows = leaves.withColumn("_row", F.monotonically_increasing_id())
    order = ["g", "key", "leaf", "_row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row")
    rows = written(rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "placed")
    parts = rows.groupBy("g", "_part").agg(F.count(F.lit(1)).alias("c"), F.min("_at").alias("first"))
    before = Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that has some of the group
    parts = parts.select("g", "_part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("c").over(Window.partitionBy("g")).alias("n"))
    out = rows.join(parts, ["g", "_part"]).withColumn("i", F.col("_at") + F.col("shift")).drop("_part", "_at", "shift")
    return written(out, "indexed")


def _levels(nodes: list[str], leaves: int, depth: int) -> list[list[str]]:
    """A block's nodes by level, up to the one node that stands for it: `depth` levels above its leaves, or its group's root."""
    out = [nodes]
    while len(out) <= depth and leaves > 1:
        last = out[-1]
        out.append([digest(last[i : i + ARITY]) for i in range(0, len(last), ARITY)])
        leaves = _shrunk(leaves)
    return out


def _block(table: pa.Table) -> tuple[pa.Table, str, int, int, list[str]]:
    """A block's rows by index, its group, the group's leaves, the first index, and its leaves."""
    table = table.sort_by("i")
    return table, table.column("g")[0].as_py(), table.column("n")[0].as_py(), table.column("i")[0].as_py(), table.column("leaf").to_pylist()


@dataclass
class Trees:
    """roots (g, root) of all groups; proved: the leaves with `proof`, from the leaf to its group's root; tables to release when done."""

    roots: DataFrame
    proved: DataFrame
    tables: list[DataFrame]


def trees(leaves: DataFrame, depth: int | None = None, blocks: int = BLOCKS) -> Trees:
    """A tree for each group of leaves (g, key, leaf, ..); depth: levels of a block, by default as many as keep the number of blocks down."""
    spark = ship(leaves.sparkSession)
    rows = placed(leaves)
    total = rows.count()
    if depth is None:
        depth = DEPTH
        while _shrunk(total, depth) > blocks:
            depth += 1
    width = ARITY**depth
    dealt = rows.withColumn("_block", F.floor(F.col("i") / width))

    def top(table: pa.Table) -> pa.Table:
        _, g, n, first, nodes = _block(table)
        node = _levels(nodes, n, depth)[-1][0]
        return pa.table({"g": [g], "n": pa.array([n], pa.int64()), "block": pa.array([first // width if n > width else -1], pa.int64()), "node": [node]})

    tops = written(dealt.select("g", "n", "i", "leaf", "_block").groupBy("g", "_block").applyInArrow(top, "g string, n long, block long, node string"), "tops")
    wide = tops.filter("block >= 0")

    def fragment(nodes: Iterator) -> Iterator[Forest]:
        out = Forest()
        for r in nodes:
            out.put(r.g, r.n, depth, r.block, r.node)
        yield out

    forest = Forest() if wide.isEmpty() else wide.rdd.mapPartitions(fragment).treeReduce(Forest.merged)
    shared = spark.sparkContext.broadcast(forest)  # BLOCKS nodes and an eighth more at most, see trees()
    roots = tops.filter("block < 0").select("g", F.col("node").alias("root"))
    roots = roots.union(spark.createDataFrame(sorted(forest.roots.items()), "g string, root string"))

    def prove(table: pa.Table) -> pa.Table:
        table, g, n, first, nodes = _block(table)
        levels = _levels(nodes, n, depth)
        above = shared.value.path(g, n, depth, first // width) if n > width else []
        steps = []  # of each level, a node's place among its siblings and the others joined
        for level in levels[:-1]:
            runs = ["".join(level[i : i + ARITY]) for i in range(0, len(level), ARITY)]
            steps.append([(k % ARITY, (r := runs[k // ARITY])[: k % ARITY * 64] + r[k % ARITY * 64 + 64 :]) for k in range(len(level))])
        flat = [s for j in range(len(nodes)) for s in [*(of[j // ARITY**at] for at, of in enumerate(steps)), *above]]
        size = len(steps) + len(above)
        struct = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.int32()), pa.array([s[1] for s in flat], pa.string())], names=["before", "siblings"])
        proof = pa.ListArray.from_arrays(pa.array(range(0, len(nodes) * size + 1, size) if size else [0] * (len(nodes) + 1), pa.int32()), struct)
        return table.drop_columns(["_block"]).append_column("proof", proof)

    schema = StructType([*rows.schema.fields, *StructType.fromDDL(f"proof array<{STEP}>").fields])
    return Trees(roots, dealt.groupBy("g", "_block").applyInArrow(prove, schema), [rows, tops])


def manifest(leaves: DataFrame, **sizes: int) -> DataFrame:
    """leaves (g, key, leaf, ..) with `subroot`, `root` and `proof`, from each leaf to the root."""
    kept = written(leaves, "leaves")
    own = trees(kept, **sizes)
    groups = trees(own.roots.select(F.lit("").alias("g"), F.col("g").alias("key"), F.col("root").alias("leaf")), **sizes)
    above = groups.proved.select(F.col("key").alias("g"), F.col("leaf").alias("subroot"), F.col("proof").alias("_above")).crossJoin(F.broadcast(groups.roots.select("root")))  # one row
    proved = own.proved.join(written(above, "subroots"), "g")
    out = proved.withColumn("proof", F.concat("proof", "_above")).drop("_above", "i", "n")
    released(kept, *groups.tables)
    return out


def proof_digest(proof: Column) -> Column:
    """A hash of all siblings on the way, left to right and level by level."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: s["siblings"]), ""), 256)


def folded(node: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    cut = lambda s: s["before"] * 64
    step = lambda acc, s: F.sha2(F.concat(F.substr(s["siblings"], F.lit(1), cut(s)), acc, F.substr(s["siblings"], cut(s) + 1)), 256)
    return F.aggregate(proof, node, step)


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its proof, and whether it still leads to the root: a third of the documents are tampered with."""
    docs = documents(spark, sf_dir)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    changed = leaf([F.translate("text", _UPPER, _LOWER) if c == "text" else F.col(c) for c in COLUMNS])
    leaves = docs.select(group_key(F.col("lang")).alias("g"), F.col("doc_id").alias("key"), leaf([F.col(c) for c in COLUMNS]).alias("leaf"), F.when(tampered, changed).alias("tampered"))
    m = manifest(leaves).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return m.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP12_SQL = r"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(0, 256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
rows AS MATERIALIZED (SELECT row_number() OVER () AS r, * FROM documents),
marked AS (
  SELECT rows.*, doc_id IS NOT NULL AND (xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0) AS tampered
  FROM rows, crc),
parts AS (
  SELECT r, doc_id, lang, tampered,
    concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
           CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS low FROM marked),
leaves AS (
  SELECT r, doc_id, coalesce('=' || lang, '') AS g, sha256(head || tail) AS leaf, CASE WHEN tampered THEN sha256(head || low) ELSE sha256(head || tail) END AS held FROM parts),
spot AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
tree(g, level, i, n, d) AS (
  SELECT g, 0, i, n, leaf FROM spot
  UNION ALL SELECT g, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY g, level, n, i // 8),
sub AS (SELECT g, d AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS j, count(*) OVER () AS m FROM tree WHERE n = 1),
crown(level, i, n, d) AS (
  SELECT 0, j, m, subroot FROM sub
  UNION ALL SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM crown WHERE n > 1 GROUP BY level, n, i // 8),
steps AS (
  SELECT spot.r, t.level, coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i < spot.i >> (3 * t.level)), '') AS pre, coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i > spot.i >> (3 * t.level)), '') AS post
  FROM spot JOIN tree t ON t.g = spot.g AND t.n > 1 AND t.i // 8 = spot.i >> (3 * t.level + 3) GROUP BY spot.r, t.level
  UNION ALL
  SELECT spot.r, 100 + c.level, coalesce(string_agg(c.d, '' ORDER BY c.i) FILTER (c.i < s.j >> (3 * c.level)), ''), coalesce(string_agg(c.d, '' ORDER BY c.i) FILTER (c.i > s.j >> (3 * c.level)), '')
  FROM spot JOIN sub s USING (g) JOIN crown c ON c.n > 1 AND c.i // 8 = s.j >> (3 * c.level + 3) GROUP BY spot.r, c.level),
numbered AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY level) AS k FROM steps),
proofs AS (SELECT r, sha256(string_agg(pre || post, '' ORDER BY k)) AS p, max(k) AS steps FROM numbered GROUP BY r),
fold(r, k, d) AS (SELECT r, 0, held FROM spot UNION ALL SELECT f.r, f.k + 1, sha256(s.pre || f.d || s.post) FROM fold f JOIN numbered s ON s.r = f.r AND s.k = f.k + 1)
SELECT spot.doc_id, spot.leaf, sub.subroot, (SELECT d FROM crown WHERE n = 1) AS root, coalesce(proofs.p, sha256('')) AS proof_sha256, fold.d AS folded_root, fold.d = (SELECT d FROM crown WHERE n = 1) AS verified
FROM spot JOIN sub USING (g) LEFT JOIN proofs USING (r) JOIN fold ON fold.r = spot.r AND fold.k = coalesce(proofs.steps, 0)
"""
