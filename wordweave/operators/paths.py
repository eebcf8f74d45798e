"""Batched shortest paths: level by level, from both ends, for all pairs at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordweave.session import released, written


def undirected(edges: DataFrame) -> DataFrame:
    both = edges.select("src", "dst")
    return both.union(both.select("dst", "src")).distinct()


def core(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have out-edges themselves."""
    heads = edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(heads, "dst", "left_semi").select(edges.columns)


@dataclass
class Search:
    """A finished search: pairs, `solved` (qid, hops, f, b) with the levels that each side had when they met, `capped` (qid) or None; if kept, `seen` (qid, node, depth) of both sides and `met` (qid, node), where they met."""

    pairs: DataFrame
    solved: DataFrame
    capped: DataFrame | None
    seen: dict[str, DataFrame]
    met: DataFrame | None
    depth: dict[str, int]
    tables: list[DataFrame]


def searched(edges: DataFrame, pairs: DataFrame, max_hops: int | None = None, cap: int | None = None, both_sides: bool = True) -> Search:
    """pairs (qid, src, dst), level by level until each has met, has died or is given up.

    Both ends grow by whole levels, the side with fewer nodes first, so the first level at
    which they meet is the distance; with one side alone the sources grow until they hit their
    targets. Inner nodes of a path have out-edges: only the first step back from a target needs
    all edges, every other one the core. A pair leaves the search in the round it meets.
    """
    tables: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        tables.append(written(df, name))
        return tables[-1]

    pairs = kept(pairs.select("qid", "src", "dst"), "bfs-pairs")
    whole = edges.select("src", "dst")
    inner = kept(core(whole), "bfs-core") if both_sides else whole
    zero = F.lit(0)
    solved = pairs.filter("src = dst").select("qid", zero.alias("hops"), zero.alias("f"), zero.alias("b"))
    every_met = pairs.filter("src = dst").select("qid", F.col("src").alias("node"))
    start = pairs.filter("src <> dst")
    front = {"f": start.select("qid", F.col("src").alias("node"), zero.alias("depth")), "b": start.select("qid", F.col("dst").alias("node"), zero.alias("depth"))}
    seen = dict(front)
    # (qid, n, total) of the pairs still searched: new nodes of a side, and all of them.
    one = start.select("qid", F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("total"))
    width = {"f": one, "b": one}
    live, depth, capped = one.select("qid"), {"f": 0, "b": 0}, None
    size = {"f": start.count(), "b": 0}
    while size["f"] and (max_hops is None or depth["f"] + depth["b"] < max_hops):
        side = "b" if both_sides and size["b"] <= size["f"] else "f"
        other = "f" if side == "b" else "b"
        steps = whole if depth["b"] == 0 else inner
        steps = steps.select(F.col("dst").alias("node"), F.col("src").alias("next")) if side == "b" else steps.select(F.col("src").alias("node"), F.col("dst").alias("next"))
        depth[side] += 1
        grown = front[side].select("qid", "node").join(live, "qid", "left_semi").join(steps, "node").select("qid", F.col("next").alias("node")).distinct()
        new = kept(grown.join(seen[side], ["qid", "node"], "left_anti").withColumn("depth", F.lit(depth[side])), "bfs-front")
        met = kept(new.join(front[other], ["qid", "node"], "left_semi").select("qid", "node"), "bfs-met")
        every_met = every_met.union(met)
        done = met.select("qid").distinct()
        solved = solved.union(done.select("qid", *[F.lit(x).alias(c) for c, x in (("hops", depth["f"] + depth["b"]), ("f", depth["f"]), ("b", depth["b"]))]))
        # A pair lives on while it hasn't met and its frontiers have nodes.
        rest = new.join(done, "qid", "left_anti").groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
        rest = kept(rest.join(width[side].select("qid", "total"), "qid").select("qid", "n", (F.col("n") + F.col("total")).alias("total")), "bfs-live")
        if cap is not None:
            over = rest.filter(F.col("total") > cap).select("qid")
            capped = over if capped is None else capped.union(over)
            rest = rest.filter(F.col("total") <= cap)
        front[side], seen[side], width[side] = new, seen[side].union(new), rest
        live = rest.select("qid")
        n, m = rest.join(width[other].select("qid", F.col("n").alias("m")), "qid").agg(F.sum("n"), F.sum("m")).first()
        size = {side: n or 0, other: m or 0}
    if size["f"] and max_hops is not None:
        capped = live if capped is None else capped.union(live)
    return Search(pairs, solved, capped, seen, every_met, depth, tables)


def hops(edges: DataFrame, pairs: DataFrame, max_hops: int | None = None, cap: int | None = None, both_sides: bool = True) -> DataFrame:
    """pairs (qid, src, dst) with `hops` and `status`: ok, nolink or capped.

    cap: visited nodes of a pair's side beyond which it is given up between levels, as `capped`;
    max_hops: levels in all, beyond which pairs are capped too.
    """
    s = searched(edges, pairs, max_hops, cap, both_sides)
    out = s.pairs.join(s.solved.select("qid", "hops"), "qid", "left")
    if s.capped is None:
        given_up = F.lit(False)
    else:
        out = out.join(s.capped.distinct().withColumn("gave_up", F.lit(True)), "qid", "left")
        given_up = F.coalesce("gave_up", F.lit(False))
    status = F.when(F.col("hops").isNotNull(), "ok").when(given_up, "capped").otherwise("nolink")
    return out.select("qid", "src", "dst", "hops", status.alias("status"))


def one_path(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (qid, src, dst) with `path`, the least of the shortest paths by its nodes in order; null if there is none, however long it is otherwise.

    Both sides of a search keep the level of every node that they saw. From where they met,
    nodes that lie on a shortest path are followed back to either end, a level at a time: a
    node's neighbour one level nearer is on a path too. Each of them names its least next one,
    and the path goes from the source along these.
    """
    s = searched(edges, pairs)
    tables = list(s.tables)

    def kept(df: DataFrame, name: str) -> DataFrame:
        tables.append(written(df, name))
        return tables[-1]

    solved = kept(s.solved, "path-solved")
    seen = {side: kept(s.seen[side].join(solved.select("qid"), "qid", "left_semi"), f"path-{side}") for side in "fb"}
    steps = edges.select("src", "dst")
    layer = kept(s.met.join(solved, "qid").select("qid", "node", F.col("f").alias("at"), "f", "b"), "path-on")
    on = layer.select("qid", "node", "at")
    back = forth = layer
    for turn in range(1, max(s.depth.values()) + 1):
        nearer = seen["f"].select("qid", F.col("node").alias("src"), F.col("depth").alias("at"))
        back = back.select("qid", F.col("node").alias("dst"), (F.col("at") - 1).alias("at"), "f", "b").filter("at >= 0").join(steps, "dst").join(nearer, ["qid", "src", "at"]).select("qid", F.col("src").alias("node"), "at", "f", "b").distinct()
        left = seen["b"].select("qid", F.col("node").alias("dst"), F.col("depth").alias("to"))
        forth = forth.select("qid", F.col("node").alias("src"), (F.col("at") + 1).alias("at"), "f", "b").withColumn("to", F.col("b") - turn).filter("to >= 0").join(steps, "src").join(left, ["qid", "dst", "to"]).select("qid", F.col("dst").alias("node"), "at", "f", "b").distinct()
        back, forth = kept(back, "path-back"), kept(forth, "path-forth")
        on = on.union(back.select("qid", "node", "at")).union(forth.select("qid", "node", "at"))
    on = kept(on, "path-on")
    ahead = on.select("qid", F.col("node").alias("dst"), (F.col("at") - 1).alias("at"))
    next_ = kept(on.withColumnRenamed("node", "src").join(steps, "src").join(ahead, ["qid", "dst", "at"]).groupBy("qid", "at", "src").agg(F.min("dst").alias("next")), "path-next")
    walk = kept(s.pairs.join(solved.select("qid", "hops"), "qid").select("qid", F.col("src").alias("node"), "hops", F.array("src").alias("path")), "path-walk")
    done, at = walk.filter("hops = 0").select("qid", "path"), 0
    while not (walk := walk.filter(F.col("hops") > at)).isEmpty():
        ways = next_.filter(F.col("at") == at).select("qid", F.col("src").alias("node"), "next")
        walk = kept(walk.join(ways, ["qid", "node"]).select("qid", F.col("next").alias("node"), "hops", F.concat("path", F.array("next")).alias("path")), "path-walk")
        at += 1
        done = done.union(walk.filter(F.col("hops") == at).select("qid", "path"))
    out = written(s.pairs.join(done, "qid", "left").select("qid", "src", "dst", "path"), "paths")
    released(*tables)
    return out


def sampled_pairs(edges: DataFrame, n: int = 150, seed: str = "42", least: int = 50) -> DataFrame:
    """n pairs (qid, src, dst) of different nodes with out-edges, by hashes of a seed; none if there are fewer than `least` such nodes.

    The 2n nodes of least hash are drawn for each end, with different seeds, and paired in order.
    """
    heads = edges.select("src").distinct()

    def drawn(name: str, salt: str) -> DataFrame:
        h = F.md5(F.concat(F.lit(f"{seed}:{salt}:"), F.col("src")))
        top = heads.select("src", h.alias("h")).orderBy("h", "src").limit(n + 1)
        return top.select(F.col("src").alias(name), (F.row_number().over(Window.orderBy("h", "src")) - 1).alias("qid"))

    enough = heads.agg((F.count(F.lit(1)) >= least).alias("enough"))
    # Where a row pairs a node with itself it is left out, and row n steps in.
    both = drawn("src", "a").join(drawn("dst", "b"), "qid").filter("src <> dst").orderBy("qid").limit(n)
    return both.crossJoin(F.broadcast(enough)).filter("enough").select("qid", "src", "dst")


def shortest_of_any(edges: DataFrame, starts: DataFrame, targets: DataFrame) -> DataFrame:
    """(qid, src, dst, hops): for each question the nearest of its start nodes (qid, src) and target nodes (qid, dst)."""
    every = starts.join(targets, "qid").withColumn("pair", F.struct("qid", "src", "dst").cast("string"))
    solved = hops(edges, every.select(F.col("pair").alias("qid"), "src", "dst")).filter("status = 'ok'").select(F.col("qid").alias("pair"), "hops")
    return every.join(solved, "pair").groupBy("qid").agg(F.min(F.struct("hops", "src", "dst")).alias("b")).select("qid", "b.src", "b.dst", "b.hops")
