"""Numbers about a graph (src, dst): degrees, components, clustering, reciprocity."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordweave.operators.paths import core
from wordweave.session import released, ship, written


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("word")).agg(F.count(F.lit(1)).alias("indeg"))


def hubs(edges: DataFrame, k: int = 15) -> DataFrame:
    return in_degrees(edges).orderBy(F.desc("indeg"), "word").limit(k)


def by_hash(df: DataFrame, word: str, seed: str, k: int) -> DataFrame:
    """k rows that look random and are the same at each run."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(word))), word).limit(k)


def dead_ends(edges: DataFrame, k: int = 15, seed: str = "42") -> DataFrame:
    """k of the nodes that exactly one edge leads to."""
    return by_hash(in_degrees(edges).filter("indeg = 1"), "word", seed, k)


#: Steps that the first searches of strong_components() may take.
SHORT = 8


def _least_label(edges: DataFrame, labels: DataFrame, most: int | None = None) -> DataFrame | None:
    """labels (node, label) as the least label that reaches each node along edges, its own included: a round for each step of the longest way. None if it isn't done after `most` rounds."""
    last = None
    for turn in count():
        if turn == most:
            released(last)
            return None
        heard = edges.join(labels.select(F.col("node").alias("src"), "label"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("heard"))
        moved = written(labels.join(heard, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label")), "labels")
        done = moved.filter("label <> old").isEmpty()
        released(last)
        labels, last = moved.select("node", "label"), moved
        if done:
            return labels


def numbered(edges: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, int]:
    """(pairs, nodes, seed) of edges (by .., src, dst), read three times; nodes of different `by` are different ones. A node's number is node_id(.., seed).

    pairs (by .., u, v, fwd, back): of any two linked nodes u <= v, whether an edge leads from u
    to v, and back; a loop has u = v and fwd. nodes (by .., id, outdeg, indeg, degree): degree
    counts linked nodes other than itself. Numbers are hashes, so no join has to hand them out;
    if two nodes share one, another seed is taken, so nothing rests on luck.
    """
    names = edges.select(*by, F.col("src").alias("node")).union(edges.select(*by, "dst")).distinct().count()
    for seed in count():
        ends = edges.select(*by, node_id("src", by, seed).alias("s"), node_id("dst", by, seed).alias("d"))
        forward = F.col("s") <= F.col("d")
        pairs = ends.groupBy(*by, F.least("s", "d").alias("u"), F.greatest("s", "d").alias("v")).agg(F.max(forward.cast("int")).alias("fwd"), F.max((~forward).cast("int")).alias("back"))
        pairs = written(pairs, "pairs")
        end = lambda at, out, in_, far: F.struct(F.col(at).alias("id"), F.col(out).cast("long").alias("o"), F.col(in_).cast("long").alias("i"), far.cast("long").alias("n"))
        apart = F.col("u") < F.col("v")
        own = F.when(apart, F.array(end("u", "fwd", "back", apart), end("v", "back", "fwd", apart))).otherwise(F.array(end("u", "fwd", "fwd", apart)))
        sums = [F.sum(f"x.{c}").alias(name) for c, name in (("o", "outdeg"), ("i", "indeg"), ("n", "degree"))]
        nodes = written(pairs.select(*by, F.explode(own).alias("x")).groupBy(*by, F.col("x.id").alias("id")).agg(*sums), "numbers")
        if nodes.select("id").distinct().count() == names:
            return pairs, nodes, seed
        released(pairs, nodes)


def node_id(node: str, by: Sequence[str], seed: int) -> Column:
    return F.xxhash64(*by, node, F.lit(seed))


def _roots(pairs: DataFrame) -> DataFrame:
    """(id, root) of the nodes of pairs (u, v), u < v, that aren't the root of their weak component themselves.

    Every node goes under the least one that it is paired with, if that is less, and under the
    last one over that, in as many joins as the logarithm of the way; then pairs between
    what is left over are looked at again. Numbers are in no order, so few nodes are left each
    time, and the pairs of a round are those of the last one that its trees don't hold.
    """
    known, left = None, pairs.select("u", "v").filter("u < v")
    while True:
        up = written(left.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("root")), "roots")
        if up.isEmpty():
            released(left, up if known is not None else None)
            return up if known is None else known
        while True:
            # Many nodes have one root: what is looked up is each root once.
            over = up.join(up.select(F.col("root").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("root"), F.col("root").alias("far"))
            over = written(over, "roots-over")
            if over.isEmpty():
                released(over)
                break
            before, up = up, written(up.join(over, "root", "left").select("id", F.coalesce("far", "root").alias("root")), "roots")
            released(before, over)
        to = lambda c: up.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
        moved = left.join(to("u"), "u", "left").join(to("v"), "v", "left").select(F.coalesce("u_root", "u").alias("a"), F.coalesce("v_root", "v").alias("b"))
        before, left = left, written(moved.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "root-pairs")
        released(before)
        if known is None:
            known = up
        else:
            old = known
            known = written(old.join(up.select(F.col("id").alias("root"), F.col("root").alias("far")), "root", "left").select("id", F.coalesce("far", "root").alias("root")).union(up), "roots-known")
            released(old, up)


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node connected, whatever the direction; edges are read four times."""
    pairs, nodes, seed = numbered(edges)
    named = vertices(edges).withColumn("id", node_id("node", (), seed)).join(_roots(pairs), "id", "left").select("node", F.coalesce("root", "id").alias("root"))
    named = written(named, "weak")
    released(pairs, nodes)
    return named.join(named.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")


def _sizes(nodes: DataFrame, pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by .., largest_wcc) of numbered() nodes and pairs."""
    of = nodes.select(*by, "id").join(_roots(pairs), "id", "left").groupBy(*by, F.coalesce("root", "id").alias("root")).count()
    return of.groupBy(*by).agg(F.coalesce(F.max("count"), F.lit(0)).alias("largest_wcc"))


def _contracted(left: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(edges, asked): a round of contraction of edges (src, dst), without loops, that keeps who reaches whom.

    Nodes without in- or out-edges leave. A node goes into one that it shares edges both ways
    with, else into its only successor or its only predecessor; none goes into one that goes
    itself, which hashes decide. asked (node, into, by): the node is in the strong component
    of `into` if that of one of its `by` is the same.
    """
    place = lambda c: F.xxhash64(F.col(c), F.lit(seed))
    outs = left.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outs"), F.min("dst").alias("after"))
    ins = left.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("ins"), F.min("src").alias("before"))
    mutual = left.join(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"])
    mates = mutual.groupBy(F.col("src").alias("node")).agg(F.max_by("dst", place("dst")).alias("mate"))
    how = F.when(F.col("mate").isNotNull(), "mate").when(F.col("outs") == 1, "after").when(F.col("ins") == 1, "before")
    live = outs.join(ins, "node").join(mates, "node", "left").withColumn("how", how)
    live = written(live.select("node", "how", F.when(F.col("how") == "mate", F.col("mate")).when(F.col("how") == "after", F.col("after")).when(F.col("how") == "before", F.col("before")).alias("into")), "scc-live")
    rivals = live.filter("into is not null").groupBy(F.col("into").alias("node")).agg(F.min(place("node")).alias("rival"))
    moves = live.join(live.select(F.col("node").alias("into"), F.col("into").alias("further")), "into").join(rivals, "node", "left")
    moves = moves.filter(F.col("further").isNull() | (place("node") < place("into"))).filter(F.col("rival").isNull() | (place("node") < F.col("rival")))
    moves = written(moves.select("node", "into", "how"), "scc-moves")
    inner = left.join(live.select(F.col("node").alias("src")), "src", "left_semi").join(live.select(F.col("node").alias("dst")), "dst", "left_semi")
    end = lambda c: moves.select(F.col("node").alias(c), F.col("into").alias(f"{c}_into"), F.col("how").alias(f"{c}_how"))
    moved = inner.join(end("src"), "src", "left").join(end("dst"), "dst", "left").withColumns({"a": F.coalesce("src_into", "src"), "b": F.coalesce("dst_into", "dst")})
    moved = written(moved, "scc-moved")
    asked = moves.filter("how = 'mate'").select("node", "into", F.col("into").alias("by"))
    asked = asked.union(moved.filter("dst_how = 'after'").select("dst", "dst_into", "a")).union(moved.filter("src_how = 'before'").select("src", "src_into", "b"))
    out = written(moved.filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "scc-edges"), written(asked.distinct(), "scc-asked")
    released(live, moves, moved)
    return out


def _same(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges whose ends both have a label, and the same one."""
    end = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    return edges.join(end("src"), "src").join(end("dst"), "dst").filter("src_label = dst_label").select("src", "dst")


def _split(left: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(edges, found): searches from many nodes at a time, forward and then backward; None if one takes more than `most` steps.

    A node's colour is the least node that reaches it; inside the colour, its goal is the least
    node that it reaches. Those whose goal is their colour are its strong component, found
    (node, component); of the others, only edges inside one colour and goal stay.
    """
    nodes = written(vertices(left).withColumn("label", F.col("node")), "scc-nodes")
    if (colour := _least_label(left, nodes, most)) is None:
        released(nodes)
        return None
    inside = written(_same(left, colour), "scc-inside")
    if (goal := _least_label(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), nodes, most)) is None:
        released(nodes, inside)
        return None
    both = written(colour.join(goal.select("node", F.col("label").alias("goal")), "node"), "scc-both")
    rest = _same(inside, both.filter("goal <> label").select("node", F.col("goal").alias("label")))
    out = written(rest, "scc-edges"), both.filter("goal = label").select("node", F.col("label").alias("component"))
    released(nodes, inside)
    return out


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of those that reach it and that it reaches.

    Two searches from all nodes split the graph first, if they end within SHORT steps, as they
    do where ways are short. In what is left, chains, cycles and nodes with edges both ways are
    contracted, a constant part of them in each round, so rounds grow with the logarithm of the
    longest way through them. Where that leaves more than 7 of 8 edges, the searches go on, a
    step for each step of the longest way that is left. Then contracted nodes are told, last
    ones first, whether they are in the component of the node that they went into.
    """
    nodes = vertices(edges)
    left = written(edges.select("src", "dst").filter("src <> dst").distinct(), "scc-edges")
    known, asks = [], []
    if parts := _split(left, SHORT):
        released(left)
        left, found = parts
        known.append(found)
    n = left.count()
    while n:
        before, (left, asked) = left, _contracted(left, len(asks))
        released(before)
        asks.append(asked)
        few, n = left.count() * 8 > n * 7, left.count()
        if few and n:
            before, (left, found) = left, _split(left)
            released(before)
            known.append(found)
            n = left.count()
    released(left)
    known = written(reduce(DataFrame.union, known, nodes.limit(0).withColumn("component", F.col("node"))), "scc-known")
    for asked in reversed(asks):
        of = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
        told = asked.join(of("into"), "into", "left").join(of("by"), "by", "left").withColumn("component", F.coalesce("into_component", "into"))
        told = told.filter(F.col("component") == F.coalesce("by_component", "by")).select("node", "component").distinct()
        before, known = known, written(known.union(told), "scc-known")
        released(before, asked)
    named = nodes.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return named.join(named.groupBy("component").agg(F.min("node").alias("first")), "component").select("node", F.col("first").alias("component"))


def largest(components: DataFrame) -> DataFrame:
    """One row (size)."""
    return components.groupBy("component").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("size"))


#: Arcs that one task holds, about; arcs worth a task of their own; arcs that are dealt as one batch.
ARCS, FEW, DEAL = 6_000_000, 50_000, 1 << 20
#: Pairs of neighbours that are looked up at once, and bits of the table that the commonest nodes' arcs are marked in.
LOOKUPS, MARKS = 1 << 18, 1 << 29


def _dealer(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arcs (a, b), as places in the order of degrees, to rows (ga, gb, arcs): the groups are the places' remainders by k, and `arcs` holds the quotients of many arcs, all first ends and then all second ones."""

    def rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        block = a % k * k + b % k
        order = np.argsort(block, kind="stable")
        block, a, b = block[order], (a[order] // k).astype(np.int32), (b[order] // k).astype(np.int32)
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        ends = [*cuts[1:], len(block)]
        blobs = [a[i:j].tobytes() + b[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(block[cuts] // k), pa.array(block[cuts] % k), pa.array(blobs, pa.binary())], ["ga", "gb", "arcs"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in "ab"])
            n += len(batch)
            if n >= DEAL:
                yield rows(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield rows(*map(np.concatenate, zip(*held, strict=True)))

    return deal


def _corners(table: pa.Table, k: int) -> pa.Table:
    """(place, n): in how many triangles of one task's arcs a node is, of those whose corners' groups are the task's three."""
    trio = table.column("trio")[0].as_py()
    own = sorted({trio // k // k, trio // k % k, trio % k})
    parts = [(ga, gb, np.frombuffer(x, np.int32).reshape(2, -1)) for ga, gb, x in zip(*(table.column(c).to_pylist() for c in ("ga", "gb", "arcs")), strict=True)]
    w = len(own)
    # Places in the order of degrees among the task's groups alone.
    a = np.concatenate([x[0].astype(np.int64) * w + own.index(ga) for ga, _, x in parts])
    b = np.concatenate([x[1].astype(np.int64) * w + own.index(gb) for _, gb, x in parts])
    del parts
    n = int(b.max()) + 1
    key = np.sort(a * n + b)  # each arc is there once
    a, b = np.divmod(key, n)
    # Whole marks for the last nodes, as bits; of two neighbours that the table doesn't hold, the arc is looked up.
    last = min(n, math.isqrt(min(MARKS, max(64 * len(key), 1 << 16))))
    low = n - last
    marks = np.zeros((last * last + 7) // 8, np.uint8)
    at = (a[a >= low] - low) * last + b[a >= low] - low
    byte, first_of = np.unique(at >> 3, return_index=True)
    if len(at):
        marks[byte] = np.bitwise_or.reduceat(np.left_shift(1, at & 7).astype(np.uint8), first_of)
    starts = np.flatnonzero(np.diff(a, prepend=-1))
    start = np.repeat(starts, np.diff(starts, append=len(a)))
    before = np.arange(len(a)) - start  # an arc is paired with those before it of the same first end
    ahead = np.concatenate([[0], np.cumsum(before)])
    one_too_many = w == 2  # the third group is one of the two twice: triangles inside one group are another task's
    hits = np.zeros(len(a), np.int64)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(ahead, ahead[lo] + LOOKUPS, "right")) - 1)
        far = np.repeat(np.arange(lo, hi), before[lo:hi])
        near = np.arange(len(far)) - np.repeat(ahead[lo:hi] - ahead[lo] - start[lo:hi], before[lo:hi])
        x, y = b[near], b[far]
        if low == 0 or (len(x) and x.min() >= low):
            bit = (x - low) * last + (y - low)
            hit = np.flatnonzero(marks[bit >> 3] >> (bit & 7) & 1)
        else:
            hit = np.zeros(len(x), bool)
            marked = np.flatnonzero(x >= low)
            bit = (x[marked] - low) * last + (y[marked] - low)
            hit[marked] = marks[bit >> 3] >> (bit & 7) & 1
            rest = np.flatnonzero(x < low)
            wanted = x[rest] * n + y[rest]
            hit[rest] = key[np.minimum(np.searchsorted(key, wanted), len(key) - 1)] == wanted
            hit = np.flatnonzero(hit)
        near, far = near[hit], far[hit]
        if one_too_many:
            mixed = (a[far] % w != b[far] % w) | (a[far] % w != b[near] % w)
            near, far = near[mixed], far[mixed]
        if len(far):
            base = int(start[lo])
            hits[base:hi] += np.bincount(near - base, minlength=hi - base) + np.bincount(far - base, minlength=hi - base)
        lo = hi
    # Each triangle is counted at both arcs from its first corner.
    found = np.flatnonzero(hits)
    total = np.bincount(b[found], hits[found], n) + np.bincount(a[found], hits[found], n) / 2
    there = np.flatnonzero(total)
    return pa.table({"place": there // w * k + np.array(own)[there % w], "n": total[there].astype(np.int64)})


def _in_order(degree: DataFrame) -> DataFrame:
    """degree (id, degree) with the place of each node in the order of degrees, from 0: places in the sorted parts, after all parts before."""
    at = F.monotonically_increasing_id()
    rows = written(degree.select("id", "degree").orderBy("degree", "id").withColumns({"part": F.shiftright(at, 33), "i": at.bitwiseAND((1 << 33) - 1)}), "tri-degree")
    sizes = rows.groupBy("part").count()
    more = sizes.select(F.col("part").alias("p"), F.col("count").alias("n"))
    begins = sizes.join(F.broadcast(more), F.col("p") < F.col("part"), "left").groupBy("part").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("begin"))  # a row for each part
    return rows.join(F.broadcast(begins), "part").select("id", "degree", (F.col("begin") + F.col("i")).alias("place"))


def _counted(pairs: DataFrame, arcs_per_task: int = ARCS) -> DataFrame:
    """(id, degree, triangles) of the nodes of pairs (u, v) with u < v, each there once.

    Each pair is an arc from its end of lower degree to the other, so no node has many
    out-neighbours, not even a hub. Nodes fall into k groups, and a task has the arcs among
    three of them: every arc goes to k tasks, packed with others as two numbers, no list of
    neighbours to any, and every triangle is counted in one. k grows with the root of the arcs,
    so that tasks don't.
    """
    spark = ship(pairs.sparkSession)
    n = pairs.count()
    degree = pairs.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    places = written(_in_order(degree), "tri-places")
    k = max(2, min(8, math.isqrt(n // FEW)), math.isqrt(6 * n // arcs_per_task) + 1)
    end = lambda c: places.select(F.col("id").alias(c), F.col("place").alias(f"p{c}"))
    arcs = pairs.select("u", "v").join(end("u"), "u").join(end("v"), "v").select(F.least("pu", "pv").alias("a"), F.greatest("pu", "pv").alias("b"))
    blocks = arcs.mapInArrow(_dealer(k), "ga long, gb long, arcs binary")
    trio = F.array_sort(F.array("ga", "gb", "g"))
    dealt = blocks.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))).withColumn("trio", (F.get(trio, 0) * k + F.get(trio, 1)) * k + F.get(trio, 2))
    tasks = k * (k + 1) * (k + 2) // 6
    dealt = dealt.select("trio", "ga", "gb", "arcs").repartition(min(tasks, 8 * spark.sparkContext.defaultParallelism + tasks // 4), "trio")
    found = dealt.groupBy("trio").applyInArrow(lambda t: _corners(t, k), "place long, n long").groupBy("place").agg(F.sum("n").alias("triangles"))
    return places.join(found, "place", "left").select("id", "degree", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def triangles(edges: DataFrame, arcs_per_task: int = ARCS) -> DataFrame:
    """(node, degree, triangles) of the undirected graph without loops; nodes with loops alone have degree 0. edges are read four times."""
    pairs, _, seed = numbered(edges)
    counts = _counted(pairs.filter("u < v"), arcs_per_task)
    named = vertices(edges).withColumn("id", node_id("node", (), seed)).join(counts, "id", "left")
    return named.select("node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("triangles", F.lit(0)).alias("triangles"))


def _closed() -> Column:
    """A node's local clustering: 2t / (d (d - 1)), 0 below degree 2."""
    d = F.col("degree")
    return F.when(d > 1, 2 * F.col("triangles") / (d * (d - 1))).otherwise(0.0)


def clustering(edges: DataFrame) -> DataFrame:
    """One row (clustering): the mean of 2t / (d (d - 1)) over all nodes, 0 below degree 2."""
    return triangles(edges).agg(F.coalesce(F.avg(_closed()), F.lit(0.0)).alias("clustering"))


def reciprocity(edges: DataFrame) -> DataFrame:
    """One row (edges, reciprocity): the share of edges whose reverse exists; loops count as none."""
    e = edges.select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back")).filter("src <> dst")
    return e.join(back, ["src", "dst"], "left").agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum("back") / F.count(F.lit(1)), F.lit(0.0)).alias("reciprocity"))


def full_stats(edges: DataFrame) -> DataFrame:
    """One row about the whole graph; edges are read three times."""
    pairs, per, _ = numbered(edges)
    base = per.agg(
        F.count(F.lit(1)).alias("nodes"),
        F.coalesce(F.sum((F.col("outdeg") > 0).cast("long")), F.lit(0)).alias("expanded_nodes"),
        F.coalesce(F.sum((F.col("outdeg") == 0).cast("long")), F.lit(0)).alias("frontier_nodes"),
        F.coalesce(F.avg("indeg"), F.lit(0.0)).alias("mean_in_degree"),
        F.coalesce(F.max("indeg"), F.lit(0)).alias("max_in_degree"),
    )
    local = _counted(pairs.filter("u < v")).agg(F.coalesce(F.sum(_closed()), F.lit(0.0)).alias("_local"))
    n = F.col("nodes")
    out = base.crossJoin(_sizes(per, pairs)).crossJoin(_mutual(pairs)).crossJoin(local)  # one row each
    share = lambda c: F.when(n > 0, F.col(c) / n).otherwise(0.0)
    return out.withColumns({"clustering": share("_local"), "wcc_ratio": share("largest_wcc")}).drop("_local")


def _mutual(pairs: DataFrame, by: Sequence[str] = (), edges: str = "edges", ratio: str = "reciprocity") -> DataFrame:
    """(by .., edges, reciprocity) of numbered() pairs, as reciprocity()."""
    n = F.sum(F.col("fwd") + F.col("back"))
    both = F.sum(F.when(F.col("u") < F.col("v"), 2 * F.col("fwd") * F.col("back")).otherwise(0))
    return pairs.groupBy(*by).agg(F.coalesce(n, F.lit(0)).cast("long").alias(edges), F.coalesce(both / n, F.lit(0.0)).alias(ratio))


def report(edges: DataFrame, hubs_: int = 3) -> DataFrame:
    """A row for every config that edges (config_id, src, dst) has: nodes, edges, expanded and frontier nodes, in-degrees, reciprocity, clustering, largest weak component and its share, the same of the core, and its hubs. All in one pass: configs are parts of one graph that share no node. edges are read four times."""
    by = ["config_id"]
    pairs, per, seed = numbered(edges, by)
    base = per.groupBy(by).agg(F.count(F.lit(1)).alias("nodes"), F.sum((F.col("outdeg") > 0).cast("long")).alias("expanded_nodes"), F.sum((F.col("outdeg") == 0).cast("long")).alias("frontier_nodes"), F.avg("indeg").alias("mean_in_degree"), F.max("indeg").alias("max_in_degree"))

    def local(rows: DataFrame, out: str) -> DataFrame:
        some = _counted(rows.filter("u < v")).filter("triangles > 0")
        return some.join(per.select(*by, "id"), "id").groupBy(by).agg(F.sum(_closed()).alias(out))

    heads = per.filter("outdeg > 0")
    inner = pairs.join(heads.select(F.col("id").alias("u")), "u", "left_semi").join(heads.select(F.col("id").alias("v")), "v", "left_semi")
    inner = written(inner.select(pairs.columns), "report-core")
    # Numbers are in no order, so hubs are chosen among all nodes that have as many in-edges as the last one or more, by name.
    top = Window.partitionBy(by).orderBy(F.desc("indeg"))
    first = written(per.filter("indeg > 0").withColumn("i", F.rank().over(top)).filter(F.col("i") <= hubs_).select(*by, "id", "indeg"), "report-hubs")
    named = edges.select(*by, F.col("dst").alias("node"), node_id("dst", by, seed).alias("id")).join(first, [*by, "id"]).select(*by, "node", "indeg").distinct()
    of = Window.partitionBy(by).orderBy(F.desc("indeg"), "node")
    named = named.withColumn("i", F.row_number().over(of)).filter(F.col("i") <= hubs_)
    hub = named.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "node"))), lambda x: x["node"]), " ").alias("hubs"))
    out = base.join(_mutual(pairs, by), by).join(hub, by)
    for more in (_sizes(per, pairs, by), local(pairs, "_local"), _mutual(inner, by, "core_edges", "core_reciprocity"), local(inner, "_core")):
        out = out.join(more, by, "left")
    n, k = F.col("nodes"), F.col("expanded_nodes")
    return out.select("config_id", "nodes", "edges", "expanded_nodes", "frontier_nodes", "mean_in_degree", "max_in_degree", "reciprocity", (F.coalesce("_local", F.lit(0.0)) / n).alias("clustering"), "largest_wcc", (F.col("largest_wcc") / n).alias("wcc_ratio"), F.coalesce("core_edges", F.lit(0)).alias("core_edges"), F.coalesce("core_reciprocity", F.lit(0.0)).alias("core_reciprocity"), (F.coalesce("_core", F.lit(0.0)) / k).alias("core_clustering"), "hubs")


def core_stats(edges: DataFrame) -> DataFrame:
    """One row about the graph among expanded nodes. Nodes are all heads, also those without an edge inside."""
    heads = edges.select(F.col("src").alias("node")).distinct()
    c = written(core(edges.select("src", "dst").distinct()), "core-edges")
    n = heads.agg(F.count(F.lit(1)).alias("nodes"))
    local = triangles(c).agg(F.coalesce(F.sum(_closed()), F.lit(0.0)).alias("local"))
    scc = largest(strong_components(c)).select(F.col("size").alias("largest_scc"))
    out = n.crossJoin(reciprocity(c)).crossJoin(local).crossJoin(scc)  # one row each
    few = F.col("nodes") < 2
    return out.select(
        "nodes",
        "edges",
        F.when(~few, F.col("local") / F.col("nodes")).alias("clustering"),
        F.when(~few, F.col("reciprocity")).alias("reciprocity"),
        F.when(~few, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).alias("density"),
        F.when(~few, F.greatest("largest_scc", F.lit(1))).alias("largest_scc"),
    )


def language_bridges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src_lang, dst_lang, edges)."""
    s, d = nodes.select(F.col("key").alias("src"), F.col("lang").alias("src_lang")), nodes.select(F.col("key").alias("dst"), F.col("lang").alias("dst_lang"))
    return edges.join(s, "src").join(d, "dst").groupBy("src_lang", "dst_lang").agg(F.count(F.lit(1)).alias("edges"))
