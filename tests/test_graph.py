"""Paths, components and clustering on hand-made and random graphs, against plain Python."""

import random
from collections import deque

import pyarrow as pa
import pytest

from wordweave.operators import metrics, paths

HAND = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("c", "d"), ("d", "leaf"), ("b", "d"), ("x", "y")]


def bfs(edges, src):
    out, todo = {src: 0}, deque([src])
    while todo:
        u = todo.popleft()
        for s, d in edges:
            if s == u and d not in out:
                out[d] = out[u] + 1
                todo.append(d)
    return out


def graph(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


def test_hand_made_paths(spark):
    e = graph(spark, HAND)
    ask = [(1, "a", "leaf"), (2, "a", "a"), (3, "leaf", "a"), (4, "x", "y"), (5, "a", "nowhere"), (6, "c", "d")]
    got = {r.qid: (r.hops, r.status) for r in paths.hops(e, spark.createDataFrame(ask, "qid long, src string, dst string")).collect()}
    assert got == {1: (3, "ok"), 2: (0, "ok"), 3: (None, "nolink"), 4: (1, "ok"), 5: (None, "nolink"), 6: (1, "ok")}


def test_caps_are_a_status_of_their_own(spark):
    e = graph(spark, HAND)
    ask = spark.createDataFrame([(1, "a", "leaf")], "qid long, src string, dst string")
    assert paths.hops(e, ask, max_hops=1).first().status == "capped"
    assert paths.hops(e, ask, cap=0).first().status == "capped"


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(25)]
    edges = sorted({(rng.choice(names), rng.choice(names)) for _ in range(45)})
    ask = [(i, rng.choice(names), rng.choice(names)) for i in range(60)]
    e, q = graph(spark, edges), spark.createDataFrame(ask, "qid long, src string, dst string")
    got = {r.qid: r.hops for r in paths.hops(e, q).collect()}
    assert got == {i: bfs(edges, s).get(d) for i, s, d in ask}
    for r in paths.one_path(e, q).collect():
        want = bfs(edges, r.src).get(r.dst)
        assert (len(r.path) - 1 if r.path else None) == want
        assert all(step in edges for step in zip(r.path or [], (r.path or [])[1:]))


@pytest.mark.parametrize("seed", [3, 4])
def test_paths_are_the_least_of_the_shortest(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(30)]
    edges = sorted({(rng.choice(names), rng.choice(names)) for _ in range(90)})

    def least(src, dst):
        todo = [(src,)]
        for _ in range(len(names)):
            hit = sorted(p for p in todo if p[-1] == dst)
            if hit:
                return list(hit[0])
            todo = [p + (d,) for p in todo for s, d in edges if s == p[-1] and d not in p]
        return None

    ask = [(i, rng.choice(names), rng.choice(names)) for i in range(40)]
    ask = [a for a in ask if (bfs(edges, a[1]).get(a[2]) or 0) < 6]
    got = {r.qid: r.path for r in paths.one_path(graph(spark, edges), spark.createDataFrame(ask, "qid long, src string, dst string")).collect()}
    assert got == {i: least(s, d) if d in bfs(edges, s) else None for i, s, d in ask}


def test_long_chain_has_its_path(spark):
    chain = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(41)]
    ask = spark.createDataFrame([(1, "c00", "c40"), (2, "c05", "c05"), (3, "c40", "c00"), (4, "c39", "c41")], "qid long, src string, dst string")
    got = {r.qid: r.path for r in paths.one_path(graph(spark, chain), ask).collect()}
    assert got == {1: [f"c{i:02d}" for i in range(41)], 2: ["c05"], 3: None, 4: ["c39", "c40", "c41"]}


def test_one_sided_search(spark):
    rng = random.Random(7)
    names = [f"n{i}" for i in range(25)]
    edges = sorted({(rng.choice(names), rng.choice(names)) for _ in range(45)})
    ask = [(i, rng.choice(names), rng.choice(names)) for i in range(40)]
    q = spark.createDataFrame(ask, "qid long, src string, dst string")
    got = {r.qid: (r.hops, r.status) for r in paths.hops(graph(spark, edges), q, cap=8, both_sides=False).collect()}
    for i, s, d in ask:
        far = bfs(edges, s)
        stop = next((k for k in range(1, 30) if sum(x <= k for x in far.values()) > 8 and k in far.values()), None)
        n = far.get(d)
        want = (n, "ok") if n is not None and (stop is None or n <= stop) else (None, "capped" if stop is not None else "nolink")
        assert got[i] == want


def test_components(spark):
    e = graph(spark, HAND)
    strong = {r.node: r.component for r in metrics.strong_components(e).collect()}
    assert strong == {"a": "a", "b": "a", "c": "a", "d": "d", "leaf": "leaf", "x": "x", "y": "y"}
    weak = {r.node: r.component for r in metrics.weak_components(e).collect()}
    assert weak == {**dict.fromkeys(["a", "b", "c", "d", "leaf"], "a"), "x": "x", "y": "x"}


def strong_by_hand(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set())

    def reach(v):
        seen, todo = {v}, [v]
        while todo:
            for w in near[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        return seen

    far = {v: reach(v) for v in near}
    return {v: min(w for w in far[v] if v in far[w]) for v in near}


@pytest.mark.parametrize("nodes, edges, seed", [(30, 33, 1), (30, 45, 2), (30, 60, 3), (40, 52, 4), (12, 40, 5)])
def test_strong_components_of_random_graphs(spark, nodes, edges, seed):
    rng = random.Random(seed)
    rows = [(f"n{rng.randrange(nodes):02d}", f"n{rng.randrange(nodes):02d}") for _ in range(edges)]
    got = {r.node: r.component for r in metrics.strong_components(graph(spark, rows)).collect()}
    assert got == strong_by_hand(rows)


def test_strong_components_of_long_ways_in_few_rounds(spark, monkeypatch):
    rounds = []
    contracted = metrics._contracted
    monkeypatch.setattr(metrics, "_contracted", lambda left, seed: rounds.append(seed) or contracted(left, seed))
    order = random.Random(5).sample(range(2000), 2000)
    cycle = [(f"c{order[i]:04d}", f"c{order[(i + 1) % 2000]:04d}") for i in range(2000)]
    chain = [(f"d{i:04d}", f"d{i + 1:04d}") for i in range(300)]
    both = [(f"e{i:04d}", f"e{i + 1:04d}") for i in range(300)] + [(f"e{i + 1:04d}", f"e{i:04d}") for i in range(300)]
    got = {r.node: r.component for r in metrics.strong_components(graph(spark, cycle + chain + both + [("d0300", "c0007"), ("c0008", "e0100")])).collect()}
    assert got == {**{a: "c0000" for a, _ in cycle}, **{f"d{i:04d}": f"d{i:04d}" for i in range(301)}, **{f"e{i:04d}": "e0000" for i in range(301)}}
    assert len(rounds) <= 30


def test_clustering_and_reciprocity(spark):
    e = graph(spark, HAND)
    t = {r.node: (r.degree, r.triangles) for r in metrics.triangles(e).collect()}
    assert t["b"] == (3, 2) and t["a"] == (2, 1) and t["leaf"] == (1, 0)
    assert metrics.reciprocity(graph(spark, [("a", "b"), ("b", "a"), ("a", "a"), ("a", "c")])).first().reciprocity == 0.5


def test_small_core_has_no_ratios(spark):
    row = metrics.core_stats(graph(spark, [("x", "y")])).first()
    assert (row.nodes, row.edges, row.density) == (1, 0, None)


def test_empty_graph(spark):
    e = graph(spark, [])
    assert metrics.full_stats(e).first().nodes == 0
    assert paths.hops(e, spark.createDataFrame([(1, "a", "b")], "qid long, src string, dst string")).first().status == "nolink"
    assert paths.sampled_pairs(e).count() == 0


@pytest.mark.parametrize("arcs", [3, 40, 10**6])
def test_triangles_in_groups_of_any_number(spark, arcs):
    rng = random.Random(11)
    rows = sorted({(f"n{min(rng.randrange(30), rng.randrange(30))}", f"n{rng.randrange(30)}") for _ in range(160)})
    near = {}
    for a, b in rows:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {v: sum(y in near[x] for x in ns for y in ns) // 2 for v, ns in near.items()}
    got = {r.node: (r.degree, r.triangles) for r in metrics.triangles(graph(spark, rows), arcs).collect()}
    assert {v: (len(near[v]), t) for v, t in want.items()} == {v: x for v, x in got.items() if v in near}
    assert sum(want.values()) > 100


def random_rows(seed, nodes, n):
    rng = random.Random(seed)
    return sorted({(f"n{min(rng.randrange(nodes), rng.randrange(nodes))}", f"n{rng.randrange(nodes)}") for _ in range(n)})


def written_schemas(monkeypatch):
    seen, plain = [], metrics.written
    monkeypatch.setattr(metrics, "written", lambda df, name: seen.append((name, df.schema.simpleString())) or plain(df, name))
    return seen


def test_full_stats_work_on_numbers(spark, monkeypatch):
    seen = written_schemas(monkeypatch)
    row = metrics.full_stats(graph(spark, [*HAND, ("a", "b")])).first()
    assert (row.nodes, row.edges, row.expanded_nodes, row.frontier_nodes, row.max_in_degree, row.largest_wcc, row.reciprocity) == (7, 8, 5, 2, 2, 5, 0.0)
    assert row.mean_in_degree == pytest.approx(8 / 7) and row.clustering == pytest.approx((1 + 2 / 3 + 2 / 3 + 1 / 3) / 7)
    assert seen and not [x for x in seen if "string" in x[1]]


def test_numbers_that_two_nodes_share_are_drawn_anew(spark, monkeypatch):
    plain = metrics.node_id
    monkeypatch.setattr(metrics, "node_id", lambda node, by, seed: plain(node, by, seed) if seed else plain(node, by, seed) % 2)
    pairs, nodes, seed = metrics.numbered(graph(spark, HAND))
    assert seed == 1 and nodes.count() == 7
    assert {r.node: r.component for r in metrics.weak_components(graph(spark, HAND)).collect()}["leaf"] == "a"


def test_corners_by_marks_and_by_lookups(monkeypatch):
    rows = {(int(a[1:]), int(b[1:])) for a, b in random_rows(3, 60, 500)}
    arcs = sorted({(min(x), max(x)) for x in rows if x[0] != x[1]})
    want = {}
    for a, b in arcs:
        for c in range(60):
            if (a, c) in arcs and (b, c) in arcs:
                for v in (a, b, c):
                    want[v] = want.get(v, 0) + 1
    for k, marks, lookups in ((1, 1 << 29, 1 << 18), (3, 64, 7), (4, 400, 50), (3, 1, 1000)):
        monkeypatch.setattr(metrics, "MARKS", marks)
        monkeypatch.setattr(metrics, "LOOKUPS", lookups)
        batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*arcs, strict=True)], ["a", "b"])
        tasks, got = {}, {}
        for r in next(metrics._dealer(k)(iter([batch]))).to_pylist():
            for g in range(k):
                x, y, z = sorted((r["ga"], r["gb"], g))
                tasks.setdefault((x * k + y) * k + z, []).append(r)
        for trio, blocks in tasks.items():
            for r in metrics._corners(pa.Table.from_pylist([{"trio": trio, **b} for b in blocks]), k).to_pylist():
                got[r["place"]] = got.get(r["place"], 0) + r["n"]
        assert got == want


def test_report_works_on_numbers(spark, monkeypatch):
    seen = written_schemas(monkeypatch)
    e = spark.createDataFrame([(c, a, b) for c in (1, 2) for a, b in HAND[c - 1 :]] + [(3, "x", "z"), (3, "x", "y"), (3, "x", "w"), (3, "x", "v")], "config_id int, src string, dst string")
    got = {r.config_id: r for r in metrics.report(e).collect()}
    assert (got[1].nodes, got[1].edges, got[1].expanded_nodes, got[1].largest_wcc, got[1].hubs) == (7, 8, 5, 5, "a d b")
    assert (got[2].edges, got[2].hubs, got[2].core_edges) == (7, "a d c", 5)
    assert got[3].hubs == "v w y" and got[3].clustering == 0.0 and got[3].core_edges == 0
    assert seen and not [x for x in seen if "string" in x[1]]
