import random

import pytest
from graphs import ABC, F1, F2, F3, F4, F5, F7, F8, F9, F14, F14_LABELS, graph
from pyspark.sql import functions as F

from graphlake.functions.util import BoundedStack, submit, unique_id
from graphlake.graph import Graph
from graphlake.operators import centrality, community, components, cycles, features, matching, mining, paths, spanning, structure, traverse
from graphlake.plans import iterate, staging
from graphlake.sources import tables


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_degrees(spark):
    g = graph(spark, *F2)
    got = {r[0]: r[1:] for r in rows(structure.degrees(g))}
    assert got == {"A": (3, 1, 2), "B": (2, 1, 1), "C": (2, 2, 0), "D": (3, 1, 2), "E": (2, 1, 1), "F": (2, 1, 1), "G": (2, 1, 1), "H": (2, 1, 1)}
    loop = graph(spark, "A>A A>B A>B", "A B C")
    assert {r[0]: r[1:] for r in rows(structure.degrees(loop))} == {"A": (4, 1, 3), "B": (2, 2, 0), "C": (0, 0, 0)}
    assert rows(structure.in_degree(g, "C")) == [("C", 2)] and rows(structure.out_degree(g, "nobody")) == [("nobody", 0)]


def test_neighbors(spark):
    g = graph(spark, *F2)
    order = lambda df: [r.neighbor for r in df.orderBy("pos").collect()]
    assert order(structure.neighbors(g, "A")) == ["B", "C", "D"]
    assert order(structure.neighbors(g, "A", "source")) == ["D"]
    assert order(structure.neighbors(g, "A", "target")) == ["B", "C"]
    with pytest.raises(ValueError):
        structure.neighbors(g, "A", "other")


def test_adjacency(spark):
    g = graph(spark, *F1)
    row = {r.src_idx: [c.dst_idx for c in r.cells] for r in structure.adjacency_rows(g).collect()}
    assert row[0] == [1, 3, 4] and 7 not in row
    assert {r[1] for r in rows(structure.adjacency(g, True)) if r[0] == 0} == {1, 3, 4}


def test_validate(spark):
    g = graph(spark, "A>B A>X", "A B")
    with pytest.raises(ValueError):
        g.validate()
    assert g.validate("drop").edges.count() == 1


def test_bfs_order(spark):
    g = graph(spark, *F1)
    got = traverse.bfs_visits(g, "A").orderBy("visit").collect()
    assert [r.id for r in got] == list("ABDECFG")
    assert [r.previous for r in got] == [None, *"ABDECF"]
    assert {r.id: r.parent for r in got}["G"] == "C"
    forbidden = traverse.bfs(g, ["A"], allow=lambda a, b: ~((a == "A") & (b == "B")))
    assert {r[0]: r[1] for r in rows(forbidden)} == {"A": 0, "D": 1, "E": 1, "F": 2}
    assert {r[0] for r in rows(traverse.bfs(g, ["G"], directed=False))} == set("ABCDEFG")


def test_dfs_order(spark):
    g = graph(spark, *F3)
    log = traverse.dfs(g, "A").orderBy("step").collect()
    assert [r.current for r in log if r.event == "enter"] == list("ABCGDEF")
    assert [r.current for r in log if r.event == "leave"] == list("GCBDFEA")
    assert [r.current for r in traverse.dfs(g, "A", allow=lambda a, b: ~((a == "A") & (b == "B"))).orderBy("step").collect() if r.event == "enter"] == list("ADGEF")


def test_components(spark):
    g = graph(spark, *F2)
    weak = {}
    for i, c in rows(components.components(g)):
        weak.setdefault(c, set()).add(i)
    assert weak == {"A": set("ABCDEF"), "G": set("GH")}
    strong = {}
    for i, c in rows(components.components(g, True)):
        strong.setdefault(c, set()).add(i)
    assert strong == {"A": {"A"}, "B": {"B"}, "C": {"C"}, "D": set("DEF"), "G": set("GH")}


def test_long_chain_is_one_component(spark):
    e = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = components.star_contract(e).collect()
    assert len(got) == 300 and {r.root for r in got} == {0}


def test_cycles(spark):
    g = graph(spark, *F5)
    assert rows(cycles.has_directed_cycle(g)) == [(False,)] and rows(cycles.directed_cycle_witness(g)) == []
    closed = graph(spark, F5[0] + " F>D", F5[1])
    assert dict(rows(cycles.directed_cycle_witness(closed))) == {"D": "F", "F": "E", "E": "D"}
    more = graph(spark, F5[0] + " F>D C>D", F5[1])
    assert {tuple(r[0]) for r in rows(cycles.simple_cycles(more))} == {("A", "B", "C", "D"), ("A", "C", "D"), ("D", "E", "F")}
    assert rows(cycles.simple_cycles(more, ["B"])) == [(["A", "B", "C", "D"],)]
    assert rows(cycles.simple_cycles(more, ["A"], include=False)) == [(["D", "E", "F"],)]
    assert rows(cycles.cycle_rank(more)) == [(3,)]
    basis = [r.path for r in cycles.cycle_basis(more).collect()]
    ends = {frozenset((r.src, r.dst)) for r in more.edges.collect()}
    assert len(basis) == 3 and all(len(set(p)) == len(p) and all(frozenset((a, b)) in ends for a, b in zip(p, p[1:] + p[:1], strict=True)) for p in basis)
    assert [sorted(r.path) for r in cycles.all_cycles(more, nodes=["B"], include=False).collect()][0]
    assert rows(cycles.simple_cycles(graph(spark, "A>A A>A B>C"))) == [(["A"],)]


def test_shortest_paths(spark):
    g = graph(spark, *F4)
    assert rows(paths.shortest_path(g, "A", "C")) == [(2.0, 1, ["A", "B", "C"])]
    assert [tuple(r) for r in paths.shortest_path(g, "A", "F").orderBy("rank").collect()] == [(2.0, 1, ["A", "E", "F"]), (2.0, 2, ["A", "D", "F"])]
    assert rows(paths.shortest_path(g, "A", "F", directed=True)) == [(2.0, 1, ["A", "E", "F"])]
    heavy = " ".join(f"{e}:{(i % 2 + 1) * 2 if e != 'F>D' else 10}" for i, e in enumerate(F4[0].split()))
    assert rows(paths.shortest_path(graph(spark, heavy, F4[1]), "A", "F", weight="weight")) == [(6.0, 1, ["A", "E", "F"])]
    assert {r[0]: r[2] for r in rows(paths.sssp(g, "A"))}["F"] == "E"
    assert {r[0]: r[1] for r in rows(paths.sssp(g, "A", unreachable=1e6))}["H"] == 1e6
    with pytest.raises(ValueError):
        paths.shortest_lengths(graph(spark, "A>B:-1"), "A", weight="weight")


def test_all_paths(spark):
    g = graph(spark, *F4)
    assert {tuple(r[0]) for r in rows(paths.simple_paths(g, "A", "E"))} == {tuple("ADFE"), tuple("ADE"), tuple("AE")}
    assert {tuple(r[0]) for r in rows(paths.simple_paths(g, "A", "E", directed=True))} == {tuple("ADE"), tuple("AE")}
    assert rows(paths.simple_paths(g, "A", "A")) == [(["A"],)]


def test_all_pairs(spark):
    g = graph(spark, *F1)
    hops = {(a, b): d for a, b, d in rows(paths.all_pairs_hops(g))}
    assert [hops.get(("A", x)) for x in ABC.split()] == [0, 1, 2, 1, 1, 2, 3, None]
    directed = {(a, b): d for a, b, d in rows(paths.all_pairs_hops(g, True))}
    assert ("G", "D") not in directed and directed["A", "G"] == 3


def hops_by_hand(n, arcs):
    heads = {v: set() for v in range(n)}
    for a, b in arcs:
        heads[a].add(b)
    out = {}
    for v in range(n):
        seen, frontier, d = {v}, {v}, 0
        while frontier:
            out.update({(v, x): d for x in frontier})
            frontier = set().union(*[heads[x] for x in frontier]) - seen
            seen |= frontier
            d += 1
    return out


def hops_by_sets(spark, monkeypatch, directed):
    """All pairs of a dense part and a sparse part: results, and rows that the rounds held."""
    n, held = 200, []
    draw = random.Random(5)
    edges = {(draw.randrange(100), draw.randrange(100)) for _ in range(3_000)} | {(v, draw.randrange(100, n)) for v in range(100, n) for _ in range(2)}
    g = Graph(spark.range(n).withColumn("pos", F.col("id")), spark.createDataFrame(sorted(edges), "src long, dst long").withColumns({"pos": F.lit(0), "weight": F.lit(1.0), "label": F.lit("")}))
    monkeypatch.setattr(paths, "WORDS", 2, raising=False)  # two blocks
    monkeypatch.setattr(paths, "grow", lambda *a: held.append((out := iterate.grow(*a)).count()) or out)
    got = rows(paths.all_pairs_hops(g, directed))
    both = edges if directed else edges | {(b, a) for a, b in edges}
    want = hops_by_hand(n, both)
    assert len(got) == len(want) and {(a, b): d for a, b, d in got} == want
    return held[0], len(want), max(want.values())


def test_all_pairs_in_sets(spark, monkeypatch):
    held, pairs, far = hops_by_sets(spark, monkeypatch, True)
    assert pairs > 12_000 and held <= 200 * 2 * (far + 1)


def test_all_pairs_in_sets_undirected(spark, monkeypatch):
    held, pairs, far = hops_by_sets(spark, monkeypatch, False)
    assert pairs == 2 * 100 * 100 and held <= 200 * 2 * (far + 1)


def test_all_pairs_undirected_reads_edges_once(spark, monkeypatch):
    """Edges of both directions, repeated ones and loops: their plan is in that of the arcs once, and an arc is taken once."""
    n, staged = 60, {}
    draw = random.Random(6)
    edges = [(a, b) for a, b in ((draw.randrange(40), draw.randrange(40)) for _ in range(150)) for _ in range(2)]
    edges += [(b, a) for a, b in edges[:100]] + [(v, v + 1) for v in range(40, n - 1)] + [(v, v) for v in range(n)]
    g = Graph(spark.range(n).withColumn("pos", F.col("id")), spark.createDataFrame(edges, "src long, dst long").withColumns({"pos": F.lit(0), "weight": F.lit(1.0), "label": F.lit("")}))
    monkeypatch.setattr(paths, "HEADS", 7, raising=False)  # several lists for a vertex
    monkeypatch.setattr(paths, "stage", lambda df, label: staged.setdefault(label, (df, out := staging.stage(df, label))) and out)
    got = rows(paths.all_pairs_hops(g))
    plan, arcs = staged["hops-arcs"]
    assert plan._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    both = {(a, b) for a, b in edges + [(b, a) for a, b in edges] if a != b}
    assert sorted((r["mid"], x) for r in arcs.collect() for x in r["heads"]) == sorted(both)
    want = hops_by_hand(n, both)
    assert len(got) == len(want) and {(a, b): d for a, b, d in got} == want


@pytest.mark.parametrize("directed", [True, False])
def test_all_pairs_makes_no_row_for_an_arc(spark, monkeypatch, directed):
    """A round unites sets where the heads are; small tiles, rows and chunks, hubs, loops, ends that are no vertices, a vertex without a key."""
    n, plans = 120, []
    draw = random.Random(7)
    edges = {(draw.randrange(n), draw.randrange(n)) for _ in range(400)} | {(0, v) for v in range(100)} | {(v, 1) for v in range(100)}
    edges |= {(v, v + 1) for v in range(n, n + 3)} | {(3, 900), (900, 901), (901, 4), (902, 5), (7, 7)}
    vertices = spark.range(n + 4).selectExpr("id", "id as pos").union(spark.sql("select cast(null as long), 0L")).union(spark.sql("select 5L, 5L"))
    g = Graph(vertices, spark.createDataFrame(sorted(edges), "src long, dst long").withColumns({"pos": F.lit(0), "weight": F.lit(1.0), "label": F.lit("")}))
    for name, value in {"WORDS": 1, "TILE": 100, "ROW_HEADS": 8, "ARCS": 40, "SETS": 6}.items():
        monkeypatch.setattr(paths, name, value, raising=False)

    def grow(step, *rest):
        return iterate.grow(lambda *a: plans.append((made := step(*a))._jdf.queryExecution().optimizedPlan().toString()) or made, *rest)

    monkeypatch.setattr(paths, "grow", grow)
    got = rows(paths.all_pairs_hops(g, directed))
    both = edges if directed else edges | {(b, a) for a, b in edges}
    want = {(a, b): d for (a, b), d in hops_by_hand(903, both).items() if a < n + 4} | {(None, None): 0}
    assert len(got) == len(want) and {(a, b): d for a, b, d in got} == want
    assert plans and not any("Generate" in p for p in plans)


def test_forest(spark):
    g = graph(spark, *F7)
    for method in ("kruskal", "prim"):
        tree = spanning.minimum_spanning_forest(g, "weight", method)
        assert tree.agg(F.sum("weight"), F.count("*")).first()[:] == (10.0, 5)
    assert spanning.minimum_spanning_forest(graph(spark, "A>A:1"), "weight").count() == 0


def test_pagerank(spark):
    g = graph(spark, *F8)
    got = dict(rows(centrality.pagerank(g, max_rounds=60)))
    assert max(got, key=got.get) == "B" and abs(sum(got.values()) - 1) < 1e-9
    assert abs(got["B"] - 0.384401) < 1e-4 and abs(got["G"] - 0.016169) < 1e-4
    other = dict(rows(centrality.pagerank(g, epsilon=1e-4, max_rounds=60, variant="column_normalised")))
    assert abs(other["B"] - 0.390270) < 1e-3


def test_k_core(spark):
    g = graph(spark, "A>B B>C C>A C>D D>E")
    assert {r.id for r in community.k_core(g, 2).vertices.collect()} == set("ABC")
    assert community.k_core(g, 3).edges.count() == 0


def test_communities(spark):
    g = graph(spark, *F9)
    got = community.louvain(g)
    groups = {}
    for i, c in rows(got):
        groups.setdefault(c, set()).add(int(i))
    assert groups == {1: set(range(5)), 2: set(range(5, 10)), 3: set(range(10, 15))}
    assert {r[0]: r[1] for r in rows(community.boundary_weights(g, got))} == {1: 3.0, 2: 2.0, 3: 3.0}
    edges = {(a, b): (w, n) for a, b, w, n in rows(community.cluster_edges(g, got))}
    assert len(edges) == 6 and edges[1, 1][1] == 13 and edges[2, 2] == (14.0, 10)
    assert {len(x) for x in groups.values()} == {5}
    labels = {int(i): c for i, c in rows(community.label_propagation(g))}
    assert len({labels[i] for i in range(5)}) == 1 and len({labels[i] for i in range(5, 10)}) == 1 and len({labels[i] for i in range(10, 15)}) == 1


def _modularity(edges, cluster):
    near = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    k = {}
    for a, _ in near:
        k[a] = k.get(a, 0) + 1
    m2 = len(near)
    total = {}
    for a, c in cluster.items():
        total[c] = total.get(c, 0) + k.get(a, 0)
    return (sum(cluster[a] == cluster[b] for a, b in near) - sum(t * t for t in total.values()) / m2) / m2


@pytest.mark.parametrize("seed", [1, 2])
def test_louvain_leaves_no_move_that_gains(spark, seed):
    """On a random graph with planted groups: within the threshold, no single vertex gains by joining a neighbour's cluster, or by leaving."""
    rng = random.Random(seed)
    n = 40
    edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(400)} & {(a, b) for a in range(n) for b in range(n) if a // 10 == b // 10 or rng.random() < 0.15})
    text = " ".join(f"{a}>{b}" for a, b in edges)
    got = {int(i): c for i, c in rows(community.louvain(graph(spark, text, " ".join(map(str, range(n))))))}
    assert set(got) == set(range(n)) and sorted(set(got.values())) == list(range(1, len(set(got.values())) + 1))
    now = _modularity(edges, got)
    assert now > 0.3
    for i in range(n):
        for c in {got[b] for a, b in edges if a == i} | {got[a] for a, b in edges if b == i} | {0}:
            assert _modularity(edges, got | {i: c}) <= now + 1e-4


def test_label_propagation_runs_to_its_end(spark):
    """A path needs a round per vertex: it ends in two labellings that swap, or with a loop at its start in a fixpoint."""
    n = 24
    path = [(i, i + 1) for i in range(n - 1)]
    v = spark.createDataFrame([(i, i) for i in range(n)], "id long, pos long")
    for edges in (path, [*path, (0, 0)]):
        e = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "src long, dst long, pos long").selectExpr("*", "cast(null as double) weight", "cast(null as string) label")
        near = [{b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in range(n)]
        want = list(range(n))
        for _ in range(1000):
            votes = [[want[j] for j in near[i]] for i in range(n)]
            want = [max(votes[i], key=lambda x: (votes[i].count(x), x == want[i], -x)) for i in range(n)]
        got = {r.id: r.label for r in community.label_propagation(Graph(v, e)).collect()}
        assert got == dict(enumerate(want))


PEOPLE = {i: {"city": "110000" if i < 5 else "310000" if i < 11 else "440300", "amount": 100 if i < 5 else 1000 if i < 11 else 10000} for i in range(17)}


def test_i_louvain_and_kmeans(spark):
    edges = cliques_of_people()
    props = {str(i): {"city": p["city"], "amount": p["amount"]} for i, p in PEOPLE.items()}
    g = graph(spark, edges, " ".join(map(str, range(17))), properties=props)
    got = {}
    for i, c in rows(community.i_louvain(g, "properties")):
        got.setdefault(c, set()).add(int(i))
    assert sorted(map(len, got.values())) == [5, 6, 6]
    means = {}
    for i, c in rows(features.kmeans_graph(g, 3, "properties")):
        means.setdefault(c, set()).add(int(i))
    assert sorted(means.values(), key=min) == [set(range(5)), set(range(5, 11)), set(range(11, 17))]
    assert {r[1] for r in rows(features.kmeans_graph(graph(spark, "A>B"), 2, "properties"))} == {0}


def cliques_of_people() -> str:
    from graphs import cliques

    return cliques([(0, 5), (5, 10), (11, 16)]) + " 9>10 10>5 0>5 5>11 11>0 16>0 16>5 16>11"


def test_vectors(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    vec = lambda *x: F.array(*[F.lit(float(v)) for v in x]).cast("array<double>")
    assert round(one(features.cosine(vec(30, 0, 100), vec(32, 1, 120))), 3) == 0.999
    assert round(one(features.cosine(vec(10, 300, 2), vec(1, 2, 30))), 3) == 0.074
    assert one(features.cosine(vec(0, 0), vec(1, 1))) == 0 and one(features.cosine(vec(1), vec(1, 1))) is None
    assert one(features.add(vec(1, 2), vec())) == [1, 2] and one(features.subtract(vec(3, 2), vec(1, 1))) == [2, 1]
    assert one(features.add(vec(1), vec(1, 2))) is None and one(features.average(vec(2), 0)) == []
    assert one(features.normalize(vec(1, 3, 2))) == [0, 1, 0.5] and one(features.normalize(vec(1, 1))) == [None, None]
    assert one(features.distance(vec(0, 0), vec(3, 4))) == 5 and one(features.norm(vec())) == 0


def test_encoding(spark):
    t = spark.createDataFrame([("a", 0, "x", 1), ("b", 1, "y", 2), ("c", 2, "", 1)], "id string, pos long, kind string, n int")
    assert {r.key: r["values"] for r in features.key_values(t).collect()} == {"kind": ["x", "y"], "n": ["1", "2"]}
    assert {r.id: r.vector for r in features.one_hot(t).collect()} == {"a": [1, 0, 1, 0], "b": [0, 1, 0, 1], "c": [0, 0, 1, 0]}
    assert {r.id: r.vector for r in features.one_hot(t, ["n"]).collect()} == {"a": [1], "b": [2], "c": [1]}
    got = features.nodes_cosine(t, "a").orderBy(F.desc("cosine"), "pos").collect()
    assert [r.id for r in got] == ["c", "b"]
    assert [r.key for r in features.property_keys(t).collect()] == ["n"]


def test_kmeans_numbers(spark):
    t = spark.createDataFrame([(str(i), i, [float(x)]) for i, x in enumerate((10, 12, 56, 300, 350))], "id string, pos long, vector array<double>")
    got = {}
    for i, c in rows(features.kmeans(t, 2, max_iter=5)):
        got.setdefault(c, set()).add(i)
    assert sorted(got.values(), key=min) == [{"0", "1", "2"}, {"3", "4"}]


def test_frequent_subgraphs(spark):
    v = spark.createDataFrame([(g, i, x) for g in (1, 2, 3) for i, x in ((1, "P"), (2, "Q"), (3, "Q"))], "graph_id int, id int, label string")
    e = spark.createDataFrame([(g, s, d, "x") for g in (1, 2) for s, d in ((1, 2), (3, 2))] + [(3, 2, 1, "x")], "graph_id int, src int, dst int, label string")
    assert dict(rows(mining.frequent_labels(v, 3))) == {"P": 3, "Q": 3}
    assert {r[:3]: r[3] for r in rows(mining.frequent_edges(v, e))} == {("P", "x", "Q"): 3, ("Q", "x", "Q"): 2}
    got = {r.pattern: r.support for r in mining.frequent_subgraphs(v, e).collect()}
    assert got == {"P,Q;0-x-1": 3, "Q,Q;0-x-1": 2, "P,Q,Q;0-x-1,1-x-2": 2}


def test_pattern_match(spark):
    g = graph(spark, F14[0], F14[1], F14_LABELS)
    p = graph(spark, "0>1:b 0>2:b", "0 1 2", {"0": "F", "1": "F", "2": "B"})
    exact = matching.match_exact(g, p)
    assert {tuple(r) for r in rows(exact)} == {("0", "1", "2"), ("1", "0", "3")}
    got = matching.match(g, p).collect()
    assert len(got) >= 1 and any({"0", "1", "2"} <= set(r.nodes) for r in got)
    ring = graph(spark, " ".join(f"{i}>{(i + 1) % 6}:e" for i in range(6)), "0 1 2 3 4 5", {"*": "B"})
    found = {frozenset(r) for r in rows(matching.match_exact(g, ring))}
    assert all(len(x) == 6 for x in found)


def test_tools(spark):
    s = BoundedStack(2)
    for i in range(3):
        s.push(i)
    assert s.to_list() == [2, 1] and s.is_full() and s.pop() == 2 and s.peek() == 1 and len(s) == 1
    s.clear()
    assert s.is_empty() and s.pop() is None
    assert unique_id(3).startswith("3-")
    assert submit(lambda: Graph(spark.range(2), spark.range(0)).vertices.count()).result(60) == 2
    with pytest.raises(ZeroDivisionError):
        submit(lambda: 1 // 0).result(60)


def test_empty_graph(spark):
    g = Graph(spark.createDataFrame([], "id string, pos long, label string"), spark.createDataFrame([], "src string, dst string, pos long, weight double, label string"))
    assert rows(structure.degrees(g)) == [] and rows(components.weak_components(g)) == [] and rows(components.strong_components(g)) == []
    assert rows(centrality.pagerank(g)) == [] and spanning.minimum_spanning_forest(g).count() == 0 and rows(paths.all_pairs_hops(g)) == []
    assert community.k_core(g).edges.count() == 0


def test_streaming_degrees(spark, tmp_path):
    from graphlake.streaming.degrees import streaming_degrees

    spark.createDataFrame([("A", "B"), ("A", "C")], "src string, dst string").write.parquet(str(tmp_path / "in"))
    stream = streaming_degrees(spark.readStream.schema("src string, dst string").parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("degrees_test").start()
    q.processAllAvailable()
    q.stop()
    assert {r.id: r.degree for r in spark.table("degrees_test").collect()} == {"A": 2, "B": 1, "C": 1}


def test_read_and_write(spark, tmp_path):
    from graphlake.sources.tables import read_graph, write_graph

    g = graph(spark, *F7)
    write_graph(g, str(tmp_path / "g"))
    again = read_graph(spark, str(tmp_path / "g/vertices"), str(tmp_path / "g/edges"), weight="weight", pos="pos", edge_pos="pos")
    assert again.edges.count() == 7 and again.validate() is again


def test_compressed_edges(spark):
    g = graph(spark, *F2)
    v, e = (x.collect() for x in tables.compressed(g))
    ids = [r.id for r in sorted(v, key=lambda r: r["index"])]
    assert [r["index"] for r in sorted(v, key=lambda r: r["index"])] == list(range(8)) and sorted(r.place for r in e) == list(range(len(e)))
    by_place = sorted(e, key=lambda r: r.place)
    for r in v:
        mine = by_place[r.offset : r.offset + r.degree]
        assert sorted(ids[x.dst_index] for x in mine) == sorted(x.dst for x in g.edges.where(F.col("src") == r.id).collect()) and all(x.src_index == r["index"] for x in mine)


def test_patterns_are_graphs_again(spark):
    found = spark.createDataFrame([("a,b;0-x-y-1,1-z-0",), ("q,q;0--1",)], "pattern string")
    v, e = mining.pattern_graphs(found)
    assert set(rows(v)) == {("a,b;0-x-y-1,1-z-0", 0, "a"), ("a,b;0-x-y-1,1-z-0", 1, "b"), ("q,q;0--1", 0, "q"), ("q,q;0--1", 1, "q")}
    assert set(rows(e.select("src", "dst", "label"))) == {(0, 1, "x-y"), (1, 0, "z"), (0, 1, "")}


def test_dates_have_one_separator(spark):
    values = {"2024-1-31": True, "24/01/31": True, "2024-01/31": False, "2024-01-31 10:00:00": True, "2024-01-31  10:00:00": False, "20245-1-1": False, "x2024-1-1": False}
    t = spark.createDataFrame([(v,) for v in values], "v string")
    assert {r.v for r in t.where(F.col("v").rlike(features.DATE)).collect()} == {v for v, fine in values.items() if fine}


def test_bfs_of_a_long_chain(spark):
    """More than a thousand levels is no bound; few are walked here, with a bound that is a feature."""
    g = graph(spark, *F1)
    assert traverse.bfs(g, ["A"], max_depth=1).agg(F.max("depth")).first()[0] == 1
    with pytest.raises(RuntimeError):
        paths.shortest_lengths(g, "A", max_rounds=1)
