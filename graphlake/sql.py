"""DuckDB SQL for the library's queries. Loops are recursive or written out round by round."""

from __future__ import annotations

STEPS = "steps AS (SELECT l_orderkey, l_suppkey AS src, l_returnflag AS flag, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_returnflag) AS dst FROM lineitem)"
TRADE = "e AS MATERIALIZED (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*)::DOUBLE AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), v AS MATERIALIZED (SELECT n_nationkey::BIGINT AS id, n_regionkey AS cluster FROM nation)"
SUPPLY = "e AS MATERIALIZED (SELECT DISTINCT l_suppkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM lineitem), v AS MATERIALIZED (SELECT s_suppkey * 2 AS id FROM supplier UNION ALL SELECT p_partkey * 2 + 1 FROM part)"
CHAIN = STEPS + ", e AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE AS weight FROM steps WHERE dst IS NOT NULL GROUP BY ALL), v AS MATERIALIZED (SELECT s_suppkey AS id, s_nationkey AS cluster FROM supplier)"
GEO = "b AS (SELECT n_nationkey::BIGINT + 1000 AS id, n_regionkey::BIGINT + 1 AS up FROM nation UNION ALL SELECT c_custkey * 2 + 1000000, c_nationkey + 1000 FROM customer UNION ALL SELECT s_suppkey * 2 + 1000001, s_nationkey + 1000 FROM supplier), e AS MATERIALIZED (SELECT up AS src, id AS dst FROM b), v AS MATERIALIZED (SELECT r_regionkey::BIGINT + 1 AS id FROM region UNION ALL SELECT id FROM b)"
FLOWS = "e AS MATERIALIZED (SELECT src, dst, count(*) AS weight FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL GROUP BY ALL)"
BASKETS = STEPS + ", bv AS MATERIALIZED (SELECT DISTINCT l_orderkey AS g, l_suppkey AS id, n_regionkey::VARCHAR AS label FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey), be AS MATERIALIZED (SELECT DISTINCT l_orderkey AS g, src, dst, flag FROM steps WHERE dst <> src)"
PARTS = "p AS (SELECT p_partkey AS id, p_brand AS brand, p_type AS type, p_size::VARCHAR AS size FROM part), k AS (SELECT 'brand' AS key, brand AS value, min(id) AS pos FROM p GROUP BY ALL UNION ALL SELECT 'type', type, min(id) FROM p GROUP BY ALL UNION ALL SELECT 'size', size, min(id) FROM p GROUP BY ALL)"
VECTORS = "x AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS vector, label AS cluster FROM embeddings)"

DEGREE = "SELECT id, count(x) AS degree, count(x) FILTER (NOT o) AS in_degree, count(x) FILTER (o) AS out_degree FROM v LEFT JOIN (SELECT src AS x, true AS o FROM e UNION ALL SELECT dst, false FROM e) ON x = id GROUP BY id"
UNDIRECTED = "u AS MATERIALIZED (SELECT DISTINCT src, dst FROM e UNION SELECT dst, src FROM e)"


def _bfs(graph: str, start: str, arcs: str) -> str:
    return f"WITH RECURSIVE {graph}, a AS MATERIALIZED ({arcs}), r(id, depth) USING KEY (id) AS (SELECT {start}::BIGINT, 0 UNION SELECT a.dst, r.depth + 1 FROM r JOIN a ON a.src = r.id LEFT JOIN recurring.r AS o ON o.id = a.dst WHERE o.id IS NULL) SELECT id, depth FROM r"


def _components(graph: str) -> str:
    return f"WITH RECURSIVE {graph}, a AS MATERIALIZED (SELECT DISTINCT src, dst FROM e UNION SELECT dst, src FROM e), r(id, component) USING KEY (id) AS (SELECT id, id FROM v UNION SELECT a.dst, min(r.component) FROM r JOIN a ON a.src = r.id JOIN recurring.r AS o ON o.id = a.dst WHERE r.component < o.component GROUP BY a.dst) SELECT id, component FROM r"


def _lengths(graph: str) -> str:
    return f"{graph}, r(id, length) USING KEY (id) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION SELECT e.dst, min(r.length + e.weight) FROM r JOIN e ON e.src = r.id LEFT JOIN recurring.r AS o ON o.id = e.dst WHERE o.id IS NULL OR r.length + e.weight < o.length GROUP BY e.dst)"


def _closure(graph: str, last: str) -> str:
    return f"WITH RECURSIVE {graph}, r(src, dst, dist) USING KEY (src, dst) AS (SELECT id, id, 0 FROM v UNION SELECT r.src, e.dst, min(r.dist + 1) FROM r JOIN e ON e.src = r.dst LEFT JOIN recurring.r AS o ON o.src = r.src AND o.dst = e.dst WHERE o.src IS NULL GROUP BY r.src, e.dst) {last}"


def _cycles(graph: str, bound: str, where: str) -> str:
    return f"WITH RECURSIVE {graph}, c(s, l, path) AS (SELECT src, dst, [src, dst] FROM e WHERE dst > src UNION ALL SELECT s, e.dst, list_append(path, e.dst) FROM c JOIN e ON e.src = c.l WHERE e.dst > s AND NOT list_contains(path, e.dst) AND {bound}), p AS (SELECT path FROM c JOIN e ON e.src = c.l AND e.dst = c.s UNION ALL SELECT [src] FROM e WHERE src = dst) SELECT path FROM p WHERE {where}"


def _forest(graph: str, nodes: int) -> str:
    rounds = max(1, (nodes - 1).bit_length())
    sql = f"WITH {graph}, o AS MATERIALIZED (SELECT src, dst, weight, row_number() OVER (ORDER BY weight, src, dst) AS r FROM e WHERE src <> dst), d0 AS MATERIALIZED (SELECT a, b, min(r) AS r FROM (SELECT src AS a, dst AS b, r FROM o UNION ALL SELECT dst, src, r FROM o) GROUP BY ALL)"
    for i in range(rounds):
        sql += f", d{i + 1} AS MATERIALIZED (SELECT a, b, min(r) AS r FROM (SELECT a, b, r FROM d{i} UNION ALL SELECT x.a, y.b, greatest(x.r, y.r) FROM d{i} x JOIN d{i} y ON x.b = y.a WHERE x.a <> y.b) GROUP BY ALL)"
    return sql + f" SELECT src, dst, weight FROM o JOIN d{rounds} d ON d.a = o.src AND d.b = o.dst AND d.r = o.r"


def _pagerank(graph: str, rounds: int, normalised: bool = False) -> str:
    sql = f"WITH {graph}, n AS MATERIALIZED (SELECT count(*) AS n FROM v), d AS MATERIALIZED (SELECT id, count(src)::DOUBLE AS out FROM v LEFT JOIN e ON src = id GROUP BY id), r0 AS MATERIALIZED (SELECT id, 1.0 / n AS rank FROM v, n)"
    for i in range(rounds):
        if normalised:
            give, rest = "0.85 / (0.15 + 0.85 * out) * rank", f"(SELECT sum(rank / (0.15 + 0.85 * out)) * 0.15 / (SELECT n FROM n) FROM r{i} JOIN d USING (id))"
        else:
            give, rest = "0.85 * rank / out", f"(SELECT (1 - 0.85 * coalesce(sum(rank) FILTER (out > 0), 0)) / (SELECT n FROM n) FROM r{i} JOIN d USING (id))"
        sql += f", g{i} AS (SELECT dst AS id, sum({give}) AS got FROM e JOIN d ON d.id = src JOIN r{i} ON r{i}.id = src GROUP BY dst), r{i + 1} AS MATERIALIZED (SELECT id, coalesce(got, 0) + {rest} AS rank FROM v LEFT JOIN g{i} USING (id))"
    return sql + f" SELECT id, round(rank, 9) AS rank FROM r{rounds}"


def _k_core(k: int, rounds: int) -> str:
    sql = f"WITH {SUPPLY}, c0 AS MATERIALIZED (SELECT * FROM e)"
    for i in range(rounds):
        sql += f", x{i} AS (SELECT id FROM (SELECT src AS id FROM c{i} UNION ALL SELECT dst FROM c{i}) GROUP BY id HAVING count(*) >= {k}), c{i + 1} AS MATERIALIZED (SELECT * FROM c{i} WHERE src IN (SELECT id FROM x{i}) AND dst IN (SELECT id FROM x{i}))"
    return sql + f" SELECT src, dst FROM c{rounds}"


def _labels(rounds: int) -> str:
    sql = f"WITH {CHAIN}, {UNDIRECTED}, l0 AS MATERIALIZED (SELECT id, id AS label FROM v)"
    for i in range(rounds):
        sql += f", t{i} AS (SELECT u.src AS id, l.label, count(*) AS n FROM u JOIN l{i} l ON l.id = u.dst GROUP BY ALL), l{i + 1} AS MATERIALIZED (SELECT l.id, coalesce(b.label, l.label) AS label FROM l{i} l LEFT JOIN (SELECT t.id, t.label FROM t{i} t JOIN l{i} o ON o.id = t.id QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY t.n DESC, t.label = o.label DESC, t.label) = 1) b ON b.id = l.id)"
    return sql + f" SELECT id, label FROM l{rounds}"


_D = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) ** 2)))"


def _kmeans(k: int) -> str:
    sql = f"WITH {VECTORS}, c1 AS MATERIALIZED (SELECT id, vector FROM x ORDER BY id LIMIT 1)"
    for i in range(2, k + 1):
        total = " + ".join(_D.format(a="x.vector", b=f"c{j}.vector") for j in range(1, i))
        fresh = " AND ".join(f"x.vector <> c{j}.vector" for j in range(1, i))
        sql += f", c{i} AS MATERIALIZED (SELECT x.id, x.vector FROM x, {', '.join(f'c{j}' for j in range(1, i))} WHERE {fresh} ORDER BY ({total}) / {i - 1} DESC, x.id LIMIT 1)"
    near = ", ".join(f"{{'d': {_D.format(a='x.vector', b=f'c{j}.vector')}, 'c': {j - 1}}}" for j in range(1, k + 1))
    return sql + f" SELECT x.id, list_min([{near}]).c AS cluster FROM x, {', '.join(f'c{j}' for j in range(1, k + 1))}"


def _lloyd(k: int, passes: int) -> str:
    """``passes`` assignments; between them centroids move to the means of what was assigned to them."""
    chosen = _kmeans(k).rsplit(" SELECT x.id", 1)[0]
    sql = chosen + ", y AS MATERIALIZED (SELECT id, unnest(vector) AS y, generate_subscripts(vector, 1) AS i FROM x), m0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {j} AS j, vector FROM c{j + 1}" for j in range(k)) + ")"
    for p in range(passes):
        sql += f", a{p} AS MATERIALIZED (SELECT x.id, min({{'d': {_D.format(a='x.vector', b=f'm{p}.vector')}, 'c': j}}).c AS cluster FROM x, m{p} GROUP BY x.id), n{p} AS (SELECT cluster AS j, list(y ORDER BY i) AS vector FROM (SELECT cluster, i, avg(y) AS y FROM y JOIN a{p} USING (id) GROUP BY ALL) GROUP BY cluster), m{p + 1} AS MATERIALIZED (SELECT j, coalesce(n{p}.vector, m{p}.vector) AS vector FROM m{p} LEFT JOIN n{p} USING (j))"
    return sql + f" SELECT id, cluster FROM a{passes - 1}"


def _dfs(graph: str, start: int) -> str:
    """One row per event, with the stack and the vertices seen so far."""
    return f"WITH RECURSIVE {graph}, n AS MATERIALIZED (SELECT src, list(dst ORDER BY dst) AS out FROM e GROUP BY src), s(step, event, current, previous, stack, seen) AS (SELECT 0::BIGINT, 'enter', {start}::BIGINT, NULL::BIGINT, [{start}::BIGINT], [{start}::BIGINT] UNION ALL SELECT step + 1, CASE WHEN next IS NULL THEN 'leave' ELSE 'enter' END, coalesce(next, top), CASE WHEN next IS NULL THEN stack[-2] ELSE top END, CASE WHEN next IS NULL THEN stack[:len(stack) - 1] ELSE list_append(stack, next) END, CASE WHEN next IS NULL THEN seen ELSE list_append(seen, next) END FROM (SELECT s.*, s.stack[-1] AS top, list_filter(n.out, lambda z: NOT list_contains(s.seen, z))[1] AS next FROM s LEFT JOIN n ON n.src = s.stack[-1] WHERE len(s.stack) > 0)) SELECT step, event, current, previous FROM s"


def _witness(graph: str) -> str:
    """A shortest cycle, least by its vertices, through the least vertex on any cycle."""
    return f"WITH RECURSIVE {graph}, a AS MATERIALIZED (SELECT src, dst FROM e WHERE src <> dst), t AS (SELECT src AS s, dst AS d FROM a UNION SELECT t.s, a.dst FROM t JOIN a ON a.src = t.d), o AS MATERIALIZED (SELECT min(s) AS root FROM t WHERE s = d), r(id, path) USING KEY (id) AS (SELECT root, [root] FROM o WHERE root IS NOT NULL UNION SELECT a.dst, min(list_append(r.path, a.dst)) FROM r JOIN a ON a.src = r.id LEFT JOIN recurring.r AS q ON q.id = a.dst WHERE q.id IS NULL GROUP BY a.dst), w AS (SELECT path FROM r JOIN a ON a.src = r.id JOIN o ON a.dst = o.root ORDER BY len(path), path LIMIT 1) SELECT unnest(list_append(path[2:], path[1])) AS node, unnest(path) AS predecessor FROM w"


def _basis(graph: str) -> str:
    """One cycle for each edge outside the forest of least shortest paths from each component's least vertex."""
    parts = _components(graph).removeprefix("WITH RECURSIVE ").rsplit(" SELECT id, component FROM r", 1)[0].replace("r(id, component)", "g(id, component)").replace("r.component", "g.component").replace("FROM r JOIN a ON a.src = r.id JOIN recurring.r", "FROM g JOIN a ON a.src = g.id JOIN recurring.g")
    return f"WITH RECURSIVE {parts}, r(id, way) USING KEY (id) AS (SELECT DISTINCT component, [component] FROM g UNION SELECT a.dst, min(list_append(r.way, a.dst)) FROM r JOIN a ON a.src = r.id LEFT JOIN recurring.r AS q ON q.id = a.dst WHERE q.id IS NULL GROUP BY a.dst), p AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM e), t AS (SELECT least(way[-2], id) AS u, greatest(way[-2], id) AS v FROM r WHERE len(way) > 1), x AS (SELECT wu.way AS wu, wv.way AS wv, len(list_filter(list_zip(wu.way, wv.way), lambda z: z[1] = z[2])) AS k FROM (SELECT * FROM p WHERE u <> v EXCEPT SELECT * FROM t) d JOIN r wu ON wu.id = d.u JOIN r wv ON wv.id = d.v) SELECT list_concat(list_reverse(wu[k:]), wv[k + 1:]) AS path FROM x UNION ALL SELECT [u] FROM p WHERE u = v"


def _subgraphs(support: int) -> str:
    """Patterns of one and two edges: an edge, two edges between the same vertices, and paths of three vertices, in the least way to write them."""
    edge = "least(x.lu, x.lw) || ',' || greatest(x.lu, x.lw) || ';0-' || x.flag || '-1'"
    labels = "list_transform(list_sort([{'p': px, 'l': lx}, {'p': pc, 'l': lc}, {'p': py, 'l': ly}]), lambda z: z.l)"
    lines = "list_sort([{'a': least(px, pc), 'b': greatest(px, pc), 'l': e1}, {'a': least(py, pc), 'b': greatest(py, pc), 'l': e2}])"
    return f"""WITH {BASKETS}, f AS (SELECT DISTINCT g, least(src, dst) AS u, greatest(src, dst) AS w, flag FROM be),
x AS MATERIALIZED (SELECT f.*, a.label AS lu, b.label AS lw FROM f JOIN bv a ON a.g = f.g AND a.id = u JOIN bv b ON b.g = f.g AND b.id = w),
arms AS MATERIALIZED (SELECT g, u AS c, lu AS lc, w AS leaf, lw AS l, flag FROM x UNION ALL SELECT g, w, lw, u, lu, flag FROM x),
ways AS MATERIALIZED (SELECT p.g, p.lc, p.l AS lx, p.flag AS e1, q.l AS ly, q.flag AS e2 FROM arms p JOIN arms q ON p.g = q.g AND p.c = q.c AND p.leaf < q.leaf),
o(px, pc, py) AS (VALUES (0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)),
k AS (SELECT lc, lx, e1, ly, e2, min({{'labels': {labels}, 'lines': {lines}}}) AS k FROM (SELECT DISTINCT lc, lx, e1, ly, e2 FROM ways), o GROUP BY ALL),
r AS (SELECT {edge} AS pattern, 2 AS nodes, 1 AS edges, count(DISTINCT x.g) AS support FROM x GROUP BY ALL
UNION ALL SELECT {edge} || ',0-' || y.flag || '-1', 2, 2, count(DISTINCT x.g) FROM x JOIN x y ON y.g = x.g AND y.u = x.u AND y.w = x.w AND x.flag < y.flag GROUP BY ALL
UNION ALL SELECT array_to_string(k.labels, ',') || ';' || array_to_string(list_transform(k.lines, lambda z: z.a || '-' || z.l || '-' || z.b), ','), 3, 2, count(DISTINCT g) FROM ways JOIN k USING (lc, lx, e1, ly, e2) GROUP BY ALL)
SELECT * FROM r WHERE support >= {support}"""


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
_PAIRS = f"{VECTORS}, y AS (SELECT a.id AS a, b.id AS b, a.vector AS x, b.vector AS y FROM x a JOIN x b ON b.id = a.id + 1)"
_NORM = lambda a: f"sqrt(list_sum(list_transform({a}, lambda z: z * z)))"


def oracle_sql() -> dict[str, str]:
    dot = _DOT.format(a="x", b="y")
    return {
        "degree": f"WITH {TRADE} {DEGREE}",
        "degree_supply": f"WITH {SUPPLY} {DEGREE}",
        "in_degree_of": f"WITH {TRADE} SELECT 3::BIGINT AS id, count(*) AS value FROM e WHERE dst = 3",
        "out_degree_of": f"WITH {TRADE} SELECT 3::BIGINT AS id, count(*) AS value FROM e WHERE src = 3",
        "neighbors_all": f"WITH {CHAIN} SELECT CASE WHEN src = 7 THEN dst ELSE src END AS neighbor FROM e WHERE src = 7 OR dst = 7",
        "neighbors_source": f"WITH {CHAIN} SELECT src AS neighbor FROM e WHERE dst = 7",
        "neighbors_target": f"WITH {CHAIN} SELECT dst AS neighbor FROM e WHERE src = 7",
        "incident_edges": f"WITH {CHAIN} SELECT src, dst, weight FROM e WHERE src = 7 OR dst = 7",
        "out_edges": f"WITH {CHAIN} SELECT src, dst, weight FROM e WHERE src = 7",
        "adjacency_undirected": f"WITH {TRADE} SELECT DISTINCT src AS src_idx, dst AS dst_idx, 1 AS value FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)",
        "adjacency_directed": f"WITH {TRADE} SELECT DISTINCT src AS src_idx, dst AS dst_idx, 1 AS value FROM e",
        "bfs_directed": _bfs(GEO, "1", "SELECT src, dst FROM e"),
        "bfs_undirected": _bfs(GEO, "1000001", "SELECT src, dst FROM e UNION SELECT dst, src FROM e"),
        "bfs_filtered": _bfs(GEO, "1", "SELECT src, dst FROM e WHERE dst < 1000 OR dst >= 1012"),
        "bfs_visits": f"WITH RECURSIVE {GEO}, r AS (SELECT 1::BIGINT AS id, 0 AS depth, NULL::BIGINT AS parent, [1::BIGINT] AS way UNION ALL SELECT e.dst, depth + 1, r.id, list_append(way, e.dst) FROM r JOIN e ON e.src = r.id), n AS (SELECT *, row_number() OVER (ORDER BY depth, way) - 1 AS visit FROM r) SELECT visit, id, lag(id) OVER (ORDER BY visit) AS previous, parent, depth FROM n",
        "dfs_events": _dfs(TRADE, 0),
        "weak_components": _components(SUPPLY),
        "weak_components_geo": _components(GEO),
        "strong_components": _closure(CHAIN, "SELECT a.src AS id, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY 1"),
        "strong_components_geo": f"WITH {GEO} SELECT id, id AS component FROM v",
        "has_directed_cycle": f"WITH RECURSIVE {CHAIN}, r AS (SELECT src AS s, dst AS d FROM e UNION SELECT r.s, e.dst FROM r JOIN e ON e.src = r.d) SELECT count(*) > 0 AS has_cycle FROM r WHERE s = d",
        "has_directed_cycle_geo": f"WITH RECURSIVE {GEO}, r AS (SELECT src AS s, dst AS d FROM e UNION SELECT r.s, e.dst FROM r JOIN e ON e.src = r.d) SELECT count(*) > 0 AS has_cycle FROM r WHERE s = d",
        "directed_cycle_witness": _witness(CHAIN),
        "cycle_basis": _basis(TRADE),
        "simple_cycles": _cycles(FLOWS, "true", "true"),
        "simple_cycles_include": _cycles(FLOWS, "true", "list_contains(path, 'click')"),
        "simple_cycles_exclude": _cycles(FLOWS, "true", "NOT list_contains(path, 'click')"),
        "simple_cycles_short": _cycles(TRADE, "len(path) < 3", "len(path) <= 3"),
        "cycle_rank": f"WITH RECURSIVE {SUPPLY}, {UNDIRECTED}, r(id, c) USING KEY (id) AS (SELECT id, id FROM v UNION SELECT u.dst, min(r.c) FROM r JOIN u ON u.src = r.id JOIN recurring.r AS o ON o.id = u.dst WHERE r.c < o.c GROUP BY u.dst) SELECT (SELECT count(*) FROM (SELECT DISTINCT least(src, dst), greatest(src, dst) FROM e)) - count(*) + count(DISTINCT c) AS rank FROM r",
        "shortest_lengths": _bfs(GEO, "1000001", "SELECT src, dst FROM e UNION SELECT dst, src FROM e").replace("SELECT id, depth FROM r", "SELECT id, depth::DOUBLE AS length FROM r"),
        "shortest_weighted": f"WITH RECURSIVE {_lengths(CHAIN)} SELECT id, length FROM r",
        "shortest_all_paths": f"WITH RECURSIVE {_lengths(TRADE)}, t AS MATERIALIZED (SELECT e.src, e.dst FROM e JOIN r a ON a.id = e.src JOIN r b ON b.id = e.dst WHERE a.length + e.weight = b.length), p AS (SELECT 0::BIGINT AS id, [0::BIGINT] AS path UNION ALL SELECT t.dst, list_append(path, t.dst) FROM p JOIN t ON t.src = p.id) SELECT p.id, length, path FROM p JOIN r ON r.id = p.id",
        "shortest_path_pair": f"WITH RECURSIVE {_lengths(CHAIN)}, t AS MATERIALIZED (SELECT e.src, e.dst FROM e JOIN r a ON a.id = e.src JOIN r b ON b.id = e.dst WHERE a.length + e.weight = b.length), p AS (SELECT 0::BIGINT AS id, [0::BIGINT] AS path UNION ALL SELECT t.dst, list_append(path, t.dst) FROM p JOIN t ON t.src = p.id) SELECT length, path FROM p JOIN r ON r.id = p.id WHERE p.id = 5",
        "all_simple_paths": f"WITH RECURSIVE {FLOWS}, p AS (SELECT 'view' AS l, ['view'] AS path UNION ALL SELECT e.dst, list_append(path, e.dst) FROM p JOIN e ON e.src = p.l WHERE p.l <> 'click' AND NOT list_contains(path, e.dst)) SELECT path FROM p WHERE l = 'click'",
        "all_simple_paths_bounded": f"WITH RECURSIVE {TRADE}, p AS (SELECT 0::BIGINT AS l, [0::BIGINT] AS path UNION ALL SELECT e.dst, list_append(path, e.dst) FROM p JOIN e ON e.src = p.l WHERE p.l <> 7 AND NOT list_contains(path, e.dst) AND len(path) <= 3) SELECT path FROM p WHERE l = 7",
        "all_pairs_hops": _closure(TRADE, "SELECT src, dst, dist FROM r"),
        "all_pairs_hops_chain": _closure(CHAIN, "SELECT src, dst, dist FROM r"),
        "all_pairs_hops_undirected": _closure(CHAIN + ", " + UNDIRECTED, "SELECT src, dst, dist FROM r").replace("JOIN e ON e.src", "JOIN u AS e ON e.src"),
        "sssp_predecessor": f"WITH RECURSIVE {_lengths(CHAIN)}, t AS (SELECT e.dst, min(e.src) AS predecessor FROM e JOIN r a ON a.id = e.src JOIN r b ON b.id = e.dst WHERE a.length + e.weight = b.length AND e.dst <> 0 GROUP BY e.dst) SELECT v.id AS target, length AS distance, predecessor FROM v LEFT JOIN r ON r.id = v.id LEFT JOIN t ON t.dst = v.id",
        "mst_kruskal": _forest(TRADE, 25),
        "mst_kruskal_chain": _forest(CHAIN, 100),
        "mst_prim": _forest(TRADE, 25),
        "pagerank": _pagerank(TRADE, 20),
        "pagerank_converged": _pagerank(TRADE, 120),
        "pagerank_supply": _pagerank(SUPPLY, 8),
        "pagerank_column_normalised": _pagerank(TRADE, 20, True),
        "k_core": _k_core(24, 14),
        "label_propagation": _labels(3),
        "label_propagation_converged": _labels(30),
        "modularity_of_partition": f"WITH {CHAIN}, {UNDIRECTED}, k AS (SELECT src AS id, count(*)::DOUBLE AS k FROM u GROUP BY 1), m AS (SELECT sum(k) AS m2 FROM k) SELECT round(((SELECT count(*) FROM u JOIN v a ON a.id = u.src JOIN v b ON b.id = u.dst WHERE a.cluster = b.cluster) - (SELECT sum(s * s) FROM (SELECT sum(k) AS s FROM k JOIN v USING (id) GROUP BY cluster)) / m2) / m2, 9) AS value FROM m",
        "inertial_modularity": f"WITH {VECTORS}, y AS MATERIALIZED (SELECT id, cluster, unnest(vector) AS y, generate_subscripts(vector, 1) AS i FROM x), n AS (SELECT count(*)::DOUBLE AS n FROM x), mu AS (SELECT i, avg(y) AS mu FROM y GROUP BY i), va AS (SELECT sum((y - mu) ** 2) AS v FROM y JOIN mu USING (i)), d AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.cluster AS ca, b.cluster AS cb, list_sum(list_transform(list_zip(a.vector, b.vector), lambda z: (z[1] - z[2]) ** 2)) AS d FROM x a, x b WHERE a.id <> b.id), o AS (SELECT a AS id, sum(d) AS o FROM d GROUP BY 1) SELECT round(sum(p.o * q.o / (2 * n * v) ** 2 - d / (2 * n * v)), 4) AS value FROM d JOIN o p ON p.id = a JOIN o q ON q.id = b, n, va WHERE ca = cb",
        "cluster_edges": f"WITH {TRADE} SELECT a.cluster::BIGINT AS source, b.cluster::BIGINT AS target, sum(weight) AS weight, count(*) AS count FROM e JOIN v a ON a.id = src JOIN v b ON b.id = dst GROUP BY ALL",
        "boundary_weights": f"WITH {TRADE}, c AS (SELECT a.cluster AS s, b.cluster AS t, weight FROM e JOIN v a ON a.id = src JOIN v b ON b.id = dst WHERE a.cluster <> b.cluster) SELECT cluster::BIGINT AS cluster, coalesce(sum(weight), 0)::DOUBLE AS sum_tot FROM (SELECT DISTINCT cluster FROM v) LEFT JOIN c ON s = cluster OR t = cluster GROUP BY cluster",
        "kmeans": _kmeans(4),
        "kmeans_lloyd": _lloyd(4, 5),
        "cosine_pairs": f"WITH {_PAIRS} SELECT a, b, round({dot} / ({_NORM('x')} * {_NORM('y')}), 6) AS cosine FROM y",
        "nodes_cosine": f"WITH {PARTS}, s AS (SELECT * FROM p WHERE id = 0) SELECT p.id, p.id AS pos, round((((p.brand = s.brand)::INT + (p.type = s.type)::INT + (p.size = s.size)::INT)) / 3.0, 6) AS cosine FROM p, s WHERE p.id <> 0",
        "key_values": f"WITH {PARTS} SELECT key, list(value ORDER BY pos) AS values FROM k GROUP BY key",
        "one_hot": f"WITH {PARTS}, w AS (SELECT list(value ORDER BY pos) FILTER (key = 'brand') AS b, list(value ORDER BY pos) FILTER (key = 'type') AS t, list(value ORDER BY pos) FILTER (key = 'size') AS s FROM k) SELECT id, list_concat(list_concat(list_transform(b, lambda z: (z = brand)::INT::DOUBLE), list_transform(t, lambda z: (z = type)::INT::DOUBLE)), list_transform(s, lambda z: (z = size)::INT::DOUBLE)) AS vector FROM p, w",
        "property_keys": "SELECT 'size' AS key, count(*) AS count FROM part",
        "property_weights": "SELECT p_partkey AS id, [p_size::DOUBLE] AS weights FROM part",
        "vector_ops": f"""WITH {_PAIRS} SELECT a, round({_NORM("list_transform(list_zip(x, y), lambda z: z[1] + z[2])")}, 6) AS norm_add, round({_NORM("list_transform(list_zip(x, y), lambda z: z[1] - z[2])")}, 6) AS norm_subtract, round({_NORM("x")} / 4, 6) AS norm_average, round(-({dot}), 6) AS dot_negated, round({_D.format(a="x", b="y")}, 6) AS distance, round({_NORM("list_transform(x, lambda z: (z - list_min(x)) / (list_max(x) - list_min(x)))")}, 6) AS norm_scaled, x = y AS equal FROM y""",
        "frequent_labels": f"WITH {BASKETS} SELECT label, count(DISTINCT g) AS support FROM bv GROUP BY label HAVING count(DISTINCT g) >= 10",
        "frequent_edges": f"WITH {BASKETS} SELECT least(a.label, b.label) AS label1, flag AS edge_label, greatest(a.label, b.label) AS label2, count(DISTINCT be.g) AS support FROM be JOIN bv a ON a.g = be.g AND a.id = src JOIN bv b ON b.g = be.g AND b.id = dst GROUP BY ALL HAVING count(DISTINCT be.g) >= 10",
        "frequent_subgraphs": _subgraphs(100),
        "k_neighbour_units": f"WITH {TRADE}, {UNDIRECTED} SELECT src AS id, cluster::VARCHAR AS label, count(*) AS count FROM u JOIN v ON id = dst WHERE src <> dst GROUP BY ALL",
        "nds_counts": f"WITH {TRADE}, {UNDIRECTED}, h AS MATERIALIZED (SELECT src AS a, dst AS n FROM u UNION SELECT id, id FROM v), p AS (SELECT src AS a, dst AS b FROM e WHERE src < dst), i AS MATERIALIZED (SELECT p.a, p.b, x.n FROM p JOIN h x ON x.a = p.a JOIN h y ON y.a = p.b AND y.n = x.n), f AS (SELECT src, dst FROM e JOIN v s ON s.id = src JOIN v d ON d.id = dst WHERE (s.cluster = 0 AND d.cluster = 1) OR (s.cluster = 1 AND d.cluster = 0)) SELECT p.a, p.b, count(f.src) AS count FROM p LEFT JOIN (SELECT x.a, x.b, f.src FROM i x JOIN f ON f.src = x.n JOIN i y ON y.a = x.a AND y.b = x.b AND y.n = f.dst) f ON f.a = p.a AND f.b = p.b GROUP BY ALL",
        "pattern_match_exact": f"WITH {CHAIN} SELECT a.src AS n0, b.src AS n1, c.src AS n2 FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst AND c.dst = a.src JOIN v x ON x.id = a.src AND x.cluster = 0 JOIN v y ON y.id = b.src AND y.cluster = 1 JOIN v z ON z.id = c.src AND z.cluster = 2",
    }
