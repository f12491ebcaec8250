from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from archspark.operators import diff as d
from archspark.operators import graph as g
from archspark.operators import iterate as it
from archspark.operators import resolve as rs

K = ["project_id"]
PK = ["project_id", "run_id"]


def node_rows(spark, rows):
    """Nodes from (id, kind, name, file, module, language)."""
    df = spark.createDataFrame([("p", *r) for r in rows], "project_id string, id string, kind string, name string, file string, module string, language string")
    return g.node_frame(df, K, id=F.col("id"), kind=F.col("kind"), name=F.col("name"), qualified_name=F.col("name"),
                        file=F.col("file"), module=F.col("module"), language=F.col("language"))


def edge_rows(spark, rows, kind="calls"):
    df = spark.createDataFrame([("p", a, b, float(w)) for a, b, w in rows], "project_id string, a string, b string, w double")
    return g.edge_frame(df, K, source=F.col("a"), target=F.col("b"), kind=F.lit(kind), weight=F.col("w"))


def test_pagerank_against_plain_iteration(spark):
    rnd = random.Random(3)
    ids = [f"n{i}" for i in range(30)]
    edges = {(rnd.choice(ids[:25]), rnd.choice(ids)): rnd.randint(1, 5) for _ in range(90)}
    edges = {k: w for k, w in edges.items() if k[0] != k[1]}
    nodes = node_rows(spark, [(i, "class", i, "", "", "") for i in ids])
    got = {r.id: r.rank for r in it.pagerank(nodes, edge_rows(spark, [(a, b, w) for (a, b), w in edges.items()]), K, max_iterations=10).collect()}
    out = {i: sum(w for (a, _), w in edges.items() if a == i) for i in ids}
    rank = dict.fromkeys(ids, 1 / 30)
    for _ in range(10):
        lost = sum(rank[i] for i in ids if not out[i])
        new = {i: 0.15 / 30 + 0.85 * lost / 30 for i in ids}
        for (a, b), w in edges.items():
            new[b] += 0.85 * rank[a] * w / out[a]
        change = sum(abs(new[i] - rank[i]) for i in ids)
        rank = new
        if change < 1e-6 * 30:
            break
    assert all(abs(got[i] - rank[i]) < 1e-9 for i in ids)


def test_pagerank_stops_by_project_and_leaves_no_tables(spark):
    rnd = random.Random(4)
    graphs = {}
    for project, size, n in (("ring", 12, 0), ("web", 40, 160), ("lone", 3, 0)):
        ids = [f"n{i}" for i in range(size)]
        edges = {(ids[i], ids[(i + 1) % size]): 1 for i in range(size)} if project == "ring" else {}
        edges |= {(rnd.choice(ids[: size // 2]), rnd.choice(ids)): rnd.randint(1, 9) for _ in range(n)}
        graphs[project] = (ids, {k: w for k, w in edges.items() if k[0] != k[1]})
    rows = [(p, i) for p, (ids, _) in graphs.items() for i in ids]
    nodes = spark.createDataFrame(rows, "project_id string, id string")
    nodes = g.node_frame(nodes, K, id=F.col("id"), kind=F.lit("class"), name=F.col("id"), qualified_name=F.col("id"))
    rows = [(p, a, b, float(w)) for p, (_, edges) in graphs.items() for (a, b), w in edges.items()] + [("web", "n0", "elsewhere", 5.0)]
    edges = spark.createDataFrame(rows, "project_id string, a string, b string, w double")
    edges = g.edge_frame(edges, K, source=F.col("a"), target=F.col("b"), kind=F.lit("calls"), weight=F.col("w"))
    got = {(r.project_id, r.id): r.rank for r in it.pagerank(nodes, edges, K, tolerance=1e-4).collect()}
    stops = {}
    for project, (ids, links) in graphs.items():
        out = {i: sum(w for (a, _), w in links.items() if a == i) for i in ids}
        rank = dict.fromkeys(ids, 1 / len(ids))
        for stops[project] in range(1, 61):
            lost = sum(rank[i] for i in ids if not out[i])
            new = {i: (0.15 + 0.85 * lost) / len(ids) for i in ids}
            for (a, b), w in links.items():
                new[b] += 0.85 * rank[a] * w / out[a]
            change = sum(abs(new[i] - rank[i]) for i in ids)
            rank = new
            if change < 1e-4 * len(ids):
                break
        assert all(abs(got[project, i] - rank[i]) < 1e-12 for i in ids)
    assert stops["ring"] == stops["lone"] == 1 < stops["web"] < 60 and len(got) == 55
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("flow_", "shares_"))]


def test_cycles_of_any_length_and_dead_ends(spark):
    rnd = random.Random(8)
    edges = {(f"n{i:02}", f"n{j:02}") for i, j in ((rnd.randrange(14), rnd.randrange(14)) for _ in range(34)) if i != j}
    edges |= {(f"r{i:02}", f"r{(i + 1) % 15:02}") for i in range(15)} | {("r03", f"x{i}") for i in range(40)} | {("n01", "r00")}
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)

    def walk(path):
        for b in out.get(path[-1], []):
            if b == path[0]:
                yield tuple(path)
            elif b > path[0] and b not in path:
                yield from walk([*path, b])

    want = {c for a in out for c in walk([a])}
    df = spark.createDataFrame([("p", a, b) for a, b in edges], "project_id string, src_module string, dst_module string")
    got = [tuple(r.members) for r in it.find_cycles(df, K, max_length=None, limit=None).collect()]
    assert sorted(got) == sorted(want) and max(map(len, want)) == 15
    short = [tuple(r.members) for r in it.find_cycles(df, K, max_length=4, limit=None).collect()]
    assert sorted(short) == sorted(c for c in want if len(c) <= 4)


@pytest.mark.parametrize("size, files, names, asked", [
    (40, 4, ["get", "run", "Load"], 80),
    (300, 150, ["get", *(f"name{i}" for i in range(200))], 1500),  # a third of the references ask for one name of few symbols
])
def test_symbol_choice_against_all_candidates(spark, size, files, names, asked):
    rnd = random.Random(5)
    kinds = ["class", "interface", "function", "method", "enum"]
    rows = [(f"n{i:03}", rnd.choice(kinds), rnd.choice(names), f"f{rnd.randrange(files)}", f"m{rnd.randint(0, 2)}", rnd.choice(["python", "go"])) for i in range(size)]
    links = [(f"n{rnd.randrange(size):03}", f"n{rnd.randrange(size):03}", 1) for _ in range(60)]
    links = sorted({x for x in links if x[0] != x[1]})
    pick = lambda: "get" if rnd.random() < 0.33 else rnd.choice(names)
    refs = [("p", rnd.choice(rows)[0], pick(), rnd.choice(["calls", "inherits", "composes", "uses"])) for _ in range(asked)]
    refs = sorted(set(refs))
    nodes, edges = node_rows(spark, rows), edge_rows(spark, links)
    ref_df = spark.createDataFrame(refs, "project_id string, source_id string, target_name string, kind string").selectExpr(
        "*", "'' as language", "'' as hint_module", "cast(map() as map<string,string>) as attr")
    done = rs.resolve_symbols(rs.with_ref_id(ref_df, K), g.index_symbols(nodes, K), nodes, edges, K)
    got = {(r.source_id, r.target_name, r.kind): r.target for r in done.collect()}
    by_id = {r[0]: r for r in rows}
    deg = {i: sum(i in (a, b) for a, b, _ in links) for i in by_id}
    for _, src, name, kind in refs:
        s = by_id[src]
        cands = [r for r in rows if r[2].lower() == name.lower() and r[0] != src]

        def order(r):
            fits = r[1] in ("class", "interface") if kind in ("inherits", "composes") else r[1] in ("function", "method") if kind == "calls" else False
            return (not fits, r[3] != s[3], r[4] != s[4], r[5] != s[5], deg[r[0]], r[0])

        best = min(cands, key=order, default=None)
        if best and best[4] != s[4] and best[5] != s[5] and len(cands) > 3:
            best = None
        assert got[(src, name, kind)] == (best and best[0]), (src, name, kind)


def test_cycles_against_search(spark):
    rnd = random.Random(8)
    names = [f"m{i}" for i in range(9)]
    pairs = sorted({(rnd.choice(names), rnd.choice(names)) for _ in range(26)})
    pairs = [x for x in pairs if x[0] != x[1]]
    df = spark.createDataFrame([("p", a, b) for a, b in pairs], "project_id string, src_module string, dst_module string")
    got = {tuple(r.members) for r in it.find_cycles(df, K, max_length=5, limit=None).collect()}
    want = set()

    def walk(path):
        for a, b in pairs:
            if a == path[-1]:
                if b == path[0] and len(path) > 1:
                    want.add(tuple(path))
                elif b > path[0] and b not in path and len(path) < 5:
                    walk([*path, b])

    for n in names:
        walk([n])
    assert got == want


def test_reach_and_chain(spark):
    nodes = node_rows(spark, [("e", "api_endpoint", "GET /", "", "", ""), ("t", "table", "orders", "", "", "sql"), *[(f"f{i}", "function", f"f{i}", "", "", "") for i in range(5)]])
    calls = edge_rows(spark, [("f0", "f1", 1), ("f1", "f2", 2), ("f1", "f0", 1), ("f2", "f3", 1), ("f3", "f4", 1)])
    edges = calls.unionByName(edge_rows(spark, [("e", "f0", 1)], "exposes"))
    near = edges.unionByName(edge_rows(spark, [("f2", "t", 1)], "reads"))
    far = edges.unionByName(edge_rows(spark, [("f4", "t", 1)], "reads"))
    assert [(r.source, r.target) for r in it.endpoint_store_reads(near, nodes, K).collect()] == [("e", "t")]
    assert it.endpoint_store_reads(far, nodes, K).isEmpty()
    entry = it.pick_entry_points(nodes, edges, K)
    assert entry.first().id == "e"
    chain = it.call_chain(entry, near, nodes, K, depth=5).orderBy("step").collect()
    assert [(r.caller, r.callee) for r in chain] == [("e", "f0"), ("f0", "f1"), ("f1", "f2"), ("f2", "f3"), ("f2", "t"), ("f3", "f4")]


def test_diff_of_a_graph_with_itself_is_empty(spark):
    nodes = node_rows(spark, [("a", "class", "A", "", "", ""), ("b", "class", "B", "", "", "")])
    edges = edge_rows(spark, [("a", "b", 1)], "uses")
    side = (nodes, edges)
    assert d.diff_nodes(side, side, K).isEmpty() and d.diff_edges(side, side, K).isEmpty() and d.changed_nodes(side, side, K).isEmpty()
    less = (nodes.filter("id = 'a'"), edges.limit(0))
    assert [(r.key, r.change) for r in d.diff_nodes(less, side, K).collect()] == [("class:B", "added")]


def test_commit_logs_and_graph_documents(spark, tmp_path):
    from archspark.operators.history import commit_parent_edges
    from archspark.sources.commits import read_commit_dag, read_commit_log
    from archspark.sources.store import read_graph_json, read_run, write_graph

    run = tmp_path / "log" / "project_id=a" / "run_id=1"
    run.mkdir(parents=True)
    (run / "log.txt").write_text("\x1es1\x1fAda\x1fa@b\x1f1700000000\x1ffirst\n\nsrc/a.py\nsrc/b.py\n\x1ebroken\x1fx\n\x1es0\x1fBob\x1fb@b\x1f1690000000\x1fsecond\n")
    rows = {r.sha: r for r in read_commit_log(spark, str(tmp_path / "log")).collect()}
    assert set(rows) == {"s1", "s0"} and rows["s1"].files == ["src/a.py", "src/b.py"] and rows["s1"].project_id == "a"
    dag = tmp_path / "dag" / "project_id=a" / "run_id=1"
    dag.mkdir(parents=True)
    (dag / "dag.txt").write_text("\x1em\x1fa b\x1fAda\x1fe\x1f5\x1fHEAD -> main\x1fmerge\n\x1ea\x1fz\x1fAda\x1fe\x1f4\x1f\x1fone\n\x1eb\x1f\x1fAda\x1fe\x1f3\x1f\x1ftwo\n")
    commits = read_commit_dag(spark, str(tmp_path / "dag"))
    assert [r.sha for r in commits.orderBy("seq").collect()] == ["m", "a", "b"]
    links = {(r.sha, r.parent): (r.is_merge, r.truncated) for r in commit_parent_edges(commits).collect()}
    assert links == {("m", "a"): (True, False), ("m", "b"): (True, False), ("a", "z"): (False, True)}
    doc = {"meta": {}, "nodes": [
        {"id": "x", "kind": "class", "name": "X", "file": "", "attributes": {"layer": "api"}},
        {"id": "x", "kind": "interface", "name": "X2", "file": "a.py"}],
        "edges": [{"source": "x", "target": "y", "kind": "uses", "weight": 1.0}, {"source": "x", "target": "y", "kind": "uses", "weight": 2.0}, {"source": "x", "target": "x", "kind": "uses"}]}
    at = tmp_path / "graph" / "project_id=a" / "run_id=1"
    at.mkdir(parents=True)
    (at / "graph.json").write_text(json.dumps(doc))
    nodes, edges = read_graph_json(spark, str(tmp_path / "graph"))
    assert [(r.id, r.kind, r.file, r.attr.layer) for r in nodes.collect()] == [("x", "interface", "a.py", "api")]
    assert [(r.source, r.target, r.weight) for r in edges.collect()] == [("x", "y", 3.0)]
    write_graph(nodes, edges, str(tmp_path / "out"))
    assert read_run(spark, str(tmp_path / "out"), "nodes", project_id="a").count() == 1


def test_source_tree(spark, tmp_path):
    from archspark.sources.tree import read_source_tree

    root = tmp_path / "src" / "project_id=a" / "run_id=1"
    for path, body in {"app/main.py": b"x = '\xff'\n", "node_modules/a.js": b"x", "web/a.min.js": b"x", "pic.png": b"x", "empty.py": b"", "Dockerfile": b"FROM a\n"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(body)
    rows = {r.path: r for r in read_source_tree(spark, str(tmp_path / "src")).collect()}
    assert set(rows) == {"app/main.py", "Dockerfile"}
    assert rows["app/main.py"].text == "x = '�'\n" and rows["app/main.py"].project_id == "a" and rows["Dockerfile"].infra_kind == "docker"


def test_cycles_of_any_length(spark):
    ring = [("p", f"r{i}", f"r{(i + 1) % 9}") for i in range(9)]
    rows = [*ring, ("p", "r0", "x"), ("p", "x", "y"), ("p", "a", "b"), ("p", "b", "a"), ("p", "b", "r3"), ("q", "s", "t"), ("q", "s", "s")]
    df = spark.createDataFrame(rows, "project_id string, src_module string, dst_module string")
    comps = it.cyclic_components(df, K)
    got = {(r.project_id, r.module, r.component) for r in comps.collect()}
    assert got == {("p", f"r{i}", "r0") for i in range(9)} | {("p", "a", "a"), ("p", "b", "a")}
    listed = it.find_cycles(df, K)
    assert listed.count() == 1
    assert sorted(r.length for r in it.counted_cycles(comps, K).collect()) == [2, 9]
    assert it.cyclic_components(df.filter("project_id = 'q'"), K).collect() == []


def test_focus_and_modules_of_requests(spark):
    from archspark.operators.review import sanitize_filters

    nodes = spark.createDataFrame(
        [("p", "class", "OrderService", "", "src/orders", "", "service"), ("p", "module", "src/orders", "", "src/orders", "", ""), ("p", "module", "x", "", "src/orders/api", "", "")],
        "project_id string, kind string, name string, qualified_name string, module string, file string, s string",
    ).selectExpr("project_id", "kind", "name", "qualified_name", "module", "file", "named_struct('stereotype', s) attr")
    asked = spark.createDataFrame(
        [("p", 1, "order", ["SRC/Orders"]), ("p", 2, "servi", ["api"]), ("p", 3, "nothing", ["none"]), ("p", 4, None, [])], "project_id string, id int, focus string, modules array<string>")
    got = {r.id: (r.focus, r.modules) for r in sanitize_filters(asked, nodes, ["project_id"]).collect()}
    assert got == {1: ("order", ["src/orders"]), 2: ("servi", ["src/orders/api"]), 3: ("", []), 4: ("", [])}


def test_no_table_of_nodes_goes_through_the_driver(spark, tmp_path):
    """A few short columns of a wide stored table look small to the planner, however many rows there are."""
    from archspark.operators import metrics as m

    node_rows(spark, [("a", "class", "A", "", "x", ""), ("b", "class", "B", "", "y", ""), ("c", "class", "C", "", "z", "")]).write.parquet(f"{tmp_path}/nodes")
    edge_rows(spark, [("a", "b", 1), ("b", "c", 1), ("c", "a", 1)], "uses").write.parquet(f"{tmp_path}/edges")
    nodes, edges = spark.read.parquet(f"{tmp_path}/nodes"), spark.read.parquet(f"{tmp_path}/edges")
    mod = m.module_edges(edges, nodes, K)
    modules = m.module_universe(nodes, mod, K)
    found = {
        "module_edges": mod, "coupling": m.coupling(modules, mod, K), "orphans": m.orphan_modules(modules, mod, K),
        "violations": m.layering_violations(edges, nodes, K), "hubs": m.hub_nodes(nodes, edges, K), "gods": m.god_classes(nodes, edges, K),
        "link": g.link(edges, nodes, K), "diff_edges": d.diff_edges((nodes, edges), (nodes, edges), K),
        "changed": d.changed_nodes((nodes, edges), (nodes, edges), K), "centrality": it.centrality(nodes.select(*K, "id", F.lit(0.5).alias("rank")), nodes, K),
    }
    sent = [name for name, df in found.items() if "Broadcast" in df._jdf.queryExecution().executedPlan().toString()]
    assert not sent
    assert {(r.src_module, r.dst_module, r.weight) for r in mod.collect()} == {("x", "y", 1), ("y", "z", 1), ("z", "x", 1)}


def test_violations_without_names_have_a_fixed_order(spark):
    from archspark.operators import metrics as m

    layers = [("a1", "domain"), ("a2", "data"), ("a3", "application"), ("b", "api")]
    df = spark.createDataFrame([("p", i, layer) for i, layer in layers], "project_id string, id string, layer string")
    nodes = g.node_frame(df, K, attr=g.attr_struct(layer=F.col("layer")), id=F.col("id"), kind=F.lit("class"), name=F.lit(None), qualified_name=F.lit(None))
    edges = edge_rows(spark, [("a1", "b", 1), ("a2", "b", 1), ("a3", "b", 1)], "uses")
    got = {r["rank"]: r["from_layer"] for r in m.layering_violations(edges, nodes, K).collect()}
    assert got == {1: "application", 2: "data", 3: "domain"}


def test_steps_of_cycles_meet_by_shuffle(spark, tmp_path, monkeypatch):
    """Adaptive execution sends a side of under 10 MB of shuffled bytes through the driver, and there it is many times that."""
    from archspark.operators import views as vw

    plans = []

    def cut(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df.localCheckpoint()

    monkeypatch.setattr(it, "cut_lineage", cut)
    node_rows(spark, [("a", "class", "A", "", "x", ""), ("b", "class", "B", "", "y", ""), ("c", "class", "C", "", "z", "")]).write.parquet(f"{tmp_path}/nodes")
    edge_rows(spark, [("a", "b", 1), ("b", "c", 1), ("c", "a", 1)], "uses").write.parquet(f"{tmp_path}/edges")
    nodes, edges = spark.read.parquet(f"{tmp_path}/nodes"), spark.read.parquet(f"{tmp_path}/edges")
    mod = spark.createDataFrame([("p", a, b) for a, b in ("xy", "yz", "zx")], "project_id string, src_module string, dst_module string")
    found = it.find_cycles(mod, K, max_length=3, limit=None)
    assert [r.members for r in found.collect()] == [["x", "y", "z"]]
    joins = [line for p in plans for line in p.splitlines() if "Join " in line]
    assert joins and all("strategy=merge" in line for line in joins)
    shown, links = vw.view_dependency(nodes, edges, vw.Filters(detail="executive"), K, found)
    assert not [1 for df in (shown, links) if "Broadcast" in df._jdf.queryExecution().executedPlan().toString()]
    assert {(r.module, r.in_cycle) for r in shown.collect()} == {("x", True), ("y", True), ("z", True)}
