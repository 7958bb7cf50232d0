from recollect.operators import code, graph, summary


def edges(spark, rows):
    return spark.createDataFrame(rows, "source long, target long")


def reach(spark, rows, node, depth=None):
    start = spark.createDataFrame([(node,)], "node long")
    return sorted(r[0] for r in graph.reach(edges(spark, rows), start, depth).collect())


def test_chain_diamond_cycle_and_loop(spark):
    chain = [(1, 2), (2, 3), (3, 4)]
    assert reach(spark, chain, 1, 2) == [2, 3] and reach(spark, chain, 1) == [2, 3, 4]
    assert reach(spark, [(1, 2), (1, 3), (2, 4), (3, 4)], 1) == [2, 3, 4]
    assert reach(spark, [(1, 2), (2, 1)], 1) == [2]
    assert reach(spark, [(1, 1)], 1) == [] and reach(spark, chain, 9) == []


def test_cycle_members_and_lines(spark):
    e = edges(spark, [(3, 2), (2, 3), (3, 4), (4, 5), (5, 4), (9, 3), (4, None)])
    members = graph.cycle_members(e)
    assert sorted(tuple(r) for r in members.collect()) == [(2, 2), (3, 2), (4, 4), (5, 4)]
    lines = [r["line"] for r in graph.dependency_lines(e.dropna(), graph.cycle_paths(e, members)).collect()]
    assert lines == ["2 -> 3", "3 -> 2", "3 -> 4", "4 -> 5", "5 -> 4", "9 -> 3", "cycle: 2 -> 3 -> 2", "cycle: 4 -> 5 -> 4"]


def test_cycles_on_random_graphs(spark):
    import random

    for seed, n, m in ((1, 12, 14), (2, 16, 20), (3, 9, 9)):
        r = random.Random(seed)
        rows = sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)})
        out = {v: {t for s, t in rows if s == v} for v in range(n)}
        dist = {}  # (v, w): least number of steps, at least 1
        for v in range(n):
            level, step = out[v], 1
            while level:
                dist.update({(v, w): step for w in level})
                level, step = {t for w in level for t in out[w] if (v, t) not in dist}, step + 1
        want = {v: min([w for w in range(n) if (v, w) in dist and (w, v) in dist]) for v in range(n) if (v, v) in dist}
        e = edges(spark, rows)
        members = graph.cycle_members(e)
        assert {x["node"]: x["component"] for x in members.collect()} == want
        paths = {x["component"]: x["path"] for x in graph.cycle_paths(e, members).collect()}
        assert set(paths) == set(want.values())
        for c, path in paths.items():
            assert path[0] == path[-1] == c and len(path) == dist[c, c] + 1 and min(path) == c
            assert all(b in out[a] for a, b in zip(path, path[1:]))


def test_no_cycles(spark):
    for rows in ([], [(1, 2), (2, 3), (1, 3)]):
        e = edges(spark, rows)
        members = graph.cycle_members(e)
        assert members.collect() == [] and graph.cycle_paths(e, members).collect() == []


def test_build_edges(spark):
    raw = spark.createDataFrame([(1, 2, "calls"), (1, 2, "calls"), (2, 1, "called_by"), (1, 1, "calls"), (1, 8, "calls")], "source long, target long, kind string")
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    assert [tuple(r) for r in graph.build_edges(raw, nodes).collect()] == [(1, 2, "calls")]
    assert [tuple(r) for r in graph.dangling(raw, nodes).collect()] == [(8, 1)]


def test_module_edges(spark):
    m = spark.createDataFrame([(1, 10), (2, 10), (3, 20)], "id long, module long")
    assert [tuple(r) for r in graph.module_edges(edges(spark, [(1, 2), (2, 3), (1, 3)]), m).collect()] == [(10, 20)]


def test_literal_search_buckets(spark):
    rows = [(1, "parse", "m.parse", "", ""), (2, "parse_all", "m.parse_all", "", ""), (3, "reparse", "m.x", "", ""), (4, "z", "parse.z", "", ""), (5, "y", "m.y", "(parse)", None), (6, None, None, None, None)]
    c = spark.createDataFrame(rows, "id long, name string, qualified_name string, signature string, description string")
    assert [tuple(r) for r in code.literal_search(c, " Parse ").collect()] == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert code.literal_search(c, " ").collect() == []


def test_python_concepts(spark):
    files = spark.createDataFrame([("a.py", "class A:\n    def f(self, x):\n        return g(x)\ndef g(y):\n    return y\n"), ("b.rs", "fn x(){}"), ("c.py", "def (")], "file string, text string")
    got = {r["qualified_name"]: (r["kind"], r["start_line"], r["calls"]) for r in code.python_concepts(files).collect()}
    assert got == {"A": ("class", 1, ["g"]), "A.f": ("method", 2, ["g"]), "g": ("function", 4, []), "b.rs": ("skipped", 0, []), "c.py": ("skipped", 0, [])}


def test_markdown_is_bounded(spark):
    rows = spark.createDataFrame([("kind", "class", 2), ("kind", "function", 9)] + [("cycle", f"m{i}", 1) for i in range(7)], "section string, item string, n long")
    text = summary.markdown(rows, 3)
    assert text.startswith("# Architecture\n\n## Concepts\n- function: 9\n- class: 2\n\n## Most imported\n- none\n")
    assert text.endswith("## Modules on cycles\n- m0: 1\n- m1: 1\n- m2: 1\n- and 4 more\n")
    assert summary.markdown(rows.limit(0)).count("- none") == 4
