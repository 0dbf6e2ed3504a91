"""Operators on hand-built graphs with known answers."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tests.helpers import graph, ids

from codeloom.functions import columns as C
from codeloom.operators import components, diff, history, lookup, quality, reach, resolve, semantic, textindex, traverse
from codeloom.plans import schema as S
from codeloom.plans.graph import CALLS, expand, expand_packed, unpacked
from codeloom.streaming.sync import Snapshots


def test_calls_and_impact(spark):
    g = graph(spark, [{"id": "P::run"}, {"id": "P::help"}], [("P::run", "P::help", "calls")])
    assert ids(traverse.callees(g, "run")) == ["P::help"] and ids(traverse.callers(g, "P::help")) == ["P::run"]
    assert ids(traverse.impact(g, "run")) == [] and ids(traverse.impact(g, "help")) == ["P::run"]
    ring = graph(spark, [{"id": x} for x in "abc"], [("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "references")])
    assert {(r.id, r.depth) for r in traverse.impact(ring, "a").collect()} == {("c", 1), ("b", 2), ("a", 3)}


def test_paths(spark):
    g = graph(spark, [{"id": x} for x in "abcdx"], [("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls"), ("d", "a", "calls"), ("a", "c", "references")])
    hops = lambda a, b: [(r.id, r.via) for r in traverse.path(g, a, b).collect()]
    assert hops("a", "c") == [("a", None), ("c", "references")]
    assert hops("a", "d") == [("a", None), ("c", "references"), ("d", "calls")]
    assert hops("b", "d") == [("b", None), ("c", "calls"), ("d", "calls")]
    assert hops("a", "a") == [("a", None)] and hops("a", "x") == []


def test_expand_equals_plain_search_for_any_partitions(spark):
    rng = random.Random(3)
    edges = sorted({(str(rng.randrange(40)), str(rng.randrange(40))) for _ in range(90)})
    g = graph(spark, [{"id": str(k)} for k in range(40)], [(a, b, "calls") for a, b in edges])
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
    level, seen, want = ["3"], {"3"}, {("3", 0)}
    for d in range(1, 5):
        level = [y for x in level for y in dict.fromkeys(near.get(x, [])) if y not in seen and not seen.add(y)]
        want |= {(y, d) for y in level}
    for n in (1, 7):
        links = g.links("calls").repartition(n)
        assert {(r.id, r.depth) for r in expand(links, g.nodes.where("id = '3'").select("id"), 4).collect()} == want


def test_hotspots(spark):
    g = graph(
        spark,
        [{"id": x, "metadata": {"complexity": 11} if x == "cxfn" else {}} for x in ("hub", "a", "b", "c", "spread", "outer", "cxfn")] + [{"id": x, "kind": "package"} for x in ("A", "B", "C")],
        [(x, "hub", "calls") for x in ("a", "b", "c", "spread")] + [("spread", x, "calls") for x in "abc"] + [("outer", "spread", "calls"), ("A", "B", "imports"), ("A", "C", "imports"), ("B", "C", "imports")],
    )
    got = quality.hotspots(g)
    top = got["fan_in"].first()
    assert (top.id, top.n, top.impact) == ("hub", 4, 5)
    assert got["fan_out"].first().id == "spread" and got["packages"].first()[:] == ("A", 2) and got["complex"].first().complexity == 11


def test_positions(spark):
    g = graph(spark, [{"id": "F::run", "start_line": 2, "end_line": 4}, {"id": "F::help", "start_line": 6, "end_line": 8}], [("F::run", "F::help", "calls", {"line": 3, "col": 5})])
    assert ids(lookup.definition_at(g, "lib/F.pm", 3)) == ["F::help"] and ids(lookup.definition_at(g, "lib/F.pm", 7)) == []
    assert [(r.line, r.caller) for r in lookup.references_at(g, "lib/F.pm", 6).collect()] == [(3, "F::run")]
    assert ids(lookup.symbol_at(g, "lib/F.pm", 4)) == ["F::run"] and ids(lookup.symbol_at(g, "lib/F.pm", 6)) == ["F::help"] and ids(lookup.symbol_at(g, "lib/F.pm", 3)) == ["F::help"]


def test_search_takes_nothing_for_a_wildcard(spark):
    g = graph(spark, [{"id": "A::foo_bar", "docstring": "Reads the Café menu"}, {"id": "A::fooXbar"}], [])
    assert ids(lookup.symbols_like(g, "FOO_bar")) == ["A::foo_bar"]
    assert ids(lookup.search(g, "cafe MENU")) == ["A::foo_bar"] and ids(lookup.search(g, "menu cafe")) == [] and ids(lookup.search(g, "::")) == []


def test_cochange(spark):
    rows, k = [], 0
    for names in [["A.pm", "B.pm"]] * 4 + [["A.pm"]] + [["C.pm", "D.pm"]] * 3 + [["README", "A.pm"]] + [[f"X{j}.pm" for j in range(8)]] * 3:
        k += 1
        rows += [(str(k), k, "me", False, n) for n in names]
    commits = spark.createDataFrame(rows, S.COMMITS)
    g = graph(spark, [{"id": "a", "file_path": "A.pm"}, {"id": "b", "file_path": "B.pm"}], [("a", "b", "calls")])
    got = history.cochange(commits, g, max_files=5).collect()
    assert [(r.a, r.b, r.support, r.linked) for r in got] == [("C.pm", "D.pm", 3, False), ("A.pm", "B.pm", 4, True)] and got[0].coupling == 1.0
    assert history.cochange(commits, g, min_support=10).count() == 0
    assert history.churn(history.transactions(commits, 3)).count() == 8


def test_layers_and_cycles(spark):
    g = graph(spark, [{"id": x, "kind": "package"} for x in "ABCXY"], [("A", "B", "imports"), ("B", "C", "imports"), ("X", "Y", "imports"), ("Y", "X", "imports")])
    found, broken = components.layers(g)
    assert {(r.module, r.layer) for r in found.collect()} == {("A", 2), ("B", 1), ("C", 0), ("X", 1), ("Y", 0)}
    assert [tuple(r) for r in broken.collect()] == [("Y", "X")]
    assert sorted(tuple(r) for r in components.cycles(g).collect()) == [("X", 2, "X", 0), ("X", 2, "Y", 1)]
    assert ids(components.on_cycles(resolve.module_edges(g, "imports")), "module") == ["X", "Y"]


def plain_components(edges):
    """Reach by repeated steps."""
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near[a].add(b)
    reach = {}
    for v in {x for e in edges for x in e if x is not None}:
        seen, todo = set(), [v]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        reach[v] = seen
    return {v: min(w for w in r if v in reach[w]) for v, r in reach.items() if v in r}, near


@pytest.mark.parametrize("seed,n,m", [(1, 30, 45), (3, 12, 40)])
def test_components_cycles_and_layers_of_random_graphs(spark, seed, n, m):
    rng = random.Random(seed)
    edges = [(f"v{rng.randrange(n):02}", f"v{rng.randrange(n):02}") for _ in range(m)] + [(None, "v01"), ("v02", None), ("v03", "v03")]
    df = spark.createDataFrame(edges, "source string, target string")
    want, near = plain_components(edges)
    assert {r.id: r.component for r in components.components(df).collect()} == want
    rows = components.cycles_of(df).collect()
    assert {r.id: r.component for r in rows} == want
    for c in set(want.values()):
        mine = {v for v, w in want.items() if w == c}
        assert all(r["size"] == len(mine) for r in rows if r.component == c)
        ring = [r.id for r in sorted((r for r in rows if r.component == c and r.hop is not None), key=lambda r: r.hop)]
        assert ring[0] == c and all(b in near[a] for a, b in zip(ring, [*ring[1:], c]))
        far, front, seen = 0, {c}, set()
        while c not in seen:
            front, far = {b for a in front for b in near[a]}, far + 1
            seen |= front
        assert len(ring) == far
    found, broken = components.layered(df)
    layer = {r.id: r.layer for r in found.collect()}
    out = {(r.source, r.target) for r in broken.collect()}
    assert set(layer) == {x for a, b in edges if a and b and a != b for x in (a, b)} and all(want[a] == want[b] for a, b in out)
    for v, l in layer.items():
        assert l == max((layer[b] + 1 for b in near[v] if (v, b) not in out), default=0)


@pytest.mark.parametrize("seed,n,m,lg", [(1, 40, 55, 12), (2, 30, 20, 12), (3, 500, 700, 6)])
def test_sizes_of_what_leads_to_each_vertex(spark, seed, n, m, lg):
    rng = random.Random(seed)
    edges = [(f"v{rng.randrange(n)}", f"v{rng.randrange(n)}") for _ in range(m)] + [("v1", "v1"), (None, "v2")]
    near, want = defaultdict(set), {}
    for a, b in edges:
        if a is not None:
            near[b].add(a)
    for v in {x for e in edges for x in e if x is not None}:
        seen, todo = set(), [v]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        want[v] = len(seen)
    got = {r.id: r for r in reach.reach_sizes(spark.createDataFrame(edges, "source string, target string"), lg=lg).collect()}
    want.update({"v2": want.get("v2", 0)})
    assert {i for i in got} == {x for a, b in edges if a is not None for x in (a, b)}
    assert all(r.exact == (r.size < 1 << lg) and (not r.exact or r.size == want[i]) for i, r in got.items())
    far = [abs(r.size - want[i]) / want[i] for i, r in got.items() if not r.exact]
    # Three standard errors.
    assert not far or max(far) < 3 * 2 ** (-lg / 2)
    assert lg == 12 or far


def test_sketches_are_kept_once_for_all_that_hear_of_them(spark, monkeypatch):
    from codeloom.plans.scratch import Scratch

    # A component of more values than a sketch has, 60 vertices that it leads to, two of them by a vertex of its own each, and one by both these.
    ring = [e for k in range(1, 200) for e in (("r0", f"r{k}"), (f"r{k}", "r0"))]
    leaves = [("r7", f"s{k:02}") for k in range(60)] + [("r1", "x"), ("r2", "y"), ("x", "s00"), ("y", "s01"), ("x", "s02"), ("y", "s02")]
    wrote, save = [], Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        wrote.append(sum(out.where(F.length(f.name) > 200).count() for f in out.schema.fields if f.dataType.simpleString() == "binary"))
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    got = {r.id: r for r in reach.reach_sizes(spark.createDataFrame(ring + leaves, "source string, target string"), lg=6).collect()}
    assert len(got) == 262 and not any(r.exact for r in got.values()) and all(abs(r.size - 200) < 3 * 200 / 8 for r in got.values())
    assert len({r.size for i, r in got.items() if i not in ("s00", "s01", "s02")}) == 1
    assert 0 < sum(wrote) < 30


def test_sets_told_by_base_are_whole(spark):
    rng = random.Random(4)
    # Without cycles, many sets larger than what is told without a base, all below what a sketch has.
    edges = [(f"v{a:03}", f"v{b:03}") for a, b in (sorted(rng.sample(range(120), 2)) for _ in range(330))]
    near = defaultdict(set)
    for a, b in edges:
        near[b].add(a)
    want = {}
    for v in sorted({x for e in edges for x in e}):
        want[v] = near[v].union(*(want[a] for a in near[v]))
    got = reach.reach_sizes(spark.createDataFrame(edges, "source string, target string"), lg=7).collect()
    assert {r.id: r.size for r in got} == {v: len(w) for v, w in want.items()} and max(r.size for r in got) > 60 and all(r.exact for r in got)


def test_components_from_a_sample_of_colours(spark, monkeypatch):
    monkeypatch.setattr(components, "MANY", 1)
    monkeypatch.setattr(components, "OF", 3)
    rng = random.Random(6)
    edges = [(f"v{rng.randrange(40):02}", f"v{rng.randrange(40):02}") for _ in range(60)] * 2 + [(f"w{k}", f"w{(k + 1) % 5}") for k in range(5)]
    want, _ = plain_components(edges)
    assert len(set(want.values())) > 2
    assert {r.id: r.component for r in components.components(spark.createDataFrame(edges, "source string, target string")).collect()} == want


def test_rounds_send_no_side_of_many_rows_by_way_of_the_driver(spark, monkeypatch):
    from codeloom.plans import graph as plans
    from codeloom.plans.scratch import Scratch

    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "d")], "source string, target string")
    edges = Scratch(spark, "test").save(edges, "edges")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    seen, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: seen.append((name, plan(df))) or save(self, df, name))
    monkeypatch.setattr(plans, "FEW", -1)
    sizes = reach.reach_sizes(edges)
    seen.append(("sizes", plan(sizes)))
    assert sorted(map(tuple, sizes.collect())) == [("a", 2, True), ("b", 2, True), ("d", 2, True)]
    assert len(seen) > 10 and [name for name, p in seen if "Broadcast" in p] == []


def test_roots_that_share_rows_meet_what_each_meets_alone(spark):
    from codeloom.plans.scratch import Scratch

    rng = random.Random(11)
    edges = [(str(rng.randrange(90)), str(rng.randrange(90))) for _ in range(110)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
    want = set()
    for root in range(70):
        seen, front = {str(root)}, {str(root)}
        for depth in range(4):
            want |= {(f"r{root}", x, depth) for x in front}
            front = {b for a in front for b in near[a]} - seen
            seen |= front
    links = Scratch(spark, "test").save(spark.createDataFrame(edges, "source string, target string"), "links")
    seeds = spark.createDataFrame([(f"r{k}", str(k)) for k in range(70)], "root string, id string")
    found = unpacked(*expand_packed(links, seeds, 3)).select("root", "id", "depth").collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_sketched_hotspots_and_reviews_count_alike(spark):
    rng = random.Random(7)
    nodes = [{"id": f"p::f{k}", "file_path": f"t/{k % 5}.t" if k % 6 == 0 else "lib/p.pm"} for k in range(40)]
    edges = [(f"p::f{rng.randrange(40)}", f"p::f{rng.randrange(40)}", rng.choice(["calls", "references"])) for _ in range(55)]
    g = graph(spark, nodes, edges)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(quality.hotspots(g)["fan_in"]) == rows(quality.hotspots(g, sketched=True)["fan_in"])
    changes = diff.diff(g.nodes.where("id <> 'p::f3'"), g.nodes.withColumn("signature", F.lit("($x)")))
    counted, estimated = diff.review(g, changes), diff.review(g, changes, sketched=True)
    assert all(rows(counted[k]) == rows(estimated[k]) for k in ("symbols", "affected"))


def test_indexes_answer_as_scans_do(spark, tmp_path):
    rng = random.Random(2)
    words = ["get", "set", "Get_Item", "é", "x", "İx", "get::set", "a-b", "日本", "GET set"]
    nodes = [{"id": f"n{k}", "name": rng.choice(words), "qualified_name": rng.choice([None, "::".join(rng.choices(words, k=3))]), "docstring": rng.choice([None, "", " ".join(rng.choices(words, k=6))]), "kind": rng.choice(["function", "file"])} for k in range(60)]
    g = graph(spark, nodes, [])
    Snapshots(spark, str(tmp_path)).write(g)
    stored, _ = Snapshots(spark, str(tmp_path)).read()
    rows = lambda df: [r.id for r in df.collect()]
    assert stored.postings is not None and stored.pieces is not None
    for phrase in ("get", "GET set", "set get item", "x x", "", "::", "日本 get", "nothing here"):
        assert rows(lookup.search(stored, phrase)) == rows(lookup.search(g, phrase))
        assert rows(lookup.search(stored, phrase, 3)) == rows(lookup.search(g, phrase, 3))
    for text in ("g", "et", "get", "Get_I", "::", "%", "_", "日本::", "", "t::s", "none such"):
        assert rows(lookup.symbols_like(stored, text)) == rows(lookup.symbols_like(g, text))
    plan = textindex.having_phrase(stored.postings, "get set")._jdf.queryExecution().toString()
    assert "PartitionFilters: [_bucket" in plan and "In(token" in plan
    assert g.with_(edges=g.edges).postings is None and stored.with_(nodes=g.nodes).pieces is None and stored.with_(edges=g.edges).pieces is not None


@pytest.mark.parametrize("seed,stretch", [(1, 4_096), (2, 1), (3, 7)])
def test_sites_fall_into_the_innermost_definition(spark, seed, stretch):
    rng = random.Random(seed)
    nodes = []
    for k in range(120):
        a = rng.randrange(1, 150)
        nodes.append({"id": f"n{k:03}", "file_path": rng.choice(["a.pm", "b.pm", None]), "start_line": rng.choice([a, a, a, None]), "end_line": rng.choice([a, a + rng.randrange(5), a + rng.randrange(120), None, a - 1]), "qualified_name": rng.choice([None, "q", f"q{k % 7}"]), "kind": rng.choice(["function", "class", "file"])})
    g = graph(spark, nodes, [])
    sites = [(f, rng.randrange(1, 260)) for f in ("a.pm", "b.pm", "none.pm") for _ in range(60)]
    key = lambda n: (n["start_line"], n["qualified_name"] is not None, n["qualified_name"] or "", n["id"])
    want = set()
    for f, l in set(sites):
        met = [n for n in nodes if n["kind"] != "file" and n["file_path"] == f and n["start_line"] is not None and n["start_line"] <= l and (n["end_line"] is None or n["end_line"] >= l) and (n["end_line"] is None or n["end_line"] >= n["start_line"])]
        if met:
            best = max(met, key=key)
            want.add((f, l, best["id"], best["qualified_name"], best["start_line"]))
    got = lookup.nodes_covering(g, spark.createDataFrame([*sites, (None, 3)], "file string, line int"), stretch)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    f, l, *rest = sorted(want, key=str)[0]
    assert [tuple(r) for r in lookup.node_covering(g, f, l).collect()] == [(f, l, *rest)]


def test_a_long_chain_and_a_long_ring(spark):
    chain = [(f"c{k:03}", f"c{k + 1:03}") for k in range(9)]
    ring = [(f"r{k:03}", f"r{(k + 1) % 9:03}") for k in range(9)]
    df = spark.createDataFrame([*chain, *ring, ("c009", "r007")], "source string, target string")
    assert {r.id for r in components.components(df).collect()} == {a for a, _ in ring}
    assert {r.component for r in components.cycles_of(df).where("hop is not null").collect()} == {"r000"}
    assert components.components(df.limit(0)).count() == 0 and components.layered(df.limit(0))[0].count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_met_from_both_ends(spark, seed):
    """As a search from one end finds them: parents by edge order, then id."""
    rng = random.Random(seed)
    edges = [(f"v{rng.randrange(25):02}", f"v{rng.randrange(25):02}", "calls", rng.randrange(9)) for _ in range(40)]
    links = spark.createDataFrame(edges, "source string, target string, kind string, edge_ord long")
    for a, b in (("v00", "v01"), ("v02", "v03"), ("v04", "v04"), ("v05", "v06")):
        level, seen, at = {a: None}, {a}, [{a: None}]
        while level and b not in level:
            found = {}
            for s, t, _, o in edges:
                if s in level and t not in seen:
                    found[t] = min(found.get(t, (o, s)), (o, s))
            level = found
            seen |= set(found)
            at.append(found)
        want, x = [], b
        for k in range(len(at) - 1, -1, -1) if level else ():
            want.append((k, x))
            x = at[k][x][1] if k else None
        seeds, ends = (spark.createDataFrame([(v,)], "id string") for v in (a, b))
        got = traverse.between(links, seeds, ends)
        assert ([(k, v) for k, v, _ in got] if got else []) == want[::-1]


def test_metrics_count_the_groups_of_modules_in_circles(spark):
    g = graph(spark, [{"id": x, "kind": "package"} for x in "ABC"], [("A", "B", "imports"), ("B", "A", "imports"), ("B", "C", "imports")])
    row = quality.metrics(g).first()
    assert (row.cycles, row.packages, row.edges) == (1, 3, 3)


def test_a_search_for_a_path_that_is_not_over_says_so(spark):
    g = graph(spark, [{"id": x} for x in "abcd"], [("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls")])
    start, end = lookup.defs(g, "a"), lookup.defs(g, "d").select("id")
    assert [r[1] for r in traverse.between(g.walks(*CALLS), start, end, most=3)] == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        traverse.between(g.walks(*CALLS), start, end, most=2)


def test_overview(spark):
    g = graph(spark, [{"id": "r", "kind": "route", "name": "/in"}, {"id": "P::h"}], [("r", "P::h", "references", {"metadata": {"via": "route"}}), ("P::h", None, "sink")], [{"from_node_id": "P::h", "reference_name": "x"}])
    got = quality.overview(g)
    assert got["totals"].first()[:] == (0, 2, 2, 1)
    assert [tuple(r) for r in got["routes"].collect()] == [("r", "/in", "P::h", "P::h")]


def test_owners(spark):
    g = graph(spark, [{"id": "a", "file_path": "A"}, {"id": "b", "file_path": "B"}, {"id": "c", "file_path": "B"}], [("b", "a", "calls"), ("c", "a", "calls"), ("c", "b", "calls")])
    authors = spark.createDataFrame([("A", "solo", 10), ("B", "solo", 3), ("B", "other", 5)], "file string, author string, commits long")
    got = [(r.file, r.author, r.share, r.fan_in, r.alone) for r in history.owners(g, authors).collect()]
    assert got == [("A", "solo", 1.0, 2, True), ("B", "other", 0.625, 0, False)]
    assert [r.author for r in history.suggest_reviewers(authors, authors.select("file")).collect()] == ["solo", "other"]


def test_ranked_upsert(spark):
    g = graph(spark, [{"id": "a"}, {"id": "b"}], [])
    new = graph(spark, [], [("a", "b", "calls", {"provenance": p, "line": line, "metadata": m}) for p, line, m in [("heuristic", 3, {"via": "x", "name": "n"}), ("llm", 9, {"module": "no"}), ("optree", None, {"via": "y"}), ("static", 7, None), ("mop", 8, None)]]).edges
    r = resolve.upsert_edges(g.edges, new).collect()
    assert len(r) == 1 and (r[0].provenance, r[0].line, r[0].metadata.via, r[0].metadata.name, r[0].metadata.module) == ("optree", 3, "y", "n", None)


def test_ancestry_of_a_diamond_and_of_a_ring(spark):
    named = lambda a, b: (a, None, "extends", {"metadata": {"name": b}})
    g = graph(spark, [{"id": x, "kind": "class"} for x in "ABCDRS"] + [{"id": "A::m", "kind": "method"}, {"id": "D::AUTOLOAD"}], [named("D", "B"), named("D", "C"), named("B", "A"), named("C", "A"), named("R", "S"), named("S", "R")])
    line = {}
    for r in resolve.linearized(g).orderBy("class", "pos").collect():
        line.setdefault(r["class"], []).append(r.ancestor)
    assert line["D"] == ["D", "B", "A", "C"] and line["R"] == ["R", "S"]


def test_unused_and_api(spark):
    g = graph(
        spark,
        [{"id": "M", "kind": "package"}] + [{"id": f"M::{x}"} for x in ("called", "alone", "new", "_build_x", "dynamic", "self_call", "method")] + [{"id": "M::out", "is_exported": True}, {"id": "M::_own", "visibility": "private"}],
        [("M", f"M::{x}", "contains") for x in ("called", "alone", "_own")] + [("M::alone", "M::called", "calls"), ("M::self_call", "M::self_call", "calls")],
        [{"from_node_id": "M::called", "reference_name": "dynamic"}],
    )
    assert ids(quality.unused(g)) == ["M::_own", "M::alone", "M::method"]
    assert {"M::new", "M::out", "M::_build_x"} <= set(ids(quality.unused(g, everything=True)))
    assert ids(quality.api(g, "M")) == ["M::alone", "M::called"] and ids(quality.dead_exports(g)) == ["M::out"]
    assert ids(quality.undocumented(g)) == ["M::alone", "M::called"]


def test_targets_by_division(spark):
    g = graph(
        spark, [{"id": "Desk::go"}] + [{"id": x, "kind": "method"} for x in ("Db::insert", "Db::close", "Log::insert")], [],
        [{"from_node_id": "Desk::go", "reference_name": m, "candidates": {"receiver": "$db"}, "line": 4} for m in ("insert", "insert", "close")],
    )
    r = resolve.resolve_targets(g).collect()
    assert [(x.receiver, x.calls, list(x.classes)) for x in r] == [("$db", 3, ["Db"])]
    open_ = {x.method: list(x.candidates) for x in resolve.unresolved(g).collect()}
    assert open_ == {"insert": ["Db::insert", "Log::insert"], "close": ["Db::close"]}
    given = spark.createDataFrame([("Desk::go", "$db", None, None, "Db"), ("Desk::go", "$x", "insert", "Db::insert", None)], "caller string, receiver string, method string, target string, receiver_type string")
    good, bad = resolve.resolve_given(g, given)
    assert {(x.method, x.target_qname) for x in good.collect()} == {("insert", "Db::insert"), ("close", "Db::close")}
    assert [x.reason for x in bad.collect()] == ["no such unresolved call"]
    new = resolve.resolve_all(g.with_(resolutions=resolve.learn(g.resolutions, good)))
    assert {(x.target, x.provenance) for x in new.edges.collect()} == {("Db::insert", "llm"), ("Db::close", "llm")} and new.refs.count() == 0


def test_runtime_rows_merge(spark):
    g = graph(spark, [{"id": "K", "kind": "class"}, {"id": "K::a", "kind": "method"}], [("K", "K::a", "contains")])
    seen = spark.createDataFrame([("method", "a", "K::a", "K", "mop"), ("method", "b", "K::b", "K", "symtab"), ("field", "a", "K::a", "K", "mop")], "kind string, name string, qualified_name string, package string, provenance string")
    edges = spark.createDataFrame([("K::b", "K::a", "calls", "optree", 3)], "source_qname string, target_qname string, kind string, provenance string, line int")
    new = resolve.merge_runtime(g, seen, edges)
    assert sorted((r.kind, r.qualified_name) for r in new.nodes.collect()) == [("class", "K"), ("field", "K::a"), ("method", "K::a"), ("method", "K::b")]
    assert ("calls", "optree") in {(r.kind, r.provenance) for r in new.edges.collect()}


def test_signatures(spark):
    row = spark.createDataFrame([("($a, $b = f(1, 2), @rest)",), ("($x)",), ("()",), (None,), ("($self, %h)",)], "s string")
    got = row.select(C.signature_params(row.s).alias("p"), C.signature_arity(row.s).alias("a")).collect()
    assert [list(r.p) for r in got] == [["$a", "$b", "@rest"], ["$x"], [], [], ["$self", "%h"]]
    assert [(r.a.low, r.a.high) for r in got] == [(1, None), (1, 1), (0, 0), (0, 0), (1, None)]


def test_node_ids_are_stable(spark):
    import hashlib

    row = spark.createDataFrame([("function", "A::b", "b", "x.pm"), ("file", None, "n", None)], "k string, q string, n string, f string")
    got = [r.i for r in row.select(C.node_id(row.k, row.q, row.n, row.f).alias("i")).collect()]
    assert got == [hashlib.sha1(b"function\0A::b\0x.pm").hexdigest(), hashlib.sha1(b"file\0n\0").hexdigest()]


def test_semantic(spark):
    g = graph(spark, [{"id": "A::validate_input", "docstring": "validate user input"}, {"id": "A::other", "docstring": "draws a chart"}], [])
    g = g.with_(embeddings=semantic.embed(g.nodes))
    assert semantic.semantic(g, "validate user input").first().id == "A::validate_input"
    assert semantic.prune(g.with_(nodes=g.nodes.where("id = 'A::other'"))).count() == 1


def test_diff_and_gate(spark):
    old = graph(spark, [{"id": "M::a", "signature": "($x)"}, {"id": "M::gone"}, {"id": "M::_own", "visibility": "private"}], [])
    new = graph(spark, [{"id": "M::a", "signature": "($x, $y)"}, {"id": "M::fresh"}], [("T::t", "M::a", "calls")])
    d = diff.diff(old.nodes, new.nodes)
    assert {(r.change, r.qualified_name, r.breaking) for r in d.collect()} == {("signature", "M::a", True), ("removed", "M::gone", True), ("removed", "M::_own", False), ("added", "M::fresh", False)}
    assert diff.semver(d).first()[:] == ("MAJOR", 2, 1, 4)
    assert "### Removed" in diff.changelog(d)
    r = diff.gate(new, d).first()
    assert (r.breaking, r.untested, r.score, r.verdict) == (2, 2, 58, "BLOCK")


def test_gate_compares_all_nodes_once(spark, monkeypatch):
    from codeloom.plans.scratch import Scratch

    wrote, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: wrote.append(name) or save(self, df, name))
    g = graph(spark, [{"id": "M::a"}, {"id": "M::b"}], [("T::t", "M::a", "calls")])
    r = diff.gate(g, diff.diff(g.nodes.where("id <> 'M::a'"), g.nodes)).first()
    assert (r.breaking, r.untested, r.wide, r.score, r.verdict) == (0, 1, 0, 94, "PASS") and "changes" in wrote and "refs" in wrote


def test_queries_without_sql_walk_to_the_operators_depth(spark, monkeypatch):
    from codeloom.plans import queries, star

    subs = [{"id": f"M::s{k}"} for k in range(9)]
    subs[0]["metadata"] = {"taint_source": "ENV"}
    calls = [(f"M::s{k}", f"M::s{k + 1}", "calls") for k in range(8)]
    g = graph(spark, [*subs, {"id": "P2", "file_path": "t/p.t"}], [*calls, ("P2", "M::s0", "calls"), ("M::s8", None, "sink", {"metadata": {"sink": "sql", "name": "do", "dynamic": True}})])
    monkeypatch.setattr(star, "graph", lambda *a, **k: g)
    assert [(r.src_sub, r.sink_sub) for r in queries.QUERIES["taint"](spark, "").collect()] == [("M::s0", "M::s8")]
    review = queries.diff.review
    depths = []
    monkeypatch.setattr(queries.diff, "review", lambda g, c, **k: depths.append(k) or review(g, c, **k))
    queries.QUERIES["review_symbols"](spark, "")
    assert depths == [{}]


def test_the_best_taint_paths_are_found_without_all(spark, monkeypatch):
    rng = random.Random(1)
    names = [f"M::s{k:02}" for k in range(40)]
    nodes = [{"id": n} for n in names]
    for k in (0, 3, 5, 9, 11, 39):
        nodes[k]["metadata"] = {"taint_source": "ENV"}
    # s39 passes its value on along a chain of its own, to a sink farther away than all others' nearest.
    for k in range(30, 39):
        nodes[k]["metadata"] = {"taint_out": [{"callee": f"s{k - 1}", "method": 0, "arg": 0, "param": 0, "src": 0}], "sink_params": [0] if k == 30 else None}
    nodes[39]["metadata"]["taint_out"] = [{"callee": "s38", "method": 0, "arg": 0, "src": 1}]
    calls = sorted({(names[rng.randrange(30)], names[rng.randrange(30)]) for _ in range(70)} | {(names[k], names[k - 1]) for k in range(31, 40)})
    sink = {"metadata": {"sink": "sql", "name": "do", "dynamic": True}}
    g = graph(spark, nodes, [*((a, b, "calls") for a, b in calls), *((names[k], None, "sink", sink) for k in (5, 7, 12, 21, 28, 30))])
    deepest = []
    plain = traverse.expand
    monkeypatch.setattr(traverse, "expand", lambda links, seeds, most, *a, keys=(), **k: (keys and deepest.append(most), plain(links, seeds, most, *a, keys=keys, **k))[1])
    every = traverse.taint(g, limit=10_000).collect()
    assert every[0].src_sub == names[39] and every[0].param_flow and len(every[0].path) == 10 and deepest == [39, 39]
    for n in (2, 5):
        assert traverse.taint(g, limit=n).collect() == every[:n]
    assert 0 in deepest and 1 in deepest


def test_pieces_are_few_and_each_query_writes_its_own_index(spark, monkeypatch):
    from codeloom.plans import queries

    g = graph(spark, [{"id": "n", "name": "abcab", "qualified_name": "abcab"}], [])
    found = textindex.pieces(g.nodes)
    assert found.columns == ["bucket", "piece", "id"] and ids(found, "piece") == ["ab\0", "abc", "b\0\0", "bca", "cab"]
    wrote = []
    plain = queries._indexed
    monkeypatch.setattr(queries, "_indexed", lambda index: wrote.append(index.columns[1]) or plain(index))
    for q in ("search_indexed", "symbols_like_indexed"):
        queries.QUERIES[q](spark, "/root/testdata/sf0.001")
    assert wrote == ["token", "piece"]


def test_queries_have_the_tests_of_all_customers(spark, monkeypatch):
    from codeloom.plans import queries, star

    sf = "/root/testdata/sf0.01"
    tests = lambda g: {r.source for r in g.edges.where("kind = 'calls' and source like 'C%'").select("source").distinct().collect()}
    seen = []
    monkeypatch.setattr(queries.quality, "metrics", seen.append)
    queries.QUERIES["metrics"](spark, sf)
    orders = spark.read.parquet(f"{sf}/orders.parquet").join(spark.read.parquet(f"{sf}/lineitem.parquet"), F.expr("o_orderkey = l_orderkey"))
    want = orders.join(spark.read.parquet(f"{sf}/customer.parquet").where("c_mktsegment = 'BUILDING'"), F.expr("o_custkey = c_custkey"))
    want = {f"C{r.c_custkey}" for r in want.select("c_custkey").distinct().collect()}
    assert tests(seen[0]) == tests(star.graph(spark, sf)) == want
