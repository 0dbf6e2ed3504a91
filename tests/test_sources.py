"""Sources to a graph, kept up to date by syncs and a stream."""

import json
import random

import pytest

from codeloom.operators import lookup, quality, resolve, textindex, traverse
from codeloom.sources import files
from codeloom.sources.perl import pod, xs
from codeloom.sources.perl.extract import extract
from codeloom.streaming.sync import Snapshots, sync, watch, watch_tree

SHOP = r"""
package Shop::Cart;
use Moo;
use Shop::Util qw(total);
extends 'Shop::Thing';
with 'Shop::Role::Priced';
has owner => (is => 'rw', isa => 'Shop::Owner');
our @EXPORT_OK = qw(checkout);
=head2 checkout($self)

Pays for all.

=head2 refund($self)

Gone.

=cut
sub checkout ($self, $how, $when = 0) {
    my $bill = Shop::Bill->new(1);
    $bill->print_out;
    $self->owner->notify($how);
    $self->log_it if $how && $when || $how;
    total($how, 2);
    $self->missing_one;
    return $bill;
}
sub _never { 1 }
"""
UTIL = r"""
package Shop::Util;
sub total ($x, $y) { return $x + $y }
sub run_it ($cmd) { system "do $cmd" }
sub entry { my $n = $ENV{NAME}; run_it($n) }
"""
REST = r"""
package Shop::Thing;
sub log_it { print "x" }
package Shop::Bill;
sub new { bless {}, shift }
sub print_out { total(1) }
package Shop::Owner;
sub notify { 1 }
package Shop::Role::Priced;
use Moo::Role;
sub price { $_[0]->whatever }
"""
TEST = "use Shop::Util;\nShop::Util::total(1, 2, 3);\n"


@pytest.fixture()
def tree(tmp_path):
    for name, text in (("lib/Shop/Cart.pm", SHOP), ("lib/Shop/Util.pm", UTIL), ("lib/Shop/Rest.pm", REST), ("t/total.t", TEST), ("README.md", "no code"), ("blib/x.pm", "package X;")):
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path / "tree"


def pairs(g):
    n = {r.id: r.qualified_name for r in g.nodes.select("id", "qualified_name").collect()}
    return {(n.get(r.source), n.get(r.target), r.kind, r.provenance) for r in g.edges.where("target is not null").select("source", "target", "kind", "provenance").collect()}


def test_index_and_resolution(spark, tree):
    g, sites = files.index(spark, str(tree))
    assert {r.path for r in g.files.collect()} == {"lib/Shop/Cart.pm", "lib/Shop/Util.pm", "lib/Shop/Rest.pm", "t/total.t"}
    found = pairs(g)
    assert ("Shop::Cart::checkout", "Shop::Bill::new", "calls", "static") in found
    assert ("Shop::Cart::checkout", "Shop::Bill::print_out", "calls", "inferred") in found
    assert ("Shop::Cart::checkout", "Shop::Owner::notify", "calls", "inferred") in found
    assert ("Shop::Cart::checkout", "Shop::Thing::log_it", "calls", "heuristic") in found
    assert ("Shop::Cart::checkout", "Shop::Util::total", "calls", "static") in found
    assert ("Shop::Cart", "Shop::Thing", "extends", "static") in found
    assert {r.method for r in quality.check_calls(g).collect()} == {"missing_one"}
    wrong = quality.check_args(g, sites).collect()
    assert [(r.callee, r.got, r.file) for r in wrong] == [("Shop::Util::total", 1, "lib/Shop/Rest.pm"), ("Shop::Util::total", 3, "t/total.t")]
    docs = quality.check_docs(g, files.texts(files.read_sources(spark, str(tree)))).collect()
    assert [(r.name, r.file) for r in docs] == [("refund", "lib/Shop/Cart.pm")]
    assert [r.file_path for r in traverse.covers(g, "Shop::Util::total").collect()] == ["t/total.t"]
    line = [(r.ancestor, r.pos) for r in resolve.linearized(g).where("class = 'Shop::Cart'").orderBy("pos").collect()]
    assert line == [("Shop::Cart", 0), ("Shop::Thing", 1), ("Shop::Role::Priced", 2)]


def test_taint_goes_through_a_parameter(spark, tree):
    g, _ = files.index(spark, str(tree))
    rows = traverse.taint(g).collect()
    assert [(r.src_sub, r.sink_sub, r.param_flow, r.value_flow, list(r.path)) for r in rows] == [("Shop::Util::entry", "Shop::Util::run_it", True, False, ["Shop::Util::entry", "Shop::Util::run_it"])]


def test_sync_equals_a_new_index(spark, tree, tmp_path):
    g, sites = files.index(spark, str(tree))
    store = Snapshots(spark, f"file://{tmp_path}/graph")
    store.write(g, sites)
    g, sites = store.read()
    same, _, change = sync(g, files.read_sources(spark, str(tree)), sites)
    assert change.added == change.changed == change.deleted == [] and same is g
    (tree / "lib/Shop/Util.pm").write_text(UTIL.replace("sub total", "\n\nsub totals"))
    (tree / "lib/Shop/New.pm").write_text("package Shop::New; sub fresh { Shop::Util::entry() }")
    (tree / "t/total.t").unlink()
    new, _, change = sync(g, files.read_sources(spark, str(tree)), sites)
    assert (change.added, change.changed, change.deleted) == (["lib/Shop/New.pm"], ["lib/Shop/Util.pm"], ["t/total.t"])
    assert "lib/Shop/Cart.pm" in change.dependents
    again, _ = files.index(spark, str(tree))
    assert pairs(new) == pairs(again)
    names = lambda x: sorted((r.from_node_id, r.reference_name, r.line) for r in x.refs.collect())
    assert names(new) == names(again)
    assert "total" in {r.reference_name for r in new.refs.collect()}
    # The indexes of words and pieces were kept up, and are those of the nodes there are now.
    for kept, made in ((new.postings, textindex.node_postings(again.nodes)), (new.pieces, textindex.pieces(again.nodes))):
        assert sorted(map(str, kept.select(*made.columns).collect())) == sorted(map(str, made.collect()))
    store.write(new)
    assert {r.qualified_name for r in lookup.search(store.read()[0], "fresh").collect()} == {"Shop::New::fresh"}
    assert lookup.search(store.read()[0], "total t").count() == 0


def _module(rng, k):
    """A module that inherits, imports, and calls what the others may or may not define."""
    subs = rng.sample(["alpha", "beta", "gamma", "delta", "make"], rng.randint(1, 4))
    head = [f"package R::M{k};"]
    if rng.random() < 0.6:
        head.append(f"use parent -norequire, 'R::M{rng.randrange(7)}';")
    if rng.random() < 0.6:
        head.append(f"use R::M{rng.randrange(7)} qw({rng.choice(subs)} {rng.choice(['alpha', 'omega'])});")
    calls = ["alpha();", "omega(1);", "$self->beta;", "$self->SUPER::gamma();", "R::M{n}->make->delta;", "my $x = R::M{n}->make; $x->alpha;", "$y->gamma(2);", "R::M{n}::beta();", "my $z = make(); $z->omega;"]
    body = [f"sub {x} {{ my $self = shift; {' '.join(c.replace('{n}', str(rng.randrange(7))) for c in rng.sample(calls, 4))}" + (f" return R::M{rng.randrange(7)}->new;" if x == "make" else "") + " }" for x in subs]
    return "\n".join([*head, *body, "1;"]) + "\n"


def test_resolution_by_deltas_equals_the_whole(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    tree = tmp_path / "src"
    tree.mkdir()
    for k in range(7):
        (tree / f"M{k}.pm").write_text(_module(rng, k))
    (tree / "far.pl").write_text("".join(f"$q{k}->nowhere{k}; lost{k}();\n" for k in range(40)))
    store = Snapshots(spark, f"file://{tmp_path}/graph")
    store.write(*files.index(spark, str(tree)))
    whole = lambda old, g, lost, fresh, start: (resolve.resolve_all(g), g.refs.select("ref_ord"))
    told = lambda g: (sorted(map(str, g.edges.drop("edge_ord").collect())), sorted(map(str, g.refs.drop("ref_ord").collect())))
    for step in range(2):
        for k in rng.sample(range(7), 1 + step):
            (tree / f"M{k}.pm").write_text(_module(rng, k))
        if step == 1:
            (tree / "M3.pm").unlink()
        g, _ = store.read()
        sources = files.read_sources(spark, str(tree))
        new, _, change = sync(g, sources)
        with monkeypatch.context() as m:
            m.setattr(resolve, "resolve_changed", whole)
            plain, _, all_ = sync(g, sources)
        assert told(new) == told(plain), step
        # The far file's open references, whose names nothing else has, are not joined again, unless a class changed what it is.
        assert 0 < change.refs_again <= all_.refs_again - 40
        store.write(new)


def test_a_stream_of_listings_sees_deletions(spark, tree, tmp_path):
    import os
    import time

    g, sites = files.index(spark, str(tree))
    store = Snapshots(spark, f"file://{tmp_path}/graph")
    store.write(g, sites)
    (tree / "lib/Shop/More.pm").write_text("package Shop::More; sub more { Shop::Util::total(1, 2) }")
    (tree / "t/total.t").unlink()
    (tree / "lib/Shop/Util.pm").write_text(UTIL.replace("sub total", "\n\nsub totals"))
    os.utime(tree / "lib/Shop/Util.pm", (2_000_000_000, 2_000_000_000))
    seen = []
    q = watch_tree(spark, str(tree), store, seen.append, "1 second")
    until = time.time() + 240
    while not seen and q.isActive and time.time() < until:
        time.sleep(1)
    q.stop()
    assert q.exception() is None and len(seen) == 1
    told = json.loads(seen[0])
    assert (told["added"], told["changed"], told["deleted"]) == (["lib/Shop/More.pm"], ["lib/Shop/Util.pm"], ["t/total.t"])
    now, _ = store.read()
    again, _ = files.index(spark, str(tree))
    assert pairs(now) == pairs(again) and not [r for r in now.nodes.where("file_path = 't/total.t'").collect()]
    names = lambda x: sorted((r.from_node_id, r.reference_name, r.line) for r in x.refs.collect())
    assert names(now) == names(again)


def test_versions_share_what_did_not_change(spark, tmp_path):
    """A changed file writes its own buckets, a version is read whole, and old folders go when nothing refers to them."""
    from tests.helpers import graph

    nodes = [{"id": f"n{k}", "file_path": f"lib/f{k % 40}.pm", "name": f"name{k}", "docstring": f"word{k % 9}"} for k in range(200)]
    edges = [(f"n{k}", f"n{(k * 7) % 200}", "calls") for k in range(200)]
    store = Snapshots(spark, f"file://{tmp_path}/graph")
    g = graph(spark, nodes, edges)
    rows = lambda x: sorted(map(str, x.collect()))
    same = lambda a, b: all(rows(getattr(a, t)) == rows(getattr(b, t)) for t in ("nodes", "edges", "refs", "files"))
    first = store.write(g)
    assert same(store.read()[0], g)
    wrote = lambda v, t: {b for b, (_, at) in store.manifest()["tables"][t].items() if at == v}
    assert len(wrote(first, "nodes")) > 20
    assert store.write(store.read()[0]) and all(not wrote(store.version(), t) for t in store.manifest()["tables"])  # nothing changed
    changed = graph(spark, [{**n, "docstring": "other"} if n["file_path"] == "lib/f3.pm" else n for n in nodes], edges)
    third = store.write(changed, note="one file")
    assert len(wrote(third, "nodes")) == 1 and not wrote(third, "edges") and not wrote(third, "pieces")
    now = store.read()[0]
    assert same(now, changed) and same(store.read(first)[0], g)
    assert {r.id for r in lookup.search(now, "other").collect()} == {f"n{k}" for k in range(3, 200, 40)}
    gone = graph(spark, [n for n in nodes if n["file_path"] != "lib/f5.pm"], edges)
    store.write(gone)
    assert same(store.read()[0], gone)
    assert store.vacuum(keep=1)[-1] == first
    assert same(store.read()[0], gone)


def test_stream_refreshes_a_snapshot(spark, tree, tmp_path):
    g, sites = files.index(spark, str(tree))
    store = Snapshots(spark, f"file://{tmp_path}/graph")
    store.write(g, sites)
    (tree / "lib/Shop/More.pm").write_text("package Shop::More; sub more { Shop::Util::total(1, 2) }")
    seen = []
    q = watch(spark, str(tree), store, seen.append, available_now=True)
    q.awaitTermination(180)
    assert q.exception() is None
    assert json.loads(seen[0])["added"] == ["lib/Shop/More.pm"]
    now, _ = store.read()
    assert ("Shop::More::more", "Shop::Util::total", "calls", "static") in pairs(now)


def test_extraction_never_fails():
    rng = random.Random(5)
    odd = ["", "}", "{{{{", "sub", "sub {", "package", "use", "my $x = <<EOT;\nno end", "s{a}{", "q(", "$x->", "->foo", "has", "=head1\n", "\x00\xff", "sub f($$) {", "print <<'A', <<\"B\";\na\nA\nb\nB\n", "class Foo :isa( { field $x :reader; }"]
    odd += ["".join(rng.choice("sub {}()[];$@%&->=>'\"/#\nqwmy :\\<package use") for _ in range(400)) for _ in range(60)]
    for k, text in enumerate(odd):
        got = extract(f"lib/f{k}.pm", text)
        assert got["nodes"][0]["kind"] == "file"
    assert sum(extract("x.pm", t)["error"] is not None for t in odd) == 0


def test_details():
    got = extract("a.pm", "package A;\nuse Dancer2;\nget '/x' => sub { work($_[0]) };\npost '/y' => sub { 1 };\nsub work { my ($p) = @_; $dbh->do(\"x $p\"); $dbh->do('plain', $p) }\n__PACKAGE__->mk_accessors(qw(a b));\nbefore work => sub { other() };\n")
    routes = [n["name"] for n in got["nodes"] if n["kind"] == "route"]
    assert routes == ["GET /x", "POST /y"]
    assert [e["metadata"]["dynamic"] for e in got["edges"] if e["kind"] == "sink"] == [True, False]
    assert {n["name"] for n in got["nodes"] if n["metadata"].get("accessor")} == {"a", "b"}
    assert [e["metadata"]["name"] for e in got["edges"] if e["kind"] == "overrides"] == ["A::work"]
    native = extract("b.pm", "class P :isa(Q) { field $x :param :reader; method go ($n) { $self->x } }\nclass R;\nsub s1 { 1 }\n")
    assert [(n["kind"], n["qualified_name"]) for n in native["nodes"] if n["kind"] in ("class", "field", "method", "function")] == [("class", "P"), ("field", "P::x"), ("method", "P::x"), ("method", "P::go"), ("class", "R"), ("function", "R::s1")]
    xs = extract("C.xs", "#include <x.h>\n\nMODULE = Calc PACKAGE = Calc PREFIX = c_\n\nint\nc_add(a, b)\n  int a\n  CODE:\n    RETVAL = a;\n")
    assert [n["qualified_name"] for n in xs["nodes"]] == ["C.xs", "Calc", "Calc::add"]
    clones = extract("d.pm", "sub a { my $x = shift; for my $i (1..3) { print $x + $i; } return $x }\nsub b { my $q = shift; for my $j (4..9) { print $q + $j; } return $q }\nsub c { my $q = shift; return $q . 'x' . 'y' }")
    dups = [n["metadata"].get("dup") for n in clones["nodes"] if n["kind"] == "function"]
    assert dups[0] == dups[1] != dups[2]


def test_xs_sections_and_paragraphs():
    text = """#include "perl.h"

int
helper(int a)
{ return a; }

MODULE = Acme::Calc    PACKAGE = Acme::Calc

int
add(a, b)
    int a
  CODE:
    RETVAL = a + b;
  OUTPUT:
    RETVAL

double
square(x)
    double x

PACKAGE = Acme::Calc::More  PREFIX = more_

char *
more_name(self)
  CODE:
    if (self)
call(self);

BOOT:
setup(aTHX);
"""
    packages, found = xs.functions(text)
    assert packages == {"Acme::Calc": 7, "Acme::Calc::More": 21}
    assert found == [("Acme::Calc", "add", 10), ("Acme::Calc", "square", 18), ("Acme::Calc::More", "name", 24)]
    assert xs.functions("int\nf(a)\n") == ({}, [])


def test_pod_names():
    text = "code\n\n=head1 NAME\n\nX - y\n\n=head2 C<< run >>($x)\n\nRuns.\n\nTwice.\n\n=item B<I<stop>>\n\n=back\n\nlost\n\n=head2 run again\n\nother\n\n=cut\n\nsub f {}\n"
    assert pod.docstrings(text) == {"NAME": "X - y", "run": "Runs.\n\nTwice."}


def test_documented_calls():
    text = "=head1 run(1)\n\n=head2 C<< run >>($x)\n\n=head3 Words of ours\n\n=item C<$obj->start($x)>\n\n=item B<I<stop>>()\n\n=head2 My::Class->make\n\n=item $h->{x}->get\n\n=item\tlast_one ( )\n\n=item Other::name()\n"
    assert pod.documented_calls(text) == [("run", 3), ("start", 7), ("stop", 9), ("make", 11), ("last_one", 15)]


def test_declared_prereqs():
    makefile = "WriteMakefile(NAME => 'X', PREREQ_PM => { 'A::B' => 0, C => '1.0', # 'D' => 1\n }, TEST_REQUIRES => {\"E::F\" => 0}, OTHER => { 'G' => 0 });"
    assert files.declared_prereqs({"Makefile.PL": makefile}) == (["A::B", "C", "E::F"], "Makefile.PL")
    cpanfile = "requires 'A', '1.0';\nrequires(\"B::C\");\n# requires 'D';\non test => sub { requires 'E' => 2; recommends 'F' };\n"
    assert files.declared_prereqs({"cpanfile": cpanfile, "Makefile.PL": makefile}) == (["A", "B::C", "E"], "cpanfile")
    assert files.declared_prereqs({"cpanfile": "", "META.json": "not json", "Makefile.PL": makefile})[1] == "Makefile.PL"
    assert files.declared_prereqs({"MYMETA.json": '{"prereqs": {"runtime": {"requires": {"Z": 0}}, "test": null}}', "cpanfile": cpanfile}) == (["Z"], "MYMETA.json")
    assert files.declared_prereqs({}) == ([], None)


@pytest.mark.parametrize("line,role", [("use Mojo::Base -role;", True), ("use Mojo::Base -base, -signatures;", False), ("use Mojo::Base 'Some-role';", False), ("use Mojo::Base '-role', -signatures;", True)])
def test_role_flags(line, role):
    package = next(n for n in extract("A.pm", f"package A;\n{line}\n1;\n")["nodes"] if n["name"] == "A")
    assert bool((package["metadata"] or {}).get("role")) == role


@pytest.mark.parametrize("code,want", [
    ("my $n = $c->param('n'); return run($n);", {"taint_out": [{"callee": "run", "method": 0, "arg": 1, "param": 2, "src": None}, {"callee": "run", "method": 0, "arg": 1, "param": None, "src": 1}]}),
    ("my $cmd = $c->param('c'); my $two = \"x $cmd\"; system($two);", {"taint_flow": True, "sink_params": [2]}),
    ("system('ls', '-l');", {}),
    ("system(\"$ENV{SHELL} -c\");", {"taint_flow": True, "taint_source": "$ENV"}),
    ("my $x = <STDIN>; $dbh->do($x);", {"taint_flow": True, "taint_source": "STDIN"}),
    ("my ($x, $y) = @ARGV; exec($y);", {"taint_flow": True, "taint_source": "@ARGV"}),
    ("my $q = $c; my $r = [$q]; $dbh->selectrow_array('select ?', $r); log_it(1, $r);", {"sink_params": [2], "taint_out": [{"callee": "log_it", "method": 0, "arg": 2, "param": 2, "src": None}]}),
    ("# $ENV{X} only in words\nmy $n = 1; run($n);", {}),
])
def test_where_values_go(code, want):
    nodes = extract("A.pm", f"package A;\nsub f ($self, $c) {{\n{code}\n}}\n1;\n")["nodes"]
    found = next(n for n in nodes if n["name"] == "f")["metadata"]
    got = {k: v for k, v in found.items() if k in ("taint_flow", "sink_params", "taint_out", "taint_source") and v}
    if "taint_out" in got:
        got["taint_out"] = [x for x in got["taint_out"] if x["callee"] not in ("param",)]
        got = {k: v for k, v in got.items() if v}
    assert got == want
