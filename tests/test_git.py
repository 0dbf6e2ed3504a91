"""The log of a git repository as a table, against git itself."""

import os
import subprocess

import pytest

from codeloom.operators import history
from codeloom.plans.api import Workbench
from codeloom.sources import git

ODD = "lib/Ödd \"na\tme\".pm"


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("repo"))
    env = {**os.environ, "GIT_CONFIG_GLOBAL": os.devnull, "GIT_CONFIG_SYSTEM": os.devnull}

    def run(*args, who="ann"):
        subprocess.run(["git", "-C", root, "-c", f"user.name={who}", "-c", f"user.email={who}@x.example", *args], check=True, capture_output=True, env=env)

    def write(name, text):
        os.makedirs(os.path.dirname(f"{root}/{name}") or root, exist_ok=True)
        with open(f"{root}/{name}", "w") as f:
            f.write(text)
        run("add", "-A")

    run("init", "-q", "-b", "main")
    for k in range(9):
        write("lib/A.pm", f"package A;\nsub a {{ {k} }}\n1;\n")
        if k % 2:
            write("lib/B.pm", f"package B;\nsub b {{ {k} }}\n1;\n")
        run("commit", "-qm", f"c{k}", who="ann" if k % 3 else "bob")
    run("commit", "-q", "--allow-empty", "-m", "nothing")
    run("tag", "mark")
    run("checkout", "-qb", "side")
    write(ODD, "package Odd;\n1;\n")
    run("commit", "-qm", "odd name", who="cy")
    run("checkout", "-q", "main")
    write("t/a.t", "use A;\n")
    run("commit", "-qm", "test")
    run("merge", "-q", "--no-ff", "-m", "both", "side")
    run("mv", "lib/B.pm", "lib/C.pm")
    run("commit", "-qm", "moved", who="bob")
    return root


def plain(root, *span):
    """A row for each commit and file, one commit at a time."""
    said = lambda *a: subprocess.run(["git", "-C", root, *a], check=True, capture_output=True).stdout
    ids = said("rev-list", *(span or ["HEAD"])).decode().split()
    out = []
    for k, c in enumerate(ids):
        email, parents = said("show", "-s", "--format=%ae%x02%P", c).decode().strip("\n").split("\x02")
        merge = len(parents.split()) > 1
        names = said("diff-tree", "--root", "--no-commit-id", "--name-only", "-r", "-z", "-M", c).split(b"\0") if not merge else []
        out += [(c, len(ids) - k, email, merge, n.decode()) for n in names if n]
    return sorted(out)


@pytest.mark.parametrize("slice", [1, 3, 2_000])
def test_slices_give_the_whole_log(spark, repo, slice):
    got = git.commits(spark, repo, slice=slice)
    rows = sorted(map(tuple, got.collect()))
    assert rows == plain(repo) and any(r[4] == ODD for r in rows)
    assert got.rdd.getNumPartitions() == -(-14 // slice)


def test_since_a_ref(spark, repo):
    assert sorted(map(tuple, git.commits(spark, repo, "mark", slice=2).collect())) == plain(repo, "mark..HEAD")
    assert git.commits(spark, repo, "HEAD").count() == 0


def test_no_repository_and_no_ref(spark, repo, tmp_path):
    assert git.commits(spark, str(tmp_path)).count() == 0
    for ref in ("nowhere", "--all", "", "a b"):
        assert git.commits(spark, repo, ref).count() == 0


def test_a_log_that_breaks_off_is_an_error(repo):
    reader = git.GitLogReader({"root": repo})
    with pytest.raises(RuntimeError):
        list(reader.read(git.Slice(0, 5, 5, "0" * 40)))


def test_history_of_a_repository(spark, repo, tmp_path):
    commits = git.commits(spark, repo, slice=2)
    churn = {r.file: r.churn for r in history.churn(commits).collect()}
    # A move counts for the new name.
    assert churn["lib/A.pm"] == 9 and churn["lib/B.pm"] == 4 and churn["lib/C.pm"] == 1 and churn[ODD] == 1
    who = {(r.file, r.author): r.commits for r in history.authorship(commits).collect()}
    assert who["lib/A.pm", "bob@x.example"] == 3 and who["lib/A.pm", "ann@x.example"] == 6
    work = Workbench(spark, str(tmp_path / "store"), repo)
    work.index()
    assert work.commits().count() == commits.count()
    assert git.changed(repo, "mark") == ["lib/C.pm", ODD, "t/a.t"]
    assert [(r.change, r.file, r.qualified_name) for r in work.changes("mark").collect()] == [("added", "lib/C.pm", "B::b")]


def test_files_as_a_ref_has_them(spark, repo):
    names = spark.createDataFrame([("lib/B.pm",), (ODD,)], "file string")
    got = {r.path: bytes(r.content) for r in git.versions(names, repo, "mark").collect()}
    assert got == {"lib/B.pm": b"package B;\nsub b { 7 }\n1;\n", ODD: b""}
