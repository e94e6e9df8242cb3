"""Answers for a user interface, the user's ignore file, and test coverage by name against brute force."""

import json
import random
import urllib.error
import urllib.request
from threading import Thread

import pytest
from pyspark.sql import functions as F

from canopy.operators import deadcode, tree
from canopy.plans import service
from canopy.plans.work import shared_dir
from canopy.sources import files


@pytest.fixture
def project(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/main.ts").write_text("import { used } from './used';\nfunction main() { used(); }\n")
    (tmp_path / "src/used.ts").write_text("export function used() {}\nfunction gone() {}\n")
    return str(tmp_path)


def test_answers(spark, project):
    status, text = service.answer(spark, "POST", "/api/analyze", json.dumps({"path": project}))
    root = json.loads(text)
    assert status == 200 and root["type"] == "directory" and root["loc"] == 4
    leaves, todo = [], [root]
    while todo:
        n = todo.pop()
        todo += n["children"]
        leaves += [n["name"]] if n["type"] == "file" else []
    assert sorted(leaves) == ["main.ts", "used.ts"]
    status, text = service.answer(spark, "POST", "/api/dead-code", json.dumps({"path": project, "minConfidence": 0}))
    assert status == 200 and [d["symbol"] for f in json.loads(text)["files"] for d in f["deadCode"]] == ["gone"]
    assert service.answer(spark, "GET", "/api/health")[0] == 200 and service.answer(spark, "GET", "/api/other")[0] == 404
    for path, want in (("", 400), (f"{project}/none", 400), (f"{project}/src/main.ts", 400)):
        assert service.answer(spark, "POST", "/api/analyze", json.dumps({"path": path}))[0] == want
    assert service.answer(spark, "POST", "/api/analyze", "{")[0] == 500
    assert service.answer(spark, "POST", "/api/dead-code", json.dumps({"path": project, "minConfidence": 101}))[0] == 500


def test_server(spark):
    s = service.server(spark)
    Thread(target=s.serve_forever, daemon=True).start()
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{s.server_port}/api/health") as r:
            assert json.load(r) == {"status": "ok"}
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(f"http://127.0.0.1:{s.server_port}/none")
    finally:
        s.shutdown()


def test_the_users_ignore_file(spark, project, tmp_path_factory, monkeypatch):
    home = tmp_path_factory.mktemp("home")
    (home / "git").mkdir()
    (home / "git/ignore").write_text("used.ts\n")
    monkeypatch.setenv("XDG_CONFIG_HOME", str(home))
    monkeypatch.setenv("HOME", str(home))
    names = lambda: sorted(r["rel_path"] for r in files.list_files(spark, project).collect())
    assert names() == ["src/main.ts"]
    with open(f"{project}/.gitignore", "w") as f:
        f.write("!used.ts\nmain.ts\n")
    assert names() == ["src/used.ts"]
    (home / ".gitconfig").write_text(f"[user]\n  name = x\n[core]\n  excludesFile = {home}/other\n")
    (home / "other").write_text("src/\n")
    assert names() == []


def test_coverage_by_name_against_brute_force(spark):
    r = random.Random(3)
    rows = [(f"{i}", "".join(r.choice("abé_") for _ in range(r.randint(1, 9))), r.random() < 0.3, False, f"p{i}") for i in range(300)] + [("x", None, False, False, "p"), ("y", None, True, False, "q")]
    symbols = spark.createDataFrame(rows, "id string, name string, is_test boolean, is_exported boolean, path string")
    got = {x["id"] for x in deadcode.tested_symbols(symbols, spark.createDataFrame([], "src_path string, dst_path string"), symbols.filter("NOT is_test")).collect()}
    tests = [n for _, n, t, *_ in rows if t and n is not None]
    assert got == {i for i, n, t, *_ in rows if not t and n is not None and any(n in x for x in tests)}


def test_a_chart_is_made_once_for_a_tree(spark):
    nodes = tree.nodes(spark.createDataFrame([("a/b.ts", 7)], "path string, loc long"))
    assert tree.chart_of(nodes) is tree.chart_of(nodes) and sorted(map(tuple, tree.chart_of(nodes).collect())) == sorted(map(tuple, tree.chart_nodes(nodes).collect()))


def test_a_cluster_needs_a_shared_folder(spark):
    class Other:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        shared_dir(Other)


def test_places_in_order(spark):
    rows = [(f"{i % 7}/{i}",) for i in range(500)]
    got = tree.in_places(spark.createDataFrame(rows, "path string"), F.split("path", "/")).collect()
    assert [r["path"] for r in sorted(got, key=lambda r: r["at"])] == sorted((p for (p,) in rows), key=lambda p: p.split("/")) and sorted(r["at"] for r in got) == list(range(1, 501))
