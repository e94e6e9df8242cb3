import json
import os
import subprocess
import time
from datetime import datetime

import pytest

from canopy import __main__ as cli
from canopy.operators.parse import UnknownLanguage, imports, parse_files, parse_text, symbols
from canopy.plans import analysis
from canopy.sinks import reports as R
from canopy.sources import files as S
from canopy.sources import reports
from canopy.streaming import watch

COUNTS = [
    ("ts", "function f() {}\nconst g = () => 1;\nclass A { m() { return 1 } }", 3),
    ("tsx", "const A = () => <div onClick={() => x}>it's</div>;\nfunction b() {}", 3),
    ("ts", "type F = (a: number) => void; let x: () => string; interface I { m(): void; f: () => void }", 0),
    ("ts", "const f = (a: number): Promise<() => void> => { return async x => x };", 2),
    ("ts", "useState<() => void>(() => {}); a < b; const q = c ? (d) : e => f;", 2),
    ("ts", "abstract class A<T extends B> extends C<D> { private x = () => 1; #p() {} abstract q(): void; static async *g() {} get v() { return 1 } constructor(private a: string, b = () => 2) { super(a) } }", 6),
    ("js", "export default function () {}\nvar o = { a() {}, b: function () {}, c: () => {}, get d() { return 1 }, async e() {} };\nfunction* g() {}", 4),
    ("js", "x.then(function (a) { function b() {} });\nconst r = /[/}{]/g.test(s) ? 1 : 2\nfunction c() {}", 2),
    ("ts", "switch (x) { case 1: y(() => 1); break; default: z() }\nfor (const a of b.map(c => c)) d()\nlabel: while (1) {}", 2),
    ("ts", "declare function f(): void; namespace N { export function g(): void {} } enum E { A = 1 }", 1),
    ("ts", "const s = `${a.map(x => `${x}`)} => function f() {}`", 1),
    ("rust", 'fn main() { println!("fn x() {}"); let f: fn(u8) -> u8 = g; }\ntrait T { fn a(&self); fn b(&self) -> [u8; 4] { [0; 4] } }\nmacro_rules! m { () => { fn z() {} } }', 2),
    ("py", "def a():\n  '''def q(): '''\n  async def b(x): pass\nclass C:\n  def d(self): # def e()\n    return lambda x: x", 3),
    ("go", "package m\nfunc A() {}\nfunc (t *T) B(x int) error { return func() interface{} { return nil }() }\nvar f func(int) int = func(x int) int { return x }\ntype F func(a int) bool\n", 4),
    ("cpp", "namespace a { class B { public: B() = default; int c() const { return 1; } void d(); struct E { int f() { return 2; } }; }; }\n#define X() {}\nint main(int, char**) { auto l = [](int x) { return x; }; if (l(1)) { } return 0; }\nint z[] = {1,2};\nvoid B::d() {}", 5),
    ("ts", "", 0),
    ("rust", "", 0),
]


@pytest.mark.parametrize(("language", "source", "want"), COUNTS)
def test_function_counts(language, source, want):
    assert parse_text(source, language)[0] == want


def test_symbols():
    source = 'import a from "./a";\nimport "./b";\nimport type { T } from \'c\'\nexport * from "./d";\nexport { x } from "./e";\nimport("./f");\n\nexport class K {\n  static async go() {}\n}\nconst one = () => 1,\n  two = () => 2;\nexport default async function last() {\n  function inner() {}\n}\nfunction plain() {}\nexport { plain };\n@dec()\nclass D {}\n'
    _, found, sources = parse_text(source, "typescript")
    assert found == [("K", "Class", 8, 10, True), ("go", "Method", 9, 9, True), ("one", "ArrowFunction", 11, 12, False), ("last", "Function", 13, 15, True), ("inner", "Function", 14, 14, True), ("plain", "Function", 16, 16, False), ("D", "Class", 18, 19, False)]
    assert [s.strip("\"'") for s in sources] == ["./a", "./b", "c"]
    with pytest.raises(UnknownLanguage):
        parse_text("", "cobol")


def test_parse_files(spark):
    deep = "x => {" * 5000
    rows = spark.createDataFrame([("a.ts", "function f() {}", 1), ("b.txt", "function f() {}", 2), ("c.js", None, 3), ("d.ts", deep, 4), (None, "x", 5), ("tests/e.js", "const e = () => 1", 6)], "path string, content string, functions int")
    parsed = parse_files(rows, keep=("functions",))
    assert {r["path"]: (r["function_count"], r["error"], r["functions"]) for r in parsed.collect()} == {"a.ts": (1, None, 1), "c.js": (0, None, 3), "d.ts": (0, "nesting", 4), "tests/e.js": (1, None, 6)}
    assert {(r["id"], r["is_test"]) for r in symbols(parsed).collect()} == {("a.ts:1:f", False), ("tests/e.js:1:e", True)}
    assert imports(parsed).count() == 0
    assert parse_files(rows.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("rule", "path", "folder", "want"),
    [("*.log", "a/b.log", False, True), ("/x", "a/x", False, False), ("/x", "x", False, True), ("x/", "x", False, False), ("x/", "a/x", True, True), ("a/*.ts", "a/b/c.ts", False, False), ("a/**/c", "a/c", False, True), ("**/c", "q/c", False, True), ("a/**", "a/b/c", False, True), ("[!a].x", "a.x", False, False), ("\\#a", "#a", False, True), ("# a", "# a", False, False), ("", "", False, False)],
)
def test_ignore_rules(rule, path, folder, want):
    r = S.ignore_rule(rule)
    assert S.ignored(path, folder, [r] if r else []) is want


def write(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


def names(df, root):
    return [os.path.relpath(r["path"], root) for r in S.in_order(df).collect()]


def test_listing(spark, tmp_path):
    write(tmp_path, {"a.ts": "x", "a-b/x.ts": "", "a/b/y.rs": "", "a/.hidden/z.ts": "", ".h.ts": "", "n.txt": "", "c.c": "", "logs/l.ts": "", "a/.gitignore": "skip.ts\n!keep.gen.ts\n", "a/skip.ts": "", "a/keep.gen.ts": "", "a/b/skip.ts": "", "q/skip.ts": "", "q/o.gen.ts": "", ".gitignore": "logs/\n*.gen.ts\n", "_u/k.py": ""})
    os.symlink(tmp_path / "a", tmp_path / "link")
    want = ["_u/k.py", "a/b/y.rs", "a/keep.gen.ts", "a-b/x.ts", "a.ts", "q/skip.ts"]
    for spread in (1, 2, 256):
        assert names(S.list_files(spark, str(tmp_path), spread=spread), tmp_path) == want
    assert names(S.list_files(spark, str(tmp_path), ["a/**", "*.py"]), tmp_path) == ["a-b/x.ts", "a.ts", "q/skip.ts"]
    with pytest.raises(FileNotFoundError):
        S.list_files(spark, str(tmp_path / "none"))
    with pytest.raises(S.NotADirectory):
        S.list_files(spark, str(tmp_path / "a.ts"))
    with pytest.raises(ValueError, match="invalid pattern"):
        S.list_files(spark, str(tmp_path), ["[a"])
    (tmp_path / "empty").mkdir()
    assert S.list_files(spark, str(tmp_path / "empty")).count() == 0


def test_reading(spark, tmp_path):
    write(tmp_path, {"a.ts": "é\r\n", "b.ts": b"\xff\xfe", "d/c.rs": ""})
    listing = S.list_files(spark, str(tmp_path))
    assert {r["rel_path"]: r["content"] for r in S.read_contents(listing).collect()} == {"a.ts": "é\r\n", "d/c.rs": ""}
    with pytest.raises(Exception, match="utf-8"):
        S.read_contents(listing, on_error="fail").collect()
    assert {r["rel_path"]: r["content"] for r in S.read_store(spark, str(tmp_path)).collect()} == {"a.ts": "é\r\n"}
    assert S.memory_files(spark, {"a/x": "1", "b/y": "2"}, "a/").count() == 1


# a repository with a cycle of unused files, a barrel that nobody imports, and a test; what is dead was worked out by hand
REPOSITORY = {
    "src/main.ts": "import { act } from './used';\nimport { api } from './internal';\nfunction main(): void {\n  act(5);\n  api('x');\n}\nfunction setup(): void {}\nsetup();\nmain();\n",
    "src/used.ts": "export function act(x: number): number {\n  return x * 2;\n}\nfunction hidden(n: number): boolean {\n  return n > 0;\n}\n",
    "src/internal.ts": "function helper(d: string): number {\n  return d.length;\n}\nexport function api(i: string): number {\n  return helper(i);\n}\nexport function beside(): string {\n  return 'x';\n}\n",
    "src/dead.ts": "export function never(x: number): string {\n  return `${x}`;\n}\nexport class Unused {\n  constructor(v: number) {}\n  public get(): number {\n    return 1;\n  }\n}\nexport default function byDefault(): boolean {\n  return true;\n}\n",
    "src/index.ts": "export * from './used';\nexport { api } from './internal';\nexport function listed(): void {}\n",
    "src/ring-a.ts": "import { b } from './ring-b';\nexport function a(): string {\n  return b();\n}\n",
    "src/ring-b.ts": "import { a } from './ring-a';\nexport function b(): string {\n  return '';\n}\n",
    "checks/app.test.ts": "import { act } from '../src/used';\nfunction checkAct(): void {\n  act(1);\n}\ncheckAct();\n",
    "node_modules/p/i.ts": "export function skipped() {}\n",
}


def dead_names(found):
    return {(os.path.basename(r["path"]), r["symbol"]) for r in found.dead.collect()}


WANT = {("main.ts", "setup"), ("used.ts", "hidden"), ("internal.ts", "helper"), ("dead.ts", "never"), ("dead.ts", "Unused"), ("dead.ts", "constructor"), ("dead.ts", "get"), ("dead.ts", "byDefault"), ("ring-a.ts", "a"), ("ring-b.ts", "b")}


@pytest.fixture
def repository(tmp_path):
    write(tmp_path / "repo", REPOSITORY)
    return tmp_path / "repo"


def test_dead_code_and_its_cache(spark, repository):
    root, cache = str(repository), str(repository / ".canopy" / "cache")
    assert dead_names(analysis.dead_code(spark, root)) == WANT
    first = analysis.dead_code(spark, root, cache_dir=cache)
    assert dead_names(first) == WANT and first.summary.first()["dead_classes"] == 1
    kept = os.listdir(cache)
    assert dead_names(analysis.dead_code(spark, root, cache_dir=cache)) == WANT and os.listdir(cache) == kept
    write(repository, {"src/ring-a.ts": "function z() {}\n", "src/new.ts": "function fresh() {}\n"})
    os.utime(repository / "src/ring-a.ts", (1, 1))
    os.remove(repository / "src/dead.ts")
    now = analysis.dead_code(spark, root, cache_dir=cache)
    assert dead_names(now) == {w for w in WANT if w[0] != "dead.ts" and w != ("ring-a.ts", "a")} | {("ring-a.ts", "z"), ("new.ts", "fresh")}
    score = {r["symbol"]: r["confidence"] for r in now.dead.collect()}
    assert score["z"] == 100 and score["fresh"] == 80  # new files are recent ones
    newest = max(os.listdir(cache))
    for f in os.listdir(os.path.join(cache, newest)):
        if f.endswith(".parquet"):
            with open(os.path.join(cache, newest, f), "wb") as out:
                out.write(b"broken")
    assert analysis.cached(spark, cache) is None and not os.listdir(cache)
    assert dead_names(analysis.dead_code(spark, root, cache_dir=cache)) == dead_names(now)


def test_command_line(spark, repository, tmp_path, capsys):
    out = str(tmp_path / "out" / "r.json")
    assert cli.main(["analyze", str(repository), "-f", "json", "-o", out], spark) == 0
    with open(out) as f:
        report = json.load(f)
    assert report["summary"]["total_files"] == len(REPOSITORY) and len(report["files"]) == len(REPOSITORY)
    assert report["summary"]["total_functions"] == sum(f["function_count"] for f in report["files"]) == 16
    assert reports.read_report(spark, out).count() == len(REPOSITORY)
    assert cli.main(["analyze", str(repository), "-f", "csv", "--dead-code"], spark) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].endswith("dead_functions,dead_loc,dead_code_ratio") and any(x.endswith(",0,0,0.0") for x in lines)
    assert cli.main(["analyze", str(repository)], spark) == 0
    assert "  1. " + str(repository / "src/dead.ts") in capsys.readouterr().out
    assert cli.main(["analyze", str(repository), "--threshold", "loc=5"], spark) == 3
    assert cli.main(["dead-code", str(repository), "-f", "json", "--min-confidence", "0"], spark) == 0
    dead = json.loads(capsys.readouterr().out)
    assert {(os.path.basename(f["path"]), s["symbol"]) for f in dead["files"] for s in f["deadCode"]} == WANT and dead["summary"]["deadClasses"] == 1
    assert cli.main(["dead-code", str(repository), "--threshold", "dead_functions=0", "--min-confidence", "0"], spark) == 3
    write(repository, {"src/more.ts": "let x = 1;\n" * 40})
    assert cli.main(["analyze", str(repository), "--baseline", out], spark) == 3
    after = str(tmp_path / "after.json")
    assert cli.main(["analyze", str(repository), "-f", "json", "-o", after], spark) == 0
    capsys.readouterr()
    assert cli.main(["diff", out, after], spark) == 0
    assert capsys.readouterr().out.startswith("1 files added\n0 files deleted\n0 files modified")
    assert cli.main(["analyze", str(tmp_path / "none")], spark) == 1
    write(tmp_path, {"bad.json": "{"})
    assert cli.main(["diff", str(tmp_path / "bad.json"), after], spark) == 1


def test_empty_report_and_config(spark, tmp_path, monkeypatch):
    (tmp_path / "e").mkdir()
    found = analysis.analyze(spark, str(tmp_path / "e"))
    assert json.loads("".join(R.json_report(found.metrics, found.summary, times=False))) == {"summary": {"total_files": 0, "total_loc": 0, "total_functions": 0, "largest_files": []}, "files": []}
    monkeypatch.chdir(tmp_path)
    assert cli.main(["config", "init"]) == 0 and cli.main(["config", "init"]) == 1
    assert set(reports.read_config(str(tmp_path))) == {"analysis", "output", "cache"} and reports.read_config("/nowhere") == {}
    (tmp_path / reports.CONFIG_NAME).write_text("= 1")
    with pytest.raises(ValueError):
        reports.read_config(str(tmp_path))


def test_commits(spark, tmp_path):
    write(tmp_path, {"a.ts": "1"})
    env = os.environ | {"GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "A", "GIT_COMMITTER_EMAIL": "a@b", "GIT_COMMITTER_DATE": "2020-01-01T00:00:00Z"}
    for args in (["init", "-q"], ["add", "."], ["commit", "-qm", "one\n\nmore"]):
        subprocess.run(["git", "-C", str(tmp_path), *args], check=True, env=env)
    assert [(r["author"], r["timestamp"], r["message"]) for r in reports.commits(spark, str(tmp_path)).collect()] == [("A", 1577836800, "one\n\nmore")]
    assert reports.committed_times(spark, str(tmp_path)).first()["last_modified"] == datetime(2020, 1, 1)


def test_watch(spark, repository, tmp_path, capsys):
    root, feed, work = str(repository), str(tmp_path / "feed"), f"file://{tmp_path}/work"
    poller = watch.Poller(spark, root, feed)
    initial = analysis.analyze(spark, root).metrics
    seen = []
    assert poller.poll() == 0
    write(repository, {"src/main.ts": "function main() {}\nlet x = 1;\n", "src/n.py": "def f(): pass\n", "src/w.go": "package w\n"})
    os.remove(repository / "src/dead.ts")
    assert poller.poll() == 3  # the watcher does not follow .go
    write(repository, {"src/n.py": b"\xff"})
    os.utime(repository / "src/n.py", (5, 5))
    watch.start(spark, initial, feed, work, lambda c, s: seen.append((c.count(), s.count())), once=True).awaitTermination()
    state = {os.path.basename(r["path"]): r["loc"] for r in watch.current_state(spark, work, initial.schema).collect()}
    assert state["main.ts"] == 2 and "dead.ts" not in state and "n.py" not in state and seen == [(2, len(REPOSITORY) - 1)]
    write(repository, {"src/n.py": "def f(): pass\n"})
    assert poller.poll() == 1
    watch.start(spark, initial, feed, work, lambda c, s: seen.append((c.count(), s.count())), once=True).awaitTermination()
    assert seen[1:] == [(1, len(REPOSITORY))]
    started = time.time()
    assert watch.watch_tree(spark, root, as_json=True, rounds=2) == 0 and time.time() - started < 60
    assert json.loads(capsys.readouterr().out.splitlines()[0])["summary"]["total_files"] == len(REPOSITORY) + 1
