"""Source trees as DataFrames: listing with ignore files, and whole-file reads."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions.paths import EXTENSIONS, MAX_BYTES, component_order, excluded, extension, glob_to_regex

LISTED = "path string, rel_path string, size_bytes long, last_modified timestamp"
IGNORE_FILES = (".gitignore", ".ignore")  # in order of weight, the last one first to decide
#: A rule: the folder (relative to the root, '' or ending in /) it applies under, a regex, whether it takes folders only, whether it keeps.
Rule = tuple[str, str, bool, bool]


class NotADirectory(ValueError):
    pass


def ignore_rule(line: str, folder: str = "") -> Rule | None:
    """One line of an ignore file. A slash before its end ties a pattern to its folder; * and ? stop at slashes."""
    line = line.rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    keeps = line.startswith("!")
    line = line[1:] if keeps or line.startswith(("\\#", "\\!")) else line
    folders_only, line = line.endswith("/"), line.rstrip("/")
    tied, line = "/" in line, line.lstrip("/")
    if not line:
        return None
    out, i = "" if tied else "(?:.*/)?", 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 2
        elif line[i:] == "**" and i and line[i - 1] == "/":
            out, i = out + ".+", i + 1
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := line.find("]", i + 2)) > 0:
            inner = line[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end
        elif c == "\\" and i + 1 < len(line):
            i += 1
            out += re.escape(line[i])
        else:
            out += re.escape(c)
        i += 1
    return folder, f"(?s:{out})", folders_only, keeps


@lru_cache(maxsize=4096)
def _compiled(regex: str) -> re.Pattern | None:
    try:
        return re.compile(regex)
    except re.error:
        return None


def ignored(rel: str, is_folder: bool, rules: list[Rule]) -> bool:
    """The last rule that matches decides; rules are in order from the root down."""
    for folder, regex, folders_only, keeps in reversed(rules):
        if folders_only and not is_folder:
            continue
        pattern = _compiled(regex)
        if rel.startswith(folder) and pattern is not None and pattern.fullmatch(rel, len(folder)):
            return not keeps
    return False


def user_rules() -> list[Rule]:
    """The rules of the user's own ignore file: the one that git's configuration names, or git/ignore in the configuration folder."""
    base = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    path = os.path.join(base, "git", "ignore")
    for config in (os.path.join(base, "git", "config"), os.path.join(os.path.expanduser("~"), ".gitconfig")):
        try:
            with open(config, encoding="utf-8", errors="replace") as f:
                said = re.findall(r"(?ims)^\s*\[core\]\s*$(?:(?!^\s*\[).)*?^\s*excludesfile\s*=\s*\"?([^\"\n]+)", f.read())
        except OSError:
            continue
        path = os.path.expanduser(said[-1].strip()) if said else path
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return [r for line in f if (r := ignore_rule(line))]
    except OSError:
        return []


def folder_rules(root: str, rel: str) -> list[Rule]:
    """The rules that a folder's own ignore files hold."""
    out: list[Rule] = []
    names = [*IGNORE_FILES] if rel else [".git/info/exclude", *IGNORE_FILES]
    for name in names:
        try:
            with open(os.path.join(root, rel, name), encoding="utf-8", errors="replace") as f:
                out += [r for line in f if (r := ignore_rule(line, rel))]
        except OSError:
            continue
    return out


def listed(root: str, rel: str, rules: list[Rule]) -> tuple[list[tuple[str, str, int, datetime]], list[str], list[Rule]]:
    """(files, folders, rules with the folder's own) of one folder; hidden, ignored and linked entries are left out, and what can't be read."""
    rules = rules + folder_rules(root, rel)
    files, folders = [], []
    try:
        entries = list(os.scandir(os.path.join(root, rel)))
    except OSError:
        return [], [], rules
    for e in entries:
        if e.name.startswith(".") or e.is_symlink():
            continue
        below = rel + e.name
        try:
            if e.is_dir(follow_symlinks=False):
                if not ignored(below, True, rules):
                    folders.append(below + "/")
            elif e.is_file(follow_symlinks=False) and not ignored(below, False, rules):
                s = e.stat(follow_symlinks=False)
                files.append((os.path.join(root, below), below, s.st_size, datetime.fromtimestamp(s.st_mtime, UTC)))
        except OSError:
            continue
    return files, folders, rules


def checked_root(root: str) -> str:
    if not root:
        raise ValueError("empty path")
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    if not os.path.isdir(root):
        raise NotADirectory(root)
    return root.rstrip("/") or "/"


def list_files(spark: SparkSession, root: str, exclude: list[str] | None = None, spread: int = 256, extensions: tuple[str, ...] | None = EXTENSIONS) -> DataFrame:
    """path, rel_path, size_bytes, last_modified of the files under a folder that driver and executors both see.

    The driver lists folders level by level until it holds `spread` of them; tasks walk those. Ignore files (nested ones too,
    .git/info/exclude and the user's own) count, a git repository or not. Globs of `exclude` are matched to the path below the root. Files over
    MAX_BYTES and of other extensions are left out. An invalid glob raises ValueError, a missing root FileNotFoundError.
    """
    root = checked_root(root)
    for g in exclude or []:
        glob_to_regex(g)
    found, work = [], [("", user_rules())]
    while work and len(work) < spread:
        below = []
        for rel, rules in work:
            files, folders, rules = listed(root, rel, rules)
            found += files
            below += [(f, rules) for f in folders]
        work = below
    rows = spark.createDataFrame(found, LISTED)
    if work:
        rule = "struct<folder:string,regex:string,folders_only:boolean,keeps:boolean>"
        folders = spark.createDataFrame(work, f"rel string, rules array<{rule}>").repartition(min(len(work), spread))

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for start, rules in zip(b["rel"], b["rules"], strict=True):
                    stack = [(start, [(r["folder"], r["regex"], r["folders_only"], r["keeps"]) for r in rules])]
                    while stack:
                        rel, above = stack.pop()
                        files, below, here = listed(root, rel, above)
                        stack += [(f, here) for f in below]
                        if files:
                            yield pd.DataFrame(files, columns=["path", "rel_path", "size_bytes", "last_modified"])

        rows = rows.unionByName(folders.mapInPandas(walk, LISTED))
    if extensions is not None:
        rows = rows.filter(extension(F.col("path")).isin(*extensions))
    return rows.filter((F.col("size_bytes") <= MAX_BYTES) & ~excluded(F.col("rel_path"), exclude or []))


def in_order(files: DataFrame) -> DataFrame:
    return files.orderBy(component_order(F.col("path")))


def read_contents(listing: DataFrame, on_error: str = "skip") -> DataFrame:
    """listing with `content`, read where the task runs. Files that are gone or not UTF-8 are skipped, or raise with on_error='fail'."""
    if on_error not in ("skip", "fail"):
        raise ValueError(on_error)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # a few files at a time: a batch of listings may stand for far more text than fits
            for at in range(0, len(b), 16):
                part = b.iloc[at : at + 16].copy()
                texts = []
                for path in part["path"]:
                    try:
                        with open(path, encoding="utf-8", newline="") as f:
                            texts.append(f.read())
                    except (OSError, UnicodeDecodeError):
                        if on_error == "fail":
                            raise
                        texts.append(None)
                part["content"] = texts
                yield part[part["content"].notna()]

    return listing.mapInPandas(read, f"{LISTED}, content string")


def read_store(spark: SparkSession, uri: str, exclude: list[str] | None = None) -> DataFrame:
    """The same rows from any store Spark reads. The size limit reaches the scan; texts that are not UTF-8 are left out. Ignore files are not read; Spark hides names that start with _ or a dot, and its scans leave out files of no bytes, so list_files is the source where these count."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri).filter(F.col("length") <= MAX_BYTES)
    base = spark._jvm.org.apache.hadoop.fs.Path(uri)
    home = base.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(base).toString().rstrip("/") + "/"
    rel = F.substring_index("path", home, -1)
    kept = rows.withColumn("rel_path", rel).filter(extension(F.col("path")).isin(*EXTENSIONS) & ~F.col("rel_path").rlike(r"(?:^|/)\.") & ~excluded(F.col("rel_path"), exclude or []))
    return kept.filter(F.is_valid_utf8(F.col("content").cast("string"))).select("path", "rel_path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_modified"), F.col("content").cast("string").alias("content"))


def memory_files(spark: SparkSession, files: dict[str, str], prefix: str = "") -> DataFrame:
    """path, content of given texts under a prefix, for tests."""
    return spark.createDataFrame([(p, c) for p, c in files.items() if p.startswith(prefix)], "path string, content string")
