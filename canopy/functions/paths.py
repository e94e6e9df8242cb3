"""Path and language expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: extensions that are scanned, and those that the watcher follows
EXTENSIONS = ("ts", "tsx", "js", "jsx", "rs", "py", "go", "cpp", "cc", "cxx", "hpp", "h")
WATCHED = ("ts", "tsx", "js", "jsx", "rs", "py")
LANGUAGES = {"ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "rs": "rust", "py": "python", "go": "go", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "h": "cpp"}
MAX_BYTES = 10 * 1024 * 1024


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def language(path: Column) -> Column:
    """The language key of a path; null for others."""
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[extension(path)]


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The folder of a path; '' at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def component_order(path: Column) -> Column:
    """Sorts paths by component, so a/b comes before a-b/x."""
    return F.split(path, "/")


def ancestors(path: Column) -> Column:
    """All folders above a path, shortest first, without the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, n), "/")))


def glob_to_regex(glob: str) -> str:
    """A glob as a whole-string regex in which * crosses /: **/ is any folders or none, ? one character, [..] a class, {a,b} alternatives."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 2
        elif c == "*":
            while glob.startswith("**", i):
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"invalid pattern: {glob}")
            inner = glob[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"invalid pattern: {glob}")
    return f"(?s)^{out}$"


def excluded(path: Column, globs: list[str]) -> Column:
    """True if any glob matches the root-relative path."""
    if not globs:
        return F.lit(False)
    return path.rlike("|".join(f"(?:{glob_to_regex(g)})" for g in globs))


def in_test_folder(path: Column) -> Column:
    """The predicate that marks symbols as tests: any part of the whole path counts."""
    return path.rlike(r"\.test\.|\.spec\.|__tests__|/tests?/|^tests?/")


def is_test_file(path: Column) -> Column:
    """The predicate that makes symbols entry points: only the file's name counts."""
    return file_name(path).rlike(r"\.test\.|\.spec\.")


def is_entry_file(path: Column) -> Column:
    return file_name(path).rlike(r"^(?:(?:main|index)\.(?:ts|tsx|js|jsx)|lib\.rs)$")
