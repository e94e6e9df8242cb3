"""Lines of code as a native expression: comments are masked, then lines with anything else are counted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "\u0001"
C_STYLE = r"""("(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\[\s\S])*+`)|/\*(?:[^*\n]|\*(?!/))*+(?:(\n)(?:[^*]|\*(?!/))*+)?\*/|//[^\n]*"""
# Rust's lifetimes are not strings; Python has no block comments, and its docstrings are code
PATTERNS = {
    "rust": r"""("(?:[^"\\]|\\[\s\S])*+"|'(?:[^'\\\n]|\\.[^'\n]*+)')|/\*(?:[^*\n]|\*(?!/))*+(?:(\n)(?:[^*]|\*(?!/))*+)?\*/|//[^\n]*""",
    "python": r"""(\"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*+'{3}|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')|#[^\n]*()""",
    "html": r"""()<!--(?:[^-\n]|-(?!->))*+(?:(\n)(?:[^-]|-(?!->))*+)?-->""",
}
for _name in ("typescript", "tsx", "javascript", "go", "cpp"):
    PATTERNS[_name] = C_STYLE


def masked(source: Column, language: str) -> Column:
    """Comments as one mark each, a comment over several lines as a mark, a line end and a mark. Other languages have no comments."""
    text = F.regexp_replace(source, "\r\n", "\n")
    return F.regexp_replace(text, PATTERNS[language], f"$1{MASK}$2{MASK}") if language in PATTERNS else text


def count_lines(text: Column) -> Column:
    """Lines that, after white space at their start, have a character that is no mark. White space after a mark counts."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"(?U)^\s*+{MASK}*+[^{MASK}]") & x.rlike(r"(?U)\S"))).cast("long")


def loc(source: Column, language: str) -> Column:
    return count_lines(masked(source, language))


def loc_by_language(source: Column, language: Column) -> Column:
    """loc, with the language in a column: one branch for each pattern."""
    out = None
    for name in PATTERNS:
        out = F.when(language == name, loc(source, name)) if out is None else out.when(language == name, loc(source, name))
    return out.otherwise(count_lines(source))
