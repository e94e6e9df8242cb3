"""Tokens of source files, for the parser: comments go, strings are one token, brackets are paired."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

_JS = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|\A\#![^\n]*)|(?P<id>[#@]?[^\W\d][\w$]*|[#@]?\$[\w$]*)|(?P<num>\d[\w.]*)|(?P<str>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)|"""
    r"""(?P<punct>=>|\.\.\.|\?\.(?!\d)|[=!]==?|<=|&&=?|\|\|=?|\?\?=?|\+\+|--|\*\*=?|[-+*%&|^]=|.)""",
    re.DOTALL,
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_OPERATOR_WORDS = frozenset("return typeof case in of delete void throw new else do await yield instanceof default extends".split())
_GENERIC = re.compile(r"<\s*(?:const\s+)?\w+\s*(?:,|extends\b)")
_LITERALS = {
    "rust": r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>b?r(\#*)".*?"\3|b?"(?:[^"\\]|\\.)*"|b?'(?:[^'\\\n]|\\[^\n]+?)')|(?P<life>'\w+)|""",
    "go": r"""(?P<skip>[^\S\n]+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>`[^`]*`|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|""",
    "cpp": r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|^[^\S\n]*\#(?:[^\n\\]|\\.)*)|(?P<str>R"([^\s()\\]*)\(.*?\)\3"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|""",
    "python": r'''(?P<skip>\s+|\#[^\n]*)|(?P<str>"{3}(?:[^"\\]|\\.|"(?!""))*(?:"{3}|\Z)|'{3}(?:[^'\\]|\\.|'(?!''))*(?:'{3}|\Z)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|''',
}
_OTHER = {k: re.compile(v + r"(?P<id>[^\W\d]\w*)|(?P<num>\d[\w.]*)|(?P<punct>::|->|=>|[=!<>]=|.|\n)", re.DOTALL | re.MULTILINE) for k, v in _LITERALS.items()}


@dataclass
class Tokens:
    """Parallel lists; the last four tokens are empty ones. mate holds the index of each opening bracket's partner."""

    text: list[str]
    kind: list[str]
    first: list[int]
    last: list[int]
    mate: list[int]
    n: int


def _close(found: list[tuple[str, str, int, int]], source: str) -> Tokens:
    n = len(found)
    starts = [0] + [m.end() for m in re.finditer("\n", source)]
    text, kind = [f[0] for f in found] + [""] * 4, [f[1] for f in found] + ["end"] * 4
    first = [bisect_right(starts, f[2]) for f in found]
    last = [bisect_right(starts, max(f[3] - 1, f[2])) for f in found]
    end = last[-1] if last else 1
    mate, stack = [n] * (n + 4), []
    for i, f in enumerate(found):
        if f[1] != "punct":
            continue
        if f[0] in "([{":
            stack.append(i)
        elif f[0] in ")]}":
            want = "([{"[")]}".index(f[0])]
            back = next((d for d in range(len(stack) - 1, max(len(stack) - 9, -1), -1) if found[stack[d]][0] == want), None)
            if back is not None:
                mate[stack[back]] = i
                del stack[back:]
    return Tokens(text, kind, first + [end + 1] * 4, last + [end + 1] * 4, mate, n)


def script_tokens(source: str, markup: bool) -> Tokens:
    """JavaScript and TypeScript. Templates and (with markup) elements become (), with what they embed inside as a list."""
    out: list[tuple[str, str, int, int]] = []
    # open contexts: ["code", braces], ["text"], ["tag", closing], ["inner"]; elements count their depth
    modes: list[list] = [["code", 0]]
    i, n = 0, len(source)

    def embed(at: int, mark: str) -> None:
        out.append((mark, "punct", at, at + 1))

    while i < n:
        mode = modes[-1]
        if mode[0] == "text":
            if source[i] == "\\":
                i += 2
            elif source[i] == "`":
                embed(i, ")")
                modes.pop()
                i += 1
            elif source.startswith("${", i):
                embed(i, "(")
                modes.append(["code", 0])
                i += 2
            else:
                i += 1
            continue
        if mode[0] == "element":
            c = source[i]
            if c == "{":
                embed(i, "(")
                modes.append(["code", 0])
                i += 1
            elif mode[2] == "children":
                if c == "<":
                    mode[2] = "closing" if source.startswith("</", i) else "opening"
                i += 1
            elif c in "\"'":
                end = source.find(c, i + 1)
                i = n if end < 0 else end + 1
            elif c == ">":
                mode[1] += {"opening": 1, "closing": -1}[mode[2]] if source[i - 1] != "/" or mode[2] == "closing" else 0
                mode[2] = "children"
                i += 1
                if mode[1] <= 0:
                    embed(i - 1, ")")
                    modes.pop()
            else:
                i += 1
            continue
        prev = out[-1] if out else None
        operand = prev is None or (prev[1] == "punct" and prev[0] not in (")", "]", "}", "++", "--")) or (prev[1] == "id" and prev[0] in _OPERATOR_WORDS)
        c = source[i]
        if c == "`":
            embed(i, "(")
            modes.append(["text"])
            i += 1
            continue
        if c == "/" and operand and not source.startswith(("//", "/*"), i) and (m := _REGEX.match(source, i)):
            out.append((m[0], "str", i, m.end()))
            i = m.end()
            continue
        if c == "<" and markup and operand and re.match(r"<(?:[A-Za-z_]|\s*>)", source[i : i + 40]) and not _GENERIC.match(source, i):
            embed(i, "(")
            modes.append(["element", 0, "opening"])
            i += 1
            continue
        m = _JS.match(source, i)
        kind = m.lastgroup
        if kind != "skip":
            if len(modes) > 1 and m[0] == "{":
                mode[1] += 1
            if len(modes) > 1 and m[0] == "}":
                if mode[1] == 0:
                    embed(i, ")")
                    embed(i, ",")
                    modes.pop()
                    i += 1
                    continue
                mode[1] -= 1
            out.append((m[0], kind, i, m.end()))
        i = m.end()
    return _close(out, source)


def plain_tokens(source: str, language: str) -> Tokens:
    found = []
    for m in _OTHER[language].finditer(source):
        kind = m.lastgroup if m.lastgroup in ("skip", "id", "num", "punct", "life") else "str"
        if m["skip"] is None:
            found.append((m[0], kind, m.start(), m.end()))
    return _close(found, source)
