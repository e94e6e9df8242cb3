"""Symbols, imports and function counts of source files.

Scripts (TypeScript, JavaScript) are walked by a descent over paired brackets that knows types, so that the arrow of a
function type counts for nothing; other languages only have their functions counted. The walk is per file and holds one
file, so it runs in mapInPandas.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions.paths import LANGUAGES, in_test_folder
from canopy.functions.tokens import Tokens, plain_tokens, script_tokens

SCRIPTS = ("typescript", "tsx", "javascript")
ALIASES = {"ts": "typescript", "js": "javascript", "jsx": "javascript", "rs": "rust", "py": "python", "c++": "cpp"}
SYMBOL = "struct<ordinal:int,name:string,kind:string,line_start:long,line_end:long,is_exported:boolean>"
PARSED = f"path string, function_count long, symbols array<{SYMBOL}>, imports array<struct<ordinal:int,source:string>>, error string"
_MODIFIERS = frozenset("public private protected static readonly async get set override abstract declare accessor".split())
_OPERATOR_WORDS = frozenset("typeof new await void delete yield in of instanceof return throw case extends".split())
_TYPE_WORDS = frozenset("keyof readonly typeof infer unique asserts new abstract".split())
_CONTINUES = frozenset("in instanceof as satisfies of".split())


class UnknownLanguage(ValueError):
    pass


class Script:
    """One walk over a script's tokens; fills symbols, imports and functions."""

    def __init__(self, tokens: Tokens) -> None:
        self.t, self.k, self.first, self.last, self.mate, self.n = tokens.text, tokens.kind, tokens.first, tokens.last, tokens.mate, tokens.n
        self.functions = 0
        self.symbols: list[tuple[str, str, int, int, bool]] = []
        self.imports: list[str] = []
        self.angles: dict[int, int] = {}
        self.block(0, self.n, False)

    def add(self, name: str, kind: str, start: int, end: int, exported: bool) -> None:
        self.symbols.append((name, kind, self.first[start], self.last[max(end, start)], exported))

    # types

    def type(self, i: int) -> int:
        """The index after the type at i; i itself if there is none."""
        t, k = self.t, self.k
        while t[i] in ("|", "&"):
            i += 1
        while True:
            if t[i] in _TYPE_WORDS and (k[i + 1] in ("id", "str") or t[i + 1] in ("(", "{", "[", "<")):
                i += 1
                continue
            if t[i] == "<":
                j = self.angle(i)
                if not j:
                    return i
                i = j
                continue
            if t[i] == "-":
                i += 1
            if t[i] in ("(", "[", "{") and k[i] == "punct":
                i = self.mate[i] + 1
                if t[i] == "=>":
                    i += 1
                    continue
            elif k[i] in ("id", "str", "num"):
                i += 1
            else:
                return i
            again = False
            while True:
                if t[i] == "." and k[i + 1] == "id":
                    i += 2
                elif t[i] == "<" and (j := self.angle(i)):
                    i = j
                elif t[i] == "[" and self.first[i] == self.last[i - 1]:
                    i = self.mate[i] + 1
                elif t[i] == "is" or t[i] in ("|", "&"):
                    i, again = i + 1, True
                    break
                elif t[i] == "extends":
                    i = self.type(i + 1)
                    if t[i] == "?":
                        i = self.type(i + 1)
                        if t[i] == ":":
                            i = self.type(i + 1)
                    return i
                else:
                    break
            if not again:
                return i

    def angle(self, i: int) -> int:
        """The index after the type parameters or arguments that open at i; 0 if they are none."""
        if i not in self.angles:
            self.angles[i] = 0
            self.angles[i] = self._angle(i)
        return self.angles[i]

    def _angle(self, i: int) -> int:
        i += 1
        while i < self.n:
            if self.t[i] == ">":
                return i + 1
            j = self.type(i)
            if self.t[j] == "=":
                j = self.type(j + 1)
            if self.t[j] == ",":
                j += 1
            elif self.t[j] != ">" and not (j > i and self.t[i] in ("const", "in", "out") and self.k[j] == "id"):
                return 0
            if j == i and self.t[j] != ">":
                return 0
            i = j
        return 0

    # expressions

    def arrow(self, i: int, in_choice: bool) -> tuple[int, int] | None:
        """Where the parameters and the => of an arrow function at i stand."""
        t = self.t
        if t[i] == "async" and self.first[i + 1] == self.first[i] and t[i + 1] != "=>":
            i += 1
        if t[i] == "<":
            i = self.angle(i)
            if not i:
                return None
        if t[i] == "(" and self.k[i] == "punct":
            j = self.mate[i] + 1
            if t[j] == ":" and not in_choice:
                j = self.type(j + 1)
            return (i, j) if t[j] == "=>" else None
        return (i, i + 1) if self.k[i] == "id" and t[i + 1] == "=>" else None

    def parameters(self, i: int, end: int, exported: bool) -> None:
        """Defaults and patterns between brackets, without the types."""
        while i < end:
            at = i
            if self.t[i] == ":":
                i = self.type(i + 1)
            elif self.t[i] == "=":
                i = self.expression(i + 1, end, exported)
            elif self.t[i] in ("{", "[") and self.k[i] == "punct":
                self.pattern(i + 1, self.mate[i], exported)
                i = self.mate[i] + 1
            elif self.t[i] == "(":
                self.listed(i + 1, self.mate[i], exported)
                i = self.mate[i] + 1
            i = max(i, at + 1)

    def pattern(self, i: int, end: int, exported: bool) -> None:
        while i < end:
            at = i
            if self.t[i] == "=":
                i = self.expression(i + 1, end, exported)
            elif self.t[i] in ("{", "["):
                self.pattern(i + 1, self.mate[i], exported)
                i = self.mate[i] + 1
            i = max(i, at + 1)

    def listed(self, i: int, end: int, exported: bool) -> None:
        while i < end:
            i = max(self.expression(i, end, exported), i + 1)

    def body(self, i: int, end: int, exported: bool) -> int:
        """A block at i, or nothing."""
        if self.t[i] != "{":
            return i
        self.block(i + 1, self.mate[i], exported)
        return self.mate[i] + 1

    def expression(self, i: int, end: int, exported: bool) -> int:
        """The index at which the expression at i ends: a comma, a semicolon, a closing bracket, or the next statement."""
        t, k = self.t, self.k
        choices, operand = 0, True
        while i < end:
            c = t[i]
            if k[i] == "punct" and c in (",", ";", ")", "]", "}"):
                return i
            if not operand and self.first[i] > self.last[i - 1] and (c in ("{", "++", "--", "!") or (k[i] != "punct" and c not in _CONTINUES)):
                return i
            if operand and (c in ("(", "<") or k[i] == "id") and (found := self.arrow(i, choices > 0)):
                self.functions += 1
                at, sign = found
                if t[at] == "(":
                    self.parameters(at + 1, self.mate[at], exported)
                i, operand = (self.body(sign + 1, end, exported) if t[sign + 1] == "{" else self.expression(sign + 1, end, exported)), False
            elif operand and c == "async" and t[i + 1] == "function":
                i += 1
            elif operand and c == "function" and k[i] == "id":
                i, operand = self.function(i, end, exported, None), False
            elif operand and c == "class":
                i, operand = self.class_(i, exported, i, False), False
            elif c in ("(", "[") and k[i] == "punct":
                self.listed(i + 1, self.mate[i], exported)
                i, operand = self.mate[i] + 1, False
            elif c == "{":
                if not operand:
                    return i
                self.members(i + 1, self.mate[i], exported, False)
                i, operand = self.mate[i] + 1, False
            elif c == "<" and (j := self.angle(i)) and (operand or t[j] == "("):
                i = j
            elif c in (".", "?."):
                i += 1
                if k[i] == "id":
                    i, operand = i + 1, False
            elif k[i] == "id":
                if c in ("as", "satisfies") and not operand:
                    i = max(self.type(i + 1), i + 1)
                else:
                    i, operand = i + 1, c in _OPERATOR_WORDS
            elif k[i] in ("num", "str"):
                i, operand = i + 1, False
            elif c == "?":
                i, operand, choices = i + 1, True, choices + 1
            elif c == ":":
                if not choices:
                    return i
                i, operand, choices = i + 1, True, choices - 1
            else:
                i, operand = i + 1, operand or c not in ("!", "++", "--")
        return i

    def function(self, i: int, end: int, exported: bool, start: int | None) -> int:
        """`function` at i. With start it is a statement: it counts, and is a symbol, if it has a name and a body and is no generator."""
        i += 1
        plain = self.t[i] != "*"
        i += not plain
        name = None
        if self.k[i] == "id":
            name, i = self.t[i], i + 1
        if self.t[i] == "<":
            i = self.angle(i) or i + 1
        if self.t[i] == "(":
            self.parameters(i + 1, self.mate[i], exported)
            i = self.mate[i] + 1
        if self.t[i] == ":":
            i = self.type(i + 1)
        if self.t[i] != "{":
            return i
        if start is not None and name and plain:
            self.functions += 1
            self.add(name, "Function", start, self.mate[i], exported)
        return self.body(i, end, exported)

    def class_(self, i: int, exported: bool, start: int, symbol: bool) -> int:
        i += 1
        name = None
        if self.k[i] == "id" and self.t[i] not in ("extends", "implements"):
            name, i = self.t[i], i + 1
        while i < self.n and self.t[i] != "{":
            if self.t[i] == "(":
                self.listed(i + 1, self.mate[i], exported)
                i = self.mate[i] + 1
            elif self.t[i] == "<":
                i = self.angle(i) or i + 1
            else:
                i += 1
        if symbol and name:
            self.add(name, "Class", start, self.mate[i], exported)
        self.members(i + 1, self.mate[i], exported, True)
        return self.mate[i] + 1

    def members(self, i: int, end: int, exported: bool, of_class: bool) -> None:
        while i < end:
            i = max(self.member(i, end, exported, of_class), i + 1)

    def member(self, i: int, end: int, exported: bool, of_class: bool) -> int:
        t, k = self.t, self.k
        if t[i] in (",", ";"):
            return i + 1
        if t[i] == "...":
            return self.expression(i + 1, end, exported)
        if of_class:
            i = self.decorators(i, exported)
        start = i
        while t[i] in _MODIFIERS and (k[i + 1] in ("id", "num", "str") or t[i + 1] in ("[", "*", "{")) and i + 1 < end:
            i += 1
            if t[i] == "{":
                return self.body(i, end, exported)
        if t[i] == "*":
            i += 1
        name = None
        if t[i] == "[":
            self.listed(i + 1, self.mate[i], exported)
            i = self.mate[i] + 1
        elif k[i] in ("id", "num", "str"):
            name = t[i] if k[i] == "id" and t[i][0] != "#" else None
            i += 1
        if t[i] in ("?", "!"):
            i += 1
        if t[i] == "<":
            i = self.angle(i) or i + 1
        if t[i] == "(":
            self.parameters(i + 1, self.mate[i], exported)
            i = self.mate[i] + 1
            if t[i] == ":":
                i = self.type(i + 1)
            if t[i] == "{":
                self.functions += 1
                if name:
                    self.add(name, "Method", start, self.mate[i], exported)
                return self.body(i, end, exported)
            return i
        if t[i] == ":":
            if not of_class:
                return self.expression(i + 1, end, exported)
            i = self.type(i + 1)
        return self.expression(i + 1, end, exported) if t[i] == "=" else i

    def decorators(self, i: int, exported: bool) -> int:
        while self.t[i].startswith("@"):
            i += 1
            while self.t[i] == "." and self.k[i + 1] == "id":
                i += 2
            if self.t[i] == "(":
                self.listed(i + 1, self.mate[i], exported)
                i = self.mate[i] + 1
        return i

    # statements

    def block(self, i: int, end: int, exported: bool) -> None:
        while i < end:
            i = max(self.statement(i, end, exported), i + 1)

    def statement(self, i: int, end: int, exported: bool) -> int:
        t, k = self.t, self.k
        start = i
        i = self.decorators(i, exported)
        if t[i] == "export" and start < i:
            start = i
        c, after = t[i], t[i + 1]
        if k[i] not in ("id", "punct") or i >= end:
            return self.expression(i, end, exported)
        if c == "{":
            return self.body(i, end, exported)
        if c == "export":
            return self.export(i, end)
        if c == "import" and after not in ("(", "."):
            return self.import_(i, end)
        if c == "function":
            return self.function(i, end, exported, i)
        if c == "async" and after == "function" and self.first[i] == self.first[i + 1]:
            return self.function(i + 1, end, exported, i)
        if c == "class":
            return self.class_(i, exported, start, True)
        if c == "abstract" and after == "class":
            return self.class_(i + 1, exported, start, False)
        if c == "const" and after == "enum":
            i, c, after = i + 1, after, t[i + 2]
        if c in ("const", "let", "var") and (k[i + 1] == "id" or after in ("{", "[")):
            return self.declaration(i, end, exported)
        if c in ("interface", "enum", "namespace", "module", "global") and (k[i + 1] in ("id", "str") or (c == "global" and after == "{")):
            while i < end and t[i] not in ("{", ";"):
                i += 1
            if t[i] == "{":
                if c == "enum":
                    self.listed(i + 1, self.mate[i], exported)
                elif c != "interface":
                    self.block(i + 1, self.mate[i], exported)
                return self.mate[i] + 1
            return i
        if c == "type" and k[i + 1] == "id" and t[i + 2] in ("=", "<"):
            i += 2
            if t[i] == "<":
                i = self.angle(i) or i + 1
            return self.type(i + 1) if t[i] == "=" else i
        if c in ("if", "for", "while", "switch", "with", "catch"):
            i += 1 + (t[i + 1] == "await")
            if t[i] == "(":
                self.block(i + 1, self.mate[i], exported)
                return self.mate[i] + 1
            return i
        if c in ("else", "do", "try", "finally", "declare") or (c == "return" and self.first[i + 1] > self.first[i]):
            return i + 1
        if (k[i] == "id" and after == ":") or (c == "default" and after == ":"):
            return i + 2
        return self.expression(i, end, exported)

    def export(self, i: int, end: int) -> int:
        t = self.t
        i += 1
        if t[i] == "type" and t[i + 1] in ("{", "*"):
            i += 1
        if t[i] in ("*", "{"):
            i = self.mate[i] + 1 if t[i] == "{" else i + 1
            if t[i] == "as":
                i += 2
            return i + 2 if t[i] == "from" else i
        if t[i] == "=":
            return self.expression(i + 1, end, True)
        if t[i] == "default":
            i += 1
            at = self.decorators(i, True)
            named = t[at] in ("class", "abstract") or (t[at] == "function" and self.k[at + 1] == "id") or (t[at] == "async" and t[at + 1] == "function" and self.k[at + 2] == "id")
            return self.statement(i, end, True) if named else self.expression(i, end, True)
        return self.statement(i, end, True)

    def import_(self, i: int, end: int) -> int:
        i += 1
        while i < end and self.k[i] != "str" and self.t[i] not in (";", "="):
            i = self.mate[i] + 1 if self.t[i] == "{" else i + 1
        if self.t[i] == "=":
            return self.expression(i + 1, end, False)
        if self.k[i] == "str" and i < end:
            self.imports.append(self.t[i])
            i += 1
            if self.t[i] in ("with", "assert") and self.t[i + 1] == "{":
                i = self.mate[i + 1] + 1
        return i

    def declaration(self, i: int, end: int, exported: bool) -> int:
        t, start, named, arrows, before = self.t, i, None, False, len(self.symbols)
        i += 1
        while i < end:
            name = None
            if self.k[i] == "id":
                name, i = t[i], i + 1
            elif t[i] in ("{", "["):
                self.pattern(i + 1, self.mate[i], exported)
                i = self.mate[i] + 1
            if t[i] == "!":
                i += 1
            if t[i] == ":":
                i = self.type(i + 1)
            if t[i] in ("=", "of", "in"):
                if t[i] == "=" and self.arrow(i + 1, False):
                    arrows = True
                value = i + 1
                i = self.expression(i + 1, end, exported)
                if name is None and i == value + 1 and self.k[value] == "id":
                    name = t[value]
            named = named or name
            if t[i] != "," or i >= end:
                break
            i += 1
        if arrows and named:
            self.add(named, "ArrowFunction", start, min(i, end) if t[i] == ";" and i < end else min(i, end) - 1, exported)
            self.symbols.insert(before, self.symbols.pop())  # before what stands in it
        return i


def _rust(k: Tokens) -> int:
    t, n, i = k.text, 0, 0
    while i < k.n:
        if t[i] == "!" and t[i + 1] in ("(", "[", "{") and k.kind[i - 1] == "id" and t[i - 1] not in ("if", "while", "return", "match", "in", "else"):
            i = k.mate[i + 1] + 1
        elif t[i] == "macro_rules" and t[i + 1] == "!" and t[i + 3] in ("(", "[", "{"):
            i = k.mate[i + 3] + 1
        elif t[i] == "fn" and k.kind[i + 1] == "id":
            j = i + 2
            while j < k.n and t[j] not in ("{", ";"):
                j = k.mate[j] + 1 if t[j] in ("(", "[") else j + 1
            n += t[j] == "{"
            i += 2
        else:
            i += 1
    return n


def _python(k: Tokens) -> int:
    return sum(k.text[i] == "def" and k.kind[i + 1] == "id" and k.text[i + 2] in ("(", "[") for i in range(k.n))


def _go_type(k: Tokens, i: int) -> int:
    t = k.text
    while t[i] in ("*", "<", "-", "chan") or (t[i] == "[" and k.mate[i] <= k.n):
        i = k.mate[i] + 1 if t[i] == "[" else i + 1
    if t[i] == "(":
        return k.mate[i] + 1
    if t[i] in ("struct", "interface") and t[i + 1] == "{":
        return k.mate[i + 1] + 1
    if t[i] == "map" and t[i + 1] == "[":
        return _go_type(k, k.mate[i + 1] + 1)
    if t[i] == "func":
        return _go_type(k, k.mate[i + 1] + 1) if t[i + 1] == "(" else i + 1
    if k.kind[i] != "id":
        return i
    i += 1
    while t[i] == "." and k.kind[i + 1] == "id":
        i += 2
    return k.mate[i] + 1 if t[i] == "[" else i


def _go(k: Tokens) -> int:
    t, n = k.text, 0
    for i in range(k.n):
        if t[i] != "func":
            continue
        if k.kind[i + 1] == "id":
            n += 1
        elif t[i + 1] == "(":
            j = k.mate[i + 1] + 1
            top = i == 0 or t[i - 1] in ("\n", ";")
            if top and k.kind[j] == "id" and t[j + 1] in ("(", "["):
                n += 1  # a method: its receiver stands in the first brackets
            else:
                n += t[_go_type(k, j)] == "{"
    return n


def _cpp(k: Tokens) -> int:
    """Definitions with a body, `= default` or `= delete`, in namespaces and classes, local ones too."""
    t, n = k.text, 0
    work = [(0, k.n, True)]
    while work:
        i, end, declares = work.pop()
        head = i
        while i < end:
            c = t[i]
            if c == ";":
                text = t[head:i]
                n += declares and len(text) > 3 and text[-2] == "=" and text[-1] in ("default", "delete") and "(" in text
                i += 1
                head = i
            elif c in ("(", "["):
                i = k.mate[i] + 1
            elif c == "{":
                words = t[head:i]
                scope = next((w for w in words if w in ("class", "struct", "union", "namespace", "enum", "extern")), None)
                called = "(" in words and "=" not in words
                if declares and called:
                    n += 1
                    work.append((i + 1, k.mate[i], False))
                elif scope and not called:
                    if scope != "enum":
                        work.append((i + 1, k.mate[i], True))
                else:
                    work.append((i + 1, k.mate[i], False))
                i = k.mate[i] + 1
                if called or not scope or scope in ("namespace", "extern"):
                    head = i
            else:
                if c == ":" and t[i - 1] in ("public", "private", "protected"):
                    head = i + 1
                i += 1
    return n


_COUNTERS = {"rust": _rust, "python": _python, "go": _go, "cpp": _cpp}


def parse_text(source: str, language: str) -> tuple[int, list[tuple[str, str, int, int, bool]], list[str]]:
    """(functions, symbols, imports) of one file. Only scripts have symbols and imports."""
    language = ALIASES.get(language, language)
    if language in SCRIPTS:
        s = Script(script_tokens(source, language != "typescript"))
        return s.functions, s.symbols, s.imports
    if language not in _COUNTERS:
        raise UnknownLanguage(f"unsupported language: {language}")
    return _COUNTERS[language](plain_tokens(source, language)), [], []


def parse_files(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """path, function_count, symbols, imports, error and the columns of `keep` of files(path, content).

    Files of unknown languages give no row; a null text is an empty one. A file too deeply nested to walk has no symbols and the
    error `nesting`. Other columns are not read.
    """
    kept = "".join(f", {c} {files.schema[c].dataType.simpleString()}" for c in keep)
    names = ["path", "function_count", "symbols", "imports", "error"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, rows = [], []
            for row, (path, content) in enumerate(zip(b["path"], b["content"], strict=True)):
                name = path.rpartition("/")[2]
                language = LANGUAGES.get(name.rpartition(".")[2]) if name.rpartition(".")[0] else None
                if not language:
                    continue
                try:
                    n, symbols, imports = parse_text((content or "").replace("\r\n", "\n"), language)
                    error = None
                except RecursionError:
                    n, symbols, imports, error = 0, [], [], "nesting"
                out.append((path, n, [(i, *s) for i, s in enumerate(symbols)], list(enumerate(imports)), error))
                rows.append(row)
            found = pd.DataFrame(out, columns=names)
            for c in keep:
                found[c] = b[c].iloc[rows].reset_index(drop=True)
            yield found

    return files.filter("path is not null").select("path", *dict.fromkeys(("content", *keep))).mapInPandas(walk, PARSED + kept)


def symbols(parsed: DataFrame) -> DataFrame:
    """id, path, ordinal, name, kind, line_start, line_end, is_exported, is_test of parse_files's rows."""
    rows = parsed.select("path", F.explode("symbols").alias("s")).select("path", "s.*")
    return rows.withColumns({"id": F.concat_ws(":", "path", F.col("line_start").cast("string"), "name"), "is_test": in_test_folder(F.col("path"))})


def imports(parsed: DataFrame) -> DataFrame:
    """path, ordinal, source of parse_files's rows; sources keep their quotes."""
    return parsed.select("path", F.explode("imports").alias("i")).select("path", "i.*")
