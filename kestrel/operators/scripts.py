"""Classes of JavaScript and TypeScript files, from a token stream whose brackets are matched.

No parser for scripts is at hand.  Tokens leave comments, strings, templates and regular expressions
behind; with brackets matched, the members of a class are the tokens of its own level.  Text between
tags of JSX is read as tokens too; brackets in it that don't match cost the classes around them only.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Classes that frameworks ask to extend, however few methods they need.
FRAMEWORK_CLASSES = ["Component", "PureComponent", "EventEmitter", "Transform", "Readable", "Writable", "Duplex", "HTMLElement", "Error", "TypeError", "RangeError", "Injectable", "Controller", "Module", "Guard", "Interceptor", "Pipe"]
MODIFIERS = {"public", "private", "protected", "static", "async", "override", "readonly", "get", "set", "accessor", "declare", "abstract"}
TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/|\Z)|<!--)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<word>[#@]?[A-Za-z_$\u0080-\U0010ffff][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|\?\.|\.\.\.|&&|\|\||\?\?|[=!]==?|[^\s\w])""",
    re.S,
)
#: After these a slash begins a regular expression.
BEFORE_REGEX = {"(", ",", "=", ":", "[", "!", "&&", "||", "??", "?", "{", "}", ";", "=>", "==", "===", "!=", "!==", "+", "-", "*", "%", "<", ">", "return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "new"}
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: What may mean something in a template, and in code inside of one; all else between is passed over at once.
IN_TEMPLATE, IN_CODE = re.compile(r"[\\`]|\$\{"), re.compile(r"""[`"'{}]""")
PAIRS = {"(": ")", "[": "]", "{": "}"}
CLASSES = "project string, path string, line long, name string, base string, methods long, constructors long"


def _template_end(text: str, at: int) -> int:
    """Index after the template that begins at a backtick; `${` leads back into code."""
    i = at + 1
    while found := IN_TEMPLATE.search(text, i):
        i = found.end()
        if found.group() == "`":
            return i
        if found.group() == "\\":
            i += 1
            continue
        depth = 1
        while depth:
            if not (found := IN_CODE.search(text, i)):
                return len(text)
            mark, i = found.group(), found.end()
            if mark == "`":
                i = _template_end(text, i - 1)
            elif mark in "\"'":
                found = TOKEN.match(text, i - 1)
                i = found.end() if found and found.lastgroup == "string" else i
            else:
                depth += 1 if mark == "{" else -1
    return len(text)


def tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, value, place) of words, strings, numbers and marks; literals keep their kind, not their content."""
    out, i = [], 0
    while i < len(text):
        if text[i] == "`":
            end = _template_end(text, i)
            out.append(("string", "`", i))
            i = end
            continue
        if text[i] == "/" and (not out or out[-1][1] in BEFORE_REGEX) and (found := REGEX.match(text, i)):
            out.append(("string", "/", i))
            i = found.end()
            continue
        found = TOKEN.match(text, i)
        if found.lastgroup != "skip":
            out.append((found.lastgroup, found.group(), i))
        i = found.end()
    return out


def matched(found: list[tuple[str, str, int]]) -> dict[int, int]:
    """Number of the closing bracket of each opening one; one that is never closed ends with the tokens."""
    ends, open_ = {}, []
    for n, (kind, value, _) in enumerate(found):
        if kind == "mark" and value in PAIRS:
            open_.append(n)
        elif kind == "mark" and value in PAIRS.values():
            while open_ and PAIRS[found[open_[-1]][1]] != value:
                ends[open_.pop()] = n
            if open_:
                ends[open_.pop()] = n
    return ends | dict.fromkeys(open_, len(found))


class _Members:
    """Names of the methods with a body among the tokens between two places."""

    def __init__(self, found, ends, text):
        self.found, self.ends, self.text = found, ends, text

    def value(self, n: int) -> str:
        return self.found[n][1] if n < len(self.found) and self.found[n][0] in ("mark", "word") else ""

    def angles(self, n: int) -> int:
        """The place after type parameters that begin here."""
        depth = 0
        while n < len(self.found):
            v = self.value(n)
            depth += (v == "<") - (v == ">")
            n = self.ends.get(n, n) + 1
            if not depth:
                break
        return n

    def type_end(self, n: int) -> int:
        """The place after a type: what an operand and operators in turn make up."""
        operand = True
        while n < len(self.found):
            v = self.value(n)
            if operand:
                if v in ("keyof", "typeof", "readonly", "infer", "asserts", "|", "&", "new", "unique", "abstract"):
                    n += 1
                    continue
                n, operand = (self.angles(n) if v == "<" else self.ends.get(n, n) + 1), v == "<"
            elif v in ("|", "&", "=>", ".", "is", "extends", "?", ":"):
                n, operand = n + 1, True
            elif v == "[":
                n = self.ends.get(n, n) + 1
            elif v == "<":
                n = self.angles(n)
            else:
                return n
        return n

    def between(self, n: int, stop: int) -> list[str]:
        names = []
        while n < stop:
            if self.value(n) in (";", ",", "}"):
                n += 1
                continue
            if self.value(n).startswith("@"):  # a decorator: its name, its parts, its arguments
                n += 1
                while self.value(n) == ".":
                    n += 2
                n = self.ends[n] + 1 if self.value(n) == "(" else n
                continue
            while self.value(n) in MODIFIERS and self.value(n + 1) not in ("(", "=", ":", ";", "?", "!", "<", "}", ","):
                n += 1
            n += self.value(n) == "*"
            if self.value(n) == "{":  # a static block
                n = self.ends[n] + 1
                continue
            name, n = self.found[n][1] if n < stop else "", self.ends.get(n, n) + 1
            n += self.value(n) in ("?", "!")
            n = self.angles(n) if self.value(n) == "<" else n
            if self.value(n) == "(":
                n = self.ends[n] + 1
                n = self.type_end(n + 1) if self.value(n) == ":" else n
                if self.value(n) == "{":
                    names.append(name)
                    n = self.ends[n] + 1
                continue
            n = self.field_end(n, stop)
        return names

    def field_end(self, n: int, stop: int) -> int:
        """The place after a field: a semicolon, or a line's end that neither side goes on over."""
        while n < stop and self.value(n) != ";":
            after = self.ends.get(n, n) + 1
            if after < stop and self.lines(after - 1, after) and self.value(n if after == n + 1 else after - 1) not in ("=", "=>", ":", ",", "+", "|", "&", "?", ".", "&&", "||", "??"):
                if self.value(after) not in ("=", "=>", ":", ",", "+", "|", "&", "?", ".", "?.", "(", "[", "&&", "||", "??") or self.value(after) == "[":
                    return after
            n = after
        return n

    def lines(self, a: int, b: int) -> bool:
        return "\n" in self.text[self.found[a][2] : self.found[b][2]]


def classes(text: str) -> list[dict]:
    """line, name, base, methods and constructors of each class declaration; class expressions and abstract classes are none."""
    found = tokens(text)
    ends = matched(found)
    reader, out, line, counted = _Members(found, ends, text), [], 1, 0
    for n, (kind, value, at) in enumerate(found):
        if kind != "word" or value != "class" or n + 1 >= len(found) or found[n + 1][0] != "word":
            continue
        before = found[n - 1][1] if n else ";"
        if before in ("abstract", ".", "?.", "=", "(", ",", ":", "return", "?", "=>", "new", "[", "&&", "||", "??"):
            continue
        name, base, m = found[n + 1][1], None, n + 2
        if name in ("extends", "implements"):
            continue
        m = reader.angles(m) if reader.value(m) == "<" else m
        if reader.value(m) == "extends":
            m += 1
            while m < len(found) and found[m][0] == "word" and found[m][1] != "implements":
                base, m = found[m][1], m + 1
                if reader.value(m) != ".":
                    break
                m += 1
        while m < len(found) and reader.value(m) != "{":
            m = reader.angles(m) if reader.value(m) == "<" else ends.get(m, m) + 1
        if m >= len(found):
            continue
        names = reader.between(m + 1, ends[m])
        line, counted = line + text.count("\n", counted, at), at
        out.append({"line": line, "name": name, "base": base, "methods": sum(x != "constructor" for x in names), "constructors": names.count("constructor")})
    return out


def script_classes(files: DataFrame) -> DataFrame:
    """A row per class declaration of each JavaScript or TypeScript file of (project, path, content) (E3, A15): methods counts those with a body, without constructors.  Null texts have none."""
    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in CLASSES.split(", "))])

    def read(batches):
        for batch in batches:
            for file in batch.to_pylist():
                rows = [{"project": file["project"], "path": file["path"]} | c for c in classes(file["content"] or "")]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    scripts = files.where(F.col("path").rlike(r"[.](js|jsx|mjs|cjs|ts|tsx|mts|cts)$"))
    return scripts.select("project", "path", "content").mapInArrow(read, CLASSES)


def single_method(found: DataFrame) -> DataFrame:
    """Classes with one method beside at most one constructor, which no framework asks for."""
    asked = F.coalesce(F.col("base").isin(FRAMEWORK_CLASSES), F.lit(False))
    return found.where((F.col("methods") == 1) & (F.col("constructors") <= 1) & ~asked)
