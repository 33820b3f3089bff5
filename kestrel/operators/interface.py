"""Findings in interface code (JSX, TSX): buttons that do nothing, effects, handlers, state set while rendering, markup.

No parser for scripts is at hand, so a bounded scanner reads them: literals and comments are blanked
out, brackets are matched, tags and attributes are walked.  It looks at one file at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kestrel.functions import scalars as S

#: Attributes that take event handlers.
EVENTS = ["onClick", "onChange", "onSubmit", "onBlur", "onFocus", "onMouseEnter", "onMouseLeave", "onKeyDown", "onKeyUp"]
#: Tags that say nothing without a class.
GENERIC_TAGS = [
    "div", "span", "p", "a", "li", "ul", "ol", "section", "header", "footer", "nav", "main", "aside", "article", "h1", "h2", "h3", "h4", "h5", "h6",
    "button", "input", "select", "option", "textarea", "form", "label", "table", "thead", "tbody", "tr", "th", "td", "tfoot", "img", "br", "hr", "strong", "em", "b", "i",
    "small", "sup", "sub", "pre", "code", "blockquote", "details", "summary", "dialog", "svg", "path", "circle", "rect", "line", "g", "defs", "clipPath",
    "video", "audio", "source", "canvas", "iframe",
]
LITERAL = re.compile(r"""//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|"(?:\\.|[^"\\\n])*"|(?<![A-Za-z])'(?:\\.|[^'\\\n])*'""", re.S)
TAG = re.compile(r"(?<![\w)\]])<(/?)([A-Za-z][\w.-]*)?")
COMPONENT = re.compile(r"\bfunction\s+[A-Z]\w*\s*(?=\()|\b(?:const|let|var)\s+[A-Z]\w*\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:function\s*\w*\s*)?(?=\()")
CLOSING = {"(": ")", "[": "]", "{": "}"}
FINDINGS = "project string, path string, line long, rule string, detail string"


def _blank(text: str) -> str:
    """Text of the same length without literals and comments; line ends and the quotes' places stay."""
    return LITERAL.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _end(bare: str, at: int) -> int:
    """Index of the bracket that closes the one at a place, or of the end."""
    open_ = []
    for i in range(at, len(bare)):
        c = bare[i]
        if c in CLOSING:
            open_.append(CLOSING[c])
        elif open_ and c == open_[-1]:
            open_.pop()
            if not open_:
                return i
    return len(bare)


def _attributes(text: str, bare: str, at: int) -> tuple[list[tuple[str, int, str]], int, bool]:
    """(name, place, value) of a tag from the end of its name; where it ends; whether it closes itself."""
    found, i = [], at
    while i < len(bare) and bare[i] != ">":
        if bare[i] == "{":
            stop = _end(bare, i)
            found.append(("...", i, text[i + 1 : stop]))
            i = stop + 1
        elif name := re.compile(r"[A-Za-z_][\w:-]*").match(bare, i):
            value, j = "", name.end()
            if equal := re.compile(r"\s*=\s*").match(bare, j):
                j = re.compile(r"\s*=\s*").match(text, j).end()
                if text[j : j + 1] == "{":
                    stop = _end(bare, j)
                    value, equal = text[j : stop + 1], stop + 1
                elif quoted := re.compile(r"\"[^\"]*\"|'[^']*'").match(text, j):
                    value, equal = quoted.group(), quoted.end()
                else:
                    equal = j + 1
                found.append((name.group(), j, value))
                i = equal
            else:
                found.append((name.group(), name.start(), value))
                i = j
        else:
            i += 1
    return found, i, bare[max(at, i - 1) : i] == "/"


def _awaits_bare(body: str) -> bool:
    """Whether a handler awaits outside of try blocks and inner functions."""
    bare = _blank(body)
    arrow = re.match(r"\s*async\b[^{=]*(?:\([^)]*\))?[^={]*=>\s*", bare)
    start = arrow.end() if arrow else bare.find("{", max(bare.find(")"), 0))
    inner = bare[start + 1 : _end(bare, start)] if bare[start : start + 1] == "{" else bare[start:]
    for opening in (r"\btry\s*\{", r"=>\s*\{", r"\bfunction\b[^{]*\{"):
        while m := re.search(opening, inner):
            inner = inner[: m.start()] + inner[_end(inner, m.end() - 1) + 1 :]
    return bool(re.search(r"\bawait\b", inner))


def _tags(text: str, bare: str) -> Iterator[tuple[int, str, str]]:
    """Findings on tags; elements are kept on a stack, for forms and clickable ancestors."""
    stack: list[tuple[str, bool, bool]] = []
    for m in TAG.finditer(bare):
        closing, name = m.group(1), m.group(2) or ""
        if closing:
            if any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        attributes, end, alone = _attributes(text, bare, m.end())
        if end >= len(bare):
            continue
        names = {a for a, _, _ in attributes}
        in_form, in_click = (any(s[k] for s in stack) for k in (1, 2))
        if name == "button" and not names & {"onClick", "formAction", "onKeyDown", "..."} and not in_click:
            if not (in_form and any(a == "type" and v.strip("\"'{} ") == "submit" for a, _, v in attributes)):
                yield m.start(), "ux.button-no-handler", name
        for a, at, value in attributes:
            if a in EVENTS and value.startswith("{"):
                inner = value[1:-1].strip()
                if re.fullmatch(r"[A-Za-z_$][\w$]*\s*\(\s*\)", inner):
                    yield at, "ux.handler-called-not-referenced", a
                elif re.match(r"async\b", inner) and _awaits_bare(inner):
                    yield at, "ux.async-handler-no-catch", a
        if name and not name[0].isupper():
            classes = [v.strip("\"'{}") for a, _, v in attributes if a in ("className", "class", "variant")]
            classes = [c for c in classes if c and "${" not in c]
            if classes:
                yield m.start(), "markup", f"<{name} class='{classes[-1]}'>"
            elif name not in GENERIC_TAGS:
                yield m.start(), "markup", f"<{name}>"
        if not alone:
            stack.append((name, name == "form", "onClick" in names))


def _effects(bare: str) -> Iterator[tuple[int, str, str]]:
    """Effects with one argument only."""
    for m in re.finditer(r"\b(useEffect|useLayoutEffect)\s*\(", bare):
        stop = _end(bare, m.end() - 1)
        inner, depth, commas = bare[m.end() : stop].rstrip().removesuffix(","), 0, 0
        for c in inner:
            depth += (c in "([{") - (c in ")]}")
            commas += c == "," and depth == 0
        if inner.strip() and not commas:
            yield m.start(), "ux.effect-missing-deps-array", m.group(1)


def _state(bare: str) -> Iterator[tuple[int, str, str]]:
    """State that a component's body sets by itself, in plain or conditional blocks."""
    for m in COMPONENT.finditer(bare):
        start = bare.find("{", _end(bare, m.end()))
        if start < 0 or not re.fullmatch(r"\)?\s*(:[^{]*)?(=>)?\s*", bare[_end(bare, m.end()) : start]):
            continue
        stop = _end(bare, start)
        body = bare[start + 1 : stop]
        setters = set(re.findall(r"\[\s*\w+\s*,\s*(\w+)\s*\]\s*=\s*(?:\w+\.)?useState\b", body))
        plain: list[tuple[int, bool]] = []  # where a bracket opens, and whether it is a block
        closed = (-1, -1)  # the last bracket that closed, and where it opened
        for token in re.finditer(r"[()\[\]{}]|\b\w+(?=\s*\()", body):
            word, last = token.group(), token.start() - 1
            while last >= 0 and body[last].isspace():
                last -= 1
            end = body[max(0, last - 4) : last + 1]
            after_else = bool(re.search(r"\belse$", end)) or end == "else"
            if word in CLOSING:
                after_if = end.endswith(")") and closed[0] == last and bool(re.search(r"\bif\s*$", body[max(0, closed[1] - 40) : closed[1]]))
                plain.append((token.start(), word == "{" and (end[-1:] in ("", ";", "{", "}") or after_else or after_if)))
            elif word in CLOSING.values():
                if plain:
                    closed = (token.start(), plain.pop()[0])
            elif word in setters and all(p for _, p in plain) and (end[-1:] in ("", ";", "{", "}", ")") or after_else or "\n" in body[last + 1 : token.start()]) and not end.endswith("=>"):
                yield start + 1 + token.start(), "ux.setstate-in-render", word


def findings(files: DataFrame) -> DataFrame:
    """(project, path, line, rule, detail) of JSX and TSX files (D17-D21), and their markup patterns under `markup`."""
    schema = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (f.split() for f in FINDINGS.split(", "))])

    def read(batches):
        for batch in batches:
            for file in batch.to_pylist():
                text = file["content"] or ""
                bare = _blank(text)
                rows = [
                    {"project": file["project"], "path": file["path"], "line": text.count("\n", 0, at) + 1, "rule": rule, "detail": detail}
                    for part in (_tags(text, bare), _effects(bare), _state(bare))
                    for at, rule, detail in part
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    seen = files.where(S.extension(F.col("path")).isin("jsx", "tsx") & ~S.is_test_path(F.col("path")))
    return seen.select("project", "path", "content").mapInArrow(read, FINDINGS)


def reuse(found: DataFrame, least_files: int = 3, least_uses: int = 3) -> DataFrame:
    """(project, pattern, uses, files) of markup that stands often in several files."""
    groups = found.where("rule = 'markup'").groupBy("project", F.col("detail").alias("pattern")).agg(F.count("*").alias("uses"), F.count_distinct("path").alias("files"))
    return groups.where((F.col("uses") >= least_uses) & (F.col("files") >= least_files))
