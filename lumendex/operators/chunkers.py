"""Chunkers: table functions from files to documentation chunks.

A chunker turns the text of one file into items (a documented declaration, a comment block or a
section) with metadata; items are filtered, split to a token budget with overlap, and hashed.
``CHUNKERS`` is the registry; ``chunk_files`` applies it to a table with an Arrow-batched map.

Source languages are read by a scanner that blanks comments and strings, and a pass over the braces
and declarations that are left; no parser is needed.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

MAX_TOKENS, OVERLAP_TOKENS = 256, 38


class ParseError(ValueError):
    """The file is not well formed; it is skipped and counted."""


@dataclass
class Item:
    text: str
    name: str | None = None
    item_type: str | None = None
    visibility: str | None = None
    signature: str | None = None
    package: str | None = None
    headings: list[str] | None = None
    always: bool = False  # passes the filter whatever it says


@dataclass(frozen=True)
class ItemFilter:
    """Which items are kept: visibility (None: any), item types ('all' for every type), least lines of doc."""

    visibility: tuple[str, ...] | None = None
    items: tuple[str, ...] = ("all",)
    min_doc_lines: int = 0

    def keeps(self, item: Item) -> bool:
        if item.always or item.item_type is None:
            return True
        seen = self.visibility is None or item.visibility is None or PUBLIC.get(item.visibility, item.visibility) in self.visibility
        return seen and ("all" in self.items or item.item_type in self.items) and len(item.text.splitlines()) >= self.min_doc_lines


# How each language's visibility counts in a filter.
PUBLIC = {
    "exported": "public", "unexported": "private", "local": "private", "protected": "public", "package-private": "private", "internal": "public",
}
PUBLIC_ONLY = ItemFilter(visibility=("public",))

# -- scanning ---------------------------------------------------------------------------------


@dataclass
class Comment:
    start: int
    end: int
    line: int
    last_line: int
    text: str

    @property
    def is_line(self) -> bool:
        return not self.text.startswith("/*")


@dataclass(frozen=True)
class Lexis:
    line: str = "//"
    block: bool = True
    nested: bool = False
    quotes: str = '"'
    raw: tuple[str, ...] = ()  # delimiters without escapes, longest first
    rust: bool = False
    regex: bool = False  # /.../ literals


#: What a slash after it begins a regular expression, not a division.
_BEFORE_REGEX = re.compile(r"(^|[=(,:;!&|?{}\[+\-*%~^<>\n]|\b(return|typeof|case|in|of|delete|void|throw|new|else|do))\s*$")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")


def scan(source: str, lex: Lexis) -> tuple[str, list[Comment]]:
    """(source with comments and strings blanked, comments)"""
    out, comments, i, n = list(source), [], 0, len(source)
    line_of = _line_numbers(source)

    def blank(a: int, b: int) -> None:
        for k in range(a, b):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        if source.startswith(lex.line, i) and not (lex.line == "#" and i and not source[i - 1].isspace() and source[i - 1] != ";"):
            end = source.find("\n", i)
            end = n if end < 0 else end
            comments.append(Comment(i, end, line_of(i), line_of(i), source[i:end]))
            blank(i, end)
            i = end
        elif lex.block and source.startswith("/*", i):
            depth, k = 1, i + 2
            while depth and k < n:
                if source.startswith("*/", k):
                    depth, k = depth - 1, k + 2
                elif lex.nested and source.startswith("/*", k):
                    depth, k = depth + 1, k + 2
                else:
                    k += 1
            if depth and lex.rust:
                raise ParseError("a block comment does not end")
            if depth:  # no comment, and nothing after it can be read
                blank(i, n)
                break
            comments.append(Comment(i, k, line_of(i), line_of(k - 1), source[i:k]))
            blank(i, k)
            i = k
        elif lex.regex and source[i] == "/" and _BEFORE_REGEX.search("".join(out[max(0, i - 40) : i])) and (m := _REGEX.match(source, i)):
            blank(i, m.end())
            i = m.end()
        elif (mark := next((r for r in lex.raw if source.startswith(r, i)), None)) is not None:
            end = source.find(mark, i + len(mark))
            end = n if end < 0 else end + len(mark)
            blank(i, end)
            i = end
        elif lex.rust and (m := _RUST_RAW.match(source, i)):
            end = source.find('"' + m[1], m.end())
            end = n if end < 0 else end + 1 + len(m[1])
            blank(i, end)
            i = end
        elif lex.rust and source[i] == "'":
            m = _RUST_CHAR.match(source, i)
            if m:
                blank(i, m.end())
            i = m.end() if m else i + 1  # a lone quote is a lifetime
        elif source[i] in lex.quotes:
            k = i + 1
            while k < n and source[k] != source[i] and not (source[k] == "\n" and lex.line != "#" and not lex.rust):
                k += 2 if source[k] == "\\" else 1
            blank(i, min(n, k + 1))
            i = k + 1
        else:
            i += 1
    return "".join(out), comments


_RUST_RAW = re.compile(r'\bb?r(#*)"')
_RUST_CHAR = re.compile(r"'(\\[^']+|[^'\\\n])'")


def _line_numbers(source: str) -> Callable[[int], int]:
    import bisect

    starts = [m.end() for m in re.finditer("\n", source)]
    return lambda at: bisect.bisect_right(starts, at)


def _doc_before(at: int, code: str, comments: list[Comment], accept: Callable[[Comment], bool], between: re.Pattern) -> list[Comment]:
    """Comments that lead up to a declaration: one block, or adjacent line comments."""
    run: list[Comment] = []
    for c in reversed([c for c in comments if c.end <= at]):
        if not run:
            if not between.fullmatch(code[c.end : at]):
                return []
            if not accept(c):
                return []
            run.append(c)
            if not c.is_line:
                break
        elif c.is_line and accept(c) and run[-1].line - c.last_line == 1 and not code[c.end : run[-1].start].strip():
            run.append(c)
        else:
            break
    return run[::-1]


def clean_block(text: str, stars: bool = True) -> str:
    inner = re.sub(r"\*+/$", "", re.sub(r"^/\*+(?!/)", "", text.strip()))
    lines = [x.strip() for x in inner.split("\n")]
    if stars:
        lines = [re.sub(r"^\*+", "", x).strip() for x in lines]
    return "\n".join(x for x in lines if x)


def clean_lines(run: list[Comment], mark: str) -> str:
    return "\n".join(re.sub(f"^({mark})+", "", c.text.strip()).strip() for c in run)


# -- declarations -----------------------------------------------------------------------------


@dataclass
class Found:
    kind: str
    name: str
    start: int
    scope: tuple[str, ...]
    match: re.Match


def check_brackets(code: str) -> None:
    """Raises unless all brackets of code without comments and strings are paired."""
    pairs, stack = {")": "(", "]": "[", "}": "{"}, []
    for m in re.finditer(r"[()\[\]{}]", code):
        if m[0] not in pairs:
            stack.append(m[0])
        elif not stack or stack.pop() != pairs[m[0]]:
            raise ParseError(f"{m[0]} closes nothing")
    if stack:
        raise ParseError(f"{stack[-1]} is not closed")


def declarations(code: str, pattern: re.Pattern, kind_of: Callable[[re.Match], str]) -> list[Found]:
    """Declarations in order, each with the kinds of the braces around it. Braces without a partner are passed over."""
    found, stack, pending = [], [], None
    for m in re.compile(f"(?P<__mark>[{{}};])|{pattern.pattern}", re.M).finditer(code):
        mark = m["__mark"]
        if mark == "{":
            stack.append(pending or "block")
            pending = None
        elif mark == "}":
            if stack:
                stack.pop()
        elif mark == ";":
            pending = None
        else:
            pending = kind_of(m)
            found.append(Found(pending, m["name"] or "", m.start("decl"), tuple(stack), m))
    return found


def _header(source: str, code: str, start: int) -> str:
    """The declaration up to its body."""
    m = re.compile(r"[{;]").search(code, start)
    return " ".join(source[start : m.start() if m else len(source)].split())


def _extent(source: str, code: str, start: int) -> str:
    """The whole declaration, its body included."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, start):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return source[start : m.end()]
    return source[start:].split("\n", 1)[0]


def _first_line(source: str, start: int) -> str:
    return source[start:].split("\n", 1)[0].strip()


_BLANK = re.compile(r"\s*")

# -- languages --------------------------------------------------------------------------------


def markdown(source: str, path: str) -> list[Item]:
    """Sections by heading line; any trimmed line that starts with ``#`` opens one, in fences too."""
    items, stack, lines = [], [], []

    def close() -> None:
        if any(x.strip() and not x.strip().startswith("#") for x in lines):
            items.append(Item("\n".join(lines).strip(), headings=[t for _, t in stack]))

    for line in source.split("\n"):
        s = line.strip()
        if s.startswith("#"):
            close()
            lines = []
            level, title = len(s) - len(s.lstrip("#")), s.lstrip("#").strip()
            if title:
                stack = [x for x in stack if x[0] < level] + [(level, title)]
        lines.append(line)
    close()
    return items


_RUST = re.compile(r"^[ \t]*(?P<decl>(?P<vis>pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|async|unsafe|const|extern(?:\s+\S+)?)\s+)*(?P<kind>fn|struct|enum|trait|type|mod|const|impl)\b\s*(?P<name>[A-Za-z_]\w*)?)")
_RUST_KINDS = {"fn": "functions", "struct": "structs", "enum": "enums", "trait": "traits", "type": "type-aliases", "const": "constants", "mod": "modules"}
_RUST_ATTRS = re.compile(r"(?:\s|#\[(?:[^\[\]]|\[[^\]]*\])*\])*")


def rust(source: str, path: str) -> list[Item]:
    """Only of this language is a file that does not parse an error; the others give what can be read."""
    code, comments = scan(source, Lexis(nested=True, rust=True))
    check_brackets(code)
    inner = [c for c in comments if c.text.startswith(("//!", "/*!"))]

    def doc_text(run: list[Comment]) -> str:
        return "\n".join(c.text[3:] if c.is_line else clean_block(c.text) for c in run)

    items = []
    top = [c for c in inner if not code[: c.start].strip()]
    if top:
        items.append(Item(doc_text(top), "module", "modules", "public"))
    outer = lambda c: c.text.startswith(("///", "/**")) and not c.text.startswith(("////", "/***"))
    for d in declarations(code, _RUST, lambda m: m["kind"]):
        if not re.compile(r"[{;]").search(code, d.start):
            raise ParseError(f"{d.kind} {d.name} does not end")
        in_impl = d.scope[-1:] == ("impl",)
        if d.kind == "impl" or any(s not in ("mod", "impl") for s in d.scope) or (in_impl and d.kind != "fn"):
            continue
        text = doc_text(_doc_before(d.start, code, comments, outer, _RUST_ATTRS))
        if text.strip():
            vis = re.sub(r"\s", "", d.match["vis"] or "")
            visibility = {"pub": "public", "pub(crate)": "crate"}.get(vis, "private")
            sig = re.sub(r"^pub(\([^)]*\))?\s+", "", _header(source, code, d.start)) if d.kind == "fn" else None
            items.append(Item(text, d.name, "impls" if in_impl else _RUST_KINDS[d.kind], visibility, sig))
    return items


_GO = re.compile(r"^(?P<decl>(?P<kind>package|func|type|const|var)\b[ \t]*(?:\((?P<recv>[^()]*)\)[ \t]*(?=\w))?\(?\s*(?P<name>\w+)?)")


def go(source: str, path: str) -> list[Item]:
    code, comments = scan(source, Lexis(quotes="\"'", raw=("`",)))
    items, package = [], None
    for d in declarations(code, _GO, lambda m: m["kind"]):
        if d.scope or not d.name:
            continue
        if d.kind == "package":
            package = d.name
        run = _doc_before(d.start, code, comments, lambda c: True, re.compile(r"[ \t]*\n?[ \t]*"))
        text = "\n".join(clean_block(c.text) if not c.is_line else clean_lines([c], "//") for c in run)
        if not text.strip():
            continue
        kind, rest = d.kind, code[d.match.end() :]
        if kind == "func":
            kind = "method" if d.match["recv"] is not None else "function"
        elif kind == "type":
            kind = {"struct": "struct", "interface": "interface"}.get(re.match(r"(?:\[[^\]]*\])?\s*(\w*)", rest)[1], "type")
        visibility = "exported" if d.name[:1].isupper() or kind == "package" else "unexported"
        sig = _extent(source, code, d.start) if d.kind == "func" else None
        items.append(Item(text, "package" if kind == "package" else d.name, kind, visibility, sig, package, always=kind == "package"))
    return items


_C = re.compile(
    r"^(?P<decl>(?:(?:static|extern|inline|const|volatile|register|unsigned|signed)\s+)*(?:(?P<typedef>typedef\b[^;{]*)|(?P<kind>struct|enum|union)\s+(?P<tag>\w+)(?=\s*[{;])|(?P<func>[A-Za-z_][\w \t\*]*?[ \t\*]+(?P<fname>\w+)\s*\([^;{}]*\)\s*(?=\{))|(?P<other>[A-Za-z_][\w \t\*]*?[ \t\*]+(?P<oname>\w+)\s*(?:\([^;{}]*\))?(?:\[[^\]]*\])*\s*(?:=[^;]*)?(?=;)))(?P<name>))"
)


def c_docs(source: str, path: str) -> list[Item]:
    code, comments = scan(source, Lexis(quotes="\"'"))
    code = re.sub(r"(?m)^[ \t]*#(?:[^\n\\]|\\\n|\\.)*", lambda m: re.sub(r"[^\n]", " ", m[0]), code)  # directives hold no items

    def kind_of(m: re.Match) -> str:
        return "typedef" if m["typedef"] else m["kind"] if m["kind"] else "function" if m["func"] else "declaration"

    items, used = [], set()
    for d in declarations(code, _C, kind_of):
        if d.scope:
            continue
        m = d.match
        kind = d.kind if d.kind in ("typedef", "struct", "enum", "function") else "declaration"
        run = _doc_before(d.start, code, comments, lambda c: True, _BLANK)
        if not run or id(run[0]) in used:
            continue
        used |= {id(c) for c in run}
        name = m["tag"] or m["fname"] or m["oname"]
        if kind == "typedef":
            body = _extent(code, code, d.start) if code[m.end() : m.end() + 1] == "{" else ""
            name = (re.match(r"[^;]*?(\w+)\s*(?:\[[^\]]*\])*\s*;", code[d.start + len(body) :]) or [None, None])[1]
        text = "\n".join(clean_block(c.text) if not c.is_line else clean_lines([c], "//") for c in run)
        if text.strip():
            items.append(Item(text, name, kind, None, _first_line(source, d.start)))
    depth_at = _depths(code)
    run: list[Comment] = []
    for c in [*comments, None]:
        if run and (c is None or not (c.is_line and run[-1].is_line and c.line - run[-1].last_line == 1)):
            text = "\n".join(clean_block(x.text) if not x.is_line else clean_lines([x], "//") for x in run)
            if text.strip():
                items.append(Item(text, None, "standalonecomment"))
            run = []
        if c is not None and id(c) not in used and depth_at(c.start) == 0:
            run.append(c)
    return items


def _depths(code: str) -> Callable[[int], int]:
    import bisect

    at, depth, now = [0], [0], 0
    for m in re.finditer(r"[{}]", code):
        now += 1 if m[0] == "{" else -1
        at.append(m.end())
        depth.append(now)
    return lambda i: depth[bisect.bisect_right(at, i) - 1]


_SHELL_FUNCTION = re.compile(r"^[ \t]*(?:function[ \t]+(?P<a>[\w:.-]+)[ \t]*(?:\(\))?|(?P<b>[\w:.-]+)[ \t]*\(\))[ \t]*(?:\{|$)")


def shell(source: str, path: str) -> list[Item]:
    """Comment blocks (gaps of at most one line); one right before a function is its doc; the shebang is skipped."""
    _, comments = scan(source, Lexis(line="#", block=False, quotes="\"'"))
    lines = source.split("\n")
    whole = [c for c in comments if not lines[c.line][: lines[c.line].find("#")].strip() and not (c.line == 0 and c.text.startswith("#!"))]
    items, block = [], []
    for c in [*whole, None]:
        if block and (c is None or c.line - block[-1].line > 1):
            text = clean_lines(block, "#")
            after = next((x for x in lines[block[-1].line + 1 :] if x.strip()), "")
            m = _SHELL_FUNCTION.match(after)
            if text.strip():
                items.append(Item(text, (m["a"] or m["b"]) if m else None, "function" if m else "standalonecomment", None, after.strip() if m else None))
            block = []
        if c is not None:
            block.append(c)
    return items


_JS = re.compile(
    r"(?P<decl>(?<![\w.$])(?P<export>export\s+(?:default\s+)?)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:const\s+(?=enum\b))?(?P<kind>function\*?|class|interface|type|enum|const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*))"
)
_JS_KINDS = {"function": "function", "function*": "function", "class": "class", "interface": "interface", "type": "typealias", "enum": "enum", "const": "variable", "let": "variable", "var": "variable"}
_JS_DECORATORS = re.compile(r"(?:\s|@[\w.]+(?:\([^)]*\))?)*")


def js(source: str, path: str) -> list[Item]:
    code, comments = scan(source, Lexis(quotes="\"'", raw=("`",), regex=True))
    module = posixpath.splitext(posixpath.basename(path))[0]
    typed = path.endswith((".ts", ".tsx"))

    def text_of(run: list[Comment]) -> str:
        if run and not run[-1].is_line:
            return clean_block(run[-1].text, stars=run[-1].text.startswith("/**"))
        return clean_lines(run, "//")

    items = []
    if comments and not code[: comments[0].start].strip() and comments[0].text.startswith("/**"):
        items.append(Item(clean_block(comments[0].text), module, "module", "exported", None, module))
    for d in declarations(code, _JS, lambda m: m["kind"]):
        if not typed and d.kind in ("interface", "type", "enum"):
            continue
        text = text_of(_doc_before(d.start, code, comments, lambda c: True, _JS_DECORATORS))
        if text.strip():
            items.append(Item(text, d.name, _JS_KINDS[d.kind], "exported" if d.match["export"] else "local", _first_line(source, d.start), module))
    return items


_MODS = r"(?:(?:public|protected|private|internal|static|final|abstract|sealed|non-sealed|default|synchronized|native|strictfp|transient|volatile|open|data|inner|override|suspend|inline|const|lateinit|operator|infix|enum(?=\s+class)|annotation(?=\s+class)|value|companion|external|tailrec|actual|expect)\s+)*"
_JAVA = re.compile(
    r"(?:^|(?<=[{};]))[ \t]*(?P<decl>(?P<mods>" + _MODS + r")(?:(?P<kind>class|interface|enum|record|@interface)\s+(?P<tname>\w+)|(?:<[^>]*>\s*)?(?P<type>[\w.]+(?:<[^;{}()]*>)?(?:\[\])*)\s+(?P<member>\w+)\s*(?P<paren>[(=;,])|(?P<ctor>[A-Z]\w*)\s*\()(?P<name>))"
)
_ANNOTATIONS = re.compile(r"(?:\s|@\w[\w.]*(?:\((?:[^()]|\([^()]*\))*\))?)*")
_NOT_TYPES = frozenset("return new throw else package import case goto yield assert".split())


def _visibility(mods: str, default: str) -> str:
    return next((v for v in ("public", "protected", "private", "internal") if re.search(rf"\b{v}\b", mods)), default)


def java(source: str, path: str) -> list[Item]:
    code, comments = scan(source, Lexis(quotes="\"'", raw=('"""',)))
    package = (re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", code) or [None, None])[1]
    kinds = {"class": "class", "interface": "interface", "enum": "enum", "record": "record", "@interface": "annotation"}

    def kind_of(m: re.Match) -> str:
        return kinds[m["kind"]] if m["kind"] else "constructor" if m["ctor"] else "method" if m["paren"] == "(" else "field"

    items = []
    for d in declarations(code, _JAVA, kind_of):
        m = d.match
        if any(s not in kinds.values() for s in d.scope) or (m["type"] in _NOT_TYPES) or (not m["kind"] and not d.scope):
            continue
        run = _doc_before(d.start, code, comments, lambda c: c.text.startswith("/**"), _ANNOTATIONS)
        text = clean_block(run[0].text) if run else ""
        if text.strip():
            name = m["tname"] or m["member"] or m["ctor"]
            items.append(Item(text, name, d.kind, _visibility(m["mods"], "package-private"), _first_line(source, d.start), package))
    return items


def kotlin(source: str, path: str) -> list[Item]:
    code, comments = scan(source, Lexis(nested=True, quotes="\"'", raw=('"""',)))
    package = (re.search(r"(?m)^\s*package\s+([\w.]+)", code) or [None, None])[1]
    pattern = re.compile(
        r"(?:^|(?<=[{};]))[ \t]*(?P<decl>(?P<mods>" + _MODS + r")(?:fun\s+(?=interface\b))?(?P<kind>class|interface|object|fun|val|var)\b[ \t]*(?:<[^>]*>[ \t]*)?(?:[\w<>?]+\.)?(?P<name>`[^`]+`|\w+)?)"
    )
    types = {"class": "class", "interface": "class", "object": "object", "fun": "function", "val": "property", "var": "property"}
    items = []
    for d in declarations(code, pattern, lambda m: types[m["kind"]]):
        if any(s not in ("class", "object") for s in d.scope):
            continue
        run = _doc_before(d.start, code, comments, lambda c: c.text.startswith("/**"), _ANNOTATIONS)
        text = clean_block(run[0].text) if run else ""
        if text.strip() and (d.name or d.kind == "object"):
            items.append(Item(text, d.name or "companion", d.kind, _visibility(d.match["mods"], "public"), _first_line(source, d.start), package))
    return items


@dataclass(frozen=True)
class Chunker:
    context_type: str
    extensions: tuple[str, ...]
    config_keys: tuple[str, ...]
    items: Callable[[str, str], list[Item]]
    default_on: bool = False
    package_key: str | None = None
    default_filter: ItemFilter = field(default_factory=ItemFilter)


#: Registry of chunkers by context type; register() adds one.
CHUNKERS: dict[str, Chunker] = {}


def register(chunker: Chunker) -> Chunker:
    CHUNKERS[chunker.context_type] = chunker
    return chunker


for _c in (
    Chunker("markdown", ("md",), ("markdown",), markdown, True),
    Chunker("rust_doc", ("rs",), ("rust",), rust, True, None, PUBLIC_ONLY),
    Chunker("shell_doc", ("sh",), ("shell",), shell, True),
    Chunker("c_doc", ("c", "h"), ("c",), c_docs, True),
    Chunker("go_doc", ("go",), ("go",), go, False, "package-name", PUBLIC_ONLY),
    Chunker("js_doc", ("js", "jsx", "ts", "tsx"), ("javascript", "typescript"), js, False, "module-name", PUBLIC_ONLY),
    Chunker("java_doc", ("java",), ("java",), java, False, "package-name", PUBLIC_ONLY),
    Chunker("kotlin_doc", ("kt", "kts"), ("kotlin",), kotlin, False, "package-name", PUBLIC_ONLY),
):
    register(_c)

# -- splitting and the table function ---------------------------------------------------------

_TOKEN = re.compile(r"\w+|[^\w\s]")


def count_tokens(text: str) -> int:
    return max(1, len(_TOKEN.findall(text)))


def split(text: str, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[str]:
    """Pieces of at most max_tokens tokens; neighbours share up to ``overlap``. A piece ends at a blank line, else at
    a line end, where one lies in its last quarter."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    if len(spans) <= max_tokens:
        return [text.strip()] if text.strip() else []
    out, first = [], 0
    while True:
        last = min(len(spans), first + max_tokens)
        if last < len(spans):
            # Between two tokens lies only white space: of the places with most line ends (two at most count), the latest.
            places = range(last, first + max(overlap + 1, max_tokens * 3 // 4), -1)
            last = max(places, key=lambda k: min(2, text.count("\n", spans[k - 1][1], spans[k][0])), default=last)
        out.append(text[spans[first][0] : spans[last - 1][1]].strip())
        if last == len(spans):
            return out
        first = max(first + 1, last - overlap)


def context_json(chunker: Chunker, item: Item) -> str:
    if item.headings is not None:
        return json.dumps({"heading-hierarchy": item.headings}, ensure_ascii=False)
    data = {"item-name": item.name, "visibility": item.visibility, "signature": item.signature, "item-type": item.item_type}
    if chunker.package_key:
        data[chunker.package_key] = item.package
    if item.visibility is None:
        del data["visibility"]
    return json.dumps(data, ensure_ascii=False)


CHUNK_SCHEMA = (
    "file_hash string, repo_name string, file_path string, ordinal int, chunk_hash string, context_type string, "
    "context_data string, content string, token_count int, last_modified long, error string"
)


def chunk_text(source: str, path: str, chunker: Chunker, keep: ItemFilter | None, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[dict]:
    """Chunk rows of one file (without the file's own columns)."""
    rows = []
    for item in chunker.items(source.replace("\r\n", "\n"), path):
        if keep is not None and not keep.keeps(item):
            continue
        for piece in split(item.text, max_tokens, overlap):
            rows.append({
                "ordinal": len(rows), "chunk_hash": hashlib.sha256(piece.encode()).hexdigest(), "context_type": chunker.context_type,
                "context_data": context_json(chunker, item), "content": piece, "token_count": count_tokens(piece), "error": None,
            })
    return rows


def chunk_files(
    files: DataFrame, filters: dict[str, ItemFilter | None] | None = None, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS
) -> DataFrame:
    """Chunk rows of files (file_hash, repo_name, file_path, file_type, last_modified, content). ``filters``:
    enabled context types and their item filters (None: no filter); by default every type with its own.
    A file that does not parse gives one row with an error and no chunk."""
    on = filters if filters is not None else {k: c.default_filter for k, c in CHUNKERS.items()}
    chunkers = dict(CHUNKERS)
    cols = ["file_hash", "repo_name", "file_path", "last_modified"]
    names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                own = {c: r[c] for c in cols}
                try:
                    if r["content"] is None:
                        raise ParseError("not UTF-8 text")
                    got = chunk_text(r["content"], r["file_path"], chunkers[r["file_type"]], on[r["file_type"]], max_tokens, overlap)
                except ParseError as e:
                    got = [{"error": f"parse: {e}"}]
                rows += [own | x for x in got]
            out = pd.DataFrame(rows, columns=names).astype(object)
            yield out.where(out.notna(), None)

    wanted = files.filter(files["file_type"].isin(*on)) if on else files.limit(0)
    return wanted.select(*cols, "file_type", "content").mapInPandas(run, CHUNK_SCHEMA)
