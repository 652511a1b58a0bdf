"""Path parts, file types and globs."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumendex.functions.text import is_shell_shebang, shebang

# File extensions of each context type.
EXTENSIONS = {
    "markdown": ["md"], "rust_doc": ["rs"], "go_doc": ["go"], "shell_doc": ["sh"], "c_doc": ["c", "h"],
    "js_doc": ["js", "jsx", "ts", "tsx"], "java_doc": ["java"], "kotlin_doc": ["kt", "kts"],
}


def repo_name(path: Column) -> Column:
    """First component; a file at the root names itself."""
    return F.element_at(F.split(path, "/"), 1)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, "\\.([^./]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), "(?<=.)\\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def file_type(path: Column, head: Column | None = None) -> Column:
    """Context type by extension, else shell by shebang, else null."""
    ext = extension(path)
    out = None
    for kind, names in EXTENSIONS.items():
        out = F.when(ext.isin(names), kind) if out is None else out.when(ext.isin(names), kind)
    return out.when(is_shell_shebang(shebang(head)), "shell_doc") if head is not None else out


def context_id(path: str) -> str:
    """Normalised relative context path; the empty path is the root."""
    clean = posixpath.normpath(path.replace("\\", "/")) if path else "."
    if clean.startswith("/") or clean == ".." or clean.startswith("../"):
        raise ValueError(f"a context must be a relative path inside the index root: {path!r}")
    return clean


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a path glob. ``*`` also crosses slashes; ``**/`` may match no directory."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i) and (i == 0 or glob[i - 1] == "/"):
            end = i + 2
            if end == len(glob):
                out += ".*"
                i = end
                continue
            if glob[end] == "/":
                out += "(?:.*/)?"
                i = end + 1
                continue
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed class in {glob!r}")
            inner = glob[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{":
            depth += 1
            out += "(?:"
        elif c == "}" and depth:
            depth -= 1
            out += ")"
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"unclosed alternatives in {glob!r}")
    return f"^{out}$"


def glob_match(path: Column, glob: str) -> Column:
    return path.rlike(glob_regex(glob))
