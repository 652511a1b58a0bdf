"""What is shown to people: paths, sizes, ages, padded cells; and what they answer."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of each unit of an age, the largest first.
UNITS = (("year", 31_557_600), ("month", 2_630_016), ("week", 604_800), ("day", 86_400), ("hour", 3_600), ("minute", 60), ("second", 1))
DIGEST_SHOWN, SIZE_WIDTH, TIME_WIDTH = 19, 8, 22
FORMATS = ("human", "json")


def display_path(path: Column, root: str, cwd: str) -> Column:
    """A path of the index as seen from a directory."""
    root, cwd = os.path.abspath(root), os.path.abspath(cwd)
    inside = os.path.relpath(cwd, root)
    if inside == ".":
        return path
    if inside.split("/")[0] == "..":  # the directory is not below the root: all paths lead through it
        return F.concat(F.lit(os.path.relpath(root, cwd) + "/"), path)
    parts = inside.split("/")
    shared = sum((F.when(path.startswith("/".join(parts[: k + 1]) + "/"), 1).otherwise(0) for k in range(len(parts))), F.lit(0))
    below = F.array_join(F.slice(F.split(path, "/"), shared + 1, F.size(F.split(path, "/"))), "/")
    return F.concat(F.repeat(F.lit("../"), F.lit(len(parts)) - shared), below)


def time_ago(seconds: Column) -> Column:
    """An age in its largest whole unit: "1 hour ago", "3 weeks ago"; below a second, "now"."""
    out = None
    for name, size in UNITS:
        n = F.floor(seconds / size)
        words = F.concat(n.cast("string"), F.when(n == 1, f" {name} ago").otherwise(f" {name}s ago"))
        out = F.when(seconds >= size, words) if out is None else out.when(seconds >= size, words)
    return out.otherwise(F.when(seconds.isNotNull(), "now"))


def megabytes(size: Column, digits: int = 1, unit: str = "MB") -> Column:
    return F.concat(F.call_function("format_number", size / F.lit(1e6), F.lit("0." + "0" * digits)), F.lit(unit))  # a pattern: no thousands separators


def padded(text: Column, width: Column | int, left: bool = False) -> Column:
    """Blanks up to a width, before the text or after it; what is wider stays whole."""
    blanks = F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(text) if isinstance(width, int) else width - F.length(text), F.lit(0)))
    return F.concat(blanks, text) if left else F.concat(text, blanks)


def image_line(tag: Column, size: Column, age: Column, digest: Column, tag_width: Column) -> Column:
    """One line of an image: tag, size, when it was pushed (blank if unknown) and the head of its digest."""
    pushed = F.coalesce(F.concat(F.lit("Pushed "), time_ago(age)), F.lit(""))
    cells = [padded(F.concat(F.lit(":"), tag), tag_width + 1), padded(megabytes(size), SIZE_WIDTH, left=True), padded(pushed, TIME_WIDTH, left=True)]
    return F.concat_ws(" ", *cells, F.substring(digest, 1, DIGEST_SHOWN))


def derived_port(name: Column, low: int = 5001, span: int = 1999) -> Column:
    """A port in [low, low + span) that a name always gets, from the first 32 bits of its SHA-256."""
    return F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long") % span + low


def confirmed(answer: str) -> bool:
    return answer.strip().lower() in ("y", "yes")


def output_format(name: str | None) -> str:
    """The format asked for; plain text if none is."""
    if name is None:
        return FORMATS[0]
    if name not in FORMATS:
        raise ValueError(f"no output format {name!r}; there are {', '.join(FORMATS)}")
    return name
