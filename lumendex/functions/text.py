"""Hashes, comments, lines and display strings as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    """Lower-case hex SHA-256; binary and text alike."""
    return F.sha2(text, 256)


def uuid_of_hash(digest: Column) -> Column:
    """Canonical UUID text of the first 16 bytes of a hex digest."""
    return F.regexp_replace(F.substring(digest, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def line_count(text: Column) -> Column:
    """Number of lines; a final line end adds none."""
    body = F.regexp_replace(text, "\\n$", "")
    return F.when(text == "", 0).otherwise(F.size(F.split(body, "\\n", -1)))


def preview(text: Column, length: int = 100) -> Column:
    """First bytes on one line, with dots if more follow; a character that the cut would split is left out."""
    head = F.make_valid_utf8(F.substring(text.cast("binary"), 1, length).cast("string"))
    cut = F.when(F.octet_length(text) > length, F.concat(F.regexp_replace(head, "\uFFFD+$", ""), F.lit("..."))).otherwise(text)
    return F.translate(cut, "\n", " ")


def score_bucket(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "good").when(score >= 0.4, "fair").otherwise("low")


def shebang(head: Column) -> Column:
    """The first line if it is a shebang, else empty."""
    return F.regexp_extract(F.substring(head, 1, 256), "\\A(#![^\\n]*)", 1)


def is_shell_shebang(line: Column) -> Column:
    return line.contains("bash") | line.contains("/sh") | line.contains("zsh")


def sentences(text: Column) -> Column:
    """Sentences of prose lines; blank lines, headings, lists, quotes, tables, rules and code fences stay whole.
    A marker counts at the very start of a line only."""
    def keep(line: Column) -> Column:
        return F.when(line.rlike("^(\\s*$|#|```|- |\\* |[0-9]+\\.|\\||---|>)"), F.array(line)).otherwise(F.split(line, "(?<=[.!?])\\s+(?=[A-Z])"))

    return F.flatten(F.transform(F.split(text, "\n", -1), keep))


def html_blocks(html: Column, tags: tuple[str, ...] = ("h1", "p", "li")) -> Column:
    """(tag, content) of the blocks of a page in order: the text that follows an opening tag, up to the next tag after it."""
    blocks = F.regexp_extract_all(html, F.lit(f"<(?:{'|'.join(tags)})>(?:<[a-z][^>]*>)*[^<]+"), F.lit(0))
    return F.transform(blocks, lambda x: F.struct(F.regexp_extract(x, "^<([a-z0-9]+)>", 1).alias("tag"), F.trim(F.regexp_replace(x, "<[^>]*>", "")).alias("content")))
