"""Chunkers on small files of each language."""

import json

import pytest

from lumendex.operators import chunkers as c


def found(fn, source, path="a/file.x"):
    return [(i.name, i.item_type, i.visibility, i.text) for i in fn(source, path)]


def test_markdown_sections_and_hierarchy():
    src = "intro\n# A\ntext\n## B\nmore\n```\n# code\nx\n```\n# C\n## D\n#\ntail"
    got = [(i.headings, i.text) for i in c.markdown(src, "x.md")]
    assert got == [([], "intro"), (["A"], "# A\ntext"), (["A", "B"], "## B\nmore\n```"), (["code"], "# code\nx\n```"), (["C", "D"], "#\ntail")]
    assert c.markdown("", "x.md") == [] and c.markdown("# only\n## heads", "x.md") == []


RUST = '''//! Module doc.
//! More.

/// Adds "x" // not a comment
#[inline]
pub fn add<'a>(x: &'a str, y: char) -> u32 { let s = r#"/// no "quote" {"#; let c = '{'; 1 }

/// Hidden.
fn hidden() {}

/** Block doc. */
pub struct S { a: [u8; 3] }

/// In crate.
pub(crate) enum E { A }

pub mod inner {
    /// Inner const.
    pub const N: u32 = 1;
}

impl S {
    /// Method.
    pub async fn go(&self) {}
}

trait T {
    /// Not visited.
    fn t(&self);
}
'''


def test_rust():
    got = found(c.rust, RUST)
    assert got == [
        ("module", "modules", "public", " Module doc.\n More."), ("add", "functions", "public", ' Adds "x" // not a comment'), ("hidden", "functions", "private", " Hidden."),
        ("S", "structs", "public", "Block doc."), ("E", "enums", "crate", " In crate."), ("N", "constants", "public", " Inner const."), ("go", "impls", "public", " Method."),
    ]
    assert next(i for i in c.rust(RUST, "x.rs") if i.name == "add").signature == "fn add<'a>(x: &'a str, y: char) -> u32"
    with pytest.raises(c.ParseError):
        c.rust("/// d\nfn x() {", "x.rs")


GO = '''// Package geo does things.
package geo

// Point is a point.
type Point struct { X int }

// Shape is one.
type Shape interface { Area() int }

// ID is a name.
type ID string

// Far measures
// the way.
func Far(a string) int { return len("// {") }

// area is local.
func (p *Point) area() int { return 1 }

// Limit is most.
const Limit = 3

// left over

// Total counts.
var Total int
'''


def test_go():
    got = found(c.go, GO)
    assert [x[:3] for x in got] == [
        ("package", "package", "exported"), ("Point", "struct", "exported"), ("Shape", "interface", "exported"), ("ID", "type", "exported"),
        ("Far", "function", "exported"), ("area", "method", "unexported"), ("Limit", "const", "exported"), ("Total", "var", "exported"),
    ]
    assert got[4][3] == "Far measures\nthe way." and got[-1][3] == "Total counts."
    far = next(i for i in c.go(GO, "x.go") if i.name == "Far")
    assert far.package == "geo" and far.signature == 'func Far(a string) int { return len("// {") }'


C = '''/* File head. */

#ifndef X_H
#define X_H
/** Adds.
 * Two numbers.
 */
int add(int a, int b) { return a + b; }

/* A thing. */
struct thing { int a; };

// Colours
// of it.
enum colour { RED };

/* Alias. */
typedef unsigned int u32;

/* Prototype. */
int sub(int a, int b);
/* Tail. */
#endif
'''


def test_c():
    got = [(n, k, t) for n, k, _, t in found(c.c_docs, C)]
    assert got == [
        ("add", "function", "Adds.\nTwo numbers."), ("thing", "struct", "A thing."), ("colour", "enum", "Colours\nof it."), ("u32", "typedef", "Alias."),
        ("sub", "declaration", "Prototype."), (None, "standalonecomment", "File head."), (None, "standalonecomment", "Tail."),
    ]


def test_shell():
    src = "#!/bin/bash\n# Top block\n# goes on\n\necho '# no' # trailing\n# Runs it.\nrun() {\n  # inside\n  echo\n}\n# Other\nfunction other {\n:\n}\n"
    got = [(n, k, t) for n, k, _, t in found(c.shell, src)]
    assert got == [
        (None, "standalonecomment", "Top block\ngoes on"), ("run", "function", "Runs it."), (None, "standalonecomment", "inside"), ("other", "function", "Other"),
    ]


TS = '''/** Module words. */
import x from "y";

/** Adds. */
export function add(a: number) { return `/** ${a} */ {`; }

// one
// two
const local = 1;

/** K. */
@dec()
export class K {}

/** I. */
export interface I { a: string }

/** T. */
type T = string;

/** E. */
export enum E { A }
'''


def test_js_and_ts():
    got = found(c.js, TS, "src/mod.ts")
    assert [x[:3] for x in got] == [
        ("mod", "module", "exported"), ("add", "function", "exported"), ("local", "variable", "local"), ("K", "class", "exported"), ("I", "interface", "exported"), ("T", "typealias", "local"), ("E", "enum", "exported"),
    ]
    assert got[2][3] == "one\ntwo"
    assert {x[1] for x in found(c.js, TS, "src/mod.js")} == {"module", "function", "variable", "class"}


JAVA = '''package a.b;

/** Klass. */
@Deprecated
public class Klass<T> {
    /** Field. */
    private int n = 3;

    /** Makes. */
    public Klass(int n) { this.n = n; }

    /** Does
     * it.
     */
    @Override(x = "}")
    protected String doIt(List<String> a) { String s = "/** no */"; return s; }

    // plain
    void quiet() {}

    /** Kinds. */
    enum Kind { A, B }
}

/** Rec. */
record Rec(int a) {}
'''


def test_java():
    got = found(c.java, JAVA)
    assert [x[:3] for x in got] == [
        ("Klass", "class", "public"), ("n", "field", "private"), ("Klass", "constructor", "public"), ("doIt", "method", "protected"), ("Kind", "enum", "package-private"), ("Rec", "record", "package-private"),
    ]
    assert got[3][3] == "Does\nit." and c.java(JAVA, "x.java")[0].package == "a.b"


KOTLIN = '''package k

/** A class. */
data class A(val x: Int) {
    /** Prop. */
    private val p = """ { /** no */ """

    /** Fun. */
    internal fun <T> f(x: T): T { return x }
}

/** Thing. */
object Thing { }

/** Ext. */
fun String.ext(): Int = 1

/* plain */
fun plain() {}
'''


def test_kotlin():
    got = found(c.kotlin, KOTLIN)
    assert [x[:3] for x in got] == [("A", "class", "public"), ("p", "property", "private"), ("f", "function", "internal"), ("Thing", "object", "public"), ("ext", "function", "public")]


def test_filters():
    item = c.Item("one\ntwo", "x", "function", "exported")
    assert c.PUBLIC_ONLY.keeps(item) and not c.ItemFilter(("private",)).keeps(item)
    assert c.ItemFilter(items=("function",), min_doc_lines=2).keeps(item) and not c.ItemFilter(min_doc_lines=3).keeps(item)
    assert not c.ItemFilter(items=("class",)).keeps(item)
    item.always = True
    assert c.ItemFilter(items=("class",)).keeps(item)


def test_split_overlaps_and_covers():
    text = "\n".join(f"word{i} and more." for i in range(300))
    parts = c.split(text, 50, 10)
    assert all(c.count_tokens(p) <= 50 for p in parts)
    for a, b in zip(parts, parts[1:], strict=False):
        assert a.split()[-1] in b
    assert {w for p in parts for w in p.split()} == set(text.split())
    assert c.split("", 5, 1) == [] and c.split(" a b ", 5, 1) == ["a b"]


def test_chunk_files(spark):
    rows = [
        ("h1", "r", "r/a.rs", "rust_doc", 1, RUST), ("h2", "r", "r/b.md", "markdown", 1, "# T\nbody"), ("h3", "r", "r/c.rs", "rust_doc", 1, "fn x() {"),
        ("h4", "r", "r/d.md", "markdown", 1, None), ("h5", "r", "r/e.kt", "kotlin_doc", 1, ""),
    ]
    files = spark.createDataFrame(rows, "file_hash string, repo_name string, file_path string, file_type string, last_modified long, content string")
    got = c.chunk_files(files).collect()
    assert {r.file_path for r in got if r.error} == {"r/c.rs", "r/d.md"}
    assert {json.loads(r.context_data)["item-name"] for r in got if r.file_path == "r/a.rs"} == {"module", "add", "S", "N", "go"}
    assert next(json.loads(r.context_data) for r in got if r.file_path == "r/b.md") == {"heading-hierarchy": ["T"]}
    everything = c.chunk_files(files, {"rust_doc": None}).filter("error is null")
    assert everything.count() == 7
    assert c.chunk_files(files, {}).count() == 0


def test_slashes_in_regular_expressions_are_no_comments():
    from lumendex.operators import chunkers

    code, comments = chunkers.scan("const re = /[/*]/; /** B */ export class B {}\nconst x = a / b; // c\n", chunkers.Lexis(quotes="\"'", raw=("`",), regex=True))
    assert [c.text for c in comments] == ["/** B */", "// c"] and "a / b" in code


@pytest.mark.parametrize("code", ["pub fn incomplete(", "fn f() { (] }", "fn f()", "struct S", "/* open", "fn f() { x) }"])
def test_rust_that_does_not_parse(code):
    with pytest.raises(c.ParseError):
        c.rust(code, "x.rs")


def test_brackets_in_rust_literals_and_macros():
    code = "/// A.\npub fn a() { let x = '('; let y = \"]\"; let z = r#\"}\"#; b!({ [x] }); }\n/// B.\npub const B: [u8; 2] = [b'(', b'\\''];\n"
    assert [i.name for i in c.rust(code, "x.rs")] == ["a", "B"]


def test_other_languages_give_what_can_be_read():
    assert [i.name for i in c.go("package p\n\n// Far goes.\nfunc Far() {}\n}\nfunc Open() {\n", "x.go") if i.name == "Far"] == ["Far"]
    assert "Adds." in [i.text.strip() for i in c.js("/** Adds. */\nexport function add() {}\nfunction open() {\n", "x.js")]
    assert [i.text.strip() for i in c.c_docs("/* Sum. */\nint sum(int a) { return a; }\n/* open", "x.c")] == ["Sum."]


def test_pieces_end_at_blank_lines_then_line_ends():
    text = "a b c d e f\n\ng h\ni j k l m n o"
    assert c.split(text, 10, 0)[0] == "a b c d e f\n\ng h"
    assert c.split(text.replace("f\n\ng h", "f g\n\nh"), 10, 0)[0].endswith("h")
    assert c.split("a b c d e f g\n\nh\ni j k l", 9, 0)[0] == "a b c d e f g"
    assert c.split("a b c d e f", 3, 1) == ["a b c", "c d e", "e f"]
