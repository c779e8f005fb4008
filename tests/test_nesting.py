"""Blocks, declarations and owners against a stack, and on Rust and TypeScript."""

import random

from loomspan.operators import nesting

RUST = '''//! crate { not a block
/// A point; with braces }
#[derive(Debug)]
pub struct Point<'a> { x: &'a str, c: char }

impl<'a> Shape for Point<'a> {
    /// Draws {it}.
    fn draw(&self, f: impl Fn() -> u8) -> String {
        let s = "}} \\" {"; let c = '{';
        if s.len() > 1 { fn inner() {} }
        s.to_string()
    }
}
mod deep { pub struct Unit; pub fn last() {} }
'''
SCRIPT = '''/** The service.
 * It serves. */
export class Service extends Base {
  private async load(id: string): Promise<void> {
    for (const x of [1]) { const go = (a) => { return '}' ; }; }
  }
}
export function top() { return `${1} }`; }
interface Shape { area(): number; }
'''


def test_rust(spark):
    rows = nesting.declarations(spark.createDataFrame([("a.rs", RUST), ("empty", ""), ("null", None)], "path string, text string")).orderBy("at").collect()
    assert [(r.path, r.line, r.kind, r.name, r.owner, r.depth) for r in rows] == [
        ("a.rs", 4, "struct", "Point", None, 1), ("a.rs", 6, "impl", "Point", None, 1), ("a.rs", 8, "fn", "draw", "Point", 2), ("a.rs", 10, "fn", "inner", "draw", 3),
        ("a.rs", 14, "mod", "deep", None, 1), ("a.rs", 14, "struct", "Unit", "deep", 2), ("a.rs", 14, "fn", "last", "deep", 2),
    ]
    assert {r.name: r.doc for r in rows if r.doc} == {"Point": "A point; with braces }", "draw": "Draws {it}."}


def test_script(spark):
    rows = nesting.declarations(spark.createDataFrame([("a.ts", SCRIPT)], "path string, text string"), kind="script").orderBy("at").collect()
    assert [(r.kind, r.name, r.owner) for r in rows] == [("class", "Service", None), ("method", "load", "Service"), ("function", "go", "load"), ("function", "top", None), ("interface", "Shape", None)]
    assert rows[0].doc.startswith("The service.")


def test_signatures(spark):
    rust = spark.createDataFrame([("a", RUST + "pub fn wide<T>(a: T, b: (u8, u8)) -> Result<(), E> where T: Copy {}\nfn none();")], "path string, text string")
    got = {r.name: (r.params, r.returns) for r in nesting.declarations(rust).where("kind = 'fn'").collect()}
    assert got == {"draw": ("&self, f: impl Fn() -> u8", "String"), "inner": (None, None), "last": (None, None), "wide": ("a: T, b: (u8, u8)", "Result<(), E>"), "none": (None, None)}
    script = {r.name: (r.params, r.returns) for r in nesting.declarations(spark.createDataFrame([("a", SCRIPT)], "path string, text string"), kind="script").collect()}
    assert script["load"] == ("id: string", "Promise<void>") and script["go"] == ("a", None) and script["top"] == (None, None)


def test_calls(spark):
    text = 'fn a() {\n  b(1); b(2);\n  // c()\n  let s = "d()";\n  if (x) { y.e::<T>( ) }\n}\nfn f(x: impl Fn()) { g(\n h()); }\nb();'
    rows = nesting.calls(spark.createDataFrame([("a", text), ("n", None)], "path string, text string")).collect()
    assert sorted((r.line, r.name, r.owner) for r in rows) == sorted([(2, "b", "a"), (5, "e", "a"), (7, "g", "f"), (8, "h", "f"), (9, "b", None)], key=lambda r: r[:2])


def test_imports(spark):
    rust = spark.createDataFrame([("a", "use std::io;\npub use a::{b, c::d};\n  use x as\n y;\n// nothing\n"), ("n", None)], "path string, text string")
    assert sorted(r.module for r in nesting.imports(rust).collect()) == ["a::b", "a::c::d", "std::io", "x as y"]
    script = spark.createDataFrame([("a", "import {\n a,\n b } from './x';\nimport \"side\";\nexport * from 'y';\nconst z = require('z'), w = await import('w');")], "path string, text string")
    assert sorted(r.module for r in nesting.imports(script, kind="script").collect()) == ["./x", "side", "w", "y", "z"]


def test_owners_are_those_of_a_stack(spark):
    rng = random.Random(5)
    tokens, want = [], {}
    for i in range(60):
        stack = []
        for at in range(rng.choice([0, 1, 5, 60])):
            step = rng.choice([1, 1, -1, -1, 0])
            name = f"n{at}" if step >= 0 and rng.random() < 0.5 else None
            tokens.append((i, at, step, name))
            if name:
                want[i, at] = next((n for n in reversed(stack) if n), None), 1 + sum(n is not None for n in stack)
            if step == 1:
                stack.append(name)
            elif step == -1 and stack:
                stack.pop()
    df = spark.createDataFrame(tokens, "id int, at int, step int, name string")
    assert {(r.id, r.at): (r.owner, r.depth) for r in nesting.owners(df, "id").collect()} == want
    assert nesting.owners(df.limit(0), "id").collect() == []
