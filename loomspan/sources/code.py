"""Code and documents to graph parts: symbols, imports, calls, rationales, headings; cross-file resolution.

Python is parsed with the standard library's syntax trees; other languages go by
declaration patterns, which miss nested and unusual forms.
"""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.schemas import lookup

# Tags of rationale comments, and those that count without a colon where a language has no parser here.
TAGS, PLAIN_TAGS = ("WHY", "NOTE", "IMPORTANT", "RATIONALE", "HACK", "FIXME", "TODO", "XXX"), ("WHY", "NOTE", "IMPORTANT", "RATIONALE")
_COMMENT = re.compile(r"(?:#|//|--|/\*|^\s*\*|<!--)(.*)")
_PLAIN = re.compile(rf"(?://|#|/\*)\s*({'|'.join(PLAIN_TAGS)})\s*:?\s*(.+)$")
# Declarations by language family.
_C = r"^\s*(?:[\w:<>*&~\[\]]+\s+)+[*&]*(?P<name>\w+)\s*\([^;{]*\)\s*(?:const\s*)?\{"
SYMBOLS = {
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?|class|interface|enum|type)\s+(?P<name>\w+)|^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name2>\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>",
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(?:fn|struct|enum|trait|mod|type|macro_rules!)\s+(?P<name>\w+)",
    "go": r"^(?:func\s+(?:\([^)]*\)\s*)?|type\s+)(?P<name>\w+)", "ruby": r"^\s*(?:def|class|module)\s+(?:self\.)?(?P<name>[\w?!]+)",
    "php": r"^\s*(?:abstract\s+|final\s+|public\s+|private\s+|protected\s+|static\s+)*(?:function|class|interface|trait)\s+(?P<name>\w+)",
    "kotlin": r"^\s*(?:\w+\s+)*(?:fun|class|interface|object)\s+(?:\w+\.)?(?P<name>\w+)", "scala": r"^\s*(?:\w+\s+)*(?:def|class|trait|object)\s+(?P<name>\w+)",
    "swift": r"^\s*(?:\w+\s+)*(?:func|class|struct|enum|protocol)\s+(?P<name>\w+)", "lua": r"^\s*(?:local\s+)?function\s+(?:[\w.]+[.:])?(?P<name>\w+)",
    "julia": r"^\s*(?:function|struct|mutable struct|module|macro)\s+(?P<name>\w+)", "elixir": r"^\s*(?:def|defp|defmodule|defmacro)\s+(?P<name>[\w.?!]+)",
    "bash": r"^\s*(?:function\s+)?(?P<name>\w+)\s*\(\)\s*\{", "zig": r"^\s*(?:pub\s+)?fn\s+(?P<name>\w+)", "haskell": r"^(?P<name>[a-z]\w*)\s*::",
    "java": r"^\s*(?:public|private|protected|static|final|abstract|\s)*(?:class|interface|enum|record)\s+(?P<name>\w+)|^\s*(?:public|private|protected|static|final|\s)+[\w<>\[\], ]+\s+(?P<name2>\w+)\s*\([^;]*\)\s*(?:throws [\w, ]+)?\{",
    "c": _C, "cpp": _C + r"|^\s*(?:class|struct|namespace)\s+(?P<name2>\w+)", "csharp": r"^\s*(?:\w+\s+)*(?:class|interface|struct|enum|record)\s+(?P<name>\w+)",
}
SYMBOLS |= {"typescript": SYMBOLS["javascript"], "tsx": SYMBOLS["javascript"]}
IMPORTS = re.compile(
    r"""^\s*(?:import\s+(?:[\w*{},\s$]+\s+from\s+)?["'](?P<a>[^"']+)["']|(?:const|let|var)\s+[\w{},\s]+=\s*require\(["'](?P<b>[^"']+)["']\)|#include\s*[<"](?P<c>[^>"]+)[>"]|use\s+(?P<d>[\w:\\]+)|import\s+(?:static\s+)?(?P<e>[\w.*]+)|require(?:_relative)?\s*\(?["'](?P<f>[^"']+)["']|using\s+(?P<g>[\w.]+)\s*;|alias\s+(?P<h>[\w.]+))""",
    re.M,
)
CALL = re.compile(r"(?<![\w.])([A-Za-z_]\w*)\s*\(")
_NOT_CALLS = frozenset("if for while switch return catch function def fn func class sizeof match elif with assert print not and or in".split())


def parse(language: str | None, text: str) -> list[tuple]:
    """Parts of a file: (part, name, kind, line, owner, detail)."""
    if language == "python":
        try:
            return _python(text) + _rationales(language, text)
        except (SyntaxError, ValueError, RecursionError):
            pass
    return _by_pattern(language, text) + _rationales(language, text)


def _rationales(language: str | None, text: str) -> list[tuple]:
    """What follows a tag and its colon in a comment, for each tag; without a language what follows one of four tags."""
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        if language is None:
            if (m := _PLAIN.search(line)) and m[2].strip():
                out.append(("rationale", m[2].strip(), m[1], n, None, None))
        elif m := _COMMENT.search(line):
            for tag in TAGS:
                if f"{tag}:" in m[1]:
                    body = m[1].split(f"{tag}:", 1)[1].strip().removesuffix("*/").removesuffix("-->").strip()
                    if body:
                        out.append(("rationale", body, tag, n, None, None))
    return out


def _python(text: str) -> list[tuple]:
    out: list[tuple] = []
    stack: list[tuple[ast.AST, str | None]] = [(ast.parse(text), None)]
    while stack:
        node, owner = stack.pop()
        for child in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if owner and isinstance(node, ast.ClassDef) else "function"
                out.append(("symbol", child.name, kind, child.lineno, owner, (ast.get_docstring(child) or "").split("\n")[0][:200] or None))
                inner = f"{owner}.{child.name}" if owner else child.name
                if kind != "class":
                    if child.returns is not None:
                        out.append(("returns", ast.unparse(child.returns)[:100], "type", child.lineno, inner, None))
                    out += [("param", ast.unparse(a.annotation)[:100], "type", a.lineno, inner, a.arg) for a in child.args.args if a.annotation is not None]
            elif isinstance(child, ast.Import):
                out += [("import", a.name, "module", child.lineno, owner, None) for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                out.append(("import", "." * child.level + (child.module or ""), "module", child.lineno, owner, ",".join(a.name for a in child.names)))
            elif isinstance(child, ast.Call):
                name = child.func.id if isinstance(child.func, ast.Name) else child.func.attr if isinstance(child.func, ast.Attribute) else None
                if name:
                    out.append(("call", name, "call", child.lineno, owner, None))
            stack.append((child, inner))
    return list(dict.fromkeys(out))


def _by_pattern(language: str | None, text: str) -> list[tuple]:
    out: list[tuple] = []
    for m in IMPORTS.finditer(text):
        out.append(("import", next(g for g in m.groups() if g), "module", text.count("\n", 0, m.start()) + 1, None, None))
    pattern = SYMBOLS.get(language or "")
    if not pattern:
        return out
    find = re.compile(pattern)
    owner, doc = None, None
    for n, line in enumerate(text.split("\n"), 1):
        if m := find.search(line):
            owner = next((g for g in m.groupdict().values() if g), None)
            kind = "type" if re.search(r"\b(class|struct|enum|trait|interface|type|module|namespace|protocol|object|record|defmodule)\b", line) else "function"
            out.append(("symbol", owner, kind, n, None, doc))
        else:
            for name in dict.fromkeys(CALL.findall(line)):
                if name not in _NOT_CALLS:
                    out.append(("call", name, "call", n, owner, None))
        comment = re.match(r"\s*(?:///?|#|--|\*)\s?(.*)", line)
        doc = comment[1][:200] if comment else None
    return out


_PART = "path string, part string, name string, kind string, line int, owner string, detail string"


def parts_of(files: DataFrame) -> DataFrame:
    """Parts of code files (path, language, text), a file at a time."""

    def run(batches):
        for batch in batches:
            rows = [(p, *x) for p, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) for x in parse(lang, text or "")]
            kinds = [pa.string()] * 4 + [pa.int32(), pa.string(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in _PART.split(", ")])

    return files.select("path", "language", "text").mapInArrow(run, _PART)


def headings(docs: DataFrame, key: str = "path") -> DataFrame:
    """key, line, level, title, kind of markdown headings: decision, task, rationale or section."""
    lines = docs.select(key, F.posexplode(F.split("text", "\n")).alias("pos", "l"))
    found = lines.where(F.col("l").rlike("^#{1,6} +\\S")).select(key, (F.col("pos") + 1).alias("line"), F.length(F.regexp_extract("l", "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("l", "^#+|#+$", "")).alias("title"))
    return found.withColumn("kind", heading_kind(F.col("title")))


def heading_kind(title: Column) -> Column:
    low = F.lower(title)
    return F.when(low.rlike("decision"), "decision").when(low.rlike("task|todo"), "task").when(low.rlike("why|rationale"), "rationale").otherwise("section")


def path_mentions(docs: DataFrame, known: DataFrame, key: str = "path") -> DataFrame:
    """key, target: known paths that a text names, by an equi-join of its path-like tokens."""
    words = docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9_./-]+\.[A-Za-z0-9]+)"), F.lit(1)))).alias("target"))
    return words.join(known.select(F.col("path").alias("target")), "target", "left_semi").where(F.col(key) != F.col("target"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """path, name, target: the first of an import's candidate paths that is a file.

    Relative names go from the file's folder, dotted ones are folders; ten
    suffixes are tried in order, then those of Python and Rust.
    """
    suffixes = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", ".py", ".rs", "/__init__.py")
    from loomspan.functions.text import normal_path

    folder = F.regexp_replace("path", "[^/]*$", "")
    dots = F.length(F.regexp_extract("name", r"^(\.+)[A-Za-z_]", 1))
    up = F.expr("repeat('../', greatest(0, _dots - 1))")
    plain = F.when(F.col("name").rlike("^\\.\\.?/"), F.concat(folder, "name")).when(F.col("_dots") > 0, F.concat(folder, up, F.translate(F.ltrim(F.col("name"), F.lit(".")), ".", "/"))).otherwise(F.translate(F.replace("name", F.lit("::"), F.lit("/")), ".", "/"))
    tried = imports.withColumn("_dots", dots).withColumn("_base", normal_path(plain)).select("path", "name", F.posexplode(F.array(*[F.concat("_base", F.lit(s)) for s in suffixes])).alias("_pos", "target"))
    found = tried.join(files.select(F.col("path").alias("target")), "target", "left_semi")
    return found.groupBy("path", "name").agg(F.min_by("target", "_pos").alias("target"))


# Weights of calls by how they were resolved.
CALL_WEIGHTS = {"resolved": 0.9, "inferred": 0.5, "ambiguous": 0.3}


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """path, owner, name, target, evidence: calls to symbols by bare name, in four tiers.

    A name with one symbol in the repository is resolved; else one symbol among
    the imported files resolves it; else one in the caller's folder is
    inferred; else the symbol of the least path is ambiguous. Symbols that
    nothing defines give no row. Each tier is an equi-join on its own counts, so
    a call meets no list of symbols.
    """
    own = [F.col("owner") if "owner" in symbols.columns else F.lit(None).cast("string").alias("owner")]
    table = symbols.select(F.col("path").alias("target"), F.element_at(F.split("name", r"\."), -1).alias("name"), *own).distinct()
    folder = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    asked = calls.select("path", "owner", "name").distinct()
    every = table.groupBy("name").agg(F.count("*").alias("_n"), F.min("target").alias("_first"))
    near = imports.select("path", "target").distinct().join(table, "target").groupBy("path", "name").agg(F.count("*").alias("_i"), F.min("target").alias("_imported"))
    beside = table.withColumn("_d", folder(F.col("target"))).groupBy("_d", "name").agg(F.count("*").alias("_b"), F.min("target").alias("_beside"))
    rows = asked.join(every, "name").join(near, ["path", "name"], "left").withColumn("_d", folder(F.col("path"))).join(beside, ["_d", "name"], "left")
    one, imported, close = F.col("_n") == 1, F.coalesce(F.col("_i") == 1, F.lit(False)), F.coalesce(F.col("_b") == 1, F.lit(False))
    target = F.when(one, F.col("_first")).when(imported, F.col("_imported")).when(close, F.col("_beside")).otherwise(F.col("_first"))
    evidence = F.when(one | imported, "resolved").when(close, "inferred").otherwise("ambiguous")
    return rows.select("path", "owner", "name", target.alias("target"), evidence.alias("evidence"))


def code_graph(files: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of code files and their parts, with source_file."""
    file = lambda c: F.concat(F.lit("file:"), c)
    symbol = lambda p, n: F.concat(F.lit("symbol:"), p, F.lit("#"), n)
    own = F.concat_ws(".", "owner", "name")
    s, r = parts.where("part = 'symbol'"), parts.where("part = 'rationale'")
    row = lambda df, i, label, kind: df.select(i.alias("id"), label.alias("label"), F.lit(kind).alias("node_type"), F.lit("repository").alias("source_type"), F.col("path").alias("source_id"), F.col("path").alias("source_file"))
    why = F.concat(F.lit("rationale:"), "path", F.lit("#"), F.col("line").cast("string"))
    imports, types = parts.where("part = 'import'"), parts.where("part in ('returns', 'param')")
    nodes = (
        row(files, file(F.col("path")), F.element_at(F.split("path", "/"), -1), "file").union(row(s, symbol(F.col("path"), own), F.col("name"), "symbol"))
        .union(row(r, why, F.col("name"), "rationale")).union(row(imports, F.concat(F.lit("module:"), "name"), F.col("name"), "module"))
        .union(row(types, F.concat(F.lit("type:"), "name"), F.col("name"), "type"))
    )
    weight = lambda ev: F.lit(1.0) if isinstance(ev, str) else lookup(ev, CALL_WEIGHTS, 1.0)
    edge = lambda df, a, b, rel, ev="extracted": df.select(a.alias("source"), b.alias("target"), (F.lit(rel) if isinstance(rel, str) else rel).alias("relation"), (F.lit(ev) if isinstance(ev, str) else ev).alias("evidence"), weight(ev).alias("weight"), F.col("path").alias("source_file"))
    found = resolve_imports(imports, files)
    calls = resolve_calls(parts.where("part = 'call'"), s, found)
    caller = F.when(F.col("owner").isNull(), file(F.col("path"))).otherwise(symbol(F.col("path"), F.col("owner")))
    edges = (
        edge(s, file(F.col("path")), symbol(F.col("path"), own), "defines").union(edge(s.where("owner is not null"), symbol(F.col("path"), F.col("owner")), symbol(F.col("path"), own), "contains"))
        .union(edge(imports, file(F.col("path")), F.concat(F.lit("module:"), "name"), "imports")).union(edge(found, file(F.col("path")), file(F.col("target")), "imports"))
        .union(edge(types, symbol(F.col("path"), F.col("owner")), F.concat(F.lit("type:"), "name"), F.col("part"))).union(edge(r, why, file(F.col("path")), "explains"))
        .union(edge(calls, caller, symbol(F.col("target"), F.col("name")), "calls", F.col("evidence")))
    )
    return nodes.dropDuplicates(["id"]), edges.distinct()
