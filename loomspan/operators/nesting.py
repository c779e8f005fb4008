"""What stands in what: blocks of code and tags by running sums, declarations with their owners and doc comments, without a parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STRINGS = r'"(?:\\[\s\S]|[^"\\])*+"|`(?:\\[\s\S]|[^`\\])*+`'
# A quote of Rust may begin a lifetime, so there only a single character is quoted.
_TOKENS = {
    "rust": rf"//[^\n]*|/\*[\s\S]*?\*/|{_STRINGS}|'(?:\\[^\n']+|[^'\\\n])'|[{{}};]|[^{{}};\"'`/]++|[\s\S]",
    "script": rf"//[^\n]*|/\*[\s\S]*?\*/|{_STRINGS}|'(?:\\[^\n]|[^'\\\n])*+'|[{{}};]|[^{{}};\"'`/]++|[\s\S]",
}
_NAMED = r"\b(fn|struct|enum|trait|mod|union|class|interface|function|namespace)\b\s*\*?\s*([A-Za-z_$][\w$]*)"
_IMPL = r"\bimpl\b(?:\s*<[^>]*>)?\s+(?:[\w:<>,'&\s]+\s+for\s+)?([\w:]+)"
_ARROW = r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)[^=;]*=\s*(?:async\s*)?(?:\([^;]*\)|[\w$]+)\s*(?::[^={}]+)?=>\s*$"
_METHOD = r"^\s*(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*([A-Za-z_$#][\w$]*)\s*(?:<[^>]*>)?\([\s\S]*\)\s*(?::[^;{}]+)?$"
_NOT_METHODS = ("if", "for", "while", "switch", "catch", "function", "return", "with", "match", "loop")


def owners(tokens: DataFrame, id_: str, at: str = "at", step: str = "step", name: str = "name") -> DataFrame:
    """id_, at, name, owner, owner_at, depth of the declarations among tokens: the owner is the innermost declared block around it.

    tokens: ``at`` orders those of an id; ``step`` is 1 where a block opens, -1
    where one closes, 0 elsewhere; ``name`` is null but for declarations. Depth
    changes by one at a time, so what closes at a level is the last that opened
    there. So the first sums tell for each end whether its block was declared,
    the second, over declared blocks alone, the depth of declarations, and the
    owner is the last that opened one level above: windows over an id's tokens
    and levels, and nothing for each level that a token is in. Ends without a
    beginning close nothing; what is never closed stays open to the end. Null
    ids are one id; a declaration at the top has a null owner and depth 1.
    """
    t = tokens.select(F.col(id_).alias("_id"), F.col(at).alias("_at"), F.col(step).alias("_step"), F.col(name).alias("_name"))
    along = Window.partitionBy("_id").orderBy("_at")
    t = t.withColumn("_depth", F.sum("_step").over(along))
    t = t.withColumn("_level", F.when(F.col("_step") == -1, F.col("_depth") + 1).otherwise(F.col("_depth")))
    declared = F.last(F.when(F.col("_step") == 1, F.col("_name").isNotNull()), ignorenulls=True).over(Window.partitionBy("_id", "_level").orderBy("_at"))
    own = F.when((F.col("_step") == 1) & F.col("_name").isNotNull(), 1).when((F.col("_step") == -1) & declared, -1).otherwise(0)
    t = t.withColumn("_own", own).withColumn("_nest", F.sum("_own").over(along)).where("_name is not null")
    t = t.withColumn("_nest", F.col("_nest") + F.when(F.col("_step") == 1, 0).otherwise(1))
    opens = F.struct(F.col("_nest").alias("level"), F.when(F.col("_step") == 1, F.struct("_at", "_name")).alias("opened"))
    asks = F.struct((F.col("_nest") - 1).alias("level"), F.lit(None).alias("opened"))
    both = t.select("_id", "_at", "_name", "_nest", F.explode(F.array(opens, asks)).alias("_e"))
    last = F.last("_e.opened", ignorenulls=True).over(Window.partitionBy("_id", "_e.level").orderBy("_at"))
    found = both.withColumn("_by", last).where(F.col("_e.level") == F.col("_nest") - 1)
    return found.select(F.col("_id").alias(id_), F.col("_at").alias("at"), F.col("_name").alias("name"), F.col("_by._name").alias("owner"), F.col("_by._at").alias("owner_at"), F.col("_nest").alias("depth"))


def tag_tokens(pages: DataFrame, id_: str, html: str, tags: tuple[str, ...], declared: tuple[str, ...]) -> DataFrame:
    """id_, at, step, name of the given tags of whole texts; tags in ``declared`` are declarations. Tags that may stay open must not be given."""
    each = pages.select(id_, F.posexplode(F.regexp_extract_all(html, F.lit(rf"(?i)</?(?:{'|'.join(tags)})\b[^>]*>"), F.lit(0))).alias("at", "_tag"))
    bare = F.lower(F.regexp_extract("_tag", r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    ends = F.col("_tag").startswith("</")
    return each.select(id_, "at", F.when(ends, -1).otherwise(1).alias("step"), F.when(~ends & bare.isin(*declared), bare).alias("name"))


def _first(header: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(header, pattern, group), F.lit(""))


def _pieces(files: DataFrame, id_: str, text: str, kind: str) -> DataFrame:
    """Comments, strings, braces, semicolons and what is between, with the number of the statement and of the lines before."""
    before = Window.partitionBy("_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    pieces = files.select(F.col(id_).alias("_id"), F.posexplode(F.regexp_extract_all(text, F.lit(_TOKENS[kind]), F.lit(0))).alias("_p", "_t"))
    lines = F.length("_t") - F.length(F.replace("_t", F.lit("\n")))
    return pieces.withColumns({"_at": F.coalesce(F.count_if(_ends("_t")).over(before), F.lit(0)), "_lines": F.coalesce(F.sum(lines).over(before), F.lit(0)).cast("int")})


def _ends(t: str) -> Column:
    return F.col(t).isin("{", "}", ";")


def _statements(pieces: DataFrame, kind: str) -> DataFrame:
    """_id, _at, line, step, _what (kind and name of a declaration, else null), _head, doc: one row a brace or semicolon."""
    grouped = pieces.groupBy("_id", "_at").agg(F.array_sort(F.collect_list(F.struct("_p", "_t"))).alias("_x"), F.max(F.when(_ends("_t"), F.col("_t"))).alias("_end"), F.max("_lines").alias("_lines"))
    comment = lambda x: x["_t"].startswith("//") | x["_t"].startswith("/*")
    doc = lambda x: x["_t"].startswith("///") | x["_t"].startswith("/**")
    said = lambda x: F.trim(F.regexp_replace(x["_t"], r"^(?:///|/\*\*)|\*/$|(?<=\n)[ \t]*\*(?!/)", ""))
    texts = grouped.select(
        "_id", "_at", "_end", (F.col("_lines") + 1).alias("line"),
        F.array_join(F.transform(F.filter("_x", lambda x: ~comment(x) & ~x["_t"].isin("{", "}", ";")), lambda x: x["_t"]), "").alias("_head"),
        F.nullif(F.array_join(F.transform(F.filter("_x", doc), said), "\n"), F.lit("")).alias("doc"),
    ).where("_end is not null")
    head, opens = F.col("_head"), F.col("_end") == "{"
    impl = _first(head, _IMPL, 1) if kind == "rust" else F.lit(None).cast("string")
    arrow, method = (_first(head, p, 1) if kind == "script" else F.lit(None).cast("string") for p in (_ARROW, _METHOD))
    method = F.when(opens & ~method.isin(*_NOT_METHODS), method)
    named = F.regexp_extract(head, _NAMED, 2)
    # An implementation before any other word: `fn f(x: impl T)` declares a function.
    is_impl = opens & impl.isNotNull() & head.rlike(r"^(?:\s|#\[[^\]]*\]|unsafe\b|default\b)*impl\b")
    what = (
        F.when(is_impl, F.struct(F.lit("impl").alias("kind"), impl.alias("name")))
        .when(named != "", F.struct(F.regexp_extract(head, _NAMED, 1).alias("kind"), named.alias("name")))
        .when(opens & arrow.isNotNull(), F.struct(F.lit("function").alias("kind"), arrow.alias("name")))
        .when(method.isNotNull(), F.struct(F.lit("method").alias("kind"), method.alias("name")))
    )
    t = texts.withColumn("_what", what).withColumn("step", F.when(opens, 1).when(F.col("_end") == "}", -1).otherwise(0))
    # The end of a block is no declaration, whatever stands before it.
    return t.withColumn("_what", F.when(F.col("step") >= 0, F.col("_what")))


def declarations(files: DataFrame, id_: str = "path", text: str = "text", kind: str = "rust") -> DataFrame:
    """Declarations of files in languages of braces: id_, at, line, kind, name, owner, depth, doc, params, returns.

    kind: ``rust``, or ``script`` for TypeScript, JavaScript and their like. A
    text is cut into comments, strings, braces, semicolons and what is between;
    what stands before a brace or semicolon is its header, which names what it
    declares: functions, types, modules, implementations by their type, classes,
    methods (of a declared block) and arrow functions. ``line`` is that of the
    header's end, ``doc`` the doc comments in the header, ``owner`` the innermost
    declared block around, ``params`` and ``returns`` a function's, as written.
    Null texts declare nothing. No parser: macros and regular expressions with
    braces may shift the nesting of their file.
    """
    t = _statements(_pieces(files, id_, text, kind), kind)
    placed = owners(t.select("_id", F.col("_at").alias("at"), "step", F.col("_what.name").alias("name")), "_id")
    # Parentheses within parameters and types: one level.
    signature = rf"\(((?:[^()]++|\([^()]*+\))*+)\)\s*(?:(?:{'->' if kind == 'rust' else ':'})\s*((?:[^()=]++|\([^()]*+\)|=(?!>\s*$))++))?(?:=>)?\s*$"
    bare = F.trim(F.regexp_replace("_head", r"\s+where\b[\s\S]*$", "") if kind == "rust" else F.col("_head"))
    function = F.col("_what.kind").isin("fn", "function", "method")
    shown = lambda g: F.when(function, F.nullif(F.trim(F.regexp_replace(F.regexp_extract(bare, signature, g), r"\s+", " ")), F.lit("")))
    out = t.select("_id", F.col("_at").alias("at"), "line", F.col("_what.kind").alias("kind"), "doc", shown(1).alias("params"), shown(2).alias("returns")).join(placed, ["_id", "at"])
    kept = out.where((F.col("kind") != "method") | F.col("owner").isNotNull())
    return kept.select(F.col("_id").alias(id_), "at", "line", "kind", "name", "owner", "depth", "doc", "params", "returns")


def calls(files: DataFrame, id_: str = "path", text: str = "text", kind: str = "rust") -> DataFrame:
    """id_, line, name, owner: what is called on a line, once, and the innermost declared block around.

    A call is a name before an opening parenthesis outside of comments, strings
    and headers of declarations; key words are none.
    """
    pieces = _pieces(files, id_, text, kind)
    t = _statements(pieces, kind)
    code = pieces.where(~F.col("_t").rlike("^(?://|/\\*|[\"'`{};])")).select("_id", "_at", "_p", F.posexplode(F.split("_t", "\n")).alias("_k", "_line"), "_lines")
    names = F.filter(F.array_distinct(F.regexp_extract_all("_line", F.lit(r"([A-Za-z_$][\w$]*)\s*(?:::<[^>]*>)?\("), F.lit(1))), lambda n: ~n.isin(*_NOT_METHODS))
    found = code.select("_id", "_at", F.struct(F.col("_at").alias("at"), F.lit(0).alias("end"), "_p", "_k").alias("at"), (F.col("_lines") + F.col("_k") + 1).alias("line"), F.explode(names).alias("name"))
    found = found.join(t.where("_what is not null").select("_id", "_at"), ["_id", "_at"], "left_anti")
    said = lambda name, line, call: F.struct(name.alias("name"), line.alias("line"), F.lit(call).alias("call"))
    # Calls stand before the brace or semicolon that ends their statement.
    last = F.struct(F.col("_at").alias("at"), F.lit(1).alias("end"), F.lit(0).alias("_p"), F.lit(0).alias("_k"))
    blocks = t.select("_id", last.alias("at"), "step", F.when(F.col("_what").isNotNull(), said(F.col("_what.name"), F.col("line"), False)).alias("name"))
    placed = owners(blocks.unionByName(found.select("_id", "at", F.lit(0).alias("step"), said(F.col("name"), F.col("line"), True).alias("name"))), "_id").where("name.call")
    return placed.groupBy(F.col("_id").alias(id_), F.col("name.line").alias("line"), F.col("name.name").alias("name")).agg(F.min_by("owner.name", "at").alias("owner"))


def imports(files: DataFrame, id_: str = "path", text: str = "text", kind: str = "rust") -> DataFrame:
    """id_, module: the distinct modules that files import; Rust's groups in braces of one level are a module each."""
    if kind == "script":
        patterns = (r"(?m)^\s*(?:import|export)\b[^;'\"]*?\bfrom\s*['\"]([^'\"\n]+)['\"]", r"(?m)^\s*import\s*['\"]([^'\"\n]+)['\"]", r"\b(?:require|import)\(\s*['\"]([^'\"\n]+)['\"]\s*\)")
        found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])
        return files.select(id_, F.explode(F.array_distinct(found)).alias("module"))
    used = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);"), F.lit(1))
    flat = files.select(id_, F.explode(F.transform(used, lambda u: F.regexp_replace(u, r"\s+", " "))).alias("_u"))
    group = F.regexp_extract("_u", r"^([^{}]*)\{([^{}]*)\}$", 2)
    parts = F.filter(F.transform(F.split(group, ","), lambda x: F.trim(x)), lambda x: x != "")
    stem = F.regexp_extract("_u", r"^([^{}]*)\{[^{}]*\}$", 1)
    return flat.select(id_, F.explode(F.when(group != "", F.transform(parts, lambda x: F.concat(stem, x))).otherwise(F.array("_u"))).alias("module")).distinct()
