"""Session files: JSON lines and JSON documents of several providers, as canonical events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions.text import clean_nul, clip, stable_id
from loomspan.operators.events import event_type

_PAYLOAD = (
    "type:string,id:string,cwd:string,role:string,message:string,text:string,command:string,cmd:string,arguments:string,name:string,tool_name:string,file_path:string,"
    "exit_code:int,output:string,summary:string,content:string,event_type:string,git:struct<branch:string>"
)
_LINE = (
    "type string, timestamp string, session_id string, sessionId string, role string, text string, message string, command string, tool_name string, "
    f"name string, file_path string, exit_code int, output string, subtype string, content string, payload struct<{_PAYLOAD}>"
)


def file_time(path: Column) -> Column:
    """The time in a file's name: rollout-YYYY-MM-DDTHH-MM-SS- or session-YYYY-MM-DDTHH-MM; null without one."""
    name = F.element_at(F.split(path, "/"), -1)
    day = r"(\d{4}-\d{2}-\d{2})T(\d{2})-(\d{2})"
    rollout, session = rf"rollout-{day}-(\d{{2}})-", rf"session-{day}"
    part = lambda pattern, *k: [F.regexp_extract(name, pattern, i) for i in k]
    full = F.concat(*[x for d, t in zip(part(rollout, 1, 2, 3, 4), (" ", ":", ":", ""), strict=True) for x in (d, F.lit(t))])
    short = F.concat(*[x for d, t in zip(part(session, 1, 2, 3), (" ", ":", ":00"), strict=True) for x in (d, F.lit(t))])
    return F.coalesce(F.when(name.rlike(rollout), F.try_to_timestamp(full)), F.when(name.rlike(session), F.try_to_timestamp(short)))


def in_date_range(path: Column, since: str | None, until: str | None) -> Column:
    """Files whose time is in the range; names without one pass."""
    at = file_time(path)
    out = F.lit(True)
    if since:
        out = out & (at.isNull() | (at >= F.lit(since).cast("timestamp")))
    if until:
        out = out & (at.isNull() | (at <= F.lit(until).cast("timestamp")))
    return out


def exit_code_of(output: Column) -> Column:
    return F.nullif(F.regexp_extract(output, r"(?:^|\n)Process exited with code\s+(-?\d+)", 1), F.lit("")).cast("int")


def command_of(output: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(output, r"(?:^|\n)Command:\s*(.+)", 1)), F.lit(""))


def output_body(output: Column) -> Column:
    """What follows the last line that is Output: alone, else all; without blanks around it, null if that is nothing."""
    body = F.when(F.contains(output, F.lit("\nOutput:\n")), F.regexp_extract(output, r"(?s)^.*\nOutput:\n(.*)$", 1)).otherwise(output)
    return F.nullif(F.btrim(body, F.lit(" \t\n\v\f\r")), F.lit(""))


def record_type(top: Column, payload_type: Column, role: Column, payload: Column) -> Column:
    """The event type of a record of provider logs by its kind, its payload's type and role, and words of the payload; null is no event.

    Kinds that providers don't wrap go by their names, see ``event_type``.
    """
    low = lambda x: F.lower(F.coalesce(x, F.lit("")))
    top_, kind, who, said = low(top), low(payload_type), low(role), low(payload)
    item = (
        F.when(kind == "message", F.when(who == "user", "prompt").when(who == "assistant", "response").otherwise("annotation"))
        .when(kind.isin("function_call", "custom_tool_call"), "tool_call").when(kind.isin("function_call_output", "custom_tool_call_output"), "tool_result").when(kind == "reasoning", "reasoning")
    )
    notice = F.when(kind == "agent_message", "agent_message").when(kind == "token_count", None).when(said.contains("error") | said.contains("failed"), "error").when(said.contains("test"), "test_result").otherwise("annotation")
    return F.when(top_ == "response_item", item).when(top_ == "event_msg", notice).when(top_ == "turn_context", "turn_context").otherwise(event_type(F.coalesce(top, role)))


def content_text(content: Column) -> Column:
    """A message's text: the content itself, or the texts of its parts, a line each."""
    parts = F.filter(F.transform(F.from_json(content, "array<struct<text:string>>"), lambda x: x["text"]), lambda t: t.isNotNull() & (t != ""))
    return F.when(F.ltrim(content).startswith("["), F.nullif(F.array_join(parts, "\n"), F.lit(""))).otherwise(content)


def numbered(lines: DataFrame, path: str, block: str, at: str) -> DataFrame:
    """``lines`` with ``pos``, the line's number in its file from 0, for files that are read in blocks.

    ``at`` orders the lines of a block. A long file is many blocks, and a block
    is what is sorted in a task; before it come as many lines as the blocks
    ahead of it count.
    """
    counts = lines.groupBy(path, block).agg(F.count("*").alias("_lines"))
    ahead = Window.partitionBy(path).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(path, block, F.coalesce(F.sum("_lines").over(ahead), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy(path, block).orderBy(at)) - 1
    return lines.withColumn("_nth", nth).join(starts, [path, block]).withColumn("pos", (F.col("_start") + F.col("_nth")).cast("int")).drop("_start", "_nth", block, at)


def read_jsonl(spark: SparkSession, roots: list[str], since: str | None = None, until: str | None = None) -> DataFrame:
    """Events of .jsonl files below the roots, one a line; malformed lines are skipped, headers give the session.

    Names that hold logs.json are left out. Lines keep their order by the
    file's line number, so turns can be counted.
    """
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(roots, lineSep="\n")
    lines = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    lines = lines.where(~F.col("path").contains("logs.json")).where(in_date_range(F.col("path"), since, until))
    kept = numbered(lines, "path", "block", "at").where("trim(line) <> ''")
    parsed = kept.withColumn("j", F.from_json("line", _LINE)).withColumn("raw", F.get_json_object("line", "$.payload")).where("j is not null and (j.type is not null or j.role is not null)")
    return _events(parsed)


def read_json(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Events of .json documents with a messages array."""
    docs = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(roots, wholetext=True)
    docs = docs.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", f"sessionId string, messages array<struct<{_LINE.replace(' ', ':').replace(',:', ',')}>>").alias("d"))
    rows = docs.where(~F.col("path").contains("logs.json") & F.col("d").isNotNull()).select("path", F.col("d.sessionId").alias("sid"), F.lit(None).cast("string").alias("raw"), F.posexplode("d.messages").alias("pos", "j"))
    return _events(rows.withColumn("j", F.col("j").withField("sessionId", F.coalesce("j.sessionId", "sid"))).drop("sid"))


def _events(parsed: DataFrame) -> DataFrame:
    j, p = (lambda c: F.col(f"j.{c}")), (lambda c: F.col(f"j.payload.{c}"))
    # The first header of a file, by an aggregate of the headers: no file's events meet in one task.
    heads = parsed.where((j("type") == "session_meta") & p("id").isNotNull()).groupBy("path").agg(F.min_by(p("id"), "pos").alias("_head"))
    parsed, head = parsed.join(heads, "path", "left"), F.col("_head")
    output = F.coalesce(j("output"), p("output"))
    top, wrapped = F.lower(F.coalesce(j("type"), F.lit(""))), F.lower(F.coalesce(p("type"), F.lit("")))
    trimmed = lambda x: F.nullif(F.trim(x), F.lit(""))
    plain = F.coalesce(j("text"), j("message"), content_text(j("content")), p("text"), p("message"), output_body(output))
    item = F.when(wrapped == "function_call_output", output_body(p("output"))).otherwise(F.coalesce(content_text(p("content")), p("output"), p("summary")))
    said = F.when(top == "event_msg", trimmed(p("message"))).when(top == "response_item", item).otherwise(plain)
    asked = F.coalesce(trimmed(F.get_json_object(p("arguments"), "$.cmd")), trimmed(p("arguments")))
    out = parsed.select(
        "path", "pos", F.coalesce(j("session_id"), j("sessionId"), head, stable_id(F.col("path"))).alias("session_id"), F.col("pos").cast("long").alias("ordinal"),
        record_type(F.coalesce(j("type"), j("role")), p("type"), F.coalesce(p("role"), j("role")), F.col("raw")).alias("event_type"), j("type").alias("raw_type"),
        clean_nul(said).alias("message"), F.coalesce(command_of(output), trimmed(p("cmd")), asked, j("command"), p("command")).alias("command"),
        F.coalesce(p("name"), p("tool_name"), j("tool_name"), j("name")).alias("tool_name"), F.coalesce(j("file_path"), p("file_path")).alias("file_path"),
        F.coalesce(exit_code_of(output), j("exit_code"), p("exit_code")).alias("exit_code"), F.try_to_timestamp(j("timestamp")).alias("created_at"),
    ).where("(raw_type is null or raw_type <> 'session_meta') and event_type is not null")
    ident = stable_id(F.concat_ws("\x01", "path", F.col("pos").cast("string")))
    return out.withColumn("event_id", ident).withColumn("idempotency_key", ident).drop("path", "pos", "raw_type")


def last_messages(events: DataFrame, n: int = 5, chars: int = 1500) -> DataFrame:
    """session_id, summary: the last n messages, joined and cut."""
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ordinal")))
    few = events.where("message is not null").withColumn("_n", nth).where(F.col("_n") <= n)
    return few.groupBy("session_id").agg(clip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "message"))), lambda x: x["message"]), "\n"), chars).alias("summary"))
