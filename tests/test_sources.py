import io
import json
import struct
import zipfile

from loomspan.sources import code, repository, sessions


def test_jsonl(spark, tmp_path):
    lines = [
        {"type": "session_meta", "payload": {"id": "S1"}}, {"type": "user", "message": "hello", "timestamp": "2025-01-02T03:04:05Z"}, "broken {", {"type": "shell", "command": "ls", "output": "Process exited with code 2\nOutput:\nno such file"},
    ]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "rollout-2025-01-02T03-04-05-x.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    (tmp_path / "a" / "rollout-2024-01-02T03-04-05-x.jsonl").write_text(json.dumps({"role": "user", "text": "old", "sessionId": "S0"}))
    rows = sessions.read_jsonl(spark, [str(tmp_path)], since="2025-01-01").orderBy("ordinal").collect()
    assert [(r.session_id, r.event_type, r.message, r.exit_code) for r in rows] == [("S1", "prompt", "hello", None), ("S1", "command", "no such file", 2)]
    every = sessions.read_jsonl(spark, [str(tmp_path)])
    assert every.count() == 3
    assert {r.session_id: r.summary for r in sessions.last_messages(every).collect()} == {"S0": "old", "S1": "hello\nno such file"}


def test_records_of_provider_logs(spark, tmp_path):
    lines = [
        {"type": "session_meta", "payload": {"id": "R"}}, {"type": "turn_context", "payload": {"cwd": "/"}}, {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"text": "one"}, {"text": "two"}]}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": json.dumps({"cmd": "ls -l"})}}, {"type": "response_item", "payload": {"type": "function_call_output", "output": "Command: ls\nProcess exited with code 3\nOutput:\nnothing"}},
        {"type": "event_msg", "payload": {"type": "token_count"}}, {"type": "event_msg", "payload": {"type": "notice", "message": " it failed "}},
    ]
    (tmp_path / "rollout.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = [(r.event_type, r.message, r.command, r.tool_name, r.exit_code) for r in sessions.read_jsonl(spark, [str(tmp_path)]).orderBy("ordinal").collect()]
    assert got == [("turn_context", None, None, None, None), ("prompt", "one\ntwo", None, None, None), ("tool_call", None, "ls -l", "shell", None), ("tool_result", "nothing", "ls", None, 3), ("error", "it failed", None, None, None)]


def test_long_logs_are_read_in_blocks(spark, tmp_path):
    lines = [json.dumps({"type": "session_meta", "payload": {"id": "L"}})] + [json.dumps({"type": "user", "message": f"m{i}"}) if i % 7 else "" for i in range(1, 400)]
    (tmp_path / "long.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = sessions.read_jsonl(spark, [str(tmp_path)]).select("ordinal", "message", "session_id").collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.ordinal, r.message) for r in rows) == [(i, f"m{i}") for i in range(1, 400) if i % 7]
    assert {r.session_id for r in rows} == {"L"}


def test_json(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"sessionId": "J", "messages": [{"role": "user", "text": "one"}, {"role": "assistant", "text": "two"}]}))
    rows = sessions.read_json(spark, [str(tmp_path)]).orderBy("ordinal").collect()
    assert [(r.session_id, r.event_type, r.message) for r in rows] == [("J", "prompt", "one"), ("J", "response", "two")]


def test_readers():
    w = '<w:document xmlns:w="x"><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>a &amp; b</w:t></w:r></w:p></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", w)
    assert repository.docx_text(out.getvalue()) == "# Top\na & b"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>x</t></si><si><t>y</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c t="s"><v>1</v></c><c t="inlineStr"><is><t>z</t></is></c><c><v>3</v></c></row></sheetData></worksheet>')
        z.writestr("ppt/slides/slide2.xml", "<s><a><t>two</t></a></s>")
        z.writestr("ppt/slides/slide1.xml", "<s><t>one</t></s>")
    assert repository.xlsx_text(out.getvalue()) == "## sheet1\ny\tz\t3"
    assert repository.pptx_text(out.getvalue()) == "## Slide 1\none\n## Slide 2\ntwo"
    assert repository.pdf_text(b"BT (Hello \\(x\\)) Tj [(a) -20 (b)] TJ ET") == "Hello (x)\nab"
    assert repository.image_size(b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 7, 9)) == (7, 9)
    assert repository.image_size(b"GIF89a" + struct.pack("<HH", 3, 4)) == (3, 4)
    assert repository.image_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 5, 6) + bytes(4)) == (6, 5)
    assert repository.image_size(b"nothing") is None
    wav = b"RIFF" + bytes(4) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", 32000)
    assert repository.media_facts(wav) == {"format": "wav", "sample_rate": "8000", "duration_ms": "2000"}


def test_walk_and_graph(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "pkg" / "a.py").write_text('import os\nfrom . import b\nfrom .b import helper\n\n\nclass Box:\n    """A box."""\n\n    def open(self, n: int) -> str:\n        # TODO: close it\n        return helper(n)\n')
    (tmp_path / "pkg" / "b.py").write_text("def helper(x):\n    return x\n")
    (tmp_path / "pkg" / "c.ts").write_text('import { z } from "./d";\nexport const run = (x) => {\n  z(x);\n};\n')
    (tmp_path / "pkg" / "d.ts").write_text("export function z(x) { return x }\n")
    (tmp_path / "README.md").write_text("# Title\n\n## Why it is so\n\nsee pkg/a.py\n")
    (tmp_path / ".env").write_text("SECRET=1")
    (tmp_path / "bad.docx").write_bytes(b"not a zip")
    (tmp_path / "node_modules" / "x.js").write_text("1")
    files = repository.walk(spark, str(tmp_path))
    assert {r.path for r in files.collect()} == {"pkg/a.py", "pkg/b.py", "pkg/c.ts", "pkg/d.ts", "README.md", "bad.docx"}
    assert repository.manifest(files).count() == 6
    read = repository.extract(files)
    assert {r.path: r.diagnostic for r in read.collect() if r.diagnostic} == {"bad.docx": "BadZipFile: metadata only"}
    from pyspark.sql import functions as F

    sources = read.withColumn("language", repository.language(F.col("path"))).where("language is not null")
    parts = code.parts_of(sources)
    found = {(r.path, r.part, r.name) for r in parts.collect()}
    assert {("pkg/a.py", "symbol", "Box"), ("pkg/a.py", "symbol", "open"), ("pkg/a.py", "param", "int"), ("pkg/a.py", "returns", "str"), ("pkg/c.ts", "symbol", "run"), ("pkg/c.ts", "import", "./d"), ("pkg/a.py", "rationale", "close it")} <= found
    nodes, edges = code.code_graph(sources, parts)
    links = {(r.source, r.relation, r.target, r.evidence) for r in edges.collect()}
    assert ("symbol:pkg/a.py#Box.open", "calls", "symbol:pkg/b.py#helper", "resolved") in links
    assert ("file:pkg/c.ts", "imports", "file:pkg/d.ts", "extracted") in links and ("file:pkg/a.py", "imports", "file:pkg/b.py", "extracted") in links
    assert nodes.where("node_type = 'symbol'").count() == 5
    docs = read.where("path = 'README.md'")
    assert [(r.level, r.title, r.kind) for r in code.headings(docs).orderBy("line").collect()] == [(1, "Title", "section"), (2, "Why it is so", "rationale")]
    assert [r.target for r in code.path_mentions(docs, sources).collect()] == ["pkg/a.py"]
