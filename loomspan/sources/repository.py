"""Repository files: walking, classes, ignores, manifests, and readers of office, PDF, image and media files."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.text import basename, extension
from loomspan.schemas import lookup

# Fixed values.
CODE = (
    "ts tsx js jsx mjs cjs py go rs java c cc cpp h hpp cxx hxx rb cs kt kts scala php swift lua zig ps1 sh sql css scss sass less vue svelte astro ex exs m mm jl dart"
).split()
DOCUMENTS = "md mdx html htm txt rst yaml yml json jsonc".split()
IMAGES, MEDIA = "png jpg jpeg webp gif".split(), "mp4 mov m4v mp3 wav".split()
KINDS = {**dict.fromkeys(CODE, "code"), **dict.fromkeys(DOCUMENTS, "document"), "docx": "office_document", "xlsx": "spreadsheet", "pptx": "presentation", "pdf": "pdf", **dict.fromkeys(IMAGES, "image"), **dict.fromkeys(MEDIA, "media")}
LANGUAGES = {
    "py": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go", "rs": "rust", "java": "java",
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "mm": "cpp", "rb": "ruby", "cs": "csharp", "kt": "kotlin", "kts": "kotlin",
    "scala": "scala", "sc": "scala", "php": "php", "swift": "swift", "lua": "lua", "zig": "zig", "ex": "elixir", "exs": "elixir", "jl": "julia", "m": "c",
}
IGNORED_DIRS = (
    ".git", ".svn", ".hg", "node_modules", ".pnp", ".yarn", "dist", "build", "out", ".output", ".next", ".nuxt", ".vercel", ".netlify", ".turbo", ".parcel-cache", ".cache", ".rollup.cache",
    "target", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", "venv", ".venv", "bin", "obj", ".idea", ".vscode", ".vs", "coverage", ".nyc_output", ".docusaurus", "secrets",
)
IGNORED_FILES = (
    ".DS_Store", "Thumbs.db", ".env", ".env.local", ".env.development", ".env.production", ".env.staging", ".env.test", "credentials.json", "serviceAccountKey.json",
    "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "composer.lock", "Cargo.lock", "Gemfile.lock",
)
IGNORED_ENDS = (".pem", ".key", ".p12", ".pfx", ".secret", ".secrets", ".min.js", ".min.css", ".map", ".tsbuildinfo", ".d.ts", ".generated.ts", ".generated.js")
TEXT_CAP, BINARY_CAP, OFFICE_BUDGET = 256 * 1024, 16 * 1024 * 1024, 2_000_000


def file_kind(path: Column) -> Column:
    return lookup(extension(path), KINDS, "unsupported")


def language(path: Column) -> Column:
    return lookup(extension(path), LANGUAGES, None)


def is_ignored(path: Column) -> Column:
    """Secrets, locks, minified and generated files, and whatever is in an ignored folder."""
    folders, name = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), basename(path)
    secret = (name.startswith(".env") & (name != ".env.example")) | (name.contains("credentials") & name.endswith(".json")) | name.startswith("__generated__")
    out = F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED_DIRS))) | name.isin(*IGNORED_FILES) | secret
    for end in IGNORED_ENDS:
        out = out | name.endswith(end)
    return out


def sync_rules(spark: SparkSession) -> DataFrame:
    """The extensions and ignored names that clients go by."""
    rows = [("extension", k, v) for k, v in KINDS.items()] + [("ignored_dir", d, None) for d in IGNORED_DIRS] + [("ignored_file", d, None) for d in (*IGNORED_FILES, *IGNORED_ENDS)] + [("ignored_file", d, None) for d in (*IGNORED_FILES, *IGNORED_ENDS)]
    return spark.createDataFrame(rows, "rule string, name string, kind string")


def walk(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), size, content of the files below a root that are not ignored; text beyond its cap is left out, large binaries lose their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split(":")[-1].lstrip("/")
    path = F.regexp_replace(F.col("path"), f"^.*{re.escape(base)}/", "")
    rows = files.select(path.alias("path"), F.col("length").alias("size"), "content").where(~is_ignored(F.col("path"))).withColumn("kind", file_kind(F.col("path")))
    text = F.col("kind").isin("code", "document")
    kept = rows.where((F.col("kind") != "unsupported") & ~(text & (F.col("size") > TEXT_CAP)))
    return kept.withColumn("content", F.when(F.col("size") <= BINARY_CAP, F.col("content")))


def manifest(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("hash"))


# --- readers ------------------------------------------------------------------


def zip_entries(data: bytes, wanted: str, budget: int = OFFICE_BUDGET) -> list[tuple[str, bytes]]:
    """Entries whose names match, in natural order, as long as the budget of bytes lasts."""
    out, used = [], 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(wanted, n)), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])
        for n in names:
            if used + z.getinfo(n).file_size > budget:
                break
            raw = z.read(n)
            used += len(raw)
            out.append((n, raw))
    return out


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def docx_text(data: bytes) -> str:
    """Paragraphs as lines; headings as markdown headings."""
    lines = []
    for _, raw in zip_entries(data, r"word/document\.xml"):
        for p in ElementTree.fromstring(raw).iter():
            if _local(p.tag) == "p":
                style = next((v for s in p.iter() if _local(s.tag) == "pStyle" for v in s.attrib.values()), "")
                line = "".join(t.text or "" for t in p.iter() if _local(t.tag) == "t")
                level = re.search(r"[Hh]eading(\d)", style)
                if line.strip():
                    lines.append("#" * int(level[1]) + " " + line if level else line)
    return "\n".join(lines)


def xlsx_text(data: bytes) -> str:
    """Sheets as sections of tab-separated rows, shared and inline strings decoded."""
    shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for _, raw in zip_entries(data, r"xl/sharedStrings\.xml") for si in ElementTree.fromstring(raw) if _local(si.tag) == "si"]
    out = []
    for name, raw in zip_entries(data, r"xl/worksheets/[^/]*\.xml"):
        out.append("## " + name.rsplit("/", 1)[-1].removesuffix(".xml"))
        for row in (r for r in ElementTree.fromstring(raw).iter() if _local(r.tag) == "row"):
            cells = []
            for c in (c for c in row if _local(c.tag) == "c"):
                value = next((v.text or "" for v in c if _local(v.tag) == "v"), "")
                if c.get("t") == "s":
                    value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
                elif c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                cells.append(value)
            out.append("\t".join(cells))
    return "\n".join(out)


def pptx_text(data: bytes) -> str:
    out = []
    for k, (_, raw) in enumerate(zip_entries(data, r"ppt/slides/slide\d+\.xml"), 1):
        out.append(f"## Slide {k}")
        out += [t.text for t in ElementTree.fromstring(raw).iter() if _local(t.tag) == "t" and t.text]
    return "\n".join(out)


_PDF = re.compile(rb"\((?P<one>(?:\\.|[^\\()])*)\)\s*Tj|\[(?P<many>(?:\((?:\\.|[^\\()])*\)|[^\]()])*)\]\s*TJ", re.S)


def pdf_text(data: bytes, most: int = 2000) -> str:
    """Literal strings of uncompressed text operators, one a line."""
    clean = lambda s: re.sub(rb"\\([()\\])", rb"\1", s).decode("latin-1")
    lines = []
    for m in _PDF.finditer(data):
        text = clean(m["one"]) if m["one"] is not None else "".join(clean(x) for x in re.findall(rb"\(((?:\\.|[^\\()])*)\)", m["many"]))
        if text.strip():
            lines.append(text)
        if len(lines) >= most:
            break
    return "\n".join(lines)


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height of PNG, GIF, WebP and JPEG files."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        if data[12:16] == b"VP8X" and len(data) >= 30:
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if data[12:16] == b"VP8 " and len(data) >= 30:
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            mark = data[at + 1]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            if mark in (0xD8, 0x01, 0xFF) or 0xD0 <= mark <= 0xD7:
                at += 1 if mark == 0xFF else 2
                continue
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def media_facts(data: bytes) -> dict[str, str]:
    """Format, sample rate and duration of WAV; ID3 version of MP3; brand and duration of MP4."""
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        out, at, rate = {"format": "wav"}, 12, 0
        while at + 8 <= len(data):
            name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
            if name == b"fmt " and at + 20 <= len(data):
                out["sample_rate"] = str(struct.unpack("<I", data[at + 12 : at + 16])[0])
                rate = struct.unpack("<I", data[at + 16 : at + 20])[0]
            if name == b"data" and rate:
                out["duration_ms"] = str(size * 1000 // rate)
            at += 8 + size + size % 2
        return out
    if data[:3] == b"ID3" and len(data) > 4:
        return {"format": "mp3", "id3": f"2.{data[3]}"}
    if data[4:8] == b"ftyp":
        out = {"format": "mp4", "brand": data[8:12].decode("latin-1")}
        at = data.find(b"mvhd")
        if at > 0 and len(data) >= at + 28:
            scale, span = struct.unpack(">II", data[at + 16 : at + 24] if data[at + 4] == 0 else data[at + 24 : at + 28] + data[at + 32 : at + 36])
            if scale:
                out["duration_ms"] = str(span * 1000 // scale)
        return out
    return {}


def extract(files: DataFrame) -> DataFrame:
    """path, kind, text, facts, diagnostic of walked files: text is decoded or extracted, what can't be read is told.

    Each file is read on its own in an Arrow batch; a broken file is a row with
    a diagnostic, never a failed job.
    """
    readers = {"office_document": docx_text, "spreadsheet": xlsx_text, "presentation": pptx_text, "pdf": pdf_text}

    def one(kind: str, data: bytes | None) -> tuple[str | None, dict, str | None]:
        if data is None:
            return None, {}, "too large: metadata only"
        try:
            if kind in ("code", "document"):
                return data.decode(), {}, None
            if kind in readers:
                return readers[kind](data), {}, None
            if kind == "image":
                size = image_size(data)
                return None, {"width": str(size[0]), "height": str(size[1])} if size else {}, None if size else "unknown image header"
            return None, media_facts(data), None
        except (UnicodeDecodeError, zipfile.BadZipFile, ElementTree.ParseError, struct.error, KeyError, ValueError) as e:
            return None, {}, f"{type(e).__name__}: metadata only"

    def run(batches):
        for batch in batches:
            found = [one(k, d) for k, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            text, facts, said = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([list(f.items()) for f in facts], pa.map_(pa.string(), pa.string())), pa.array(said, pa.string())],
                ["path", "kind", "text", "facts", "diagnostic"],
            )

    return files.select("path", "kind", "content").mapInArrow(run, "path string, kind string, text string, facts map<string,string>, diagnostic string")
