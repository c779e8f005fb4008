"""TIFF pages: walk image directories, decode strips and tiles, one row per page.

The reader takes little- and big-endian classic files, any number of image
directories, strips or tiles, 8-bit and 16-bit unsigned samples (chunky), no
compression, PackBits, LZW (most significant bit first, early change) and
deflate, and horizontal differencing. The writer makes the same forms and
stores any payload without loss as 8-bit samples.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.kernel import mapped, texts
from loomspan.plans.lineage import read

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
_CLEAR, _END, _FULL = 256, 257, 4094


class TiffError(ValueError):
    """The bytes are not a TIFF file that this reader takes."""


# --- compression -----------------------------------------------------------


def packbits_decode(data: bytes, most: float = math.inf) -> bytes:
    """No more is decoded once ``most`` bytes are there."""
    out, i, n, size = [], 0, len(data), 0
    while i < n and size < most:
        k = data[i]
        if k < 128:
            out.append(data[i + 1 : i + 2 + k])
            size += k + 1
            i += k + 2
        elif k > 128:
            out.append(data[i + 1 : i + 2] * (257 - k))
            size += 257 - k
            i += 2
        else:
            i += 1
    return b"".join(out)


_RUN = re.compile(rb"(.)\1{2,127}", re.S)


def packbits_encode(data: bytes) -> bytes:
    out, at = [], 0

    def literal(end: int) -> None:
        for i in range(at, end, 128):
            part = data[i : min(end, i + 128)]
            out.append(bytes([len(part) - 1]) + part)

    for run in _RUN.finditer(data):
        literal(run.start())
        out.append(bytes([257 - (run.end() - run.start())]) + run[1])
        at = run.end()
    literal(len(data))
    return b"".join(out)


def _code_widths() -> np.ndarray:
    """Bits of the i-th code after a clear: the width changes one code early."""
    size = 258 + np.arange(_FULL - 258 + 2)  # entries in the table when the code after this one is read
    return np.where(size < 511, 9, np.where(size < 1023, 10, np.where(size < 2047, 11, 12)))


_WIDTHS = _code_widths()
_WIDTH_ENDS = np.cumsum(_WIDTHS)


def lzw_encode(data: bytes) -> bytes:
    """Each segment starts with a clear code and ends before the table is full."""
    segments: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    size, prefix = 258, -1
    for b in data:
        if prefix < 0:
            prefix = b
            continue
        key = prefix << 8 | b
        known = table.get(key)
        if known is not None:
            prefix = known
            continue
        codes.append(prefix)
        table[key] = size
        size += 1
        prefix = b
        if size == _FULL:
            codes.append(prefix)
            segments.append(codes)
            codes, table, size, prefix = [], {}, 258, -1
    if prefix >= 0:
        codes.append(prefix)
    segments.append(codes)
    values, widths = [np.array([_CLEAR])], [np.array([9])]
    for k, codes in enumerate(segments):
        end = _END if k == len(segments) - 1 else _CLEAR
        values.append(np.array([*codes, end]))
        widths.append(_WIDTHS[: len(codes) + 1])
    value, width = np.concatenate(values), np.concatenate(widths)
    # All bits at once: bit j of code i is (value >> (width - 1 - j)) & 1.
    ends = np.cumsum(width)
    at = np.arange(ends[-1])
    owner = np.repeat(np.arange(len(value)), width)
    return np.packbits(((value[owner] >> (ends[owner] - 1 - at)) & 1).astype(np.uint8)).tobytes()


def lzw_decode(data: bytes, most: float = math.inf) -> bytes:
    """No segment is decoded once ``most`` bytes are there."""
    padded = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
    total, at, out, size = len(data) * 8, 0, [], 0
    base = [bytes([i]) for i in range(256)] + [b"", b""]

    def codes(start: int) -> np.ndarray:
        ends = _WIDTH_ENDS[: np.searchsorted(_WIDTH_ENDS, total - start, "right")]
        widths = _WIDTHS[: len(ends)]
        begin = start + ends - widths
        byte = begin >> 3
        word = padded[byte] << 16 | padded[byte + 1] << 8 | padded[byte + 2]
        return (word >> (24 - (begin & 7) - widths).astype(np.uint32)) & ((1 << widths) - 1).astype(np.uint32)

    while at + 9 <= total and size < most:
        found = codes(at)
        stop = np.flatnonzero((found == _CLEAR) | (found == _END))
        k = int(stop[0]) if len(stop) else len(found)
        table, previous = base.copy(), None
        for code in found[:k].tolist():
            if previous is None:
                entry = table[code]
            else:
                if code < len(table):
                    entry = table[code]
                elif code == len(table):
                    entry = previous + previous[:1]
                else:
                    raise TiffError("a code beyond the LZW table")
                table.append(previous + entry[:1])
            out.append(entry)
            size += len(entry)
            previous = entry
        if k == len(found) or found[k] == _END:
            break
        at += int(_WIDTH_ENDS[k])
    return b"".join(out)


def compress(data: bytes, how: int) -> bytes:
    if how == NONE:
        return data
    if how == LZW:
        return lzw_encode(data)
    if how == PACKBITS:
        return packbits_encode(data)
    return zlib.compress(data, 6)


def expand(data: bytes, how: int, most: float = math.inf) -> bytes:
    """The stored bytes in the clear; decoding ends soon after ``most`` bytes."""
    if how == NONE:
        return data
    if how == LZW:
        return lzw_decode(data, most)
    if how == PACKBITS:
        return packbits_decode(data, most)
    if how in (DEFLATE, 32946):
        try:
            return zlib.decompressobj().decompress(data, 0 if most == math.inf else max(1, int(most)))
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from None
    raise TiffError(f"compression {how}")


# --- files -----------------------------------------------------------------


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The tags of each image directory, in file order; a loop of links ends the walk."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    try:
        while at and at not in seen:
            seen.add(at)
            (n,) = struct.unpack_from(order + "H", data, at)
            tags: dict[int, tuple] = {0: (order,)}
            for i in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
                if kind not in _CODES and kind != 2:
                    continue
                place = at + 2 + 12 * i + 8
                if _SIZES[kind] * count > 4:
                    (place,) = struct.unpack_from(order + "I", data, place)
                if kind == 2:
                    tags[tag] = (data[place : place + count],)
                else:
                    tags[tag] = struct.unpack_from(f"{order}{count}{_CODES[kind]}", data, place)
            yield tags
            (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    except struct.error:
        raise TiffError("a directory beyond the end of the file") from None


def _first(tags: dict[int, tuple], tag: int, default=None):
    """A tag's first value; a tag without values is as good as none."""
    return (tags.get(tag) or (default,))[0]


def page_samples(data: bytes, tags: dict[int, tuple]) -> np.ndarray:
    """Samples of one directory as an array of height, width, samples a pixel."""
    width, height, per = _first(tags, 256), _first(tags, 257), _first(tags, 277, 1)
    bits, how, predictor = tags.get(258) or (1,), _first(tags, 259, 1), _first(tags, 317, 1)
    if not width or not height or not per or len(set(bits)) != 1 or bits[0] not in (8, 16) or _first(tags, 284, 1) != 1 or predictor not in (1, 2):
        raise TiffError("a layout that is not read: chunky 8- or 16-bit samples are")
    kind = np.dtype(np.uint8 if bits[0] == 8 else tags[0][0] + "u2")

    def block(k: int, rows: int, columns: int, offsets: tuple, counts: tuple) -> np.ndarray:
        if k >= min(len(offsets), len(counts)):
            raise TiffError("a strip or tile has no place")
        need = rows * columns * per * kind.itemsize
        raw = expand(data[offsets[k] : offsets[k] + counts[k]], how, need)
        if len(raw) < need:
            raise TiffError("a strip or tile is short")
        x = np.frombuffer(raw, kind, rows * columns * per).reshape(rows, columns, per)
        return np.add.accumulate(x, axis=1, dtype=kind.newbyteorder("=")) if predictor == 2 else x

    # Blocks are decoded before the page is laid out, so sizes that the data don't bear out take no memory.
    if 322 in tags or 323 in tags:
        wide, high = _first(tags, 322), _first(tags, 323)
        if not wide or not high:
            raise TiffError("tiles without a size")
        across, offsets, counts = -(-width // wide), tags.get(324, ()), tags.get(325, ())
        places = [(k // across * high, k % across * wide) for k in range(min(across * -(-height // high), len(offsets) + 1))]
        blocks = [block(k, high, wide, offsets, counts)[: height - y, : width - x] for k, (y, x) in enumerate(places)]
    else:
        rows, offsets, counts = min(_first(tags, 278, height), height), tags.get(273, ()), tags.get(279, ())
        if not rows:
            raise TiffError("strips without rows")
        places = [(y, 0) for y in range(0, min(height, rows * (len(offsets) + 1)), rows)]
        blocks = [block(k, min(rows, height - y), width, offsets, counts) for k, (y, _) in enumerate(places)]
    out = np.empty((height, width, per), kind.newbyteorder("="))
    for (y, x), b in zip(places, blocks, strict=True):
        out[y : y + b.shape[0], x : x + b.shape[1]] = b
    return out


def write(pages: list[np.ndarray], how: int = DEFLATE, predictor: int = 1, rows: int = 64, tile: int = 0, order: str = "<") -> bytes:
    """A file with 8-bit pages (height, width) in strips of ``rows`` rows or square tiles of ``tile`` pixels."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        height, width = page.shape
        if tile:
            padded = np.pad(page, ((0, -height % tile), (0, -width % tile)))
            blocks = [padded[y : y + tile, x : x + tile] for y in range(0, height, tile) for x in range(0, width, tile)]
        else:
            blocks = [page[y : y + rows] for y in range(0, height, rows)]
        offsets, counts = [], []
        for b in blocks:
            if predictor == 2:
                b = np.diff(b, axis=1, prepend=np.uint8(0))
            stored = compress(np.ascontiguousarray(b).tobytes(), how)
            offsets.append(len(out))
            counts.append(len(stored))
            out += stored + bytes(len(stored) % 2)
        entries = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8]), (259, 3, [how]), (262, 3, [1]), (277, 3, [1])]
        entries += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, offsets), (325, 4, counts)] if tile else [(273, 4, offsets), (278, 4, [rows]), (279, 4, counts)]
        entries += [(317, 3, [predictor])]
        fields = b""
        for tag, kind, values in sorted(entries):
            packed = struct.pack(f"{order}{len(values)}{_CODES[kind]}", *values)
            if len(packed) > 4:
                packed, place = struct.pack(order + "I", len(out)), packed
                out += place
            fields += struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        link = len(out) + 2 + len(fields)
        out += struct.pack(order + "H", len(fields) // 12) + fields + bytes(4)
    return bytes(out)


# --- operators -------------------------------------------------------------

_PAGE = pa.schema(
    [
        ("tiff_row", pa.int64()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()),
        ("bits", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string()),
    ]
)


def pages_of(data: bytes | None) -> Iterator[dict]:
    """A record for each page; a file or page that can't be read is a record with its error."""
    if data is None:
        return
    page = 0
    try:
        for tags in directories(data):
            found = {"page": page, "compression": _first(tags, 259, 1), "predictor": _first(tags, 317, 1), "tiled": 322 in tags}
            try:
                x = page_samples(data, tags)
                found |= {"height": x.shape[0], "width": x.shape[1], "samples": x.shape[2], "bits": x.dtype.itemsize * 8, "pixels": x.tobytes()}
            except (ValueError, LookupError, ArithmeticError, TypeError, MemoryError) as e:  # TiffError is a ValueError
                found["error"] = f"{type(e).__name__}: {e}"
            # Tags of an odd type are not passed on.
            yield {k: v for k, v in found.items() if k not in ("compression", "predictor") or isinstance(v, int) and v < 1 << 31}
            page += 1
    except TiffError as e:
        yield {"page": page, "error": str(e)}


def tiff_pages(df: DataFrame, data: str = "data", key: str = "id") -> DataFrame:
    """One row per page of the TIFF files in binary column ``data``.

    Returns ``key, page, width, height, samples, bits, compression, predictor,
    tiled, pixels, error``. Null data gives no row; bytes that are not TIFF and
    pages of an unread or broken layout (no samples, no sizes, missing or short
    strips) give a row with ``error`` and null pixels, and a link beyond the file
    gives one after its good pages, with the number that the next page would
    have. No page takes more memory than its data decode to.
    Repeated rows give repeated pages. Other columns of ``df`` are left out, so
    clashing names don't matter. Map-side only: no shuffle.
    """
    kind = df.schema[key].dataType

    def run(batches):
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for found in pages_of(raw.as_py()):
                    yield pa.RecordBatch.from_pylist([{"key": k, **found}], schema)

    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("key", to_arrow_type(kind)), *[f for f in _PAGE if f.name != "tiff_row"]])
    out = "key {}, page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"
    return mapped(df.select(F.col(key), F.col(data)), run, out.format(kind.simpleString())).withColumnRenamed("key", key)


def form_of(payload: bytes) -> dict:
    """How a payload is stored: its checksum picks the compression, predictor and layout."""
    c = zlib.crc32(payload)
    return {"how": (DEFLATE, LZW, PACKBITS, DEFLATE)[c % 4], "predictor": 1 + c // 4 % 2, "tile": (0, 64)[c // 8 % 2], "order": "<>"[c // 16 % 2]}


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 if text else 64)


def store(payload: bytes, rows_a_page: int = 1024) -> bytes:
    """A payload of whole 64-byte rows as pages of at most ``rows_a_page`` rows."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    return write([x[i : i + rows_a_page] for i in range(0, len(x), rows_a_page)], **form_of(payload))


def feature(payload: np.ndarray, pages: int) -> str:
    """Pages, rows, mean, deviation, share of zero samples and an 8-bin histogram of the samples."""
    bins = np.bincount(payload >> 5, minlength=8)
    return f"{pages}x64x{len(payload) // 64};{payload.mean():.3f};{payload.std():.3f};{np.mean(payload == 0):.4f};" + ",".join(map(str, bins))


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int, compression int, predictor int, tiled boolean"


def text_media(docs: DataFrame) -> DataFrame:
    """Store each text as a TIFF file, read the stored pages back and describe what was read.

    A null text is empty, and an empty one is 64 zero bytes. Equal texts give
    equal values; each row, repeated or with a null id, gives one row. Other
    columns are ignored. Map-side only; memory is one Arrow batch and one file.
    """

    def run(batches):
        for batch in batches:
            data, at = texts(batch.column(1))
            raw = data.tobytes()
            rows = []
            for i in range(batch.num_rows):
                text = raw[at[i] : at[i + 1]]
                media = store(payload_of(text))
                pages = list(pages_of(media))
                if any("error" in p for p in pages):
                    raise TiffError(next(p["error"] for p in pages if "error" in p))
                back = b"".join(p["pixels"] for p in pages)
                rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(np.frombuffer(back, np.uint8), len(pages)), len(pages), pages[0]["compression"], pages[0]["predictor"], pages[0]["tiled"]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(columns, kinds, strict=True)]], [f.split()[0] for f in _DIGEST.split(", ")])

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, _DIGEST)


def op1_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(read(spark, sf_dir, "documents"))
