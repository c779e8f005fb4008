"""Byte-level BPE: distinct pre-tokens meet in a global shuffle, are encoded once, and ids return by position."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.kernel import chunks, mapped, texts
from loomspan.plans.lineage import read

#: Characters below this are split with explicit classes and the standard library's faster matcher.
_NEAR = 0x250
#: The White_Space property.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes of text in a block: the unit within which a pre-token is named by a local number.
BLOCK_BYTES = 1 << 24
#: Bytes beyond which a word is merged by a heap.
LONG_WORD = 128


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(2)
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table by id; its size is the vocabulary's, whatever the corpus."""
    table = ranks(path)
    out = [b""] * (max(table.values()) + 1)
    for token, k in table.items():
        out[k] = token
    return out


@functools.cache
def _splitters():
    import public_tokenizers
    import regex

    def with_space(pattern: str) -> str:
        return pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")

    def runs(kind: str) -> str:
        return "".join(re.escape(chr(i)) for i in range(_NEAR) if unicodedata.category(chr(i))[0] == kind)

    every = with_space(public_tokenizers.PATTERN)
    near = every.replace(r"[^" + _SPACE + r"\p{L}\p{N}]", f"[^{_SPACE}{runs('L')}{runs('N')}]").replace(r"\p{L}", f"[{runs('L')}]").replace(r"\p{N}", f"[{runs('N')}]")
    return re.compile(near).findall, regex.compile(every).findall, re.compile(f"[^\0-{chr(_NEAR - 1)}]").search


def pretokens(text: str) -> list[str]:
    near, every, beyond = _splitters()
    return every(text) if beyond(text) else near(text)


def pack(x: np.ndarray) -> bytes:
    """Non-negative 32-bit numbers as LEB128."""
    x = x.astype(np.uint32)
    size = 1 + (x >= 1 << 7) + (x >= 1 << 14) + (x >= 1 << 21) + (x >= 1 << 28)
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(x) else 0, np.uint8)
    begin = ends - size
    for k in range(5):
        has = size > k
        out[begin[has] + k] = ((x[has] >> np.uint32(7 * k)) & np.uint32(127)).astype(np.uint8) | ((size[has] > k + 1).astype(np.uint8) << 7)
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(raw < 128)[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(starts, append=len(raw)))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


def _squeeze(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(len(p).to_bytes(8, "little") + p for p in parts))


def _expand(data: bytes) -> list[bytes]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def merge(word: bytes, table: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token: of the neighbouring parts whose join has the least rank, the leftmost are joined, until no join has one."""
    whole = table.get(word)
    if whole is not None:
        return [whole]
    if len(word) > LONG_WORD:
        return _merge_long(word, table)
    none = len(table) + (1 << 32)
    parts = [word[i : i + 1] for i in range(len(word))]
    pair = [table.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while pair:
        least = min(pair)
        if least == none:
            break
        i = pair.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = table.get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = table.get(parts[i - 1] + parts[i], none)
    return [table[x] for x in parts]


def _merge_long(word: bytes, table: dict[bytes, int]) -> list[int]:
    """The same joins by a heap over a linked list, so that a word of n bytes takes n log n steps."""
    n = len(word)
    size, after, before = [1] * n, [*range(1, n), -1], [*range(-1, n - 1)]

    def rank(i: int):
        j = after[i]
        return None if j < 0 else table.get(word[i : j + size[j]])

    heap = [(r, i) for i in range(n) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if not size[i] or rank(i) != r:
            continue
        j = after[i]
        size[i], size[j], after[i] = size[i] + size[j], 0, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(heap, (r, k))
    return [table[word[i : i + size[i]]] for i in range(n) if size[i]]


def blocks_of(docs: DataFrame) -> DataFrame:
    """block, main, words: a block's sequences of local numbers, and its distinct pre-tokens, by number."""

    def run(batches):
        for batch in batches:
            data, offsets = texts(batch.column(1))
            for i, j in chunks(offsets, BLOCK_BYTES):
                local: defaultdict[str, int] = defaultdict()
                local.default_factory = local.__len__
                counts, sequences = [], []
                for k in range(i, j):
                    found = pretokens(data[offsets[k] : offsets[k + 1]].tobytes().decode())
                    counts.append(len(found))
                    sequences.append(np.fromiter(map(local.__getitem__, found), np.uint32, len(found)))
                sequence = np.concatenate(sequences)
                # Frequent words get small numbers, so that their positions pack into a byte.
                order = np.argsort(-np.bincount(sequence, minlength=len(local)), kind="stable")
                rank = np.empty(len(local), np.uint32)
                rank[order] = np.arange(len(local), dtype=np.uint32)
                listed = list(local)
                words = [listed[k].encode() for k in order.tolist()]
                ids = batch.column(0).slice(i, j - i)
                valid = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), np.uint8).tobytes()
                values = ids.fill_null(0).to_numpy().astype(np.int64).tobytes()
                main = _squeeze(valid, values, pack(np.array(counts)), pack(rank[sequence]), len(words).to_bytes(8, "little"))
                joined = _squeeze(pack(np.array([len(w) for w in words])), b"".join(words))
                # A block is named by its content, which is all that its parts must agree on.
                name = int.from_bytes(hashlib.blake2b(main + joined, digest_size=8).digest(), "little", signed=True)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([main], pa.binary()), pa.array([joined], pa.binary())], ["block", "main", "words"])

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "block long, main binary, words binary")


def _dealt(blocks: DataFrame, buckets: int) -> DataFrame:
    """block, bucket, data: a block's words and the steps between their numbers, dealt to buckets by the words' hash."""

    def run(batches):
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                parts: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
                for r, word in enumerate(_listed(*_expand(blob.as_py()))):
                    at, found = parts[zlib.crc32(word) % buckets]
                    at.append(r)
                    found.append(word)
                blobs = [_squeeze(pack(np.diff(at, prepend=0)), pack(np.array([len(w) for w in found])), b"".join(found)) for at, found in parts.values()]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(blobs), pa.int64()), pa.array(list(parts), pa.int32()), pa.array(blobs, pa.binary())], ["block", "bucket", "data"])

    return mapped(blocks, run, "block long, bucket int, data binary")


def _listed(sizes: bytes, joined: bytes) -> list[bytes]:
    size = unpack(sizes)
    ends = np.cumsum(size)
    return [joined[a:b] for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]


def _encoded(dealt: DataFrame, path: str) -> DataFrame:
    """block, data of blobs sorted by bucket: steps of numbers, counts of ids, ids, and decoded words.

    Within a bucket each distinct word, from however many blocks, is encoded
    once, and its ids meet the token-byte table once. A bucket's words are held
    until the next one: those of one bucket in twice ``spark.sql.shuffle.partitions``.
    """

    def run(batches):
        table, tokens = ranks(path), token_bytes(path)
        known: dict[bytes, tuple[list[int], bytes]] = {}
        last = None
        for batch in batches:
            blobs = []
            for bucket, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket != last:
                    last, known = bucket, {}
                at, *packed = _expand(blob.as_py())
                found = []
                for word in _listed(*packed):
                    one = known.get(word)
                    if one is None:
                        ids = merge(word, table)
                        one = known[word] = (ids, b"".join([tokens[k] for k in ids]))
                    found.append(one)
                sizes, back = (np.fromiter((len(x[k]) for x in found), np.int64, len(found)) for k in (0, 1))
                blobs.append(_squeeze(at, pack(sizes), pack(np.fromiter(chain.from_iterable(x[0] for x in found), np.uint32)), pack(back), b"".join([x[1] for x in found])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["block", "data"])

    return mapped(dealt, run, "block long, data binary")


def _documents(main: bytes, encoded: list[bytes]) -> Iterator[tuple]:
    """doc_id, number of ids, ids in decimal, decoded bytes of each document of a block."""
    valid, values, counts, sequence, words = _expand(main)
    n = int.from_bytes(words, "little")
    size = np.zeros(n, np.int64)
    decimal: list[bytes] = [b""] * n
    decoded: list[bytes] = [b""] * n
    for blob in encoded:
        at, lengths, ids, sizes, joined = _expand(blob)
        at, lengths, digits = np.cumsum(unpack(at)), unpack(lengths), [b"%d" % x for x in unpack(ids).tolist()]
        size[at] = lengths
        low = 0
        for r, m, back in zip(at.tolist(), lengths.tolist(), _listed(sizes, joined), strict=True):
            decimal[r], decoded[r] = b" ".join(digits[low : low + m]), back
            low += m
    if n and not size.min():
        raise RuntimeError("a word of a block was not encoded")
    ids, ok = np.frombuffer(values, np.int64).tolist(), np.frombuffer(valid, np.uint8).tolist()
    numbers = unpack(sequence)
    at = 0
    for k, m in enumerate(unpack(counts).tolist()):
        part = numbers[at : at + m]
        at += m
        pick = itemgetter(*part.tolist()) if m > 1 else lambda x, part=part: [x[r] for r in part]
        yield (ids[k] if ok[k] else None), int(size[part].sum()), b" ".join(pick(decimal)), b"".join(pick(decoded))


def encode_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Encode each text and decode the ids again.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for,
    ``ids`` (array) and ``decoded``.

    Texts are split into pre-tokens; within a block of BLOCK_BYTES of texts each
    distinct one gets a number, and positions are kept as these numbers. All
    distinct words of a block are dealt with their numbers to buckets by hash, a
    global shuffle in which equal words of all blocks meet. There each is encoded
    once, and its ids meet the token-byte table, which has the vocabulary's fixed
    size and is held by each worker. Ids and bytes go back to the blocks by an
    equi-join, where documents are put together by position. Blocks and words come from one shuffle, whose partitions follow
    from bytes. A word in every document is one entry a block.

    Null is empty text and gives no ids; a row with a null or repeated doc_id
    gives its own row. Texts of any length are encoded whole. Special tokens
    are ordinary text. Other columns are ignored; no rows give no rows.
    """
    path = path or tokenizer_path()
    spark = docs.sparkSession
    buckets = 2 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Both uses take all columns, so that no pruning makes two shuffles of this one.
    blocks = blocks_of(docs).repartition("block")
    dealt = _dealt(blocks, buckets).repartition("bucket").sortWithinPartitions("bucket")
    encoded = _encoded(dealt, path).groupBy("block").agg(F.collect_list("data").alias("encoded"))
    gathered = blocks.join(encoded, "block", "left").select("main", "words", "encoded")
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
        kinds += ", ids array<int>, decoded string"

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows = []
                for key, n, decimal, decoded in _documents(batch.column(0)[k].as_py(), batch.column(2)[k].as_py() or []):
                    row = (key, n, hashlib.sha256(decimal).hexdigest(), hashlib.sha256(decoded).hexdigest())
                    rows.append(row + ((list(map(int, decimal.split())), decoded.decode()) if keep_ids else ()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [f for f, _ in fields])

    return mapped(gathered, run, kinds)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"))
