"""Secret scans: fixed patterns, and a character convolutional network in numpy, trained in Spark tasks on every labelled finding and asked about every candidate."""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.kernel import mapped
from loomspan.plans.lineage import read, shared_folder

# Fixed values of the base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "cnn")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20
_KEYWORDS = ("passw", "secret", "token", "api")

#: A candidate: a run of secret-like characters with a digit and a letter, with both cases inside, or of 16 or more whatever they are.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
_MIXED = re.compile(r"[a-z].*[A-Z]|[A-Z]{2}.*[a-z]|[A-Z].*[a-z].*[A-Z]")
#: Runs that are ordinary by their form: host names, words before a full stop or before that and a number, and numbers.
_ORDINARY = re.compile(r"(?:[a-z][a-z-]*[0-9]?\.)+[a-z]{2,6}|[A-Za-z]?[a-z]+\.[0-9]{1,4}|[A-Za-z]?[a-z]+\.?|[A-Z]+\.?|[0-9]+")
_LONG_WORD = re.compile(r"\S{12,}")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
#: Characters of a piece of a candidate, and of the text on each side of it, that the network sees.
SEEN, CONTEXT = 48, 24
WIDTH = SEEN + 2 * CONTEXT
#: Characters from a piece of a longer candidate to the next, and pieces scored at once.
STEP, AT_ONCE = 24, 4096
#: Kinds of labelled findings; all but the first are secrets. How many of each are in a batch.
ORDINARY, BASE, MADE = range(3)
SHARES = (48, 8, 40)
#: Rounds of training at most, each on a slice of the findings; findings of a task of a round; batches at least, of all rounds.
SLICES, PART, STEPS = 12, 8192, 400
#: Adam's first step, and what is left of it in the last round.
RATE, LEAST_RATE = 0.01, 0.002
#: Fixed point of sums over tasks, which are then the same in any order.
POINT = 2.0**32
#: The share of labelled secrets of each kind in the calibration fold that the threshold must reach.
RECALL = 0.98
#: Log odds are counted by steps of this part of one, up to 40 on both sides.
LEVELS, MOST_ODDS = 64, 40
_CLASSES = 12


def _class_table() -> np.ndarray:
    """Characters as classes: a few letters of hexadecimal and keywords apart, then lower, upper, digits, marks."""
    out = np.full(128, 1, np.uint8)
    for i in range(128):
        c = chr(i)
        if c in "abcdef":
            out[i] = 2
        elif c.islower():
            out[i] = 3
        elif c in "ABCDEF":
            out[i] = 4
        elif c.isupper():
            out[i] = 5
        elif c.isdigit():
            out[i] = 6
        elif c in ":=":
            out[i] = 7
        elif c in "\"'":
            out[i] = 8
        elif c in "+/":
            out[i] = 9
        elif c in "-_.":
            out[i] = 10
        elif c.isspace():
            out[i] = 11
    return out


_TABLE = _class_table()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, leftmost and non-overlapping within a kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if len(s) >= 16 or (_DIGIT.search(s) and _LETTER.search(s)) or _MIXED.search(s):
            out.append(m.span())
    return out


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """A candidate as overlapping pieces of at most SEEN characters, which reach all of it."""
    last = end - SEEN
    if last <= start:
        return [(start, end)]
    return [(s, s + SEEN) for s in [*range(start, last, STEP), last]]


def _seen(before: str, piece: str, after: str) -> str:
    """WIDTH characters: a piece with the CONTEXT characters before and after it."""
    return before[-CONTEXT:].rjust(CONTEXT, "\0") + piece.ljust(SEEN, "\0") + after[:CONTEXT].ljust(CONTEXT, "\0")


def _place(text: str, start: int, end: int) -> str:
    return _seen(text[max(0, start - CONTEXT) : start], text[start:end], text[end : end + CONTEXT])


def _classes(seen: list[str]) -> np.ndarray:
    """Classes of characters, a row for each string of WIDTH."""
    codes = np.frombuffer("".join(seen).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, WIDTH)
    out = np.where(codes < 128, _TABLE[np.minimum(codes, 127)], 1).astype(np.uint8)
    out[codes == 0] = 0
    return out


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Classes of the context before a piece, of its own characters, and of the context after it."""
    return _classes([_place(text, start, end)])[0]


class Covered:
    """The places that base findings cover, as disjoint spans."""

    def __init__(self, base: list[tuple[int, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, _, e in base:
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, span: tuple[int, int]) -> bool:
        k = bisect.bisect_right(self.ends, span[0])
        return k < len(self.starts) and self.starts[k] < span[1]


@dataclass(frozen=True)
class CharNet:
    """Convolution, ReLU, largest and mean over positions, a hidden layer, a logit; then calibration and a threshold."""

    kernel: np.ndarray  # width * classes, filters
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    span: int = 5

    def columns(self, codes: np.ndarray) -> np.ndarray:
        """One-hot windows: rows * positions, span * classes."""
        hot = np.eye(_CLASSES, dtype=np.float32)[codes]
        row, sign, one = hot.strides
        view = np.lib.stride_tricks.as_strided(hot, (len(codes), WIDTH - self.span + 1, self.span * _CLASSES), (row, sign, one), writeable=False)
        return np.ascontiguousarray(view).reshape(-1, self.span * _CLASSES)

    def forward(self, codes: np.ndarray):
        """Windows, activations (filters, rows, positions), pooled values, hidden layer, logits."""
        x = self.columns(codes)
        act = self.kernel.T @ x.T
        act += self.bias[:, None]
        np.maximum(act, 0, out=act)
        act = act.reshape(len(self.bias), len(codes), -1)
        pooled = np.concatenate([act.max(2), act.mean(2)]).T
        mid = np.maximum(pooled @ self.hidden + self.hidden_bias, 0)
        return x, act, pooled, mid, mid @ self.out + self.out_bias

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *[self.forward(codes[i : i + 128])[-1] for i in range(0, len(codes), 128)]])

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(codes) + self.shift, -40, 40)))


@dataclass(frozen=True)
class Descent:
    """Where a training stands: weights, Adam's two moments of each, and the batches so far."""

    weights: list[np.ndarray]
    first: list[np.ndarray]
    second: list[np.ndarray]
    batches: float = 0.0

    def net(self, **more) -> CharNet:
        return CharNet(*self.weights[:5], float(self.weights[5][0]), **more)

    def flat(self) -> np.ndarray:
        """All in one row; second moments by their roots, which are not too small for POINT."""
        return np.concatenate([x.ravel() for x in (*self.weights, *self.first, *map(np.sqrt, self.second))] + [[self.batches]]).astype(float)

    def filled(self, flat: np.ndarray) -> Descent:
        """The same shapes with other numbers."""
        out, at = [], 0
        for x in (*self.weights, *self.first, *self.second):
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        n = len(self.weights)
        return Descent(out[:n], out[n : 2 * n], [x * x for x in out[2 * n :]], float(flat[-1]))


def begin(filters: int = 24, hidden: int = 16, seed: int = 7) -> Descent:
    rng = np.random.default_rng(seed)
    d = 5 * _CLASSES
    p = [rng.normal(0, d**-0.5, (d, filters)), np.zeros(filters), rng.normal(0, (2 * filters) ** -0.5, (2 * filters, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    p = [x.astype(np.float32) for x in p]
    return Descent(p, [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p])


def descend(start: Descent, codes: np.ndarray, kinds: np.ndarray, steps: int, rate: float, seed: int) -> Descent:
    """Adam over batches with SHARES of each kind: every finding is in a batch, those of rarer kinds in more, and there are at least ``steps``."""
    rng = np.random.default_rng(seed)
    own = [(np.flatnonzero(kinds == k), share) for k, share in enumerate(SHARES)]
    own = [(at, share) for at, share in own if len(at)]
    steps = max([steps, *[-(-len(at) // share) for at, share in own]])
    dealt = [np.concatenate([rng.permutation(at) for _ in range(-(-steps * share // len(at)))])[: steps * share].reshape(steps, share) for at, share in own]
    p, first, second = list(start.weights), list(start.first), list(start.second)
    filters, t = len(p[1]), start.batches
    for part in np.concatenate(dealt, 1):
        t += 1
        x, act, pooled, mid, logit = Descent(p, first, second).net().forward(codes[part])
        g = ((1 / (1 + np.exp(-np.clip(logit, -40, 40))) - (kinds[part] > ORDINARY)) / len(part)).astype(np.float32)
        dmid = np.outer(g, p[4]) * (mid > 0)
        dpool = (dmid @ p[2].T).T
        dact = np.repeat((dpool[filters:] / np.float32(act.shape[2]))[:, :, None], act.shape[2], 2)
        top = act.argmax(2)[:, :, None]
        np.put_along_axis(dact, top, np.take_along_axis(dact, top, 2) + dpool[:filters, :, None], 2)
        dact *= act > 0
        dact = dact.reshape(filters, -1)
        grads = [(dact @ x).T, dact.sum(1), pooled.T @ dmid, dmid.sum(0), mid.T @ g, g.sum(keepdims=True)]
        for k, grad in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad * grad
            p[k] = p[k] - np.float32(rate) * (first[k] / np.float32(1 - 0.9**t)) / (np.sqrt(second[k] / np.float32(1 - 0.999**t)) + np.float32(1e-8))
    return Descent(p, first, second, t)


def _fold(codes: np.ndarray) -> np.ndarray:
    """The calibration fold: a quarter, chosen by the value without its context."""
    return np.array([zlib.crc32(c[CONTEXT : CONTEXT + SEEN].tobytes()) % 4 == 0 for c in codes], bool)


def _levels(net: CharNet, codes: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(net.logits(codes), -MOST_ODDS, MOST_ODDS) * LEVELS).astype(np.int32)


def _calibrated(stand: Descent, kinds: np.ndarray, levels: np.ndarray, n: np.ndarray) -> CharNet:
    """Platt scaling and threshold from how many findings of each kind have log odds of each level."""
    slope, shift = _platt((levels + 0.5) / LEVELS, (kinds > ORDINARY).astype(float), n.astype(float))
    return stand.net(slope=slope, shift=shift, threshold=_threshold(slope * levels / LEVELS + shift, kinds, n, slope / LEVELS))


def train(codes: np.ndarray, y: np.ndarray, filters: int = 24, hidden: int = 16, steps: int = STEPS, seed: int = 7) -> CharNet:
    """``learn`` in one task on findings at hand: three quarters train, the rest calibrates and sets the threshold.

    Findings of one label alone give a network that adds nothing.
    """
    stand = begin(filters, hidden, seed)
    if len(set(y.tolist())) < 2:
        return stand.net(threshold=2.0)
    held = _fold(codes)
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    stand = descend(stand, codes[~held], y[~held], steps, RATE, seed)
    fold = held if held.any() else np.ones(len(y), bool)
    found, n = np.unique(np.stack([y[fold], _levels(stand.net(), codes[fold])]), axis=1, return_counts=True)
    return _calibrated(stand, *found, n)


def _threshold(odds: np.ndarray, kinds: np.ndarray, n: np.ndarray | None = None, width: float = 0.0) -> float:
    """Of the thresholds that find RECALL of the secrets of each kind, one of the highest precision, amid the gap of log odds in which nothing changes.

    ``n`` findings have log odds from ``odds`` up to ``width`` more.
    """
    order = np.argsort(-odds, kind="stable")
    odds, kinds, n = odds[order], kinds[order], np.ones(len(odds), np.int64) if n is None else n[order]
    last = np.append(odds[1:] < odds[:-1], True)  # a threshold can't part equal odds
    for k in set(kinds[kinds > ORDINARY].tolist()):
        found = np.cumsum(n * (kinds == k))
        last &= found >= RECALL * found[-1]
    precision = np.where(last, np.cumsum(n * (kinds > ORDINARY)) / np.cumsum(n), -1)
    k = len(odds) - 1 - int(np.argmax(precision[::-1]))
    middle = (odds[k] + odds[k + 1] + width) / 2 if k + 1 < len(odds) else odds[k] - 1e-6
    return float(1 / (1 + np.exp(-middle)))


def _platt(logit: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    slope, shift = 1.0, 0.0
    ones, zeros = (n * y).sum(), (n * (1 - y)).sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(slope * logit + shift, -40, 40)))
        w = n * np.maximum(q * (1 - q), 1e-6)
        # A pull to the network's own odds keeps separable findings finite.
        g = np.array([(n * (q - target) * logit).sum() + 5 * (slope - 1), (n * (q - target)).sum() + 5 * shift])
        h = np.array([[(w * logit * logit).sum() + 5, (w * logit).sum()], [(w * logit).sum(), w.sum() + 5]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - 0.5 * step[0], shift - 0.5 * step[1]
    return float(max(slope, 1e-3)), float(shift)


#: Alphabets of keys: of 62 letters and digits, of base64 and its form for addresses, of one case and digits, of letters, and hexadecimal.
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALPHABETS = (_LOWER + _UPPER + _DIGITS, _LOWER + _UPPER + _DIGITS + "+/", _LOWER + _UPPER + _DIGITS + "-_", _UPPER + _DIGITS, _LOWER + _DIGITS, _LOWER + _UPPER, _DIGITS + "abcdef")


_SIGNS = tuple(bytes(ord(signs[b % len(signs)]) for b in range(256)) for signs in _ALPHABETS)


def made_key(seed: str) -> str:
    """A random-looking key of 16 to 48 characters that follows from the seed."""
    raw = hashlib.blake2b(seed.encode("utf-8", "surrogatepass")).digest()
    return raw[2 : 18 + raw[1] % 33].translate(_SIGNS[raw[0] % len(_SIGNS)]).decode()


def labelled_findings(docs: DataFrame, most: int | None = None) -> DataFrame:
    """All labelled findings of all texts: kind, y, codes. With ``most``, for looks at them, at most about that many of each label from a task.

    Values that a base pattern marks are secrets. Ordinary are, outside all base
    findings, candidates of an ordinary form (see _ORDINARY), and all long words
    that hold no candidate. Other candidates have no label and are not trained
    on. Each finding counts with its context and without, and in the place of
    each long word a made key counts as a secret, so that neither keywords nor
    one alphabet stand for secrets. A finding has a row for each time it occurs.
    """

    def run(batches):
        seen: list[str] = []
        kinds: list[int] = []
        left = [most, most]

        def rows():
            codes, kind = _classes(seen), np.array(kinds, np.int32)
            bare = codes[kind != MADE]
            bare[:, :CONTEXT] = bare[:, CONTEXT + SEEN :] = 0
            codes, kind = np.concatenate([codes, bare]), np.concatenate([kind, kind[kind != MADE]])
            seen.clear()
            kinds.clear()
            if most is not None:
                keep = np.zeros(len(kind), bool)
                for y in (0, 1):
                    at = np.flatnonzero((kind > ORDINARY) == y)[: left[y]]
                    left[y] -= len(at)
                    keep[at] = True
                codes, kind = codes[keep], kind[keep]
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), len(codes), [None, pa.py_buffer(codes.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(kind), pa.array((kind > ORDINARY).astype(np.int32)), raw.cast(pa.binary())], ["kind", "y", "codes"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                base = base_spans(text)
                covered = Covered(base)
                found = {}
                for finding in base:
                    s, e = value_span(text, *finding)
                    if e - s >= 12:
                        found |= dict.fromkeys(pieces(s, e), BASE)
                asked = candidates(text)
                for s, e in asked:
                    if not covered.meets((s, e)) and _ORDINARY.fullmatch(text, s, e):
                        found |= dict.fromkeys(pieces(s, e), ORDINARY)
                held = Covered([(s, 0, e) for s, e in asked])
                for m in _LONG_WORD.finditer(text):
                    s, e = m.span()
                    if not covered.meets((s, e)) and not held.meets((s, e)):
                        found |= dict.fromkeys(pieces(s, e), ORDINARY)
                        seen.append(_seen(text[max(0, s - CONTEXT) : s], made_key(m[0]), text[e : e + CONTEXT]))
                        kinds.append(MADE)
                for (s, e), kind in found.items():
                    seen.append(_place(text, s, e))
                    kinds.append(kind)
                    if len(seen) >= AT_ONCE:
                        yield rows()
        if seen:
            yield rows()

    return mapped(docs.select(F.coalesce(F.col("text").cast("string"), F.lit(""))), run, "kind int, y int, codes binary")


def _array(codes: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, WIDTH)


def _round(found: DataFrame, stand: Descent, parts: int, steps: int, rate: float) -> Descent:
    """Each of ``parts`` tasks goes on from ``stand`` over all of its findings; then the mean of where they come to."""

    def run(table: pa.Table) -> pa.Table:
        codes, kinds = _array(table.column("codes")), table.column("kind").to_numpy()
        order = np.lexsort((codes.view(f"S{WIDTH}").ravel(), kinds))
        flat = descend(stand, codes[order], kinds[order], steps, rate, int(stand.batches)).flat()
        return pa.table({"place": pa.array(np.arange(len(flat), dtype=np.int32)), "value": pa.array(np.rint(flat * POINT).astype(np.int64))})

    dealt = found.withColumn("part", F.pmod(F.xxhash64("codes", F.lit(1)), F.lit(parts))).groupBy("part").applyInArrow(run, "place int, value long")
    rows = dealt.groupBy("place").agg(F.sum("value").alias("value"), F.count("*").alias("n")).collect()
    flat = np.zeros(len(rows))
    for r in rows:
        flat[r["place"]] = r["value"] / r["n"] / POINT
    return stand.filled(flat)


def _tally(found: DataFrame, net: CharNet):
    """Counts of all findings by kind and level of log odds."""

    def run(batches):
        for batch in batches:
            if len(batch):
                (kind, level), n = np.unique(np.stack([batch.column(0).to_numpy(), _levels(net, _array(batch.column(1)))]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(level), pa.array(n)], ["kind", "level", "n"])

    rows = mapped(found.select("kind", "codes"), run, "kind int, level int, n long").groupBy("kind", "level").agg(F.sum("n").alias("n")).collect()
    return np.array([tuple(r) for r in rows], np.int64).reshape(-1, 3).T


def learn(docs: DataFrame, part: int = PART) -> CharNet:
    """Train, calibrate and set the threshold on all distinct labelled findings of all texts.

    A quarter, chosen by value, is kept for calibration and threshold, of which
    all log odds are counted. The others are dealt to rounds by hash, and those
    of a round to tasks of about ``part``; each task goes on from the mean of the
    round before. Which findings a task has, and their order, follow from the
    findings alone, and sums over tasks are exact. The driver gets weights and
    counts of levels, whose size is fixed. Findings of one label alone give a
    network that adds nothing.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "findings")
    held = F.crc32(F.substring("codes", CONTEXT + 1, SEEN)) % 4 == 0
    distinct = labelled_findings(docs).select("kind", "codes").distinct()
    dealt = distinct.withColumn("slice", F.when(held, SLICES).otherwise(F.pmod(F.xxhash64("codes"), F.lit(SLICES))).cast("int"))
    try:
        dealt.write.option("compression", "zstd").partitionBy("slice").parquet(folder)
        return _learned(spark.read.schema("kind int, codes binary, slice int").parquet(folder), part)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _learned(found: DataFrame, part: int) -> CharNet:
    """``learn`` from findings dealt to slices, of which the last is for calibration."""
    counts = {(r["slice"], r["kind"]): r["count"] for r in found.groupBy("slice", "kind").count().collect()}

    def both(slices) -> bool:
        return len({k > ORDINARY for s, k in counts if s in slices}) == 2

    every = range(SLICES + 1)
    if not both(every):
        return begin().net(threshold=2.0)
    learned, fold = (range(SLICES), [SLICES]) if both([SLICES]) and both(range(SLICES)) else (every, every)
    n = sum(c for (s, _), c in counts.items() if s in learned)
    rounds = min(SLICES, -(-n // part))
    parts = max(1, round(n / rounds / part))
    stand = begin()
    for k in range(rounds):
        own = [s for s in learned if s * rounds // len(learned) == k]
        rate = RATE + (LEAST_RATE - RATE) * k / max(1, rounds - 1)
        stand = _round(found.where(F.col("slice").isin(own)), stand, parts, -(-STEPS // rounds), rate)
    return _calibrated(stand, *_tally(found.where(F.col("slice").isin(list(fold))), stand.net()))


def value_span(text: str, start: int, kind: int, end: int) -> tuple[int, int]:
    """Where the value of a base finding lies: of an assignment what is assigned, else all of it."""
    return ASSIGN.match(text, start).span(2) if kind == 0 else (start, end)


def scan(docs: DataFrame, net: CharNet) -> DataFrame:
    """Findings of each text: doc_id, n_assign, n_access, n_hex, n_cnn, n_scored, n_doubtful, base_sha256, spans.

    The network scores every piece of every candidate, those that base findings
    cover by the finding's value, with its context on both sides. Candidates
    outside base findings with a piece at the threshold are added with kind
    ``cnn``. Base findings always stay; those with no piece at the threshold
    count in n_doubtful. n_scored is how many candidates and values were scored.
    Spans are kind:start:end in code points, sorted by start and kind. Null is empty
    text; a row with a null or repeated doc_id gives its own row; texts are
    scanned whole. Other columns are ignored. Map-side only.
    """
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_cnn", "n_scored", "n_doubtful", "base_sha256", "spans"]

    def line(spans) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)

    def run(batches):
        for batch in batches:
            bases, added, asked, seen = [], [], [], []
            sure: list[set] = []
            n_scored: list[int] = []

            def score():
                if seen:
                    for (i, span, own), q in zip(asked, net.probability(_classes(seen)), strict=True):
                        if q >= net.threshold:
                            (sure[i] if own else added[i]).add(span)
                asked.clear()
                seen.clear()

            for i, text in enumerate(batch.column(1).to_pylist()):
                base = base_spans(text)
                bases.append(base)
                added.append(set())
                sure.append(set())
                covered = Covered(base)
                spans = [(span, False) for span in candidates(text) if not covered.meets(span)] + [(value_span(text, *f), True) for f in base]
                n_scored.append(len(spans))
                for span, own in spans:
                    for piece in pieces(*span):
                        asked.append((i, span, own))
                        seen.append(_place(text, *piece))
                        if len(seen) == AT_ONCE:
                            score()
            score()
            texts_ = batch.column(1).to_pylist()
            counts = [[sum(k == kind for _, k, _ in base) for base in bases] for kind in range(3)]
            counts += [[len(a) for a in added], n_scored, [sum(value_span(t, *f) not in ok for f in base) for t, base, ok in zip(texts_, bases, sure, strict=True)]]
            spans = [line(sorted([*b, *[(s, 3, e) for s, e in a]])) for b, a in zip(bases, added, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array([hashlib.sha256(line(b).encode()).hexdigest() for b in bases], pa.string()), pa.array(spans, pa.string())], names)

    source = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return mapped(source, run, "doc_id long, n_assign long, n_access long, n_hex long, n_cnn long, n_scored long, n_doubtful long, base_sha256 string, spans string")


def op7_char_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, learn(docs))
