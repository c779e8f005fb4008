"""Vector indexes as Parquet: cells as partitions, packed codes beside the vectors, and search that reads the cells in question."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.operators.retrieval import packed, quantise, top_of_blocks

#: Cells of an index at most, and numbers of the sample that they are learned on (64 MB): both are held by the driver.
MAX_CELLS, SAMPLE_NUMBERS = 4096, 1 << 23
_ROWS = 4096


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def learn_cells(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Unit centres by k-means on directions; cells that lose all rows keep their centre."""
    if not len(sample):
        return sample
    x = unit(sample)
    centres = x[np.random.default_rng(seed).permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        of = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        held = np.linalg.norm(sums, axis=1) > 1e-12
        centres[held] = unit(sums[held])
    return centres


def _per_byte(bits: int) -> int:
    return 8 // bits


def pack(codes: np.ndarray, bits: int) -> np.ndarray:
    """Codes of 2 to 4 bits, as many as fit into a byte; a row's last byte is filled with zeros."""
    per = _per_byte(bits)
    n, size = codes.shape
    wide = np.zeros((n, -(-size // per) * per), np.uint8)
    wide[:, :size] = codes
    out = np.zeros((n, wide.shape[1] // per), np.uint8)
    for k in range(per):
        out |= wide[:, k::per] << np.uint8(bits * k)
    return out


def lookup(query: np.ndarray, bits: int) -> np.ndarray:
    """What each value of each packed byte adds to the product with the query."""
    per, top = _per_byte(bits), (1 << bits) - 1
    byte = np.arange(256)[:, None] >> (bits * np.arange(per))[None, :] & top
    wide = np.zeros(-(-len(query) // per) * per)
    wide[: len(query)] = query
    return wide.reshape(-1, per) @ (byte / (top / 2) - 1).T


@dataclass(frozen=True)
class VectorIndex:
    """Vectors by cells, the last complete version under a path.

    ``rows`` are partitioned by cell: key, vector, and packed codes with the
    length of what they stand for. ``cells`` has each cell's centre, number of
    rows and the widest angle of a row to it. A version is seen once its row is
    in ``versions``, a single file that comes last; one that stops before leaves
    the old.
    """

    spark: SparkSession
    path: str
    key: str = "id"
    vector: str = "embedding"

    def build(self, vectors: DataFrame, cells: int | None = None, bits: int = 4) -> int:
        """Write a version of ``vectors`` and return its number.

        Cells, by default the square root of the rows' number, are learned on a
        sample of at most SAMPLE_NUMBERS numbers, chosen by the keys' hash; every
        row is indexed. A cell that holds most rows is written by several tasks.
        Rows with a null key or vector are left out; no rows give an index
        without cells. Other columns stay with the rows.
        """
        if not 2 <= bits <= 4:
            raise ValueError("2 to 4 bits")
        known = vectors.where(F.col(self.key).isNotNull() & F.col(self.vector).isNotNull())
        size, n = known.agg(F.max(F.size(self.vector)), F.count("*")).first()
        version = self._last()[0] + 1
        at = f"{self.path}/v{version}"
        wanted = min(MAX_CELLS, cells or max(1, round((n or 0) ** 0.5)))
        most = max(wanted, min(64 * wanted, SAMPLE_NUMBERS // max(1, size or 1)))
        chosen = known.where(F.pmod(F.xxhash64(self.key), F.lit(1_000_000)) < int(1_200_000 * most / max(1, n)) + 1).select(self.vector).limit(most)
        sample = np.array([r[0] for r in chosen.collect()] or [r[0] for r in known.select(self.vector).limit(1).collect()], np.float64).reshape(-1, size or 1)
        if n and not len(sample):
            raise RuntimeError("vectors changed while they were read")
        centres = learn_cells(sample, wanted)
        shared = self.spark.sparkContext.broadcast(centres)
        names = [c for c in known.columns if c != "cell"]
        place = names.index(self.vector)

        def run(batches):
            for batch in batches:
                x = np.array(batch.column(place).to_pylist(), np.float64).reshape(batch.num_rows, -1)
                near = unit(x) @ shared.value.T
                cell = np.argmax(near, axis=1) if near.size else np.zeros(0, np.int64)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                codes = np.array(batch.column(len(names)).to_pylist(), np.uint8).reshape(batch.num_rows, -1)
                length = np.linalg.norm(codes / (((1 << bits) - 1) / 2) - 1, axis=1)
                code = pa.array([c.tobytes() for c in pack(codes, bits)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], code, pa.array(length), pa.array(angle), pa.array(cell.astype(np.int32))], [*names, "codes", "length", "angle", "cell"])

        kinds = dict(known.dtypes)
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", codes binary, length double, angle double, cell int"
        coded = known.select(*names).withColumn("_codes", quantise(F.col(self.vector), bits))
        coded.mapInArrow(run, schema).hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(f"{at}/rows")
        held = self.spark.read.schema(schema).parquet(f"{at}/rows").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
        centre = self.spark.createDataFrame([(k, [float(v) for v in c]) for k, c in enumerate(centres)] if n else [], "cell int, centre array<double>")
        held.join(centre, "cell").coalesce(1).write.parquet(f"{at}/cells")
        self.spark.createDataFrame([(version, bits, schema)], "version int, bits int, columns string").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        return version

    def _last(self) -> tuple[int, int, str]:
        """The number, bits and columns of the last complete version."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return 0, 4, ""
        return tuple(self.spark.read.schema("version int, bits int, columns string").parquet(f"{self.path}/versions").orderBy(F.desc("version")).first())

    def rows(self) -> DataFrame:
        version, _, columns = self._last()
        return self.spark.read.schema(columns).parquet(f"{self.path}/v{version}/rows")

    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self._last()[0]}/cells")

    def _asked(self, queries: DataFrame, query_key: str, probes: int | None, least: str | None = None) -> DataFrame:
        """cell, query_key, vector: the ``probes`` nearest cells of each query; or, with a column ``least``, all beyond these that may hold as near a row."""
        held = self.cells().orderBy("cell").collect()
        known = queries.where(F.col(query_key).isNotNull() & F.col(self.vector).isNotNull())
        kind, vector = dict(queries.dtypes)[query_key], self.vector
        cell = np.array([r["cell"] for r in held], np.int32)
        shared = self.spark.sparkContext.broadcast((np.array([r["centre"] for r in held], np.float64), np.array([r["radius"] for r in held]), cell))

        def run(batches):
            centres, radius, cell = shared.value
            for batch in batches:
                if not len(cell) or not batch.num_rows:
                    continue
                x = unit(np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1))
                angle = np.arccos(np.clip(x @ centres.T, -1, 1))
                rank = np.argsort(np.argsort(angle, axis=1, kind="stable"), axis=1, kind="stable")
                near = rank < (len(cell) if probes is None else probes)
                if least is not None:
                    # No row of a cell is nearer than the angle to its centre less its radius, and no similarity is below 0.
                    bound = np.maximum(0.0, np.cos(np.maximum(0.0, angle - radius - 1e-9)))
                    near = ~near & (bound + 1e-8 >= batch.column(2).to_numpy()[:, None])
                q, c = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(cell[c]), batch.column(0).take(pa.array(q)), batch.column(1).take(pa.array(q)).cast(pa.list_(pa.float64()))], ["cell", query_key, vector])

        return known.select(query_key, F.col(self.vector).cast("array<double>").alias(self.vector), *([least] if least else [])).mapInArrow(run, f"cell int, `{query_key}` {kind}, `{self.vector}` array<double>")

    def _probed(self, asked: DataFrame) -> DataFrame:
        """The rows of the cells that are asked for: a partition filter, of at most MAX_CELLS numbers."""
        return self.rows().where(F.col("cell").isin([r["cell"] for r in asked.select("cell").distinct().collect()]))

    def _nearest(self, asked: DataFrame, k: int, query_key: str, kind: str) -> DataFrame:
        held = self._probed(asked)
        q = packed(asked.repartition("cell"), query_key, self.vector, "cell").withColumnsRenamed({"keys": "asked", "matrix": "q"})
        pairs = packed(held, self.key, self.vector, "cell").join(q, "block").select("keys", "matrix", "asked", "q")
        return top_of_blocks(pairs, k, self.key, query_key, (dict(held.dtypes)[self.key], kind))

    def search(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, query_key: str = "query_id") -> DataFrame:
        """The k nearest rows of each query by cosine: query_key, key, similarity; ties by key.

        Each query meets the rows of its ``probes`` nearest cells, all others are
        not read. ``exact`` reads, in a second step, the further cells whose
        bound, the angle to the centre less the cell's radius, lets them hold a
        row as near as a query's k-th, so that the result is that of a scan.
        Queries with a null key or vector take no part; an index without rows
        gives none.
        """
        from loomspan.plans.lineage import cut

        kind = dict(queries.dtypes)[query_key]
        found = cut(self._nearest(cut(self._asked(queries, query_key, probes)), k, query_key, kind))
        if not exact:
            return found
        least = found.groupBy(query_key).agg(F.when(F.count("*") >= k, F.min("similarity")).otherwise(-1.0).alias("least"))
        further = cut(self._asked(queries.join(least, query_key, "left").na.fill(-1.0, ["least"]), query_key, probes, "least"))
        every = found.unionByName(self._nearest(further, k, query_key, kind))
        w = Window.partitionBy(query_key).orderBy(F.desc("similarity"), self.key)
        return every.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")

    def search_codes(self, queries: DataFrame, k: int, probes: int | None = None, quantised_query: bool = False, query_key: str = "query_id") -> DataFrame:
        """The k nearest rows of each query by their codes, in the ``probes`` nearest cells or all; vectors are not read.

        A query has a table of what each byte of codes adds to its product with a
        row, so a row costs one look-up a byte. The query itself is taken as it
        is, or with ``quantised_query`` in as few bits as the rows.
        """
        from loomspan.plans.lineage import cut

        key, bits, kind = self.key, self._last()[1], dict(queries.dtypes)[query_key]
        asked = cut(self._asked(queries, query_key, probes))
        held = self._probed(asked).select(self.key, "codes", "length", "cell")
        key_kind = dict(held.dtypes)[self.key]

        def gather(batches):
            for batch in batches:
                cell = batch.column(3).to_numpy()
                for c in np.unique(cell):
                    own = np.flatnonzero(cell == c)
                    for i in range(0, len(own), _ROWS):
                        part = pa.array(own[i : i + _ROWS])
                        lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), batch.column(j).take(part)) for j in (0, 2)]
                        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), *lists, pa.array([b"".join(batch.column(1).take(part).to_pylist())], pa.binary())], ["cell", "keys", "lengths", "codes"])

        top = (1 << bits) - 1
        q = asked.withColumn("_q", F.transform(quantise(F.col(self.vector), bits), lambda c: c / F.lit(top / 2) - 1) if quantised_query else F.col(self.vector))
        pairs = held.mapInArrow(gather, f"cell int, keys array<{key_kind}>, lengths array<double>, codes binary").join(q, "cell").select(query_key, "_q", "keys", "lengths", "codes")

        def run(batches):
            for batch in batches:
                for r in range(batch.num_rows):
                    x = np.array(batch.column(1)[r].as_py(), np.float64)
                    keys, length = batch.column(2)[r].values, batch.column(3)[r].values.to_numpy()
                    codes = np.frombuffer(batch.column(4)[r].as_buffer(), np.uint8).reshape(len(keys), -1)
                    table = lookup(x, bits)
                    s = table[np.arange(codes.shape[1])[None, :], codes].sum(axis=1) / np.maximum(length * np.linalg.norm(x), 1e-300)
                    s = np.round(np.maximum(0, s), 9)
                    order = np.argsort(keys.to_numpy(zero_copy_only=False), kind="stable")
                    best = order[np.argsort(-s[order], kind="stable")[:k]]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r] * len(best), pa.int64())), keys.take(pa.array(best)), pa.array(s[best])], [query_key, key, "similarity"])

        found = pairs.mapInArrow(run, f"`{query_key}` {kind}, `{self.key}` {key_kind}, similarity double")
        w = Window.partitionBy(query_key).orderBy(F.desc("similarity"), self.key)
        return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
