"""Vectors in cells: a kept table that is searched cell by cell, and a join of a whole table above a similarity.

Cells are those of pivots, fitted by k-means on a bounded sample; every vector
is put into the cell of its nearest pivot.  Similarity is the cosine, so
vectors are taken at length 1 and zeros are like nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.operators.best_first import best_first
from loomwork.operators.search import PRODUCTS, QUERY_BLOCK, _matrix
from loomwork.plans.storage import materialize
from loomwork.plans.versions import Versions

#: Vectors that pivots and codes are fitted on, and pivots at most.
SAMPLE, PIVOTS = 8_192, 1_024
#: Vectors of a part of which a task compares two; smaller tables have smaller parts, down to SMALL.
CHUNK, SMALL = 32_768, 1_024
#: Queries of an exact search that are sent to all tasks at once, with a bit for each cell that they open.
ASKED = 4_096
#: Folders that cells are dealt over.
BANDS = 16
#: What rounding may move a distance.
SLACK = 1e-6


def _sample(vectors: DataFrame, key: str, vector: str) -> np.ndarray:
    """The vectors of the least hashes of keys, at most SAMPLE, at length 1."""
    some = vectors.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(SAMPLE).select(vector).toArrow().combine_chunks()
    return _matrix(some[vector].combine_chunks()) if some.num_rows else np.zeros((0, 1))


def fit_pivots(rows: np.ndarray, n: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """k-means: at most ``n`` pivots of these rows; a pivot that loses all its rows stays where it is."""
    n = min(n, len(rows))
    pivots = rows[np.random.default_rng(seed).permutation(len(rows))[:n]].copy()
    for _ in range(rounds if n else 0):
        nearest = _nearest(rows, pivots)
        sums, counts = np.zeros_like(pivots), np.bincount(nearest, minlength=n)
        np.add.at(sums, nearest, rows)
        pivots = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], pivots)
    return pivots


def _nearest(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.argmin((pivots * pivots).sum(axis=1) - 2 * rows @ pivots.T, axis=1)


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (rows * rows).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * rows @ pivots.T))


def _lists(matrix: np.ndarray, kind=pa.float64()) -> pa.ListArray:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, pa.array(matrix.ravel(), kind))


# A join of a whole table


def _homes(pivots):
    """(key, vector) to (key, home, distance to the pivot, vector at length 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(1))
            apart = _distances(rows, pivots.value) if batch.num_rows else np.zeros((0, 1))
            home = apart.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(home.astype(np.int32)), pa.array(apart.min(axis=1)), _lists(rows)], ["key", "home", "apart", "vector"])

    return run


def _replicas(known):
    """(key, home, vector) to a row per lower cell that may hold a vector within ``reach``, and one of its own cell.

    All vectors of a cell lie on its pivot's side of the plane between the two
    pivots and within its radius, so a vector further than ``reach`` from
    either has no partner there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radius, reach = known.value
        between = _distances(pivots, pivots)
        for batch in batches:
            rows, home = _matrix(batch.column("vector")), batch.column("home").to_numpy()
            apart = _distances(rows, pivots) if batch.num_rows else np.zeros((0, len(pivots)))
            own = apart[np.arange(len(rows)), home]
            plane = (apart**2 - own[:, None] ** 2) <= 2 * reach * between[home] + SLACK
            near = plane & (apart <= radius + reach + SLACK) & (np.arange(len(pivots)) < home[:, None])
            near[np.arange(len(rows)), home] = True
            at, cell = np.nonzero(near)
            part = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("home"), pa.array(cell.astype(np.int32)), part.column("vector")], ["key", "home", "cell", "vector"])

    return run


def _parts(pivots: np.ndarray, counts: np.ndarray, most: int) -> list[list[tuple[int, int]]]:
    """Cells in parts of at most ``most`` vectors, neighbours together: of each part its (cell, pieces of that cell); a cell of more is cut into pieces."""
    between, left, parts, size = _distances(pivots, pivots), set(np.flatnonzero(counts).tolist()), [], most + 1
    cell = min(left)
    while True:
        left.discard(cell)
        pieces = -(-int(counts[cell]) // most)
        if pieces > 1:
            parts += [[(cell, pieces)]] * pieces
            size = most + 1
        elif size + counts[cell] > most:
            parts.append([(cell, 1)])
            size = counts[cell]
        else:
            parts[-1].append((cell, 1))
            size += counts[cell]
        if not left:
            return parts
        cell = min(left, key=lambda c: between[cell, c])


def _compared(known, least: float):
    """Two parts' vectors (i, j, key, home, vector) to pairs (a, b, similarity), a < b; cells beyond reach of one another never meet."""

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        near_cells = known.value
        left, right = own["key"].to_numpy(), asked["key"].to_numpy()
        found: list[tuple] = [(left[:0], left[:0], np.zeros(0))]
        if own.num_rows and asked.num_rows:
            rows, asking = _matrix(own["vector"].combine_chunks()), _matrix(asked["vector"].combine_chunks())
            homes, asking_homes = own["home"].to_numpy(), asked["home"].to_numpy()
            same = own["i"][0] == own["j"][0]
            for cell in np.unique(asking_homes):
                here = np.flatnonzero(near_cells[cell][homes])
                block, ask = rows[here].T, np.flatnonzero(asking_homes == cell)
                step = max(1, PRODUCTS // max(1, len(here)))
                for k in range(0, len(ask), step):
                    some = ask[k : k + step]
                    near = asking[some] @ block
                    q, at = np.nonzero(near >= least)
                    x, y, value = right[some[q]], left[here[at]], near[q, at]
                    kept = x > y if same else slice(None)
                    found.append((x[kept], y[kept], value[kept]))
        x, y, value = (np.concatenate(c) for c in zip(*found))
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y), "similarity": value})

    return run


def classes(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, representative (the smallest key) of vectors that are equal in all numbers; nulls are left out."""
    named = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.xxhash64(vector).alias("h1"), F.xxhash64(F.lit(7), vector).alias("h2"))
    least = named.groupBy("h1", "h2").agg(F.min("key").alias("representative"))
    return named.join(least, ["h1", "h2"]).select("key", "representative")


def similar_vectors(vectors: DataFrame, key: str, vector: str, least: float, cells: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b, similarity) of representatives at cosine ``least`` (above 0) or more, and members (key, representative).

    Equal vectors are one representative.  Cells are put together in parts of
    at most CHUNK vectors, larger cells cut into such; two parts meet in one
    task if some of their cells are within reach, so a vector is sent once a
    part and no task holds more than two parts.  Keys are unique longs.
    """
    spark = vectors.sparkSession
    members = materialize(classes(vectors, key, vector), "members")
    chosen = members.select(F.col("representative").alias("key")).distinct()
    own = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector")).join(chosen, "key")
    own = materialize(own.where(F.exists("vector", lambda x: x != 0)), "distinct")
    n = own.count()
    rows = _sample(own, "key", "vector")
    pivots = fit_pivots(rows, cells or max(1, min(PIVOTS, int(np.sqrt(n)))))
    if not n:
        return spark.createDataFrame([], "a long, b long, similarity double"), members
    homes = materialize(own.mapInArrow(_homes(spark.sparkContext.broadcast(pivots)), "key long, home int, apart double, vector array<double>"), "homes")
    reach, radius, counts = float(np.sqrt(max(0.0, 2 - 2 * least))), np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in homes.groupBy("home").agg(F.max("apart").alias("radius"), F.count("*").alias("n")).collect():  # a row per pivot
        radius[r.home], counts[r.home] = r.radius, r.n
    near = _distances(pivots, pivots) <= radius[:, None] + radius[None] + reach + SLACK
    parts = _parts(pivots, counts, min(CHUNK, max(SMALL, -(-n // 16))))
    known = spark.sparkContext.broadcast(near)
    holds = np.zeros((len(parts), len(pivots)), np.float32)
    for part, cells_of in enumerate(parts):
        holds[part, [c for c, _ in cells_of]] = 1
    i, j = np.nonzero(np.triu(holds @ near.astype(np.float32) @ holds.T > 0))
    met = spark.createDataFrame(pa.table({"i": i.astype(np.int32), "j": j.astype(np.int32)}))  # of parts, which are as many as n / CHUNK and the pivots
    first = {c: part for part, cells_of in reversed(list(enumerate(parts))) for c, _ in cells_of}
    places = spark.createDataFrame([(c, first[c], m) for part in parts for c, m in part], "home int, first int, pieces int").distinct()
    placed = homes.join(F.broadcast(places), "home").select("key", "home", "vector", (F.col("first") + F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int")).alias("part"))
    placed = materialize(placed, "placed")
    dealt = lambda side: placed.withColumnRenamed("part", side).join(F.broadcast(met), side).select(*[F.col(c).alias(c) for c in ("i", "j", "key", "home", "vector")])
    pairs = dealt("i").groupBy("i", "j").cogroup(dealt("j").groupBy("i", "j")).applyInArrow(_compared(known, least), "a long, b long, similarity double")
    return pairs, members


# A kept table


@dataclass
class Model:
    pivots: np.ndarray
    codes: np.ndarray  # part, code, numbers of the part

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, distance to its pivot and codes of what is left of each row."""
        apart = _distances(rows, self.pivots)
        cell = apart.argmin(axis=1)
        rest = rows - self.pivots[cell]
        parts, _, width = self.codes.shape
        found = np.stack([_nearest(rest[:, p * width : (p + 1) * width], self.codes[p]) for p in range(parts)], axis=1)
        return cell, apart[np.arange(len(rows)), cell], found.astype(np.uint8)


def fit_model(rows: np.ndarray, cells: int, parts: int, codes: int = 256) -> Model:
    """Pivots, and codes of ``parts`` equal stretches of the numbers that the pivots leave."""
    pivots = fit_pivots(rows, cells)
    rest, width = rows - pivots[_nearest(rows, pivots)], rows.shape[1] // parts
    own = [fit_pivots(rest[:, p * width : (p + 1) * width], codes, seed=p + 2) for p in range(parts)]
    return Model(pivots, np.stack(own))


@dataclass
class VectorIndex:
    """A table of vectors in ``folder``, in cells, with codes; its state is the last committed version.

    ``create`` fits the model, ``add`` puts rows in or in place of those of
    their keys, ``remove`` takes keys out.  ``nearest`` probes cells and ranks
    again what the codes say is near; ``exact`` opens cells by their bounds.
    """

    spark: SparkSession
    folder: str
    key: str = "long"

    def _state(self) -> tuple[int, dict]:
        return Versions(self.spark, self.folder).latest()

    def create(self, vectors: DataFrame, key: str, vector: str, cells: int | None = None, parts: int = 8) -> int:
        """Fits the model on a sample of ``vectors``; their length must be a multiple of ``parts``.  No rows are added."""
        rows = _sample(vectors, key, vector)
        if not len(rows) or rows.shape[1] % parts:
            raise ValueError(f"no vectors, or not of a multiple of {parts} numbers")
        model = fit_model(rows, cells or max(1, min(PIVOTS, int(np.sqrt(vectors.count())))), parts)
        table = [("pivot", 0, k, row.tolist()) for k, row in enumerate(model.pivots)]
        table += [("code", p, k, row.tolist()) for p, own in enumerate(model.codes) for k, row in enumerate(own)]
        name = f"model-{uuid.uuid4().hex}"
        self.spark.createDataFrame(table, "kind string, part int, id int, numbers array<double>").coalesce(1).write.parquet(f"{self.folder}/{name}")
        Versions(self.spark, self.folder).commit(1, {"model": name, "segments": [], "dead": [], "n": 0})
        return 1

    @cached_property
    def model(self) -> Model:
        rows = self.spark.read.parquet(f"{self.folder}/{self._state()[1]['model']}").orderBy("kind", "part", "id").collect()  # of a fixed number
        pivots = np.array([r.numbers for r in rows if r.kind == "pivot"])
        parts = 1 + max(r.part for r in rows)
        return Model(pivots, np.array([r.numbers for r in rows if r.kind == "code"]).reshape(parts, -1, pivots.shape[1] // parts))

    def rows(self, state: dict | None = None) -> DataFrame:
        """key, cell, apart, codes, vector, segment, band of the live rows."""
        state = state or self._state()[1]
        schema = f"key {self.key}, cell int, apart double, codes binary, vector array<float>, segment string, band int"
        paths = [f"{self.folder}/rows/segment={s}" for s in state["segments"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.folder}/rows").parquet(*paths)
        return rows.join(self._dead(state), ["key", "segment"], "left_anti") if state["dead"] else rows

    def _dead(self, state: dict) -> DataFrame:
        return self.spark.read.schema(f"key {self.key}, segment string").parquet(*[f"{self.folder}/{d}" for d in state["dead"]])

    def add(self, vectors: DataFrame, key: str, vector: str) -> int:
        """One row a key (the greatest vector of those of one key); null keys, null vectors and zeros are left out."""
        number, state = self._state()
        model = self.spark.sparkContext.broadcast(self.model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    rows = _matrix(batch.column(1))
                    cell, apart, codes = model.value.encode(rows)
                    arrays = [batch.column(0), pa.array(cell.astype(np.int32)), pa.array(apart), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)]
                    yield pa.RecordBatch.from_arrays(arrays, ["key", "cell", "apart", "codes", "vector"])

        own = vectors.select(F.col(key).cast(self.key).alias("key"), F.col(vector).cast("array<float>").alias("vector"))
        own = own.where(F.col("key").isNotNull() & F.exists("vector", lambda x: x != 0)).groupBy("key").agg(F.max("vector").alias("vector"))
        rows = materialize(own.mapInArrow(run, f"key {self.key}, cell int, apart double, codes binary, vector array<float>"), "encoded")
        name = f"{number + 1}-{uuid.uuid4().hex}"
        dealt = rows.withColumn("band", F.col("cell") % BANDS).repartition("band", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("band", "cell")
        dealt.write.partitionBy("band").parquet(f"{self.folder}/rows/segment={name}")
        return self._commit(number, state, rows.select("key"), [name], rows.count())

    def remove(self, keys: DataFrame) -> int:
        number, state = self._state()
        return self._commit(number, state, keys.select(F.col(keys.columns[0]).cast(self.key).alias("key")), [], 0)

    def _commit(self, number: int, state: dict, keys: DataFrame, segments: list[str], n: int) -> int:
        lost = materialize(self.rows(state).select("key", "segment").join(keys.distinct(), "key", "left_semi").select("key", "segment"), "lost")
        gone, dead = lost.count(), []
        if gone:
            dead = [f"dead-{number + 1}-{uuid.uuid4().hex}"]
            lost.write.parquet(f"{self.folder}/{dead[0]}")
        new = {"segments": state["segments"] + segments, "dead": state["dead"] + dead, "n": state["n"] + n - gone}
        Versions(self.spark, self.folder).commit(number + 1, state | new)
        return number + 1

    def differences(self, vectors: DataFrame, key: str) -> DataFrame:
        """key, problem of keys that only the table (``missing``) or only the index (``stray``) has."""
        own, table = self.rows().select("key"), vectors.select(F.col(key).cast(self.key).alias("key")).where("key is not null").distinct()
        return table.join(own, "key", "left_anti").withColumn("problem", F.lit("missing")).union(own.join(table, "key", "left_anti").withColumn("problem", F.lit("stray")))

    def _blocks(self, queries: DataFrame, key: str, vector: str, most: int = QUERY_BLOCK):
        """Queries (keys, rows at length 1) in blocks of about ``most`` that may be sent to all tasks."""
        slim = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast(self.key).alias("key"), F.col(vector).alias("vector"))
        n = max(1, -(-slim.count() // most))
        n = 1 if n == 1 else 2 * n
        for part in range(n):
            table = slim.where(F.pmod(F.xxhash64("key"), F.lit(n)) == part).toArrow().combine_chunks()
            if table.num_rows:
                yield table["key"].to_pylist(), _matrix(table["vector"].combine_chunks())

    def _named(self, found: DataFrame, keys: list) -> DataFrame:
        names = self.spark.createDataFrame(list(enumerate(keys)), f"q int, query {self.key}")
        return found.join(F.broadcast(names), "q").select("query", "key", "similarity", "rank")

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], f"query {self.key}, key {self.key}, similarity double, rank int")

    def probed(self, rows: np.ndarray, probes: int) -> np.ndarray:
        """Which cells each query opens."""
        apart = _distances(rows, self.model.pivots)
        probes = min(probes, apart.shape[1])
        return apart <= np.partition(apart, probes - 1, axis=1)[:, probes - 1 : probes]

    def nearest(self, queries: DataFrame, key: str, vector: str, k: int = 10, probes: int = 16, refine: int = 10) -> DataFrame:
        """query, key, similarity, rank: of the ``probes`` cells nearest to a query the ``k`` best of those the codes rank first.

        The codes of the opened cells are read first; only ``refine`` times
        ``k`` keys a query are looked up for their vectors.
        """
        legs = [self._probe(keys, rows, k, probes, k * refine) for keys, rows in self._blocks(queries, key, vector)]
        return reduce(DataFrame.unionByName, legs) if legs else self._empty()

    def _probe(self, keys: list, asked: np.ndarray, k: int, probes: int, most: int) -> DataFrame:
        open_, model = self.probed(asked, probes), self.model
        parts, _, width = model.codes.shape
        tables = np.stack([asked[:, p * width : (p + 1) * width] @ model.codes[p].T for p in range(parts)], axis=1)
        block = self.spark.sparkContext.broadcast((keys, asked, open_, asked @ model.pivots.T, tables))
        cells = np.flatnonzero(open_.any(axis=0)).tolist()

        def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, _, opened, near, table = block.value
            best: dict[int, tuple] = {}
            for batch in batches:
                own, cell = np.array(batch.column("key").to_pylist(), object), batch.column("cell").to_numpy()
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(own), -1)
                for c in np.unique(cell):
                    at = np.flatnonzero(cell == c)
                    for q in np.flatnonzero(opened[:, c]):
                        score = near[q, c] + table[q][np.arange(codes.shape[1]), codes[at]].sum(axis=1)
                        keep = own[at] != names[q]
                        have = best.get(q, (np.zeros(0, object), np.zeros(0)))
                        ids, score = np.r_[have[0], own[at][keep]], np.r_[have[1], score[keep]]
                        first = np.argsort(-score, kind="stable")[:most]
                        best[q] = ids[first], score[first]
            for q, (ids, score) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q, np.int32)), pa.array(ids.tolist(), kind), pa.array(score)], ["q", "key", "score"])

        rows = self.rows().where(F.col("band").isin(sorted({c % BANDS for c in cells})) & F.col("cell").isin(cells))
        kind = pa.int64() if self.key == "long" else pa.string()
        found = rows.select("key", "cell", "codes").mapInArrow(approximate, f"q int, key {self.key}, score double")
        turn = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "key"))
        found = materialize(found.withColumn("turn", turn).where(F.col("turn") <= most).select("q", "key"), "candidates")
        ranked = F.row_number().over(W.partitionBy("q").orderBy(F.desc("similarity"), "key"))
        exact = rows.select("key", "vector").join(found, "key").mapInArrow(_similarities(block), f"q int, key {self.key}, similarity double")
        return self._named(exact.withColumn("rank", ranked).where(F.col("rank") <= k), keys)

    def exact(self, queries: DataFrame, key: str, vector: str, k: int = 10) -> DataFrame:
        """query, key, similarity, rank of the ``k`` nearest vectors: cells by bound, until no unseen one reaches the k-th.

        A cell's rows meet all queries that open it in matrix products of at
        most PRODUCTS numbers, and a task passes on its ``k`` best of each query.
        """
        state = self._state()[1]
        rows = self.rows(state).select("key", "cell", "apart", "vector")
        # What was replaced is taken out once, not in every wave.
        rows = materialize(rows.sortWithinPartitions("cell"), "live") if state["dead"] else rows
        radius = np.full(len(self.model.pivots), np.nan)
        for r in rows.groupBy("cell").agg(F.max("apart").alias("radius")).collect():  # a row per pivot
            radius[r.cell] = r.radius
        legs = [self._best_first(rows, radius, keys, asked, k) for keys, asked in self._blocks(queries, key, vector, ASKED)]
        return reduce(DataFrame.unionByName, legs) if legs else self._empty()

    def _best_first(self, rows: DataFrame, radius: np.ndarray, keys: list, asked: np.ndarray, k: int) -> DataFrame:
        kind = pa.int64() if self.key == "long" else pa.string()
        context = self.spark.sparkContext
        block, known = context.broadcast((pa.array(keys, kind), asked)), context.broadcast((self.model.pivots, radius))
        bounds = materialize(self.spark.range(len(keys)).mapInArrow(_bounds(block, known), "q int, cell int, bound double"), "bounds")

        def evaluate(opened: DataFrame) -> DataFrame:
            wanted = np.zeros((len(radius), len(keys)), bool)
            table = opened.groupBy("cell").agg(F.collect_list("q").alias("q")).toArrow()  # a row per pivot, of a block of queries
            for cell, q in zip(table["cell"].to_pylist(), table["q"]):
                wanted[cell, q.values.to_numpy()] = True
            cells = np.flatnonzero(wanted.any(axis=1)).tolist()
            bits = context.broadcast(np.packbits(wanted, axis=1))
            return rows.where(F.col("cell").isin(cells)).select("key", "cell", "vector").mapInArrow(_best(block, bits, k), f"q int, key {self.key}, similarity double, value double")

        return self._named(best_first(bounds, ["q"], k, evaluate, [F.col("key")], least=-1), keys)


def _bounds(block, known):
    """(number of a query) to (q, cell, bound of the similarities in the cell)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, asked), (pivots, radius) = block.value, known.value
        step = max(1, PRODUCTS // len(pivots))
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for at in range(0, len(numbers), step):
                own = numbers[at : at + step]
                # A vector of the cell is at least so far from the query.
                least = np.maximum(0, _distances(asked[own], pivots) - radius - SLACK)
                bound = np.minimum(1 - least**2 / 2, asked[own] @ pivots.T + radius) + SLACK
                q, cell = np.nonzero(~np.isnan(bound))
                yield pa.RecordBatch.from_arrays([pa.array(own[q].astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(bound[q, cell])], ["q", "cell", "bound"])

    return run


def _best(block, bits, k: int):
    """(key, cell, vector) to the task's ``k`` best (q, key, similarity, value to nine decimals) of each query that opens the cell, without its own key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = block.value
        wanted = np.unpackbits(bits.value, axis=1, count=len(names)).astype(bool)
        floor = np.full(len(names), -np.inf)  # what a row must reach to be among a query's best

        def cut(found: list[pa.RecordBatch]) -> pa.Table:
            table = pa.Table.from_batches(found)
            table = table.take(pc.sort_indices(table, [("q", "ascending"), ("value", "descending"), ("key", "ascending")])).combine_chunks()
            q, at = table["q"].to_numpy(), np.arange(table.num_rows)
            turn = at - np.maximum.accumulate(np.where(np.r_[True, q[1:] != q[:-1]][: len(q)], at, 0))
            floor[q[turn == k - 1]] = table["value"].to_numpy()[turn == k - 1]
            return table.filter(pa.array(turn < k))

        found, size = [], 0
        for batch in batches:
            rows, cell = _matrix(batch.column("vector")), batch.column("cell").to_numpy()
            for c in np.unique(cell):
                here, asking = np.flatnonzero(cell == c), np.flatnonzero(wanted[c])
                step = max(1, PRODUCTS // max(1, len(asking)))
                for start in range(0, len(here), step):
                    some = here[start : start + step]
                    near = asked[asking] @ rows[some].T
                    value = np.round(near, 9)
                    a, b = np.nonzero(value >= floor[asking][:, None])
                    q, key = asking[a], batch.column("key").take(pa.array(some[b]))
                    part = pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), key, pa.array(near[a, b]), pa.array(value[a, b])], ["q", "key", "similarity", "value"])
                    found.append(part.filter(pc.not_equal(names.take(pa.array(q)), key)))
                    size += found[-1].num_rows
                    if size >= PRODUCTS:
                        found = cut(found).to_batches()
                        size = 0
        if found:
            yield from cut(found).to_batches()

    return run


def _similarities(block):
    """(q, key, vector) in any order of columns to (q, key, similarity), without a query's own key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = block.value[:2]
        for batch in batches:
            q = batch.column("q").to_numpy()
            near = (asked[q] * _matrix(batch.column("vector"))).sum(axis=1) if len(q) else np.zeros(0)
            own = pa.array([names[a] != b for a, b in zip(q.tolist(), batch.column("key").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("key"), pa.array(near)], ["q", "key", "similarity"]).filter(own)

    return run


def action(similarity: Column | str, write: float = 0.85) -> Column:
    """What becomes of a pair: written at this similarity, reviewed below it."""
    similarity = F.col(similarity) if isinstance(similarity, str) else similarity
    return F.when(similarity >= write, "write").otherwise("review")
