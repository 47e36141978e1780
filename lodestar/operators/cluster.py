"""Clustering of change vectors.

Centres are model-sized (k x width) and are the only thing that moves
through the driver between Lloyd steps, exactly as in MLlib's KMeans.
Points are never collected, paired or grouped into one task.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from lodestar.functions.columns import uniform_draw
from lodestar.sources.files import stored


def _matrix(vectors) -> "np.ndarray":
    """Rows of an Arrow list column of equally long vectors."""
    import numpy as np
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.empty((0, 0))


class Vectors:
    """Points whose vectors are a column. What reads them gets each batch in
    two parts, as from ``encode.RowCodes``: leading entries row by row, and
    for the others each row's place in a table (here: none)."""

    def __init__(self, column: str = "vector"):
        self.columns = [column]

    def read(self, columns: list):
        import numpy as np
        x = _matrix(columns[0])
        return x, np.zeros(len(x), dtype=np.int64), np.zeros((1, 0))


def _whole(x, where, table, rows):
    """The vectors of some rows."""
    import numpy as np
    return np.concatenate([x[rows], table[where[rows]]], axis=1)


def _summed(x: "np.ndarray", centres: "np.ndarray"):
    """Squared Euclidean distances (centre, row), summed over positions
    from left to right."""
    import numpy as np
    columns, total = np.ascontiguousarray(x.T), np.zeros((len(centres), len(x)))
    for i in range(centres.shape[1]):
        d = columns[i] - centres[:, i, None]
        d *= d
        total += d
    return total


def _least(distances: "np.ndarray"):
    """Per row of (centre, row): where the least is (ties: lowest; NaN is
    least, as for argmin) and what it is."""
    import numpy as np
    if np.isnan(distances.sum()):
        at = distances.argmin(axis=0)
        return at, distances[at, np.arange(distances.shape[1])]
    best, at = distances[0].copy(), np.zeros(distances.shape[1], dtype=np.int64)
    for j in range(1, len(distances)):
        at[distances[j] < best] = j
        np.minimum(best, distances[j], out=best)
    return at, best


def _nearest(x: "np.ndarray", centres: "np.ndarray", where=None, table=None):
    """Index of the nearest centre (ties: lowest) and the squared Euclidean
    distance; entries in a table are compared once for all their rows."""
    d = x.shape[1]
    total = _summed(x, centres[:, :d])
    if table is not None and table.shape[1]:
        total += _summed(table, centres[:, d:])[:, where]
    return _least(total)


def _sums(at, k: int, x, where, table) -> "np.ndarray":
    """The sum of the vectors of each of k groups."""
    import numpy as np
    out = np.zeros((k, x.shape[1] + table.shape[1]))
    if not table.shape[1]:
        for j in np.unique(at):
            out[j] = x[at == j].sum(axis=0)
        return out
    for i in range(x.shape[1]):
        out[:, i] = np.bincount(at, x[:, i], minlength=k)
    size = len(table)
    out[:, x.shape[1]:] = np.bincount(at * size + where, minlength=k * size).reshape(k, size) @ table
    return out


def vector_width(points: DataFrame, column: str = "vector") -> int:
    row = points.select(F.size(column).alias("w")).first()
    return int(row["w"]) if row else 0


def group_means(points: DataFrame, group: str, column: str, width: int) -> dict:
    """{group: mean vector}: one aggregate with a sum per position (k rows
    reach the driver); no explode of the points."""
    aggs = [F.avg(F.col(column)[i]).alias(f"m{i}") for i in range(width)]
    rows = points.groupBy(group).agg(*aggs).collect()
    return {r[group]: [float(r[f"m{i}"]) for i in range(width)] for r in rows}


def _check_k(n: int, k: int):
    if k < 2:
        raise ValueError("k must be at least 2")
    if n < k:
        raise ValueError(f"cannot form {k} clusters from {n} rows")


# Points taken in hash order per centre asked for, at first and at most.
FIRST_POINTS, MOST_POINTS = 32, 20_000


def initial_centres(points: DataFrame, k: int, id_col: str = "id", column: str = "vector", seed: int = 42,
                    make=None) -> list:
    """k distinct vectors chosen by hash order of their first point's id.
    The first k distinct vectors of the points in that order are these, so
    a short top list has them; where copies fill it, a longer one, and in
    the end a dedupe of all points. Only such a list reaches the driver.
    ``make``: adds the vectors to points that lack them, so that only a
    list's are made."""
    u = uniform_draw([id_col, seed])
    listed = points.drop("u", "__id") if make else points.select(column, id_col)
    order = listed.withColumns({"u": u, "__id": F.col(id_col)}).orderBy("u", "__id")
    take = FIRST_POINTS * k
    while take <= MOST_POINTS:
        rows = order.limit(take).collect()
        n_rows = len(rows)
        if make and rows:
            # of the collected rows: Spark moves a projection below the limit
            rows = make(points.sparkSession.createDataFrame(rows, order.schema)).select(column).collect()
        first = {}
        for r in rows:
            # zeros of both signs are one vector, as NaNs are
            v = [float(x) + 0.0 for x in r[column]]
            first.setdefault(tuple("nan" if x != x else x for x in v), v)
        if len(first) >= k or n_rows < take:
            _check_k(len(first), k)
            return list(first.values())[:k]
        take *= 8
    ranked = ((make(points) if make else points).select(column, u.alias("u"), F.col(id_col))
              .groupBy(column).agg(F.min(F.struct("u", id_col)).alias("first"))
              .orderBy(F.col("first.u"), F.col(f"first.{id_col}")).limit(k).collect())
    _check_k(len(ranked), k)
    return [list(map(float, r[column])) for r in ranked]


def centre_means(points: DataFrame, centres: list, column: str = "vector", rows=None) -> dict:
    """{cluster: mean vector} of the points nearest to each centre. A task
    hands on one partial sum per cluster (k rows). ``rows``: what reads the
    points (``encode.RowCodes``), else their ``column`` is read."""
    import numpy as np
    import pyarrow as pa
    width, rows = len(centres[0]), rows or Vectors(column)
    shared = np.array(centres, dtype=float)

    def run(batches):
        n, sums = np.zeros(len(shared), dtype=np.int64), np.zeros(shared.shape)
        for batch in batches:
            if batch.num_rows:
                x, where, table = rows.read(batch.columns)
                at, _ = _nearest(x, shared, where, table)
                n += np.bincount(at, minlength=len(shared))
                sums += _sums(at, len(shared), x, where, table)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(shared)), pa.int32()), pa.array(n), pa.array(
            sums.tolist(), pa.list_(pa.float64()))], names=["cluster_id", "n", "s"])

    parts = points.select(*rows.columns).mapInArrow(run, "cluster_id int, n long, s array<double>").where("n > 0")
    found = parts.groupBy("cluster_id").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}")
                                                                     for i in range(width)]).collect()
    return {r["cluster_id"]: [float(r[f"s{i}"]) / r["n"] for i in range(width)] for r in found}


@dataclass
class LloydResult:
    centres: list
    steps: int
    converged: bool = False


def lloyd(points: DataFrame, centres: list, steps: int = 300, column: str = "vector", rows=None) -> LloydResult:
    """Lloyd steps from given centres until they stop moving, at most
    ``steps`` (an empty cluster keeps its centre). The result says how
    many were made and whether the centres had stopped."""
    centres = [list(map(float, c)) for c in centres]
    for done in range(1, steps + 1):
        means = centre_means(points, centres, column, rows)
        moved = [means.get(j, centres[j]) for j in range(len(centres))]
        if moved == centres:
            return LloydResult(centres, done, True)
        centres = moved
    return LloydResult(centres, steps)


def assign(points: DataFrame, centres: list, column: str = "vector", keep_vector: bool = True) -> DataFrame:
    """Attach labels (and squared distance to the centre), in Arrow
    batches against the k centres; with the vectors or without."""
    import numpy as np
    import pyarrow as pa
    points = points.drop("cluster_id", "sq_distance")
    where = points.columns.index(column)
    kept = [i for i, c in enumerate(points.columns) if keep_vector or i != where]
    schema = StructType([*[points.schema.fields[i] for i in kept], StructField("cluster_id", IntegerType()),
                         StructField("sq_distance", DoubleType())])
    names = schema.names
    shared = np.array(centres, dtype=float)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at, d = _nearest(_matrix(batch.column(where)), shared)
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(at.astype(np.int32)), pa.array(d)],
                                                 names=names)

    return points.mapInArrow(run, schema)


def assign_coded(points: DataFrame, centres: list, rows) -> DataFrame:
    """C5 for points that ``rows`` (``encode.RowCodes``) reads: what it
    reads is replaced by the deltas and the pattern, from which its
    ``fields`` makes flags and tokens."""
    import numpy as np
    import pyarrow as pa
    points = points.drop("cluster_id", "sq_distance")
    read = [points.columns.index(c) for c in rows.columns]
    kept = [i for i in range(len(points.columns)) if i not in read]
    after = replace(rows, stored=True)
    schema = StructType([*[points.schema.fields[i] for i in kept], *[StructField(c, DoubleType()) for c in after.columns[:-1]],
                         StructField(after.columns[-1], LongType()), StructField("cluster_id", IntegerType()),
                         StructField("sq_distance", DoubleType())])
    names = schema.names
    shared = np.array(centres, dtype=float)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, code = rows.coded([batch.column(i) for i in read])
                known, where = np.unique(code, return_inverse=True)
                at, d = _nearest(x, shared, where, rows.patterns(known))
                made = [*[pa.array(np.ascontiguousarray(c)) for c in x.T], pa.array(code), pa.array(at.astype(np.int32)), pa.array(d)]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *made], names=names)

    return points.mapInArrow(run, schema)


# Rounds of oversampling, and candidates a round in expectation per centre.
SEED_ROUNDS, OVERSAMPLING = 3, 2
# Rows whose distances to all centres of all restarts are held at once.
DISTANCE_CELLS = 1 << 21


def _packed(batches):
    """(id hash, vector) rows as one row a batch: the hashes, which columns
    are 0 or 1 throughout, those as bytes and the others as doubles."""
    import numpy as np
    import pyarrow as pa
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(1))
            flags = ((x == 0) | (x == 1)).all(axis=0)
            parts = [batch.column(0).to_numpy(zero_copy_only=False), flags, x[:, flags].astype(np.uint8), x[:, ~flags].T]
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts],
                                             names=["h", "flags", "bits", "x"])


def _slices(batches, n_centres: int):
    """(id hash, vectors) of packed rows in slices of bounded distance tables."""
    import numpy as np
    step = max(1, DISTANCE_CELLS // max(1, n_centres))
    for batch in batches:
        for i in range(batch.num_rows):
            h, flags, bits, rest = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in enumerate(
                (np.int64, np.bool_, np.uint8, np.float64)))
            x = np.empty((len(h), len(flags)))
            x[:, flags] = bits.reshape(len(h), -1) if flags.any() else 0.0
            x[:, ~flags] = rest.reshape(-1, len(h)).T
            for o in range(0, len(h), step):
                yield h[o:o + step], x[o:o + step]


# Rows of a block of coded points.
BLOCK_ROWS = 1 << 16


def _packed_codes(rows):
    """(id hash, what ``rows`` reads) as blocks of bytes: the hashes, the
    patterns that occur, each row's place among them, the deltas."""
    import numpy as np
    import pyarrow as pa

    def block(parts):
        h, x, code = (np.concatenate(p) for p in zip(*parts))
        known, where = np.unique(code, return_inverse=True)
        where = where.astype(np.uint16 if len(known) <= 1 << 16 else np.int32)
        return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in (h, known, where, x.T)],
                                          names=["h", "known", "place", "x"])

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append((batch.column(0).to_numpy(zero_copy_only=False), *rows.coded(batch.columns[1:])))
                n += batch.num_rows
                if n >= BLOCK_ROWS:
                    yield block(parts)
                    parts, n = [], 0
        if parts:
            yield block(parts)

    return run


@dataclass
class _Block:
    """Points in two parts (see :class:`Vectors`) with their id hashes."""
    h: "np.ndarray"
    x: "np.ndarray"
    where: "np.ndarray"
    table: "np.ndarray"

    def vectors(self, rows):
        return _whole(self.x, self.where, self.table, rows)

    def distances(self, centres: "np.ndarray"):
        """(rows, squared distances (centre, row)) in slices of bounded size."""
        import numpy as np
        if not self.table.shape[1]:
            yield slice(0, len(self.x)), np.ascontiguousarray(_square_distances(self.x, centres).T)
            return
        d = self.x.shape[1]
        near = centres[:, :d]
        # once per pattern: its own share of the distance, and what the centre adds
        part = _square_distances(self.table, centres[:, d:]).T + (near * near).sum(axis=1)[:, None]
        square = (self.x * self.x).sum(axis=1)
        step = max(1, (DISTANCE_CELLS >> 2) // len(centres))
        for o in range(0, len(self.x), step):
            rows = slice(o, o + step)
            out = (-2.0 * near) @ self.x[rows].T
            out += np.take(part, self.where[rows], axis=1)
            out += square[rows]
            yield rows, np.maximum(out, 0.0, out=out)


def _blocks(batches, n_centres: int, rows=None):
    """The stored points of :class:`Restarts` as blocks."""
    import numpy as np
    if rows is None:
        for h, x in _slices(batches, n_centres):
            yield _Block(h, x, np.zeros(len(x), dtype=np.int64), np.zeros((1, 0)))
        return
    for batch in batches:
        for i in range(batch.num_rows):
            h, known, place, x = (batch.column(c)[i].as_buffer() for c in range(4))
            h, known, x = np.frombuffer(h, np.int64), np.frombuffer(known, np.int64), np.frombuffer(x, np.float64)
            where = np.frombuffer(place, np.uint16 if place.size == 2 * len(h) else np.int32).astype(np.int64)
            yield _Block(h, np.ascontiguousarray(x.reshape(-1, len(h)).T), where, rows.patterns(known))


def _square_distances(x: "np.ndarray", centres: "np.ndarray"):
    import numpy as np
    d = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ centres.T) + (centres * centres).sum(axis=1)[None, :]
    return np.maximum(d, 0.0)


def _draws(ids: "np.ndarray", seed: int):
    """Uniform draws in [0, 1) from id hashes and a seed."""
    import numpy as np
    with np.errstate(over="ignore"):
        z = ids.view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


# Arrays of at most so many tasks go straight to the driver.
DIRECT_ARRAYS = 4


def _added(parts: DataFrame, shape: tuple) -> "np.ndarray":
    """Sum of the arrays that tasks hand on as bytes, one row a task; they
    are added up in a tree of tasks, so that the driver gets a handful of
    them however many tasks there are."""
    import numpy as np
    arrays = parts.rdd.map(lambda r: np.frombuffer(r[0]))
    many = arrays.getNumPartitions() > DIRECT_ARRAYS
    total = arrays.treeReduce(lambda a, b: a + b, depth=3) if many else sum(arrays.collect())
    return np.asarray(total, dtype=float).reshape(shape) if np.ndim(total) else np.zeros(shape)


class Restarts:
    """K-Means from many starts, of one or of several k, with one pass over
    the points for all of them at every step.

    Seeding is k-means||: from one point per start, each round takes a
    point with a probability in proportion to its squared distance to the
    candidates so far (draws are hashes of the id, so they do not depend on
    partitions); candidates are weighted by the points nearest to them and
    reduced to k by weighted k-means++ on the driver. A Lloyd pass hands on
    partial sums per (start, centre); starts that have settled take no part
    in the next pass. Candidates and centres are model-sized; points stay
    where they are."""

    def __init__(self, points: DataFrame, starts: list[tuple[int, int]], id_col: str = "id", column: str = "vector", rows=None,
                 make=None):
        # stored once in blocks of bytes, as every step reads all of it
        h = F.xxhash64(id_col).alias("h")
        if rows is None:
            packed = points.select(h, F.transform(column, lambda v: v.cast("double")).alias("v")).mapInArrow(
                _packed, "h binary, flags binary, bits binary, x binary")
        else:
            packed = points.select(h, *rows.columns).mapInArrow(_packed_codes(rows), "h binary, known binary, place binary, x binary")
        self.points = stored(packed, "points")
        self.starts, self.id_col, self.column, self.source, self.rows, self.make = starts, id_col, column, points, rows, make

    def _run(self, work, shape: tuple):
        """``work(blocks, out)`` adds to an array of ``shape`` per task."""
        import numpy as np
        import pyarrow as pa
        n_centres, rows = max(shape[0], 1), self.rows

        def run(batches):
            out = np.zeros(shape)
            work(_blocks(batches, n_centres, rows), out)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["a"])

        return _added(self.points.mapInArrow(run, "a binary"), shape)

    def _nearest_of(self, centres: list) -> tuple:
        """All starts' centres in one table, and where each start's are."""
        import numpy as np
        ends = np.cumsum([0, *map(len, centres)])
        return np.concatenate(centres), ends

    def _first(self) -> list:
        """Per start, the point of the smallest draw."""
        import numpy as np
        import pyarrow as pa
        seeds, rows = [seed for _, seed in self.starts], self.rows

        def run(batches):
            best: dict = {}
            for block in _blocks(batches, len(seeds), rows):
                for r, seed in enumerate(seeds):
                    if len(block.h):
                        u = _draws(block.h, seed)
                        i = int(u.argmin())
                        if float(u[i]) <= best.get(r, (2.0, ()))[0]:
                            best[r] = min(best.get(r, (2.0, ())), (float(u[i]), tuple(block.vectors([i])[0].tolist())))
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array([b[0] for b in best.values()], pa.float64()),
                                              pa.array([b[1] for b in best.values()], pa.list_(pa.float64()))], names=["r", "u", "v"])

        firsts = self.points.mapInArrow(run, "r int, u double, v array<double>").groupBy("r").agg(
            F.min(F.struct("u", "v")).alias("b")).collect()
        found = {r["r"]: np.array([r["b"]["v"]]) for r in firsts}
        if not found:
            raise ValueError("no points to cluster")
        return [found[r] for r in range(len(seeds))]

    def _costs(self, centres: list):
        table, ends = self._nearest_of(centres)

        def work(blocks, out):
            for block in blocks:
                for _, d in block.distances(table):
                    for r in range(len(ends) - 1):
                        out[r] += d[ends[r]:ends[r + 1]].min(axis=0).sum()
        return self._run(work, (len(centres),))

    def _drawn(self, centres: list, costs, number: int) -> list:
        """Candidates of one more round, per start."""
        import numpy as np
        import pyarrow as pa
        table, ends = self._nearest_of(centres)
        starts, per, stored_rows = self.starts, OVERSAMPLING, self.rows

        def run(batches):
            for block in _blocks(batches, len(table), stored_rows):
                rows, vs = [], []
                for some, d in block.distances(table):
                    for r, (k, seed) in enumerate(starts):
                        if costs[r] > 0:
                            near = d[ends[r]:ends[r + 1]].min(axis=0)
                            u = _draws(block.h[some], seed * 1_000_003 + number + 1)
                            taken = np.nonzero(u * costs[r] < per * k * near)[0]
                            rows += [r] * len(taken)
                            vs += block.vectors(some.start + taken).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(vs, pa.list_(pa.float64()))],
                                                 names=["r", "v"])

        # in expectation OVERSAMPLING * k rows per start
        found = self.points.mapInArrow(run, "r int, v array<double>").distinct().orderBy("r", "v").collect()
        out = [list(map(tuple, c.tolist())) for c in centres]
        for row in found:
            if tuple(row["v"]) not in out[row["r"]]:
                out[row["r"]].append(tuple(row["v"]))
        return [np.array(c) for c in out]

    def _weights(self, centres: list):
        import numpy as np
        table, ends = self._nearest_of(centres)

        def work(blocks, out):
            for block in blocks:
                for _, d in block.distances(table):
                    for r in range(len(ends) - 1):
                        at, _ = _least(d[ends[r]:ends[r + 1]])
                        out[ends[r]:ends[r + 1]] += np.bincount(at, minlength=ends[r + 1] - ends[r])
        weights = self._run(work, (len(table),))
        return [weights[a:b] for a, b in zip(ends, ends[1:])]

    def seeds(self) -> list:
        """k centres per start."""
        import random
        import numpy as np
        candidates = self._first()
        for number in range(SEED_ROUNDS):
            candidates = self._drawn(candidates, self._costs(candidates), number)
        out = []
        for (k, seed), c, w in zip(self.starts, candidates, self._weights(candidates)):
            rng = random.Random(seed)
            chosen: list[int] = []
            near = np.ones(len(c))
            while len(chosen) < k and (w * near).sum() > 0:
                mass = np.cumsum(w * near)
                chosen.append(int(np.searchsorted(mass, rng.random() * mass[-1], side="right").clip(0, len(c) - 1)))
                d = _square_distances(c, c[chosen[-1:]])[:, 0]
                d[(c == c[chosen[-1]]).all(axis=1)] = 0.0
                near = d if len(chosen) == 1 else np.minimum(near, d)
            centres = c[chosen]
            if len(chosen) < k:
                # fewer candidates than centres: distinct points in hash order fill up
                more = initial_centres(self.source, k, self.id_col, self.column, seed, self.make)
                have = {tuple(v) for v in centres.tolist()}
                centres = np.array([*centres.tolist(), *[v for v in more if tuple(v) not in have]])[:k]
            out.append(centres)
        return out

    def fit(self, max_iter: int = 300, tol: float = 1e-12) -> list[tuple[float, LloydResult]]:
        """(inertia, result) per start. A start settles when no centre
        moves by more than ``tol`` of the centres' scale (squared)."""
        import numpy as np
        centres = self.seeds()
        done: dict[int, tuple[float, LloydResult]] = {}
        for step in range(1, max_iter + 1):
            open_ = [r for r in range(len(centres)) if r not in done]
            if not open_:
                break
            table, ends = self._nearest_of([centres[r] for r in open_])
            width = table.shape[1]

            def work(blocks, out):
                for block in blocks:
                    d, size = block.x.shape[1], len(block.table)
                    counts = np.zeros((len(table), size))
                    for some, far in block.distances(table):
                        x, where = block.x[some], block.where[some]
                        columns = np.ascontiguousarray(x.T)
                        for i in range(len(ends) - 1):
                            rows = slice(ends[i], ends[i + 1])
                            k = ends[i + 1] - ends[i]
                            at, least = _least(far[rows])
                            out[ends[i], width + 1] += least.sum()
                            if block.table.shape[1]:
                                for c in range(d):
                                    out[rows, c] += np.bincount(at, columns[c], minlength=k)
                                counts[rows] += np.bincount(at * size + where, minlength=k * size).reshape(k, size)
                            else:
                                hot = np.zeros((len(x), k))
                                hot[np.arange(len(x)), at] = 1.0
                                out[rows, :d] += hot.T @ x
                                counts[rows, 0] += hot.sum(axis=0)
                    # the entries of the table once a pattern, not once a row
                    out[:, d:width] += counts @ block.table
                    out[:, width] += counts.sum(axis=1)

            sums = self._run(work, (len(table), width + 2))
            for i, r in enumerate(open_):
                part = sums[ends[i]:ends[i + 1]]
                n = part[:, width]
                # an empty cluster keeps its centre
                moved = np.where(n[:, None] > 0, part[:, :width] / np.maximum(n, 1.0)[:, None], centres[r])
                scale = max(float((moved * moved).sum(axis=1).max()), 1e-300)
                still = float(((moved - centres[r]) ** 2).sum(axis=1).max()) <= tol * scale
                if still or step == max_iter:
                    done[r] = (float(part[0, width + 1]), LloydResult(moved.tolist(), step, still))
                centres[r] = moved
        return [done[r] for r in range(len(self.starts))]


def kmeans(points: DataFrame, k: int, id_col: str = "id", column: str = "vector", seed: int = 42, n_init: int = 10,
           max_iter: int = 300, rows=None, make=None) -> LloydResult:
    """C1 on stored vectors: ``n_init`` starts at once, the one of least
    inertia (ties: first). ``rows`` reads points without vectors, ``make``
    adds those (``lloyd``, ``initial_centres``)."""
    return best_of_k(points, [k], id_col, column, seed, n_init, max_iter, rows, make)[k]


def best_of_k(points: DataFrame, ks, id_col: str = "id", column: str = "vector", seed: int = 42, n_init: int = 10,
              max_iter: int = 300, rows=None, make=None) -> dict[int, LloydResult]:
    """The best of ``n_init`` starts for each k, all fitted together."""
    ks = list(ks)
    n = points.count()
    for k in ks:
        _check_k(n, k)
    starts = [(k, seed + i) for k in ks for i in range(n_init)]
    fits = Restarts(points, starts, id_col, column, rows, make).fit(max_iter)
    best: dict = {}
    for (k, _), (cost, fit) in zip(starts, fits):
        if k not in best or cost < best[k][0]:
            best[k] = (cost, fit)
    return {k: fit for k, (_, fit) in best.items()}


def inertia(assigned: DataFrame) -> DataFrame:
    """Sum of squared distances to the assigned centre."""
    return assigned.agg(F.sum("sq_distance").alias("inertia"))


def sizes(assigned: DataFrame) -> DataFrame:
    """Size and share per cluster (share = size / total), by size desc."""
    total = F.sum("size").over(Window.partitionBy(F.lit(1)))
    counts = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    # k rows: the global window is over k rows only
    return counts.withColumn("share", F.col("size") / total).orderBy(F.col("size").desc(), "cluster_id")


def _cluster_sums(assigned: DataFrame, column: str, rows=None) -> dict:
    """{cluster: (points, mean vector, mean squared norm)}: a task hands on
    one partial sum per cluster."""
    import numpy as np
    import pyarrow as pa
    rows = rows or Vectors(column)

    def run(batches):
        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, at = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            x, where, table = rows.read(batch.columns[1:])
            norms = (x * x).sum(axis=1) + (table * table).sum(axis=1)[where]
            part = np.concatenate([np.bincount(at)[:, None], np.bincount(at, norms)[:, None], _sums(at, len(ids), x, where, table)], axis=1)
            for c, p in zip(ids.tolist(), part):
                sums[c] = sums[c] + p if c in sums else p
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(
            [s.tolist() for s in sums.values()], pa.list_(pa.float64()))], names=["c", "s"])

    clustered = assigned.where("cluster_id IS NOT NULL")
    parts = clustered.select("cluster_id", *rows.columns).mapInArrow(run, "c long, s array<double>")
    each = parts.select("c", F.posexplode("s").alias("at", "v")).groupBy("c", "at").agg(F.sum("v").alias("v"))
    found: dict = {}
    for r in each.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("s")).collect():
        s = [p["v"] for p in r["s"]]
        found[r["c"]] = (int(s[0]), [v / s[0] for v in s[2:]], s[1] / s[0])
    return found


def silhouette(assigned: DataFrame, column: str = "vector", rows=None) -> DataFrame:
    """C4 (squared Euclidean, exact): for a point x and cluster C,
    mean_{y in C} |x - y|^2 = |x|^2 - 2 x.mu_C + mean_{y in C} |y|^2,
    so a(x), b(x) need only per-cluster (count, mean, mean |y|^2): k rows
    that are collected, no point pairs. NaN with one cluster. ``rows``:
    what reads the points, else their ``column`` is read."""
    import numpy as np
    import pyarrow as pa
    info = _cluster_sums(assigned, column, rows)
    ids, rows = sorted(info), rows or Vectors(column)
    if len(ids) < 2:
        return assigned.sparkSession.createDataFrame([(float("nan"),)], "silhouette double")
    counts = np.array([info[j][0] for j in ids], dtype=float)
    means, norms = np.array([info[j][1] for j in ids]), np.array([info[j][2] for j in ids])

    def run(batches):
        n, total = 0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.searchsorted(ids, batch.column(0).to_numpy(zero_copy_only=False))
            x, where, table = rows.read(batch.columns[1:])
            at, near = np.arange(len(x)), x.shape[1]
            d = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ means[:, :near].T) + norms[None, :]
            if table.shape[1]:
                d += ((table * table).sum(axis=1)[:, None] - 2.0 * (table @ means[:, near:].T))[where]
            size = counts[own]
            # a(x) excludes x itself: sum over the n-1 others = n * mean (own term is 0)
            a = d[at, own] * size / np.maximum(size - 1.0, 1.0)
            d[at, own] = np.inf
            b = d.min(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                s = np.where(size <= 1.0, 0.0, (b - a) / np.maximum(a, b))
            n, total = n + len(x), total + float(np.where(np.isfinite(s), s, 0.0).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.float64())], names=["n", "s"])

    clustered = assigned.where("cluster_id IS NOT NULL").select(F.col("cluster_id").cast("long"), *rows.columns)
    parts = clustered.mapInArrow(run, "n long, s double")
    return parts.agg((F.sum("s") / F.sum("n")).alias("silhouette"))


# Points of a block, and blocks that one copy of another block meets.
TILE_ROWS, LOT_TILES = 2048, 32


def euclidean_silhouette(assigned: DataFrame, column: str = "vector") -> DataFrame:
    """C4 (Euclidean): the mean over points of (b - a) / max(a, b), from the
    mean distances to the own and the nearest other cluster. NaN with one
    cluster; a point alone in its cluster counts 0.

    Plain distances have no closed form, so every point meets every other:
    the work is quadratic in the points. It is dealt out in tiles, block by
    block of points; a tile hands on one sum per (point, cluster), never a
    pair, and a block is copied once per lot of blocks that it meets."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext
    spark = assigned.sparkSession
    counts = {r["cluster_id"]: r["count"] for r in assigned.groupBy("cluster_id").count().collect()}
    ids = sorted(counts)
    if len(ids) < 2:
        return spark.createDataFrame([(float("nan"),)], "silhouette double")
    place, tile = {c: i for i, c in enumerate(ids)}, TILE_ROWS

    def cut(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for o in range(0, batch.num_rows, tile):
                part = batch.slice(o, tile)
                at = np.array([place[c] for c in part.column(1).to_pylist()], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number], pa.int64()), pa.array([part.num_rows], pa.int32()), pa.array([at.tobytes()], pa.binary()),
                    pa.array([_matrix(part.column(0)).tobytes()], pa.binary())], names=["tile", "n", "at", "x"])
                number += 1

    tiles = stored(assigned.select(F.transform(column, lambda v: v.cast("double")), "cluster_id").mapInArrow(
        cut, "tile long, n int, at binary, x binary"), "tiles")
    n_tiles = tiles.count()
    lots = max(1, min(n_tiles, max(spark.sparkContext.defaultParallelism, -(-n_tiles // LOT_TILES))))
    copies = tiles.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    others = tiles.select(F.pmod(F.xxhash64("tile"), F.lit(lots)).cast("int").alias("lot"), F.col("n").alias("m"),
                          F.col("at").alias("other_at"), F.col("x").alias("y"))
    met = copies.join(others, "lot").select("tile", "n", "at", "x", "m", "other_at", "y")
    k = len(ids)

    def measure(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["x"]).reshape(r["n"], -1)
                y = np.frombuffer(r["y"]).reshape(r["m"], -1)
                centre = y.mean(axis=0) if len(y) else 0.0
                hot = np.zeros((r["m"], k))
                hot[np.arange(r["m"]), np.frombuffer(r["other_at"], dtype=np.int32)] = 1.0
                sums = np.sqrt(_square_distances(x - centre, y - centre)) @ hot
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(r["n"], r["tile"])), pa.array(np.arange(r["n"], dtype=np.int32)),
                    pa.array(np.frombuffer(r["at"], dtype=np.int32)), *[pa.array(sums[:, j]) for j in range(k)]],
                    names=["tile", "row", "own", *[f"s{j}" for j in range(k)]])

    schema = "tile long, row int, own int, " + ", ".join(f"s{j} double" for j in range(k))
    per = met.mapInArrow(measure, schema).groupBy("tile", "row", "own").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(k)])
    own = [F.when(F.col("own") == j, F.col(f"s{j}") / max(1, counts[c] - 1)) for j, c in enumerate(ids)]
    near = [F.when(F.col("own") != j, F.col(f"s{j}") / counts[c]) for j, c in enumerate(ids)]
    alone = F.col("own").isin([j for j, c in enumerate(ids) if counts[c] == 1])
    a, b = F.coalesce(*own), F.least(*near)
    s = F.when(alone | (F.greatest(a, b) == 0), 0.0).otherwise((b - a) / F.greatest(a, b))
    return per.agg(F.avg(s).alias("silhouette"))


def k_sweep(points: DataFrame, ks=range(2, 11), id_col: str = "id", seed: int = 42, n_init: int = 3,
            column: str = "vector", max_iter: int = 50):
    """Per k: silhouette, inertia, min and max cluster size (one row
    each). All starts of all k are fitted together."""
    rows = []
    for k, fit in best_of_k(points, ks, id_col, column, seed, n_init, max_iter).items():
        assigned = assign(points, fit.centres, column)
        sil = silhouette(assigned, column).first()["silhouette"]
        per = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sum("sq_distance").alias("d"))
        sz = per.agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.sum("d").alias("d")).first()
        rows.append((int(k), float(sil), float(sz["d"]), int(sz["lo"]), int(sz["hi"])))
    return points.sparkSession.createDataFrame(
        rows, "k int, silhouette double, inertia double, min_size bigint, max_size bigint")
