"""Exact top-k search by pivot-table elimination (operator 3)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K

PIVOTS = 64
SAMPLE = 4096  # vectors of each length that pivots and first thresholds are taken from
LENGTHS = 1000  # lengths of vectors, the most frequent, that have pivots; others are compared without
BLOCK, QUERY_BLOCK = 1 << 16, 1 << 14  # vectors that meet in one task, at most about
STEP = 512  # candidates evaluated before the first look at the bound; each step is twice the one before
MOST = 2**63 - 1


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of float components, as doubles."""
    return np.floor(1024 * vectors.astype(np.float64))


def _rows(table: pa.Table, name: str) -> np.ndarray:
    col = table.column(name).combine_chunks()
    return np.asarray(col.flatten()).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each vector to each pivot, by one matrix product; exact but for the root while squares stay below 2**53."""
    squares = (vectors * vectors).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n different rows, each the one that is farthest from those before it."""
    chosen, near = [], np.full(len(sample), np.inf)
    while len(chosen) < n and len(sample) and (not chosen or near.max() > 0):
        chosen.append(int(np.argmax(near)) if chosen else 0)
        near = np.minimum(near, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def exactly(*arrays: np.ndarray) -> bool:
    """Whether inner products of these whole numbers are exact in doubles."""
    big = max([1.0, *(float(np.abs(a).max()) for a in arrays if a.size)])
    return big * big * max(1, arrays[0].shape[1]) < 2**51


def search(queries: tuple[np.ndarray, ...], data: tuple[np.ndarray, ...], k: int) -> tuple[list[tuple[int, int, int]], list[int]]:
    """(query, vector, score) of each query's k best in this block that may be of its k best at all, ties to the smaller id; and how many
    candidates were evaluated for each query.

    An inner product is (|q|^2 + |x|^2 - d^2) / 2, and by the triangle inequality d is no less than
    |d(q, p) - d(x, p)| for any pivot p; the largest of these over all pivots gives a candidate's bound. Candidates are evaluated by
    falling bound, until the bound falls below the k-th best score so far, or that of the sample; an equal bound is still
    evaluated, as ids break ties. Numbers too large for exact doubles are compared whole and without bounds.
    """
    (qid, q, qp, least), (vid, x, xp) = queries, data
    exact = exactly(q, x)
    if not exact:
        qi, xi = ([[int(v) for v in r] for r in a] for a in (q, x))
    q2, x2 = (q * q).sum(1), (x * x).sum(1)
    out, evaluated = [], []
    for i in range(len(qid)):
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.float64 if exact else object)
        if exact and xp.shape[1]:
            low = np.abs(xp - qp[i]).max(1)
            low = np.maximum(low * (1 - 1e-9) - 1e-3, 0)
            bound = (q2[i] + x2 - low * low) / 2 * (1 + 1e-12) + 1e-3
            order = np.flatnonzero(bound >= least[i])
            order = order[np.argsort(-bound[order], kind="stable")]
        else:
            bound, order = np.full(len(vid), np.inf), np.arange(len(vid))
        at, step = 0, STEP
        while at < len(order):
            part = order[at : at + step]
            if len(ids) == k and bound[part[0]] < scores[-1]:
                break
            at, step = at + len(part), 2 * step
            part = part[vid[part] != qid[i]]
            new = x[part] @ q[i] if exact else np.array([sum(a * b for a, b in zip(xi[j], qi[i], strict=True)) for j in part], object)
            ids, scores = np.r_[ids, vid[part]], np.r_[scores, new]
            best = np.lexsort((ids, -scores)) if exact else np.array(sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j])), np.int64)
            ids, scores = ids[best[:k]], scores[best[:k]]
        evaluated.append(at)
        out += [(int(qid[i]), int(v), max(-MOST - 1, min(MOST, int(s)))) for v, s in zip(ids, scores, strict=True)]
    return out, evaluated


class Cell:
    """The vectors nearest to one pivot: how many there are, the range of their distances to each pivot, and their greatest square."""

    def __init__(self, n: int = 0, q: int = 0, square: float = -np.inf, low: np.ndarray | None = None, high: np.ndarray | None = None):
        self.n, self.q, self.square, self.low, self.high = n, q, square, low, high


def needed(q: np.ndarray, qp: np.ndarray, least: np.ndarray, cells: list[Cell]) -> np.ndarray:
    """Which cells (columns) may hold any of the k best of which queries (rows): those whose bound doesn't fall below the query's first threshold."""
    out, q2 = np.zeros((len(q), len(cells)), bool), (q * q).sum(1)
    for c, cell in enumerate(cells):
        if cell.n and cell.low is not None and len(cell.low):
            far = np.maximum(np.maximum(cell.low - qp, qp - cell.high), 0).max(1)
            far = np.maximum(far * (1 - 1e-9) - 1e-3, 0)
            out[:, c] = (q2 + cell.square - far * far) / 2 * (1 + 1e-12) + 1e-3 >= least
        else:
            out[:, c] = cell.n > 0
    return out


def query_blocks(cells: list[Cell], size: int) -> list[tuple[int, int]]:
    """For each cell the first block of its queries, and how many blocks there are for them: small cells share one, large ones have several."""
    out, block, room = [], -1, 0
    for cell in cells:
        parts = -(-cell.q // size)
        if parts > 1:
            out.append((block + 1, parts))
            block, room = block + parts, 0
        else:
            if cell.q > room:
                block, room = block + 1, size
            out.append((max(block, 0), 1))
            room -= cell.q
    return out


MEASURED = "id long, v array<double>, is_query boolean, dim int, p array<double>, least double, cell int, square double"


def _met(vectors: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, report: bool) -> DataFrame:
    """(query_id, vec_id, score) of block pairs; for a report instead (query_id, met, evaluated)."""
    v = F.col(f"`{vector_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.cast("array<double>").alias("v"), is_query.alias("is_query"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))).withColumn("dim", F.size("v"))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"))
    common = [r["dim"] for r in sizes.orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()]
    # At most SAMPLE rows in all come to the driver, shared out among the most frequent lengths.
    each = max(1, SAMPLE // max(1, len(common)))
    ranked = rows.filter(F.col("dim").isin(common)).groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(each)).alias("slot")).agg(F.min(F.struct(F.xxhash64("id", F.lit(1)), "id", "v")).alias("s"))
    sample: dict[int, list] = {}
    for r in ranked.select("dim", "s.id", "s.v").orderBy("dim", "id").collect():
        sample.setdefault(r["dim"], []).append((r["id"], r["v"]))
    known = {d: (np.array([i for i, _ in s]), whole_numbers(np.array([x for _, x in s]).reshape(len(s), d))) for d, s in sample.items()}
    pivots = {d: far_apart(x, PIVOTS) if exactly(x) else x[:0] for d, (_, x) in known.items()}

    def measure(batches):
        for b in batches:
            ids, dims, asks = (np.asarray(b.column(c)) for c in (0, 3, 2))
            flat, start = np.asarray(b.column(1).flatten()), np.r_[0, np.cumsum(dims)]
            ends = np.r_[0, np.cumsum([len(pivots[d]) if d in pivots else 0 for d in dims.tolist()])].astype(np.int64)
            far, least, cell, square = np.zeros(ends[-1]), np.full(len(ids), -np.inf), np.zeros(len(ids), np.int32), np.full(len(ids), np.inf)
            for d in np.unique(dims).tolist():
                some = np.flatnonzero(dims == d)
                w = whole_numbers(flat[start[some][:, None] + np.arange(d)]) if d else np.zeros((len(some), 0))
                square[some] = (w * w).sum(1)
                if d not in pivots or not len(pivots[d]):
                    continue
                sid, s = known[d]
                if not exactly(w, s):  # compared whole, in a cell that is always met
                    far[ends[some][:, None] + np.arange(len(pivots[d]))], square[some] = np.nan, np.inf
                    continue
                p = distances(w, pivots[d])
                far[ends[some][:, None] + np.arange(p.shape[1])], cell[some] = p, p.argmin(1)
                mine = np.flatnonzero(asks[some] == True) if len(s) > k else ()  # noqa: E712
                for at in range(0, len(mine), 256):
                    part = mine[at : at + 256]
                    scores = w[part] @ s.T
                    scores[ids[some[part]][:, None] == sid[None]] = -np.inf
                    least[some[part]] = np.partition(scores, len(s) - k, axis=1)[:, len(s) - k]
            told = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(far))
            yield pa.RecordBatch.from_arrays([*b.columns, told, pa.array(least), pa.array(cell), pa.array(square)], ["id", "v", "is_query", "dim", "p", "least", "cell", "square"])

    def ranges(batches):
        """Of each cell what `Cell` holds, a row a task and pivot (and one without)."""
        held: dict[tuple[int, int], Cell] = {}
        for b in batches:
            dims, cells, asks, square = (np.asarray(b.column(c)) for c in (0, 1, 2, 4))
            p, starts = np.asarray(b.column(3).flatten()), np.asarray(b.column(3).offsets)
            for d, c in {*zip(dims.tolist(), cells.tolist(), strict=True)}:
                some = np.flatnonzero((dims == d) & (cells == c))
                width = int(starts[some[0] + 1] - starts[some[0]])
                far = p[(starts[some] - starts[0])[:, None] + np.arange(width)]
                old = held.setdefault((d, c), Cell(low=np.full(width, np.inf), high=np.full(width, -np.inf)))
                whole = ~np.isnan(far).any(1)
                if not whole.all():
                    old.low[:], old.high[:] = -np.inf, np.inf
                old.n, old.q, old.square = old.n + len(some), old.q + int((asks[some] == True).sum()), max(old.square, float(square[some].max()))  # noqa: E712
                if whole.any():
                    old.low, old.high = np.minimum(old.low, far[whole].min(0)), np.maximum(old.high, far[whole].max(0))
        for (d, c), x in held.items():
            n = len(x.low)
            yield pa.RecordBatch.from_arrays([pa.array([d] * (n + 1), pa.int32()), pa.array([c] * (n + 1), pa.int32()), pa.array(np.arange(-1, n, dtype=np.int32)), pa.array([x.n] + [0] * n, pa.int64()), pa.array([x.q] + [0] * n, pa.int64()), pa.array(np.r_[x.square, x.low]), pa.array(np.r_[x.square, x.high])], ["dim", "cell", "pos", "n", "q", "low", "high"])

    kept = rows.mapInArrow(measure, MEASURED)
    told = kept.select("dim", "cell", "is_query", "p", "square").mapInArrow(ranges, "dim int, cell int, pos int, n long, q long, low double, high double")
    told = told.groupBy("dim", "cell", "pos").agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.min("low").alias("low"), F.max("high").alias("high"))
    cells: dict[int, list[Cell]] = {}
    for r in told.orderBy("dim", "cell", "pos").collect():  # PIVOTS rows and one for each cell, of which there are PIVOTS for each of LENGTHS lengths; lengths without pivots are one cell
        here = cells.setdefault(r["dim"], [])
        while len(here) <= r["cell"]:
            here.append(Cell())
        x = here[r["cell"]]
        if r["pos"] < 0:
            x.n, x.q, x.square, x.low, x.high = r["n"], r["q"], r["high"], [], []
        else:
            x.low.append(r["low"])
            x.high.append(r["high"])
    for x in (x for here in cells.values() for x in here if x.low is not None):
        x.low, x.high = np.array(x.low), np.array(x.high)
    parts = {d: [-(-x.n // BLOCK) for x in here] for d, here in cells.items()}
    asked = {d: query_blocks(here, QUERY_BLOCK) for d, here in cells.items()}

    def sent(batches):
        """Queries, for each part of each cell that they need."""
        for b in batches:
            ids, dims, of = (np.asarray(b.column(c)) for c in (0, 3, 6))
            for d in np.unique(dims).tolist():
                some = np.flatnonzero(dims == d)
                part = b.take(pa.array(some))
                whole = pa.Table.from_batches([part])
                q, qp = whole_numbers(_rows(whole, "v")), _rows(whole, "p")
                qp = qp if qp.size else np.zeros((len(some), 0))
                which = np.ones((len(some), len(cells[d])), bool) if np.isnan(qp).any() or np.isinf(np.asarray(part.column(7))).any() else needed(q, qp, np.asarray(part.column(5)), cells[d])
                row, cell = np.nonzero(which & np.array([x.n > 0 for x in cells[d]]))
                first, count = (np.array([asked[d][c][i] for c in of[some].tolist()]) for i in (0, 1))
                block = (first + (K.mix(ids[some].astype(np.uint64)) % count.astype(np.uint64)).astype(np.int64))[row]
                times = np.array(parts[d])[cell]
                row, cell, block, sub = np.repeat(row, times), np.repeat(cell, times), np.repeat(block, times), np.concatenate([np.arange(t) for t in times] or [np.zeros(0, np.int64)])
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row)) for c in (0, 1, 4, 3, 5)), pa.array(block.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(sub.astype(np.int32))], ["id", "v", "p", "dim", "least", "qb", "cell", "sub"])

    asking = rows.filter("is_query").mapInArrow(measure, MEASURED).groupBy("id").agg(F.min(F.struct("v", "is_query", "dim", "p", "least", "cell", "square")).alias("s")).select("id", "s.*")
    queries = asking.mapInArrow(sent, "id long, v array<double>, p array<double>, dim int, least double, qb int, cell int, sub int")
    wanted = queries.select(F.col("dim").alias("of"), F.col("cell").alias("at"), F.col("qb").alias("by")).distinct()

    def placed(batches):
        for b in batches:
            dims, of, ids = (np.asarray(b.column(c)) for c in (3, 6, 0))
            n = np.array([parts[d][c] for d, c in zip(dims.tolist(), of.tolist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (0, 1, 4, 3, 6)), pa.array((K.mix(ids.astype(np.uint64)) % np.maximum(n, 1).astype(np.uint64)).astype(np.int32))], ["id", "v", "p", "dim", "cell", "sub"])

    data = kept.mapInArrow(placed, "id long, v array<double>, p array<double>, dim int, cell int, sub int")
    data = data.join(wanted, (F.col("dim") == F.col("of")) & (F.col("cell") == F.col("at"))).select("id", "v", "p", "dim", F.col("by").alias("qb"), "cell", "sub")
    names = ("query_id", "met", "evaluated") if report else ("query_id", "vec_id", "score")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        q, x = ((np.asarray(t.column("id")), whole_numbers(_rows(t, "v")), _rows(t, "p")) for t in (left, right))
        if np.isnan(q[2]).any() or np.isnan(x[2]).any():  # numbers too large for distances
            q, x = ((*t[:2], t[2][:, :0]) for t in (q, x))
        found, evaluated = search((*q, np.asarray(left.column("least"))), x, k) if len(q[0]) and len(x[0]) else ([], [])
        if report:
            found = [(int(i), len(x[0]), n) for i, n in zip(q[0], evaluated, strict=False)]
        return pa.table({n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate(names)})

    keys = ["dim", "qb", "cell", "sub"]
    return queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(meet, ", ".join(f"{n} long" for n in names))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k highest integer inner products over all other rows: query_id, rank, vec_id, score.

    Components are taken as floor(1024 * x). Vectors that are null or hold null or non-finite components,
    and rows without an id, take no part; vectors of different lengths aren't compared; rows with the query's
    id are its own; of rows that share a query's id the smallest vector is the query; scores beyond
    64 bits are cut to them; with fewer than k others all are returned; an empty table gives no rows; other columns don't matter.
    A very long vector is one row like any other.

    SAMPLE rows come to the driver; PIVOTS of them that lie far apart are the pivots, and a query's k-th best score among
    all of them is where its threshold starts in every block. Vectors are dealt to the cell of their nearest pivot, and cells to blocks of
    BLOCK vectors at most. A cell's ranges of distances to all pivots bound what any of its vectors can score: a query goes to
    the cells alone whose bound reaches its threshold, and a vector to the blocks of queries that want its cell. A pair of blocks is one
    task's work; in it the table of distances is looked at vector by vector.
    """
    met = _met(vectors, is_query, k, id_col, vector_col, False)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def elimination(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query of `top_k` that meets any block: how many vectors its blocks hold, and how many of them had to be evaluated (query_id, met, evaluated)."""
    found = _met(vectors, is_query, k, id_col, vector_col, True)
    return found.groupBy("query_id").agg(F.sum("met").alias("met"), F.sum("evaluated").alias("evaluated"))


def op3_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id AS vec_id, list_inner_product(q.e, x.e)::BIGINT AS score FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
