"""Product codes of vectors by ball k-means, exact in integers.

Components become floor(1024 * x), vectors are cut into PARTS equal consecutive parts, and each part position has a codebook of at most
ENTRIES entries, at first the parts of the rows with the smallest ids. A round assigns every part to its nearest entry (squared Euclidean
distance, ties to the lower index) and moves each entry to the componentwise floor of its parts' mean.

After the first assignment an entry and its parts are a ball. With D the squared distances between entries and r the farthest part's
distance, only entries with D <= 4 r^2 are its neighbours. A part with 4 d^2 below the least D lies in the stable core and stays unseen.
The other parts lie in rings: one at distance d has as candidates the entries with D <= 4 d^2 alone, as all others are farther by the
triangle inequality. Parts of rings with about as many candidates (powers of two) are compared together. All bounds are compared as exact
integers and let equality through, so results are those of comparing every part with every entry. Radii are those of the parts in one
Arrow batch: smaller balls with fewer neighbours, and nothing to exchange.

A round is one pass without a shuffle of vectors: tasks return sums by (part, entry), which are added by Spark; the codebooks, whose size
doesn't depend on the number of rows, go through the driver. Codes are written with the vectors after each round, to the shared folder.

Defined results: rows whose vector is null, or has a null or non-finite component, or another length than the first kept row's (by id), are
dropped; a length that isn't a multiple of PARTS is filled up with zeros; empty vectors have no parts and errors of 0. Rows without an
id come last in the order of ids; rows that share an id are ordered by their vectors. Fewer rows than ENTRIES make as many entries. Components beyond
limit() are set to it, as the errors of others don't fit a long. Repeated rows count each; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored, temporary

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Rows of an Arrow batch: the more, the more parts a ball has.
ROWS = 16_384
#: Magnitudes up to this give products whose sums a double holds exactly.
_EXACT = 1 << 22


def limit(length: int) -> int:
    """The largest magnitude of a component for which sums of squared differences of whole vectors fit a long."""
    return math.isqrt((1 << 62) // (4 * max(1, length)))


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all entries, int64."""
    if max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0))) <= _EXACT and points.shape[1] <= 64:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return (((p * p).sum(1)[:, None] - 2 * (p @ e.T)) + (e * e).sum(1)).astype(np.int64)
    out = np.zeros((len(points), len(entries)), np.int64)
    for c in range(points.shape[1]):
        out += (points[:, c, None] - entries[None, :, c]) ** 2
    return out


def assign_all(points: np.ndarray, entries: np.ndarray, block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries and squared distances, each point compared with each entry."""
    near, far = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    for i in range(0, len(points), block):
        d = distances(points[i : i + block], entries)
        near[i : i + block] = d.argmin(1)
        far[i : i + block] = d.min(1)
    return near, far


class Balls:
    """The entries of one codebook, with all others of each by their distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        between = distances(entries, entries)
        np.fill_diagonal(between, -1)  # an entry itself comes first, also before equal ones
        self.order = np.argsort(between, axis=1, kind="stable")
        self.between = np.take_along_axis(between, self.order, axis=1)

    def assign(self, points: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entries and squared distances of points that were assigned to before; and how many distances that took."""
        near, far = before.copy(), ((points - self.entries[before]) ** 2).sum(1)
        seen = len(points)
        members = np.argsort(before, kind="stable")
        stops = np.searchsorted(before[members], np.arange(len(self.entries) + 1))
        for j in range(len(self.entries)):
            ball = members[stops[j] : stops[j + 1]]
            if not len(ball) or len(self.entries) == 1:
                continue
            reach = 4 * far[ball]
            rings = np.searchsorted(self.between[j], reach, side="right")  # candidates, the entry itself included
            shells = np.ceil(np.log2(rings)).astype(np.int64)
            for s in np.unique(shells[rings > 1]).tolist():  # rings of 1 are the stable core
                ring = ball[shells == s]
                candidates = np.sort(self.order[j, : 1 << s])
                d = distances(points[ring], self.entries[candidates])
                seen += d.size
                best = d.argmin(1)
                near[ring], far[ring] = candidates[best], d[np.arange(len(ring)), best]
        return near, far, seen


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and the integer components x of the kept rows, of one length that is a multiple of PARTS."""
    e = F.col("embedding")
    sound = e.isNotNull() & F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = embeddings.filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform(e, lambda x: F.floor(x.cast("double") * SCALE)).alias("x"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select(F.size("x")).limit(1).collect()
    length = first[0][0] if first else 0
    most = limit(length + -length % PARTS)
    held = F.transform("x", lambda x: F.greatest(F.least(x, F.lit(most)), F.lit(-most)))
    filled = F.concat(held, F.array_repeat(F.lit(0).cast("long"), -length % PARTS)) if length % PARTS else held
    return rows.filter(F.size("x") == length).withColumn("x", filled)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1).astype(np.int64)


def _rows(batch: pa.RecordBatch, near: np.ndarray, far: np.ndarray, label: pa.Array) -> pa.RecordBatch:
    code = [pa.FixedSizeListArray.from_arrays(pa.array(a.reshape(-1)), PARTS).cast(pa.list_(pa.int64())) for a in (near, far)]
    return pa.record_batch([batch.column("vec_id"), label, batch.column("x"), *code], names=["vec_id", "label", "x", "near", "far"])


def _assign(books: np.ndarray, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Nearest entry and distance of each part; books is PARTS x entries x components of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = None if first else [Balls(b) for b in books]
        for batch in batches:
            n = batch.num_rows
            near, far = np.zeros((n, PARTS), np.int64), np.zeros((n, PARTS), np.int64)
            if n and books.size:
                parts = _matrix(batch.column("x"), n).reshape(n, PARTS, -1)
                before = None if first else _matrix(batch.column("near"), n)
                for m in range(PARTS):
                    points = np.ascontiguousarray(parts[:, m])
                    near[:, m], far[:, m] = assign_all(points, books[m]) if first else balls[m].assign(points, before[:, m])[:2]
            yield _rows(batch, near, far, batch.column("label"))

    return run


def _sums(entries: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row a task, part and used entry: how many parts it has, and their componentwise sums as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, width), object)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            parts, near = _matrix(batch.column("x"), n).reshape(n, PARTS, width), _matrix(batch.column("near"), n)
            for m in range(PARTS):
                order = np.argsort(near[:, m], kind="stable")
                used, starts, many = np.unique(near[order, m], return_index=True, return_counts=True)
                count[m, used] += many
                total[m, used] += np.add.reduceat(parts[order, m], starts, axis=0).astype(object)
        m, j = np.nonzero(count)
        sums = pa.array([[int(v) for v in t] for t in total[m, j]], pa.list_(pa.decimal128(38, 0)))
        yield pa.record_batch([pa.array(m), pa.array(j), pa.array(count[m, j]), sums], names=["part", "entry", "n", "sums"])

    return run


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each used entry at the componentwise floor of its parts' mean."""
    entries, width = books.shape[1:]
    partial = rows.select("x", "near").mapInArrow(_sums(entries, width), "part long, entry long, n long, sums array<decimal(38,0)>")
    sums = [F.sum(F.get("sums", F.lit(c))).alias(f"s{c}") for c in range(width)]
    out = books.copy()
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        out[r["part"], r["entry"]] = [int(r[f"s{c}"]) // r["n"] for c in range(width)]
    return out


def train(embeddings: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, label, x, near, far) assigned to the final codebooks, and these (PARTS x entries x components of a part)."""
    spark = prepare(embeddings.sparkSession, ROWS)
    kept = integers(embeddings)
    seeds = [r["x"] for r in kept.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()]
    whole = np.array(seeds, np.int64).reshape(len(seeds), PARTS, len(seeds[0]) // PARTS if seeds else 0)
    books = np.ascontiguousarray(whole.transpose(1, 0, 2))
    kind = dict(embeddings.dtypes)["label"]
    schema = f"vec_id long, label {kind}, x array<long>, near array<long>, far array<long>"
    rows = kept
    with temporary(spark):
        for r in range(rounds):
            rows = stored(rows.mapInArrow(_assign(books, r == 0), schema), "codes", compression="zstd")
            if books.size:
                books = moved(rows, books)
        rows = stored(rows.mapInArrow(_assign(books, rounds == 0), schema), "codes", keep=True, compression="zstd")
    return rows, books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimals with commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """Per kept row: vec_id, code, error, label_error, codebooks_sha256."""
    rows, books = train(embeddings, rounds, entries)
    code = F.lower(F.concat_ws("", F.transform("near", lambda j: F.lpad(F.hex(j), 2, "0"))))
    error = F.aggregate("far", F.lit(0).cast("long"), lambda a, b: a + b)
    coded = rows.select("vec_id", F.col("label").alias("label"), code.alias("code"), error.alias("error"))
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(length: int = 64, rounds: int = ROUNDS, entries: int = ENTRIES) -> str:
    """SQL of another engine for the rows of compress() over embeddings of one length: each part compared with each entry."""
    width = length // PARTS
    steps = [f"""v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, label, m, x[m * {width} + 1:(m + 1) * {width}] AS x FROM v, range({PARTS}) AS r(m)
), e0 AS MATERIALIZED (
  SELECT m, j, x FROM (SELECT m, row_number() OVER (PARTITION BY m ORDER BY vec_id) - 1 AS j, x FROM p) WHERE j < {entries}
)"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT p.vec_id, p.m, min({{'d': list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, e.x) + list_inner_product(e.x, e.x), 'j': e.j}}) AS a FROM p JOIN e{r} e ON e.m = p.m GROUP BY p.vec_id, p.m
)""")
        if r < rounds:
            steps.append(f"""s{r} AS (
  SELECT m, j, c, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT p.m, a.a.j AS j, unnest(range(1, {width + 1})) AS c, unnest(p.x) AS x FROM p JOIN a{r} a ON a.vec_id = p.vec_id AND a.m = p.m) GROUP BY m, j, c
), e{r + 1} AS MATERIALIZED (
  SELECT e.m, e.j, coalesce(u.x, e.x) AS x FROM e{r} e LEFT JOIN (
    SELECT m, j, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY c) AS x FROM s{r} GROUP BY m, j
  ) u ON u.m = e.m AND u.j = e.j
)""")
    return f"""
WITH {", ".join(steps)}, b AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY m, j, c)) AS codebooks_sha256 FROM (SELECT m, j, unnest(range(1, {width + 1})) AS c, unnest(x) AS x FROM e{rounds})
), r AS (
  SELECT v.vec_id, v.label, string_agg(printf('%02x', a.a.j), '' ORDER BY a.m) AS code, CAST(sum(a.a.d) AS BIGINT) AS error FROM v JOIN a{rounds} a USING (vec_id) GROUP BY v.vec_id, v.label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, b
"""
