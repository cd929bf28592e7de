"""Whitening of embeddings from an exact integer scatter matrix.

Entries become integers x = floor(scale * c) + offset. The fit list is every distinct vector x once. A shift (the
offset) is subtracted, and sums and cross-products of what is left are accumulated in integers of any
size: values are cut into limbs of 20 bits, limbs are multiplied as doubles in blocks that are small enough to be
exact, and the blocks' products are added as integers. Tasks hand their totals on as limbs of 32 bits, which Spark adds
up; only matrices of the dimension's size reach the driver, however many rows there are. There n * X'X - S * S'
is formed exactly, converted to doubles once, divided by n * n, and decomposed by eigh. The shift cancels.

Edge cases: rows whose vector is null, or holds a null or an entry that is not finite, are dropped. Vectors of
differing length: the length that most distinct vectors have (of equally many, the longer) is whitened, rows of
another length (the empty vector too) are dropped. Entries beyond 2**62 after scaling count as 2**62. Components
whose eigenvalue cannot be told from rounding (below 1e4 * dimension * 2**-52 of the largest) have no unit variance
and are left out, so that one vector alone, or equal ones, give no rows. Repeated rows and ids are each returned; a
null id stays null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

LIMB = 20  # bits; two limbs and 2**12 rows stay below 2**53
BLOCK = 1 << 12
WORD = 32  # bits of the limbs that Spark adds up
MOST = float(1 << 62)


def quantised(column: pa.Array, scale: float, offset: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places of rows, their vectors x as a matrix), for each length that occurs among the vectors that stay."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1), np.int64)
    present = np.flatnonzero(sizes >= 0)
    values = np.asarray(pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False), np.float64)
    begin = np.cumsum(sizes[present]) - sizes[present]
    out = []
    for size in np.unique(sizes[present]).tolist():
        mine = np.flatnonzero(sizes[present] == size)
        matrix = values[begin[mine][:, None] + np.arange(size)]
        with np.errstate(over="ignore", invalid="ignore"):
            good = np.isfinite(matrix).all(axis=1)
            scaled = np.clip(np.floor(scale * matrix[good]), -MOST, MOST)
        out.append((present[mine[good]], scaled.astype(np.int64) + offset))
    return out


def packed(vectors: np.ndarray) -> list[bytes]:
    """Each vector in the fewest bytes an entry that hold it, after that number: equal vectors have equal bytes."""
    out = [b""] * len(vectors)
    low, high = vectors.min(axis=1, initial=0), vectors.max(axis=1, initial=0)
    width = np.select([(low >= -(1 << b - 1)) & (high < 1 << b - 1) for b in (8, 16, 32)], [1, 2, 4], 8)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        flat, step = vectors[rows].astype(f"<i{w}").tobytes(), w * vectors.shape[1]
        for k, r in enumerate(rows.tolist()):
            out[r] = bytes([w]) + flat[k * step : (k + 1) * step]
    return out


def unpacked(contents: list[bytes]) -> np.ndarray:
    """The vectors again; all of one length."""
    dim = (len(contents[0]) - 1) // contents[0][0]
    out = np.empty((len(contents), dim), np.int64)
    width = np.frombuffer(b"".join([c[:1] for c in contents]), np.uint8)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        out[rows] = np.frombuffer(b"".join([contents[r][1:] for r in rows.tolist()]), f"<i{w}").reshape(len(rows), dim)
    return out


class Scatter:
    """n, sums and cross-products of vectors of integers below 2**63, exact whatever their number."""

    def __init__(self, dim: int) -> None:
        self.n = 0
        self.sums = np.zeros(dim, object)
        self.products = np.zeros((dim, dim), object)

    def add(self, vectors: np.ndarray) -> None:
        for k in range(0, len(vectors), BLOCK):
            block = vectors[k : k + BLOCK]
            limbs, rest = [], block
            while True:  # the lowest limbs are not negative, the highest one has the sign
                if not len(block) or max(int(rest.max(initial=0)), -int(rest.min(initial=0))) < 1 << LIMB:
                    limbs.append(rest.astype(np.float64))
                    break
                limbs.append((rest & (1 << LIMB) - 1).astype(np.float64))
                rest = rest >> LIMB
            self.n += len(block)
            for a, left in enumerate(limbs):
                self.sums += left.sum(axis=0).astype(np.int64).astype(object) << LIMB * a
                for b, right in enumerate(limbs):
                    self.products += (left.T @ right).astype(np.int64).astype(object) << LIMB * (a + b)

    def rows(self) -> list[tuple[int, int, int, int]]:
        """(i, j, k, limb): the value at i <= j is the sum of limb << 32 * k; sums are at (i, -1), n at (-1, -1)."""
        values = [(-1, -1, self.n)]
        for i, s in enumerate(self.sums.tolist()):
            values.append((i, -1, s))
            values += [(i, j, v) for j, v in enumerate(self.products[i].tolist()) if j >= i]
        out = []
        for i, j, v in values:
            sign, v, k = (-1 if v < 0 else 1), abs(v), 0
            while v:
                out.append((i, j, k, sign * (v & (1 << WORD) - 1)))
                v >>= WORD
                k += 1
        return out


class Fit:
    """n, the sums S of the vectors x, and the components of x's covariance."""

    def __init__(self, n: int, sums: list[int], products: dict[tuple[int, int], int], shift: int, components: int) -> None:
        dim = len(sums)
        self.n = n
        self.sums = [s + n * shift for s in sums]
        covariance = np.zeros((dim, dim))
        for i in range(dim):
            for j in range(i, dim):  # integers of any size; one rounding, in the division
                covariance[i, j] = covariance[j, i] = (n * products.get((i, j), 0) - sums[i] * sums[j]) / (n * n)
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        order = order[values[order] > 1e4 * dim * 2.0**-52 * max(values.max(initial=0.0), 0.0)]
        self.values, self.vectors = values[order], vectors[:, order]
        trace = float(np.trace(covariance))
        self.explained = self.values / trace if trace > 0 else self.values

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit integers where they hold the sum of its squares, else Python's."""
        most = max([abs(s) for s in self.sums], default=0) + self.n * max(int(x.max(initial=0)), -int(x.min(initial=0)))
        kind = np.int64 if most < 1 << 62 else object
        out = x.astype(kind) * self.n - np.array(self.sums, kind)
        widest = max(int(out.max(initial=0)), -int(out.min(initial=0)))
        return out if widest * widest * max(1, x.shape[1]) < 1 << 62 else out.astype(object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ self.vectors / np.sqrt(self.values)


def _totals(rows: DataFrame) -> dict[tuple[int, int], int]:
    """(i, j) -> value, of the limbs that all tasks gave."""
    out: dict[tuple[int, int], int] = {}
    for r in rows.groupBy("i", "j", "k").agg(F.sum("limb").alias("limb")).collect():  # as many as a matrix has entries, times a few limbs
        out[r["i"], r["j"]] = out.get((r["i"], r["j"]), 0) + (r["limb"] << WORD * r["k"])
    return out


def fit(vectors: DataFrame, dim: int, components: int, shift: int) -> Fit | None:
    """The fit on a table of distinct ``vector``s (packed, less ``shift``) of one length; None without any."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Scatter(dim)
        for batch in batches:
            if batch.num_rows:
                total.add(unpacked(batch.column("vector").to_pylist()))
        if total.n:
            columns = [pa.array(c, pa.int64()) for c in zip(*total.rows(), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "k", "limb"])

    totals = _totals(vectors.mapInArrow(scatter, "i long, j long, k long, limb long"))
    sums = [totals.get((i, -1), 0) for i in range(dim)]
    return Fit(totals[-1, -1], sums, totals, shift, components) if totals else None


def identity_error(vectors: DataFrame, found: Fit, shift: int) -> float:
    """The largest absolute entry of (covariance of the whitened vectors, minus the identity), from the vectors themselves."""
    width = len(found.values)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            if batch.num_rows:
                w = found.whitened(found.centred(unpacked(batch.column("vector").to_pylist()) + shift))
                w = np.hstack([np.ones((len(w), 1)), w])
                total += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(x.reshape(-1)) for x in (i, j, total)], names=["i", "j", "sum"])

    rows = vectors.mapInArrow(moments, "i long, j long, sum double").groupBy("i", "j").agg(F.sum("sum").alias("sum")).collect()
    total = np.zeros((width + 1, width + 1))
    for r in rows:
        total[r["i"], r["j"]] = r["sum"]
    total /= found.n
    return float(np.abs(total[1:, 1:] - np.outer(total[0, 1:], total[0, 1:]) - np.eye(width)).max(initial=0.0))


def whiten(embeddings: DataFrame, components: int = 16, scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation decimal, whitened, explained, identity_error) for each row that stays and component.

    ``deviation`` is the exact sum over dimensions of (n * x - S)**2, null where it has more than 38 digits.
    """
    vec_id = embeddings.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {vec_id}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in quantised(batch.column("embedding"), scale, offset):
                if x.size:
                    rows = list(dict.fromkeys(packed(x - offset)))
                    yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]] * len(rows), pa.int32()), pa.array(rows, pa.binary())], names=["dim", "vector"])

    # distinct vectors, equal ones of a task together before they are moved
    lists = materialise(embeddings.select("embedding").mapInArrow(pack, "dim int, vector binary").distinct(), "vectors")
    length = lists.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).head(1)
    found = fit(lists.where(F.col("dim") == length[0]["dim"]).select("vector"), length[0]["dim"], components, offset) if length else None
    if found is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    dim = length[0]["dim"]
    error = identity_error(lists.where(F.col("dim") == dim).select("vector"), found, offset)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(found.values)
        for batch in batches:
            for rows, x in quantised(batch.column("embedding"), scale, offset):
                if x.shape[1] != dim or not len(x) or not width:
                    continue
                centred = found.centred(x)
                deviation = [int(v) if int(v) < 10**38 else None for v in (centred * centred).sum(axis=1).tolist()]
                each = np.repeat(np.arange(len(x)), width)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(rows[each])),
                        pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(each), found.n, np.int64)),
                        pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(each)),
                        pa.array(found.whitened(centred).reshape(-1)),
                        pa.array(np.tile(found.explained, len(x))),
                        pa.array(np.full(len(each), error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return embeddings.select("vec_id", "embedding").mapInArrow(project, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS long)"))  # null where 64 bits don't hold it
