"""Count regression on covariates over all cells, without a task that holds them.

A regression (unit) has sparse entries: cells where its x or y isn't zero. All other cells are told
apart by their covariates alone, so they enter as distinct covariate rows with a number of cells, and
so do entries of a unit that are equal in x, y and covariates. Both are packed once into blocks and stored. A round sends the coefficients of a block of units to
its entries and to the covariate blocks; each yields the units' sums (score and information, or
what the dispersion asks), which add up by block of units; the step is taken on the executors.
Units that have settled leave the rounds. Entries of a hot unit are many blocks.

Log link throughout: mean = exp(offset + coefficients . (1, [x,] covariates)). Variance is
mean + alpha * mean^2, with alpha 0 for Poisson.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Units, covariate rows, and entries of a block.
UNITS, ROWS, ENTRIES = 512, 2048, 65_536
#: Rounds at most, and the step and relative score at which a unit has settled.
MOST_ROUNDS, STEP, SCORE = 60, 1e-9, 1e-10
#: The linear predictor stays within this.
FURTHEST = 80.0

PARAMETERS = "ub long, ids array<long>, live int, b binary, alpha binary, done binary, more binary"


def _matrix(x: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(x, np.float64).reshape(-1, columns).copy()


class Block:
    """Covariate rows or entries of units, with numbers of cells: ``z`` has a row each, ``x`` stands in column 1 if there is one."""

    def __init__(self, z: np.ndarray, offset: np.ndarray, n: np.ndarray, unit: np.ndarray | None, y: np.ndarray | None, has_x: bool):
        self.z, self.offset, self.n, self.unit, self.y, self.has_x = z, offset, n, unit, y, has_x
        self.pairs = np.triu_indices(z.shape[1])

    def sums(self, b: np.ndarray, alpha: np.ndarray, live: np.ndarray, terms: Callable) -> np.ndarray:
        """A row of sums for each unit; those that aren't live stay 0."""
        if self.unit is None:
            out = np.zeros((len(b), terms.width(self.z.shape[1])))
            at = np.flatnonzero(live)
            if len(at):
                mean = np.exp(np.clip(b[at] @ self.z.T + self.offset, -FURTHEST, FURTHEST))
                out[at] = terms.dense(mean, alpha[at][:, None], self.n, self.z, self.pairs)
            return out
        keep = live[self.unit]
        u, z, y, offset, n = self.unit[keep], self.z[keep], self.y[keep], self.offset[keep], self.n[keep]
        bare = z.copy()
        if self.has_x:
            bare[:, 1] = 0
        mean, zero = (np.exp(np.clip((b[u] * v).sum(axis=1) + offset, -FURTHEST, FURTHEST)) for v in (z, bare))
        each = terms.entry(y, mean, alpha[u], z, self.pairs) - terms.entry(np.zeros(len(y)), zero, alpha[u], bare, self.pairs)
        out = np.zeros((len(b), each.shape[1]))
        np.add.at(out, u, each * n[:, None])
        return out


class Newton:
    """Score and information."""

    @staticmethod
    def width(p: int) -> int:
        return p + p * (p + 1) // 2

    @staticmethod
    def dense(mean: np.ndarray, alpha: np.ndarray, n: np.ndarray, z: np.ndarray, pairs: tuple) -> np.ndarray:
        w = n * mean / (1 + alpha * mean)
        return np.hstack([-w @ z, w @ (z[:, pairs[0]] * z[:, pairs[1]])])

    @staticmethod
    def entry(y: np.ndarray, mean: np.ndarray, alpha: np.ndarray, z: np.ndarray, pairs: tuple) -> np.ndarray:
        v = 1 + alpha * mean
        return np.hstack([((y - mean) / v)[:, None] * z, (mean / v)[:, None] * z[:, pairs[0]] * z[:, pairs[1]]])


class Spread:
    """Squared Pearson residuals at ``alpha`` and their slope in it, excess of squares over means, squared means, means."""

    @staticmethod
    def width(p: int) -> int:
        return 5

    @staticmethod
    def dense(mean: np.ndarray, alpha: np.ndarray, n: np.ndarray, z: np.ndarray, pairs: tuple) -> np.ndarray:
        v = 1 + alpha * mean
        return np.stack([(n * mean / v).sum(1), -(n * mean * mean / (v * v)).sum(1), (n * (mean * mean - mean)).sum(1), (n * mean * mean).sum(1), (n * mean).sum(1)], axis=1)

    @staticmethod
    def entry(y: np.ndarray, mean: np.ndarray, alpha: np.ndarray, z: np.ndarray, pairs: tuple) -> np.ndarray:
        v, d = mean * (1 + alpha * mean), (y - mean) ** 2
        return np.stack([d / v, -d * mean * mean / (v * v), d - mean, mean * mean, mean], axis=1)


def newton_step(b: np.ndarray, sums: np.ndarray, scale: float, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """New coefficients, which units have settled, and the standard errors at the old ones. The first coefficient is never penalised."""
    p = b.shape[1]
    i, j = np.triu_indices(p)
    info = np.zeros((len(b), p, p))
    info[:, i, j] = info[:, j, i] = sums[:, p:]
    penalty = np.diag([0.0] + [ridge] * (p - 1))
    score = sums[:, :p] - b @ penalty
    inverse = np.linalg.pinv(info + penalty, hermitian=True)
    step = np.clip((inverse @ score[:, :, None])[:, :, 0], -5, 5)
    settled = (np.abs(step).max(axis=1) < STEP) | (np.abs(score).max(axis=1) < SCORE * (1 + scale))
    return b + step, settled, np.sqrt(np.maximum(np.diagonal(inverse, axis1=1, axis2=2), 0))


def told_cells(cells: DataFrame) -> DataFrame:
    """cell_id, offset, c as the regression reads them: nulls are 0."""
    return cells.select("cell_id", F.coalesce("offset", F.lit(0.0)).cast("double").alias("offset"), F.transform("c", lambda v: F.coalesce(v.cast("double"), F.lit(0.0))).alias("c"))


class Regression:
    """Units with their entries, and covariates of all cells, packed and stored.

    ``entries``: unit, cell_id, x, y (one row for a cell of a unit where x or y isn't 0; without
    ``has_x`` x isn't read). ``cells``: cell_id, offset, c (an array of as many numbers for each
    cell). Units without entries don't come up. Entries of unknown cells are left out; a null x, y,
    offset or covariate counts as 0; NaN is not allowed. Instead of cell_id entries may have offset and
    c of :func:`told_cells` and n, a number of cells; those that are equal in all but n add up.
    """

    def __init__(self, entries: DataFrame, cells: DataFrame, has_x: bool):
        self.has_x, self.spark = has_x, entries.sparkSession
        cells = stored(told_cells(cells), "regression-cells")
        widths = cells.agg(F.min(F.size("c")), F.max(F.size("c")), F.count("*")).first()
        if widths[0] != widths[1]:
            raise ValueError("cells have covariates of different number")
        self.n_cells, self.p = widths[2], 1 + has_x + (widths[0] or 0)
        rows = stored(cells.groupBy("offset", "c").agg(F.count("*").cast("double").alias("n")), "regression-distinct")
        n_rows = rows.count()
        if "n" not in entries.columns:
            entries = entries.join(cells, "cell_id").withColumn("n", F.lit(1.0))
        entries = entries.select("unit", (F.coalesce("x", F.lit(0.0)) if has_x else F.lit(0.0)).cast("double").alias("x"), F.coalesce("y", F.lit(0.0)).cast("double").alias("y"), "offset", "c", "n")
        entries = stored(entries.groupBy("unit", "x", "y", "offset", "c").agg(F.sum("n").alias("n")).filter("n != 0"), "regression-entries")
        sizes = entries.groupBy("unit").agg(F.count("*").alias("n"))
        n_units = sizes.count()
        self.n_blocks = max(1, -(-n_units // UNITS))
        ub = F.pmod(F.xxhash64("unit"), F.lit(self.n_blocks))
        units = sizes.groupBy(ub.alias("ub")).agg(F.array_sort(F.collect_list("unit")).alias("ids"), F.sum("n").alias("n"))  # about UNITS units each
        self.units = stored(units, "regression-units")
        chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / ENTRIES)).cast("long")
        told = entries.withColumn("ub", ub).join(self.units.select("ub", "ids", chunks.alias("_chunks")), "ub")
        told = told.withColumns({"chunk": F.pmod(F.xxhash64("x", "y", "offset", "c"), F.col("_chunks")), "k": F.array_position("ids", F.col("unit")) - 1})
        p, has = self.p, has_x

        def packed(t: pa.Table) -> pa.Table:
            z = np.ones((t.num_rows, p))
            if has:
                z[:, 1] = t.column("x").to_numpy()
            z[:, 1 + has :] = t.column("c").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            return pa.table({"ub": [t.column("ub")[0].as_py()], "n": [t.column("n").to_numpy().tobytes()], "k": [t.column("k").to_numpy().astype(np.int64).tobytes()], "y": [t.column("y").to_numpy().tobytes()], "offset": [t.column("offset").to_numpy().tobytes()], "z": [z.tobytes()]}, schema=SCHEMA)

        def dense(t: pa.Table) -> pa.Table:
            z = np.ones((t.num_rows, p))
            if has:
                z[:, 1] = 0
            z[:, 1 + has :] = t.column("c").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            return pa.table({"ub": [None], "n": [t.column("n").to_numpy().tobytes()], "k": [None], "y": [None], "offset": [t.column("offset").to_numpy().tobytes()], "z": [z.tobytes()]}, schema=SCHEMA)

        kind = "ub long, n binary, k binary, y binary, offset binary, z binary"
        self.entries = stored(told.select("ub", "chunk", "n", "k", "y", "x", "offset", "c").groupBy("ub", "chunk").applyInArrow(packed, kind), "regression-blocks")
        block = F.pmod(F.xxhash64("offset", "c"), F.lit(max(1, -(-n_rows // ROWS))))
        self.rows = stored(rows.groupBy(block.alias("block")).applyInArrow(dense, kind), "regression-rows")

    def start(self, alpha: float = 0.0) -> DataFrame:
        """Parameters at the first round: coefficients 0."""
        p = self.p

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = [len(ids) for ids in batch.column("ids").to_pylist()]
                zero = lambda w: pa.array([np.zeros((k, w)).tobytes() for k in n], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("ub"), batch.column("ids"), pa.array(n, pa.int32()), zero(p), pa.array([np.full(k, alpha).tobytes() for k in n], pa.binary()), pa.array([np.zeros(k, bool).tobytes() for k in n], pa.binary()), zero(p)], names=ROUND.names)

        return stored(self.units.select("ub", "ids").mapInArrow(first, PARAMETERS), "regression-round")

    def _summed(self, parameters: DataFrame, terms: type) -> DataFrame:
        """ub, sums: one row for each task that met the block of units."""
        p, has_x = self.p, self.has_x
        live = parameters.select("ub", "b", "alpha", "done")
        # every covariate row is a cell of every unit: blocks of rows by blocks of units
        grid = self.rows.withColumn("ub", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.n_blocks - 1).cast("long")))).join(live, "ub")
        both = grid.select("ub", "n", "k", "y", "offset", "z", "b", "alpha", "done").unionByName(self.entries.join(live, "ub"))

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for i in range(batch.num_rows):  # block by block, each read where it stands
                    at = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind) if batch.column(c)[i].is_valid else None  # noqa: B023, E731
                    block = Block(at("z", np.float64).reshape(-1, p), at("offset", np.float64), at("n", np.float64), at("k", np.int64), at("y", np.float64), has_x)
                    s = block.sums(at("b", np.float64).reshape(-1, p), at("alpha", np.float64), ~at("done", bool), terms)
                    ub = batch.column("ub")[i].as_py()
                    held[ub] = held[ub] + s if ub in held else s
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([s.tobytes() for s in held.values()], pa.binary())], names=["ub", "sums"])

        return both.mapInArrow(summed, "ub long, sums binary")

    def _stepped(self, parameters: DataFrame, terms: type, step: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple]) -> DataFrame:
        """Parameters after one round: ``step`` takes b, alpha, more and the sums of live units and gives new ones and which have settled."""
        p = self.p

        def moved(now: pa.Table, sums: pa.Table) -> pa.Table:
            r = now.to_pylist()[0]
            b, alpha, done, more = _matrix(r["b"], p), np.frombuffer(r["alpha"], np.float64).copy(), np.frombuffer(r["done"], bool).copy(), _matrix(r["more"], p)
            total = sum(np.frombuffer(s, np.float64) for s in sums.column("sums").to_pylist()).reshape(len(b), -1)
            at = ~done
            b[at], alpha[at], more[at], done[at] = step(b[at], alpha[at], more[at], total[at])
            return pa.table({"ub": [r["ub"]], "ids": [r["ids"]], "live": [int((~done).sum())], "b": [b.tobytes()], "alpha": [alpha.tobytes()], "done": [done.tobytes()], "more": [more.tobytes()]}, schema=ROUND)

        moving = parameters.filter(F.col("live") > 0)
        new = moving.groupBy("ub").cogroup(self._summed(moving, terms).groupBy("ub")).applyInArrow(moved, PARAMETERS)
        return stored(new.unionByName(parameters.filter("live = 0")), "regression-round")

    def rounds(self, parameters: DataFrame, terms: type, step: Callable) -> DataFrame:
        for _ in range(MOST_ROUNDS):
            if parameters.filter(F.col("live") > 0).isEmpty():
                break
            parameters = self._stepped(parameters, terms, step)
        return parameters

    def fitted(self, parameters: DataFrame, ridge: float = 0.0, dispersed_only: bool = False) -> DataFrame:
        """Coefficients by Newton's steps at each unit's alpha; ``more`` has their standard errors. With ``dispersed_only`` units of alpha 0 stay as they are.

        A unit that the data separate has no finite maximum: its coefficients stop where the score is
        next to nothing, far out but finite.
        """
        scale = min(self.n_cells, 1000)

        def step(b: np.ndarray, alpha: np.ndarray, more: np.ndarray, sums: np.ndarray) -> tuple:
            new, settled, se = newton_step(b, sums, scale, ridge)
            return new, alpha, se, settled

        return self.rounds(opened(parameters, dispersed_only=dispersed_only), Newton, step)

    def dispersed(self, parameters: DataFrame) -> DataFrame:
        """alpha at which squared Pearson residuals sum to their degrees of freedom; where they don't exceed these at 0, by moments.

        One over the sum is concave in alpha, so Newton's steps on it come from below and never
        pass the root.
        """
        df = max(self.n_cells - self.p, 1)

        def step(b: np.ndarray, alpha: np.ndarray, more: np.ndarray, sums: np.ndarray) -> tuple:
            f, slope, excess, squares, _ = sums.T
            none = (alpha == 0) & (f <= df)
            moments = np.maximum(excess / (squares + 1e-12), 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                new = alpha + (f - df) * f / (-slope * df)
            new = np.where(none, moments, np.maximum(new, alpha))
            settled = none | (np.abs(new - alpha) <= 1e-12 * (1 + new)) | (f - df <= 1e-10 * df)
            return b, new, more, settled

        return self.rounds(opened(parameters, alpha=0.0), Spread, step)

    def moments(self, parameters: DataFrame) -> DataFrame:
        """The fits as they are, with the mean and the sum of squares of the fitted means in the first and last column of ``more``."""
        n = self.n_cells

        def step(b: np.ndarray, alpha: np.ndarray, more: np.ndarray, sums: np.ndarray) -> tuple:
            more[:, 0], more[:, -1] = sums[:, 4] / n, sums[:, 3]
            return b, alpha, more, np.ones(len(b), bool)

        return self.rounds(opened(parameters), Spread, step)

    def table(self, parameters: DataFrame) -> DataFrame:
        """unit, b (an array), alpha, more."""
        p = self.p

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    lists = lambda c: pa.array(list(_matrix(r[c], p)), pa.list_(pa.float64()))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), lists("b"), pa.array(np.frombuffer(r["alpha"], np.float64)), lists("more")], names=["unit", "b", "alpha", "more"])

        return parameters.mapInArrow(rows, "unit long, b array<double>, alpha double, more array<double>")


SCHEMA = pa.schema([("ub", pa.int64()), ("n", pa.binary()), ("k", pa.binary()), ("y", pa.binary()), ("offset", pa.binary()), ("z", pa.binary())])
ROUND = pa.schema([("ub", pa.int64()), ("ids", pa.list_(pa.int64())), ("live", pa.int32()), ("b", pa.binary()), ("alpha", pa.binary()), ("done", pa.binary()), ("more", pa.binary())])
def opened(parameters: DataFrame, alpha: float | None = None, dispersed_only: bool = False) -> DataFrame:
    """All units live again (or those with an alpha above 0); with ``alpha`` that for each."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(c) for c in batch.schema.names}
            old = [np.frombuffer(x, np.float64) for x in cols["alpha"].to_pylist()]
            done = [(x <= 0) & dispersed_only for x in old]
            cols["live"] = pa.array([int((~d).sum()) for d in done], pa.int32())
            cols["done"] = pa.array([d.tobytes() for d in done], pa.binary())
            if alpha is not None:
                cols["alpha"] = pa.array([np.full(len(x), alpha).tobytes() for x in old], pa.binary())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return stored(parameters.mapInArrow(again, PARAMETERS), "regression-round")
