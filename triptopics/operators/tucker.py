"""Non-negative Tucker decomposition of a COO tensor (O-18, O-19, O-20, C-08).

The tensor stays a distributed COO table ``(i_0, ..., i_{N-1}, value)``; the factors A_n (mode size x
rank) and the core G are model-sized and live on the driver.  An iteration updates the modes one after
the other and then the core, each by the multiplicative (Lee-Seung style) rule with everything else
fixed, so the error never rises:

A_n <- A_n * num_n / (A_n G_(n) (⊗ A_m'A_m) G_(n)'),    G <- G * num_G / (G x_n A_n'A_n).

The numerators come from a contraction tree.  Its trunk splits the modes into the large ones (stations)
and the ``small`` ones (calendar: day, hour), whose joint cells fit the driver:

* a large mode's numerator is one pass over the non-zeros against the core already contracted with the
  small modes (a table by calendar cell, computed once for the pass);
* one more pass contracts the tensor with all large modes.  The result, calendar cells x ranks, is summed
  over the cluster and shared: all small modes, the core and the error are computed from it.

‖X − X̂‖² = ‖X‖² − 2⟨num_G, G⟩ + ⟨G, G x_n A_n'A_n⟩, so neither the dense tensor nor another pass is needed.

The start is deterministic: of each leading eigenvector of a mode's Gram matrix the heavier of its
positive and negative part, which gives components of different support, and the core they make.  The fit ends when its last five iterations lowered the relative error by no more than ``tol``
of it on average (``converged``; multiplicative updates rest on plateaus for an iteration or two), or after
``n_iter`` iterations.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .topics.estep import user_blocks

EPS = 1e-12
FLOOR = 1e-3                # of the start, relative to the mean entry: a zero entry could never grow
GATHERED = 20_000_000       # numbers of the shared contraction that may come to the driver
GRAM_SIZE = 8_192           # beyond this mode size the start is taken from index hashes
GRAM_BLOCK = 1 << 17        # numbers of a block of fibres as a matrix
PAIR_COST = 20              # a pair of cells added alone, in multiplications of a matrix product
GRAM_LOCAL = 1_024          # up to this mode size a task sums its part of the Gram matrix (8 MB)
CHUNK = 4_096
PATIENCE = 5
CELLS_A_TASK = 8            # calendar cells a task holds on average, or the non-zeros are dealt evenly instead of by cell
TASK_CELLS = 250_000        # non-zeros of one task: its sums are model-sized, so fewer tasks send less


@dataclass
class TuckerModel:
    core: np.ndarray
    factors: list[np.ndarray]
    history: list[tuple[int, float]] = field(default_factory=list)
    converged: bool = False


def _core_times(core, mats):
    """G ×_1 M_1 ... ×_N M_N (mode products with square or rectangular M)."""
    out = core
    for n, m in enumerate(mats):
        out = np.moveaxis(np.tensordot(m, out, axes=([1], [n])), 0, n)
    return out


def reconstruct(core, factors, idx) -> np.ndarray:
    """x̂ at the cells ``idx``, mode after mode."""
    out = np.empty(len(idx[0]))
    for s in range(0, len(out), CHUNK):
        z = slice(s, s + CHUNK)
        part = np.tensordot(factors[0][idx[0][z]], core, axes=([1], [0]))
        for f, i in zip(factors[1:], idx[1:], strict=True):
            part = np.einsum("za...,za->z...", part, f[i[z]])
        out[z] = part
    return out


# --- the contraction tree --------------------------------------------------------------------

class _Tree:
    """Passes over a table ``(b0, b1, ..., cell, value array<double>)``: indices of the large modes, the joint
    cell of the small modes, and the values (several where a further mode is contracted already)."""

    def __init__(self, data: DataFrame, shape: tuple[int, ...], ranks: tuple[int, ...], n_big: int, lead: int = 1):
        self.data, self.shape, self.ranks, self.n_big, self.lead = data, shape, ranks, n_big, lead
        self.cells = int(np.prod(shape[n_big:], dtype=np.int64))
        if self.cells * lead * int(np.prod(ranks[:n_big], dtype=np.int64)) > GATHERED:
            raise ValueError("the small modes have too many joint cells to be gathered: leave them to the large ones")

    def _summed(self, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], size: int) -> np.ndarray:
        """Sum of the flat arrays of all tasks; their non-zeros are added by position over the cluster first."""
        def run(batches):
            for total in fn(batches):
                k = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["k", "x"])

        return _dense(self.data.mapInArrow(run, "k long, x double"), size)

    def big_numerator(self, core: np.ndarray, factors: list[np.ndarray], n: int) -> np.ndarray:
        """X_(n) (⊗_{m≠n} A_m) G_(n)' of a large mode; ``core`` has the contracted mode first."""
        big, table = self.n_big, self._by_cell(core, factors)
        large, size = factors[:big], factors[n].shape

        def fn(batches):
            total = np.zeros(size)
            for idx, cell, value in _chunks(batches, big):
                _add_rows(total, idx[n], big_rows(table, large, n, idx, cell, value))
            yield total.ravel()

        return self._summed(fn, size[0] * size[1]).reshape(size)

    def _by_cell(self, core: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
        """The core contracted with the small modes, for every joint cell: (cells, lead, large ranks)."""
        out = core
        n_small = len(factors) - self.n_big
        for k in range(n_small):                    # the first remaining small rank axis becomes a cell axis at the end
            out = np.tensordot(out, factors[self.n_big + k], axes=([1 + self.n_big], [1]))
        return np.moveaxis(out, list(range(1 + self.n_big, 1 + self.n_big + n_small)), list(range(n_small))).reshape(self.cells, *core.shape[:1 + self.n_big])

    def shared(self, factors: list[np.ndarray]) -> np.ndarray:
        """The tensor contracted with all large modes: (small sizes..., lead, large ranks...)."""
        big, inner = self.n_big, (self.lead, *self.ranks[:self.n_big])
        large, cells = factors[:big], self.cells

        def fn(batches):
            total = np.zeros((cells, int(np.prod(inner))))
            for idx, cell, value in _chunks(batches, big):
                if big == 2 and _in_few_cells(cell, len(large[0])):
                    here, at = np.unique(cell, return_inverse=True)
                    part = np.zeros((len(here) * len(large[0]), value.shape[1] * large[1].shape[1]))
                    _add_rows(part, at * len(large[0]) + idx[0], (value[:, :, None] * large[1][idx[1]][:, None, :]).reshape(len(value), -1))
                    part = part.reshape(len(here), len(large[0]), value.shape[1], -1)
                    total[here] += np.moveaxis(np.tensordot(part, large[0], axes=([1], [0])), 3, 2).reshape(len(here), -1)
                    continue
                part = value
                for f, i in zip(large, idx, strict=True):
                    part = (part[:, :, None] * f[i][:, None, :]).reshape(len(part), -1)
                order = np.argsort(cell, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(cell[order]) > 0))
                total[cell[order][first]] += np.add.reduceat(part[order], first, axis=0)
            yield total.ravel()

        return self._summed(fn, cells * int(np.prod(inner))).reshape(*self.shape[big:], *inner)


def _dense(parts: DataFrame, size: int) -> np.ndarray:
    """The sums of ``parts`` (position k, x) as one array of model size."""
    out = np.zeros(size)
    found = parts.groupBy("k").agg(F.sum("x").alias("x")).toPandas()
    out[found["k"].to_numpy(np.int64)] = found["x"].to_numpy()
    return out


def big_rows(table, large, n, idx, cell, value):
    """Per non-zero, the value times the core contracted with everything but mode ``n``."""
    if len(large) == 2 and _in_few_cells(cell, len(large[1 - n])):
        here, at = np.unique(cell, return_inverse=True)
        rest = np.moveaxis(np.tensordot(table[here], large[1 - n], axes=([3 - n], [1])), 3, 1)     # (cells here, items of the other mode, lead, rank)
        return np.einsum("zl,zla->za", value, rest[at, idx[1 - n]])
    part = np.einsum("zl,zl...->z...", value, table[cell])
    for m in reversed(range(len(large))):
        if m != n:
            part = np.moveaxis(part, 1 + m, 1)
            part = np.einsum("za...,za->z...", part, large[m][idx[m]])
    return part


def _in_few_cells(cell: np.ndarray, size: int) -> bool:
    """Whether a table of ``size`` rows for each calendar cell of a chunk is less work than one for each non-zero."""
    return len(cell) > size * np.count_nonzero(np.diff(cell, prepend=-1))


def _add_rows(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """total[at] += rows, in place, rows of one place added up."""
    width = total.shape[1]
    np.add.at(total.reshape(-1), (at[:, None] * width + np.arange(width)).ravel(), rows.ravel())


def _chunks(batches, n_big):
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        idx = [batch.column(f"b{k}").to_numpy() for k in range(n_big)]
        cell = batch.column("cell").to_numpy()
        value = batch.column("value").flatten().to_numpy().reshape(n, -1)
        for s in range(0, n, CHUNK):
            yield [i[s:s + CHUNK] for i in idx], cell[s:s + CHUNK], value[s:s + CHUNK]


def _updated(a: np.ndarray, num: np.ndarray, core: np.ndarray, grams: list[np.ndarray], axis: int) -> np.ndarray:
    """Multiplicative update of the factor on ``axis`` of the core."""
    mats = [g if m != axis else np.eye(len(g)) for m, g in enumerate(grams)]
    rest = np.moveaxis(_core_times(core, mats), axis, 0).reshape(core.shape[axis], -1)
    flat = np.moveaxis(core, axis, 0).reshape(core.shape[axis], -1)
    return a * num / np.maximum(a @ (flat @ rest.T), EPS)


def _sweep(tree: _Tree, core: np.ndarray, factors: list[np.ndarray], gram_lead: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], float, float]:
    """One update of every mode and the core; also ⟨num_G, G⟩ and ‖X̂‖² of the result.

    ``core``: (lead, ranks); ``gram_lead``: Gram matrix of the mode contracted already."""
    big, factors = tree.n_big, list(factors)
    grams = [gram_lead, *(f.T @ f for f in factors)]
    for n in range(big):
        factors[n] = _updated(factors[n], tree.big_numerator(core, factors, n), core, grams, 1 + n)
        grams[1 + n] = factors[n].T @ factors[n]
    shared = tree.shared(factors)
    n_small = len(factors) - big
    cell, rank, inner = string.ascii_lowercase[:n_small], string.ascii_uppercase[:n_small], string.ascii_lowercase[10:11 + big]
    for s in range(n_small):
        others = [k for k in range(n_small) if k != s]
        spec = ",".join([cell + inner, inner + rank, *(cell[k] + rank[k] for k in others)]) + f"->{cell[s]}{rank[s]}"
        num = np.einsum(spec, shared, core, *(factors[big + k] for k in others), optimize=True)
        factors[big + s] = _updated(factors[big + s], num, core, grams, 1 + big + s)
        grams[1 + big + s] = factors[big + s].T @ factors[big + s]
    spec = ",".join([cell + inner, *(cell[k] + rank[k] for k in range(n_small))]) + f"->{inner}{rank}"
    num = np.einsum(spec, shared, *factors[big:], optimize=True)
    core = core * num / np.maximum(_core_times(core, grams), EPS)
    return core, factors, float((num * core).sum()), float((core * _core_times(core, grams)).sum())


def _error(xx: float, inner: float, norm2: float) -> float:
    return float(np.sqrt(max(xx - 2.0 * inner + norm2, 0.0) / xx)) if xx > 0 else 0.0


def _settled(history: list[tuple[int, float]], tol: float) -> bool:
    """Whether the last ``PATIENCE`` iterations lowered the error by no more than ``tol`` of it on average."""
    return len(history) > PATIENCE and history[-1 - PATIENCE][1] - history[-1][1] <= PATIENCE * tol * history[-1][1]


# --- the start -------------------------------------------------------------------------------

def _gram(data: DataFrame, mode: str, others: list[str], size: int, other_sizes: list[int], tasks: int) -> np.ndarray:
    """X_(n) X_(n)' of one mode: products of cells of one fibre (of at most ``size`` cells), summed by pair.

    The fibres are dealt over the cluster; a task multiplies blocks of whole fibres as matrices, so no pair of
    cells is a row.  Where a matrix of the mode's size is too much for a task, the pairs are joined."""
    if size <= GRAM_LOCAL and np.prod(other_sizes, dtype=float) < 2.0 ** 62:
        fibre = F.lit(0).cast("long")
        for c, n in zip(others, other_sizes, strict=True):
            fibre = fibre * n + F.col(c).cast("long")
        cells = data.select(fibre.alias("fibre"), F.col(mode).cast("long").alias("i"), "x").repartition(tasks, "fibre").sortWithinPartitions("fibre")
        return _dense(cells.mapInPandas(_fibre_products(size), "k long, x double"), size * size).reshape(size, size)
    left = data.select(*[F.col(c).alias(c) for c in others], F.col(mode).alias("i"), "x")
    right = data.select(*[F.col(c).alias(c) for c in others], F.col(mode).alias("j"), F.col("x").alias("y"))
    pairs = left.join(right, others) if others else left.join(right, left["i"] == right["j"])
    return _dense(pairs.select((F.col("i").cast("long") * size + F.col("j")).alias("k"), (F.col("x") * F.col("y")).alias("x")), size * size).reshape(size, size)


def _fibre_products(size: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Task of ``_gram``: cells (fibre, i, x) sorted by fibre to the sums of the products x_i x_j within fibres."""
    step = max(1, GRAM_BLOCK // size)

    def run(batches):
        total = np.zeros((size, size))
        for block in user_blocks(batches, CHUNK, "fibre"):
            fibre, i, x = block["fibre"].to_numpy(), block["i"].to_numpy(), block["x"].to_numpy()
            first = np.append(np.flatnonzero(np.append(True, fibre[1:] != fibre[:-1])), len(fibre))
            for s in range(0, len(first) - 1, step):
                ends = first[s:s + step + 1]
                at, value, length = i[ends[0]:ends[-1]], x[ends[0]:ends[-1]], np.diff(ends)
                if PAIR_COST * (length ** 2).sum() < size ** 2 * len(length):       # nearly empty: the pairs themselves
                    n = np.repeat(length, length)
                    left = np.repeat(np.arange(len(at)), n)
                    right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.repeat(ends[:-1] - ends[0], length), n)
                    np.add.at(total.ravel(), at[left] * size + at[right], value[left] * value[right])
                else:
                    part = np.zeros((size, len(length)))
                    np.add.at(part, (at, np.repeat(np.arange(len(length)), length)), value)
                    total += part @ part.T
        k = np.flatnonzero(total)
        yield pd.DataFrame({"k": k, "x": total.ravel()[k]})

    return run


def _hash_rows(size: int, rank: int) -> np.ndarray:
    i, r = np.indices((size, rank))
    return ((i * 48271 + r * 69621) % 2147483647 % 1000) / 1000.0 + 0.1


def gram_start(data: DataFrame, cols: list[str], shape: tuple[int, ...], ranks: tuple[int, ...]) -> list[np.ndarray]:
    """The heavier signed parts of the leading eigenvectors of every mode's Gram matrix (``data``: cols, x), kept off zero."""
    out = []
    tasks = max(1, -(-data.count() // TASK_CELLS))
    for n, (size, rank) in enumerate(zip(shape, ranks, strict=True)):
        if size > GRAM_SIZE:
            out.append(_hash_rows(size, rank))
            continue
        _, vectors = np.linalg.eigh(_gram(data, cols[n], [c for k, c in enumerate(cols) if k != n], size,
                                          [m for k, m in enumerate(shape) if k != n], tasks))
        v = vectors[:, ::-1][:, :rank]
        v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)     # eigenvectors have no sign of their own
        up, down = np.maximum(v, 0), np.maximum(-v, 0)
        a = np.where((up ** 2).sum(axis=0) >= (down ** 2).sum(axis=0) - 1e-9, up, down)
        if a.shape[1] < rank:
            a = np.hstack([a, _hash_rows(size, rank - a.shape[1]) / size])
        out.append(a + FLOOR * max(a.mean(), EPS))
    return out


def _small_modes(shape: tuple[int, ...], ranks: tuple[int, ...]) -> tuple[int, ...]:
    """The smallest modes whose joint cells, times the other modes' ranks, can be gathered."""
    small: list[int] = []
    for m in sorted(range(len(shape)), key=lambda k: (shape[k], -k)):
        trial = [*small, m]
        cells = np.prod([shape[k] for k in trial], dtype=float) * np.prod([r for k, r in enumerate(ranks) if k not in trial], dtype=float)
        if len(trial) < len(shape) and len(trial) <= len(shape) // 2 and cells <= GATHERED / 4:
            small = trial
    return tuple(sorted(small))


def _leaves(cols: list[str], shape: tuple[int, ...], big: list[int], small: list[int]) -> list[Column]:
    cell = F.lit(0).cast("long")
    for m in small:
        cell = cell * shape[m] + F.col(cols[m]).cast("long")
    return [*(F.col(cols[m]).cast("long").alias(f"b{k}") for k, m in enumerate(big)), cell.alias("cell")]


def non_negative_tucker(coo: DataFrame, cols: list[str], shape: tuple[int, ...], ranks: tuple[int, ...], n_iter: int = 1000,
                        tol: float = 1e-6, small: tuple[int, ...] | None = None,
                        start: tuple[np.ndarray, list[np.ndarray]] | None = None) -> TuckerModel:
    """O-18: factor a non-negative COO tensor whose index columns ``cols`` are 0-based and below ``shape``.

    ``small`` names the modes gathered on the driver (default: the smallest half, as far as they fit);
    ``start`` is a core and factors to begin with instead of the Gram start.  A tensor without non-zeros
    keeps its start and has error 0."""
    ensure_checkpoint_dir(coo.sparkSession)
    small = list(_small_modes(shape, ranks) if small is None else small)
    big = [m for m in range(len(shape)) if m not in small]
    order = big + small
    back = [order.index(m) for m in range(len(shape))]
    flat = coo.select(*cols, F.col("value").cast("double").alias("x")).where("x <> 0").checkpoint()
    xx, cells = flat.agg(F.sum(F.col("x") * F.col("x")), F.count(F.lit(1))).first()
    xx = xx or 0.0
    tasks = max(1, -(-cells // TASK_CELLS))
    by_cell = ["cell"] if np.prod([shape[m] for m in small], dtype=float) >= CELLS_A_TASK * tasks else []
    data = (flat.select(*_leaves(cols, shape, big, small), F.array("x").alias("value"))
            .repartition(tasks, *by_cell).sortWithinPartitions("cell").persist(StorageLevel.MEMORY_AND_DISK))
    tree = _Tree(data, tuple(shape[m] for m in order), tuple(ranks[m] for m in order), len(big))
    if start is None:
        begin = gram_start(flat, cols, shape, ranks)
        factors = [begin[m] for m in order]
        shared = tree.shared(factors)
        n_small = len(small)
        cell, rank, inner = string.ascii_lowercase[:n_small], string.ascii_uppercase[:n_small], string.ascii_lowercase[10:11 + len(big)]
        core = np.einsum(",".join([cell + inner, *(cell[k] + rank[k] for k in range(n_small))]) + f"->{inner}{rank}", shared, *factors[len(big):], optimize=True)
        core = core + FLOOR * max(core.mean(), EPS)
    else:
        core, factors = start[0].transpose(order)[None], [start[1][m] for m in order]
    model = TuckerModel(core[0].transpose(back), [factors[k] for k in back])
    for it in range(n_iter):
        core, factors, inner_product, norm2 = _sweep(tree, core, factors, np.eye(1))
        model.history.append((it, _error(xx, inner_product, norm2)))
        model.converged = _settled(model.history, tol)
        if model.converged:
            break
    model.core, model.factors = core[0].transpose(back), [factors[k] for k in back]
    data.unpersist()
    return model


def factor_topics(model: TuckerModel, mode: int, keys: np.ndarray) -> pd.DataFrame:
    """O-20: factor transposed (components × items), rows L1-normalised, keyed back."""
    f = model.factors[mode].T
    s = f.sum(axis=1, keepdims=True)
    f = np.where(s > 0, f / np.where(s > 0, s, 1.0), f)
    c, i = np.indices(f.shape)
    return pd.DataFrame({"mode": mode, "component": c.ravel().astype(np.int32),
                         "value": keys[i.ravel()].astype(np.int64), "weight": f.ravel()})


def residuals(coo: DataFrame, cols: list[str], model: TuckerModel) -> DataFrame:
    """x, x̂ and x − x̂ on the non-zero cells (C-08 input)."""
    core, factors = model.core, model.factors

    def fn(batches):
        for pdf in batches:
            idx = [pdf[c].to_numpy(np.int64) for c in cols]
            xhat = reconstruct(core, factors, idx)
            out = pdf.copy()
            out["x_hat"] = xhat
            out["residual"] = pdf["value"].to_numpy(np.float64) - xhat
            yield out

    schema = ", ".join([f"{c} long" for c in cols] + ["value double", "x_hat double", "residual double"])
    return coo.select(*[F.col(c).cast("long") for c in cols], F.col("value").cast("double")).mapInPandas(fn, schema)


def outliers(res: DataFrame, z: float = 3.0) -> DataFrame:
    """C-08 (re-aimed robust PCA): cells whose |residual| exceeds mean + z·std."""
    m, s = res.agg(F.avg(F.abs("residual")), F.stddev_pop(F.abs("residual"))).first()
    return res.filter(F.abs("residual") > F.lit(float(m or 0.0) + z * float(s or 0.0)))


# ---- tensors with a distributed leading mode (e.g. user × O × D × T) ----------------

USER_TABLE = 4_000_000      # numbers of a table of cells that a task may hold
USER_IN = ["user_id", "u", "b0", "b1", "cell", "x"]
USER_OUT = "kind int, user_id long, u array<double>, b0 long, b1 long, cell long, value array<double>"


def _init_users(users: DataFrame, rank: int) -> DataFrame:
    """Deterministic non-negative start rows: a function of the user id only."""
    vals = [(F.pmod(F.xxhash64(F.col("user_id"), F.lit(k)), F.lit(1000)) / 1000.0 + 0.1) for k in range(rank)]
    return users.select("user_id", F.array(*vals).alias("u"))


def non_negative_tucker_users(coo: DataFrame, cols: list[str], shape: tuple[int, ...], ranks: tuple[int, ...],
                              n_iter: int = 3000, tol: float = 1e-5) -> tuple[DataFrame, TuckerModel]:
    """O-18 for a tensor ``coo(user_id, two station modes, one calendar mode, value)`` whose first mode grows with the data.

    ``shape`` and ``ranks`` cover the user mode first (its size is unused).  The user factor is a table
    hash-partitioned like the tensor, so the join that brings them together moves nothing.  One pass an
    iteration updates whole users and, in the same task, contracts the tensor with the new rows: what is
    left has no user mode, is grouped by cell once, and feeds the same contraction tree as
    ``non_negative_tucker``.  Users and contraction are checkpointed every iteration.  Returns (users
    table, model with the other factors, the core and the error history).
    """
    spark = coo.sparkSession
    ensure_checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest_shape, rest_ranks, r0 = tuple(shape[1:]), tuple(ranks[1:]), ranks[0]
    flat = coo.select("user_id", *cols, F.col("value").cast("double").alias("x")).where("x <> 0").checkpoint()
    leaves = flat.select("user_id", *_leaves(cols, rest_shape, [0, 1], [2]), "x").repartition(n, "user_id")
    # one row a user: at most a value for each cell of the network and the calendar
    data = (leaves.groupBy("user_id").agg(F.collect_list(F.struct("b0", "b1", "cell", "x")).alias("z"))
            .select("user_id", *[F.col("z")[c].alias(c) for c in ("b0", "b1", "cell", "x")]).persist(StorageLevel.MEMORY_AND_DISK))
    users = _init_users(data.select("user_id"), r0).repartition(n, "user_id").checkpoint()
    total = flat.groupBy(*cols).agg(F.sum("x").alias("x")).checkpoint()
    factors = gram_start(total, cols, rest_shape, rest_ranks)
    xx = flat.agg(F.sum(F.col("x") * F.col("x"))).first()[0] or 0.0
    core = np.full(ranks, 1.0)
    model = TuckerModel(core, [None, *factors])
    gram = _user_gram(users, r0)

    for it in range(n_iter):
        grams = [gram, *(f.T @ f for f in factors)]
        flat_core = core.reshape(r0, -1)
        # X̂ summed against itself over the user mode: one r0 x r0 matrix
        bottom = flat_core @ _core_times(core, [np.eye(r0), *grams[1:]]).reshape(r0, -1).T
        table = _Tree(data, rest_shape, rest_ranks, 2, r0)._by_cell(core, factors)
        step = _user_step(table, factors[:2], bottom, r0)
        out = data.join(users, "user_id").select(*USER_IN).mapInArrow(step, USER_OUT).checkpoint()
        users = out.where("kind = 0").select("user_id", "u").repartition(n, "user_id").checkpoint()
        left = out.where("kind = 1").groupBy("b0", "b1", "cell").agg(
            F.array(*[F.sum(F.col("value")[k]) for k in range(r0)]).alias("value")).persist(StorageLevel.MEMORY_AND_DISK)
        gram = _user_gram(users, r0)
        core, factors, inner_product, norm2 = _sweep(_Tree(left, rest_shape, rest_ranks, 2, r0), core, factors, gram)
        left.unpersist()
        model.history.append((it, _error(xx, inner_product, norm2)))
        model.converged = _settled(model.history, tol)
        if model.converged:
            break
    model.core, model.factors = core, [None, *factors]
    data.unpersist()
    return users, model


def _user_cells(table: np.ndarray, large: list[np.ndarray]) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """(b0, b1, cell) of non-zeros to the core contracted with both large modes and the cell: (non-zeros, user rank).

    As far as a table of all cells, or of the second mode's items by calendar cell, is small, it is made once."""
    cells, r0, rank, _ = table.shape
    if cells * len(large[1]) * r0 * rank > USER_TABLE:
        return lambda i, j, c: np.einsum("zla,za->zl", np.einsum("zlab,zb->zla", table[c], large[1][j]), large[0][i])
    second = np.ascontiguousarray(np.moveaxis(np.tensordot(table, large[1], axes=([3], [1])), 3, 1))       # (cells, items, user rank, rank)
    if cells * len(large[0]) * len(large[1]) * r0 > USER_TABLE:
        return lambda i, j, c: np.einsum("zla,za->zl", second[c, j], large[0][i])
    both = np.ascontiguousarray(np.moveaxis(np.tensordot(second, large[0], axes=([3], [1])), 3, 1))        # (cells, items, items, user rank)
    return lambda i, j, c: both[c, i, j]


def _lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as one list each."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def _user_rows(kind: int, user: np.ndarray, u: pa.Array, b0: np.ndarray, b1: np.ndarray, cell: np.ndarray, value: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(user), kind, np.int32)), pa.array(user), u, *map(pa.array, (b0, b1, cell)), value],
                                      names=[c.split()[0] for c in USER_OUT.split(", ")])


def _user_step(table, large, bottom, r0):
    """Task of one user pass: new rows of whole users (kind 0) and the task's sums of the tensor times them (kind 1),
    added up over the task where all cells fit a table, else over a batch."""
    shape = len(large[0]), len(large[1]), len(table)
    whole = int(np.prod(shape, dtype=np.int64)) * r0 <= USER_TABLE

    def sums(key, rows):
        b0, b1, cell = np.unravel_index(key, shape)
        none = np.zeros(len(key), np.int64)
        return _user_rows(1, none - 1, pa.nulls(len(key), pa.list_(pa.float64())), b0, b1, cell, _lists(rows))

    def step(batches):
        contracted = _user_cells(table, large)
        total = np.zeros((int(np.prod(shape)), r0)) if whole else None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, u = batch.column("user_id").to_numpy(), batch.column("u").flatten().to_numpy().reshape(-1, r0)
            b0, b1, cell, x = (batch.column(c).flatten().to_numpy() for c in ("b0", "b1", "cell", "x"))
            owner = np.repeat(np.arange(len(ids)), batch.column("x").value_lengths().to_numpy())
            num = np.zeros((len(ids), r0))
            for s in range(0, len(x), CHUNK):
                z = slice(s, s + CHUNK)
                _add_rows(num, owner[z], contracted(b0[z], b1[z], cell[z]) * x[z, None])
            new = u * num / np.maximum(u @ bottom, EPS)
            none = np.zeros(len(ids), np.int64)
            yield _user_rows(0, ids, _lists(new), none, none, none, pa.nulls(len(ids), pa.list_(pa.float64())))
            key = np.ravel_multi_index((b0, b1, cell), shape)
            if whole:
                place, own = total, key
            else:
                found, own = np.unique(key, return_inverse=True)
                place = np.zeros((len(found), r0))
            for s in range(0, len(x), CHUNK):
                z = slice(s, s + CHUNK)
                _add_rows(place, own[z], x[z, None] * new[owner[z]])
            if not whole:
                yield sums(found, place)
        if whole:
            key = np.flatnonzero(total.any(axis=1))
            for s in range(0, len(key), CHUNK):
                yield sums(key[s:s + CHUNK], total[key[s:s + CHUNK]])

    return step


def _user_gram(users: DataFrame, r0: int) -> np.ndarray:
    """U'U: one r0 x r0 matrix a task, added up by the cluster."""
    def run(batches):
        g = np.zeros((r0, r0))
        for pdf in batches:
            if len(pdf):
                u = np.stack(pdf["u"].to_numpy())
                g += u.T @ u
        yield pd.DataFrame({"k": np.arange(g.size), "x": g.ravel()})

    return _dense(users.select("u").mapInPandas(run, "k long, x double"), r0 * r0).reshape(r0, r0)
