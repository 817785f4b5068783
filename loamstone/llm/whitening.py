"""PCA whitening of embeddings from upper-triangle column aggregates.

Entries become whole numbers x = floor(scale * c), and each distinct vector counts once. Over that fit list
 1. one aggregation gives n, the sums S of the dimensions and their extremes, exactly;
 2. generated SQL, sum(c_i * c_j) for every pair i <= j of dimensions with c = (n * x - S) / n, gives the upper
    triangle of the covariance in one aggregation (in several of `PAIRS` pairs, beyond 128 dimensions); only sums leave the executors;
 3. the triangle is mirrored and decomposed by LAPACK on the driver, whose work depends on the number of dimensions alone;
 4. an aggregation of the whitened columns' products measures how far their covariance is from the identity.
n * x - S is exact: in longs where the extremes show that squares and their sum fit, otherwise in decimals of 38 digits.

Defined results:
 - null vectors, and those with a null or non-finite entry: left out; so are vectors shorter than the
   longest, as their last entries are missing, and empty ones;
 - entries beyond the range of long after scaling: the nearest long; a deviation of over 38 digits: null;
 - null or repeated ids and repeated vectors: each row gets its results, a vector counts once in the fit;
 - a component without variance (equal vectors, fewer vectors than dimensions): whitened is null and it is not
   in identity_error, which is null where none is left; explained is then 0;
 - an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.llm.common import discard, materialise

#: Pairs of dimensions in one aggregation.
PAIRS = 128 * 129 // 2
#: Below this share of the largest eigenvalue, for each dimension, a component is rounding error.
NOISE = 2.0**-50


@dataclass(frozen=True)
class Whitening:
    """What fit() learns; components are rows, by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    #: Whether every sum of squares of n * x - S is known to fit into a long.
    narrow: bool
    values: np.ndarray
    components: np.ndarray

    def scales(self) -> list[float | None]:
        """The square root of each eigenvalue, None where there is no variance."""
        least = len(self.values) * NOISE * max(self.values, default=0.0)
        return [float(np.sqrt(e)) if e > least else None for e in self.values.tolist()]

    def explained(self) -> list[float]:
        total = float(self.values.sum())
        return [e / total if total > 0 else 0.0 for e in np.maximum(self.values, 0.0).tolist()]


def whole_numbers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, x: the rows without missing entries, as arrays of longs."""
    broken = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    kept = vectors.select("vec_id", "embedding").where(~broken & (F.size("embedding") > 0))
    return kept.select("vec_id", F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("x"))


def balanced(terms: list[str], add: str = "({} + {})") -> str:
    """SQL for a sum as a balanced tree, shallow for many terms and with little rounding error."""
    while len(terms) > 1:
        terms = [add.format(*terms[i : i + 2]) if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def _offsets(rows: DataFrame, model: Whitening, *keep: str) -> DataFrame:
    """rows (x, ...) of the model's dimension -> the columns of keep and y0, y1, ...: the exact values of n * x - S."""
    if model.narrow:
        y = [f"{model.n}L * x[{i}] - {s}L AS y{i}" for i, s in enumerate(model.sums)]
    else:
        y = [f"CAST({model.n} AS DECIMAL(17, 0)) * CAST(x[{i}] AS DECIMAL(19, 0)) - CAST('{s}' AS DECIMAL(36, 0)) AS y{i}" for i, s in enumerate(model.sums)]
    return rows.where(F.size("x") == len(model.sums)).selectExpr(*keep, *y)


def _centred(i: int, n: int) -> str:
    return f"(CAST(y{i} AS DOUBLE) / {n}D)"


def fit_list(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """x: each distinct vector once, written to the shared folder."""
    return materialise(whole_numbers(vectors, scale).select("x").distinct(), "fit")


def fit(distinct: DataFrame) -> Whitening | None:
    """The model of a fit list; None if that is empty."""
    dims = distinct.agg(F.max(F.size("x"))).first()[0]
    if dims is None:
        return None
    rows = distinct.where(F.size("x") == dims)
    exact = [f"{f}({x}) AS {f}{i}" for i in range(dims) for f, x in (("sum", f"CAST(x[{i}] AS DECIMAL(19, 0))"), ("min", f"x[{i}]"), ("max", f"x[{i}]"))]
    found = rows.selectExpr("count(*) AS n", *exact).first()
    n, sums = found["n"], tuple(int(found[f"sum{i}"]) for i in range(dims))
    widest = [max(abs(n * int(found[f"{f}{i}"]) - sums[i]) for f in ("min", "max")) for i in range(dims)]
    held = max(n * max(abs(int(found[f"{f}{i}"])) for f in ("min", "max")) for i in range(dims)) < 2**63
    model = Whitening(n, sums, held and sum(w * w for w in widest) < 2**63, np.zeros(dims), np.eye(dims))
    centred = _offsets(rows, model).selectExpr(*(f"{_centred(i, n)} AS c{i}" for i in range(dims)))
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    cov = np.zeros((dims, dims))
    for a in range(0, len(pairs), PAIRS):
        block = pairs[a : a + PAIRS]
        sums_of = centred.selectExpr(*(f"sum(c{i} * c{j}) AS s{i}_{j}" for i, j in block)).first()
        for (i, j), s in zip(block, sums_of, strict=True):
            cov[i, j] = cov[j, i] = s / n
    values, vectors = np.linalg.eigh(cov)
    return Whitening(n, sums, model.narrow, values[::-1].copy(), vectors.T[::-1].copy())


def _whitened(model: Whitening, components: int) -> list[str]:
    """SQL over _offsets(), for each component."""
    out = []
    for v, scale in zip(model.components[:components], model.scales(), strict=False):
        terms = [f"{_centred(i, model.n)} * {float(w)!r}D" for i, w in enumerate(v)]
        out.append("CAST(NULL AS DOUBLE)" if scale is None else f"{balanced(terms)} / {scale!r}D")
    return out


def whiten(vectors: DataFrame, model: Whitening, *, components: int = 4, scale: int = 256) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, component (from 1), deviation, whitened, explained."""
    dims = len(model.sums)
    square, add, kind = ("y{0} * y{0}", "({} + {})", "BIGINT") if model.narrow else ("try_multiply(y{0}, y{0})", "try_add({}, {})", "DECIMAL(38, 0)")
    deviation = balanced([square.format(i) for i in range(dims)], add)
    structs = [
        f"named_struct('component', {k + 1}, 'whitened', {w}, 'explained', {e!r}D)"
        for k, (w, e) in enumerate(zip(_whitened(model, components), model.explained(), strict=False))
    ]
    rows = _offsets(whole_numbers(vectors, scale), model, "vec_id")
    rows = rows.selectExpr("vec_id", f"CAST({deviation} AS {kind}) AS deviation", f"explode(array({', '.join(structs)})) AS c")
    return rows.select("vec_id", "c.component", "deviation", "c.whitened", "c.explained")


def identity_error(distinct: DataFrame, model: Whitening, components: int = 4) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, measured over the rows."""
    names = [k for k, s in enumerate(model.scales()[:components]) if s is not None]
    if not names:
        return None
    columns = _whitened(model, components)
    rows = _offsets(distinct, model).selectExpr(*(f"{columns[k]} AS w{k}" for k in names))
    pairs = [(i, j) for i in names for j in names if i <= j]
    means = rows.selectExpr(*(f"avg(w{k}) AS m{k}" for k in names)).first()
    centred = rows.selectExpr(*(f"w{k} - {float(m)!r}D AS w{k}" for k, m in zip(names, means, strict=True)))
    found = centred.selectExpr(*(f"avg(w{i} * w{j}) AS s{i}_{j}" for i, j in pairs)).first()
    return max(abs(s - (i == j)) for (i, j), s in zip(pairs, found, strict=True))


def whitened(vectors: DataFrame, *, components: int = 4, scale: int = 256) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> vec_id, component, n, deviation, whitened, explained, identity_error."""
    distinct = fit_list(vectors, scale)
    model = fit(distinct)
    if model is None:
        found = whole_numbers(vectors, scale).where("false").selectExpr("vec_id", "1 AS component", "0L AS deviation", "0D AS whitened", "0D AS explained")
        n, error = 0, None
    else:
        found, n, error = whiten(vectors, model, components=components, scale=scale), model.n, identity_error(distinct, model, components)
    discard(distinct)
    return found.selectExpr(
        "vec_id", "component", f"CAST({n} AS BIGINT) AS n", "deviation", "whitened", "explained",
        f"CAST({'NULL' if error is None else repr(error)} AS DOUBLE) AS identity_error",
    )
