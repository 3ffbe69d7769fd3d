"""Linear and logistic regression with cluster-robust errors. All sums over rows are distributed; the driver
only sees matrices of the size of the design (columns x columns)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


@dataclass(frozen=True)
class Fit:
    names: list[str]
    beta: np.ndarray
    se: np.ndarray
    n: int
    groups: int

    @property
    def z(self) -> np.ndarray:
        return np.divide(self.beta, self.se, out=np.zeros_like(self.beta), where=(self.se > 0) & np.isfinite(self.se))

    @property
    def p(self) -> np.ndarray:
        return np.array([two_sided(z) for z in self.z])

    def rows(self) -> list[tuple]:
        return [(n, float(b), float(s), float(z), float(p), self.n, self.groups) for n, b, s, z, p in zip(self.names, self.beta, self.se, self.z, self.p, strict=True)]


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def design(df: DataFrame, features: Sequence[str], dummies: Sequence[str] = (), centred: Sequence[str] = (), most_levels: int = 200) -> tuple[DataFrame, list[str]]:
    """df with the design's columns x0.. and their names: a constant, features, centred ones, and for each dummy its
    levels but the first. Columns that don't vary are left out. A dummy of more than most_levels is an error."""
    cols: list[tuple[str, Column]] = [("const", F.lit(1.0))]
    cols += [(f, F.col(f).cast("double")) for f in features]
    if centred:
        means = df.agg(*[F.avg(c).alias(c) for c in centred]).first()
        cols += [(c, F.col(c) - F.lit(float(means[c] or 0.0))) for c in centred]
    for d in dummies:
        levels = [r[0] for r in df.select(d).where(F.col(d).isNotNull()).distinct().orderBy(d).limit(most_levels + 1).collect()]
        if len(levels) > most_levels:
            raise ValueError(f"{d} has more than {most_levels} levels")
        cols += [(f"{d}_{v}", (F.col(d) == F.lit(v)).cast("double")) for v in levels[1:]]
    sd = df.agg(*[F.stddev_pop(c).alias(str(i)) for i, (_, c) in enumerate(cols)]).first()
    kept = [(n, c) for i, (n, c) in enumerate(cols) if i == 0 or (sd[i] or 0.0) > 1e-12]
    return df.select("*", *[c.alias(f"x{i}") for i, (_, c) in enumerate(kept)]), [n for n, _ in kept]


def _matrix(row, k: int, at: int = 0) -> np.ndarray:
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = row[at] or 0.0
            at += 1
    return out


def _correction(n: int, k: int, g: int) -> float:
    return g / (g - 1) * (n - 1) / (n - k) if g > 1 and n > k else float("nan")


def _degenerate(names: list[str], n: int, g: int) -> Fit:
    return Fit(names, np.zeros(len(names)), np.full(len(names), np.inf), n, g)


def ols(df: DataFrame, names: list[str], y: str, cluster: str) -> Fit:
    """Least squares over a design(); errors robust to correlation within clusters (CR1)."""
    return _alone(df, names, Model(y, "ols"), cluster)


def logit(df: DataFrame, names: list[str], y: str, cluster: str, most: int = 100, tolerance: float = 1e-10, ridge: float = 1e-8) -> Fit:
    """Logistic regression over a design() by reweighted least squares: one distributed pass a step."""
    return _alone(df, names, Model(y, "logit"), cluster, most, tolerance, ridge)


def _alone(df: DataFrame, names: list[str], model: Model, cluster: str, *settings) -> Fit:
    """One model of all rows; columns that don't vary have been left out by design()."""
    rows = df.withColumn("_all", F.lit("all"))
    fit = fit_groups(rows, "_all", [f"x{i}" for i in range(1, len(names))], [model], cluster, *settings)["all", model.outcome]
    return replace(fit, names=[names[int(n[1:])] if n != "const" else n for n in fit.names])


# --- many models of one frame ------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """An outcome and how it is modelled: "ols" or "logit"."""

    outcome: str
    kind: str


def fit_groups(df: DataFrame, by: str, names: Sequence[str], models: Sequence[Model], cluster: str, most: int = 100, tolerance: float = 1e-10, ridge: float = 1e-8) -> dict[tuple[str, str], Fit]:
    """The models of every value of `by`, all fitted together: each pass over df is one aggregate for all groups and outcomes.

    df: by, cluster, the columns `names` (without the constant, which is added) and the outcomes. A column that doesn't
    vary in a group, and an outcome as its own feature, is left out of that model; groups are as few as the driver
    holds matrices for. (group, outcome) -> Fit; a Fit that isn't defined has infinite errors.
    """
    rows = df.where(F.col(by).isNotNull()).select(by, F.col(cluster).alias("_cluster"), F.array(F.lit(1.0), *[F.col(n).cast("double") for n in names]).alias("_x"), *[F.col(m.outcome).cast("double").alias(f"_y{j}") for j, m in enumerate(models)])
    k, columns = len(names) + 1, ["const", *names]
    first = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct("_cluster").alias("g"), *[F.stddev_pop(F.col("_x")[i]).alias(f"s{i}") for i in range(1, k)], *[F.stddev_pop(f"_y{j}").alias(f"t{j}") for j in range(len(models))]).collect()
    use, size, fixed = {}, {}, set()
    for r in first:
        for j, m in enumerate(models):
            key = (r[by], j)
            use[key] = [0, *(i for i in range(1, k) if (r[f"s{i}"] or 0.0) > 1e-12 and columns[i] != m.outcome)]
            size[key] = (r["n"], r["g"])
            if (r[f"t{j}"] or 0.0) < 1e-12:
                fixed.add(key)
    beta = {key: np.zeros(k) for key in use}
    bread: dict = {}

    def predicted(j: int) -> Column:
        """The linear predictor of each row by its group's coefficients."""
        made = F.create_map(*[v for (g, i), b in beta.items() if i == j for v in (F.lit(g), F.array(*[F.lit(float(x)) for x in b]))])
        return F.aggregate(F.zip_with("_x", F.try_element_at(made, F.col(by)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    def probability(eta: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta))))

    kind = df.schema[by].dataType
    upper = np.triu_indices(k)

    def step(open_: list[tuple]) -> dict[tuple, np.ndarray]:
        """One pass: weighted products and scores of the open models; the steps of their coefficients. Each task multiplies the rows
        that it has and gives one row of sums for each group and model."""
        now = {key: beta[key] for key in open_}

        def run(batches):
            sums: dict[tuple, np.ndarray] = {}
            for batch in batches:
                x = batch.column("_x").values.to_numpy(zero_copy_only=False)[batch.column("_x").offset * k :][: batch.num_rows * k].reshape(-1, k)
                groups = batch.column(by).to_pylist()
                ys = {j: batch.column(f"_y{j}").to_numpy(zero_copy_only=False).astype(float) for j in {j for _, j in now}}
                where: dict = {}
                for i, g in enumerate(groups):
                    where.setdefault(g, []).append(i)
                for (g, j), b in now.items():
                    if g in where:
                        own, y = x[where[g]], ys[j][where[g]]
                        whole = np.isfinite(own).all(axis=1) & np.isfinite(y)  # a row with a null tells nothing
                        own, y = own[whole], y[whole]
                        eta = own @ b
                        p = 1 / (1 + np.exp(-np.clip(eta, -30, 30))) if models[j].kind == "logit" else eta
                        w = p * (1 - p) if models[j].kind == "logit" else np.ones(len(own))
                        part = np.concatenate([((own * w[:, None]).T @ own)[upper], own.T @ (y - p)])
                        sums[g, j] = sums[g, j] + part if (g, j) in sums else part
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in sums], to_arrow_type(kind)), pa.array([j for _, j in sums], pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["g", "j", "s"])

        kinds = T.StructType([T.StructField("g", kind), T.StructField("j", T.IntegerType()), T.StructField("s", T.ArrayType(T.DoubleType()))])
        parts = rows.where(F.col(by).isin(*{g for g, _ in open_})).select(by, "_x", *[f"_y{j}" for j in sorted({j for _, j in open_})]).mapInArrow(run, kinds)
        out = {}
        for r in parts.groupBy("g", "j").agg(*[F.sum(F.col("s")[i]).alias(f"c{i}") for i in range(len(upper[0]) + k)]).collect():
            key, own = (r["g"], r["j"]), list(r)[2:]
            u = use[key]
            gram = _matrix(own, k)[np.ix_(u, u)]
            bread[key] = np.linalg.pinv(gram + (ridge * np.eye(len(u)) if models[key[1]].kind == "logit" else 0))
            out[key] = bread[key] @ np.array([v or 0.0 for v in own[-k:]])[u]
        return out

    open_ = [key for key in use if key not in fixed]
    for turn in range(most):
        if not open_:
            break
        moved = step(open_)
        for key, d in moved.items():
            beta[key][use[key]] += d
        # least squares need one step; a model that has stopped moving has its products of the step before, so it goes once more
        open_ = [key for key, d in moved.items() if models[key[1]].kind == "logit" and np.abs(d).max() >= tolerance]
    logits = [key for key in use if key not in fixed and models[key[1]].kind == "logit"]
    if logits:
        step(logits)
    # scores summed within clusters, then their products
    made = rows
    for j, m in enumerate(models):
        eta = predicted(j)
        made = made.withColumn(f"_r{j}", F.col(f"_y{j}") - (probability(eta) if m.kind == "logit" else eta))
    scores = [(j, i, F.sum(F.col("_x")[i] * F.col(f"_r{j}"))) for j in range(len(models)) for i in range(k)]
    per = made.groupBy(by, "_cluster").agg(*[c.alias(f"s{j}_{i}") for j, i, c in scores], *[F.max(F.abs(F.col(f"_r{j}"))).alias(f"m{j}") for j in range(len(models))])
    cells = [F.sum(F.col(f"s{j}_{a}") * F.col(f"s{j}_{b}")) for j in range(len(models)) for a in range(k) for b in range(a, k)]
    wide = k * (k + 1) // 2
    out = {}
    for r in per.groupBy(by).agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)], *[F.max(f"m{j}").alias(f"m{j}") for j in range(len(models))]).collect():
        for j, m in enumerate(models):
            key = (r[by], j)
            u, (n, g) = use[key], size[key]
            own = [columns[i] for i in u]
            if key in fixed or m.kind == "ols" and (r[f"m{j}"] or 0.0) < 1e-10:
                out[r[by], m.outcome] = _degenerate(own, n, g)
                continue
            meat = _matrix(list(r)[1 + j * wide : 1 + (j + 1) * wide], k)[np.ix_(u, u)]
            v = bread[key] @ meat @ bread[key] * _correction(n, len(u), g)
            out[r[by], m.outcome] = Fit(own, beta[key][u], np.sqrt(np.clip(np.diag(v), 0, None)), n, g)
    return out


def with_dummies(df: DataFrame, columns: Sequence[str], most_levels: int = 200) -> tuple[DataFrame, list[str]]:
    """df with a 0/1 column for every level of the columns but the first, and the names of the new ones."""
    names: list[str] = []
    for d in columns:
        levels = [r[0] for r in df.select(d).where(F.col(d).isNotNull()).distinct().orderBy(d).limit(most_levels + 1).collect()]
        if len(levels) > most_levels:
            raise ValueError(f"{d} has more than {most_levels} levels")
        df = df.withColumns({f"{d}_{v}": F.coalesce(F.col(d) == F.lit(v), F.lit(False)).cast("double") for v in levels[1:]})
        names += [f"{d}_{v}" for v in levels[1:]]
    return df, names


def centred(df: DataFrame, column: str, by: str) -> DataFrame:
    """df with the column's mean within each value of `by` taken off it."""
    means = df.groupBy(by).agg(F.avg(column).alias("_mean"))
    return df.join(means, by, "left").withColumn(column, F.col(column) - F.col("_mean")).drop("_mean")
