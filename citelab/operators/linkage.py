"""Hierarchical clustering of a few series by their correlations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Series that are clustered at once: their matrix is the driver's.
MOST = 2_000


def correlation_distances(df: DataFrame, series: str, at: str, value: str) -> tuple[list, np.ndarray]:
    """(series, 1 - correlation) of every two series over the points that both have; 1 where it isn't defined.

    Sums of products are joined by point and added up in tasks; only the matrix comes to the driver, and more than MOST series are an error."""
    rows = df.where(F.col(value).isNotNull() & F.col(series).isNotNull()).groupBy(series, at).agg(F.avg(value).alias("v"))
    names = [r[0] for r in rows.select(series).distinct().orderBy(series).limit(MOST + 1).collect()]
    if len(names) > MOST:
        raise ValueError(f"more than {MOST} series")
    a, b = (rows.select(F.col(series).alias(s), F.col(at).alias("_at"), F.col("v").alias(v)) for s, v in (("a", "x"), ("b", "y")))
    pairs = a.join(b, "_at").where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("r")).collect()
    place, out = {n: i for i, n in enumerate(names)}, 1.0 - np.eye(len(names))
    for x, y, r in pairs:
        if r is not None and r == r:
            out[place[x], place[y]] = out[place[y], place[x]] = 1.0 - r
    return names, out


def linkage(distances: np.ndarray, method: str = "average") -> list[tuple[int, int, float, int]]:
    """(cluster, cluster, height, size) of each merge, lowest first; leaves are 0 to n - 1 and merge i makes cluster n + i.

    Nearest-neighbour chains: from any cluster on to its nearest and that one's nearest, until two are each other's; they are merged, and the
    chain goes on from what is left of it. Methods: single, complete, average."""
    d = np.array(distances, float)
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, alive, chain, merges = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            x = chain[-1]
            row = np.where(alive, d[x], np.inf)
            y = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[y]:
                y = chain[-2]  # of equally near ones the one before, so that chains end
                break
            chain.append(y)
        x, y = sorted(chain[-2:])
        del chain[-2:]
        merges.append((x, y, float(d[x, y])))
        joined = {"single": np.minimum(d[x], d[y]), "complete": np.maximum(d[x], d[y]), "average": (size[x] * d[x] + size[y] * d[y]) / (size[x] + size[y])}[method]
        d[y], d[:, y] = joined, joined
        d[y, y] = np.inf
        size[y] += size[x]
        alive[x] = False
    # merges were found along chains: in order of height, with names of the clusters that they join
    top, count, out = list(range(n)), [1] * n, []

    def root(i: int) -> int:
        while top[i] != i:
            i = top[i]
        return i

    label = list(range(n))
    for k, (x, y, height) in enumerate(sorted(merges, key=lambda m: m[2])):
        x, y = root(x), root(y)
        out.append((*sorted((label[x], label[y])), height, count[x] + count[y]))
        top[x], count[y], label[y] = y, count[x] + count[y], n + k
    return out


def clusters(names: Sequence, merges: list[tuple[int, int, float, int]], below: float) -> dict:
    """The cluster of each name, by its first name, when merges up to a height are made."""
    members = {i: [n] for i, n in enumerate(names)}
    for k, (x, y, height, _) in enumerate(merges):
        members[len(names) + k] = sorted(members[x] + members[y])
        if height <= below:
            del members[x], members[y]
        else:
            break
    made = [m for i, m in members.items() if i < len(names) or merges[i - len(names)][2] <= below]
    return {n: m[0] for m in made for n in m}
