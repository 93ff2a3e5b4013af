"""Average-linkage clustering of a few group vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

LIMIT = 5_000  # groups; the matrix of their distances is held on the driver


def average_linkage(vectors: DataFrame, key: str, vector: str, cut: float) -> DataFrame:
    """(key, cluster): merges the nearest clusters while their mean distance is at most ``cut``.

    Distance is one minus the cosine.  Clusters are numbered by their smallest
    key.  More than ``LIMIT`` groups are refused: cluster group means, not rows.
    """
    rows = vectors.select(key, vector).orderBy(key).limit(LIMIT + 1).collect()
    if len(rows) > LIMIT:
        raise ValueError(f"more than {LIMIT} groups to cluster")
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    if not rows:
        return spark.createDataFrame([], f"`{key}` {kind}, cluster int")
    x = np.array([r[1] for r in rows], float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    gap = 1 - x @ x.T
    np.fill_diagonal(gap, np.inf)
    members = {k: [k] for k in range(len(rows))}
    while len(members) > 1:
        i, j = np.unravel_index(np.argmin(gap), gap.shape)
        if gap[i, j] > cut:
            break
        a, b = len(members[i]), len(members[j])
        merged = (a * gap[i] + b * gap[j]) / (a + b)
        gap[i], gap[:, i] = merged, merged
        gap[i, i] = np.inf
        gap[j], gap[:, j] = np.inf, np.inf
        members[i] += members.pop(j)
    numbered = sorted(members.values(), key=min)
    out = [(rows[k][0], c) for c, group in enumerate(numbered) for k in group]
    return spark.createDataFrame(out, f"`{key}` {kind}, cluster int")
