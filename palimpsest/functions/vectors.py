"""Vector functions: cosine similarity, validity, and a deterministic token-hash embedding."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def is_usable(v: Column, dimensions: int) -> Column:
    """Exactly `dimensions` finite values, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dimensions) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def rounded(c: Column, digits: int) -> Column:
    """Rounded as the SQL does it: the double nearest to c times 10 ** digits decides, where F.round looks at decimal digits."""
    return F.signum(c) * F.floor(F.abs(c) * 10.0**digits + 0.5) / 10.0**digits


def hash_embedding(text: str | None, dimensions: int) -> list[float]:
    """Each ASCII word adds one to the bucket of its SHA-256's first four bytes, or takes one if the fifth is odd; unit length."""
    out = [0.0] * dimensions
    for w in re.findall(r"[a-z0-9_]+", (text or "").lower()):
        h = hashlib.sha256(w.encode()).digest()
        out[int.from_bytes(h[:4], "big") % dimensions] += 1.0 if h[4] % 2 == 0 else -1.0
    n = math.sqrt(sum(x * x for x in out))
    return [x / n for x in out] if n else out


def hash_embedder(dimensions: int):
    """The deterministic embedding as a vectorised function of a text column."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hash_embedding(t, dimensions))

    return embed


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Numbers times 10 ** digits as integers, rounded as Spark rounds: by their decimal digits, halves away from zero."""
    y = np.abs(x) * 10.0**digits
    out = np.copysign(np.floor(y + 0.5), x)
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).scaleb(digits).to_integral_value(ROUND_HALF_UP))
    return out


def _usable(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The rows whose `vector`, of one size in all, is finite and not zero, and these vectors."""
    v = t["vector"].combine_chunks()
    x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(t), -1)
    ok = np.isfinite(x).all(axis=1) & x.any(axis=1)
    return t.drop_columns("vector").filter(pa.array(ok)), x[ok]


#: Queries that are compared at a time, and pairs that are scored again at a time.
COMPARED, SCORED = 256, 2048


def meeting(limit: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of queries (query_id, cutoff, vector) and chunks (chunk_id, since, until, vector) the first `limit` chunks of each query.

    A matrix product finds whatever comes close to the last place; only that is scored as `cosine` does, value by
    value in order. Places are by score to nine digits, then by chunk_id, a chunk once.
    """

    def near(q: pa.Table, c: pa.Table) -> pa.Table:
        qs, cs, scores = [], [], []
        if len(q) and len(c):
            q, y = _usable(q)
            c, x = _usable(c.sort_by("chunk_id"))
        if len(q) and len(c):
            nx, ny = (np.sqrt(np.cumsum(z * z, axis=1)[:, -1]) for z in (x, y))
            unit = (x / nx[:, None]).T
            since, cutoff = (t.to_numpy() for t in (c["since"], q["cutoff"]))
            until = c["until"].fill_null(np.iinfo(np.int64).max).to_numpy()
            ids = c["chunk_id"].to_pylist()
            chunk = np.cumsum([0] + [a != b for a, b in zip(ids, ids[1:])])
            known: dict[bytes, int] = {}
            same = np.array([known.setdefault(z.tobytes(), i) for i, z in enumerate(x)])  # repeated vectors are scored once
            last = len(c) - limit * int(np.bincount(chunk).max())
            for at in range(0, len(q), COMPARED):
                part = slice(at, at + COMPARED)
                s = (y[part] / ny[part, None]) @ unit
                s[(since > cutoff[part, None]) | (until <= cutoff[part, None])] = -np.inf
                least = np.partition(s, last, axis=1)[:, last] - 2e-9 if last > 0 else np.full(len(s), -np.inf)
                qi, ci = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                qi += at
                pairs, where = np.unique(qi * len(c) + same[ci], return_inverse=True)
                score = np.empty(len(pairs))
                for k in range(0, len(pairs), SCORED):
                    a, b = np.divmod(pairs[k : k + SCORED], len(c))
                    score[k : k + SCORED] = np.cumsum(x[b] * y[a], axis=1)[:, -1] / (nx[b] * ny[a])
                score = score[where]
                order = np.lexsort((ci, -half_up(score, 9), qi))
                order = order[np.sort(np.unique(qi[order] * len(c) + chunk[ci[order]], return_index=True)[1])]
                _, start, n = np.unique(qi[order], return_index=True, return_counts=True)
                order = order[np.arange(len(order)) - np.repeat(start, n) < limit]
                qs.append(qi[order])
                cs.append(ci[order])
                scores.append(score[order])
        i, j, s = (np.concatenate([np.empty(0, np.int64 if z is not scores else np.float64), *z]) for z in (qs, cs, scores))
        return pa.table({"query_id": q["query_id"].take(pa.array(i)), "chunk_id": c["chunk_id"].take(pa.array(j)), "score": s})

    return near
