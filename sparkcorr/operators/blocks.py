"""The exact plan's inner loop: all correlations of a bucket of windows as matrix products.

Interpreted array functions cost microseconds a pair; a matrix product costs nanoseconds. So each
lag bucket (and block of series) is one Arrow group, and only the pairs that pass leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcorr.config import CorrConfig
from sparkcorr.operators.pairs import lag_buckets
from sparkcorr.shipping import ship

FOUND = pa.schema([("id1", pa.string()), ("t1", pa.int64()), ("id2", pa.string()), ("t2", pa.int64()), ("lag", pa.int64()), ("corr", pa.float64())])
TILE = 1024


def _side(table: pa.Table, w: int) -> tuple:
    """Windows in order of start: ids, starts, values, and sums."""
    table = table.sort_by("t0")
    xs = table.column("xs").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, w)
    s1, s2 = table.column("s1").to_numpy(), table.column("s2").to_numpy()
    return table.column("id").combine_chunks(), table.column("t0").to_numpy(), xs, s1, s2 - s1 * s1 / float(w)


def correlate(left: pa.Table, right: pa.Table, cfg: CorrConfig) -> pa.Table:
    """Pairs that pass, of later windows ``left`` and earlier ones ``right``; tile by tile."""
    w = cfg.w
    ids1, t1, x, sx, vx = _side(left, w)
    ids2, t2, y, sy, vy = _side(right, w)
    names = pa.concat_arrays([ids1, ids2]).unique()
    order = np.empty(len(names), np.int64)  # ranks, as ids compare by code point
    order[np.argsort(np.array(names.to_pylist(), object), kind="stable")] = np.arange(len(names))
    rank1, rank2 = (order[pa.compute.index_in(i, names).to_numpy()] for i in (ids1, ids2))
    out = []
    for start in np.unique(t1).tolist():
        a, b = np.searchsorted(t1, [start, start + 1])
        c, d = np.searchsorted(t2, [start - cfg.n_lags, start + 1])
        for i in range(a, b, TILE):
            for j in range(c, d, TILE):
                p, q = slice(i, min(i + TILE, b)), slice(j, min(j + TILE, d))
                scale = np.sqrt(np.outer(vx[p], vy[q]))
                r = (x[p] @ y[q].T - np.outer(sx[p], sy[q]) / float(w)) / scale
                np.clip(r, -1.0, 1.0, out=r)
                ok = (np.abs(r) if cfg.neg_corr else r) >= cfg.threshold
                ok &= (t2[q] < start) | (rank1[p][:, None] < rank2[q])
                m, n = np.nonzero(ok)
                out.append((m + i, n + j, r[m, n]))
    m, n, r = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.Table.from_arrays([ids1.take(pa.array(m)), pa.array(t1[m]), ids2.take(pa.array(n)), pa.array(t2[n]), pa.array(t1[m] - t2[n]), pa.array(r)], schema=FOUND)


NEAR = pa.schema([("id1", pa.int64()), ("id2", pa.int64()), ("sign", pa.int32()), ("dist", pa.float64())])


def block_neighbours(left: pa.Table, right: pa.Table, tau: float) -> pa.Table:
    """Pairs of vectors of two tables (id, sketch) at ``tau`` or less, smaller id on the left.

    Products tell which pairs are near; those are measured by their differences.
    """
    if not left.num_rows or not right.num_rows:
        return NEAR.empty_table()
    u, v = (np.array(t.column("sketch").to_pylist(), float) for t in (left, right))
    ids1, ids2, sign = left.column("id").to_numpy(), right.column("id").to_numpy(), right.column("sign").to_numpy()
    out = []
    for i in range(0, len(u), TILE):
        for j in range(0, len(v), TILE):
            p, q = u[i : i + TILE], v[j : j + TILE]
            square = (p * p).sum(1)[:, None] + (q * q).sum(1) - 2 * (p @ q.T)
            m, n = np.nonzero((square <= tau**2 + 1e-9 * (1 + tau**2)) & (ids1[i : i + TILE][:, None] < ids2[j : j + TILE]))
            exact = ((p[m] - q[n]) ** 2).sum(1)
            near = exact <= tau**2
            out.append((ids1[m[near] + i], ids2[n[near] + j], sign[n[near] + j], np.sqrt(exact[near])))
    return pa.Table.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out), NEAR)], schema=NEAR)


def block_votes(table: pa.Table, tau: float, min_votes: int, dims: int) -> pa.Table:
    """(id1, id2, votes) of the vectors (id, u, own) of ``block1`` and ``block2``, or of one block with itself, with ``min_votes`` or more."""
    own = table.column("own").to_numpy()
    ids = table.column("id").combine_chunks()
    rank = pa.compute.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
    by_rank = np.argsort(rank, kind="stable")
    u = np.full((table.num_rows, dims), np.nan)
    lists = table.column("u").combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    u[np.repeat(np.arange(len(u)), lengths), place] = lists.flatten().to_numpy(zero_copy_only=False)
    one, other = table.column("block1")[0].as_py(), table.column("block2")[0].as_py()
    left, right = by_rank[own[by_rank] == one], by_rank[own[by_rank] == other]
    out = []
    for p in _tiles(rank[left]):
        for q in _tiles(rank[right]):
            a, b = left[p], right[q]
            if one == other and rank[a[0]] > rank[b[-1]]:
                continue
            i, j = (np.cumsum(np.diff(rank[x], prepend=rank[x[0]]) > 0) for x in (a, b))  # the number of each row's id
            votes = np.zeros((i[-1] + 1, j[-1] + 1), np.int64)
            for s in range(0, len(a), TILE):
                for t in range(0, len(b), TILE):
                    near = np.zeros((len(a[s : s + TILE]), len(b[t : t + TILE])), np.int16)
                    for k in range(dims):
                        near += np.abs(u[a[s : s + TILE], k][:, None] - u[b[t : t + TILE], k]) <= tau
                    at, to = (np.unique(x, return_index=True) for x in (i[s : s + TILE], j[t : t + TILE]))
                    if len(at[0]) < len(near) or len(to[0]) < near.shape[1]:
                        near = np.add.reduceat(np.add.reduceat(near, at[1], 0, np.int64), to[1], 1)
                    votes[at[0][0] : at[0][-1] + 1, to[0][0] : to[0][-1] + 1] += near
            m, n = np.nonzero(votes >= min_votes)
            x, y = a[np.searchsorted(i, m)], b[np.searchsorted(j, n)]
            keep = rank[x] != rank[y] if one != other else rank[x] < rank[y]
            x, y, found = x[keep], y[keep], votes[m, n][keep]
            swap = rank[x] > rank[y]
            out.append((np.where(swap, y, x), np.where(swap, x, y), found))
    x, y, found = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    return pa.table({"id1": ids.take(pa.array(x)), "id2": ids.take(pa.array(y)), "votes": pa.array(found)})


def _tiles(rank: np.ndarray) -> list[slice]:
    """Slices of about ``TILE`` rows in order of ids; rows of one id are in one."""
    edges, at = [0], 0
    while at < len(rank):
        at = int(np.searchsorted(rank, rank[min(at + TILE, len(rank)) - 1], "right"))
        edges.append(at)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def correlated(windows: DataFrame, cfg: CorrConfig) -> DataFrame:
    """(id1, t1, id2, t2, lag, corr) of all pairs that pass, of windows neither constant nor spiked."""
    ship(windows.sparkSession)
    kept = windows.where(~F.col("is_const") & ~F.col("is_spiked")).select("id", "t0", "xs", "s1", "s2")
    left, right, keys = lag_buckets(kept, kept, cfg)
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # other attributes than the left's
    schema = "id1 string, t1 long, id2 string, t2 long, lag long, corr double"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: correlate(a, b, cfg) if a.num_rows and b.num_rows else FOUND.empty_table(), schema)
