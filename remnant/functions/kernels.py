"""NumPy helpers that run inside Spark tasks on Arrow batches.

The central object is the *paired moment vector* of a set of rows (x, y) about a shift
(c, d).  With x' = x - c, y' = y - d, k = |x'|^2 and l = |y'|^2 it holds the sums

    n, Sk, Sl, Skl, Skk, Sll, Sx, Sy, Skx, Sky, Slx, Sly, Sxx, Sxy, Syy

Moment vectors add up, can be moved to another shift exactly, and determine linear CKA
(biased and debiased) of any weighting of the rows.  So one scan with small partial states
replaces n x n Gram matrices, and resampling becomes a weighted sum of moment vectors.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa

FLUSH_DOUBLES = 8_000_000  # partial state kept per task before it is emitted
SLICE_DOUBLES = 2_000_000  # doubles worked on at a time


# -- moment vectors --------------------------------------------------------------------
def moment_slices(p, q):
    sizes = [
        ("n", 1), ("k", 1), ("l", 1), ("kl", 1), ("kk", 1), ("ll", 1),
        ("x", p), ("y", q), ("kx", p), ("ky", q), ("lx", p), ("ly", q),
        ("xx", p * p), ("xy", p * q), ("yy", q * q),
    ]
    out, at = {}, 0
    for name, size in sizes:
        out[name] = slice(at, at + size)
        at += size
    return out, at


def row_features(x, y):
    """Moment contributions of single rows, already shifted."""
    n, p = x.shape
    q = y.shape[1]
    s, width = moment_slices(p, q)
    k, l = (x * x).sum(1), (y * y).sum(1)
    f = np.empty((n, width))
    f[:, s["n"]] = 1.0
    for name, v in (("k", k), ("l", l), ("kl", k * l), ("kk", k * k), ("ll", l * l)):
        f[:, s[name]] = v[:, None]
    f[:, s["x"]], f[:, s["y"]] = x, y
    f[:, s["kx"]], f[:, s["ky"]] = k[:, None] * x, k[:, None] * y
    f[:, s["lx"]], f[:, s["ly"]] = l[:, None] * x, l[:, None] * y
    f[:, s["xx"]] = (x[:, :, None] * x[:, None, :]).reshape(n, -1)
    f[:, s["xy"]] = (x[:, :, None] * y[:, None, :]).reshape(n, -1)
    f[:, s["yy"]] = (y[:, :, None] * y[:, None, :]).reshape(n, -1)
    return f


def summed_features(x, y):
    """Sum of row_features without building the per-row outer products."""
    p, q = x.shape[1], y.shape[1]
    s, width = moment_slices(p, q)
    k, l = (x * x).sum(1), (y * y).sum(1)
    t = np.empty(width)
    t[s["n"]] = len(x)
    for name, v in (
        ("k", k.sum()), ("l", l.sum()), ("kl", k @ l), ("kk", k @ k), ("ll", l @ l),
        ("x", x.sum(0)), ("y", y.sum(0)), ("kx", k @ x), ("ky", k @ y), ("lx", l @ x),
        ("ly", l @ y), ("xx", (x.T @ x).ravel()), ("xy", (x.T @ y).ravel()),
        ("yy", (y.T @ y).ravel()),
    ):
        t[s[name]] = v
    return t


def translate(t, p, q, d, e):
    """Moments (rows of t) about a shift moved by (d, e); d and e may differ per row."""
    t = np.atleast_2d(t)
    m = len(t)
    s, width = moment_slices(p, q)
    d = np.broadcast_to(d, (m, p))
    e = np.broadcast_to(e, (m, q))
    n, k, l, kl, kk, ll = (t[:, s[i]] for i in ("n", "k", "l", "kl", "kk", "ll"))
    x, y, kx, ky, lx, ly = (t[:, s[i]] for i in ("x", "y", "kx", "ky", "lx", "ly"))
    xx = t[:, s["xx"]].reshape(m, p, p)
    xy = t[:, s["xy"]].reshape(m, p, q)
    yy = t[:, s["yy"]].reshape(m, q, q)

    def dot(u, v):
        return (u * v).sum(1, keepdims=True)

    a, b = dot(d, d), dot(e, e)
    xxd = np.einsum("mij,mj->mi", xx, d)
    xye = np.einsum("mij,mj->mi", xy, e)
    xyd = np.einsum("mij,mi->mj", xy, d)
    yye = np.einsum("mij,mj->mi", yy, e)
    out = np.empty((m, width))
    k2 = k - 2 * dot(d, x) + n * a
    l2 = l - 2 * dot(e, y) + n * b
    out[:, s["n"]], out[:, s["k"]], out[:, s["l"]] = n, k2, l2
    out[:, s["x"]], out[:, s["y"]] = x - n * d, y - n * e
    out[:, s["kx"]] = kx - 2 * xxd + a * x - d * k2
    out[:, s["ky"]] = ky - 2 * xyd + a * y - e * k2
    out[:, s["lx"]] = lx - 2 * xye + b * x - d * l2
    out[:, s["ly"]] = ly - 2 * yye + b * y - e * l2
    out[:, s["kl"]] = (
        kl - 2 * dot(e, ky) + b * k - 2 * dot(d, lx) + 4 * dot(d, xye)
        - 2 * b * dot(d, x) + a * l - 2 * a * dot(e, y) + a * b * n
    )
    out[:, s["kk"]] = (
        kk - 4 * dot(d, kx) + 2 * a * k + 4 * dot(d, xxd) - 4 * a * dot(d, x) + a * a * n
    )
    out[:, s["ll"]] = (
        ll - 4 * dot(e, ly) + 2 * b * l + 4 * dot(e, yye) - 4 * b * dot(e, y) + b * b * n
    )

    def outer(u, v):
        return (u[:, :, None] * v[:, None, :]).reshape(m, -1)

    out[:, s["xx"]] = t[:, s["xx"]] - outer(d, x) - outer(x, d) + n * outer(d, d)
    out[:, s["xy"]] = t[:, s["xy"]] - outer(d, y) - outer(x, e) + n * outer(d, e)
    out[:, s["yy"]] = t[:, s["yy"]] - outer(e, y) - outer(y, e) + n * outer(e, e)
    return out


def cka_values(t, p, q):
    """(n, biased, debiased) per moment vector; NaN where undefined."""
    t = np.atleast_2d(t)
    s, _ = moment_slices(p, q)
    n = t[:, s["n"]]
    with np.errstate(all="ignore"):
        t = translate(t, p, q, t[:, s["x"]] / n, t[:, s["y"]] / n)
        n = n[:, 0]
        fro = {i: (t[:, s[i]] ** 2).sum(1) for i in ("xx", "xy", "yy")}
        tot_k, tot_l = t[:, s["k"]][:, 0], t[:, s["l"]][:, 0]

        def hsic(f, cross, a, b):
            return (f - cross - 2 * cross / (n - 2) + a * b / ((n - 1) * (n - 2))) / (n * (n - 3))

        hxy = hsic(fro["xy"], t[:, s["kl"]][:, 0], tot_k, tot_l)
        hxx = hsic(fro["xx"], t[:, s["kk"]][:, 0], tot_k, tot_k)
        hyy = hsic(fro["yy"], t[:, s["ll"]][:, 0], tot_l, tot_l)
        ok = (n >= 4) & (hxx > 0) & (hyy > 0)
        debiased = np.where(
            ok, np.clip(hxy / np.sqrt(np.maximum(hxx * hyy, 1e-10)), 0, 1), np.nan
        )
        denom = np.sqrt(fro["xx"] * fro["yy"])
        biased = np.where(denom > 0, np.clip(fro["xy"] / denom, 0, 1), 0.0)
        biased = np.where(n > 0, biased, np.nan)
    return n, biased, debiased


# -- Arrow plumbing --------------------------------------------------------------------
def _groups(batch, keys):
    """Row indices of each key tuple of a batch."""
    if not keys:
        return {(): np.arange(batch.num_rows)}
    frame = pd.DataFrame({k: batch.column(k).to_pandas() for k in keys})
    codes, uniques = pd.factorize(pd.MultiIndex.from_frame(frame), sort=False)
    order = np.argsort(codes, kind="stable")
    ends = np.cumsum(np.bincount(codes, minlength=len(uniques)))
    first = np.concatenate([[0], ends[:-1]])
    rows = [order[a:b] for a, b in zip(first, ends)]
    cols = [batch.column(k) for k in keys]
    return {tuple(c[int(r[0])].as_py() for c in cols): r for r in rows}


def _matrix(batch, name, idx):
    values = batch.column(name).take(pa.array(idx))
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (values.value_lengths().to_numpy(zero_copy_only=False) != len(flat) // len(idx)).any():
        raise ValueError(f"vectors of different length in column {name}")
    return flat.reshape(len(idx), -1)


def _emit(rows, schema):
    if rows:
        cols = list(zip(*rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema
        )


def _state_rows(state):
    for key, (c, d, t) in state.items():
        yield (*key, len(c), len(d), c, d, t)


def moment_partials(keys, schema, x="x", y="y"):
    """mapInArrow: partial moments per key and task, each about its own local shift."""

    def run(batches):
        state, held = {}, 0
        for batch in batches:
            for key, idx in _groups(batch, keys).items():
                mx, my = _matrix(batch, x, idx), _matrix(batch, y, idx)
                if key not in state:
                    c, d = mx.mean(0), my.mean(0)
                    state[key] = [c, d, summed_features(mx - c, my - d)]
                    held += len(state[key][2])
                else:
                    c, d, t = state[key]
                    t += summed_features(mx - c, my - d)
            if held > FLUSH_DOUBLES:
                yield from _emit(list(_state_rows(state)), schema)
                state, held = {}, 0
        yield from _emit(list(_state_rows(state)), schema)

    return run


def _width_slices(batch):
    """Slices of rows of equal widths with about SLICE_DOUBLES moments each: (slice, p, q)."""
    if not batch.num_rows:
        return
    p, q = (batch.column(c).to_numpy() for c in ("p", "q"))
    cuts = [0, *(np.flatnonzero((p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1), len(p)]
    for a, b in zip(cuts, cuts[1:]):
        step = max(1, SLICE_DOUBLES // moment_slices(int(p[a]), int(q[a]))[1])
        for s in range(a, b, step):
            yield batch.slice(s, min(step, b - s)), int(p[a]), int(q[a])


def _all(batch, name):
    return _matrix(batch, name, np.arange(batch.num_rows))


def merge_moments(keys, schema):
    """mapInArrow over rows sorted by key: moments of equal keys are moved to one centre and added.

    Whole slices are moved at once; the last group of a slice stays open for the next one.
    """

    def run(batches):
        last = None  # key, centres and sums of the open group
        for batch in batches:
            for rows, p, q in _width_slices(batch):
                groups = _groups(rows, keys)
                starts = np.array([r[0] for r in groups.values()])
                first = np.repeat(starts, np.diff(np.append(starts, rows.num_rows)))
                c, d = _all(rows, "cx"), _all(rows, "cy")
                t = translate(_all(rows, "t"), p, q, c[first] - c, d[first] - d)
                done = []
                for key, at, total in zip(groups, starts, np.add.reduceat(t, starts)):
                    if last is not None and last[0] == key:
                        _, lc, ld, lt = last
                        if (len(lc), len(ld)) != (p, q):
                            raise ValueError("vectors of different length in one group")
                        last = (key, lc, ld, lt + translate(total, p, q, lc - c[at], ld - d[at])[0])
                        continue
                    if last is not None:
                        done.append(last)
                    last = (key, c[at], d[at], total)
                yield from _emit([(*k, len(x), len(y), x, y, v) for k, x, y, v in done], schema)
        if last is not None:
            k, x, y, v = last
            yield from _emit([(*k, len(x), len(y), x, y, v)], schema)

    return run


def _kept(rows, keep, schema, *values):
    """The kept columns of rows beside columns of doubles, NULL where a value is not finite."""
    columns = [pa.array(v, pa.float64(), mask=~np.isfinite(v)) for v in values]
    return pa.RecordBatch.from_arrays([*(rows.column(k) for k in keep), *columns], schema=schema)


def moments_to_cka(keep, schema):
    """mapInArrow: n, biased and debiased CKA of each moment row."""

    def run(batches):
        for batch in batches:
            for rows, p, q in _width_slices(batch):
                yield _kept(rows, keep, schema, *cka_values(_all(rows, "t"), p, q))

    return run


def leave_one_out(keep, schema):
    """mapInArrow over rows with unit moments and group moments (g_ columns)."""

    def run(batches):
        for batch in batches:
            for rows, p, q in _width_slices(batch):
                shift = _all(rows, "g_cx") - _all(rows, "cx"), _all(rows, "g_cy") - _all(rows, "cy")
                unit, group = translate(_all(rows, "t"), p, q, *shift), _all(rows, "g_t")
                yield _kept(rows, keep, schema, cka_values(group, p, q)[2], cka_values(group - unit, p, q)[2])

    return run


def linear_probe(keep, schema, ridge):
    """mapInArrow over moments of features x and one target y: least-squares weights.

    The last weight is the intercept.  Squared weights cost `ridge` per row, so that the
    equations always have one solution.
    """

    def run(batches):
        for batch in batches:
            for rows, p, q in _width_slices(batch):
                s, _ = moment_slices(p, q)
                t, cx, cy = _all(rows, "t"), _all(rows, "cx"), _all(rows, "cy")
                n = t[:, s["n"]]
                mx, my = t[:, s["x"]] / n, t[:, s["y"]] / n
                t = translate(t, p, q, mx, my)
                xx = t[:, s["xx"]].reshape(-1, p, p) + ridge * n[:, :, None] * np.eye(p)
                w = np.linalg.solve(xx, t[:, s["xy"]].reshape(-1, p, q))[:, :, 0]
                b = (my + cy)[:, 0] - (w * (mx + cx)).sum(1)
                weights = pa.array(list(np.column_stack([w, b])), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in keep), weights], schema=schema)

    return run


def logistic_partials(keys, schema):
    """mapInArrow over (keys, x, label, w): log loss, gradient and Hessian of each key and task at its weights.

    One vector per key: rows, loss, gradient (p + 1), Hessian ((p + 1)^2); the last feature is one.
    """

    def run(batches):
        state, held = {}, 0
        for batch in batches:
            for key, idx in _groups(batch, keys).items():
                for part in np.array_split(idx, max(1, len(idx) // 4096)):
                    x = np.column_stack([_matrix(batch, "x", part), np.ones(len(part))])
                    y = batch.column("label").take(pa.array(part)).to_numpy(zero_copy_only=False)
                    z = x @ _matrix(batch, "w", part[:1])[0]
                    m = 0.5 * (1 + np.tanh(z / 2))  # the logistic function without overflow
                    loss = (np.logaddexp(0, z) - y * z).sum()
                    h = (x * (m * (1 - m))[:, None]).T @ x
                    t = np.concatenate([[len(part), loss], x.T @ (m - y), h.ravel()])
                    if key in state:
                        if len(state[key]) != len(t):
                            raise ValueError("vectors of different length in one group")
                        state[key] += t
                    else:
                        state[key] = t
                        held += len(t)
            if held > FLUSH_DOUBLES:
                yield from _emit([(*k, t) for k, t in state.items()], schema)
                state, held = {}, 0
        yield from _emit([(*k, t) for k, t in state.items()], schema)

    return run


def added_vectors(keys, schema):
    """mapInArrow over rows (keys, t) sorted by key: sums of the vectors of equal keys."""

    def run(batches):
        last = None
        for batch in batches:
            for key, idx in _groups(batch, keys).items():
                for i in idx:
                    t = _matrix(batch, "t", [i])[0]
                    if last is not None and last[0] == key:
                        if len(last[1]) != len(t):
                            raise ValueError("vectors of different length in one group")
                        last = key, last[1] + t
                    else:
                        if last is not None:
                            yield from _emit([(*last[0], last[1])], schema)
                        last = key, t.copy()
        if last is not None:
            yield from _emit([(*last[0], last[1])], schema)

    return run


def newton_step(keep, schema, ridge, tol):
    """mapInArrow over (keep, base, w, best, t): the next weights to look at of each key.

    If the loss at w is no greater than at base, w becomes the base and a full Newton step is
    taken; otherwise the step is halved.  Squared weights without the intercept cost `ridge` / 2
    per row, so that the equations always have one solution.  A key is done when its gradient per
    row is below `tol`, or when a step no longer changes the weights.
    """

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                base, w, t = (_matrix(batch, c, [i])[0] for c in ("base", "w", "t"))
                best, p = batch.column("best")[i].as_py(), len(w)
                n = t[0]
                free = np.append(np.ones(p - 1), 0.0) * ridge * n
                loss = t[1] + 0.5 * free @ (w * w)
                g = t[2 : 2 + p] + free * w
                if best is None or loss <= best * (1 + 1e-15):
                    h = t[2 + p :].reshape(p, p) + np.diag(free)
                    # Labels of one kind leave the intercept without a finite solution.
                    h[-1, -1] += 1e-12 * n
                    base, best = w, loss
                    w = base - np.linalg.solve(h, g)
                    done = np.abs(g).max() <= tol * n
                else:
                    w, done = (base + w) / 2, False
                done = bool(done or np.abs(w - base).max() <= 1e-15 * max(1.0, np.abs(base).max()))
                out.append((*(batch.column(k)[i].as_py() for k in keep), base, w, float(best), done))
            yield from _emit(out, schema)

    return run


def packed_draws(seed, rows, schema):
    """mapInArrow over (n_units, r0, r1, s0, s1): the draws of slots s0 <= s < s1 by replicates r0 <= r < r1.

    A slot of a replicate draws one unit by the hash of (seed, replicate, slot).  Units are numbered
    in tiles of `rows`; an output row holds the draws of a tile: how many each replicate has, and
    the places in the tile, two bytes each, replicate by replicate.
    """

    def run(batches):
        for batch in batches:
            for job in batch.to_pylist():
                n, r0, r1, s0, s1 = (job[k] for k in ("n_units", "r0", "r1", "s0", "s1"))
                slots = [str(s).encode() for s in range(s0, s1)]
                tiles = -(-n // rows)
                counts = np.zeros((r1 - r0, tiles), np.int32)
                places = []
                for r in range(r0, r1):
                    head = f"{seed}|{r}|".encode()
                    drawn = b"".join([md5(head + s).digest()[:4] for s in slots])
                    tile, at = np.divmod(np.frombuffer(drawn, ">u4").astype(np.int64) % n, rows)
                    counts[r - r0] = np.bincount(tile, minlength=tiles)
                    places.append(at[np.argsort(tile, kind="stable")].astype("<u2"))
                ends = counts.cumsum(1)
                for k in np.flatnonzero(counts.any(0)).tolist():
                    mine = [p[e - c : e] for p, c, e in zip(places, counts[:, k].tolist(), ends[:, k].tolist())]
                    yield from _emit([(n, k, r0, counts[:, k].tolist(), np.concatenate(mine).tobytes())], schema)

    return run


def _draws(batch, i):
    """First replicate of a row of packed draws, and replicate and place of each of its draws."""
    counts = np.array(batch.column("counts")[i].as_py())
    return batch.column("r0")[i].as_py(), np.repeat(np.arange(len(counts)), counts), np.frombuffer(batch.column("places")[i].as_py(), "<u2")


def unpacked_draws(rows, schema):
    """mapInArrow over packed draws: a row per drawn unit lists its replicates, counted from r0, with repeats."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r0, rep, place = _draws(batch, i)
                order = np.lexsort((rep, place))
                unit, rep = place[order].astype(np.int64) + batch.column("tile")[i].as_py() * rows, rep[order]
                at = np.flatnonzero(np.diff(unit, prepend=-1))
                lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(unit)).astype(np.int32)), pa.array(rep.astype(np.int16)))
                yield _batch(schema, [batch.column("n_units")[i].as_py()], len(at), [unit[at], r0, lists])

    return run


def replicate_moments(keys, schema, n_replicates, rows, from_moments, finish):
    """mapInArrow over packed draws and rows, sorted by (n_units, tile, bucket, kind, keys).

    The draws of a tile (kind 0) come before its rows, which hold x and y, or the moments of a whole
    unit.  With `finish` a group lies in one tile and is given out as debiased CKA per replicate,
    otherwise as moments that still have to be added up.
    """

    def features(batch, idx, c, d, p, q):
        if from_moments:
            return translate(_matrix(batch, "t", idx), p, q, c - _matrix(batch, "cx", idx), d - _matrix(batch, "cy", idx))
        return row_features(_matrix(batch, "x", idx) - c, _matrix(batch, "y", idx) - d)

    def done(state):
        for key, (c, d, t) in state.items():
            if finish:
                value = cka_values(t, len(c), len(d))[2]
                ok = pa.array(value, pa.float64(), mask=~np.isfinite(value))
                yield _batch(schema, key, n_replicates, [np.arange(n_replicates, dtype=np.int32), ok])
            else:
                drawn = np.flatnonzero(t.any(1)).tolist()
                for s in range(0, len(drawn), 100):
                    yield from _emit([(*key, r, len(c), len(d), c, d, t[r]) for r in drawn[s : s + 100]], schema)

    def run(batches):
        tile, weights, state, held = None, None, {}, 0
        for batch in batches:
            for (kind, *at), idx in _groups(batch, ["kind", "n_units", "tile", "bucket"]).items():
                if at != tile:
                    tile, weights = at, np.zeros((min(rows, at[0]), n_replicates), np.uint16)
                if kind == 0:
                    for i in idx:
                        r0, rep, place = _draws(batch, i)
                        width = min(n_replicates - r0, rep.max() + 1)
                        hits = np.bincount(place * np.int64(width) + rep, minlength=len(weights) * width)
                        weights[:, r0 : r0 + width] += hits.reshape(-1, width).astype(np.uint16)
                    continue
                mine = batch.take(pa.array(idx))
                place = mine.column("place").to_numpy()
                for key, idx in _groups(mine, keys).items():
                    if key not in state:
                        if held > FLUSH_DOUBLES:
                            yield from done(state)
                            state, held = {}, 0
                        names = ("cx", "cy") if from_moments else ("x", "y")
                        c, d = (_matrix(mine, n, idx).mean(0) for n in names)
                        state[key] = [c, d, np.zeros((n_replicates, moment_slices(len(c), len(d))[1]))]
                        held += state[key][2].size
                    c, d, t = state[key]
                    step = max(1, SLICE_DOUBLES // max(t.shape))
                    for s in range(0, len(idx), step):
                        part = idx[s : s + step]
                        t += weights[place[part]].T.astype(np.float64) @ features(mine, part, c, d, len(c), len(d))
        yield from done(state)

    return run


def replicate_sums(keys, schema, rows):
    """mapInArrow over packed draws and values, sorted by (n_units, tile, kind, keys).

    The draws of a tile (kind 0) come before its values.  Number and sum of the drawn values per
    key and replicate.
    """

    def run(batches):
        tile, draws, state, held = None, [], {}, {}

        def add():
            for key, (n, total) in held.items():
                for r0, counts, place in draws:
                    rep = np.repeat(np.arange(len(counts)), counts)
                    sums = np.stack([np.bincount(rep, v[place], len(counts)) for v in (n, total)])
                    state[key, r0] = state.get((key, r0), 0.0) + sums

        for batch in batches:
            for (kind, *at), idx in _groups(batch, ["kind", "n_units", "tile"]).items():
                if at != tile:
                    add()
                    tile, draws, held = at, [], {}
                if kind == 0:
                    for i in idx:
                        places = np.frombuffer(batch.column("places")[i].as_py(), "<u2")
                        draws.append((batch.column("r0")[i].as_py(), np.array(batch.column("counts")[i].as_py()), places))
                    continue
                mine = batch.take(pa.array(idx))
                place, value = (mine.column(c).to_numpy() for c in ("place", "value"))
                for key, idx in _groups(mine, keys).items():
                    if key not in held:
                        # Keys are sorted: those before it are complete.
                        add()
                        held = {key: np.zeros((2, min(rows, at[0])))}
                    np.add.at(held[key][0], place[idx], 1.0)
                    np.add.at(held[key][1], place[idx], value[idx])
            if 2 * sum(v.size for v in state.values()) > FLUSH_DOUBLES:
                yield from _emit(list(rows_of(state)), schema)
                state.clear()
        add()
        yield from _emit(list(rows_of(state)), schema)

    def rows_of(state):
        for (key, r0), (n, total) in state.items():
            for r in np.flatnonzero(n).tolist():
                yield (*key, r0 + r, float(n[r]), float(total[r]))

    return run


# -- blocks of items against blocks of items -------------------------------------------
def _sq_dist(a, b, same):
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    d = np.maximum(d, 0.0)
    if same:
        np.fill_diagonal(d, 0.0)
    return d


def _blocks(batches):
    """Row by row: the other columns, and item ids and matrices of both blocks as arrays.

    A block is a list of items, or a struct of packed matrices.  Without a second block, the first is
    paired with itself.
    """
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            row = {}
            for n in names:
                value = batch.column(n)[i]
                if n == "b" and not value.is_valid:
                    row[n] = row["a"]
                elif pa.types.is_struct(value.type):
                    row[n] = _unpacked(value)
                elif n in ("a", "b"):
                    ids, x, y = value.values.flatten()
                    size = len(ids)
                    row[n] = (ids, *(v.flatten().to_numpy(zero_copy_only=False).reshape(size, -1) for v in (x, y)))
                elif pa.types.is_list(value.type) and not pa.types.is_struct(value.type.value_type):
                    row[n] = value.values.to_numpy(zero_copy_only=False)
                else:
                    row[n] = value.as_py()
            yield row, row["bi"] == row["bj"]


def _unpacked(value):
    """Ids (if any) and matrices of a packed block; of several groups with the same x, that, and ids and y of each."""
    size = value["n"].as_py()
    mats = [np.frombuffer(value[f.name].as_py()).reshape(size, -1) for f in value.type if f.name in ("x", "y")]
    if value.type.get_field_index("groups") >= 0:
        groups = value["groups"].values
        ids = groups.field("ids") if groups.type.get_field_index("ids") >= 0 else None
        return mats[0], [
            (None if ids is None else ids[i].values, np.frombuffer(y.as_py()).reshape(size, -1))
            for i, y in enumerate(groups.field("y"))
        ]
    return (value["ids"].values if value.type.get_field_index("ids") >= 0 else None, *mats)


TILE = (512, 4096)  # items against items whose matrix is held at once


def _tiles(n_a, n_b, same, tile=None):
    """Slices of both blocks that cover each pair of items once, and whether they are the same items."""
    high, wide = tile or TILE
    for r in range(0, n_a, high):
        rows = slice(r, min(r + high, n_a))
        if same:
            yield rows, rows, True
        for c in range(rows.stop if same else 0, n_b, wide):
            yield rows, slice(c, min(c + wide, n_b)), False


class _Counts:
    """Counts of non-negative integers: as they come while they are few, then dense from the least positive one on."""

    def __init__(self):
        self.few, self.held, self.zeros, self.lo, self.counts = [], 0, 0, 0, None

    def add(self, v, times=1):
        self.few.append((v, times))
        self.held += len(v)
        if self.held > SLICE_DOUBLES // 2:
            self._fold()

    def _fold(self):
        for v, times in self.few:
            zeros = int(np.count_nonzero(v == 0))
            self.zeros += times * zeros
            if zeros == len(v):
                continue
            v = v[v > 0] if zeros else v
            lo, hi = int(v.min()), int(v.max())
            if self.counts is None:
                self.lo, self.counts = lo, np.zeros(0, np.int64)
            start, stop = min(lo, self.lo), max(hi + 1, self.lo + len(self.counts))
            if stop - start > len(self.counts):
                wider = np.zeros(stop - start, np.int64)
                wider[self.lo - start : self.lo - start + len(self.counts)] = self.counts
                self.lo, self.counts = start, wider
            np.add.at(self.counts, v - self.lo, times)
        self.few, self.held = [], 0

    def bins(self):
        if self.counts is None and not self.zeros:
            v, times = (np.concatenate(c) for c in zip(*((v, np.full(len(v), t)) for v, t in self.few))) if self.few else (np.zeros(0, np.int64),) * 2
            bins, at = np.unique(v, return_inverse=True)
            return bins, np.bincount(at, times, len(bins)).astype(np.int64)
        self._fold()
        dense = np.zeros(0, np.int64) if self.counts is None else self.counts
        at = np.flatnonzero(dense)
        zero = np.zeros(1 if self.zeros else 0, np.int64)
        return np.append(zero, at + self.lo), np.append(zero + self.zeros, dense[at])


def _batch(schema, key, n, columns):
    """Record batch of n rows: the key repeated, then the given columns (None = all NULL)."""
    arrays = []
    for f, v in zip(schema, [*key, *columns]):
        if v is None:
            arrays.append(pa.nulls(n, f.type))
        elif np.ndim(v) == 0 and not isinstance(v, (pa.Array, pa.ChunkedArray)):
            arrays.append(pa.repeat(pa.scalar(v, f.type), n))
        elif isinstance(v, pa.Array):
            arrays.append(v.cast(f.type))
        else:
            arrays.append(pa.array(v, type=f.type, from_pandas=True))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def distance_histogram(keys, schema, shift, prefix_shift=None):
    """mapInArrow over block pairs: counts of squared distances by leading bits.

    Non-negative doubles sort like their bit patterns.  With `prefix_shift`, only distances
    whose coarser prefix equals the selected one (px, py) are counted.
    """

    def run(batches):
        for row, same in _blocks(batches):
            (_, xa, ya), (_, xb, yb) = row["a"], row["b"]
            key = [row[k] for k in keys]
            for side, a, b, want in (("x", xa, xb, "px"), ("y", ya, yb, "py")):
                # Those of one prefix span at most 2^(prefix_shift - shift) bins.
                found = _Counts()
                for ra, rb, diagonal in _tiles(len(a), len(b), same):
                    bits = _sq_dist(a[ra], b[rb], diagonal).ravel().view(np.int64)
                    if prefix_shift is not None:
                        bits = bits[(bits >> prefix_shift) == row[want]]
                    found.add(bits >> shift, 1 if diagonal else 2)
                bins, counts = found.bins()
                for s in range(0, len(bins), 100_000):
                    part = slice(s, s + 100_000)
                    yield _batch(schema, key, len(bins[part]), [side, bins[part], counts[part]])

    return run


def rbf_sums(keys, schema):
    """mapInArrow over block pairs of groups with the same x: of each, kernel row sums per item and products over the pair."""

    def run(batches):
        kept = np.empty((2, NEAR[0] * NEAR[1]))
        one_a, one_b = np.ones(NEAR[0]), np.ones(NEAR[1])

        def kernel(of, buffer, ra, rb, diagonal, sums_a, sums_b):
            v = of(ra, rb, diagonal, buffer)
            np.exp(v, out=v)
            sums_a[ra] += v @ one_b[: v.shape[1]]
            if not diagonal:
                sums_b[rb] += one_a[: len(v)] @ v
            return v.ravel()

        for row, same in _blocks(batches):
            (xa, of_a), (xb, of_b) = row["a"], row["b"]
            facts = row["facts"]

            def sums():
                here = np.zeros(len(xa))
                return here, here if same else np.zeros(len(xb))

            x, sums_x = _exponents(xa, xb, row["sigma_x"]), sums()
            y = [_exponents(a, b, f["sigma_y"]) for (_, a), (_, b), f in zip(of_a, of_b, facts)]
            sums_y, products = [sums() for _ in y], np.zeros((len(y), 3))
            for ra, rb, diagonal in _tiles(len(xa), len(xb), same, NEAR):
                times = 1 if diagonal else 2
                kx = kernel(x, kept[0], ra, rb, diagonal, *sums_x)
                xx = kx @ kx
                for of, own, total in zip(y, sums_y, products):
                    ky = kernel(of, kept[1], ra, rb, diagonal, *own)
                    total += times * np.array([kx @ ky, xx, ky @ ky])
            for f, (ia, _), (ib, _), own, total in zip(facts, of_a, of_b, sums_y, products):
                key = [f["key"][k] for k in keys]
                yield _batch(schema, key, 1, [None, None, None, *total.tolist()])
                yield _batch(schema, key, len(ia), [ia, sums_x[0], own[0], None, None, None])
                if not same:
                    yield _batch(schema, key, len(ib), [ib, sums_x[1], own[1], None, None, None])

    return run


def _exponents(a, b, sigma):
    """Function of two slices, whether they are the same, and a buffer: squared distances over -2 sigma^2."""
    scale = -1 / (2 * sigma**2)
    if not (np.isfinite(a).all() and np.isfinite(b).all() and np.isfinite(scale)):
        return lambda ra, rb, diagonal, kept: _sq_dist(a[ra], b[rb], diagonal) * scale
    left, right = _factors(a, b, "squared", scale=scale)
    # Long vectors leave rounding errors that are no longer small, and no exponent may be positive.
    long = np.linalg.norm(left, axis=1).max(initial=0) * np.linalg.norm(right, axis=0).max(initial=0) > 1e3

    def of(ra, rb, diagonal, kept):
        v = _product(left, right, ra, rb, kept)
        if long:
            np.minimum(v, 0.0, out=v)
        if diagonal:
            np.fill_diagonal(v, 0.0)
        return v

    return of


def _distances(metric):
    """Function of two blocks of vectors: their matrix of distances."""

    def unit(v):
        if metric == "cosine":
            return v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-8)
        v = v - v.mean(1, keepdims=True)
        with np.errstate(all="ignore"):
            return v / np.linalg.norm(v, axis=1, keepdims=True)

    def dist(a, b, same):
        if metric == "euclidean":
            return np.sqrt(_sq_dist(a, b, same))
        return np.maximum(1.0 - unit(a) @ unit(b).T, 0.0)

    return dist


def pair_distances(keys, schema, metric):
    """mapInArrow over block pairs: distances of both representations for i < j."""
    import pyarrow.compute as pc

    dist = _distances(metric)

    def run(batches):
        for row, same in _blocks(batches):
            (ia, xa, ya), (ib, xb, yb) = row["a"], row["b"]
            dx, dy = dist(xa, xb, same), dist(ya, yb, same)
            if same:
                r, c = np.triu_indices(len(ia), 1)
            else:
                r, c = (v.ravel() for v in np.indices(dx.shape))
            key = [row[k] for k in keys]
            for at in range(0, len(r), 100_000):
                rr, cc = r[at : at + 100_000], c[at : at + 100_000]
                u, v = ia.take(pa.array(rr)), ib.take(pa.array(cc))
                yield _batch(
                    schema, key, len(rr),
                    [pc.min_element_wise(u, v), pc.max_element_wise(u, v), dx[rr, cc], dy[rr, cc]],
                )

    return run


def _pair_bits(row, same, dist):
    """Bit patterns of both distances of each pair of items of two blocks, which sort like the distances.

    Tile by tile.  Distances are rounded to twelve digits, so that equal ones are ties; pairs whose
    distance is not finite on a side are left out.
    """
    (_, xa, ya), (_, xb, yb) = row["a"], row["b"]
    for ra, rb, diagonal in _tiles(len(xa), len(xb), same):
        d = np.stack([dist(xa[ra], xb[rb], diagonal), dist(ya[ra], yb[rb], diagonal)])
        d = d[:, *np.triu_indices(d.shape[1], 1)] if diagonal else d.reshape(2, -1)
        yield (np.round(d[:, np.isfinite(d).all(0)], 12) + 0.0).view(np.int64)


def rank_histogram(keys, schema, metric, shift, within=None):
    """mapInArrow over block pairs: counts of distances by leading bits, per key, side and task.

    With `within`, only distances whose coarser bin (bits >> within) is one of heavy_x or heavy_y.
    Counts of a key are given out when another key begins, so rows should come sorted by key.
    """
    dist = _distances(metric)

    def inside(bits, heavy):
        coarse = bits >> within
        at = np.minimum(np.searchsorted(heavy, coarse), len(heavy) - 1)
        return bits[heavy[at] == coarse]

    def flush(key, state):
        for side, found in state.items():
            if within is None:
                bins, counts = found.bins()
            else:
                bins, counts = merged(found)
            for s in range(0, len(bins), 100_000):
                yield _batch(schema, key, len(bins[s : s + 100_000]), [side, bins[s : s + 100_000], counts[s : s + 100_000]])

    def merged(parts):
        bins, at = np.unique(np.concatenate([b for b, _ in parts]), return_inverse=True)
        return bins, np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)

    def run(batches):
        last, state, held = None, {}, 0
        for row, same in _blocks(batches):
            key = tuple(row[k] for k in keys)
            if key != last:
                yield from flush(last, state)
                last, state, held = key, {}, 0
            if within is not None and not len(row["heavy_x"]) and not len(row["heavy_y"]):
                continue
            for both in _pair_bits(row, same, dist):
                for side, bits in zip("xy", both):
                    if within is None:
                        state.setdefault(side, _Counts()).add(bits >> shift)
                    elif len(row[f"heavy_{side}"]):
                        part = np.unique(inside(bits, row[f"heavy_{side}"]) >> shift, return_counts=True)
                        state.setdefault(side, []).append(part)
                        held += len(part[0])
                if held > SLICE_DOUBLES:
                    state = {k: [merged(v)] for k, v in state.items()}
                    held = sum(len(v[0][0]) for v in state.values())
                    if held > SLICE_DOUBLES // 2:
                        yield from flush(last, state)
                        state, held = {}, 0
        yield from flush(last, state)

    return run


def _ranker(last, rank, drop):
    """Function from bits to ranks: those of the first `last` that is not smaller.

    A table over the bits without their `drop` lowest answers where all that share it have one rank.
    """
    if len(last) < 1024:
        return lambda bits: rank[np.searchsorted(last, bits)]
    lo, hi = int(last[last > 0].min(initial=last[-1])) >> drop, int(last[-1]) >> drop
    prefix = np.arange(lo, hi + 1)
    first = np.searchsorted(last, prefix << drop)
    alike = first == np.searchsorted(last, ((prefix + 1) << drop) - 1)
    alike[-1] = alike[-1] or first[-1] == len(last) - 1
    table = np.where(alike, rank[np.minimum(first, len(last) - 1)], np.nan)

    def of(bits):
        at = (bits >> drop) - lo
        out = np.where(at < 0, np.nan, table[np.clip(at, 0, len(table) - 1)])
        open_ = np.flatnonzero(np.isnan(out))
        out[open_] = rank[np.searchsorted(last, bits[open_])]
        return out

    return of


def rank_products(keys, schema, metric, shift, drop):
    """mapInArrow over block pairs with the cells of both sides: sum of products of centred ranks."""
    dist = _distances(metric)

    def run(batches):
        for row, same in _blocks(batches):
            total = 0.0
            if len(row["last_x"]):
                rank_x, rank_y = (_ranker(row[f"last_{s}"], row[f"rank_{s}"], drop) for s in "xy")
                for x, y in _pair_bits(row, same, dist):
                    total += float(rank_x(x >> shift) @ rank_y(y >> shift))
            yield _batch(schema, [row[k] for k in keys], 1, [total])

    return run


# -- packed blocks: tiles fit a core's cache, and one product gives their distances ----
NEAR = (64, 1024)  # items against items: half a MB of doubles
COUNTED = (32, 1024)  # the same where bins or ranks are looked up
SAMPLE, POINTS = 64, 8192  # items of a tile of sampled pairs; quantiles kept of a block's sample
DEVIATIONS = 5  # of a sampled rank that the bracket of a median spans on both sides
FINE = 1 << 26
FEW = 128  # items of a group whose bracket holds all distances
HELD = 1 << 22  # distances in a bracket that a task holds
SIDE = ("w", "finite", "f", "g", "points", "m")  # facts of a side of a block


def _directions(v, metric):
    """Vectors whose products give the distances."""
    if metric in ("squared", "euclidean"):
        return v
    if metric == "cosine":
        return v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-8)
    v = v - v.mean(1, keepdims=True)
    with np.errstate(all="ignore"):
        return v / np.linalg.norm(v, axis=1, keepdims=True)


def _factors(a, b, metric, zero=0.0, scale=1.0):
    """Matrices with the product (distance - zero) * scale.  Euclidean distances stay squared, which keeps their order."""
    if metric in ("squared", "euclidean"):
        centre = a.mean(0)
        a, b = a - centre, b - centre
        sq_a, sq_b = (a * a).sum(1)[:, None], (b * b).sum(1)[:, None]
        left = np.hstack([-2 * scale * a, scale * (sq_a - zero), np.full((len(a), 1), scale)])
        return left, np.hstack([b, np.ones((len(b), 1)), sq_b]).T.copy()
    a, b = _directions(a, metric), _directions(b, metric)
    return np.hstack([-scale * a, np.full((len(a), 1), scale * (1 - zero))]), np.hstack([b, np.ones((len(b), 1))]).T.copy()


def _product(left, right, ra, rb, kept):
    """Product of two slices in the buffer `kept`."""
    shape = ra.stop - ra.start, rb.stop - rb.start
    return np.matmul(left[ra], right[:, rb], out=kept[: shape[0] * shape[1]].reshape(shape))


def _fingerprint(v):
    """Two 64-bit sums of hashes of the rows: equal for the same vectors in any order."""
    bits, out = (v + 0.0).view(np.uint64), []
    for seed in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        h = np.full(len(v), seed, np.uint64)
        for j in range(v.shape[1]):
            h ^= bits[:, j]
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = (h ^ (h >> np.uint64(31))) + np.uint64(seed)
        out.append(int(h.sum(dtype=np.uint64).view(np.int64)))
    return out


def _sampled(v, metric, shifts):
    """Quantiles of sampled distances of a block, and the number of those sampled.

    Shuffled tiles of items meet `shifts` other tiles each, so that every item is drawn equally often.
    Small blocks are taken whole.
    """
    n = len(v)
    if n < 2:
        return np.zeros(1), 1
    left, right = _factors(v, v, metric)
    if n <= 2048:
        d = (left @ right)[np.triu_indices(n, 1)]
    else:
        rng = np.random.default_rng(n)
        tiles = np.array_split(rng.permutation(n), n // SAMPLE)
        by = rng.choice(np.arange(1, len(tiles)), shifts, replace=False)
        others = [np.ascontiguousarray(right[:, t]) for t in tiles]
        d = np.concatenate([(left[t] @ others[(k + s) % len(tiles)]).ravel().astype(np.float32) for k, t in enumerate(tiles) for s in by])
    d = np.sort(d.astype(np.float32))
    return np.maximum(d[np.linspace(0, len(d) - 1, POINTS + 1).astype(np.int64)], 0).astype(np.float64), len(d)


def pack_blocks(keys, schema, metric, shifts):
    """mapInArrow over blocks of items: matrices as bytes, a hash of the first, and what is known of both sides of a block.

    Of a side: width, whether all numbers are finite, hashes of its vectors, quantiles of sampled
    distances, and how many were sampled.
    """

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, *sides = batch.column("items")[i].values.flatten()
                n = len(ids)
                out = [*(batch.column(k)[i].as_py() for k in (*keys, "_nb", "_b")), n, ids, ""]
                for column in sides:
                    v = np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)
                    finite = bool(np.isfinite(_directions(v, metric)).all())
                    points, m = _sampled(v, metric, shifts) if finite else (np.zeros(1), 1)
                    out[len(keys) + 4] = out[len(keys) + 4] or md5(v.tobytes(), usedforsecurity=False).hexdigest()
                    out += [v.tobytes(), v.shape[1], finite, *_fingerprint(v), points.tobytes(), m]
                arrays = [
                    pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c).cast(f.type) if isinstance(c, pa.Array) else pa.array([c], f.type)
                    for c, f in zip(out, schema)
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def side_facts(keys, schema, share=None, cells=1):
    """mapInArrow over groups with the facts of their blocks: of both sides the hashes, and a bracket of distances.

    The bracket reaches from the `share` quantile of the samples to that from above; without one, it is
    to hold the lower median of all n * n distances.  Fewer pairs than FINE get up to 16 times the
    `cells`, as what shared ranks do to a correlation falls with the root of the pairs.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n, blocks = sum(b["n"] for b in row["blocks"]), row["blocks"]
                for s in "xy":
                    points = np.sort(np.concatenate([np.frombuffer(b[f"points_{s}"]) for b in blocks]))
                    last, m = len(points) - 1, sum(b[f"m_{s}"] for b in blocks)
                    if share is None:
                        # The n zeros on the diagonal are not sampled.
                        middle, off = (n / 2 - 1) / max(n - 1, 1), DEVIATIONS / 2 / np.sqrt(m) + 2 / POINTS
                        ends = middle - off, middle + off
                    else:
                        ends = share, 1 - share
                    lo = points[max(0, int(np.floor(ends[0] * last)) - 1)] * (1 - 1e-6)
                    hi = points[min(last, int(np.ceil(ends[1] * last)) + 1)] * (1 + 1e-6)
                    if share is None and n <= FEW:
                        lo, hi = 0.0, np.inf
                    hashes = [(sum(b[f"{h}_{s}"] for b in blocks) + 2**63) % 2**64 - 2**63 for h in "fg"]
                    finite = all(b[f"finite_{s}"] for b in blocks)
                    times = np.clip(np.ceil(np.log2(FINE / max(1, n * (n - 1) / 2)) / 2), 0, 4)
                    yield _batch(schema, [row[k] for k in keys], 1, [s, finite, *hashes, lo, hi, cells * 2 ** int(times)])

    return run


def _planes(v):
    """Bytes of ascending integers: their differences, byte by byte of all, which compress well."""
    return np.ascontiguousarray(np.diff(v, prepend=0).view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(b):
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.int64).ravel().cumsum()


def _few_true(mask):
    """Places of the true ones, which are few, looked for eight at a time."""
    whole = len(mask) // 8 * 8
    at = (8 * np.flatnonzero(mask[:whole].view(np.uint64))[:, None] + np.arange(8)).ravel()
    return np.concatenate([at[mask[at]], whole + np.flatnonzero(mask[whole:])])


def near_median(keys, schema):
    """mapInArrow over block pairs of one side: how many squared distances are below a bracket, and those in it.

    Counts are of ordered pairs.  Equal distances are counted once they are many; a task that still
    holds too many gives up and says so.
    """

    def merged(found):
        values, at = np.unique(np.concatenate([v for v, _ in found]), return_inverse=True)
        return [(values, np.bincount(at, np.concatenate([c for _, c in found])).astype(np.int64))]

    def run(batches):
        kept, masks = np.empty(NEAR[0] * NEAR[1]), np.empty((2, NEAR[0] * NEAR[1]), bool)
        for row, same in _blocks(batches):
            (_, a), (_, b) = row["a"], row["b"]
            lo = row["_lo"]
            left, right = _factors(a, b, "squared", lo)
            width = row["_hi"] - lo
            below, found, held = 0, [], 0
            if same and lo > 0:
                below = len(a)
            elif same:
                found = [(np.zeros(1), np.array([len(a)]))]
            for ra, rb, diagonal in _tiles(len(a), len(b), same, NEAR):
                g = _product(left, right, ra, rb, kept)
                g = g[np.triu_indices(len(g), 1)] if diagonal else g.ravel()
                if lo == 0:
                    np.maximum(g, 0.0, out=g)
                    g += 0.0
                under, upto = np.less(g, 0, out=masks[0, : len(g)]), np.less_equal(g, width, out=masks[1, : len(g)])
                below += 2 * np.count_nonzero(under)
                near = g[_few_true(np.logical_xor(under, upto, out=upto))] + lo
                found.append((near, np.full(len(near), 2)))
                held += len(near)
                if held > HELD:
                    found = merged(found)
                    held = len(found[0][0])
                    if held > HELD // 2:
                        break
            over = held > HELD // 2
            if over or not found:
                values, counts = np.zeros(0), b""
            elif all((c == 2).all() for _, c in found):
                # Each is counted in both orders, and that needs no list.
                values, counts = np.sort(np.concatenate([v for v, _ in found])), b""
            else:
                values, counts = merged(found)[0]
                counts = _planes(counts)
            cells = [*(row[k] for k in keys), len(a) if same else 0, int(below), over, _planes(values.view(np.int64)), counts]
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, schema)], schema=schema)

    return run


def pick_median(keys, schema):
    """mapInArrow over what near_median found, sorted by key: the lower median, or NULL where it is not among them."""

    def picked(parts):
        n = sum(p["n"] for p in parts)
        rank = (n * n - 1) // 2 + 1 - sum(p["below"] for p in parts)
        if any(p["over"] for p in parts):
            return None
        values = [_from_planes(p["near"]).view(np.float64) for p in parts]
        counts = [_from_planes(p["counts"]) if p["counts"] else np.full(len(v), 2) for p, v in zip(parts, values)]
        values, counts = np.concatenate(values), np.concatenate(counts)
        if not 1 <= rank <= counts.sum():
            return None
        if (counts == 2).all():
            return float(np.partition(values, (rank - 1) // 2)[(rank - 1) // 2])
        order = np.argsort(values)
        return float(values[order[np.searchsorted(np.cumsum(counts[order]), rank)]])

    def run(batches):
        last, parts = None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if parts and key != last:
                    yield _batch(schema, last, 1, [picked(parts)])
                    parts = []
                last = key
                parts.append(row)
        if parts:
            yield _batch(schema, last, 1, [picked(parts)])

    return run


class _Binned:
    """Bins of the distances of a block pair: number of a distance is the nearest integer to (distance - zero) * scale."""

    def __init__(self, a, b, metric, zero, scale, buffers):
        self.left, self.right = _factors(a, b, metric, zero - 0.5 / scale, scale)  # cut off, not rounded
        self.kept, self.found = buffers
        # No product is larger; one beyond 63 bits would be no integer.
        self.far = np.linalg.norm(self.left, axis=1).max(initial=0) * np.linalg.norm(self.right, axis=0).max(initial=0)

    def of(self, ra, rb, diagonal, clip=None):
        """Those of a tile, of pairs of different items; kept within 0 and `clip` if that is given."""
        g = _product(self.left, self.right, ra, rb, self.kept)
        g = g[np.triu_indices(len(g), 1)] if diagonal else g.ravel()
        if clip is not None:
            np.clip(g, 0, clip, out=g)
        out = self.found[: len(g)]
        np.copyto(out, g, casting="unsafe")
        return out


def _buffers():
    size = COUNTED[0] * COUNTED[1]
    return np.empty(size), np.empty(size, np.int64)


def _scale(lo, hi, cells):
    return (cells - 1) / (hi - lo) if hi > lo else 1.0


def _longest(a, b, metric):
    """No distance is larger."""
    if metric in ("squared", "euclidean"):
        return sum(np.linalg.norm(v - a.mean(0), axis=1).max(initial=0) for v in (a, b)) ** 2 * (1 + 1e-9)
    return 2 + 1e-9


def bin_counts(keys, schema, metric):
    """mapInArrow over block pairs of one side: distances counted in _cells bins from _lo to _hi, and beyond in the outer ones."""

    def run(batches):
        buffers = _buffers()
        for row, same in _blocks(batches):
            (_, a), (_, b) = row["a"], row["b"]
            lo, cells = row["_lo"], row["_cells"]
            scale = _scale(lo, row["_hi"], cells)
            # Bins for all distances, if they are not too many, save bounding each.
            size = _longest(a, b, metric) * scale + 4
            before = int(lo * scale) + 1
            clip = None if size <= 4 * cells else cells - 1
            binned = _Binned(a, b, metric, lo if clip else lo - before / scale, scale, buffers)
            counts = np.zeros(cells if clip else max(before + cells, int(size)), np.int64)
            for ra, rb, diagonal in _tiles(len(a), len(b), same, COUNTED):
                np.add.at(counts, binned.of(ra, rb, diagonal, clip), 1)
            if not clip:
                inner = counts[before : before + cells]
                inner[0] += counts[:before].sum()
                inner[-1] += counts[before + cells :].sum()
                counts = inner
            cells_ = [*(row[k] for k in keys), counts.astype(np.uint32).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells_, schema)], schema=schema)

    return run


def rank_tables(keys, schema, most):
    """mapInArrow over bin_counts, sorted by key: number of pairs, centred mean rank of each bin, and the sum of their squares.

    `ok` says whether sharing ranks within bins takes at most the share `most` of all variance of ranks.
    """

    def table(counts):
        n = int(counts.sum())
        c = counts.astype(np.float64)
        # Singles keep both tables of a block pair in a core's cache; the sum of squares is of what is looked up.
        rank = (np.cumsum(counts) - c / 2 - n / 2).astype(np.float32)
        ok = bool((c**3 - c).sum() <= most * float(n) ** 3)
        return [n, ok, float(c @ rank.astype(np.float64) ** 2), rank.tobytes()]

    def emitted(key, counts):
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip([*key, *table(counts)], schema)], schema=schema)

    def run(batches):
        last, counts = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                key = tuple(batch.column(k)[i].as_py() for k in keys)
                if key != last:
                    if last is not None:
                        yield emitted(last, counts)
                    last, counts = key, 0
                counts = counts + np.frombuffer(batch.column("counts")[i].as_py(), np.uint32).astype(np.int64)
        if last is not None:
            yield emitted(last, counts)

    return run


def rank_dots(keys, schema, metric):
    """mapInArrow over block pairs of groups with the same x, with brackets and rank tables: sums of products of centred ranks."""

    def run(batches):
        buffers, ranks = _buffers(), np.empty(COUNTED[0] * COUNTED[1], np.float32)

        def side(a, b, lo, hi, table):
            table = np.frombuffer(table, np.float32)
            binned = _Binned(a, b, metric, lo, _scale(lo, hi, len(table)), buffers)
            clip = len(table) - 1 if binned.far > 2.0**50 else None

            def of(*tile):
                # Bins beyond the outer ones have the ranks of these.
                bins = binned.of(*tile, clip)
                return np.take(table, bins, out=ranks[: len(bins)], mode="clip").astype(np.float64)

            return of

        for row, same in _blocks(batches):
            (xa, of_a), (xb, of_b) = row["a"], row["b"]
            x = side(xa, xb, row["_lo_x"], row["_hi_x"], row["ranks_x"])
            y = [side(a, b, f["_lo_y"], f["_hi_y"], f["ranks_y"]) for (_, a), (_, b), f in zip(of_a, of_b, row["facts"])]
            totals = np.zeros(len(y))
            for tile in _tiles(len(xa), len(xb), same, COUNTED):
                rx = x(*tile)
                totals += [rx @ of(*tile) for of in y]
            for f, total in zip(row["facts"], totals.tolist()):
                yield _batch(schema, [f["key"][k] for k in keys], 1, [total])

    return run


def whole_rho(keys, schema, metric):
    """mapInArrow over groups of one block: number of pairs and Spearman correlation of both distance matrices."""
    dist = _distances(metric)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(s)[i].as_py()).reshape(batch.column("n")[i].as_py(), -1) for s in "xy")
                upper = np.triu_indices(len(x), 1)
                d = np.stack([dist(v, v, True)[upper] for v in (x, y)])
                d = np.round(d[:, np.isfinite(d).all(0)], 12) + 0.0
                n = d.shape[1]
                if not n:
                    continue
                ranks, norm = [], 1.0
                for v in d:
                    _, at, counts = np.unique(v, return_inverse=True, return_counts=True)
                    rank = np.cumsum(counts) - counts / 2 - n / 2
                    ranks.append(rank[at])
                    norm *= np.sqrt(counts @ (rank * rank))
                rho = float(np.clip(ranks[0] @ ranks[1] / norm, -1, 1)) if n >= 3 and norm > 0 else None
                yield _batch(schema, [batch.column(k)[i].as_py() for k in keys], 1, [n, rho])

    return run


# -- p values --------------------------------------------------------------------------
def _lgamma(x):
    from math import lgamma

    return np.vectorize(lgamma, otypes=[float])(x)


def betainc(a, b, x):
    """Regularized incomplete beta function by its continued fraction (Lentz)."""
    a, b, x = np.broadcast_arrays(
        np.asarray(a, float), np.asarray(b, float), np.asarray(x, float)
    )
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    with np.errstate(all="ignore"):
        front = np.exp(
            _lgamma(p + q) - _lgamma(p) - _lgamma(q)
            + p * np.log(np.maximum(z, tiny)) + q * np.log(np.maximum(1 - z, tiny))
        ) / p
        c = np.ones_like(z)
        d = 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            for num in (
                m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
            ):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
        out = front * h
    out = np.where(z <= 0, 0.0, out)
    return np.where(swap, 1 - out, out)


def correlation_p(r, n):
    """Two-sided p value of a correlation coefficient with n - 2 degrees of freedom."""
    r, n = np.asarray(r, float), np.asarray(n, float)
    df = n - 2
    with np.errstate(all="ignore"):
        p = betainc(np.maximum(df, 1e-9) / 2, 0.5, np.clip(1 - r * r, 0, 1))
    return np.where((df > 0) & np.isfinite(r), p, np.nan)


def correlation_p_series(r, n):
    p = correlation_p(r.to_numpy(float), n.to_numpy(float))
    return pd.Series([None if not np.isfinite(v) else float(v) for v in p])


# -- Unicode ---------------------------------------------------------------------------
NFKD_ROWS = 256  # texts turned into Python strings at once


def nfkd(texts):
    """Compatibility forms of an Arrow array of texts, of which few are Python strings at a time."""
    import unicodedata

    import pyarrow as pa

    parts = []
    for at in range(0, len(texts), NFKD_ROWS):
        rows = texts.slice(at, NFKD_ROWS).to_pylist()
        parts.append(pa.array([None if t is None else unicodedata.normalize("NFKD", t) for t in rows], pa.string()))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def norm_token(text):
    """The rule of text.norm_token for a single text."""
    import re

    return re.sub("[^a-z0-9]+", "_", text.casefold()).strip("_")
