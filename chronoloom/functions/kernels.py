"""Elastic distances of many pairs at once, in numpy. Arrays are (pairs, time) or (pairs, time, variables).

Dynamic programmes run over anti-diagonals: cells of one don't depend on each other, so a step is an operation on
(pairs, diagonal) arrays and only two earlier diagonals are kept.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

NEVER = -10000.0  # fixed value: the logarithm of 0 in the alignment kernel


def _band(nx: int, ny: int, window: int | None) -> np.ndarray:
    """Cells of the slanted band; all without a window."""
    if window is None:
        return np.ones((nx, ny), bool)
    i = np.arange(1, nx + 1)[:, None] * ny / nx
    j = np.arange(1, ny + 1)[None, :]
    return (j >= np.ceil(i - window)) & (j <= np.floor(i + window))


def _local(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, power: int) -> np.ndarray:
    d = np.abs(x[:, i] - y[:, j])
    d = d * d if power == 2 else d
    return d.sum(2) if d.ndim == 3 else d


LOOK = 8  # anti-diagonals between two looks at which pairs go on


def _sweep(x, y, first, combine, outside, allowed, power, limit=None):
    """Values of the last cell; combine(cost, diag, left, up) with `outside` for what doesn't exist or isn't allowed. limit: costs that only grow are given up (infinite) where
    all cells of two diagonals, one of which every path crosses, lie above a pair's limit."""
    b, nx, ny = len(x), x.shape[1], y.shape[1]
    if limit is not None:
        live, last = np.arange(b), np.full(b, np.inf)
    one = np.full((b, nx + 1), outside)  # index i + 1: the diagonal before
    two = one.copy()
    for d in range(nx + ny - 1):
        i = np.arange(max(0, d - ny + 1), min(nx, d + 1))
        j = d - i
        cost = _local(x, y, i, j, power)
        new = np.full((len(x), nx + 1), outside)
        value = first(cost) if d == 0 else combine(cost, two[:, i], one[:, i + 1], one[:, i], i, j)
        new[:, i + 1] = np.where(allowed[i, j], value, outside)
        two, one = one, new
        if limit is not None and d % LOOK == LOOK - 1:
            on = np.minimum(one.min(1), two.min(1)) <= limit[live]
            if not on.all():
                x, y, one, two, live = x[on], y[on], one[on], two[on], live[on]
                if not len(live):
                    return last
    if limit is not None:
        last[live] = one[:, nx]
        return last
    return one[:, nx]


def _asymmetric(x: np.ndarray, y: np.ndarray, window: int | None, power: int, open_begin: bool, open_end: bool) -> np.ndarray:
    """Each point of x in turn meets the same point of y, the next or the one after; a row depends on the row before alone."""
    allowed, j = _band(x.shape[1], y.shape[1], window), np.arange(y.shape[1])
    row = _local(x, y, np.zeros_like(j), j, power)
    row[:, ~allowed[0] | ((j > 0) & (not open_begin))] = np.inf
    for i in range(1, x.shape[1]):
        before = np.pad(row, ((0, 0), (2, 0)), constant_values=np.inf)
        row = np.minimum(np.minimum(row, before[:, 1:-1]), before[:, :-2]) + _local(x, y, np.full_like(j, i), j, power)
        row[:, ~allowed[i]] = np.inf
    return row.min(1) if open_end else row[:, -1]


# Step patterns with slope constraints. For each way into a cell: how far back it begins in x and y, and the weights of the local
# costs that it passes, by how far back they lie.
SLOPES = {
    "symmetricP1": [(1, 2, [(0, 1, 2.0), (0, 0, 1.0)]), (1, 1, [(0, 0, 2.0)]), (2, 1, [(1, 0, 2.0), (0, 0, 1.0)])],
    "asymmetricP1": [(1, 2, [(0, 1, 0.5), (0, 0, 0.5)]), (1, 1, [(0, 0, 1.0)]), (2, 1, [(1, 0, 1.0), (0, 0, 1.0)])],
    "symmetricP2": [(2, 3, [(1, 2, 2.0), (0, 1, 2.0), (0, 0, 1.0)]), (1, 1, [(0, 0, 2.0)]), (3, 2, [(2, 1, 2.0), (1, 0, 2.0), (0, 0, 1.0)])],
    "asymmetricP2": [(2, 3, [(1, 2, 2 / 3), (0, 1, 2 / 3), (0, 0, 2 / 3)]), (1, 1, [(0, 0, 1.0)]), (3, 2, [(2, 1, 1.0), (1, 0, 1.0), (0, 0, 1.0)])],
    "symmetricP05": [(1, 3, [(0, 2, 2.0), (0, 1, 1.0), (0, 0, 1.0)]), (1, 2, [(0, 1, 2.0), (0, 0, 1.0)]), (1, 1, [(0, 0, 2.0)]), (2, 1, [(1, 0, 2.0), (0, 0, 1.0)]), (3, 1, [(2, 0, 2.0), (1, 0, 1.0), (0, 0, 1.0)])],
    "asymmetricP05": [(1, 3, [(0, 2, 1 / 3), (0, 1, 1 / 3), (0, 0, 1 / 3)]), (1, 2, [(0, 1, 0.5), (0, 0, 0.5)]), (1, 1, [(0, 0, 1.0)]), (2, 1, [(1, 0, 1.0), (0, 0, 1.0)]), (3, 1, [(2, 0, 1.0), (1, 0, 1.0), (0, 0, 1.0)])],
    "asymmetricP0": [(0, 1, []), (1, 1, [(0, 0, 1.0)]), (1, 0, [(0, 0, 1.0)])],
    "mori2006": [(2, 1, [(1, 0, 2.0), (0, 0, 1.0)]), (1, 1, [(0, 0, 3.0)]), (1, 2, [(0, 1, 3.0), (0, 0, 3.0)])],
    "rigid": [(1, 1, [(0, 0, 1.0)])],
}
# The classic types of local constraints as the steps in x and y of each way into a cell.
TYPES = {
    "I": [[(1, 1), (1, 0)], [(1, 1)], [(1, 1), (0, 1)]],
    "II": [[(2, 1)], [(1, 1)], [(1, 2)]],
    "III": [[(1, 2)], [(1, 1)], [(1, 1), (1, 0)], [(1, 2), (1, 0)]],
    "IV": [[(1, up), *[(1, 0)] * on] for on in range(3) for up in (1, 2, 3)],
}
#: Weight of a step of u points in x and v in y.
LAWS = {"a": min, "b": max, "c": lambda u, v: u, "d": lambda u, v: u + v}


def _way(steps: list[tuple[int, int]], law: str, smooth: bool) -> tuple:
    """A way into a cell in the form of SLOPES; smooth spreads its weight evenly over its steps."""
    weights = [float(LAWS[law](u, v)) for u, v in steps]
    weights = [sum(weights) / len(weights)] * len(weights) if smooth else weights
    rest = [(sum(u for u, _ in steps[n:]), sum(v for _, v in steps[n:])) for n in range(len(steps) + 1)]
    return *rest[0], [(u, v, w) for (u, v), w in zip(rest[1:], weights, strict=True)]


SLOPES |= {f"type{t}{law}{'s' * smooth}": [_way(steps, law, smooth) for steps in ways] for t, ways in TYPES.items() for law in LAWS for smooth in (False, True)}
#: How often the lengths of x and y go into the weight that all paths of a step pattern have (those of mori2006 thrice as much); patterns whose paths weigh differently aren't there.
PATH_WEIGHT = {"symmetric2": (1, 1), "asymmetric": (1, 0), "mori2006": (0, 1), "rigid": (1, 0)}
PATH_WEIGHT |= {s: (1, 1) for s in SLOPES if s.startswith("symmetric") or s.rstrip("s").endswith("d") and s != "rigid"}
PATH_WEIGHT |= {s: (1, 0) for s in SLOPES if s.startswith("asymmetric") or s.rstrip("s").endswith("c")}


def _sloped(x: np.ndarray, y: np.ndarray, window: int | None, power: int, ways: list) -> np.ndarray:
    """Rows of cells from those of up to three points before."""
    allowed, j, deep = _band(x.shape[1], y.shape[1], window), np.arange(y.shape[1]), 3
    pad = lambda a, fill: np.pad(a, ((0, 0), (deep, 0)), constant_values=fill)
    costs, rows = [], []
    for i in range(x.shape[1]):
        costs.append(pad(_local(x, y, np.full_like(j, i), j, power), 0.0))
        row = np.full((len(x), len(j)), np.inf)
        if i == 0:
            row[:, 0] = costs[0][:, deep]
        for di, dj, terms in ways:
            if 0 < di <= i:
                value = rows[-di][:, deep - dj + j].copy()
                for oi, oj, weight in terms:
                    value += weight * costs[-1 - oi][:, deep - oj + j]
                row = np.minimum(row, value)
        row[:, ~allowed[i]] = np.inf
        if (0, 1, []) in ways:  # along y for free
            row = np.minimum.accumulate(row, 1)
            row[:, ~allowed[i]] = np.inf
        rows.append(pad(row, np.inf))
        costs, rows = costs[-deep:], rows[-deep:]
    return rows[-1][:, -1]


def dtw(x: np.ndarray, y: np.ndarray, window: int | None = None, norm: str = "L1", step: str = "symmetric2", normalize: bool = False, root: bool = True, open_begin: bool = False, open_end: bool = False, limit: np.ndarray | None = None) -> np.ndarray:
    """Dynamic time warping. L2 costs are squared and the root is taken at the end; root=False leaves it out (L2 only).

    Paths of symmetricP1, symmetricP2, asymmetricP1 and asymmetricP2 have slopes between 1/2 and 2, or 2/3 and 3/2; series whose lengths don't allow that are at an
    infinite distance; those of symmetricP05 and asymmetricP05 are between 1/3 and 3, symmetricP0 is symmetric2, asymmetricP0 moves along y for free, rigid along the diagonal alone.
    typeIa to typeIVd, with an s if smoothed, are the ways of TYPES with weights by LAWS. step="asymmetric" counts each point of x once; with it the path may begin (open_begin) or end (open_end) anywhere in y.
    Normalized are patterns whose paths have one weight (PATH_WEIGHT): symmetric ones (but symmetric1) by both lengths, asymmetric ones by the length of x, mori2006 by that of y. limit: a distance for each pair, beyond which it may
    be given up as infinite (symmetric1 and symmetric2, not normalized).
    """
    step = "symmetric2" if step == "symmetricP0" else step
    if normalize and step not in PATH_WEIGHT:
        raise ValueError(f"Paths of {step} have no common weight to normalize by.")
    if step != "asymmetric" and (open_begin or open_end):
        raise ValueError("Open ends need the asymmetric step.")
    power = {"L1": 1, "L2": 2}[norm]
    if step == "asymmetric":
        out = _asymmetric(x, y, window, power, open_begin, open_end)
    elif step in SLOPES:
        out = _sloped(x, y, window, power, SLOPES[step])
    else:
        s = {"symmetric1": 1.0, "symmetric2": 2.0}[step]
        combine = lambda c, diag, left, up, i, j: np.minimum(diag + s * c, np.minimum(left, up) + c)
        most = None if limit is None else np.asarray(limit, float) ** (2 if norm == "L2" and root else 1) * (1 + 1e-12)
        out = _sweep(x, y, lambda c: c, combine, np.inf, _band(x.shape[1], y.shape[1], window), power, most)
    out = np.sqrt(out) if norm == "L2" and root else out
    return out / np.dot(PATH_WEIGHT[step], (x.shape[1], y.shape[1])) if normalize else out


def dtw_paths(x: np.ndarray, y: np.ndarray, window: int | None = None, norm: str = "L1", step: str = "symmetric2") -> tuple[np.ndarray, list[np.ndarray]]:
    """Distances and warping paths, arrays of 0-based (i, j) from the start; ties prefer the diagonal, then j - 1. A pair that the band keeps apart is at an infinite distance and has an empty path."""
    s, power = {"symmetric1": 1.0, "symmetric2": 2.0}[step], {"L1": 1, "L2": 2}[norm]
    b, nx, ny = len(x), x.shape[1], y.shape[1]
    allowed = _band(nx, ny, window)
    d = np.full((b, nx + 1, ny + 1), np.inf)
    move = np.zeros((b, nx, ny), np.int8)
    for k in range(nx + ny - 1):
        i = np.arange(max(0, k - ny + 1), min(nx, k + 1))
        j = k - i
        c = _local(x, y, i, j, power)
        if k == 0:
            d[:, 1, 1] = c[:, 0]
            continue
        options = np.stack([d[:, i, j] + s * c, d[:, i + 1, j] + c, d[:, i, j + 1] + c])
        best = options.argmin(0)
        move[:, i, j] = best
        d[:, i + 1, j + 1] = np.where(allowed[i, j], options.min(0), np.inf)
    dist = d[:, nx, ny]
    # All pairs walk back in step; steps[k] has each pair's place after k moves.
    at = np.tile([nx - 1, ny - 1], (b, 1))
    steps, rows = [at.copy()], np.arange(b)
    for _ in range(nx + ny - 2):
        m = move[rows, at[:, 0], at[:, 1]]
        at = np.maximum(at - np.stack([m != 1, m != 2], 1), 0)
        steps.append(at.copy())
    steps = np.array(steps)
    n = 1 + (steps.sum(2) > 0).sum(0)
    paths = [steps[: n[p], p][::-1] if np.isfinite(dist[p]) else np.zeros((0, 2), int) for p in range(b)]
    return np.sqrt(dist) if norm == "L2" else dist, paths


def _softmin(a, b, c, gamma):
    low = np.minimum(np.minimum(a, b), c)
    low = np.where(np.isfinite(low), low, 0)
    return low - gamma * np.log(np.exp((low - a) / gamma) + np.exp((low - b) / gamma) + np.exp((low - c) / gamma))


def sdtw(x: np.ndarray, y: np.ndarray, gamma: float = 0.01) -> np.ndarray:
    """Soft-DTW with squared costs; may be negative, and isn't 0 for equal series."""
    if gamma <= 0:
        raise ValueError("gamma must be positive.")
    combine = lambda c, diag, left, up, i, j: c + _softmin(diag, left, up, gamma)
    with np.errstate(over="ignore"):
        return _sweep(x, y, lambda c: c, combine, np.inf, np.ones((x.shape[1], y.shape[1]), bool), 2)


def sdtw_gradients(z: np.ndarray, x: np.ndarray, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """Soft-DTW of z (time[, variables]) with each of x (series, time[, variables]), and the gradients by z: both passes by anti-diagonals."""
    if gamma <= 0:
        raise ValueError("gamma must be positive.")
    shape = z.shape
    z, x = z.reshape(len(z), -1), x.reshape(len(x), x.shape[1], -1)
    b, n, m = len(x), len(z), x.shape[1]
    cost = np.zeros((b, n + 2, m + 2))
    cost[:, 1 : n + 1, 1 : m + 1] = ((z[None, :, None] - x[:, None]) ** 2).sum(3)
    r = np.full((b, n + 2, m + 2), np.inf)
    r[:, 0, 0] = 0
    places = [np.arange(max(1, k - m), min(n, k - 1) + 1) for k in range(2, n + m + 1)]  # i of each anti-diagonal, j = k - i
    with np.errstate(over="ignore"):
        for k, i in enumerate(places, 2):
            j = k - i
            r[:, i, j] = cost[:, i, j] + _softmin(r[:, i - 1, j - 1], r[:, i, j - 1], r[:, i - 1, j], gamma)
    value = r[:, n, m].copy()
    r[:, :, m + 1] = r[:, n + 1, :] = -np.inf
    r[:, n + 1, m + 1] = value
    e = np.zeros((b, n + 2, m + 2))
    e[:, n + 1, m + 1] = 1
    for k, i in reversed(list(enumerate(places, 2))):
        j = k - i
        e[:, i, j] = sum(np.exp((r[:, p, q] - r[:, i, j] - cost[:, p, q]) / gamma) * e[:, p, q] for p, q in ((i + 1, j), (i, j + 1), (i + 1, j + 1)))
    e = e[:, 1 : n + 1, 1 : m + 1]
    return value, (2 * (e.sum(2)[:, :, None] * z - e @ x)).reshape(b, *shape)


def log_gak(x: np.ndarray, y: np.ndarray, sigma: float, window: int | None = None) -> np.ndarray:
    """Logarithm of the triangular global alignment kernel."""
    nx, ny, t = x.shape[1], y.shape[1], window or 0
    if t and abs(nx - ny) > t:
        return np.full(len(x), -np.inf)
    gap = np.abs(np.arange(nx)[:, None] - np.arange(ny)[None])
    weight = np.where(gap < t, np.log(np.maximum(1 - gap / t, 1e-300)), NEVER) if t else np.zeros((nx, ny))
    allowed = weight > NEVER

    def kernel(c, i, j):
        g = weight[i, j] - c / (2 * sigma * sigma)
        return g - np.log(2 - np.exp(g))

    def combine(c, diag, left, up, i, j):
        top = np.maximum(np.maximum(diag, left), up)
        total = top + np.log(np.exp(diag - top) + np.exp(left - top) + np.exp(up - top))
        return np.where(top > NEVER, total, NEVER) + kernel(c, i, j)

    zero = np.zeros(1, int)
    return _sweep(x, y, lambda c: kernel(c, zero, zero), combine, NEVER, allowed, 2)


def gak_self(x: np.ndarray, other: int, sigma: float, window: int | None = None) -> dict[str, np.ndarray]:
    return {"own": log_gak(x, x, sigma, window)}


def gak(x: np.ndarray, y: np.ndarray, sigma: float, window: int | None = None, x_own: np.ndarray | None = None, y_own: np.ndarray | None = None) -> np.ndarray:
    """1 - exp(L(x, y) - (L(x, x) + L(y, y)) / 2) of the logarithms of the kernel; each series' own term may be given."""
    x_own, y_own = (gak_self(v, 0, sigma, window)["own"] if own is None else own for v, own in ((x, x_own), (y, y_own)))
    return 1 - np.exp(log_gak(x, y, sigma, window) - (x_own + y_own) / 2)


def zscores(x: np.ndarray) -> np.ndarray:
    """Rows of series by their own mean and sample deviation; a constant one gives zeros."""
    sd = x.std(1, ddof=1, keepdims=True) if x.shape[1] > 1 else np.zeros((len(x), 1))
    return np.where(sd > 0, (x - x.mean(1, keepdims=True)) / np.where(sd > 0, sd, 1), 0.0)


def spectrum(x: np.ndarray, other: int, znorm: bool = False) -> dict[str, np.ndarray]:
    """Transforms of rows of series that meet series of the length `other`, and their norms."""
    x = zscores(x) if znorm else x
    size = 1 << max(x.shape[1] + other - 2, 1).bit_length()
    return {"spectrum": np.fft.rfft(x, size), "norm": np.linalg.norm(x, axis=1)}


def ncc(x: np.ndarray, y: np.ndarray, znorm: bool = False, **known: np.ndarray) -> np.ndarray:
    """Cross-correlations at lags -(ny - 1)..nx - 1 over the product of the norms; 0 norms give 0. known: x_ and y_ parts of spectrum()."""
    nx, ny = x.shape[1], y.shape[1]
    if not known:
        known = {f"{s}_{k}": v for s, a, b in (("x", x, y), ("y", y, x)) for k, v in spectrum(a, b.shape[1], znorm).items()}
    size = 2 * (known["x_spectrum"].shape[1] - 1)
    c = np.fft.irfft(known["x_spectrum"] * np.conj(known["y_spectrum"]), size)
    c = np.hstack([c[:, size - ny + 1 :], c[:, :nx]]) if ny > 1 else c[:, :nx]
    norm = known["x_norm"] * known["y_norm"]
    return np.where(norm[:, None] > 0, c / np.maximum(norm, 1e-300)[:, None], 0.0)


def sbd(x: np.ndarray, y: np.ndarray, znorm: bool = False, **known: np.ndarray) -> np.ndarray:
    """1 - the greatest normalized cross-correlation, within [0, 2]; 1 if either norm is 0. znorm: of z-scored series."""
    return 1 - ncc(x, y, znorm, **known).max(1)


def sbd_shifts(x: np.ndarray, y: np.ndarray, znorm: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distances of one series x to rows of series, and those rows shifted to their best lags, cut or filled with zeros to x's length."""
    c = ncc(x[None], y, znorm)
    at = np.arange(len(x)) - (c.argmax(1) - (y.shape[1] - 1))[:, None]
    inside = (at >= 0) & (at < y.shape[1])
    return 1 - c.max(1), np.where(inside, np.take_along_axis(y, np.clip(at, 0, y.shape[1] - 1), 1), 0.0)


def sbd_shift(x: np.ndarray, y: np.ndarray, znorm: bool = False) -> tuple[float, np.ndarray]:
    """The same of one pair."""
    d, moved = sbd_shifts(x, y[None], znorm)
    return float(d[0]), moved[0]


def envelope(x: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value within `window` points to either side, for rows of series: any 2 window + 1 points in a row are the end of one chunk of so many and the
    beginning of the next, so minima from either end of the chunks give all of them in time that doesn't depend on the window."""
    window = min(window, x.shape[1])
    wide, n = 2 * window + 1, x.shape[1]

    def least(v: np.ndarray) -> np.ndarray:
        padded = np.pad(v, ((0, 0), (window, window + (-(n + 2 * window)) % wide)), constant_values=np.inf)
        chunks = padded.reshape(len(v), -1, wide)
        begun = np.minimum.accumulate(chunks, axis=2).reshape(len(v), -1)
        ending = np.minimum.accumulate(chunks[:, :, ::-1], axis=2)[:, :, ::-1].reshape(len(v), -1)
        return np.minimum(ending[:, :n], begun[:, wide - 1 : wide - 1 + n])

    return least(x), -least(-x)


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _added(x.T, y.T, 1)  # in order of time, as for two stacks, so that ties are the same


def euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(_added(x.T, y.T, 2))


def _excess(x, low, up, norm):
    e = np.maximum(np.maximum(x - up, low - x), 0)
    return e.sum(1) if norm == "L1" else (e * e).sum(1)


def envelopes(x: np.ndarray, other: int, window: int, norm: str = "L1", force_symmetry: bool = False) -> dict[str, np.ndarray]:
    low, up = envelope(x, window)
    return {"low": low, "up": up}


def _sides(x, y, window, known):
    """Both series with their envelopes: given, or computed."""
    if not known:
        known = {f"{s}_{k}": v for s, a in (("x", x), ("y", y)) for k, v in envelopes(a, 0, window).items()}
    return (x, known.get("x_low"), known.get("x_up")), (y, known["y_low"], known["y_up"])


def lb_keogh(x: np.ndarray, y: np.ndarray, window: int, norm: str = "L1", force_symmetry: bool = False, **known: np.ndarray) -> np.ndarray:
    """How far x lies outside y's envelope; force_symmetry: the greater of both directions. known: y_low and y_up (and x's) from envelopes()."""
    p, q = _sides(x, y, window, known)
    out = _excess(x, *q[1:], norm)
    out = np.maximum(out, _excess(y, *p[1:], norm)) if force_symmetry else out
    return out if norm == "L1" else np.sqrt(out)


def lb_improved(x: np.ndarray, y: np.ndarray, window: int, norm: str = "L1", force_symmetry: bool = False, **known: np.ndarray) -> np.ndarray:
    """lb_keogh plus how far y lies outside the envelope of x clamped to y's envelope."""
    p, q = _sides(x, y, window, known)

    def one(p, q):
        return _excess(p[0], *q[1:], norm) + _excess(q[0], *envelope(np.clip(p[0], *q[1:]), window), norm)

    out = np.maximum(one(p, q), one(q, p)) if force_symmetry else one(p, q)
    return out if norm == "L1" else np.sqrt(out)


# Kernels of every x with every y of two stacks of series of one length each, where the others take stacked pairs: a step is an operation of a point of x and one of y on a tile
# of the result, so nothing is gathered for a pair and a tile stays in the processor's cache.
TILE, LONG, MANY_PAIRS, PRODUCTS = (64, 256), 1 << 14, 1 << 11, 1 << 16  # fewer pairs than MANY_PAIRS are stacked sooner


def _tiles(f: Callable, x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """f(x, y) over tiles: x and y are what is known of either side, series last."""
    m, n = x[0].shape[-1], y[0].shape[-1]
    out = np.empty((m, n))
    high = TILE[0] * TILE[1] // max(1, min(n, TILE[1]))  # of few columns, as prototypes are, a tile is as large by more rows
    for a in range(0, m, high):
        rows = [v[..., a : a + high, None] for v in x]
        for b in range(0, n, TILE[1]):
            out[a : a + high, b : b + TILE[1]] = f(rows, [v[..., None, b : b + TILE[1]] for v in y])
    return out


def _last(v: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.moveaxis(v, 0, -1))


def _added(x: np.ndarray, y: np.ndarray, power: int) -> np.ndarray:
    """Sums over the first axis of absolute or squared differences."""
    e = np.empty(np.broadcast_shapes(x.shape[1:], y.shape[1:]))
    out = np.zeros_like(e)
    for u, v in zip(x, y, strict=True):
        np.subtract(u, v, out=e)
        out += np.multiply(e, e, out=e) if power == 2 else np.abs(e, out=e)
    return out


def manhattan_outer(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _tiles(lambda u, v: _added(u[0], v[0], 1), [_last(x)], [_last(y)])


def euclidean_outer(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(_tiles(lambda u, v: _added(u[0], v[0], 2), [_last(x)], [_last(y)]))


NEAR = (1e-3, 0.05)  # share of the norms below which a product of matrices would lose digits; share of such pairs from which on all are computed otherwise


def euclidean_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """euclidean_outer() by a product of matrices, to some 12 digits: pairs that lie too near for that (or aren't finite) are computed by their differences."""
    p, q = (np.einsum("ij,ij->i", v, v) for v in (x, y))
    d = x @ y.T
    d *= -2
    d += p[:, None]
    d += q[None, :]
    near = ~(d >= NEAR[0] * (p.max(initial=0) + q.max(initial=0)))
    n = np.count_nonzero(near)
    if n > NEAR[1] * near.size:
        return euclidean_outer(x, y)
    if n:
        d[near] = 0
    np.sqrt(d, out=d)
    if n:
        i, j = np.nonzero(near)
        d[i, j] = euclidean(x[i], y[j])
    return d


def _dtw_rows(x: np.ndarray, y: np.ndarray, allowed: np.ndarray, power: int, twice: bool, far: float = np.inf, room: dict | None = None) -> np.ndarray:
    """The last cell, of any type of numbers; x and y time first, far stands for infinity. Two rows of cells, within the band alone. A minimum is taken before the cost is added, which gives the same sums but
    in doubles for twice the cost of a diagonal, as those are rounded. room: keeps the rows' memory from one tile to the next of its shape."""
    early, ny, shape = not (twice and x.dtype == float), len(y), (x.shape[-2], y.shape[-1])
    room = {} if room is None else room
    if shape not in room:
        room[shape] = [np.empty((n, *shape), x.dtype) for n in (ny + 1, ny + 1, 2)]
    old, new, (c, e) = room[shape]
    ends = [cells[-1] + 2 if len(cells := np.flatnonzero(row)) else 0 for row in allowed] + [ny + 1]  # what a row and the next one look at, at last the last cell
    old[: max(ends[0], 1)] = far

    def local(u: np.ndarray, v: np.ndarray, out: np.ndarray) -> None:
        np.subtract(u, v, out=out)
        np.multiply(out, out, out=out) if power == 2 else np.abs(out, out=out)

    for i in range(len(x)):
        cells = np.flatnonzero(allowed[i])
        if not len(cells):
            return np.full(shape, far, x.dtype)
        new[cells[0]] = far
        for j in cells:
            if x.ndim == 4:
                local(x[i, 0], y[j, 0], c)
                for v in range(1, x.shape[1]):
                    local(x[i, v], y[j, v], e)
                    np.add(c, e, out=c)
            else:
                local(x[i], y[j], c)
            cell = new[j + 1]
            if i == j == 0:
                np.copyto(cell, c)
                continue
            np.minimum(old[j + 1], new[j], out=cell)
            if early:
                np.minimum(cell, np.add(old[j], c, out=e) if twice else old[j], out=cell)
            np.add(cell, c, out=cell)
            if not early:
                np.add(c, c, out=e)
                np.minimum(cell, np.add(e, old[j], out=e), out=cell)
        new[ends[i] : max(ends[i : i + 2])] = far
        old, new = new, old
    return old[ny].copy()


def _whole(x: np.ndarray, y: np.ndarray, power: int) -> tuple[list[np.ndarray], int] | None:
    """Both stacks in the narrowest integers that hold every sum of a path, and a number beyond all of them, if all values are whole numbers: sums are exact so, as in doubles."""
    if not all(len(v) and np.isfinite(v).all() and (np.rint(v) == v).all() for v in (x, y)):
        return None
    low, high = np.minimum(x.min((0, 1)), y.min((0, 1))), np.maximum(x.max((0, 1)), y.max((0, 1)))
    cost = float(((high - low) ** power).sum())
    far = (x.shape[1] + y.shape[1]) * cost + 1
    for kind in (np.int16, np.int32):
        if 2 * far + 2 * cost <= np.iinfo(kind).max:  # what doesn't exist grows by costs as well
            return [(v - low).astype(kind) for v in (x, y)], int(far)
    return None


def dtw_outer(x: np.ndarray, y: np.ndarray, window: int | None = None, norm: str = "L1", step: str = "symmetric2", normalize: bool = False, root: bool = True) -> np.ndarray:
    """dtw() with symmetric1 or symmetric2."""
    allowed, power, twice = _band(x.shape[1], y.shape[1], window), {"L1": 1, "L2": 2}[norm], step == "symmetric2"
    last = lambda a: [np.ascontiguousarray(np.moveaxis(a, 0, -1))]
    whole, room = _whole(x, y, power), {}
    if whole:
        (u, v), far = map(last, whole[0]), whole[1]
        out = _tiles(lambda p, q: _dtw_rows(p[0], q[0], allowed, power, twice, far, room), u, v)
        out[out >= far] = np.inf
    else:
        out = _tiles(lambda p, q: _dtw_rows(p[0], q[0], allowed, power, twice, np.inf, room), last(x), last(y))
    out = np.sqrt(out) if norm == "L2" and root else out
    return out / np.dot(PATH_WEIGHT[step], (x.shape[1], y.shape[1])) if normalize else out


def dtw_single(x: np.ndarray, y: np.ndarray, window: int | None = None, step: str = "symmetric2", power: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Sums of dtw() of every x with every y of one variable, by absolute or squared differences, in single precision, and how far each may lie off: of sums of costs that aren't negative an operation
    adds a unit of rounding in proportion, and each cost is off by that of its two values."""
    allowed, room = _band(x.shape[1], y.shape[1], window), {}
    u, v = ([np.ascontiguousarray(a.T, np.float32)] for a in (x, y))
    out = _tiles(lambda p, q: _dtw_rows(p[0], q[0], allowed, power, step == "symmetric2", np.inf, room), u, v)
    most = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0))
    return out, np.finfo(np.float32).eps * 2 * (x.shape[1] + y.shape[1] + 4) * (out + 4 * most if power == 1 else out + 16 * most * most)


def dtw_banded(x: np.ndarray, y: np.ndarray, window: int | None = None, norm: str = "L1", step: str = "symmetric2", most: int = 1 << 14) -> np.ndarray:
    """dtw() with symmetric1 or symmetric2 of stacked pairs of one variable by rows of cells, within the band alone."""
    allowed, power, out, room = _band(x.shape[1], y.shape[1], window), {"L1": 1, "L2": 2}[norm], np.empty(len(x)), {}
    for at in range(0, len(x), most):
        u, v = (np.ascontiguousarray(a[at : at + most].T)[..., None] for a in (x, y))
        out[at : at + most] = _dtw_rows(u, v, allowed, power, step == "symmetric2", np.inf, room)[:, 0]
    return np.sqrt(out) if norm == "L2" else out


def sbd_outer(x: np.ndarray, y: np.ndarray, znorm: bool = False) -> np.ndarray:
    """sbd() by a product of matrices for each lag; of long series by their transforms."""
    nx, ny = x.shape[1], y.shape[1]
    if nx * ny > LONG:
        known = [spectrum(v, n, znorm) for v, n in ((x, ny), (y, nx))]
        own = {f"y_{k}": v for k, v in known[1].items()}
        return np.stack([sbd(u[None], y, znorm, x_spectrum=s[None], x_norm=n, **own) for u, s, n in zip(x, known[0]["spectrum"], known[0]["norm"], strict=True)])
    x, y = (zscores(v) if znorm else v for v in (x, y))
    most, turned, high_rows = np.full((len(x), len(y)), -np.inf), np.ascontiguousarray(y.T), max(1, PRODUCTS // max(1, len(y)))
    room = np.empty((min(high_rows, len(x)), len(y)))
    for at in range(0, len(x), high_rows):  # so many rows that sums and products stay in the processor's cache
        u, best = x[at : at + high_rows], most[at : at + high_rows]
        c = room[: len(u)]
        for lag in range(1 - ny, nx):
            low, high = max(0, lag), min(nx, ny + lag)
            np.matmul(u[:, low:high], turned[low - lag : high - lag], out=c)
            np.maximum(best, c, out=best)
    norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None]
    return 1 - np.where(norm > 0, most / np.maximum(norm, 1e-300), 0.0)


def _both_sides(x: np.ndarray, y: np.ndarray, window: int, one: Callable, norm: str, force_symmetry: bool) -> np.ndarray:
    """one(x, y, y's envelope) of all pairs, with force_symmetry the greater of both directions."""
    u, v = ([_last(a), *map(_last, envelope(a, window))] for a in (x, y))
    out = _tiles(lambda p, q: np.maximum(one(p[0], *q), one(q[0], *p)) if force_symmetry else one(p[0], *q), u, v)
    return out if norm == "L1" else np.sqrt(out)


def lb_keogh_outer(x: np.ndarray, y: np.ndarray, window: int, norm: str = "L1", force_symmetry: bool = False) -> np.ndarray:
    power = 1 if norm == "L1" else 2
    return _both_sides(x, y, window, lambda u, v, low, up: _added(np.broadcast_to(u, np.broadcast_shapes(u.shape, v.shape)), np.clip(u, low, up), power), norm, force_symmetry)


def lb_improved_outer(x: np.ndarray, y: np.ndarray, window: int, norm: str = "L1", force_symmetry: bool = False) -> np.ndarray:
    power, n = 1 if norm == "L1" else 2, x.shape[1]
    window = min(window, n)
    wide = 2 * window + 1

    def least(h: np.ndarray) -> np.ndarray:
        """Of so many points in a row, by doubling."""
        m = np.full((n + 2 * window, *h.shape[1:]), np.inf)
        m[window : window + n] = h
        span = 1
        while span < wide:
            step = min(span, wide - span)
            m = np.minimum(m[: len(m) - step], m[step:])
            span += step
        return m

    def one(u: np.ndarray, v: np.ndarray, low: np.ndarray, up: np.ndarray) -> np.ndarray:
        h = np.clip(u, low, up)
        return _added(np.broadcast_to(u, h.shape), h, power) + _added(np.broadcast_to(v, h.shape), np.clip(v, least(h), -least(-h)), power)

    return _both_sides(x, y, window, one, norm, force_symmetry)


def memberships(d: np.ndarray, fuzziness: float = 2.0) -> np.ndarray:
    """Of rows of distances to some centroids: 1 / sum_c (d / d_c) ** (2 / (m - 1)); a series at centroids belongs to them alone."""
    at = d == 0
    with np.errstate(divide="ignore", invalid="ignore"):
        inverse = np.where(at, 0, d ** (-2.0 / (fuzziness - 1)))
        soft = inverse / inverse.sum(1, keepdims=True)
    return np.where(at.any(1, keepdims=True), at / np.maximum(at.sum(1, keepdims=True), 1), soft)


def dense(series: list | np.ndarray) -> np.ndarray:
    """Equally long series (of arrays, or of arrays of a point's variables) as one array."""
    if isinstance(series, np.ndarray) and series.dtype == float:
        return series
    if len(series) and all(type(r) is np.ndarray and r.dtype == float and r.ndim == 1 for r in series) and len(by_length(series)) == 1:
        return np.concatenate(series).reshape(len(series), len(series[0]))  # np.stack would go through the arrays one by one
    return np.stack([np.stack(r) if getattr(r, "dtype", None) == object else np.asarray(r, float) for r in series])


def by_length(series: list) -> dict[int, np.ndarray]:
    """Positions of the series of each length."""
    sizes = np.fromiter(map(len, series), np.int64, len(series))
    return {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}


def stacks(series: list | np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Positions and stack of the series of each length; an array is such a stack."""
    if isinstance(series, np.ndarray):
        return {series.shape[1]: (np.arange(len(series)), series)}
    return {n: (at, dense([series[k] for k in at])) for n, at in by_length(series).items()}


def in_batches(kernel, x: list, y: list, most: int = 2048) -> np.ndarray:
    """kernel over pairs of arrays of any lengths: pairs of equal shapes are stacked."""
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (a, b) in enumerate(zip(x, y, strict=True)):
        groups.setdefault((len(a), len(b)), []).append(k)
    out = np.empty(len(x))
    for rows in groups.values():
        for at in range(0, len(rows), most):
            part = rows[at : at + most]
            out[part] = kernel(dense([x[k] for k in part]), dense([y[k] for k in part]))
    return out


def of_blocks(kernel, x: list | np.ndarray, y: list | np.ndarray, wanted: np.ndarray, prepare=None, most: int = 4096, outer=None) -> np.ndarray:
    """kernel for the wanted (x, y) pairs of two blocks; what prepare(stack, other length) gives of each series is computed once and passed on. outer, of all pairs of two stacks, serves where it is given."""
    out = np.full(wanted.shape, np.nan)
    left, right = stacks(x), stacks(y)
    for n, (p, a) in left.items():
        for m, (q, b) in right.items():
            if outer and len(p) * len(q) >= MANY_PAIRS:
                out[np.ix_(p, q)] = outer(a, b)
                continue
            i, j = np.nonzero(wanted[np.ix_(p, q)])
            own = [prepare(v, w) if prepare and len(i) else {} for v, w in ((a, m), (b, n))]
            for at in range(0, len(i), most):
                s, t = i[at : at + most], j[at : at + most]
                known = {f"x_{k}": v[s] for k, v in own[0].items()} | {f"y_{k}": v[t] for k, v in own[1].items()}
                out[p[s], q[t]] = kernel(a[s], b[t], **known)
    return np.where(wanted, out, np.nan) if outer else out
