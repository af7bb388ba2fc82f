"""Signal and matching kernels on numpy arrays, for use inside grouped pandas functions."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def interpolate(grid: np.ndarray, t: np.ndarray, y: np.ndarray, valid: np.ndarray, gap: float) -> np.ndarray:
    """Linear interpolation of valid samples; NaN across gaps beyond ``gap`` and outside the samples."""
    t, y = t[valid], y[valid]
    out = np.full(len(grid), np.nan)
    if not len(t):
        return out
    right = np.clip(np.searchsorted(t, grid, "left"), 0, len(t) - 1)
    left = np.clip(np.searchsorted(t, grid, "right") - 1, 0, len(t) - 1)
    inside = (grid >= t[0]) & (grid <= t[-1]) & (t[right] - t[left] <= gap)
    out[inside] = np.interp(grid[inside], t, y)
    return out


def fill_missing(x: np.ndarray) -> np.ndarray:
    """NaN replaced by linear interpolation over the index, ends extended, all missing gives zeros."""
    good = np.isfinite(x)
    return np.interp(np.arange(len(x)), np.flatnonzero(good), x[good]) if good.any() else np.zeros(len(x))


def _edges(x: np.ndarray, size: int) -> np.ndarray:
    return np.pad(x, (size // 2, size - 1 - size // 2), "edge")


def rolling_mean(x: np.ndarray, size: int) -> np.ndarray:
    """Centred moving mean, edge values repeated."""
    total = np.cumsum(np.insert(_edges(x, size), 0, 0.0))
    return (total[size:] - total[:-size]) / size


#: Neighbouring windows whose medians are found together, and how many such groups at a time.
TOGETHER, GROUPS = 16, 128


def rolling_median(x: np.ndarray, size: int) -> np.ndarray:
    """Centred moving median along the last axis, edge values repeated.

    Neighbouring windows share all but a few values; of those shared only the middle ones can be a median.
    """
    low, high, apart = (size - 1) // 2, size // 2, min(TOGETHER, (size + 1) // 2) - 1
    after = size - 1 - size // 2 + -x.shape[-1] % (apart + 1)
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, [(0, 0)] * (x.ndim - 1) + [(size // 2, after)], "edge"), size + apart, axis=-1)[..., :: apart + 1, :]
    found = []
    for start in range(0, windows.shape[-2], GROUPS):  # bounded memory, however long the axis
        group = windows[..., start : start + GROUPS, :]
        middle = np.sort(group[..., apart:size], axis=-1)[..., None, low - apart : high + 1]
        rest = np.lib.stride_tricks.sliding_window_view(np.concatenate([group[..., :apart], group[..., size:]], -1), apart, axis=-1) if apart else group[..., None, :0]
        parts = np.sort(np.concatenate([np.broadcast_to(middle, (*rest.shape[:-1], middle.shape[-1])), rest], -1), axis=-1)
        medians = (parts[..., apart] + parts[..., apart + high - low]) / 2 if high > low else parts[..., apart]
        found.append(medians.reshape(*x.shape[:-1], -1))
    return np.concatenate(found, -1)[..., : x.shape[-1]]


@lru_cache(maxsize=64)
def _polynomial(size: int, degree: int) -> np.ndarray:
    """From the values of a window to the coefficients of the fitted polynomial around its middle."""
    return np.linalg.pinv(np.vander(np.arange(-(size // 2), size // 2 + 1), degree + 1))


def savgol(x: np.ndarray, size: int, degree: int) -> np.ndarray:
    """Local least-squares polynomial smoothing; the ends are read off the polynomial of the first and last window."""
    size = min(size, len(x) - (1 - len(x) % 2))
    if size <= degree:
        return x.copy()
    half = size // 2
    fit = _polynomial(size, degree)
    out = np.convolve(x, fit[-1][::-1], "same")
    for at, window in ((slice(0, half), x[:size]), (slice(len(x) - half, None), x[-size:])):
        where = np.arange(-half, 0) if at.start == 0 else np.arange(1, half + 1)
        out[at] = np.vander(where, degree + 1) @ (fit @ window)
    return out


def eigenvalue_over(a: np.ndarray, limit: float) -> np.ndarray:
    """Whether the greatest eigenvalue of each covariance exceeds the limit.

    It lies between the squared norm over the trace and the norm; where these settle it, nothing is solved.
    """
    square, trace = np.square(a).sum((1, 2)), np.trace(a, axis1=1, axis2=2)
    over = square > limit * trace
    open_ = (square > (limit * (1 - 1e-9)) ** 2) & (square < limit * (1 + 1e-9) * trace)
    over[open_] = np.linalg.eigvalsh(a[open_])[:, -1] > limit
    return over


def thin(t: np.ndarray, least: float) -> np.ndarray:
    """Mask of rows at least ``least`` after the last kept row; the first is kept."""
    keep, last = np.zeros(len(t), bool), -np.inf
    for i, now in enumerate(t):
        if now - last >= least - 1e-9:
            keep[i], last = True, now
    return keep


def peaks(x: np.ndarray, distance: int, prominence: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Local maxima at least ``distance`` apart (the higher first) whose prominence is enough, their left bases and prominences.

    A flat top counts at its middle; a base is the lowest sample between the peak and the nearest higher one on its side.
    """
    cuts = np.flatnonzero(np.diff(x))
    first, last = np.r_[0, cuts + 1], np.r_[cuts, len(x) - 1]
    rises = np.diff(x[first]) > 0 if len(x) else np.zeros(0, bool)
    tops = np.flatnonzero(rises[:-1] & ~rises[1:]) + 1
    kept = (first[tops] + last[tops]) // 2
    alive = np.ones(len(kept), bool)
    for k in np.argsort(x[kept], kind="stable")[::-1] if len(kept) else []:
        if alive[k]:
            near = np.abs(kept - kept[k]) < distance
            near[k] = False
            alive &= ~near
    out, bases, heights = [], [], []
    for p in kept[alive].tolist():
        higher = np.flatnonzero(x[:p] > x[p])
        low = higher[-1] + 1 if len(higher) else 0
        left = low + len(x[low : p + 1]) - 1 - int(np.argmin(x[low : p + 1][::-1]))
        higher = np.flatnonzero(x[p + 1 :] > x[p])
        right = x[p : p + 1 + (higher[0] if len(higher) else len(x))].min()
        if x[p] - max(x[left], right) >= prominence:
            out.append(p)
            bases.append(left)
            heights.append(x[p] - max(x[left], right))
    return np.array(out, int), np.array(bases, int), np.array(heights, float)


def peak_widths(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Widths at half of the prominence, crossings interpolated."""
    out = []
    for p in at.tolist():
        sides = []
        for part in (x[: p + 1][::-1], x[p:]):
            higher = np.flatnonzero(part > x[p])
            sides.append(part[: higher[0]] if len(higher) else part)
        level = x[p] - (x[p] - max(s.min() for s in sides)) / 2
        width = 0.0
        for s in sides:
            below = np.flatnonzero(s <= level)
            if len(below):
                k = below[0]
                width += k - (level - s[k]) / (s[k - 1] - s[k]) if k else 0
            else:
                width += len(s) - 1
        out.append(width)
    return np.array(out)


def periodicity(x: np.ndarray, period: float) -> float:
    """Greatest autocorrelation over lags of 0.7 to 1.3 periods, each as a share of the power and corrected for the overlap."""
    x = x - x.mean()
    n, power = len(x), float(x @ x)
    lags = np.arange(max(1, int(0.7 * period)), min(n - 1, int(1.3 * period) + 1) + 1)
    if not power or not len(lags):
        return 0.0
    spectrum = np.abs(np.fft.rfft(x, 2 * n)) ** 2  # padded to twice the length, so nothing wraps around
    return max(0.0, float((np.fft.irfft(spectrum)[lags] / power * n / (n - lags)).max()))


def assign(score: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one assignment of greatest total score: shortest augmenting paths over the shorter side."""
    cost = -np.asarray(score, float)
    flip = cost.shape[0] > cost.shape[1]
    cost = cost.T if flip else cost
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m + 1)
    owner = np.full(m + 1, -1)
    for row in range(n):
        owner[m] = row
        at, best, came, seen = m, np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[at] >= 0:
            seen[at] = True
            r = owner[at]
            free = ~seen[:m]
            reduced = cost[r] - u[r] - v[:m]
            better = free & (reduced < best)
            best[better], came[better] = reduced[better], at
            target = int(np.flatnonzero(free)[np.argmin(best[free])])
            step = best[target]
            rows = owner[seen]
            u[rows] += step
            v[seen] -= step
            best[free] -= step
            at = target
        while at != m:
            owner[at] = owner[came[at]]
            at = came[at]
        owner[m] = -1
    pairs = [(int(owner[c]), c) for c in range(m) if owner[c] >= 0]
    return sorted((c, r) if flip else (r, c) for r, c in pairs)


def merged(n: int, links: list[tuple[float, int, int]], forbidden: set[frozenset[int]]) -> list[int]:
    """Constrained merging: links by falling confidence, a merge is refused if any pair across it is forbidden.  Roots by item."""
    group = {i: [i] for i in range(n)}
    root = list(range(n))
    for _, a, b in sorted(links, key=lambda x: (-x[0], x[1], x[2])):
        ra, rb = root[a], root[b]
        if ra != rb and not any(frozenset((x, y)) in forbidden for x in group[ra] for y in group[rb]):
            low, high = min(ra, rb), max(ra, rb)
            for x in group[high]:
                root[x] = low
            group[low] += group.pop(high)
    return root


@lru_cache(maxsize=64)
def four_of(n: int, tries: int, seed: int) -> np.ndarray:
    """The samples of four out of n, drawn one after another; one that comes again cannot win, so it is left out."""
    rng = np.random.default_rng(seed)
    picks = np.array([rng.choice(n, 4, replace=False) for _ in range(tries)])
    return picks[np.sort(np.unique(np.sort(picks, 1), axis=0, return_index=True)[1])]


def homography(px: np.ndarray, world: np.ndarray, tolerance: float = 0.6, seed: int = 0) -> np.ndarray:
    """3 x 3 matrix from pixel to floor: exact for four points, else consensus over samples and least squares on the inliers."""

    def solve(a, b):  # for many sets of points at once
        def scaled(p):
            c, out = p.mean(1), np.zeros((len(p), 3, 3))
            s = np.sqrt(2) / np.maximum(1e-12, np.linalg.norm(p - c[:, None], axis=2).mean(1))
            out[:, 0, 0], out[:, 1, 1], out[:, 2, 2], out[:, :2, 2] = s, s, 1, -s[:, None] * c
            return out

        ta, tb = scaled(a), scaled(b)
        a, b = (np.concatenate([p, np.ones((*p.shape[:2], 1))], 2) @ t.transpose(0, 2, 1) for p, t in ((a, ta), (b, tb)))
        none = np.zeros_like(a)
        rows = np.stack([np.concatenate([-a, none, b[..., :1] * a], 2), np.concatenate([none, -a, b[..., 1:2] * a], 2)], 2)
        h = np.linalg.inv(tb) @ np.linalg.svd(rows.reshape(len(a), -1, 9))[2][:, -1].reshape(-1, 3, 3) @ ta
        return h / h[:, 2:, 2:]

    px, world = np.asarray(px, float), np.asarray(world, float)
    if len(px) == 4:
        return solve(px[None], world[None])[0]
    picks = four_of(len(px), 300, seed)
    picks = picks[(np.isfinite(px).all(1) & np.isfinite(world).all(1))[picks].all(1)]
    with np.errstate(all="ignore"):
        q = np.c_[px, np.ones(len(px))] @ solve(px[picks], world[picks]).transpose(0, 2, 1)
        error = np.nan_to_num(np.linalg.norm(q[..., :2] / q[..., 2:] - world, axis=2), nan=np.inf)
    if (error < tolerance).sum(1).max(initial=0) < 4:
        raise ValueError("no consistent homography")
    # not the greatest count: a matrix bent to take in a wrong point would have one more than the one that fits the others
    best = (error < tolerance)[np.minimum(error, tolerance).sum(1).argmin()]
    return solve(px[best][None], world[best][None])[0]


def projected(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.c_[p, np.ones(len(p))] @ h.T
    return q[:, :2] / q[:, 2:]


def fit_report(h: np.ndarray, px: np.ndarray, world: np.ndarray) -> dict:
    """Errors of a fit, leave-one-out where there are six points, spread of the points, and its grade."""
    px, world = np.asarray(px, float), np.asarray(world, float)
    error = np.linalg.norm(projected(h, px) - world, axis=1)
    held = [float(np.linalg.norm(projected(homography(np.delete(px, i, 0), np.delete(world, i, 0)), px[i : i + 1]) - world[i])) for i in range(len(px))] if len(px) >= 6 else None
    spread = float(np.ptp(world[:, 0]) * np.ptp(world[:, 1]))
    rmse = float(np.sqrt((error**2).mean()))
    grade = "good" if held and rmse < 0.3 and np.sqrt(np.mean(np.square(held))) < 0.6 and spread > 4 else "fair" if len(px) > 4 and rmse < 0.6 else "weak"
    return {"rmse": rmse, "max": float(error.max()), "loo": held and float(np.sqrt(np.mean(np.square(held)))), "spread": spread, "grade": grade}


def rigid(a: np.ndarray, b: np.ndarray, scale: bool = False) -> tuple[float, float, np.ndarray]:
    """Scale, angle and shift of the least-squares map from a to b."""
    ca, cb = a.mean(0), b.mean(0)
    x, y = a - ca, b - cb
    dot, cross = float((x * y).sum()), float((x[:, 0] * y[:, 1] - x[:, 1] * y[:, 0]).sum())
    theta = float(np.arctan2(cross, dot))
    s = float(np.hypot(dot, cross) / max(1e-12, (x**2).sum())) if scale else 1.0
    c, d = np.cos(theta), np.sin(theta)
    return s, theta, cb - s * (np.array([[c, -d], [d, c]]) @ ca)


def ransac_rigid(a: np.ndarray, b: np.ndarray, tolerance: float = 0.8, tries: int = 500, seed: int = 0) -> tuple[float, np.ndarray, int]:
    """Angle, shift and number of inliers of the rigid map that most pairs agree with."""
    rng, best = np.random.default_rng(seed), np.zeros(len(a), bool)
    for _ in range(tries):
        pick = rng.choice(len(a), 2, replace=False)
        _, theta, shift = rigid(a[pick], b[pick])
        c, s = np.cos(theta), np.sin(theta)
        good = np.linalg.norm(a @ np.array([[c, s], [-s, c]]) + shift - b, axis=1) < tolerance
        if good.sum() > best.sum():
            best = good
    _, theta, shift = rigid(a[best], b[best])
    return theta, shift, int(best.sum())
