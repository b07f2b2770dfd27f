"""Signal kernels on planes (2-D arrays of one frame or fingerprint). Two-dimensional transforms have no built-in, so they run as NumPy
functions inside Arrow batches; a plane travels as binary float32 with its height and width."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def ncc(a: np.ndarray, b: np.ndarray, eps: float = 1e-12) -> float:
    """Normalised correlation at zero shift, both sides centred."""
    x, y = a.ravel() - a.mean(dtype=np.float64), b.ravel() - b.mean(dtype=np.float64)
    return float(x @ y / (math.sqrt(float((x @ x) * (y @ y))) + eps))


def cross_correlation(k: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The circular cross correlation of k and w; no shift lies at (h - 1, w - 1)."""
    return np.real(np.fft.ifft2(np.fft.fft2(k) * np.fft.fft2(np.rot90(w, 2))))


def peak_energy(surface: np.ndarray, row: int, col: int, radius: int = 2) -> float:
    """Signed squared value at a place over the mean square of all places more than `radius` rows or columns away, going round the edges."""
    h, w = surface.shape
    rows, cols = np.arange(row - radius, row + radius + 1) % h, np.arange(col - radius, col + radius + 1) % w
    outside = np.ones((h, w), bool)
    outside[np.ix_(rows, cols)] = False
    peak, rest = float(surface[row, col]), surface[outside]
    return math.copysign(peak * peak, peak) / max(float(np.mean(rest * rest)), 1e-30) if rest.size else math.nan


def pce_scores(k: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """(pce at the highest place, pce at no shift)."""
    s = cross_correlation(k - k.mean(), w - w.mean())
    top = np.unravel_index(int(np.argmax(s)), s.shape)
    return peak_energy(s, int(top[0]), int(top[1])), peak_energy(s, s.shape[0] - 1, s.shape[1] - 1)


def zero_mean(p: np.ndarray) -> np.ndarray:
    """Rows, then columns, without their means, apart for the four places of the colour filter."""
    out = np.array(p, dtype=np.float64)
    for i in range(2):
        for j in range(2):
            part = out[i::2, j::2]
            if part.size:
                part -= part.mean(axis=1, keepdims=True)
                part -= part.mean(axis=0, keepdims=True)
    return out


def wiener_spectrum(p: np.ndarray, sigma: float) -> np.ndarray:
    """p with what stands out of the noise floor in the spectrum taken down: each magnitude is scaled by noise over the greater of noise and its 3 x 3 neighbourhood's energy."""
    f = np.fft.fft2(p)
    m = np.abs(f) / math.sqrt(p.size)
    power = sum(np.roll(m * m, (a, b), (0, 1)) for a in (-1, 0, 1) for b in (-1, 0, 1)) / 9
    local = np.maximum(0.0, power - sigma * sigma)
    return np.real(np.fft.ifft2(f * (sigma * sigma / np.maximum(local + sigma * sigma, 1e-30))))


def residual(y: np.ndarray, radius: int = 2) -> np.ndarray:
    """What a Gaussian smoothing leaves of a frame: the noise. A stand-in for a wavelet denoiser."""
    x = np.arange(-radius, radius + 1)
    g = np.exp(-(x * x) / 2.0)
    g /= g.sum()
    y = np.asarray(y, dtype=np.float64)
    smooth = np.pad(y, radius, mode="reflect" if min(y.shape) > radius else "edge")
    smooth = sum(w * smooth[i : i + y.shape[0], :] for i, w in enumerate(g))
    return y - sum(w * smooth[:, i : i + y.shape[1]] for i, w in enumerate(g))


def residual_stats(w: np.ndarray) -> tuple[float, float, float]:
    """Standard deviation, skewness and excess kurtosis of the population; the last two 0 for a flat plane."""
    x = w.ravel() - w.mean()
    s2 = float(np.mean(x * x))
    return (0.0, 0.0, 0.0) if s2 <= 0 else (math.sqrt(s2), float(np.mean(x**3)) / s2**1.5, float(np.mean(x**4)) / s2**2 - 3)


def spectrum_stats(w: np.ndarray) -> dict[str, float]:
    """Flatness, share above a quarter cycle a pixel, highest peak over the median, places above ten medians, and the energy at multiples of 1/8 cycle over the mean."""
    p = np.abs(np.fft.fft2(w - w.mean())) ** 2
    fy, fx = np.fft.fftfreq(p.shape[0])[:, None], np.fft.fftfreq(p.shape[1])[None, :]
    r = np.hypot(fy, fx)
    keep = r > 0
    q = p[keep] + 1e-12
    med = float(np.median(q))
    grid = keep & (np.isclose(np.abs(fy * 8) % 1, 0) | np.isclose(np.abs(fx * 8) % 1, 0))
    return {"flatness": float(np.exp(np.mean(np.log(q))) / np.mean(q)), "hf_ratio": float(p[r > 0.25].sum() / q.sum()), "peak_ratio": float(q.max() / med), "n_peaks": int((q > 10 * med).sum()), "block8": float(p[grid].mean() / q.mean())}


def log_spectrum(w: np.ndarray, least: float = 0.1) -> np.ndarray:
    """The log power spectrum above `least` cycles a pixel, without its mean."""
    p = np.abs(np.fft.fft2(w)) ** 2
    r = np.hypot(np.fft.fftfreq(p.shape[0])[:, None], np.fft.fftfreq(p.shape[1])[None, :])
    x = np.log(p[r > least] + 1e-12)
    return x - x.mean()


def thumbnail(y: np.ndarray, side: int = 16) -> np.ndarray:
    """side x side block means, without their mean, of length 1."""
    h, w = (d // side * side for d in y.shape)
    t = np.asarray(y[:h, :w], np.float64).reshape(side, h // side, side, w // side).mean(axis=(1, 3)).ravel()
    t -= t.mean()
    return t / max(float(np.linalg.norm(t)), 1e-12)


def matching_cost(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> float:
    """Mean square difference of two clips' block means, and 50 times their relative difference of length."""
    return float(np.mean((np.asarray(a, float) - b) ** 2)) + 50.0 * abs(n_a - n_b) / max(n_a, n_b, 1)


def injected(y: np.ndarray, k: np.ndarray, alpha: float) -> np.ndarray:
    """y times (1 + alpha k), rounded half to even and kept within a byte; a negative alpha takes the pattern out."""
    return np.clip(np.rint(np.asarray(y, np.float64) * (1 + alpha * k)), 0, 255).astype(np.uint8)


def secant(points: list[tuple[float, float]]) -> float:
    """The next alpha where the correlation should vanish: the line through the nearest points on both sides of 0, else through the two of least correlation."""
    low, high = [p for p in points if p[1] <= 0], [p for p in points if p[1] > 0]
    if low and high:
        (a, x), (b, y) = max(low, key=lambda p: p[1]), min(high, key=lambda p: p[1])
    else:
        (a, x), (b, y) = sorted(points, key=lambda p: abs(p[1]))[:2]
    return a if x == y else a - x * (b - a) / (y - x)


# fixed values: three high-pass filters of residual steganalysis
HIGH_PASS = (
    np.array([[0, 0, 0, 0, 0], [0, -1, 2, -1, 0], [0, 2, -4, 2, 0], [0, -1, 2, -1, 0], [0, 0, 0, 0, 0]]) / 4,
    np.array([[-1, 2, -2, 2, -1], [2, -6, 8, -6, 2], [-2, 8, -12, 8, -2], [2, -6, 8, -6, 2], [-1, 2, -2, 2, -1]]) / 12,
    np.array([[0, 0, 0, 0, 0], [0, 0, 0, 0, 0], [0, 1, -2, 1, 0], [0, 0, 0, 0, 0], [0, 0, 0, 0, 0]]) / 2,
)


def high_passed(y: np.ndarray, most: float = 4.0) -> np.ndarray:
    """The three filters' answers within -most … most."""
    p = np.pad(np.asarray(y, np.float64), 2)
    out = [sum(f[i, j] * p[i : i + y.shape[0], j : j + y.shape[1]] for i in range(5) for j in range(5) if f[i, j]) for f in HIGH_PASS]
    return np.clip(np.stack(out), -most, most)


def noised(y: np.ndarray, key: str, sigma: float) -> np.ndarray:
    """y with Gaussian noise that hangs on the key only."""
    import zlib

    rng = np.random.default_rng(zlib.crc32(key.encode()))
    return np.clip(np.rint(np.asarray(y, np.float64) + rng.normal(0, sigma, y.shape)), 0, 255).astype(np.uint8)


def assignment(cost: np.ndarray) -> list[int]:
    """The column of each row such that all differ and the sum is least (rows <= columns): shortest augmenting paths."""
    n, m = cost.shape
    u, v, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        dist, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0, delta, j1 = owner[j0], np.inf, 0
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = reduced < dist[free]
            dist[free[better]], way[free[better]] = reduced[better], j0
            j1 = int(free[np.argmin(dist[free])])
            delta = dist[j1]
            u[owner[used]] += delta
            v[used] -= delta
            dist[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def _plane(row, name: str = "y") -> np.ndarray:
    kind = np.uint8 if len(row[name]) == row["h"] * row["w"] else np.float32
    return np.frombuffer(row[name], kind).reshape(row["h"], row["w"])


def frame_features(frames: DataFrame, clip: str) -> DataFrame:
    """(clip, frame, res_std, res_skew, res_kurt, fft_*): a row a frame of (clip, frame, h, w, y). Frames are independent, so nothing is shuffled."""
    kind = frames.schema[clip].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                w = residual(_plane(r))
                s = spectrum_stats(w)
                rows.append((r[clip], r["frame"], *residual_stats(w), s["flatness"], s["hf_ratio"], s["peak_ratio"], s["n_peaks"], s["block8"]))
            yield pd.DataFrame(rows, columns=[clip, "frame", "res_std", "res_skew", "res_kurt", "fft_flatness", "fft_hf_ratio", "fft_peak_ratio", "fft_n_peaks", "fft_block8"])

    return frames.select(clip, "frame", "h", "w", "y").mapInPandas(run, f"`{clip}` {kind}, frame int, res_std double, res_skew double, res_kurt double, fft_flatness double, fft_hf_ratio double, fft_peak_ratio double, fft_n_peaks int, fft_block8 double")


def fingerprints(frames: DataFrame, by: str, chunks: int = 32) -> DataFrame:
    """(by, h, w, n, k): the sensor pattern sum(W I) / (sum(I I) + 1) of every camera's frames, zero mean, as binary float32.

    The two sums add up, so frames are summed by (camera, chunk) first: a camera that holds most frames is spread over
    `chunks` tasks, and at most `chunks` partial planes a camera meet in the last step.
    """
    from pyspark.sql import functions as F

    kind = frames.schema[by].dataType.simpleString()
    schema = f"`{by}` {kind}, h int, w int, n long, top binary, bottom binary"

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        top = bottom = 0.0
        for r in pdf.to_dict("records"):
            y = _plane(r).astype(np.float64)
            top, bottom = top + residual(y) * y, bottom + y * y
        r = pdf.iloc[0]
        return pd.DataFrame([(r[by], r["h"], r["w"], len(pdf), np.asarray(top).tobytes(), np.asarray(bottom).tobytes())], columns=[by, "h", "w", "n", "top", "bottom"])

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        top, bottom = (sum(np.frombuffer(x) for x in pdf[c]).reshape(r["h"], r["w"]) for c in ("top", "bottom"))
        k = zero_mean(top / (bottom + 1))
        k = wiener_spectrum(k, float(k.std()))
        return pd.DataFrame([(r[by], r["h"], r["w"], pdf["n"].sum(), k.astype(np.float32).tobytes())], columns=[by, "h", "w", "n", "k"])

    parts = frames.select(by, "frame", "h", "w", "y").withColumn("chunk", F.pmod(F.xxhash64(by, "frame", "y"), F.lit(chunks))).groupBy(by, "h", "w", "chunk").applyInPandas(partial, schema)
    return parts.groupBy(by, "h", "w").applyInPandas(final, f"`{by}` {kind}, h int, w int, n long, k binary")


def plane_scores(queries: DataFrame, bank: DataFrame, query: str, candidate: str) -> DataFrame:
    """(query, candidate, pce, pce0, ncc) of every query plane (query, h, w, k) and every bank plane of its size (candidate, h, w, k).

    Pairs are joined on the size, the bank side in parts; scores of a pair hang on it alone.
    """
    from pyspark.sql import functions as F

    pairs = queries.select(query, "h", "w", F.col("k").alias("a")).join(bank.select(candidate, "h", "w", F.col("k").alias("b")), ["h", "w"])
    kinds = queries.schema[query].dataType.simpleString(), bank.schema[candidate].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                a, b = (np.frombuffer(r[c], np.float32).reshape(r["h"], r["w"]) for c in "ab")
                rows.append((r[query], r[candidate], *pce_scores(b, a), ncc(a, b)))
            yield pd.DataFrame(rows, columns=[query, candidate, "pce", "pce0", "ncc"])

    return pairs.mapInPandas(run, f"`{query}` {kinds[0]}, `{candidate}` {kinds[1]}, pce double, pce0 double, ncc double")
