"""Sound: spectra, onsets, tempo, key and fingerprints in numpy, batch by batch; rules and tables as expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Krumhansl's key profiles
MAJOR_PROFILE = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR_PROFILE = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]


def step(value: Column, table: list[tuple[float, float]]) -> Column:
    """The last entry whose start the value reaches."""
    out = F.lit(None)
    for at, v in sorted(table):
        out = F.when(value >= at, v).otherwise(out)
    return out.cast("int") if all(isinstance(v, int) for _, v in table) else out


def resample_source(cut: Column, rates: list[int], want: float = 0.955, low: float = 0.86, high: float = 1.01) -> Column:
    """The rate under whose half a cut-off lies most as resampling leaves it; null if under none."""
    tries = F.transform(F.array(*map(F.lit, rates)), lambda r: F.struct(F.abs(cut / (r / 2.0) - want).alias("off"), r.alias("rate"), (cut / (r / 2.0)).alias("x")))
    return F.array_min(F.filter(tries, lambda s: s["x"].between(low, high)))["rate"]


def verdict(rules: list[tuple[str, str, Column]]) -> dict[str, Column]:
    """The worst severity of the rules that hold (bad, warn, info, else ok) and the findings, worst first."""
    rank = {"bad": 0, "warn": 1, "info": 2}
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(rank[s]).alias("rank"), F.lit(i).alias("i"), F.lit(s).alias("sev"), F.lit(title).alias("title"))) for i, (s, title, c) in enumerate(rules))))
    found = F.array_sort(found)
    return {"grade": F.coalesce(F.get(found, F.lit(0))["sev"], F.lit("ok")), "findings": found}


def keep_range(total: Column, rate: Column, first_ts: Column, seconds: Column) -> tuple[Column, Column]:
    """The samples [first, last) of a decoded stream that belong to the sound: what lies before time 0 is dropped."""
    first = F.greatest(F.lit(0), F.floor(-F.least(F.lit(0.0), first_ts) * rate)).cast("long")
    return first, F.least(total.cast("long"), first + F.floor(seconds * rate + 0.5).cast("long"))


def _per_row(f, cols: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([f(r) for r in pdf.itertuples(index=False)], columns=cols)

    return run


def tones(df: DataFrame, rate: int = 8000, seconds: float = 8.0) -> DataFrame:
    """(id, rate, pcm): a decaying tone of ``hz`` struck ``bpm`` times a minute, with its third and fifth."""

    def one(r):
        t = np.arange(int(rate * seconds)) / rate
        beat = 60 / r.bpm
        x = sum(a * np.sin(2 * np.pi * r.hz * k * t) for k, a in ((1, 1.0), (1.26, 0.5), (1.5, 0.5))) * np.exp(-8 * (t % beat))
        return r.id, rate, (x / 2).astype(np.float32).tolist()

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInPandas(_per_row(one, ["id", "rate", "pcm"]), f"id {kind}, rate int, pcm array<float>")


def stft(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Magnitudes of Hann-windowed frames, frames by bins; none if the sound is shorter than a frame."""
    if len(x) < size:
        return np.zeros((0, size // 2 + 1))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    return np.abs(np.fft.rfft(frames * np.hanning(size), axis=1))


def onsets(mag: np.ndarray, width: int = 8) -> np.ndarray:
    """Rising log energy summed over bins, less its local mean."""
    e = np.log1p(100 * mag)
    flux = np.concatenate([[0.0], np.maximum(0, np.diff(e, axis=0)).sum(1)]) if len(e) else np.zeros(0)
    if not len(flux):
        return flux
    c = np.concatenate([[0.0], np.cumsum(flux)])
    i = np.arange(len(flux))
    lo, hi = np.maximum(0, i - width), np.minimum(len(flux), i + width + 1)
    return np.maximum(0, flux - (c[hi] - c[lo]) / (hi - lo))


def tempo(env: np.ndarray, fps: float, low: float = 60, high: float = 200, prior: float = 122) -> float | None:
    """Beats a minute: the autocorrelation summed over four multiples of a lag, weighed by a log-normal prior."""
    n = len(env)
    if n < 8 or not env.any():
        return None
    spec = np.fft.rfft(env, 2 * n)
    acf = np.fft.irfft(spec * np.conj(spec))[:n] / (n - np.arange(n))
    lags = np.arange(max(1, int(fps * 60 / high)), min(n // 2, int(fps * 60 / low)) + 1)
    if len(lags) < 3:
        return None
    comb = sum(np.interp(lags * k, np.arange(n), acf, right=0) / k for k in (1, 2, 3, 4))
    s = comb * np.exp(-0.5 * (np.log2(60 * fps / lags / prior) / 0.9) ** 2)
    i = int(np.clip(np.argmax(s), 1, len(s) - 2))
    a, b, c = s[i - 1 : i + 2]
    shift = 0.5 * (a - c) / (a - 2 * b + c) if a - 2 * b + c else 0.0
    return float(60 * fps / (lags[i] + np.clip(shift, -0.5, 0.5)))


def tonal_peaks(mag: np.ndarray, rate: int, size: int, low: float = 55, high: float = 4200) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and heights of the frames' spectral peaks, placed between bins by a parabola."""
    m = np.maximum(mag, 1e-12)
    a, b, c = m[:, :-2], m[:, 1:-1], m[:, 2:]
    k = np.arange(1, m.shape[1] - 1)
    on = (b > a) & (b >= c) & (b > 1e-3 * size) & (k * rate / size >= low) & (k * rate / size <= high)
    bend = np.where(on, a - 2 * b + c, -1.0)
    return ((k + 0.5 * (a - c) / np.where(bend == 0, -1e-12, bend)) * rate / size)[on], b[on]


def key_of(mag: np.ndarray, rate: int, size: int) -> tuple[int, bool] | None:
    """Tonic (0 = C) and whether minor: the profile that goes best with the peaks by pitch class.

    How far the peaks lie off the 440 Hz grid, as a mean on the circle of a semitone, tells the tuning; peaks then
    count by the root of their height, the less the further they are from a note.
    """
    hz, height = tonal_peaks(mag, rate, size)
    if not len(hz):
        return None
    off = 2j * np.pi * 12 * np.log2(hz / 440)
    tuning = np.angle((height * np.exp(off)).sum()) / (2 * np.pi)
    pitch = 12 * np.log2(hz / 440) - tuning + 69
    near = np.round(pitch)
    chroma = np.bincount(near.astype(int) % 12, np.sqrt(height) * np.cos(np.pi * (pitch - near)) ** 2, 12)
    if not chroma.std():
        return None
    best = max((np.corrcoef(chroma, np.roll(p, t))[0, 1], -t, m) for m, p in ((False, MAJOR_PROFILE), (True, MINOR_PROFILE)) for t in range(12))
    return -best[1], bool(best[2])


def analysed(df: DataFrame, size: int = 1024, hop: int = 256) -> DataFrame:
    """(id, peak_hz, rms, bpm, tonic, minor) of sounds (id, rate, pcm); nulls where a sound is too short or silent."""

    def one(r):
        x = np.asarray(r.pcm if r.pcm is not None else [], np.float64)
        mag = stft(x, size, hop)
        ltas = mag.mean(0) if len(mag) else np.zeros(size // 2 + 1)
        key = key_of(mag, r.rate, size)
        return r.id, float(np.argmax(ltas) * r.rate / size) if ltas.any() else None, float(np.sqrt((x * x).mean())) if len(x) else None, tempo(onsets(mag), r.rate / hop), key and key[0], key and key[1]

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInPandas(_per_row(one, ["id", "peak_hz", "rms", "bpm", "tonic", "minor"]), f"id {kind}, peak_hz double, rms double, bpm double, tonic int, minor boolean")


def fingerprint(x: np.ndarray, rate: int, size: int = 2048, hop: int = 512, bands: int = 33) -> tuple[list[int], list[int]]:
    """32-bit words, a bit for each pair of neighbouring bands whose difference grew, and loudness 0 to 255."""
    mag = stft(x, size, hop)
    edges = np.unique(np.geomspace(max(2, 200 * size / rate), min(size // 2, 3000 * size / rate), bands + 1).astype(int))
    if len(mag) < 2 or len(edges) < bands + 1:
        return [], []
    e = np.add.reduceat(mag**2, edges[:-1], axis=1)[:, :bands]
    d = np.diff(e, axis=1)
    bits = (d[1:] - d[:-1] > 0)[:, :32]
    words = (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(1)
    loud = np.clip(20 * np.log10(np.sqrt(e.sum(1)[1:]) + 1e-9) + 100, 0, 255)
    return words.astype(np.int64).tolist(), loud.astype(int).tolist()


def fingerprints(df: DataFrame) -> DataFrame:
    def one(r):
        w, loud = fingerprint(np.asarray(r.pcm if r.pcm is not None else [], np.float64), r.rate)
        return r.id, w, loud

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInPandas(_per_row(one, ["id", "words", "loud"]), f"id {kind}, words array<bigint>, loud array<int>")
