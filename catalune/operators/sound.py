"""What a sound holds: three-band waveforms, beat grids, and how far its spectrum really reaches. Numpy on whole arrays;
each sound is a row, so rows are independent and run batch by batch."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from catalune.operators.signals import _per_row, onsets, stft

# Points a second of a waveform, the edges of its bands, its curve, and the lag of an onset in windows
POINTS, LOW, HIGH, CURVE, ONSET_LAG = 150, 200.0, 2500.0, 0.75, 0.7


def second_order(sr: float, edge: float, high: bool, hz: np.ndarray) -> np.ndarray:
    """The response of a second-order low- or high-pass (Butterworth, bilinear transform) at frequencies."""
    w = 2 * np.pi * edge / sr
    c, a = np.cos(w), np.sin(w) / np.sqrt(2)
    z = np.exp(-2j * np.pi * hz / sr)
    gain = (1 + c) / 2 if high else (1 - c) / 2
    zeros = (1 - z) ** 2 if high else (1 + z) ** 2
    return gain * zeros / ((1 + a) - 2 * c * z + (1 - a) * z * z)


def filtered(x: np.ndarray, sr: float, edge: float, high: bool) -> np.ndarray:
    """x through two such sections. Filters are products of spectra; the padding takes up what rings on."""
    n = 1 << int(np.ceil(np.log2(len(x) + int(sr / 10) + 1)))
    h = second_order(sr, edge, high, np.fft.rfftfreq(n, 1 / sr)) ** 2
    return np.fft.irfft(np.fft.rfft(x, n) * h, n)[: len(x)]


def scaled(x: np.ndarray) -> np.ndarray:
    """0 to 255 against the loudest, with a gentle curve."""
    most = x.max(initial=0)
    return np.floor(255 * (x / most) ** CURVE + 0.5).astype(int) if most > 0 else np.zeros(len(x), int)


def waveform(x: np.ndarray, sr: float) -> dict[str, np.ndarray]:
    """low, mid, high (RMS) and peak, POINTS a second, each against its own loudest point."""
    x = np.asarray(x, float)
    n = max(1, int(len(x) * POINTS / sr))
    at = np.minimum((np.arange(n + 1) * sr / POINTS).astype(int), len(x))
    if not len(x):
        return {k: np.zeros(1, int) for k in ("low", "mid", "high", "peak")}
    low, high = filtered(x, sr, LOW, False), filtered(x, sr, HIGH, True)
    ends = np.append(at[:-1], at[-1])
    over = lambda f, v: f.reduceat(np.append(v, 0.0), ends)[:n]
    rms = lambda v: np.sqrt(np.maximum(0, over(np.add, v * v)) / np.maximum(1, np.diff(at)))
    bands = {"low": rms(low), "mid": rms(x - low - high), "high": rms(high), "peak": over(np.maximum, np.abs(x))}
    return {k: scaled(v) for k, v in bands.items()}


def beat_grid(env: np.ndarray, fps: float, t0: float, bpm: float, level: np.ndarray | None = None, level_rate: float = POINTS) -> tuple[float, int]:
    """When the first beat at or after 0 falls, and which of each four begins a bar.

    The phase is the one whose beats meet most onsets, all phases of a quarter frame tried at once; the bar begins at
    the beat that is loudest in ``level`` within 30 ms, or in the onsets.
    """
    period, n = fps * 60 / bpm, len(env)
    if not period > 1 or n < 4 * period:
        return 0.0, 0
    heard = lambda f: np.interp(f, np.arange(n), env)

    def score(phases: np.ndarray) -> np.ndarray:
        f = phases[:, None] + np.arange(int(np.ceil((n - 1) / period)) + 1) * period
        return np.where(f < n - 1, heard(f), 0).sum(1)

    phases = np.arange(0, period, 0.25)
    best = phases[int(np.argmax(score(phases)))]
    before, here, after = score(np.array([best - 0.25 + (period if best < 0.25 else 0), best, best + 0.25]))
    bend = before - 2 * here + after
    phase = (best + (0.125 * (before - after) / bend if bend < 0 else 0)) % period
    beat = 60 / bpm
    first = (t0 + phase / fps) % beat
    if level is None:
        f = np.arange(phase, n - 1, period)
        loud = heard(f)
    else:
        times = np.arange(first, len(level) / level_rate, beat)
        i = np.floor(times * level_rate + 0.5).astype(int)
        span = max(1, int(0.03 * level_rate + 0.5))
        padded = np.append(level, np.zeros(span))
        loud = padded[np.minimum(i[:, None] + np.arange(span), len(padded) - 1)].max(1)
    return float(first), int(np.argmax(np.bincount(np.arange(len(loud)) % 4, loud, 4)))


@dataclass
class Levels:
    """A long-term spectrum in dB, one value a bin of ``width`` Hz."""

    db: np.ndarray
    width: float

    @property
    def top(self) -> float:
        return self.width * len(self.db)

    def bin(self, hz):
        return np.clip(np.floor(np.asarray(hz) / self.width + 0.5).astype(int), 0, len(self.db) - 1)

    def mean(self, low, high):
        """Over bins from low to high, both included; nan where there are none."""
        a, b = self.bin(low), self.bin(high)
        s = np.concatenate([[0.0], np.cumsum(self.db)])
        return np.where(b >= a, (s[b + 1] - s[a]) / np.maximum(1, b - a + 1), np.nan)

    def rank(self, low: float, high: float, share: float) -> float:
        part = np.sort(self.db[int(self.bin(low)) : int(self.bin(high)) + 1])
        return float(part[int(share * (len(part) - 1))])

    def smoothed(self, hz: float = 75.0) -> Levels:
        """Powers averaged over so many Hz either way."""
        n, w = len(self.db), max(1, int(hz / self.width + 0.5))
        p = np.concatenate([[0.0], np.cumsum(10 ** (self.db / 10))])
        a, b = np.maximum(0, np.arange(n) - w), np.minimum(n, np.arange(n) + w + 1)
        return Levels(np.maximum(-200, 10 * np.log10((p[b] - p[a]) / (b - a) + 1e-30)), self.width)

    def highest_run(self, over: float, hz: float = 400.0, below: int | None = None) -> float:
        """The end of the highest stretch of ``hz`` that lies over a level; 0 if there is none."""
        need = max(2, int(hz / self.width + 0.5))
        loud = np.concatenate([[0], np.cumsum(self.db[:below] > over)])
        full = np.flatnonzero(loud[need:] - loud[:-need] == need) if len(loud) > need else np.empty(0, int)
        return float((full[-1] + need - 1) * self.width) if len(full) else 0.0


def cutoff(spectrum: Levels) -> dict:
    """Where a spectrum ends: fc, whether at a wall (and how deep a drop), fade, full, floor, ref, rising, mirror.

    A wall is a drop of 18 dB from the 600 Hz below a place to those above, with nothing much above; the highest one
    counts. Without one the spectrum ends where it sinks into the floor. mirror: the rate whose half the spectrum is
    folded at, as a bad resampler leaves it.
    """
    sm = spectrum.smoothed()
    half = sm.top
    floor, ref = sm.rank(1000, half * 0.995, 0.05), sm.rank(200, min(half * 0.8, 12000), 0.5)
    step = max(1, int(50 / sm.width + 0.5))
    f = np.arange(int(sm.bin(half - 950)), int(sm.bin(2000)) - 1, -step) * sm.width
    below, above = sm.mean(f - 900, f - 300), sm.mean(f + 300, f + 900)
    walls = np.flatnonzero((below - above >= 18) & (sm.mean(f + 300, np.minimum(half * 0.995, f + 4000)) <= floor + 12))
    fade = sm.highest_run(floor + 6)
    out = {"fc": fade, "wall": False, "drop": 0.0}
    if len(walls):
        at, mid = f[walls[0]], (below[walls[0]] + above[walls[0]]) / 2
        a, b = int(sm.bin(at - 900)), int(sm.bin(at + 900))
        over = np.flatnonzero(sm.db[a : b + 1] >= mid)
        fc = float((a + over[-1]) * sm.width) if len(over) else float(at)
        out = {"fc": fc, "wall": True, "drop": float(sm.mean(fc - 1200, fc - 400) - sm.mean(fc + 400, min(half * 0.995, fc + 1200)))}
    rising = bool(half > 40000 and sm.mean(half * 0.75, half * 0.95) > sm.mean(24000, 30000) + 6)
    return out | {"fade": fade, "full": out["fc"] >= 0.93 * half, "floor": floor, "ref": ref, "rising": rising, "mirror": None if rising else _mirror(sm, floor)}


def _mirror(sm: Levels, floor: float) -> int | None:
    half = sm.top
    for rate in (44100, 48000) if 2 * half >= 88200 else ():
        m = rate / 2
        span = min(m * 0.7, half - m - 500)
        if span >= 3000:
            d = np.arange(1000, span + 1e-9, max(sm.width, span / 300))
            x, y = sm.db[sm.bin(m - d)], sm.db[sm.bin(m + d)]
            alike = np.corrcoef(x, y)[0, 1] if x.std() > 0 and y.std() > 0 else 0.0
            if alike > 0.85 and np.abs(x - y).mean() < 8 and sm.mean(m + 1000, m + span) > floor + 10:
                return rate
    return None


@dataclass
class Moments:
    """A spectrogram in dB, moments by bins."""

    db: np.ndarray
    width: float

    def band(self, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each moment, the loudest bin and the mean power of a band, in dB."""
        n = self.db.shape[1]
        a, b = (int(min(n - 1, max(0, int(f / self.width + 0.5)))) for f in (low, high))
        part = self.db[:, a : max(a + 1, b)]
        return part.max(1), 10 * np.log10((10 ** (part / 10)).mean(1) + 1e-30)


def _at(x: np.ndarray, share: float) -> float:
    return float(np.sort(x)[int(share * (len(x) - 1))])


def reach(m: Moments, bands: int = 128) -> float | None:
    """How far content comes and goes: the highest two bands whose loud moments lie over the floor and over their own
    quiet ones. Steady noise doesn't count."""
    moments, rows = m.db.shape
    if not moments or rows < 64:
        return None
    half = rows * m.width
    edges = (np.arange(bands) * rows / bands).astype(int)
    held = np.sort(np.maximum.reduceat(m.db, edges, axis=1), axis=0)
    loud, quiet = held[int(0.95 * (moments - 1))], held[int(0.2 * (moments - 1))]
    begin = int(np.ceil(1000 / half * bands))
    floor = np.convolve(quiet, np.ones(3) / 3, "valid")[begin : bands - 2].min()
    on = (loud > floor + 10) & (loud > quiet + 6)
    both = np.flatnonzero(on[1:] & on[:-1]) + 1
    both = both[both > begin]
    return float(((both[-1] if len(both) else begin - 1) + 1) * half / bands)


def beyond(m: Moments, cut: dict) -> dict | None:
    """Above a wall: how loud it gets there, how far under the music, and whether it moves with it."""
    half = m.db.shape[1] * m.width
    low, high = cut["fc"] + 700, min(cut["fc"] + 3500, half * 0.98)
    if not cut["wall"] or high - low < 500 or len(m.db) < 8 or m.db.shape[1] < 64:
        return None
    peak, up = m.band(low, high)
    _, under = m.band(cut["fc"] - 2000, cut["fc"] - 500)
    level = _at(peak, 0.99)
    a, b = under - under.mean(), up - up.mean()
    alike = float((a @ b) / np.sqrt((a @ a) * (b @ b) + 1e-30))
    return {"level": level, "below": cut["ref"] - level, "corr": alike, "content": bool(level >= max(cut["ref"] - 45, cut["floor"] + 12) and alike >= 0.3)}


def holes(m: Moments, cut: dict) -> float | None:
    """The share of the louder moments in which the band just under a wall is as empty as above it."""
    half = m.db.shape[1] * m.width
    low, high = min(cut["fc"] + 600, half * 0.95), half * 0.985
    if not cut["wall"] or len(m.db) < 16 or m.db.shape[1] < 64 or high - low < 200:
        return None
    _, music = m.band(1000, 8000)
    _, under = m.band(cut["fc"] - 2000, cut["fc"] - 500)
    _, empty = m.band(low, high)
    loud = music >= _at(music, 0.5)
    return float((under[loud] <= _at(empty, 0.5) + 6).mean()) if loud.any() else None


def decibels(x: np.ndarray, rate: int, size: int = 2048) -> Moments:
    mag = stft(np.asarray(x, float), size, size // 2)
    return Moments(20 * np.log10(mag[:, : size // 2] / (size / 4) + 1e-10), rate / size)


def examined(df: DataFrame, size: int = 2048) -> DataFrame:
    """(id, fc, wall, full, reach, holes, beat0, bar, low, mid, high, peak) of sounds (id, rate, pcm, bpm); nulls where a
    sound is too short or silent. The grid is for the row's bpm."""

    def one(r):
        x = np.asarray(r.pcm if r.pcm is not None else [], float)
        m = decibels(x, r.rate, size)
        w = waveform(x, r.rate)
        if not len(m.db) or not x.any():
            return r.id, None, None, None, None, None, None, None, *(v.tolist() for v in w.values())
        cut = cutoff(Levels(10 * np.log10((10 ** (m.db / 10)).mean(0) + 1e-30), m.width))
        hop = 256
        env = onsets(stft(x, 1024, hop))
        first, bar = beat_grid(env, r.rate / hop, ONSET_LAG * 1024 / r.rate, r.bpm, np.maximum(w["low"], w["peak"]).astype(float)) if r.bpm and r.bpm > 0 else (None, None)
        return r.id, cut["fc"], cut["wall"], bool(cut["full"]), reach(m), holes(m, cut), first, bar, *(v.tolist() for v in w.values())

    kind = df.schema["id"].dataType.simpleString()
    names = ["id", "fc", "wall", "full", "reach", "holes", "beat0", "bar", "low", "mid", "high", "peak"]
    return df.mapInPandas(_per_row(one, names), f"id {kind}, fc double, wall boolean, full boolean, reach double, holes double, beat0 double, bar int, low array<int>, mid array<int>, high array<int>, peak array<int>")
