"""Waveforms, grids and cut-offs on sounds whose answer is known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalune.operators import signals, sound


def slow_biquad(x, sr, high, f0):
    w = 2 * np.pi * f0 / sr
    c, al = np.cos(w), np.sin(w) / (2 * np.sqrt(0.5))
    b0 = (1 + c) / 2 if high else (1 - c) / 2
    b = (b0, -(1 + c) if high else 1 - c, b0)
    y = np.zeros(len(x))
    for i in range(len(x)):
        past = lambda v, k: v[i - k] if i >= k else 0.0  # noqa: B023, E731
        y[i] = (b[0] * x[i] + b[1] * past(x, 1) + b[2] * past(x, 2) + 2 * c * past(y, 1) - (1 - al) * past(y, 2)) / (1 + al)
    return y


@pytest.mark.parametrize("high,edge", [(False, 200.0), (True, 2500.0)])
def test_filters_are_the_recursion(high, edge):
    x = np.random.default_rng(1).normal(size=3000)
    want = slow_biquad(slow_biquad(x, 8000, high, edge), 8000, high, edge)
    assert np.abs(sound.filtered(x, 8000, edge, high) - want).max() < 1e-6


def test_bands_of_a_waveform():
    sr = 8000
    t = np.arange(sr * 2) / sr
    w = sound.waveform(np.where(t < 1, np.sin(2 * np.pi * 60 * t), np.sin(2 * np.pi * 3500 * t)), sr)
    assert len(w["low"]) == 300 and w["low"][20:140].min() > 200 and w["low"][170:].max() < 20 and w["high"][20:140].max() < 20 and w["high"][170:290].min() > 200
    assert {k: len(v) for k, v in sound.waveform(np.zeros(0), sr).items()} == {k: 1 for k in w}


@pytest.mark.parametrize("bpm,first,bar", [(120.0, 0.21, 0), (97.0, 0.05, 2)])
def test_grid_of_clicks(bpm, first, bar):
    fps, n = 100.0, 3000
    env, level = np.zeros(n), np.zeros(int(n / fps * sound.POINTS))
    for k in range(int((n / fps - first) / (60 / bpm))):
        f = (first + k * 60 / bpm) * fps
        env[int(f)] += 1 - f % 1
        env[int(f) + 1] += f % 1
        level[int(f / fps * sound.POINTS + 0.5) :][:3] = 2.0 if k % 4 == bar else 1.0
    got, at = sound.beat_grid(env, fps, 0.0, bpm, level)
    assert abs(got - first) < 0.004 and at == bar
    assert sound.beat_grid(env[:50], fps, 0.0, bpm) == (0.0, 0)


def cut_noise(sr, edge, seconds=4):
    rng = np.random.default_rng(3)
    spec = np.fft.rfft(rng.normal(size=sr * seconds))
    spec[np.fft.rfftfreq(sr * seconds, 1 / sr) > edge] = 0
    return np.fft.irfft(spec) + 3e-3 * rng.normal(size=sr * seconds)


@pytest.mark.parametrize("edge", [15000, 18600])
def test_cutoff_of_cut_noise(edge):
    m = sound.decibels(cut_noise(44100, edge), 44100)
    cut = sound.cutoff(sound.Levels(10 * np.log10((10 ** (m.db / 10)).mean(0)), m.width))
    assert cut["wall"] and abs(cut["fc"] - edge) < 150 and cut["drop"] > 40 and not cut["full"]
    assert sound.holes(m, cut) == 0.0 and not sound.beyond(m, cut)["content"]
    quiet = m.db.copy()
    under = slice(int((cut["fc"] - 2100) / m.width), None)
    quiet[::2, under] = quiet[:, -40:].mean()
    assert abs(sound.holes(sound.Moments(quiet, m.width), cut) - 0.5) < 0.2


def test_full_noise_and_mirrors():
    flat = np.full(1024, -40.0)
    flat[300:380] = -120  # the floor is the quietest part, here a gap far below the end
    assert sound.cutoff(sound.Levels(flat, 22050 / 1024))["full"]
    n = 2048
    hz = np.arange(n) * 48000 / n
    shape = -40 - 30 * np.minimum(hz, 44100 - np.minimum(hz, 44100)) / 22050 + 3 * np.sin(np.minimum(hz, np.abs(44100 - hz)) / 700)
    shape[hz > 44100 - 2000] = -130
    assert sound.cutoff(sound.Levels(shape, 48000 / n))["mirror"] == 44100
    assert sound.cutoff(sound.Levels(-40 - hz / 600, 48000 / n))["mirror"] is None


def test_reach_counts_what_comes_and_goes():
    rng = np.random.default_rng(5)
    db = -100 + rng.normal(size=(200, 256))
    db[::3, :180] += 40  # bursts up to 180 of 256 bins
    db[:, 220:] += 30  # steady noise above
    assert abs(sound.reach(sound.Moments(db, 22050 / 256)) - 180 / 256 * 22050) < 350
    assert sound.reach(sound.Moments(np.zeros((0, 256)), 1.0)) is None


def test_examined(spark):
    d = signals.tones(spark.createDataFrame([(1, 440.0, 120.0)], "id int, hz double, bpm double")).withColumn("bpm", F.lit(120.0))
    empty = spark.createDataFrame([(2, 8000, [], 120.0), (3, 8000, None, None)], "id int, rate int, pcm array<float>, bpm double")
    got = {r["id"]: r for r in sound.examined(d.unionByName(empty)).collect()}
    beat = got[1]["beat0"] % 0.5
    assert min(beat, 0.5 - beat) < 0.05 and len(got[1]["low"]) == 1200 and got[2]["fc"] is None and got[3]["low"] == [0]
