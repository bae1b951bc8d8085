"""Audio measurement and processing: numpy per stream, parallel over streams.

A recursive filter can't be split within a stream, so one stream is one group, handled in order.
What is closed-form (gating, gain plans, response curves) stays in DataFrame functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ABSOLUTE_GATE, RELATIVE_GATE, OFFSET = -70.0, -10.0, -0.691
NYQUIST_SHARE = 0.45


@dataclass(frozen=True)
class Band:
    kind: str  # peaking, low_shelf, high_shelf, low_pass, high_pass
    freq: float
    gain_db: float = 0.0
    q: float = 0.707


def design(band: Band, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of the public audio-EQ cookbook; shelves read q as a slope, frequencies are capped below Nyquist."""
    amp = 10 ** (band.gain_db / 40)
    w = 2 * math.pi * min(band.freq, rate * NYQUIST_SHARE) / rate
    c, s = math.cos(w), math.sin(w)
    alpha = s / (2 * band.q)
    if band.kind == "peaking":
        b, a = (1 + alpha * amp, -2 * c, 1 - alpha * amp), (1 + alpha / amp, -2 * c, 1 - alpha / amp)
    elif band.kind in ("low_shelf", "high_shelf"):
        turn = 1.0 if band.kind == "low_shelf" else -1.0  # a high shelf is a low one with the cosine's sign turned
        slope = min(max(band.q, 0.1), 3.0)
        root = 2 * math.sqrt(amp) * (s / 2) * math.sqrt((amp + 1 / amp) * (1 / slope - 1) + 2)
        up, down, t = amp + 1, amp - 1, turn * c
        b = (amp * (up - down * t + root), 2 * amp * turn * (down - up * t), amp * (up - down * t - root))
        a = (up + down * t + root, -2 * turn * (down + up * t), up + down * t - root)
    elif band.kind == "low_pass":
        b, a = ((1 - c) / 2, 1 - c, (1 - c) / 2), (1 + alpha, -2 * c, 1 - alpha)
    else:
        b, a = ((1 + c) / 2, -(1 + c), (1 + c) / 2), (1 + alpha, -2 * c, 1 - alpha)
    return np.array(b) / a[0], np.array(a) / a[0]


def biquad(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """One second-order section over frames (n, channels)."""
    y, z1, z2 = np.empty_like(x), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    b0, b1, b2, a1, a2 = *b, a[1], a[2]
    for i in range(len(x)):
        y[i] = b0 * x[i] + z1
        z1 = b1 * x[i] - a1 * y[i] + z2
        z2 = b2 * x[i] - a2 * y[i]
    return y


def equalised(x: np.ndarray, rate: int, bands: list[Band]) -> np.ndarray:
    for band in bands:
        x = biquad(x, *design(band, rate))
    return x


def k_weighted(x: np.ndarray, rate: int) -> np.ndarray:
    return equalised(x, rate, [Band("high_shelf", 1681.974, 3.9868, 0.70718), Band("high_pass", 60.4137, 0.0, 0.50033)])


def block_energies(x: np.ndarray, rate: int) -> np.ndarray:
    """Mean squares of 400 ms blocks every 100 ms, summed over channels; the last block is padded with silence."""
    size, hop = int(rate * 0.4), int(rate * 0.1)
    if not len(x):
        return np.zeros(0)
    n = max(1, math.ceil(max(0, len(x) - size) / hop) + 1)
    total = np.concatenate([[0.0], np.cumsum((x * x).sum(axis=1))])
    at = np.arange(n) * hop
    return (total[np.minimum(at + size, len(x))] - total[np.minimum(at, len(x))]) / size


def gated_loudness(energies: DataFrame, stream: str, energy: str) -> DataFrame:
    """Integrated loudness per stream: blocks over the absolute gate, then over their mean less 10; null for silence."""
    floor = 10 ** ((ABSOLUTE_GATE - OFFSET) / 10)
    mean = energies.where(F.col(energy) > floor).groupBy(stream).agg(F.avg(energy).alias("__m"))
    loud = lambda m: OFFSET + 10 * F.log10(m)
    gate = F.pow(F.lit(10.0), (loud(F.col("__m")) + RELATIVE_GATE - OFFSET) / 10)
    kept = energies.join(mean, stream).where((F.col(energy) > floor) & (F.col(energy) > gate))
    result = kept.groupBy(stream).agg(loud(F.avg(energy)).alias("lufs"))
    return energies.select(stream).distinct().join(result, stream, "left")


def planned_gain_db(wanted: Column, peak: Column, boost: Column, least: float = -24.0, margin: float = 1.0) -> Column:
    """The gain that reaches the target without the peak passing full scale."""
    room = -20 * F.log10(peak) - boost - margin
    return F.when(peak <= 1e-6, wanted).otherwise(F.greatest(F.least(wanted, room), F.lit(least)))


def response_db(freq: Column, band: Band, rate: int) -> Column:
    """Gain of a band at a frequency, in closed form."""
    b, a = design(band, rate)
    w = 2 * math.pi * freq / rate

    def power(k):
        re, im = k[0] + k[1] * F.cos(w) + k[2] * F.cos(2 * w), k[1] * F.sin(w) + k[2] * F.sin(2 * w)
        return re * re + im * im

    return 10 * F.log10(power([float(v) for v in b]) / power([float(v) for v in a]))


def worst_boost_db(spark, bands: list[Band], rate: int, points: int = 512, low: float = 20.0, high: float = 20_000.0) -> DataFrame:
    """The greatest total gain over a logarithmic grid, 0 at least."""
    f = F.lit(low) * F.pow(F.lit(high / low), F.col("id") / (points - 1))
    total = F.lit(0.0)
    for band in bands:
        total = total + response_db(f, band, rate)
    return spark.range(points).agg(F.greatest(F.lit(0.0), F.max(total)).alias("boost_db"))


def crossfed(x: np.ndarray, rate: int, feed_db: float = 4.5, cutoff: float = 700.0) -> np.ndarray:
    """Stereo: each side through a high shelf, plus the other side's low-pass."""
    if x.shape[1] != 2:
        return x
    low_db, high_db = feed_db * -5 / 6 - 3, feed_db / 6 - 3
    g_low, g_high = 10 ** (low_db / 20), 1 - 10 ** (high_db / 20)
    cut_high = cutoff * 2 ** ((low_db - 20 * math.log10(g_high)) / 12)
    p, q = math.exp(-2 * math.pi * cutoff / rate), math.exp(-2 * math.pi * cut_high / rate)
    one = np.array([1.0, 0.0, 0.0])
    low = biquad(x, one * g_low * (1 - p), np.array([1.0, -p, 0.0]))
    high = biquad(x, np.array([1 - g_high * (1 - q), -q, 0.0]), np.array([1.0, -q, 0.0]))
    return (high + low[:, ::-1]) / (1 - g_high + g_low)


def resampled(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """Cubic (Catmull-Rom) through four frames; the ends repeat."""
    if source == target or not len(x):
        return x
    n = int(len(x) * target // source)
    at = np.arange(n) * (source / target)
    i = at.astype(int)
    t = (at - i)[:, None]
    p = [x[np.clip(i + k, 0, len(x) - 1)] for k in (-1, 0, 1, 2)]
    return p[1] + 0.5 * t * (p[2] - p[0] + t * (2 * p[0] - 5 * p[1] + 4 * p[2] - p[3] + t * (3 * (p[1] - p[2]) + p[3] - p[0])))


def stretched(x: np.ndarray, rate: int, speed: float) -> np.ndarray:
    """Waveform-similarity overlap-add: 25 ms frames, the best continuation within 10 ms; pitch stays."""
    frame, reach = int(rate * 0.025) & ~1, int(rate * 0.01)
    hop = frame // 2
    if speed == 1.0 or len(x) < frame + reach + hop:
        return x
    fade = 0.5 - 0.5 * np.cos(np.pi * (np.arange(hop) + 0.5) / hop)[:, None]
    mono, out, at = x.mean(axis=1), [x[:hop]], 0
    k = 1
    while True:
        ideal = int(k * hop * speed)
        if ideal + reach + frame > len(x) or at + frame > len(x):
            break
        wanted = mono[at + hop : at + frame]
        lo = max(0, ideal - reach)
        view = np.lib.stride_tricks.sliding_window_view(mono[lo : ideal + reach + hop], hop)
        score = view @ wanted / np.sqrt((view * view).sum(axis=1) + 1e-9)
        best = lo + int(score.argmax())
        out.append(x[at + hop : at + frame] * fade[::-1] + x[best : best + hop] * fade)
        at, k = best, k + 1
    return np.concatenate([*out, x[at + hop :][: hop]])


def limited(x: np.ndarray, rate: int, ceiling: float = 0.98, ahead_ms: float = 5.0, release_ms: float = 60.0) -> np.ndarray:
    """Gain falls to the least that the next 5 ms need, at once, and recovers with a 60 ms time constant."""
    if not len(x):
        return x
    peak = np.abs(x).max(axis=1)
    need = np.minimum(1.0, ceiling / np.maximum(peak, 1e-12))
    n = int(rate * ahead_ms / 1000)
    target = np.lib.stride_tricks.sliding_window_view(np.concatenate([need, np.ones(n)]), n + 1).min(axis=1)
    up, gain, g = 1 - math.exp(-1 / (rate * release_ms / 1000)), np.empty(len(x)), 1.0
    for i, t in enumerate(target):
        g = min(t, g + (1 - g) * up)
        gain[i] = g
    return x * gain[:, None]


def ramped(x: np.ndarray, start: float, target: float, frames: int) -> np.ndarray:
    """Linear gain from start to target over a number of frames, then steady."""
    g = np.minimum(1.0, (np.arange(len(x)) + 1) / max(1, frames))
    return x * (start + (target - start) * g)[:, None]


def meter(x: np.ndarray, rate: int, chunk: int, tau: float = 1.5, gate: float = 1e-7) -> np.ndarray:
    """Smoothed mean square after each chunk; silence leaves it where it is."""
    out, ms, begun = [], 0.0, False
    for i in range(0, len(x), chunk):
        part = x[i : i + chunk]
        now = float((part * part).mean(axis=0).sum())
        if now >= gate:
            ms = ms + (1 - math.exp(-len(part) / rate / tau)) * (now - ms) if begun else now
            begun = True
        out.append(ms)
    return np.array(out)


def saturated(x: np.ndarray, drive: float = 2.0, factor: int = 4) -> np.ndarray:
    """A soft curve at ``factor`` times the rate (windowed-sinc filters), scaled to leave small signals alone."""
    taps = np.sinc(np.arange(-32, 33) / factor) * np.kaiser(65, 8.0)
    up = np.zeros((len(x) * factor, x.shape[1]))
    up[::factor] = x
    smooth = np.stack([np.convolve(c, taps, "same") for c in up.T], axis=1) if len(x) else up
    bent = np.tanh(drive * smooth) / drive
    low = taps / taps.sum()
    return np.stack([np.convolve(c, low, "same")[::factor] for c in bent.T], axis=1) if len(x) else x


def decimated(bits: np.ndarray, ratio: int, stop_db: float = 75.0) -> np.ndarray:
    """1-bit samples (n, channels of 0/1) to PCM: a Kaiser-windowed sinc of odd length and unit gain, one output per ``ratio`` bits."""
    width = 0.5 / ratio
    beta = 0.1102 * (stop_db - 8.7)
    n = int(min(2047, max(65, math.ceil((stop_db - 8) / (2.285 * 2 * math.pi * width / 2))))) | 1
    t = np.arange(n) - n // 2
    h = np.sinc(t * width * 1.5) * np.kaiser(n, beta)
    h /= h.sum()
    x = bits.astype(float) * 2 - 1
    return np.stack([np.convolve(c, h, "same")[::ratio] for c in x.T], axis=1)


def dsd_bits(data: bytes, channels: int, lsb_first: bool) -> np.ndarray:
    """(n, channels) of 0/1 from byte-interleaved 1-bit audio."""
    raw = np.frombuffer(data, dtype=np.uint8)
    raw = raw[: len(raw) // channels * channels].reshape(-1, channels)
    return np.stack([np.unpackbits(raw[:, c], bitorder="little" if lsb_first else "big") for c in range(channels)], axis=1)


CHAIN = ("resample", "stretch", "crossfeed", "eq", "preamp", "analog", "gain", "volume", "limiter", "guard")


def processed(x: np.ndarray, rate: int, settings: dict) -> np.ndarray:
    """The whole chain in its fixed order; a missing setting leaves its stage out."""
    steps = {
        "resample": lambda v, s: resampled(v, rate, s),
        "stretch": lambda v, s: stretched(v, rate, s),
        "crossfeed": lambda v, s: crossfed(v, rate, **s),
        "eq": lambda v, s: equalised(v, rate, s),
        "preamp": lambda v, s: v * 10 ** (s / 20),
        "analog": lambda v, s: saturated(v, s),
        "gain": lambda v, s: v * 10 ** (s / 20),
        "volume": lambda v, s: v * s,
        "limiter": lambda v, s: limited(v, rate, s),
        "guard": lambda v, s: np.clip(v, -s, s),
    }
    for name in CHAIN:
        if name in settings:
            x = steps[name](x, settings[name])
            rate = settings[name] if name == "resample" else rate
    return x


def per_stream(blocks: DataFrame, work, schema: str) -> DataFrame:
    """``work(frames, rate) -> rows`` once per stream. ``blocks``: stream, block_no, channels, sample_rate, samples (array<float>, interleaved)."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block_no")
        x = np.concatenate([np.asarray(s, dtype=float) for s in pdf["samples"]]).reshape(-1, int(pdf["channels"].iloc[0]))
        return pd.DataFrame([(key[0], *r) for r in work(x, int(pdf["sample_rate"].iloc[0]))], columns=columns)

    return blocks.groupBy("stream").applyInPandas(run, schema)


def measured_energies(blocks: DataFrame) -> DataFrame:
    """(stream, block, energy) of K-weighted 400 ms blocks."""
    return per_stream(blocks, lambda x, r: enumerate(block_energies(k_weighted(x, r), r).tolist()), "stream long, block long, energy double")
