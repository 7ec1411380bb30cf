"""Signal kernels in numpy and the Arrow-batched operator that applies them to signals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Analysis grid and bands in Hz.
RATE, LENGTH, HOP = 16000, 400, 160
ALPHA, LHR, SPI_CUT, ROLLOFF = ((1000, 5000), (50, 1000)), ((0, 1000), (3000, 8000)), 4000, 0.85
PITCH = {"M": (75.0, 300.0), "F": (100.0, 500.0)}
CEILING = {"M": 5000.0, "F": 5500.0}


def frame_matrix(x: np.ndarray, length: int = LENGTH, hop: int = HOP) -> np.ndarray:
    if len(x) < length:
        return np.empty((0, length))
    return np.lib.stride_tricks.sliding_window_view(x, length)[::hop]


def emphasise(x: np.ndarray, c: float = 0.97) -> np.ndarray:
    return np.concatenate([x[:1], x[1:] - c * x[:-1]])


def power_spectrum(x: np.ndarray, rate: int = RATE, length: int = LENGTH, hop: int = HOP) -> tuple[np.ndarray, np.ndarray]:
    """Squared magnitudes of periodic-Hann frames of the pre-emphasised signal, and their frequencies."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)
    return np.abs(np.fft.rfft(frame_matrix(emphasise(x), length, hop) * window, axis=1)) ** 2, np.fft.rfftfreq(length, 1 / rate)


def frame_rms(x: np.ndarray, length: int = LENGTH, hop: int = HOP) -> np.ndarray:
    return np.sqrt((frame_matrix(x, length, hop) ** 2).mean(1))


def spectral(x: np.ndarray, rate: int = RATE, length: int = LENGTH, hop: int = HOP) -> dict[str, np.ndarray]:
    """Spectral features of every frame."""
    p, f = power_spectrum(x, rate, length, hop)
    tiny = 1e-12
    q = p / (p.sum(1, keepdims=True) + tiny)
    mu = q @ f
    dev = f[None] - mu[:, None]
    sd = np.sqrt((q * dev**2).sum(1)) + tiny
    band = lambda lo, hi: p[:, (f >= lo) & (f < hi)].sum(1)
    run = np.cumsum(p, 1)
    high = f >= 2000
    mag = np.sqrt(p)
    return {
        "spectral_skewness": (q * dev**3).sum(1) / sd**3,
        "spectral_kurtosis": (q * dev**4).sum(1) / sd**4,
        "spectral_entropy": -(q * np.log(q + tiny)).sum(1),
        "spectral_rolloff": f[(run >= ROLLOFF * run[:, -1:]).argmax(1)] if len(p) else np.empty(0),
        "spectral_flux": np.concatenate([np.full(min(1, len(p)), np.nan), np.sqrt((np.diff(mag, axis=0) ** 2).sum(1))]),
        "alpha_ratio": band(*ALPHA[0]) / (band(*ALPHA[1]) + tiny),
        "LHR": band(*LHR[0]) / (band(*LHR[1]) + tiny),
        "SPI": p[:, f >= SPI_CUT].sum(1) / (p[:, f < SPI_CUT].sum(1) + tiny),
        "SSPF": f[high][p[:, high].argmax(1)] if high.any() and len(p) else np.full(len(p), np.nan),
        "RMS": frame_rms(x, length, hop),
    }


def burg(x: np.ndarray, order: int) -> np.ndarray:
    """Prediction polynomial [1, a1, ...] by Burg's recursion; [1, 0, ...] for input that is too short or silent."""
    a = np.zeros(order + 1)
    a[0] = 1
    if len(x) <= order or not np.any(x):
        return a
    f, b = x[1:].astype(float), x[:-1].astype(float)
    for m in range(1, order + 1):
        den = f @ f + b @ b
        k = -2 * (f @ b) / den if den > 0 else 0.0
        a[1 : m + 1] += k * a[m - 1 :: -1][:m]
        f, b = (f + k * b)[1:], (b + k * f)[:-1]
    return a


def poles(a: np.ndarray, rate: int = RATE) -> list[tuple[float, float]]:
    """(frequency, bandwidth) of the complex poles in the upper half plane, by frequency."""
    r = np.roots(a)
    r = r[(r.imag > 1e-9) & (np.abs(r) < 1)]
    return sorted((float(np.angle(z) * rate / (2 * np.pi)), float(-np.log(np.abs(z)) * rate / np.pi)) for z in r if np.abs(z) > 0)


def match_formants(known: list[float], found: list[tuple[float, float]], ceiling: float, most: float = 300.0, widest: float = 1000.0) -> tuple[list[float], float, float]:
    """Bandwidth of the nearest unused pole within `most` Hz of each known formant; frequency and bandwidth of the lowest unused narrow pole above the last of them."""
    used, widths = set(), []
    for f in known:
        near = min(((abs(p - f), k) for k, (p, _) in enumerate(found) if k not in used), default=(np.inf, -1))
        ok = np.isfinite(f) and near[0] <= most
        widths.append(found[near[1]][1] if ok else np.nan)
        used |= {near[1]} if ok else set()
    top = known[-1] if known and np.isfinite(known[-1]) else np.nan
    rest = [(p, b) for k, (p, b) in enumerate(found) if k not in used and p > top and p <= ceiling and b < widest]
    return widths, *(rest[0] if rest else (np.nan, np.nan))


def _filtered(b: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.convolve(x, b)[: len(x)]


def _integrated(x: np.ndarray, leak: float = 0.99) -> np.ndarray:
    """y[t] = x[t] + leak y[t-1], in blocks."""
    n = min(len(x), 2000)
    kernel = leak ** np.arange(n)
    out, carry = np.empty(len(x)), 0.0
    for at in range(0, len(x), n):
        part = np.convolve(x[at : at + n], kernel)[: min(n, len(x) - at)]
        part = part + carry * leak ** np.arange(1, len(part) + 1)
        out[at : at + n] = part
        carry = part[-1]
    return out


def _highpass(x: np.ndarray, cut: float, rate: int) -> np.ndarray:
    """Second-order Butterworth with zero phase, in the frequency domain."""
    n = 1 << (2 * len(x) - 1).bit_length() if len(x) else 1
    f = np.fft.rfftfreq(n, 1 / rate)
    gain = np.where(f > 0, 1 / (1 + (cut / np.maximum(f, 1e-9)) ** 4), 0)
    return np.fft.irfft(np.fft.rfft(x, n) * gain, n)[: len(x)]


def glottal_flow(x: np.ndarray, rate: int = RATE, tract: int = 18, glottis: int = 4, rounds: int = 2, leak: float = 0.99) -> np.ndarray:
    """Glottal flow by iterative adaptive inverse filtering (Alku 1992)."""
    s = _highpass(np.asarray(x, float), 40.0, rate)
    w = np.hanning(len(s)) if len(s) else s
    source = burg(s * w, 1)
    flow = s
    for k in range(rounds):
        vt = burg(_filtered(source, s) * w, tract)
        flow = _integrated(_filtered(vt, s), leak)
        if k + 1 < rounds:
            source = burg(flow * w, glottis)
    return flow


def pitch(x: np.ndarray, sex: str = "M", rate: int = RATE, hop: int = HOP, voicing: float = 0.45) -> np.ndarray:
    """F0 of frames by the autocorrelation of the windowed signal divided by the window's (Boersma 1993); NaN where unvoiced."""
    low, high = PITCH.get(sex, (75.0, 500.0))
    n = int(3 * rate / low)
    fr = frame_matrix(np.asarray(x, float), n, hop)
    if not len(fr):
        return np.empty(0)
    w = np.hanning(n)
    size = 1 << (2 * n).bit_length()
    ac = lambda y: np.fft.irfft(np.abs(np.fft.rfft(y, size)) ** 2, size)[..., :n]
    r = ac((fr - fr.mean(1, keepdims=True)) * w)
    r = r / np.maximum(r[:, :1], 1e-12) / np.maximum(ac(w) / ac(w)[0], 1e-3)
    lo, hi = int(rate / high), min(int(rate / low), n // 2)
    part = r[:, lo : hi + 1]
    inner = (part[:, 1:-1] >= part[:, :-2]) & (part[:, 1:-1] >= part[:, 2:])
    lag = np.arange(lo + 1, hi)
    strength = np.where(inner, part[:, 1:-1] - 0.01 * np.log2(low * lag / rate), -np.inf)
    k = strength.argmax(1)
    at = k + lo + 1
    i = np.arange(len(r))
    a, b, c = r[i, at - 1], r[i, at], r[i, at + 1]
    shift = np.where(np.abs(a - 2 * b + c) > 1e-12, 0.5 * (a - c) / np.where(np.abs(a - 2 * b + c) > 1e-12, a - 2 * b + c, 1), 0)
    loud = np.abs(fr).max(1) > 0.03 * max(np.abs(x).max(initial=0), 1e-12)
    return np.where((b > voicing) & loud & np.isfinite(strength[i, k]), rate / (at + shift), np.nan)


def pulses(x: np.ndarray, f0: float, rate: int = RATE) -> np.ndarray:
    """Sample numbers of glottal pulses: the largest extreme, then maxima one period away on either side."""
    t = rate / f0
    half = max(1, int(0.25 * t))
    first = int(np.argmax(np.abs(x)))
    sign = np.sign(x[first]) or 1
    out = [first]
    for way in (1, -1):
        at = first
        while 0 <= (mid := int(at + way * t)) - half and mid + half < len(x):
            at = mid - half + int(np.argmax(sign * x[mid - half : mid + half + 1]))
            out.append(at)
    return np.array(sorted(set(out)))


def perturbation(x: np.ndarray, f0: float, rate: int = RATE, least: int = 5) -> tuple[float, float]:
    """Local jitter and shimmer of a voiced segment: mean absolute difference of consecutive periods (amplitudes) over their mean; NaN below `least` pulses."""
    at = pulses(x, f0, rate)
    if len(at) < least:
        return np.nan, np.nan
    t, a = np.diff(at) / rate, np.abs(x[at])
    ok = (t > 1e-4) & (t < 0.02)
    pairs = ok[1:] & ok[:-1] & (np.maximum(t[1:], t[:-1]) / np.maximum(np.minimum(t[1:], t[:-1]), 1e-9) < 1.3)
    amps = np.maximum(a[1:], a[:-1]) / np.maximum(np.minimum(a[1:], a[:-1]), 1e-12) < 1.6
    return (np.abs(np.diff(t))[pairs].mean() / t[ok].mean() if pairs.any() else np.nan), (np.abs(np.diff(a))[amps].mean() / a.mean() if amps.any() else np.nan)


def cepstral_peak(x: np.ndarray, rate: int = RATE, length: int = 1024, hop: int = HOP, low: float = 60.0, high: float = 330.0) -> np.ndarray:
    """Cepstral peak prominence of frames in dB: the peak above the regression line (Hillenbrand 1994)."""
    fr = frame_matrix(np.asarray(x, float), length, hop)
    if not len(fr):
        return np.empty(0)
    spec = 10 * np.log10(np.abs(np.fft.rfft(fr * np.hanning(length), axis=1)) ** 2 + 1e-12)
    cep = np.abs(np.fft.irfft(spec, axis=1))[:, : length // 2]
    db = 20 * np.log10(cep + 1e-12)
    q = np.arange(length // 2) / rate
    fit = slice(int(0.001 * rate), length // 2)
    a = np.c_[q[fit], np.ones(len(q[fit]))]
    line = np.linalg.lstsq(a, db[:, fit].T, rcond=None)[0]
    zone = np.arange(int(rate / high), min(int(rate / low), length // 2))
    k = zone[db[:, zone].argmax(1)]
    i = np.arange(len(db))
    return db[i, k] - (line[0] * q[k] + line[1])


def harmonics(power: np.ndarray, freqs: np.ndarray, f0: float, top: float = 5000.0) -> tuple[float, float]:
    """Inharmonicity and subharmonic-to-harmonic ratio of one frame; NaN with fewer than two harmonics."""
    if not np.isfinite(f0) or f0 <= 0 or (n := int(min(top, freqs[-1]) // f0)) < 2:
        return np.nan, np.nan
    mag, off, sub, har = np.sqrt(power), [], 0.0, 0.0
    at = lambda f: mag[int(np.argmin(np.abs(freqs - f)))]
    for k in range(1, n + 1):
        near = np.flatnonzero((freqs >= k * 0.9 * f0) & (freqs <= k * 1.1 * f0))
        if not near.size:
            continue
        best = near[mag[near].argmax()]
        off.append(abs(freqs[best] - k * f0))
        har += mag[best]
        sub += at((k - 0.5) * f0)
    return (float(np.mean(off)) if off else np.nan), float(sub / (har + 1e-12))


def noise_excitation(x: np.ndarray, rate: int = RATE, width: float = 1000.0, step: float = 300.0, low: float = 300.0, high: float = 4000.0) -> float:
    """Glottal-to-noise excitation ratio: largest correlation of Hilbert envelopes of bands at least half a band apart (Michaelis 1997)."""
    r = _filtered(burg(np.asarray(x, float), 13), np.asarray(x, float))
    n = len(r)
    if n < 64:
        return np.nan
    spec, f = np.fft.fft(r), np.fft.fftfreq(n, 1 / rate)
    centres, env = np.arange(low + width / 2, high - width / 2 + 1, step), []
    for c in centres:
        inside = np.abs(f - c) <= width / 2
        w = np.zeros(n)
        w[inside] = 0.5 + 0.5 * np.cos(2 * np.pi * (f[inside] - c) / width)
        env.append(np.abs(np.fft.ifft(2 * spec * w)))
    out = [np.corrcoef(env[a], env[b])[0, 1] for a in range(len(env)) for b in range(a + 1, len(env)) if centres[b] - centres[a] >= width / 2 and env[a].std() > 0 and env[b].std() > 0]
    return float(max(out)) if out else np.nan


def modulation(rms: np.ndarray, speech: np.ndarray, hop_rate: float = 100.0, cut: float = 20.0, least: int = 5) -> float:
    """Coefficient of variation over speech frames of the level below `cut` Hz; NaN below `least` frames."""
    if speech.sum() < least or not len(rms):
        return np.nan
    spec = np.fft.rfft(rms)
    spec[np.fft.rfftfreq(len(rms), 1 / hop_rate) >= cut] = 0
    low = np.fft.irfft(spec, len(rms))[speech]
    return float(low.std() / low.mean()) if low.mean() > 0 else np.nan


def glottal_cycle(u: np.ndarray, rate: int = RATE) -> dict[str, float]:
    """Parameters of one cycle of glottal flow between two closures (at least 4 samples)."""
    if len(u) < 4:
        return dict.fromkeys(("GCT", "CQ", "NAQ", "MFDR", "SQ"), np.nan)
    span, fall = u.max() - u.min(), float(np.max(-np.diff(u)) * rate)
    t0, closed, top = len(u) / rate, int((u < u.min() + 0.1 * span).sum()), int(u.argmax())
    low = int(u.argmin())
    return {"GCT": closed / rate * 1000, "CQ": closed / len(u), "NAQ": float(span / (fall * t0)) if fall > 0 else np.nan, "MFDR": fall, "SQ": (top - low) / (len(u) - top) if top > low else np.nan}


def glottal_params(x: np.ndarray, f0: float, rate: int = RATE) -> dict[str, float]:
    """Mean cycle parameters of a voiced stretch; closures are the steepest falls of the flow, a period apart."""
    u = glottal_flow(x, rate)
    if len(u) < 8 or not np.isfinite(f0):
        return dict.fromkeys(("GCT", "CQ", "NAQ", "MFDR", "SQ"), np.nan)
    at = pulses(-np.diff(u), f0, rate)
    cycles = pd.DataFrame([glottal_cycle(u[a:b], rate) for a, b in zip(at[:-1], at[1:], strict=True)])
    return {k: float(cycles[k].mean()) if len(cycles) else np.nan for k in ("GCT", "CQ", "NAQ", "MFDR", "SQ")}


def bandwidth(x: np.ndarray, rate: int = RATE, floor_db: float = -30.0) -> float:
    """Highest frequency whose mean power lies within floor_db of the strongest."""
    p, f = power_spectrum(np.asarray(x, float), rate)
    if not len(p):
        return np.nan
    m = p.mean(0)
    return float(f[np.flatnonzero(m >= m.max() * 10 ** (floor_db / 10))[-1]]) if m.max() > 0 else np.nan


def apply(signals: DataFrame, kernel: Callable[[np.ndarray], list[dict]], schema: str) -> DataFrame:
    """kernel(samples) gives rows for each signal (utt_id, samples); a signal that fails gives one row with `error`.

    schema: the kernel's columns as DDL; utt_id and error are added. Batches pass through Arrow, nothing is shuffled.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for utt, samples in zip(batch["utt_id"], batch["samples"], strict=True):
                try:
                    rows += [{"utt_id": utt, "error": None} | r for r in kernel(np.asarray(samples, float))]
                except Exception as e:  # a signal never fails its batch; the row says why
                    rows.append({"utt_id": utt, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=["utt_id", *names, "error"])

    return signals.select("utt_id", "samples").mapInPandas(run, f"utt_id long, {schema}, error string")
