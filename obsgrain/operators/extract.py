"""Utterance-level features: frame contours, masks by phone class, guarded aggregates, timing; one row an utterance, never an exception."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from obsgrain.operators import kernels, segments

#: Features in order, with the frames they are taken over and how they are aggregated.
FEATURES = {
    "F0": ("voiced", "median"), "jitter": ("voiced", "mean"), "shimmer": ("voiced", "mean"), "GCT": ("voiced", "mean"), "CQ": ("voiced", "mean"), "MFDR": ("voiced", "mean"), "SQ": ("voiced", "mean"), "NAQ": ("voiced", "mean"),
    "SHR": ("voiced", "mean"), "IHI": ("voiced", "mean"), "VFI": ("voiced", "mean"), "semitone_SD_F0": ("voiced", "sd_semitone"), "F1": ("sonorant", "median"), "F2": ("sonorant", "median"), "F3": ("sonorant", "median"),
    "F4": ("sonorant", "median"), "F5": ("sonorant", "median"), "B1": ("sonorant", "median"), "B2": ("sonorant", "median"), "B3": ("sonorant", "median"), "B4": ("sonorant", "median"), "B5": ("sonorant", "median"),
    "Nasality": ("sonorant", "mean"), "spectral_skewness": ("speech", "mean"), "spectral_kurtosis": ("speech", "mean"), "spectral_entropy": ("speech", "mean"), "spectral_rolloff": ("speech", "mean"), "spectral_flux": ("speech", "mean"),
    "alpha_ratio": ("speech", "mean"), "LHR": ("speech", "mean"), "SPI": ("speech", "mean"), "GNE": ("voiced", "mean"), "SSPF": ("sibilant", "mean"), "CPP": ("voiced", "mean"), "dCPP": ("voiced", "mean"), "RMS": ("speech", "mean"),
    "AMD": ("speech", "mean"), "speech_rate": ("segments", ""), "VOT": ("segments", ""), "BGD": ("segments", ""),
}
LEAST = 5


def aggregate(values: np.ndarray, mask: np.ndarray, kind: str, least: int = LEAST) -> tuple[float, int]:
    """(value, count) over finite frames inside the mask; NaN below `least`."""
    v = values[mask & np.isfinite(values)]
    if kind == "sd_semitone":
        v = v[v > 0]
    if len(v) < least:
        return np.nan, len(v)
    return float({"mean": np.mean, "median": np.median, "sd_semitone": lambda x: np.std(12 * np.log2(x), ddof=1)}[kind](v)), len(v)


def timing(phones: list[tuple[int, int, str]], rate: int) -> dict[str, tuple[float, int]]:
    """Vowels a second of speaking span, mean length of stops after a closure, mean length of runs without silence."""
    loud = [(a, b, x) for a, b, x in phones if x not in segments.SILENCE]
    span = (loud[-1][1] - loud[0][0]) / rate if loud else 0
    vowels = sum(x in segments.PHONE_CLASSES["vowel"] for _, _, x in phones)
    stops = [(b - a) / rate for (_, _, before), (a, b, x) in zip(phones, phones[1:], strict=False) if x in segments.STOPS and before in segments.CLOSURES]
    runs: list[list[int]] = []
    open_run = False
    for a, b, x in phones:
        if x in segments.SILENCE:
            open_run = False
        elif open_run:
            runs[-1][1] = b
        else:
            runs.append([a, b])
            open_run = True
    mean = lambda xs: float(np.mean(xs)) if xs else np.nan
    return {"speech_rate": (vowels / span if span > 0 else np.nan, vowels), "VOT": (mean(stops), len(stops)), "BGD": (mean([(b - a) / rate for a, b in runs]), len(runs))}


def _stretches(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(int), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def contours(x: np.ndarray, rate: int, sex: str, masks: dict[str, np.ndarray], formants: np.ndarray | None, creak: list[tuple[float, float]] | None) -> dict[str, np.ndarray]:
    """Every frame feature on the grid of 400 samples every 160. formants: four frequencies a frame from outside, if there are any."""
    length, hop = kernels.LENGTH, kernels.HOP
    out = kernels.spectral(x, rate, length, hop)
    n = len(out["RMS"])
    centre = np.arange(n) * hop + length // 2

    def on_grid(values: np.ndarray, first: float) -> np.ndarray:
        """A contour with a value every hop from `first` on, at the nearest time; of two as near the later."""
        if not len(values):
            return np.full(n, np.nan)
        return values[np.clip(np.floor((centre - first) / hop + 0.5).astype(int), 0, len(values) - 1)]

    window = int(3 * rate / kernels.PITCH.get(sex, (75.0, 500.0))[0])
    out["F0"] = f0 = on_grid(kernels.pitch(x, sex, rate, hop), window / 2)
    out["CPP"] = cpp = on_grid(kernels.cepstral_peak(x, rate), 512)
    out["dCPP"] = np.concatenate([np.full(min(1, n), np.nan), np.abs(np.diff(cpp))])
    out["semitone_SD_F0"] = f0
    for name in ("jitter", "shimmer", "GCT", "CQ", "NAQ", "MFDR", "SQ", "GNE", "IHI", "SHR", "Nasality", *(f"{c}{k}" for c in "FB" for k in range(1, 6))):
        out[name] = np.full(n, np.nan)
    for a, b in _stretches(masks["voiced"]):
        part, pitch = x[a * hop : (b - 1) * hop + length], np.nanmedian(f0[a:b]) if np.isfinite(f0[a:b]).any() else np.nan
        if not np.isfinite(pitch):
            continue
        out["jitter"][a:b], out["shimmer"][a:b] = kernels.perturbation(part, pitch, rate)
        out["GNE"][a:b] = kernels.noise_excitation(part, rate)
        for name, value in kernels.glottal_params(part, pitch, rate).items():
            out[name][a:b] = value
    power, freqs = kernels.power_spectrum(x, rate, length, hop)
    for k in np.flatnonzero(masks["voiced"] & np.isfinite(f0)):
        out["IHI"][k], out["SHR"][k] = kernels.harmonics(power[k], freqs, f0[k])
    frames, ceiling = kernels.frame_matrix(kernels.emphasise(x), length, hop), kernels.CEILING.get(sex, 5500.0)
    for k in np.flatnonzero(masks["sonorant"]):
        found = kernels.poles(kernels.burg(frames[k] * np.hamming(length), 20), rate)
        own = [p for p in found if p[0] > 90 and p[1] < 1000 and p[0] < ceiling]
        known = list(formants[k]) if formants is not None else [f for f, _ in own[:4]] + [np.nan] * (4 - len(own[:4]))
        widths, f5, b5 = kernels.match_formants(known, found, ceiling)
        for j in range(4):
            out[f"F{j + 1}"][k], out[f"B{j + 1}"][k] = known[j], widths[j]
        out["F5"][k], out["B5"][k] = f5, b5
        if np.isfinite(known[0]):
            near, low = (freqs >= 0.8 * known[0]) & (freqs <= 1.2 * known[0]), (freqs >= 200) & (freqs <= 500)
            if near.any() and low.any():
                out["Nasality"][k] = 10 * np.log10(power[k, near].max() + 1e-12) - 10 * np.log10(power[k, low].max() + 1e-12)
    out["AMD"] = np.full(n, kernels.modulation(out["RMS"], masks["speech"], rate / hop))
    at = centre / rate
    inside = np.zeros(n, bool)
    for a, b in creak or []:
        inside |= (at >= a) & (at < b)
    # creak comes from outside; a voiced utterance without marks has none
    out["VFI"] = np.where(masks["voiced"], inside.astype(float), np.nan)
    return out


def features(x: np.ndarray, phones: list[tuple[int, int, str]], sex: str = "M", rate: int = kernels.RATE, formants: np.ndarray | None = None, creak: list[tuple[float, float]] | None = None) -> dict[str, tuple[float, int]]:
    """(value, coverage) of each feature of one utterance; phones: (start, end, label) in samples, contiguous and ordered."""
    n = len(kernels.frame_matrix(x))
    starts, at = np.array([a for a, _, _ in phones] or [0]), np.arange(n) * kernels.HOP + kernels.LENGTH // 2
    which = np.searchsorted(starts, at, "right") - 1
    label = [phones[k][2] if phones and k >= 0 and at[i] < phones[k][1] else "" for i, k in enumerate(which.tolist())]
    by = {x: c for c, xs in reversed(segments.PHONE_CLASSES.items()) for x in xs}
    kind = np.array([by.get(x, "other") for x in label], dtype=object)
    masks = {name: np.isin(kind, classes) for name, classes in (("voiced", segments.VOICED), ("sonorant", segments.SONORANT), ("speech", segments.SPEECH))} | {"sibilant": np.isin(np.array(label, dtype=object), segments.SIBILANTS)}
    values = contours(np.asarray(x, float), rate, sex, masks, formants, creak)
    out = {name: aggregate(values[name], masks[domain], how) for name, (domain, how) in FEATURES.items() if domain != "segments"} | timing(phones, rate)
    voiced = int(masks["voiced"].sum())
    if not np.isfinite(out["VFI"][0]) and voiced:
        out["VFI"] = (0.0, voiced)  # a voiced utterance always has a share of creak
    return {name: out[name] for name in FEATURES}


def quality(x: np.ndarray, phones: list[tuple[int, int, str]], rate: int = kernels.RATE) -> dict[str, float]:
    """snr_db of speech over silence power (of the 90th over the 10th percentile of 320-sample energies without either), bandwidth_hz, clip_pct."""
    x = np.asarray(x, float)
    power = lambda quiet: np.concatenate([x[a:b] ** 2 for a, b, p in phones if (p in segments.SILENCE) == quiet] or [np.empty(0)])
    noise, voice = power(True), power(False)
    blocks = (x[: len(x) // 320 * 320].reshape(-1, 320) ** 2).mean(1)
    low, high = (noise.mean(), voice.mean()) if noise.size and voice.size else (np.percentile(blocks, 10), np.percentile(blocks, 90)) if blocks.size else (np.nan, np.nan)
    return {"snr_db": float(10 * np.log10((high + 1e-12) / (low + 1e-12))), "bandwidth_hz": kernels.bandwidth(x, rate), "clip_pct": float(100 * (np.abs(x) > 0.999).mean()) if x.size else np.nan}


def extract(utterances: DataFrame) -> DataFrame:
    """One row for each utterance (utt_id, samples, sex, phones array of start, end, label): 40 features, their coverage and error.

    Optional columns from external models: formants (an array of four frequencies for each frame, null where unknown) and
    creak (an array of start, end in seconds). Without the first, formants are the utterance's own poles; without the second,
    VFI is 0 in voiced utterances. A failing utterance has no values and says why; missing values are NULL.
    """
    names = list(FEATURES)
    schema = ", ".join(["utt_id long", *(f"{n} double" for n in names), *(f"cov_{n} int" for n in names), "error string"])
    more = [c for c in ("formants", "creak") if c in utterances.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                try:
                    known, creak = getattr(r, "formants", None), getattr(r, "creak", None)
                    known = None if known is None else np.array([[np.nan if v is None else v for v in f] for f in known], float)
                    creak = None if creak is None else [(p["start"], p["end"]) for p in creak]
                    got = features(np.asarray(r.samples, float), [(p["start"], p["end"], p["label"]) for p in r.phones], r.sex, formants=known, creak=creak)
                    value = {n: v if np.isfinite(v) else None for n, (v, _) in got.items()}
                    rows.append({"utt_id": r.utt_id, "error": None} | value | {f"cov_{n}": int(c) for n, (_, c) in got.items()})
                except Exception as e:  # an utterance never fails its batch; the row says why
                    rows.append({"utt_id": r.utt_id, "error": f"{type(e).__name__}: {e}"} | {f"cov_{n}": 0 for n in names})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({n: float for n in names})

    return utterances.select("utt_id", "samples", "sex", "phones", *more).mapInPandas(run, schema)


def recording_quality(utterances: DataFrame) -> DataFrame:
    """snr_db, bandwidth_hz and clip_pct of each utterance (utt_id, samples, phones); NULL where it cannot be told."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                x = np.asarray(r.samples if r.samples is not None else [], float)
                q = quality(x, [(p["start"], p["end"], p["label"]) for p in (r.phones if r.phones is not None else [])]) if x.size else {}
                rows.append((r.utt_id, *(float(q[c]) if c in q and np.isfinite(q[c]) else None for c in ("snr_db", "bandwidth_hz", "clip_pct"))))
            yield pd.DataFrame(rows, columns=["utt_id", "snr_db", "bandwidth_hz", "clip_pct"]).astype({c: float for c in ("snr_db", "bandwidth_hz", "clip_pct")})

    return utterances.select("utt_id", "samples", "phones").mapInPandas(run, "utt_id long, snr_db double, bandwidth_hz double, clip_pct double")
