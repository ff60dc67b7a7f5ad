"""Coefficient tables, made on the driver: windows, filter designs, mel and cosine matrices, channel matrices."""

from __future__ import annotations

import numpy as np


def hann(n: int) -> np.ndarray:
    """Periodic."""
    return 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / n))


def lowpass(taps: int, fc: float) -> np.ndarray:
    """Hamming-windowed sinc with unity gain at zero; fc in cycles per sample."""
    m = np.arange(taps) - (taps - 1) / 2
    h = 2 * fc * np.sinc(2 * fc * m) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(taps) / max(1, taps - 1)))
    return h / h.sum()


def _delta(taps: int) -> np.ndarray:
    if taps % 2 == 0:
        raise ValueError("an odd number of taps is needed")
    d = np.zeros(taps)
    d[taps // 2] = 1
    return d


def highpass(taps: int, fc: float) -> np.ndarray:
    return _delta(taps) - lowpass(taps, fc)


def bandpass(taps: int, lo: float, hi: float) -> np.ndarray:
    return lowpass(taps, hi) - lowpass(taps, lo)


def bandstop(taps: int, lo: float, hi: float) -> np.ndarray:
    return _delta(taps) - bandpass(taps, lo, hi)


def cqt_bands(bins: int, taps: int, f_min: float, per_octave: int) -> np.ndarray:
    f = f_min * 2.0 ** (np.arange(bins) / per_octave)
    edge = 2.0 ** (1 / (2 * per_octave))
    return np.array([bandpass(taps, x / edge, min(0.4999, x * edge)) for x in f])


def resample_proto(up: int, down: int, half: int) -> np.ndarray:
    """A sinc of 2 half + 1 taps that cuts at the lower of the two rates, under a Hann window that is zero at both ends, with gain up."""
    i = np.arange(2 * half + 1)
    h = np.sinc((i - half) / max(up, down)) * 0.5 * (1 - np.cos(np.pi * i / half))
    return h * up / h.sum()


def polyphase_proto(up: int, down: int) -> np.ndarray:
    """The prototype of a zero-phase rational converter: a Kaiser-windowed (beta 5) sinc, ten periods of the lower rate each side."""
    most = max(up, down)
    half = 10 * most
    i = np.arange(2 * half + 1)
    h = np.sinc((i - half) / most) * np.kaiser(2 * half + 1, 5.0)
    return h * up / h.sum()


def mel_bank(bins: int, bands: int = 26, rate: float = 48000.0) -> np.ndarray:
    """Triangular bands between equal steps on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.arange(bins) * rate / (2 * (bins - 1))
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid)))


def mel_bank_floored(bins: int, frame: int, rate: float, bands: int = 26) -> np.ndarray:
    """Triangular bands whose corners lie on whole bins, each at least one bin after the one before."""
    mel = np.linspace(0.0, 2595 * np.log10(1 + rate / 2 / 700), bands + 2)
    corner = np.floor(frame * 700 * (10 ** (mel / 2595) - 1) / rate).astype(int)
    lo, b = corner[:-2, None], np.arange(bins)[None]
    mid = np.maximum(corner[1:-1, None], lo + 1)
    hi = np.maximum(corner[2:, None], mid + 1)
    return np.where((b >= lo) & (b < mid), (b - lo) / (mid - lo), np.where((b >= mid) & (b < hi), (hi - b) / (hi - mid), 0.0))


def dct(n: int, bands: int = 26) -> np.ndarray:
    """Orthonormal DCT-II, n rows."""
    k, i = np.arange(n)[:, None], np.arange(bands)[None]
    m = np.cos(np.pi * k * (2 * i + 1) / (2 * bands)) * np.sqrt(2 / bands)
    m[0] /= np.sqrt(2)
    return m


def hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1))
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h / np.sqrt(n)


#: Speaker order and fold-down gains (front, rear and centre at half power; the low-frequency channel is dropped).
_HALF = 2**-0.5
MIX = {
    ("mono", "stereo"): [[1.0], [1.0]],
    ("stereo", "mono"): [[0.5, 0.5]],
    ("5.1", "stereo"): [[1, 0, _HALF, 0, _HALF, 0], [0, 1, _HALF, 0, 0, _HALF]],
    ("stereo", "5.1"): [[1, 0], [0, 1], [0, 0], [0, 0], [0, 0], [0, 0]],
    ("stereo", "7.1"): [[1, 0], [0, 1], [0, 0], [0, 0], [0, 0], [0, 0], [0, 0], [0, 0]],
    ("5.1", "7.1"): [[1, 0, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0], [0, 0, 1, 0, 0, 0], [0, 0, 0, 1, 0, 0], [0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 1, 0], [0, 0, 0, 0, 0, 1]],
    ("7.1", "5.1"): [[1, 0, 0, 0, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0, 0, 0], [0, 0, 1, 0, 0, 0, 0, 0], [0, 0, 0, 1, 0, 0, 0, 0], [0, 0, 0, 0, _HALF, 0, 1, 0], [0, 0, 0, 0, 0, _HALF, 0, 1]],
}
CANONICAL = {"mono": ["C"], "stereo": ["L", "R"], "5.1": ["L", "R", "C", "LFE", "Ls", "Rs"], "7.1": ["L", "R", "C", "LFE", "Lb", "Rb", "Ls", "Rs"]}


def permutation(canonical: list[str], device: list[str]) -> list[int]:
    """Where each canonical channel lies in the device's order; both must name the same channels once."""
    if sorted(canonical) != sorted(device) or len(set(device)) != len(device):
        raise ValueError("channel orders aren't a bijection")
    return [device.index(c) for c in canonical]


def sh(azimuth: float, elevation: float, order: int) -> list[float]:
    """Real spherical harmonics up to order 2, SN3D scaled, ACN ordered."""
    ca, sa, ce, se = np.cos(azimuth), np.sin(azimuth), np.cos(elevation), np.sin(elevation)
    y = [1.0, sa * ce, se, ca * ce]
    r = np.sqrt(3) / 2
    y += [r * np.sin(2 * azimuth) * ce * ce, r * sa * np.sin(2 * elevation), 0.5 * (3 * se * se - 1), r * ca * np.sin(2 * elevation), r * np.cos(2 * azimuth) * ce * ce]
    return [float(v) for v in y[: (order + 1) ** 2]]
