"""Picture and sound features over arrays and bytes: scrambling, palettes, geometry, mel spectrograms."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: The sixteen named colours.
PALETTE = {
    "aqua": (0, 255, 255), "black": (0, 0, 0), "blue": (0, 0, 255), "fuchsia": (255, 0, 255), "gray": (128, 128, 128), "green": (0, 128, 0),
    "lime": (0, 255, 0), "maroon": (128, 0, 0), "navy": (0, 0, 128), "olive": (128, 128, 0), "purple": (128, 0, 128), "red": (255, 0, 0),
    "silver": (192, 192, 192), "teal": (0, 128, 128), "white": (255, 255, 255), "yellow": (255, 255, 0),
}
RATE, FFT, HOP, MELS = 12_000, 512, 256, 96


def nearest_colour(r: Column, g: Column, b: Column) -> Column:
    """Name of the nearest palette colour, the alphabetically first on ties."""
    far = [F.struct(((r - x) * (r - x) + (g - y) * (g - y) + (b - z) * (b - z)).alias("d"), F.lit(n).alias("n")) for n, (x, y, z) in sorted(PALETTE.items())]
    return F.least(*far)["n"]


def crop_geometry(w: Column, h: Column, tw: int, th: int) -> Column:
    """Scale so both sides cover the target, then crop the centre."""
    scale = F.greatest(F.lit(tw) / w, F.lit(th) / h)
    sw, sh = F.ceil(F.round(w * scale, 6)), F.ceil(F.round(h * scale, 6))
    return F.struct(sw.alias("sw"), sh.alias("sh"), F.floor((sw - tw) / 2).alias("x"), F.floor((sh - th) / 2).alias("y"))


def scramble_blocks(a: np.ndarray, block: int, rng: np.random.Generator) -> np.ndarray:
    """Permute the whole blocks of (h, w, c); what is left at the right and bottom stays."""
    out = a.copy()
    rows, cols = a.shape[0] // block, a.shape[1] // block
    for to, at in enumerate(rng.permutation(rows * cols)):
        (ty, tx), (y, x) = divmod(to, cols), divmod(int(at), cols)
        out[ty * block : (ty + 1) * block, tx * block : (tx + 1) * block] = a[y * block : (y + 1) * block, x * block : (x + 1) * block]
    return out


def scramble_recursive(a: np.ndarray, block: int, rng: np.random.Generator) -> np.ndarray:
    """Permute quadrants, then within each quadrant, down to the block size."""
    h, w = a.shape[0] // 2, a.shape[1] // 2
    if min(h, w) < block:
        return a
    parts = [a[:h, :w], a[:h, w : 2 * w], a[h : 2 * h, :w], a[h : 2 * h, w : 2 * w]]
    parts = [scramble_recursive(parts[i], block, rng) for i in rng.permutation(4)]
    out = a.copy()
    out[:h, :w], out[:h, w : 2 * w], out[h : 2 * h, :w], out[h : 2 * h, w : 2 * w] = parts
    return out


def scrambled(df: DataFrame, key: str, how: Callable, block: int, seed: int = 0) -> DataFrame:
    """``(key, img)`` with scrambled pixels, one seed per row; bytes that do not fit h x w x 3 give null."""

    @F.pandas_udf("binary")
    def run(k: pd.Series, img: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for i, b, y, x in zip(k, img, h, w):
            fits = b is not None and y == y and x == x and y is not None and x is not None and len(b) == y * x * 3 and len(b)
            out.append(how(np.frombuffer(b, np.uint8).reshape(int(y), int(x), 3), block, np.random.default_rng([seed, int(i)])).tobytes() if fits else None)
        return pd.Series(out, dtype=object)

    return df.select(key, run(key, "img", "h", "w").alias("img"))


def mel_filters(rate: int = RATE, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """(mels, fft // 2 + 1) triangles, equal steps on the mel scale, scaled to unit area."""
    to_mel = lambda f: 2595 * math.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(0, to_mel(rate / 2), mels + 2) / 2595) - 1)
    bins = np.linspace(0, rate / 2, fft // 2 + 1)
    up = (bins - points[:-2, None]) / np.diff(points)[:-1, None]
    down = (points[2:, None] - bins) / np.diff(points)[1:, None]
    return np.clip(np.minimum(up, down), 0, None) * (2 / (points[2:] - points[:-2]))[:, None]


def log_melgram(x: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Log of the squared mel spectrogram, (mels, frames)."""
    x = np.pad(np.asarray(x, float), FFT // 2, mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(x, FFT)[::HOP] * np.hanning(FFT + 1)[:-1]
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    mel = mel_filters(rate) @ power.T
    return 10 * np.log10(np.maximum(mel**2, 1e-10))


def fit_length(x: str, n: int) -> Column:
    """Pad with zeros to ``n`` or take the middle ``n`` values."""
    size = F.size(x)
    middle = F.slice(x, F.floor((size - n) / 2).cast("int") + 1, F.lit(n))
    padded = F.concat(F.col(x), F.array_repeat(F.lit(0.0), F.greatest(F.lit(n) - size, F.lit(0))))
    return F.when(size >= n, middle).otherwise(padded)


def augment(a: np.ndarray, height: int, width: int, rng: np.random.Generator, flip: bool = True) -> np.ndarray:
    """A random crop of (h, w, c), mirrored half of the time if ``flip``; a side too short is padded with black around the picture."""
    h, w = a.shape[:2]
    pad = [(max(0, n - m) // 2, max(0, n - m) - max(0, n - m) // 2) for m, n in ((h, height), (w, width))]
    own = np.pad(a, [*pad, (0, 0)])
    y, x = (int(rng.integers(0, m - n + 1)) for m, n in ((own.shape[0], height), (own.shape[1], width)))
    cut = own[y : y + height, x : x + width]
    return cut[:, ::-1] if flip and rng.random() < 0.5 else cut


def jpeg_channels(content: bytes) -> int | None:
    """Colour components that a JPEG file's frame header declares; None for bytes that are no JPEG."""
    if content[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 < len(content) and content[at] == 0xFF:
        mark = content[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return content[at + 9]
        at += 2 + int.from_bytes(content[at + 2 : at + 4], "big")
    return None
