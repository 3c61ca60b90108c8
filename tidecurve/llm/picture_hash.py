"""Canonical forms, locality hashes and comparison of small pictures (numpy, batched).

A picture's canonical form: margins of one colour trimmed, reduced to luma,
brought to one size by area means, centred and scaled (so exposure drops
out).  Besides the whole picture (``BASE``) one with one pixel taken off every
side (``INNER``) is kept, which meets a partner whose border was painted over
or cut away.

Direction drops out in the hashes.  A picture is turned until each of its four
halves in turn lies on the left, and each left half gives one code, the signs
of fixed random projections; so one set of projections serves all halves, and a
spot leaves at least two of them alone.  A query asks with all eight
orientations, and also for the buckets with its weakest signs turned over.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SIDE, FINE = 8, 12
BITS, FLIPS = 32, 3
SIGNATURE_BITS = 64
#: Steps of 256 by which the pixels of a margin may differ.
MARGIN_RANGE = 12
#: Orientations: 0-3 quarter turns, 4-7 the same after mirroring.
TURNS = 8
LUMA = np.array([0.299, 0.587, 0.114], np.float32)


@lru_cache(maxsize=None)
def _area(n: int, side: int) -> np.ndarray:
    """(side, n) weights: each output cell is the mean of the input span it covers."""
    edges, cells = np.linspace(0, n, side + 1), np.arange(n)
    cover = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
    cover = np.clip(cover, 0, None)
    return (cover / cover.sum(1, keepdims=True)).astype(np.float32)


@lru_cache(maxsize=None)
def _planes() -> np.ndarray:
    n = SIDE * SIDE // 2
    rng = np.random.default_rng(1000)
    blocks = [np.linalg.qr(rng.standard_normal((n, n)))[0] for _ in range(-(-BITS // n))]
    return np.concatenate(blocks, 1)[:, :BITS].astype(np.float32)


@lru_cache(maxsize=None)
def _signature_planes() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((SIDE * SIDE, SIGNATURE_BITS)).astype(np.float32)


def standardise(x: np.ndarray) -> np.ndarray:
    x = x - x.mean(axis=(1, 2), keepdims=True)
    return x / np.maximum(np.sqrt((x * x).mean(axis=(1, 2), keepdims=True)), 1e-6)


def resize(pictures: np.ndarray, side: int) -> np.ndarray:
    _, h, w = pictures.shape
    return np.einsum("ih,nhw,jw->nij", _area(h, side), pictures, _area(w, side), optimize=True)


def turned(forms: np.ndarray, turn: int) -> np.ndarray:
    """(n, side, side) forms in one of the eight orientations."""
    own = forms[:, :, ::-1] if turn >= 4 else forms
    return np.rot90(own, turn % 4, axes=(1, 2))


def trims(pixels: np.ndarray) -> np.ndarray:
    """(n, 4) lines of the margin's colour at the top, bottom, left and right of (n, h, w, 3) pixels.

    A margin's lines are each of one colour, and that of the outermost one.
    Where nothing but margin would be found, nothing is trimmed.
    """
    out = []
    for axis in (2, 1):
        high, low = pixels.max(axis).astype(np.int16), pixels.min(axis).astype(np.int16)  # (n, lines, 3)
        flat = (high - low).max(-1) <= MARGIN_RANGE
        for end in (slice(None), slice(None, None, -1)):
            h, l = high[:, end], low[:, end]
            one = (np.maximum.accumulate(h, 1) - np.minimum.accumulate(l, 1)).max(-1) <= 2 * MARGIN_RANGE
            out.append(np.cumprod(flat[:, end] & one, axis=1).sum(1))
    counts = np.stack(out, 1)
    for k, n in ((0, pixels.shape[1]), (2, pixels.shape[2])):
        counts[counts[:, k] + counts[:, k + 1] > n - 2] = 0
    return counts


def canonical(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(kept, forms)``: which of (n, h, w, 3) are pictures at all, and their (kept, 2, 12, 12) forms."""
    n, h, w, _ = pixels.shape
    flat = pixels.reshape(n, -1, 3)
    kept = np.flatnonzero((flat.max(1) != flat.min(1)).any(-1))
    pixels = pixels[kept]
    forms = np.zeros((len(kept), 2, FINE, FINE), np.float32)
    margin = trims(pixels)
    for t, b, l, r in np.unique(margin, axis=0):
        own = np.flatnonzero((margin == (t, b, l, r)).all(1))
        luma = pixels[own, t : h - b, l : w - r].astype(np.float32) @ LUMA
        forms[own, 0] = standardise(resize(luma, FINE))
        inner = luma[:, 1:-1, 1:-1] if min(luma.shape[1:]) > 4 else luma
        forms[own, 1] = standardise(resize(inner, FINE))
    return kept, forms


def _small(forms: np.ndarray) -> np.ndarray:
    return np.einsum("ih,nhw,jw->nij", _area(FINE, SIDE), forms, _area(FINE, SIDE), optimize=True)


def hashes(forms: np.ndarray, turns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For (n, 12, 12) forms in the first ``turns`` orientations: (n, turns) codes of the left half,
    (n, turns, 2**FLIPS) probes, (n, turns) 64-bit signatures of the whole."""
    n, small = len(forms), _small(forms)
    weights = (1 << np.arange(BITS)).astype(np.int64)
    codes, probes = np.zeros((n, turns), np.int64), np.zeros((n, turns, 1 << FLIPS), np.int64)
    signatures = np.zeros((n, turns), np.int64)
    subsets = (np.arange(1 << FLIPS)[:, None] >> np.arange(FLIPS)) & 1
    for t in range(turns):
        own = turned(small, t)
        values = standardise(own[:, :, : SIDE // 2]).reshape(n, -1) @ _planes()
        codes[:, t] = (values > 0) @ weights
        weakest = np.argpartition(np.abs(values), FLIPS, axis=1)[:, :FLIPS]
        probes[:, t] = codes[:, t, None] ^ (weights[weakest] @ subsets.T)
        signs = standardise(own).reshape(n, -1) @ _signature_planes() > 0
        signatures[:, t] = np.packbits(signs, axis=1).view(">i8").astype(np.int64).ravel()
    return codes, probes, signatures


def pack_form(forms: np.ndarray) -> np.ndarray:
    """Standardised forms as bytes: 24 steps per standard deviation."""
    return np.clip(np.rint(forms * 24 + 128), 0, 255).astype(np.uint8)


def unpack_form(data: np.ndarray) -> np.ndarray:
    return (data.astype(np.float32) - 128) / 24


def likeness(a: np.ndarray, b: np.ndarray, keep: float = 0.75) -> np.ndarray:
    """Correlation of (n, 12, 12) forms over the share ``keep`` of cells that agree best.

    A first fit finds the cells an edit at spots has changed; they are left
    out and the correlation is taken over the others.
    """
    x, y = standardise(a).reshape(len(a), -1), standardise(b).reshape(len(b), -1)
    for _ in range(2):
        gap = np.abs(x - y)
        cut = np.quantile(gap, keep, axis=1, keepdims=True)
        use = (gap <= cut).astype(np.float32)
        n = use.sum(1, keepdims=True)
        mx, my = (x * use).sum(1, keepdims=True) / n, (y * use).sum(1, keepdims=True) / n
        cx, cy = (x - mx) * use, (y - my) * use
        sx, sy = np.sqrt((cx * cx).sum(1, keepdims=True) / n), np.sqrt((cy * cy).sum(1, keepdims=True) / n)
        x, y = (x - mx) / np.maximum(sx, 1e-6), (y - my) / np.maximum(sy, 1e-6)
    gap = np.sqrt((((x - y) ** 2) * use).sum(1) / n[:, 0])
    return 1 - gap * gap / 2
