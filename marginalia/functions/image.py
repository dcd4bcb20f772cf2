"""Figures of page images."""

from __future__ import annotations

import numpy as np

#: What makes a page degraded, and what each measure adds to the score.
DARK, LIGHT = 50, 220
MOST_DARK, MOST_LIGHT = 0.60, 0.85
LEAST_EDGE, MOST_SPREAD, BLEED_LIGHT = 0.03, 45.0, 0.4
PARTS = {"dark": 0.35, "light": 0.25, "blur": 0.25, "spread": 0.15}
#: What red, green and blue add to grey.
LUMA = (0.299, 0.587, 0.114)


def grey(pixels: np.ndarray) -> np.ndarray:
    """Rows of grey values from 0 to 255 of a grey, colour or colour-and-alpha image; a single row is one of height 1."""
    x = np.atleast_2d(np.asarray(pixels))
    if x.ndim == 3:
        x = x[..., :3].astype(np.float64) @ np.array(LUMA) if x.shape[2] >= 3 else x[..., 0]
    return x.astype(np.uint8)


def degradation(pixels: np.ndarray) -> dict:
    """Status, score (0 to 1, higher: worse), reasons, and the shares of dark and light pixels, edge strength and spread.

    An image without pixels is degraded, with the reason ``empty``.
    """
    x = grey(pixels)
    if not x.size:
        return {"status": "DEGRADED", "score": 1.0, "reasons": ["empty"], "dark": 0.0, "light": 0.0, "edge": 0.0, "spread": 0.0}
    wide = x.astype(np.float64)
    steps = [float(np.abs(np.diff(wide, axis=k)).mean()) if x.shape[k] > 1 else 0.0 for k in (0, 1)]
    dark, light, edge, spread = float((x <= DARK).mean()), float((x >= LIGHT).mean()), sum(steps) / 2 / 255, float(wide.std())
    found = {"dark": dark > MOST_DARK, "washed out": light > MOST_LIGHT, "blurred": edge < LEAST_EDGE, "bleed-through": light > BLEED_LIGHT and spread > MOST_SPREAD}
    measures = {"dark": min(dark / MOST_DARK, 1), "light": min(light / MOST_LIGHT, 1), "blur": max(0, 1 - edge / LEAST_EDGE), "spread": min(spread / MOST_SPREAD / 2, 1)}
    reasons = [name for name, is_so in found.items() if is_so]
    score = min(1.0, sum(PARTS[k] * v for k, v in measures.items()))
    return {"status": "DEGRADED" if reasons else "NORMAL", "score": round(score, 4), "reasons": reasons, "dark": round(dark, 4), "light": round(light, 4), "edge": round(edge, 4), "spread": round(spread, 2)}


def netpbm(data: bytes) -> np.ndarray:
    """Pixels of a binary PGM (grey) or PPM (colour) image of 8 bits; ValueError if it is none."""
    fields, at = [], 0
    while len(fields) < 4:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.find(b"\n", at) if data[at : at + 1] == b"#" else at + 1
            if at < 0:
                raise ValueError("a header without an end")
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("not a binary PGM or PPM image")
        fields.append(data[at:end])
        at = end
    kind, width, height, most = fields[0], *map(int, fields[1:])
    depth = {b"P5": 1, b"P6": 3}.get(kind)
    if depth is None or most > 255 or len(data) - at - 1 < width * height * depth:
        raise ValueError("not a binary PGM or PPM image of 8 bits")
    pixels = np.frombuffer(data, np.uint8, width * height * depth, at + 1)
    return pixels.reshape((height, width) if depth == 1 else (height, width, depth))
