"""Printed characters: dark components, correlation with templates, words decoded column by column."""

from __future__ import annotations

import numpy as np

#: Accepted correlation, margin to the best other text, area of a loose pixel, brightness range and cost of a placed template.
ACCEPT, MARGIN, FRAGMENT, BRIGHT, PLACED = 0.85, 0.05, 3, (0.5, 2.0), 2500.0


def components(dark: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Boxes (x, y, width, height, area) of dark pixels that hang together (8 neighbours)."""
    left = {(int(y), int(x)) for y, x in zip(*np.nonzero(dark), strict=True)}
    out = []
    while left:
        stack = [left.pop()]
        xs, ys = [], []
        while stack:
            y, x = stack.pop()
            ys.append(y)
            xs.append(x)
            for n in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if n in left:
                    left.remove(n)
                    stack.append(n)
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(xs)))
    return sorted(out)


def around(boxes: list[tuple]) -> tuple[int, int, int, int, int]:
    x, y = min(b[0] for b in boxes), min(b[1] for b in boxes)
    return x, y, max(b[0] + b[2] for b in boxes) - x, max(b[1] + b[3] for b in boxes) - y, sum(b[4] for b in boxes)


def glyphs(boxes: list[tuple]) -> list[tuple]:
    """Boxes of one character as one: stacked parts that share half their width and no row, and loose pixels that touch a character within its width."""
    out, group = [], []
    for b in sorted(boxes):
        if group:
            g = around(group)
            shared = min(g[0] + g[2], b[0] + b[2]) - max(g[0], b[0])
            stacked = shared >= 0.5 * max(g[2], b[2]) and all(min(p[1] + p[3], b[1] + b[3]) <= max(p[1], b[1]) for p in group)
            loose = b[4] <= FRAGMENT and b[0] >= g[0] and b[0] + b[2] <= g[0] + g[2] and min(g[1] + g[3], b[1] + b[3]) - max(g[1], b[1]) >= 0
            if stacked or loose:
                group.append(b)
                continue
            out.append(around(group))
        group = [b]
    return out + ([around(group)] if group else [])


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Of two patches of equal size; 0 where one does not vary."""
    a, b = a - a.mean(), b - b.mean()
    v = float((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / np.sqrt(v)) if v > 0 else 0.0


def halves(t: np.ndarray) -> list[np.ndarray]:
    """A template as it is, and moved by half a pixel right, down, and both."""
    right = (t + np.pad(t, ((0, 0), (1, 0)))[:, :-1]) / 2
    down = lambda u: (u + np.pad(u, ((1, 0), (0, 0)))[:-1]) / 2
    return [t, right, down(t), down(right)]


def best_score(patch: np.ndarray, template: np.ndarray) -> float:
    """The greatest correlation over shifts of one pixel and half-pixel forms. patch has one pixel more than the template on each side."""
    h, w = template.shape
    return max(correlation(patch[y : y + h, x : x + w], f) for f in halves(template) for y in range(3) for x in range(3) if patch[y : y + h, x : x + w].shape == (h, w))


def match(ink: np.ndarray, box: tuple, templates: list[tuple[str, np.ndarray]]) -> tuple[str, float]:
    """The text and score of the template that fits best, "?" below ACCEPT or without MARGIN over the best of another text. ink: darkness (255 - gray); box: x, y, width, height, ..."""
    x, y = box[0], box[1]
    pad = np.pad(ink.astype(float), 8)
    scores: dict[str, float] = {}
    for text, t in templates:
        patch = pad[y + 7 : y + 9 + t.shape[0], x + 7 : x + 9 + t.shape[1]]
        if patch.shape == (t.shape[0] + 2, t.shape[1] + 2):
            scores[text] = max(scores.get(text, -1.0), best_score(patch, t.astype(float)))
    if not scores:
        return "?", 0.0
    text = max(scores, key=lambda k: scores[k])
    rival = max((v for k, v in scores.items() if k != text), default=-np.inf)
    return (text if scores[text] >= ACCEPT and scores[text] - rival >= MARGIN else "?"), scores[text]


def decode(ink: np.ndarray, templates: list[tuple[str, np.ndarray]]) -> list[tuple[str, int]]:
    """Texts and columns of the templates that explain a word's ink at least cost: a column passed over costs its energy, a template what it leaves, at its best brightness, and PLACED.

    Shortest path over columns; templates as tall as the word at most stand on any row."""
    ink = ink.astype(float)
    h, w = ink.shape
    energy = (ink**2).sum(0)
    cost, came = np.full(w + 1, np.inf), [None] * (w + 1)
    cost[0] = 0.0
    for x in range(w):
        if cost[x] + energy[x] < cost[x + 1]:
            cost[x + 1], came[x + 1] = cost[x] + energy[x], (x, None)
        for text, t in templates:
            th, tw = t.shape
            if x + tw > w or th > h:
                continue
            for y in range(h - th + 1):
                part = ink[y : y + th, x : x + tw]
                a = float(np.clip((part * t).sum() / max(1e-9, (t * t).sum()), *BRIGHT))
                c = cost[x] + energy[x : x + tw].sum() - (part**2).sum() + ((part - a * t) ** 2).sum() + PLACED
                if c < cost[x + tw]:
                    cost[x + tw], came[x + tw] = c, (x, text)
    out, x = [], w
    while x:
        before, text = came[x]
        if text is not None:
            out.append((text, before))
        x = before
    return out[::-1]


def fragment(ink: np.ndarray, template: np.ndarray) -> tuple[int, int, float] | None:
    """Where (x, y) a template fits best in an area, with its score, if that is ACCEPT at least."""
    h, w = template.shape
    if ink.shape[0] < h or ink.shape[1] < w:
        return None
    views = np.lib.stride_tricks.sliding_window_view(ink.astype(float), (h, w))
    v = views - views.mean((2, 3), keepdims=True)
    t = template - template.mean()
    norm = np.sqrt((v * v).sum((2, 3)) * (t * t).sum())
    score = np.where(norm > 0, (v * t).sum((2, 3)) / np.where(norm > 0, norm, 1), 0.0)
    y, x = np.unravel_index(int(score.argmax()), score.shape)
    return (int(x), int(y), float(score[y, x])) if score[y, x] >= ACCEPT else None


def dissimilar(instances: list[np.ndarray], most: int = 16, below: float = 0.93) -> list[np.ndarray]:
    """Templates from clean occurrences of a character: each that is unlike all chosen before, up to `most`."""
    out: list[np.ndarray] = []
    for t in instances:
        if len(out) < most and all(t.shape != o.shape or correlation(t.astype(float), o.astype(float)) < below for o in out):
            out.append(t)
    return out
