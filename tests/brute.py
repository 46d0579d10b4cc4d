"""The rules of the series operators, one row at a time, on small lists."""

from __future__ import annotations

import math
from collections import defaultdict


def by_series(points):
    out = defaultdict(list)
    for p in points:
        out[p["series"]].append(p)
    return {s: sorted(ps, key=lambda p: (p["x"], p["id"])) for s, ps in out.items()}


def min_max(points, width, threshold):
    kept = set()
    for series, ps in by_series(points).items():
        if len(ps) <= threshold:
            kept |= {(series, p["id"]) for p in ps}
            continue
        lo, span = ps[0]["x"], ps[-1]["x"] - ps[0]["x"]
        columns = defaultdict(list)
        for p in ps:
            columns[int((p["x"] - lo) / span * width) if span else 0].append(p)
        for column, inside in columns.items():
            kept.add((series, inside[0]["id"]))
            if column != max(columns):
                valued = [p for p in inside if p["y"] is not None]
                kept.add((series, inside[-1]["id"]))
                if valued:
                    kept.add((series, min(valued, key=lambda p: p["y"])["id"]))
                    kept.add((series, max(valued, key=lambda p: p["y"])["id"]))
    return kept


def lttb(points, samples, threshold):
    kept = set()
    for series, ps in by_series(points).items():
        n = len(ps)
        if n <= threshold or n <= samples:
            kept |= {(series, p["id"]) for p in ps}
            continue
        kept |= {(series, ps[0]["id"]), (series, ps[-1]["id"])}
        if samples <= 2:
            continue
        rate = (n - 2) / (samples - 2)
        starts = [math.floor(b * rate) + 1 for b in range(samples)]
        last = ps[0]
        for b in range(samples - 2):
            ahead = ps[starts[b + 1]:min(starts[b + 2], n)]
            nx = sum(p["x"] for p in ahead) / len(ahead)
            ny = sum(p["y"] for p in ahead) / len(ahead)
            best = max(
                ps[starts[b]:min(starts[b + 1], n)],
                key=lambda p: abs(
                    (last["x"] - nx) * (p["y"] - last["y"])
                    - (last["x"] - p["x"]) * (ny - last["y"])
                ),
            )
            kept.add((series, best["id"]))
            last = best
    return kept


def stack_tops(values):
    """Tops of one pile: a value stands on the sum of the earlier values of its
    sign; a zero has the sign of the first value before it that is not zero."""
    tops = []
    for k, value in enumerate(values):
        before = values[:k]
        sign = value or next((v for v in before if v), 0)
        tops.append(value + sum(v for v in before if v * sign > 0))
    return tops


def segments(ps, gap):
    out, run, before = {}, -1, None
    for p in ps:
        if p["y"] is not None:
            far = gap is not None and before is not None and p["x"] - before["x"] > gap
            if before is None or before["y"] is None or far:
                run += 1
            out[p["id"]] = run
        before = p
    return out
