"""Knee of a concave, decreasing curve after Satopää, Albrecht, Irwin and Raghavan (2011)."""

from __future__ import annotations


def knee(x: list[float], y: list[float], sensitivity: float = 1.0, online: bool = True) -> tuple[float, float] | None:
    """(x, y) of the knee, or None. x ascends; online keeps the last knee that is found.

    The curve is scaled to the unit square and turned so that it rises; its distance from the diagonal has a local
    maximum at each candidate, which is a knee if the distance falls under a threshold before it rises again.
    """
    n = len(x)
    if n < 3 or x[-1] == x[0] or max(y) == min(y):
        return None
    u = [(v - x[0]) / (x[-1] - x[0]) for v in x]
    v = [(w - min(y)) / (max(y) - min(y)) for w in y]
    # Concave and decreasing: mirrored in x it is concave and increasing.
    v = v[::-1]
    distance = [b - a for a, b in zip(u, v, strict=True)]
    step = sum(b - a for a, b in zip(u, u[1:], strict=False)) / (n - 1)
    found, threshold, candidate = None, None, None
    for i in range(1, n):
        here = distance[i]
        if i < n - 1 and distance[i - 1] <= here >= distance[i + 1] and (distance[i - 1] < here or distance[i + 1] < here):
            candidate, threshold = i, here - sensitivity * abs(step)
        elif i < n - 1 and distance[i - 1] >= here <= distance[i + 1] and here < distance[i - 1]:
            threshold = 0.0 if threshold is not None else None
        if threshold is not None and candidate is not None and i > candidate and here < threshold:
            found, threshold = candidate, None
            if not online:
                break
    if found is None:
        return None
    i = n - 1 - found
    return x[i], y[i]
