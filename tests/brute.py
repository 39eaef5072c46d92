"""Plain re-statements of the sequential rules, for small inputs."""
from __future__ import annotations

import math


def metres(a, b):
    x = (math.radians(b[1]) - math.radians(a[1])) * math.cos((math.radians(a[0]) + math.radians(b[0])) / 2)
    return 6371000.0 * math.hypot(x, math.radians(b[0]) - math.radians(a[0]))


def bursts(photos):
    """``(sha1, ts, lat, lon)`` rows to ``{frozenset of ids}`` of bursts with two or more photos."""
    out, run = [], []
    for p in sorted(photos, key=lambda r: (r[1], r[0])):
        if run:
            lapse = p[1] - run[-1][1]
            close = metres(run[-1][2:], p[2:]) <= 15
            bridge = len(run) >= 2 and lapse <= 5 and run[-1][1] - run[0][1] <= 10
            if lapse <= 15 and (close or bridge):
                run.append(p)
                continue
            out.append(run)
        run = [p]
    if run:
        out.append(run)
    return {frozenset(r[0] for r in c) for c in out if len(c) >= 2}


def time_clusters(photos, gap):
    """``(key, sha1, ts)`` to a set of clusters; rows without ts stand alone."""
    out = []
    for key in {p[0] for p in photos}:
        run = []
        for p in sorted((p for p in photos if p[0] == key and p[2] is not None), key=lambda r: r[2]):
            if run and p[2] - run[-1][2] > gap:
                out.append(run)
                run = []
            run.append(p)
        out.append(run)
        out += [[p] for p in photos if p[0] == key and p[2] is None]
    return {frozenset(p[1] for p in c) for c in out if c}


def place_regions(points, weights, scores, k):
    """Ordered points to a centre list, by the written selection rule."""
    lead = max(range(len(points)), key=lambda i: (scores[i], weights[i], -i))
    centres = [points[lead]]
    d2 = lambda p, c: (p[0] - c[0]) ** 2 + (p[1] - c[1]) ** 2
    while len(centres) < k:
        gaps = [min(d2(p, c) for c in centres) for p in points]
        total = sum(gaps)
        if not total:
            break
        run, at = 0, 0
        for i, g in enumerate(gaps):
            run += g
            if 2 * run >= total:
                at = i
                break
        centres.append(points[at])
        if len(centres) >= len(points):
            break
    near = lambda p: min(range(len(centres)), key=lambda i: d2(p, centres[i]))
    for _ in range(12):
        own = [near(p) for p in points]
        moved = []
        for i, c in enumerate(centres):
            mine = [j for j, o in enumerate(own) if o == i]
            w = sum(weights[j] for j in mine)
            moved.append(c if not mine else tuple(math.floor(sum(points[j][a] * weights[j] for j in mine) / w + 0.5) for a in (0, 1)))
        if moved == centres:
            break
        centres = moved
    return centres


def moment_centres(values, k):
    """Time values (with repeats) to centres."""
    values = sorted(values)
    if k >= len(values):
        return [float(v) for v in values]
    centres = [float(values[len(values) // 2])]
    while len(centres) < k:
        centres.append(float(max(values, key=lambda v: (min(abs(v - c) for c in centres), -v))))
    centres.sort()
    for _ in range(10):
        groups = [[] for _ in centres]
        for v in values:
            groups[min(range(len(centres)), key=lambda i: abs(v - centres[i]))].append(v)
        moved = [sum(g) / len(g) if g else c for g, c in zip(groups, centres)]
        still = all(abs(a - b) < 1 for a, b in zip(moved, centres))
        centres = moved
        if still:
            break
    return centres


def flattened(files):
    """``(dir, name, path)`` to target names: first copies keep theirs, later ones probe for a free number."""
    first, later, taken, out = {}, [], set(), {}
    for d, name, path in sorted(files, key=lambda f: f[2]):
        if (d, name) in first:
            later.append((d, name, path))
        else:
            first[(d, name)] = path
            taken.add((d, name))
            out[path] = name
    for d, name, path in later:
        stem, dot, ext = name.rpartition(".")
        number = 1
        while (d, f"{stem}({number}).{ext}") in taken:
            number += 1
        taken.add((d, f"{stem}({number}).{ext}"))
        out[path] = f"{stem}({number}).{ext}"
    return out
