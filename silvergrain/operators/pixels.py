"""Image statistics from pixel grids and saliency maps held in array columns.

An image is a row, so its statistics need no shuffle: Arrow hands the arrays of a
batch to numpy without copying them, and each grid is read in bands of
``BAND`` pixels, with one row of neighbours above and below where a filter needs
them. What is kept between bands are counts and sums, whole numbers where the pixels are, so a task's memory
beyond the rows themselves doesn't grow with the image.

Images whose grids are missing, empty, hold nulls or don't have ``width * height`` cells are left out.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from silvergrain.session import ship_package

#: Pixels that are looked at together.
BAND = 1 << 20
#: Values that are sorted at once when a quantile is refined.
SORTED = 1 << 16


def _per_image(images: DataFrame, arrays: list[str], names: list[str], of: Callable[..., tuple]) -> DataFrame:
    """``image_id`` and the numbers that ``of(width, height, *arrays)`` returns for each whole image."""
    ship_package(images.sparkSession)
    kind = dict(images.dtypes)["image_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, found = [], []
            width, height = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, (w, h) in enumerate(zip(width, height)):
                cells = [batch.column(3 + k)[i].values for k in range(len(arrays))]
                if w and h and all(c is not None and len(c) == w * h and not c.null_count for c in cells):
                    kept.append(i)
                    found.append(of(w, h, *[c.to_numpy() for c in cells]))
            numbers = [pa.array(list(c), pa.float64()) for c in zip(*found)] or [pa.array([], pa.float64())] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), *numbers], ["image_id", *names])

    schema = f"image_id {kind}, " + ", ".join(f"{n} double" for n in names)
    return images.select("image_id", "width", "height", *arrays).mapInArrow(run, schema)


def bands(cells: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(cells), BAND):
        yield cells[at:at + BAND]


def spread(n: int, total: int, squares: int) -> float:
    """Population standard deviation from whole sums."""
    return math.sqrt(max(0, squares * n - total * total)) / n


def _grey_numbers(gray: np.ndarray) -> tuple[float, float, float]:
    n, total, squares, counts = len(gray), 0, 0, np.zeros(0, np.int64)
    for part in bands(gray):
        v = part.astype(np.int64)
        total, squares = total + int(v.sum()), squares + int((v * v).sum())
        here = np.bincount(v - v.min())
        shift = int(v.min())
        if not len(counts):
            counts, low = here, shift
        else:
            start, end = min(low, shift), max(low + len(counts), shift + len(here))
            wider = np.zeros(end - start, np.int64)
            wider[low - start:low - start + len(counts)] += counts
            wider[shift - start:shift - start + len(here)] += here
            counts, low = wider, start
    some = counts[counts > 0].astype(float)
    # Entropy from counts alone: log2(n) - sum(c * log2(c)) / n.
    return total / n, spread(n, total, squares), math.log2(n) - float((some * np.log2(some)).sum()) / n


def _laplacian(width: int, height: int, gray: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian; beyond a border stands the pixel before the border pixel."""
    grid, total, squares = gray.reshape(height, width), 0, 0
    step = max(1, BAND // width)
    for y in range(0, height, step):
        rows = np.abs(np.arange(y - 1, min(y + step, height) + 1))
        rows = np.where(rows >= height, 2 * height - 2 - rows, rows) if height > 1 else np.zeros_like(rows)
        block = grid[rows].astype(np.int64)
        here = block[1:-1]
        side = np.pad(here, ((0, 0), (1, 1)), mode="reflect") if width > 1 else np.repeat(here, 3, axis=1)
        response = block[:-2] + block[2:] + side[:, :-2] + side[:, 2:] - 4 * here
        total, squares = total + int(response.sum()), squares + int((response * response).sum())
    n = width * height
    return (squares * n - total * total) / (float(n) * n)


def _colour_numbers(red: np.ndarray, green: np.ndarray, blue: np.ndarray) -> tuple[float, float]:
    n, sums, chroma = len(red), [0, 0, 0, 0], 0
    for r, g, b in zip(bands(red), bands(green), bands(blue)):
        r, g, b = (x.astype(np.int64) for x in (r, g, b))
        rg, yb = np.abs(r - g), np.abs(r + g - 2 * b)  # the second is twice the yellow-blue difference
        sums = [s + int(v) for s, v in zip(sums, (rg.sum(), (rg * rg).sum(), yb.sum(), (yb * yb).sum()))]
        top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
        share = np.floor((top - low) * 255 / np.maximum(top, 1) + 0.5)
        chroma += int(np.where(top > 0, share, 0).sum())
    s1, s2 = spread(n, *sums[:2]), spread(n, *sums[2:]) / 2
    m1, m2 = sums[0] / n, sums[2] / n / 2
    return math.sqrt(s1 * s1 + s2 * s2) + 0.3 * math.sqrt(m1 * m1 + m2 * m2), chroma / n / 255


def grid_statistics(images: DataFrame) -> DataFrame:
    """``image_id, mean, std, entropy, laplacian, colourfulness, saturation`` from ``width, height, gray, red, green, blue``."""
    def numbers(width, height, gray, red, green, blue):
        return *_grey_numbers(gray), _laplacian(width, height, gray), *_colour_numbers(red, green, blue)

    return _per_image(images, ["gray", "red", "green", "blue"],
                      ["mean", "std", "entropy", "laplacian", "colourfulness", "saturation"], numbers)


def nth_values(values: np.ndarray, ranks: list[int]) -> list[float]:
    """The values of the given ranks (from 0) in order, by counting bins and refining the bin that holds a rank."""
    return [_nth_value(values, rank) for rank in ranks]


def _nth_value(values: np.ndarray, rank: int) -> float:
    low, high = (float(f(f(b) for b in bands(values))) for f in (min, max))
    while low < high:
        edges = np.linspace(low, high, 1025)
        inside = sum(int(((b >= low) & (b <= high)).sum()) for b in bands(values))
        if inside <= SORTED or not (np.diff(edges) > 0).all():
            held = np.concatenate([b[(b >= low) & (b <= high)] for b in bands(values)])
            below = sum(int((b < low).sum()) for b in bands(values))
            return float(np.partition(held, rank - below)[rank - below])
        counts = sum(np.histogram(b[(b >= low) & (b <= high)], edges)[0] for b in bands(values))
        below = sum(int((b < low).sum()) for b in bands(values))
        bin_of = int(np.searchsorted(below + np.cumsum(counts), rank, "right"))
        within = [b[(b >= edges[bin_of]) & ((b < edges[bin_of + 1]) if bin_of < 1023 else (b <= high))] for b in bands(values)]
        low, high = (float(f(f(b) for b in within if len(b))) for f in (min, max))
    return low


def quantile(values: np.ndarray, share: float) -> float:
    """Exact quantile with linear interpolation between neighbours."""
    place = (len(values) - 1) * share
    lower, upper = math.floor(place), math.ceil(place)
    first, second = nth_values(values, [lower, upper])
    return first if first == second else (upper - place) * first + (place - lower) * second


def _saliency_numbers(width: int, height: int, mass_of: np.ndarray) -> tuple[float, ...]:
    strong_from = quantile(mass_of, 0.9)
    half_x, half_y = width // 2, height // 2
    band_x, band_y = (max(1, math.floor(size * 0.05 + 0.5)) for size in (width, height))
    mass = mx = my = left = right = top = bottom = 0.0
    strong_n = touch_n = 0
    box = [width, -1, height, -1]
    at = 0
    for m in bands(mass_of):
        cell = np.arange(at, at + len(m))
        at += len(m)
        x, y, strong = cell % width, cell // width, m >= strong_from
        mass, mx, my = mass + float(m.sum()), mx + float((m * x).sum()), my + float((m * y).sum())
        left, right = left + float(m[x < max(1, half_x)].sum()), right + float(m[x >= half_x].sum())
        top, bottom = top + float(m[y < max(1, half_y)].sum()), bottom + float(m[y >= half_y].sum())
        edge = (x < band_x) | (x >= width - band_x) | (y < band_y) | (y >= height - band_y)
        strong_n, touch_n = strong_n + int(strong.sum()), touch_n + int((strong & edge).sum())
        if strong.any():
            sx, sy = x[strong], y[strong]
            box = [min(box[0], sx.min()), max(box[1], sx.max()), min(box[2], sy.min()), max(box[3], sy.max())]
    if mass <= 1e-12:
        return 0.5, 0.5, 0.0, 0.0, 1.0, 0.0, 0.0
    cx, cy = mx / mass / max(1.0, width - 1), my / mass / max(1.0, height - 1)
    held = lambda v: max(0.0, min(1.0, v))
    even = lambda a, b: 1.0 - abs(a - b) / max(mass, 1e-8)
    reach = min(math.hypot(cx - tx, cy - ty) for tx in (1 / 3, 2 / 3) for ty in (1 / 3, 2 / 3))
    covered = max(1, (box[1] - box[0] + 1) * (box[3] - box[2] + 1)) / (width * height)
    return (cx, cy, strong_n / len(mass_of), covered, touch_n / max(1, strong_n),
            held((even(left, right) + even(top, bottom)) * 0.5), held(1.0 - reach / 0.4715))


def saliency_properties(images: DataFrame) -> DataFrame:
    """Centre, strong-mask share, box share, edge touch, balance and thirds of each saliency map.

    ``images`` needs ``image_id, width, height, saliency array<double>``. A map
    without mass gives the neutral values.
    """
    return _per_image(images, ["saliency"], ["cx", "cy", "q90_ratio", "box_ratio", "edge_touch", "balance", "thirds"], _saliency_numbers)
