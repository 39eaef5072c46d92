"""Pixel statistics and label banks against plain versions, at sizes that need several bands and blocks."""
from __future__ import annotations

import math
import random
import tracemalloc

import numpy as np
import pytest

from silvergrain.operators import pixels, semantics

GRID = "image_id long, width int, height int, gray array<int>, red array<int>, green array<int>, blue array<int>, saliency array<double>"


def plain_grid(w, h, gray, red, green, blue):
    n = w * h
    mirror = lambda i, size: 0 if size == 1 else -i if i < 0 else 2 * size - 2 - i if i >= size else i
    at = lambda x, y: gray[mirror(y, h) * w + mirror(x, w)]
    lap = [at(x - 1, y) + at(x + 1, y) + at(x, y - 1) + at(x, y + 1) - 4 * at(x, y) for y in range(h) for x in range(w)]
    share = [gray.count(v) / n for v in set(gray)]
    rg, yb = [abs(r - g) for r, g in zip(red, green)], [abs(0.5 * (r + g) - b) for r, g, b in zip(red, green, blue)]
    sat = [math.floor((max(p) - min(p)) * 255 / max(p) + 0.5) if max(p) else 0 for p in zip(red, green, blue)]
    return (np.mean(gray), np.std(gray), -sum(s * math.log2(s) for s in share), np.var(lap),
            math.hypot(np.std(rg), np.std(yb)) + 0.3 * math.hypot(np.mean(rg), np.mean(yb)), np.mean(sat) / 255)


@pytest.mark.parametrize("band", [3, 17, 1 << 20])
def test_grids_in_bands_equal_whole_grids(spark, monkeypatch, band):
    monkeypatch.setattr(pixels, "BAND", band)
    rng = random.Random(band)
    for w, h in ((1, 1), (1, 5), (6, 1), (2, 2), (7, 9), (16, 3)):
        colours = [[rng.choice([0, 3, 255, rng.randrange(256)]) for _ in range(w * h)] for _ in range(4)]
        gray, red, green, blue = (np.array(c, np.int32) for c in colours)
        got = (*pixels._grey_numbers(gray), pixels._laplacian(w, h, gray), *pixels._colour_numbers(red, green, blue))
        assert got == pytest.approx(plain_grid(w, h, *colours), abs=1e-9)


@pytest.mark.parametrize("sorted_at_once", [4, 1 << 16])
def test_quantiles_are_exact_with_ties(monkeypatch, sorted_at_once):
    monkeypatch.setattr(pixels, "SORTED", sorted_at_once)
    monkeypatch.setattr(pixels, "BAND", 50)
    rng = random.Random(1)
    for n in (1, 2, 10, 333):
        for values in ([rng.random() for _ in range(n)], [rng.choice([0.0, 0.5, 0.5, 1.0]) for _ in range(n)], [0.25] * n,
                       [1e-300 * rng.randrange(5) for _ in range(n)], [10.0 ** rng.randrange(-12, 12) for _ in range(n)]):
            cells = np.array(values)
            ranks = sorted({0, n - 1, n // 2, int(0.9 * (n - 1))})
            assert pixels.nth_values(cells, ranks) == [sorted(values)[r] for r in ranks]
            assert pixels.quantile(cells, 0.9) == pytest.approx(np.quantile(cells, 0.9), rel=1e-12)


def plain_saliency(w, h, m):
    q = np.quantile(m, 0.9)
    cells = [(i % w, i // w, v) for i, v in enumerate(m)]
    total = sum(m)
    strong = [(x, y) for x, y, v in cells if v >= q]
    bx, by = max(1, math.floor(w * 0.05 + 0.5)), max(1, math.floor(h * 0.05 + 0.5))
    cx, cy = sum(v * x for x, _, v in cells) / total / max(1, w - 1), sum(v * y for _, y, v in cells) / total / max(1, h - 1)
    touch = sum(x < bx or x >= w - bx or y < by or y >= h - by for x, y in strong) / len(strong)
    xs, ys = [x for x, _ in strong], [y for _, y in strong]
    return cx, cy, len(strong) / len(m), (max(xs) - min(xs) + 1) * (max(ys) - min(ys) + 1) / (w * h), touch


@pytest.mark.parametrize("band", [5, 1 << 20])
def test_saliency_in_bands(monkeypatch, band):
    monkeypatch.setattr(pixels, "BAND", band)
    rng = np.random.default_rng(band)
    for w, h in ((4, 4), (30, 7), (1, 12)):
        m = rng.choice([0.125, 0.25, 0.5, 2.0], w * h)
        assert pixels._saliency_numbers(w, h, m)[:5] == pytest.approx(plain_saliency(w, h, m.tolist()), abs=1e-12)
    assert pixels._saliency_numbers(3, 2, np.zeros(6)) == (0.5, 0.5, 0.0, 0.0, 1.0, 0.0, 0.0)


def test_no_shuffle_and_broken_grids_left_out(spark):
    ints, mass = [1, 2, 3, 4], [0.1, 0.2, 0.3, 0.4]
    rows = [(1, 2, 2, ints, ints, ints, ints, mass), (2, 2, 2, None, ints, ints, ints, None), (3, 2, 2, [1, 2, 3], ints, ints, ints, mass[:3]),
            (4, 2, 2, [1, None, 3, 4], ints, ints, ints, [0.1, None, 0.3, 0.4]), (5, 0, 0, [], [], [], [], []),
            (6, None, 2, ints, ints, ints, ints, mass)]
    images = spark.createDataFrame(rows, GRID)
    for made in (pixels.grid_statistics(images), pixels.saliency_properties(images)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        assert [r["image_id"] for r in made.collect()] == [1]
    assert pixels.grid_statistics(images.limit(0)).count() == 0


def test_a_large_image_needs_little_memory():
    """Twelve megapixels: what is kept besides the row stays far below one copy of it."""
    w, h = 4000, 3000
    gray, mass = np.tile(np.arange(4000, dtype=np.int32) % 251, 3000), np.tile(np.linspace(0, 1, 4000), 3000)
    tracemalloc.start()
    assert pixels._laplacian(w, h, gray) > 0 and pixels._grey_numbers(gray)[0] > 0
    assert pixels._saliency_numbers(w, h, mass)[0] > 0.5
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20 and len(gray) * 8 + len(mass) * 8 > 180 << 20


def plain_softmax(vector, bank):
    logits = [sum(x * y for x, y in zip(vector, v)) for _, _, v in bank]
    top = max(logits)
    total = sum(math.exp(x - top) for x in logits)
    return [(math.exp(x - top) / total, p, la) for x, (p, la, _) in zip(logits, bank)]


@pytest.mark.parametrize("bank_bytes,products", [(64 << 20, 2_000_000), (8 * 3 * 8, 40)], ids=["one block", "many blocks"])
def test_probabilities_over_blocks(spark, monkeypatch, bank_bytes, products):
    monkeypatch.setattr(semantics, "PRODUCTS", products)
    rng = random.Random(4)
    bank = [(i, f"l{i}", [rng.choice([-1.0, 0.5, 2.0]) for _ in range(3)]) for i in range(40)]  # many labels tie
    vectors = [[rng.uniform(-2, 2) for _ in range(3)] for _ in range(30)] + [[400.0, -400.0, 400.0], [0.0, 0.0, 0.0]]
    rows = list(enumerate(vectors)) + [(100, None), (101, [1.0]), (102, [1.0, None, 2.0])]
    images = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    table = spark.createDataFrame(bank, "label_pos int, label string, vector array<double>")
    every = {r["vec_id"]: r["probs"] for r in semantics.label_probabilities(images, table, "vec_id", bank_bytes).collect()}
    first = {r["vec_id"]: r["top"] for r in semantics.top_probabilities(images, table, "vec_id", 6, bank_bytes).collect()}
    for i, vector in enumerate(vectors):
        want = plain_softmax(vector, bank)
        assert [(p["label_pos"], p["label"]) for p in every[i]] == [(p, la) for _, p, la in want]
        assert [p["p"] for p in every[i]] == pytest.approx([p for p, _, _ in want], abs=1e-9)
        logits = [round(sum(x * y for x, y in zip(vector, v)), 9) for _, _, v in bank]
        order = sorted(range(40), key=lambda n: (-logits[n], n))[:6]
        assert [t["label"] for t in first[i]] == [f"l{n}" for n in order]
        assert [t["score"] for t in first[i]] == pytest.approx([want[n][0] for n in order], abs=1e-6)
    assert all(every[i] is None and first[i] is None for i in (100, 101, 102))


def test_a_bank_of_fifty_thousand_labels():
    rng = np.random.default_rng(0)
    bank, rows = rng.standard_normal((50_000, 16)), 60 * rng.standard_normal((40, 16))
    top, total, labels, products = semantics.softmax_parts(rows, bank, 6)
    logits = rows @ bank.T
    assert logits.max() > 709 and np.isfinite(total).all()
    whole = np.exp(logits - logits.max(1)[:, None])
    assert np.exp(np.stack(products) - top[:, None]) / total[:, None] == pytest.approx(
        np.take_along_axis(whole / whole.sum(1)[:, None], np.stack(labels), 1), rel=1e-9)
    assert (np.stack(labels) == (-logits).argsort(1)[:, :6]).all()


def test_margin_equals_the_means_of_the_sides(spark):
    bank = spark.createDataFrame([(0, "pos", [1.0, 2.0]), (1, "pos", [0.0, 1.0]), (2, "neg", [3.0, -1.0])],
                                 "label_pos int, label string, vector array<double>")
    images = spark.createDataFrame([(1, [1.0, 1.0])], "vec_id long, vector array<double>")
    assert semantics.prompt_margin(images, bank).first()["margin"] == pytest.approx((3 + 1) / 2 - 2)
