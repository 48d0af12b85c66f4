"""Array kernels against brute force, and whole drawn pages."""

import dataclasses

import numpy as np
import pytest

from gridleaf.config import Settings, TableSettings
from gridleaf.operators import detect
from gridleaf.operators import kernels as k


def masks(n=25, shape=(17, 23), seed=4):
    rng = np.random.default_rng(seed)
    for i in range(n):
        yield np.where(rng.random(shape) < 0.15 + 0.03 * (i % 20), 255, 0).astype(np.uint8)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 40])
@pytest.mark.parametrize("iterations", [1, 2])
def test_erode_and_dilate(size, iterations):
    for mask in masks(5):
        for axis in (0, 1):
            want_e, want_d = mask, mask
            for _ in range(iterations):
                for kind in ("e", "d"):
                    src = want_e if kind == "e" else want_d
                    out = np.zeros_like(src)
                    line = np.moveaxis(src, axis, -1)
                    to = np.moveaxis(out, axis, -1)
                    for at in range(line.shape[-1]):
                        part = line[..., max(0, at - size // 2) : at - size // 2 + size]
                        to[..., at] = part.min(axis=-1) if kind == "e" else part.max(axis=-1) if part.shape[-1] else 0
                    want_e, want_d = (out, want_d) if kind == "e" else (want_e, out)
            assert (k.erode_line(mask, axis, size, iterations) == want_e).all()
            assert (k.dilate_line(mask, axis, size, iterations) == want_d).all()


@pytest.mark.parametrize("diagonal", [True, False])
def test_components(diagonal):
    for mask in masks():
        labels, n = k.components(mask, diagonal)
        seen = np.zeros(mask.shape, dtype=int)
        count = 0
        for y, x in zip(*np.nonzero(mask), strict=True):
            if seen[y, x]:
                continue
            count += 1
            todo = [(y, x)]
            seen[y, x] = count
            while todo:
                a, b = todo.pop()
                for i in (-1, 0, 1):
                    for j in (-1, 0, 1):
                        p, q = a + i, b + j
                        if (diagonal or not (i and j)) and 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and mask[p, q] and not seen[p, q]:
                            seen[p, q] = count
                            todo.append((p, q))
        assert n == count and (labels == seen).all()


def test_otsu():
    rng = np.random.default_rng(2)
    for _ in range(20):
        gray = rng.integers(0, 256, (9, 9)).astype(np.uint8)
        best = (-1.0, 0)
        for t in sorted(set(gray.ravel().tolist())):
            low, high = gray[gray <= t].astype(float), gray[gray > t].astype(float)
            if len(high):
                best = max(best, (len(low) * len(high) * (low.mean() - high.mean()) ** 2, -t))
        assert k.otsu_threshold(gray) == -best[1]


def test_contours_of_shapes():
    mask = np.zeros((30, 30), dtype=np.uint8)
    mask[2:12, 3:18] = 255  # a block
    mask[5:9, 6:12] = 0  # with a hole
    mask[6:8, 8:10] = 255  # and something in the hole, which is not outside
    mask[20, 20] = 255  # a dot
    found = k.external_contours(mask)
    assert len(found) == 2
    block = found[0]
    assert block.min(axis=0).tolist() == [3, 2] and block.max(axis=0).tolist() == [17, 11]
    assert k.polygon_area(block) == 14 * 9
    corners = k.simplify(block, 0.02 * k.perimeter(block))
    assert sorted(map(tuple, corners.tolist())) == [(3, 2), (3, 11), (17, 2), (17, 11)]
    assert len(found[1]) == 1 and k.polygon_area(found[1]) == 0


def test_contour_covers_extent():
    for mask in masks(30, (12, 12), 9):
        labels, n = k.components(mask)
        boxes = {tuple(b[:4]) for b in k.boxes_of(labels, n).tolist()}
        for c in k.external_contours(mask):
            (x, y), (r, b) = c.min(axis=0).tolist(), c.max(axis=0).tolist()
            assert (x, y, r - x + 1, b - y + 1) in boxes


def ruled(rows, cols, height=400, width=400, cell=(60, 80), origin=(30, 20), skip=()):
    page = np.full((height, width), 235, dtype=np.uint8)
    x0, y0 = origin
    for r in range(rows + 1):
        page[y0 + cell[0] * r : y0 + cell[0] * r + 2, x0 : x0 + cell[1] * cols + 2] = 15
    for c in range(cols + 1):
        for r in range(rows):
            if (r, c) not in skip:
                page[y0 + cell[0] * r : y0 + cell[0] * (r + 1) + 2, x0 + cell[1] * c : x0 + cell[1] * c + 2] = 15
    return page


@pytest.mark.parametrize(("rows", "cols"), [(2, 3), (3, 4), (5, 3)])
def test_drawn_table(rows, cols):
    (table,) = detect.detect_tables(ruled(rows, cols))
    assert (table["num_rows"], table["num_cols"], len(table["cells"])) == (rows, cols, rows * cols)
    assert table["id"] == "table_0"
    first = table["cells"][0]["bbox"]
    assert abs(first["x_min"] - 30) <= 3 and abs(first["y_min"] - 20) <= 3


def test_merged_cells():
    page = ruled(3, 4, skip={(0, 1), (0, 2)})
    (table,) = detect.detect_tables(page)
    wide = [c for c in table["cells"] if c["row"] == 0]
    assert [(c["col"], c["colspan"]) for c in wide] == [(0, 3), (3, 1)]
    assert len(table["cells"]) == 10
    unmerged = Settings(table_detector=TableSettings(mode_merge_cells=None))
    assert len(detect.detect_tables(page, unmerged)[0]["cells"]) == 12
    every = Settings(table_detector=TableSettings(mode_merge_cells="all"))
    assert {(c["row"], c["col"], c["colspan"]) for c in detect.detect_tables(page, every)[0]["cells"] if c["row"] == 0} == {(0, 0, 3), (0, 3, 1)}


def test_empty_pages():
    assert detect.detect_tables(np.full((50, 50), 255, dtype=np.uint8)) == []
    assert detect.extract_cells(np.zeros((0, 0), dtype=np.uint8), (0, 0, 0, 0), Settings(), "cols") == []


def test_remove_lines_and_paragraphs():
    page = ruled(2, 3)
    page[350:362, 40:140] = 10
    mask = detect.table_mask(page, Settings())
    box = detect.find_tables(mask, Settings())[0]
    clean = detect.remove_table_lines(page, mask, box)
    assert (clean[20:142, 30:272] < 100).mean() < 0.02 and (page[20:142, 30:272] < 100).mean() > 0.05
    found = detect.find_paragraphs(detect.paragraph_mask(page, [box]))
    assert any(y0 >= 330 for _, y0, _, _ in found) and all(y1 < 16 or y0 > 130 for _, y0, _, y1 in found)


def test_quality_of_straight_and_turned_page():
    page = ruled(4, 4)
    straight = detect.quality(page)
    assert not straight["has_skew"] and straight["skew_angle"] == 0 and not straight["has_colored_bg"]
    turned = k.rotate(page, 3.0)
    assert detect.quality(turned)["has_skew"]
    back = detect.enhance(turned, detect.quality(turned))
    assert abs(k.skew_angle(back)) <= 0.3
    color = np.stack([page, page, np.maximum(page, 40) - 40], axis=2)
    assert detect.quality(color)["has_colored_bg"]


@pytest.mark.parametrize("kernel", [k.median3, k.sharpen, k.clahe, k.denoise_tv, k.auto_gamma, k.unsharp_mask, k.adaptive_threshold, lambda a: k.gaussian_blur(a, 7), lambda a: k.clahe(a, 2.0, 16)])
def test_enhancers_keep_shape(kernel):
    gray = ruled(2, 2, 90, 110, (20, 30))
    out = kernel(gray)
    assert out.shape == gray.shape and out.dtype == np.uint8
    flat = np.full((40, 40), 200, dtype=np.uint8)
    assert kernel(flat).std() == 0


def test_settings_from_dict():
    s = Settings.from_dict({"table_detector": {"min_table_area": 5}})
    assert s.table_detector.min_table_area == 5 and s.cell_detector.padding == 10
    with pytest.raises(TypeError):
        Settings.from_dict({"table_detector": {"unknown": 1}})
    with pytest.raises(dataclasses.FrozenInstanceError):
        s.table_detector.min_table_area = 1
    with pytest.raises(ValueError):
        detect.detect_lines(np.zeros((3, 3), dtype=np.uint8), 2, "diagonal")


def test_canvas():
    from gridleaf.operators.drawing import Canvas

    page = np.full((20, 30), 255, dtype=np.uint8)
    for mode, columns in (("left", {5}), ("right", {35}), ("both", {5, 35}), ("auto", {35})):
        canvas = Canvas(page, page[:10], mode)
        canvas.box((5, 5, 15, 15), (1, 2, 3), 1)
        assert canvas.image.shape == (20, 60, 3)
        assert {int(x) for x in np.flatnonzero((canvas.image[7] == (1, 2, 3)).all(axis=1)) if x % 30 == 5} == columns
    Canvas(page).box((-50, -50, 500, 500))
    with pytest.raises(ValueError):
        Canvas(page, None, "top")


def test_line_mask_of_a_table():
    mask = np.arange(100, dtype=np.uint8).reshape(10, 10)
    assert (detect.table_line_mask(mask, (2, 3, 5, 6)) == mask[3:6, 2:5]).all()
    assert detect.table_line_mask(mask, (2, 3, 5, 6), 5).shape == (10, 10)


def mirrored(n, i):
    """The pixel that stands for a place outside: the edge itself is not repeated."""
    return -i if i < 0 else 2 * (n - 1) - i if i >= n else i


def blurred_by_hand(gray, size, sigma=0.0):
    weights, reach = k.gaussian_kernel(size, sigma), size // 2
    h, w = gray.shape
    return np.array([[sum(weights[dy + reach] * weights[dx + reach] * float(gray[mirrored(h, y + dy), mirrored(w, x + dx)]) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)) for x in range(w)] for y in range(h)])


def test_blur_threshold_and_unsharp_by_hand():
    gray = np.random.default_rng(5).integers(0, 256, (14, 17)).astype(np.uint8)
    assert abs(k.gaussian_kernel(7).sum() - 1) < 1e-12 and (k.gaussian_kernel(7) == k.gaussian_kernel(7)[::-1]).all()
    want = blurred_by_hand(gray, 7)
    assert np.abs(k.gaussian_blur(gray, 7) - want).max() <= 0.5 + 1e-6
    sure = np.abs(gray - (want - 11)) > 1  # where rounding cannot decide
    assert ((k.adaptive_threshold(gray, 7, 11) == 255) == (gray > want - 11))[sure].all()
    soft = blurred_by_hand(gray, 7, 1.0)
    assert np.abs(k.unsharp_mask(gray, 1.5, 1.0).astype(float) - np.clip(2.5 * gray - 1.5 * soft, 0, 255)).max() <= 1.5
    color = np.stack([gray, gray[::-1], gray], axis=2)
    assert (k.unsharp_mask(color)[:, :, 0] == k.unsharp_mask(gray)).all()


def test_median_by_hand():
    gray = np.random.default_rng(6).integers(0, 256, (9, 11)).astype(np.uint8)
    clip = lambda n, i: min(max(i, 0), n - 1)
    for y in range(9):
        for x in range(11):
            assert k.median3(gray)[y, x] == sorted(gray[clip(9, y + a), clip(11, x + b)] for a in (-1, 0, 1) for b in (-1, 0, 1))[4]


def test_one_tile_of_local_equalization_by_hand():
    gray = np.random.default_rng(7).integers(90, 140, (32, 32)).astype(np.uint8)
    n = [int((gray == v).sum()) for v in range(256)]
    limit = max(1, int(2.0 * gray.size / 256))
    over = sum(max(0, c - limit) for c in n)
    n = [min(c, limit) + over // 256 + (v < over % 256) for v, c in enumerate(n)]
    curve = [min(255.0, sum(n[: v + 1]) * 255.0 / gray.size) for v in range(256)]
    assert np.abs(k.clahe(gray, 2.0, 1).astype(float) - np.array(curve)[gray]).max() <= 0.5 + 1e-9
    assert k.clahe(gray, 2.0, 8).std() > gray.std(), "contrast grows"


def test_lightness_space():
    rng = np.random.default_rng(8)
    image = rng.integers(0, 256, (20, 20, 3)).astype(np.uint8)
    assert (k.from_lab(k.to_lab(image)) == image).all()
    known = np.array([[[255, 255, 255], [0, 0, 0], [0, 0, 255], [255, 0, 0], [0, 128, 0]]], dtype=np.uint8)  # white, black, red, blue, green
    assert np.abs(k.to_lab(known)[0] - [(100, 0, 0), (0, 0, 0), (53.24, 80.09, 67.20), (32.30, 79.19, -107.86), (46.23, -51.70, 49.90)]).max() < 0.05
    # A faint tint, which no lightness can drive out of the range of colours.
    flat = np.tile(np.array([[[112, 116, 120]]], dtype=np.uint8), (32, 32, 1)) + rng.integers(0, 8, (32, 32, 1)).astype(np.uint8)
    before, after = k.to_lab(flat), k.to_lab(k.clahe_color(flat))
    assert np.abs(before[:, :, 1:] - after[:, :, 1:]).max() < 1.5 and after[:, :, 0].std() > before[:, :, 0].std()


def test_denoising_by_definition():
    """The result has a lower energy (variation and absolute difference) than the noisy image; a flat one stays."""
    rng = np.random.default_rng(9)
    clean = np.zeros((24, 24))
    clean[:, 12:] = 200
    noisy = np.clip(clean + 20 + rng.normal(0, 15, clean.shape), 0, 255).astype(np.uint8)
    energy = lambda u: np.abs(np.diff(u.astype(float), axis=0)).sum() + np.abs(np.diff(u.astype(float), axis=1)).sum() + np.abs(u.astype(float) - noisy).sum()
    assert energy(k.denoise_tv(noisy, 1.0, 60)) < energy(noisy)
    assert (k.denoise_tv(np.full((9, 9), 77, dtype=np.uint8), 1.0, 5) == 77).all()
