"""The training of the line field against plain Python on some twenty lines."""

import itertools
import math

import numpy as np

from gridleaf.llm import quality_crf as crf

TEXTS = ["A plain line of words.\nAnother line, with more words in it.\nThe end.", "$$$ ### 123\n|||| <> buy now !!!\n%% 77 88 99", "One line alone.", "click here\nclick here\nclick here\nhome | about | help\n###", "Words are here.\n\nMore words are there, and\nthey go on.\n12 34", "{} [] ()\n<<>>"]
LABELS = [1, 0, 1, 0, 1, 0]


def plain_training(x, sizes, labels, steps):
    """By enumerating all label sequences of every document."""
    n, width = len(sizes), len(x[0])
    part = [1 / s for s in sizes for _ in range(s)]
    total = sum(part)
    centre = [sum(p * row[k] for p, row in zip(part, x, strict=True)) / total for k in range(width)]
    scale = [math.sqrt(sum(p * (row[k] - centre[k]) ** 2 for p, row in zip(part, x, strict=True)) / total) for k in range(width)]
    scale = [1.0 if s < 1e-6 else s for s in scale]
    centre[-1], scale[-1] = 0.0, 1.0
    x = [[(v - c) / s for v, c, s in zip(row, centre, scale, strict=True)] for row in x]
    theta, first, second = [0.0] * (width + 4), [0.0] * (width + 4), [0.0] * (width + 4)
    mean_size = max(sum(sizes) / n, 1)
    for step in range(1, steps + 1):
        slope = [0.0] * (width + 4)
        start = 0
        for size, label in zip(sizes, labels, strict=True):
            rows = x[start : start + size]
            unary = [sum(a * b for a, b in zip(row, theta[:width], strict=True)) for row in rows]
            worth = {}
            for path in itertools.product((0, 1), repeat=size):
                worth[path] = math.exp(sum(u for u, y in zip(unary, path, strict=True) if y) + sum(theta[width + 2 * a + b] for a, b in itertools.pairwise(path)))
            z = sum(worth.values())
            for t, row in enumerate(rows):
                good = sum(w for path, w in worth.items() if path[t]) / z
                for k in range(width):
                    slope[k] += row[k] * (label - good) / size / n
            for t in range(1, size):
                slope[width + 3 * label] += 1 / mean_size / n
                for a, b in itertools.product((0, 1), repeat=2):
                    slope[width + 2 * a + b] -= sum(w for path, w in worth.items() if path[t - 1 : t + 1] == (a, b)) / z / mean_size / n
            start += size
        for k in range(width + 4):
            slope[k] -= crf.L2 * theta[k]
            first[k] = 0.9 * first[k] + 0.1 * slope[k]
            second[k] = 0.999 * second[k] + 0.001 * slope[k] ** 2
            theta[k] += crf.RATE * (first[k] / (1 - 0.9**step)) / (math.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return theta, centre, scale


def test_training_matches_plain_python():
    measures, _, begins = crf.line_measures(TEXTS)
    sizes = np.diff(np.r_[begins, len(measures)]).tolist()
    assert 15 <= sum(sizes) <= 25
    held = [m.ravel() for m in np.split(measures, begins[1:])]
    theta, centre, scale = plain_training(crf.positions(measures, begins).tolist(), sizes, LABELS, 40)
    found = crf.train(held, LABELS, 40)
    assert np.allclose(found.centre, centre) and np.allclose(found.scale, scale)
    assert np.allclose(np.r_[found.weights, found.transitions.ravel()], theta, atol=1e-6)
    whole = crf.train(held, LABELS)
    assert ((whole.scores(TEXTS) >= 0.5) == np.array(LABELS, dtype=bool)).all()
