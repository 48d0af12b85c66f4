"""Recognised words.  The engine is a protocol; none is bundled.

An engine is made once per Python worker by a factory and gets page images one after the
other.  ``FixedEngine`` gives prepared results and serves tests.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame

from gridleaf.config import OcrSettings
from gridleaf.operators.detect import map_pages
from gridleaf.schema import BBOX


@dataclass(frozen=True)
class Word:
    text: str
    confidence: float
    bbox: tuple[int, int, int, int]


class Engine(Protocol):
    def predict(self, images: Iterable[np.ndarray]) -> Iterator[list[Word]]:
        """The words of each image, in reading order."""


def from_arrays(result: dict) -> list[Word]:
    """Words from parallel arrays; the shortest ends them, missing ones count as empty."""
    arrays = [list(result[k]) if result.get(k) is not None else [] for k in ("rec_texts", "rec_scores", "rec_boxes")]
    return [Word(t, float(s), tuple(int(v) for v in b)) for t, s, b in zip(*arrays, strict=False)]


def check_models(settings: OcrSettings) -> None:
    """FileNotFoundError unless both model folders are there; detection is looked for first."""
    for folder in (settings.text_detection_model_dir, settings.text_recognition_model_dir):
        if not os.path.isdir(folder):
            raise FileNotFoundError(f"no model folder {folder}")


class FixedEngine:
    """Gives the same prepared words for every image of a size."""

    def __init__(self, by_size: dict[tuple[int, int], list[Word]]):
        self.by_size = by_size

    def predict(self, images: Iterable[np.ndarray]) -> Iterator[list[Word]]:
        for image in [images] if isinstance(images, np.ndarray) else images:
            yield self.by_size.get(image.shape[:2], [])


_engines: dict[object, Engine] = {}


def recognise(pages: DataFrame, keys: list[str], factory: Callable[[], Engine], image: str = "image") -> DataFrame:
    """keys, ord, text, confidence, bbox: one row per word of each page image."""

    def words(array: np.ndarray) -> list[dict]:
        if factory not in _engines:
            _engines[factory] = factory()
        found = next(iter(_engines[factory].predict([array])), [])
        return [{"ord": i, "text": w.text, "confidence": w.confidence, "bbox": dict(zip(("x_min", "y_min", "x_max", "y_max"), map(float, w.bbox), strict=True))} for i, w in enumerate(found)]

    return map_pages(pages, keys, words, f"ord int, text string, confidence double, bbox {BBOX}", image)
