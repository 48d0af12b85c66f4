"""Debug pictures: a page beside itself with boxes drawn on it.  Labels need a font engine and are left out."""

from __future__ import annotations

import numpy as np

SIDES = ("auto", "left", "right", "both")


class Canvas:
    """One image, or two side by side; boxes go on the side that ``draw_on`` names (auto: right if there are two)."""

    def __init__(self, left: np.ndarray, right: np.ndarray | None = None, draw_on: str = "auto"):
        if draw_on not in SIDES:
            raise ValueError(f"draw_on {draw_on!r}: one of {', '.join(SIDES)}")
        parts = [self._color(i) for i in (left, right) if i is not None]
        height = max(p.shape[0] for p in parts)
        self.offsets = [0, parts[0].shape[1]][: len(parts)]
        self.image = np.concatenate([np.pad(p, ((0, height - p.shape[0]), (0, 0), (0, 0)), constant_values=255) for p in parts], axis=1)
        wanted = {"auto": [len(parts) - 1], "left": [0], "right": [len(parts) - 1], "both": range(len(parts))}[draw_on]
        self.targets = [self.offsets[i] for i in wanted]

    @staticmethod
    def _color(image: np.ndarray) -> np.ndarray:
        return np.repeat(image[:, :, None], 3, axis=2) if image.ndim == 2 else image.copy()

    def box(self, box: tuple[float, float, float, float], color: tuple[int, int, int] = (0, 0, 255), thickness: int = 2) -> None:
        """The outline of a box, as far as it lies on the canvas."""
        x0, y0, x1, y1 = (int(v) for v in box)
        height, width = self.image.shape[:2]
        for offset in self.targets:
            for a, b, c, d in ((y0, y0 + thickness, x0, x1), (y1 - thickness, y1, x0, x1), (y0, y1, x0, x0 + thickness), (y0, y1, x1 - thickness, x1)):
                self.image[max(a, 0) : max(min(b, height), 0), max(c + offset, 0) : max(min(d + offset, width), 0)] = color
