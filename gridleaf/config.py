"""Settings of detection and recognition.  The numbers are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class TableSettings:
    min_table_area: int = 10_000
    approx_poly_eps: float = 0.02
    #: ``all``, ``cols``, ``rows`` or None: which cells without a line between them merge.
    mode_merge_cells: str | None = "cols"


@dataclass(frozen=True)
class CellSettings:
    min_cell: int = 10
    padding: int = 10
    threshold_line: int = 4
    coverage_thr: float = 0.8


@dataclass(frozen=True)
class LineSettings:
    gaussian_blur_kernel: int = 1
    horizontal_length_ratio: float = 0.03
    vertical_length_ratio: float = 0.006
    min_table_width_ratio: float = 0.5
    min_table_height_ratio: float = 0.05


@dataclass(frozen=True)
class QualitySettings:
    noise_area: float = 10
    blur_below: float = 500.0
    colored_above: float = 15.0
    noise_above: float = 0.25
    skew_above: float = 0.5


@dataclass(frozen=True)
class OcrSettings:
    text_recognition_model_name: str = "cyrillic_PP-OCRv5_mobile_rec"
    text_recognition_model_dir: str = "../models/cyrillic_PP-OCRv5_mobile_rec"
    text_detection_model_name: str = "PP-OCRv5_server_det"
    text_detection_model_dir: str = "../models/PP-OCRv5_server_det"
    use_doc_orientation_classify: bool = False
    use_doc_unwarping: bool = False
    use_textline_orientation: bool = False
    device: str = "cpu"


@dataclass(frozen=True)
class Settings:
    table_detector: TableSettings = field(default_factory=TableSettings)
    cell_detector: CellSettings = field(default_factory=CellSettings)
    table_preprocessor: LineSettings = field(default_factory=LineSettings)
    paddleocr: OcrSettings = field(default_factory=OcrSettings)

    @classmethod
    def from_dict(cls, values: dict) -> Settings:
        """Sections that are absent keep their defaults; an unknown key in a section is a TypeError."""
        return cls(**{f.name: f.default_factory(**values[f.name]) for f in fields(cls) if f.name in values})
