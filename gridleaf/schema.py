"""Types of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

BBOX = "struct<x_min: double, y_min: double, x_max: double, y_max: double>"
CELL = f"struct<row: int, col: int, colspan: int, rowspan: int, value: string, bbox: {BBOX}, blobs: array<{BBOX}>>"
TABLE = f"struct<id: string, bbox: {BBOX}, num_rows: int, num_cols: int, cells: array<{CELL}>, start_page: int, end_page: int>"
PARAGRAPH = f"struct<id: string, text: string, type: int, bbox: {BBOX}, blobs: array<{BBOX}>>"
PAGE = f"struct<tables: array<{TABLE}>, paragraphs: array<{PARAGRAPH}>, metadata: map<string, string>>"
METRICS = (
    "struct<has_noise: boolean, has_blur: boolean, has_colored_bg: boolean, has_skew: boolean, contrast_level: double,"
    " text_density: double, noise_ratio: double, sharpness: double, skew_angle: double>"
)
WORD = f"struct<ord: int, text: string, confidence: double, bbox: {BBOX}>"
ROW_ID = "struct<id_table: string, id_row: string>"
ENTRY = f"struct<row_id: {ROW_ID}, record: string, value: double, date: string>"
#: As Spark's ``image`` source: 8-bit rows, one channel (gray, mask) or three (blue, green, red).
IMAGE = "struct<height: int, width: int, channels: int, data: binary>"

#: Codes of Paragraph.type.
HEADER, FOOTER, TEXT = 0, 1, 2


def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)
