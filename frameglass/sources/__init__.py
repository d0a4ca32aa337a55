"""Readers and writers."""

from .csv import NA_TOKENS, read_csv
from .csv_blocks import stage_csv
from .json_blocks import stage_json
from .nested import read_json, read_jsonl
from .reader import (
    corrupt_rows,
    infer_column_kinds,
    null_safe,
    preview,
    read_any,
    read_parquet,
    source_meta,
    validate_source,
)
from .sinks import clean_preview, section_json, write_clean, write_report, write_sections

__all__ = [
    "NA_TOKENS", "clean_preview", "corrupt_rows", "infer_column_kinds", "null_safe", "preview",
    "read_any", "read_csv", "read_json", "read_jsonl", "read_parquet", "section_json",
    "source_meta", "stage_csv", "stage_json", "validate_source", "write_clean", "write_report", "write_sections",
]
