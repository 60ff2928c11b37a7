"""Readers, source sniffing and nested flattening."""

from starweave.sources.readers import (
    SUPPORTED_FORMATS,
    read_any,
    read_csv,
    read_json,
    read_jsonl,
    read_parquet,
    read_with_schema,
    format_from_path,
)
from starweave.sources.sniff import file_metadata, sniff_delimiter, sniff_encoding, validate_source
from starweave.sources.nested import flatten_nested

__all__ = [
    "SUPPORTED_FORMATS",
    "read_any",
    "read_csv",
    "read_json",
    "read_jsonl",
    "read_parquet",
    "read_with_schema",
    "format_from_path",
    "file_metadata",
    "sniff_delimiter",
    "sniff_encoding",
    "validate_source",
    "flatten_nested",
]
