"""Readers, writers and views over tables."""

from .files import binary_guard, layout_blocks, markdown_layout, read_items, read_manifest, write_json, write_report
from .tables import table
from .views import boxes, items, outline, problems, review_log

__all__ = ["binary_guard", "boxes", "items", "layout_blocks", "markdown_layout", "outline", "problems", "read_items", "read_manifest", "review_log", "table", "write_json", "write_report"]
