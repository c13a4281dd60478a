"""Writes as plans: DataFrames that say what would be done, and the append that does it."""

from .writes import apply_overrides, append_new, append_versions, identity_upsert, merge_plan, next_stage, pages_to_do, replace_children, validate

__all__ = ["append_new", "append_versions", "apply_overrides", "identity_upsert", "merge_plan", "next_stage", "pages_to_do", "replace_children", "validate"]
