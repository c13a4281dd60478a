"""Queries by topic; importing this package registers all of them."""

from . import crops, dedup, dictionary, evidence, figures, kernels, layout, mathtext, plans, readings, recognition, relational, repair, replay, review, rules, search, sequence, spatial, stats, text, workflow  # noqa: F401
