"""The query catalogue. Importing this package registers every query."""

from . import asof_plans, book_plans, evidence_plans, feed_plans, outcome_plans, selection_plans, series, stream_plans, text_plans, universe_quality  # noqa: F401
from .spec import REGISTRY  # noqa: F401
