"""All registered queries."""

from eventide.plans import q_cleaning, q_io, q_models, q_scoring, q_signals, q_streaming, q_text  # noqa: F401
from eventide.plans.registry import ORACLES, QUERIES  # noqa: F401
