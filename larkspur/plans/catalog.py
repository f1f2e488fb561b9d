"""Imports every query module so the registry is complete."""

from larkspur.plans import q_campaigns, q_classify, q_confidence, q_decks, q_extract, q_joins, q_normalize, q_preferences, q_quality, q_ranking, q_streams, q_urls  # noqa: F401
from larkspur.plans.registry import ORACLES, QUERIES, callables  # noqa: F401
