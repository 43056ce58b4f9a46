"""The query catalogue; importing it registers every query."""

from . import catalog, derived, effects, evaluation, graphs, learning, ledgers, project, retrieval

__all__ = ["catalog", "derived", "effects", "evaluation", "graphs", "learning", "ledgers", "project", "retrieval"]
