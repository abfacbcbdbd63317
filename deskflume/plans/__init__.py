"""Registered queries over the driver's tables, and the same rows as SQL."""

from . import desk, edges, knowledge, layout, more, rest, retrieval, streams, upkeep

QUERIES = desk.QUERIES | knowledge.QUERIES | rest.QUERIES | edges.QUERIES | more.QUERIES | retrieval.QUERIES | streams.QUERIES | upkeep.QUERIES | layout.QUERIES
ORACLES = desk.ORACLES | knowledge.ORACLES | rest.ORACLES | edges.ORACLES | more.ORACLES | retrieval.ORACLES | streams.ORACLES | upkeep.ORACLES | layout.ORACLES
