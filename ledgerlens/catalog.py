"""Imports every module that registers queries, so that the registry is complete."""

from ledgerlens.operators import aggregates, cascades, feeds, graph, imports, intervals, joins, ledger, ranking, repository, retrieval, sets, text_safety  # noqa: F401
from ledgerlens.plans import families, files, flows  # noqa: F401
from ledgerlens.registry import REGISTRY
from ledgerlens.sources import lines, manifests  # noqa: F401
from ledgerlens.streaming import checkpoints  # noqa: F401

__all__ = ["REGISTRY"]
