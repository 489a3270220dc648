"""All registered queries."""

from .catalog_core import core
from .catalog_datasets import datasets
from .catalog_evaluation import evaluation
from .catalog_signals import signals
from .catalog_sources import sources
from .catalog_streaming import streaming

_PARTS = [core, sources, signals, evaluation, datasets, streaming]

QUERIES = {}
ORACLES = {}
COVERS = {}
for _part in _PARTS:
    clash = QUERIES.keys() & _part.queries.keys()
    if clash:
        raise ValueError(f"registered twice: {sorted(clash)}")
    QUERIES.update(_part.queries)
    ORACLES.update(_part.oracles)
    COVERS.update(_part.covers)
