"""Tessera: a PySpark-native analytics engine for graph-shaped data."""

from .config import EngineConfig, FtsConfig
from .functions.terms import split_literal, unescape
from .plans.engine import Engine
from .plans.graph import Graph, StoredGraph, VirtualGraph
from .service import Service, TimeoutError
from .sources.store import TripleStore

__all__ = ["Engine", "EngineConfig", "FtsConfig", "Graph", "Service", "StoredGraph", "TimeoutError", "TripleStore", "VirtualGraph", "split_literal", "unescape"]
