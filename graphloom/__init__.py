"""Virtual knowledge graphs over tables and JSON: declare how rows stand for terms, then match graph patterns as DataFrames."""

from graphloom.functions.terms import Const, Namespace, Ref, Template
from graphloom.operators.solutions import Solutions
from graphloom.plans.graph import VirtualGraph
from graphloom.sources.mapping import Source, TriplesMap

__all__ = ["Const", "Namespace", "Ref", "Solutions", "Source", "Template", "TriplesMap", "VirtualGraph"]
