"""Registered queries: one per operator of the inventory, each with the
equivalent DuckDB SQL where one exists.  Each query reads the given tables
(or data Spark derives from them) in full."""

from __future__ import annotations

from ._registry import ORACLES, QUERIES, query  # noqa: F401
from . import (graph_q, relational_q, sinks_q, sources_q, streaming_q,  # noqa: F401
               transforms_q)
