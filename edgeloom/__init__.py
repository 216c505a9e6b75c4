"""edgeloom: graph and edge-list analytics as PySpark DataFrame programs.

Edges are DataFrames ``(u LONG, v LONG)``; labels are ``(node LONG, component LONG)`` with one row per node.
"""

from edgeloom.plans.components import connected_components

__all__ = ["connected_components"]
