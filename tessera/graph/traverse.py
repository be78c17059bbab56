"""A builder for traversals: hops over edge tables are equi-joins; rows are paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .loader import Graph
from .schema import EDGES


class Traversal:
    """Paths from the nodes of a table. ``start`` holds the first node's id and ``at`` that of the last one.

    A path is a row, so a node reached twice is there twice. A hop keeps the
    columns that were picked up before.
    """

    def __init__(self, graph: Graph, table: str, nodes: DataFrame | None = None, paths: DataFrame | None = None) -> None:
        self.graph, self.table = graph, table
        self.paths = paths if paths is not None else (graph.nodes[table] if nodes is None else nodes).select(F.col("id").alias("start"), F.col("id").alias("at"))

    def _hop(self, edge: str, here: str, there: str, table: str, props: dict[str, str] | None) -> Traversal:
        e = self.graph.edges[edge].select(F.col(here).alias("_here"), F.col(there).alias("_there"), *[F.col(p).alias(a) for p, a in (props or {}).items()])
        kept = [c for c in self.paths.columns if c != "at"]
        joined = self.paths.join(e, F.col("at") == F.col("_here"))
        return Traversal(self.graph, table, paths=joined.select(*kept, F.col("_there").alias("at"), *(props or {}).values()))

    def out(self, edge: str, props: dict[str, str] | None = None) -> Traversal:
        """Along an edge; ``props``: its properties to pick up, and their names."""
        if EDGES[edge][0] != self.table:
            raise ValueError(f"{edge} does not start at {self.table}")
        return self._hop(edge, "src", "dst", EDGES[edge][1], props)

    def in_(self, edge: str, props: dict[str, str] | None = None) -> Traversal:
        """Against an edge."""
        if EDGES[edge][1] != self.table:
            raise ValueError(f"{edge} does not end at {self.table}")
        return self._hop(edge, "dst", "src", EDGES[edge][0], props)

    def pick(self, **props: str) -> Traversal:
        """Properties of the node where the paths are: new name = property."""
        n = self.graph.nodes[self.table].select(F.col("id").alias("_id"), *[F.col(p).alias(a) for a, p in props.items()])
        return Traversal(self.graph, self.table, paths=self.paths.join(n, F.col("at") == F.col("_id")).drop("_id"))

    def where(self, condition: Column | str) -> Traversal:
        """Keep paths by what was picked up."""
        return Traversal(self.graph, self.table, paths=self.paths.filter(condition))

    def rows(self) -> DataFrame:
        return self.paths

    def aggregate(self, *aggs: Column) -> DataFrame:
        """One row for each start that has a path: (start, aggregates)."""
        return self.paths.groupBy("start").agg(*aggs)

    def collect(self, name: str, *cols: str) -> DataFrame:
        """(start, array of structs, sorted): for starts whose paths fit in a row; use ``rows`` for others."""
        return self.aggregate(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
