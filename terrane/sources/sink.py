"""Sinks of entities that users write: a dataset is sent to one by its parts, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..model import OsmDataset


class EntitySink:
    """Override what is needed. Parts come as lazy tables, so a sink decides what runs, and where."""

    def begin(self, ds: OsmDataset) -> None:
        """Before all entities; the dataset's metadata can be read here."""

    def nodes(self, nodes: DataFrame) -> None: ...

    def ways(self, ways: DataFrame) -> None: ...

    def relations(self, relations: DataFrame) -> None: ...

    def end(self) -> None:
        """After all entities."""


def send(ds: OsmDataset, sink: EntitySink) -> None:
    sink.begin(ds)
    sink.nodes(ds.nodes)
    sink.ways(ds.ways)
    sink.relations(ds.relations)
    sink.end()
