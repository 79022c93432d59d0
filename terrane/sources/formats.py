"""Spark data sources "osmpbf" and "vex", to read and write.

A path is a file, or a folder of parts. Beside a file there may be a directory of its blocks, FILE.blocks: kind, number and least and greatest
id of each, and where it lies. With it a reader takes only the blocks that can hold what is asked for, by kind, by the options low and high, or by the
ids that look_up() is given; without it, PBF blocks of every kind are inflated. Filters are not pushed by Spark: as of 4.1, what a Python source is once
pushed stays with the DataFrame, and a later query on the same one, without the filter, would read too little. Writers make a folder: each task writes a part with its directory, and the driver then commits the list of
parts, in the order of partitions. What a failed job has written is in no list, so nobody reads it; it goes when the job ends or, where a task was
still writing then, with tidy().

Options: path (local, or on a file system that Arrow opens) and entity (nodes, ways or relations); low and high, bounds of ids, which rows may be outside of; keys, apart by commas, keeps only tags of these keys;
limits=false lifts the VEX reader's bounds on tags and strings.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..model import NODES, RELATIONS, WAYS
from ..plans.lineage import cut
from . import opened, pbf, vex
from .rows import from_batch, to_batches

SCHEMA_OF = {"nodes": NODES, "ways": WAYS, "relations": RELATIONS}
KINDS = tuple(SCHEMA_OF)
PARTS = "_parts.json"
PIECE = 4 << 20  # bytes of blocks that a task reads
_BLOCKS = pa.schema([("offset", pa.int64()), ("size", pa.int64()), ("kind", pa.string()), ("count", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


@dataclass(frozen=True)
class Block:
    offset: int
    size: int
    kind: str | None = None  # None: not known, as are low and high
    count: int = 0
    low: int | None = None
    high: int | None = None


class Piece(InputPartition):
    """Blocks of a file; None: those that its directory has."""

    def __init__(self, path: str, blocks: list[Block] | None):
        self.path, self.blocks = path, blocks


def read_directory(path: str) -> list[Block]:
    with opened.read_from(path + ".blocks") as f:
        return [Block(**r) for r in pq.read_table(f).to_pylist()]


def write_directory(path: str, blocks: Iterable[Block]) -> None:
    with opened.write_to(path + ".blocks") as f:
        pq.write_table(pa.Table.from_pylist([b.__dict__ for b in blocks], _BLOCKS), f)


def read_parts(path: str) -> list[dict]:
    """The committed parts of a folder, in order."""
    with opened.read_from(f"{path}/{PARTS}") as f:
        return json.loads(f.read())


def _walk_pbf(f) -> list[Block]:
    return [Block(at, n) for kind, at, n in pbf.frames(f) if kind == "OSMData"]


def _walk_vex(f) -> list[Block]:
    return [Block(at, size, kind, n) for kind, n, at, size in vex.blocks(f)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.entity = options["path"], options.get("entity", "nodes")
        self.keys = set(options["keys"].split(",")) if options.get("keys") else None
        self.limits = str(options.get("limits", "true")).lower() != "false"
        self.low, self.high = int(options.get("low", -(1 << 63))), int(options.get("high", (1 << 63) - 1))
        self.only = json.loads(options["only"]) if "only" in options else None  # offsets of blocks, by file

    def _may_hold(self, low: int | None, high: int | None) -> bool:
        return low is None or low <= self.high and high >= self.low

    def wanted(self, blocks: Iterable[Block]) -> list[Block]:
        return [b for b in blocks if b.kind in (None, self.entity) and self._may_hold(b.low, b.high)]

    def partitions(self) -> list[Piece]:
        if self.only is not None:
            chosen = {path: set(offsets) for path, offsets in self.only.items()}
            return [p for path, offsets in chosen.items() for p in self._pieces(path, [b for b in read_directory(path) if b.offset in offsets])]
        if not opened.is_file(self.path):
            return [Piece(f"{self.path}/{p['name']}", None) for p in read_parts(self.path) if self._may_hold(p["low"], p["high"])]
        if opened.is_file(self.path + ".blocks"):
            return self._pieces(self.path, read_directory(self.path))
        with opened.read_from(self.path) as f:
            return self._pieces(self.path, self.walk(f))

    def _pieces(self, path: str, blocks: list[Block]) -> list[Piece]:
        out, size = [], PIECE
        for b in self.wanted(blocks):
            if size >= PIECE:
                out.append(Piece(path, []))
                size = 0
            out[-1].blocks.append(b)
            size += b.size
        return out

    def entities(self, piece: Piece) -> Iterator[tuple]:
        blocks = self.wanted(read_directory(piece.path)) if piece.blocks is None else piece.blocks
        with opened.read_from(piece.path) as f:
            for b in blocks:
                f.seek(b.offset)
                yield from self.decode(b, f.read(b.size))

    def read(self, partition):
        if partition is None:  # no blocks: Spark still asks once
            return
        kept = (e if self.keys is None else (*e[:-1], [t for t in e[-1] if t[0] in self.keys]) for e in self.entities(partition))
        yield from to_batches(self.entity, kept)


class PbfReader(_Reader):
    walk = staticmethod(_walk_pbf)

    def decode(self, block: Block, data: bytes) -> Iterator[tuple]:
        return pbf.decode(pbf.inflate(data), self.entity)


class VexReader(_Reader):
    walk = staticmethod(_walk_vex)

    def decode(self, block: Block, data: bytes) -> Iterator[tuple]:
        return vex.decode(self.entity, block.count, data, self.limits)


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str | None
    count: int = 0
    low: int | None = None
    high: int | None = None


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool, fmt: str):
        self.path, self.entity, self.fmt, self.overwrite = options["path"], options.get("entity", "nodes"), fmt, overwrite
        self.job = uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        """One part: blocks as they get full, and their directory."""
        codec, walk = (pbf, _walk_pbf) if self.fmt == "pbf" else (vex, _walk_vex)
        number = TaskContext.get().partitionId()
        name = f"part-{number:05d}-{self.job}-{uuid.uuid4().hex[:8]}.{self.fmt}"
        ids: list[int] = []

        def noted() -> Iterator[tuple]:
            for b in iterator:
                for e in from_batch(self.entity, b):
                    ids.append(e[0])
                    yield e

        blocks, at = [], 0
        with opened.write_to(f"{self.path}/{name}") as out:
            for data in codec.encode(self.entity, noted()):
                (b,) = walk(io.BytesIO(data))
                n = b.count or len(ids)  # an encoder may have read on, to what begins the next block
                blocks.append(Block(at + b.offset, b.size, self.entity, n, min(ids[:n]), max(ids[:n])))
                del ids[:n]
                out.write(data)
                at += len(data)
        if not blocks:
            opened.delete(f"{self.path}/{name}")
            return Part(number, None)
        write_directory(f"{self.path}/{name}", blocks)
        return Part(number, name, sum(b.count for b in blocks), min(b.low for b in blocks), max(b.high for b in blocks))

    def _clean(self, but: set[str]) -> None:
        for n in opened.names(self.path):
            if f"-{self.job}-" in n and n.removesuffix(".blocks") not in but:
                opened.delete(f"{self.path}/{n}")

    def commit(self, messages: list[Part | None]) -> None:
        new = [p for p in sorted((m for m in messages if m is not None), key=lambda m: m.partition) if p.name]
        before = read_parts(self.path) if not self.overwrite and opened.is_file(f"{self.path}/{PARTS}") else []
        listed = before + [{"name": p.name, "count": p.count, "low": p.low, "high": p.high} for p in new]
        opened.replace(f"{self.path}/{PARTS}", json.dumps(listed).encode())
        self._clean({p["name"] for p in listed})

    def abort(self, messages: list[Part | None]) -> None:
        self._clean(set())


class _Source(DataSource):
    fmt, reading = "", _Reader

    def schema(self) -> str:
        entity = self.options.get("entity", "nodes")
        if entity not in SCHEMA_OF:
            raise ValueError(f"entity is nodes, ways or relations, not {entity}")
        return SCHEMA_OF[entity]

    def reader(self, schema):
        return self.reading(self.options)

    def writer(self, schema, overwrite: bool):
        self.schema()
        return _Writer(self.options, overwrite, self.fmt)


class PbfSource(_Source):
    fmt, reading = "pbf", PbfReader

    @classmethod
    def name(cls) -> str:
        return "osmpbf"


class VexSource(_Source):
    fmt, reading = "vex", VexReader

    @classmethod
    def name(cls) -> str:
        return "vex"


def tidy(path: str) -> list[str]:
    """Delete parts of a folder that its list doesn't have, while nobody writes there; their names."""
    listed = {p["name"] for p in read_parts(path)}
    gone = [n for n in opened.names(path) if n.startswith("part-") and n.removesuffix(".blocks") not in listed]
    for n in gone:
        opened.delete(f"{path}/{n}")
    return gone


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PbfSource)
    spark.dataSource.register(VexSource)


def index_file(spark: SparkSession, path: str) -> DataFrame:
    """Make the directory of a file's blocks, which lies beside it from then on: tasks decode blocks, the driver gets a row for each."""
    reading = PbfReader if path.endswith("pbf") else VexReader
    with opened.read_from(path) as f:
        found = reading.walk(f)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            with opened.read_from(path) as f:
                for b in (Block(**r) for r in batch.to_pylist()):
                    f.seek(b.offset)
                    data = f.read(b.size)
                    for kind in KINDS if b.kind is None else (b.kind,):
                        own = [e[0] for e in reading({"path": path, "entity": kind}).decode(b, data)]
                        if own:
                            rows.append({"offset": b.offset, "size": b.size, "kind": kind, "count": b.count or len(own), "low": min(own), "high": max(own)})
            yield pa.RecordBatch.from_pylist(rows, _BLOCKS)

    kinds = "offset long, size long, kind string, count long, low long, high long"
    parts = max(1, sum(b.size for b in found) // PIECE)
    told = spark.createDataFrame([b.__dict__ for b in found], kinds).repartition(parts).mapInArrow(describe, kinds).orderBy("offset", "kind").collect()
    write_directory(path, [Block(**r.asDict()) for r in told])
    return spark.createDataFrame(told, kinds)


def look_up(spark: SparkSession, path: str, entity: str, ids: DataFrame) -> DataFrame:
    """The entities of one kind whose id is in ids (a column id, of any number of rows), from a file with a directory or a folder of parts.

    Tasks look ids up between the least ids of blocks, the fences; the driver gets the numbers of blocks that may hold one, and these are read.
    """
    whole = opened.is_file(path)
    files = [path] if whole else [f"{path}/{p['name']}" for p in read_parts(path)]
    blocks = sorted(((b.low, b.high, f, b.offset) for f in files for b in read_directory(f) if b.kind == entity), key=lambda b: b[0])
    fences, most = np.array([b[0] for b in blocks], np.int64), np.maximum.accumulate(np.array([b[1] for b in blocks], np.int64))
    highs = np.array([b[1] for b in blocks], np.int64)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[int] = set()
        for batch in batches:
            own = np.unique(batch.column(0).to_numpy(zero_copy_only=False))
            last = np.searchsorted(fences, own, "right") - 1
            while (open_ := last >= 0).any():  # blocks may overlap: back, as long as one can reach so far
                own, last = own[open_], last[open_]
                reach = most[last] >= own
                own, last = own[reach], last[reach]
                found.update(last[highs[last] >= own].tolist())
                last = last - 1
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], names=["block"])

    asked = cut(ids.select("id").where("id is not null").distinct())
    numbers = [r["block"] for r in asked.mapInArrow(meet, "block long").distinct().collect()]
    only: dict[str, list[int]] = {}
    for n in sorted(numbers):
        only.setdefault(blocks[n][2], []).append(blocks[n][3])
    register(spark)
    fmt = "osmpbf" if files and files[0].endswith("pbf") else "vex"
    rows = spark.read.format(fmt).option("path", path).option("entity", entity).option("only", json.dumps(only)).load()
    return rows.join(asked, "id", "left_semi")
