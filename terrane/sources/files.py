"""Files by suffix: .pbf and .vex are read and written, .txt is written."""

from __future__ import annotations

import io
import json
import os
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions import text
from ..model import META, OsmDataset
from . import folders, opened, pbf, vex
from .formats import KINDS, PARTS, read_parts, register
from .rows import from_batch

BEGIN, END = "--- BEGINNING OF OSM TEXT OUTPUT ---", "--- END OF OSM TEXT OUTPUT ---"  # fixed values


def suffix(path: str, known: tuple[str, ...]) -> str:
    for s in known:
        if path.endswith("." + s):
            return s
    raise ValueError(f"{path}: the suffix is none of {', '.join(known)}")


def load_osm(spark: SparkSession, path: str, *, keys: list[str] | None = None, limits: bool = True) -> OsmDataset:
    """A file, a folder of parts, or a URL whose content is fetched first."""
    if urllib.parse.urlparse(path).scheme in ("http", "https", "ftp"):
        path = _fetch(spark, path)
    if not opened.is_there(path):
        suffix(path, ("pbf", "vex"))
        raise FileNotFoundError(path)
    register(spark)
    whole = opened.is_file(path)
    when = sequence = 0
    if whole:
        fmt = suffix(path, ("pbf", "vex"))
        if fmt == "pbf":
            with opened.read_from(path) as f:
                for kind, at, n in pbf.frames(f):
                    if kind == "OSMHeader":
                        f.seek(at)
                        when, sequence = pbf.read_header(pbf.inflate(f.read(n)))
                    break
    else:
        with opened.read_from(f"{path}/{PARTS}") as f:
            told = json.loads(f.read())
        fmt, when, sequence = told["format"], told["timestamp"], told["sequence"]

    def one(kind: str) -> DataFrame:
        r = spark.read.format(FORMATS[fmt]).option("path", path if whole else f"{path}/{kind}").option("entity", kind).option("limits", str(limits).lower())
        return (r.option("keys", ",".join(keys)) if keys else r).load()

    return OsmDataset(*(one(k) for k in KINDS), spark.createDataFrame([(when, sequence)], META))


FORMATS = {"pbf": "osmpbf", "vex": "vex"}


def save_parts(ds: OsmDataset, path: str, fmt: str, parts: int | None = None) -> None:
    """A folder of parts, written by the tasks that hold them: ranges of ids in order. It counts as a dataset once its list is there, which comes last."""
    register(ds.spark)
    n = parts or int(ds.spark.conf.get("spark.sql.shuffle.partitions"))
    if opened.is_there(f"{path}/{PARTS}"):
        raise FileExistsError(f"{path} holds a dataset already")
    meta = ds.meta.first()
    when, sequence = ((meta and meta[i]) or 0 for i in (0, 1))
    if fmt == "txt":
        for kind, line in (("nodes", text.node_line()), ("ways", text.way_line()), ("relations", text.relation_line())):
            _in_ranges(getattr(ds, kind), n).select(line.alias("value")).write.text(f"{path}/{kind}")
    else:
        for kind in KINDS:
            _in_ranges(getattr(ds, kind), n).write.format(FORMATS[fmt]).option("path", f"{path}/{kind}").option("entity", kind).mode("overwrite").save()
    opened.replace(f"{path}/{PARTS}", json.dumps({"format": fmt, "timestamp": when, "sequence": sequence}).encode())


def _in_ranges(df: DataFrame, n: int) -> DataFrame:
    return df.repartitionByRange(n, "id").sortWithinPartitions("id")


def join_parts(path: str, target: str) -> None:
    """One file from a folder of parts: encoded blocks, one after another, are a file of either format. Bytes are copied, not rows."""
    with opened.read_from(f"{path}/{PARTS}") as f:
        told = json.loads(f.read())
    if told["format"] == "txt":
        raise ValueError("a folder of text is plain lines: concatenate it with the tools for these")
    with opened.write_to(target) as out:
        if told["format"] == "pbf":
            out.write(pbf.header(told["timestamp"], told["sequence"]))
        for kind in KINDS:
            for p in read_parts(f"{path}/{kind}"):
                with opened.read_from(f"{path}/{kind}/{p['name']}") as f:
                    while chunk := f.read(1 << 20):
                        out.write(chunk)


def _fetch(spark: SparkSession, url: str) -> str:
    name = os.path.basename(urllib.parse.urlparse(url).path)
    suffix(name, ("pbf", "vex"))
    path = f"{folders.shared(spark, 'fetched')}/{name}"
    with urllib.request.urlopen(url) as src, opened.write_to(path) as out:  # noqa: S310
        while chunk := src.read(1 << 20):
            out.write(chunk)
    return path


def _encoder(kind: str, fmt: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entities = (e for b in batches for e in from_batch(kind, b))
        for block in (pbf if fmt == "pbf" else vex).encode(kind, entities):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["block"])

    return run


def encoded(ds: OsmDataset, kind: str, fmt: str) -> DataFrame:
    """Blocks of one kind in the order of ids; partitions are ranges of ids, and encoded where they are."""
    return getattr(ds, kind).orderBy("id").mapInArrow(_encoder(kind, fmt), "block binary")


def write_to(ds: OsmDataset, fmt: str, out) -> None:
    """Blocks come from the executors encoded, one partition at a time."""
    if fmt == "txt":
        out.write((BEGIN + "\n").encode())
        for df, line in ((ds.nodes, text.node_line()), (ds.ways, text.way_line()), (ds.relations, text.relation_line())):
            for row in df.orderBy("id").select(line.alias("line")).toLocalIterator():
                out.write((row["line"] + "\n").encode())
        out.write(END.encode())
        return
    if fmt == "pbf":
        meta = ds.meta.first()
        out.write(pbf.header(meta["replication_timestamp"] or 0, meta["sequence_number"] or 0) if meta else pbf.header())
    for kind in KINDS:
        for row in encoded(ds, kind, fmt).toLocalIterator():
            out.write(bytes(row["block"]))


def save_osm(ds: OsmDataset, path: str) -> None:
    fmt = suffix(path, ("pbf", "vex", "txt"))
    with open(path, "wb") as out:
        write_to(ds, fmt, out)


def encode_bytes(ds: OsmDataset, fmt: str) -> bytes:
    out = io.BytesIO()
    write_to(ds, suffix("." + fmt, ("pbf", "vex", "txt")), out)
    return out.getvalue()


def decode_bytes(spark: SparkSession, fmt: str, data: bytes) -> OsmDataset:
    path = f"{folders.shared(spark, 'stream')}/stream." + suffix("." + fmt, ("pbf", "vex"))
    with opened.write_to(path) as f:
        f.write(data)
    return load_osm(spark, path)


def convert(spark: SparkSession, source: str, target: str) -> None:
    """By suffixes; the replication timestamp goes along where the formats carry one."""
    suffix(target, ("pbf", "vex", "txt"))
    save_osm(load_osm(spark, source), target)
