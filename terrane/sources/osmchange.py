"""osmChange documents and replication state files."""

from __future__ import annotations

import gzip
import io
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import TYPES
from ..operators.changes import CHANGES
from . import folders, opened
from .rows import SCHEMAS

_schema = pa.schema([("seq", pa.int64()), ("ord", pa.int64()), ("op", pa.string()), ("type", pa.string()), ("id", pa.int64()), ("fixed_lat", pa.int32()), ("fixed_lon", pa.int32()), ("nodes", pa.list_(pa.int64())), ("members", SCHEMAS["relations"].field("members").type), ("tags", SCHEMAS["ways"].field("tags").type)])
# An entity under one of these is put; under delete it is removed.
PUTS = ("create", "add", "modify")


def _fixed(degrees: str | None) -> int | None:
    return None if degrees is None else int(float(degrees) * 1e7)


def parse(data: bytes, seq: int = 0, op: str | None = "upsert", said: list | None = None) -> Iterator[dict]:
    """Changes in document order; names in any case. Entities without an id are left out; deletes need no coordinates.

    op holds until the first block opens, None if it isn't known; said, if given, gets each op that a block opens."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    ord_, entity = 0, None
    for event, e in ET.iterparse(io.BytesIO(data), events=("start", "end")):
        name = e.tag.lower()
        if event == "start":
            if name == "delete" or name in PUTS:
                op = "delete" if name == "delete" else "upsert"
                if said is not None:
                    said.append(op)
            elif name.upper() in TYPES:
                entity = {"seq": seq, "ord": ord_, "op": op, "type": name.upper(), "id": int(e.get("id", -1)), "fixed_lat": _fixed(e.get("lat")), "fixed_lon": _fixed(e.get("lon")), "nodes": [], "members": [], "tags": []}
            elif entity is not None and name == "tag":
                entity["tags"].append({"key": e.get("k"), "value": e.get("v") or ""})
            elif entity is not None and name == "nd":
                entity["nodes"].append(int(e.get("ref")))
            elif entity is not None and name == "member":
                entity["members"].append({"type": e.get("type", "").upper(), "id": int(e.get("ref")), "role": e.get("role") or ""})
        elif name.upper() in TYPES and entity is not None:
            if entity["id"] >= 0:
                if op == "upsert" and entity["type"] == "NODE" and (entity["fixed_lat"] is None or entity["fixed_lon"] is None):
                    raise ValueError(f"node {entity['id']} has no coordinates")
                yield entity
                ord_ += 1
            entity = None
            e.clear()


def sequence_of(path: str) -> int:
    """Of a diff's path, .../004/212/345.osc.gz; a plain number is taken too."""
    m = re.search(r"(\d{3})/(\d{3})/(\d{3})\.[^/]*$", path)
    if m:
        return int("".join(m.groups()))
    m = re.search(r"(\d+)\.[^/]*$", path)
    return int(m[1]) if m else 0


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1)):
            rows = []
            for change in parse(content.as_py(), sequence_of(path)):
                rows.append(change)
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_pylist(rows, _schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, _schema)


def changes_of(files: DataFrame) -> DataFrame:
    """files: path and content, as the binaryFile source gives them."""
    return files.select("path", "content").mapInArrow(_read, CHANGES)


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return changes_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.osc*").load(path))


def parse_state(text: str) -> tuple[int, int]:
    """Epoch seconds and sequence number of a state file: k=v lines, # opens a comment, \\: stands for a colon."""
    got = {}
    for line in text.splitlines():
        parts = line.split("=")
        if not line.startswith("#") and len(parts) == 2:
            got[parts[0].strip()] = parts[1].strip()
    when = datetime.fromisoformat(got["timestamp"].replace("\\:", ":").replace("Z", "+00:00"))
    return int(when.astimezone(timezone.utc).timestamp()), int(got["sequenceNumber"])


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """path, seq, timestamp of every state file under a folder."""
    from ..functions.text import state_epoch

    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*state.txt").text(path).select(F.col("_metadata.file_path").alias("path"), F.split("value", "=").alias("kv"), "value")
    pairs = lines.where(~F.startswith("value", F.lit("#")) & (F.size("kv") == 2)).select("path", F.trim(F.col("kv")[0]).alias("k"), F.trim(F.col("kv")[1]).alias("v"))
    wide = pairs.groupBy("path").agg(F.max(F.when(F.col("k") == "sequenceNumber", F.col("v"))).cast("long").alias("seq"), F.max(F.when(F.col("k") == "timestamp", F.col("v"))).alias("t"))
    return wide.select("path", "seq", state_epoch(F.col("t")).alias("timestamp"))


# ---- one large document, in pieces ----

PIECE = 16 << 20
_BORDER = re.compile(rb"<(?:node|way|relation)\b", re.IGNORECASE)
_BLOCK = re.compile(rb"<(create|add|modify|delete)\b[^>]*>", re.IGNORECASE)
_ELSE = re.compile(rb"</(?:create|add|modify|delete|osmchange)\s*>|<osmchange\b[^>]*>|<\?[^>]*\?>|<!--.*?-->", re.IGNORECASE | re.DOTALL)


def _border(f, at: int, end: int, comment: bool) -> int:
    """The first start of an entity from `at` on, or end. comment: `at` may lie within a comment, which is then passed over."""
    seen, base = b"", at
    f.seek(at)
    while True:
        more = f.read(min(1 << 16, max(0, end - base - len(seen))))
        if not more:
            return end
        seen += more
        if comment:
            opens, closes = seen.find(b"<!--"), seen.find(b"-->")
            if closes >= 0 and not 0 <= opens < closes and b"<" not in seen[:closes]:
                seen, base, comment = seen[closes + 3 :], base + closes + 3, False
        found = _BORDER.search(seen)
        if found and len(seen) - found.start() > 16:
            return base + found.start()
        if found and base + len(seen) >= end:
            return base + found.start()
        if not found and len(seen) > 1 << 20:  # a long entity goes on: keep what could be a tag's beginning
            seen, base = seen[-16:], base + len(seen) - 16


def piece(path: str, number: int, size: int, length: int) -> tuple[list[dict], str | None]:
    """The changes of the entities that start in one piece of a document, and the op of the last block that opens there. op is None before the first one."""
    start, end = number * size, min(length, (number + 1) * size)
    with opened.read_from(path) as f:
        first = _border(f, start, length, True) if number else 0
        last = length if end == length else _border(f, end, length, True)
        if first >= end or first >= last:
            return [], None
        f.seek(first)
        body = f.read(last - first)
    said: list = []
    body = _BLOCK.sub(rb"<\1/>", _ELSE.sub(b"", body))
    rows = list(parse(b"<piece>" + body + b"</piece>", 0, None if number else "upsert", said))
    return rows, said[-1] if said else None


def read_large(spark: SparkSession, path: str, seq: int | None = None, size: int = PIECE) -> DataFrame:
    """The changes of one document that isn't compressed, parsed by as many tasks as it has pieces.

    A piece has the entities that start in it. Which block they are in, add, modify or delete, is known from the first block that opens there; what
    comes before is in the last block that an earlier piece opened. The driver gets a row for each piece to tell. As in any XML, < must not stand within
    attributes; a comment must not hold markup of entities.
    """
    seq = sequence_of(path) if seq is None else seq
    with opened.read_from(path) as f:
        length = f.size()
    pieces = max(1, -(-length // size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in b.column(0).to_pylist():
                rows, last = piece(path, n, size, length)
                marks = {"seq": n, "ord": len(rows), "op": last, "type": None, "id": None}
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist([r | {"seq": n} for r in rows[at : at + 10_000]], _schema)
                yield pa.RecordBatch.from_pylist([marks], _schema)

    at = folders.shared(spark, "pieces")
    spark.range(0, pieces, 1, pieces).mapInArrow(run, CHANGES).write.parquet(at)  # parsed once
    rows = spark.read.schema(CHANGES).parquet(at)
    op, before, told = "upsert", 0, []
    for m in rows.where("type is null").select("seq", "ord", "op").orderBy("seq").collect():  # one row a piece
        told.append((m["seq"], op, before))
        op, before = m["op"] or op, before + m["ord"]
    opens = F.broadcast(spark.createDataFrame(told, "seq bigint, _op string, _before bigint"))
    mended = rows.where("type is not null").join(opens, "seq").withColumns({"op": F.coalesce("op", "_op"), "ord": F.col("ord") + F.col("_before"), "seq": F.lit(seq).cast("long")})
    bare = (F.col("op") == "upsert") & (F.col("type") == "NODE") & (F.col("fixed_lat").isNull() | F.col("fixed_lon").isNull())
    return mended.withColumn("id", F.when(bare, F.raise_error(F.concat(F.lit("no coordinates: node "), F.col("id").cast("string"))).cast("long")).otherwise(F.col("id"))).drop("_op", "_before")
