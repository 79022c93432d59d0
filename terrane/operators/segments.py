"""A log-structured store: base files by ranges of ids, and segments of changes that are merged when read.

    log/0000000007.json      one version: which base folder each range has, which segments still count, time and sequence number
    base/NAME/KIND/range=R   sorted rows of a range
    segments/NAME/kind=KIND  the last change of each id of one diff, sorted by range: upserts, and deletes as tombstones

A diff is a new segment and a new version, however large the store is. The log entry is written last, so what a lost job leaves counts for
nothing, and a version that is read stays as it is. Compaction rewrites ranges whose changes have grown to a share of their rows, and no others.

Indexes are further kinds, chosen when a store is made, and a diff's segment has their changes too. "index", the tile index, is keyed by way: new rows
come of the ways that a diff changes, and of those whose first node it moves. "counts" (see derived) is keyed by node: old counts are
looked up for the ids that the diff's ways and nodes name, and no others.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tiles import degrees, x_tile, y_tile
from ..model import META, NODES, RELATIONS, WAYS, OsmDataset
from ..sources import folders
from . import derived
from .changes import last_changes

INDEX = "id bigint, node_id bigint, xtile int, ytile int"
SCHEMAS = {"nodes": NODES, "ways": WAYS, "relations": RELATIONS, "index": INDEX, "counts": derived.COUNTS}
INDEXES = {"index": "ways", "counts": "nodes"}  # and the kind whose ranges they have
TYPE_OF = {"nodes": "NODE", "ways": "WAY", "relations": "RELATION"}
RANGES = 64
PIECE = 4 << 20  # bytes of files for each task that writes what comes of them


@dataclass
class Version:
    number: int
    timestamp: int
    sequence: int
    bounds: dict[str, list[int]]  # least ids of the ranges but the first
    base: dict[str, dict[str, str]]  # kind, range: folder under base/
    segments: list[dict] = field(default_factory=list)  # name, place (the version that it came with), ranges: those of its changes by kind
    through: dict[str, dict[str, int]] = field(default_factory=dict)  # kind, range: the place up to which changes are in the base

    @property
    def kinds(self) -> list[str]:
        return list(self.bounds)

    def pending(self, segment: dict, kind: str) -> set[str]:
        """Ranges whose changes in a segment are not in the base yet."""
        passed = self.through.get(kind, {})
        return {r for r in segment["ranges"].get(kind, []) if segment["place"] > passed.get(r, 0)}


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n[:-5]) for n in folders.names(spark, f"{path}/log") if n.endswith(".json")]


def current(spark: SparkSession, path: str, number: int | None = None) -> Version:
    found = versions(spark, path)
    if not found or number is not None and number not in found:
        raise FileNotFoundError(f"{path} holds no dataset" + ("" if number is None else f" of version {number}"))
    return Version(**json.loads(folders.read_text(spark, f"{path}/log/{number or found[-1]:010d}.json")))


def _commit(spark: SparkSession, path: str, v: Version) -> Version:
    folders.write_new(spark, f"{path}/log/{v.number:010d}.json", json.dumps(v.__dict__))
    return v


def range_of(bounds: list[int], id_: Column) -> Column:
    """The range of an id: how many bounds are not over it."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= id_)) if bounds else F.lit(0)


def _parts(spark: SparkSession, paths: list[str] = ()) -> int:
    """In how many partitions rows are written: in proportion to the files that they come from, so that a task's share does not grow."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(folders.size(spark, p) for p in paths) // PIECE))


def _write_base(df: DataFrame, bounds: list[int], to: str) -> dict[str, str]:
    """Ranges by bounds, and where each is. df: partitions are ranges of ids."""
    df.withColumn("range", range_of(bounds, F.col("id"))).sortWithinPartitions("range", "id").write.partitionBy("range").parquet(to)
    return {r: f"{to}/range={r}" for r in _ranges_in(df.sparkSession, to)}


def _write_first(df: DataFrame, ranges: int, to: str, parts: int) -> tuple[list[int], dict[str, str]]:
    """Ranges of about one size as the shuffle finds them, in one pass over df: bounds, and where each range is."""
    each = -(-parts // ranges)
    placed = df.repartitionByRange(ranges * each, "id").withColumn("range", F.floor(F.spark_partition_id() / each).cast("int"))
    placed.sortWithinPartitions("range", "id").write.partitionBy("range").parquet(to)
    found = sorted(_ranges_in(df.sparkSession, to), key=int)
    if not found:
        return [], {}
    least = dict(df.sparkSession.read.schema("id bigint, range int").parquet(to).groupBy("range").agg(F.min("id")).collect())  # a row for each range
    return [least[int(r)] for r in found[1:]], {str(k): f"{to}/range={r}" for k, r in enumerate(found)}


def _ranges_in(spark: SparkSession, folder: str) -> list[str]:
    return [n.removeprefix("range=") for n in folders.names(spark, folder) if n.startswith("range=")]


def first_node_rows(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Index rows of ways that have nodes; the tile is null where the first node is missing."""
    first = ways.select("id", F.get("nodes", F.lit(0)).alias("node_id")).where("node_id is not null")
    return _with_tiles(first, nodes)


def _with_tiles(first: DataFrame, nodes: DataFrame) -> DataFrame:
    at = nodes.select(F.col("id").alias("node_id"), x_tile(degrees(F.col("fixed_lon"))).alias("xtile"), y_tile(degrees(F.col("fixed_lat"))).alias("ytile"))
    return first.join(at, "node_id", "left").select("id", "node_id", "xtile", "ytile")


def create(ds: OsmDataset, path: str, ranges: int = RANGES, indexes: tuple[str, ...] = ("index",), parts: int | None = None) -> Version:
    """A new store with the indexes named: "index", "counts", both or none. A path that holds data already is refused. parts: how many tasks write a kind."""
    if set(indexes) - set(INDEXES):
        raise ValueError(f"indexes are {', '.join(INDEXES)}")
    spark = ds.spark
    if versions(spark, path):
        raise FileExistsError(f"{path} holds a dataset already")
    name, bounds, base = uuid.uuid4().hex, {}, {}
    for kind in (*TYPE_OF, *indexes):
        to = f"{path}/base/{name}/{kind}"
        if kind in INDEXES:
            bounds[kind] = bounds[INDEXES[kind]]
            files = {k: [f"{path}/base/{at}" for at in base[k].values()] for k in ("ways", "nodes")}
            stored, n = (_read(spark, SCHEMAS[k], files[k]) for k in files), _parts(spark, [at for f in files.values() for at in f])
            placed = first_node_rows(*stored).repartitionByRange(n, "id") if kind == "index" else derived.counts(*stored, parts=n)
            found = _write_base(placed, bounds[kind], to)
        else:
            bounds[kind], found = _write_first(getattr(ds, kind), ranges, to, parts or _parts(spark))
        base[kind] = {r: at.removeprefix(f"{path}/base/") for r, at in found.items()}
    meta = ds.meta.first()
    return _commit(spark, path, Version(1, (meta and meta[0]) or 0, (meta and meta[1]) or 0, bounds, base))


def _read(spark: SparkSession, schema: str, paths: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _last(spark: SparkSession, path: str, v: Version, kind: str, ranges: set[str] | None = None) -> tuple[DataFrame, set[str]]:
    """The last change of each id in segments that count, and the ranges that have any."""
    schema = f"{SCHEMAS[kind]}, op string, place bigint, seq bigint, ord bigint, range int"
    of = {s["name"]: own for s in v.segments if (own := v.pending(s, kind) & (ranges if ranges is not None else v.pending(s, kind)))}
    touched = set().union(*of.values())
    rows = _read(spark, schema, [f"{path}/segments/{n}/kind={kind}" for n in of])
    passed = v.through.get(kind, {})
    if passed:
        known = F.create_map(*(F.lit(x) for r, place in passed.items() for x in (int(r), place)))
        rows = rows.where(F.col("place") > F.coalesce(known[F.col("range")], F.lit(0)))
    if ranges is not None:
        rows = rows.where(F.col("range").isin([int(r) for r in ranges]))
    columns = [c for c in rows.columns if c not in ("place", "seq", "ord", "id", "range")]
    if len(of) < 2:
        return rows.select("id", *columns), touched  # a segment has one change of an id
    last = rows.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("place", "seq", "ord")).alias("x")).select("id", "x.*")
    return last, touched


def _merged(base: DataFrame, last: DataFrame) -> DataFrame:
    return base.join(last.select("id"), "id", "left_anti").select(*base.columns).unionByName(last.where("op = 'upsert'").select(*base.columns))


def table(spark: SparkSession, path: str, kind: str, v: Version, ranges: set[str] | None = None) -> DataFrame:
    """The rows of a kind, of some ranges or all. Ranges without changes are read as they are."""
    last, touched = _last(spark, path, v, kind, ranges)
    own = {r: f"{path}/base/{at}" for r, at in v.base[kind].items() if ranges is None or r in ranges}
    still = _read(spark, SCHEMAS[kind], [at for r, at in own.items() if r not in touched])
    if not touched:
        return still
    return still.unionByName(_merged(_read(spark, SCHEMAS[kind], [at for r, at in own.items() if r in touched]), last))


def load(spark: SparkSession, path: str, number: int | None = None) -> OsmDataset:
    v = current(spark, path, number)
    meta = spark.createDataFrame([(v.timestamp, v.sequence)], META)
    return OsmDataset(*(table(spark, path, k, v) for k in ("nodes", "ways", "relations")), meta)


def _indexed(spark: SparkSession, path: str, kind: str, number: int | None) -> DataFrame:
    v = current(spark, path, number)
    if kind not in v.kinds:
        raise LookupError(f"{path} has no index {kind!r}")
    return table(spark, path, kind, v)


def load_counts(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """id, refs, all_refs, present: to be filtered by derived.referenced(), intersection(), dangling() or unused()."""
    return _indexed(spark, path, "counts", number)


def load_index(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    return _indexed(spark, path, "index", number).where("xtile is not null").select("xtile", "ytile", F.col("id").alias("way_id"))


def look_up(spark: SparkSession, path: str, kind: str, ids: DataFrame, v: Version | None = None, ranges: set[str] | None = None) -> DataFrame:
    """The rows of a kind whose id is in ids (a column id, of any number of rows). Only the ranges that ids fall in, which may be given, are read."""
    v = v or current(spark, path)
    asked = ids.select("id").where("id is not null").distinct()
    if ranges is None:
        ranges = {str(r[0]) for r in asked.select(range_of(v.bounds[kind], F.col("id"))).distinct().collect()}  # as many as there are ranges, at most
    return table(spark, path, kind, v, ranges).join(asked, "id", "left_semi")


def append(spark: SparkSession, path: str, changes: DataFrame, timestamp: int | None = None, sequence: int | None = None) -> Version:
    """One diff as a segment. A sequence number that the store has passed already is not applied again."""
    v = current(spark, path)
    if sequence is not None and v.sequence and sequence <= v.sequence:
        return v
    name = uuid.uuid4().hex
    at, place = f"{path}/segments/{name}", v.number + 1
    last = last_changes(changes)
    range_column = F.lit(None)
    for kind, type_ in TYPE_OF.items():
        range_column = F.when(F.col("type") == type_, range_of(v.bounds[kind], F.col("id"))).otherwise(range_column)
    kinds = F.create_map(*(F.lit(x) for kind, type_ in TYPE_OF.items() for x in (type_, kind)))
    rows = last.withColumns({"kind": kinds[F.col("type")], "range": range_column, "place": F.lit(place).cast("long")}).where("kind is not null").drop("type")
    rows.hint("rebalance", "kind", "range").sortWithinPartitions("kind", "range", "id").write.partitionBy("kind").parquet(at)
    segment = {"name": name, "place": place, "ranges": {}}
    _note_ranges(spark, at, segment)
    own = Version(place, v.timestamp if timestamp is None else timestamp, v.sequence if sequence is None else sequence, v.bounds, v.base, [*v.segments, segment], v.through)
    if {"nodes", "ways"} & set(segment["ranges"]):
        for kind in INDEXES:
            if kind in v.kinds and (rows := (_index_changes if kind == "index" else _count_changes)(spark, path, v, own)) is not None:
                zero = F.lit(0).cast("long")
                rows = rows.withColumns({"place": F.lit(place).cast("long"), "seq": zero, "ord": zero, "range": range_of(v.bounds[kind], F.col("id"))})
                rows.hint("rebalance", "range").sortWithinPartitions("range", "id").write.parquet(f"{at}/kind={kind}")
        _note_ranges(spark, at, segment)
    return _commit(spark, path, own)


def _note_ranges(spark: SparkSession, at: str, segment: dict) -> None:
    for kind in SCHEMAS:
        if kind not in segment["ranges"] and f"kind={kind}" in folders.names(spark, at):
            found = spark.read.schema("range int").parquet(f"{at}/kind={kind}").distinct().collect()  # as many as there are ranges, at most
            if found:
                segment["ranges"][kind] = sorted(str(r[0]) for r in found)


def _own(spark: SparkSession, path: str, after: Version, kind: str) -> DataFrame:
    """The changes of the latest segment alone."""
    only = Version(after.number, 0, 0, after.bounds, after.base, after.segments[-1:])
    return _last(spark, path, only, kind)[0]


def _index_changes(spark: SparkSession, path: str, before: Version, after: Version) -> DataFrame | None:
    """Rows of the tile index that the latest segment makes other ones."""
    if "ways" not in after.segments[-1]["ranges"] and not before.base["index"] and not any("index" in s["ranges"] for s in before.segments):
        return None  # no way that a node could move
    ways, nodes = _own(spark, path, after, "ways"), _own(spark, path, after, "nodes")
    set_ways = ways.where("op = 'upsert'").select("id", F.get("nodes", F.lit(0)).alias("node_id"))
    old = table(spark, path, "index", before).select("id", "node_id")
    beside = old.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi").join(ways.select("id"), "id", "left_anti").select("id", "node_id")
    first = set_ways.where("node_id is not null").unionByName(beside)
    here = look_up(spark, path, "nodes", first.select(F.col("node_id").alias("id")), after)
    gone = ways.where("op = 'delete'").select("id").unionByName(set_ways.where("node_id is null").select("id"))
    put = _with_tiles(first, here).withColumn("op", F.lit("upsert"))
    return put.unionByName(gone.withColumn("op", F.lit("delete")), allowMissingColumns=True)


def _count_changes(spark: SparkSession, path: str, before: Version, after: Version) -> DataFrame:
    """New counts of the nodes that the latest segment's ways and nodes, and what they replace, name."""
    ways, nodes = _own(spark, path, after, "ways"), _own(spark, path, after, "nodes")
    put = lambda df: df.where("op = 'upsert'")
    known = after.segments[-1]["ranges"]
    old = lambda kind, own: look_up(spark, path, kind, own, before, set(known.get(kind, ())))
    deltas = derived.count_deltas(old("ways", ways), put(ways), old("nodes", nodes), put(nodes))
    at = f"{path}/segments/{after.segments[-1]['name']}/deltas"
    deltas.write.parquet(at)  # small, and read three times
    deltas = spark.read.schema(derived.COUNTS).parquet(at)
    return derived.advance(look_up(spark, path, "counts", deltas, before), deltas).withColumn("op", F.when(derived.counted(), "upsert").otherwise("delete"))


def compact(spark: SparkSession, path: str, share: float = 0.1) -> Version:
    """Rewrite the ranges whose pending changes number at least `share` of their rows; 0 rewrites all ranges with changes."""
    v = current(spark, path)
    name, base, done = uuid.uuid4().hex, {k: dict(b) for k, b in v.base.items()}, {}
    for kind in v.kinds:
        last, touched = _last(spark, path, v, kind)
        if not touched:
            continue
        count = lambda df: {str(r[0]): r[1] for r in df.groupBy(range_of(v.bounds[kind], F.col("id"))).count().collect()}  # noqa: E731, B023  one row a range
        changed = count(last)
        files = {r: f"{path}/base/{at}" for r, at in v.base[kind].items() if r in touched}
        rows = count(_read(spark, SCHEMAS[kind], list(files.values())))
        over = {r for r in touched if changed.get(r, 0) >= share * rows.get(r, 0)}
        if not over:
            continue
        done[kind] = over
        to = f"{path}/base/{name}/{kind}"
        parts = _parts(spark, [at for r, at in files.items() if r in over])
        written = _write_base(table(spark, path, kind, v, done[kind]).repartitionByRange(parts, "id"), v.bounds[kind], to)
        for r in done[kind]:
            base[kind].pop(r, None)
            if r in written:
                base[kind][r] = written[r].removeprefix(f"{path}/base/")
    if not any(done.values()):
        return v
    through = {k: {**v.through.get(k, {}), **dict.fromkeys(done.get(k, ()), v.number)} for k in v.kinds}
    own = Version(v.number + 1, v.timestamp, v.sequence, v.bounds, base, v.segments, through)
    own.segments = [s for s in v.segments if any(own.pending(s, k) for k in v.kinds)]
    return _commit(spark, path, own)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Forget all but the latest versions, and delete what no remaining one names. Readers of older versions must have ended."""
    found = versions(spark, path)
    kept = [current(spark, path, n) for n in found[-keep:]]
    for n in found[:-keep]:
        folders.delete(spark, f"{path}/log/{n:010d}.json")
    segments = {s["name"] for v in kept for s in v.segments}
    ranges = {at for v in kept for b in v.base.values() for at in b.values()}
    for n in folders.names(spark, f"{path}/segments"):
        if n not in segments:
            folders.delete(spark, f"{path}/segments/{n}")
    for n in folders.names(spark, f"{path}/base"):
        for kind in folders.names(spark, f"{path}/base/{n}"):
            for r in _ranges_in(spark, f"{path}/base/{n}/{kind}"):
                if f"{n}/{kind}/range={r}" not in ranges:
                    folders.delete(spark, f"{path}/base/{n}/{kind}/range={r}")
