"""MinHash near-dedup with odd sketches: documents whose word shingles overlap in `similar` percent or more are linked
(SIMILAR unless the caller names another share).

Every text is read once for its signature: MINIMA MinHash values in bands of ROWS, and an odd sketch, a bitmap in which each
value flips one bit. The bits that differ between two sketches say how many values differ, so that a pair's similarity
is known closely where it is high. Texts with the same set of shingles are one class from here on, and the classes' members
come back at the end: copies are never paired.

Classes that share a band are candidates. Pairs are not listed: in each band two classes, the centres, are held against the
others; pairs whose lengths or sketches rule a link out (SLACK standard deviations below the limit) leave;
the rest are confirmed on the full sets, streamed by centre in chunks. Linked classes are one component from then on.
Where a band still holds more than one component after ROUNDS rounds, classes that such bands connect are a cluster if they fit
in one chunk. Larger clusters, which may be chains of texts that share bands by chance, fall apart into their bands again; each
is cut into chunks. A task holds a cluster or two chunks of a band and compares what is in different components, sketches
first, then full sets. So no candidate goes untried, no pair becomes a row, and texts move in proportion to the bands. A pair at the limit shares no band with a probability of (1 - 0.85**4)**24, 2e-8; 3e-6 at 0.8.

Defined results: null and empty texts have no shingles and are linked with nothing; a row with a null doc_id is linked
with nothing, is its own component (null) and is kept; rows with one doc_id and one text are one document, and with
different texts different documents; an empty table gives an empty result. keep_one judges each of them by its own
group. Extra columns are ignored by components_of and kept by keep_one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import drop, stash

WORDS, SIMILAR = 5, 85
BANDS, ROWS = 24, 4
MINIMA = BANDS * ROWS
SKETCH = 8  # 64-bit words of an odd sketch
SLACK = 6.32
CHUNK = 256  # classes that one task holds against a centre at a time
HELD = 4_000_000  # shingles of a chunk, about
ROUNDS = 1

_rng = np.random.default_rng(8)
_times, _plus = (_rng.integers(1, 1 << 62, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_place = _rng.integers(1, 1 << 62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _least_likely(similar: int) -> float:
    """The similarity that a sketch must show: SLACK standard deviations of MINIMA draws under the limit."""
    limit = similar / 100
    return limit - SLACK * math.sqrt(limit * (1 - limit) / MINIMA)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles. bytes.lower() and bytes.split() touch A-Z and the six ASCII spaces alone."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < WORDS:
        return _mix((_mix(h) * _place[:n]).sum(keepdims=True) + np.uint64(n))
    total = h[: n - WORDS + 1] * _place[0]
    for i in range(1, WORDS):
        total = total + _mix(h[i : n - WORDS + 1 + i]) * _place[i]
    return np.unique(_mix(total))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n", "s1", "s2", "bands", "sketch", "t1", "t2"]

    def out(ids: list, texts: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets])
        some = np.flatnonzero(sizes)
        bands, sketch = np.zeros((len(sets), BANDS), np.int64), np.zeros((len(sets), SKETCH), np.uint64)
        if len(some):
            joined = np.concatenate([sets[i] for i in some])
            starts = np.r_[0, np.cumsum(sizes[some])[:-1]]
            least = np.empty((len(some), MINIMA), np.uint64)
            for j in range(MINIMA):
                x = joined * _times[j] + _plus[j]
                least[:, j] = np.minimum.reduceat(x ^ (x >> np.uint64(31)), starts)
            key = np.zeros((len(some), BANDS), np.uint64)
            for r in range(ROWS):
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + least[:, r::ROWS])
            bands[some] = key.view(np.int64)
            bit = _mix(least + np.arange(MINIMA, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(64 * SKETCH)
            flat = np.zeros((len(some), 64 * SKETCH), np.uint8)
            np.add.at(flat, (np.arange(len(some))[:, None], bit.astype(np.int64)), 1)
            sketch[some] = np.packbits(flat & 1, axis=1).view(np.uint64)
        marks = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]
        lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(a.view(np.int64).ravel()))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array([int(m[0]) for m in marks], pa.int64()), pa.array([int(m[1]) for m in marks], pa.int64()), lists(bands), lists(sketch), *(pa.array([t[k] for t in texts], pa.int64()) for k in (0, 1))], names=names)

    for batch in batches:
        ids, texts, sets, size = [], [], [], 0
        for i, text, *marks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            ids.append(i)
            texts.append(marks)
            sets.append(shingles(text.as_py()))
            size += len(sets[-1])
            if size > 200_000:
                yield out(ids, texts, sets)
                ids, texts, sets, size = [], [], [], 0
        if ids:
            yield out(ids, texts, sets)


def _confirm(similar: int):
    """Rows come by centre and chunk, the centre first; columns a, chunk, role, b, s1, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centre = None, None
        for batch in batches:
            us, vs = [], []
            for a, chunk, role, b, s1, text in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if role == 0 and now == (a, chunk) and centre is not None:
                    continue
                own = shingles(text)
                if int(np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)[0]) != s1:
                    continue  # another text of the same doc_id
                if role == 0:
                    now, centre = (a, chunk), own
                    continue
                if now != (a, chunk) or centre is None:
                    continue
                common = len(np.intersect1d(centre, own, assume_unique=True))
                if 100 * common >= similar * (len(centre) + len(own) - common):
                    us.append(a)
                    vs.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _search(similar: int):
    """Rows come by cluster and pair of chunks: all classes of different components are held against each other in memory."""
    least = _least_likely(similar)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: list[tuple], lo: int, hi: int) -> tuple[list[int], list[int]]:
            kept = []
            for chunk, id_, component, s1, sketch, text in rows:
                own = shingles(text)
                if int(np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)[0]) == s1:
                    kept.append((chunk, id_, component, np.array(sketch, np.int64).view(np.uint64), own))
            us, vs = [], []
            if len(kept) < 2:
                return us, vs
            chunks, part = np.array([k[0] for k in kept]), np.array([k[2] for k in kept])
            sketches, sizes = np.array([k[3] for k in kept]), np.array([len(k[4]) for k in kept])
            for i in range(len(kept) - 1):
                rest = slice(i + 1, None)
                differ = np.bitwise_count(sketches[rest] ^ sketches[i]).sum(axis=1)
                likely = 1 + 64 * SKETCH / 4 / MINIMA * np.log(np.maximum(1 - 2 * differ / (64 * SKETCH), 1e-9))
                fits = (100 * np.minimum(sizes[rest], sizes[i]) >= similar * np.maximum(sizes[rest], sizes[i])) & (likely >= least)
                if lo != hi:
                    fits &= chunks[rest] != chunks[i]
                for j in np.flatnonzero(fits) + i + 1:
                    if part[j] == part[i]:
                        continue
                    common = len(np.intersect1d(kept[i][4], kept[j][4], assume_unique=True))
                    if 100 * common >= similar * (sizes[i] + sizes[j] - common):
                        us.append(kept[i][1])
                        vs.append(kept[j][1])
                        part[part == part[j]] = part[i]
            return us, vs

        now, rows = None, []
        for batch in batches:
            us, vs = [], []
            for cluster, lo, hi, chunk, id_, component, s1, sketch, text in zip(*(batch.column(i).to_pylist() for i in range(9))):
                if (cluster, lo, hi) != now:
                    if rows:
                        u, v = links(rows, *now[1:])
                        us, vs = us + u, vs + v
                    now, rows = (cluster, lo, hi), []
                rows.append((chunk, id_, component, s1, sketch, text))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
        if rows:
            u, v = links(rows, *now[1:])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _groups(open_: DataFrame, near: DataFrame) -> DataFrame:
    """Who is compared with whom, one row for each class and place: cluster, lo, hi (a pair of chunks), chunk, id, component, sketch.

    open_ has bands (band, value) with id and component. A text goes to one place if its cluster fits in a chunk, else to
    as many as its bands have chunks; of bands with the same classes one is enough.
    """
    least = open_.groupBy("band", "value").agg(F.min("id").alias("v"))
    found = components(open_.join(least, ["band", "value"]).where("id <> v").select(F.col("id").alias("u"), "v"))
    known = open_.join(found.withColumnRenamed("u", "id"), "id", "left").withColumn("cluster", F.coalesce("v", "id")).drop("v").join(near.select("id", "n"), "id")
    known = stash(known, "near-clusters")
    size = [F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("n") / HELD)).alias("chunks"), F.min("component").alias("p"), F.max("component").alias("q")]
    members = known.select("cluster", "id", "component", "n").distinct()
    sizes = stash(members.groupBy("cluster").agg(*size).where("p < q").select("cluster", "chunks"), "near-sizes")
    whole = members.join(sizes.where("chunks = 1"), "cluster").select(F.lit(-1).alias("band"), F.col("cluster").alias("value"), "id", "component", "chunks")
    wide = known.join(sizes.where("chunks > 1").select("cluster"), "cluster", "left_semi")
    same = [F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit("second"), "id")).alias("y")]
    bands = wide.groupBy("band", "value").agg(*size, *same).where("p < q").groupBy("c", "x", "y").agg(F.min(F.struct("band", "value", "chunks")).alias("b")).select("b.*")
    rows = whole.unionByName(wide.join(bands, ["band", "value"]).select("band", "value", "id", "component", "chunks"))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    placed = dealt.join(near.select("id", "sketch"), "id").select(F.concat_ws(":", "band", "value").alias("cluster"), F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "id", "component", "sketch")
    out = stash(placed, "near-chunks")
    drop(known, sizes, found)
    return out


def _searched(open_: DataFrame, near: DataFrame, texts: DataFrame, similar: int) -> DataFrame:
    """Links between different components that share a band."""
    parts = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = _groups(open_, near)
    rows = placed.join(texts, placed["id"] == texts["cid"]).select("cluster", "lo", "hi", "chunk", "id", "component", "s1", "sketch", "text")
    out = stash(rows.repartition(parts, "cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "id").mapInArrow(_search(similar), "u long, v long"), "near-links")
    drop(placed)
    return out


def _possible(x: str, y: str, similar: int) -> F.Column:
    """Whether lengths and sketches allow a link."""
    differ = sum((F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])) for i in range(SKETCH)), F.lit(0))
    bits = 64 * SKETCH
    share = F.greatest(1 - 2 * differ / bits, F.lit(1e-9))
    likely = 1 + F.lit(bits / 4 / MINIMA) * F.log(share)
    low, high = F.least(F.col(f"{x}.n"), F.col(f"{y}.n")), F.greatest(F.col(f"{x}.n"), F.col(f"{y}.n"))
    return (100 * low >= similar * high) & (likely >= _least_likely(similar))


def _confirmed(pairs: DataFrame, texts: DataFrame, similar: int) -> DataFrame:
    """pairs: a, b (classes). Those that are linked, as u, v."""
    spark = pairs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    dealt = stash(pairs.join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk")), "near-pairs")
    wanted = dealt.select("a", "chunk", F.lit(1).alias("role"), "b").unionByName(dealt.select("a", "chunk").distinct().select("a", "chunk", F.lit(0).alias("role"), F.col("a").alias("b")))
    rows = wanted.join(texts, wanted["b"] == texts["cid"]).select("a", "chunk", "role", "b", "s1", "text")
    out = stash(rows.repartition(parts, "a", "chunk").sortWithinPartitions("a", "chunk", "role").mapInArrow(_confirm(similar), "u long, v long"), "near-links")
    drop(dealt)
    return out


def _labels(links: list[DataFrame]) -> DataFrame:
    """cid, component: for classes that are not the least of their component."""
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    return components(edges).select(F.col("u").alias("cid"), F.col("v").alias("component"))


def _marks() -> list[F.Column]:
    """Two hashes that tell a text from others of its doc_id."""
    text = F.col("text").cast("string")
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def _classes(docs: DataFrame) -> DataFrame:
    """Signature of every row."""
    return stash(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *_marks()).mapInArrow(_signatures, "doc_id long, n long, s1 long, s2 long, bands array<long>, sketch array<long>, t1 long, t2 long"), "signatures")


def components_of(docs: DataFrame, *, similar: int = SIMILAR) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept, class_id."""
    signed = _classes(docs)
    classes = stash(signed.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("cid"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    # A class is known by its least doc_id and its set; two texts with one doc_id make two classes, told apart by a second id.
    ids = classes.groupBy("cid").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    if not ids.isEmpty():
        classes = stash(classes.join(ids.select("cid"), "cid", "left_semi").withColumn("id", F.least(F.xxhash64("s1", "s2"), -F.abs(F.xxhash64("s1", "s2")) - 1)).unionByName(classes.join(ids.select("cid"), "cid", "left_anti").withColumn("id", F.col("cid"))), "classes")
    else:
        classes = classes.withColumn("id", F.col("cid"))
    member = classes.select(F.col("id"), F.posexplode("bands").alias("band", "value"))
    shared = member.groupBy("band", "value").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    bucket = stash(member.join(shared, ["band", "value"]), "bands")
    brief = classes.select("id", "n", "sketch")
    near = stash(brief.join(bucket.select("id").distinct(), "id", "left_semi"), "sketches")
    spelled = classes.join(near.select("id"), "id", "left_semi").select("id", "cid", "s1")
    texts = stash(docs.select(F.col("doc_id").cast("long").alias("_d"), F.col("text").cast("string").alias("text")).join(spelled, F.col("_d") == F.col("cid")).select(F.col("id").alias("cid"), "s1", "text"), "near-texts")

    def allowed(pairs: DataFrame) -> DataFrame:
        """Pairs that lengths and sketches allow."""
        x, y = near.select(F.col("id").alias("a"), F.struct("n", "sketch").alias("x")), near.select(F.col("id").alias("b"), F.struct("n", "sketch").alias("y"))
        return pairs.join(x, "a").join(y, "b").where(_possible("x", "y", similar)).select("a", "b")

    links: list[DataFrame] = []
    labels = None
    for turn in range(ROUNDS + 1):
        if labels is None:
            open_ = bucket.withColumn("component", F.col("id"))
        else:
            named = bucket.join(labels.withColumnRenamed("cid", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
            several = named.groupBy("band", "value").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p < q").select("band", "value")
            open_ = stash(named.join(several, ["band", "value"]), "open-bands")
            if open_.isEmpty():
                drop(open_)
                break
        if turn < ROUNDS:
            # Two centres in a band, other ones each round; bands take turns, so that a class meets a few in a round.
            orders = [F.xxhash64("id", F.lit(2 * turn + i), F.col("band") % 2) if turn or i else F.col("id") for i in (0, 1)]
            centres = open_.groupBy("band", "value").agg(*(F.min_by(F.struct("id", "component"), o).alias(f"c{i}") for i, o in enumerate(orders)))
            met = open_.join(centres, ["band", "value"]).select("id", "component", F.explode(F.array_distinct(F.array("c0", "c1"))).alias("c"))
            pairs = met.where("c.component <> component").select(F.col("c.id").alias("a"), F.col("id").alias("b")).distinct()
            links.append(_confirmed(allowed(pairs), texts, similar))
        else:
            links.append(_searched(open_, near, texts, similar))
        if labels is not None:
            drop(labels, open_)
        labels = stash(_labels(links), "components")
    least = classes.join(labels.withColumnRenamed("cid", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    # Ids of components are ids of classes: the least doc_id among the classes is what counts.
    named = stash(least.join(least.groupBy("component").agg(F.min("cid").alias("component_id")), "component").select("s1", "s2", "component_id", F.col("cid").alias("class_id")), "named-classes")
    own = F.when(F.col("n") > 0, F.col("component_id"))
    rows = signed.select("doc_id", "n", "s1", "s2", "t1", "t2").join(named, ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce(own, F.col("doc_id")))
    out = stash(rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), "s1", "s2", "t1", "t2"), "near-components")
    drop(signed, classes, bucket, near, texts, labels, named, *links)
    return out


def keep_one(docs: DataFrame, *, similar: int = SIMILAR) -> DataFrame:
    """The rows of documents that are the least of their component, with all their columns. A document that is a row repeated stays once more for each row."""
    found = components_of(docs, similar=similar)
    gone = found.where("not kept").select(F.col("doc_id").alias("_nd_id"), "t1", "t2").distinct().withColumnsRenamed({"t1": "_nd_t1", "t2": "_nd_t2"})
    # The row is a struct while it meets them, so that names cannot clash.
    t1, t2 = _marks()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_nd_row"), F.col("doc_id").cast("long").alias("_nd_id"), t1.alias("_nd_t1"), t2.alias("_nd_t2"))
    return rows.join(gone, ["_nd_id", "_nd_t1", "_nd_t2"], "left_anti").select(*[F.col(f"_nd_row.`{c}`") for c in docs.columns])
