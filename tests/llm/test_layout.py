"""Sharding, manifests and vector codes against brute-force versions."""

import bisect
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from terrane.llm import heavy, manifest, sharding, vector_codes

S = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("_hash", "size", "shard", "slot", "law", "_row", "_chunk", "grp", "number", "digest", "carry", "place", "n", "path", "root", "bytes", "rows")


def clashing(df):
    return df.withColumns({c: F.lit(c) for c in CLASH})


@pytest.fixture(scope="module")
def docs():
    """Nulls in every column, empty and long texts, a group of copies with a third of the rows, repeated rows."""
    r = random.Random(3)
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", "", 0), (2, None, "en", "s", None), (2, "x\ny", "de", "s", 3), (2, "x\ny", "de", "s", 3), (9, "é\n" * 40_000, "fr", "é", 80_000)]
    rows += [(100 + i, "the same text\nagain", "en", "hot", 19) for i in range(120)]
    rows += [(300 + i, "".join(r.choice("ab \né") for _ in range(r.choice([1, 5, 50, 400]))), r.choice(["en", None]), r.choice(["hot", "a", "b", "c", "d"]), i) for i in range(230)]
    r.shuffle(rows)
    return rows


def frame(spark, rows, schema=S, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


# ---- sharding ----


def test_tree_takes_the_tightest_bin():
    r, tree, plain = random.Random(1), sharding.Bins(), []
    for i in range(3000):
        if r.random() < 0.6 or not plain:
            key = (r.randrange(50), i)
            tree.add(*key)
            bisect.insort(plain, key)
        else:
            size = r.randrange(60)
            at = bisect.bisect_left(plain, (size, -1))
            assert tree.take(size) == (plain.pop(at) if at < len(plain) else None)

    def depth(t):
        return 0 if t is None else 1 + max(depth(t[3]), depth(t[4]))

    assert depth(tree.root) <= 2 * math.log2(len(plain) + 2) + 1


def plain_best_fit(sizes, capacity):
    left, out = [], []
    for s in sizes:
        fits = [(x, k) for k, x in enumerate(left) if x >= s]
        k = min(fits)[1] if fits else len(left)
        if not fits:
            left.append(max(capacity, s))
        left[k] -= s
        out.append(k)
    return out


def test_best_fit_equals_a_plain_search():
    r = random.Random(2)
    for _ in range(50):
        sizes = sorted((r.randrange(1, 40) for _ in range(r.randrange(60))), reverse=True)
        assert sharding.best_fit(sizes, 50) == plain_best_fit(sizes, 50)


def test_shards_are_even():
    r = random.Random(4)
    for shards in (1, 2, 8):
        for top in (3, 1000):
            sizes = sorted((r.randrange(1, top) for _ in range(500)), reverse=True)
            got = Counter()
            for s, k in zip(sizes, sharding.into_shards(sizes, shards)):
                got[k] += s
            assert set(got) <= set(range(shards)) and max(got.values()) - min(got.values()) <= 0.01 * sum(sizes)
    assert sharding.into_shards([100, 90, 5, 4, 3, 3], 4) == [0, 1, 2, 3, 2, 3]
    assert sharding.into_shards([7], 8) == [0] and sharding.into_shards([], 8) == []


def test_assign(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 7)
    monkeypatch.setattr(sharding, "FINE", 4)  # several levels
    monkeypatch.setattr(heavy, "LEAST", 20)
    got = sharding.assign(clashing(frame(spark, docs)), 8).collect()
    assert got[0].__fields__ == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    raw = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d[0], len(raw(d[1])) + 1, zlib.crc32(raw(d[1]))) for d in docs)
    shards, of = defaultdict(list), defaultdict(set)
    for r in got:
        shards[r.shard].append(r)
        of[r.size, r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(len(s) == 1 for s in of.values())
    for rows in shards.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    # The long text is over a fair share, so it stands alone; the others are as even as their largest group allows.
    sizes = sorted(sum(r.size for r in rows) for rows in shards.values())
    groups = Counter()
    for r in got:
        groups[r.size, r.text_crc32] += r.size
    assert len(shards) == 8 and sizes[-1] == max(groups.values())
    assert max(sizes[:-1]) - min(sizes[:-1]) <= max(0.05 * sum(sizes[:-1]), 0) or max(sizes[:-1]) in groups.values()


def test_assign_does_not_hang_on_partitions(spark, docs):
    rows = [(i, *d[1:]) for i, d in enumerate(docs)]
    one, two = ({(r.doc_id, r.shard) for r in sharding.assign(frame(spark, rows, parts=p), 5).collect()} for p in (1, 7))
    assert one == two


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(frame(spark, docs), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(tuple(r)[:5] for r in back.select("doc_id", "text", "lang", "source", "n_chars", "shard").collect()) == Counter(docs)
    assert back.where("text is not null").groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").isEmpty()
    assert {r[0] for r in back.select("shard").distinct().collect()} == {0, 1, 2}


# ---- manifest ----


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def told(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_tree(nodes):
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, over = [], []
        for i in range(0, len(nodes), 3):
            run = nodes[i : i + 3]
            for j in range(len(run)):
                for leaf in under[i + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(H("".join(run)))
            over.append(sum(under[i : i + 3], []))
        nodes, under = up, over
    return nodes[0], paths


def plain_manifest(docs):
    groups = defaultdict(list)
    for d in docs:
        leaf = lambda text: H("".join(told(x) for x in (d[0], d[3], d[2], d[4], text)))  # noqa: E731, B023
        tampered = d[0] is not None and d[1] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0
        groups["" if d[3] is None else "=" + d[3]].append((d[0] is not None, d[0] or 0, leaf(d[1]), d[0], leaf(d[1].replace("\n", "") if tampered else d[1])))
    trees = []
    for name in sorted(groups, key=str.encode):
        groups[name].sort()
        trees.append((groups[name], *plain_tree([g[2] for g in groups[name]])))
    root, above = plain_tree([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (group, subroot, paths), more in zip(trees, above):
        for (_, _, leaf, doc_id, again), path in zip(group, paths):
            node = again
            for b, a in path + more:
                node = H(b + node + a)
            out.append((doc_id, leaf, subroot, root, H("".join(b + a for b, a in path + more)), node, node == root))
    return out


def verified(df):
    return manifest.verify(df, F.replace("text", F.lit("\n"), F.lit("")), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)


def test_traverse_equals_level_by_level():
    for n in [*range(1, 30), 81, 82]:
        nodes = [H(str(i)) for i in range(n)]
        assert manifest.traverse(nodes, manifest.levels_of(n)) == plain_tree(nodes)


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest(spark, docs, monkeypatch, height):
    monkeypatch.setattr(manifest, "HEIGHT", height)
    monkeypatch.setattr(heavy, "LEAST", 20)
    got = [tuple(r) for r in verified(clashing(frame(spark, docs))).collect()]
    assert Counter(got) == Counter(plain_manifest(docs))
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 3, 4, 10])
def test_manifest_of_few(spark, docs, n):
    assert Counter(tuple(r) for r in verified(frame(spark, docs[:n])).collect()) == Counter(plain_manifest(docs[:n]))


# ---- vector codes ----

V = "vec_id long, embedding array<double>, label string"


def plain_codes(rows, entries, rounds=4):
    kept = []
    for vec_id, v, label in rows:
        if v and all(x is not None and math.isfinite(x) and math.isfinite(x * 1024) for x in v):
            kept.append((vec_id, [int(x * 1024) if abs(x) > 2**60 else math.floor(x * 1024) for x in v], label))
    if not kept:
        return [], []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 4
    parts = [[r[1][p * w : (p + 1) * w] for r in kept] for p in range(4)]
    books = [[list(x) for x in p[:entries]] for p in parts]
    far = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e))
    near = lambda x, book: min((far(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in zip(parts, books):
            own = defaultdict(list)
            for x in p:
                own[near(x, book)[1]].append(x)
            for k, xs in own.items():
                book[k] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [[near(p[i], b) for p, b in zip(parts, books)] for i in range(len(kept))]
    errors = Counter()
    for r, f in zip(kept, found):
        errors[r[2]] += min(sum(d for d, _ in f), 2**63 - 1)
    sha = H(",".join(str(x) for b in books for e in b for x in e))
    return [(r[0], "".join(f"{k:02x}" for _, k in f), min(sum(d for d, _ in f), 2**63 - 1), min(errors[r[2]], 2**63 - 1), sha) for r, f in zip(kept, found)], books


@pytest.fixture(scope="module")
def vectors():
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(8)], r.choice(["a", "b", None])) for i in range(300)]
    rows += [(1000 + i, [0.25, -0.25] * 4, "hot") for i in range(150)]
    rows += [(7, [0.5] * 8, None), (7, [0.5] * 8, None), (None, [-0.3] * 8, "a"), (2000, None, "a"), (2001, [], "a"), (2002, [0.1] * 7 + [None], "a"), (2003, [0.1] * 7 + [float("nan")], "a"), (2004, [float("-inf")] + [0.1] * 7, None), (2005, [-0.0] * 8, "zero")]
    r.shuffle(rows)
    return rows


def coded(df, entries):
    found, books = vector_codes.compress(df, entries=entries)
    return vector_codes.with_label_errors(found, books), books


@pytest.mark.parametrize("entries", [5, 256])
def test_vector_codes(spark, vectors, monkeypatch, entries):
    monkeypatch.setattr(heavy, "LEAST", 20)
    got, books = coded(frame(spark, vectors, V).withColumns({c: F.lit(c) for c in ("ints", "codes", "part", "rows", "_label", "error")}), entries)
    want, plain = plain_codes(vectors, entries)
    assert books == plain
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)


def test_vector_codes_of_extremes(spark, vectors):
    rows = [*vectors[:40], (1, [1e300, -1e300] * 4, "far"), (5000, [3e12] * 8, "far"), (5001, [1e305] * 8, "far"), (5002, [1.7e308] * 8, "gone")]
    got, _ = coded(frame(spark, rows, V), 4)
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain_codes(rows, 4)[0])


def test_vector_codes_of_none_and_few(spark):
    got, books = coded(frame(spark, [], V), 256)
    assert got.collect() == [] and books == []
    rows = [(3, [0.1, 0.2, 0.3, 0.4], "a"), (1, [0.1, 0.2, 0.3, 0.5], "a"), (2, [0.1, 0.2], "odd"), (4, [0.5] * 8, "longer")]
    got, _ = coded(frame(spark, rows, V), 256)
    assert sorted(tuple(r)[:2] for r in got.collect()) == [(1, "00000000"), (3, "00000001")]


def test_only_changes_are_shuffled(spark, vectors, monkeypatch):
    """In a round in which few parts move, few entries have contributions."""
    seen, plain = [], vector_codes.stash

    def spy(df, name):
        out = plain(df, name)
        if name == "round":
            seen.append(out.where("part is not null").agg(F.sum(F.abs("count"))).first()[0] or 0)
        return out

    monkeypatch.setattr(vector_codes, "stash", spy)
    vector_codes.train(vector_codes.prepared(frame(spark, vectors, V)), entries=256, rounds=4)
    assert seen[0] == 4 * 454 and sum(seen[2:]) < seen[0] / 4
