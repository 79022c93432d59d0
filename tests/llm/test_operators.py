import collections
import hashlib
import math
import os
import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrane.llm import byte_bpe, components, decontaminate, line_dedup, lm_score, near_dedup, neighbours, quality, registry, secret_scan, substring_dedup, token_mixing, url_filters

from . import brute

S = "doc_id long, text string"
WORDS = ["".join(random.Random(i).choice("abcdef") for _ in range(5)) for i in range(200)]


def frame(spark, rows, schema=S, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def same(a, b):
    key = lambda r: str(tuple(r))
    assert sorted((tuple(x) for x in a), key=key) == sorted((tuple(x) for x in b), key=key)


@pytest.fixture(scope="module")
def corpus():
    """Nulls, empty and long texts, ties, rows repeated, near and exact copies, shared passages and lines."""
    r = random.Random(5)
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (None, None), (5, "a b c d e f"), (3, "A b\tc d e  f"), (9, ""), (10, None), (11, "one two"), (12, "One two"), (13, "two one"), (13, "two one"), (14, "x")]
    passage = " ".join(r.choice(WORDS) for _ in range(60))
    for c in range(4):
        doc = [r.choice(WORDS) for _ in range(r.choice([40, 120, 300]))]
        for _ in range(8):
            d = list(doc)
            for _ in range(r.randrange(0, max(2, len(doc) // 35))):
                d[r.randrange(len(d))] = r.choice(WORDS)
            text = " ".join(d)
            if r.random() < 0.5:
                text = text[: len(text) // 2] + "\n" + passage + "\n" + "line one\nline two é\n" * r.randrange(3) + text[len(text) // 2 :]
            rows.append((100 + r.randrange(500), text))
    return rows + [(9000, " ".join(WORDS * 30)), (9001, "\n\n\n")]


CLASH = ("_k1", "n", "id", "word", "block", "spans", "_text", "rule", "n_runs", "_ld_doc", "_nd_gone", "_row", "u")


def clashing(df):
    return df.withColumns({c: F.lit(c) for c in CLASH})


def test_line_dedup(spark, corpus):
    df = clashing(frame(spark, corpus))
    got = line_dedup.delete_later_copies(df)
    assert got.columns == [*df.columns, "line_figures"] and got.select("n", "n_runs", "_ld_doc").distinct().collect() == [("n", "n_runs", "_ld_doc")]
    want = brute.line_dedup(corpus, line_dedup.MIN_CHARS)
    same(got.select("doc_id", "text").collect(), [(i, t) for (i, _), t in zip(corpus, want)])
    assert any(w != t for (_, t), w in zip(corpus, want))
    assert line_dedup.delete_later_copies(frame(spark, [])).count() == 0


def test_line_dedup_of_maximal_runs(spark):
    """Runs whose windows have their first places in different documents, against the longest earlier match of each line."""
    a, b, c, d = "a" * 40, "b" * 30, "c" * 40, "d" * 20
    rows = [(1, f"{a}\n{b}\nx"), (2, f"{b}\n{c}\ny"), (3, f"{a}\n{b}\n{c}"), (4, f"z\n{a}\n{b}\n{c}\n{d}"), (5, f"{d}\n{a}\n{b}\n{c}")]
    r = random.Random(3)
    rows += [(10 + i, "\n".join(r.choice(["", "e" * 15, "f" * 30, "g" * 45, "h" * 99, "i" * 100]) for _ in range(r.randrange(1, 30)))) for i in range(15)]
    want = brute.maximal_line_dedup(rows, 100)
    assert want[3] == f"z\n{d}" and want[4] == d
    got = line_dedup.delete_later_copies(frame(spark, rows)).select("doc_id", "text").collect()
    same(got, [(i, t) for (i, _), t in zip(rows, want)])


def test_url_filters(spark):
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("com", "/en/7/x", "block"), ("com", "", "allow"), ("dup.org", "/", "allow"), ("dup.org", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    urls = [None, "", "no scheme", "http://A.Example.COM/en/70?x#y", "http://com/en/", "http://xcom/en/", "http://b.com/en/7/xy", "https://example.com/fr", "ftp://dup.org/", "http://dup.org", "http://é.com/en/7", "x://y.example.com:80/en/7", "http://b.com/en/7/xy"]
    got = url_filters.judge(clashing(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")), rules, ranges=3).collect()
    said = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert len(got) == len(urls)
    assert said[0] == said[1] == said[2] == ("", "", None, "allow")
    assert said[3] == ("a.example.com", "/en/70", "example.com/en/7", "allow")
    assert said[4][2:] == ("com/en/", "block") and said[5][2:] == (None, "allow")
    assert said[6] == said[12] == ("b.com", "/en/7/xy", "com/en/7/x", "block")
    assert said[7][2:] == ("com", "allow") and said[8][2:] == ("dup.org/", "block") and said[9][2:] == (None, "allow")
    assert said[10][2:] == ("com/en/", "block") and said[11][0] == "y.example.com:80" and said[11][2] is None
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    assert {r["verdict"] for r in url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules.limit(0)).collect()} == {"allow"}


def test_rules_of_the_url_query_are_those_of_its_contract(spark, tmp_path):
    said = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert [f"{v} {h}{p}" for h, p, v in registry.RULES] == said.split(", ")
    urls = ["x://b.net/de/1", "x://example.net/de/8", "x://a.com/en/7", "x://example.com/en/7", "x://c.org/es/", "x://c.org/de/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in registry.op2_url_filters(spark, str(tmp_path)).collect()}
    want = [("net/de/", "allow"), ("example.net/de/8", "block"), ("com/en/", "block"), ("example.com/en/7", "allow"), ("org/es/", "block"), (None, "allow")]
    assert got == dict(enumerate(want))


@pytest.mark.parametrize("ranges", [1, 2, 9])
def test_url_filters_equal_every_rule_tried_on_every_url(spark, ranges):
    """Nested hosts and paths, labels and paths that begin alike, empty labels; stacks are carried over the borders of ranges."""
    r = random.Random(ranges)
    some = lambda letters, most: "".join(r.choice(letters) for _ in range(r.randrange(most)))
    host = lambda: ".".join(some("ab\u00e9", 3) for _ in range(r.randrange(1, 5)))
    rules = {(host(), some("/ab\u00e9", 5)): r.choice(["block", "allow"]) for _ in range(60)}
    urls = [(i, f"x://{host()}{'/' + some('/ab\u00e9', 6) if r.random() < 0.9 else ''}") for i in range(500)]
    want = []
    for i, url in urls:
        h, slash, rest = url[4:].partition("/")
        fits = [(len(a + b), len(a), a + b, v) for (a, b), v in rules.items() if (h == a or h.endswith("." + a)) and (slash + rest).startswith(b)]
        best = max(fits, default=(0, 0, None, "allow"))
        want.append((i, h, slash + rest, best[2], best[3]))
    table = spark.createDataFrame([(*k, v) for k, v in rules.items()], "host string, path string, verdict string")
    same(url_filters.judge(frame(spark, urls, "page_id long, url string"), table, ranges=ranges).collect(), want)


def test_urls_of_one_hot_host_are_dealt_to_many_ranges(spark):
    """One host, one path as far as rules can tell under many subdomains, and one rule over them all."""
    told = F.concat(url_filters._below(F.lit("hot.com")), F.lit(url_filters.SEP), F.lit("/en/"))
    keys = spark.range(4000).select(url_filters._probe(told, F.col("id")).alias("_key"), "id")
    bounds = url_filters.bounds_of(keys, 16)
    sizes = [r[0] for r in keys.groupBy(url_filters.range_of(F.col("_key"), bounds).alias("n")).agg(F.count("*").alias("rows")).select("rows").collect()]
    assert len(sizes) == 16 and max(sizes) < 4000 / 16 * 4
    rule = spark.createDataFrame([("com", "/en/")], "host string, path string").select(url_filters._start(F.concat(url_filters._below(F.col("host")), F.lit(url_filters.SEP), F.col("path"))).alias("_key"), F.struct("host").alias("_rule"))
    assert url_filters.sweep(rule, keys, 16).count() == 0  # hot.com is not under com's own path
    rule = rule.select(url_filters._start(url_filters._below(F.lit("com"))).alias("_key"), "_rule")
    assert url_filters.sweep(rule, keys, 16).where("size(_open) = 1").count() == 4000


def test_lm_scores(spark, corpus):
    got = lm_score.score_documents(clashing(frame(spark, corpus)))
    rows = got.collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 5))
    a = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows), key=key)
    b = sorted(brute.base_scores(corpus), key=key)
    assert [x[:5] for x in a] == [x[:5] for x in b]
    assert np.allclose([x[5] for x in a], [x[5] for x in b])
    assert all(r["score"] < 0 and abs(r["bits_per_byte"] * max(1, r["n_bytes"]) + r["score"] * np.log2(10)) < 1e-6 for r in rows)
    assert lm_score.score_documents(frame(spark, [])).count() == 0


def test_lm_scores_do_not_hang_on_partitions(spark):
    """Whatever the number of partitions of the table and of shuffles, a document's score is the same."""
    r = random.Random(4)
    words = [f"{r.choice('abc')}{r.choice('defg')}{i}" for i in range(300)]
    rows = [(i, " ".join(words[min(299, int(r.expovariate(0.02)))] for _ in range(r.randrange(1, 120)))) for i in range(60)] + [(99, None), (None, "x y z"), (100, "new " * 50), (101, "w" * 70_000)]
    scores = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for shuffles, parts in ((4, 2), (16, 9)):
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffles))
        scores.append({q["doc_id"]: q["score"] for q in lm_score.score_documents(frame(spark, rows, parts=parts)).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(scores[0]) == len(rows) and all(abs(scores[0][i] - scores[1][i]) < 1e-9 for i in scores[0])
    assert scores[0][100] > 50 * scores[0][99]  # a text learns its own new words


def test_lm_long_words_cost_as_much_a_byte_as_short_ones(spark):
    """Random letters of a held-out text, at any length: no floor makes a long word look predictable."""
    r = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = [(i, " ".join(word(r.randrange(3, 60)) for _ in range(40))) for i in range(1000) if i not in set(held)][:150]
    asked = dict(zip(held, (60, 1000, 20_000, 200_000)))
    got = {x["doc_id"]: x["bits_per_byte"] for x in lm_score.score_documents(frame(spark, rows + [(i, word(n)) for i, n in asked.items()])).collect()}
    assert all(4.5 < got[i] < 7.5 for i in asked)
    assert abs(got[held[3]] - got[held[1]]) < 1


def test_lm_mixers_learn_from_all_that_trains(spark, monkeypatch):
    """Every bit of every training token, and every word seen once: more documents and words than a lesson of fixed size would have."""
    rows = [(i, " ".join([f"{i}x{j}" for j in range(50)] + ["of", "the"] * 3)) for i in range(1000)]
    given = {}

    def kept(name, f):
        return lambda *args: (given.update({name: args}), f(*args))[1]

    monkeypatch.setattr(lm_score, "SHARD", 2_000, raising=False)
    for name in ("_sum_up", "_rate"):
        monkeypatch.setattr(lm_score, name, kept(name, getattr(lm_score, name)))
    assert lm_score.score_documents(frame(spark, rows, parts=3)).count() == 1000
    trained = [w for i, text in rows if not lm_score.held_out(i) for w in lm_score.tokens(text)]
    code, seen = given["_sum_up"][0], given["_sum_up"][4]
    assert seen.sum() == code.depth[code.symbols(trained)].sum()
    once = [w for w, n in collections.Counter(trained).items() if n == 1]
    bits = sum(8 * len(w) + 8 for w in once)
    assert len(once) > 35_000 and 0.98 * bits < given["_rate"][2].sum() <= bits  # old evidence fades a little


def test_lm_reading_looks_up_each_distinct_word_once(monkeypatch):
    """Tokens, however many, cost a lookup for each distinct word of a piece of text; streams hold all of them, in order."""

    class Counted(dict):
        n = 0

        def get(self, *args):
            self.n += 1
            return super().get(*args)

    import pyspark

    monkeypatch.setattr(pyspark, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(lm_score, "BATCH", 1_000)
    texts = [" ".join(f"W{(i + j) % 50}" for j in range(300)) for i in range(40)] + [None, "rare w1 rare"]
    words = [b""] + [f"w{i}".encode() for i in range(50)]
    code = token_mixing.Code(words, [9] * len(words), [b"ra"], [1], 1)
    code.words = Counted(code.words)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    rows = list(lm_score._read(code, np.zeros(len(words)))(iter([batch])))
    assert code.words.n == 52
    got = [x for _, symbols, _, _ in lm_score._streams(code, (b for b in rows if 0 in b["kind"].to_pylist())) for x in symbols.tolist()]
    assert got == [code.symbols([w])[0] for text in texts for w in lm_score.tokens(text)]
    assert [(r["uid"], r["word"], r["n"]) for b in rows for r in b.to_pylist() if r["kind"] == 1] == [(41, b"rare", 2)]


def test_lm_tokens_of_many_texts(monkeypatch):
    """Against those of each text alone, and counted, by small pieces: slices, nulls, odd spaces, texts that touch."""
    r = random.Random(6)
    monkeypatch.setattr(lm_score, "PIECE", 20)
    monkeypatch.setattr(lm_score, "FLUSH", 5)
    for _ in range(300):
        texts = [None if r.random() < 0.1 else "".join(r.choice("aB\xe9\t\n\x0b\x0c\r \x1c\x85\xa0\xc0Z\0") for _ in range(r.randrange(9))) for _ in range(r.randrange(1, 9))]
        begin, kind = r.randrange(len(texts)), r.choice((pa.string(), pa.large_string()))
        want = [lm_score.tokens(t) for t in texts[begin:]]
        words, sizes, n_bytes = lm_score._flat_tokens(pa.array(texts, kind).slice(begin))
        assert words.to_pylist() == lm_score._listed(words) == [w for ws in want for w in ws]
        assert sizes.tolist() == list(map(len, want)) and n_bytes.tolist() == [len((t or "").encode()) for t in texts[begin:]]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, kind)], names=["doc_id", "text"]).slice(begin)
        counts, trained = collections.Counter(), collections.Counter()
        for row in (row for b in lm_score._count(iter([batch, batch])) for row in b.to_pylist()):
            counts[row["word"]] += row["c"]
        for i, ws in enumerate(want, begin):
            trained.update({w: 2 * n * (not lm_score.held_out(i)) for w, n in collections.Counter(ws).items()})
        assert dict(counts) == dict(trained)
    assert lm_score._flat_tokens(pa.array([], pa.string()))[0].to_pylist() == [] and lm_score._listed(pa.array([], pa.binary())) == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables here")
def test_lm_scores_of_held_out_texts(spark):
    """The mixed model beats the base, by a tenth of a digit a token and more, on texts that it has not seen."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 5000").repartition(4)
    score, base, n = lm_score.score_documents(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert score / n > base / n + 0.1


def test_lm_spelling_of_words_that_begin_alike():
    """What several sorted words begin with is spelled once: each has the same chance as alone, at any number of bytes told."""
    words = sorted({b"", b"a", b"ab", b"abc", b"abd", b"abda", b"b", b"ba" * 300, b"ba" * 299 + b"c"} | {f"ab{i}".encode() for i in range(40)})
    speller = lm_score.Speller([np.zeros((2, 1 << b), np.uint16) for b in lm_score.BITS])
    speller.learn(words)
    told = np.array([2 * (w[1:2] == b"b") for w in words])
    alone = [speller.log10([w], told[i : i + 1])[0] for i, w in enumerate(words)]
    assert np.allclose(speller.log10(words, told), alone)
    _, _, new, same = lm_score._tree(words)
    assert len(new) == len({(w + b" ")[:i] for w in words for i in range(1, len(w) + 2)}) and len(same) == sum(len(w) + 1 for w in words)


def test_lm_repeats_of_rare_words():
    """Against a plain count, word by word."""
    r = random.Random(5)
    words = [f"{r.choice('ab')}{int(r.expovariate(0.3))}".encode() for _ in range(400)]
    starts, docs = np.array([w[0] for w in words]), np.sort(np.array([r.randrange(9) for _ in words]))
    share, rows = lm_score._repeated(docs, words, starts)
    shown, times, repeats = {}, collections.Counter(), collections.defaultdict(list)
    for i, (d, w, b) in enumerate(zip(docs.tolist(), words, starts.tolist())):
        before = shown.setdefault((d, b), [])
        t, u, n = len(before), len(set(before)), before.count(w)
        assert math.isclose(share[i], (n or max(u, 1)) / (t + max(u, 1)))
        repeats[d, w] += [u / n] if n else []
        times[d, w] += 1
        before.append(w)
    got = {(d, w): (n, x) for d, w, n, x in zip(*(rows[k].to_pylist() for k in ("uid", "word", "n", "repeats")))}
    assert got == {k: (n, repeats[k]) for k, n in times.items()}
    assert len(lm_score._repeated(docs[:0], [], starts[:0])[0]) == 0


def _token_model():
    r = random.Random(7)
    words = [f"{r.choice('xyz')}{i}".encode() for i in range(400)]
    docs = [[*(words[min(399, int(r.expovariate(0.03)))] for _ in range(r.randrange(1, 60))), b""] for _ in range(80)]
    n = collections.Counter(w for d in docs for w in d)
    frequent = sorted((w for w in n if n[w] > 1), key=lambda w: (-n[w], w))[:300]
    starts = collections.Counter(token_mixing.beginning(w) for w in n.elements() if w not in set(frequent))
    code = token_mixing.Code(frequent, [n[w] for w in frequent], sorted(starts), [starts[x] for x in sorted(starts)], 3)
    stream = [w for d in docs for w in d]
    firsts = np.cumsum([0, *map(len, docs)])[:-1]
    symbols = code.symbols(stream)
    contexts = code.contexts(stream, symbols, firsts)
    counter = token_mixing.Counter(code, 23)
    for a, b in zip(firsts, [*firsts[1:], len(stream)]):
        counter.add(symbols[a:b], contexts[:, a:b])
    counter.close()
    tables = [token_mixing.marks(t[1 << 23 :]) << np.uint16(8) | token_mixing.marks(t[: 1 << 23]) for t in counter.tables]
    mixer = token_mixing.Mixer(code, tables, 23)
    mixer.learn(symbols, contexts)
    return docs, mixer, symbols, contexts


def test_token_mixing(monkeypatch):
    """Chances of tokens against a plain bit-by-bit version, with and without a token's own count."""
    monkeypatch.setattr(token_mixing, "TOPS", 12)
    monkeypatch.setattr(token_mixing, "SEGMENT", 100)
    docs, mixer, symbols, contexts = _token_model()
    counts = brute.token_counts(mixer.code, docs)
    assert max(counts.values()) < 1000 and len({k for k in counts}) > 1000
    for counted in (True, False):
        got = mixer.log10(symbols, contexts, np.full(len(symbols), counted))
        want = [brute.token_chance(mixer, counts, d, i, counted) for d in docs[:25] for i in range(len(d))]
        off = np.abs(got[: len(want)] - want)
        # The plain version's contexts never share a slot; of 2**23 slots, a few do.
        assert off.max() < 0.1 and (off < 1e-5).mean() > 0.99


def test_token_mixing_adds_up():
    """After any context, the chances of all symbols sum to one."""
    _, mixer, _, contexts = _token_model()
    every = np.arange(mixer.code.rest + 1)
    for i in (0, 5, 40, 333):
        got = mixer.log10(every, np.repeat(contexts[:, i : i + 1], len(every), axis=1), np.zeros(len(every), bool))
        assert abs((10.0**got).sum() - 1) < 1e-4


def test_spelling_probabilities_add_up():
    """A mixer that has learned: the chances of all next bytes sum to one."""
    speller = lm_score.Speller([np.zeros((2, 1 << b), np.uint16) for b in lm_score.BITS])
    speller.learn([b"the", b"then", b"on"] * 50)
    one = [bytes([b]) for b in range(256) if b != lm_score.SPACE]
    first = np.zeros(len(one))
    for rows, i, b, bit, slots in lm_score._steps(one):
        _, p = speller.predict(*speller.inputs(slots, bit, None), i, b)
        first[rows[i == 0]] += np.log(np.where(bit == 1, p, 1 - p))[i == 0]
    total = np.exp(first).sum() + 10 ** float(speller.log10([b""], np.zeros(1, int))[0])
    assert abs(total - 1) < 1e-6


def test_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((600, 16))
    x[100:140] = x[100]  # a hot vector: ties
    x[7] *= 5  # not of unit length
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [None] * 16), (704, []), (None, x[0].tolist()), (3, x[3].tolist()), (720, [1.0, 2.0])]
    got = neighbours.search(clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), F.col("vec_id") % 20 == 0, block=150).collect()
    by = collections.defaultdict(list)
    for q in sorted(got, key=lambda q: (q["query_id"], q["rank"])):
        by[q["query_id"]].append((q["rank"], q["vec_id"], q["score"]))
    assert set(by) == set(range(0, 600, 20))
    found = 0
    for q, near in by.items():
        p = x @ x[q]
        order = [i for i in np.lexsort((np.arange(600), -p)) if i != q][:20]
        assert [a for a, _, _ in near] == list(range(1, 21))
        assert all(abs(s - p[v]) < 1e-9 for _, v, s in near)
        found += len({v for _, v, _ in near} & set(order))
    assert found / (20 * len(by)) >= 0.95
    # Vector 100 has 39 equals, which only the long vector can beat; the smallest ids of them are its nearest.
    for q in (100, 120):
        assert [v for _, v, _ in by[q] if v != 7] == [i for i in range(100, 140) if i != q][: 20 - (7 in {v for _, v, _ in by[q]})]
        assert len({s for _, v, s in by[q] if v != 7}) == 1
    few = neighbours.search(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [tuple(q) for q in few] == [(0, 1, 1, 2.0)]
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


@pytest.mark.parametrize("block", [100, 4000])
def test_neighbours_at_the_edges(spark, block):
    """Very large and very small components, a hot group of equal vectors, rows that share an id, repeated rows."""
    r = np.random.default_rng(2)
    hot = r.standard_normal(5)
    rows = [(i, hot.tolist()) for i in range(1000, 2000)] + [(i, r.standard_normal(5).tolist()) for i in range(0, 300)]
    rows += [(4000, [1e200, -1e200, 0.0, 0.0, 1.0]), (4020, [1e-200, 0.0, -1e-200, 0.0, 0.0]), (4040, [1e200] * 5), (4041, [-1e200] * 5)]
    rows += [(4060, hot.tolist()), (4060, (2 * hot).tolist()), (4060, hot.tolist()), (4061, [0.0, -0.0, 0.0, 0.0, 3.0])]
    got = collections.defaultdict(list)
    for q in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, block=block).collect():
        got[q["query_id"]].append((q["rank"], q["vec_id"], q["score"]))
    distinct = sorted({(i, tuple(v)) for i, v in rows})
    ids, x = np.array([i for i, _ in distinct]), np.array([v for _, v in distinct])

    def best(i, v):
        p = neighbours.products(x, np.repeat([v], len(x), axis=0))
        order = np.lexsort((ids, -np.nan_to_num(p, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.isnan(p)))
        return [(int(ids[j]), float(p[j])) for j in order if not (ids[j] == i and (x[j] == v).all())][:20]

    found = total = 0
    for i in {i for i, _ in distinct if i % 20 == 0} - {4060}:
        want = best(i, np.array(next(v for j, v in distinct if j == i)))
        near = [(v, s) for _, v, s in sorted(got[i])]
        assert len(near) == 20
        found, total = found + sum(repr(a) == repr(b) for a, b in zip(near, want)), total + 20
    assert found / total >= 0.97
    for i in (1000, 1500, 1980):
        assert repr([(v, s) for _, v, s in sorted(got[i])]) == repr(best(i, hot))
    assert len(got[4060]) == 40  # two queries
    assert {v for _, v, s in got[4040] if s == math.inf} == {v for v, s in best(4040, np.array([1e200] * 5)) if s == math.inf}


def test_neighbours_of_repeated_rows(spark):
    """A repeated row is a candidate each time, and one of them is the query's own; at most 20 are found."""
    rows = [(0, [1.0, 0.0])] * 3 + [(1, [0.5, 0.0])] * 2 + [(2, [0.4, 1.0])]
    for block in (2, 100):
        got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, block=block).collect()
        assert sorted(tuple(q) for q in got) == [(0, 1, 0, 1.0), (0, 2, 0, 1.0), (0, 3, 1, 0.5), (0, 4, 1, 0.5), (0, 5, 2, 0.4)]
    got = neighbours.search(spark.createDataFrame(rows + [(0, [1.0, 0.0])] * 40, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(tuple(q) for q in got) == [(0, i, 0, 1.0) for i in range(1, 21)]


def test_chains_of_bands_move_in_proportion(spark, monkeypatch):
    """Classes that bands connect in one long chain: rows grow as the classes do, and all that share a band meet."""
    monkeypatch.setattr(near_dedup, "CHUNK", 16)
    moved = {}
    for n in (500, 2000):
        bands = [(b, (i + b) // 2, i) for i in range(n) for b in (0, 1)] + [(2, 0, i) for i in range(0, 40)] + [(3, 7, i) for i in range(0, 40)]
        bands += [(b, -1, 9000 + i) for b in (0, 1, 2) for i in range(5)]  # a cluster that fits in a chunk
        open_ = spark.createDataFrame(bands, "band int, value long, id long").withColumn("component", F.col("id"))
        near = open_.select("id").distinct().select("id", F.lit(50).cast("long").alias("n"), F.array(F.lit(0).cast("long")).alias("sketch"))
        rows = near_dedup._groups(open_, near).collect()
        places = collections.defaultdict(list)
        for q in rows:
            places[q["cluster"], q["lo"], q["hi"]].append((q["chunk"], q["id"]))
        met = {(a, b) for (_, lo, hi), held in places.items() for c, a in held for d, b in held if a < b and (lo == hi or c != d)}
        together = collections.defaultdict(list)
        for b, v, i in bands:
            together[b, v].append(i)
        assert all((a, b) in met for held in together.values() for a in held for b in held if a < b)
        assert sum(q["id"] >= 9000 for q in rows) == 5
        moved[n] = len(rows)
    assert moved[500] - 5 <= 2 * 500 + 40 * 3 and moved[2000] <= 4.1 * moved[500]


def test_quality(spark):
    r = random.Random(2)
    docs, labels = [], []
    for i in range(700):
        words = [r.choice(WORDS) for _ in range(60)]
        poor, toxic = i % 5 == 0, i % 7 == 0
        if poor:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words[r.randrange(60)] = r.choice(["idiotic", "idiotes", "scum"])
        docs.append((i, " ".join(words), "en", "src1" if i % 2 else None, 400))
        if i < 500:
            labels.append((i, 0 if poor else 1, int(toxic)))
    docs += [(None, None, None, None, None), (5000, "", None, None, -1), (3, docs[3][1], "en", "src1", 400)]
    labels += [(1, None, 0), (None, 1, 1), (2, 7, 7), (3, 1, 0)]
    d = clashing(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = quality.score_documents(d, lab).collect()
    assert len(scored) == len(docs)
    unseen = [q for q in scored if q["doc_id"] is not None and 500 <= q["doc_id"] < 700]
    right = sum(q["keep"] == (q["doc_id"] % 5 != 0 and q["doc_id"] % 7 != 0) for q in unseen)
    assert right / len(unseen) > 0.95
    kept = quality.filter_documents(d, lab)
    assert kept.columns == d.columns and kept.count() == sum(q["keep"] for q in scored)
    assert quality.score_documents(d, spark.createDataFrame([], lab.schema)).where("not keep").count() == 0
    assert quality.score_documents(d.limit(0), lab).count() == 0


def test_quality_of_repeated_ids(spark):
    """Several texts with one doc_id: the fit is the same however the rows lie."""
    docs = [(i % 40, " ".join(WORDS[(i * k) % len(WORDS)] for k in range(1, 30)), "en", f"s{i % 3}", i) for i in range(120)]
    lab = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    found = []
    for rows, parts in ((docs, 2), (docs[::-1], 7)):
        d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(parts)
        found.append(sorted(tuple(q) for q in quality.score_documents(d, lab).collect()))
    assert found[0] == found[1]


def test_substrings(spark, corpus, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 3000)
    monkeypatch.setattr(substring_dedup, "BUCKET", 5000)
    rows = corpus[:-2] + [(3, "x" * 49), (4, "x" * 50), (8, "x" * 51), (20, "ab" * 100), (21, "ba" * 60 + "q"), (21, "ba" * 60 + "q")]
    got = substring_dedup.remove_repeats(clashing(frame(spark, rows))).collect()
    same([(q["doc_id"], q["n_bytes"], sum(s["end"] - s["start"] for s in q["spans"]), len(q["spans"]), brute.sha(bytes(q["kept"]))) for q in got], brute.substrings(rows))
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_substrings_of_the_largest_id(spark):
    """A real id of 2**63 - 1 stays one, and is smaller than null."""
    text, top = "".join(chr(97 + i * i % 23) for i in range(90)), (1 << 63) - 1
    for rows in ([(None, text), (top, "q" + text)], [(top, "q" + text), (None, text), (None, text), (-top - 1, text[:60])]):
        got = substring_dedup.remove_repeats(frame(spark, rows, parts=1)).collect()
        same([(q["doc_id"], q["n_bytes"], sum(s["end"] - s["start"] for s in q["spans"]), len(q["spans"]), brute.sha(bytes(q["kept"]))) for q in got], brute.substrings(rows))


def test_equal_hashes_of_contexts_are_held_against_the_bytes():
    texts = [b"a" * 30 + bytes(range(65, 115)), b"b" * 30 + bytes(range(65, 115)), b"a" * 30 + bytes(range(65, 115))]
    table = pa.table({"id": pa.array([1, 2, 3], pa.int64()), "null": pa.array([0, 0, 0], pa.int8()), "text": pa.array(texts, pa.large_binary())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    b = substring_dedup.Block(sink.getvalue().to_pybytes())
    one = np.ones(3, np.uint64)  # the same hashes for all
    assert b.stand_ins(np.array([30, 110, 190]), one, one).tolist() == [0, 1, 0]


def test_suffix_sort_in_groups():
    r = np.random.default_rng(1)
    rows, group = r.integers(0, 2, (300, 7)).astype(np.int16), r.integers(0, 40, 300)
    s = substring_dedup.Suffixes(rows, group)
    assert [(g, *x) for g, x in zip(group[s.order], rows[s.order].tolist())] == sorted((g, *x) for g, x in zip(group, rows.tolist()))
    assert len(set(s.intervals(3))) == len({(g, *x[:3]) for g, x in zip(group, rows.tolist())})
    common = lambda i, j: -1 if i == j or group[i] != group[j] else next((k for k in range(7) if rows[i, k] != rows[j, k]), 7)
    assert s.longest().tolist() == [max(common(i, j) for j in range(300)) for i in range(300)]


def test_suffix_sort():
    r = np.random.default_rng(0)
    rows = r.integers(0, 2, (200, 9)).astype(np.int16)
    s = substring_dedup.Suffixes(rows)
    assert [tuple(x) for x in rows[s.order]] == sorted(tuple(x) for x in rows)
    for depth in (1, 4, 9):
        got = s.intervals(depth)
        assert len(set(got)) == len({tuple(x[:depth]) for x in rows})


def test_bpe(spark, corpus):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    known = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    rows = corpus + [(1, "<|endoftext|> 'tis"), (2, " " * 500), (4, "é" * 700 + "漢字🎉\u2003\n\n x")] + [(50 + n, "".join(r.choice("abcdetnrs") for _ in range(n))) for n in (1, 2, 63, 64, 65, 3000)]
    got = byte_bpe.encode_documents(clashing(frame(spark, rows)), path, public.PATTERN).collect()
    want = []
    for i, t in rows:
        ids = known.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(t or "")))
    same(got, want)
    assert byte_bpe.encode_documents(frame(spark, []), path, public.PATTERN).count() == 0


def test_near_dedup(spark, corpus):
    got = near_dedup.components_of(clashing(frame(spark, corpus)))
    want = brute.near(corpus)
    same(got.select("doc_id", "n_shingles", "component_id", "kept").collect(), want)
    docs = clashing(frame(spark, corpus))
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert {q["doc_id"] for q in kept.collect()} == {i for i, _, _, k in want if k} - {i for i, _, _, k in want if not k}


def test_near_dedup_of_a_chain(spark):
    """Each text is close to the next only: the rounds must find what the first centre does not reach."""
    base = WORDS[:100]
    rows = [(i, " ".join([*(WORDS[100 + j] for j in range(i)), *base[i:]])) for i in range(40)] + [(99, "")]
    got = near_dedup.components_of(frame(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    same(got, brute.near(rows))
    assert near_dedup.components_of(frame(spark, [])).count() == 0


def test_near_dedup_of_repeated_ids(spark):
    """Of two texts with one doc_id, one goes as a copy and the other stays for its group."""
    a, b = " ".join(WORDS[:30]), " ".join(WORDS[50:90])
    rows = [(3, a), (5, a), (5, b), (9, b), (5, b), (None, a)]
    kept = near_dedup.keep_one(frame(spark, rows)).select("doc_id", "text").collect()
    same(kept, [r for r, n in zip(rows, brute.near(rows)) if n[3]])
    assert (5, b) in [tuple(q) for q in kept] and (5, a) not in [tuple(q) for q in kept]


def test_near_dedup_at_80(spark):
    """Pairs between 0.80 and 0.85 are linked at 80, as in the pipeline, and not at 85."""
    r = random.Random(8)
    rows = []
    for c, swaps in enumerate([0, 1, 2, 2, 3, 3, 4, 5]):
        doc = [r.choice(WORDS) for _ in range(150)]
        other = list(doc)
        for j in range(swaps):
            other[10 + 25 * j] = "swapped"
        rows += [(10 * c, " ".join(doc)), (10 * c + 1, " ".join(other))]
    docs = frame(spark, rows)
    least = {s: [i for i, _, _, k in brute.near(rows, s) if k] for s in (80, 85)}
    assert len(least[80]) < len(least[85])
    for s in (80, 85):
        got = near_dedup.components_of(docs, similar=s).select("doc_id", "n_shingles", "component_id", "kept").collect()
        same(got, brute.near(rows, s))
    assert sorted(q["doc_id"] for q in corpus_pipeline.near_stage(spark, docs, "").collect()) == least[80]


def test_components_with_hubs(spark, monkeypatch):
    """Nodes with many neighbours are dealt to several tasks, and the result is the same."""
    monkeypatch.setattr(components, "HUB", 5)
    r = random.Random(9)
    edges = [(1000, i) for i in range(300)] + [(i, 2000 + i) for i in range(0, 300, 7)] + [(5000 + r.randrange(90), 5000 + r.randrange(90)) for _ in range(60)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {q["u"]: q["v"] for q in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_components(spark):
    edges = [(i + 1, i) for i in range(60)] + [(100, 200), (200, 150), (-5, -9)]
    got = {r["u"]: r["v"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 150: 100, 200: 100, -5: -9}


def test_secrets(spark):
    token = "ghp_" + "Z" * 30
    import zlib

    n, check = zlib.crc32(b"Z" * 30), ""
    while n:
        n, d = divmod(n, 62)
        check = secret_scan.BASE62[d] + check
    token += check.rjust(6, "0")
    rows = [(1, None), (2, ""), (3, 'é PassWord = "abc123" token:short SECRET:=x'), (4, "AKIA" + "Z9" * 8 + " AKIA12"), (5, "g" + "0123456789abcdef" * 2 + "G ſecret=abcdefgh"), (6, f"x {token} {token[:-1]}_"), (7, "4111 1111 1111 1111 and 4111 1111 1111 1112"), (8, "GB82WEST12345698765432 GB82WEST12345698765431"), (3, "api_key=a.b-c/d apikey: 'qwerty12'"), (9, "tokentoken=token=abcdef")]
    got = secret_scan.scan_documents(clashing(frame(spark, rows))).collect()
    by = {q["doc_id"]: q for q in got if q["doc_id"] != 3}
    assert by[1]["base_sha256"] == by[2]["base_sha256"] == brute.sha("") and by[1]["spans"] == ""
    assert by[4]["spans"] == "access:0:20" and by[5]["spans"] == "hex:1:33"
    assert by[6]["spans"] == "github:2:42" and by[7]["spans"] == "card:0:19" and by[8]["spans"] == "iban:0:22"
    assert by[9]["spans"] == "assign:5:23" and by[9]["n_assign"] == 1
    assert sorted(q["spans"] for q in got if q["doc_id"] == 3) == ["assign:0:15,assign:16:33", "assign:2:20"]
    assert secret_scan.scan_documents(frame(spark, [])).count() == 0
    card = [*"411111111111111", "1"]
    assert secret_scan.scan(" ".join(card), secret_scan.automaton()) == [(0, secret_scan.KINDS.index("card"), 31)]


def test_cards_and_ibans_beside_other_characters():
    keywords = secret_scan.automaton()
    found = lambda text: [(secret_scan.KINDS[k], text[a:b]) for a, k, b in secret_scan.scan(text, keywords)]
    assert found("MT86MALT01100ABCDEFGHIJKLMNOPQR") == [("iban", "MT86MALT01100ABCDEFGHIJKLMNOPQR")]
    assert found("20 4111111111111111") == [("card", "4111111111111111")]
    assert found("1 4111 1111 1111 1111 22") == [("card", "4111 1111 1111 1111")]
    assert found("94111111111111111") == [] == found("0" * 16)

    def plain(text):
        """Every start and length, leftmost and then longest."""
        out, at = [], 0
        while at < len(text):
            for end in range(min(len(text), at + 37), at, -1):
                t = text[at:end]
                n = sum(c.isdigit() for c in t)
                whole = (at == 0 or not text[at - 1].isdigit()) and (end == len(text) or not text[end].isdigit())
                if t[0].isdigit() and t[-1].isdigit() and 13 <= n <= 19 and whole and re.fullmatch("[0-9](?:[ -]?[0-9])*", t) and secret_scan.luhn_ok(re.sub("[ -]", "", t)):
                    out.append((at, end))
                    at = end - 1
                    break
            at += 1
        return out

    r, total = random.Random(8), 0
    for _ in range(600):
        text = "".join(r.choice(["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "12", "7", " ", " ", "-", "x", "  ", "340000000000009"]) for _ in range(r.randrange(12)))
        assert list(secret_scan.cards(text)) == plain(text)
        total += len(plain(text))
    assert total > 300


def test_secrets_against_plain_patterns():
    """Base spans of random texts, against each pattern searched over the whole text."""
    r = random.Random(11)
    parts = ["password", "PASSWD", "secret", "toKen", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "akia", "Z9", "A1B2C3", "0123456789abcdef", "deadbeef", "x", "é", "\n", "ſ", "K", "abc123", "/+_.=-"]
    plain = {"assign": re.compile(secret_scan.ASSIGN, re.I | re.A), "access": re.compile(secret_scan.ACCESS), "hex": re.compile(secret_scan.HEX)}
    keywords = secret_scan.automaton()
    found = 0
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(40)))
        want = []
        for k, (kind, pattern) in enumerate(plain.items()):
            for m in pattern.finditer(text):
                if (len(m[2]) >= 6) if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24):
                    want.append((m.start(), k, m.end()))
        assert [x for x in secret_scan.scan(text, keywords) if x[1] < 3] == sorted(want)
        found += len(want)
    assert found > 500


def test_decontamination(spark, corpus):
    items = [("b", " ".join(WORDS[:20])), ("a", " ".join(WORDS[5:20])), ("short", "one two"), (None, "x"), ("e", ""), ("n", None), ("b", "line two é")]
    rows = corpus + [(600, "zz " * 5 + " ".join(WORDS[2:18]).upper()), (601, " ".join(WORDS[:13] * 2)), (602, " ".join(WORDS[:12])), (603, "one, two! " + "w " * 100), (604, "É one")]
    docs, it = clashing(frame(spark, rows)), spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.judge(docs, it)
    want = brute.contamination(rows, items)
    same(got.collect(), want)
    left = decontaminate.clean(docs, it)
    whole = brute.whole_windows(rows, items)
    assert left.columns == docs.columns and left.count() == sum(not (w[-1] or x) for w, x in zip(want, whole))
    assert decontaminate.judge(docs.limit(0), it).count() == 0
    assert decontaminate.judge(docs, it.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_of_long_texts(spark, monkeypatch):
    """Passages at and across the borders of stretches, in texts so long that the passage is a small share; and without a filter of words."""
    monkeypatch.setattr(decontaminate, "STRETCH", 50)
    r = random.Random(6)
    words = [f"w{i:03d}" for i in range(200)]
    items = [("p", " ".join(words[:15])), ("q", words[3]), ("r", " ".join(words[3:5]))]
    rows = [(i, " ".join([*(r.choice(words) for _ in range(at)), *words[: 15 if i % 3 else 12], "other", *(r.choice(words) for _ in range(3000))])) for i, at in enumerate([0, 30, 36, 37, 38, 49, 50, 51, 99, 700])]
    docs, it = frame(spark, rows).withColumns({"_dc_n": F.lit(7), "_row": F.lit("r"), "_dc_bad": F.lit(1)}), spark.createDataFrame(items, "item_id string, text string")
    want = brute.contamination(rows, items)
    for sent in (decontaminate.SENT, -1):
        monkeypatch.setattr(decontaminate, "SENT", sent)
        same(decontaminate.judge(docs, it).collect(), want)
    left = decontaminate.clean(docs, it).collect()
    assert not any(w[-1] for w in want)
    assert sorted(q["doc_id"] for q in left) == [i for (i, _), x in zip(rows, brute.whole_windows(rows, items)) if not x] == [0, 3, 6, 9]
    assert {(q["_dc_n"], q["_row"], q["_dc_bad"]) for q in left} == {(7, "r", 1)}
