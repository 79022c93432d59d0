"""Quality classifier by co-training: two views label for each other, then score every document together.

The text view sees which words, beginnings of words and punctuation marks a document has (hashed). The metadata view sees its language,
source, length and layout (line, letter-case, punctuation and repetition figures), but no words. Each view fits one
logistic model for quality and one for toxicity. In each round, each view labels the unlabelled documents of which
it is most sure for the other view. At the end both views are calibrated and combined on labelled documents held
back from the fit. A document is kept if its quality is likelier than not and its toxicity is not.

Fitting is bounded: MAX_LABELLED labelled and MAX_UNLABELLED other documents, taken in the order of a hash of their
id, with a hashed vocabulary of 2**BITS. Scoring reads every whole text, once, without a shuffle.

Defined results: null text is empty text; null language, source or length are values of their own; a document whose
label is null or not 0 or 1 counts as unlabelled; labels that disagree count as low quality and toxic; without
labelled documents of both classes, a model returns the class that it knows (quality 1, toxicity 0 for none); rows
that repeat are each scored, and of rows with one doc_id the fit takes the least (by text, then language, source, length); an empty table gives an empty result. Extra columns are passed on by filter_documents
and ignored by score_documents.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import column_or_null

MAX_LABELLED, MAX_UNLABELLED, BITS = 10_000, 5_000, 20
ROUNDS, PER_ROUND, SURE = 3, 400, 0.95
CHOSEN, SIGNIFICANT = 3000, 4.0  # words that a text model may weigh: how many, and how many standard deviations apart the classes are
STEMS = (4, 5, 6)  # bytes
LANGS, SOURCES, BINS = 16, 64, 10

SCHEMA = "doc_id long, p_quality double, p_toxic double, score double, keep boolean"

_tokens = re.compile(rb"[a-z\x80-\xff]+|[^a-z0-9\s\x80-\xff]+").findall
# Fixed classes of bytes: space, line end, digit, upper case, lower case, beyond ASCII, other.
_class = np.full(256, 6, np.uint8)
_class[list(b" \t")] = 0
_class[list(b"\n\r")] = 1
_class[48:58], _class[65:91], _class[97:123], _class[128:] = 2, 3, 4, 5
N_FIGURES = 9


def features(text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, and the metadata figures with the places of language and source at the end."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    tokens = _tokens(raw.lower())
    seen = set(tokens)
    # A word's beginnings count too, marked by the line feed that no token holds: endings vary where stems do not.
    parts = {t[:m] + b"\n" for t in seen for m in STEMS if len(t) >= m}
    words = np.unique(np.fromiter((zlib.crc32(t) & ((1 << BITS) - 1) for t in (*seen, *parts)), np.int32, len(seen) + len(parts)))
    n, k = max(1, len(raw)), max(1, len(tokens))
    c = np.bincount(_class[np.frombuffer(raw, np.uint8)], minlength=7)
    figures = [math.log1p(n_chars if n_chars is not None and n_chars >= 0 else 0), math.log1p(len(raw)), c[1] / n, c[2] / n, c[3] / n, c[6] / n, (c[4] + c[5]) / n, len(seen) / k, len(raw) / k]
    places = [zlib.crc32((lang or "").encode()) % LANGS, LANGS + zlib.crc32((source or "").encode()) % SOURCES]
    return words, np.array([*figures, *places], np.float32)


class Linear:
    """Logistic model over sparse rows (lists of places, each of value 1)."""

    def __init__(self, size: int):
        self.w, self.b = np.zeros(size, np.float32), 0.0

    def fit(self, rows: list[np.ndarray], y: np.ndarray, l2: float = 2e-5, steps: int = 150, choose: int = 0) -> None:
        pos, n = float(y.sum()), len(y)
        if pos in (0, n):  # one class only, or none
            self.w[:] = 0
            self.b = 0.0 if not n else 30.0 if pos else -30.0
            return
        if choose:
            # Counted by row: a flat list of all rows' words would take most of the driver's memory.
            df, df1 = np.zeros(len(self.w)), np.zeros(len(self.w))
            for r, label in zip(rows, y):  # no word twice in a row
                df[r] += 1
                df1[r] += label
            p = (df + 1) / (n + 2)
            z = np.abs(df1 / pos - (df - df1) / (n - pos)) / np.sqrt(p * (1 - p) * (1 / pos + 1 / (n - pos)))
            z[df < 5] = 0
            best = np.argsort(-z)[:choose]
            best = np.sort(best[z[best] > SIGNIFICANT])
            place = np.full(len(self.w), -1, np.int32)
            place[best] = np.arange(len(best))
            rows = [p[p >= 0] for p in (place[r] for r in rows)]
        else:
            best = np.arange(len(self.w))
        at = np.concatenate(rows)
        row = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
        w, b = np.zeros(len(best)), math.log(pos / (n - pos))
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for t in range(1, steps + 1):
            g = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at], n) + b, -30, 30))) - y
            gw, gb = np.bincount(at, g[row], len(w)) / n + l2 * w, g.mean()
            m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            c1, c2 = 1 - 0.9**t, 1 - 0.99**t
            w -= 0.1 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
            b -= 0.1 * (mb / c1) / (math.sqrt(vb / c2) + 1e-8)
        self.w[:] = 0
        self.w[best], self.b = w, b

    def margin(self, row: np.ndarray) -> float:
        return float(self.w[row].sum()) + self.b


def _combine(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the two margins and a constant: both views' calibration and their combination. Newton steps, halved until they help."""
    prior = np.array([0.5, 0.5, 0.0])
    if len(set(y.tolist())) < 2:
        return prior
    x, w = np.c_[np.clip(z, -30, 30), np.ones(len(z))], prior

    def loss(w: np.ndarray) -> float:
        m = np.clip(x @ w, -500, 500)
        return float((np.logaddexp(0, m) - y * m).sum() + 0.5 * ((w - prior) ** 2).sum())

    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(3), x.T @ (p - y) + w - prior)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-6:
            step = step / 2
        w = w - step
    if w[0] < 0 or w[1] < 0:  # a view that says the reverse of what it learned is no help
        best = int(np.argmax(w[:2]))
        w = np.array([float(best == 0), float(best == 1), 0.0])
    return w


class CoTrained:
    """Both views' models for quality and toxicity, and how their margins combine."""

    def __init__(self, words: list[np.ndarray], figures: np.ndarray, labels: np.ndarray):
        """labels: quality and toxic, nan where unknown."""
        self.cuts = np.quantile(figures[:, :N_FIGURES], np.linspace(0, 1, BINS + 1)[1:-1], axis=0) if len(figures) else np.zeros((BINS - 1, N_FIGURES))
        places = [self.places(f) for f in figures]
        size = N_FIGURES * BINS + LANGS + SOURCES
        self.parts = []
        for k in (0, 1):
            known = ~np.isnan(labels[:, k]) if len(labels) else np.zeros(0, bool)
            mine, pool = np.flatnonzero(known), np.flatnonzero(~known)
            held = mine[::4]
            train = np.setdiff1d(mine, held)
            y = labels[:, k].copy() if len(labels) else np.zeros(0)
            views = [(Linear(1 << BITS), words, CHOSEN), (Linear(size), places, 0)]
            given: list[dict[int, float]] = [{}, {}]  # pseudo-labels for each view
            for turn in range(ROUNDS + 1):
                for v, (model, rows, choose) in enumerate(views):
                    ids = [*train.tolist(), *given[v]]
                    model.fit([rows[i] for i in ids], np.array([*y[train], *given[v].values()]), choose=choose)
                if turn == ROUNDS or not len(pool):
                    break
                for v, (model, rows, _) in enumerate(views):
                    p = 1 / (1 + np.exp(-np.clip([model.margin(rows[i]) for i in pool], -30, 30)))
                    for sign, sure in ((1.0, p), (0.0, 1 - p)):
                        best = [j for j in np.argsort(-sure)[: PER_ROUND * (turn + 1)] if sure[j] >= SURE]
                        for j in best:
                            given[1 - v].setdefault(int(pool[j]), sign)
            if len(held) >= 20:
                z = np.array([[m.margin(rows[i]) for m, rows, _ in views] for i in held])
                mix = _combine(z, y[held])
            else:
                mix = np.array([0.5, 0.5, 0.0])
            if not len(mine):
                mix = np.array([0.0, 0.0, 30.0 if k == 0 else -30.0])
            self.parts.append((views[0][0].w, views[0][0].b, views[1][0].w, views[1][0].b, mix))

    @classmethod
    def of(cls, cuts: np.ndarray, parts: list[tuple]) -> CoTrained:
        """A model fitted elsewhere."""
        model = cls.__new__(cls)
        model.cuts, model.parts = cuts, parts
        return model

    def places(self, figures: np.ndarray) -> np.ndarray:
        bins = (figures[None, :N_FIGURES] > self.cuts).sum(axis=0)
        return np.r_[np.arange(N_FIGURES) * BINS + bins, N_FIGURES * BINS + figures[N_FIGURES:].astype(int)]

    def score(self, words: np.ndarray, figures: np.ndarray) -> tuple[float, float]:
        places, out = self.places(figures), []
        for wt, bt, wm, bm, mix in self.parts:
            z = mix[0] * (float(wt[words].sum()) + bt) + mix[1] * (float(wm[places].sum()) + bm) + mix[2]
            out.append(1 / (1 + math.exp(-min(30.0, max(-30.0, z)))))
        return out[0], out[1]


def _columns(docs: DataFrame) -> list:
    return [column_or_null(docs, "text", "string").alias("_qc_text"), column_or_null(docs, "lang", "string").alias("_qc_lang"), column_or_null(docs, "source", "string").alias("_qc_source"), column_or_null(docs, "n_chars", "long").alias("_qc_n")]


def fit(docs: DataFrame, labels: DataFrame) -> CoTrained:
    """Fit on the bounded sample. Only ids are read to choose it; only its texts are read after."""
    known = (
        labels.where("doc_id is not null and quality in (0, 1) and toxic in (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.min("quality").cast("double").alias("_quality"), F.max("toxic").cast("double").alias("_toxic"))
    )
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_id"))
    order = [F.xxhash64("_id"), F.col("_id")]
    labelled = known.join(ids, "_id", "left_semi").orderBy(*order).limit(MAX_LABELLED)
    other = ids.join(known, "_id", "left_anti").dropDuplicates().orderBy(*order).limit(MAX_UNLABELLED).withColumns({"_quality": F.lit(None).cast("double"), "_toxic": F.lit(None).cast("double")})
    sample = F.broadcast(labelled.unionByName(other))  # MAX_LABELLED + MAX_UNLABELLED rows at most
    met = docs.select(F.col("doc_id").cast("long").alias("_id"), *_columns(docs)).join(sample, "_id")
    rows = met.groupBy("_id", "_quality", "_toxic").agg(F.min(F.struct("_qc_text", "_qc_lang", "_qc_source", "_qc_n")).alias("_qc")).select("_id", "_quality", "_toxic", "_qc.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(*x) for x in zip(*(b.column(c).to_pylist() for c in ("_qc_text", "_qc_lang", "_qc_source", "_qc_n")))]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_quality"), b.column("_toxic"), pa.array([w.tobytes() for w, _ in got], pa.binary()), pa.array([f.tobytes() for _, f in got], pa.binary())], names=["id", "quality", "toxic", "words", "figures"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known, words, figures = [], [], [], []
        for b in batches:
            ids += b.column("id").to_pylist()
            known += zip(b.column("quality").to_pylist(), b.column("toxic").to_pylist())
            words += [np.frombuffer(x.as_py(), np.int32) for x in b.column("words")]
            figures += [np.frombuffer(x.as_py(), np.float32) for x in b.column("figures")]
        turn = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i]))
        model = _learned([words[i] for i in turn], [figures[i] for i in turn], [known[i] for i in turn])
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps((model.cuts, model.parts)), 1)], pa.binary())], names=["model"])

    sampled = rows.mapInArrow(run, "id long, quality double, toxic double, words binary, figures binary")
    # The sample is bounded, so one task holds it; the driver gets nothing but the fitted weights.
    fitted = sampled.repartition(1).mapInArrow(learn, "model binary").first()
    return CoTrained.of(*pickle.loads(zlib.decompress(fitted["model"]))) if fitted else _learned([], [], [])


def _learned(words: list[np.ndarray], figures: list[np.ndarray], known: list[tuple[float | None, float | None]]) -> CoTrained:
    n = len(words)
    labels = np.array([[np.nan if v is None else v for v in pair] for pair in known], float).reshape(n, 2)
    return CoTrained(words, np.array(figures).reshape(n, N_FIGURES + 2), labels)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: both probabilities, their product as score, and whether to keep it."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.score(*features(*x)) for x in zip(*(b.column(c).to_pylist() for c in ("_qc_text", "_qc_lang", "_qc_source", "_qc_n")))]
            q, t = [x[0] for x in got], [x[1] for x in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(q, pa.float64()), pa.array(t, pa.float64()), pa.array([a * (1 - c) for a, c in got], pa.float64()), pa.array([a >= 0.5 and c < 0.5 for a, c in got], pa.bool_())], names=["doc_id", "p_quality", "p_toxic", "score", "keep"])

    return docs.select(F.col("doc_id").cast("long"), *_columns(docs)).mapInArrow(run, SCHEMA)


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that are kept, with all their columns."""
    model = fit(docs, labels)
    width = len(docs.columns)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.score(*features(*x)) for x in zip(*(b.column(width + i).to_pylist() for i in range(4)))]
            yield b.select(range(width)).filter(pa.array([q >= 0.5 and t < 0.5 for q, t in got], pa.bool_()))

    return docs.select("*", *_columns(docs)).mapInArrow(run, schema)
