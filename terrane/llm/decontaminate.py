"""Benchmark decontamination: a prefix-filtered set join, in DataFrame functions only.

A window is WINDOW consecutive words of an item (or the whole of a shorter one). A document must hold all words of a
window that occurs in it, so of a window's words in the order of rarity a prefix of one word is enough: the word
that fewest documents have. Rarity is counted over the whole corpus, among the benchmark's words. Only places of
these rarest words are candidates; the word's place in its window and the document's length bound where the window
can lie (positional and length filter); and each candidate is verified word for word on the document.

Word counts are summed in tasks before their shuffle, so a frequent word costs one row a task. The benchmark's words go to
all tasks as a filter where they take SENT bytes at most, as counted; beyond, the sums meet them in a sort-merge join.
Places that hold no rarest word leave before anything is shuffled by document. A text with candidates is split once for
each stretch of STRETCH words that holds some, so that no row holds all candidates of a very long text.

clean drops more than judge calls contaminated: also every document with a whole window of WINDOW words, however long
the document is, as a passage is a passage. Windows of shorter items (down to one common word) tell by their share alone.

Defined results: null text has no words; such documents, and empty ones, are not contaminated; items without words
have no windows; items that share a window all count; rows equal in doc_id and text are one document, and each gets
its result; rows with one item_id each give their windows to it, and a null item_id is written as an empty string;
an empty table gives no hits. Extra columns are ignored by judge, and kept by clean, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import ascii_lower, drop, stash

WINDOW = 13
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["_dc_null", "_dc_doc", "_dc_k1", "_dc_k2"]
STRETCH = 1 << 18  # words; candidates are gathered by stretches of a document
SENT = 8 << 20  # bytes of words that may travel to all tasks


def words_of(text: Column) -> Column:
    """Lower-cased words; no text, no words."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def _windows(items: DataFrame, item_col: str) -> DataFrame:
    """_item, _window (its words): each window once an item."""
    lists = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("_item"), words_of(F.col("text").cast("string")).alias("_w")).where("size(_w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - WINDOW + 1, F.lit(1)))
    return lists.select("_item", F.explode(F.transform(starts, lambda i: F.slice("_w", i, WINDOW))).alias("_window")).distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    """The row as _row, its key and its text."""
    text = F.col("text").cast("string")
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col("doc_id").isNull().alias("_dc_null"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_dc_doc"),
        F.coalesce(F.xxhash64(text), F.lit(0)).alias("_dc_k1"),
        F.coalesce(F.xxhash64(F.lit("second"), text), F.lit(0)).alias("_dc_k2"),
        text.alias("_dc_text"),
    )


def _only(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Rows whose _word is among words, if these may travel; else all rows, for the join that follows to tell."""
    size = words.agg(F.coalesce(F.sum(F.octet_length("_word") + 16), F.lit(0))).first()[0]
    return rows.join(F.broadcast(words), "_word", "left_semi") if size <= SENT else rows


def occurrences(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Key of a document, start (a word's place, from 0) and window, for each occurrence. windows: _window, distinct."""
    keyed = _keyed(docs.select("doc_id", "text")).select(*KEY, "_dc_text")
    split = keyed.select(*KEY, words_of(F.col("_dc_text")).alias("_words"))
    vocabulary = stash(windows.select(F.explode("_window").alias("_word")).distinct(), "benchmark-words")
    summed = _only(split.select(F.explode("_words").alias("_word")), vocabulary).groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))
    rarity = stash(summed.join(vocabulary, "_word", "left_semi"), "word-rarity")

    # The prefix of a window: its rarest word. A window with a word that no document has is nowhere.
    spread = windows.select("_window", F.posexplode("_window").alias("_at", "_word")).dropDuplicates(["_window", "_word"])
    prefixes = stash(
        spread.join(rarity, "_word", "left")
        .groupBy("_window")
        .agg(F.min(F.struct(F.col("_n").alias("n"), F.col("_word").alias("word"), F.col("_at").alias("at"))).alias("_r"), F.count("_n").alias("_there"), F.count(F.lit(1)).alias("_all"))
        .where("_there = _all")
        .select("_window", F.col("_r.word").alias("_word"), F.col("_r.at").alias("_at")),
        "window-prefixes",
    )
    # Places of prefix words; where the window would lie must be inside the document.
    places = _only(split.select(*KEY, F.size("_words").alias("_len"), F.posexplode("_words").alias("_pos", "_word")), prefixes.select("_word").distinct())
    candidates = (
        places.join(prefixes, "_word")
        .where((F.col("_pos") >= F.col("_at")) & (F.col("_pos") - F.col("_at") + F.size("_window") <= F.col("_len")))
        .select(*KEY, (F.col("_pos") - F.col("_at")).alias("_start"), "_window")
    )
    # Candidates of a stretch meet the text of their document, which moves as text and is split once for all of them.
    by_stretch = stash(candidates.groupBy(*KEY, F.floor(F.col("_start") / STRETCH).alias("_stretch")).agg(F.collect_set(F.struct("_start", "_window")).alias("_c")), "window-candidates")
    found = (
        by_stretch.join(keyed, KEY)
        .withColumn("_words", words_of(F.col("_dc_text")))
        .select(*KEY, F.explode(F.filter("_c", lambda c: F.slice(F.col("_words"), c["_start"] + 1, F.size(c["_window"])) == c["_window"])).alias("_h"))
        .select(*KEY, "_h._start", "_h._window")
    )
    out = stash(found.distinct(), "window-hits")
    drop(vocabulary, rarity, prefixes, by_stretch)
    return out


def figures(docs: DataFrame, items: DataFrame, item_col: str = "item_id") -> DataFrame:
    """For each document with hits: its key, n_hit, whether a hit is WINDOW words long, n_items, items_sha256."""
    owned = stash(_windows(items, item_col), "benchmark-windows")
    hits = occurrences(docs, owned.select("_window").distinct())
    w = Window.partitionBy(*KEY).orderBy("_start", "_end")
    covered = (
        hits.select(*KEY, "_start", (F.col("_start") + F.size("_window")).alias("_end"))
        .withColumn("_before", F.coalesce(F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .groupBy(*KEY)
        .agg(F.sum(F.greatest(F.col("_end") - F.greatest("_start", "_before"), F.lit(0))).alias("n_hit"), (F.max(F.col("_end") - F.col("_start")) >= WINDOW).alias("whole"))
    )
    of_items = (
        hits.select(*KEY, "_window").distinct().join(owned, "_window").groupBy(*KEY).agg(F.array_sort(F.collect_set("_item")).alias("_items"))
        .select(*KEY, F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"))
    )
    return covered.join(of_items, KEY)


def _judged(docs: DataFrame, items: DataFrame, item_col: str) -> DataFrame:
    keyed = _keyed(docs).withColumn("_dc_n", F.size(words_of(F.col("_dc_text"))).cast("long")).drop("_dc_text")
    hit = F.coalesce("_dc_f.n_hit", F.lit(0))
    found = figures(docs, items, item_col).select(*KEY, F.struct("n_hit", "whole", "n_items", "items_sha256").alias("_dc_f"))
    return keyed.join(found, KEY, "left").withColumn("_dc_bad", (hit > 0) & (20 * hit >= F.col("_dc_n")))


def judge(docs: DataFrame, items: DataFrame, *, item_col: str = "item_id") -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return _judged(docs.select("doc_id", "text"), items, item_col).select(
        F.col("_row.doc_id").cast("long").alias("doc_id"),
        F.col("_dc_n").alias("n_words"),
        F.coalesce("_dc_f.n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("_dc_f.n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("_dc_f.items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("_dc_bad").alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, *, item_col: str = "item_id") -> DataFrame:
    """The rows of documents that are not contaminated and hold no whole window of WINDOW words, with all their columns."""
    return _judged(docs, items, item_col).where(~F.col("_dc_bad") & ~F.coalesce("_dc_f.whole", F.lit(False))).select(*[F.col(f"_row.`{c}`") for c in docs.columns])
