"""Line dedup: a suffix array over line ids by distributed prefix doubling, in DataFrame functions only.

A line goes if it lies in a run of lines of at least min_chars characters that occurs at an earlier place too, by doc_id
and line: line feeds and all; shorter runs (a heading, a bare licence line) stay.

Texts are split at line feeds; a line's id is 128 bits of hash. Level k ranks the runs of k lines that start at each
position. A run of 2k lines is the pair (rank at p, rank at p + k), and the sorted pairs get the ranks of level 2k.
A position whose run occurs once leaves: no longer run of it can repeat.

Whether a line goes is told by least runs: from each line, and back from each line, the fewest lines that have min_chars
characters. Each line of a longer repeated run is in a least run inside it (forward from itself or, too near the end,
back from itself, or else in the one that starts the run), and a least run goes or stays as a whole. A run of m
lines, k <= m < 2k, is known by m and the ranks of level k at its two ends, which overlap. So levels go up to
the longest least run, and each least run is looked up in one level. Where several are equal, all but the first go.

All shuffles carry hashes, ranks and places, never text, but for the last join, which takes the runs to their texts.
Ranks come from groups that are summed before the shuffle, and join back as an ordinary equi-join, which the
adaptive planner splits where one line is very common.

Defined results: null text has no lines and stays null; empty lines are lines of no characters; rows equal in doc_id
and text are one document, and each gets its result; a null doc_id comes last; ties in doc_id go by the text's hash;
an empty table gives an empty result. Extra columns are kept, whatever their names; the figures are one struct column, which
takes the place of a column of its name. A very long text is one row of lines; its stretches are windows over its own lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, stash

MIN_CHARS = 100
PLACE = ["_ld_null", "_ld_doc", "_ld_k1", "_ld_k2", "_ld_pos"]
DOC = PLACE[:-1]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row as _ld_row, its key and its text."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_ld_row"),
        F.col(f"`{id_col}`").isNull().alias("_ld_null"),
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0)).alias("_ld_doc"),
        F.coalesce(F.xxhash64(text), F.lit(0)).alias("_ld_k1"),
        F.coalesce(F.xxhash64(F.lit("second"), text), F.lit(0)).alias("_ld_k2"),
        text.alias("_ld_text"),
    )


def _ranked(groups: DataFrame, by: list[str]) -> DataFrame:
    """Ranks in the order of the keys: after a range sort, the running id grows with them. Written, as it hangs on the partitioning."""
    return stash(groups.orderBy(*by).withColumn("_ld_rank", F.monotonically_increasing_id()), "line-ranks")


def _least_runs(active: DataFrame, min_chars: int) -> DataFrame:
    """Start and number of lines (m) of the least runs of min_chars characters, within stretches of lines that all repeat."""
    w = Window.partitionBy(*DOC).orderBy("_ld_pos")
    isle = active.select(*PLACE, "_ld_chars").withColumn("_ld_isle", F.col("_ld_pos") - F.row_number().over(w)).withColumn("_ld_after", F.lead("_ld_pos").over(w))
    # A stretch of n lines has n + 1 borders, with the characters before each.
    here = F.struct(F.col("_ld_pos").alias("pos"), F.col("_ld_chars").alias("chars"))
    end = F.struct((F.col("_ld_pos") + 1).alias("pos"), F.lit(0).alias("chars"))
    borders = isle.withColumn("_ld_b", F.explode(F.when(F.col("_ld_after") == F.col("_ld_pos") + 1, F.array(here)).otherwise(F.array(here, end))))
    by = [*DOC, "_ld_isle"]
    up_to = Window.partitionBy(*by).orderBy("_ld_pos").rowsBetween(Window.unboundedPreceding, -1)
    summed = borders.select(*by, F.col("_ld_b.pos").alias("_ld_pos"), F.col("_ld_b.chars").cast("long").alias("_ld_chars")).withColumn("_ld_sum", F.coalesce(F.sum("_ld_chars").over(up_to), F.lit(0).cast("long")))
    long_enough = F.max("_ld_sum").over(Window.partitionBy(*by)) >= min_chars
    far = [Window.partitionBy(*by).orderBy(o).rangeBetween(Window.unboundedPreceding, -min_chars) for o in (F.desc("_ld_sum"), F.asc("_ld_sum"))]
    found = summed.withColumn("_ld_some", long_enough).where("_ld_some").withColumn("_ld_until", F.min("_ld_pos").over(far[0])).withColumn("_ld_from", F.max("_ld_pos").over(far[1]))
    runs = F.array(F.struct(F.col("_ld_pos").alias("p"), (F.col("_ld_until") - F.col("_ld_pos")).alias("m")), F.struct(F.col("_ld_from").alias("p"), (F.col("_ld_pos") - F.col("_ld_from")).alias("m")))
    return found.select(*DOC, F.explode(runs).alias("_ld_run")).where("_ld_run.m > 0").select(*DOC, F.col("_ld_run.p").alias("_ld_pos"), F.col("_ld_run.m").alias("_ld_m")).distinct()


def repeated_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each maximal stretch of lines that go: the document's key, from and until (lines)."""
    keyed = _keyed(docs.select(id_col, text_col), id_col, text_col)
    split = keyed.where("_ld_text is not null").select(*DOC, F.posexplode(F.split("_ld_text", "\n", -1)).alias("_ld_pos", "_ld_line"))
    ids = {"_ld_h1": F.xxhash64("_ld_line"), "_ld_h2": F.xxhash64(F.lit("second"), F.col("_ld_line")), "_ld_chars": F.length("_ld_line")}
    lines = stash(split.select(*PLACE, *(c.alias(n) for n, c in ids.items())).dropDuplicates(PLACE), "lines")

    # Level 1: ranks of lines that repeat.
    place = F.struct(*PLACE)
    groups = _ranked(lines.groupBy("_ld_h1", "_ld_h2").agg(F.count(F.lit(1)).alias("_ld_n")).where("_ld_n > 1").drop("_ld_n"), ["_ld_h1", "_ld_h2"])
    active = stash(lines.join(groups, ["_ld_h1", "_ld_h2"]).select(*PLACE, "_ld_rank", "_ld_chars"), "line-level")
    least = stash(_least_runs(active, min_chars), "least-runs")
    longest = least.agg(F.coalesce(F.max("_ld_m"), F.lit(0))).first()[0]
    found, used, k = None, [lines, groups, active, least], 1
    while True:
        ends = [active.select(*DOC, (F.col("_ld_pos") + k - F.lit(back)).alias("_ld_pos"), F.col("_ld_rank").alias(name)) for back, name in ((k, "_ld_r1"), (0, "_ld_r2"))]
        # r2 is found by where its window ends, which is where the run ends.
        level = least.where((F.col("_ld_m") >= k) & (F.col("_ld_m") < 2 * k))
        known = level.join(ends[0], PLACE).withColumn("_ld_from", F.col("_ld_pos")).withColumn("_ld_pos", F.col("_ld_from") + F.col("_ld_m")).join(ends[1], PLACE)
        known = stash(known.select(*DOC, F.col("_ld_from").alias("_ld_pos"), "_ld_m", "_ld_r1", "_ld_r2"), "level-runs")
        first = known.groupBy("_ld_m", "_ld_r1", "_ld_r2").agg(F.count(F.lit(1)).alias("_ld_n"), F.min(place).alias("_ld_first")).where("_ld_n > 1").drop("_ld_n")
        later = known.join(first, ["_ld_m", "_ld_r1", "_ld_r2"]).where(place > F.col("_ld_first")).select(*DOC, F.col("_ld_pos").alias("_ld_from"), (F.col("_ld_pos") + F.col("_ld_m")).alias("_ld_until"))
        found = later if found is None else found.unionByName(later)
        used.append(known)
        if 2 * k > longest:
            break
        ahead = active.select(*DOC, (F.col("_ld_pos") - k).alias("_ld_pos"), F.col("_ld_rank").alias("_ld_next"))
        pairs = active.join(ahead, PLACE)
        again = pairs.groupBy("_ld_rank", "_ld_next").agg(F.count(F.lit(1)).alias("_ld_n")).where("_ld_n > 1").drop("_ld_n")
        ranks = _ranked(again.withColumnRenamed("_ld_rank", "_ld_r"), ["_ld_r", "_ld_next"])
        used.append(ranks)
        if ranks.isEmpty():
            break
        active = stash(pairs.join(ranks.select(F.col("_ld_r").alias("_ld_rank"), "_ld_next", F.col("_ld_rank").alias("_ld_new")), ["_ld_rank", "_ld_next"]).select(*PLACE, F.col("_ld_new").alias("_ld_rank")), "line-level")
        used.append(active)
        k *= 2
    w = Window.partitionBy(*DOC).orderBy("_ld_from", "_ld_until")
    before = F.max("_ld_until").over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = stash(
        found.withColumn("_ld_new", (F.coalesce(before, F.lit(-1)) < F.col("_ld_from")).cast("int"))
        .withColumn("_ld_run", F.sum("_ld_new").over(w))
        .groupBy(*DOC, "_ld_run")
        .agg(F.min("_ld_from").alias("_ld_from"), F.max("_ld_until").alias("_ld_until"))
        .drop("_ld_run"),
        "line-merged",
    )
    drop(*used)
    return out


def delete_later_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, figures: str = "line_figures") -> DataFrame:
    """Every row with what is left of its text, and a struct column: n_lines, n_removed (lines) and n_runs."""
    runs = repeated_runs(docs, id_col=id_col, text_col=text_col, min_chars=min_chars)
    per_doc = runs.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct(F.col("_ld_from").alias("a"), F.col("_ld_until").alias("b")))).alias("_ld_runs"))
    lines = F.split("_ld_text", "\n", -1)
    runs_of = F.coalesce("_ld_runs", F.array().cast("array<struct<a:int,b:int>>"))
    # The stretches between the runs; each is a slice of the lines.
    kept = F.filter(
        F.transform(F.sequence(F.lit(0), F.size("_ld_runs")), lambda i: F.struct(F.when(i == 0, 0).otherwise(F.element_at("_ld_runs", i)["b"]).alias("a"), F.when(i == F.size("_ld_runs"), F.size("_ld_lines")).otherwise(F.element_at("_ld_runs", i + 1)["a"]).alias("b"))),
        lambda x: x["a"] < x["b"],
    )
    # Merged whatever the size: a plan that changes with it would grow in steps.
    joined = _keyed(docs, id_col, text_col).join(per_doc.hint("merge"), DOC, "left").withColumn("_ld_lines", F.when(F.col("_ld_runs").isNotNull(), lines))
    text = F.when(F.col("_ld_runs").isNull(), F.col("_ld_text")).otherwise(F.array_join(F.transform(kept, lambda x: F.array_join(F.slice("_ld_lines", x["a"] + 1, x["b"] - x["a"]), "\n")), "\n"))
    n_lines = F.when(F.col("_ld_text").isNull(), 0).otherwise(F.length("_ld_text") - F.length(F.replace("_ld_text", F.lit("\n"), F.lit(""))) + 1)
    told = F.struct(n_lines.cast("long").alias("n_lines"), F.aggregate(runs_of, F.lit(0), lambda s, r: s + r["b"] - r["a"]).cast("long").alias("n_removed"), F.size(runs_of).cast("long").alias("n_runs"))
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"_ld_row.`{c}`") for c in docs.columns if c != figures], told.alias(figures))
