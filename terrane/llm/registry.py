"""Queries of the training-data operators: each applies its operator to the whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, line_dedup, lm_score, manifest, near_dedup, neighbours, quality, secret_scan, sharding, substring_dedup, url_filters, vector_codes

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.delete_later_copies(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "line_figures.n_lines", "line_figures.n_removed", "line_figures.n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, verdict)")
    return url_filters.judge(_read(spark, sf_dir, "pages"), rules)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_read(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components_of(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(_read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_read(spark, sf_dir, "documents"), 8)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verify(_read(spark, sf_dir, "documents"), F.replace("text", F.lit("\n"), F.lit("")), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.with_label_errors(*vector_codes.compress(_read(spark, sf_dir, "embeddings")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_url_filters, op3_lm_scoring, op4_nearest_neighbours, op5_quality_classifier, op6_suffix_array_dedup, op7_byte_bpe, op8_minhash_near_dedup, op9_secret_scan, op10_decontamination, op11_sharding, op12_merkle_manifest, op13_vector_codes, pipeline)}



def _lloyd_sql(rounds: int = 4) -> str:
    """Rounds written out: a{r} assigns by b{r - 1}, b{r} has the means of a{r}."""
    near = "SELECT p.vec_id, p.part, any_value(p.x) AS x, arg_min(b.entry, (list_inner_product(b.c, b.c) - 2 * list_inner_product(p.x, b.c), b.entry)) AS entry FROM p JOIN b{b} b ON p.part = b.part GROUP BY 1, 2"
    steps = ""
    for r in range(1, rounds + 1):
        steps += f"""a{r} AS MATERIALIZED ({near.format(b=r - 1)}),
m{r} AS (SELECT part, entry, list(s ORDER BY i) AS c FROM (SELECT part, entry, i, floor(sum(x[i]) / count(*)) AS s FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{r} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{r - 1} b LEFT JOIN m{r} m ON m.part = b.part AND m.entry = b.entry),
"""
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS x FROM k, range(4) t(part)),
b0 AS MATERIALIZED (SELECT part, rn - 1 AS entry, x AS c FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS rn FROM p) WHERE rn <= 256),
{steps}l AS ({near.format(b=rounds)}),
e AS (SELECT l.vec_id, string_agg(format('{{:02x}}', l.entry), '' ORDER BY l.part) AS code,
 CAST(sum(list_inner_product(l.x, l.x) - 2 * list_inner_product(l.x, b.c) + list_inner_product(b.c, b.c)) AS BIGINT) AS error
 FROM l JOIN b{rounds} b ON b.part = l.part AND b.entry = l.entry GROUP BY 1),
h AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(c) AS x, unnest(range(len(c))) AS i FROM b{rounds}))
SELECT e.vec_id, e.code, e.error, CAST(sum(e.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.codebooks_sha256 FROM e JOIN k ON k.vec_id = e.vec_id, h
"""


def _merkle_sql() -> str:
    told = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || {x} END"
    leaf = lambda text: "sha256(" + " || ".join(map(told, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    # CRC-32, a bit at a time; its polynomial is 3988292384.
    crc = "xor(list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT)), lambda c, b: list_reduce(range(8), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)), xor(c, b)), 4294967295), 4294967295)"
    levels = "SELECT grp, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {t}) WHERE n > 1 GROUP BY grp, level, pos // 3"
    path = """SELECT l.key, n.level, coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos < l.place // CAST(pow(3, n.level) AS BIGINT)), '') AS b,
 coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos > l.place // CAST(pow(3, n.level) AS BIGINT)), '') AS a
 FROM {l} l JOIN (SELECT *, max(level) OVER (PARTITION BY grp) AS top FROM {n}) n ON n.grp = l.grp AND n.level < n.top AND n.pos // 3 = l.place // CAST(pow(3, n.level + 1) AS BIGINT) GROUP BY 1, 2"""
    return f"""
WITH RECURSIVE leaves AS MATERIALIZED (SELECT doc_id AS key, coalesce('=' || source, '') AS grp, {leaf('text')} AS leaf, CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS again,
 row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents),
nodes AS (SELECT grp, 0 AS level, place AS pos, leaf AS h FROM leaves UNION ALL {levels.format(t='nodes')}),
subs AS MATERIALIZED (SELECT grp AS key, '' AS grp, arg_max(h, level) AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place FROM nodes GROUP BY grp),
tops AS (SELECT grp, 0 AS level, place AS pos, subroot AS h FROM subs UNION ALL {levels.format(t='tops')}),
lower_path AS ({path.format(l='leaves', n='nodes')}),
upper_path AS ({path.format(l='subs', n='tops')}),
steps AS (SELECT key, list(b || '|' || a ORDER BY stage, level) AS steps, sha256(string_agg(b || a, '' ORDER BY stage, level)) AS proof_sha256
 FROM (SELECT key, 0 AS stage, level, b, a FROM lower_path UNION ALL SELECT l.key, 1, u.level, u.b, u.a FROM leaves l JOIN upper_path u ON u.key = l.grp) GROUP BY key),
out AS (SELECT l.key AS doc_id, l.leaf, s.subroot, (SELECT arg_max(h, level) FROM tops) AS root, coalesce(t.proof_sha256, sha256('')) AS proof_sha256,
 list_reduce(coalesce(t.steps, []), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2)), l.again) AS folded_root
 FROM leaves l JOIN subs s ON s.key = l.grp LEFT JOIN steps t ON t.key = l.key)
SELECT *, folded_root = root AS verified FROM out
"""


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLES = {
    "op2_url_filters": f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UP}', '{_LOW}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
r(rh, rp, rv) AS (VALUES {", ".join(f"('{h}', '{q}', '{v}')" for h, q, v in RULES)}),
m AS (SELECT DISTINCT host, path, first_value(rh || rp) OVER w AS rule, first_value(rv) OVER w AS verdict
      FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
      WINDOW w AS (PARTITION BY host, path ORDER BY length(rh || rp) DESC, length(rh) DESC))
SELECT p.page_id, coalesce(p.host, '') AS host, coalesce(p.path, '') AS path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
""",
    "op12_merkle_manifest": _merkle_sql(),
    "op13_vector_codes": _lloyd_sql(),
}
