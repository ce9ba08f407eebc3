"""The registered training-data queries, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm import centroids, divergence, html_blocks, near_dups, packing, parity_join, pii, quality_gam, resampling, secrets, spans, toxicity, url_trie, wu_manber
from foliograph.llm.shared import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels are learned from rows outside fold 0 of 5."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_gam.fit(documents, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    scored = quality_gam.with_score(documents, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


#: Fixed by the contract of the URL query: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query
def op4_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_trie.with_verdict(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op4_url_trie"] = r"""
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM rest),
fits AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict
FROM fits QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST, verdict DESC) = 1
"""


@query
def op10_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a ten-word window of a benchmark item."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = wu_manber.with_hits(documents, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["stop"] - h["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLES["op10_wu_manber"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, m, k, array_to_string(w[k : k + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT doc_id, k, p.m, item_id FROM g JOIN p USING (m, g)),
n AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM (SELECT doc_id, k, unnest(range(0, m)) AS j FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels are learned from rows outside fold 2 of 4."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(documents, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    scored = toxicity.with_score(documents, lexicon)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op3_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_blocks.with_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = secrets.with_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in secrets.STRONG],
        F.sha2(spans.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        spans.joined(F.col("spans")).alias("spans"),
    )


@query
def op7_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the divergence verdict of every document."""
    judged = divergence.with_verdict(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "language", "char_distance", "word_distance")


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(spans.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        spans.joined(F.col("spans")).alias("spans"),
    )


@query
def op5_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    found = near_dups.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"))


@query
def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of 2,048 words over all documents."""
    return packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query
def op11_weighted_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every kept vector after ten rounds with eight centroids."""
    found = centroids.clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), dims=64, scale=1024, k=8, rounds=10, seed="3:")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroids.digest(F.col("centroid")).alias("centroid_sha256"))


def _lloyd_sql(k: int, rounds: int) -> str:
    """Every round as two statements: the nearest centroid of each vector, then floor(sum / count) of each centroid."""
    kept = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE {kept})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS cluster, q AS c FROM (SELECT sha256('3:' || vec_id) AS h, q FROM v WHERE vec_id IS NOT NULL ORDER BY h, q LIMIT {k}))",
    ]
    near = "a{0} AS MATERIALIZED (SELECT i, min_by(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT i, cluster, CAST(list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{0}) GROUP BY i)"
    for r in range(rounds):
        parts += [
            near.format(r),
            f"s{r} AS MATERIALIZED (SELECT cluster, p, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS p FROM v JOIN a{r} USING (i)) GROUP BY ALL)",
            f"m{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS c FROM s{r} GROUP BY cluster)",
            f"c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))",
        ]
    parts.append(near.format(rounds))
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM v JOIN a{rounds} USING (i) JOIN c{rounds} USING (cluster)"
    )


ORACLES["op11_weighted_lloyd"] = _lloyd_sql(8, 10)


@query
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document against the benchmark's words; a tenth of the longer ones is drawn."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = resampling.resampled(documents, table(spark, sf_dir, "benchmark").select("text"), upto=1, buckets=10_000, least_words=20, percent=10, seed="2024:")
    return found.select("doc_id", "n_features", "weight", "score", "rank")


ORACLES["op12_resampling"] = r"""
WITH bits AS MATERIALIZED (SELECT list(list_reduce(list_concat([CAST(b AS BIGINT)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY b) AS t FROM range(256) r(b)),
d AS (SELECT row_number() OVER () AS i, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
dw AS MATERIALIZED (SELECT i, x, count(*) AS n FROM (SELECT i, unnest(w) AS x FROM d) GROUP BY ALL),
bw AS MATERIALIZED (SELECT x, count(*) AS n FROM (SELECT unnest(w) AS x FROM b) GROUP BY ALL),
k AS MATERIALIZED (SELECT x, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(length(hex(encode(x))) // 2), lambda j: CAST(CAST('0x' || substr(hex(encode(x)), CAST(2 * j + 1 AS INTEGER), 2) AS INTEGER) AS BIGINT))), lambda c, z: xor(t[xor(c, z) % 256 + 1], c // 256))) % 10000 AS k FROM (SELECT x FROM dw UNION SELECT x FROM bw), bits),
s AS (SELECT k, sum(n) AS s FROM dw JOIN k USING (x) GROUP BY k),
t AS (SELECT k, sum(n) AS t FROM bw JOIN k USING (x) GROUP BY k),
g AS (SELECT k, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN t USING (k)),
w AS (SELECT i, CAST(sum(n * gain) AS BIGINT) AS weight FROM dw JOIN k USING (x) JOIN g USING (k) GROUP BY i),
r AS (SELECT i, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5)::DOUBLE / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w USING (i)),
o AS (SELECT i, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM r WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM r LEFT JOIN o USING (i)
"""


@query
def op13_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document under links of a Jaccard similarity of 0.8 or more between sets of five-word shingles."""
    found = parity_join.classes(table(spark, sf_dir, "documents").select("doc_id", "text"), size=5, percent=80)
    return found.select("doc_id", "n_shingles", "component_id")


ORACLES["op13_parity_join"] = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT i, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k : k + 4], ' '))) AS g FROM d WHERE len(w) > 0),
u AS MATERIALIZED (SELECT g, min(i) AS u FROM (SELECT list_sort(g) AS g, i FROM g) GROUP BY g),
o AS (SELECT u, len(g) AS n, unnest(g) AS x FROM u),
c AS (SELECT a.u AS a, b.u AS b, a.n + b.n - count(*) AS whole, count(*) AS n FROM o a JOIN o b ON a.x = b.x AND a.u < b.u GROUP BY a.u, b.u, a.n, b.n),
l AS MATERIALIZED (SELECT a, b FROM c WHERE 100 * n >= 80 * whole UNION ALL SELECT b, a FROM c WHERE 100 * n >= 80 * whole),
r AS (SELECT u AS a, u AS b FROM u UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT i, u, doc_id FROM d JOIN g USING (i) JOIN u ON list_sort(g.g) = u.g),
k AS (SELECT a, min(doc_id) AS component_id FROM r JOIN m ON r.b = m.u GROUP BY a)
SELECT doc_id, CAST(coalesce(len(g), 0) AS BIGINT) AS n_shingles, CASE WHEN g IS NULL THEN doc_id ELSE component_id END AS component_id
FROM d LEFT JOIN g USING (i) LEFT JOIN (SELECT i, component_id FROM m JOIN k ON m.u = k.a) USING (i)
"""
