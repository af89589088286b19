"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


#: Target weights of sources that count more than the others, whose weight is 1.
TARGETS = {"src0": 8.0, "src1": 3.0, "src2": 2.0}


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_sign_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_t_occurrence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar_texts

    return similar_texts(table(spark, sf_dir, "documents"))


def op4_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"), [1.0] * 24)


def op5_support_vector_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeat_digests

    return repeat_digests(table(spark, sf_dir, "documents"))


def op9_minimum_cut_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op10_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return mix(docs, TARGETS, other=1.0)


def op11_covariance_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    # A deviation that doesn't fit a long, as with many millions of rows, is null.
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op13_bit_plane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bit_planes import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sum_of_squares_packing,
        op2_sign_hash_dedup,
        op3_t_occurrence_join,
        op4_rendezvous_sharding,
        op5_support_vector_quality,
        op6_multi_index_search,
        op7_noisy_channel_toxicity,
        op8_suffix_repeats,
        op9_minimum_cut_text,
        op10_pfair_mixing,
        op11_covariance_whitening,
        op12_simhash_fingerprints,
        op13_bit_plane_clusters,
    )
}

_REACH = """reach AS (
  SELECT id AS a, id AS b FROM ids
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)"""


def _clusters_sql(clusters: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds, one after another, each a pair of steps: assigned vectors, then moved centroids."""
    steps = [
        """v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS k, x FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {clusters}))",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (
  SELECT vec_id, x, n.k AS k, n.d AS d FROM (
    SELECT vec_id, any_value(v.x) AS x, min(struct_pack(d := CAST(list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, c.x) + list_dot_product(c.x, c.x) AS BIGINT), k := k)) AS n
    FROM v CROSS JOIN c{r} c GROUP BY vec_id
  )
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS (
  SELECT c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT k, list(m ORDER BY j) AS x FROM (
      SELECT k, j, floor(sum(y) / count(*)) AS m FROM (SELECT k, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM a{r}) GROUP BY k, j
    ) GROUP BY k
  ) m ON m.k = c.k
)""")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.x, lambda y: CAST(y AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.k = a.k"""


ORACLE_SQL: dict[str, str] = {
    "op2_sign_hash_dedup": f"""
WITH RECURSIVE ids AS (SELECT vec_id AS id FROM embeddings),
v AS (
  SELECT vec_id, label, len(embedding) AS d, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.d = b.d AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
),
{_REACH},
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT id AS vec_id, coalesce(n.n, 0) AS n_links, component_id, id = component_id AS kept
FROM (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY 1) LEFT JOIN n ON n.a = id""",
    "op3_t_occurrence_join": f"""
WITH RECURSIVE ids AS (SELECT doc_id AS id FROM documents),
w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE text IS NOT NULL
),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END)) AS s
  FROM w WHERE len(w) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT p.a, p.b FROM pairs p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.i >= 75 * (x.n + y.n - p.i)),
{_REACH}
SELECT id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id
FROM (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY 1) LEFT JOIN n ON n.doc_id = id""",
    "op13_bit_plane_clusters": _clusters_sql(),
}
