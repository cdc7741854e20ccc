"""The registered queries of this subpackage, each over its whole tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .licenses import op4_license_scan
from .mixing import OP10_SQL, op10_mixing
from .ngram_join import jaccard_join
from .packing import op6_packing
from .pii import op2_personal_data
from .quality import OP5_SQL, op5_quality_rules
from .sharding import op9_sharding
from .token_counts import op8_token_counts
from .topk import top_k
from .toxicity import op7_toxicity


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {
    f.__name__: f
    for f in (op1_exact_top_k, op2_personal_data, op3_ngram_jaccard_join, op4_license_scan, op5_quality_rules, op6_packing, op7_toxicity, op8_token_counts, op9_sharding, op10_mixing)
}

OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

# All pairs that share a shingle, and everything reachable by links: fine for a few thousand documents.
OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'),
         lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS shingles FROM d),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS n, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (n - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.reached = u.a),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, c.component_id FROM s JOIN c USING (doc_id)
"""

ORACLE: dict[str, str] = {"op1_exact_top_k": OP1_SQL, "op3_ngram_jaccard_join": OP3_SQL, "op5_quality_rules": OP5_SQL, "op10_mixing": OP10_SQL}
