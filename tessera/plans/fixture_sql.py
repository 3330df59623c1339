"""SQL twins of the fixtures: common table expressions over the warehouse tables."""

from __future__ import annotations

import re

FIXTURES = {
    "spots": """
        SELECT c_custkey AS spot_id, c_mktsegment AS slice, CAST(c_custkey % 40 AS DOUBLE) AS x,
               CAST(c_custkey // 40 AS DOUBLE) AS y, r_name AS label,
               CASE WHEN k.pos <= 3 THEN 'A' WHEN k.pos <= 5 THEN 'B' END AS slice_class
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        JOIN (SELECT c_mktsegment AS s, row_number() OVER (ORDER BY c_mktsegment) AS pos
              FROM (SELECT DISTINCT c_mktsegment FROM customer)) k ON k.s = c_mktsegment""",
    "genes": """
        SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS gene_index
        FROM (SELECT DISTINCT p_type || '-' || p_size AS gene FROM part)""",
    "counts": """
        SELECT c_mktsegment AS slice, o_custkey AS spot_id, p_type || '-' || p_size AS gene, sum(l_quantity) AS count
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""",
    "expr": """
        SELECT slice, spot_id, gene, count, ln(1 + 10000.0::DOUBLE * count / sum(count) OVER (PARTITION BY spot_id)) AS value
        FROM counts""",
    "embedding": """
        SELECT vec_id AS spot_id, 's' || (vec_id % 3) AS slice, CAST(label AS VARCHAR) AS label, embedding::DOUBLE[] AS emb
        FROM embeddings""",
    "metric_meta": """
        SELECT * FROM (VALUES
          (0, 'bASW', 'Integration', 'BatchMixing', 1, false), (1, 'iLISI', 'Integration', 'BatchMixing', 1, false),
          (2, 'dASW', 'Integration', 'BiologicalConservation', 1, true), (3, 'dLISI', 'Integration', 'BiologicalConservation', 1, true),
          (4, 'ILL', 'Integration', 'BiologicalConservation', 1, true), (5, 'GC', 'Integration', 'BiologicalConservation', 1, true),
          (6, 'silhouette', 'Clustering', 'LabelIndependentClustering', 1, false),
          (7, 'CHAOS', 'Clustering', 'LabelIndependentClustering', -1, false),
          (8, 'PAS', 'Clustering', 'LabelIndependentClustering', -1, false),
          (9, 'ari', 'Clustering', 'LabelAgreement', 1, true), (10, 'nmi', 'Clustering', 'LabelAgreement', 1, true),
          (11, 'Accuracy', 'Alignment', 'Alignment', 1, true), (12, 'Ratio', 'Alignment', 'Alignment', -1, true)
        ) t(metric_number, metric_name, task_group, component, direction, needs_label)""",
    "records": """
        SELECT dataset, 'grid' AS platform, 1::BIGINT AS n_slices, fs_method,
               CASE WHEN fs_method = 'Brand#1' THEN 'all' ELSE '2000' END AS n_features, integration_method,
               task_group AS task, metric_name,
               CASE WHEN dataset = 'MACHINERY' AND needs_label THEN NULL ELSE round(raw_value, 9) END AS metric_value,
               random_seed, runtime, memory_usage, effective_n_features, '' AS notes
        FROM (SELECT c_mktsegment AS dataset, p_brand AS fs_method, l_linestatus AS integration_method,
                     l_suppkey % 13 AS metric_number, l_orderkey % 3 AS random_seed, avg(l_discount + l_tax) AS raw_value,
                     avg(l_quantity) AS runtime, avg(l_extendedprice) AS memory_usage, count(*) AS effective_n_features
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
              JOIN customer ON o_custkey = c_custkey GROUP BY ALL) JOIN metric_meta USING (metric_number)""",
    "rankings": """
        SELECT dataset, method, gene, gene_index, score,
               row_number() OVER (PARTITION BY dataset, method ORDER BY score DESC, gene_index DESC) AS rank
        FROM (SELECT c_mktsegment AS dataset, p_brand AS method, p_type || '-' || p_size AS gene, sum(l_quantity) AS score
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
              JOIN customer ON o_custkey = c_custkey GROUP BY ALL) JOIN genes USING (gene)""",
    # ---- derived building blocks ----
    "slice_sizes": "SELECT slice, count(*) AS n_spots FROM spots GROUP BY slice",
    "slice_moments": """
        SELECT slice, gene, n_spots, d AS n_detected, s / n_spots AS mean,
               greatest(q / n_spots - (s / n_spots) * (s / n_spots), 0) AS var_pop,
               greatest(q / n_spots - (s / n_spots) * (s / n_spots), 0) * n_spots / nullif(n_spots - 1, 0) AS var
        FROM (SELECT slice, gene, sum(value) AS s, sum(value * value) AS q, count(*) FILTER (value > 0) AS d
              FROM expr GROUP BY 1, 2) JOIN slice_sizes USING (slice)""",
    "knn8": """
        SELECT slice, src, dst, dist2, rank FROM (
          SELECT a.slice, a.spot_id AS src, b.spot_id AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS dist2,
                 row_number() OVER (PARTITION BY a.spot_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.spot_id) AS rank
          FROM spots a JOIN spots b ON a.slice = b.slice AND a.spot_id <> b.spot_id) WHERE rank <= 8""",
    "pairs8": "SELECT DISTINCT slice, least(src, dst) AS src, greatest(src, dst) AS dst FROM knn8",
    "emb_pairs": """
        SELECT a.spot_id AS src, b.spot_id AS dst, a.slice AS src_slice, b.slice AS dst_slice, a.label AS src_label, b.label AS dst_label,
               list_sum(list_transform(list_zip(a.emb, b.emb), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist2
        FROM embedding a JOIN embedding b ON a.spot_id <> b.spot_id""",
    "emb_knn15": """
        SELECT *, rank16 - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist2, dst) AS rank16 FROM emb_pairs)
        WHERE rank16 BETWEEN 2 AND 16""",
    "oriented": "SELECT r.*, component, metric_value * direction AS oriented FROM records r JOIN metric_meta m USING (metric_name)",
    "setting": """
        SELECT dataset, fs_method, n_features, integration_method, task, metric_name, avg(metric_value) AS value_mean,
               stddev_samp(metric_value) AS value_sd, avg(oriented) AS oriented_mean, stddev_samp(oriented) AS oriented_sd,
               count(DISTINCT random_seed) AS n_seeds, min(effective_n_features) AS effective_min,
               max(effective_n_features) AS effective_max, avg(runtime) AS runtime_mean
        FROM oriented GROUP BY ALL""",
    "ranges": """
        SELECT *, CASE WHEN status = 'ok' THEN range END AS denominator FROM (
          SELECT *, upper - lower AS range, CASE WHEN n_finite = 0 THEN 'unavailable' WHEN upper - lower = 0 THEN 'constant' ELSE 'ok' END AS status
          FROM (SELECT dataset, task, metric_name, min(oriented_mean) AS lower, max(oriented_mean) AS upper, count(oriented_mean) AS n_finite
                FROM setting GROUP BY ALL))""",
    "seed_scaled": "SELECT o.*, (oriented - lower) / denominator AS scaled FROM oriented o LEFT JOIN ranges USING (dataset, task, metric_name)",
    "setting_scaled": "SELECT o.*, lower, upper, status, (oriented_mean - lower) / denominator AS scaled FROM setting o LEFT JOIN ranges USING (dataset, task, metric_name)",
    "seed_scores": """
        SELECT *, (Integration + Clustering) / 2 AS CoreOverall, (Integration + Clustering + Alignment) / 3 AS AlignmentEligibleOverall FROM (
          SELECT *, CASE WHEN BatchMixing IS NULL THEN BiologicalConservation WHEN BiologicalConservation IS NULL THEN BatchMixing
                    ELSE (BatchMixing + BiologicalConservation) / 2 END AS Integration,
                 CASE WHEN LabelIndependentClustering IS NULL THEN LabelAgreement WHEN LabelAgreement IS NULL THEN LabelIndependentClustering
                    ELSE (LabelIndependentClustering + LabelAgreement) / 2 END AS Clustering FROM (
            SELECT dataset, fs_method, n_features, integration_method, random_seed,
              CASE WHEN count(scaled) FILTER (component = 'BatchMixing') = 2 THEN avg(scaled) FILTER (component = 'BatchMixing') END AS BatchMixing,
              CASE WHEN count(scaled) FILTER (component = 'BiologicalConservation') = 4 THEN avg(scaled) FILTER (component = 'BiologicalConservation') END AS BiologicalConservation,
              CASE WHEN count(scaled) FILTER (component = 'LabelIndependentClustering') = 3 THEN avg(scaled) FILTER (component = 'LabelIndependentClustering') END AS LabelIndependentClustering,
              CASE WHEN count(scaled) FILTER (component = 'LabelAgreement') = 2 THEN avg(scaled) FILTER (component = 'LabelAgreement') END AS LabelAgreement,
              CASE WHEN count(scaled) FILTER (component = 'Alignment') = 2 THEN avg(scaled) FILTER (component = 'Alignment') END AS Alignment
            FROM seed_scaled GROUP BY ALL))""",
    "core_scores": """
        SELECT dataset, fs_method, n_features, integration_method, round(avg(CoreOverall), 9) AS CoreOverallMean
        FROM seed_scores GROUP BY ALL""",
    "core_ranked": """
        SELECT *, CASE WHEN CoreOverallMean IS NOT NULL THEN rank() OVER (PARTITION BY dataset, integration_method ORDER BY CoreOverallMean DESC NULLS LAST)
                 + (count(*) OVER (PARTITION BY dataset, integration_method, CoreOverallMean) - 1) / 2.0::DOUBLE END AS core_rank
        FROM core_scores""",
}

_WORD = {name: re.compile(rf"\b{name}\b") for name in FIXTURES}


def with_fixtures(sql: str) -> str:
    """Put the definitions of all fixtures a statement uses (directly or not) in front of it."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, pattern in _WORD.items():
            if name not in needed and pattern.search(text):
                needed.add(name)
                visit(FIXTURES[name])

    visit(sql)
    if not needed:
        return sql
    # slow pair tables are materialized so that they are computed once per statement
    parts = [f"{n} AS MATERIALIZED ({FIXTURES[n].strip()})" for n in FIXTURES if n in needed]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
