"""SQL of the schedule: partitions of every width, their controls, and metrics over all of them."""

from __future__ import annotations

from strataspan.functions.scripts import DOMINANT_SQL
from strataspan.sources.tables import SCALES, SEEDS, VOCAB_SQL

#: Noise rules of the stability runs: what the distance to the mean of all rows is multiplied by.
MARGINS = (0.9, 0.95)

_E = ", ".join(str(k) for k in SCALES)
_RULES = " UNION ALL ".join(f"SELECT '{n}' AS source, {m}::DOUBLE AS margin" for n, m in (("baseline", 1.0), *((f"stability_{m}", m) for m in MARGINS)))
_PARTS = f"""e_ AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
l_ AS (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM e_),
c_ AS (SELECT label, list(m ORDER BY d) AS c FROM (SELECT label, d, avg(v) AS m FROM l_ WHERE label > 0 GROUP BY label, d UNION ALL SELECT 0, d, avg(v) FROM l_ GROUP BY d) GROUP BY label),
sc_ AS (SELECT unnest([{_E}]) AS scale), rule_ AS ({_RULES}),
far_ AS (SELECT vec_id, scale, c_.label, list_sum(list_transform(list_zip(x[1:scale], c[1:scale]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM e_, c_, sc_),
part_ AS (SELECT source, scale, vec_id AS token_id, label - 1 AS cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY source, scale, vec_id ORDER BY d * CASE WHEN label = 0 THEN margin ELSE 1 END, label) AS k FROM far_, rule_) WHERE k = 1)"""
_TASKS = f"""WITH {VOCAB_SQL}, {DOMINANT_SQL}, {_PARTS},
text_ AS (SELECT token_id, token_str, script, CASE WHEN length(token_str) <= 2 THEN '1-2' WHEN length(token_str) <= 5 THEN '3-5' WHEN length(token_str) <= 10 THEN '6-10' ELSE '11+' END AS bucket FROM scripted WHERE token_id IN (SELECT vec_id FROM embeddings)),
sd_ AS (SELECT unnest([{', '.join(map(str, SEEDS))}]) AS seed),
kept_ AS (SELECT k.source, seed, scale, CASE WHEN k.source = 'permutation' THEN '' ELSE bucket END AS within, p.token_id, cluster_id FROM part_ p JOIN text_ t ON p.token_id = t.token_id, sd_, (SELECT unnest(['permutation', 'length_bucket']) AS source) k WHERE p.source = 'baseline' AND cluster_id >= 0),
seat_ AS (SELECT *, row_number() OVER (PARTITION BY source, seed, scale, within ORDER BY token_id) AS a, row_number() OVER (PARTITION BY source, seed, scale, within ORDER BY sha256(CAST(seed AS VARCHAR) || ':' || CAST(token_id AS VARCHAR))) AS b FROM kept_),
task_ AS (SELECT source, CAST(NULL AS BIGINT) AS seed, scale, token_id, cluster_id FROM part_ UNION ALL
  SELECT x.source, x.seed, x.scale, y.token_id, x.cluster_id FROM seat_ x JOIN seat_ y ON x.source = y.source AND x.seed = y.seed AND x.scale = y.scale AND x.within = y.within AND x.a = y.b) """
_METRICS = _TASKS + """, named_ AS (SELECT token_id, 'script' AS metric, script AS category FROM text_ UNION ALL SELECT token_id, 'length', bucket FROM text_),
kinds_ AS (SELECT metric, count(DISTINCT category) AS kinds FROM named_ GROUP BY metric),
n_ AS (SELECT source, seed, scale, metric, cluster_id, category, count(*) AS n FROM task_ JOIN named_ USING (token_id) WHERE cluster_id >= 0 GROUP BY ALL),
h_ AS (SELECT source, seed, scale, metric, cluster_id, CAST(sum(n) AS BIGINT) AS size, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM n_ GROUP BY ALL),
hn_ AS (SELECT h_.*, CASE WHEN kinds <= 1 THEN 0.0 ELSE h / ln(kinds) END AS h_norm FROM h_ JOIN kinds_ USING (metric)),
lc_ AS (SELECT source, seed, scale, metric, 'h' AS component, h AS v FROM hn_ UNION ALL SELECT source, seed, scale, metric, 'h_norm', h_norm FROM hn_),
ag_ AS (SELECT source, seed, scale, metric, component, avg(v) AS mean, stddev_pop(v) AS std, CAST(count(*) AS DOUBLE) AS n FROM lc_ GROUP BY ALL),
mr_ AS (SELECT source, seed, scale, metric, component, 'mean' AS aggregation, round(mean, 9) + 0.0 AS value FROM ag_ UNION ALL SELECT source, seed, scale, metric, component, 'std', round(std, 9) + 0.0 FROM ag_ UNION ALL SELECT source, seed, scale, metric, component, 'count', n FROM ag_) """
_KEY = "source, coalesce(CAST(seed AS VARCHAR), '') AS seed"

#: mr (metric, scale, seed, aggregation, value): the curves that statistics are taken of.
METRIC_SQL = _METRICS.removeprefix("WITH ").rstrip() + ", mr AS (SELECT metric, CAST(scale AS INT) AS scale, seed, aggregation, value FROM mr_ WHERE source IN ('baseline', 'permutation') AND component = 'h')"
