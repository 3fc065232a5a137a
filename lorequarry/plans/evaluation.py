"""Queries on retrieval metrics, labels and calibration, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lorequarry.operators import calibration as cal, labels as lb, metrics as mt, vector
from lorequarry.plans import retrieval as rt
from lorequarry.sources.tables import table

REPS, FULL_REPS = 200, 2000


def items(spark, folder) -> DataFrame:
    """Distinct test items (rows delivered again fall together)."""
    return table(spark, folder, "test_set").select(
        "item_id", "evidence_chunk_ids", "gold_chunk_ids", "gold_sources", "expected_sources"
    ).distinct()


def runs(spark, folder) -> DataFrame:
    """Evaluation runs with the evidence of their items."""
    evidence = items(spark, folder).select(
        F.concat(F.lit("answerable-"), F.col("item_id").cast("string")).alias("item_id"), F.col("evidence_chunk_ids").alias("evidence")
    )
    rows = table(spark, folder, "e2e").select(
        "row_id", F.col("kind").alias("strategy"), F.col("retrieved_ids").alias("ids"), F.col("retrieved_sources").alias("sources"),
        F.col("gold_chunk_ids").alias("gold"), "gold_sources", "expected_sources", "item_id",
    )
    return rows.join(evidence, "item_id", "left")


def retrieval_metrics(spark, folder):
    m = mt.retrieval_metrics(runs(spark, folder))
    return m.select("row_id", "strategy", *(F.round(c, 9).alias(c) for c in m.columns[2:]))


def strategy_summary(spark, folder):
    s = mt.strategy_summary(mt.retrieval_metrics(runs(spark, folder)))
    return s.withColumn("value", F.round("value", 9))


def strategy_means(spark, folder):
    s = mt.strategy_means(mt.retrieval_metrics(runs(spark, folder)))
    return s.withColumn("value", F.round("value", 9))


def wilson_ci(spark, folder):
    grouped = table(spark, folder, "e2e").groupBy("kind", F.date_format("run_at", "yyyy-MM").alias("month")).agg(
        F.count_if("retrieval_hit").alias("hits"), F.count("retrieval_hit").alias("n")
    )
    low, high = mt.wilson(F.col("hits"), F.col("n"))
    return grouped.select("kind", "month", "hits", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def _values(spark, folder) -> DataFrame:
    return mt.retrieval_metrics(runs(spark, folder)).where("mrr is not null").select(F.col("row_id").alias("key"), F.col("mrr").alias("v"))


def bootstrap_ci(spark, folder):
    b = mt.bootstrap_interval(_values(spark, folder), REPS)
    return b.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


def bootstrap_ci_full(spark, folder):
    b = mt.bootstrap_interval(_values(spark, folder), FULL_REPS)
    return b.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


def _paired(spark, folder) -> DataFrame:
    """Share of hits with the query's label, of plain similarity (a) and of marginal relevance (b)."""
    c, q = rt.corpus(spark, folder), rt.questions(spark, folder)
    labels = c.select("chunk_id", "label")

    def share(hits: DataFrame, name: str) -> DataFrame:
        good = hits.join(labels, "chunk_id").join(q.select("query_id", F.col("label").alias("own")), "query_id")
        return good.groupBy("query_id").agg((F.count_if(F.col("label") == F.col("own")) / F.lit(3.0)).alias(name))

    similar, varied = vector.nearest(c, q, 3), vector.marginal_relevance(c, q, 3)
    return share(similar, "a").join(share(varied, "b"), "query_id")


def paired_diff(spark, folder):
    return _paired(spark, folder).select("query_id", F.round("a", 9).alias("a"), F.round("b", 9).alias("b"), F.round(F.col("a") - F.col("b"), 9).alias("diff"))


def paired_bootstrap(spark, folder):
    return mt.paired_bootstrap(_paired(spark, folder).withColumnRenamed("query_id", "key"), REPS)


def paired_bootstrap_full(spark, folder):
    return mt.paired_bootstrap(_paired(spark, folder).withColumnRenamed("query_id", "key"), FULL_REPS)


def random_baseline(spark, folder):
    return mt.random_baseline(items(spark, folder), table(spark, folder, "chunk"))


def random_baseline_chunk(spark, folder):
    return mt.random_baseline_chunk(items(spark, folder), table(spark, folder, "chunk"))


def jaccard_pairs(spark, folder):
    p = lb.evidence_pairs(items(spark, folder), table(spark, folder, "chunk"))
    return p.select("a", "b", F.round("similarity", 9).alias("similarity"))


def expand_gold(spark, folder):
    return lb.expand_gold(items(spark, folder), table(spark, folder, "chunk"))


def label_stats(spark, folder):
    return lb.label_stats(lb.expand_gold(items(spark, folder), table(spark, folder, "chunk")))


def missing_evidence(spark, folder):
    return lb.missing_evidence(items(spark, folder), table(spark, folder, "chunk"))


def _distances(spark, folder) -> DataFrame:
    q = rt.questions(spark, folder)
    best = vector.best_distance(rt.corpus(spark, folder), q).join(q.select("query_id", "label"), "query_id")
    kind = F.when(F.col("label") <= 4, "positive").when(F.col("label") <= 7, "easy").otherwise("hard")
    return best.select(kind.alias("kind"), F.round("dist", 6).alias("dist"))


def distance_stats(spark, folder):
    return cal.distance_stats(_distances(spark, folder))


def _grid(low: int, high: int):
    return F.transform(F.sequence(F.lit(low), F.lit(high)), lambda i: i / F.lit(100.0))


def threshold_metrics(spark, folder):
    return cal.threshold_metrics(_distances(spark, folder), F.array(F.lit(rt.GATE)))


def threshold_sweep(spark, folder):
    return cal.threshold_metrics(_distances(spark, folder), _grid(50, 150))


def best_f1_threshold(spark, folder):
    return cal.best_threshold(cal.threshold_metrics(_distances(spark, folder), _grid(50, 150)))


def distance_histogram(spark, folder):
    return cal.histogram(_distances(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        retrieval_metrics, strategy_summary, strategy_means, wilson_ci, bootstrap_ci, bootstrap_ci_full, paired_diff, paired_bootstrap,
        paired_bootstrap_full, random_baseline, random_baseline_chunk, jaccard_pairs, expand_gold, label_stats, missing_evidence, distance_stats, threshold_metrics,
        threshold_sweep, best_f1_threshold, distance_histogram,
    )
}

_ITEMS = "items AS (SELECT DISTINCT item_id, evidence_chunk_ids, gold_chunk_ids, gold_sources, expected_sources FROM test_set)"
_SET = "list_distinct(list_filter(coalesce({}, []), lambda x: x IS NOT NULL))"
_METRICS = f"""WITH {_ITEMS},
r AS (SELECT row_id, kind AS strategy, coalesce(retrieved_ids, []) AS ids, {_SET.format("retrieved_sources")} AS srcs, {_SET.format("e.gold_chunk_ids")} AS gold,
        {_SET.format("e.gold_sources")} AS gsrc, {_SET.format("e.expected_sources")} AS esrc, {_SET.format("i.evidence_chunk_ids")} AS ev
      FROM e2e e LEFT JOIN items i ON e.item_id = 'answerable-' || i.item_id),
metrics AS (SELECT row_id, strategy,
  (len(list_intersect(srcs, esrc)) > 0)::int::double AS source_strict, (len(list_intersect(srcs, gsrc)) > 0)::int::double AS source_relaxed,
  len(srcs)::double AS diversity,
  CASE WHEN len(gold) > 0 THEN (len(list_intersect(ids, gold)) > 0)::int::double END AS chunk_any,
  CASE WHEN len(gold) > 0 AND len(ev) > 0 THEN (len(list_intersect(ev, ids)) = len(ev))::int::double END AS chunk_all,
  CASE WHEN len(gold) > 0 AND len(ev) > 0 THEN len(list_intersect(ev, ids))::double / len(ev) END AS evidence_coverage,
  CASE WHEN len(gold) > 0 THEN len(list_filter(ids[1:3], lambda x: list_contains(gold, x))) / 3.0::double END AS chunk_precision,
  CASE WHEN len(gold) > 0 THEN coalesce(1.0::double / nullif(list_position(list_transform(ids, lambda x: coalesce(list_contains(gold, x), false)), true), 0), 0) END AS mrr,
  CASE WHEN len(gold) > 0 THEN
    coalesce(list_sum(list_transform(range(1, least(len(ids), 3) + 1), lambda i: CASE WHEN list_contains(gold, ids[i]) THEN 1 / log2(i + 1) ELSE 0 END)), 0)
    / list_sum(list_transform(range(1, least(len(gold), 3) + 1), lambda i: 1 / log2(i + 1))) END AS ndcg
  FROM r)"""
_WILSON = """CASE WHEN n > 0 THEN round(greatest(0, (hits::double / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96::double * sqrt(hits::double / n * (1 - hits::double / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 9) ELSE 0.0 END AS low,
  CASE WHEN n > 0 THEN round(least(1, (hits::double / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96::double * sqrt(hits::double / n * (1 - hits::double / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 9) ELSE 0.0 END AS high""".replace("3.8416", "3.8416::double")


def _boot(source: str) -> str:
    """Resampled means of a relation (key, v)."""
    return f""", vals AS (SELECT row_number() OVER (ORDER BY key) - 1 AS place, v FROM ({source})),
    draws AS (SELECT rep, ('0x' || substr(md5('42:' || rep || ':' || draw), 1, 8))::bigint % (SELECT count(*) FROM vals) AS place
              FROM range({REPS}) a(rep), (SELECT place AS draw FROM vals)),
    means AS (SELECT rep, round(avg(v), 12) AS mean FROM draws JOIN vals USING (place) GROUP BY 1),
    sorted AS (SELECT list(mean ORDER BY mean) AS m FROM means)"""


_LO, _HI = int((1 - 0.95) / 2 * REPS), min(REPS - 1, int((1 - (1 - 0.95) / 2) * REPS))
_PAIRED = (
    rt._MMR
    + "".join(rt._next_pick(i) for i in (1, 2))
    + """, varied AS (SELECT * FROM pick0 UNION ALL SELECT * FROM pick1 UNION ALL SELECT * FROM pick2),
  a AS (SELECT query_id, count(*) FILTER (WHERE c.label = q.label) / 3.0::double AS a FROM near n JOIN corpus c USING (chunk_id) JOIN queries q USING (query_id) WHERE rank < 3 GROUP BY 1),
  b AS (SELECT query_id, count(*) FILTER (WHERE c.label = q.label) / 3.0::double AS b FROM varied n JOIN corpus c USING (chunk_id) JOIN queries q USING (query_id) GROUP BY 1)"""
)
_CHANCE = """CASE WHEN t - m < 3 THEN CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END
  ELSE 1 - (t - m)::double / t * (t - m - 1) / (t - 1) * (t - m - 2) / (t - 2) END"""
_PAIRS = (
    rf"""WITH {_ITEMS},
texts AS (SELECT chunk_id, arg_min(source, row_id) AS source, arg_min(page_content, row_id) AS text
          FROM chunk WHERE page_content IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1),
named AS (SELECT DISTINCT unnest(evidence_chunk_ids) AS chunk_id FROM items),
bare AS (SELECT chunk_id, regexp_replace(text, '[\s\x0b\x1c-\x1f\x85\p{{Z}}]+', '', 'g') AS t FROM texts),
grams AS (SELECT DISTINCT chunk_id, substr(t, i, 3) AS g FROM (SELECT chunk_id, t, unnest(range(1, length(t) - 1)) AS i FROM bare)),
sizes AS (SELECT chunk_id, count(*) AS n FROM grams GROUP BY 1),
shared AS (SELECT x.chunk_id AS a, y.chunk_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.chunk_id <> y.chunk_id
           WHERE x.chunk_id IN (SELECT chunk_id FROM named) GROUP BY 1, 2),
pairs AS (SELECT a, b, c::double / (p.n + q.n - c) AS similarity FROM shared JOIN sizes p ON p.chunk_id = a JOIN sizes q ON q.chunk_id = b
          WHERE c::double / (p.n + q.n - c) >= 0.8::double)"""
)
_EXPANDED = (
    _PAIRS
    + f""", ev AS (SELECT item_id, unnest({_SET.format("evidence_chunk_ids")}) AS a FROM items),
added AS (SELECT DISTINCT ev.item_id, p.b AS chunk_id, t.source FROM ev JOIN pairs p ON p.a = ev.a JOIN texts t ON t.chunk_id = p.b
          WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.item_id = ev.item_id AND e.a = p.b)),
grown AS (SELECT item_id, list(DISTINCT chunk_id) AS more, list(DISTINCT source) AS srcs FROM added GROUP BY 1),
expanded AS (SELECT item_id, list_sort(list_concat({_SET.format("evidence_chunk_ids")}, coalesce(more, []))) AS gold_chunk_ids, coalesce(len(more), 0)::int AS added_chunks,
    coalesce(len(list_filter(srcs, lambda s: NOT list_contains({_SET.format("expected_sources").replace("lambda x: x", "lambda z: z")}, s))), 0)::int AS added_sources, coalesce(len(more), 0) > 0 AS ambiguous
  FROM items LEFT JOIN grown USING (item_id))"""
)
_DISTANCES = (
    rt._DIST
    + """, d AS (SELECT CASE WHEN label <= 4 THEN 'positive' WHEN label <= 7 THEN 'easy' ELSE 'hard' END AS kind, round(best, 6) AS dist
    FROM (SELECT q.query_id, q.label, coalesce(min(dist), 'infinity'::double) AS best FROM queries q LEFT JOIN dist USING (query_id) GROUP BY 1, 2))"""
)


def _sweep_sql(grid: str) -> str:
    return f"""{_DISTANCES}, c AS (
      SELECT threshold, count(*) FILTER (WHERE kind = 'positive' AND dist <= threshold) AS tp, count(*) FILTER (WHERE kind = 'positive' AND dist > threshold) AS fn,
             count(*) FILTER (WHERE kind <> 'positive' AND dist <= threshold) AS fp, count(*) FILTER (WHERE kind <> 'positive' AND dist > threshold) AS tn
      FROM d, ({grid}) GROUP BY 1),
    p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::double / (tp + fp) ELSE 1.0 END AS pr, CASE WHEN tp + fn > 0 THEN tp::double / (tp + fn) ELSE 0.0 END AS re FROM c),
    swept AS (SELECT threshold, tp, fn, fp, tn, round(pr, 9) AS precision, round(re, 9) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 9) AS f1,
      round(CASE WHEN fp + tn > 0 THEN fp::double / (fp + tn) ELSE 0 END, 9) AS fpr, round(CASE WHEN tp + fp > 0 THEN fp::double / (tp + fp) ELSE 0 END, 9) AS fdr FROM p)
    SELECT * FROM swept"""


_GRID = "SELECT i / 100.0::double AS threshold FROM range(50, 151) t(i)"
ORACLE_SQL = {
    "retrieval_metrics": _METRICS
    + """SELECT row_id, strategy, source_strict, source_relaxed, diversity, chunk_any, chunk_all, round(evidence_coverage, 9) AS evidence_coverage,
         round(chunk_precision, 9) AS chunk_precision, round(mrr, 9) AS mrr, round(ndcg, 9) AS ndcg FROM metrics""",
    "strategy_summary": _METRICS
    + f""", long AS ({" UNION ALL ".join(f"SELECT strategy, '{m}' AS metric, {m} AS v FROM metrics" for m in mt.BINARY)}),
      s AS (SELECT strategy, metric, coalesce(sum(v), 0)::bigint AS hits, count(v) AS n FROM long GROUP BY 1, 2)
      SELECT strategy, metric, CASE WHEN n > 0 THEN round(hits::double / n, 9) END AS value, hits, n, {_WILSON} FROM s""",
    "strategy_means": _METRICS
    + " UNION ALL ".join(f" SELECT strategy, '{m}' AS metric, round(avg({m}), 9) AS value, count({m}) AS n FROM metrics GROUP BY 1" for m in mt.CONTINUOUS),
    "wilson_ci": f"""WITH g AS (SELECT kind, strftime(run_at, '%Y-%m') AS month, count(*) FILTER (WHERE retrieval_hit) AS hits, count(retrieval_hit) AS n FROM e2e GROUP BY 1, 2)
      SELECT kind, month, hits, n, {_WILSON} FROM g""",
    "bootstrap_ci": _METRICS
    + _boot("SELECT row_id AS key, mrr AS v FROM metrics WHERE mrr IS NOT NULL")
    + f" SELECT round(m[{_LO + 1}], 9) AS low, round(m[{_HI + 1}], 9) AS high FROM sorted",
    "paired_diff": _PAIRED + " SELECT query_id, round(a, 9) AS a, round(b, 9) AS b, round(a - b, 9) AS diff FROM a JOIN b USING (query_id)",
    "paired_bootstrap": _PAIRED
    + _boot("SELECT query_id AS key, a - b AS v FROM a JOIN b USING (query_id)")
    + f""" SELECT (SELECT round(avg(v), 9) FROM vals) AS mean_diff, round(m[{_LO + 1}], 9) AS low, round(m[{_HI + 1}], 9) AS high,
        least(1.0, 2 * least((SELECT count(*) FROM means WHERE mean <= 0) / {REPS}.0::double, (SELECT count(*) FROM means WHERE mean >= 0) / {REPS}.0::double)) AS p_value FROM sorted""",
    "random_baseline": f"""WITH {_ITEMS}, c AS (SELECT source, count(*) AS c FROM chunk GROUP BY 1),
      x AS (SELECT item_id, unnest(CASE WHEN len(gold_sources) > 0 THEN gold_sources ELSE [NULL] END) AS source FROM items),
      m AS (SELECT item_id, coalesce(sum(c), 0) AS m, (SELECT count(*) FROM chunk) AS t FROM x LEFT JOIN c USING (source) GROUP BY 1)
      SELECT round(avg({_CHANCE}), 9) AS baseline, count(*) AS n FROM m""",
    "random_baseline_chunk": f"""WITH {_ITEMS}, m AS (SELECT len({_SET.format("gold_chunk_ids")}) AS m, (SELECT count(*) FROM chunk) AS t FROM items)
      SELECT round(avg(CASE WHEN m = 0 THEN 0.0 ELSE {_CHANCE} END), 9) AS baseline, count(*) AS n FROM m""",
    "jaccard_pairs": _PAIRS + " SELECT a, b, round(similarity, 9) AS similarity FROM pairs",
    "expand_gold": _EXPANDED + " SELECT item_id, gold_chunk_ids, added_chunks, added_sources, ambiguous FROM expanded",
    "label_stats": _EXPANDED
    + """ SELECT count(*) AS items, count(*) FILTER (WHERE ambiguous) AS ambiguous_items, round(avg(ambiguous::int), 9) AS ambiguous_rate,
          sum(added_chunks)::bigint AS added_chunk_labels, sum(added_sources)::bigint AS added_source_labels FROM expanded""",
    "missing_evidence": f"""WITH {_ITEMS} SELECT chunk_id FROM (SELECT DISTINCT unnest(evidence_chunk_ids) AS chunk_id FROM items)
      WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM chunk WHERE chunk_id IS NOT NULL)""",
    "distance_stats": _DISTANCES
    + """ SELECT kind, count(*) AS n, min(dist) AS min, (list(dist ORDER BY dist))[(count(*) // 2)::int + 1] AS median, round(avg(dist), 9) AS mean, max(dist) AS max FROM d GROUP BY 1""",
    "threshold_metrics": _sweep_sql("SELECT 1.25::double AS threshold"),
    "threshold_sweep": _sweep_sql(_GRID),
    "best_f1_threshold": _sweep_sql(_GRID) + " ORDER BY f1 DESC, threshold LIMIT 1",
    "distance_histogram": _DISTANCES
    + """ SELECT kind, floor(round((dist - 0.4::double) / 0.05::double, 6))::bigint AS bin, count(*) AS n FROM d WHERE dist >= 0.4 AND dist < 1.6 GROUP BY 1, 2""",
}
