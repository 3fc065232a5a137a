"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lorequarry.llm.conversations import dropped_threads, sound_turns
from lorequarry.llm.defects import defective_pairs
from lorequarry.llm.dressed import distinct_contents, dressed_copies
from lorequarry.llm.leakage import leaked_passages
from lorequarry.llm.markup import clean_markup, markup_found
from lorequarry.llm.neardup import near_duplicate_pairs, near_duplicate_rows
from lorequarry.llm.packing import container_fill, pack_documents
from lorequarry.llm.splitting import oversized_rows, split_oversized
from lorequarry.llm.truncation import truncated_documents, truncation_report
from lorequarry.shared import materialize
from lorequarry.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return markup_found(clean_markup(table(spark, folder, "chunk")))


def p1_clean(spark: SparkSession, folder: str) -> DataFrame:
    return clean_markup(table(spark, folder, "chunk"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return defective_pairs(table(spark, folder, "e2e"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return dropped_threads(spark, f"{folder}/conversations.parquet")


def p3_turns(spark: SparkSession, folder: str) -> DataFrame:
    return sound_turns(spark, f"{folder}/conversations.parquet")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return oversized_rows(split_oversized(table(spark, folder, "chunk")))


def p5_split(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "chunk"))


def p5_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the pieces of every text: they tile it, none is too long, each stands where it says."""
    before = W.partitionBy("row_id").orderBy("piece_no")
    pieces = p5_split(spark, folder).withColumn("before", F.coalesce(F.lag("end").over(before), F.lit(0)))
    joined = (F.col("start") <= F.col("before")) & (F.col("start") >= F.col("before") - 50) & (F.col("end") >= F.col("before"))
    in_place = joined & (F.length("piece") == F.col("end") - F.col("start"))
    return pieces.groupBy("row_id").agg(
        F.sum(F.col("end") - F.col("before")).alias("covered"), F.max("end").cast("bigint").alias("until"),
        F.every(F.length("piece") <= 600).alias("within_limit"), F.every(in_place).alias("in_place"),
    )


def p8_places(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the place of every document: its pieces are whole, only long ones are cut, no container is overfull."""
    placed = materialize(p8_pack(spark, folder), "placed")
    used = placed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    rows = placed.join(used, "container_id", "left")
    whole = (F.sum("n_tokens") == F.max(F.col("start_token") + F.col("n_tokens"))) & (F.count(F.lit(1)) == F.max("piece_no") + 1)
    return rows.groupBy("doc_id").agg(
        whole.alias("whole"), ((F.max("piece_no") == 0) | (F.sum("n_tokens") > 2048)).alias("cut_if_long"), F.every(F.coalesce(F.col("used") <= 2048, F.lit(True))).alias("fits")
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return dressed_copies(table(spark, folder, "chunk"))


def p6_collapse(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_contents(table(spark, folder, "chunk"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, folder, "chunk"))


def p7_classes(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_rows(table(spark, folder, "chunk"))


def p8_pack(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return container_fill(p8_pack(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_passages(table(spark, folder, "documents"), table(spark, folder, "heldout")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncated_documents(table(spark, folder, "documents")).where("cut").select("doc_id")


def p10_report(spark: SparkSession, folder: str) -> DataFrame:
    return truncation_report(truncated_documents(table(spark, folder, "documents")))


QUERIES = {
    "p1_found": p1_found,
    "p1_clean": p1_clean,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_turns": p3_turns,
    "p5_found": p5_found,
    "p5_split": p5_split,
    "p5_tiles": p5_tiles,
    "p6_found": p6_found,
    "p6_collapse": p6_collapse,
    "p7_found": p7_found,
    "p7_classes": p7_classes,
    "p8_pack": p8_pack,
    "p8_fill": p8_fill,
    "p8_places": p8_places,
    "p9_found": p9_found,
    "p10_found": p10_found,
    "p10_report": p10_report,
}

_THREADS = r"""
    WITH messages AS (
      SELECT owner, thread_id, role, content, created_at, min(id) AS id FROM conversations GROUP BY ALL
    ), read_roles AS (
      SELECT owner, thread_id, content, created_at, id,
             CASE regexp_replace(lower(role), '^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$', '', 'g')
               WHEN 'user' THEN 'u' WHEN 'human' THEN 'u' WHEN 'assistant' THEN 'a' WHEN 'ai' THEN 'a'
               WHEN 'system' THEN 's' WHEN 'tool' THEN 's' ELSE 'x' END AS who,
             coalesce(regexp_matches(content, '[^\s\p{Z}\p{C}\p{M}\x{115F}\x{1160}\x{3164}\x{2800}]'), false) AS visible
      FROM messages
    ), turns AS (
      SELECT *, lag(who) OVER t AS prev_who, lead(who) OVER t AS next_who
      FROM read_roles WHERE visible AND who IN ('u', 'a') AND created_at IS NOT NULL
      WINDOW t AS (PARTITION BY owner, thread_id ORDER BY created_at, id)
    ), flags AS (
      SELECT owner, thread_id, bool_or(coalesce(visible AND who IN ('u', 'a'), false)) AS speaks,
             bool_or(visible AND (who = 'x' OR created_at IS NULL)) AS odd
      FROM read_roles GROUP BY 1, 2
    ), order_flags AS (
      SELECT owner, thread_id, bool_or(who = 'a' AND coalesce(prev_who, 'a') = 'a') AS broken,
             bool_or(who = 'u' AND coalesce(next_who, 'u') = 'u') AS waiting
      FROM turns GROUP BY 1, 2
    ), judged AS (
      SELECT f.owner, f.thread_id,
             CASE WHEN NOT speaks THEN 'empty' WHEN odd OR broken THEN 'broken' WHEN waiting THEN 'no_reply' END AS defect
      FROM flags f LEFT JOIN order_flags o ON f.owner IS NOT DISTINCT FROM o.owner AND f.thread_id IS NOT DISTINCT FROM o.thread_id
    )
"""

# records are flat here; one within another is compared in the tests
_CONTENTS = r"""
    WITH texts AS (
      SELECT row_id, page_content, trim(page_content, chr(65279) || chr(12288) || chr(160) || ' ' || chr(9) || chr(13) || chr(10)) AS t,
             regexp_replace(lower(page_content), '[^\p{L}\p{N}]+', '', 'g') AS flat
      FROM chunk WHERE page_content IS NOT NULL
    ), kept AS (SELECT *, t LIKE '{%}' AND json_valid(t) AS is_json FROM texts WHERE flat <> ''),
    objects AS (
      SELECT row_id, k AS name, json_extract_string(t, '$."' || k || '"') AS value FROM (SELECT row_id, t, unnest(json_keys(t)) AS k FROM kept WHERE is_json)
    ), cut AS (
      SELECT row_id, 1 AS way, unnest(string_split(t, chr(10))) AS part FROM kept WHERE NOT is_json
      UNION ALL SELECT row_id, 2, unnest(string_split_regex(t, '[;；]')) FROM kept WHERE NOT is_json
    ), parts AS (
      SELECT row_id, way, regexp_extract(trim(part, ' ' || chr(9) || chr(13) || chr(10)),
        '(?s)^["''`*-]*\s*([\p{L}_][\p{L}\p{N}_./-]*(?: [\p{L}\p{N}_./-]+)*)\s*["''`*]*\s*[:=：＝](.*)$', ['k', 'v']) AS f
      FROM cut WHERE regexp_matches(part, '\S')
    ), ways AS (
      SELECT row_id, min(way) AS way FROM (
        SELECT row_id, way FROM parts GROUP BY ALL HAVING count(*) > 1 AND bool_and(f.k <> '' AND f.v NOT LIKE '//%')) GROUP BY 1
    ), fields AS (
      SELECT * FROM objects UNION ALL SELECT row_id, f.k, f.v FROM parts JOIN ways USING (row_id, way)
    ), records AS (
      SELECT row_id, chr(1) || array_to_string(list_sort(list(bare(name) || chr(2) || bare(value))), chr(3)) AS root FROM fields GROUP BY 1 HAVING count(*) > 1
    ), rooted AS (SELECT row_id, page_content, flat, root FROM kept LEFT JOIN records USING (row_id)),
    named AS (
      SELECT r.row_id, page_content, coalesce(r.root, n.root, r.flat) AS label
      FROM rooted r LEFT JOIN (SELECT flat, min(root) AS root FROM rooted WHERE root IS NOT NULL GROUP BY 1) n USING (flat)
    ), grouped AS (SELECT row_id, page_content, min(row_id) OVER (PARTITION BY label) AS keep_id, count(*) OVER (PARTITION BY label) AS copies FROM named)
""".replace("bare(name)", r"regexp_replace(lower(name), '[^\p{L}\p{N}]+', '', 'g')").replace(
    "bare(value)", r"regexp_replace(lower(coalesce(value, '')), '[^\p{L}\p{N}]+', '', 'g')"
)

ORACLE_SQL: dict[str, str] = {
    "p6_found": _CONTENTS + "SELECT keep_id, row_id AS copy_id FROM grouped WHERE row_id <> keep_id",
    "p6_collapse": _CONTENTS + "SELECT keep_id, copies, page_content AS content FROM grouped WHERE row_id = keep_id",
    "p3_found": _THREADS + "SELECT owner, thread_id, defect FROM judged WHERE defect IS NOT NULL",
    "p3_turns": _THREADS
    + """SELECT t.owner, t.thread_id, row_number() OVER (PARTITION BY t.owner, t.thread_id ORDER BY created_at, id) - 1 AS turn,
                CASE who WHEN 'u' THEN 'user' ELSE 'assistant' END AS role, content, created_at, id
         FROM turns t JOIN judged j ON t.owner IS NOT DISTINCT FROM j.owner AND t.thread_id IS NOT DISTINCT FROM j.thread_id
         WHERE defect IS NULL""",
    "p5_found": r"""
        SELECT row_id, CASE WHEN regexp_matches(page_content, '[^\s\x0b\x1c-\x1f\x85\p{Z}.,;:!?。，；：！？、]{601,}')
                            THEN 'hard' ELSE 'natural' END AS cut_kind
        FROM chunk WHERE length(page_content) > 600""",
    "p5_tiles": """SELECT row_id, length(page_content)::bigint AS covered, length(page_content) AS until, true AS within_limit, true AS in_place
        FROM chunk WHERE page_content IS NOT NULL""",
    "p8_places": "SELECT doc_id, true AS whole, true AS cut_if_long, true AS fits FROM documents",
    "p7_found": r"""
        WITH texts AS (
          SELECT row_id, regexp_replace(page_content, '[\s\x0b\x1c-\x1f\x85\p{Z}]+', '', 'g') AS t FROM chunk
        ), kept AS (SELECT row_id, t, length(t) AS n FROM texts WHERE regexp_matches(t, '[\p{L}\p{N}]')),
        grams AS (
          SELECT DISTINCT row_id, substr(t, i, 3) AS g FROM (SELECT row_id, t, unnest(range(1, n - 1)) AS i FROM kept)
        ), sizes AS (SELECT row_id, count(*) AS size FROM grams GROUP BY 1),
        shared AS (
          SELECT a.row_id AS row_a, b.row_id AS row_b, count(*) AS in_both
          FROM grams a JOIN grams b ON a.g = b.g AND a.row_id < b.row_id GROUP BY 1, 2
        )
        SELECT row_a, row_b FROM shared JOIN sizes x ON x.row_id = row_a JOIN sizes y ON y.row_id = row_b
        WHERE in_both * 10 >= (x.size + y.size - in_both) * 8
        UNION
        SELECT a.row_id, b.row_id FROM kept a JOIN kept b ON a.t = b.t AND a.row_id < b.row_id""",
    "p7_classes": r"""
        WITH texts AS (
          SELECT row_id, regexp_replace(page_content, '[\s\x0b\x1c-\x1f\x85\p{Z}]+', '', 'g') AS t FROM chunk
        ), classes AS (
          SELECT t, min(row_id) AS class_id, count(*) AS copies FROM texts WHERE regexp_matches(t, '[\p{L}\p{N}]') GROUP BY t
        ), grams AS (
          SELECT DISTINCT class_id, substr(t, i, 3) AS g FROM (SELECT class_id, t, unnest(range(1, length(t) - 1)) AS i FROM classes)
        ), sizes AS (SELECT class_id, count(*) AS size FROM grams GROUP BY 1),
        shared AS (
          SELECT a.class_id AS x, b.class_id AS y, count(*) AS in_both FROM grams a JOIN grams b ON a.g = b.g AND a.class_id <> b.class_id GROUP BY 1, 2
        ), degree AS (
          SELECT x AS class_id, count(*) AS links FROM shared JOIN sizes p ON p.class_id = x JOIN sizes q ON q.class_id = y
          WHERE in_both * 10 >= (p.size + q.size - in_both) * 8 GROUP BY 1
        )
        SELECT row_id, class_id, copies, coalesce(links, 0) AS links FROM texts JOIN classes USING (t) LEFT JOIN degree USING (class_id)""",
    "p9_found": r"""
        WITH docs AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
        items AS (
          SELECT item_id, regexp_replace(lower(passage), '[^\p{L}\p{N}]+', '', 'g') AS t, CASE WHEN lang LIKE 'zh%' THEN 24 ELSE 60 END AS run
          FROM heldout WHERE passage IS NOT NULL
        ), windows AS (
          SELECT DISTINCT item_id, run, substr(t, i, run) AS w FROM (SELECT *, unnest(range(1, length(t) - run + 2)) AS i FROM items)
        ), parts AS (
          SELECT DISTINCT doc_id, run, substr(t, i, run) AS w
          FROM (SELECT doc_id, t, run, unnest(range(1, length(t) - run + 2)) AS i FROM docs CROSS JOIN (SELECT DISTINCT run FROM items))
        )
        SELECT DISTINCT doc_id, item_id FROM parts JOIN windows USING (run, w)""",
}
