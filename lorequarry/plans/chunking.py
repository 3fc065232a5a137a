"""Queries on chunking, headings and sections, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from lorequarry.operators import chunking as ck
from lorequarry.operators.scans import running_max
from lorequarry.plans.text import NORMAL
from lorequarry.sources.tables import table


def _docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "source", "text")


def _sectioned(spark, folder):
    docs = _docs(spark, folder)
    return ck.with_section_paths(ck.fixed_windows(docs), docs)


def scan_chunks(spark, folder):
    return table(spark, folder, "chunk").select("row_id", "chunk_id", "source", "section_path", "chunk_index", "start_index", "page_content")


def chunks_per_source(spark, folder):
    return table(spark, folder, "chunk").groupBy("source").agg(F.count(F.lit(1)).alias("chunks"))


def chunk_fixed(spark, folder):
    return ck.fixed_windows(_docs(spark, folder))


def chunk_recursive(spark, folder):
    return ck.recursive_chunks(_docs(spark, folder))


def recursive_cover(spark, folder):
    """What must hold of the recursive pieces of every text: they stand where they say, are short, and leave out blanks only."""
    docs = _docs(spark, folder).select("doc_id", F.col("text").alias("whole"))
    before = W.partitionBy("doc_id").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("start") + F.length("text")
    pieces = ck.recursive_chunks(_docs(spark, folder)).withColumn("before", F.coalesce(F.max(end).over(before), F.lit(0))).join(docs, "doc_id")
    gap = F.expr("substring(whole, before + 1, greatest(start - before, 0))")
    blank = lambda c: F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", "") == ""
    rest = F.expr("substring(max_by(whole, piece), max(start + length(text)) + 1)")
    return pieces.groupBy("doc_id").agg(
        F.every(F.expr("substring(whole, start + 1, length(text)) = text")).alias("in_place"), F.every(F.length("text") <= ck.SIZE).alias("short"),
        (F.every(blank(gap)) & blank(rest)).alias("only_blanks_left_out"),
    )


def headings(spark, folder):
    return ck.headings(_docs(spark, folder))


def section_list(spark, folder):
    return ck.section_list(_docs(spark, folder))


def section_path(spark, folder):
    return _sectioned(spark, folder).select("doc_id", "piece", "section_path")


def enrich_chunks(spark, folder):
    return ck.enrich(_sectioned(spark, folder))


def locate_chunk(spark, folder):
    docs = _docs(spark, folder)
    chunks = ck.fixed_windows(docs).withColumn("cursor", F.greatest(F.col("start") - 250, F.lit(0)))
    return ck.locate(chunks, docs)


def offset_map(spark, folder):
    return ck.mapped_texts(_docs(spark, folder))


def locate_raw(spark, folder):
    docs = _docs(spark, folder)
    chunks = ck.fixed_windows(docs).withColumn("cursor", F.greatest(F.col("start") - 50, F.lit(0)))
    return ck.locate_raw(chunks, docs)


def split_h2(spark, folder):
    return ck.split_at_level(_docs(spark, folder), 2)


def split_h3(spark, folder):
    return ck.split_at_level(_docs(spark, folder), 3, keep_empty=True)


def running_cursor(spark, folder):
    rows = table(spark, folder, "chunk").select("row_id", "source", "chunk_index", "start_index")
    slices = F.floor(F.col("chunk_index") / 64)
    return running_max(rows, ["source"], ["chunk_index", "row_id"], "start_index", slices, "cursor").select("row_id", "cursor")


def longest_chunks(spark, folder):
    return ck.longest_chunks(table(spark, folder, "chunk"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_chunks, chunks_per_source, chunk_fixed, chunk_recursive, recursive_cover, headings, section_list, section_path, enrich_chunks,
        locate_chunk, offset_map, locate_raw, split_h2, split_h3, running_cursor, longest_chunks,
    )
}

_WINDOWS = """WITH fixed AS (
  SELECT doc_id, source, piece::int AS piece, (piece * 250)::int AS start, substr(text, piece * 250 + 1, 300) AS text
  FROM (SELECT *, unnest(range(0, greatest(ceil((length(text) - 50) / 250.0)::bigint - 1, 0) + 1)) AS piece FROM documents WHERE length(text) > 0))"""
_HEADINGS = r"""lines AS (
  SELECT doc_id, n, line, sum(length(line) + 1) OVER w - length(line) - 1 AS pos,
         sum(CASE WHEN regexp_matches(line, '^[\s\p{Z}]*(```|~~~)') THEN 1 ELSE 0 END) OVER w AS fences
  FROM (SELECT doc_id, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL))
  WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
heads AS (
  SELECT doc_id, pos::int AS "offset", length(regexp_extract(line, '^(#{1,6})[\s\p{Z}]', 1))::int AS level,
         regexp_replace(regexp_extract(line, '^#{1,6}[\s\p{Z}]+(.*[^\s\p{Z}])', 1), '[\s\p{Z}]*#*[\s\p{Z}]*$', '') AS title
  FROM lines WHERE fences % 2 = 0 AND regexp_matches(line, '^#{1,6}[\s\p{Z}]+[^\s\p{Z}]'))"""
_PATHS = """paths AS (
  SELECT h.doc_id, h."offset", array_to_string(list(g.title ORDER BY g."offset"), ' > ') AS path
  FROM heads h JOIN heads g ON g.doc_id = h.doc_id AND (g."offset" = h."offset" OR (g."offset" < h."offset" AND g.level < h.level
       AND NOT EXISTS (SELECT 1 FROM heads b WHERE b.doc_id = h.doc_id AND b."offset" > g."offset" AND b."offset" < h."offset" AND b.level <= g.level)))
  GROUP BY 1, 2)"""
_SECTIONED = (
    f"{_WINDOWS}, {_HEADINGS}, {_PATHS}"
    + """, sectioned AS (SELECT f.doc_id, f.source, f.piece, f.text, coalesce(p.path, '') AS section_path
  FROM fixed f ASOF LEFT JOIN paths p ON f.doc_id = p.doc_id AND f.start >= p."offset")"""
)
_STRIP = r"regexp_replace({}, '^[\s\x0b\x1c-\x1f\x85\p{{Z}}]+|[\s\x0b\x1c-\x1f\x85\p{{Z}}]+$', '', 'g')"


_MAPPED = r"""WITH chars AS (
  SELECT doc_id, c, i, regexp_matches(c, '[\s\x0b\x1c-\x1f\x85\p{Z}]') AS blank
  FROM (SELECT doc_id, unnest(x) AS c, unnest(range(0, len(x))) AS i FROM (SELECT doc_id, string_split(text, '') AS x FROM documents WHERE text <> ''))
), shown AS (
  SELECT *, lag(blank) OVER w AS before, max(CASE WHEN NOT blank THEN i END) OVER (PARTITION BY doc_id) AS last_i,
         min(CASE WHEN NOT blank THEN i END) OVER (PARTITION BY doc_id) AS first_i
  FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), mapped AS (
  SELECT doc_id, string_agg(CASE WHEN blank THEN ' ' ELSE c END, '' ORDER BY i) AS body, list(i::int ORDER BY i) AS offsets
  FROM shown WHERE NOT blank OR (NOT coalesce(before, false) AND i BETWEEN first_i AND last_i) GROUP BY 1
)
"""


def _split_sql(mark: str) -> str:
    return f"""
      WITH t AS (SELECT doc_id, text, string_split(chr(10) || text, chr(10) || '{mark} ') AS x FROM documents WHERE text IS NOT NULL),
      p AS (SELECT doc_id, text, x, unnest(range(2, len(x) + 1)) AS i FROM t WHERE len(x) > 1),
      b AS (SELECT doc_id, (i - 1)::int AS part, {_STRIP.format("regexp_extract(x[i], '^[^\\n]*')")} AS title,
                   {_STRIP.format("regexp_replace(x[i], '^[^\\n]*', '')")} AS body FROM p)"""


ORACLE_SQL = {
    "scan_chunks": "SELECT row_id, chunk_id, source, section_path, chunk_index, start_index, page_content FROM chunk",
    "chunks_per_source": "SELECT source, count(*) AS chunks FROM chunk GROUP BY 1",
    "chunk_fixed": _WINDOWS + "SELECT doc_id, source, piece, start, text FROM fixed",
    "recursive_cover": r"""SELECT doc_id, true AS in_place, true AS short, true AS only_blanks_left_out FROM documents
        WHERE regexp_matches(text, '[^\s\x0b\x1c-\x1f\x85\p{Z}]')""",
    "headings": f'WITH {_HEADINGS} SELECT doc_id, "offset", level, title FROM heads',
    "section_list": f'WITH {_HEADINGS}, {_PATHS} SELECT doc_id, "offset", path FROM paths',
    "section_path": _SECTIONED + "SELECT doc_id, piece, section_path FROM sectioned",
    "enrich_chunks": _SECTIONED
    + f""", n AS (SELECT *, {NORMAL.format("text")} AS body, row_number() OVER (ORDER BY doc_id, piece) - 1 AS chunk_index FROM sectioned),
      o AS (SELECT *, row_number() OVER (PARTITION BY source, body ORDER BY chunk_index) - 1 AS occurrence FROM n)
      SELECT doc_id, piece, chunk_index, occurrence, section_path,
             substr(sha1(source || chr(0) || section_path || chr(0) || body || chr(0) || occurrence), 1, 16) AS chunk_id FROM o""",
    "locate_chunk": _WINDOWS
    + f""", n AS (SELECT f.doc_id, piece, greatest(start - 250, 0) AS cur, substr({NORMAL.format("f.text")}, 1, 120) AS needle, {NORMAL.format("d.text")} AS body
                  FROM fixed f JOIN documents d USING (doc_id))
      SELECT doc_id, piece, (CASE WHEN needle = '' THEN cur WHEN instr(substr(body, cur + 1), needle) > 0 THEN cur + instr(substr(body, cur + 1), needle) - 1
             WHEN instr(body, needle) > 0 THEN instr(body, needle) - 1 ELSE cur END)::int AS found FROM n""",
    "offset_map": _MAPPED + "SELECT doc_id, coalesce(body, '') AS body, coalesce(offsets, []) AS offsets FROM documents LEFT JOIN mapped USING (doc_id)",
    "locate_raw": _WINDOWS + _MAPPED.replace("WITH", ",")
    + f""", n AS (SELECT doc_id, piece, greatest(start - 50, 0) AS cur, substr({NORMAL.format("f.text")}, 1, 120) AS needle, body, offsets,
                         len(list_filter(offsets, lambda o: o < greatest(start - 50, 0))) AS ahead FROM fixed f LEFT JOIN mapped USING (doc_id))
      SELECT doc_id, piece, (CASE WHEN needle = '' THEN cur WHEN instr(substr(body, ahead + 1), needle) > 0 THEN offsets[ahead + instr(substr(body, ahead + 1), needle)]
             WHEN instr(body, needle) > 0 THEN offsets[instr(body, needle)] ELSE cur END)::int AS found FROM n""",
    "split_h2": _split_sql("##")
    + """ SELECT doc_id, part, title, body FROM b WHERE body <> ''
          UNION ALL SELECT doc_id, 1, 'full', text FROM t WHERE len(x) = 1""",
    "split_h3": _split_sql("###") + " SELECT doc_id, part, title, body FROM b",
    "running_cursor": """SELECT row_id, max(start_index) OVER (PARTITION BY source ORDER BY chunk_index, row_id ROWS UNBOUNDED PRECEDING) AS cursor
        FROM chunk""",
    "longest_chunks": """
        SELECT source, row_id, size, place::int AS place FROM (
          SELECT source, row_id, length(page_content) AS size, count(*) OVER (PARTITION BY source) AS n,
                 row_number() OVER (PARTITION BY source ORDER BY length(page_content) DESC, chunk_index, row_id) AS place
          FROM chunk WHERE page_content IS NOT NULL) WHERE n >= 2 AND place <= 2""",
}
