"""Documents as markdown notes (with front matter, a heading for each line but the first, and a link to the next) and as printed lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.plans.activity_queries import QUERIES, SQL, query, table
from kelpie.sources import articles, layout, vault

__all__ = ["QUERIES", "SQL"]


def _notes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumns({"id": F.col("doc_id").cast("string"), "source": F.coalesce("source", F.lit(""))})
    part = F.concat(F.lit("\n\n## Part\n\n[["), (F.col("doc_id") + 1).cast("string"), F.lit("#part-2|next]] [up](../x.md)\n- "))
    front = F.concat(F.lit('---\ntitle: "Document '), "id", F.lit('"\naliases: [d'), "id", F.lit(", '"), "source", F.lit("']\n---\n"))
    text = F.concat(front, F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), part))
    return vault.Vault(d.select(F.concat(F.lit("notes/"), "id", F.lit(".md")).alias("path"), F.encode(text, "UTF-8").alias("content")))


_LINES = r"""WITH d AS (SELECT 'notes/' || doc_id || '.md' AS path, doc_id, coalesce(source, '') AS source, '---' || chr(10) || 'title: "Document ' || doc_id || '"' || chr(10) || 'aliases: [d' || doc_id || ', ''' || coalesce(source, '') || ''']' || chr(10) || '---' || chr(10) AS front,
 replace(coalesce(text, ''), chr(10), chr(10) || chr(10) || '## Part' || chr(10) || chr(10) || '[[' || (doc_id + 1) || '#part-2|next]] [up](../x.md)' || chr(10) || '- ') AS body FROM documents),
l AS (SELECT path, unnest(x) AS value, unnest(range(1, len(x) + 1)) + 4 AS line FROM (SELECT path, string_split_regex(body, '\r\n|\n|\r') AS x FROM d)),
c AS (SELECT *, fence OR sum(CAST(fence AS INT)) OVER (PARTITION BY path ORDER BY line) % 2 = 1 AS code FROM (SELECT *, regexp_matches(value, '^ {0,3}(?:`{3,}|~{3,})') AS fence FROM l)),
h AS (SELECT *, CASE WHEN NOT code AND regexp_matches(value, '(?s)^ {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*\z') THEN regexp_replace(regexp_extract(value, '(?s)^ {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*\z', 1), '[*`]+', '', 'g') END AS heading FROM c),
s AS (SELECT *, coalesce(max(CASE WHEN heading IS NOT NULL THEN line END) OVER (PARTITION BY path ORDER BY line), 0) AS section FROM h),
k0 AS (SELECT path, section, heading, CASE WHEN b = '' THEN 'section' ELSE b END AS base FROM (SELECT *, trim(regexp_replace(lower(CASE WHEN heading = '' THEN regexp_extract(path, '(\d+)\.md$', 1) ELSE heading END), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS b FROM s WHERE heading IS NOT NULL)),
k1 AS (SELECT *, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS key1 FROM (SELECT *, row_number() OVER (PARTITION BY path, base ORDER BY section) + CAST(base = 'document' AS INT) AS n FROM k0)),
k2 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY path, key1 ORDER BY section) = 1 THEN key1 ELSE base || '-' || (n + 1) END AS key2 FROM k1),
k AS (SELECT path, section, heading, CASE WHEN row_number() OVER (PARTITION BY path, key2 ORDER BY section) = 1 THEN key2 ELSE key2 || '.' || section END AS key FROM k2),
g AS (SELECT path, section, max(line) AS end_line, coalesce(list(value ORDER BY line) FILTER (heading IS NULL), []) AS x FROM s GROUP BY ALL),
b AS (SELECT path, section, end_line, CASE WHEN section > 0 AND trim(x[1]) = '' THEN x[2:] ELSE x END AS given FROM g)
"""  # noqa: E501


@query(_LINES + """SELECT path, 0 AS section, 'document' AS type, 'document' AS key, regexp_extract(path, '(\\d+)\\.md$', 1) AS heading, 1 AS start_line, 4 + len(string_split_regex(body, '\\r\\n|\\n|\\r')) AS end_line, sha256(body) AS text_hash FROM d
UNION ALL SELECT path, section, 'heading', key, heading, section, end_line, sha256(array_to_string(given, chr(10))) FROM k JOIN b USING (path, section)""")  # fmt: skip
def s15_note_anchors(spark, sf_dir):
    return _notes(spark, sf_dir).anchors()


_PLAIN = "x"
for _pattern, _kept in ((r"\[\[[^|\]]+\|([^\]]+)\]\]", r"\1"), (r"\[\[([^\]]+)\]\]", r"\1"), (r"\[([^\[\]]*)\]\([^)]+\)", r"\1"), (r"^\s{0,3}>\s?", ""), (r"^\s{0,3}[-*+]\s+", ""), (r"^\s{0,3}\d+\.\s+", ""), (r"`{1,3}([^`]+)`{1,3}", r"\1")):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_pattern}', '{_kept}', 'g')"
_STRIPPED = r"regexp_replace({}, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')"


@query(_LINES + rf""", p AS (SELECT path, section, list_filter(list_transform(string_split_regex(array_to_string(list_transform(given, lambda x: CASE WHEN regexp_matches(x, '^\s*#') THEN '' ELSE {_STRIPPED.format(_PLAIN)} END), chr(10)), '\n{{2,}}'), lambda x: {_STRIPPED.format('x')}), lambda x: x <> '') AS parts FROM b)
SELECT path, section, ordinal, text, sha256(text) AS hash FROM (SELECT path, section, unnest(range(len(parts))) AS ordinal, unnest(parts) AS text FROM p)""")  # fmt: skip
def s19_note_chunks(spark, sf_dir):
    return _notes(spark, sf_dir).chunks()


@query(_LINES + r""", w AS (SELECT path, section, 'wikilink' AS type, unnest(regexp_extract_all(value, '\[\[([^\]]+)\]\]', 1)) AS raw FROM s),
m AS (SELECT path, section, 'markdown' AS type, unnest(regexp_extract_all(value, '\[[^\[\]]*\]\([^()\s<>]*\)')) AS raw FROM s WHERE NOT code),
e AS (SELECT path, section, type, CASE WHEN raw LIKE '%|%' THEN regexp_extract(raw, '\|(.*)$', 1) ELSE raw END AS text, regexp_extract(raw, '^[^|]*', 0) AS dst FROM w UNION ALL SELECT path, section, type, regexp_extract(raw, '^\[(.*)\]', 1), regexp_extract(raw, '\((.*)\)$', 1) FROM m),
t AS (SELECT path, section, type, text, CASE WHEN dst LIKE '../%' THEN dst[4:] ELSE 'notes/' || split_part(dst, '#', 1) END AS to_path, CASE WHEN dst LIKE '%#%' THEN split_part(dst, '#', 2) END AS to_anchor FROM e),
o AS (SELECT DISTINCT path, coalesce(key, 'document') AS key, type, text, to_path, to_anchor FROM t LEFT JOIN k USING (path, section))
SELECT o.*, d.path AS to_file FROM o LEFT JOIN d ON to_path || '.md' = d.path""")  # fmt: skip
def s16_note_links(spark, sf_dir):
    return _notes(spark, sf_dir).resolved_links()


@query(_LINES + """SELECT path, 'Document ' || doc_id AS title, array_to_string(list_sort(list_distinct(list_filter([CAST(doc_id AS VARCHAR), 'Document ' || doc_id, 'd' || doc_id, source], lambda a: a <> ''))), '|') AS aliases, sha256(front || body) AS checksum, strlen(front || body) AS length,
'{"aliases":["d' || doc_id || '","' || source || '"],"title":["Document ' || doc_id || '"]}' AS metadata FROM d""")  # fmt: skip
def io6_note_files(spark, sf_dir):
    return _notes(spark, sf_dir).files().withColumn("aliases", F.array_join("aliases", "|"))


_STRIP = r"regexp_replace({}, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')"
_BLOCKS = rf"""WITH l AS (SELECT doc_id, unnest(x) AS raw, unnest(range(len(x))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
t AS (SELECT doc_id, pos, v, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, coalesce(sum(length(v) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 AS before FROM (SELECT doc_id, pos, {_STRIP.format('raw')} AS v FROM l) WHERE v <> ''),
z AS (SELECT *, max(CAST(n > 4 OR before > 140 OR regexp_matches(v, '[@†]|^[0-9*]') OR lower(v) = 'abstract' OR n > 1 AND regexp_matches(v, '(?:^|[^0-9A-Za-z_])[0-9]+(?:$|[^0-9A-Za-z_])') AS INT)) OVER (PARTITION BY doc_id ORDER BY n) AS past FROM t),
k AS (SELECT *, CASE WHEN past = 0 THEN 'title' WHEN lower(v) = 'abstract' OR regexp_matches(v, '^[0-9]+(?:\.[0-9]+)*\s+[A-Z]') OR length(v) < 80 AND len(string_split_regex(v, '[\s\x0b]+')) <= 8 AND right(v, 1) NOT IN ('.', ',', ';') AND v NOT LIKE '%@%' THEN 'heading' ELSE 'paragraph' END AS kind FROM z),
o AS (SELECT *, sum(CASE WHEN kind = 'title' OR kind = 'paragraph' AND before_kind = 'paragraph' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY n) AS before_kind, lead(kind) OVER (PARTITION BY doc_id ORDER BY n) AS next_kind FROM k)),
b AS (SELECT doc_id, CAST(block AS BIGINT) AS block, kind, {_STRIP.format("string_agg(CASE WHEN kind = 'paragraph' AND next_kind = 'paragraph' AND right(v, 1) = '-' THEN left(v, -1) ELSE v || ' ' END, '' ORDER BY n)")} AS text FROM o GROUP BY doc_id, block, kind)
"""  # noqa: E501


def _blocks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return layout.blocks(d, "doc_id", "at", "line")


@query(_BLOCKS + "SELECT * FROM b")
def io13_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir)


@query(_BLOCKS + "SELECT doc_id, string_agg(CASE kind WHEN 'title' THEN '# ' WHEN 'heading' THEN '## ' ELSE '' END || text, chr(10) || chr(10) ORDER BY block) AS markdown FROM b GROUP BY doc_id")
def io13_markdown(spark, sf_dir):
    return layout.markdown(_blocks(spark, sf_dir), "doc_id")


@query(r"""WITH f AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, coalesce(sum(CAST(role = 'assistant' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM conversations),
g AS (SELECT conv_id, l, trim(string_agg(CASE WHEN regexp_matches(t, '^[),.:;?]') THEN t ELSE ' ' || t END, '' ORDER BY turn)) AS text FROM f WHERE t <> '' GROUP BY conv_id, l)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY l) - 1 AS line, text FROM g""")
def io13_lines(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return layout.lines(turns, "conv_id", ["turn"], "text", F.col("role") == "assistant")


@query()
def s22_content_scores(spark, sf_dir):
    return articles.content_scores(table(spark, sf_dir, "pages"), "page_id", F.col("html")).withColumnRenamed("id", "page_id")


@query()
def s25_articles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", articles.article(F.col("html"), F.col("url")).alias("markdown"))
