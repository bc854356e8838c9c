"""Bound queries: corpus maintenance, page layout, chunking, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.session import work_dir
from shelfmark.functions.text import text_lines, tokens
from shelfmark.operators import ingest, layout, quality
from shelfmark.operators.chunking import chunk_docs, chunk_docs_lateral
from shelfmark.plans.bindings import CHUNKS, strip_sql, tokens_sql, with_sql
from shelfmark.plans.registry import query
from shelfmark.sources import chunk_store as store
from shelfmark.sources.corpus import STAGE_SCHEMA, chunks_of, list_corpus, read_eval_jsonl, read_text_docs, read_usage, rows_to_text, union_sheets
from shelfmark.sources.sinks import timed, write_jsonl

PAGE_LINES = 40

# --- logical tables --------------------------------------------------------------------

FILES = """files AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, md5(text) AS hash, doc_id, text FROM documents),
manifest AS (
  SELECT path, CASE WHEN quality = 1 THEN hash ELSE md5(text || '~') END AS hash
  FROM files JOIN (SELECT DISTINCT doc_id, quality FROM labels) USING (doc_id)
  UNION ALL SELECT 'web/' || CAST(page_id AS VARCHAR) || '.txt', md5(html) FROM pages)"""


def files(t):
    d = t["documents"]
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(path.alias("path"), F.md5("text").alias("hash"), "doc_id", "text")


def manifest(t):
    """The last run knew the labelled documents; low-quality ones have changed since; web pages are gone."""
    labels = t["labels"].select("doc_id", "quality").distinct()
    known = files(t).join(labels, "doc_id").select(
        "path", F.when(F.col("quality") == 1, F.col("hash")).otherwise(F.md5(F.concat("text", F.lit("~")))).alias("hash")
    )
    web = t["pages"].select(
        F.concat(F.lit("web/"), F.col("page_id").cast("string"), F.lit(".txt")).alias("path"), F.md5("html").alias("hash")
    )
    return known.unionByName(web)


BLOCKS = """blocks AS (
  SELECT o_custkey AS doc_id, o_orderkey AS page, CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey AS block_no,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN ' ' || l_linestatus || ' '
              ELSE 'part ' || CAST(l_partkey AS VARCHAR) || ' from ' || CAST(l_suppkey AS VARCHAR) END AS text,
         CAST((l_partkey % 60) * 10 AS DOUBLE) AS x0, CAST((l_suppkey * 37) % 800 AS DOUBLE) AS y0,
         CAST((l_partkey % 60) * 10 AS DOUBLE) + l_quantity * 4 AS x1, CAST((l_suppkey * 37) % 800 AS DOUBLE) + 12 AS y1,
         CAST(600 AS DOUBLE) AS page_w, CAST(800 AS DOUBLE) AS page_h
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
boxes AS (SELECT o_custkey AS doc_id, o_orderkey AS page, 100.0::DOUBLE AS bx0, 100.0::DOUBLE AS by0,
          400.0::DOUBLE AS bx1, 500.0::DOUBLE AS by1 FROM orders WHERE o_orderstatus = 'F')"""

IN_BANDS = f"y0 >= page_h * 0.07 AND y1 <= page_h * (1 - 0.07::DOUBLE) AND length({strip_sql('text')}) >= 3"

SUPPRESSED = """free_blocks AS (
  SELECT * FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM boxes x WHERE x.doc_id = b.doc_id AND x.page = b.page
    AND greatest(0.0::DOUBLE, least(x1, bx1) - greatest(x0, bx0)) * greatest(0.0::DOUBLE, least(y1, by1) - greatest(y0, by0))
        / greatest(1e-6::DOUBLE, (x1 - x0) * (y1 - y0)) >= 0.4::DOUBLE))"""


def blocks(t):
    rows = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
    x0 = ((F.col("l_partkey") % 60) * 10).cast("double")
    y0 = ((F.col("l_suppkey") * 37) % 800).cast("double")
    text = F.when(
        (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), F.concat(F.lit(" "), "l_linestatus", F.lit(" "))
    ).otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" from "), F.col("l_suppkey").cast("string")))
    return rows.select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"),
        (F.col("l_linenumber").cast("bigint") * 100000000 + F.col("l_partkey")).alias("block_no"),
        text.alias("text"), x0.alias("x0"), y0.alias("y0"),
        (x0 + F.col("l_quantity") * 4).alias("x1"), (y0 + 12).alias("y1"),
        F.lit(600.0).alias("page_w"), F.lit(800.0).alias("page_h"),
    )


def boxes(t):
    return t["orders"].filter(F.col("o_orderstatus") == "F").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"),
        F.lit(100.0).alias("x0"), F.lit(100.0).alias("y0"), F.lit(400.0).alias("x1"), F.lit(500.0).alias("y1"),
    )


def page_lines(t):
    """Documents as lines, ``PAGE_LINES`` of them to a page."""
    lines = t["documents"].select("doc_id", F.posexplode_outer(text_lines(F.col("text"))).alias("no", "text"))
    return lines.select(
        "doc_id", (F.floor(F.col("no") / PAGE_LINES) + 1).alias("page"), (F.col("no") + 1).alias("chunk_no"), "text"
    )


LINES = f"""lines AS (SELECT doc_id, (no - 1) // {PAGE_LINES} + 1 AS page, no AS chunk_no, line AS text FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents))"""


def doc_pages(t):
    """Pages as slices of the line array; narrow."""
    lines = text_lines(F.col("text"))
    count = F.ceil(F.size(lines) / PAGE_LINES).cast("int")
    pages = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.array_join(F.slice(lines, i * PAGE_LINES + 1, F.lit(PAGE_LINES)), "\n"),
    )
    out = t["documents"].select("doc_id", F.posexplode_outer(pages).alias("no", "text"))
    return out.select("doc_id", (F.col("no") + 1).alias("page"), "text", F.contains("text", F.lit("|")).alias("has_image"))


DOC_PAGES = LINES + """,
doc_pages AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY chunk_no) AS text FROM lines GROUP BY ALL),
profile AS (
  SELECT doc_id, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS total_chars,
         CAST(sum(length(text)) AS BIGINT) // count(*) AS avg_chars,
         round(coalesce(sum(length(regexp_replace(text, '[^\\x{4e00}-\\x{9fff}]', '', 'g')))::DOUBLE / nullif(sum(length(text)), 0), 0), 4) AS cjk_ratio,
         round(count(*) FILTER (WHERE length(""" + strip_sql("text") + """) < 50 AND contains(text, '|'))::DOUBLE / count(*), 4) AS scanned_ratio
  FROM doc_pages GROUP BY doc_id)"""

# --- sources ---------------------------------------------------------------------------


@query("row_text", """
SELECT 'customer.csv::row_' || CAST(c_custkey AS VARCHAR) AS chunk_id, 'customer.csv' AS source, c_custkey AS row,
       concat_ws('；', 'c_name：' || c_name, 'c_nationkey：' || CAST(c_nationkey AS VARCHAR),
                 'c_acctbal：' || CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS VARCHAR),
                 CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'c_mktsegment：' || c_mktsegment END) AS content
FROM customer""")
def row_text(t):
    """Customers as sentences; one segment is blanked so that blank cells drop out."""
    c = t["customer"]
    shown = c.select(
        F.col("c_custkey").alias("row"), "c_name", "c_nationkey", F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "  ").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    return rows_to_text(shown, "customer.csv")


@query("sheet_union", """
WITH s AS (SELECT 0 AS no, c_custkey AS k, 'customers' AS sheet, 'name：' || c_name || '；segment：' || c_mktsegment AS content FROM customer
  UNION ALL SELECT 1, s_suppkey, 'suppliers', 'name：' || s_name || '；nation：' || CAST(s_nationkey AS VARCHAR) FROM supplier)
SELECT 'book.xlsx::row_' || CAST(row AS VARCHAR) AS chunk_id, row, content FROM (
  SELECT content, row_number() OVER (ORDER BY no, k) - 1 AS row FROM s)""")
def sheet_union(t):
    book = union_sheets(
        {
            "customers": t["customer"].select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
            "suppliers": t["supplier"].select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")),
        },
        {"customers": F.col("k"), "suppliers": F.col("k")},
    )
    return rows_to_text(book.drop("k"), "book.xlsx").select("chunk_id", "row", "content")


@query("chunks_by_source", with_sql(CHUNKS) + " SELECT chunk_id, page, doc_type, content FROM chunks WHERE source = 'src3'")
def chunks_by_source(t):
    return chunks_of(t.chunks, "src3").select("chunk_id", "page", "doc_type", "content")


@query("index_stats", with_sql(CHUNKS) + " SELECT doc_type, industry, count(*) AS chunk_count FROM chunks GROUP BY ALL")
def index_stats(t):
    return ingest.index_stats(t.chunks)


# --- incremental ingest ----------------------------------------------------------------


@query("changed_docs", with_sql(FILES) + """
SELECT coalesce(f.path, m.path) AS path, f.hash,
       CASE WHEN f.hash IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'new' WHEN f.hash = m.hash THEN 'unchanged' ELSE 'changed' END AS status
FROM files f FULL OUTER JOIN manifest m ON f.path = m.path""")
def changed_docs(t):
    return ingest.changed_docs(files(t), manifest(t))


@query("chunk_identity", """
WITH f AS (SELECT doc_id, doc_id % 10 + 1 AS page, CASE WHEN doc_id % 7 = 0 THEN 'table' ELSE 'chunk' END AS kind,
  CASE WHEN lang = 'es' THEN '/elsewhere/' ELSE '/corpus/' || lang || '/' || source || '/' END AS dir FROM documents),
p AS (SELECT *, CASE WHEN dir = '/elsewhere/' THEN CAST(doc_id AS VARCHAR) || '.pdf'
                ELSE substr(dir, 9) || CAST(doc_id AS VARCHAR) || '.pdf' END AS name FROM f)
SELECT dir || CAST(doc_id AS VARCHAR) || '.pdf' AS path, page,
       name || '::page_' || CAST(page AS VARCHAR) || '::' || kind || '_' || CAST(doc_id AS VARCHAR) AS chunk_id,
       CASE WHEN dir <> '/elsewhere/' THEN split_part(name, '/', 1) END AS industry
FROM p""")
def chunk_identity(t):
    folder = F.when(F.col("lang") == "es", F.lit("/elsewhere/")).otherwise(
        F.concat(F.lit("/corpus/"), "lang", F.lit("/"), "source", F.lit("/"))
    )
    parts = t["documents"].select(
        F.concat(folder, F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"),
        (F.col("doc_id") % 10 + 1).alias("page"),
        F.when(F.col("doc_id") % 7 == 0, "table").otherwise("chunk").alias("kind"),
        F.col("doc_id").alias("no"),
    )
    return ingest.chunk_identity(parts, "/corpus").select("path", "page", "chunk_id", "industry")


@query("upsert_chunks", with_sql(CHUNKS) + """,
target AS (SELECT chunk_id, source, content || ' old' AS content FROM chunks WHERE doc_id IN (SELECT doc_id FROM labels)),
updates AS (SELECT chunk_id, source, content FROM chunks WHERE industry IN ('en', 'fr'))
SELECT chunk_id, source, md5(content) AS content_md5 FROM updates
UNION ALL SELECT chunk_id, source, md5(content) FROM target WHERE chunk_id NOT IN (SELECT chunk_id FROM updates)""")
def upsert_chunks(t):
    """Labelled chunks exist in an old form; English and French ones arrive twice, the second version wins."""
    target = t.chunks.join(t["labels"].select("doc_id"), "doc_id", "left_semi").select(
        "chunk_id", "source", F.concat("content", F.lit(" old")).alias("content")
    )
    came = t.chunks.filter(F.col("industry").isin("en", "fr"))
    draft = came.select("chunk_id", "source", F.concat("content", F.lit(" draft")).alias("content"), F.lit(1).alias("seq"))
    final = came.select("chunk_id", "source", "content", F.lit(2).alias("seq"))
    merged = ingest.upsert(target, draft.unionByName(final), ["chunk_id"], "seq")
    return merged.select("chunk_id", "source", F.md5("content").alias("content_md5"))


@query("replace_source", with_sql(CHUNKS) + """,
touched AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT chunk_id, source FROM chunks WHERE source NOT IN (SELECT source FROM touched)
UNION ALL SELECT chunk_id, source FROM chunks WHERE source IN (SELECT source FROM touched) AND doc_type = 'text'""")
def replace_source(t):
    """Sources with a toxic document are re-read and hold only their text chunks now."""
    bad = t["labels"].filter("toxic = 1").select("doc_id")
    touched = t["documents"].join(bad, "doc_id", "left_semi").select("source").distinct()
    target = t.chunks.select("chunk_id", "source")
    updates = t.chunks.filter(F.col("doc_type") == "text").select("chunk_id", "source").join(touched, "source", "left_semi")
    return ingest.replace_sources(target, updates, touched)


@query("stored_upsert", with_sql(CHUNKS) + """,
target AS (SELECT chunk_id, source, industry, content || ' old' AS content FROM chunks WHERE doc_id IN (SELECT doc_id FROM labels)),
updates AS (SELECT chunk_id, source, industry, content FROM chunks WHERE industry IN ('en', 'fr')),
merged AS (SELECT * FROM updates UNION ALL SELECT * FROM target WHERE chunk_id NOT IN (SELECT chunk_id FROM updates))
SELECT chunk_id, source, industry, md5(content) AS content_md5 FROM merged WHERE source NOT IN ('src1', 'src2')
UNION ALL SELECT chunk_id, source, industry, md5(content) FROM chunks WHERE source = 'src2' AND doc_type = 'text'""")
def stored_upsert(t):
    """The upsert on a stored table, followed by one that re-reads a source and drops another; read back by its pointer."""
    root, columns = work_dir(t.spark, "chunk-store"), ["chunk_id", "source", "industry", "content"]
    labelled = t.chunks.join(t["labels"].select("doc_id"), "doc_id", "left_semi")
    store.upsert_chunks(labelled.withColumn("content", F.concat("content", F.lit(" old"))).select(*columns), root)
    came = t.chunks.filter(F.col("industry").isin("en", "fr")).select(*columns)
    draft = came.withColumns({"content": F.concat("content", F.lit(" draft")), "seq": F.lit(1)})
    store.upsert_chunks(draft.unionByName(came.withColumn("seq", F.lit(2))), root, seq="seq")
    again = t.chunks.filter("source = 'src2' and doc_type = 'text'").select(*columns)
    now = store.upsert_chunks(again, root, t.spark.sql("SELECT 'src1' AS source"), by="source")
    return store.read_store(t.spark, now).select("chunk_id", "source", "industry", F.md5("content").alias("content_md5"))


@query("store_chunks_by_source", with_sql(CHUNKS) + " SELECT chunk_id, page, doc_type, content FROM chunks WHERE source = 'src3' AND industry = 'en'")
def store_chunks_by_source(t):
    """Chunks of a source and industry from the stored table: one bucket's folder of that industry is read."""
    rows = t.chunks.select("chunk_id", "source", "industry", "page", "doc_type", "content")
    stored = store.upsert_chunks(rows, work_dir(t.spark, "chunk-store"))
    return store.read_store(t.spark, stored, "src3", "en").select("chunk_id", "page", "doc_type", "content")


PACKED = """sized AS (SELECT path, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_chunks FROM files),
packed AS (SELECT path, n_chunks, (last - n_chunks) // {size} AS first_batch, (last - 1) // {size} AS last_batch FROM (
  SELECT path, n_chunks, CAST(sum(n_chunks) OVER (ORDER BY md5(path), path) AS BIGINT) AS last FROM sized))"""


def packed(t):
    sized = files(t).select("path", F.size(text_lines(F.col("text"))).cast("bigint").alias("n_chunks"))
    return ingest.batch_pack(sized, 500)


@query("batch_pack", with_sql(FILES, PACKED.format(size=500)) + " SELECT path, n_chunks, first_batch, last_batch FROM packed")
def batch_pack(t):
    """Lines stand for chunks, 500 to a batch."""
    return packed(t)


@query("manifest_after", with_sql(FILES, PACKED.format(size=500)) + """,
done AS (SELECT path, hash FROM files JOIN packed USING (path) WHERE last_batch <= 3)
SELECT path, hash FROM done UNION ALL SELECT path, hash FROM manifest WHERE path NOT IN (SELECT path FROM done)""")
def manifest_after(t):
    """The run stopped after the fourth batch."""
    return ingest.manifest_after(manifest(t), files(t), packed(t), committed=3)


@query("chunk_docs")
def chunks(t):
    """Documents cut along the separator ladder; checked by properties and a reference case in the tests."""
    return chunk_docs(t["documents"].select("doc_id", "source", "text"))


@query("chunk_words", f"""
WITH RECURSIVE d AS (SELECT doc_id, list_transform({tokens_sql('text')}, lambda w: substr(w, 1, 60)) AS w FROM documents),
l AS (SELECT doc_id, array_to_string(w, ' ') AS text, list_transform(w, lambda x: length(x)) AS len FROM d WHERE len(w) > 0),
c AS (SELECT doc_id, text, list(upto ORDER BY i) AS cuts FROM (
  SELECT doc_id, text, i, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY i) + i - 1 AS BIGINT) AS upto FROM (
    SELECT doc_id, text, unnest(len) AS n, generate_subscripts(len, 1) AS i FROM l)
  UNION ALL SELECT doc_id, text, 0, 0 FROM l) GROUP BY ALL),
walk AS (
  SELECT doc_id, 0 AS no, 1::BIGINT AS tail, len(list_filter(cuts, lambda x: x <= 500)) AS head FROM c
  UNION ALL
  SELECT doc_id, no + 1, first, len(list_filter(cuts, lambda x: x <= cuts[first] + 500)) FROM (
    SELECT doc_id, no, cuts, len(list_filter(cuts, lambda x: x < cuts[head] - 50)) + 1 AS first FROM walk JOIN c USING (doc_id) WHERE head < len(cuts)))
SELECT doc_id, no AS chunk_no, trim(substr(text, cuts[tail]::INT + 1, (cuts[head] - cuts[tail])::INT)) AS content FROM walk JOIN c USING (doc_id)""")
def chunk_words(t):
    """Texts with one level of separators (words of at most 60 characters, a space between two), cut by the table function."""
    words = F.transform(tokens(F.col("text")), lambda w: F.substring(w, 1, 60))
    return chunk_docs_lateral(t["documents"].select("doc_id", F.array_join(words, " ").alias("text")), kind="txt")


# --- layout ----------------------------------------------------------------------------


@query("hf_filter", with_sql(BLOCKS) + f" SELECT doc_id, page, block_no, text, y0 FROM blocks WHERE {IN_BANDS}")
def hf_filter(t):
    return layout.outside_bands(blocks(t)).select("doc_id", "page", "block_no", "text", "y0")


@query("table_suppress", with_sql(BLOCKS, SUPPRESSED) + " SELECT doc_id, page, block_no, text FROM free_blocks")
def table_suppress(t):
    return layout.suppress_table_text(blocks(t), boxes(t)).select("doc_id", "page", "block_no", "text")


READING = f"""body AS (SELECT *, x0 >= page_w / 2 AS is_right FROM free_blocks WHERE {IN_BANDS}),
shape AS (SELECT doc_id, page, coalesce(min(CASE WHEN is_right THEN x0 END) - max(CASE WHEN NOT is_right THEN x1 END)
          > max(page_w) * 0.12::DOUBLE, false) AS two_columns FROM body GROUP BY ALL),
page_texts AS (SELECT doc_id, page, two_columns, count(*) AS n_blocks,
  {strip_sql("string_agg(text, chr(10) ORDER BY CASE WHEN two_columns AND is_right THEN 1 ELSE 0 END, y0, block_no)")} AS page_text
FROM body JOIN shape USING (doc_id, page) GROUP BY doc_id, page, two_columns)"""


def page_texts(t):
    free = layout.suppress_table_text(blocks(t), boxes(t))
    return layout.reading_order(layout.outside_bands(free))


@query("reading_order", with_sql(BLOCKS, SUPPRESSED, READING) + " SELECT doc_id, page, two_columns, n_blocks, page_text FROM page_texts")
def reading_order(t):
    return page_texts(t)


TABLES_MD = """cells AS (SELECT l_orderkey AS table_id, CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey AS row_no,
  CAST(l_linenumber AS VARCHAR) AS c1, 'part ' || CAST(l_partkey AS VARCHAR) AS c2,
  CASE WHEN l_linestatus = 'O' OR l_returnflag = 'N' THEN '' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS c3 FROM lineitem),
tables AS (SELECT table_id, '| line | part | qty |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
  string_agg('| ' || c1 || ' | ' || c2 || ' | ' || c3 || ' |', chr(10) ORDER BY row_no, c3) AS markdown FROM cells GROUP BY table_id)"""


def markdown_tables(t):
    """Order lines as tables: rows have two to four cells, some are NULL, some hold extra white space."""
    li = t["lineitem"]
    qty = F.col("l_quantity").cast("bigint").cast("string")
    two = [F.col("l_linenumber").cast("string"), F.concat(F.lit(" part \t "), F.col("l_partkey").cast("string"))]
    cells = (
        F.when(F.col("l_linestatus") == "O", F.array(*two))
        .when(F.col("l_returnflag") == "N", F.array(*two, F.lit(None).cast("string")))
        .otherwise(F.array(*two, qty, F.lit("spare")))
    )
    rows = li.select(
        F.col("l_orderkey").alias("table_id"),
        (F.col("l_linenumber").cast("bigint") * 100000000 + F.col("l_partkey")).alias("row_no"), cells.alias("cells"),
    )
    head = li.select(F.col("l_orderkey").alias("table_id")).distinct().select(
        "table_id", F.lit(-1).cast("bigint").alias("row_no"), F.array(F.lit("line"), F.lit(" part "), F.lit("qty")).alias("cells")
    )
    return layout.table_markdown(head.unionByName(rows))


@query("table_markdown", with_sql(TABLES_MD) + " SELECT table_id, markdown FROM tables")
def table_markdown(t):
    return markdown_tables(t)


@query("doc_chunks", with_sql(BLOCKS, SUPPRESSED, READING, TABLES_MD, """parts AS (
  SELECT doc_id, page, 'chunk' AS kind, 'text' AS doc_type, page_text AS content FROM page_texts WHERE page_text <> ''
  UNION ALL SELECT o_custkey, table_id, 'table', 'table', markdown FROM tables JOIN orders ON o_orderkey = table_id)""") + """
SELECT 'customers/' || CAST(doc_id AS VARCHAR) || '.pdf::page_' || CAST(page AS VARCHAR) || '::' || kind || '_0' AS chunk_id,
       '/corpus/customers/' || CAST(doc_id AS VARCHAR) || '.pdf' AS source, page, doc_type, 'customers' AS industry, content FROM parts""")
def doc_chunks(t):
    """Text chunks in reading order together with whole tables, one id space per page. A page's text fits into one chunk here."""
    texts = chunk_docs(page_texts(t).select("doc_id", "page", F.col("page_text").alias("text")))
    orders = t["orders"].select(F.col("o_orderkey").alias("table_id"), F.col("o_custkey").alias("doc_id"))
    tables = markdown_tables(t).join(orders, "table_id")

    def parts(df, kind, no, content):
        path = F.format_string("/corpus/customers/%d.pdf", F.col("doc_id"))
        return df.select(path.alias("path"), "page", F.lit(kind).alias("kind"), no.alias("no"), content.alias("content"))

    both = parts(texts, "chunk", F.col("chunk_no"), F.col("content")).unionByName(
        parts(tables.withColumn("page", F.col("table_id")), "table", F.lit(0), F.col("markdown"))
    )
    doc_type = F.when(F.col("kind") == "table", "table").otherwise("text")
    return ingest.chunk_identity(both, "/corpus").select(
        "chunk_id", F.col("path").alias("source"), "page", doc_type.alias("doc_type"), "industry", "content"
    )


@query("page_text", with_sql(LINES) + f""",
joined AS (SELECT doc_id, page, count(*) AS n_chunks, {strip_sql("string_agg(text, chr(10) || chr(10) ORDER BY chunk_no)")} AS page_text
           FROM lines GROUP BY doc_id, page)
SELECT * FROM joined WHERE page_text <> ''""")
def page_text(t):
    return layout.page_text(page_lines(t))


# --- quality ---------------------------------------------------------------------------


@query("doc_profile", with_sql(DOC_PAGES) + " SELECT * FROM profile")
def doc_profile(t):
    p = quality.doc_profile(doc_pages(t))
    return p.withColumns({"cjk_ratio": F.round("cjk_ratio", 4), "scanned_ratio": F.round("scanned_ratio", 4)})


@query("doc_issues", with_sql(DOC_PAGES) + """
SELECT doc_id, concat_ws(' | ', CASE WHEN total_chars < 100 * pages THEN '全量扫描版' END,
  CASE WHEN total_chars >= 100 * pages AND scanned_ratio > 0.3 THEN '部分扫描' END,
  CASE WHEN total_chars >= 100 * pages AND total_chars >= 50 AND cjk_ratio < 0.1 THEN '疑似乱码' END) AS issues FROM profile""")
def doc_issues(t):
    return quality.doc_issues(quality.doc_profile(doc_pages(t))).select("doc_id", "issues")


@query("dup_groups", with_sql(FILES) + """
SELECT hash, path, copies FROM (SELECT *, count(*) OVER (PARTITION BY hash) AS copies FROM files) WHERE copies > 1""")
def dup_groups(t):
    return quality.dup_groups(files(t).select("path", "hash"))


# --- files written from the tables and read back -----------------------------------------


@query("corpus_listing", """
SELECT source, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes,
       CAST(sum(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1) AS BIGINT) AS lines
FROM documents GROUP BY source""")
def corpus_listing(t):
    """The documents as one text file per source: listed by kind and size, then read whole. Files of other kinds are not listed."""
    root = work_dir(t.spark, "corpus")
    rows = t["documents"].select("source", F.coalesce("text", F.lit("")).alias("value"))
    rows.repartition("source").write.partitionBy("source").text(f"{root}/texts")
    rows.limit(1).select("value").write.orc(f"{root}/other")
    found = list_corpus(t.spark, root)
    texts = read_text_docs(t.spark, f"{root}/texts").select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.size(text_lines(F.col("text"))).alias("lines"))
    both = found.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length").join(texts, "path")
    source = F.regexp_extract("path", "source=([^/]+)/", 1)
    # a file ends with a line break, behind which no line begins
    return both.groupBy(source.alias("source")).agg(F.sum("length").alias("bytes"), F.sum(F.col("lines") - 1).cast("bigint").alias("lines"))


@query("eval_jsonl", f"""
SELECT text AS question, text AS ground_truth, 'item_' || CAST(item_id AS VARCHAR) AS source_file, CAST(item_id % 30 AS INT) AS page
FROM benchmark WHERE {strip_sql('text')} <> ''""")
def eval_jsonl(t):
    """Evaluation records exported as JSON lines and read back from among broken, blank and empty ones."""
    path = work_dir(t.spark, "eval")
    b = t["benchmark"]
    write_jsonl(b.select(
        F.col("text").alias("question"), F.col("text").alias("ground_truth"), F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("source_file"),
        (F.col("item_id") % 30).cast("int").alias("page"), F.lit("报告").alias("industry"), F.col("text").alias("chunk_text"),
    ), path)
    broken = F.explode(F.array(F.concat(F.lit('{"question": "'), F.col("item_id").cast("string")), F.lit(""), F.lit('{"question": " "}'), F.lit("no json")))
    b.select(broken.alias("value")).write.mode("append").text(path)
    return read_eval_jsonl(t.spark, path).select("question", "ground_truth", "source_file", "page")


@query("usage_jsonl", """
SELECT 'user-' || CAST(user_id AS VARCHAR) AS username, CAST(event_id AS VARCHAR) AS thread_id, epoch_us(ts) // 1000 AS ms, value AS latency_ms,
       CAST(floor(value) AS BIGINT) AS prompt_tokens, CAST(floor(value * 2) AS BIGINT) AS total_tokens FROM events""")
def usage_jsonl(t):
    """The usage log written as JSON lines and scanned with its record schema; fields that a line lacks are null."""
    path = work_dir(t.spark, "usage")
    e = t["events"]
    write_jsonl(e.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("username"), F.col("event_id").cast("string").alias("thread_id"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("latency_ms"),
        F.floor("value").cast("bigint").alias("prompt_tokens"), F.floor(F.col("value") * 2).cast("bigint").alias("total_tokens"),
    ), path)
    return read_usage(t.spark, path).filter("completion_tokens is null").select(
        "username", "thread_id", F.unix_millis("ts").alias("ms"), "latency_ms", "prompt_tokens", "total_tokens"
    )


@query("timing_log", """
SELECT lang AS stage, CASE WHEN lang = 'es' THEN 'failed: ValueError' ELSE 'success' END AS status, true AS measured, count(*) > 0 AS counted FROM documents GROUP BY lang""")
def timing_log(t):
    """One timing record per language, each around a pass over its documents; one pass fails and is recorded all the same."""
    path = work_dir(t.spark, "timings")
    for (lang,) in t["documents"].select("lang").distinct().collect():
        mine = t["documents"].filter(F.col("lang").eqNullSafe(F.lit(lang)))
        try:
            with timed(t.spark, lang, path, doc_count=mine.count(), lang=lang):
                mine.agg(F.sum(F.length("text"))).first()
                if lang == "es":
                    raise ValueError("the parser gave up")
        except ValueError:
            pass
    log = t.spark.read.schema(STAGE_SCHEMA).json(path)
    return log.select("stage", "status", (F.col("elapsed_s") >= 0).alias("measured"), (F.col("docs_per_sec") > 0).alias("counted"))
