"""Queries over documents, pages and conversations: sections, chunks, tags, tables, facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.operators import text
from limnos.plans.registry import query
from limnos.plans.surrogates import table


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
 h AS (SELECT *, regexp_full_match(line, '\\S+( \\S+){0,3}') AS head FROM l), s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM h)
 SELECT doc_id, CAST(section AS BIGINT) AS section, max(CASE WHEN head THEN line END) AS heading, count(CASE WHEN NOT head THEN 1 END) AS lines, CAST(coalesce(sum(CASE WHEN NOT head THEN length(line) END), 0) AS BIGINT) AS chars FROM s GROUP BY doc_id, section""")
def text_sections(spark, sf_dir):
    """Lines of one to four words are headings."""
    out = text.sections(table(spark, sf_dir, "documents"), "doc_id", "text", F.col("line").rlike(r"^\S+( \S+){0,3}$"))
    return out.select("doc_id", "section", "heading", "lines", (F.length("body") - F.greatest(F.col("lines") - 1, F.lit(0))).cast("long").alias("chars"))


CHUNK_END = "CASE WHEN s + 2000 >= n THEN n WHEN strpos(reverse(substr(x, s + 1001, 1000)), chr(10) || chr(10)) > 0 THEN s + 1999 - strpos(reverse(substr(x, s + 1001, 1000)), chr(10) || chr(10)) ELSE s + 2000 END"


@query(f"""WITH RECURSIVE t AS (SELECT doc_id, text AS x, CAST(length(text) AS BIGINT) AS n FROM documents WHERE length(text) > 0), c AS (SELECT doc_id, x, n, 0 AS chunk, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS before FROM t
  UNION ALL SELECT doc_id, x, n, chunk + 1, greatest(e - 200, s + 1), e FROM (SELECT *, CAST({CHUNK_END} AS BIGINT) AS e FROM c) WHERE e < n), k AS (SELECT *, CAST({CHUNK_END} AS BIGINT) AS e FROM c)
 SELECT doc_id, chunk, CAST(s AS INTEGER) AS start, CAST(e - s AS INTEGER) AS n, CAST(CASE WHEN chunk = 0 THEN 0 ELSE before - s END AS INTEGER) AS overlap_before FROM k""")
def text_chunks(spark, sf_dir):
    out = text.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 2000, 200)
    return out.select("doc_id", "chunk", "start", F.length("chunk_text").alias("n"), "overlap_before")


@query("""SELECT doc_id, substr(sha256(source || '|' || length(text) || '|' || substr(text, 1, 200) || '|' || substr(text, greatest(1, CAST(floor(length(text) / 2) AS BIGINT) - 99), 200) || '|' || substr(text, greatest(1, length(text) - 199), 200)), 1, 16) AS print,
 substr(sha256('https://x.example/' || doc_id), 1, 24) AS key FROM documents""")
def text_fingerprints(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.fingerprint(F.col("source"), F.col("text")).alias("print"), text.doc_key(F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string"))).alias("key"))


@query("""SELECT doc_id, regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}])thing($|[^\\p{L}\\p{N}])') AS a, regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}])oui($|[^\\p{L}\\p{N}])') AS b,
 CAST(regexp_matches(text, '[0-9]{3}') AS INTEGER) + CAST(contains(text, '@') AS INTEGER) + CAST(NOT regexp_matches(text, '[0-9]{3}') AND NOT contains(text, '@') AS INTEGER) AS n FROM documents""")
def text_tags(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    tags = text.tag(F.lit(None).cast("string"), F.col("text"), {"a": ("thing", []), "b": ("oui", [])})
    has = lambda s: F.exists(tags, lambda t: t["slug"] == s)
    return d.select("doc_id", has("a").alias("a"), has("b").alias("b"), F.size(text.categories(F.col("text"), {"number": "[0-9]{3}", "mail": "@"})).alias("n"))


@query("""SELECT page_id, len(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref\\s*=\\s*["'']([^"'']*)', 1)) AS links, array_to_string(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref\\s*=\\s*["'']([^"'']*)', 1), ' ') AS urls,
 length(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))) AS chars FROM pages""")
def text_html_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.size(text.hrefs(F.col("html"))).cast("long").alias("links"), F.array_join(text.hrefs(F.col("html")), " ").alias("urls"), F.length(text.plain(F.col("html"))).cast("long").alias("chars"))


@query("""WITH l AS (SELECT page_id, regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li>', 1) AS c, regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1) AS p FROM pages)
 SELECT page_id, array_to_string(list_transform(c, lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))), ';') AS cells,
 array_to_string(list_transform(p, lambda x: CAST(length(trim(regexp_replace(x, '[|\\s]+', ' ', 'g'))) AS VARCHAR)), ';') AS md FROM l""")
def text_table_rows(spark, sf_dir):
    """The pages' list items as a table's cells, and their paragraphs as a pipe table's rows, whose lengths are told."""
    html = F.col("html")
    li = F.regexp_replace(F.regexp_replace(html, r"(?is)<li\b[^>]*>(.*?)</li>", "<td>$1</td>"), r"(?is)<(ul|ol)\b[^>]*>(.*?)</\1>", "<tr>$2</tr>")
    rows = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), lambda x: F.concat(F.lit("| "), F.regexp_replace(x, r"[|\s]+", " "), F.lit(" |")))
    md = F.transform(text.markdown_rows(F.concat(F.lit("|---|\n"), F.array_join(rows, "\n"))), lambda r: F.length(r[0]).cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.flatten(text.table_cells(li)), ";").alias("cells"), F.array_join(md, ";").alias("md"))


@query("""SELECT user_id, event_type, CAST(floor(value / 10) AS BIGINT) AS fact, count(*) AS agree, max(value) AS confidence FROM events GROUP BY ALL""")
def text_dedupe_facts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor(F.col("value") / 10).alias("fact"), "value")
    return text.dedupe_facts(e, ["user_id", "event_type", "fact"], "value")


@query("""WITH v AS (SELECT user_id, event_type, floor(value / 20) * 20 + 10 AS v, min(event_id) AS fact FROM events GROUP BY ALL),
 e AS (SELECT user_id, event_type, min(v) AS lo, arg_min(fact, v) AS lof, max(v) AS hi, arg_max(fact, v) AS hif FROM v GROUP BY ALL), c AS (SELECT *, abs(v - lo) > 0.15 * greatest(abs(v), abs(lo)) AS a, abs(v - hi) > 0.15 * greatest(abs(v), abs(hi)) AS b FROM v JOIN e USING (user_id, event_type))
 SELECT user_id, event_type, v, fact, CASE WHEN a THEN lo ELSE hi END AS against, CASE WHEN a THEN lof ELSE hif END AS against_fact FROM c WHERE a OR b""")
def text_contradictions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", (F.floor(F.col("value") / 20) * 20 + 10).cast("double").alias("v"), "event_id")
    return text.contradictions(e, ["user_id", "event_type"], "v", "event_id")


@query("""WITH d AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM conversations), n AS (SELECT DISTINCT array_to_string(w[1:2], ' ') AS gram, len(w[1:2]) AS n, conv_id AS slug FROM d WHERE turn = 0 AND len(w) > 0),
 g AS (SELECT DISTINCT conv_id, turn, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT d.*, l.n, unnest(range(1, len(w) - l.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM n) l))
 SELECT conv_id, turn, slug, 0.85::DOUBLE AS confidence FROM g JOIN n USING (gram, n)""")
def text_tag_registry(spark, sf_dir):
    """Every turn is searched for the first two words of every conversation."""
    c = table(spark, sf_dir, "conversations")
    names = c.where("turn = 0").select(F.col("conv_id").alias("slug"), F.array_join(F.slice(text.words_of(F.col("text")), 1, 2), " ").alias("name"), F.lit(False).alias("alias"))
    docs = c.select(F.struct("conv_id", "turn").alias("k"), F.lit(None).cast("string").alias("head"), "text")
    return text.tag_registry(docs, "k", "head", "text", names).select("k.conv_id", "k.turn", "slug", "confidence")


@query("""WITH d AS (SELECT doc_id, 0.5 * (CASE WHEN source IN ('src0','src1') THEN 1.0 ELSE 0.4 END) + 0.3 * least(1.0, length(text) / 5000.0) + 0.1 * (CASE lang WHEN 'en' THEN 1 ELSE 0 END) + 0.1 * coalesce(quality, 0) AS s FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id))
 SELECT doc_id, round(s, 6) AS score FROM d ORDER BY score DESC, doc_id LIMIT 50""")
def text_score_documents(spark, sf_dir):
    q = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = table(spark, sf_dir, "documents").join(q, "doc_id", "left")
    s = text.score_documents(F.when(F.col("source").isin("src0", "src1"), 1.0).otherwise(0.4), F.least(F.lit(1.0), F.length("text") / 5000.0), F.when(F.col("lang") == "en", 1).otherwise(0), F.coalesce("quality", F.lit(0)))
    return d.select("doc_id", F.round(s, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


@query("""WITH t AS (SELECT conv_id, turn, role, length(text) AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, count(*) AS turns, count(CASE WHEN role <> before THEN 1 END) AS changes, CAST(sum(n) AS BIGINT) AS chars FROM t GROUP BY conv_id""")
def text_turns(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, sf_dir, "conversations").withColumn("b", before)
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count(F.when(F.col("role") != F.col("b"), 1)).alias("changes"), F.sum(F.length("text")).cast("long").alias("chars"))
