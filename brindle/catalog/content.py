"""Queries of documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.catalog.book import Book
from brindle.functions import ranges, text
from brindle.operators import chat
from brindle.sources import blocks, sinks

book = Book()
QUERIES = book.queries


@book("content_paragraphs", """SELECT conv_id, turn, p.i AS ord, p.p AS paragraph FROM (SELECT conv_id, turn, unnest(list_transform(list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x, i: {'i': cast(i - 1 AS INTEGER), 'p': x})) AS p FROM conversations)""")
def _(t):
    c = t.raw("conversations").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return c.select("conv_id", "turn", F.posexplode(text.paragraphs(F.col("text"))).alias("ord", "paragraph"))


@book("content_html_markdown")
def _(t):
    parsed = blocks.parse_html(t.raw("pages").select("page_id", "html"))
    return parsed.select("page_id", F.size("blocks").alias("n_blocks"), blocks.markdown(F.col("blocks")).alias("markdown"))


@book("content_text_markdown", "SELECT conv_id, turn, text AS markdown FROM conversations WHERE NOT regexp_matches(text, '^\\s*$') AND text = trim(text) AND NOT contains(text, chr(10) || chr(10))")
def _(t):
    c = t.raw("conversations").filter("text = trim(text) AND NOT contains(text, '\n\n') AND NOT text RLIKE '^\\\\s*$'")
    return c.select("conv_id", "turn", blocks.markdown(blocks.text_blocks(F.col("text"))).alias("markdown"))


@book("content_search", "SELECT message_id, created_at FROM messages WHERE NOT hidden AND contains(lower(content), 'the')")
def _(t):
    return chat.search(t.messages(), "  THE ").select("message_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@book("content_snippets", """WITH h AS (SELECT message_id, content, instr(lower(content), 'on') AS p, length(content) AS n FROM messages WHERE NOT hidden AND contains(lower(content), 'on'))
SELECT message_id, CASE WHEN greatest(p - 20, 1) > 1 THEN '…' ELSE '' END || substr(content, greatest(p - 20, 1), least(p + 21, n) - greatest(p - 20, 1) + 1) || CASE WHEN least(p + 21, n) < n THEN '…' ELSE '' END AS snippet FROM h""")
def _(t):
    return chat.search(t.messages(), "on", 20).select("message_id", "snippet")


@book("content_context", """WITH v AS (SELECT message_id, content, lag(message_id) OVER w AS b, lead(message_id) OVER w AS a FROM messages WHERE NOT hidden WINDOW w AS (PARTITION BY session_id ORDER BY turn))
SELECT message_id, coalesce(b, '') AS before, coalesce(a, '') AS after FROM v WHERE contains(lower(content), 'er')""")
def _(t):
    m = t.messages()
    return chat.context(m, chat.search(m, "er")).select("message_id", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


@book("content_message_chain", "SELECT s.message_id AS start_id, m.message_id, cast(s.turn - m.turn AS INTEGER) AS distance FROM messages s JOIN messages m ON s.session_id = m.session_id AND m.turn <= s.turn WHERE s.turn = 5")
def _(t):
    m = t.messages()
    return chat.chain(m, m.filter("turn = 5"), levels=6)


@book("content_message_descendants", "SELECT s.message_id AS start_id, m.message_id, cast(m.turn - s.turn AS INTEGER) AS distance FROM messages s JOIN messages m ON s.session_id = m.session_id AND m.turn > s.turn WHERE s.turn = 0")
def _(t):
    m = t.messages()
    return chat.descendants(m, m.filter("turn = 0"))


@book("content_siblings", "SELECT message_id, cast(row_number() OVER (PARTITION BY session_id, p ORDER BY created_at, message_id) - 1 AS INTEGER) AS variant, count(*) OVER (PARTITION BY session_id, p) AS n_variants FROM (SELECT *, turn // 3 AS p FROM messages)")
def _(t):
    return chat.siblings(t.messages().withColumn("parent_id", F.expr("turn div 3"))).select("message_id", "variant", "n_variants")


@book("content_activate", "SELECT message_id, CASE WHEN turn % 2 = 0 THEN true WHEN turn % 3 = 0 THEN false ELSE turn % 5 = 0 END AS is_active FROM messages")
def _(t):
    m = t.messages().withColumn("is_active", F.col("turn") % 5 == 0)
    return chat.activate(m, m.filter("turn % 2 = 0"), m.filter("turn % 3 = 0")).select("message_id", "is_active")


@book("content_latest", "SELECT session_id, max(turn) AS turn FROM messages GROUP BY session_id")
def _(t):
    return chat.latest(t.messages(), ["session_id"]).select("session_id", "turn")


@book("content_recent", "SELECT session_id, turn FROM (SELECT session_id, turn, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS r FROM messages) WHERE r <= 3")
def _(t):
    return chat.recent(t.messages(), 3).select("session_id", "turn")


@book("content_range", "SELECT message_id FROM messages WHERE (created_at > TIMESTAMP '2024-01-01 02:00:00' OR created_at = TIMESTAMP '2024-01-01 02:00:00' AND message_id > '12-0') AND (created_at < TIMESTAMP '2024-01-01 09:00:00' OR created_at = TIMESTAMP '2024-01-01 09:00:00' AND message_id <= '54-0')")
def _(t):
    at = lambda x: F.lit(x).cast("timestamp")
    return chat.after_base(t.messages(), (at("2024-01-01 02:00:00"), F.lit("12-0")), (at("2024-01-01 09:00:00"), F.lit("54-0"))).select("message_id")


@book("content_export", """SELECT session_id, count(*) AS n_messages, string_agg('**' || upper(substr(role, 1, 1)) || substr(role, 2) || '**' || chr(10) || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS markdown FROM messages WHERE NOT hidden GROUP BY session_id""")
def _(t):
    return sinks.conversations(t.messages()).select("session_id", "n_messages", "markdown")


@book("content_export_json", """SELECT session_id, cast(to_json({'session_id': session_id, 'messages': list({'turn': turn, 'message_id': message_id, 'role': role, 'content': content} ORDER BY turn)}) AS VARCHAR) AS json FROM messages GROUP BY session_id""")
def _(t):
    return sinks.conversations(t.messages(), include_hidden=True).select("session_id", "json")


@book("content_quota", """SELECT 'u' || user_id AS user_id, CASE event_type WHEN 'click' THEN 'total' ELSE 'tier' END AS bucket, cast(sum(cast(round(value * 100) AS BIGINT)) AS BIGINT) AS spent_credits, count(*) AS calls, cast(sum(CASE WHEN event_type = 'click' THEN event_id % 100 ELSE 0 END) AS BIGINT) AS tokens FROM events GROUP BY ALL""")
def _(t):
    d = t.events().select(
        F.lit("t").alias("tenant_id"), F.concat(F.lit("u"), "user_id").alias("user_id"), F.lit("day").alias("period_type"), F.lit("2024-01-01").alias("period_start"), F.when(F.col("event_type") == "click", "total").otherwise("tier").alias("bucket"),
        F.round(F.col("value") * 100).cast("long").alias("spent_credits"), F.lit(0).alias("reserved_credits"), (F.col("event_id") % 100).alias("tokens"),
    )
    return chat.quota_usage(d).select("user_id", "bucket", "spent_credits", "calls", "tokens")


def attachments(t):
    p = t.raw("part")
    return p.select(F.col("p_partkey").alias("attachment_id"), F.col("p_size").cast("long").alias("size_bytes"), F.when(F.col("p_partkey") % 5 == 0, "failed").otherwise("ready").alias("status"), F.when(F.col("p_partkey") % 7 == 0, F.lit("2024-01-01")).alias("deleted_at"))


@book("content_attachments", "SELECT l_orderkey AS message_id, l_partkey AS attachment_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_partkey % 7 <> 0")
def _(t):
    links = t.raw("lineitem").select(F.col("l_orderkey").alias("message_id"), F.col("l_partkey").alias("attachment_id"))
    return chat.attach(t.raw("orders").select(F.col("o_orderkey").alias("message_id")), links, attachments(t)).select("message_id", "attachment_id")


@book("content_unreferenced", "SELECT a AS attachment_id FROM (SELECT p_partkey AS a FROM part UNION ALL SELECT -p_partkey FROM part WHERE p_partkey % 11 = 0) WHERE a NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL)")
def _(t):
    # Every eleventh attachment has a second upload, under its negative id, that no message took.
    a = attachments(t)
    links = t.raw("lineitem").select(F.col("l_partkey").alias("attachment_id"))
    return chat.unreferenced(a.unionByName(a.filter("attachment_id % 11 = 0").withColumn("attachment_id", -F.col("attachment_id"))), links).select("attachment_id")


@book("content_storage_used", "SELECT cast(coalesce(sum(p_size), 0) AS BIGINT) AS used_bytes FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0")
def _(t):
    return chat.storage_used(attachments(t))


@book("content_message_counts", "SELECT session_id, count(*) AS n FROM messages GROUP BY session_id")
def _(t):
    return t.messages().groupBy("session_id").agg(F.count("*").alias("n"))


@book("content_text_functions", """SELECT page_id, lower(regexp_replace(regexp_replace(regexp_extract(url, '^https?://([^/]+)', 1), ':[0-9]+$', ''), '^www\\.', '')) AS host,
CASE WHEN page_id % 2 = 0 THEN 'text/html' ELSE 'application/octet-stream' END AS media, CASE WHEN page_id % 2 = 0 THEN substr(replace(url, '.', '_'), 1, 15) || '.html' ELSE substr(replace(url, '.', '_'), 1, 20) END AS cut FROM pages""")
def _(t):
    end = F.when(F.col("page_id") % 2 == 0, ".html").otherwise("")
    plain = F.regexp_replace("url", r"\.", "_")
    p = t.raw("pages").withColumn("name", F.concat(plain, end))
    cut = text.truncate_name(F.col("name"), 20)
    return p.select("page_id", text.alias(F.regexp_extract("url", "^https?://([^/]+)", 1)).alias("host"), text.media_by_name(F.col("name")).alias("media"), cut.alias("cut"))


@book("content_reactions", """SELECT 'u' || user_id AS user_id, event_id % 100 AS message_id, max_by(event_type, event_id) AS reaction FROM events WHERE user_id % 2 = 0 GROUP BY ALL HAVING max_by(event_type, event_id) <> 'error'""")
def _(t):
    e = t.events()
    given = F.when(F.col("event_type") != "error", F.col("event_type"))
    rows = e.select(F.concat(F.lit("u"), "user_id").alias("user_id"), (F.col("event_id") % 100).alias("message_id"), given.alias("reaction"), F.col("event_id").alias("reacted_at"))
    return chat.reactions_of(rows, e.filter("user_id % 2 = 0").select(F.concat(F.lit("u"), "user_id").alias("user_id")))


@book("content_citations", "SELECT l_orderkey AS message_id, l_linenumber AS n, 'f' || l_partkey AS file_id, CASE WHEN l_partkey % 4 <> 0 THEN l_partkey END AS attachment_id FROM lineitem")
def _(t):
    file = lambda k: F.concat(F.lit("f"), k)
    cited = t.raw("lineitem").select(F.col("l_orderkey").alias("message_id"), F.col("l_linenumber").alias("n"), file("l_partkey").alias("file_id"))
    files = t.raw("part").filter("p_partkey % 4 <> 0").select(file("p_partkey").alias("file_id"), F.col("p_partkey").alias("attachment_id"))
    return chat.cite(cited, files)


@book("content_retrieval_mode", "SELECT o_orderkey AS session_id, CASE WHEN o_orderkey % 5 = 0 OR n IS NULL THEN 'none' ELSE 'unrestricted' END AS mode FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_partkey % 5 = 1 GROUP BY 1) ON o_orderkey = l_orderkey")
def _(t):
    ready = t.raw("lineitem").filter("l_partkey % 5 = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    chats = t.raw("orders").select("o_orderkey").join(ready, "o_orderkey", "left")
    return chats.select(F.col("o_orderkey").alias("session_id"), chat.retrieval_mode(F.col("o_orderkey") % 5 == 0, F.col("n")).alias("mode"))


@book("content_byte_ranges", """WITH r AS (SELECT page_id, cast(octet_length(encode(html)) AS BIGINT) AS n, page_id % 50 AS a, page_id % 6 AS k FROM pages)
SELECT page_id, cast(CASE k WHEN 0 THEN 206 WHEN 1 THEN 206 WHEN 2 THEN 206 WHEN 3 THEN 416 ELSE 200 END AS INTEGER) AS status,
CASE k WHEN 0 THEN a WHEN 1 THEN a WHEN 2 THEN greatest(0, n - a - 1) WHEN 3 THEN NULL ELSE 0 END AS first, CASE k WHEN 0 THEN least(a + 9, n - 1) WHEN 3 THEN NULL ELSE n - 1 END AS last FROM r""")
def _(t):
    p = t.raw("pages").select("page_id", F.octet_length("html").cast("long").alias("n"), (F.col("page_id") % 50).alias("a"), (F.col("page_id") % 6).alias("k"))
    asked = (
        F.when(F.col("k") == 0, F.format_string("bytes=%d-%d", "a", F.col("a") + 9)).when(F.col("k") == 1, F.format_string("bytes=%d-", "a")).when(F.col("k") == 2, F.format_string("bytes=-%d", F.col("a") + 1))
        .when(F.col("k") == 3, F.format_string("bytes=%d-", "n")).when(F.col("k") == 4, F.lit("bytes=0-1,5-9"))
    )
    return p.select("page_id", ranges.byte_range(asked, F.col("n")).alias("r")).select("page_id", "r.status", "r.first", "r.last")
