"""Queries over conversations, passages and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import memory as A
from ..operators import metrics as M
from . import vector
from .common import table



def _turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text")


def chat_last_n(spark, d):
    return A.last_turns(_turns(spark, d), 3).select("conv_id", "turn", "role")


def chat_max_turns(spark, d):
    """The turns that a limit of 4 drops."""
    t = _turns(spark, d)
    return t.join(A.last_turns(t, 4).select("conv_id", "turn"), ["conv_id", "turn"], "left_anti").select("conv_id", "turn")


def chat_time_retention(spark, d):
    return A.within(_turns(spark, d), 2).select("conv_id", "turn")


def chat_rolling_summary(spark, d):
    return A.rolling_summary(_turns(spark, d), 2)


def _vectors(spark, d):
    """Each turn with an embedding: that of the id its numbers give."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("e"), F.col("embedding").alias("v"))
    return _turns(spark, d).withColumn("e", (F.col("conv_id") * 7 + F.col("turn") * 13) % 500).join(e, "e")


def chat_vector_recall(spark, d):
    """The two newest turns of each conversation and the three others with the nearest vectors."""
    return A.recalled(_vectors(spark, d), 3, 2)


def chat_time_window(spark, d):
    """Turns of the last 20 minutes, with times made from the events of the same number."""
    ts = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, turn * turn * 97)")
    return A.within_time(_turns(spark, d).withColumn("ts", ts), 1200).select("conv_id", "turn")


def chat_custom(spark, d):
    """A rule of one's own: newest turns until 600 characters are used up."""
    return A.custom(_turns(spark, d), lambda age, size, newer: (age == 0) | (newer + size <= 600)).select("conv_id", "turn")


def _store(spark, d):
    """Events as records: put all, put the errors again with a later version, delete the signups, flush the first 100."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("seq"), "ts", F.array("event_type").alias("tags"), F.col("props").alias("text"), F.lit(None).cast("array<float>").alias("v"))
    kind = F.col("tags")[0]
    store = A.ContextStore(e.limit(0).withColumn("deleted", F.lit(False))).put(e)
    again = e.filter(kind == "error").withColumns({"seq": F.col("seq") + 10**7, "text": F.concat(F.lit("again "), F.col("text"))})
    return store.put(again).delete(e.filter(kind == "signup").select((F.col("seq") + 10**8).alias("seq"), "id")).flush(100)


def store_records(spark, d):
    return _store(spark, d).records().select("id", F.array_join("tags", ",").alias("tags"), "text")


def store_get(spark, d):
    ids = table(spark, d, "events").select(F.col("event_id").alias("id"))
    return _store(spark, d).get(ids).select("id", F.coalesce("text", F.lit("none")).alias("text"))


def store_count(spark, d):
    return _store(spark, d).count()


def store_pages(spark, d):
    return _store(spark, d).pages(100).select("id", "page")


def store_search(spark, d):
    """Embeddings as records, searched by every row whose id is divisible by 20."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("v"))
    store = A.ContextStore(e.limit(0).withColumn("deleted", F.lit(False))).put(e)
    return store.search(e.filter("id % 20 = 0"), 5)


def context_time_range(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", "event_type")
    return A.by_range(e, "ts", F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-06").cast("timestamp_ntz"), 100).select("id", "event_type")


def context_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"), F.length(X.truncate(F.col("text"), 200)).cast("bigint").alias("cut"))


def answer_normalize(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(X.answer_tokens(F.col("text")), " ").alias("answer"))


def answer_span(spark, d):
    """Spans of whole texts with a marker at the end: up to the first line end or marker."""
    q = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("  "), "text", F.lit("\nQuestion: more")).alias("raw"), F.concat("text", F.lit("Answer:x")).alias("raw2"))
    return q.select("item_id", X.answer_span(F.col("raw")).alias("span"), X.answer_span(F.col("raw2")).alias("span2"))


def _answers(spark, d):
    """Each item's whole text as prediction; the aliases are the texts of the next two items. The last item has none."""
    b = table(spark, d, "benchmark")
    gold = b.select(F.explode(F.array(F.col("item_id") - 1, F.col("item_id") - 2)).alias("item_id"), F.col("text").alias("alias"))
    return b.join(gold.groupBy("item_id").agg(F.collect_list("alias").alias("aliases")), "item_id", "left").withColumn("p", X.answer_tokens(F.col("text")))


def token_f1(spark, d):
    p, a = F.col("p"), F.col("aliases")
    return _answers(spark, d).select("item_id", F.round(X.f1_aliases(p, a), 6).alias("f1"), X.em_strict(p, a).alias("em_strict"), X.em_contains(p, a).alias("em_contains"))


def rag_averages(spark, d):
    """Averages over the items that have aliases, and how many do."""
    t = token_f1(spark, d)
    return t.agg(F.round(F.avg("f1"), 6).alias("f1"), F.round(F.avg("em_strict"), 6).alias("em_strict"), F.round(F.avg("em_contains"), 6).alias("em_contains"), F.count("f1").alias("n"))


def short_answers(spark, d):
    """Aliases that are in the text: its sixth word on, and one with articles and case; and an empty list."""
    b = table(spark, d, "benchmark").withColumn("words", F.split(F.trim("text"), "\\s+"))
    a = F.when(F.col("item_id") % 3 == 0, F.array(F.concat(F.lit("The "), F.upper(F.array_join(F.slice("words", 6, 2), " "))), F.col("text"))).when(F.col("item_id") % 3 == 1, F.array(F.concat(F.lit("an "), F.get("words", F.lit(5))), F.lit("!"))).otherwise(F.array().cast("array<string>"))
    q = b.select("item_id", X.answer_tokens(F.col("text")).alias("p"), a.alias("aliases"))
    p, a = F.col("p"), F.col("aliases")
    return q.select("item_id", F.round(X.f1_aliases(p, a), 6).alias("f1"), X.em_strict(p, a).alias("em_strict"), X.em_contains(p, a).alias("em_contains"))


def prompt_assembly(spark, d):
    """Each item's first line as question over the texts of the next three items; the last has no passages."""
    b = table(spark, d, "benchmark")
    near = b.select(F.explode(F.array(*[F.col("item_id") - k for k in (1, 2, 3)])).alias("item_id"), F.col("item_id").alias("i"), "text")
    lists = near.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("ps"))
    q = b.join(lists, "item_id", "left").withColumn("passages", F.transform("ps", lambda p: p["text"]))
    return q.select("item_id", X.prompt(X.answer_span(F.col("text")), F.col("passages")).alias("prompt"))


def passage_dedup(spark, d):
    """The first id of each distinct passage, cut at 1,800 characters, numbered in id order within its language."""
    p = table(spark, d, "documents").select("doc_id", "lang", X.truncate(F.col("text"), 1800).alias("cut"))
    first = p.groupBy("lang", F.sha2("cut", 256).alias("key")).agg(F.min("doc_id").alias("doc_id"))
    return A.numbered(first.select("lang", "doc_id"), "doc_id", ("lang",)).select("lang", "doc_id", "number")


def short_answer_join(spark, d):
    """Items joined to labels of documents on trimmed lower text: a left join, misses null."""
    b = table(spark, d, "benchmark").select("item_id", F.lower(F.trim("text")).alias("k"))
    docs = table(spark, d, "documents").select(F.lower(F.trim("text")).alias("k"), "doc_id").groupBy("k").agg(F.min("doc_id").alias("doc_id"))
    return b.join(docs, "k", "left").select("item_id", "doc_id")


def throughput(spark, d):
    """Events per user and day, and the busiest day's share in permille."""
    e = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return e.groupBy("user_id").agg(F.count_distinct("day").alias("days"), F.sum("n").alias("total"), F.floor(F.max("n") * 1000 / F.sum("n")).cast("bigint").alias("peak"))


def agent_latency(spark, d):
    """Operations a second of each agent over its time, and ranks of its latencies (here the value in hundredths): p50, p95, p99."""
    e = table(spark, d, "events").select("user_id", "ts", F.expr("cast(round(value * 100) as bigint)").alias("us"))
    span = F.expr("timestampdiff(SECOND, min(ts), max(ts))")
    rate = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), span.alias("seconds"))
    rate = rate.withColumn("per_hour", F.floor(F.col("n") * 3600 / F.greatest("seconds", F.lit(1))))
    ranks = M.ranked_percentiles(e, "user_id", "us", (0.5, 0.95, 0.99))
    wide = ranks.groupBy("user_id").agg(*[F.max(F.when(F.col("p") == p, F.col("us"))).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)])
    return rate.join(wide, "user_id").select("user_id", "n", "per_hour", "p50", "p95", "p99")


def template(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.replace(F.replace(F.lit("{name} of {segment}"), F.lit("{name}"), F.col("c_name")), F.lit("{segment}"), F.col("c_mktsegment")).alias("prompt"))


def digest(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("sha256"))


TOK = "list_filter(string_split(trim(regexp_replace(lower({c}), '[^a-z0-9_]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the'))"
CUT = "CASE WHEN length({c}) <= {n} THEN {c} WHEN contains(substr({c}, 1, {n}), ' ') THEN regexp_replace(substr({c}, 1, {n}), ' [^ ]*$', '') ELSE substr({c}, 1, {n}) END"
F1 = "CASE WHEN len(p) = 0 OR len({g}) = 0 THEN CASE WHEN len(p) = len({g}) THEN 1.0 ELSE 0.0 END ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter({g}, lambda x: x = t))))), 0) / (len(p) + len({g})) END"
SCORES = f"""n AS (SELECT item_id, p, list_transform(aliases, lambda x: {TOK.format(c='x')}) AS gs FROM a),
s AS (SELECT item_id, CASE WHEN len(gs) > 0 THEN round(list_max(list_transform(gs, lambda g: {F1.format(g='g')})), 6) END AS f1, CASE WHEN len(gs) > 0 THEN CASE WHEN len(list_filter(gs, lambda g: len(g) > 0 AND g = p)) > 0 THEN 1.0 ELSE 0.0 END END AS em_strict,
CASE WHEN len(gs) > 0 THEN CASE WHEN len(list_filter(gs, lambda g: len(g) > 0 AND contains(' ' || array_to_string(p, ' ') || ' ', ' ' || array_to_string(g, ' ') || ' '))) > 0 THEN 1.0 ELSE 0.0 END END AS em_contains FROM n)"""
F1_SQL = f"WITH a AS (SELECT b.item_id, {TOK.format(c='any_value(b.text)')} AS p, list(g.text) FILTER (WHERE g.text IS NOT NULL) AS aliases FROM benchmark b LEFT JOIN benchmark g ON g.item_id IN (b.item_id + 1, b.item_id + 2) GROUP BY 1), {SCORES}"
WORDS = "list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: TRUE)"
SHORT_SQL = f"""WITH w AS (SELECT item_id, text, {WORDS} AS words FROM benchmark),
a AS (SELECT item_id, {TOK.format(c='text')} AS p, CASE item_id % 3 WHEN 0 THEN ['The ' || upper(array_to_string(words[6:7], ' ')), text] WHEN 1 THEN ['an ' || words[6], '!'] ELSE CAST([] AS VARCHAR[]) END AS aliases FROM w), {SCORES}"""
MARK = "coalesce(least(nullif(strpos({c}, chr(10)), 0), nullif(strpos({c}, 'Question:'), 0), nullif(strpos({c}, 'Answer:'), 0)), length({c}) + 1)"
SPAN = "trim(substr({c}, 1, " + MARK + " - 1))"
PROMPTS = f"""WITH q AS (SELECT item_id, {SPAN.format(c="regexp_replace(text, '^[ ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ']+', '')")} AS question FROM benchmark),
p AS (SELECT b.item_id, string_agg('[' || (g.item_id - b.item_id) || '] ' || substr(g.text, 1, 500) || chr(10), '' ORDER BY g.item_id) AS lines FROM benchmark b JOIN benchmark g ON g.item_id BETWEEN b.item_id + 1 AND b.item_id + 3 GROUP BY 1)
SELECT q.item_id, CASE WHEN lines IS NULL THEN 'Answer the question with a short factual phrase (one line).' || chr(10) || 'Question: ' || question || chr(10) || 'Answer:'
ELSE 'Answer the question using only the context below. Reply with a short factual answer (one phrase).' || chr(10) || chr(10) || 'Context:' || chr(10) || lines || chr(10) || 'Question: ' || question || chr(10) || 'Answer:' END AS prompt FROM q LEFT JOIN p USING (item_id)"""
STORE = "WITH e AS (SELECT event_id AS id, event_type, CASE WHEN event_type = 'error' THEN 'again ' || props ELSE props END AS text FROM events WHERE event_type <> 'signup' AND (event_type = 'error' OR event_id > 100))"

QUERIES = {
    "chat_last_n": (chat_last_n, "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i FROM conversations) WHERE i <= 3"),
    "chat_max_turns": (chat_max_turns, "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i FROM conversations) WHERE i > 4"),
    "chat_time_retention": (chat_time_retention, "SELECT conv_id, turn FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) WHERE turn > m - 2"),
    "chat_rolling_summary": (
        chat_rolling_summary,
        "WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 2 AS old FROM conversations) SELECT conv_id, count(*) FILTER (WHERE old) AS summarised, count(*) FILTER (WHERE NOT old) AS kept, CAST(coalesce(sum(length(text)) FILTER (WHERE old), 0) AS BIGINT) AS chars FROM o GROUP BY 1",
    ),
    "chat_vector_recall": (
        chat_vector_recall,
        """WITH t AS (SELECT conv_id, turn, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i FROM conversations JOIN embeddings ON vec_id = (conv_id * 7 + turn * 13) % 500),
        n AS (SELECT t.conv_id, t.turn, row_number() OVER (PARTITION BY t.conv_id ORDER BY round(1.0 - list_dot_product(t.v, l.v) / (sqrt(list_dot_product(t.v, t.v)) * sqrt(list_dot_product(l.v, l.v))), 6), t.turn) AS r FROM t JOIN t l ON l.conv_id = t.conv_id AND l.i = 1 WHERE t.i > 2)
        SELECT conv_id, turn FROM n WHERE r <= 3 UNION SELECT conv_id, turn FROM t WHERE i <= 2""",
    ),
    "chat_time_window": (chat_time_window, "SELECT conv_id, turn FROM (SELECT *, max(turn * turn * 97) OVER (PARTITION BY conv_id) AS m FROM conversations) WHERE turn * turn * 97 >= m - 1200"),
    "chat_custom": (chat_custom, "WITH t AS (SELECT *, row_number() OVER w AS i, sum(coalesce(length(text), 0)) OVER w AS upto FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)) SELECT conv_id, turn FROM t WHERE i = 1 OR upto <= 600"),
    "store_records": (store_records, f"{STORE} SELECT id, event_type AS tags, text FROM e"),
    "store_get": (store_get, f"{STORE} SELECT event_id AS id, coalesce(e.text, 'none') AS text FROM events LEFT JOIN e ON e.id = event_id"),
    "store_count": (store_count, f"{STORE} SELECT count(*) AS n FROM e"),
    "store_pages": (store_pages, f"{STORE} SELECT id, (row_number() OVER (ORDER BY id) - 1) // 100 AS page FROM e"),
    "store_search": (store_search, f"WITH {vector.BASE}, {vector.top_sql(vector.COS, k=5)} SELECT query_id, rank, id, distance FROM found"),
    "context_time_range": (context_time_range, "SELECT event_id AS id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06' ORDER BY ts, event_id LIMIT 100"),
    "context_json": (context_json, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "token_estimate": (token_estimate, f"SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens, CAST(length({CUT.format(c='text', n=200)}) AS BIGINT) AS cut FROM documents"),
    "answer_normalize": (answer_normalize, f"SELECT item_id, array_to_string({TOK.format(c='text')}, ' ') AS answer FROM benchmark"),
    "answer_span": (
        answer_span,
        f"WITH r AS (SELECT item_id, regexp_replace(text, '^[ ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ']+', '') || chr(10) || 'Question: more' AS a, regexp_replace(text, '^[ ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ']+', '') || 'Answer:x' AS b FROM benchmark) SELECT item_id, {SPAN.format(c='a')} AS span, {SPAN.format(c='b')} AS span2 FROM r",
    ),
    "token_f1": (token_f1, f"{F1_SQL} SELECT * FROM s"),
    "rag_averages": (rag_averages, f"{F1_SQL} SELECT round(avg(f1), 6) AS f1, round(avg(em_strict), 6) AS em_strict, round(avg(em_contains), 6) AS em_contains, count(f1) AS n FROM s"),
    "short_answers": (short_answers, f"{SHORT_SQL} SELECT * FROM s"),
    "prompt_assembly": (prompt_assembly, PROMPTS),
    "passage_dedup": (passage_dedup, f"WITH f AS (SELECT lang, {CUT.format(c='text', n=1800)} AS cut, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2) SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS number FROM f"),
    "short_answer_join": (short_answer_join, "WITH k AS (SELECT lower(trim(text)) AS k, min(doc_id) AS doc_id FROM documents GROUP BY 1) SELECT item_id, doc_id FROM benchmark LEFT JOIN k ON k.k = lower(trim(text))"),
    "throughput": (throughput, "WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, count(*) AS days, CAST(sum(n) AS BIGINT) AS total, CAST(max(n) * 1000 // sum(n) AS BIGINT) AS peak FROM e GROUP BY 1"),
    "agent_latency": (
        agent_latency,
        """WITH e AS (SELECT user_id, ts, CAST(round(value * 100) AS BIGINT) AS us FROM events), l AS (SELECT user_id, count(*) AS n, greatest(date_sub('second', min(ts), max(ts)), 1) AS s, list_sort(list(us)) AS v FROM e GROUP BY 1)
        SELECT user_id, n, CAST(n * 3600 // s AS BIGINT) AS per_hour, v[CAST(least(n // 2, n - 1) AS BIGINT) + 1] AS p50, v[CAST(least(floor(n * CAST(0.95 AS DOUBLE)), n - 1) AS BIGINT) + 1] AS p95, v[CAST(least(floor(n * CAST(0.99 AS DOUBLE)), n - 1) AS BIGINT) + 1] AS p99 FROM l""",
    ),
    "prompt_template": (template, "SELECT c_custkey, c_name || ' of ' || c_mktsegment AS prompt FROM customer"),
    "content_digest": (digest, "SELECT page_id, sha256(html) AS sha256 FROM pages"),
}
