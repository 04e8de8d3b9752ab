"""Queries over records: headlines, stories, injection marks, HTML, ingest rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedup as D
from ..sources import bindings as B
from .series_queries import ORDERS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


STOP = ", ".join(f"'{w}'" for w in X.HEADLINE_STOPWORDS)
HEADLINES = f"""heads AS (
    SELECT doc_id AS record_id, source AS source_id, string_split(text, chr(10))[1] AS title FROM documents
), bare AS (
    SELECT *, lower(regexp_replace(strip_accents(coalesce(title, '')), '\\s+[-|–—]\\s+[A-Z][\\p{{L}}\\p{{N}}_ .&''’]{{1,40}}$', '')) AS low FROM heads
), tokened AS (
    SELECT record_id, source_id, list_sort(list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(low, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')), '\\s+'), lambda w: w <> '' AND w NOT IN ({STOP})))) AS tokens FROM bare
), printed AS (
    SELECT *, CASE WHEN len(tokens) >= 3 THEN left(sha256(array_to_string(tokens, ' ')), 32) END AS fingerprint FROM tokened
), stories AS (SELECT fingerprint, any_value(tokens) AS tokens FROM printed WHERE fingerprint IS NOT NULL GROUP BY fingerprint
), near AS (
    SELECT a.fingerprint AS a, b.fingerprint AS b, len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(a.tokens || b.tokens)) AS s
    FROM stories a JOIN stories b ON a.fingerprint < b.fingerprint WHERE len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(a.tokens || b.tokens)) >= 0.7
)"""
LABELS = f"""{HEADLINES}, sym AS (SELECT a, b FROM near UNION SELECT b, a FROM near
), reach AS (SELECT fingerprint AS v, fingerprint AS r FROM stories UNION SELECT reach.v, sym.b FROM reach JOIN sym ON reach.r = sym.a
), labels AS (SELECT v AS fingerprint, min(r) AS story FROM reach GROUP BY v
), told AS (SELECT * FROM printed JOIN labels USING (fingerprint))"""


def _headlines(spark, sf_dir):
    return D.fingerprinted(B.headlines(spark, sf_dir).select("record_id", "source_id", "title"))


def _stories(spark, sf_dir):
    return _headlines(spark, sf_dir).filter("fingerprint is not null").groupBy("fingerprint").agg(F.first("tokens").alias("tokens"))


def _told(spark, sf_dir):
    stories = _stories(spark, sf_dir)
    return _headlines(spark, sf_dir).join(D.story_labels(stories, D.near_pairs(stories)), "fingerprint")


@query(f"WITH {HEADLINES} SELECT record_id, array_to_string(tokens, ' ') AS tokens, fingerprint FROM printed")
def title_fingerprint(spark, sf_dir):
    return _headlines(spark, sf_dir).select("record_id", F.array_join("tokens", " ").alias("tokens"), "fingerprint")


@query(f"WITH {HEADLINES} SELECT a, b, round(s, 4) AS similarity FROM near")
def near_dup_pairs(spark, sf_dir):
    return D.near_pairs(_stories(spark, sf_dir)).select("a", "b", F.round("similarity", 4).alias("similarity"))


@query(f"WITH RECURSIVE {LABELS} SELECT story, count(*) AS records FROM told GROUP BY story")
def story_groups(spark, sf_dir):
    return _told(spark, sf_dir).groupBy("story").agg(F.count("*").alias("records"))


@query(f"WITH RECURSIVE {LABELS} SELECT source_id, CASE WHEN count(*) >= 2 THEN round(1 - count(DISTINCT story) / count(*), 4) ELSE 0 END AS duplication_ratio FROM told GROUP BY source_id")
def dup_ratio(spark, sf_dir):
    return D.duplication(_told(spark, sf_dir), "source_id")


@query(f"WITH RECURSIVE {LABELS} SELECT story, count(*) AS records, count(DISTINCT source_id) AS sources, count(DISTINCT source_id) > 1 AS is_syndicated FROM told GROUP BY story")
def syndicated(spark, sf_dir):
    return D.syndicated(_told(spark, sf_dir))


def _swept() -> str:
    """Texts after each replacement in turn, and how often each pattern was replaced."""
    steps = ["t0 AS (SELECT doc_id, source, regexp_replace(coalesce(text, ''), '[\\x{200B}-\\x{200F}\\x{2028}\\x{2029}\\x{2060}\\x{FEFF}]', '', 'g') AS t FROM documents)"]
    for k, (label, pattern) in enumerate(X.INJECTIONS):
        pattern = pattern.replace("'", "''")
        steps.append(f"t{k + 1} AS (SELECT doc_id, source, regexp_replace(t, '{pattern}', '[neutralised:{label}]', 'g') AS t, '{label}' AS label, len(regexp_extract_all(t, '{pattern}')) AS n FROM t{k})")
    return ", ".join(steps)


HITS = " UNION ALL ".join(f"SELECT doc_id, source, label, n FROM t{k + 1}" for k in range(len(X.INJECTIONS)))


@query(f"""WITH {_swept()}, hits AS ({HITS}), each AS (SELECT doc_id, source, label, sum(n) AS n FROM hits GROUP BY ALL HAVING sum(n) > 0)
SELECT source, label, count(*) AS records, CAST(sum(n) AS BIGINT) AS matches FROM each GROUP BY ALL""")
def injection_sweep(spark, sf_dir):
    return D.injection_sweep(B.table(spark, sf_dir, "documents").select("source", "text"), "source", "text")


@query(f"""WITH {_swept()} SELECT doc_id, md5(trim(CASE WHEN length(t) > 20000 THEN left(t, 20000) || chr(10) || '[truncated]' ELSE t END)) AS digest FROM t{len(X.INJECTIONS)}""")
def neutralised_text(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", F.md5(X.neutralised(F.col("text"))).alias("digest"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<br\s*/?>|</p>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&mdash;', '-'), '&ndash;', '-') AS t FROM b),
d AS (SELECT page_id, array_to_string(list_transform(list_zip(string_split_regex(t, '&#[0-9]+;'), regexp_extract_all(t, '&#([0-9]+);', 1)), lambda x: x[1] || coalesce(CASE WHEN TRY_CAST(x[2] AS BIGINT) < 1114112 THEN chr(CAST(x[2] AS INT)) WHEN x[2] IS NOT NULL THEN ' ' END, '')), '') AS t FROM c)
SELECT page_id, CAST(length(trim(regexp_replace(t, '[ \t]{2,}', ' ', 'g'))) AS BIGINT) AS n_chars, md5(trim(regexp_replace(t, '[ \t]{2,}', ' ', 'g'))) AS digest FROM d""")
def html_text(spark, sf_dir):
    text = X.html_text(F.col("html"))
    return B.table(spark, sf_dir, "pages").select("page_id", F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("digest"))


@query("SELECT source AS source_id, min(doc_id) AS record_id, sha256(text) AS content_hash FROM documents GROUP BY source, text")
def raw_dedup(spark, sf_dir):
    rows = B.table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("record_id"), F.sha2("text", 256).alias("content_hash"))
    return D.first_arrival(rows, ["source_id", "content_hash"], ["record_id"])


@query(f"WITH {ORDERS}, again AS (SELECT series, tick, value, 0 AS arrival FROM orders_obs UNION ALL SELECT series, tick, value + 1, 1 FROM orders_obs) SELECT series, strftime(tick, '%Y-%m-%d') AS month, arg_min(value, arrival) AS value FROM again GROUP BY series, tick")
def obs_dedup(spark, sf_dir):
    obs = B.series(spark, sf_dir, "orders")
    again = obs.withColumn("arrival", F.lit(0)).unionByName(obs.withColumn("value", F.col("value") + 1).withColumn("arrival", F.lit(1)))
    return D.first_arrival(again, ["series", "at"], ["arrival"]).select("series", F.date_format("at", "yyyy-MM-dd").alias("month"), "value")


def _envelopes(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    k = F.col("event_id") % 11
    return e.select(
        "event_id", F.col("event_type").alias("source_id"), F.when(k == 0, "").otherwise(F.col("event_id").cast("string")).alias("external_id"), F.when(k == 1, "odd").when(k.isin(2, 3, 4), "missing").otherwise("ok").alias("status"),
        F.when(k.isin(2, 5), None).otherwise("customer_count_growth").alias("signal_type"), F.when(k == 6, None).otherwise("x").alias("entity_name"),
        F.when(k == 4, None).when(k == 7, F.lit(float("nan"))).otherwise(F.col("value")).alias("metric_value"), F.when(k == 8, "EURO").otherwise("EUR").alias("metric_currency"),
    )


ENVELOPES = """env AS (SELECT event_id, event_type AS source_id, event_id % 11 AS k, value FROM events), judged AS (
    SELECT *, CASE WHEN k = 0 THEN 'missing external_id' WHEN k = 1 THEN 'unknown status' WHEN k = 2 THEN 'gap without series' WHEN k = 3 THEN 'gap with value' WHEN k = 4 THEN NULL
        WHEN k = 5 THEN 'metric without signal_type' WHEN k = 6 THEN 'metric without entity_name' WHEN k = 7 THEN 'metric not finite' WHEN k = 8 THEN 'bad currency' END AS reason FROM env)"""


@query(f"WITH {ENVELOPES} SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM judged GROUP BY ALL")
def validate_reject(spark, sf_dir):
    return _envelopes(spark, sf_dir).groupBy(F.coalesce(D.reject_reason(), F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {ENVELOPES} SELECT source_id, count(*) AS fetched, count(DISTINCT CASE WHEN reason IS NULL THEN event_id // 2 END) AS stored, count(reason) AS rejected,
count(*) - count(reason) - count(DISTINCT CASE WHEN reason IS NULL THEN event_id // 2 END) AS duplicates FROM judged GROUP BY source_id""")
def run_ledger(spark, sf_dir):
    rows = _envelopes(spark, sf_dir).withColumn("reason", D.reject_reason()).withColumn("content", F.floor(F.col("event_id") / 2))
    stored = D.first_arrival(rows.filter("reason is null"), ["source_id", "content"], ["event_id"])
    return D.run_ledger(stored, rows.filter("reason is not null"), rows)


@query("SELECT event_type AS source_id, event_id, (SELECT count(*) FROM events x WHERE x.event_type = e.event_type) > 50 AS truncated FROM events e QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 50")
def capped_run(spark, sf_dir):
    rows = B.table(spark, sf_dir, "events").select(F.col("event_type").alias("source_id"), "event_id", "ts")
    return D.capped(rows, "source_id", ["ts", "event_id"], 50).select("source_id", "event_id", "truncated")


@query("""WITH s AS (SELECT source, CAST(substr(source, 4) AS INT) AS k, count(*) AS n FROM documents GROUP BY source)
SELECT source, CASE WHEN k % 5 = 0 THEN 'demo class' WHEN k % 7 = 1 THEN 'generates its own data' WHEN k % 3 = 2 THEN 'unknown adapter' WHEN k % 3 = 1 THEN 'offline adapter' ELSE 'live' END AS reason, n FROM s""")
def excluded_sources(spark, sf_dir):
    k = F.substring("source", 4, 9).cast("int")
    adapters = spark.createDataFrame([("files", False), ("feed", True), ("demo_mock", False)], "adapter string, needs_network boolean")
    adapter = F.when(k % 7 == 1, "demo_mock").when(k % 3 == 2, "gone").when(k % 3 == 1, "files").otherwise("feed")
    rows = B.table(spark, sf_dir, "documents").select("source", adapter.alias("adapter"), F.when(k % 5 == 0, "demo").alias("source_class")).join(F.broadcast(adapters), "adapter", "left")  # a row for each adapter
    return rows.groupBy("source", F.coalesce(D.live_reason(F.col("adapter"), F.col("source_class"), F.col("needs_network")), F.lit("live")).alias("reason")).agg(F.count("*").alias("n"))
