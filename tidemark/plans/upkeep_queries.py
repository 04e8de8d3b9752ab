"""Queries over the upkeep of entities and topics: customers as entities, parts as members of topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as E
from ..operators import upkeep as U
from ..sources import bindings as B

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
c = F.col


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _shown(ids):
    return F.array_join(F.array_sort(F.transform(F.map_entries(ids), lambda e: F.concat_ws("=", e["key"], e["value"]))), "|")


@query("""SELECT c_custkey AS id, array_to_string(list_sort(list_filter([
    CASE WHEN c_custkey % 2 = 0 THEN 'sec_cik=' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') END, CASE WHEN c_custkey % 3 = 0 THEN 'iso_country=' || upper(left(c_mktsegment, 2)) END,
    CASE WHEN c_custkey % 5 = 0 THEN 'package_name=' || lower(c_mktsegment) END, CASE WHEN c_custkey % 4 = 0 THEN 'ticker_exchange=X' || c_nationkey || ':T' || c_custkey WHEN c_custkey % 7 = 0 THEN 'ticker_exchange=NYSE:A' || c_custkey END,
    CASE WHEN c_custkey % 11 = 0 THEN 'chain_address=eth:0x' || c_custkey END], lambda x: x IS NOT NULL)), '|') AS ids FROM customer""")
def entity_identifiers(spark, sf_dir):
    k, seg = c("c_custkey"), c("c_mktsegment")
    text = lambda test, v: F.when(test, v)
    loose = F.create_map(
        F.lit("sec_cik"), text(k % 2 == 0, F.concat(F.lit(" "), k.cast("string"))), F.lit("iso_country"), text(k % 3 == 0, F.lower(F.left(seg, F.lit(2)))),
        F.lit("package_name"), text(k % 5 == 0, seg), F.lit("ticker"), text(k % 2 == 0, F.concat(F.lit("t"), k.cast("string"))), F.lit("exchange"), text(k % 4 == 0, F.concat(F.lit("x"), c("c_nationkey").cast("string"))),
        F.lit("ticker_exchange"), text((k % 7 == 0) & (k % 4 != 0), F.concat(F.lit("nyse:a"), k.cast("string"))), F.lit("chain"), text(k % 11 == 0, F.lit("ETH")), F.lit("contract_address"), F.concat(F.lit("0X"), k.cast("string")),
    )
    return B.table(spark, sf_dir, "customer").select(k.alias("id"), _shown(U.identifiers(loose)).alias("ids"))


@query("SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_returnflag = 'R' AND least(x.l_partkey, x.l_suppkey) = least(l.l_partkey, l.l_suppkey) AND greatest(x.l_partkey, x.l_suppkey) = greatest(l.l_partkey, l.l_suppkey))")
def undecided_candidates(spark, sf_dir):
    lines = B.table(spark, sf_dir, "lineitem")
    ruled = lines.filter("l_returnflag = 'R'").select(c("l_suppkey").alias("a"), c("l_partkey").alias("b"))
    return U.undecided(lines.select(c("l_partkey").alias("a"), c("l_suppkey").alias("b")).distinct(), ruled)


#: Each of three in seven entities is merged into the one before it, so that chains lead to the first of four.
ENTITY = "CASE WHEN e % 7 IN (3, 4, 5) THEN e - e % 7 + 2 ELSE e END"


def _merges(spark, sf_dir):
    ids = B.table(spark, sf_dir, "customer").select((c("c_custkey") % 700).alias("duplicate")).distinct()
    return ids.filter("duplicate % 7 in (3, 4, 5)").withColumn("survivor", c("duplicate") - 1)


@query(f"""WITH a AS (SELECT 'n' || c_custkey % 300 AS normalized, c_mktsegment AS entity_type, c_custkey % 700 AS e, min(c_name) AS alias FROM customer GROUP BY ALL)
SELECT normalized, entity_type, {ENTITY} AS entity_id, arg_min(alias, CAST(e % 7 IN (3, 4, 5) AS INT) || alias) AS alias FROM a GROUP BY ALL""")
def merged_aliases(spark, sf_dir):
    k = c("c_custkey")
    rows = B.table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("n"), (k % 300).cast("string")).alias("normalized"), c("c_mktsegment").alias("entity_type"), (k % 700).alias("entity_id")).agg(F.min("c_name").alias("alias"))
    return U.merged_aliases(rows, _merges(spark, sf_dir)).select("normalized", "entity_type", "entity_id", "alias")


@query(f"""WITH own AS (SELECT c_custkey % 700 AS e, c_mktsegment AS kind, min(c_name) AS value FROM customer GROUP BY ALL),
one AS (SELECT {ENTITY} AS entity_id, kind, arg_min(value, (e % 7 IN (3, 4, 5))::INT * 10000 + e) AS value FROM own GROUP BY ALL)
SELECT entity_id, string_agg(kind || '=' || value, '|' ORDER BY kind) AS ids FROM one GROUP BY entity_id""")
def merged_identifiers(spark, sf_dir):
    own = B.table(spark, sf_dir, "customer").groupBy((c("c_custkey") % 700).alias("entity_id"), c("c_mktsegment").alias("kind")).agg(F.min("c_name").alias("value"))
    entities = own.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "value"))).alias("ids"))
    return U.merged_identifiers(entities, _merges(spark, sf_dir)).select("entity_id", _shown(c("ids")).alias("ids"))


@query(f"""SELECT {ENTITY} AS entity_id, count(*) AS observations, count(DISTINCT e) AS merged, round(sum(o_totalprice), 2) AS total FROM (SELECT o_custkey % 700 AS e, o_totalprice FROM orders) GROUP BY 1""")
def merged_series(spark, sf_dir):
    """Orders as readings of entities, behind the merges: those of a chain are one series."""
    rows = B.table(spark, sf_dir, "orders").select((c("o_custkey") % 700).alias("entity_id"), (c("o_custkey") % 700).alias("was"), "o_totalprice")
    sums = [F.count("*").alias("observations"), F.countDistinct("was").alias("merged"), F.round(F.sum("o_totalprice"), 2).alias("total")]
    return E.merged(rows, _merges(spark, sf_dir)).groupBy("entity_id").agg(*sums)


@query("""WITH held AS (SELECT lower(c_name) AS raw, c_mktsegment AS entity_type, min(c_custkey) AS entity_id FROM customer WHERE c_custkey % 3 <> 0 GROUP BY ALL)
SELECT entity_type, entity_id, 'held' AS how FROM held UNION ALL SELECT c_mktsegment, c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0""")
def alias_upkeep(spark, sf_dir):
    """A third of the customers come as new names beside those that are held; each of the others comes once more."""
    from ..functions.text import normal_name

    rows = B.table(spark, sf_dir, "customer").select(c("c_custkey").alias("entity_id"), c("c_mktsegment").alias("entity_type"), c("c_name").alias("alias"))
    held = rows.filter("entity_id % 3 != 0").select(normal_name(c("alias")).alias("normalized"), "entity_type", "entity_id", "alias")
    again = rows.select((c("entity_id") + F.when(c("entity_id") % 3 == 0, 0).otherwise(1_000_000)).alias("entity_id"), "entity_type", "alias")
    found = U.with_aliases(held, again)
    return found.select("entity_type", "entity_id", F.when(c("entity_id") % 3 == 0, "new").otherwise("held").alias("how"))


@query("""WITH w AS (SELECT p_partkey // 8 AS topic, p_partkey AS id, unnest(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+'))) AS word FROM part), n AS (SELECT p_partkey // 8 AS topic, count(*) AS n FROM part GROUP BY 1),
k AS (SELECT topic, word, count(*) AS k, any_value(n) AS n, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, word) AS place FROM w JOIN n USING (topic) GROUP BY topic, word),
s AS (SELECT topic, list(word ORDER BY word) FILTER (k = n) AS every, list(word ORDER BY place) FILTER (place <= 3 AND k >= 0.6 * n) AS often, arg_min(word, lpad(CAST(100 - k AS VARCHAR), 3, '0') || word) FILTER (length(word) > 3 AND k < n) AS longer FROM k GROUP BY topic),
t AS (SELECT topic, coalesce(every, often) AS shared, longer FROM s WHERE coalesce(every, often) IS NOT NULL),
kinds AS (SELECT topic, kind FROM (SELECT p_partkey // 8 AS topic, list_value('product', 'industry', 'keyword', 'odd')[p_size % 4 + 1] AS kind FROM part) GROUP BY topic, kind QUALIFY row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, kind) = 1)
SELECT topic, array_to_string(shared, '|') AS shared, CASE kind WHEN 'product' THEN 'import_distribution' WHEN 'odd' THEN 'technology' ELSE 'business' END AS category,
    array_to_string(list_transform(shared[1:3], lambda w: CASE WHEN length(w) <= 3 THEN upper(w) ELSE upper(w[1]) || w[2:] END) || CASE WHEN len(shared) = 1 AND length(shared[1]) <= 3 AND longer IS NOT NULL THEN [upper(longer[1]) || longer[2:]] ELSE [] END, ' ') AS label
FROM t JOIN kinds USING (topic)""")
def topic_attributes(spark, sf_dir):
    """Every eight parts in a row as a topic: what their names share."""
    p = B.table(spark, sf_dir, "part").select((c("p_partkey") / 8).cast("bigint").alias("topic"), c("p_partkey").alias("id"), c("p_name").alias("name"), F.get(F.array(*map(F.lit, ("product", "industry", "keyword", "odd"))), c("p_size") % 4).alias("entity_type"))
    words = p.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("word"))
    return U.topic_attributes(p, words)


@query("""SELECT p_partkey AS key, array_to_string(list_filter([CASE WHEN p_size % 6 < 3 THEN 'signal_types' END, CASE WHEN p_partkey % 4 < 2 THEN 'sources' END, CASE WHEN p_size / 50 < 0.5 THEN 'confidence' END,
    CASE WHEN p_partkey % 60 > 30 THEN 'age' END, CASE WHEN p_size % 5 = 0 THEN 'stage' END, CASE WHEN p_partkey % 10 = 0 THEN 'blocking' END], lambda x: x IS NOT NULL), '|') AS reasons FROM part""")
def first_gate(spark, sf_dir):
    p, size, none = c("p_partkey"), c("p_size"), F.array().cast("array<string>")
    rows = B.table(spark, sf_dir, "part").select(
        p.alias("key"), (size % 6).alias("signal_types"), (p % 4).alias("sources"), (size / 50).alias("confidence"), (p % 60).alias("newest_days"),
        F.when(size % 5 == 0, "mature").otherwise("emerging").alias("stage"), F.when(p % 10 == 0, F.array(F.lit("fraud"))).otherwise(none).alias("blocking"),
    )
    return U.first_gate(rows, 3, 2, 0.5, 30).select("key", F.array_join("reasons", "|").alias("reasons"))


@query(None)  # folding depends on the order of what it has folded; a test holds it against a plain loop
def greedy_stories(spark, sf_dir):
    """The newest 200 first lines of each source's documents, folded to stories."""
    title = F.substring_index("text", "\n", 1)
    rows = B.table(spark, sf_dir, "documents").select(c("source").alias("subject"), c("doc_id").alias("record_id"), c("lang").alias("source_id"), title.alias("title"), c("doc_id").alias("at"))
    return U.greedy_stories(rows)
