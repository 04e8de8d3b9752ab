"""What a report may say: the closed list of facts of a subject, and the audit of claims against it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases that promise what nobody can.
FORBIDDEN = ("guaranteed", "guarantee", "sure thing", "can't lose", "cannot lose", "you should buy", "buy now", "invest now", "100x", "next bitcoin", "risk-free", "risk free", "no risk")
FACTUAL = r"[0-9]|(^|[^A-Za-z])[A-Z][a-z]{2,}([^A-Za-z]|$)|%|\$|€"  # a number, name, share or amount


def fact_list(scored: DataFrame, key: str, prefix: str) -> DataFrame:
    """key, fact_id, value: a row for each column of `scored` that starts with the prefix and isn't 0."""
    names = [n for n in scored.columns if n.startswith(prefix)]
    rows = scored.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])).alias("f"))
    return rows.filter("f.value != 0").select(key, F.concat_ws("/", key, "f.name").alias("fact_id"), F.round("f.value", 4).alias("value"))


def audit(claims: DataFrame, facts: DataFrame, least: float = 0.9) -> DataFrame:
    """claims: report, text, evidence_ids; per report: unknown citations, factual and cited claims, the
    citation density, and whether it may stand."""
    cited = claims.select("report", F.explode("evidence_ids").alias("fact_id")).distinct()
    unknown = cited.join(facts.select("fact_id").distinct(), "fact_id", "left_anti").groupBy("report").agg(F.count("*").alias("unknown"))
    factual, has = F.col("text").rlike(FACTUAL), F.size("evidence_ids") > 0
    out = claims.groupBy("report").agg(F.count_if(factual).alias("factual"), F.count_if(factual & has).alias("cited")).join(unknown, "report", "left").fillna({"unknown": 0})
    density = F.when(F.col("factual") == 0, 1.0).otherwise(F.round(F.col("cited") / F.col("factual"), 4))
    return out.withColumn("density", density).withColumn("grounded", (F.col("unknown") == 0) & (F.col("density") >= least))


def forbidden(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, phrase, texts: how many texts of a key hold each forbidden phrase."""
    low = F.lower(text)
    found = F.array_compact(F.array(*[F.when(low.contains(p), p) for p in FORBIDDEN]))
    return texts.select(key, F.explode(found).alias("phrase")).groupBy(key, "phrase").agg(F.count("*").alias("texts"))
