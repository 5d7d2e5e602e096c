"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import heavy, mixing, prose, ranks, tokenizer

WHITE = " \t\r\n"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _frequent(spark: SparkSession, folder: str) -> DataFrame:
    text = F.upper(F.btrim("sequence", F.lit(WHITE)))
    return heavy.frequent_values(table(spark, folder, "read_entries"), F.when(text.rlike(r"\p{L}"), text), 1 / 200)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _frequent(spark, folder).select(F.col("value").alias("sequence"))


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _frequent(spark, folder).select(F.col("value").alias("sequence"), "n_rows")


PCTS = (5, 25, 50, 75, 95)


def _measures() -> dict[str, ranks.Measure]:
    return {
        "quality": ranks.Measure(F.col("quality_scores"), 0, 93),
        "read_length": ranks.Measure(F.col("read_length"), 1),
    }


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = ranks.summaries(table(spark, folder, "read_entries"), F.col("sample"), _measures())
    return ranks.percentiles(found, PCTS).select(
        F.col("grp").alias("sample"), "measure", F.col("pct").cast("int").alias("pct"),
        F.col("pct_value").cast("int").alias("pct_value"),
    )


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode(table(spark, folder, "documents"), F.col("text"), {"doc_id": F.col("doc_id")})


def p7_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every text as its ids spell it."""
    return tokenizer.decode(p7_ids(spark, folder), F.col("ids"), {"doc_id": F.col("doc_id")})


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sizes = tokenizer.count_tokens(
        table(spark, folder, "documents"), F.col("text"), {"doc_id": F.col("doc_id"), "source": F.col("source")}
    )
    return mixing.balance(sizes, mixing.read_targets(table(spark, folder, "source_targets")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1].where("not reachable").select("source")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1]


def p8_copies(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0].where("copies > 0").select("doc_id", "source", "copies")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_scores(spark, folder).where("odd").select("doc_id")


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    return prose.score_pages(table(spark, folder, "documents"), "doc_id")


P3_COUNTS = r"""
WITH v AS (SELECT upper(trim(sequence, chr(32) || chr(9) || chr(13) || chr(10))) AS sequence FROM read_entries),
    told AS (SELECT * FROM v WHERE regexp_matches(sequence, '\p{L}'))
SELECT sequence, count(*) AS n_rows FROM told GROUP BY sequence
HAVING count(*) * 200 > (SELECT count(*) FROM told)
"""

P5_FOUND = """
WITH v AS (
    SELECT sample, 'quality' AS measure, unnest(quality_scores) AS value FROM read_entries
    UNION ALL SELECT sample, 'read_length', read_length FROM read_entries WHERE read_length > 0
), c AS (
    SELECT sample, measure, value, sum(count(*)) OVER (PARTITION BY sample, measure ORDER BY value) AS upto,
        sum(count(*)) OVER (PARTITION BY sample, measure) AS n
    FROM v WHERE sample IS NOT NULL AND (measure <> 'quality' OR value BETWEEN 0 AND 93) GROUP BY sample, measure, value
)
SELECT sample, measure, CAST(pct AS INTEGER) AS pct, CAST(min(value) AS INTEGER) AS pct_value
FROM c, (SELECT unnest([5, 25, 50, 75, 95]) AS pct) WHERE upto * 100 >= pct * n GROUP BY sample, measure, pct
"""

P7_TEXT = "SELECT doc_id, coalesce(text, '') AS text FROM documents"

QUERIES = {
    "p3_found": p3_found,
    "p3_counts": p3_counts,
    "p5_found": p5_found,
    "p7_ids": p7_ids,
    "p7_text": p7_text,
    "p8_found": p8_found,
    "p8_report": p8_report,
    "p8_copies": p8_copies,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
}
ORACLES = {"p3_found": f"SELECT sequence FROM ({P3_COUNTS})", "p3_counts": P3_COUNTS, "p5_found": P5_FOUND, "p7_text": P7_TEXT}
