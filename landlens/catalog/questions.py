"""Parameterised questions, session log and reply parsing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.adhoc import ask, log_entries, parse_reply
from ..session import shared_dir
from ..sources.listings import raw_listings
from ..sources.tables import append_log, read_log
from .checks import RAW
from .registry import query, table


@query(
    "y1_typed_parameters",
    "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_name IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_11') AND n_nationkey > 1 GROUP BY 1 ORDER BY n DESC, n_regionkey LIMIT 3",
)
def y1(spark, d):
    parameters = [
        {"name": "TOP_K", "type": "int", "value": 3},
        {"name": "MIN_KEY", "type": "float", "value": 1},
        {"name": "NAMES", "type": "list", "value": ["NATION_1", "NATION_2", "NATION_3", "NATION_11"]},
    ]
    sql = (
        "SELECT n_regionkey, count(*) AS n FROM nation_rows WHERE array_contains(:NAMES, n_name) AND n_nationkey > :MIN_KEY "
        "GROUP BY n_regionkey ORDER BY n DESC, n_regionkey LIMIT :TOP_K"
    )
    return ask(table(spark, d, "nation"), sql, parameters, name="nation_rows")


@query("y2_input_unchanged", "SELECT count(*) AS before, count(*) AS after, count(*) FILTER (WHERE r_regionkey > 1) AS asked FROM region")
def y2(spark, d):
    region = table(spark, d, "region")
    asked = ask(region, "SELECT count(*) AS asked FROM region_rows WHERE r_regionkey > :k", [{"name": "k", "type": "int", "value": 1}], name="region_rows")
    counted = region.agg(F.count(F.lit(1)).alias("before")).withColumn("after", region.agg(F.count(F.lit(1))).scalar())
    return counted.withColumn("asked", asked.scalar())


@query("y3_row_rules_as_columns", f"{RAW} SELECT src_pos, length(coalesce(description, '')) AS desc_len, length(coalesce(description, '')) - length(replace(coalesce(description, ''), '!', '')) AS exclamation_count FROM listings")
def y3(spark, d):
    f = T.style_features(F.col("description"))
    return raw_listings(spark, d).select("src_pos", f["desc_len"].alias("desc_len"), f["exclamation_count"].alias("exclamation_count"))


_TURNS = """SELECT conv_id, turn, text AS user_prompt, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, role FROM conversations"""


@query(
    "y4_session_entries",
    f"WITH t AS ({_TURNS}) SELECT conv_id, turn, trim(user_prompt) <> trim(answer) AS code_modified, length(substr(answer, 1, 500)) AS summary_length FROM t WHERE role = 'user'",
)
def y4(spark, d):
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = table(spark, d, "conversations").withColumn("answer", nxt).where(F.col("role") == "user")
    entries = turns.select(
        F.format_string("%012d-%06d", "conv_id", "turn").alias("timestamp"), F.col("text").alias("user_prompt"), F.lit("").alias("explanation"),
        F.col("text").alias("generated_code"), F.col("answer").alias("executed_code"), F.col("answer").alias("result_summary"), F.lit("").alias("error"),
    )
    out = log_entries(entries)
    key = F.split("timestamp", "-")
    return out.select(
        key[0].cast("bigint").alias("conv_id"), key[1].cast("bigint").alias("turn"), "code_modified", F.length("result_summary").alias("summary_length")
    )


@query("y4_log_round_trip", f"WITH t AS ({_TURNS}) SELECT printf('%012d-%06d', conv_id, turn) AS \"timestamp\", user_prompt FROM t WHERE role = 'user' ORDER BY 1 DESC LIMIT 20")
def y4_log(spark, d):
    turns = table(spark, d, "conversations").where(F.col("role") == "user")
    stamp = F.format_string("%012d-%06d", "conv_id", "turn")
    empty = [F.lit("").alias(c) for c in ("explanation", "generated_code", "executed_code", "result_summary", "error")]
    path = shared_dir(spark, "log")
    append_log(log_entries(turns.select(stamp.alias("timestamp"), F.col("text").alias("user_prompt"), *empty)), path)
    return read_log(spark, path, 20).select("timestamp", "user_prompt")


@query(
    "y5_reply_parsing",
    """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'df.head()' WHEN 1 THEN 'x = 1' WHEN 2 THEN 'bare' ELSE '' END AS code,
    CASE turn % 4 WHEN 0 THEN 'giải ' || role WHEN 1 THEN 'vì ' || role WHEN 2 THEN 'Không có giải thích.' ELSE trim(text, chr(10) || ' ') END AS explanation,
    CASE turn % 4 WHEN 0 THEN '[{"name":"K","value":3}]' ELSE '[]' END AS parameters FROM conversations""",
)
def y5(spark, d):
    t = F.col("turn") % 4
    reply = (
        F.when(t == 0, F.concat(F.lit('Đây:\n```json\n{"code": "df.head()", "explanation": "giải '), "role", F.lit('", "parameters": [{"name":"K","value":3}]}\n```\nhết')))
        .when(t == 1, F.concat(F.lit("Xem\n```python\nx = 1\n```\n**Giải thích:** vì "), "role"))
        .when(t == 2, F.lit('trước {"code": "bare"} sau'))
        .otherwise(F.col("text"))
    )
    rows = table(spark, d, "conversations").select("conv_id", "turn", parse_reply(reply).alias("r"))
    return rows.select("conv_id", "turn", F.col("r.code").alias("code"), F.col("r.explanation").alias("explanation"), F.col("r.parameters").alias("parameters"))
