"""Parameterised questions, session log and reply parsing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

KINDS = {"int": int, "float": float, "str": str}

# Answers used when a reply has no explanation.
NO_EXPLANATION = "Không có giải thích."
NO_DETAIL = "Không có giải thích chi tiết."


def bind_parameters(parameters: Sequence[Mapping]) -> dict:
    """Typed values of question parameters, as arguments for SQL parameter markers."""
    args = {}
    for p in parameters:
        kind, value = p.get("type", "str"), p["value"]
        if kind == "list":
            args[p["name"]] = F.array(*[F.lit(v) for v in value])
        else:
            args[p["name"]] = KINDS.get(kind, str)(value)
    return args


def ask(df: DataFrame, sql: str, parameters: Sequence[Mapping] = (), name: str = "listings") -> DataFrame:
    """Run one SELECT over a table with typed parameters.

    Values travel as parameter markers, never as text. The statement is asked as a subquery, where nothing but a query can
    stand, so it writes and defines nothing; the table's name holds inside it only, and the session's own views stay.
    """
    text = sql.strip().rstrip(";").replace("{", "{{").replace("}", "}}")
    if not text:
        raise ValueError("one SELECT statement is expected")
    try:
        return df.sparkSession.sql(f"WITH `{name}` AS (SELECT * FROM {{asked}}) SELECT * FROM (\n{text}\n)", args=bind_parameters(parameters), asked=df)
    except ParseException as error:
        raise ValueError(f"one SELECT statement is expected: {error}") from error


def records_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON record, null fields included."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("record"))


def log_entries(df: DataFrame) -> DataFrame:
    """Session log rows: a modified flag and a summary of at most 500 characters."""
    return df.select(
        F.col("timestamp"),
        "user_prompt",
        "explanation",
        "generated_code",
        "executed_code",
        (F.btrim("generated_code") != F.btrim("executed_code")).alias("code_modified"),
        F.substring("result_summary", 1, 500).alias("result_summary"),
        F.col("error"),
    )


def parse_reply(text: Column) -> Column:
    """Struct(code, explanation, parameters) of a reply text.

    A JSON object, fenced or bare, gives its fields; else the first fenced Python block
    gives the code and the text behind it the explanation.
    """
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    source = F.coalesce(fenced, text)
    # From the first "{" to the last "}".
    body = F.nullif(F.regexp_extract(source, r"(?s)^[^{]*(\{.*\})", 1), F.lit(""))
    shape = "struct<code:string,explanation:string,parameters:string>"

    def parsed(b: Column) -> Column:
        return F.when(F.try_parse_json(b).isNotNull(), F.from_json(b, shape))

    code = F.btrim(F.regexp_extract(text, r"(?s)```python\s*\n(.*?)```", 1), F.lit(" \t\r\n"))
    marked = F.btrim(F.regexp_extract(text, r"(?s)\*\*Giải thích:\*\*\s*(.*)", 1), F.lit(" \t\r\n"))
    parts = F.split(text, "```")
    tail = F.when(F.size(parts) > 2, F.btrim(F.element_at(parts, -1), F.lit(" \t\r\n"))).otherwise(NO_DETAIL)
    plain = F.struct(
        code.alias("code"),
        F.when(code == "", F.btrim(text, F.lit(" \t\r\n")))
        .when(text.contains("**Giải thích:**"), marked)
        .otherwise(tail)
        .alias("explanation"),
        F.lit("[]").alias("parameters"),
    )
    def pick(o: Column) -> Column:
        return F.when(
            o.isNotNull(),
            F.struct(
                F.coalesce(o["code"], F.lit("")).alias("code"),
                F.coalesce(o["explanation"], F.lit(NO_EXPLANATION)).alias("explanation"),
                F.coalesce(o["parameters"], F.lit("[]")).alias("parameters"),
            ),
        ).otherwise(plain)

    return let(let(body, parsed), pick)
