"""The functions as SQL functions (§2.13): inlined SQL where they are plain expressions, Arrow functions elsewhere."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docevidence.functions import labs, routing, text

# Fixed names; each body is plain SQL, which Catalyst inlines into the query that calls it.
SCALARS = {
    "normalize_text(t STRING) RETURNS STRING": r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\r\\n?', '\n'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', ''), '[ \\t\\f\\x0B\\x{00A0}]+', ' '), ' *\\n *', '\n'), '\\n{3,}', '\n\n'), '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+\\z', '')",
    "eval_normalize(t STRING) RETURNS STRING": r"trim(regexp_replace(regexp_replace(lower(t), '[^a-z0-9.%<>/ ]+', ' '), ' +', ' '))",
    "normalize_flag(f STRING) RETURNS STRING": "CASE WHEN lower(trim(f)) IN ('h', 'hi', 'high', '↑', '*h', 'above') THEN 'High' WHEN lower(trim(f)) IN ('l', 'lo', 'low', '↓', '*l', 'below') THEN 'Low' WHEN lower(trim(f)) IN ('n', 'normal', 'within range', 'wnl') THEN 'Normal' WHEN lower(trim(f)) IN ('critical', 'panic', 'c', 'hh', 'll') THEN 'Critical' ELSE trim(f) END",
    "result_number(v STRING) RETURNS DOUBLE": r"try_cast(replace(regexp_replace(regexp_extract(trim(v), '^(-?\\d+(?:[.,]\\d+)?)(?:\\s*[^\\d<>=≤≥].*)?\\z', 1), ',(?=\\d{3}\\b)', ''), ',', '.') AS DOUBLE)",
}




def _quoted(pattern: str) -> str:
    """A pattern as a raw SQL string."""
    return f'r"{pattern}"' if '"' not in pattern else f"r'{pattern}'"


def _range_body() -> str:
    number, blank = labs.NUMBER, labs.WS
    between, top, floor = rf"(?i)({number}){blank}*(?:-|–|—|to){blank}*({number})", rf"(?i)^(?:<=|<|≤|up to|upto){blank}*({number})", rf"^(?:>=|>|≥){blank}*({number})"
    plain = lambda x: f"try_cast(replace(regexp_replace({x}, r',(?=\\d{{3}}\\b)', ''), ',', '.') AS DOUBLE)"
    part = lambda p, k: plain(f"regexp_extract(trim(t), {_quoted(p)}, {k})")
    low, high = part(between, 1), part(between, 2)
    pair = lambda a, b: f"named_struct('low', {a}, 'high', {b})"
    none = "CAST(NULL AS DOUBLE)"
    return f"CASE WHEN trim(t) RLIKE {_quoted(between)} THEN CASE WHEN {low} < {high} THEN {pair(low, high)} END WHEN {part(top, 1)} IS NOT NULL THEN {pair(none, part(top, 1))} WHEN {part(floor, 1)} IS NOT NULL THEN {pair(part(floor, 1), none)} END"


ACCENTS = r"r'[\x{0300}-\x{036F}]'"
#: Bodies that call other functions of this session, in order.
COMPOSED = {
    "fold_text(t STRING) RETURNS STRING": f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(decompose(lower(t)), {ACCENTS}, ''), r'[^a-z0-9.%]+', ' '), r'\\.+(?= |\\z)', ''), ' +', ' '))",
    "term_key(t STRING) RETURNS STRING": f"trim(regexp_replace(lower(regexp_replace(decompose(t), {ACCENTS}, '')), r'[^a-z0-9]+', ' '))",
    "parse_range(t STRING) RETURNS STRUCT<low: DOUBLE, high: DOUBLE>": _range_body(),
    "flag_from_range(v STRING, span STRING) RETURNS STRING": "CASE WHEN result_number(v) IS NULL OR parse_range(span) IS NULL THEN NULL WHEN result_number(v) < parse_range(span).low THEN 'Low' WHEN result_number(v) > parse_range(span).high THEN 'High' ELSE 'Normal' END",
}


def decode_entity(m: re.Match) -> str:
    """T6 for one entity, as text.decode_entities."""
    body = m[1]
    if body[0] != "#":
        return text.NAMED.get(m[0], m[0])
    code = int(body[2:], 16) if body[1] == "x" else int(body[1:])
    return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else m[0]


def decode_array(s: pd.Series) -> pd.Series:
    return s.map(lambda t: re.sub("&(#x[0-9a-fA-F]+|#[0-9]+|[a-zA-Z]+);", decode_entity, t), na_action="ignore")


def chunk_array(s: pd.Series) -> pd.Series:
    """D1 with its usual sizes on text that is normalised already."""
    from docevidence.operators.structure import _pieces

    return s.map(lambda t: _pieces(t, 1000, 150) if t is not None else [])


class Chunks:
    """D1 as a table function: ``FROM (SELECT normalize_text(body) AS t FROM docs), LATERAL chunk_text(t)``;
    a null text has no rows."""

    def eval(self, text: str):
        from docevidence.operators.structure import _pieces

        for p in _pieces(text or "", 1000, 150):
            yield p["idx"], p["text"], p["start"], p["end"]


def _question_body() -> str:
    """Q3's kind as SQL over the patterns of routing."""
    plain = "regexp_replace(regexp_replace(regexp_replace(lower(trim(t)), r'[\"“”‘’]', ''), r'(?:[?!.]|\\s)+\\z', ''), r'\\s+', ' ')"
    term = plain
    for pattern in (routing.LEADING + routing.TRAILING) * 3:
        term = f"regexp_replace({term}, {_quoted(pattern)}, '')"
    like = lambda x, p: f"{x} RLIKE {_quoted(p)}"
    what = like(plain, r"^what\s+(?:does|do)\b")
    asks = f"{like(plain, routing.DEFINITIONAL)} AND NOT ({what} AND NOT {like(plain, r'\s(?:mean|means|stand|stands)(?:\s+for)?\z')})"
    alone = like("x", r"^(?:it|that|this|these|those|there|here|more)\z")
    defines = f"exists(array(trim({term})), x -> x <> '' AND size(split(x, ' +')) <= 8 AND length(x) <= 100 AND NOT {alone} AND NOT {like('x', routing.PATIENT)} AND NOT {like('x', routing.CLINICAL)})"
    low = "lower(trim(t))"
    return f"CASE WHEN NOT {like(low, routing.REPORT_LOOKUP)} AND {asks} AND {defines} THEN 'terminology' WHEN {like(low, routing.CLINICAL)} THEN 'clinical' ELSE 'report' END"


COMPOSED["question_kind(t STRING) RETURNS STRING"] = _question_body()


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL in this session."""
    from docevidence.operators.evidence import strip_citations
    from docevidence.operators.structure import PIECES

    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("decompose", text.decompose)
    spark.udf.register("decode_entities", F.pandas_udf(decode_array, "string"))
    spark.udf.register("strip_citations", strip_citations)
    spark.udf.register("chunk_array", F.pandas_udf(chunk_array, PIECES))
    spark.udtf.register("chunk_text", F.udtf(Chunks, returnType="idx int, text string, start int, end int"))
    for head, body in COMPOSED.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
