"""Answer normalisation as Column expressions (no Python UDF).

Each parser maps a raw model response to a label (and confidence) exactly
like one family of the study's per-row parsers, but runs JVM-side inside
whole-stage codegen over a whole response table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annospark.functions.text import WS, utrim

THINK_RE = r"(?is)<think>.*?</think>"
JSON_SLICE_RE = r"(?s)\{.*\}"
_JSON_OPTS = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


def strip_think(c: Column) -> Column:
    """Remove <think>...</think> blocks (dot-all, case-insensitive, non-greedy)."""
    return F.regexp_replace(c, THINK_RE, "")


def json_slice(c: Column) -> Column:
    """From the first '{' to the last '}' of the stripped text ('' when absent)."""
    return F.regexp_extract(utrim(c), JSON_SLICE_RE, 0)


def json_array(text: Column, schema: str) -> Column:
    """The text wrapped as '[text]' and parsed as an array: trailing content
    or a second object makes it invalid (size != 1), matching a strict
    parser rather than Spark's lenient first-object read.
    """
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<struct<{schema}>>", _JSON_OPTS)


def only_object(arr: Column) -> Column:
    """The one object of a parsed array -> struct, else NULL."""
    return F.when(F.size(arr) == 1, F.element_at(arr, 1))


def parse_json_object(text: Column, schema: str) -> Column:
    """Strictly one JSON object -> struct, else NULL."""
    return only_object(json_array(text, schema))


ANSWER_SCHEMA = "label:string,confidence:string"


def cleaned(c: Column) -> Column:
    return F.lower(utrim(c))


def json_answer(label: Column, conf: Column) -> list[Column]:
    """label, confidence of the cleaned fields: label yes/no else ('error','unknown'); bad confidence -> 'unknown'."""
    ok = F.coalesce(label.isin("yes", "no"), F.lit(False))
    return [F.when(ok, label).otherwise(F.lit("error")).alias("label"),
            F.when(ok & F.coalesce(conf.isin("high", "medium", "low"), F.lit(False)), conf)
            .otherwise(F.lit("unknown")).alias("confidence")]


def parse_json_answer(raw: Column) -> Column:
    """struct<label, confidence> of one column; over a table, `normalize_answers` parses each text once."""
    obj = parse_json_object(json_slice(raw), ANSWER_SCHEMA)
    return F.struct(*json_answer(cleaned(obj["label"]), cleaned(obj["confidence"])))


def parse_plain_answer(raw: Column) -> Column:
    """First yes/no token and first high/medium/low token, independently (exact tokens)."""
    toks = F.split(F.lower(utrim(raw)), f"{WS}+")
    lab = F.try_element_at(F.filter(toks, lambda t: t.isin("yes", "no")), F.lit(1))
    conf = F.try_element_at(F.filter(toks, lambda t: t.isin("high", "medium", "low")), F.lit(1))
    return F.struct(F.coalesce(lab, F.lit("error")).alias("label"),
                    F.coalesce(conf, F.lit("unknown")).alias("confidence"))


def parse_contains(raw: Column) -> Column:
    """Upper-case containment: YES first, then NO (also matches NON/UNKNOWN), else UNCLEAR; NULL -> ERROR."""
    u = F.upper(utrim(raw))
    return (F.when(raw.isNull(), F.lit("ERROR"))
            .when(u.contains("YES"), F.lit("YES"))
            .when(u.contains("NO"), F.lit("NO"))
            .otherwise(F.lit("UNCLEAR")))


def parse_prefix(raw: Column) -> Column:
    """Prefix YES -> yes, prefix NO -> no, anything else (incl. empty / None) -> no."""
    u = F.upper(utrim(F.coalesce(raw, F.lit("None"))))
    return F.when(u.startswith("YES"), F.lit("yes")).otherwise(F.lit("no"))


def parse_legacy(raw: Column) -> Column:
    """Lower-case containment of yes / si / no; anything else no.  Marked legacy: any word
    containing 'si' counts as yes."""
    l = F.lower(utrim(raw))
    return (F.when(l.contains("yes") | l.contains("sì") | l.contains("si"), F.lit("yes"))
            .otherwise(F.lit("no")))


STRUCTURED_SCHEMA = "dil:string,confidenza:string,ragionamento:string,marcatori:array<string>"


def structured_status(obj: Column, result_type: Column) -> Column:
    """api_error / expired from the request outcome, parse_error when the text is not one JSON object, else ok."""
    return (F.when(result_type == "errored", F.lit("api_error"))
            .when(result_type == "expired", F.lit("expired"))
            .when(obj.isNull(), F.lit("parse_error"))
            .otherwise(F.lit("ok")))


def structured_answer(raw: Column, obj: Column, status: Column) -> list[Column]:
    """The answer's columns; defaults of an ok one are dil 'error', confidenza 'sconosciuta', ragionamento '' and marcatori []."""
    ok = status == "ok"
    return [
        status.alias("status"),
        F.when(ok, F.coalesce(obj["dil"], F.lit("error"))).alias("dil"),
        F.when(ok, F.coalesce(obj["confidenza"], F.lit("sconosciuta"))).alias("confidenza"),
        F.when(ok, F.coalesce(obj["ragionamento"], F.lit(""))).alias("ragionamento"),
        F.when(ok, F.coalesce(obj["marcatori"], F.array().cast("array<string>"))).alias("marcatori"),
        F.when(status == "parse_error", F.substring(raw, 1, 500)).alias("raw_prefix")]


def parse_structured(raw: Column, result_type: Column) -> Column:
    """Structured (schema-constrained) answer of the whole text, as one struct."""
    obj = parse_json_object(utrim(raw), STRUCTURED_SCHEMA)
    return F.struct(*structured_answer(raw, obj, structured_status(obj, result_type)))


def answer_text(content: Column, reasoning: Column) -> Column:
    """Content when non-blank, else the reasoning text."""
    return F.coalesce(F.nullif(utrim(content), F.lit("")), reasoning)


def output_text(direct: Column, items: Column) -> Column:
    """Text of a structured response: the direct output text when non-blank, else the
    concatenated `text` items, else the reasoning summaries joined by a space, else ''.

    `items` is array<struct<type:string, text:string, summary:array<string>>>.
    """
    texts = F.filter(F.transform(F.filter(items, lambda x: x["type"] == "text"), lambda x: x["text"]),
                     lambda t: t.isNotNull() & (t != ""))
    sums = F.flatten(F.transform(F.filter(items, lambda x: x["type"] == "reasoning"),
                                 lambda x: F.coalesce(x["summary"], F.array().cast("array<string>"))))
    return (F.when(F.coalesce(utrim(direct), F.lit("")) != "", utrim(direct))
            .when(F.coalesce(F.size(texts), F.lit(0)) > 0, utrim(F.array_join(texts, "")))
            .when(F.coalesce(F.size(sums), F.lit(0)) > 0, utrim(F.array_join(sums, " ")))
            .otherwise(F.lit("")))
