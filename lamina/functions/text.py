"""Text rules of the layers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.schemas import MEMORY_KINDS

MESSAGE_CAP = 500


def trimmed(text: Column) -> Column:
    """Without leading and trailing white space of any script; SQL trim() only knows the blank."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def non_blank(text: Column) -> Column:
    return F.length(trimmed(text)) > 0


def require_text(text: Column, name: str) -> Column:
    """The trimmed text; the query fails where nothing is left."""
    return F.when(F.coalesce(non_blank(text), F.lit(False)), trimmed(text)).otherwise(F.raise_error(F.lit(f"{name} must not be blank")).cast("string"))


def token_estimate(text: Column) -> Column:
    """A token for every four code points or part of four."""
    return F.ceil(F.char_length(text) / F.lit(4.0)).cast("long")


def truncated_message(text: Column) -> Column:
    """Messages of more than 500 bytes are cut to 500 characters and an ellipsis."""
    return F.when(F.octet_length(text) > MESSAGE_CAP, F.concat(F.substring(text, 1, MESSAGE_CAP), F.lit("…"))).otherwise(text)


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def parsed_tags(argument: Column, nested: bool = True) -> Column:
    """Tags of a JSON argument: null is none, an array of strings as it is, and (where `nested`) a string holding such an array. Null where invalid."""
    strings = lambda text: F.when(
        text.rlike(r'^\s*\[\s*(?:"(?:[^"\\]|\\.)*"\s*(?:,\s*"(?:[^"\\]|\\.)*"\s*)*)?\]\s*$'), F.from_json(text, "array<string>")
    )
    inner = F.get_json_object(F.concat(F.lit('{"v":'), argument, F.lit("}")), "$.v")
    absent = argument.isNull() | (F.trim(argument) == "null")
    tags = F.when(absent, F.array().cast("array<string>")).when(argument.rlike(r"^\s*\["), strings(argument))
    return tags.when(argument.rlike(r'^\s*"'), strings(inner)) if nested else tags


def valid_kind(kind: Column) -> Column:
    return kind.isin(*MEMORY_KINDS)


def valid_weight(weight: Column) -> Column:
    return F.coalesce(weight.between(0.0, 1.0) & ~F.isnan(weight), F.lit(False))


def session_id_of(uri: Column) -> Column:
    """The id at the end of a session URI, up to a query or fragment."""
    return F.regexp_extract(uri, r"session/([^?#/]+)", 1)


def human_bytes(n: int) -> str:
    value, unit = float(n), "B"
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if value < 1024 or unit == "TiB":
            break
        value /= 1024
    return f"{n} B" if unit == "B" else f"{value:.2f} {unit}"
