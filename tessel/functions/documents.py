"""Values in JSON text as Column expressions, null where the text is no object."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """The text as a variant; null if it is no JSON."""
    return F.try_parse_json(text)


def decoded_payload(text: Column) -> Column:
    """The text if it is JSON, else an object that holds it under ``raw``; null stays null."""
    return F.when(text.isNull() | parsed(text).isNotNull(), text).otherwise(F.to_json(F.struct(text.alias("raw"))))


def is_object(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(parsed(text)).startswith("OBJECT"), F.lit(False))


def field(text: Column, name: str) -> Column:
    """A top-level field as text; null if there is none or the text is no object."""
    return F.when(is_object(text), F.get_json_object(text, f"$['{name}']"))


def field_truthy(text: Column, name: str) -> Column:
    """Whether the text is an object whose field is neither empty, zero, false nor null."""
    value = field(text, name)
    empty = value.isin("", "false", "[]", "{}") | F.coalesce(value.try_cast("double") == 0, F.lit(False))
    quoted = F.schema_of_variant(F.try_variant_get(parsed(text), f"$.{name}", "variant")) == "STRING"
    return F.coalesce(F.when(quoted, value != "").otherwise(~empty), F.lit(False))


def field_equals(text: Column, name: str, wanted: str) -> Column:
    """Whether the text is an object whose field reads as ``wanted``."""
    return F.coalesce(field(text, name) == wanted, F.lit(False))


def answer_text(text: Column, keys: Sequence[str] = ("answer", "text", "content", "message")) -> Column:
    """The first of the keys that holds a text or an object with ``content``; the text itself where none does or it is no object."""
    first = None
    for key in keys:
        inner = F.get_json_object(text, f"$['{key}']['content']")
        kind = F.schema_of_variant(F.try_variant_get(parsed(text), f"$.{key}", "variant"))
        value = F.when(kind == "STRING", field(text, key)).when(kind.startswith("OBJECT"), inner)
        first = value if first is None else F.coalesce(first, value)
    return F.coalesce(F.when(is_object(text), first), text)
