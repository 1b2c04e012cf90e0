"""Reading model answers: JSON objects, labels, replacements."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.text import strip, strong_protect


def whole_object(c: Column) -> Column:
    """The text if all of it is one JSON object; else null."""
    return F.when(F.substring(F.schema_of_variant(F.try_parse_json(c)), 1, 6) == "OBJECT", c)


_FENCE = re.compile(r"^```(?:json)?\s*|\s*```$", re.IGNORECASE)


def salvage(text: str | None) -> str | None:
    """The first object of a text: all of it, without a code fence, or the first balanced braces that parse.

    Braces are counted in strings as well.
    """
    if not text:
        return None
    body = _FENCE.sub("", text.strip()).strip()
    if _object(body) is not None:
        return body
    for at in (m.start() for m in re.finditer(r"\{", body)):
        depth = 0
        for k in range(at, len(body)):
            depth += (body[k] == "{") - (body[k] == "}")
            if not depth:
                if _object(body[at : k + 1]) is not None:
                    return body[at : k + 1]
                break
    return None


def _object(text: str) -> dict | None:
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def extract_object(c: Column) -> Column:
    """The text's object: by built-in functions where all of it is one, else by Python."""

    @pandas_udf("string")
    def salvaged(texts: pd.Series) -> pd.Series:
        return texts.map(salvage)

    return F.coalesce(whole_object(c), salvaged(c))


def string_field(c: Column, name: str) -> Column:
    """A field that must be a string; null if it is missing or anything else."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(c), f"$.{name}", "variant"))
    return F.when(kind == "STRING", F.get_json_object(c, f"$.{name}"))


def label(c: Column) -> Column:
    """0 or 1 from a boolean, number or string field ``label``; null otherwise."""
    value = F.lower(strip(F.get_json_object(c, "$.label")))
    return F.when(value.isin("1", "1.0", "true"), 1).when(value.isin("0", "0.0", "false"), 0)


def post_guard(raw: Column, answer: Column) -> Column:
    """The answer, unless the token is protected or the answer is blank, long or holds a tag."""
    text = strip(answer)
    bad = strong_protect(raw) | answer.isNull() | (text == "") | (F.size(F.split(text, r"(?U)\s+")) > 6) | text.contains("#") | text.contains("@")
    return F.when(bad, raw).otherwise(text)
