"""Values inside Python dict literals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from labelwright.functions.text import strip_text


def dict_literal(text: Column) -> Column:
    """``{'a': 4.0, 'b': None}`` as map<string,string>; null if it is no dict."""
    body = strip_text(text)
    for python_word, json_word in (("None", "null"), ("True", "true"), ("False", "false")):
        body = F.regexp_replace(body, rf":\s*{python_word}\b", f": {json_word}")
    return F.when(
        body.startswith("{") & body.endswith("}"), F.from_json(body, "map<string,string>")
    )


def extract_overall(text: Column, key: str = "overall") -> Column:
    """The number under ``key``: 0.0 if the key is absent, null if unreadable."""
    values = dict_literal(text)
    return F.when(
        values.isNotNull() & ~F.map_contains_key(values, key), F.lit(0.0)
    ).otherwise(F.try_element_at(values, F.lit(key)).try_cast("double"))
