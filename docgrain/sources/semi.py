"""Semi-structured sources: JSON leaves and HTML text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _leaves(value: object, path: str) -> Iterator[tuple[str, str]]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _leaves(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _leaves(v, f"{path}.[{i}]")
    else:
        yield path, str(value)


def json_leaves(docs: DataFrame) -> DataFrame:
    """id, pos, path, value of every leaf of a JSON column (id, json), depth first, below `root`.

    Lists show as [i]; True, False and None as words. A text that isn't JSON has no leaves. Depth is open, so this is an
    Arrow-batched function; a flat object could be parsed with from_json.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["json"], strict=True):
                try:
                    value = json.loads(text) if text else None
                except ValueError:
                    continue
                if value is not None:
                    rows += [(key, i, p, v) for i, (p, v) in enumerate(_leaves(value, "root"))]
            yield pd.DataFrame(rows, columns=["id", "pos", "path", "value"])

    return docs.select(F.col("id").cast("long"), F.col("json").cast("string")).mapInPandas(run, "id long, pos int, path string, value string")


def strip_html(html: Column) -> Column:
    """Text of a page: scripts, styles and tags out, white space single."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"[ \t\n\r]+", " "))
