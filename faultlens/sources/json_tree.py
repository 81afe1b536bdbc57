"""Flattening of JSON documents with unknown nesting."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

NODE_SCHEMA = "{key} string, pos int, depth int, chain array<string>, node string"


def json_nodes(df: DataFrame, key: str = "artifact_id", text: str = "text") -> DataFrame:
    """One row per JSON object: its preorder ``pos``, key ``chain`` from the root and own fields as ``node``.

    Own fields are scalars and objects of scalars. Unreadable documents, and those nested deeper than the
    JSON parser goes, give no rows. Everything that interprets the nodes is plain Spark.
    """
    def flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        def own(value: dict) -> str:
            flat = lambda v: not isinstance(v, (dict, list))
            return json.dumps({
                k: v for k, v in value.items()
                if flat(v) or (isinstance(v, dict) and all(flat(x) for x in v.values()))
            })

        def walk(root: object) -> Iterator[tuple[int, int, list[str], str]]:
            stack, pos = [(root, 0, [])], 0
            while stack:
                value, depth, chain = stack.pop()
                if isinstance(value, dict):
                    yield pos, depth, chain, own(value)
                    pos += 1
                    stack.extend((child, depth + 1, [*chain, str(name)]) for name, child in reversed(value.items()))
                elif isinstance(value, list):
                    stack.extend((child, depth + 1, chain) for child in reversed(value))

        for batch in batches:
            rows = []
            for ident, document in zip(batch[key], batch[text]):
                try:
                    root = json.loads(document)
                except (TypeError, ValueError, RecursionError):
                    continue
                rows.extend((ident, *node) for node in walk(root))
            yield pd.DataFrame(rows, columns=[key, "pos", "depth", "chain", "node"])

    return df.select(df[key].cast("string").alias(key), text).mapInPandas(flatten, NODE_SCHEMA.format(key=key))
