"""Results as JSON: written by the executors, or returned when small; slices and previews of them."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of JSON up to which a result is returned itself: of tools and of reports.
THRESHOLD, REPORT_THRESHOLD = 8192, 4096
MOST = 500


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def offload(df: DataFrame, path: str, threshold: int = THRESHOLD, preview: int = 3) -> dict:
    """The rows where their JSON is small; else they are written and a status with a preview comes back.

    The size is added up on the executors; no more than `threshold` bytes or `preview` rows come to
    the driver.
    """
    text = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    size = text.agg(F.coalesce(F.sum(F.octet_length("j") + 1), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    if size["bytes"] <= threshold:
        return {"status": "inline", "rows": [json.loads(r["j"]) for r in text.collect()]}
    write_json(df, path)
    first = [json.loads(r["j"]) for r in text.take(preview)]
    return {"status": "offloaded", "path": path, "bytes": size["bytes"], "count": size["rows"], "preview": first, "structure": structure(first[0]) if first else {}}


def structure(value) -> dict | str:
    """What a value holds: array(n), object, or the type of a scalar, by key."""
    kind = lambda v: f"array({len(v)})" if isinstance(v, list) else "object" if isinstance(v, dict) else "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"
    return {k: kind(v) for k, v in value.items()} if isinstance(value, dict) else kind(value)


def read_slice(value, path: str = "", offset: int = 0, limit: int = 50):
    """The part of a decoded result at a path of keys and numbers with dots; of an array so many items."""
    for key in filter(None, path.split(".")):
        try:
            value = value[int(key)] if isinstance(value, list) else value[key]
        except (KeyError, IndexError, ValueError, TypeError):
            raise KeyError(f"nothing at {key} of {path}") from None
    if isinstance(value, list):
        start = max(0, offset)
        return value[start : start + max(0, min(limit, MOST))]
    return value


def cursor(offset: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"o": offset}).encode()).decode()


def offset_of(text: str | None) -> int:
    """0 for no cursor; an error for one that isn't ours."""
    if not text:
        return 0
    try:
        at = json.loads(base64.urlsafe_b64decode(text.encode()))["o"]
    except (ValueError, KeyError, TypeError):
        raise ValueError("not a cursor") from None
    if not isinstance(at, int) or at < 0:
        raise ValueError("not a cursor")
    return at
