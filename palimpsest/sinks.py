"""What leaves the engine: packs and reports as JSON and text, log lines, and files that are written once."""

from __future__ import annotations

import hashlib
import json
import sys
from datetime import datetime, timezone
from typing import Any, TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACK_VERSION = 1


def pack_json(items: DataFrame) -> DataFrame:
    """One JSON document a query: version, items in order, their number and characters. Absent values have no key."""
    i = F.struct("item", "chunk_id", "context_role", "reasons", "start_line", "end_line", "characters", "truncated", "content")
    g = items.groupBy("query_id").agg(F.array_sort(F.collect_list(i)).alias("evidence"), F.sum("characters").alias("characters"), F.count("*").alias("n"))
    return g.select("query_id", F.to_json(F.struct(F.lit(PACK_VERSION).alias("schemaVersion"), F.col("query_id").alias("query"), F.col("n").alias("items"), "characters", "evidence")).alias("pack"))


def pack_text(items: DataFrame) -> DataFrame:
    """The same as text: each item under a line that says what it is, in order."""
    head = F.concat(F.lit("["), F.col("item").cast("string"), F.lit("] "), F.col("context_role"), F.lit(" "), F.col("chunk_id"), F.coalesce(F.concat(F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")), F.lit("")))
    g = items.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("item", F.concat_ws("\n", head, "content").alias("text")))).alias("e"))
    return g.select("query_id", F.array_join(F.transform("e", lambda x: x["text"]), "\n\n").alias("pack"))


def legacy_results(ranked: DataFrame) -> DataFrame:
    """Results in the eight fields of the old shape, one JSON array a query."""
    fields = F.struct("rank", F.col("chunk_id").alias("chunkId"), F.col("source_type").alias("sourceType"), F.col("source_reference").alias("sourceReference"), "path", F.col("symbol_name").alias("symbolName"), F.round("score", 6).alias("similarity"), "content")
    return ranked.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(fields))).alias("results"))


def table_text(rows: list[dict], columns: list[str]) -> str:
    """A short report as an aligned table; numbers to four places."""
    def cell(v: Any) -> str:
        return "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)

    body = [[cell(r.get(c)) for c in columns] for r in rows]
    widths = [max(len(x) for x in col) for col in zip(columns, *body)] if columns else []
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, widths)).rstrip() for line in [columns, *body])


def stable_json(value: Any) -> str:
    """JSON with keys in order and no white space: equal values give equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def stable_hash(value: Any) -> str:
    return hashlib.sha256(stable_json(value).encode()).hexdigest()


def write_once(path: str, value: Any) -> str:
    """Write a value as stable JSON to a file that must not exist; its hash."""
    with open(path, "x", encoding="utf-8") as f:
        f.write(stable_json(value) + "\n")
    return stable_hash(value)


def write_new(df: DataFrame, path: str) -> None:
    """A table into a folder that must not exist."""
    df.write.mode("errorifexists").parquet(path)


class Log:
    """One JSON line an event: time, level, event, and the fields of the logger and of its parents."""

    def __init__(self, out: TextIO | None = None, **fields: Any):
        self.out, self.fields = out or sys.stderr, fields

    def child(self, **fields: Any) -> "Log":
        return Log(self.out, **self.fields, **fields)

    def __call__(self, level: str, event: str, **fields: Any) -> None:
        at = datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        self.out.write(json.dumps({"time": at, "level": level, "event": event, **self.fields, **fields}, default=str) + "\n")
        self.out.flush()
