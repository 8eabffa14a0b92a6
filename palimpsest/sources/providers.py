"""Contracts of what can be plugged in, settings of the environment, and calls that are repeated when a provider asks for it."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..operators.memory import Embedder
from .landed import exists

# Answers that another attempt would not change; attempts; longest wait for a new allowance, in seconds.
FINAL = frozenset({400, 401, 403, 404, 409, 422})
RETRIES, LONGEST_WAIT = 3, 60


class StructureParser(Protocol):
    """A source text to ('parsed' | 'unsupported' | 'failed', symbols)."""

    def __call__(self, text: str, language: str | None) -> tuple[str, list]: ...


class RelationshipExtractor(Protocol):
    """A source text to its bindings."""

    def __call__(self, text: str) -> list[tuple]: ...


class RetrievalStrategy(Protocol):
    """Queries to a ranked list: rows (query_id, chunk_id, rank, score)."""

    def __call__(self, queries: DataFrame) -> DataFrame: ...


class EvidenceSource(Protocol):
    """Anchors to further candidates: rows (query_id, chunk_id, origin, rank, reason)."""

    def __call__(self, anchors: DataFrame) -> DataFrame: ...


@dataclass
class Answer:
    status: int
    body: object = None
    #: Seconds until a new allowance, if the provider says that the present one is used up.
    wait: float | None = None


class ProviderError(RuntimeError):
    def __init__(self, status: int):
        super().__init__(f"provider answered {status}")
        self.status = status


@dataclass
class Caller:
    """Calls a provider: up to three repeats, none for answers that are final, one more after a short wait for a new allowance."""

    call: Callable[[str], Answer]
    sleep: Callable[[float], None] = time.sleep
    requests: int = 0
    waits: list[float] = field(default_factory=list)

    def get(self, address: str) -> object:
        waited = False
        attempt = 0
        while True:
            self.requests += 1
            a = self.call(address)
            if a.status < 400:
                return a.body
            if a.wait is not None and not waited and a.wait <= LONGEST_WAIT:
                waited = True
                self._wait(a.wait)
                continue
            if a.status in FINAL or attempt == RETRIES:
                raise ProviderError(a.status)
            attempt += 1
            self._wait(2.0 ** (attempt - 1))

    def _wait(self, seconds: float) -> None:
        self.waits.append(seconds)
        self.sleep(seconds)

    def pages(self, address: Callable[[int], str], limit: int, size: int = 100) -> Iterator[dict]:
        """Records page by page, until the limit, a short page, or as many pages as the limit would fill."""
        taken = 0
        for page in range(1, -(-limit // size) + 1):
            rows = self.get(address(page))
            for r in rows:
                if taken == limit:
                    return
                taken += 1
                yield r
            if len(rows) < size:
                return


def land(rows: list[dict], path: str) -> str:
    """Records as JSON lines in a new file, for the readers of landed records."""
    with open(path, "x", encoding="utf-8") as f:
        for r in rows:
            f.write(json.dumps(r, sort_keys=True) + "\n")
    return path


def repository(caller: Caller, owner: str, name: str) -> dict:
    return caller.get(f"/repos/{owner}/{name}")


def commits(caller: Caller, owner: str, name: str, limit: int) -> list[dict]:
    """The newest commits; a repository without any is empty, not an error."""
    try:
        return list(caller.pages(lambda p: f"/repos/{owner}/{name}/commits?per_page=100&page={p}", limit))
    except ProviderError as e:
        if e.status == 409:
            return []
        raise


def landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed JSON lines under a schema; a path without files is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


# ---- settings
def environment(text: str, process: Mapping[str, str] | None = None) -> dict[str, str]:
    """The settings of a .env text; what the process has set wins. Quotes are taken off, comments and blank lines skipped."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#") or "=" not in line:
            continue
        k, v = line.removeprefix("export ").split("=", 1)
        v = v.strip()
        quoted = len(v) >= 2 and v[0] == v[-1] and v[0] in "\"'"
        out[k.strip()] = v[1:-1] if quoted else v.split(" #", 1)[0].rstrip()
    return out | dict(os.environ if process is None else process)


def embedder(settings: Mapping[str, str], hosted: Callable[[Mapping[str, str]], Embedder] | None = None) -> Embedder:
    """The embedding provider of the settings: the local deterministic one, or the hosted one where it is asked for and configured."""
    kind = settings.get("EMBEDDING_PROVIDER", "local")
    if kind == "local":
        n = int(settings.get("EMBEDDING_DIMENSIONS", "512"))
        return Embedder("local", "token-hash", n, lambda texts: [vx.hash_embedding(t, n) for t in texts])
    if kind == "hosted" and hosted and settings.get("EMBEDDING_KEY"):
        return hosted(settings)
    raise ValueError(f"embedding provider {kind!r} is not configured")


def reranker(settings: Mapping[str, str], make: Callable[[str], Callable] | None = None):
    """The reranker of the settings, or none; it must be on this machine."""
    address = settings.get("RERANKER_URL")
    if not address:
        return None
    host = address.split("://", 1)[-1].split("/", 1)[0].rsplit(":", 1)[0]
    if host not in ("localhost", "127.0.0.1", "[::1]"):
        raise ValueError("a reranker must be on this machine")
    if make is None:
        raise ValueError("no reranker is available")
    return make(address)


# ---- manifests of experiments
MANIFEST = "version int, tasks array<struct<id:string,category:string,repository:string,split:string>>"
RUN = "taskId string, condition string, retry int, runId string, passed boolean, completion string, elapsedMs bigint"


def read_manifest(spark: SparkSession, path: str, final: int = 12, pilot: tuple[int, int] = (2, 3)) -> DataFrame:
    """Tasks of a manifest, one row each; wrong numbers of final or pilot tasks, repeated ids or missing fields are an error."""
    t = spark.read.schema(MANIFEST).option("multiLine", "true").json(path).select(F.explode("tasks").alias("t")).select("t.*")
    n = t.agg(F.count_if(F.col("split") == "final").alias("final"), F.count_if(F.col("split") == "pilot").alias("pilot"), F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count_if(F.col("id").isNull() | F.col("category").isNull() | F.col("repository").isNull()).alias("bare")).first()
    faults = []
    if n["final"] != final:
        faults.append(f"{n['final']} final tasks, not {final}")
    if not pilot[0] <= n["pilot"] <= pilot[1]:
        faults.append(f"{n['pilot']} pilot tasks, not {pilot[0]} to {pilot[1]}")
    if n["ids"] != n["n"] or n["bare"]:
        faults.append("repeated ids or missing fields")
    if faults:
        raise ValueError("; ".join(faults))
    return t
