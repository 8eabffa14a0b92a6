"""Supersession and the as-of join against brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from palimpsest.operators import temporal as tm
from palimpsest.plans import event_time

T0 = dt.datetime(2024, 1, 1)


def _t(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


def test_superseded_by_is_strict_and_spans_blocks(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), _t(rng.choice([0, 1, 1, 2, 5000, 9000, 90000, rng.randint(0, 99999)]))) for i in range(200)] + [(900, "a", None)]
    df = spark.createDataFrame(rows, "i int, e string, t timestamp")
    got = {r.i: r.n for r in tm.superseded_by(df, ["e"], "t", "n").collect()}
    for i, e, t in rows:
        later = [x for _, f, x in rows if f == e and x is not None and t is not None and x > t]
        assert got[i] == (min(later) if later else None)


def test_as_of_join_against_brute_force(spark):
    rng = random.Random(2)
    facts, events = [], []
    for i in range(400):
        a = rng.choice([None, 0, 10, rng.randint(0, 60000), -5_000_000])
        facts.append((f"f{i}", rng.choice(["k", "l", None]), _t(a), _t(None if a is None or rng.random() < 0.2 else a + rng.choice([0, 1, 500, 70000, -3]))))
    for i in range(300):
        events.append((i, rng.choice(["k", "l", None]), _t(rng.choice([None, 0, 10, 11, rng.randint(0, 70000), 2_000_000]))))
    f = spark.createDataFrame(facts, "fid string, key string, a timestamp, b timestamp")
    e = spark.createDataFrame(events, "eid int, key string, t timestamp")
    got = sorted((r.eid, r.fid) for r in tm.as_of_join(e, f, ["key"], ["key"], "t", "a", "b", ["fid"]).collect())
    want = sorted((i, x) for i, k, t in events for x, l, a, b in facts if k is not None and k == l and t and a and a <= t and (b is None or b > t))
    assert got == want
    assert tm.as_of_join(e.limit(0), f, ["key"], ["key"], "t", "a", "b", ["fid"]).count() == 0


def test_requests_are_answered_as_known_then(spark):
    ent = "repository_id string, source_type string, source_entity_id string"
    docs = [("v1", "r", "issue", "e", _t(0), None), ("v1", "r", "issue", "e", _t(0), None), ("v2", "r", "issue", "e", _t(10), _t(20)), ("v3", "r", "issue", "e", _t(10), None), ("w", "r", "issue", "z", _t(5), _t(15)), ("n", None, "issue", "e", _t(0), None)]
    rel = [("x", "v1", "w", _t(6), None), ("x", "v1", "w", _t(6), None), ("y", "v3", "w", _t(0), None), ("q", "v1", "gone", _t(0), None)]
    req = [(1, "r", "issue", "e", _t(7)), (1, "r", "issue", "e", _t(7)), (2, "r", "issue", "e", _t(10)), (3, "r", "issue", "e", _t(-1)), (4, "r", "issue", "e", _t(30)), (5, "r", "issue", "e", None), (6, None, "issue", "e", _t(7))]
    got = event_time.answers(
        spark.createDataFrame(req, f"request_id int, {ent}, cutoff timestamp"),
        spark.createDataFrame(docs, f"id string, {ent}, available_at timestamp, superseded_at timestamp"),
        spark.createDataFrame(rel, "id string, source_document_id string, target_document_id string, available_at timestamp, superseded_at timestamp"),
    )
    assert sorted((r.request_id, r.record_id) for r in got.collect()) == [(1, "v1"), (1, "x"), (2, "v2"), (2, "v3"), (2, "y"), (4, "v3")]
    one = tm.latest_fact(got.filter("kind = 'version'"), ["request_id"], [F.col("available_at").desc(), F.col("record_id").desc()])
    assert {r.request_id: r.record_id for r in one.collect()} == {1: "v1", 2: "v3", 4: "v3"}
