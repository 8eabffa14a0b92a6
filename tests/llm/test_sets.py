"""Problems 2, 7, 8 and 9 on small sets, against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import mixing, near_dup, neighbours, packing


# ---- problem 2
def _brute(texts: dict, words: int, least: float, min_words: int) -> set:
    import re

    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\W_]+", t.lower())
        if len(w) >= max(min_words, words):
            sets[k] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
    ks = sorted(sets)
    return {(a, b) for i, a in enumerate(ks) for b in ks[i + 1 :] if texts[a] != texts[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def test_near_duplicates_and_groups(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for g in range(30):
        base = rng.choices(words, k=80)
        for v in range(4):
            t = list(base)
            for _ in range(v * 2):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts[f"{g:02}-{v}"] = " ".join(t)
    texts |= {"copy": texts["00-0"], "short": "a b", "empty": ""}
    rows = [(k, t, "x") for k, t in texts.items()] + [("null", None, "x"), (None, texts["01-0"], "x"), ("00-0", texts["00-0"], "x")]
    pairs, members = near_dup.near_duplicates(spark, spark.createDataFrame(rows, "id string, content string, cls string"), 3, 0.7, 30)
    by = defaultdict(set)
    for r in members.collect():
        by[r.cls].add(r.id)
    got = {tuple(sorted((x, y))) for r in pairs.collect() for x in by[r.a] for y in by[r.b]}
    want = _brute(texts, 3, 0.7, 30)
    assert got <= want and len(got) >= 0.97 * len(want)
    groups = {r.id: r for r in near_dup.groups(spark, pairs, members).collect()}
    for a, b in got:
        assert groups[a].group_id == groups[b].group_id
    assert len({groups[f"{g:02}-0"].group_id for g in range(30)}) == 30 and groups["short"].links == 0
    none, m = near_dup.near_duplicates(spark, spark.createDataFrame([], "id string, content string"))
    assert none.count() == 0 and m.count() == 0 and near_dup.groups(spark, none, m).count() == 0


def test_words_of_any_script():
    import re

    text = "a_b ß İx 日本 \U0001d4b3 2é"
    assert len(near_dup.words_of(text)) == len(re.findall(r"[^\W_]+", text.lower())) == 8
    assert near_dup.words_of("Ab")[0] == near_dup.words_of("x aB.")[1]


# ---- problem 7
def test_neighbours_reach_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((150, 32))
    m = (centres[:, None] + 0.4 * rng.standard_normal((150, 10, 32))).reshape(-1, 32).astype(np.float32)
    t = "2024-01-01 00:00:00"
    rows = [(f"c{i}", "m", [float(x) for x in v], t) for i, v in enumerate(m)]
    rows += [("zero", "m", [0.0] * 32, t), ("nan", "m", [float("nan")] * 32, t), ("short", "m", [1.0], t), ("other", "n", [1.0] * 32, t), (None, "m", [1.0] * 32, t), ("none", "m", None, t), ("c0", "m", [-float(x) for x in m[0]], "2023-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "chunk_id string, model string, embedding array<float>, embedded_at string").withColumn("embedded_at", F.to_timestamp("embedded_at"))
    index = neighbours.build_index(spark, df, "m", 32)
    assert index.rounds >= 1
    q = spark.createDataFrame([(f"c{i}",) for i in range(0, 1500, 5)] + [("zero",), ("c0",), (None,)], "chunk_id string")
    got = defaultdict(dict)
    for r in neighbours.search(index, q, 5).collect():
        got[r["query"]][r.neighbour] = r.rank
    u = m / np.linalg.norm(m, axis=1)[:, None]
    hit = 0
    for i in range(0, 1500, 5):
        s = u @ u[i]
        s[i] = -2
        hit += len({f"c{j}" for j in np.argsort(-s)[:5]} & set(got[f"c{i}"]))
    assert hit >= 0.95 * 300 * 5 and len(got) == 300 and all(sorted(v.values()) == [1, 2, 3, 4, 5] for v in got.values())


def test_neighbours_of_few_and_equal_vectors(spark):
    schema = "chunk_id string, model string, embedding array<float>, embedded_at timestamp"
    few = spark.createDataFrame([("a", "m", [1.0, 0.0], None), ("b", "m", [1.0, 0.0], None), ("c", "m", [0.0, 1.0], None)], schema)
    got = {(r["query"], r.neighbour) for r in neighbours.search(neighbours.build_index(spark, few, "m", 2), few.select("chunk_id"), 1).collect()}
    assert ("a", "b") in got and ("b", "a") in got
    empty = neighbours.build_index(spark, spark.createDataFrame([], schema), "m", 2)
    assert neighbours.search(empty, few.select("chunk_id"), 5).count() == 0


def test_neighbours_among_many_leaves(spark, tmp_path, monkeypatch):
    """Small clusters within a few topics: as many leaves as millions of vectors have must not part a cluster."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    monkeypatch.setattr(neighbours, "LEAF", 40)
    rng = np.random.default_rng(7)

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    centres = unit(0.5 * unit(rng.standard_normal((8, 128)))[rng.integers(0, 8, 2500)] + 0.75**0.5 * unit(rng.standard_normal((2500, 128))))
    m = unit(0.7**0.5 * np.repeat(centres, 8, axis=0) + 0.3**0.5 * unit(rng.standard_normal((20000, 128)))).astype(np.float32)
    order = rng.permutation(20000)
    e = pa.ListArray.from_arrays(pa.array(np.arange(0, 128 * 20000 + 1, 128, dtype=np.int32)), pa.array(m[order].ravel()))
    pq.write_table(pa.table({"chunk_id": [f"c{i}" for i in order], "model": ["m"] * 20000, "embedding": e, "embedded_at": pa.array([0] * 20000, pa.timestamp("us", tz="UTC"))}), f"{tmp_path}/e.parquet")
    q = spark.createDataFrame([(f"c{i}",) for i in range(0, 20000, 10)], "chunk_id string")
    got = {(int(r["query"][1:]), int(r.neighbour[1:])) for r in neighbours.search(neighbours.build_index(spark, spark.read.parquet(f"{tmp_path}/e.parquet"), "m", 128), q, 5).collect()}
    s = m[::10] @ m.T
    s[np.arange(2000), np.arange(0, 20000, 10)] = -2
    want = {(10 * i, int(j)) for i in range(2000) for j in np.argpartition(-s[i], 4)[:5]}
    assert len(got) == 10000 and len(want & got) >= 0.95 * len(want)


def test_graph_answers_for_every_vector(spark, tmp_path):
    rng = np.random.default_rng(3)
    m = (rng.standard_normal((100, 1, 512)) + rng.standard_normal((100, 10, 512))).reshape(-1, 512).astype(np.float32)
    rows = [(f"c{i}", "quartz-embed-512", [float(x) for x in v], None) for i, v in enumerate(m)]
    spark.createDataFrame(rows, "chunk_id string, model string, embedding array<float>, embedded_at timestamp").write.parquet(f"{tmp_path}/chunk_embeddings.parquet")
    got = {(int(r.chunk_id[1:]), int(r.neighbour[1:])): r.similarity for r in neighbours.p7_graph(spark, str(tmp_path)).collect()}
    u = m / np.linalg.norm(m, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(1000) for j in np.argsort(-s[i])[:5]}
    assert len(got) == 5000 and len(want & set(got)) >= 0.95 * 5000
    assert all(abs(s[k] - v) < 1e-3 for k, v in got.items())


# ---- problem 8
@pytest.mark.parametrize("seed", range(6))
def test_windows_place_every_item(seed):
    rng = random.Random(seed)
    counts = Counter(min(128, max(1, int(rng.lognormvariate(2.5, 1)))) for _ in range(3000))
    patterns = packing.pack_windows(dict(counts), 128)
    placed = Counter()
    for size, times, p in patterns:
        assert times > 0 and sum(k * n for k, n in p) <= size and max(k for k, _ in p) <= size
        for k, n in p:
            placed[k] += times * n
    assert placed == counts
    plan = packing.Plan(patterns, 128)
    assert plan.containers <= math.ceil(sum(k * n for k, n in counts.items()) / 128) * 1.02 + 1
    got = [(plan.place(k, i), k) for k, n in counts.items() for i in range(n)]
    assert {p[0] for p, _ in got} == set(range(plan.containers)) and len({p[:3] for p, _ in got}) == len(got)
    windows, boxes = defaultdict(list), defaultdict(int)
    for (container, start, _, size, _), k in got:
        windows[container, start, size].append(k)
        boxes[container] += k
    assert all(sum(v) <= size for (_, _, size), v in windows.items()) and max(boxes.values()) <= 128
    spans = defaultdict(list)
    for c, start, size in windows:
        spans[c].append((start, start + size))
    assert all(b <= x for s in spans.values() for (_, b), (x, _) in zip(sorted(s), sorted(s)[1:]))
    work = defaultdict(int)
    for (_, _, _, _, group), k in got:
        work[group] += k * k
    assert max(work.values()) <= 1.25 * min(work.values())


def test_tiers_decide():
    """Each tier is packed on its own, and long windows take what is left of the shorter tiers."""
    counts = {100: 40, 28: 60, 60: 20, 4: 50, 16: 64, 8: 30}
    tiered, flat = packing.pack_windows(dict(counts), 128), packing.pack_windows(dict(counts), 128, (1,))
    assert {s for s, _, _ in flat} == {128} and {128, 64} <= {s for s, _, _ in tiered}
    assert any(s == 128 and p[0][0] > 64 and p[-1][0] <= 32 for s, _, p in tiered)
    assert sorted(tiered) != sorted(flat)


def test_packing_keeps_everything(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["word"] * rng.choice([3, 10, 50, 200, 900, 2048, 5000])), 7) for i in range(300)] + [(900, None, 7), (901, "", 7), (902, "x", 7), (902, "x", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, container int")
    got = packing.pack(spark, df).collect()
    boxes = defaultdict(list)
    tokens = Counter()
    for r in got:
        tokens[r.doc_id] += r.length
        if r.container is not None:
            boxes[r.container].append(r)
    assert all(sum(r.length for r in b) <= 2048 and len({(r.window_start, r.position) for r in b}) == len(b) for b in boxes.values())
    assert {r.doc_id for r in got} == {r[0] for r in rows} and tokens[900] == tokens[901] == 0 and sum(r.doc_id == 902 for r in got) == 2
    for d in {r.doc_id for r in got if r.piece > 0}:
        parts = sorted((r.token_start, r.length) for r in got if r.doc_id == d)
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and all(n == 2048 for _, n in parts[:-1])
    u = packing.utilisation(packing.pack(spark, df)).first()
    assert u.filled > 0.95 and u.tokens == sum(tokens.values()) and set(boxes) == set(range(u.containers))
    assert packing.pack(spark, df.limit(0)).count() == 0
    # parts of a length change nothing but who is where
    part, packing.PART = packing.PART, 20
    try:
        again = packing.pack(spark, df).collect()
    finally:
        packing.PART = part
    key = ("container", "window_start", "position")
    assert Counter((r.length, *(r[k] for k in key)) for r in again) == Counter((r.length, *(r[k] for k in key)) for r in got)


# ---- problem 9
def test_temperature():
    t = {"a": 800.0, "b": 150.0, "c": 50.0, "none": 0.0}
    x, w = mixing.temperature_weights(t, entropy=math.log(3) * 0.9)
    assert 0 < x < 1 and sum(w.values()) == pytest.approx(1) and -sum(p * math.log(p) for p in w.values()) == pytest.approx(math.log(3) * 0.9)
    x, w = mixing.temperature_weights(t, max_repeats={"a": 1, "b": 2, "c": 3}, budget=900)
    assert all(w[k] * 900 <= {"a": 1, "b": 2, "c": 3}[k] * t[k] * (1 + 1e-9) for k in w)
    assert mixing.temperature_weights({}) == (1.0, {})
    aim, caps = {"a": 0.2, "b": 0.3, "c": 0.5}, {"a": 1, "b": 2, "c": 3}
    most = mixing.largest_budget(t, aim, caps)
    assert most == 300 and mixing.temperature_weights(t, max_repeats=caps, budget=most, targets=aim) == (0.0, pytest.approx(aim))
    x, w = mixing.temperature_weights(t, max_repeats=caps, budget=600, targets=aim)
    assert 0 < x < 1 and w["c"] * 600 == pytest.approx(150) and all(w[k] * 600 <= caps[k] * t[k] * (1 + 1e-9) for k in w)
    assert mixing.largest_budget(t, aim | {"none": 0.1}, caps | {"none": 2}) == 0


def test_mix_reaches_targets_within_caps(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["word"] * rng.randint(1, 30)), rng.choice(["a"] * 8 + [" B ", "b", "c", None, "zzz"]), 1) for i in range(4000)] + [(9000, None, "a", 1), (9001, "", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, tokens int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 4), ("a", 0.5, 1)], "source string, target_share double, max_repeats int")
    uses, report = mixing.mix(spark, docs, targets)
    rep = {r.source: r for r in report.collect()}
    for r in rep.values():
        assert r.actual_share == pytest.approx(r.target_share, abs=0.01) and r.most_uses <= r.max_repeats and r.tokens <= r.budget
    n = Counter((r.doc_id, r["pass"]) for r in uses.collect())
    assert max(n.values()) == 1
    by_doc = Counter(d for d, _ in n)
    src = {i: mixing_clean(s) for i, _, s, _ in rows}
    assert all(c <= {"a": 1, "b": 3, "c": 4}[src[d]] for d, c in by_doc.items())
    # in the one order of the mix every stretch has the shares
    ordered = sorted(uses.collect(), key=lambda r: r.place)
    assert all(0 <= r.place < 1.1 for r in ordered)  # the cut is by tokens, the place by documents
    half = ordered[: len(ordered) // 2]
    for s, r in rep.items():
        assert sum(u.tokens for u in half if u.source == s) / sum(u.tokens for u in half) == pytest.approx(r.target_share, abs=0.03)
    # a larger budget makes the exponent leave the targets, and the caps still hold
    more, report = mixing.mix(spark, docs, targets, budget=int(1.06 * sum(r.budget for r in rep.values())))
    big = {r.source: r for r in report.collect()}
    assert 0 < big["a"].exponent < 1 and all(r.most_uses <= r.max_repeats for r in big.values())
    assert sum(r.tokens for r in big.values()) > 1.04 * sum(r.tokens for r in rep.values())
    assert any(abs(r.actual_share - r.target_share) > 0.01 for r in big.values())
    assert mixing.mix(spark, docs.limit(0), targets)[0].count() == 0
    assert mixing.mix(spark, docs, targets.limit(0))[1].count() == 0


def mixing_clean(s):
    return s.strip().lower() if s else None
