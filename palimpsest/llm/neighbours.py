"""Problem 7: most similar vectors, by a neighbour graph from NN-descent and greedy search on it.

Vectors are kept at twelve bits a value, for search as codes of four bits a value, and for building the graph as
coarse codes of two. Every vector goes to the nearest few of a bounded sample of vectors, the pivots; the best
neighbours among those that came to a pivot start the graph. Each round of NN-descent joins neighbours of neighbours: every
node's list of forward and reverse neighbours is compared with itself, and pairs that beat an end's current worst
neighbour go into the lists. Codes travel once per block of nodes that needs them, not once per pair. The best of
what greedy search finds is scored again on the twelve-bit vectors. The plan is the same for few and for many vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import Scratch
from ..sources.tables import read

MODEL, DIMENSIONS = "quartz-embed-512", 512
#: Neighbours kept a node; reverse neighbours that join its list; members of a leaf, all that come to one pivot; most of a
#: group that is compared as a whole.
K, REVERSE, LEAF, GROUP = 10, 10, 600, 4096
#: Signs on random hyperplanes by which leaves larger than a group are cut further, as pivots end where their sample does.
BITS = 12
#: Groups above their size, for repeated vectors, are cut by salt: the size is raised so that there are no more of them.
HEAVY = 100_000
#: Leaves a node goes to, and the neighbours it takes from each; they cost one shuffle of codes each and spare rounds of the
#: descent. Descent alone does not mend a poor start: between a node and others like it, which have nothing in common with
#: the rest, no path of neighbours leads.
NEAREST, START = 4, 6
#: Pivots at most: the bound of the sample.
SAMPLE = 4096
#: Rounds of NN-descent at most; a round that renews less than this share of the lists is the last.
ROUNDS, RENEWED = 6, 0.05
#: Greedy search: hops, nodes expanded a hop, nodes remembered.
HOPS, EXPAND, BEAM = 1, 10, 24
#: Hops where every vector asks: most lie far from all others, and their neighbours are harder to find than a probe's.
GRAPH_HOPS = 2
#: Of these, scored again on the twelve-bit vectors are those that come so close to the last wanted one by their codes:
#: two and a half times the standard error of a difference of two similarities of four-bit codes.
CLOSE = 0.025
#: Nodes of a block: as the square root of all, so that neither the blocks nor what each of them holds grow fast.
BLOCK_LEAST, BLOCK_MOST, BLOCK_ROOT = 512, 16_384, 22
#: Rows decoded at a time.
DECODED = 8192


def block_size(n: int) -> int:
    return int(min(BLOCK_MOST, max(BLOCK_LEAST, BLOCK_ROOT * n**0.5)))


def _unit(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at twelve bits a value, two values in three bytes, and the factor that makes each of length one."""
    top = np.abs(values).max(axis=1)
    q = np.rint(values / top[:, None] * 2047).astype(np.int16)
    scale = (1 / np.linalg.norm(q.astype(np.float64), axis=1)).astype(np.float32)
    if q.shape[1] % 2:
        q = np.concatenate([q, np.zeros((len(q), 1), np.int16)], axis=1)
    u = (q + 2048).astype(np.uint16)
    a, b = u[:, 0::2], u[:, 1::2]
    out = np.empty((len(q), 3 * a.shape[1]), np.uint8)
    out[:, 0::3], out[:, 1::3], out[:, 2::3] = a >> 4, ((a & 15) << 4) | (b >> 8), b & 255
    return out, scale


def _whole(b: np.ndarray) -> np.ndarray:
    """The values of such rows."""
    x, y, z = b[:, 0::3].astype(np.int16), b[:, 1::3].astype(np.int16), b[:, 2::3]
    m = np.empty((len(b), 2 * x.shape[1]), np.float32)
    m[:, 0::2] = (x << 4) | (y >> 4)
    m[:, 1::2] = ((y & 15) << 8) | z
    return m - 2048


def _bytes(column) -> np.ndarray:
    """The binary values of a column as rows of a matrix."""
    if len(column) == 0:
        return np.empty((0, 6), np.uint8)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _encode(m: np.ndarray) -> np.ndarray:
    """Rows as codes: each value in fifteen steps of its row's spread, two values a byte."""
    spread = 2.7 * np.sqrt((m * m).mean(axis=1, keepdims=True))
    q = (np.clip(np.rint(m / spread * 7), -7, 7) + 8).astype(np.uint8)
    if q.shape[1] % 2:
        q = np.concatenate([q, np.full((len(q), 1), 8, np.uint8)], axis=1)
    return (q[:, 0::2] << 4) | q[:, 1::2]


def _decode(b: np.ndarray) -> np.ndarray:
    """Unit vectors from codes."""
    m = np.empty((b.shape[0], 2 * b.shape[1]), np.float32)
    m[:, 0::2] = b >> 4
    m[:, 1::2] = b & 15
    m -= 8
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def _encode_coarse(m: np.ndarray) -> np.ndarray:
    """Rows as codes of two bits a value: its sign, and whether it lies beyond its row's spread. Four values a byte."""
    q = (m > 0).astype(np.uint8) * 2 + (np.abs(m) > np.sqrt((m * m).mean(axis=1, keepdims=True)))
    if q.shape[1] % 4:
        q = np.concatenate([q, np.zeros((len(q), 4 - q.shape[1] % 4), np.uint8)], axis=1)
    return (q[:, 0::4] << 6) | (q[:, 1::4] << 4) | (q[:, 2::4] << 2) | q[:, 3::4]


#: What stands for the four coarse codes: the centres of a normal distribution's parts inside and beyond one spread.
_LEVELS = np.array([-0.46, -1.52, 0.46, 1.52], np.float32)
_BYTE = np.stack([_LEVELS[(np.arange(256) >> k) & 3] for k in (6, 4, 2, 0)], axis=1)


def _decode_coarse(b: np.ndarray) -> np.ndarray:
    """Unit vectors from coarse codes."""
    m = _BYTE[b].reshape(len(b), 4 * b.shape[1])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _of_coarse(t: pa.Table):
    """Reads rows of a table's coarse codes as unit vectors; so do the two below, of codes and of vectors."""
    b = _bytes(t.column("coarse"))
    return lambda rows: _decode_coarse(b[rows])


def _of_code(t: pa.Table):
    b = _bytes(t.column("code"))
    return lambda rows: _decode(b[rows])


def _of_vector(t: pa.Table):
    b, scale = _bytes(t.column("v")), np.asarray(t.column("scale"))
    return lambda rows: _whole(b[rows]) * scale[rows, None]


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a contiguous array as binary values."""
    width = rows.strides[0]
    off = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def vectors(embeddings: DataFrame, model: str = MODEL, dimensions: int = DIMENSIONS) -> DataFrame:
    """Rows (h, chunk_id, at, v, scale): every usable vector with a hash of chunk, time and values.

    Usable are vectors of the model with `dimensions` finite values, not all zero. Null ids, vectors and
    values make a row unusable; a null embedded_at is the oldest.
    """
    out = pa.schema([("chunk_id", pa.string()), ("at", pa.timestamp("us", tz="UTC")), ("v", pa.binary()), ("scale", pa.float32())])

    def run(batches):
        for b in batches:
            e = b.column("embedding")
            size = e.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ok = np.flatnonzero(size == dimensions)
            vals = e.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(np.where(np.asarray(e.is_valid()), size, 0))])[:-1]
            m = vals[starts[ok][:, None] + np.arange(dimensions)] if len(ok) else np.empty((0, dimensions))
            good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
            m, ok = m[good], ok[good]
            if not len(ok):
                continue
            q, scale = _unit(m)
            v = _binary(q)
            take = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column("chunk_id").take(take), b.column("at").take(take).cast(out.field("at").type), v, pa.array(scale)], schema=out)

    e = embeddings.filter((F.col("model") == model) & F.col("chunk_id").isNotNull() & F.col("embedding").isNotNull()).select("chunk_id", F.col("embedded_at").alias("at"), "embedding")
    v = e.mapInArrow(run, "chunk_id string, at timestamp, v binary, scale float")
    return v.select(F.xxhash64("chunk_id", F.unix_micros("at"), "v").alias("h"), "chunk_id", "at", "v", "scale")


def latest(v: DataFrame) -> DataFrame:
    """Rows (nid, h, chunk_id): of each chunk the latest vector, ties by hash, with a number. No vector is shuffled.

    The numbers hold once the rows are written. They are small, so lists of them shrink in a shuffle as hashes would not.
    """
    w = Window.partitionBy("chunk_id").orderBy(F.col("at").desc_nulls_last(), F.col("h").desc())
    v = v.select("h", "chunk_id", "at").withColumn("__rn", F.row_number().over(w)).filter("__rn = 1")
    return v.select(F.monotonically_increasing_id().alias("nid"), "h", "chunk_id")


# ---- pivots
def choose_pivots(coarse: np.ndarray, n: int) -> np.ndarray:
    """Of a sample's coarse codes those of the pivots of n vectors, each next to those like it."""
    coarse = np.unique(coarse, axis=0)
    want = min(SAMPLE, len(coarse), max(2 * NEAREST, -(-n * NEAREST // LEAF)))
    coarse = coarse[np.random.default_rng(1).permutation(len(coarse))[:want]]
    if not len(coarse):
        return coarse
    m = _decode_coarse(coarse)
    s = m @ m.T
    at, tour = 0, [0]
    s[:, 0] = -2
    for _ in range(want - 1):
        at = int(s[at].argmax())
        tour.append(at)
        s[:, at] = -2
    return coarse[tour]


def nearest_pivots(pivots: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The numbers of each row's NEAREST most similar pivots, the most similar first."""
    out = np.empty((len(m), min(NEAREST, len(pivots))), np.int32)
    for lo in range(0, len(m), 1024):
        s = m[lo : lo + 1024] @ pivots.T
        for k in range(out.shape[1]):
            top = s.argmax(axis=1)
            out[lo : lo + len(s), k] = top
            s[np.arange(len(s)), top] = -2
    return out


def codes(v: DataFrame) -> DataFrame:
    """Rows (h, code, coarse) of (h, v, scale)."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                m = _of_vector(b)(np.arange(b.num_rows))
                yield pa.RecordBatch.from_arrays([b.column("h"), _binary(_encode(m)), _binary(_encode_coarse(m))], names=["h", "code", "coarse"])

    return v.select("h", "v", "scale").mapInArrow(run, "h bigint, code binary, coarse binary")


def _leaves(code: DataFrame, pivots: np.ndarray, *carry: str) -> DataFrame:
    """Rows (nid, near, leaf, bits, carried columns), one a node and pivot, of which near counts from 0; bits are its sides of BITS random hyperplanes.

    A leaf has one of NEAREST sets of hyperplanes, so what one leaf cuts apart may stay together in another.
    """

    def run(batches):
        p = _decode_coarse(pivots)
        planes = np.random.default_rng(1000).standard_normal((4 * pivots.shape[1], NEAREST * BITS)).astype(np.float32)
        for b in batches:
            if not b.num_rows:
                continue
            m = _of_coarse(b)(np.arange(b.num_rows))
            sides = ((m @ planes > 0).reshape(len(m), NEAREST, BITS) @ (1 << np.arange(BITS))).astype(np.int32)
            for k, leaf in enumerate(nearest_pivots(p, m).T):
                bits = sides[np.arange(len(m)), leaf % NEAREST]
                yield pa.RecordBatch.from_arrays([b.column("nid"), pa.array(np.full(len(m), k, np.int32)), pa.array(leaf), pa.array(bits), *[b.column(c) for c in carry]], names=["nid", "near", "leaf", "bits", *carry])

    return code.select("nid", "coarse").mapInArrow(run, "nid bigint, near int, leaf int, bits int" + "".join(f", {c} binary" for c in carry))


_EDGE = pa.schema([("u", pa.int64()), ("w", pa.int64()), ("sim", pa.float32())])


def _edges(u, w, sim) -> pa.Table:
    return pa.table([pa.array(u, pa.int64()), pa.array(w, pa.int64()), pa.array(sim, pa.float32())], schema=_EDGE)


def _within(k: int):
    """The best k neighbours of each member of a group within it."""

    def run(t: pa.Table) -> pa.Table:
        ids = t.column("nid").to_numpy()
        n = len(ids)
        m = _of_coarse(t)(np.arange(n))
        kk = min(k, n - 1)
        if kk < 1:
            return _edges([], [], [])
        us, ws, ss = [], [], []
        for lo in range(0, n, 512):
            s = m[lo : lo + 512] @ m.T
            s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -2
            top = np.argpartition(-s, kk - 1, axis=1)[:, :kk]
            us.append(np.repeat(ids[lo : lo + len(s)], kk))
            ws.append(ids[top].ravel())
            ss.append(np.take_along_axis(s, top, axis=1).ravel())
        return _edges(np.concatenate(us), np.concatenate(ws), np.concatenate(ss))

    return run


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k most similar of each node, ties by node number."""
    w = Window.partitionBy("u").orderBy(F.col("sim").desc(), "w")
    return edges.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


def _close(edges: DataFrame, k: int, margin: float) -> DataFrame:
    """Of each node's edges the k most similar, and all that are less than a margin below the last of them."""
    e = _best(edges, BEAM).withColumn("__rn", F.row_number().over(Window.partitionBy("u").orderBy(F.col("sim").desc(), "w")))
    last = F.min(F.when(F.col("__rn") <= k, F.col("sim"))).over(Window.partitionBy("u"))
    return e.withColumn("__last", last).filter((F.col("__rn") <= k) | (F.col("sim") >= F.col("__last") - margin)).drop("__rn", "__last")


def _distinct(edges: DataFrame, by: str, other: str, *aggs) -> DataFrame:
    """One row a pair. The one exchange is by the first end, which later windows and joins by it need anyway."""
    return edges.repartition(by).groupBy(by, other).agg(*aggs)


def _lists(edges: DataFrame, reverse: int) -> DataFrame:
    """Rows (v, x, fresh): each node's forward neighbours and its most similar reverse ones."""
    back = _best(edges.select(F.col("w").alias("u"), F.col("u").alias("w"), "sim", "fresh"), reverse)
    both = edges.select(F.col("u").alias("v"), F.col("w").alias("x"), "fresh").union(back.select("u", "w", "fresh"))
    return _distinct(both, "v", "x", F.max("fresh").alias("fresh"))


def _local_join(lists: pa.Table, vecs: pa.Table, reader, most: int) -> pa.Table:
    """Pairs within each node's list, at least one of them fresh, that beat the worst neighbour of their first end."""
    ids = vecs.column("x").to_numpy()
    order = np.argsort(ids)
    ids = ids[order]
    rows = reader(vecs)
    worst = vecs.column("worst").to_numpy()[order]
    v = lists.column("v").to_numpy()
    x = np.searchsorted(ids, lists.column("x").to_numpy())
    fresh = lists.column("fresh").to_numpy() > 0
    by = np.argsort(v, kind="stable")
    v, x, fresh = v[by], x[by], fresh[by]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(v)) + 1, [len(v)]])
    us, ws, ss = [], [], []
    at = 0
    while at < len(cuts) - 1:
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + DECODED, side="right")) - 1)
        lo = cuts[at]
        uniq, inside = np.unique(x[lo : cuts[to]], return_inverse=True)
        m = rows(order[uniq])
        for a, b in zip(cuts[at:to], cuts[at + 1 : to + 1]):
            if b - a < 2 or not fresh[a:b].any():
                continue
            i, f = x[a:b], fresh[a:b]
            r = m[inside[a - lo : b - lo]]
            s = r @ r.T
            hit = (s > worst[i][:, None]) & (f[:, None] | f[None, :])
            np.fill_diagonal(hit, False)
            p, q = np.nonzero(hit)
            if len(p):
                us.append(i[p])
                ws.append(i[q])
                ss.append(s[p, q])
        at = to
    if not us:
        return _edges([], [], [])
    u, w, s = np.concatenate(us), np.concatenate(ws), np.concatenate(ss)
    _, first = np.unique(u.astype(np.int64) * len(ids) + w, return_index=True)
    u, w, s = u[first], w[first], s[first]
    # of each first end only the best can enter its list from here
    o = np.lexsort((-s, u))
    u, w, s = u[o], w[o], s[o]
    start = np.concatenate([[0], np.flatnonzero(np.diff(u)) + 1])
    place = np.arange(len(u)) - np.repeat(start, np.diff(np.concatenate([start, [len(u)]])))
    keep = place < most
    return _edges(ids[u[keep]], ids[w[keep]], s[keep])


def _join(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by shuffle at every size: no side of these joins is bounded, so none is broadcast."""
    return a.hint("merge").join(b.hint("merge"), on, how)


class Index:
    """A neighbour graph: vec (h, v, scale), names (nid, h, chunk_id), code (nid, code, coarse), blocks (nid, block), edges (u, w, sim)."""

    def __init__(self, scratch: Scratch, vec: DataFrame, names: DataFrame, code: DataFrame, blocks: DataFrame, edges: DataFrame, rounds: int):
        self.scratch, self.vec, self.names, self.code, self.blocks, self.edges, self.rounds = scratch, vec, names, code, blocks, edges, rounds


def build_index(spark: SparkSession, embeddings: DataFrame, model: str = MODEL, dimensions: int = DIMENSIONS) -> Index:
    """The graph over all usable vectors. Only the pivots are a sample, of at most SAMPLE vectors; every vector is indexed."""
    scratch = Scratch(spark, "neighbours")
    vec = scratch.keep(vectors(embeddings, model, dimensions), "uncompressed")
    names = scratch.keep(latest(vec))
    code = scratch.keep(_join(codes(vec).dropDuplicates(["h"]), names.select("h", "nid"), "h").select("nid", "code", "coarse"), "uncompressed")
    scratch.sweep()
    n = code.count()
    sample = _bytes(code.filter(F.pmod(F.xxhash64("nid", F.lit(7)), F.lit(max(n, 1))) < SAMPLE).select("coarse").limit(2 * SAMPLE).toArrow().column("coarse"))
    pivots = choose_pivots(sample, n)
    where = scratch.keep(_leaves(code, pivots))
    # one row a leaf, of which there are SAMPLE at most: into how many cells its members are cut
    cells = F.broadcast(where.groupBy("leaf").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / GROUP))).cast("int").alias("deep")))
    most = max(GROUP, n // HEAVY)

    def celled(df: DataFrame) -> DataFrame:
        return df.join(cells, "leaf").withColumn("cell", F.expr(f"bits & (shiftleft(1, least(deep, {BITS})) - 1)")).drop("bits", "deep")

    # repeated vectors stay together in any cell: such cells are cut by salt, and there are NEAREST times HEAVY at most
    heavy = F.broadcast(celled(where).groupBy("leaf", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("leaf", "cell", F.ceil(F.col("n") / most).cast("int").alias("parts")))

    def parted(df: DataFrame) -> DataFrame:
        return celled(df).join(heavy, ["leaf", "cell"], "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("nid"), F.col("parts"))).cast("int")).drop("parts")

    start = parted(_leaves(code, pivots, "coarse")).groupBy("leaf", "cell", "part").applyInArrow(_within(START), "u bigint, w bigint, sim float")
    edges = scratch.keep(_best(_distinct(start, "u", "w", F.max("sim").alias("sim")), K).withColumn("fresh", F.lit(1)))
    # neighbouring numbers of leaves are near each other: a block is a run of them
    run = max(1, block_size(n) * len(pivots) // max(n, 1))
    blocks = scratch.keep(parted(where.filter("near = 0")).select("nid", F.hash(F.floor(F.col("leaf") / run), F.col("cell"), F.col("part")).alias("block")))
    scratch.drop(where)
    rounds = 0
    for rounds in range(1, ROUNDS + 1):
        new = scratch.keep(_round(code, blocks, edges))
        renewed = new.filter("fresh = 1").count()
        scratch.drop(edges)
        edges = new
        if renewed <= RENEWED * K * n:
            break
    return Index(scratch, vec, names, code, blocks, edges, rounds)


def _compared(lists: DataFrame, known: DataFrame, column: str, reader, most: int) -> DataFrame:
    """Edges from the lists (block, v, x, fresh), compared in their blocks; known has (x, the codes' column, worst)."""
    need = _join(lists.select("block", "x").distinct(), known, "x")
    a = lists.select(F.col("block").alias("a"), F.col("v").alias("v"), F.col("x").alias("x"), F.col("fresh").alias("fresh"))
    b = need.select(F.col("block").alias("b"), F.col("x").alias("x"), F.col(column).alias(column), F.col("worst").alias("worst"))
    return a.groupBy("a").cogroup(b.groupBy("b")).applyInArrow(lambda x, y: _local_join(x, y, reader, most), "u bigint, w bigint, sim float")


def _round(code: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    lists = _join(_lists(edges, REVERSE), blocks.withColumnRenamed("nid", "v"), "v")
    # a list without a fresh member has been compared already
    lists = lists.withColumn("__any", F.max("fresh").over(Window.partitionBy("v"))).filter("__any = 1").drop("__any")
    worst = edges.groupBy("u").agg(F.when(F.count("*") >= K, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
    known = _join(code, worst, F.col("nid") == F.col("u"), "left").select(F.col("nid").alias("x"), "coarse", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))
    found = _compared(lists, known, "coarse", _of_coarse, K)
    both = edges.select("u", "w", "sim", F.lit(0).alias("fresh")).union(found.select("u", "w", "sim", F.lit(1)))
    return _best(_distinct(both, "u", "w", F.max("sim").alias("sim"), F.min("fresh").alias("fresh")), K)


def _score(reader):
    """Similarities of pairs (u, w), both of whose vectors came."""

    def run(pairs: pa.Table, vecs: pa.Table) -> pa.Table:
        ids = vecs.column("x").to_numpy()
        if not len(ids) or not len(pairs):
            return _edges([], [], [])
        order = np.argsort(ids)
        ids = ids[order]
        rows = reader(vecs)
        u, w = pairs.column("u").to_numpy(), pairs.column("w").to_numpy()
        a, b = order[np.searchsorted(ids, u)], order[np.searchsorted(ids, w)]
        s = np.concatenate([np.einsum("ij,ij->i", rows(a[k : k + 4096]), rows(b[k : k + 4096])) for k in range(0, len(u), 4096)])
        return _edges(u, w, s)

    return run


def _needed(pairs: DataFrame) -> DataFrame:
    """Rows (block, x): what each block needs to score its pairs (block, u, w)."""
    return pairs.select("block", F.col("w").alias("x")).union(pairs.select("block", "u")).distinct()


def _scored(pairs: DataFrame, vecs: DataFrame, columns: list[str], reader) -> DataFrame:
    """Pairs (block, u, w) with their similarity, vecs having (block, x) and the columns that the reader takes."""
    a = pairs.select(F.col("block").alias("a"), F.col("u").alias("u"), F.col("w").alias("w"))
    b = vecs.select(F.col("block").alias("b"), F.col("x").alias("x"), *[F.col(c).alias(c) for c in columns])
    run = _score(reader)
    return a.groupBy("a").cogroup(b.groupBy("b")).applyInArrow(lambda x, y: run(x, y), "u bigint, w bigint, sim float")


def search(index: Index, queries: DataFrame, k: int, hops: int = HOPS) -> DataFrame:
    """Rows (query, neighbour, similarity, rank): the k most similar chunks of each query chunk, itself left out.

    Greedy search: from the node's own neighbours, the best nodes not yet expanded give their neighbours,
    hops times. `queries` has chunk_id; those without a usable vector get nothing, repeated ones count once.
    """
    s = index.scratch
    q = _join(queries.select("chunk_id").distinct(), index.names.select("chunk_id", "nid"), "chunk_id").select(F.col("nid").alias("u"))
    step = _lists(index.edges.withColumn("fresh", F.lit(0)), REVERSE).select(F.col("v").alias("x"), F.col("x").alias("y"))
    step = s.keep(step)
    s.sweep()
    placed = index.blocks.withColumnRenamed("nid", "u")

    def score(pairs: DataFrame) -> DataFrame:
        pairs = _join(pairs, placed, "u").select("block", "u", "w")
        near = _join(_needed(pairs), index.code.select(F.col("nid").alias("x"), "code"), "x")
        return _scored(pairs, near, ["code"], _of_code)

    # the graph's similarities are those of coarse codes: the start is scored anew
    first = _join(index.edges.select("u", "w"), q, "u", "left_semi")
    state = s.keep(score(first).withColumn("open", F.lit(True)))
    for _ in range(hops):
        w = Window.partitionBy("u").orderBy(F.col("open").desc(), F.col("sim").desc(), "w")
        ranked = state.withColumn("__rn", F.row_number().over(w)).withColumn("go", F.col("open") & (F.col("__rn") <= EXPAND))
        reached = _join(ranked.filter("go").select("u", F.col("w").alias("x")), step, "x").select("u", F.col("y").alias("w"), F.lit(0).alias("known")).filter("u <> w")
        reached = _distinct(reached.union(state.select("u", "w", F.lit(1))), "u", "w", F.max("known").alias("known")).filter("known = 0")
        scored = score(reached)
        merged = ranked.select("u", "w", "sim", (F.col("open") & ~F.col("go")).alias("open")).union(scored.select("u", "w", "sim", F.lit(True)))
        new = s.keep(_best(merged, BEAM))
        s.drop(state)
        state = new
    best = _join(_close(state.select("u", "w", "sim"), k, CLOSE), index.blocks.withColumnRenamed("nid", "u"), "u").select("block", "u", "w")
    best = s.keep(best)
    return _finished(index, best, k)


def _finished(index: Index, best: DataFrame, k: int) -> DataFrame:
    """Rows (query, neighbour, similarity, rank): the k best of the kept pairs (block, u, w) on the twelve-bit vectors."""
    last = _join(_needed(best), index.names.select(F.col("nid").alias("x"), "h"), "x").select("block", "x", "h")
    near = _join(index.vec.select("h", "v", "scale").dropDuplicates(["h"]), last, "h")
    state = _scored(best, near, ["v", "scale"], _of_vector)
    names = index.names.select("nid", "chunk_id")
    out = _join(_join(state, names.select(F.col("nid").alias("u"), F.col("chunk_id").alias("query")), "u"), names.select(F.col("nid").alias("w"), F.col("chunk_id").alias("neighbour")), "w")
    w = Window.partitionBy("query").orderBy(F.col("sim").desc(), "neighbour")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", "neighbour", F.col("sim").alias("similarity"), "rank")


_COLUMNS = ["chunk_id", "model", "embedding", "embedded_at"]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    index = build_index(spark, read(spark, d, "chunk_embeddings", *_COLUMNS))
    r = search(index, read(spark, d, "probe_chunks", "chunk_id"), 5)
    return r.select(F.least("query", "neighbour").alias("chunk_id_a"), F.greatest("query", "neighbour").alias("chunk_id_b")).distinct()


def p7_graph(spark: SparkSession, d: str) -> DataFrame:
    """For every usable vector its five most similar chunks: the search of p7_found, with every chunk as a query."""
    index = build_index(spark, read(spark, d, "chunk_embeddings", *_COLUMNS))
    return search(index, index.names, 5, GRAPH_HOPS).select(F.col("query").alias("chunk_id"), "neighbour", F.col("similarity").cast("double").alias("similarity"))


SQL = {
    "p7_found": """
with u as (select chunk_id, embedding, row_number() over (partition by chunk_id order by embedded_at desc) as rn from chunk_embeddings
  where model = 'quartz-embed-512' and len(embedding) = 512 and len(list_filter(embedding, lambda x: not isfinite(x) or x is null)) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
v as (select chunk_id, embedding::double[] as e from u where rn = 1),
q as (select distinct chunk_id from probe_chunks),
s as (select q.chunk_id as a, w.chunk_id as b, list_cosine_similarity(v.e, w.e) as sim from q join v using (chunk_id) join v w on w.chunk_id <> q.chunk_id),
t as (select a, b, row_number() over (partition by a order by sim desc, b) as rn from s)
select distinct least(a, b) as chunk_id_a, greatest(a, b) as chunk_id_b from t where rn <= 5""",
}
