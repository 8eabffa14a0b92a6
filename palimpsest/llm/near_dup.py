"""Problem 2: near-duplicate chunks, by minhash with tensored banding.

Exact copies form a class first. Each class gets two small collections of half-keys, every half-key being a
few minhash values over its word shingles; a table key combines one half-key of either collection, so that
m * m tables need only 2 * m half-keys. Classes that meet in any table are candidates and are verified on
their exact shingle sets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch
from ..sources.tables import read
from .arrow import map_rows

#: Parameters of problem 2: words a shingle, least shared part of all distinct shingles, least words a text.
WORDS = 3
SIMILARITY = 0.7
MIN_WORDS = 30
#: Half-keys in each of the two collections, minhash values in a half-key. With s the similarity, a pair meets
#: with probability (1 - (1 - s**2)**8)**2: 0.991 at 0.7, 0.997 at 0.75, 0.9998 at 0.8.
HALVES = 8
VALUES = 2
#: Members of a table key that one task of the pair join sees at most; larger keys are cut into blocks.
BLOCK = 64

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_S32, _S29 = np.uint64(32), np.uint64(29)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S32)) * _MUL
    x = (x ^ (x >> _S29)) * _MIX
    return x ^ (x >> _S32)


class _Tables:
    """Powers of an odd base modulo 2**64 and of its inverse, and which characters belong to words; made on first use."""

    BASE = 0xD6E8FEB86659FD93

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)
        self.word = None

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            inverse = pow(self.BASE, -1, 1 << 64)
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, self.BASE, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, inverse, np.uint64)]), dtype=np.uint64)
        return self.up, self.down

    def is_word(self, codes: np.ndarray) -> np.ndarray:
        if self.word is None:
            self.word = np.array([chr(c).isalnum() for c in range(0x10000)])
        if codes.max() < 0x10000:
            return self.word[codes]
        return np.array([chr(c).isalnum() for c in codes.tolist()])


_TABLES = _Tables()
_A, _B, _C = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def words_of(text: str) -> np.ndarray:
    """64-bit hashes of the words in order. A word is a maximal run of letters or digits of the lower-cased text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    if not n:
        return np.empty(0, np.uint64)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = _TABLES.is_word(codes)
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = _TABLES.powers(n)
    # sums of code * base**position; a word's share, moved to position 0, is its polynomial hash
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return _mix((total[end] - total[start]) * down[start])


def shingles(text: str, words: int = WORDS) -> tuple[int, np.ndarray]:
    """(number of words, sorted distinct hashes of the runs of `words` words)."""
    h = words_of(text)
    m = len(h) - words + 1
    if m < 1:
        return len(h), np.empty(0, np.uint64)
    s = h[:m].copy()
    for k in range(1, words):
        s = s * _A + h[k : k + m] * _B + _C
    return len(h), np.unique(_mix(s))


_SEEDS = _mix(np.arange(1, 4096, dtype=np.uint64) * _MUL) | np.uint64(1)


def _half_keys(s: np.ndarray, halves: int, values: int) -> list[int]:
    """2 * halves half-keys of a shingle set."""
    n = 2 * halves * values
    if len(s) <= 20_000:
        least = (s[:, None] * _SEEDS[None, :n]).min(axis=0)
    else:
        least = np.array([(s * x).min() for x in _SEEDS[:n]])
    key = np.zeros(2 * halves, np.uint64)
    for k in range(values):
        key = _mix(key + least[k::values])
    return key.view(np.int64).tolist()


def sketches(texts: DataFrame, words: int, min_words: int, halves: int = HALVES, values: int = VALUES) -> DataFrame:
    """Rows (cls, keys) for the columns (cls, text): the half-keys of every text of at least min_words words."""

    def one(cls, text):
        n, s = shingles(text, words)
        if n >= min_words and len(s):
            yield cls, _half_keys(s, halves, values)

    return map_rows(texts, "cls bigint, keys array<bigint>", one)


def _tables(sk: DataFrame, halves: int) -> DataFrame:
    """Rows (key, cls): the table keys of all combinations of a half-key of either collection."""
    a = sk.select("cls", F.slice("keys", halves + 1, halves).alias("right"), F.posexplode(F.slice("keys", 1, halves)).alias("i", "a"))
    b = a.select("cls", "i", "a", F.posexplode("right").alias("j", "b"))
    return b.select(F.xxhash64("i", "a", "j", "b").alias("key"), "cls")


def candidates(sk: DataFrame, halves: int = HALVES) -> DataFrame:
    """Distinct pairs (a, b), a < b, of classes that meet in a table.

    Most keys have one member and vanish in the aggregation; of those with two, least and greatest are the
    pair. Only the members of larger keys are joined, and a key with more than BLOCK members is cut into
    blocks by salt, every block meeting the key's members in a task of its own.
    """
    t = _tables(sk, halves)
    g = t.groupBy("key").agg(F.count("*").alias("n"), F.min("cls").alias("a"), F.max("cls").alias("b")).filter("a < b")
    two = g.filter("n = 2").select("a", "b")
    big = g.filter("n > 2").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    m = t.join(big, "key").select("key", "cls", "blocks")
    left = m.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).select("key", "block", F.col("cls").alias("a"))
    right = m.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "block", F.col("cls").alias("b"))
    more = left.join(right, ["key", "block"]).filter("a < b").select("a", "b")
    return two.unionByName(more).distinct()


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Pairs (a, b, similarity) whose shingle sets share at least `similarity`; texts has (cls, text)."""

    def one(a, b, x, y):
        _, s = shingles(x, words)
        _, t = shingles(y, words)
        if not (len(s) and len(t)):
            return
        both = len(np.intersect1d(s, t, assume_unique=True))
        j = both / (len(s) + len(t) - both)
        if j >= similarity:
            yield a, b, j

    left = texts.select(F.col("cls").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("cls").alias("b"), F.col("text").alias("y"))
    return map_rows(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), "a bigint, b bigint, similarity double", one)


def near_duplicates(spark: SparkSession, chunks: DataFrame, words: int = 5, similarity: float = 0.8, min_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, similarity) of classes of equal content, and members (cls, id).

    `chunks` has id and content. Ids repeat freely; null ids and contents belong to no class; an empty text,
    or one with fewer words than a shingle or than min_words, is in no pair. Copies are one class however
    many they are, so a text that makes up a third of all rows costs one sketch and no pair.
    """
    scratch = Scratch(spark, "neardup")
    c = chunks.select("id", "content").filter(F.col("id").isNotNull() & F.col("content").isNotNull()).withColumn("cls", F.xxhash64("content"))
    # a class's text stands in the row of its least id; only ids and class numbers are shuffled to find it
    members = scratch.keep(c.select("cls", "id").distinct())
    firsts = members.groupBy("cls").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    # sketches are made in the scan, before any shuffle; a copy costs a second sketch, not a shuffle of texts
    sk = scratch.keep(sketches(c.select("cls", F.col("content").alias("text")), words, min_words).dropDuplicates(["cls"]))
    pairs = scratch.keep(candidates(sk))
    involved = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().join(firsts.select("cls", "first"), "cls")
    texts = c.join(involved, "cls").filter(F.col("id") == F.col("first")).select("cls", F.col("content").alias("text")).dropDuplicates(["cls"])
    good = scratch.keep(verified(pairs, scratch.keep(texts), words, similarity))
    return good, members


def groups(spark: SparkSession, pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (id, group_id, links): each id with the least class of its connected component and its number of linked classes.

    Components by alternating large-star and small-star joins, cut at each round; a hub's links are never
    gathered, only their minimum is.
    """
    scratch = Scratch(spark, "groups")
    edges = scratch.keep(pairs.select("a", "b").filter("a < b").distinct())
    label = scratch.keep(edges.select(F.col("a").alias("cls")).union(edges.select("b")).distinct().withColumn("root", F.col("cls")))
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    while True:
        near = both.join(label.select(F.col("cls").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        hooked = label.join(near, F.col("cls") == F.col("a"), "left").select("cls", "root", F.least("root", "near").alias("low"))
        # pull every root down to the least root seen by its members, then follow it
        low = hooked.groupBy("root").agg(F.min("low").alias("jump"))
        nxt = scratch.keep(hooked.join(low, "root").select("cls", F.col("root").alias("old"), F.least("low", "jump").alias("root")))
        done = nxt.filter("old <> root").limit(1).count() == 0
        scratch.drop(label)
        label = nxt.select("cls", "root")
        label._palimpsest_path = nxt._palimpsest_path
        if done:
            break
    links = both.groupBy("a").agg(F.count("*").alias("links")).withColumnRenamed("a", "cls")
    out = members.join(label, "cls", "left").join(links, "cls", "left")
    return out.select("id", F.coalesce("root", "cls").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def _p2(spark: SparkSession, d: str):
    return near_duplicates(spark, read(spark, d, "document_chunks", "id", "content"), WORDS, SIMILARITY, MIN_WORDS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = _p2(spark, d)
    left = members.select(F.col("cls").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("cls").alias("b"), F.col("id").alias("y"))
    p = pairs.select("a", "b").join(left, "a").join(right, "b").filter("x <> y")
    return p.select(F.least("x", "y").alias("chunk_id_a"), F.greatest("x", "y").alias("chunk_id_b")).distinct()


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups(spark, *_p2(spark, d))


SQL = {
    "p2_found": r"""
with c as (select distinct content from document_chunks where content is not null),
w as (select row_number() over () as n, content, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') as w from c),
k as (select n, content, w from w where len(w) >= 30),
s as (select distinct n, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from (select n, w, unnest(range(1, len(w) - 1)) as i from k)),
z as (select n, count(*) as z from s group by n),
p as (select a.n as a, b.n as b, count(*) as both from s a join s b on a.s = b.s and a.n < b.n group by 1, 2),
g as (select p.a, p.b from p join z x on x.n = p.a join z y on y.n = p.b where p.both >= 0.7 * (x.z + y.z - p.both)),
m as (select distinct k.n, d.id from k join document_chunks d using (content))
select distinct least(x.id, y.id) as chunk_id_a, greatest(x.id, y.id) as chunk_id_b
from g join m x on x.n = g.a join m y on y.n = g.b where x.id <> y.id""",
}
