"""Problem 10: keyword-stuffed and link-list pages.

Each page's suffix automaton tells which of its characters lie in repeated maximal substrings; its clauses tell
which lie outside any clause structure (no function words). Characters that are neither are sentences. Of the
rest, a page about the project names what the project's sentences name: which words those are is counted over
the clauses of the whole collection, not listed. A page that is mainly repeats and loose words that no sentence
of the collection speaks of is promotion.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch
from ..sources.tables import read

#: A substring counts as repeated from so many occurrences and characters on.
OCCURRENCES = 3
LENGTH = 5
#: A clause has structure if one in so many of its words is a function word, and is stuffed if such a share of it is repeated.
FUNCTION_EVERY, STUFFED = 8, 0.5
#: A line or sentence is about the project if such a share of its characters are identifiers, paths, references and the like.
MARKED = 0.3
#: A page is promotion if such a share of its characters, and so many of them, are repeated or loose and foreign.
PROMOTION, CHARACTERS = 0.3, 120
#: A word is one of the project's if so many pages have it in sentences, and no fewer than have it in lists and loops.
PAGES_AT_LEAST = 2
#: Words found on more than this share of all listed words' pages are joined by broadcast: there are at most 1 / HOT of them.
HOT = 0.001

# Function words of English, German, Spanish and French.
FUNCTION_WORDS = frozenset(
    """a an the and or but if then than that this these those it its is are was were be been has have had do does did not no
    of to in on at by for from with without as so because while when which who what where how i we you they he she our your
    their my me us them can could should would will may might must only before after until into over under here there
    otherwise although whenever instead once never
    der die das ein eine einen einem einer und oder aber wenn dass ist sind war wird werden hat haben nicht kein keine
    mit auf für von zu im dem den des wir ich sie es er nach bei aus als noch nur seit trotzdem sollte bitte mehr
    el la los las un una unos unas y o pero si que es son fue ha han no ni de del al en con por para se lo le su sus ya más
    cuando todo podría propongo sin
    le les des du et ou mais ne pas est sont dans qui pour avec sur plus ce cette il elle nous vous se au aux après avant
    depuis quand on pourrait faut""".split()
)

_TOKEN = re.compile(r"[^\W_]+")
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_CUT = re.compile(r"(?<=[.!?])\s+|\n+")
#: What a project is written about with: code, identifiers, references, digests, versions, times, paths, blobs, check boxes.
_MARK = re.compile(
    r"""`[^`\n]+`|\b[a-z]+(?:[A-Z][a-z0-9]*)+\b|\b[A-Z][a-z]+(?:[A-Z][a-z0-9]*)+\b|\b\w+\(\)|(?<!\w)\#\d+\b|\b(?=[a-f]*\d)[0-9a-f]{7,40}\b
    |\bv?\d+\.\d+\.\d+\b|\d{4}-\d\d-\d\dT[\d:]+Z?|(?<![/\w.:])(?:[\w.-]+/)+[\w-]+\.[a-z]{1,4}\b(?::\d+)*|[A-Za-z0-9+/=]{40,}
    |https?://[^\s<>"')\]]+/(?:issues|pull|commit|compare|blob|tree)/[^\s<>"')\]]*|\[[ xX]\]""",
    re.X | re.M,
)
_URL = re.compile(r"https?://[^\s<>\"')\]]+")


def repeated(text: str, occurrences: int = OCCURRENCES, length: int = LENGTH) -> tuple[list[tuple[int, int]], list[bool]]:
    """The spans of a text's words, and whether each lies in a substring of at least `length` characters that occurs at least `occurrences` times.

    A suffix automaton with the words as alphabet: each state's occurrences follow from its links, and at each
    position the longest suffix that repeats often enough is covered.
    """
    words: dict[str, int] = {}
    spans: list[tuple[int, int]] = []
    seq: list[int] = []
    low = text.lower()
    if len(low) != len(text):
        low = text  # a letter whose lower case is longer; positions count
    for m in _TOKEN.finditer(low):
        spans.append(m.span())
        seq.append(words.setdefault(m.group(), len(words)))
    n = len(seq)
    if n < occurrences:
        return spans, [False] * n
    link, longest, nxt, count = [-1], [0], [{}], [0]
    last = 0
    ends = []
    for c in seq:
        cur = len(link)
        link.append(0)
        longest.append(longest[last] + 1)
        nxt.append({})
        count.append(1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if longest[p] + 1 == longest[q]:
                link[cur] = q
            else:
                clone = len(link)
                link.append(link[q])
                longest.append(longest[p] + 1)
                nxt.append(nxt[q].copy())
                count.append(0)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
        ends.append(cur)
    order = sorted(range(1, len(link)), key=longest.__getitem__)
    for s in reversed(order):
        count[link[s]] += count[s]
    best = [0] * len(link)  # the longest suffix of the state that repeats often enough
    for s in order:
        best[s] = longest[s] if count[s] >= occurrences else best[link[s]]
    covered, reach = [False] * n, n
    for i in range(n - 1, -1, -1):
        k = best[ends[i]]
        if k and spans[i][1] - spans[i - k + 1][0] >= length:
            reach = min(reach, i - k + 1)
        covered[i] = reach <= i
    return spans, covered


def coverage(text: str, occurrences: int = OCCURRENCES, length: int = LENGTH) -> float:
    """The share of a text's word characters that lie in repeated substrings."""
    spans, covered = repeated(text, occurrences, length)
    total = sum(b - a for a, b in spans)
    return sum(b - a for (a, b), c in zip(spans, covered) if c) / total if total else 0.0


def _blank(m: re.Match) -> str:
    return " " * len(m.group())


class Page:
    """What a page is made of, in characters of words: all, repeated, loose, marked; and the words that may be promotion."""

    __slots__ = ("characters", "covered", "loose", "suspects", "spoken", "listed")

    def __init__(self, text: str, by_coverage: bool = True, by_clauses: bool = True):
        text = _TAG.sub(_blank, _FENCE.sub(_blank, text))
        spans, cov = repeated(text)
        if not by_coverage:
            cov = [False] * len(cov)
        marks = bytearray(len(text) + 1)
        for m in _MARK.finditer(text):
            marks[m.start() : m.end()] = b"\1" * (m.end() - m.start())
        links = bytearray(len(text) + 1)
        for m in _URL.finditer(text):
            links[m.start() : m.end()] = b"\1" * (m.end() - m.start())
        self.characters = self.covered = self.loose = 0
        #: Characters by word of what is repeated or loose, and no function word and not marked.
        self.suspects: dict[str, int] = {}
        #: Words of sentences, and of lists and loops.
        self.spoken: set[str] = set()
        self.listed: set[str] = set()
        i = 0
        for end in [m.end() for m in _CUT.finditer(text)] + [len(text)]:
            first = i
            while i < len(spans) and spans[i][0] < end:
                i += 1
            if i > first:
                self._clause(text, spans[first:i], cov[first:i], marks, links, by_clauses)

    def _clause(self, text, spans, cov, marks, links, by_clauses) -> None:
        words = [text[a:b].lower() for a, b in spans]
        size = sum(b - a for a, b in spans)
        covered = sum(b - a for (a, b), c in zip(spans, cov) if c)
        marked = sum(b - a for a, b in spans if marks[a])
        alpha = [w for w in words if w.isalpha()]
        loose = by_clauses and sum(w in FUNCTION_WORDS for w in alpha) * FUNCTION_EVERY < max(1, len(alpha))
        stuffed = covered >= STUFFED * size
        self.characters += size
        self.covered += covered
        self.loose += size if loose else 0
        into = self.listed if loose or stuffed else self.spoken
        carried = 0
        for k, ((a, b), w, c) in enumerate(zip(spans, words, cov)):
            if marks[a] or w in FUNCTION_WORDS:
                carried = 0
                continue
            if len(w) >= 3 and w.isalpha():
                into.add(w)
            if marked >= MARKED * size or not (loose or c):
                carried = 0
                continue
            if text[b : b + 1] == "/" and k + 1 < len(spans) and spans[k + 1][0] == b + 1 and not links[a]:
                carried += b - a  # a label such as area/cache is about what it ends in
                continue
            self.suspects[w] = self.suspects.get(w, 0) + b - a + carried
            carried = 0


def is_promotion(foreign: int, characters: int) -> bool:
    """Whether so many of a page's characters are repeated or loose words that the project's sentences do not have."""
    return foreign >= CHARACTERS and foreign >= PROMOTION * characters


_PASS = "row string, doc_id bigint, characters int, covered int, loose int, word string, n bigint, spoken bigint, listed bigint"


def _pages(documents: DataFrame, by_coverage: bool, by_clauses: bool) -> DataFrame:
    """One pass over the texts: a row a page (word null), a row a suspect word of a page that could be promotion, and
    pre-aggregated rows of the vocabulary (row null)."""
    names = [c.split()[0] for c in _PASS.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        types = {"row": pa.string(), "word": pa.string(), "doc_id": pa.int64(), "characters": pa.int32(), "covered": pa.int32(), "loose": pa.int32()}
        for b in batches:
            out, spoken, listed = [], {}, {}
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                p = Page(text or "", by_coverage, by_clauses)
                row = f"{part}-{at}"
                at += 1
                out.append((row, doc_id, p.characters, p.covered, p.loose, None, None, None, None))
                # the vocabulary can only take words away: who does not reach the threshold with all of them is done
                if is_promotion(sum(p.suspects.values()), p.characters):
                    out += [(row, doc_id, p.characters, None, None, w, n, None, None) for w, n in p.suspects.items()]
                for w in p.spoken:
                    spoken[w] = spoken.get(w, 0) + 1
                for w in p.listed:
                    listed[w] = listed.get(w, 0) + 1
            out += [(None, None, None, None, None, w, None, spoken.get(w, 0), listed.get(w, 0)) for w in spoken.keys() | listed.keys()]
            cols = list(zip(*out)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, types.get(k, pa.int64())) for k, c in zip(names, cols)], names=names)

    return documents.select("doc_id", "text").mapInArrow(run, _PASS)


def score_pages(documents: DataFrame, by_coverage: bool = True, by_clauses: bool = True) -> DataFrame:
    """Rows (doc_id, characters, coverage, clauseless, foreign_share, promotional), one a row of (doc_id, text).

    characters are those of words; coverage and clauseless the shares of them that are repeated and that stand
    outside clauses; foreign_share that of repeated or clauseless words which the sentences of `documents` do not
    speak of. Null and empty texts, and texts without words, are not promotional; a null doc_id is kept, repeated
    rows are scored each. by_coverage and by_clauses switch a part of the evidence off, to see what it decides.
    """
    scratch = Scratch(documents.sparkSession, "pages")
    t = scratch.keep(_pages(documents, by_coverage, by_clauses))
    pages = t.filter("row is not null and word is null")
    suspects = t.filter("row is not null and word is not null").select("row", "word", "n")
    words = scratch.keep(t.filter("row is null").groupBy("word").agg(F.sum("spoken").alias("spoken"), F.sum("listed").alias("listed")))
    own = words.filter((F.col("spoken") >= PAGES_AT_LEAST) & (F.col("spoken") >= F.col("listed"))).select("word", "listed")
    # a word of a third of all pages is a hot key of the join: such words are few by their share, and sent to all tasks
    total = words.agg(F.sum("listed")).first()[0] or 0
    frequent = own.filter(F.col("listed") > HOT * total).select("word", F.lit(True).alias("own"))
    left = suspects.join(F.broadcast(frequent), "word", "left").filter("own is null").drop("own")
    left = left.join(own.filter(F.col("listed") <= HOT * total).select("word"), "word", "left_anti")
    foreign = left.groupBy("row").agg(F.sum("n").alias("foreign"))
    out = pages.join(foreign, "row", "left").withColumn("foreign", F.coalesce("foreign", F.lit(0)))

    def share(c: str):
        return F.coalesce(F.col(c) / F.nullif(F.col("characters"), F.lit(0)), F.lit(0.0))

    return out.select("doc_id", "characters", share("covered").alias("coverage"), share("loose").alias("clauseless"), share("foreign").alias("foreign_share"), ((F.col("foreign") >= CHARACTERS) & (F.col("foreign") >= PROMOTION * F.col("characters"))).alias("promotional"))


#: Endings of pages; other files of a repository are no pages.
PAGES = ["md", "markdown", "mdx", "rst", "txt", "adoc", "html", "htm"]


def posts_and_pages(documents: DataFrame) -> DataFrame:
    """Documents that are posts (anything but source files) or pages (documentation among the files)."""
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return documents.filter(~F.col("source_type").eqNullSafe("source_code") | F.col("path").isNull() | ending.isin(PAGES))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return score_pages(posts_and_pages(read(spark, d, "documents", "doc_id", "text", "source_type", "path")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).filter("promotional").select("doc_id")
