"""Problem 1: splitting oversized chunks at natural boundaries.

A chunk over its limit is parsed into a tree: Markdown headings, blocks, list items, lines, sentences and
words for prose; indentation blocks for code. From the bottom up, sibling subtrees are merged while they fit a piece;
only a node that fits none is descended into, and what it comes to stays apart from its siblings, unless one of them is
too small to stand alone. Pieces are spans of the text: nothing is trimmed or rewritten, so the pieces without their
overlaps join up to the text again.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import read
from .arrow import map_rows

# The limits of the problem.
PROSE_CHARS = 1_800
CODE_CHARS = 12_000
CODE_LINES = 120
CODE_OVERLAP_LINES = 20
#: A sibling below this share of the limit joins a neighbour's part rather than stand alone.
SMALL = 1 / 8


def oversized(source_type: Column, content: Column) -> Column:
    """Whether a chunk is over its limit; a null source type is prose, a null content never is."""
    lines = F.char_length(content) - F.char_length(F.replace(content, F.lit("\n"))) + 1
    code = (F.char_length(content) > CODE_CHARS) | (lines > CODE_LINES)
    over = F.when(source_type.eqNullSafe("source_code"), code).otherwise(F.char_length(content) > PROSE_CHARS)
    return F.coalesce(over, F.lit(False))


_HEADING = re.compile(r"(#{1,6})\s")
_LIST = re.compile(r"(\s*)(?:[-*+]|\d+[.)])\s")
_SENTENCE = re.compile(r"(?<=[.!?。！？])[\"')\]]*\s+")
_WORD = re.compile(r"\s+")
_CODE_CUT = re.compile(r"(?<=[;,{}])|(?<=\s)")


class Node:
    """A span of the text and the spans that tile it; without children only characters are left to cut."""

    __slots__ = ("start", "end", "kids")

    def __init__(self, start: int, end: int, kids=None):
        self.start, self.end, self.kids = start, end, kids


def _cut(text: str, start: int, end: int, at) -> list[tuple[int, int]]:
    """The span cut after each match of a pattern."""
    out, last = [], start
    for m in at.finditer(text, start, end):
        if last < m.end() < end:
            out.append((last, m.end()))
            last = m.end()
    out.append((last, end))
    return out


def _inline(text: str, start: int, end: int) -> Node:
    """A line or paragraph: sentences, and in them words."""
    kids = []
    for a, b in _cut(text, start, end, _SENTENCE):
        words = [Node(x, y) for x, y in _cut(text, a, b, _WORD)]
        kids.append(Node(a, b, words if len(words) > 1 else None))
    return Node(start, end, kids) if len(kids) > 1 else kids[0]


def _lines(text: str) -> list[tuple[int, int]]:
    out, pos = [], 0
    while pos < len(text):
        e = text.find("\n", pos) + 1
        e = e or len(text)
        out.append((pos, e))
        pos = e
    return out


def _group(spans: list[Node]) -> Node:
    return spans[0] if len(spans) == 1 else Node(spans[0].start, spans[-1].end, spans)


def prose_tree(text: str) -> Node:
    """Sections by heading level over blocks (paragraph, list, fence) over lines, sentences and words."""
    blocks: list[tuple[int, Node]] = []  # (heading level or 0, block)
    fence = None
    cur: list[Node] = []
    level = 0

    def close() -> None:
        nonlocal cur
        if cur:
            blocks.append((level, _group(_items(text, cur))))
            cur = []

    for a, b in _lines(text):
        line = text[a:b]
        bare = line.strip()
        if fence is None and bare[:3] in ("```", "~~~"):
            close()
            level, fence = 0, bare[:3]
            cur.append(_inline(text, a, b))
        elif fence is not None:
            cur.append(_inline(text, a, b))
            if bare[:3] == fence:
                fence = None
                close()
        elif not bare:
            # blank lines end a block and stay with it
            if cur:
                cur.append(Node(a, b))
                close()
            elif blocks:
                lv, n = blocks[-1]
                blocks[-1] = (lv, Node(n.start, b, [n, Node(a, b)]))
            else:
                cur.append(Node(a, b))
        else:
            m = _HEADING.match(line)
            if m:
                close()
                level = len(m.group(1))
                cur.append(_inline(text, a, b))
                close()
                level = 0
            else:
                cur.append(_inline(text, a, b))
    close()
    return _sections(blocks, 1) if blocks else Node(0, len(text))


def _items(text: str, lines: list[Node]) -> list[Node]:
    """Lines of a block, those of a list nested by indentation under their item."""
    root: list = []
    open_items: list[tuple[int, list]] = []  # items around the line, with their indentation
    for n in lines:
        m = _LIST.match(text, n.start, n.end)
        if m:
            indent = len(m.group(1))
            while open_items and open_items[-1][0] >= indent:
                open_items.pop()
            item = [n]
            (open_items[-1][1] if open_items else root).append(item)
            open_items.append((indent, item))
        else:
            (open_items[-1][1] if open_items else root).append(n)
    return [_build(x) for x in root]


def _build(x) -> Node:
    """Nested lists to nodes, without recursion."""
    done: list[Node] = []
    work = [(x, False, 0)]
    while work:
        item, ready, mark = work.pop()
        if isinstance(item, Node):
            done.append(item)
        elif ready:
            kids = done[mark:]
            del done[mark:]
            if kids:
                done.append(_group(kids))
        else:
            work.append((item, True, len(done)))
            work.extend((k, False, 0) for k in reversed(item))
    return done[0]


def _sections(blocks: list[tuple[int, Node]], level: int) -> Node:
    """Blocks grouped under headings of this level or deeper; a heading stays with the block that follows it."""
    if level > 6:
        out, i = [], 0
        while i < len(blocks):
            if blocks[i][0] and i + 1 < len(blocks):
                nxt = blocks[i + 1][1]
                out.append(Node(blocks[i][1].start, nxt.end, [blocks[i][1], *(nxt.kids or [nxt])]))
                i += 2
            else:
                out.append(blocks[i][1])
                i += 1
        return _group(out)
    starts = [i for i, (lv, _) in enumerate(blocks) if lv == level]
    if not starts:
        return _sections(blocks, level + 1)
    cuts = ([0] if starts[0] else []) + starts + [len(blocks)]
    return _group([_sections(blocks[a:b], level + 1) for a, b in zip(cuts, cuts[1:])])


def code_tree(text: str) -> Node:
    """Blocks by indentation: a line heads the deeper lines that follow, and a closing line ends its block."""
    lines = _lines(text)
    if not lines:
        return Node(0, 0)
    depth = []
    for a, b in lines:
        s = text[a:b].expandtabs(4)
        depth.append(len(s) - len(s.lstrip()) if s.strip() else -1)
    # a blank line belongs to what stands before it
    nodes = [Node(a, b, [Node(x, y) for x, y in _cut(text, a, b, _CODE_CUT)] if b - a > CODE_CHARS else None) for a, b in lines]
    return _blocks(text, nodes, depth, 0, len(nodes))


_CLOSER = re.compile(r"\s*[)\]}]|\s*(?:else|elif|except|finally|catch|end|case|default)\b")
_LEAD = re.compile(r"\s*(?:#|//|/\*|\*|--|@)")


def _blocks(text: str, nodes: list[Node], depth: list[int], lo: int, hi: int) -> Node:
    """Nodes lo to hi as siblings at their least depth. Works through an explicit stack, so depth of nesting is free."""
    root: list = []
    stack = [(lo, hi, root)]
    while stack:
        a, b, out = stack.pop()
        live = [d for d in depth[a:b] if d >= 0]
        if not live or b - a == 1:
            out.extend(nodes[a:b])
            continue
        base = min(live)
        heads: list[int] = []
        for i in range(a, b):
            if depth[i] == base and not _CLOSER.match(text, nodes[i].start, nodes[i].end):
                # a comment or decorator leads the line after it
                if heads and heads[-1] == i - 1 and _LEAD.match(text, nodes[i - 1].start, nodes[i - 1].end):
                    continue
                heads.append(i)
        if not heads or heads[0] != a:
            heads.insert(0, a)
        if len(heads) == 1:
            # one block: its head, then its inside
            kids: list = [nodes[a]]
            inner: list = []
            kids.append(inner)
            out.append(kids)
            stack.append((a + 1, b, inner))
            continue
        for x, y in zip(heads, [*heads[1:], b]):
            if y - x == 1:
                out.append(nodes[x])
            else:
                inner = []
                out.append([nodes[x], inner])
                stack.append((x + 1, y, inner))

    return _build(root)


class Packer:
    """Pieces of one text. A piece that starts at a place has a fixed overlap before it, so whether a span fits depends on the span alone."""

    def __init__(self, text: str, code: bool):
        self.text, self.code = text, code
        self.limit = CODE_CHARS if code else PROSE_CHARS
        self.feeds = [m.start() for m in re.finditer("\n", text)]

    def over(self, at: int) -> int:
        """Where the overlap of a piece that starts here starts: 20 lines before, fewer where these and the next line exceed the limit."""
        if not self.code or at == 0 or self.text[at - 1] != "\n":
            return at
        i = bisect_left(self.feeds, at)  # of the line that starts here
        end = self.feeds[i] + 1 if i < len(self.feeds) else len(self.text)
        for k in range(max(0, i - CODE_OVERLAP_LINES), i):
            start = self.feeds[k - 1] + 1 if k else 0
            if end - start <= self.limit:
                return start
        return at

    def fits(self, a: int, b: int) -> bool:
        o = self.over(a)
        return b - o <= self.limit and (not self.code or bisect_left(self.feeds, b) - bisect_left(self.feeds, o) + 1 <= CODE_LINES)

    def cut(self, a: int, b: int) -> list[tuple[int, int]]:
        """A span without structure, cut where the limit ends it; a carriage return stays with its line feed."""
        out = []
        while not self.fits(a, b):
            end = a + self.limit
            if self.code:
                # as many line feeds as a piece may hold, the last of them ending it
                k = bisect_left(self.feeds, a) + CODE_LINES - 1
                end = min(end, self.feeds[k - 1] + 1 if k - 1 < len(self.feeds) else end)
            if self.text[end - 1 : end + 1] == "\r\n" and end - 1 > a:
                end -= 1
            out.append((a, end))
            a = end
        return [*out, (a, b)]

    def join(self, out: list, piece: tuple[int, int, bool]) -> None:
        """Add a piece (start, end, whether it is made of whole siblings) to those before, merged with the last if it may be."""
        if out:
            a, m, left = out[-1]
            _, b, right = piece
            small = SMALL * self.limit
            if self.fits(a, b) and (left == right or (m - a if left else b - m) < small):
                out[-1] = (a, b, left and right)
                return
        out.append(piece)

    def pieces(self, tree: Node) -> list[tuple[int, int]]:
        """Bottom-up over the tree, through an explicit stack."""
        result: list = []
        stack = [(tree, None, [])]  # node, its children still to come, pieces of those done
        while stack:
            node, kids, out = stack.pop()
            if kids is None:
                if self.fits(node.start, node.end):
                    done = [(node.start, node.end, True)]
                elif not node.kids:
                    done = [(a, b, False) for a, b in self.cut(node.start, node.end)]
                else:
                    stack.append((node, iter(node.kids), out))
                    continue
            else:
                kid = next(kids, None)
                if kid is not None:
                    stack += [(node, kids, out), (kid, None, [])]
                    continue
                # to its siblings all that a node too large for a piece comes to is a part
                done = [(a, b, False) for a, b, _ in out]
            into = stack[-1][2] if stack else result
            for k, piece in enumerate(done):
                # parts of one node have been merged with each other already
                into.append(piece) if k else self.join(into, piece)
        return [(a, b) for a, b, _ in result]


def pack(text: str, code: bool) -> list[tuple[int, int, int]]:
    """The pieces of an oversized text as (start of the overlap, start, end)."""
    p = Packer(text, code)
    spans = p.pieces(code_tree(text) if code else prose_tree(text))
    return [(p.over(a), a, b) for a, b in spans]


_SCHEMA = "chunk_id string, piece int, pieces int, content string, start_line int, end_line int, char_start int, char_end int, overlap_chars int"


def _split(chunk_id, source_type, content, start_line):
    spans = pack(content, source_type == "source_code")
    first = start_line if start_line is not None else 1
    for k, (over, start, end) in enumerate(spans):
        a = first + content.count("\n", 0, over)
        b = a + content.count("\n", over, end - 1)
        yield chunk_id, k, len(spans), content[over:end], a, b, over, end, start - over


def split_oversized(chunks: DataFrame) -> DataFrame:
    """The pieces of every chunk over its limit, one row each.

    `chunks` has id, source_type, content and start_line. Columns: chunk_id, piece (from 0), pieces, content,
    start_line and end_line (1-based lines of the document; of the chunk where its start_line is null),
    char_start and char_end (code points of the chunk's content, the overlap included) and overlap_chars.
    Chunks within the limit and null contents give no rows; repeated chunks give repeated rows. A piece shares
    fewer than 20 lines with the piece before only where these and the next line exceed 12,000 characters, and none
    where it starts within a line that had to be cut.
    """
    c = chunks.select("id", "source_type", "content", "start_line").filter(oversized(F.col("source_type"), F.col("content")))
    return map_rows(c, _SCHEMA, _split)


def renumber(chunks: DataFrame, pieces: DataFrame) -> DataFrame:
    """All chunks with the oversized ones replaced by their pieces, chunk_index running anew in each document.

    One row a chunk id (the one indexed last) or piece. The new index is the old order of chunks, then of
    pieces. It is counted from slim rows; the texts only join at the end.
    """
    w = Window.partitionBy("id").orderBy(F.col("indexed_at").desc_nulls_last(), F.col("content").desc_nulls_last())
    c = chunks.select("id", "document_id", "source_type", "chunk_index", "content", "start_line", "end_line", "indexed_at")
    c = c.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "indexed_at")
    p = pieces.dropDuplicates(["chunk_id", "piece"]).select(F.col("chunk_id").alias("__chunk"), "piece", "pieces", F.col("content").alias("__content"), F.col("start_line").alias("__start"), F.col("end_line").alias("__end"), "overlap_chars")
    j = c.join(p, F.col("id") == F.col("__chunk"), "left")
    j = j.select("id", "document_id", "source_type", "chunk_index", F.coalesce("piece", F.lit(0)).alias("piece"), F.coalesce("pieces", F.lit(1)).alias("pieces"), F.coalesce("__content", "content").alias("content"), F.coalesce("__start", "start_line").alias("start_line"), F.coalesce("__end", "end_line").alias("end_line"), F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"))
    order = Window.partitionBy("document_id").orderBy(F.col("chunk_index").asc_nulls_last(), "id", "piece")
    return j.withColumn("chunk_index", (F.row_number().over(order) - 1).cast("int")).withColumnRenamed("id", "chunk_id")


_COLUMNS = ["id", "source_type", "content", "start_line"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(read(spark, d, "document_chunks", *_COLUMNS)).filter("piece = 0").select("chunk_id").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk or piece with its new index."""
    c = read(spark, d, "document_chunks", *_COLUMNS, "document_id", "chunk_index", "end_line", "indexed_at")
    return renumber(c, split_oversized(c))


SQL = {
    "p1_found": r"""select distinct id as chunk_id from document_chunks where case when source_type = 'source_code'
  then length(content) > 12000 or length(content) - length(replace(content, chr(10), '')) + 1 > 120 else length(content) > 1800 end""",
}
