"""Documents from records, and chunks from documents: the memory's own generators."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# The sizes of chunks, in UTF-16 units, and of the code window in lines.
PROSE, CODE, LINES, OVERLAP, LABEL = 1_800, 12_000, 120, 20, 32


def _units(s: str) -> int:
    return len(s) + sum(c > "￿" for c in s) if not s.isascii() else len(s)


def _cut(s: str, n: int) -> int:
    """How many characters fit n UTF-16 units."""
    if s.isascii():
        return n
    used = 0
    for i, c in enumerate(s):
        used += 2 if c > "￿" else 1
        if used > n:
            return i
    return len(s)


def prose_chunks(text: str, limit: int = PROSE) -> list[str]:
    """Paragraphs packed in order while they fit with a blank line between; longer ones are cut at the last blank within the limit."""
    parts: list[str] = []
    for p in re.split(r"\n\s*\n", text.replace("\r\n", "\n")):
        p = p.strip()
        while _units(p) > limit:
            at = _cut(p, limit)
            blank = p.rfind(" ", 0, at + 1)
            at = blank if blank > 0 else at
            parts.append(p[:at].strip())
            p = p[at:].strip()
        if p:
            parts.append(p)
    out: list[str] = []
    for p in parts:
        if out and _units(out[-1]) + 2 + _units(p) <= limit:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    return out


def code_windows(text: str, limit: int = CODE, lines: int = LINES, overlap: int = OVERLAP) -> list[tuple[str, int, int]]:
    """(content, first line, last line): windows of lines within both limits, each but the first going back `overlap` lines.

    A line beyond the limit is cut into slices that stand alone. Windows of nothing but blanks are left out.
    """
    rows = text.replace("\r\n", "\n").split("\n")
    out: list[tuple[str, int, int]] = []
    i = 0
    while i < len(rows):
        if _units(rows[i]) > limit:
            s = rows[i]
            while s:
                k = _cut(s, limit)
                out.append((s[:k], i + 1, i + 1))
                s = s[k:]
            i += 1
            continue
        size, j = 0, i
        while j < len(rows) and j - i < lines:
            more = _units(rows[j]) + (1 if j > i else 0)
            if size + more > limit:
                break
            size += more
            j += 1
        content = "\n".join(rows[i:j])
        if content.strip():
            out.append((content, i + 1, j))
        if j >= len(rows):
            break
        i = max(j - overlap, i + 1)
    return out


# ---- symbols
_SYMBOL = {
    "TypeScript": [
        (re.compile(r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"), "class"),
        (re.compile(r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+([A-Za-z_$][\w$]*)"), "function"),
        (re.compile(r"^(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)"), "interface"),
        (re.compile(r"^(?:export\s+)?type\s+([A-Za-z_$][\w$]*)\b[^=]*="), "type"),
        (re.compile(r"^(?:export\s+)?(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)"), "enum"),
        (re.compile(r"^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)"), "variable"),
    ],
    "Python": [(re.compile(r"^class\s+([A-Za-z_]\w*)"), "class"), (re.compile(r"^(?:async\s+)?def\s+([A-Za-z_]\w*)"), "function")],
    "Go": [(re.compile(r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"), "function"), (re.compile(r"^type\s+([A-Za-z_]\w*)"), "type")],
}
_SYMBOL["JavaScript"] = _SYMBOL["TypeScript"]


def top_symbols(text: str, language: str | None) -> tuple[str, list[tuple[str, str, int, int]]]:
    """('parsed' | 'unsupported' | 'failed', [(name, kind, first line, last line)]): the top-level symbols of a source.

    A conservative reading by lines: a symbol begins at column 0 and lasts until the next line at column 0 that
    is no closing bracket. A text whose brackets do not balance over all lines has failed.
    """
    rules = _SYMBOL.get(language or "")
    if rules is None:
        return "unsupported", []
    rows = text.replace("\r\n", "\n").split("\n")
    bare = re.sub(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|//[^\n]*|#[^\n]*|/\*.*?\*/", "", text, flags=re.S)
    if any(bare.count(a) != bare.count(b) for a, b in ("()", "[]", "{}")):
        return "failed", []
    out = []
    i = 0
    while i < len(rows):
        hit = next(((m.group(1), kind) for p, kind in rules if (m := p.match(rows[i]))), None)
        if hit is None:
            i += 1
            continue
        j = i + 1
        while j < len(rows) and (not rows[j].strip() or rows[j][0] in " \t)]}"):
            j += 1
            if rows[j - 1][:1] in (")", "]", "}") and language != "Python":
                break
        last = j
        while last > i + 1 and not rows[last - 1].strip():
            last -= 1
        out.append((*hit, i + 1, last))
        i = j
    return "parsed", out


_MODIFIERS = r"(?:(?:public|private|protected|static|async|readonly|abstract|override|declare|get|set)\s+)*"
#: Members within the body of a symbol, by language: (pattern of a line without its indentation, kind).
_MEMBER = {
    "TypeScript": [(re.compile(_MODIFIERS + r"\*?\s*(#?[A-Za-z_$][\w$]*)\s*(?:<[^>()]*>)?\([^;]*\)\s*(?::[^{;=]+)?\{"), "method"), (re.compile(_MODIFIERS + r"(#?[A-Za-z_$][\w$]*)\s*[?!]?\s*(?::[^=;]+)?(?:=[^>].*|;)\s*;?$"), "property")],
    "Python": [(re.compile(r"(?:async\s+)?def\s+([A-Za-z_]\w*)"), "method"), (re.compile(r"([A-Za-z_]\w*)\s*(?::[^=]+)?=[^=]"), "property")],
}
_MEMBER["JavaScript"] = _MEMBER["TypeScript"]
_WORDS_NOT_MEMBERS = frozenset("if for while switch catch return function constructor_call do else".split())
SIGNATURE = 500


def symbols_of(text: str, language: str | None) -> tuple[str, list[tuple]]:
    """(state, [(name, kind, parent, first line, last line, signature)]): top-level symbols and the members of classes and interfaces.

    A member begins at the least indentation within the body and lasts until the next line that is indented no more
    and closes nothing. Go methods belong to the type of their receiver. A signature is what stands before the body,
    500 characters at most.
    """
    state, top = top_symbols(text, language)
    rows = text.replace("\r\n", "\n").split("\n")
    out = []

    def signature(line: str) -> str:
        cut = line.split("{", 1)[0] if language != "Python" else re.sub(r":\s*(?:#.*)?$", "", line)
        return cut.strip()[:SIGNATURE]

    for name, kind, a, b in top:
        parent = None
        if language == "Go" and (m := re.match(r"func\s+\(\s*\w*\s*\*?\s*([A-Za-z_]\w*)[^)]*\)", rows[a - 1])):
            parent, kind = m.group(1), "method"
        out.append((name, kind, parent, a, b, signature(rows[a - 1])))
        if kind not in ("class", "interface") or language not in _MEMBER:
            continue
        body = [(i, len(r) - len(r.lstrip())) for i, r in enumerate(rows[a:b], a + 1) if r.strip() and not r.strip().startswith(("}", ")", "]"))]
        body = [(i, d) for i, d in body if d > 0]
        level = min((d for _, d in body), default=0)
        heads = [i for i, d in body if d == level]
        for k, i in enumerate(heads):
            bare = rows[i - 1].strip()
            hit = next(((m.group(1), what) for p, what in _MEMBER[language] if (m := p.match(bare))), None)
            if hit and hit[0] not in _WORDS_NOT_MEMBERS:
                last = (heads[k + 1] - 1) if k + 1 < len(heads) else b
                while last > i and (not rows[last - 1].strip() or (len(rows[last - 1]) - len(rows[last - 1].lstrip())) < level):
                    last -= 1
                out.append((*hit, name, i, last, signature(bare)))
    return state, out


_SYMBOLS = "document_id string, state string, name string, kind string, parent string, start_line int, end_line int, signature string"


def extract_symbols(documents: DataFrame) -> DataFrame:
    """Symbols of source documents (id, text, language), one row each; a document without any has one row with its state alone."""

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                state, found = symbols_of(r.text, r.language if isinstance(r.language, str) else None)
                rows += [(r.id, state, *x) for x in sorted(found, key=lambda x: (x[3], -x[4], x[0]))] or [(r.id, state, None, None, None, None, None, None)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SYMBOLS.split(", ")]).astype({"start_line": "Int32", "end_line": "Int32"})

    return documents.select("id", "text", "language").filter(F.col("text").isNotNull()).mapInPandas(run, _SYMBOLS)


def structural_chunks(text: str, language: str | None, path: str) -> tuple[str, list[dict]]:
    """(strategy, chunks): a chunk a symbol, the gaps as module chunks; symbols beyond the limits in parts, without overlap.

    Each part but the first of a symbol is led by a line that names it. What does not parse falls back to windows.
    """
    state, symbols = top_symbols(text, language)
    if state != "parsed" or not symbols:
        return "line_windows", [{"content": c, "start_line": a, "end_line": b, "symbol_name": None, "symbol_kind": None, "symbol_part": None, "symbol_part_count": None} for c, a, b in code_windows(text)]
    rows = text.replace("\r\n", "\n").split("\n")
    units, at = [], 1
    for name, kind, a, b in [*symbols, (None, None, len(rows) + 1, len(rows) + 1)]:
        if a > at:
            units.append((None, "module", at, a - 1))
        if name is not None:
            units.append((name, kind, a, b))
        at = max(at, b + 1)
    out = []
    for name, kind, a, b in units:
        while a < b and not rows[a - 1].strip():
            a += 1
        while b > a and not rows[b - 1].strip():
            b -= 1
        if not any(r.strip() for r in rows[a - 1 : b]):
            continue
        label = f"// {path}: {name or 'module'}"[: LABEL + 480]
        parts = code_windows("\n".join(rows[a - 1 : b]), CODE - LABEL - _units(label), LINES - 1, 0)
        for k, (content, x, y) in enumerate(parts, 1):
            lead = f"{label} ({k}/{len(parts)})\n" if len(parts) > 1 and k > 1 else ""
            out.append({"content": lead + content, "start_line": a + x - 1, "end_line": a + y - 1, "symbol_name": name, "symbol_kind": kind, "symbol_part": k, "symbol_part_count": len(parts)})
    return "structural", out


_CHUNKS = "document_id string, chunk_index int, strategy string, content string, start_line int, end_line int, symbol_name string, symbol_kind string, symbol_part int, symbol_part_count int"


def chunk_documents(documents: DataFrame) -> DataFrame:
    """Chunks of documents (id, source_type, text, path, language): one row a chunk, chunk_index from 0.

    Source code by its structure, everything else as prose. Null and blank texts give no chunks.
    """

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                if not isinstance(r.text, str) or not r.text.strip():
                    continue
                if r.source_type == "source_code":
                    strategy, parts = structural_chunks(r.text, r.language if isinstance(r.language, str) else None, r.path if isinstance(r.path, str) else "")
                else:
                    strategy, parts = "natural_language", [{"content": c} for c in prose_chunks(r.text)]
                for k, p in enumerate(parts):
                    rows.append((r.id, k, strategy, p["content"], p.get("start_line"), p.get("end_line"), p.get("symbol_name"), p.get("symbol_kind"), p.get("symbol_part"), p.get("symbol_part_count")))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in _CHUNKS.split(", ")])
            yield out.astype({c: "Int32" for c in ("chunk_index", "start_line", "end_line", "symbol_part", "symbol_part_count")})

    return documents.select("id", "source_type", "text", "path", "language").mapInPandas(run, _CHUNKS)


def with_identity(chunks: DataFrame) -> DataFrame:
    """Chunks with the SHA-256 of their content and an id made of document, index and that."""
    c = chunks.withColumn("content_hash", F.sha2("content", 256))
    return c.withColumn("chunk_id", tx.identity(F.lit("chunk_v1"), F.col("document_id"), F.col("chunk_index").cast("string"), F.col("content_hash")))


# ---- fields of records
def commit_message(subject: Column, body: Column) -> Column:
    """Subject, and the body after a blank line where there is one."""
    return F.concat_ws("\n\n", subject, F.nullif(tx.trim(body), F.lit("")))


def pull_request_state(state: Column, merged_at: Column) -> Column:
    """merged where merged_at is set, else the raw state; others than open and closed are an error."""
    s = F.when(merged_at.isNotNull(), F.lit("merged")).otherwise(F.lower(state))
    return F.when(s.isin("open", "closed", "merged"), s).otherwise(F.raise_error(F.concat(F.lit("unknown state: "), F.coalesce(state, F.lit("null")))).cast("string"))


def file_status(status: Column) -> Column:
    s = F.when(status == "removed", F.lit("deleted")).otherwise(status)
    return F.when(s.isin("added", "modified", "deleted", "renamed", "copied", "changed", "unchanged"), s).otherwise(F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce(status, F.lit("null")))).cast("string"))


def issue_number(url: Column) -> Column:
    """The number at the end of an issue's address; null where there is none."""
    return F.nullif(F.regexp_extract(url, r"/(\d+)/?$", 1), F.lit("")).cast("int")


_IMPORT = re.compile(
    r"""^\s*import\s+(?P<type>type\s+)?(?:(?P<default>[A-Za-z_$][\w$]*)\s*(?:,\s*)?)?(?:\*\s+as\s+(?P<ns>[A-Za-z_$][\w$]*)|\{(?P<names>[^}]*)\})?\s*from\s*["'](?P<from>[^"']+)["']
    |^\s*import\s+["'](?P<side>[^"']+)["']
    |^\s*export\s+(?P<etype>type\s+)?(?:\*(?:\s+as\s+(?P<ens>[A-Za-z_$][\w$]*))?|\{(?P<enames>[^}]*)\})\s*from\s*["'](?P<efrom>[^"']+)["']""",
    re.X | re.M,
)


def imports_of(text: str) -> list[tuple]:
    """(kind, binding, imported, local, type only, specifier, line) of each static import and re-export of a module."""
    out = []
    for m in _IMPORT.finditer(text):
        line = text.count("\n", 0, m.start() + (len(m.group()) - len(m.group().lstrip()))) + 1
        if m.group("side"):
            out.append(("imports", "side_effect", None, None, False, m.group("side"), line))
            continue
        export = m.group("efrom") is not None
        kind, spec = ("reexports", m.group("efrom")) if export else ("imports", m.group("from"))
        only = bool(m.group("etype") if export else m.group("type"))
        if m.group("default"):
            out.append((kind, "default", "default", m.group("default"), only, spec, line))
        if m.group("ns") or (export and m.group("enames") is None):
            out.append((kind, "namespace", "*", m.group("ens") if export else m.group("ns"), only, spec, line))
        for n in filter(str.strip, (m.group("enames") if export else m.group("names") or "").split(",") if (m.group("enames") or m.group("names")) else []):
            w = n.split()
            own = only or (w[0] == "type" and len(w) > 1)
            w = w[1:] if w[0] == "type" and len(w) > 1 else w
            out.append((kind, "named", w[0], w[-1], own, spec, line))
    return out


_IMPORTS = "document_id string, kind string, binding string, imported string, local string, type_only boolean, specifier string, line int"


def extract_imports(documents: DataFrame) -> DataFrame:
    """Imports and re-exports of JavaScript and TypeScript documents (id, text, path), one row a binding."""

    def run(frames):
        for pdf in frames:
            rows = [(r.id, *x) for r in pdf.itertuples() if isinstance(r.text, str) for x in imports_of(r.text)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _IMPORTS.split(", ")])

    d = documents.select("id", "text", "path").filter(F.col("path").rlike(r"\.(?:[cm]?[jt]s|[jt]sx)$") & F.col("text").isNotNull())
    return d.mapInPandas(run, _IMPORTS)
