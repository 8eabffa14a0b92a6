"""Problem 5: generated, minified, vendored and data files among the source files.

Attribute files (`.gitattributes`) are parsed and their globs resolved with the precedence of the format: the
deepest directory, then the last line, wins for each attribute. What they declare teaches which path patterns stand
for such files; so does what files of repositories without them declare of themselves. Patterns that hold across
repositories are applied where nothing is declared, and only then does a file's own content decide.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import Scratch
from .arrow import map_rows
from .texts import load

# Endings of source code; documents, configuration, markup and JSON are no cases.
CODE_ENDINGS = "ts tsx mts cts js jsx mjs cjs py pyi go sql java kt scala c h cc cpp cxx hpp cs rs rb php swift m mm lua pl r jl dart vue svelte css scss less sh".split()
# Names of lock files.
LOCK_FILES = "package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml bun.lockb bun.lock composer.lock gemfile.lock cargo.lock poetry.lock pdm.lock uv.lock pipfile.lock go.sum go.work.sum flake.lock mix.lock pubspec.lock podfile.lock packages.lock.json gradle.lockfile deno.lock".split()
#: A pattern is mined if at least so many files show it, in so many repositories, and such a share of them is no hand-written source.
MIN_FILES, MIN_REPOSITORIES, MIN_SHARE = 8, 3, 0.6
#: Lines longer than this on average, with less white space than the share, are minified.
MINIFIED_LINE, MINIFIED_SPACE = 300, 0.14
#: Literals that make up such a share of a file of at least DATA_CHARS characters make it data saved as code.
DATA_SHARE, DATA_CHARS = 0.8, 400

_COMMENT = r"^\s*(?://|/\*+!?|\*|\#|--|<!--|;|\"{3}|'{3})"
# What tools write at the head of their output.
_GENERATED = re.compile(
    _COMMENT
    + r""".*?(?:
    code\ generated\b.*(?:do\ not\ edit|\.)|\bdo\ not\ (?:edit|modify)\b|@generated\b|<auto-?generated
    |\bauto-?generated\b(?!\ reports?\b)|\bautomatically\ (?:generated|created|produced)\b
    |\b(?:this|the)\ (?:file|code|source)\ (?:is|was|has\ been)\ (?:auto(?:matically)?[ -]?)?(?:generated|created)\b
    |\bgenerated\ (?:by|from|using|with)\b|\boutput\ of\b.*\b(?:compiler|generator)\b|\bsource:\ \S+\ hash\ [0-9a-f]{6,}
    |\bautomatisch\ (?:erzeugt|generiert|erstellt)\b|\bgénéré\ automatiquement\b|\bgenerado\ automáticamente\b
    )""",
    re.X | re.I | re.M,
)
_THIRD_PARTY = re.compile(
    _COMMENT
    + r""".*?(?:
    \(c\)\s*\d{4}.*\b(?:authors|contributors|foundation|inc|ltd|llc|gmbh|corp)\b|\bcopyright\b.*\d{4}.*\b(?:authors|contributors|foundation|inc|ltd|llc|gmbh|corp)\b
    |\bredistribution\ and\ use\ in\ source\b|\bupstream\ (?:release|version|commit)\b|\bvendored\ from\b|\bcopied\ from\ https?://
    |\breleased\ under\ the\ [\w. -]+\ licen[sc]e\b|\bpermission\ is\ hereby\ granted\b|\blicensed\ under\ the\ (?:apache|mit|bsd|mozilla|gnu)\b
    )""",
    re.X | re.I | re.M,
)
#: What a comment after the first line of code has to say: there it may tell of what code does.
_PLAINLY = re.compile(r"\bdo not (?:edit|modify)\b|@generated\b|<auto-?generated|\bcode generated\b|\b(?:this|the) (?:file|source) (?:is|was|has been) (?:auto(?:matically)?[ -]?)?(?:generated|created)\b", re.I)
_OWN = re.compile(r"\b(?:maintainers|authors|contributors|owners) of this (?:repository|project)\b|\bthis repository\b", re.I)
#: A file is written by a template if lines of so many names, alike but for these, make up such a share of its characters, so many at least.
TEMPLATE_NAMES, TEMPLATE_SHARE, TEMPLATE_TIMES = 7, 0.4, 3
_NAMES = re.compile(r"[A-Za-z_$][\w$]*|\d+(?:\.\d+)?|\"[^\"\n]*\"|'[^'\n]*'")
_LITERAL = re.compile(r"0x[0-9a-fA-F]+|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|[\"'][^\"'\n]{24,}[\"']|[\"'][A-Za-z0-9+/=]*[\"']|(?<=[\"'])[A-Za-z0-9+/=]{40,}(?=[\"'])")
_SEPARATORS = re.compile(r"[\s,\[\](){}+;:]+")
_BASE64 = re.compile(r"[\"'`][A-Za-z0-9+/=]{40,}[\"'`]")


# Pairs that open and close a comment of several lines.
_BLOCKS = (("/*", "*/"), ('"""', '"""'), ("'''", "'''"), ("<!--", "-->"))


def head(text: str) -> tuple[str, str]:
    """The comment lines with which a file begins, whole, and those that follow its first line of code."""
    parts: tuple[list[str], list[str]] = ([], [])
    close, code, at = "", False, 0
    while at <= len(text):
        end = text.find("\n", at)
        line = text[at : end if end >= 0 else len(text)]
        at = end + 1 if end >= 0 else len(text) + 1
        bare = line.strip()
        if close:
            if close == "*/" and not re.match(_COMMENT, line):
                line = "* " + line  # a line within a comment is one without its own mark too
            if close in line:
                close = ""
        elif bare and not re.match(_COMMENT, line) and not line.startswith("#!"):
            if code:
                break
            code = True
            continue  # one line of code, such as 'use strict' or a package clause
        else:
            for a, b in _BLOCKS:
                if bare.startswith(a) and b not in bare[len(a) :]:
                    close = b
        parts[code].append(line)
    return "\n".join(parts[0]), "\n".join(parts[1])


def templated(text: str) -> float:
    """The share of a text's characters in lines that are alike but for names, numbers and literals."""
    shapes: dict[str, list[int]] = {}
    total = 0
    for line in text.split("\n"):
        bare = line.strip()
        total += len(bare)
        shape, names = _NAMES.subn("a", bare)
        if names >= TEMPLATE_NAMES:
            seen = shapes.setdefault(shape, [0, 0])
            seen[0] += 1
            seen[1] += len(bare)
    most = max((size for times, size in shapes.values() if times >= TEMPLATE_TIMES), default=0)
    return most / total if total else 0.0


def evidence(path: str | None, text: str | None) -> str | None:
    """What a file shows itself to be: lock, generated, vendored, minified or data; None if hand-written or not code."""
    if not path:
        return None
    base = path.rsplit("/", 1)[-1].lower()
    if base in LOCK_FILES or base.endswith(".lock"):
        return "lock"
    ending = base.rsplit(".", 1)[-1] if "." in base else ""
    if ending not in CODE_ENDINGS or not text:
        return None
    for late, h in enumerate(head(text)):
        # a mention of generated things elsewhere in a sentence is no declaration: the line must say it of this file
        for m in _GENERATED.finditer(h):
            line = h[h.rfind("\n", 0, m.start()) + 1 : (h.find("\n", m.end()) + 1 or len(h) + 1) - 1]
            if late and not _PLAINLY.search(line):
                continue
            if not re.search(r"(?i)\bsee \S+;|\bgenerated (?:reports?|files?|output|code|artifacts?) (?:go|goes|live|lives|are|is) ", line):
                return "generated"
        for m in _THIRD_PARTY.finditer(h):
            line = h[h.rfind("\n", 0, m.start()) + 1 : (h.find("\n", m.end()) + 1 or len(h) + 1) - 1]
            if not _OWN.search(line):
                return "vendored"
    lines = text.count("\n") + 1
    if templated(text) >= TEMPLATE_SHARE:
        return "generated"
    n = len(text)
    if n >= DATA_CHARS:
        blob = sum(len(m.group()) for m in _BASE64.finditer(text))
        if blob >= DATA_SHARE * n:
            return "data"
        rest = len(_SEPARATORS.sub("", _LITERAL.sub("", text)))
        if rest <= (1 - DATA_SHARE) * n * 0.5 and len(_LITERAL.findall(text)) >= 64:
            return "data"
        long = n / lines > MINIFIED_LINE
        if long and sum(map(text.count, " \t\n\r")) < MINIFIED_SPACE * n:
            return "minified"
        if long:
            widest = max(map(len, text.split("\n")))
            if widest > 2000 and widest > 0.8 * n and ending in ("js", "mjs", "cjs", "ts", "css", "jsx"):
                return "minified"
    return None


# ---- attribute files
# The attributes that mark files, and what they mark them as.
ATTRIBUTES = {"linguist-generated": "generated", "linguist-vendored": "vendored", "gitlab-generated": "generated"}
# Fixed value: the attribute that is unset for files that are not to be compared, which tools write.
NOT_COMPARED = "diff"


def macros_of(text: str | None) -> dict[str, list[str]]:
    """The macros that a repository's topmost attribute file defines, and the one that Git has built in."""
    out = {"binary": ["-diff", "-merge", "-text"]}
    for line in (text or "").split("\n"):
        m = re.match(r"\s*\[attr\](\S+)\s+(.*)", line)
        if m:
            out[m.group(1)] = m.group(2).split()
    return out


def parse_attributes(text: str, macros: dict[str, list[str]] | None = None) -> list[tuple[int, str, str, bool]]:
    """Rows (line, glob, class, set) of an attribute file; unset marks (-attr, !attr, attr=false) take a class back."""
    macros = macros_of(text) if macros is None else macros
    out = []
    for i, line in enumerate((text or "").split("\n")):
        line = line.strip()
        if not line or line.startswith(("#", "[attr]")):
            continue
        m = re.match(r'"((?:[^"\\]|\\.)*)"|(\S+)', line)
        glob = m.group(1) if m.group(1) is not None else m.group(2)
        todo, seen = line[m.end() :].split(), set()
        while todo:
            a = todo.pop(0)
            name, _, value = a.partition("=")
            off = name.startswith(("-", "!"))
            bare = name.lstrip("-!")
            if bare in macros and bare not in seen:
                # a macro sets what it stands for; taking it back takes back its own name only
                seen.add(bare)
                todo += [] if off else macros[bare]
            elif bare in ATTRIBUTES:
                out.append((i, glob, ATTRIBUTES[bare], not off and value.lower() not in ("false", "0", "no")))
            elif bare == NOT_COMPARED and name.startswith("-"):
                out.append((i, glob, "generated", True))
    return out


@lru_cache(maxsize=4096)
def glob_regex(glob: str) -> re.Pattern:
    """The pattern of an attribute file's glob, for a path relative to the file's directory."""
    anchored = "/" in glob.rstrip("/")
    g = glob.lstrip("/")
    out, i = [], 0
    while i < len(g):
        c = g[i]
        if g[i : i + 3] == "**/":
            out.append("(?:.*/)?")
            i += 3
            continue
        if g[i : i + 2] == "**":
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in g[i + 1 :]:
            j = g.index("]", i + 1)
            out.append("[" + g[i + 1 : j].replace("!", "^", 1).replace("\\", "") + "]")
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return re.compile(("" if anchored else "(?:.*/)?") + "".join(out) + r"\Z")


@lru_cache(maxsize=256)
def parsed(text: str, top: str | None) -> tuple:
    return tuple(parse_attributes(text, macros_of(top)))


def declared(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (id, declared): what attribute files say of each file; 'none' where a mark is taken back.

    `files` has id, repository_id and path, `rules` repository_id, path and text of the attribute files. A file
    is joined with the attribute files of its own ancestor directories only.
    """
    rules = rules.filter((F.col("path") == ".gitattributes") | F.col("path").endswith("/.gitattributes")).filter(F.col("text").isNotNull())
    root = rules.filter(F.col("path") == ".gitattributes").groupBy("repository_id").agg(F.max("text").alias("root"))
    rules = rules.join(root, "repository_id", "left").select("repository_id", F.regexp_replace("path", r"\.gitattributes$", "").alias("dir"), F.col("text").alias("rules"), "root")
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))))
    files = files.filter(F.col("path").isNotNull()).select("id", "repository_id", "path", F.explode(dirs).alias("dir"))

    def one(file_id, path, directory, text, top):
        rel = path[len(directory) :]
        last = {}
        for line, glob, cls, on in parsed(text, top):
            if glob_regex(glob).match(rel):
                last[cls] = (line, on)
        for cls, (line, on) in last.items():
            yield file_id, cls, len(directory), line, on

    hit = map_rows(files.join(rules, ["repository_id", "dir"]).select("id", "path", "dir", "rules", "root"), "id string, cls string, depth int, line int, marked boolean", one)
    w = Window.partitionBy("id", "cls").orderBy(F.col("depth").desc(), F.col("line").desc(), F.col("marked").desc())
    best = hit.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1")
    return best.groupBy("id").agg(F.coalesce(F.max(F.when(F.col("marked"), F.col("cls"))), F.lit("none")).alias("declared"))


def patterns(files: DataFrame) -> DataFrame:
    """Rows (pattern, the files' columns): the globs that a path fits: one of each of its directories' names, and those of its compound ending."""
    parts = F.split(F.lower("path"), "/")
    dirs = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.concat(F.lit("**/"), p, F.lit("/**")))
    base = F.element_at(parts, -1)
    mark = F.regexp_extract(base, r"((?:\.[a-z_]+|_pb2?))\.[a-z0-9]+$", 1)
    ends = F.when(mark != "", F.array(F.concat(F.lit("*"), mark, F.lit(".*")))).otherwise(F.array().cast("array<string>"))
    return files.withColumn("pattern", F.explode(F.array_distinct(F.concat(dirs, ends))))


def mined(files: DataFrame) -> DataFrame:
    """Rows (pattern, cls): the globs that stand for files not written by hand, as files (repository_id, path, known) teach.

    Counts are pre-aggregated by pattern, repository and class, so a pattern of a third of all files is no hot key.
    """
    c = patterns(files.filter("path is not null")).groupBy("pattern", "repository_id", "known").agg(F.count("*").alias("n"))
    by = c.groupBy("pattern", "known").agg(F.sum("n").alias("n"), F.collect_set(F.pmod(F.xxhash64("repository_id"), F.lit(1024))).alias("r"))
    p = by.groupBy("pattern").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("known").isNotNull(), F.col("n"))), F.lit(0)).alias("hit"), F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("known").isNotNull(), F.col("r")))))).alias("repositories"), F.max_by("known", F.when(F.col("known").isNotNull(), F.col("n"))).alias("cls"))
    return p.filter((F.col("n") >= MIN_FILES) & (F.col("repositories") >= MIN_REPOSITORIES) & (F.col("hit") >= MIN_SHARE * F.col("n"))).select("pattern", "cls", (F.col("hit") / F.col("n")).alias("share"))


def classify(texts: DataFrame, rules: DataFrame | None = None, by_rules: bool = True, by_patterns: bool = True) -> DataFrame:
    """Rows (file_id, repository_id, path, cls, reason), one a file: cls null for hand-written source and non-code.

    `texts` has id, repository_id, path and text (null where there is none); `rules` the attribute files alone, if
    they can be read more cheaply than from `texts`. Attribute files decide first, then the mined patterns, then
    the file's content. Null paths have no class; an empty file is hand-written. Texts are read once: what they
    show is kept as a slim table. by_rules and by_patterns switch a step off, to see what it decides.
    """

    def one(file_id, repository_id, path, text):
        base = (path or "").rsplit("/", 1)[-1].lower()
        ending = base.rsplit(".", 1)[-1] if "." in base else ""
        yield file_id, repository_id, path, ending in CODE_ENDINGS, evidence(path, text)

    scratch = Scratch(texts.sparkSession, "files")
    shown = scratch.keep(map_rows(texts.select("id", "repository_id", "path", "text"), "id string, repository_id string, path string, is_code boolean, shown string", one))
    told = declared(shown.select("id", "repository_id", "path"), (texts if rules is None else rules).filter(F.lit(by_rules)))
    f = scratch.keep(shown.join(told, "id", "left"))
    known = F.when(F.col("declared").isNotNull(), F.nullif("declared", F.lit("none"))).otherwise(F.col("shown"))
    globs = mined(f.filter("is_code").select("repository_id", "path", known.alias("known"))).filter(F.lit(by_patterns))
    left = patterns(f.filter("is_code and declared is null and path is not null").select("id", "path"))
    by_path = left.join(globs, "pattern").groupBy("id").agg(F.max(F.struct("share", "pattern", "cls")).alias("best"))
    out = f.join(by_path, "id", "left")
    reason = F.when(F.col("declared").isNotNull(), F.lit("declared")).when(F.col("best").isNotNull(), F.col("best.pattern")).when(F.col("shown").isNotNull(), F.lit("content"))
    cls = F.when(F.col("declared").isNotNull(), F.nullif("declared", F.lit("none"))).otherwise(F.coalesce("best.cls", "shown"))
    return out.select(F.col("id").alias("file_id"), "repository_id", "path", cls.alias("cls"), reason.alias("reason"))


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    return classify(load(spark, d, "left"), load(spark, d, name=".gitattributes"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_files(spark, d).filter("cls is not null").select("file_id")
