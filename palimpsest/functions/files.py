"""Files by name: their language, and whether a memory admits them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import basename, extension, normalise_path

# Languages by file name, then by ending.
LANGUAGE_BY_NAME = {"dockerfile": "Dockerfile", "gemfile": "Ruby", "makefile": "Makefile", "rakefile": "Ruby"}
LANGUAGE_BY_ENDING = {
    "c": "C", "cc": "C++", "cpp": "C++", "cs": "C#", "css": "CSS", "cxx": "C++", "dart": "Dart", "ex": "Elixir", "exs": "Elixir", "fs": "F#", "fsx": "F#",
    "go": "Go", "h": "C", "hpp": "C++", "html": "HTML", "java": "Java", "js": "JavaScript", "jsx": "JavaScript", "kt": "Kotlin", "kts": "Kotlin", "lua": "Lua",
    "m": "Objective-C", "md": "Markdown", "php": "PHP", "pl": "Perl", "prisma": "Prisma", "py": "Python", "rb": "Ruby", "rs": "Rust", "scala": "Scala",
    "sh": "Shell", "sql": "SQL", "svelte": "Svelte", "swift": "Swift", "ts": "TypeScript", "tsx": "TypeScript", "vue": "Vue", "xml": "XML", "yaml": "YAML",
    "yml": "YAML", "zig": "Zig",
}
# Names and directories that keep a file out.
LOCK_NAMES = "bun.lock bun.lockb cargo.lock chart.lock composer.lock gemfile.lock npm-shrinkwrap.json package-lock.json pipfile.lock pnpm-lock.yaml poetry.lock uv.lock yarn.lock".split()
VENDORED = "node_modules third-party third_party vendor vendors".split()
OUTPUT = ".cache .next .nuxt .parcel-cache .svelte-kit .turbo build coverage dist generated out target".split()
CATALOG_ENDINGS = ".json .yaml .yml .po .pot .properties".split()
LOCALE = r"(?i)^[a-z]{2,3}([-_][a-z]{4})?[-_]([a-z]{2}|[0-9]{3})$"
CANONICAL_LOCALE = "en-us"
GENERATED_HEADER = (
    r"(?i)(^|\n)\s*(//|#|/\*+|\*|<!--)[^\n]{0,160}(@generated|<auto-generated>|generated (file|code|by)|code generated"
    r"|(this )?(file|code) (is |was )?auto(matically)?[- ]?generated|auto(matically)?[- ]?generated (file|code))"
)
DO_NOT_EDIT = r"(?i)(^|\n)\s*(//|#|/\*+|\*|<!--)[^\n]{0,160}(please\s+)?do not (edit|modify)( this file| manually)?([.!—-]|$)"


def language(path: Column) -> Column:
    """The language by file name, else by ending; null if neither is known."""
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_BY_NAME.items() for x in kv])
    endings = F.create_map(*[F.lit(x) for kv in LANGUAGE_BY_ENDING.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(basename(path))), F.try_element_at(endings, F.substring(extension(path), 2, 99)))


def _in_directory(p: Column, names: list[str]) -> Column:
    return p.rlike(r"(^|/)(" + "|".join(n.replace(".", r"\.") for n in names) + r")(/|$)")


def exclusion_by_path(files: DataFrame) -> DataFrame:
    """`files` (repository_id, path, ...) with `excluded`: why a file stays out, null if it is admitted.

    In order: lock and cache files, vendored directories, build output, snapshots, minified scripts, SVG,
    bundled API descriptions whose sources are there, and translations of a catalogue whose canonical locale
    is there. The last two look at the other files of the repository, by window counts and a semi-join.
    """
    p = normalise_path(F.col("path"))
    low, base = F.lower(p), F.lower(basename(p))
    f = files.withColumns({"__p": p, "__low": low, "__base": base, "__ext": extension(p)})
    f = f.withColumn("__dir", F.regexp_replace("__p", r"[^/]*$", ""))
    # sources of a bundled description, by the directory that would hold the bundle
    inside = f.select("repository_id", F.regexp_extract("__p", r"(?i)^(.*?)src/(?:(openapi|swagger)\.(?:json|ya?ml)$|paths/|components/)", 1).alias("d"), F.col("__p").rlike(r"(?i)(^|/)src/(openapi|swagger)\.(json|ya?ml)$").alias("entry"), F.col("__p").rlike(r"(^|/)src/(paths|components)/").alias("part"))
    sources = inside.filter("entry or part").groupBy("repository_id", "d").agg(F.max("entry").alias("entry"), F.max("part").alias("part")).filter("entry and part").select(F.col("repository_id").alias("__r"), F.col("d").alias("__d"), F.lit(True).alias("__sources"))
    f = f.join(sources, F.col("repository_id").eqNullSafe(F.col("__r")) & (F.col("__dir") == F.col("__d")), "left").drop("__r", "__d")
    # catalogues: root/<locale>.ext or root/<locale>/tail.ext
    root = r"(?i)^((?:[^/]+/)*?(?:locale|locales|translations))/"
    first = F.regexp_extract("__p", root + r"([^/]+)", 2)
    tail = F.regexp_extract("__p", root + r"[^/]+/(.+)$", 2)
    flat = tail == ""
    locale = F.when(flat, F.regexp_replace(first, r"\.[^.]*$", "")).otherwise(first)
    catalogue = (first != "") & F.col("__ext").isin(CATALOG_ENDINGS) & locale.rlike(LOCALE)
    group = F.concat(F.regexp_extract("__p", root, 1), F.lit("/<locale>"), F.when(flat, F.col("__ext")).otherwise(F.concat(F.lit("/"), tail)))
    f = f.withColumn("__group", F.when(catalogue, group)).withColumn("__canon", catalogue & (F.lower(F.replace(locale, F.lit("_"), F.lit("-"))) == CANONICAL_LOCALE))
    g = f.filter("__group is not null").groupBy(F.col("repository_id").alias("__r"), F.col("__group").alias("__g")).agg(F.count("*").alias("__n"), F.sum(F.col("__canon").cast("int")).alias("__c"))
    f = f.join(g, F.col("repository_id").eqNullSafe(F.col("__r")) & (F.col("__group") == F.col("__g")), "left").drop("__r", "__g")
    why = (
        F.when(F.col("__ext").isin(".lock", ".cache") | F.col("__base").isin([*LOCK_NAMES, ".eslintcache", ".stylelintcache"]), "lock_file")
        .when(_in_directory(F.col("__low"), VENDORED), "vendored_dependency")
        .when(_in_directory(F.col("__low"), OUTPUT), "generated_output")
        .when(_in_directory(F.col("__low"), ["__snapshots__"]) | F.col("__base").endswith(".snap") | F.col("__base").rlike(r"\.snapshot\.[^.]+$"), "snapshot")
        .when(F.col("__base").rlike(r"\.min\.(c?js|mjs|css)$"), "minified")
        .when(F.col("__ext") == ".svg", "static_asset")
        .when(F.col("__base").rlike(r"^(openapi|swagger)\.(json|ya?ml)$") & F.col("__sources"), "generated_bundle")
        .when((F.col("__n") >= 2) & (F.col("__c") == 1) & ~F.col("__canon"), "translated_locale")
    )
    return f.withColumn("excluded", why).drop("__p", "__low", "__base", "__ext", "__dir", "__sources", "__group", "__canon", "__n", "__c")


def has_generated_header(content: Column) -> Column:
    """Whether a comment among the first 20 lines and 2,048 characters says that a tool wrote the file."""
    head = F.array_join(F.slice(F.split(F.left(content, F.lit(2048)), "\n"), 1, 20), "\n")
    return F.coalesce(head.rlike(GENERATED_HEADER) | head.rlike(DO_NOT_EDIT), F.lit(False))


def is_binary(content: Column) -> Column:
    """Whether bytes hold control characters that no text has."""
    return F.decode(content, "ISO-8859-1").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1A\x1C-\x1F]")


def admission(files: DataFrame, maximum: int = 512 * 1024) -> DataFrame:
    """Files with bytes in `content`: path rules first, then empty, oversized, binary, non-UTF-8 and generated."""
    f = exclusion_by_path(files)
    c = F.col("content")
    text = F.decode(c, "UTF-8")
    why = (
        F.when(F.col("excluded").isNotNull(), F.col("excluded"))
        .when(F.length(c) == 0, "empty")
        .when(F.length(c) > maximum, "oversized")
        .when(is_binary(c), "binary")
        .when(~F.is_valid_utf8(c.cast("string")), "non_utf8")
        .when(has_generated_header(text), "generated_file")
    )
    return f.withColumn("excluded", why)


