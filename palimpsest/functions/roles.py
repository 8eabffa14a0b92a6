"""The role of a source by its path: ordered rules, first match wins; and how well roles suit intents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalise_path

# The roles.
ROLES = """production_implementation unit_test integration_test e2e_test configuration documentation generated_reference_documentation
database_schema migration api_definition script type_definition fixture generated development_history unknown""".split()
TEST_ROLES = ["unit_test", "integration_test", "e2e_test"]
# Endings and names.
PRODUCTION = "c cc cpp cs css cxx dart ex exs fs fsx go h hpp html java js jsx kt kts lua m php pl py rb rs scala swift svelte ts tsx vue zig".split()
DOCUMENTATION = "adoc md mdx rst txt".split()
CONFIGURATION_NAMES = """.babelrc .editorconfig .env .env.example .eslintrc .gitattributes .gitignore .npmrc .prettierignore .prettierrc
cargo.toml compose.yaml compose.yml deno.json docker-compose.yaml docker-compose.yml dockerfile gemfile go.mod package.json
pnpm-workspace.yaml pyproject.toml turbo.json""".split()


def _segment(words: str) -> str:
    """A pattern: one of the path's segments, the file name among them, is one of the words."""
    return rf"(^|/)({words})(/|$)"


def _named(word: str) -> str:
    """A pattern: the file name holds the word between dots, dashes or underscores."""
    return rf"(^|/)([^/]*[._-])?{word}([._-][^/]*)?$"


def _ending(words: list[str]) -> str:
    return rf"[^/]\.({'|'.join(words)})$"


_S, _N, _E = _segment, _named, _ending

# Fixed values, in the order in which they are tried: (role, confidence, patterns of which one must match the lower-case
# path, or lists of which all must).
RULES: list[tuple[str, float, list]] = [
    ("fixture", 0.95, [_S("__fixtures__|fixture|fixtures|testdata"), _N("fixture")]),
    ("e2e_test", 1.0, [_S("e2e|end-to-end|playwright|cypress"), _N("e2e")]),
    ("integration_test", 1.0, [_S("integration|integration-tests?"), _N("integration")]),
    ("unit_test", 1.0, [_S("__tests__|test|tests|unit|unit-tests?"), r"\.(spec|test)\.[^./]+$", r"(^|/)(test|spec)_[^./]+[^/]*$", r"_test\.[^./]+$"]),
    ("migration", 1.0, [_S("migration|migrations"), _N("migration"), [_E(["sql"]), _S("migrate|migrations?")]]),
    ("database_schema", 1.0, [r"(^|/)schema\.prisma$", _E(["prisma"]), [_S("database|db|drizzle|models?|prisma"), r"(^|/)([^/]*[._-])?(schema|model)([._-][^/]*)?$"]]),
    ("api_definition", 0.95, [r"(^|/)(openapi|swagger)(\.[^./]+)?\.(json|ya?ml)$", _S("openapi|swagger"), [_E(["json", "yaml", "yml"]), _S("api-reference|api_reference")]]),
    ("generated_reference_documentation", 0.9, [[_E(DOCUMENTATION), _S("api-reference|api_reference|generated-reference|generated_reference")]]),
    ("generated", 0.9, [_S("generated|gen"), _N("generated")]),
    ("documentation", 1.0, [_E(DOCUMENTATION), r"(^|/)readme(\.[^/]*)?$", _S("doc|docs|documentation")]),
    ("configuration", 0.95, [rf"(^|/)({'|'.join(n.replace('.', chr(92) + '.') for n in CONFIGURATION_NAMES)})$", r"(^|/)([^/]*[._-])?config(uration)?([._-][^/]*)?$", r"(^|/)tsconfig(\.[^./]+)?\.json$", r"(^|/)env\.([cm]?[jt]s|py|rb)$", r"^\.github/workflows/", [_S("deploy|deployment|k8s|kubernetes"), _E(["json", "toml", "yaml", "yml"])], _E(["tf"])]),
    ("script", 0.9, [_S("bin|script|scripts"), _E("bash bat cmd ps1 sh zsh".split())]),
]


def _match(p: Column, patterns: list) -> Column:
    out = F.lit(False)
    for x in patterns:
        if isinstance(x, list):
            both = F.lit(True)
            for y in x:
                both = both & p.rlike(y)
            out = out | both
        else:
            out = out | p.rlike(x)
    return out


def classify(source_type: Column, path: Column, symbol_kind: Column) -> Column:
    """struct(role, confidence) of a source; anything but source code is development history, a source without path unknown."""
    p = F.lower(normalise_path(path))

    def as_(role: str, confidence: float) -> Column:
        return F.struct(F.lit(role).alias("role"), F.lit(confidence).alias("confidence"))

    c = F.when(~source_type.eqNullSafe("source_code"), as_("development_history", 1.0)).when(path.isNull() | (path == ""), as_("unknown", 1.0))
    for role, confidence, patterns in RULES:
        c = c.when(_match(p, patterns), as_(role, confidence))
    c = c.when(p.endswith(".d.ts") | symbol_kind.isin("interface", "type", "enum"), as_("type_definition", 0.9))
    c = c.when(p.rlike(_ending(PRODUCTION)) | symbol_kind.isNotNull(), as_("production_implementation", 0.8))
    return c.otherwise(as_("unknown", 1.0))


# How well a role suits an intent, from 0 to 1.
COMPATIBILITY: dict[str, dict[str, float]] = {
    "implementation": {"production_implementation": 1, "type_definition": 0.45, "api_definition": 0.5, "database_schema": 0.45, "configuration": 0.4, "script": 0.35, "migration": 0.2, "unit_test": 0.12, "integration_test": 0.12, "e2e_test": 0.12, "fixture": 0.05, "documentation": 0.15},
    "tests": {"unit_test": 1, "integration_test": 1, "e2e_test": 1, "fixture": 0.6, "production_implementation": 0.25, "configuration": 0.2},
    "configuration": {"configuration": 1, "production_implementation": 0.35, "documentation": 0.35, "script": 0.3},
    "documentation": {"documentation": 1, "generated_reference_documentation": 0.8, "api_definition": 0.45, "development_history": 0.3},
    "database_schema": {"database_schema": 1, "migration": 0.6, "type_definition": 0.45, "production_implementation": 0.35},
    "migration": {"migration": 1, "database_schema": 0.55, "development_history": 0.3},
    "api_endpoint": {"api_definition": 0.8, "production_implementation": 1, "type_definition": 0.3, "documentation": 0.25, "unit_test": 0.15, "integration_test": 0.15, "e2e_test": 0.15},
    "error_handling": {"production_implementation": 0.8, "unit_test": 0.45, "integration_test": 0.45, "e2e_test": 0.45, "documentation": 0.15},
    "authentication": {"production_implementation": 0.55, "configuration": 0.35, "database_schema": 0.25, "unit_test": 0.2, "integration_test": 0.2, "e2e_test": 0.2},
    "authorization": {"production_implementation": 0.55, "configuration": 0.35, "database_schema": 0.25, "unit_test": 0.2, "integration_test": 0.2, "e2e_test": 0.2},
    "history_rationale": {"development_history": 1, "migration": 0.4, "documentation": 0.3},
}


def compatibility(signals: Column, role: Column, exact: Column, symbol_name: Column) -> Column:
    """The best product of a signal's confidence and the suitability of the role; for exact_symbol 1 for an exact match, 0.55 for any symbol."""
    cells = [F.lit(x) for i, row in COMPATIBILITY.items() for r, w in row.items() for x in (f"{i}/{r}", float(w))]
    table = F.create_map(*cells)

    def score(s: Column) -> Column:
        own = F.when(F.coalesce(exact, F.lit(False)), F.lit(1.0)).when(symbol_name.isNotNull(), F.lit(0.55)).otherwise(F.lit(0.0))
        weight = F.when(s["intent"] == "exact_symbol", own).otherwise(F.coalesce(F.try_element_at(table, F.concat(s["intent"], F.lit("/"), role)), F.lit(0.0)))
        return weight * s["confidence"]

    return F.coalesce(F.array_max(F.transform(signals, score)), F.lit(0.0))


def implementation_weight(symbol_kind: Column) -> Column:
    return F.when(symbol_kind.isin("function", "method", "class"), 2).when(symbol_kind.isin("variable", "property"), 1).otherwise(0)
