"""The supported languages: a recogniser for each, and a ranking of languages by their tokens."""

from __future__ import annotations

import ast
import json
import re
import sys
import warnings

from . import go, js, sql
from .js import SyntaxFault

# The language of each supported file ending.
LANGUAGE_OF = {"ts": "typescript", "js": "javascript", "py": "python", "go": "go", "sql": "sql", "json": "json"}
LANGUAGES = ("typescript", "javascript", "python", "go", "sql", "json")

#: Nesting that the recognisers follow. Of deeper text only the tokens and brackets are checked, but for JSON, which is read whole.
MAX_DEPTH = 6000

# Tokens that are typical of one language and rare in the others.
_TYPICAL = {
    "typescript": "interface enum readonly implements declare namespace keyof unknown never abstract private public protected ?: as",
    "javascript": "const let var function => === !== ?? async await export require undefined typeof ...",
    "python": "def elif except lambda pass self None True False from import with not in is raise __init__ yield",
    "go": "package func := nil defer range chan struct go fallthrough select <- iota string error",
    "sql": "select from where insert into values create table alter update delete join group order by primary key not null varchar bigint",
    "json": "{ } [ ] : , true false null",
}
_TYPICAL = {k: frozenset(v.split()) for k, v in _TYPICAL.items()}
_TOKENS = re.compile(r"""[A-Za-z_]\w*|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|\d[\w.]*|:=|=>|===|!==|\?\?|\?:|<-|\.\.\.|[^\w\s]""")


def rank(text: str) -> list[str]:
    """The languages by the share of the text's tokens that are typical of them, most first; ties in the order of LANGUAGES.

    Strings and numbers are tokens of JSON only where nothing but its own punctuation stands between them.
    """
    counts: dict[str, int] = {}
    literals = 0
    for m in _TOKENS.finditer(text):
        t = m.group()
        if t[0] in "\"'" or t[0].isdigit():
            literals += 1
        else:
            counts[t] = counts.get(t, 0) + 1
    lower: dict[str, int] = {}
    for t, n in counts.items():
        lower[t.lower()] = lower.get(t.lower(), 0) + n
    score = {k: sum((lower if k == "sql" else counts).get(t, 0) for t in typical) for k, typical in _TYPICAL.items()}
    words = sum(n for t, n in counts.items() if t not in _TYPICAL["json"])
    score["json"] = 0 if words > 0.05 * (score["json"] + literals) else score["json"] + literals
    # TypeScript is JavaScript and more
    score["typescript"] += score["javascript"] if score["typescript"] else 0
    return sorted(LANGUAGES, key=lambda k: (-score[k], LANGUAGES.index(k)))


def _reject(_: str):
    raise ValueError("no JSON constant")


def _python(text: str) -> None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        ast.parse(text)


_JSON_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))')


def _json(text: str) -> None:
    """JSON of any depth: its brackets stand in a list, not on the stack."""
    open_: list[str] = []
    want = "value"  # or "first" (value or ]), "key", "first key" (key or }), "colon", "after"
    pos, end = 0, len(text.rstrip(" \t\n\r"))
    while pos < end:
        m = _JSON_TOKEN.match(text, pos)
        if m is None:
            raise ValueError(f"character at {pos}")
        pos = m.end()
        sign, string, _ = m.groups()
        if want in ("key", "first key") and string:
            want = "colon"
        elif want == "colon" and sign == ":":
            want = "value"
        elif want in ("value", "first") and sign and sign in "[{":
            open_.append(sign)
            want = "first" if sign == "[" else "first key"
        elif want in ("value", "first") and not sign:
            want = "after"
        elif sign and sign in "]}" and open_ and open_[-1] + sign in ("[]", "{}") and want in ("after", "first" if sign == "]" else "first key"):
            open_.pop()
            want = "after"
        elif want == "after" and sign == "," and open_:
            want = "value" if open_[-1] == "[" else "key"
        else:
            raise ValueError(f"{m.group().strip()} at {pos}")
    if open_ or want != "after":
        raise ValueError("unfinished")


_PARSE = {
    "typescript": lambda t: js.recognise(t, True),
    "javascript": lambda t: js.recognise(t, False),
    "python": _python,
    "go": go.recognise,
    "sql": sql.recognise,
    "json": lambda t: json.loads(t, parse_constant=_reject),
}


def parse(text: str, language: str) -> tuple[str | None, bool]:
    """(why the text is not in the language, or None; whether it nests too deep to be read whole).

    Where nesting ends the recognition, tokens and brackets have been found right before it began.
    """
    old = sys.getrecursionlimit()
    sys.setrecursionlimit(max(old, MAX_DEPTH))
    try:
        try:
            _PARSE[language](text)
            return None, False
        except (RecursionError, MemoryError):
            if language == "json":
                _json(text)
                return None, False
            return None, True
    except (SyntaxFault, SyntaxError, ValueError) as e:
        return (str(e) or type(e).__name__)[:200], False
    finally:
        sys.setrecursionlimit(old)


def fault(text: str, language: str) -> str | None:
    """Why the text is not in the language; None if it is."""
    return parse(text, language)[0]
