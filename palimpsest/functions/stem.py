"""English stemming (the Porter 2 rules): a function for the workers, and the same rules as SQL expressions.

Stems go through Python in Arrow batches of whole texts' words, with a memory of words met before. As expressions they
would be put into each other by the optimiser until no plan holds them; for other engines they are given step by step.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# English words that full-text search leaves out.
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
do does did doing a an the and but if or because as until while of at by for with about against between into through during before
after above below to from up down in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
# Words with a stem of their own, and words that the first step leaves for good.
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
FINISHED = "inning outing canning herring earring proceed exceed succeed".split()
# Suffixes and what takes their place, longest first; where a pattern follows, what stands before the suffix must match it.
STEP_2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og", "l$"), ("li", "", "[cdeghkmnrt]$")]
STEP_3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]
_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
_SHORT = f"({_OTHER}{_VOWEL}[^aeiouywxY]|^{_VOWEL}{_OTHER})$"


class Dialect:
    """How a dialect tests, takes and replaces by regular expression; the group of a replacement is written as {1}."""

    def __init__(self, test: str, first: str, replace: str, group: str):
        self._test, self._first, self._replace, self._group = test, first, replace, group

    def test(self, x: str, pattern: str) -> str:
        return self._test.format(x=x, p=pattern)

    def first(self, x: str, pattern: str) -> str:
        return self._first.format(x=x, p=pattern)

    def replace(self, x: str, pattern: str, by: str) -> str:
        return self._replace.format(x=x, p=pattern, r=by.replace("{1}", self._group))


DUCKDB = Dialect("regexp_matches({x}, '{p}')", "regexp_extract({x}, '{p}', 0)", "regexp_replace({x}, '{p}', '{r}', 'g')", "\\1")


def _cut(n: int, more: str = "") -> str:
    left = f"substr(w, 1, length(w) - {n})"
    return f"concat({left}, '{more}')" if more else left


def _cases(cases: list[tuple[str, str]]) -> str:
    return "case " + " ".join(f"when {c} then {v}" for c, v in cases) + " else w end"


def steps(d: Dialect) -> list[dict[str, str]]:
    """The steps in order: each the columns that it sets, from the columns word, w, p1 and p2 (characters before either region)."""

    def before(n: int, pattern: str) -> str:
        return d.test(_cut(n), pattern)

    def ends(suffix: str) -> str:
        return f"w like '%{suffix}'"

    region = f"^.*?{_VOWEL}{_OTHER}"
    prefix = d.first("w", "^(gener|commun|arsen)")
    p1 = f"case when {prefix} <> '' then length({prefix}) when {d.test('w', region)} then length({d.first('w', region)}) else length(w) end"
    rest = "substr(w, p1 + 1, length(w) - p1)"
    p2 = f"case when {d.test(rest, region)} then p1 + length({d.first(rest, region)}) else length(w) end"
    vowel = _VOWEL
    s1a = [(ends("sses"), _cut(2)), (f"({ends('ied')} or {ends('ies')})", f"case when length(w) > 4 then {_cut(2)} else {_cut(1)} end"), (f"({ends('us')} or {ends('ss')})", "w"), (f"{ends('s')} and {before(2, vowel)}", _cut(1))]
    eed = [(ends(x), f"case when length(w) - {len(x)} >= p1 then {_cut(len(x), 'ee')} else w end") for x in ("eedly", "eed")]
    # what -ed and -ing leave is marked with a bar, as only then the ending is mended
    ing = [(ends(x), f"case when {before(len(x), vowel)} then {_cut(len(x), '|')} else w end") for x in ("ingly", "edly", "ing", "ed")]
    bare = "replace(w, '|', '')"
    mend = [
        ("w not like '%|'", "w"),
        (d.test("w", "(at|bl|iz)[|]$"), "replace(w, '|', 'e')"),
        (d.test("w", "(bb|dd|ff|gg|mm|nn|pp|rr|tt)[|]$"), _cut(2)),
        (f"{d.test(bare, _SHORT)} and p1 >= length(w) - 1", "replace(w, '|', 'e')"),
    ]
    two = [(ends(s), f"case when length(w) - {len(s)} >= p1" + (f" and {before(len(s), more[0])}" if more else "") + f" then {_cut(len(s), r)} else w end") for s, r, *more in STEP_2]
    three = [(ends(s), f"case when length(w) - {len(s)} >= {'p2' if s == 'ative' else 'p1'} then {_cut(len(s), r)} else w end") for s, r in STEP_3]
    four = [(ends(s), f"case when length(w) - {len(s)} >= p2" + (f" and {before(3, '[st]$')}" if s == "ion" else "") + f" then {_cut(len(s))} else w end") for s in STEP_4]
    five = [
        (f"{ends('e')} and (length(w) - 1 >= p2 or (length(w) - 1 >= p1 and not {before(1, _SHORT)}))", _cut(1)),
        (f"{ends('ll')} and length(w) - 1 >= p2", _cut(1)),
    ]
    kept = " or ".join(["length(word) <= 2", *[f"word = '{k}'" for k in EXCEPTIONS]])
    special = "case word " + " ".join(f"when '{k}' then '{v}'" for k, v in EXCEPTIONS.items()) + " else word end"
    finished = "w in (" + ", ".join(f"'{x}'" for x in FINISHED) + ")"
    return [
        {"w": d.replace(d.replace("word", "^y", "Y"), "([aeiouy])y", "{1}Y")},
        {"p1": p1},
        {"p2": p2},
        {"w": _cases(s1a)},
        {"done": finished},
        {"w": f"case when done then w else {_cases(eed + ing)} end"},
        {"w": f"case when {ends('|')} then " + f"replace({_cases(mend)}, '|', '') else w end"},
        {"w": f"case when not done and {d.test('w', f'.{_OTHER}[yY]$')} then {_cut(1, 'i')} else w end"},
        {"w": f"case when done then w else {_cases(two)} end"},
        {"w": f"case when done then w else {_cases(three)} end"},
        {"w": f"case when done then w else {_cases(four)} end"},
        {"w": f"case when done then w else {_cases(five)} end"},
        {"w": f"case when {kept} then {special} else replace(w, 'Y', 'y') end"},
    ]


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2 or word in EXCEPTIONS:
        return EXCEPTIONS.get(word, word)
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))
    lead = re.match("(gener|commun|arsen)", w) or re.match(f".*?{_VOWEL}{_OTHER}", w)
    p1 = lead.end() if lead else len(w)
    more = re.match(f".*?{_VOWEL}{_OTHER}", w[p1:])
    p2 = p1 + more.end() if more else len(w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_VOWEL, w[:-2]):
        w = w[:-1]
    if w in FINISHED:
        return w
    for suffix in ("eedly", "eed", "ingly", "edly", "ing", "ed"):
        if not w.endswith(suffix):
            continue
        left = w[: -len(suffix)]
        if suffix.startswith("eed"):
            w = left + "ee" if len(left) >= p1 else w
        elif re.search(_VOWEL, left):
            if left.endswith(("at", "bl", "iz")):
                w = left + "e"
            elif left.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
                w = left[:-1]
            else:
                w = left + "e" if re.search(_SHORT, left) and p1 >= len(left) else left
        break
    if re.search(f".{_OTHER}[yY]$", w):
        w = w[:-1] + "i"
    for suffix, by, *before in STEP_2:
        if w.endswith(suffix):
            left = w[: -len(suffix)]
            w = left + by if len(left) >= p1 and (not before or re.search(before[0], left)) else w
            break
    for suffix, by in STEP_3:
        if w.endswith(suffix):
            left = w[: -len(suffix)]
            w = left + by if len(left) >= (p2 if suffix == "ative" else p1) else w
            break
    for suffix in STEP_4:
        if w.endswith(suffix):
            left = w[: -len(suffix)]
            w = left if len(left) >= p2 and (suffix != "ion" or left[-1:] in ("s", "t")) else w
            break
    if w.endswith("e") and (len(w) - 1 >= p2 or len(w) - 1 >= p1 and not re.search(_SHORT, w[:-1])) or w.endswith("ll") and len(w) - 1 >= p2:
        w = w[:-1]
    return w.replace("Y", "y")


_STOP = frozenset(STOP_WORDS)


@F.pandas_udf(ArrayType(StringType()))
def english(words: pd.Series) -> pd.Series:
    """The English lexemes of arrays of lower-case words, in their order and with repeats: stop words left out, others stemmed."""
    return words.map(lambda ws: [] if ws is None else [stem(w) for w in ws if w not in _STOP])


def sql(table: str, d: Dialect = DUCKDB, name: str = "stems") -> str:
    """Common table expressions that end in `name`(word, stem) for a table of distinct words."""
    out, last, have = [], table, ["word"]
    for i, step in enumerate(steps(d)):
        (column, expr), *_ = step.items()
        keep = [c for c in have if c != column]
        out.append(f"{name}_{i} as (select {', '.join(keep)}, {expr} as {column} from {last})")
        have = [*keep, column]
        last = f"{name}_{i}"
    out.append(f"{name} as (select word, w as stem from {last})")
    return ",\n".join(out)
