"""Problem 6: credentials embedded in code, configuration and prose.

Quoted strings and long tokens of any length are taken from each text with the name or phrase they stand under.
Two Shannon entropies are held against thresholds that depend on the length and fall with how clearly the context
names a credential: that of the characters, relative to the alphabet they use, and that of the alphabets along the
string. Of what reaches them, digests, ids, public keys, names made of words, placeholders and references are left
out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read
from .arrow import map_rows

# Words that make a name the name of a credential when they end it.
SECRET_WORDS = frozenset("password passwd passphrase passcode pass pwd pw secret secrets token tok apikey credential credentials cred creds login hmac auth authorization bearer pat dsn".split())
#: ... those of them that people choose the value of,
PASSWORD_WORDS = frozenset("password passwd passphrase passcode pass pwd pw login".split())
#: ... and pairs of a word and "key", "seed", "master" or "salt" that do.
SECRET_PAIRS = frozenset(
    "api_key access_key signing_key secret_key private_key encryption_key auth_key client_key deploy_key master_key account_key shared_key service_key license_key session_key session_seed salt_master master_salt webhook_key ssh_key upstream_auth".split()
)
# Words that make a name the name of a digest or an id.
DIGEST_WORDS = frozenset("sha sha1 sha256 sha512 md5 digest hash checksum integrity revision commit id uuid guid etag fingerprint version ref build pub public sum crc nonce header label hint prompt field column url uri path name title text message format pattern regex placeholder template".split())
# Literals that stand for a credential to be filled in.
PLACEHOLDERS = frozenset(
    """changeme change_me change-me replace_me replaceme replace-me todo tbd fixme none null nil undefined true false example sample dummy
    placeholder secret password passwd token apikey api_key redacted removed hidden masked your_password yourpassword
    your_token your_key string xxx test foo bar foobar unset empty default insert_here""".split()
)
# Tokens that tell by their form that they grant access, and the strings one of which each holds.
KNOWN = re.compile(
    r"""(?<![A-Za-z0-9_])(?:
    (?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])
    |gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[\w-]{20,}
    |(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}
    |xox[abprs]-[A-Za-z0-9-]{10,}
    |AIza[\w-]{35}|npm_[A-Za-z0-9]{36}|SG\.[\w-]{16,}\.[\w-]{16,}|sk-[A-Za-z0-9_-]{20,}|hf_[A-Za-z0-9]{30,}|dop_v1_[a-f0-9]{64}
    |eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{10,}
    )""",
    re.X,
)
_KNOWN_SIGNS = "AKIA ASIA ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- k_live_ k_test_ xox AIza npm_ SG. sk- hf_ dop_v1_ .eyJ".split()
VENDOR = re.compile(r"(?<![A-Za-z0-9_])[a-z]{2,8}_(?:live|key|tok|token|pat|secret|sk)_[A-Za-z0-9]{16,}")
_VENDOR_TAIL = re.compile(r"_(?:live|key|tok|token|pat|secret|sk)_(?=[A-Za-z0-9]{16})")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PUBLIC = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*(?:PUBLIC KEY|CERTIFICATE)(?: BLOCK)?-----.*?-----END [A-Z0-9 ]+-----|\bssh-(?:rsa|ed25519|dss) \S+", re.S)
_URL = re.compile(r"://[^\s/:@\"'`<>]*:([^\s/@\"'`<>]+)@")
_DSN = re.compile(r"[;\"'\s](?:[Pp]assword|PASSWORD|[Pp]wd|PWD)=([^;\"'`\s]+)(?=;|[\"'`])")
_SQL_PASSWORD = re.compile(r"(?:[Pp]assword|PASSWORD|[Ii]dentified\s+by|IDENTIFIED\s+BY)\s+'([^'\n]+)'")
_HEADER = re.compile(r"(?:[Aa]uthorization|AUTHORIZATION)[\"'`]?\s*[:=,]\s*[\"'`]?\s*(?:[Bb]earer|[Bb]asic|[Tt]oken)\s+([^\s\"'`,;)}]{8,})")
_OPTION = re.compile(r"(?<!\S)--?(?:p|pass|password|passphrase|token|key|secret|api-key|apikey|auth|access-token|credential)[ =]([^\s\"'`]+)")
_LOGIN = re.compile(r"(?:[Ll]ogin|[Pp]assword|[Pp]assphrase|[Cc]redentials?|[Aa]ccount)\b[^\n`\"']{0,40}`[^`\n]+`[^\n`]{0,12}\s`([^`\s]+)`|\blogin\s+\S+\s+/\s+(\S+)")
#: A quoted literal without blanks, and the name that binds it: name = "x", "name": "x", name ?? "x", get("NAME", "x").
_QUOTED = re.compile(r"""(["'`])([^\s"'`\\]{8,})\1""")
#: Any quoted content, tried from each quote on: what may stand under a credential's name, with blanks and escapes.
_ANY_QUOTED = re.compile(r"""(?<=[\s=:,(?|>rbuf])(["'`])(?=((?:\\.|(?!\1)[^\\\n]){8,})\1)""")
_BINDER = re.compile(r"""([A-Za-z_$][\w$.-]*)["'`\]]?\s*(?::=|=>|\?\?|\|\||[:=,])\s*\(?\s*(?:\w+\(\s*)?([rbuf]?)\Z""")
#: What joins a literal to the one before it, from that one's closing quote, and its content.
_JOINED = re.compile(r"""["'`][\s\\]*(?:\+|\.{1,2}|&|\|\|)?[\s\\]*(?:(?:\#|//)[^\n]*\n\s*)*[rbuf]?(["'`])([^\s"'`\\]+)(?=\1)""")
_JOINT = re.compile(r"""(["'`][\s\\]*(?:\+|\.{1,2}|&|\|\|)?[\s\\]*(?:(?:\#|//)[^\n]*\n\s*)*[rbuf]?["'`])""")
#: A long token that no name binds, in quotes or bare.
_TOKEN = re.compile(r"(?<![\w+/=.@#%&?:$~\\-])[A-Za-z0-9_+/-]{18,}={0,2}(?![\w+/=@(:\\-]|\.\w)")
#: A part of a private key's text, up to a line break or its escape, and what may stand around it.
_PEM_PART = re.compile(r"""((?:[\s"'`,;()#*|>]|\\(?!n)|\+(?=[\s"'`]))*)([A-Za-z0-9+/=]*)([^\n\\]*)(\n|\\r\\n|\\n|\\|\Z)""")
#: A bare literal and its name, as in environment files, YAML and query strings.
_BARE = re.compile(r"""(?<=\w)(?:=|:[ \t]+)([^\s"'`;&,<>(){}\[\]]{8,})(?=$|[\s;&,"'`)\]}])""", re.M)
_NAME = re.compile(r"(?:^|(?<=[\s;&?,{(]))([A-Za-z_][\w.-]*)\Z", re.M)
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\Z")
_HEX = re.compile(r"(?:0x)?[0-9a-fA-F]+\Z")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_PLAIN = re.compile(r"[A-Za-z]+(?:[-_./:][A-Za-z]+)*\Z")
# Words of a sentence that no passphrase of drawn words is likely to hold.
_TALK = frozenset("a an the your you to of for is are be in on or and not with from this that enter please no must".split())
#: Characters from which on a literal without a name is data, not a token.
BLOB = 160


def entropy(s: str) -> float:
    """Shannon entropy of the characters, in bits each."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def alphabet(s: str) -> int:
    """How many characters the smallest usual alphabet that covers the string has."""
    if _HEX.match(s):
        return 16
    if s.isdigit():
        return 10
    if re.fullmatch(r"[A-Z2-7=]+", s) or re.fullmatch(r"[a-z0-9]+", s) or re.fullmatch(r"[A-Z0-9]+", s):
        return 36
    if re.fullmatch(r"[A-Za-z0-9+/=_-]+", s):
        return 64
    return 94


def alphabet_entropy(s: str) -> float:
    """Shannon entropy of each character's alphabet (lower case, upper case, digits, signs) given the one before it, in bits.

    Words and names stay within an alphabet and change it in fixed ways; a random string changes it at random.
    """
    kinds = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-" for c in s]
    pairs = Counter(zip(kinds, kinds[1:]))
    first = Counter(kinds[:-1])
    n = len(kinds) - 1
    return -sum(c / n * math.log2(c / first[x]) for (x, _), c in pairs.items()) if n > 0 else 0.0


# By how clear the context is, the least share of what a random string of the length and alphabet would
# have in entropy of characters (shorter than LONG, and from there on), and the least entropy of alphabets in bits.
# 0: no name; 1: a header or exported variable; 2: a credential's name; 3: a password's; 4: a form that tells by itself.
LONG = 20
THRESHOLDS = {0: (0.87, 0.86, 0.78), 1: (0.78, 0.78, 0.45), 2: (0.72, 0.8, 0.35), 3: (0.72, 0.74, 0.3), 4: (0.6, 0.6, 0.0)}
#: The same where there are only letters, and signs between words: names are made of them.
LETTERS = (0.93, 0.93, 0.6)
#: Characters that tell the entropy of alphabets; of fewer, less is asked.
TELLING = 16


@lru_cache(maxsize=1 << 16)
def is_random(s: str, level: int) -> bool:
    """Whether the entropies of a string reach the thresholds of its length and of how clearly its context names a credential."""
    if len(s) < 6:
        return False
    at, telling = THRESHOLDS[level], min(1.0, len(s) / TELLING)
    bare = s if level >= 2 else re.sub(r"[-_]?v?\d{1,3}\Z", "", s)
    if level < 4 and _PLAIN.match(bare) and not (level == 3 and classes(s) >= 3 and not s[:1].isupper()):
        s, at, telling = bare, LETTERS, 1.0  # but for a password chosen of words
    n = len(s)  # a random draw of n from an alphabet holds no more than n different letters
    return n > 0 and entropy(s) >= at[n >= LONG] * math.log2(min(n, alphabet(s))) and alphabet_entropy(s) >= at[2] * telling


def classes(s: str) -> int:
    return any(c.islower() for c in s) + any(c.isupper() for c in s) + any(c.isdigit() for c in s) + any(not c.isalnum() for c in s)


def is_placeholder(s: str) -> bool:
    """Placeholders, references to variables or vaults, and masks."""
    low = s.lower().strip("_-.*")
    if not low or low in PLACEHOLDERS or s[0] in "$%<{[" or s.startswith(("env:", "vault:", "secrets.", "process.env", "os.environ", "arn:", "ref:", "op://")):
        return True
    if "${" in s or "{{" in s or "<" in s and ">" in s or "%(" in s or "example" in low or "placeholder" in low:
        return True
    if re.match(r"(?i)(?:your|my|the|insert|enter|replace|change|some|dummy|fake|sample|test)[-_](?:.*)", s) and not any(c.isdigit() for c in s):
        return True
    return len(set(low)) <= 2


def names_secret(name: str) -> int:
    """3: the name says password; 2: it says credential; 0: it says nothing; -1: it says digest, id or text."""
    parts = [w.lower() for w in _WORDS.findall(name)]
    if not parts:
        return 0
    last = parts[-1]
    while len(parts) > 1 and (last.isdigit() or last in ("v", "value", "val", "str", "old", "new", "prod", "dev", "env")):
        parts.pop()
        last = parts[-1]
    if last in SECRET_WORDS or "_".join(parts[-2:]) in SECRET_PAIRS:
        return 3 if last in PASSWORD_WORDS else 2
    return -1 if last in DIGEST_WORDS else 0


def is_excluded(value: str, level: int) -> bool:
    """Placeholders, references, ids, digests by their prefix, addresses, paths, calls and numbers."""
    if is_placeholder(value) or _UUID.match(value) or value.startswith(("sha1-", "sha256:", "sha512:", "sha256-", "sha384-", "sha512-", "md5:", "http://", "https://", "./", "../", "/api", "@")):
        return True
    if value.isdigit() or "://" in value or value.count(".") > 4:
        return True
    if value.count("(") and (level < 2 or re.search(r"^[\w.]+\(.*\)$|\w\(\)", value)):
        return True
    return False


def is_credential(value: str, level: int, carrier: str = "") -> bool:
    """Whether a literal under a name of this level is one: by its entropies first, then by what is excluded.

    The thresholds fall with the clarity of the context. A long literal that nothing names is a digest if it is
    hexadecimal, and data saved as code from BLOB characters on.
    """
    if level >= 2 and re.search(r"\s", value):
        return not is_excluded(value, level) and _phrase(value, carrier == "phrase")
    if level < 0:
        return False
    clear = level if level >= 2 else 1 if carrier in ("export", "header") else 0
    if len(value) < (8 if clear >= 2 else 16 if carrier in ("export", "header", "env") else 18) or not is_random(value, clear):
        return False
    if clear == 0 and (_HEX.match(value) or len(value) >= BLOB):
        return False
    return not is_excluded(value, level)


def _phrase(value: str, named: bool) -> bool:
    """Whether a text with blanks under a credential's name is one: it holds a word that is none, or is a passphrase by its name."""
    words = value.split()
    if any(len(w) >= 5 and classes(w) >= 3 and not w.startswith(("$", "{", "%")) and is_random(w, 2) for w in words):
        return True
    return named and len(words) >= 4 and all(w.isalpha() and w.islower() for w in words) and not _TALK.intersection(words)


def find(text: str, path: str | None = None) -> list[tuple[int, int, str]]:
    """The credentials of a text as (start, end, kind), in order and without overlaps."""
    if not text:
        return []
    hits: list[tuple[int, int, str]] = []
    blocked: list[tuple[int, int]] = []
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            e = _PEM_END.search(text, m.end())
            stop = e.end() if e else _pem_stop(text, m.end())
            body = re.sub(r"\\n|[^A-Za-z0-9+/=]", "", text[m.end() : e.start() if e else stop])
            if len(body) >= 40 and len(set(body)) > 12:
                hits.append((m.start(), stop, "private key"))
            blocked.append((m.start(), stop))
    if "-----BEGIN" in text or "ssh-" in text:
        for m in _PUBLIC.finditer(text):
            blocked.append((m.start(), m.end()))

    def free(a: int, b: int) -> bool:
        return not any(x < b and a < y for x, y in blocked)

    def add(a: int, b: int, kind: str) -> None:
        if free(a, b):
            hits.append((a, b, kind))
            blocked.append((a, b))

    known = []
    if any(sign in text for sign in _KNOWN_SIGNS):
        known.append(KNOWN)
    if _VENDOR_TAIL.search(text):
        known.append(VENDOR)
    for pattern in known:
        for m in pattern.finditer(text):
            v = m.group()
            if not is_placeholder(v) and is_random(v.rsplit("_", 1)[-1] if "_" in v else v, 4):
                add(m.start(), m.end(), "known token")
    for sign, pattern, kind in _CONTEXTS:
        if not any(x in text for x in sign):
            continue
        for m in pattern.finditer(text):
            k = 1 if m.group(1) is not None else 2
            v = m.group(k)
            if is_placeholder(v) or v.isdigit() or not is_random(v, 2 if kind in ("option", "login") else 3):
                continue
            a, b = m.span(k)
            if kind in ("login", "option"):
                b = a + len(v.rstrip(".,;:"))
            add(a, b, kind)
    env = bool(path) and (re.search(r"(?:^|/)[^/]*\.env(?:\.[^/]*)?$", path) is not None)
    upto = 0
    for m in _QUOTED.finditer(text):
        if m.start() < upto:
            continue  # joined to the one before
        v, end = m.group(2), m.end(2)
        while j := _JOINED.match(text, end):
            v, end = v + j.group(2), j.end(2)
        if end > m.end(2):
            upto = end
            begun = [h for h in hits if m.start(2) <= h[0] and h[1] <= m.end(2)]
            if begun:
                # what is joined to a hit belongs to it
                hits = [h for h in hits if not (begun[0][0] <= h[0] and h[1] <= end)] + [(begun[0][0], end, begun[0][2])]
                blocked.append((begun[0][0], end))
                continue
        if not is_random(v, 3):
            continue  # not even as a password
        n = _bound(text, m.start())
        if n is None:
            continue  # a token without a name, if it is one
        name, before = n.group(1), n.string
        if "{" in v and (n.group(2) or m.group(1) == "`"):
            continue  # an interpolated string
        level, carrier = names_secret(name), ""
        if before[: n.start()].endswith("export ") and before[n.end(1) : n.end(1) + 1] == "=":
            # in an environment file a value in quotes is no digest unless it looks like one
            carrier = "export"
            if level < 0 and not _HEX.match(v):
                level = 0
        elif level == 0 and re.match(r"(?i)x-[a-z]", name):
            carrier = "header"
        if is_credential(v, level, carrier) and not (level == 0 and not carrier and _in_data(text, m.start(2), m.end(2))):
            add(m.start(2), end, "named literal" if level >= 2 else "random literal")
    for m in _ANY_QUOTED.finditer(text):
        v = m.group(2)
        a, b = m.span(2)
        if not free(a, b):
            continue
        if not (_phrase(v, True) if re.search(r"\s", v) else is_random(v, 3) or _JOINED.match(text, b)):
            continue
        n = _bound(text, m.start())
        if n is None or names_secret(n.group(1)) < 2 or "{" in v and (n.group(2) or m.group(1) == "`"):
            continue
        whole, end = v, b
        while j := _JOINED.match(text, end):
            whole, end = whole + j.group(2), j.end(2)
        if is_credential(whole, names_secret(n.group(1)), "phrase" if "phrase" in n.group(1).lower() else ""):
            add(a, end, "named literal")
    for m in _BARE.finditer(text):
        if not is_random(m.group(1).rstrip(".,:"), 3):
            continue
        n = _NAME.search(text, max(0, m.start() - 80), m.start())
        if n is None:
            continue
        v = m.group(1).rstrip(".,:")
        level = names_secret(n.group(1))
        if level == 0 and not env:
            continue
        if is_credential(v, level, "env" if env else ""):
            if not env and re.match(r"[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)*$", v) and not (len(v) >= 12 and is_random(v, 0)):
                continue  # a variable
            add(m.start(1), m.start(1) + len(v), "named literal")
    for m in _TOKEN.finditer(text):
        v = m.group()
        if is_credential(v, 0, "token") and free(m.start(), m.end()) and _unbound(text, m.start(), m.end()):
            add(m.start(), m.end(), "random token")
    return sorted(hits)


def _bound(text: str, at: int) -> re.Match | None:
    """The name that binds a literal that begins at this place: an operator or a bracket stands before it, and the name before that."""
    before = text[max(0, at - 120) : at]
    end = before.rstrip()
    if end[-1:] in "rbuf" and end:
        end = end[:-1].rstrip()
    return _BINDER.search(before) if end and end[-1] in "=:,>?|(" else None


def _pem_stop(text: str, at: int) -> int:
    """Where the body of a private key that has no end line ends."""
    stop, begun, gap = at, False, False
    for p in _PEM_PART.finditer(text, at):
        token, rest = p.group(2), p.group(3)
        if not token and not rest:
            gap = gap or p.group(1).count("\n") > 0
        elif not begun and re.match(r"[A-Za-z-]+: ", token + rest):
            pass  # a header of the block
        elif token and (len(token) >= 16 or begun and not gap and not rest.strip("\"'`,;() \r\t+")):
            stop, begun, gap = p.end(2), True, p.group(1).count("\n") > 1
            if rest.strip("\"'`,;() \r\t+"):
                break
        else:
            break
        if p.end() >= len(text):
            break
    return stop


def _unbound(text: str, a: int, b: int) -> bool:
    """Whether a token that no name binds may be a credential: it is no digest or id by its name, no path and no line of data."""
    before, after = text[max(0, a - 120) : a], text[b : b + 100]
    n = _BINDER.search(before[:-1] if before[-1:] in ("\"", "'", "`") else before)
    if n is not None and names_secret(n.group(1)) < 0:
        return False
    if re.search(r"[A-Za-z0-9+/=]{40,}[\"'`,\\n\s+]*\Z", before) or re.match(r"[\"'`,\\n\s+]*[A-Za-z0-9+/=]{40,}", after):
        return False
    return not _in_data(text, a, b)


_CONTEXTS = (
    (("://",), _URL, "url"),
    (("assword=", "ASSWORD=", "wd=", "WD="), _DSN, "connection string"),
    (("assword", "ASSWORD", "dentified", "DENTIFIED"), _SQL_PASSWORD, "sql password"),
    (("uthorization", "UTHORIZATION"), _HEADER, "header"),
    ((" -",), _OPTION, "option"),
    (("ogin", "assword", "assphrase", "redential", "ccount"), _LOGIN, "login"),
)


def _in_data(text: str, a: int, b: int) -> bool:
    """Whether a literal is one of a run of long literals, as in data saved as code."""
    nxt = re.match(r"[\"'`]\s*[+,]?\s*[\"'`][A-Za-z0-9+/=]{40,}", text[b : b + 80])
    return nxt is not None


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with every credential masked in place: letters and digits become X, all else stays, so that
    quotes, lengths, line breaks and the syntax around are as they were."""
    out, pos = [], 0
    for a, b, kind in found:
        out.append(text[pos:a])
        piece = text[a:b]
        if kind == "private key":
            head = _PEM.match(piece)
            tail = _PEM_END.search(piece)
            stop = tail.start() if tail else len(piece)
            out.append(piece[: head.end()] + re.sub(r"(?<!\\)[A-Za-z0-9+/=]", "X", piece[head.end() : stop]) + piece[stop:])
        else:
            # what joins the parts of a split literal stays
            out += [x if k % 2 else re.sub(r"[A-Za-z0-9]", "X", x) for k, x in enumerate(_JOINT.split(piece))]
        pos = b
    out.append(text[pos:])
    return "".join(out)


_FOUND = "chunk_id string, line_no int, char_start int, char_end int, kind string, entropy double"


def findings(chunks: DataFrame) -> DataFrame:
    """Rows (chunk_id, line_no, char_start, char_end, kind, entropy), one a credential, for (id, content, path).

    Lines are split at line feeds and counted from 1; a credential of several lines begins on its first. Null
    or empty contents give no rows, a repeated chunk repeated ones.
    """

    def one(chunk_id, content, path):
        for a, b, kind in find(content or "", path):
            yield chunk_id, content.count("\n", 0, a) + 1, a, b, kind, entropy("".join(_JOINT.split(content[a:b])[::2]))

    return map_rows(chunks.select("id", "content", "path").filter(F.col("content").isNotNull()), _FOUND, one)


def redacted(chunks: DataFrame) -> DataFrame:
    """Rows (chunk_id, credentials, content): every chunk with its credentials masked; null contents stay null."""

    def one(chunk_id, content, path):
        f = find(content or "", path)
        yield chunk_id, len(f), redact(content, f) if f else content

    return map_rows(chunks.select("id", "content", "path"), "chunk_id string, credentials int, content string", one)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return findings(read(spark, d, "document_chunks", "id", "content", "path")).select("chunk_id", "line_no").distinct()


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redacted(read(spark, d, "document_chunks", "id", "content", "path"))
