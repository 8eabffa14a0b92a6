"""Recognisers for JavaScript modules and TypeScript.

One tokenizer and one recursive-descent recogniser, written from the public
language grammars.  It answers only "does this text parse"; it builds no tree,
does no name resolution and reports no early errors other than those that the
grammar itself gives.
"""

from __future__ import annotations

import re


class SyntaxFault(Exception):
    """The text is not in the language."""


_SKIP = re.compile(r"(?:[\s﻿]+|//[^\n\r  ]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)+")
_NAME = r"(?:[A-Za-z_$ª-￿]|[\U00010000-\U0010ffff]|\\u[0-9a-fA-F]{4})(?:[\w$‌‍]|[ª-￿]|\\u[0-9a-fA-F]{4})*"
_TOKEN = re.compile(
    rf"""(\#?{_NAME})
    |("(?:[^"\\\n\r]|\\(?:\r\n|.|\n))*"|'(?:[^'\\\n\r]|\\(?:\r\n|.|\n))*')
    |((?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d[\d_]*)?|\.\d[\d_]*(?:[eE][+-]?\d[\d_]*)?)n?(?![\w$]))
    |(>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|<<|>>|\*\*|[{{}}()\[\];,<>+\-*%&|^!~?:=.@])
    |(/)
    |(`)""",
    re.X,
)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\(?:.|\n)|\$(?!\{))*(`|\$\{)", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/([A-Za-z]*)(?![\w$])")

# The reserved words of module code.
RESERVED = frozenset(
    """break case catch class const continue debugger default delete do else enum export extends false finally for
    function if import in instanceof new null return super switch this throw true try typeof var void while with
    let static yield await implements interface package private protected public""".split()
)
#: Reserved words of strict code that this recogniser lets stand as names, as they are contextual in TypeScript.
_CONTEXTUAL = frozenset("static yield await implements interface package private protected public let".split())
_HARD = RESERVED - _CONTEXTUAL
_BEFORE_REGEX = frozenset("return typeof case in of instanceof new delete void throw do else yield await default extends".split())
_HEADS = frozenset("if while for with".split())
_BINARY = frozenset("+ - * / % ** == != === !== < > <= >= << >> >>> & | ^ && || ?? in instanceof".split())
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_PREFIX = frozenset("+ - ! ~ typeof void delete ++ -- await".split())
_CLOSE = {")": "(", "]": "[", "}": "{"}
_MODIFIERS = frozenset("public private protected static readonly abstract override declare async get set accessor".split())


def tokens(src: str):
    """(kinds, values, newline before, matching bracket) or SyntaxFault.

    Kinds: n name, s string, d number, p punctuator, r regular expression, t whole template,
    h m e head, middle and end of a template with substitutions, $ the end.
    """
    kinds: list[str] = []
    vals: list[str] = []
    nls: list[bool] = []
    match: list[int] = []
    stack: list[int] = []
    pos, n = 0, len(src)
    if src.startswith("#!"):
        pos = src.find("\n")
        pos = n if pos < 0 else pos
    skip, tok = _SKIP.match, _TOKEN.match
    kadd, vadd, nadd, madd = kinds.append, vals.append, nls.append, match.append
    nl = True
    closed = 0  # where the bracket closed last was opened
    while True:
        m = skip(src, pos)
        if m:
            e = m.end()
            nl = nl or "\n" in src[pos:e] or "\r" in src[pos:e]
            pos = e
        if pos >= n:
            break
        m = tok(src, pos)
        if m is None:
            raise SyntaxFault(f"character at {pos}")
        k = m.lastindex
        v = m.group()
        if k == 4:
            if v in "([{":
                stack.append(len(kinds))
            elif v in ")]}":
                if not stack:
                    raise SyntaxFault(f"unopened {v} at {pos}")
                o = stack.pop()
                if vals[o] != _CLOSE[v]:
                    if v == "}" and kinds[o] in "hm":
                        t = _TEMPLATE.match(src, pos + 1)
                        if t is None:
                            raise SyntaxFault("unterminated template")
                        match[o] = len(kinds)
                        if t.group(1) == "`":
                            kadd("e")
                        else:
                            stack.append(len(kinds))
                            kadd("m")
                        vadd("}")
                        nadd(nl)
                        madd(-1)
                        nl = False
                        pos = t.end()
                        continue
                    raise SyntaxFault(f"{v} at {pos} closes {vals[o]}")
                match[o] = len(kinds)
                closed = o
            kadd("p")
        elif k == 1:
            kadd("n")
        elif k == 2:
            kadd("s")
        elif k == 3:
            kadd("d")
        elif k == 5:
            pk = kinds[-1] if kinds else "p"
            pv = vals[-1] if kinds else ";"
            # after the head of an if, while, for or with no value has been read: a slash begins a regular expression
            head = pk == "p" and pv == ")" and closed > 0 and kinds[closed - 1] == "n" and vals[closed - 1] in _HEADS and not (closed > 1 and vals[closed - 2] == ".")
            if head or (pk == "p" and pv not in (")", "]", "}", "++", "--")) or (pk == "n" and pv in _BEFORE_REGEX and not (len(vals) > 1 and vals[-2] == ".")) or pk in "hm":
                m = _REGEX.match(src, pos)
                if m is None:
                    raise SyntaxFault(f"regular expression at {pos}")
                flags = m.group(1)
                if len(set(flags)) != len(flags) or set(flags) - set("dgimsuyv"):
                    raise SyntaxFault("flags of a regular expression")
                v = m.group()
                kadd("r")
            else:
                if src.startswith("/=", pos):
                    v = "/="
                kadd("p")
        else:
            t = _TEMPLATE.match(src, pos + 1)
            if t is None:
                raise SyntaxFault("unterminated template")
            pos = t.end()
            if t.group(1) == "`":
                kadd("t")
            else:
                stack.append(len(kinds))
                kadd("h")
            vadd("`")
            nadd(nl)
            madd(-1)
            nl = False
            continue
        vadd(v)
        nadd(nl)
        madd(-1)
        nl = False
        pos += len(v)
    if stack:
        raise SyntaxFault(f"unclosed {vals[stack[-1]]}")
    for _ in range(3):
        kadd("$")
        vadd("")
        nadd(True)
        madd(-1)
    return kinds, vals, nls, match


def recognise(src: str, types: bool) -> None:
    """Raise SyntaxFault unless src is a JavaScript module, or with types a TypeScript file."""
    K, V, NL, M = tokens(src)
    i = 0
    depth_fn = 0

    def fail(what: str = "") -> None:
        raise SyntaxFault(f"{what or 'unexpected'} {V[i]!r} at token {i}")

    def eat(v: str) -> None:
        nonlocal i
        if V[i] != v or K[i] == "s":
            fail(f"expected {v}, found")
        i += 1

    def is_name(at: int) -> bool:
        return K[at] == "n" and V[at] not in _HARD and V[at][0] != "#"

    def name() -> None:
        nonlocal i
        if K[i] != "n" or V[i] in _HARD or V[i][0] == "#":
            fail("expected a name, found")
        i += 1

    def end() -> None:
        """The end of a statement, with automatic semicolons."""
        nonlocal i
        if V[i] == ";" and K[i] == "p":
            i += 1
        elif not (NL[i] or (V[i] == "}" and K[i] in "pme") or K[i] == "$"):
            fail("expected the end of the statement, found")

    # ---- types (TypeScript only)
    def gt() -> None:
        """Close a list of type arguments, splitting >> and its kin."""
        nonlocal i
        v = V[i]
        if v == ">":
            i += 1
        elif v[:1] == ">" and K[i] == "p":
            V[i] = v[1:]
        else:
            fail("expected >, found")

    def type_args() -> None:
        nonlocal i
        eat("<")
        type_()
        while V[i] == ",":
            i += 1
            if V[i][:1] == ">":
                break
            type_()
        gt()

    def type_params() -> None:
        nonlocal i
        eat("<")
        while True:
            while V[i] in ("const", "in", "out") and K[i + 1] == "n":
                i += 1
            name()
            if V[i] == "extends":
                i += 1
                type_()
            if V[i] == "=":
                i += 1
                type_()
            if V[i] != ",":
                break
            i += 1
            if V[i][:1] == ">":
                break
        gt()

    def type_() -> None:
        nonlocal i
        union()
        if V[i] == "extends" and not NL[i]:
            i += 1
            union()
            eat("?")
            type_()
            eat(":")
            type_()

    def union() -> None:
        nonlocal i
        if V[i] in ("|", "&") and K[i] == "p":
            i += 1
        type_postfix()
        while V[i] in ("|", "&") and K[i] == "p":
            i += 1
            type_postfix()

    def type_postfix() -> None:
        nonlocal i
        type_primary()
        while V[i] == "[" and not NL[i]:
            i += 1
            if V[i] != "]":
                type_()
            eat("]")

    def return_type() -> None:
        nonlocal i
        if V[i] == "asserts" and K[i + 1] == "n" and not NL[i + 1] and V[i + 1] != "is":
            i += 2
            if V[i] == "is":
                i += 1
                type_()
            return
        if K[i] == "n" and V[i + 1] == "is" and K[i + 1] == "n" and not NL[i + 1]:
            i += 2
        type_()

    def type_primary() -> None:
        nonlocal i
        k, v = K[i], V[i]
        if k == "n":
            if v in ("keyof", "unique", "readonly", "infer") and (K[i + 1] in "nsd" or V[i + 1] in ("(", "[", "{")) and not NL[i + 1]:
                i += 1
                type_postfix()
                return
            if v in ("new", "abstract") and (V[i + 1] in ("(", "<") or V[i + 1] == "new"):
                i += 1
                if V[i] == "new":
                    i += 1
                if V[i] == "<":
                    type_params()
                params(True)
                eat("=>")
                return_type()
                return
            if v == "typeof":
                i += 1
                if V[i] == "import":
                    type_primary()
                    return
                if K[i] != "n":
                    fail()
                i += 1
                while V[i] == ".":
                    i += 1
                    if K[i] != "n":
                        fail()
                    i += 1
                if V[i] == "<":
                    type_args()
                return
            if v == "import":
                i += 1
                eat("(")
                type_()
                eat(")")
            elif v in _HARD and v not in ("void", "null", "true", "false", "this"):
                fail("in a type,")
            elif v[0] == "#":
                fail()
            else:
                i += 1
            while V[i] == "." and K[i] == "p":
                i += 1
                if K[i] != "n":
                    fail()
                i += 1
            if V[i] == "<" and not NL[i]:
                type_args()
        elif k == "s" or k == "d" or k == "t":
            i += 1
        elif k == "h":
            i += 1
            while True:
                type_()
                if K[i] == "e":
                    i += 1
                    return
                if K[i] != "m":
                    fail()
                i += 1
        elif v == "-":
            i += 1
            if K[i] != "d":
                fail()
            i += 1
        elif v == "(":
            if V[M[i] + 1] == "=>":
                params(True)
                eat("=>")
                return_type()
            else:
                i += 1
                type_()
                eat(")")
        elif v == "<":
            type_params()
            params(True)
            eat("=>")
            return_type()
        elif v == "[":
            i += 1
            while V[i] != "]":
                if V[i] == "...":
                    i += 1
                if K[i] == "n" and (V[i + 1] == ":" or (V[i + 1] == "?" and V[i + 2] == ":")):
                    i += 2 if V[i + 1] == ":" else 3
                type_()
                if V[i] == "?":
                    i += 1
                if V[i] != ",":
                    break
                i += 1
            eat("]")
        elif v == "{":
            type_members()
        else:
            fail("in a type,")

    def type_members() -> None:
        nonlocal i
        eat("{")
        while V[i] != "}" or K[i] != "p":
            type_member()
            if V[i] in (";", ",") and K[i] == "p":
                i += 1
            elif not (V[i] == "}" or NL[i]):
                fail("expected the end of a member, found")
        i += 1

    def type_member() -> None:
        nonlocal i
        if V[i] in ("+", "-") and V[i + 1] == "readonly":
            i += 1
        while V[i] in ("readonly", "get", "set") and (K[i + 1] in "nsd" or V[i + 1] == "[") and not (K[i + 1] == "p" and V[i + 1] != "["):
            i += 1
        v = V[i]
        if v in ("(", "<"):
            if v == "<":
                type_params()
            params(True)
            if V[i] == ":":
                i += 1
                return_type()
            return
        if v == "new" and V[i + 1] in ("(", "<"):
            i += 1
            if V[i] == "<":
                type_params()
            params(True)
            if V[i] == ":":
                i += 1
                return_type()
            return
        if v == "[" and K[i] == "p":
            close = M[i]
            if K[i + 1] == "n" and V[i + 2] == ":":
                i += 3
                type_()
                eat("]")
            elif K[i + 1] == "n" and V[i + 2] == "in":
                i += 3
                type_()
                if V[i] == "as":
                    i += 1
                    type_()
                eat("]")
            else:
                i += 1
                assign(False)
                if i != close:
                    fail()
                eat("]")
            if V[i] in ("+", "-"):
                i += 1
        elif K[i] in "nsd":
            i += 1
        else:
            fail("in a type,")
        if V[i] == "?":
            i += 1
        if V[i] in ("(", "<") and K[i] == "p":
            if V[i] == "<":
                type_params()
            params(True)
        if V[i] == ":":
            i += 1
            return_type()

    # ---- bindings and functions
    def binding() -> None:
        nonlocal i
        v = V[i]
        if v == "{" and K[i] == "p":
            i += 1
            while V[i] != "}":
                if V[i] == "...":
                    i += 1
                    binding()
                else:
                    plain = is_name(i)
                    key()
                    if V[i] == ":":
                        i += 1
                        binding()
                    elif not plain:
                        fail()
                if V[i] == "=":
                    i += 1
                    assign(False)
                if V[i] != ",":
                    break
                i += 1
            eat("}")
        elif v == "[" and K[i] == "p":
            i += 1
            while V[i] != "]":
                if V[i] == ",":
                    i += 1
                    continue
                if V[i] == "...":
                    i += 1
                binding()
                if V[i] == "=":
                    i += 1
                    assign(False)
                if V[i] != ",":
                    break
                i += 1
            eat("]")
        else:
            name()

    def params(in_type: bool = False) -> None:
        nonlocal i
        eat("(")
        while V[i] != ")":
            if types:
                while V[i] == "@" and K[i] == "p":
                    decorator()
                while V[i] in ("public", "private", "protected", "readonly", "override") and K[i + 1] == "n":
                    i += 1
            if V[i] == "...":
                i += 1
            if types and V[i] == "this":
                i += 1
            else:
                binding()
            if types:
                if V[i] == "?":
                    i += 1
                if V[i] == ":":
                    i += 1
                    type_()
            if V[i] == "=" and not in_type:
                i += 1
                assign(False)
            if V[i] != ",":
                break
            i += 1
        eat(")")

    def signature() -> None:
        nonlocal i
        if types and V[i] == "<":
            type_params()
        params()
        if types and V[i] == ":":
            i += 1
            return_type()

    def body() -> None:
        nonlocal i, depth_fn
        eat("{")
        depth_fn += 1
        while V[i] != "}" or K[i] != "p":
            statement()
        depth_fn -= 1
        i += 1

    def function(named: bool) -> None:
        nonlocal i
        eat("function")
        if V[i] == "*":
            i += 1
        if is_name(i):
            i += 1
        elif named:
            fail("expected a name, found")
        signature()
        if types and named and V[i] != "{":
            end()
        else:
            body()

    def key() -> None:
        """A property name."""
        nonlocal i
        if K[i] in "nsd":
            i += 1
        elif V[i] == "[" and K[i] == "p":
            i += 1
            assign(False)
            eat("]")
        else:
            fail("expected a property name, found")

    def decorator() -> None:
        nonlocal i
        eat("@")
        if V[i] == "(":
            i = M[i] + 1
            return
        name()
        while V[i] == ".":
            i += 1
            if K[i] != "n":
                fail()
            i += 1
        if V[i] == "(":
            arguments()

    def class_(named: bool) -> None:
        nonlocal i
        eat("class")
        if is_name(i) and V[i] not in ("implements",):
            i += 1
        elif named:
            fail("expected a name, found")
        if types and V[i] == "<":
            type_params()
        if V[i] == "extends":
            i += 1
            operand()
            if types and V[i] == "<":
                type_args()
        if types and V[i] == "implements":
            i += 1
            type_postfix()
            while V[i] == ",":
                i += 1
                type_postfix()
        eat("{")
        while V[i] != "}" or K[i] != "p":
            if V[i] == ";":
                i += 1
                continue
            member()
        i += 1

    def member() -> None:
        nonlocal i
        while V[i] == "@" and K[i] == "p":
            decorator()
        if V[i] == "static" and V[i + 1] == "{":
            i += 1
            body()
            return
        allowed = _MODIFIERS if types else ("static", "async", "get", "set", "accessor")
        while V[i] in allowed and K[i] == "n" and (K[i + 1] in "nsd" or V[i + 1] in ("[", "*")) and not (NL[i + 1] and V[i] not in ("static", "get", "set", "public", "private", "protected", "readonly")):
            i += 1
        if V[i] == "*" and K[i] == "p":
            i += 1
        if types and V[i] == "[" and K[i + 1] == "n" and V[i + 2] == ":":
            type_member()
            end()
            return
        key()
        if types and V[i] in ("?", "!") and K[i] == "p":
            i += 1
        if V[i] == "(" or (types and V[i] == "<"):
            signature()
            if V[i] == "{":
                body()
            elif types:
                end()
            else:
                fail("expected {, found")
            return
        if types and V[i] == ":":
            i += 1
            type_()
        if V[i] == "=":
            i += 1
            assign(False)
        end()

    # ---- expressions
    def arguments() -> None:
        nonlocal i
        eat("(")
        while V[i] != ")" or K[i] != "p":
            if V[i] == "...":
                i += 1
            assign(False)
            if V[i] != ",":
                break
            i += 1
        eat(")")

    def object_() -> None:
        nonlocal i
        close = M[i]
        pattern = V[close + 1] == "=" or V[close + 1] in ("of", "in")
        i += 1
        while V[i] != "}" or K[i] != "p":
            v = V[i]
            if v == "..." and K[i] == "p":
                i += 1
                assign(False)
            else:
                accessor = False
                while v in ("async", "get", "set") and K[i] == "n" and (K[i + 1] in "nsd" or V[i + 1] in ("[", "*")):
                    accessor = True
                    i += 1
                    v = V[i]
                if v == "*" and K[i] == "p":
                    accessor = True
                    i += 1
                plain = is_name(i)
                key()
                v = V[i]
                if v == "(" or (types and v == "<"):
                    signature()
                    body()
                elif accessor:
                    fail()
                elif v == ":":
                    i += 1
                    assign(False)
                elif not plain:
                    fail()
                elif v == "=" and pattern:
                    i += 1
                    assign(False)
            if V[i] != ",":
                break
            i += 1
        eat("}")

    def arrow_body(no_in: bool) -> None:
        nonlocal i
        if NL[i]:
            fail("line break before")
        eat("=>")
        if V[i] == "{" and K[i] == "p":
            body()
        else:
            assign(no_in)

    def paren_arrow(at: int) -> bool:
        """Whether the parenthesis at `at` opens the parameters of an arrow function."""
        nonlocal i
        nxt = M[at] + 1
        if V[nxt] == "=>" and K[nxt] == "p":
            return True
        if not types or V[nxt] != ":" or K[nxt] != "p":
            return False
        keep, values = i, None
        try:
            i, values = at, list(V[nxt : nxt + 64])
            params()
            eat(":")
            return_type()
            return V[i] == "=>" and not NL[i]
        except (SyntaxFault, IndexError):
            return False
        finally:
            i = keep
            if values is not None:
                V[nxt : nxt + len(values)] = values

    def template() -> None:
        nonlocal i
        i += 1
        while True:
            expression(False)
            if K[i] == "e":
                i += 1
                return
            if K[i] != "m":
                fail("in a template,")
            i += 1

    def generic_call() -> bool:
        """In TypeScript: whether < opens type arguments that a call or template follows."""
        nonlocal i
        keep = i
        values = list(V[i : i + 64])
        try:
            type_args()
            if V[i] in ("(", ".", "?.", ")", "]", ":", ";", ",", "}") or K[i] in "th" or K[i] == "$":
                return True
        except (SyntaxFault, IndexError):
            pass
        V[keep : keep + len(values)] = values
        i = keep
        return False

    def operand() -> int:
        """A unary expression. 1: it can be assigned to; 2: it may be a pattern; 0: neither."""
        nonlocal i
        target = 0
        k, v = K[i], V[i]
        if k == "n":
            if v in _HARD:
                if v == "this" or v == "null" or v == "true" or v == "false":
                    i += 1
                elif v == "typeof" or v == "void" or v == "delete":
                    i += 1
                    operand()
                    return 0
                elif v == "function":
                    function(False)
                elif v == "new":
                    i += 1
                    if V[i] == ".":
                        i += 1
                        if V[i] != "target":
                            fail()
                        i += 1
                    else:
                        operand()
                        return 1 if V[i - 1] == "]" else 0
                elif v == "class":
                    class_(False)
                elif v == "super":
                    i += 1
                    if V[i] not in ("(", ".", "["):
                        fail()
                elif v == "import":
                    i += 1
                    if V[i] == ".":
                        i += 2
                    elif V[i] != "(":
                        fail()
                else:
                    fail()
            elif v == "await" and (K[i + 1] in "nsdrth" or V[i + 1] in ("(", "[", "{", "+", "-", "!", "~")) and not (K[i + 1] == "n" and V[i + 1] in ("in", "of", "instanceof")):
                i += 1
                operand()
                return 0
            elif v == "async" and V[i + 1] == "function" and not NL[i + 1]:
                i += 1
                function(False)
            elif v[0] == "#":
                if V[i + 1] != "in":
                    fail()
                i += 1
                return 0
            else:
                i += 1
                target = 1
        elif k == "s" or k == "d" or k == "t" or k == "r":
            i += 1
        elif k == "h":
            template()
        elif k == "p":
            if v == "(":
                i += 1
                target = 1 if expression(False) == 1 else 0
                eat(")")
            elif v == "[":
                i += 1
                target = 2
                while V[i] != "]" or K[i] != "p":
                    if V[i] == "," and K[i] == "p":
                        i += 1
                        continue
                    if V[i] == "...":
                        i += 1
                    assign(False)
                    if V[i] != ",":
                        break
                    i += 1
                eat("]")
            elif v == "{":
                object_()
                target = 2
            elif v == "+" or v == "-" or v == "!" or v == "~":
                i += 1
                operand()
                return 0
            elif v == "++" or v == "--":
                i += 1
                if operand() != 1:
                    fail("no target of ++ or --,")
                return 0
            elif v == "@":
                while V[i] == "@":
                    decorator()
                class_(False)
            elif v == "<" and types:
                i += 1
                type_()
                gt()
                operand()
                return 0
            else:
                fail()
        else:
            fail()
        while True:
            v = V[i]
            k = K[i]
            if k == "p":
                if v == ".":
                    i += 1
                    if K[i] != "n":
                        fail("expected a name, found")
                    i += 1
                    target = 1
                elif v == "(":
                    arguments()
                    target = 0
                elif v == "[":
                    i += 1
                    expression(False)
                    eat("]")
                    target = 1
                elif v == "?.":
                    i += 1
                    if K[i] == "n":
                        i += 1
                    elif V[i] == "(":
                        arguments()
                    elif V[i] == "[":
                        i += 1
                        expression(False)
                        eat("]")
                    else:
                        fail()
                    target = 0
                elif (v == "++" or v == "--") and not NL[i]:
                    if target != 1:
                        fail("no target of")
                    i += 1
                    return 0
                elif types and v == "!" and not NL[i]:
                    i += 1
                elif types and v == "<" and target and generic_call():
                    target = 0
                else:
                    return target
            elif k == "t":
                i += 1
                target = 0
            elif k == "h":
                template()
                target = 0
            else:
                return target

    def assign(no_in: bool) -> int:
        """An assignment expression; the value is that of operand()."""
        nonlocal i
        k, v = K[i], V[i]
        if k == "n":
            if V[i + 1] == "=>" and v not in _HARD and K[i + 1] == "p":
                i += 1
                arrow_body(no_in)
                return 0
            if v == "async" and not NL[i + 1]:
                if K[i + 1] == "n" and V[i + 2] == "=>":
                    i += 2
                    arrow_body(no_in)
                    return 0
                if V[i + 1] == "(" and paren_arrow(i + 1) or types and V[i + 1] == "<":
                    i += 1
                    signature()
                    arrow_body(no_in)
                    return 0
            elif v == "yield" and depth_fn:
                i += 1
                if V[i] == "*":
                    i += 1
                    assign(no_in)
                elif not NL[i] and V[i] not in (")", "]", "}", ",", ";", ":") and K[i] != "$":
                    assign(no_in)
                return 0
        elif k == "p":
            if v == "(" and paren_arrow(i):
                signature()
                arrow_body(no_in)
                return 0
            if v == "<" and types:
                keep, values = i, list(V[i : i + 64])
                try:
                    signature()
                    if V[i] == "=>":
                        arrow_body(no_in)
                        return 0
                except (SyntaxFault, IndexError):
                    pass
                V[keep : keep + len(values)] = values
                i = keep
        target = operand()
        v = V[i]
        if v in _ASSIGN and K[i] == "p":
            if target == 0 or (target == 2 and v != "="):
                fail("no target of")
            i += 1
            assign(no_in)
            return 0
        mixed = 0
        while True:
            k = K[i]
            if (k == "p" or (k == "n" and (v == "in" or v == "instanceof"))) and v in _BINARY:
                if v == "in" and no_in:
                    return target
                if v == "??":
                    mixed |= 1
                elif v == "&&" or v == "||":
                    mixed |= 2
                if mixed == 3:
                    fail("?? mixed with")
                i += 1
                operand()
                target = 0
            elif types and k == "n" and (v == "as" or v == "satisfies") and not NL[i]:
                i += 1
                if V[i] == "const":
                    i += 1
                else:
                    type_()
            else:
                break
            v = V[i]
        if v == "?" and K[i] == "p":
            i += 1
            assign(False)
            eat(":")
            assign(no_in)
            return 0
        if v in _ASSIGN and K[i] == "p" and target != 1:
            fail("no target of")
        elif v in _ASSIGN and K[i] == "p":
            i += 1
            assign(no_in)
            return 0
        return target

    def expression(no_in: bool) -> int:
        nonlocal i
        target = assign(no_in)
        while V[i] == "," and K[i] == "p":
            i += 1
            assign(no_in)
            target = 0
        return target

    # ---- statements
    def declarations(no_in: bool, constant: bool, ambient: bool = False) -> int:
        """How many declarators came, negative if one had an initialiser."""
        nonlocal i
        count, given = 0, False
        while True:
            pattern = V[i] in ("{", "[") and K[i] == "p"
            binding()
            if types:
                if V[i] == "!":
                    i += 1
                if V[i] == ":":
                    i += 1
                    type_()
            count += 1
            if V[i] == "=" and K[i] == "p":
                i += 1
                given = True
                assign(no_in)
            elif not (no_in or ambient) and (constant or pattern):
                fail("a declaration without a value before")
            if V[i] != "," or K[i] != "p":
                break
            i += 1
        return -count if given else count

    def block() -> None:
        nonlocal i
        eat("{")
        while V[i] != "}" or K[i] != "p":
            statement()
        i += 1

    def string() -> None:
        nonlocal i
        if K[i] != "s":
            fail("expected a string, found")
        i += 1

    def attributes() -> None:
        nonlocal i
        if V[i] in ("with", "assert") and V[i + 1] == "{" and not NL[i]:
            i += 1
            object_()

    def names(import_: bool) -> None:
        nonlocal i
        eat("{")
        while V[i] != "}":
            if types and V[i] == "type" and K[i + 1] == "n" and not (V[i + 1] == "as" and V[i + 2] in ("as", ",", "}")):
                i += 1
            if K[i] not in "ns":
                fail()
            plain = is_name(i)
            i += 1
            if V[i] == "as" and K[i] == "n":
                i += 1
                if import_:
                    name()
                elif K[i] in "ns":
                    i += 1
                else:
                    fail()
            elif import_ and not plain:
                fail()
            if V[i] != ",":
                break
            i += 1
        eat("}")

    def import_() -> None:
        nonlocal i
        eat("import")
        if K[i] == "s":
            i += 1
            attributes()
            end()
            return
        if types and V[i] == "type" and (V[i + 1] in ("{", "*") or (K[i + 1] == "n" and V[i + 1] != "from")):
            i += 1
        if types and is_name(i) and V[i + 1] == "=":
            i += 2
            expression(False)
            end()
            return
        more = True
        if is_name(i):
            i += 1
            more = V[i] == ","
            if more:
                i += 1
        if more:
            if V[i] == "*":
                i += 1
                eat("as")
                name()
            else:
                names(True)
        eat("from")
        string()
        attributes()
        end()

    def export() -> None:
        nonlocal i
        eat("export")
        v = V[i]
        if types and v == "type" and V[i + 1] in ("{", "*"):
            i += 1
            v = V[i]
        if v == "*":
            i += 1
            if V[i] == "as":
                i += 1
                if K[i] not in "ns":
                    fail()
                i += 1
            eat("from")
            string()
            attributes()
            end()
        elif v == "{":
            names(False)
            if V[i] == "from":
                i += 1
                string()
                attributes()
            end()
        elif v == "default":
            i += 1
            if V[i] == "async" and V[i + 1] == "function" and not NL[i + 1]:
                i += 1
            if V[i] == "function":
                function(False)
            elif V[i] == "class" or V[i] == "@":
                while V[i] == "@":
                    decorator()
                class_(False)
            elif types and V[i] == "abstract" and V[i + 1] == "class":
                i += 1
                class_(False)
            elif types and V[i] == "interface":
                statement()
            else:
                assign(False)
                end()
        elif types and v == "=":
            i += 1
            assign(False)
            end()
        elif types and v == "as" and V[i + 1] == "namespace":
            i += 2
            name()
            end()
        elif v in ("var", "let", "const", "function", "class", "async", "@") or (types and v in ("interface", "type", "enum", "declare", "abstract", "namespace", "module", "import")):
            statement()
        else:
            fail()

    def for_() -> None:
        nonlocal i
        eat("for")
        if V[i] == "await":
            i += 1
        eat("(")
        v = V[i]
        if v == ";" and K[i] == "p":
            count = 9
        elif v in ("var", "const") or (v == "let" and (K[i + 1] == "n" or V[i + 1] in ("{", "["))):
            i += 1
            count = declarations(True, v == "const")
        else:
            count = 1 if expression(True) else 9
        if count == 1 and V[i] in ("of", "in") and K[i] == "n":
            of = V[i] == "of"
            i += 1
            if of:
                assign(False)
            else:
                expression(False)
        else:
            eat(";")
            if V[i] != ";":
                expression(False)
            eat(";")
            if V[i] != ")":
                expression(False)
        eat(")")
        statement()

    def typed_statement(v: str) -> bool:
        """A statement that only TypeScript has; whether there was one."""
        nonlocal i
        nxt = i + 1
        if NL[nxt] and v != "abstract":
            return False
        if v == "interface" and is_name(nxt):
            i += 2
            if V[i] == "<":
                type_params()
            if V[i] == "extends":
                i += 1
                type_postfix()
                while V[i] == ",":
                    i += 1
                    type_postfix()
            type_members()
            return True
        if v == "type" and is_name(nxt):
            i += 2
            if V[i] == "<":
                type_params()
            eat("=")
            type_()
            end()
            return True
        if v == "enum" and is_name(nxt):
            i += 2
            eat("{")
            while V[i] != "}":
                if K[i] in "ns":
                    i += 1
                else:
                    key()
                if V[i] == "=":
                    i += 1
                    assign(False)
                if V[i] != ",":
                    break
                i += 1
            eat("}")
            return True
        if v in ("namespace", "module", "global") and (K[nxt] in "ns" or (v == "global" and V[nxt] == "{")):
            i += 1
            if v != "global":
                i += 1
                while V[i] == ".":
                    i += 1
                    name()
            if V[i] == "{":
                block()
            else:
                end()
            return True
        if v == "declare" and K[nxt] == "n":
            i += 1
            v = V[i]
            if v in ("var", "let", "const") and V[i + 1] != "enum":
                i += 1
                declarations(False, False, True)
                end()
            else:
                statement()
            return True
        if v == "abstract" and V[nxt] == "class":
            i += 1
            class_(True)
            return True
        return False

    def statement() -> None:
        nonlocal i
        k, v = K[i], V[i]
        if k == "n":
            if v == "const" or v == "var" or (v == "let" and (K[i + 1] == "n" or V[i + 1] in ("{", "["))):
                if types and v == "const" and V[i + 1] == "enum":
                    i += 1
                    typed_statement("enum")
                    return
                i += 1
                declarations(False, v == "const")
                end()
                return
            if v == "if":
                i += 1
                eat("(")
                expression(False)
                eat(")")
                statement()
                if V[i] == "else" and K[i] == "n":
                    i += 1
                    statement()
                return
            if v == "return":
                if not depth_fn:
                    fail("outside a function,")
                i += 1
                if not (NL[i] or V[i] in (";", "}") and K[i] == "p"):
                    expression(False)
                end()
                return
            if v == "for":
                for_()
                return
            if v == "function" or (v == "async" and V[i + 1] == "function" and not NL[i + 1]):
                if v == "async":
                    i += 1
                function(True)
                return
            if v == "class":
                class_(True)
                return
            if v == "import" and V[i + 1] not in ("(", "."):
                import_()
                return
            if v == "export":
                export()
                return
            if v == "switch":
                i += 1
                eat("(")
                expression(False)
                eat(")")
                eat("{")
                while V[i] != "}" or K[i] != "p":
                    if V[i] == "case" and K[i] == "n":
                        i += 1
                        expression(False)
                    else:
                        eat("default")
                    eat(":")
                    while not (V[i] in ("case", "default") and K[i] == "n" or V[i] == "}" and K[i] == "p"):
                        statement()
                i += 1
                return
            if v == "try":
                i += 1
                block()
                caught = False
                if V[i] == "catch":
                    caught = True
                    i += 1
                    if V[i] == "(":
                        i += 1
                        binding()
                        if types and V[i] == ":":
                            i += 1
                            type_()
                        eat(")")
                    block()
                if V[i] == "finally":
                    caught = True
                    i += 1
                    block()
                if not caught:
                    fail("expected catch or finally, found")
                return
            if v == "while":
                i += 1
                eat("(")
                expression(False)
                eat(")")
                statement()
                return
            if v == "do":
                i += 1
                statement()
                eat("while")
                eat("(")
                expression(False)
                eat(")")
                if V[i] == ";":
                    i += 1
                return
            if v == "throw":
                i += 1
                if NL[i]:
                    fail()
                expression(False)
                end()
                return
            if v == "break" or v == "continue":
                i += 1
                if is_name(i) and not NL[i]:
                    i += 1
                end()
                return
            if v == "debugger":
                i += 1
                end()
                return
            if types and K[i + 1] in "nsp" and typed_statement(v):
                return
            if V[i + 1] == ":" and K[i + 1] == "p" and v not in _HARD:
                i += 2
                statement()
                return
        elif k == "p":
            if v == "{":
                block()
                return
            if v == ";":
                i += 1
                return
            if v == "@":
                while V[i] == "@":
                    decorator()
                if V[i] == "export":
                    export()
                elif types and V[i] == "abstract":
                    typed_statement("abstract")
                else:
                    class_(True)
                return
        expression(False)
        end()

    try:
        while K[i] != "$":
            statement()
    except IndexError:
        raise SyntaxFault("unexpected end") from None
