"""Recogniser for Go source files, written from the public language specification."""

from __future__ import annotations

import re

from .js import SyntaxFault

_SKIP = re.compile(r"[ \t\r]+")
_TOKEN = re.compile(
    r"""(//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)
    |([^\W\d]\w*)
    |("(?:[^"\\\n]|\\.)*"|`[^`]*`|'(?:[^'\\\n]|\\(?:[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[abfnrtv\\'"]))')
    |((?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+(?![\d.eE])|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?(?!\w))
    |(<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[{}()\[\];,<>+\-*/%&|^!~:=.])
    |(\n)""",
    re.X,
)
# The keywords of the language.
KEYWORDS = frozenset(
    """break case chan const continue default defer else fallthrough for func go goto if import interface map package
    range return select struct switch type var""".split()
)
_ENDS = frozenset("break continue fallthrough return ++ -- ) ] }".split())
_BINARY = frozenset("|| && == != < <= > >= + - | ^ * / % << >> & &^".split())
_ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
_CLOSE = {")": "(", "]": "[", "}": "{"}


def tokens(src: str):
    """(kinds, values, matching bracket) with the semicolons that line ends stand for."""
    kinds: list[str] = []
    vals: list[str] = []
    match: list[int] = []
    stack: list[int] = []

    def add(k: str, v: str) -> None:
        kinds.append(k)
        vals.append(v)
        match.append(-1)

    def newline() -> None:
        if kinds and (kinds[-1] in "nsd" and vals[-1] not in KEYWORDS or vals[-1] in _ENDS and kinds[-1] in "np"):
            add("p", ";")

    pos, n = 0, len(src)
    if src[:1] == "﻿":
        pos = 1
    while pos < n:
        m = _SKIP.match(src, pos)
        if m:
            pos = m.end()
            if pos >= n:
                break
        m = _TOKEN.match(src, pos)
        if m is None:
            raise SyntaxFault(f"character at {pos}")
        k, v = m.lastindex, m.group()
        pos = m.end()
        if k == 2:
            add("n", v)
        elif k == 5:
            if v in "([{":
                stack.append(len(kinds))
            elif v in ")]}":
                if not stack or vals[stack[-1]] != _CLOSE[v]:
                    raise SyntaxFault(f"unmatched {v} at {pos}")
                match[stack.pop()] = len(kinds)
            add("p", v)
        elif k == 3:
            add("s", v)
        elif k == 4:
            add("d", v)
        elif k == 6:
            newline()
        elif "\n" in v:
            newline()
    newline()
    if stack:
        raise SyntaxFault(f"unclosed {vals[stack[-1]]}")
    for _ in range(3):
        add("$", "")
    return kinds, vals, match


def recognise(src: str) -> None:
    """Raise SyntaxFault unless src is a Go source file."""
    K, V, M = tokens(src)
    i = 0
    level = 0  # below 0: in the header of a statement, where { opens its block

    def fail(what: str = "") -> None:
        raise SyntaxFault(f"{what or 'unexpected'} {V[i]!r} at token {i}")

    def eat(v: str) -> None:
        nonlocal i
        if V[i] != v or K[i] == "s":
            fail(f"expected {v}, found")
        i += 1

    def semi() -> None:
        nonlocal i
        if V[i] == ";":
            i += 1
        elif V[i] not in (")", "}"):
            fail("expected the end of the statement, found")

    def name() -> None:
        nonlocal i
        if K[i] != "n" or V[i] in KEYWORDS:
            fail("expected a name, found")
        i += 1

    def string() -> None:
        nonlocal i
        if K[i] != "s" or V[i][0] == "'":
            fail("expected a string, found")
        i += 1

    def starts_type(at: int) -> bool:
        v = V[at]
        if K[at] == "n":
            return v not in KEYWORDS or v in ("func", "map", "chan", "struct", "interface")
        return K[at] == "p" and v in ("*", "[", "(", "<-")

    def type_() -> None:
        nonlocal i
        v = V[i]
        if K[i] == "n":
            if v not in KEYWORDS:
                i += 1
                if V[i] == ".":
                    i += 1
                    name()
                if V[i] == "[" and V[i + 1] != "]":
                    i += 1
                    type_list("]")
                    eat("]")
            elif v == "func":
                i += 1
                signature()
            elif v == "map":
                i += 1
                eat("[")
                type_()
                eat("]")
                type_()
            elif v == "chan":
                i += 1
                if V[i] == "<-":
                    i += 1
                type_()
            elif v == "struct":
                struct()
            elif v == "interface":
                interface()
            else:
                fail("expected a type, found")
        elif v == "*":
            i += 1
            type_()
        elif v == "(":
            i += 1
            type_()
            eat(")")
        elif v == "[":
            i += 1
            if V[i] == "...":
                i += 1
            elif V[i] != "]":
                inner()
            eat("]")
            type_()
        elif v == "<-":
            i += 1
            if V[i] != "chan":
                fail("expected chan, found")
            i += 1
            type_()
        else:
            fail("expected a type, found")

    def type_list(close: str) -> None:
        nonlocal i
        while V[i] != close:
            type_()
            if V[i] != ",":
                break
            i += 1

    def struct() -> None:
        nonlocal i
        eat("struct")
        eat("{")
        while V[i] != "}":
            if V[i] == "*" or (K[i] == "n" and (V[i + 1] in (";", "}", ".") or K[i + 1] == "s")):
                type_()
            else:
                name()
                while V[i] == ",":
                    i += 1
                    name()
                type_()
            if K[i] == "s":
                string()
            semi()
        i += 1

    def interface() -> None:
        nonlocal i
        eat("interface")
        eat("{")
        while V[i] != "}":
            if K[i] == "n" and V[i + 1] == "(":
                name()
                signature()
            else:
                constraint()
            semi()
        i += 1

    def constraint() -> None:
        nonlocal i
        while True:
            if V[i] == "~":
                i += 1
            type_()
            if V[i] != "|":
                return
            i += 1

    def params() -> None:
        nonlocal i
        eat("(")
        while V[i] != ")":
            if V[i] == "...":
                i += 1
                type_()
            elif K[i] == "n" and V[i] not in KEYWORDS and (starts_type(i + 1) or V[i + 1] == "...") and not (V[i + 1] == "[" and V[i + 2] != "]" and not starts_type(M[i + 1] + 1)) and V[i + 1] != "(":
                i += 1
                if V[i] == "...":
                    i += 1
                type_()
            elif K[i] == "n" and V[i + 1] == "(":
                i += 1
                type_()
            else:
                type_()
            if V[i] != ",":
                break
            i += 1
        eat(")")

    def signature() -> None:
        params()
        if V[i] == "(" and K[i] == "p":
            params()
        elif starts_type(i):
            type_()

    def type_params() -> None:
        nonlocal i
        eat("[")
        while V[i] != "]":
            name()
            while V[i] == ",":
                i += 1
                name()
            constraint()
            if V[i] != ",":
                break
            i += 1
        eat("]")

    # ---- expressions
    def inner() -> None:
        nonlocal level
        keep, level = level, 0
        expression()
        level = keep

    def literal_value() -> None:
        nonlocal i, level
        keep, level = level, 0
        eat("{")
        while V[i] != "}":
            element()
            if V[i] == ":":
                i += 1
                element()
            if V[i] != ",":
                break
            i += 1
        eat("}")
        level = keep

    def element() -> None:
        if V[i] == "{" and K[i] == "p":
            literal_value()
        else:
            expression()

    def arguments() -> None:
        nonlocal i, level
        keep, level = level, 0
        eat("(")
        while V[i] != ")":
            if V[i] == "[" or (K[i] == "n" and V[i] in ("map", "chan", "struct", "interface")) or (V[i] == "*" and K[i] == "p"):
                operand_or_type()
            else:
                expression()
            if V[i] == "...":
                i += 1
            if V[i] != ",":
                break
            i += 1
        eat(")")
        level = keep

    def operand_or_type() -> None:
        nonlocal i
        at = i
        try:
            expression()
        except SyntaxFault:
            i = at
            type_()

    def expression() -> None:
        nonlocal i
        while True:
            unary()
            if K[i] == "p" and V[i] in _BINARY:
                i += 1
            else:
                return

    def unary() -> None:
        nonlocal i
        while K[i] == "p" and V[i] in ("+", "-", "!", "^", "*", "&", "<-"):
            i += 1
        literal = False
        k, v = K[i], V[i]
        if k == "n":
            if v not in KEYWORDS:
                i += 1
                literal = True
            elif v == "func":
                i += 1
                signature()
                if V[i] == "{":
                    block(True)
            elif v in ("map", "struct", "chan", "interface"):
                type_()
                literal = True
                if V[i] not in ("{", "("):
                    fail()
                if V[i] == "{":
                    literal_value()
                    literal = False
            else:
                fail()
        elif k == "s" or k == "d":
            i += 1
        elif v == "(":
            i += 1
            inner_or_type()
            eat(")")
        elif v == "[":
            type_()
            if V[i] == "{":
                literal_value()
            elif V[i] != "(":
                fail()
        else:
            fail()
        while K[i] == "p":
            v = V[i]
            if v == ".":
                i += 1
                if V[i] == "(":
                    i += 1
                    if V[i] == "type":
                        i += 1
                    else:
                        type_()
                    eat(")")
                    literal = False
                else:
                    name()
            elif v == "(":
                arguments()
                literal = False
            elif v == "[":
                index()
            elif v == "{" and literal and level >= 0:
                literal_value()
                literal = False
            else:
                return

    def inner_or_type() -> None:
        nonlocal i, level
        keep, level = level, 0
        operand_or_type()
        level = keep

    def index() -> None:
        nonlocal i, level
        keep, level = level, 0
        eat("[")
        colons = 0
        if V[i] != ":":
            operand_or_type()
        while V[i] == ",":
            i += 1
            if V[i] == "]":
                break
            type_()
        while V[i] == ":":
            colons += 1
            i += 1
            if V[i] not in (":", "]"):
                expression()
        if colons > 2:
            fail()
        eat("]")
        level = keep

    def expressions() -> int:
        nonlocal i
        count = 1
        expression()
        while V[i] == ",":
            i += 1
            expression()
            count += 1
        return count

    # ---- statements
    def block(inside: bool = False) -> None:
        nonlocal i, level
        keep, level = level, 0
        eat("{")
        while V[i] != "}":
            statement()
            semi()
        i += 1
        level = keep

    def simple() -> bool:
        """A simple statement; whether it was a range clause."""
        nonlocal i
        if V[i] == "range" and K[i] == "n":
            i += 1
            expression()
            return True
        count = expressions()
        v = V[i]
        if K[i] != "p":
            return False
        if v in _ASSIGN:
            i += 1
            if V[i] == "range" and v in ("=", ":="):
                i += 1
                expression()
                return True
            if count > 1 and v not in ("=", ":="):
                fail()
            expressions()
        elif v == "++" or v == "--":
            i += 1
        elif v == "<-":
            i += 1
            expression()
        return False

    def header(for_: bool) -> None:
        """What stands between if, for or switch and its block."""
        nonlocal i, level
        keep, level = level, -1
        ranged = False
        if V[i] != "{" and V[i] != ";":
            ranged = simple()
        if not ranged and V[i] == ";":
            i += 1
            if for_:
                if V[i] not in (";", "{"):
                    expression()
                if V[i] == ";":
                    i += 1
                    if V[i] != "{":
                        simple()
                elif V[i] != "{":
                    fail()
            elif V[i] != "{":
                simple()
        level = keep

    def clauses(select: bool) -> None:
        nonlocal i
        eat("{")
        while V[i] != "}":
            if V[i] == "default" and K[i] == "n":
                i += 1
            else:
                if V[i] != "case":
                    fail("expected case, found")
                i += 1
                if select:
                    simple()
                else:
                    operand_or_type()
                    while V[i] == ",":
                        i += 1
                        operand_or_type()
            eat(":")
            while not (V[i] == "}" or K[i] == "n" and V[i] in ("case", "default")):
                statement()
                semi()
        i += 1

    def if_() -> None:
        nonlocal i
        if V[i] == "{":
            fail("expected a condition, found")
        header(False)
        block()
        if V[i] == "else":
            i += 1
            if V[i] == "if":
                i += 1
                if_()
            else:
                block()

    def statement() -> None:
        nonlocal i
        v = V[i]
        if K[i] == "n" and v in KEYWORDS:
            if v == "if":
                i += 1
                if_()
            elif v == "for":
                i += 1
                header(True)
                block()
            elif v == "switch":
                i += 1
                header(False)
                clauses(False)
            elif v == "select":
                i += 1
                clauses(True)
            elif v == "return":
                i += 1
                if V[i] not in (";", "}"):
                    expressions()
            elif v in ("go", "defer"):
                i += 1
                expression()
                if V[i - 1] != ")":
                    fail("expected a call before")
            elif v in ("break", "continue", "goto"):
                i += 1
                if K[i] == "n":
                    name()
            elif v == "fallthrough":
                i += 1
            elif v in ("var", "const", "type"):
                declaration()
            elif v in ("func", "struct", "map", "chan", "interface"):
                simple()
            else:
                fail()
        elif v == "{":
            block()
        elif v == ";" or v == "}":
            return
        elif K[i] == "n" and V[i + 1] == ":" and K[i + 1] == "p":
            i += 2
            if V[i] != "}":
                statement()
        else:
            simple()

    def group(one) -> None:
        nonlocal i
        if V[i] == "(":
            i += 1
            while V[i] != ")":
                one()
                semi()
            i += 1
        else:
            one()

    def value_spec() -> None:
        nonlocal i
        name()
        while V[i] == ",":
            i += 1
            name()
        if V[i] not in ("=", ";", ")"):
            type_()
        if V[i] == "=":
            i += 1
            expressions()

    def var_spec() -> None:
        at = i
        value_spec()
        if V[i - 1] != ")" and i - at < 2:
            fail("expected a type, found")

    def type_spec() -> None:
        nonlocal i
        name()
        if V[i] == "[" and K[i + 1] == "n" and V[i + 1] not in KEYWORDS and (K[i + 2] == "n" or V[i + 2] in (",", "~", "*", "[", "interface")):
            type_params()
        if V[i] == "=":
            i += 1
        type_()

    def declaration() -> None:
        nonlocal i
        v = V[i]
        i += 1
        group({"var": var_spec, "const": value_spec, "type": type_spec}[v])

    def import_spec() -> None:
        nonlocal i
        if V[i] == "." or (K[i] == "n"):
            i += 1
        string()

    try:
        while V[i] == ";":
            i += 1
        if V[i] != "package":
            fail("expected package, found")
        i += 1
        name()
        semi()
        while V[i] == "import":
            i += 1
            group(import_spec)
            semi()
        while K[i] != "$":
            v = V[i]
            if v == "func" and K[i] == "n":
                i += 1
                if V[i] == "(":
                    params()
                name()
                if V[i] == "[":
                    type_params()
                signature()
                if V[i] == "{":
                    block(True)
            elif v in ("var", "const", "type") and K[i] == "n":
                declaration()
            else:
                fail("expected a declaration, found")
            if V[i] == ";":
                i += 1
            elif K[i] != "$":
                fail("expected the end of the declaration, found")
    except IndexError:
        raise SyntaxFault("unexpected end") from None
