"""Recogniser for SQL scripts: the statements of the standard and of the common dialects.

Queries, inserts, updates, deletes and table definitions are parsed fully; the long tail of
administrative statements is checked for its verb, its balanced brackets and the absence of stray
words, which is what distinguishes a statement from prose.
"""

from __future__ import annotations

import re

from .js import SyntaxFault

_SKIP = re.compile(r"(?:\s+|--[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)+")
_TOKEN = re.compile(
    r"""((?:[eEnNbBxX](?='))?'(?:[^']|'')*'|\$(\w*)\$(?s:.*?)\$\2\$)
    |("(?:[^"]|"")+"|`[^`]+`)
    |([^\W\d]\w*\$?\w*|@@?\w+)
    |((?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?(?!\w)|\$\d+|\?|:[A-Za-z_]\w*|0[xX][0-9a-fA-F]+)
    |(::|<=>|<=|>=|<>|!=|\|\||->>|->|\#>>|\#>|@>|<@|!~\*|!~|~\*|&&|:=|=>|[(),;.*+\-/%<>=~^&|\[\]!@#:{}])""",
    re.X,
)
# Words that end an operand or a list, hence are no aliases.
STOP = frozenset(
    """select from where group having order limit offset fetch union intersect except on using join inner left right full
    cross natural outer and or not in is like ilike between when then else end as set values returning window for
    with asc desc nulls case insert into update delete create by distinct into primary references check unique
    default constraint foreign collate exists any all some qualify over filter within lateral tablesample
    similar escape isnull notnull""".split()
)
_VERBS = frozenset(
    """alter drop truncate grant revoke begin commit rollback start savepoint release set show use explain analyze vacuum
    comment lock copy call execute prepare deallocate declare fetch close open do pragma attach detach describe desc
    refresh reindex cluster discard listen notify unlisten reset checkpoint load merge replace optimize end""".split()
)
_COMPARE = frozenset("= <> != < > <= >= <=> || + - * / % ^ & | ~ !~ ~* !~* -> ->> #> #>> @> <@ && := # @".split())


# What no administrative statement ends in.
_UNFINISHED = frozenset("add column constraint rename set to by on as table references using with , = .".split())


def tokens(src: str):
    kinds: list[str] = []
    vals: list[str] = []
    pos, n = 0, len(src)
    if src[:1] == "﻿":
        pos = 1
    while True:
        m = _SKIP.match(src, pos)
        if m:
            pos = m.end()
        if pos >= n:
            break
        m = _TOKEN.match(src, pos)
        if m is None:
            raise SyntaxFault(f"character at {pos}")
        k = m.lastindex
        pos = m.end()
        v = m.group()
        if m.group(1) is not None:
            kinds.append("s")
        elif k == 3:
            kinds.append("q")
        elif k == 4:
            kinds.append("n")
            v = v.lower()
        elif k == 5:
            kinds.append("d")
        else:
            kinds.append("p")
        vals.append(v)
    kinds += ["$"] * 4
    vals += [""] * 4
    return kinds, vals


def recognise(src: str) -> None:
    """Raise SyntaxFault unless src is a sequence of SQL statements (none is fine)."""
    K, V = tokens(src)
    i = 0

    def fail(what: str = "") -> None:
        raise SyntaxFault(f"{what or 'unexpected'} {V[i]!r} at token {i}")

    def word(*ws: str) -> bool:
        return K[i] == "n" and V[i] in ws

    def take(*ws: str) -> bool:
        nonlocal i
        if K[i] == "n" and V[i] in ws:
            i += 1
            return True
        return False

    def need(w: str) -> None:
        nonlocal i
        if V[i] != w or K[i] in "sq":
            fail(f"expected {w}, found")
        i += 1

    def name() -> None:
        nonlocal i
        if not (K[i] == "q" or K[i] == "n" and V[i] not in STOP):
            fail("expected a name, found")
        i += 1

    def dotted() -> None:
        nonlocal i
        name()
        while V[i] == "." and K[i] == "p":
            i += 1
            if V[i] == "*":
                i += 1
                return
            if K[i] not in "nq":
                fail()
            i += 1

    def names() -> None:
        nonlocal i
        need("(")
        name()
        while V[i] == ",":
            i += 1
            name()
        need(")")

    def alias() -> None:
        nonlocal i
        if take("as"):
            if K[i] not in "nqs":
                fail("expected a name, found")
            i += 1
        elif K[i] == "q" or K[i] == "n" and V[i] not in STOP:
            i += 1
        else:
            return
        if V[i] == "(":
            balanced()

    def balanced() -> None:
        nonlocal i
        depth = 0
        while True:
            if K[i] == "$":
                fail("unclosed bracket before")
            if K[i] == "p":
                if V[i] in ("(", "["):
                    depth += 1
                elif V[i] in (")", "]"):
                    depth -= 1
                elif V[i] == ";":
                    fail()
            i += 1
            if depth == 0:
                return

    # ---- expressions
    def expression() -> None:
        nonlocal i
        while take("not"):
            pass
        operand()
        while True:
            v = V[i]
            if K[i] == "p":
                if v in _COMPARE:
                    i += 1
                    while V[i] in ("-", "+") and K[i] == "p":
                        i += 1
                    if word("any", "all", "some"):
                        i += 1
                        need("(")
                        query_or_list()
                        need(")")
                    else:
                        while take("not"):
                            pass
                        operand()
                else:
                    return
            elif K[i] == "n":
                if v == "and" or v == "or":
                    i += 1
                    while take("not"):
                        pass
                    operand()
                elif v == "is":
                    i += 1
                    take("not")
                    if take("distinct"):
                        need("from")
                        operand()
                    elif not take("null", "true", "false", "unknown", "json", "document"):
                        fail()
                elif v in ("isnull", "notnull"):
                    i += 1
                elif v in ("not", "in", "like", "ilike", "between", "similar", "rlike", "regexp"):
                    take("not")
                    if take("in"):
                        need("(")
                        query_or_list()
                        need(")")
                    elif take("between"):
                        take("symmetric")
                        simple()
                        need("and")
                        simple()
                    elif take("like", "ilike", "rlike", "regexp") or (word("similar") and V[i + 1] == "to"):
                        if take("similar"):
                            i += 1
                        if take("any", "all"):
                            balanced()
                        else:
                            simple()
                        if take("escape"):
                            operand()
                    else:
                        fail()
                elif v == "collate":
                    i += 1
                    dotted()
                elif v == "at" and V[i + 1] == "time":
                    i += 2
                    need("zone")
                    operand()
                else:
                    return
            else:
                return

    def simple() -> None:
        nonlocal i
        operand()
        while K[i] == "p" and V[i] in ("+", "-", "*", "/", "%", "||"):
            i += 1
            operand()

    def query_or_list() -> None:
        nonlocal i
        if word("select", "with", "values"):
            query()
            return
        if V[i] == ")":
            return
        expression()
        while V[i] == ",":
            i += 1
            expression()

    def type_name() -> None:
        nonlocal i
        name()
        while V[i] == "." or (K[i] == "n" and V[i] in ("precision", "varying", "unsigned", "zone", "time") or word("with", "without") and V[i + 1] in ("time", "local")):
            i += 1
        if V[i] == "(":
            balanced()
        if word("with", "without") and V[i + 1] in ("time", "local"):
            while K[i] == "n" and V[i] in ("with", "without", "local", "time", "zone"):
                i += 1
        while V[i] == "[" or word("array"):
            if take("array"):
                continue
            balanced()

    def operand() -> None:
        nonlocal i
        k, v = K[i], V[i]
        if k == "s":
            i += 1
            while K[i] == "s":
                i += 1
        elif k == "d":
            i += 1
        elif k == "p":
            if v == "(":
                i += 1
                query_or_list()
                need(")")
            elif v in ("-", "+", "~", "@"):
                i += 1
                operand()
                return
            elif v == "*":
                i += 1
            else:
                fail()
        elif k == "n":
            if v == "case":
                i += 1
                if not word("when"):
                    expression()
                if not word("when"):
                    fail("expected when, found")
                while take("when"):
                    expression()
                    need("then")
                    expression()
                if take("else"):
                    expression()
                need("end")
            elif v in ("exists", "all", "any", "some") and V[i + 1] == "(":
                i += 2
                query_or_list()
                need(")")
            elif v in ("cast", "try_cast") and V[i + 1] == "(":
                i += 2
                expression()
                need("as")
                type_name()
                need(")")
            elif v in ("extract", "position", "overlay", "trim", "substring") and V[i + 1] == "(":
                i += 1
                balanced()
            elif v in ("interval", "date", "timestamp", "time", "timestamptz") and K[i + 1] == "s":
                i += 2
                if word("year", "month", "day", "hour", "minute", "second"):
                    i += 1
                    if take("to"):
                        i += 1
            elif v == "array" and V[i + 1] == "[":
                i += 1
                balanced()
            elif v == "row" and V[i + 1] == "(":
                i += 1
                balanced()
            elif v == "distinct":
                fail()
            elif v in ("left", "right", "replace", "values", "default", "set") and (V[i + 1] == "(" or v == "default"):
                i += 1
                if V[i] == "(":
                    call()
            elif v in STOP:
                fail()
            else:
                dotted()
                if V[i] == "(":
                    call()
        elif k == "q":
            dotted()
            if V[i] == "(":
                call()
        else:
            fail()
        while K[i] == "p":
            if V[i] == "::":
                i += 1
                type_name()
            elif V[i] == "[":
                balanced()
            elif V[i] == "." and K[i + 1] in "nq":
                i += 2
            else:
                return

    def call() -> None:
        nonlocal i
        need("(")
        take("distinct", "all")
        if word("select", "with"):
            query()
        elif V[i] != ")":
            while True:
                expression()
                if V[i] == "=>":
                    i += 1
                    expression()
                if V[i] != ",":
                    break
                i += 1
            if take("order"):
                order_list()
            if take("separator"):
                operand()
            if take("ignore", "respect"):
                need("nulls")
        need(")")
        if take("within"):
            need("group")
            balanced()
        if take("filter"):
            balanced()
        if take("over"):
            if V[i] == "(":
                balanced()
            else:
                name()

    def order_list() -> None:
        nonlocal i
        need("by")
        while True:
            expression()
            take("asc", "desc")
            if take("nulls"):
                if not take("first", "last"):
                    fail()
            if V[i] != ",":
                return
            i += 1

    # ---- queries
    def relation() -> None:
        nonlocal i
        take("lateral", "only")
        if V[i] == "(":
            i += 1
            if word("select", "with", "values"):
                query()
            elif V[i] == "(":
                query_or_relations()
            else:
                relations()
            need(")")
        else:
            dotted()
            if V[i] == "(":
                call()
        if take("tablesample"):
            name()
            balanced()
        alias()

    def query_or_relations() -> None:
        nonlocal i
        keep = i
        try:
            query()
        except SyntaxFault:
            i = keep
            relations()

    def relations() -> None:
        nonlocal i
        while True:
            relation()
            while True:
                cross = natural = False
                keep = i
                if take("natural"):
                    natural = True
                if take("cross"):
                    cross = True
                elif take("inner"):
                    pass
                elif take("left", "right", "full"):
                    take("outer")
                    take("semi", "anti")
                if not take("join"):
                    if i != keep:
                        fail("expected join, found")
                    break
                relation()
                if take("on"):
                    expression()
                elif take("using"):
                    names()
                elif not (cross or natural):
                    fail("expected on, found")
            if V[i] != "," or K[i] != "p":
                return
            i += 1

    def select() -> None:
        nonlocal i
        need("select")
        if take("distinct"):
            if take("on"):
                balanced()
        else:
            take("all")
        if take("top"):
            operand()
        while True:
            if V[i] == "*":
                i += 1
                if take("except", "exclude", "replace"):
                    balanced()
            else:
                expression()
                alias()
            if V[i] != ",":
                break
            i += 1
        if take("into"):
            dotted()
        if take("from"):
            relations()
        if take("where"):
            expression()
        if take("group"):
            need("by")
            if not take("all"):
                while True:
                    if word("rollup", "cube") and V[i + 1] == "(":
                        i += 1
                        balanced()
                    elif word("grouping") and V[i + 1] == "sets":
                        i += 2
                        balanced()
                    else:
                        expression()
                    if V[i] != ",":
                        break
                    i += 1
        if take("having"):
            expression()
        if take("qualify"):
            expression()
        if take("window"):
            while True:
                name()
                need("as")
                balanced()
                if V[i] != ",":
                    break
                i += 1

    def values() -> None:
        nonlocal i
        need("values")
        while True:
            if V[i] != "(":
                fail("expected (, found")
            i += 1
            while True:
                expression()
                if V[i] != ",":
                    break
                i += 1
            need(")")
            if V[i] != ",":
                return
            i += 1

    def body() -> None:
        nonlocal i
        if V[i] == "(":
            i += 1
            query()
            need(")")
        elif word("values"):
            values()
        elif word("table"):
            i += 1
            dotted()
        else:
            select()

    def with_() -> None:
        nonlocal i
        if take("with"):
            take("recursive")
            while True:
                name()
                if V[i] == "(":
                    names()
                need("as")
                if take("not"):
                    pass
                take("materialized")
                need("(")
                if word("insert", "update", "delete"):
                    statement()
                else:
                    query()
                need(")")
                if V[i] != ",":
                    break
                i += 1

    def query() -> None:
        nonlocal i
        with_()
        body()
        while take("union", "intersect", "except", "minus"):
            take("all", "distinct")
            if take("by"):
                need("name")
            body()
        if take("order"):
            order_list()
        while True:
            if take("limit"):
                if not take("all"):
                    expression()
                if V[i] == ",":
                    i += 1
                    expression()
            elif take("offset"):
                expression()
                take("row", "rows")
            elif take("fetch"):
                take("first", "next")
                if K[i] == "d":
                    i += 1
                take("row", "rows")
                take("only")
            elif take("for"):
                while K[i] == "n":
                    i += 1
            else:
                return

    # ---- statements
    def returning() -> None:
        nonlocal i
        if take("returning"):
            while True:
                expression()
                alias()
                if V[i] != ",":
                    return
                i += 1

    def sets() -> None:
        nonlocal i
        need("set")
        while True:
            if V[i] == "(":
                names()
            else:
                dotted()
            if V[i] not in ("=", ":="):
                fail("expected =, found")
            i += 1
            expression()
            if V[i] != ",":
                return
            i += 1

    def insert() -> None:
        nonlocal i
        i += 1
        if take("or"):
            i += 1
        take("ignore")
        if not take("into", "overwrite"):
            fail("expected into, found")
        take("table")
        dotted()
        if take("as"):
            name()
        if V[i] == "(" and not (K[i + 1] == "n" and V[i + 1] in ("select", "with")):
            names()
        if take("default"):
            need("values")
        else:
            query()
        if take("on"):
            if take("conflict"):
                if V[i] == "(":
                    balanced()
                    if take("where"):
                        expression()
                elif take("on"):
                    need("constraint")
                    name()
                need("do")
                if not take("nothing"):
                    need("update")
                    sets()
                    if take("where"):
                        expression()
            else:
                need("duplicate")
                i += 1
                need("update")
                i -= 1
                V[i] = "set"
                sets()
        returning()

    def constraint_tail() -> None:
        nonlocal i
        while True:
            if take("constraint"):
                name()
            elif take("not"):
                if not take("null", "deferrable", "valid"):
                    fail()
            elif take("null", "unique", "auto_increment", "autoincrement", "deferrable", "stored", "virtual", "asc", "desc", "enable", "disable"):
                pass
            elif take("primary"):
                need("key")
                take("asc", "desc")
                take("autoincrement")
            elif take("default"):
                simple()
            elif take("initially"):
                i += 1
            elif take("check"):
                need("(")
                expression()
                need(")")
            elif take("references"):
                dotted()
                if V[i] == "(":
                    names()
                while word("on", "match"):
                    if take("match"):
                        i += 1
                    else:
                        i += 1
                        if not take("delete", "update"):
                            fail()
                        if take("set"):
                            if not take("null", "default"):
                                fail()
                        elif take("no"):
                            need("action")
                        elif not take("cascade", "restrict"):
                            fail()
            elif take("generated"):
                if take("by"):
                    need("default")
                else:
                    take("always")
                need("as")
                if take("identity"):
                    if V[i] == "(":
                        balanced()
                else:
                    balanced()
            elif take("identity"):
                if V[i] == "(":
                    balanced()
            elif take("collate"):
                dotted()
            elif take("comment"):
                operand()
            elif take("on"):
                need("update")
                operand()
            else:
                return

    def table_element() -> None:
        nonlocal i
        if word("constraint"):
            i += 1
            name()
        if take("primary"):
            need("key")
            balanced()
            constraint_tail()
        elif word("unique") and V[i + 1] in ("(", "key", "index"):
            while not V[i] == "(":
                i += 1
                if K[i] == "$":
                    fail()
            balanced()
            constraint_tail()
        elif take("foreign"):
            need("key")
            if V[i] != "(":
                name()
            balanced()
            constraint_tail()
        elif word("check"):
            constraint_tail()
        elif take("exclude"):
            if take("using"):
                name()
            balanced()
        elif take("like"):
            dotted()
            while take("including", "excluding"):
                i += 1
        elif word("key", "index") and K[i + 1] in "nq" and V[i + 2] == "(":
            i += 2
            balanced()
        else:
            name()
            type_name()
            constraint_tail()

    def create() -> None:
        nonlocal i
        need("create")
        if take("or"):
            need("replace")
        while take("temp", "temporary", "unlogged", "global", "local", "external", "unique", "materialized", "recursive", "transient", "foreign"):
            pass
        if take("table"):
            if take("if"):
                need("not")
                need("exists")
            dotted()
            if V[i] == "(":
                i += 1
                while True:
                    table_element()
                    if V[i] != ",":
                        break
                    i += 1
                need(")")
            elif not word("as", "partition", "of", "like", "using"):
                fail("expected (, found")
            while K[i] != "$" and V[i] != ";":
                if take("as"):
                    query()
                    if take("with"):
                        rest()
                elif V[i] == "(":
                    balanced()
                elif K[i] in "nsdq" or V[i] in ("=", ",", "."):
                    if word("select", "insert", "create", "update", "delete"):
                        fail()
                    i += 1
                else:
                    fail()
        elif take("view"):
            if take("if"):
                need("not")
                need("exists")
            dotted()
            if V[i] == "(":
                names()
            while not word("as"):
                if K[i] == "$" or V[i] == ";":
                    fail("expected as, found")
                i += 1
            i += 1
            query()
            if take("with"):
                rest()
        elif take("index"):
            take("concurrently")
            if take("if"):
                need("not")
                need("exists")
            if not word("on"):
                dotted()
            need("on")
            take("only")
            dotted()
            if take("using"):
                name()
            balanced()
            if take("include"):
                balanced()
            if take("with"):
                balanced()
            if take("where"):
                expression()
        elif word("function", "procedure", "trigger", "type", "schema", "sequence", "extension", "role", "user", "database", "domain", "policy", "rule", "aggregate", "operator", "cast", "collation", "statistics", "publication", "subscription", "server", "language", "event", "conversion", "macro", "group", "tablespace", "virtual"):
            i += 1
            if K[i] not in "nq" and V[i] != "(":
                fail("expected a name, found")
            rest()
        else:
            fail()

    def rest() -> None:
        """The rest of an administrative statement: balanced, without a second verb."""
        nonlocal i
        while K[i] != "$" and V[i] != ";":
            if V[i] in ("(", "["):
                balanced()
            elif V[i] in (")", "]", "{", "}"):
                fail()
            else:
                i += 1
        if V[i - 1].lower() in _UNFINISHED and K[i - 1] in "np":
            fail("unfinished statement before")

    def alter() -> None:
        nonlocal i
        i += 1
        if not word("table", "role", "user", "view", "index", "sequence", "schema", "database", "type", "function", "procedure", "domain", "extension", "default", "policy", "materialized", "foreign", "system", "session", "column", "group", "publication", "server", "trigger", "aggregate"):
            fail()
        i += 1
        if K[i] not in "nq":
            fail("expected a name, found")
        start = i
        rest()
        if i - start < 2:
            fail("unfinished statement before")

    def statement() -> None:
        nonlocal i
        v = V[i]
        if K[i] == "p":
            if v == "(":
                query()
                return
            fail()
        if K[i] != "n":
            fail()
        if v in ("select", "values", "table"):
            query()
        elif v == "with":
            with_()
            if word("insert", "update", "delete", "merge"):
                statement()
            else:
                body_tail()
        elif v in ("insert", "replace") and V[i + 1] in ("into", "or", "ignore", "overwrite"):
            insert()
        elif v == "update":
            i += 1
            take("only")
            dotted()
            if not word("set"):
                alias()
            sets()
            if take("from"):
                relations()
            if take("where"):
                expression()
            returning()
        elif v == "delete":
            i += 1
            need("from")
            take("only")
            dotted()
            if not word("using", "where", "returning"):
                alias()
            if take("using"):
                relations()
            if take("where"):
                expression()
            returning()
        elif v == "create":
            create()
        elif v == "alter":
            alter()
        elif v in _VERBS:
            i += 1
            if v in ("drop", "truncate", "grant", "revoke", "comment", "copy", "call", "declare", "merge", "execute", "use"):
                if K[i] not in "nq":
                    fail()
                if v == "drop" and not word("table", "view", "index", "schema", "sequence", "function", "procedure", "type", "role", "user", "database", "trigger", "extension", "materialized", "policy", "domain", "column", "constraint", "owned", "rule", "aggregate", "foreign", "server", "publication", "macro"):
                    fail()
            rest()
        else:
            fail("no statement begins with")

    def body_tail() -> None:
        query()

    while True:
        while V[i] == ";" and K[i] == "p":
            i += 1
        if K[i] == "$":
            return
        statement()
        if K[i] != "$" and not (V[i] == ";" and K[i] == "p"):
            fail("expected ;, found")
