"""Syntax trees of JavaScript, TypeScript and markup in them, for code and for patterns of code.

A tolerant recursive parser: types are passed over, a statement that cannot be
read becomes an ``error`` node and reading goes on at the next one. In patterns
``...`` stands for any number of siblings and ``$NAME`` for a piece of code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

NAME = r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*"
LEX = re.compile(
    rf"(?P<many>\$\.\.\.[A-Z_]\w*)|(?P<name>#?{NAME})|(?P<number>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?n?)"
    r"|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
    r"|(?P<mark>\.\.\.|=>|>>>=|<<=|>>=|>>>|\*\*=|\?\?=|&&=|\|\|=|===|!==|==|!=|<=|>=|\+\+|--|\*\*|&&|\|\||\?\?|\?\.(?!\d)|<<|>>|[-+*/%&|^]=|[{}()\[\];,.<>:?=+\-*/%&|^!~@`#])",
    re.S,
)
SPACE = re.compile(r"(?:[\s﻿]|//[^\n]*|/\*.*?(?:\*/|\Z))*", re.S)
REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
BINARY = {op: n for n, ops in enumerate(("??", "||", "&&", "|", "^", "&", "== != === !==", "< > <= >= in instanceof", "<< >> >>>", "+ -", "* / %", "**"), 1) for op in ops.split()}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
PREFIX = frozenset("! ~ + - ++ --".split())
CLOSE = {"(": ")", "[": "]", "{": "}"}
SEQUENCES = frozenset(("stmts", "params", "args", "array", "object", "class_body", "attrs", "children", "clauses", "var", "seq", "template", "array_pattern", "cases"))


class Node:
    """kind, value (text of leaves, operators, flags), kids (nodes or None), character range and line."""

    __slots__ = ("kind", "value", "kids", "start", "end", "line")

    def __init__(self, kind: str, value: str = "", kids: list | None = None, start: int = 0, end: int = 0, line: int = 0) -> None:
        self.kind, self.value, self.kids, self.start, self.end, self.line = kind, value, kids or [], start, end, line

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(k for k in reversed(n.kids) if k is not None)

    def __repr__(self) -> str:
        return f"{self.kind}{f':{self.value}' if self.value else ''}{self.kids or ''}"


class Unreadable(Exception):
    pass


class Parser:
    def __init__(self, source: str, typed: bool = True, markup: bool = True, pattern: bool = False) -> None:
        self.source, self.typed, self.markup, self.pattern = source, typed, markup, pattern
        self.breaks = [m.start() for m in re.finditer("\n", source)]
        self.no_arrow: set[int] = set()
        self.errors = 0
        self.depth = 0
        self.end = self.after = 0
        self.seek(0)

    # --- tokens

    def line(self, at: int) -> int:
        from bisect import bisect_left

        return bisect_left(self.breaks, at) + 1

    def seek(self, at: int) -> None:
        """The token at or after ``at`` becomes the current one."""
        begin = SPACE.match(self.source, at).end()
        self.broke = "\n" in self.source[at:begin] or at == 0
        self.start = begin
        m = LEX.match(self.source, begin)
        if m:
            self.kind, self.text, self.after = m.lastgroup, m[0], m.end()
            if self.kind == "many":
                self.kind, self.text = "mark", "..."
        elif begin >= len(self.source):
            self.kind, self.text, self.after = "end", "", begin
        else:
            self.kind, self.text, self.after = "odd", self.source[begin], begin + 1

    def next(self) -> str:
        text, self.end = self.text, self.after
        self.seek(self.after)
        return text

    def state(self) -> tuple:
        return self.start, self.end, self.broke, self.kind, self.text, self.after

    def back(self, state: tuple) -> None:
        self.start, self.end, self.broke, self.kind, self.text, self.after = state

    def at(self, *marks: str) -> bool:
        return self.kind == "mark" and self.text in marks

    def word(self, *names: str) -> bool:
        return self.kind == "name" and self.text in names

    def eat(self, mark: str) -> bool:
        if self.at(mark):
            self.next()
            return True
        return False

    def want(self, mark: str) -> None:
        if not self.eat(mark):
            raise Unreadable(f"{mark} at {self.start}")

    def node(self, kind: str, start: int, value: str = "", kids: list | None = None) -> Node:
        return Node(kind, value, kids, start, max(self.end, start), self.line(start))

    def ahead(self) -> tuple[str, str, bool]:
        """Kind, text and line break of the token after this one."""
        here = self.state()
        self.next()
        found = self.kind, self.text, self.broke
        self.back(here)
        return found

    # --- types are passed over

    def skip_group(self) -> None:
        stack = []
        while self.kind != "end":
            if self.kind == "mark" and self.text in CLOSE:
                stack.append(CLOSE[self.text])
            elif self.at("`"):
                self.template()
                continue
            elif self.kind == "mark" and stack and self.text == stack[-1]:
                stack.pop()
                if not stack:
                    self.next()
                    return
            self.next()
        raise Unreadable("group")

    def skip_angles(self) -> None:
        depth = 0
        while self.kind != "end":
            if self.at("<"):
                depth += 1
            elif self.at(">", ">>", ">>>"):
                depth -= len(self.text)
                if depth <= 0:
                    self.next()
                    return
            elif self.at("(", "[", "{"):
                self.skip_group()
                continue
            elif self.at(";", ")", "]", "}"):
                break
            self.next()
        raise Unreadable("angles")

    def skip_type(self) -> None:
        while self.at("|", "&"):
            self.next()
        while True:
            while self.word("keyof", "typeof", "readonly", "infer", "unique", "asserts", "new", "abstract") and self.ahead()[0] != "end" and not (self.ahead()[0] == "mark" and self.ahead()[1] in (",", ")", ">", ";", "=", "|", "&")):
                self.next()
            if self.at("<"):
                self.skip_angles()
            if self.at("("):
                self.skip_group()
                if self.eat("=>"):
                    self.skip_type()
                    return
            elif self.at("{", "["):
                self.skip_group()
            elif self.at("`"):
                self.template()
            elif self.at("-"):
                self.next()
                continue
            elif self.kind in ("name", "string", "number"):
                self.next()
                while self.at(".") or self.at("<") or (self.word("is") and not self.broke):
                    if self.at("<"):
                        self.skip_angles()
                    elif self.word("is"):
                        self.next()
                        self.skip_type()
                    else:
                        self.next()
                        if self.kind == "name":
                            self.next()
            elif self.at("..."):
                self.next()
            else:
                raise Unreadable(f"type at {self.start}")
            while self.at("[") and not self.broke:
                self.skip_group()
            if self.word("extends") and not self.broke:
                self.next()
                self.skip_type()
                if self.eat("?"):
                    self.skip_type()
                    self.want(":")
                    self.skip_type()
                return
            if self.at("|", "&"):
                self.next()
                continue
            return

    def annotation(self) -> None:
        if self.at("?", "!") and self.typed:
            here = self.state()
            self.next()
            if not self.at(":", ",", ")", "=", ";"):
                self.back(here)
                return
        if self.typed and self.eat(":"):
            self.skip_type()

    # --- statements

    def program(self) -> Node:
        body = self.body("end")
        return Node("stmts", "program", body, 0, len(self.source), 1)

    def body(self, close: str) -> list[Node]:
        out = []
        while self.kind != "end" and not (close != "end" and self.at(close)):
            begin = self.state()
            try:
                s = self.statement()
                if s is not None:
                    out.append(s)
            except (Unreadable, RecursionError):
                if self.pattern:
                    raise
                self.errors += 1
                self.back(begin)
                start = self.start
                self.recover(close)
                out.append(self.node("error", start))
            if self.start == begin[0] and self.kind != "end":
                self.next()
        return out

    def recover(self, close: str) -> None:
        """To the end of the statement: a semicolon, or a line break outside brackets."""
        first = True
        while self.kind != "end":
            if self.at("(", "[", "{"):
                here = self.state()
                try:
                    self.skip_group()
                except Unreadable:
                    self.back(here)
                    self.next()
                first = False
                continue
            if self.at(";"):
                self.next()
                return
            if not first and (self.broke or self.at(close)):
                return
            first = False
            self.next()

    def finish(self) -> None:
        if not self.eat(";") and not (self.broke or self.at("}") or self.kind == "end" or self.pattern):
            raise Unreadable(f"statement end at {self.start}")

    def block(self) -> Node:
        start = self.start
        self.want("{")
        kids = self.body("}")
        self.want("}")
        return self.node("stmts", start, "", kids)

    def statement(self) -> Node | None:
        start = self.start
        if self.at("{"):
            return self.block()
        if self.at(";"):
            self.next()
            return None
        if self.pattern and self.at("..."):
            here = self.state()
            self.next()
            if self.kind == "end" or self.broke or self.at("}", ";") or self.kind == "name" or self.at("...", "<", "{"):
                self.eat(";")
                return self.node("ellipsis", start)
            self.back(here)
        if self.at("@"):
            marks = self.decorators()
            if self.pattern and self.kind == "end":
                return marks[0]
            s = self.statement()
            if s is not None:
                s.kids += [Node("decorators", "", marks, start, self.end, self.line(start))] if s.kind in ("class", "method") else []
                if s.kind == "export" and s.kids and s.kids[0] is not None:
                    s.kids[0].kids.append(Node("decorators", "", marks, start, self.end, self.line(start)))
                s.start = start
            return s
        if self.kind == "name":
            w = self.text
            method = getattr(self, f"_{w}", None) if w in ("if", "for", "while", "do", "switch", "try", "return", "throw", "break", "continue", "import", "export", "var", "let", "const", "class", "function", "type", "interface", "enum", "declare", "namespace", "module", "abstract", "debugger", "async") else None
            if method is not None:
                s = method(start)
                if s is not None:
                    return s
            kind, text, _ = self.ahead()
            if kind == "mark" and text == ":" and not self.pattern:
                self.next()
                self.next()
                return self.statement()
        e = self.expression()
        if e.kind == "name" and e.value.startswith("$") and self.pattern and self.at("{"):
            raise Unreadable("pattern")
        self.finish()
        return self.node("expr_stmt", start, "", [e])

    def _if(self, start: int) -> Node:
        self.next()
        self.want("(")
        test = self.expression()
        self.want(")")
        then = self.statement()
        other = None
        if self.word("else"):
            self.next()
            other = self.statement()
        return self.node("if", start, "", [test, then, other])

    def _for(self, start: int) -> Node:
        self.next()
        if self.word("await"):
            self.next()
        self.want("(")
        if self.pattern and self.at("...") :
            self.next()
            self.want(")")
            return self.node("for", start, "", [Node("ellipsis"), self.statement()])
        first = None
        if self.word("var", "let", "const"):
            first = self.declaration(bare=True)
        elif not self.at(";"):
            first = self.expression(no_in=True)
        if self.word("of", "in"):
            how = self.next()
            over = self.expression()
            self.want(")")
            return self.node("for_in", start, how, [first, over, self.statement()])
        self.want(";")
        test = None if self.at(";") else self.expression()
        self.want(";")
        step = None if self.at(")") else self.expression()
        self.want(")")
        return self.node("for", start, "", [first, test, step, self.statement()])

    def _while(self, start: int) -> Node:
        self.next()
        self.want("(")
        test = self.expression()
        self.want(")")
        return self.node("while", start, "", [test, self.statement()])

    def _do(self, start: int) -> Node:
        self.next()
        body = self.statement()
        if self.word("while"):
            self.next()
        self.want("(")
        test = self.expression()
        self.want(")")
        self.eat(";")
        return self.node("do", start, "", [body, test])

    def _switch(self, start: int) -> Node:
        self.next()
        self.want("(")
        on = self.expression()
        self.want(")")
        self.want("{")
        cases = []
        while not self.at("}") and self.kind != "end":
            begin = self.start
            if self.pattern and self.eat("..."):
                cases.append(self.node("ellipsis", begin))
                continue
            test = None
            if self.word("case"):
                self.next()
                test = self.expression()
            elif self.word("default"):
                self.next()
            else:
                raise Unreadable("case")
            self.want(":")
            inner = []
            while not self.at("}") and not self.word("case", "default") and self.kind != "end":
                s = self.statement()
                if s is not None:
                    inner.append(s)
            cases.append(self.node("case", begin, "", [test, Node("stmts", "", inner, begin, self.end, self.line(begin))]))
        self.want("}")
        return self.node("switch", start, "", [on, Node("cases", "", cases, start, self.end, self.line(start))])

    def _try(self, start: int) -> Node:
        self.next()
        body, handler, last = self.block(), None, None
        if self.word("catch"):
            begin = self.start
            self.next()
            param = None
            if self.eat("("):
                param = self.target()
                self.annotation()
                self.want(")")
            handler = self.node("catch", begin, "", [param, self.block()])
            handler.end = self.end
        if self.word("finally"):
            self.next()
            last = self.block()
        return self.node("try", start, "", [body, handler, last])

    def _return(self, start: int) -> Node:
        kind = self.next()
        value = None if self.broke or self.at(";", "}") or self.kind == "end" else self.expression()
        self.finish()
        return self.node(kind, start, "", [value])

    _throw = _return

    def _break(self, start: int) -> Node:
        kind = self.next()
        if self.kind == "name" and not self.broke:
            self.next()
        self.finish()
        return self.node(kind, start)

    _continue = _debugger = _break

    def _var(self, start: int) -> Node | None:
        kind, text, _ = self.ahead()
        if self.text == "let" and not (kind in ("name",) or text in ("{", "[")):
            return None
        if self.text == "const" and text == "enum":
            self.next()
            return self._enum(start)
        d = self.declaration()
        return d

    _let = _const = _var

    def declaration(self, bare: bool = False) -> Node:
        start = self.start
        how = self.next()
        kids = []
        while True:
            begin = self.start
            target = self.target()
            self.annotation()
            value = None
            if self.eat("="):
                value = self.assignment(no_in=bare)
            kids.append(self.node("declarator", begin, "", [target, value]))
            if not self.eat(","):
                break
        if not bare:
            self.finish()
        return self.node("var", start, how, kids)

    def _async(self, start: int) -> Node | None:
        kind, text, broke = self.ahead()
        if kind == "name" and text == "function" and not broke:
            self.next()
            return self.function(start, "async", statement=True)
        return None

    def _function(self, start: int) -> Node:
        return self.function(start, "", statement=True)

    def function(self, start: int, flags: str, statement: bool = False) -> Node:
        self.next()
        if self.eat("*"):
            flags += "*"
        name = None
        if self.kind == "name":
            name = self.ident()
        params = self.params()
        if self.eat(":"):
            self.skip_type()
        if statement and not self.at("{"):
            self.finish()
            return self.node("function", start, flags, [name, params, None])
        return self.node("function", start, flags, [name, params, self.block()])

    def params(self) -> Node:
        if self.typed and self.at("<"):
            self.skip_angles()
        start = self.start
        self.want("(")
        kids = []
        while not self.at(")"):
            begin = self.start
            marks = self.decorators() if self.at("@") else []
            while self.typed and self.word("public", "private", "protected", "readonly", "override") and self.ahead()[0] == "name":
                self.next()
            if self.at("..."):
                self.next()
                if self.pattern and (self.at(",", ")")):
                    kids.append(self.node("ellipsis", begin))
                else:
                    inner = self.target()
                    self.annotation()
                    kids.append(self.node("spread", begin, "", [inner]))
            else:
                t = self.target()
                self.annotation()
                if self.eat("="):
                    t = self.node("default", begin, "", [t, self.assignment()])
                if marks:
                    t = self.node("marked", begin, "", [t, Node("decorators", "", marks, begin, self.end, self.line(begin))])
                kids.append(t)
            if not self.eat(","):
                break
        self.want(")")
        return self.node("params", start, "", kids)

    def target(self) -> Node:
        """A name or a destructuring pattern."""
        start = self.start
        if self.at("{"):
            self.next()
            kids = []
            while not self.at("}"):
                begin = self.start
                if self.eat("..."):
                    kids.append(self.node("ellipsis", begin) if self.pattern and self.at(",", "}") else self.node("spread", begin, "", [self.target()]))
                else:
                    key = self.key()
                    value = key
                    if self.eat(":"):
                        value = self.target()
                    if self.eat("="):
                        value = self.node("default", begin, "", [value, self.assignment()])
                    kids.append(self.node("prop", begin, "", [key, value]))
                if not self.eat(","):
                    break
            self.want("}")
            return self.node("object", start, "", kids)
        if self.at("["):
            self.next()
            kids = []
            while not self.at("]"):
                begin = self.start
                if self.at(","):
                    kids.append(self.node("hole", begin))
                elif self.eat("..."):
                    kids.append(self.node("ellipsis", begin) if self.pattern and self.at(",", "]") else self.node("spread", begin, "", [self.target()]))
                else:
                    value = self.target()
                    if self.eat("="):
                        value = self.node("default", begin, "", [value, self.assignment()])
                    kids.append(value)
                if not self.eat(","):
                    break
            self.want("]")
            return self.node("array", start, "", kids)
        if self.pattern and self.at("..."):
            self.next()
            return self.node("ellipsis", start)
        return self.ident()

    def ident(self) -> Node:
        start = self.start
        if self.kind != "name":
            raise Unreadable(f"name at {start}")
        return self._leaf("name", start)

    def _leaf(self, kind: str, start: int) -> Node:
        value = self.next()
        return self.node(kind, start, value)

    def _class(self, start: int, expression: bool = False) -> Node:
        while self.word("abstract"):
            self.next()
        self.next()
        name = above = None
        if self.kind == "name" and not self.word("extends", "implements"):
            name = self.ident()
        if self.at("<"):
            self.skip_angles()
        if self.word("extends"):
            self.next()
            above = self.postfix(self.primary(), no_call_type=True)
            if self.at("<"):
                self.skip_angles()
        if self.word("implements"):
            self.next()
            self.skip_type()
            while self.eat(","):
                self.skip_type()
        begin = self.start
        self.want("{")
        kids = []
        while not self.at("}") and self.kind != "end":
            if self.eat(";"):
                continue
            kids.append(self.element())
        self.want("}")
        return self.node("class", start, "", [name, above, self.node("class_body", begin, "", kids)])

    _abstract = _class

    def element(self) -> Node:
        start = self.start
        if self.pattern and self.at("..."):
            self.next()
            return self.node("ellipsis", start)
        marks = self.decorators() if self.at("@") else []
        flags = []
        while self.word("static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "declare", "accessor"):
            kind, text, _ = self.ahead()
            if kind == "mark" and text in ("(", "=", ";", "}", ":", "?", "!", "<", ","):
                break
            flags.append(self.next())
            if self.at("{") and flags == ["static"]:
                return self.node("static", start, "", [self.block()])
        if self.eat("*"):
            flags.append("*")
        if self.at("["):
            here = self.state()
            self.skip_group()
            if self.at(":") or self.at("?"):  # an index signature
                self.annotation()
                self.finish()
                return self.node("signature", start)
            self.back(here)
        key = self.key()
        self.at("?", "!") and self.next()
        if self.at("(", "<"):
            params = self.params()
            if self.eat(":"):
                self.skip_type()
            body = self.block() if self.at("{") else None
            if body is None:
                self.finish()
            kids = [key, params, body]
            kind = "method"
        else:
            self.annotation()
            kids = [key, self.assignment() if self.eat("=") else None]
            self.finish()
            kind = "field"
        if marks:
            kids.append(Node("decorators", "", marks, start, marks[-1].end, self.line(start)))
        return self.node(kind, start, " ".join(f for f in flags if f in ("static", "async", "get", "set", "*")), kids)

    def decorators(self) -> list[Node]:
        out = []
        while self.at("@"):
            start = self.start
            self.next()
            e = self.ident() if self.kind == "name" else self.primary()
            out.append(self.node("decorator", start, "", [self.postfix(e)]))
        return out

    def _type(self, start: int) -> Node | None:
        kind, text, broke = self.ahead()
        if kind != "name" or broke or not self.typed:
            return None
        self.next()
        name = self.ident()
        if self.at("<"):
            self.skip_angles()
        self.want("=")
        self.skip_type()
        self.eat(";")
        return self.node("typedef", start, "type", [name])

    def _interface(self, start: int) -> Node | None:
        kind, _, broke = self.ahead()
        if kind != "name" or broke or not self.typed:
            return None
        how = self.next()
        name = self.ident()
        while not self.at("{") and self.kind != "end":
            self.skip_angles() if self.at("<") else self.next()
        self.skip_group()
        return self.node("typedef", start, how, [name])

    _enum = _namespace = _module = _interface

    def _declare(self, start: int) -> Node | None:
        kind, _, broke = self.ahead()
        if kind != "name" or broke or not self.typed:
            return None
        self.next()
        if self.word("global"):
            self.next()
            return self.block()
        return self.statement()

    def _import(self, start: int) -> Node | None:
        kind, text, _ = self.ahead()
        if kind == "mark" and text in ("(", "."):
            return None
        self.next()
        if self.word("type") and self.ahead()[1] not in ("from", ","):
            self.next()
        clauses = []
        if self.kind != "string":
            while not self.word("from"):
                begin = self.start
                if self.eat("{"):
                    while not self.at("}"):
                        b = self.start
                        if self.eat("..."):
                            clauses.append(self.node("ellipsis", b))
                        else:
                            if self.word("type") and self.ahead()[0] == "name" and self.ahead()[1] != "as":
                                self.next()
                            name = self._leaf("name", b) if self.kind in ("name", "string") else self.ident()
                            local = name
                            if self.word("as"):
                                self.next()
                                local = self.ident()
                            clauses.append(self.node("specifier", b, "", [name, local]))
                        if not self.eat(","):
                            break
                    self.want("}")
                elif self.eat("*"):
                    if self.word("as"):
                        self.next()
                    clauses.append(self.node("import_all", begin, "", [self.ident()]))
                elif self.pattern and self.eat("..."):
                    clauses.append(self.node("ellipsis", begin))
                else:
                    clauses.append(self.node("import_default", begin, "", [self.ident()]))
                if self.at("=") :  # import x = require("y")
                    raise Unreadable("import =")
                if not self.eat(","):
                    break
            if not self.word("from"):
                raise Unreadable("import")
            self.next()
        if self.kind != "string" and not (self.pattern and self.kind == "name"):
            raise Unreadable("import source")
        source = self._leaf(self.kind, self.start)
        if self.word("with", "assert") and self.ahead()[1] == "{":
            self.next()
            self.skip_group()
        self.finish()
        return self.node("import", start, "", [Node("clauses", "", clauses, start, self.end, self.line(start)), source])

    def _export(self, start: int) -> Node:
        self.next()
        if self.word("type") and self.ahead()[1] in ("{", "*"):
            self.next()
        if self.word("default"):
            self.next()
            if self.word("function", "class", "abstract", "interface", "const", "let", "var") or (self.word("async") and self.ahead()[1] == "function"):
                return self.node("export", start, "default", [self.statement()])
            e = self.assignment()
            self.finish()
            return self.node("export", start, "default", [e])
        if self.at("{", "*"):
            clauses = []
            if self.eat("*"):
                if self.word("as"):
                    self.next()
                    self.next()
            else:
                self.next()
                while not self.at("}"):
                    b = self.start
                    if self.eat("..."):
                        clauses.append(self.node("ellipsis", b))
                    else:
                        name = local = self._leaf("name", b)
                        if self.word("as"):
                            self.next()
                            local = self._leaf("name", self.start)
                        clauses.append(self.node("specifier", b, "", [name, local]))
                    if not self.eat(","):
                        break
                self.want("}")
            source = None
            if self.word("from"):
                self.next()
                source = self._leaf("string", self.start)
            self.finish()
            return self.node("export", start, "from" if source else "list", [Node("clauses", "", clauses, start, self.end, self.line(start)), source])
        if self.eat("="):
            e = self.expression()
            self.finish()
            return self.node("export", start, "=", [e])
        return self.node("export", start, "", [self.statement()])

    # --- expressions

    def expression(self, no_in: bool = False) -> Node:
        start = self.start
        e = self.assignment(no_in)
        if self.at(",") :
            kids = [e]
            while self.eat(","):
                kids.append(self.assignment(no_in))
            return self.node("seq", start, "", kids)
        return e

    def assignment(self, no_in: bool = False) -> Node:
        self.depth += 1
        if self.depth > 180:
            self.depth = 0
            raise Unreadable("too deep")
        try:
            return self._assignment(no_in)
        finally:
            self.depth -= 1

    def _assignment(self, no_in: bool) -> Node:
        start = self.start
        arrow = self.arrow(start)
        if arrow is not None:
            return arrow
        if self.word("yield"):
            self.next()
            self.eat("*")
            value = None if self.broke or self.at(")", "]", "}", ",", ";") or self.kind == "end" else self.assignment(no_in)
            return self.node("yield", start, "", [value])
        left = self.conditional(no_in)
        if self.kind == "mark" and self.text in ASSIGN:
            op = self.next()
            return self.node("assign", start, op, [left, self.assignment(no_in)])
        return left

    def arrow(self, start: int) -> Node | None:
        flags = ""
        here = self.state()
        if self.word("async"):
            kind, text, broke = self.ahead()
            if not broke and (kind == "name" and text not in ("function",) or text in ("(", "<")):
                self.next()
                flags = "async"
        if self.kind == "name":
            kind, text, broke = self.ahead()
            if kind == "mark" and text == "=>" and not broke:
                begin = self.start
                params = Node("params", "", [self.ident()], begin, self.end, self.line(begin))
                self.next()
                return self._arrow(start, flags, params)
        elif (self.at("(") or (self.at("<") and self.typed)) and self.start not in self.no_arrow:
            begin = self.start
            try:
                params = self.params()
                if self.typed and self.at(":"):
                    self.next()
                    self.skip_type()
                if self.at("=>") and not self.broke:
                    self.next()
                    return self._arrow(start, flags, params)
            except Unreadable:
                pass
            self.no_arrow.add(begin)
        self.back(here)
        return None

    def _arrow(self, start: int, flags: str, params: Node) -> Node:
        body = self.block() if self.at("{") else self.assignment()
        return self.node("arrow", start, flags, [params, body])

    def conditional(self, no_in: bool) -> Node:
        start = self.start
        test = self.binary(1, no_in)
        if self.at("?"):
            self.next()
            a = self.assignment()
            self.want(":")
            return self.node("cond", start, "", [test, a, self.assignment(no_in)])
        return test

    def binary(self, least: int, no_in: bool) -> Node:
        start = self.start
        left = self.unary()
        while True:
            if self.typed and self.word("as", "satisfies") and not self.broke:
                self.next()
                begin = self.start
                if self.word("const"):
                    self.next()
                else:
                    self.skip_type()
                left = self.node("as", start, self.source[begin : self.end].strip(), [left])
                continue
            op = self.text
            power = BINARY.get(op, 0) if self.kind in ("mark", "name") else 0
            if power < least or (op == "in" and no_in):
                return left
            self.next()
            right = self.binary(power if op == "**" else power + 1, no_in)
            left = self.node("binary", start, op, [left, right])

    def unary(self) -> Node:
        start = self.start
        if self.kind == "mark" and self.text in PREFIX:
            op = self.next()
            return self.node("unary", start, op, [self.unary()])
        if self.word("typeof", "void", "delete") or (self.word("await") and self.ahead()[1] not in (")", ",", ";", "=>", "=", ".")):
            op = self.next()
            return self.node("await" if op == "await" else "unary", start, "" if op == "await" else op, [self.unary()])
        e = self.postfix(self.primary())
        if self.at("++", "--") and not self.broke:
            op = self.next()
            return self.node("unary", start, op, [e])
        return e

    def args(self) -> Node:
        start = self.start
        self.want("(")
        kids = []
        while not self.at(")"):
            kids.append(self.item((",", ")")))
            if not self.eat(","):
                break
        self.want(")")
        return self.node("args", start, "", kids)

    def item(self, stops: tuple[str, ...]) -> Node:
        """An expression, a spread, or an ellipsis of a pattern."""
        start = self.start
        if self.at("..."):
            self.next()
            if self.pattern and (self.at(*stops) or self.kind == "end"):
                return self.node("ellipsis", start)
            return self.node("spread", start, "", [self.assignment()])
        return self.assignment()

    def postfix(self, e: Node, no_call_type: bool = False) -> Node:
        start = e.start
        while True:
            if self.at(".", "?."):
                optional = self.next() == "?."
                if optional and self.at("("):
                    e = self.node("call", start, "", [e, self.args()])
                elif optional and self.at("["):
                    self.next()
                    i = self.expression()
                    self.want("]")
                    e = self.node("index", start, "", [e, i])
                elif self.kind == "name":
                    e = self.node("member", start, "", [e, self.ident()])
                    e.end = self.end
                elif self.pattern and self.at("..."):
                    begin = self.start
                    self.next()
                    e = self.node("member", start, "", [e, self.node("ellipsis", begin)])
                else:
                    raise Unreadable(f"member at {self.start}")
            elif self.at("[") :
                self.next()
                i = Node("ellipsis") if self.pattern and self.at("...") and self.next() else self.expression()
                self.want("]")
                e = self.node("index", start, "", [e, i])
            elif self.at("("):
                e = self.node("call", start, "", [e, self.args()])
                e.end = self.end
            elif self.at("`"):
                e = self.node("tagged", start, "", [e, self.template()])
                e.end = self.end
            elif self.typed and self.at("!") and not self.broke and self.ahead()[1] not in ("=",):
                self.next()
                e = self.node("nonnull", start, "", [e])
            elif self.typed and self.at("<") and not no_call_type:
                here = self.state()
                try:
                    self.skip_angles()
                    if not self.at("(", "`", ")", ",", ";", "]", "}", ":") or self.broke:
                        raise Unreadable("less")
                    if not self.at("(", "`"):
                        raise Unreadable("less")
                except Unreadable:
                    self.back(here)
                    return e
            else:
                return e

    def primary(self) -> Node:
        start = self.start
        if self.kind == "name":
            w = self.text
            if w == "function":
                return self.function(start, "")
            if w == "async" and self.ahead()[1] == "function" and not self.ahead()[2]:
                self.next()
                return self.function(start, "async")
            if w == "class":
                return self._class(start, True)
            if w == "new":
                self.next()
                if self.eat("."):
                    return self._leaf("name", start)
                callee = self.primary()
                while self.at(".", "["):
                    if self.eat("."):
                        callee = self.node("member", callee.start, "", [callee, self.ident()])
                    else:
                        self.next()
                        i = self.expression()
                        self.want("]")
                        callee = self.node("index", callee.start, "", [callee, i])
                if self.typed and self.at("<"):
                    self.skip_angles()
                args = self.args() if self.at("(") else Node("args", "", [], self.end, self.end, self.line(self.end))
                return self.node("new", start, "", [callee, args])
            return self._leaf("name", start)
        if self.kind in ("string", "number"):
            return self._leaf(self.kind, start)
        if self.at("("):
            self.next()
            if self.pattern and self.at("..."):
                self.next()
                self.want(")")
                return self.node("ellipsis", start)
            e = self.expression()
            self.want(")")
            # what stands in parentheses begins and ends with them
            e.start, e.end, e.line = start, self.end, self.line(start)
            return e
        if self.at("["):
            self.next()
            kids = []
            while not self.at("]"):
                if self.at(","):
                    kids.append(self.node("hole", self.start))
                else:
                    kids.append(self.item((",", "]")))
                if not self.eat(","):
                    break
            self.want("]")
            return self.node("array", start, "", kids)
        if self.at("{"):
            return self.object(start)
        if self.at("`"):
            return self.template()
        if self.at("/", "/="):
            m = REGEX.match(self.source, start)
            if not m:
                raise Unreadable("regex")
            self.end = m.end()
            self.seek(m.end())
            return self.node("regex", start, m[0])
        if self.at("<") and self.markup:
            if self.pattern and self.source.startswith("<...", start):
                self.next()
                self.next()
                e = self.expression()
                self.want("...")
                self.want(">")
                return self.node("deep", start, "", [e])
            return self.element_markup()
        if self.at("<") and self.typed:
            self.skip_angles()
            return self.unary()
        if self.pattern and self.at("..."):
            self.next()
            return self.node("ellipsis", start)
        if self.at("@"):
            self.decorators()
            return self.primary()
        raise Unreadable(f"{self.text!r} at {start}")

    def object(self, start: int) -> Node:
        self.want("{")
        kids = []
        while not self.at("}"):
            begin = self.start
            if self.at("..."):
                self.next()
                kids.append(self.node("ellipsis", begin) if self.pattern and self.at(",", "}") else self.node("spread", begin, "", [self.assignment()]))
            else:
                flags = ""
                while self.word("async", "get", "set") and self.ahead()[1] not in (":", ",", "}", "(", "="):
                    flags = self.next()
                if self.eat("*"):
                    flags += "*"
                key = self.key()
                if self.at("(", "<"):
                    params = self.params()
                    if self.eat(":"):
                        self.skip_type()
                    kids.append(self.node("method", begin, flags, [key, params, self.block()]))
                    kids[-1].end = self.end
                elif self.eat(":"):
                    value = self.node("ellipsis", self.start) if self.pattern and self.at("...") and self.next() else self.assignment()
                    kids.append(self.node("prop", begin, "", [key, value]))
                else:
                    value = key
                    if self.eat("="):
                        value = self.node("default", begin, "", [key, self.assignment()])
                    kids.append(self.node("prop", begin, "short", [key, value]))
            if not self.eat(","):
                break
        self.want("}")
        return self.node("object", start, "", kids)

    def key(self) -> Node:
        start = self.start
        if self.kind in ("name", "string", "number"):
            return self._leaf(self.kind, start)
        if self.eat("["):
            e = self.assignment()
            self.want("]")
            return self.node("computed", start, "", [e])
        raise Unreadable(f"key at {start}")

    def template(self) -> Node:
        start, at = self.start, self.start + 1
        kids, begin = [], at
        s = self.source
        piece = lambda a, b: Node("ellipsis" if self.pattern and s[a:b] == "..." else "chunk", s[a:b], [], a, b, self.line(a))
        while at < len(s) and s[at] != "`":
            if s[at] == "\\":
                at += 2
            elif s.startswith("${", at):
                if at > begin:
                    kids.append(piece(begin, at))
                self.end = at + 2
                self.seek(at + 2)
                kids.append(self.expression())
                if not self.at("}"):
                    raise Unreadable("template")
                at = begin = self.start + 1
            else:
                at += 1
        if at >= len(s):
            raise Unreadable("template")
        if at > begin:
            kids.append(piece(begin, at))
        self.end = at + 1
        self.seek(at + 1)
        return self.node("template", start, "", kids)

    # --- markup

    def element_markup(self) -> Node:
        start = self.start
        self.want("<")
        name = None
        if not self.at(">"):
            name = self.tag_name()
            if self.typed and self.at("<"):
                self.skip_angles()
        begin, attrs = self.start, []
        while not self.at(">", "/"):
            attrs.append(self.attribute())
        row = Node("attrs", "", attrs, begin, self.end, self.line(begin))
        if self.eat("/"):
            if not self.at(">"):
                raise Unreadable("tag")
            self.next()
            return self.node("jsx", start, "self", [name, row, Node("children", "", [], self.end, self.end, self.line(self.end))])
        if not self.at(">"):
            raise Unreadable("tag")
        at, kids, first = self.after, [], self.after
        s = self.source
        while True:
            stop = at
            while stop < len(s) and s[stop] not in "<{":
                stop += 1
            if stop >= len(s):
                raise Unreadable("open tag")
            text = s[at:stop]
            if text.strip():
                if self.pattern and text.strip() == "...":
                    kids.append(Node("ellipsis", "", [], at, stop, self.line(at)))
                else:
                    lead = len(text) - len(text.lstrip())
                    kids.append(Node("jsx_text", " ".join(text.split()), [], at + lead, at + len(text.rstrip()), self.line(at + lead)))
            self.end = stop
            self.seek(stop)
            if self.at("{"):
                b = self.start
                self.next()
                inner = None
                if not self.at("}"):
                    inner = self.item(("}",))
                if not self.at("}"):
                    raise Unreadable("markup expression")
                kids.append(Node("jsx_expr", "", [inner], b, self.after, self.line(b)))
                at = self.after
            elif self.source.startswith("</", self.start) or (self.at("<") and self.ahead()[1] == "/"):
                row_end = self.start
                self.next()
                self.next()
                if not self.at(">"):
                    self.tag_name()
                if not self.at(">"):
                    raise Unreadable("close tag")
                self.next()
                return self.node("jsx", start, "", [name, row, Node("children", "", kids, first, row_end, self.line(first))])
            else:
                kids.append(self.element_markup())
                at = self.end

    def tag_name(self) -> Node:
        """Names of tags and attributes may hold hyphens and colons."""
        start = self.start
        m = re.compile(rf"{NAME}(?:[-:][\w$]+)*").match(self.source, start)
        if not m:
            raise Unreadable("tag name")
        self.end = m.end()
        self.seek(m.end())
        n = self.node("name", start, m[0])
        while self.at("."):
            self.next()
            n = self.node("member", start, "", [n, self.ident()])
            n.end = self.end
        return n

    def attribute(self) -> Node:
        start = self.start
        if self.at("..."):
            self.next()
            return self.node("ellipsis", start)
        if self.at("{"):
            self.next()
            self.want("...")
            if self.pattern and self.at("}"):
                self.next()
                return self.node("ellipsis", start)
            e = self.assignment()
            self.want("}")
            return self.node("spread", start, "", [e])
        name = self.tag_name()
        value = None
        if self.eat("="):
            if self.at("{"):
                b = self.start
                self.next()
                inner = self.item(("}",))
                self.want("}")
                value = self.node("jsx_expr", b, "", [inner])
            elif self.source[self.start] in "\"'":
                quote = self.source[self.start]
                stop = self.source.find(quote, self.start + 1)
                if stop < 0:
                    raise Unreadable("attribute")
                b = self.start
                self.end = stop + 1
                self.seek(stop + 1)
                value = self.node("string", b, self.source[b : stop + 1])
            elif self.at("<"):
                value = self.element_markup()
            elif self.kind == "name":
                value = self.ident()
            else:
                raise Unreadable("attribute")
        return self.node("attr", start, "", [name, value])


def parse(source: str, typed: bool = True, markup: bool = True) -> tuple[Node, int]:
    """The tree of a file and the number of statements that could not be read."""
    p = Parser(source, typed, markup)
    return p.program(), p.errors


def parse_pattern(text: str) -> Node:
    """A pattern: an expression, a statement, or several as ``stmts``."""
    p = Parser(text.strip(), True, True, pattern=True)
    tree = p.program()
    if not tree.kids:
        raise Unreadable("empty pattern")
    if len(tree.kids) > 1:
        return tree
    only = tree.kids[0]
    return only.kids[0] if only.kind == "expr_stmt" else only
