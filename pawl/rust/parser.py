"""Items, statements and expressions of Rust, as far as measurements need them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pawl.rust.lexer import Malformed, Token

LEVELS = {"||": 3, "&&": 4, "==": 5, "!=": 5, "<": 5, ">": 5, "<=": 5, ">=": 5, "|": 6, "^": 7, "&": 8, "<<": 9, ">>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<=", ">>="}
OPERATORS = {*LEVELS, *ASSIGN, "..", "..=", "=>", "->", "::", "..."}
BLOCKS = {"if", "match", "while", "for", "loop", "unsafe", "block", "async", "const_block"}
ITEM_WORDS = {"fn", "struct", "enum", "impl", "trait", "mod", "use", "static", "type", "macro_rules"}


@dataclass(slots=True)
class Node:
    """An expression, statement or item. parts are its children in source order."""

    kind: str
    parts: list[Node] = field(default_factory=list)
    text: str = ""
    attrs: list[Token] = field(default_factory=list)
    extra: dict = field(default_factory=dict)

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.parts))


def attributes(tokens: list[Token]) -> list[Token]:
    """All attribute groups in token trees, however deep."""
    found = []
    for i, t in enumerate(tokens):
        if t.kind == "group":
            before = [x for x in tokens[max(0, i - 2) : i]]
            if t.text == "[" and before and (before[-1].is_("#") or (len(before) == 2 and before[0].is_("#") and before[1].is_("!"))):
                found.append(t)
            else:
                found += attributes(t.inner)
    return found


class Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    # tokens -----------------------------------------------------------------
    def peek(self, ahead: int = 0) -> Token | None:
        at = self.at + ahead
        return self.tokens[at] if at < len(self.tokens) else None

    def next(self) -> Token:
        token = self.peek()
        if token is None:
            raise Malformed("the source ends too early")
        self.at += 1
        return token

    def is_(self, *texts: str, ahead: int = 0) -> bool:
        at = self.at + ahead
        if at >= len(self.tokens):
            return False
        token = self.tokens[at]
        return token.text in texts and token.kind in ("punct", "ident")

    def is_group(self, bracket: str, ahead: int = 0) -> bool:
        token = self.peek(ahead)
        return token is not None and token.group(bracket)

    def accept(self, *texts: str) -> bool:
        if self.is_(*texts):
            self.at += 1
            return True
        return False

    def expect(self, text: str) -> None:
        if not self.accept(text):
            token = self.peek()
            raise Malformed(f"{text} expected" + (f" in line {token.line}, not {token.text}" if token else ""))

    def operator(self) -> str:
        """The longest operator that starts here, "" if none."""
        run = ""
        for token in self.tokens[self.at : self.at + 3]:
            if token.kind != "punct":
                break
            run += token.text
            if not token.joint:
                break
        while run and run not in OPERATORS:
            run = run[:-1]
        return run

    def eat_attrs(self, inner: bool = False) -> list[Token]:
        found = []
        """Attributes of what follows, or (inner) of what they stand in."""
        while self.is_("#") and (self.is_("!", ahead=1) and self.is_group("[", 2) if inner else self.is_group("[", 1)):
            self.at += 1 + inner
            found.append(self.next())
        return found

    # types and paths --------------------------------------------------------
    def skip_angles(self) -> None:
        """From < to the > that closes it."""
        depth = 0
        while True:
            token = self.next()
            if token.is_("<"):
                depth += 1
            elif token.is_("-") and token.joint and self.is_(">"):
                self.at += 1
            elif token.is_(">"):
                depth -= 1
                if not depth:
                    return

    def skip_path(self, in_type: bool) -> None:
        """A path, with ``::<...>`` in expressions and ``<...>`` or ``(...) -> T`` in types."""
        if self.is_("<"):
            self.skip_angles()
        while True:
            if self.operator() == "::":
                self.at += 2
                if self.is_("<"):
                    self.skip_angles()
                    continue
            elif self.peek() is None or self.peek().kind != "ident":
                return
            if self.peek() is not None and self.peek().kind == "ident":
                self.at += 1
            else:
                return
            if in_type and self.is_("<"):
                self.skip_angles()
            if in_type and self.is_group("("):
                self.at += 1
                if self.operator() == "->":
                    self.at += 2
                    self.skip_type(bounds=False)
            if self.operator() != "::":
                return

    def skip_type(self, bounds: bool = True) -> None:
        while self.operator() in ("&", "&&") or self.is_("&"):
            self.at += 1
            if self.peek() is not None and self.peek().kind == "life":
                self.at += 1
            self.accept("mut")
        token = self.peek()
        if token is None:
            raise Malformed("a type is missing")
        if token.is_("*"):
            self.at += 1
            self.accept("const", "mut")
            return self.skip_type(bounds)
        if token.kind == "group":
            self.at += 1
            if token.text == "{":
                raise Malformed(f"line {token.line}: a type expected")
        elif token.is_("!", "_"):
            self.at += 1
        elif token.is_("impl", "dyn"):
            self.at += 1
            self.skip_bounds()
            return
        else:
            if token.is_("for"):
                self.at += 1
                self.skip_angles()
            while self.accept("unsafe", "extern") or (self.peek() is not None and self.peek().kind == "lit"):
                if self.peek() is not None and self.peek().kind == "lit":
                    self.at += 1
            if self.accept("fn"):
                self.next()
                if self.operator() == "->":
                    self.at += 2
                    self.skip_type(bounds=False)
                return
            before = self.at
            self.skip_path(in_type=True)
            if self.at == before:
                raise Malformed(f"line {token.line}: a type expected, not {token.text}")
            if self.is_("!") and self.peek(1) is not None and self.peek(1).kind == "group":
                self.at += 2
        if bounds and self.operator() == "+":
            self.at += 1
            self.skip_bounds()

    def skip_bounds(self) -> None:
        while True:
            self.accept("?")
            token = self.peek()
            if token is None:
                return
            if token.kind == "life" or token.group("("):
                self.at += 1
            elif token.is_("for"):
                self.at += 1
                self.skip_angles()
                self.skip_path(in_type=True)
            elif token.kind == "ident" or self.operator() == "::":
                self.skip_path(in_type=True)
            else:
                return
            if self.operator() != "+":
                return
            self.at += 1

    def type_tokens(self) -> list[Token]:
        start = self.at
        self.skip_type()
        return self.tokens[start : self.at]

    def skip_pattern(self, *stops: str) -> None:
        """To one of the stops at this depth; ``=`` stops only by itself, ``if`` only as a word."""
        depth = 0
        while self.peek() is not None:
            op = self.operator()
            if depth == 0 and (op in stops or (self.peek().kind == "ident" and self.peek().text in stops)):
                return
            if self.is_("<") and op == "<":
                self.skip_angles()
                continue
            self.at += max(1, len(op))

    # expressions ------------------------------------------------------------
    def expr(self, struct: bool = True, level: int = 0) -> Node:
        attrs = self.eat_attrs()
        left = self.prefix(struct)
        left.attrs = attrs + left.attrs
        return self.binary(left, struct, level)

    def binary(self, left: Node, struct: bool, level: int) -> Node:
        while True:
            if self.is_("as"):
                self.at += 1
                self.skip_type(bounds=False)
                left = Node("cast", [left])
                continue
            op = self.operator()
            if op in ASSIGN:
                if level > 1:
                    return left
                self.at += len(op)
                left = Node("assign", [left, self.expr(struct, 1)])
            elif op in ("..", "..=", "..."):
                if level > 2:
                    return left
                self.at += len(op)
                left = Node("range", [left, *([self.expr(struct, 3)] if self.starts_expr(struct) else [])])
            elif op in LEVELS and LEVELS[op] >= max(level, 3):
                self.at += len(op)
                left = Node("binary", [left, self.expr(struct, LEVELS[op] + 1)], op)
            else:
                return left

    def starts_expr(self, struct: bool) -> bool:
        token = self.peek()
        if token is None or token.is_(",", ";", "=", ">", "?", ".", "as", "else") or self.operator() in ("=>", "&&", "||", "==") and not self.is_("|"):
            return False
        return not (token.group("{") and not struct)

    def prefix(self, struct: bool) -> Node:
        op = self.operator()
        if op in ("..", "..="):
            self.at += len(op)
            return Node("range", [self.expr(struct, 3)] if self.starts_expr(struct) else [])
        if op in ("|", "||") or self.is_("|"):
            return self.closure(struct)
        token = self.peek()
        if token is None:
            raise Malformed("an expression is missing")
        if token.is_("-", "!", "*"):
            self.at += 1
            return Node("unary", [self.unary_operand(struct)])
        if token.is_("&"):
            self.at += 1
            if self.is_("raw") and self.is_("const", "mut", ahead=1):
                self.at += 1
            self.accept("mut", "const")
            return Node("unary", [self.unary_operand(struct)])
        if token.is_("let"):
            self.at += 1
            self.skip_pattern("=")
            self.expect("=")
            return Node("let", [self.expr(struct, 5)])
        if token.is_("return", "yield", "break", "become"):
            self.at += 1
            label = token.text == "break" and self.peek() is not None and self.peek().kind == "life"
            if label:
                self.at += 1
            value = [self.expr(struct, 1)] if self.starts_expr(struct) else []
            return Node(token.text, value, "labelled" if label else "")
        if token.is_("continue"):
            self.at += 1
            label = self.peek() is not None and self.peek().kind == "life"
            self.at += label
            return self.postfix(Node("continue", [], "labelled" if label else ""))
        return self.postfix(self.primary(struct))

    def unary_operand(self, struct: bool) -> Node:
        attrs = self.eat_attrs()
        node = self.prefix(struct)
        node.attrs = attrs + node.attrs
        return node

    def closure(self, struct: bool) -> Node:
        if self.operator() == "||":
            self.at += 2
        else:
            self.expect("|")
            while not self.is_("|"):
                if self.is_("<"):
                    self.skip_angles()
                else:
                    self.next()
            self.at += 1
        if self.operator() == "->":
            self.at += 2
            self.skip_type(bounds=False)
        return Node("closure", [self.expr(struct)])

    def postfix(self, node: Node) -> Node:
        while True:
            if self.is_("?"):
                self.at += 1
                node = Node("try", [node])
            elif self.is_group("("):
                node = Node("call", [node, *self.listed(self.next())])
            elif self.is_group("["):
                node = Node("index", [node, *self.listed(self.next())])
            elif self.is_(".") and self.operator() not in ("..", "..=", "..."):
                self.at += 1
                name = self.next()
                if self.operator() == "::":
                    self.at += 2
                    self.skip_angles()
                if name.kind == "ident" and self.is_group("("):
                    node = Node("method", [node, *self.listed(self.next())], name.text)
                else:
                    node = Node("field", [node])
            else:
                return node

    def listed(self, group: Token) -> list[Node]:
        """Expressions between commas or semicolons of a bracketed group."""
        inner, found = Parser(group.inner), []
        while inner.peek() is not None:
            found.append(inner.expr())
            if inner.peek() is not None and not inner.accept(",", ";"):
                raise Malformed(f"line {inner.peek().line}: a comma expected, not {inner.peek().text}")
        return found

    def primary(self, struct: bool) -> Node:
        token = self.peek()
        if token.kind == "life":
            self.at += 1
            self.expect(":")
            return self.primary(struct)
        if token.kind == "lit":
            self.at += 1
            return Node("lit", [], token.text)
        if token.kind == "group":
            self.at += 1
            if token.text == "{":
                return self.block_of(token)
            return Node("paren" if token.text == "(" else "array", self.listed(token))
        if token.is_("if"):
            return self.if_()
        if token.is_("match"):
            self.at += 1
            return self.match_()
        if token.is_("while"):
            self.at += 1
            condition = self.expr(struct=False)
            return Node("while", [condition, self.block()])
        if token.is_("for") and not self.is_("<", ahead=1):
            self.at += 1
            self.skip_pattern("in")
            self.expect("in")
            source = self.expr(struct=False)
            return Node("for", [source, self.block()])
        if token.is_("loop") and self.is_group("{", 1):
            self.at += 1
            return Node("loop", [self.block()])
        if token.is_("unsafe") and self.is_group("{", 1):
            self.at += 1
            return Node("unsafe", [self.block()])
        if token.is_("const") and self.is_group("{", 1):
            self.at += 1
            return Node("const_block", [self.block()])
        if token.is_("async", "gen") and (self.is_group("{", 1) or (self.is_("move", ahead=1) and self.is_group("{", 2))):
            self.at += 1
            self.accept("move")
            return Node("async", [self.block()])
        if token.is_("move", "static", "async", "for"):
            while self.accept("move", "static", "async"):
                pass
            if self.accept("for"):
                self.skip_angles()
            self.accept("move")
            return self.closure(struct)
        start = self.at
        self.skip_path(in_type=False)
        if self.at == start:
            raise Malformed(f"line {token.line}: an expression expected, not {token.text}")
        names = [t.text for t in self.tokens[start : self.at] if t.kind == "ident"]
        if self.is_("!") and self.operator() != "!=" and self.peek(1) is not None and self.peek(1).kind == "group":
            self.at += 1
            return Node("macro", [], names[-1] if names else "", extra={"group": self.next()})
        if struct and self.is_group("{"):
            return self.struct_literal(self.next())
        return Node("path", [], "::".join(names))

    def struct_literal(self, group: Token) -> Node:
        inner, found = Parser(group.inner), Node("struct")
        while inner.peek() is not None:
            found.attrs += inner.eat_attrs()
            if inner.operator() == "..":
                inner.at += 2
                if inner.peek() is not None:
                    found.parts.append(inner.expr())
                continue
            inner.next()
            if inner.is_(":"):
                inner.at += 1
                found.parts.append(inner.expr())
            if inner.peek() is not None:
                inner.expect(",")
        return found

    def if_(self) -> Node:
        self.expect("if")
        parts = [self.expr(struct=False), self.block()]
        if self.accept("else"):
            parts.append(self.if_() if self.is_("if") else self.block())
        return Node("if", parts)

    def match_(self) -> Node:
        subject = self.expr(struct=False)
        if not self.is_group("{"):
            raise Malformed("a match has no arms")
        inner = Parser(self.next().inner)
        node = Node("match", [subject], attrs=inner.eat_attrs(inner=True), extra={"arms": []})
        while inner.peek() is not None:
            node.attrs += inner.eat_attrs()
            inner.skip_pattern("=>", "if")
            guard = inner.expr() if inner.accept("if") else None
            if inner.operator() != "=>":
                raise Malformed("an arm has no body")
            inner.at += 2
            attrs = inner.eat_attrs()
            body = inner.statement_expr()
            body.attrs = attrs + body.attrs
            inner.accept(",")
            node.extra["arms"].append((guard, body))
            node.parts += ([guard] if guard else []) + [body]
        return node

    def statement_expr(self) -> Node:
        """An expression that ends with its block if it starts as one, as statements and arms do."""
        start = self.peek()
        blocky = start is not None and (start.group("{") or start.kind == "life" or start.is_("if", "match", "while", "for", "loop", "unsafe", "async", "const"))
        if not blocky:
            return self.expr()
        before = self.at
        node = self.primary(True)
        if node.kind not in BLOCKS:
            self.at = before
            return self.expr()
        if (self.is_(".") and self.operator() not in ("..", "..=", "...")) or self.is_("?"):
            return self.binary(self.postfix(node), True, 0)
        return node

    # blocks and items -------------------------------------------------------
    def block(self) -> Node:
        if not self.is_group("{"):
            token = self.peek()
            raise Malformed("a block expected" + (f" in line {token.line}" if token else ""))
        return self.block_of(self.next())

    def block_of(self, group: Token) -> Node:
        inner = Parser(group.inner)
        node = Node("block", attrs=inner.eat_attrs(inner=True), extra={"group": group})
        while inner.peek() is not None:
            if inner.accept(";"):
                continue
            node.parts.append(inner.statement())
        return node

    def statement(self) -> Node:
        start = self.at
        attrs = self.eat_attrs()
        if self.is_("let"):
            self.at += 1
            node = Node("local", attrs=attrs)
            self.skip_pattern(":", "=", ";")
            if self.is_(":"):
                self.at += 1
                self.skip_type()
            if self.accept("="):
                node.parts.append(self.expr())
                if self.accept("else"):
                    node.parts.append(self.block())
            self.expect(";")
            return node
        if self.starts_item():
            self.at = start
            return self.item()
        node = self.statement_expr()
        node.attrs = attrs + node.attrs
        if node.kind == "macro" and node.extra["group"].text == "{":
            if self.is_(".") or self.is_("?"):
                node = self.binary(self.postfix(node), True, 0)
        if not self.accept(";") and self.peek() is not None and node.kind not in BLOCKS and not (node.kind == "macro" and node.extra["group"].text == "{"):
            raise Malformed(f"line {self.peek().line}: a semicolon expected, not {self.peek().text}")
        return node

    def starts_item(self) -> bool:
        token = self.peek()
        if token is None or token.kind != "ident":
            return False
        if token.text == "pub" or token.text in ("struct", "enum", "trait", "mod", "use", "fn", "impl", "type"):
            return True
        if token.text == "static":
            return not (self.is_("|", ahead=1) or self.is_("move", ahead=1))
        if token.text == "macro_rules":
            return self.is_("!", ahead=1)
        if token.text == "union":
            return self.peek(1) is not None and self.peek(1).kind == "ident"
        if token.text in ("const", "unsafe", "async", "extern", "default", "auto", "safe"):
            ahead = 0
            while self.is_("const", "unsafe", "async", "extern", "default", "auto", "safe", ahead=ahead) or (self.peek(ahead) is not None and self.peek(ahead).kind == "lit"):
                ahead += 1
            after = self.peek(ahead)
            if after is None:
                return False
            if after.is_("fn", "impl", "trait", "crate", "mod"):
                return True
            if token.text == "extern":
                return after.group("{")
            return token.text == "const" and after.kind == "ident" and not after.is_("move")
        return False

    def item(self) -> Node:
        start, first = self.at, self.peek().line
        attrs = self.eat_attrs()
        public = False
        if self.accept("pub"):
            public = True
            if self.is_group("(") and self.peek().inner and self.peek().inner[0].is_("crate", "self", "super", "in"):
                self.at += 1
                public = False
        words = set()
        while self.is_("const", "unsafe", "async", "extern", "default", "auto", "safe") or (words and self.peek() is not None and self.peek().kind == "lit"):
            token = self.next()
            words.add(token.text)
            if token.text == "const" and not self.is_("fn", "unsafe", "async", "extern"):
                return self.value_item("const", start, first, attrs, public)
            if token.text == "extern" and self.is_("crate"):
                return self.plain("extern crate", start, first, attrs, public)
        if self.is_group("{") and "extern" in words:
            return self.plain("foreign", start, first, attrs, public)
        word = self.next()
        if word.is_("fn"):
            return self.function(start, first, attrs, public, words)
        if word.is_("static"):
            return self.value_item("static", start, first, attrs, public)
        if word.is_("mod", "trait"):
            name = self.next().text
            while self.peek() is not None and not self.is_group("{") and not self.is_(";"):
                self.skip_angles() if self.is_("<") else self.next()
            node = Node(word.text, [], name, attrs, {"public": public})
            if self.is_group("{"):
                self.members(node, self.next())
            else:
                self.expect(";")
            return self.located(node, start, first)
        if word.is_("impl"):
            return self.impl(start, first, attrs, public)
        if word.is_("type"):
            name = self.next().text
            node = Node("type", [], name, attrs, {"public": public, "target": []})
            while self.peek() is not None and self.operator() != "=" and not self.is_(";"):
                self.skip_angles() if self.is_("<") else self.next()
            if self.accept("="):
                node.extra["target"] = self.type_tokens()
            while not self.accept(";"):
                self.next()
            return self.located(node, start, first)
        if word.is_("struct", "enum", "union"):
            name = self.next().text
            node = self.plain(word.text, start, first, attrs, public)
            node.text = name
            return node
        if word.is_("use"):
            return self.plain("use", start, first, attrs, public)
        # a macro as an item
        self.at -= 1
        self.skip_path(in_type=False)
        if not self.is_("!"):
            raise Malformed(f"line {word.line}: an item expected, not {word.text}")
        self.at += 1
        if self.peek() is not None and self.peek().kind == "ident":
            self.at += 1
        group = self.next()
        if group.kind != "group":
            raise Malformed(f"line {word.line}: a macro without a body")
        if group.text != "{":
            self.accept(";")
        return self.located(Node("macro", [], word.text, attrs, {"group": group, "item": True}), start, first)

    def located(self, node: Node, start: int, first: int) -> Node:
        node.extra |= {"start": first, "end": self.tokens[self.at - 1].last, "tokens": self.tokens[start : self.at]}
        return node

    def plain(self, kind: str, start: int, first: int, attrs: list[Token], public: bool) -> Node:
        """An item of no interest inside but for its attributes: to its semicolon or braces."""
        while True:
            token = self.next()
            if token.is_(";") or (token.group("{") and kind != "use"):
                break
        node = self.located(Node(kind, [], "", attrs, {"public": public}), start, first)
        node.extra["inside"] = attributes(node.extra["tokens"])[len(attrs) :]
        return node

    def value_item(self, kind: str, start: int, first: int, attrs: list[Token], public: bool) -> Node:
        while self.operator() not in ("=",) and not self.is_(";"):
            if self.is_(":") and self.operator() == ":":
                self.at += 1
                self.skip_type()
            else:
                self.next()
        node = Node(kind, [], "", attrs, {"public": public})
        if self.accept("="):
            node.parts.append(self.expr())
        self.expect(";")
        return self.located(node, start, first)

    def function(self, start: int, first: int, attrs: list[Token], public: bool, words: set[str]) -> Node:
        name = self.next().text
        if self.is_("<"):
            self.skip_angles()
        inputs = self.next()
        output: list[Token] = []
        if self.operator() == "->":
            self.at += 2
            output = self.type_tokens()
        while self.peek() is not None and not self.is_group("{") and not self.is_(";"):
            self.skip_angles() if self.is_("<") else self.next()
        node = Node("fn", [], name, attrs, {"public": public, "unsafe": "unsafe" in words, "inputs": inputs, "output": output, "body": None})
        if self.is_group("{"):
            node.extra["body"] = self.block()
            node.parts.append(node.extra["body"])
        else:
            self.expect(";")
        return self.located(node, start, first)

    def impl(self, start: int, first: int, attrs: list[Token], public: bool) -> Node:
        if self.is_("<") and not (self.is_(">", ahead=1) and False):
            self.skip_angles()
        self.accept("const")
        self.accept("!")
        target, trait = self.type_tokens(), []
        if self.accept("for"):
            trait, target = target, self.type_tokens()
        while not self.is_group("{"):
            self.skip_angles() if self.is_("<") else self.next()
        node = Node("impl", [], "", attrs, {"public": public, "target": target, "trait": trait})
        self.members(node, self.next())
        return self.located(node, start, first)

    def members(self, node: Node, group: Token) -> None:
        inner = Parser(group.inner)
        node.extra["inner_attrs"] = inner.eat_attrs(inner=True)
        while inner.peek() is not None:
            if not inner.accept(";"):
                node.parts.append(inner.item())


def parse_file(tokens: list[Token]) -> Node:
    root = Node("file")
    Parser([]).members(root, Token("group", "{", 1, 1, tokens))
    return root


def parse_whole(tokens: list[Token]) -> list[Node] | None:
    """Expressions between commas, None if the tokens are no such list."""
    inner, found = Parser(tokens), []
    try:
        while inner.peek() is not None:
            found.append(inner.expr())
            if inner.peek() is not None:
                inner.expect(",")
    except Malformed:
        return None
    return found
