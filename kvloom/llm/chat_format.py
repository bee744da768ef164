"""Chat formatting by a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants in it are folded, and Python closures
are made of the rest. It knows text, {{ expressions }}, {% if %}/{% elif %}/{% else %}, {% for x in xs %},
{% set x = ... %} and {% generation %} blocks, whose output is the loss mask. Expressions: literals, names,
x.key, x[key], + - * // %, comparisons, in, and/or/not, x if c else y, filters (escape, trim, upper, lower,
length, string). There is no call, no attribute access to Python objects and no loop without a list.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings that must not be readable inside texts; fixed values.
CONTROL = ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TEMPLATE = (
    "{% for m in messages %}<|turn|>{{ m.role | escape }}<|text|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|end|>{{ '\\n' }}{% endfor %}"
)
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))


class TemplateError(ValueError):
    """A template that doesn't parse or asks for what the language lacks."""


def escape(text: str) -> str:
    """Backslashes doubled, and one put after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", lambda m: m[1], text)


FILTERS = {"escape": lambda x: escape(_text(x)), "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": len, "string": lambda x: _text(x)}


def _text(x: Any) -> str:
    if x is None:
        return ""
    return x if isinstance(x, str) else ("true" if x else "false") if isinstance(x, bool) else str(x)


@dataclass(frozen=True)
class Node:
    """A syntax tree node: kind and parts (nodes, tuples of nodes, constants)."""

    kind: str
    parts: tuple = ()


TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|//|[-+*%<>()\[\].|,=]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_OPS = {
    "+": lambda a, b: a + b if not isinstance(a, str) and not isinstance(b, str) else _text(a) + _text(b), "-": lambda a, b: a - b, "*": lambda a, b: _product(a, b), "//": lambda a, b: a // b, "%": lambda a, b: a % b if not isinstance(a, str) else _refuse("% on text"),
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
}


def _refuse(what: str):
    raise TemplateError(what)


def _product(a, b):
    return a * b if isinstance(a, (int, float)) and isinstance(b, (int, float)) else _refuse("* is for numbers")


class Expressions:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.tokens.append(("num", m[1]) if m[1] else ("str", m[2]) if m[2] else ("name", m[3]) if m[3] else ("op", m[4]))
            at = m.end()
        self.at = 0

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("name expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Node:
        node = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def choice(self) -> Node:
        node = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            node = Node("choice", (test, node, self.choice()))
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", (node, self.both()))
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = Node("and", (node, self.negated()))
        return node

    def negated(self) -> Node:
        return Node("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.summed()
        while op := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
            node = Node("op", (op, node, self.summed()))
        return node

    def summed(self) -> Node:
        node = self.multiplied()
        while op := self.take("+", "-"):
            node = Node("op", (op, node, self.multiplied()))
        return node

    def multiplied(self) -> Node:
        node = self.filtered()
        while op := self.take("*", "//", "%"):
            node = Node("op", (op, node, self.filtered()))
        return node

    def filtered(self) -> Node:
        node = self.member()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            node = Node("filter", (name, node))
        return node

    def member(self) -> Node:
        node = self.atom()
        while True:
            if self.take("."):
                node = Node("item", (node, Node("const", (self.name(),))))
            elif self.take("["):
                node = Node("item", (node, self.choice()))
                self.need("]")
            else:
                return node

    def atom(self) -> Node:
        if self.take("("):
            node = self.choice()
            self.need(")")
            return node
        if self.take("-"):
            return Node("op", ("-", Node("const", (0,)), self.member()))
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return Node("const", (float(value) if "." in value else int(value),))
        if kind == "str":
            return Node("const", (re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1]),))
        if kind == "name":
            return Node("const", ({"true": True, "false": False, "none": None}[value],)) if value in ("true", "false", "none") else Node("name", (value,))
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    pieces = [p for p in re.split(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", source, flags=re.S) if p]
    at = 0

    def block(ends: tuple[str, ...]) -> tuple[Node, str]:
        nonlocal at
        nodes: list[Node] = []
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if piece.startswith("{#"):
                continue
            if piece.startswith("{{"):
                nodes.append(Node("show", (Expressions(piece[2:-2]).whole(),)))
            elif not piece.startswith("{%"):
                nodes.append(Node("text", (piece,)))
            else:
                word, _, rest = piece[2:-2].strip(" -").partition(" ")
                if word in ends:
                    return Node("block", tuple(nodes)), piece[2:-2].strip(" -")
                nodes.append(statement(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]} missing")
        return Node("block", tuple(nodes)), ""

    def statement(word: str, rest: str) -> Node:
        if word == "if":
            body, end = block(("elif", "else", "endif"))
            test = Expressions(rest).whole()
            if end.startswith("elif"):
                return Node("if", (test, body, Node("block", (statement("if", end[4:]),))))
            other = block(("endif",))[0] if end == "else" else Node("block")
            return Node("if", (test, body, other))
        if word == "for":
            e = Expressions(rest)
            name = e.name()
            e.need("in")
            return Node("for", (name, e.whole(), block(("endfor",))[0]))
        if word == "set":
            e = Expressions(rest)
            name = e.name()
            e.need("=")
            return Node("set", (name, e.whole()))
        if word == "generation":
            return Node("generation", (block(("endgeneration",))[0],))
        raise TemplateError(f"no statement {word!r}")

    return block(())[0]


def fold(node: Node) -> Node:
    """The tree with constant expressions worked out, dead branches dropped and neighbouring texts joined."""
    parts = tuple(fold(p) if isinstance(p, Node) else p for p in node.parts)
    constant = lambda p: isinstance(p, Node) and p.kind == "const"
    value = lambda p: p.parts[0]
    if node.kind == "op" and constant(parts[1]) and constant(parts[2]):
        return Node("const", (_OPS[parts[0]](value(parts[1]), value(parts[2])),))
    if node.kind == "filter" and constant(parts[1]):
        return Node("const", (FILTERS[parts[0]](value(parts[1])),))
    if node.kind == "not" and constant(parts[0]):
        return Node("const", (not value(parts[0]),))
    if node.kind in ("and", "or") and constant(parts[0]):
        return parts[1] if bool(value(parts[0])) == (node.kind == "and") else parts[0]
    if node.kind in ("choice", "if") and constant(parts[0]):
        return parts[1] if value(parts[0]) else parts[2]
    if node.kind == "show" and constant(parts[0]):
        return Node("text", (_text(value(parts[0])),))
    if node.kind == "block":
        out: list[Node] = []
        for p in parts:
            for q in p.parts if p.kind == "block" else (p,):
                if q.kind == "text" and out and out[-1].kind == "text":
                    out[-1] = Node("text", (out[-1].parts[0] + q.parts[0],))
                elif q.kind != "text" or q.parts[0]:
                    out.append(q)
        return Node("block", tuple(out))
    return Node(node.kind, parts)


def _item(x, key):
    if isinstance(x, dict):
        return x.get(key)
    if isinstance(x, (list, tuple, str)) and isinstance(key, int):
        return x[key] if -len(x) <= key < len(x) else None
    return None if x is None else _refuse("only maps and lists have items")


def value_of(node: Node):
    """Closure names -> value of an expression."""
    kind, p = node.kind, node.parts
    if kind == "const":
        return lambda names, c=p[0]: c
    if kind == "name":
        return lambda names, n=p[0]: names.get(n)
    subs = [value_of(x) if isinstance(x, Node) else x for x in p]
    if kind == "item":
        return lambda names, x=subs[0], k=subs[1]: _item(x(names), k(names))
    if kind == "op":
        return lambda names, f=_OPS[subs[0]], a=subs[1], b=subs[2]: f(a(names), b(names))
    if kind == "filter":
        return lambda names, f=FILTERS[subs[0]], a=subs[1]: f(a(names))
    if kind == "not":
        return lambda names, a=subs[0]: not a(names)
    if kind == "and":
        return lambda names, a=subs[0], b=subs[1]: a(names) and b(names)
    if kind == "or":
        return lambda names, a=subs[0], b=subs[1]: a(names) or b(names)
    if kind == "choice":
        return lambda names, t=subs[0], a=subs[1], b=subs[2]: a(names) if t(names) else b(names)
    raise TemplateError(f"{kind} is no expression")


class Output:
    """Rendered parts, their length in code points, and the spans of generation blocks."""

    def __init__(self):
        self.parts, self.at, self.spans = [], 0, []

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.at += len(text)


def action_of(node: Node):
    """Closure (names, Output) that renders a statement."""
    kind, p = node.kind, node.parts
    if kind == "block":
        steps = [action_of(x) for x in p]
        if len(steps) == 1:
            return steps[0]

        def run(names, out):
            for s in steps:
                s(names, out)

        return run
    if kind == "text":
        return lambda names, out, t=p[0]: out.put(t)
    if kind == "show":
        return lambda names, out, v=value_of(p[0]): out.put(_text(v(names)))
    if kind == "if":
        test, yes, no = value_of(p[0]), action_of(p[1]), action_of(p[2])
        return lambda names, out: (yes if test(names) else no)(names, out)
    if kind == "set":
        value = value_of(p[1])
        return lambda names, out, n=p[0]: names.__setitem__(n, value(names))
    if kind == "for":
        items, body, name = value_of(p[1]), action_of(p[2]), p[0]

        def loop(names, out):
            values = items(names) or []
            inner = dict(names)
            for i, x in enumerate(values):
                inner[name], inner["loop"] = x, {"index": i + 1, "index0": i, "first": i == 0, "last": i + 1 == len(values)}
                body(inner, out)

        return loop
    if kind == "generation":
        body = action_of(p[0])

        def marked(names, out):
            start = out.at
            body(names, out)
            if out.at > start:
                out.spans.append((start, out.at))

        return marked
    raise TemplateError(f"{kind} is no statement")


def compiled(source: str):
    """Template -> function of names that returns (text, generation spans in code points)."""
    action = action_of(fold(parse(source)))

    def render(**names):
        out = Output()
        action(dict(names), out)
        return "".join(out.parts), out.spans

    return render


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in what TEMPLATE rendered."""
    turns = []
    for part in formatted.split("<|turn|>")[1:]:
        role, _, rest = part.partition("<|text|>")
        turns.append((unescape(role), unescape(rest.partition("<|end|>")[0])))
    return turns


def format_chats(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, spans (array of start and end, in code points, of the loss mask), one row a conversation.

    Turns are taken in order of turn, ties by role and then text; turns without number come first. Null text and
    role count as empty. Turns without conversation make one conversation of null id; repeated turns stay turns;
    other columns are ignored; an empty table gives no rows. A conversation is one string, so one task renders it.
    """
    rows = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def run(batches):
        import pyarrow as pa

        render = compiled(template)
        for batch in batches:
            made = [render(messages=turns) for turns in batch.column(1).to_pylist()]
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f for f, _ in made], pa.string()), spans], names=["conv_id", "formatted", "spans"])

    return chats.mapInArrow(run, "conv_id long, formatted string, spans array<struct<start: long, end: long>>")


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted strings and spans say, read back from them."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            ids, rows = batch.column(0), []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
