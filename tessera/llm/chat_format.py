"""Chat formatting by a compiler for a sandboxed template language.

A template's text is parsed into a syntax tree, constants are folded, and the
tree becomes nested Python closures that write pieces of text, each marked as
generated (under the loss mask) or not. The language has {{ expression }},
{% for x in y %}, {% if %}/{% elif %}/{% else %}, {% set x = e %} and
{% generation %}...{% endgeneration %}; expressions have literals, names,
fields, filters, comparisons, and/or/not, + and ~. It reaches nothing but the
given variables' fields and the filters below: no calls, no attributes.

Conversations are streamed: rows are dealt by conversation and sorted, each is
rendered from a one-pass run of messages, and leaves in parts of whole turns of
about PART characters, so that no conversation, however long, is held in memory.

Control strings inside roles and texts are escaped with a backslash, reversibly.

Defined results: null roles and texts are empty; turns go by turn, then role and
text (nulls first); repeated rows are repeated turns; rows with a null conv_id
are one conversation; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

PART = 1_000_000
TURN, GAP, END = "### ", ": ", "</turn>"
TEMPLATE = (
    "{% for message in messages %}### {{ message.role | escape_role }}: "
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}</turn>\n{% endfor %}"
    "{% if add_generation_prompt %}### assistant: {% endif %}"
)
ESCAPED = re.compile(r"\\|###|</turn>")
ROLE_ESCAPED = re.compile(r"\\|###|</turn>|:")
UNESCAPED = re.compile(r"\\(\\|###|</turn>|:)")


def escape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\\" + m[0], text)


def escape_role(text: str) -> str:
    return ROLE_ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return UNESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable[[object], object]] = {"escape": lambda x: escape(str(x)), "escape_role": lambda x: escape_role(str(x)), "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": lambda x: len(str(x))}
MARK = re.compile(r"\{\{-?\s*(.*?)\s*-?\}\}|\{%-?\s*(.*?)\s*-?%\}", re.DOTALL)
WORD = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[.|+~()\[\]]))""")


class TemplateError(ValueError):
    pass


# The syntax tree: ("text", s) ("out", e) ("for", name, e, body) ("if", [(e, body)], else) ("set", name, e)
# ("gen", body); expressions: ("lit", v) ("name", n) ("field", e, key) ("filter", e, f) ("op", o, a, b) ("not", e)


def lex(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    for m in WORD.finditer(source):
        if source[at : m.start()].strip():
            break
        kind = ("str", "int", "name", "op")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
        at = m.end()
    if source[at:].strip():
        raise TemplateError(f"not understood: {source[at:]}")
    return out


class Expression:
    """A parser of one expression, from the weakest binding to the strongest."""

    def __init__(self, source: str):
        self.words, self.at = lex(source), 0

    def peek(self) -> str:
        return self.words[self.at][1] if self.at < len(self.words) else ""

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.words):
            raise TemplateError("the expression ends early")
        self.at += 1
        return self.words[self.at - 1]

    def whole(self) -> tuple:
        e = self.either()
        if self.at < len(self.words):
            raise TemplateError(f"not understood: {self.peek()}")
        return e

    def binary(self, ops: tuple[str, ...], below: Callable[[], tuple]) -> tuple:
        e = below()
        while self.peek() in ops:
            op = self.take()[1]
            e = ("op", op, e, below())
        return e

    def either(self) -> tuple:
        return self.binary(("or",), self.both)

    def both(self) -> tuple:
        return self.binary(("and",), self.negated)

    def negated(self) -> tuple:
        if self.peek() == "not":
            self.take()
            return ("not", self.negated())
        return self.binary(("==", "!="), self.joined)

    def joined(self) -> tuple:
        return self.binary(("+", "~"), self.filtered)

    def filtered(self) -> tuple:
        e = self.single()
        while self.peek() == "|":
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"no such filter: {name}")
            e = ("filter", e, name)
        return e

    def single(self) -> tuple:
        kind, word = self.take()
        if word == "(":
            e = self.either()
            if self.take()[1] != ")":
                raise TemplateError("a bracket isn't closed")
        elif kind == "str":
            e = ("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), word[1:-1]))
        elif kind == "int":
            e = ("lit", int(word))
        elif kind == "name":
            e = ("lit", {"true": True, "false": False, "none": None}[word]) if word in ("true", "false", "none") else ("name", word)
        else:
            raise TemplateError(f"not understood: {word}")
        while self.peek() in (".", "["):
            if self.take()[1] == ".":
                kind, key = self.take()
            else:
                kind, key = self.take()
                key = key[1:-1] if kind == "str" else ""
                if self.take()[1] != "]":
                    raise TemplateError("a bracket isn't closed")
            if not key or key.startswith("_"):
                raise TemplateError("this field can't be reached")
            e = ("field", e, key)
        return e


def parse(source: str) -> list[tuple]:
    """The template's syntax tree."""
    top: list[tuple] = []
    stack: list[tuple[str, list]] = [("", top)]
    at = 0
    for m in chain(MARK.finditer(source), (None,)):
        text = source[at : m.start() if m else len(source)]
        if text:
            stack[-1][1].append(("text", text))
        if m is None:
            break
        at = m.end()
        if m[1] is not None:
            stack[-1][1].append(("out", Expression(m[1]).whole()))
            continue
        word, _, rest = m[2].partition(" ")
        body = stack[-1][1]
        if word == "for":
            f = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.*)", rest.strip(), re.DOTALL)
            if not f:
                raise TemplateError(f"not understood: {m[2]}")
            body.append(("for", f[1], Expression(f[2]).whole(), inner := []))
            stack.append(("endfor", inner))
        elif word == "if":
            body.append(("if", branches := [(Expression(rest).whole(), inner := [])], other := []))
            stack.append(("endif", inner))
        elif word in ("elif", "else") and stack[-1][0] == "endif":
            stack.pop()
            _, branches, other = stack[-1][1][-1]
            if word == "elif":
                branches.append((Expression(rest).whole(), inner := []))
            stack.append(("endif", other if word == "else" else inner))
        elif word == "set":
            name, eq, value = rest.partition("=")
            if not eq or not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
                raise TemplateError(f"not understood: {m[2]}")
            body.append(("set", name.strip(), Expression(value).whole()))
        elif word == "generation":
            body.append(("gen", inner := []))
            stack.append(("endgeneration", inner))
        elif word == stack[-1][0]:
            stack.pop()
        else:
            raise TemplateError(f"not understood: {m[2]}")
    if len(stack) > 1:
        raise TemplateError(f"missing {stack[-1][0]}")
    return top


OPS: dict[str, Callable[[object, object], object]] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: a + b, "~": lambda a, b: f"{a}{b}"}


def fold_expression(e: tuple) -> tuple:
    """e with what is constant computed."""
    if e[0] in ("lit", "name"):
        return e
    if e[0] == "op":
        a, b = fold_expression(e[2]), fold_expression(e[3])
        if a[0] == "lit" and e[1] in ("and", "or"):
            return b if bool(a[1]) == (e[1] == "and") else a
        if a[0] == b[0] == "lit":
            return ("lit", OPS[e[1]](a[1], b[1]))
        return ("op", e[1], a, b)
    inner = fold_expression(e[1])
    if inner[0] == "lit" and e[0] == "not":
        return ("lit", not inner[1])
    if inner[0] == "lit" and e[0] == "filter":
        return ("lit", FILTERS[e[2]](inner[1]))
    return (e[0], inner, *e[2:])


def fold(body: list[tuple]) -> list[tuple]:
    """The tree with constants computed, dead branches gone and neighbouring texts joined."""
    out: list[tuple] = []
    for node in body:
        if node[0] == "out":
            e = fold_expression(node[1])
            node = ("text", str(e[1])) if e[0] == "lit" else ("out", e)
        elif node[0] == "set":
            node = ("set", node[1], fold_expression(node[2]))
        elif node[0] == "for":
            node = ("for", node[1], fold_expression(node[2]), fold(node[3]))
        elif node[0] == "gen":
            node = ("gen", fold(node[1]))
        elif node[0] == "if":
            branches, other = [], fold(node[2])
            for test, inner in node[1]:
                test = fold_expression(test)
                if test[0] == "lit" and test[1]:
                    other = fold(inner)
                    break
                if test[0] != "lit":
                    branches.append((test, fold(inner)))
            if not branches:
                for x in other:
                    add_node(out, x)
                continue
            node = ("if", branches, other)
        add_node(out, node)
    return out


def add_node(out: list[tuple], node: tuple) -> None:
    if node[0] == "text" and out and out[-1][0] == "text":
        out[-1] = ("text", out[-1][1] + node[1])
    elif node != ("text", ""):
        out.append(node)


def value_of(e: tuple) -> Callable[[dict], object]:
    """A closure that computes an expression from the variables."""
    kind = e[0]
    if kind == "lit":
        v = e[1]
        return lambda env: v
    if kind == "name":
        name = e[1]
        return lambda env: env.get(name, "")
    if kind == "field":
        inner, key = value_of(e[1]), e[2]
        return lambda env: x.get(key, "") if isinstance(x := inner(env), dict) else ""
    if kind == "filter":
        inner, f = value_of(e[1]), FILTERS[e[2]]
        return lambda env: f(inner(env))
    if kind == "not":
        inner = value_of(e[1])
        return lambda env: not inner(env)
    a, b = value_of(e[2]), value_of(e[3])
    if e[1] == "and":
        return lambda env: a(env) and b(env)
    if e[1] == "or":
        return lambda env: a(env) or b(env)
    op = OPS[e[1]]
    return lambda env: op(a(env), b(env))


Render = Callable[[dict], Iterator[tuple[str, bool] | None]]


def closure(body: list[tuple], generated: bool = False) -> Render:
    """A closure that renders a tree: given the variables it yields (text, generated), and None after each item of the outer loop."""
    steps = [step(node, generated) for node in body]
    if len(steps) == 1:
        return steps[0]

    def run(env):
        for s in steps:
            yield from s(env)

    return run


def step(node: tuple, generated: bool) -> Render:
    kind = node[0]
    if kind == "text":
        piece = (node[1], generated)
        return lambda env: iter((piece,))
    if kind == "out":
        value = value_of(node[1])
        return lambda env: iter(((str(value(env)), generated),))
    if kind == "gen":
        return closure(node[1], True)
    if kind == "set":
        name, value = node[1], value_of(node[2])

        def assign(env):
            env[name] = value(env)
            return iter(())

        return assign
    if kind == "if":
        tests, other = [(value_of(t), closure(b, generated)) for t, b in node[1]], closure(node[2], generated)
        return lambda env: next((b for t, b in tests if t(env)), other)(env)
    name, items, inner = node[1], value_of(node[2]), closure(node[3], generated)

    def loop(env):
        values, none = iter(items(env) or ()), object()
        item, k, outer = next(values, none), 0, "loop" not in env
        while item is not none:
            after = next(values, none)  # one ahead, so that items may be a stream
            yield from inner(env | {name: item, "loop": {"index": k + 1, "first": k == 0, "last": after is none}})
            item, k = after, k + 1
            if outer:
                yield None

    return loop


def compile_template(source: str) -> Render:
    return closure(fold(parse(source)))


def render_parts(render: Render, messages: Iterable[dict], most: int = PART, **more) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """The formatted conversation in parts of whole turns, each with its spans under the loss mask."""
    held: list[str] = []
    spans: list[tuple[int, int]] = []
    size = 0
    for piece in render({"messages": messages, **more}):
        if piece is None:
            if size > most:
                yield "".join(held), spans
                held, spans, size = [], [], 0
        else:
            text, generated = piece
            if generated and text:
                spans.append((size, size + len(text)))
            held.append(text)
            size += len(text)
    if held:
        yield "".join(held), spans


def read_back(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted part."""
    at = 0
    while text.startswith(TURN, at):
        gap = find(text, GAP, at + len(TURN))
        end = find(text, END, gap + len(GAP))
        yield unescape(text[at + len(TURN) : gap]), unescape(text[gap + len(GAP) : end])
        at = end + len(END) + 1


def find(text: str, mark: str, at: int) -> int:
    """Where the next mark without a backslash begins."""
    while (at := text.find(mark, at)) >= 0:
        back = at
        while back and text[back - 1] == "\\":
            back -= 1
        if (at - back) % 2 == 0:
            return at
        at += 1
    raise ValueError("a turn is not ended")


PARTS = "conv_id long, part long, text string, spans array<struct<begin: long, end: long>>"


def format_chats(rows: DataFrame, template: str = TEMPLATE, most: int = PART) -> DataFrame:
    """conv_id, part, text, spans (under the loss mask, in code points of the part), parts in order.

    A conversation's parts follow each other in one partition, and joined they are its text."""
    chosen = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    dealt = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def flat(it):
        for b in batches(it, 4 << 20):
            for conv, role, text in zip(*(b.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                yield conv, {"role": role or "", "text": text or ""}

    def run(it):
        render, out, size = compile_template(template), [], 0
        for conv, messages in groupby(flat(it), lambda x: x[0]):
            for k, (text, spans) in enumerate(render_parts(render, (m for _, m in messages), most)):
                out.append((conv, k, text, [{"begin": a, "end": z} for a, z in spans]))
                size += len(text)
                if size > 4 * most:
                    yield parts_out(out)
                    out, size = [], 0
        if out:
            yield parts_out(out)

    return dealt.mapInArrow(run, PARTS)


def parts_out(rows: list[tuple]):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "part", "text", "spans"])


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from format_chats's parts."""

    def flat(it):
        for b in batches(it, 8 << 20):
            yield from zip(*(b.column(k).to_pylist() for k in (0, 2, 3)), strict=True)

    def run(it):
        out = []
        for conv, parts in groupby(flat(it), lambda x: x[0]):
            turns, loss, n, masked, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, text, spans in parts:
                size += len(text)
                for role, said in read_back(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for s in spans:
                    said = unescape(text[s["begin"] : s["end"]])
                    loss.update(said.encode())
                    masked += len(said)
            out.append((conv, n, turns.hexdigest(), masked, loss.hexdigest(), size))
            if len(out) >= 5000:
                yield digests_out(out)
                out = []
        if out:
            yield digests_out(out)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digests_out(rows: list[tuple]):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
