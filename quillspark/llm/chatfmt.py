r"""Operator 6: chat formatting by a template compiler.

A template is text with `{{ expression }}` and `{% statement %}` tags. It is parsed into a syntax tree, constants are
folded (constant expressions, dead branches, neighbouring texts), and the tree becomes nested Python closures. The
language is a sandbox: names, dotted fields of mappings, string and integer constants, `+`, comparisons, `and`, `or`,
`not`, the filters of FILTERS, `for`, `if`/`elif`/`else` and `generation`; nothing else can be reached from a template.

`{% generation %} ... {% endgeneration %}` marks what the model is to learn: rendering gives the text and the code
point spans under the loss mask.

Turn marks are control strings. Inside texts and roles a backslash is put before every control string and every
backslash, so formatting is reversible: `parse_chat` reads roles, texts and mask back from the formatted text.

Defined results: a null text or role is empty; turns are ordered by (turn, role, text), nulls first; repeated rows are
repeated turns; a null conv_id is one conversation; an empty table gives an empty result; other columns are ignored.
A conversation is streamed turn by turn through sorted partitions, never gathered into an array by the engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, COLON = "### ", " </turn>\n", ": "
#: Control strings; an escaped text never holds one without a backslash before it.
CONTROLS = ("###", "</turn>")
_ESCAPE = re.compile(r"\\|###|</turn>")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>|:)")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    """A role also escapes the colon that would end it."""
    return escape(role).replace(":", "\\:")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


FILTERS: dict[str, Callable[[str], str]] = {
    "trim": str.strip,
    "upper": str.upper,
    "lower": str.lower,
    "capitalize": lambda s: s[:1].upper() + s[1:],
    "escape": escape,
    "escape_role": escape_role,
}


class TemplateError(ValueError):
    pass


# Syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    parts: tuple[str, ...]


@dataclass(frozen=True)
class Apply:
    op: str
    args: tuple


@dataclass(frozen=True)
class Out:
    value: Any


@dataclass(frozen=True)
class Block:
    items: tuple


@dataclass(frozen=True)
class If:
    test: Any
    then: Any
    other: Any


@dataclass(frozen=True)
class For:
    name: str
    source: Any
    body: Any


@dataclass(frozen=True)
class Generation:
    body: Any


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[.+|()]))")
_WORDS = {"and", "or", "not", "true", "false"}


class _Expression:
    """Recursive descent over one expression: or, and, not, comparison, sum, filters, atoms."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted and self.at < len(self.tokens) and self.tokens[self.at][0] != "str":
            self.at += 1
            return True
        return False

    def whole(self):
        value = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()!r}")
        return value

    def either(self):
        value = self.both()
        while self.take("or"):
            value = Apply("or", (value, self.both()))
        return value

    def both(self):
        value = self.negated()
        while self.take("and"):
            value = Apply("and", (value, self.negated()))
        return value

    def negated(self):
        return Apply("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        value = self.summed()
        for op in ("==", "!="):
            if self.take(op):
                return Apply(op, (value, self.summed()))
        return value

    def summed(self):
        value = self.filtered()
        while self.take("+"):
            value = Apply("+", (value, self.filtered()))
        return value

    def filtered(self):
        value = self.atom()
        while self.take("|"):
            name = self.peek()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            value = Apply("|" + name, (value,))
        return value

    def atom(self):
        if self.take("("):
            value = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket is not closed")
            return value
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(text))
        if kind != "name" or text in _WORDS - {"true", "false"}:
            raise TemplateError(f"unexpected {text!r}")
        if text in ("true", "false"):
            return Const(text == "true")
        parts = [text]
        while self.take("."):
            kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or text.startswith("_"):
                raise TemplateError(f"no field {text!r}")
            self.at += 1
            parts.append(text)
        return Name(tuple(parts))


def parse(source: str) -> Block:
    """The syntax tree of a template."""
    pieces: list[tuple[str, str]] = []
    at = 0
    for m in _TAG.finditer(source):
        pieces.append(("text", source[at : m.start()]))
        pieces.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    pieces.append(("text", source[at:]))
    place = 0

    def block(*ends: str) -> tuple[Block, str]:
        nonlocal place
        items: list[Any] = []
        while place < len(pieces):
            kind, text = pieces[place]
            place += 1
            if kind == "text":
                items.append(Out(Const(text)))
            elif kind == "out":
                items.append(Out(_Expression(text).whole()))
            else:
                word, _, rest = text.partition(" ")
                if word in ends:
                    return Block(tuple(items)), text
                if word == "for":
                    m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError(f"cannot read {text!r}")
                    body, _ = block("endfor")
                    items.append(For(m[1], _Expression(m[2]).whole(), body))
                elif word == "if":
                    items.append(branch(rest))
                elif word == "generation":
                    body, _ = block("endgeneration")
                    items.append(Generation(body))
                else:
                    raise TemplateError(f"unexpected tag {text!r}")
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return Block(tuple(items)), ""

    def branch(test: str) -> If:
        then, end = block("elif", "else", "endif")
        if end.startswith("elif"):
            return If(_Expression(test).whole(), then, branch(end[4:]))
        other = block("endif")[0] if end == "else" else Block(())
        return If(_Expression(test).whole(), then, other)

    return block()[0]


def _same(op: str, *args: Any) -> Any:
    match op:
        case "+":
            return args[0] + args[1] if all(isinstance(a, int) for a in args) else _text(args[0]) + _text(args[1])
        case "==":
            return args[0] == args[1]
        case "!=":
            return args[0] != args[1]
        case "and":
            return args[0] and args[1]
        case "or":
            return args[0] or args[1]
        case "not":
            return not args[0]
    return FILTERS[op[1:]](_text(args[0]))


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def fold(node: Any) -> Any:
    """Constant expressions become constants, dead branches go, neighbouring texts join."""
    match node:
        case Apply(op, args):
            args = tuple(map(fold, args))
            if all(isinstance(a, Const) for a in args):
                return Const(_same(op, *(a.value for a in args)))
            if op in ("and", "or") and isinstance(args[0], Const):
                return args[1] if bool(args[0].value) == (op == "and") else args[0]
            return Apply(op, args)
        case Out(value):
            return Out(fold(value))
        case If(test, then, other):
            test = fold(test)
            if isinstance(test, Const):
                return fold(then if test.value else other)
            return If(test, fold(then), fold(other))
        case For(name, source, body):
            return For(name, fold(source), fold(body))
        case Generation(body):
            return Generation(fold(body))
        case Block(items):
            out: list[Any] = []
            for item in map(fold, items):
                for part in item.items if isinstance(item, Block) else (item,):
                    if isinstance(part, Out) and isinstance(part.value, Const):
                        text = _text(part.value.value)
                        if out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                            out[-1] = Out(Const(out[-1].value.value + text))
                        elif text:
                            out.append(Out(Const(text)))
                    else:
                        out.append(part)
            return Block(tuple(out))
    return node


class Sink:
    """Text so far and the spans under the loss mask, in code points."""

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _value(node: Any) -> Callable[[dict], Any]:
    match node:
        case Const(value):
            return lambda scope: value
        case Name(parts):
            head, rest = parts[0], parts[1:]

            def look(scope: dict) -> Any:
                found = scope.get(head)
                for part in rest:
                    found = found.get(part) if isinstance(found, dict) else None
                return found

            return look
        case Apply(op, args):
            if op == "and":
                a, b = map(_value, args)
                return lambda scope: a(scope) and b(scope)
            if op == "or":
                a, b = map(_value, args)
                return lambda scope: a(scope) or b(scope)
            made = [_value(a) for a in args]
            return lambda scope: _same(op, *(f(scope) for f in made))
    raise TemplateError(f"not an expression: {node!r}")


def _renderer(node: Any) -> Callable[[dict, Sink], None]:
    match node:
        case Out(Const(value)):
            text = _text(value)
            return lambda scope, sink: sink.write(text)
        case Out(value):
            get = _value(value)
            return lambda scope, sink: sink.write(_text(get(scope)))
        case Block(items):
            made = [_renderer(i) for i in items]

            def run(scope: dict, sink: Sink) -> None:
                for f in made:
                    f(scope, sink)

            return run
        case If(test, then, other):
            check, yes, no = _value(test), _renderer(then), _renderer(other)
            return lambda scope, sink: yes(scope, sink) if check(scope) else no(scope, sink)
        case For(name, source, body):
            rows, inner = _value(source), _renderer(body)

            def loop(scope: dict, sink: Sink) -> None:
                for item in rows(scope) or ():
                    inner({**scope, name: item}, sink)

            return loop
        case Generation(body):
            inner = _renderer(body)

            def learn(scope: dict, sink: Sink) -> None:
                start = sink.size
                inner(scope, sink)
                sink.spans.append((start, sink.size))

            return learn
    raise TemplateError(f"cannot render {node!r}")


def compile_template(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from variables to (text, learnt spans)."""
    render = _renderer(fold(parse(source)))

    def run(scope: dict) -> tuple[str, list[tuple[int, int]]]:
        sink = Sink()
        render(scope, sink)
        return "".join(sink.parts), sink.spans

    return run


#: One turn. Only the assistant's own text is learnt.
TURN = (
    "{{ '### ' + (message.role | escape_role) + ': ' }}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}{{ ' </turn>\\n' }}"
)
TEMPLATE = "{% for message in messages %}" + TURN + "{% endfor %}"

_TURN = re.compile(r"### ((?:[^\\:]+|\\.)*): ((?:[^\\<]+|\\.|<(?!/turn>))*) </turn>\n", re.S)


def parse_chat(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn, read back from the formatted text; start and end place the escaped text."""
    found, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        found.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return found


def format_conversations(rows: DataFrame, turn_template: str = TURN) -> DataFrame:
    """One row a turn, in order: conv_id, turn_no, formatted (that turn's text), start, end (learnt span within it, or null).

    A conversation's formatted text is its turns' texts joined; sorted partitions keep a conversation's turns together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(turn_template)
        last, number = object(), 0
        for batch in batches:
            conv, role, text = (batch.column(i).to_pylist() for i in (0, 2, 3))
            out: dict[str, list] = {k: [] for k in ("conv_id", "turn_no", "formatted", "start", "end")}
            for c, r, t in zip(conv, role, text, strict=True):
                number = number + 1 if c == last else 0
                last = c
                formatted, spans = render({"message": {"role": r or "", "text": t or ""}})
                for key, value in zip(out, (c, number, formatted, spans[0][0] if spans else None, spans[0][1] if spans else None), strict=True):
                    out[key].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k == "formatted" else pa.int64()) for k, v in out.items()], list(out))

    ordered = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id bigint, turn_no bigint, formatted string, start bigint, end bigint")


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Read conversations back from the output of format_conversations (in its order) and digest what is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        def result() -> pa.RecordBatch:
            names = [f.split()[0] for f in DIGEST.split(", ")]
            values = [conv, turns, whole.hexdigest(), loss_chars, loss.hexdigest(), chars]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.string() if isinstance(v, str) else pa.int64()) for v in values], names)

        conv, begun = None, False
        turns = loss_chars = chars = 0
        whole, loss = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            for c, number, text, start, end in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if number == 0:
                    if begun:
                        yield result()
                    conv, begun = c, True
                    turns = loss_chars = chars = 0
                    whole, loss = hashlib.sha256(), hashlib.sha256()
                chars += len(text)
                for role, said, _, _ in parse_chat(text):
                    turns += 1
                    whole.update(f"{role}\n{said}\n".encode())
                if start is not None:
                    learnt = unescape(text[start:end])
                    loss_chars += len(learnt)
                    loss.update(learnt.encode())
        if begun:
            yield result()

    return formatted.mapInArrow(run, DIGEST)
