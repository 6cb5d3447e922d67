"""Name-literal pairs in source and configuration texts.

A text is cut into tokens: strings of all forms (prefixed, single, double, back-quoted, triple), names, brackets, operators,
line ends and whatever else stands there. Each assignment operator (``=``, ``:``, ``:=``, ``=>``, ``+=``) has a target before it
(a name, a quoted key, or a subscript, whose key is the name; ``name[]`` is the name) and an expression after it: strings,
joined ones too, names of constants, calls, and the elements of brackets. A type between the target and a further ``=`` is
passed over. Further forms are YAML's block scalars, leaf elements of XML, and a key in one pair with its value in the next
(``name: X`` and ``value: y``).

What a name holds is known from its assignment on, inside the block or function that it stands in. Comment signs only end an
expression, so pairs in comments count as well, and a lone quote in one opens no string, as strings in single quotes end with
their line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

NAME = r"[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*"
TOKEN = re.compile(
    rf"""(?ax)
    (?P<triple>(?P<fix3>[A-Za-z]{{0,2}})(?P<mark>\"\"\"|''')(?P<in3>[\s\S]*?)(?P=mark))
    |(?P<double>(?P<fix2>[A-Za-z$@]{{0,2}})"(?P<in2>(?:[^"\\\n]|\\.)*)")
    |(?P<single>(?P<fix1>[A-Za-z]{{0,2}})'(?P<in1>(?:[^'\\\n]|\\.)*)')
    |(?P<back>`(?P<in4>[^`]*)`)
    |(?P<name>{NAME})
    |(?P<op>===|!==|\|\|=|\?\?=|==|!=|<=|>=|=>|=~|:=|\+=|::|:/|//|/\*|\*/|\|\||&&|->|\?\?|[=:+?&.])
    |(?P<open>[(\[{{])
    |(?P<close>[)\]}}])
    |(?P<line>\n)
    |(?P<stop>[,;\#<>|])
    |(?P<bare>[^\s"'`,;()\[\]{{}}=:+<>|\#?&.]+|["'])
    """
)
ASSIGN = frozenset(("=", ":", ":=", "=>", "+=", "||=", "??="))
JOIN = frozenset(("+", "||", "??", "&", "."))
STRINGS = {"triple": ("in3", "fix3"), "double": ("in2", "fix2"), "single": ("in1", "fix1"), "back": ("in4", None)}
#: What an unquoted value of a configuration file may hold.
UNQUOTED = re.compile(r"[^\s\"'`,;)}\]]+")
KEY = re.compile(r"(?a)[\w$.\-/@:]+\Z")
BLOCK = re.compile(r"[\x20\t]*[|>][+\-0-9]{0,2}[\x20\t]*(?:\#[^\n]*)?\n")
ELEMENT = re.compile(rf"(?a)<({NAME})(?:\s[^<>]*)?>([^<>]+)</\1\s*>")
INNER = re.compile(rf"(?a)\$?\{{({NAME})\}}")
#: Calls whose first argument names what is asked for; the second is its default.
GETTERS = frozenset(("get", "getenv", "getproperty", "getstring", "fetch", "env", "environ", "getordefault"))
NAMES_OF = frozenset(("key", "name", "id", "field", "variable"))
VALUES_OF = frozenset(("value", "val", "content", "data", "default"))


class Held:
    """What a name holds: spans of literals, and what other names held when they were joined in, shared and not copied."""

    __slots__ = ("spans", "parts", "reached")

    def __init__(self) -> None:
        self.spans: list[tuple[int, int]] = []
        self.parts: list[Held] = []
        self.reached = 0.0  # the greatest weight of a target that these literals have reached


class Source:
    """A text's tokens: kind, begin, end, and the place of each bracket's partner."""

    def __init__(self, text: str):
        self.text = text
        self.kind: list[str] = []
        self.begin: list[int] = []
        self.end: list[int] = []
        self.inner: dict[int, tuple[int, int, str]] = {}
        self.partner: dict[int, int] = {}
        opened: list[int] = []
        for m in TOKEN.finditer(text):
            kind = m.lastgroup
            # the last group is the outermost one that matched last: inner groups of strings close before it
            i = len(self.kind)
            if kind in STRINGS:
                inside, fix = STRINGS[kind]
                self.inner[i] = (*m.span(inside), (m[fix] or "").lower() if fix else "`")
                kind = "string"
            elif kind == "open":
                opened.append(i)
            elif kind == "close" and opened:
                j = opened.pop()
                self.partner[j], self.partner[i] = i, j
            self.kind.append(kind)
            self.begin.append(m.start())
            self.end.append(m.end())

    def __len__(self) -> int:
        return len(self.kind)

    def word(self, i: int) -> str:
        return self.text[self.begin[i] : self.end[i]]

    def is_op(self, i: int, words: frozenset[str]) -> bool:
        return 0 <= i < len(self.kind) and self.kind[i] == "op" and self.word(i) in words

    def is_open(self, i: int, sign: str) -> bool:
        return i < len(self.kind) and self.kind[i] == "open" and self.text[self.begin[i]] == sign


class Scopes:
    """What names hold, innermost block first."""

    def __init__(self) -> None:
        self.all: list[dict[str, Held]] = [{}]

    def get(self, name: str) -> Held | None:
        for known in reversed(self.all):
            if name in known:
                return known[name]
        return None

    def put(self, name: str, held: Held) -> None:
        if held.spans or held.parts:
            self.all[-1][name] = held
        else:
            self.all[-1].pop(name, None)


def pairs(text: str) -> Iterator[tuple[str, Held]]:
    """(target's name, what it is given) of each assignment, in the order of the text."""
    source, scopes = Source(text), Scopes()
    ends: list[tuple[str, int]] = []  # what ends each inner scope: a bracket's place, or the indent of a function's line
    pending, depth = None, 0
    for i in range(len(source)):
        kind = source.kind[i]
        if kind == "open":
            depth += 1
            if _opens_block(source, i):
                scopes.all.append({})
                ends.append(("bracket", source.partner.get(i, len(source))))
        elif kind == "close":
            depth = max(0, depth - 1)
            while ends and ends[-1] == ("bracket", i):
                ends.pop()
                scopes.all.pop()
        elif kind == "line":
            if depth == 0 and i + 1 < len(source) and source.kind[i + 1] not in ("line", "stop"):
                indent = source.begin[i + 1] - source.end[i]
                while ends and ends[-1][0] == "indent" and indent <= ends[-1][1]:
                    ends.pop()
                    scopes.all.pop()
        elif kind == "name" and source.word(i) in ("def", "class") and (i == 0 or source.kind[i - 1] == "line" or source.word(i - 1) == "async"):
            first = i if i == 0 or source.kind[i - 1] == "line" else i - 1
            scopes.all.append({})
            ends.append(("indent", source.begin[first] - (source.end[first - 1] if first else 0)))
        elif kind == "op" and source.word(i) in ASSIGN:
            name = _target(source, i - 1)
            if name is None:
                continue
            held, only = _value(source, i, scopes)
            scopes.put(name, held)
            yield name, held
            if pending is not None and name.lower() in VALUES_OF:
                yield pending, held
            pending = only if name.lower() in NAMES_OF else None
    if "</" in text:
        for m in ELEMENT.finditer(text):
            held = Held()
            _lines(held, text, *m.span(2))
            yield m[1], held


def _opens_block(source: Source, i: int) -> bool:
    """Whether a brace opens a block of statements, not a literal."""
    if source.text[source.begin[i]] != "{":
        return False
    j = i - 1
    while j >= 0 and source.kind[j] == "line":
        j -= 1
    return j >= 0 and (source.word(j) in (")", "=>", "else", "try", "do", "finally"))


def _target(source: Source, j: int) -> str | None:
    if j < 0:
        return None
    if source.kind[j] == "name":
        return source.word(j)
    if source.kind[j] == "string":
        a, b, _ = source.inner[j]
        return source.text[a:b] if KEY.match(source.text, a, b) else None
    if source.kind[j] == "close" and source.text[source.begin[j]] == "]" and (k := source.partner.get(j)) is not None and k > 0:
        if j - k == 2 and source.kind[k + 1] == "string":
            a, b, _ = source.inner[k + 1]
            return source.text[a:b] if KEY.match(source.text, a, b) else None
        if j - k <= 2 and source.kind[k - 1] == "name":
            return source.word(k - 1)
    return None


def _lines(held: Held, text: str, a: int, b: int) -> None:
    """A literal's span, or those of its lines without the blanks around them."""
    while a <= b:
        stop = text.find("\n", a, b)
        stop = b if stop < 0 else stop
        low, high = a, stop
        while low < high and text[low].isspace():
            low += 1
        while high > low and text[high - 1].isspace():
            high -= 1
        if high > low:
            held.spans.append((low, high))
        a = stop + 1


def _literal(source: Source, i: int, held: Held, scopes: Scopes) -> None:
    a, b, fix = source.inner[i]
    text = source.text
    if "\n" in text[a:b]:
        _lines(held, text, a, b)
    elif b > a:
        held.spans.append((a, b))
    if fix == "`" or "f" in fix or "$" in fix:
        for m in INNER.finditer(text, a, b):
            if known := scopes.get(m[1]):
                held.parts.append(known)


def _call(source: Source, i: int, held: Held, scopes: Scopes) -> int:
    """The string arguments of the call of name i, those of calls among them too; the place after its bracket."""
    def frame(k: int) -> list:
        return [source.partner.get(k + 1, len(source)), source.word(k).rsplit(".", 1)[-1].lower() in GETTERS, 0]

    calls = [frame(i)]
    j, end = i + 2, calls[0][0]
    while calls:
        stop, getter, argument = calls[-1]
        if j >= stop:
            calls.pop()
            j = stop + 1
            continue
        kind = source.kind[j]
        if kind == "stop" and source.text[source.begin[j]] == ",":
            calls[-1][2] += 1
        elif source.is_op(j + 1, ASSIGN) and kind in ("name", "string"):
            j += 2  # a named argument is a pair of its own
            while j < stop and not (source.kind[j] == "stop" and source.text[source.begin[j]] == ","):
                j = source.partner.get(j, stop) + 1 if source.kind[j] == "open" else j + 1
            continue
        elif kind == "string" and not (getter and argument == 0):
            _literal(source, j, held, scopes)
        elif kind == "name" and source.is_open(j + 1, "("):
            calls.append(frame(j))
            j += 1
        elif kind == "name" and (known := scopes.get(source.word(j))):
            held.parts.append(known)
        elif kind == "open":
            j = source.partner.get(j, stop)
        j += 1
    return end + 1


def _value(source: Source, i: int, scopes: Scopes) -> tuple[Held, str | None]:
    """What the expression after operator i holds; its text if it is one plain string or word."""
    text, held, only = source.text, Held(), None
    if source.word(i) == ":" and (block := BLOCK.match(text, source.end[i])):
        start = text.rfind("\n", 0, source.begin[i]) + 1
        indent, at = _indent(text, start), block.end()
        while at < len(text):
            stop = text.find("\n", at)
            stop = len(text) if stop < 0 else stop
            if text[at:stop].strip() and _indent(text, at) <= indent:
                break
            _lines(held, text, at, stop)
            at = stop + 1
        return held, None
    j, depth, joined, n = i + 1, 0, True, len(source)
    while j < n:
        kind = source.kind[j]
        if kind == "line":
            if depth or (joined and j > i + 1):
                j += 1
                continue
            break
        if kind == "open":
            depth, joined = depth + 1, True
        elif kind == "close":
            depth, joined = depth - 1, False
            if depth < 0:
                break
        elif kind == "string":
            if source.is_op(j + 1, ASSIGN) and not (source.is_op(j + 1, frozenset("=")) and depth == 0):
                break  # a key: a pair of its own begins here
            _literal(source, j, held, scopes)
            a, b, _ = source.inner[j]
            only, joined = text[a:b] if only is None else "", False
        elif not joined and not (kind == "op" or kind == "stop"):
            break
        elif kind == "name":
            j, word = _named(source, j, i, held, scopes)
            if j < 0:
                break
            only, joined = word if only is None else "", False
            continue
        elif kind == "op" and source.word(j) in JOIN:
            joined = True
        elif kind == "stop" and text[source.begin[j]] == "," and depth:
            joined = True
        elif kind == "bare" and text[source.begin[j]] == "\\":
            joined = True  # the line goes on
        elif joined and kind in ("bare", "op", "stop") and text[source.begin[j]] not in ",;<>" and source.word(j) not in ("//", "/*", "*/", "#"):
            j = _unquoted(source, j, held)
            joined = False
            continue
        else:
            break
        j += 1
    return held, only or None


def _indent(text: str, start: int) -> int:
    at = start
    while at < len(text) and text[at] in " \t-":
        at += 1
    return at - start


def _unquoted(source: Source, j: int, held: Held) -> int:
    """A run of signs without quotes as one literal; the place after it."""
    m = UNQUOTED.match(source.text, source.begin[j])
    stop = m.end() if m else source.end[j]
    if m:
        held.spans.append(m.span())
    while j < len(source) and source.begin[j] < stop:
        j += 1
    return j


def _named(source: Source, j: int, i: int, held: Held, scopes: Scopes) -> tuple[int, str]:
    """A name in the expression after operator i: what it holds, what its call is given, or itself. The place after it, -1 where
    a pair of its own begins."""
    word, text = source.word(j), source.text
    if source.is_open(j + 1, "("):
        return _call(source, j, held, scopes), ""
    stop = j + 1
    if source.is_open(stop, "[") and stop in source.partner:
        stop = source.partner[stop] + 1
    if source.is_op(stop, ASSIGN):
        # a type, or a further target of the same value
        return (stop + 1, "") if source.word(stop) == "=" and j == i + 1 else (-1, "")
    if stop > j + 1:
        if stop - j == 4 and source.kind[j + 2] == "string":
            a, b, _ = source.inner[j + 2]
            if known := scopes.get(text[a:b]):
                held.parts.append(known)
        return stop, ""
    if known := scopes.get(word):
        held.parts.append(known)
        return j + 1, word
    after = text[source.end[j] : source.end[j] + 1]
    if after and after not in "+([|.?:" and UNQUOTED.match(after):  # an unquoted value that only begins like a name
        return _unquoted(source, j, held), ""
    held.spans.append((source.begin[j], source.end[j]))
    return j + 1, word
