"""Secret scan: fixed patterns, and assignment-aware lexing that scores literals by the names they are given to.

The lexer makes one pass over source and configuration syntax, keeping track of quotes and comments, and yields name-literal
pairs: assignments, object and element entries, attributes, unquoted configuration values, arguments of calls. What stands in
a comment is read in a scope of its own, what stands in a literal in another. Constants propagate over the bindings, whatever
their order: a name bound to a literal, to another name, or to a sum of both stands for those literals, at any depth
and in any number. A literal's score is the sensitivity of the most sensitive name it reaches times how much it
looks like a secret (length, entropy, no placeholder); non-empty spans of 0.5 or more are added, kind `literal`, unless a base
span covers them. Row by row; nothing is shuffled.

Defined results: a null text is an empty one: no spans, empty strings. Null and repeated doc_ids are rows
like any other. Extra columns are ignored. Positions are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfield.llm.common import ship

KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 0.5
#: Characters of a literal at least.
LEAST = 8

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Hex digits of a Latin-1-like image of the text become h: a run of 32 is then a plain search.
_HEX_TABLE = bytes(104 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_RUN = b"h" * 32

#: What parts of a name say about its value.
NAME_PARTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 1.0, "pwd": 1.0, "pass": 0.8, "secret": 1.0, "token": 0.9,
    "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "auth": 0.6, "authorization": 0.7, "bearer": 0.8, "key": 0.5, "signature": 0.6,
    "salt": 0.6, "cookie": 0.5, "dsn": 0.6, "pin": 0.5,
}
#: Parts that make a following or leading "key" sensitive, and parts that say it is not.
KEY_PARTS = {"api", "private", "access", "secret", "signing", "encryption", "master", "account", "storage", "client", "auth", "ssh", "service"}
HARMLESS_PARTS = {"public", "name", "id", "file", "path", "url", "type", "length", "size", "count", "field", "label", "hint", "expiry", "ttl", "policy", "limit"}
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|<.*>|\$\{?.*\}?|%\(?.*|\{\{.*\}\}|(?:your|my|the|some|change|replace|insert|enter|example|sample|dummy|test|todo|none|null|undefined|true|false|password|secret|token)[\w\s-]*)$")

#: Openers of regions come first: what closes them is looked for by itself, so that one that never closes costs one search.
_TOKEN = re.compile(
    r"""(?P<open>/\*|<!--|\"\"\"|\'\'\')
    |(?P<line>(?<![^\s;{}(\[,])(?://|\#(?!\{)))
    |(?P<text>(?:(?<!\w)[bBrRuUfFlL]{1,2})?"(?:\\.|[^"\\\n])*+"(?!\w)
        |(?:(?<!\w)[bBrRuUfFlL]{1,2}|(?<!\w))'(?:\\.|[^'\\\n])*+'(?!\w)
        |`[^`\n]*+`)
    |(?P<name>[A-Za-z_][\w.-]*+)
    |(?P<sign>:=|=>|\+=|\.=|===?|!==?|<=|>=|->|::|=|:)
    |(?P<mark>\|\||\?\?|\.\.|[()\[\]{}<>,;+.|&?%\n])""",
    re.X,
)
_CLOSERS = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
_BINDS = {":=", "=>", "=", ":", "+=", ".="}
_JOINS = {"+", "||", "??", "..", ".", "|", "&", "?", "%"}
#: Words between operands, and parts of a call's name that say that its first argument names what it looks up.
_BETWEEN = {"or", "and", "not", "if", "else", "new", "await", "return"}
_LOOKUPS = {"get", "getenv", "env", "environ", "read", "load", "fetch", "lookup", "input", "prompt", "ask", "find", "require", "import"}
_KEY = re.compile(r"[A-Za-z_][\w.\- ]*")
_BARE = re.compile(r"""[ \t]*(?P<value>[^\s"'`<>{}\[\]();,]{8,})""")
_LINE_END = re.compile(r"[ \t]*;?\r?(?:\n|$)")
_TIGHT_END = re.compile(r"""[;&\s"'`]|$""")
_ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.:-]*)[^<>\n]*>(?P<value>[^<>\n]{8,})</(?P=name)>")
#: A text without any of these has no sensitive name.
_MAYBE = re.compile(r"(?i)pass|pwd|secret|token|credential|key|auth|bearer|signature|salt|cookie|dsn|pin")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_score(name: str) -> float:
    """0 to 1: how much a target name says that its value is secret."""
    parts = [p.lower() for p in _CAMEL.findall(name)]
    if not parts or parts[-1] in HARMLESS_PARTS or "public" in parts:
        return 0.0
    best = max((NAME_PARTS.get(p, 0.0) for p in parts), default=0.0)
    if "key" in parts or "keys" in parts:
        best = max(best, 1.0 if KEY_PARTS & set(parts) else 0.5)
    return best


class _Value:
    """What a literal, or a sum of them, looks like: length, counts of characters, spaces, whether all is a placeholder or lower-case letters."""

    __slots__ = ("counts", "lower", "n", "placeholder", "spaces")

    def __init__(self, text: str | None = None):
        self.n = float(len(text or ""))
        self.counts: dict[str, float] = dict(Counter(text or ""))
        self.spaces = (text or "").count(" ")
        self.placeholder = not text or bool(_PLACEHOLDER.match(text))
        self.lower = not text or (text.isalpha() and text.islower())

    def add(self, other: _Value) -> None:
        self.n += other.n
        for c, k in other.counts.items():
            self.counts[c] = self.counts.get(c, 0.0) + k
        if self.n > 1e200:  # a sum of itself, many times over: shares are what counts
            self.n *= 1e-150
            self.counts = {c: k * 1e-150 for c, k in self.counts.items()}
        self.spaces = max(self.spaces, other.spaces)
        self.placeholder &= other.placeholder
        self.lower &= other.lower

    def score(self) -> float:
        """0 to 1: how much it looks like a secret."""
        if self.n < LEAST or self.placeholder or self.spaces > 2:
            return 0.0
        entropy = -sum(k / self.n * math.log2(k / self.n) for k in self.counts.values() if k)
        score = min(1.0, max(0.0, (entropy - 1.5) / 1.5))
        return score * (0.6 if self.lower else 1.0) * (0.7 if self.spaces else 1.0)

    def mixed(self) -> bool:
        return any(map(str.isdigit, self.counts)) and any(map(str.isalpha, self.counts))


def literal_score(value: str) -> float:
    """0 to 1: how much a literal looks like a secret."""
    return _Value(value).score()


@dataclass
class Binding:
    """name <- operands in a scope: (start, end, "") of literals and (-1, -1, name) of names.

    pair: told by its place alone. bare: the unquoted value that the names are if none of them is bound.
    """

    scope: int
    name: str
    operands: list[tuple[int, int, str]]
    pair: bool = False
    bare: tuple[int, int] | None = None


class _Lexer:
    """Tokens of a text and the bindings they make. Comments are a scope of their own (1); so is the inside of each literal."""

    def __init__(self, text: str):
        self.text = text
        self.bindings: list[Binding] = []
        # (start, end, scope, openers and quotes that still count)
        todo = [(0, len(text), 0, frozenset("\"'`#") | {"/*", "<!--", '"""', "'''"})]
        scopes = 1
        while todo:
            start, end, scope, live = todo.pop()
            tokens, inner = self._tokens(start, end, live)
            self._bind(tokens, scope, start, end)
            for a, b, mark in inner:
                if mark in ("/*", "<!--", "#"):
                    todo.append((a, b, 1, live - {"/*", "<!--", "#"}))
                elif b - a >= LEAST and ("=" in text[a:b] or ":" in text[a:b]):
                    scopes += 1
                    todo.append((a, b, scopes, live - {"/*", "<!--", "#", mark}))
        for m in _ELEMENT.finditer(text):
            self.bindings.append(Binding(0, m["name"], [(m.start("value"), m.end("value"), "")]))

    def _tokens(self, start: int, end: int, live: frozenset[str]) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, str]]]:
        """(kind, start, end), S being literals without their quotes; and the regions to be lexed by themselves."""
        text, at, out, inner, never = self.text, start, [], [], set()
        while m := _TOKEN.search(text, at, end):
            at = m.end()
            kind, a = m.lastgroup, m.start()
            if kind == "open":
                mark = m[0]
                close = -1 if mark in never or mark not in live else text.find(_CLOSERS[mark], at, end)
                if close < 0:
                    never.add(mark)
                    at = a + (1 if mark[0] in "\"'" else len(mark))
                    continue
                inner.append((at, close, mark))
                if mark[0] in "\"'":
                    out.append(("S", at, close))
                at = close + 3 if mark[0] in "\"'" else close + len(_CLOSERS[mark])
            elif kind == "line":
                if "#" in live:
                    close = text.find("\n", at, end)
                    close = end if close < 0 else close
                    inner.append((at, close, "#"))
                    at = close
            elif kind == "text":
                q = text[at - 1]
                if q in live:
                    a = text.index(q, a) + 1
                    out.append(("S", a, at - 1))
                    inner.append((a, at - 1, q))
                else:
                    at = a + 1
            elif kind == "name":
                out.append(("N", a, at))
            elif kind == "sign":
                out.append(("=" if m[0] in _BINDS else "!", a, at))
            else:
                out.append((m[0], a, at))
        return out, inner

    def _bind(self, tokens: list[tuple[str, int, int]], scope: int, start: int, end: int) -> None:
        text, n, found = self.text, len(tokens), self.bindings
        kind = lambda i: tokens[i][0] if i < n else ""
        chain: list[str] = []
        chained = -1
        attribute = ""
        for i, (k, a, b) in enumerate(tokens):
            if k not in ("N", "S"):
                continue
            word = text[a:b]
            if k == "S" and not (b - a <= 200 and _KEY.fullmatch(word)):
                continue
            sign = i + 1
            while kind(sign) in ("]", "?") and sign - i < 3:
                sign += 1
            if kind(sign) != "=":
                if k == "N" and kind(i + 1) == "(" and name_score(word) > 0:
                    found.append(Binding(scope, word, self._operands(tokens, i + 2, word)))
                elif k == "S" and kind(i + 1) == "," and kind(i + 2) == "S" and kind(i + 3) != "=" and name_score(word) > 0:
                    found.append(Binding(scope, word, [(tokens[i + 2][1], tokens[i + 2][2], "")], True))
                continue
            if chained != i:
                chain = []
            first = sign + 1
            # a = b = "...", and a: type = "..."
            if kind(first) == "N" and kind(first + 1) == "=":
                chain.append(word)
                chained = first
                continue
            if text[tokens[sign][1]] == ":":
                t = first
                while kind(t) in ("N", "[", "]", "|", "<", ">", ".", "?", ","):
                    t += 1
                if t > first and kind(t) == "=" and text[tokens[t][1] : tokens[t][2]] == "=" and kind(t - 1) != ",":
                    first = t + 1
            operands = self._operands(tokens, first)
            bare = None if any(x[0] >= 0 for x in operands) else self._bare(self._begins_line(tokens, i, start), tokens[sign], end)
            if text[tokens[sign][1]] in "+." and tokens[sign][2] - tokens[sign][1] == 2:
                operands = [(-1, -1, word), *operands]
            for name in [*chain, word]:
                found.append(Binding(scope, name, operands, bare=bare))
            # <add key="..." value="..."/>
            low = word.lower()
            if low in ("value", "val", "content") and attribute:
                found.append(Binding(scope, attribute, operands))
            attribute = text[operands[0][0] : operands[0][1]] if low in ("name", "key", "id") and len(operands) == 1 and operands[0][0] >= 0 else ""

    def _begins_line(self, tokens: list[tuple[str, int, int]], i: int, start: int) -> bool:
        """Whether only blanks, dashes, or a word like export stand before a token on its line."""
        while i >= 0:
            before = tokens[i - 1] if i else ("\n", start, start)
            if self.text[before[2] : tokens[i][1]].strip(" \t-\"'"):
                return False
            if before[0] == "\n":
                return True
            if before[0] != "N" or self.text[before[1] : before[2]] not in ("export", "set"):
                return False
            i -= 1
        return True

    def _bare(self, begins: bool, sign: tuple[str, int, int], end: int) -> tuple[int, int] | None:
        """An unquoted value: the rest of a configuration line, or what stands close behind an equals sign."""
        text = self.text
        m = _BARE.match(text, sign[2], end)
        if not m:
            return None
        word = re.fullmatch(r"[A-Za-z_.]+", m["value"])
        if begins and _LINE_END.match(text, m.end(), end):
            return None if word and "." in m["value"] else m.span("value")
        value = m["value"].split("&")[0].split(";")[0]
        tight = text[sign[1] : sign[2]] == "=" and not text[sign[1] - 1].isspace() and m.start("value") == sign[2]
        fits = tight and len(value) >= LEAST and not word and _TIGHT_END.match(text, sign[2] + len(value), end)
        return (sign[2], sign[2] + len(value)) if fits else None

    def _operands(self, tokens: list[tuple[str, int, int]], i: int, call: str = "") -> list[tuple[int, int, str]]:
        """The literals and names of a value; up to the next binding, wherever that begins."""
        text, n, out = self.text, len(tokens), []
        kind = lambda j: tokens[j][0] if j < n else ""
        # open brackets: whether the first argument is to be left out, and the number of the argument
        open_: list[list] = [[_looks_up(call), 0]] if call else []
        wanted = True
        while i < n:
            k, a, b = tokens[i]
            if k == "\n":
                if not open_ and not (out and wanted) and not (a and text[a - 1] == "\\"):
                    j = i
                    while kind(j) == "\n":
                        j += 1
                    if out or not (kind(j) == "(" or kind(j) == "S" and kind(j + 1) not in ("=", "]")):
                        break
                    i = j - 1
            elif k == "S":
                if kind(i + 1) == "=" or kind(i + 1) == "]" and kind(i + 2) == "=":
                    break
                if b > a and not (open_ and open_[-1][0] and open_[-1][1] == 0):
                    out.append((a, b, ""))
                wanted = False
            elif k == "N":
                if kind(i + 1) == "=":
                    break
                word = text[a:b]
                if word in _BETWEEN:
                    wanted = True
                elif not wanted and not open_:
                    break
                elif kind(i + 1) == "(":
                    open_.append([_looks_up(word), 0])
                    wanted = True
                    i += 1
                else:
                    out.append((-1, -1, word))
                    wanted = False
            elif k in ("(", "["):
                open_.append([False, 0])
                wanted = True
            elif k in (")", "]"):
                if not open_:
                    break
                open_.pop()
                wanted = False
                if call and not open_:
                    break
            elif k == ",":
                if not open_:
                    break
                open_[-1][1] += 1
                wanted = True
            elif k in _JOINS:
                wanted = True
            else:
                break
            i += 1
        return out


def _looks_up(call: str) -> bool:
    parts = [p.lower() for p in _CAMEL.findall(call)]
    return bool(parts) and not _LOOKUPS.isdisjoint(parts[-2:])


def lexed(text: str) -> list[Binding]:
    return _Lexer(text).bindings


def literals(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of the literals that reach a sensitive name, through any number of names in any order.

    A name stands for what it was bound to last before its use, else for what it is bound to first after it.
    """
    bindings = lexed(text)
    at: dict[tuple[int, str], list[int]] = {}
    for i, x in enumerate(bindings):
        at.setdefault((x.scope, x.name), []).append(i)

    def meant(i: int, name: str) -> int:
        own = at.get((bindings[i].scope, name), ())
        k = bisect_left(own, i)
        if k > 0:
            return own[k - 1]
        later = [j for j in own[k : k + 2] if j != i]
        if later:
            return later[0]
        outer = at.get((0, name), ()) if bindings[i].scope else ()
        return outer[-1] if outer else -1

    # names by the binding they stand for
    uses: list[list[int]] = []
    spans: list[list[tuple[int, int]]] = []
    for i, x in enumerate(bindings):
        own_uses, own_spans = [], []
        for a, b, name in x.operands:
            j = meant(i, name) if name else -1
            if j >= 0:
                own_uses.append(j)
            elif a >= 0:
                own_spans.append((a, b))
        uses.append(own_uses)
        spans.append([x.bare] if x.bare and not own_uses else own_spans)
    # values of what a sensitive name may stand for, those used first
    values: list[_Value | None] = [None] * len(bindings)
    state = bytearray(len(bindings))
    heads: list[tuple[float, int]] = []
    for head, x in enumerate(bindings):
        weight = name_score(x.name)
        if weight <= 0:
            continue
        todo = [head]
        while todo:
            i = todo[-1]
            if not state[i]:
                state[i] = 1
                todo += [j for j in uses[i] if not state[j]]
                continue
            todo.pop()
            if state[i] == 1:
                state[i] = 2
                value = _Value()
                for a, b in spans[i]:
                    value.add(_Value(text[a:b]))
                for j in uses[i]:
                    if values[j] is not None:
                        value.add(values[j])
                values[i] = value
        if not x.pair or values[head].mixed():
            heads.append((weight * values[head].score(), head))
    # parts of a sum are judged together: the best of all names that a literal reaches
    best: dict[tuple[int, int], float] = {}
    reached = bytearray(len(bindings))
    for score, head in sorted(heads, key=lambda h: (-h[0], h[1])):
        todo = [head]
        while todo:
            i = todo.pop()
            if not reached[i]:
                reached[i] = 1
                todo += uses[i]
                for span in spans[i]:
                    best[span] = max(best.get(span, 0.0), score)
    return sorted((a, b, s) for (a, b), s in best.items())


def scan(text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted; kinds count as in KINDS."""
    if not text:
        return []
    out: list[tuple[int, int, int]] = []
    marks = "=" in text or ":" in text
    if marks:
        low = text.lower() if text.isascii() else text.translate(_LOWER)
        if any(w in low for w in _WORDS):
            out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _RUN in text.encode("latin-1", "replace").translate(_HEX_TABLE):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if (marks or "</" in text or "(" in text) and _MAYBE.search(text):
        # the furthest end of the base spans that begin at or before a place
        base = sorted((a, b) for a, _, b in out)
        starts, ends = [a for a, _ in base], list(accumulate((b for _, b in base), max))
        for a, b, score in literals(text):
            k = bisect_right(starts, a)
            if score >= threshold and not (k and ends[k - 1] >= b):
                out.append((a, 3, b))
    return sorted(out)


_LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"


def secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, counts by kind, the digest of the base spans, and all spans as kind:start:end by start, then kind."""
    ship(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                spans = scan(text.as_py(), threshold)
                n = Counter(k for _, k, _ in spans)
                said = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
                base = ",".join(s for s, (_, k, _) in zip(said, spans, strict=True) if k < 3)
                rows.append((n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(), ",".join(said), n[3]))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
