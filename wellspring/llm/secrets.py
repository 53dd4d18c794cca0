"""Secret scans: fixed patterns, and an assignment-aware lexer for sources and configuration.

Base spans (leftmost, not overlapping, per kind; failing matches are dropped and not retried):
``assign`` a sensitive name, ``:`` or ``=`` and a value of 12 characters or more; ``access`` ``AKIA`` and
capitals or digits, 18 characters or more; ``hex`` 16 or more digits 0-9a-f.

The lexer adds ``literal`` spans.  At every ``=`` or ``:`` outside a literal it reads the name to the left
(dotted, quoted or bracketed) and the expression to the right: quoted or triple-quoted literals, bare words
and ``+`` or ``.`` chains of them, also where they begin on the next line; indented blocks (after ``|`` or
``>``, or of bare words below the name).  No length is bounded: literals run to their delimiters.  A name on
the right stands for what was bound to it last, or is bound to it first further down (constants propagate,
also through several names).  A literal scores by the most sensitive name that it reaches, by its length and
character entropy, less for placeholders, and so do the parts of an expression together; from ``THRESHOLD``
on they are reported, unless a base ``assign`` span holds them.  Positions are code points, ends exclusive.

How it scales.  Bindings form a graph whose nodes each hold their own literals; weights and findings go along
its edges once, so time grows with the text whatever is bound to what.  Nothing is shuffled.

Defined results.  Null text counts as empty: no spans, the digest of the empty string.  Null ids, repeated
rows and ties pass through row by row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
HEX = re.compile(r"[0-9a-f]{16,}", re.ASCII)  # a greedy run below 16 fails as a whole, so this equals dropping it

#: Weights of words in a target's name.
SENSITIVE = {
    "password": 0.6, "passwd": 0.6, "pwd": 0.6, "passphrase": 0.6, "secret": 0.6, "token": 0.6, "apikey": 0.6, "credential": 0.5,
    "credentials": 0.5, "privatekey": 0.6, "accesskey": 0.6, "secretkey": 0.6, "clientsecret": 0.6, "auth": 0.35, "bearer": 0.4,
    "key": 0.3, "signature": 0.2, "session": 0.2, "cookie": 0.2, "salt": 0.25, "private": 0.25, "access": 0.15, "api": 0.15,
}
PLACEHOLDER = re.compile(r"(?i)^(?:changeme|example|placeholder|none|null|true|false|todo|x{3,}|\*{3,}|your[-_ ].*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(?\w+\)?s?)$")
PEM = re.compile(r"-----(?:BEGIN|END) [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----")
THRESHOLD = 0.5
REACH = 160  # a step to the left for a name; names that begin before it are read whole

_NAME = re.compile(r"""(?:^|[^\w.$-])["'`]?([A-Za-z_$][\w$.-]*+)["'`]?(?:\[["'](\w++)["']\]|[ \t]*:[ \t]*[A-Za-z_][\w.\[\]]*+)?[ \t]*$""")
_ITEM = re.compile(
    r"""[ \t]*(?:\(?[ \t]*)(?:\"""((?:[^"\\]|\\[\s\S]|"(?!""))*+)\"""|\'\'\'((?:[^'\\]|\\[\s\S]|'(?!''))*+)\'\'\'"""
    r"""|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`]*+)`|([A-Za-z0-9_$][\w$./+-]*+=*+))"""
)
_BARE = 6  # its last group
_BLOCK = re.compile(r"[ \t]*[|>][+-]?[0-9]?[+-]?[ \t]*\r?\n")
_NEXT = re.compile(r"[ \t]*[(\\]?[ \t]*\r?\n")
_QUOTE = re.compile(r"[ \t]*[\"'`]")
_ALONE = re.compile(r"[A-Za-z0-9_$+/][\w$./+-]*+=*+|-----[A-Z0-9 ]+-----")
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.?|\|\|)[ \t]*(?=[\"'`A-Za-z_$])")
_INNER = re.compile(r"\S([^\S\n]++)(?=\S)")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_weight(name: str) -> float:
    words = [w.lower() for w in _CAMEL.findall(name)]
    pairs = [a + b for a, b in zip(words, words[1:])]
    return min(0.7, max((SENSITIVE.get(w, 0.0) for w in words + pairs), default=0.0) + 0.1 * (sum(w in SENSITIVE for w in words) > 1))


def _count(value: str) -> Counter:
    """How often each character stands in ``value``."""
    if len(value) < 4096:
        return Counter(value)
    codes = np.bincount(np.frombuffer(value.encode("utf-32-le", "surrogatepass"), dtype="<u4"))
    return Counter({chr(c): int(codes[c]) for c in np.flatnonzero(codes)})


def _worth(weight: float, counts: Counter) -> float:
    """Score of characters bound to a name of that weight; none score 0."""
    n = counts.total()
    if not n:
        return 0.0
    kinds = set("a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "-" for c in counts)
    entropy = math.log2(n) - sum(c * math.log2(c) for c in counts.values()) / n
    return min(1.0, weight + 0.06 * min(entropy, 4.0) + 0.05 * len(kinds) - (0.35 if len(kinds) < 2 else 0.0) - (0.1 if n < 8 else 0.0))


def _is_prose(text: str, start: int, end: int) -> bool:
    """Whether a line holds a blank between other characters, keys' headings aside; stops at the first."""
    for m in _INNER.finditer(text, start, end):
        if " " in m[1]:
            line = text.rfind("\n", start, m.start()) + 1 or start
            stop = text.find("\n", m.end(), end)
            if " " in PEM.sub("", text[line : stop if stop >= 0 else end]).strip():
                return True
    return False


def _scored(weight: float, text: str, start: int, end: int) -> float:
    """Score of the literal ``text[start:end]``."""
    if not weight or end - start < 6 or _is_prose(text, start, end):
        return 0.0
    return _scored_plain(weight, text, start, end)


def _scored_plain(weight: float, text: str, start: int, end: int) -> float:
    value = text[start:end]
    if "-----" in value:
        value = PEM.sub("", value)
    if "\n" in value:
        value = "\n".join(line.strip() for line in value.split("\n"))
    if len(value) < 6 or PLACEHOLDER.match(value) or " " in value.strip():
        return 0.0
    return _worth(weight, _count(value))


def literal_score(name: str, value: str) -> float:
    """How likely ``value`` is a secret when bound to ``name``, from 0 to 1."""
    return _scored(name_weight(name), value, 0, len(value))


class _Lines:
    """Lines of a text with the blocks that are indented below them; each is found without reading its lines again."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        lines = [text[a:b] for a, b in zip(self.starts, [*self.starts[1:], len(text)])]
        self.indent = [len(x) - len(x.lstrip(" \t")) for x in lines]
        self.stop = [a + len(x.rstrip()) for a, x in zip(self.starts, lines)]
        bodies = [x.strip() for x in lines]
        n = len(lines)
        self.below = [n] * n  # the next line that is not indented deeper
        self.run = [0] * n  # the end of the run of bare words that begins here
        self.solid = [n] * (n + 1)  # the first line from here on that holds anything
        self.filled = [-1] * (n + 1)  # the last line before here that holds anything
        open_lines: list[int] = []
        for i in range(n):
            self.filled[i + 1] = i if bodies[i] else self.filled[i]
            if bodies[i]:
                while open_lines and self.indent[open_lines[-1]] >= self.indent[i]:
                    self.below[open_lines.pop()] = i
                open_lines.append(i)
        for i in reversed(range(n)):
            self.solid[i] = i if bodies[i] else self.solid[i + 1]
            if bodies[i] and _ALONE.fullmatch(bodies[i]):
                self.run[i] = self.run[i + 1] if i + 1 < n and self.run[i + 1] else i + 1

    def block(self, at: int, plain: bool) -> tuple[int, int] | None:
        """Span of the lines below that of ``at`` that are indented deeper; of bare words alone if ``plain``."""
        i = bisect_right(self.starts, at) - 1
        end = min(self.below[i], self.run[i + 1]) if plain and i + 1 < len(self.run) else self.below[i]
        first = self.solid[i + 1]
        if first >= end:
            return None
        return self.starts[first] + self.indent[first], self.stop[self.filled[end]]


def _name(text: str, at: int) -> re.Match | None:
    """The name to the left of ``at``."""
    end = at
    while end and text[end - 1] == ":":
        end -= 1
    while end and text[end - 1] in " \t":
        end -= 1
    lo = end
    for _ in range(2):  # the second step is for what a long key or type stands behind
        if 0 < end - lo <= REACH:
            break
        lo = max(0, lo - REACH)
        while lo and (text[lo - 1].isalnum() or text[lo - 1] in "_.$-"):
            lo -= 1
    return _NAME.search(text[lo:end])


class Binding:
    """A name bound to literals and to other bindings; counts are of the characters of all of them."""

    __slots__ = ("weight", "spans", "parts", "hot", "_counts", "_leaf")

    def __init__(self, weight: float, spans: list[tuple[int, int]], parts: list[Binding], text: str):
        self.weight, self.spans, self.parts, self.hot = weight, spans, parts, False
        self._counts, self._leaf = None, (text, *spans[0]) if len(spans) == 1 and not parts else None
        if not self._leaf:
            self._counts = parts[0].counts if not spans and len(parts) == 1 else Counter()
            for s, e in spans:
                self._counts.update(self._letters(text, s, e))
            for x in dict.fromkeys(parts) if len(spans) + len(parts) > 1 else ():
                if len(self._counts) < 256:  # more letters than that tell nothing new
                    self._counts.update(x.counts)

    @property
    def counts(self) -> Counter:
        """Of a single literal they are made when first asked for."""
        if self._counts is None:
            self._counts = self._letters(*self._leaf)
        return self._counts

    @staticmethod
    def _letters(text: str, start: int, end: int) -> Counter:
        """Counts of a literal; of one with blanks only that it has some, for then they are not asked for."""
        return Counter(" ") if text.find(" ", start, end) >= 0 else _count(text[start:end])

    def score(self, text: str) -> float:
        """The best of its literals' scores and of that of all together."""
        best = max((_scored(self.weight, text, s, e) for s, e in self.spans), default=0.0)
        if len(self.spans) + len(self.parts) > 1 and " " not in self.counts:
            best = max(best, _worth(self.weight, self.counts))
        return best


def bindings(text: str) -> list[Binding]:
    """All assignments of literals or of names that are bound somewhere to literals."""
    out: list[Binding] = []
    lines: _Lines | None = None
    bound: dict[str, Binding] = {}
    later: dict[str, list[Binding]] = {}  # who names what is not bound yet
    at = -1
    eq, colon = text.find("="), text.find(":")
    while True:
        if 0 <= eq <= at:
            eq = text.find("=", at + 1)
        if 0 <= colon <= at:
            colon = text.find(":", at + 1)
        if eq < 0 and colon < 0:
            break
        at = min(p for p in (eq, colon) if p >= 0)
        two = text[at : at + 2]
        if two == ":=":  # an assignment too, as the = that it is read from
            at += 1
        elif two in ("==", "::") or text[max(at - 1, 0) : at] in ("!", "<", ">", "="):
            at += two in ("==", "::")
            continue
        name = _name(text, at)
        if not name:
            continue
        target, pos = ".".join(x for x in name.groups() if x), at + 1 + (text[at + 1 : at + 2] == ">")
        spans: list[tuple[int, int]] = []
        parts: list[Binding] = []
        open_names: list[str] = []

        def bare(s: int, e: int) -> None:
            word = text[s:e]
            if word in bound:
                parts.append(bound[word])
            else:
                spans.append((s, e))
                open_names.append(word)

        if text[at] == ":" and (m := _BLOCK.match(text, pos)):
            lines = lines or _Lines(text)
            spans = [b] if (b := lines.block(at, False)) else []
            pos = len(text)
        elif m := _NEXT.match(text, pos):
            if _QUOTE.match(text, m.end()):
                pos = m.end()
            else:
                lines = lines or _Lines(text)
                if b := lines.block(at, True):
                    bare(*b)
                pos = len(text)
        while m := _ITEM.match(text, pos):
            g = m.lastindex
            if g < _BARE:
                spans.append(m.span(g))
            elif m[g] in bound or not _JOIN.match(text, m.end()):
                bare(*m.span(g))
            else:
                open_names.append(m[g])
            pos = m.end()
            if not (j := _JOIN.match(text, pos)):
                break
            pos = j.end()
        if not spans and not parts and not open_names:
            continue
        new = Binding(name_weight(target), spans, parts, text)
        out.append(new)
        for x in later.pop(target, ()):  # names used before they were bound
            x.parts.append(new)
        for x in open_names:
            if x != target:
                later.setdefault(x, []).append(new)
        bound[target] = new
    return out


def literals(text: str) -> list[tuple[int, int, float]]:
    """start, end and score of literals bound, at first or second hand, to sensitive names."""
    every = bindings(text)
    todo = [b for b in every if b.weight]
    while todo:  # weights go down to what a name was bound to; each rises a few times at most
        b = todo.pop()
        for x in b.parts:
            if x.weight < b.weight:
                x.weight = b.weight
                todo.append(x)
    found: dict[tuple[int, int], float] = {}
    for b in every:
        if b.weight and (score := b.score(text)) >= THRESHOLD:
            todo = [b]
            while todo:  # a secret's parts are secret, each is visited once
                x = todo.pop()
                for s in x.spans:
                    if s[1] - s[0] >= 6:
                        found[s] = max(found.get(s, 0.0), score if x is b else THRESHOLD)
                todo += [y for y in x.parts if not y.hot]
                for y in x.parts:
                    y.hot = True
    return sorted((s, e, v) for (s, e), v in found.items())


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """kind, start, end of all spans, by start, then kind as listed."""
    t = text or ""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    held = [s[1:] for s in spans]
    starts = [s for s, _ in held]
    spans += [("access", *m.span()) for m in ACCESS.finditer(t) if m.end() - m.start() >= 18]
    spans += [("hex", *m.span()) for m in HEX.finditer(t)]
    if "=" in t or ":" in t:
        for s, e, _ in literals(t):
            n = bisect_right(starts, s)  # base spans don't overlap, so only the last one before can hold it
            if not n or e > held[n - 1][1]:
                spans.append(("literal", s, e))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id and an array of spans (kind, start, end, by start) for each row."""

    def one(b: pa.RecordBatch) -> dict:
        return {"doc_id": b.column(0), "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t)] for t in b.column(1).to_pylist()]}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, spans array<struct<kind:string,start:int,end:int>>", one)


def digest(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans as text, from ``secret_scan``."""
    of = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    text = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    return found.select("doc_id", *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.sha2(text(of(KINDS[:3])), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size(of(["literal"])).cast("long").alias("n_literal"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each found span of the text replaced by ``mark`` and n_chars (if there) recounted.

    Overlapping spans are replaced as one.  Texts without secrets, null ones too, stay as they are.
    """
    cols = docs.columns

    def clean(b: pa.RecordBatch) -> dict:
        texts = b.column("text").to_pylist()
        out = []
        for t in texts:
            spans = sorted((s, e) for _, s, e in scan(t)) if t else []
            parts, at = [], 0
            for s, e in spans:
                if s >= at:
                    parts += [t[at:s], mark]
                at = max(at, e)
            out.append("".join([*parts, t[at:]]) if spans else t)
        new = {c: b.column(c) for c in cols} | {"text": out}
        if "n_chars" in cols:
            new["n_chars"] = [n if a is b_ or a == b_ else len(b_) for n, a, b_ in zip(b.column("n_chars").to_pylist(), texts, out)]
        return new

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, schema, clean)
