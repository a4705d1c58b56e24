"""Secret scans by assignment-aware lexing."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import alone, arrow_rows, blocks

#: The base patterns and the kinds in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "named")

#: Where a token begins: comments; strings with their prefix (three quotes, one quote, and back quotes where a value may stand); names,
#: dotted or with hyphens; tags; signs; line ends. White space and digits stand between. Strings are followed to their ends by BODIES.
_NOTE = r"""(?P<note>(?<!\S)\#[^\n]*|(?<![:\w/"'])//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|<!--(?s:.*?)(?:-->|\Z))"""
_OPEN = r"""(?P<text>(?:(?<!\w)(?:(?i:u8|[bcft]r|r[bft]|[bruftlnecs])|[@$]{1,2})\#*)?["'`])"""
_REST = r"(?P<name>[^\W\d]\w*(?:[.\-]\w+)*)|(?P<tag><[A-Za-z][\w:.\-]*)|(?P<end></[A-Za-z][\w:.\-]*>)|(?P<sign>:=|=>|===?|!==?|<=|>=|->|::|[-+*/|&]=|\n|[^\s\w])"
TOKEN, PLAIN, REST = (re.compile(x) for x in (f"{_NOTE}|{_OPEN}|{_REST}", f"{_OPEN}|{_REST}", _REST))
#: By the quotes that open and close a string: what may stand between.
BODIES = {
    '"""': re.compile(r'[^"\\]*+(?:(?:\\(?s:.)|"(?!""))[^"\\]*+)*+'),
    '"': re.compile(r'[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+'),
    "'''": re.compile(r"[^'\\]*+(?:(?:\\(?s:.)|'(?!''))[^'\\]*+)*+"),
    "'": re.compile(r"[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+"),
    "`": re.compile(r"[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+"),
}
TEMPLATE = re.compile(r"(?:(?<=[=:(,+?])|(?<=[=:(,+?]\x20))`(?!``)")
NOTE, TEXT, NAME, TAG, END, SIGN = range(6)
KIND = {"note": NOTE, "text": TEXT, "name": NAME, "tag": TAG, "end": END, "sign": SIGN}
#: A bare value, a macro, a name within a string, and names of types that follow the name they type.
WORD = re.compile(r"""[^\s"',;(){}<>\[\]]+""")
MACRO = re.compile(r"""\#\s*define\s+(\w+)\s+"([^"\n]*)\"""")
WITHIN = re.compile(r"\$?\{\s*(\w+)\s*\}")
TYPES = {"string", "str", "byte", "bytes", "text", "char"}
ASSIGNS = {"=", ":", ":=", "=>"}
JOINS = {"+", ".", "&"}
TYPING = {".", "|", "&", "?", "*", "!", "<", ">", "::", "'", "[", "(", "{"}
CLOSERS = {")": "(", "]": "[", "}": "{"}
#: Attributes that name what another attribute or the element holds.
NAMING, HOLDING = ("key", "name", "id", "property"), ("value", "val", "content", "default")

#: Names that hold secrets, with their weight, and words that make a name harmless. Parts of names are matched whole.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "credential": 3, "credentials": 3, "apikey": 3,
    "privatekey": 3, "accesskey": 3, "secretkey": 3, "token": 2, "auth": 2, "authorization": 2, "bearer": 2, "signature": 1, "key": 1, "salt": 1,
}
HARMLESS = {"length", "len", "count", "min", "max", "policy", "hint", "label", "field", "name", "url", "path", "file", "type", "expiry", "ttl", "public"}
#: Literals that only stand for a secret.
DUMMY = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|none|null|true|false|changeme|change_me|example|your[-_ ].*|<.*>|\$\{.*\}|\$\(.*\)|%\(.*\)s|todo|redacted|\[.*\])$")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: A literal counts at this score: the name's weight, and one point each for twelve characters,
#: two classes of characters (of letters alone: mixed case), and three bits of entropy a character.
#: Names of weight 1 need all points and a literal that is more than words joined by signs.
NAMED_SCORE = 5
#: Constants add so many characters to a literal at most, the next ones stay as they are written: what a program pastes together beyond
#: that is no credential, and constants that double each other would fill the memory. Of longer bare words the head is held against DUMMY, and their characters.
FOLLOWED, HEAD = 2048, 256
#: What may join words, and one in so many letters of either case that makes a literal mixed (CamelCase has fewer).
JOINTS, CASED = "._:/-, ", 4


def name_weight(name: str) -> int:
    """How far a target's name, taken apart at case and signs, tells of a secret."""
    parts = [p.lower() for p in PARTS.findall(name)]
    if HARMLESS.intersection(parts):
        return 0
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(p, 0) for p in (*parts, *joined)), default=0)


def mixed_case(counts: Counter) -> bool:
    upper, lower = (sum(k for c, k in counts.items() if f(c)) for f in (str.isupper, str.islower))
    return min(upper, lower) * CASED >= upper + lower > 0


def only_words(counts: Counter) -> bool:
    """No digit, no mixed case and no sign but those that join words."""
    return all(c.isalpha() or c in JOINTS for c in counts) and not mixed_case(counts)


def is_dummy(n: int, counts: Counter, said: str) -> bool:
    """Whether the whole literal is a placeholder. A bare word has neither spaces nor brackets: one that is longer than its head is a placeholder if it says
    your-something, or is one sign over and over, which its characters tell."""
    return DUMMY.match(said) is not None and (n == len(said) or said[:4].lower() == "your" or len({c.lower() for c in counts}) == 1)


def literal_points(n: int, counts: Counter, said: str) -> int:
    """0 to 3: length, mix of characters, entropy; 0 for dummies and for words of a script without case.

    n and counts are the literal's length and characters; of a bare word of more than HEAD characters, said is its head.
    """
    if n < 8 or is_dummy(n, counts, said):
        return 0
    if all(c.isalpha() for c in counts):
        if not any(c.isupper() or c.islower() for c in counts):
            return 0
        mix = mixed_case(counts)
    else:
        mix = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum())) >= 2
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    return (n >= 12) + mix + (entropy >= 3.0)


def facts(n: int, counts: Counter, said: str) -> tuple[int, bool, bool | None]:
    """(points, whether it is only words, of a phrase whether a word of it has all points and is more than joined words)."""
    phrase = None
    if " " in said and not DUMMY.match(said):
        parts = [(w, Counter(w)) for w in said.split()]
        phrase = any(literal_points(len(w), c, w) == 3 and not only_words(c) for w, c in parts)
    return literal_points(n, counts, said), only_words(counts), phrase


def is_secret(weight: int, passphrase: bool, points: int, words: bool, phrase: bool | None) -> bool:
    """Name (its weight, whether it asks for a passphrase) and literal (its facts) add up to a secret: a phrase if its name
    asks for one or a word of it is a secret by itself (``Bearer Zx9...``)."""
    if phrase is not None and not passphrase:
        return phrase
    if weight == 1:
        return points == 3 and not words
    return points >= 2 and weight + points >= NAMED_SCORE


class Lexed:
    """The name-literal pairs of a text: (name, start, end, what the literal says), constants followed to their literals.

    Statements are read in order, one pass over the tokens; look-ahead stops at the next sign, so that time follows the
    text's length. Comments are texts of their own, whose constants mean nothing to the code around them, and in which marks of comments
    are signs (notes: False); strings that hold signs are read once more, for the assignments within. A string lies in no string of its
    own quotes, and a comment in no comment, so that texts lie in each other a few deep at most.
    """

    def __init__(self, text: str, notes: bool = True):
        self.text, self.notes, self.known = text, notes, {}
        self.tokens: list[tuple[int, int, int, int, int]] = []  # kind, start, end, and of strings the content's start and end
        add, pattern = self.tokens.append, TOKEN if notes else PLAIN
        dead = dict.fromkeys(BODIES, -1)  # up to where no string of these quotes ends
        m = pattern.search(text)
        while m:
            kind, start, end = KIND[m.lastgroup], m.start(), m.end()
            if kind == TEXT:
                found = self._string(start, end, dead)
                if found:
                    add((kind, start, *found))
                    end = found[0]
                else:
                    m = REST.match(text, start)
                    end = m.end()
                    add((KIND[m.lastgroup], start, end, start, end))
            else:
                add((kind, start, end, start, end))
            m = pattern.search(text, end)
        self.match: dict[int, int] = {}
        held: list[tuple[str, int]] = []
        for i, t in enumerate(self.tokens):
            if t[0] == SIGN and t[2] - t[1] == 1:
                c = text[t[1]]
                if c in "([{":
                    held.append((c, i))
                elif c in CLOSERS and held and held[-1][0] == CLOSERS[c]:
                    self.match[held.pop()[1]] = i
        self.back = {v: k for k, v in self.match.items()}
        self.until = -1
        self.taken = 0  # by constants, of the literal at hand

    def _string(self, start: int, first: int, dead: dict[str, int]) -> tuple[int, int, int] | None:
        """(end, start and end of the content) of the string whose prefix starts at start and whose first quote ends at first; None if it never closes.

        A search that found no closing quote passed every later opening quote at its very end, so that those find none either: dead remembers.
        """
        text, quote = self.text, self.text[first - 1]
        if quote == "`":
            kinds = ("`",) if first - start == 1 and TEMPLATE.match(text, start) else ()
        elif quote == '"' or first < 2 or not (text[first - 2].isalnum() or text[first - 2] == "_"):
            kinds = (quote * 3, quote) if text.startswith(quote * 3, first - 1) else (quote,)
        else:  # an apostrophe behind a letter, but for a prefix
            kinds = ("'",) if first - start > 1 and text[start] not in "@$" else ()
        for q in kinds:
            a = first - 1 + len(q)
            if a > dead[q]:
                b = BODIES[q].match(text, a).end()
                if text.startswith(q, b):
                    return b + len(q), a, b
                dead[q] = b
        return None

    def said(self, i: int) -> str:
        """The token as written; of a string its content."""
        if not 0 <= i < len(self.tokens):
            return ""
        t = self.tokens[i]
        return self.text[t[3] : t[4]]

    def is_(self, i: int, kind: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i][0] == kind

    def sign(self, i: int) -> str:
        return self.said(i) if self.is_(i, SIGN) else ""

    def target(self, i: int) -> str | None:
        """The name that the sign at i assigns to: a name, a quoted key, or what stands in a subscript."""
        while True:
            i -= 1
            while self.sign(i) in ("?", "!"):
                i -= 1
            if self.is_(i, NAME):
                name = self.said(i)
                if name.lower() in TYPES and self.is_(i - 1, NAME) and self.tokens[i][1] - self.tokens[i - 1][2] <= 2:
                    return self.said(i - 1)  # var pwd string =
                return name
            if self.is_(i, TEXT):
                return self.said(i) or None
            first = self.back.get(i) if self.sign(i) == "]" else None
            if first is None:
                return None
            if i - first == 2 and (self.is_(first + 1, TEXT) or self.is_(first + 1, NAME)):
                return self.said(first + 1)
            if i - first > 1 and not self.is_(first - 1, NAME):
                return None
            i = first

    def typed(self, i: int) -> int | None:
        """Where the sign at i is a colon before a type: the place of the equals sign after it."""
        j, angle = i + 1, 0
        while j < len(self.tokens):
            kind, said = self.tokens[j][0], self.said(j)
            if kind == SIGN:
                if said == "=" and not angle:
                    return j if j > i + 1 else None
                angle += (said == "<") - (said == ">")
                if said not in TYPING and not (said == "," and angle > 0):
                    return None
                j = self.match.get(j, j)
            elif kind not in (NAME, TEXT, TAG):
                return None
            elif kind == TAG:  # List<String
                angle += 1
            j += 1
        return None

    def followed(self, name: str) -> str | None:
        """What the constant of this name adds to the literal at hand; None if there is none, or no room for it."""
        c = self.constant(name)
        n = (len(c[2]) or c[1] - c[0]) if c else 0
        if not c or self.taken + n > FOLLOWED:
            return None
        self.taken += n
        return c[2] or self.text[c[0] : c[1]]

    def content(self, i: int) -> str:
        """What a string says: escapes of quotes taken off, constants put into their places."""
        said, t = self.said(i), self.tokens[i]
        if "\\" in said:
            said = re.sub(r"\\(.)", r"\1", said, flags=re.S)
        if "{" in said and (self.text[t[1]] in "fF`" or "${" in said):
            said = WITHIN.sub(lambda m: m[0] if m[1] not in self.known or (c := self.followed(m[1])) is None else c, said)
        return said

    def constant(self, name: str):
        """(start, end, what it says, "" for the text there) of a constant; a chain of assignments that goes on for long is none."""
        c = self.known.get(name) or self.known.get(name.rpartition(".")[2])
        return c if c and (c[2] or c[1] - c[0] <= FOLLOWED) else None

    def joined(self, i: int) -> tuple[int, int, str]:
        """The string at i with those that are added to it or follow it: from the first content to the last."""
        self.taken = 0
        start, end, parts = *self.tokens[i][3:5], [self.content(i)]
        j = i + 1
        while True:
            k = j
            while self.sign(k) in ("\n", "\\"):
                k += 1
            if self.sign(k) in JOINS:
                k += 1
                while self.sign(k) == "\n":
                    k += 1
                if self.is_(k, NAME) and self.sign(k + 1) not in ("(", "[") and (c := self.followed(self.said(k))) is not None:
                    parts.append(c)
                    j = k + 1
                    continue
            elif k != j and self.sign(i - 1) != "(":  # on another line only within brackets
                break
            if not self.is_(k, TEXT) or self.sign(k + 1) in ASSIGNS:
                break
            parts.append(self.content(k))
            end, j = self.tokens[k][4], k + 1
        return start, end, "".join(parts)

    def strings(self, i: int) -> list[tuple[int, int, str]]:
        """The strings within the bracket at i, up to the next assignment."""
        out, j, last = [], i + 1, self.match.get(i, -1)
        while j < last and self.sign(j) not in ASSIGNS:
            if self.is_(j, TEXT) and self.sign(j + 1) not in ASSIGNS:
                found = self.joined(j)
                out.append(found)
                while j < last and self.tokens[j][1] < found[1]:
                    j += 1
                continue
            j += 1
        return out

    def bare(self, at: int) -> list[tuple[int, int, str]]:
        """The bare word at a place of the text, or the constant that it names."""
        text = self.text
        if at < self.until:
            end = self.until
        else:
            m = WORD.match(text, at)
            if not m:
                return []
            end = self.until = m.end()
            self.within = max(text.rfind("=", at, end), text.rfind(":", at, end))
        if self.within < at:
            value = text[at:end]
            if c := self.constant(value.lstrip("$")):
                return [c]
            if value.isidentifier() and not any(c.isdigit() for c in value):  # a name that is not a constant here
                if len(value) < 12 or not value.isalpha() or text[end : end + 1] in ("(", "[") or not mixed_case(Counter(value)):
                    return []
            return [(at, end, value)]
        return [(at, end, "")]  # read in find_secrets, once for all that share its end

    def below(self, i: int) -> list[tuple[int, int, str]]:
        """The value of a key whose line ends after its colon: a deeper line's one string or word, or such a line's list."""
        text, out = self.text, []
        j = i + 1
        while self.sign(j) in (">", "|", "-", "+"):
            j += 1
        if self.sign(j) != "\n":
            return []
        line = text.rfind("\n", 0, self.tokens[i][1]) + 1
        deep = len(text[line : self.tokens[i][1]]) - len(text[line : self.tokens[i][1]].lstrip(" \t"))
        while self.sign(j) == "\n":
            at = self.tokens[j][2]
            m = re.compile(r"([ \t]*)(-[ \t]+)?").match(text, at)
            if text[m.end() : m.end() + 1] in ("", "\n"):
                break
            if len(m[1]) + bool(m[2]) <= deep:
                break
            j += 1 + bool(m[2])
            if self.is_(j, TEXT):
                found, j = [self.joined(j)], j + 1
            else:
                found = self.bare(m.end())
                if not found or text[self.until : self.until + 1] not in ("", "\n") or text[self.until - 1] == ":":
                    break
                while j < len(self.tokens) and self.tokens[j][1] < self.until:
                    j += 1
            out += found
            if not m[2]:
                break
        return out

    def value(self, i: int, colon: bool) -> list[tuple[int, int, str]]:
        """The literals that stand at token i, after a sign."""
        if colon and self.sign(i) in ("\n", ">", "|"):
            return self.below(i - 1)
        while self.sign(i) in ("\\", "\n") and self.sign(i - 1) != "\n":
            i += 1
        while self.is_(i, NAME) and self.said(i) in ("new", "await", "const"):
            i += 1
        if self.is_(i, TEXT):
            return [self.joined(i)]
        if self.sign(i) in ("(", "["):
            return self.strings(i)
        if self.is_(i, NAME) and self.sign(i + 1) in ("(", "[") and self.tokens[i + 1][1] == self.tokens[i][2]:
            return self.strings(i + 1)
        at = self.tokens[i][1] if i < len(self.tokens) else len(self.text)
        before = self.tokens[i - 1][2]
        word = WORD.search(self.text, before, at + 1)  # digits are no token
        found = self.bare(word.start()) if word and not self.text[before : word.start()].strip(" \t") else []
        if found and self.is_(i, NAME) and self.sign(i + 1) in JOINS and self.is_(i + 2, TEXT):
            start, end, said = self.joined(i + 2)
            a, b, what = found[0]
            what = what or self.text[a:b]
            return [(start, end, what + said if a == word.start() or self.taken + len(what) <= FOLLOWED else said)]
        return found

    def pairs(self) -> Iterator[tuple[str, int, int, str]]:
        tag, attributes, element = None, {}, None  # of the open tag, and the element that waits for its end
        typed = -1  # the last equals sign whose statement was read from its colon
        for i, (kind, start, end, first, last) in enumerate(self.tokens):
            if kind == SIGN:
                said = self.text[start:end]
                if said in ASSIGNS and i != typed:
                    name = self.target(i)
                    if name is None:
                        continue
                    names, j = [name], i
                    if said == ":" and (e := self.typed(i)) is not None:
                        names += [self.said(k) for k in range(i + 1, e) if self.is_(k, NAME)][:1]
                        typed = j = e
                    for a, b, what in self.value(j + 1, said == ":" and j == i):
                        self.known[name] = (a, b, what)
                        for n in names:  # what stands as a type may be the name (environment: DB_PWD = "...")
                            yield n, a, b, what
                    if tag and said == "=" and self.is_(i + 1, TEXT):
                        attributes[name.lower()] = i + 1
                elif said == ">" and tag:
                    key = next((self.said(attributes[k]) for k in NAMING if k in attributes), None)
                    if key:
                        for k in HOLDING:
                            if k in attributes:
                                t = self.tokens[attributes[k]]
                                yield key, t[3], t[4], self.said(attributes[k])
                    element = (tag, key, end) if self.text[start - 1] != "/" else None
                    tag = None
            elif kind == TAG:
                tag, attributes, element = self.text[start + 1 : end], {}, None
            elif kind == END:
                if element and element[0] == self.text[start + 2 : end - 1]:
                    a, b = element[2], start
                    held = self.text[a:b]
                    a, b = a + len(held) - len(held.lstrip()), b - len(held) + len(held.rstrip())
                    if a < b and "<" not in held:
                        for n in filter(None, element[:2]):
                            yield n, a, b, self.text[a:b]
                tag = element = None
            elif kind == NOTE:
                said = self.text[start:end]
                for m in MACRO.finditer(self.text, start, end) if "define" in said else ():
                    self.known[m[1]] = (*m.span(2), m[2])
                    yield m[1], *m.span(2), m[2]
                if "=" in said or ":" in said:
                    cut = 4 if said.startswith("<!--") else 2 if said[0] == "/" else 1
                    for n, a, b, what in Lexed(said[cut:].removesuffix("-->").removesuffix("*/"), notes=False).pairs():
                        yield n, a + start + cut, b + start + cut, what
            elif kind == TEXT and self.sign(i + 1) not in ASSIGNS:
                inner = self.text[first:last]
                if "=" in inner or ":" in inner:
                    for n, a, b, what in Lexed(inner, self.notes).pairs():
                        yield n, a + first, b + first, what


def pairs(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(name, start, end, what it says) of every assignment's literal; "" for a bare word with signs of its own, which says what stands there."""
    return Lexed(text).pairs()


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, sorted by start, then kind as in KINDS; null: none.

    assign, access and hex are the base patterns, leftmost and not overlapping within a
    kind; named are literals whose targets' names and own look add up to a secret, that no
    base span covers. Offsets are code points.
    """
    if not text:
        return []
    spans = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    if "=" in text or ":" in text:
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "=" in text or ":" in text or "</" in text or "#define" in text:
        base = sorted((a, b) for a, b, _ in spans)
        starts, ends = [a for a, _ in base], list(accumulate((b for _, b in base), max))
        found: set[tuple[int, int]] = set()
        weights: dict[str, tuple[int, bool]] = {}
        told: dict[tuple[int, int, str], tuple] = {}  # facts of literals, as many names may share one
        reach, last, counts = (0, 0), (0, 0), Counter()
        for name, start, end, said in pairs(text):
            if name not in weights:
                weights[name] = name_weight(name), "passphrase" in {p.lower() for p in PARTS.findall(name)}
            weight, passphrase = weights[name]
            if not weight or end == reach[1] and start > reach[0]:  # within a literal that is found already
                continue
            key = (start, end, said)
            if key not in told:
                if said:
                    said = said.strip()
                    told[key] = facts(len(said), Counter(said), said)
                else:
                    if end == last[1] and start >= last[0]:  # within the last one
                        counts.subtract(text[last[0] : start])
                        counts = +counts
                    else:
                        counts = Counter(text[start:end])
                    last = (start, end)
                    told[key] = facts(end - start, counts, text[start : min(end, start + HEAD)])
            if is_secret(weight, passphrase, *told[key]):
                found.add((start, end))
                reach = start, end
        covered = lambda a, b: (i := bisect_right(starts, a) - 1) >= 0 and ends[i] >= b
        spans += [(a, b, "named") for a, b in found if not covered(a, b)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_named of every whole text.

    Null and empty texts have no spans (sha256 of the empty string). One row a row, repeats
    and null ids included; other columns are not read; an empty table gives no rows; no shuffle; batches hold a bounded number of characters.
    Very long texts are lexed whole, in time and memory in proportion, whatever their quotes, comments and constants are.
    """
    arrow_rows(docs.sparkSession)

    def scanned(batches):
        alone("secrets")
        for batch, texts in blocks(batches):
            found = [find_secrets(t) for t in texts]
            base = [[s for s in x if s[2] != "named"] for x in found]
            count = lambda kind: pa.array([sum(s[2] == kind for s in x) for x in found], pa.int64())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), count("assign"), count("access"), count("hex"),
                    pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base]), pa.array([joined(x) for x in found]), count("named"),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_named"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_named long"
    )


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every secret replaced; overlapping spans become one mark. Of an assignment only the value goes."""
    spans = []
    for start, end, kind in find_secrets(text):
        if kind == "assign":
            start = ASSIGN.match(text, start).start(2)
        spans.append((start, end))
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:] if spans else text


def redact_documents(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with secrets in text replaced by ``mark`` and n_chars, if there, as it then is; all else (null texts, repeats,
    further columns) unchanged; very long texts are read whole, an empty table gives no rows. A span that several literals share is marked once."""
    arrow_rows(docs.sparkSession)
    names = docs.columns

    def redacted(batches):
        alone("secrets")
        for batch, texts in blocks(batches):
            new = [redact(t, mark) for t in texts]
            columns = [batch.column(c) for c in range(len(names))]
            columns[names.index("text")] = pa.array(new, pa.string())
            if "n_chars" in names:
                old = batch.column("n_chars").to_pylist()
                columns[names.index("n_chars")] = pa.array([n if a is b or n is None else len(b) for n, a, b in zip(old, texts, new, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(redacted, docs.schema)
