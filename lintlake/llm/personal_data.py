"""Personal data by offset-preserving deobfuscation.

Identifiers are detected twice: in the text as it stands (base spans), and in a normalised form of it. A chain of small
transducers makes that form: look-alike characters, spelled digits, disguised dots, disguised at signs. Every transducer
keeps a tape of its edits, so that a span of the normalised text is mapped back through the tapes to the characters of
the source. Only texts that a transducer changes are detected a second time.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lintlake.llm.common import slices

KINDS = ("email", "ip", "card", "phone")

# Detection. The patterns equal the greedy ones of the contract, written so that long runs take linear time: an address is
# searched from its @ sign, digit groups are taken as whole runs.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3,}+")
_CARD = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(_DOUBLED[v] for v in values[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(done, at + 1))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four parts at a time from the left of every dotted run; a group with a part above 255 is passed over whole."""
    for run in _DOTTED.finditer(text):
        parts, start = run[0].split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, end
            start = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(m[0].count, "0123456789")) <= 15:
            yield m.span()


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every identifier as written, by start and then kind; kinds may overlap."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(a, 1, b) for a, b in _addresses(text)]
        found += [(a, 2, b) for a, b in _cards(text)]
        if "+" in text:
            found += [(a, 3, b) for a, b in _phones(text)]
    return sorted(found)


class Tape:
    """A text made from another one by edits, and the way back for spans."""

    def __init__(self, text: str, source: Tape | None = None, edits: list[tuple[int, int, str]] = ()):
        """``edits``: (start, end, replacement) in ``source``, ascending, not overlapping; ``text`` is used without a source."""
        self.source, self.edits = source, []
        if source is None:
            self.text = text
            return
        parts, at, length = [], 0, 0
        for start, end, new in edits:
            length += start - at
            self.edits.append((length, length + len(new), start, end))
            parts += [source.text[at:start], new]
            length += len(new)
            at = end
        self.text = "".join([*parts, source.text[at:]])
        self._starts = [e[0] for e in self.edits]

    def _back(self, at: int, is_end: bool) -> int:
        k = bisect_right(self._starts, at) - 1
        if k < 0:
            return at + is_end
        _, stop, source_start, source_stop = self.edits[k]
        if at < stop:
            return source_stop if is_end else source_start
        return source_stop + at - stop + is_end

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """The span of the first source whose characters made the non-empty span; an edit is taken whole."""
        if self.source is None:
            return start, end
        return self.source.origin(self._back(start, False), self._back(end - 1, True))

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Tape:
        return Tape("", self, edits) if edits else self


# Letters of other scripts that look like Latin ones.
_LOOK_ALIKE = dict(zip(
    "АВЕЅІЈКМНОРСТХУаеіјорсухѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονυιρα",
    "ABESIJKMHOPCTXYaeijopcyxsdhqwABEZHIKMNOPTYXovuipa"))
# Dashes and stops that are no compatibility forms of the ASCII ones.
_LOOK_ALIKE |= dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2212", "-") | dict.fromkeys("\u3002\uff61", ".")
# Characters without width.
_NO_WIDTH = dict.fromkeys("\u00ad\u200b\u200c\u200d\u2060\ufeff", "")


def _glyphs() -> dict[str, str]:
    """Every character with one ASCII reading: compatibility forms, decimal digits of all scripts, look-alikes, no width."""
    table = {}
    for code in (*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)):
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and " " <= plain <= "~":
            table[c] = plain
        elif (digit := unicodedata.decimal(c, None)) is not None:
            table[c] = str(digit)
    return table | _LOOK_ALIKE | _NO_WIDTH


GLYPHS = _glyphs()
_LETTER_DIGIT = re.compile(r"[0-9][OolI](?=[0-9])")

# Number words, 0 to 9, by language.
_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
_DIGIT_OF = {word: str(k) for words in _WORDS.values() for k, word in enumerate(words.split())} | {"oh": "0"}
_TIMES = {"double": 2, "triple": 3}
_DOT = "dot|punkt|point|punto"
_WORD = "(?:(?:double|triple)[ -])?(?:" + "|".join(sorted(_DIGIT_OF, key=len, reverse=True)) + ")"
_NEXT = rf"[ ,-]{{1,2}}(?:(?:{_DOT})[ ])?(?:{_WORD}\b|[0-9]+(?![0-9A-Za-z.]))"
#: Three number words at least, with digits and spelled dots among them; a single "un" or "six" is a word of the text.
_SPELLED = re.compile(rf"(?i)\b(?:plus )?{_WORD}\b(?:{_NEXT})+")
#: What the second and third item of every such run look like in lower case, from a blank, comma or dash, which are found fast.
_MAY_BE_SPELLED = re.compile(rf"[ ,-]{_WORD}{_NEXT}")
_SPELLED_ITEM = re.compile(r"(?i)[0-9]+|[^\W\d_]+")
# Disguised signs, each from its first sure character; blanks around it belong to it.
_MARKED_DOT = re.compile(rf"(?i)[\[({{<][ \t]*(?:{_DOT}|\.)[ \t]*[\])}}>]|&#0*46;|&period;|%2e")
_BARE_DOT = re.compile(rf"(?i)[ \t](?:{_DOT})(?=[ \t]+[A-Za-z0-9])")
_MARKED_AT = re.compile(r"(?i)[\[({<][ \t]*(?:at|ät|arroba|@)[ \t]*[\])}>]|&#0*64;|&commat;|%40")
_BARE_AT = re.compile(r"(?i)[ \t](?:at|ät|arroba)(?=[ \t]+[A-Za-z0-9-]+(\.))")
_BLANKS = " \t"


def _spelled(match: re.Match) -> str | None:
    """The digits that a run of number words stands for; None if fewer than three words are among them."""
    out, words, times = [], 0, 1
    for item in _SPELLED_ITEM.findall(match[0].lower()):
        if item in _DIGIT_OF:
            out.append(_DIGIT_OF[item] * times)
            words, times = words + 1, 1
        elif item in _TIMES:
            times = _TIMES[item]
        else:
            out.append("+" if item == "plus" else item if item[0].isdigit() else ".")
    return "".join(out) if words >= 3 else None


def _signs(text: str, found: Iterator[re.Match], bare: bool) -> list[tuple[int, int]]:
    """Spans of disguised signs with the blanks around them; a bare word must follow a letter or digit."""
    spans = []
    for m in found:
        start, end = m.span()
        while start and text[start - 1] in _BLANKS:
            start -= 1
        while end < len(text) and text[end] in _BLANKS:
            end += 1
        if not bare or start and text[start - 1].isalnum():
            spans.append((start, end))
    return spans


def _apart(spans: list[tuple[int, int]], sign: str) -> list[tuple[int, int, str]]:
    """Edits of ascending spans; of two that meet the first counts."""
    edits: list[tuple[int, int, str]] = []
    for a, b in sorted(spans):
        if not edits or a >= edits[-1][1]:
            edits.append((a, b, sign))
    return edits


def normalised(text: str) -> Tape:
    """The text as the detectors should see it; a tape without source if nothing was disguised."""
    tape = Tape(text)
    if not text.isascii() and (odd := set(text) & GLYPHS.keys()):
        glyph = re.compile("[" + "".join(sorted(odd)) + "]")
        tape = tape.rewritten([(m.start(), m.end(), GLYPHS[m[0]]) for m in glyph.finditer(tape.text)])
    tape = tape.rewritten([(m.end() - 1, m.end(), "1" if m[0][1] in "lI" else "0") for m in _LETTER_DIGIT.finditer(tape.text)])
    if _MAY_BE_SPELLED.search(tape.text.lower()):
        spelled = ((m.start(), m.end(), _spelled(m)) for m in _SPELLED.finditer(tape.text))
        tape = tape.rewritten([e for e in spelled if e[2]])
    t = tape.text
    dots = _apart(_signs(t, _MARKED_DOT.finditer(t), False) + _signs(t, _BARE_DOT.finditer(t), True), ".")
    tape = tape.rewritten(dots)
    t = tape.text
    ats = _signs(t, _MARKED_AT.finditer(t), False)
    if dots:  # a bare "at" is a sign only before a name whose dot was disguised too
        made = {e[0] for e in tape.edits}
        ats += _signs(t, (m for m in _BARE_AT.finditer(t) if m.start(1) in made), True)
    return tape.rewritten(_apart(ats, "@"))


def added(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that only the normalised text shows.

    A span in which nothing was rewritten is none, nor is one that meets a base span of its kind, except for an address
    that holds the whole of a base one (the base pattern stopped at the disguise).
    """
    tape = normalised(text)
    if tape.source is None:
        return []
    by_kind = [[(a, b) for a, k, b in base if k == kind] for kind in range(len(KINDS))]
    found = set()
    for start, kind, end in detect(tape.text):
        a, b = tape.origin(start, end)
        if text[a:b] == tape.text[start:end]:
            continue
        near = by_kind[kind]
        k = max(0, bisect_right(near, (a,)) - 1)
        met = []
        while k < len(near) and near[k][0] < b:
            if near[k][1] > a:
                met.append(near[k])
            k += 1
        if not met or kind == 0 and all(a <= x and y <= b for x, y in met) and (a, b) not in met:
            found.add((a, kind, b))
    return sorted(found)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with every span replaced by its kind in angle brackets; of overlapping ones the first names the whole."""
    out, at, open_until = [], 0, -1
    for a, kind, b in spans:
        if a >= open_until:
            out += [text[at:a], f"<{KINDS[kind]}>"]
        open_until = at = max(at, b)
    return "".join([*out, text[at:]])


_FOUND = pa.schema([
    *[(f"n_{kind}", pa.int64()) for kind in KINDS], ("n_added", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def find_personal_data(docs: DataFrame, text: str = "text", mask: bool = False) -> DataFrame:
    """Every row of ``docs`` with ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base spans), ``n_added``, ``base_sha256`` and ``spans``.

    ``spans`` lists base and added spans as ``kind:start:end`` (code points, end exclusive) by start and then kind;
    ``base_sha256`` is the hash of the same list of base spans only. ``text`` is replaced by its masked form with
    ``mask`` and left out otherwise. A null text counts as empty and stays null when masked. Rows stand alone: repeated
    rows come back as often as given, an empty table gives an empty one, and other columns are carried along; columns
    with the names of the results are replaced. One pass without a shuffle.
    """
    kept = [f for f in docs.schema.fields if f.name not in _FOUND.names and (mask or f.name != text)]
    names = [f.name for f in kept]
    kinds = ["long", "long", "long", "long", "long", "string", "string"]
    schema = T.StructType(kept)
    for name, kind in zip(_FOUND.names, kinds):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            rows, texts = {name: [] for name in _FOUND.names}, []
            for body in batch.column(text).to_pylist():
                base = detect(body or "")
                more = added(body, base) if body else []
                spans = sorted(base + more)
                for k, kind in enumerate(KINDS):
                    rows[f"n_{kind}"].append(sum(s[1] == k for s in base))
                rows["n_added"].append(len(more))
                rows["base_sha256"].append(hashlib.sha256(shown(base).encode()).hexdigest())
                rows["spans"].append(shown(spans))
                if mask:
                    texts.append(masked(body, spans) if spans else body)
            columns = [pa.array(texts, batch.schema.field(text).type) if mask and n == text else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, *[pa.array(rows[f.name], f.type) for f in _FOUND]], names=[*names, *_FOUND.names])

    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(run, schema)
