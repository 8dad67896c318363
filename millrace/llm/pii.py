"""Personal data: base patterns plus offset-preserving deobfuscation.

The base patterns look at the text as it is.  A chain of transducers then rewrites disguises
(look-alike letters, invisible characters, at/dot words, spelled digits) while it carries, for each
character of its output, the span of source characters that it came from.  The same detectors run
over the output, and what they find is mapped back to source offsets.  Spans that the base already
has, or that overlap one of the same kind, are not added again.

Every scan goes on behind what it has tried, so its time is linear in the text and whole texts of
any length are read.

Defined results: null text is empty and has no spans; offsets are code points, ends exclusive;
repeated rows give repeated results; of overlapping finds of one kind the base one, then the first,
stays; a null id stays null; an empty table gives an empty result; further columns are ignored by
``personal_data`` and kept by ``mask_personal_data``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._scratch import tidy

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

# Letters of other scripts that look like ASCII ones, and the words for digits.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѐ": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "ᴢ": "z",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ɑ": "a", "․": ".", "。": ".", "∙": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", " ": " ", "＠": "@", "﹫": "@",
}
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

_ODD = re.compile(f"[{re.escape(''.join(LOOKALIKES))}{INVISIBLE}！-～٠-٩۰-۹०-९\U0001d400-\U0001d7ff]")
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_DOT = r"(?:dot|point|punkt|punto)"
_DOT_SIGN = rf"(?:\s*[\[({{<]\s*(?:{_DOT}|\.)\s*[\])}}>]\s*|\s+{_DOT}\s+)"
_JOINED = rf"(?:{_WORD}|[0-9]{{1,3}}(?![0-9]))"
#: Runs of spelled or written digits with one separator or one dot word between them.  Beside dots,
#: digits may stand together as in the parts of an address.
_SPELLED = re.compile(
    rf"(?<![^\W_])(?:\+|plus[\s-])?(?:{_WORD}|[0-9](?:[0-9]{{1,2}}(?={_DOT_SIGN}))?)"
    rf"(?:[\s,.-]{{1,2}}(?:{_WORD}|[0-9](?![0-9])|[0-9]{{2,3}}(?={_DOT_SIGN}))|{_DOT_SIGN}{_JOINED})+(?![^\W_])",
    re.I,
)
_TOKEN = re.compile(rf"{_WORD}|[0-9]|\+|plus|{_DOT}|\.", re.I)
_DOT_WORDS = {"dot", "point", "punkt", "punto"}
#: A disguised address in two parts: words joined by dots in some form, then an at sign in some form
#: and labels joined by dots in some form.
_LOCAL_CHAIN = re.compile(rf"[A-Za-z0-9._%+-]+(?:{_DOT_SIGN}[A-Za-z0-9_%+-]+)*+", re.I)
_AT_LABELS = re.compile(
    rf"(?P<at>\s*[\[({{{{<]\s*(?:at|@)\s*[\])}}}}>]\s*|\s+at\s+|\s*@\s*)"
    rf"[A-Za-z0-9-]+(?P<rest>(?:(?:{_DOT_SIGN}|\.)[A-Za-z0-9-]+)+)",
    re.I,
)
_AT_HINT = re.compile(rf"[\[({{<]\s*(?:at|@|{_DOT}|\.)\s*[\])}}>]|\s{_DOT}\s", re.I)
#: With ``_AT_HINT``, every text that holds a disguised address and the base patterns do not.
_LOOSE_AT = re.compile(r"\s@|@\s")
_SIGNS = re.compile(rf"(?P<dot>{_DOT_SIGN})|(?P<at>\s*[\[({{<]\s*(?:at|@)\s*[\])}}>]\s*|\s+at\s+|\s*@\s*)", re.I)
_DOTTED_HINT = re.compile(rf"[0-9]{{1,3}}(?:{_DOT_SIGN}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """What the base patterns find, by kind and start."""
    found: list[Span] = []
    if "@" in text:
        done, sign, low = 0, text.find("@"), 0
        while sign >= 0:
            low = max(low, done)
            start = low + len(text[low:sign].rstrip(LOCAL))
            domain = DOMAIN.match(text, sign + 1) if start < sign else None
            if domain:
                found.append((0, start, domain.end()))
                done = domain.end()
            low = sign + 1
            sign = text.find("@", max(done, sign + 1))
    if DIGITS.search(text):
        if "." in text:
            for chunk in DOTTED.finditer(text):
                if "." in (run := chunk[0]):
                    parts, at = run.split("."), chunk.start()
                    for k in range(0, len(parts) - 3, 4):
                        four = parts[k : k + 4]
                        size = sum(map(len, four)) + 3
                        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                            found.append((1, at, at + size))
                        at += size + 1
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append((2, *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found.append((3, *m.span()))
    return found


class Mapped:
    """A rewritten text; character k comes from source characters starts[k] to ends[k] - 1."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans of the present text; each new character maps to the whole span replaced."""
        if not edits:
            return
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text.append(self.text[at:a])
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            if new:
                text.append(new)
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        self.text, self.starts, self.ends = "".join(text), starts + self.starts[at:], ends + self.ends[at:]


def _fold_char(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    folded = unicodedata.normalize("NFKC", c)
    if len(folded) == 1 and folded.isdigit():
        return str(unicodedata.digit(folded))
    return folded if len(folded) == 1 and folded.isascii() else c


def _lookalikes(m: Mapped) -> None:
    m.rewrite([(x.start(), x.end(), new) for x in _ODD.finditer(m.text) if (new := _fold_char(x[0])) != x[0]])


def _signs(m: Mapped) -> None:
    edits, upto = [], 0
    while chain := _LOCAL_CHAIN.search(m.text, upto):  # what a chain has tried is not tried again
        address = _AT_LABELS.match(m.text, chain.end())
        upto = address.end() if address else chain.end()
        if not address:
            continue
        bare = not re.search(r"[\[({<@]", address["at"])
        if bare and not re.search(_DOT_SIGN, address["rest"], re.I):
            continue  # "look at example.com" is ordinary prose
        for x in _SIGNS.finditer(m.text, chain.start(), address.end()):
            new = "." if x["dot"] else "@"
            if x[0] != new:
                edits.append((x.start(), x.end(), new))
    m.rewrite(edits)
    m.rewrite([(a + x.start(), a + x.end(), ".") for n in _DOTTED_HINT.finditer(m.text) for a in [n.start()] for x in re.finditer(_DOT_SIGN, n[0], re.I)])


def _spelled(m: Mapped) -> None:
    edits = []
    for run in _SPELLED.finditer(m.text):
        tokens = list(_TOKEN.finditer(m.text, *run.span()))
        if not any(t[0].lower() in DIGIT_WORDS for t in tokens):
            continue
        for k, t in enumerate(tokens):
            word = t[0].lower()
            new = "+" if word == "plus" else "." if word in _DOT_WORDS else DIGIT_WORDS.get(word, t[0])
            edits.append((t.start(), t.end(), new))
            if k + 1 < len(tokens) and t.end() < tokens[k + 1].start():
                edits.append((t.end(), tokens[k + 1].start(), ""))
    m.rewrite(edits)


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """What the detectors find only after the disguises are undone, in source offsets."""
    odd = not text.isascii() and _ODD.search(text) is not None
    m = Mapped(text) if odd else None
    if m:
        _lookalikes(m)
    now = m.text if m else text
    if _AT_HINT.search(now) or ("@" in now and _LOOSE_AT.search(now)):
        m = m or Mapped(text)
        _signs(m)
        now = m.text
    if _SPELLED.search(now):
        m = m or Mapped(text)
        _spelled(m)
    if not m or m.text == text:
        return []
    taken: dict[int, list[tuple[int, int]]] = {k: sorted((a, b) for kind, a, b in base if kind == k) for k in range(len(KINDS))}
    new = []
    for kind, a, b in base_spans(m.text):
        a, b = m.starts[a], m.ends[b - 1]
        at = bisect_right(taken[kind], (b - 1, 1 << 62))
        if at == 0 or taken[kind][at - 1][1] <= a:
            new.append((kind, a, b))
    return new


def find_personal_data(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by kind and start."""
    base = sorted(base_spans(text))
    return base, sorted({*base, *added_spans(text, base)})


def joined(spans: list[Span]) -> str:
    """``kind:start:end`` of each, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span, or union of overlapping spans, replaced by its kind."""
    out, at = [], 0
    for a, b, kind in sorted((a, -b, k) for k, a, b in spans):
        b = -b
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base finds), base_sha256, spans (all finds)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, every = find_personal_data(text.as_py() or "")
                count = [0] * len(KINDS)
                for kind, _, _ in base:
                    count[kind] += 1
                rows.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        tidy(scan), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def mask_personal_data(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced by ``[KIND]`` and ``length_col``, if there, counted anew.

    A null text stays null; no row goes and no other column changes.
    """
    schema, text_at = docs.schema, docs.columns.index(text_col)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(text_at):
                text = text.as_py()
                spans = find_personal_data(text)[1] if text else []
                texts.append(masked(text, spans) if spans else text)
            yield batch.set_column(text_at, batch.schema.field(text_at), pa.array(texts, batch.schema.field(text_at).type))

    done = docs.mapInArrow(tidy(mask), schema)
    if length_col in docs.columns:
        done = done.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(schema[length_col].dataType))
    return done
