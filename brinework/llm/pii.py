"""Personal data behind disguises, with offsets in the source.

Base detectors find email, ip, card and phone in the text as it stands. Where a
text has a disguise (a look-alike letter, an invisible character, a run of spelled
digits, a bracketed or spelled "at" or "dot", an @ beside white space, a letter for a
digit, an entity for @), a chain of transducers rewrites the whole of it; each keeps,
for every piece it writes, the source range that it came from. The same detectors run
over the rewritten text, and their spans go back through those ranges to source
characters, whole however long they are. A span found this way is added unless a base
span of its kind covers it; base spans stay. All scans take time linear in the text.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Each
row is looked at by itself, so repeated rows and ids give repeated results and no
other column than the two named is read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches, strings

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    back = [ord(c) - 48 for c in reversed(digits)]
    return (sum(back[::2]) + sum(d * 2 - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@label.label..., found from each @ outward in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = start < at and _DOMAIN.match(text, at + 1)
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:  # the run before this @ can't begin a match, nor can the @
            free = at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans by the fixed patterns, by start and then in the order of KINDS."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                parts = [p.lstrip("0") for p in m[0].split(".")]
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                    out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    out.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return out


# --- transducers ---------------------------------------------------------

#: Look-alike letters of other scripts and the ASCII they imitate.
_CYRILLIC = ("АВЕЅІЈКМНОРСТХУаеѕіјорсухһԁԛԝ", "ABESIJKMHOPCTXYaesijopcyxhdqw")
_GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ", "ABEZHIKMNOPTYXovp")
#: Signs that imitate those of an address or number.
_SIGNS = ("․。．｡·•﹒∙＠﹫＋﹢‐‑‒–—−﹣－\u00a0\u2007\u202f\u3000", "........@@++--------    ")
_LETTERS = dict(zip(*_CYRILLIC)) | dict(zip(*_GREEK))
_PLAIN = _LETTERS | dict(zip(*_SIGNS)) | {chr(c + 0xFEE0): chr(c) for c in range(48, 123) if chr(c).isalnum()}
# digits of other scripts and styles, from the Unicode database
_PLAIN |= {chr(c): str(unicodedata.decimal(chr(c))) for c in (*range(0x660, 0x66A), *range(0x6F0, 0x6FA), *range(0x966, 0x970), *range(0x1D7CE, 0x1D800))}
_TABLE = str.maketrans(_PLAIN)
_UNSEEN = re.compile("[\u00ad\u200b\u200c\u200d\u2060-\u2063\ufeff]+")
#: Digit words of the four languages.
_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_ONE = "|".join(sorted(_WORDS, key=len, reverse=True))
_SAID = r" (?:dot|punto|punkt|point) "


class Tape:
    """A rewritten text and where each of its characters comes from.

    Pieces lie side by side: piece k begins at ``pos[k]`` and either copies the source
    from ``a[k]`` on (``b[k]`` is -1) or stands, each character of it, for the source
    range ``a[k]:b[k]``. A text of few changes has few pieces, however long it is.
    """

    def __init__(self, text: str):
        self.text, self.pos, self.a, self.b = text, [0], [0], [-1]

    def source(self, i: int, j: int) -> tuple[int, int]:
        """The source range of the characters i to j (exclusive) of the text."""
        k, m = bisect_right(self.pos, i) - 1, bisect_right(self.pos, j - 1) - 1
        start = self.a[k] if self.b[k] >= 0 else self.a[k] + i - self.pos[k]
        return start, self.b[m] if self.b[m] >= 0 else self.a[m] + j - self.pos[m]

    def put(self, changes: list[tuple[str, int, int]]) -> None:
        """Writes each (new, i, j) in place of the characters i to j; in order, none overlapping."""
        if not changes:
            return
        out, pos, a, b, size = [], [], [], [], 0

        def copy(i: int, j: int) -> None:
            nonlocal size
            if i >= j:
                return
            out.append(self.text[i:j])
            k = bisect_right(self.pos, i) - 1
            while k < len(self.pos) and self.pos[k] < j:
                skip = max(0, i - self.pos[k])
                pos.append(size + max(0, self.pos[k] - i))
                a.append(self.a[k] + (skip if self.b[k] < 0 else 0))
                b.append(self.b[k])
                k += 1
            size += j - i

        at = 0
        for new, i, j in changes:
            copy(at, i)
            if new:
                first, last = self.source(i, j)
                out.append(new)
                pos.append(size)
                a.append(first)
                b.append(last)
                size += len(new)
            at = j
        copy(at, len(self.text))
        self.text, self.pos, self.a, self.b = "".join(out), pos or [0], a or [0], b or [-1]

    def replace(self, pattern: re.Pattern, new: str) -> None:
        self.put([(new, *m.span()) for m in pattern.finditer(self.text)])


# No pattern below has two ways to read the same characters, and none begins at each
# place of a run that it reads to the end: every search is linear in its text.
_ENTITY = re.compile(r"(?i)&#0*+64;|&#x0*+40;|&commat;|%40")
_BRACKETED = re.compile(r"(?i)[\[({<]\s*+(?:at|@|arroba|dot|\.|punto|punkt|point)\s*+[\])}>]")
_AT = re.compile(r"(?i)(?<!\s)\s*+[\[({<]\s*+(?:at|@|arroba)\s*+[\])}>]\s*+")
_DOT = re.compile(r"(?i)(?<!\s)\s*+[\[({<]\s*+(?:dot|\.|punto|punkt|point)\s*+[\])}>]\s*+")
_DOTTED = re.compile(rf"(?i){_SAID}")
def _branches(words) -> str:
    """A pattern for the words in which each prefix is read once."""
    ends = sorted({w[0] for w in words if w})
    rest = "|".join(c + _branches([w[1:] for w in words if w[:1] == c]) for c in ends)
    return f"(?:{rest})" + "?" * ("" in words) if ends else ""


# On lower-cased texts: a digit word that another element follows, as every run of them has one.
_SPELLED = re.compile(rf"(?:(?<![^\W0-9_])|(?<=plus)){_branches([*_WORDS])}(?:{_SAID}|[ .,\-]{{0,2}})(?:{_branches([*_WORDS])}|[0-9])")
_SAID_NUMBER = re.compile(rf"[0-9a-zäöüé]{_SAID}(?=[0-9]|{_ONE})")
_SAID_WORDS = (" dot ", " punto ", " punkt ", " point ")
#: All in _TABLE that lie beyond ASCII do so here.
_ODD = re.compile("[\u00a0\u00ad\u00b7\u0250-\U0010ffff]")
_CHUNK = re.compile(rf"(?i)(?<!\w)(?:(?:plus|\+) ?)?(?:{_ONE}|[0-9])++(?!\w)")
_GAP = re.compile(rf"(?i){_SAID}|[ .,\-]{{1,2}}")
_TOKEN = re.compile(rf"(?i)plus|\+|{_ONE}|[0-9]++|{_SAID}|[ .,\-]++")
_ZERO = re.compile(r"(?:(?<=[0-9])|(?<=[0-9][ -]))[OolI]++(?=[ -]?[0-9])")
_SIGN = re.compile(r"(?i) at | ?@ ?")
_LIKE_ZERO = re.compile(r"[0-9][ -]?[OolI]")
_SIGN_HOST = re.compile(r" at [a-z0-9-]++\.[a-z0-9]| @ ?[a-z0-9-]++\.[a-z0-9]|@ [a-z0-9-]++\.[a-z0-9]")
_LOOSE = re.compile(r"(?<=[A-Za-z0-9_%+-])(?: @ ?|@ )(?=[A-Za-z0-9-]++\.[A-Za-z]{2})")
_LABEL = re.compile(r"[A-Za-z0-9-]++")
_NEXT_LABEL = re.compile(rf"((?i:{_SAID})|\.)([A-Za-z0-9-]++)")
_ALPHA = re.compile(r"[A-Za-z]{2,}+")
#: After a plain full stop a host's last label is in one case: in "home.Then" a space is missing.
_TLD = re.compile(r"(?:[a-z]{2,}+|[A-Z]{2,}+)(?![A-Za-z0-9])")
#: Words that follow "at" in prose and name no host.
_PROSE = re.compile(r"(?i)(?:the|a|an|this|that|these|those|my|our|your|his|her|its|their|each|every|any|some|no|one) ")
#: Words that stand before "at" in prose ("find us at host.org") and name no mailbox.
_ASIDE = re.compile(r"(?i)(?:me|us|him|her|it|them|you|is|are|was|were|be|been|look|looks|looking|looked|found|available|online|here|site|website|page|pages|more|visit|hosted|and|or)")


def runs(text: str) -> Iterator[tuple[int, int]]:
    """Digits and digit words beside each other, with what separates them."""
    start = end = -1
    for m in _CHUNK.finditer(text):
        if start >= 0 and m[0][0] not in "+pP" and _GAP.fullmatch(text, end, m.start()):
            end = m.end()
        else:
            if start >= 0:
                yield start, end
            start, end = m.span()
    if start >= 0:
        yield start, end


def _digits(text: str, start: int, stop: int) -> list[tuple[str, int, int]]:
    """A run of digits, at least four of them or a dot spelled, as digits.

    White space goes within a run of four spelled digits or more; in others between
    two spelled ones only, so that numbers beside each other stay two.
    """
    places = [m.span() for m in _TOKEN.finditer(text, start, stop)]
    tokens = [text[a:b].lower() for a, b in places]
    spelled = sum(t in _WORDS for t in tokens)
    if spelled < 4 and not any(_DOTTED.fullmatch(t) for t in tokens):
        return []
    out = []
    for k, (t, (i, j)) in enumerate(zip(tokens, places)):
        if t in _WORDS:
            new = str(_WORDS[t])
        elif t in ("plus", "+"):
            new = "+"
        elif _DOTTED.fullmatch(t):
            new = "."
        elif t == "." or t.isdigit():
            continue
        elif spelled >= 4 or t.isspace() and 0 < k < len(tokens) - 1 and tokens[k - 1] in _WORDS and tokens[k + 1] in _WORDS:
            new = "-" if "-" in t else ""
        else:
            continue
        out.append((new, i, j))
    return out


def _mailbox(text: str, sign: int, free: int) -> int:
    """Where the mailbox before ``sign`` begins, not before ``free``; ``sign`` itself where there is none."""
    at = sign
    if at <= free or text[at - 1] not in _LOCAL or text[at - 1] == ".":
        return sign
    while at > free and text[at - 1] in _LOCAL:
        at -= 1
    while True:  # "jane dot doe"
        said = next((w for w in (7, 5) if at - w > free and _DOTTED.fullmatch(text, at - w, at)), 0)
        back = at - said
        if not said or text[back - 1] not in _LOCAL or text[back - 1] == ".":
            return at
        while back > free and text[back - 1] in _LOCAL and text[back - 1] != ".":
            back -= 1
        at = back


def _host_end(text: str, at: int, aside: bool) -> int:
    """Where a host that begins at ``at`` and has a spelled dot or an end in one case stops; -1 for none.

    After a word like "us" (``aside``) the end must be spelled.
    """
    m = _LABEL.match(text, at)
    labels = []
    while m:
        m = _NEXT_LABEL.match(text, m.end())
        if m:
            labels.append(m)
    for m in reversed(labels):
        last = _ALPHA.match(text, m.start(2), m.end(2)) if m[1] != "." else None if aside else _TLD.match(text, m.start(2))
        if last:
            return last.end()
    return -1


def addresses(text: str) -> list[tuple[str, int, int]]:
    """Changes that put signs for " at " and " dot " inside addresses, found from each sign outward."""
    out, free = [], 0
    for m in _SIGN.finditer(text):
        start = _mailbox(text, m.start(), free)
        if start == m.start():
            continue
        said = m[0][1:2] in "aA" and len(m[0]) == 4
        aside = said and (_PROSE.match(text, m.end()) or _ASIDE.fullmatch(text, start, m.start())) is not None
        if said and _PROSE.match(text, m.end()):
            continue
        end = _host_end(text, m.end(), aside)
        if end < 0:
            continue
        out += [(".", *d.span()) for d in _DOTTED.finditer(text, start, m.start())]
        out.append(("@", *m.span()))
        out += [(".", *d.span()) for d in _DOTTED.finditer(text, m.end(), end)]
        free = end
    return [x for x in out if text[x[1]:x[2]] != x[0]]


def normalise(text: str) -> Tape | None:
    """The text after all transducers; None where none of them changes anything."""
    odd = not text.isascii() and _ODD.search(text)
    tape = Tape(text.translate(_TABLE) if odd else text)  # sign by sign, so that places stay
    if odd:
        tape.replace(_UNSEEN, "")
    if "&" in tape.text or "%40" in tape.text:
        tape.replace(_ENTITY, "@")
    if _BRACKETED.search(tape.text):
        tape.replace(_AT, "@")
        tape.replace(_DOT, ".")
    low = tape.text.lower()
    said = any(w in low for w in _SAID_WORDS)
    if _SPELLED.search(low) or said and _SAID_NUMBER.search(low):
        tape.put([c for i, j in runs(tape.text) for c in _digits(tape.text, i, j)])
    if _LIKE_ZERO.search(tape.text):
        tape.put([("0" if c in "Oo" else "1", k, k + 1) for m in _ZERO.finditer(tape.text) for k, c in enumerate(m[0], m.start())])
    if said or ("@" in low or " at " in low) and _SIGN_HOST.search(tape.text.lower()):
        tape.put(addresses(tape.text))
        tape.replace(_LOOSE, "@")
    return None if tape.text == text else tape


def spelled_phone(text: str) -> list[tuple[int, int]]:
    """Runs of ten to fifteen spelled digits without a plus: a phone number too."""
    out = []
    for i, j in runs(text):
        tokens = [m[0].lower() for m in _TOKEN.finditer(text, i, j)]
        n = sum(t in _WORDS for t in tokens)
        if 10 <= n <= 15 and not any(t.isdigit() or _DOTTED.fullmatch(t) for t in tokens):
            out.append((i, j))
    return out


def hidden_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans that only the rewritten text shows, in source offsets."""
    tape = normalise(text)
    if tape is None:
        return []
    out = {(kind, *tape.source(s, e)) for kind, s, e in base_spans(tape.text)}
    if _SPELLED.search(text.lower()):
        taken = sorted((s, e) for _, s, e in out)
        reach = list(accumulate((e for _, e in taken), max))
        for s, e in spelled_phone(text):
            k = bisect_left(taken, (e, -1))  # those that begin before e
            if not k or reach[k - 1] <= s:
                out.add(("phone", s, e))
    return sorted(out)


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    own = {kind: [(s, e) for k, s, e in base if k == kind] for kind in KINDS}

    def covered(kind, start, end):  # base spans of a kind don't overlap
        k = bisect_right(own[kind], (start, len(text))) - 1
        return k >= 0 and end <= own[kind][k][1]

    added = [x for x in hidden_spans(text) if not covered(*x)]
    return base, sorted([*base, *added], key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, found): arrays of struct<kind, start, end>, for every row."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [find(t) for t in strings(b.column("text"))]
            cols = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x[i]] for x in both], span) for i in (0, 1)]
            yield pa.record_batch([b.column("doc_id"), *cols], ["doc_id", "base", "found"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, f"doc_id long, base {kind}, found {kind}")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with every span replaced by its kind in angle brackets."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                if t is not None:
                    pieces, at = [], 0
                    for kind, s, e in find(t)[1]:
                        if s >= at:
                            pieces += [t[at:s], f"<{kind}>"]
                        at = max(at, e)
                    t = "".join(pieces) + t[at:]
                out.append(t)
            yield pa.record_batch([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, "doc_id long, text string")


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def digest(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    def text(column):
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(text("base"), 256).alias("base_sha256"), text("found").alias("spans"), (F.size("found") - F.size("base")).cast("long").alias("n_added"))


def digest_of(text: str) -> str:
    return hashlib.sha256(listed(base_spans(text)).encode()).hexdigest()
