"""Secret scan: three exact patterns, and the entropy of a window that slides over candidate strings.

* Base spans: assignments to a secret's name, access keys and long hex strings, by fixed patterns.
* A candidate is a run of ``WINDOW`` or more characters of the base-64 alphabets. A window of that many characters slides
  over it; character counts and the sum of ``c log c`` are updated for the character that leaves and the one that enters,
  never recomputed. The threshold depends on the class of the window (digits, hex, one case of letters, mixed), so a
  prefix such as ``hmac=`` does not change what the hex after it needs. Windows above it unite to a span of kind
  ``entropy``. UUIDs are left out, and so are windows that read as words (most of their letter pairs are common ones,
  which random letters fail), numbers with separators and digits that count up or down. Spans that touch a base span
  are suppressed. Any other run of ``WINDOW`` or more digits is a candidate: a long number can't be told from a key.

Every row is scanned by itself and as a whole, so nothing is shuffled. Defined results: null and empty texts have no
spans; repeated rows repeat; an empty table gives an empty result; a span touching several kinds is listed for each. Only
``doc_id`` and ``text`` are read; ``redacted`` keeps all columns and counts ``n_chars`` again where there is one.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import slices

# fixed values: the patterns of the base kinds, and how many characters each needs
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Bits a character that a window needs, by its class; log2(20) = 4.32 is the most there can be, log2(10) = 3.32 for digits.
#: Of random windows of digits, of hex and of one case more than nine of ten reach it.
BITS = {"digits": 2.6, "hex": 3.1, "one case": 3.4, "mixed": 3.7}
#: Whole runs that look random but are no secrets: UUIDs.
ALLOWED = (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",)
#: Runs of digits and separators (numbers, rules), and of plain or capitalised words (also joined ones). Nothing that has matched
#: is given back, so a run takes time in proportion to its length.
NUMBERS = r"[0-9_+/=-]+"
WORDS = r"(?:[A-Z]?[a-z]++|[A-Z]++)(?:[_/+=-]++(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,4}+))*+[_/+=-]*+"
#: Letter pairs that are common in English, German, French or Spanish words: a first letter, then all its seconds.
#: They are 304 of 676, so few windows of random letters (2.5 of 100) have ``COMMON`` of their pairs among them.
PAIRS = frozenset(
    group[0] + second
    for group in (
        "abcdefgiklmnprstuvy baeijlorstuy cacehiklortu dadeiorsu eabcdefgijklmnpqrstuvwxyz faefilortuy gaehilnorstu haeilmnortu "
        "iabcdefgklmnopqrstvz jaeou kaeilnorstu labdefiloqstuyz mabeimopsu nacdefgiklnoqstuvz oabcdefgilmnoprstuvw paefhiloprstuy "
        "qu racdefgiklmnopqrstuvwyz sacehiklopstuyz tacehilmoprstuwyz uabcdegijlmnoprstx vaei waehinoru xaceipt yoprst zaeou"
    ).split()
    for second in group[1:]
)
COMMON = 0.7

_ASSIGN, _ACCESS, _HEX = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX)
_LONG = re.compile(rb"[A-Za-z0-9+/_=-]{%d}" % WINDOW)
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
_NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")

Span = tuple[int, int, int]


def _kind(c: str) -> str:
    """The characters that classes tell apart: digits, letters by case and whether they are hex, all others."""
    if c.isdigit():
        return "0"
    if not c.isalpha():
        return "-"
    return ("a" if c <= "f" else "g") if c.islower() else ("A" if c <= "F" else "G")


_KIND = {c: _kind(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"}


def _class_of(kinds: set[str]) -> str:
    if kinds <= {"0"}:
        return "digits"
    if kinds <= {"0", "a"} or kinds <= {"0", "A"}:
        return "hex"
    return "one case" if kinds <= {"a", "g"} or kinds <= {"A", "G"} else "mixed"


def character_class(run: str) -> str:
    return _class_of({_KIND[c] for c in run})


def reads_as_words(window: str) -> bool:
    """Whether most pairs of neighbouring letters are common. Too few pairs (pieces of one or two letters) tell nothing."""
    low = window.lower()
    pairs = [low[k : k + 2] for k in range(len(low) - 1) if low[k].isalpha() and low[k + 1].isalpha()]
    return 2 * len(pairs) < len(window) or sum(p in PAIRS for p in pairs) >= COMMON * len(pairs)


def counts_on(window: str) -> bool:
    """Whether digits mostly go on by the same step, as 1234567890 does."""
    steps = [(int(b) - int(a)) % 10 for a, b in zip(window, window[1:], strict=False)]
    return 2 * max(map(steps.count, steps)) > len(steps)


def harmless(run: str) -> Callable[[str, str], bool]:
    """Which windows (with their class) of ``run`` look random but are no secrets."""
    numbers, words = re.fullmatch(NUMBERS, run) is not None, re.fullmatch(WORDS, run) is not None

    def spare(window: str, kind: str) -> bool:
        if kind == "digits":
            return counts_on(window)
        return numbers or (kind == "one case" or words) and reads_as_words(window)

    return spare


def high_entropy(
    run: str, window: int = WINDOW, bits: dict[str, float] = BITS, spare: Callable[[str, str], bool] | None = None
) -> list[tuple[int, int]]:
    """United windows of ``run`` whose entropy reaches the threshold of their class, without those that ``spare`` names."""
    counts, kinds, total = {}, {}, 0.0
    log = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]
    least = min(bits.values()) - 1e-9
    found: list[tuple[int, int]] = []
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        total += log[n + 1] - log[n]
        counts[c] = n + 1
        kinds[_KIND[c]] = kinds.get(_KIND[c], 0) + 1
        if i >= window:
            gone = run[i - window]
            n = counts[gone]
            total += log[n - 1] - log[n]
            counts[gone] = n - 1
            kinds[_KIND[gone]] -= 1
        if i < window - 1 or (entropy := math.log2(window) - total / window) < least:
            continue
        kind, start = _class_of({k for k, n in kinds.items() if n}), i - window + 1
        if entropy < bits[kind] - 1e-9 or spare is not None and spare(run[start : i + 1], kind):
            continue
        if found and start <= found[-1][1]:
            found[-1] = (found[-1][0], i + 1)
        else:
            found.append((start, i + 1))
    return found


def base_spans(text: str) -> list[Span]:
    """``start, kind, end`` of the base kinds in order; a match that is too short still uses up its characters."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found)


def entropy_spans(text: str, base: list[Span], allowed: tuple[str, ...] = ALLOWED) -> list[Span]:
    allow, found = re.compile("|".join(f"(?:{a})" for a in allowed) if allowed else r"(?!)"), []
    for m in _RUN.finditer(text):
        if allow.fullmatch(m.group()):
            continue
        for a, b in high_entropy(m.group(), spare=harmless(m.group())):
            a, b = a + m.start(), b + m.start()
            if not any(s < b and a < e for s, _, e in base):
                found.append((a, 3, b))
    return found


def spans_of(raw: bytes) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text in UTF-8. Texts without any of the needed byte strings are left at once."""
    low = raw.lower()
    long = _LONG.search(raw) is not None
    if not long and b"AKIA" not in raw and not any(n in low for n in _NAMES):
        return [], []
    text = raw.decode("utf-8", "replace")
    base = base_spans(text)
    return base, sorted(base + entropy_spans(text, base)) if long else base


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans``, a row for each row of ``docs``."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            both = [spans_of(t) for t in texts]
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in both], pa.int64()) for k in range(3)]
            digest = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in both]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(digest, pa.string()), pa.array([written(s) for _, s in both], pa.string())], names
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def without_spans(raw: bytes, mark: str) -> str | None:
    """The text with each united span replaced, or None if it has no span."""
    _, spans = spans_of(raw)
    if not spans:
        return None
    text, parts, at = raw.decode("utf-8", "replace"), [], 0
    for a, _, b in spans:
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; rows without one stay as they are, all rows stay."""
    schema = docs.schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            new = [without_spans(t, mark) for t in texts]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            old = columns["text"].to_pylist()
            columns["text"] = pa.array([o if n is None else n for o, n in zip(old, new, strict=True)], columns["text"].type)
            if "n_chars" in columns:
                was = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([w if n is None else len(n) for w, n in zip(was, new, strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(clean, schema)
