r"""Secret scans: three fixed patterns, and windows of high entropy in candidate strings.

Candidates are runs of 20 and more of ``[A-Za-z0-9+/=_-]``. A window of WINDOW characters slides over a candidate; the counts of
its characters change by one in and one out, and with them the sum of c log2 c that gives Shannon entropy. Stretches of windows
above the threshold of the candidate's character class become spans of kind ``entropy``, beside spans of fixed patterns in the same
place, unless the candidate is on the allow-list. Allowed words that stand alone between separators are cut out of stretches; what is
left is kept from a window on, unless an allow-list pattern for parts (``.*word.*``) matches it; then what lies outside of fixed spans
is looked at by itself. Work is linear in a text's length.

Arrow's RE2 first tells which texts can have a match at all; patterns run in Python over those alone, over whole texts.

Edge cases: null and empty texts have no spans; positions count code points; a text may be of any length; repeated rows are each
scanned; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sourcesieve.llm.pieces import blocks

# The patterns of the base kinds. A run of fewer characters than a kind asks for can't be part of a longer match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
WORD = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]+(?![A-Za-z0-9])")
#: Allow-list patterns that ask for a part of a string.
PART = re.compile(r"(\(\?[a-z]+\))?\.\*.*\.\*", re.DOTALL)
KINDS = ("assign", "access", "hex", "entropy")
MAY_ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]"
MAY_RUN = r"[A-Za-z0-9+/=_-]{20}"

WINDOW = 20
#: Bits a character that a window of a class must have. Twenty characters have 4.32 bits at most, hexadecimal ones 4.
THRESHOLDS = {"digits": 3.2, "hex": 3.3, "letters": 4.15, "mixed": 3.8}
#: Candidates that are known not to be secrets: UUIDs, alphabets and counts in order, rulers, documented examples.
ALLOWED = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"(?i).*(abcdefghijkl|0123456789abcdef|1234567890123|qwertyuiop).*",
    r"[-=_+/]+",
    r"(?i).*example.*",
    r"(?i)[a-z]+([-_/][a-z]+)+",
)

Span = tuple[str, int, int]
_C_LOG = [0.0] + [c * log2(c) for c in range(1, WINDOW + 1)]


def char_class(run: str) -> str:
    if run.isdigit():
        return "digits"
    if not run.strip("0123456789abcdef") or not run.strip("0123456789ABCDEF"):
        return "hex"
    return "letters" if run.isalpha() else "mixed"


def entropy_stretches(run: str, threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """[start, end) of the united windows of run whose entropy reaches the threshold. window: WINDOW characters at most."""
    if len(run) < window:
        return []
    counts: dict[str, int] = {}
    total = 0.0
    most = window * (log2(window) - threshold) + 1e-9  # entropy is log2(window) - total / window
    found: list[tuple[int, int]] = []
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        if i >= window:
            old = run[i - window]
            if old != c:
                m = counts[old]
                total += _C_LOG[m - 1] - _C_LOG[m] + _C_LOG[n + 1] - _C_LOG[n]
                counts[old], counts[c] = m - 1, n + 1
        else:
            total += _C_LOG[n + 1] - _C_LOG[n]
            counts[c] = n + 1
        start = i - window + 1
        if start >= 0 and total <= most:
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


def base_spans(text: str, assign: bool = True, runs: bool = True) -> list[Span]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if assign else []
    if runs:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _remainders(stretches: list[tuple[int, int]], cuts: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What cuts leave of stretches, where it has WINDOW characters; both in order, none meeting another of its kind."""
    i = 0
    for start, end in stretches:
        while i < len(cuts) and cuts[i][1] <= start:
            i += 1
        for a, b in [*itertools.takewhile(lambda c: c[0] < end, itertools.islice(cuts, i, None)), (end, end)]:  # noqa: B023
            if min(a, end) - start >= WINDOW:
                yield start, min(a, end)
            start = max(start, b)


def _plain_words(run: str, inside: list[re.Pattern]) -> list[tuple[int, int]]:
    """Allowed words in plain case that stand alone between separators: a path's ``example`` says nothing about what follows."""
    found = (m for m in WORD.finditer(run) if m[0].islower() or m[0].isupper() or m[0].istitle())
    return [m.span() for m in found if any(a.fullmatch(m[0]) for a in inside)]


def _covered(spans: list[Span]) -> list[tuple[int, int]]:
    """Where spans (in order) are, those that meet as one."""
    out: list[tuple[int, int]] = []
    for _, a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_spans(text: str, allowed: tuple[re.Pattern, ...], assign: bool = True, runs: bool = True) -> tuple[list[Span], list[Span]]:
    """The spans of the fixed patterns, and those that entropy adds; both in order."""
    base = in_order(base_spans(text, assign, runs))
    covered = _covered(base)
    ends = [b for _, b in covered]
    inside = [a for a in allowed if PART.fullmatch(a.pattern)]
    whole = [a for a in allowed if not PART.fullmatch(a.pattern)]
    added: list[Span] = []
    for m in CANDIDATE.finditer(text) if runs else ():
        run, at = m[0], m.start()
        stretches = entropy_stretches(run, THRESHOLDS[char_class(run)])
        if not stretches or any(a.fullmatch(run) for a in whole):
            continue
        for a, b in _remainders(stretches, _plain_words(run, inside)):
            known = lambda x, y: any(p.fullmatch(text, x, y) for p in inside)
            if not known(at + a, at + b):
                added.append(("entropy", at + a, at + b))
                continue
            # what is known may lie in a fixed span: the rest counts by itself
            fixed = itertools.takewhile(lambda c: c[0] < at + b, itertools.islice(covered, bisect.bisect_right(ends, at + a), None))  # noqa: B023
            cuts = list(fixed)
            added += [("entropy", x, y) for x, y in _remainders([(at + a, at + b)], cuts) if cuts and not known(x, y)]
    return base, added


def scan(texts: pa.Array, allow: tuple[str, ...] = ALLOWED) -> Iterator[tuple[list[Span], list[Span]]]:
    """find_spans() of each text."""
    allowed = tuple(re.compile(a) for a in allow)
    texts = pc.fill_null(texts, "")
    assign, runs = (pc.match_substring_regex(texts, p).to_pylist() for p in (MAY_ASSIGN, MAY_RUN))
    for i, (a, r) in enumerate(zip(assign, runs, strict=True)):
        yield find_spans(texts[i].as_py(), allowed, a, r) if a or r else ([], [])


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", allow: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Per row: how many spans of each base kind, the SHA-256 of the base spans, and all spans, as kind:start:end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            rows = []
            for base, added in scan(batch.column(1), allow):
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
                rows.append((*n, hashlib.sha256(written_spans(base).encode()).hexdigest(), written_spans(in_order(base + added))))
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()] * 2, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each stretch of spans that meet replaced by ``[kind]``, the kind of the first of them."""
    out, end = [], 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[end:a], f"[{kind}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact(df: DataFrame, text: str = "text", allow: tuple[str, ...] = ALLOWED, length: str | None = None) -> DataFrame:
    """df with the secrets in its text replaced; texts without any, null ones included, stay as they are. length: a column that
    gets the new number of code points where a text changed."""
    at = df.columns.index(text)
    size_at = df.columns.index(length) if length and length in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, at):
            changed = {}
            for i, (base, added) in enumerate(scan(batch.column(at), allow)):
                if base or added:
                    changed[i] = redacted(batch.column(at)[i].as_py(), in_order(base + added))
            columns = list(batch.columns)
            if changed:
                columns[at] = pa.array([changed.get(i, x) for i, x in enumerate(columns[at].to_pylist())], columns[at].type)
                if size_at is not None:
                    columns[size_at] = pa.array([len(changed[i]) if i in changed else x for i, x in enumerate(columns[size_at].to_pylist())], columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, T.StructType(df.schema.fields))
