"""Secret scans with multipart credential linking.

Base patterns find assignments, access identifiers and long hexadecimal strings; these are always reported. Credentials
often come in parts, though: an identifier, a secret, an endpoint. Weak candidates of each part (random-looking strings,
account names, addresses) mean little alone. They are reported only if the parts they need stand in the same scope:
the block of lines up to the next blank lines, such as a config of any length, and ``REACH`` code points on both sides,
which is all there is for a block of one line. Each weak span, widened to its scope, is joined as an interval with the
spans of the complementary roles.

    weak secret    needs an identifier (access or account)
    weak account   needs a secret (assign, hex or weak)
    weak endpoint  needs both

Spans of a role are sorted and disjoint, so each join is a binary search, not a comparison of all pairs. All parts of a
scope are in one row, so nothing is shuffled; memory is bounded by the longest text.

Null text counts as empty and has no spans. Each row is judged on its own, repeated or not; ids may be null. An empty
table gives no rows. Other columns are not read by ``scan`` and passed on by ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstmonth.llm.common import sliced

REACH = 200
MASK = "[SECRET]"

ASSIGN, ACCESS, HEX = "assign", "access", "hex"
SECRET, ACCOUNT, ENDPOINT = "secret", "account", "endpoint"
KINDS = (ASSIGN, ACCESS, HEX, SECRET, ACCOUNT, ENDPOINT)
BASE = KINDS[:3]

_NAMES = "password|passwd|secret|token|api_?key"
_ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")  # a run fits as a whole or not at all
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_ACCOUNT = re.compile(
    r"""(?<![A-Za-z0-9_])(?:user(?:name)?|login|account|client_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]+""", re.IGNORECASE | re.ASCII
)
_ENDPOINT = re.compile(
    r"""(?<![a-z0-9+.-])(?:[a-z][a-z0-9+.-]*://[^\s"'<>]+|[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}:[0-9]{2,5})""",
    re.IGNORECASE | re.ASCII,
)
_BLANK_LINES = re.compile(r"\n(?:[^\S\n]*\n)+")

Span = tuple[int, int, str]

SCHEMA = """doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string,
    links array<struct<weak_kind: string, weak_start: long, part_kind: string, part_start: long>>"""


def base_spans(text: str) -> list[Span]:
    """Spans (start, end, kind) of the base patterns, leftmost and disjoint within each kind."""
    found = [(m.start(), m.end(), ASSIGN) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), ACCESS) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), HEX) for m in _HEX.finditer(text)]
    return found


def weak_spans(text: str, strong: list[Span]) -> dict[str, list[Span]]:
    """Candidates by kind that don't touch a base span; none if there is no identifier, which all need in the end."""
    accounts = list(_ACCOUNT.finditer(text))
    if not accounts and not any(kind == ACCESS for _, _, kind in strong):
        return {SECRET: [], ACCOUNT: [], ENDPOINT: []}
    taken = sorted((start, end) for start, end, _ in strong)
    starts = [start for start, _ in taken]
    ends, furthest = [], 0  # ends may nest: keep the furthest so far
    for _, end in taken:
        furthest = max(furthest, end)
        ends.append(furthest)

    def free(m: re.Match) -> bool:
        i = bisect_left(starts, m.end())
        return not i or ends[i - 1] <= m.start()

    return {
        SECRET: [(m.start(), m.end(), SECRET) for m in _RANDOM.finditer(text) if _looks_random(m[0]) and free(m)],
        ACCOUNT: [(m.start(), m.end(), ACCOUNT) for m in accounts if free(m)],
        ENDPOINT: [(m.start(), m.end(), ENDPOINT) for m in _ENDPOINT.finditer(text) if free(m)],
    }


def _looks_random(value: str) -> bool:
    """Letters of both cases and digits, and at least 3.5 bits a character."""
    if not (re.search("[a-z]", value) and re.search("[A-Z]", value) and re.search("[0-9]", value)):
        return False
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) >= 3.5


def blocks(text: str) -> list[tuple[int, int]]:
    """Bounds (start, end) of the blocks between blank lines that have more than one line, ascending."""
    found, start = [], 0
    for m in [*_BLANK_LINES.finditer(text), None]:
        end = m.start() if m else len(text)
        if "\n" in text[start:end].strip():
            found.append((start, end))
        start = m.end() if m else end
    return found


def nearby(scope: tuple[int, int], parts: list[Span], starts: list[int]) -> Span | None:
    """The last of the disjoint, sorted ``parts`` that overlaps ``scope``."""
    i = bisect_left(starts, scope[1])
    return parts[i - 1] if i and parts[i - 1][1] > scope[0] else None


def credential_spans(text: str, reach: int = REACH) -> tuple[list[Span], list[tuple[Span, Span]]]:
    """All reported spans, sorted by start and kind, and the links that made weak ones count."""
    strong = base_spans(text)
    weak = weak_spans(text, strong)
    by_kind = {**{kind: sorted(s for s in strong if s[2] == kind) for kind in BASE}, **weak}
    starts = {kind: [s[0] for s in spans] for kind, spans in by_kind.items()}
    bounds = blocks(text) if any(weak.values()) else []
    block_starts = [start for start, _ in bounds]

    def scope_of(span: Span) -> tuple[int, int]:
        start, end = span[0] - reach, span[1] + reach
        i = bisect_right(block_starts, span[0])
        if i and bounds[i - 1][1] >= span[1]:
            start, end = min(start, bounds[i - 1][0]), max(end, bounds[i - 1][1])
        return start, end

    def joined(span: Span, kinds: tuple[str, ...]) -> Span | None:
        scope = scope_of(span)
        found = (nearby(scope, by_kind[kind], starts[kind]) for kind in kinds)
        return next((part for part in found if part and part != span), None)

    identifiers, secrets = (ACCESS, ACCOUNT), (ASSIGN, HEX, SECRET)
    needed = {SECRET: [identifiers], ACCOUNT: [secrets], ENDPOINT: [identifiers, secrets]}
    spans, links = list(strong), []
    for kind, roles in needed.items():
        for span in weak[kind]:
            parts = [joined(span, role) for role in roles]
            if all(parts):
                spans.append(span)
                links += [(span, part) for part in parts]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])), links


def _spelled(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """For each of ``docs`` (``doc_id``, ``text``) the number of base spans, all spans, and the links of weak ones."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans, links = credential_spans(text or "", reach)
                base = [s for s in spans if s[2] in BASE]
                n = Counter(kind for _, _, kind in base)
                digest = hashlib.sha256(_spelled(base).encode()).hexdigest()
                made = [{"weak_kind": a[2], "weak_start": a[0], "part_kind": b[2], "part_start": b[0]} for a, b in links]
                rows.append((doc_id, n[ASSIGN], n[ACCESS], n[HEX], digest, _spelled(spans), made))
            link = [("weak_kind", pa.string()), ("weak_start", pa.int64()), ("part_kind", pa.string()), ("part_start", pa.int64())]
            types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.list_(pa.struct(link))]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "links"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, SCHEMA)


def masked(text: str, reach: int = REACH) -> str:
    """``text`` with every reported span, and spans that overlap, replaced by one mask."""
    kept, at = [], 0
    for start, end, _ in credential_spans(text, reach)[0]:
        if start >= at:
            kept += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*kept, text[at:]])


def redact(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """All of ``docs`` with secrets masked in ``text``, and ``n_chars`` counted anew if it is there."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: None if text is None else masked(text, reach))

    cleaned = docs.withColumn("text", mask("text"))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(kind))
    return cleaned
