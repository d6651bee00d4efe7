"""Multipart credential linking.

Single-part secrets are found by pattern and always reported. A token that looks like a secret but carries no keyword (a
*weak candidate*) is reported only where a complementary part, an access identifier or an endpoint, lies within reach
inside the same scope; such parts are reported beside secrets of either sort. This is an interval join of the parts of a
text, done as a sweep over their sorted positions, so a text with very many parts never yields all their pairs. Every text
is one row and is handled whole; there is no shuffle.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from cohortry.llm.common import query, table, text_slices, texts_of

# fixed values of the contract
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # 20 characters with the prefix; a shorter run is consumed and dropped anyway
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_LEAST = 6
_SECRETS = ("secret", "assign", "hex")  # kinds on the secret side of a link

# parts of the linking method, of any length; possessive repeats keep the scans linear
_LABELLED_ID = re.compile(
    r"""(?:client_?id|account_?id|access_?key_?id|user_?name|login)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9@._-]{3,}+)""",
    re.IGNORECASE | re.ASCII,
)
_ENDPOINT = re.compile(
    r"(?:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]{3,}+"
    r"|(?<![A-Za-z0-9.-])(?:[a-z0-9-]++\.)+(?:internal|local|com|net|org|io)(?::[0-9]{2,5})?(?![A-Za-z0-9.-])",
    re.ASCII,
)
_WEAK = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
_BREAK = re.compile(r"\n[\x20\t\r]*\n")

_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_assign", pa.int64()),
        ("n_access", pa.int64()),
        ("n_hex", pa.int64()),
        ("base_sha256", pa.string()),
        ("spans", pa.string()),
        ("n_linked", pa.int64()),
    ]
)
_DDL = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [(2, m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


def _looks_secret(token: str) -> bool:
    """Letters and digits mixed with an entropy above 3 bits a character."""
    kinds = sum(bool(re.search(p, token)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    if kinds < 2 or not re.search("[0-9]", token):
        return False
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) > 3.0


def linked_spans(text: str, base: list[tuple[int, int, int]], reach: int) -> list[tuple[str, int, int]]:
    """Secrets with a complementary part in reach and scope, and the parts they are linked to.

    Secrets are weak candidates and the assign and hex spans of ``base``; a hex span inside an assign span is the same
    secret. A part that overlaps a secret does not complement it. A scope ends at an empty line. A part reaches ``reach``
    code points to either side of itself. Every secret with some part in reach and scope is given, and every part with
    some secret there: two sweeps of binary searches, no pairs.
    """
    strong = sorted((s, e) for _, s, e in base)

    furthest = list(accumulate((e for _, e in strong), max))

    def free(start: int, end: int) -> bool:
        i = bisect_left(strong, (end, -1))  # all before it start ahead of the candidate's end
        return not i or furthest[i - 1] <= start

    weak = [(m.start(), m.end()) for m in _WEAK.finditer(text) if _looks_secret(m[0]) and free(m.start(), m.end())]
    candidates = [("secret", s, e) for s, e in weak] + [("assign", s, e) for k, s, e in base if k == 0]
    assigned = [(s, e) for k, s, e in base if k == 0]  # of one kind, so both starts and ends ascend
    for k, s, e in base:
        i = bisect_right(assigned, (s, len(text))) if k == 2 else 0
        if k == 2 and not (i and e <= assigned[i - 1][1]):
            candidates.append(("hex", s, e))
    if not candidates:
        return []
    parts = [("identifier", s, e) for k, s, e in base if k == 1]
    parts += [("identifier", m.start(1), m.end(1)) for m in _LABELLED_ID.finditer(text)]
    parts += [("endpoint", m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
    breaks = [m.start() for m in _BREAK.finditer(text)]
    return sorted({*_near(candidates, parts, breaks, reach), *_near(parts, candidates, breaks, reach)}, key=lambda x: x[1:])


def _near(
    spans: list[tuple[str, int, int]], others: list[tuple[str, int, int]], breaks: list[int], reach: int
) -> Iterator[tuple[str, int, int]]:
    """The spans with any of the others in reach and scope, on either side.

    The nearest one on a side tells: one further off has a longer gap and at least the same breaks in it.
    """
    starts, ends = sorted(s for _, s, _ in others), sorted(e for _, _, e in others)
    for kind, start, end in spans:
        after, before = bisect_left(starts, end), bisect_right(ends, start) - 1
        gaps = [(end, starts[after])] if after < len(starts) else []
        gaps += [(ends[before], start)] if before >= 0 else []
        if any(high - low <= reach and bisect_left(breaks, low) == bisect_left(breaks, high) for low, high in gaps):
            yield kind, start, end


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        rows = []
        for text in texts_of(batch):
            base = sorted(base_spans(text), key=lambda x: (x[1], x[0]))
            named = [(KINDS[k], s, e) for k, s, e in base]
            linked, known = linked_spans(text, base, reach), set(named)
            extra = [x for x in linked if x not in known and ("access", *x[1:]) not in known]
            order = {k: i for i, k in enumerate((*KINDS, "identifier", "secret", "endpoint"))}
            every = sorted(named + extra, key=lambda x: (x[1], order[x[0]]))
            counts = [sum(x[0] == k for x in base) for k in range(3)]
            digest = hashlib.sha256(joined(named).encode()).hexdigest()
            rows.append((*counts, digest, joined(every), sum(k in _SECRETS for k, _, _ in linked)))
        ids = batch.column("doc_id")
        columns = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, f.type) for c, f in zip(columns, list(_SCHEMA)[1:])]], schema=_SCHEMA)


def link_credentials(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """One row per row of ``docs``: counts of base spans, their digest, and all spans with the linked parts.

    Span kinds beside the base ones: ``secret`` (a weak candidate), ``identifier``, ``endpoint`` (parts linked to a secret).
    ``n_linked`` counts the secrets with a part, whether weak or base spans (assign, hex). A null or empty text has no spans (digest of the empty string). Repeated rows give repeated results, a
    null id stays null, an empty table gives an empty result, other columns are ignored whatever their names. Spans of
    one kind never overlap, so ties in start are between kinds only and follow the order of the kinds.
    """
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(lambda batches: _scan(batches, reach), _DDL)


@query("op1_credential_linking")
def _(spark, sf):
    return link_credentials(table(spark, sf, "documents"))
