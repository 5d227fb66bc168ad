"""Secret scans: three patterns, and Shannon entropy in windows that slide over candidate strings.

A candidate is a long run of characters of one class (hexadecimal, or base 64 with its URL
form), ``SHORTEST`` characters at least with up to two padding signs. Segments that are words around a stated
example mark ("example", "your"), and alphabets, are cut out of it, so that a key beside them is still
looked at. A window of fixed length slides over each piece; the counts of the window's characters, and
with them its entropy, are updated by the character that enters and the one that leaves. A shorter
piece is one window, with the same share of the largest possible entropy as threshold. The
windows whose entropy reaches the threshold are merged into spans. Left alone are pieces that
match the allow list (plain words, numbers, identifiers in the 8-4-4-4-12 form), pieces shorter than
a window made of words with numbers, spans with an example mark inside, and an entropy span inside a span of a pattern.

Defined cases: a null text is an empty text and has no spans; the whole text is scanned, however
long; rows stay as they are, repeated rows included; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, lean, slices, texts_of

#: Fixed patterns of the base kinds, with the least length of the group that counts.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

#: Least length of a candidate, padding included.
SHORTEST = 20
#: Candidate classes: pattern, window length, least entropy in bits of a window.
CLASSES = (
    ("hex", r"[0-9a-fA-F]{20,}", 24, 3.0),
    ("base64", r"[A-Za-z0-9+/_-]{18,}={0,2}", 24, 3.9),
)
#: Candidates that are never secrets.
ALLOW = (
    r"[A-Za-z]+(?:[-_/+][A-Za-z]+)*",
    r"[0-9]+(?:[-_/][0-9]+)*",
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
)
#: Stated examples, and alphabets.
MARK = re.compile(r"(?i:example|placeholder|changeme|your(?=[-_]))")
ALPHABET = re.compile(r"(?:0123456789abcdef(?:ghijklmnop(?:qrstuvwxyz)?)?|(?:abcdefghijklmnop(?:qrstuvwxyz)?|ABCDEFGHIJKLMNOP(?:QRSTUVWXYZ)?)(?:0123456789)?)+")
SEGMENT = re.compile(r"[^-_/+]+")
#: A segment of words, in camel case or capitals, or a number.
WORDY = re.compile(r"[a-z]*(?:[A-Z][a-z]+)*[0-9]*|[A-Z]+[0-9]*")


def entropy_spans(candidate: str, window: int, least: float) -> list[tuple[int, int]]:
    """Merged [start, end) of the windows whose Shannon entropy is at least ``least`` bits.

    With counts c of a window of n characters, H = log2 n - (sum of c log2 c) / n; only the
    sum's two changed terms are recomputed per step.
    """
    n = len(candidate)
    if n < window:
        return []
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, spans, start = 0.0, [], None
    limit = (math.log2(window) - least) * window + 1e-9
    for i, ch in enumerate(candidate):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += term[c + 1] - term[c]
        if i >= window:
            out = candidate[i - window]
            c = counts[out]
            counts[out] = c - 1
            total += term[c - 1] - term[c]
        at = i - window + 1
        if at >= 0 and total <= limit:
            if start is None or at > end:
                if start is not None:
                    spans.append((start, end))
                start = at
            end = i + 1
    if start is not None:
        spans.append((start, end))
    return spans


class Scanner:
    """Compiled patterns; ``spans(text)`` gives (start, kind index, end), sorted, in code points."""

    def __init__(self, classes=CLASSES, allow=ALLOW):
        self.assign, self.access, self.hex = re.compile(ASSIGN), re.compile(ACCESS), re.compile(HEX)
        self.classes = [(re.compile(p), w, h) for _, p, w, h in classes]
        self.allow = re.compile("|".join(f"(?:{a})" for a in allow), re.S) if allow else None

    def base(self, text: str) -> list[tuple[int, int, int]]:
        found = [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if m.end(1) - m.start(1) >= 8]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in self.access.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        return sorted(found)

    def pieces(self, run: str) -> list[tuple[int, int]]:
        """[start, end) of what is left of a run without alphabets and word-like segments with a mark."""
        if not self.allow:
            return [(0, len(run))]
        cuts = [m.span() for m in ALPHABET.finditer(run)]
        if MARK.search(run):
            cuts += [g.span() for g in SEGMENT.finditer(run) if MARK.search(run[g.start() : g.end() + 1]) and WORDY.fullmatch(g[0])]
        out, at = [], 0
        for a, b in [*sorted(cuts), (len(run), len(run))]:
            left = len(run[at:a]) - len(run[at:a].lstrip("-_/+")) if at else 0
            if a - at - left >= SHORTEST:
                out.append((at + left, a))
            at = max(at, b)
        return out

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        base, added = self.base(text), set()
        for pattern, window, least in self.classes:
            for m in pattern.finditer(text):
                for start, end in self.pieces(m[0]):
                    piece = m[0][start:end]
                    bare = piece.rstrip("=")
                    if self.allow and self.allow.fullmatch(bare):
                        continue
                    if self.allow and len(bare) < window and all(WORDY.fullmatch(g) for g in SEGMENT.findall(bare)):
                        continue
                    width = min(window, len(bare))
                    for a, b in entropy_spans(bare, width, least * math.log2(width) / math.log2(window)):
                        if self.allow and MARK.search(bare, a, b):
                            continue
                        a, b = a + m.start() + start, (len(piece) if b == len(bare) else b) + m.start() + start
                        if not any(s <= a and b <= e for s, _, e in base):
                            added.add((a, 3, b))
        kept = [x for x in added if not any(y != x and y[0] <= x[0] and x[2] <= y[2] for y in added)]
        return base, sorted(base + kept)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", classes=CLASSES, allow=ALLOW) -> DataFrame:
    """Per row: id, counts of the base kinds, ``base_sha256`` and ``spans`` as text, ``found`` as structs."""

    def scan(batches):
        scanner = Scanner(classes, allow)
        for batch in batches:
            for part in slices(batch, "text", 16 << 20):
                out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "found")}
                for text in texts_of(part.column("text")):
                    base, spans = scanner.spans(text)
                    kinds = [k for _, k, _ in base]
                    for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                        out[name].append(kinds.count(k))
                    out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                    out["spans"].append(joined(spans))
                    out["found"].append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), **out}, schema)

    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()),
        ("found", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
    ])
    two = docs.select(col(docs, id_col).cast("long").alias("doc_id"), col(docs, text_col).alias("text"))
    return two.mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind: string, start: int, end: int>>")


def redact_secrets(docs: DataFrame, *, text_col: str = "text", mark: str = "[REDACTED]", classes=CLASSES, allow=ALLOW) -> DataFrame:
    """The same rows and columns; each found span of the text is replaced by ``mark`` (touching spans by one)."""
    place = docs.columns.index(text_col)

    def clean(batches):
        lean()
        scanner = Scanner(classes, allow)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for i, text in enumerate(texts):
                _, spans = scanner.spans(text or "")
                if spans:
                    out, at = [], 0
                    for s, _, e in spans:
                        if s >= at:
                            out += [text[at:s], mark]
                        at = max(at, e)
                    texts[i] = "".join([*out, text[at:]])
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(clean, docs.schema)
