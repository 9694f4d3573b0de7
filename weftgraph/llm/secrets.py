"""Secret scanning: a keyword automaton first, anchored patterns near its hits, then checksums.

One Aho-Corasick automaton finds every keyword of a lower-cased text in one pass. A second one
finds 24 hexadecimal digits in a row on a copy of the text whose characters are mapped to
classes, since a bare digest has no keyword. Regular expressions are only tried at the
positions that these hits name. Kinds that embed a checksum are reported only if it is right.

The scan keeps nothing between documents: no shuffle, one pass, memory of one text. Runs that several hits share are
passed over once, so its time is in proportion to the text's length.

Cases: a null or empty text has no spans; a very long one is scanned whole; repeated rows are scanned each for itself; columns of
the input are left as they are, and clashing names are avoided by selecting the two inputs.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import functools
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order that breaks ties; the first three are the base patterns.
KINDS = ("assign", "access", "hex", "forge", "package", "private_key", "web_token")
BASE_KINDS = KINDS[:3]

#: Least lengths: the value of an assignment, an access key, a run of hexadecimal digits.
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_FORGE_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_FORGE = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_PACKAGE = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_KEY_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----")
_KEY_END = re.compile(r"(?=(-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----))")
_NOT_KEY = re.compile(r"[^A-Za-z0-9+/=\s:,.-]")
_WEB_PART, _WEB_REST = re.compile(r"[A-Za-z0-9_-]+"), re.compile(r"\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_HEX_CLASS = bytes(ord("h") if chr(b) in "0123456789abcdef" else ord(" ") for b in range(256))
_DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

Span = tuple[int, int, int]  # start, kind, end


def checksum62(body: str) -> str:
    """The six base-62 digits that forge and package tokens carry: CRC-32 of the body."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, digit = divmod(n, 62)
        out = _DIGITS62[digit] + out
    return out.rjust(6, "0")


def _json_header(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except (ValueError, binascii.Error, RecursionError):
        return False


@functools.cache
def _automata():
    import ahocorasick

    words = ahocorasick.Automaton()
    for word in _ASSIGN_WORDS:
        words.add_word(word, ("assign", len(word)))
    words.add_word("akia", ("access", 4))
    for word in _FORGE_WORDS:
        words.add_word(word, ("forge", 4))
    words.add_word("npm_", ("package", 4))
    words.add_word("-----begin ", ("private_key", 11))
    words.add_word("eyj", ("web_token", 3))
    words.make_automaton()
    runs = ahocorasick.Automaton()
    runs.add_word("h" * LEAST_HEX, LEAST_HEX)
    runs.make_automaton()
    return words, runs


class _Keys:
    """Private keys of one text, asked for in order of their starts; the whole text is passed over once."""

    def __init__(self, text: str):
        self.text, self.foreign, self.ends = text, -1, None

    def end(self, at: int) -> int | None:
        """Where the key that begins at ``at`` ends: the first END line, with nothing foreign to a key before it."""
        if not (m := _KEY_BEGIN.match(self.text, at)):
            return None
        if self.ends is None:
            self.ends = [(e.start(), e.end(1)) for e in _KEY_END.finditer(self.text)]
        if self.foreign < m.end():
            self.foreign = bad.start() if (bad := _NOT_KEY.search(self.text, m.end())) else len(self.text)
        k = bisect.bisect_left(self.ends, (m.end(), 0))
        return self.ends[k][1] if k < len(self.ends) and self.ends[k][0] <= self.foreign else None


class _Tokens:
    """Web tokens of one text, asked for in order of their starts; a run of their characters is passed over once.

    Whatever starts in one run goes on with the same two parts behind it, or fails with them.
    """

    def __init__(self, text: str):
        self.text, self.until, self.rest = text, -1, None

    def end(self, at: int) -> tuple[int, str] | None:
        """Where the token that begins at ``at`` ends, and its first part."""
        if not self.text.startswith("eyJ", at):
            return None
        if at >= self.until:
            self.until = _WEB_PART.match(self.text, at).end()
            self.rest = _WEB_REST.match(self.text, self.until)
        return (self.rest.end(), self.text[at : self.until]) if self.rest and self.until > at + 3 else None


def _tried(kind: str, text: str, at: int, keys: _Keys, tokens: _Tokens) -> tuple[int, bool] | None:
    """End of the pattern that starts at ``at`` and whether it passes its tests; None if none starts there."""
    if kind == "assign":
        return (m.end(), len(m[2]) >= LEAST_ASSIGN) if (m := _ASSIGN.match(text, at)) else None
    if kind == "access":
        return (m.end(), m.end() - at >= LEAST_ACCESS) if (m := _ACCESS.match(text, at)) else None
    if kind in ("forge", "package"):
        pattern = _FORGE if kind == "forge" else _PACKAGE
        return (m.end(), checksum62(m[1]) == m[2]) if (m := pattern.match(text, at)) else None
    if kind == "private_key":
        return (end, True) if (end := keys.end(at)) is not None else None
    return (found[0], _json_header(found[1])) if (found := tokens.end(at)) else None


def find_spans(text: str | None) -> list[Span]:
    """All spans (start, index of kind, end) in code points, in order of start and kind."""
    if not text:
        return []
    words, runs = _automata()
    narrow = text.encode("latin-1", "replace")  # one byte for each code point
    spans: list[Span] = []
    hits = sorted((end - size + 1, kind) for end, (kind, size) in words.iter(narrow.translate(_LOWER).decode("latin-1")))
    done: dict[str, int] = {}
    keys, tokens = _Keys(text), _Tokens(text)
    for at, kind in hits:
        if at < done.get(kind, 0):
            continue
        if found := _tried(kind, text, at, keys, tokens):
            done[kind] = found[0]
            if found[1]:
                spans.append((at, KINDS.index(kind), found[0]))
    classes = narrow.translate(_HEX_CLASS).decode("latin-1")
    if "h" * LEAST_HEX in classes:
        done_to = 0
        for end, size in runs.iter(classes):
            start = end - size + 1
            if start < done_to:
                continue
            stop = classes.find(" ", end)
            done_to = len(classes) if stop < 0 else stop
            spans.append((start, KINDS.index("hex"), done_to))
    spans.sort()
    return spans


def described(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every whole text: (id, spans array<struct<kind,start,end>>), a row for each row."""
    kind = "array<struct<kind:string,start:int,end:int>>"
    out_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_spans(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, out_type)], ["id", "spans"])

    ids = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {ids}, spans {kind}")


def redacted(df: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """The same rows and columns with each secret of the text replaced by ``mask``.

    Overlapping spans are replaced together. A null text stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            out = []
            for value in batch.column(at):
                text = value.as_py()
                parts, done = [], 0
                for start, _, end in find_spans(text):
                    if end <= done:
                        continue
                    if start >= done:
                        parts += [text[done:start], mask]
                    done = end
                out.append(text if not parts else "".join(parts) + text[done:])
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return df.mapInArrow(run, df.schema)


def report(df: DataFrame) -> DataFrame:
    """The contract's row for each document: counts of base kinds, their digest, and all spans."""
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(1):
                spans = find_spans(text.as_py())
                base = [s for s in spans if s[1] < len(BASE_KINDS)]
                counts = [sum(s[1] == k for s in base) for k in range(len(BASE_KINDS))]
                rows.append((*counts, hashlib.sha256(described(base).encode()).hexdigest(), described(spans)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return df.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)
