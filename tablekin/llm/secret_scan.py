"""Secrets in texts, also below nested encodings.

A worklist unwraps each text layer by layer: percent escapes, backslash and character-reference escapes, base64 runs,
and gzip or zlib streams inside decoded bytes. Every layer is scanned with the same three patterns and each hit is
mapped back to the span of the original text it came from. Layers already seen in a text are not opened again, so a
chain of decodings ends at its fixpoint.

Defined cases: a null text counts as empty and has no spans; a very long text is scanned whole; kinds that start at the
same place tie and go as listed; repeated rows are scanned each; an empty table gives an empty result; further columns
are ignored, or kept where texts are redacted. A compressed stream is read in overlapping windows, each unwrapped and
scanned like any layer, whatever its bytes; the overlap holds any encoded run of up to LONGEST bytes.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import html
import itertools
import re
import urllib.parse
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import SLICE, arrow_map, map_batches, table

KINDS = ("assign", "access", "hex")
#: Bytes of a compressed stream handled at a time, the least overlap of two windows, and the most.
PIECE, OVERLAP, LONGEST = 8 << 20, 4096, 16 << 20
_RUN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-.%\\&#;{}\r\n"
#: The contract's patterns with its least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

_WORDS = ("passw", "secret", "token", "api")
_PERCENT_ONE = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: A word of form data, in which a plus sign is a blank, and what is decoded there.
_FORM, _FORM_ONE = re.compile(r"[^\s\"'<>]+"), re.compile(r"\+|(?:%[0-9A-Fa-f]{2})+")
#: Escapes of an escape's own first character, over and over. Such a run is halved at a time, whatever its depth: what lies
#: between differs in the length of the run only.
_NESTED = re.compile(r"%(?:25){4,}|&(?:amp;){4,}|&(?:#38;){4,}|&(?:#x26;){4,}|\\(?:u005[cC]){4,}|\\(?:x5[cC]){4,}")
_PERIOD = {"%": 2, "&a": 4, "&#3": 4, "&#x": 5, "\\u": 5, "\\x": 3}
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|&(?:quot|apos|amp|lt|gt|equals|colon);")
#: Compressed bytes as percent escapes (other characters standing for themselves), and as characters.
_PERCENT_PACKED = re.compile(r"(?:%1[Ff]%8[Bb]|(?:%78|x)(?:%01|%5[Ee]|%9[Cc]|%[Dd][Aa]|\^%))[!-~]*")
_RAW_PACKED, _BYTES = re.compile(r"\x1f\x8b|x[\x01\x9c\xda]"), re.compile(r"[\x00-\xff]*")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A run and the lines after it that are base64 throughout; the last may have text after a blank.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]++(?![^\s=\"'<,;)]))+={0,2}")
_BREAK = re.compile(r"[ \t]*\r?\n[ \t]*")
#: What a decoded text must hold to be worth unwrapping.
_DEEPER = re.compile(r"%[0-9A-Fa-f]{2}|\\[ux]|&[#a-z]|[A-Za-z0-9+/_-]{16}|[A-Za-z0-9+/_-]\r?\n|\x1f\x8b|x[\x01\x9c\xda]")


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the matches of one layer, by start and then kind as listed."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return found


class Layer:
    """A text and, for its characters, the spans of the original text they stand for.

    cuts: ascending (start in this text, first and last original position, step); between cuts a step of 1 maps each
    character to one, a step of 0 maps all of them to the whole span.
    """

    def __init__(self, text: str, cuts: list[tuple[int, int, int, int]]):
        self.text, self.cuts, self.starts = text, cuts, [c[0] for c in cuts]

    def span(self, start: int, end: int) -> tuple[int, int]:
        first = self.cuts[bisect.bisect_right(self.starts, start) - 1]
        last = self.cuts[bisect.bisect_right(self.starts, max(start, end - 1)) - 1]
        left = first[1] + (start - first[0]) if first[3] else first[1]
        right = last[1] + (end - 1 - last[0]) + 1 if last[3] else last[2]
        return left, max(left, right)

    def part(self, start: int, end: int, text: str) -> Layer:
        """A decoded text all of which stands for [start, end) of this layer."""
        left, right = self.span(start, end)
        return Layer(text, [(0, left, right, 0)])

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Layer:
        """This text with (start, end, new text) applied; what stays keeps its character-wise mapping."""
        out, cuts, at, length = [], [], 0, 0
        for start, end, new in [*edits, (len(self.text), len(self.text), "")]:
            if start > at:
                k = bisect.bisect_right(self.starts, at) - 1
                while k < len(self.cuts) and self.cuts[k][0] < start:
                    a = max(at, self.cuts[k][0])
                    c = self.cuts[k]
                    cuts.append((length + a - at, c[1] + (a - c[0]) if c[3] else c[1], c[2], c[3]))
                    k += 1
                out.append(self.text[at:start])
                length += start - at
            if new:
                cuts.append((length, *self.span(start, end), 0))
                out.append(new)
                length += len(new)
            at = end
        return Layer("".join(out), cuts or [(0, 0, 0, 0)])


def _char(m: re.Match) -> str | None:
    for group, base in ((1, 16), (2, 16), (3, 16), (4, 16), (5, 10)):
        if m.group(group):
            code = int(m.group(group), base)
            return chr(code) if (group == 3 or code) and code < 0x110000 and not 0xD800 <= code < 0xE000 else None
    return html.unescape(m.group())


def _readable(raw: bytes) -> str | None:
    """Decoded bytes as text if they are text: valid UTF-8 with almost no control characters."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    odd = sum(1 for c in text if c < " " and c not in "\t\n\r\x0b\x0c")
    return text if text and odd * 20 <= len(text) else None


def _text(raw: bytes) -> str:
    """Bytes as text whatever they are: UTF-16 if it is marked so or every other byte is mostly zero, UTF-8, or else one
    character a byte, which keeps all ASCII in place."""
    half = len(raw) // 2
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    if half >= 8 and b"\0" in raw:
        for first, name in ((1, "utf-16-le"), (0, "utf-16-be")):
            if 2 * raw[first::2].count(0) >= half and 8 * raw[1 - first :: 2].count(0) <= half:
                return raw.decode(name, "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _packed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] * 256 + raw[1]) % 31 == 0


def _stream(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The inflated bytes of a gzip or zlib stream and of all members after it, at most PIECE at a time."""
    stream, held = zlib.decompressobj(47), b""
    for chunk in chunks:
        rest = held + chunk
        held = b""
        while True:
            if stream is None:
                rest = rest.lstrip(b"\0")  # padding between members
                if len(rest) < 3:
                    held = rest
                    break
                if not _packed(rest):
                    return
                stream = zlib.decompressobj(47)
            try:
                out = stream.decompress(rest, PIECE)
            except zlib.error:
                return
            if out:
                yield out
            rest = stream.unconsumed_tail
            if stream.eof:
                stream, rest = None, stream.unused_data
            elif not rest and len(out) < PIECE:
                break


def _inflated(raw: bytes) -> Iterator[bytes] | None:
    """The bytes below all compressed layers of raw, piece by piece; None if raw is not compressed."""
    first, pieces, seen = raw, iter(()), set()
    while _packed(first) and (key := hashlib.blake2b(first).digest()) not in seen:  # a stream may inflate to itself
        below = _stream(itertools.chain([first], pieces))
        if (new := next(below, None)) is None:
            break
        seen.add(key)
        first, pieces = new, below
    return itertools.chain([first], pieces) if seen else None


def _packed_parts(text: str) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, bytes) of compressed streams that stand in a text as characters."""
    at = 0
    while m := _RAW_PACKED.search(text, at):
        at = m.start() + 1
        try:
            zlib.decompressobj(47).decompress(text[m.start() : m.start() + 64].encode("latin-1", "replace"), 1)
            raw = _BYTES.match(text, m.start()).group().encode("latin-1")
            stream, rest = zlib.decompressobj(47), raw
            while rest and not stream.eof:
                stream.decompress(rest, PIECE)
                rest = stream.unconsumed_tail
        except zlib.error:
            continue
        end = m.start() + len(raw) - len(stream.unused_data)
        while end < m.start() + len(raw) and _packed(more := raw[end - m.start() :]):
            stream = zlib.decompressobj(47)
            try:
                while more and not stream.eof:
                    stream.decompress(more, PIECE)
                    more = stream.unconsumed_tail
            except zlib.error:
                break
            end = m.start() + len(raw) - len(stream.unused_data)
        yield m.start(), end, raw[: end - m.start()]
        at = end


def _windows(pieces: Iterable[bytes]) -> Iterator[str]:
    """Pieces as texts of at least PIECE bytes, each of which begins with the end of the one before.

    The overlap goes back to the last byte that ends any encoded run or secret, so that none is cut, LONGEST bytes at most.
    """
    held, new = b"", False
    for piece in pieces:
        held, new = held + piece, True
        if len(held) < PIECE:
            continue
        run = len(held) - len(held.rstrip(_RUN))
        if run == len(held) < LONGEST:
            continue
        yield _text(held)
        held, new = held[-max(OVERLAP, run if run < LONGEST else 0) :], False
    if new:
        yield _text(held)


def _base64_bytes(run: str) -> bytes:
    core = run.rstrip("=")
    core = core[: len(core) - (len(core) % 4 == 1)]
    return base64.b64decode((core + "=" * (-len(core) % 4)).replace("-", "+").replace("_", "/"))


def _percent(run: str) -> str:
    return _text(binascii.unhexlify(run.replace("%", "")))


def _halved(run: str) -> str:
    period = next(n for head, n in _PERIOD.items() if run.startswith(head))
    return run[: 1 + period * ((len(run) - 1) // period // 2)]


def unwrap(layer: Layer) -> Iterator[Layer]:
    """The layers directly below this one, one at a time, so that windows of a large stream are not held together."""
    text = layer.text
    if edits := [(m.start(), m.end(), _halved(m.group())) for m in _NESTED.finditer(text)]:
        yield layer.rewritten(edits)
        return  # everything else is in the layers below that one too
    if "%" in text:
        if edits := [(m.start(), m.end(), _percent(m.group())) for m in _PERCENT_ONE.finditer(text)]:
            yield layer.rewritten(edits)
            if "+" in text and (form := [(m.start(), m.end(), " " if m.group() == "+" else _percent(m.group())) for w in _FORM.finditer(text) if "+" in w.group() and "%" in w.group() for m in _FORM_ONE.finditer(text, w.start(), w.end())]):
                yield layer.rewritten(form)
    if "\\" in text or "&" in text:
        edits = [(m.start(), m.end(), c) for m in _ESCAPE.finditer(text) if (c := _char(m)) is not None]
        if edits:
            yield layer.rewritten(edits)
    packed = [(m.start(), m.end(), urllib.parse.unquote_to_bytes(m.group())) for m in _PERCENT_PACKED.finditer(text)]
    for start, end, raw in itertools.chain(packed, _packed_parts(text)):
        if (pieces := _inflated(raw)) is not None:
            for plain in _windows(pieces):
                yield layer.part(start, end, plain)
    for m in _BASE64.finditer(text):
        yield from _decoded(layer, m)
    if "\n" in text and (edits := [(b.start(), b.end(), "") for m in _WRAPPED.finditer(text) for b in _BREAK.finditer(text, m.start(), m.end())]):
        lines = layer.rewritten(edits)  # only for decoding: as text, the joined lines were never there
        for m in _BASE64.finditer(lines.text):
            yield from _decoded(lines, m)


def _decoded(layer: Layer, m: re.Match) -> Iterator[Layer]:
    """The layers below a base64 run; where it is not readable from its start, of all four alignments, as a word or path may stand before it."""
    for shift in range(4):
        raw = _base64_bytes(m.group()[shift:])
        if (pieces := _inflated(raw)) is not None:
            for plain in _windows(pieces):
                yield layer.part(m.start(), m.end(), plain)
            return
        readable = _readable(raw) if not shift else None
        plain = _text(raw) if readable is None else readable
        if scan(plain) or _DEEPER.search(plain):
            yield _base64_layer(layer, m.start() + shift, plain, raw)
        if readable is not None:
            return


def _base64_layer(layer: Layer, at: int, plain: str, raw: bytes) -> Layer:
    """Text decoded from a base64 run, each character mapped to the base64 characters that hold its bytes."""
    if len(plain) != len(raw) or len(layer.cuts) == 1 and not layer.cuts[0][3]:
        return layer.part(at, at + (len(raw) * 4 + 2) // 3, plain)
    cuts = []
    for k in range(len(raw)):
        cuts.append((k, *layer.span(at + k * 4 // 3, at + (k * 4 + 4) // 3 + ((k * 4 + 4) % 3 > 0)), 0))
    return Layer(plain, cuts)


def secrets(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a whole text in code points, both by start, then kind as listed."""
    text = text or ""
    base = scan(text)
    found, seen = set(base), {hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}
    work = [unwrap(Layer(text, [(0, 0, len(text), 1)]))]
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        where = layer.cuts[0][1], layer.cuts[-1][2]
        key = hashlib.blake2b(f"{where}:{layer.text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if key in seen:
            continue
        seen.add(key)
        found.update((kind, *layer.span(a, b)) for kind, a, b in scan(layer.text))
        work.append(unwrap(layer))
    return base, sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_scan(documents: DataFrame) -> DataFrame:
    """doc_id, base (array of kind, start, end) and spans (base and decoded ones) for every document."""

    def of(ids: list, texts: list) -> dict:
        both = [secrets(x) for x in texts]
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        return {"doc_id": ids, "base": [as_rows(b) for b, _ in both], "spans": [as_rows(s) for _, s in both]}

    span = "array<struct<kind: string, start: int, end: int>>"
    return map_batches(documents.select("doc_id", "text"), of, f"doc_id long, base {span}, spans {span}")


def redact(documents: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every found span replaced in the text; all other columns stay, n_chars follows the text."""
    schema, names = documents.schema, documents.columns
    text_at = names.index("text")

    def clean(text: str | None) -> str | None:
        if not text or not (spans := secrets(text)[1]):
            return text
        out, at = [], 0
        for start, end in merged([(a, b) for _, a, b in spans]):
            out += [text[at:start], mark]
            at = end
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                old = part.column(text_at).to_pylist()
                new = [clean(x) for x in old]
                columns = list(part.columns)
                columns[text_at] = pa.array(new, pa.string())
                if "n_chars" in names and part.column(names.index("n_chars")).type == pa.int64():
                    j = names.index("n_chars")
                    columns[j] = pa.array([n if a == b else len(b) for n, a, b in zip(columns[j].to_pylist(), old, new, strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return arrow_map(documents, run, schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(ids: list, texts: list) -> dict:
        rows = [secrets(x) for x in texts]
        count = lambda kind: [sum(k == kind for k, _, _ in b) for b, _ in rows]
        return {
            "doc_id": ids, "n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"),
            "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in rows], "spans": [joined(s) for _, s in rows],
        }

    return map_batches(table(spark, sf_dir, "documents").select("doc_id", "text"), of, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
