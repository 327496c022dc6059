"""Secret scans with a recursive decoding worklist.

Each text is scanned as it stands (the base spans). Then encoded parts are unwrapped layer by layer - percent escapes, Unicode and byte
escapes, base64 and compressed data - every new layer is scanned again and put on the worklist, until none yields a layer not seen
before. Escapes (%41, %u0041, \\x41, \\x{41}, \\u0041, \\u{41}, \\U00000041, &#65;) are replaced in place, so that a secret partly escaped is seen with its surroundings; where one gives the beginning of the next, the chain is followed to its
end within one layer, so that the time does not grow with the square of its length. Base64 parts become layers of their
own, one for each of the four characters the encoding may begin with, line by line and joined over lines. Bytes that are no UTF-8 stay as
single placeholders between the valid stretches. A layer with wide characters (UTF-16 or UTF-32, either byte order) gives one without their zero
bytes. Every character of a layer knows the code points of the original text it came from, and
what is found is reported there.

Compressed data may begin anywhere in a layer; raw deflate, which has no head, is tried from the first byte of a base64 part. All found in it, however deep, is reported at the whole compressed part, so that only the
kinds matter there: its content is kept as bytes, in a temporary file once it is over LAYER_BYTES, and read to its end. Parts with such a
content are counted in `n_oversize`. A disk too small for the content fails the task.

Null texts count as empty; texts of any length are read whole; repeated rows get equal results; other columns are not read. Spans are in
code points, end exclusive.
"""
from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import mmap
import re
import tempfile
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from loadwarden.llm.common import map_texts, texts_of

# The kinds of secret in report order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
WORDS = ("passw", "secret", "token", "api_key", "apikey")
# end of fixed values

#: A match that is too short cannot hide a longer one here, so the least length goes into these patterns.
ACCESS = re.compile(r"AKIA[A-Z0-9]{%d,}" % (ACCESS_LEAST - 4))
HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)

LAYER_BYTES = 16 << 20
BASE64_LEAST = 16
_B64 = "[A-Za-z0-9+/_-]"
_BASE64 = re.compile(_B64 + "{%d,}" % BASE64_LEAST)
#: Runs that go on in the next line; all but the last have the least length.
_LINES = re.compile(rf"(?<!{_B64}){_B64}{{{BASE64_LEAST},}}+(?:[ \t]*+\r?\n[ \t]*+{_B64}{{{BASE64_LEAST},}}+)*+(?:[ \t]*+\r?\n[ \t]*+{_B64}++)?+")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\x[0-9A-Fa-f]{2})+|(?:[\\%]u[0-9A-Fa-f]{4})+|\\[ux]\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
#: Characters that escapes begin with, and a single escape.
_FIRST = "%\\&"
_ONE = re.compile(r"%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|[\\%]u[0-9A-Fa-f]{4}|\\[ux]\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
#: Escapes of single bytes, as against those of characters.
_BYTES = re.compile(r"%[^u]|\\x[^{]")

#: The same in bytes.
_ASSIGN_B = re.compile(ASSIGN.pattern.encode(), re.IGNORECASE)
_ACCESS_B, _HEX_B, _BASE64_B, _LINES_B = (re.compile(p.pattern.encode()) for p in (ACCESS, HEX, _BASE64, _LINES))
_ESCAPES_B = re.compile(f"{_PERCENT.pattern}|{_ESCAPE.pattern}".encode())
#: Where compressed data may begin, and what any secret or escape of one needs.
_ZLIB = b"|".join(re.escape(bytes([window, level + 31 - (window * 256 + level) % 31])) for window in range(0x08, 0x80, 0x10) for level in range(0, 256, 64))
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x28\xb5\x2f\xfd|BZh[1-9]|\xfd7zXZ\x00|" + _ZLIB)
_LEGIBLE = re.compile(rb"[\x20-\x7e]{12}")
#: Six characters of two or four bytes.
_WIDE = re.compile("(?:[\\x20-\\x7e\t\r\n]\0{1,3}){6}")
_WIDE_B = re.compile(_WIDE.pattern.encode())
_STANDARD = bytes.maketrans(b"-_", b"+/")
PIECE = 1 << 18

Span = tuple[int, int, int]  # start, kind, end


def scan(text: str) -> list[Span]:
    """Base spans of a text: leftmost matches per kind that do not overlap, those too short dropped."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


class _Spool:
    """Bytes written piece by piece: in memory up to LAYER_BYTES, in an unnamed temporary file beyond."""

    def __init__(self):
        self.size, self.parts, self.file = 0, [], None

    def write(self, piece: bytes) -> None:
        self.size += len(piece)
        self.parts.append(piece)
        if self.file is None and self.size > LAYER_BYTES:
            self.file = tempfile.TemporaryFile()
        if self.file is not None:
            self.file.writelines(self.parts)
            self.parts.clear()

    def content(self) -> bytes | mmap.mmap:
        if self.file is None:
            return b"".join(self.parts)
        self.file.flush()
        with self.file:
            return mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)


def _unfold(data, at: int, spool: _Spool, unfold=None) -> int | None:
    """Writes what the compressed data that begins at `at` unfolds to, by its head or with `unfold`; where it ends, None if it is damaged or has no end."""
    head = data[at:at + 4]
    step, bounded = 64, (PIECE,)
    if unfold is not None:
        pass
    elif head == b"\x28\xb5\x2f\xfd":
        unfold, bounded = zstandard.ZstdDecompressor().decompressobj(), ()  # has no bound on its output, so little goes in
    elif head[:3] == b"BZh":
        unfold = bz2.BZ2Decompressor()
    elif head[:1] == b"\xfd":
        unfold = lzma.LZMADecompressor()
    else:
        unfold = zlib.decompressobj(47)
    try:
        while at < len(data) and not unfold.eof:
            piece = data[at:at + step]
            at += len(piece)
            out = unfold.decompress(piece, *bounded)
            spool.write(out)
            while bounded and not unfold.eof and (len(out) == PIECE or getattr(unfold, "unconsumed_tail", b"")):
                out = unfold.decompress(getattr(unfold, "unconsumed_tail", b""), PIECE)
                spool.write(out)
            if bounded:  # small pieces to begin with, so that what comes before damage is kept
                step = min(2 * step, 4096)
    except (zlib.error, zstandard.ZstdError, lzma.LZMAError, EOFError, ValueError):
        return None
    except OSError as error:
        if error.errno is not None:  # the disk, not the data
            raise
        return None
    return at - len(unfold.unused_data) if unfold.eof else None


def _members(data):
    """Start, end and content of each compressed part in bytes; members or frames that follow one another are one part."""
    at = 0
    while m := _MAGIC.search(data, at):
        spool, start = _Spool(), m.start()
        first, end = start, _unfold(data, start, spool)
        while end is not None and (more := _MORE.match(data, end)) and more.group(1)[:2] == data[first:first + 2]:
            start, end = more.start(1), _unfold(data, more.start(1), spool)
        if spool.size:
            yield first, end or len(data), spool
        at = start + 1 if end is None else end  # inside of what is damaged or cut off anything else may begin


_MORE = re.compile(rb"\x00*+(%s)" % _MAGIC.pattern)


def _tells(data) -> bool:
    """Whether bytes can hold a secret, an escape of one or compressed data."""
    return bool(_LEGIBLE.search(data) or _MAGIC.search(data) or _WIDE_B.search(data))


def _deflated(data) -> _Spool | None:
    """What bytes that begin with a whole raw deflate stream unfold to, if that tells anything."""
    spool = _Spool()
    if _unfold(data, 0, spool, zlib.decompressobj(-15)) is None or not spool.size:
        return None
    return spool if spool.file is not None or _tells(spool.content()) else None


def _kinds(content) -> set[int]:
    """The kinds of secret in bytes and in all they unwrap to."""
    found: set[int] = set()
    seen: set[bytes] = set()
    work = [content]
    while work and len(found) < len(KINDS):
        data = work.pop()
        mark = hashlib.blake2b(data, digest_size=16).digest()
        if mark in seen:
            continue
        seen.add(mark)
        if any(m.end(2) - m.start(2) >= ASSIGN_LEAST for m in _ASSIGN_B.finditer(data)):
            found.add(0)
        found.update(k for k, p in ((1, _ACCESS_B), (2, _HEX_B)) if p.search(data))
        work += [spool.content() for _, _, spool in _members(data)]
        for start, end in _runs(_BASE64_B, _LINES_B, data):
            for shift in range(4):
                spool = _Spool()
                rest = b""
                for i in range(start, end, PIECE):
                    rest += data[i:min(i + PIECE, end)].translate(_STANDARD, b" \t\r\n")
                    if i == start:
                        rest = rest[shift:]
                    whole = len(rest) // 4 * 4
                    spool.write(base64.b64decode(rest[:whole]))
                    rest = rest[whole:]
                spool.write(_b64(rest))
                inner = spool.content()
                if _tells(inner):
                    work.append(inner)
                if raw := _deflated(inner):
                    work.append(raw.content())
        if _WIDE_B.search(data):
            spool = _Spool()
            for i in range(0, len(data), PIECE):
                spool.write(data[i:i + PIECE].translate(None, b"\0"))
            work.append(spool.content())
        spool, at = _Spool(), 0
        for m in _ESCAPES_B.finditer(data) if any(data.find(c) >= 0 for c in (b"%", b"\\", b"&#")) else ():
            for i in range(at, m.start(), PIECE):
                spool.write(data[i:min(i + PIECE, m.start())])
            at = m.end()
            got = m.group()
            if _BYTES.match(got.decode()):
                spool.write(bytes.fromhex(got.translate(None, b"%\\x").decode()))
            else:
                spool.write("".join(c for c, _ in _units(got.decode())).encode("utf-8", "surrogatepass") or got)
        if at:
            for i in range(at, len(data), PIECE):
                spool.write(data[i:i + PIECE])
            work.append(spool.content())
    return found


def _runs(single: re.Pattern, lines: re.Pattern, text):
    """Start and end of the base64 candidates: each run, and runs joined over lines."""
    for m in single.finditer(text):
        yield m.span()
    for m in lines.finditer(text):
        if single.match(text, m.start()).end() < m.end():
            yield m.span()


def _b64(body: bytes) -> bytes:
    """Decoded base64 without its padding; a single character left over holds no byte."""
    body = body[:len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + b"=" * (-len(body) % 4))


class _Layer:
    """A decoded text; `starts` and `ends` give the original code points of each of its characters (None: the original itself)."""

    def __init__(self, text: str, starts=None, ends=None):
        self.text, self.starts, self.ends = text, starts, ends

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def child(self, text: str, local_starts: np.ndarray, local_ends: np.ndarray) -> "_Layer":
        """A layer whose characters came from [local_start, local_end) of this one."""
        if self.starts is None:
            return _Layer(text, local_starts, local_ends)
        return _Layer(text, self.starts[local_starts], self.ends[local_ends - 1])


def _char_bytes(text: str) -> np.ndarray:
    """Where the UTF-8 bytes of each character begin, and the end; placeholders stand for one byte."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    sizes[(code >= 0xDC80) & (code < 0xDD00)] = 1
    return np.concatenate([[0], np.cumsum(sizes)])


_LONE = re.compile("[\ud800-\udc7f\udd00-\udfff]")


def _compressed(layer: _Layer, found: set, oversize: list) -> None:
    """Adds what the compressed parts of a layer hold."""
    data = _LONE.sub("???", layer.text).encode("utf-8", "surrogateescape")
    if not _MAGIC.search(data):
        return
    at = _char_bytes(layer.text)
    for start, end, spool in _members(data):
        first, last = np.searchsorted(at, [start, end - 1], "right")
        a, b = layer.origin(int(first) - 1, int(last))
        if spool.file is not None:
            oversize.append((a, b))
        found.update((a, k, b) for k in _kinds(spool.content()))


def _narrowed(layer: _Layer) -> list[_Layer]:
    """The layer without the zero bytes of wide characters."""
    if not _WIDE.search(layer.text):
        return []
    kept = np.flatnonzero(np.frombuffer(layer.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
    return [layer.child(layer.text.replace("\0", ""), kept, kept + 1)]


def _base64_layers(layer: _Layer, found: set, oversize: list) -> list[_Layer]:
    """Layers of the base64 parts; what raw deflate in them holds is added to `found`."""
    out = []
    for start, end in _runs(_BASE64, _LINES, layer.text):
        part = layer.text[start:end].encode()
        body = part.translate(_STANDARD, b" \t\r\n")
        where = None
        for shift in range(4):
            data = _b64(body[shift:])
            if raw := _deflated(data):
                a, b = layer.origin(start, end)
                if raw.file is not None:
                    oversize.append((a, b))
                found.update((a, k, b) for k in _kinds(raw.content()))
            if not _tells(data):
                continue
            if where is None:
                where = start + np.flatnonzero(~np.isin(np.frombuffer(part, dtype=np.uint8), list(b" \t\r\n")))
            text = data.decode("utf-8", "surrogateescape")
            byte = np.arange(len(data))
            char = shift + byte // 3 * 4 + byte % 3
            at = np.arange(len(text) + 1) if len(text) == len(data) else _char_bytes(text)
            out.append(layer.child(text, where[char][at[:-1]], where[char + 1][at[1:] - 1] + 1))
    return out


def _units(match: str) -> list[tuple[str, int]]:
    """Characters of an escape and the length each has in it."""
    if match[0] == "&":
        code = int(match[3:-1], 16) if match[2] in "xX" else int(match[2:-1])
        return [(chr(code), len(match))] if code < 0x110000 else []
    if match[2] == "{":
        code = int(match[3:-1], 16)
        return [(chr(code), len(match))] if code < 0x110000 else []
    if match[1] == "U":
        code = int(match[2:], 16)
        return [(chr(code), 10)] if code < 0x110000 else []
    codes, out, i = [int(match[k + 2:k + 6], 16) for k in range(0, len(match), 6)], [], 0
    while i < len(codes):
        if 0xD800 <= codes[i] < 0xDC00 and i + 1 < len(codes) and 0xDC00 <= codes[i + 1] < 0xE000:
            out.append((chr(0x10000 + (codes[i] - 0xD800) * 1024 + codes[i + 1] - 0xDC00), 12))
            i += 2
        else:
            out.append((chr(codes[i]), 6))
            i += 1
    return out


def _chained(text: str, char: str, end: int) -> tuple[str, int]:
    """An escape may give the first character of another one, as in %25252541: follows the chain from `char`, which stands for what ends at `end`, and returns the last
    character and where it ends. Bytes above ASCII are left as escapes, as the next layer reads them together with their neighbours."""
    while char in _FIRST:
        m = _ONE.match(char + text[end:end + 10])
        if not m:
            break
        got = m.group()
        if _BYTES.match(got):
            code = int(got[-2:], 16)
            after = chr(code) if code < 0x80 else None
        else:
            units = _units(got)
            after = units[0][0] if units else None
        if after is None:
            break
        char, end = after, end + len(got) - 1
    return char, end


def _unescaped(layer: _Layer, pattern: re.Pattern) -> list[_Layer]:
    """The layer with its escapes replaced in place. Chains of escapes are followed to their end at once, so that their depth costs no layers."""
    text, parts, starts, ends, at = layer.text, [], [], [], 0

    def copy(a, b):
        parts.append(text[a:b])
        starts.append(np.arange(a, b))
        ends.append(np.arange(a + 1, b + 1))

    m = pattern.search(text)
    while m:
        got, a, e = m.group(), m.start(), m.end()
        width = 0 if not _BYTES.match(got) else 3 if got[0] == "%" else 4
        if width:
            data = bytes.fromhex(got.replace("%", "").replace("\\x", ""))
            chars = data.decode("utf-8", "surrogateescape")
            sizes = [(c, width * n) for c, n in zip(chars, np.diff(_char_bytes(chars)).tolist())]
        else:
            sizes = _units(got)
        if sizes:
            copy(at, a)
            last, e = _chained(text, sizes[-1][0], e)
            sizes[-1] = last, sizes[-1][1] + e - m.end()
            parts.append("".join(c for c, _ in sizes))
            edge = a + np.array([0, *accumulate(n for _, n in sizes)])
            starts.append(edge[:-1])
            ends.append(edge[1:])
            at = e
        m = pattern.search(text, e)
    if not at:
        return []
    copy(at, len(text))
    return [layer.child("".join(parts), np.concatenate(starts), np.concatenate(ends))]


def unwrap(text: str) -> tuple[list[Span], list[Span], int]:
    """Base spans, all spans (base ones first found, then those of decoded layers, each once, in order) and the number of parts too large for memory."""
    base = scan(text)
    found, oversize = set(base), []
    seen: set[tuple] = set()
    work = [_Layer(text)]
    while work:
        layer = work.pop()
        if layer.starts is not None:
            if not layer.text:
                continue
            mark = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *layer.origin(0, len(layer.text)))
            if mark in seen:
                continue
            seen.add(mark)
            found.update((*layer.origin(s, e)[:1], k, layer.origin(s, e)[1]) for s, k, e in scan(layer.text))
            _compressed(layer, found, oversize)
        if "%" in layer.text:
            work += _unescaped(layer, _PERCENT)
        if "\\" in layer.text or "&#" in layer.text or "%u" in layer.text:
            work += _unescaped(layer, _ESCAPE)
        if "\0" in layer.text:
            work += _narrowed(layer)
        work += _base64_layers(layer, found, oversize)
    return base, sorted(found), len(set(oversize))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame) -> DataFrame:
    """Per row: base counts, the digest of the base spans, all spans as text, how many spans decoding added, parts too large for memory."""
    def make():
        def work(texts):
            got = [unwrap(t) for t in texts]
            out = {f"n_{name}": [sum(k == i for _, k, _ in base) for base, _, _ in got] for i, name in enumerate(KINDS)}
            out["base_sha256"] = [hashlib.sha256(written(base).encode()).hexdigest() for base, _, _ in got]
            out["spans"] = [written(spans) for _, spans, _ in got]
            out["n_decoded"] = [len(spans) - len(set(base)) for base, spans, _ in got]
            out["n_oversize"] = [n for _, _, n in got]
            return out
        return work

    return map_texts(docs, make, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long, n_oversize long")


def redacted(text: str) -> str:
    """The text with every span, overlapping ones merged, replaced by a marker that names the kind found first."""
    _, spans, _ = unwrap(text)
    if not spans:
        return text
    merged = []
    for s, k, e in spans:
        if merged and s < merged[-1][2]:
            merged[-1] = (*merged[-1][:2], max(e, merged[-1][2]))
        else:
            merged.append((s, k, e))
    parts, at = [], 0
    for s, k, e in merged:
        parts += [text[at:s], f"[{KINDS[k]} removed]"]
        at = e
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs`, secrets in `text` replaced and `n_chars`, if there is such a column, counted anew. Null texts stay."""
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(at))
            clean = [redacted(t) for t in texts]
            columns = list(batch.columns)
            valid = columns[at].is_valid().to_pylist()
            columns[at] = pa.array([c if v else None for c, v in zip(clean, valid)], type=columns[at].type)
            if chars is not None:
                columns[chars] = pa.array([len(c) if c != t else n for c, t, n in zip(clean, texts, columns[chars].to_pylist())], type=columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
