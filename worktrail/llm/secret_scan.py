"""Secret scans through nested encodings.

The text is scanned for three kinds of secrets. Then a worklist opens what is
encoded in it: percent escapes, Unicode escapes, base64 runs, and gzip, zlib,
bzip2 or xz data inside base64. Every opened layer is scanned, its findings are
mapped to the span of the original text that they come from, and the layer
itself goes on the worklist, until nothing new opens. A layer already opened
for the same span is not opened again, which ends cycles.

Percent and Unicode escapes are opened over the whole layer and mapped by
character, so a secret that is only partly escaped is found as a whole; base64
runs map to the run. Wrapped base64 is opened line by line and as one run; a run
that does not decode is read at all four alignments, as text or data may begin
anywhere in it. Compressed data is also looked for in the bytes of percent and
\\x escapes, and all its members are read. Data that unpacks to more than ``MOST`` bytes is scanned in
overlapping parts, so no layer is cut short and memory stays bounded.

Null is the empty text. Each row is judged by its own text; other columns, ties
and repeated rows play no part. An empty table gives no rows.
"""

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

# Kinds, in the order in which they are listed, and their patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ["assign", "access", "hex"]
WORD = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
LEAST_VALUE = 8

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}"
                     r"|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
ONE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})"
                 r"|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+"
                     r"(?:(?:\r?\n[\x20\t]*|(?:\\r)?\\n)[A-Za-z0-9+/_-]++)++={0,2}")
BREAKS = re.compile(r"\r?\n[\x20\t]*|(?:\\r)?\\n")
# Text inside undecodable bytes; the shortest secret has 14 characters.
PLAIN = re.compile(r"[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ufffd]{14,}")
MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")
BYTE = re.compile(r"(?:%|\\x)[89A-Fa-f][0-9A-Fa-f]")
BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\\[nrt0\\'\"]|[\x20-\[\]-~])+")
ONE_BYTE = re.compile(r"(?:%|\\x)([0-9A-Fa-f]{2})|\\([nrt0\\'\"])")
NAMED = {"n": "\n", "r": "\r", "t": "\t", "0": "\0"}
MOST, OVERLAP = 1 << 20, 1 << 16


def scan(text):
    """(kind, start, end) of the base rules: leftmost, non-overlapping per kind."""
    out = []
    if WORD.search(text):
        out += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in ACCESS.finditer(text)]
    out += [(2, *m.span()) for m in HEX.finditer(text)]
    return out


def replaced(text, pattern, decode):
    """The text with each run decoded, and start and end of every character's origin."""
    parts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(text):
        found = decode(m[0], m.start())
        if found is None:
            continue
        said, own = found
        plain = np.arange(at, m.start())
        parts += text[at:m.start()], said
        starts += plain, np.array([s for s, _ in own], np.int64)
        ends += plain + 1, np.array([e for _, e in own], np.int64)
        at = m.end()
    if not parts:
        return None
    plain = np.arange(at, len(text))
    parts.append(text[at:])
    return "".join(parts), np.concatenate([*starts, plain]), np.concatenate([*ends, plain + 1])


def percent(run, at):
    """Each character with the escapes of its own bytes; a stray byte is a character of its own."""
    raw = bytes.fromhex(run.replace("%", ""))
    if raw.isascii():
        return raw.decode(), [(at + 3 * i, at + 3 * i + 3) for i in range(len(raw))]
    said, own, i = [], [], 0
    while i < len(raw):
        first = raw[i]
        n = 1 if first < 0xC2 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        try:
            char = raw[i:i + n].decode()
        except UnicodeDecodeError:
            char, n = "\ufffd", 1
        said.append(char)
        own.append((at + 3 * i, at + 3 * (i + n)))
        i += n
    return "".join(said), own


def escapes(run, at):
    chars, own = [], []
    for m in ONE.finditer(run):
        kind = m.lastindex
        code = int(m[kind], 10 if kind == 5 else 16)
        if code > 0x10FFFF:
            return None
        if 0xDC00 <= code < 0xE000 and chars and 0xD800 <= chars[-1] < 0xDC00:
            chars[-1] = 0x10000 + ((chars[-1] - 0xD800) << 10) + code - 0xDC00
            own[-1] = own[-1][0], at + m.end()
            continue
        chars.append(code)
        own.append((at + m.start(), at + m.end()))
    return "".join("�" if 0xD800 <= c < 0xE000 else chr(c) for c in chars), own


def readable(raw):
    """The text of bytes, None if they aren't text."""
    try:
        said = raw.decode()
    except UnicodeDecodeError:
        return None
    return said if said and all(c >= " " or c in "\t\r\n" for c in said) else None


def opener_of(raw):
    """A decompressor for data that begins like this, None if it isn't compressed."""
    if raw[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] << 8 | raw[1]) % 31 == 0:
        return zlib.decompressobj()
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def unpacked(raw):
    """Parts of compressed data as bytes, each of bounded size; none if it isn't compressed.

    Parts overlap, so that a secret across two of them is whole in one. Members
    that follow each other are read as one text.
    """
    held = b""
    while (opener := opener_of(raw)) is not None:
        feed, raw = raw, b""
        try:
            while True:
                got = opener.decompress(feed, MOST)
                feed = opener.unconsumed_tail if hasattr(opener, "unconsumed_tail") else b""
                more = bool(feed) if hasattr(opener, "unconsumed_tail") else not (
                    opener.eof or opener.needs_input)
                held += got
                if opener.eof:
                    raw = opener.unused_data.lstrip(b"\0")
                if not got or not more:
                    break
                yield held
                held = held[-OVERLAP:]
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            pass
        if raw and len(held) > MOST:
            yield held
            held = held[-OVERLAP:]
    if held:
        yield held


def inside(raw):
    """Compressed data anywhere in the bytes, unpacked to texts."""
    for m in MAGIC.finditer(raw):
        for part in unpacked(memoryview(raw)[m.start():]):
            yield part.decode("utf-8", "replace")


def opened(run):
    """Texts inside a base64 run."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    for skip in range(4):
        own = body[skip:]
        own = own[:len(own) - (len(own) % 4 == 1)]
        try:
            raw = base64.b64decode(own + "=" * (-len(own) % 4))
        except (binascii.Error, ValueError):
            continue
        if skip == 0 and len(own) == len(body):
            said = readable(raw)
            if said:
                yield said
                return
        yield from PLAIN.findall(raw.decode("utf-8", "replace"))
        yield from inside(raw)


def packed_escapes(layer):
    """(start, end, text) of compressed data written with percent or \\x escapes."""
    if not BYTE.search(layer):
        return
    for m in BYTES.finditer(layer):
        if BYTE.search(m[0]):
            raw = ONE_BYTE.sub(lambda x: chr(int(x[1], 16)) if x[1] else NAMED.get(x[2], x[2]), m[0])
            for said in inside(raw.encode("latin-1")):
                yield m.start(), m.end(), said


def layers(layer, starts, ends):
    """The layers inside ``layer``, one at a time, with the origin of each character."""
    for pattern, decode, sign in ((PERCENT, percent, ("%",)), (UNICODE, escapes, ("\\", "&#"))):
        if any(s in layer for s in sign):
            got = replaced(layer, pattern, decode)
            if got:
                said, a, b = got
                yield (said, a, b) if starts is None else (said, starts[a], ends[b - 1])

    def placed(said, a, b):
        a, b = (a, b) if starts is None else (int(starts[a:b].min()), int(ends[a:b].max()))
        return said, np.broadcast_to(a, len(said)), np.broadcast_to(b, len(said))

    for m in BASE64.finditer(layer):
        for said in opened(m[0]):
            yield placed(said, *m.span())
    for m in WRAPPED.finditer(layer):
        for said in opened(BREAKS.sub("", m[0])):
            yield placed(said, *m.span())
    for a, b, said in packed_escapes(layer):
        yield placed(said, a, b)


def find(text):
    """Base spans of a text, and all spans with those of its encoded layers, as sets.

    The worklist holds openers, not layers: the next layer is made when the one
    before it has been read with all that lies inside it.
    """
    base = set(scan(text))
    found, seen, todo = set(base), set(), [layers(text, None, None)]
    while todo:
        layer, starts, ends = next(todo[-1], (None, None, None))
        if layer is None:
            todo.pop()
            continue
        if not layer:
            continue
        key = (hashlib.blake2b(layer.encode(), digest_size=16).digest(),
               int(starts[0]), int(ends[-1]))
        if key in seen:
            continue
        seen.add(key)
        for kind, s, e in scan(layer):
            found.add((kind, int(starts[s:e].min()), int(ends[s:e].max())))
        todo.append(layers(layer, starts, ends))
    return base, found


def written(spans):
    """kind:start:end by start, then kind."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], x[0], x[2])))


KIND = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                  ("base", pa.bool_())])


def secrets(text):
    """A column of all secrets: array of (kind, start, end, base), in code points."""
    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
    def run(values: pa.Array) -> pa.Array:
        out = []
        for x in values.to_pylist():
            base, found = find(x or "")
            out.append([{"kind": KINDS[k], "start": s, "end": e, "base": (k, s, e) in base}
                        for k, s, e in sorted(found, key=lambda y: (y[1], y[0], y[2]))])
        return pa.array(out, pa.list_(KIND))
    return run(text)


def joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs, id_column="doc_id", text="text"):
    found = docs.select(id_column, secrets(F.col(text)).alias("found"))
    base = F.filter("found", lambda x: x["base"])

    def count(kind):
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(id_column, *[count(k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("found")).alias("spans"))
