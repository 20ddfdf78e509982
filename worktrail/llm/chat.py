"""Chat formatting with loss masks aligned by offsets.

A turn is rendered as ``### role:``, a line break, the text, a line break and
``</turn>``. A backslash is put before every backslash and every control string
inside roles and texts, so the form can be read back exactly. Conversations are
rendered in turn order and encoded once, with the offsets of the tokens; the
spans of the assistant's texts are then found among the token spans by binary
search.

Rows of a conversation stream through one task in order, and are handed on in
segments of whole turns of about ``SEGMENT`` characters, so memory stays bounded
however long a conversation is. A segment starts at a turn's mark, which the
vocabulary's pattern never joins to the line break before it, so the ids of the
segments together are those of the whole conversation.

Null texts and roles are empty. Turns are ordered by turn (null first), ties by
role and text. Rows without a conversation id make up one conversation. Repeated rows are
turns of their own, texts of any length are rendered whole. Other columns are not read.
An empty table gives no rows.
"""

import functools
import hashlib
import os
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

SEGMENT = 100_000
CONTROL = ["\\", "###", "</turn>", "<|"]
_ESCAPE = re.compile("|".join(map(re.escape, CONTROL)))
_UNESCAPE = re.compile(r"\\(" + "|".join(map(re.escape, CONTROL)) + "|n)")
HEAD, TAIL = "### {}:\n", "\n</turn>\n"
LEARNED = "assistant"


def escape(text):
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def escape_role(role):
    """Roles stand in one line, so line breaks become backslash-n."""
    return escape(role).replace("\n", "\\n")


def unescape(text):
    return _UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


@functools.cache
def tokenizer(path):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, processors
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


def align(spans, offsets):
    """For each sorted text span: its token range and the part of it the tokens cover."""
    starts, ends = offsets[:, 0], offsets[:, 1]
    a, b = spans[:, 0], spans[:, 1]
    first = np.searchsorted(ends, a, "right")
    last = np.searchsorted(starts, b, "left")
    some = (first < last) & (a < b)
    first, last, a, b = first[some], last[some], a[some], b[some]
    return np.stack([np.maximum(a, starts[first]), np.minimum(b, ends[last - 1]), first, last], 1)


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()),
                  ("first_token", pa.int64()), ("last_token", pa.int64())])
SEGMENTS = ("formatted string, ids binary, loss_mask binary, "
            "loss_spans array<struct<start:bigint,end:bigint,first_token:bigint,last_token:bigint>>")


def segment(turns, path):
    """Text, ids, token mask and loss spans of rendered turns [(role, text)]."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = HEAD.format(escape_role(role)), escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += head, body, TAIL
        at += len(head) + len(body) + len(TAIL)
    whole = "".join(parts)
    coded = tokenizer(path).encode(whole, add_special_tokens=False)
    offsets = np.array(coded.offsets, np.int64).reshape(-1, 2)
    found = align(np.array(spans, np.int64).reshape(-1, 2), offsets)
    mask = np.zeros(len(offsets), np.uint8)
    for _, _, first, last in found.tolist():
        mask[first:last] = 1
    names = ("start", "end", "first_token", "last_token")
    return {"formatted": whole, "ids": np.array(coded.ids, "<u4").tobytes(),
            "loss_mask": mask.tobytes(),
            "loss_spans": [dict(zip(names, x, strict=True)) for x in found.tolist()]}


def format_conversations(turns, path=None, size=SEGMENT):
    """Rows (conv_id, formatted, ids, loss_mask, loss_spans): segments, in order per conversation.

    ``ids`` are little-endian unsigned 32-bit integers and ``loss_mask`` has one
    byte per id; spans are code points within the segment. The rows of one
    conversation follow each other in one partition.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    rows = (rows.repartition("conv_id")
            .sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text"))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        id_type, conv, own, held = None, None, [], 0

        def out():
            row = segment(own, path)
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], id_type), pa.array([row["formatted"]]),
                 pa.array([row["ids"]], pa.binary()), pa.array([row["loss_mask"]], pa.binary()),
                 pa.array([row["loss_spans"]], pa.list_(SPAN))],
                ["conv_id", "formatted", "ids", "loss_mask", "loss_spans"])

        for batch in batches:
            id_type = batch.column(0).type
            for key, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own and (key != conv or held > size):
                    yield out()
                    own, held = [], 0
                conv = key
                own.append((role, text))
                held += len(role) + len(text)
        if own:
            yield out()

    return rows.mapInArrow(run, f"conv_id {kind}, {SEGMENTS}")


def read_back(formatted):
    """[(role, text)] of a formatted segment."""
    out = []
    for part in formatted.split(TAIL)[:-1]:
        head, _, body = part.partition("\n")
        out.append((unescape(head[4:-1]), unescape(body)))
    return out


def digest(segments):
    """Per conversation what its segments hold: all turns, and all text under the loss mask."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
             "formatted_chars", "n_tokens", "loss_tokens"]

    def run(batches):
        id_type, conv, state = None, None, None

        def out():
            n, turns, chars, loss, size, tokens, learned = state
            row = [conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, tokens, learned]
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

        for batch in batches:
            id_type = batch.column(0).type
            for key, text, ids, mask, spans in zip(*(c.to_pylist() for c in batch.columns),
                                                   strict=True):
                if state is None or key != conv:
                    if state is not None:
                        yield out()
                    conv, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, said in read_back(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for x in spans:
                    said = unescape(text[x["start"]:x["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
                state[5] += len(ids) // 4
                state[6] += mask.count(1)
        if state is not None:
            yield out()

    return segments.mapInArrow(
        run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
        "loss_sha256 string, formatted_chars bigint, n_tokens bigint, loss_tokens bigint")
