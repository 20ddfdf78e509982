"""Personal data: base rules, and a character tagger for what they miss.

The tagger is a bidirectional LSTM with CRF transitions over characters
(``tagger``), trained in numpy before each use from labelled spans: those that
the base rules find in a bounded sample of the documents (``SAMPLE_DOCS``
documents, ``SAMPLE_WINDOWS`` windows at most), the same spans rewritten in forms
the rules don't know, and numbers that are no personal data. The seed is fixed.

Every form holds a digit, an at sign or the word "at", in any case and between
characters that are no letters, so each stretch of text near one of these or the
word "dot" is a candidate, however many there are, and text far from any can hold
no span. A stretch ends where a word ends. It is read in overlapping windows of ``LENGTH``
characters; the emissions of a character are averaged over its windows with more
weight to the middle of a window, and one best path is taken over the whole
stretch. A span it yields must pass its kind's check, end where a word ends, and
may not touch a base span; base spans always stay.

Null is the empty text. Each row is judged by its own text; a corpus without
labelled spans is trained on the generated forms alone. Other columns, ties and
repeated rows play no part. An empty table gives no rows.
"""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from worktrail.llm.common import Cache, runs
from worktrail.llm.tagger import PAD, Tagger, codes

# Kinds, in the order in which they are listed, and their patterns.
KINDS = ["email", "ip", "card", "phone"]
LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")
# A digit, an at sign, or the words "at" and "dot"; begins with a set, which is searched fast.
NEAR = re.compile(r"[0-9@aAdD](?:(?<=[0-9@])|(?<=[aA])(?<!\w.)[tT](?!\w)"
                  r"|(?<=[dD])(?<!\w.)[oO][tT](?!\w))", re.S)

# An address with its at sign and dots as they are, spaced, in brackets or as words.
FORM = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++"
                  r"(?:\s*@\s*|\s*[(\[{<]\s*(?:at|@)\s*[)\]}>]\s*|\s+at\s+)[A-Za-z0-9-]++"
                  r"(?:(?:\.|\s\.\s|\s*[(\[{<]\s*(?:dot|\.)\s*[)\]}>]\s*|\s+dot\s+)[A-Za-z0-9-]++)+",
                  re.I | re.A)

SAMPLE_DOCS, SAMPLE_WINDOWS = 4000, 1500
LENGTH, STEP, REACH = 64, 32, 24
STEPS, ROWS = 300, 3000
LABELS = 1 + 2 * len(KINDS)  # outside; then begin and inside of each kind


def digits(text):
    return [int(c) for c in text if "0" <= c <= "9"]


def luhn(numbers):
    total = 0
    for i, d in enumerate(reversed(numbers)):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def is_ip(text):
    return all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in text.split("."))


def is_card(text):
    found = digits(text)
    return 13 <= len(found) <= 19 and luhn(found)


def is_phone(text):
    return 9 <= len(digits(text)) <= 15


def emails(text):
    """Leftmost non-overlapping matches, found from their at signs."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def scan(text):
    """(kind, start, end) of the base rules."""
    if not SIGN.search(text):
        return []
    out = emails(text)
    for kind, pattern, fine in ((1, IP, is_ip), (2, CARD, is_card), (3, PHONE, is_phone)):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if fine(m[0])]
    return out


def stretches(text, sign=SIGN):
    """(start, end) of the text near a sign."""
    out = []
    for m in sign.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return out


def candidates(text):
    """(start, end) of the stretches in which a span can lie: whole words near any sign."""
    out = []
    for a, b in stretches(text, NEAR):
        if out and b <= out[-1][1]:
            continue
        while a > 0 and not text[a - 1].isspace():
            a -= 1
            if out and a <= out[-1][1]:
                break
        while b < len(text) and not text[b].isspace():
            b += 1
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return out


def windows(length):
    """Starts of the windows over a stretch: overlapping by half, the last one at its end."""
    if length <= LENGTH:
        return [0]
    return [*range(0, length - LENGTH, STEP), length - LENGTH]


_WEIGHT = np.minimum(np.arange(1, LENGTH + 1), np.arange(LENGTH, 0, -1)).astype(np.float32)


def tag(model, texts, block=512):
    """Spans that the tagger sees in each text."""
    where, rows = [], []
    for i, text in enumerate(texts):
        for a, b in candidates(text):
            own = codes(text[a:b])
            starts = windows(len(own))
            where.append((i, a, len(own), starts))
            for s in starts:
                cut = own[s:s + LENGTH]
                rows.append(np.pad(cut, (0, LENGTH - len(cut)), constant_values=PAD))
    out = [[] for _ in texts]
    if not rows:
        return out
    rows = np.array(rows)
    said = np.concatenate([model.forward(rows[k:k + block])[0]
                           for k in range(0, len(rows), block)])
    at = 0
    for i, a, n, starts in where:
        total, weight = np.zeros((n, LABELS), np.float32), np.zeros((n, 1), np.float32)
        for s in starts:
            size = min(LENGTH, n - s)
            total[s:s + size] += said[at, :size] * _WEIGHT[:size, None]
            weight[s:s + size, 0] += _WEIGHT[:size]
            at += 1
        path = model.best_path(total / weight)
        out[i] += [(k, a + s, a + e) for k, s, e in spans_of(path)]
    return out


def spans_of(path):
    out, kind, start = [], -1, 0
    for t, label in enumerate([*path.tolist(), 0]):
        now = (label - 1) // 2 if label else -1
        if kind >= 0 and (now != kind or label % 2 == 1):
            out.append((kind, start, t))
            kind = -1
        if now >= 0 and kind < 0:
            kind, start = now, t
    return out


# A kind's check for what the tagger adds.
def plausible(kind, text):
    found = len(digits(text))
    if kind == 0:
        return bool(re.search(r"@|\bat\b", text, re.I)) and bool(
            re.search(r"\.|\bdot\b", text, re.I)) and len(text) >= 6
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return is_card(text)
    return 9 <= found <= 15 and found * 2 >= len(text.strip())


def addresses(text, a, b):
    """What a tagged address [a, b) stands for: the whole forms it touches, else itself.

    Words alone are no address without such a form.
    """
    low, high = a, min(len(text), b + LENGTH)
    while low > 0 and text[low - 1] in LOCAL:
        low -= 1
    while high < len(text) and text[high] in LOCAL:
        high += 1
    found = [m.span() for m in FORM.finditer(text, low, high) if m.start() < b and m.end() > a]
    if found:
        return found
    return [(a, b)] if re.search(r"[0-9@()\[\]]", text[a:b]) else []


def find(model, texts):
    """For each text: base spans and added spans."""
    base = [scan(x) for x in texts]
    out = []
    for text, own, seen in zip(texts, base, tag(model, texts), strict=True):
        added = []
        for kind, a, b in seen:
            while a < b and text[a].isspace():
                a += 1
            while b > a and (text[b - 1].isspace() or text[b - 1] in ".,;:"):
                b -= 1
            for a, b in addresses(text, a, b) if kind == 0 else [(a, b)]:
                whole = not text[max(0, a - 1):a].isalnum() and not text[b:b + 1].isalnum()
                if (whole and all(b <= s or a >= e for _, s, e in own) and plausible(kind, text[a:b])
                        and (kind, a, b) not in added):
                    added.append((kind, a, b))
        out.append((own, added))
    return out


def sampled_windows(docs, text="text"):
    """Windows of a bounded sample of documents, with their base spans: [(text, spans)]."""
    n = docs.count()
    every = max(1, n // SAMPLE_DOCS)
    chosen = docs.select(F.col(text).alias("text")).filter(
        F.col("text").rlike("[0-9@]")
        & (F.pmod(F.xxhash64("text"), F.lit(every)) == 0))

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column(0).to_pylist():
                own = scan(x)
                for a, b in stretches(x):
                    b = min(b, a + LENGTH)
                    out.append({"text": x[a:b], "spans": [
                        [k, s - a, e - a] for k, s, e in own if s >= a and e <= b]})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema(
                    [("text", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))]))

    found = (chosen.mapInArrow(run, "text string, spans array<array<bigint>>").distinct()
             .orderBy(F.xxhash64("text"), "text").limit(SAMPLE_WINDOWS))
    return [(r["text"], [tuple(s) for s in r["spans"]]) for r in found.collect()]


class Forms:
    """Labelled spans in known and rewritten forms, and numbers that are none."""

    WORDS = ["the", "of", "lorem", "und", "que", "les", "para", "error", "value", "total", "id"]

    def __init__(self, seed):
        self.r = random.Random(seed)

    def number(self, n):
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def word(self):
        return "".join(self.r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(self.r.randint(2, 8)))

    def email(self):
        name = self.r.choice([self.word(), self.number(2), self.word() + "." + self.word(),
                              self.word() + self.number(2)])
        at = self.r.choice(["@"] * 4 + [" @ ", " (at) ", "[at]", "(at)", " [at] "])
        dot = self.r.choice([".", " . ", " (dot) ", "[dot]"]) if at != "@" else "."
        host = self.r.choice(["mail" + self.number(1) + ".example", self.word()])
        return name + at + host.replace(".", dot) + dot + self.r.choice(["com", "org", "net", "de"])

    def ip(self):
        dot = self.r.choice(["."] * 3 + ["[.]", "(.)", " . "])
        return dot.join(str(self.r.randint(0, 255)) for _ in range(4))

    def card(self):
        body = [int(c) for c in self.r.choice("345") + self.number(14)]
        body.append(next(d for d in range(10) if luhn([*body, d])))
        cut = self.r.choice(["", "", " ", "-", ".", "/"])
        return cut.join("".join(map(str, body[i:i + 4])) for i in range(0, 16, 4))

    def phone(self):
        a, b, c = self.number(3), self.number(3), self.number(4)
        return self.r.choice([f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"+49 {a} {b}{c}",
                              f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"001 {a} {b} {c}",
                              f"00{self.number(2)} {a} {b}{c}", f"{a}/{b}-{c}"])

    def nothing(self):
        hexed = "".join(self.r.choice("0123456789abcdef") for _ in range(40))
        return self.r.choice([
            self.number(self.r.randint(1, 8)), f"20{self.number(2)}-0{self.number(1)}-1{self.number(1)}",
            f"{self.number(1)}.{self.number(1)}.{self.number(2)}", f"${self.number(2)}.{self.number(2)}",
            f'token = "{hexed}"', hexed[:20], f"{self.number(2)}:{self.number(2)}", "@" + self.word(),
            f"{self.number(2)}%", f"{self.number(16)}x", "version " + self.number(1) + ".0",
            f"{self.number(3)} - {self.number(3)}",
            f"{self.word()} at {self.word()}. {self.word()}", f"at {self.word()} {self.word()}.",
            f"({self.word()} at {self.word()})", f"{self.word()} dot {self.word()}",
            f"{self.word()} at {self.word()}.{self.word()}()"])

    def window(self, around):
        """A text of LENGTH characters at most, with its spans."""
        left = around[:self.r.randint(0, 20)] if around else ""
        text, spans = left + self.r.choice(["", " ", " ", self.r.choice(self.WORDS) + " "]), []
        kind = self.r.randint(0, 2 * len(KINDS) - 1)
        said = getattr(self, KINDS[kind])() if kind < len(KINDS) else self.nothing()
        if kind < len(KINDS):
            spans.append((kind, len(text), len(text) + len(said)))
        text += said + self.r.choice([" ", ". ", ", ", "### ", "\n", " " + self.r.choice(self.WORDS)])
        text += around[20:20 + max(0, LENGTH - len(text))] if around else ""
        return text[:LENGTH], [s for s in spans if s[2] <= LENGTH]


def labelled(text, spans):
    y = np.zeros(LENGTH, np.int64)
    for kind, s, e in spans:
        y[s] = 1 + 2 * kind
        y[s + 1:e] = 2 + 2 * kind
    x = codes(text)
    return np.pad(x, (0, LENGTH - len(x)), constant_values=PAD), y


def examples(sample, rows, seed):
    """Training rows: each sampled window, and generated ones in sampled surroundings."""
    forms = Forms(seed)
    plain = [re.sub("[0-9@]", "", t) for t, own in sample if not own] or [
        re.sub("[0-9@+]", "", t) for t, _ in sample] or [""]
    known = [(t, own) for t, own in sample if len(t) <= LENGTH]
    made = [forms.window(forms.r.choice(plain)) for _ in range(max(rows - len(known), rows // 2))]
    found = [labelled(t, own) for t, own in [*known, *made]]
    return np.array([x for x, _ in found]), np.array([y for _, y in found])


def train(docs, text="text", steps=STEPS, seed=0):
    """A tagger fitted to the documents' own labelled spans and their rewritten forms."""
    x, y = examples(sampled_windows(docs, text), ROWS, seed)
    return Tagger(LABELS, seed).fit(x, y, steps, seed=seed)


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                  ("base", pa.bool_())])


def personal(text, model):
    """A column of all spans: array of (kind, start, end, base), by kind, then start."""
    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
    def run(values: pa.Array) -> pa.Array:
        Cache.release()
        out = []
        for texts in runs(values):
            for own, added in find(model, [x or "" for x in texts]):
                rows = sorted([*((*s, True) for s in own), *((*s, False) for s in added)])
                out.append([{"kind": KINDS[k], "start": s, "end": e, "base": b}
                            for k, s, e, b in rows])
        return pa.array(out, pa.list_(SPAN))
    return run(text)


def masked(text, model):
    """A text column with each span replaced by its kind in brackets; null stays null."""
    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        Cache.release()
        out = []
        for some in runs(values):
            for text, (own, added) in zip(some, find(model, [x or "" for x in some]), strict=True):
                if text is None:
                    out.append(None)
                    continue
                parts, at = [], 0
                for kind, s, e in sorted([*own, *added], key=lambda x: (x[1], -x[2])):
                    if s >= at:
                        parts += text[at:s], f"[{KINDS[kind].upper()}]"
                    at = max(at, e)
                out.append("".join([*parts, text[at:]]))
        return pa.array(out, pa.string())
    return run(text)


def joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs, id_column="doc_id", text="text"):
    model = train(docs, text)
    found = docs.select(id_column, personal(F.col(text), model).alias("found"))
    base = F.filter("found", lambda x: x["base"])

    def count(kind):
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(id_column, *[count(k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("found")).alias("spans"))
