"""Quality rules, secrets, personal data, URLs and chat against plain reference versions."""

import base64
import bz2
import gzip
import hashlib
import html
import json
import lzma
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from urllib.parse import quote, unquote

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from worktrail.llm import chat, pii, quality, secret_scan, urls
from worktrail.llm.tagger import Tagger

DOCS = "doc_id bigint, text string, source string, text_hash string"


def words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", x or "")


# --- quality rules -----------------------------------------------------------------

def slow_repeats(own):
    spans = [tuple(own[i:i + 8]) for i in range(len(own) - 7)]
    twice = {k for k, n in Counter(spans).items() if n > 1}
    return len({j for i, s in enumerate(spans) if s in twice for j in range(i, i + 8)})


@given(st.lists(st.sampled_from("abc"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_repeated_words(own):
    assert quality.repeated_words(own) == slow_repeats(own)


def slow_rate(rows, most=quality.MAX_DOCS):
    """The rule in plain Python: {row number: (base_failed, words_left, kept)}."""
    lines = {}
    for i, (_, text, host, _) in enumerate(rows):
        own = Counter()
        for x in (text or "").split("\n"):
            w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x))
            if w:
                own[" ".join(w)] += len(w)
        lines[i] = own
    holders = defaultdict(set)
    for i, (_, text, host, _) in enumerate(rows):
        for x in lines[i]:
            holders[host, x].add(text)
    frequent = {k for k, v in holders.items() if len(v) > most}
    families = defaultdict(set)
    for i, (_, text, host, _) in enumerate(rows):
        own = sorted(quality.line_hash(x.encode()) for x in lines[i] if (host, x) in frequent)
        shared = sum(n for x, n in lines[i].items() if (host, x) in frequent)
        for x in lines[i]:
            if (host, x) in frequent:
                other = [h for h in own if h != quality.line_hash(x.encode())]
                alike = 2 * shared > len(words(text)) and other
                families[host, x].add(other[0] if alike else text)
    gone = {k for k, v in families.items() if len(v) > most}
    out = {}
    for i, (_, text, host, _) in enumerate(rows):
        n = len(words(text))
        failed = n < 20 or 100 * slow_repeats(words(text)) > 30 * n
        left = n - sum(k for x, k in lines[i].items() if (host, x) in gone)
        out[i] = failed, left, not failed and 100 * left >= quality.MIN_LEFT * n
    return out


def corpus():
    r = random.Random(3)

    def line(n):
        return " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n))

    notice, menu = "All rights reserved. Notice " + line(6), [line(7) for _ in range(3)]
    rows = [(i, line(30) + "\n" + notice.upper() + "\n" + line(12), "h", "x") for i in range(30)]
    rows += [(100 + i, "\n".join([*menu, notice, *menu, line(2)]), "h", "x") for i in range(5)]
    rows += [(200 + i, "\n".join([*menu, line(90)]), "h", "x") for i in range(25)]
    base = [line(9) for _ in range(12)]
    rows += [(300 + i, "\n".join(line(9) if r.random() < 0.1 else x for x in base), "h", "x")
             for i in range(60)]
    rows += [(400 + i, "\n".join(base), "h", "x") for i in range(40)]
    rows += [(500, None, None, None), (500, "", "h", None), (None, line(25), None, "x"),
             (501, notice, "other", "x"), (502, " ".join(["a b c d e f g h"] * 9), "h", "x"),
             (503, ("w" * 50000 + " ") * 25, "h", "x"), (503, "one\n\none\n one\none", "h", "x")]
    return rows


def test_quality_against_plain(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], DOCS)
    got = {r.doc_id: (r.base_failed, r.words_left, r.kept) for r in quality.digest(df).collect()}
    assert got == slow_rate(rows)
    kept = {i for i, r in got.items() if r[2]}
    assert all(i in kept for i, r in enumerate(rows) if r[0] in range(30))  # clean with a notice
    assert all(i not in kept for i, r in enumerate(rows) if r[0] in range(100, 105))  # nothing else
    assert all(i in kept for i, r in enumerate(rows) if r[0] in range(300, 440))  # copies


def test_quality_oracle_and_columns(spark):
    rows = [(i, *r[1:]) for i, r in enumerate(corpus()) if "w" * 99 not in (r[1] or "")]
    df = spark.createDataFrame(rows, DOCS)
    documents = df.toPandas()  # noqa: F841
    want = duckdb.sql(quality.SQL).fetchall()
    names = duckdb.sql(quality.SQL).columns
    got = [tuple(r[n] for n in names) for r in quality.digest(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert quality.kept(df).columns == df.columns
    assert quality.digest(df.limit(0)).count() == 0


def test_measures():
    m = quality.measure("One #two\n\nOne #two\n x|y \nOne #two")
    assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"]) == (7, 24, 4, 2)


# --- secrets -----------------------------------------------------------------------

KEY = "AKIA" + "ABCDEFGH12345678"
HEX = "0123456789abcdef" * 2


def test_base_secrets():
    x = f'my API_KEY = "abc.def-123" and password: short, tOkEn=12345678 {KEY} {HEX}f AKIASHORT'
    got = [(secret_scan.KINDS[k], x[s:e]) for k, s, e in sorted(secret_scan.scan(x))]
    assert got == [("assign", 'API_KEY = "abc.def-123'), ("assign", "tOkEn=12345678"),
                   ("access", KEY), ("hex", HEX + "f")]
    # A match that fails is dropped whole: nothing is looked for inside it.
    assert secret_scan.scan("token=secret:abcdefghij") == []
    assert secret_scan.scan("ſecret=abcdefghij") == []  # only A-Z and a-z vary


def found(x):
    base, every = secret_scan.find(x)
    assert base == set(secret_scan.scan(x)) and base <= every
    return {(secret_scan.KINDS[k], x[s:e]) for k, s, e in every}


@pytest.mark.parametrize("wrap", [
    lambda x: base64.b64encode(x.encode()).decode(),
    lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("="),
    lambda x: base64.b64encode(gzip.compress(x.encode())).decode(),
    lambda x: base64.b64encode(zlib.compress(x.encode())).decode(),
    lambda x: "".join(f"%{b:02X}" for b in x.encode()),
    lambda x: "".join(f"\\u{ord(c):04x}" for c in x),
    lambda x: "".join(f"&#{ord(c)};" for c in x),
])
def test_one_and_two_layers(wrap):
    secret = f"password={KEY}"
    one = wrap("see " + secret + " there")
    assert ("access", one) in found(f"text {one} text") or any(
        k == "access" for k, _ in found(f"text {one} text"))
    two = wrap(base64.b64encode(("x " + secret).encode()).decode())
    assert any(k == "access" for k, _ in found("a " + two + " b"))
    three = base64.b64encode(two.encode()).decode()
    assert ("access", three) in found("a " + three + " b")


def wrapped(raw, width, cut="\n"):
    x = base64.b64encode(raw).decode()
    return cut.join(x[i:i + width] for i in range(0, len(x), width))


@pytest.mark.parametrize("wide", [64, 76])
@pytest.mark.parametrize("cut", ["\n", "\r\n", "\n  ", "\\n"])
@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress, zlib.compress])
def test_wrapped_base64(wide, cut, pack):
    for lead in range(30, 60):
        text = " ".join(hashlib.md5(b"%d" % i).hexdigest()[:9] for i in range(lead))
        inner = (text[:lead] + f" password={KEY} é " + text).encode()
        x = wrapped(pack(inner), wide, cut)
        assert ("assign", x) in found("a: " + x + " b") and ("access", x) in found(x)


def test_base64_glued_cut_escaped_and_in_members():
    secret = f"see password={KEY} there".encode()
    x = base64.b64encode(secret).decode().rstrip("=")
    for glue in ("", "/", "_a", "key", "a/b_c"):
        for more in ("", "x", "xy", "xyz"):
            assert any(k == "access" for k, _ in found(f"q {glue}{x}{more} z"))
    for pack in (gzip.compress, zlib.compress):
        for y in (quote(pack(secret)), "".join(f"\\x{b:02x}" for b in pack(secret)),
                  "".join(f"%{b:02X}" for b in pack(secret)), repr(pack(secret))):
            assert any(k == "access" for k, _ in found("q " + y + " z"))
    for pack in (gzip.compress, bz2.compress, lzma.compress):
        y = base64.b64encode(pack(b"first member " * 9) + pack(secret[:12]) + pack(secret[12:])).decode()
        assert ("access", y) in found("q " + y + " z")


def test_spans_map_to_characters():
    x = "é token=abc%64efgh%69 end"
    assert ("assign", "token=abc%64efgh%69") in found(x)
    y = "q \\u0041KIAABCDEFGH12345678 z"
    assert ("access", "\\u0041KIAABCDEFGH12345678") in found(y)


def test_cycles_broken_escapes_and_bombs():
    assert found("%25%32%35%25 \\u{FFFFFFFF} %zz &#99999999; ====") == set()
    x = "a"
    for _ in range(30):
        x = quote(x, safe="")
    assert found(x) == set()
    big = b" " * (20 << 20) + b"token=12345678abc" + b" " * (9 << 20)
    assert {k for k, _ in found(base64.b64encode(gzip.compress(big)).decode())} == {"assign"}


def test_percent_spans_are_exact_beside_other_characters():
    """One é, a stray byte and a broken sequence in a run: each secret keeps its own escapes."""
    run = "".join(f"%{b:02X}" for b in (f"é a {KEY} \u6f22 token=abcdefgh1 ".encode() + b"\xff\xc3 " + b"z"))
    x = "q " + run + " z"
    at = run.index("".join(f"%{b:02X}" for b in KEY.encode()))
    word = "".join(f"%{b:02X}" for b in b"token=abcdefgh1")
    assert found(x) == {("access", run[at:at + 3 * len(KEY)]), ("assign", word)}


def test_memory_of_what_unpacks_to_much():
    """A text of some kilobytes that unpacks to 200 MB is read in bounded memory, twice nested too."""
    big = gzip.compress(b" " * (100 << 20) + b"token=12345678abc" + b" " * (100 << 20))
    for x in (base64.b64encode(big), base64.b64encode(gzip.compress(base64.b64encode(big)))):
        tracemalloc.start()
        try:
            assert {k for k, _ in found(x.decode())} == {"assign"}
            assert tracemalloc.get_traced_memory()[1] < 60 << 20
        finally:
            tracemalloc.stop()


def unwrapped(text, depth=9):
    """All texts inside a text by plain recursion: whole words that decode, no spans."""
    out = {text}
    if depth:
        for word in re.split(r"[^A-Za-z0-9+/=%\\&#;]+", text):
            for decode in (lambda w: unquote(w, errors="strict"), html.unescape,
                           lambda w: re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), w),
                           lambda w: base64.b64decode(w, validate=True).decode(),
                           lambda w: gzip.decompress(base64.b64decode(w, validate=True)).decode()):
                try:
                    said = decode(word)
                except (ValueError, OSError, EOFError, zlib.error):
                    continue
                if len(word) >= 16 and said != word:
                    out |= unwrapped(said, depth - 1)
    return out


def test_nested_layers_against_plain_recursion():
    rnd = random.Random(8)
    wraps = [lambda b: base64.b64encode(b).decode(), lambda b: base64.b64encode(gzip.compress(b)).decode(),
             lambda b: "".join(f"%{x:02X}" for x in b), lambda b: "".join(f"\\u{x:04x}" for x in b),
             lambda b: "".join(f"&#{x};" for x in b)]
    for _ in range(150):
        secret = rnd.choice([KEY, "token=abcdefgh1", HEX, "nothing here at all"])
        x = f"see {secret} there"
        for _ in range(rnd.randint(1, 4)):
            x = "a " + rnd.choice(wraps)(x.encode()) + " b"
        want = {k for t in unwrapped(x) for k, *_ in secret_scan.scan(t)}
        assert {secret_scan.KINDS.index(k) for k, _ in found(x)} >= want
        assert (secret == "nothing here at all") == (not want)


def test_secret_query_edges(spark):
    x = f"{KEY} token=abcdefgh"
    df = spark.createDataFrame([(1, None, None, "c"), (1, "", "s", "c"), (None, x, "s", "c"),
                                (None, x, "s", "c"), (2, "y" * 300000, "s", "c")], DOCS)
    rows = sorted(((r.doc_id or 0, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans)
                   for r in secret_scan.digest(df).collect()))
    spans = "access:0:20,assign:21:35"
    sha = hashlib.sha256(spans.encode()).hexdigest()
    none = hashlib.sha256(b"").hexdigest()
    assert rows == sorted([(1, 0, 0, 0, none, "")] * 2 + [(0, 1, 1, 0, sha, spans)] * 2
                          + [(2, 0, 0, 0, none, "")])
    assert secret_scan.digest(df.limit(0)).count() == 0


# --- personal data -----------------------------------------------------------------

SLOW = [(0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), (2, r"[0-9]([\x20-]?[0-9])+"),
        (3, r"\+[0-9][\x20().0-9-]+[0-9]")]
FINE = {0: lambda x: True, 1: lambda x: all(int(p) <= 255 for p in x.split(".")),
        2: pii.is_card, 3: pii.is_phone}


@given(st.text(alphabet=list("0123456789+-. ()@aZ_%é"), max_size=50))
@settings(max_examples=1500, deadline=None)
def test_base_rules_are_the_patterns(x):
    want = [(k, *m.span()) for k, p in SLOW for m in re.finditer(p, x) if FINE[k](m[0])]
    assert sorted(pii.scan(x)) == sorted(want)


def test_base_rules_on_long_runs():
    for x in ("a" * 200000, "1" * 200000, "1." * 100000, "a@" * 50000, "+1" * 50000, "@" * 50000):
        assert len(pii.scan(x)) <= 1 << 16


def test_gradients():
    m = Tagger(pii.LABELS, 1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, y = pii.examples([], 40, 3)
    x, y = x[:3, :10], y[:3, :10]
    _, g = m.loss(x, y)
    for k in m.p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        was = m.p[k][at]
        m.p[k][at] = was + 1e-4
        up = m.loss(x, y)[0]
        m.p[k][at] = was - 1e-4
        down = m.loss(x, y)[0]
        m.p[k][at] = was
        assert abs((up - down) / 2e-4 - g[k][at]) < 1e-3 * max(1, abs(g[k][at]))


@pytest.fixture(scope="module")
def model():
    x, y = pii.examples([], 2000, 0)
    return Tagger(pii.LABELS, 0).fit(x, y, pii.STEPS)


def test_held_out_accuracy(model):
    x, y = pii.examples([], 1000, 77)
    path = np.array([model.best_path(e) for e in model.forward(x)[0]])
    assert (path == y).mean() > 0.95
    inside = y > 0
    assert (path[inside] > 0).mean() > 0.9


def test_added_spans_and_windows(model):
    text = "call (212) 555-0188 now or mail joe.doe (at) example (dot) org today " + "lorem " * 40
    own, added = pii.find(model, [text])[0]
    assert own == [] and all(pii.plausible(k, text[s:e]) for k, s, e in added)
    base = "x +1 (743) 555-3824 y"
    own, added = pii.find(model, [base])[0]
    assert own == [(3, 2, 19)] and all(e <= 2 or s >= 19 for _, s, e in added)
    assert pii.windows(64) == [0] and pii.windows(65) == [0, 1] and pii.windows(200)[-1] == 136
    assert pii.stretches("a" * 500) == []


@pytest.mark.parametrize("said", ["jane.roe (at) mailer (dot) org", "jane[at]mailer[dot]org",
                                  "jane.roe(at)mailer.com", "jane [AT] mailer [DOT] net"])
def test_addresses_of_letters_only(model, said):
    for left, right in (("", ""), ("lorem " * 40, " lorem" * 40), ("write to ", ". thanks")):
        text = left + said + right
        own, added = pii.find(model, [text])[0]
        assert own == [] and added == [(0, len(left), len(left) + len(said))]
    assert pii.candidates("flat matter dotted atlas " * 40) == []
    assert pii.find(model, ["meet at the corner. we dot the lines. they look at it. " * 9])[0] == ([], [])


def test_personal_query_edges(spark):
    x = "mail a@b.co, 1.2.3.4"
    df = spark.createDataFrame([(1, None, None, "c"), (1, "", "s", "c"), (None, x, "s", "c"),
                                (None, x, "s", "c"), (2, "y" * 300000, "s", "c")], DOCS)
    rows = sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)
                  for r in pii.digest(df).collect())
    none = hashlib.sha256(b"").hexdigest()
    sha = hashlib.sha256(b"email:5:11,ip:13:20").hexdigest()
    assert rows == sorted([(1, 0, 0, 0, 0, none)] * 2 + [(0, 1, 1, 0, 0, sha)] * 2
                          + [(2, 0, 0, 0, 0, none)])
    assert pii.digest(df.limit(0)).count() == 0


# --- URLs --------------------------------------------------------------------------

URLS = ["http://Example.NET/en/x", "http://a.example.net/de/", "https://sub.org/fr/1?x#y",
        "http://org/fr/", "http://example.com/de/1", "http://notexample.com/de/1", "no scheme",
        None, "", "http://", "http://h.net", "http://h.net?q", "x://www.spam-farm.org/a/?utm_x=1&b=2&a=1#f",
        "http://spam-farm.org/a?a=1&b=2", "http://ÉXAMPLE.org/a\nb?c", "ftp://a://b/c"] * 2


def test_urls_against_sql(spark):
    df = spark.createDataFrame([(i if i % 5 else None, u, "h") for i, u in enumerate(URLS)],
                               "page_id bigint, url string, host string")
    pages = df.toArrow()  # noqa: F841
    rel = duckdb.sql(urls.SQL)
    names = rel.columns
    got = [tuple(r[n] for n in names) for r in urls.judge(
        df, urls.bad_host_urls(df), urls.RULES).collect()]
    assert sorted(map(str, got)) == sorted(map(str, rel.fetchall()))
    by = {(r.host, r.path): (r.rule, r.verdict) for r in urls.judge(
        df, urls.bad_host_urls(df), urls.RULES).collect()}
    assert by["example.net", "/en/x"] == ("example.net/en/", "allow")
    assert by["a.example.net", "/de/"] == ("net/", "block")
    assert by["h.net", ""] == (None, "allow")
    assert by["spam-farm.org", "/a"] == (None, "block")
    assert by["", ""] == (None, "allow")


def test_no_listed_url_is_lost(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id as page_id", "concat('http://h', id, '.org/p') as url")
    listed = df.filter("page_id % 3 = 0").selectExpr("concat('h', page_id, '.org/p') as canonical")
    for blocks in (2, 1 << 16):  # even an overfull filter decides nothing by itself
        monkeypatch.setattr(urls, "BLOCKS", blocks)
        out = urls.judge(df, listed, []).filter("listed").count()
        assert out == 1000
    assert urls.judge(df, listed.limit(0), []).filter("verdict = 'allow'").count() == 3000


# --- chat --------------------------------------------------------------------------

@given(st.text(alphabet=list("\\#/<>turn |n:\nAé"), max_size=30))
@settings(max_examples=500, deadline=None)
def test_escape_reads_back(text):
    assert chat.unescape(chat.escape(text)) == text
    row = chat.segment([(text, text), ("assistant", text)], chat_path())
    assert chat.read_back(row["formatted"]) == [(text, text), ("assistant", text)]


def chat_path():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def test_chat_against_plain(spark):
    r = random.Random(1)
    odd = "\\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", odd), (1, 0, "user", odd), (2, 0, "assistant", None),
            (None, None, None, "x"), (3, 0, "assistant", " \n lead 漢字😀 tail \n "),
            (3, 0, "assistant", "<|endoftext|>"), (3, 0, "assistant", "<|endoftext|>")]
    rows += [(7, i, r.choice(["user", "assistant"]), "w" * r.randrange(3000)) for i in range(300)]
    df = spark.createDataFrame([(*x, "n") for x in rows],
                               "conv_id bigint, turn bigint, role string, text string, n_turns string")
    got = {x.conv_id: x for x in chat.digest(chat.format_conversations(df, size=5000)).collect()}
    by = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda x: json.dumps(
            [x[0] or 0, x[1] is not None, f"{x[1] or 0:09}", x[2] or "", x[3] or ""])):
        by[conv].append((role or "", text or ""))
    assert got.keys() == by.keys()
    for conv, turns in by.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        x = got[conv]
        assert x.n_turns == len(turns) and x.loss_chars == len(loss)
        assert x.turns_sha256 == hashlib.sha256(
            "".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert x.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert x.formatted_chars == len(chat.segment(turns, chat_path())["formatted"])
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


def test_segments_encode_like_the_whole():
    turns = [("user", " a\n"), ("assistant", "\n b  "), ("assistant", "é漢"), ("user", "")]
    whole = chat.segment(turns, chat_path())["ids"]
    assert b"".join(chat.segment([t], chat_path())["ids"] for t in turns) == whole
