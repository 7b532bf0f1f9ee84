"""Secret scan: plain patterns against brute force, planted layers at their places, cycles and odd rows."""
import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import zlib
from urllib.parse import quote

import pytest

from placerank.llm.secret_scan import KINDS, Layer, _mark, _peel, find, find_secrets

KEY = "AKIA" + "Q7ZJ2M4N8P6R5T3V"
LOGIN = "password = Tr0ub4dor_and_3"


def plain(text):
    """The patterns as given, failing matches dropped."""
    out = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
                         r"""[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


def written(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_patterns_match_brute_force():
    rng = random.Random(5)
    bits = ["password", "Token", "SECRET", "api_key", "apikey", "AKIA", "KIA", "=", ":", " ", "  ", "'", '"', "abc", "0f" * 4, "Z9", "-", ".",
            "ſecret", "toKen", "é", "\n", "deadbeef", "Q" * 6]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert find(text) == plain(text), text


NESTED = [
    ("url", quote(LOGIN, safe=""), 0), ("url twice", quote(quote(LOGIN, safe=""), safe=""), 0),
    ("unicode", "".join(f"\\u{ord(c):04x}" for c in KEY), 1), ("hex escapes", "".join(f"\\x{ord(c):02x}" for c in KEY), 1),
    ("gzip", b64(gzip.compress(KEY.encode())), 1), ("zlib", b64(zlib.compress(b"see " + KEY.encode())), 1),
    ("bzip2", b64(bz2.compress(KEY.encode())), 1), ("xz", b64(lzma.compress(KEY.encode())), 1),
    ("gzip of gzip", b64(gzip.compress(gzip.compress(KEY.encode()))), 1),
    ("url of zlib", "".join(f"%{b:02X}" for b in zlib.compress(KEY.encode())), 1),
    ("gzip of base64", b64(gzip.compress(b64("the key is " + KEY).encode())), 1),
]


@pytest.mark.parametrize("name,code,kind", NESTED, ids=[n[0] for n in NESTED])
def test_layers_are_found_where_they_lie(spark, name, code, kind):
    text = f"Über line, {code} , end"
    start = text.index(code)
    got = find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    hidden = {(f["kind"], f["start"], f["end"]) for f in got["found"]} - {(k, s, e) for s, k, e in plain(text)}
    assert (kind, start, start + len(code)) in hidden


def test_base64_finds_have_their_own_characters(spark):
    inner = b64("first words, then " + KEY + " and more words after it")
    text = "blob:" + b64("outer " + inner + " tail")
    got = find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    (span,) = [f for f in got["found"] if f["kind"] == 1]
    assert 5 < span["start"] < span["end"] < len(text) - 10
    lo, hi = 18, 18 + len(KEY)                       # the key in the inner text, its characters in the inner token,
    lo, hi = 6 + lo * 4 // 3, 6 + -(-hi * 4 // 3)    # these in the outer text, and theirs in the outer token
    assert (span["start"], span["end"]) == (5 + lo * 4 // 3, 5 + -(-hi * 4 // 3))


def test_lines_of_wrapped_base64(spark):
    code = b64("x" * 80 + " " + KEY + " " + "y" * 40)
    wrapped = "\n".join(code[i:i + 64] for i in range(0, len(code), 64))
    got = find_secrets(spark.createDataFrame([(1, "body\n" + wrapped)], "doc_id long, text string")).first()
    (span,) = [f for f in got["found"] if f["kind"] == 1]
    lo, hi = 81 * 4 // 3, -(-(81 + len(KEY)) * 4 // 3) - 1
    assert (span["start"], span["end"]) == (5 + lo + lo // 64, 5 + hi + hi // 64 + 1)


def test_a_layer_that_comes_again_ends():
    raw = gzip.compress(b"loop")
    assert _peel(raw, [], 1 << 20)[0] == "loop"
    assert _peel(raw, [_mark(raw)], 1 << 20) is None
    assert _peel(raw, [_mark(b"loop")], 1 << 20) is None


def test_bomb_is_cut_and_counted(spark):
    bomb = b64(gzip.compress(KEY.encode() + b" " * 300_000))
    got = find_secrets(spark.createDataFrame([(1, bomb)], "doc_id long, text string"), max_layer=100_000).first()
    assert got["n_over"] == 1 and "access:0:" in got["spans"]


def test_rows(spark):
    long = "plain words without anything " * 20_000 + LOGIN
    texts = [LOGIN, LOGIN, None, "", "token: abc", long, "x " + b64(KEY + " is the key"), "%zz \\u12 100% sure", "QUJD" * 30]
    rows = [(i if i != 4 else None, t, "en", 1) for i, t in enumerate(texts)] + [(0, LOGIN, None, 2), (6, texts[6], None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, key int").repartition(3)
    got = [r.asDict() for r in find_secrets(df).collect()]
    assert len(got) == len(rows)
    by = {}
    for g in got:
        by.setdefault(g["doc_id"], []).append(g)
    for i, t, *_ in rows:
        base = plain(t or "")
        for g in by[i]:
            assert [g[f"n_{k}"] for k in KINDS] == [sum(s[1] == j for s in base) for j in range(3)]
            assert g["base_sha256"] == hashlib.sha256(written(base).encode()).hexdigest()
            if i != 6:
                assert g["spans"] == written(base)
    assert all("access:" in g["spans"] and g["n_access"] == 0 for g in by[6]) and len(by[6]) == 2
    assert find_secrets(df.limit(0)).count() == 0


def test_text_ids(spark):
    df = spark.createDataFrame([("a", LOGIN), ("b", None)], "doc_id string, text string")
    assert {(r["doc_id"], r["n_assign"]) for r in find_secrets(df).collect()} == {("a", 1), ("b", 0)}
