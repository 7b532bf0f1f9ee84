"""Spelling variants against brute force."""
import collections
import random
import re
import zlib

import pytest

from placerank.llm import spelling as sp

SCHEMA = "doc_id long, text string, word string, n int, form string"


def brute(rows, min_length=7, min_count=2, ratio=10):
    counts = collections.Counter()
    for i, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= min_length:
                counts[w] += 1
    n = {w: c for w, c in counts.items() if c >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    by = collections.defaultdict(list)
    for a in n:
        by[a] = [b for b in n if near(a, b)]
    form = {}
    for w, others in by.items():
        if others and n[best := min(others, key=lambda b: (-n[b], b))] >= ratio * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n[w], len(by[w]), n.get(form.get(w))) for w in n), key=str)


def got(df, **options):
    cols = ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in sp.spelling_variants(df, **options).select(*cols).collect()), key=str)


def words(rng, n):
    """Families of words one or two edits apart, some within runs of one letter."""
    out = []
    for _ in range(n):
        base = "".join(rng.choice("abé") for _ in range(rng.randrange(6, 12)))
        out.append(base)
        for _ in range(4):
            w, i = rng.choice(out[-3:]), rng.randrange(7)
            out.append(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abéÿ") + w[i:], w[:i] + rng.choice("abé") + w[i + 1:]]))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocabulary = words(rng, 60) + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "Straße" * 2, "ABCDEFG", "abcdefh", "x" * 3000, "x" * 2999]
    rows = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (1 + k % 40) for k in range(len(vocabulary))], k=300)), "z", 1, None) for i in range(12)]
    rows += [(None, "abcdefg abcdefg, abcdefg", None, None, None), (20, None, None, None, None), (21, "", None, None, None), (22, "abcdefg7abcdefg x-y", "q", 2, "w")]
    return rows + rows[:2]


def test_matches_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute(rows)
    assert got(df) == want and sum(w[4] for w in want) > 100 and any(w[2] not in (w[0], w[1]) for w in brute(rows, ratio=2))
    assert got(df, ratio=2) == brute(rows, ratio=2)


def test_crowded_nodes_have_copies(spark, rows, monkeypatch):
    monkeypatch.setattr(sp, "SPREAD", 3)
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_short_words_and_no_words(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    short = [(i, (t or "")[:400] if t is not None else None) for i, t, *_ in rows[:5]]
    assert got(spark.createDataFrame(short, "doc_id long, text string"), min_length=3, min_count=1) == brute(short, 3, 1)
    assert got(df.limit(0)) == [] and got(df.filter("text is null")) == []
    assert got(spark.createDataFrame([(1, "lonelyword lonelyword")], "doc_id long, text string")) == brute([(1, "lonelyword lonelyword")])


def test_no_join_broadcasts_a_table_that_looks_small(spark, rows, monkeypatch):
    """Files of words say little about the prefixes made of them: no table of the walk goes through the driver."""
    plans, write = [], sp.saved

    def saved(df, label="step"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(sp, "saved", saved)
    out = sp.spelling_variants(spark.createDataFrame(rows, SCHEMA))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("Join" in p for p in plans) > 4 and not any("Broadcast" in p for p in plans)
