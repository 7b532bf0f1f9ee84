"""Corpus operators against brute force, on small tables with null, empty, long, tied and repeated rows."""
import base64
import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, id int, key int"
TEST = "question one asks which of the seven lamps was lit before the long night ended in the harbour town"
MIT = "Released under the MIT License."


def prose(rng, n):
    return " ".join(rng.choice("amber birch cloud delta ember frost grove haven islet jewel karst lotus maple north "
                               "ocean prism quartz ridge stone tulip umber vivid willow xenon yield zephyr".split())
                    + str(rng.randrange(90)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    a, b, c = prose(rng, 120), prose(rng, 300), prose(rng, 60)
    words = a.split()
    words[40] = "changed"
    texts = [a, a, a + " ", " ".join(words), b, "x\n" + b, c, "", None, "   \n\t", "one two", "ONE, two!", "é" * 30,
             "Mail bob.k@mail.example.com or +1 (555) 010-9999 now 4111 1111 1111 1111 from 10.0.0.255 not 10.0.0.256",
             f"{c}\n{MIT}\nApache License, Version 2.0 cc by-nc " + c, f"intro {TEST} outro", prose(rng, 5000),
             "\n".join([prose(rng, 20), "A quiet line that many texts share, word for word, again and again.", prose(rng, 20)]),
             "\n".join([prose(rng, 20), "A quiet line that many texts share, word for word, again and again!", prose(rng, 20)]),
             "ab" * 400, "The " + "same " * 90]
    out = [(i, t, "en" if i % 2 else None, f"src{i % 3}", 1, 0.5, "k", 1, 2) for i, t in enumerate(texts)]
    out += [out[0], out[13]]                                                    # repeated rows
    out += [(None, a, None, None, None, None, None, None, None), (None, "lone words " + c, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def got(df):
    return [r.asDict() for r in df.collect()]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in t or "")


def test_exact_dedup(docs, rows):
    from placerank.llm.exact_dedup import exact_dedup

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    best = {}
    for d, t, *_ in rows:
        k = (-len(t or ""), d is None, d)
        best[norm(t)] = min(best.get(norm(t), k), k)
    size = collections.Counter(norm(r[1]) for r in rows)
    want = sorted(str((d, best[norm(t)][2], size[norm(t)], d == best[norm(t)][2], hashlib.sha256(norm(t).encode()).hexdigest()))
                  for d, t, *_ in rows)
    for options in ({}, {"heavy_rows": 2, "max_heavy": 3}):
        assert sorted(str(tuple(r.values())) for r in got(exact_dedup(docs, **options))) == want
    assert exact_dedup(docs.limit(0)).count() == 0


def brute_spans(t):
    t = t or ""
    digits = lambda v: re.sub("[^0-9]", "", v)

    def luhn(v):
        d = [int(x) for x in v[::-1]]
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0

    checks = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
              ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
              ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v))),
              ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15)]
    return [(k, m.start(), m.end()) for k, p, ok in checks for m in re.finditer(p, t) if ok(m[0])]


def test_pii_base(spark, docs, rows):
    from placerank.llm.pii import find_pii

    odd = ["a@b.c_d@x.y z@@q.w a@b a@b..c", "1.2.3.4.5.6.7.8 001.02.3.255 9.9.9", "+1 2 3 +12345678901 ((+4) 1-2-3-4-5-6-7-8-9",
           "é😀 4111-1111-1111-1111 4111111111111112 " + "12 " * 3000, "x" * 20000 + "@" + "a." * 5000 + "b", "7" * 30000, "+" + "1" * 20000]
    df = docs.unionByName(spark.createDataFrame([(900 + i, t) + (None,) * 7 for i, t in enumerate(odd)], SCHEMA))
    texts = {900 + i: t for i, t in enumerate(odd)} | {r[0]: r[1] for r in rows if r[0] is not None}
    out = got(find_pii(df))
    assert len(out) == len(rows) + len(odd)
    for r in out:
        if r["doc_id"] is None:
            continue
        base = brute_spans(texts[r["doc_id"]])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), r["doc_id"]
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[0] == k for x in base) for k in ("email", "ip", "card", "phone")]
    assert find_pii(docs.limit(0)).count() == 0


def test_pii_terms_follow_the_entity(spark):
    from placerank.llm.pii import find_pii, sanitise

    rng = random.Random(5)
    data = [(i, f"{prose(rng, 30)} zanzibarian contact ann@corp.example.org {prose(rng, 5)}") for i in range(4)]
    data += [(10 + i, prose(rng, 40) + " contact us") for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    out = {r["doc_id"]: r for r in got(find_pii(df))}
    for i, t in data[:4]:
        at = t.index("zanzibarian")
        assert f"term:{at}:{at + 11}" in out[i]["spans"].split(",")
        assert "general" not in out[i]["spans"] or "contact" in t
    assert all(out[i]["spans"] == "" for i, _ in data[4:])
    clean = {r["doc_id"]: r["clean_text"] for r in got(sanitise(df))}
    assert all("zanzibarian" not in clean[i] and "[EMAIL]" in clean[i] and "ann@" not in clean[i] for i in range(4))
    assert all(clean[i] == t for i, t in data[4:])


def test_warc_round_trip(spark):
    from placerank.llm.warc import archive_pages

    rng = random.Random(1)
    data = [(i, f"http://h/{i}", f"<p>{prose(rng, 50)}</p>") for i in range(40)]
    data += [(50, None, None), (51, "a\r\nb", ""), (52, "u", data[3][2]), (53, "u", data[3][2]), (53, "u", data[3][2]),
             (54, "u", "é" * 100_000), (None, "n", data[3][2])]
    df = spark.createDataFrame([(*r, 1) for r in data], "page_id long, url string, html string, digest int").repartition(3)
    out = got(archive_pages(df))
    assert len(out) == len(data)
    payload = lambda t: (t or "").encode()
    first = {}
    for i, _, t in data:
        if i is not None:
            first[payload(t)] = min(first.get(payload(t), i), i)
    text = {i: t for i, _, t in data}
    for r in out:
        p = payload(text[r["page_id"]])
        assert r["payload_bytes"] == len(p)
        assert r["digest"] == base64.b32encode(hashlib.sha1(p).digest()).decode()
        response = r["page_id"] == first[p]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if response else ("revisit", first[p]))
        assert bytes(r["payload"]) == (p if response else b"")
    assert archive_pages(df.limit(0)).count() == 0


def test_quality(spark, docs):
    from placerank.llm.quality import classify, fit

    rng = random.Random(2)
    good = [(i, prose(rng, rng.randrange(5, 200)), 1) for i in range(150)]
    bad = [(200 + i, " ".join(w.upper() + "###" for w in prose(rng, rng.randrange(5, 200)).split()), 0) for i in range(150)]
    df = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(None, 1), (9999, 0), (3, None)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in got(classify(df, labels))}
    held = [(i, q) for i, _, q in good + bad if out[i]["held_out"]]
    import zlib
    assert {i for i, _ in held} == {i for i, *_ in good + bad if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([out[i]["predicted"] == q for i, q in held]) >= 0.95
    scored = got(classify(docs, labels.limit(0)))                # no labels: one score for all
    assert len(scored) == docs.count() and {r["score"] for r in scored} == {0.5}
    assert all(0 <= r["score"] <= 1 for r in got(classify(docs, labels)))
    model = fit([], np.zeros(0))
    assert model.score(np.zeros((0, 69)), np.zeros(0, int), 2).tolist() == [0.5, 0.5]
    assert classify(docs.limit(0), labels).count() == 0


def test_license_base(docs, rows):
    from placerank.llm.license_scan import PHRASES, license_scan

    out = collections.Counter()
    for r in got(license_scan(docs)):
        out[str((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]))] += 1
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    want = collections.Counter()
    for d, t, *_ in rows:
        w = WORD.findall(low(t))
        hits = [(i, label) for p, label in PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        want[str((d, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))] += 1
    assert out == want
    assert license_scan(docs.limit(0)).count() == 0


def test_license_notice_with_a_word_changed(spark):
    from placerank.llm.license_scan import license_scan

    text = "x " * 7 + "This work is hereby licensed under the GNU General Public License, version 3."
    row = got(license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")))[0]
    assert row["labels"] == "gpl-3" and row["n_base"] == 0 and 0.8 <= row["score"] <= 1


def brute_repeats(rows):
    seen, out = set(), {}
    order = lambda r: (r[0] is None, r[0] or 0)
    for d, t in sorted(set(rows), key=order):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 99):
            if b[i:i + 100] in seen:
                gone[i:i + 100] = True
            seen.add(b[i:i + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out[(d, t)] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()),
                       hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("odd_ids", [False, True])
def test_substring_dedup(spark, rows, odd_ids):
    from placerank.llm.substring_dedup import remove_repeats

    rng = random.Random(8)
    seen, data = set(), []
    for r in rows:
        if odd_ids and r[0] is not None or r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            data.append((r[0], r[1]))
    if odd_ids:
        data.append((None, rows[0][1]))
    shared = prose(rng, 40)
    data += [(100 + i, prose(rng, 30) + shared + prose(rng, 5) + "ab" * 100) for i in range(8)]
    data += [(200 + i, "q" * i) for i in (99, 100, 101, 350)]
    want = brute_repeats(data)
    df = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, id int").repartition(4)
    out = got(remove_repeats(df))
    assert sorted(str((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in out) == \
        sorted(str((r[0], *want[r])) for r in data)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in out)
    assert remove_repeats(df.limit(0)).count() == 0


def shingles(t):
    w = WORD.findall(low(t))
    return collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def test_near_dedup(docs, rows):
    from placerank.llm.near_dedup import near_duplicates

    def alike(a, b):
        x, y = shingles(a), shingles(b)
        both = sum((x & y).values())
        return both and both / (sum(x.values()) + sum(y.values()) - both) >= 0.8

    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if alike(rows[i][1], rows[j][1]):
            parent[find(j)] = find(i)
    want = collections.Counter()
    for i, r in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if find(j) == find(i)]
        known = [d for d in group if d is not None]
        name = min(known) if known else None
        want[str((r[0], name, len(group), r[0] == name))] += 1
    out = collections.Counter(str((r["doc_id"], r["group_id"], r["group_size"], r["kept"])) for r in got(near_duplicates(docs)))
    assert out == want
    assert near_duplicates(docs.limit(0)).count() == 0


def test_near_dedup_finds_a_large_group_of_near_copies(spark):
    from placerank.llm.near_dedup import near_duplicates

    rng = random.Random(4)
    words = prose(rng, 150).split()
    data = []
    for i in range(150):
        w = list(words)
        for _ in range(2):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10 ** 6)}"
        data.append((i, " ".join(w)))
    data += [(1000 + i, prose(rng, 150)) for i in range(50)]
    out = got(near_duplicates(spark.createDataFrame(data, "doc_id long, text string")))
    assert {r["group_id"] for r in out if r["doc_id"] < 1000} == {0}
    assert sum(r["kept"] for r in out) == 51


def test_signature_estimates_weighted_jaccard():
    from placerank.llm.near_dedup import dart_signatures

    rng = np.random.default_rng(0)
    pool = rng.integers(1, 1 << 62, 900, dtype=np.uint64)
    a, b = pool[:600], pool[100:700]
    sig = dart_signatures(np.concatenate([a, b]), np.repeat([0, 1], 600), 3, 2000)
    assert (sig[2] == 0).all() and abs((sig[0] == sig[1]).mean() - 500 / 700) < 0.04


def test_components(spark):
    from placerank.llm.linking import components

    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges += [(5000, 5001 + i) for i in range(100)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    out = {r["node"]: r["root"] for r in got(components(spark.createDataFrame(edges, "a long, b long")))}
    assert all(out.get(x, x) == find(x) for x in parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontaminate(spark, docs, rows):
    from placerank.llm.decontaminate import decontaminate, tile

    parts = TEST.split()
    other = " ".join(parts[9:] + ["filler"] * 3 + parts[:9])                     # reordered halves
    items = [(1, TEST), (2, None), (3, ""), (4, "too short"), (5, rows[4][1][:200]), (6, other), (7, "no such words at all here")]
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, covered int")
    extra = spark.createDataFrame([(700, other) + (None,) * 7, (701, " ".join(parts[:9])) + (None,) * 7], SCHEMA)
    out = got(decontaminate(docs.unionByName(extra), bench))
    assert len(out) == len(rows) + 2 and set(out[0]) >= set(docs.columns)
    by = {r["doc_id"]: r for r in out}
    assert 1 in by[15]["item_ids"] and 1 in by[700]["item_ids"] and by[701]["n_items"] == 0
    assert {i for i, r in by.items() if r["contaminated"]} == {4, 5, 15, 700}
    assert not any(r["contaminated"] for r in got(decontaminate(docs, bench.limit(0))))
    assert decontaminate(docs.limit(0), bench).count() == 0
    assert tile([(i, i) for i in range(6)] + [(20, 2), (21, 3)]) == 10            # 6 seeds: 10 words; the rest overlaps


def test_mixing_rakes_to_targets(spark, docs, rows):
    from placerank.llm.mixing import mix_sources, rake

    rng = np.random.default_rng(1)
    targets = ({"a": 0.5, "*": 0.5}, {"en": 0.6, "de": 0.4}, {"p": 0.7, "q": 0.2, "r": 0.1})
    cells = [(s, la, t, int(rng.integers(1, 1000))) for s in "a*" for la in ("en", "de") for t in "pq"]
    out = got(rake(spark.createDataFrame(cells, "k0 string, k1 string, k2 string, w long"), targets, 200))
    x = {c[:3]: float(c[3]) for c in cells}
    total = sum(x.values())
    for _ in range(200):
        for m, target in enumerate(targets):
            live = {k: v for k, v in target.items() if any(c[m] == k for c in x)}
            for k in live:
                s = sum(v for c, v in x.items() if c[m] == k)
                for c in x:
                    if c[m] == k:
                        x[c] *= live[k] / sum(live.values()) * total / s
    assert all(abs(r["raked"] - x[(r["k0"], r["k1"], r["k2"])]) < 1e-6 * total for r in out)
    mixed = got(mix_sources(docs))
    assert len(mixed) == len(rows) and all(0 <= r["probability"] <= 1 for r in mixed)
    assert {r["doc_id"]: r["n_tokens"] for r in mixed}[10] == 2
    assert mix_sources(docs.limit(0)).count() == 0


def test_mixing_samples_by_probability(spark):
    from placerank.llm.mixing import mix_sources

    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"), F.lit("en").alias("lang"),
                                  F.when(F.col("id") % 2 == 0, "src0").otherwise("src1").alias("source"))
    out = got(mix_sources(df))
    share = np.mean([r["source"] == "src0" for r in out if r["kept"]])
    assert abs(share - 0.25) < 0.03 and all(r["kept"] for r in out if r["source"] == "src1")


def test_mixing_keeps_other_languages(spark):
    from placerank.llm.mixing import mix_sources

    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"), F.lit("src1").alias("source"),
                                  F.when(F.col("id") % 100 == 0, None).when(F.col("id") % 50 == 0, "it").otherwise("en").alias("lang"))
    out = got(mix_sources(df))
    assert all(r["probability"] > 0 for r in out) and {r["lang"] for r in out if r["kept"]} == {"en", "it", None}


def test_mixing_trims_weights(spark):
    from placerank.llm.mixing import rake

    cells = [("a", "en", "p", 5000), ("a", "de", "p", 3000), ("*", "en", "p", 2000), ("*", "en", "q", 3)]
    targets = ({"a": 0.5, "*": 0.5}, {"en": 0.6, "de": 0.4}, {"p": 0.7, "q": 0.3})
    out = {(r["k0"], r["k1"], r["k2"]): r["raked"] for r in got(rake(
        spark.createDataFrame(cells, "k0 string, k1 string, k2 string, w long"), targets, 100, 4.0))}
    x, total = {c[:3]: float(c[3]) for c in cells}, sum(c[3] for c in cells)
    for _ in range(100):
        for m, target in enumerate(targets):
            for k, share in target.items():
                s = sum(v for c, v in x.items() if c[m] == k)
                x = {c: v * share * total / s if c[m] == k else v for c, v in x.items()}
        x = {c[:3]: min(x[c[:3]], 4.0 * c[3]) for c in cells}
    assert all(abs(out[c] - x[c]) < 1e-6 * total for c in x)
    assert out[("*", "en", "q")] <= 12 and min(out[c[:3]] / c[3] for c in cells) > 0.1


def test_line_dedup(docs, rows):
    from placerank.llm.line_dedup import dedup_lines

    out = got(dedup_lines(docs))
    assert len(out) == len(rows) and set(out[0]) >= set(docs.columns)
    by = {r["doc_id"]: r for r in out}
    assert (by[17]["n_dropped"], by[18]["n_dropped"]) == (0, 1)                   # the shared line, but for a mark
    assert by[18]["dropped"] == [1] and "quiet line" not in by[18]["kept_text"]
    assert by[1]["n_dropped"] == 1 and by[0]["n_dropped"] == 0                    # an exact copy, the first stays
    assert by[3]["n_dropped"] in (0, 1) and by[8]["n_lines"] == 1 and by[9]["n_dropped"] == 0
    for r in out:
        lines = (r["text"] or "").split("\n")
        assert r["kept_text"] == "\n".join(x for i, x in enumerate(lines) if i not in set(r["dropped"]))
    assert dedup_lines(docs.limit(0)).count() == 0


def test_line_links_match_brute_force(spark):
    from placerank.llm import line_dedup as ld

    rng = random.Random(9)
    lines = []
    for _ in range(40):
        w = prose(rng, 40).split()
        lines.append(" ".join(w))
        for _ in range(4):
            v = list(w)
            v[rng.randrange(40)] = f"v{rng.randrange(1000)}"
            lines.append(" ".join(v))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    texts = ld.different_lines(ld.word_lines(df)).select("node", "n_words", "t").collect()
    number = {t: i for i, t in enumerate(lines)}
    prints = {r["node"]: r["fp"] for r in got(ld.fingerprints(spark.createDataFrame(texts, "node long, n_words int, t string")))}
    fp = {number[r["t"]]: prints[r["node"]] for r in texts}
    parent = list(range(len(lines)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for i, j in itertools.combinations(range(len(lines)), 2):
        if bin((fp[i] ^ fp[j]) & (2 ** 64 - 1)).count("1") <= 3 and edits(lines[i].split(), lines[j].split()) <= 8:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    assert {r["doc_id"] for r in got(ld.dedup_lines(df)) if r["n_dropped"]} == {i for i in range(len(lines)) if find(i) != i}


def test_line_dedup_recall_by_edit_similarity_alone(spark, tmp_path):
    from placerank.llm.queries import QUERIES

    rng = random.Random(10)
    vocab = [f"w{i}" for i in range(4000)]
    common = [f"c{i}" for i in range(30)]
    lines, near = [], []
    for n in (5, 8, 9, 10, 20, 50, 100):
        for edits in sorted({1, max(1, n // 10), n // 5}):
            for _ in range(12):
                w = [rng.choice(common if rng.random() < 0.4 else vocab) for _ in range(n)]
                v = list(w)
                # words replaced, or some taken out: the longer line has n words, so n // 5 edits are still near
                for i in sorted(rng.sample(range(n), edits), reverse=True):
                    if rng.random() < 0.7:
                        v[i] = f"x{rng.randrange(10 ** 9)}"
                    else:
                        del v[i]
                far = list(w)
                for i in rng.sample(range(n), n // 5 + 1):
                    far[i] = f"y{rng.randrange(10 ** 9)}"
                near.append(len(lines) + 1)
                lines += [" ".join(w), " ".join(v), " ".join(far)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    dropped = {r["doc_id"] for r in got(QUERIES["op10_line_dedup"](spark, str(tmp_path))) if r["n_dropped"]}
    assert dropped == set(near)


def test_long_lines_whose_rare_words_are_replaced_are_near(spark):
    """Of the 21 rarest words of a line only one may be left in the other: all of them are buckets."""
    from placerank.llm.line_dedup import dedup_lines

    rng = random.Random(14)
    common, lines = [f"c{i}" for i in range(600)], []
    for p in range(30):
        w = rng.sample(common, 79) + [f"r{p}n{i}" for i in range(21)]
        rng.shuffle(w)
        gone = {f"r{p}n{i}" for i in range(20)}
        lines += [" ".join(w), " ".join(f"q{x}" if x in gone else x for x in w)]
    lines += [" ".join(rng.sample(common, 80)) for _ in range(60)]
    out = got(dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), max_bits=None))
    assert {r["doc_id"] for r in out if r["n_dropped"]} == set(range(1, 60, 2))


def test_lines_of_the_queries_meet_in_blocks_of_fingerprints_too(spark, monkeypatch):
    """Without any rare words the query's way finds what the blocks of fingerprints find."""
    from placerank.llm import line_dedup as ld

    rng, lines = random.Random(15), []
    for _ in range(40):
        w = prose(rng, 60).split()
        lines.append(" ".join(w))
        for i in rng.sample(range(60), 3):
            lines.append(" ".join([*w[:i], "other", *w[i + 1:]]))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = lambda bits: {tuple(r) for r in ld.duplicate_lines(docs, max_bits=bits).collect()}
    want, whole = gone(ld.MAX_BITS), gone(None)
    real = ld._rare_words
    monkeypatch.setattr(ld, "_rare_words", lambda *a: real(*a).withColumn("buckets", F.array().cast("array<bigint>")))
    assert want and gone(None) == want < whole == {(i, k, 0) for i, k, _ in whole} and len(whole) == 120


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
        empty = stage(spark, docs.limit(0), sf)
        assert empty.count() == 0 and empty.columns == docs.columns
    assert 0 < cp.run(spark, sf).count() < docs.count()


def test_queries_match_their_sql(spark):
    import duckdb

    from placerank.llm.queries import ORACLES, QUERIES
    from tools.check_oracles import norm_frame

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    for name, sql in ORACLES.items():
        assert norm_frame(QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()) == norm_frame(con.execute(sql).df())


def test_entry_lists_queries_without_a_session():
    import subprocess
    import sys

    root = __import__("os").path.dirname(__import__("corpus_pipeline").__file__)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=root,
                         capture_output=True, text=True, timeout=300)
    assert "op10_line_dedup" in out.stdout and "pipeline" in out.stdout, out.stderr[-500:]


def test_links_of_a_large_bucket_are_all_found(spark, monkeypatch):
    """400 members of one bucket, linked in twos that no order shows: pivots join next to nothing."""
    from placerank.llm import linking
    monkeypatch.setattr(linking, "BLOCK", 64)
    members = spark.range(400).select(F.lit(7).cast("long").alias("bucket"), F.col("id").alias("node"), F.xxhash64("id").alias("mark"))
    half = lambda c: F.floor(F.col(c) / 2)
    groups = linking.link(linking.saved(members), lambda a, b: F.lit(True), lambda nodes: nodes.withColumn("t", F.col("node")),
                          lambda pairs: pairs.filter(half("t_a") == half("t_b")).select("a", "b"), lambda mark, bucket: mark)
    got = {(r.node, r.root) for r in groups.collect()}
    assert got == {(i, i // 2 * 2) for i in range(400)}


def test_near_copies_just_under_the_similarity_are_not_compared_pair_by_pair(spark, monkeypatch):
    """300 copies of a text with a word of their own each, most pairs of which lie just under 0.8, and some linked ones."""
    from placerank.llm import linking, near_dedup

    rng = random.Random(9)
    words, texts = prose(rng, 40).split(), []
    for i in range(300):
        w = list(words)
        w[rng.randrange(len(w))] = f"z{i}"
        texts.append(" ".join(w))
    grams = [{tuple(t.split()[i:i + 5]) for i in range(36)} for t in texts]
    root = list(range(300))
    for b in range(300):
        for a in range(b):
            if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    compared = []

    def saved(df, label="step"):
        out = near_dedup.saved(df, label)
        if label == "pairs":
            compared.append(out.count())
        return out

    monkeypatch.setattr(linking, "saved", saved)
    out = got(near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {r["doc_id"]: r["group_id"] for r in out} == dict(enumerate(root))
    assert len(set(root)) > 100 and sum(compared) < 300 * 299 / 2 / 5


def test_alike_pairs_match_brute_force(spark):
    from placerank.llm.near_dedup import alike_pairs

    rng = random.Random(5)
    base = [rng.sample(range(400), rng.randrange(5, 60)) for _ in range(12)]
    data = []
    for node in range(240):
        t = set(base[node % 12])
        for _ in range(rng.randrange(0, 6)):
            t.discard(rng.choice(base[node % 12]))
            t.add(rng.randrange(400))
        data.append((node, node - node % 2 if node % 5 else 1000 + node % 7, sorted(t)))
    want = {(a, b) for a, ra, ta in data for b, rb, tb in data if a < b and ra != rb
            and len(set(ta) & set(tb)) >= 0.8 * len(set(ta) | set(tb))}
    found = {(r.a, r.b) for r in alike_pairs(spark.createDataFrame(data, "node long, root long, t array<long>"), 0.8).collect()}
    different = sum(a < b and ra != rb for a, ra, _ in data for b, rb, _ in data)
    assert want and want <= found and all(a < b for a, b in found) and len(found) < different / 4


def test_line_links_are_found_in_slices_of_the_buckets(spark, monkeypatch):
    """With many buckets only a slice of their members is dealt at a time; the groups stay the same."""
    from placerank.llm import line_dedup, linking

    rng = random.Random(11)
    lines = [prose(rng, rng.choice((6, 12, 30))) for _ in range(60)]
    data = []
    for i in range(80):
        some = [rng.choice(lines).split() for _ in range(4)]
        for w in some[::2]:
            w[rng.randrange(len(w))] = f"z{i}"
        data.append((i, "\n".join(" ".join(w) for w in some)))
    docs, sizes = spark.createDataFrame(data, "doc_id long, text string"), []

    def saved(df, label="step"):
        out = line_dedup.saved(df, label)
        if label in ("buckets", "details"):
            sizes.append((label, out.count()))
        return out

    gone = lambda: {tuple(r) for r in line_dedup.duplicate_lines(docs, max_bits=None).collect()}
    monkeypatch.setattr(linking, "saved", saved)
    want = gone()
    whole = dict(sizes[:1])["buckets"]
    sizes.clear()
    monkeypatch.setattr(linking, "SLICE_ROWS", 100)
    monkeypatch.setattr(linking, "BROADCAST_ROWS", 20)
    assert want and gone() == want
    parts = [n for label, n in sizes if label == "buckets"]
    assert len(parts) > 2 and sum(parts) == whole and max(parts) < whole / 2
    assert sum(label == "details" for label, _ in sizes) > 3


def test_line_sketches_lose_no_pair_and_leave_few_strangers(spark, monkeypatch):
    """Lines near by words pass both sketches, also where buckets are cut into blocks; lines of other words repeated do not."""
    from placerank.llm import line_dedup, linking

    rng = random.Random(12)
    vocab, lines, near = [f"w{i}" for i in range(60)], [], set()
    for n in [8, 20, 40, 70] * 6 + [150] * 24:
        w = [rng.choice(vocab) for _ in range(n)] if n < 150 else rng.sample(vocab, 12) * 13
        v = list(w)
        for i in sorted(rng.sample(range(len(w)), len(w) // 5), reverse=True):
            if rng.random() < 0.6:
                v[i] = f"x{rng.randrange(10 ** 9)}"
            else:
                del v[i]
        near.add(len(lines) + 1)
        lines += [" ".join(w), " ".join(v)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    monkeypatch.setattr(linking, "BLOCK", 4)
    pairs = []

    def saved(df, label="step"):
        out = line_dedup.saved(df, label)
        if label == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(linking, "saved", saved)
    gone = {r["doc_id"] for r in line_dedup.duplicate_lines(docs, max_bits=None).collect()}
    assert gone == near and sum(pairs) < 3 * len(near)


def test_members_of_link_lists_that_met_a_near_one_are_paired_once(spark, monkeypatch):
    """Twelve buckets hold 40 lines of one group and 20 that pass the cheap condition but are linked to none: each such pair once."""
    from placerank.llm import linking

    buckets = list(range(12))
    nodes = spark.createDataFrame([(i, buckets, None) for i in range(60)], "node long, buckets array<long>, extra int")
    joined = []

    def saved(df, label="step"):
        out = linking_saved(df, label)
        if label == "slice-pairs":
            # the pairs as the join makes them, before the same ones of several buckets are put together
            joined.append((made.pop(), out.count()))
        return out

    linking_saved, made, frame = linking.saved, [], type(nodes)
    distinct = frame.distinct

    def counted(df):
        if df.columns == ["a", "b"]:
            made.append(df.count())
        return distinct(df)

    monkeypatch.setattr(linking, "saved", saved)
    monkeypatch.setattr(frame, "distinct", counted)
    groups = linking.link_lists(
        linking_saved(nodes), lambda a, b: F.lit(True), lambda of: of.withColumn("t", F.col("node")),
        lambda pairs: pairs.filter((F.col("t_a") < 40) & (F.col("t_b") < 40)).select("a", "b"), "extra", lambda a, b: F.lit(True))
    got = {(r.node, r.root) for r in groups.collect()}
    assert got == {(i, 0) for i in range(40)}
    rows, pairs = joined[-1]
    assert rows == pairs >= 40 * 20 + 20 * 19 / 2
