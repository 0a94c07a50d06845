"""The text operators against brute force on small tables with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from breakweave.llm import components, decontaminate, media_chunks, mixing, pii, pu_quality, simhash, suffix_dedup, token_count, token_files, url_trust

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to blend there ing Erth éaux straße 12 3.5 x@y.org 10.0.0.1".split()


def texts(seed=5, n=60):
    rng = random.Random(seed)
    out = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 80))) for _ in range(n)]
    out += [out[3], out[3] + " end", None, "", " \n\t", "x" * 3000, "é" * 700, "<|endoftext|> a  b\n\n c<|endoftext|>", "a\tb \n c", "İΣς. fi ffi"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"src{k % 3}" if k % 5 else None, 0) for k, t in enumerate(texts())]
    rows += [(None, "no id here", "en", "src1", 0), rows[3]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(frame):
    return {None if pd.isna(r.doc_id) else int(r.doc_id): r for r in frame.toPandas().itertuples()}


def pairs(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def test_token_counts(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = by_id(token_count.token_counts(docs, path, limit=50))
    for k, t in pairs(docs):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len(t.encode()), n > 50)
    assert token_count.token_counts(empty, path).count() == 0


def test_media_round_trip(spark, docs, empty):
    rows = media_chunks.media_columns(docs, spark)
    assert rows.count() == docs.count()
    got = by_id(rows)
    for k, t in pairs(docs):
        raw = t.encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert got[k].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert got[k].tail_crc32 == zlib.crc32(payload[-32:])
        assert (got[k].n_bytes, got[k].payload_bytes, got[k].media_bytes) == (len(raw), len(payload), len(payload) + 44)
    assert media_chunks.media_columns(empty, spark).count() == 0


def test_chunks_follow_the_content():
    data = np.random.default_rng(0).integers(0, 256, 200_000, np.uint8).tobytes()
    table = media_chunks.gear_table()
    h = 0
    slow = []
    for b in data[:5000]:
        h = (h << 1) + int(table[b]) & 0xFFFFFFFF
        slow.append(h)
    assert media_chunks.gear(np.frombuffer(data[:5000], np.uint8), table)[40:].tolist() == slow[40:]

    def chunks(d):
        ends = media_chunks.cuts(d, table)
        assert ends[-1] == len(d) and all(b - a <= media_chunks.LONGEST for a, b in zip([0, *ends], ends, strict=False))
        return {d[a:b] for a, b in zip([0, *ends], ends, strict=False)}

    a, b = chunks(data), chunks(b"in front" + data)
    assert len(a & b) > 0.9 * len(a)


def test_token_files(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = token_files.token_files(docs, spark, path, parts=3)
    got = sorted((tuple(r) for r in rows.collect()), key=lambda r: r[1])
    want, at = [], 0
    for k, t in sorted(pairs(docs), key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert token_files.token_files(empty, spark, path).count() == 0


def test_words_apart_are_the_text_encoded_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), token_files.Encoder(path, "<u2")
    rng = random.Random(2)
    letters = [*"abcABC éÉßñΣσςİı.,!%'’s tdm\n\t ́\x1c 12٣ﬁ中ไ😀", "<|endoftext|>", "'s", "Σ.", "É"]
    for _ in range(1500):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(own.ids([t], 2)[0], "<u2").tolist() == [*library.encode(t, add_special_tokens=False).ids, 2]


def test_mixing_reaches_its_weights(spark, docs, empty):
    many = spark.range(6000).select("id", F.lit("word").alias("text"), F.when(F.col("id") % 3 == 0, "small").otherwise("large").alias("source")).withColumnRenamed("id", "doc_id")
    out = mixing.mix_sources(many, {"small": 0.5, "large": 0.5})
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["small"] - 3000) < 250 and abs(n["large"] - 3000) < 250
    assert out.count() == out.select("doc_id", "mix_copy").distinct().count()
    assert mixing.mix_sources(docs).columns[:5] == docs.columns
    assert mixing.mix_sources(empty).count() == 0


def test_poisson_inversion(spark):
    from math import exp, factorial

    rows = spark.createDataFrame([(u, m) for m in (0.1, 1.0, 7.5, 16.0) for u in (0.0, 0.3, 0.9, 0.999999)], "u double, m double")
    for r in rows.withColumn("k", mixing.poisson_count(F.col("u"), mixing.distribution(F.col("m")))).collect():
        total, k = exp(-r["m"]), 0
        while total <= r["u"]:
            k += 1
            total += exp(-r["m"]) * r["m"] ** k / factorial(k)
        assert r["k"] == k


def plain_fingerprint(t, n=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [4096, 2])
def test_simhash(spark, empty, bucket):
    rng = random.Random(1)
    base = [[rng.choice(WORDS) + str(rng.randint(0, 50)) for _ in range(60)] for _ in range(10)]
    rows = []
    for k in range(80):
        w = list(base[k % 10])
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(60)] = "other"
        rows.append((k, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "one")]
    got = by_id(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bucket=bucket))
    fps = [plain_fingerprint(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    for n, (k, _) in enumerate(rows):
        assert got[k].fingerprint == f"{fps[n]:016x}"
        assert got[k].component_id == rows[top(n)][0]
    assert simhash.near_duplicates(empty).count() == 0


def test_masks_cover_every_difference():
    masks = simhash.covering_masks(4)
    rng = random.Random(0)
    for _ in range(3000):
        diff = sum(1 << i for i in rng.sample(range(64), 4))
        assert any(not diff & m for m in masks)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 100), (None, 1)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == dict.fromkeys(range(61), 0)


def test_template_leaks(spark, empty):
    item = "And then Alice walks 12.5 kg and Alice pays 3 dollars for it all day long."
    rows = [
        (1, "we know " + item),
        (2, "we know Then Bob walks 7 kg and Bob pays 9 dollars for it all day long"),
        (3, "we know Then Bob walks 7 kg and Carl pays 9 euros to it all the day long"),
        (4, None),
        (5, ""),
        (None, item),
        (6, "nothing of the kind " * 40),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, None), (None, "x")], "item_id long, text string")
    got = {r["doc_id"]: r["kind"] for r in decontaminate.template_leaks(docs, bench).collect()}
    assert got == {1: "verbatim", 2: "reparameterised"}
    assert decontaminate.template_leaks(empty, bench).count() == 0
    assert decontaminate.template_leaks(docs, bench.where("false")).count() == 0


def test_quality_learns_from_positives_alone(spark, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(900):
        good = k % 4 != 0
        t = " ".join(rng.choice(WORDS) for _ in range(60)) if good else "!! ".join(rng.choice(WORDS).upper() for _ in range(60))
        rows.append((k, t))
        if k % 2 == 0:
            labels.append((k, int(good), 0))
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = by_id(pu_quality.score_quality(docs, marks))
    held = [k for k in range(900) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k].held_out == (k in set(held)) for k in range(900))
    assert np.mean([got[k].predicted == int(k % 4 != 0) for k in held]) > 0.95
    assert 0 <= got[None].score <= 1
    assert pu_quality.score_quality(empty, marks).count() == 0
    assert pu_quality.keep_good(docs, marks.where("false")).count() == docs.count()


def test_private_spans(spark, docs, empty):
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    odd = "a@b.c_d@e.f x@y.z.. 1.2.3.4.5.6.7.8 999.1.2.3 001.2.3.004 +1 (555) 123-4567 +123456789 4111 1111 1111 1111 4111-1111-1111-1111 5 é😀 4111111111111111,a@b.co @x.y +1--2 +12"
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000, odd), (1001, "1" * 5000 + " " + "a" * 5000 + "@")], "doc_id long, text string"))
    got = by_id(pii.find_private(more))
    for k, t in pairs(more):
        spans = [[f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(p, t) if ok(m[0])] for kind, p, ok in kinds]
        assert [got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone] == list(map(len, spans))
        assert got[k].base_sha256 == hashlib.sha256(",".join(sum(spans, [])).encode()).hexdigest()
        assert set(sum(spans, [])) <= set(got[k].spans.split(","))
    assert pii.find_private(empty).count() == 0


def test_contexts_discover_what_patterns_miss(spark):
    rows = [(k, f"please write to host 10.0.0.{k} now") for k in range(9)] + [(50, "please write to host 10.0.0.999 now")]
    got = by_id(pii.find_private(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[50].n_ip == 0 and got[50].spans == "ip:21:31"


def test_repeats(spark, empty):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd é") for _ in range(900)) for _ in range(4)]
    rows = []
    for k in range(60):
        t = ""
        for _ in range(rng.randint(0, 4)):
            s = rng.choice(base)
            a = rng.randint(0, 700)
            t += s[a : a + rng.randint(20, 260)]
        rows.append((k, t))
    rows += [(100, rows[7][1]), (101, "é" * 300), (102, "x" * 99), (103, "x" * 100), (104, "x" * 250), (105, None), (106, ""), (None, base[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen, want = set(), {}
    for k, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        d = (t or "").encode()
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - 99):
            w = d[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        want[k] = (len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    for options in ({}, {"hot": 3, "bucket_segments": 40}):
        got = by_id(suffix_dedup.remove_repeats(docs, **options))
        assert {k: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for k, r in got.items()} == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_levels_grow_geometrically():
    family = suffix_dedup.SuffixFamily()
    rng = np.random.default_rng(0)
    for k in range(1, 65):
        windows = rng.integers(97, 123, (50, 100), np.uint8).view("S100").ravel()
        assert not family.add(windows).any()
        assert family.add(windows).all()
        assert len(family.levels) <= k.bit_length() and all((level[1:] > level[:-1]).all() for level in family.levels)


def test_pages(spark):
    link = '<a href="https://{}/x">l</a>'
    rows = [
        (1, "http://A.example.org/en/15?x", ""),
        (2, "https://sub.example.org/fr/1", link.format("good.net")),
        (3, "http://x.com/de/1", ""),
        (4, "http://x.com/de/2#y", ""),
        (5, "http://good.net/a", ""),
        (6, "http://bad.net/a", link.format("x.com")),
        (7, None, None),
        (8, "no scheme", ""),
        (9, "http://lone.net", ""),
        (9, "http://lone.net", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/en/1", "block"), ("com", "/de/", "block")], "rule_host string, rule_path string, rule_verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_trust.judge_pages(pages, rules).collect()}
    assert got[1] == ("a.example.org", "/en/15", "example.org/en/1", "block")
    assert got[2] == ("sub.example.org", "/fr/1", "org/", "allow")
    assert got[3] == ("x.com", "/de/1", "com/de/", "block")
    assert got[5] == ("good.net", "/a", None, "allow")
    assert got[6] == ("bad.net", "/a", None, "block")  # it links to a blocked host
    assert got[7] == got[8] == ("", "", None, "allow")
    assert url_trust.judge_pages(pages.where("false"), rules).count() == 0
