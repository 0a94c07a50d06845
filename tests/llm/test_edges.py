"""Edge cases of the text operators: clashing columns, nulls, repeats, long texts; scoring against brute force."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from breakweave.llm import common, mixing, pii, pu_quality, queries, token_files, url_trust

DATA = "/root/testdata/sf0.001"


def test_mixing_keeps_clashing_columns_and_spreads_rows_without_key(spark):
    rows = [(None, f"text {k}", "a", k, "own", 1.5, -1) for k in range(400)] + [(k, None, None, k, "own", 2.5, -1) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_source long, mix_key string, mix_rate double, mix_copy int")
    out = mixing.mix_sources(docs, {"a": 1.0})
    assert out.columns == ["doc_id", "text", "source", "mix_source", "mix_key", "mix_rate", "mix_copy", "mix_order"]
    got = out.collect()
    n = Counter(r["text"] for r in got)
    assert 300 < len(got) < 500 and len(set(n.values())) > 2 and {r["mix_key"] for r in got} == {"own"} and {r["mix_rate"] for r in got} == {1.0}
    assert all(sorted(r["mix_copy"] for r in got if r["text"] == t) == list(range(k)) for t, k in n.items())
    assert sorted(r["mix_order"] for r in got) != [r["mix_order"] for r in got] or len({r["mix_order"] for r in got}) == len(got)


@pytest.mark.parametrize("parts", [1, 5])
def test_token_parts_of_one_hot_id(spark, parts, monkeypatch):
    monkeypatch.setattr(token_files, "PART_BYTES", 2000 if parts > 1 else 1 << 20)
    monkeypatch.setattr(common, "BATCH_ROWS", 16)
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    rows = [(rng.choice([None, 7, 7, 7, k]), "word and " * rng.randint(0, 30) + str(k)) for k in range(300)] + [(3, None), (900, "long text " * 400)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, part string").repartition(3)
    low = lambda k: -1 if k is None else k
    dealt = token_files.dealt_by_id(docs.select("doc_id", "text"), parts).withColumn("range", F.spark_partition_id()).collect()
    spans = defaultdict(list)
    for r in dealt:
        spans[r["range"]].append(low(r["doc_id"]))
    ordered = [spans[k] for k in sorted(spans)]
    assert all(x == sorted(x) for x in ordered) and all(max(a) <= min(b) for a, b in zip(ordered, ordered[1:], strict=False))
    assert sum(7 in ids for ids in ordered) == 1 if parts == 1 else sum(7 in ids for ids in ordered) > 1
    listed = token_files.write_token_files(docs, path, common.shared_dir(spark, "t"), parts=parts).orderBy("part").collect()
    assert len(listed) == 1 if parts == 1 else len(listed) > parts
    at = docs_before = 0
    for r in listed:
        assert (r["base"], r["base_docs"]) == (at, docs_before)
        at, docs_before = at + r["n_tokens"], docs_before + r["n_docs"]
    got = sorted(token_files.token_files(docs, spark, path, parts=parts).collect(), key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [low(r["doc_id"]) for r in got] == sorted(low(k) for k, _ in rows)
    ids = [(k, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for k, t in rows]
    want = Counter((k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in ids)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def plain_totals(texts):
    """Tokens in every pattern, word by word."""
    n = Counter()
    for text in texts:
        w = re.split(r"[ \t\n\x0b\f\r]+", (text or "").strip(" \t\n\x0b\f\r").lower())
        for i in range(len(w)):
            n.update([f"before {w[i]}"] * (i + 1 < len(w)) + [f"after {w[i]}"] * (i > 0))
            if i + 2 < len(w):
                n.update([f"before2 {w[i]} {w[i + 1]}", f"around {w[i]} {w[i + 2]}"])
    return n


def plain_scores(rows, texts, rounds, least, support):
    """Good patterns by dictionaries: the whole graph in every round."""
    edges, times, totals = defaultdict(float), Counter(), plain_totals(texts)
    for r in rows:
        for kind in [r["kind"]] if r["kind"] else r["kinds"]:
            if r["pattern"]:
                key = (r["pattern"], r["token"], kind)
                edges[key] = max(edges[key], float(r["kind"] is not None))
                times[key] += 1
    trust = {(t, k): 1.0 for (_, t, k), seed in edges.items() if seed}
    for _ in range(rounds):
        by, sure = defaultdict(float), Counter()
        for p, t, k in edges:
            by[p, k] += trust.get((t, k), 0.0) * times[p, t, k]
            sure[p, k] += trust.get((t, k), 0.0) >= least
        good = {x: min(v / totals[x[0]], 1.0) for x, v in by.items() if totals[x[0]] and sure[x] >= support and v >= least * totals[x[0]]}
        trust = {(t, k): 1.0 for (_, t, k), seed in edges.items() if seed}
        for p, t, k in edges:
            if (p, k) in good:
                trust[t, k] = max(trust.get((t, k), 0), good[p, k])
    return good


def people(rng, n):
    """Texts with marked identifiers, some of forms that no fixed pattern knows, and where those are."""
    words = "the sea was calm and grey when they came home to rest at night".split()
    rows, hidden = [], {}
    for k in range(n):
        left, right = (" ".join(rng.choice(words) for _ in range(rng.randint(3, 9))) for _ in range(2))
        kind = k % 4
        if kind == 0:
            what, before = (f"{rng.randint(100, 999)}-{rng.randint(1000, 9999)}-{rng.randint(10, 99)}" if k % 3 == 0 else f"+49 ({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}"), "my phone:"
        elif kind == 1:
            what, before = (f"user{k}[at]host{k % 7}" if k % 3 == 0 else f"user{k}@mail{k % 5}.example.org"), "please contact"
        elif kind == 2:
            what, before = ("".join(rng.choice("0123456789abcdef") for _ in range(24 if k % 3 == 0 else 40)) + "a1"), "token ="
        else:
            what, before = str(rng.randint(1, 99999)), rng.choice(["page", "chapter", "room"])
        text = f"{left} {before} {what} {right}"
        rows.append((k, text))
        if kind < 3 and k % 3 == 0:
            at = text.index(what)
            hidden[k] = f"{['phone', 'email', 'secret'][kind]}:{at}:{at + len(what)}"
    return rows, hidden


def test_bootstrapping_finds_marked_identifiers(spark):
    rows, hidden = people(random.Random(5), 480)
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, pattern int")
    got = {r["doc_id"]: r for r in pii.find_private(docs).collect()}
    assert sum(v in got[k]["spans"].split(",") for k, v in hidden.items()) >= 0.9 * len(hidden)
    assert not any(got[k]["n_found"] for k in range(3, 480, 4))
    base = {r["doc_id"]: r["base_sha256"] for r in pii.find_private(docs, rounds=1, support=10**6).collect()}
    assert {k: r["base_sha256"] for k, r in got.items()} == base


def test_instances_of_one_round_found_patterns_of_the_next(spark):
    rows = [(k, f"phone: +49 ({100 + k}) 555-{1000 + k} x") for k in range(5)]
    rows += [(100 + k, f"phone: 030-{12345 + k} x") for k in range(4)]  # found by 'phone:' in the first round
    rows += [(200 + k, f"or dial 030-{12345 + k} today") for k in range(4)] + [(300, "or dial 040-777777 today")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r["doc_id"]: r["n_found"] for r in pii.find_private(docs, rounds=1, least=0.5).collect()}
    more = {r["doc_id"]: r["n_found"] for r in pii.find_private(docs, rounds=3, least=0.5).collect()}
    assert one[100] == 1 and one[300] == 0 and more[300] == 1


@pytest.mark.parametrize("rounds", [1, 3])
def test_pattern_scores_against_brute_force(spark, rounds):
    rows, _ = people(random.Random(6), 240)
    rng = random.Random(7)
    rows += [(1000 + k, rng.choice(["phone:", "dial", "contact"]) + f" {rng.choice(['030-12345', '040-7654321', 'a1@b.c', 'x[at]y9', '12345678'])} " + rng.choice(["now", "x"])) for k in range(60)]
    rows += [(None, "phone: 030-12345"), (1, None), (2, ""), (5000, "dial 030-99999 " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = pii.occurrences(pii.scanned(docs))
    good = {(r["pattern"], r["kind"]): round(r["score"], 12) for r in pii.good_patterns(seen, docs, rounds, 0.6, 3).collect()}
    assert good == {k: round(v, 12) for k, v in plain_scores(seen.collect(), [t for _, t in rows], rounds, 0.6, 3).items()}
    assert good


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def plain_private(rows, share=0.8, rounds=3, least=0.4, support=3):
    """All spans of (id, text) by loops and dictionaries; ids are unique, texts hold plain spaces."""
    seen, spans, places = [], {}, []
    for k, text in rows:
        base = [(n, m.start(), m.end(), kind, m[0]) for n, (kind, p, ok) in enumerate(BASE) for m in re.finditer(p, text) if ok(m[0])]
        spans[k] = [x[:3] for x in base]
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\S+", text)]
        for i, (a, b, w) in enumerate(words):
            if not re.search("[0-9@]", w):
                continue
            hit = next((x for x in base if x[1] < b and x[2] > a), None)
            head = len(re.match(r"[^a-zA-Z0-9+(@]*", w)[0])
            bare = re.sub(r"^[^a-zA-Z0-9+(@]+|[^a-zA-Z0-9)]+$", "", w)
            own = "secret" if re.search(pii.SEED_SECRET, bare) and zlib.crc32(bare.lower().encode()) % 1000 < 1000 * share else None
            kind = hit[3] if hit else own
            n, letters, marked = len(re.sub("[^0-9]", "", bare)), len(re.sub("[^a-zA-Z]", "", bare)), bool(re.search(r"@|\[at\]|\(at\)", bare))
            may = [] if kind else [x for x, test in [("email", marked and letters), ("ip", not letters and re.search(r"^[0-9]+([.:,][0-9]+){3,}$", bare)), ("card", not letters and 12 <= n <= 19),
                ("phone", not letters and 6 <= n <= 15 and not re.search(r"^[0-9]+(\.[0-9]+){3}$", bare)), ("secret", not marked and letters and n and len(bare) >= 12)] if test]
            low = lambda j: words[j][2].lower()
            first, last = not hit or a <= hit[1], not hit or b >= hit[2]
            before, after = first and i > 0, last and i + 1 < len(words)
            patterns = [f"before {low(i - 1)}"] * before + [f"before2 {low(i - 2)} {low(i - 1)}"] * (before and i > 1) + [f"after {low(i + 1)}"] * after + [f"around {low(i - 1)} {low(i + 1)}"] * (before and after) if before or after else []
            for pattern in patterns:
                seen.append({"pattern": pattern, "token": (hit[4] if hit else bare).lower(), "kind": kind, "kinds": may})
                if not hit:
                    places.append((k, a + head, a + head + len(bare), pattern, [kind] if kind else may))
    good = plain_scores(seen, [t for _, t in rows], rounds, least, support)
    best = {}
    for k, a, b, pattern, may in places:
        for kind in may:
            if (pattern, kind) in good:
                score = (good[pattern, kind], -pii.FOUND_KINDS.index(kind))
                best[k, a, b] = max(best.get((k, a, b), score), score)
    for (k, a, b), (_, n) in best.items():
        spans[k].append((-n, a, b))
    return {k: ",".join(f"{pii.FOUND_KINDS[n]}:{a}:{b}" for n, a, b in sorted(x)) for k, x in spans.items()}


def noise(rng, n):
    """Numbers of card length, right and wrong ones, and addresses after words that stand before everything."""
    rows = []
    for k in range(n):
        number = "".join(rng.choice("0123456789") for _ in range(16))
        what = rng.choice([number, "4111111111111111", f"10.0.0.{k}", f"u{k}@x.org", str(k)])
        rows.append((10_000 + k, f"in {rng.choice(['the', 'of', 'and'])} {what} and the sea of the night and of the day"))
    return rows


def test_spans_against_a_plain_program(spark):
    rows, hidden = people(random.Random(8), 480)
    rows += noise(random.Random(9), 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["spans"] for r in pii.find_private(docs).collect()}
    assert got == plain_private(rows)
    assert sum(v in got[k].split(",") for k, v in hidden.items()) >= 0.9 * len(hidden)
    fixed = plain_private(rows, support=10**9)
    assert all(got[k] == fixed[k] for k in range(10_000, 10_200))  # nothing is found after `the`, `of`, `and`


def test_keys_that_are_no_seeds_are_found_by_their_contexts(spark):
    rng = random.Random(10)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) + "a1" for _ in range(200)]
    rows = [(k, f"and so the {rng.choice(['token =', 'api key', 'secret:'])} {x} of the night") for k, x in enumerate(keys)] + noise(rng, 300)
    got = {r["doc_id"]: r["spans"] for r in pii.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    withheld = [k for k, x in enumerate(keys) if zlib.crc32(x.encode()) % 1000 >= 800]
    assert len(withheld) > 25 and sum("secret:" in got[k] for k in withheld) >= 0.9 * len(withheld)


def test_quality_of_many_parts_and_few_labels(spark, monkeypatch):
    monkeypatch.setattr(pu_quality, "PART_ROWS", 100)
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("calm sea wind hill boat".split()) for _ in range(40)) if k % 5 else "$$ ## !! " * 30, k) for k in range(900)] + [(None, None, 0), (None, "", 0), (900, "word " * 50_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, f long").repartition(4)
    marks = spark.createDataFrame([(k, int(k % 5 > 0)) for k in range(0, 900, 3)] + [(None, 1), (7, None), (5000, 1)], "doc_id long, quality int")
    got = pu_quality.score_quality(docs, marks).collect()
    assert len(got) == len(rows)
    ruled = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 5 > 0) for r in ruled]) > 0.95
    kept = pu_quality.keep_good(docs, marks)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["predicted"] == 1}
    one = pu_quality.score_quality(docs, spark.createDataFrame([(k, 1) for k in range(1, 9) if k != 5], "doc_id long, quality int")).collect()
    assert len({r["score"] for r in one}) > 1


def test_ranks_against_numpy(spark):
    rng = np.random.default_rng(3)
    hosts = [f"h{k}" for k in range(40)]
    w = np.where(rng.random((40, 40)) < 0.08, rng.integers(1, 9, (40, 40)), 0).astype(float)
    w[:, 0] += 5  # a hub
    w[[3, 4, 5]] = 0  # dangling hosts
    np.fill_diagonal(w, 0)
    edges = spark.createDataFrame([(hosts[i], hosts[j], float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)], "src string, dst string, w double")
    common.ensure_checkpoint_dir(spark)
    for seeds in ({0: 0.5, 7: 0.5}, {3: 1.0}, {}):
        start = np.zeros(40)
        start[list(seeds)] = list(seeds.values())
        p = np.divide(w, w.sum(1, keepdims=True), out=np.zeros_like(w), where=w.sum(1, keepdims=True) > 0)
        rank = start
        for _ in range(10):
            moved = 0.85 * rank @ p
            rank = moved + (1 - moved.sum()) * start
        frame = spark.createDataFrame([(hosts[k], v) for k, v in seeds.items()], "host string, rank double")
        got = {r["host"]: r["rank"] for r in url_trust.propagate(url_trust.normalised(edges), frame, 10, 0.85).collect()}
        assert all(abs(got.get(h, 0) - r) < 1e-9 for h, r in zip(hosts, rank, strict=True))


def test_hot_join_by_salt(spark):
    left = spark.range(1000).select((F.col("id") % 3).alias("k"), "id").repartition(5)
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    for how in ("inner", "left"):
        a, b = (sorted(map(str, common.hot_join(left, right, ["k"], how, limit=n).collect())) for n in (0, 10))
        assert a == b and len(a) == (1000 if how == "left" else 667)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_text_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    frames = queries.queries()[name](spark, DATA).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    a, b = (sorted(tuple("~" if v is None or v != v else str(v) for v in r) for r in f[sorted(f.columns)].itertuples(index=False)) for f in frames)
    assert a == b
