"""Merkle manifest, top-k search and prefix trie against plain programs and their SQL, on small tables with odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from breakweave.llm import merkle, prefix_trie, queries, ranking, top_k

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, level int, digest string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def write(frame, path):
    frame.write.parquet(str(path))
    return str(path.parent)


# Merkle manifest


def document_rows():
    rng = random.Random(3)
    rows = [(k, f"text {k}\n" * rng.randint(0, 3), "en", rng.choice(["a", "a", "a", "b", "é", None]), k) for k in range(150)]
    rows += [(200, None, None, None, None), (None, "no id\n", "en", "a", 1), (7, "again", None, "a", 3), (7, "again", None, "a", 3), (201, "", "", "", 0), (202, "x" * 300_000 + "\n", "en", "only", 9)]
    return rows


def merkle_by_hand(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of all rows, as the contract words it."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha(*map(field, (r[0], r[3], r[2], r[4], text)))

    def tree(leaves):
        """Root, and the runs above each leaf."""
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
        return levels

    def above(levels, at):
        for level in levels[:-1]:
            first = at // 3 * 3
            run = level[first : first + 3]
            yield run[: at - first], run[at - first + 1 :]
            at //= 3

    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for at, (_, _, own, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            acc, proof = leaf(r, r[1].replace("\n", "")) if changed else own, ""
            for left, right in [*above(trees[s], at), *above(top, place)]:
                acc, proof = sha(*left, acc, *right), proof + "".join(left + right)
            out.append((r[0], own, trees[s][-1][0], top[-1][0], sha(proof), acc, acc == top[-1][0]))
    return out


def test_merkle_against_a_plain_program(spark, tmp_path):
    rows = document_rows()
    docs = spark.createDataFrame([(*r, "own", -1, "own") for r in rows], DOCS).repartition(5)
    folder = write(docs, tmp_path / "documents.parquet")
    got = queries.op11_merkle_manifest(spark, folder)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(merkle_by_hand(rows), key=key)
    assert 0 < sum(not r["verified"] for r in got.collect()) < len(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 28])
def test_merkle_of_few_rows(spark, tmp_path, n):
    rows = [(k, f"t{k}\n", "en", "s", k) for k in range(n)]
    folder = write(spark.createDataFrame([(*r, "own", -1, "own") for r in rows], DOCS), tmp_path / "documents.parquet")
    got = queries.op11_merkle_manifest(spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(merkle_by_hand(rows))


def test_nodes_cover_nested_intervals(spark):
    docs = spark.createDataFrame([(k, "g" if k % 4 else None) for k in range(100)], "doc_id long, source string")
    built = merkle.manifest(docs, F.col("source"), F.col("doc_id"), merkle.leaf_digest(F.col("doc_id")), {})
    nodes = [tuple(r) for r in built.groups.nodes().select("tree", "level", "lo", "hi").collect()]
    for group, n in (("=g", 75), ("-", 25)):
        levels = defaultdict(list)
        for tree, level, lo, hi in nodes:
            if tree == group:
                levels[level].append((lo, hi))
        assert all(sorted(x)[0][0] == 0 and sorted(x)[-1][1] == n and all(a[1] == b[0] for a, b in zip(sorted(x), sorted(x)[1:], strict=False)) for x in levels.values())
        assert len(levels[max(levels)]) == 1


def test_ranks_of_repeated_and_null_orders(spark):
    rows = [("a", None), ("a", 1), ("a", 1), ("a", 1), ("b", 5)] + [("hot", k % 3) for k in range(200)]
    got = ranking.ranked(spark.createDataFrame(rows, "g string, o long").repartition(7), "g", ["o"], "t").collect()
    for g, n in (("a", 4), ("b", 1), ("hot", 200)):
        own = sorted((r["rank"], -1 if r["o"] is None else r["o"]) for r in got if r["g"] == g)
        assert [k for k, _ in own] == list(range(n)) and [o for _, o in own] == sorted(o for _, o in own)
        assert {r["total"] for r in got if r["g"] == g} == {n}


# Top-k search


def top_by_hand(rows, k=5):
    rows = {(i, tuple(int(np.floor(256 * np.float64(np.float32(x)))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, v in rows:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in rows if j != i and len(w) == len(v))[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


def vector_rows(seed=1, n=400, dims=6):
    rng = random.Random(seed)
    rows = [(k, [rng.gauss(0, 1) for _ in range(dims)]) for k in range(n)]
    hot = [0.5] * dims
    rows += [(1000 + k, hot) for k in range(300)] + [(5000, [0.0] * dims), (5050, hot), (5050, hot), rows[3]]
    rows += [(6000, None), (6050, [None] * dims), (6100, [float("nan")] * dims), (6150, [float("inf")] + [0.0] * (dims - 1)), (None, hot), (7000, [1.0]), (7001, [2.0]), (7050, []), (7051, [])]
    return rows


@pytest.mark.parametrize("block,chunk,wide", [(4096, 512, True), (16, 4, True), (16, 4, False), (1, 1, False)])
def test_top_k_against_brute_force(spark, tmp_path, monkeypatch, block, chunk, wide):
    monkeypatch.setattr(top_k, "BLOCK_ROWS", block if block > 1 else 60)
    monkeypatch.setattr(top_k, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(top_k, "BROADCAST_BYTES", 1 << 23 if wide else 0)
    rows = vector_rows()
    folder = write(spark.createDataFrame([(*r, 1, "own") for r in rows], "vec_id long, embedding array<float>, label int, rank string").repartition(4), tmp_path / "embeddings.parquet")
    got = queries.op12_top_k(spark, folder)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == top_by_hand(rows)


def test_top_k_of_few_rows(spark):
    schema = "vec_id long, embedding array<double>"
    assert not top_k.top_k(spark.createDataFrame([], schema), F.lit(True)).collect()
    two = top_k.top_k(spark.createDataFrame([(0, [1.0, -1.0]), (50, [3.0, 0.5])], schema), F.col("vec_id") % 50 == 0, scale=10)
    assert sorted(map(tuple, two.collect())) == [(0, 1, 50, 250), (50, 1, 0, 250)]


@pytest.mark.parametrize("scale", [1, 1000, 10**7, 10**9])
def test_the_walk_stops_early_and_loses_nothing(scale):
    """Exact in all number types; on vectors with one strong component the walk meets a small part."""
    rng = np.random.default_rng(0)
    vectors = (rng.exponential(1, (500, 3)) * [1, 50, 1] * scale).astype("<i8") + 1
    places = np.argsort(vectors, axis=0, kind="stable")
    query = np.array([1, 40, -1]) * max(scale // 10, 1)
    kind = top_k.exact_type(vectors, query[None])
    lists = top_k.Lists(vectors.astype(kind), places)
    at, scores = lists.walk(query.astype(kind), 6, -np.inf)
    want = sorted((sum(int(a) * int(b) for a, b in zip(v, query, strict=True)) for v in vectors), reverse=True)[:6]
    assert sorted(map(int, scores), reverse=True)[:6] == want and len(at) < 100


# Prefix trie


def talk_rows(seed=2):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 60), *range(100, 140), *range(-5, 0), 1000, 1001, 1205]:
        for turn in range(rng.randint(1, 8)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["hi", "é é", "", None, "long " * 40])))
    rows += [(2000 + k, t, "user", f"same {t}") for k in range(100) for t in range(3)]  # exact copies
    rows += [(3000, t, "user", f"turn {t % 7}") for t in range(300)] + [(3001, t, "user", f"turn {t % 7}") for t in range(200)]  # over several segments
    rows += [(4000, None, "user", "first"), (4000, 1, "user", "b"), (4000, 1, "user", "a"), (4000, 1, "user", "a"), (None, 0, "user", "no conversation")]
    return rows


def trie_by_hand(rows):
    digest = lambda r, t: hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{t or ''}".encode()).hexdigest()
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role, text), len(text or "")))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + (len(members[node]) - 1) * (node[-1][1] if node else 0)
    return sorted(
        (m[0], len(n), -1 if not n else members[n[:-1]][0], len(m), len(kids[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n, m in members.items()
    )


@pytest.mark.parametrize("segment,shard,piece", [(64, 8192, 4096), (3, 20, 7), (2, 1, 1)])
def test_trie_against_a_plain_program(spark, tmp_path, monkeypatch, segment, shard, piece):
    if shard == 1:
        monkeypatch.setattr(prefix_trie, "SHARD_ITEMS", 40)
    else:
        monkeypatch.setattr(prefix_trie, "SHARD_ITEMS", shard)
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows = talk_rows()
    if segment == 2:
        rows = [r for r in rows if r[0] is None or r[0] < 3000]
    folder = write(spark.createDataFrame([(*r, 5, "own") for r in rows], "conv_id long, turn long, role string, text string, depth int, node string").repartition(6), tmp_path / "conversations.parquet")
    got = queries.op13_prefix_trie(spark, folder)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got.columns == names
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got.collect()) == trie_by_hand(rows)


def test_trie_of_nothing(spark, tmp_path):
    folder = write(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), tmp_path / "conversations.parquet")
    assert queries.op13_prefix_trie(spark, folder).collect() == []


def test_medians_come_first():
    for n in (0, 1, 2, 7, 20):
        order = list(prefix_trie.medians_first(n))
        assert sorted(order) == list(range(n)) and order[:1] == [n // 2][: n > 0]


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_top_k", "op13_prefix_trie"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    frame = queries.queries()[name](spark, DATA)
    names = sorted(frame.columns)
    cursor = con.execute(queries.oracle_sql()[name])
    place = [[c[0] for c in cursor.description].index(n) for n in names]
    assert sorted(str(tuple(r)) for r in frame.select(*names).collect()) == sorted(str(tuple(r[k] for k in place)) for r in cursor.fetchall())
