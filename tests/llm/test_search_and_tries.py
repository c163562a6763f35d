"""Operators 11 to 13 against brute force on small tables with nulls, ties, repeated rows, hot groups and clashing columns."""

import hashlib
import heapq
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import one_bit, prefix_trie, queries, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_neighbours(rows, every, k):
    own = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            own[i] = min(own.get(i, v), v)
    out = []
    for q, a in own.items():
        if q % every == 0:
            found = []
            for c, b in own.items():
                if c != q:
                    n = max(len(a), len(b))
                    total = 0.0
                    for x, y in zip(b + [0.0] * (n - len(b)), a + [0.0] * (n - len(a)), strict=True):
                        total += (x - y) * (x - y)
                    found.append((math.sqrt(total), c))
            out += [(q, r, c, s) for r, (s, c) in enumerate(heapq.nsmallest(k, found), 1)]
    return sorted(out)


def vectors(count, dim, seed):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(5, dim))
    return [(i, (centres[i % 5] + rnd.normal(size=dim) * 0.4).tolist()) for i in range(count)]


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 40, "GROUP": 3, "FIRST": 1, "SAMPLE": 60}])
def test_neighbours_against_brute_force(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(one_bit, name, value)
    rows = vectors(400, 12, 3)
    hot = rows[7][1]
    rows += [(1000 + i, hot) for i in range(150)]  # a group of equal vectors, queries among them
    rows += [(5000, None), (5001, [0.0] * 12), (5002, [float("nan")] * 12), (5003, [None, 1.0]), (None, hot), (5010, [0.3, -1.0]), (5020, [])]
    rows += [rows[3], (3, [9.0] * 12)]  # a repeated row, and an id with a second vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"row": F.lit(1), "v": F.lit("x"), "query": F.lit(2)})
    got = sorted(map(tuple, one_bit.neighbours(df, F.col("vec_id") % 10 == 0, 4).collect()))
    want = brute_neighbours(rows, 10, 4)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    recall = len({(x[0], x[2]) for x in got} & {(x[0], x[2]) for x in want}) / len(want)
    assert recall >= 0.999 and (recall < 1 or got == want)


def test_neighbours_of_few_and_none(spark):
    df = spark.createDataFrame([(10, [1.0, 0.0]), (20, [0.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in one_bit.neighbours(df, F.col("vec_id") == 10, 5).collect()] == [(10, 1, 20, math.sqrt(5))]
    assert one_bit.neighbours(df.limit(1), F.lit(True), 5).count() == 0 and one_bit.neighbours(df.limit(0), F.lit(True), 5).count() == 0


def test_estimates_hold_their_bound():
    rnd = np.random.default_rng(5)
    for dim in (3, 64, 300):
        x, q = rnd.normal(size=(800, dim)), rnd.normal(size=(50, dim))
        centroids, turn = rnd.normal(size=(1, dim)) * 0.3, one_bit.rotation(dim)
        assert np.allclose(turn.T @ turn, np.eye(dim))
        _, codes, length, along, shift = one_bit.encoded(x, centroids, turn)
        assert codes.shape[1] * 8 >= max(one_bit.BITS, dim)
        squared, least = one_bit.estimates(q, centroids[0], turn, one_bit.signs_of(codes), length, along, shift)
        true = ((q[:, None] - x) ** 2).sum(-1)
        assert (least > true).mean() < 2e-4 and abs((squared - true).mean()) < 0.02 * true.mean()


def brute_ranked(docs, items, k):
    docs = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    docs = [d for d in docs if d[1]]
    count, total = len(docs), sum(len(w) for _, w in docs)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1))) for t in terms if (df := sum(t in w for _, w in docs))}
        found = []
        for i, words in docs:
            m = 10 + 90 * len(words) * count // total
            score = sum(w * (1_000_000_000 * tf // (1000 * tf + 8 * m)) for t, w in weight.items() if (tf := words.count(t)))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(heapq.nsmallest(k, found), 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"WINDOW": 64, "TERMS": 7, "PARTS": 3}])
def test_ranked_against_brute_force(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(ranked_search, name, value)
    rnd = random.Random(2)
    words = ["Sea", "sea", "é", "Éa", "x1", "10", "你好", "tide", "a", "b", "c"]
    docs = [(rnd.choice([i, i * 1000, -i, None]), rnd.choice([None, "", " ".join(rnd.choices(words, k=rnd.randint(1, 30))), "--"])) for i in range(300)]
    docs += [(77, "tide sea")] * 120 + [(9, "sea " * 50_000)]
    items = [(1, "SEA, tide!"), (2, "sea"), (2, "é x1"), (3, None), (4, "--"), (None, "a b c"), (5, "unheard"), (1, "SEA, tide!"), (6, "你好 10-éa")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("n"), "window": F.lit(1), "places": F.lit(2)})
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("t"))
    assert sorted(map(tuple, ranked_search.ranked(d, q, 5).collect()), key=str) == brute_ranked(docs, items, 5)
    assert ranked_search.ranked(d.limit(0), q).count() == 0 and ranked_search.ranked(d, q.limit(0)).count() == 0


def md5(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute_trie(rows):
    own, made, nodes, kids, leaves, saved = {}, {}, {}, {}, {}, {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, md5(r or "", x or ""), (r or "", x or "")))
    own = {c: [x[-1] for x in sorted(turns)] for c, turns in own.items()}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    for c, s in made.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    for n in nodes:
        if n:
            kids.setdefault(n[:-1], []).append(n)
    for n in sorted(nodes, key=len, reverse=True):
        leaves[n] = sum(leaves[x] for x in kids.get(n, [])) or 1
        saved[n] = sum(saved[x] for x in kids.get(n, [])) + ((len(nodes[n]) - 1) * len(n[-1][1]) if n else 0)
    ends = lambda n: hashlib.sha256(",".join(str(c) for c in sorted(nodes[n]) if made[c] == n).encode()).hexdigest()
    return sorted(((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), len(kids.get(n, [])), leaves[n], saved[n], ends(n)) for n, m in nodes.items()), key=str)


@pytest.mark.parametrize("part, piece", [(20_000, 8192), (5, 4), (1, 1)])
def test_trie_against_brute_force(spark, monkeypatch, part, piece):
    monkeypatch.setattr(prefix_trie, "PART", part)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rnd = random.Random(part)
    rows = [(rnd.choice([None, *range(-120, 230)]), rnd.choice([None, 0, 1, 2, 3]), rnd.choice([None, "u"]), rnd.choice(["a", "bb", None, "é"])) for _ in range(500)]
    rows += [(1000 + i, t, "u", "hot") for i in range(60) for t in range(3)]  # a group of equal conversations
    rows += [(300, t, "u", "long" * 1000) for t in range(120)] + rows[:40]  # a long conversation, repeated rows
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"path": F.lit("p"), "key": F.lit(1), "depth": F.lit(2), "t": F.lit(3)})
    assert sorted(map(tuple, prefix_trie.prefix_trie(df).collect()), key=str) == brute_trie(rows)
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


paths = st.sets(st.lists(st.sampled_from("ab"), max_size=5).map(tuple), min_size=1, max_size=14)


@settings(max_examples=300, deadline=None)
@given(paths, st.integers(1, 5))
def test_parts_add_up(found, size):
    """However sorted paths are cut into parts, the points add up to those of one part."""
    text = lambda p: "".join(hashlib.md5(x.encode()).hexdigest() + f"{ord(x) % 7:016x}" for x in p)
    rows = sorted((text(p), k % 3 + 1, k) for k, p in enumerate(sorted(found)))

    def summed(parts):
        spines = []
        for k, part in enumerate(parts):
            made = prefix_trie.points(part, None, None, [], [])
            spines.append((k, part[0][0], part[-1][0], sorted(p.depth for p, _ in made if p.first == 0), sorted(p.depth for p, _ in made if p.last == len(part) - 1)))
        cut, out = prefix_trie.cuts(spines), {}
        for k, part in enumerate(parts):
            for p, above in prefix_trie.points(part, *cut[k]):
                key, depth, parent, edge, n, low, *sums = p.row(above)
                have = out.setdefault((key, depth, parent), [[], 0, 10**9, [0] * 4])
                have[0] += [edge] if edge is not None else []
                have[1] += n
                have[2] = min(have[2], low)
                have[3] = [a + b for a, b in zip(have[3], sums, strict=True)]
        return out

    assert summed([rows[a : a + size] for a in range(0, len(rows), size)]) == summed([rows])


@pytest.mark.parametrize("name", ["op11_rotated_one_bit_codes", "op12_windowed_bucket_search", "op13_prefix_trie"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    want = con.execute(queries.ORACLE_SQL[name])
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
