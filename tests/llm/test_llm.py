"""Training-data operators against brute force, libraries, exact round trips and held-out labels."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm import bpe, chat, licences, mixing, near_duplicates, sharding, shared, spotsigs, token_shards, top_k, toxicity
from strandline.llm.components import components
from strandline.llm.licence_templates import TEMPLATES

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_bpe_equals_library(text):
    own = bpe.codec(RANKS, P.PATTERN)
    ranks = own.ranks
    library = test_bpe_equals_library.__dict__.setdefault("library", tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    assert own.encode(text) == library.encode_ordinary(text)
    assert own.decode(own.encode(text)).decode() == text


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=60), st.binary(max_size=8), st.data())
def test_bpe_append_and_edit(piece, new, data):
    own = bpe.codec(RANKS, P.PATTERN)
    table = own.last_tokens(piece)
    assert own.append(table, piece, new) == own.last_tokens(piece + new)
    a = data.draw(st.integers(0, len(piece)))
    b = data.draw(st.integers(a, len(piece)))
    edited, again = own.edit(table, piece, a, b, new)
    assert edited == piece[:a] + new + piece[b:] and again == own.last_tokens(edited)


def test_bpe_frames(documents, reference):
    texts = [(r.doc_id, r.text or "") for r in documents.collect()]
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(documents, RANKS, P.PATTERN).collect())
    want = [(k, len(i := reference.encode_ordinary(t)), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for k, t in texts]
    assert got == sorted(want)
    encoded = bpe.encode_documents(documents, RANKS, P.PATTERN)
    assert sorted((r.doc_id, r.text) for r in bpe.decode_documents(encoded, RANKS, P.PATTERN).collect()) == sorted(texts)
    assert bpe.round_trip(documents.limit(0), RANKS, P.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é\n\t.'s1 　")), max_size=5))
def test_library_chunks_equal_whole_texts(texts):
    texts = [*texts, "x<|endoftext|> y"]
    assert token_shards.library_encoder(JSON).encode(texts) == [e.ids for e in Tokenizer.from_file(JSON).encode_batch(texts, add_special_tokens=False)] if texts else True


def test_token_shards(spark, documents):
    rows = sorted(documents.collect(), key=lambda r: (r.doc_id, r.text or ""))
    library = Tokenizer.from_file(JSON)
    want, start = [], 0
    for r in rows:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_shards.shard_digests(documents, JSON).collect()) == sorted(want)
    folder = shared.shared_folder(spark)
    manifest = token_shards.write_shards(documents, JSON, 0, folder)
    store, _ = token_shards.filesystem(folder)
    found = []
    for m in manifest.collect():
        with store.open_input_file(m.path) as file:
            reader = token_shards.ShardReader(file)
            found += [len(x) for x in reader.get(6)]
            assert reader.get(999) == []
    assert len(found) == 2
    assert token_shards.shard_digests(documents.limit(0), JSON).count() == 0


def test_sharding(spark, documents):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("é").alias("text"))
    p = sharding.shard_documents(docs).toPandas()
    assert set(p["size"]) == {10} and set(p.text_crc32) == {zlib.crc32("é".encode())}
    for _, g in p.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    moved = p[p.shard != p.grown_shard]
    assert set(moved.grown_shard) == {24} and 80 < len(moved) < 260 and p.shard.nunique() == 24
    tree = sharding.topology(24)
    heavier = sharding.reweighted(tree, 5, 3.0)  # in the second rack of the first region, shards 4 to 7 and 0 to 11
    both = docs.select(sharding.descend(F.col("doc_id"), tree).alias("a"), sharding.descend(F.col("doc_id"), heavier).alias("b")).toPandas()
    moved = both[both.a != both.b]
    assert 250 < (both.b == 5).sum() - (both.a == 5).sum() < 400  # from 1/24 to 3/26 of 4000
    # keys come into the region, in it into the rack, in that into the shard; none moves between shards outside of these
    assert (moved.b < 12).all() and moved.b[moved.a < 12].between(4, 7).all() and (moved.b[moved.a.between(4, 7)] == 5).all()
    assert sharding.shard_documents(documents).count() == 12 and sharding.shard_documents(documents.limit(0)).count() == 0


def test_one_more_shard_takes_rows_into_itself_only(spark):
    keys = spark.range(3000).select(F.col("id").alias("doc_id")).union(spark.sql("select cast(null as bigint)"))
    counts = range(24, 41)
    p = keys.select("doc_id", *(sharding.descend(F.col("doc_id"), sharding.topology(n)).alias(f"s{n}") for n in counts)).toPandas()
    for n in counts[:-1]:
        moved = p[f"s{n}"] != p[f"s{n + 1}"]
        assert set(p[f"s{n + 1}"][moved]) == {n} and p[f"s{n}"].nunique() == n
    # by brute force: the smallest draw of the regions, of the racks of that region, of the shards of that rack
    names = {f"root/region{r}": (12.0, [f"root/region{r}/rack{3 * r + k}" for k in range(3)]) for r in range(2)} | {f"root/region-of-shard{k}": (1.0, k) for k in range(24, 40)}
    names |= {f"root/region{k // 3}/rack{k}": (4.0, [f"root/region{k // 3}/rack{k}/shard{i}" for i in range(4 * k, 4 * k + 4)]) for k in range(6)}
    names |= {f"root/region{k // 12}/rack{k // 4}/shard{k}": (1.0, k) for k in range(24)}
    draws = keys.select(*(shared.uniform(F.col("doc_id"), n).alias(str(k)) for k, n in enumerate(names))).toPandas().to_numpy()
    draws = {n: -np.log(draws[:, k]) / w for k, (n, (w, _)) in enumerate(names.items())}

    def leaf(i):
        at = [n for n in names if n.count("/") == 1]
        while isinstance(at, list):
            at = names[min(at, key=lambda n: draws[n][i])][1]
        return at

    assert [leaf(i) for i in range(len(p))] == p["s40"].tolist()
    # another tree of the same shards deals them otherwise
    flat = keys.select(sharding.descend(F.col("doc_id"), sharding.topology(24, 24, 1, 12)).alias("f"), sharding.descend(F.col("doc_id"), sharding.topology(24)).alias("t")).toPandas()
    assert (flat.f != flat.t).mean() > 0.5
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    grown = {r.doc_id: r.grown_shard for r in sharding.shard_documents(docs, 24).collect()}
    assert grown == {r.doc_id: r.shard for r in sharding.shard_documents(docs, 25).collect()}


def brute_components(rows, width, percent):
    sets = [near_duplicates.word_shingles(t or "", width) for _, t in rows]
    low = [k for k, _ in rows]
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                c = len(sets[i] & sets[j])
                if sets[i] and sets[j] and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c) and low[i] != low[j]:
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    return {k: (len(s), m) for (k, _), s, m in zip(rows, sets, low, strict=True)}


def test_near_duplicates(spark, documents):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(12):
        base = rng.choice(words, 80).tolist()
        for k in range(12):
            own = list(base)
            for at in rng.choice(80, rng.integers(0, 6), replace=False):
                own[at] = f"e{g}x{k}x{at}"
            rows.append((100 + 12 * g + k, " ".join(own)))
    rows += [(r.doc_id, r.text) for r in documents.dropDuplicates(["doc_id"]).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("regs", F.lit("x"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(df, 4, 80).collect()}
    assert got == brute_components(rows, 4, 80)
    kept = near_duplicates.without_near_duplicates(df, 4, 80)
    assert kept.columns == df.columns and kept.count() == len({m for _, m in got.values()})
    assert near_duplicates.near_duplicates(df.limit(0), 4, 80).count() == 0


def test_near_duplicates_of_null_and_repeated_ids(spark):
    text = lambda name: " ".join(f"{name}{k}" for k in range(40))
    rows = [(1, text("a"), "x"), (None, text("a"), "y"), (None, text("b"), "z"), (None, text("c"), "z"), (None, text("c") + " more", "z"), (None, "", "e"), (None, None, "e")]
    rows += [(2, text("d"), "x"), (2, text("d"), "x"), (2, text("d"), "other"), (3, text("d"), "x"), (4, "", "e"), (4, "", "e"), (5, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    got = sorted(near_duplicates.without_near_duplicates(df, 5, 80).collect(), key=str)
    third = [r for r in got if r.text and r.text.startswith("c0 ")]
    assert len(third) == 1 and tuple(third[0]) in rows
    want = [(1, text("a"), "x"), (None, text("b"), "z"), (None, "", "e"), (None, None, "e"), (2, text("d"), "x"), (2, text("d"), "other"), (4, "", "e"), (5, "", "e")]
    assert sorted((tuple(r) for r in got if r not in third), key=str) == sorted(want, key=str)


def test_near_duplicates_of_clashing_ids(spark):
    text = lambda name, *new: " ".join([f"{name}{k}" for k in range(60)] + list(new))
    rows = [(1, text("a")), (1, text("b")), (2, text("a", "x")), (3, text("b", "y")), (None, text("c")), (None, text("c", "z")), (None, text("d")), (5, text("d", "u")), (7, None), (7, ""), (None, "")]
    rows += [(9, text("e"))] * 2 + [(8, text("e"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates.near_duplicates(df, 4, 80).collect()), key=str)
    want = [(1, 57, 1, True)] * 2 + [(2, 58, 1, False), (3, 58, 1, False), (None, 57, None, True), (None, 58, None, True), (None, 57, 5, False), (5, 58, 5, True), (7, 0, 7, True), (7, 0, 7, True), (None, 0, None, True)]
    want += [(9, 57, 8, False)] * 2 + [(8, 57, 8, True)]
    assert got == sorted(want, key=str)


def test_near_duplicates_of_extreme_ids(spark):
    text = lambda name, *new: " ".join([f"{name}{k}" for k in range(60)] + list(new))
    top = 2**63 - 1
    rows = [(top, text("a")), (top, text("b")), (top - 1, text("b", "x")), (None, text("a", "y")), (-(2**63), text("c"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates.near_duplicates(df, 4, 80).collect()), key=str)
    assert got == sorted([(top, top), (top, top - 1), (top - 1, top - 1), (None, top), (-(2**63), -(2**63))], key=str)
    assert near_duplicates.without_near_duplicates(df.where("doc_id > 0 OR doc_id IS NULL"), 4, 80).count() == 2


def test_hot_buckets_are_salted(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "HOT_ROWS", 5)
    monkeypatch.setattr(near_duplicates, "STAR_ROUNDS", 1)
    monkeypatch.setattr(near_duplicates, "BLOCK", 4)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base[:k], f"e{k}", *base[k + 1 :]])) for k in range(30)] + [(100 + k, " ".join(base)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(df, 4, 80).collect()} == brute_components(rows, 4, 80)


def test_registers_merge():
    a, b = (np.unique(np.random.default_rng(k).integers(0, 2**64, 500, dtype=np.uint64)) for k in range(2))
    of = lambda x: near_duplicates.registers(x, np.array([0, len(x)]))
    assert (near_duplicates.merged(of(a), of(b)) == of(np.union1d(a, b))).all()


def test_blocks_find_what_stars_miss(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "STAR_ROUNDS", 0)
    monkeypatch.setattr(near_duplicates, "BLOCK", 4)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base[:k], f"e{k}", *base[k + 1 :]])) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(df, 4, 80).collect()} == brute_components(rows, 4, 80)


def test_members_of_a_small_bucket_are_dealt_once(spark, monkeypatch):
    rows = [(1, 0, k, k, 9, b"", b"", k == 0, 1, 19) for k in range(20)]
    members = spark.createDataFrame(rows, "key long, band int, rep long, component long, n long, regs binary, folded binary, largest boolean, most long, others long")
    deal, dealt = type(members).repartition, []
    monkeypatch.setattr(type(members), "repartition", lambda self, *by: dealt.append(self.count()) or deal(self, *by))
    near_duplicates.blocks(members, 80)
    assert dealt == [20]


def test_registers_stay_no_longer_than_they_are_read(spark, monkeypatch, tmp_path):
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base[:k], f"e{k}", *base[k + 1 :]])) for k in range(30)] + [(100 + k, " ".join(f"{w}x{k}" for w in base)) for k in range(50)]
    compared, estimated = [], near_duplicates.estimated
    monkeypatch.setattr(near_duplicates, "estimated", lambda pairs, classes, threshold: compared.append(classes.count()) or estimated(pairs, classes, threshold))
    monkeypatch.setattr(near_duplicates, "shared_folder", lambda spark: f"file://{tmp_path}")
    out = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80)
    assert compared and max(compared) <= 30  # the others share no bucket
    assert [p.name for p in tmp_path.iterdir() if "regs" in spark.read.parquet(f"file://{p}").columns] == []
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute_components(rows, 4, 80)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), shared.shared_folder(spark)).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}


def test_toxicity(spark, documents):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(900):
        toxic = k % 6 == 0
        own = rng.choice(words, 40).tolist() + ["nasty"] * toxic
        rows.append((k, " ".join(own)))
        if k % 2 or toxic:
            labels.append((k, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    p = toxicity.toxicity(docs, known).toPandas()
    assert all(h == (zlib.crc32(str(k).encode()) % 5 == 0) for k, h in zip(p.doc_id, p.held_out))
    assert (p[p.held_out].predicted == (p[p.held_out].doc_id % 6 == 0)).mean() > 0.98
    kept = toxicity.without_toxic(documents, known)
    assert kept.columns == documents.columns
    none = toxicity.toxicity(documents, known.limit(0)).toPandas()
    assert len(none) == 12 and none.score.between(0, 1).all()


def brute_risk(positive, unlabelled, prior, w):
    g = lambda rows: [sum(w[k] for k in r) + w[-1] for r in rows]
    loss = lambda z: float(np.log1p(np.exp(-z)))
    on_positives = prior * np.mean([loss(z) for z in g(positive)])
    on_negatives = np.mean([loss(-z) for z in g(unlabelled)]) - prior * np.mean([loss(-z) for z in g(positive)])
    return on_positives, on_negatives


def test_nnpu_risk_and_direction():
    rng = np.random.default_rng(1)
    seen = set()
    for prior in (0.05, 0.3, 0.9):
        for _ in range(10):
            rows = [[np.flatnonzero(rng.random(5) < 0.4) for _ in range(n)] for n in (6, 15)]
            w = rng.normal(size=6) * 2
            made = [toxicity.Presence(r, 5) for r in rows]
            positive, negative, direction = toxicity.nnpu_risk(*made, prior, w)
            np.testing.assert_allclose([positive, negative], brute_risk(*rows, prior, w), rtol=1e-9)
            # downhill of the whole risk while that on negatives is positive, uphill of it alone when it isn't
            seen.add(negative >= 0)
            of = lambda w: sum(brute_risk(*rows, prior, w)) if negative >= 0 else -brute_risk(*rows, prior, w)[1]
            numeric = [(of(w + 1e-6 * e) - of(w - 1e-6 * e)) / 2e-6 for e in np.eye(6)]
            np.testing.assert_allclose(direction, numeric, atol=1e-6)
    assert seen == {True, False}


def test_scores_against_plain_loops(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    weights = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    letter = lambda b: b >= 128 or chr(b).isalnum()
    known: dict[bytes, list[int]] = {}

    def features(word):
        if word not in known:
            known[word] = [int(shared.hashed_words([word.decode()], toxicity._TABLE)[0][0])]
            for k in toxicity.PREFIXES:
                known[word] += [int(h) for h in shared.hashed_words([word.decode()], toxicity._TABLE, prefixes=(k,))[0][1:]]
        return known[word]

    rows = docs.limit(60).collect()
    got = model.scores([r.text for r in rows])
    for r, score in zip(rows, got, strict=True):
        words, word = set(), b""
        for b in [*(r.text or "").encode(), 32]:
            if letter(b):
                word += bytes([b])
            elif word:
                words.add(word)
                word = b""
        own = {f for w in words for f in features(w)}
        assert abs(score - 1 / (1 + np.exp(-(model.bias + sum(weights.get(f, 0.0) for f in own))))) < 1e-9
    kept = {r.doc_id for r in toxicity.without_toxic(docs, spark.read.parquet(f"{d}/labels.parquet")).collect()}
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, spark.read.parquet(f"{d}/labels.parquet")).collect()}
    assert kept == {k for k, s in scores.items() if s < 0.5}


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    p = toxicity.toxicity(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).toPandas()
    known = spark.read.parquet(f"{d}/labels.parquet").toPandas().merge(p[p.held_out], on="doc_id")
    assert (known.toxic == known.predicted).mean() > 0.95


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(300, 8)), np.tile(rng.normal(size=8), (200, 1))]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1050, [float("nan")] * 8), (1100, [None] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(0)).withColumn("block", F.lit(0))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    want = {}
    for k in range(0, 500, 50):
        order = sorted((j for j in range(500) if j != k), key=lambda j: (-int(q[k] @ q[j]), j))[:5]
        want |= {(k, i + 1): (j, int(q[k] @ q[j])) for i, j in enumerate(order)}
    assert got == want
    monkeypatch.setattr(top_k, "BLOCK", 16)
    monkeypatch.setattr(top_k, "VISITS", 3)
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k.top_k(df, F.col("vec_id") % 50 == 0).collect()} == want
    short = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, []), (3, [1.0, 2.0]), (4, [1.0, 2.0, 3.0]), (4, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in top_k.top_k(short, F.col("vec_id") == 0, 9).orderBy("rank").collect()] == [(3, 5 * 65536), (4, 5 * 65536), (4, 5 * 65536), (1, 65536), (2, 0)]
    assert top_k.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_mixing_meets_targets(spark, documents):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(rng.choice([f"{'ab'[k % 2]}{j}" for j in range(30)] + ["c"] * 20, 30))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(0, 200)], "doc_id long, domain string")
    p = mixing.mixture(docs, labels, {"a": 0.7, "b": 0.3}).toPandas()
    shares = (np.array(p.p.tolist()) * (p.n_tokens * p.rate).to_numpy()[:, None]).sum(0) / p.n_tokens.sum()
    assert np.abs(shares - [0.7, 0.3]).max() < 1e-6 and (p.rate >= 0).all() and (p.domain == ["ab"[k % 2] for k in p.doc_id]).mean() > 0.95
    mixed = mixing.mixed_documents(docs, labels, {"a": 0.7, "b": 0.3}, at_least=1, steps=3)
    assert mixed.columns == docs.columns and mixed.select("doc_id").distinct().count() == 300
    assert mixing.mixture(documents, labels, {"a": 1.0, "b": 1.0}, steps=2).count() == 12
    assert mixing.mixture(documents.limit(0), labels, {"a": 1.0, "b": 1.0}, steps=2).count() == 0


def test_mixing_of_shared_and_missing_ids(spark):
    rng = np.random.default_rng(2)
    text = lambda k: " ".join(rng.choice([f"{'ab'[k % 2]}{j}" for j in range(30)], 30))
    rows = [(k, text(k), "x") for k in range(100)] + [(7, text(0), "y"), (7, text(0), "z"), (None, text(1), "n"), (None, None, "n"), (200, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _copies string")
    labels = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(60)], "doc_id long, domain string")
    out = mixing.mixed_documents(df, labels, {"a": 0.9, "b": 0.1}, at_least=1)
    times = {}
    for r in out.collect():
        times[tuple(r)] = times.get(tuple(r), 0) + 1
    assert out.columns == df.columns and set(times) == set(rows)
    assert len({times[r] for r in rows if r[0] == 7}) == 1 and len({times[r] for r in rows if r[0] is None}) == 1


@pytest.mark.parametrize("targets", [[0.5, 0.3, 0.2], [0.05, 0.9, 0.05], [0.9, 0.05, 0.05], [0.0, 0.0, 1.0]])
def test_rates_against_plain_projected_gradient(spark, targets):
    rng = np.random.default_rng(8)
    p, n = rng.dirichlet([1.0, 0.6, 0.4], 400), rng.integers(1, 60, 400).astype(float)
    if targets[0] == 0.9:
        p = 0.2 * p + 0.8 / 3  # no text is likely enough to be of the first domain: these targets can't be met
    total = n.sum()
    goal = np.array(targets) * total
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")
    steps = mixing.fit_rates(rows, goal.tolist())
    got = np.array([r.rate for r in rows.select(mixing.rate(steps, 3).alias("rate")).collect()])
    weight = np.linalg.pinv((p * n[:, None]).T @ p / total, rcond=1e-9, hermitian=True)
    loss = lambda r: ((p * (n * r)[:, None]).sum(0) - goal) @ weight @ ((p * (n * r)[:, None]).sum(0) - goal) / total**2
    plain = np.ones(400)
    for _ in range(mixing.STEPS):
        plain = np.maximum(0, plain - p @ (weight @ ((p * (n * plain)[:, None]).sum(0) - goal)) / total)
    assert (got >= 0).all() and loss(got) <= loss(plain) * (1 + 1e-9) + 1e-15
    if 0 < targets[0] < 0.9:
        assert len(steps) < 15
        assert np.abs((p * (n * got)[:, None]).sum(0) - goal).max() / total < 1e-6


def test_repeats_against_brute_force(spark):
    rng = np.random.default_rng(9)
    p, n = rng.dirichlet([2.0, 1.0], 300), rng.integers(1, 60, 300).astype(float)
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")
    shares = np.array([0.45, 0.55])
    v = np.array(mixing.fit_repeats(rows, shares.tolist()))
    rate = lambda v: 1 + np.maximum(0, (p - shares) @ v)
    reached = (p * (n * rate(v))[:, None]).sum(0) / (n * rate(v)).sum()
    assert np.abs(reached - shares).max() < 1e-4
    # of two domains one number decides; found by halving
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        own = rate(np.array([-mid, mid]) / 2)
        low, high = (mid, high) if (p[:, 1] * n * own).sum() / (n * own).sum() < 0.55 else (low, mid)
    assert np.abs(rate(v) - rate(np.array([-mid, mid]) / 2)).max() < 1e-2


def test_mixing_stage_reaches_shares(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(4)
    rows = [(k, " ".join(rng.choice([f"{'ab'[k % 2]}{j}" for j in range(30)] + ["c"] * 20, 30))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = [r.doc_id for r in corpus_pipeline.mixing(spark, docs, str(tmp_path)).collect()]
    high = sum(k % 2 == 0 for k in out) / len(out)  # every text has 30 words
    assert set(out) == set(range(400)) and abs(high - corpus_pipeline.TARGETS["high"]) < 0.02
    p = mixing.mixture(docs, mixing.label_domains(spark.read.parquet(f"{tmp_path}/labels.parquet")), mixing.Repeated(high=0.2, low=0.8)).toPandas()
    assert p.rate.min() >= 1 and abs(p.rate[p.doc_id % 2 == 0].sum() / p.rate.sum() - 0.2) < 0.02


def test_spotsigs(spark, documents):
    one = documents.dropDuplicates(["doc_id"])
    rows = sorted(((r.doc_id, r.text or "") for r in one.collect()))
    got = {r.doc_id: r for r in spotsigs.fingerprint_documents(one).collect()}
    for (k, t), (_, following) in zip(rows, [*rows[1:], rows[0]], strict=True):
        half = len(t) // 2
        assert got[k].n_chars == len(t) and got[k].edited_sha256 == hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1
    assert got[1].fingerprint == got[2].fingerprint and got[1].near_next == 1 and got[2].near_next > 0.5 and got[4].fingerprint == ""
    members, pairs = spotsigs.similar_classes(documents, 0.7)
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, 3)} and members.where("class_id = 1").count() == 2
    assert spotsigs.fingerprint_documents(documents).count() == 12 and spotsigs.fingerprint_documents(documents.limit(0)).count() == 0


def brute_signatures(text):
    """Operator 9's signatures by plain loops, with the same hash."""

    def hashed(kind, chain):
        h = 42
        for part in [kind, *(c for c in chain if c is not None)]:
            h = xxhash.xxh64_intdigest(part.encode(), seed=h)
        return h % (1 << 32) - (1 << 31)

    words = [w for w in regex.sub(r"[^\p{L}\p{N}]+", " ", (text or "").lower()).split(" ") if w]
    stretches = [[]]
    for w in words:
        if w in spotsigs.ANCHORS:
            stretches.append([])
        else:
            stretches[-1].append(w)
    at = lambda xs, k: xs[k] if k < len(xs) else None
    out = {hashed("anchor", sum(stretches[i : i + 3], [])[:3]) for i in range(1, len(stretches))}
    for i, s in enumerate(stretches):
        for k in range(8 if i else 0, len(s)):
            if k == (8 if i else 0) or k + 3 <= len(s):
                out.add(hashed("word", [at(s, k + j) for j in range(3)]))
    if 1 <= len(words) <= 6:
        letters = list(" ".join(words))
        for k in range(max(1, len(letters) - 3)):
            own = hashed("letters", [at(letters, k + j) for j in range(4)])
            if own % 6 >= len(words) - 1:
                out.add(own)
    return out


def test_signatures_and_likeness_against_brute_force(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id > 20").unionByName(documents.dropDuplicates(["doc_id"]).select("doc_id", "text"))
    rows = [tuple(r) for r in docs.orderBy("doc_id").collect()]
    sigs = {k: brute_signatures(t) for k, t in rows}
    alike = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    got = {r.doc_id: r for r in spotsigs.fingerprint_documents(docs).collect()}
    for (k, t), (following, text) in zip(rows, [*rows[1:], rows[0]], strict=True):
        t, text = t or "", text or ""
        half = len(t) // 2
        new = brute_signatures(t[: len(t) - half] + text[:half])
        name = lambda s: "".join(f"{x + (1 << 31):08X}" for x in sorted(s))
        assert (got[k].fingerprint, got[k].edited_fingerprint) == (name(sigs[k]), name(new)), k
        assert abs(got[k].near_edited - alike(sigs[k], new)) < 1e-12 and abs(got[k].near_next - alike(sigs[k], sigs[following])) < 1e-12
    members, pairs = spotsigs.similar_classes(docs, 0.6)
    classes = {}
    for k, s in sorted(sigs.items()):
        if s:
            classes.setdefault(frozenset(s), k)
    assert {r.doc_id: r.class_id for r in members.collect()} == {k: classes[frozenset(s)] for k, s in sigs.items() if s}
    near = {(a, b) for x, a in classes.items() for y, b in classes.items() if a < b and alike(x, y) >= 0.6}
    assert {(r.a, r.b) for r in pairs.collect()} == near and near


def test_spotsigs_change_next_to_an_anchor_only(spark):
    content = [f"w{k}" for k in range(100)]
    with_anchors = lambda n: " ".join("the " * (n > 0 and k % (100 // n) == 0) + w for k, w in enumerate(content))
    seven = with_anchors(8).split(" ", 1)[1]
    rows = [(1, seven, "the " + seven), (2, seven, seven.replace("w50", "w50 the")), (3, "w1 w2 w3 w4 w5", "w1 w2 w3 w4 w5 w6"), (4, "w1 w2 w3 w4 w5 w6", "w1 w2 w3 w4 w5 w6 w7")]
    rows += [(5, " ".join(content), " ".join(content[:50]) + " the " + " ".join(content[50:]))]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    df = spotsigs.with_signatures(spotsigs.with_signatures(df, "a", "x"), "b", "y")
    got = {r.k: r.near for r in df.select("k", spotsigs.likeness(F.col("x"), F.col("y")).alias("near")).collect()}
    assert min(got.values()) > 0.35 and got[5] > 0.8, got


def test_next_over_many_buckets(spark):
    from strandline.llm.neighbours import with_next

    df = spark.range(0, 20000, 3).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    p = with_next(df, "doc_id", "text", ["text"]).toPandas().sort_values("doc_id")
    assert p.next_text.tolist() == [*p.text.tolist()[1:], "0"]


def test_quotation_linking(spark):
    rows = [
        (1, 0, "u", "Hello there, how are you?\nSecond line here"), (1, 1, "a", "fine thanks"), (1, 2, "u", "> Hello there,  HOW are you?\n> Second line here\n\nme too"),
        (1, 3, "a", "> > Hello there, how are you?\n> me too\nok"), (2, 0, "u", "> fine thanks\nwow"), (2, 1, "a", None), (2, 2, "u", "no > quote"), (3, 0, "u", "> never said\nx"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("hash", F.lit(1))
    got = {(r.conv_id, r.turn): (r.thread_id, r.reply_pos, r.parent_conv, r.parent_turn, r.linked, r.quote_levels, r.text) for r in chat.conversations_without_quotes(df).collect()}
    assert got == {
        (1, 0): (1, 0, None, None, False, 0, rows[0][3]), (1, 1): (1, 1, 1, 0, False, 0, "fine thanks"), (1, 2): (1, 2, 1, 0, True, 1, "me too"), (1, 3): (1, 3, 1, 2, True, 2, "ok"),
        (2, 0): (1, 4, 1, 1, True, 1, "wow"), (2, 1): (1, 5, 2, 0, False, 0, ""), (2, 2): (1, 6, 2, 1, False, 0, "no > quote"), (3, 0): (3, 0, None, None, False, 1, "x"),
    }
    assert chat.conversations_without_quotes(df.limit(0)).count() == 0


def brute_threads(rows):
    """The rules of operator 7 over a list of (conv_id, turn, role, text), message by message."""
    normal = lambda t: regex.sub(r"[^\p{L}\p{N}]+", " ", t.lower()).strip(" ")
    order = lambda k: (rows[k][0] is not None, rows[k][0] or 0, rows[k][1] is not None, rows[k][1] or 0, k)
    said, quotes, clean, levels = {}, {}, {}, {}
    for k, (conv, turn, _, text) in enumerate(rows):
        text = text or ""
        passages = []
        for line in regex.split("\r?\n", text):
            marks = regex.match(r"^\s*(>(?:\s?>)*)", line)
            level = marks.group(1).count(">") if marks else 0
            if not passages or passages[-1][0] != level:
                passages.append((level, []))
            passages[-1][1].append(regex.sub(r"^\s*>(?:\s?>)*\s?", "", line))
        levels[k] = max(p[0] for p in passages)
        clean[k] = regex.sub(r"^\s+|\s+$", "", "\n".join("\n".join(ls) for lv, ls in passages if not lv)) if levels[k] else text
        for level, lines in passages:
            units = [u for u in map(normal, ["\n".join(lines), *(lines if len(lines) > 1 else [])]) if u]
            if level:
                quotes.setdefault(k, []).extend((level, u) for u in units)
            elif conv is not None and turn is not None:
                for u in units:
                    own = said.setdefault(u, {})
                    own[conv] = min(own.get(conv, (turn, k)), (turn, k))
    parents, joins, last = {}, {}, {}
    for k in sorted(range(len(rows)), key=order):
        conv, turn = rows[k][:2]
        votes = {}
        for level, u in quotes.get(k, []):
            own = said.get(u, {})
            any_ = min(((c, *p) for c, p in own.items()), default=None)
            to = None
            if turn is not None and conv in own and own[conv][0] < turn:
                to = (conv, own[conv][0])
            elif any_ and conv is not None and any_[0] < conv:
                to = any_[:2]
            if to and level == 1:
                votes[to] = votes.get(to, 0) + len(u)
        best = max(votes, key=lambda p: (votes[p], p[1], p[0]), default=None)
        before = last.get(conv)
        parents[k] = best or ((conv, rows[before][1]) if before is not None else (None, None)), best is not None
        if before is None and best and best[0] != conv:
            joins[conv] = best[0]
        last[conv] = k
    root = lambda c: root(joins[c]) if c in joins else c
    places, out = {}, []
    for k in sorted(range(len(rows)), key=order):
        thread = root(rows[k][0])
        places[thread] = places.get(thread, -1) + 1
        (pc, pt), linked = parents[k]
        out.append((*rows[k][:3], thread, places[thread], pc, pt, linked, levels[k], clean[k]))
    return out


def test_quotation_linking_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    said = [r for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").limit(60).collect()]
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in said]
    texts = [t for *_, t in rows if t]
    quoted = lambda t, mark: "\n".join(mark + line for line in t.split("\n"))
    for k in range(120):
        conv, turn = int(rng.integers(0, 40)), int(rng.integers(0, 1500))
        parts = []
        for _ in range(rng.integers(1, 4)):
            t = texts[rng.integers(len(texts))]
            part = t if rng.random() < 0.6 else t[: len(t) // 2]
            parts.append([quoted(part, "> "), quoted(part.upper(), ">> "), quoted(part, " > > "), f"own words {k}", "", "> nobody said this"][rng.integers(6)])
        rows.append((conv, turn, "user", "\n".join(parts)))
        texts.append(f"own words {k}")
    rows += [(3, None, "user", "first words"), (3, None, "user", quoted(texts[0], "> ") + "\nx"), (None, 1, "user", quoted(texts[1], "> ")), (None, None, "a", texts[2]), (50, 0, "user", None), (50, 1, None, "")]
    rows += rows[60:64] + [(60, 0, "user", "> own words 5\nreply")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit(1)).withColumn("root", F.lit(2))
    for stretch in (512, 7):
        monkeypatch.setattr(chat, "STRETCH", stretch)
        got = [tuple(r) for r in chat.conversations_without_quotes(df).collect()]
        assert sorted(got, key=str) == sorted(brute_threads(rows), key=str)
    assert sum(r[7] for r in got) > 20 and len({r[3] for r in got}) < len({r[0] for r in got})
    of = {(r[0], r[1]): (r[3], r[4]) for r in got}
    assert all(of[r[5], r[6]][1] < r[4] for r in got if (r[5], r[6]) in of and of[r[5], r[6]][0] == r[3] and (r[5], r[6]) != (r[0], r[1]))


def test_licences(documents):
    got = {r.doc_id: r for r in licences.scan_licences(documents, TEMPLATES).collect()}
    assert got[9].licence == "MIT-notice" and got[9].dice == 1 and [(s.first_line, s.last_line) for s in got[9].spans] == [(0, 0)]
    assert all(r.licence is None and r.dice == 0 for k, r in got.items() if k != 9)
    text = "intro words\n\n" + TEMPLATES["MIT"].replace(". ", ".\n") + "\n\nmore words follow"
    words, _, starts, _ = shared.hashed_words([text], licences._TABLE)
    found = licences.Scanner(TEMPLATES, 0.8).scan(text, words, starts)
    assert [f[0] for f in found] == ["MIT"] and found[0][1] > 0.99
    assert licences.scan_licences(documents.limit(0), TEMPLATES).count() == 0


def test_licences_at_word_positions():
    def found(text):
        words, _, starts, _ = shared.hashed_words([text], licences._TABLE)
        return [f for f in licences.Scanner(TEMPLATES, 0.8).scan(text, words, starts)]

    prose = " ".join(f"prose{k}" for k in range(40))
    assert found("Code here is free to read. All rights reserved.") == [("All-rights-reserved", 1.0, 0, 0)]
    assert found(f"{prose} Released under the MIT License. {prose}\n{prose}") == [("MIT-notice", 1.0, 0, 0)]
    assert found(f"All rights reserved. {prose} All rights reserved.") == [("All-rights-reserved", 1.0, 0, 0)] * 2
    assert [f[0] for f in found(f"{prose} {TEMPLATES['MIT']} {prose}")] == ["MIT"]
    wrapped = (TEMPLATES["MIT"] + " " + TEMPLATES["MPL-2.0-header"]).replace(", ", ",\n").replace(". ", ".\n")
    assert {f[0] for f in found(wrapped)} == {"MIT", "MPL-2.0-header"}
    assert len(found("All rights reserved. " * 20000)) == 20000 and found("all rights " * 20000 + prose) == []
    # every window, by brute force
    rng = np.random.default_rng(6)
    name = "CC-BY-4.0"
    template = TEMPLATES[name].lower().replace(".", " ").split()
    target = set(zip(template, template[1:], strict=False))
    for _ in range(30):
        words = [w for k in range(0, 40, 13) for w in [*rng.choice(["x", "y", "work", "licensed"], 3), *(t for t in template if rng.random() > 0.08)]]
        pairs = list(zip(words, words[1:], strict=False))
        dice = [2 * len(target & set(pairs[a:b])) / (len(target) + len(set(pairs[a:b]))) for a in range(len(pairs)) for b in range(a + 1, len(pairs) + 1)]
        got = max((f[1] for f in found(" ".join(words)) if f[0] == name), default=0)
        assert abs(got - (max(dice) if max(dice) >= 0.8 else 0)) < 1e-9


def test_pipeline(spark, reference):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    clean = corpus_pipeline.toxicity(spark, docs, d)
    kept = corpus_pipeline.near_duplicates(spark, clean, d)
    assert docs.columns == clean.columns == kept.columns
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    low = {m for _, m in brute_components(rows, 5, 80).values()}
    assert {r.doc_id for r in kept.collect()} == low
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "mixing", "encoding"]
    kept = shared.written(kept, shared.shared_folder(spark), "kept")
    labels = mixing.label_domains(spark.read.parquet(f"{d}/labels.parquet"))
    rates = {r.doc_id: r.rate for r in mixing.mixture(kept, labels, corpus_pipeline.TARGETS).collect()}
    draws = {r.doc_id: r.u for r in kept.select("doc_id", shared.uniform("mixing", F.col("doc_id")).alias("u")).collect()}
    texts = {r.doc_id: r.text or "" for r in kept.collect()}
    want = sorted((k, reference.encode_ordinary(t)) for k, t in texts.items() for _ in range(max(1, int(rates[k] + draws[k]))))
    assert corpus_pipeline.mixing(spark, kept, d).columns == docs.columns
    assert sorted((r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, d).collect()) == want


def test_shuffles_go_once_their_table_is_written(spark, tmp_path):
    from strandline.llm.shared import CLEANUP, written

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    rows = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    left, setting = manager.shuffleStatuses().size(), spark.conf.get(CLEANUP, "false")
    assert written(rows, str(tmp_path), "rows").count() == 10
    assert spark.conf.get(CLEANUP, "false") == setting
    written(rows, str(tmp_path), "again")
    assert manager.shuffleStatuses().size() <= left + 1  # that of the count
