"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from mentionweave.llm import bpe, common, language, licenses, mixing, nearcopies, neardup_vectors, queries, simhash, suffixes, topk, toxicity, urlfilter
from mentionweave.llm.components import connected

from ..compare import SF, connect, rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x") for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \n", "a", "same text here", "same text here", "é" * 300, "word " * 60_000, "\u0000\t", "日本語 😀"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_oracle(spark, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), connect().sql(queries.ORACLE_SQL[name]).df()
    assert rows(got) == rows(want)


# 1. Toxicity -----------------------------------------------------------------------------------


def toxic_corpus(spark, n=1500, share=0.2):
    rng = random.Random(5)
    plain = [f"w{k}" for k in range(300)]
    texts, labels = [], []
    for i in range(n):
        toxic = rng.random() < share
        words = rng.choices(plain, k=rng.randint(5, 60))
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vilescum", "vilefool", "trashy"])
        texts.append(" ".join(words))
        if rng.random() < 0.6:
            labels.append((i, 1, int(toxic)))
    truth = {i for i, t in enumerate(texts) if any(w in t for w in ("vile", "trashy"))}
    return docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_toxicity_held_out(spark):
    documents, labels, truth = toxic_corpus(spark)
    model = toxicity.train(documents, labels)
    got = toxicity.score(documents, model).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == (r.doc_id in truth) for r in held) / len(held) > 0.95


def test_nnpu_risk_gradient_prefers_positives():
    ptr, idx, positive = np.arange(201), np.array([0] * 100 + [1] * 100), np.array([True] * 100 + [False] * 100)
    w, b = toxicity.nnpu(ptr, idx, positive, 2, 0.3)
    assert w[0] + b > 0 > w[1] + b


def test_nnpu_correction_keeps_the_risk_from_falling_below_zero():
    rng = np.random.default_rng(0)
    n, n_features, prior = 1500, 400, 0.3  # most features are chance: the model can fit every text
    positive = np.arange(n) < 150
    mk = lambda toxic: np.unique(np.append(rng.integers(20, n_features, 30), rng.integers(0, 20, 2) if toxic else [])).astype(int)
    texts = [mk(y) for y in positive | (rng.random(n) < prior)]
    fresh, y = [mk(i < 300) for i in range(1000)], np.arange(1000) < 300
    risk, loss = [], []
    for correct in (True, False):
        w, b = toxicity.nnpu(np.concatenate([[0], np.cumsum([len(d) for d in texts])]), np.concatenate(texts), positive, n_features, prior, correct=correct)
        z, f = (np.array([w[d].sum() + b for d in x]) for x in (texts, fresh))
        risk.append(np.logaddexp(0, z)[~positive].mean() - prior * np.logaddexp(0, z)[positive].mean())
        loss.append(np.logaddexp(0, np.where(y, -f, f)).mean())
    assert abs(risk[0]) < 0.3 and risk[1] < -2 and loss[0] < 1 < 2 < loss[1]


def test_toxicity_is_calibrated(spark):
    documents, labels, truth = toxic_corpus(spark, 3000)
    got = toxicity.score(documents, toxicity.train(documents, labels)).collect()
    share = len(truth) / len(got)
    assert abs(np.mean([r.score for r in got]) - share) < 0.05 and abs(np.mean([r.predicted for r in got]) - share) < 0.05


def test_spread_drops_near_copies_alone():
    rng = np.random.default_rng(4)
    own = [np.unique(np.append(rng.integers(100, 1 << 60, 60, np.uint64), np.uint64(i // 2))) for i in range(400)]  # each pair shares its least feature
    copies = [np.unique(np.append(own[0][:-2], np.uint64(1 << 61) + np.uint64(i))) for i in range(5)]
    assert toxicity._spread(own + copies, np.zeros(405, bool)).tolist() == [True] * 400 + [False] * 5


def test_toxicity_odd(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs(spark, ODD), none)
    got = toxicity.score(docs(spark, ODD), model).collect()
    assert len(got) == len(ODD) and len({r.score for r in got}) == 1
    assert toxicity.score(docs(spark, []), model).count() == 0


# 2. BPE ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def both():
    t = bpe.Transducer.from_file(VOCABULARY, public_tokenizers.PATTERN)
    return t, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=t.ranks, special_tokens={})


def test_bpe_as_tiktoken(both):
    ours, theirs = both
    rng = random.Random(3)
    parts = ["a", "e", "th", "ing", " ", "  ", "\n", "\t", "é", "日本", "😀", "'s", "1", "23", "###", "\x1c", "\x85", "\u00a0", "\u3000", "<|endoftext|>", "\u0301", "\U00032888", "\u088f"]
    for _ in range(4000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert ours.encode(s) == theirs.encode_ordinary(s)
        assert "".join(ours.decode(ours.encode(s))) == s
    for s in ("a" * 3000, "ab" * 3000, " " * 3000 + "x", "ÿ" * 2000, "0" * 2000):
        assert ours.encode(s) == theirs.encode_ordinary(s)


def test_bpe_neighbours_are_those_of_the_merges(both):
    ours, _ = both
    rng = random.Random(11)
    tokens = sorted(ours.bytes_of)
    for _ in range(20_000):
        a, b = rng.choice(tokens[: rng.choice((300, 3000, len(tokens)))]), rng.choice(tokens[: rng.choice((300, 3000, len(tokens)))])
        if ours._reached(a) and ours._reached(b):
            assert ours._apart(a, b) == (ours.merged(ours.bytes_of[a] + ours.bytes_of[b]) == [a, b])


def test_bpe_bounds_transitions_inside_a_piece(both, monkeypatch):
    theirs = both[1]
    ours = bpe.Transducer(both[0].ranks, public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "MAX_TRANSITIONS", 50)
    rng = random.Random(12)
    for _ in range(20):
        s = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
        assert ours.encode(s) == theirs.encode_ordinary(s) and len(ours._next) <= 51


def test_utf8_machine_in_any_pieces():
    rng = random.Random(4)
    data = "aé日😀z\u0301".encode() + b"\xff\xc3(\xe2\x82" + "ü".encode() + b"\xf0\x9f\x98"
    for _ in range(300):
        m, out, at = bpe.Utf8Machine(), "", 0
        while at < len(data):
            n = rng.randint(1, 4)
            out, at = out + m.feed(data[at : at + n]), at + n
        assert out + m.close() == data.decode("utf-8", "replace")


def test_bpe_digests_and_columns(spark, both):
    df = docs(spark, ODD)
    for r in bpe.digests(df, VOCABULARY, public_tokenizers.PATTERN).collect():
        ids = both[1].encode_ordinary(ODD[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((ODD[r.doc_id] or "").encode()).hexdigest())
    there = bpe.decode_column(bpe.encode_column(df, VOCABULARY, public_tokenizers.PATTERN), VOCABULARY, public_tokenizers.PATTERN)
    assert there.where(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0


# 3. SimHash ------------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_reachable(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_simhash_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    ids = sorted(prints)
    linked = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = least_reachable(ids, linked)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.report(df).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


@pytest.mark.parametrize("bucket", [2, 32])
def test_simhash_links_in_crowded_buckets(spark, bucket):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(200):
        prints.add(rng.choice(sorted(prints)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints |= {rng.getrandbits(64) for _ in range(50)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = least_reachable(signed, [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), bucket).collect()])
    want = least_reachable(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2])
    assert got == want


def test_simhash_odd(spark):
    got = {r.doc_id: r.component_id for r in simhash.report(docs(spark, ODD)).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[4] == got[5] == 4 and len(got) == len(ODD)
    assert simhash.report(docs(spark, [])).count() == 0
    twice = docs(spark, ["a b c d"]).union(docs(spark, ["a b c d"]))
    assert simhash.report(twice).count() == 2 and simhash.deduplicate(twice).count() == 1


def shingle_set(text, n=5):
    words = text.lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def edited_texts():
    rng = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    bases = [rng.choices(words, k=200) for _ in range(40)]
    texts = []
    for n, base in enumerate(bases):
        for edits in (0, 1, 2, 3, 8, 40) if n else range(100):  # many copies of the first, each with four words changed
            copy = list(base)
            for at in rng.sample(range(200), edits if n else 4):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def test_near_copies_are_dropped(spark):
    import corpus_pipeline

    texts = edited_texts()
    df = docs(spark, texts)
    sets = [shingle_set(t) for t in texts]
    alike = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    component = least_reachable(range(len(texts)), alike)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, SF).collect()}
    assert not [e for e in alike if set(e) <= kept]
    assert set(component.values()) <= kept and len(alike) > 200


def test_near_copies_of_a_group_that_is_not_all_alike(spark, monkeypatch):
    """Copies of one text with up to a third of its words changed: most meet, and many are alike to few."""
    import corpus_pipeline

    rng = random.Random(21)
    words = [f"w{k}" for k in range(3000)]
    base = rng.choices(words, k=150)
    texts = []
    for _ in range(400):
        copy = list(base)
        for at in rng.sample(range(150), rng.randint(1, 20)):
            copy[at] = rng.choice(words)
        texts.append(" ".join(copy))
    sets = [shingle_set(t) for t in texts]
    alike = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = set(least_reachable(range(len(texts)), alike).values())
    assert len(want) > 20
    for block in (256, 16):
        monkeypatch.setattr(nearcopies, "BLOCK", block)
        assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs(spark, texts), SF).collect()} == want


def test_shared_shingles():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 900, rng.integers(0, 700))) for _ in range(40)]
    got = nearcopies.shared(np.repeat(np.arange(40), [len(s) for s in sets]), np.concatenate(sets), 40)
    assert all(got[a, b] == len(np.intersect1d(sets[a], sets[b])) for a in range(40) for b in range(40) if a != b)


def test_near_copies_odd(spark):
    import corpus_pipeline

    got = corpus_pipeline.drop_near_duplicates(spark, docs(spark, ODD), SF)
    assert got.columns == docs(spark, []).columns
    assert {r.doc_id for r in got.collect()} == {0, 3, 4, 6, 7, 8, 9}
    assert corpus_pipeline.drop_near_duplicates(spark, docs(spark, []), SF).count() == 0


def test_near_copies_keep_clean_rows_without_or_with_shared_ids(spark):
    import corpus_pipeline

    texts = [(None, "one text without any id at all"), (None, "another text without an id here"), (None, "one text without any id at all"), (7, "a first text under the id seven"), (7, "some other text under that id"), (8, "a first text under the id seven")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t), "x") for i, t in texts], DOCS)
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, SF).collect())
    assert got == sorted((i or 0, t) for i, t in {texts[0], texts[1], texts[3], texts[4]})


def test_components(spark):
    rng = random.Random(2)
    linked = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, k) for k in range(501, 560)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(linked, "a long, b long")).collect()}
    want = least_reachable({x for e in linked for x in e}, linked)
    assert got == {n: c for n, c in want.items() if n != c}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


# 4. Suffixes -----------------------------------------------------------------------------------


def slow_removal(texts):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for b in data:
        mark = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                mark[i : i + 200] = True
        spans = int(mark[:1].sum() + (mark[1:] & ~mark[:-1]).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~mark])
        out.append((len(b), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeated_texts():
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [word(n) for n in (199, 200, 201, 260, 700)]
    texts = [word(rng.randint(0, 900)) for _ in range(30)]
    for _ in range(40):
        texts.append(word(rng.randint(0, 300)) + rng.choice(passages) + word(rng.randint(0, 300)) + rng.choice(passages))
    return [*texts, *texts[:3], "ab" * 400, "z" * 450, "é" * 150, None, "", "x" * 199, "x" * 199]


def test_suffixes_brute_force(spark):
    texts = repeated_texts()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.report(docs(spark, texts)).collect()}
    assert got == dict(enumerate(slow_removal(texts)))


@pytest.mark.parametrize("shard", [1, 4, 30])
def test_suffixes_narrow_hot_grams(spark, monkeypatch, shard):
    monkeypatch.setattr(suffixes, "SHARD", shard)
    texts = repeated_texts()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.report(docs(spark, texts)).collect()}
    assert got == dict(enumerate(slow_removal(texts)))


def test_suffixes_rows_without_or_with_shared_ids(spark):
    texts = repeated_texts()
    want = Counter(slow_removal(texts))
    for ids in ([None] * len(texts), [7] * len(texts), [i % 3 or None for i in range(len(texts))]):
        df = spark.createDataFrame([(i, t) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string")
        assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.report(df).collect()) == want


def test_suffixes_rows_that_share_id_and_text_are_one_in_the_merge(spark, monkeypatch):
    rows = [(g, k, s, at) for g in range(3) for k, s, at in ((5, 1, 7), (5, 2, 7), (6, 1, 7), (6, 1, 9)) for _ in range(400)]
    table = pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["gram", "key", "salt", "start"])
    for size in (1, 7, 400, 10_000):
        batches = [*table.to_batches(max_chunksize=size), table.slice(0, 0).to_batches()[0] if table.slice(0, 0).to_batches() else pa.RecordBatch.from_pylist([], table.schema)]
        got = [tuple(r.values()) for b in suffixes._once(iter(batches), "gram", "key", "salt", "start") for r in b.to_pylist()]
        assert got == sorted(set(rows), key=rows.index)
    monkeypatch.setattr(suffixes, "SHARD", 2)
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    texts = [f"one {passage} end of it"] * 3000 + [f"another {passage} with a tail", passage[:250] + " cut", "x" * 10]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    want = Counter(slow_removal(texts[:2] + texts[3000:]))  # copies among themselves are removed whole either way
    got = Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.report(df).collect())
    assert set(got) == set(want) and max(got.values()) == 3000


def test_merged_transform_is_that_of_all_texts(monkeypatch):
    rng = random.Random(8)
    passage = bytes(rng.choice(b"abc") for _ in range(260))
    data = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(200, 500))) for _ in range(20)] + [passage + bytes(rng.choice(b"ab") for _ in range(100)) for _ in range(6)] + [b"a" * 300, b"a" * 290, bytes(range(256)) * 2]
    off = np.concatenate([[0], np.cumsum([len(b) for b in data])])
    joined = b"".join(data)
    every = [(joined[p : p + 200], p) for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True) for p in range(s, e - 199)]
    want = [joined[p - 1] if p not in off else None for _, p in sorted(every)]
    for size in (1, 900, 1 << 18):
        monkeypatch.setattr(suffixes, "SHARD_BYTES", size)
        numbered = suffixes.shards_of(np.frombuffer(joined, np.uint8), off)
        which, at, same = suffixes.merged_order([s for _, s in numbered])
        p = at + off[[a for a, _ in numbered]][which]
        assert [joined[x - 1] if x not in off else None for x in p.tolist()] == want
        assert same.tolist() == [False] + [joined[x : x + 200] == joined[y : y + 200] for x, y in zip(p[:-1].tolist(), p[1:].tolist(), strict=True)]


def test_suffixes_of_bytes_that_are_no_utf8(spark):
    rng = random.Random(3)
    passage = bytes(rng.randrange(256) for _ in range(230))
    data = [passage + b"\xff\xfe", b"x\xc3" + passage, b"\xff" * 50, "é".encode() * 120]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(data)], "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in suffixes.report(df).collect()}
    left = [b"\xff\xfe", b"x\xc3", b"\xff" * 50, "é".encode()]
    assert {i: g[2] for i, g in got.items() if i < 3} == {i: hashlib.sha256(b).hexdigest() for i, b in enumerate(left[:3])}
    assert [got[i][:2] for i in range(4)] == [(232, 230), (232, 230), (50, 0), (240, 240)]
    kept = {r.doc_id: bytes(r.b) for r in suffixes.deduplicate(df).select("doc_id", F.col("text").cast("binary").alias("b")).collect()}
    assert kept == {0: b"", 1: b"x", 2: b"\xff" * 50, 3: b""}


def test_suffixes_deduplicate(spark):
    df = docs(spark, [*repeated_texts(), *ODD])
    got = suffixes.deduplicate(df)
    assert got.columns == df.columns and got.count() == df.count()
    assert got.where("text is null").count() == df.where("text is null").count()
    assert suffixes.report(docs(spark, [])).count() == 0


# 5. Mixing -------------------------------------------------------------------------------------


def test_rates_solve_the_least_squares(spark):
    rng = np.random.default_rng(0)
    p, n = rng.dirichlet([1, 1, 1], 400), rng.integers(1, 50, 400)
    soft = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(400)], "doc_id long, n_tokens long, p array<double>")
    residuals = mixing.fit_rates(soft, (0.6, 0.3, 0.1), rounds=300)
    r, w, goal = mixing.replay(p, residuals), n / n.sum(), np.array([0.6, 0.3, 0.1])
    loss = lambda x: 0.5 * ((w * x) @ p - goal) @ ((w * x) @ p - goal) + mixing.RIDGE / 2 * w @ (x - 1) ** 2
    slow = np.ones(400)
    for _ in range(5000):
        slow = np.maximum(0, slow - 0.5 * (p @ ((w * slow) @ p - goal) + mixing.RIDGE * (slow - 1)))
    assert (r >= 0).all() and loss(r) <= loss(slow) + 1e-9 and np.abs(r - slow).max() < 1e-3
    assert np.abs((w * r) @ p - goal).sum() < np.abs(w @ p - goal).sum()


def test_rates_reach_the_targets(spark):
    rng = np.random.default_rng(3)
    p = np.eye(3)[rng.choice(3, 3000, p=[0.76, 0.127, 0.113])]
    p = np.vstack([p, rng.dirichlet([8, 2, 0.3], 1000)])
    documents = spark.createDataFrame([(i, int(n), p[i].tolist()) for i, n in enumerate(rng.integers(1, 900, len(p)))], "doc_id long, n_tokens long, p array<double>")
    multipliers = mixing.fit_rates(documents, mixing.TARGETS, mixing.HELD)
    w = np.array([r.n_tokens for r in documents.orderBy("doc_id").collect()], float)
    reached = (w / w.sum() * mixing.replay(p, multipliers)) @ p
    assert np.abs(reached - mixing.TARGETS).max() < 5e-4


def test_mixed_table_has_the_target_shares(spark):
    sf = SF.replace("0.001", "0.1")
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = mixing.rates(documents, labels).toPandas()
    shares = [(got.rate * got.n_tokens * got[f"p_{d}"]).sum() / got.n_tokens.sum() for d in mixing.DOMAINS]
    assert np.abs(np.array(shares) - mixing.TARGETS).max() < 1e-3


def test_mixing_odd(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.rate for r in mixing.rates(docs(spark, ODD), none).collect()} == {1.0}
    assert mixing.resample(docs(spark, ODD), none).count() == len(ODD)
    documents, labels, _ = toxic_corpus(spark, 300)
    labels = labels.withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    got = mixing.rates(documents.unionByName(docs(spark, ODD)), labels).collect()
    assert len(got) == 300 + len(ODD) and all(abs(r.p_high + r.p_low + r.p_toxic - 1) < 1e-6 and r.rate >= 0 for r in got)
    assert mixing.rates(docs(spark, []), labels).count() == 0


# 6. Licences -----------------------------------------------------------------------------------


def test_license_inheritance(spark):
    data = [
        (0, "LICENSE", "Released under the MIT License."),
        (1, "a/b/x.py", "print(1)"),
        (2, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (3, "a/b/c/y.py", "no words of it"),
        (4, "z/w.py", "code\nThis work is licensed under the GNU General Public License, version 3.\n" + "code " * 100),
        (5, "z/v.py", None),
        (6, None, "plain"),
        (7, "a/q.py", ""),
    ]
    df = spark.createDataFrame(data, "doc_id long, p string, text string")
    got = {r.doc_id: (r.license, r.origin, r.license_dir) for r in licenses.scan(df, F.col("p")).collect()}
    assert got == {
        0: ("MIT", "own", None), 1: ("Apache-2.0", "inherited", "a"), 2: ("Apache-2.0", "own", None), 3: ("Apache-2.0", "inherited", "a"),
        4: ("GPL-3.0", "own", None), 5: ("MIT", "inherited", ""), 6: (None, None, None), 7: ("Apache-2.0", "inherited", "a"),
    }
    assert licenses.scan(df.limit(0), F.col("p")).count() == 0


def test_license_headers_and_files(spark):
    texts = dict(licenses.TEXTS)
    body = texts["MIT"].replace("subject to the following conditions: ", "subject to the following conditions:\n\n")
    wrapped = "\n".join("# " + " ".join(texts["GPL-3.0" if k else "MPL-2.0"].split()[i : i + 9]) for k in (0,) for i in range(0, 60, 9))
    apache = next(t for n, t in licenses.TEXTS if n == "Apache-2.0")
    header = "\n".join(" * " + " ".join(apache.split()[i : i + 11]) for i in range(0, 90, 11))
    data = [
        (0, "p/LICENSE", "The MIT License\n\nCopyright (c) 2020 Some Author\n\n" + body),
        (1, "p/src/a.py", "import os\n\nprint(os.name)"),
        (2, "q/b.java", "/*\n" + header + "\n */\n\npackage x;\n\n" + "int unrelated = computed(value);\n" * 200),
        (3, "q/c.java", "int x;"),
        (4, "r/d.c", wrapped + "\n\nint main() { return 0; }"),
        (5, "s/COPYING", "GNU GENERAL PUBLIC LICENSE\n\nPreamble\n\nThe GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n\n" + "Other paragraphs follow here at some length. " * 50),
        (6, "s/deep/er/e.c", "int y;"),
        (7, "t/essay.txt", "The software industry grants no warranty on happiness, and any person may use this copy of an essay without fee.\n\nNot a license at all."),
    ]
    df = spark.createDataFrame(data + [data[2]], "doc_id long, p string, text string")
    rows_of = sorted((r.doc_id, r.license, r.origin, r.license_dir) for r in licenses.scan(df, F.col("p")).collect())
    assert rows_of == [
        (0, "MIT", "own", None), (1, "MIT", "inherited", "p"), (2, "Apache-2.0", "own", None), (2, "Apache-2.0", "own", None), (3, None, None, None),
        (4, "MPL-2.0", "own", None), (5, "GPL-3.0", "own", None), (6, "GPL-3.0", "inherited", "s"), (7, None, None, None),
    ]


@pytest.mark.parametrize("longer", [False, True])
def test_licenses_are_told_from_their_siblings(spark, longer):
    """Every template, its versions, and texts that name no version or another one."""
    every = licenses.TEXTS if longer else licenses.TEMPLATES
    texts = [(n, t) for n, t in every]
    if longer:
        text = lambda license: next(t for n, t in every if n == license)
        texts += [("GPL-2.0", text("GPL-2.0").split(" You should")[0]), (None, next(t for n, t in every if n == "GPL-3.0").replace("version 3", "version 9"))]
        texts += [("Apache-2.0", "Copyright 2020 The Authors. " + text("Apache-2.0")), ("BSD-2-Clause", "Copyright (c) 2019, Someone. All rights reserved. " + text("BSD-2-Clause"))]
    else:
        texts += [(None, "This work is licensed under the GNU General Public License."), ("GPL-2.0", "Licensed under the GNU General Public License, version 2 or later."), (None, "Licensed under CC BY-SA 3.0.")]
        texts += [("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"), ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1"), (None, "Released under the BSD License.")]
    filler = [f"plain words of document {k} that say nothing of rights, {'x' * k}" for k in range(60)]
    given = spark.createDataFrame([(i, f"d{i}", t) for i, (_, t) in enumerate(texts)] + [(1000 + k, f"f{k}", t) for k, t in enumerate(filler)], "doc_id long, d string, text string")
    got = {r.doc_id: r.license for r in licenses.scan(given, F.concat_ws("/", "d", F.col("doc_id").cast("string"))).where("origin = 'own'").collect()}
    assert {i: got.get(i) for i in range(len(texts))} == {i: n for i, (n, _) in enumerate(texts)}


def test_license_heavy_terms_lose_nothing():
    templates = licenses.Templates()
    _, _, vectors = licenses.weights(1000, {t: 3 for t in templates.vocabulary}, templates)
    heavy = set(licenses.heavy_terms(vectors, templates.least, frozenset({"the", "license", "of"})))
    for v, least in zip(vectors, templates.least, strict=True):
        assert math.sqrt(sum(w * w for t, w in v.items() if t not in heavy)) < least


# 7. Language -----------------------------------------------------------------------------------


def test_excerpts_reach_from_beginning_to_end(spark):
    rng = random.Random(9)
    texts = ["", None, "short", "é" * 80, *("".join(rng.choices("abcdefgh ", k=n)) for n in (79, 80, 81, 500, 12_345))]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", common.excerpt("t", 80).alias("x")).collect():
        if r.t is None or len(r.t) <= 80:
            assert r.x == r.t
        else:
            parts = [r.x[k * 11 : k * 11 + 10] for k in range(8)]
            at = [k * (len(r.t) - 10) // 7 for k in range(8)]
            assert len(r.x) == 87 and parts == [r.t[a : a + 10] for a in at] and r.x.endswith(r.t[-10:])


def test_a_language_may_be_called_anything(spark):
    """An empty label is a language like others, beside the class of no language."""
    rng = random.Random(4)
    words = {"": ["alpha", "beta", "gamma", "delta"], "und": ["один", "два", "три", "четыре"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=12)), lang) for i, lang in enumerate(list(words) * 150)]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(given)
    assert model.langs == ["", "und", None]
    got = language.identify(given, model)
    assert got.where("not rejected and lang_pred = lang").count() >= 0.98 * len(rows)


def test_language_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(df)
    got = language.identify(df, model).withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).where("held").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all() and got.rejected.mean() < 0.02
    odd = {r.doc_id: r for r in language.identify(docs(spark, [*ODD, "123 ..."]), model).collect()}
    assert [odd[i].lang_pred == "und" for i in range(11)] == [True, True, True, False, False, False, False, False, True, False, True]
    assert odd[0].score == 0 and odd[0].rejected and odd[0].extra == "x"
    assert language.identify(docs(spark, []), model).count() == 0
    assert {r.lang_pred for r in language.identify(docs(spark, ODD), language.train(docs(spark, ODD, None))).collect()} == {"und"}


# 8. Top-k --------------------------------------------------------------------------------------


def vectors(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")


def test_topk_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    data = [(i, (rng.normal(size=8) * (1 + i % 3)).astype(np.float32).tolist(), 0) for i in range(700)]
    data += [(700 + i, data[i][1], 1) for i in range(50)] + [(800, None, 0), (850, [float("nan")] * 8, 0), (900, [], 0), (950, [1.0, None] * 4, 0)]
    x = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v, _ in data if i < 800}
    want = {}
    for q in (i for i in x if i % 50 == 0):
        best = sorted(((-int(x[q] @ x[c]), c) for c in x if c != q))[:5]
        want |= {(q, k + 1): (c, -s) for k, (s, c) in enumerate(best)}
    monkeypatch.setattr(topk, "SUPER", 64)
    monkeypatch.setattr(topk, "CHUNK", 4)
    monkeypatch.setattr(topk, "SUMMARIES", 3)
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(vectors(spark, data)).collect()} == want
    assert topk.search(vectors(spark, [])).count() == 0
    assert topk.search(vectors(spark, data[:3])).count() == 2


# 9. URLs ---------------------------------------------------------------------------------------


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "https://www.Example.ORG/es/1?x", "http://example.org/en/12", "http://example.org/en/2#t", "http://a.b.com/fr/", "http://com/de/x", "http://xcom/de/", "http://notexample.org/es/", "ftp://h.net?/org/", "http://example.org", "a://b://org/"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in (lambda p: urlfilter.judge(p, urlfilter.build(p)))(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in host)
        fits = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "allow")
        assert got[i] == (host, path, rule, verdict)


def test_cascade_is_exact_on_its_universe(spark):
    rng = random.Random(9)
    pages = [(i, f"http://h{rng.randrange(400)}.net/p{rng.randrange(50)}/") for i in range(4000)]
    rules = [(f"h{k}.net", f"/p{rng.randrange(50)}/", "block") for k in range(0, 400, 2)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    cascade = urlfilter.build(df, rules)
    listed = {h + p for h, p, _ in rules}
    for _, u in pages:
        host, path = u[7:].split("/", 1)
        for a, b in urlfilter.keys_of(host, "/" + path, tuple(sorted({len(p) for _, p, _ in rules}, reverse=True)), 2):
            assert ((a + b) in cascade) == ((a + b) in listed)
    assert urlfilter.build(df, []).levels == []


# 10. Vectors -----------------------------------------------------------------------------------


def slow_links(x, threshold=0.9):
    ids = list(x)
    m = np.stack([x[i] / np.linalg.norm(x[i]) for i in ids])
    a, b = np.nonzero(np.triu(m @ m.T >= threshold, 1))
    return [(ids[i], ids[j]) for i, j in zip(a, b, strict=True)]


@pytest.mark.parametrize("dim, most", [(64, 6), (256, 4)])
def test_recall_of_every_number_of_hashes(dim, most):
    rng = np.random.default_rng(1)
    assert {neardup_vectors.hashes_for(10**k, dim) for k in range(1, 30)} == set(range(1, most + 1))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(rng.normal(size=(200, dim)))
    b = rng.normal(size=a.shape)
    b = 0.9 * a + math.sqrt(1 - 0.81) * unit(b - (b * a).sum(1, keepdims=True) * a)
    for hashes in range(1, most + 1):
        x, y = (neardup_vectors.codes(v, hashes, neardup_vectors.tables_for(hashes)) for v in (a, b))
        assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(x, y, strict=True)]) >= 0.9


@pytest.mark.parametrize("block", [8, 1024])
def test_vectors_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(neardup_vectors.links, "__defaults__", (neardup_vectors.THRESHOLD, None, block))
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 32))
    x = {i: (centers[i % 12] + rng.normal(size=32) * (0.15 if i % 5 else 0.5)).astype(np.float32).astype(float) for i in range(300)}
    x |= {300 + i: x[7] for i in range(40)} | {340: 2 * x[7]}
    linked = slow_links(x)
    degree, want = Counter(i for e in linked for i in e), least_reachable(x, linked)
    odd = [(900, None, 0), (901, [], 0), (902, [0.0] * 32, 0), (903, [float("inf")] * 32, 0), (904, [1.0, 2.0], 0)]
    got = {r.vec_id: r for r in neardup_vectors.components(vectors(spark, [(i, v.tolist(), 0) for i, v in x.items()] + odd)).collect()}
    assert sum(got[i].n_links for i in x) >= 0.98 * sum(degree.values()) and all(got[i].n_links <= degree[i] for i in x)
    assert sum(got[i].component_id == want[i] for i in x) >= 0.98 * len(x)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 905))
    assert neardup_vectors.components(vectors(spark, [])).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    spark_docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = spark_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == spark_docs.columns, name
        kept = out
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
