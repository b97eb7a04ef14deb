"""All ten operators and the pipeline's stages on odd tables: nulls, empty tables, repeated rows, ties, long texts, clashing names, bytes that are no UTF-8."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mentionweave.llm import bpe, language, licenses, mixing, neardup_vectors, simhash, suffixes, topk, toxicity, urlfilter

from ..compare import SF

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Names that operators use inside or give to their results.
CLASH = ["score", "lang_pred", "rejected", "held_out", "predicted", "key", "salt", "removed", "wanted", "mark", "r1", "fp", "u", "__u", "rate", "p", "n_tokens", "ids", "decoded", "copy", "own", "letter", "own_0", "band", "node"]
TEXTS = [None, "", " \n\t", "a", "...", "same text here", "same text here", "é" * 300, "word " * 60_000, "\u0000", "日本語 😀", "x" * 4000, "The quick brown fox jumps over the lazy dog and runs away from it all."]


def rows(texts=TEXTS, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "en" if k % 2 else None, "s", len(t or ""), *[k] * len(CLASH)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


def table(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASH))


@pytest.fixture(scope="module")
def documents(spark):
    """Odd rows, each twice, some without an id or under one id, and texts that are no UTF-8."""
    odd = table(spark, [*rows(), *rows(), *rows(ids=[None] * len(TEXTS)), *rows(["one text under the id 7 of two", "another text under the id 7 altogether"], [7, 7])])
    broken = spark.createDataFrame([(100 + i, bytearray(b)) for i, b in enumerate((b"\xff\xfe" * 150, b"abc \xc3", b"\xe2\x82 text"))], "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    return odd.unionByName(broken, allowMissingColumns=True).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    real = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic")
    return real.unionByName(spark.createDataFrame([(None, 1, 1), (5, 1, 0), (5, 0, 1), (6, None, None), (10**9, 1, 1)], "doc_id long, quality int, toxic int"))


@pytest.fixture(scope="module")
def many(spark, documents):
    """The odd rows among real ones, so that models can be trained."""
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    return documents.unionByName(real, allowMissingColumns=True).cache()


def clean(data):
    return (data or "").encode("utf-8", "replace") if isinstance(data, str) or data is None else bytes(data)


def counted(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_toxicity(many, documents, labels):
    model = toxicity.train(many, labels)
    got = toxicity.score(documents, model)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and counted(got, "doc_id") == counted(documents, "doc_id")
    assert got.where("not score between 0 and 1 or predicted <> cast(score >= 0.5 as int)").count() == 0
    assert got.where("doc_id is null and held_out").count() == 0
    assert toxicity.score(documents.limit(0), toxicity.train(documents.limit(0), labels.limit(0))).count() == 0


def test_bpe(documents):
    got = bpe.digests(documents, VOCABULARY, public_tokenizers.PATTERN)
    texts = [bytes(b).decode("utf-8", "replace") if b is not None else "" for (b,) in documents.select(F.col("text").cast("binary")).collect()]
    assert counted(got, "decoded_sha256") == Counter((hashlib.sha256(t.encode()).hexdigest(),) for t in texts)
    assert bpe.digests(documents.limit(0), VOCABULARY, public_tokenizers.PATTERN).count() == 0
    there = bpe.decode_column(bpe.encode_column(documents, VOCABULARY, public_tokenizers.PATTERN), VOCABULARY, public_tokenizers.PATTERN)
    assert sorted(there.columns) == sorted(documents.columns) and counted(there, "n_chars", "copy") == counted(documents, "n_chars", "copy")
    assert there.where("doc_id < 50 and coalesce(text, '') <> decoded").count() == 0


def test_simhash(documents):
    got = simhash.report(documents)
    assert counted(got, "doc_id") == counted(documents, "doc_id") and got.where("length(fingerprint) <> 16").count() == 0
    zero = got.where("fingerprint = '0000000000000000'").select("component_id").distinct().collect()
    assert [r.component_id for r in zero] == [0]
    assert simhash.report(documents.limit(0)).count() == 0


def test_simhash_links_through_rows_without_an_id(spark, monkeypatch):
    prints = [(1, 0b0000), (None, 0b0011), (2, 0b1111), (None, 0b1111 << 40), (9, 0xFFFF << 20)]
    monkeypatch.setattr(simhash, "fingerprints", lambda df: spark.createDataFrame(prints, "doc_id long, fp long"))
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.components(None).collect()}
    assert got == {(1, 0): 1, (None, 3): 1, (2, 15): 1, (None, 15 << 40): None, (9, 0xFFFF << 20): 9}


def test_suffixes(documents):
    got = suffixes.report(documents)
    size = documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    assert counted(got, "doc_id", "n_bytes") == counted(size, "doc_id", "n_bytes")
    cut = suffixes.deduplicate(documents)
    assert cut.columns == documents.columns and counted(cut, "doc_id", "key", "own_0") == counted(documents, "doc_id", "key", "own_0")
    assert cut.where("doc_id = 8 and text <> ''").count() == 0 and suffixes.deduplicate(documents.limit(0)).count() == 0


def test_mixing(many, documents, labels):
    got = mixing.rates(many, labels)
    assert counted(got, "doc_id") == counted(many, "doc_id") and got.where("rate < 0 or abs(p_high + p_low + p_toxic - 1) > 1e-6").count() == 0
    drawn = mixing.resample(many, labels)
    assert drawn.columns == many.columns and counted(drawn, "doc_id", "text") == counted(mixing.resample(many, labels), "doc_id", "text")
    assert mixing.resample(documents.limit(0), labels).count() == 0 and mixing.rates(documents, labels.limit(0)).where("rate <> 1").count() == 0


def test_rates_of_a_whole_table_are_those_of_the_least_squares(spark, labels):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.rates(real, labels).orderBy("doc_id").toPandas()
    p, w = got[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy(), got.n_tokens.to_numpy() / got.n_tokens.sum()
    goal, slow = np.array(mixing.TARGETS), np.ones(len(got))
    loss = lambda r: 0.5 * (((w * r) @ p - goal) ** 2).sum() + mixing.HELD / 2 * w @ (r - 1) ** 2
    for _ in range(20_000):  # plain projected gradient
        slow = np.maximum(0, slow - 0.9 * (p @ ((w * slow) @ p - goal) + mixing.HELD * (slow - 1)))
    assert loss(got.rate.to_numpy()) <= loss(slow) + 1e-9


def test_licenses(documents):
    got = licenses.scan(documents, F.col("source"))
    assert counted(got, "doc_id") == counted(documents, "doc_id") and got.where("license is not null").count() == 0
    lined = documents.withColumn("text", F.concat_ws("\n", "text", F.lit("Released under the MIT License.")))
    assert licenses.scan(lined, F.lit(None).cast("string")).where("license <> 'MIT' or origin <> 'own' or path is not null").count() == 0
    assert licenses.scan(documents.limit(0), F.col("source")).count() == 0


def test_language(many, documents):
    model = language.train(many)
    got = language.identify(documents, model)
    assert set(got.columns) == set(documents.columns) and counted(got, "doc_id", "copy") == counted(documents, "doc_id", "copy")
    assert got.where("doc_id in (0, 1, 2, 4) and (lang_pred <> 'und' or score <> 0 or not rejected)").count() == 0
    kept = language.reject(documents, model)
    assert kept.columns == documents.columns and kept.where("text is null").count() == 0
    assert language.reject(documents, None).count() == 0 and language.identify(documents.limit(0), model).count() == 0


UNSEEN = {
    "hu": "A magyar nyelv az uráli nyelvcsalád tagja, a finnugor nyelvek közé tartozó ugor nyelvek egyike. Legközelebbi rokonai a manysi és a hanti nyelv.",
    "fi": "Suomen kieli eli suomi on uralilaisten kielten itämerensuomalaiseen ryhmään kuuluva kieli, jota puhuvat pääosin suomalaiset.",
    "pl": "Język polski jest językiem z grupy zachodniosłowiańskiej, stanowiącej część rodziny języków indoeuropejskich.",
    "ru": "Русский язык является одним из восточнославянских языков, национальным языком русского народа.",
    "ja": "日本語は、日本国内や、日本人同士の間で使われている言語。日本は法令によって公用語を規定していない。",
    "tr": "Türkçe, Güneydoğu Avrupa ve Batı Asya'da konuşulan, Türk dilleri dil ailesine ait sondan eklemeli bir dildir.",
    "cs": "Čeština neboli český jazyk je západoslovanský jazyk, nejbližší slovenštině, poté lužické srbštině a polštině.",
    "vi": "Tiếng Việt là ngôn ngữ của người Việt và là ngôn ngữ chính thức tại Việt Nam.",
    "ar": "اللغة العربية هي أكثر اللغات السامية تحدثا وإحدى أكثر اللغات انتشارا في العالم",
    "letters": "xkq wzzrt plmvb qqe zxcv bnmlk jhgf qwrt ypsd fghjk lzxc vbnm trewq",
    "hex": "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08 a94a8fe5ccb19ba61c4c0873d391e987982fbbd3",
    "base64": "TG9yZW0gaXBzdW0gZG9sb3Igc2l0IGFtZXQsIGNvbnNlY3RldHVyIGFkaXBpc2NpbmcgZWxpdC4gU2VkIGRv",
}


def test_language_rejects_what_it_has_not_learned(spark):
    real = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    model = language.train(real)
    unseen = spark.createDataFrame(list(UNSEEN.items()), "id string, text string")
    assert language.identify(unseen, model).where("rejected").count() >= 0.9 * len(UNSEEN)
    assert language.identify(real, model).where("text is not null and rejected").count() <= 0.01 * real.count()
    assert 0.003 < model.temperature < 9


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "SUPER", 16)
    monkeypatch.setattr(topk, "BLOCK", 4)
    rng = random.Random(5)
    vectors = {i: [float(rng.randrange(-3, 4)) for _ in range(4 if i % 7 else 3)] for i in range(300)}  # many ties, two lengths
    vectors |= {300: [1e30, -1e30, 3.0], 301: [1e30, 1e30], 350: [2e38, 2e38, 0.0, 1.0]}
    odd = [(None, [1.0]), (400, None), (450, []), (500, [1.0, None]), (550, [float("inf")])]
    df = spark.createDataFrame([*vectors.items(), *odd], "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("chunk", F.lit(1))
    ints = {i: [int(np.floor(256 * x)) for x in v] for i, v in vectors.items()}
    cut = lambda x: max(-(2**63), min(2**63 - 1, x))
    want = set()
    for q in (i for i in ints if i % 50 == 0):
        best = sorted((-cut(sum(a * b for a, b in zip(ints[q], v))), c) for c, v in ints.items() if c != q)[:5]  # noqa: B905
        want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    assert set(counted(topk.search(df), "query_id", "rank", "vec_id", "score")) == want
    assert topk.search(df.limit(0)).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(None, "http://a.org/x"), (1, None), (1, None), (2, "http://A.example.ORG/es/1"), (2, "http://A.example.ORG/es/1"), (3, "x" * 100_000), (4, "http://" + "a." * 5000 + "com/de/" + "y" * 50_000)], "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("host", F.lit(2))
    got = urlfilter.judge(pages, urlfilter.build(pages))
    assert counted(got, "page_id", "rule", "verdict") == Counter({(None, "org/", "allow"): 1, (1, None, "allow"): 2, (2, "example.org/es/", "block"): 2, (3, None, "allow"): 1, (4, "com/de/", "block"): 1})
    assert urlfilter.judge(pages.limit(0), urlfilter.build(pages.limit(0))).count() == 0


def test_vectors(spark):
    data = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1e30, 0.0]), (8, [1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("n", F.lit(1)).withColumn("component_id", F.lit(0))
    got = counted(neardup_vectors.components(df), "vec_id", "n_links", "component_id", "kept")
    want = {(1, 4, 1, True): 2, (None, 4, 1, None): 1, (2, 4, 1, False): 1, (7, 4, 1, False): 1, (3, 0, 3, True): 1, (4, 0, 4, True): 1, (5, 0, 5, True): 1, (6, 0, 6, True): 1, (8, 0, 8, True): 1}
    assert got == Counter(want)
    assert neardup_vectors.components(df.limit(0)).count() == 0


def test_pipeline_stages(spark, many, documents):
    import corpus_pipeline

    for data in (many, documents.limit(0)):
        docs = data
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == many.columns, name
            docs = out.cache()
            assert set(counted(docs, "doc_id")) <= set(counted(data, "doc_id")), name
        assert corpus_pipeline.encode(spark, docs, SF).count() == docs.count()


def test_pipeline_rows(spark):
    """What run() gives is what the operators give one after another."""
    import corpus_pipeline
    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    ranks = bpe.Transducer.from_file(VOCABULARY, public_tokenizers.PATTERN).ranks
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = theirs.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert counted(corpus_pipeline.run(spark, SF), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
