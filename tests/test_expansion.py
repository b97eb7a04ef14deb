"""The token estimate against the tokenizer it was fitted to, parts within a budget, and synonyms by brute force."""

from __future__ import annotations

import base64
import itertools
import re

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from mentionweave import vocab as V
from mentionweave.functions import synonyms as Y
from mentionweave.functions import text as T


def encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_estimate_is_near_the_tokenizer(spark):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("text", T.token_estimate("text").alias("n")).collect()
    count = encoding()
    real = np.array([len(count.encode(r.text, disallowed_special=())) for r in texts], float)
    error = np.array([r.n for r in texts])[real >= 100] / real[real >= 100] - 1
    assert abs(np.median(error)) < 0.02 and np.abs(error).mean() < 0.04 and np.mean(np.abs(error) <= 0.15) >= 0.98 and np.abs(error).max() < 0.25


def test_parts_need_no_more_than_a_budget(spark):
    texts = ["", None, "a", "word " * 3000, "x1! " * 500, "é" * 900, "\n\n\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for budget in (1, 7, 500):
        for r in df.select("t", T.token_estimate("t").alias("n"), T.token_chunks("t", budget).alias("p")).collect():
            assert "".join(r.p) == (r.t or "") and len(r.p) <= max(1, -(-r.n // budget))
    even = df.where("t like 'word%'").select(F.explode(T.token_chunks("t", 500)).alias("p")).select(T.token_estimate("p").alias("n"))
    assert even.agg(F.max("n")).first()[0] <= 505  # a part may end within a word


def brute(name, options):
    words = re.findall("[A-Z0-9]+|[^A-Z0-9]+", " ".join(name.upper().split()))
    found = {}
    for picked in itertools.product(*[[(0, w), *((1, o) for o in options.get(w, []))] for w in words]):
        text = " ".join("".join(w for _, w in picked).split())
        changed = sum(c for c, _ in picked)
        found[text] = min(changed, found.get(text, changed))
    return {(c, t) for t, c in found.items() if t and t != " ".join(name.upper().split())}


def test_synonyms_are_the_products_of_what_words_may_be(spark):
    options = Y.synonyms()
    assert options["HOLDINGS"][0] == "" and "HLDG" in options["HOLDINGS"] and "HOLDINGS" in options["HLDG"] and "HOLDINGS" not in options["HOLDINGS"]
    names = ["Acme Holdings Inc", "ACME, INC.", "Global Tech Group-Labs Ltd", "Inc", "no synonyms here", "", None, "  two   spaces  Co ", "Medical-Medical", "TECHNOLOGYS", "Ind/Ind"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", Y.expanded("n", options, 100_000).alias("v")).collect()
    for r in got:
        assert {tuple(x) for x in r.v} == brute(r.n or "", options), r.n
        assert [x.changed for x in r.v] == sorted(x.changed for x in r.v)
    few = spark.createDataFrame([("Global Tech Group Labs Holdings Ltd",)], "n string").select(Y.expanded("n", options, 20).alias("v")).first().v
    assert 0 < len(few) <= 20 and {x.changed for x in few} == {1}  # the fewest changes are kept


def test_tails(spark):
    names = ["ACME /DE/", "ACME /DE", "ACME/CALIFORNIA", "ACME-NEW", "ACME - PRO FORMA", r"ACME \DE", "ACME/", "/DE/", "A-B/C", "plain", "", None]
    got = {r.n: r.v for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", Y.without_tail("n").alias("v")).collect()}
    assert got["ACME /DE/"] == ["ACME"] and got["ACME /DE"] == ["ACME"] and got["ACME/CALIFORNIA"] == [] and got["ACME-NEW"] == ["ACME"] and got["ACME - PRO FORMA"] == []
    assert got[r"ACME \DE"] == ["ACME"] and got["ACME/"] == [] and got["/DE/"] == [] and got["A-B/C"] == ["A-B", "A"] and got["plain"] == got[""] == got[None] == []
    assert V.TOKEN_COST
