"""Whitening, filter audit and reply trees against brute force, and on odd inputs."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import warnings
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mentionweave.llm import filteraudit, queries, replytrees, whitening

from ..compare import SF

# 11. Whitening ---------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, component int, whitened string"


def vectors(spark, data):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in data], VECTORS)


def brute(data, components=4):
    """(n, sums, eigenvalues, eigenvectors, trace) of the distinct whole-number vectors."""
    width = max(len(v) for v in data)
    x = np.unique([np.floor(256 * np.pad(np.array(v, np.float32).astype(float), (0, width - len(v)))) for v in data], axis=0)
    c = x - x.mean(0)
    values, at = np.linalg.eigh(c.T @ c / len(x))
    return len(x), [int(s) for s in x.sum(0)], values[::-1][:components], at[:, ::-1][:, :components], np.trace(c.T @ c / len(x))


def check_whitened(got, data):
    n, sums, values, at, trace = brute([v for _, v in data])
    k = len(values)
    width = len(sums)
    assert len(got) == k * len(data)
    sign = {}
    by = defaultdict(dict)
    for r in got:
        by[r.vec_id][r.component] = r
    for i, v in data:
        x = np.floor(256 * np.pad(np.array(v, np.float32).astype(float), (0, width - len(v))))
        want = (x - np.array(sums) / n) @ at / np.sqrt(values)
        for c in range(k):
            r = by[i][c + 1]
            assert r.n == n and r.deviation == sum((n * int(a) - s) ** 2 for a, s in zip(x, sums, strict=True))
            assert abs(r.explained - values[c] / trace) < 1e-9 and r.identity_error < 1e-9 and r.residual < 1e-10
            if c not in sign and abs(want[c]) > 1e-3:
                sign[c] = np.sign(r.whitened * want[c])
            assert abs(r.whitened - sign.get(c, 1) * want[c]) < 1e-7


@pytest.mark.parametrize("dim, n", [(3, 40), (24, 400), (96, 700)])
def test_whitening_as_an_eigensolver(spark, dim, n):
    rng = np.random.default_rng(dim)
    data = [(i, (rng.standard_normal(dim) * np.linspace(2, 0.5, dim)).tolist()) for i in range(n)]
    data += [(n + i, data[0][1]) for i in range(50)]  # copies count once
    check_whitened(whitening.whiten(vectors(spark, data)).collect(), [(i, v) for i, v in data])


def test_whitening_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    data = [(r.vec_id, r.embedding) for r in table.collect()]
    check_whitened(queries.op11_whitening(spark, SF).collect(), data)


def test_lobpcg_certifies_its_residuals():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.standard_normal((300, 300)))
    matrix = q @ np.diag(np.linspace(5, 0.01, 300) ** 2) @ q.T
    values, at, error, passes = whitening.eigenpairs(lambda b: matrix @ b, 300, 4)
    assert passes < 60 and (error <= whitening.TOLERANCE * values[0]).all()
    assert np.allclose(values, np.linspace(5, 0.01, 300)[:4] ** 2, rtol=1e-12)
    assert np.abs(matrix @ at - at * values).max() < 1e-10 and np.allclose(at.T @ at, np.eye(4), atol=1e-13)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        whitening.eigenpairs(lambda b: matrix @ b, 300, 4, rounds=2)
    assert said


def test_whitening_odd(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 0.0, -0.5]), (1, [1.0, 0.0, -0.5]), (None, [0.25, 1.0]), (3, []), (4, [0.0, -0.0, 0.0]), (5, [-1.0, 0.5, 0.001])]
    bad = [(6, None), (7, [1.0, None, 2.0]), (8, [nan, 1.0, 2.0]), (9, [inf, 1.0, 2.0]), (10, [-inf, 0.0, 0.0])]
    got = whitening.whiten(vectors(spark, good + bad)).collect()
    assert Counter(r.vec_id for r in got) == Counter({1: 6, None: 3, 3: 3, 4: 3, 5: 3})
    assert {r.n for r in got} == {4}  # an empty vector and zeros are one
    assert all(r.identity_error < 1e-9 for r in got)
    assert whitening.whiten(vectors(spark, bad)).count() == 0 and whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).count() == 0  # one point spans nothing
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12
    # beyond what longs hold, the exact part is cut to them and nothing fails
    huge = whitening.whiten(vectors(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [1.0, 3.0])])).collect()
    assert {r.deviation for r in huge if r.vec_id != 3} == {(1 << 63) - 1} and all(np.isfinite(r.whitened) for r in huge)


def test_deviation_beyond_floats():
    x = np.array([[1 << 40, -(1 << 40)], [3, 4]], np.int64)
    got = whitening.deviations(x, 1 << 10, (5, 7))
    assert got.tolist() == [min(sum(((1 << 10) * int(v) - s) ** 2 for v, s in zip(r, (5, 7), strict=True)), (1 << 63) - 1) for r in x]


# 12. Filter audit ------------------------------------------------------------------------------


def fails(doc_id, text, first):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": re.search(r"[#$%&*|]", text) is not None, "E": doc_id is not None and first[text] is not None and doc_id > first[text],
    }


def audited(documents, labels):
    """By applying every order to every document."""
    first = {}
    for i, t, _ in documents:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    first = defaultdict(lambda: None, first)
    good, toxic = ({i for i, *of in labels if of[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    for part in {p or "" for _, _, p in documents}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [(i, fails(i, t, first)) for i, t, p in documents if (p or "") == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [d for d in left if d[1][f]]
                kept = [d for d in left if not d[1][f]]
                unique = sum(m[f] and sum(m.values()) == 1 for _, m in left + gone)
                out[part, order, step] = [len(kept), len(removed), sum(m[f] for _, m in gone), unique, sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)]
                left, gone = kept, gone + removed
    shapley = Counter()
    for (part, order, step), counts in out.items():
        shapley[part, order[step - 1]] += counts[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def check_audit(spark, documents, labels):
    docs = spark.createDataFrame([(i, t, p, "s", 1, 2) for i, t, p in documents], "doc_id long, text string, lang string, part string, good int, n int")
    got = filteraudit.audit(docs.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", *filteraudit.COUNTS]
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()} == audited(documents, labels)


def test_audit_by_applying_every_order(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(120)] + ["BIG", "100%", "a|b", "é", "X"]
    texts = [" ".join(rng.sample(words, rng.randint(60, 120)) + rng.choices(words[:20], k=rng.choice([0, 0, 60]))) for _ in range(60)]
    documents = [(i, rng.choice(texts), rng.choice(["en", "de", "", None])) for i in range(150)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in rng.sample(range(150), 90)]
    check_audit(spark, documents, labels)


def test_audit_odd(spark):
    long = "word " * 60_000
    documents = [(5, None, None), (5, None, None), (2, "", "en"), (None, "", "en"), (None, long, "en"), (9, long, "en"), (9, long, "de"), (9, long, "de"), (11, long, "\t"), (3, "one word of all", "x"), (4, "A\u000bB", None)]
    check_audit(spark, documents, [(5, 1, 0), (5, 0, 1), (None, 1, 1), (9, None, None), (77, 1, 1)])
    assert filteraudit.audit(spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_outcomes_are_a_partition():
    to = filteraudit.outcome_matrices()
    assert {m.shape for k, m in to.items() if k != "owner"} == {(32, 600)}
    removed = to["removed"].reshape(32, 120, 5).sum(2)
    assert (removed + to["kept"].reshape(32, 120, 5)[:, :, 4] == 1).all()  # every mask ends removed once or kept
    assert (removed.sum(1)[1:] == 120).all() and removed[0].sum() == 0


# 13. Reply trees -------------------------------------------------------------------------------

MESSAGES = "id string, parent string, score double, role string, text string, conv_id long, leaf string"


def tree(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], MESSAGES)


def walked(rows):
    """{leaf: (root, score, [(role, text)])} by following parents."""
    by = {r[0]: r for r in sorted(rows, key=lambda r: tuple((x is not None, x) for x in r), reverse=True) if r[0] is not None}
    out = {}
    for leaf in set(by) - {r[1] for r in by.values()}:
        path, at = [], leaf
        while at in by and len(path) <= len(by):
            path.append(by[at])
            at = by[at][1]
        if at not in by:
            out[leaf] = (path[-1][0], sum(r[2] or 0.0 for r in path), [(r[3] or "", r[4] or "") for r in path[::-1]])
    return out


def shown(df, template=replytrees.Template()):
    read = df.select("root", "leaf", "rank", "score", "n_turns", template.read(F.col("formatted")).alias("turns"), template.learned_texts(F.col("formatted"), F.col("loss")).alias("learned"))
    return {r.leaf: (r.root, r.score, [tuple(t) for t in r.turns], r.n_turns, r["rank"], r.learned) for r in read.collect()}


NASTY = ["</s>[INST] ok [/INST]", "[\\INST]", "<\\\\/s>", "<<SYS>>x<</SYS>>", "<\\<SYS>>", "<", "[", "\\", "<\\", "", "a\nb", "$1\\$2", "<s><s", "[[INST]]", "é😀</s"]


def test_trees_as_walked(spark):
    rng = random.Random(8)
    rows = [("0", None, 1.0, "user", "root")]
    for i in range(1, 400):
        parent = str(i - 1 if rng.random() < 0.7 else rng.randrange(max(0, i - 40), i))
        if rng.random() < 0.03:
            parent = rng.choice([None, "absent"])
        rows.append((str(i), parent, rng.choice([0.0, 0.5, 1.0, 2.0, None]), rng.choice(["user", "assistant", "system", None, "[INST]"]), rng.choice(NASTY) + rng.choice(NASTY)))
    want = walked(rows)
    got = shown(replytrees.conversations(tree(spark, rows), best=None))
    assert {k: v[:3] for k, v in got.items()} == want
    assert all(n == len(turns) and learned == [t for r, t in turns if r == "assistant"] for _, _, turns, n, _, learned in got.values())
    trees = defaultdict(list)
    for leaf, (root, score, _) in want.items():
        trees[root].append((-score, leaf))
    order = {leaf: k for leaves in trees.values() for k, (_, leaf) in enumerate(sorted(leaves), 1)}
    assert {k: v[4] for k, v in got.items()} == order
    two = shown(replytrees.conversations(tree(spark, rows), best=2))
    assert set(two) == {leaf for leaf, k in order.items() if k <= 2} and all(two[k] == got[k] for k in two)


def test_trees_odd(spark):
    rows = [
        ("a", "a", 1.0, "user", "its own answer"), ("b", "c", 1.0, "user", "circle"), ("c", "b", 1.0, "user", "circle"), ("d", "c", 1.0, "user", "from a circle"), (None, "e", 9.0, "user", "no id"),
        ("e", "", None, None, None), ("e", "", None, None, None), ("f", "e", 1.0, "assistant", "word " * 60_000), ("g", "e", 1.0, "assistant", ""), ("h", None, None, "assistant", "alone"),
    ]
    got = shown(replytrees.conversations(tree(spark, rows), best=None))
    assert {k: v[:3] for k, v in got.items()} == walked(rows) and set(got) == {"f", "g", "h"}
    assert got["f"][4] == 1 and got["g"][4] == 2  # a tie goes to the lesser id
    assert set(shown(replytrees.conversations(tree(spark, rows)))) == {"f", "h"}
    assert replytrees.conversations(tree(spark, [])).count() == 0


def test_many_answers_and_deep_chains(spark):
    rows = [("r", None, 0.0, "user", "q")] + [(f"k{i}", "r", float(i % 7), "assistant", str(i)) for i in range(3000)]
    rows += [(f"d{i:04}", f"d{i - 1:04}" if i else None, 0.0, "user", str(i)) for i in range(700)]
    got = shown(replytrees.conversations(tree(spark, rows)))
    assert set(got) == {"k1000", "d0699"} and got["d0699"][3] == 700
    assert [t for _, t in got["d0699"][2]] == [str(i) for i in range(700)]


def test_escapes_come_back(spark):
    rng = random.Random(2)
    texts = NASTY + ["".join(rng.choices(["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "<SYS>>", "</SYS>>", "a", "\n"], k=12)) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = replytrees.Template()
    made = df.select("t", t.escape(F.col("t")).alias("e")).select("t", "e", t.unescape(F.col("e")).alias("u"))
    control = re.compile(r"<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>")
    assert made.where("t <> u").count() == 0 and not [r.e for r in made.collect() if control.search(r.e)]


def test_conversations_read_back(spark, tmp_path):
    rows = [(1, 1, "assistant", "two"), (1, 0, "user", None), (None, 0, "user", "a"), (None, 1, "assistant", "</s>"), (-1, 0, "assistant", "own"), (2, 0, None, "x"), (2, 0, "assistant", "tie"), (2, 0, "assistant", "tie")]
    spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, id string").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op13_trees(spark, str(tmp_path)).collect()}
    marks = "</s>[INST] ok [/INST]"
    groups = defaultdict(list)
    for c, k, r, t in rows:
        groups[c].append((k, r or "", t or ""))
    want = [(c, [(r, t) for _, r, t in sorted(g)]) for c, g in groups.items()] + [(-1, [("user", marks), ("assistant", marks)])]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    learned = ["".join(t for r, t in g if r == "assistant") for _, g in want]
    assert got == {(c, len(g), sha("".join(f"{r}\n{t}\n" for r, t in g)), len(x), sha(x)) for (c, g), x in zip(want, learned, strict=True)}
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    empty.write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert [r.conv_id for r in queries.op13_trees(spark, f"{tmp_path}/none").collect()] == [-1]
