"""Source divergence, language-model scoring and embedding whitening against brute force, traps, empty tables."""

from __future__ import annotations

import math
import os
import random
import sys
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from wellspring.llm import divergence, lm_score, whitening  # noqa: E402

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows, extra=()):
    """rows: (doc_id, text, lang, source)."""
    df = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOC)
    for c in extra:
        df = df.withColumn(c, F.lit("x"))
    return df


def audit_rows(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


def corpus(n, sources, seed=3):
    rng = random.Random(seed)
    words = ["Ab", "aB", "É", "é", "naïve", "x1y", "ß", *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(9))]
    rows = []
    for i in range(n):
        k = min(int(rng.expovariate(0.5)), len(sources) - 1)  # the first source holds a good part
        text = rng.choice([" ", "-", "\n", "\x7f"]).join(rng.choices(words[k % 20:], k=rng.choice([0, 1, 5, 40])))
        rows.append((i, text, rng.choice(["en", "en", "en", "de"]), sources[k]))
    return rows


AUDIT_TRAPS = [(1, None, "en", "s"), (2, "", None, None), (3, "alpha beta", "", None), (3, "alpha beta", "", None), (None, "alpha", None, ""),
               (4, "solo " * 30_000, "fr", "only"), (5, "one", "xx", "a"), (6, "two", "xx", "b"), (7, None, "yy", "a"), (8, None, "yy", "b"),
               (9, "tie tie", "tt", "a"), (10, "tie tie", "tt", "b"), (11, "tie tie", "tt", "c")]


@pytest.mark.parametrize("entries", [1, 40, divergence.BLOCK_ENTRIES])
def test_audit_equals_brute_force(spark, entries):
    rows = corpus(120, ["a", "b", "c", "d", None]) + AUDIT_TRAPS
    docs = documents(spark, rows, ["shard", "first", "p", "q", "idx", "rank", "hist", "term"]).repartition(5)
    got = audit_rows(divergence.audit(docs, block_entries=entries))
    assert got == brute.divergence([r[1:] for r in rows])


def test_audit_of_more_sources_than_a_cell_holds(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["aa", "bb", "cc", "dd"], k=6)), "en", f"s{i % 300:03}") for i in range(600)]
    got = audit_rows(divergence.audit(documents(spark, rows)))
    assert len(got) == len(set(got)) > 300 * 299
    assert got == brute.divergence([r[1:] for r in rows])


def test_audit_keeps_only_the_top_terms(spark):
    rows = corpus(60, ["a", "b"])
    got = audit_rows(divergence.audit(documents(spark, rows), min_docs=2, top=5))
    assert got == brute.divergence([r[1:] for r in rows], 2, 5)


def test_audit_of_nothing(spark):
    assert divergence.audit(documents(spark, [])).collect() == []


def test_a_shard_is_merged_holding_few_chunks():
    block = divergence.Block(1)
    block.add("en", "s", " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)).encode())
    chunks = sorted(divergence.chunks(block.run(10)), key=lambda c: c.terms[0])
    open_, most = [], 0

    def feed():
        nonlocal most
        for c in chunks:
            open_.append(c)
            most = max(most, len(open_) - len(out) // 10)
            yield c
    out: list = []
    for row in divergence.merged(feed(), 1):
        out.append(row)
    assert [r[1] for r in out] == sorted(r[1] for r in out) and most <= 2


VEC = "vec_id bigint, embedding array<float>, label int"


def vectors(spark, rows, extra=(), schema=VEC):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], schema)
    for c in extra:
        df = df.withColumn(c, F.lit("x"))
    return df


def check_whitening(found, rows, components=16):
    """Every figure of the result against whole-matrix arithmetic."""
    want = [(i, [math.floor(64 * float(c)) + 1000000 for c in np.float32(v).tolist()]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in want})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    exact = np.array([[n * c - t for c, t in zip(x, s)] for x in fit], float) / n
    cov = exact.T @ exact / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > 1e-12 * values.sum()).sum()))
    assert len(found) == len(want) * k
    by_id = defaultdict(list)
    for r in found:
        by_id[r.vec_id].append(r)
        assert r.n == n and 0 <= r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    for i in {i for i, _ in want} if k else ():
        mine = [x for j, x in want if j == i]
        assert len(by_id[i]) == k * len(mine)
        assert {r.deviation for r in by_id[i]} == {sum((n * c - t) ** 2 for c, t in zip(x, s)) for x in mine}
    # Components along well separated eigenvalues are the same up to one sign for all rows.
    single = {i: x for i, x in want if [j for j, _ in want].count(i) == 1}
    for c in range(1, k + 1):
        gap = min([abs(values[c - 1] - v) for j, v in enumerate(values) if j != c - 1], default=1)
        if gap > 1e-6 * values[0]:
            z = {i: (np.array(x, float) - np.array(s) / n) @ axes[:, c - 1] / values[c - 1] ** 0.5 for i, x in single.items()}
            got = {i: next(r.whitened for r in by_id[i] if r.component == c) for i in z}
            sign = np.sign(sum(got[i] * z[i] for i in z))
            assert all(got[i] * sign == pytest.approx(z[i], abs=1e-6) for i in z)


def test_whitening_equals_whole_matrix_arithmetic(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 20)) * np.geomspace(1, 0.05, 20) + rng.normal(size=20)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900 + i, rows[i][1]) for i in range(40)]  # repeated vectors count once in the fit
    rows += [(2000, rows[0][1]), (2000, rows[1][1]), (None, rows[2][1]), (2001, None), (2002, [None] + [0.0] * 19),
             (2003, [float("nan")] * 20), (2004, [float("inf")] * 20), (2005, [0.0] * 20), (2006, [])]
    got = whitening.whiten(vectors(spark, rows, ["x", "n", "component", "data", "small"]).repartition(6)).collect()
    check_whitening(got, rows)


@pytest.mark.parametrize("n,dims", [(2, 3), (1, 3), (40, 1), (30, 70)])
def test_whitening_of_few_vectors_and_dimensions(spark, n, dims):
    rng = np.random.default_rng(n)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, dims)))]
    check_whitening(whitening.whiten(vectors(spark, rows)).collect(), rows)


def test_whitening_of_nothing_and_of_one_point(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []


def test_whitening_takes_the_most_frequent_width(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [5.0, 5.5]), (4, [1.0]), (5, [1.0, 2.0, 3.0])]
    check_whitening(whitening.whiten(vectors(spark, rows)).collect(), rows[:3])


def test_whitening_of_entries_beyond_a_long(spark):
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [1e12, 3.0])]
    got = whitening.whiten(vectors(spark, rows, schema="vec_id bigint, embedding array<double>, label int")).collect()
    # Next to such entries the second dimension is rounding.
    assert [r.deviation for r in got] == [None] * 3


@pytest.mark.parametrize("shape", ["flat", "falling", "low rank", "repeated eigenvalues", "two clusters"])
def test_jacobi_davidson_reaches_double_precision(shape):
    rng = np.random.default_rng(2)
    x = {"flat": lambda: rng.normal(size=(900, 64)), "falling": lambda: rng.normal(size=(500, 300)) * np.geomspace(1, 1e-3, 300),
         "low rank": lambda: rng.normal(size=(400, 5)) @ rng.normal(size=(5, 90)), "repeated eigenvalues": lambda: np.vstack([np.eye(50), -np.eye(50)]),
         "two clusters": lambda: rng.normal(size=(800, 150)) * np.repeat([3.0, 1.0], [20, 130])}[shape]()
    x = x - x.mean(0)
    cov = x.T @ x / len(x)
    values, axes = whitening.jacobi_davidson(lambda u: cov @ u, len(cov), 16)
    want = np.linalg.eigvalsh(cov)[::-1][:16]
    assert np.abs(values - want).max() <= 1e-13 * want[0]
    assert np.linalg.norm(cov @ axes - axes * values, axis=0).max() <= 1e-13 * want[0]
    assert np.abs(axes.T @ axes - np.eye(16)).max() < 1e-12


LONG = " ".join(f"word{i}" for i in range(30_000))
TOKEN_TRAPS = [(1, "A b a B"), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (6, "a \x0b b\x0cC"), (None, "a b"), (None, "zz"), (7, "É é naïve"),
               (8, "a a a"), (8, "a a a"), (8, "b"), (10, "unseen words here")]


def test_base_scores_equal_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    rows = TOKEN_TRAPS + [(100 + i, " ".join(rng.choices("a b c d e f g".split(), k=rng.randint(0, 50)))) for i in range(150)]
    # Several shards and several copies of each.
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 9000)
    monkeypatch.setattr(lm_score, "SALT_TOKENS", 4000)
    docs = documents(spark, [(i, t, None, None) for i, t in rows], ["rid", "shard", "w", "n", "model", "salt", "key"]).repartition(5)
    got = lm_score.score(docs)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (r[0] is None, *(v or 0 for v in r[:1]), *r[1:4], round(r[5], 6))
    found = sorted((tuple(r)[:6] for r in got.collect()), key=key)
    want = sorted(brute.token_counts(rows)[0], key=key)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert [r[5] for r in found] == pytest.approx([r[5] for r in want], rel=1e-9)


def test_scores_equal_the_models_probabilities_token_by_token(spark, monkeypatch):
    """A plain replay: the rounds' steps in order, then each token's class, member and share."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["a b c", "b c d", "x y"], k=rng.randint(1, 20)))) for i in range(60)]
    docs = documents(spark, [(i, t, None, None) for i, t in rows]).coalesce(1)
    models = []
    fit = lm_score.train
    monkeypatch.setattr(lm_score, "train", lambda *a: models.append(fit(*a)) or models[-1])
    got = {r.doc_id: r.score for r in lm_score.score(docs).collect()}
    model, tokens = models[0], lm_score.Tokens()
    assert np.abs(model.classes).max() > 0
    _, count = brute.token_counts(rows)
    hashed = {w: int(tokens(b"" if w is None else w.encode())[0]) for w in {None, "a", "b", "c", "d", "x", "y"}}
    cells = lm_score.CLASSES * lm_score.MEMBERS
    inside = {b: (sum(c for w, c in count.items() if hashed[w] % cells == b), sum(hashed[w] % cells == b for w in count)) for b in range(cells)}
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    for i, text in rows:
        words = [*text.split(), None]
        hashes = np.array([hashed[w] for w in words], np.uint64)
        context, total = lm_score.contexts([hashes]), 0.0
        for k, w in enumerate(words):
            b = hashed[w] % cells
            at = model.rows(context[k:k + 1], np.array([b]))
            one = softmax(model.class_bias.astype(float) + sum(model.classes[r].astype(float) for r in at[0][0]))
            two = softmax(model.member_bias[b // lm_score.MEMBERS].astype(float) + sum(model.members[r].astype(float) for r in at[1][0]))
            n, v = inside[b]
            total += math.log10(one[b // lm_score.MEMBERS] * two[b % lm_score.MEMBERS] * (count[w] + 0.1) / (n + 0.1 * (v + 1)))
        assert got[i] == pytest.approx(total, rel=1e-4)


def test_the_models_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 9, lm_score.CLASSES * lm_score.MEMBERS).astype(float)
    trainer = lm_score.Trainer(lm_score.Model.of_counts(counts))
    tokens = rng.integers(0, 1 << 60, 20_000).astype(np.uint64)
    for at in range(0, 20_000, 4000):
        trainer.step(tokens[at:at + 4000], lm_score.contexts([tokens[at:at + 4000]]))
    every = np.arange(lm_score.CLASSES * lm_score.MEMBERS, dtype=np.uint64)
    context = np.repeat(lm_score.contexts([tokens[:9]])[8:9], len(every), axis=0)
    assert np.exp(trainer.model.score(every, context)).sum() == pytest.approx(1, abs=1e-5)


def test_contexts_stay_in_their_text():
    a, b = np.array([1, 2, 3], np.uint64), np.array([2, 3], np.uint64)
    both = lm_score.contexts([a, b])
    assert (both[:3] == lm_score.contexts([a])).all() and (both[3:] == lm_score.contexts([b])).all()
    assert (both[0] == both[3]).all() and both[1, 0] != both[4, 0]


def test_group_sums_equal_a_plain_sum():
    rng = np.random.default_rng(4)
    for hot in (0, 1, 500):
        ids = np.sort(np.concatenate([rng.integers(0, 300, 900), np.zeros(hot, int)]))
        rows = rng.normal(size=(len(ids), 4))
        edge = np.flatnonzero(np.diff(ids, prepend=-1))
        assert np.allclose(lm_score.group_sums(rows, edge), [rows[ids == i].sum(0) for i in ids[edge]])


def test_model_scores_beat_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    once, again = ([tuple(r) for r in lm_score.score(docs).where("held_out").orderBy("doc_id").collect()] for _ in range(2))
    assert sum(r[6] for r in once) > sum(r[5] for r in once)
    assert [r[6] for r in once] == pytest.approx([r[6] for r in again], rel=1e-12)  # reruns agree


def test_lm_score_of_nothing_and_of_nothing_to_learn_from(spark):
    assert lm_score.score(documents(spark, [])).collect() == []
    got = lm_score.score(documents(spark, [(None, "a b", None, None)])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in got] == [(3, 0, 0, 0.0)]
