"""Line dedup, licences, mixing, toxicity, language ID: traps, empty tables, clashing names."""

from __future__ import annotations

import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from wellspring.llm import langid, licenses, line_dedup, mixing, toxicity  # noqa: E402

LONG = " ".join(f"word{i}" for i in range(30_000))
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that operators use inside.
CLASH = ["row", "th", "h", "k", "size", "kept", "score", "copies", "component", "vid", "doc_id__", "copy_no", "mix_copy_no", "Copy_No_"]


def documents(spark, rows, extra=()):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)
    for c in extra:
        df = df.withColumn(c, F.lit("x"))
    return df


TRAPS = [(1, "Same line\nown one"), (2, "  same LINE\t\nown two\n"), (3, "same line\nsame line"), (3, "same line\nsame line"),
         (4, None), (5, ""), (6, "\n\n \n"), (None, "same line\nx"), (None, "same line\nx"), (None, "x\ny"), (7, LONG),
         (8, "É same line"), (9, "é same line\n" + LONG)]


def test_line_dedup_equals_brute_force(spark):
    got = line_dedup.line_dedup(documents(spark, TRAPS, CLASH), min_docs=3)
    found = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()), key=repr)
    assert found == sorted(brute.lines(TRAPS, 3), key=repr)


def test_line_dedup_keeps_the_input_columns(spark):
    docs = documents(spark, TRAPS, CLASH)
    got = line_dedup.like_input(line_dedup.line_dedup(docs, min_docs=3), docs)
    assert got.columns == docs.columns
    assert all(r.n_chars == len(r.text) and r.row == "x" for r in got.collect())


def test_line_dedup_of_nothing(spark):
    assert line_dedup.line_dedup(documents(spark, [])).collect() == []


def test_line_dedup_counts_code_points(spark):
    rows = [(i, "é\nab") for i in range(4)]
    got = line_dedup.line_dedup(documents(spark, rows), min_docs=4, min_len=2).collect()
    assert {r.kept for r in got} == {"é"}


def test_long_training_texts_keep_their_smallest_features(spark, monkeypatch):
    """Bounded features learn the same rule; a text and its swap are cut alike."""
    import pyarrow as pa
    letters = "abcdefghijklmnop"
    text = " ".join(a + b + c for a in letters for b in letters for c in letters) + " the women said"
    part = pa.RecordBatch.from_pylist([{"y": 1, "text": text.encode()}, {"y": 0, "text": b"the men said"}])
    monkeypatch.setattr(toxicity, "MAX_FEATURES", 200)
    got = next(toxicity._training_rows(iter([part]))).to_pylist()
    assert 150 <= len(got[0]["own"]) <= 200 and len(got[1]["own"]) < 20
    whole = toxicity.Features()(text.encode()).view("int64").tolist()
    assert got[0]["own"] == whole[:len(got[0]["own"])]
    assert len(set(got[0]["own"]) ^ set(got[0]["swapped"])) <= len(set(whole) ^ set(toxicity.Features()(toxicity.swapped(text.encode())).view("int64").tolist()))


def test_documents_without_evidence_stay(spark):
    docs = documents(spark, [(i, f"only{i}") for i in range(20)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, toxic int")
    balanced = labels.where("crc32(cast(doc_id as string)) % 5 <> 0")
    both = balanced.groupBy("toxic").count().agg(F.min("count")).first()[0]
    picked = balanced.where("toxic = 0").limit(both).union(balanced.where("toxic = 1").limit(both))
    assert toxicity.drop_toxic(docs, picked).count() == 20


def test_license_base_places_equal_a_plain_search():
    rng = random.Random(4)
    vocabulary = "a b c d".split()
    phrase = lambda n: " ".join(rng.choices(vocabulary, k=rng.randint(1, n)))
    for _ in range(500):
        base = [(phrase(4), f"l{i}") for i in range(3)]
        templates = [(f"t{i}", phrase(8)) for i in range(3)]
        scanner = licenses.Scanner(base, templates, 2, 1, 0.5)
        text = " ".join(rng.choices([*vocabulary, "x"], k=rng.randint(0, 30)))
        w = text.split()
        at = [(i, label) for p, label in base for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        got = scanner(text.encode())
        assert got["n_base"] == len(at)
        assert (got["first_word"], got["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert got["base_labels"] == ",".join(sorted({x for _, x in at}))
        for label, p in templates:
            if any(w[i:i + len(p.split())] == p.split() for i in range(len(w))):
                assert label in got["labels"].split(",")


def test_license_chain_bridges_a_changed_word():
    text = dict(licenses.TEMPLATES)["bsd"].replace("forms", "shapes")
    got = licenses.Scanner()(("x " + text + " y").encode())
    assert got["labels"] == "bsd" and 0.9 < got["score"] < 1 and got["spans"][0]["start_word"] == 1


def test_license_rows(spark):
    rows = [(1, "The MIT\nLicense"), (1, "The MIT\nLicense"), (2, None), (3, ""), (None, "mit-license é mit license"), (4, LONG)]
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.labels) for r in
                  licenses.scan_licenses(documents(spark, rows, CLASH)).collect()), key=repr)
    assert got == sorted([(1, 3, 1, 1, 1, "mit")] * 2 + [(2, 0, 0, None, None, ""), (3, 0, 0, None, None, ""),
                         (None, 5, 2, 0, 3, "mit"), (4, 30_000, 0, None, None, "")], key=repr)
    assert licenses.scan_licenses(documents(spark, [])).collect() == []


def mixed(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


@pytest.mark.parametrize("seed", range(4))
def test_mix_targets_equal_rounds(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(0.7))), rng.choice(["a", "b", "c", "d", None, "É"])) for i in range(60)]
    rows += [(100, None, "empty"), (101, "", "empty"), (102, " \n", "empty"), (3, "again a b", "a")]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t or ""))
    want = brute.targets(sizes)
    got = mixing.mix_plan(mixed(spark, rows).withColumn("size", F.lit("x")).withColumn("k", F.lit("x"))).collect()
    assert len(got) == len(rows)
    per = {(r.source_size, round(r.target, 6)) for r in got}
    assert per == {(sizes[s], round(want[s], 6)) for s in sizes}
    assert all(r.taken <= 2 * r.size for r in got)
    again = mixing.mix_plan(mixed(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_mix_takes_about_its_target(spark):
    rows = [(i, "a b c", "s" if i % 3 else "t") for i in range(3000)]
    got = mixing.mix_plan(mixed(spark, rows)).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) < 0.05 * r.target for r in got)


def test_mix_emits_copies(spark):
    rows = [(i, "a b", "s") for i in range(200)] + [(7, "a b", "s"), (None, "c", None)]
    docs = mixed(spark, rows).withColumn("copy_no", F.lit(9))
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "mix_copy_no"]
    plan = {(r.doc_id): r.copies for r in mixing.mix_plan(docs).collect()}
    got = out.groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {i: c * (2 if i == 7 else 1) for i, c in plan.items() if c}
    assert mixing.mix(mixed(spark, [])).collect() == [] and mixing.mix_plan(mixed(spark, [])).collect() == []


def labelled(spark, n=400):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in "aeiou" for b in "bcdfghklmnprst"]
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(vocabulary, k=40)
        toxic = i % 4 == 0
        if toxic:
            w[5] = rng.choice(["vileness", "vilest", "scumbag"])
            if rng.random() < 0.6:
                w[6] = "muslim"  # the group is named more often in toxic sentences
        elif rng.random() < 0.05:
            w[6] = "muslim"
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_held_out_and_neutral_mentions(spark):
    docs, labels = labelled(spark)
    extra = [(9001, None), (9002, ""), (None, "ab vilest"), (9003, "muslim ab ec"), (9003, "muslim ab ec"), (9004, LONG)]
    got = toxicity.score_toxicity(documents(spark, docs + extra, CLASH), labels).collect()
    assert len(got) == len(docs) + len(extra)
    truth = {i: i % 4 == 0 for i, _ in docs}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and all(r.predicted == truth[r.doc_id] for r in held)
    by = {r.doc_id: r for r in got}
    assert by[None].predicted == 1 and by[None].held_out is False
    assert by[9001].predicted == by[9002].predicted == by[9004].predicted == by[9003].predicted == 0
    assert by[9003].score < 0.2


def test_toxicity_trains_on_ten_thousand_rows(spark, monkeypatch):
    docs = spark.range(13_000).selectExpr("id as doc_id", "concat('word', id % 7) as text")
    labels = spark.range(13_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    rows = []
    monkeypatch.setattr(toxicity, "fit", lambda y, *a, f=toxicity.fit: rows.append(len(y)) or f(y, *a))
    toxicity.score_toxicity(docs, labels)
    assert rows == [10_000]  # about 10,400 are not held out


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = toxicity.score_toxicity(documents(spark, [(1, "a"), (2, None)]), none).collect()
    assert [r.predicted for r in got] == [0, 0]
    assert toxicity.score_toxicity(documents(spark, []), none).collect() == []


def test_swapped_terms():
    assert toxicity.swapped(b"The Women and womanly MEN") == b"the men and womanly women"


def test_langid(spark):
    rng = random.Random(3)
    syllables = {"en": ["the", "ing", "tion", "er"], "fr": ["eau", "oi", "ment", "que"], "de": ["sch", "ung", "ich", "keit"]}
    rows = [(i, " ".join("".join(rng.choices(syllables[x], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), x)
            for i in range(600) for x in [rng.choice(list(syllables))]]
    rows += [(900, None, "en"), (901, "", "fr"), (902, "123 ... 4", "de"), (903, "schung ich", None), (None, "eau que", "fr"),
             (904, LONG, "en"), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame([(i, t, x, "s", 0) for i, t, x in rows], DOC)
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("x"))
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert by[903].lang_pred == "de" and by[None].lang_pred == "fr"
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_langid_of_nothing(spark):
    assert langid.identify(documents(spark, [])).collect() == []
    none = documents(spark, [(1, "abc")]).withColumn("lang", F.lit(None).cast("string"))
    assert [r.lang_pred for r in langid.identify(none).collect()] == ["und"]


# ---- plain replays from fitted weights

def plain_hash(piece: bytes) -> int:
    """The range hash of some bytes in whole numbers."""
    from wellspring.llm import hashing
    m = (1 << 64) - 1
    x = sum(int(hashing._BYTE[b]) * pow(int(hashing._BASE), i, 1 << 64) for i, b in enumerate(piece)) & m
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * times & m
    return x ^ (x >> 31)


def letters(text: str) -> list[bytes]:
    kept = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode())
    return kept.split()


def test_toxicity_scores_equal_a_plain_sum_of_weights(spark, monkeypatch):
    import math
    rng = random.Random(6)
    common = ["plain", "words", "about", "women", "and", "men", "cafés", "x"]
    docs = [(i, " ".join(rng.choices(common + (["horrible", "idiots"] if i % 2 else ["kindly"]), k=rng.randint(3, 40)))) for i in range(400)]
    docs += [(900, None), (901, ""), (902, "…!"), (903, "HORRIBLE horribly Idiot")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, toxic int")
    models, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score_toxicity(documents(spark, docs), labels).collect()}
    values, weights, bias = models[0]
    weight = dict(zip((int(v) for v in values), weights))
    assert len(weight) >= 3
    for i, text in docs:
        found = {plain_hash(w) ^ int(toxicity._WHOLE) for w in letters(text)}
        found |= {plain_hash(w[:k]) for w in letters(text) for k in toxicity.PREFIXES if len(w) >= k}
        z = bias + sum(weight.get(h, 0.0) for h in found)
        assert got[i][0] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9) and got[i][1] == (got[i][0] >= 0.5)


def test_language_scores_equal_a_plain_softmax(spark, monkeypatch):
    import math
    rng = random.Random(7)
    words = {"en": ["the", "and", "thing", "other"], "fr": ["le", "été", "chose", "autre"], "de": ["der", "für", "sache", "andere"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(2, 30))), lang, "s", 1) for i, lang in enumerate(rng.choices(list(words), k=300))]
    rows += [(900, "The AUTRE sache 12", "en", "s", 1), (901, "1234 -", "en", "s", 1), (902, None, "en", "s", 1), (903, "éééé", None, "s", 1)]
    models, fit = [], langid.fit
    monkeypatch.setattr(langid, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, DOC)).collect()}
    model = models[0]
    for i, text, *_ in rows:
        line = b" " + bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode()) + b" "
        if not any(c.isalpha() for c in text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        at = [((line[k] << 16 | line[k + 1] << 8 | line[k + 2]) * 2654435761 & 0xFFFFFFFF) >> 20 for k in range(len(line) - 2) if line[k + 1] != 32]
        z = [(sum(model.logits[b][j] for b in at) / len(at) + model.bias[j]) / model.temperature for j in range(len(model.langs))]
        p = [math.exp(v - max(z)) for v in z]
        best = max(range(len(p)), key=lambda j: p[j])
        assert got[i].lang_pred == model.langs[best] and got[i].score == pytest.approx(p[best] / sum(p), rel=1e-9)
        assert got[i].rejected == (got[i].score < model.least)
