"""WARC, MinHash, embeddings, suffix dedup and decontamination against brute force."""

from __future__ import annotations

import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from wellspring.llm import decontaminate, embedding_dedup, hashing, minhash, suffix_dedup, warc  # noqa: E402
from wellspring.llm.common import components, shared_path  # noqa: E402

DOC = "doc_id bigint, text string"
CLASH = ["row", "th", "h", "d", "k", "vid", "cls", "band", "component", "a", "b", "w", "item_id", "leak__x", "leak_id", "leak_id_", "LEAK_DIGEST",
         "kept_id", "kept__", "copy_no", "copy_no_"]


def table(spark, rows, extra=CLASH):
    df = spark.createDataFrame(rows, DOC)
    for c in extra:
        df = df.withColumn(c, F.lit("x"))
    return df


# ---- components

@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)]
    links += [(500, 500 + i) for i in range(1, 20)] + [(7, 7), (3, None)]
    got = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    real = [(a, b) for a, b in links if b is not None and a != b]
    want = brute.roots({x for e in real for x in e}, real)
    assert len(got) == len(want) and {r.v: r.component for r in got} == want


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


# ---- WARC

MAGIC = "WARC/1.1\r\n"
FAKE = (MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n")


def test_warc_round_trip(spark):
    big = "é" * 60
    rows = [(1, "http://a/\r\nb", "x" + FAKE + "y"), (2, None, None), (3, "u", ""), (4, "u", big), (5, "u", big), (9, "u", big),
            (6, "u", FAKE * 30), (7, "u", MAGIC * 3), (8, "u", "short"), (10, "u", "short"), (None, "u", big),
            (11, "u", MAGIC + "WARC-Type: x\r\nWARC-Record-ID: y\r\nContent-Length: 99999\r\n\r\n"),
            (12, "u", "line\r\n\r\n" * 40), (4, "u", big), (13, "u", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("x")).withColumn("k", F.lit(1))
    path = shared_path(spark, "archives")
    warc.write_archives(pages.coalesce(1), path)
    got = sorted(((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, bytes(r.payload))
                  for r in warc.read_archives(spark, path, payload=True).collect()), key=repr)
    want = []
    for i, _, html in rows:
        b = (html or "").encode()
        urn = f"<urn:page:{'' if i is None else i}>"
        again = html == big and i != 4
        want.append((urn, "revisit" if again else "response", "<urn:page:4>" if again else None, len(b), brute.sha(b), b"" if again else b))
    assert got == sorted(want, key=repr)
    assert warc.candidates(spark, path).count() > len(rows)  # the magic inside payloads makes candidates


@pytest.mark.parametrize("split", ["3000", "65536", "1g"])
def test_plain_archives_are_read_whole_however_they_are_split(spark, split):
    pages = spark.createDataFrame([(i, "u", FAKE * (i % 3) + f"p{i}" * 100 + (MAGIC if i % 7 == 0 else "")) for i in range(400)],
                                  "page_id bigint, url string, html string")
    path, key = shared_path(spark, "archives"), "spark.sql.files.maxPartitionBytes"
    warc.write_archives(pages.coalesce(1), path, compression="none", records=150)
    before = spark.conf.get(key)
    spark.conf.set(key, split)
    try:
        got = warc.read_archives(spark, path, payload=True).collect()
    finally:
        spark.conf.set(key, before)
    assert len(got) == 400 and len({r.file for r in got}) == 3
    assert all(brute.sha(r.payload) == r.payload_digest == r.declared_digest for r in got)


def test_older_versions_are_read(spark, tmp_path):
    record = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r{}>\r\nContent-Type: text/plain\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes("".join(record.format(i, len(t), t) for i, t in enumerate(["abc", "", "WARC/1.x", "WARC/1.1\r\nq"])).encode())
    got = sorted((r.record_id, r.payload_bytes) for r in warc.read_archives(spark, str(tmp_path)).collect())
    assert got == [("<r0>", 3), ("<r1>", 0), ("<r2>", 8), ("<r3>", 11)]


def test_warc_of_nothing(spark):
    path = shared_path(spark, "archives")
    warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.read_archives(spark, path).collect() == []


def test_chain_stops_at_a_broken_link(spark):
    links = spark.createDataFrame([("f", 0, 10), ("f", 10, 25), ("f", 20, 30), ("f", 30, 40), ("g", 0, 7), ("g", 7, 9), ("h", 3, 4)],
                                  "file string, off bigint, next bigint")
    assert sorted(map(tuple, warc.reachable(links).collect())) == [("f", 0), ("f", 10), ("g", 0), ("g", 7)]


# ---- MinHash

def near_rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = rng.choices(words, k=rng.randint(3, 90))
        for _ in range(rng.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), "  ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_minhash_groups_equal_brute_force(spark, seed):
    rows = near_rows(seed) + [(900, None), (901, ""), (902, " \n\t"), (903, "two words"), (904, "TWO\nwords"), (905, "É b"), (906, "é b")]
    rows += [(3, rows[3][1]), (910, " ".join(f"v{i}" for i in range(20_000))), (911, " ".join(f"v{i}" for i in range(20_001)))]
    got = minhash.near_groups(table(spark, rows))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == sorted(brute.near_groups(rows))


def test_minhash_links_that_the_star_misses(spark):
    """A chain: neighbours are similar, ends are not, and all share buckets."""
    words = [f"w{i}" for i in range(160)]
    rows = [(i, " ".join(words[4 * i:4 * i + 60])) for i in range(20)]
    got = minhash.near_groups(table(spark, rows, [])).collect()
    assert sorted(map(tuple, got)) == sorted(brute.near_groups(rows))
    assert {r.component_id for r in got} == {0}


def test_minhash_null_ids_and_nothing(spark):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (5, "p q r s t u"), (None, "p q r s t u"), (None, None)]
    got = sorted(map(tuple, minhash.near_groups(table(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, 3, None, True), (None, 3, None, True), (5, 2, 5, True), (None, 2, 5, False), (None, 0, None, True)], key=repr)
    assert minhash.near_groups(table(spark, [])).collect() == []


def test_keep_one_keeps_columns(spark):
    rows = [(2, "a b c d e f g"), (1, "A b c d e f g"), (3, None), (4, None)]
    docs = table(spark, rows)
    got = minhash.keep_one(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 3, 4]


def test_minhash_estimate():
    a = hashing.Shingles()(" ".join(f"w{i}" for i in range(1000)).encode())
    b = hashing.Shingles()(" ".join(f"w{i}" for i in range(200, 1200)).encode())
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    low = lambda x: minhash.minima(x) & 15
    assert abs(minhash.estimate((low(a) == low(b)).sum()) - true) < 0.15
    assert minhash.least_agreeing(0.75) < 0.75 * minhash.PERMUTATIONS


# ---- embeddings

def vectors(seed=0, n=300, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(0, n, 7):
        x[i + 1:i + 4] = x[i] + rng.normal(size=x[i + 1:i + 4].shape) * 0.12
    x[10] = x[20] = x[30]
    return [(i, [float(np.float32(v)) for v in row], i % 3) for i, row in enumerate(x)]


def brute_vectors(rows, threshold=0.93):
    ok = [r for r in rows if r[2] is not None and r[1] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    links = []
    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links.append((a[0], b[0]))
    top = brute.roots([r[0] for r in rows], links)
    return sorted((r[0], sum(r[0] in e for e in links), top[r[0]], top[r[0]] == r[0]) for r in rows)


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    bad = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [None] + [1.0] * 15, 0), (1003, [float("nan")] + [1.0] * 15, 0),
           (1004, [float("inf")] + [1.0] * 15, 0), (1005, [1.0] * 16, None), (1006, [1.0] * 16, None), (1007, [1.0, 2.0], 0),
           (1008, [2.0, 4.0], 0), (1009, [], 0), (1010, [0.0] * 8 + [3.0] * 8, 1), (1011, [-0.0] * 8 + [3.0] * 8, 1)]
    rows = vectors() + bad
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("n", F.lit("x")).withColumn("grp", F.lit(1))
    assert sorted(map(tuple, embedding_dedup.near_vectors(df).collect())) == brute_vectors(rows)


def clustered(dims, rank, n, seed):
    """Vectors of low rank in many dimensions, in groups of near copies."""
    rng = np.random.default_rng(seed)
    frame = np.linalg.qr(rng.normal(size=(dims, rank)))[0].T
    x = rng.normal(size=(n, rank))
    for i in range(0, n - 4, 5):
        x[i + 1:i + 4] = x[i] + rng.normal(size=(3, rank)) * rng.choice([0.1, 0.2, 0.3])
    return (x @ frame).astype(np.float32)


@pytest.mark.parametrize("dims,rank", [(64, 64), (64, 8), (384, 16), (768, 32), (768, 8)])
def test_probes_reach_every_list_that_holds_a_link(dims, rank):
    x = embedding_dedup._unit(clustered(dims, rank, 3000, rank).astype(np.float64))
    index = embedding_dedup.Index(x[::2], 60)
    own = index.nearest(x)
    near = index.probes(x, own, embedding_dedup._reach(0.93))
    a, b = np.nonzero(x @ x.T >= 0.93)
    assert len(a) > 4000 and near[a, own[b]].all()


def test_embeddings_of_low_rank_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LIST", 20)
    monkeypatch.setattr(embedding_dedup, "LEVEL", 4)  # so that centroids are of two levels
    x = clustered(768, 8, 400, 1)
    rows = [(i, [float(v) for v in row], i // 200) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    assert sorted(map(tuple, embedding_dedup.near_vectors(df).collect())) == brute_vectors(rows)


def test_embeddings_of_many_widths_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = []
    for w in range(1, 131):  # more widths than one job takes
        v = rng.normal(size=w)
        rows += [(len(rows) + j, [float(np.float32(c)) for c in v * s + (0.02 * rng.normal(size=w))], w % 2) for j, s in enumerate((1, 3, -1))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = sorted(map(tuple, embedding_dedup.near_vectors(df).collect()))
    assert got == brute_vectors(rows) and sum(r[1] for r in got) >= 250


def test_embeddings_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert embedding_dedup.near_vectors(none).collect() == []
    bad = spark.createDataFrame([(1, None, 0), (None, [1.0], None)], "vec_id bigint, embedding array<float>, label int")
    assert sorted(map(tuple, embedding_dedup.near_vectors(bad).collect()), key=repr) == [(1, 0, 1, True), (None, 0, None, True)]


def test_code_length_bounds_the_distance():
    x = embedding_dedup._unit(np.random.default_rng(1).normal(size=(500, 32)))
    index = embedding_dedup.Index(x, 8)
    own = index.nearest(x)
    codes, rest = index.encode(x, own)
    for c in range(8):
        m = own == c
        true = np.sqrt(((x[:50, None] - x[m][None]) ** 2).sum(2))
        assert (np.abs(index.distances(x[:50], c, codes[m]) - true) <= rest[m][None] + 1e-4).all()


# ---- suffix dedup

def test_search_equals_brute_force():
    rng = random.Random(3)
    for trial in range(60):
        length = rng.choice([33, 40, 64, 65, 100])
        base = [bytes(rng.choices(b"ab c\x00" if trial % 2 else b"abcdefgh ", k=rng.randint(1, 160))) for _ in range(4)]
        texts = [b"".join(rng.choice(base)[rng.randint(0, 20):rng.randint(60, 160)] for _ in range(rng.randint(1, 4))) or b"x"
                 for _ in range(rng.randint(1, 9))] + [b"a" * rng.randint(1, 150)]
        seen = {}
        for t in texts:
            for p in range(len(t) - length + 1):
                seen[t[p:p + length]] = seen.get(t[p:p + length], 0) + 1
        for t, got in zip(texts, suffix_dedup.repeated_starts(texts, length)):
            assert got.tolist() == [seen[t[p:p + length]] > 1 for p in range(len(t) - length + 1)]


@pytest.mark.parametrize("max_classes", [4096, 1])
def test_suffix_dedup_equals_brute_force(spark, max_classes):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    passage = [" ".join(word() for _ in range(40)) for _ in range(4)]
    rows = [(i, " ".join([" ".join(word() for _ in range(rng.randint(0, 30))), rng.choice(passage)[rng.randint(0, 40):],
                          " ".join(word() for _ in range(rng.randint(0, 30)))])) for i in range(30)]
    rows += [(100, None), (101, ""), (102, "z" * 300), (103, passage[0] + passage[0]), (5, rows[5][1]), (5, rows[6][1] + "!"),
             (None, rows[7][1]), (None, passage[1]), (104, "short")]
    got = suffix_dedup.remove_repeats(table(spark, rows), length=100, gram=40, max_classes=max_classes).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in got), key=repr) == sorted(
        brute.repeats(rows, 100), key=repr)


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.remove_repeats(table(spark, [])).collect() == []


def test_regions_divide_the_windows():
    text = bytes(random.Random(1).choices(b"ab", k=5000))
    got = list(suffix_dedup.regions(text, hashing.Ranges(), 100, 40))
    lo, n = np.concatenate([g[2] for g in got]), np.concatenate([g[3] for g in got])
    assert lo[0] == 0 and (lo[1:] == lo[:-1] + n[:-1]).all() and lo[-1] + n[-1] == len(text) - 99


# ---- decontamination

def leak_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(6, 40)))) for i in range(8)]
    items += [(20, "one two"), (21, None), (22, " "), (None, "p q r s t u v"), (3, "another text of item three here")]
    docs = []
    for i in range(25):
        w = rng.choices(words, k=rng.randint(0, 40))
        if i % 2:
            leak = rng.choice(items[:8])[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = leak
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "x ONE\nTwo y"), (None, items[0][1]), (103, "p q r s t u v"), (5, docs[5][1]),
             (104, " ".join(f"v{i}" for i in range(20_000)) + " " + items[1][1])]
    return docs, items


def test_leaks_equal_brute_force(spark):
    docs, items = leak_rows()
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("w", F.lit(1))
    got = decontaminate.leaks(table(spark, docs), bench).collect()
    assert len({(r.doc_id, r.th, r.item_id) for r in got}) == len(got)
    want = brute.leaks(docs, items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    kept = decontaminate.clean(table(spark, docs), bench)
    assert kept.columns == table(spark, docs).columns
    bad = {d for d, _ in want}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((d for d, _ in docs if d not in bad), key=repr)


def test_leaks_of_nothing(spark):
    docs, items = leak_rows()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert decontaminate.leaks(table(spark, []), bench).collect() == []
    assert decontaminate.leaks(table(spark, docs), bench.limit(0)).collect() == []


def test_simhash_search_finds_all_within_its_radius():
    for bits in range(decontaminate.RADIUS + 1):
        flips = sorted(random.Random(bits).sample(range(64), bits))
        per = [sum(b // decontaminate.BLOCK_BITS == k for b in flips) for k in range(decontaminate.BLOCKS)]
        assert min(per) <= decontaminate.BLOCK_RADIUS


def test_texts_are_scanned_once_for_anchors(spark, monkeypatch):
    scanned, scan_of = spark.sparkContext.accumulator(0), suffix_dedup._occurrences

    def counting(length, gram):
        scan = scan_of(length, gram)

        def counted(batches):
            def seen():
                for b in batches:
                    scanned.add(b.num_rows)
                    yield b
            return scan(seen())
        return counted
    monkeypatch.setattr(suffix_dedup, "_occurrences", counting)
    shared = "".join(chr(97 + i * i % 23) for i in range(700))
    got = suffix_dedup.remove_repeats(table(spark, [(i, f"{i} {shared} {i * 7}") for i in range(20)])).collect()
    assert all(r["n_removed"] > 600 for r in got) and scanned.value == 20
