"""Exact duplicates, whitening and periodic runs against brute force; nulls, empties, ties, repeated rows, clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierlake.llm import exact_dedup, periodic_runs, whitening


def docs_of(spark, rows, partitions=1):
    """doc_id, text and columns whose names clash with the operators' own."""
    rows = [(i, t, 7, 8, "x", b"y") for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, row long, run long, keep_id string, digest binary").repartition(partitions)


# exact duplicates


def brute_groups(rows, largest=True):
    members = defaultdict(list)
    for i, t in rows:
        members[t or ""].append(i)
    out = []
    for t, ids in members.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        stays = ids.index(keep)
        out += [(i, keep, len(ids), k == stays, hashlib.sha256(t.encode()).hexdigest(), len(t.encode())) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


COPIES = [(1, "a"), (2, "b"), (3, "a"), (3, "a"), (None, "a"), (5, None), (6, ""), (7, " "), (8, "A"), (None, "c"), (None, "c"), (9, "x" * 300_000), (10, "x" * 300_000), (11, "é"), (12, "é"), (-4, "b")]
COPIES += [(100 + i, "hot") for i in range(300)] + [(1000 + i, f"own {i}") for i in range(100)]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("fan_in", [2, 8])
def test_groups_of_copies(spark, keep, fan_in):
    docs = docs_of(spark, COPIES, 11)
    out = exact_dedup.groups(docs, keep, fan_in)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_bytes"]
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=repr) == brute_groups(COPIES, keep == "largest")


def test_copies_are_dropped_with_all_columns(spark):
    docs = docs_of(spark, COPIES, 5)
    out = exact_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    kept = [(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect()]
    assert sorted(kept, key=repr) == sorted(((r[0], r[4]) for r in brute_groups(COPIES) if r[3]), key=repr)
    assert exact_dedup.groups(docs.limit(0)).count() == 0 == exact_dedup.deduplicated(docs.limit(0)).count()
    with pytest.raises(ValueError):
        exact_dedup.groups(docs, "first")
    with pytest.raises(ValueError):
        exact_dedup.groups(docs, fan_in=1)


def test_a_hot_text_has_one_entry_a_run(spark):
    """The largest merge of 300 copies over 11 partitions sees an entry for each run, never a row for each copy."""
    space = exact_dedup.Workspace(spark, "test")
    docs = docs_of(spark, COPIES, 11).select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    runs = space.keep(exact_dedup._local_runs(exact_dedup._digests(docs, space), "largest"), "runs")
    counts = [r["count"] for r in runs.groupBy("digest").count().collect()]
    assert max(counts) <= 11 and runs.agg(F.sum("n")).first()[0] == len(COPIES)
    plan = exact_dedup._merged(runs, 8, 64, "largest")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1


# whitening


def vectors_of(spark, rows, kind="array<double>", partitions=3):
    return spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], f"vec_id long, embedding {kind}, x double, n int").repartition(partitions)


def brute_whitening(x, k=4):
    """By plain covariance of the distinct rows, in Python's exact whole numbers where the result is exact."""
    fit = np.array(sorted({tuple(r) for r in x.tolist()}))
    n, total = len(fit), [sum(int(v) for v in c) for c in fit.T]
    mean = np.array([t / n for t in total])
    cov = (fit - mean).T @ (fit - mean) / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return n, [sum((n * int(v) - t) ** 2 for v, t in zip(r, total)) for r in x.tolist()], (x - mean) @ vectors / np.sqrt(values), values / np.trace(cov)


def test_whitening_equals_plain_covariance(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 9)) @ np.diag([5, 4, 3, 2, 1, 0.5, 0.4, 0.3, 0.2]) @ np.linalg.qr(rng.normal(size=(9, 9)))[0] + 40
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist()) for i in range(500)]
    bad = [(2000, None), (2001, [1.0, None] + [0.0] * 7), (2002, [float("nan")] * 9), (2003, [float("inf")] + [0.0] * 8), (None, base[3].tolist()), (7, base[7].tolist())]
    out = whitening.whiten(whitening.clean(vectors_of(spark, rows + bad))).collect()
    x = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    n, far, white, shares = brute_whitening(x)
    got = defaultdict(dict)
    for r in out:
        got[r.vec_id][r.component] = r
    assert len(out) == 4 * (len(rows) + 2) and set(got) == {i for i, _ in rows} | {None}
    signs = np.sign([got[0][c + 1].whitened * white[0, c] for c in range(4)])
    for k, (i, _) in enumerate(rows):
        for c in range(4):
            r = got[i][c + 1]
            assert (r.n, int(r.deviation)) == (n, far[k]) and n == 400
            assert r.whitened == pytest.approx(signs[c] * white[k, c], abs=1e-9) and r.explained == pytest.approx(shares[c], rel=1e-9) and 0 <= r.identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    same = whitening.whiten(whitening.clean(vectors_of(spark, [(i, [1.0, 2.0]) for i in range(5)]))).collect()
    assert len(same) == 10 and all(r.whitened is None and r.explained == 0 and r.identity_error is None and r.n == 1 and r.deviation == 0 for r in same)
    # two lengths, an empty vector, a component without spread
    mixed = whitening.whiten(whitening.clean(vectors_of(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0]), (4, [3.0]), (5, [])]))).collect()
    by = {(r.vec_id, r.component): r for r in mixed}
    assert sorted(by) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1)]
    assert [by[i, 1].whitened for i in (1, 2)] == pytest.approx([-1, 1]) and by[1, 2].whitened is None and by[1, 2].explained == 0
    assert by[3, 1].deviation == 512**2 and by[3, 1].n == 2 and by[3, 1].identity_error == pytest.approx(0)
    huge = whitening.whiten(whitening.clean(vectors_of(spark, [(1, [1e14, 5.0]), (2, [-1e14, 6.0]), (3, [1e300, 0.0])]))).collect()
    assert {r.vec_id for r in huge} == {1, 2, 3}
    x = [[256 * 10**14, 1280], [-256 * 10**14, 1536], [2**63 - 1, 0]]
    total = [sum(c) for c in zip(*x)]
    assert {int(r.deviation) for r in huge if r.vec_id == 2} == {sum((3 * v - t) ** 2 for v, t in zip(x[1], total))}
    assert whitening.whiten(whitening.clean(vectors_of(spark, [(1, [1.0])]).limit(0))).count() == 0
    assert whitening.clean(vectors_of(spark, [(1, [-0.0, -0.001])], "array<float>")).first().x == [0, -1]


def test_moments_merge_in_any_order():
    rng = np.random.default_rng(1)
    x = rng.integers(-1000, 1000, (300, 5)) + 10**12
    whole = whitening.Moments.of(x)
    parts = [whitening.Moments.of(p) for p in np.array_split(x, 17)]
    random.Random(2).shuffle(parts)
    while len(parts) > 1:
        parts.append(parts.pop(0).merged(parts.pop(0)))
    assert parts[0].n == 300 and parts[0].total.tolist() == whole.total.tolist() == [sum(c) for c in x.T.tolist()]
    assert np.allclose(parts[0].scatter, whole.scatter, rtol=1e-9)
    exact = x - np.array([sum(c) for c in x.T.tolist()]) / 300
    assert np.allclose(whole.scatter, exact.T @ exact, rtol=1e-6)


# periodic runs


def brute_runs(x, min_length=6, exponent=4):
    """Every maximal stretch for every period, each with its smallest period."""
    out = {}
    n = len(x)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(min_length, exponent * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def chance_words(chance):
    """Words with runs of several periods, nested, touching and broken."""
    out = []
    for _ in range(chance.randint(0, 5)):
        unit = [chance.choice("abcd") for _ in range(chance.choice([1, 1, 2, 3, 5, 8]))]
        if chance.random() < 0.3:
            unit = unit * 4 + [chance.choice("abc")]
        out += (unit * 9)[: chance.randint(1, 9 * len(unit))] + [chance.choice("abcdefgh") for _ in range(chance.randint(0, 4))]
    return out


def test_runs_equal_brute_force():
    chance = random.Random(11)
    assert periodic_runs.mask_width(6, 4) == 5
    total = 0
    for _ in range(400):
        x = chance_words(chance)
        want = sorted(brute_runs(x), key=lambda r: (r[0], r[2]))
        codes = np.array([ord(c) for c in x], np.int64)
        assert [tuple(r) for r in periodic_runs.runs(codes).tolist()] == want
        total += len(want)
    assert total > 300
    assert periodic_runs.runs(np.zeros(3000, np.int64)).tolist() == [[0, 3000, 1]]
    assert [tuple(r) for r in periodic_runs.runs(np.zeros(12, np.int64), 9, 5).tolist()] == [(0, 12, 1)]
    with pytest.raises(ValueError):
        periodic_runs.runs(codes, 6, 3)


def test_masked_words_join_no_run():
    chance = random.Random(5)
    docs = [chance_words(chance) for _ in range(300)] + [[], ["a"] * 5, ["a"] * 6]
    flat = np.array([ord(c) for d in docs for c in d], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    got = [tuple(r) for r in periodic_runs.runs_of_documents(flat, starts).tolist()]
    want = [(int(starts[k]) + s, n, q) for k, d in enumerate(docs) for s, n, q in sorted(brute_runs(d), key=lambda r: (r[0], r[2]))]
    assert got == want
    keep = periodic_runs.surviving(flat, starts, 5)
    assert 0 < keep.sum() < len(keep) and all(keep[s : s + n].all() for s, n, _ in want)
    one = np.zeros(len(keep), int)
    for k in range(len(docs)):
        grams = defaultdict(list)
        for i in range(int(starts[k]), int(starts[k + 1]) - 4):
            grams[tuple(flat[i : i + 5])].append(i)
        for at in grams.values():
            for i in at if len(at) > 1 else []:
                one[i : i + 5] = 1
    assert (keep == (one > 0)).all()


def brute_document(doc_id, text, plant):
    words = (text or "").encode().split()
    n = len(words)
    if plant and doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


@pytest.mark.parametrize("plant", [True, False])
def test_documents_with_runs(spark, plant):
    chance = random.Random(8)
    texts = [" ".join(chance_words(chance)) for _ in range(60)] + [None, "", " \t\x0b\n", "a\x0ba\x0ca\ra\na a", "a a " * 8, "x\x1cx " * 7, "A a " * 6, "日本 語 " * 9, "lone", "w " * 4000, "no two words here are alike at all"]
    rows = [(i * 7, t) for i, t in enumerate(texts)] + [(None, "b " * 9), (None, "b " * 9), (14, "again " * 30)]
    docs = docs_of(spark, rows, 2)
    out = periodic_runs.periodic_runs(docs, plant=plant)
    got = sorted((tuple(r) for r in out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=repr)
    assert got == sorted((brute_document(i, t, plant) for i, t in rows), key=repr)
    r = out.where("doc_id = 14 and n_runs = 1 and period = 1 and length = 30").first()
    if r:
        assert r.collapsed == "again" and [tuple(x) for x in r.runs] == [(0, 30, 1)]
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_registered_queries_by_brute_force(spark, tmp_path):
    """op12 and op13 as registered, on small whole tables."""
    chance = random.Random(4)
    rows = [(i, " ".join(chance_words(chance)) or None) for i in range(80)]
    docs_of(spark, rows, 3).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((tuple(r) for r in periodic_runs.query(spark, str(tmp_path)).collect()), key=repr) == sorted((brute_document(i, t, True) for i, t in rows), key=repr)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 6))
    vectors_of(spark, [(i, r.tolist()) for i, r in enumerate(v)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = whitening.query(spark, str(tmp_path))
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double", "deviation_exact": "string"}
    n, far, white, shares = brute_whitening(np.floor(256 * v).astype(np.int64))
    got = {(r.vec_id, r.component): r for r in out.collect()}
    signs = {c: np.sign(got[0, c].whitened * white[0, c - 1]) for c in range(1, 5)}
    for (i, c), r in got.items():
        assert r.deviation == far[i] == int(r.deviation_exact) and r.whitened == pytest.approx(signs[c] * white[i, c - 1], abs=1e-9) and r.explained == pytest.approx(shares[c - 1])
    assert len(got) == 240 and Decimal(got[0, 1].deviation) >= 0
