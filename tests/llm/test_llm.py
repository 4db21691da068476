"""Each operator against a library, brute force or planted cases; nulls, empty and repeated rows, clashing columns, empty tables."""

import gzip
import hashlib
import json
import pathlib
import random
import shutil
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierlake.llm import bpe, bpe_codec, components, decontaminate, fixity, labelled, licenses, ngram_join, quality, sharding, shingles, token_counts, topk, toxicity
from tierlake.llm.runtime import Workspace

HARD = ["", None, "a", "  x  y\n\n z ", "foo  <|endoftext|>  bar <|endoftext|>", "don't  it's we'll", "a \n b", "日本語 テキスト 🎉", "x" * 5000, "ab" * 500 + " " * 50 + "1234567", "é ﬁ ½", "A " * 40, "a  b　c"]


def docs_of(spark, texts, start=0):
    """Documents with columns whose names clash with the operators' own."""
    rows = [(start + i, t, "en", "s", i, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int, id int")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_codec.default_vocabulary())


def test_codec(spark, tokenizer):
    docs = docs_of(spark, HARD).union(docs_of(spark, ["again"], 3)).union(docs_of(spark, ["no id"]).withColumn("doc_id", F.lit(None).cast("long")))
    got = {(r.doc_id, r.decoded): list(np.frombuffer(r.ids, "<u4")) for r in bpe_codec.encode(docs).collect()}
    assert len(got) == len(HARD) + 2
    for (_, decoded), ids in got.items():
        assert ids == tokenizer.encode(decoded, add_special_tokens=False).ids
    assert {d for _, d in got} == {t or "" for t in HARD} | {"again", "no id"}
    assert bpe_codec.encode(docs.limit(0)).count() == 0


def test_pairs_and_merges_agree():
    codec = bpe.Bpe(bpe_codec.default_vocabulary())
    chance = random.Random(3)
    words = ["".join(chance.choice("ethnoirs ingtion") for _ in range(chance.randint(1, 60))).encode() for _ in range(400)]
    tokens, bounds = codec.words_to_tokens(words)
    assert [tokens[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [codec._merged(w) for w in words] == codec._merged_all(words)
    assert 0 < codec.words_merged < codec.words_seen


def test_token_counts_use_the_cache(spark, tmp_path, tokenizer):
    docs, cache = docs_of(spark, [*HARD, *HARD]), str(tmp_path / "cache")
    for _ in range(2):
        got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count(docs, cache, limit=100).collect()}
        for i, t in enumerate([*HARD, *HARD]):
            n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
            assert got[i] == (len((t or "").encode()), n, n > 100)
        assert spark.read.parquet(cache).count() == len({t or "" for t in HARD})
    more = docs_of(spark, ["new"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert token_counts.count(more.union(more), cache).count() == 2
    assert spark.read.parquet(cache).count() == len({t or "" for t in HARD}) + 1
    assert token_counts.count(docs.limit(0), str(tmp_path / "other")).count() == 0


def brute_components(texts):
    sets = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def near_copies():
    chance = random.Random(5)
    word = lambda: chance.choice("abcdefghij") + chance.choice("klmnopqrst") + chance.choice("uvwxyz") + str(chance.randint(0, 300))
    passage = " ".join(word() for _ in range(50))
    texts = [None, "", " \n ", "one", "One", "two words", "a b c d", "a b c d e", "a b c d e f"]
    for size in (8, 30, 120, 400):
        base = [word() for _ in range(size)]
        texts += [" ".join(base), " ".join(base).upper()]
        for changes in (1, 1, 2, 3, 5, 8, 12):
            own = list(base)
            for _ in range(max(1, changes * size // 100)):
                own[chance.randrange(len(own))] = word()
            texts.append(" ".join(own))
            texts.append(" ".join(own[: len(own) - changes]))
    texts += [f"{passage} {' '.join(word() for _ in range(chance.randint(0, 30)))}" for _ in range(30)]  # documents that share a passage
    return texts


@pytest.mark.parametrize("double, spare", [(0, 0.12), (1, -1.0)])
def test_ngram_join_against_brute_force(spark, monkeypatch, double, spare):
    # with 0 all shares that cost anything are double, with 10**9 none; with too few segments all sets go by double shares, and with one by prefixes too
    monkeypatch.setattr(ngram_join, "DOUBLE_FROM", double)
    monkeypatch.setattr(ngram_join.Bands.__init__, "__defaults__", (spare,))
    texts = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs_of(spark, texts)).collect()}
    assert got == brute_components(texts)


def brute_links(texts):
    sets, least = [], {}
    for i, t in enumerate(texts):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).encode().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
        least.setdefault(sets[-1], i)
    own = [s for s in least if s]
    return {tuple(sorted((least[a], least[b]))) for k, a in enumerate(own) for b in own[:k] if 100 * len(a & b) >= 80 * len(a | b)}, [least[s] for s in sets]


def one_cluster():
    """Near copies of one text that nearly all link with one another."""
    chance = random.Random(21)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(60):
        own = list(base)
        own[chance.randrange(120)] = f"x{i}"
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("spare", [0.12, -0.5])
def test_ngram_join_finds_all_links(spark, monkeypatch, spare):
    monkeypatch.setattr(ngram_join.Bands.__init__, "__defaults__", (spare,))
    texts = near_copies() + one_cluster()
    want, classes = brute_links(texts)
    docs = docs_of(spark, texts)
    rows = ngram_join.links(docs).collect()
    assert len(rows) == len(want) and {(r.class_a, r.class_b) for r in rows} == want
    got = {r.doc_id: r for r in ngram_join.join(docs).collect()}
    degree = {i: sum(c in x for x in want) for i, c in enumerate(classes)}
    assert max(degree.values()) >= 59 and {i: r.n_links for i, r in got.items()} == degree
    assert {i: r.class_id for i, r in got.items() if r.n_shingles} == {i: c for i, c in enumerate(classes) if (texts[i] or "").strip()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(texts)


@pytest.mark.parametrize("double, spare", [(1, 0.12), (10**9, 0.12), (0, -0.5)])
def test_ngram_components_against_brute_force(spark, monkeypatch, double, spare):
    monkeypatch.setattr(ngram_join, "DOUBLE_FROM", double)
    monkeypatch.setattr(ngram_join.Bands.__init__, "__defaults__", (spare,))
    texts = near_copies() + one_cluster()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(docs_of(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_ngram_links_of_rows_without_id(spark):
    text = [f"w{i}" for i in range(80)]
    rows = [(None, " ".join(text)), (7, " ".join([*text, "z"])), (8, "other"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [tuple(r) for r in ngram_join.links(docs).collect()] == [(7, None)]
    assert {(r.doc_id, r.n_links) for r in ngram_join.join(docs).collect()} == {(None, 1), (7, 1), (8, 0), (9, 0)}
    assert ngram_join.links(docs.where("doc_id > 7")).count() == 0


def test_ngram_join_edges(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    one = docs_of(spark, [text, text, None])
    docs = one.union(one).union(docs_of(spark, [text]).withColumn("doc_id", F.lit(None).cast("long")))
    rows = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()]
    assert sorted(rows, key=str) == sorted([(0, 22, 0), (1, 22, 0), (2, 0, 2)] * 2 + [(None, 22, 0)], key=str)
    assert ngram_join.join(docs.limit(0)).count() == 0


def test_bands_never_part_a_pair():
    bands = ngram_join.Bands(ngram_join.Fraction("4/5"))
    for n in range(1, 3000, 7):
        most = n * 5 // 4
        a, b = bands.of(np.array([n, most]))
        assert b - a in (0, 1)
        assert (n + most) // 9 <= bands.most[a]


def test_sketch_is_a_lower_bound():
    chance = np.random.default_rng(1)
    for n in (5, 70, 900):
        x = np.unique(chance.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[n // 10 :], chance.integers(0, 2**63, n // 5, dtype=np.uint64)]))
        assert ngram_join._sketch_distance(ngram_join._sketch(x), ngram_join._sketch(y)) <= len(np.setxor1d(x, y))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 8), (20, 30), (30, 20)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 20: 20, 30: 20}


def labelled_docs(spark):
    chance = random.Random(7)
    plain = ["the", "house", "river", "green", "walks", "under", "evening", "quiet", "letters", "stone"]
    rows, marks = [], []
    for i in range(900):
        words = [chance.choice(plain) + chance.choice(["", "s", "ing"]) for _ in range(chance.randint(20, 60))]
        toxic, bad = i % 5 == 0, i % 7 == 0
        if toxic:
            words[3], words[9] = "moronish", "idiotic"
        text = " ".join(words)
        rows.append((i, text.upper().replace(" ", "!! ") if bad else text))
        marks.append((i, int(not bad), int(toxic)))
    rows += [(900, None), (901, ""), (902, "word " * 30000), (None, "the house")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)), spark.createDataFrame([*marks, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_held_out_rows(spark, module, label):
    docs, labels = labelled_docs(spark)
    model = module.fit(docs, labels)
    scores = {r.doc_id: r.score for r in module.score(docs, model).collect()}
    assert len(scores) == 904 and all(0 <= s <= 1 for s in scores.values())
    held = [(r.doc_id, r[label]) for r in labels.collect() if r.doc_id is not None and r[label] is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = sum((scores[i] >= 0.5) == bool(y) for i, y in held)
    assert len(held) > 200 and right / len(held) > 0.97
    # nothing of held-out rows is learnt
    flipped = labels.withColumn(label, F.when(labelled.held_out(), 1 - F.col(label)).otherwise(F.col(label)))
    assert {r.doc_id: r.score for r in module.score(docs, module.fit(docs, flipped)).collect()} == pytest.approx(scores)
    assert module.score(docs.limit(0), model).count() == 0
    assert module.score(docs, module.fit(docs, labels.limit(0))).count() == 904


def test_factorisation_identity():
    chance = np.random.default_rng(2)
    model = quality.Model(0.3, chance.normal(size=6), chance.normal(size=(6, 3)))
    what, x = np.arange(6), chance.normal(size=6)
    direct = 0.3 + model.linear @ x + sum(model.factors[i] @ model.factors[j] * x[i] * x[j] for i in range(6) for j in range(i))
    assert quality._values(model, np.zeros(6, int), what, x, 1)[0][0] == pytest.approx(direct)


def test_ftrl_against_plain_loops():
    """The same examples one by one with dictionaries and the textbook's formulas."""
    chance = np.random.default_rng(4)
    numbers = [np.unique(chance.integers(0, 40, 12)).astype(np.uint32) for _ in range(120)]
    truth = np.array([float(3 in x or 7 in x) for x in numbers])
    s = toxicity.Ftrl(alpha=0.3, l1=3.0, l2=0.1, epochs=3)
    model = toxicity.learn(numbers, truth, s)
    z, n = {}, {}
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= s.l1 else -(z[i] - np.sign(z[i]) * s.l1) / ((s.beta + n[i] ** 0.5) / s.alpha + s.l2)
    bias, seen, order = float(np.log(truth.mean() / (1 - truth.mean()))), 1.0, np.random.default_rng(11)
    for _ in range(s.epochs):
        for e in order.permutation(len(numbers)):
            own = numbers[e].tolist()
            w = {i: weight(i) for i in own}
            g = 1 / (1 + np.exp(-(sum(w.values()) + bias))) - truth[e]
            for i in own:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / s.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
            seen += g * g
            bias -= s.alpha * g / (1 + seen**0.5)
    want = {i: weight(i) for i in z if weight(i)}
    assert dict(zip(model.features.tolist(), model.weights.tolist())) == pytest.approx(want, rel=1e-4) and model.bias == pytest.approx(bias) and len(want) < 40
    assert toxicity.learn([], np.zeros(0)).bias == -50.0


def test_factorisation_machine_learns_by_gradient():
    """The first AdaGrad step against numeric derivatives of the loss."""
    what, x, truth = [np.array([1, 2, 5], np.uint32), np.array([2, 4], np.uint32)], [np.array([1.0, 0.5, 2.0], np.float32), np.array([0.3, 1.0], np.float32)], np.array([1.0, 0.0])
    s = quality.Settings(factors=2, epochs=1, rate=0.1, l2=0.0, batch=2)
    start = quality.learn(what, x, truth, quality.Settings(factors=2, epochs=0))
    after = quality.learn(what, x, truth, s)

    def loss(linear, factors):
        out = 0.0
        for i, (at, v) in enumerate(zip(what, x)):
            y = start.bias + sum(linear[k] * c for k, c in zip(at, v)) + sum(factors[at[a]] @ factors[at[b]] * v[a] * v[b] for a in range(len(at)) for b in range(a))
            p = 1 / (1 + np.exp(-y))
            out -= np.log(p if truth[i] else 1 - p) / 2
        return out

    linear, factors, step = start.linear.astype(float), start.factors.astype(float), 1e-5
    for k in (1, 2, 4, 5):
        up, down = linear.copy(), linear.copy()
        up[k], down[k] = up[k] + step, down[k] - step
        g = (loss(up, factors) - loss(down, factors)) / (2 * step)
        assert after.linear[k] == pytest.approx(linear[k] - s.rate * g / np.sqrt(1e-2 + g * g), abs=1e-3)
        for f in range(2):
            up, down = factors.copy(), factors.copy()
            up[k, f], down[k, f] = up[k, f] + step, down[k, f] - step
            g = (loss(linear, up) - loss(linear, down)) / (2 * step)
            assert after.factors[k, f] == pytest.approx(factors[k, f] - s.rate * g / np.sqrt(1e-2 + g * g), abs=1e-3)


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i} " * (1 + i % 3)) for i in range(400)] + [(1, "text 1 text 1 ")] * 5, "doc_id long, text string").withColumn("y", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = labelled.sample(docs, labels, "toxic", 30).collect()
    assert len(got) == 30 and len({(r.doc_id, r.text) for r in got}) == 30 and all(r.y == r.doc_id % 2 and r.doc_id < 50 for r in got)
    assert labelled.gathered(spark.createDataFrame([(1, 0, b"x" * 9), (2, 0, b"x" * 9)], "doc_id long, y int, f binary"), "f", 1).num_rows == 2
    many = spark.createDataFrame([(i, 0, b"x" * 9000) for i in range(4)], "doc_id long, y int, f binary")
    assert labelled.gathered(many, "f", 1).num_rows == 1
    # one that is too large by itself doesn't take the others with it
    large = spark.createDataFrame([(i, 0, b"x" * (labelled.ROW_BYTES * 30 if i == 3 else 5)) for i in range(20)], "doc_id long, y int, f binary")
    assert labelled.gathered(large, "f", 20).num_rows == 19
    with pytest.raises(ValueError):
        labelled.gathered(large.where("doc_id = 3"), "f", 20)
    assert labelled.gathered(large.limit(0), "f", 20).num_rows == 0
    assert len(toxicity.fold_losses(docs, labels, [toxicity.Ftrl(epochs=1)])) == 1 and len(quality.fold_losses(docs, labels, [quality.Settings(epochs=1)], "toxic")) == 1
    wide = toxicity.score(docs.withColumn("score", F.lit(3)), toxicity.fit(docs, labels), "_score")
    assert wide.columns == ["doc_id", "text", "y", "score", "_score"] and wide.count() == 405


def benchmark_of(spark):
    chance = random.Random(11)
    word = lambda: "".join(chance.choice("abcdefgh") for _ in range(chance.randint(2, 5)))
    items = [" ".join(word() for _ in range(chance.randint(12, 59))) for _ in range(40)] + ["short one", "x", "", None]
    noise = lambda n: " ".join(word() for _ in range(n))
    docs = [noise(300), None, "", f"{noise(200)} {items[3].upper()}, {noise(100)}", f"{items[7]}!", f"{noise(50)}\n{items[9]} {items[10]}", noise(5), f"{noise(70)} {items[12]} {noise(40000)}"]
    return docs_of(spark, docs), spark.createDataFrame([(i, t, i) for i, t in enumerate(items)], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("settings", [decontaminate.Settings(), decontaminate.Settings(pass_bytes=2000, index_items=7)])
def test_decontamination(spark, settings):
    docs, items = benchmark_of(spark)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, items, settings).collect()}
    assert {(3, 3), (4, 7), (5, 9), (5, 10), (7, 12)} <= got and all(i in (40, 41) or (d, i) in {(3, 3), (4, 7), (5, 9), (5, 10), (7, 12)} for d, i in got)
    assert decontaminate.contamination(docs.limit(0), items, settings).count() == 0
    assert decontaminate.contamination(docs, items.limit(0), settings).count() == 0


def test_pairs_that_only_edits_find_are_told_apart(spark, tmp_path):
    docs, items = benchmark_of(spark)
    words = next(r.text for r in items.collect() if r.item_id == 7).split()
    edited = " ".join("zzz" if i % 4 == 2 else w for i, w in enumerate(words))
    rows = docs.union(docs_of(spark, [f"so {edited} so"], 100))
    found = {(r.doc_id, r.item_id): r for r in decontaminate.contamination(rows, items).collect()}
    assert found[100, 7].edited and found[100, 7].question_overlap < 0.5 and not found[4, 7].edited
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {(r.doc_id, r.item_id) for r in decontaminate.query(spark, str(tmp_path)).collect()} == {k for k, r in found.items() if not r.edited}


def test_decontamination_of_repeated_and_nameless_rows(spark):
    docs, items = benchmark_of(spark)
    text = next(r.text for r in items.collect() if r.item_id == 7)
    twice = items.where("item_id = 7").union(items.where("item_id = 7")).union(items.where("item_id = 9"))
    rows = spark.createDataFrame([(None, f"so {text} so"), (1, text), (1, text), (2, None)], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = sorted((str(r.doc_id), r.item_id) for r in decontaminate.contamination(rows, twice).collect())
    assert got == [("1", 7)] * 4 + [("None", 7)] * 2


def test_decontamination_finds_edited_items(spark):
    _, items = benchmark_of(spark)
    texts = {r.item_id: r.text.split() for r in items.where("item_id < 40").collect()}
    docs, want = [], set()
    for i, w in texts.items():
        n = len(w) // 4
        for k in range(n):  # each word of the answer changed, left out, or with a new one before it
            for own in ([*w[: len(w) - n + k], "zz", *w[len(w) - n + k + 1 :]], w[: len(w) - n + k] + w[len(w) - n + k + 1 :], [*w[: len(w) - n + k], "zz", *w[len(w) - n + k :]]):
                want.add((len(docs), i))
                docs.append("zzz " * 30 + " ".join(own) + " yyy" * 30)
        for k in range(len(w) - n):
            want.add((len(docs), i))
            docs.append(" ".join([*w[:k], "zz", *w[k + 1 :]]))
    whole = len(docs)
    docs += [" ".join(w[: len(w) - len(w) // 4]) + " zzz" * 30 for w in texts.values()]  # no answer
    docs += [" ".join(w[len(w) - len(w) // 4 :]) + " zzz" * 30 for w in texts.values()]  # no question
    # each second word another: too many edits
    docs += [" ".join(x if k % 2 else "zz" for k, x in enumerate(w)) for w in texts.values()]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs_of(spark, docs), items.where("item_id < 40")).collect()}
    assert got == want and max(d for d, _ in got) < whole


def test_edits_against_brute_force():
    chance = np.random.default_rng(4)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    for _ in range(60):
        part, words = chance.integers(0, 4, chance.integers(1, 7)), chance.integers(0, 4, chance.integers(0, 12))
        assert decontaminate._edits(part, words).tolist() == [min(distance(part, words[i:j]) for i in range(j + 1)) for j in range(len(words) + 1)]
        answer = chance.integers(0, 4, chance.integers(1, 4))
        want = any(distance(part, words[i:j]) <= len(part) * 2 // 5 and distance(answer, words[j:k]) <= len(answer) * 2 // 5 for i in range(len(words) + 1) for j in range(i, len(words) + 1) for k in range(j, len(words) + 1))
        assert decontaminate._stands(part, answer, words, 0.4) == want


def test_block_max_wand_against_all_scores():
    chance = random.Random(13)
    texts = [" ".join(chance.choice("abcdefghijklmnop") + chance.choice("qrst") for _ in range(chance.randint(3, 40))) for _ in range(90)]
    words = [set(t.split()) for t in texts]
    df: dict = {}
    import pyarrow as pa

    for t in texts:
        for h in np.unique(decontaminate.words_of(pa.array([t]))[0]).tolist():
            df[h] = df.get(h, 0) + 1
    index = decontaminate.Index(list(range(90)), texts, decontaminate.Settings(), (90, 20.0, df))
    for t in texts[:30]:
        query = np.unique(index.numbers(decontaminate.words_of(pa.array([t]))[0])).tolist()
        scores = np.zeros(90)
        for q in query:
            a, b = index.begins[q], index.begins[q + 1]
            scores[index.items[a:b]] += index.impacts[a:b]
        for least in (0.1, 0.4, 0.9):
            assert dict(index.search(query, least)) == pytest.approx({i: s for i, s in enumerate(scores) if s >= least})
    assert words


def test_licences(spark):
    mit = licenses.KNOWN[0][1]
    texts = [mit, f"Copyright (c) 2020 Somebody\n\n{mit.upper()}", mit.replace("sublicense", "sublicense").replace('"Software"', "'software'"), f"{mit} and more", None, "", "Released under the MIT licence", "word " * 50000]
    got = {r.doc_id: r.licence for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: "MIT", 7: None}
    own = spark.createDataFrame([("X", "Some text"), ("A", "some  text!"), (None, "other"), ("Z", "...")], "licence string, text string")
    assert [r.licence for r in licenses.scan(docs_of(spark, ["SOME TEXT", "other", "!"]), own).orderBy("doc_id").collect()] == ["A", None, None]
    nobody = spark.createDataFrame([(None, mit), (None, mit), (3, None)], "doc_id long, text string").withColumns({"digest": F.lit(1), "licence": F.lit(2)})
    assert sorted(map(str, ((r.doc_id, r.licence) for r in licenses.scan(nobody).collect()))) == sorted(map(str, [(None, "MIT"), (None, "MIT"), (3, None)]))
    assert licenses.scan(nobody.limit(0)).count() == 0


@pytest.mark.parametrize("name, licence", [("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")])
def test_full_licence_texts(spark, tmp_path, name, licence):
    """Whole texts, as they stand on many systems, in capitals and with another notice; one word more is no licence."""
    path = pathlib.Path("/usr/share/common-licenses") / name
    if not path.exists():
        pytest.skip("no licence texts here")
    text = path.read_text(encoding="utf-8")
    texts = [text, text.upper(), f"Copyright 2021 A. Nobody\n\n{text}", " ".join(text.split()), f"{text} more"]
    docs = docs_of(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.licence for r in licenses.query(spark, str(tmp_path)).collect()}
    flat = None if licence in ("Apache-2.0", "GPL-3.0", "LGPL-2.1") else licence  # a copyright line inside the text can't be told from others once lines are joined
    assert {k: v for k, v in got.items() if k != 3} == {0: licence, 1: licence, 2: licence, 4: None} and got[3] in (flat, licence)


def test_fixity(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 7)) for i in range(3000)] + [(5000, None, None), (None, "u", "é"), (None, "v", "è"), (7, "http://x/7", "<p>7</p>" * 0), (4, "long", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shard", F.lit(1)).withColumn("place", F.lit(1))

    def stored(table, name):
        fixity.write_archive(fixity.records(table), str(tmp_path / name))
        return tmp_path / name

    def tree(path):
        return fixity.Tree(fixity.read_archive(spark, str(path)))

    def rewritten(name, change):
        """A copy of the first archive with the second shard's uncompressed bytes changed."""
        shutil.copytree(tmp_path / "one", tmp_path / name)
        file = next((tmp_path / name / "shard=1" / "part=0").glob("part-*"))
        file.write_bytes(change(file.read_bytes()))
        for check in file.parent.glob(".*.crc"):
            check.unlink()
        return tree(tmp_path / name)

    one = tree(stored(pages, "one"))
    assert one.leaf.count() == len(rows) and one.leaf.where("shard < -1000").select("shard").distinct().count() == 2
    want = {r.record: (r.page_id, r.shard) for r in fixity.records(pages).collect()}
    assert {(hashlib.sha256(k.encode()).hexdigest(), *v) for k, v in want.items()} == {(r.sha256, r.page_id, r.shard) for r in one.leaf.collect()}
    assert fixity.audit(one, tree(stored(pages.repartition(5), "same"))).count() == 0
    wrong = fixity.audit(one, tree(stored(fixity.damaged_copy(pages, F.col("page_id") % 500 == 3), "hurt")))
    assert {r.page_id for r in one.leaf.join(wrong, ["shard", "part", "place"]).collect()} == {3, 503, 1003, 1503, 2003, 2503}
    # a lost record shows from its place on, and not before
    lost = fixity.audit(one, tree(stored(pages.where("page_id <> 2990 OR page_id IS NULL"), "lost")))
    assert {r.shard for r in lost.collect()} == {2} and lost.count() == 10
    # one byte of a body on disk, a header, a cut-off file, and damage to the compressed bytes
    def flip(offset):
        def change(content):
            plain = bytearray(gzip.decompress(content))
            plain[offset] ^= 1
            return gzip.compress(bytes(plain))

        return change

    plain = gzip.decompress(next((tmp_path / "one" / "shard=1" / "part=0").glob("part-*")).read_bytes())
    places = {r.place: r.offset for r in one.leaf.where("shard = 1").collect()}
    at = lambda audit: sorted(r.place for r in audit.collect())
    assert at(fixity.audit(one, rewritten("body", flip(places[11] - 5)))) == [10]
    assert at(fixity.audit(one, rewritten("head", flip(places[20] + plain[places[20] :].index(b"Content-Length") + 1)))) == [20]
    assert at(fixity.audit(one, rewritten("cut", lambda c: gzip.compress(gzip.decompress(c)[: places[1000] + 30])))) == list(range(1000, 1024))
    damage = at(fixity.audit(one, rewritten("bits", lambda c: c[: len(c) // 2] + bytes(64) + c[len(c) // 2 + 64 :])))
    assert damage and damage[-1] >= 1023 and damage[0] > 100
    # a shard of one repeated id is split
    monkeypatch.setattr(fixity, "PART_RECORDS", 16)
    hot = spark.range(400).select(F.lit(9).cast("long").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html"))
    assert tree(stored(hot, "hot")).leaf.select("part").distinct().count() > 10
    empty = tree(stored(pages.limit(0), "empty"))
    assert fixity.audit(empty, empty).count() == 0 and fixity.audit(one, empty).count() == len(rows)


def test_sharding(spark, tmp_path):
    docs = docs_of(spark, [*HARD, *(f"text {i} " * 50 for i in range(400))])
    policy = sharding.Policy(target=40_000, fan_in=3)
    store = sharding.ShardStore(spark, str(tmp_path / "store"), policy)
    for i in range(5):
        store.append(docs.where(f"doc_id % 5 = {i}").repartition(3))
    before = store.version()
    small = len(store.manifest()["files"])
    store.compact()
    assert len(store.manifest()["files"]) < small and store.version() > before
    for version in (before, store.version()):
        assert sorted(map(str, store.read(version).collect())) == sorted(map(str, docs.collect()))
    with pytest.raises(sharding.Conflict):
        store.commit(before, store.manifest()["schema"], {})
    assert store.vacuum() > 0 and store.read().count() == docs.count()
    with pytest.raises(ValueError):
        store.append(docs.select("doc_id"))
    assert json.loads((tmp_path / "store" / "manifest" / f"{1:012d}.json").read_text())["version"] == 1
    files = store.manifest()["files"]
    assert not store.due() and max(files.values()) < 1.5 * policy.target and sum(p.stat().st_size for p in (tmp_path / "store" / "data").rglob("*.parquet")) == sum(files.values())
    # an incompressible tier that can't shrink doesn't keep larger ones from being merged
    odd = sharding.ShardStore(spark, str(tmp_path / "odd"), sharding.Policy(target=40_000, fan_in=2))
    noise = spark.range(40).select("id", F.sha2(F.col("id").cast("string"), 512).alias("x"), F.lit(None).cast("string").alias("gone"))
    for _ in range(3):
        odd.append(noise.repartition(2))
    odd.compact()
    assert not odd.due() and odd.read().count() == 120 and odd.read().where("gone is null").count() == 120
    bad = sharding.ShardStore(spark, str(tmp_path / "store"), policy)
    made = bad._write(docs)
    with pytest.raises(sharding.Conflict):
        bad._kept(made, lambda: bad.commit(0, "", made))
    assert not any((tmp_path / "store" / n).exists() for n in made)
    nulls = spark.createDataFrame([(None, None), (None, "x" * 200_000), (1, "")], "doc_id long, text string").withColumn("_file", F.lit("clash"))
    assert sorted(map(str, sharding.shard(nulls).read().collect())) == sorted(map(str, nulls.collect()))
    assert sharding.shard(docs.limit(0)).read().count() == 0


def test_the_query_of_sharding_compacts(spark, tmp_path, monkeypatch):
    """On small tables too; and it would show if compaction did nothing."""
    docs_of(spark, [f"text {i} " * 20 for i in range(200)]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = sharding.query(spark, str(tmp_path)).collect()
    assert len(rows) == 200 and all(r.fits and r.listed and r.settled and r.compacted for r in rows)
    store = sharding.shard(spark.read.parquet(str(tmp_path / "documents.parquet")))
    first = [len(store.manifest(v)["files"]) for v in range(1, store.version() + 1)]
    assert max(first) >= 8 and len(store.manifest()["files"]) < 4 and all(size > 1000 for size in store.manifest()["files"].values())
    with pytest.raises(ValueError):
        store.append_each(docs_of(spark, ["x"]), F.lit(0), 1)
    monkeypatch.setattr(sharding.ShardStore, "compact", lambda self: self.version())
    assert not any(r.compacted or r.settled for r in sharding.query(spark, str(tmp_path)).collect())


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 150)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 20)
    chance = np.random.default_rng(17)
    x = chance.integers(-9, 9, (700, 6)).astype(float)
    x[200:420] = x[7]  # many equal vectors: ties go to smaller ids
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1050, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1100, [float("nan")] * 6), (1150, []), (None, [1.0] * 6), (1200, [1.0, 2.0])]
    table = spark.createDataFrame(rows + bad, "vec_id long, v array<double>").withColumn("score", F.lit(0))
    got = {}
    for r in topk.top_k(table, table.where("vec_id % 10 = 0"), 5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    scores = (x @ x.T).astype(int)
    for q in range(0, 700, 10):
        want = sorted((-int(s), i) for i, s in enumerate(scores[q]) if i != q)[:5]
        assert [got[q][k] for k in range(1, 6)] == [(i, -s) for s, i in want]
    assert set(got) == set(range(0, 700, 10))
    assert topk.top_k(table.limit(0), table, 5).count() == 0


@pytest.mark.parametrize("scale", [10**6, 10**9, 10**13])
def test_top_k_is_exact_for_large_numbers(spark, monkeypatch, scale):
    """Scores beyond 2**53 and beyond 64 bits, and rows that share a vec_id."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    chance = random.Random(scale)
    base = [scale + chance.randrange(5) for _ in range(8)]
    rows = [(i // 2, [float(v + chance.randrange(3)) for v in base]) for i in range(200)]
    rows += [(3, rows[0][1])] * 2
    table = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = {}
    for r in topk.top_k(table, table.where("vec_id % 10 = 0"), 5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    dot = lambda x, y: sum(int(a) * int(b) for a, b in zip(x, y))
    for q in range(0, 100, 10):
        pairs = sorted((-min(dot(x, y), 2**63 - 1), j) for i, x in rows if i == q for j, y in rows if j != q)[:5]
        assert [got[q][k] for k in range(1, 6)] == [(j, -s) for s, j in pairs]


def test_top_k_of_rows_that_share_an_id(spark):
    """With numbered rows, each query row is ranked by itself and only its own row is left out."""
    chance = np.random.default_rng(2)
    x = chance.integers(-9, 9, (60, 20)).astype(float)
    rows = [(i // 2, v.tolist(), i) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, v array<double>, row long")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(table, table.where("vec_id % 5 = 0"), 5).collect())
    want = []
    for i, v, n in rows:
        if i % 5 == 0:
            best = sorted((-int(np.dot(v, w)), j) for j, w, m in rows if m != n)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_most_scores_are_not_finished():
    """In the given 64 dimensions balls rule out nothing; the heads of the vectors rule out most pairs."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    x, ids = np.floor(256 * np.array(table["embedding"].to_pylist(), float)), table["vec_id"].to_numpy()
    shard = topk._Leaves(x, ids, np.arange(len(x)))
    who = np.flatnonzero(ids % 50 == 0)
    best = shard.search(x[who], who, np.full(len(who), -np.inf), 5)
    scores = x[who] @ x.T
    scores[np.arange(len(who)), who] = -np.inf
    for row, own in zip(best, scores):
        assert [(-i, s) for s, i in row] == sorted(zip(ids.tolist(), own.tolist()), key=lambda p: (-p[1], p[0]))[:5]
    assert shard.finished < 0.4 * shard.pairs


def test_copies_are_indexed_once_a_task(spark, monkeypatch):
    """One text in every slice of every task: its entries grow with the tasks, not with its copies."""
    text, entries = " ".join(f"w{i % 41}{i}" for i in range(400)), {}
    for copies in (40, 4000):
        docs = spark.range(copies).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")).repartition(4)
        join = ngram_join._Join(docs, ngram_join.Fraction(4, 5), 5)
        join.prepare()
        dealt = []
        monkeypatch.setattr(type(docs), "repartition", lambda self, *a, **k: dealt.append(self) or self)
        join.index(396)
        monkeypatch.undo()
        entries[copies] = dealt[0].agg(F.sum(F.octet_length("keys") / 8)).first()[0]
    assert entries[4000] == entries[40] > 0


def test_equal_records_are_dealt_in_turn(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixity, "PART_RECORDS", 500)
    pages = spark.range(10_000).select(F.lit(5).cast("long").alias("page_id"), F.lit("u").alias("url"), F.lit("<p>same</p>").alias("html")).union(spark.range(1024, 1100).selectExpr("id", "'v'", "'x'"))
    sizes = {(r.shard, r.part): r["count"] for r in fixity.records(pages).groupBy("shard", "part").count().collect()}
    assert len(sizes) == 21 and max(sizes.values()) == 500 and sum(sizes.values()) == 10_076
    fixity.write_archive(fixity.records(pages), str(tmp_path / "one"))
    one = fixity.Tree(fixity.read_archive(spark, str(tmp_path / "one")))
    assert one.leaf.count() == 10_076 and fixity.audit(one, one).count() == 0
    # bytes count as well as rows
    monkeypatch.setattr(fixity, "PART_BYTES", 100_000)
    long = spark.range(0, 40).select("id", F.lit("u"), F.repeat(F.lit("y"), 50_000)).toDF("page_id", "url", "html")
    assert fixity.records(long).select("shard", "part").distinct().count() > 10


def test_shingles_of_slices():
    import pyarrow as pa

    texts = pa.array(["x y", "a b c d e f", None, "A B c d e f", "q"])
    whole, bounds = shingles.shingle_sets(texts)
    assert np.diff(bounds).tolist() == [1, 2, 0, 2, 1] and whole[1:3].tolist() == whole[3:5].tolist()
    part, cut = shingles.shingle_sets(texts.slice(1, 3))
    assert np.diff(cut).tolist() == [2, 0, 2] and part.tolist() == whole[1:5].tolist()


