"""Stages of the pipeline on rows without id, repeated rows and shared ids."""

import corpus_pipeline as pipeline


def test_stages_decide_by_row(spark, tmp_path):
    near = [f"w{i}" for i in range(80)]
    item = " ".join(f"q{i}" for i in range(30))
    one, other, bad = " ".join(near), " ".join([*near, "z"]), f"some {item} more"
    rows = [(5, other), (3, one), (3, one), (None, one), (3, "another text of the same id"), (None, "alone"), (None, ""), (9, ""), (9, None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _score int")
    key = lambda r: (str(r[0]), str(r[1]))
    left = pipeline.one_of_each_group(spark, docs, "").collect()
    assert sorted([(r.doc_id, r.text) for r in left], key=key) == sorted([(3, one), (3, "another text of the same id"), (None, "alone"), (None, ""), (9, ""), (9, None)], key=key)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, bad), (4, bad), (4, "clean"), (None, "clean too"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = pipeline.decontaminated(spark, docs, str(tmp_path))
    assert sorted(map(tuple, left.collect()), key=key) == sorted([(4, "clean"), (None, "clean too"), (6, None)], key=key) and left.columns == ["doc_id", "text"]


def plain_toxic(model, text):
    """The score of a text by a plain sum over its distinct features."""
    import math

    import pyarrow as pa

    from tierlake.llm import toxicity

    weights = dict(zip(model.features.tolist(), model.weights.tolist()))
    total = model.bias + sum(weights.get(int(x) & ((1 << toxicity.BITS) - 1), 0.0) for x in toxicity.features(pa.array([text], pa.string())))
    return 1 / (1 + math.exp(-max(min(total, 50), -50)))


def plain_quality(model, text):
    """The score of a text by all pairs of its features."""
    import math

    import pyarrow as pa

    from tierlake.llm import quality

    _, what, x = quality.features(pa.array([text], pa.string()))
    total = model.bias + sum(float(model.linear[i]) * v for i, v in zip(what, x))
    for a in range(len(what)):
        for b in range(a):
            total += float(model.factors[what[a]] @ model.factors[what[b]]) * x[a] * x[b]
    return 1 / (1 + math.exp(-max(min(total, 50), -50)))


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept, with nulls, empty and repeated rows, a long text and columns of clashing names."""
    import hashlib
    import random

    import public_tokenizers
    import tokenizers

    from test_llm import brute_components

    from tierlake.llm import quality, toxicity

    chance = random.Random(31)
    plain = ["the", "house", "river", "green", "walks", "under", "evening", "quiet", "letters", "stone"]
    rows, marks = [], []
    for i in range(420):
        words = [chance.choice(plain) + chance.choice(["", "s", "ing"]) for _ in range(chance.randint(20, 60))]
        toxic, bad = i % 5 == 0, i % 7 == 0
        if toxic:
            words[3], words[9] = "moronish", "idiotic"
        text = " ".join(words)
        rows.append((i, text.upper().replace(" ", "!! ") if bad else text))
        marks.append((i, int(not bad), int(toxic)))
    items = [" ".join(f"q{k}x{j}" for j in range(25)) for k in range(4)]
    base = rows[1][1].split()
    rows += [(500 + k, " ".join([*base[: 3 + k], chance.choice(plain), *base[3 + k :]])) for k in range(6)]
    rows += [(600, f"{rows[2][1]} {items[1]} {rows[3][1]}"), (601, items[2]), (None, f"{rows[4][1]} {items[3]}"), (602, None), (603, ""), (None, rows[8][1]), (rows[9][0], rows[9][1]), (604, "quiet river " * 3000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 1) for i, t in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf, docs = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    key = lambda r: (str(r[0]), str(r[1]))
    seen = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "bpe":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        seen[name] = sorted([(r[0], r["text"]) for r in docs.collect()], key=key)
        docs = spark.read.parquet(str(tmp_path / name))
        seen[f"{name} kept"] = sorted([(r[0], r["text"]) for r in docs.collect()], key=key) if name != "bpe" else docs.collect()
    whole = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity.fit(whole, labels)
    want = [r for r in seen["toxicity"] if plain_toxic(model, r[1]) < toxicity.TOXIC_FROM]
    assert want == seen["toxicity kept"] and 250 < len(want) < 400
    model = quality.fit(whole, labels)
    want = [r for r in seen["quality"] if plain_quality(model, r[1]) >= quality.GOOD_FROM]
    assert want == seen["quality kept"] and len(want) < len(seen["quality"])
    before = seen["near_duplicates"]
    groups = {}
    for i, (n, c) in brute_components([t for _, t in before]).items():
        groups.setdefault(c if n else -1 - i, []).append(before[i])
    assert len(seen["near_duplicates kept"]) == len(groups) < len(before)
    for own in groups.values():
        least = min((r[0] for r in own if r[0] is not None), default=None)
        assert sum(r in seen["near_duplicates kept"] and r[0] == least for r in set(own)) >= 1
    want = [r for r in seen["decontamination"] if not any(x in (r[1] or "") for x in items)]
    assert want == seen["decontamination kept"] and len(want) < len(seen["decontamination"])
    codec = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    import numpy as np

    for r in seen["bpe kept"]:
        assert r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest() and r.n_tokens == len(r.ids) // 4
    ids = sorted(bytes(r.ids) for r in seen["bpe kept"])
    assert ids == sorted(np.array(codec.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for _, t in seen["bpe"])


def test_run_is_the_stages(spark, tmp_path):
    rows = [(i, f"text {i} of some words that differ {i * 7} and more of them {i}", "en", "s", 1) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "ids"] and got.count() == 40
    empty = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_a_fit_gives_the_samples_memory_back(monkeypatch):
    """What the driver gathered for a classifier is freed, and then returned to the system, before later stages need room."""
    import weakref

    import numpy as np

    from tierlake.llm import quality, toxicity

    left = []
    for classifier in (toxicity, quality):
        gathered = [np.arange(4, dtype=np.uint32) for _ in range(8)]
        seen, truth = [weakref.ref(x) for x in gathered], np.array([0, 1] * 4, float)
        values = [[np.ones(4, np.float32) for _ in gathered]] if classifier is quality else []
        parts = [gathered, *values, truth]
        del gathered, values
        monkeypatch.setattr(classifier, "_examples", lambda *a, p=parts: tuple(p.pop(0) for _ in range(len(p))))
        monkeypatch.setattr(classifier, "give_back", lambda s=seen: left.append(sum(x() is not None for x in s)))
        classifier.fit(None, None)
    assert left == [0, 0]
