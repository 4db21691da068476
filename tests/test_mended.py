"""Faults that were found in the query language and the corpus, each with a small case; refinement against a plain loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import COLUMNS, talk
from tierlake.corpus import Corpus
from tierlake.errors import QueryError
from tierlake.operators import formants, measures, pauses
from tierlake.plans.dsl import Count, InterquartileRange, Median, Quantile, or_
from tierlake.schema import Schema


def words(spark, rows):
    table = spark.createDataFrame([(str(i), label, float(i), i + 1.0, "d", "s", p, q) for i, (label, p, q) in enumerate(rows)], "id string, label string, begin double, end double, discourse string, speaker string, p string, q double")
    return Corpus(spark, "w", Schema({"word": None}), {"word": table})


def ids(query):
    return sorted(r.id for r in query.frame().collect())


def test_nulls_are_neither_in_nor_not_in(spark):
    c = words(spark, [("a", "x", 1.0), ("b", None, 2.0), ("c", "y", 3.0), ("d", "y", None)])
    w = c.word
    inner = lambda: c.query(c.word).filter(or_(c.word.label == "a", c.word.label == "b")).columns(c.word.p)  # x and null
    assert ids(c.query(w).filter(w.p.not_in_(["x"]))) == ids(c.query(w).filter(w.p.not_in_(inner()))) == ["2", "3"]
    assert ids(c.query(w).filter(w.p.in_(["x"]))) == ids(c.query(w).filter(w.p.in_(inner()))) == ["0"]
    assert ids(c.query(w).filter(w.p.not_in_(["x", None]))) == ["2", "3"] and ids(c.query(w).filter(w.p.in_([None]))) == []
    either = or_(w.p.not_in_(inner()), w.label == "b")
    assert ids(c.query(w).filter(either)) == ["1", "2", "3"]
    assert ids(c.query(w).filter(or_(w.p.not_in_(inner()), w.label == "none"))) == ["2", "3"]


def test_expressions_match_whole_strings(spark):
    c = words(spark, [("d", "x", 1.0), ("d\n", "x", 1.0), ("dd", "x", 1.0), ("a\nd", "x", 1.0)])
    assert ids(c.query(c.word).filter(c.word.label.regex("d"))) == ["0"]
    assert ids(c.query(c.word).filter(c.word.label.regex("d|dd"))) == ["0", "2"]
    assert sorted(r.id for r in pauses.encode_pauses(c.tokens["word"], "d").where("is_pause").collect()) == ["0"]


@pytest.mark.parametrize("gathered", [0, 10**6])
def test_quantiles_of_queries_are_exact(spark, gathered, monkeypatch):
    monkeypatch.setattr(measures.quantiles, "__defaults__", (32, gathered))
    chance = random.Random(2)
    rows = [(chance.choice("abc"), chance.choice(["x", None]), chance.choice([None, float(chance.randint(0, 30)), chance.random() * 30])) for _ in range(600)] + [("none", "x", None)]
    c = words(spark, rows)
    w = c.word
    out = c.query(w).group_by(w.label.column_name("label"), w.p.column_name("p")).aggregate(Median(w.q).column_name("m"), Quantile(w.q, 0.9).column_name("u"), InterquartileRange(w.q).column_name("i"), Median(w.begin).column_name("b"), Count().column_name("n"))
    got = {(r.label, r.p): tuple(r)[2:] for r in out.collect()}
    rank = lambda v, p: v[max(int(np.ceil(p * len(v) - 1e-12)), 1) - 1] if v else None
    for key in {(a, b) for a, b, _ in rows}:
        v = sorted(q for a, b, q in rows if (a, b) == key and q is not None)
        at = [float(i) for i, (a, b, _) in enumerate(rows) if (a, b) == key]
        assert got[key] == (rank(v, 0.5), rank(v, 0.9), rank(v, 0.75) - rank(v, 0.25) if v else None, rank(at, 0.5), len(at))
    assert len(got) == 7
    assert c.query(w).aggregate(Median(w.q)) == rank(sorted(q for *_, q in rows if q is not None), 0.5)
    few = c.query(w).group_by(w.label.column_name("label")).filter(Median(w.q) > 1e9).aggregate(Count())
    assert few.count() == 0


def test_a_removed_discourse_takes_all_with_it(spark):
    c = talk(spark)
    c.types["word"] = spark.createDataFrame([(x, len(x)) for x in ("mela", "tok", "kanto", "strel", "unheard")], "label string, size int")
    rows = [(f"s{i}", r.id, r.begin, r.end) for i, r in enumerate(c.tokens["word"].collect())]
    c.add_subannotations("word", "mark", spark.createDataFrame(rows, "id string, annotated_id string, begin double, end double"))
    c.tracks["f"] = spark.createDataFrame([("walk", "ana", 1.0, 2.0), ("rest", "ana", 1.0, 2.0)], "discourse string, speaker string, time double, f double")
    c.remove_discourse("walk")
    left = {r.id for r in c.tokens["word"].collect()}
    assert len(left) == 2 and {r.annotated_id for r in c.subannotations["word", "mark"].collect()} == left
    assert {r.label for r in c.types["word"].collect()} == {"strel", "tok", "unheard"}
    assert c.tracks["f"].count() == 1 and [r.name for r in c.discourses.collect()] == ["rest"]


def test_equal_tokens_keep_ids_of_their_own(spark):
    rows = [("a", 0.0, 1.0), ("a", 0.0, 1.0), ("b", 0.0, 1.0)]
    tier = lambda rows: spark.createDataFrame([(*r, "d", "s") for r in rows], "label string, begin double, end double, discourse string, speaker string")
    c = Corpus.from_tiers(spark, "t", {"phone": tier(rows), "word": tier([("w", 0.0, 4.0), ("w", 0.0, 4.0), ("inner", 0.2, 0.4)])}, ["phone", "word"])
    got = c.tokens["phone"].collect()
    assert len({r.id for r in got}) == 3 and len({r.word_id for r in got}) == 1
    first = Corpus.from_tiers(spark, "t", {"phone": tier(rows[:1]), "word": tier([])}, ["phone", "word"]).tokens["phone"].first()
    assert first.id in {r.id for r in got} and first.word_id is None
    # a short word inside a long one doesn't hide it
    assert c.query(c.phone).filter(c.phone.word.label == "w").count() == 3


def test_properties_by_time_reach_every_token(spark):
    c = talk(spark)
    c.tokens["word"] = c.tokens["word"].unionByName(spark.createDataFrame([("over", "over", 0.0, 9.0, "walk", "ana", "first")], ", ".join(f"{x} {'double' if x in ('begin', 'end') else 'string'}" for x in (*COLUMNS[:4], "discourse", "speaker", "line_id"))))
    at = spark.createDataFrame([("walk", 0.1, 5), ("walk", 3.3, 6), ("walk", 9.5, 7)], "discourse string, time double, hit int")
    c.enrich_tokens_at("word", at)
    got = {r.id: r.hit for r in c.tokens["word"].where("hit is not null").collect()}
    assert got == {"over": 6, "w0": 5, "w9": 6}


def test_levels_open_when_asked(spark):
    opened = []

    def level(name):
        def table():
            opened.append(name)
            return spark.createDataFrame([("1", "x", 0.0, 1.0, "d", "s", "2", 5)], f"id string, label string, begin double, end double, discourse string, speaker string, top_id string, of_{name} int")

        return table

    c = Corpus(spark, "lazy", Schema({"low": "top", "top": None}), {n: level(n) for n in ("low", "top")}, {"top": lambda: opened.append("types") or spark.createDataFrame([("x", 1)], "label string, size int")})
    assert opened == []
    assert c.query(c.low).filter(c.low.of_low == 5).count() == 1 and opened == ["low"]
    assert c.query(c.low).columns(c.low.top.size).count() == 0
    assert set(opened) == {"low", "top", "types"} and c.schema.has("token", "top", "of_top") and c.schema.has("type", "top", "size")
    assert [r.name for r in c.speakers.collect()] == ["s"] and c.speaks_in.count() == 1


def loop_refined(rows, default, rounds, given=None):
    """The same refinement, group by group with numpy."""
    groups = {}
    for g, token, k, *x in rows:
        groups.setdefault(g, {}).setdefault(token, []).append((k, x))
    out = {}
    for g, tokens in groups.items():
        pick = {t: next((c for c in cs if c[0] == default), min(cs)) for t, cs in tokens.items()}
        if len(tokens) >= formants.LEAST_TOKENS:
            for turn in range(rounds):
                x = np.array([c[1] for c in pick.values()])
                mean, cov = given[g] if given and g in given and not turn else (x.mean(0), np.cov(x, rowvar=False))
                inverse = np.linalg.pinv(np.array(cov))
                far = lambda c: float((np.array(c[1]) - mean) @ inverse @ (np.array(c[1]) - mean))  # noqa: B023, E731
                new = {t: min(cs, key=lambda c: (far(c), c[0])) for t, cs in tokens.items()}
                if new == pick:
                    break
                pick = new
        out |= {(g, t): c[0] for t, c in pick.items()}
    return out


def test_refinement_equals_a_loop_over_groups(spark):
    rng = np.random.default_rng(8)
    rows = [(g, t, k, *rng.normal([500 + 40 * k, 1500, 2500 - 90 * k], [60, 90, 120]).tolist()) for g, n in (("a", 80), ("b", 7), ("c", 4), (None, 9)) for t in range(n) for k in range(5)]
    rows += [("d", t, 2, 1.0, 2.0, 3.0) for t in range(8)] + [("e", t, k, 1.0 * k, 2.0 * k, 3.0 * k) for t in range(3) for k in (3, 4)]
    table = spark.createDataFrame(rows, "g string, token int, k int, f1 double, f2 double, f3 double")
    given = {"b": ([520.0, 1500.0, 2400.0], [[900.0, 0.0, 0.0], [0.0, 2500.0, 0.0], [0.0, 0.0, 4900.0]])}
    for rounds in (1, 20):
        got = {(r.g, r.token): r.k for r in formants.refined(table, ["f1", "f2", "f3"], ["g"], "token", "k", default=1, rounds=rounds, prototypes_of={("b",): given["b"]}).collect()}
        assert got == loop_refined(rows, 1, rounds, given)
    assert formants.refined(table.limit(0), ["f1", "f2"], ["g"], "token", "k").count() == 0


def test_short_stretches_join_without_python(spark):
    chance = random.Random(6)
    rows, want = [], {}
    for d in range(40):
        t, stretches = 0.0, []
        for _ in range(chance.randint(1, 25)):
            t += chance.choice([0.6, 0.7, 1.0, 2.0])
            length = chance.choice([0.1, 0.2, 0.25, 0.5, 1.0])
            stretches.append((round(t, 2), round(t + length, 2)))
            t += length
        rows += [(f"{d}-{i}", "w", b, e, f"d{d}", False) for i, (b, e) in enumerate(stretches)]
        out = []
        for i, (b, e) in enumerate(stretches):
            if e - b < 0.3:
                after = stretches[i + 1][0] - e if i + 1 < len(stretches) else float("inf")
                if out and b - out[-1][1] < after:
                    out[-1] = (out[-1][0], e, out[-1][2] + 1)
            else:
                out.append((b, e, 1))
        want[f"d{d}"] = out
    table = spark.createDataFrame(rows, "id string, label string, begin double, end double, discourse string, is_pause boolean")
    found = pauses.utterances(table, 0.5, 0.3)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.discourse, r.utterance)):
        got.setdefault(r.discourse, []).append((r.begin, r.end, r.n_words))
    assert got == {d: u for d, u in want.items() if u}
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString() and "Pandas" not in found._jdf.queryExecution().executedPlan().toString()


def test_speakers_of_a_query(spark):
    c = talk(spark)
    c.tokens["word"] = c.tokens["word"].unionByName(c.tokens["word"].limit(1).withColumns({"id": F.lit("nobody"), "speaker": F.lit(None).cast("string")}))
    n = lambda q: q.count()
    assert (n(c.query(c.word).of_speakers("bo")), n(c.query(c.word).without_speakers("bo")), n(c.query(c.word).of_speakers("bo", "ana")), n(c.query(c.word).of_speakers())) == (4, 10, 13, 0)
    q = c.query(c.word).without_speakers("ana").filter(c.word.label == "um")
    assert n(type(q).from_plan(c, q.plan_json())) == n(q) == 2


def test_lists_and_resets_of_a_corpus(spark, tmp_path):
    c = talk(spark)
    assert {r.label for r in c.words.collect()} == {"mela", "tok", "um", "strel", "o", "kanto", "lem"} and c.phones.count() == 11 and c.genders().count() == 0
    given = spark.createDataFrame([("ana", "f", 3), ("bo", None, 4)], "name string, gender string, age int")
    c.enrich_speakers(given)
    assert [r.gender for r in c.genders().collect()] == ["f"]
    assert c.reset_properties_of(given, entity="speaker") == ["gender", "age"] and c.speakers.columns == ["name"] and not c.schema.has("speaker", None, "age")
    types = spark.createDataFrame([("tok", 5)], "label string, freq int")
    c.enrich_types("word", types)
    assert c.query(c.word).filter(c.word.freq == 5).count() == 3
    c.reset_properties_of(types, level="word")
    assert not c.schema.has("type", "word", "freq")
    with pytest.raises(QueryError):
        c.reset_properties_of(types)
    assert not Corpus.exists(spark, str(tmp_path), "talk")
    c.save(str(tmp_path), 1)
    assert Corpus.exists(spark, str(tmp_path), "talk")


def test_tokens_below_are_not_sent_to_the_driver(spark):
    """Their numbers are a row for each token of the level above, though Spark may guess them to be few."""
    c = talk(spark)
    found = c.query(c.word).columns(c.word.label.column_name("word"), c.word.phone.count.column_name("phones")).frame()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan, plan
    assert found.where("phones > 0").count() > 0
