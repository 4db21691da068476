"""Pages by keys and queries as JSON."""

import json
import random

import pytest

from fixtures import NUCLEI, talk
from tierlake.corpus import Corpus
from tierlake.errors import AttributeMissing, QueryError
from tierlake.plans.dsl import Average, Count, Median, Query, and_, or_
from tierlake.schema import Schema


def many(spark):
    chance = random.Random(4)
    rows = [(f"i{i}", chance.choice(["a", "b", None]), float(i), i + 1.0, "d", "s", chance.choice([1, 2, None]), chance.choice([0.1, 2.5, None])) for i in range(53)]
    chance.shuffle(rows)
    table = spark.createDataFrame(rows, "id string, label string, begin double, end double, discourse string, speaker string, n int, x double")
    return Corpus(spark, "m", Schema({"word": None}), {"word": table}), rows


@pytest.mark.parametrize("order", [(), (("label", False),), (("label", True), ("n", False)), (("n", True), ("x", True), ("label", False))])
def test_pages_forward_and_back(spark, order):
    c, rows = many(spark)
    q = c.query(c.word).columns(c.word.id)
    for name, down in order:
        q.order_by(getattr(c.word, name), down)
    at = {n: k for k, n in enumerate(("id", "label", "begin", "end", "discourse", "speaker", "n", "x"))}
    want = sorted(rows, key=lambda r: r[0])
    for name, down in reversed(order):
        # nulls first when rising, last when falling
        want.sort(key=lambda r: (r[at[name]] is not None, r[at[name]] if r[at[name]] is not None else 0), reverse=down)
    want = [r[0] for r in want]
    page, seen = q.cursor(10), []
    assert not page.has_previous
    while True:
        seen.append([r[0] for r in page.rows])
        if not page.has_next:
            break
        page = page.next()
    assert sum(seen, []) == want and [len(s) for s in seen] == [10, 10, 10, 10, 10, 3]
    page = q.cursor(10, back=True)
    back = [[r[0] for r in page.rows]]
    while page.has_previous:
        page = page.previous()
        back.insert(0, [r[0] for r in page.rows])
    assert sum(back, []) == want
    # a page is found again by its token alone, and both ways meet
    second = q.cursor(10, q.cursor(10).last)
    assert [r[0] for r in second.rows] == want[10:20] and [r[0] for r in second.previous().rows] == want[:10]
    assert q.cursor(10, q.cursor(10, back=True).last).rows == []


def test_pages_stay_when_rows_come_and_go(spark):
    c, rows = many(spark)
    q = c.query(c.word).columns(c.word.id).order_by(c.word.begin)
    token = q.cursor(10).last
    c.tokens["word"] = c.tokens["word"].where("begin <> 3")
    again = c.query(c.word).columns(c.word.id).order_by(c.word.begin)
    assert [r[0] for r in again.cursor(5, token).rows] == [f"i{i}" for i in range(10, 15)]
    with pytest.raises(QueryError):
        again.limit(5).cursor()
    plan = json.loads(token)
    assert plan == {"_o0": 9.0, "_id": "i9"}


def queries(c):
    p, w = c.phone, c.word
    yield c.query(p).filter(p.label == "e", p.word.label.regex("[a-m].*")).columns(p.id, p.following.label, p.word.line.begin)
    yield c.query(w).filter(or_(and_(w.begin > 1, w.phone.label == "k"), w.label.in_({"tok", "um"}))).columns(w.id, w.phone.label, w.phone.count.column_name("n"), w.phone.initial.label).order_by(w.begin, True).limit(4)
    yield c.query(w).filter(w.label.not_in_(c.query(w).filter(w.begin < 1).columns(w.label)), w.precedes("w5"))
    yield c.query(w).columns(w.speaker.name.column_name("s"), Average(w.phone.duration).column_name("n"))
    yield c.query(p).filter(p.begin == p.word.begin).filter_not_right_aligned(c.line)
    yield c.query_speakers().columns(c.speaker.name, c.speaker.discourses)
    yield c.query(c.lexicon_word).filter(c.lexicon_word.label != "tok")
    yield c.query(p.filter_by_subset("nuclei")).columns(p.id, p.word.duration)
    yield c.query(w).columns(w.phone.filter_by_subset("nuclei").position)
    yield c.query(w).group_by(w.label).filter(Count() >= 2)


def test_queries_as_json(spark):
    c = talk(spark)
    c.encode_class(NUCLEI, "nuclei")
    prints = set()
    for q in [*queries(c)][:8]:
        text = q.plan_json()
        twin = Query.from_plan(c, text)
        assert twin.plan_json() == text and twin.fingerprint() == q.fingerprint()
        assert sorted(map(str, twin.frame().collect())) == sorted(map(str, q.frame().collect()))
        prints.add(q.fingerprint())
    assert len(prints) == 8
    grouped = [*queries(c)][9]
    twin = Query.from_plan(c, grouped.plan_json())
    both = [sorted(map(str, x.aggregate(Average(c.word.duration), Median(c.word.begin)).collect())) for x in (grouped, twin)]
    assert both[0] == both[1] and len(both[0]) == 4
    # the same query written again, and another one
    a, b = (c.query(c.word).filter(c.word.label == "tok") for _ in range(2))
    assert a.fingerprint() == b.fingerprint() != b.limit(1).fingerprint()
    other = Corpus(spark, "o", Schema({"word": None}), {"word": c.tokens["word"].drop("line_id")})
    assert Query.from_plan(other, a.plan_json()).count() == 3
    with pytest.raises(AttributeMissing):
        Query.from_plan(other, c.query(c.word).filter(c.word.line.begin > 1).plan_json())
    with pytest.raises(QueryError):
        c.query(c.word).filter(c.word.label == object()).plan_json()
