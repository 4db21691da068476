"""Logs of edits: against a plain loop over the log, and their cases one by one."""

import random

import pytest
from pyspark.sql import functions as F

from fixtures import talk
from tierlake.errors import QueryError
from tierlake.operators.edits import applied
from tierlake.sources.store import CorpusStore

LOG = "id string, op string, at int, x int, y string, cleared array<string>"


def played(rows, log):
    """The rows of unique ids after the edits, one by one in order."""
    found = {i: {"x": x, "y": y, "z": z} for i, x, y, z in rows}
    last = {}
    for i, op, at, *_ in log:
        if op == "delete":
            last[i] = max(last.get(i, at), at)
    for i in last:
        found.pop(i, None)
    left = [e for e in log if e[1] != "delete" and (e[0] not in last or e[2] > last[e[0]])]
    for i in {e[0] for e in left if e[1] == "put"} - {*found}:
        found[i] = {"x": None, "y": None, "z": None}
    for i, _, _, x, y, cleared in sorted(left, key=lambda e: e[2]):
        if i in found:
            for name, value in (("x", x), ("y", y)):
                if value is not None or name in (cleared or []):
                    found[i][name] = value
    return sorted((i, r["x"], r["y"], r["z"]) for i, r in found.items())


@pytest.mark.parametrize("seed", range(4))
def test_edits_equal_a_loop_over_the_log(spark, seed):
    pick = random.Random(seed)
    rows = [(f"r{i}", i, f"y{i}", i * 2) for i in range(12)]
    log = [(f"r{pick.randrange(18)}", pick.choice(["set", "set", "put", "delete"]), at, pick.choice([None, at]), pick.choice([None, f"new{at}"]), pick.choice([None, ["x"], ["y", "x"]])) for at in range(60)]
    pick.shuffle(log)
    got = applied(spark.createDataFrame(rows, "id string, x int, y string, z int"), spark.createDataFrame(log, LOG)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == played(rows, log)


def test_cases_of_edits(spark):
    table = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "id string, x int")
    rows = lambda log, kind="id string, op string, x int": sorted(map(str, (tuple(r) for r in applied(table, spark.createDataFrame(log, kind)).collect())))
    assert rows([]) == sorted(map(str, [("a", 1), ("a", 2), (None, 3), ("b", 4)]))
    # no order: all of one time, so the greatest value counts and a delete comes last
    assert rows([("a", "set", 7), ("a", "set", 9), ("b", "put", 5), ("b", "delete", None)]) == sorted(map(str, [("a", 9), ("a", 9), (None, 3)]))
    assert rows([(None, "put", 7), ("new", "set", 1), ("b", "set", None)]) == rows([])
    # columns that only edits have; a put row twice is one row
    assert rows([("n", "put", "p"), ("n", "put", "q")], "id string, op string, word string") == sorted(map(str, [("a", 1, None), ("a", 2, None), (None, 3, None), ("b", 4, None), ("n", None, "q")]))
    with pytest.raises(Exception, match="no such edit"):
        rows([("a", "drop", 1)])
    with pytest.raises(QueryError, match="op"):
        applied(table, table)
    empty = applied(table.where("false"), spark.createDataFrame([("n", "put", 1), ("m", "set", 1)], "id string, op string, x int"))
    assert [tuple(r) for r in empty.collect()] == [("n", 1)]


def test_the_table_is_not_shuffled_by_a_small_log(spark, tmp_path):
    spark.range(1000).select(F.col("id"), F.lit(1).alias("x")).write.parquet(f"{tmp_path}/table")
    spark.createDataFrame([(3, "set", 5), (3, "set", 4)], "id long, op string, x int").write.parquet(f"{tmp_path}/log")
    out = applied(spark.read.parquet(f"{tmp_path}/table"), spark.read.parquet(f"{tmp_path}/log"))
    assert {r.id: r.x for r in out.collect()}[3] == 5 and out.count() == 1000
    plan = out._jdf.queryExecution().sparkPlan().toString()
    changed = plan[: plan.index("LeftAnti")]
    assert "BroadcastHashJoin" in changed and "SortMergeJoin" not in changed


def test_tokens_and_subannotations_of_a_corpus(spark):
    c = talk(spark)
    one, two = (r.id for r in c.tokens["word"].orderBy("begin").limit(2).collect())
    c.edit_tokens("word", spark.createDataFrame([(one, "set", 9.0, "seen"), (two, "delete", None, None)], "id string, op string, begin double, state string"))
    found = c.query(c.word).filter(c.word.state == "seen").frame().collect()
    assert len(found) == 1 and found[0].end == 9.0 and found[0].begin < 9.0  # exchanged
    assert c.tokens["word"].where(F.col("id") == two).isEmpty()
    marks = [("m1", "put", one, 2.0, 1.0), ("m2", "put", one, 3.0, 4.0), ("m3", "put", two, 1.0, 2.0)]
    c.edit_subannotations("word", "mark", spark.createDataFrame(marks, "id string, op string, annotated_id string, begin double, end double"))
    left = {r.id: (r.begin, r.end) for r in c.subannotations["word", "mark"].collect()}
    assert left == {"m1": (1.0, 2.0), "m2": (3.0, 4.0)}  # the token of m3 is gone
    c.edit_subannotations("word", "mark", spark.createDataFrame([("m1", "delete", None), ("m2", "set", 0.5)], "id string, op string, end double"))
    assert {r.id: (r.begin, r.end) for r in c.subannotations["word", "mark"].collect()} == {"m2": (0.5, 3.0)}
    assert c.query(c.word).columns(c.word.mark.begin.column_name("b")).filter(c.word.state == "seen").frame().collect()[0].b == [0.5]


def test_corrected_subannotations_stay(spark):
    c = talk(spark)
    (word,) = (r.id for r in c.tokens["word"].limit(1).collect())
    log = lambda *rows: spark.createDataFrame(rows, "id string, op string, annotated_id string, begin double, end double, edited boolean")
    c.edit_subannotations("word", "vot", log(("a", "put", word, 1.0, 2.0, True), ("b", "put", word, 1.0, 2.0, None)))
    c.edit_subannotations("word", "vot", log(("a", "put", word, 5.0, 6.0, None), ("b", "put", word, 5.0, 6.0, None)), overwrite_edited=False)
    assert {r.id: r.begin for r in c.subannotations["word", "vot"].collect()} == {"a": 1.0, "b": 5.0}
    c.edit_subannotations("word", "vot", log(("a", "put", word, 5.0, 6.0, None)))
    assert {r.id: r.begin for r in c.subannotations["word", "vot"].collect()} == {"a": 5.0, "b": 5.0}


def test_a_store_writes_only_rows_that_a_log_names(spark, tmp_path):
    c, store = talk(spark), CorpusStore(spark, str(tmp_path), "talk")
    store.save(c)
    ids = [r.id for r in c.tokens["word"].orderBy("begin").limit(3).collect()]
    log = spark.createDataFrame([(ids[0], "set", "new", None), (ids[1], "delete", None, None), ("more", "put", "added", 5)], "id string, op string, label string, rank int")
    assert store.merge("token_word", log) == 2
    latest = store.manifest()["tables"]["token_word"]
    assert spark.read.parquet(f"{store.root}/{latest['parts'][-1]}").count() == 2 and len(latest["parts"]) == 2
    again = store.open()
    assert sorted(map(str, store.table("token_word").select("id", "label", "rank").collect())) == sorted(map(str, applied(c.tokens["word"], log).select("id", "label", "rank").collect()))
    assert again.query(again.word).filter(again.word.rank == 5).count() == 1 and store.open(1).tokens["word"].count() == c.tokens["word"].count()
