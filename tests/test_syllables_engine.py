"""Syllables by joins against the functions of one word."""

import random
from collections import Counter

import pytest

from fixtures import talk
from tierlake.functions.syllables import UNSEEN_CODAS, UNSEEN_ONSETS, log_shares, split_at_longest_prefix, split_prefix_by_probability, syllabify
from tierlake.operators import syllables

NUCLEI = {"a", "e"}


def counted(words):
    onsets, codas = Counter(), Counter()
    for w in words:
        at = [i for i, p in enumerate(w) if p in NUCLEI]
        if at:
            onsets[tuple(w[: at[0]])] += 1
            codas[tuple(w[at[-1] + 1 :])] += 1
    return onsets, codas


def parts(word, tables, method):
    out = []
    for k, s in enumerate(syllabify(word, NUCLEI, *tables, method=method)):
        bare = (split_at_longest_prefix(word, tables[0]) if method == "maxonset" else split_prefix_by_probability(word, *tables)) if s.nucleus < 0 else None
        border = s.nucleus if s.nucleus >= 0 else s.stop if bare is None else s.first + bare
        out += [(i, k + 1, ".".join(word[s.first : s.stop]), s.first, s.stop, "nucleus" if i == s.nucleus else "onset" if i < border else "coda") for i in range(s.first, s.stop)]
    return out


@pytest.mark.parametrize("method,custom", [("maxonset", None), ("maxonset", [["t"], ["s", "t"]]), ("probabilistic", None)])
def test_joins_split_as_the_functions_do(spark, method, custom):
    chance = random.Random(3)
    words = [[chance.choice("aestrk") for _ in range(chance.randint(1, 9))] for _ in range(150)] + [list("strst"), list("k"), list("a"), list("ae"), list("tststt")]
    rows = [(f"{k}-{i}", p, float(i), i + 1.0, f"w{k}") for k, w in enumerate(words) for i, p in enumerate(w)] + [("lost", "a", 0.0, 1.0, None)]
    chance.shuffle(rows)
    phones = spark.createDataFrame(rows, "id string, label string, begin double, end double, word_id string")
    onsets, codas = counted(words)
    if method == "maxonset":
        tables = ({tuple(x) for x in custom} if custom is not None else {*onsets, ()}, None)
    else:
        tables = (log_shares(dict(onsets), UNSEEN_ONSETS), log_shares(dict(codas), UNSEEN_CODAS))
    found = syllables.encode_syllables(phones, sorted(NUCLEI), method, custom)
    got = {(r.phone_id, r.place, r.label, r.begin, r.end, r.part) for r in found.collect()}
    assert got == {(f"{k}-{i}", place, label, a, b, part) for k, w in enumerate(words) for i, place, label, a, b, part in parts(w, tables, method)}
    assert found.count() == len(got)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_rows_of_phones_are_not_sent_to_the_driver(spark):
    """Words and phones that come of a small table by explode look as small as it is."""
    c = talk(spark)
    c.encode_syllables(sorted(NUCLEI))
    for table in (c.tokens["phone"], c.tokens["syllable"]):
        plan = table._jdf.queryExecution().sparkPlan().toString()
        assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and ("phone_id" in x or "word_id" in x)] and "SortMergeJoin" in plan
