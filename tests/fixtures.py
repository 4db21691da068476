"""A small timed corpus of invented words, and the same as plain Python rows to count by hand or by loops."""

from tierlake.corpus import Corpus

#: discourse, speaker, line, word, begin, phones. A phone lasts a tenth of a second, and 0.02 longer with each place in its word.
TALK = [
    ("walk", "ana", "first", "mela", 0.0, ["m", "e", "l", "a"]),
    ("walk", "ana", "first", "tok", 0.6, ["t", "o", "k"]),
    ("walk", "ana", "first", "um", 1.0, ["u", "m"]),
    ("walk", "ana", "first", "strel", 1.4, ["s", "t", "r", "e", "l"]),
    ("walk", "ana", "second", "mela", 4.0, ["m", "e", "l", "a"]),
    ("walk", "ana", "second", "o", 4.8, ["o"]),
    ("walk", "ana", "second", "kanto", 5.0, ["k", "a", "n", "t", "o"]),
    ("walk", "bo", "third", "tok", 2.5, ["t", "o", "k"]),
    ("walk", "bo", "third", "um", 2.9, ["u", "m"]),
    ("walk", "bo", "third", "um", 3.2, ["u", "m"]),
    ("walk", "bo", "third", "lem", 3.5, ["l", "e", "m"]),
    ("rest", "ana", "fourth", "strel", 0.5, ["s", "t", "r", "e", "l"]),
    ("rest", "ana", "fourth", "tok", 1.2, ["t", "o", "k"]),
]
NUCLEI = ["a", "e", "o", "u"]
COLUMNS = ("id", "label", "begin", "end", "discourse", "speaker")


def levels():
    """phone, word and line rows as dicts, linked by ids."""
    phones, words, lines = [], [], {}
    for k, (discourse, speaker, line, label, begin, parts) in enumerate(TALK):
        at, own = begin, {"discourse": discourse, "speaker": speaker, "word_id": f"w{k}", "line_id": line}
        for i, p in enumerate(parts):
            end = round(at + 0.1 + 0.02 * i, 2)
            phones.append({"id": f"p{k}.{i}", "label": p, "begin": at, "end": end, **own})
            at = end
        words.append({"id": f"w{k}", "label": label, "begin": begin, "end": at, "discourse": discourse, "speaker": speaker, "line_id": line})
        row = lines.setdefault(line, {"id": line, "label": line, "begin": begin, "end": at, "discourse": discourse, "speaker": speaker})
        row["end"] = at
    return {"phone": phones, "word": words, "line": list(lines.values())}


def talk(spark):
    frames = {name: spark.createDataFrame(rows, ", ".join(f"{c} {'double' if c in ('begin', 'end') else 'string'}" for c in rows[0])) for name, rows in levels().items()}
    return Corpus.from_tiers(spark, "talk", {n: t.drop("word_id", "line_id") for n, t in frames.items()}, ["phone", "word", "line"])
