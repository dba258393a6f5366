import random
import re

from tesserae.llm import licenses
from tests.llm.helpers import TEXTS, clashing, documents, rows

MORE = [
    (20, "This work is under the MIT License. Under  the mit-license!", "en", "a"),
    (21, "Licensed under CC BY-NC 4.0.", "en", "a"),
    (22, "This work is licensed under the GNU General Public License, version 3.", "en", "a"),
    (23, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "en", "a"),
    (24, "under the mit lİcense under the mit K license apache license version 22", "en", "a"),
    (25, "Apache License, Version 2", "en", "a"),
]
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(text):
    words = WORD.findall((text or "").translate(LOWER))
    at, labels = [], set()
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += own
        if own:
            labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_by_hand(spark):
    data = TEXTS + MORE
    got = rows(licenses.scan(clashing(documents(spark, data))))
    assert [r[:6] for r in got] == sorted(((i, *by_hand(t)) for i, t, _, _ in data), key=repr)


def test_labels_and_scores(spark):
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, TEXTS + MORE)).collect()}
    assert got[22]["labels"] == "gpl-3" and got[22]["base_labels"] == ""
    assert got[23]["labels"] == "mit" and got[23]["score"] == 1.0
    assert got[21]["labels"] == "cc-by-nc" and got[20]["n_base"] == 2
    assert got[4]["score"] == 0 and got[24]["n_base"] == 0


def stands(words, t):
    """Starts at which every key phrase of a template stands, by comparing at every place."""
    keys = t.mandatory()
    return [i for i in range(-len(t.words), len(words) + 1) if all(0 <= i + o < len(words) and words[i + o] == w for o, w in keys)]


def test_every_template_by_hand(spark):
    """All templates against a plain search at every place, over texts put together from whole and
    cut templates, on corpora with different frequencies."""
    rng = random.Random(8)
    every = [*licenses.BASE, *licenses.MORE]
    assert len(every) > 150 and len({t.name for t in every}) == len(every)
    for some in (every, every[:20]):
        data = []
        for i in range(120):
            words = []
            for _ in range(rng.randint(0, 5)):
                t = rng.choice(some)
                a = rng.choice([0, 0, rng.randrange(len(t.words))])
                words += list(t.words[a : a + rng.choice([len(t.words), 6, 9])])
                words += rng.choices(["the", "license", "under", "other", "é"], k=rng.randint(0, 3))
            data.append((i, "-".join(words).upper() if i % 3 else "; ".join(words), "en", "a"))
        data += [(1000, "license " * 3000 + "under the mit license " * 500, "en", "a"), (1001, None, "en", "a")]
        got = {r["doc_id"]: r for r in licenses.scan(documents(spark, data)).collect()}
        for i, text, _, _ in data:
            words = WORD.findall((text or "").translate(LOWER))
            at = {t: stands(words, t) for t in every}
            covers = [sum(0 <= s + j < len(words) and words[s + j] == w for j, w in enumerate(t.words)) / len(t.words) for t, ss in at.items() for s in ss]
            base = [s for t in licenses.BASE for s in at[t]]
            assert got[i]["labels"] == ",".join(sorted({t.label for t in every if at[t]}))
            assert (got[i]["n_base"], got[i]["first_word"], got[i]["last_word"]) == (len(base), min(base, default=None), max(base, default=None))
            assert got[i]["score"] == round(max(covers, default=0), 6)


def test_empty(spark):
    assert rows(licenses.scan(documents(spark, []))) == []
