import re

from helpers import SCHEMA, collected, corpus, frame, low_words

from weekrank.llm import licenses

TEXTS = ["Licensed under CC BY-NC 4.0.", "cc by cc by CC, BY! xcc by", "GNU General Public License v2 or later", "The GNU General Public License version 3, or (at your option) any later version.",
         "Copyright 2020 Me. All rights reserved. all RIGHTS reserved", "Apache License, Version 2.0", "apache", "mit license " * 300, "cc", "by cc", "é cc by é general public license all rights reserved"]


def brute(row, own):
    words = low_words(row[1])
    text = " " + " ".join(words) + " " if words else " "
    starts, labels = [], set()
    for phrase, label in licenses.BASE:
        parts = phrase.split()
        found = [i for i in range(len(words)) if words[i:i + len(parts)] == parts]
        starts += found
        if found:
            labels.add(label)
    found = sorted((m.start(), -m.end(), i, label) for i, label, _, regex in own for m in re.finditer(regex, text))
    kept = []
    for first, back, priority, label in found:
        if not kept or first >= kept[-1][0]:
            kept.append((-back, priority, label))
        elif -back > kept[-1][0] and priority < kept[-1][1]:
            kept[-1] = (-back, priority, label)
    both = labels | {k[2] for k in kept}
    return row[0], len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels), sorted(both), 1 - 0.5 ** len(kept)


def test_against_brute_force(spark):
    rows = corpus(5, n=40) + [(900 + i, t, None, None, None) for i, t in enumerate(TEXTS)]
    own = licenses.rules()
    assert len(own) > 200
    assert collected(licenses.scan(frame(spark, rows))) == sorted((brute(r, own) for r in rows), key=repr)


def test_specific_rules_win(spark):
    got = {r.doc_id: r.labels for r in licenses.scan(frame(spark, [(i, t, None, None, None) for i, t in enumerate(TEXTS)])).collect()}
    assert "gpl-2-or-later" not in got[2] and "gpl" in got[2] and "gpl-3-or-later" in got[3] and got[5] == ["apache-2.0"] and got[7] == ["mit"]
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def shortest(parsed):
    """The shortest text of a parsed regex; of equally short alternatives the first."""
    out = ""
    for kind, value in parsed:
        if str(kind) == "LITERAL":
            out += chr(value)
        elif str(kind) == "NOT_LITERAL":
            out += "q"
        elif str(kind) == "IN":
            out += chr(value[0][1] if str(value[0][0]) == "LITERAL" else value[0][1][0]) if str(value[0][0]) != "NEGATE" else "q"
        elif str(kind) == "BRANCH":
            out += min((shortest(v) for v in value[1]), key=len)
        elif str(kind) == "SUBPATTERN":
            out += shortest(value[3])
        elif str(kind) in ("MAX_REPEAT", "MIN_REPEAT"):
            out += shortest(value[2]) * value[0]
        else:
            assert str(kind) in ("ASSERT", "ASSERT_NOT"), kind
    return out


def test_the_shortest_match_of_every_rule_alone(spark):
    own = licenses.rules()
    texts = [shortest(re._parser.parse(regex)) for _, _, _, regex in own]
    assert "0bsd" in texts and "noncommercial use only" in texts
    assert all(re.search(regex, f" {text} ") for text, (_, _, _, regex) in zip(texts, own))
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    seen = {i for i, (t, rule) in enumerate(zip(texts, own)) if rule[2] in f" {t} "}
    found = {r.doc_id: r.score for r in licenses.scan(frame(spark, rows)).collect()}
    assert len(seen) == len(own) and all(found[i] > 0 for i in seen)
    lost = [(t, rule[1]) for i, (t, rule) in enumerate(zip(texts, own)) if not found[i]]
    assert not lost, lost
