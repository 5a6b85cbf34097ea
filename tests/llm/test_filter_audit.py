import random
from itertools import permutations

import numpy as np
from helpers import SCHEMA, blank_words, collected, corpus, frame

from weekrank.llm import filter_audit, queries

LABELS = "doc_id long, quality int, toxic int"


def fails(row, rows):
    text = row[1] or ""
    words = blank_words(text)
    capitals = sum("A" <= c <= "Z" for c in text)
    out = ""
    out += "A" * (len(words) < 50)
    out += "B" * (100 * len(set(words)) < 65 * len(words))
    out += "C" * (100 * capitals > 5 * len(text))
    out += "D" * any(c in "#$%&*|" for c in text)
    out += "E" * any(r[0] is not None and row[0] is not None and r[0] < row[0] and (r[1] or "") == text for r in rows)
    return out


def brute(rows, labels):
    """Document by document and order by order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    judged = [(r[3] or "", fails(r, rows), r[0] in good, r[0] in toxic) for r in rows]
    out = []
    for part in sorted({j[0] for j in judged}):
        own = [j[1:] for j in judged if j[0] == part]
        removed_by = {c: 0 for c in "ABCDE"}
        lines = []
        for order in permutations("ABCDE"):
            left = list(own)
            for step, letter in enumerate(order, 1):
                gone = [j for j in left if letter in j[0]]
                left = [j for j in left if letter not in j[0]]
                all_failing = [j for j in own if letter in j[0]]
                removed_by[letter] += len(gone)
                lines.append((letter, part, "".join(order), step, len(left), len(gone), len(all_failing) - sum(letter in j[0] and not set(j[0]) & set(order[:step - 1]) for j in own),
                              sum(j[0] == letter for j in own), sum(j[1] for j in gone), sum(j[2] for j in gone)))
        out += [(*line[1:], removed_by[line[0]]) for line in lines]
    return sorted(out, key=repr)


def case(seed=6):
    rng = random.Random(seed)
    rows = [(r[0], r[1], r[2], rng.choice(["s1", "s2", None, ""]), r[4]) for r in corpus(seed, n=60)]
    rows += [(500 + i, rng.choice(["50 % off", "A B C", "same " * 60, "Word " * 70, None, ""]), None, "s1", None) for i in range(60)]
    rows += [(None, "same " * 60, None, "s2", None)] * 4 + [(501, "same " * 60, None, "s3", None)] * 2
    rows += [(7000, " ".join(f"w{i}" for i in range(60000)), None, "s2", None), (7001, "é" * 19 + "A", None, "s2", None), (7002, "é" * 20 + "A", None, "s2", None)]
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for r in rows if rng.random() < 0.5]
    return rows, labels + labels[:5] + [(None, 1, 1), (99999, 1, 1), (0, 1, 1)]


def test_against_every_order_done_by_hand(spark):
    rows, labels = case()
    got = filter_audit.audit(frame(spark, rows), spark.createDataFrame(labels, LABELS).repartition(3))
    assert collected(got) == brute(rows, labels)


def test_min_plus_steps():
    masks, places = np.arange(32), filter_audit.positions()
    assert places.shape == (120, 5) and sorted(places[0]) == [1, 2, 3, 4, 5]
    steps = filter_audit.removal_steps(masks, places)
    for o, order in enumerate(filter_audit.ORDERS):
        for mask in masks:
            assert steps[mask, o] == next((i for i, c in enumerate(order, 1) if mask >> "ABCDE".index(c) & 1), 6)


def test_empty_tables_and_the_query(spark, tmp_path):
    none, no_labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(none, no_labels).count() == 0
    rows, labels = case(7)
    assert collected(filter_audit.audit(frame(spark, rows[:30]), no_labels)) == brute(rows[:30], [])
    rows = [r for r in rows if r[0] is not None]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert collected(queries.op11_filter_audit(spark, str(tmp_path))) == brute(rows, labels)
