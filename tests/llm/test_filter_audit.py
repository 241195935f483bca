"""Filter audit against filters applied one after the other to a plain list of documents."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np

from tenderloom.llm import filter_audit

WORDS = "alpha beta gamma delta Epsilon ZETA #tag 50% eta theta".split()


def plain_failures(rows):
    """The set of letters that each (id, text, part) fails."""
    found = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = set()
        if len(words) < 200:
            failed.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            failed.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            failed.add("C")
        if re.search("[#$%&*|]", text):
            failed.add("D")
        if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows):
            failed.add("E")
        found.append(failed)
    return found


def plain_audit(rows, labels):
    failures = plain_failures(rows)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    found = {}
    for part in {p or "" for _, _, p in rows}:
        docs = [(r[0], f) for r, f in zip(rows, failures) if (r[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            alive = docs
            for step, letter in enumerate(order, 1):
                lost = [d for d in alive if letter in d[1]]
                gone = sum(letter in d[1] for d in docs) - len(lost)
                alive = [d for d in alive if letter not in d[1]]
                total[letter] += len(lost)
                found[part, "".join(order), step] = [
                    len(alive), len(lost), gone, sum(d[1] == {letter} for d in docs),
                    sum(d[0] in good for d in lost), sum(d[0] in toxic for d in lost),
                ]
        for (p, order, step), row in found.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {key: tuple(row) for key, row in found.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS mask", "2 AS part", "'x' AS kept")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return filter_audit.audit_filters(docs, known)


def check(spark, rows, labels):
    found = {(r[0], r[1], r[2]): tuple(r[3:]) for r in audited(spark, rows, labels).collect()}
    assert found == plain_audit(rows, labels)
    assert len(found) == 600 * len({p or "" for _, _, p in rows})


def test_random_documents(spark):
    draw = random.Random(5)
    texts = [" ".join(draw.choices(WORDS[: draw.randint(3, 10)], k=draw.choice((0, 30, 200, 220)))) for _ in range(25)]
    texts += [" ".join(f"w{k}" for k in range(n)) for n in (199, 200, 399)]
    rows = [(i, draw.choice(texts), draw.choice(("en", "fr", None, ""))) for i in range(120)]
    labels = [(i, draw.choice((0, 1, None)), draw.choice((0, 1, None))) for i in range(0, 150, 2)]
    check(spark, rows, labels + labels[:5] + [(None, 1, 1), (4, 1, 0), (4, 0, 1)])


def test_nulls_ties_and_repeated_rows(spark):
    long = " ".join(f"word{k % 9000}" for k in range(40_000))
    rows = [
        (None, "same", "en"), (None, "same", "en"), (3, "same", "en"), (3, "same", "fr"), (3, "same", "en"), (7, "same", "en"),
        (1, None, None), (2, "", ""), (5, None, "en"), (4, long, "en"), (4, long, "en"), (6, long + " |", "en"),
        (8, "\n\t ", "en"), (9, "É" * 97 + "ABC", "en"), (10, "É" * 96 + "ABCD", "en"),
    ]
    check(spark, rows, [(3, 1, 1), (7, 0, 1), (4, 1, None), (None, 1, 1)])
    assert audited(spark, [], []).collect() == []
    check(spark, rows[:2], [])


def test_hot_text_is_counted_before_it_is_shuffled(spark):
    rows = [(i, "copied text" if i % 3 else f"text {i}", "en") for i in range(3000)]
    found = audited(spark, rows, []).where("filter_order = 'EABCD' AND step = 1").first()
    assert (found["removed"], found["kept"], found["unique_fails"]) == (1999, 1001, 0)


def test_walk_equals_counting_each_set():
    draw = np.random.default_rng(3)
    masks, counts = np.arange(32), draw.integers(0, 50, (32, 3))
    states = filter_audit.walk_subsets(masks, counts, 5)
    for chosen in range(32):
        assert (states[chosen] == counts[(masks & chosen) == 0].sum(axis=0)).all()
