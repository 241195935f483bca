"""Personal data and revealing words against a plain version of both."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
import regex

from tenderloom.llm import disclosure, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def plain_base(text):
    found = {}
    for kind, pattern in PATTERNS.items():
        spans = []
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(part) <= 255 for part in match[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                spans.append((match.start(), match.end(), match[0]))
        found[kind] = spans
    return found


def plain_words(text):
    return {w for w in regex.findall(r"[\p{L}\p{M}\p{N}]+", text.lower()) if len(w) >= 3}


def plain_spans(texts, threshold=0.9, least=2, prefix=3):
    """For each text its base and all spans, as strings."""
    base = [plain_base(t) for t in texts]
    held = [
        {f"{k}:" + (v.lower() if k == "email" else v if k == "ip" else re.sub("[^0-9]", "", v)) for k in b for _, _, v in b[k]}
        for b in base
    ]
    general = lambda w: w[:prefix] + "…" if len(w) > prefix else None
    of_text = [(plain_words(t), {general(w) for w in plain_words(t)} - {None}) for t in texts]
    n, n_term, n_entity, both = len(texts), Counter(), Counter(), Counter()
    entity_texts, both_texts = defaultdict(set), defaultdict(set)
    for text, entities, (words, forms) in zip(texts, held, of_text):
        n_term.update(words | forms)
        n_entity.update(entities)
        for e in entities:
            entity_texts[e].add(text)
            for t in words | forms:
                both[e, t] += 1
                both_texts[e, t].add(text)
    reveals = set()
    for (e, t), count in both.items():
        if len(entity_texts[e]) >= least and len(both_texts[e, t]) >= least and n_entity[e] < n:
            if math.log2(count * n / (n_entity[e] * n_term[t])) / math.log2(n / n_entity[e]) >= threshold:
                reveals.add((e, t))
    found = []
    for text, b, entities in zip(texts, base, held):
        shown = [f"{k}:{s}:{e}" for k in PATTERNS for s, e, _ in b[k]]
        masked = list(text)
        for k in b:
            for s, e, _ in b[k]:
                masked[s:e] = " " * (e - s)
        extra, instead = [], Counter()
        for match in regex.finditer(r"[\p{L}\p{M}\p{N}]+", "".join(masked)):
            word = match[0].lower()
            by = [e for e in entities if (e, word) in reveals]
            if by:
                extra.append(f"term:{match.start()}:{match.end()}")
                removed = len(word) <= prefix or any((e, general(word)) in reveals for e in by)
                instead["n_removed" if removed else "n_generalised"] += 1
        found.append((shown, ",".join(shown + extra), instead["n_generalised"], instead["n_removed"]))
    return found


def check(spark, texts, **options):
    rows = [(k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "id long, text string").selectExpr("*", "'x' AS spans", "1 AS digest", "2 AS body", "3 AS term")
    found = {r["id"]: r for r in disclosure.sanitise(docs, **options).collect()}
    expected = plain_spans([t or "" for t in texts], **{k.replace("_texts", ""): v for k, v in options.items()})
    for k, (base, spans, generalised, removed) in enumerate(expected):
        got = found[k]
        assert got["base_spans"] == ",".join(base), texts[k]
        assert got["spans"] == spans, texts[k]
        assert (got["n_generalised"], got["n_removed"]) == (generalised, removed)
        assert got["digest"] == 1 and got["body"] == 2 and got["term"] == 3
    return found


CASES = [
    "a@b.c_d@e.f x@y. q@w.e.r, a@b@c.d %+-.@x.y--z é@é.é user.name+tag@mail.example.com.",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 001.02.3.0255 999.1.2.3.4 ..1.2.3.4.. 0000000000000255.1.1.1 1.2.3.4567",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4381893557741609 41111111111111110000 6304 0000 0000 0000 00 4111  1111 1111 1111",
    "+1 (743) 555-3824 +12 +1-2-3-4-5-6-7-8 +1234567890123456 ++34 600 10 20 30) +3 ( +1.2.3.4 +4111 1111 1111 1111",
    "😀 日本 +34 600 10 20 30 ёж a@b.cd \U0001f600 10.0.0.1 é 4111111111111111 end",
    "x@a.12 34 5678 9012 3456 78 +1 10.20.30.40 4111111111111111@x.y +1@2.3.4.5.6.7.8",
    "", None, "plain words only", "\x01\x02 a@b.cc \x03\x04",
]


def test_base_spans(spark):
    found = check(spark, CASES)
    assert found[9]["clean_text"] == "   [email]   " and found[7]["clean_text"] == ""
    assert found[4]["clean_text"].startswith("😀 日本 [phone] ёж [email] \U0001f600 [ip] é [card]")


def test_random_text_of_fitting_characters(spark):
    draw = random.Random(11)
    marks = ["1", "2", "25", "0", "4111", "1111", ".", "-", " ", "+", "@", "a", "b.c", "(", ")", "_", "%", "é", "\n", "😀"]
    check(spark, ["".join(draw.choices(marks, k=draw.randint(1, 60))) for _ in range(400)], least_texts=2)


def test_revealing_words(spark):
    draw = random.Random(2)
    common = [f"common{k}" for k in range(40)]
    texts = [" ".join(draw.choices(common, k=30)) for _ in range(150)]
    for k in range(4):
        texts.append(f"{' '.join(draw.choices(common, k=8))} Zebrawood keeper of night Qixel, mail Ann@x.example or +34 600 10 20 30. end{k}")
    texts += [texts[-1]] * 5 + [f"zebra crossing {k} with zebras" for k in range(6)]
    texts += [f"once b{k}@y.example with rare{k}" for k in range(10)] + ["twice same@z.example lonely unseen"] * 7
    found = check(spark, texts)
    shown = found[150]["clean_text"]
    assert "[email]" in shown and "[phone]" in shown and "Qixel" not in shown and "Zebrawood" not in shown
    assert "zeb…" in shown and found[150]["n_generalised"] >= 1 and found[150]["n_removed"] >= 1
    # Single texts and copies of one text are no evidence; texts without personal data stay as they are.
    assert all(found[k]["spans"].count("term") == 0 for k in range(166, len(texts)))
    assert all(found[k]["clean_text"] == texts[k] for k in range(150))


def test_long_text_and_empty_table(spark):
    long = " ".join(f"user{k}@host{k % 7}.example or 10.0.{k % 256}.{k % 99}" for k in range(300))
    check(spark, [long, long + " more", "x"])
    # Runs that the plain patterns, but not these, would go over again from each of their characters.
    runs = spark.createDataFrame([(1, "a" * 300_000 + "1" * 300_000 + " 1" * 100_000 + "+1" + " " * 300_000 + " a@b.cc")], "id long, text string")
    assert disclosure.sanitise(runs).first()["base_spans"] == "email:1100003:1100009"
    empty = spark.createDataFrame([], "id long, text string")
    assert disclosure.sanitise(empty).collect() == []


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a@b.cc"), (None, "a@b.cc"), (1, "a@b.cc"), (1, "no"), (1, None)], "doc_id long, text string")
    found = sorted((r["doc_id"] or 0, r["text"] or "", r["n_email"]) for r in disclosure.sanitise(docs).collect())
    assert found == [(0, "a@b.cc", 1), (0, "a@b.cc", 1), (1, "", 0), (1, "a@b.cc", 1), (1, "no", 0)]


def test_query_equals_plain_version(spark, sample):
    rows = spark.read.parquet(f"{sample}/documents.parquet").orderBy("doc_id").collect()
    expected = plain_spans([r["text"] or "" for r in rows])
    found = {r["doc_id"]: r for r in queries.op13_disclosure(spark, sample).collect()}
    assert len(found) == len(rows)
    for row, (base, spans, _, _) in zip(rows, expected):
        got = found[row["doc_id"]]
        by_kind = Counter(s.split(":")[0] for s in base)
        assert got["spans"] == spans and all(got[f"n_{k}"] == by_kind[k] for k in PATTERNS)
        assert got["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()


def test_plan_runs_no_python(spark, sample):
    plan = queries.op13_disclosure(spark, sample)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("digits, good", [("4111111111111111", True), ("4111111111111112", False), ("0" * 19, True)])
def test_luhn(spark, digits, good):
    from pyspark.sql import functions as F

    assert spark.range(1).select(disclosure._luhn(F.lit(digits))).first()[0] is good
