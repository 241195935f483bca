"""Near duplicates and test items against comparisons of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tenderloom.llm import components as stars
from tenderloom.llm import decontaminate, jaccard
from tenderloom.llm.components import components


def shingles(text):
    words = (text or "").lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def plain_classes(rows):
    """{id: (class, links)} by comparing all documents; ids are unique."""
    sets = {i: shingles(t) for i, t in rows}
    links = {i: [] for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a != b and both and both >= 0.8 * (len(sets[a] | sets[b])):
                links[a].append(b)
    found = {}
    for i in sorted(sets):
        if i in found:
            continue
        work = [i]
        while work:
            k = work.pop()
            if k not in found:
                found[k] = (i, len(links[k]))
                work += links[k]
    return found


@pytest.fixture(scope="module")
def copies():
    """A large group of near copies, exact copies, short texts, and texts with nothing in common."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    texts = []
    for _ in range(130):
        text = list(base)
        for _ in range(draw.randrange(4)):
            text[draw.randrange(len(text))] = word()
        texts.append(" ".join(text))
    texts += [texts[0], texts[0].upper(), texts[0].replace(" ", "\n\t")] * 5
    texts += [" ".join(word() for _ in range(40)) for _ in range(40)]
    texts += ["one two", "One  two", "three", "a b c d e", "a b c d e", "a b c d f"]
    draw.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block_nodes", [512, 16])
def test_classes_and_links_equal_all_pairs(spark, copies, block_nodes):
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    found = jaccard.near_duplicates(docs, block_nodes=block_nodes).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found} == plain_classes(copies)


def test_odd_rows_of_near_duplicates(odd_docs, no_docs):
    rows = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"]) for r in jaccard.near_duplicates(odd_docs).collect())
    assert rows == [
        (0, 0, 0), (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 2), (4, 4, 2), (5, 4, 2), (6, 6, 1), (7, 6, 1),
        (8, 8, 0), (9, 9, 0),
    ]
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 6, 8, 9]
    assert jaccard.near_duplicates(no_docs).collect() == [] and jaccard.keep_one(no_docs).collect() == []


def test_unlike_texts_under_one_id_lose_no_link_and_no_row(spark):
    draw = random.Random(8)
    text = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    a, b, c = text(120), text(120), text(30)
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (4, c), (1, c + " q"), (5, a), (1, a), (6, ""), (6, " "), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(docs).collect())
    # All rows compared with all others, rows being documents.
    of_row = plain_classes(list(enumerate(t for _, t in rows)))
    ids = {}
    for k, (name, _) in of_row.items():
        ids[name] = min(ids.get(name, 99), rows[k][0])
    assert found == sorted((rows[k][0], ids[name], n) for k, (name, n) in of_row.items())
    kept = jaccard.keep_one(docs).collect()
    assert len(kept) == 5 and {r["doc_id"] for r in kept} == {1, 6}
    assert {r["text"] for r in kept if r["doc_id"] == 1} == {a, b, c + " q"}


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9995), (0.5, 0.9), (0.9, 0.99)):
        bands, rows = jaccard.choose_bands(threshold, recall)
        assert bands * rows <= 128 and 1 - (1 - threshold**rows) ** bands >= recall


def test_shared_counts_in_narrow_slices():
    draw = np.random.RandomState(0)
    sets = [np.unique(draw.randint(0, 300, 80)).astype(np.uint64) for _ in range(12)]
    plain = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    apart = ~np.eye(12, dtype=bool)  # a set is not compared with itself
    assert (jaccard.shared_counts(sets, None, width=7) == plain)[apart].all()
    assert (jaccard.shared_counts(sets[:5], sets[5:], width=7) == plain[:5, 5:]).all()


def test_components_of_a_path_a_star_and_a_pair(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 50)] + [(300, 299), (7, 7)]
    random.Random(1).shuffle(edges)
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {k: 0 for k in range(1, 41)} | {100 + k: 100 for k in range(1, 50)} | {300: 299}
    assert {r["node"]: r["root"] for r in found} == roots and len(found) == len(roots)


ITEMS = [
    (1, "Which river flows past the old mill and under seven stone bridges before it meets the northern sea"),
    (2, "Name the chemist who found that grey tin crumbles in the cold and wrote four letters about it to the crown"),
    (3, "short item"),
    (4, None),
    (5, "..."),
]


@pytest.fixture
def many_partitions(spark):
    """Shuffles into many partitions that Spark does not put together."""
    own = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def kept_frames(monkeypatch, module):
    """What a module writes from now on."""
    frames, write = [], module.written
    monkeypatch.setattr(module, "written", lambda *args: frames.append(write(*args)) or frames[-1])
    return frames


def test_components_of_few_edges_cost_few_files_and_no_round_more(spark, many_partitions, monkeypatch):
    frames = kept_frames(monkeypatch, stars)
    done = spark.range(1, 200).selectExpr("id AS a", "id % 7 - 7 AS b")
    assert {(r["node"], r["root"]) for r in components(done, 199).collect()} == {(k, k % 7 - 7) for k in range(1, 200)}
    assert len(frames) == 2  # edges that are stars already are written and looked at, no more
    path = spark.range(1, 20).selectExpr("id AS a", "id - 1 AS b")
    assert {(r["node"], r["root"]) for r in components(path, 19).collect()} == {(k, 0) for k in range(1, 20)}
    assert max(len(f.inputFiles()) for f in frames) <= spark.sparkContext.defaultParallelism


def test_near_duplicates_of_few_rows_write_few_files(spark, copies, many_partitions, monkeypatch):
    frames = kept_frames(monkeypatch, jaccard)
    frame = spark.createDataFrame(copies, "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: r["class_id"] for r in jaccard.near_duplicates(frame).collect()}
    assert found == {key: value[0] for key, value in plain_classes(copies).items()}
    many = [len(f.inputFiles()) for f in frames if "n_doc_links" not in f.columns]
    assert max(many) <= spark.sparkContext.defaultParallelism


def plain_alignment(item, text):
    above, best = [0] * (len(text) + 1), 0
    for word in item:
        row = [0]
        for k, other in enumerate(text):
            row.append(max(0, above[k] + (2 if word == other else -1), above[k + 1] - 1, row[k] - 1))
        best, above = max(best, *row), row
    return best


def test_alignment_equals_a_plain_one():
    draw = np.random.RandomState(4)
    for _ in range(40):
        item, text = draw.randint(0, 6, draw.randint(1, 12)), draw.randint(-1, 6, (1, draw.randint(1, 40)))
        assert decontaminate.align(item, text)[0][0] == plain_alignment(item.tolist(), text[0].tolist())


def test_leaks_equal_alignment_of_all_pairs(spark, odd_docs, no_docs):
    draw = random.Random(8)
    filler = lambda n: " ".join(draw.choice("the of a sea stone letters cold mill other words here".split()) for _ in range(n))
    words = ITEMS[0][1].split()
    edited = [w if k % 7 else "changed" for k, w in enumerate(words)]
    rows = [
        (10, f"{filler(50)} {ITEMS[0][1].upper()}! {filler(30)}"),
        (11, f"{filler(50)} {' '.join(edited)} {filler(3)}"),
        (12, f"{' '.join(words[:9])} and {' '.join(words[9:])} {ITEMS[1][1]}"),
        (13, f"{filler(200)} {' '.join(words[3:8])} {filler(20)}"),
        (14, "a short item is here"),
        (15, filler(300)),
        (None, ITEMS[1][1]),
    ]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    known = set()
    listed = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 5000]
    for item, item_text in ITEMS:
        vocabulary = decontaminate.Vocabulary([item_text or ""])
        for doc, text in listed:
            numbers = vocabulary.numbers(pa.array([text], pa.string()))[0].tolist()
            size = len(vocabulary.words)
            if size and plain_alignment(vocabulary.words.tolist(), numbers) >= size:
                known.add((doc, item))
    found = decontaminate.find_leaks(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == known
    assert known == {(10, 1), (11, 1), (12, 1), (12, 2), (14, 3), (None, 2)}
    again = decontaminate.find_leaks(docs, items, block_chars=10).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    kept = decontaminate.drop_leaks(docs, items, block_chars=100)
    assert kept.count() == docs.count() - 5 and kept.schema == docs.schema
    assert decontaminate.find_leaks(no_docs, items).collect() == []
    assert decontaminate.find_leaks(docs, items.limit(0)).collect() == []
    assert decontaminate.drop_leaks(docs, items.limit(0)).count() == docs.count()


def test_copies_of_a_leak_do_not_hide_it(spark):
    items = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    docs = spark.createDataFrame([(k, ITEMS[0][1]) for k in range(500)], "doc_id long, text string")
    assert decontaminate.find_leaks(docs, items).where("item_id = 1 AND score = 1").count() == 500
