"""Every operator over Spark: whole small tables against brute force, and the edge cases its docstring defines."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import types as T

import corpus_pipeline
from screenlens.llm import (
    op1_decontaminate as op1,
    op2_quality as op2,
    op3_minhash as op3,
    op4_paragraphs as op4,
    op5_wordpiece as op5,
    op6_licenses as op6,
    op7_urls as op7,
    op8_bpe as op8,
    op9_shards as op9,
    op10_suffix as op10,
)
from screenlens.llm.common import Stage, components, importable_on_workers
from screenlens.llm.queries import QUERIES

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
LONG = " ".join(f"word{i * 7919 % 10007}" for i in range(30_000))
BASE = " ".join(f"w{i}" for i in range(200))
#: nulls, empty, very long, ties, repeated rows; ``text`` has company whose names clash with the operators' own
ROWS = [
    (1, BASE), (2, BASE), (2, BASE), (3, BASE + " tail of its own"), (4, None), (5, ""), (6, " \n\t "), (7, LONG),
    (8, "released under the mit license\n" + BASE), (9, "one two"), (9, "three four five six"), (None, BASE),
    (None, None), (10, "aé" * 500), (11, "a" * 1500), (12, BASE.replace("w150 ", "x150 ")), (13, LONG[:-3]),
]
CLASH = ["k", "s", "v", "rep", "posting", "n", "score", "kept", "a", "b", "component", "h", "row", "ids", "start"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       *[T.StructField(c, T.StringType()) for c in CLASH]])


@pytest.fixture(scope="module")
def docs(spark):
    importable_on_workers(spark)
    return spark.createDataFrame([(i, t, *["x"] * len(CLASH)) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark, sf):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def rows(df):
    return [r.asDict() for r in df.collect()]


def sort_rows(found):
    return sorted(found, key=repr)


# 1 ------------------------------------------------------------------------------------------------------------------

def test_op1_edges(spark, docs, none):
    bench = spark.createDataFrame([(1, "W10 w11, w12 w13 w14 w15 w16 w17 w18 w19!", "x"), (2, None, "x"), (3, "", "x"),
                                   (4, "two words", "x"), (5, "w10 w11 w12 w13 w14 w15 w16 w17 w18 w19", "x")],
                                  "item_id long, text string, k string")
    found = {(r["doc_id"], r["item_id"]) for r in rows(op1.decontaminate(docs, bench))}
    assert found == {(d, i) for d in (1, 2, 3, 8, 12, None) for i in (1, 5)}
    one_per_block = op1.decontaminate(docs, bench, block_chars=40)
    assert {(r["doc_id"], r["item_id"]) for r in rows(one_per_block)} == found
    assert op1.decontaminate(none, bench).count() == 0
    assert op1.decontaminate(docs, bench.limit(0)).count() == 0
    kept = op1.clean_documents(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in rows(kept)) == Counter([4, 5, 6, 7, 9, 9, 10, 11, 13])


def test_op1_matches_short_and_unspaced_items(spark):
    importable_on_workers(spark)
    items = [(1, "What is the capital of France?"), (2, "如果一个三角形的两条边相等，那么它叫做什么三角形？"), (3, "art"), (4, "?!"),
             (5, "เมืองหลวงของประเทศไทยคืออะไร")]
    texts = [(1, "Question: what is the capital of France? Paris."), (2, "练习：如果一个三角形的两条边相等，那么它叫做什么三角形？等腰"),
             (3, "an art of parts"), (4, "parts of a start ?!"), (5, "ตอบ" + items[4][1] + "ครับ")]
    found = op1.decontaminate(spark.createDataFrame(texts, "doc_id long, text string"),
                              spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["places"]) for r in rows(found)} == {(1, 1, 1), (2, 2, 1), (3, 3, 1), (5, 5, 1)}


def test_op1_finds_planted_items(spark, sf, small):
    items = {r["item_id"]: op1.normalise(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    found = {(r["doc_id"], r["item_id"]): r for r in rows(QUERIES["op1_decontaminate"](spark, sf))}
    exact = {(d, i) for d, t in small for i, item in items.items()
             if len(item.split()) >= op1.MIN_WORDS and item in op1.normalise(t)}
    assert exact <= set(found)
    for (d, i), r in found.items():
        assert 0 <= r["distance"] <= op1.budget(items[i])


# 2 ------------------------------------------------------------------------------------------------------------------

def test_op2_edges(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 1), (99, 0)], "doc_id long, quality int")
    found = rows(op2.quality_rules(docs, labels))
    assert len(found) == len(ROWS)
    by_id = defaultdict(list)
    for r in found:
        by_id[r["doc_id"]].append(r)
    assert by_id[4][0]["n_words"] == 0 and by_id[4][0]["base_failed"] and not by_id[4][0]["kept"]
    assert not by_id[1][0]["base_failed"] and by_id[7][0]["n_words"] == 30_000
    assert all(not r["kept"] for r in found if r["base_failed"])
    no_labels = rows(op2.quality_rules(docs, labels.limit(0)))
    assert all(r["kept"] == (not r["base_failed"]) and r["score"] is None for r in no_labels)
    assert op2.quality_rules(none, labels).count() == 0
    kept = op2.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in rows(kept)) == Counter(r["doc_id"] for r in found if r["kept"])


def test_op2_keeps_good_and_drops_bad(spark, sf):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = {r["doc_id"]: r for r in rows(QUERIES["op2_quality_rules"](spark, sf))}
    judged = [(labels[d], r["kept"]) for d, r in found.items() if d in labels and not r["base_failed"]]
    good = [k for q, k in judged if q == 1]
    assert np.mean(good) >= 0.97
    bad = [k for q, k in judged if q == 0]
    assert bad and np.mean(bad) <= 0.1


def test_op2_verdicts_by_brute_force(spark, sf, small):
    """Statistics, forest scores (mean of walked paths), threshold from all labelled rows and verdict, in plain Python."""
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    forest = op2.fitted(op2.rule_statistics(documents), labels)

    def walk(tree, row, node=0):
        column, value, left, right, length = (c[node] for c in tree)
        return length if column < 0 else walk(tree, row, left if row[column] < value else right)

    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    found = {r["doc_id"]: r for r in rows(QUERIES["op2_quality_rules"](spark, sf))}
    counts = np.zeros((2, op2.GRID + 1), np.int64)
    scores = {}
    for d, t in small:
        stats = op2.statistics(t or "")
        failed = stats[0] < 50 or 100 * stats[4] > 50 * stats[0]
        row = op2.excess(np.array(stats[5:]), forest.middle, forest.unit, forest.side)
        scores[d] = 2.0 ** (-np.mean([walk(x, row) for x in forest.trees]) / forest.scale)
        assert abs(scores[d] - found[d]["score"]) < 1e-9 and found[d]["base_failed"] == failed
        if not failed and quality.get(d) in (0, 1):
            counts[quality[d], int(scores[d] * op2.GRID)] += 1
    threshold = op2.threshold_of(counts[1], counts[0])
    assert threshold == forest.threshold < 1
    assert all(r["kept"] == (not r["base_failed"] and scores[d] < threshold) for d, r in found.items())
    assert any(not r["kept"] and not r["base_failed"] for r in found.values())


# 3 ------------------------------------------------------------------------------------------------------------------

def expected_components(pairs_of_rows, share=80, shingle=4):
    sets = [(d, op3.exact_set(t or "", shingle)) for d, t in pairs_of_rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    post = defaultdict(list)
    for n, (d, s) in enumerate(sets):
        for x in s if d is not None else ():
            post[x].append(n)
    seen = set()
    for members in post.values():
        for i, a in enumerate(members):
            for b in members[i + 1:]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    if op3.linked(sets[a][1], sets[b][1], share):
                        x, y = find(sets[a][0]), find(sets[b][0])
                        parent[max(x, y)] = min(x, y)
    return [(d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets]


def as_tuples(df):
    return sort_rows((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


def test_op3_edges(docs, none):
    assert as_tuples(op3.near_duplicates(docs)) == sort_rows(expected_components(ROWS))
    assert op3.near_duplicates(none).count() == 0
    kept = op3.deduplicated(docs)
    assert kept.columns == docs.columns
    assert {1, 4, 5, 6, 7, 9, 10, 11, None} <= {r["doc_id"] for r in kept.collect()}
    assert not {2, 3, 12, 13} & {r["doc_id"] for r in kept.collect()}


def test_op3_group_of_near_copies(spark):
    """A group whose members differ by several edits: links only between some, chains included."""
    rng = np.random.default_rng(4)
    base = [f"t{i}" for i in range(120)]
    made = []
    for d in range(300):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 8), replace=False):
            words[at] = f"e{d}-{at}"
        made.append((d, " ".join(words)))
    made += [(1000 + d, " ".join([*base[:60], *[f"u{d}-{i}" for i in range(40)]])) for d in range(200)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert as_tuples(op3.near_duplicates(df)) == sort_rows(expected_components(made))


def test_op3_group_without_links_makes_no_square_of_pairs(spark, monkeypatch):
    """Texts put together from two forms of each sentence share rare shingles with all the others and link with few."""
    rng = np.random.default_rng(8)
    forms = [[" ".join(f"s{n}f{f}w{i}" for i in range(10)) for f in range(2)] for n in range(15)]
    made = [(d, " ".join(forms[n][f] for n, f in enumerate(rng.integers(0, 2, 15)))) for d in range(300)]
    for d in range(0, 60, 3):                                   # some have a near copy: one sentence in its other form
        words = made[d][1].split()
        words[:10] = [f"x{d}-{i}" for i in range(10)]
        made.append((1000 + d, " ".join(words)))
    df = spark.createDataFrame(made, "doc_id long, text string")
    counts, confirm = [], op3._agreeing
    monkeypatch.setattr(op3, "_agreeing", lambda pairs, *a: (counts.append(pairs.count()), confirm(pairs, *a))[1])
    expected = expected_components(made)
    assert len({c for _, _, c, _ in expected}) > 250
    assert as_tuples(op3.near_duplicates(df)) == sort_rows(expected)
    assert sum(counts) < 10 * len(made)


def test_op3_blocks_give_the_links_that_components_need(spark):
    """Classes of many components in one block: links join each two linked components once, copies of a link are left out."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, 300).astype(np.uint64)) for _ in range(6)]
    full = [*sets, *[np.delete(s, [0, 1]) for s in sets], *[np.delete(s, [5]) for s in sets]]
    classes = [(n, n, np.zeros(4, np.uint32), s) for n, s in enumerate(full)]
    links = op3.spanning_links(classes, classes, 80, 4)
    same = {(n, m) for n in range(18) for m in range(18) if n != m and n % 6 == m % 6}
    assert len(links) == 12 and set(links) <= same
    assert op3.spanning_links([(n, 0, s, h) for n, _, s, h in classes], [(9, 0, *classes[9][2:])], 80, 4) == []


def test_components(spark):
    stage = Stage(spark, "test")
    chain = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 150), (300, 150), (150, 200)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long"), stage,
                                                          "c").collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 150: 150, 200: 150, 300: 150}
    assert components(spark.createDataFrame([], "a long, b long"), stage, "d").count() == 0


# 4 ------------------------------------------------------------------------------------------------------------------

def test_op4_edges(docs, none):
    found = rows(op4.repeated_paragraphs(docs))
    marked = {(r["doc_id"], r["paragraph"]): r["kept"] for r in found}
    assert {d for d, _ in marked} == {1, 2, 3, 7, 8, 12, 13, None}
    assert marked[1, 0] is True and marked[2, 0] is False and marked[8, 1] is False and marked[None, 0] is False
    assert len({r["component_id"] for r in found if r["doc_id"] in (1, 2, 3, 8, 12, None)}) == 1
    assert op4.repeated_paragraphs(none).count() == 0


def test_op4_finds_all_links(spark, sf, small):
    found = [r for r in rows(QUERIES["op4_paragraph_dedup"](spark, sf)) if r["unit"] == "paragraph"]
    units = [(d, n, op3.exact_set(t, op4.SHINGLE)) for d, text in small for n, _, t in op4.paragraphs(text)]
    post = defaultdict(list)
    for i, (_, _, s) in enumerate(units):
        for x in s:
            post[x].append(i)
    partner = set()
    for members in post.values():
        for i, a in enumerate(members):
            for b in members[i + 1:]:
                if op3.linked(units[a][2], units[b][2]):
                    partner |= {a, b}
    assert {(r["doc_id"], r["paragraph"]) for r in found} == {units[i][:2] for i in partner}
    groups = defaultdict(list)
    for r in found:
        groups[r["component_id"]].append(r)
    for g in groups.values():
        assert sum(r["kept"] for r in g) == 1
        assert min(g, key=lambda r: (r["doc_id"], r["paragraph"]))["kept"]


def test_op4_joins_short_lines():
    text = "a b c\nd e\n\n" + "\n".join(f"s{i} t{i}" for i in range(12)) + "\n" + BASE + "\nx y"
    assert [(n, k) for n, k, _ in op4.paragraphs(text)] == [(0, 25), (15, 200)]
    joined = op4.paragraphs("\n".join(["one two three four five"] * 11))
    assert [(n, k) for n, k, _ in joined] == [(0, 25), (5, 25)]


def test_op4_window_starts_meet_anywhere():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 2**63, op4.WINDOW + op4.SAMPLE - 1, dtype=np.uint64)
    for _ in range(200):
        met = []
        for _ in range(2):
            left = rng.integers(0, 2**63, rng.integers(0, 90), dtype=np.uint64)
            right = rng.integers(0, 2**63, rng.integers(0, 90), dtype=np.uint64)
            starts = op4.window_starts(np.concatenate((left, passage, right))) - len(left)
            met.append({int(x) for x in starts if 0 <= x <= len(passage) - op4.WINDOW})
        assert met[0] & met[1]
    assert list(op4.window_starts(passage[:10])) == []
    assert len(op4.window_starts(np.ones(op4.WINDOW, np.uint64))) == 1


def _runs_shared(texts, size):
    """(text number, first word) of every ``size`` words that stand at two places or more."""
    places = defaultdict(list)
    for d, t in enumerate(texts):
        w = op4.lower_bytes(t or "").split()
        for i in range(len(w) - size + 1):
            places[b" ".join(w[i:i + size])].append((d, i))
    return {p for v in places.values() if len(v) > 1 for p in v}


def test_op4_meets_every_shared_passage_of_51_words(spark, sf, small):
    found = [r for r in rows(QUERIES["op4_paragraph_dedup"](spark, sf)) if r["unit"] == "window"]
    number = {d: i for i, (d, _) in enumerate(small)}
    texts = [t for _, t in small]
    marked = defaultdict(set)
    for r in found:
        marked[number[r["doc_id"]]].add(r["first_word"])
        assert r["n_words"] == op4.WINDOW
    whole = op4.WINDOW + op4.SAMPLE - 1
    passages = _runs_shared(texts, whole)
    assert passages
    for d, i in passages:
        assert any(i + k in marked[d] for k in range(op4.SAMPLE))
    # nothing but repeats is marked, and the first place of each stays
    repeats = _runs_shared(texts, op4.WINDOW)
    assert all((d, i) in repeats for d, at in marked.items() for i in at)
    groups = defaultdict(list)
    for r in found:
        groups[r["component_id"]].append(r)
    for g in groups.values():
        assert [r["kept"] for r in sorted(g, key=lambda r: (r["doc_id"], r["first_word"]))] == [True] + [False] * (len(g) - 1)


def test_op4_passages_inside_lines_and_across_lines(spark, docs, none):
    words = BASE.split()
    own = lambda n, k: [f"own{n}x{i}" for i in range(k)]                      # noqa: E731
    inside = " ".join(own(1, 90) + words[:51] + own(2, 70))
    clean = " ".join(own(4, 60) + words[:30] + own(5, 60))
    across = "\n".join(" ".join((own(6, 7) + words[:51])[i:i + 6]) for i in range(0, 58, 6))
    df = spark.createDataFrame([(1, inside), (2, across), (3, clean), (4, None), (5, "")], "doc_id long, text string")
    found = rows(op4.repeated_passages(df))
    assert {r["doc_id"] for r in found} == {1, 2}
    assert all(r["kept"] == (r["doc_id"] == 1) and r["unit"] == "window" for r in found)
    line = {r["first_word"]: r["paragraph"] for r in found if r["doc_id"] == 2}
    assert all(p == w // 6 for w, p in line.items())
    edge = rows(op4.repeated_passages(docs))
    assert {r["doc_id"] for r in edge if r["unit"] == "window"} >= {1, 2, 3, 7, 8, 12, 13, None}
    assert not any(r["kept"] for r in edge if r["doc_id"] is None)
    assert op4.repeated_passages(none).count() == 0


# 5 ------------------------------------------------------------------------------------------------------------------

def test_op5(spark, docs, none, sf, small):
    ranks = op5.read_ranks(PATH)

    def greedy(word):
        at = n = 0
        while at < len(word):
            at = next(e for e in range(min(len(word), at + 128), at, -1) if word[at:e] in ranks)
            n += 1
        return n

    found = {r["doc_id"]: r for r in rows(QUERIES["op5_token_counts"](spark, sf))}
    for d, t in small[:60]:
        words = t.encode().split()
        assert (found[d]["n_words"], found[d]["n_tokens"], found[d]["n_unknown"]) == (
            len(words), sum(greedy(b" " + w) for w in words), 0)
    edge = rows(op5.token_counts(docs, PATH))
    assert len(edge) == len(ROWS)
    assert all((r["n_words"], r["n_tokens"]) == (0, 0) for r in edge if r["doc_id"] in (4, 5, 6))
    assert op5.token_counts(none, PATH).count() == 0


# 6 ------------------------------------------------------------------------------------------------------------------

def test_op6(spark, docs, none, sf, small):
    import re
    found = {r["doc_id"]: r for r in rows(QUERIES["op6_license_scan"](spark, sf))}
    for d, t in small:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
                           "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        starts, labels = [], set()
        for phrase, label in op6.PHRASES:
            p = phrase.split()
            for i in range(len(words) - len(p) + 1):
                if words[i: i + len(p)] == p:
                    starts.append(i)
                    labels.add(label)
        r = found[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
            len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        met = {label for line in t.split("\n") for block in op6.blocks(op6.clean(line).split())
               for template, label in op6.TEMPLATES
               if len(set(template.split()) & {w.decode() for w in block})
               >= op6.CONTAINMENT * len(set(template.split()))}
        assert set(filter(None, r["labels"].split(","))) == met | labels
    edge = rows(op6.license_scan(docs))
    assert len(edge) == len(ROWS)
    assert [r["labels"] for r in edge if r["doc_id"] == 8] == ["mit"]
    assert all(r["n_words"] == 0 and r["first_word"] is None for r in edge if r["doc_id"] in (4, 5, 6))
    assert op6.license_scan(none).count() == 0


def test_op6_templates_wrapped_over_lines(spark):
    importable_on_workers(spark)
    pad = " ".join(f"p{i}" for i in range(90))
    made = [(1, "Redistribution and use in source and binary forms, with or without\nmodification, are permitted", "bsd"),
            (2, f"{pad}\n{pad} This work is licensed under the GNU General\nPublic License version 3\n{pad}", "gpl-3"),
            (3, "\n".join("this source code form is subject to the terms of the mozilla public license".split()), "mpl"),
            (4, f"this work is licensed under the GNU General\n{pad}\nPublic License version 3", "")]
    df = spark.createDataFrame([(d, t) for d, t, _ in made], "doc_id long, text string")
    found = {r["doc_id"]: (r["labels"], r["score"]) for r in rows(op6.license_scan(df))}
    assert found == {d: (label, 1.0 if label else 0.0) for d, _, label in made}
    long = " ".join(f"l{i}" for i in range(100))
    wrapped = spark.createDataFrame([(1, f"{pad}\n" + long.replace(" l50", "\nl50"))], "doc_id long, text string")
    assert rows(op6.license_scan(wrapped, templates=[(long, "long")]))[0]["labels"] == "long"


# 7 ------------------------------------------------------------------------------------------------------------------

URLS = [
    (1, "https://A.b.Example.NET/en/1?x#y", "a.b.example.net", "/en/1", "example.net/en/", "allow"),
    (2, "http://x.net/", "x.net", "/", "net/", "block"), (3, "http://x.net", "x.net", "", None, "allow"),
    (4, "http://example.com/de/a", "example.com", "/de/a", "example.com/de/", "block"),
    (5, "http://notexample.com/de/a", "notexample.com", "/de/a", None, "allow"),
    (6, "http://q.org/fr/", "q.org", "/fr/", "org/fr/", "allow"), (7, None, "", "", None, "allow"),
    (8, "no scheme/de/", "", "", None, "allow"), (9, "a://b://net/x", "b:", "//net/x", None, "allow"),
    (2, "http://x.net/", "x.net", "/", "net/", "block"), (None, "", "", "", None, "allow"),
    (10, "http://org?/fr/", "org", "", None, "allow"), (11, "http://É.net/Ä", "É.net", "/Ä", "net/", "block"),
]


def test_op7_rules_and_edges(spark):
    importable_on_workers(spark)
    schema = "page_id long, url string, host string, path string, rule string, n long, template string"
    df = spark.createDataFrame([(i, u, "x", "x", "x", 1, "x") for i, u, *_ in URLS], schema)
    found = sort_rows((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"])
                      for r in op7.url_filter(df).collect())
    assert found == sort_rows((i, h, p, r, v) for i, _, h, p, r, v in URLS)
    assert op7.url_filter(df.limit(0)).count() == 0


def test_op7_templates_learn_labelled_purity(spark):
    importable_on_workers(spark)
    made = [(i, f"http://h.test/spam/{i}.html", True if i % 2 else None) for i in range(60)]
    made += [(100 + i, f"http://h.test/junk/{i}.html", True) for i in range(40)]
    made += [(200 + i, f"http://h.test/blog/{i}.html", False if i % 2 else None) for i in range(300)]
    made += [(600 + i, f"http://other.test/item-{i}-x/view", None) for i in range(30)]
    df = spark.createDataFrame(made, "page_id long, url string, bad boolean")
    found = {r["page_id"]: r for r in op7.url_filter(df, label="bad").collect()}
    assert {found[i]["template"] for i in range(60)} == {"/spam/*.html"}
    assert {found[600 + i]["template"] for i in range(30)} == {"/*/view"}
    assert {found[i]["verdict"] for i in range(60)} == {"block"}
    assert {found[100 + i]["verdict"] for i in range(40)} == {"block"}
    assert {found[200 + i]["verdict"] for i in range(300)} == {"allow"}


# 8 ------------------------------------------------------------------------------------------------------------------

def encoding():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_digests(pairs):
    enc = encoding()
    for d, t in pairs:
        ids = enc.encode_ordinary(t or "")
        yield (d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
               hashlib.sha256((t or "").encode()).hexdigest())


@pytest.mark.parametrize("chunk,overlap", [(op8.CHUNK_CHARS, op8.OVERLAP_CHARS), (97, 20)])
def test_op8_edges(docs, none, chunk, overlap):
    made = op8.digests(docs, PATH, PATTERN, chunk_chars=chunk, overlap_chars=overlap)
    found = sort_rows((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in made.collect())
    assert found == sort_rows(token_digests(ROWS))
    assert op8.digests(none, PATH, PATTERN).count() == 0


def test_op8_query(spark, sf, small):
    found = sort_rows((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
                      for r in QUERIES["op8_byte_bpe"](spark, sf).collect())
    assert found == sort_rows(token_digests(small))


# 9 ------------------------------------------------------------------------------------------------------------------

def check_shards(found, given_rows, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in given_rows)
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[i]) for i in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in found)


def test_op9_edges(spark, docs, none):
    plain = docs.select("doc_id", "text", "k", "h")
    check_shards(rows(op9.report(plain)), ROWS, op9.SHARDS)
    assert op9.report(none.select("doc_id", "text")).count() == 0
    with pytest.raises(ValueError):
        op9.shards(docs.withColumn("slot", docs.k)).count()
    written = op9.shards(plain).collect()
    assert Counter((r["doc_id"], r["text"]) for r in written) == Counter(ROWS)


def test_op9_hot_copies_and_order(spark):
    importable_on_workers(spark)
    made = [(1, "same text")] * 900 + [(i, f"text {i}") for i in range(600)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    kwargs = {"bucket_bytes": 2_000, "shards": 7}
    check_shards(rows(op9.report(df, **kwargs)), made, 7)
    a = sorted((r["shard"], r["slot"], r["doc_id"]) for r in op9.shards(df, **kwargs).collect())
    b = sorted((r["shard"], r["slot"], r["doc_id"]) for r in op9.shards(df.repartition(13), **kwargs).collect())
    assert a == b
    other = sorted((r["shard"], r["slot"], r["doc_id"]) for r in op9.shards(df, seed=1, **kwargs).collect())
    assert other != a
    per_shard = Counter(r[0] for r in a if r[2] == 1)
    assert len(per_shard) == 7 and max(per_shard.values()) < 200


# 10 -----------------------------------------------------------------------------------------------------------------

def cut_by_brute_force(pairs, length):
    data = [(d, (t or "").encode()) for d, t in pairs]
    counts = Counter(b[i: i + length] for _, b in data for i in range(len(b) - length + 1))
    for d, b in data:
        covered = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if counts[b[i: i + length]] > 1:
                covered[i] += 1
                covered[i + length] -= 1
        mask = np.cumsum(covered)[:-1] > 0
        spans = int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~mask])
        yield d, len(b), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()


def cut_rows(df):
    return sort_rows((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def test_op10_edges(docs, none):
    short = [(d, t) for d, t in ROWS if t is None or len(t) < 5_000]
    df = docs.filter("doc_id is null or doc_id not in (7, 13)")
    assert cut_rows(op10.repeats(df)) == sort_rows(cut_by_brute_force(short, op10.LENGTH))
    assert op10.repeats(none).count() == 0
    assert {r["doc_id"]: r["n_removed"] for r in op10.repeats(docs).collect()}[7] > 200_000
    cut = op10.remove_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(ROWS)


def test_op10_query(spark, sf, small):
    assert cut_rows(QUERIES["op10_suffix_dedup"](spark, sf)) == sort_rows(cut_by_brute_force(small, op10.LENGTH))


def test_op10_passages(spark, sf, small):
    """Passages of over 50 words that are shorter than LENGTH bytes are counted, whatever is removed."""
    importable_on_workers(spark)
    rng = np.random.default_rng(10)

    def words(n):
        return " ".join("".join(rng.choice(list("abcdefghij"), 4)) for _ in range(n))

    # 51 and 60 words are 254 and 299 bytes, 90 are 449; chained: shared strings of 250 bytes that make no shared 400
    short, longer, long, chain = words(51), words(60), words(90), words(110)
    made = [(d, f"{words(40)}X{p}Y{words(40)}") for d, p in enumerate([short, short, longer, longer, long, long])]
    made += [(10, f"{words(40)}X{words(30)}Y{words(40)}"), (11, f"<{chain[:500]}>"), (12, f"({chain[:300]})"),
             (13, f"[{chain[200:500]}]"), (14, "é" * 600), (15, ""), (16, None), (4, made[4][1]), (None, short)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    found = op10.repeats(df).collect()
    assert cut_rows(op10.repeats(df)) == sort_rows(cut_by_brute_force(made, op10.LENGTH))
    passages = sort_rows((d, n, spans) for d, _, n, spans, _ in cut_by_brute_force(made, op10.PASSAGE))
    assert sort_rows((r["doc_id"], r["n_passage_bytes"], r["n_passages"]) for r in found) == passages
    by = {r["doc_id"]: r for r in found}
    assert all(by[d]["n_passage_bytes"] >= 254 and by[d]["n_removed"] == 0 for d in (0, 1, 2, 3, 11, None))
    assert by[10]["n_passage_bytes"] == 0
    query = QUERIES["op10_suffix_dedup"](spark, sf).collect()
    assert sort_rows((r["doc_id"], r["n_passage_bytes"], r["n_passages"]) for r in query) == sort_rows(
        (d, n, spans) for d, _, n, spans, _ in cut_by_brute_force(small, op10.PASSAGE))
    with pytest.raises(ValueError):
        op10.repeats(df, length=200)


def test_op10_hot_rims(spark):
    """A passage in many documents and near copies, with every anchor over the limit for trimming."""
    importable_on_workers(spark)
    rng = np.random.default_rng(8)

    def noise(n):
        return "".join(rng.choice(list("abcdefghij "), n))

    passage, base = noise(700), noise(1500)
    made = [(d, noise(rng.integers(0, 300)) + passage[: rng.integers(380, 700)] + noise(200)) for d in range(40)]
    for d in range(40, 80):
        text = list(base)
        for at in rng.integers(0, 1500, rng.integers(0, 4)):
            text[at] = "#"
        made.append((d, "".join(text)))
    made += [(90, base), (91, base), (92, None)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    stage = Stage(spark, "test")
    for hot in (0, 3, 10**6):
        ranges = defaultdict(list)
        for r in op10.covered(df, stage, hot=hot).collect():
            ranges[r["doc"]].append((r["start"], r["size"]))
        found = {d: sum(b - a for a, b in op10.merge(*map(list, zip(*r)))) for d, r in ranges.items()}
        expected = {d: n for d, _, n, _, _ in cut_by_brute_force(made, op10.LENGTH) if n}
        assert found == expected
        stage = Stage(spark, "test")


def test_op10_hot_rims_stay_out_of_the_index(spark):
    """Different text before a common passage: no anchor brings more than ``hot`` segments to one bucket."""
    importable_on_workers(spark)
    rng = np.random.default_rng(9)

    def noise(n):
        return "".join(rng.choice(list("abc "), n))

    passage = noise(900)
    made = [(d, noise(340) + passage + noise(int(rng.integers(0, 340)))) for d in range(400)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    stage = Stage(spark, "test")
    ranges = defaultdict(list)
    for r in op10.covered(df, stage, hot=20).collect():
        ranges[r["doc"]].append((r["start"], r["size"]))
    found = {d: sum(b - a for a, b in op10.merge(*map(list, zip(*r)))) for d, r in ranges.items()}
    assert found == {d: n for d, _, n, _, _ in cut_by_brute_force(made, op10.LENGTH) if n}
    per_anchor = Counter(r["v"] for r in spark.read.parquet(f"{stage.root}/index").collect())
    assert max(per_anchor.values(), default=0) <= 20


# pipeline -----------------------------------------------------------------------------------------------------------

def test_pipeline(spark, sf, small):
    importable_on_workers(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    texts = dict(small)
    for name, function in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = Stage(spark, "test").write(function(spark, docs, sf), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before) and after
        if name == "near_dedup":
            exp = expected_components([(d, t or "") for d, t in before.items()], shingle=corpus_pipeline.NEAR_SHINGLE)
            assert set(after) == {d for d, _, _, kept in exp if kept}
        if name == "suffix_dedup":
            assert all(len(after[d]) <= len(t) for d, t in before.items())
            assert {r["doc_id"]: r["n_chars"] for r in docs.collect()} == {d: len(t) for d, t in after.items()}
    final = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in final.collect()} == set(after) <= set(texts)


def test_stages_judge_rows_not_ids(spark):
    importable_on_workers(spark)
    leak = "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10"
    other = " ".join(f"o{i}" for i in range(100))
    given = [(None, BASE), (None, leak + " and more"), (None, other), (None, other), (None, None), (5, "clean text"),
             (5, "before " + leak), (7, BASE + " tail"), (7, "its own words only here"), (8, other + " x"), (6, leak),
             (9, ""), (9, ""), (3, "said twice"), (3, "said twice")]
    df = spark.createDataFrame(given, "doc_id long, text string")
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    clean = Counter((r["doc_id"], r["text"]) for r in op1.clean_rows(df, bench).collect())
    assert clean == Counter(r for r in given if leak not in (r[1] or ""))
    kept = Counter((r["doc_id"], r["text"]) for r in op3.deduplicated(df).collect())
    gone = Counter([(None, BASE), (None, other), (None, other), (3, "said twice"), (6, leak)])      # 6 is near 5
    assert kept == Counter(given) - gone


def test_stages_on_an_empty_table(spark, sf):
    importable_on_workers(spark)
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, empty, sf).count() == 0, name
