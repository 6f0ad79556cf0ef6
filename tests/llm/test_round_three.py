"""Operators 11 to 13: whole small tables and made-up shapes against brute force, and the docstrings' edge cases."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from screenlens.llm import op11_filter_audit as op11, op12_simhash as op12, op13_spelling as op13
from screenlens.llm.common import Stage, importable_on_workers
from screenlens.llm.queries import QUERIES

from .test_operators import ROWS, SCHEMA, docs, none, small  # noqa: F401  (fixtures)


# 11 -----------------------------------------------------------------------------------------------------------------

def audit_brute(documents, labels):
    """(part, order, step) -> counts, by applying every order to every document."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least = {}
    for i, t, _ in documents:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    judged = []
    for i, t, p in documents:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": i is not None and least[t] < i}
        judged.append((p or "", fails, i in good, i in toxic))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    out, shapley = defaultdict(Counter), Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for p, fails, g, x in judged:
            gone = False
            for step, f in enumerate(order, 1):
                c = out[p, order, step]
                removed = fails[f] and not gone
                c["redundant"] += fails[f] and gone
                gone = gone or fails[f]
                c["kept"] += not gone
                c["removed"] += removed
                c["good_lost"] += removed and g
                c["toxic_lost"] += removed and x
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                shapley[p, f] += removed
    return {(*k, *(c[n] for n in names), shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def audit_rows(df):
    return {tuple(r) for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                                        "good_lost", "toxic_lost", "shapley").collect()}


def test_op11_edges(spark, none):  # noqa: F811
    importable_on_workers(spark)
    long = " ".join(f"w{i}" for i in range(400))
    data = [(1, long, "p"), (2, long, None), (2, long, "p"), (None, long, "p"), (None, long, ""), (3, None, "p"),
            (4, "", "q"), (5, "a " * 500, "q"), (6, "ABC " + long, "q"), (6, long + " #", "q"), (7, "A" * 90_000, "q"),
            (8, "two|words", None), (9, "é" * 50 + "A", "q"), (10, " \n\t ", "p")]
    marks = [(1, 1, 0), (2, 1, 1), (2, 0, None), (None, 1, 1), (3, None, 1), (5, 0, 1), (99, 1, 1)]
    df = spark.createDataFrame([(*d, "x") for d in data], "doc_id long, text string, source string, part string")
    lab = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    expected = audit_brute(data, marks)
    assert audit_rows(op11.filter_audit(df, lab)) == expected
    # shards of one document, pieces of a few bytes: the same counts
    assert audit_rows(op11.filter_audit(df.repartition(5), lab, shard_bytes=1)) == expected
    assert op11.filter_audit(none.withColumnRenamed("k", "source"), lab).count() == 0
    assert b"".join(op11.pieces(b"ab  cd\nef gh", 3)) == b"ab  cd\nef gh"
    assert [p.split() for p in op11.pieces(b"abcd ef", 1)] == [[b"abcd"], [b"ef"]]


def test_op11_whole_table(spark, sf):
    d = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    lab = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert audit_rows(QUERIES["op11_filter_audit"](spark, sf)) == audit_brute(d, lab)


def test_op11_matrix(spark):
    """Global codes are dense and one per word; a row's sum and nonzero count come from the coded block."""
    importable_on_workers(spark)
    texts = ["b a b", "", "c a", None, "d d d d"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    stage = Stage(spark, "test")
    local = stage.write(op11.counted(df, shard_bytes=1), "counted")
    in_shards = local.selectExpr("shard", "posexplode(words) as (at, word)")
    codes = {(r["shard"], r["at"]): r["code"] for r in op11.global_codes(in_shards, stage).collect()}
    words = {(r["shard"], r["at"]): bytes(r["word"]) for r in in_shards.collect()}
    assert len({(words[k], codes[k]) for k in words}) == len(set(words.values())) == 4
    assert sorted(set(codes.values())) == [0, 1, 2, 3]
    n, distinct = op11.row_statistics(np.array([0, 3, 3, 4]), np.array([5, 2, 5, 9]), np.array([1, 4, 1, 7]))
    assert n.tolist() == [6, 0, 7] and distinct.tolist() == [2, 0, 1]


# 12 -----------------------------------------------------------------------------------------------------------------

def print_brute(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_brute(prints):
    """fingerprint -> least fingerprint reachable over links of at most four bits."""
    v = np.array(sorted(set(prints)), np.uint64)
    parent = list(range(len(v)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1:] ^ v[i]) <= 4):
            a, b = sorted((find(i), find(i + 1 + int(j))))
            parent[b] = a
    return {int(v[i]): int(v[find(i)]) for i in range(len(v))}


def expected_groups(data):
    prints = [print_brute(t) for _, t in data]
    group = groups_brute(prints)
    least = {}
    for (i, _), p in zip(data, prints):
        if i is not None:
            least[group[p]] = min(i, least.get(group[p], i))
    return sorted(((i, f"{p:016x}", least.get(group[p])) for (i, _), p in zip(data, prints)), key=repr)


def found_groups(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_op12_edges(spark, docs, none):  # noqa: F811
    assert found_groups(op12.simhash_groups(docs)) == expected_groups(ROWS)
    assert op12.simhash_groups(none).count() == 0


def test_op12_whole_table(spark, sf, small):  # noqa: F811
    assert found_groups(QUERIES["op12_simhash"](spark, sf)) == expected_groups(small)


@pytest.mark.parametrize("cold", [2, 8, 64])
def test_op12_clouds(spark, cold):
    """Near fingerprints in clouds, with chains at distance four and pairs at five, at every split of hot and cold."""
    importable_on_workers(spark)
    r = random.Random(cold)
    prints = set()
    for _ in range(3):
        centre = r.getrandbits(64)
        for _ in range(60):
            prints.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))))
    at = r.getrandbits(64)
    for _ in range(6):
        prints.add(at)
        at ^= sum(1 << b for b in r.sample(range(64), 4))
    prints.add(at ^ 0b11111)
    prints |= {0, 2**64 - 1}
    classes = spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "fp long")
    stage = Stage(spark, "test")
    met = op12.posted(classes, 6)
    counts = met.groupBy("key").count()
    met = met.join(counts, "key")
    links = op12.cold_links(met.filter(f"count <= {cold}").select("key", "fp")).union(
        op12.hot_links(met.filter(f"count > {cold}").select("fp").distinct(), stage))
    found = {r["node"] % 2**64: r["component"] % 2**64 for r in op12.components(links, stage, "c").collect()}
    expected = defaultdict(set)
    for p, g in groups_brute(prints).items():
        expected[g].add(p)
    got = defaultdict(set)
    for p in prints:
        got[found.get(p, p)].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_op12_pivots_discard_nothing_near():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**64, 4000, dtype=np.uint64)
    b = a.copy()
    for bits in r.integers(0, 64, (4, 4000)):
        b ^= np.uint64(1) << bits.astype(np.uint64)
    far = np.abs(op12.pivot_table(a, op12.pivots()) - op12.pivot_table(b, op12.pivots())).max(1)
    assert (far <= op12.RADIUS).all()
    other = np.abs(op12.pivot_table(a, op12.pivots()) - op12.pivot_table(np.roll(a, 1), op12.pivots())).max(1)
    assert (other > op12.RADIUS).mean() > 0.99      # and nearly all chance pairs
    for blocks in (6, 7, 9):
        masks = op12.key_masks(blocks)
        assert (((a ^ b)[:, None] & masks) == 0).any(1).all()
    assert [op12.blocks_for(n) for n in (0, 10, 2**20, 2**24, 2**40 - 1)] == [6, 6, 6, 7, 11]


def test_op12_texts_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(400))
    whole = op12.fingerprint(text.encode())
    monkeypatch.setattr(op12, "pieces", lambda data: op11.pieces(data, 7))
    assert op12.fingerprint(text.encode()) == whole == print_brute(text)


# 13 -----------------------------------------------------------------------------------------------------------------

def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def variants_brute(data):
    counts = Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for i, t in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    nears = {w: [x for k in (-1, 0, 1) for x in by_length[len(w) + k] if near(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(nears[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 10 * n:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(nears[w]), words[form[w]] if w in form else None))
    return out


def found_variants(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_op13_edges(spark, docs, none):  # noqa: F811
    assert found_variants(op13.variant_groups(docs)) == variants_brute([r[:2] for r in ROWS])
    assert op13.variant_groups(none).count() == 0


def test_op13_chains_ties_and_hot_halves(spark):
    importable_on_workers(spark)
    data = [(1, "abcdefgh " * 2_000 + "abcdefgx " * 150 + "abcdefxx " * 10 + "abcdxxxx Abcdxxxx"),
            (2, "colour01 " + "ÀÉÎÕÜßa ÀÉÎÕÜßa ÀÉÎÕÜßb ÀÉÎÕÜßb " * 3 + "Z" * 3_000 + " " + "z" * 3_000 + " " + "z" * 3_001),
            (3, "z" * 3_001 + " bbbbbbb" * 20 + " cbbbbbb" * 20 + " bbbbbbbb bbbbbbbb dbbbbbb dbbbbbb"), (None, "abcdefg " * 3)]
    r = random.Random(5)
    data += [(10 + i, " ".join("prefix" + "".join(r.choice("ab") for _ in range(r.randint(1, 6))) for _ in range(300)))
             for i in range(4)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    expected = variants_brute(data)
    assert any(form and root != form for _, form, root, *_ in expected)      # a chain of two
    assert found_variants(op13.variant_groups(df)) == expected
    assert found_variants(op13.variant_groups(df, group_words=3, shard_postings=50)) == expected


def test_op13_whole_table(spark, sf, small):  # noqa: F811
    assert found_variants(QUERIES["op13_spelling"](spark, sf)) == variants_brute(small)


@pytest.mark.parametrize("seed", range(8))
def test_op13_schemes(seed):
    r = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdeé"
    words = sorted({"".join(r.choice(letters) for _ in range(r.randint(7, 10))) for _ in range(120)})
    asked = [w for w in words for _ in (0, 1)]
    pairs = set()
    for q, w, more in op13.near_in_shard(words, asked, [True, False] * len(words)):
        pairs.add((asked[q], words[w]))
        if more:
            pairs.add((words[w], asked[q]))
    assert pairs == {(a, b) for a in words for b in words if near(a, b)}


def test_op13_intervals():
    """Both directions give the interval of the same occurrences, kept in step."""
    words = ["banana", "bandana", "anna"]
    index = op13.BidirectionalIndex(words)
    text = "\n" + "\n".join(words) + "\n"
    for pattern in ("an", "ana", "nd", "\nb", "a\n", "na\n"):
        codes, _ = index.encode([pattern.strip("\n") or "a"])
        symbol = {c: codes[1 + i] for i, c in enumerate(pattern.strip("\n"))} | {"\n": op13.DELIMITER}
        right, left = index.whole(1), index.whole(1)
        for c in pattern:
            right = index.extend(True, right, np.array([symbol[c]]))
        for c in reversed(pattern):
            left = index.extend(False, left, np.array([symbol[c]]))
        assert (right == left).all()
        places = sorted(index.suffixes[right[0, 0]: right[0, 0] + right[2, 0]].tolist())
        assert places == [m.start() for m in re.finditer(f"(?={re.escape(pattern)})", text)]
