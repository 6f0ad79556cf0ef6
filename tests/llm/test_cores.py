"""Small parts of the operators against plain re-computations."""

import base64
import random
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from screenlens.llm import (
    op1_decontaminate as op1,
    op2_quality as op2,
    op3_minhash as op3,
    op4_paragraphs as op4,
    op5_wordpiece as op5,
    op6_licenses as op6,
    op8_bpe as op8,
    op9_shards as op9,
    op10_suffix as op10,
)

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
words = st.text(alphabet="ab \n\té", max_size=60)


def edit_distance_to_a_stretch(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@given(st.text(alphabet="ab ", min_size=1, max_size=70), st.text(alphabet="ab c", max_size=120))
def test_myers_is_the_edit_distance(pattern, text):
    assert op1.myers(op1.masks(pattern), len(pattern), text)[0] == edit_distance_to_a_stretch(pattern, text)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(0, 14))
def test_pigeonhole_finds_every_item_within_budget(seed, edits):
    rng = random.Random(seed)
    item = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9))) for _ in range(30))
    damaged = list(item)
    for _ in range(edits):
        damaged[rng.randrange(len(damaged))] = rng.choice("abcdefg ")
    text = "x y z " * 5 + "".join(damaged) + " q r s" * 5
    machine, table = op1.automaton({item: [1]}, op1.EDIT_SHARE)
    found = op1.matches(text, machine, table)
    best = edit_distance_to_a_stretch(item, text)
    assert bool(found) == (best <= op1.budget(item))
    if found:
        assert found[0][1] == best


@given(words)
def test_word_hashes_follow_words(text):
    data = text.encode()
    split = data.split()
    hashes = op3.word_hashes(data)
    assert len(hashes) == len(split)
    assert len(set(hashes.tolist())) == len(set(split))


@given(words, words)
def test_shingle_hashes_follow_exact_sets(a, b):
    sa, sb = op3.exact_set(a), op3.exact_set(b)
    ha, hb = set(op3.shingle_hashes(a).tolist()), set(op3.shingle_hashes(b).tolist())
    assert (len(ha), len(hb), len(ha & hb)) == (len(sa), len(sb), len(sa & sb))


def test_bands_reach_the_recall():
    n = op4.tune()
    assert (1 - 0.8**op4.ROWS) ** n <= 0.0005 < (1 - 0.8**op4.ROWS) ** (n - 1)


def test_paragraph_signatures_follow_the_sets():
    rng = random.Random(5)
    units = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 40))).encode() for _ in range(50)]
    hasher = op3._Hasher(12)
    swept = op4.signatures(units, [len(u.split()) for u in units], 5, hasher)
    assert (swept == hasher.signatures([op3.shingle_hashes(u.decode(), 5) for u in units])).all()


def greedy(word, initial, continuing):
    at = count = 0
    while at < len(word):
        pieces = initial if at == 0 else continuing
        stop = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if stop is None:
            return -1
        at, count = stop, count + 1
    return count


pieces = st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=14)


@settings(max_examples=300, deadline=None)
@given(pieces, pieces, st.binary(min_size=1, max_size=24).map(lambda b: bytes(x % 3 + 97 for x in b)))
def test_automaton_counts_greedy_pieces(initial, continuing, word):
    assert op5.Automaton(initial, continuing).count(word) == greedy(word, initial, continuing)


def test_automaton_on_the_vocabulary():
    ranks = op5.read_ranks(PATH)
    machine = op5.Automaton(ranks, ranks)
    for word in [b" the", b" unbelievableness", " Überraschung".encode(), b" ", b" 1234567", b"\xff\xfe"]:
        assert machine.count(word) == greedy(word, ranks, ranks)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("released under the mit license apache version 2 x y".split()), max_size=14))
def test_license_join_finds_every_met_template(block):
    index = op6.TemplateIndex(op6.TEMPLATES, Counter({b"the": 9, b"license": 5}), op6.CONTAINMENT)
    given_block = [w.encode() for w in block]
    expected = {}
    for template, label in op6.TEMPLATES:
        words = set(op6.clean(template).split())
        share = len(words & set(given_block)) / len(words)
        if share >= op6.CONTAINMENT - 1e-12:
            expected[label] = max(expected.get(label, 0), share)
    assert index.met(given_block) == expected


def test_license_base_places():
    phrases = [(b" cc by nc ", "cc-by-nc")]
    words = op6.clean("CC BY-NC, cc by\nnc x cc by ncx").split()
    assert op6.base_places(words, phrases) == ([0, 3], {"cc-by-nc"})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1'!? \n\tsré", min_size=1, max_size=120), st.integers(3, 30), st.integers(1, 20))
def test_stitched_chunks_have_the_true_pieces(text, chunk, overlap):
    codec = op8.Codec.get(PATH, public_tokenizers.PATTERN)
    starts = list(range(0, len(text), chunk))
    parts = [text[s: s + chunk + overlap] for s in starts]
    final = [s + chunk + overlap >= len(text) for s in starts]
    n = final.index(True) + 1
    ends = [op8._unpack(op8._pack(codec.ends(p, f))) for p, f in zip(parts[:n], final)]
    segments = op8.stitch(codec, starts[:n], parts[:n], ends)
    assert np.concatenate([e for _, e in segments]).tolist() == [m.end() for m in codec.pattern.finditer(text)]


def test_codec_round_trip():
    codec = op8.Codec.get(PATH, public_tokenizers.PATTERN)
    with open(PATH, "rb") as f:
        assert len(codec._tokens) == sum(1 for _ in f)
    for text in ["", "hello  world\n", "ça va? 日本語 🙂", "<|endoftext|>"]:
        ids = codec.encode_pieces(codec.pattern.findall(text))
        assert codec.decode(ids) == text.encode()
    assert base64.b64decode(b"IQ==") in codec._tokens.values()


def test_fisher_yates_is_a_permutation_and_uniform():
    rng = np.random.default_rng(0)
    seen = Counter(tuple(op9.fisher_yates(3, rng)) for _ in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 850
    assert op9.fisher_yates(0, rng).tolist() == []


def covered_starts(parts, length):
    counts = Counter(p[i: i + length] for p in parts for i in range(len(p) - length + 1))
    return [{i for i in range(len(p) - length + 1) if counts[p[i: i + length]] > 1} for p in parts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 2 + 97 for x in b)), max_size=6), st.integers(2, 12))
def test_run_index_marks_all_repeats(parts, length):
    found = op10.matched(parts, length)
    starts = [{i for a, n in spans for i in range(a, a + n - length + 1)} for spans in found]
    assert starts == (covered_starts(parts, length) if parts else [])


def test_run_index_is_run_compressed():
    rng = random.Random(1)
    base = bytes(rng.choice(b"abcdefgh") for _ in range(500))
    index = op10.RunIndex([base] * 20, 500)
    assert index.runs < len(index.text) / 8


def test_segments_give_equal_windows_equal_anchors():
    rng = random.Random(2)
    shared = bytes(rng.choice(b"abcdef ") for _ in range(900))
    texts = [bytes(rng.choice(b"abcdef ") for _ in range(rng.randint(0, 700))) + shared for _ in range(4)]
    ends = np.cumsum([len(t) for t in texts]).tolist()
    text, anchor, _, start, size, _ = op10.segments(b"".join(texts), list(zip([0, *ends[:-1]], ends)), 400, 16)
    by_window = {}
    for t, v, a, n in zip(text.tolist(), anchor.tolist(), start.tolist(), size.tolist()):
        for i in range(a, a + n - 399):
            by_window.setdefault(texts[t][i: i + 400], set()).add(v)
    assert len(by_window) > 0 and all(len(v) == 1 for v in by_window.values())
    windows = {t[i: i + 400] for t in texts for i in range(len(t) - 399)}
    assert windows == set(by_window)


def test_whole_characters():
    assert op10.whole_characters("aéb", [(2, 4)]) == "aé"
    assert op10.whole_characters("aéb", [(1, 2)]) == "aéb"
    assert op10.whole_characters("aéb", [(1, 3)]) == "ab"


def brute_statistics(text):
    w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    tri = Counter(tuple(w[i: i + 3]) for i in range(len(w) - 2))
    repeat = {j for i in range(len(w) - 2) if tri[tuple(w[i: i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if __import__("re").search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeat))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #|\n\t\x0b\x0c\r\x85\xa0é", max_size=120))
def test_base_statistics(text):
    assert op2.statistics(text)[:5] == brute_statistics(text)


def two_kinds():
    rng = np.random.default_rng(0)
    good = np.abs(rng.normal(0.0, 0.01, (900, len(op2.FEATURES))))
    bad = good[:100] + np.eye(len(op2.FEATURES))[0] * 0.4
    return np.vstack([good, bad]), np.array([True] * 900 + [False] * 100)


def test_forest_isolates_what_differs():
    x, label = two_kinds()
    forest = op2.fit(x[::2], label[::2])
    rejected = forest.rejects(x[1::2])                       # rows that the fit has not seen
    assert rejected[~label[1::2]].mean() > 0.95 and rejected[label[1::2]].mean() < 0.01
    assert op2.fit(x[label], label[label]) is None


def test_forest_decides_alone():
    x, label = two_kinds()
    forest = op2.fit(x, label)
    assert forest.rejects(x)[~label].all()
    forest.trees = [tuple(np.array([v]) for v in (-1, 0.0, 0, 0, 8.0))]   # one leaf: every row as far as any other
    assert len(set(forest.score(x))) == 1 and not forest.rejects(x).any()


def path(tree, row, node=0):
    column, value, left, right, length = (c[node] for c in tree)
    return length if column < 0 else path(tree, row, left if row[column] < value else right)


def test_forest_scores_are_mean_paths():
    x, label = two_kinds()
    forest = op2.fit(x, label)
    seen = op2.excess(x, forest.middle, forest.unit, forest.side)
    want = [2.0 ** (-np.mean([path(t, row) for t in forest.trees]) / forest.scale) for row in seen[::50]]
    assert np.allclose(forest.score(x)[::50], want)
    # without a split the path is the expected one of as many rows
    assert op2.grow(np.zeros((7, 2)), np.random.default_rng(0), 5) == [(-1, 0.0, 0, 0, op2.average_path(7))]


def test_threshold_is_the_best_balance():
    rng = np.random.default_rng(5)
    for _ in range(50):
        good, bad = rng.integers(0, 4, 40) * (np.arange(40) < rng.integers(1, 40)), rng.integers(0, 4, 40)
        loss = float(rng.choice([0.0, 0.1, 0.3]))
        t = op2.threshold_of(good, bad, loss, 2.0)
        gain = {}
        for at in range(40):
            lost, caught = good[at:].sum() / max(1, good.sum()), bad[at:].sum() / max(1, bad.sum())
            if lost <= loss:
                gain[at] = caught - 2.0 * lost
        top = max(gain.values(), default=0)
        if top <= 0:
            assert t == np.inf
        else:
            assert abs(gain[round(t * op2.GRID)] - top) < 1e-12
