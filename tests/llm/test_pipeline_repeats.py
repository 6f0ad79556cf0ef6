"""The pipeline's suffix stage against brute force over shared passages of more than 50 words."""

import random

from corpus_pipeline import COLUMNS, REPEAT_BYTES, suffix_dedup

WORDS = 51


def shared_passages(texts):
    """(document, first word) of every window of WORDS words that another place has too."""
    places = {}
    for d, t in enumerate(texts):
        w = t.split()
        for i in range(len(w) - WORDS + 1):
            places.setdefault(" ".join(w[i:i + WORDS]), []).append((d, i))
    return {k: v for k, v in places.items() if len(v) > 1}


def test_passages_of_over_fifty_words_go(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmno") for _ in range(r.randint(3, 8)))
    fresh = lambda n: [word() for _ in range(n)]
    passages = [fresh(n) for n in (51, 52, 55, 60, 80, 200)]
    texts, clean = [], []
    for n in range(60):
        own = [fresh(r.randint(30, 200)) for _ in range(3)]
        if n % 3:
            texts.append(" ".join(own[0] + passages[n % 6] + own[1] + passages[(n * 7 + 1) % 6] + own[2]))
        else:
            # thirty shared words are no passage
            texts.append(" ".join(own[0] + passages[5][:30] + own[1] + own[2]))
            clean.append(n)
    found = shared_passages(texts)
    assert found and all(len(p) >= REPEAT_BYTES for p in found)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)],
                               "doc_id long, text string, lang string, source string, n_chars long").select(*COLUMNS)
    left = {x["doc_id"]: x["text"] for x in suffix_dedup(spark, df, "").collect()}
    assert len(left) == len(texts)
    for passage, places in found.items():
        assert all(passage not in left[d] for d, _ in places)
    assert shared_passages([left[i] for i in range(len(texts))]) == {}
    assert all(left[d] == texts[d] for d in clean)


def test_whole_table(spark, sf):
    """Of the small table, no passage of REPEAT_BYTES bytes or more that is shared on the input is left in its place."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*COLUMNS).dropDuplicates(["text"])
    before = {r["doc_id"]: r["text"] for r in docs.collect() if r["text"]}
    after = {r["doc_id"]: r["text"] for r in suffix_dedup(spark, docs, sf).collect()}
    ids = sorted(before)
    shared = {" ".join(p.split()) for p in shared_passages([before[i] for i in ids]) if len(p.encode()) >= REPEAT_BYTES + 60}
    left = shared_passages([after[i] for i in ids])
    # what differs in white space only is no repeat of bytes
    raw = [p for p in shared if p in left and sum(p in before[i] for i in ids) > 1]
    assert not raw
