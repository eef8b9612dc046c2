"""The pipeline's near-dedup against brute force over all pairs."""

from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from scenequarry.llm import near_copies

SCHEMA = "doc_id long, text string, source string"


def plain_set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1))))


def plain_leaders(rows):
    """The least doc_id of each component under a similarity of 0.8, by comparing all pairs."""
    sets = {d: plain_set(t) for d, t, _ in rows}
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return sorted({top(d) for d in sets})


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(400)])
    line = list(words[:12])
    texts = [list(rng.choice(words, rng.integers(1, 150))) + line * int(rng.integers(0, 2)) for _ in range(40)]
    for start in texts[:20]:  # copies with one to four words changed: similarities on both sides of 0.8
        for _ in range(3):
            copy = list(start)
            for at in rng.integers(0, len(copy), rng.integers(0, 5)):
                copy[at] = f"new{rng.integers(1000)}"
            texts.append(copy)
    made = [" ".join(t) for t in texts] + ["", None, " \t"]
    return [(i, t, "s") for i, t in enumerate(made)]


@pytest.mark.parametrize("crowd", [near_copies.CROWD, 2])
def test_stage_keeps_one_of_all_that_are_alike(spark, sf, monkeypatch, rows, crowd):
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    docs = spark.createDataFrame(rows, SCHEMA)
    want = plain_leaders(rows)
    kept = corpus_pipeline.STAGES[1][1](spark, docs, sf)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want and len(want) < len(rows)


def test_copies_of_one_text_make_no_pairs_by_the_square(spark, monkeypatch):
    """Copies that each differ from the text by nearly a fifth, so that hardly two of them link to each other."""
    rng = np.random.default_rng(9)
    start, texts = [f"w{i}" for i in range(60)], []
    for i in range(150):
        copy = list(start)
        copy[int(rng.integers(2, 58))] = f"new{i}"
        if i % 2:
            copy.append(f"end{i}")
        texts.append(" ".join(copy))
    rows = [(i, t, "s") for i, t in enumerate([" ".join(start), *texts])] + [(500 + i, " ".join(start[:20] + [f"v{i}x{j}" for j in range(60)]), "s") for i in range(10)]
    docs, tried = spark.createDataFrame(rows, SCHEMA), []
    verified = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *more: tried.append(pairs.count()) or verified(pairs, *more))
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == plain_leaders(rows) == [0, *range(500, 510)]
    assert sum(tried) < 150 * 20 < 150 * 149 / 2


def test_texts_that_share_a_passage_only_are_not_compared(spark, monkeypatch):
    """A passage that the sample does not show to be common: its shingles go back in the order once prefixes show them crowded."""
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    passage = [f"p{i}" for i in range(24)]
    own = lambda i, k: [f"v{i}x{j}" for j in range(k)]
    texts = [" ".join(own(i, 40) + passage + own(-i - 1, 20)) for i in range(120)]
    texts += [texts[7] + " end", texts[7] + " end of it", " ".join(passage), " ".join([*passage, "end"])]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    docs, tried = spark.createDataFrame(rows, SCHEMA), []
    verified = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *more: tried.append(pairs.count()) or verified(pairs, *more))
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == plain_leaders(rows) == [*range(120), 122]
    assert sum(tried) < 20


def test_rows_without_or_with_the_same_doc_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    docs = spark.createDataFrame([(None, a, "s"), (None, b, "s"), (1, b, "s"), (1, "c d e f g h", "s"), (2, "c d e f g h", "t")], SCHEMA)
    kept = sorted(((r.doc_id, r.text) for r in near_copies.keep_one(docs).collect()), key=str)
    assert kept == sorted([(None, a), (1, b), (1, "c d e f g h")], key=str)


def test_simhash_links_come_first_and_are_not_compared_again(spark, monkeypatch):
    """Fingerprints at most two bits apart are linked by op10's join, then checked exactly; the prefix join leaves them out."""
    long = [f"w{i}" for i in range(2000)]
    texts = [" ".join(long), " ".join([*long[:-1], "end"]), " ".join(f"v{i}" for i in range(50))]
    docs, tried = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SCHEMA), []
    verified = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *more: tried.append(pairs.count()) or verified(pairs, *more))
    assert (near_copies.simhash.fingerprint(texts[0]) ^ near_copies.simhash.fingerprint(texts[1])).bit_count() <= 2
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == [0, 2]
    assert tried == [1, 0]


def test_tables_of_the_way_go(spark, rows, monkeypatch):
    """Of all that the stage writes on its way only its leaders stay."""
    names = []
    written = near_copies.written
    monkeypatch.setattr(near_copies, "written", lambda df: names.append(written(df)) or names[-1])
    near_copies.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    left = [place for _, place in names if Path(place.removeprefix("file://")).exists()]
    assert len(names) > 5 and left == [names[-1][1]]
