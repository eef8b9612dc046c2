"""The operators against brute force on small tables, with nulls, ties, repeats and clashing names."""

import hashlib
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scenequarry.llm import audio, html_crf, mixing, mtree, packing, shared, simhash, token_counts, token_files, toxicity, url_filter
from scenequarry.llm.queries import BYTE_BPE, RULES, WORD_BPE
from scenequarry.llm.shared import scratch
from scenequarry.llm.word_cache import WordCache

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, rank string, fp string"
ODD = ["", "a", " a", "a ", "a  b", "a\n\nb", "a \n b", "\n", "\t x\ty\t", "it's they'LL o'clock 's", "x<|endoftext|> y", "日本語 é é ẞ İ ſ", "a b \x1c c\x85d", "1234 5,6.7 --- !!!\r\nz", "ÀÉÎ ß ÿ ñ's", "a" * 500 + " b", "x \n", "\nfoo", "foo\n\n\nbar  \n baz"]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(0)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 9))) for _ in range(300)]
    made = [" ".join(rng.choice(words, rng.integers(1, 400))) + rng.choice(["", ".", "\nend. Of it"]) for _ in range(60)]
    made += made[:5] + ["The same text here and there"] * 12 + ODD + [None, None, "word " * 5000]
    return made


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", [None, "a", "b", "c", "ä"][i % 5 if i % 3 else 1], 0, 7, "r", "f") for i, t in enumerate(texts)]
    rows.append(rows[3])
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@cache
def bare(path):
    return Tokenizer.from_file(path)


def ids_of(path, text, end):
    """Ids by the library alone, without a setting."""
    return np.array([*bare(path).encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_word_cache_equals_whole_texts(path, texts):
    sample = [t or "" for t in texts]
    sample += ["hello <|endoftext|> world", "<|endoftext|>", "a <|ENDOFTEXT|> b", "x <|startoftext|><|endoftext|>\ny", "<| endoftext |>"]
    coder = WordCache(path, limit=50)
    want = [ids_of(path, t, 0)[:-1].tobytes() for t in sample]
    assert coder.encode(sample) == want and coder.encode(sample[::-1]) == want[::-1]
    as_text = WordCache(path, special_as_text=True)
    assert as_text.encode(sample) == as_text.whole(sample) != want


def test_token_files(spark, docs, none):
    manifest = token_files.write_tokens(docs, scratch(spark, "t"), WORD_BPE, end_id=1, seq_len=64)
    got = sorted(token_files.read_documents(spark, manifest).collect(), key=lambda r: r.start)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    at = 0
    for r, (doc, text) in zip(got, rows, strict=True):
        ids = ids_of(WORD_BPE, text, 1)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    first = manifest.orderBy("shard").first()
    shard = token_files.TokenShard(first.tokens)
    ids, mask = shard.sequence(0)
    assert len(ids) == len(mask) == 64 and mask.all()
    last_ids, last_mask = shard.sequence(first.n_sequences - 1)
    assert last_mask.sum() == (first.n_tokens - 1) % 64 + 1 and not last_ids[~last_mask].any()
    empty = token_files.write_tokens(none, scratch(spark, "t"), WORD_BPE, end_id=1)
    assert token_files.read_documents(spark, empty).count() == 0


def test_mix_targets_reshare_the_excess():
    got = mixing.targets({"a": 10, "b": 100, None: 100}, {"a": 3, "b": 1, None: 2})
    assert got["a"] == 20 and got["b"] + got[None] == pytest.approx(1.5 * 210 - 20)
    assert got[None] == pytest.approx(min(200, 2 * got["b"]))
    assert mixing.cyclic_weights([None, "b", "a", "ä"]) == {"a": 3, "b": 1, "ä": 2, None: 3}


@pytest.mark.parametrize("seed", range(6))
def test_fit_counts_is_the_best_subset_sum(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    lengths, counts = np.unique(rng.integers(1, 60, 12)), None
    counts = rng.integers(0, 5, len(lengths))
    budget = int(rng.integers(0, 1 + (lengths * counts).sum()))
    taken = mixing._knapsack(lengths, counts, budget)
    sums = {0}
    for x, c in zip(lengths, counts):
        sums = {s + x * k for s in sums for k in range(c + 1)}
    assert (taken <= counts).all() and (taken * lengths).sum() == max(s for s in sums if s <= budget)
    fitted = mixing.fit_counts(lengths, counts, budget)
    total = int((lengths * counts).sum())
    best = max((x for x in sums if x <= budget), default=0)
    assert (0 <= fitted).all() and (fitted <= counts).all() and (fitted * lengths).sum() <= budget
    assert (fitted * lengths).sum() == best or not total
    monkeypatch.setattr(mixing, "WINDOW", 1)
    fitted = mixing.fit_counts(lengths, counts, budget)
    assert (fitted <= counts).all() and (fitted * lengths).sum() <= budget


def test_fit_counts_swaps_long_documents_and_shares_by_length():
    long = np.array([60_000, 70_000, 80_000])
    assert mixing.fit_counts(long, np.ones(3, int), 130_000).tolist() == [1, 1, 0]
    rng = np.random.default_rng(8)
    lengths = np.unique(rng.integers(1, 20_000, 3000))
    counts = rng.integers(1, 40, len(lengths))
    budget = int((lengths * counts).sum() * 0.37)
    fitted = mixing.fit_counts(lengths, counts, budget)
    assert (fitted * lengths).sum() == budget and (fitted <= counts).all()
    assert (np.abs(fitted - 0.37 * counts) * lengths).sum() < 0.1 * budget  # about the same share of every length


def test_mix(spark, docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    size = {i: len((t or "").encode().split()) for i, t in docs.select("doc_id", "text").collect()}
    assert all(r["size"] == size[r.doc_id] and 0 <= r.times <= 2 for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    wanted = mixing.targets({s: sum(r["size"] for r in v) for s, v in by.items()}, mixing.cyclic_weights(list(by)))
    for s, v in by.items():
        assert {(r.source_size, r.target) for r in v} == {(sum(r["size"] for r in v), wanted[s])}
        assert abs(sum(r["size"] * r.times for r in v) - v[0].target) <= min(r["size"] for r in v if r["size"]) + 1
    again = mixing.mix(docs.repartition(2)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))
    clashing = docs.withColumn("times", docs.n_chars).withColumn("_copy", docs.lang)
    copies = mixing.mixed_documents(clashing).collect()
    assert set(map(tuple, copies)) <= set(map(tuple, clashing.collect()))
    words = defaultdict(int)
    for r in copies:
        words[r.source] += size[r.doc_id]
    assert words == {s: w for s, v in by.items() if (w := sum(r["size"] * r.times for r in v))}
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).columns == none.columns


def test_audio_keeps_the_bytes(spark, docs, none):
    rows = {r.doc_id: r for r in audio.stored_and_read(spark, docs).collect()}
    by_text = defaultdict(set)
    for i, t in docs.select("doc_id", "text").collect():
        raw = (t or "").encode()
        full = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(full), hashlib.sha256(full).hexdigest())
        assert r.tail_crc32 == zlib.crc32(full[-16:]) and r.media_bytes == len(full) + 44
        by_text[t or ""].add(tuple(r)[1:])
    assert all(len(v) == 1 for v in by_text.values())
    assert audio.stored_and_read(spark, none).count() == 0
    long = spark.createDataFrame([(None, "noise and text " * 60_000), (None, None)], "doc_id long, text string")
    assert sorted(r.payload_bytes for r in audio.stored_and_read(spark, long).collect()) == [192, 900_096]


def plain_features(text):
    """Spans and tensors by direct convolution, a loop over frames and a scan with two levels."""
    raw = (text or "").encode()
    x = (np.frombuffer(raw.ljust(max(1, -(-len(raw) // 192)) * 192), np.uint8).astype(float) - 128) / 128
    y = []
    for j in range(len(x) * 2 // 3):
        total = norm = 0.0
        for t in range(int(j * 1.5) - 13, int(j * 1.5) + 15):
            d = t - j * 1.5
            if abs(d) < 12:
                w = np.sinc(2 / 3 * d) * (0.5 + 0.5 * np.cos(np.pi * d / 12))
                norm += w
                total += w * (x[t] if 0 <= t < len(x) else 0.0)
        y.append(total / norm)
    n = max(1, -(-(len(y) - 256) // 128) + 1)
    y = np.pad(y, (0, max(0, n * 128 + 128 - len(y))))
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(mel(20), mel(4000), 34)]
    mels, level = [], []
    for i in range(n):
        frame = y[128 * i : 128 * i + 256] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256))
        power = np.abs(np.fft.fft(frame)[:129]) ** 2
        f = np.arange(129) * 8000 / 256
        tri = lambda k: np.clip(np.minimum((f - edges[k]) / (edges[k + 1] - edges[k]), (edges[k + 2] - f) / (edges[k + 2] - edges[k + 1])), 0, None)  # noqa: B023, E731
        mels.append([np.log(power @ tri(k) + 1e-6) for k in range(32)])
        level.append(10 * np.log10((frame**2).mean() + 1e-9))
    middle, spans, open_ = np.median(level), [], None
    for i, v in enumerate([*level, -1e9]):
        if open_ is None and v >= middle + audio.RISE:
            open_ = i
        elif open_ is not None and v <= middle - audio.FALL:
            spans.append((open_, i))
            open_ = None
    mels = np.array(mels)
    bins = [[mels[a + k * (b - a) // 4 : max(a + k * (b - a) // 4 + 1, a + (k + 1) * (b - a) // 4)].mean(axis=0) for k in range(4)] for a, b in spans]
    return np.array(spans).reshape(-1, 2) * 128 / 8000, np.array(bins).reshape(-1, 4, 32)


def test_audio_features_have_spans_and_fixed_tensors(spark, docs):
    files = audio.tensor_files(audio.media_table(docs, scratch(spark, "m")), scratch(spark, "tensors")).collect()
    texts, checked = dict(docs.select("doc_id", "text").collect()), 0
    for f in files:
        with pa.memory_map(f.segments.removeprefix("file:").replace("///", "/")) as m:
            t = pa.ipc.open_file(m).read_all()
        assert t.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float16(), [audio.BINS, audio.MELS]) and t.num_rows == f.n_segments
        got = defaultdict(list)
        for doc, a, b, tensor in zip(t["doc_id"].to_pylist(), t["start_s"].to_pylist(), t["end_s"].to_pylist(), t["tensor"].combine_chunks().to_numpy_ndarray()):
            got[doc].append((a, b, tensor))
        for doc in [d for d in got if 100 < len(texts[d]) < 1500 and d != 3][:4]:
            spans, tensors = plain_features(texts[doc])
            assert np.allclose([(a, b) for a, b, _ in got[doc]], spans, atol=1e-5)
            assert np.abs(np.array([x for _, _, x in got[doc]], float) - tensors).max() < 0.03
            checked += 1
    assert checked > 2 and sum(f.n_docs for f in files) == docs.count()


def test_resampler_keeps_a_low_tone_and_drops_a_high_one():
    t = np.arange(192 * 40)
    tone = lambda f: np.round(128 + 100 * np.sin(2 * np.pi * f * t / audio.RATE)).astype(np.uint8)
    low, high = audio.resample(tone(500)), audio.resample(tone(5500))
    want = 100 / 128 * np.sin(2 * np.pi * 500 * np.arange(len(low)) / (audio.RATE * 2 / 3))
    assert np.abs(low - want)[50:-50].max() < 0.02 and np.abs(high)[50:-50].max() < 0.05
    assert audio.hysteresis(np.array([0, 0, 2, 0.8, 0.8, -1, 0.9, 0, 0.0])).tolist() == [[2, 5]]


PAGES = [
    ("<nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><article><h1>A  title &amp; more</h1><p>One\n two&nbsp;three.<p><b>Four<br>five. It goes on for a while here.</b></article><footer>&copy; us</footer>", "A title & more\n\nOne two three.\n\nFour five. It goes on for a while here."),
    ("<body><div class='cookie-notice'><p>We use cookies.</p></div><div id=content><h1>Title of it</h1><p>Some text that is long enough to be read.</p><div class=\"ad\">Buy now.</div><p>More of the text follows here, as it must.</p></div><section class='comments'><div class='comment'><p>First to say this.</p></div></section>", "Title of it\n\nSome text that is long enough to be read.\n\nMore of the text follows here, as it must."),
    ("<script>if (a < b) document.write('<p>no</p>')</script><style>p{}</style><main><p>Only this sentence is text here.</p></main><form><label>Mail</label><button>Go</button></form><aside class=sidebar><h3>Related</h3><ul><li><a href=z>Other</a></ul></aside>", "Only this sentence is text here."),
    ("", ""), (None, ""), ("<p", ""), ("<!-- only -->", ""),
]


def test_html_text(spark):
    rows = [(i, f"http://x/{i}", h, "t") for i, (h, _) in enumerate(PAGES)]
    pages = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string, text string")
    got = html_crf.extract(pages).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert (r.text, r.n_chars) == (PAGES[r.page_id][1], len(PAGES[r.page_id][1]))
    assert html_crf.extract(pages.limit(0)).count() == 0


def test_references_end_at_tags_and_unseen_elements_are_left_out():
    blocks = lambda page: [b.text for b in html_crf.leaf_blocks(page)]
    assert blocks("<p>a &am<b>p;</b> b &amp; c&#39;s<!-- x --> d</p>") == ["a &amp; b & c's d"]
    assert blocks("<p>one</p><noscript><p>turn it on</p></noscript><iframe><p>x</p></iframe>two") == ["one", "two"]
    assert blocks("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]


def test_deep_pages_take_memory_in_their_length():
    extractor = html_crf.Extractor(html_crf.trained_field())
    for page in ("<div>x" * 40_000, "<div class='a b'>x</b></i>" * 10_000, "<p>" + "word " * 100_000, "<a " + "x='y' " * 40_000):
        began = time.perf_counter()
        tracemalloc.start()
        extractor.main_text(page)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 600 * len(page) and time.perf_counter() - began < 120


def test_crf_on_held_out_pages():
    made, right, total = html_crf.trained_field(), 0, 0
    extractor = html_crf.Extractor(made)
    for blocks, labels in html_crf.labelled_pages(60, seed=99):
        got = made.decode(np.array([extractor._score(b) for b in blocks]))
        right, total = right + sum(a == b for a, b in zip(got, labels)), total + len(labels)
    assert right / total > 0.97


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    f = html_crf.Field(np.zeros((1, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    for n in (1, 2, 7):
        s = rng.normal(size=(n, 2))
        value = lambda p: f.first[p[0]] + sum(s[i, l] for i, l in enumerate(p)) + sum(f.step[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        paths = [[k >> i & 1 for i in range(n)] for k in range(2**n)]
        assert value(f.decode(s)) == pytest.approx(max(map(value, paths)))


def test_crf_marginals_sum_over_all_paths():
    rng = np.random.default_rng(2)
    s, step, first = rng.normal(size=(1, 4, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    live = np.array([[True, True, True, False]])
    p, joint = html_crf._marginals(s, step, first, live)
    paths = [[k >> i & 1 for i in range(3)] for k in range(8)]
    w = np.exp([first[q[0]] + sum(s[0, i, l] for i, l in enumerate(q)) + step[q[0], q[1]] + step[q[1], q[2]] for q in paths])
    for i in range(3):
        assert p[0, i, 1] == pytest.approx(sum(x for x, q in zip(w, paths) if q[i]) / w.sum())
    assert joint[0, 1, 0, 1] == pytest.approx(sum(x for x, q in zip(w, paths) if q[1:] == [0, 1]) / w.sum())
    assert not joint[0, 2].any()


def greedy(vocabulary, word):
    n = 0
    while word:
        k = next(k for k in range(len(word), 0, -1) if word[:k] in vocabulary or k == 1)
        word, n = word[k:], n + 1
    return n


def test_longest_match_automaton():
    rng = np.random.default_rng(3)
    for _ in range(30):
        vocabulary = {bytes(rng.integers(97, 100, rng.integers(1, 7)).astype(np.uint8)) for _ in range(12)}
        automaton = token_counts.LongestMatch(vocabulary)
        for _ in range(60):
            word = bytes(rng.integers(97, 101, rng.integers(0, 20)).astype(np.uint8))
            assert automaton.count(word) == greedy(vocabulary, word)


def test_token_counts(docs, none):
    vocabulary = set(token_counts.byte_level_vocabulary(BYTE_BPE))
    texts = dict(docs.select("doc_id", "text").collect())
    rows = token_counts.count_tokens(docs, BYTE_BPE).collect()
    assert len(rows) == docs.count()
    for r in rows:
        words = Counter((texts[r.doc_id] or "").encode().split())
        assert (r.n_words, r.n_tokens) == (words.total(), sum(greedy(vocabulary, b" " + w) * k for w, k in words.items()))
    assert token_counts.count_tokens(none, BYTE_BPE).count() == 0


@pytest.fixture(scope="module")
def toxic(spark):
    rng = np.random.default_rng(4)
    plain = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        words, bad = list(rng.choice(plain, 40)), i % 4 == 0
        if bad:
            words[7] = "zzqx" + str(rng.choice(plain))
        rows.append((i, " ".join(words), None, None, None, 1, "r", "f"))
        labels.append((i, int(i % 3 > 0), int(bad)))
    rows += [(400, None, None, None, None, 1, "r", "f"), (401, "", None, None, None, 1, "r", "f"), rows[0]]
    labels += [(1, None, 0), (2, 1, None), (9999, 1, 1)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_chain(spark, toxic, none):
    docs, labels = toxic
    chain = toxicity.train(docs, labels.where("doc_id < 200 or doc_id > 9000"))
    rows = toxicity.score(docs, chain).collect()
    assert len(rows) == docs.count()
    held_out = [r for r in rows if 200 <= r.doc_id < 400]
    assert sum(r.toxic == (r.doc_id % 4 == 0) for r in held_out) / len(held_out) > 0.97
    assert [len(m.dense) for m in chain.models] == [toxicity.N_DENSE, toxicity.N_DENSE + 1]
    clashing = docs.withColumn("toxic", docs.doc_id).withColumn("p_toxic", docs.text)
    kept = toxicity.drop_toxic(clashing, labels)
    assert kept.columns == clashing.columns and {r.doc_id for r in kept.collect()} >= {i for i in range(400) if i % 4}
    assert toxicity.score(none, chain).count() == 0
    often = docs.where("doc_id % 4 = 0").withColumn("times", F.explode(F.sequence(F.lit(1), F.lit(30)))).drop("times").unionByName(docs.where("doc_id % 4 > 0"))
    same = toxicity.train(often, labels.where("doc_id < 200 or doc_id > 9000"))
    assert all((a.weights == b.weights).all() for a, b in zip(same.models, chain.models))
    untaught = toxicity.train(docs, labels.limit(0))
    assert not any(r.toxic for r in toxicity.score(docs, untaught).collect())


def test_toxicity_is_not_fitted_on_the_driver(spark, toxic, monkeypatch):
    """The features of thousands of texts, and what the fit makes of them, stay out of the driver's memory."""
    docs, labels = toxic
    want = [m.kept.tolist() for m in toxicity.train(docs, labels).models]
    monkeypatch.setattr(toxicity, "fit_chain", None)
    assert want[1] and [m.kept.tolist() for m in toxicity.train(docs, labels).models] == want


def test_packing(spark, docs, none):
    cut = packing.pieces(docs, BYTE_BPE, end_id=0, capacity=256)
    rows = packing.pack(cut, capacity=256).collect()
    made, texts = defaultdict(list), docs.select("doc_id", "text").collect()
    for r in rows:
        made[r.sequence_id].append((r.offset, r.length))
    for parts in made.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    want = Counter()
    for doc, text in texts:
        ids = ids_of(BYTE_BPE, text, 0)
        head = len(ids) % 256 or 256
        cuts = [0, *range(head, len(ids) + 1, 256)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert len(made) <= 1.02 * sum(r.length for r in rows) / 256 + 2
    assert packing.pack(packing.pieces(none, BYTE_BPE, end_id=0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plans_place_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    histogram = dict(Counter(rng.choice([1, 2, 3, 17, 64, 65, 100, 120, 128], rng.integers(1, 400)).tolist()))
    p = packing.plan(histogram, 128)
    used, lengths = defaultdict(set), sorted(histogram)
    for k in lengths:
        for rank in range(histogram[k]):
            at = p.length_start[k] + rank
            slot = np.searchsorted(p.first, at, side="right") - 1
            within = at - p.first[slot]
            start = int(p.offset[slot] + within % p.mult[slot] * k)
            here = set(range(start, start + k))
            seq = int(p.base[slot] + within // p.mult[slot])
            assert not here & used[seq] and start + k <= 128
            used[seq] |= here
    assert all(v == set(range(len(v))) for v in used.values()) and len(used) == p.n_sequences


def test_non_negative_fit_uses_up_the_histogram():
    lengths = np.arange(1, 65)
    rows, uses = packing.patterns(lengths, 64)
    sums = (np.where(rows < 0, 0, lengths[np.maximum(rows, 0)]) * uses).sum(axis=1)
    made = Counter(tuple(sorted((int(i), int(k)) for i, k in zip(r, u) if k)) for r, u in zip(rows, uses))
    assert (sums == 64).all() and max(Counter(tuple(sorted(sum(([i] * k for i, k in p), []))) for p in made).values()) == 1
    pieces = lambda least, left, n: sum(pieces(a, left - a, n - 1) for a in range(least, left + 1)) + (left == 0) if n else left == 0
    few = sum(sum(k for _, k in p) <= 3 for p in made)
    assert few == pieces(1, 64, 3)
    counts = np.bincount(rows[::7].ravel() + 1, uses[::7].ravel(), minlength=65)[1:].astype(float)
    x = packing.fit(rows, uses, counts)
    used = np.bincount(rows.ravel() + 1, (x[:, None] * uses).ravel(), 65)[1:]
    assert (x >= 0).all() and np.abs(used - counts).max() < 0.05 * counts.max()


def test_short_pieces_have_patterns():
    p = packing.plan({100: 900, 50: 31, 7: 13}, 1000)
    assert p.n_sequences == -(-(900 * 100 + 31 * 50 + 13 * 7) // 1000) and p.residual < 5000


@pytest.mark.parametrize("tree_rows", [20_000, 64, 16])
def test_mtree_top_k(spark, tree_rows):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 6)).astype(np.float32)
    v[100:180] = v[100]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    rows += [(400, None, 0), (401, [1.0, None, 2.0, 0.0, 0.0, 0.0], 0), (402, [float("nan")] * 6, 0), (403, [float("inf")] * 6, 0), (None, [1.0] * 6, 0), rows[7]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    vectors = mtree.integer_vectors(table)
    got = defaultdict(list)
    for r in mtree.top_k(vectors, vectors.where("vec_id % 20 = 0"), scratch(spark, "x"), k=5, tree_rows=tree_rows).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ids = np.append(np.arange(400), 7)
    x = np.floor(256 * v.astype(float)).astype(int)[ids]
    assert sorted(got) == list(range(0, 400, 20))
    for q, found in got.items():
        scores = x @ x[q]
        best = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if i != q)[:5]
        assert sorted(found) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert mtree.top_k(vectors.limit(0), vectors.limit(0), scratch(spark, "x")).count() == 0
    few = vectors.where("vec_id < 3")
    assert mtree.top_k(few, few.where("vec_id = 0"), scratch(spark, "x")).count() == 2


def test_mtree_with_shared_ids_long_queries_and_large_numbers(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 2.0]), (3, [-1.0, 0.5])]
    vectors = mtree.integer_vectors(spark.createDataFrame(rows, schema))
    got = sorted(map(tuple, mtree.top_k(vectors, vectors.where("vec_id = 50"), scratch(spark, "x"), k=2).collect()))
    scale = 256 * 256
    assert got == sorted([(50, 1, 1, 3 * scale), (50, 2, 2, scale), (50, 1, 2, 2 * scale), (50, 2, 1, scale)])
    long = spark.createDataFrame([(9, [1e13, 1e13])], schema)
    small = mtree.top_k(vectors, mtree.integer_vectors(long), scratch(spark, "x"), k=1).collect()
    assert [(r.vec_id, r.score) for r in small] == [(1, 4 * 256 * int(256 * np.float64(np.float32(1e13))))]
    for bad in ([1e30, 0.0], [1e10, 0.0]):
        with pytest.raises(Exception, match="too large|does not fit"):
            over = mtree.integer_vectors(spark.createDataFrame([(1, bad)], schema))
            mtree.top_k(over, over, scratch(spark, "x")).collect()


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.partition("://")[2]
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), raw), re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


def test_url_rules(spark):
    hosts = ["example.com", "www.Example.COM", "xexample.com", "net", "a.example.net", "example.net", "org", "b.c.org", "com.", "", "com", "example.com:80", "."]
    paths = ["/en/7", "/en/71?q", "/en/", "/de/8#x", "/de/", "/es/9", "", "/EN/", "?/en/", "/en"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "http://", "a://b://com/en/", "x" * 5000 + "://com/en/"]
    pages = spark.createDataFrame([(i, u, "p", "h") for i, u in enumerate(urls)] + [(0, urls[0], "p", "h")], "page_id long, url string, path string, host string")
    rows = url_filter.judge(pages, RULES).collect()
    assert len(rows) == len(urls) + 1
    assert [tuple(r)[1:] for r in rows] == [judged(urls[r.page_id]) for r in rows]
    assert url_filter.judge(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, []).collect()} == {"allow"}


def test_cascade_is_exact_over_the_universe():
    rng = np.random.default_rng(7)
    keys = np.unique(rng.integers(0, 2**63, 30_000).astype(np.uint64))
    rng.shuffle(keys)
    listed, others = keys[:500], keys[500:]
    cascade = url_filter.Cascade(url_filter.Bloom(listed, 0.3, 1), listed, others)
    assert len(cascade.levels) > 2
    assert cascade.holds(listed).all() and not cascade.holds(others).any()


def plain_fingerprint(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = {d: d for d in fps}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {d: find(d) for d in ids}


def test_near_duplicates(spark, docs, none):
    fps = {i: plain_fingerprint(t) for i, t in docs.select("doc_id", "text").collect()}
    want = plain_components(fps)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    assert all((int(r.fingerprint, 16), r.component_id) == (fps[r.doc_id], want[r.doc_id]) for r in rows)
    assert simhash.near_duplicates(none).count() == 0


def test_near_duplicates_keep_rows_without_or_with_the_same_doc_id(spark):
    a, b, c = ("alpha beta gamma delta", "one two three four", "lost row without a copy")
    rows = [(1, a), (1, b), (2, b), (2, b), (None, c), (None, a), (None, None), (7, ""), (None, "\n")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {a: 1, b: 1, c: None, None: 7, "": 7, "\n": 7}
    assert Counter((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in found) == Counter((d, plain_fingerprint(t), want[t]) for d, t in rows)


def test_hubs_are_salted(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HUB", 3)
    star = [(0, i) for i in range(1, 40)] + [(40, 41), (41, 42)]
    edges = spark.createDataFrame(star, "a long, b long")
    nodes = spark.createDataFrame([(i, 100 - i) for i in range(50)], "node long, rank long")
    got = {r.node: r.root for r in simhash.components(edges, nodes).collect()}
    assert got == {i: 61 if i < 40 else 58 for i in range(43)}
    assert simhash.components(edges.limit(0), nodes).count() == 0


def test_salted_rank_of_alike_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "LOT", 4)
    rows = [("k", None, 30)] * 21 + [("k", i, 30) for i in range(9)] + [("l", 1, 1)]
    ranked = shared.salted_rank(spark.createDataFrame(rows, "key string, id long, n long"), ["key"], "n", ["id"], 1).collect()
    assert Counter((r.key, r.id, r.n) for r in ranked) == Counter(rows)
    assert sorted(r["rank"] for r in ranked if r.key == "k") == list(range(30))


@pytest.mark.parametrize("seed", range(3))
def test_links_and_components_of_planted_fingerprints(spark, seed):
    rng = np.random.default_rng(seed)
    made = {int(x) for x in rng.integers(0, 2**63, 40)} | {0, 2**64 - 1, 1 << 63}
    for start in list(made)[:12]:
        for _ in range(8):
            for _ in range(int(rng.integers(1, 4))):
                start ^= 1 << int(rng.integers(0, 64))
            made.add(start)
    fps = sorted(made)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(s,) for s in signed], "fp long")
    links = simhash.links(table)
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2}
    assert {(r.a, r.b) for r in links.collect()} == want and links.count() == len(want)
    order = {s: i for i, s in enumerate(signed)}
    nodes = spark.createDataFrame([(s, i) for s, i in order.items()], "node long, rank long")
    roots = plain_components(dict(enumerate(fps)))
    got = {order[r.node]: r.root for r in simhash.components(links, nodes).collect()}
    assert all(roots[i] == got.get(i, i) for i in order.values())
