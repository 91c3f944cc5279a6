"""Operators on documents against brute force, and their defined cases."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from curatrix.llm import bpe, langid, neardup, ngram_lm, packing, quality, queries, repeats, secrets
from curatrix.llm.common import RangeHash, table


def rows(df):
    return [r.asDict() for r in df.collect()]


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# --- operator 5


KIND = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m.group(2)) >= 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 16),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 32),
}


def fixed_spans(text):
    found = [(m.start(), i, m.end(), k) for i, (k, (p, ok)) in enumerate(KIND.items()) for m in p.finditer(text) if ok(m)]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


@pytest.mark.parametrize("which", ["tricky", "small", "nothing"])
def test_secret_report(spark, request, which):
    docs = request.getfixturevalue(which)
    docs = table(spark, docs, "documents") if isinstance(docs, str) else docs
    got = sorted((r["doc_id"] or -1, r["base_sha256"], r["n_assign"] + r["n_access"] + r["n_hex"]) for r in rows(secrets.scan_report(docs)))
    want = sorted((d or -1, hashlib.sha256(",".join(fixed_spans(t)).encode()).hexdigest(), len(fixed_spans(t))) for d, t in texts_of(docs))
    assert got == want


def test_secret_positions_and_entropy(spark):
    cases = {
        1: "é token: abc, then password=tok:secret12 and API_KEY = 'zzzzzzzz9'",
        2: "key f3Kq9Zt1Lw8Xv2Bn7Mc4 tail",  # high entropy, no fixed kind
        3: "id 123e4567-e89b-12d3-a456-426614174000 and state-of-the-art-2024-edition and aaaaaaaaaaaaaaaaaaaaaaaa1",
        4: "x1EXAMPLEf3Kq9Zt1Lw8Xv2Bn7",
        5: "plainwordswithoutanydigitsatall12",
    }
    docs = spark.createDataFrame(list(cases.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in rows(secrets.scan_report(docs))}
    assert got[1] == ",".join(fixed_spans(cases[1]))
    assert got[2] == "entropy:4:24"
    assert got[3] == "" and got[4] == "" and got[5] == ""
    found = secrets.secret_spans(docs)
    clean = {r["doc_id"]: r["t"] for r in rows(found.select("doc_id", secrets.redacted(found["text"], found["secret_spans"]).alias("t")))}
    assert clean[2] == "key [SECRET] tail" and clean[3] == cases[3]


def entropy_range(word, rule):
    bits = rule.hex_bits if re.fullmatch("[0-9a-f]+|[0-9A-F]+", word) else rule.alnum_bits if re.fullmatch("[A-Za-z0-9]+", word) else rule.base64_bits
    hits = [i for i in range(len(word) - rule.window + 1) if -sum(c / rule.window * math.log2(c / rule.window) for c in Counter(word[i : i + rule.window]).values()) >= bits - 1e-9]
    return (hits[0], hits[-1] + rule.window) if hits else (-1, -1)


def test_incremental_entropy(spark):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdef0123456789" if i % 2 else "abcXYZ0189+/_-qwertyASDF"), rng.integers(20, 60))) for i in range(40)]
    words += [w[:25] + "a" * 25 + w[:25] for w in words[:10]]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    rule = secrets.EntropyRule()
    got = [(r["h"]["first"], r["h"]["last"]) for r in rows(df.select(secrets.hot_range(df["w"], rule).alias("h")))]
    assert sorted((a, b) for a, b in got) == sorted(entropy_range(w, rule) for w in words)


# --- operator 3


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def test_perfect_hash(codec):
    assert sorted(codec.hash.slot_of.tolist()) == list(range(len(codec.ranks)))


@pytest.mark.parametrize("which", ["tricky", "small", "nothing"])
def test_bpe_matches_the_library(spark, request, which, codec):
    tiktoken = pytest.importorskip("tiktoken")
    docs = request.getfixturevalue(which)
    docs = table(spark, docs, "documents") if isinstance(docs, str) else docs
    tool = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    want = []
    for d, t in texts_of(docs):
        ids = tool.encode_ordinary(t)
        want.append((d or -1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [(r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(bpe.round_trip_report(docs, codec))]
    assert sorted(got) == sorted(want)


def test_bpe_round_trip_columns(spark, codec, tricky):
    ids = bpe.encoded(tricky, codec)
    back = sorted((r["doc_id"] or -1, bytes(r["data"]).decode()) for r in rows(bpe.decoded(ids, codec)))
    assert back == sorted((d or -1, t) for d, t in texts_of(tricky))


# --- operator 4


@pytest.mark.parametrize("which", ["tricky", "small", "nothing"])
def test_packing(spark, request, which):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(which)
    docs = table(spark, docs, "documents") if isinstance(docs, str) else docs
    if which == "tricky":
        special = ["hello <|startoftext|> there", "a<|endoftext|>B C", "NOT <|ENDOFTEXT|> One", "É<|endoftext|>é"]
        docs = docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(special, 50)), "doc_id long, text string"))
    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    tool = Tokenizer.from_str(spec)
    got = pd.DataFrame(rows(packing.pack(docs, spec)), columns=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    want = []
    for d, t in texts_of(docs):
        ids = np.array([*tool.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want += [(-1 if d is None else d, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    seen = sorted((int(r.doc_id) if r.doc_id == r.doc_id and r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    assert seen == sorted(want)
    if not len(got):
        return
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all()
    assert ordered.groupby("sequence_id").length.sum().max() <= 4096
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 4096) + 1


def test_packing_words_are_the_librarys():
    """Latin letters with marks behind them go to the model piece by piece, all else to the library."""
    from tokenizers import Tokenizer

    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    rng, letters, marks = random.Random(4), "abzAZßÀÖØöøÿéÑÜ", "!&(/:@[`{~-_.,;<|>\""
    words = ["".join(rng.choices(letters, k=rng.randint(1, 7))) + "".join(rng.choices(marks, k=rng.randint(0, 3))) for _ in range(3000)]
    words += ["don't", "été's", "ªº", "µ", "×÷", "İı", "ſK", "é", "é́x", "x1y", "a\x1fb", "<|endoftext|>", "ab<|endoftext|>", "É<|endoftext|>!"]
    one, tool = packing.ChunkTokenizer(spec), Tokenizer.from_str(spec)
    assert one.simple
    for w in words:
        assert np.frombuffer(one.ids(w), "<u4").tolist() == tool.encode(w, add_special_tokens=False).ids, w
    for token in ("abc", "!!", "a!"):  # such special tokens can stand inside of words
        assert not packing.ChunkTokenizer(spec.replace("<|endoftext|>", token)).simple


def test_packing_remembers_a_bounded_share_of_a_worker():
    """Two full generations of 700 000 strings, in each of an executor's workers, were more than the pipeline leaves."""
    one = packing.ChunkTokenizer(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    a = [x + y for x in "abcdefghij" for y in "klmnopqrst"]
    for x in a[:90]:
        one.ids(" ".join(x + y + z for y in a for z in a))
    held = [sys.getsizeof(d) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items()) for d in (one.kept, one.kept.old)]
    assert len(one.kept.old) and sum(held) < 110e6


def test_plan_uses_exact_complements():
    counts = {6: 2, 4: 2, 5: 3, 3: 1, 2: 1, 1: 2, 10: 1}
    planned = packing.plan(counts, 10)
    used = Counter()
    for lengths, times in planned:
        assert sum(lengths) <= 10
        for x in lengths:
            used[x] += times
    assert used == counts
    assert sum(times for _, times in planned) == math.ceil(sum(k * v for k, v in counts.items()) / 10)


def test_plan_residuals_best_fit():
    assert sum(t for _, t in packing.plan({7: 3, 6: 3}, 10)) == 6
    assert sum(t for _, t in packing.plan({3: 9}, 10)) == 3


# --- operator 9


def repeats_by_hand(texts, width):
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_on_the_table(spark, small):
    docs = table(spark, small, "documents")
    pairs = texts_of(docs)
    want = dict(zip([d for d, _ in pairs], repeats_by_hand([t.encode() for _, t in pairs], 200), strict=True))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(repeats.removal_report(docs))}
    assert got == want


def test_repeats_in_many_forms(spark, monkeypatch):
    """Self-overlap, periodic text, passages shared in part, short width, small segments, runs and ranges."""
    for name, value in (("SEGMENT", 300), ("SORTED", 500), ("BLOCK", 40), ("RANGE", 60), ("LONGEST", 16), ("HASHES", 300)):
        monkeypatch.setattr(repeats, name, value)
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcd é"), n))
    shared = [word(60) for _ in range(5)]
    texts = ["ab" * 200, "a" * 100, word(500)]
    for i in range(40):
        parts = [word(int(rng.integers(0, 50))), shared[i % 5][int(rng.integers(0, 20)) :], word(10), shared[(i + 1) % 5][: int(rng.integers(20, 60))]]
        texts.append("".join(parts))
    texts += [texts[5], "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(repeats.removal_report(docs, 24, 8, 18))}
    assert got == dict(enumerate(repeats_by_hand([(t or "").encode() for t in texts], 24)))
    kept = {r["doc_id"]: r["text"] for r in rows(repeats.without_repeats(docs, 24, 8, 18))}
    assert kept[len(texts) - 1] == "" and len(kept) == len(texts)


def most_python_in_a_stage(frame):
    """The largest number of Python functions that one task of the frame's plan would run one after the other."""
    most = 0

    def within(node):
        nonlocal most
        name, kids = node.nodeName(), node.children()
        found = [within(kids.apply(i)) for i in range(kids.size())]
        n = (max if name == "Union" else sum)(found or [0]) + any(x in name for x in ("Python", "InArrow", "InPandas"))
        most = max(most, n)
        return 0 if "Exchange" in name else n

    within(frame._jdf.queryExecution().executedPlan())
    return most


def test_repeats_hold_one_python_worker_a_task(spark, small, monkeypatch):
    """Two in a stage would double the memory that the workers of an executor take."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        seen, plain = [], repeats.stored
        monkeypatch.setattr(repeats, "stored", lambda df, label: seen.append((label, most_python_in_a_stage(df))) or plain(df, label))
        docs = table(spark, small, "documents")
        seen += [("report", most_python_in_a_stage(repeats.removal_report(docs))), ("texts", most_python_in_a_stage(repeats.without_repeats(docs)))]
        assert len(seen) > 10 and max(n for _, n in seen) == 1, seen
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_loser_tree_orders_and_shares():
    rng = np.random.default_rng(1)
    streams = [sorted(bytes(rng.integers(97, 99, 6, dtype=np.uint8)) for _ in range(int(rng.integers(0, 9)))) for _ in range(7)]

    def stream(s):
        for k, x in enumerate(s):
            before = s[k - 1] if k else b""
            yield x, next((i for i in range(min(len(before), 6)) if before[i] != x[i]), min(len(before), 6)), None

    out = list(repeats.LoserTree([stream(s) for s in streams], 6))
    assert [x for x, _, _ in out] == sorted(x for s in streams for x in s)
    for (a, _, _), (b, shared, _) in zip(out, out[1:], strict=False):
        assert shared == next((i for i in range(6) if a[i] != b[i]), 6)


def test_repeats_defined_cases(tricky, nothing):
    got = repeats.without_repeats(tricky)
    assert got.columns == tricky.columns and got.count() == tricky.count()
    by = defaultdict(list)
    for r in rows(got):
        by[r["doc_id"]].append(r)
    assert [r["text"] for r in by[4]] == [""] and by[1][0]["text"] == "" and by[7][0]["text"] == "one"
    assert all(r["key"] == "clash" for found in by.values() for r in found)
    assert repeats.removal_report(nothing).count() == 0


# --- operator 6


def classes_by_hand(pairs, weights):
    hashing = RangeHash(61)
    vectors = {}
    for d, t in pairs:
        data = np.frombuffer(t.encode(), np.uint8)
        row, h = neardup.word_hashes(data, np.array([0, len(data)]), hashing)
        _, code, weight = weights.shingles(row, h, 1)
        vectors[d] = (code, weight)
    up = {d: d for d, _ in pairs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(pairs):
        for b, t in pairs[:i]:
            if s == t or neardup.similarity(vectors[a], vectors[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: find(d) for d, _ in pairs}


def test_near_duplicates_on_the_table(spark, small):
    docs = table(spark, small, "documents")
    weights = neardup.corpus_weights(neardup._with_node(docs).select(docs["text"]))
    assert {r["doc_id"]: r["class_id"] for r in rows(neardup.class_report(docs))} == classes_by_hand(texts_of(docs), weights)


def test_near_duplicates_in_chains_and_hot_groups(spark, monkeypatch):
    """Groups around one text whose copies are further from each other than from it, and chains of small steps."""
    monkeypatch.setattr(neardup, "SIDE", 4)
    rng = np.random.default_rng(5)
    draw = lambda n: [f"v{int(x)}" for x in rng.integers(0, 3000, n)]
    texts = []
    for _ in range(3):
        base = draw(200)
        for _ in range(25):
            copy = list(base)
            for at in rng.choice(200, int(rng.integers(1, 6)), replace=False):
                copy[at] = draw(1)[0]
            texts.append(" ".join(copy))
    step = draw(200)
    for k in range(12):
        step = [*step[:k * 8], *draw(3), *step[k * 8 + 3 :]]
        texts.append(" ".join(step))
    texts += [" ".join(draw(80)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    weights = neardup.corpus_weights(neardup._with_node(docs).select("text"))
    assert {r["doc_id"]: r["class_id"] for r in rows(neardup.class_report(docs))} == classes_by_hand(texts_of(docs), weights)


def test_weighted_samples_estimate_similarity():
    rng = np.random.default_rng(2)
    code = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    a, b = np.sort(code[:45]), np.sort(code[15:])
    wa, wb = rng.uniform(0.5, 3, 45), rng.uniform(0.5, 3, 45)
    for i, c in enumerate(a):
        if c in b and rng.random() < 0.7:
            wb[np.searchsorted(b, c)] = wa[i]
    draw = neardup.Sampler(2000)
    picks = draw.picks(np.repeat([0, 1], 45), np.concatenate([a, b]), np.concatenate([wa, wb]))
    assert abs((picks[0] == picks[1]).mean() - neardup.similarity((a, wa), (b, wb))) < 0.05


def test_near_duplicates_defined_cases(tricky, nothing):
    got = neardup.near_duplicates(tricky)
    assert got.count() == tricky.count() and set(got.columns) == set(tricky.columns) | {"class_size"}
    by = {r["doc_id"]: r for r in rows(got)}
    assert by[1]["kept"] and not by[2]["kept"] and by[2]["class_id"] == 1 and by[3]["class_id"] == 1 and by[13]["class_id"] == 1
    assert by[5]["class_id"] == 4 and by[6]["class_id"] == 6 and by[9]["class_size"] == 2 and by[None]["kept"]
    assert neardup.class_report(nothing).count() == 0


# --- operator 2


def lm_by_hand(pairs, held):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    token = {(d, t): [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(low)), " "] for d, t in pairs}
    count = Counter(w for d, t in pairs if not held(d) for w in token[d, t])
    n, v = sum(count.values()), len(count)
    return {d: (len(token[d, t]), sum(w in count for w in token[d, t]), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in token[d, t])) for d, t in pairs}


@pytest.mark.parametrize("which", ["tricky", "small", "nothing"])
def test_lm_counts_and_base(spark, request, which):
    docs = request.getfixturevalue(which)
    docs = table(spark, docs, "documents") if isinstance(docs, str) else docs
    held = lambda d: zlib.crc32(str(d).encode() if d is not None else b"") % 7 == 2
    want = lm_by_hand(texts_of(docs), held)
    got = rows(ngram_lm.score_report(docs))
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:3] and r["held_out"] == held(r["doc_id"])
        assert math.isclose(r["base_score"], want[r["doc_id"]][3], rel_tol=1e-9, abs_tol=1e-9) and r["score"] <= 1e-9
    if which == "small":
        assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def test_count_filter_levels(spark):
    rng = np.random.default_rng(4)
    words = [f"w{int(x)}" for x in rng.zipf(1.3, 3000) % 500]
    docs = spark.createDataFrame([(i, " ".join(words[i * 100 : i * 100 + 100])) for i in range(30)], "doc_id long, text string")
    blocks = docs.select("doc_id", "text", ngram_lm.F.lit(True).alias("train")).mapInArrow(ngram_lm._ngram_blocks(40, 1), "bucket int, codes binary, counts binary, n int")
    segments = blocks.groupBy("bucket").applyInArrow(ngram_lm._segment(1 << 20), "bucket int, bits long, lowest int, n long, data binary").toArrow().to_pylist()
    lm = ngram_lm.CountFilter(segments, 40, 1)
    pairs = Counter()
    for i in range(30):
        seq = [None, *[w.encode() for w in words[i * 100 : i * 100 + 100]], ngram_lm.END]
        pairs.update(zip(seq, seq[1:], strict=False))
    hashed = {w: ngram_lm.START if w is None else ngram_lm.word_hashes([w])[0] for p in pairs for w in p}
    code = ngram_lm.pair_codes(np.array([hashed[a] for a, _ in pairs]), np.array([hashed[b] for _, b in pairs])) >> np.uint64(24)
    got, want = lm.counts(code), np.array([2.0 ** math.floor(math.log2(c)) for c in pairs.values()])
    assert (got >= want).all() and (got == want).mean() > 0.99
    absent = lm.counts(rng.integers(0, 1 << 40, 20_000, dtype=np.uint64))
    assert (absent > 0).mean() < 0.01


@pytest.mark.parametrize("which", ["tricky", "small"])
def test_lm_scores_do_not_depend_on_what_fits_a_broadcast(spark, request, which):
    docs = request.getfixturevalue(which)
    docs = table(spark, docs, "documents") if isinstance(docs, str) else docs
    by_size = [sorted(map(tuple, ngram_lm.scores(docs, ngram_lm.remainder(7) != 2, most_bits=most).collect()), key=str) for most in (1 << 28, 1 << 10)]
    assert by_size[0] == by_size[1] and len(by_size[0]) == docs.count()


def test_lm_splits_each_text_once(monkeypatch):
    """The passes after the first read the numbered tokens of a chunk; the scores come from one sort of its codes."""
    split, plain = [], ngram_lm.tokens
    monkeypatch.setattr(ngram_lm, "tokens", lambda text: split.append(text) or plain(text))
    monkeypatch.setattr(ngram_lm, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("One", (), {"partitionId": lambda self: 0})())}))
    texts = ["a b a b c", "", "A  b\tc", "b"]
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t, "train": i != 3} for i, t in enumerate(texts)])
    chunk = pa.Table.from_batches(list(ngram_lm._cut(2)([batch]))).filter(pc.field("bucket") == -1)
    blocks = pa.Table.from_batches(list(ngram_lm._chunk_blocks(40, 1)(chunk.to_batches())))
    said = [{**r, "ngrams": True} for b in range(2) for r in ngram_lm._levels(40)(blocks.filter(pc.field("bucket") == b)).to_pylist()]
    words = pa.Table.from_batches(list(ngram_lm._cut(1)([batch]))).filter(pc.field("bucket") == 0)
    said += [{**r, "ngrams": False} for r in ngram_lm._answers(words).select(["chunk", "bucket", "counts", "n"]).slice(0, 1).to_pylist()]
    split.clear()
    got = ngram_lm._score(None, (12, 4, 0, 3), 1, 40, 0.1)(chunk, pa.Table.from_pylist(said))
    list(ngram_lm._chunk_blocks(40, 1)(chunk.to_batches()))
    assert not split
    assert got["n_tokens"].to_pylist() == [6, 1, 4, 2] and got["n_known"].to_pylist() == [6, 1, 4, 2]
    # the end alone: 3 of 12 training tokens end a text; one of the 3 documents starts with its end
    want = math.log10(0.9 * (1 - 1 / 14) * 4 / 16 + 0.1 * 1 / 3)
    assert math.isclose(got["score"].to_pylist()[1], want, rel_tol=1e-12)


# --- operators 8 and 10


def test_quality_held_out(spark, small):
    found = pd.DataFrame(rows(queries.op8_quality(spark, "/root/testdata/sf0.01"))).merge(table(spark, "/root/testdata/sf0.01", "labels").toPandas(), on="doc_id")
    held = found[found.held_out]
    assert ((held.score >= 0.5) == held.quality).mean() > 0.95 and found.score.between(0, 1).all()
    assert (found.predicted == (found.score >= 0.3)).all()


def test_quality_factors():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, len(quality.STATS)))
    cov = np.cov(rng.normal(size=(200, len(quality.STATS))).T) + np.eye(len(quality.STATS))
    mean, inv = np.zeros(len(quality.STATS)), np.linalg.inv(np.linalg.cholesky(cov))
    far = ((x @ inv.T) ** 2).sum(1)
    assert np.allclose(far, np.einsum("nd,de,ne->n", x, np.linalg.inv(cov), x))
    model = quality.Discriminant(mean - 9, mean + 9, (mean, mean + 1), (inv, inv), 0.0, 0.5)
    assert ((model.scores(np.vstack([mean, mean + 1])) > 0.5) == [False, True]).all()


def test_quality_defined_cases(spark, tricky, nothing):
    bad = spark.createDataFrame([(1, None, 0), (2, 1, 0), (2, 0, 0), (7, 5, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = rows(quality.quality_scores(tricky, bad))
    assert len(got) == tricky.count() and all(r["score"] == 0.5 and r["predicted"] == 1 for r in got)
    one = spark.createDataFrame([(i, 1, 0) for i in (1, 2, 3, 7, 9)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in rows(quality.quality_scores(tricky, one))} == {1.0}
    assert quality.quality_scores(nothing, one).count() == 0
    mixed = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 0), (6, 0, 0), (8, 0, 0), (14, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(tricky, mixed)
    assert set(quality.accepted(tricky, model).columns) == set(tricky.columns)


def test_language_held_out(spark, small):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = pd.DataFrame(rows(langid.language_report(docs))).merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (found[found.held_out].lang == found[found.held_out].lang_pred).mean() > 0.95


def test_language_gradients():
    net = langid.BiGru.drawn(["a", "b", "c"], 3, 6, 1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    rng = np.random.default_rng(0)
    x, y, mask = rng.integers(0, 256, (6, 4)), np.array([0, 1, 2, 1]), np.ones((6, 4))

    def loss():
        return -np.log(net.position_probabilities(x)[:, np.arange(4), y]).mean()

    grad = net.gradients(x, y, mask)
    for name in net.weights:
        flat, g = net.weights[name].reshape(-1), grad[name].reshape(-1)
        for at in np.argsort(-np.abs(g))[:3]:
            was = flat[at]
            flat[at] = was + 1e-3
            up = loss()
            flat[at] = was - 1e-3
            down = loss()
            flat[at] = was
            assert abs((up - down) / 2e-3 - g[at]) < 1e-3 + 0.02 * abs(g[at]), name


def test_language_defined_cases(tricky, nothing):
    got = {r["doc_id"]: r for r in rows(langid.language_report(tricky))}
    assert {got[d]["lang_pred"] for d in (4, 5, 6)} == {"und"} and got[4]["score"] == 0
    assert all(r["lang_pred"] in ("en", "de", "fr", "und") and 0 <= r["score"] <= 1 for r in got.values())
    assert langid.language_report(nothing).count() == 0
    unlabelled = tricky.withColumn("lang", langid.F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in rows(langid.language_report(unlabelled))} == {"und"}


def test_secrets_of_one_text_with_very_many_matches(spark):
    """Spans and the redacted text against a plain scan; 6 000 words in one text, spans that overlap and touch."""
    rnd = random.Random(4)
    words = ["token=aB3dE5gH7", "AKIA" + "Q7" * 8, "0123456789abcdef" * 2, "é plain", "secret: 0123456789abcdef0123456789abcdef,", "xK9vQ2mZ7pL4wT8rB1nY"]
    texts = [" ".join(rnd.choice(words) for _ in range(n)) for n in (0, 1, 255, 256, 257, 700, 6_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secrets.secret_spans(docs)
    for r in rows(found.select("text", "secret_spans", secrets.redacted(found["text"], found["secret_spans"]).alias("clean"))):
        spans, out, at = [(s["start"], s["end"], s["rank"]) for s in r["secret_spans"]], [], 0
        base = [(m.start(), m.end(), rank) for rank, (pattern, long_enough) in enumerate(KIND.values()) for m in pattern.finditer(r["text"]) if long_enough(m)]
        assert sorted(s for s in spans if s[2] < 3) == sorted(base)
        assert all(r["text"][s:e] == words[5] for s, e, k in spans if k == 3)
        assert sum(k == 3 for _, _, k in spans) == r["text"].count(words[5])
        for s, e, _ in spans:
            if s >= at:
                out += [r["text"][at:s], "[SECRET]"]
            at = max(at, e)
        assert r["clean"] == "".join(out) + r["text"][at:]


def test_open_groups_work_out_few_similarities(monkeypatch):
    """Texts of one size that share little are told apart by sums of weights, and links come out as by comparing all."""
    import zstandard

    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(40)]
    texts += [t.rsplit(" ", 2)[0] + " end" for t in texts[:10]] + ["", "one", "one two"]
    weights = neardup.Weights(np.zeros(0, np.uint64), np.zeros(0), len(texts))
    packed = [zstandard.compress(t.encode()) for t in texts]
    nodes = pa.table({"node": pa.array(range(len(texts)), pa.int64()), "root": pa.array(range(len(texts)), pa.int64()), "left": pa.array([True] * len(texts)), "packed": pa.array(packed, pa.binary())})
    calls, exact = [], neardup.similarity
    monkeypatch.setattr(neardup, "similarity", lambda a, b: calls.append(1) or exact(a, b))

    class Given:
        value = weights

    found = neardup._open_group(Given, 0.8)(nodes)
    assert {tuple(sorted(x)) for x in zip(*found.to_pydict().values(), strict=True)} == {(i, 40 + i) for i in range(10)}
    assert len(calls) < 100


def test_order_by_owner_and_words_in_shared_slots():
    rng = np.random.default_rng(4)
    owner, code = np.sort(rng.integers(0, 50, 5000)), rng.integers(0, 400, 5000).astype(np.uint64)
    order, plain = neardup._by_owner(owner, code, 50), np.lexsort((code, owner))
    assert np.array_equal(owner[order], owner[plain]) and np.array_equal(code[order], code[plain])
    words = np.unique(rng.integers(0, 1 << 62, 3000, dtype=np.uint64) // np.uint64(1 << 14) * np.uint64(1 << 14) + rng.integers(0, 700, 3000, dtype=np.uint64))
    weights = neardup.Weights(words, rng.integers(1, 100, len(words)).astype(float), 100)
    asked = np.concatenate([words, rng.integers(0, 1 << 62, 500, dtype=np.uint64)])
    at = np.minimum(np.searchsorted(weights.words, asked), len(weights.words) - 1)
    assert np.array_equal(weights.of(asked), np.where(weights.words[at] == asked, weights.idf[at], 2.0))


def test_statistics_of_many_texts_are_those_of_each():
    texts = ["", " ", "One two two.\n\nOne two two.", "Äh, naïve 1984 — x=y;", "a " * 500 + "b!"]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    together = quality.statistics(texts, raw)
    for i, t in enumerate(texts):
        words = t.split()
        assert np.array_equal(together[i], quality.statistics([t], [raw[i]])[0])
        assert together[i][0] == np.log1p(len(words)) and together[i][5] == np.log1p(np.mean([len(w) for w in words] or [0]))
        assert together[i][6] == np.log1p(np.std([len(w) for w in words] or [0]))


def test_only_texts_with_a_usable_label_are_measured(spark, monkeypatch):
    docs = spark.sql("SELECT id AS doc_id, concat('text ', id) AS text FROM range(200)")
    labels = spark.sql("SELECT id AS doc_id, CAST(id % 2 AS int) AS quality FROM range(200)")
    seen, before = [], quality.document_statistics
    monkeypatch.setattr(quality, "document_statistics", lambda df: seen.append(df.count()) or before(df))
    quality.learn(docs, labels)
    assert seen == [quality.training_labels(labels).count()]
