"""Operators 11 to 13 against the libraries and brute force, and their defined cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from curatrix.llm import alignment, collocations, queries, token_files, units
from curatrix.llm.common import table

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A_SPEC = open(A_PATH, encoding="utf-8").read()
B_MODEL = open(B_PATH, "rb").read()
CASES = ["a  b ", " lead", "trail ", "x\n y\n\n  z", "tab\t and 　wide", "say <|endoftext|> and <s>x</s>", "under▁score", "it's 12,345.67 l’été\x00", "\x1c \x85 x", "ﬁ ½ Ω", "  ", " ", "\n", "<|endoftext|>"]


def rows(df):
    return [r.asDict() for r in df.collect()]


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def key(r):
    return tuple((v is not None, v) for v in r)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(100 + i, t) for i, t in enumerate(CASES)], "doc_id long, text string").repartition(3)


def which_docs(request, spark, which):
    docs = request.getfixturevalue(which)
    return table(spark, docs, "documents") if isinstance(docs, str) else docs


# --- operator 11


def brute_alignment(docs):
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    value = units.byte_values()
    found = []
    for doc, text in docs:
        raw = (" " + (text or "")).encode()
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        wa = [bytes(value[c] for c in a.id_to_token(i)) for i in ia]
        wb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ib)]
        if not text or b"".join(wa) != raw or b"".join(wb) != raw:
            found.append((doc, [], [], [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(w) for w in wa]).tolist(), np.cumsum([len(w) for w in wb]).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        links = [(x, y) for e in common for x, p in zip(ia, ends_a) if p == e for y, q in zip(ib, ends_b) if q == e] if len(raw) < 3000 else [(ia[ends_a.index(e)], ib[ends_b.index(e)]) for e in common]
        groups, lo = [], 0
        for e in common:
            groups.append(",".join(str(x) for x, p in zip(ia, ends_a) if lo < p <= e) + "|" + ",".join(str(y) for y, q in zip(ib, ends_b) if lo < q <= e) if len(raw) < 3000 else None)
            lo = e
        if len(raw) >= 3000:
            groups, i, j = [], 0, 0
            for e in common:
                i2, j2 = ends_a.index(e) + 1, ends_b.index(e) + 1
                groups.append(",".join(map(str, ia[i:i2])) + "|" + ",".join(map(str, ib[j:j2])))
                i, j = i2, j2
        found.append((doc, ia, ib, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(x for f in found for x in f[3])
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [(doc, len(ia), len(ib), len(links), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), h) for doc, ia, ib, links, h in found], count


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def shortened(docs):
    return docs if docs.count() < 100 else docs.where("length(text) < 4000 OR text IS NULL")


@pytest.mark.parametrize("which", ["tricky", "small", "nothing", "odd"])
def test_alignment_report(spark, request, which):
    docs = shortened(which_docs(request, spark, which).where("text IS NULL OR length(text) < 100000"))
    got = sorted((tuple(r[c] for c in NAMES) for r in rows(alignment.alignment_report(docs, A_SPEC, B_MODEL))), key=key)
    assert got == sorted(brute_alignment(texts_of(docs))[0], key=key)


def test_alignment_pairs_and_partial_bitmaps(spark, small, monkeypatch):
    monkeypatch.setattr(alignment, "HELD", 300)
    docs = table(spark, small, "documents").where("length(text) < 2000").repartition(2)
    parts = alignment.stored(alignment.aligned_parts(docs, A_SPEC, B_MODEL), "t")
    found = alignment.stored(alignment.postings(parts), "t")
    key_ = ["a", "b", "plane", "container"]
    partial, whole = parts.where("plane IS NOT NULL").count(), found.count()
    assert partial > whole == found.select(*key_).distinct().count()  # partial bitmaps were merged
    texts = texts_of(docs)
    want, count = brute_alignment(texts)
    got = {(r["a"], r["b"]): r for r in rows(alignment.pair_counts(found))}
    assert {k: r["links"] for k, r in got.items()} == count
    in_docs = Counter(x for t in texts for x in brute_alignment([t])[1])
    assert {k: r["docs"] for k, r in got.items()} == in_docs
    out = alignment.returned(found, alignment.pair_counts(found))
    assert sum(r["count_sum"] for r in rows(out)) == sum(w[6] for w in want)


def test_bitmaps():
    rng = np.random.default_rng(1)
    for n in (1, 5, alignment.DENSE - 1, alignment.DENSE, 9000):
        x, y = (np.sort(rng.choice(alignment.DOCS, n, replace=False)) for _ in "ab")
        (a,), (b,) = (alignment.compressed((7 << alignment.CONTAINER) | z)[2] for z in (x, y))
        assert alignment.members(a).tolist() == x.tolist() and alignment.popcount(a) == n
        both = alignment.merged([a, b])
        assert alignment.members(both).tolist() == sorted(set(x.tolist()) | set(y.tolist())) and alignment.popcount(both) == len(set(x.tolist()) | set(y.tolist()))


def test_units_spell_the_text():
    for t in [*CASES, "one two  three\n four "]:
        first, rest = units.units(t)
        assert " ".join([first, *rest]) == t


def test_groups_as_text(spark):
    docs = spark.createDataFrame([(1, "hello there"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["groups"] for r in rows(alignment.aligned_groups(docs, A_SPEC, B_MODEL))}
    assert got[2] == "" and got[1].count("|") == got[1].count(";") + 1


# --- operator 12


def brute_files(docs):
    tool = Tokenizer.from_file(A_PATH)
    out, start = [], 0
    for doc, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tool.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("which", ["tricky", "small", "nothing", "odd"])
def test_token_file_report(spark, request, which):
    docs = which_docs(request, spark, which)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(token_files.file_report(docs, A_SPEC))), key=key)
    assert got == sorted(brute_files(texts_of(docs)), key=key)


def test_token_files_by_key(spark, small):
    docs = table(spark, small, "documents").repartition(5)
    files = token_files.write_token_files(docs, A_SPEC, shard_bytes=60_000, bucket_keys=40)
    assert len(files.shards) > 3 and len(files.index) > 3
    again = token_files.TokenFiles.open(files.path)
    tool = Tokenizer.from_file(A_PATH)
    for doc, text in texts_of(docs)[::17]:
        (ids,) = again.get(doc)
        assert ids.tolist() == [*tool.encode(text or "", add_special_tokens=False).ids, 0]
    assert again.get(-5) == [] and again.get(10**15) == []
    asked = spark.createDataFrame([(3,), (3,), (10**12,), (None,)], "doc_id long")
    got = rows(token_files.read_token_files(spark, files.path, asked))
    assert [(r["doc_id"], r["ids"]) for r in got] == [(3, again.get(3)[0].tolist())]


def test_keys_that_run_over_shards(spark, monkeypatch):
    monkeypatch.setattr(token_files, "READ_IDS", 50)
    docs = spark.createDataFrame([(7, f"copy number {i % 3} " * 9) for i in range(300)] + [(None, "none at all " * 20)] * 40 + [(9, "after"), (1, "before")], "doc_id long, text string").repartition(4)
    files = token_files.write_token_files(docs, A_SPEC, shard_bytes=4000, bucket_keys=2)
    assert len({s["part"] for s in files.shards}) > 4
    got = rows(token_files.lookup(docs.select("doc_id"), files, "ids_crc32"))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((d, n, c) for d, _, n, c in brute_files(texts_of(docs)))
    spans = sorted((r["start"], r["n_tokens"], r["doc_id"] or 0) for r in got)
    assert spans[0][0] == 0 and all(a[0] + a[1] == b[0] and a[2] <= b[2] for a, b in zip(spans, spans[1:]))
    assert len(files.get(7)) == 300 and len(files.get(None)) == 40


def test_minimal_perfect_hash():
    keys = token_files.fingerprint(np.arange(-3000, 5000) * 977)
    made = token_files.MinimalPerfectHash.of(keys)
    assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))
    entries = np.zeros(len(keys), token_files.ENTRY)
    entries["fingerprint"], entries["offset"] = keys, np.arange(len(keys))
    index = token_files.IndexFile.read(token_files.IndexFile.of(entries).bytes())
    found, at = index.find(keys[::-1])
    assert found.all() and at["offset"].tolist() == list(range(len(keys)))[::-1]
    assert not index.find(token_files.fingerprint(np.arange(10**9, 10**9 + 5000)))[0].any()


# --- operator 13


def brute_collocations(docs, support, top):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang or "und"] += len(words)
            for i in range(len(words)):
                for k in range(1, min(5, len(words) - i) + 1):
                    f[(lang or "und", *words[i : i + k])] += 1
    held = {p: a for p, a in f.items() if len(p) > 2 and a >= support}
    inside = defaultdict(int)
    for (lang, *words), a in held.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                part = (lang, *words[i : i + size])
                inside[part] = max(inside[part], a)
    out = defaultdict(list)
    for (lang, *words), a in held.items():
        if 100 * inside[(lang, *words)] >= 100 * a:
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k, f[(lang, *words[:k])], f[(lang, *words[k:])]) for k in range(1, len(words)))
        out[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, some in out.items() for i, (s, a, p, left, right) in enumerate(sorted(some)[:top])]


@pytest.mark.parametrize("which, support, top", [("tricky", 2, 2000), ("tricky", 1, 50), ("small", 5, 2000), ("small", 40, 10), ("nothing", 2, 5)])
def test_collocations(spark, request, which, support, top):
    docs = which_docs(request, spark, which)
    got = sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows(collocations.collocations(docs, support, top)))
    assert got == sorted(brute_collocations([(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()], support, top))


def test_few_counters_change_nothing(spark, small):
    texts = collocations.by_language(table(spark, small, "documents"))
    want = None
    for bits in (3, 12, 22):
        marks = collocations.frequent_chains(texts, 20, bits)
        got = sorted(map(tuple, collocations.phrase_counts(collocations.lead_windows(texts, marks), 20).collect()))
        assert want is None or got == want
        want = got


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**15
    phrases = spark.createDataFrame([("x", 0, "", big * 1000), ("x", 1, "a", big), ("x", 1, "b", big + 7), ("x", 2, "a b", big - 1)], "lang string, m int, phrase string, f long")
    (r,) = rows(collocations.cuts(phrases))
    assert r["score"] == 1000 * (big - 1) * (big * 1000) // (big * (big + 7))


def test_registered():
    assert {"op11_alignment", "op12_token_files", "op13_collocations"} <= set(queries.QUERIES)
