"""Language ID, byte-level BPE, the pipeline."""

import gc
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from kronika.llm import bpe, language_id, storage, texts

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = storage.table(spark, SF, "documents")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert len(out) > 100 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97


def test_language_of_odd_rows(spark):
    rng = random.Random(1)
    en = lambda: " ".join(rng.choice("the and thing with that other".split()) for _ in range(30))
    de = lambda: " ".join(rng.choice("der und ungen nicht schein über".split()) for _ in range(30))
    rows = [(i, (en if i % 2 else de)(), "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, "12 ... ² 34", "de"), (103, en() * 2000, None), (None, de(), "de"), (1, rows[1][1], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = language_id.identify(df).collect()
    assert len(got) == len(rows)
    pred = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert all(pred[i] == ("und", 0.0) for i in (100, 101, 102))
    assert pred[103][0] == "en" and pred[None][0] == "de" and pred[1][0] == "en"
    assert language_id.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_code_switched_words_and_segments():
    rng = random.Random(2)
    text = lambda words: " ".join(rng.choice(words.split()) for _ in range(60))
    en, de = "the and thing with that other", "der und ungen nicht schein über"
    tagger = language_id.train([("en", text(en)) for _ in range(20)] + [("de", text(de)) for _ in range(20)])
    words = language_id.words_of(text(en) + " " + text(de) + " " + text(en))
    assert tagger.label(words) == ["en"] * 60 + ["de"] * 60 + ["en"] * 60
    codes = np.array([tagger.codes[w] for w in words])
    cut, whole = (language_id.segments([codes], n) for n in (7, len(codes)))
    a, b = (language_id.marginals(tagger.scores[p], m, tagger.transitions, o)[m] for p, m, o in (cut, whole))
    assert np.allclose(a, b, atol=1e-5)


def by_paths(scores, transitions):
    """Log of the sum over all label sequences of one text, marginals and pair marginals, sequence by sequence."""
    n, s = scores.shape
    single, pairs, total = np.zeros((n, s)), np.zeros((s, s)), 0.0
    for path in itertools.product(range(s), repeat=n):
        weight = np.exp(sum(scores[t, y] for t, y in enumerate(path))) * np.prod([transitions[a, b] for a, b in zip(path, path[1:])])
        total += weight
        for t, y in enumerate(path):
            single[t, y] += weight
        for a, b in zip(path, path[1:]):
            pairs[a, b] += weight
    return np.log(total), single / total, pairs / total


def test_marginals_by_brute_force():
    rng = np.random.default_rng(4)
    transitions, lengths = np.exp(rng.normal(size=(3, 3))), [1, 5, 7, 3, 6]
    scores = [rng.normal(size=(n, 3)) * 2 for n in lengths]
    flat = np.concatenate(scores)
    cuts = np.cumsum([0, *lengths])
    codes = [np.arange(a, b) for a, b in zip(cuts, cuts[1:])]
    for length in (3, 8):  # texts over several segments, and in one
        places, mask, owner = language_id.segments(codes, length)
        pairs = np.zeros((3, 3))
        got = language_id.marginals(flat[places], mask, transitions, owner, pairs)[mask]
        want = [by_paths(x, transitions) for x in scores]
        assert np.allclose(got, np.concatenate([w[1] for w in want]), atol=1e-5)
        if length == 8:
            assert np.allclose(pairs, sum(w[2] for w in want), atol=1e-4)
            bumped = transitions.copy()
            bumped[0, 2] *= np.exp(1e-5)  # pair marginals are the gradient by log transitions
            change = sum(by_paths(x, bumped)[0] for x in scores) - sum(w[0] for w in want)
            assert abs(change / 1e-5 - pairs[0, 2]) < 1e-3


def test_transitions_are_learned():
    rng = random.Random(6)
    text = lambda words: " ".join(rng.choice(words.split()) for _ in range(80))
    tagger = language_id.train([("en", text("the and thing with shared")) for _ in range(15)] + [("de", text("der und ungen nicht shared")) for _ in range(15)])
    t = tagger.transitions
    assert t[0, 0] > 1.5 * t[0, 1] and t[1, 1] > 1.5 * t[1, 0]
    assert tagger.label(["der", "shared", "und"])[1] == "de" and tagger.label(["the", "shared", "and"])[1] == "en"


def test_marks_belong_to_words():
    assert language_id.words_of("हिन्दी में Ünter-x² e\u0301te") == ["हिन्दी", "में", "ünter", "x", "e\u0301te"]
    assert language_id.words_of("½ 12 ² _") == []


PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_bpe_as_the_public_encoder(spark):
    ranks = bpe.read_ranks(PATH)
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    alphabet = "abc AB  \n\t12'sdtrlvem.,!?é ñß\xa0\x1c\x85²½ª中文字😀　 ٣ÀœŁǆΩжא\x7fʼ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += ["a" * 300, " " * 300, "<|endoftext|>", "don't we'll", "the " * 30000, "w" * 50_000, "ab" * 15_000, None, ""]
    texts += ["".join(rng.choice(letters) for _ in range(1500)) for letters in ("etaoinshr", "ABCdefghijklm", "0x", "-=.", "é中a")]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = bpe.tokenize(df, PATH, public_tokenizers.PATTERN, keep_ids=True).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        ids = encoder.encode_ordinary(text)
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, text)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.tokenize(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_coders_go_when_workers_do_other_work(spark):
    df = spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id long, text string").repartition(4)
    assert len(bpe.tokenize(df, PATH, public_tokenizers.PATTERN).collect()) == 40

    def left(batches):
        coders = sum(isinstance(x, bpe.PieceCoder) for x in gc.get_objects())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([coders] * len(batch), pa.int64())], ["coders"])

    assert {r.coders for r in df.select("doc_id").mapInArrow(left, "coders long").collect()} == {0}


def test_equal_pieces_are_held_once(monkeypatch):
    coder, seen = bpe.PieceCoder(bpe.read_ranks(PATH)), []
    known = coder.known
    monkeypatch.setattr(coder, "known", lambda pieces: seen.extend(pieces) or known(pieces))
    encoded = [*bpe.encode_texts(["some words and some words"] * 50, bpe.Splitter(public_tokenizers.PATTERN), coder)]
    assert len({*map(id, seen)}) == len(set(seen)) == 4 and len({e.ids_hash.hexdigest() for e in encoded}) == 1


def test_long_pieces_as_the_public_encoder():
    """Letters without white space, DNA, base64, and runs of one sign at every offset to the chunks."""
    ranks = bpe.read_ranks(PATH)
    public = tiktoken.Encoding("p", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder, split, rng = bpe.PieceCoder(ranks), bpe.Splitter(public_tokenizers.PATTERN), random.Random(11)
    letters = lambda signs, n: "".join(rng.choices(signs, k=n))
    texts = ["x" + c * n for c in "a- é中" for n in (201, 5003)] + ["!" + "=-" * 900, "ab" * 3000 + "c"]
    texts += [letters("abcdefghijklmnopqrstuvwxyz", n) for n in (201, 2000, 60_000)] + [letters("ACGT", 9000), letters("aeiouß", 3000)]
    texts += [" ".join(letters(rng.choice(["ab", "=-", "xyzABC"]), rng.randint(100, 900)) for _ in range(30)), "a" * 1_500_000]
    for text, found in zip(texts, bpe.encode_texts(texts, split, coder, keep=True)):
        n, _, _, ids, decoded = found.row()
        assert ids == public.encode_ordinary(text) and decoded == text and n == len(ids), text[:20]


def test_long_texts_in_parts(monkeypatch):
    ranks = bpe.read_ranks(PATH)
    coder, split, rng = bpe.PieceCoder(ranks), bpe.Splitter(public_tokenizers.PATTERN), random.Random(12)
    texts = [" ".join(rng.choice(["some", "Wörter", "a1", "-" * 300, "\n\n"]) for _ in range(n)) for n in (0, 3, 5000)]
    whole = [found.row() for found in bpe.encode_texts(texts, split, coder, keep=True)]
    for name, value in (("TEXT_AT_ONCE", 10), ("PIECES_AT_ONCE", 7)):
        monkeypatch.setattr(bpe, name, value)
    assert [found.row() for found in bpe.encode_texts(texts, split, coder, keep=True)] == whole


def test_pieces_go_to_duckdb_by_their_size(monkeypatch):
    """Queries have a cost of their own: many short pieces share one, long ones do not."""
    coder, calls = bpe.PieceCoder(bpe.read_ranks(PATH)), []
    contract = coder.contract
    monkeypatch.setattr(coder, "contract", lambda rest: calls.append(sum(len(p) for _, p in rest)) or contract(rest))
    coder.learn({f"{i:x}q" for i in range(1 << 20, (1 << 20) + 25_000)})
    assert len(calls) == 1 and len(coder.ids) == 25_000
    monkeypatch.setattr(bpe, "SPELLED_AT_ONCE", 20_000)
    coder.learn({f"{i}" + "z" * 34 for i in range(100_000, 101_000)})
    assert len(calls) == 3 and max(calls[1:]) <= 20_000


def test_batches_are_gathered_by_bytes():
    batches = [pa.RecordBatch.from_pydict({"i": [i, -i], "text": ["x" * n, None]}) for i, n in enumerate((3, 4, 9, 0, 50, 1, 0))]
    got = [*texts.gathered(iter(batches), "text", 10)]
    assert [b["i"].to_pylist() for b in got] == [[0, 0, 1, -1], [2, -2, 3, -3], [4, -4], [5, -5, 6, -6]]
    assert [*texts.gathered(iter([]), "text", 10)] == []


def test_pipeline_stage_by_stage(spark):
    """Each stage against what its operator says of its own input."""
    docs = storage.table(spark, "/root/testdata/sf0.001", "documents")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = storage.materialize(stage(spark, docs, "/root/testdata/sf0.001"), "test")
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
        before = {r.doc_id: r for r in docs.collect()}
        after = out.collect()
        assert all(before[r.doc_id] == r for r in after)
        sizes.append(len(after))
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in last.collect())
    assert sizes[0] >= sizes[1] >= sizes[2]
    whole = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    key = lambda r: (r.doc_id, r.n_tokens, r.ids_sha256)
    assert sorted(map(key, whole.collect())) == sorted(map(key, last.collect()))


def test_queries_are_registered():
    from kronika.llm import queries

    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
