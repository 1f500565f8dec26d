"""Exact and near dedup, repeated strings, mixing: against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kronika.llm import components, exact_dedup, mixing, near_dedup, shingles, suffix_dedup

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def docs_of(spark, rows, clash="kept"):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn(clash, F.lit("clash"))


def word(rng):
    return "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 5)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    base = [[word(rng) for _ in range(rng.randint(1, 120))] for _ in range(20)]
    out = []
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = word(rng)
        text = rng.choice([" ", "  ", "\n"]).join(words)
        out.append((i, text.upper() if rng.random() < 0.1 else text, rng.choice(["a", "b", "é", None, "c"])))
    out += [(500, None, "a"), (501, "", None), (502, " \n\t", "z"), (503, "x", "z"), (504, "x", "z"), (505, "one two three four", "a")]
    out += [(506, "one  two three four", "b"), (507, "w" * 50000, "b"), (508, "ab " * 20000, "b"), (509, "ab " * 20001, "b")]
    rng.shuffle(out)
    return out


def test_exact_dedup(spark, rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[WHITE.sub("", t or "")].append((-len(t or ""), i))
    got = exact_dedup.dedup(docs_of(spark, rows), buckets=4).collect()
    assert len(got) == len(rows)
    for r in got:
        text = WHITE.sub("", dict((i, t) for i, t, _ in rows)[r.doc_id] or "")
        own = groups[text]
        assert (r.keep_id, r.group_size, r.kept) == (min(own)[1], len(own), min(own)[1] == r.doc_id)
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_index_persists(spark, rows):
    index = exact_dedup.DigestIndex(spark, "kept_digests", 4)
    first = exact_dedup.dedup(docs_of(spark, rows), index).collect()
    later = [(i + 10_000, t, s) for i, t, s in rows[:40]] + [(99_999, "only here", "a")]
    again = {r.doc_id: r for r in exact_dedup.dedup(docs_of(spark, later), index).collect()}
    keep = {r.text_sha256: r.keep_id for r in first}
    assert all(again[i].keep_id == keep[again[i].text_sha256] and not again[i].kept for i, _, _ in later[:-1])
    assert again[99_999].kept
    assert spark.table("kept_digests").groupBy("digest").count().where("count > 1").isEmpty()


def sets_by_hand(text):
    words = [w for w in WHITE.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup(spark, rows, percent):
    sets = {i: sets_by_hand(t) for i, t, _ in rows}
    parent = {i: i for i in sets}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = near_dedup.near_duplicates(docs_of(spark, rows, "n_shingles"), percent).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(s), root(i), root(i) == i) for i, s in sets.items()}


def test_crowded_regions(spark):
    """A group of copies far larger than a region, with links only among some."""
    rng = random.Random(4)
    words = [word(rng) for _ in range(100)]
    rows = []
    for i in range(150):
        own = list(words)
        own[rng.randrange(100)] = f"own{i}"
        rows.append((i, " ".join(own), "a"))
    got = near_dedup.near_duplicates(docs_of(spark, rows), 80).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 150


def test_plan_of_pairs_does_not_grow_with_levels(spark):
    """Texts that stay crowded for several levels: the pairs of all levels are read from tables, not made in one plan."""
    words = [f"w{i}" for i in range(400)]
    texts = [(i, " ".join([*words[:200], f"own{i}", *words[200:]]), "a") for i in range(60)]
    nodes = near_dedup.signed(docs_of(spark, texts).withColumnRenamed("doc_id", "id"), 5)
    found, _ = near_dedup.candidates(nodes)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") >= 3 and plan.count("Exchange") == 1
    assert {(r.a, r.b) for r in found.collect()} >= {(0, i) for i in range(1, 60)}


def test_copies_of_a_text_that_is_not_the_least(spark):
    """Copies link with the text that they were made from, not with each other, in regions that stay crowded."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    base = rng.choices(words, k=300)
    texts = []
    for _ in range(400):
        copy = list(base)
        for at in rng.sample(range(300), 4):
            copy[at] = rng.choice(words)
        texts.append(copy)
    texts.insert(250, base)
    sets = [sets_by_hand(" ".join(t)) for t in texts]
    alike = [len(s & sets[250]) / len(s | sets[250]) >= 0.85 for s in sets]
    found = near_dedup.near_duplicates(docs_of(spark, [(i, " ".join(t), "a") for i, t in enumerate(texts)]), percent=85)
    got = {r.doc_id: r.component_id for r in found.collect()}
    linked = [i for i, near in enumerate(alike) if near]
    assert len(linked) > 380
    assert {got[i] for i in linked} == {linked[0]}


def test_links_within_a_template_group(spark):
    """Planted pairs and chains among thousands of texts that share a template, none alike enough to the least or the centre."""
    rng = random.Random(6)
    template = [f"t{i}" for i in range(278)]
    own = [[f"own{i}x{k}" for k in range(26)] for i in range(2500)]
    planted = [(i, i + 1) for i in range(100, 180, 2)] + [(i, i + 1) for i in range(300, 309)]
    for a, b in planted:  # the end of one and the start of the next share seven words
        own[a][-7:] = own[b][:7] = [f"pair{a}x{k}" for k in range(7)]
    texts = [template + x for x in own]
    sets = [sets_by_hand(" ".join(t)) for t in texts]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(alike(a, b) >= 0.85 for a, b in planted)
    assert all(alike(*rng.sample(range(400, 2500), 2)) < 0.85 for _ in range(100)) and alike(300, 302) < 0.85
    found = near_dedup.near_duplicates(docs_of(spark, [(i, " ".join(t), "a") for i, t in enumerate(texts)]), percent=85)
    got = {r.doc_id: r.component_id for r in found.collect()}
    want = {i: i for i in range(2500)} | {i + 1: i for i in range(100, 180, 2)} | {i: 300 for i in range(300, 310)}
    assert got == want


def rows_joined_by_id(spark, docs):
    """The rows that all joins by id make while near-duplicates are found."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    near_dedup.near_duplicates(docs, 85).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs, total = store.executionsList(), 0
    for n in range(before, runs.size()):
        run = runs.apply(n).executionId()
        metrics, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name() and re.search(r"\[id#\d+L?\], \[id#\d+L?\], Inner", node.desc()):
                own = (node.metrics().apply(i) for i in range(node.metrics().size()))
                made = [metrics.get(m.accumulatorId()) for m in own if m.name() == "number of output rows"]
                total += sum(int(m.get().replace(",", "")) for m in made if m.isDefined())
    return total


def test_work_in_a_template_group_grows_with_its_size(spark, monkeypatch):
    """Texts that share a template but do not link: twice as many make twice the rows, not four times."""
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    texts = [" ".join([*(f"t{k}" for k in range(200)), *(f"own{i}x{k}" for k in range(30))]) for i in range(800)]
    made = [rows_joined_by_id(spark, docs_of(spark, [(i, t, "a") for i, t in enumerate(texts[:n])])) for n in (400, 800)]
    assert 400 <= made[0] and made[1] <= 2.5 * made[0] and made[1] <= 10 * 800


def test_links_share_rare_keys(spark):
    """Every two sets that link have a key in common with the smaller one at home, whatever the order of shingles."""
    rng = np.random.default_rng(7)
    base = rng.integers(1, 1 << 63, 160, dtype=np.uint64)
    for counts in (np.ones(near_dedup.BUCKETS, np.int64) * 2, rng.integers(2, 9, near_dedup.BUCKETS)):
        for percent in (80, 85):
            sets = [np.unique(rng.permutation(base)[: rng.integers(1, 161)]) for _ in range(60)]
            sets += [np.unique(np.append(rng.permutation(base)[: rng.integers(130, 161)], rng.integers(1, 1 << 63, rng.integers(0, 25), dtype=np.uint64))) for _ in range(140)]
            keys = [near_dedup.rare_keys(x, counts, percent) for x in sets]
            found = 0
            for i, x in enumerate(sets):
                for j, y in enumerate(sets[:i]):
                    both = len(np.intersect1d(x, y))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        small, large = (i, j) if len(x) <= len(y) else (j, i)
                        assert np.isin(keys[small][0][keys[small][1]], keys[large][0]).any()
                        found += 1
            assert found > 50


def test_rows_without_id(spark):
    base = [f"w{i}" for i in range(200)]
    text, near, alone = " ".join(base), " ".join([*base[:-1], "other"]), " ".join(f"x{i}" for i in range(50))
    far = (1 << 60) + 1  # not a double
    rows = [(None, text, "a"), (far, text, "a"), (7, near, "a"), (None, near, "a"), (None, alone, "a"), (None, None, "a"), (9, "y " * 9, "a")]
    got = near_dedup.near_duplicates(docs_of(spark, rows), 80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == sorted(
        [(None, 196, 7, False), (far, 196, 7, False), (7, 196, 7, True), (None, 196, 7, False), (None, 46, None, True), (None, 0, None, True), (9, 1, 9, True)], key=str
    )


def test_pipeline_keeps_rows_without_id(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(200)]
    text, near = " ".join(base), " ".join([*base[:-1], "other"])
    texts = [(None, text), (5, text), (None, near), (None, " ".join(f"x{i}" for i in range(60))), (8, " ".join(f"y{i}" for i in range(60)))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    exact = corpus_pipeline.drop_copies(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in exact), key=str) == sorted(texts[1:], key=str)
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(exact, docs.schema), "")
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([texts[1], *texts[3:]], key=str)
    mixed = {(r.doc_id, r.text) for r in corpus_pipeline.mix_sources(spark, left, "").collect()}
    assert mixed == {texts[1], *texts[3:]}


def test_shingle_hashes():
    texts = ["a b c d e f a b c d e", "", " x ", "A B C D E", "a b c d e"]
    sets = shingles.shingle_sets(texts)
    assert [len(s) for s in sets] == [len(sets_by_hand(t)) for t in texts]
    assert np.array_equal(sets[3], sets[4]) and sets[4][0] in sets[0]


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 900), (900, 901), (5, 5)]
    got = components.components(spark.createDataFrame(chain, "a long, b long")).collect()
    want = {(i, 100) for i in range(101, 141)} | {(7, 3), (900, 3), (901, 3)}
    assert {(r.node, r.component) for r in got} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def repeats_by_hand(rows, length):
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p : p + length] in first:
                gone[p : p + length] = b"\1" * length
            else:
                first[data[p : p + length]] = i
        spans = sum(bool(g) and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("chunk, frequent, ranks", [(1 << 20, 8, 2000), (150, 2, 3)])
def test_repeated_strings(spark, monkeypatch, chunk, frequent, ranks):
    """Also with chunks, frequent seeds and crowded seeds so small that every path is taken."""
    for name, value in (("CHUNK", chunk), ("FREQUENT", frequent), ("FREQUENT_RANKS", ranks)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(6)
    base = ["".join(rng.choice("abcd é\n") for _ in range(rng.randint(0, 500))) for _ in range(8)]
    rows = []
    for i in range(80):
        a, b = rng.choice(base), rng.choice(base)
        cut = rng.randint(0, len(a) // 2)
        rows.append((i * 2, rng.choice([a, a[cut:] + b[: rng.randint(0, len(b))], (rng.choice(["ab", "xyz ", "q"]) * 200)[: rng.randint(50, 500)], a + "tail"])))
    rows += [(1000, None), (1001, "short"), (None, base[0] + base[1])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("p", F.lit("clash"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == repeats_by_hand(rows, 100)


def repeats_of_rows(rows, length):
    """(id, bytes, bytes removed) of each row where rows may share an id: a string counts as earlier by (id, place)."""
    order = lambda i, p: (i is not None, i or 0, p)
    first = {}
    for i, text in rows:
        for p in range(len(text) - length + 1):
            key = text[p : p + length]
            first[key] = min(first.get(key, (True, 1 << 62, 0)), order(i, p))
    out = []
    for i, text in rows:
        gone = bytearray(len(text))
        for p in range(len(text) - length + 1):
            if first[text[p : p + length]] < order(i, p):
                gone[p : p + length] = b"\1" * length
        out.append((i, len(text), sum(gone), hashlib.sha256("".join(c for c, g in zip(text, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("ids, holders", [("unique", 1), ("unique", 2), ("none", 1), ("none", 2), ("few", 2)])
def test_a_passage_in_many_rows(spark, ids, holders):
    """A footer of every page (all texts of a batch wait for ranks), and many rows of one id or of none."""
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(150))
    rows = []
    for n in range(1500):
        own = "".join(rng.choice("klmnopq ") for _ in range(rng.randint(40, 160)))
        cut = rng.randint(0, len(own))
        rows.append(({"unique": n, "none": None, "few": n % 3}[ids], own[:cut] + passage + own[cut:] if n % holders == 0 else own))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got), key=str) == repeats_of_rows(rows, 100)


def test_empty_tables(spark):
    empty = docs_of(spark, [])
    assert exact_dedup.dedup(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert mixing.mix(empty).count() == 0


def test_repeated_rows(spark):
    twice = docs_of(spark, [(1, "some words to be repeated here", "a")] * 2 + [(2, "other", "a")])
    assert [r.kept for r in exact_dedup.dedup(twice).collect()] == [True] * 3
    assert [r.kept for r in near_dedup.near_duplicates(twice).collect()] == [True] * 3
    assert {r.n_removed for r in suffix_dedup.remove_repeats(twice).collect()} == {0}
    assert mixing.mix(twice).count() == 3


def filled(sizes, weights, budget, epochs):
    """Clamp, hand the excess on by weight, until none is above its cap."""
    target = {s: 0.0 for s in sizes}
    open_ = {s for s in sizes if sizes[s]}
    left = budget
    while open_:
        share = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * share > epochs * sizes[s]}
        for s in full or open_:
            target[s] = epochs * sizes[s] if full else weights[s] * share
        if not full:
            break
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def test_mixing(spark, rows):
    got = mixing.mix(docs_of(spark, rows, "taken")).collect()
    words = {i: len([w for w in WHITE.split(t or "") if w]) for i, t, _ in rows}
    sources = sorted({s for _, _, s in rows if s is not None}) + [None]
    sizes = {s: sum(words[i] for i, _, x in rows if x == s) for s in sources}
    weights = {s: (3, 1, 2)[n % 3] for n, s in enumerate(sources)}
    target = filled(sizes, weights, 1.5 * sum(sizes.values()), 2)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        assert (r.size, r.source_size) == (words[r.doc_id], sizes[r.source])
        assert r.target == pytest.approx(target[r.source])
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for s in sources:
        assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1
    again = mixing.mix(docs_of(spark, rows[::-1], "taken").repartition(7)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}
