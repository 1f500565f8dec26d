"""Language ID by a linear-chain conditional random field over words.

Each word of a text gets a score for every language from its affixes, its byte n-grams and a
lexicon; learned transitions tie neighbouring words, so that code-switched text is labelled word by word.
Forward-backward gives each word's marginals; a document's language is the one with the largest
mean marginal, which is its score.

Training uses at most ``per_lang`` labelled documents of each language (the lowest seeded hashes of
their ids), of each at most ``most_chars`` characters, cut into runs and dealt into code-switched sequences, on the driver: the
sample is bounded by ``per_lang * most_chars`` times the number of languages.  Emissions and transitions are fitted together to
the likelihood of the sequences.  Documents with crc32(id as text) mod 4 = 2 are held out.  Only the
text decides a prediction.

Long texts are cut into segments of ``SEGMENT`` words whose transfer matrices are multiplied first, which gives
the same marginals as a walk over the whole text.

Defined results: a null text, or one without letters, is ``und`` with score 0; without any labelled
document all are.  Ties go to the language that sorts first.  Repeated rows get equal answers; an empty table gives
an empty result.  A null id is neither held out nor learned from.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .storage import small_batches
from .texts import give_back, slices, small


#: Letters with their marks; the plain pattern does the same for texts without marks and letters of other scripts, faster.
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*+")
LATIN_WORDS, OTHER = re.compile(r"[^\W\d_²³¹¼½¾]+"), re.compile("[^\x00-\u02ff]")
SEGMENT = 64
KEPT_WORDS = 300_000
#: Up to so many languages, counted, their sizes are broadcast.
BROADCAST_LANGS = 10_000
#: Sizes of the tables of weights: byte pairs, byte triples, starts and ends of words.
TABLES = (1 << 16, 1 << 17, 1 << 16, 1 << 16)
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    return (WORDS if OTHER.search(text) else LATIN_WORDS).findall(text)


def held_out(id_col="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def word_features(words: list[str]):
    """(places, word of each place) for each of the four tables of weights."""
    data = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03\x03\x03\x03").encode(), np.uint8).astype(np.uint32)
    starts = np.flatnonzero(data == 2)
    stops = np.append(starts[1:] - 1, len(data) - 4)
    owner = np.cumsum(data[:-4] == 2) - 1
    a, b, c, d = data[:-4], data[1:-3], data[2:-2], data[3:-1]
    pair = a * 256 + b
    mixed = (pair * 257 + c) * np.uint32(2654435761)
    inside = a != 3
    triple = inside & (b != 3)
    first = (mixed[starts] + d[starts] * np.uint32(40503)) * np.uint32(2246822519)
    before = np.maximum(stops - 3, starts)
    last = (mixed[before] + d[before] * np.uint32(40503)) * np.uint32(3266489917)
    every = np.arange(len(starts))
    return (
        (pair[inside], owner[inside]),
        (mixed[triple] >> np.uint32(15), owner[triple]),
        (first >> np.uint32(16), every),
        (last >> np.uint32(16), every),
    )


def marginals(scores: np.ndarray, mask: np.ndarray, transitions: np.ndarray, owner: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Marginals (segments, SEGMENT, languages) by forward-backward.

    ``scores`` are words' log scores, ``transitions`` the factors of neighbours, ``mask`` tells words from padding, ``owner`` is the text
    of each segment, ascending; a text's segments follow each other.  The marginals of neighbours within segments are
    added up in ``pairs``, if given.
    """
    n, length, s = scores.shape
    near = np.exp(scores - scores.max(2, keepdims=True)).astype(np.float32)
    near[~mask] = 1.0
    step = transitions.astype(np.float32)

    first = np.append(True, owner[1:] != owner[:-1])
    place = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    most = int(place.max()) + 1
    start = np.full((n, s), 1 / s, np.float32)
    after = np.ones((n, s), np.float32)
    if most > 1:
        carried = np.broadcast_to(np.eye(s, dtype=np.float32), (n, s, s)).copy()
        for t in range(length):
            came = carried @ step
            if t == 0:
                came[first] = 1  # a text's first word follows none
            new = came * near[:, t, None, :]
            new /= new.sum((1, 2), keepdims=True)
            carried = np.where(mask[:, t, None, None], new, carried)
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(most + 1))
        for i in range(1, most):
            at = order[cuts[i] : cuts[i + 1]]
            v = np.einsum("ns,nst->nt", start[at - 1], carried[at - 1])
            start[at] = v / v.sum(1, keepdims=True)
        for i in range(most - 1, 0, -1):
            at = order[cuts[i] : cuts[i + 1]]
            v = np.einsum("nst,nt->ns", carried[at], after[at])
            after[at - 1] = v / v.sum(1, keepdims=True)

    out = np.empty((n, length, s), np.float32)
    v = start
    for t in range(length):
        came = v @ step
        if t == 0:
            came[first] = 1
        new = came * near[:, t]
        v = np.where(mask[:, t, None], new / new.sum(1, keepdims=True), v)
        out[:, t] = v
    v = after
    for t in range(length - 1, -1, -1):
        if pairs is not None and t:
            both = out[:, t - 1, :, None] * step * (near[:, t] * v)[:, None, :]
            pairs += (both / both.sum((1, 2), keepdims=True))[mask[:, t]].sum(0)
        out[:, t] *= v
        new = (near[:, t] * v) @ step.T
        v = np.where(mask[:, t, None], new / new.sum(1, keepdims=True), v)
    out /= out.sum(2, keepdims=True)
    out[~mask] = 0
    return out


def segments(codes: list[np.ndarray], length: int = SEGMENT):
    """(codes padded to segments, mask, text of each segment)."""
    counts = np.array([len(c) for c in codes])
    per_text = -(-counts // length)
    owner = np.repeat(np.arange(len(codes)), per_text)
    flat = np.zeros(per_text.sum() * length, np.int32)
    mask = np.zeros(len(flat), bool)
    offsets = (np.cumsum(per_text) - per_text) * length
    at = np.arange(counts.sum()) + np.repeat(offsets - (np.cumsum(counts) - counts), counts)
    flat[at] = np.concatenate(codes) if codes else []
    mask[at] = True
    return flat.reshape(-1, length), mask.reshape(-1, length), owner


class Tagger:
    def __init__(self, langs: list[str], tables: list[np.ndarray], lexicon: dict[str, int], lexical: np.ndarray, transitions: np.ndarray):
        self.langs, self.tables, self.lexicon, self.lexical, self.transitions = langs, tables, lexicon, lexical, transitions
        self.codes: dict[str, int] = {}
        self.scores = np.empty((0, len(langs)), np.float32)

    def score(self, words: list[str]) -> np.ndarray:
        total = np.zeros((len(words), len(self.langs)), np.float32)
        for table, (places, owner) in zip(self.tables, word_features(words)):
            for s in range(len(self.langs)):
                total[:, s] += np.bincount(owner, table[places, s], len(words))
        return total + self.lexical[[self.lexicon.get(w, 0) for w in words]]

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.codes]
        if len(self.codes) + len(new) > KEPT_WORDS:
            self.codes, new = {}, list(words)
            self.scores = self.scores[:0]
        self.codes.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
        parts = [self.score(new[i : i + 50_000]) for i in range(0, len(new), 50_000)]
        self.scores = np.concatenate([self.scores, *parts])

    def shares(self, texts: list[list[str]]) -> np.ndarray:
        """Mean marginals of each text's words; no text may be empty."""
        self.learn(set().union(*texts))
        codes = [np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words)) for words in texts]
        padded, mask, owner = segments(codes)
        total = np.zeros((len(texts), len(self.langs)))
        for i, j in cut_at_texts(owner, 4_000):
            got = marginals(self.scores[padded[i:j]], mask[i:j], self.transitions, owner[i:j]).sum(1)
            np.add.at(total, owner[i:j], got)
        return total / total.sum(1, keepdims=True)

    def label(self, words: list[str]) -> list[str]:
        """The likeliest language of each word of one text."""
        self.learn(set(words))
        padded, mask, owner = segments([np.array([self.codes[w] for w in words])])
        got = marginals(self.scores[padded], mask, self.transitions, owner)[mask]
        return [self.langs[i] for i in got.argmax(1)]


def cut_at_texts(owner: np.ndarray, most: int):
    """Ranges of about ``most`` segments that end where a text ends."""
    i = 0
    while i < len(owner):
        j = min(i + most, len(owner))
        if j < len(owner):
            j = int(np.searchsorted(owner, owner[j - 1], "right"))
        yield i, j
        i = j


def train(rows: list[tuple[str, str]], rounds: int = 40, lexicon_size: int = 4000, seed: int = 3) -> Tagger | None:
    """Fit to (lang, text) rows by full-batch Adam on the likelihood of code-switched sequences."""
    texts = [(lang, words_of(text)) for lang, text in sorted(rows)]
    langs = sorted({lang for lang, words in texts if words})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    counts: dict[str, int] = {}
    runs: list[tuple[int, list[str]]] = []
    for lang, words in texts:
        at = 0
        while at < len(words):
            n = int(rng.integers(8, 40))
            runs.append((langs.index(lang), words[at : at + n]))
            at += n
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    lexicon = {w: i + 1 for i, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w))[:lexicon_size])}
    vocabulary = sorted(counts)
    code = {w: i for i, w in enumerate(vocabulary)}
    rng.shuffle(runs)
    stream = np.array([code[w] for _, run in runs for w in run], np.int32)
    truth = np.repeat([lang for lang, _ in runs], [len(run) for _, run in runs])
    length = SEGMENT
    padded = np.zeros(-(-len(stream) // length) * length, np.int32)
    wanted, mask = padded.copy(), np.zeros(len(padded), bool)
    padded[: len(stream)], wanted[: len(stream)], mask[: len(stream)] = stream, truth, True
    padded, wanted, mask = (x.reshape(-1, length) for x in (padded, wanted, mask))
    s = len(langs)
    target = np.eye(s, dtype=np.float32)[wanted] * mask[..., None]

    features = word_features(vocabulary)
    lexical_at = np.array([lexicon.get(w, 0) for w in vocabulary])
    switches = np.zeros((s, s))
    both = mask[:, 1:]
    np.add.at(switches, (wanted[:, :-1][both], wanted[:, 1:][both]), 1)
    weights = [np.zeros((n, s), np.float32) for n in TABLES] + [np.zeros((len(lexicon) + 1, s), np.float32), np.zeros((s, s), np.float32)]
    one, two = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    tagger = Tagger(langs, weights[:4], lexicon, weights[4], np.exp(weights[5]))
    every = np.arange(len(padded))
    for k in range(1, rounds + 1):
        scores = tagger.score(vocabulary)[padded]
        expected = np.zeros((s, s))
        error = marginals(scores, mask, tagger.transitions, every, expected) - target
        by_word = np.stack([np.bincount(padded[mask], error[..., i][mask], len(vocabulary)) for i in range(s)], 1)
        for j, w in enumerate(weights):
            if j < 5:
                places, owner = features[j] if j < 4 else (lexical_at, np.arange(len(vocabulary)))
                grad = np.stack([np.bincount(places, by_word[owner, i], len(w)) for i in range(s)], 1).astype(np.float32)
            else:
                grad = (expected - switches).astype(np.float32)
            grad = grad / len(stream) * 1000 + 1e-3 * w
            one[j] = 0.9 * one[j] + 0.1 * grad
            two[j] = 0.99 * two[j] + 0.01 * grad * grad
            w -= 0.05 * (one[j] / (1 - 0.9**k)) / (np.sqrt(two[j] / (1 - 0.99**k)) + 1e-3)
        weights[4][0] = 0
        tagger.transitions = np.exp(weights[5])
    return tagger


def sample(docs: DataFrame, per_lang: int, most_chars: int, seed: int = 5) -> list[tuple[str, str]]:
    """At most ``per_lang`` labelled, not held-out (lang, text) rows for each language, of a text its first ``most_chars``."""
    ids = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang")
    counts = ids.groupBy("lang").count()
    if counts.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS:
        counts = F.broadcast(counts)  # else ids would be dealt by language
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    share = F.least(F.lit(1.0), F.lit(2.0 * per_lang + 50) / F.col("count"))
    few = ids.join(counts, "lang").where(draw < share).withColumn("draw", draw)
    nth = F.row_number().over(W.partitionBy("lang").orderBy("draw", "doc_id"))
    chosen = few.withColumn("nth", nth).where(F.col("nth") <= per_lang).select("doc_id", "lang").distinct()
    text = F.substring(F.coalesce("text", F.lit("")), 1, most_chars).alias("text")
    rows = docs.select("doc_id", "lang", text).join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    one = rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # an id may be repeated, without bound
    return [(r.lang, r.text) for r in one.collect()]


def predictions(tagger: Tagger | None, texts: list[str | None]):
    """(index of the best language or -1, its share) of each text."""
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    texts = [t or "" for t in texts]
    for part in slices(texts) if tagger else ():
        words = {i: w for i, t in enumerate(texts[part], part.start) if (w := words_of(t))}
        if words:
            shares = tagger.shares([*words.values()])
            best[[*words]], score[[*words]] = shares.argmax(1), shares.max(1)
    return best, score.clip(0, 1)


def fitted(docs: DataFrame, per_lang: int, most_chars: int, id_col: str, text_col: str, lang_col: str):
    """A broadcast tagger."""
    small_batches(docs.sparkSession)
    columns = (F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return docs.sparkSession.sparkContext.broadcast(train(sample(docs.select(*columns), per_lang, most_chars)))


def identify(
    docs: DataFrame,
    per_lang: int = 120,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    most_chars: int = 200_000,
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""
    shared = fitted(docs, per_lang, most_chars, id_col, text_col, lang_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        tagger = shared.value
        for batch in small(batches, "text"):
            best, score = predictions(tagger, batch["text"].to_pylist())
            langs = pa.array([tagger.langs[i] if i >= 0 else UNKNOWN for i in best], pa.string())
            columns = [batch["doc_id"], batch["held_out"], langs, pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])
        give_back()

    return docs.select(
        F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")
    ).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(
    docs: DataFrame,
    min_score: float = 0.4,
    per_lang: int = 120,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    most_chars: int = 200_000,
) -> DataFrame:
    """The rows of ``docs``, unchanged, whose language is known with a score of at least ``min_score``."""
    shared = fitted(docs, per_lang, most_chars, id_col, text_col, lang_col)

    def run(batches):
        for batch in small(batches, text_col):
            best, score = predictions(shared.value, batch.column(text_col).to_pylist())
            yield batch.filter(pa.array((best >= 0) & (score >= min_score)))
        give_back()

    return docs.mapInArrow(run, docs.schema)
