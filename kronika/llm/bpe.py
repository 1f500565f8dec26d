"""Byte-level BPE encoding and decoding with DuckDB recursive queries in each partition.

Texts are split by the vocabulary's pattern; each distinct piece of a partition is encoded
once.  Pieces go to DuckDB as rows of (piece, position, token); a recursive query joins
neighbouring tokens with the merge table and contracts each piece's leftmost pair of least rank until
no pair is left.  An ordered aggregation over the resulting ids gives the encoded ids, another, joined
with the vocabulary, the bytes that they decode to.  A piece that is itself in the vocabulary
is its own token, as in the public encoder.

Long pieces (base64, DNA, lines of one sign) are encoded in overlapping chunks.  A sequence of tokens is the encoding of its bytes if and
only if every two neighbours are the encoding of theirs, so two chunks are joined where both have a boundary and the tokens beside
it pass that test; where they have none, another chunk is begun at a boundary of the first.

The rank table is read once on the driver from ``path`` and broadcast; its size is that of the vocabulary.

Defined results: a null text counts as empty and gives no tokens; repeated rows are encoded alike; texts and pieces of any length
are worked on in bounded parts, in time that grows in proportion; an empty table gives an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re
from collections.abc import Set

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches
from .texts import gathered, give_back, slices, small


#: Pieces a worker keeps between batches, chunks and characters of pieces that go to DuckDB at once.
KEPT_PIECES = 400_000
PIECES_AT_ONCE, SPELLED_AT_ONCE = 20_000, 600_000
#: Pieces of more bytes are encoded in chunks of ``2 * STEP`` bytes, one from every ``STEP`` bytes on, so that rounds do not grow with
#: the piece; so many bytes of a piece, or characters of texts, at a time.
LONG, STEP = 200, 64
FRESH, SEGMENT, TEXT_AT_ONCE = 256, 1 << 17, 4_000_000

ENCODE = """
WITH RECURSIVE steps AS (
  SELECT piece, pos, tok, false AS done FROM started
  UNION ALL
  (WITH pairs AS (
     SELECT s.*, CASE WHEN m.rank IS NOT NULL THEN (m.rank::BIGINT << 32) + s.pos END AS pair
     FROM (SELECT piece, pos, tok, lead(tok) OVER o AS follower, lead(piece) OVER o AS next_piece
           FROM steps WHERE NOT done WINDOW o AS (ORDER BY piece, pos)) s
     LEFT JOIN merges m ON m.a = s.tok AND m.b = s.follower AND s.next_piece = s.piece),
   least AS (SELECT piece, min(pair) AS best FROM pairs GROUP BY piece)
   SELECT p.piece, pos, CASE WHEN pair = best THEN (pair >> 32)::INTEGER ELSE tok END, best IS NULL
   FROM (SELECT *, lag(pair) OVER (ORDER BY piece, pos) AS pair_before FROM pairs) p
   JOIN least l ON l.piece = p.piece
   WHERE best IS NULL OR pair_before IS DISTINCT FROM best)
)
SELECT piece, string_agg(tok::VARCHAR, ' ' ORDER BY pos) AS ids FROM steps WHERE done GROUP BY piece
"""

DECODE = """
SELECT piece, string_agg(v.hexed, '' ORDER BY nth) AS hexed
FROM (SELECT piece, unnest(toks)::INTEGER AS tok, unnest(range(len(toks))) AS nth
      FROM (SELECT piece, string_split(ids, ' ') AS toks FROM encoded)) e
JOIN vocabulary v ON v.tok = e.tok GROUP BY piece
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def as_class(name: str, upto: int = 0x250) -> str:
    """The characters below ``upto`` of a Unicode class, for a pattern of ``re``."""
    test = regex.compile(name)
    return "".join(f"\\u{c:04x}" for c in range(upto) if test.match(chr(c)))


class Splitter:
    """Splits by ``pattern``; a plain ``re`` does the same for texts of Latin characters, faster."""

    def __init__(self, pattern: str):
        white, letter, number = r"\p{White_Space}", r"\p{L}", r"\p{N}"
        self.full = regex.compile(pattern.replace(r"[^\s", f"[^{white}").replace(r"\s", white).replace(r"\S", f"[^{white}]"))
        latin = {white: as_class(white), letter: as_class(letter), number: as_class(number)}
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", "[^" + "".join(latin.values()) + "]")
        plain = plain.replace(r"\S", f"[^{latin[white]}]").replace(r"\s", f"[{latin[white]}]")
        plain = plain.replace(letter, f"[{latin[letter]}]").replace(number, f"[{latin[number]}]")
        self.plain = re.compile(plain)
        self.other = re.compile("[^\x00-ɏ]")

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or not self.other.search(text):
            return self.plain.findall(text)
        return self.full.findall(text)

    def some(self, text: str, n: int):
        """The same in lists of ``n`` pieces."""
        found = (m[0] for m in self.full.finditer(text))
        while pieces := list(itertools.islice(found, n)):
            yield pieces


def is_long(piece: str) -> bool:
    return len(piece) > LONG // 4 and len(piece.encode()) > LONG


def is_huge(piece: str) -> bool:
    """Too long to be kept whole."""
    return len(piece) > SEGMENT // 4


def chunks_in(data: bytes) -> int:
    return max(-(-len(data) // STEP) - 1, 1)


def shared(n: int, where: dict[int, int], at: dict[int, int], after: int) -> list[int]:
    """Boundaries that chunk ``n`` has in common with another, those in the middle of what they share first."""
    return sorted((p for p in where.keys() & at.keys() if p > after), key=lambda p: abs(p - n * STEP - STEP // 2))


class PieceCoder:
    """Encodes and decodes pieces in DuckDB; one for each Python worker."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (ranks[t[:i]], ranks[t[i:]], rank)
            for t, rank in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        a, b, rank = map(pa.array, zip(*pairs))
        self.register("m", pa.table({"a": a, "b": b, "rank": rank}))
        self.register("v", pa.table({"tok": list(ranks.values()), "hexed": [t.hex() for t in ranks]}))
        self.db.execute("CREATE TABLE merges AS SELECT a::INTEGER a, b::INTEGER b, rank::INTEGER rank FROM m")
        self.db.execute("CREATE TABLE vocabulary AS SELECT tok::INTEGER tok, hexed FROM v")
        self.db.unregister("m")
        self.db.unregister("v")
        self.ids: dict[str, str] = {}
        self.bytes: dict[str, bytes] = {}
        self.token = {rank: t for t, rank in ranks.items()}
        self.chunks: dict[bytes, list[int]] = {}
        self.agree: dict[tuple[int, int], bool] = {}

    def register(self, name: str, rows: pa.Table) -> None:
        self.db.register(name, rows)

    def encode(self, pieces: list[bytes]) -> pa.Table:
        """``piece, ids`` with ``piece`` the place in ``pieces``; none may be empty."""
        known = [*map(self.ranks.get, pieces)]
        whole = [(i, rank) for i, rank in enumerate(known) if rank is not None]
        rest = [(i, pieces[i]) for i, rank in enumerate(known) if rank is None]
        asis = pa.table(
            {
                "piece": pa.array([i for i, _ in whole], pa.int32()),
                "ids": pa.array([str(t) for _, t in whole], pa.string()),
            }
        )
        return pa.concat_tables([asis, self.contract(rest).cast(asis.schema)]) if rest else asis

    def contract(self, rest: list[tuple[int, bytes]]) -> pa.Table:
        sizes = np.array([len(p) for _, p in rest], np.int64)
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(p for _, p in rest), np.uint8)
        places = np.array([i for i, _ in rest], np.int32)
        self.register(
            "started",
            pa.table(
                {
                    "piece": np.repeat(places, sizes),
                    "pos": (np.arange(len(data)) - np.repeat(starts, sizes)).astype(np.int32),
                    "tok": self.single[data],
                }
            ),
        )
        return self.db.sql(ENCODE).to_arrow_table()

    def decode(self, encoded: pa.Table) -> pa.Table:
        self.register("encoded", encoded)
        return self.db.sql(DECODE).to_arrow_table()

    def learn(self, pieces: Set[str]) -> None:
        """Puts every piece into ``ids`` and ``bytes``."""
        new = [p for p in pieces - self.ids.keys() if not is_huge(p)]
        if len(self.ids) + len(new) > KEPT_PIECES:
            self.ids = {p: self.ids[p] for p in pieces if p in self.ids}
            self.bytes = {p: self.bytes[p] for p in self.ids}
        far = [p for p in new if is_long(p)]
        for part in slices(far, SEGMENT):
            some = far[part]
            self.prepare([(d, range(chunks_in(d))) for d in map(str.encode, some)])
            for piece in some:
                ids, decoded = zip(*self.long(piece))
                self.ids[piece], self.bytes[piece] = " ".join(ids), b"".join(decoded)
        new = [p for p in new if p not in self.ids]
        for part in slices(new, SPELLED_AT_ONCE) if new else ():
            some = new[part]
            encoded = self.encode([p.encode() for p in some])
            decoded = self.decode(encoded).select(["piece", "hexed"])
            self.ids.update((some[at], ids) for at, ids in zip(*(c.to_pylist() for c in encoded.columns)))
            self.bytes.update((some[at], bytes.fromhex(h)) for at, h in zip(*(c.to_pylist() for c in decoded.columns)))


    def merged(self, parts: list[bytes]) -> list[list[int]]:
        """The tokens that each of ``parts`` contracts to."""
        out: list[list[int]] = [[]] * len(parts)
        for start in range(0, len(parts), PIECES_AT_ONCE):
            some = parts[start : start + PIECES_AT_ONCE]
            found = self.contract([(i, p) for i, p in enumerate(some)])
            for at, ids in zip(found["piece"].to_pylist(), found["ids"].to_pylist()):
                out[start + at] = [*map(int, ids.split(" "))]
        return out

    def learn_chunks(self, parts: set[bytes]) -> None:
        if len(self.chunks) > KEPT_PIECES // 16:
            self.chunks.clear()
        new = [p for p in parts if p not in self.chunks]
        self.chunks.update(zip(new, self.merged(new)))

    def learn_pairs(self, pairs: set[tuple[int, int]]) -> None:
        """Whether two tokens side by side are what their bytes are encoded to."""
        if len(self.agree) > KEPT_PIECES // 2:
            self.agree.clear()
        new = [p for p in pairs if p not in self.agree]
        together = self.merged([self.token[a] + self.token[b] for a, b in new])
        self.agree.update((pair, tokens == [*pair]) for pair, tokens in zip(new, together))

    def bounds(self, tokens: list[int], start: int) -> dict[int, int]:
        """Of each boundary, the place of the token that starts there."""
        out, at = {}, start
        for i, t in enumerate(tokens):
            out[at] = i
            at += len(self.token[t])
        return out

    def agrees(self, left: int, right: int) -> bool:
        self.learn_pairs({(left, right)})
        return self.agree[left, right]

    def chunk(self, data: bytes, at: int, size: int = 2 * STEP) -> tuple[list[int], dict[int, int]]:
        """Tokens of the chunk at a place, with their boundaries."""
        part = data[at : at + size]
        self.learn_chunks({part})
        return self.chunks[part], self.bounds(self.chunks[part], at)

    def prepare(self, some: list[tuple[bytes, range]]) -> None:
        """Learns chunks of runs of bytes, and the tokens beside the boundaries at which neighbours are joined first, all at once."""
        self.learn_chunks({data[n * STEP : (n + 2) * STEP] for data, ns in some for n in ns})
        pairs = set()
        for data, ns in some:
            ahead = [self.chunk(data, n * STEP) for n in ns]
            for n, (tokens, where), (following, at) in zip(ns[1:], ahead, ahead[1:]):
                for p in shared(n, where, at, (n - 1) * STEP)[:1]:
                    pairs.add((tokens[where[p] - 1], following[at[p]]))
        self.learn_pairs(pairs)

    def stitched(self, data: bytes):
        """Runs of tokens of a long run of bytes, from those of its chunks; chunk ``n`` starts at byte ``n * STEP``."""
        count = chunks_in(data)
        ahead: dict[int, tuple[list[int], dict[int, int]]] = {}

        def load(first: int) -> None:
            ahead.clear()
            some = range(first, min(first + SEGMENT // STEP, count))
            self.prepare([(data, some)])
            ahead.update((n, self.chunk(data, n * STEP)) for n in some)

        load(0)
        (tokens, where), begun, end, n, last = ahead[0], 0, 2 * STEP, 1, None
        while n < count and end < len(data):
            if n not in ahead:
                load(n)
            met = next((p for p in shared(n, where, ahead[n][1], begun) if self.agrees(tokens[where[p] - 1], ahead[n][0][ahead[n][1][p]])), None)
            if met is not None:
                (following, at), stop = ahead[n], (n + 2) * STEP
            else:  # another chunk, from a boundary of this one; from its start, a longer one
                far = end - STEP // 2
                for met in [*sorted((p for p in where if p > begun), key=lambda p: abs(p - far)), begun]:
                    stop = met + FRESH if met > begun else 2 * end - begun
                    following, at = self.chunk(data, met, stop - met)
                    before = tokens[where[met] - 1] if met > begun else last
                    if before is None or self.agrees(before, following[0]):
                        break
                else:
                    raise ValueError("a piece has chunks that cannot be joined")
            run = tokens[where[begun] : where[met]] if met > begun else []
            if run:
                last = run[-1]
                yield run
            tokens, where, begun, end = following, at, met, stop
            n = begun // STEP + 1
        yield tokens[where[begun] :]

    def long(self, piece: str):
        """(ids, decoded bytes) of parts of a long piece, in order."""
        data = piece.encode()
        if data in self.ranks:
            runs = [[self.ranks[data]]]
        else:
            runs = self.stitched(data)
        held: list[int] = []
        for run in itertools.chain(runs, [None]):
            held += run or []
            if held and (run is None or len(held) > SEGMENT):
                ids = " ".join(map(str, held))
                hexed = self.decode(pa.table({"piece": pa.array([0], pa.int32()), "ids": [ids]}))["hexed"][0].as_py()
                yield ids, bytes.fromhex(hexed)
                held = []

    def known(self, pieces: list[str]):
        """(ids, decoded bytes) of learned pieces, if any, as one."""
        if pieces:
            yield " ".join(map(self.ids.__getitem__, pieces)), b"".join(map(self.bytes.__getitem__, pieces))

    def parts(self, pieces: list[str]):
        """(ids, decoded bytes) of runs of learned pieces and of parts of huge ones, in order."""
        start = 0
        for i in (*(i for i, p in enumerate(pieces) if is_huge(p)), len(pieces)):
            yield from self.known(pieces[start:i])
            if i < len(pieces):
                yield from self.long(pieces[i])
            start = i + 1


class Vocabulary:
    """The rank table for a broadcast, with the coder that a worker makes from it.

    Spark takes a broadcast from a worker whose next task does not use it, and the coder with its tables and pieces goes too.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    @functools.cached_property
    def coder(self) -> PieceCoder:
        return PieceCoder(self.ranks)


class Encoded:
    """Count and digests of one text's tokens, and with ``keep`` the tokens and bytes themselves."""

    def __init__(self, keep: bool):
        self.n, self.ids_hash, self.bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
        self.kept: tuple[list[str], list[bytes]] | None = ([], []) if keep else None

    def add(self, ids: str, decoded: bytes) -> None:
        self.ids_hash.update((f" {ids}" if self.n else ids).encode())
        self.bytes_hash.update(decoded)
        self.n += ids.count(" ") + 1
        if self.kept:
            self.kept[0].append(ids)
            self.kept[1].append(decoded)

    def row(self) -> list:
        found = [self.n, self.ids_hash.hexdigest(), self.bytes_hash.hexdigest()]
        if self.kept:
            found += [[*map(int, " ".join(self.kept[0]).split())], b"".join(self.kept[1]).decode("utf-8", "replace")]
        return found


def encode_texts(texts: list[str], split: Splitter, coder: PieceCoder, keep: bool = False):
    """``Encoded`` of each text; the pieces of a very long one are taken some at a time."""
    for part in slices(texts, TEXT_AT_ONCE):
        some = texts[part]
        if sum(map(len, some)) <= 2 * TEXT_AT_ONCE:
            every: dict[str, str] = {}  # each piece once, however often it is found
            split_texts = [[*map(every.setdefault, pieces, pieces)] for pieces in map(split, some)]
            coder.learn(every.keys())
            whole = not is_huge(max(every, key=len, default=""))
            for pieces in split_texts:
                out = Encoded(keep)
                for ids, decoded in coder.known(pieces) if whole else coder.parts(pieces):
                    out.add(ids, decoded)
                yield out
            continue
        for text in some:
            out = Encoded(keep)
            for pieces in split.some(text, PIECES_AT_ONCE):
                coder.learn(set(pieces))
                for ids, decoded in coder.parts(pieces):
                    out.add(ids, decoded)
            yield out


def tokenize(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row.

    With ``keep_ids`` the ids themselves (``array<int>``) and the decoded text come too.
    """
    small_batches(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(path)))
    out = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        out += ", ids array<int>, decoded string"
    kinds = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
    kinds = kinds if keep_ids else kinds[:3]

    def run(batches):
        split, coder = Splitter(pattern), vocabulary.value.coder
        for batch in small(gathered(batches, "text", TEXT_AT_ONCE), "text", TEXT_AT_ONCE):
            texts = [t or "" for t in batch["text"].to_pylist()]
            columns = zip(*(found.row() for found in encode_texts(texts, split, coder, keep_ids)))
            arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *arrays], ["doc_id", *(name for name, _ in kinds)])
        give_back()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, out)
