"""Secret scan by assignment-aware lexing.

Texts are lexed for what source and configuration files write to bind a name to a value: ``name = v``, ``name: v``, ``name => v``,
``NAME=v``, declarations with types, attributes, subscripts and keys in quotes, keyword and positional arguments of calls, setters,
flags of commands, elements and attributes of XML, block values of YAML, headers and passwords in URLs.  Values are strings of all
kinds (also triple, raw, templates), bare words, names, and what operators join of them.

Names that are bound are constants of the text, wherever in it; a name in a value stands for its nearest definition before, or else the first
one after, and so on.  A binding is scored by the words of its name together with length, character classes and entropy of all
literals that reach it; those that score ``threshold`` or more mark every literal that reaches them with a span of kind ``literal``,
which covers the literal where it is written.

Three base patterns (``assign``, ``access``, ``hex``) are always reported.  Spans are in code points, the end exclusive.

Defined results: a null text counts as empty and has no spans; repeated rows get equal answers; very long texts are read whole, in time
in proportion; an empty table gives an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches

# Base patterns and the least length of what counts (group 2, or the match).
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ORDER = {"assign": 0, "access": 1, "hex": 2, "literal": 3}

# Words of names that make a name sensitive, and by how much.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "pass": 2.5, "pw": 2.5, "secret": 3, "token": 2.5, "apikey": 3, "api key": 3,
    "access key": 3, "private key": 3, "secret key": 3, "credential": 2.5, "cred": 2.5, "auth": 1.5, "authorization": 2.5, "bearer": 2.5,
    "signing key": 3, "encryption key": 3, "session key": 2.5, "master key": 3, "connection string": 2.5, "account key": 3,
}
#: Words that end in one of these are sensitive, too (``dbpassword``).
ENDINGS = ("password", "passwd", "passphrase", "apikey", "secretkey", "accesskey", "privatekey", "authtoken", "accesstoken", "clientsecret")
#: A name that ends in one of these words tells of a secret, not the secret.
ABOUT = frozenset(
    "count limit length len size type name id field label url uri path file expiry ttl prefix policy hint regex pattern min max index endpoint "
    "column header param parameter version format".split()
)
#: Calls that read a value by a name.
READERS = re.compile(r"(?i)(?:^|[._])(?:get|read|load|fetch|find|lookup|has|is|check|require|delete|remove|print|log|assert|verify|describe|input|prompt|ask)[a-z]*|env$")

STRING = r"""(?:(?<![A-Za-z0-9_])[rRbBuUfF@$]{0,2}(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|\'\'\'(?:[^\\]|\\.)*?\'\'\'|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`))"""
IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*+(?:(?:\.|->|::|-)[A-Za-z_][A-Za-z0-9_$]*+)*+"
BINDING = re.compile(
    rf"""
    (?<![A-Za-z0-9_.$-])
    (?: (?P<name>{IDENTIFIER}) | (?P<quote>["'`])(?P<key>[A-Za-z_][A-Za-z0-9_ .$-]{{0,80}}+)(?P=quote)[\x20\t]*+\]? )
    (?: [\x20\t]*+\??:[\x20\t]*+[A-Za-z_&*\[][A-Za-z0-9_.<>\[\]|&*,?'\x20]{{0,60}}?(?=[\x20\t]*=(?![=>])) | [\x20\t]++(?:\*?string|\[\]byte)(?=[\x20\t]*=) )?
    [\x20\t]*+(?: :=|=>|\+=|\?\?=|\|\|=|=(?!=)|:(?!:|//) )
    """,
    re.X,
)
ARGUMENT = re.compile(r"""[(,][\x20\t]*+(?P<quote>["'`])(?P<key>[A-Za-z_][A-Za-z0-9_.-]{0,80}+)(?P=quote)[\x20\t]*+,(?=\s*["'`A-Za-z_])""")
SETTER = re.compile(rf"""(?<![A-Za-z0-9_.$-])(?P<name>{IDENTIFIER})\((?=[\x20\t]*["'`])""")
FLAG = re.compile(r"""(?<![A-Za-z0-9_-])--(?P<name>[A-Za-z][A-Za-z0-9_-]*+)[\x20=](?!-)""")
ELEMENT = re.compile(r"""<(?P<name>[A-Za-z][A-Za-z0-9_:.-]*+)(?P<attributes>[^<>]*+)>\s*+(?P<value>[^<>\s]++)\s*+</""")
NAMED_VALUE = re.compile(r"""<[A-Za-z][^<>]*?\b(?:name|key|id)\s*=\s*["'](?P<name>[^"'<>]+)["'][^<>]*?\bvalue\s*=\s*["'](?P<value>[^"'<>]+)["']""")
KEY = re.compile(r"""\b(?:name|key|id)\s*=\s*["']([^"'<>]+)["']""")
LOGIN = re.compile(r"""://[^\s:/@"'<>]++:(?P<value>[^\s:/@"'<>]++)@""")
VARIABLE = re.compile(r"""(?m)^[\x20\t]*+ENV[\x20\t]++(?P<name>[A-Za-z_][A-Za-z0-9_]*+)[\x20\t]++(?=\S)""")

BLANK, OPEN_BLANK = re.compile(r"(?:[\x20\t]|\\\n)*+"), re.compile(r"(?:\s|\\\n)*+")
LITERAL, WRAPPED = re.compile(STRING, re.S), re.compile(rf"(?:new\x20+)?({IDENTIFIER})\(\s*+(?=[rRbBuU]?[\"'`])")
CALL = re.compile(rf"{IDENTIFIER}\([^()\n]*\)")
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""")
SCHEME, BLOCK = re.compile(r"(?:Bearer|Basic|Token)[\x20\t]++(?=\S)"), re.compile(r"[|>][+-]?[\x20\t]*\n[\x20\t]++(?=\S)")
JOIN = re.compile(r"\+|\.\.?(?=\s*[\"'`$])|\|\||\?\?|or\b|(?=[rRbBuU]?[\"'`])")
WHOLE_NAME, HOLE = re.compile(rf"(?:{IDENTIFIER})\Z"), re.compile(r"\$?\{\{?\s*([A-Za-z_][A-Za-z0-9_.]*)\s*\}?\}")
QUOTES = re.compile(r"""[rRbBuUfF@$]{0,2}("{3}|'{3}|["'`])\s*""")
PLACEHOLDER = re.compile(
    r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%[({].*|your[_-].*|change[_-]?me.*|example.*|placeholder.*|none|null|true|false|undefined|redacted.*)$"
)
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Literals of a value that are looked at for its score; all are marked.
SCORED = 64


@lru_cache(1 << 16)
def sensitivity(name: str) -> float:
    """By whole words, however they are joined: ``clientSecret``, ``client-secret`` and ``CLIENT_SECRET`` alike."""
    words = [w.lower() for w in WORD.findall(name)]
    if not words or (len(words) > 1 and words[-1] in ABOUT):
        return 0.0
    line = f" {' '.join(words)} "
    found = max((w for phrase, w in SENSITIVE.items() if f" {phrase} " in line or f" {phrase}s " in line), default=0.0)
    return max(found, 3.0 if any(w.endswith(ENDINGS) for w in words) else 0.0)


def entropy(text: str) -> float:
    counts = [text.count(c) / len(text) for c in set(text)]
    return -sum(p * math.log2(p) for p in counts)


def literal_score(literal: str, name_score: float) -> float:
    """Name, length, entropy and mixture of characters; 0 for what is no secret on its face."""
    if len(literal) < 8 or PLACEHOLDER.match(literal) or " " in literal:
        return 0.0
    kinds = sum(any(f(c) for c in literal) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in literal)
    return name_score + 0.5 * min(entropy(literal), 4.5) + 0.25 * kinds + 0.5 * (len(literal) >= 16)


@dataclass
class Binding:
    """A name with the parts of its value: (start, end, quoted) of literals, and names with where they stand."""

    at: int
    name: str
    literals: list[tuple[int, int, bool]]
    names: list[tuple[str, int, int]]
    used: list[int] = field(default_factory=list)


def inner(text: str, start: int, end: int) -> tuple[int, int]:
    """A string without its quotes and white space at its ends."""
    m = QUOTES.match(text, start, end)
    a, b = m.end(), end - len(m[1])
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


def value_at(text: str, at: int) -> tuple[list[tuple[int, int, bool]], list[tuple[str, int, int]]]:
    """Literals and names of the expression at a place."""
    literals, names, blank = [], [], BLANK
    at = blank.match(text, at).end()
    if block := BLOCK.match(text, at) or SCHEME.match(text, at):
        at = block.end()
    if text.startswith("(", at):
        blank = OPEN_BLANK
        at = blank.match(text, at + 1).end()
    while at < len(text):
        if m := LITERAL.match(text, at):
            a, b = inner(text, at, m.end())
            literals.append((a, b, True))
            names += [(h[1], h.start(), h.end()) for h in HOLE.finditer(text, a, b)]
        elif (m := WRAPPED.match(text, at)) and not READERS.search(m[1]):
            if not (m := LITERAL.match(text, m.end())):
                break
            literals.append((*inner(text, *m.span()), True))
            m = re.compile(r"\s*\)?").match(text, m.end())
        elif m := CALL.match(text, at):
            pass  # what it gives is not known, but an operator may follow
        elif m := BARE.match(text, at):
            if WHOLE_NAME.match(m[0]):
                names.append((m[0], *m.span()))
            else:
                pieces = m[0].split("+")
                if len(pieces) > 1 and all(map(WHOLE_NAME.match, pieces)):
                    for piece in pieces:
                        names.append((piece, at, at + len(piece)))
                        at += len(piece) + 1
                else:
                    literals.append((*m.span(), False))
        else:
            break
        more = JOIN.match(text, blank.match(text, m.end()).end())
        if not more:
            break
        at = blank.match(text, more.end()).end()
    return literals, names


def in_call(text: str, at: int) -> bool:
    """Whether a call's parenthesis is open before a place of its line."""
    opened = text.rfind("(", max(text.rfind("\n", 0, at), at - 200, 0), at + 1)
    return opened > 0 and (text[opened - 1].isalnum() or text[opened - 1] == "_") and ")" not in text[opened:at]


def bindings(text: str) -> list[Binding]:
    """What the text binds, in order."""
    found = []
    for m in BINDING.finditer(text):
        found.append(Binding(m.start(), m["name"] or m["key"], *value_at(text, m.end())))
    if "(" in text:
        for m in ARGUMENT.finditer(text):
            if in_call(text, m.start()):
                found.append(Binding(m.start(), m["key"], *value_at(text, OPEN_BLANK.match(text, m.end()).end())))
        for m in SETTER.finditer(text):
            if sensitivity(m["name"]) and not READERS.search(m["name"]):
                value = LITERAL.match(text, BLANK.match(text, m.end()).end())
                if value and text.startswith(")", BLANK.match(text, value.end()).end()):
                    found.append(Binding(m.start(), m["name"], [(*inner(text, *value.span()), True)], []))
    if "--" in text:
        found += [Binding(m.start(), m["name"], *value_at(text, m.end())) for m in FLAG.finditer(text)]
    if "ENV" in text:
        found += [Binding(m.start(), m["name"], *value_at(text, m.end())) for m in VARIABLE.finditer(text)]
    if "</" in text:
        for m in ELEMENT.finditer(text):
            key = KEY.search(m["attributes"])
            found.append(Binding(m.start(), key[1] if key else m["name"], [(*m.span("value"), True)], []))
    if "value" in text and "<" in text:
        found += [Binding(m.start(), m["name"], [(*m.span("value"), True)], []) for m in NAMED_VALUE.finditer(text)]
    if "://" in text:
        found += [Binding(m.start(), "password", [(*m.span("value"), True)], []) for m in LOGIN.finditer(text)]
    return sorted(found, key=lambda b: b.at)


def resolve(found: list[Binding]) -> None:
    """Ties names in values to their nearest definition before, or else the first after; others are bare words."""
    known: dict[str, list[int]] = {}
    for i, b in enumerate(found):
        known.setdefault(b.name, []).append(i)
        if (last := re.split(r"\.|->|::", b.name)[-1]) != b.name:
            known.setdefault(last, []).append(i)
    for i, b in enumerate(found):
        for name, start, end in b.names:
            where = known.get(name) or known.get(re.split(r"\.|->|::", name)[-1], [])
            where = where if where != [i] else []
            if where:
                before = bisect.bisect_left(where, i) - 1
                b.used.append(where[before] if before >= 0 else next((x for x in where if x != i), where[0]))
            elif not b.literals:
                b.literals.append((start, end, False))


def reaching(found: list[Binding]) -> list[dict]:
    """Of each binding the literals that reach it, each once; of very many the first ``SCORED``."""
    values: list[dict | None] = [None] * len(found)
    turning = True
    while turning:  # once, but for names that define each other
        turning, before, ready = False, list(values), [False] * len(found)
        for start in range(len(found)):
            todo = [start]
            while todo:
                i = todo[-1]
                b = found[i]
                later = [] if ready[i] or values[i] is ENTERED else [x for x in b.used if not ready[x] and values[x] is not ENTERED]
                if later:
                    values[i] = ENTERED
                    todo += later
                    continue
                todo.pop()
                if ready[i]:
                    continue
                parts = [before[x] if values[x] is ENTERED else values[x] for x in b.used]
                if not b.literals and len(parts) == 1 and parts[0] is not None:
                    values[i] = parts[0]
                else:
                    values[i] = dict(islice({k: None for part in (b.literals, *filter(None, parts)) for k in part}.items(), SCORED))
                ready[i] = True
                turning |= any(x is not None and x is not i and not ready[x] for x in b.used)
        turning = turning and values != before
    return values


ENTERED: dict = {}


def value_of(text: str, literals) -> str:
    """Literals joined; empty if they are bare words without digits."""
    joined = "".join(text[a:b] for a, b, _ in sorted(literals))
    return joined if any(quoted for _, _, quoted in literals) or any(c.isdigit() for c in joined) else ""


def literal_spans(text: str, threshold: float = 5.0) -> set[tuple[int, int]]:
    """Spans of literals that reach a sensitive name."""
    if not ANY.search(text):
        return set()
    found = bindings(text)
    resolve(found)
    weights = [sensitivity(b.name) for b in found]
    if not any(weights):
        return set()
    todo = []
    for i, (weight, literals) in enumerate(zip(weights, reaching(found))):
        if weight and literal_score(value_of(text, literals), weight) >= threshold:
            todo.append(i)
    marked = set(todo)
    while todo:
        for i in found[todo.pop()].used:
            if i not in marked:
                marked.add(i)
                todo.append(i)
    return {(a, b) for i in marked for a, b, _ in found[i].literals if b > a}


#: Nothing is bound in a text without a match.
ANY = re.compile(r"[=(<]|--|:|ENV")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return spans + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def written(spans) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], ORDER[s[2]], s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


def scan_text(text: str, threshold: float = 5.0) -> tuple[list, list]:
    """(base spans, spans of literals) as (start, end, kind)."""
    return base_spans(text), [(a, b, "literal") for a, b in literal_spans(text, threshold)]


def scan(docs: DataFrame, threshold: float = 5.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_literal, base_sha256, spans`` of every row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base, more = scan_text(text or "", threshold)
                kinds = [s[2] for s in base]
                rows.append(
                    (
                        *map(kinds.count, ("assign", "access", "hex")),
                        len(more),
                        hashlib.sha256(written(base).encode()).hexdigest(),
                        written(base + more),
                    )
                )
            got = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans"])
            got.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield got

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string"
    )
