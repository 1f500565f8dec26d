"""Main text of web pages by a tree-structured graphical model.

Every element of a page is a binary variable: does its own text belong to the article?  Log-linear
potentials score elements by tag, by words of class, id and role, and by length and link density of what they
hold; potentials on parent-child pairs tie neighbours.  Sum-product messages upward, then downward, give exact
marginals; text of elements above ``threshold`` is kept, block by block.

The model is trained by gradient ascent on the exact likelihood of labelled pages.  Those used by default are made
here by a seeded rule in many layouts; their number is a parameter.

Defined results: null or empty html gives an empty text; markup that is cut off, unclosed or unknown is read as far as
it goes, in time in proportion to its length; repeated rows get equal answers; an empty table gives an empty result.  Only the id, url and html columns
are read.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_tree import INLINE, Tree, parse
from .storage import small_batches

CONTAINERS = frozenset("div section article main body html td table tbody tr ul ol dl center #root".split())
BOUNDS = frozenset("nav header footer aside form menu dialog address button fieldset".split())
NAME_WORDS = re.compile(r"[a-z]+")


TOPS = frozenset("#root html body".split())


def group(tag: str) -> int:
    """Parent-child potentials are shared by kind of child, and apart for children of a page's top."""
    return 0 if tag in INLINE else 1 if tag in CONTAINERS else 2 if tag in BOUNDS else 3


def clipped_exp(x: float) -> float:
    return math.exp(min(max(x, -60.0), 60.0))


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)  # "tag:p", "name:menu", "size:12"
    pairs: list[list[float]] = field(default_factory=lambda: [[0.0] * 4 for _ in range(8)])  # by group: 00 01 10 11 (parent, child)
    seen: dict[tuple[str, str], tuple[float, int]] = field(default_factory=dict, repr=False)

    def fixed(self, tag: str, names: str) -> tuple[float, int]:
        """Score of tag and names, and the group; kept for a while as few kinds make up most elements."""
        key = (tag, names)
        if key not in self.seen:
            if len(self.seen) > 50_000:
                self.seen.clear()
            self.seen[key] = sum(self.words.get(f, 0.0) for f in name_features(tag, names)), group(tag)
        return self.seen[key]


def name_features(tag: str, names: str) -> list[str]:
    return ["bias", f"tag:{tag}", *(f"name:{w}" for w in sorted(set(NAME_WORDS.findall(names))))]


def size_features(tree: Tree) -> list[tuple[str, ...]]:
    """Of each element: length of all text below with how much of it is in links, its own text, its share of the page's."""
    total, linked = list(tree.lengths), [0] * len(tree.tags)
    for i in range(len(total) - 1, 0, -1):
        if tree.tags[i] == "a":
            linked[i] = total[i]
        p = tree.parents[i]
        total[p] += total[i]
        linked[p] += linked[i]
    steps = [0 if not k else 1 if k < 0.3 * n else 2 if k < 0.7 * n else 3 for n, k in zip(total, linked)]
    free = max(total[0] - linked[0], 1)
    of_page = lambda n: (n > 0.03 * free) + (n > 0.15 * free) + (n > 0.4 * free) + (n > 0.8 * free)
    return [
        (
            f"size:{min(n.bit_length(), 10) // 2}:{step}",
            f"own:{min(own.bit_length(), 8) // 2}:{step}",
            f"share:{of_page(n - k)}:{of_page(own)}:{group(tag)}",
        )
        for n, k, own, step, tag in zip(total, linked, tree.lengths, steps, tree.tags)
    ]


def sum_product(tree: Tree, model: Model):
    """Odds: own with all below, messages to parents, all; with exponentials of the pair potentials by group."""
    parents = tree.parents
    tables = [[clipped_exp(x) for x in t] for t in model.pairs]
    groups, below = [], []
    weight = model.words.get
    for tag, names, (size, own, share) in zip(tree.tags, tree.names, size_features(tree)):
        score, kind = model.fixed(tag, names)
        groups.append(kind + 4 * (tree.tags[parents[len(groups)]] in TOPS))
        below.append(clipped_exp(score + weight(size, 0.0) + weight(own, 0.0) + weight(share, 0.0)))
    up = [1.0] * len(below)
    for i in range(len(below) - 1, 0, -1):
        p00, p01, p10, p11 = tables[groups[i]]
        b = min(max(below[i], 1e-25), 1e25)
        below[i] = b
        up[i] = (p10 + p11 * b) / (p00 + p01 * b)
        below[parents[i]] = min(max(below[parents[i]] * up[i], 1e-25), 1e25)
    every = list(below)
    for i in range(1, len(below)):
        p00, p01, p10, p11 = tables[groups[i]]
        o = every[parents[i]] / up[i]
        every[i] = min(max(below[i] * (p01 + p11 * o) / (p00 + p10 * o), 1e-25), 1e25)
    return below, up, every, groups, tables


def extract(page: str, model: Model, threshold: float = 0.5) -> str:
    """The main text of one page."""
    tree = parse(page)
    odds = sum_product(tree, model)[2]
    least = threshold / (1 - threshold)
    blocks: list[str] = []
    parts: list[str] = []
    last = -1
    for element, block, text in tree.chunks:
        if odds[element] > least:
            if block != last and parts:
                blocks.append("".join(parts))
                parts = []
            last = block
            parts.append(text)
    blocks.append("".join(parts))
    return " ".join(" ".join(blocks).split())


LABEL = re.compile(r"label-(yes|no)")


#: A labelled page without a body starts with this if what lies at its top is article.
TOP_MARK = "<!--label-yes-->"


def labels_of(tree: Tree, top: bool = False) -> list[bool]:
    """What ``label-yes`` and ``label-no`` say, inherited downward; takes the marks out of the names."""
    labels: list[bool] = []
    for i, names in enumerate(tree.names):
        mark = LABEL.search(names)
        labels.append(mark[1] == "yes" if mark else labels[tree.parents[i]] if i else top)
    tree.names = [LABEL.sub("", names).strip() for names in tree.names]
    return labels


def train(pages: list[str], rounds: int = 160, rate: float = 0.12, at_once: int = 200) -> Model:
    """Fit to labelled pages: gradient ascent on the likelihood of ``at_once`` of them in turn, with exact marginals."""
    model = Model()
    data = []
    for page in pages:
        tree = parse(page)
        labels = labels_of(tree, page.startswith(TOP_MARK))
        features = [[*name_features(t, n), *s] for t, n, s in zip(tree.tags, tree.names, size_features(tree))]
        data.append((tree, labels, features))
    squares: dict = {}
    for k in range(rounds):
        model.seen.clear()
        pace = rate * (1 - k / rounds)
        step: dict = {}
        for tree, labels, features in (data[(k * at_once + i) % len(data)] for i in range(min(at_once, len(data)))):
            below, up, every, groups, tables = sum_product(tree, model)
            for i, label in enumerate(labels):
                error = label - every[i] / (1 + every[i])
                for f in features[i]:
                    step[f] = step.get(f, 0.0) + error
                if i:
                    o = every[tree.parents[i]] / up[i]
                    joint = [a * b for a, b in zip(tables[groups[i]], (1.0, below[i], o, o * below[i]))]
                    total = sum(joint)
                    truth = 2 * labels[tree.parents[i]] + label
                    for pair in range(4):
                        key = (groups[i], pair)
                        step[key] = step.get(key, 0.0) + (pair == truth) - joint[pair] / total
        for key, g in step.items():
            now = model.pairs[key[0]][key[1]] if isinstance(key, tuple) else model.words.get(key, 0.0)
            g -= 0.01 * now
            squares[key] = 0.9 * squares.get(key, g * g) + 0.1 * g * g + 1e-6
            now += pace * g / math.sqrt(squares[key])
            if isinstance(key, tuple):
                model.pairs[key[0]][key[1]] = now
            else:
                model.words[key] = now
    model.seen.clear()
    return model


# What labelled pages are made of: names by which sites mark their parts.
MENUS = "menu nav navbar navigation breadcrumb breadcrumbs topnav mainmenu tabs pagination toc".split()
HEADS = "header masthead topbar branding site-header page-header logo".split()
FEET = "footer site-footer copyright bottom colophon legal foot".split()
SIDES = "sidebar side widget related right-column recommended rail more trending tags".split()
NOTICES = "notice alert cookie consent banner cookie-banner gdpr popup modal message newsletter subscribe paywall disclaimer".split()
ADVERTS = "ad ads advert advertisement sponsored promo ad-slot adsbox adsense promotion sponsor".split()
COMMENTS = "comments comment comment-list responses disqus discussion replies reply respond reader-comments user-comments".split()
SHARES = "share social share-bar sharing author-box tools".split()
MAINS = "content main article post entry story body article-body entry-content post-content main-content text single blog news page".split()
#: What names of parts are made longer by; they say nothing.
BOXES = "wrapper inner container box wrap area block section outer col row holder".split()


def labelled_pages(n: int = 800, seed: int = 17) -> list[str]:
    """Pages in many layouts; class words ``label-yes`` and ``label-no`` say what each part is.

    Articles are in elements that say so, or in elements that do not, or lie plainly in the body, as elements or as bare text, from a
    few words to pages long; heads, bodies and paragraphs may be left open.
    """
    rng = random.Random(seed)
    syllables = "lo mi ra ten sor ka vi del pan tu re o an est".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def words(a: int, b: int) -> str:
        """From ``a`` to ``b`` words, short more often than long."""
        return " ".join(word() for _ in range(round(a * (b / a) ** rng.random())))

    def tag(name: str, inner: str, label: str = "", names: str = "") -> str:
        key = rng.choice(["class", "class", "id"]) if names else "class"
        if names and rng.random() < 0.3:
            names = f"{names}{rng.choice('-_ ')}{rng.choice(BOXES)}" if rng.random() < 0.8 else f"{rng.choice(BOXES)}-{names}"
        mark = f"label-{label}" if label else ""
        other = f' {key}="{names}"' if names else ""
        return f'<{name}{other} role="{mark}">{inner}</{name}>' if mark else f"<{name}{other}>{inner}</{name}>"

    def links() -> str:
        return "".join(tag("li", f'<a href="/{word()}">{words(1, 3)}</a>') for _ in range(rng.randint(2, 8)))

    def paragraph() -> str:
        text = words(1, 400)
        if rng.random() < 0.3:
            text += f" {rng.choice(['<b>', '<i>', '<em>', '<strong>'])}{words(1, 6)} " if rng.random() < 0.3 else f" <a href='/x'>{words(1, 3)}</a> {words(1, 20)}"
        if rng.random() < 0.15:
            text = f"<b>{text}<br>"
        return f"<p>{text}" if rng.random() < 0.15 else f"<p>{text}</p>"

    def noise(kinds: list[str], most: int) -> str:
        out = []
        for _ in range(rng.randint(0, most)):
            kind = rng.choice(kinds)
            text = words(2, 30) if rng.random() < 0.6 else "".join(paragraph() for _ in range(rng.randint(1, 3)))
            if kind == "menu":
                inner = f"<ul>{links()}</ul>"
                out.append(tag("nav", inner, "no") if rng.random() < 0.5 else tag(rng.choice(["div", "ul", "section"]), links(), "no", rng.choice(MENUS)))
            elif kind == "head":
                inner = rng.choice([f"<h1>{words(1, 4)}</h1>", f"<a href='/'>{words(1, 2)}</a><p>{words(2, 8)}</p>", text])
                out.append(tag("header", inner, "no") if rng.random() < 0.5 else tag("div", inner, "no", rng.choice(HEADS)))
            elif kind == "foot":
                inner = rng.choice([f"&copy; {text}", f"<p>{words(2, 12)}</p><ul>{links()}</ul>", text])
                out.append(tag("footer", inner, "no") if rng.random() < 0.6 else tag("div", inner, "no", rng.choice(FEET)))
            elif kind == "side":
                inner = rng.choice([f"<h3>{words(1, 4)}</h3><ul>{links()}</ul>", f"<h2>{words(1, 3)}</h2>{text}", text])
                out.append(tag("aside", inner, "no", rng.choice(["", *SIDES])) if rng.random() < 0.5 else tag(rng.choice(["div", "section"]), inner, "no", rng.choice(SIDES)))
            elif kind == "form":
                inner = f"<label>{words(1, 4)}</label><input name='q'><p>{words(2, 15)}</p><button>{words(1, 2)}</button>"
                out.append(tag("form", inner, "no", rng.choice(["", "search", "signup", "login"])))
            elif kind == "comment":
                inner = "".join(tag(rng.choice(["div", "li", "p"]), rng.choice([text, paragraph()]), "no", rng.choice(["", "comment", "reply"])) for _ in range(rng.randint(1, 4)))
                out.append(tag(rng.choice(["div", "section", "ol"]), f"<h3>{words(1, 3)}</h3>{inner}", "no", rng.choice(COMMENTS)))
            else:
                names = {"notice": NOTICES, "advert": ADVERTS, "share": SHARES}[kind]
                out.append(tag(rng.choice(["div", "div", "p", "section", "aside", "ins" if kind == "advert" else "div"]), text, "no", rng.choice(names)))
        return "".join(out)

    def lines() -> str:
        """Bare text."""
        return rng.choice(["<br>", "<br><br>", "\n", "<br/>\n"]).join(words(3, 250) for _ in range(rng.randint(1, 6)))

    def piece() -> str:
        k = rng.random()
        if k < 0.72:
            return paragraph()
        if k < 0.8:
            return f"<h2>{words(1, 6)}</h2>"
        if k < 0.86:
            return f"<{(t := rng.choice(['ul', 'ol']))}>" + "".join(f"<li>{words(1, 20)}</li>" for _ in range(3)) + f"</{t}>"
        if k < 0.9:
            return f"<blockquote><p>{words(5, 30)}</p></blockquote>"
        if k < 0.93:
            return "<table>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr>" for _ in range(3)) + "</table>"
        if k < 0.95:
            return f"<figure><img src='x'><figcaption>{words(2, 12)}</figcaption></figure>"
        if k < 0.97:
            return f"<pre>{words(3, 60)}</pre>"
        return f"<div>{words(5, 300)}</div>"

    def body(bare: bool = True) -> str:
        k = rng.random()
        if k < 0.25:  # a very short article
            return f"<h1>{words(1, 8)}</h1><p>{words(1, 10)}</p>" if rng.random() < 0.5 else f"<p>{words(1, 12)}</p><p>{words(1, 12)}"
        if k < 0.35:
            return f"<p>{words(20, 400)}</p>"
        if k < 0.45 and bare:
            return (f"<h1>{words(2, 10)}</h1>" if rng.random() < 0.5 else "") + lines()
        out = [f"<h1>{words(2, 10)}</h1>"] if rng.random() < 0.8 else []
        if rng.random() < 0.15:
            out = [tag("header", f"<h1>{words(2, 10)}</h1><p>{words(2, 8)}</p>", "no", rng.choice(["", "", "entry-header"]))]
        out += [piece() for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.2:
            out.insert(rng.randint(0, len(out)), noise(["advert", "side", "share", "form", "notice"], 1))
        if rng.random() < 0.2:
            out.append(tag("footer", words(2, 12), "no"))
        return "".join(out)

    pages = []
    for _ in range(n):
        k = rng.random()
        names = rng.choice(["", "", *MAINS])
        plain = k >= 0.65
        if k < 0.25:
            main = tag("article", body(), "yes", names)
        elif k < 0.33:
            main = tag("main", tag("article", body()) + noise(["comment", "side"], 1), "yes")
        elif k < 0.4:
            main = tag("main", body(), "yes", names)
        elif k < 0.65:
            main = tag(rng.choice(["div", "section", "div", "td"]), body(), "yes", rng.choice(MAINS))
        elif k < 0.72:
            main = tag(rng.choice(["div", "td", "center"]), body(), "yes")
        elif k < 0.88:
            main = body(False)
        else:
            main = body() if rng.random() < 0.4 else lines()
        if rng.random() < 0.08 and k < 0.88:
            main = tag(rng.choice(["font", "span", "div"]), main, "yes")
        for _ in range(rng.choice([0, 0, 0, 0, 1, 2, 3])):  # boxes around the article alone
            main = tag("div", main, "yes", rng.choice(["", *BOXES])) if 0.4 <= k < 0.72 or k < 0.15 else main
        few = rng.random() < (0.5 if plain else 0.35)
        none = few and rng.random() < 0.4
        before = "" if none else noise(["menu", "head", "notice", "advert", "form"], 1 if few else 4)
        after = "" if none else noise(["side", "comment", "advert", "form", "share", "menu", "notice"], 1 if few else 4) + noise(["foot"], 1 if few else 2)
        whole = before + main + after
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2]) if not plain else 0):
            whole = tag("div", whole, "yes" if none else "no", rng.choice(["", "wrapper", "container", "page", "site", *BOXES]))
        label = 'role="label-yes"' if k >= 0.72 else 'role="label-no"'
        title = f"<title>{words(2, 6)}</title>"
        head = rng.choice([f"<html><head>{title}</head>", f"<html><head>{title}</head>", f"<html><head>{title}", f"<!doctype html>{title}", "<html>"])
        if k >= 0.72 and rng.random() < 0.25:  # neither html nor body
            bare = "" if k < 0.88 or rng.random() < 0.5 else rng.choice([lines(), words(10, 400)])
            pages.append(TOP_MARK + (bare or rng.choice([f"<head>{title}", f"<head>{title}</head>", title, "", "<!doctype html>"]) + whole))
            continue
        pages.append(f"{head}<body {label}>{whole}" + rng.choice(["</body></html>", "</body></html>", ""]))
    return pages


@lru_cache(1)
def default_model() -> Model:
    """Fitted once in a process."""
    return train(labelled_pages())


def extract_pages(
    pages: DataFrame,
    model: Model | None = None,
    threshold: float = 0.5,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        fitted = shared.value
        for batch in batches:
            texts = [extract(h, fitted, threshold) if h else "" for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [*map(len, texts)]})

    columns = (F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return pages.select(*columns).mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")
