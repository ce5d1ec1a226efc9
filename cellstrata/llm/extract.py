"""Main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks: the text between two borders of block-level
elements. Each block has features of its ancestors (tags, words of class and
id) and of its text (length, link share, punctuation); a chain over the blocks
with two labels, article or not, is decoded by Viterbi. The model is trained on
labelled pages: a small set that comes with the package (below), and a bounded
sample of the table's own pages labelled where they mark their article
(``article``, ``main``). Sampled pages count twice, the second time without
those two tags, so that the other features learn too.

Inside a block white space becomes one space; character references are
decoded; blocks of the article are joined by a line feed, in page order.

Cases: a null or empty page has an empty text; text outside any element is a
block; a tag, comment or script that never ends runs to the end of the page;
end tags without a start only end a block; pages, attributes and class lists
have no greatest length; of two labellings of equal score the one with the later
blocks in the article is taken. Other columns, null URLs and repeated rows pass
through. An empty table trains on the package's pages only.
"""

from __future__ import annotations

import re
from collections.abc import Container
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cellstrata.llm.labelled import sampled

#: Elements that begin and end a block; elements without content; raw text; elements whose start ends an open p.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup html label legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td "
    "template textarea tfoot th thead title tr ul video audio iframe object canvas svg".split()
)
RAW = frozenset("script style xmp noembed noframes".split())
SAME = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "td": "td th", "th": "td th", "tr": "tr td th", "option": "option"}
KEEPS_P = frozenset("button label legend option optgroup select textarea video audio iframe object canvas svg noscript template".split())
#: Words in class and id that mark what is not the article, for labelling sampled pages.
OTHER = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs byline comment comments cookie cookies consent disqus footer header menu nav "
    "navbar navigation newsletter notice notices pagination pager popup promo promoted related respond share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar widget".split()
)
OTHER_TAGS = frozenset("aside button fieldset footer form head header label legend menu nav noscript option optgroup select template textarea title iframe svg".split())

#: An attribute's value may be quoted after its equals sign; a quote that is never closed ends nothing.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_NAMES = re.compile(r"""(?i)\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[a-z]+|[0-9]+")
_SPLIT_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block:
    __slots__ = ("text", "above", "parent", "links", "label")

    def __init__(self, text: str, above: tuple[str, ...], parent: str, links: float, label: bool):
        self.text, self.above, self.parent, self.links, self.label = text, above, parent, links, label


def leaf_blocks(html: str, known: Container[str] | None = None) -> list[Block]:
    """Blocks in page order, with features of all their ancestors; of these only the ``known`` ones, where given."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = [("", (), False)]
    parts: list[str] = []
    linked = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                tag, above, label = stack[-1]
                out.append(Block(text, above, tag, min(1.0, linked / len(text)), label))
            parts.clear()
        linked = 0

    def say(s: str) -> None:
        nonlocal linked
        if s:
            s = unescape(s) if "&" in s else s
            parts.append(s)
            if in_link:
                linked += len(s)

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        say(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(html, lt)
        if m is None:
            if re.match(r"</?[a-zA-Z]", html[lt : lt + 3]):
                break  # a tag that never ends
            say("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
                in_link = False
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            elif tag == "a":
                in_link = False
            continue
        if tag in RAW:
            end = re.compile(rf"(?i)</{tag}\b[^>]*>?").search(html, at)
            at = n if end is None else end.end()
            continue
        if tag in BLOCK:
            flush()
            in_link = False
            closes = SAME.get(tag, "").split() or ([] if tag in KEEPS_P else ["p"])
            if tag in ("li", "dt", "dd", "tr", "td", "th"):
                closes = [*closes, "p"]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in closes:
                    del stack[k:]
                    break
                if stack[k][0] not in ("p", "li", "dt", "dd", "td", "th", "tr", "option") and stack[k][0] in BLOCK:
                    break
            if m[3].endswith("/") and tag in ("svg", "iframe"):
                continue
            above = stack[-1][1]
            new = [f"t:{tag}"]
            if m[3]:
                for a, b, c in _NAMES.findall(m[3]):
                    new += [f"c:{w}" for w in _WORD.findall(_SPLIT_CASE.sub(" ", a or b or c).lower())]
            have = set(above)
            above += tuple(x for x in dict.fromkeys(new) if x not in have and (known is None or x in known))
            stack.append((tag, above, "data-article" in m[3]))
        elif tag == "a":
            in_link = True
        elif tag in ("br", "hr", "img"):
            parts.append(" ")
            if tag == "hr":
                flush()
    flush()
    return out


def features(block: Block, place: int, count: int) -> list[str]:
    t = block.text
    n = len(t)
    words = t.count(" ") + 1
    ends = t[-1] in ".!?…\"”»)"
    low = t[:120].lower()
    return [
        "bias",
        *block.above,
        f"p:{block.parent}",
        f"words:{min(words.bit_length(), 7)}",
        f"links:{int(block.links * 3.999)}",
        f"ends:{ends}",
        f"words,ends:{min(words.bit_length(), 7)},{ends}",
        f"stops:{min(t.count('.') + t.count(','), 6)}",
        f"first:{place == 0}",
        f"last:{place == count - 1}",
        *[f"says:{w}" for w in SAYS if w in low],
        *(["says:copyright"] if "©" in t or n < 60 and "all rights" in low else []),
    ]


#: Words that a block's beginning is searched for.
SAYS = ("cookie", "subscribe", "newsletter", "comment", "repl", "share", "sponsor", "advert", "related", "sign in", "log in", "privacy", "terms", "menu", "search")

#: Labelled pages: blocks of elements with data-article are the article.
LABELLED = (
    """<html><head><title>Rain on the coast</title></head><body><header><a href=/>Coast Daily</a><p>Since 1951</p></header><nav><ul><li><a href=/n>News</a><li><a href=/s>Sport</a></ul></nav><article><h1 data-article>Rain on the coast</h1><p data-article>It rained for three days, and the river rose above its banks near the old mill.</p><p data-article>Nobody was hurt.</p><aside><p>Read more: Ten storms we remember</p></aside><p data-article>Work on the wall begins in May, the council said on Monday.</p></article><section class="comments"><h3>3 comments</h3><div><p>I saw it, the water was up to my knees.</p></div><div><p>Great report, thanks.</p></div></section><footer>Copyright Coast Daily. All rights reserved. <a href=/p>Privacy</a></footer></body></html>""",
    """<body><div id="top-menu"><a href=1>Home</a> <a href=2>Shop</a> <a href=3>About us</a></div><div class="cookie-notice">We use cookies. <button>Accept</button></div><div class="content"><h2 data-article>How to mend a chair</h2><div data-article>You need glue, a clamp and a little time.</div><ul><li data-article>Clean the joint with warm water.</li><li data-article>Put glue on both parts.</li></ul><div class="ad">Chairs from 19.99! Buy now.</div><div data-article>Leave it for a night. Then it holds.</div></div><div class="sidebar"><h4>Popular posts</h4><ul><li><a href=a>Oil for tables</a></li><li><a href=b>Old lamps</a></li></ul></div><form action=/s><label>Your mail</label><input><button>Subscribe</button></form><div class="footer">Contact | Terms | Privacy</div></body>""",
    """<body><main><p data-article>The committee met on Tuesday to discuss the budget of the coming year; members agreed on most points.</p><p data-article>A second meeting follows in June.</p><div class="share"><a href=x>Share</a> <a href=y>Tweet</a></div></main><div id="comments"><p class=comment>I do not agree with this, the budget is far too small for the schools we have.</p><p class=comment>Me too.</p><form><textarea>Leave a comment</textarea></form></div></body>""",
    """<table><tr><td class=nav><a href=1>Index</a><td><h1 data-article>Notes on bees</h1><p data-article>Bees leave the hive when the sun is up and it is warm enough.</p><p data-article>They return before dusk, heavy with pollen, and dance for the others.</p></table><p class="copyright">© 2009 A. Keeper</p>""",
    """<body><div class="banner">Free delivery on all orders over 50!</div><div class="post"><h1 data-article>On slow trains</h1><p data-article>Slow trains stop everywhere. That is their charm, and their use.</p><blockquote data-article>One sees more from a slow window.</blockquote><p data-article>So I took one.</p></div><div class="related"><h3>Related posts</h3><p><a href=1>On ferries</a></p><p><a href=2>On trams</a></p></div><div class="newsletter"><p>Sign up for our newsletter and never miss a post again.</p></div></body>""",
    """<body><nav><a href=/>Home</a></nav><div class="notice">This site is for readers above 16 years of age.</div><h1 data-article>Bread</h1><p data-article>Flour, water, salt, and time; nothing else is needed for a good loaf.</p><p data-article>Bake it hot.</p><p data-article>Let it cool before you cut it, or the crumb will be wet.</p><footer><p>Written with care.</p><p>Terms and privacy</p></footer></body>""",
)


class Chain:
    """Weights by feature (for label 1 against 0), and scores of label changes ``turn[from][to]``."""

    def __init__(self, weights: dict[str, float], turn: list[list[float]], start: float):
        self.weights, self.turn, self.start = weights, turn, start

    def decode(self, blocks: list[Block]) -> list[bool]:
        """Viterbi; a tie goes to label 1."""
        if not blocks:
            return []
        weight, ((aa, ab), (ba, bb)) = self.weights.get, self.turn
        no, yes, back = 0.0, 0.0, []
        for i, block in enumerate(blocks):
            score = sum(weight(f, 0.0) for f in features(block, i, len(blocks)))
            if i == 0:
                no, yes = 0.0, self.start + score
                continue
            from_yes_no, from_yes_yes = yes + ba >= no + aa, yes + bb >= no + ab
            back.append((from_yes_no, from_yes_yes))
            no, yes = max(no + aa, yes + ba), max(no + ab, yes + bb) + score
        label = yes >= no
        labels = [label]
        for from_yes_no, from_yes_yes in reversed(back):
            label = from_yes_yes if label else from_yes_no
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[list[list[str]], list[bool]]], steps: int = 150, rate: float = 0.15, decay: float = 1e-3) -> Chain:
    """Maximum conditional likelihood, by Adam on the exact gradient (forward-backward, all pages side by side)."""
    pages = [p for p in pages if p[0]]
    index: dict[str, int] = {}
    for blocks, _ in pages:
        for f in (f for b in blocks for f in b):
            index.setdefault(f, len(index) + 1)
    n, t = len(pages), max(len(b) for b, _ in pages)
    places = [(i * t + j, f) for i, (blocks, _) in enumerate(pages) for j, f in enumerate(blocks)]
    row = np.repeat([k for k, _ in places], [len(f) for _, f in places])
    x = np.fromiter((index[k] for _, f in places for k in f), np.int64, len(row))
    y, mask = np.zeros((n, t), np.int64), np.zeros((n, t), bool)
    for i, (blocks, labels) in enumerate(pages):
        mask[i, : len(blocks)], y[i, : len(blocks)] = True, labels
    # parameters: one for each feature (from 1 on), four for turns, one for the start
    w = np.zeros(len(index) + 6)
    first, second = np.zeros_like(w), np.zeros_like(w)
    inside = mask[:, 1:]
    for step in range(1, steps + 1):
        node = np.zeros((n, t, 2))
        node[:, :, 1] = np.bincount(row, w[x], n * t).reshape(n, t)
        node[:, 0, 1] += w[-1]
        turn = w[-5:-1].reshape(2, 2)
        fwd, bwd = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        fwd[:, 0] = node[:, 0]
        for j in range(1, t):
            new = node[:, j] + np.logaddexp.reduce(fwd[:, j - 1, :, None] + turn, axis=1)
            fwd[:, j] = np.where(mask[:, j, None], new, fwd[:, j - 1])
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        for j in range(t - 2, -1, -1):
            new = np.logaddexp.reduce(turn + (node[:, j + 1] + bwd[:, j + 1])[:, None, :], axis=2)
            bwd[:, j] = np.where(mask[:, j + 1, None], new, 0.0)
        p = np.exp(fwd + bwd - z[:, None, None])[:, :, 1]
        pair = np.exp(fwd[:, :-1, :, None] + turn + (node[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * inside[:, :, None, None]
        gap = (y - p) * mask
        grad = np.bincount(x, gap.ravel()[row], len(w))
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][inside], y[:, 1:][inside]), 1)
        grad[-5:-1] = (seen - pair.sum((0, 1))).ravel()
        grad[-1] = gap[:, 0].sum()
        grad = grad / n - decay * w
        grad[0] = 0
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Chain({f: float(w[i]) for f, i in index.items()}, w[-5:-1].reshape(2, 2).tolist(), float(w[-1]))


def _own_labels(blocks: list[Block]) -> list[bool] | None:
    """Labels from the page's own article mark; None if it has none."""
    if not any("t:article" in b.above or "t:main" in b.above for b in blocks):
        return None
    return [
        ("t:article" in b.above or "t:main" in b.above)
        and not any(f[2:] in (OTHER_TAGS if f[0] == "t" else OTHER) for f in b.above)
        for b in blocks
    ]


def labelled_pages(pages: DataFrame, key: str, html: str, rows: int, chars: int, most: int = 200) -> list[tuple[list[list[str]], list[bool]]]:
    out = []
    for page in LABELLED:
        blocks = leaf_blocks(page)
        out += [([features(b, i, len(blocks)) for i, b in enumerate(blocks)], [b.label for b in blocks])] * 4
    some = pages.select(F.col(key).alias("k"), F.col(html).alias("h")).where(F.length("h").between(1, chars))
    sample = sampled(some, "k", rows, repeats=True).limit(2 * rows).collect()
    for row in sample:
        blocks = leaf_blocks(row["h"])
        labels = _own_labels(blocks)
        if labels is None or len(blocks) > most:
            continue
        full = [features(b, i, len(blocks)) for i, b in enumerate(blocks)]
        out.append((full, labels))
        out.append(([[f for f in fs if f not in ("t:article", "t:main")] for fs in full], labels))
    return out


def fit(pages: DataFrame, key: str = "page_id", html: str = "html", rows: int = 200, chars: int = 20_000, blocks: int = 200) -> Chain:
    """Train on the package's labelled pages and at most about ``rows`` pages of at most ``chars`` characters and ``blocks`` blocks."""
    return train(labelled_pages(pages, key, html, rows, chars, blocks))


def extract(pages: DataFrame, model: Chain, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` plus the main text of each, in place of a column of that name."""

    @F.arrow_udf("string")
    def main_text(batch: pa.Array) -> pa.Array:
        def one(page: str | None) -> str:
            blocks = leaf_blocks(page or "", model.weights)  # what the model does not know has no weight
            return "\n".join(b.text for b, label in zip(blocks, model.decode(blocks)) if label)

        return pa.array((one(value.as_py()) for value in batch), pa.string())

    return pages.withColumn(into, main_text(F.col(html)))


def op10_html(pages: DataFrame) -> DataFrame:
    """Main text of every page."""
    found = extract(pages.select("page_id", "url", "html"), fit(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
