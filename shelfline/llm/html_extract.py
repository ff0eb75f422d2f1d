"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A block's features are its ancestors' tags, words of their class, id and role attributes
(of all, and of the nearest ancestor that has any), and
features of its text: length, link share, closing punctuation, capitals, digits, signs of a
notice. Two labels, main and other, with transitions between neighbours. The field is
trained by gradient ascent of the conditional likelihood (forward-backward) on labelled
pages, and pages are decoded by Viterbi.

Labelled pages are made from rules (``labelled_pages``): layouts of nested elements whose
blocks' labels are known. Their number and seed are parameters; a table of real labelled
pages can be given in their place.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dom_blocks import Block, blocks_of

#: Labelled pages made for training, their seed, gradient steps, rate and weight decay.
PAGES, SEED, STEPS, RATE, DECAY = 600, 11, 160, 0.3, 3e-4

#: Tags and attribute words that tell something about a block below them.
TAGS = (
    "article", "main", "section", "aside", "nav", "header", "footer", "form", "figure", "figcaption", "table", "ul", "ol", "dl", "li", "p", "h1", "h2", "h3", "h4", "h5",
    "blockquote", "pre", "a", "button", "label", "dialog", "menu", "address", "div", "span", "td", "b", "strong", "small", "fieldset", "details",
)
GROUPS = {
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner adsense adbox dfp",
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs toolbar topbar tabs pagination pager skip",
    "side": "sidebar side aside complementary widget widgets related recommended recommendations trending popular rail more",
    "head": "header masthead top logo brand branding",
    "foot": "footer foot contentinfo copyright legal bottom colophon",
    "comment": "comment comments reply replies disqus discussion respond commentlist reviews feedback",
    "notice": "cookie cookies consent notice notices gdpr alert popup modal overlay subscribe newsletter signup paywall disclaimer",
    "share": "share sharing social follow tags meta byline author login search form",
    "content": "content article post entry story body text main page maincontent articlebody prose copy",
}
GROUP_OF = {w: g for g, ws in GROUPS.items() for w in ws.split()}
PHRASES = {
    "©": "sign", "copyright": "sign", "all rights reserved": "sign", "cookie": "notice", "privacy": "notice", "subscribe": "notice", "newsletter": "notice",
    "sign up": "notice", "log in": "notice", "advertisement": "advert", "sponsored": "advert", "read more": "more", "share": "more", "reply": "reply", "comments": "reply",
}


def _features(b: Block, n: int) -> set[str]:
    f = {f"in:{t}" for t in b.tags if t in TAGS}
    f |= {f"has:{GROUP_OF[w]}" for w in b.names if w in GROUP_OF}
    f |= {f"near:{GROUP_OF[w]}" for w in b.nearest if w in GROUP_OF}
    f.add(f"leaf:{next((t for t in reversed(b.tags) if t in TAGS), 'none')}")
    size = len(b.text)
    f.add(f"size:{min(size.bit_length(), 11)}")
    share = b.linked / size
    f.add("links:all" if share > 0.8 else "links:some" if share > 0.2 else "links:none")
    if b.text[-1] in ".!?…\"”»。！？؟۔।":
        f.add("stop")
    if size > 3 and b.text.isupper():
        f.add("capitals")
    if sum(c.isdigit() for c in b.text[:200]) > 0.2 * min(size, 200):
        f.add("digits")
    if size < 300:
        low = b.text.lower()
        f |= {f"says:{g}" for p, g in PHRASES.items() if p in low}
    if n == 1:
        f.add("only")
    return f


@functools.cache
def _names() -> dict[str, int]:
    found = ["bias", "stop", "capitals", "digits", "only", "links:all", "links:some", "links:none", "leaf:none"]
    found += [f"{k}:{t}" for k in ("in", "leaf") for t in TAGS] + [f"{k}:{g}" for k in ("has", "near") for g in GROUPS] + [f"size:{k}" for k in range(12)] + [f"says:{g}" for g in sorted(set(PHRASES.values()))]
    return {f: i for i, f in enumerate(found)}


def rows_of(blocks: list[Block]) -> list[list[int]]:
    at = _names()
    return [[0, *(at[f] for f in sorted(_features(b, len(blocks))))] for b in blocks]


class Crf:
    """Weights of features by label (other, main), and of label pairs; scores at the ends are in the features."""

    def __init__(self) -> None:
        self.w, self.t = np.zeros((len(_names()), 2)), np.zeros((2, 2))

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        flat = np.fromiter((i for r in rows for i in r), np.int64)
        cuts = np.cumsum([0, *(len(r) for r in rows)])[:-1]
        return np.add.reduceat(self.w[flat], cuts, axis=0)

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The labels of the best path; of equal ones, the one with other first."""
        if not rows:
            return []
        (t00, t01), (t10, t11) = self.t.tolist()
        back, (a, b) = [], (0.0, 0.0)
        for k, (s0, s1) in enumerate(self.scores(rows).tolist()):
            if not k:
                a, b = s0, s1
                continue
            from0, from1 = b + t10 > a + t00, b + t11 > a + t01
            back.append((from0, from1))
            a, b = s0 + (b + t10 if from0 else a + t00), s1 + (b + t11 if from1 else a + t01)
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]

    def fit(self, pages: list[tuple[list[list[int]], list[int]]]) -> "Crf":
        """Gradient ascent on all pages at once; shorter ones are padded and masked."""
        pages = [p for p in pages if p[0]]
        n, high, f = len(pages), max(len(r) for r, _ in pages), len(self.w)
        x, y, real = np.zeros((n, high, f), np.float32), np.zeros((n, high), np.int64), np.zeros((n, high), bool)
        for i, (rows, labels) in enumerate(pages):
            for k, r in enumerate(rows):
                x[i, k, r] = 1
            y[i, : len(rows)], real[i, : len(rows)] = labels, True
        hot = np.eye(2)[y] * real[:, :, None]
        pairs = (real[:, 1:] & real[:, :-1])[:, :, None, None]
        seen = (np.eye(2)[y[:, :-1]][:, :, :, None] * np.eye(2)[y[:, 1:]][:, :, None, :] * pairs).sum((0, 1))
        flat = x.reshape(-1, f)
        total = real.sum()
        gw, gt = np.zeros_like(self.w), np.zeros_like(self.t)
        for _ in range(STEPS):
            s = (flat @ self.w.astype(np.float32)).reshape(n, high, 2).astype(np.float64) * real[:, :, None]
            fwd, bwd = np.zeros_like(s), np.zeros_like(s)
            fwd[:, 0] = s[:, 0]
            for k in range(1, high):
                step = np.logaddexp(fwd[:, k - 1, 0, None] + self.t[0], fwd[:, k - 1, 1, None] + self.t[1]) + s[:, k]
                fwd[:, k] = np.where(real[:, k, None], step, fwd[:, k - 1])
            for k in range(high - 2, -1, -1):
                nxt = bwd[:, k + 1] + s[:, k + 1]
                step = np.logaddexp(self.t[:, 0] + nxt[:, 0, None], self.t[:, 1] + nxt[:, 1, None])
                bwd[:, k] = np.where(real[:, k + 1, None], step, 0)
            z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])[:, None, None]
            p = np.exp(fwd + bwd - z) * real[:, :, None]
            joint = np.exp(fwd[:, :-1, :, None] + self.t + (s + bwd)[:, 1:, None, :] - z[..., None]) * pairs
            dw = (flat.T @ (hot - p).reshape(-1, 2).astype(np.float32)) / total - DECAY * self.w
            dt = (seen - joint.sum((0, 1))) / total - DECAY * self.t
            gw, gt = gw + dw**2, gt + dt**2
            self.w += RATE * dw / (np.sqrt(gw) + 1e-9)
            self.t += RATE * dt / (np.sqrt(gt) + 1e-9)
        return self


# ------------------------------------------------------------------------------ labelled pages

#: By script: syllables, what joins words, what ends sentences. A page is in one script, half of them in the first.
_SCRIPTS = [
    ("an be co da en fi go ha in ka le mo no or pa re si ta un vi wo ya ze".split(), " ", ".!?"),
    ("на по ра со ми ве до ка ли то не сту".split(), " ", ".!?"),
    ("ال من كت با مر سا لا نو في دي".split(), " ", ".!؟"),
    ("山 水 人 大 中 日 月 木 火 土 天 心".split(), "", "。！？"),
]


def labelled_pages(n: int = PAGES, seed: int = SEED) -> Iterator[tuple[str, list[tuple[str, int]]]]:
    """Pages made from rules, each with its blocks' texts and labels (1 main) in page order."""
    rng = random.Random(seed)
    script = _SCRIPTS[0]
    word = lambda: "".join(rng.choices(script[0], k=rng.randint(1, 4)))
    words = lambda a, b: script[1].join(word() for _ in range(rng.randint(a, b)))
    said = lambda a, b: words(a, b).capitalize() + rng.choice([script[2][0]] * 6 + [*script[2][1:], ""])
    for _ in range(n):
        script = rng.choice([_SCRIPTS[0]] * 3 + _SCRIPTS[1:])
        labels: list[tuple[str, int]] = []

        def block(tag: str, text: str, label: int, attrs: str = "", link: bool = False) -> str:
            labels.append((text, label))
            return f"<{tag}{attrs}>" + (f'<a href="/x">{text}</a>' if link else text) + f"</{tag}>"

        def some(kind: str) -> str:
            name = rng.choice(GROUPS[kind].split())
            if rng.random() < 0.3:
                name += rng.choice(["-box", "-wrap", "_1", " block", "-container"])
            return f' {rng.choice(["class", "class", "id"])}="{name}"'

        def menu() -> str:
            items = "".join(block("li", words(1, 3), 0, link=True) for _ in range(rng.randint(3, 8)))
            tag = rng.choice(["nav", "nav", "div"])
            return f"<{tag}{some('menu') if tag == 'div' or rng.random() < 0.3 else ''}><ul>{items}</ul></{tag}>"

        yield _page(rng, labels, block, some, menu, said, words), labels


def _page(rng, labels, block, some, menu, said, words) -> str:
    """One page of a layout drawn at random: what surrounds, interrupts and follows an article."""

    def other(kind: str, tags: list[str], lead: list[str], most: int) -> str:
        tag = rng.choice(tags)
        attrs = "" if tag not in ("div", "section", "p", "ul") and rng.random() < 0.5 else some(kind)
        if rng.random() < 0.5:
            text = (rng.choice(lead) + said(3, 14)).strip()
            labels.append((text, 0))
            return f"<{tag}{attrs}>{text}</{tag}>"
        inner = "".join(block(rng.choice(["p", "div", "h3", "li"]), (rng.choice(lead) + said(2, 30)).strip(), 0, link=rng.random() < 0.3) for _ in range(rng.randint(1, most)))
        return f"<{tag}{attrs}>{inner}</{tag}>"

    advert = lambda: other("ad", ["div", "div", "aside", "section"], ["", "", "Sponsored: ", "Advertisement "], 2)
    notice = lambda: other("notice", ["div", "div", "section", "dialog", "form"], ["", "We use cookies. ", "Subscribe to our newsletter: "], 2)
    side = lambda: other("side", ["aside", "aside", "div"], ["", "Read more: "], 5)
    form = lambda: f"<form{some('share')}><label>{block('span', words(1, 3), 0)}</label>{block('button', words(1, 2), 0)}</form>"
    comments = lambda: other("comment", ["section", "div", "ol", "div"], ["", "", "Reply: "], 6)

    #: Where the article is: in an element that tells so, in a plain one, in none, or in a cell of a table that lays out the page.
    layout = rng.choice(["named"] * 7 + ["plain", "bare", "table"])
    wrapped, alone = rng.random() < 0.25, rng.random() < 0.12
    paragraph = rng.choice([["p"] * 8 + ["div"]] * 6 + [["div"]])
    parts = ["<body>", f"<div{some('content')}>" if wrapped else ""]
    if layout == "table":
        cells = [block("td", words(1, 3), 0, link=rng.random() < 0.7) for _ in range(rng.randint(1, 4))]
        parts.append(f"<table><tr>{''.join(cells)}</tr><tr><td>")
    elif not alone and rng.random() < 0.6:
        top = rng.choice(["header", "header", "div"])
        name = block(rng.choice(["div", "span"]), words(1, 5), 0)
        parts.append(f"<{top}{some('head') if top == 'div' or rng.random() < 0.4 else ''}>{name}</{top}>")
    if not alone and rng.random() < (0.85 if layout != "table" else 0.4):
        parts.append(menu())
    for what, share in ((advert, 0.5), (notice, 0.3), (side, 0.25), (form, 0.15)):
        if not alone and rng.random() < share:
            parts.append(what())
    tag = rng.choice(["article", "article", "article", "main", "div", "div", "section"]) if layout == "named" else "div"
    attrs = (some("content") if tag in ("div", "section") or rng.random() < 0.3 else "") if layout == "named" else ""
    opened, closed = {"table": ("</td><td>", "</td></tr><tr><td>"), "bare": ("", "")}.get(layout, (f"<{tag}{attrs}>", f"</{tag}>"))
    parts.append(opened)
    inside = rng.choice(["", "", "", "<div>", '<div class="content">']) if layout == "named" else ""
    parts.append(inside)
    if rng.random() < (0.5 if alone else 0.85):
        title = block("h1", words(2, 12).capitalize(), 1)
        parts.append(f"<header>{title}</header>" if layout == "named" and rng.random() < 0.1 else title)
    for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14, 20])):
        kind = rng.random()
        if kind < 0.08:
            parts.append(block(rng.choice(["h2", "h3"]), words(1, 7).capitalize(), 1))
        elif kind < 0.14:
            linked = rng.choice([0, 0.1, 1])
            parts.append("<ul>" + "".join(block("li", said(2, 20), 1, link=rng.random() < linked) for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind < 0.18:
            parts.append(block("blockquote", said(5, 40), 1))
        elif kind < 0.21:
            parts.append("<table>" + "".join("<tr>" + block("td", words(1, 4), 1) + block("td", words(1, 4), 1) + "</tr>" for _ in range(2)) + "</table>")
        elif kind < 0.27:
            parts.append(rng.choice([advert, notice, side])())
        elif kind < 0.35:
            parts.append(block(rng.choice(paragraph), (rng.choice(["", "", "", "Copyright. All rights reserved. ", "Read more: ", "Subscribe. "]) + said(1, 3)).strip(), 1))
        elif kind < 0.40:
            text = said(3, 60)
            labels.append((text, 1))
            parts.append(f"<p><b>{text}<br>")
        else:
            parts.append(block(rng.choice(paragraph), said(4, 120), 1))
    within = comments() if rng.random() < 0.15 else ""
    parts += [within, "</div>" if inside else "", closed]
    for what, share in ((comments, 0.35), (side, 0.3), (advert, 0.2), (form, 0.15), (notice, 0.15)):
        if not alone and rng.random() < share:
            parts.append(what())
    if layout == "table" and rng.random() < 0.6:
        parts.append(block(rng.choice(["td", "div", "p"]), rng.choice(["© ", "Copyright "]) + said(2, 10), 0))
    elif not alone and rng.random() < 0.85:
        parts.append(other("foot", ["footer", "footer", "footer", "div"], ["© ", "Copyright ", ""], 3))
    return "".join(parts) + ("</td></tr></table>" if layout == "table" else "") + ("</div>" if wrapped else "") + "</body>"


def train(pages: list[tuple[str, list[tuple[str, int]]]] | None = None) -> Crf:
    """A field trained on labelled pages (page, blocks' texts and labels); those whose blocks don't match their labels are left out."""
    known = []
    for page, labels in pages if pages is not None else labelled_pages():
        blocks = blocks_of(page)
        if [b.text for b in blocks] == [" ".join(t.split()) for t, _ in labels]:
            known.append((rows_of(blocks), [y for _, y in labels]))
    return Crf().fit(known)


def main_text(page: str | None, crf: Crf) -> str:
    blocks = blocks_of(page)
    return " ".join(b.text for b, y in zip(blocks, crf.decode(rows_of(blocks))) if y)


def extract(pages: DataFrame, crf: Crf) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    A null or empty page, and one without a main block, give the empty text. Nulls in page_id
    and url stay, rows repeat as they come, and an empty table gives none. Columns besides
    page_id, url and html are ignored. A page of any length is read whole.
    """
    shared = pages.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p.as_py(), shared.value) for p in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), train())
