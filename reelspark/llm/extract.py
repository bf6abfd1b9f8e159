"""Main-text extraction: boosted trees over DOM-node features, decoded so that no choice contradicts its ancestors'.

A page is read into block nodes and text leaves (``dom``).  Gradient-boosted trees give every node the odds that
its subtree holds text of the article.  A dropped node drops all below it; under a kept one every child is
chosen again.  The best such choice is found from the leaves up: keeping a node earns its odds and the better of the two
choices of each child, dropping it earns the odds against every node of its subtree.

No table says what the article of a page is, so the trees learn from two kinds of pages, a bounded sample in all.
Pages of the table whose own markup tells (one ``article`` or ``main`` element) are labelled by that markup.  And
texts of these pages are set again under other usual ways of marking up a page, where the label of every
part is known because it was put there.
"""

from __future__ import annotations

import html
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boost import BoostedTrees
from .common import trim, with_fields
from .dom import GROUPS, HIDDEN, TAG_GROUPS, TEXT, Pages, features, labels

#: Bounds on the training sample: pages of the table, characters of each, and pages set again.
SAMPLE_PAGES, SAMPLE_CHARS, SET_AGAIN = 300, 100_000, 700
#: Pages read together in a task.
PAGES, CHARS = 400, 1 << 21
#: Odds are held within this, so that one sure node does not outvote a whole subtree.
MOST = 4.0
SEED = 20

UNWANTED = sum(1 << k for k, g in enumerate(GROUPS) if g in ("comment", "menu", "advert", "notice", "side", "share", "form", "hidden"))
UNWANTED_TAGS = sum(1 << 16 + TAG_GROUPS[t] for t in ("nav", "footer", "aside", "form"))
HOLDERS = sum(1 << 16 + TAG_GROUPS[t] for t in ("article", "main"))


def label_by_markup(pages: Pages) -> np.ndarray | None:
    """Whether nodes of one page hold article text, as its only ``article`` or ``main`` element tells; None if none does."""
    tags = np.array(pages.tag)
    if sum(int((tags == TAG_GROUPS[t]).sum()) for t in ("article", "main")) != 1:
        return None
    above = np.array(pages.above, np.int64)
    keep = (tags == TEXT) & ((above & HOLDERS) > 0) & ((above & (UNWANTED | UNWANTED_TAGS)) == 0)
    pages.label = keep.astype(int).tolist()
    return labels(pages)


# Pages set again ------------------------------------------------------------------------------------

class Setter:
    """Writes pages whose parts carry their label, out of texts found in the sample."""

    def __init__(self, long: list[str], short: list[str], seed: int = SEED):
        self.r = random.Random(seed)
        words = sorted({w for t in long + short for w in t.split() if len(w) < 30}) or ["lorem", "ipsum", "dolor", "sit", "amet"]
        self.words, self.long, self.short = words, long, short

    def pick(self, *options):
        return self.r.choice(options)

    def sentence(self, low: int, high: int) -> str:
        return " ".join(self.r.choices(self.words, k=self.r.randint(low, high))).capitalize() + self.pick(".", ".", "", "!")

    def phrase(self) -> str:
        return html.escape(self.r.choice(self.short) if self.short and self.r.random() < 0.5 else self.sentence(1, 4))

    def prose(self) -> str:
        if self.long and self.r.random() < 0.7:
            return html.escape(self.r.choice(self.long)[:1500])
        return html.escape(" ".join(self.sentence(1, 18) for _ in range(self.r.randint(1, 4))))

    def mark(self, plain: str, *names: str) -> str:
        """An element by its own name, or a ``div``, ``section`` or the like with a class or id that says the same."""
        k = self.r.random()
        if plain and k < 0.45:
            return f"<{plain}>"
        name = self.r.choice(names) if names else ""
        name += self.pick("", "", "", "s", "-1", "-wrap", "_box", " block", " clearfix")
        return f"<{self.pick('div', 'div', 'div', 'section')} {self.pick('class', 'class', 'id')}=\"{name}\">" if name else "<div>"

    @staticmethod
    def closed(opening: str, inside: str, keep: int | None = None) -> str:
        name = opening[1:].split(">")[0].split()[0]
        if keep is not None:
            opening = opening.replace(name, f'{name} data-keep="{keep}"', 1)
        return f"{opening}{inside}</{name}>"

    def links(self, low: int = 2, high: int = 9) -> str:
        items = [f'<a href="/{k}">{self.phrase()}</a>' for k in range(self.r.randint(low, high))]
        return "<ul>" + "".join(f"<li>{a}</li>" for a in items) + "</ul>" if self.r.random() < 0.7 else self.pick(" | ", " ", " · ").join(items)

    def filler(self) -> str:
        """What a box beside the article may hold: links, a phrase, or prose as long as the article's."""
        return self.pick(self.links, self.phrase, self.prose, lambda: f"<p>{self.prose()}</p>", lambda: f"<p>{self.phrase()}</p>{self.links(1, 4)}",
                         lambda: f"<h{self.pick(2, 3, 4)}>{self.phrase()}</h3><p>{self.prose()}</p>")()

    def menu(self) -> str:
        return self.closed(self.mark("nav", "nav", "menu", "navbar", "main-nav", "navigation", "breadcrumbs", "site-menu"), self.links(), 0)

    def advert(self) -> str:
        return self.closed(self.mark("", "ad", "ads", "advert", "advertisement", "sponsored", "ad-slot", "promo", "banner", "ad-container"), self.filler(), 0)

    def notice(self) -> str:
        return self.closed(self.mark("", "cookie-notice", "cookie", "consent", "notice", "newsletter", "alert", "popup", "gdpr-banner", "subscribe", "modal"),
                           self.pick(f"<p>{self.prose()}</p>", self.prose(), self.phrase() + "<button>OK</button>"), 0)

    def form(self) -> str:
        return self.closed(self.pick("<form>", '<form class="search">', '<form id="contact">', self.mark("form", "search-form", "login", "subscribe-form")),
                           f"<label>{self.phrase()}</label><input type=text><p>{self.pick(self.phrase(), self.prose())}</p><button>Go</button>", 0)

    def aside(self) -> str:
        return self.closed(self.mark("aside", "sidebar", "side", "widget", "related", "related-posts", "recommended", "secondary", "trending"),
                           "".join(self.filler() for _ in range(self.r.randint(1, 3))), 0)

    def share(self) -> str:
        return self.closed(self.mark("", "share", "social", "sharing-buttons", "follow"), self.links(2, 5), 0)

    def header(self) -> str:
        inside = [f"<h{self.pick(1, 1, 2)}>{self.phrase()}</h1>", self.phrase(), f"<p>{self.pick(self.phrase(), self.prose())}</p>", self.menu(), self.form()]
        return self.closed(self.mark("header", "header", "masthead", "site-header", "top", "branding"), "".join(self.r.sample(inside, self.r.randint(1, 3))), 0)

    def footer(self) -> str:
        inside = self.pick(f"&copy; {self.phrase()} &middot; {self.prose()}", f"<p>&copy; {self.phrase()}</p>", self.links(), f"<p>{self.prose()}</p>{self.links()}")
        return self.closed(self.mark("footer", "footer", "site-footer", "bottom", "copyright", "colophon"), inside, 0)

    def comments(self) -> str:
        item = self.pick("<li>", '<div class="comment">', '<div class="comment-body">', "<article>", '<article class="comment">', "<p>", "<div>")
        body = "".join(self.closed(item, self.pick(f"<b>{self.phrase()}</b> {self.prose()}", f"<p>{self.prose()}</p>" if item != "<p>" else self.prose()))
                       for _ in range(self.r.randint(1, 5)))
        body = f"<h3>{self.phrase()}</h3>{body}" if self.r.random() < 0.5 else body
        body = f"<ol>{body}</ol>" if item == "<li>" else body
        return self.closed(self.mark("", "comments", "comment-list", "comments-area", "discussion", "reader-comments", "respond", "disqus_thread"),
                           body + (self.form() if self.r.random() < 0.4 else ""), 0)

    def article(self) -> str:
        out = [f"<h1>{self.phrase()}</h1>" if self.r.random() < 0.85 else ""]
        if self.r.random() < 0.15:
            out = [self.closed("<header>", out[0])]
        for _ in range(self.r.randint(1, 12)):
            out.append(self.r.choices(
                [f"<p>{self.prose()}</p>", f"<p>{self.sentence(1, 4)}</p>", f"<h{self.pick(2, 3)}>{self.phrase()}</h2>", f"<p><b>{self.phrase()}<br><p>{self.prose()}</p>",
                 "<ul>" + "".join(f"<li>{self.pick(self.phrase(), self.prose())}</li>" for _ in range(3)) + "</ul>", f"<blockquote><p>{self.prose()}</p></blockquote>",
                 f"<p>{self.phrase()} <a href=\"/x\">{self.phrase()}</a> {self.prose()}</p>", f"{self.prose()}<br><br>{self.prose()}<br>", f"<pre>{self.prose()}</pre>",
                 f"<table><tr><td>{self.phrase()}</td><td>{self.phrase()}</td></tr></table>", f"<figure><img src=x><figcaption>{self.phrase()}</figcaption></figure>",
                 f"<div>{self.prose()}</div>", f"<section><h2>{self.phrase()}</h2><p>{self.prose()}</p></section>"],
                [30, 10, 4, 5, 3, 3, 5, 3, 1, 2, 2, 5, 3])[0])
            if self.r.random() < 0.1:
                out.append(self.pick(self.advert, self.advert, self.aside, self.share, self.notice, self.form)())
        if self.r.random() < 0.25:
            out.append(self.pick(self.share, self.aside, self.comments, self.footer, lambda: self.closed("<footer>", self.phrase(), 0))())
        opening = self.pick("<article>", "<article>", self.mark("article", "post", "article", "entry-content", "post-body", "content", "story", "article-body", "text", "main-content"), "<div>")
        return self.closed(opening, "".join(out), 1)

    def page(self) -> str:
        r = self.r
        top = [f() for f in r.sample([self.header, self.menu, self.notice, self.advert, self.form, self.aside, self.share], r.randint(0, 4))]
        end = [f() for f in r.sample([self.aside, self.comments, self.comments, self.footer, self.share, self.notice, self.advert, self.menu], r.randint(0, 4))]
        body = self.article()
        if r.random() < 0.3:
            body = self.closed(self.mark("main", "main", "content", "container", "primary", "row"), "".join(r.sample(top, len(top) // 2)) + body + (self.comments() if r.random() < 0.3 else ""))
        body = "".join(top) + body + "".join(end) + (self.footer() if r.random() < 0.6 else "")
        for _ in range(r.randint(0, 2)):
            body = self.closed(self.pick("<div>", '<div id="page">', '<div class="container">', '<div class="wrapper">'), body)
        return f"<html><head><title>{self.phrase()}</title><script>x()</script></head><body>{body}" + self.pick("</body></html>", "")


def train(sample: list[str], set_again: int = SET_AGAIN, seed: int = SEED) -> BoostedTrees:
    """Fit the trees to the pages of a sample that their own markup labels, and to as many set again."""
    x, y, long, short = [], [], [], []
    for source in sample:
        one = Pages()
        one.add(source)
        found = [" ".join(t.split()) for t, g in zip(one.texts, one.tag) if g == TEXT]
        long += [t for t in found if len(t) >= 80]
        short += [t for t in found if len(t) < 80]
        told = label_by_markup(one)
        if told is not None:
            x.append(features(one))
            y.append(told)
    setter, made = Setter(long, short, seed), Pages()
    for _ in range(set_again):
        made.add(setter.page())
    x.append(features(made))
    y.append(labels(made))
    return BoostedTrees().fit(np.concatenate(x), np.concatenate(y).astype(np.float64))


# Decoding -------------------------------------------------------------------------------------------

def decode(pages: Pages, odds: np.ndarray) -> np.ndarray:
    """Keep or drop every node: the choice of the highest sum of log-probabilities in which a dropped node's subtree is dropped."""
    odds = np.clip(odds, -MOST, MOST)
    hidden = (np.array(pages.own, np.int64) & HIDDEN) > 0
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    keep[hidden] = -np.inf
    gain_keep, gain_drop = keep.tolist(), drop.tolist()
    parent, page = pages.parent, set(pages.page)
    for k in range(len(parent) - 1, -1, -1):        # children come after their parent
        if k not in page:
            p = parent[k]
            gain_keep[p] += max(gain_keep[k], gain_drop[k])
            gain_drop[p] += gain_drop[k]
    kept = np.zeros(len(parent), bool)
    for k in range(len(parent)):
        kept[k] = gain_keep[k] > gain_drop[k] and (k in page or kept[parent[k]])
    return kept


def joined(pages: Pages, kept: np.ndarray) -> list[str]:
    """The text of each page's kept leaves in page order, white space turned into single spaces."""
    out, bounds = [], [*pages.page, len(pages.parent)]
    for lo, hi in zip(bounds, bounds[1:]):
        parts, block = [], None
        for k in range(lo, hi):
            if pages.tag[k] == TEXT and kept[k]:
                if block is not None and pages.block[k] != block:
                    parts.append(" ")
                parts.append(pages.texts[k])
                block = pages.block[k]
        out.append(" ".join("".join(parts).split()))
    return out


def main_texts(sources: list[str], model: BoostedTrees) -> list[str]:
    """The main text of every page, several pages at a time."""
    out, pages, size = [], Pages(), 0
    for source in sources:
        pages.add(source)
        size += len(source)
        if len(pages.page) >= PAGES or size >= CHARS:
            out += joined(pages, decode(pages, model.raw(features(pages))))
            pages, size = Pages(), 0
    return out + (joined(pages, decode(pages, model.raw(features(pages)))) if pages.page else [])


def extract_main_text(pages: DataFrame, *, html_col: str = "html", sample_pages: int = SAMPLE_PAGES, sample_chars: int = SAMPLE_CHARS,
                      set_again: int = SET_AGAIN) -> DataFrame:
    """The input's columns without ``html_col``, then ``main_text`` (empty if there is none) and ``main_chars`` (its code points).

    The trees are fitted on the driver to the ``sample_pages`` pages of the least row hash
    among those of at most ``sample_chars`` characters, and to ``set_again`` pages set from their texts; every page is then read whole, in map tasks without a
    shuffle.  A null html is an empty page.  Equal pages give equal texts; the sample is by the rows' content, so their order and the
    number of tasks do not matter.  Columns of the input with a new column's name are replaced.  An empty table gives an empty one.
    """
    made = ("main_text", "main_chars")
    kept = [c for c in pages.columns if c != html_col and c not in made]
    source = F.col(html_col).cast("string")
    order = F.pmod(F.xxhash64(*kept, source), F.lit(1 << 40))       # of the whole row: copies of a page do not hash alike
    some = pages.where(source.isNotNull() & (F.length(source) <= sample_chars)).select(order.alias("h"), source.alias("source"))
    n = pages.count()
    if n > sample_pages:        # thin out before the ordered limit, so that all tasks together send about twice the sample
        some = some.where(F.col("h") < int((1 << 40) * min(1.0, 2 * sample_pages / n)))
    sample = some.orderBy("h").limit(sample_pages).collect()
    trees = train(sorted({r.source for r in sample}), set_again)
    rows = pages.select(F.struct(*kept).alias("row") if kept else F.lit(None).cast("int").alias("row"), F.coalesce(source, F.lit("")).alias("source"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PAGES):
                part = batch.slice(lo, PAGES)
                texts = main_texts(part.column(1).to_pylist(), trees)
                yield pa.record_batch([part.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                      names=["row", *made])
        trim()

    out = rows.mapInArrow(kernel, with_fields(rows.select("row").schema, main_text="string", main_chars="long"))
    return out.select(*[F.col("row")[c].alias(c) for c in kept], *made)
