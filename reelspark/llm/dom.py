"""A tolerant reading of HTML into block nodes and text leaves, and features of these nodes.

Only what text extraction needs: elements that lay out a block, or that carry a class, id or role, are nodes;
the text between two such boundaries is a leaf.  Other inline markup (``b``, ``em``, ``a`` ...) leaves no node, so
unclosed or overlapping inline tags change nothing.  Nodes are numbered in page order, so a node's
descendants are the numbers after it up to ``last``.
"""

from __future__ import annotations

import html
import re

import numpy as np

# HTML's own element categories ------------------------------------------------------
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen frame".split())
#: Elements whose content is not markup, and elements whose content no reader sees as the page's text.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style textarea title iframe noembed noframes noscript template head svg math canvas object audio "
                   "video select datalist button map".split())
IN_HEAD = frozenset("title base link meta style script noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())         # the end tag of any ends the open one
#: Start tags that end an open paragraph; start tags that end an open element of the same family.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
                   "h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre section summary table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "tbody": {"tbody", "thead"}, "tfoot": {"tbody", "thead"}}
#: An implied end does not reach beyond these.
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"},
         "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}, "p": {"table", "td", "th", "button", "caption"}}

# Words of class, id and role attributes, by what they are used for -------------------
VOCABULARY = {
    "content": "article content main post entry body text story page prose copy blog news chapter paragraph summary single primary",
    "comment": "comment comments reply replies respond disqus discussion feedback reviews guestbook thread responses commenter",
    "menu": "nav navi navigation menu menubar navbar breadcrumb breadcrumbs toc pagination pager paging tabs toolbar skip links categories",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner adsense dfp adslot affiliate "
              "outbrain taboola commercial marketing",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall toast "
              "disclaimer warning privacy dialog announcement infobar",
    "side": "sidebar side aside widget widgets related recommended recommendations trending popular rail secondary complementary tags tagcloud more "
            "teaser archive",
    "frame": "header head topbar masthead logo branding brand site footer foot bottom copyright legal colophon imprint contentinfo",
    "share": "share sharing social follow facebook twitter likes rating vote print",
    "form": "form search searchbox login register field fieldset input captcha contact poll",
    "hidden": "hidden hide invisible sr screenreader noprint",
}
GROUPS = list(VOCABULARY)
GROUP_OF = {word: 1 << k for k, words in enumerate(VOCABULARY.values()) for word in words.split()}
HIDDEN = 1 << GROUPS.index("hidden")
TAG_GROUPS = {name: k for k, names in enumerate((
    ("#text",), ("#page", "html", "body"), ("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl", "menu", "dir"), ("li", "dt", "dd"),
    ("article",), ("main",), ("section", "hgroup", "details", "summary"), ("nav",), ("header",), ("footer", "address"), ("aside", "dialog"),
    ("form", "fieldset", "legend", "input"), ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"),
    ("pre", "blockquote", "figure", "figcaption"), ("div", "center"))) for name in names}
N_TAGS = max(TAG_GROUPS.values()) + 2
OTHER, TEXT = N_TAGS - 1, TAG_GROUPS["#text"]
MARKERS = [TAG_GROUPS[t] for t in ("article", "main", "nav", "header", "footer", "aside", "form")]

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*(?:>|\Z)))", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden|itemprop|data-keep)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s>/]|\Z|$)""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
UNSEEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: What names have been found to say; forgotten when there are this many (a speed-up only).
SEEN: dict[str, int] = {}
SEEN_NAMES = 1 << 16


def groups_of(name: str) -> int:
    """What a class, id or role value says, as bits; compound words count by their first or last part."""
    if name in SEEN:
        return SEEN[name]
    found = 0
    for part in PART.findall(name):
        word = part.lower()
        bit = GROUP_OF.get(word) or GROUP_OF.get(word.removesuffix("s")) or 0
        if not bit and len(word) > 5:
            for k in range(4, len(word) - 1):
                bit |= GROUP_OF.get(word[:k], 0) | GROUP_OF.get(word[-k:], 0)
        found |= bit
    if len(SEEN) >= SEEN_NAMES:
        SEEN.clear()
    SEEN[name] = found
    return found


def attributes(text: str) -> tuple[int, str | None]:
    """(bits of class, id and role; the training label where there is one)."""
    found, label = 0, None
    for name, *value in ATTRIBUTE.findall(text):
        name, value = name.lower(), "".join(value)
        if name == "data-keep":
            label = value
        elif name == "style":
            found |= HIDDEN if UNSEEN_STYLE.search(value) else 0
        elif name in ("hidden", "aria-hidden"):
            found |= 0 if value.lower() == "false" else HIDDEN
        else:
            found |= groups_of(value)
    return found, label


class Pages:
    """The nodes of many pages one after another, as lists; ``page[k]`` is the first node of page ``k``."""

    def __init__(self):
        self.page, self.parent, self.last, self.tag, self.own, self.above = [], [], [], [], [], []
        self.depth, self.place, self.children, self.before = [], [], [], []
        self.texts, self.links, self.block, self.label = [], [], [], []

    def node(self, parent: int, tag: int, own: int, text: str = "", link: int = 0, block: int = 0, label: int = -1) -> int:
        k = len(self.parent)
        self.parent.append(parent)
        self.last.append(k)
        self.tag.append(tag)
        self.own.append(own)
        self.children.append(0)
        root = parent == k
        self.above.append(0 if root else self.above[parent] | self.own[parent] | (1 << 16 + self.tag[parent]))
        self.depth.append(0 if root else self.depth[parent] + 1)
        self.place.append(0 if root else self.children[parent])
        if not root:
            self.children[parent] += 1
        self.texts.append(text)
        self.links.append(link)
        self.block.append(block)
        self.label.append(label)
        return k

    def add(self, source: str) -> None:
        """Read one page."""
        root = len(self.parent)
        self.page.append(root)
        self.node(root, TAG_GROUPS["#page"], 0)
        stack: list[tuple[str, int, int]] = [("#page", root, -1)]       # open elements: name, node, training label
        buffer: list[str] = []
        block = linked = link_chars = 0
        unseen = 0                                                       # open elements that no reader sees
        pos, size = 0, len(source)

        def flush() -> None:
            nonlocal link_chars
            if buffer:
                text = "".join(buffer)
                buffer.clear()
                if text and not text.isspace():
                    self.node(stack[-1][1], TEXT, 0, text, min(link_chars, len(text)), block, stack[-1][2])
                elif text:
                    self.texts[-1] += " " if self.tag[-1] == TEXT and self.block[-1] == block else ""
                link_chars = 0

        def close(depth: int) -> None:
            nonlocal block, unseen
            flush()
            while len(stack) > depth:
                name, node, _ = stack.pop()
                self.last[node] = len(self.parent) - 1
                unseen -= name in UNSEEN
                block += name not in INLINE

        def close_nearest(names, barrier) -> None:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in names:
                    return close(k)
                if stack[k][0] in barrier:
                    return

        while pos < size:
            m = TAG.search(source, pos)
            end = m.start() if m else size
            if end > pos and not unseen:
                piece = source[pos:end]
                if "&" in piece:
                    piece = html.unescape(piece)
                buffer.append(piece)
                if linked:
                    link_chars += len(piece)
            if not m:
                break
            pos = m.end()
            name = m[2]
            if name is None:                                             # a comment or declaration
                continue
            name, rest = name.lower(), m[3]
            if m[1]:
                if name == "a":
                    linked = max(0, linked - 1)
                if name == "br":
                    flush()
                    block += 1
                elif name == "p" or name not in INLINE or any(s[0] == name for s in stack[-8:]):
                    close_nearest(HEADINGS if name in HEADINGS else (name,), () if name not in INLINE else ("p", "div", "li", "td", "article", "section"))
                continue
            if stack[-1][0] == "head" and name not in IN_HEAD:           # an unclosed head ends here
                close(len(stack) - 1)
            if name in RAW and name not in VOID:
                ended = re.compile(f"</{name}(?=[\\s/>])", re.I).search(source, pos)
                pos = ended.start() if ended else size
                found = ended and re.compile("[^>]*(?:>|\\Z)").match(source, pos)
                pos = found.end() if found else size
                flush()
                block += name not in ("script", "style")
                continue
            if name in VOID:
                if name in ("br", "hr", "input"):
                    flush()
                    block += 1
                    if name == "input":
                        self.node(stack[-1][1], TAG_GROUPS["input"], 0)
                continue
            own, label = attributes(rest) if len(rest) > 6 else (0, None)
            if name in INLINE:
                linked += name == "a"
                if not own and label is None or rest.endswith("/>"):
                    continue
                flush()
            else:
                if name in ENDS_P:
                    close_nearest(("p",), SCOPE["p"])
                if name in ENDS:
                    close_nearest(ENDS[name], SCOPE[name])
                flush()
                block += 1
                linked = 0 if name in ("p", "div", "article", "section", "main", "body") else linked
            if name in UNSEEN:
                unseen += 1
                stack.append((name, stack[-1][1], stack[-1][2]))
                continue
            node = self.node(stack[-1][1], TAG_GROUPS.get(name, OTHER), own)
            stack.append((name, node, stack[-1][2] if label is None else int(label)))
        close(0)


FEATURES = [*(f"tag{k}" for k in range(N_TAGS)), *(f"own_{g}" for g in GROUPS), *(f"above_{g}" for g in GROUPS),
            *(f"in{k}" for k in MARKERS), *(f"holds{k}" for k in MARKERS), "depth", "place", "place_share", "siblings", "same_tag_siblings",
            "children", "nodes", "chars", "chars_a_node", "chars_a_leaf", "link_share", "marks", "share_of_page", "position",
            "siblings_chars", "siblings_links", "parent_chars", "paragraphs", "paragraph_share", "inputs"]
MARK = re.compile(r"[.,;:!?]")


def features(pages: Pages) -> np.ndarray:
    """One row of ``FEATURES`` a node: what it and its attributes are, its subtree's density, its depth and its siblings."""
    n = len(pages.parent)
    parent, last, tag = (np.array(x, np.int64) for x in (pages.parent, pages.last, pages.tag))
    own, above = np.array(pages.own, np.int64), np.array(pages.above, np.int64)
    here = np.arange(n)

    def subtree(x: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(x)))
        return (total[last + 1] - total[here]).astype(np.float64)

    leaf = tag == TEXT
    chars = np.array([len(t) for t in pages.texts], np.int64)
    marks = np.array([len(MARK.findall(t)) for t in pages.texts], np.int64)
    s_chars, s_links, s_marks = subtree(chars), subtree(np.array(pages.links, np.int64)), subtree(marks)
    s_nodes, s_leaves, s_p = subtree(np.ones(n, np.int64)), subtree(leaf), subtree(tag == TAG_GROUPS["p"])
    in_p = subtree(np.where((above >> (16 + TAG_GROUPS["p"])) & 1, chars, 0))
    children = np.array(pages.children, np.int64)
    siblings = np.where(parent == here, 1, children[parent])
    pair = parent * N_TAGS + tag
    _, inverse, counts = np.unique(pair, return_inverse=True, return_counts=True)
    starts = np.array(pages.page, np.int64)
    first = starts[np.searchsorted(starts, here, "right") - 1]
    page_chars = np.maximum(1.0, s_chars[first])
    before = np.concatenate(([0], np.cumsum(chars)))
    rest = np.maximum(1, siblings - 1)
    one_hot = tag[:, None] == np.arange(N_TAGS)
    bits = np.arange(len(GROUPS))
    kinds = np.array([1 << 16 + k for k in MARKERS])
    holds = np.stack([subtree(tag == k) > (tag == k) for k in MARKERS], 1)
    place = np.array(pages.place, np.float64)
    columns = [np.array(pages.depth), place, place / np.maximum(1, siblings - 1), siblings, counts[inverse], children, np.log1p(s_nodes),
               np.log1p(s_chars), s_chars / s_nodes, s_chars / np.maximum(1, s_leaves), s_links / np.maximum(1, s_chars), s_marks / np.maximum(1, s_chars),
               s_chars / page_chars, (before[here] - before[first]) / page_chars, np.log1p((s_chars[parent] - s_chars) / rest),
               (s_links[parent] - s_links) / np.maximum(1, s_chars[parent] - s_chars), np.log1p(s_chars[parent]), s_p, in_p / np.maximum(1, s_chars),
               subtree(tag == TAG_GROUPS["input"])]
    return np.concatenate((one_hot, (own[:, None] >> bits) & 1, (above[:, None] >> bits) & 1, (above[:, None] & kinds) > 0, holds,
                           np.stack(columns, 1)), 1).astype(np.float32)


def labels(pages: Pages) -> np.ndarray:
    """Whether a node holds text of the article, from the labels of its leaves."""
    leaf = np.cumsum(np.concatenate(([0], np.array(pages.label) == 1)))
    return leaf[np.array(pages.last, np.int64) + 1] > leaf[:-1]
