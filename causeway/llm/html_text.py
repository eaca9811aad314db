"""HTML extraction by a tree-structured graphical model.

A page is parsed into a tree of elements. Every element is a node with a hidden state, boilerplate or content; what is
seen at it (tag, class and id words, amount of text, share of link text, punctuation, place) has a probability under
each state, and each child's state depends on its parent's. Sum-product messages go up the tree and down again and
give each node's marginal probability of content, exactly, as a tree has no loops. Text belongs to its nearest element
and is kept where that element's marginal is at least one half. Potentials are counted on labelled pages
(labelled_pages), where content elements carry data-keep; adding pages there retrains the model.

A name is read as a whole: its last word says what it is (post-comments), others qualify it (related-article); what
comes after `with` or `has`, or under a taxonomy (category-social, tag-comments), says what an element has or is about;
names that end in a state (sharing-enabled, sidebar-none) and those of html and body tell nothing.

Place is that relative to the smallest block around the page's headline, where that holds a good part of its text.

Tags that never hold text to read (scripts, styles, forms, ...) are boilerplate. Siblings aren't independent witnesses,
so that what their plain tags and amounts of text tell is shared out among them: sixty long comments say no more than
two. Blocks are joined in page order by a newline; white space inside a block becomes one blank; character references
are decoded.

Defined cases: a null or empty page has the text ''; a page cut off anywhere is read as far as it goes, an unfinished
tag at its end is dropped; unclosed and stray tags are mended; a page without markup is content; repeated rows and null
ids are kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import labelled_pages
from .tables import own

SCHEMA = "page_id long, url string, text string, n_chars long"
#: How HTML treats tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select option math canvas".split())
NEVER = RAW | frozenset("head button form fieldset datalist dialog label legend".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
#: A start tag of the key closes open elements of the values, up to the nearest block that is neither.
CLOSES = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
CLOSES |= {t: {"p"} for t in BLOCK - CLOSES.keys() - {"html", "body"}}
#: Words of class, id and role that tell boilerplate from content.
BAD_WORDS = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo promotion nav navigation navbar menu menubar "
    "breadcrumb breadcrumbs sidebar widget widgets footer foot masthead cookie cookies consent notice "
    "notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended "
    "comment comments reply replies respond disqus reader readers discussion form search pagination pager toolbar "
    "legal copyright disclaimer tags rss skip complementary contentinfo paywall gdpr feedback".split()
)
HEAD_WORDS = frozenset("header head top".split())
LAYOUT_WORDS = frozenset("row col left right side template grid".split())
#: Words of names that say what an element has, not what it is: nothing from there on counts.
HAVING_WORDS = frozenset("no not non without has have with is and layout".split())
#: Last words of names that say in what state something is.
STATE_WORDS = frozenset("open closed enabled disabled on off none free active loaded ready visible".split())
#: First words of names that file an element under a subject, and what may follow them in names of lists of subjects.
SUBJECT_WORDS = frozenset("category cat tag topic term type status format js".split())
SUBJECT_LISTS = frozenset("list lists cloud links menu nav cell bar widget box".split())
GOOD_WORDS = frozenset(
    "article articlebody articletext story storybody main content contents entry post posttext body text prose page "
    "maincontent".split()
)
#: Quotes count after an equals sign only, and only where they are closed.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
#: The end tags of elements of raw text, found without regard to what looks like tags or quotes before them.
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "textarea", "title", "iframe")}
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACES = re.compile(r"\s+")


def told(words: list[str]) -> str | None:
    """What one name says: bad, good, mixed (good, qualified by a word of boilerplate), head, layout, other; or nothing."""
    for k, w in enumerate(words):
        if w in HAVING_WORDS:
            words = words[:k]
            break
    if not words or words[-1] in STATE_WORDS:
        return None
    if words[0] in SUBJECT_WORDS and len(words) > 1 and words[1] not in SUBJECT_LISTS:
        return None
    bad, good = not BAD_WORDS.isdisjoint(words), not GOOD_WORDS.isdisjoint(words)
    if bad and not LAYOUT_WORDS.isdisjoint(words):
        return "layout"
    if bad:
        return "mixed" if good and words[-1] in GOOD_WORDS else "bad"
    if not HEAD_WORDS.isdisjoint(words):
        return "good head" if not (GOOD_WORDS - {"page"}).isdisjoint(words) else "head"  # a page's head may be the site's
    return "good" if good else "other"


@lru_cache(1 << 14)
def naming(attrs: str) -> tuple[int, bool]:
    """(kind of the names in the attributes of a tag, whether it is labelled as content)."""
    said = set()
    for name, *values in _ATTR.findall(attrs):
        if name.lower() in ("class", "id", "role"):
            said |= {told([w.lower() for w in _WORD.findall(token)]) for token in "".join(values).split()}
    good = "good" in said or "good head" in said
    if "bad" in said or "mixed" in said:
        kind = 3 if good or "bad" not in said else 1
    elif "layout" in said:
        kind = 2 if good else 4
    elif "head" in said or "good head" in said:
        kind = 6 if good else 5
    else:
        kind = 2 if good else 7 if "other" in said else 0
    return kind, "data-keep" in attrs


class Node:
    """An element: its place in the tree and what is seen at it."""

    __slots__ = ("tag", "parent", "kind", "keep", "text", "link", "marks", "children", "anchor")

    def __init__(self, tag: str, parent: int, attrs: str, anchor: int) -> None:
        self.tag, self.parent, self.anchor = tag, parent, anchor
        self.kind, self.keep = naming(attrs) if attrs and not attrs.isspace() else (0, False)
        self.text = self.link = self.marks = self.children = 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str | None]]]:
    """The elements in page order (0 is the root) and the run of texts and block ends: (element, text) or
    (element, None) where a block begins or ends."""
    nodes, run, stack = [Node("#root", -1, "", -1)], [], [0]
    at, look = 0, 0
    while m := _TAG.search(page, look):
        closing, name = m[1], m[2]
        look = m.end()
        if m.start() > at and page[at : m.start()]:
            run.append((stack[-1], page[at : m.start()]))
        at = m.end()
        if not name or not m[4]:  # a comment, a declaration, or a tag the page's end cut off
            continue
        tag = name.lower()
        if tag in BLOCK or tag == "br":
            run.append((stack[-1], " " if tag == "br" else None))
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[k]].tag
                if open_tag == tag:
                    del stack[k:]
                    break
                if tag not in BLOCK and open_tag in BLOCK:  # a stray inline end doesn't close blocks
                    break
            continue
        shut = CLOSES.get(tag)
        if shut:
            # inline elements between the block to close and the top go with it
            for k in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[k]].tag
                if open_tag in shut:
                    del stack[k:]
                elif open_tag in BLOCK:
                    break
        top = nodes[stack[-1]]
        nodes.append(Node(tag, stack[-1], m[3], len(nodes) if tag == "a" else top.anchor))
        nodes[stack[-1]].children += 1
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(len(nodes) - 1)
            if tag in _ENDS:  # inside an element of raw text only its own end tag counts
                end = _ENDS[tag].search(page, at)
                look = end.start() if end else len(page)
        elif tag in VOID:
            nodes.pop() if nodes[-1].children == 0 else None
    if at < len(page):
        run.append((stack[-1], page[at:]))
    for k, text in run:
        if text:
            node = nodes[k]
            n = len(text)
            node.text += n
            node.marks += text.count(".") + text.count(",")
            if node.anchor >= 0:
                node.link += n
    return nodes, run


def observed(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """(feature values [node, feature], parents). Each feature is a small number."""
    parent = np.array([n.parent for n in nodes])
    text = np.array([n.text for n in nodes], float)
    link = np.array([n.link for n in nodes], float)
    marks = np.array([n.marks for n in nodes], float)
    for k in range(len(nodes) - 1, 0, -1):  # sums over subtrees
        p = parent[k]
        text[p] += text[k]
        link[p] += link[k]
        marks[p] += marks[k]
    share = link / np.maximum(text, 1)
    titled = set()  # elements with a headline of the first order
    for k, n in enumerate(nodes):
        while n.tag == "h1" and k > 0 and parent[k] not in titled:
            k = int(parent[k])
            titled.add(k)
    out = np.zeros((len(nodes), len(SIZES)), np.int64)
    for k, n in enumerate(nodes):
        out[k, 0] = KINDS.get(n.tag, 0)
        out[k, 1] = n.kind if out[k, 0] != KINDS["body"] else 0
        if out[k, 0] == KINDS["header"] and k not in titled:
            out[k, 0] = BARE_HEADER
        if 5 <= n.kind <= 6:  # names of a header: what it holds tells whose
            out[k, 1] = 6 if k in titled else 9 if n.kind == 6 else 5
        elif n.kind in (1, 3) and k in titled:  # a name of boilerplate on what holds the headline
            out[k, 1] = 8
    out[:, 2] = np.digitize(text, (1, 25, 80, 300))
    out[:, 3] = np.digitize(share, (0.01, 0.3, 0.7))
    out[:, 4] = np.digitize(marks / np.maximum(text, 1), (0.002, 0.02))
    for k in range(1, len(nodes)):  # amounts mean something for blocks; an inline element has those of its block
        if out[k, 0] in INLINE and parent[k] > 0:
            out[k, 2:5] = out[parent[k], 2:5]
    out[:, 5] = placed(nodes, parent, text)
    return out, parent


def placed(nodes: list[Node], parent: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Each node's place relative to the block around the headline: 1 around it or itself, 2 before, 3 inside,
    4 after. Where that block is the whole page or holds little of its text, only what comes before the headline has a
    place; where there is no headline, or several, nothing has (0)."""
    out = np.zeros(len(nodes), np.int64)
    heads = [k for k, n in enumerate(nodes) if n.tag == "h1"]
    if len(heads) != 1:
        return out
    head = heads[0]
    main = top = int(parent[head])
    while main > 0 and (KINDS.get(nodes[main].tag) in (*INLINE, KINDS["header"]) or 5 <= nodes[main].kind <= 6):
        main = int(parent[main])
    if main <= 0 or nodes[main].tag in ("html", "body") or text[main] < 0.25 * text[0]:
        out[:head] = 2
        while top >= 0:
            out[top] = 0
            top = int(parent[top])
        return out
    end = main + 1  # nodes are in page order: what is inside follows in one run
    while end < len(nodes) and parent[end] >= main:
        end += 1
    out[:main], out[main:end], out[end:] = 2, 3, 4
    while main >= 0:
        out[main] = 1
        main = int(parent[main])
    return out


_GROUPS = (
    "#root html body", "p", "h1 h2 h3 h4 h5 h6", "article main", "div section center", "span b i em strong u font small "
    "code sub sup mark q cite abbr time", "a", "ul ol dl li dt dd", "nav menu", "aside", "footer", "header hgroup",
    " ".join(sorted(NEVER)), "table tbody thead tfoot tr td th caption", "blockquote pre figure figcaption details "
    "summary address",
)
KINDS = {tag: k + 1 for k, tags in enumerate(_GROUPS) for tag in tags.split()}
INLINE = KINDS["span"], KINDS["a"]
BARE_HEADER = len(_GROUPS) + 1
SIZES = (len(_GROUPS) + 2, 10, 5, 4, 3, 5)
#: How much each kind of evidence counts: tag, names and place tell more than amounts of text.
POWER = (1.5, 1.6, 0.5, 0.7, 0.4, 1.0)
#: Siblings look alike for one reason: what their amounts of text and plain tags tell counts for about so many of them.
SIBLINGS = 2.0
PLAIN = tuple(KINDS[t] for t in ("p", "h1", "span", "a", "ul", "table")) + (0,)
PLAIN_POWER = 0.4
#: The log-odds against content of elements that hold no text to read.
NEVER_LOG = 50.0


class Potentials:
    """Log-probabilities of what is seen under each state, of a child's state given its parent's, and of the root's."""

    def __init__(self, pages: tuple[str, ...] | None = None) -> None:
        seen = [np.full((2, n), 0.5) for n in SIZES]
        pairs = np.array([[1.0, 0.05], [1.0, 1.0]])  # parent, child: below boilerplate hardly anything is content
        for page in labelled_pages.training() if pages is None else pages:
            nodes, _ = parse(page)
            values, parent = observed(nodes)
            keep = [n.keep for n in nodes]
            for k in range(len(nodes) - 1, 0, -1):  # what holds content is no boilerplate
                if keep[k]:
                    keep[parent[k]] = True
            state = np.array(keep, int)
            for f, table in enumerate(seen):
                np.add.at(table, (state, values[:, f]), 1)
            np.add.at(pairs, (state[parent[1:]], state[1:]), 1)
        self.seen = [np.log(t / t.sum(1, keepdims=True)) * w for t, w in zip(seen, POWER, strict=True)]
        self.pairs = np.log(pairs / pairs.sum(1, keepdims=True))
        self.root = np.log(np.array([0.05, 0.95]))

    def evidence(self, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
        """(log-probability of what is seen at each node under each state, parents)."""
        values, parent = observed(nodes)
        tag, name, *amounts, place = (t[:, values[:, f]].T for f, t in enumerate(self.seen))
        siblings = np.array([nodes[p].children if p >= 0 else 1 for p in parent])
        share = np.minimum(1, SIBLINGS / np.maximum(siblings, 1))[:, None]
        place = place * np.where(values[:, 5:] == 0, 0, share)  # no known place tells nothing
        own_log = name * np.where(values[:, 1:2] == 0, share, 1) + tag * np.where(
            np.isin(values[:, :1], PLAIN), PLAIN_POWER * share, 1) + sum(amounts) * share + place
        own_log[values[:, 0] == KINDS["script"], 1] -= NEVER_LOG
        return own_log, parent

    def content(self, nodes: list[Node]) -> np.ndarray:
        """Each node's marginal probability of content, by messages up and then down the tree."""
        own_log, parent = self.evidence(nodes)
        up = own_log.copy()  # what is seen in the subtree, for each state of its top
        message = np.zeros_like(up)
        for k in range(len(nodes) - 1, 0, -1):
            joint = self.pairs + up[k]
            top = joint.max(1)
            message[k] = top + np.log(np.exp(joint - top[:, None]).sum(1))
            up[parent[k]] += message[k]
        down = np.empty_like(up)  # what is seen elsewhere
        down[0] = self.root
        for k in range(1, len(nodes)):
            p = parent[k]
            joint = (down[p] + up[p] - message[k])[:, None] + self.pairs
            top = joint.max(0)
            down[k] = top + np.log(np.exp(joint - top).sum(0))
        both = up + down
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))


@cache
def potentials() -> Potentials:
    return Potentials()


def extract(page: str | None, model: Potentials | None = None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    nodes, run = parse(page)
    keep = (model or potentials()).content(nodes) >= 0.5
    return joined(run, keep)


def joined(run: list[tuple[int, str | None]], keep: np.ndarray) -> str:
    """The texts of kept elements as blocks."""
    blocks, now = [], []
    for k, text in [*run, (0, None)]:
        if text is None:
            block = _SPACES.sub(" ", html.unescape("".join(now))).strip()
            if block:
                blocks.append(block)
            now = []
        elif keep[k]:
            now.append(text)
    return "\n".join(blocks)


def main_texts(pages: DataFrame) -> DataFrame:
    """SCHEMA for every row of pages, in one pass without a shuffle; the model (a few kilobytes) goes with the task."""
    model = potentials()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 500):
                batch = big.slice(at, 500)
                texts = [extract(page, model) for page in batch.column(2).to_pylist()]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                       pa.array([len(t) for t in texts], pa.int64())],
                                      names=["page_id", "url", "text", "n_chars"])

    return own(pages, "page_id", "url", "html").mapInArrow(read, SCHEMA)
