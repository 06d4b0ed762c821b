"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks (text without a block-level element inside), each with features of
its ancestors (tags, and words of class, id and role) and of its text (length, share of link text, punctuation).
Two labels, main text or not, are scored by weights per feature and per label change; Viterbi finds the best sequence.
The weights are fitted by stochastic gradient steps on the likelihood of labelled pages (``labelled_pages``): the
tables hold no labels, so these pages are put together here from labelled parts in many orders, a fixed, bounded set.
Every page is extracted in one task, without a shuffle.

Defined results: null and empty pages have an empty text; unclosed and stray tags are repaired the way browsers do for
paragraphs, list items and cells; text of svg, select, template, iframe and noscript is not shown, and one of these that is
never closed ends with the element around it at the latest; repeated rows are extracted one by one; further columns are ignored.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, text string, n_chars long"
EPOCHS, RATE, DECAY = 12, 0.5, 1e-4
N_PAGES = 400
#: A tag up to its end.  A quote opens a value only after "=", and one that is never closed is part of its value.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)|[^=>])*+)>")
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden|aria-label)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
RAW = frozenset("script style title textarea".split())
#: Elements whose text is not shown; tags inside do not end the block they stand in.
UNSEEN = frozenset("svg select template iframe noscript".split())
#: Blocks that cannot stand in these: an open one ended without its end tag.
UNCLOSED = frozenset("svg select".split())
BREAKS_OUT = frozenset("article aside blockquote body center dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header li main menu nav ol p pre "
                       "section table ul".split())
#: These do not hold their own kind: one without an end tag before the next of its kind has no content.
NEXT_OF_KIND = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])", re.I | re.A) for tag in ("iframe", "noscript")}
#: Searched in the page itself: lower-casing some letters moves the offsets.
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A) for tag in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark meter nobr progress q rp rt "
                   "ruby s samp small span strike strong sub sup time tt u var wbr object math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror "
                   "mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction semantics "
                   "annotation annotation-xml".split()) | UNSEEN
#: A start tag closes these open elements, up to the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}
KEEPS_P = INLINE | VOID - {"hr"}


Path = tuple[frozenset[str], str]  # feature words of all ancestors, and of the nearest one that is a block


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: Path, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def markup(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, "" or "/", tag or "", attributes) of every piece of markup, and the rest of the text at last; the
    receiver may send the place to go on from.  A "<" without a ">" after it is text, as one before no letter is."""
    at = text_from = 0
    closed = True     # so far every tag has its end outside of quotes
    while (lt := page.find("<", at)) >= 0:
        nxt = page[lt + 1:lt + 2]
        if nxt == "!" or nxt == "?":
            if page.startswith("<!--", lt):
                # <!--> and <!---> are complete
                empty = 1 if page.startswith(">", lt + 4) else 2 if page.startswith("->", lt + 4) else 0
                ends = [e for e in (page.find("-->", lt + 4), page.find("--!>", lt + 4)) if e >= 0] if not empty else []
                end = lt + 4 + empty if empty else min(ends) + (3 if page.startswith("-->", min(ends)) else 4) if ends else len(page)
            else:
                end = page.find(">", lt) + 1 or len(page)
            out = (page[text_from:lt], "", "", "")
        else:
            m = TAG.match(page, lt) if closed else None
            if m:
                end, out = m.end(), (page[text_from:lt], m.group(1), m.group(2).lower(), m.group(3))
            elif not nxt.isascii() or not (nxt.isalpha() or nxt == "/" and page[lt + 2:lt + 3].isalpha()):
                at = lt + 1
                continue
            else:
                gt = page.find(">", lt)
                if gt < 0:
                    break
                # a quote swallows the end of this tag: from here on the next ">" ends a tag
                closed = False
                name = re.match(r"</?([a-zA-Z][^\s/><]*+)", page[lt:gt])
                if not name:
                    at = lt + 1
                    continue
                end, out = gt + 1, (page[text_from:lt], "/" if nxt == "/" else "", name.group(1).lower(), page[lt + name.end():gt])
        at = text_from = (yield out, end) or end
    yield (page[text_from:], "", "", ""), len(page)


@functools.lru_cache(maxsize=50_000)
def _inside(words: frozenset[str], feature: str) -> frozenset[str]:
    new = feature.split(" ")
    return words if words.issuperset(new) else words.union(new)


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks in page order; white space inside a block is one space."""
    blocks: list[Block] = []
    stack: list[tuple[str, Path]] = []
    opened: Counter[str] = Counter()
    held: list[str] = []
    links: list[int] = [0, 0]          # open links, characters inside links
    unseen: list[int] = []             # place in the stack of the outermost open element whose text is not shown

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            blocks.append(Block(stack[-1][1] if stack else NOWHERE, text, links[1]))
        links[1] = 0

    def close(i: int) -> None:
        if any(tag not in INLINE for tag, _ in stack[i:unseen[0] if unseen else None]):
            flush()
        if unseen and i <= unseen[0]:
            unseen.clear()
        links[0] -= sum(tag == "a" for tag, _ in stack[i:])
        opened.subtract(tag for tag, _ in stack[i:])
        del stack[i:]

    pieces, at = markup(page), None
    while True:
        try:
            (text, closing, tag, attributes), end = pieces.send(at)
        except StopIteration:
            break
        at = None
        if text and not unseen:
            text = html.unescape(text)
            held.append(text)
            if links[0]:
                links[1] += len(text.strip())
        if not tag:
            continue
        if closing:
            if not opened[tag]:
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE and not (unseen and i > unseen[0]):
                    break  # a stray inline end does not close a block
            continue
        ended = attributes.endswith("/")
        if unseen and tag in BREAKS_OUT and stack[unseen[0]][0] in UNCLOSED and not opened["foreignobject"]:
            close(unseen[0])
        if tag in RAW and not (ended and opened["svg"]):
            raw_end = RAW_END[tag].search(page, end)
            close_at = page.find(">", raw_end.end()) if raw_end else -1
            at = close_at + 1 if close_at >= 0 else len(page)
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in NEXT_OF_KIND and not ((follows := NEXT_OF_KIND[tag].search(page, end)) and follows.group(1)):
            continue
        if tag not in INLINE:
            if not unseen:
                flush()
            ends, stops = CLOSES.get(tag, ((), ()))
            for i in range(len(stack) - 1, unseen[0] if unseen else -1, -1):
                if stack[i][0] in ends or stack[i][0] == "p" and tag not in KEEPS_P:
                    close(i)
                    break
                if stack[i][0] in stops or ends == () and stack[i][0] not in INLINE:
                    break
        if tag not in VOID and not ended:
            if tag in UNSEEN and not unseen:
                unseen.append(len(stack))
            feature = element_features(tag, attributes)
            words, own = stack[-1][1] if stack else NOWHERE
            stack.append((tag, (_inside(words, feature), own if tag in INLINE else feature)))
            opened[tag] += 1
            links[0] += tag == "a"
    flush()
    return blocks


NOWHERE: Path = (frozenset(), "")


@functools.lru_cache(maxsize=20_000)
def element_features(tag: str, attributes: str) -> str:
    """The tag and the words of its naming attributes."""
    words = [f"<{tag}>"]
    if attributes.strip():
        for name, value in ATTRIBUTE.findall(attributes):
            value = value.strip("\"'").lower()
            name = name.lower()
            if name == "style":
                words += ["hidden"] * ("display:none" in value.replace(" ", ""))
            elif name in ("hidden", "aria-hidden"):
                words += ["hidden"] * (value != "false")
            else:
                words += [w for w in re.split(r"[^a-z]+", value) if w]
    return " ".join(words)


def text_features(b: Block) -> tuple[str, ...]:
    length, link = min(6, (b.text.count(" ") + 1).bit_length()), min(3, 4 * b.linked // len(b.text))
    return (f"len{length}", f"link{link}", "stop" if b.text[-1] in ".!?:\"')" else "open")


@functools.lru_cache(maxsize=50_000)
def path_features(path: Path) -> tuple[str, ...]:
    return tuple(sorted(path[0])) + tuple(f"own:{w}" for w in path[1].split(" "))


def features(blocks: list[Block]) -> list[list[str]]:
    return [["bias", *path_features(b.path), *text_features(b)] for b in blocks]


# ------------------------------------------------------------------------------------------ labelled pages

MAIN_PARTS = (
    "<p>{s}</p>", "<p>{s}</p>", "<p>{s}<p>{s}", "<h1>{t}</h1>", "<h2>{t}</h2>", "<h3>{t}</h3>", "<ul><li>{t}</li><li>{s}</li></ul>",
    "<ol><li>{s}<li>{t}</ol>", "<blockquote>{s}</blockquote>", "<blockquote><p>{s}</p></blockquote>", "<pre>{t}</pre>", "<p><b>{t}</b> {s}</p>",
    "<p><a href=x>{t}</a> {s}</p>", "<table><tr><th>{t}</th><td>{t}</td></tr></table>", "<figure><figcaption>{t}</figcaption></figure>",
    "<div>{s}</div>", "<section><h2>{t}</h2><p>{s}</p></section>", "<p>{t}</p>", "<dl><dt>{t}</dt><dd>{s}</dd></dl>", "<p><b>{s}<br><p>{s}</p>",
    "<table><thead><tr><th>{t}<th>{t}<tbody><tr><td>{t}<td>{s}</table>",
)
MAIN_FRAMES = (
    "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div class=\"content\">{}</div>",
    "<div id=\"main\"><div class=\"post entry\">{}</div></div>", "<div class=\"article-body\">{}</div>", "<article class=\"story\"><div class=\"text\">{}</div></article>",
    "<div class=\"page\"><article>{}</article></div>", "<div role=\"main\">{}</div>", "<section class=\"post-content\">{}</section>",
)
OTHER_WORDS = (
    "nav menu navigation navbar breadcrumb breadcrumbs header masthead topbar banner footer foot copyright legal sidebar side widget rail "
    "ad ads advert advertisement sponsor sponsored promo cookie cookies consent notice notification alert popup modal overlay newsletter subscribe "
    "signup login search form share social related recommended more comments comment reply replies discussion respond disqus hidden tags pager pagination toolbar"
).split()
OTHER_FRAMES = (
    "<nav>{}</nav>", "<header>{}</header>", "<footer>{}</footer>", "<aside>{}</aside>", "<form>{}</form>", "<div class=\"{w}\">{}</div>",
    "<div class=\"{w}\">{}</div>", "<div id=\"{w}\">{}</div>", "<section class=\"{w}\">{}</section>", "<ul class=\"{w}\">{}</ul>", "<div class=\"site-{w}\">{}</div>",
    "<div class=\"{w}-box\">{}</div>", "<aside class=\"{w}\">{}</aside>", "<section id=\"{w}\">{}</section>", "<div role=\"{w}\">{}</div>",
    "<ol class=\"{w}\">{}</ol>", "<div hidden>{}</div>", "<div class=\"{w}\">{}</div>", "<footer class=\"{w}\">{}</footer>", "<nav class=\"{w}\">{}</nav>",
    "<table class=\"{w}\"><tr><td>{}</table>", "<table id=\"{w}\"><tbody><tr><td>{}</td></tr></tbody></table>",
    "<div class=\"{w}\"><table><tr><td>{}</td></tr></table></div>", "<table><tr><td class=\"{w}\">{}</td></tr></table>",
)
OTHER_PARTS = (
    "<ul><li><a href=x>{t}</a></li><li><a href=y>{t}</a></li></ul>", "{s}", "<p>{s}</p>", "<p>{s}</p><p>{s}</p>", "<a href=x>{t}</a>", "&copy; {t} &middot; {s}",
    "<h3>{t}</h3><p>{s}</p>", "<li>{s}</li>", "<label>{t}</label><input name=q><button>{t}</button>", "<h2>{t}</h2><ul><li><a href=x>{t}</a></li></ul>",
    "<div>{t}</div>", "<article><p>{s}</p></article>", "<div class=\"body\"><p>{s}</p></div>", "<p>{t}</p>", "<span>{t}</span>", "<h1>{t}</h1>",
    "<table><tr><td>{t}</td><td><a href=x>{t}</a></td></tr></table>", "<table><tr><th>{t}<td>{s}</table>",
)


def labelled_pages(n: int = N_PAGES, seed: int = 5) -> list[tuple[list[Block], list[int]]]:
    """Pages of labelled parts: a frame of main parts, some of them interrupted by other parts, among other frames.
    A block's label is that of the part it came from."""
    rng = random.Random(seed)
    marks = ("zmain", "zother")

    def word() -> str:
        return "".join(rng.choice(("th", "er", "on", "an", "re", "is", "ou", "que", "der", "la")) for _ in range(rng.randint(1, 4)))

    def fill(part: str, label: int) -> str:
        for key, low, high in (("{s}", 4, 60), ("{t}", 1, 9)):
            while key in part:
                words = " ".join(word() for _ in range(rng.randint(low, high))) + rng.choice((".", ".", "", ","))
                part = part.replace(key, f"{marks[1 - label]}{words}", 1)
        return part

    def other() -> str:
        inner = "".join(fill(rng.choice(OTHER_PARTS), 0) for _ in range(rng.randint(1, 4)))
        return rng.choice(OTHER_FRAMES).replace("{w}", rng.choice(OTHER_WORDS)).replace("{}", inner)

    pages = []
    for _ in range(n):
        main = []
        for _ in range(rng.randint(1, 12)):
            main.append(fill(rng.choice(MAIN_PARTS), 1))
            if rng.random() < 0.12:
                main.append(other())
        body = "".join(other() for _ in range(rng.randint(0, 4)))
        body += rng.choice(MAIN_FRAMES).replace("{}", "".join(main))
        body += "".join(other() for _ in range(rng.randint(0, 4)))
        blocks = leaf_blocks(rng.choice(("{}", "<div class=\"wrapper\">{}</div>", "<body>{}</body>")).replace("{}", body))
        labels = [int(b.text.count(marks[0]) > 0) for b in blocks]
        for b in blocks:
            for mark in marks:
                b.linked -= mark in b.text and min(b.linked, len(mark))
                b.text = b.text.replace(mark, "")
        pages.append(([b for b in blocks if b.text], [y for b, y in zip(blocks, labels) if b.text]))
    return pages


# ------------------------------------------------------------------------------------------ the field

class Field:
    """Weights of (feature, label) and of (label, next label)."""

    def __init__(self):
        self.names: dict[str, int] = {}
        self.emit = np.zeros((0, 2))
        self.move = np.zeros((2, 2))
        self.kept: dict[tuple, tuple[float, float]] = {}

    def _sum(self, row: tuple[str, ...]) -> tuple[float, float]:
        return tuple(self.emit[[self.names[w] for w in row if w in self.names]].sum(axis=0).tolist())

    def scores(self, blocks: list[Block]) -> list[tuple[float, float]]:
        """The sums of a path's and of a text's weights are kept: pages of a site share them."""
        out = []
        if len(self.kept) > 100_000:
            self.kept.clear()
        for b in blocks:
            sums = []
            for key in (b.path, text_features(b)):
                found = self.kept.get(key)
                if found is None:
                    found = self.kept[key] = self._sum(("bias", *path_features(key)) if key is b.path else key)
                sums.append(found)
            out.append((sums[0][0] + sums[1][0], sums[0][1] + sums[1][1]))
        return out

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], seed: int = 3) -> Field:
        self.names = {w: i for i, w in enumerate(sorted({w for rows, _ in pages for row in rows for w in row}))}
        self.emit = np.zeros((len(self.names), 2))
        coded = [([np.array([self.names[w] for w in row]) for row in rows], labels) for rows, labels in pages if rows]
        seen_emit, seen_move = np.full(self.emit.shape, 1e-3), np.full((2, 2), 1e-3)
        order = np.random.default_rng(seed)
        for _ in range(EPOCHS):
            for k in order.permutation(len(coded)):
                rows, labels = coded[k]
                s = np.array([self.emit[row].sum(axis=0) for row in rows])
                node, edge = marginals(s, self.move)
                node[np.arange(len(rows)), labels] -= 1
                grad = np.zeros((2, 2)) + edge
                for a, b in zip(labels, labels[1:]):
                    grad[a, b] -= 1
                grad += DECAY * self.move
                seen_move += grad ** 2
                self.move -= RATE * grad / np.sqrt(seen_move)
                at = np.concatenate(rows)
                g = np.repeat(node, [len(r) for r in rows], axis=0)
                unique, inverse = np.unique(at, return_inverse=True)
                total = np.zeros((len(unique), 2))
                np.add.at(total, inverse, g)
                total += DECAY * self.emit[unique]
                seen_emit[unique] += total ** 2
                self.emit[unique] -= RATE * total / np.sqrt(seen_emit[unique])
        return self


def marginals(s: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each label at each place, and the expected number of each label change."""
    n = len(s)
    fore, back = np.zeros((n, 2)), np.zeros((n, 2))
    fore[0] = s[0]
    for i in range(1, n):
        fore[i] = s[i] + np.logaddexp(fore[i - 1, 0] + move[0], fore[i - 1, 1] + move[1])
    for i in range(n - 2, -1, -1):
        ahead = s[i + 1] + back[i + 1]
        back[i] = np.logaddexp(move[:, 0] + ahead[0], move[:, 1] + ahead[1])
    total = np.logaddexp(*fore[-1])
    edge = np.exp(fore[:-1, :, None] + move + (s[1:] + back[1:])[:, None, :] - total).sum(axis=0)
    return np.exp(fore + back - total), edge


def viterbi(s: list[tuple[float, float]], move: np.ndarray) -> list[int]:
    if not s:
        return []
    (m00, m01), (m10, m11) = move.tolist()
    a, b = s[0]
    back = []
    for x, y in s[1:]:
        stay, come = a + m00, b + m10
        go, keep = a + m01, b + m11
        back.append((stay < come, go < keep))
        a, b = x + (come if stay < come else stay), y + (keep if go < keep else go)
    label = int(b > a)
    out = [label]
    for step in reversed(back):
        label = int(step[label])
        out.append(label)
    return out[::-1]


@functools.cache
def trained() -> Field:
    return Field().fit([(features(blocks), labels) for blocks, labels in labelled_pages()])


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page)
    labels = viterbi(field.scores(blocks), field.move)
    return "\n\n".join(b.text for b, y in zip(blocks, labels) if y)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, shared.value) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, SCHEMA)
