"""Main-text extraction with a tree-structured graphical model over the DOM.

Every element is article or not.  Unary potentials come from its own features (tag, names in its
attributes, text, link density), pairwise potentials tie it to its parent.  One upward and one downward
pass of sum-product messages, vectorised over the elements of a depth in a whole batch of pages, give
the exact marginals; an element's own text is kept if its marginal is at least one half.  The
potentials are fitted by gradient ascent on the likelihood of labelled pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks_by_bytes
from .dom import Page, blocks
from .sample_pages import labelled_page

#: Pages the model is fitted on, and its gradient steps.
TRAINING_PAGES, STEPS, RATE, MOMENTUM, L2 = 600, 400, 0.3, 0.9, 1e-4
_TAGS = """#root html head body title meta link script style noscript template iframe svg object header footer nav aside main article section
div p span a b i em strong u small sub sup code pre kbd h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th caption figure figcaption
img br hr blockquote q cite form label input select option optgroup textarea button fieldset legend address time details summary dialog menu
video audio center font mark abbr""".split()
#: Words in class, id and role, grouped; each is matched as a word part.
_NAMES = {
    "advert": "ad ads adv advert advertisement adbox sponsor sponsored promo promotion banner",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar tabs",
    "head": "header masthead topbar top", "foot": "footer foot bottom copyright legal",
    "side": "sidebar side aside widget rail column col related recommended more popular trending",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay privacy warning",
    "talk": "comment comments reply replies discussion responses disqus respond",
    "form": "form search newsletter subscribe signup login share social tags rating",
    "byline": "byline author meta date posted published by",
    "text": "content article post entry body story text main page blog"}
_GROUP = {w: k for k, ws in enumerate(_NAMES.values()) for w in ws.split()}
_PART = re.compile(r"[A-Za-z]+?(?=[A-Z][a-z]|[^A-Za-z]|$)")
_TAG_NO = {t: k for k, t in enumerate(_TAGS)}
_N_TAGS, _N_NAMES, _N_SIZES = len(_TAGS) + 1, len(_NAMES), 6
#: Kinds of element whose own text may be short for different reasons.
_KINDS = {k: n for n, tags in enumerate(("p blockquote pre dd dt figcaption caption td th address q cite", "h1 h2 h3 h4 h5 h6", "li", "a button label option input",
                                         "b i em strong u small sub sup code kbd font mark abbr span time")) for k in tags.split()}
_N_KINDS = 6
_KIND_OF = np.array([*(_KINDS.get(t, 5) for t in _TAGS), 5])
#: tag, tag of the parent, names, own text by kind, text below, links, what is above, bias
_AT_PARENT = _N_TAGS
_AT_NAMES = 2 * _N_TAGS
_AT_OWN = _AT_NAMES + _N_NAMES
_AT_BELOW = _AT_OWN + _N_KINDS * _N_SIZES
_AT_LINKS = _AT_BELOW + _N_SIZES
#: What some element above is: a landmark tag, or named like one of the groups.
_LANDMARKS = "header footer nav aside main article form section li".split()
_AT_ABOVE = _AT_LINKS + 4
_AT_BIAS = _AT_ABOVE + len(_LANDMARKS) + _N_NAMES
FEATURES = _AT_BIAS + 1


class Forest:
    """The elements of a batch of pages: parents, depths, sparse binary features and text pieces."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.tag) for p in pages]
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        n = int(self.start[-1])
        base = np.repeat(self.start[:-1], sizes)
        parent = np.fromiter((x for p in pages for x in p.parent), np.int64, n)
        self.parent = np.where(parent >= 0, parent + base, -1)
        tag = np.fromiter((_TAG_NO.get(t, _N_TAGS - 1) for p in pages for t in p.tag), np.int64, n)
        link = np.fromiter((t == "a" for p in pages for t in p.tag), bool, n)
        pieces = [(int(s) + e, len(t.strip())) for s, p in zip(self.start, pages) for e, _, t in p.texts]
        own = np.zeros(n)
        if pieces:
            at = np.array(pieces, np.int64)
            own = np.bincount(at[:, 0], at[:, 1], n)
        self.depth = np.zeros(n, np.int64)
        self.levels = [np.flatnonzero(self.parent < 0)]
        order = np.argsort(self.parent, kind="stable")
        sorted_parent = self.parent[order]
        while len(self.levels[-1]):
            last = self.levels[-1]
            lo, hi = np.searchsorted(sorted_parent, last), np.searchsorted(sorted_parent, last, side="right")
            size = hi - lo
            take = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
            self.levels.append(order[take])
        self.levels.pop()
        below = own.copy()
        linked = np.where(link, 0.0, 0.0)
        for level in reversed(self.levels[1:]):
            linked[level[link[level]]] = below[level[link[level]]]
            np.add.at(below, self.parent[level], below[level])
            np.add.at(linked, self.parent[level], linked[level])
        here = np.zeros((n, len(_LANDMARKS) + _N_NAMES), bool)
        for k, name in enumerate(_LANDMARKS):
            here[:, k] = tag == _TAG_NO[name]
        rows, cols = [np.arange(n)] * 2, [tag, _AT_PARENT + np.where(self.parent >= 0, tag[self.parent], _N_TAGS - 1)]
        for s, p in zip(self.start, pages):
            for e, raw in enumerate(p.attrs):
                if raw:
                    value = p.attribute(e, "class", "id", "role")
                    if value:
                        found = {_GROUP[w.lower()] for w in _PART.findall(value) if w.lower() in _GROUP}
                        if found:
                            rows.append(np.full(len(found), s + e))
                            cols.append(_AT_NAMES + np.array(sorted(found)))
                            here[s + e, [len(_LANDMARKS) + g for g in found]] = True
        above = np.zeros_like(here)
        for level in self.levels[1:]:
            above[level] = above[self.parent[level]] | here[self.parent[level]]
        inside, which = np.nonzero(above)
        rows.append(inside)
        cols.append(_AT_ABOVE + which)
        rows += [np.arange(n)] * 4
        cols += [_AT_OWN + _KIND_OF[tag] * _N_SIZES + np.searchsorted([1, 20, 60, 150, 400], own, side="right"), _AT_BELOW + np.searchsorted([1, 40, 150, 500, 1500], below, side="right"),
                 _AT_LINKS + np.searchsorted([0.05, 0.4, 0.8], linked / np.maximum(below, 1), side="right"), np.full(n, _AT_BIAS)]
        self.row, self.col = np.concatenate(rows), np.concatenate(cols)
        self.tag, self.n = tag, n


@dataclass
class Potentials:
    unary: np.ndarray           # FEATURES: log odds of article
    pair: np.ndarray            # tags of the child x (parent state, child state)


def marginals(f: Forest, w: Potentials) -> tuple[np.ndarray, np.ndarray]:
    """(probability of article per element, joint probabilities with its parent: elements x 2 x 2)."""
    odds = np.bincount(f.row, w.unary[f.col], f.n)
    up = np.stack([np.zeros(f.n), odds], 1)                 # log belief from below and from the element
    message = np.zeros((f.n, 2))
    for level in reversed(f.levels[1:]):
        both = w.pair[f.tag[level]] + up[level][:, None, :]
        message[level] = np.logaddexp(both[..., 0], both[..., 1])
        np.add.at(up, f.parent[level], message[level])
    belief = up - np.logaddexp(up[:, :1], up[:, 1:])
    joint = np.zeros((f.n, 2, 2))
    for level in f.levels[1:]:
        outside = belief[f.parent[level]] - message[level]
        table = outside[:, :, None] + w.pair[f.tag[level]] + up[level][:, None, :]
        table -= table.max((1, 2), keepdims=True)
        table = np.exp(table)
        table /= table.sum((1, 2), keepdims=True)
        joint[level] = table
        belief[level] = np.log(np.maximum(table.sum(1), 1e-300))
    return np.exp(belief[:, 1]), joint


def train(pages: list[str], mark: str = "data-main", steps: int = STEPS) -> Potentials:
    """Potentials from pages whose article elements carry the attribute ``mark``.

    An element that only holds article elements counts as article itself if most text below it does.
    """
    parsed = [Page(p) for p in pages]
    f = Forest(parsed)
    marked = np.array([re.search(rf"(?<![\w-]){mark}(?![\w-])", a) is not None for p in parsed for a in p.attrs], np.float64)
    good, every = np.zeros(f.n), np.zeros(f.n)
    for s, p in zip(f.start, parsed):
        for e, _, t in p.texts:
            every[s + e] += len(t.strip())
            good[s + e] += len(t.strip()) * marked[s + e]
    for level in reversed(f.levels[1:]):
        np.add.at(good, f.parent[level], good[level])
        np.add.at(every, f.parent[level], every[level])
    state = np.maximum(marked, (good > 0.7 * every) & (every > 0)).astype(np.int64)
    w = Potentials(np.zeros(FEATURES), np.zeros((_N_TAGS, 2, 2)))
    children = np.flatnonzero(f.parent >= 0)
    seen_u = np.bincount(f.col, state[f.row], FEATURES)
    seen_p = np.zeros((_N_TAGS, 2, 2))
    np.add.at(seen_p, (f.tag[children], state[f.parent[children]], state[children]), 1)
    scale_u = np.sqrt(np.bincount(f.col, minlength=FEATURES) + 1.0)
    scale_p = np.sqrt(seen_p.sum((1, 2)) + 1.0)[:, None, None]
    go_u, go_p = np.zeros_like(w.unary), np.zeros_like(w.pair)
    for _ in range(steps):
        p, joint = marginals(f, w)
        hope_p = np.zeros((_N_TAGS, 2, 2))
        np.add.at(hope_p, f.tag[children], joint[children])
        go_u = MOMENTUM * go_u + (seen_u - np.bincount(f.col, p[f.row], FEATURES)) / scale_u ** 2 - L2 * w.unary
        go_p = MOMENTUM * go_p + (seen_p - hope_p) / scale_p ** 2 - L2 * w.pair
        w.unary += RATE * go_u
        w.pair += RATE * go_p
    return w


@lru_cache(maxsize=1)
def default_potentials() -> Potentials:
    return train([labelled_page(k) for k in range(TRAINING_PAGES)])


def extract(pages: list[str], w: Potentials) -> list[str]:
    """The main text of every page."""
    parsed = [Page(p) for p in pages]
    f = Forest(parsed)
    keep = marginals(f, w)[0] >= 0.5
    return [blocks([(b, t) for e, b, t in p.texts if keep[s + e]]) for s, p in zip(f.start, parsed)]


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                      potentials: Potentials | None = None) -> DataFrame:
    """One row per page: (id, url, text, n_chars).

    ``text`` has the article's blocks joined by line feeds, empty if there is none; a null or empty page
    has none.  Repeated rows are extracted each; other columns are not read.
    """
    w = potentials or default_potentials()
    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks_by_bytes(batches, "html", 1 << 20):
            texts = extract([h or "" for h in b.column("html").to_pylist()], w)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    out = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(
        run, f"id {kinds[0]}, url {kinds[1]}, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
