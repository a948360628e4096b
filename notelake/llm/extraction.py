"""The main text of HTML pages: flat text blocks, classified by a decision tree.

What the tree sees of a block are its own and its neighbours' word counts and link
densities, the region that the elements around it name, and a heading that ends the article.  It is trained on
the labelled pages below, a bounded table, whenever it is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelake.llm import common
from notelake.llm.html_blocks import MAIN, NONE, Block, blocks

FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "region", "outside_main", "afterwards",
)
DEPTH = 7

_LONG = "The committee met again in the old town hall on Monday and talked for three hours about the bridge that nobody wants to pay for"
_OTHER = "Nobody had expected so many people to come, and most of those who came had never been to a meeting of the council before"
_SHORT = "It was late."
_MENU = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport and leisure</a></li></ul>'
_LINKS = '<p><a href="/1">Ten things to see in the north</a></p><p><a href="/2">Why the river floods</a></p>'
_TALK = f"<p>{_OTHER}, said one reader, and I agree with every word of it</p><p>Me too</p>"

#: Labelled pages, each as pieces of its markup with + for the article and - for the rest.
LABELLED: tuple[tuple[tuple[str, str], ...], ...] = (
    (("-", f"<nav>{_MENU}</nav><div class=ad>Buy now and save a lot.</div>"), ("+", f"<article><h1>A bridge</h1><p>{_LONG}</p><p>{_SHORT}</p><p>No.</p><p>{_OTHER}</p></article>"), ("-", f"<footer>&copy; site. {_LONG}</footer>")),
    (("-", f"<header><h1>The Paper</h1>{_MENU}</header>"), ("+", f"<main><h2>News</h2><p>{_SHORT}</p><p>{_LONG}</p><ul><li>One</li><li>Two of them</li></ul></main>"), ("-", f"<aside><h3>Weather</h3><p>{_OTHER}</p>{_LINKS}</aside><footer><a href=/c>Contact</a></footer>")),
    (("-", f"<article><aside><p>{_LONG}</p></aside><header>"), ("+", "<h1>The title of it</h1>"), ("-", "<p>By a writer, on Monday</p></header>"), ("+", f"<p>{_OTHER}</p><p>{_SHORT}</p>"), ("-", f"<footer>Filed under news</footer></article><section class=comments><h2>3 comments</h2><article>{_TALK}</article></section>")),
    (("-", f"<div>{_MENU}</div><div><a href=/>Start</a> | <a href=/m>Map</a></div>"), ("+", f"<div><p>{_LONG}</p><p>{_SHORT}</p><p>{_OTHER}</p></div>"), ("-", "<div><a href=/i>Imprint</a></div><div>All rights reserved</div>")),
    (("-", "<table><tr><td><a href=/>Home</a></td><td><a href=/a>About us</a></td></tr></table>"), ("+", f"<table><tr><td><h2>A flood</h2>{_OTHER}<br>{_LONG}</td></tr><tr><td>{_LONG}</td></tr></table>"), ("-", f"{_LINKS}<p>Page 1 of 3</p>")),
    (("-", f'<div id="cookie-consent"><p>{_LONG}</p></div><form><p>{_OTHER}</p><label>Name</label></form>'), ("+", f'<div id="content"><h1>Rain</h1><p>{_LONG}</p><p>Yes.</p><p>He said <a href=/x>so</a>, twice.</p></div>'), ("-", f"<div class=newsletter><p>{_OTHER}</p></div>")),
    (("+", f"<article><p>{_SHORT}</p></article>"), ("-", f"<div class='comment-list'><p>{_LONG}</p><p>{_OTHER}</p></div>")),
    (("-", f"<div class=top>{_LINKS}</div>"), ("+", f"<h1>A long way home</h1><p>{_LONG}</p><p>{_OTHER}</p><h3>The way back</h3><p>{_LONG}</p>"), ("-", f"<h3>Comments</h3>{_TALK}")),
    (("-", "<p>Skip</p><p>Log in</p><p>Search</p>"), ("+", f"<p>{_OTHER}</p><p>{_LONG}</p>"), ("-", "<p>Top</p><p>Terms</p>")),
    (("+", f"<article><h1>One</h1><p><a href=/f>The whole of this line is a link</a></p><p>{_LONG}</p></article>"), ("-", f"<p>{_LONG}</p><div class=related>{_LINKS}</div>")),
    (("-", f"<div class=header><p>{_LONG}</p></div>"), ("+", f"<div class=post><p>{_OTHER}</p><p>Ok</p><h2>So</h2><p>{_SHORT}</p></div>"), ("-", f"<p>{_SHORT}</p><div class=sidebar><p>{_OTHER}</p></div>")),
    (("-", f"<nav>{_MENU}</nav><form><p>Mail</p></form>"), ("+", f"<p>{_LONG}</p><p>{_SHORT}</p><p>{_LONG}</p>"), ("-", f"<form><p>{_LONG}</p></form><aside><p>{_SHORT}</p></aside><footer><p>{_OTHER}</p></footer>")),
    (("+", f"<article><h2>Two</h2><p>{_LONG}</p>"), ("-", f"<div class=ad><p>{_OTHER}</p></div>"), ("+", f"<p>{_OTHER}</p>"), ("-", f"<aside><h3>Box</h3><p>{_SHORT}</p></aside>"), ("+", f"<p>{_SHORT}</p><p>{_LONG}</p>"), ("-", f"<div class=share><p>Share</p></div><div class=comments><h3>Comments</h3>{_TALK}</div></article>")),
    (("-", f"<header><p>{_LONG}</p></header>"), ("+", f"<main><article><p>{_LONG}</p>"), ("-", f"<nav><h2>In this text</h2><p>{_SHORT}</p></nav><header><p>{_OTHER}</p></header>"), ("+", f"<h3>Then</h3><p>{_SHORT}</p></article>"), ("-", f"<form><h3>Write to us</h3><p>{_OTHER}</p></form></main>")),
    (("-", f"<div class=notice><p>{_SHORT}</p></div>"), ("+", f"<div class=entry><header><h1>Three</h1></header><p>{_LONG}</p>"), ("-", f"<section class=related><h2>Related</h2><p>{_LONG}</p></section>"), ("+", f"<p>{_OTHER}</p></div>"), ("-", f"<div class=popup><h2>Wait</h2><p>{_OTHER}</p></div>")),
    (("-", f"<div><p>{_SHORT}</p></div>"), ("+", f"<article><p>{_OTHER}</p><h2>Comments on the law</h2><p>{_LONG}</p></article>"), ("-", "<div><p>Share this</p></div>")),
    (("-", "<div>Breaking story of today</div>"), ("+", f"<article><p>{_LONG} {_OTHER}</p></article>"), ("-", f"<div>{_LONG} {_OTHER}</div><aside><h3>What others read on this very day</h3></aside>")),
    (("-", f"<header><h1>The daily paper of the north</h1></header><nav><h2>All the parts of it</h2></nav>"), ("+", f"<article><header><h1>Four</h1></header><p>{_LONG}</p></article>"), ("-", f"<div><p>{_SHORT}</p></div><div><p>{_LONG}</p></div><footer><h4>Where to find us in town</h4></footer>")),
    (("-", f"<div class=comments><h3>What our readers think of it</h3>{_TALK}</div>"), ("+", "<article><header><h1>Nothing but a title</h1></header></article>"), ("-", f"<p>{_SHORT}</p><p>{_OTHER} {_LONG}</p>")),
    (("+", f"<p>{_LONG}</p>"),),
    (("+", f"{_LONG} {_OTHER}"),),
    (("-", f"{_MENU}<p>Sorry, there is nothing here</p>"),),
)


def features(found: list[Block]) -> list[list[float]]:
    """A row of ``FEATURES`` for each block of a page."""
    has_main = any(b.region == MAIN for b in found)
    own = [(float(b.words), b.link_density) for b in found]
    out = []
    for i, b in enumerate(found):
        before = own[i - 1] if i else (0.0, 0.0)
        after = own[i + 1] if i + 1 < len(own) else (0.0, 0.0)
        out.append([*own[i], *before, *after, float(b.region), float(has_main and b.region == NONE), float(b.afterwards)])
    return out


@dataclass
class Node:
    """A leaf with its share of article blocks, or a test ``feature <= value`` with two sides."""

    share: float
    feature: int = -1
    value: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None

    def is_main(self, row: Sequence[float]) -> bool:
        node = self
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.value else node.high
        return node.share >= 0.5


def _impurity(labels: np.ndarray) -> float:
    share = labels.mean() if len(labels) else 0.0
    return len(labels) * share * (1 - share)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = DEPTH) -> Node:
    """A tree of Gini splits; of equal splits the first feature's, then the smallest value's."""
    node = Node(float(labels.mean()) if len(labels) else 0.0)
    best = _impurity(labels) - 1e-9
    if depth == 0 or best <= 0:
        return node
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        for value in (values[1:] + values[:-1]) / 2:
            low = rows[:, feature] <= value
            cost = _impurity(labels[low]) + _impurity(labels[~low])
            if cost < best - 1e-12:
                best, node.feature, node.value = cost, feature, float(value)
    if node.feature >= 0:
        low = rows[:, node.feature] <= node.value
        node.low, node.high = grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1)
    return node


def labelled_rows(pages: Sequence[Sequence[tuple[str, str]]] = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of labelled pages."""
    rows, labels = [], []
    for page in pages:
        found = list(blocks("".join(part for _, part in page)))
        ends = np.cumsum([len(part) for _, part in page])
        rows += features(found)
        labels += [page[int(np.searchsorted(ends, b.at, side="right"))][0] == "+" for b in found]
    return np.array(rows).reshape(-1, len(FEATURES)), np.array(labels, dtype=float)


def learn_blocks(pages: Sequence[Sequence[tuple[str, str]]] = LABELLED, depth: int = DEPTH) -> Node:
    """The tree learned from ``pages``, pieces of markup labelled + or -; they have to fit the driver."""
    return grow(*labelled_rows(pages), depth)


def main_blocks(page: str, tree: Node) -> list[Block]:
    found = list(blocks(page))
    return [b for b, row in zip(found, features(found), strict=True) if tree.is_main(row)]


def _extract(tree: Node):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, most=2 << 20):
            texts, n_blocks, n_kept = [], [], []
            at = batch.schema.get_field_index("content")
            for page in batch.column(at):
                found = list(blocks(page.as_py()))
                kept = [b.text for b, row in zip(found, features(found), strict=True) if tree.is_main(row)]
                texts.append("\n".join(kept))
                n_blocks.append(len(found))
                n_kept.append(len(kept))
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(texts, pa.string()), pa.array(n_blocks, pa.int64()), pa.array(n_kept, pa.int64())],
                names=[*names, "content", "n_blocks", "n_kept"],
            )

    return extract


def extract_text(notes: DataFrame, tree: Node | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """``vault, path``, the columns to ``carry``, ``content, n_blocks, n_kept``: the main text of notes clipped as HTML.

    A block is the text between two block boundaries (``br`` is none).  Character references are
    decoded, runs of white space (as Unicode has it) become one space, and the blocks that the
    tree takes for the article are joined by ``\\n`` in the order of the page.  Scripts, styles,
    comments, controls of forms and the title in the head are no text.  An element's region is what its
    tag, role, class or id names; inside menus, asides, footers, adverts, notices and
    reader comments it stays so whatever is nested, but for ``main``.

    A NULL or empty page, and one without an article, gives an empty text; repeated rows give repeated
    results; an empty table gives none.  Broken markup is read as far as it goes; an unclosed script or
    style takes the rest of the page.  No page is cut.
    """
    tree = tree or learn_blocks()
    rows = notes.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("vault", "path")), *carry,
        F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content"),
    )
    fields = [f for f in rows.schema.fields if f.name != "content"]
    schema = T.StructType([*fields, T.StructField("content", T.StringType()), T.StructField("n_blocks", T.LongType()), T.StructField("n_kept", T.LongType())])
    return rows.mapInArrow(_extract(tree), schema)
