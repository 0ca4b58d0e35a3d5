"""Main text of HTML pages: boosted trees over DOM nodes, and decoding along the tree.

The trees are fitted on ``PAGES`` made-up pages, a fixed number, with known main text; nothing of
the table at hand goes into them. They stand in ``trees.npz``, which ``python -m
girder.llm.html_extract`` writes anew. Each page of the table is parsed, its block elements get log-odds
from the trees, and the best choice is kept in which no element stands in a dropped one.
"""

from __future__ import annotations

import io
import pkgutil
from functools import cache
from html import unescape
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import boosting, dom
from .common import ddl, per_batch, tune, with_text
from .sample_pages import sample_pages

#: Production parameters: made-up pages that the trees are fitted on.
PAGES = 1500
SEED = 42


def fitted(pages: int = PAGES, seed: int = SEED) -> boosting.Boosted:
    """Trees fitted on made-up pages; the same numbers give the same trees."""
    parsed, labels = [], []
    for html, known, _ in sample_pages(pages, seed):
        page = dom.Page(html)
        if len(page.tag) == len(known):
            parsed.append(page)
            labels += known
    return boosting.fit(dom.features(parsed), np.array(labels, np.float64))


@cache
def model() -> boosting.Boosted:
    """The trees as ``fitted`` made them, read once in a process."""
    saved = np.load(io.BytesIO(pkgutil.get_data(__package__, "trees.npz")))
    return boosting.Boosted(saved["feature"], saved["cut"], saved["leaf"], float(saved["base"]))


def extract(htmls: list[str | None], trees: boosting.Boosted) -> list[str]:
    """Main text of each page."""
    pages = [dom.Page(h or "") for h in htmls]
    logit = trees.logit(dom.features(pages)) if pages else np.empty(0)
    out, at = [], 0
    for page in pages:
        out.append(dom.main_text(page, logit[at : at + len(page.tag)]))
        at += len(page.tag)
    return out


def expected(blocks: list[str]) -> str:
    """Main text as ``extract`` gives it, from the blocks of a made-up page."""
    return "\n".join(t for t in (" ".join(unescape(b).split()) for b in blocks) if t)


def main_texts(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), trees: boosting.Boosted | None = None) -> DataFrame:
    """The columns ``keep`` of ``pages``, with ``text`` and ``n_chars`` (its code points).

    ``text``: blocks of the article in page order, joined by line breaks, with character references
    decoded and white space within a block as single spaces; without menus, headers, footers,
    sidebars, notices, adverts, forms, comments of readers, scripts and styles.

    A null or empty page, or one where nothing is worth keeping, has an empty text. Pages of any
    length and depth are taken whole; broken markup is read as far as it can be. Repeated rows are
    read each for itself; an empty table gives no rows; only the named columns are read.
    """
    tune(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(trees or model())
    source, name = with_text(pages, keep, html)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = extract(batch.column(name).to_pylist(), shared.value)
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return source.mapInArrow(per_batch(run), ddl(source.select(*keep), "text string, n_chars long"))


if __name__ == "__main__":
    np.savez_compressed(Path(__file__).with_name("trees.npz"), **fitted()._asdict())
