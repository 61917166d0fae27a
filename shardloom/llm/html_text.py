"""HTML extraction (operator 4): main text by parser events and text-to-tag ratios.

The standard library's parser turns a page into lines, one per block of text,
each with the number of tags seen in it and the containers around it.  Lines of
menus, headers, footers, asides, forms, scripts, hidden parts and containers
that are named as an advert, a notice, a sidebar or a comment area (``_STRONG``)
are left out.  Each other line's ratio of text to tags is smoothed with a
Gaussian; lines whose smoothed ratio passes a threshold (a share of the ratios'
standard deviation) form the content clusters.

The region: where an ``article`` or ``main`` holds clustered lines, all of them;
else the innermost container that holds ``SHARE`` of the clustered text.  Every
line of the region is kept, however short, and without an article also every
clustered line outside it that passes by its own ratio too; the other lines,
such as lists of links, are not.
Containers whose names only resemble those of ``_STRONG`` (``_WEAK``) count as
outside where none of their lines is clustered, and never add lines to it.  Names of paragraphs, headings
and items never matter.

White space in a line becomes one space, lines are joined by two line feeds.
Rows: one per input row, repeated rows included.  A null, empty or text-free
page gives an empty text.  Very long pages are parsed whole, one at a time.  Of
containers that hold the same text the innermost counts.  Other columns are kept
as they are, but ``text`` and ``n_chars`` replace columns of these names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.common import table, text_of

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
_MARKED = frozenset("nav footer aside form script style noscript template head title button select textarea input iframe object svg canvas menu dialog search".split())
_SILENT = frozenset("script style noscript template head svg iframe object canvas".split())
_CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption html body article main".split())
_STRONG = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies cookie-notice cookie-banner cookie-consent consent gdpr notice notices popup modal overlay newsletter newsletter-signup subscribe paywall sidebar side-bar aside rail widget widgets related related-posts related-articles recommended share sharing share-buttons social social-share comment comments comment-list comments-area reader-comments replies reply respond disqus disqus_thread nav navbar navigation menu breadcrumb breadcrumbs pagination pager masthead footer site-footer site-header page-header topbar toolbar skip-link login signup search search-form copyright".split())
_WEAK = re.compile(r"(?:^|[_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|notice\w*|popup\w*|modal\w*|newsletter\w*|subscri\w*|sidebar\w*|widget\w*|related\w*|recommend\w*|share|social\w*|comment\w*|replies|reply|nav|navbar\w*|menu\w*|breadcrumb\w*|pagination|footer\w*|disclaimer)(?=$|[_-])")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")
#: Share of the ratios' standard deviation that a content line passes, width of the Gaussian in lines, and share of clustered text that the region holds.
THRESHOLD, SIGMA, SHARE = 0.5, 1.0, 0.85


class Lines(HTMLParser):
    """Parser whose events become lines: (text, tags, containers, marked, weak), ``weak`` being the outermost weakly named container, or -1."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, tuple[int, ...], bool, int]] = []
        self.open: list[tuple[str, int, bool, bool, int]] = []  # tag, number, marked, silent, weak
        self.kind: list[str] = []
        self.text: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        if self.text:
            line = _SPACE.sub(" ", "".join(self.text)).strip()
            self.text = []
            if line:
                last = self.open[-1] if self.open else ("", -1, False, False, -1)
                self.lines.append((line, self.tags, tuple(x[1] for x in self.open), last[2], last[4]))
                self.tags = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in _BLOCK:
            self.flush()
            for k in range(len(self.open) - 1, -1, -1):  # an open paragraph, and what is open in it, ends here
                if self.open[k][0] in _CLOSED_BY_BLOCK:
                    del self.open[k:]
                    break
                if self.open[k][0] in _BLOCK:
                    break
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and self.open and self.open[-1][0] == tag:
                self.open.pop()
        elif tag == "br":
            self.text.append(" ")
        if tag in _VOID:
            return
        values = dict(attrs)
        inside = any(x[0] in ("article", "main") for x in self.open)
        _, _, marked, silent, weak = self.open[-1] if self.open else ("", -1, False, False, -1)
        marked = marked or tag in _MARKED or (tag == "header" and not inside) or str(values.get("role")).lower() in _ROLES or "hidden" in values or str(values.get("aria-hidden")).lower() == "true" or _HIDDEN.search(values.get("style") or "") is not None
        if tag in _BLOCK and tag not in _TEXT:
            names = f"{values.get('class') or ''} {values.get('id') or ''}".lower().split()
            marked = marked or any(n in _STRONG for n in names)
            if weak < 0 and any(_WEAK.search(n) for n in names):
                weak = len(self.kind)
        self.open.append((tag, len(self.kind), marked, silent or tag in _SILENT, weak))
        self.kind.append(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if any(x[0] in _BLOCK for x in self.open[k:]):
                    self.flush()
                del self.open[k:]
                return
            if tag not in _BLOCK and self.open[k][0] in _BLOCK:
                return  # an inline end tag doesn't close a block
        if tag == "p":
            self.flush()

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][3]):
            self.text.append(data)


def smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing that keeps the length and reflects nothing beyond the ends."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight


def _parsed(html: str) -> Lines:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser


def main_text(html: str | None, threshold: float = THRESHOLD, sigma: float = SIGMA, share: float = SHARE) -> str:
    """The main text of one page; see the module."""
    if not html:
        return ""
    try:
        parser = _parsed(html)
    except AssertionError:  # the parser gives up on some broken declarations; they are then text
        parser = _parsed(html.replace("<![", "&lt;!["))
    free = [(text, tags, within, weak) for text, tags, within, marked, weak in parser.lines if not marked]
    if not free:
        return ""
    plain = np.array([len(text) / max(tags, 1) for text, tags, _, _ in free])
    ratios = smooth(plain, sigma)
    bound = min(threshold * ratios.std(), ratios.max())
    content = ratios >= bound
    # Weakly named containers without a clustered line are left out.
    telling = {weak for (_, _, _, weak), good in zip(free, content) if good}
    free, content, plain = zip(*[x for x in zip(free, content, plain) if x[0][3] < 0 or x[0][3] in telling])
    held: dict[int, int] = {}
    for (text, _, within, _), good in zip(free, content):
        if good:
            for n in within:
                held[n] = held.get(n, 0) + len(text)
    total = sum(len(x[0]) for x, good in zip(free, content) if good)
    for tag in ("article", "main"):
        if any(parser.kind[n] == tag for n in held):
            return "\n\n".join(text for text, _, within, _ in free if any(parser.kind[n] == tag for n in within))
    inner = [n for n, size in held.items() if size >= share * total and parser.kind[n] in _BLOCK and parser.kind[n] not in _CLOSED_BY_BLOCK]
    region = max(inner) if inner else None
    # Outside the region a line needs a ratio of its own, not only good neighbours, and no doubtful name.
    own = [good and ratio >= bound and x[3] < 0 for x, good, ratio in zip(free, content, plain)]
    return "\n\n".join(text for (text, _, within, _), good in zip(free, own) if good or region is None or region in within)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html`` but with ``text`` and ``n_chars`` in code points; a column that has one of these names is replaced."""
    rest = [f for f in pages.schema.fields if f.name not in (html, "text", "n_chars")]
    plain = pages.select(*[F.col(f.name) for f in rest], text_of(html).alias(html))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [main_text(x) for x in part.column(html).to_pylist()]
                names = [f.name for f in rest]
                yield pa.record_batch([*[part.column(n) for n in names], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], "text string", "n_chars long"])
    return plain.mapInArrow(run, schema)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
