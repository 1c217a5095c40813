r"""Main text of web pages by a tree-structured graphical model.

A page's block elements are the nodes of a tree, each with a hidden label: content or not. Node potentials are linear in
features of an element (its tag, its names and roles, the length, links and punctuation of its text); parent-child
potentials depend on both labels and the kind of child. Sum-product passes messages up to the root and down again, which
on a tree gives exact marginals. The weights maximise the likelihood of labelled pages (``page_samples``), whose
gradient is what those marginals give; training takes ``TRAINING_PAGES`` pages, a bound that no input changes. The trained weights,
fewer than a hundred, lie in ``page_weights.json``; ``python -m threadloom.llm.html_text`` trains them anew.

A text block is kept if its element's marginal for content is above one half. Character references are decoded, white space in a
block becomes one space, blocks are joined in page order by one newline; scripts, styles and comments are no text, formulas are (without
their annotations).

Defined results: null or empty html gives an empty text; unclosed and stray tags are read as browsers do for
paragraphs, list items and cells; long and deep pages are read whole, without recursion, in time linear in their length; repeated pages give a row each; empty table,
empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from threadloom.session import ship

TRAINING_PAGES, SEED, EPOCHS = 300, 7, 40
# Elements that break lines, elements without content, elements whose content is no markup.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style title textarea noscript iframe noembed noframes xmp template svg annotation annotation-xml object canvas audio video".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_BAD = re.compile(r"(?:^|[\s_\-\"'=])(nav|navbar|navigation|topnav|menu|header|masthead|top-?bar|branding|footer|bottom|copyright|legal|side-?bar|aside|side|widget|related|recommend\w*|notice|cookies?|consent|alert|gdpr|pop-?up|modal|ads?|advert\w*|sponsor\w*|promo\w*|banner|newsletter|subscri\w*|search|login|signup|contact|comments?|respond|repl(?:y|ies)|discussion|share|social|toolbar|breadcrumbs?|pagination|hidden|display:\s*none)(?=$|[\s_\-\"';])", re.I)
_GOOD = re.compile(r"(?:^|[\s_\-\"'=])(content|article|post|entry|story|main|text|page|body)(?=$|[\s_\-\"';])", re.I)
_NAMES = re.compile(r"""(?:class|id|role|style|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|\bhidden\b""", re.I)
_KINDS = {"p": 0, "h1": 1, "h2": 1, "h3": 1, "h4": 1, "h5": 1, "h6": 1, "li": 2, "ul": 2, "ol": 2, "td": 2, "tr": 2, "table": 2, "tbody": 2, "article": 3, "main": 3, "div": 4, "section": 4}
_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "td", "tr", "table", "article", "main", "div", "section", "nav", "header", "footer", "aside", "form", "label", "button", "blockquote", "pre", "figure", "figcaption", "body")
N_KINDS, _FIRST = 6, {t: k for k, t in enumerate(_TAGS)}
_BASE = len(_TAGS) + 1
N_FEATURES = _BASE + 2 + 5 + 3 + 3 + 6 + 5 + 15


class Tree:
    """Block elements in page order (a parent before its children) and the text blocks with their element."""

    def __init__(self, page: str | None):
        self.parent, self.tag, self.names, self.label = [-1], ["html"], [""], [-1]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(page or "")

    def _read(self, page: str) -> None:
        stack, pieces, links, link, at, hidden = [0], [], 0, 0, 0, 0
        opened: Counter = Counter()  # how often each tag is open, so that what isn't there is not looked for

        def close(k: int) -> None:
            nonlocal hidden
            for x in stack[k:]:
                opened[self.tag[x]] -= 1
                hidden -= self.tag[x] == "head"
            del stack[k:]

        def flush() -> None:
            nonlocal pieces, links
            if pieces:
                text = " ".join(html.unescape("".join(pieces)).split())
                if text and not hidden:
                    self.blocks.append((stack[-1], text, links))
                pieces, links = [], 0

        search, size = _TAG.search, len(page)
        while at < size:
            m = search(page, at)
            upto = m.start() if m else size
            if upto > at:
                pieces.append(page[at:upto])
                links += link and upto - at
            if not m:
                break
            at = m.end()
            closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if name == "a":
                link = 0 if closing else 1
            elif name in RAW_TAGS:
                if not closing and not rest.endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = end.end() if end else size
            elif name == "br":
                pieces.append(" ")
            elif name in VOID_TAGS:
                if name == "hr":
                    flush()
            elif name in BLOCK_TAGS:
                flush()
                tags = self.tag
                if closing:
                    if opened[name]:
                        close(next(k for k in range(len(stack) - 1, 0, -1) if tags[stack[k]] == name))
                    continue
                known = re.search(r'data-y="([01])"', rest) if rest else None
                if name == "html" and known:
                    self.label[0] = int(known[1])
                if name == "html" or (name == "body" and opened[name]):
                    continue
                if name == "body" and hidden:
                    close(next(k for k, x in enumerate(stack) if tags[x] == "head"))
                if tags[stack[-1]] == "p":
                    close(len(stack) - 1)
                if name in CLOSES and any(opened[x] for x in CLOSES[name][0].split()):
                    own, stop = CLOSES[name]
                    for k in range(len(stack) - 1, 0, -1):
                        if tags[stack[k]] in stop:
                            break
                        if tags[stack[k]] in own.split():
                            close(k)
                            break
                hidden += name == "head"
                self.parent.append(stack[-1])
                tags.append(name)
                self.names.append(" ".join(x.group() for x in _NAMES.finditer(rest)) if rest else "")
                self.label.append(int(known[1]) if known else -1)
                stack.append(len(tags) - 1)
                opened[name] += 1
        flush()

    def features(self) -> list[list[int]]:
        """Indices of each element's features."""
        n = len(self.parent)
        own, linked, last = [0] * n, [0] * n, [""] * n
        for node, text, links in self.blocks:
            own[node] += len(text)
            linked[node] += min(links, len(text))
            last[node] = text[-1]
        below, below_links = own[:], linked[:]
        for k in range(n - 1, 0, -1):
            below[self.parent[k]] += below[k]
            below_links[self.parent[k]] += below_links[k]
        paragraphs = [0] * n
        for k in range(1, n):
            paragraphs[self.parent[k]] += self.tag[k] == "p"
        total, out = max(below[0], 1), []
        for k in range(n):
            f = [_FIRST.get(self.tag[k], len(_TAGS))]
            if names := self.names[k]:
                if _BAD.search(names):
                    f.append(_BASE)
                elif _GOOD.search(names):
                    f.append(_BASE + 1)
            # how paragraphs and items read is left out: many short ones would outvote the element that holds them
            plain = _KINDS.get(self.tag[k], 5) < 3
            size = own[k]
            if not plain:
                f.append(_BASE + 2 + (0 if not size else 1 if size < 25 else 2 if size < 90 else 3 if size < 300 else 4))
            share = below_links[k] / below[k] if below[k] else 0.0
            f.append(_BASE + 7 + (0 if share < 0.3 else 1 if share < 0.7 else 2))
            if not plain:
                f.append(_BASE + 10 + (0 if not last[k] else 1 if last[k] in ".!?:" else 2))
            share, n_p = below[k] / total, paragraphs[k]
            leaf = own[k] == below[k]
            f.append(_BASE + 13 + (5 if leaf else 0 if share < 0.1 else 1 if share < 0.3 else 2 if share < 0.6 else 3 if share < 0.85 else 4))
            many = 0 if not n_p else 1 if n_p < 3 else 2 if n_p < 6 else 3 if n_p < 12 else 4
            f.append(_BASE + 19 + many)
            if self.tag[k] in ("html", "body"):  # these hold content themselves on few pages
                f.append(_BASE + 24 + many)
                f.append(_BASE + 29 + (0 if not size else 1 if size < 90 else 2))
            elif not names and self.tag[k] in ("div", "section"):
                f.append(_BASE + 32 + many)
            out.append(f)
        return out

    def kinds(self) -> list[int]:
        return [_KINDS.get(t, 5) for t in self.tag]

    def labels(self) -> list[int]:
        """Known labels, passed down to elements without one of their own; a root without one is no content."""
        out = [max(self.label[0], 0)]
        for k in range(1, len(self.parent)):
            out.append(self.label[k] if self.label[k] >= 0 else out[self.parent[k]])
        return out


def _log_add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


class Model:
    """weights: of the features, for content against not. edges[kind][parent label][child label]: log-potentials."""

    def __init__(self, weights, edges):
        self.weights, self.edges = weights, edges

    def messages(self, tree: Tree, features: list[list[int]] | None = None):
        """Sum-product over the tree: log-odds of every element from below, its upward messages, and all evidence."""
        w, parent = self.weights, tree.parent
        features = features or tree.features()
        kinds, n = tree.kinds(), len(parent)
        below = [sum(w[i] for i in f) for f in features]
        up = [0.0] * n
        for k in range(n - 1, 0, -1):
            (a, b), (c, d) = self.edges[kinds[k]]
            u = below[k]
            up[k] = _log_add(c, d + u) - _log_add(a, b + u)
            below[parent[k]] += up[k]
        full = below[:]
        for k in range(1, n):
            (a, b), (c, d) = self.edges[kinds[k]]
            rest = full[parent[k]] - up[k]
            full[k] = below[k] + _log_add(b, d + rest) - _log_add(a, c + rest)
        return below, up, full

    def text(self, page: str | None) -> str:
        tree = Tree(page)
        if not tree.blocks:
            return ""
        full = self.messages(tree)[2]
        return "\n".join(text for node, text, _ in tree.blocks if full[node] > 0)


def train(pages: list[str], epochs: int = EPOCHS, step: float = 0.5, decay: float = 1e-4) -> Model:
    """Maximum likelihood by adaptive gradient steps; expected counts come from the marginals."""
    import numpy as np

    w, e = np.zeros(N_FEATURES), np.zeros((N_KINDS, 2, 2))
    sw, se = np.full_like(w, 1e-8), np.full_like(e, 1e-8)
    trees = [(t := Tree(p), t.features(), t.kinds(), t.labels()) for p in pages]
    for _ in range(epochs):
        gw, ge = -decay * w * len(trees), -decay * e * len(trees)
        model = Model(w.tolist(), e.tolist())
        for tree, features, kinds, y in trees:
            below, up, full = model.messages(tree, features)
            for k, f in enumerate(features):
                gw[f] += y[k] - 1.0 / (1.0 + math.exp(-max(min(full[k], 500.0), -500.0)))
            for k in range(1, len(kinds)):
                parent = tree.parent[k]
                rest, table = full[parent] - up[k], model.edges[kinds[k]]
                joint = [table[0][0], table[0][1] + below[k], table[1][0] + rest, table[1][1] + rest + below[k]]
                top = max(joint)
                mass = [math.exp(j - top) for j in joint]
                total = sum(mass)
                for j in range(4):
                    ge[kinds[k], j >> 1, j & 1] -= mass[j] / total
                ge[kinds[k], y[parent], y[k]] += 1.0
        sw += gw * gw
        se += ge * ge
        w += step * gw / np.sqrt(sw)
        e += step * ge / np.sqrt(se)
    return Model(w.tolist(), e.tolist())


WEIGHTS = Path(__file__).with_name("page_weights.json")


def trained() -> Model:
    """The model of the built-in labelled pages, as stored."""
    return Model(**json.loads(WEIGHTS.read_text()))


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text) of every row of pages(page_id, url, html)."""
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([model.text(x.as_py()) for x in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["page_id", "url", "text"])

    ship(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")


if __name__ == "__main__":
    from threadloom.llm.page_samples import labelled_pages

    made = train(labelled_pages(TRAINING_PAGES, SEED))
    rounded = {"weights": [round(x, 6) for x in made.weights], "edges": [[[round(x, 6) for x in row] for row in table] for table in made.edges]}
    WEIGHTS.write_text(json.dumps(rounded) + "\n")
