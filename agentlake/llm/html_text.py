"""HTML extraction: the main text of a page by gradient-boosted trees over its
DOM nodes and hierarchical decoding.

A tolerant parser makes the tree of block elements, with the text runs between
block boundaries. Every block node gets features: density of text, links and
tags in its subtree, words of its attributes and of its ancestors', depth, and
statistics of its siblings. Boosted trees (logistic loss, histogram splits, in
numpy) give the log-odds that a node's text is main text. Decoding then labels
the whole tree at once: a node is all content, all boilerplate, or mixed, and
only below a mixed node may labels differ, so no kept node hangs under a
dropped one. The best labelling is found by one pass from the leaves up.

Training takes at most ``max_pages`` pages, those with the smallest hash of
page_id (a bounded, documented sample). Their own marks (article, main, nav,
footer, ...) label them; their sentences also fill layouts without such marks,
composed at random (class names only, bare tables, comments, forms, notices,
sidebars), so that the trees do not lean on one tag. Extraction reads every
whole page once, row by row.

Defined results: null and empty pages give the empty string; text in no element
is a block of its own; white space is what str.split takes; ``br`` is white space;
scripts, styles, templates and comments hold no text (nor do buttons, objects and
the like, if they are closed; what follows an unclosed one is text of the page); repeated rows
give equal results; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.llm.common import small_batches

MAX_PAGES, TREES, DEPTH, RATE, BINS, SEED = 200, 40, 3, 0.3, 32, 5

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page. The first hold text, not tags, so they last to their end tag or to
#: the page's end; without an end tag the others are passed over like inline elements.
RAW_TEXT = frozenset("script style textarea title".split())
RAW = RAW_TEXT | frozenset("noscript template svg iframe object select button canvas audio video".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = frozenset("table td th ul ol dl div section article body blockquote form".split())

AWAY_TAGS = frozenset("nav header footer aside form menu fieldset search dialog legend".split())
MAIN_TAGS = frozenset(("article", "main"))
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote td dd dt figcaption".split())
#: Words of class, id, role and aria-label attributes.
AWAY_WORDS = frozenset("ad ads advert advertisement adsense alert author banner bio breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright discussion disqus feedback foot footer form gdpr head header login masthead menu meta modal nav navbar navigation newsletter notice notification pager pagination popup privacy promo promoted recommended related reply replies respond review reviews search share sharing sidebar side signup skip social sponsor sponsored subscribe subscription tags toolbar topbar trending warning widget complementary contentinfo".split())
MAIN_WORDS = frozenset("article articlebody body blog content contents copy entry main page post prose story text".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|aria-label|hidden|style|data-gold)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")

FEATURES = ("depth", "text", "own", "links", "density", "paragraphs", "stops", "commas", "children", "place", "siblings", "alike", "share", "offset", "away_tag", "main_tag", "text_tag",
            "away_word", "main_word", "away_above", "main_above", "away_tag_above", "main_tag_above", "mean_sibling", "items", "controls", "mean_block", "run_above", "hidden")


class Page:
    """The block elements of a page, in page order; a node's parent stands before it."""

    def __init__(self, html: str, marked: bool = False):
        """``marked``: data-gold attributes are labels (of composed pages; elsewhere they mean nothing)."""
        self.marked = marked
        self.parent, self.tag, self.marks = [-1], ["#root"], [(0, 0, 0, "")]
        self.runs: list[tuple[int, str, int]] = []  # node, text, characters in links
        self.tags, self.controls = [0], [0]
        self._parse(html)

    def _parse(self, html: str) -> None:
        stack, names = [0], ["#root"]  # open block nodes and, with inline ones, open names
        open_, buf, links, in_link, at = [(0, "#root")], [], 0, 0, 0
        tags, controls = self.tags, self.controls

        def flush():
            nonlocal links
            if buf:
                text = " ".join(unescape("".join(buf)).split())
                if text:
                    self.runs.append((stack[-1], text, min(links, len(text))))
                buf.clear()
                links = 0

        def pop(n: int) -> None:
            nonlocal in_link
            while len(open_) > n:
                node, name = open_.pop()
                if name == "a":
                    in_link = max(0, in_link - 1)
                if node >= 0:
                    flush()
                    stack.pop()

        for m in _TOKEN.finditer(html):
            if m.start() < at:
                continue
            if m.start() > at:
                text = html[at:m.start()]
                buf.append(text)
                if in_link:
                    links += len(text)
            at = m.end()
            if m["cdata"]:
                buf.append(m["cdata"])
            name = m["tag"]
            if not name:
                continue
            name = name.lower()
            if m["close"]:
                if name == "p" and not any(x[1] == "p" for x in open_):
                    continue
                for i in range(len(open_) - 1, 0, -1):
                    if open_[i][1] == name:
                        pop(i)
                        break
                    if open_[i][1] in SCOPE and name not in BLOCKS:
                        break
                continue
            tags[stack[-1]] += 1
            if name in ("input", "select", "button", "textarea"):
                controls[stack[-1]] += 1
            if name in RAW:
                if not m["attrs"].rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                    if end or name in RAW_TEXT:
                        at = end.end() if end else len(html)
                buf.append(" ")
                continue
            if name in VOID:
                buf.append(" ")
                if name == "hr":
                    flush()
                continue
            if name in BLOCKS:
                closes = CLOSES.get(name) or {"p"}
                bound = SCOPE - closes if name not in ("tr", "td", "th", "tbody", "tfoot") else {"table"}
                for i in range(len(open_) - 1, 0, -1):
                    if open_[i][1] in closes:
                        last = i
                        while name in CLOSES and last > 1 and open_[last - 1][1] in closes:
                            last -= 1
                        pop(last)
                        break
                    if open_[i][1] in bound:
                        break
                flush()
                attrs = {k.lower(): (a or b or c or "") for k, a, b, c in _ATTR.findall(m["attrs"])} if m["attrs"] else {}
                words = set(_WORDS.findall(" ".join(attrs.get(k, "") for k in ("class", "id", "role", "aria-label")).lower())) if attrs else set()
                hidden = "hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", "").lower()
                self.parent.append(stack[-1])
                self.tag.append(name)
                self.marks.append((int(bool(words & AWAY_WORDS)), int(bool(words & MAIN_WORDS)), int(hidden), attrs.get("data-gold", "") if self.marked else ""))
                tags.append(1)
                controls.append(0)
                open_.append((len(self.tag) - 1, name))
                stack.append(len(self.tag) - 1)
            else:
                open_.append((-1, name))
                in_link += name == "a"
        if at < len(html):
            buf.append(html[at:])
        pop(1)
        flush()

    def features(self) -> np.ndarray:
        """One row for each node, in the order of FEATURES."""
        n = len(self.parent)
        parent = np.array(self.parent)
        own, links, runs, stops, commas, first = (np.zeros(n) for _ in range(6))
        first[:] = -1
        seen = 0
        for node, text, linked in self.runs:
            own[node] += len(text)
            links[node] += linked
            runs[node] += 1
            stops[node] += text.count(".") + text.count("!") + text.count("?")
            commas[node] += text.count(",")
            if first[node] < 0:
                first[node] = seen
            seen += len(text)
        is_p = np.array([t == "p" for t in self.tag], float)
        is_li = np.array([t in ("li", "option", "dt", "dd") for t in self.tag], float)
        total, linked, blocks, tags, controls, st, co, ps, li = own.copy(), links.copy(), runs.copy(), np.array(self.tags, float), np.array(self.controls, float), stops.copy(), commas.copy(), is_p.copy(), is_li.copy()
        kids, depth, place = np.zeros(n), np.zeros(n), np.zeros(n)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
            place[i] = kids[parent[i]]
            kids[parent[i]] += 1
        for i in range(n - 1, 0, -1):
            p = parent[i]
            for x in (total, linked, blocks, tags, controls, st, co, ps, li):
                x[p] += x[i]
            if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
                first[p] = first[i]
        away_tag, main_tag, text_tag = (np.array([t in s for t in self.tag], float) for s in (AWAY_TAGS, MAIN_TAGS, TEXT_TAGS))
        away, main, hidden = (np.array([m[k] for m in self.marks], float) for k in range(3))
        away_up, main_up, at_up, mt_up, run_up = (np.zeros(n) for _ in range(5))
        alike: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            p = parent[i]
            away_up[i], main_up[i] = max(away_up[p], away[p]), max(main_up[p], main[p])
            at_up[i], mt_up[i] = max(at_up[p], away_tag[p]), max(mt_up[p], main_tag[p])
            run_up[i] = runs[p]
            key = (p, self.tag[i])
            alike[key] = alike.get(key, 0) + 1
        same = np.array([0] + [alike[parent[i], self.tag[i]] for i in range(1, n)], float)
        sib = np.maximum(kids[np.maximum(parent, 0)], 1)
        mean_sib = (total[np.maximum(parent, 0)] - own[np.maximum(parent, 0)]) / sib
        one = np.maximum(total, 1)
        return np.column_stack([
            np.minimum(depth, 30), np.log1p(total), np.log1p(own), linked / one, total / np.maximum(tags, 1), ps, st / one * 100, co / one * 100, kids, place / sib, sib, same, total / max(seen, 1),
            np.maximum(first, 0) / max(seen, 1), away_tag, main_tag, text_tag, away, main, away_up, main_up, at_up, mt_up, np.log1p(mean_sib), li / np.maximum(kids, 1), controls, total / np.maximum(blocks, 1), run_up, hidden])

    def gold(self) -> np.ndarray:
        """1 main text, 0 not, by data-gold marks or else by the page's own sectioning tags."""
        marked = any(m[3] for m in self.marks)
        out = np.zeros(len(self.parent))
        for i in range(1, len(out)):
            up, tag, (away, _, hidden, mark) = out[self.parent[i]], self.tag[i], self.marks[i]
            if marked:
                out[i] = float(mark) if mark else up
            elif tag in MAIN_TAGS:
                out[i] = 1
            else:
                out[i] = up if not (tag in AWAY_TAGS or away or hidden) else 0
        return out

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters of each node's subtree, and those of them that are gold."""
        g = self.gold()
        all_, good = np.zeros(len(g)), np.zeros(len(g))
        for node, text, _ in self.runs:
            all_[node] += len(text)
            good[node] += len(text) * g[node]
        for i in range(len(g) - 1, 0, -1):
            all_[self.parent[i]] += all_[i]
            good[self.parent[i]] += good[i]
        return all_, good

    def decode(self, odds: np.ndarray, mixed: float = -1.0) -> str:
        """The text under the best consistent labelling. The three values of a
        subtree: all content, all boilerplate, mixed (children as they like best;
        text directly in a mixed node goes by the node's own odds)."""
        n = len(self.parent)
        s = np.clip(odds, -6, 6)
        with_text = np.zeros(n, bool)
        direct = np.zeros(n, bool)
        for node, _, _ in self.runs:
            direct[node] = True
        with_text[:] = direct
        for i in range(n - 1, 0, -1):
            with_text[self.parent[i]] |= with_text[i]
        s = np.where(with_text, s, 0.0).tolist()
        content, away = s[:], [-x for x in s]
        mix = [mixed + (abs(s[i]) if direct[i] else 0.0) for i in range(n)]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            content[p] += content[i]
            away[p] += away[i]
            mix[p] += max(content[i], away[i], mix[i])
        keep = [False] * n
        label = [""] * n
        for i in range(n):
            up = label[self.parent[i]] if i else "m"
            if up != "m":
                label[i] = up
            else:
                best = max(content[i], away[i], mix[i])
                label[i] = "m" if i == 0 or best == mix[i] else "c" if best == content[i] else "b"
            keep[i] = label[i] == "c" or label[i] == "m" and s[i] > 0
        return "\n".join(text for node, text, _ in self.runs if keep[node])


# -- boosted trees ------------------------------------------------------------------------------------------------------

def train_trees(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> dict:
    """Logistic gradient boosting; a tree is a complete one of ``depth`` levels."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)])
    base = float(np.log(max((w * y).sum(), 1e-6) / max((w * (1 - y)).sum(), 1e-6)))
    f, model = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = w * (y - p), np.maximum(w * p * (1 - p), 1e-9)
        node, feats, thresholds = np.zeros(len(y), np.int64), [], []
        for level in range(depth):
            width = 1 << level
            best, feat, thr = np.full(width, 1e-6), np.zeros(width, int), np.full(width, bins)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key = node * (bins + 1) + binned[:, j]
                gs = np.bincount(key, g, width * (bins + 1)).reshape(width, -1)
                hs = np.bincount(key, h, width * (bins + 1)).reshape(width, -1)
                gl, hl = gs.cumsum(1), hs.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt ** 2 / (ht + 1)
                gain[:, len(c):] = -1
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better], feat[better], thr[better] = top[better], j, at[better]
            feats.append(feat)
            thresholds.append(thr)
            node = node * 2 + (binned[np.arange(len(y)), feat[node]] > thr[node])
        leaf_g, leaf_h = np.bincount(node, g, 1 << depth), np.bincount(node, h, 1 << depth)
        leaf = rate * leaf_g / (leaf_h + 1)
        f += leaf[node]
        model.append({"f": [a.tolist() for a in feats], "t": [[float(cuts[j][k]) if k < len(cuts[j]) else 1e300 for j, k in zip(a, b)] for a, b in zip(feats, thresholds)], "v": leaf.tolist()})
    return {"base": base, "trees": model}


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    out, rows = np.full(len(x), model["base"]), np.arange(len(x))
    for tree in model["trees"]:
        node = np.zeros(len(x), np.int64)
        for f, t in zip(tree["f"], tree["t"]):
            node = node * 2 + (x[rows, np.array(f)[node]] > np.array(t)[node])
        out += np.array(tree["v"])[node]
    return out


# -- training pages -------------------------------------------------------------------------------------------------------

def composed(rng: np.random.Generator, sentences: list[str]) -> str:
    """A page in a random layout, filled with these sentences, marked by data-gold."""
    def say(a: int, b: int) -> str:
        return " ".join(sentences[k] for k in rng.integers(0, len(sentences), rng.integers(a, b)))

    def few(a: int, b: int) -> str:
        return " ".join(sentences[rng.integers(len(sentences))].split()[:rng.integers(a, b)])

    def one(*options):
        return options[rng.integers(len(options))]

    def attr(*names: str) -> str:
        return one("", "", f' class="{one(*names)}"', f' id="{one(*names)}"', f' class="{one("box", "c1", "row", "x")} {one(*names)}-{one("wrap", "inner", "1")}"')

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{few(1, 4)}</a></li>' for k in range(n))

    def paragraph() -> str:
        p = one(say(1, 4), say(1, 8), few(2, 9), f"<b>{few(2, 6)}</b> {say(1, 4)}", f'{say(1, 3)} <a href="/x">{few(1, 4)}</a> {say(1, 3)}')
        return one(f"<p>{p}</p>", f"<p>{p}</p>", f"<p>{p}", f"<div>{p}</div>", f"<h2>{few(2, 8)}</h2><p>{p}</p>", f"<ul><li>{say(1, 2)}</li><li>{say(1, 3)}</li></ul>", f"<blockquote>{p}</blockquote>")

    body = f"<h1>{few(3, 11)}</h1>" * bool(rng.random() < 0.8) + "".join(paragraph() for _ in range(rng.integers(1, 14)))
    if rng.random() < 0.25:
        inner = one(f'<div class="{one("ad", "advert", "promo", "share", "related")}" data-gold="0">{few(2, 12)}</div>', f'<aside data-gold="0">{say(1, 2)}</aside>', f'<form data-gold="0"><p>{few(2, 8)}</p><input name="q"><button>{few(1, 2)}</button></form>')
        body = body + inner if rng.random() < 0.5 else inner + body
    main = one("article", "main", "div", "div", "section", "td")
    held = f'<{main}{attr("content", "post", "entry", "story", "main", "article-body")} data-gold="1">{body}</{main}>'
    held = f"<table><tr>{held}</tr></table>" if main == "td" else held
    above = [one(f'<nav><ul>{links(rng.integers(2, 9))}</ul></nav>', f'<div{attr("nav", "menu", "topbar")}><ul>{links(rng.integers(3, 9))}</ul></div>', f'<header><p>{few(1, 6)}</p></header>', f'<div class="{one("header", "masthead")}">{few(1, 6)}</div>'),
             one("", f'<div class="{one("ad", "ads", "banner", "sponsored")}">{few(3, 20)}</div>', f'<div class="{one("cookie", "consent", "notice", "alert")}">{say(1, 3)}</div>', f'<form><input><p>{few(1, 5)}</p></form>')]
    beside = one("", f'<aside>{say(1, 3)}</aside>', f'<div class="{one("sidebar", "widget", "related")}"><h3>{few(1, 4)}</h3><ul>{links(rng.integers(2, 7))}</ul></div>', f'<div id="sidebar"><p>{say(1, 3)}</p></div>')
    comments = "".join(f'<{one("div", "li", "p")} class="{one("comment", "reply", "c")}">{say(1, 4)}</p></div>' for _ in range(rng.integers(0, 6)))
    below = [one("", "", f'<{one("section", "div")} {one("id", "class")}="{one("comments", "discussion", "responses comments", "reader-comments")}"><h3>{few(1, 3)}</h3>{comments}</section></div>'),
             one(f"<footer>{few(2, 14)}</footer>", f"<footer><p>{say(1, 2)}</p></footer>", f'<div class="{one("footer", "copyright")}">&copy; {few(2, 12)}</div>', f'<div id="footer"><ul>{links(4)}</ul></div>')]
    if rng.random() < 0.3:
        above.reverse()
    middle = held + beside if rng.random() < 0.6 else beside + held
    wrap = one("{}", "{}", '<div id="wrapper">{}</div>', '<div class="container"><div>{}</div></div>')
    return f"<html><head><title>{few(2, 6)}</title></head><body>" + wrap.format("".join(above) + middle + "".join(below)) + "</body></html>"


def learn(pages: list[str], seed: int = SEED, variants: int = 4) -> dict:
    """The model from sampled pages and layouts composed of their sentences."""
    rng = np.random.default_rng(seed)
    xs, ys, ws = [], [], []

    def add(page: Page) -> None:
        chars, good = page.weights()
        used = chars > 0
        x = page.features()[used]
        share = good[used] / chars[used]
        xs.append(x)
        ys.append((share > 0.5).astype(float))
        # mixed nodes teach less; the sum over a page is the same for all pages
        w = np.abs(2 * share - 1) + 0.05
        ws.append(w / w.sum() * 20)

    for html in pages or ["<article><p>Plain words make up this page, nothing else.</p></article>"]:
        page = Page(html)
        if not page.runs:
            continue
        if page.gold().any():
            add(page)
        sentences = [s for _, t, _ in page.runs for s in re.split(r"(?<=[.!?]) ", t) if len(s) > 3][:400] or ["word"]
        for _ in range(variants):
            add(Page(composed(rng, sentences), marked=True))
    if not xs:
        add(Page(composed(rng, ["Some words.", "Some more words, and again some."]), marked=True))
    return train_trees(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


def fit(pages: DataFrame, max_pages: int = MAX_PAGES, seed: int = SEED) -> str:
    """Trains in one task on a bounded sample; returns the model as JSON."""
    small_batches(pages.sparkSession)
    chosen = pages.where("html IS NOT NULL AND html <> ''").select(F.coalesce("page_id", F.lit(0)).cast("long").alias("page_id"), "html", F.xxhash64("page_id").alias("h")) \
        .orderBy("h", "page_id", F.xxhash64("html")).limit(max_pages).select("page_id", "html")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((int(r.page_id), r.html) for pdf in frames for r in pdf.itertuples())
        yield pd.DataFrame({"model": [json.dumps(learn([h for _, h in rows], seed))]})

    model = chosen.repartition(1).mapInPandas(run, "model string").collect()
    return model[0]["model"] if model else json.dumps(learn([], seed))


def texts_of(htmls: list[str], model: dict) -> list[str]:
    parsed = [Page(h) for h in htmls]
    x = [p.features() for p in parsed]
    odds = log_odds(model, np.concatenate(x)) if x else np.empty(0)
    ends = np.cumsum([0, *map(len, x)])
    return [p.decode(odds[a:b]) for p, a, b in zip(parsed, ends[:-1], ends[1:])]


def extract(pages: DataFrame, model: str, html: str = "html", name: str = "text") -> DataFrame:
    """Adds the main text of every page."""
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # some 100 kB, whatever the input

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trees = json.loads(shared.value)
        for s in batches:
            out = []
            for i in range(0, len(s), 64):
                out += texts_of([h or "" for h in s.iloc[i:i + 64]], trees)
            yield pd.Series(out, dtype=object)

    return pages.withColumn(name, main_text(F.coalesce(F.col(html), F.lit(""))))
