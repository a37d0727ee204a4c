"""Main-text extraction by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, inline tags joined through.  Each
block is a vector of its tag path (tags, classes, ids and roles of its ancestors, hashed), of its words
(hashed, averaged), and of a few measures.  A bidirectional LSTM in numpy reads a page's blocks forwards
and backwards, so each is classified with the whole page in view; the blocks kept are joined in page
order by a space.

The labeller is trained here, on pages that ``lesson`` makes up: articles among menus, headers, footers,
sidebars, notices, adverts, forms and reader comments, under many usual tags and class names, with
invented words.  Training is deterministic, takes seconds on the driver and does not depend on the input;
the weights that go to the workers are a few kilobytes.

Defined results: a null page is the empty page, whose text is empty.  Scripts, styles, comments of the
markup and titles have no blocks, whatever they hold; nor have frames, form fields and templates.  Formulas,
drawings' words, and what stands in for objects, canvases and scripts are text like other text.  Tags that
aren't closed end with their parent; stray ends are ignored; a tag that the page breaks off in goes, and so
does the rest after a comment, script or style without an end.  The scan is one pass over the page, in time
proportional to its length.  Repeated rows give repeated rows.  Pages are independent, so skew of any column is of no effect.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import vectors as V

PATH_DIM, WORD_DIM, MEASURES, HIDDEN, GROUP, NEAREST = 40, 8, 6, 14, 128, 32
# Tags within a line of text, tags without an end, tags whose content is no text of the page, and what a new block ends.
INLINE = frozenset("a abbr acronym b bdi bdo big canvas cite code data del dfn em font i ins kbd label mark math nobr object q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
HIDDEN_TAGS = frozenset("template select datalist".split())
DRAWN = frozenset("svg math".split())
DRAWN_NOTES = frozenset("script style title desc metadata annotation annotation-xml".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP, _BLANK, _BARE = re.compile(r"[>=]"), re.compile(r"\s*"), re.compile(r"[^\s>]*")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")


def pieces(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """(text, tag, attributes, is an end): text up to the next tag, then the tag ('' at the end of the page).

    One pass: a position is never gone back to, and a closing mark that is once not found isn't looked for again.
    Quotes count only after an equals sign; one that isn't closed is a plain character.  The content of RAW
    elements, comments and declarations are passed over; a RAW element without an end is a tag without content,
    except that scripts and styles go on to the end of the page.
    """
    n, at, start, gone = len(page), 0, 0, set()
    last = {q: page.rfind(q) for q in ("\"", "'", "]]>")}
    text: list[str] = []
    drawn = ""
    while (i := page.find("<", at)) >= 0:
        m = _TAG.match(page, i)
        if m is None:
            if page.startswith("<!--", i):
                end = page.find(">", i) + 1 if page.startswith((">", "->"), i + 4) else page.find("-->", i + 4) + 3
                end = end if end > i else n
            elif page.startswith("<![CDATA[", i) and last["]]>"] > i:
                end = page.find("]]>", i) + 3
            elif page.startswith(("<!", "<?", "</"), i):
                end = page.find(">", i) + 1 or n
            else:  # a plain character
                at = i + 1
                continue
            text.append(page[start:i])
            at = start = end
            continue
        j = m.end()
        while (stop := _STOP.search(page, j)) is not None and stop[0] == "=":
            j = _BLANK.match(page, stop.end()).end()
            q = page[j : j + 1]
            if q in ("\"", "'"):
                j = page.find(q, j + 1) + 1 if last[q] > j else j + 1
            else:
                j = _BARE.match(page, j).end()
        text.append(page[start:i])
        if stop is None:  # a tag that never ends
            at = start = n
            break
        tag, attrs, ends = m[1].lower(), page[m.end() : stop.start()], page[i + 1] == "/"
        at = start = stop.end()
        closed = attrs.endswith("/")
        if drawn and (tag in CLOSES_P or tag in SELF_CLOSING or (ends and tag == drawn)):
            drawn = ""
        elif drawn:
            if drawn == "svg":
                text.append(" ")
            if ends or closed or tag not in DRAWN_NOTES:
                continue
        elif tag in DRAWN and not ends and not closed:
            drawn = tag
        if not ends and (tag in RAW or (drawn and tag in DRAWN_NOTES)) and tag not in gone:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            if end is not None:
                at = start = page.find(">", end.end()) + 1 or n
            elif tag in ("script", "style"):
                at = start = n
            else:
                gone.add(tag)
            if drawn:
                continue
        yield "".join(text), tag, attrs, ends
        text.clear()
    text.append(page[start:])
    yield "".join(text), "", "", False


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters within links) of the leaf blocks; path: the ancestors' tokens, outermost first.

    Of deeper paths the NEAREST outermost and innermost ancestors count.
    """
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    still: Counter[str] = Counter()  # open elements by tag
    buf: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        if buf:
            text = _SPACE.sub(" ", html.unescape("".join(buf))).strip()
            # Further white space characters end up as one space too.
            text = " ".join(text.split())
            if text:
                path = stack if len(stack) <= 2 * NEAREST else stack[:NEAREST] + stack[-NEAREST:]
                out.append((tuple(t for _, ts in path for t in ts), text, min(links, len(text))))
            buf.clear()
        links = 0

    def close(i: int) -> None:
        for tag, _ in stack[i:]:
            still[tag] -= 1
        del stack[i:]

    for text, tag, attrs, ends in pieces(page or ""):
        if text and not any(still[t] for t in HIDDEN_TAGS):
            buf.append(text)
            links += len(text) if still["a"] else 0
        if ends:
            if tag not in INLINE:
                flush()
                if still[tag]:
                    close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            elif stack and stack[-1][0] == tag:
                close(len(stack) - 1)
            continue
        if tag == "br":
            buf.append(" ")
            continue
        if not tag or tag in RAW:
            continue
        if tag == "a" and stack and stack[-1][0] == "a":  # links don't nest
            close(len(stack) - 1)
        if tag not in INLINE:
            flush()
            over = SELF_CLOSING.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            if any(still[t] for t in over):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in over:
                        close(i)
                        break
                    if stack[i][0] not in INLINE and stack[i][0] != "p":
                        break
        if tag in VOID:
            continue
        tokens = (tag,)
        if "=" in attrs:
            tokens += tuple(f".{x.lower()}" for a in _ATTR.finditer(attrs) for x in _NAME.findall(a[2] or a[3] or a[4] or ""))
        if tag not in INLINE or tag == "a":
            stack.append((tag, tokens))
            still[tag] += 1
    flush()
    return out


def _random(key: str, dim: int) -> np.ndarray:
    return np.random.default_rng(zlib.crc32(key.encode())).standard_normal(dim).astype(np.float32)


_tokens: dict[str, np.ndarray] = {}
_paths: dict[tuple[str, ...], np.ndarray] = {}
_words = np.random.default_rng(7).standard_normal((4096, WORD_DIM)).astype(np.float32)


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    got = _paths.get(path)
    if got is None:
        v = np.zeros(PATH_DIM, np.float32)
        for t in set(path):
            if t not in _tokens:
                if len(_tokens) > 50_000:
                    _tokens.clear()
                _tokens[t] = _random(t, PATH_DIM)
            v += _tokens[t]
        got = v / 2
        if len(_paths) > 20_000:
            _paths.clear()
        _paths[path] = got
    return got


def features(pages: list[list[tuple[tuple[str, ...], str, int]]]) -> list[np.ndarray]:
    """One matrix a page: a row for each block."""
    flat = [b for p in pages for b in p]
    x = np.zeros((len(flat), PATH_DIM + WORD_DIM + MEASURES), np.float32)
    if flat:
        x[:, :PATH_DIM] = [_path_vector(b[0]) for b in flat]
        raw, off = V.batch_texts(pa.array([b[1] for b in flat]))
        for i, j in V.chunks(off):
            part, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
            s, e, doc = V.words(part, o)
            if len(s):
                h = (V.span_hash(V.LOWER[part], s, e) >> V.U(52)).astype(np.int64)
                n = np.bincount(doc, minlength=j - i)
                for k in range(WORD_DIM):
                    x[i:j, PATH_DIM + k] = np.bincount(doc, _words[h, k], j - i) / np.sqrt(np.maximum(n, 1))
                x[i:j, PATH_DIM + WORD_DIM + 1] = np.log1p(n) / 4
        size = np.array([len(b[1]) for b in flat], np.float32)
        x[:, PATH_DIM + WORD_DIM] = np.log1p(size) / 5
        x[:, PATH_DIM + WORD_DIM + 2] = np.array([b[2] for b in flat]) / size
        x[:, PATH_DIM + WORD_DIM + 3] = [b[1][-1] in ".!?:;" for b in flat]
        at = 0
        for p in pages:
            n = len(p)
            x[at : at + n, -2] = np.linspace(0, 1, n) if n else 0
            x[at : at + n, -1] = min(np.log1p(n) / 5, 0.8)
            at += n
    ends = np.cumsum([len(p) for p in pages])
    return np.split(x, ends[:-1]) if pages else []


@dataclass
class Labeller:
    """w: for both directions the LSTM's matrix (inputs, state and one for the bias -> 4 gates); out: the last layer."""

    w: list[np.ndarray]
    out: np.ndarray

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Probabilities of a batch x (pages, blocks, features); keep: also what training needs."""
        n, t, _ = x.shape
        hs, saved = [], []
        for way, w in enumerate(self.w):
            h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            all_h, steps = np.zeros((n, t, HIDDEN), np.float32), []
            inputs = x @ w[: x.shape[2]] + w[-1]
            for i in range(t) if way == 0 else range(t - 1, -1, -1):
                z = inputs[:, i] + h @ w[x.shape[2] : -1]
                g = np.tanh(z[:, 3 * HIDDEN :])
                s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
                live = mask[:, i : i + 1]
                c2 = s[:, HIDDEN : 2 * HIDDEN] * c + s[:, :HIDDEN] * g
                h2 = s[:, 2 * HIDDEN :] * np.tanh(c2)
                if keep:
                    steps.append((i, s, g, c, c2, h, live))
                c, h = np.where(live, c2, c), np.where(live, h2, h)
                all_h[:, i] = h
            hs.append(all_h)
            saved.append(steps)
        both = np.concatenate([*hs, np.ones((n, t, 1), np.float32)], 2)
        p = 1 / (1 + np.exp(-(both @ self.out)))
        return (p, both, saved) if keep else p


def _train_step(m: Labeller, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    p, both, saved = m.run(x, mask, keep=True)
    total = mask.sum()
    loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total)
    dz = mask * (p - y) / total
    grads = []
    dboth = dz[:, :, None] * m.out[None, None, :]
    d = x.shape[2]
    for way, w in enumerate(m.w):
        gw = np.zeros_like(w)
        dh_next, dc_next = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
        for i, s, g, c, c2, h, live in reversed(saved[way]):
            dh = dboth[:, i, way * HIDDEN : (way + 1) * HIDDEN] + dh_next
            ig, fg, og = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            tc = np.tanh(c2)
            dhl = dh * live
            dc = dc_next * live + dhl * og * (1 - tc * tc)
            dzs = np.concatenate([dc * g * ig * (1 - ig), dc * c * fg * (1 - fg), dhl * tc * og * (1 - og), dc * ig * (1 - g * g)], 1)
            gw[:d] += x[:, i].T @ dzs
            gw[d:-1] += h.T @ dzs
            gw[-1] += dzs.sum(0)
            dh_next = dzs @ w[d:-1].T + dh * (1 - live)
            dc_next = dc * fg + dc_next * (1 - live)
        grads.append(gw)
    return loss, [*grads, np.einsum("nt,nth->h", dz, both)]


# --- lessons: made-up pages whose main text is known ----------------------------------------------

_GOOD = ["article", "main", "section", "div class='content'", "div class='post-body'", "div id='main-content'", "div class='entry-content'", "div class='article-text'", "div role='main'", "div"]
_MENU = ["nav", "ul class='menu'", "div class='nav'", "div id='navigation'", "div class='breadcrumbs'", "div role='navigation'", "div class='topbar'"]
_HEAD = ["header", "div class='header'", "div id='site-header'", "div class='masthead'", "div class='banner'"]
_FOOT = ["footer", "div class='footer'", "div id='footer'", "div class='copyright'", "div class='site-footer'"]
_SIDE = ["aside", "div class='sidebar'", "div id='sidebar'", "div class='related'", "div class='widget'", "div class='recommended'", "section class='promo'"]
_NOTE = ["div class='cookie-notice'", "div class='notice'", "div id='cookie-banner'", "div class='alert'", "div class='consent'", "div class='newsletter'", "div class='popup modal'", "noscript"]
_ADS = ["div class='ad'", "div class='ads'", "div class='advert'", "div class='sponsored'", "div id='advertisement'", "aside class='ad'", "p class='ad'", "div class='ad-slot'"]
_FORM = ["form", "form class='search'", "div class='login-form'", "form id='subscribe'"]
_TALK = ["section class='comments'", "div class='comments'", "div id='comments'", "ol class='comment-list'", "div class='reader-comments'", "div class='discussion'"]


def lesson(rnd: random.Random) -> tuple[str, str]:
    """(page, main text)."""
    parts = [rnd.choice("b c d f g l m n p r s t th st er in on ha".split()) + rnd.choice("a e i o u ea ou".split()) + rnd.choice(["", "n", "r", "st", "ly"]) for _ in range(40)]
    word = lambda: "".join(rnd.choices(parts, k=rnd.randint(1, 3)))
    said = lambda a, b: (" ".join(word() for _ in range(rnd.randint(a, b)))).capitalize() + rnd.choice(["", ".", ".", ".", "!", "?"])
    good: list[str] = []

    def wrap(tag: str, inner: str) -> str:
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def keep(text: str) -> str:
        good.append(text)
        return text

    def body() -> str:
        out = []
        if rnd.random() < 0.8:
            out.append(wrap("h1", keep(said(2, 9))))
        for _ in range(rnd.choice([1, 1, 2, 2, 4, 8, 14]) if rnd.random() < 0.97 else rnd.randint(30, 120)):
            kind = rnd.random()
            if kind < 0.7:
                t = keep(said(*rnd.choice([(1, 3), (5, 20), (20, 60), (60, 120), (120, 400)])) if rnd.random() < 0.93 else " ".join([word()] * rnd.randint(5, 500)))
                out.append(rnd.choice([wrap("p", t), f"<p>{t}", wrap("p", f"<b>{t}</b>"), f"<p><b>{t}<br>", f"<p>{t}<br>", wrap("div", t), wrap("p", f"<em>{t}</em>"), wrap("p", f"<a href='/x'>{t}</a>")] if rnd.random() < 0.5 else [wrap("p", t)]))
            elif kind < 0.8:
                out.append(wrap(rnd.choice(["h2", "h3"]), keep(said(1, 6))))
            elif kind < 0.9:
                out.append(wrap(rnd.choice(["ul", "ol"]), "".join(wrap("li", keep(said(2, 12))) for _ in range(rnd.randint(2, 5)))))
            elif kind < 0.92:
                out.append(wrap(rnd.choice(["noscript", "object", "figure"]), wrap("p", keep(said(3, 20)))))
            elif kind < 0.95:
                out.append(wrap("blockquote", wrap("p", keep(said(5, 30)))))
            else:
                out.append(wrap("table", "".join(wrap("tr", "".join(wrap("td", keep(said(1, 4))) for _ in range(2))) for _ in range(2))))
            if rnd.random() < 0.06:
                out.append(junk(_ADS))
        return "".join(out)

    def junk(kinds: list[str]) -> str:
        # The plain tag, where there is one, is as common as all class names.
        tag = kinds[0] if rnd.random() < 0.4 else rnd.choice(kinds)
        if kinds is _MENU or rnd.random() < 0.25:
            links = [f"<a href='/{word()}'>{said(1, 2)}</a>" for _ in range(rnd.randint(2, 8))]
            inner = wrap("ul", "".join(wrap("li", x) for x in links)) if rnd.random() < 0.7 and not tag.startswith(("p", "ul", "ol")) else " ".join(links)
        elif kinds is _TALK:
            inner = "".join(wrap(rnd.choice(["div class='comment'", "p", "li"]), said(3, 40)) for _ in range(rnd.randint(1, 6)))
        elif kinds is _FORM:
            inner = f"<label>{said(1, 3)}</label><input name='q'><button>{said(1, 2)}</button>"
        else:
            inner = said(1, 30) if tag.startswith("p") or rnd.random() < 0.5 else "".join(wrap(rnd.choice(["p", "div", "h3", "span"]), said(2, 25)) for _ in range(rnd.randint(1, 3)))
        return wrap(tag, inner)

    before = [junk(k) for k in (_HEAD, _MENU, _NOTE, _ADS, _FORM, _SIDE) if rnd.random() < 0.45]
    after = [junk(k) for k in (_SIDE, _TALK, _ADS, _NOTE, _FORM, _MENU, _FOOT) if rnd.random() < 0.45]
    rnd.shuffle(before)
    tag = _GOOD[0] if rnd.random() < 0.3 else rnd.choice(_GOOD)
    inner = wrap(tag, body())
    if rnd.random() < 0.3:
        inner = wrap(rnd.choice(["div class='container'", "div id='page'", "main", "div class='wrapper'"]), "".join(before[:1]) + inner + "".join(after[:1]))
        before, after = before[1:], after[1:]
    page = f"<html><head><title>{said(2, 6)}</title></head><body>{''.join(before)}{inner}{''.join(after)}</body></html>"
    return page, " ".join(good)


def _lesson_labels(parts: list[tuple], text: str) -> list[int]:
    """A block is main text if it is the next of the text's pieces."""
    out, at = [], 0
    for _, t, _ in parts:
        hit = text.startswith(t, at) and (at + len(t) == len(text) or text[at + len(t)] == " ")
        out.append(int(hit))
        at += (len(t) + 1) * hit
    return out


def _batch(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max((len(x) for x in xs), default=0)
    x = np.zeros((len(xs), max(t, 1), PATH_DIM + WORD_DIM + MEASURES), np.float32)
    mask = np.zeros((len(xs), max(t, 1)), np.float32)
    for i, v in enumerate(xs):
        x[i, : len(v)], mask[i, : len(v)] = v, 1
    return x, mask


_trained: dict[tuple, Labeller] = {}


def train(pages: int = 2400, epochs: int = 12, seed: int = 3) -> Labeller:
    """The labeller; once a process for each set of parameters."""
    key = (pages, epochs, seed)
    if key in _trained:
        return _trained[key]
    rnd = random.Random(seed)
    made = [lesson(rnd) for _ in range(pages)]
    parts = [blocks(p) for p, _ in made]
    labels = [_lesson_labels(b, t) for b, (_, t) in zip(parts, made, strict=True)]
    xs = features(parts)
    rng = np.random.default_rng(seed)
    d = PATH_DIM + WORD_DIM + MEASURES
    ws = [(rng.standard_normal((d + HIDDEN + 1, 4 * HIDDEN)) / np.sqrt(d + HIDDEN)).astype(np.float32) for _ in range(2)]
    for w in ws:
        w[-1] = 0
        w[-1, HIDDEN : 2 * HIDDEN] = 1
    m = Labeller(ws, (rng.standard_normal(2 * HIDDEN + 1) / 5).astype(np.float32))
    state = [[np.zeros_like(a), np.zeros_like(a)] for a in (*m.w, m.out)]
    order = sorted(range(pages), key=lambda i: len(xs[i]))
    groups = [order[i : i + 24] for i in range(0, pages, 24)]
    step = 0
    for epoch in range(epochs):
        rnd.shuffle(groups)
        for g in groups:
            x, mask = _batch([xs[i] for i in g])
            y = np.zeros(mask.shape, np.float32)
            for r, i in enumerate(g):
                y[r, : len(labels[i])] = labels[i]
            _, grads = _train_step(m, x, mask, y)
            step += 1
            rate = 0.012 * (1 - epoch / epochs) + 0.001
            for a, grad, (m1, m2) in zip((*m.w, m.out), grads, state, strict=True):
                grad = np.clip(grad, -1, 1)
                m1 += 0.1 * (grad - m1)
                m2 += 0.001 * (grad * grad - m2)
                a -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    _trained[key] = m
    return m


def extract_pages(pages: list[str | None], m: Labeller) -> list[str]:
    parts = [blocks(p) for p in pages]
    xs = features(parts)
    out = [""] * len(pages)
    order = sorted(range(len(pages)), key=lambda i: len(xs[i]))
    i = 0
    while i < len(order):
        # Groups of like length; a very long page is a group of its own, so padding stays bounded.
        j = i + 1
        while j < len(order) and j - i < GROUP and (j - i + 1) * len(xs[order[j]]) <= 20_000:
            j += 1
        g = order[i:j]
        x, mask = _batch([xs[k] for k in g])
        p = m.run(x, mask)
        for r, k in enumerate(g):
            out[k] = " ".join(b[1] for b, q in zip(parts[k], p[r], strict=False) if q >= 0.5)
        i = j
    return out


def _extract(batches: Iterator[pa.RecordBatch], m: Labeller) -> Iterator[pa.RecordBatch]:
    for b in batches:
        html_col = b.column(1).to_pylist()
        for i in range(0, max(len(html_col), 1), 256):
            text = extract_pages(html_col[i : i + 256], m)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 256), pa.array(text, pa.string())], names=["row", "main_text"])


def extract(pages: DataFrame, *, html_col: str = "html", out_col: str = "main_text", labeller: Labeller | None = None) -> DataFrame:
    """pages without html_col, with the main text as out_col (in place of a column of that name)."""
    from pyspark.sql.types import StringType, StructField, StructType

    spark = pages.sparkSession
    V.ship(spark)
    kept = [c for c in pages.columns if c not in (html_col, out_col)]
    spare = "_" * (max(map(len, pages.columns), default=0) + 1)  # a struct has a field at least, and no name twice
    rows = pages.select(F.struct(F.lit(0).alias(spare), *[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{html_col}`").alias("html"))
    shared = spark.sparkContext.broadcast(labeller or train())
    schema = StructType([rows.schema["row"], StructField("main_text", StringType())])
    got = rows.mapInArrow(lambda it: _extract(it, shared.value), schema)
    return got.select(*[F.col(f"row.`{c}`") for c in kept], F.col("main_text").alias(out_col))
