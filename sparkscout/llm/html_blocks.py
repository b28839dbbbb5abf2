"""Main-text extraction with a recurrent block labeller (operator 1).

A page is cut into leaf blocks: text between block-level tags, with the path
of open elements (tag names, words of class, id and role) above it.  Each
block becomes a vector of its hashed path, its hashed words and a few sizes.
A bidirectional LSTM in numpy reads the blocks of the whole page in order and
labels every block main text or not, so each label depends on the whole
document.

The labeller is trained here, on generated pages: random layouts around an
article, with menus, headers, sidebars, notices, adverts, forms, comments and
footers under the names such parts usually have, or under meaningless names.
Training takes no row of the table and gives the same weights every time.

Defined cases: null or empty html has an empty text; what follows an unclosed
script, style or comment is part of it; unclosed elements end with the page; a
cut-off tag at the end is dropped; ``<br>`` is white space inside its block.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map

# Fixed values of HTML: elements inside a line of text, without content, without
# readable text, and what an opening tag closes.
INLINE = set("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp
small span strike strong sub sup time tt u var wbr br""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("""script style template noscript title svg math iframe canvas object audio video select
textarea button datalist map head""".split())
RAW = set("script style title textarea iframe xmp noembed noframes".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_NAME = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])")


def _names(tag: str, attrs: str) -> tuple[str, ...]:
    out = [tag]
    if attrs:
        for m in _NAME.finditer(attrs):
            out += ["." + x.lower() for x in _PART.findall(m[2] or m[3] or m[4] or "")]
    return tuple(out)


def blocks(html: str | None) -> list[tuple[tuple[tuple[str, ...], ...], str, int]]:
    """(path, text, characters in links) of each leaf block with text."""
    html = html or ""
    out, stack, buf = [], [], []
    silent = links = linked = 0
    at, n = 0, len(html)

    def flush():
        nonlocal linked
        if buf:
            text = " ".join("".join(buf).split())
            if text:
                out.append((tuple(x[1] for x in stack), text, linked))
            buf.clear()
        linked = 0

    def pop(k: int):
        nonlocal silent
        for tag, _ in stack[k:]:
            silent -= tag in SILENT
        del stack[k:]

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not silent:
            piece = html[at:lt]
            if "&" in piece:
                piece = unescape(piece)
            buf.append(piece)
            if links:
                linked += len(piece)
        if lt == n:
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(html, lt)
        if m is None:
            nxt = html[lt + 1:lt + 2]
            if nxt.isalpha() or nxt == "/":                       # a tag that does not end
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                if not silent:
                    buf.append("<")
                at = lt + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE:
                continue
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
            continue
        if tag in INLINE:
            if tag == "br":
                buf.append(" ")
            elif tag == "a":
                links += 1
            continue
        flush()
        links = 0
        if tag in VOID:
            continue
        if stack and stack[-1][0] == "p":
            pop(len(stack) - 1)
        shut = CLOSES.get(tag, ())
        while stack and stack[-1][0] in shut:
            pop(len(stack) - 1)
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(html, at)
            at = n if end is None else html.find(">", end.start()) + 1 or n
            continue
        if m[3].endswith("/") and tag in SILENT:
            continue
        silent += tag in SILENT
        stack.append((tag, _names(tag, m[3])))
    flush()
    return out


# Usual names of page parts and words that stand in them.
ARTICLE_NAMES = """article main content post entry story body text page document blog news maincontent
articlebody entrycontent postcontent""".split()
PARTS = {
    "nav": "nav menu navigation navbar topnav mainmenu breadcrumb breadcrumbs pagination toc tabs skip".split(),
    "header": "header masthead banner topbar logo branding site siteheader toolbar".split(),
    "footer": "footer bottom copyright legal colophon sitefooter credits imprint".split(),
    "aside": "sidebar aside widget related recommended popular trending links tags archive more teaser promo".split(),
    "ad": "ad ads advert advertisement sponsor sponsored banner adsense promo promotion".split(),
    "notice": "cookie consent notice alert popup modal gdpr banner overlay warning disclaimer message".split(),
    "form": "form search login signup subscribe newsletter contact register".split(),
    "comment": "comment comments reply replies discussion respond commentlist disqus reader".split(),
    "social": "share social sharing follow author byline meta date rating".split(),
}
PART_TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"],
             "aside": ["aside", "div", "section"], "ad": ["div", "aside", "ins", "section"],
             "notice": ["div", "section", "aside"], "form": ["form", "div"],
             "comment": ["section", "div", "ol"], "social": ["div", "ul"]}
PART_WORDS = """home about contact login register search menu share tweet subscribe newsletter cookies accept
privacy policy terms copyright rights reserved advertisement sponsored read more next previous comments reply
follow related posts categories tags archive sitemap help faq ©""".split()
_SYLLABLES = "an be con der el en er est fi ga ho in ing ka la le lo ma men mo na ne on or pa re ri sa st ta te th ti ver wo".split()

KINDS = [*PARTS, "article"]
_KINDS_OF: dict[str, list[int]] = {}
for _k, _kind in enumerate(KINDS):
    for _x in PARTS.get(_kind, ARTICLE_NAMES):
        _KINDS_OF.setdefault(_x, []).append(_k)

HASHED, WORDS, SIZES = 128, 32, 6
PATH = HASHED + 2 * len(KINDS)
INPUT = PATH + WORDS + SIZES


@lru_cache(1 << 16)
def _path_vector(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    """Signed hashes of all names on the path (the last element's count again),
    and which kinds of page part they usually name, anywhere and last."""
    v = np.zeros(PATH, np.float32)
    last = len(path) - 1
    for depth, names in enumerate(path):
        for x in names:
            for key in (x, "^" + x) if depth == last else (x,):
                h = crc32(key.encode())
                v[h % HASHED] += 1.0 if h >> 16 & 1 else -1.0
            for k in _KINDS_OF.get(x.lstrip("."), ()):
                v[HASHED + k] = 1.0
                if depth == last:
                    v[HASHED + len(KINDS) + k] = 1.0
    return v


class _Words(dict):
    """Bucket of a word, hashed once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        k = self[word] = crc32(word.lower().encode()) % WORDS
        return k


_WORDS = _Words()


def page_matrix(page: list) -> np.ndarray:
    """One input row per block."""
    x = np.zeros((len(page), INPUT), np.float32)
    n = len(page)
    for k, (path, text, linked) in enumerate(page):
        words = text.split(" ")
        x[k, :PATH] = _path_vector(path)
        counts = np.bincount(np.fromiter(map(_WORDS.__getitem__, words), np.int64, len(words)), minlength=WORDS)
        x[k, PATH:PATH + WORDS] = counts / len(words)
        x[k, PATH + WORDS:] = (np.log1p(len(words)) / 4, min(1.0, linked / len(text)), k / n,
                               text[-1] in ".!?…", np.log1p(n) / 4, len(path) / 10)
    return x


class BiLstm:
    """Two LSTM layers side by side, one per direction, and a logistic unit
    over both states and the block's own vector."""

    def __init__(self, size: int = 24, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size = size
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w[d + "x"] = rng.normal(0, 1 / np.sqrt(INPUT), (INPUT, 4 * size)).astype(np.float32)
            self.w[d + "h"] = rng.normal(0, 1 / np.sqrt(size), (size, 4 * size)).astype(np.float32)
            bias = np.zeros(4 * size, np.float32)
            bias[size:2 * size] = 1.0                             # forget gates start open
            self.w[d + "b"] = bias
        self.w["o"] = rng.normal(0, 0.2, (2 * size, 1)).astype(np.float32)
        self.w["ob"] = np.zeros(1, np.float32)
        self.w["ox"] = np.zeros((INPUT, 1), np.float32)           # the block's own vector, beside the context

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """Hidden states over time; x is [time, page, input]."""
        t, n, _ = x.shape
        s = self.size
        z_in = x.reshape(t * n, -1) @ self.w[d + "x"] + self.w[d + "b"]
        z_in = z_in.reshape(t, n, 4 * s)
        h, c = np.zeros((n, s), np.float32), np.zeros((n, s), np.float32)
        hs, tape = np.zeros((t, n, s), np.float32), []
        for k in (range(t) if d == "f" else range(t - 1, -1, -1)):
            z = z_in[k] + h @ self.w[d + "h"]
            gates = 1 / (1 + np.exp(-np.clip(z[:, :3 * s], -30, 30)))
            i, f, o = gates[:, :s], gates[:, s:2 * s], gates[:, 2 * s:]
            g = np.tanh(z[:, 3 * s:])
            m = mask[k][:, None]
            c_new = (f * c + i * g) * m
            th = np.tanh(c_new)
            h_new = o * th * m
            if keep:
                tape.append((k, i, f, o, g, th, c, h, m))
            h, c = h_new, c_new
            hs[k] = h
        return hs, tape

    def _back(self, d: str, x: np.ndarray, dhs: np.ndarray, tape: list, grads: dict) -> None:
        s = self.size
        n = x.shape[1]
        dh_next, dc_next = np.zeros((n, s), np.float32), np.zeros((n, s), np.float32)
        dz_all = np.zeros((x.shape[0], n, 4 * s), np.float32)
        for k, i, f, o, g, th, c, h, m in reversed(tape):
            dh = (dhs[k] + dh_next) * m
            dc = dh * o * (1 - th * th) + dc_next * m
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * th * o * (1 - o),
                                 dc * i * (1 - g * g)], axis=1)
            dz_all[k] = dz
            grads[d + "h"] += h.T @ dz
            dh_next, dc_next = dz @ self.w[d + "h"].T, dc * f
        flat = dz_all.reshape(-1, 4 * s)
        grads[d + "x"] += x.reshape(-1, x.shape[2]).T @ flat
        grads[d + "b"] += flat.sum(axis=0)

    @staticmethod
    def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        t = max(map(len, pages))
        x = np.zeros((t, len(pages), INPUT), np.float32)
        mask = np.zeros((t, len(pages)), np.float32)
        for j, p in enumerate(pages):
            x[:len(p), j] = p
            mask[:len(p), j] = 1.0
        return x, mask

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run("f", x, mask, False)[0], self._run("b", x, mask, False)[0]], axis=2)
        return (both @ self.w["o"] + x @ self.w["ox"] + self.w["ob"])[:, :, 0]

    def step(self, pages: list[np.ndarray], labels: list[np.ndarray], state: dict, rate: float) -> float:
        """One Adam step on the mean logistic loss of all blocks."""
        x, mask = self.pad(pages)
        y = np.zeros(mask.shape, np.float32)
        for j, v in enumerate(labels):
            y[:len(v), j] = v
        fs, ft = self._run("f", x, mask, True)
        bs, bt = self._run("b", x, mask, True)
        both = np.concatenate([fs, bs], axis=2)
        z = (both @ self.w["o"] + x @ self.w["ox"] + self.w["ob"])[:, :, 0]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        dz = ((p - y) * mask / mask.sum())[:, :, None]
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        grads["o"] += both.reshape(-1, both.shape[2]).T @ dz.reshape(-1, 1)
        grads["ob"] += dz.sum()
        grads["ox"] += x.reshape(-1, INPUT).T @ dz.reshape(-1, 1)
        dboth = dz @ self.w["o"].T
        self._back("f", x, dboth[:, :, :self.size], ft, grads)
        self._back("b", x, dboth[:, :, self.size:], bt, grads)
        state["t"] = state.get("t", 0) + 1
        for k, g in grads.items():
            m = state[k, "m"] = 0.9 * state.get((k, "m"), 0.0) + 0.1 * g
            v = state[k, "v"] = 0.999 * state.get((k, "v"), 0.0) + 0.001 * g * g
            self.w[k] -= (rate * (m / (1 - 0.9 ** state["t"]))
                          / (np.sqrt(v / (1 - 0.999 ** state["t"])) + 1e-8)).astype(np.float32)
        right = ((p > 0.5) == (y > 0.5)) * mask
        return float(right.sum() / mask.sum())

    def label(self, pages: list[np.ndarray], most: int = 60_000) -> list[np.ndarray]:
        """Main text or not, for the blocks of many pages.  Pages of similar
        length run together, at most ``most`` padded blocks at a time."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k, p in enumerate(pages) if len(p)), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and stop - at < 128 and (stop - at + 1) * len(pages[order[stop]]) <= most:
                stop += 1
            own = order[at:stop]
            z = self.logits(*self.pad([pages[k] for k in own]))
            for j, k in enumerate(own):
                out[k] = z[:len(pages[k]), j] > 0
            at = stop
        return out


def _sentence(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    text = " ".join(words).capitalize()
    return text + rng.choice([".", ".", ".", "!", "?", ""])


def generated_page(rng: random.Random) -> tuple[list, list[int]]:
    """Blocks and labels of one random layout."""
    out, labels = [], []
    opaque = rng.random() < 0.15                                # names that say nothing
    shell = [("html",), ("body",)]
    if rng.random() < 0.4:
        shell.append(("div", "." + rng.choice(["wrapper", "container", "page", "wrap", "root", "site", "layout"])))

    def names(tag: str, options: list[str]) -> tuple[str, ...]:
        if opaque or rng.random() < 0.1:
            return (tag, "." + rng.choice("abcdefgh") * 2) if rng.random() < 0.5 else (tag,)
        return (tag, *("." + x for x in rng.sample(options, rng.choice([1, 1, 2]))))

    def add(path, text, main, linked=0):
        out.append((tuple(path), text, min(linked, len(text))))
        labels.append(main)

    def part(kind: str, above: list) -> None:
        tag = rng.choice(PART_TAGS[kind])
        semantic = tag not in ("div", "ul", "section", "ol")
        box = (tag,) if semantic and rng.random() < 0.6 else names(tag, PARTS[kind])
        path = [*above, box]
        if rng.random() < 0.25:
            path.append(("div", "." + rng.choice(["inner", "container", "wrap", "box", "content", "row", "col"])))
        for _ in range(rng.choice([1, 1, 1, 2, 3, 6, 8]) if kind not in ("nav", "comment") else rng.randint(1, 9)):
            if kind == "comment":
                text = _sentence(rng, rng.randint(1, 60))
            elif rng.random() < 0.4:
                text = " ".join(rng.choice(PART_WORDS) for _ in range(rng.randint(1, 5))).capitalize()
            else:
                text = _sentence(rng, rng.choice([1, 1, 2, 4, 9, 18, 35]))
            leaf = {"nav": [("ul",), ("li",)], "comment": [rng.choice([("p",), ("li",), ("div", ".comment")])]}.get(
                kind, [rng.choice([("p",), ("p",), ("li",), ("div",), ("h3",), ("label",)])])
            if path[-1][0] == "ul" and leaf[0] == ("ul",):
                leaf = leaf[1:]
            direct = kind not in ("nav", "comment") and rng.random() < 0.45
            add(path if direct else [*path, *leaf], text, 0,
                len(text) if kind in ("nav", "social") or rng.random() < 0.25 else 0)

    for kind in rng.sample(["header", "nav", "ad", "notice", "nav", "form", "social"], rng.randint(0, 5)):
        part(kind, shell)
    box = [*shell]
    if rng.random() < 0.3:
        box.append(("main",))
    style = rng.random()
    bare = not opaque and rng.random() < 0.06                   # paragraphs right below the body
    if bare:
        pass
    elif style < 0.55 or (opaque and style < 0.8):
        box.append(("article",) if rng.random() < 0.6 else names("article", ARTICLE_NAMES))
    else:
        box.append(names(rng.choice(["div", "div", "section"]), ARTICLE_NAMES))
    if not bare and rng.random() < 0.25:
        box.append(names("div", ARTICLE_NAMES))
    inner_header = rng.random() < 0.15
    if rng.random() < 0.85:
        add([*box, *([("header",)] if inner_header else []), (rng.choice(["h1", "h1", "h2"]),)],
            _sentence(rng, rng.randint(1, 12)), 1)
    if rng.random() < 0.2:
        part("social", box)
    for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 14, 25])):
        leaf = rng.choice([("p",)] * 12 + [("h2",), ("h3",), ("blockquote",), ("pre",), ("div",)])
        path = [*box, leaf]
        if rng.random() < 0.06:
            path = [*box, (rng.choice(["ul", "ol"]),), ("li",)]
        elif rng.random() < 0.04:
            path = [*box, ("table",), ("tr",), ("td",)]
        elif rng.random() < 0.04:
            path = [*box, ("figure",), ("figcaption",)]
        text = _sentence(rng, rng.choice([1, 1, 2, 4, 9, 20, 45, 90]))
        add(path, text, 1, len(text) // 3 if rng.random() < 0.1 else 0)
        if rng.random() < 0.08:
            part(rng.choice(["ad", "ad", "aside", "social", "form", "notice"]), box)
    if rng.random() < 0.2:
        part(rng.choice(["comment", "social", "aside", "ad"]), box)
    for kind in rng.sample(["comment", "aside", "ad", "nav", "form", "footer", "notice", "social"], rng.randint(0, 4)):
        part(kind, shell)
    if rng.random() < 0.7:
        part("footer", shell)
    return out, labels


@lru_cache(2)
def trained(pages: int = 4000, epochs: int = 12, batch: int = 32, seed: int = 11) -> BiLstm:
    """The labeller, trained on ``pages`` generated pages (same weights for
    the same arguments)."""
    rng = random.Random(seed)
    made = [generated_page(rng) for _ in range(pages)]
    data = [(page_matrix(b), np.asarray(y, np.float32)) for b, y in made]
    model, state, rate = BiLstm(), {}, 0.012
    for epoch in range(epochs):
        order = sorted(range(len(data)), key=lambda k: (len(data[k][0]) // 8, rng.random()))
        groups = [order[k:k + batch] for k in range(0, len(order), batch)]
        rng.shuffle(groups)
        for g in groups:
            model.step([data[k][0] for k in g], [data[k][1] for k in g], state,
                       rate * (1 - epoch / epochs))
    return model


def main_text(pages: list[str | None], model: BiLstm) -> list[str]:
    """Main text of each page, blocks joined by a line feed."""
    cut = [blocks(h) for h in pages]
    keep = model.label([page_matrix(b) for b in cut])
    return ["\n".join(x[1] for x, k in zip(b, own) if k) for b, own in zip(cut, keep)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            chunk: int = 512) -> DataFrame:
    """(id_col, url_col, text, n_chars) of every page.  The weights (about
    80 KB) travel with the tasks."""
    model = trained()
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, chunk):
                b = whole.slice(at, chunk)
                text = main_text(b.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(text, pa.string()),
                     pa.array(list(map(len, text)), pa.int64())], [id_col, url_col, "text", "n_chars"])

    return arrow_map(pages.select(id_col, url_col, F.col(html_col).cast("string")), run,
                     f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars bigint")
