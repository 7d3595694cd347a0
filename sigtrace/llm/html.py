"""Main text of web pages: a bidirectional LSTM labels every block of a page in the light of all its blocks."""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textops import map_arrow, texts

#: The labeller is fitted on at most so many pages, chosen by a hash of the id, and on as many made of their blocks.
FIT_PAGES = 300
#: Only while fitting, a page longer than this is cut into pages of so many blocks.
FIT_BLOCKS = 60
PATH_BUCKETS, PATH_WIDTH, WORD_BUCKETS, WORD_WIDTH, HIDDEN, EPOCHS, STEPS, SEED = 1024, 12, 2048, 6, 16, 5, 150, 3

#: Of the names around a block the nearest so many tell what it is.
PATH_NAMES = 64

#: Elements that begin and end blocks; elements without content; elements whose content is no text of the page.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
                  "form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section select summary "
                  "table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TEXT = frozenset("script style template textarea title svg head".split())
#: An opening tag on the left ends an open element on the right.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Words of elements and classes by which pages commonly tell what a part is; they label what the network learns from.
MAIN_WORDS = "article main content post entry story text body".split()
OTHER_WORDS = ("nav menu header footer aside sidebar notice cookie consent banner ad ads advert advertisement promo sponsored newsletter subscribe "
               "gdpr cookies privacy disclaimer form login search comment comments reply related share social breadcrumb pagination popup modal widget").split()

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>|<[!?][^<>]*>?|[^<]+|<""", re.S)
_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>?|<[!?][^<>]*>?|[^<]+|<", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A run of text between block tags: the nearest names on its way from the root, each once, its own tag, its text, its letters in links."""

    path: tuple[str, ...]
    tag: str
    text: str
    linked: int


def blocks(page: str | None) -> list[Block]:
    """Blocks of a page in order; markup, comments and hidden elements gone, references decoded, blanks made one.

    The page is walked once. A tag that nothing closes has no quotes to respect any more, nor have those
    after it; elements that are never ended are looked for once.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    count: Counter[str] = Counter()  # open elements by tag
    parts: list[str] = []
    state = {"links": 0, "linked": 0}

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            tag, path = stack[-1] if stack else ("", ())
            out.append(Block(path, tag, text, min(len(text), state["linked"])))
        parts.clear()
        state["links"] = state["linked"] = 0

    def pop() -> None:
        count[stack.pop()[0]] -= 1

    at, page, pattern, endless = 0, page or "", _TOKEN, set()
    while (m := pattern.match(page, at)) is not None:
        tag = m.group(2)
        if tag is None and m.end() == at + 1 and page[at] == "<" and _LOOSE.match(page, at).group(2):
            pattern = _LOOSE
            continue
        at = m.end()
        if tag is None:
            if page[m.start()] != "<" or at == m.start() + 1:
                text = m.group()
                text = entities.unescape(text) if "&" in text else text
                parts.append(text)
                if state["links"]:
                    state["linked"] += len(text)
            continue
        tag, closing = tag.lower(), bool(m.group(1))
        if tag in HIDDEN_TEXT:
            if not closing and not m.group(3).endswith("/"):
                end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\b[^<>]*>?", re.I).search(page, at)
                if not end:
                    endless.add(tag)
                stop = end.end() if end else len(page)
                if tag == "head" and not end:  # no end tag: the body begins it
                    body = None if "body" in endless else re.compile(r"<body\b", re.I).search(page, at)
                    if not body:
                        endless.add("body")
                    stop = body.start() if body else at
                at = stop
            if tag != "svg":
                flush()
        elif tag == "a":
            state["links"] = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            flush()
            if closing:
                while count[tag] and stack[-1][0] != tag:
                    pop()
                if count[tag]:
                    pop()
            elif tag not in VOID:
                if stack and stack[-1][0] == "p":  # a block ends an open paragraph
                    pop()
                for name in ENDS.get(tag, ()):
                    if stack and stack[-1][0] == name:
                        pop()
                names = " ".join(x for g in _NAMES.findall(m.group(3)) for x in g).lower() if m.group(3) else ""
                own = tuple(dict.fromkeys((tag, *("." + w for w in _WORD.findall(names)))))
                above = stack[-1][1] if stack else ()
                stack.append((tag, (*(n for n in above if n not in own), *own)[-PATH_NAMES:]))
                count[tag] += 1
    flush()
    return out


def weak_label(block: Block) -> float | None:
    """1 in the article, 0 in another part, None where the names don't tell; the innermost telling name decides."""
    for name in reversed(block.path):
        word = name.removeprefix(".")
        if word in OTHER_WORDS:
            return 0.0
        if word in MAIN_WORDS and (name[0] == "." or word in ("article", "main")):
            return 1.0
    return None


class Buckets(dict):
    """Hash buckets by word; a bounded memo, emptied when full."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.buckets
        return value


_paths, _words = Buckets(PATH_BUCKETS), Buckets(WORD_BUCKETS)


def features(page: list[Block]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
    """Per block: hashed names of its path, hashed words, and shape (length, share in links, place, is a heading)."""
    paths, own, shape = [], [], np.zeros((len(page), 4))
    for i, b in enumerate(page):
        paths.append([_paths[n] for n in (*dict.fromkeys(b.path), "^" + b.tag)])
        words = b.text.lower().split(" ")
        own.append(list(map(_words.__getitem__, words)))
        shape[i] = np.log1p(len(words)) / 5, b.linked / len(b.text), i / len(page), b.tag in ("h1", "h2", "h3")
    return paths, own, shape


def _mean_rows(table: np.ndarray, lists: list[list[int]]) -> np.ndarray:
    sizes = np.array([len(x) for x in lists])
    flat = np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum()))
    return np.add.reduceat(table[flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings, one LSTM forward and one backward over a page's blocks, and a logistic output."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        d = PATH_WIDTH + WORD_WIDTH + 4
        init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"path": rng.normal(0, 0.3, (PATH_BUCKETS, PATH_WIDTH)), "word": rng.normal(0, 0.1, (WORD_BUCKETS, WORD_WIDTH)),
                  "out": init(2 * HIDDEN, 1)[:, 0], "bias": np.zeros(1)}
        for way in "fb":
            self.p |= {way + "x": init(d, 4 * HIDDEN), way + "h": init(HIDDEN, 4 * HIDDEN), way + "c": np.zeros(4 * HIDDEN)}

    def inputs(self, page) -> np.ndarray:
        paths, words, shape = page
        return np.hstack([_mean_rows(self.p["path"], paths), _mean_rows(self.p["word"], words), shape])

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, trace: list | None) -> np.ndarray:
        steps, many, _ = x.shape
        h, c, out = np.zeros((many, HIDDEN)), np.zeros((many, HIDDEN)), np.zeros((steps, many, HIDDEN))
        given = x @ self.p[way + "x"] + self.p[way + "c"]
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = given[t] + h @ self.p[way + "h"]
            gates = _sigmoid(z[:, :3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            g = np.tanh(z[:, 3 * HIDDEN:])
            new = f * c + i * g
            tanh, m = np.tanh(new), mask[t][:, None]
            if trace is not None:
                trace.append((t, h, c, i, f, o, g, tanh))
            c, h = m * new + (1 - m) * c, m * o * tanh + (1 - m) * h
            out[t] = h
        return out

    def _pad(self, pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        x, mask = np.zeros((max(map(len, pages)), len(pages), pages[0].shape[1])), np.zeros((max(map(len, pages)), len(pages)))
        for k, p in enumerate(pages):
            x[:len(p), k], mask[:len(p), k] = p, 1
        return x, mask

    def label(self, pages: list) -> list[np.ndarray]:
        """The probability of being main text, of each block of each page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k][0]), key=lambda k: len(pages[k][0]))
        for at in range(0, len(order), 128):
            group = order[at:at + 128]
            x, mask = self._pad([self.inputs(pages[k]) for k in group])
            h = np.concatenate([self._run(way, x, mask, None) for way in "fb"], axis=2)
            p = _sigmoid(h @ self.p["out"] + self.p["bias"])
            for j, k in enumerate(group):
                out[k] = p[:len(pages[k][0]), j]
        return out

    def gradients(self, pages: list, labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients by back-propagation through time; blocks labelled NaN don't count."""
        x, mask = self._pad([self.inputs(p) for p in pages])
        y, use = np.zeros(mask.shape), np.zeros(mask.shape)
        for k, own in enumerate(labels):
            y[:len(own), k], use[:len(own), k] = np.nan_to_num(own), ~np.isnan(own)
        traces: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self._run(way, x, mask, traces[way]) for way in "fb"], axis=2)
        p = _sigmoid(h @ self.p["out"] + self.p["bias"])
        total = max(use.sum(), 1)
        loss = -(use * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / total
        d = use * (p - y) / total
        g = {"out": np.einsum("tb,tbh->h", d, h), "bias": d.sum(keepdims=True)[0]}
        dx = np.zeros_like(x)
        for w, way in enumerate("fb"):
            dh_all = d[:, :, None] * self.p["out"][w * HIDDEN:(w + 1) * HIDDEN]
            gx, gh, gc = (np.zeros_like(self.p[way + s]) for s in "xhc")
            dh, dc = np.zeros(h.shape[1:2] + (HIDDEN,)), np.zeros(h.shape[1:2] + (HIDDEN,))
            for t, h0, c0, i, f, o, gg, tanh in reversed(traces[way]):
                m = mask[t][:, None]
                dh = dh + dh_all[t]
                do = m * dh * tanh
                dn = m * (dh * o * (1 - tanh ** 2) + dc)
                dz = np.hstack([dn * gg * i * (1 - i), dn * c0 * f * (1 - f), do * o * (1 - o), dn * i * (1 - gg ** 2)])
                gx += x[t].T @ dz
                gh += h0.T @ dz
                gc += dz.sum(0)
                dx[t] += dz @ self.p[way + "x"].T
                dh = (1 - m) * dh + dz @ self.p[way + "h"].T
                dc = (1 - m) * dc + dn * f
            g |= {way + "x": gx, way + "h": gh, way + "c": gc}
        g |= {"path": np.zeros_like(self.p["path"]), "word": np.zeros_like(self.p["word"])}
        for k, (paths, words, _) in enumerate(pages):
            for name, lists, a, b in (("path", paths, 0, PATH_WIDTH), ("word", words, PATH_WIDTH, PATH_WIDTH + WORD_WIDTH)):
                sizes = np.array([len(v) for v in lists])
                np.add.at(g[name], np.concatenate([np.asarray(v) for v in lists]), np.repeat(dx[:len(lists), k, a:b] / sizes[:, None], sizes, axis=0))
        return float(loss), g


def _renamed(page: list[Block], labels: list[float | None], rng: np.random.Generator) -> tuple[list[Block], list[float | None]]:
    """The page as another site might mark it up: other names for its parts, and parts put in between."""
    swap = {"article": ("div", "." + str(rng.choice(MAIN_WORDS))) if rng.random() < 0.6 else ("article",)}
    for word in ("nav", "footer", "header", "aside"):
        swap[word] = ("div", "." + word) if rng.random() < 0.3 else ("section", "." + word) if rng.random() < 0.3 else (word,)
    out = [Block(tuple(x for n in b.path for x in swap.get(n, (n,))), b.tag, b.text, b.linked) for b in page]
    labels = list(labels)
    words = [w for b in page for w in b.text.split(" ")] or ["text"]
    for _ in range(int(rng.integers(1, 5))):
        word, at = str(rng.choice(OTHER_WORDS)), int(rng.integers(0, len(out) + 1))
        around = next((b.path for b, y in zip(out[at:], labels[at:], strict=True) if y == 1.0), ()) if rng.random() < 0.5 else ("html", "body")
        tag = word if word in ("nav", "header", "footer", "aside", "form", "menu") and rng.random() < 0.6 else None
        names = (tag,) if tag else (str(rng.choice(["div", "section", "ul"])), "." + word)
        if around and around[-1] == "p":
            around = around[:-1]
        for _ in range(int(rng.integers(1, 6))):
            leaf = str(rng.choice(["p", "p", "li", "div", "h3", "label", "button"]))
            size, start = int(rng.integers(1, 80 if leaf == "p" else 8)), int(rng.integers(0, len(words)))
            text = " ".join(words[start:start + size]) or "text"
            out.insert(at, Block((*around, *names, leaf), leaf, text, len(text) if leaf == "li" and rng.random() < 0.6 else 0))
            labels.insert(at, 0.0)
    return out, labels


#: A page to learn from where no page of the input tells its parts.
_PLAIN = ("<html><body><header><p>Site name</p></header><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>About us</a></li></ul></nav><article><h1>A headline"
          "</h1><p>The first paragraph says in a few sentences what the page is about. It goes on for a while.</p><p>The second one is shorter.</p></article>"
          "<footer><p>All rights reserved.</p></footer></body></html>")


def fit(pages: list[str], seed: int = SEED) -> Labeller:
    """Adam over pages labelled by the names of their parts, half of them marked up anew."""
    rng, examples = np.random.default_rng(seed), []
    for page in [*pages, *[_PLAIN] * 20]:
        own = blocks(page)
        labels = [weak_label(b) for b in own]
        for variant in ((own, labels), _renamed(own, labels, rng), _renamed(own, labels, rng)):
            for at in range(0, len(variant[0]), FIT_BLOCKS):
                part = variant[0][at:at + FIT_BLOCKS]
                examples.append((features(part), np.array([np.nan if y is None else y for y in variant[1][at:at + FIT_BLOCKS]], float)))
    model = Labeller(seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    step = 0
    for _ in range(max(EPOCHS, -(-STEPS // -(-len(examples) // 32)))):
        order = rng.permutation(len(examples))
        for at in range(0, len(order), 32):
            group = sorted(order[at:at + 32].tolist())
            _, grads = model.gradients([examples[k][0] for k in group], [examples[k][1] for k in group])
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.p[k] -= 0.02 * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
    model.p = {k: v.astype(np.float32) for k, v in model.p.items()}
    return model


def train(df: DataFrame, html_col: str = "html", id_col: str = "page_id", pages: int = FIT_PAGES) -> Labeller:
    """Fit on at most ``pages`` rows, chosen by a hash of the id."""
    able = df.where(F.col(html_col).isNotNull())
    mark = F.pmod(F.xxhash64(F.lit(SEED), F.col(id_col).cast("string")), F.lit(1 << 40))
    many = able.count()
    some = able.where(mark < F.lit(int((1 << 40) * min(1.0, 1.5 * pages / max(1, many))))) if many > pages else able
    return fit([r["html"] for r in some.select(mark.alias("mark"), F.col(html_col).alias("html")).orderBy("mark", "html").limit(pages).collect()])


def extract(own: list[str | None], model: Labeller) -> list[tuple[str, int, int]]:
    """(main text, blocks kept, blocks) of pages."""
    parsed = [blocks(page) for page in own]
    found = model.label([features(p) for p in parsed])
    out = []
    for page, p in zip(parsed, found, strict=True):
        kept = [b.text for b, x in zip(page, p.tolist(), strict=True) if x >= 0.5]
        out.append(("\n".join(kept), len(kept), len(page)))
    return out


def main_text(df: DataFrame, model: Labeller, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, url, text, n_chars, n_kept, n_blocks) per row: blocks labelled as main text, joined by line feeds.

    A null or empty page, or one without text, gives the empty text. Null ids
    and urls stay null; repeated rows are read one by one; an empty table gives
    no rows; other columns are not read. Whole pages are labelled, however long.
    """
    def work(batch):
        at = batch.schema.get_field_index
        own = texts(batch, html_col)
        rows = [r for k in range(0, len(own), 512) for r in extract(own[k:k + 512], model)]
        text, kept, many = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [batch.column(at(id_col)), batch.column(at(url_col)), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64()),
             pa.array(kept, pa.int64()), pa.array(many, pa.int64())], names=[id_col, url_col, "text", "n_chars", "n_kept", "n_blocks"])

    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return map_arrow(df.select(id_col, url_col, html_col), work,
                     f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long, n_kept long, n_blocks long")
