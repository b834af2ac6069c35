"""Main-text extraction by a recurrent block labeller.

A page is a sequence of leaf blocks.  Each block is a vector: its hashed tag
path (tags and pieces of class, id and role names), its hashed words and a
few shape figures.  A bidirectional LSTM in numpy reads the whole sequence,
so every block is judged with the page around it, and labels each block main
text or not.

The model is fitted here.  Pages carry no labels, so a bounded sample of
them (``SAMPLE_PAGES``) is labelled by its own semantic elements, and the
blocks of the sample are also set into made-up layouts with known labels:
other content containers, menus, headers, sidebars, notices, adverts, forms
and reader comments, before, after and inside the article.  The sample and
all random choices are fixed by hashes and seeds.  Labelling is one
projection over all pages; pages are never shortened.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreg.llm.common import as_row, text_or_empty, write_table
from sparkreg.llm.html_blocks import Block, blocks

SAMPLE_PAGES = 240
MADE_UP = 900
PATH_DIM, WORD_DIM, SHAPE_DIM, HIDDEN = 192, 24, 5, 16
EPOCHS, BATCH = 9, 48
#: Longer training pages are cut into windows of about equal size, at most this long.
TRAIN_BLOCKS = 256
#: Blocks of a padded batch when labelling.
BATCH_BLOCKS = 20_000
#: Longer pages are scored in parts of so many blocks.
LONG_PART = 4_096
#: Elements and names that mark parts of the sample pages that are not main text.
ASIDE = frozenset("nav footer aside form header menu .ad .ads .advert .sidebar .comments .comment .cookie .notice "
                  ".menu .nav .footer .header".split())
INSIDE = frozenset("article main".split())
YES, NO = "\ue000", "\ue001"

CONTENT = [("<article>", "</article>"), ('<main><article class="post">', "</article></main>"), ("<main>", "</main>"),
           ('<div class="content">', "</div>"), ('<div id="main-content"><div class="entry-content">', "</div></div>"),
           ('<section class="article-body">', "</section>"), ('<div class="post-body">', "</div>"),
           ('<div role="main"><div class="story">', "</div></div>"), ("<div>", "</div>"), ("", ""),
           ('<table><tr><td class="text">', "</td></tr></table>"), ('<div class="page"><article id="post-12">',
                                                                    "</article></div>")]
MENUS = ['<nav><ul>{li}</ul></nav>', '<div class="menu"><ul>{li}</ul></div>', '<ul class="breadcrumb">{li}</ul>',
         '<div id="navbar">{a}</div>', '<header class="site-header"><a>{n}</a><nav>{a}</nav></header>',
         '<div class="header"><span>{n}</span></div>', '<header><p>{n}</p></header>', '<nav role="navigation">{a}</nav>']
FEET = ['<footer>{n}</footer>', '<footer><p>{n}</p><ul>{li}</ul></footer>', '<div class="footer">{n}</div>',
        '<div id="footer"><p>{n}</p></div>', '<div class="copyright">{n}</div>']
SIDES = ['<aside><p>{p}</p></aside>', '<div class="sidebar"><h3>{n}</h3><p>{p}</p><ul>{li}</ul></div>',
         '<aside class="related"><ul>{li}</ul></aside>', '<div class="related-posts"><h4>{n}</h4><ul>{li}</ul></div>',
         '<div id="sidebar"><p>{p}</p></div>', '<div class="widget"><p>{n}</p></div>', '<div class="share">{a}</div>']
ADS = ['<div class="ad">{p}</div>', '<div class="advert"><p>{p}</p></div>', '<div class="ads-banner">{n}</div>',
       '<div class="sponsored"><p>{p}</p></div>', '<div class="promo">{n}</div>', '<aside class="ad"><p>{p}</p></aside>',
       '<div id="advertisement"><p>{p}</p></div>']
NOTICES = ['<div class="cookie-notice"><p>{p}</p></div>', '<div id="cookie-banner">{n}</div>',
           '<div class="notice">{p}</div>', '<div class="alert"><p>{n}</p></div>', '<div role="alert">{n}</div>',
           '<div class="consent-popup"><p>{p}</p></div>', '<div class="gdpr">{n}</div>', '<div role="dialog">{p}</div>']
FORMS = ['<form><label>{n}</label><input name="q"></form>', '<div class="newsletter"><form><p>{p}</p></form></div>',
         '<form class="search"><p>{n}</p></form>', '<div class="subscribe"><p>{n}</p></div>',
         '<form id="login"><p>{n}</p><label>{n}</label></form>']
COMMENTS = ['<div class="comments"><div class="comment"><b>{n}</b><p>{p}</p></div><div class="comment"><p>{p}</p></div>'
            '</div>', '<section id="comments"><h3>{n}</h3><ol><li><p>{p}</p></li><li><p>{p}</p></li></ol></section>',
            '<ul class="comment-list"><li class="comment">{p}</li><li class="comment">{p}</li></ul>',
            '<div id="disqus_thread"><p>{p}</p></div>', '<div class="reader-comments"><p>{p}</p><p>{p}</p></div>',
            '<div class="responses"><div class="reply"><p>{p}</p></div></div>']


def made_up_page(rng: np.random.Generator, main: list[str], rest: list[str]) -> str:
    """A page in a made-up layout; every text starts with its label."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    short = lambda: NO + pick(rest)
    prose = lambda: NO + (pick(main) if rng.random() < 0.7 else pick(rest))

    def fill(t: str) -> str:
        while "{" in t:
            many = range(int(rng.integers(2, 7)))
            for mark, make in (("{li}", lambda: "".join(f'<li><a href="/x">{short()}</a></li>' for _ in many)),
                               ("{a}", lambda: "<br>".join(f'<a href="/x">{short()}</a>' for _ in many)),
                               ("{n}", short), ("{p}", prose)):
                if mark in t:
                    t = t.replace(mark, make(), 1)
        return t

    def some(groups, p) -> str:
        return "".join(fill(pick(g)) for g in groups if rng.random() < p)

    open_, close = pick(CONTENT)
    body = [f"<h1>{YES}{pick(rest)}</h1>"] if rng.random() < 0.8 else []
    if body and rng.random() < 0.2:
        body = ["<header>" + body[0] + "</header>"] if "article" in open_ else body
    for _ in range(int(rng.integers(1, 12))):
        t = YES + pick(main)
        shape = rng.random()
        body.append(f"<p>{t}</p>" if shape < 0.7 else f"<p><b>{t}<br><p>" if shape < 0.76 else f"<p>{t}" if shape < 0.8
                    else f"<h2>{t}</h2>" if shape < 0.86 else f"<ul><li>{t}</li><li>{YES}{pick(rest)}</li></ul>"
                    if shape < 0.92 else f"<blockquote><p>{t}</p></blockquote>" if shape < 0.96 else f"<div>{t}</div>")
        if rng.random() < 0.08:
            body.append(fill(pick(pick([ADS, SIDES, NOTICES, FORMS]))))
    if rng.random() < 0.25:
        body.append(fill(pick(COMMENTS)))
    page = ("<body>" + some([NOTICES], 0.3) + some([MENUS], 0.9) + some([ADS, SIDES], 0.3) + open_ + "".join(body)
            + close + some([COMMENTS, SIDES, FORMS, ADS], 0.3) + some([FEET], 0.85) + some([NOTICES], 0.15) + "</body>")
    return page[:int(len(page) * rng.uniform(0.4, 1))] if rng.random() < 0.1 else page


def sample_labels(bs: list[Block]) -> np.ndarray | None:
    """Labels of a page by its semantic elements; None without any."""
    if not any(INSIDE & set(b.path) for b in bs):
        return None
    return np.array([bool(INSIDE & set(b.path)) and not ASIDE & set(b.path) for b in bs], dtype=np.float32)


_PATHS: dict[tuple, np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = _PATHS.get(path)
    if v is None:
        if len(_PATHS) > 20_000:
            _PATHS.clear()
        v = np.zeros(PATH_DIM, dtype=np.float32)
        for p in set(path) | {f"leaf {path[-1] if path else ''}"}:
            v[zlib.crc32(p.encode()) % PATH_DIM] = 1.0
        _PATHS[path] = v
    return v


def vectors(bs: list[Block], first: int = 0, total: int | None = None) -> np.ndarray:
    """(blocks, features) of a page, or of the part of a page of ``total``
    blocks that starts at its block ``first``."""
    x = np.zeros((len(bs), PATH_DIM + WORD_DIM + SHAPE_DIM), dtype=np.float32)
    for i, b in enumerate(bs):
        x[i, :PATH_DIM] = _path_vector(b.path)
        words = b.text.lower().encode("utf-8", "surrogatepass").split()
        counts = np.bincount([zlib.crc32(w) % WORD_DIM for w in words], minlength=WORD_DIM)
        x[i, PATH_DIM:PATH_DIM + WORD_DIM] = counts / (len(words) + 4.0)
        n = len(b.text)
        x[i, -SHAPE_DIM:] = (np.log1p(n) / 6, b.link_chars / n, b.text.count(". ") / (n / 40 + 1),
                             b.text[-1] in ".!?", (first + i) / (total or len(bs)))
    return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-z))


class Labeller:
    """Bidirectional LSTM with a logistic output on both states."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def fresh(cls, seed: int = 5) -> Labeller:
        rng, d = np.random.default_rng(seed), PATH_DIM + WORD_DIM + SHAPE_DIM
        p = {}
        for s in "fb":
            p["W" + s] = rng.normal(0, 0.08, (d, 4 * HIDDEN)).astype(np.float32)
            p["U" + s] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            p["c" + s] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)
        p["V"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        p["v0"] = np.zeros(1, dtype=np.float32)
        return cls(p)

    def _direction(self, x, mask, s, tape=False, start=None):
        """States (T, B, H) of one direction, with what the gradient needs if
        ``tape``, and the last state, which ``start`` may go on from."""
        t_n, b_n, _ = x.shape
        pre = x @ self.p["W" + s] + self.p["c" + s]
        h, c = start or (np.zeros((b_n, HIDDEN), np.float32), np.zeros((b_n, HIDDEN), np.float32))
        hs, kept = np.zeros((t_n, b_n, HIDDEN), np.float32), [None] * t_n
        for t in range(t_n) if s == "f" else range(t_n - 1, -1, -1):
            z = pre[t] + h @ self.p["U" + s]
            g = _sigmoid(z[:, :3 * HIDDEN])
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN:2 * HIDDEN], g[:, 2 * HIDDEN:]
            u = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            c_new = f * c + i * u
            th = np.tanh(c_new)
            if tape:
                kept[t] = (h, c, i, f, o, u, th, m)
            c = np.where(m, c_new, c)
            h = np.where(m, o * th, h)
            hs[t] = h
        return hs, kept, (h, c)

    def scores(self, x, mask, tape=False):
        f, kf, _ = self._direction(x, mask, "f", tape)
        b, kb, _ = self._direction(x, mask, "b", tape)
        both = np.concatenate([f, b], axis=2)
        return both @ self.p["V"] + self.p["v0"], (both, kf, kb)

    def gradients(self, x, mask, y):
        z, (both, kf, kb) = self.scores(x, mask, tape=True)
        prob = _sigmoid(z)
        w = np.where(mask, 1.0, 0.0).astype(np.float32)
        dz = (prob - y) * w / w.sum()
        g = {"V": np.einsum("tb,tbh->h", dz, both), "v0": np.array([dz.sum()], np.float32)}
        dboth = dz[:, :, None] * self.p["V"]
        for s, kept, dh_out in (("f", kf, dboth[:, :, :HIDDEN]), ("b", kb, dboth[:, :, HIDDEN:])):
            t_n = len(kept)
            dpre = np.zeros((t_n, x.shape[1], 4 * HIDDEN), np.float32)
            du = np.zeros_like(self.p["U" + s])
            dh, dc = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
            for t in range(t_n - 1, -1, -1) if s == "f" else range(t_n):
                h0, c0, i, f, o, u, th, m = kept[t]
                dh = dh + dh_out[t]
                dcn = (dc + dh * o * (1 - th * th)) * m
                d = np.concatenate([dcn * u * i * (1 - i), dcn * c0 * f * (1 - f), dh * m * th * o * (1 - o),
                                    dcn * i * (1 - u * u)], axis=1)
                dpre[t] = d
                du += h0.T @ d
                dh = np.where(m, d @ self.p["U" + s].T, dh)
                dc = np.where(m, dcn * f, dc)
            flat = dpre.reshape(-1, 4 * HIDDEN)
            g["W" + s], g["U" + s], g["c" + s] = x.reshape(len(flat), -1).T @ flat, du, flat.sum(axis=0)
        return g

    def fit(self, seqs: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.02) -> None:
        """Every block of every page is trained on, in windows of at most
        TRAIN_BLOCKS blocks."""
        seqs = sorted([w for x, y in seqs if len(x) for w in windows(x, y)], key=lambda s: len(s[0]))
        batches = [pad(seqs[i:i + BATCH]) for i in range(0, len(seqs), BATCH)]
        rng = np.random.default_rng(11)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step, total = 0, epochs * len(batches)
        for _ in range(epochs):
            for j in rng.permutation(len(batches)):
                step += 1
                for k, d in self.gradients(*batches[j]).items():
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.99 * v[k] + 0.01 * d * d
                    lr = rate * (1 - 0.95 * step / total)
                    self.p[k] = self.p[k] - lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)

    def score_long(self, page: list[Block]) -> np.ndarray:
        """The scores of one page, part by part: the states pass from a part
        to the next, so they are those of the whole page."""
        z = np.full(len(page), self.p["v0"][0], np.float32)
        starts = list(range(0, len(page), LONG_PART))
        for s, order, v in (("f", starts, self.p["V"][:HIDDEN]), ("b", starts[::-1], self.p["V"][HIDDEN:])):
            state = None
            for a in order:
                x = vectors(page[a:a + LONG_PART], a, len(page))[:, None, :]
                hs, _, state = self._direction(x, np.ones(x.shape[:2], bool), s, start=state)
                z[a:a + LONG_PART] += hs[:, 0] @ v
        return z

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """True per block of main text, for each page."""
        out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        while order and len(pages[order[-1]]) > LONG_PART:
            i = order.pop()
            out[i] = self.score_long(pages[i]) > 0
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and len(pages[order[end]]) * (end + 1 - at) <= BATCH_BLOCKS:
                end += 1
            some = [i for i in order[at:end] if pages[i]]
            if some:
                x, mask, _ = pad([(vectors(pages[i]), None) for i in some])
                z, _ = self.scores(x, mask)
                for j, i in enumerate(some):
                    out[i] = z[:len(pages[i]), j] > 0
            at = end
        return out

    def dumps(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, **self.p)
        return f.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Labeller:
        return cls(dict(np.load(io.BytesIO(data))))


def windows(x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    n = -(-len(x) // TRAIN_BLOCKS)
    return list(zip(np.array_split(x, n), np.array_split(y, n)))


def pad(seqs):
    t = max(len(x) for x, _ in seqs)
    x = np.zeros((t, len(seqs), seqs[0][0].shape[1]), np.float32)
    y, mask = np.zeros((t, len(seqs)), np.float32), np.zeros((t, len(seqs)), bool)
    for j, (a, b) in enumerate(seqs):
        x[:len(a), j], mask[:len(a), j] = a, True
        if b is not None:
            y[:len(a), j] = b
    return x, mask, y


def fit_labeller(pages: list[str]) -> Labeller:
    """A labeller fitted on the sampled pages and on made-up layouts of their
    blocks.  Without usable pages it is fitted on layouts of filler words."""
    parsed = [blocks(p) for p in pages]
    known = [(b, y) for b in parsed if (y := sample_labels(b)) is not None]
    main = [t.text for b, y in known for t, k in zip(b, y) if k] or ["Some words of a plain text, and more of them."]
    rest = [t.text for b, y in known for t, k in zip(b, y) if not k] or ["Home", "About us", "Read more"]
    seqs = [(vectors(b), y) for b, y in known]
    rng = np.random.default_rng(3)
    for _ in range(MADE_UP):
        bs = blocks(made_up_page(rng, main, rest))
        bs = [b for b in bs if b.text[0] in (YES, NO) and len(b.text) > 1]
        y = np.array([b.text[0] == YES for b in bs], dtype=np.float32)
        bs = [b._replace(text=b.text.replace(YES, "").replace(NO, "").strip() or "-") for b in bs]
        if bs:
            seqs.append((vectors(bs), y))
    model = Labeller.fresh()
    model.fit(seqs)
    return model


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
            sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """One row per input row: ``row`` (the input as a struct), text, n_chars
    (code points), n_blocks, n_main (blocks of main text).

    A null or empty page, or one without main text, gives the empty text.
    Rows that repeat an id are extracted each on their own, and so are rows
    with a null id, which only the sample leaves out.
    """
    spark = pages.sparkSession
    page = text_or_empty(F.col(f"`{html_col}`"))
    some = pages.select(F.col(f"`{id_col}`").alias("i")).where("i is not null").distinct() \
        .orderBy(F.md5(F.col("i").cast("string").cast("binary")), "i").limit(sample_pages)
    some = write_table(some, "html-sample")                     # at most sample_pages ids
    sample = pages.select(F.col(f"`{id_col}`").alias("i"), page.alias("h")).join(F.broadcast(some), "i") \
        .groupBy("i").agg(F.min("h").alias("h"))

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"i": [], "h": []})]).sort_values("i")
        yield pd.DataFrame({"m": [fit_labeller(rows["h"].tolist()).dumps()]})

    got = sample.repartition(1).mapInPandas(train, "m binary").collect()
    model = spark.sparkContext.broadcast(got[0]["m"] if got else fit_labeller([]).dumps())

    @F.pandas_udf("text string, n_blocks int, n_main int")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net = Labeller.loads(model.value)
        for batch in batches:
            out = []
            for s in range(0, len(batch), 512):
                parsed = [blocks(p) for p in batch.iloc[s:s + 512]]
                for bs, keep in zip(parsed, net.label(parsed)):
                    out.append((" ".join(b.text for b, k in zip(bs, keep) if k), len(bs), int(keep.sum())))
            yield pd.DataFrame(out, columns=["text", "n_blocks", "n_main"])

    out = pages.select(as_row(pages).alias("row"), label(page).alias("x"))
    return out.select("row", "x.text", F.char_length("x.text").cast("long").alias("n_chars"), "x.n_blocks", "x.n_main")
