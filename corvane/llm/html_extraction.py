"""Main-text extraction: a linear-chain CRF over the leaf blocks of a page.

A block is labelled 1 (article) or 0 (anything else).  Its score sums the
weights of the names of all its ancestors and of its own tag and text; a
transition weight ties neighbours.  Weights are learned by gradient ascent on
the likelihood of labelled pages, and a page's labels decoded by Viterbi.

The labelled pages are generated: layouts with menus, headers, adverts,
notices, sidebars, forms, comments and footers around an article, in made-up
words, so nothing of the corpus to be extracted is learned by heart.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.html_blocks import Page, block_features, parse
from corvane.llm.shared import bounded_batches, tidy
from corvane.scratch import unused

TRAINING_PAGES = 600
EPOCHS = 6
SEED = 11

# The words that authors of pages commonly use in classes and ids.
ARTICLE_WORDS = "article content post entry story body main text maincontent prose page single".split()
OTHER_WORDS = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav links pagination pager tabs toc".split(),
    "header": "header masthead topbar logo branding banner site head".split(),
    "footer": "footer bottom copyright legal colophon foot credits".split(),
    "side": "sidebar aside widget rail related recommended popular trending secondary side more recent tags".split(),
    "ad": "ad ads advert advertisement adsense sponsored sponsor promo promotion promoted banner outbrain taboola".split(),
    "notice": "cookie cookies consent notice gdpr banner alert popup modal overlay privacy disclaimer paywall message".split(),
    "form": "form newsletter subscribe signup login search subscription contact".split(),
    "comments": "comments comment commentlist discussion replies reply disqus responses reader reviews respond thread".split(),
    "share": "share social sharing buttons toolbar follow print".split(),
}


class _Maker:
    """Generates pages and the labels of their blocks."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.rng
        made = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        return " ".join(made)

    def figures(self) -> str:
        """What articles have besides words: years, numbers, marks."""
        r = self.rng
        return " ".join(r.choice([str(r.randint(1, 2030)), f"{r.randint(1, 99)}.{r.randint(0, 9)}%", "©", f"©{r.randint(1990, 2030)}", f"© {self.words(1, 2)}", "€5", "(c)"]) for _ in range(r.randint(1, 5)))

    def sentence(self, low: int = 5, high: int = 60) -> str:
        return self.words(low, high).capitalize() + self.rng.choice("....!?")

    def name(self, kind: list[str]) -> str:
        r = self.rng
        word = r.choice(kind)
        if r.random() < 0.5:
            word += r.choice("-_ ") + r.choice(["box", "wrap", "area", "inner", "list", "item", "block", "container", "section", "1", r.choice(kind)])
        return f' {r.choice(["class", "class", "id"])}="{word}"'

    def plain(self) -> str:
        return self.rng.choice(["", "", ' class="row"', ' class="col wide"', ' id="wrapper"', ' class="container"'])

    def other(self, kind: str) -> str:
        """Markup of one part that isn't the article."""
        r = self.rng
        own = {"menu": ["nav", "ul", "div"], "header": ["header", "div"], "footer": ["footer", "div"], "side": ["aside", "div", "section"], "ad": ["div", "aside", "ins", "section"], "notice": ["div", "section", "p", "dialog"], "form": ["form"], "comments": ["section", "div", "ol"], "share": ["div", "ul"]}[kind]
        tag = r.choice(own)
        plain = tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.5
        start = f"<{tag}{self.plain() if plain else self.name(OTHER_WORDS[kind])}>"
        link = lambda: f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>'
        if tag == "p":
            return f"{start}{self.sentence(4, 30)}</p>"
        if kind == "menu" or tag == "ul":
            inner = "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 8)))
            return f"{start}{inner if tag == 'ul' else f'<ul>{inner}</ul>'}</{tag}>"
        if kind in ("comments",):
            item = "li" if tag == "ol" else r.choice(["div", "p", "article"])
            inner = "".join(f"<{item}{self.plain()}><p>{self.sentence(3, 50)}</p></{item}>" for _ in range(r.randint(1, 5)))
            return f"{start}{'' if tag == 'ol' else f'<h3>{self.words(1, 3)}</h3>'}{inner}</{tag}>"
        if kind == "form":
            return f'{start}<label>{self.words(1, 4)}</label><input type="text"><p>{self.words(2, 12)}</p><button>{self.words(1, 2)}</button></{tag}>'
        if kind == "footer":
            return f"{start}{r.choice(['', '<p>'])}&copy; {self.words(1, 4)} &middot; {self.sentence(2, 20)}</{tag}>"
        if kind == "header":
            inner = r.choice(["h1", "div", "p", "span"])
            return f"{start}<{inner}>{link()} {self.words(0, 5)}</{inner}></{tag}>"
        inner = "".join(r.choice([f"<p>{self.sentence(3, 40)}</p>", f"<h4>{self.words(1, 5)}</h4>", f"<ul><li>{link()}</li><li>{link()}</li></ul>", f"{self.words(3, 20)}."]) for _ in range(r.randint(1, 3)))
        return f"{start}{inner}</{tag}>"

    def article_part(self) -> str:
        r = self.rng
        kind = r.random()
        if kind < 0.66:
            text = self.sentence(1 if r.random() < 0.2 else 8, 90)
            if r.random() < 0.15:
                at = r.choice([0, len(text) // 2, len(text)])
                text = f"{text[:at]} {self.figures()} {text[at:]}"
            elif r.random() < 0.04:
                text = self.figures()
            if r.random() < 0.2:
                text = f"{text[: len(text) // 2]}<b>{text[len(text) // 2 :]}</b>"
            if r.random() < 0.15:
                text += f' <a href="/x">{self.words(1, 4)}</a> {self.sentence(2, 12)}'
            return f"<p>{text}</p>" if r.random() < 0.85 else f"<p>{text}<br>{self.sentence(2, 30)}"
        if kind < 0.76:
            level = r.randint(2, 4)
            return f"<h{level}>{self.words(1, 8)}</h{level}>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{self.words(2, 14)}{r.choice(['.', ''])}</li>" if r.random() < 0.85 else f'<li><a href="/x">{self.words(1, 5)}</a></li>' for _ in range(r.randint(1, 5))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote>{r.choice(['', '<p>'])}{self.sentence(6, 40)}</blockquote>"
        if kind < 0.94:
            return f"<pre>{self.words(3, 20)}</pre>"
        if kind < 0.97:
            return f"<figure><img src='x'><figcaption>{self.words(3, 12)}</figcaption></figure>"
        return "<table>" + "".join(f"<tr><td>{self.words(1, 5)}</td><td>{self.words(1, 5)}</td></tr>" for _ in range(3)) + "</table>"

    def page(self) -> list[tuple[str, int]]:
        """Pieces of markup in order, each with the label of the blocks in it."""
        r = self.rng
        if r.random() < 0.12:  # nothing but a text
            some = r.choice([1, 1, 2, 4])
            return [(r.choice(["", "<html><body>", "<body>", "<div>"]), 0), *[(r.choice([self.article_part(), self.article_part(), self.sentence(1, 12), f"<p>{self.words(1, 6)}</p>"]), 1) for _ in range(some)]]
        out: list[tuple[str, int]] = [(f"<html><head><title>{self.words(2, 6)}</title></head><body>", 0)]
        wraps = r.randint(0, 2)
        out += [(f"<div{self.plain()}>", 0) for _ in range(wraps)]
        for kind in r.sample(["header", "menu", "notice", "ad", "form", "side", "share", "menu"], r.randint(1, 5)):
            out.append((self.other(kind), 0))
        style = r.random()
        if style < 0.45:
            opening, closing = f"<article{self.plain() if r.random() < 0.6 else self.name(ARTICLE_WORDS)}>", "</article>"
        elif style < 0.6:
            opening, closing = f"<main{self.plain()}>", "</main>"
        elif style < 0.7:
            opening, closing = f"<main><article{self.plain()}>", "</article></main>"
        elif style < 0.9:
            tag = r.choice(["div", "section", "td"])
            opening, closing = f"<{tag}{self.name(ARTICLE_WORDS)}>", f"</{tag}>"
        else:
            opening, closing = f"<div{self.plain()}>", "</div>"
        out.append((opening, 1))
        if r.random() < 0.8:
            out.append((f"<h1>{self.words(2, 10)}{r.choice(['', '.'])}</h1>", 1))
        brief = r.random() < 0.12
        for _ in range(r.randint(1, 2) if brief else r.randint(1, 14)):
            out.append((f"<p>{self.sentence(1, 6)}</p>" if brief else self.article_part(), 1))
            if r.random() < 0.08:
                out.append((self.other(r.choice(["ad", "side", "share", "form", "notice"])), 0))
        if r.random() < 0.12:
            out.append((self.other("comments"), 0))
        out.append((closing, 1))
        for kind in r.sample(["comments", "side", "ad", "share", "form", "menu", "notice", "comments"], r.randint(0, 4)):
            out.append((self.other(kind), 0))
        out += [("</div>", 0)] * wraps
        if r.random() < 0.85:
            out.append((self.other("footer"), 0))
        out.append(("</body></html>", 0))
        if r.random() < 0.1:  # pages that break off
            out = out[: max(3, len(out) - r.randint(1, 4))]
        return out


def labelled_page(pieces: list[tuple[str, int]]) -> tuple[Page, list[int]]:
    """The page made of ``pieces`` and its labels: a block has the label of the piece that its first word stands in."""
    page = parse("".join(x for x, _ in pieces))
    labels, so_far = [], ""
    done = 0
    for markup, label in pieces:
        so_far += markup
        now = len(parse(so_far).blocks)
        labels += [label] * (now - done)
        done = max(done, now)
    return page, (labels + [0] * len(page.blocks))[: len(page.blocks)]


def page_features(page: Page) -> list[list[str]]:
    """Features of each block: names of all its ancestors, and its own."""
    return [page.names_above(b.element) + block_features(b) for b in page.blocks]


class ChainModel:
    """Weights of features for label 1, of the first label and of label pairs."""

    def __init__(self, weights: dict[str, float], start: np.ndarray, pair: np.ndarray):
        self.weights, self.start, self.pair = weights, start, pair

    def emissions(self, page: Page) -> np.ndarray:
        get = self.weights.get
        above = [*page.sums_above(get), 0.0]  # the last is for element -1
        return np.array([above[b.element] + sum(get(x, 0.0) for x in block_features(b)) for b in page.blocks])

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over many pages at once."""
        lengths = np.array([len(x) for x in scores])
        out = [np.zeros(n, dtype=np.int8) for n in lengths]
        if not len(scores) or not lengths.max():
            return out
        by = np.argsort(-lengths, kind="stable")
        most = int(lengths.max())
        emit = np.zeros((most, len(scores)))
        for k, i in enumerate(by.tolist()):
            emit[: lengths[i], k] = scores[i]
        alive = np.searchsorted(-lengths[by], -np.arange(most), "left")  # pages that have a block at each place
        best = np.stack([np.zeros(len(scores)), emit[0]], axis=1) + self.start
        back = np.zeros((most, len(scores), 2), dtype=np.int8)
        for t in range(1, most):
            n = int(alive[t])
            through = best[:n, :, None] + self.pair[None]
            back[t, :n] = through.argmax(axis=1)
            best[:n] = through.max(axis=1)
            best[:n, 1] += emit[t, :n]
        label = best.argmax(axis=1).astype(np.int8)
        for t in range(most - 1, -1, -1):
            n = int(alive[t])
            for k in range(n):
                out[by[k]][t] = label[k]
            if t:
                label[:n] = back[t, np.arange(n), label[:n]]
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4) -> ChainModel:
    """AdaGrad ascent on the conditional likelihood, by forward and backward sums."""
    names = {x: i for i, x in enumerate(sorted({x for rows, _ in pages for row in rows for x in row}))}
    w, seen = np.zeros(len(names)), np.full(len(names), 1e-6)
    tie, tie_seen = np.zeros(6), np.full(6, 1e-6)
    coded = [([np.array([names[x] for x in row]) for row in rows], np.array(labels)) for rows, labels in pages if rows]
    for _ in range(epochs):
        for rows, labels in coded:
            m = len(rows)
            start, pair = tie[:2], tie[2:].reshape(2, 2)
            emit = np.stack([np.zeros(m), np.array([w[r].sum() for r in rows])], axis=1)
            ahead, behind = np.zeros((m, 2)), np.zeros((m, 2))
            ahead[0] = emit[0] + start
            for t in range(1, m):
                ahead[t] = _logsum(ahead[t - 1][:, None] + pair, 0) + emit[t]
            for t in range(m - 2, -1, -1):
                behind[t] = _logsum(pair + (emit[t + 1] + behind[t + 1])[None], 1)
            whole = _logsum(ahead[-1], 0)
            likely = np.exp(ahead + behind - whole)
            slope_tie = np.zeros(6)
            slope_tie[:2] = -likely[0]
            slope_tie[labels[0]] += 1
            if m > 1:
                both = np.exp(ahead[:-1, :, None] + pair[None] + (emit[1:] + behind[1:])[:, None] - whole)
                slope_tie[2:] = -both.sum(axis=0).ravel()
                np.add.at(slope_tie, 2 + 2 * labels[:-1] + labels[1:], 1)
            at = np.concatenate(rows)
            slope = np.zeros(len(w))
            np.add.at(slope, at, np.repeat(labels - likely[:, 1], [len(r) for r in rows]))
            at = np.unique(at)
            g = slope[at] - decay * w[at]
            seen[at] += g * g
            w[at] += rate * g / np.sqrt(seen[at])
            tie_seen += slope_tie**2
            tie += rate * slope_tie / np.sqrt(tie_seen)
    return ChainModel({x: float(w[i]) for x, i in names.items() if w[i]}, tie[:2].copy(), tie[2:].reshape(2, 2).copy())


@lru_cache(maxsize=2)
def trained_model(pages: int = TRAINING_PAGES, seed: int = SEED) -> ChainModel:
    """The model of ``pages`` generated pages; the same for the same arguments."""
    maker = _Maker(seed)
    made = [labelled_page(maker.page()) for _ in range(pages)]
    return train([(page_features(page), labels) for page, labels in made])


def main_texts(model: ChainModel, sources: list[str | None]) -> list[str]:
    """The main text of each page; empty for null, and where no block is of the article."""
    pages = [parse(x or "") for x in sources]
    labels = model.decode([model.emissions(p) for p in pages])
    return [" ".join(b.text for b, y in zip(p.blocks, own, strict=True) if y) for p, own in zip(pages, labels, strict=True)]


def extract_main_text(pages: DataFrame, html_col: str = "html", model: ChainModel | None = None) -> DataFrame:
    """All columns of ``pages`` except the html, and text (string, empty if none) and n_chars (long, its code points).

    Null and empty pages give empty texts.  Pages of any length and depth are
    parsed whole, in time in proportion to their length.  Repeated rows give
    the same results; columns called text or n_chars are replaced, all others
    pass through, whatever their names; an empty table gives an empty result.
    No shuffle: each page is parsed where it is read.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model or trained_model())
    others = [c for c in pages.columns if c.lower() not in (html_col.lower(), "text", "n_chars")]
    slim = pages.select(*others, F.col(html_col).alias(unused(others, "source")[0]))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts(shared.value, batch.column(len(others)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*others, "text", "n_chars"])

    return slim.mapInArrow(tidy(run), schema)
