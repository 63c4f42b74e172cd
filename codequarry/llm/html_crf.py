"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

Each block is described by the tags around it, the words of their class names, and its text (length, links,
marks, position, tell-tale words); neighbouring labels depend on each other. The field is trained on labelled
pages by maximum likelihood (forward-backward sums) and decoded by Viterbi.

The labelled pages are of two kinds, both bounded: ``SAMPLE_PAGES`` pages of the input (whole ones, of up to
``SAMPLE_BLOCKS`` blocks; read on the executors, which send features), labelled by their own semantic elements (a block inside article or main, and in nothing that names navigation, notices, adverts, forms or
comments, is main text), and ``LAYOUT_PAGES`` pages in layouts of our own (with and without semantic elements)
whose blocks are filled with passages of the sampled pages.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm import labelled
from codequarry.llm.html_blocks import Block, Element, blocks, steps

SAMPLE_PAGES = 200
LAYOUT_PAGES = 500
PASSAGE = 2000  # characters of a sampled passage that fill blocks of made-up pages
SAMPLE_BLOCKS = 2000  # pages of the input with more blocks are not in the sample
SEED = 3

# Words of class names and of texts that tell blocks apart.
ASIDE_WORDS = frozenset(
    """ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus dialog footer form
    gdpr login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup privacy promo promoted recommended related replies
    reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget""".split()
)
MAIN_WORDS = frozenset("article articlebody body content entry main maincontent post story text".split())
ASIDE_TAGS = frozenset("nav aside footer form button dialog menu".split())
TELLING = frozenset(
    "accept advertisement advertisements agree comment comments contact cookie cookies copyright follow home login menu more newsletter next password policy previous privacy read related reply rights search share sign sponsored subscribe terms".split()
)
NAMED_ASIDE = ASIDE_WORDS - {"body", "text"}
_NAMES = ASIDE_WORDS | MAIN_WORDS


def _step(value: float, steps: tuple[float, ...]) -> int:
    return sum(value >= s for s in steps)


def describe(page: list[Block], known: frozenset[str] | None = None) -> Iterator[list[str]]:
    """The feature names that hold for each block; of the tags around it only those in ``known``, if given."""
    around: list[Element] = []
    tags: Counter[str] = Counter()
    names: Counter[str] = Counter()
    for i, (left, entered, block) in enumerate(steps(page)):
        for _ in range(left):
            element = around.pop()
            tags.subtract([element.tag])
            names.subtract(_NAMES.intersection(element.words))
            if not tags[element.tag]:
                del tags[element.tag]
        for element in entered:
            around.append(element)
            tags[element.tag] += 1
            names.update(_NAMES.intersection(element.words))
        named = {w for w, n in names.items() if n}
        words = block.text.split(" ")
        lower = {w.strip(".,:;!?()").lower() for w in words}
        found = [f"in {t}" for t in (tags if known is None else tags.keys() & known)] + [f"own {around[-1].tag if around else ''}"]
        found += [f"named {w}" for w in named & ASIDE_WORDS] + [f"named {w}" for w in named & MAIN_WORDS] + [f"says {w}" for w in lower & TELLING]
        if named & NAMED_ASIDE:
            found.append("named aside")
        if named & MAIN_WORDS:
            found.append("named main")
        if "article" not in tags and "main" not in tags:
            found.append("in no article")
        found += [
            f"words {_step(len(words), (2, 4, 8, 15, 30, 60))}",
            f"links {_step(block.linked / len(block.text), (0.05, 0.5, 0.9))}",
            f"end {block.text[-1] in '.!?:;…»”'}",
            f"marks {_step(block.text.count(',') + block.text.count('. '), (1, 3, 8))}",
            f"place {_step(i / max(1, len(page) - 1), (0.1, 0.3, 0.7, 0.9))}",
            f"copy {'©' in block.text}",
            "always",
        ]
        yield found


class Field:
    """Weights of features by label (emission) and of label pairs (transition); label 1 is main text."""

    def __init__(self, names: list[str]):
        self.index = {n: i for i, n in enumerate(names)}
        self.tags = frozenset(n[3:] for n in names if n.startswith("in "))
        self.emission = np.zeros((len(names), 2))
        self.transition = np.zeros((2, 2))

    def scores(self, page: list[Block]) -> np.ndarray:
        index, emission = self.index, self.emission
        return np.array([emission[[index[n] for n in found if n in index]].sum(0) for found in describe(page, self.tags)]).reshape(-1, 2)

    def fit(self, pages: list[list[list[str]]], labels: list[list[int]], rounds: int = 150, rate: float = 0.1, ridge: float = 0.02) -> None:
        """Maximum likelihood by Adam, on described pages; all go through forward and backward sums side by side."""
        longest, n = max(map(len, pages)), len(pages)
        rows, columns = [], []
        y, real = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
        for p, page in enumerate(pages):
            y[p, : len(page)], real[p, : len(page)] = labels[p], True
            for i, found in enumerate(page):
                own = [self.index[x] for x in found if x in self.index]
                rows += [p * longest + i] * len(own)
                columns += own
        rows, columns = np.array(rows), np.array(columns)
        both = real[:, 1:]
        target = np.zeros((n, longest, 2))
        target[real, y[real]] = 1
        pairs = np.zeros((2, 2))
        np.add.at(pairs, (y[:, :-1][both], y[:, 1:][both]), 1)
        moments = [np.zeros_like(self.emission), np.zeros_like(self.emission), np.zeros((2, 2)), np.zeros((2, 2))]
        for step in range(1, rounds + 1):
            score = np.zeros((n * longest, 2))
            for k in (0, 1):
                score[:, k] = np.bincount(rows, self.emission[columns, k], n * longest)
            score = score.reshape(n, longest, 2)
            ahead, back = np.zeros_like(score), np.zeros_like(score)
            ahead[:, 0] = score[:, 0]
            for i in range(1, longest):
                new = score[:, i] + np.logaddexp(ahead[:, i - 1, :1] + self.transition[0], ahead[:, i - 1, 1:] + self.transition[1])
                ahead[:, i] = np.where(real[:, i, None], new, ahead[:, i - 1])
            for i in range(longest - 2, -1, -1):
                ahead_of = score[:, i + 1] + back[:, i + 1]
                new = np.logaddexp(ahead_of[:, :1] + self.transition[:, 0], ahead_of[:, 1:] + self.transition[:, 1])
                back[:, i] = np.where(real[:, i + 1, None], new, 0)
            total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
            chance = np.where(real[:, :, None], np.exp(ahead + back - total[:, None, None]), 0)
            difference = (target - chance).reshape(-1, 2)
            slope = np.column_stack([np.bincount(columns, difference[rows, k], len(self.emission)) for k in (0, 1)]) / n - ridge / n * self.emission * 10
            joint = ahead[:, :-1, :, None] + self.transition + (score + back)[:, 1:, None, :] - total[:, None, None, None]
            turn = (pairs - np.exp(np.where(both[:, :, None, None], joint, -np.inf)).sum((0, 1))) / n
            for weights, grad, m, v in ((self.emission, slope, *moments[:2]), (self.transition, turn, *moments[2:])):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                weights += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def decode(self, page: list[Block]) -> list[int]:
        """The most probable labels (Viterbi)."""
        if not page:
            return []
        score, (a, b) = self.scores(page).tolist(), self.transition.tolist()
        best0, best1 = score[0]
        back = []
        for s0, s1 in score[1:]:
            from00, from10, from01, from11 = best0 + a[0], best1 + b[0], best0 + a[1], best1 + b[1]
            back.append((int(from10 > from00), int(from11 > from01)))
            best0, best1 = max(from00, from10) + s0, max(from01, from11) + s1
        labels = [int(best1 > best0)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def own_labels(page: list[Block]) -> list[int] | None:
    """Labels from a page's semantic elements; None if it has neither article nor main."""
    out, some = [], False
    states: list[str] = []  # of the elements around a block: not yet inside main text, inside it, or out of it for good
    for left, entered, _ in steps(page):
        del states[len(states) - left :]
        for e in entered:
            state = states[-1] if states else "before"
            some = some or e.tag in ("article", "main")
            if state != "out":
                if e.tag in ("article", "main"):
                    state = "inside"
                elif e.tag in ASIDE_TAGS or (not NAMED_ASIDE.isdisjoint(e.words) if state == "inside" else e.tag == "header"):
                    state = "out"
            states.append(state)
        out.append(int(bool(states) and states[-1] == "inside"))
    return out if some else None


def layouts(passages: list[str], count: int = LAYOUT_PAGES, seed: int = SEED) -> tuple[list[list[Block]], list[list[int]]]:
    """Pages in random layouts, whose blocks carry their labels: a text begins with its label and a bar."""
    rng = random.Random(seed)
    pick = rng.choice
    long = [p for p in passages if len(p.split()) >= 12] or ["Plain words make a sentence that is long enough to be read, and end with a stop."]

    def para(y: int) -> str:
        own = " ".join(pick(long).split(" ")[: rng.randint(3, 120)]).rstrip(",") + pick([".", ".", ".", "", "!"])
        return f"{y}|{own}"

    def few(y: int, most: int = 8) -> str:
        return f"{y}|" + " ".join(pick(long).split(" ")[: rng.randint(1, most)])

    def named(words: str) -> str:
        return f'{pick(["class", "class", "id"])}="{pick(words.split())}"'

    def links(n: int) -> str:
        return "".join(f'<li><a href="#">{few(0, 4)}</a></li>' for _ in range(n))

    def menu() -> str:
        inner = f"<ul>{links(rng.randint(2, 9))}</ul>"
        return pick([f"<nav>{inner}</nav>", f"<nav {named('navbar main-nav')}>{inner}</nav>", f"<div {named('menu nav navigation site-menu topbar breadcrumbs')}>{inner}</div>"])

    def advert() -> str:
        return f"<div {named('ad ads advert ad-slot banner sponsored promo')}>{pick([few(0, 12), para(0), '0|Advertisement'])}</div>"

    def notice() -> str:
        says = pick(["We use cookies to improve this site.", "This site uses cookies. Read our privacy policy.", "Accept all cookies to go on."])
        return f"<div {named('cookie-notice notice consent gdpr-banner popup overlay')}><p>0|{says}</p><button>0|{pick(['Accept', 'I agree', 'OK'])}</button></div>"

    def form() -> str:
        return f"<form {named('search login newsletter subscribe')}><label>0|{pick(['Search', 'Email', 'Subscribe to our newsletter', 'Password'])}</label><input><button>0|Go</button></form>"

    def related() -> str:
        inner = pick([f"<ul>{links(rng.randint(2, 6))}</ul>", f"<p>{para(0)}</p>", f"<p>{few(0)}</p><p>{para(0)}</p>"])
        return pick([f"<aside>{inner}</aside>", f"<aside {named('sidebar related')}>{inner}</aside>", f"<div {named('sidebar related widget recommended share social tags')}>{inner}</div>"])

    def comments() -> str:
        each = "".join(f"<div class=\"comment\"><p>{few(0, 3)}</p><p>{para(0)}</p></div>" for _ in range(rng.randint(1, 5)))
        tag = pick(["section", "div", "ol"])
        return f"<{tag} {named('comments disqus replies comment-list respond')}><h{rng.randint(2, 3)}>0|{pick(['Comments', 'Replies', '3 comments'])}</h3>{each}</{tag}>"

    def main() -> str:
        inner = [pick([f"<h1>{few(1, 14)}</h1>", f"<h1>{few(1, 14)}</h1>", f"<header><h1>{few(1, 14)}</h1></header>", ""])]
        for _ in range(rng.randint(1, 12)):
            inner.append(
                pick([f"<p>{para(1)}</p>"] * 8 + [f"<p>{para(1)}", f"<p><b>{para(1)}<br>", f"<h2>{few(1, 9)}</h2>", f"<blockquote><p>{para(1)}</p></blockquote>"]
                     + [f"<ul><li>{para(1)}</li><li>{few(1, 12)}</li></ul>", f"<div>{para(1)}</div>", f"<pre>{para(1)}</pre>", f"<table><tr><td>{few(1)}</td><td>{para(1)}</td></tr></table>"])
            )
            if rng.random() < 0.12:
                inner.append(pick([advert, related, form])())
        if rng.random() < 0.2:
            inner.append(comments())
        body = "".join(inner)
        wraps = ["<article>{}</article>"] * 5 + ["<main>{}</main>", "<main><article>{}</article></main>", "<main><div class=\"content\">{}</div></main>", "<article class=\"post\"><div class=\"entry-content\">{}</div></article>"]
        wraps += [f'<div {named("content main post-body entry-content story article-body text post maincontent")}>{{}}</div>'] * 3 + ["<div>{}</div>", "<section>{}</section>", "<table><tr><td>{}</td></tr></table>"]
        return pick(wraps).format(body.replace("{", "(").replace("}", ")"))

    def head() -> str:
        return pick([f"<header><div class=\"logo\">{few(0, 4)}</div>{menu()}</header>", menu(), f"<div {named('header masthead site-header')}>{few(0, 5)}{menu()}</div>"])

    def foot() -> str:
        inner = pick([f"0|© {few(0, 12)[2:]}", f"<p>0|Copyright {few(0)[2:]}. All rights reserved.</p>", f"<ul>{links(4)}</ul><p>{para(0)}</p>", f"© {few(0)[2:]} · {para(0)[2:]}".join(["0|", ""])])
        return pick([f"<footer>{inner}</footer>", f"<div {named('footer site-footer copyright')}>{inner}</div>"])

    pages, labels = [], []
    for _ in range(count):
        parts = [head()]
        parts += [f() for f in (notice, advert, form, related) if rng.random() < 0.35]
        parts.append(main())
        parts += [f() for f in (comments, related, advert, form) if rng.random() < 0.3]
        parts += [foot()] * (rng.random() < 0.9) + [notice()] * (rng.random() < 0.2)
        page, own = [], []
        for b in blocks("<html><body>" + "".join(parts) + "</body></html>"):
            marks = [m for m in b.text.split(" ") if m[:2] in ("0|", "1|")]
            if not marks:
                continue
            text = " ".join(w[2:] if w[:2] in ("0|", "1|") else w for w in b.text.split(" ")).strip()
            if text:
                page.append(Block(b.inmost, text, min(b.linked, len(text))))
                own.append(int(marks[0][0]))
        if page:
            pages.append(page)
            labels.append(own)
    return pages, labels


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Field:
    """A field fitted on the driver, on a sample of pages (by the order of a hash) and on layouts filled with their passages."""
    picked = labelled.lowest(pages.where("html is not null").select("page_id", "url", "html"), F.xxhash64(F.lit("sample"), "page_id", "url", F.length("html")), sample_pages)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for batch in batches:
            for html in batch.column(0).to_pylist():
                page = blocks(html)
                own = own_labels(page) if len(page) <= SAMPLE_BLOCKS else None
                if page and own is not None:
                    out.append((list(describe(page)), own, [b.text[:PASSAGE] for b, y in zip(page, own, strict=True) if y]))
        kinds = (pa.list_(pa.list_(pa.string())), pa.list_(pa.int32()), pa.list_(pa.string()))
        columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["found", "labels", "passages"])

    known = picked.select("html").mapInArrow(described, "found array<array<string>>, labels array<int>, passages array<string>").orderBy(F.xxhash64("found", "labels")).collect()
    made, labels = layouts([p for r in known for p in r["passages"]])
    every = [(r["found"], r["labels"]) for r in known] + [(list(describe(p)), y) for p, y in zip(made, labels, strict=True)]
    seen: dict[str, int] = {}
    for page, _ in every:
        for found in page:
            for name in found:
                seen[name] = seen.get(name, 0) + 1
    field = Field(sorted(n for n, c in seen.items() if c >= 3))
    field.fit([p for p, _ in every], [y for _, y in every])
    return field


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """``page_id, url, html`` to ``page_id, url, text, n_chars``, one row per input row.

    ``text`` has the main blocks in page order, joined by newlines; a null or empty page, or one without main
    text, gives an empty text. ``n_chars`` counts code points. Repeated rows give equal texts.
    """
    model = pages.sparkSession.sparkContext.broadcast((list(field.index), field.emission, field.transition))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(model.value[0])
        own.emission, own.transition = model.value[1:]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = []
                for page in part.column(2).to_pylist():
                    found = blocks(page or "")
                    texts.append("\n".join(b.text for b, y in zip(found, own.decode(found), strict=True) if y))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def query(spark, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, train(pages))
