"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks: runs of text between block-level tags, with inline markup dissolved.
Each block has binary features from its ancestors (tags, words of ``class``, ``id`` and ``role``, and parts of those words; the
nearest region and the nearest names apart) and its text (length, share of linked text, punctuation). The field scores every block as main text or not, and every
pair of neighbours; it is fitted to ``labelled_pages`` by gradient steps on the exact likelihood
(forward-backward), and the best labels of a page come from Viterbi.

Character references are decoded, white space inside a block becomes one blank, blocks of main text are joined by an empty
line. Scripts, styles, comments, CDATA, parts of forms and other content without text are left out before. Broken markup is
read as far as it goes: open tags end with the page, end tags without a start are passed over. Null and
empty pages give an empty text; equal pages equal texts; pages of any length are read whole. An empty table gives an empty
result. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

import dataclasses
import html
import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cedarlog.llm.common import fresh

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements by how they are read. Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("script style noscript template iframe object svg math canvas audio video textarea title head".split())
#: Parts of forms: what they say is no text either. One that is never closed ends where it begins.
FORM_PARTS = frozenset("button select datalist label legend option optgroup meter progress output".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
CLOSES_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
               "th": ("td", "th")}
#: Elements that say what a part of the page is for.
REGIONS = frozenset("article main section aside nav header footer form dialog menu address figure table".split())
#: Share of pages that a feature must be found in.
RARE = 0.008
#: Letters of the parts by which names are known that were never seen whole.
GRAM = 4


@dataclasses.dataclass
class Block:
    """A leaf block: its text, the part of it inside links, and the features of its ancestors."""

    text: str
    linked: int
    inside: tuple[str, ...]


def _words_of(attributes: str) -> list[str]:
    if "=" not in attributes:
        return []
    return [w.lower() for m in _ATTRIBUTE.finditer(attributes) for w in _NAME.findall(m[2] or m[3] or m[4] or "")]


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, in_link, at = 0, 0, 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, tuple(itertools.chain.from_iterable(f for _, f in stack))))
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if in_link:
                linked += len(text)

    while True:
        tag = _TAG.search(page, at)
        if tag is None:
            say(page[at:])
            break
        say(page[at : tag.start()])
        at = tag.end()
        if tag[2] is None:
            continue
        name, ending = tag[2].lower(), bool(tag[1])
        if name in FORM_PARTS:
            stop = None if ending else re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            close()
            at = stop.end() if stop else at
        elif name in NO_TEXT and not ending:
            stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            close()
            if stop is None and name != "head":
                break
            at = stop.end() if stop else at
        elif name in INLINE:
            if name == "a":
                in_link = 0 if ending else 1
            elif name == "br":
                parts.append(" ")
        elif name in VOID:
            close()
        elif ending:
            close()
            in_link = 0
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
        else:
            close()
            in_link = 0
            if name in CLOSES_P and stack and stack[-1][0] == "p":
                stack.pop()
            elif name in CLOSES_SELF and stack and stack[-1][0] in CLOSES_SELF[name]:
                stack.pop()
                if name == "tr" and stack and stack[-1][0] == "tr":
                    stack.pop()
            words = _words_of(tag[3])
            stack.append((name, (f"in:{name}", *[f"word:{w}" for w in words])))
    close()
    return out


def features(block: Block) -> list[str]:
    """Of the text, of all ancestors, of the nearest ones, and of parts of their names."""
    n = len(block.text)
    share = block.linked / n
    size = "tiny" if n < 15 else "short" if n < 50 else "middle" if n < 150 else "long"
    tags = [f[3:] for f in block.inside if f.startswith("in:")]
    out = ["any", f"size:{size}", f"tag:{tags[-1] if tags else 'none'}", *dict.fromkeys(block.inside)]
    out.append("links:most" if share > 0.6 else "links:some" if share > 0.2 else "links:few")
    out.append("end:stop" if block.text[-1] in ".!?\"”»…:;" else "end:open")
    if block.text[0] in "©" or "©" in block.text[:40]:
        out.append("copyright")
    # The nearest region, what that one stands in, and how far inside it the block is.
    regions = ["page", *[t for t in tags if t in REGIONS]]
    out += [f"region:{regions[-1]}", f"regions:{'>'.join(regions[-2:])}"]
    words = [f"^{f[5:]}$" for f in block.inside if f.startswith("word:")]
    # Names of the innermost element that has any.
    named = [k for k, f in enumerate(block.inside) if f.startswith("word:")]
    if named:
        first = max((k for k, f in enumerate(block.inside[: named[-1]]) if f.startswith("in:")), default=0)
        out += [f"near:{f[5:]}" for f in block.inside[first : named[-1] + 1] if f.startswith("word:")]
    grams = {w[k : k + GRAM] for w in words for k in range(len(w) - GRAM + 1)}
    return list(dict.fromkeys([*out, *[f"gram:{g}" for g in sorted(grams)]]))


# Labelled pages -----------------------------------------------------------------------------------------

#: Parts of pages that are not main text: layout with ``{s}`` for a short and ``{t}`` for a long text.
BOILERPLATE = (
    '<nav><ul><li><a href="/a">{s}</a></li><li><a href="/b">{s}</a></li><li><a href="/c">{s}</a></li></ul></nav>',
    '<div class="menu"><a href="/a">{s}</a><p><a href="/b">{s}</a></p></div>',
    '<ul id="main-menu" class="navigation"><li><a href="/">{s}</a></li><li><a href="/x">{s}</a></li></ul>',
    '<header><h1><a href="/">{s}</a></h1><p>{s}</p></header>',
    '<div id="header" class="site-header masthead"><h2>{s}</h2><p>{t}</p></div>',
    '<div class="ad">{t}</div>',
    '<div class="advert ads advertisement"><p>{t}</p></div>',
    '<div class="banner promo"><a href="/p">{s}</a></div>',
    '<section class="sponsored promoted"><h3>{s}</h3><p>{t}</p></section>',
    '<aside><h3>{s}</h3><p>{t}</p></aside>',
    '<div class="sidebar side widget"><h4>{s}</h4><ul><li><a href="/r">{s}</a></li></ul><p>{t}</p></div>',
    '<div class="cookie notice consent"><p>{t}</p><button>{s}</button></div>',
    '<div id="cookie-banner" class="notification alert gdpr">{t}</div>',
    '<div class="notice"><p>{t}</p></div>',
    '<form action="/s"><label>{s}</label><input name="q"><p>{t}</p><button>{s}</button></form>',
    '<div class="newsletter subscribe signup"><p>{t}</p><form><input><button>{s}</button></form></div>',
    '<div class="related recommended"><h3>{s}</h3><ul><li><a href="/r1">{s}</a></li><li><a href="/r2">{s}</a></li></ul></div>',
    '<div class="share social"><a href="/f">{s}</a><a href="/t">{s}</a></div>',
    '<div class="breadcrumb breadcrumbs"><a href="/">{s}</a></div>',
    '<div class="pagination pager"><a href="/2">{s}</a></div>',
    '<section id="comments" class="comments"><h2>{s}</h2><div class="comment"><p>{t}</p></div><div class="comment reply"><p>{t}</p></div></section>',
    '<ol class="comment-list"><li class="comment"><p>{t}</p><p>{t}</p></li></ol>',
    '<div class="disqus responses"><article class="comment"><p>{t}</p></article></div>',
    '<footer>&copy; {s} &middot; {t}</footer>',
    '<div id="footer" class="footer site-info"><p>&copy; {s}</p><p>{t}</p></div>',
    '<footer><ul><li><a href="/i">{s}</a></li></ul><p>{t}</p></footer>',
    '<div class="modal popup overlay"><p>{t}</p></div>',
    '<div role="navigation"><a href="/a">{s}</a></div>',
    '<div role="complementary"><p>{t}</p></div>',
    '<div class="kopfzeile"><a href="/">{s}</a><p>{s}</p></div>',
    '<div class="seitenkopf navigationsleiste"><ul><li><a href="/a">{s}</a></li><li><a href="/b">{s}</a></li></ul></div>',
    '<div class="fusszeile"><p>{t}</p><a href="/i">{s}</a></div>',
    '<div class="seitenleiste"><h4>{s}</h4><p>{t}</p></div>',
    '<div class="werbung anzeige"><p>{t}</p></div>',
    '<div class="kommentare"><div class="kommentar"><p>{t}</p></div></div>',
    '<div class="hinweis datenschutz"><p>{t}</p></div>',
    '<div class="entete bandeau"><h2>{s}</h2><p>{s}</p></div>',
    '<div class="pied piedpage"><p>{t}</p></div>',
    '<div class="publicite"><p>{t}</p></div>',
    '<section class="commentaires"><h3>{s}</h3><p>{t}</p></section>',
    '<div class="cabecera"><p>{s}</p></div><div class="publicidad">{t}</div>',
    '<div class="comentarios"><p>{t}</p><p>{t}</p></div>',
    '<div class="pie legal"><p>{t}</p></div>',
    '<div class="adslot adbox"><p>{t}</p></div>',
    '<div class="topbar toolbar"><a href="/l">{s}</a> <a href="/r">{s}</a></div>',
    '<div class="login account userbox"><p>{s}</p><form><p>{t}</p></form></div>',
    '<div class="tags categories metadata byline"><a href="/t">{s}</a></div>',
    '<div class="teaser moreposts readmore"><h3><a href="/m">{s}</a></h3><p>{t}</p></div>',
    '<div class="authorbox bio"><p>{t}</p></div>',
    '<div class="discussion feedback replies"><h3>{s}</h3><div><p>{t}</p></div></div>',
    '<dialog><p>{t}</p></dialog>',
    '<menu><li><a href="/m">{s}</a></li></menu>',
    '<div class="search searchbar"><form><p>{s}</p><input></form></div>',
    '<div class="rating poll survey"><p>{t}</p></div>',
    '<footer><p>{t}</p></footer>',
    '<footer>{s}</footer>',
    '<div class="ad"><p>{t}</p></div>',
    '<div class="ads"><p>{s}.</p></div>',
    '<aside>{t}</aside>',
    '<form><p>{t}</p></form>',
    '<div class="comments"><p>{t}</p></div>',
    '<div class="banner"><p>{s}</p></div>',
    '<div class="cookie"><p>{t}</p></div>',
    '<div class="newsletter"><p>{t}</p></div>',
    '<div class="sponsored"><p>{t}</p></div>',
)
#: Parts of main text.
MAIN = (
    "<h1>{s}</h1><p>{t}</p><p>{t}</p><p>{s}.</p>",
    "<p>{t}</p><h2>{s}</h2><p>{t}</p><p>{t}</p>",
    "<h1>{s}</h1><p><b>{t}<br><p>{t}<p>{s}.</p>",
    "<p>{t}</p><ul><li>{t}</li><li>{s}</li></ul><p>{t}</p>",
    "<p>{t}</p><blockquote><p>{t}</p></blockquote><p>{t} <a href='/x'>{s}</a> {t}</p>",
    "<h2>{s}</h2><p>{t}</p><pre>{t}</pre><p>{s}.</p><p>{t}</p>",
    "<p>{t}</p><table><tr><td>{s}</td><td>{t}</td></tr></table><p>{t}</p>",
    "<figure><figcaption>{s}</figcaption></figure><p>{t}</p><ol><li>{t}</li></ol>",
    "<h1>{s}</h1><h3>{s}</h3><div>{t}</div><div>{t}</div><p>{s}</p>",
    "<p>{s}</p><p>{s}</p><p>{t}</p><p>{s}.</p>",
    "<header><h1>{s}</h1></header><p>{t}</p><p>{t}</p>",
    "<section><h2>{s}</h2><p>{t}</p></section><section><h2>{s}</h2><p>{t}</p><p>{t}</p></section>",
    "<div class='paragraph lead intro'><p>{t}</p></div><div class='chapter'><p>{t}</p><p>{t}</p></div>",
    "<p><a href='/l'>{s}</a> {t}</p><div><div><p>{t}</p></div></div>",
    "<p>{t}</p><p>{t}</p><p>{t}</p><p>{t}</p>",
    "<ul><li>{t}</li><li>{t}</li><li><a href='/l'>{s}</a> {t}</li></ul><dl><dt>{s}</dt><dd>{t}</dd></dl>",
)
#: What main text stands in.
FRAMES = (
    "<article>{m}</article>",
    "<article>{m}</article>",
    "<main><article class='post entry'>{m}</article></main>",
    "<main>{m}</main>",
    "<div class='content'>{m}</div>",
    "<div id='content' class='post article body text'><section>{m}</section></div>",
    "<div class='entry-content story'>{m}</div>",
    "<div role='main'>{m}</div>",
    "<div class='wrapper container page'><div>{m}</div></div>",
    "<div class='post'>{m}</div>",
    "<div class='body'>{m}</div>",
    "<div id='text'>{m}</div>",
    "<div id='story'><div class='body'>{m}</div></div>",
    "<div id='maincontent'><section>{m}</section></div>",
    "<div class='artikel inhalt'>{m}</div>",
    "<div class='contenu texte'><div>{m}</div></div>",
    "<section class='contenido'>{m}</section>",
    "<main id='mainbody'><div class='column'>{m}</div></main>",
    "<div class='layout grid'><main><article><div class='copy prose'>{m}</div></article></main></div>",
)
_MARK = "\x02"
_NAMED = re.compile(r"""( (?:class|id)=)(["'])([a-z -]+)\2""")


def labelled_pages(count: int = 800, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """Pages put together from the parts above, with a label for each leaf block.

    Texts are nonsense words, so only layout and shape can be learned. Boilerplate stands before and after the main
    text, and in most pages also between its parts, inside its frame. In most pages the names of elements
    have other words grown on to them, so that no single name decides.
    """
    rng = np.random.default_rng(seed)
    letters = np.array(list("aeioulnrstmdcpg"))
    pool = ["".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(400)]

    def words(n: int) -> str:
        return " ".join(pool[i] for i in rng.integers(0, len(pool), n))

    def fill(layout: str, mark: str) -> str:
        while "{s}" in layout or "{t}" in layout:
            short, long = layout.find("{s}"), layout.find("{t}")
            if long < 0 or 0 <= short < long:
                layout = layout.replace("{s}", mark + words(rng.integers(1, 7)).capitalize(), 1)
            else:
                layout = layout.replace("{t}", mark + words(rng.integers(6, 70)).capitalize() + ".", 1)
        return layout

    def compound(m: re.Match) -> str:
        """The same names with other words grown on to them, as sites do."""
        grown = []
        for name in m[3].split():
            other, kind = pool[rng.integers(len(pool))], rng.integers(4)
            grown.append((name, name + other, other + name, f"{other}-{name}")[kind])
        return f"{m[1]}{m[2]}{' '.join(grown)}{m[2]}"

    def some(n: int) -> str:
        return "".join(fill(BOILERPLATE[i], "") for i in rng.integers(0, len(BOILERPLATE), n))

    out = []
    for _ in range(count):
        parts = [fill(MAIN[i], _MARK) for i in rng.integers(0, len(MAIN), rng.integers(1, 5))]
        for _ in range(rng.integers(0, 6)):
            parts.insert(rng.integers(0, len(parts) + 1), some(1))
        frame = FRAMES[rng.integers(len(FRAMES))].replace("{m}", "".join(parts))
        page = f"<html><head><title>{words(4)}</title></head><body>{some(rng.integers(1, 5))}{frame}{some(rng.integers(1, 5))}</body></html>"
        if rng.random() < 0.4:
            page = _NAMED.sub(compound, page)
        found = blocks(page)
        labels = [_MARK in b.text for b in found]
        out.append((page.replace(_MARK, ""), labels))
    return out


# The field ----------------------------------------------------------------------------------------------


@dataclasses.dataclass(frozen=True)
class Field:
    """Weight of each feature for main text against the rest, and of each pair of neighbouring labels."""

    weights: dict[str, float]
    transitions: np.ndarray

    def scores(self, found: list[Block]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in features(b)) for b in found]


def decode(scores: list[float], transitions: np.ndarray) -> list[bool]:
    """The best sequence of labels (Viterbi)."""
    (aa, ab), (ba, bb) = transitions.tolist()
    off, on, back = 0.0, scores[0] if scores else 0.0, []
    for s in scores[1:]:
        from_off, from_on = off + ab >= on + bb, off + aa >= on + ba
        back.append((from_on, from_off))
        off, on = (off + aa if from_on else on + ba), s + (off + ab if from_off else on + bb)
    state, out = on > off, []
    for to_off, to_on in reversed(back):
        out.append(state)
        state = not (to_on if state else to_off)
    return [*reversed([*out, state])] if scores else []


def _log_add(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(pages: list[tuple[str, list[bool]]], steps: int = 400, rate: float = 0.3, decay: float = 0.00001) -> Field:
    """Weights by Adam on the log-likelihood of all pages at once."""
    sequences = [[features(b) for b in blocks(p)] for p, _ in pages]
    held = Counter(f for s in sequences for f in {f for block in s for f in block})
    # What few pages have tells those pages, not the layout.
    names = sorted(f for f, n in held.items() if n >= len(pages) * RARE)
    column = {f: i for i, f in enumerate(names)}
    count, longest = len(pages), max(map(len, sequences))
    y, real = np.zeros((count, longest), int), np.zeros((count, longest), bool)
    # The features of all blocks one after the other, and the place of the block each belongs to.
    which, place = [], []
    for p, (sequence, (_, labels)) in enumerate(zip(sequences, pages, strict=True)):
        for t, block in enumerate(sequence):
            known = [column[f] for f in block if f in column]
            which += known
            place += [p * longest + t] * len(known)
        y[p, : len(labels)], real[p, : len(labels)] = labels, True
    which, place = np.array(which), np.array(place)
    w = np.zeros(len(names) + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    pairs = real[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
    for step in range(1, steps + 1):
        state = np.zeros((count, longest, 2))
        state[:, :, 1] = np.bincount(place, w[which], count * longest).reshape(count, longest)
        trans = w[-4:].reshape(2, 2)
        forward, backward = state.copy(), np.zeros_like(state)
        for t in range(1, longest):
            new = _log_add(forward[:, t - 1, :, None] + trans, 1) + state[:, t]
            forward[:, t] = np.where(real[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _log_add(trans + (state[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(real[:, t + 1, None], new, backward[:, t + 1])
        whole = _log_add(forward[:, -1], 1)[:, None, None]
        chance = np.where(real[:, :, None], np.exp(forward + backward - whole), 0)
        both = np.exp(forward[:, :-1, :, None] + trans + (state + backward)[:, 1:, None, :] - whole[..., None])
        expected = np.where(pairs[:, :, None, None], both, 0).sum((0, 1))
        gap = (chance[:, :, 1] - y * real).ravel()
        grad = np.append(np.bincount(which, gap[place], len(names)), (expected - seen).ravel()) / count + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field({f: float(w[i]) for f, i in column.items()}, w[-4:].reshape(2, 2))


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page or "")
    keep = decode(field.scores(found), field.transitions)
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, field: Field | None = None, html_col: str = "html") -> DataFrame:
    """The pages with ``main_text``; the name gets underscores in front if it is taken.

    ``field`` is fitted to ``labelled_pages`` by default; fit it to pages of your own where you have labels.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fit(labelled_pages()) if field is None else field)

    def of(column: pa.Array) -> pa.Array:
        return pa.array([main_text(p, shared.value) for p in column.to_pylist()], pa.string())

    (name,) = fresh(pages, "main_text")
    return pages.withColumn(name, F.arrow_udf(of, "string")(F.col(html_col)))
