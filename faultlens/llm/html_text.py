"""Main text of web pages by tag-path ratios.

A page is cut into blocks, each with its path of tags (and classes) from the root. For every path the text length and the
punctuation of its blocks are summed and divided by their number; both ratios are smoothed with those of the paths under
the same parent and fused. Scores of paths outside the container (the page's article or main element if there is one with
text, else the deepest path that holds nearly all content) count a quarter, and paths above the standard deviation of all are
content, on every page. Of the others only headings, and items of lists, tables and the like between or beside content, stay,
if they lie in the container and aren't mostly links. Elements that by their names are no part of an article are left out,
unless they enclose it. Pages are independent, so nothing is shuffled.
"""
from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from faultlens.llm.registry import query, table

# Names of elements and of classes, ids and roles.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
NEVER = frozenset(
    "aside audio button canvas datalist dialog fieldset footer form head iframe input label legend link menu meta nav noembed noframes noscript object "
    "optgroup option script search select style svg math template textarea title video".split())
# Of these, elements whose text is no text of the page, and wrappers that may enclose an article.
UNSEEN = frozenset("audio button canvas datalist head iframe input label legend link meta noembed noframes noscript object optgroup option script select style svg math template textarea title video".split())
WRAPPERS = frozenset("form fieldset header".split())
NOISE = frozenset(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright "
    "discussion disqus dropdown footer gdpr login masthead menu modal nav navbar navigation navigator newsletter notice notices notification pager paginate pagination "
    "popup promo promoted promotion promotions related reply replies respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe "
    "subscription toolbar topbar widget widgets complementary alert".split())
NOISE_IN_ARTICLE_NAMES = frozenset("ad ads advert advertisement comment comments promo related reply sponsor sponsored widget".split())
# Words of layout that may stand beside a word of NOISE in one name: "site-footer" is noise, "related-work" is not.
LAYOUT = frozenset(
    "a accent aria area articles bar block body bottom bottoms box btn button buttons c card cards cell center close col collapse column columns container content cta default desktop div "
    "el element end fixed float fluid global grid group h header holder home horizontal icon icons id image images img inline inner item items js l label large lg left level line link "
    "links list lists local m main md media menus meta mid middle mini mobile module modules more news o outer overlay p page pages panel panels pane placement post posts primary pub region "
    "right root row s section sections secondary sidebar site slot slots sm small sticky stories story sub t tab tabs tag tags text tile title toggle top tool u ui ul unit units vertical view w "
    "wide wrap wrapper x xl xs y z zone".split())
CLOSES_P = BLOCKS - frozenset("body caption dd dt head html legend li optgroup option tbody td tfoot th thead tr".split())
SAME_CLOSE = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("td", "th", "tr", "tbody", "thead", "tfoot"),
    "tfoot": ("td", "th", "tr", "tbody", "thead"), "thead": ("td", "th", "tr", "tbody", "tfoot")}
OUTSIDE = 0.25  # weight of paths outside the container
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HOLDERS = frozenset("ul ol dl table blockquote pre figure".split())  # of short items
# An element of these kinds is a limit for implied ends.
LIMITS = frozenset("table ul ol dl select body html article section div main td th".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_READ = frozenset("class id role hidden style aria-hidden itemprop".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[.,;:!?…，。、；：！？।]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block:
    __slots__ = ("path", "parts")

    def __init__(self, path: int):
        self.path, self.parts = path, []  # parts: (path of the innermost element under a veto or -1, whether in a link, text)


class Page:
    """Blocks of a page in order, and its tag paths as (parent, step) pairs; one pass over the text."""

    def __init__(self, source: str):
        self.paths: list[tuple[int, str]] = [(-1, "")]
        self.known: dict[tuple[int, str], int] = {}
        self.main: dict[int, bool] = {}  # paths of article and main elements: whether it is named as the text itself
        self.vetoes: dict[int, bool] = {}  # paths of elements that are no part of an article by their name: whether they may enclose one
        self.blocks: list[Block] = []  # without text that isn't shown
        self.stack: list[tuple[str, int, bool, int]] = [("", 0, False, -1)]  # name, path, whether it isn't shown, innermost veto
        self.opened: dict[str, int] = {}
        self.block: Block | None = None
        self._parse(source)

    def _parse(self, source: str) -> None:
        at = 0
        while True:
            tag = _TAG.search(source, at)
            self._text(source[at:tag.start()] if tag else source[at:])
            if not tag:
                break
            at = tag.end()
            name = (tag[2] or tag[5] or "").lower()
            if not name:
                if tag[0].startswith("<![CDATA["):
                    self._text(tag[0][9:-3], decode=False)
                continue
            if tag[1] or tag[4]:
                self._end(name)
                continue
            closed_at_once = self._start(name, tag[3] if tag[2] else tag[6] or "")
            if name in RAW and not closed_at_once:
                end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(source, at)
                at = end.start() if end else len(source)

    def _path(self, step: str) -> int:
        key = self.stack[-1][1], step
        if key not in self.known:
            self.known[key] = len(self.paths)
            self.paths.append(key)
        return self.known[key]

    def _start(self, name: str, attributes: str) -> bool:
        """Open an element; true if it holds nothing."""
        if name in CLOSES_P and self.opened.get("p"):
            self._close(("p",))
        if name in SAME_CLOSE:
            self._close(SAME_CLOSE[name])
        if name in BLOCKS:
            self.block = None
        if name == "br":
            self._text(" ")
        if name in VOID:
            return True
        if attributes.endswith("/") and name in ("svg", "math"):
            return True
        unseen, noise, label, main = self._judge(name, attributes)
        path = self._path(name + label)
        if main is not None and not noise and not unseen:
            self.main[path] = main
        if noise:
            self.vetoes[path] = name in WRAPPERS or name not in NEVER
        self.stack.append((name, path, self.stack[-1][2] or unseen, path if noise else self.stack[-1][3]))
        self.opened[name] = self.opened.get(name, 0) + 1
        return False

    def _judge(self, name: str, attributes: str) -> tuple[bool, bool, str, bool | None]:
        """Whether the element isn't shown; whether its name is that of no article; its label in paths; whether it names itself the text."""
        found: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(attributes):
            if (key := m[1].lower()) in _READ:
                found.setdefault(key, m[2] or m[3] or m[4] or "")
        tokens = [[w.lower() for w in _NAME.findall(token)] for key in ("class", "id", "role") for token in found.get(key, "").split()]
        names = {w for words in tokens for w in words}
        label = "." + ".".join(sorted(names)) if names else ""
        # Only the element's own text is the article: a bare article or main element, or one that says so.
        main = True if found.get("itemprop", "").lower() == "articlebody" else False if name in ("article", "main") or found.get("role", "").lower() in ("main", "article") else None
        if name in ("html", "body"):
            return False, False, label, None
        hidden = "hidden" in found and found["hidden"].lower() != "until-found" or found.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(found.get("style", "")))
        inside = self.opened.get("article") or self.opened.get("main")
        noise = name in NEVER or (name == "header" or "header" in names) and not inside and main is None
        telling = NOISE if main is None else NOISE_IN_ARTICLE_NAMES
        noise = noise or any(not telling.isdisjoint(words) and all(w in NOISE or w in LAYOUT for w in words) for words in tokens)
        return hidden or name in UNSEEN, noise, label, main

    def _close(self, names: tuple[str, ...]) -> None:
        """Implied ends of elements of these names, up to a limit."""
        place = len(self.stack) - 1
        reach = 0
        while place > 0:
            name = self.stack[place][0]
            if name in names:
                reach = place
            elif name in LIMITS:
                break
            place -= 1
        if reach:
            self._pop(reach)

    def _pop(self, size: int) -> None:
        while len(self.stack) > size:
            name = self.stack.pop()[0]
            self.opened[name] -= 1
            if name in BLOCKS:
                self.block = None

    def _end(self, name: str) -> None:
        if name in BLOCKS:
            self.block = None
        if name == "br":
            self._text(" ")
        if self.opened.get(name):
            place = len(self.stack) - 1
            while self.stack[place][0] != name:
                place -= 1
            self._pop(place)

    def _text(self, text: str, decode: bool = True) -> None:
        if not text or self.stack[-1][2]:
            return
        if self.block is None:
            if not text.strip():
                return
            self.block = Block(self._block_path())
            self.blocks.append(self.block)
        self.block.parts.append((self.stack[-1][3], bool(self.opened.get("a")), html.unescape(text) if decode and "&" in text else text))

    def _block_path(self) -> int:
        place = len(self.stack) - 1
        while place > 0 and self.stack[place][0] not in BLOCKS:
            place -= 1
        return self.stack[place][1]

    def _chain(self, path: int) -> list[int]:
        """Vetoes on a path, the innermost first."""
        found = []
        while path > 0:
            if path in self.vetoes:
                found.append(path)
            path = self.paths[path][0]
        return found

    def release(self) -> None:
        """Lift vetoes on elements that enclose the page's article or main element or most of its text.

        The vetoes around an article go if no article lies outside of any; of several articles, around those under the
        fewest. Else those around a wrapper go that holds three quarters of its own text and of the text under no veto.
        """
        if not self.vetoes:
            return
        held: dict[int, int] = {}
        mains: dict[int, list[int]] = {}
        for block in self.blocks:
            for veto, _, text in block.parts:
                size = len(text.strip())
                if size:
                    held[veto] = held.get(veto, 0) + size
                    if self.main and veto not in mains and self.under(block.path, self.main) and (veto < 0 or not self.main_outside(block.path, veto)):
                        mains[veto] = self._chain(veto)
        if mains:
            least = min(len(chain) for chain in mains.values())
            lifted = [chain for chain in mains.values() if len(chain) == least]
        else:
            lifted = []
            free = held.pop(-1, 0)
            chains = {veto: self._chain(veto) for veto in held}
            whole = [veto for veto in held if all(self.vetoes[v] for v in chains[veto])]
            if whole and held[most := max(whole, key=held.__getitem__)] > 3 * free:
                lifted = [chains[most]]
        for chain in lifted:
            for veto in chain:
                self.vetoes.pop(veto, None)

    def main_outside(self, path: int, veto: int) -> bool:
        """Whether no article or main element lies between a path and the veto above it."""
        while path > veto and path not in self.main:
            path = self.paths[path][0]
        return path <= veto

    def texts(self) -> tuple[list[str], list[bool]]:
        """Text of each block, without parts under a veto, and whether most of it is links."""
        free: dict[int, bool] = {}
        out, linked = [], []
        for block in self.blocks:
            parts, links = [], 0
            for veto, link, text in block.parts:
                if veto not in free:
                    free[veto] = not self._chain(veto)
                if free[veto]:
                    parts.append(text)
                    links += len(text) if link else 0
            out.append(" ".join("".join(parts).split()))
            linked.append(2 * links > len(out[-1]))
        return out, linked

    def under(self, path: int, top: set[int] | dict[int, bool]) -> bool:
        while path > 0:
            if path in top:
                return True
            path = self.paths[path][0]
        return False


def path_scores(page: Page, texts: list[str], linked: list[bool] | None = None, inside: dict[int, bool] | None = None) -> dict[int, float]:
    """Fused score of each path that has blocks: length and punctuation a block, smoothed over the paths of a parent.

    Paths ``inside`` the article's element are smoothed towards it as well, as one more block of its mean would, so few or short blocks of
    a path of their own don't stand alone; those of links are not.
    """
    size: dict[int, list[float]] = {}
    own, links = [0.0, 0.0, 0.0], {}
    for i, (block, text) in enumerate(zip(page.blocks, texts, strict=True)):
        if text:
            marks = len(_PUNCTUATION.findall(text))
            for entry in (size.setdefault(block.path, [0.0, 0.0, 0.0]), own if inside and inside[block.path] else None):
                if entry is not None:
                    entry[0] += 1
                    entry[1] += len(text)
                    entry[2] += marks
            links[block.path] = links.get(block.path, 0) + (1 if linked and linked[i] else -1)
    if inside and own[0]:
        for path, entry in size.items():
            if inside[path] and links[path] < 0:
                entry[0] += 1
                entry[1] += own[1] / own[0]
                entry[2] += own[2] / own[0]
    ratios = {path: (length / n, marks / n) for path, (n, length, marks) in size.items()}
    parents: dict[int, list[float]] = {}
    for path, (length, marks) in ratios.items():
        entry = parents.setdefault(page.paths[path][0], [0.0, 0.0, 0.0])
        entry[0] += 1
        entry[1] += length
        entry[2] += marks
    scores = {}
    for path, (length, marks) in ratios.items():
        n, lengths, all_marks = parents[page.paths[path][0]]
        scores[path] = float(np.sqrt((length + lengths / n) / 2 * (1 + (marks + all_marks / n) / 2)))
    return scores


def main_text(source: str | None) -> str:
    """Text of the page's article: blocks in order, white space as one space, joined by two line feeds; empty if none."""
    if not source:
        return ""
    page = Page(source)
    page.release()
    texts, linked = page.texts()
    scores = path_scores(page, texts)
    if not scores:
        return ""
    tops = _container(page, texts, scores)
    inside = {path: 0 in tops or page.under(path, tops) for path in scores}
    scores = path_scores(page, texts, linked, inside)
    content = _above({path: score * (1 if inside[path] else OUTSIDE) for path, score in scores.items()})
    beside = {page.paths[path][0] for path in content}
    chosen = [i for i, block in enumerate(page.blocks) if texts[i] and block.path in content]
    kept = []
    for i, (block, text) in enumerate(zip(page.blocks, texts, strict=True)):
        if text and (block.path in content or inside[block.path] and not linked[i] and _accompanies(page, block.path, i < chosen[0], i < chosen[-1], beside)):
            kept.append(text)
    return "\n\n".join(kept)


def _above(scores: dict[int, float]) -> set[int]:
    """Paths whose score reaches the standard deviation of all."""
    least = np.std(list(scores.values()))
    return {path for path, score in scores.items() if score >= least}


def _accompanies(page: Page, path: int, before: bool, followed: bool, beside: set[int]) -> bool:
    """Whether a path of low score is a heading with content to follow, or an item between content or in a holder beside it."""
    if page.paths[path][1].split(".")[0] in HEADINGS:
        return followed
    while path > 0:
        parent, step = page.paths[path]
        if step.split(".")[0] in HOLDERS and (followed and not before or parent in beside):
            return True
        path = parent
    return False


def _container(page: Page, texts: list[str], scores: dict[int, float]) -> set[int]:
    """Paths of the elements that hold the article, by name or else by where the content lies."""
    content = _above(scores)
    tops: set[int] = set()
    for bodies in (True, False):
        wanted = {path for path, itself in page.main.items() if itself == bodies}
        if wanted and any(page.under(path, wanted) for path in scores):
            tops = wanted
            break
    if not tops:
        mass: dict[int, float] = {}
        total = 0.0
        for block, text in zip(page.blocks, texts, strict=True):
            if block.path in content:
                total += len(text)
                path = block.path
                while path >= 0:
                    mass[path] = mass.get(path, 0.0) + len(text)
                    path = page.paths[path][0]
        # The longest chain from the root on which each path holds nearly all of the content's text.
        tops = {max((path for path, held in mass.items() if held >= 0.9 * total and path not in scores or path == 0), key=lambda p: _depth(page, p))}
    return tops


def _depth(page: Page, path: int) -> int:
    depth = 0
    while path > 0:
        path, depth = page.paths[path][0], depth + 1
    return depth


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begun in range(0, batch.num_rows, 500):
            part = batch.slice(begun, 500)
            texts = [main_text(source) for source in part.column(part.num_columns - 1).to_pylist()]
            fields = [*list(part.schema)[:-1], pa.field("text", pa.string()), pa.field("n_chars", pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=pa.schema(fields))


def extract_text(pages: DataFrame, source: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points) in place of the page's source.

    Null and empty sources, and pages without an article, give an empty text; very long pages are read whole, an empty table gives no rows. Broken markup is read as browsers do: unclosed
    elements end where their kind must. Repeated rows stay repeated; columns named like the new ones are replaced.
    """
    kept = [c for c in pages.columns if c not in (source, "text", "n_chars")]
    rows = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], F.col(source).alias("_source"))
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL("text string, n_chars long").fields])
    return rows.mapInArrow(_extract, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], "text", "n_chars")


@query("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(table(spark, folder, "pages").select("page_id", "url", "html"))
