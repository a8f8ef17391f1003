"""HTML extraction: structure where pages have it, repeated text of a host where they don't.

A page is cut into blocks of text by its tags.  Blocks inside menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and comments are left out, and so are hidden elements;
where a page names its article (article, main, role=main or itemprop=articleBody), the blocks
inside it are the main text.  A class token whose first or last word is one of comments or adverts
names them, unless a word beside it says otherwise (no-ads, comments-open).

The text of a host's suffix array are the words of its pages outside named articles.  Every word
starts a suffix, compared to a depth of DEPTH words: all suffixes of all hosts are sorted, and
neighbours that agree to that depth are a run of the array.  A run with two distinct pages, and
SHARE of the host's, is a repeat.  Deeper comparison would not change what repeats cover: a repeat
of L words is the union of its L - DEPTH + 1 windows, all of which are runs of the array.  Every
page is looked up in its host's array; where blocks are undecided, repeats are boilerplate: words
that they cover go, other runs stay.  Near copies of a page count as that page,
so that they don't take their text from each other.  A block
shorter than DEPTH is one suffix of its own length.  The sort cuts hosts and runs anywhere, and what
a run holds on both sides of a cut is added up, so a host or a passage of any size is no hot spot.

Text inside a named article is never removed for being repeated: articles that quote or copy
one another are whole articles.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from remnant.llm.common import SLICE, components, text_udf
from remnant.llm.url_filter import host
from remnant.sources.storage import materialize, stored

DEPTH = 6
SHARE = 0.1  # of a host's pages have what is boilerplate
SIGNS, ROWS = 64, 4
_ODD = (np.random.default_rng(10).integers(0, 1 << 63, SIGNS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_PLACES = np.random.default_rng(6).integers(0, 1 << 63, DEPTH, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
ALIKE = 0.6  # of all suffixes of two near copies are shared

#: Element names, and words of class, id and role that name what is left out.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
DROPPED = frozenset(
    "nav header footer aside form script style noscript template iframe object svg canvas audio video button select textarea input "
    "head title dialog menu".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = BLOCKS - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "title"}
HINTS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner banners cookie cookies consent gdpr notice notices "
    "newsletter subscribe subscription signup sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments "
    "commentlist respond disqus related share sharing social popup modal overlay widget widgets toolbar pagination pager alert "
    "contentinfo complementary search skip".split()
)
COMMENT_HINTS = frozenset("comment comments commentlist reply replies ad ads advert advertisement sponsored promo".split())
#: Words that may stand beside a hint in one class token, as in site-footer or comment-list.
BESIDE = frozenset(
    "site page global main primary secondary post entry top bottom left right box block bar list item items area wrap wrapper "
    "container inner outer section body text link links button buttons icons slot unit form panel column col row".split()
)
#: Words that name readers' comments or adverts as the first or last word of a token, whatever the others are.
ENDING = frozenset("comment comments commentlist disqus replies ad ads adbox advert adverts advertisement adsense adsbygoogle taboola outbrain".split())
#: Words beside them that say otherwise, as in no-ads, comments-open or category-ads.
NEGATING = frozenset("no not non has have is with without free hide hidden open closed enabled disabled allow category tag topic type status hoc".split())
#: Hints whose element is left out even if it holds a named article: readers' comments, adverts, teasers.
HELD = COMMENT_HINTS | frozenset("respond related".split())
PLAIN = frozenset("html body main".split())
_LISTS, _TABLES = {"ul", "ol", "menu", "dl"}, {"table"}
#: Elements whose start ends an open one of these kinds, up to the nearest container.
SIBLINGS = {
    "li": ({"li"}, _LISTS), "dt": ({"dt", "dd"}, _LISTS), "dd": ({"dt", "dd"}, _LISTS),
    "tr": ({"tr"}, _TABLES), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S,
)
_HINTED = re.compile(r"(?:\A|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HINT_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"(?:\A|[\s\"/])hidden(?=[\s=/]|\Z)", re.I)
_UNSEEN = re.compile(
    r"(?:\A|[\s\"'/])(?:aria-hidden\s*=\s*[\"']?true\b|style\s*=\s*(?:\"[^\"]*?|'[^']*?)?display\s*:\s*none)", re.I
)
_VALUE = re.compile(r"\"[^\"]*\"|'[^']*'")
_ARTICLE = re.compile(r"(?:\A|\s)(?:role\s*=\s*[\"']?(?:main|article)|itemprop\s*=\s*[\"']?articleBody)(?=[\s\"'/]|\Z)", re.I)
MAIN, HINTED, OPEN, OUT = 2, 1, 0, -1


class Block(NamedTuple):
    text: str
    zone: int  # MAIN: in a named article, HINTED: in one inside a hinted element, OPEN: undecided, OUT: left out


def _hidden(attributes: str) -> bool:
    """Whether an element is never shown: hidden, aria-hidden or display:none; a word inside a value is none."""
    return bool(_UNSEEN.search(attributes) or _HIDDEN.search(_VALUE.sub('""', attributes)))


def _hints(attributes: str) -> tuple[set[str], bool]:
    """Hint words of class, id and role, from tokens of hints and words beside them only: not has-sidebar.

    Also whether a token starts or ends with a word of comments or adverts: user-comments, not ad-free.
    """
    found: set[str] = set()
    ending = False
    for m in _HINTED.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").split():
            words = [x.lower() for x in _HINT_WORD.findall(token)]
            words = [x for x in words if len(x) > 1]  # share-buttons-v2
            w = set(words)
            hints = w & (HINTS | COMMENT_HINTS)
            if hints and w <= hints | BESIDE:
                found |= hints
            if words and not w & NEGATING and (words[0] in ENDING or words[-1] in ENDING):
                ending = True
    return found, ending


def blocks(page: str | None) -> list[Block]:
    """Blocks of a page in order, with one space for each run of white space.

    Unclosed and stray tags are tolerated; a tag that is cut off by the end is no text.
    """
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # name, left out, article, hinted: 1, or -n where an article lifts n
    parts: list[str] = []
    dropped = inside = hinted = lifted = 0

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(Block(text, OUT if dropped or hinted else OPEN if not inside else HINTED if lifted else MAIN))

    def pop() -> None:
        nonlocal dropped, inside, hinted, lifted
        _, d, a, h = stack.pop()
        dropped -= d
        inside -= a
        hinted -= h
        lifted -= max(0, -h)

    at, size = 0, len(page)
    while at < size:
        m = _MARK.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                parts.append(entities_escape(m[0][9:].removesuffix("]]>")))
            continue
        name = name.lower()
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if dropped or hinted:
                        flush()
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in ("article", "main", "body", "td") and name in ("p", "b", "i", "a", "span", "li"):
                    break
            continue
        if name in ENDS_P and any(s[0] == "p" for s in stack[-8:]):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in BLOCKS:
                    break
        if name == "body" or name in SIBLINGS:
            closes, until = ({"head"}, set()) if name == "body" else SIBLINGS[name]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in until:
                    break
        if name in VOID or attributes.endswith("/") and name in ("svg", "path"):
            continue
        article = name in ("article", "main") or "=" in attributes and name != "body" and bool(_ARTICLE.search(attributes))
        hints, ending = _hints(attributes) if name not in PLAIN and attributes else ((), False)
        hint = hints & (COMMENT_HINTS if name == "article" else HINTS) if hints else ()
        # An article's own class may name its column, as in news-comment; elsewhere it is a list of readers' words.
        hint = hint or ending and name != "article"
        drop = name in DROPPED or hint is not True and bool(hint and (name == "article" or hint & HELD))
        drop = drop or bool(attributes) and name not in PLAIN and _hidden(attributes)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if drop or hint:
            flush()
        # An article lifts the hints around it, but not what is left out by its element or by HELD.
        soft = -hinted if article else int(bool(hint) and not drop)
        stack.append((name, drop, article, soft))
        dropped += drop
        inside += article
        hinted += soft
        lifted += max(0, -soft)
    flush()
    return out


def entities_escape(text: str) -> str:
    """Text whose signs are no references, written so that decoding gives it back."""
    return text.replace("&", "&amp;")


def suffixes(words: list[str], depth: int = DEPTH) -> list[str]:
    """The first `depth` words of each suffix that has so many; a short text is one."""
    return [" ".join(words[i : i + depth]) for i in range(max(1, len(words) - depth + 1))]


def signature(texts: list[str], hashes: dict[str, int], depth: int = DEPTH) -> list[int]:
    """The least hash of the texts' suffixes under each of SIGNS multipliers, its upper half.

    hashes: those of words, kept from page to page.  A short text is filled up with zeros.
    """
    values, ends = [], []
    for t in texts:
        for w in t.split():
            h = hashes.get(w)
            if h is None:
                h = hashes[w] = xxhash.xxh3_64_intdigest(w)
            values.append(h)
        values += [0] * max(0, depth - len(values) + (ends[-1] if ends else 0))
        ends.append(len(values))
    words, last = np.array(values, np.uint64), len(values) - depth + 1
    windows = sum(words[j : last + j] * _PLACES[j] for j in range(depth))
    # Those that go on from one text to the next are none.
    own = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    windows = windows[own[:last] == own[depth - 1 :]]
    return ((windows * _ODD[:, None]).min(axis=1) >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist()


def _streams(texts: list) -> dict:
    """The suffixes of each page outside named articles, the signature of all, and whether it names no article."""
    found = [blocks(t) for t in texts]
    streams = [sorted({s for b in f if b.zone not in (MAIN, HINTED) for s in suffixes(b.text.split())}) for f in found]
    # Articles tell pages apart that share nothing but the host's boilerplate.
    hashes: dict[str, int] = {}
    signs = [signature([b.text for b in f], hashes) if s else None for f, s in zip(found, streams)]
    return {"s": streams, "sig": signs, "asks": [named_text(f) is None for f in found]}


def _named(texts: list) -> dict:
    """Main text of pages that name an article; null of others."""
    found = [named_text(blocks(t)) for t in texts]
    return {"text": found}


def unique_runs(text: str, repeated: frozenset, depth: int = DEPTH) -> str:
    """The words of a block that no repeated substring covers."""
    words = text.split()
    covered = np.zeros(len(words) + 1, bool)
    for i, s in enumerate(suffixes(words, depth)):
        if s in repeated:
            covered[i : i + depth] = True
    return " ".join(w for w, c in zip(words, covered) if not c)


def main_text(page: str | None, repeated: frozenset = frozenset()) -> str:
    """Main text of a page; `repeated`: the host's repeated suffixes."""
    found = blocks(page)
    named = named_text(found)
    if named is not None:
        return named
    kept = [unique_runs(b.text, repeated) for b in found if b.zone == OPEN]
    return "\n\n".join(t for t in kept if t)


def named_text(found: list[Block]) -> str | None:
    """Text of the named articles; of those inside hinted elements where there are no others."""
    best = max((b.zone for b in found), default=OUT)
    return "\n\n".join(b.text for b in found if b.zone == best) if best >= HINTED else None


@arrow_udf(T.StringType())
def _main_text(pages: pa.Array, repeated: pa.Array) -> pa.Array:
    parts = []
    for s in range(0, len(pages), SLICE):
        rows = zip(pages.slice(s, SLICE).to_pylist(), repeated.slice(s, SLICE).to_pylist())
        parts.append(pa.array([main_text(p, frozenset(r or ())) for p, r in rows], pa.string()))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def near_copies(streams: DataFrame) -> DataFrame:
    """(host, page, class): pages of a host that share at least about ALIKE of their suffixes are one class.

    streams: host, page, sig.  Pages of a host that agree on ROWS signs in a row are compared with
    the least of them, never in pairs.
    """
    signs = streams.select("host", "page", "sig", F.xxhash64("host", "page").alias("id"))
    keys = [F.xxhash64(F.lit(k), "host", *[F.col("sig")[k + i] for i in range(ROWS)]) for k in range(0, SIGNS, ROWS)]
    bands = signs.select("id", F.explode(F.array(*keys)).alias("band"))
    stars = bands.join(bands.groupBy("band").agg(F.min("id").alias("b")), "band").filter("id <> b").select(F.col("id").alias("a"), "b").distinct()
    both = stars.join(signs.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a").join(signs.select(F.col("id").alias("b"), F.col("sig").alias("y")), "b")
    alike = F.aggregate(F.zip_with("x", "y", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, v: n + v)
    merged = components(both.filter(alike >= ALIKE * SIGNS).select("a", "b"))
    return signs.join(merged, F.col("id") == F.col("node"), "left").select("host", "page", F.coalesce("component", "id").alias("class"))


_RUN = pa.schema([("host", pa.string()), ("s", pa.string()), ("n", pa.int64())])


def _runs(batches):
    """host, s, n: runs of equal neighbours of a sorted part of the array, and their distinct classes.

    The rows are distinct.  A run of one class inside the part is no repeat and is left out; the
    first and the last run may go on in another part.
    """
    first, run = True, None  # whether no run was closed yet; host, s and rows of the open one
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        host, s = batch.column(0), batch.column(1)
        differ = [pc.not_equal(c.slice(1), c.slice(0, rows - 1)) for c in (host, s)]
        starts = np.concatenate([[0], np.flatnonzero(pc.or_(*differ).to_numpy(zero_copy_only=False)) + 1])
        sizes = np.diff(np.append(starts, rows))
        head = (host[0].as_py(), s[0].as_py())
        out = []
        if run and run[:2] == head:
            sizes[0] += run[2]
        elif run:
            out += [run] if first or run[2] > 1 else []
            first = False
        for k in np.flatnonzero((sizes[:-1] > 1) | (np.arange(len(sizes) - 1) == 0) & first):
            out.append((host[int(starts[k])].as_py(), s[int(starts[k])].as_py(), int(sizes[k])))
        first = first and len(sizes) == 1
        run = (host[int(starts[-1])].as_py(), s[int(starts[-1])].as_py(), int(sizes[-1]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RUN)], schema=_RUN)
    if run:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(run, _RUN)], schema=_RUN)


def suffix_array(entries: DataFrame) -> DataFrame:
    """The array of all hosts: distinct (host, s, class), sorted across partitions and inside them.

    A run may be cut between partitions, as its classes are sorted too.
    """
    # Equal rows are dropped first, where they are; the sort then holds each once.  With a number of
    # its own the array stays cut where adaptive execution would join its parts again.
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["host", "s", "class"]
    return entries.select(*keys).distinct().repartitionByRange(parts, *keys).sortWithinPartitions(*keys)


def repeated_suffixes(streams: DataFrame) -> DataFrame:
    """(host, s): suffixes on at least two and SHARE of the host's pages; near copies are one page.

    streams: host, page, s, sig: one row per distinct page, its suffixes outside named articles.
    """
    copies = materialize(near_copies(streams))
    pages = copies.groupBy("host").agg(F.countDistinct("class").alias("pages"))
    entries = streams.select("host", "page", F.explode("s").alias("s")).join(copies, ["host", "page"])
    runs = suffix_array(entries).mapInArrow(_runs, "host string, s string, n bigint")
    n = runs.groupBy("host", "s").agg(F.sum("n").alias("n")).filter("n > 1")
    return n.join(pages, "host").filter(F.col("n") >= SHARE * F.col("pages")).select("host", "s")


def extract(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_repeats per row of pages.

    Null and empty html have an empty text.  Pages of equal html, and near copies, are one page for
    the question on how many of the host's pages a substring occurs.  Pages without a host form
    one host of their own.  n_repeats: the page's suffixes outside named articles that are repeats
    of its host's array.  Other columns are ignored.
    """
    rows = pages.select(F.col(page_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("host", host(F.col("url"))).withColumn("page", F.xxhash64("html"))
    # Only the streams are stored and moved; html is read again for the texts.
    # Called non-deterministic, so that the filter on its result doesn't run it again.
    split = text_udf(_streams, "s array<string>, sig array<int>, asks boolean").asNondeterministic()
    parsed = rows.select("host", "page", split(F.col("html")).alias("p"))
    streams = parsed.select("host", "page", "p.*").filter("size(s) > 0").dropDuplicates(["host", "page"])
    streams, _ = stored(streams, "streams")
    # An article's text needs no list of repeats, only pages that ask get one.
    entries = streams.select("host", "page", "asks", F.explode("s").alias("s"))
    marked = entries.join(repeated_suffixes(streams), ["host", "s"]).groupBy("host", "page").agg(
        F.count(F.lit(1)).alias("n_repeats"), F.collect_list(F.when(F.col("asks"), F.col("s"))).alias("repeated")
    )
    marked, _ = stored(marked, "marked")
    texts = rows.withColumn("named", text_udf(_named, "text string")(F.col("html"))["text"])
    texts = texts.withColumn("html", F.when(F.col("named").isNull(), F.col("html")))
    found = texts.join(marked, ["host", "page"], "left")
    return found.select(
        "page_id", "url", F.coalesce("named", _main_text(F.col("html"), F.col("repeated"))).alias("text"), F.coalesce("n_repeats", F.lit(0)).alias("n_repeats")
    )
