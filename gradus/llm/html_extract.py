"""HTML extraction by equivalence-class template deduction.

Tokens of a page are its tags with their path (and class) and its text nodes. Across the pages of a host each token has an
occurrence vector (how often on each page), kept as a fingerprint (a sum of hashes of page and count) that is added up in the cluster, so no
host is ever gathered. Tokens with the same vector form an equivalence class. A class is valid if it is on SUPPORT of the host's pages
and on SUPPORT of its different articles (bitmaps of hashes of the article text, so copies of one article don't make it a template).
Valid classes are then held against the pages: tokens that break the order of the class (of mean places) on more than 1 - SUPPORT of
their pages are split off, and so are those of other classes that are not nested, that is in one same gap between tokens of the class
that is on all pages, on SUPPORT of theirs. What is left is the template, its tokens in order. Roles are told apart by path and text
alone: tokens that come again are not differentiated anew by the classes found. On a page the template is what of it comes in that order (the longest increasing run; a token out of order is no
template there). The slots are what lies between its tags; text of the template is no part of them.

Of the slots, the article's are told by the page's main container (article, main, role main). A page without one takes, if its
host has a template, the slot with the most text, else the body. In these, menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and comments of readers go, by tag, role and class name: the template tells what repeats, not what a text that changes is for.

Cases: null and empty html give an empty text; pages without a host share one; pages of a host of fewer than about MIN_PAGES different
articles have no template; cut or badly nested markup is read as far as it goes, at any depth; repeated rows are extracted each.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

MIN_PAGES, SUPPORT = 18, 0.9  # pages are counted by bits, of BITS, that their articles' hashes set: 20 of 256 set about 19
BITS = 256
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTR = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "xmp", "noembed", "noframes", "object", "canvas", "audio", "video"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption",
}
_OUT_TAGS = {"nav", "footer", "aside", "form", "head", "menu", "button", "select", "dialog", "fieldset", "label", "option"}
_OUT_WORDS = re.compile(
    r"(?:^|[-_\s])(?:nav|navbar|navigation|menu|menubar|breadcrumbs?|header|masthead|topbar|footer|foot|bottom|sidebar|side|aside|widget|rail|notice|cookies?|consent|gdpr|"
    r"alert|banner|ads?|advert|adverts?|advertisement|advertising|sponsor(?:ed)?|promo|promotion|popup|modal|overlay|form|login|signup|newsletter|subscribe|search|share|sharing|"
    r"social|related|recommend(?:ed|ations)?|comments?|disqus|replies|reply|responses|discussion|pagination|pager|toolbar|skip|copyright)(?:$|[-_\s\d])",
    re.I,
)
_SPACE = re.compile(r"\s+")
_P_ENDS = _BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)), F.lit(""))


#: inside an article these are text whatever parts their class name has; only a whole name that is one of the words takes them out
_TEXT_TAGS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "b", "i", "em", "strong", "span", "a", "blockquote", "pre", "code", "td", "th", "dd", "dt", "q", "cite", "small", "sub", "sup", "mark", "u"}
_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"}
_CLOSE_WITHIN = {"p", "b", "i", "a", "span", "em", "strong", "li"}
_HOLD_CLOSE = {"article", "main", "body", "td", "nav", "aside", "footer"}
_HOLD_P = {"article", "main", "body", "div", "td", "th", "li", "section", "blockquote", "button"}


def nodes(page: str) -> list[tuple[int, str | None, bool, int, bool]]:
    """Tokens of a page in order: (hash of the path, text or None for a tag, out, block, main).

    out: inside something that is not the article; main: inside the page's main container.
    """
    out: list[tuple[int, str | None, bool, int, bool]] = []
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
    opened: Counter = Counter()
    block, at, n = 0, 0, len(page)

    def put(raw: str) -> None:
        if raw:
            _, path, bad, main = stack[-1]
            out.append((path, html.unescape(raw), bad, block, main))

    def drop(k: int) -> None:
        for entry in stack[k:]:
            opened[entry[0]] -= 1
        del stack[k:]

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if name in _BLOCK:
            block += 1
        if m.group(1):
            if opened[name]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        drop(k)
                        break
                    if name in _CLOSE_WITHIN and stack[k][0] in _HOLD_CLOSE:
                        break
            continue
        attrs = m.group(3) or ""
        label, main, bad = name, stack[-1][3] or name in ("article", "main"), stack[-1][2] or name in _OUT_TAGS
        if attrs:
            for a in _ATTR.finditer(attrs):
                key, value = a.group(1).lower(), (a.group(2) or a.group(3) or a.group(4) or "").strip()
                if key in ("class", "id"):
                    if key == "class":
                        label += "." + ".".join(sorted(value.split()))
                    if name in ("html", "body", "article", "main"):
                        continue
                    if main and name in _TEXT_TAGS:
                        bad = bad or any(_OUT_WORDS.fullmatch(x) for x in value.split())
                    elif _OUT_WORDS.search(value):
                        bad = True
                elif key == "role" and value.lower() in _OUT_ROLES:
                    bad = True
                elif key == "role" and value.lower() == "main":
                    main = True
                elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                    bad = True
        if name == "header" and not (opened["article"] or opened["main"]):
            bad = True
        if name in _RAW:
            end = re.compile(rf"</{name}\s*>?", re.I).search(page, at)
            out.append((_key(str(stack[-1][1]), name), None, bad, block, main))
            at = end.end() if end else n
            continue
        if opened["p"] and (name in _P_ENDS or name in ("tr", "td", "th")):  # an open paragraph ends, with what is open in it
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    drop(k)
                    break
                if stack[k][0] in _HOLD_P:
                    break
        if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == name:
            drop(len(stack) - 1)
        path = _key(str(stack[-1][1]), label)
        out.append((path, None, bad, block, main))
        if name in _VOID or attrs.rstrip().endswith("/"):
            if name in ("br", "hr", "img"):
                out.append((stack[-1][1], " ", stack[-1][2], block, stack[-1][3]))
            continue
        stack.append((name, path, bad, main))
        opened[name] += 1
    return out


def _key(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "replace")) - 2**63


PAGE = _key("page")  # the token that every page has once


def _plain(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def _token(path: int, text: str | None) -> int:
    """The token of a node: of its path, and of its text if it has one."""
    return path if text is None else _key("text", str(path), text)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html, uid) -> host, token, fingerprint of its occurrence vector, pages, sum of places, bits of the articles."""
    seen: dict[tuple[str, int], list[int]] = {}
    names = ["host", "token", "vector", "pages", "places", *(f"b{k}" for k in range(BITS // 64))]

    def signed(x: int) -> int:
        x &= 2**64 - 1
        return x - 2**64 if x >= 2**63 else x

    def flush() -> pa.RecordBatch:
        keys, vals = list(seen), list(seen.values())
        seen.clear()
        cols = [pa.array([signed(v[i]) for v in vals], pa.int64()) for i in range(3)] + [pa.array([signed(v[3] >> (64 * k)) for v in vals], pa.int64()) for k in range(BITS // 64)]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *cols], names=names)

    for b in batches:
        for host, page, uid in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            article = xxhash.xxh64()
            counts: dict[int, list[int]] = {PAGE: [1, 0]}
            for i, (path, text, bad, _, main) in enumerate(nodes(page.as_py() or "")):
                if text is not None:
                    text = _plain(text)
                    if not text:
                        continue
                    if main or not bad:
                        article.update(text.encode("utf-8", "replace"))
                counts.setdefault(_token(path, text), [0, i])[0] += 1
            bit = 1 << (article.intdigest() % BITS)
            for token, (n, place) in counts.items():
                h = xxhash.xxh64_intdigest(f"{uid}:{n}")
                v = seen.get((host, token))
                if v is None:
                    seen[host, token] = [h, 1, place, bit]
                else:
                    v[0] += h
                    v[1] += 1
                    v[2] += place
                    v[3] |= bit
            if len(seen) > 100_000:
                yield flush()
    yield flush()


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, support: float = SUPPORT) -> DataFrame:
    """host, tokens: of each host the tokens of its valid classes in order. pages: host, html, uid."""
    words = [f"b{k}" for k in range(BITS // 64)]
    got = pages.select("host", "html", "uid").mapInArrow(_vectors, "host string, token long, vector long, pages long, places long, " + ", ".join(f"{w} long" for w in words))
    # the sum is modulo 2^64: its low and high halves are added apart
    low = F.sum(F.col("vector").bitwiseAND(F.lit(2**32 - 1)))
    high = F.sum(F.shiftrightunsigned("vector", 32))
    vector = F.shiftleft((high + F.shiftright(low, 32)).bitwiseAND(F.lit(2**32 - 1)), 32).bitwiseOR(low.bitwiseAND(F.lit(2**32 - 1)))
    got = got.groupBy("host", "token").agg(vector.alias("vector"), F.sum("pages").alias("pages"), F.sum("places").alias("places"), *[F.expr(f"bit_or({w})").alias(w) for w in words])
    articles = sum((F.bit_count(w) for w in words), F.lit(0))
    got = saved(got.where("pages >= 2").select("host", "token", "vector", "pages", (F.col("places") / F.col("pages")).alias("place"), articles.alias("articles")), "tokens")
    size = got.where(F.col("token") == PAGE).select("host", F.col("pages").alias("n"), F.col("articles").alias("k"))
    classes = got.groupBy("host", "vector").agg(F.max("pages").alias("support"), F.min("articles").alias("spread"))
    fit = (F.col("k") >= min_pages) & (F.col("support") >= support * F.col("n")) & (F.col("spread") >= support * F.col("k"))
    valid = classes.join(size, "host").where(fit).select("host", "vector")
    inside = got.where(F.col("token") != PAGE).join(valid, ["host", "vector"])
    root = got.where(F.col("token") == PAGE).select("host", F.col("vector").alias("root"))
    inside = saved(inside.join(root, "host").select("host", "token", "place", (F.col("vector") == F.col("root")).alias("root")), "classes")
    # tokens on nearly all pages of a host: few more than a page has
    listed = lambda df: df.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "token", "root"))).alias("t"))
    asked = listed(inside).select("host", F.expr("transform(t, x -> x.token)").alias("tokens"), F.expr("transform(t, x -> x.root)").alias("roots"))
    seen = pages.select("host", "html").join(asked, "host").mapInArrow(_places, "host string, token long, before long, after long, n long, ordered long")
    seen = saved(seen.groupBy("host", "token", "before", "after").agg(F.sum("n").alias("n"), F.sum("ordered").alias("ordered")), "places")
    judged = seen.groupBy("host", "token").agg(F.sum("n").alias("n"), F.sum("ordered").alias("ordered"))
    for side in ("before", "after"):  # a neighbour may itself change places, so one of the two has to stay
        judged = judged.join(seen.groupBy("host", "token", side).agg(F.sum("ordered").alias(side + "_n")).groupBy("host", "token").agg(F.max(side + "_n").alias(side)), ["host", "token"])
    judged = inside.join(judged, ["host", "token"])
    kept = judged.where(F.col("ordered") >= support * F.col("n")).where(F.col("root") | (F.greatest("before", "after") >= support * F.col("ordered")))
    return listed(kept.select("host", "place", "token", "root")).select("host", F.expr("transform(t, x -> x.token)").alias("tokens"))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html, tokens, roots) -> host, token, the tokens of the class on all pages that come before and after it, pages, pages in order."""
    seen: Counter = Counter()
    last: tuple[str | None, dict[int, int], set[int]] = (None, {}, set())

    def flush() -> pa.RecordBatch:
        keys, n = list(seen), list(seen.values())
        seen.clear()
        ordered = [x * k[4] for k, x in zip(keys, n, strict=True)]
        cols = [pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (1, 2, 3)), pa.array(n, pa.int64()), pa.array(ordered, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["host", "token", "before", "after", "n", "ordered"])

    for b in batches:
        for i in range(b.num_rows):
            host = b.column(0)[i].as_py()
            if host != last[0]:
                tokens = b.column(2)[i].as_py()
                last = (host, {t: k for k, t in enumerate(tokens)}, {t for t, x in zip(tokens, b.column(3)[i].as_py(), strict=True) if x})
            _, rank, root = last
            first = list(dict.fromkeys(t for path, text, *_ in nodes(b.column(1)[i].as_py() or "") if (t := path if text is None else _token(path, _plain(text))) in rank))
            firm = _in_order([t for t in first if t in root], rank)  # the others are judged by the gap they lie in
            edges, at, found = [PAGE, *(t for t in first if t in firm), PAGE], 0, []
            for t in first:
                here = edges[at + 1] == t
                found.append((t, edges[at], edges[at + 1 + here]))
                at += here
            fits = [t for t, lo, hi in found if t in firm or (t not in root and rank.get(lo, -1) < rank[t] < rank.get(hi, len(rank)))]
            kept = _in_order(fits, rank)
            for t, lo, hi in found:
                seen[host, t, lo, hi, t in kept] += 1
        if len(seen) > 100_000:
            yield flush()
    yield flush()


def _in_order(tokens: list[int], rank: dict[int, int]) -> set[int]:
    """The tokens of the template that a page has in the template's order: the longest increasing run of first occurrences."""
    first = list(dict.fromkeys(t for t in tokens if t in rank))
    ends: list[int] = []  # least rank that ends a run of each length, and which token that is
    at: list[int] = []
    before = [-1] * len(first)
    for i, t in enumerate(first):
        k = bisect_left(ends, rank[t])
        if k == len(ends):
            ends.append(rank[t]), at.append(i)
        else:
            ends[k], at[k] = rank[t], i
        before[i] = at[k - 1] if k else -1
    kept: set[int] = set()
    i = at[-1] if at else -1
    while i >= 0:
        kept.add(first[i])
        i = before[i]
    return kept


def main_text(page: str | None, rank: dict[int, int] | None = None) -> str:
    """The article of a page. rank: the place of each token in the template of its host."""
    if not page:
        return ""
    rows = nodes(page)
    tokens = [path if text is None else _token(path, _plain(text)) for path, text, *_ in rows] if rank else []
    template = _in_order(tokens, rank) if rank else set()
    use = [(main, bad) for _, _, bad, _, main in rows]
    if any(main and not bad and text and text.strip() for (main, bad), (_, text, *_) in zip(use, rows, strict=True)):
        keep = [main and not bad for main, bad in use]
    elif template:  # the slot with the most text: what lies between two tags of the template that a page has once
        slot, size, slots, often = 0, Counter(), [], Counter(tokens)
        for token, (_, text, bad, _, _) in zip(tokens, rows, strict=True):
            if text is None:
                slot += token in template and often[token] == 1  # tags that come again are nested in a slot
            elif not bad and token not in template:
                size[slot] += len(text.strip())
            slots.append(slot)
        best = max(size, key=lambda k: (size[k], -k), default=-1)
        keep = [k == best and not bad for k, (_, bad) in zip(slots, use, strict=True)]
    else:
        keep = [not bad for _, bad in use]
    blocks: list[str] = []
    last, parts = -1, []

    def close() -> None:
        s = _plain("".join(parts))
        if s:
            blocks.append(s)
        parts.clear()

    for i, (_, text, _, block, _) in enumerate(rows):
        if text is None:
            continue
        if block != last:
            close()
            last = block
        if keep[i] and not (template and text.strip() and tokens[i] in template):
            parts.append(text)
    close()
    return "\n".join(blocks)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple[str | None, dict[int, int]] = (None, {})
    for b in batches:
        names = b.schema.names
        page, host, tokens = (b.column(names.index(k)) for k in ("html", "host", "tokens"))
        out = []
        for i in range(b.num_rows):
            h = host[i].as_py()
            if h != last[0]:
                last = (h, {t: k for k, t in enumerate(tokens[i].as_py() or ())})
            out.append(main_text(page[i].as_py(), last[1]))
        keep = [names.index("page_id"), names.index("url")]
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(out, pa.string()), pa.array(np.array([len(t) for t in out], np.int64))], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    uid = F.xxhash64("page_id", "url", "html")
    found = saved(templates(rows.where(F.length("html") > 0).withColumn("uid", uid)), "templates")
    joined = rows.join(found, "host", "left").select("page_id", "url", "html", "host", "tokens")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
