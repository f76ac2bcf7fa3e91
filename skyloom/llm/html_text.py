"""Main text of web pages, by page structure and a host suffix array of repeated passages.

A page is cut into blocks. Blocks inside the article are the main text. Menus, headers, footers,
sidebars, notices, adverts, forms and reader comments are known by element, role, or a class or id that
says nothing else, and dropped. A class or id that names such a thing among other words
(``search-result``, ``related-work``) settles nothing: its blocks, like all blocks of a page without an
article, are held against the rest of the host.

For that each page's blocks outside plain article text are laid one after the other as a token stream.
The suffixes of all streams of a host are sorted, and neighbours' common prefixes give the substrings
of ``LEAST`` tokens or more that stand on two or more distinct pages. A block that such runs cover by
``COVERED`` is boilerplate and removed; unique runs stay.

A host may hold a third of all pages, so its array isn't built in one place. Suffixes whose first
``LEAST`` tokens stand on one page only can't take part and leave first. Equal suffixes (to ``DEPTH``
tokens; a longer run is a union of such prefixes) are one entry that knows two of its pages, made
before the shuffle; so a menu on every page of a host is one entry a task. The entries are dealt out
by ranges of their order, and a host of any size spreads over all tasks. A neighbour across the edge of a
range is not seen, which costs an entry no more than the length beyond ``LEAST``, and that is covered
by the suffixes that start there.

Cases: null and empty pages have an empty text; broken markup is read as browsers do, as far as it
matters here (unclosed elements end with their parents, a tag cut off at the end is dropped); equal
pages count as one page; very long pages are read whole, one at a time; ties of suffixes are one
entry; an empty table gives an empty result; further columns are left out. If all blocks of a page
without an article are covered, they stay: a page is never emptied by its copies.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import table, written
from skyloom.llm.url_filter import host

LEAST, DEPTH, COVERED = 5, 10, 0.8
#: Zones of a block, by rank. HINTED: in an article, under a name that may mean boilerplate.
ARTICLE, OPEN, HINTED, DROPPED, SKIPPED = 0, 1, 2, 3, 4

# Elements of HTML by kind.
RAW = frozenset("script style noscript template iframe svg textarea title noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br
    math mrow mi mo mn ms mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle semantics""".split())
BOILERPLATE = frozenset("nav footer aside form button select dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
HINTS = frozenset("""nav navbar navigation menu menus topbar header masthead footer sidebar sidebars aside ad ads adv advert adverts advertisement
    advertising banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification popup modal overlay
    comment comments discussion disqus respond replies share sharing social related recommended breadcrumb breadcrumbs newsletter subscribe
    subscription signup login search widget widgets pagination pager toolbar copyright""".split())
#: Words of class names that say how something is laid out, not what it is.
LAYOUT = frozenset("""area bar block body bottom box col column container content desktop fixed form global grid group header heading holder
    icon icons inner item items large layout left link links list main mobile module outer page panel primary right row secondary section site
    small sticky text title top unit wrap wrapper""".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
LEFT_OPEN = frozenset("nav form menu head header button select dialog".split())
SIBLINGS = {"li": ("li",), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PART = re.compile(r"[A-Za-z]+")


def _boilerplate(name: str, attributes: str) -> int:
    """DROPPED for what is boilerplate, HINTED for what may be, else ARTICLE."""
    if name in BOILERPLATE:
        return DROPPED
    found = ARTICLE
    if not attributes or attributes.isspace():
        return found
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return DROPPED
        if key in ("class", "id") and name not in ("html", "body", "main"):
            for own in value.split():
                of = _PART.findall(own)
                if name == "article":  # an article may say what it has; only a comment is none
                    of = of[:1]
                if not of or of[0] in ("no", "not", "has", "with", "without") or HINTS.isdisjoint(of):
                    continue
                if all(x in HINTS or x in LAYOUT for x in of):
                    return DROPPED
                found = HINTED
    return found


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, zone) of a page's blocks, in page order."""
    page = page or ""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = [("", OPEN)]
    parts: list[str] = []
    block = [OPEN]

    def say(text: str) -> None:
        zone = stack[-1][1]
        if zone != SKIPPED:
            if not parts:
                block[0] = zone
            parts.append(html.unescape(text))

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append((text, block[0]))

    def end(name: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                del stack[k:]
                return

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        m = _TAG.match(page, lt) if lt >= 0 else None
        if m is None:  # no mark, or a plain "<"
            stop = n if lt < 0 else lt + 1
            say(page[at:stop])
            at = stop
            continue
        if lt > at:
            say(page[at:lt])
        at = m.end()
        if not m[2]:
            continue
        if page[at - 1] != ">":  # cut off at the end of the page
            break
        closing, name, attributes = m[1], m[2].lower(), m[3]
        if name not in INLINE:
            flush()
        if name in VOID:
            if name == "br":
                say(" ")
            continue
        if closing:
            end(name)
            continue
        if name in RAW:
            over = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = n if over is None else (page.find(">", over.start()) + 1 or n)
            continue
        if name in CLOSES_P and any(x == "p" for x, _ in stack):
            end("p")
        siblings = SIBLINGS.get(name)
        if siblings and stack[-1][0] in siblings:
            stack.pop()
        own = _boilerplate(name, attributes)
        if name in INLINE:
            if own == DROPPED:
                stack.append((name, SKIPPED))
            continue
        if name in ("article", "main", "body") and own != DROPPED:
            # these can't stand in a menu or form: it was left open
            first = next((k for k, (_, z) in enumerate(stack) if z == DROPPED), None)
            if first is not None and stack[first][0] in LEFT_OPEN:
                del stack[first:]
        zone = stack[-1][1]
        if own == DROPPED or name == "header":
            zone = max(zone, DROPPED)
        elif own == HINTED and zone == ARTICLE:
            zone = HINTED
        elif name in ("article", "main") and zone == OPEN:
            zone = ARTICLE
        elif name in HEADINGS and stack[-1][0] == "header" and any(z in (ARTICLE, HINTED) for _, z in stack):
            zone = ARTICLE  # an article's title
        stack.append((name, zone))
    flush()
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("text", pa.string()), ("zone", pa.int8())]))
    for batch in batches:
        keys, found = [], []
        for name, page in zip(batch.column("host"), batch.column("html")):
            page = page.as_py()
            keys.append(xxhash.xxh3_64_intdigest(f"{name.as_py()}\n{page or ''}".encode("utf-8", "surrogatepass")) - 2**63)
            found.append([{"text": t, "zone": z} for t, z in blocks(page)])
        columns = [batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(keys, pa.int64()), pa.array(found, kind)]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "page", "blocks"])


def stream(own: list[tuple[str, int]]) -> tuple[list[str], list[int]]:
    """The tokens of a page's blocks outside plain article text, and the block of each."""
    tokens, of = [], []
    for k, (text, zone) in enumerate(own):
        if zone != ARTICLE:
            words = text.split()
            tokens += words
            of += [k] * len(words)
    return tokens, of


def _name(host_: str, words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\n".join([host_, *words]).encode("utf-8", "surrogatepass")) - 2**63


def _streams(batch: pa.RecordBatch) -> Iterator[tuple[str, int, list[str], list[int]]]:
    for name, page, own in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "blocks"))):
        tokens, of = stream([(b["text"], b["zone"]) for b in own])
        yield name, page, tokens, of


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (start, page): the first ``LEAST`` tokens of each suffix, by name."""
    for batch in batches:
        starts, pages = [], []
        for name, page, tokens, _ in _streams(batch):
            own = {_name(name, tokens[k : k + LEAST]) for k in range(len(tokens) - LEAST + 1)}
            starts += own
            pages += [page] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(pages, pa.int64())], names=["start", "page"])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (start, page, host, at, suffix): one for each token that starts a suffix, cut at ``DEPTH`` tokens."""
    for batch in batches:
        rows = []
        for name, page, tokens, _ in _streams(batch):
            rows += [(_name(name, tokens[k : k + LEAST]), page, name, k, " ".join(tokens[k : k + DEPTH])) for k in range(len(tokens) - LEAST + 1)]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 5, kinds)], names=["start", "page", "host", "at", "suffix"])


def common(x: list[str], y: list[str]) -> int:
    """How many first tokens two suffixes share."""
    n = 0
    for a, b in zip(x, y):
        if a != b:
            break
        n += 1
    return n


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted entries (host, suffix, lo, hi: its least and greatest page): (host, suffix, run), the longest repeat that starts so.

    An entry on two pages repeats as a whole; else it shares a run with the entries next to it that
    stand on another page. Neighbours on its own page are passed over, for which the run so far is kept.
    """
    last = None  # host, tokens, lo, hi
    waiting: list[list] = []  # entries since the last change of page: [host, suffix, tokens, run]
    ready: list[list] = []

    def rows(own: list[list]) -> pa.RecordBatch:
        columns = list(zip(*((h, s, r) for h, s, _, r in own))) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int32()))], names=["host", "suffix", "run"])

    for batch in batches:
        for name, suffix, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("host", "suffix", "lo", "hi"))):
            tokens = suffix.split(" ")
            run = len(tokens) if lo != hi else LEAST
            if last is not None and last[0] != name:
                ready += waiting
                waiting = []
            elif last is not None and last[2:] != (lo, hi):
                for w in reversed(waiting):  # those further back share ever less
                    n = common(w[2], tokens)
                    if n <= LEAST:
                        break
                    w[3] = max(w[3], n)
                run = max(run, common(last[1], tokens))
                ready += waiting
                waiting = []
            elif waiting:
                run = max(run, min(waiting[-1][3], common(waiting[-1][2], tokens)))
            waiting.append([name, suffix, tokens, run])
            last = (name, tokens, lo, hi)
        yield rows(ready)
        ready = []
    yield rows(waiting)


def repeated(parsed: DataFrame) -> DataFrame:
    """The suffix array of all hosts: ``(host, suffix, run)`` of the suffixes that begin with a repeated run."""
    rows = parsed.select("host", "page", "blocks")
    # min and max are combined before the shuffle, so a menu on every page of a host is a row a task
    starts = rows.mapInArrow(_starts, "start long, page long").groupBy("start").agg(F.min("page").alias("lo"), F.max("page").alias("hi")).where("lo <> hi").select("start")
    starts = written(starts, "starts")  # its size is known now and decides the join
    suffixes = rows.mapInArrow(_suffixes, "start long, page long, host string, at int, suffix string").join(starts, "start", "left_semi")
    entries = suffixes.groupBy("host", "suffix").agg(F.min("page").alias("lo"), F.max("page").alias("hi"))
    ordered = entries.repartitionByRange("host", "suffix").sortWithinPartitions("host", "suffix")
    return ordered.mapInArrow(_neighbours, "host string, suffix string, run int")


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page, gone): the blocks that repeated runs cover. In: host, page, blocks, runs (at, run)."""
    for batch in batches:
        pages, gone = [], []
        for (_, page, tokens, of), runs in zip(_streams(batch), batch.column("runs").to_pylist()):
            cover = [0] * (len(tokens) + 1)
            for r in runs:
                cover[r["at"]] += 1
                cover[min(len(tokens), r["at"] + r["run"])] -= 1
            size: dict[int, list[int]] = {}
            depth = 0
            for k, block in enumerate(of):
                depth += cover[k]
                own = size.setdefault(block, [0, 0])
                own[0] += 1
                own[1] += depth > 0
            pages.append(page)
            gone.append([k for k, (n, c) in size.items() if c >= COVERED * n])
        yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["page", "gone"])


def covered(parsed: DataFrame, undecided: DataFrame) -> DataFrame:
    """``(page, gone)`` for pages of ``undecided``: the blocks that runs repeated on their host cover."""
    array = written(repeated(parsed), "suffix-array")
    rows = undecided.dropDuplicates(["page"]).select("host", "page", "blocks")
    own = rows.mapInArrow(_suffixes, "start long, page long, host string, at int, suffix string").join(array, ["host", "suffix"])
    runs = own.groupBy("page").agg(F.collect_list(F.struct("at", "run")).alias("runs"))  # at most the tokens of one page
    return rows.join(runs, "page").mapInArrow(_covered, "page long, gone array<int>")


def extracted(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each page."""
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), "html")
    parsed = written(rows.mapInArrow(_parse, "page_id long, url string, host string, page long, blocks array<struct<text:string,zone:tinyint>>"), "blocks")
    joined = lambda chosen: F.array_join(F.transform(chosen, lambda b: b["text"]), "\n")
    inside = F.exists("blocks", lambda b: b["zone"] == ARTICLE)
    open_ = F.exists("blocks", lambda b: b["zone"].isin(OPEN, HINTED))
    asks = F.exists("blocks", lambda b: b["zone"] == HINTED) | (~inside & open_)
    # pages whose structure settles all blocks don't wait for the array, but their streams are in it
    clear = parsed.where(~asks).select("page_id", "url", joined(F.filter("blocks", lambda b: b["zone"] == ARTICLE)).alias("text"))
    other = parsed.where(asks)
    gone = covered(parsed, other)
    numbered = F.transform("blocks", lambda b, i: F.struct(b["text"].alias("text"), b["zone"].alias("zone"), i.alias("i")))
    other = other.join(gone, "page", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>"))).select("page_id", "url", "gone", inside.alias("inside"), numbered.alias("numbered"))
    unique = lambda b: ~F.array_contains("gone", b["i"])
    article = F.filter("numbered", lambda b: (b["zone"] == ARTICLE) | ((b["zone"] == HINTED) & unique(b)))
    free = F.filter("numbered", lambda b: b["zone"].isin(OPEN, HINTED))
    own = F.filter(free, unique)
    text = F.when(F.col("inside"), joined(article)).when(F.size(own) > 0, joined(own)).otherwise(joined(free))
    return clear.unionByName(other.select("page_id", "url", text.alias("text"))).withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
