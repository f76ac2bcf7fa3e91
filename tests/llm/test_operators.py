"""Each corpus operator against brute force on small tables, with nulls, ties, repeats, long and empty texts."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyloom.llm import chat_format, decontaminate, html_text, ngram_join, packing, quality_classifier, quality_rules, queries, secret_scan, sharding, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, blob string, component long, rank string"


def documents(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), "clash", 7, "x") for k, t in enumerate(texts)], DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts(small):
    own = [r[0] for r in duckdb.sql(f"select text from '{small}/documents.parquet' order by doc_id").fetchall()]
    return own + [None, "", " \t\n ", "one", "one two", own[3], own[3], "é" * 3000 + " token=abcdef1 " + "x y z " * 5000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return documents(spark, texts).repartition(3).cache()


def test_names():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 11)]


# 1


def test_chat_matches_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{small}/conversations.parquet'")
    rel = con.execute(chat_format.SQL)
    names = [x[0] for x in rel.description]
    got = {tuple(r) for r in chat_format.query(spark, small).select(*names).collect()}
    assert got == set(rel.fetchall())


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>\n", "<\\|", "<\\\\|", "<", "|>", "<|turn|>", "a<\nb", None, "", "<\\n", "\\", "<|im_start|>user\nhi"]
    rng = random.Random(1)
    rows = [(c, k, rng.choice(["user", "assistant", "sys\ntem", None, "<|x"]), rng.choice(nasty), "extra") for c in range(40) for k in range(rng.randrange(1, 9))]
    rows += [(99, None, "user", "null turn", "e"), (99, 1, "user", "tie", "e"), (99, 1, "user", "tie", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    want = defaultdict(list)
    for c, k, r, t, _ in sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want[c].append((r or "", t or ""))
    for r in chat_format.read_back(chat_format.formatted(df)).collect():
        assert [tuple(t) for t in r["turns"]] == want[r["conv_id"]]
        assert list(r["loss_texts"]) == [t for role, t in want[r["conv_id"]] if role == "assistant"]
        assert r["formatted_chars"] == len(r["formatted"])
    assert chat_format.formatted(df.where("false")).count() == 0


# 2


def test_encoder_equals_the_tokenizer(texts):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.tokenizer_path())
    own = packing.Encoder(packing.tokenizer_path())
    odd = ["a <|endoftext|> b", "漢字 かな", "\u00a0\u2003x", "𝒳y 1²3", "it's  'LL  ", "\x00\x1f"]
    for t in [x or "" for x in texts[:60]] + odd:
        assert own(t).tolist() == [*exact.encode(t, add_special_tokens=False).ids, 1]


def check_packed(rows, ids_of):
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for d, ids in ids_of.items():
        at = 0
        for r in sorted(by[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    waste = total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        total += at
        waste += 0 if at & (at - 1) == 0 else 2048 - at
    return waste / total


def test_packing(docs, texts):
    encode = packing.Encoder(packing.tokenizer_path())
    waste = check_packed(packing.pack(docs).collect(), {k: encode(t) for k, t in enumerate(texts)})
    assert waste < 0.03
    assert packing.pack(docs.where("false")).count() == 0


def test_packed_sequences_hold_the_ids(docs):
    pieces = packing.pack(docs.where("doc_id < 40"), with_ids=True).cache()
    of = {r["sequence_id"]: r for r in packing.sequences(pieces).collect()}
    for r in pieces.collect():
        assert of[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert all(len(r["ids"]) == 2048 or len(r["ids"]) & (len(r["ids"]) - 1) == 0 for r in of.values())


def test_linear_program_reaches_a_known_optimum():
    demand = np.zeros(101, np.int64)
    demand[[45, 36, 31, 14]] = 97, 610, 395, 211  # a textbook case: 452.25 rolls
    assert abs(sum(x for _, x in packing.linear_program(demand, 100)) - 452.25) < 0.5
    made = packing.plan({45: 97, 36: 610, 31: 395, 14: 211}, 100)
    assert sum(n for _, n in made) <= 454
    left = Counter()
    for pattern, n in made:
        assert sum(c * k for c, k in pattern.items()) <= 100
        left.update({c: k * n for c, k in pattern.items()})
    assert left == {45: 97, 36: 610, 31: 395, 14: 211}
    assert packing.plan({}, 100) == []


# 3


@pytest.mark.parametrize(("page", "text"), [
    ("<nav>m</nav><article><h1>T &amp; U</h1><p>a<br>b <b>c<p>d &lt;e&gt; 3 < 4</article><footer>f</footer>", "T & U\na b c\nd <e> 3 < 4"),
    ("<div class='content no-sidebar'><p>Hello</p><div class='cookie-notice'>We use</div><p>World <span class=ad>AD</span>here</p></div>", "Hello\nWorld here"),
    ("<nav><li>m<article><p>in</p><div class='comments'><article><p>bad</p></article></div></article>", "in"),
    ("<p title='a>b'>q</p><script>var t='</p>';</script><style>x</style><!-- no -->z<p cla", "q\nz"),
    ("<main><form>f<input></form><p>x&nbsp;&#233;\n y</p><aside>s</aside><div role=navigation>n</div></main>", "x é y"),
    (None, ""), ("", ""), ("<html><body></body></html>", ""),
])
def test_html_blocks(spark, page, text):
    df = spark.createDataFrame([(1, None, page, 3)], "page_id long, url string, html string, blocks int")
    r = html_text.extracted(df).first()
    assert r["text"] == text and r["n_chars"] == len(text)


def test_html_repeated_passages_without_an_article(spark):
    rng = random.Random(2)
    site = "please read our terms and the rules of this site before you write"
    bodies = [prose(rng, 60) for _ in range(6)]
    rows = [(k, f"http://a.example/{k}", f"<div><p>{site}</p><p>{b}</p></div>") for k, b in enumerate(bodies)]
    rows += [(10, "http://b.example/", f"<div><p>{site}</p></div>"), (11, "http://c.example/1", f"<div><p>{bodies[0]}</p></div>"), (12, "http://c.example/1", f"<div><p>{bodies[0]}</p></div>")]
    got = {r["page_id"]: r["text"] for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: b for k, b in enumerate(bodies)} | {10: site, 11: bodies[0], 12: bodies[0]}


@pytest.mark.parametrize(("page", "text"), [
    ("<article><div class='search-result'><p>real body text</p></div><p>rest</p></article>", "real body text\nrest"),
    ("<main><section class='related-work'><p>others did so</p></section></main>", "others did so"),
    ("<div class='social-science'><p>a field of study</p></div>", "a field of study"),
    ("<article><p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p><div class='ad-box'>buy</div><div class=share-buttons>tweet</div></article>", "let x=1 be\ntweet"),
])
def test_names_among_other_words_settle_nothing(spark, page, text):
    assert html_text.extracted(spark.createDataFrame([(1, "http://a.b/", page)], "page_id long, url string, html string")).first()["text"] == text


def test_hinted_blocks_go_where_the_host_repeats_them(spark):
    rng = random.Random(16)
    share = "tell all your friends about this page right now"
    rows = [(k, "http://a.example/", f"<article><p>{prose(rng, 30)}</p><div class='share-buttons'>{share}</div><div class='search-result'>{prose(rng, 9)}</div></article>") for k in range(4)]
    rows.append((9, "http://b.example/", f"<article><p>x</p><div class='share-buttons'>{share}</div></article>"))
    for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert (share in r["text"]) == (r["page_id"] == 9) and len(r["text"].split("\n")) == 2


def made_pages(rng):
    """(host, page, blocks) of small vocabularies, so that runs of any length repeat within and across pages."""
    phrases = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(4, 40))) for _ in range(5)]
    return [(rng.choice("hg"), k, [(" ".join([*(rng.choice("abcdefghij") for _ in range(rng.randrange(0, 9))), rng.choice(phrases), *(rng.choice("abcdefghij") for _ in range(rng.randrange(0, 4)))]), rng.choice([1, 1, 2, 3, 0])) for _ in range(rng.randrange(1, 5))]) for k in range(14)]


def test_suffix_array_equals_brute_force(spark):
    rng = random.Random(17)
    made = made_pages(rng)
    parsed = spark.createDataFrame([(h, p, [{"text": t, "zone": z} for t, z in b]) for h, p, b in made], "host string, page long, blocks array<struct<text:string,zone:tinyint>>")
    streams = {(h, p): html_text.stream(b) for h, p, b in made}
    suffixes = defaultdict(list)
    for (h, p), (tokens, _) in streams.items():
        suffixes[h] += [(tokens[k : k + html_text.DEPTH], p) for k in range(len(tokens) - html_text.LEAST + 1)]
    want = {}
    for h, own in suffixes.items():
        for t, p in own:
            run = max((html_text.common(t, u) for u, q in own if q != p), default=0)
            if run >= html_text.LEAST:
                key = (h, " ".join(t))
                want[key] = max(want.get(key, 0), run)
    got = {(r["host"], r["suffix"]): r["run"] for r in html_text.repeated(parsed.coalesce(1)).collect()}
    assert set(got) == set(want)
    assert all(html_text.LEAST <= got[k] <= want[k] for k in want)  # an edge of a range may cut a run
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert {(r["host"], r["suffix"]): r["run"] for r in html_text.repeated(parsed).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    # the blocks that substrings of LEAST tokens or more on two pages cover, by trying all
    gone = {r["page"]: sorted(r["gone"]) for r in html_text.covered(parsed, parsed).collect()}
    for (h, p), (tokens, of) in streams.items():
        cover = [False] * len(tokens)
        for (g, q), (other, _) in streams.items():
            if g == h and q != p:
                for i in range(len(tokens)):
                    for j in range(len(other)):
                        n = html_text.common(tokens[i:], other[j:])
                        if n >= html_text.LEAST:
                            cover[i : i + n] = [True] * n
        size, hit = Counter(of), Counter(k for k, c in zip(of, cover) if c)
        assert gone.get(p, []) == [k for k in sorted(size) if hit[k] >= html_text.COVERED * size[k]], p


def test_html_pages(spark, small):
    import html as h

    pages = dict(duckdb.sql(f"select page_id, html from '{small}/pages.parquet'").fetchall())
    for r in html_text.query(spark, small).collect():
        own = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.S)[1]
        own = re.sub(r"</?\w+>|</?\w*\Z", "", re.sub(r"</?(p|h1)>", "\n", own.replace("<br>", " ")))
        assert r["text"] == "\n".join(filter(None, (" ".join(h.unescape(x).split()) for x in own.split("\n"))))


# 4


def test_url_rules(spark):
    urls = ["http://A.Example.NET/en/1?x=1", "http://example.net/fr/", "https://example.com/de/x", "x://m.example.com/de", "ftp://foo.org/fr/a#b", "http://foo.org/en/", "http://net", "http://net/", "http://planet/", None, "nothing", "http://x.net?a=/", "a://b://c/d", "http:///p"]
    want = {"http://A.Example.NET/en/1?x=1": ("a.example.net", "/en/1", "example.net/en/", "allow"), "http://example.net/fr/": ("example.net", "/fr/", "net/", "block"),
            "https://example.com/de/x": ("example.com", "/de/x", "example.com/de/", "block"), "x://m.example.com/de": ("m.example.com", "/de", None, "allow"),
            "ftp://foo.org/fr/a#b": ("foo.org", "/fr/a", "org/fr/", "allow"), "http://foo.org/en/": ("foo.org", "/en/", None, "allow"), "http://net": ("net", "", None, "allow"),
            "http://net/": ("net", "/", "net/", "block"), "http://planet/": ("planet", "/", None, "allow"), None: ("", "", None, "allow"), "nothing": ("", "", None, "allow"),
            "http://x.net?a=/": ("x.net", "", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"), "http:///p": ("", "/p", None, "allow")}
    pages = spark.createDataFrame([(k, u, "t") for k, u in enumerate(urls * 2)], "page_id long, url string, rule string")
    rules = url_filter.mined(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = url_filter.judged(pages, rules).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == want[r["url"]], r


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(3)
    urls = [f"http://{rng.choice(['a', 'b', 'spam'])}.com/{rng.choice(['x', 'y'])}/{k}" for k in range(300)]
    labels = [(k, 0 if "spam" in u and "/x/" in u else 1, 0) for k, u in enumerate(urls)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = url_filter.mined(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    own = {tuple(r["rule_tokens"]): r["confidence"] for r in rules.collect()}
    assert own[("h:spam", "p:x")] == 1.0 and ("h:a", "p:x") not in own
    got = {r["page_id"]: r["verdict"] for r in url_filter.judged(pages, rules).collect()}
    sets = {k: set(t) for k, t in pages.select("page_id", url_filter.tokens(F.col("url"))).collect()}
    assert got == {k: "block" if any(set(r) <= sets[k] for r in own) else "allow" for k in sets}


def test_labels_go_to_the_page_that_holds_the_document(spark):
    ends = ("", "/", ".html", "?page=2&ref=x", "#top", "?utm_source=feed")
    urls = [f"http://{'spam' if k % 3 == 0 else 'good'}{'.m' if k % 2 else ''}.com/en/{k}{ends[k % 5]}" for k in range(90)]
    pages = spark.createDataFrame([(89 - k, u) for k, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(90)], "doc_id long, quality int, toxic int")
    rules = url_filter.mined(pages, labels)
    assert {tuple(r["rule_tokens"]): r["confidence"] for r in rules.collect()}[("h:spam",)] == 1.0
    got = {r["url"]: r["verdict"] for r in url_filter.judged(pages, rules).collect()}
    assert got == {u: "block" if "spam" in u else "allow" for u in urls}
    odd = spark.createDataFrame([("http://a.com/7/x",), ("http://a.com/en/x7",), ("http://7.com",), (None,), ("http://a.com/99999999999999999999",), ("http://a.com/3/12.htm?b=4",)], "url string")
    assert [r[0] for r in odd.select(url_filter.held(F.col("url"))).collect()] == [None, None, None, None, None, 12]


def test_rules_of_five_tokens_block(spark):
    five = ("a", "b", "c", "d", "e")
    dealt = [five[:k] + five[k + 1 :] + (f"x{k}",) for k in range(5)]  # each has four of the five
    urls = [f"http://{'.'.join(labels)}/{{}}" for labels in [five] + dealt for _ in range(20)]
    urls = [u.format(k) for k, u in enumerate(urls)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(k, int(k >= 20), 0) for k in range(len(urls))], "doc_id long, quality int, toxic int")
    rules = url_filter.mined(pages, labels)
    kept = {tuple(r["rule_tokens"]) for r in rules.collect()}
    assert tuple(f"h:{x}" for x in five) in kept and min(map(len, kept)) == 5
    got = {r["page_id"]: r["verdict"] for r in url_filter.judged(pages, rules).collect()}
    assert got == {k: "block" if k < 20 else "allow" for k in got}


def brute_rules(rows, support):
    """All rules of token sets by counting every subset of every page's tokens."""
    from itertools import combinations

    n, bad, held = len(rows), sum(b for _, b in rows), defaultdict(lambda: [0, 0])
    for tokens, b in rows:
        for k in range(1, len(tokens) + 1):
            for own in combinations(sorted(tokens), k):
                held[own][0] += 1
                held[own][1] += b
    least = max(url_filter.MIN_SUPPORT, url_filter.MIN_COUNT / n) * n - 1e-9

    def lower(x, y, z=2.575):  # Wilson
        return (y / x + z * z / (2 * x) - z * (y / x * (1 - y / x) / x + z * z / (4 * x * x)) ** 0.5) / (1 + z * z / x)

    return {t: y / x for t, (x, y) in held.items() if y >= least and lower(x, y) >= url_filter.MIN_CONFIDENCE and (y / x) / (bad / n) >= url_filter.MIN_LIFT}


def test_fp_growth_equals_brute_force_with_labels_and_seeds(spark):
    rng = random.Random(12)
    hosts = ["big-casino.example.com", "win-casino.example.com", "a.example.com", "b.example.net", "bad.example.net", "blog.example.org"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de'])}/{k}{rng.choice(['', '?ref=1'])}" for k in range(400)]
    labels = [(k, int(not ("bad." in u and rng.random() < 0.9)), None) for k, u in enumerate(urls) if k % 2]
    pages = spark.createDataFrame([*enumerate(urls), (900, "http://win-big.example.org/en/900"), (901, None)], "page_id long, url string")
    labels_df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = url_filter.mined(pages, labels_df, ("casino",))
    own = {tuple(r["rule_tokens"]): r["confidence"] for r in found.collect()}
    sets = {u: t for u, t in pages.where("url is not null").select("url", url_filter.tokens(F.col("url"))).collect()}
    bad = {k: q == 0 for k, q, _ in labels}
    rows = [(sets[u], 1 if "casino" in u else int(bad[k])) for k, u in enumerate(urls) if "casino" in u or k in bad]
    want = brute_rules(rows, 0)
    assert set(own) == set(want) and all(abs(own[t] - want[t]) < 1e-9 for t in want)
    assert own[("w:win",)] == 1.0 and ("h:example",) not in own
    got = {r["page_id"]: r["verdict"] for r in url_filter.judged(pages, found).collect()}
    assert got[900] == "block"  # neither labelled nor seeded: the mined word blocks it
    assert got == {p: "block" if u and any(set(t) <= set(sets[u]) for t in own) else ("allow" if not u or ".net" not in u else "block" if "/en/" not in u else "allow") for p, u in pages.collect()} | {
        p: v for p, v in got.items() if u_listed(dict(pages.collect())[p])}


def u_listed(url):
    """Whether a listed rule decides the URL."""
    return bool(url) and (".net" in url or ".com/de/" in url)


def test_mined_rules_decide_pages_of_the_table(spark, small):
    big = small.replace("sf0.001", "sf0.1")
    pages, labels = spark.read.parquet(f"{big}/pages.parquet").select("page_id", "url"), spark.read.parquet(f"{big}/labels.parquet")
    rules = url_filter.mined(pages, labels, url_filter.SEEDS)
    rows = url_filter.judged(pages, rules).where("rule is null and verdict = 'block'").collect()
    assert rows and all(re.search("adult|ads|bets|casino|pills|spam", r["host"]) for r in rows)


# 5


def brute_components(texts, width, percent):
    sets = {}
    for d, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[d] = set() if not w else {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in texts}


@pytest.mark.parametrize(("width", "percent", "key_limit"), [(3, 90, 64), (5, 80, 2)])
def test_jaccard_components(spark, docs, texts, monkeypatch, width, percent, key_limit):
    monkeypatch.setattr(ngram_join, "SMALL_KEY", key_limit)
    rng = random.Random(4)
    base = prose(rng, 150)
    more = []
    for _ in range(60):  # copies on both sides of the threshold, as one large group
        w = base.split()
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        more.append(" ".join(w))
    all_ = [*texts[:80], *texts[-8:], *more, "A b C", "a B c", "A B c d"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked(documents(spark, all_), width, percent).collect()}
    assert got == brute_components(dict(enumerate(all_)), width, percent)


def test_edits_bound_holds_for_linked_pairs():
    rng = random.Random(5)
    for _ in range(300):
        pivot = set(range(100))
        near = [pivot ^ {rng.randrange(130) for _ in range(rng.randrange(1, 16))} for _ in range(2)]
        x, y = sorted(near, key=lambda s: len(s ^ pivot))
        both_linked = all(10 * len(s & pivot) >= 9 * len(s | pivot) for s in near)
        if 10 * len(x & y) >= 9 * len(x | y) and not both_linked:
            ex, ey = x ^ pivot, y ^ pivot
            few, many = ngram_join.edit_prefixes(100, len(x), len(ex), 90)[0], ngram_join.edit_prefixes(100, len(y), len(ey), 90)[1]
            order = sorted(ex | ey)
            assert set(sorted(ex, key=order.index)[:few]) & set(sorted(ey, key=order.index)[:many])


@pytest.mark.parametrize("step", [ngram_join._keys, ngram_join._edit_keys])
def test_long_sets_go_through_workers_in_pieces(step):
    """No row or key is lost by the pieces, and memory follows a piece instead of the batch."""
    sets, tokens = 60, 5000
    rng = np.random.default_rng(6)
    token = pa.array(np.tile(rng.integers(-(2**63), 2**63 - 1, tokens, np.int64), sets))
    shared = pa.ListArray.from_arrays(pa.array(np.arange(sets + 1, dtype=np.int32) * tokens), pa.StructArray.from_arrays([pa.array(np.full(sets * tokens, 300, np.int32)), token], ["df", "token"]))
    ids, size = pa.array(np.arange(sets)), pa.array(np.full(sets, tokens, np.int32))
    rows = {"a": ids, "b": ids, "id": ids, "size": size, "size_a": size, "near_n": size, "n": size, "far": pa.array([[]] * sets, pa.list_(pa.int64())), "shared": shared}
    batch = pa.RecordBatch.from_arrays(list(rows.values()), names=list(rows))
    want = pa.Table.from_batches([out for k in range(sets) for out in step(80)(iter([batch.slice(k, 1)]))]).combine_chunks().to_batches()[0]
    done = 0
    tracemalloc.start()
    for out in step(80)(iter([batch])):
        assert out.equals(want.slice(done, out.num_rows))
        done += out.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert done == want.num_rows > 0 and peak < 64 << 20


def test_pieces_hold_all_rows_in_order():
    texts = ["x" * n for n in (0, 3 << 20, 5, 700_000, 700_000, 1)] + [None] * 3 + ["y" * 40_000] * 200
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    pieces = list(ngram_join._pieces(iter([batch.slice(0, 0), batch])))
    assert pa.Table.from_batches(pieces).to_pydict() == batch.to_pydict()
    assert all(p.nbytes <= ngram_join.PIECE_BYTES or p.num_rows == 1 for p in pieces)


def test_jaccard_of_nothing(spark):
    assert ngram_join.linked(documents(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_join.linked(documents(spark, [None, ""])).orderBy("doc_id").collect()] == [(0, 0, 0), (1, 0, 1)]


def test_jaccard_with_repeated_and_null_ids(spark, monkeypatch):
    """Ids that stand at several texts: rows are documents by themselves, and no link of any text is lost."""
    monkeypatch.setattr(ngram_join, "SMALL_KEY", 3)
    rng = random.Random(13)
    bases = [prose(rng, 120, 5000) for _ in range(6)]

    def near(t):
        w = t.split()
        w[rng.randrange(len(w))] = "edited"
        return " ".join(w)

    rows = [(5, bases[0]), (5, bases[1]), (3, bases[0]), (7, near(bases[1])), (5, near(bases[2])), (9, bases[2]), (None, bases[3]), (None, near(bases[3])), (None, bases[4]), (4, near(bases[4])), (5, bases[1]), (8, None), (8, None), (None, "")]
    rows += [(20 + k % 3, near(bases[5])) for k in range(12)]
    got = ngram_join._grouped(spark.createDataFrame(rows, "id long, text string"), 3, 90).collect()
    whole = brute_components({k: t for k, (_, t) in enumerate(rows)}, 3, 90)
    groups = defaultdict(list)
    for k, (_, c) in whole.items():
        groups[c].append(k)
    want = []
    for own in groups.values():
        ids = [rows[k][0] for k in own if rows[k][0] is not None]
        want += [(rows[k][0], whole[k][0], min(ids, default=None)) for k in own]
    assert sorted(((r["doc_id"], r["size"], r["component_id"]) for r in got), key=repr) == sorted(want, key=repr)


def test_near_copies_leave_one_row_of_each_group(spark):
    rng = random.Random(14)
    a, b, c = (prose(rng, 80, 3000) for _ in range(3))
    rows = [(5, a, "x"), (5, b, "y"), (3, a, "z"), (6, b, "w"), (6, c, "v"), (6, c, "v"), (None, c, "n"), (None, None, "e"), (1, "", "e"), (1, "", "e")]
    out = ngram_join.stage(spark, spark.createDataFrame(rows, "doc_id int, text string, `group` string"), "").collect()
    assert sorted(map(tuple, out), key=repr) == sorted([(5, b, "y"), (3, a, "z"), (6, c, "v"), (None, None, "e"), (1, "", "e"), (1, "", "e")], key=repr)


# 6


def test_shard_store(spark, tmp_path, docs, texts):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), 1 << 20)
    assert store.read().count() == 0 and store.version() == 0
    for k in range(6):
        store.append(docs.where(F.col("doc_id") % 6 == k))
    before = store.manifest()
    store.compact()
    after = store.manifest()
    assert after["version"] > before["version"] and len(after["shards"]) < len(before["shards"])
    assert sorted(store.read().select("doc_id", "text").collect(), key=repr) == sorted(docs.select("doc_id", "text").collect(), key=repr)
    assert store.read(before["version"]).count() == len(texts)
    assert store.vacuum() > 0 and store.read().count() == len(texts)
    with pytest.raises(RuntimeError):
        store.commit(before, [], set(), None)  # a version that another writer took
    store.append(docs.where("false"))
    assert store.read().count() == len(texts)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_dead_writers_block_nothing(spark, tmp_path, monkeypatch):
    store = sharding.ShardStore(spark, str(tmp_path / "s"))
    store.append(spark.range(3).toDF("a"))
    folder = store._begin()  # dies while it writes
    spark.range(9).toDF("a").write.parquet(f"{store.path}/{folder}")
    store._write("draft-dead", {"version": 2})  # dies before it publishes
    store.append(spark.range(3, 5).toDF("a"))
    assert store.version() == 2 and store.read().count() == 5
    assert store.vacuum() == 0  # the first writer may be alive
    monkeypatch.setattr(sharding, "LEASE", -1)
    assert store.vacuum() > 0 and store.read().count() == 5


def test_vacuum_spares_running_appends_and_kept_versions(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), 1 << 20)
    for k in range(4):
        store.append(spark.range(k, k + 1).toDF("a"))
    before = store.version()
    folder = store._begin()
    spark.range(100, 102).toDF("a").write.parquet(f"{store.path}/{folder}")
    store.compact()
    assert store.vacuum(keep=2) == 0 and store.read(before).count() == 4
    assert store.vacuum() > 0 and rows_of(store.read()) == [(k,) for k in range(4)]
    store._add(store.manifest(), folder, before and store.manifest()["schema"])
    store._end(folder)
    assert store.read().count() == 6


def test_two_writers_of_one_version(spark, tmp_path):
    one, two = (sharding.ShardStore(spark, str(tmp_path / "s")) for _ in range(2))
    one.append(spark.range(2).toDF("a"))
    base = two.manifest()
    one.append(spark.range(2).toDF("a"))
    with pytest.raises(RuntimeError):
        two.commit(base, [], set(), None)
    assert one.read().count() == 4


def test_pages_of_a_manifest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "PAGE", 3)
    store = sharding.ShardStore(spark, str(tmp_path / "s"), 1 << 20)
    for k in range(5):
        store.append(spark.range(10 * k, 10 * k + 2).coalesce(1).toDF("a"))
    m = store.manifest()
    assert len(m["pages"]) == 2 and len(m["shards"]) == 5
    store.compact()
    assert len(store.manifest()["shards"]) == 1 and store.read().count() == 10


def test_arrivals_with_any_column_names(spark, tmp_path):
    df = spark.createDataFrame([(k, f"t{k}", None if k % 2 else k) for k in range(40)], "a long, SHARD_bin string, shard_bin_ long")
    store = sharding.ShardStore(spark, str(tmp_path / "s"), 1 << 20)
    store.append_split(df, F.col("a") % 5, 5)
    store.compact()
    assert store.read().columns == df.columns and rows_of(store.read()) == rows_of(df)


def test_sharding_query_returns_every_document(spark, small):
    want = sorted((d, len(t or ""), zlib.crc32((t or "").encode())) for d, t in duckdb.sql(f"select doc_id, text from '{small}/documents.parquet'").fetchall())
    assert sorted(tuple(r)[:3] for r in sharding.query(spark, small).collect()) == want


# 7


def test_tiling_finds_reordered_passages():
    item = list(range(40))
    text = [100, *item[20:], 101, 102, *item[:20], 103]
    tiles = decontaminate.tiling(item, text)
    assert sorted(t[2] for t in tiles) == [20, 20]
    assert decontaminate.tiling(item, [500] * 50) == [] and decontaminate.tiling([], []) == []


def plain_tiling(item, text, least):  # greedy string tiling, word by word
    a, b, out = [False] * len(item), [False] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                best = max(best, (k, -j, -i))
        k, j, i = best[0], -best[1], -best[2]
        if k < least:
            return out
        a[i : i + k], b[j : j + k] = [True] * k, [True] * k
        out += k


def test_tiling_covers_as_much_as_brute_force():
    rng = random.Random(6)

    for _ in range(60):
        item = [rng.randrange(6) for _ in range(30)]
        text = [rng.randrange(6) for _ in range(40)]
        at = rng.randrange(20)
        text[5:17] = item[at : at + 12]
        tiles = decontaminate.tiling(item, text, 4)
        assert all(item[i : i + k] == text[t : t + k] and k >= 4 for t, i, k in tiles)
        used = [x for t, _, k in tiles for x in range(t, t + k)]
        assert len(used) == len(set(used))
        assert sum(k for *_, k in tiles) == plain_tiling(item, text, 4)


def test_tiling_of_repeated_words_is_quick():
    import time

    began = time.time()
    assert decontaminate.tiling([1] * 200, [1] * 20_000) == [(0, 0, 200)]
    text = ([1] * 7 + [2]) * 2500
    tiles = decontaminate.tiling([1, 2] * 50 + [1] * 100, text)
    assert tiles and time.time() - began < 2


def test_words_of_scripts_without_spaces():
    words = decontaminate._WORD.findall
    assert words("don't 漢字かな 12_a ไทย") == ["don", "t", "漢", "字", "か", "な", "12_a", "ไ", "ท", "ย"]


@pytest.mark.parametrize("sent", [10**6, 0])
def test_leaks_equal_brute_force(spark, monkeypatch, sent):
    """Short items, items of scripts without spaces, repeated and null ids, and a phrase that most items have."""
    monkeypatch.setattr(decontaminate, "SEEDS", sent)
    rng = random.Random(15)
    phrase = "answer the following question with care and"
    items = [f"{phrase} {prose(rng, rng.randrange(3, 40), 300)}" for _ in range(25)] + ["漢字" * 9 + "".join(chr(0x4E00 + k) for k in range(30)), "just three words", "one", "", None, "just three words"]
    texts = []
    for k, t in enumerate(items):
        w = (t or "").split()
        cut = rng.randrange(len(w) + 1)
        texts += [f"{prose(rng, 60, 300)} {' '.join(w[cut:] + ['x'] + w[:cut])} {prose(rng, 30, 300)}", f"{phrase} {prose(rng, 40, 300)}", " ".join(w[: len(w) // 3])]
    texts += [None, "", "see " + items[25][4:30] + " ok", "These are JUST three, words!"]
    ids = [rng.choice([None, 1, 2, k]) for k in range(len(texts))]
    bench = spark.createDataFrame([(k % 20, t) for k, t in enumerate(items)], "item_id int, text string")
    got = Counter((r["doc_id"], r["item_id"], r["item_words"], r["covered_words"]) for r in decontaminate.leaks(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"), bench).collect())
    want = Counter()
    number = {}
    coded = lambda t: [number.setdefault(w, len(number)) for w in decontaminate._WORD.findall((t or "").lower())]
    for k, t in enumerate(items):
        own = coded(t)
        for d, text in zip(ids, texts):
            covered = plain_tiling(own, coded(text), min(5, len(own))) if own else 0
            if own and covered >= 0.5 * len(own):
                want[(d, k % 20, len(own), covered)] += 1
    assert got == want


def test_decontaminated_stage_drops_rows(spark, small):
    item = duckdb.sql(f"select text from '{small}/benchmark.parquet' limit 1").fetchall()[0][0]
    rows = [(1, item, "a"), (1, "clean words here", "b"), (None, item, "c"), (None, None, "d"), (2, None, "e"), (1, "clean words here", "b")]
    out = decontaminate.stage(spark, spark.createDataFrame(rows, "doc_id int, text string, words string"), small).collect()
    assert sorted(map(tuple, out), key=repr) == sorted([(1, "clean words here", "b"), (None, None, "d"), (2, None, "e"), (1, "clean words here", "b")], key=repr)


def test_leaks(spark):
    rng = random.Random(7)
    items = [prose(rng, 40, 5000) for _ in range(5)]
    w = items[0].split()
    rows = [items[0], "x " + items[1].upper().replace(" ", ", ") + " y", " ".join(w[20:] + ["q"] + w[:20]), " ".join(w[:8]) + " " + prose(rng, 300, 5000), None, "", prose(rng, 500, 5000), items[2] + " " + items[3]]
    bench = spark.createDataFrame([*enumerate(items), (7, None), (8, "too short")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(documents(spark, rows), bench).collect())
    assert got == [(0, 0), (1, 1), (2, 0), (7, 2), (7, 3)]
    assert decontaminate.leaks(documents(spark, rows), bench.where("false")).count() == 0
    assert decontaminate.leaks(documents(spark, []), bench).count() == 0


# 8


def brute_spans(t):
    out = []
    for order, (kind, pattern, least, group) in enumerate((("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2), ("access", r"AKIA[A-Z0-9]+", 20, 0), ("hex", r"[0-9a-f]+", 24, 0))):
        out += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, t, re.ASCII) if len(m[group]) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


SECRETS = ["Token: abcdef", "token=abc password = 'hunter22'", "AKIA" + "A1" * 10, "AKIA1 AKIA", "ſecret=abcdefgh", "é secret=abcdefgh", "0" * 30 + "g" + "f" * 23, "api_key=\"a.b/c+d=\" apikey:zzzzzz APIKEY=QQQQQQ", "token=secret=abcdef", "ghp_" + "a" * 40, "https://me:pass@host/"]


def test_secret_spans(spark, texts):
    all_ = [*texts, *SECRETS, *SECRETS]
    docs = documents(spark, all_)
    ledger = secret_scan.scan(docs)
    rows = secret_scan.findings(docs, ledger).select("doc_id", "blob", secret_scan.joined(F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))).alias("s")).collect()
    assert len(rows) == len(all_)
    for r in rows:
        assert r["s"] == brute_spans(all_[r["doc_id"]] or "")
        assert r["blob"] == hashlib.sha256((all_[r["doc_id"]] or "").encode()).hexdigest()


def test_ledger_scans_unseen_blobs_only(spark):
    first = documents(spark, SECRETS[:4])
    ledger = secret_scan.scan(first).cache()
    assert ledger.count() == 4
    assert secret_scan.scan(documents(spark, SECRETS), ledger=ledger).count() == len(SECRETS) - 4
    assert secret_scan.scan(first, ledger=ledger.withColumn("rules", F.lit("older"))).count() == 4
    assert secret_scan.scan(documents(spark, [])).count() == 0


def test_kept_ledger_over_versions_and_runs(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    history = [("a.txt", 1, "token=abcdef"), ("a.txt", 2, "clean"), ("b.txt", 1, "token=abcdef"), ("b.txt", 2, "key AKIA" + "B2" * 10), ("c.txt", 1, None)]
    first = spark.createDataFrame(history[:3], "path string, version int, text string")
    every = spark.createDataFrame(history, "path string, version int, text string")
    assert secret_scan.Ledger(spark, path).update(first).count() == 2
    kept = secret_scan.Ledger(spark, path)
    rows = kept.update(every)
    assert rows.count() == 4  # the first run's two blobs weren't scanned again
    got = {(r["path"], r["version"]): [s["kind"] for s in r["spans"]] for r in secret_scan.findings(every, rows).collect()}
    assert got == {("a.txt", 1): ["assign"], ("a.txt", 2): [], ("b.txt", 1): ["assign"], ("b.txt", 2): ["access"], ("c.txt", 1): []}
    assert kept.update(every).count() == 4
    (tmp_path / "ledger" / "update-lost").mkdir()  # a run that was lost before its job had ended
    assert kept.rows().count() == 4
    monkeypatch.setattr(secret_scan, "RULES_VERSION", "another")
    assert kept.update(every).count() == 8
    secret_scan.scan(every).write.parquet(f"{path}/update-twin")  # two runs at once
    assert secret_scan.findings(every, kept.rows()).count() == 5


def test_more_rules_equal_plain_search(texts):
    odd = ["-----BEGIN RSA PRIVATE KEY-----\nMIIB+/=\n-----END RSA PRIVATE KEY----- x", "xoxb-1234567890-abc", "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh12", "gho_" + "Z9" * 18, "ftp://u:p@h ftp://user:pass@h", "-----BEGIN PRIVATE KEY-----"]
    for t in [x or "" for x in texts] + SECRETS + odd:
        want = []
        for order, (kind, pattern, least, group) in enumerate(secret_scan.BASE_RULES + secret_scan.MORE_RULES):
            want += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, t, re.ASCII) if len(m[group]) >= least]
        assert secret_scan.find(t) == [(k, a, b) for a, _, k, b in sorted(want)]
    assert {k for t in odd for k, _, _ in secret_scan.find(t)} == {k for k, *_ in secret_scan.MORE_RULES}


def test_redaction_of_many_spans_is_quick():
    import time

    text = "token=abcdef12 é " * 20_000
    began = time.time()
    out = secret_scan.redacted(text, [(a, b) for _, a, b in secret_scan.find(text)])
    assert out == "[REDACTED] é " * 20_000 and time.time() - began < 2
    assert secret_scan.redacted("abcdef", [(1, 3), (2, 4), (4, 5)]) == "a[REDACTED][REDACTED]f"


def test_redaction(spark):
    out = secret_scan.stage(spark, documents(spark, ["é token=abcdef12 ok", "plain", None]), "").orderBy("doc_id").collect()
    assert [r["text"] for r in out] == ["é [REDACTED] ok", "plain", None]
    assert out[0]["n_chars"] == len(out[0]["text"]) and out[0]["blob"] == "clash"


# 9


def brute_em(rows, faults, rounds):
    """The label model on single documents, in plain loops."""
    k, kinds = len(rows[0]), 1 + len(faults)
    bad = [[0.02 if y == 0 else 0.9 if j in faults[y - 1] else 0.05 for j in range(k)] for y in range(kinds)]
    share = [0.85] + [0.15 / len(faults)] * len(faults)

    def posterior(row):
        like = []
        for y in range(kinds):
            p = share[y]
            for j, v in enumerate(row):
                p *= 1 if v < 0 else bad[y][j] if v == 0 else 1 - bad[y][j]
            like.append(p)
        return [x / sum(like) for x in like]

    for _ in range(rounds):
        q = [posterior(r) for r in rows]
        share = [(sum(x[y] for x in q) + 1) / (len(rows) + kinds) for y in range(kinds)]
        bad = [[(sum(x[y] for x, r in zip(q, rows) if r[j] == 0) + 1) / (sum(x[y] for x, r in zip(q, rows) if r[j] >= 0) + 2) for j in range(k)] for y in range(kinds)]
    return share, bad, [posterior(r) for r in rows]


def planted_votes(rng, n, accuracy, faults):
    """Documents of a kind each; labeller j errs by 1 - accuracy[j], and abstains on one text in five."""
    out = []
    for _ in range(n):
        kind = rng.choices(range(1 + len(faults)), [0.8] + [0.2 / len(faults)] * len(faults))[0]
        row = []
        for j, a in enumerate(accuracy):
            truth = 0 if kind and j in faults[kind - 1] else 1
            row.append(-1 if rng.random() < 0.2 else truth if rng.random() < a else 1 - truth)
        out.append((kind, tuple(row)))
    return out


def test_label_model_equals_brute_force_and_finds_planted_accuracies():
    rng = random.Random(8)
    faults, accuracy = ((0, 1, 2), (3, 4, 5)), [0.95, 0.9, 0.85, 0.97, 0.88, 0.92]
    made = planted_votes(rng, 4000, accuracy, faults)
    rows = [r for _, r in made]
    model = quality_classifier.label_model(Counter(rows), faults, 30)
    share, bad, q = brute_em(rows, faults, 30)
    assert np.allclose(model["share"], share, atol=1e-6) and np.allclose(model["rate"][:, :, 0], bad, atol=1e-6)
    own = quality_classifier._kinds(quality_classifier._coded(rows, 6), model["share"], model["rate"])
    assert np.allclose(own, q, atol=1e-6)
    for j, a in enumerate(accuracy):
        assert abs(model["rate"][0, j, 1] - a) < 0.05 and abs(model["rate"][1 + j // 3, j, 0] - a) < 0.05
    right = sum((x[0] >= 0.5) == (kind == 0) for (kind, _), x in zip(made, own)) / len(made)
    best = sum((sum(v == 0 for v in r) == 0) == (kind == 0) for kind, r in made) / len(made)
    assert right > 0.94 and right > best + 0.2  # far better than "all rules must pass"


def test_label_model_of_nothing():
    model = quality_classifier.LabelModel(Counter())
    assert model.good([(-1,) * len(quality_classifier.LABELLERS)])[0] > 0


def test_classifier_scores_equal_brute_force(spark, small):
    """Every score again, from the votes on, in plain code."""
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    lexicon, model, w, b = quality_classifier.fitted(docs, labels)
    texts = dict(docs.select("doc_id", "text").collect())
    own = quality_classifier.Featurizer(lexicon)
    rows = {d: own.votes(t) for d, t in texts.items()}
    cut = len(quality_classifier.FORM)
    names = list(quality_classifier.FORM)
    faults = [tuple(names.index(x) for x in f) for f in quality_classifier.FAULTS]
    form, harm = brute_em([r[:cut] for r in rows.values()], faults, quality_classifier.ROUNDS)[2], brute_em([r[cut:] for r in rows.values()], ((0, 1, 2),), quality_classifier.ROUNDS)[2]
    want = dict(zip(rows, (x[0] * y[0] for x, y in zip(form, harm))))
    got = dict(zip(rows, model.good(list(rows.values()))))
    assert all(abs(got[d] - want[d]) < 1e-6 for d in rows)
    scores = {r["doc_id"]: r["score"] for r in quality_classifier.scored(docs, labels).collect()}
    for d, t in texts.items():
        words = {quality_classifier.xxhash.xxh3_64_intdigest(x) % 2**16 for x in re.findall(r"\w+", t.lower())}
        z = b + sum(w[x] for x in words) / max(1, len(words)) ** 0.5 + sum(w[2**16 + 3 * j + v + 1] for j, v in enumerate(rows[d]))
        assert abs(scores[d] - 1 / (1 + np.exp(-z))) < 1e-4
    agree = sum((scores[d] >= 0.5) == (want[d] >= 0.5) for d in rows) / len(rows)
    assert agree > 0.97


def test_stage_drops_rows_not_ids(spark):
    rng = random.Random(10)
    good = [" ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(3, 8))) for _ in range(90)) for _ in range(40)]
    junk = [" ".join(x + "###$$$" for x in t.split()) for t in good[:8]]
    rows = [(k, t, 1.5) for k, t in enumerate(good)] + [(k, t, 2.5) for k, t in enumerate(junk)] + [(None, junk[0], 3.5), (0, good[0], 1.5)]
    import tempfile

    folder = tempfile.mkdtemp()
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = quality_classifier.stage(spark, spark.createDataFrame(rows, "doc_id long, text string, score double"), folder)
    assert out.columns == ["doc_id", "text", "score"]
    assert sorted(out.collect(), key=repr) == sorted([r for r in rows if r[2] == 1.5] + [(None, junk[0], 3.5)], key=repr)


def test_classifier_on_held_out_labels(spark, small):
    big = small.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    fit_on, held = labels.where(F.col("doc_id") % 2 == 0), labels.where(F.col("doc_id") % 2 == 1)
    rows = quality_classifier.scored(docs, fit_on).join(held, "doc_id").where("toxic = 0").collect()
    right = [r["kept"] == (r["quality"] == 1) for r in rows]
    assert sum(right) / len(right) > 0.9


def test_classifier_edge_cases(spark):
    rng = random.Random(9)
    rows = [prose(rng, 80) for _ in range(20)] + [None, "", "a"]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality_classifier.scored(documents(spark, rows), none).collect()}
    assert len(got) == 23 and all(got[k] for k in range(20))
    assert quality_classifier.scored(documents(spark, []), none).count() == 0


# 10


def test_quality_counts(docs, texts):
    for r in quality_rules.measured(docs).collect():
        t = texts[r["doc_id"]] or ""
        w = WORD.findall(t)
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        twice = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(twice))


def test_quality_verdicts(spark, docs, texts):
    rows = {r["doc_id"]: r for r in quality_rules.judged(docs).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        n = len(WORD.findall(t or ""))
        assert rows[k]["base_failed"] == (n < 50 or 100 * rows[k]["n_repeat_words"] > 50 * n)
        assert not (rows[k]["base_failed"] and rows[k]["kept"])
    assert quality_rules.judged(docs.where("false")).count() == 0


def test_quality_posteriors_equal_brute_force(docs):
    rows = quality_rules.judged(docs).collect()
    names = list(quality_rules.RULES)
    faults = [tuple(names.index(x) for x in f) for f in quality_rules.FAULTS]
    q = brute_em([tuple(r["v"]) for r in rows], faults, quality_rules.ROUNDS)[2]
    for r, x in zip(rows, q):
        assert abs(r["quality"] - x[0]) < 1e-6
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= quality_rules.THRESHOLD)


def test_quality_rules_outvote_a_single_bad_vote(spark):
    rng = random.Random(11)
    names = list(quality_rules.RULES)
    faults = [tuple(names.index(x) for x in f) for f in quality_rules.FAULTS]
    accuracy = [0.9, 0.95, 0.93, 0.9, 0.97, 0.94, 0.92, 0.96, 0.9]
    made = planted_votes(rng, 3000, accuracy, faults)
    model = quality_rules.fitted(spark.createDataFrame([(list(r),) for _, r in made], "v array<int>")).first()["m"]
    for j, a in enumerate(accuracy):
        assert abs(1 - model[0]["bad"][j] - a) < 0.05
        # a fault that only two rules see isn't identified by their votes alone; it is held against chance
        assert all(abs(model[1 + y]["bad"][j] - a) < 0.05 if len(own) > 2 else model[1 + y]["bad"][j] > 0.5 for y, own in enumerate(faults) if j in own)
    state = F.array(*[F.struct(F.lit(m["share"]).alias("share"), F.array(*map(F.lit, m["bad"])).alias("bad")) for m in model])
    rows = spark.createDataFrame([(k, list(r)) for k, r in made], "kind int, v array<int>").select("kind", "v", F.get(quality_rules.kinds(F.col("v"), state), 0).alias("q")).collect()
    right = sum((r["q"] >= 0.5) == (r["kind"] == 0) for r in rows) / len(rows)
    all_pass = sum(all(x != 0 for x in r["v"]) == (r["kind"] == 0) for r in rows) / len(rows)
    assert right > 0.93 and right > all_pass + 0.2


def test_quality_uses_no_python(spark, docs):
    plan = quality_rules.judged(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# pipeline


def test_pipeline(spark, small):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, small).cache()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = docs
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, kept, small).cache()
        assert new.columns == columns and 0 < new.count() <= kept.count(), name
        kept = new
    encode = packing.Encoder(packing.tokenizer_path())
    check_packed(out.collect(), {r["doc_id"]: encode(r["text"]) for r in kept.collect()})
    near = brute_components({r["doc_id"]: r["text"] for r in kept.collect()}, 5, 95)
    assert all(c == d for d, (_, c) in near.items())
