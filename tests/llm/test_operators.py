"""Training-data operators against brute force on rows with every odd case."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vitals.llm import (bpe, components, html_template, pieces, quality_rules, secrets, simhash_vp, token_files, warc,
                        winnowing)

from . import brute as B

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _counter(rows):
    return Counter(tuple(r) for r in rows)


# 1 ------------------------------------------------------------------------------------------------

def test_base_spans(docs, doc_rows):
    got = secrets.find_secrets(docs.select("doc_id", "text")).select(
        "doc_id", secrets.listed(F.filter("spans", lambda s: s["kind"] != "random"))).collect()
    want = [(r[0], ",".join(f"{k}:{a}:{e}" for a, _, k, e in B.base_spans(r[1]))) for r in doc_rows]
    assert _counter(got) == Counter(want)


def test_random_strings_are_found_and_words_are_not(spark):
    rng = random.Random(3)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choices(b64, k=44)) for _ in range(60)]
    words = ["thinkingofsomethinglonger", "internationalisationofwords", "a" * 40, "abababababababababababab",
             "the-quick-brown-fox-jumps-over-the-lazy-dog", "1234567890" * 4]
    rows = [(i, f"see {k} there") for i, k in enumerate(keys + words * 5)]
    got = {r["doc_id"]: r["s"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
           .select("doc_id", secrets.listed(F.filter("spans", lambda s: s["kind"] == "random")).alias("s")).collect()}
    found = sum(got[i] == "random:4:48" for i in range(len(keys)))
    assert found >= 0.9 * len(keys)
    assert not any(got[i] for i in range(len(keys), len(rows)))


def test_random_values_after_an_equals_sign_are_found(spark):
    rng = random.Random(8)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    shapes = ["AUTH={k} end", "get https://h.org/file?id=1&sig={k}&x=2 now", "key={k}== end", "{k}=value", "a=b={k}"]
    rows, want = [], []
    for i in range(100):
        k, shape = "".join(rng.choices(b64, k=44)), shapes[i % len(shapes)]
        at = shape.index("{k}")
        rows.append((i, shape.format(k=k)))
        want.append(f"random:{at}:{at + 44 + {2: 2, 3: 1}.get(i % len(shapes), 0)}")
    rows += [(100 + i, "name=thinkingofsomethinglonger&other=internationalisationofwords==") for i in range(20)]
    found = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in found.select("doc_id", secrets.listed(F.col("spans")).alias("s"),
                                                secrets.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    hits = [i for i in range(100) if got[i]["s"] == want[i]]
    assert len(hits) >= 90 and {i % len(shapes) for i in hits} == set(range(len(shapes)))
    assert {got[i]["t"] for i in hits if i % len(shapes) == 0} == {"AUTH=[SECRET] end"}
    assert not any(got[i]["s"] for i in range(100, len(rows)))


def test_normal_tail(spark):
    import math
    zs = [0.0, 0.5, 1.0, 2.0, 5.0, 8.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(secrets.neglog_tail(F.col("z"))).collect()
    for z, (g,) in zip(zs, got):
        assert abs(g + math.log10(math.erfc(z / math.sqrt(2)) / 2)) < 0.01  # a bin is 0.05


def test_redaction(spark):
    rows = [(1, "a password=abcdefghijklmnop é 0123456789abcdef!"), (2, None), (3, "clean")]
    found = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    got = dict(found.select("doc_id", secrets.redacted(F.col("text"), F.col("spans"))).collect())
    assert got == {1: "a [SECRET] é [SECRET]!", 2: None, 3: "clean"}


def test_many_matches_have_exact_starts(spark):
    text = " ".join("é" * (i % 7) + "0123456789abcdef" for i in range(1500))
    got = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(
        secrets.listed(F.col("spans"))).first()[0]
    assert got == ",".join(f"{k}:{a}:{e}" for a, _, k, e in B.base_spans(text))


# 2 ------------------------------------------------------------------------------------------------

def test_simhash_classes(docs, doc_rows):
    got = simhash_vp.near_duplicates(docs).select("doc_id", simhash_vp.fp_hex(F.col("fp")), "component_id").collect()
    codes = [B.simhash(r[1]) for r in doc_rows]
    low = B.components([r[0] for r in doc_rows], codes)
    assert _counter(got) == Counter((r[0], f"{c:016x}", x) for r, c, x in zip(doc_rows, codes, low))


def test_tree_misses_no_near_pair(spark, monkeypatch):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 63, (400, 3), dtype=np.uint64)
    codes = np.unique(np.concatenate([seeds, seeds ^ flips[:, 0], seeds ^ flips[:, 0] ^ flips[:, 1],
                                      seeds[:1] ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))]))
    monkeypatch.setattr(simhash_vp, "LEAF_ROWS", 128)
    monkeypatch.setattr(simhash_vp, "CELL_OWN", 16)
    monkeypatch.setattr(simhash_vp, "CELL_VISITORS", 64)
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    roots = dict(components.connected_components(simhash_vp.near_links(df, 2)).collect())
    got = {}
    for c in codes.view(np.int64).tolist():
        got.setdefault(roots.get(c, c), set()).add(c)
    ids = list(range(len(codes)))
    want = {}
    for c, x in zip(codes.view(np.int64).tolist(), B.components(ids, codes.tolist())):
        want.setdefault(x, set()).add(c)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (7, 8)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {got[i] for i in range(201)} == {0}
    assert {got[1000 + i] for i in range(300)} == {1000}


def test_large_shards_split_by_trees_of_their_own(spark, monkeypatch):
    """Forests of finer and finer shards join what all pairs join."""
    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = [base]
    for _ in range(12):
        bits = np.uint64(1) << rng.integers(0, 64, len(base), dtype=np.uint64)
        flips.append(flips[-1] ^ bits)
    codes = np.unique(np.concatenate(flips))
    pairs = np.bitwise_count(codes[:, None] ^ codes) <= 2
    label = np.arange(len(codes))
    while True:
        low = np.array([label[row].min() for row in pairs])
        if (low == label).all():
            break
        label = low
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long").repartition(3)
    monkeypatch.setattr(simhash_vp, "MAX_SAMPLE", 64)  # a coarse first tree
    monkeypatch.setattr(simhash_vp, "SPLIT_ROWS", 500)
    made = []
    for most in (1 << 30, 200, 40):
        monkeypatch.setattr(simhash_vp, "SPLIT_OWN", most)
        roots = components.connected_components(simhash_vp.near_links(df, 2)).collect()
        made.append({r["node"]: r["root"] for r in roots})
    want = {}
    for c, x in zip(codes.view(np.int64).tolist(), label.tolist()):
        want.setdefault(x, []).append(c)
    expected = {c: min(own) for own in want.values() if len(own) > 1 for c in own}
    assert made[0] == made[1] == made[2] == expected


# 3 ------------------------------------------------------------------------------------------------

def test_contamination(spark, docs, doc_rows):
    long = doc_rows[8][1].split()
    items = [(1, " ".join(long[100:130])), (2, " ".join(long[100:109])), (3, " ".join(long[29_985:])), (4, None),
             (5, "nowhere to be found " * 5), (6, "one"), (7, "..."), (None, " ".join(long[:20])), (10, "TWO words!"),
             (2, " ".join(long[500:515])), (11, " ".join(long[90:95] + ["gap"] + long[96:110]))]
    got = winnowing.contamination(docs, spark.createDataFrame(
        [(*x, "extra") for x in items], "item_id long, text string, pos string"))
    got = [(r[0], r[1], r[2], tuple(r[3])) for r in got.select("doc_id", "n_words", "n_hit", "items").collect()]
    want = []
    for r in doc_rows:
        n, hit, ids = B.contamination(r[1], items)
        want.append((r[0], n, hit, tuple(ids)))
    assert Counter(got) == Counter(want)


@pytest.mark.parametrize("k", [4, 8])
def test_winnowing_keeps_a_shared_gram(k):
    rng = np.random.default_rng(k)
    a, b = (rng.integers(0, 50, 400, dtype=np.uint64) for _ in range(2))
    b[100:110] = a[37:47]
    doc = np.zeros(400, np.int64)
    (pa, ga), (pb, gb) = winnowing.winnow(a, doc, k, 10), winnowing.winnow(b, doc, k, 10)
    inside_a = {int(g) for p, g in zip(pa, ga) if 37 <= p <= 47 - k}
    inside_b = {int(g) for p, g in zip(pb, gb) if 100 <= p <= 110 - k}
    assert inside_a & inside_b


def test_repeated_phrases_join_as_classes(spark):
    """A phrase that repeats within items and documents: equal results, and a join of distinct seeds only."""
    words = [f"w{i}" for i in range(9)]
    phrase = " ".join(words * 200)
    items = [(1, phrase), (2, phrase + " end"), (3, "other " + phrase), (4, "short one")]
    rows = [(i, phrase if i else phrase + " short one") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = winnowing.contamination(docs, bench).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got) == [
        (i, *B.contamination(t, items)) for i, t in rows]
    seeds = winnowing.item_seeds(bench)
    assert seeds.count() < 100
    assert seeds.select("size", "hash", "left", "right").distinct().count() < 60


def test_columns_named_like_results(spark):
    rows = [(1, "some words of a text that is long enough to have a window here", 7, 8, 9, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, seeds int, fp int, spans int, n_words int")
    near = simhash_vp.near_duplicates(docs, keep=("doc_id", "seeds", "spans"))
    assert near.select("doc_id", "seeds", "spans", "component_id").first()[:] == (1, 7, 9, 1)
    bench = spark.createDataFrame([(5, rows[0][1])], "item_id long, text string")
    hit = winnowing.contamination(docs, bench, keep=("doc_id", "seeds", "fp", "spans"))
    assert hit.select("doc_id", "seeds", "fp", "spans", "items").first()[:] == (1, 7, 8, 9, ["5"])


# 4 ------------------------------------------------------------------------------------------------

def test_bpe_round_trip(docs, doc_rows, library):
    got = bpe.encode_documents(docs, PATH, decoded=True, digests=True).collect()
    want = []
    for r in doc_rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), tuple(ids), text, B.sha(" ".join(map(str, ids))), B.sha(text)))
    assert Counter((r[0], r[1], tuple(r[2]), *r[3:]) for r in got) == Counter(want)


def test_letters_of_every_block_encode_as_in_the_library(spark, library):
    """Also letters that are newer than the library's tables, next to ASCII letters and digits."""
    letters = [chr(c) for c in range(0x80, 0x33480) if not 0xD800 <= c < 0xE000]
    newer = [0x0C5C, 0x088F, 0x10940, 0x1C89, 0x1C8A, 0xA7CB, 0x10D4A, 0x11380, 0x16100, 0x1E5D0, 0x32400, 0xE0100]
    texts = [" ".join(f"a{x}B1" for x in letters[k:k + 500]) for k in range(0, len(letters), 500)]
    texts += [f"a{chr(c)}B1 {chr(c)}{chr(c)}'s" for c in newer]
    texts += ["\x1cx\x1dy \x85 \xa0z", " " * 9, "\u200b \u200b a", "x" + "\u0301" * 40 + " e\u0301'S"]
    got = bpe.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()
    files = token_files.token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, 1,
                                    with_ids=True).collect()
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["ids"] for r in got} == want
    assert {r["doc_id"]: r["ids"][:-1] for r in files} == want


def test_only_word_level_files(tmp_path):
    assert pieces.cuts_into_words(PATH)
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert not pieces.cuts_into_words(other)
    with pytest.raises(ValueError):
        bpe.WordBPE(other)


def test_merge_order():
    ranks, merged = {(1, 2): 0, (2, 3): 1, (4, 3): 2}, [4, 5, 6]
    assert bpe.merge_ids([1, 2, 3], ranks, merged) == [6]
    assert bpe.merge_ids([2, 3, 1, 2], ranks, merged) == [5, 4]
    assert bpe.merge_ids([9], ranks, merged) == [9]


def test_long_runs_merge_as_short_ones(monkeypatch, library):
    rng = random.Random(9)
    one = bpe.WordBPE(PATH)

    def word(run):
        return one._word(one.pretokens(run)[0][0])
    runs = ["".join(rng.choices(letters, k=n)) for letters in ("a", "ab", "etaoinshrdlu") for n in (401, 999, 3000)]
    by_heap = [word(r) for r in runs]
    monkeypatch.setattr(bpe, "SCAN_PARTS", 1 << 30)
    assert by_heap == [word(r) for r in runs]
    monkeypatch.undo()
    run = "".join(rng.choices("etaoinshrdlu", k=200_000))
    start = time.process_time()
    ids = word(run)
    assert time.process_time() - start < 20
    assert ids == library.encode(run, add_special_tokens=False).ids


# 5 ------------------------------------------------------------------------------------------------

def test_quality_measures(docs, doc_rows):
    small = docs.where("length(text) < 5000 or text is null")
    got = quality_rules.measures(small).drop("text").collect()
    want = Counter((r[0], *B.quality(r[1])) for r in doc_rows if len(r[1] or "") < 5000)
    assert Counter(map(tuple, got)) == want


def test_cascade_order_never_changes_the_verdict(spark, docs):
    order = quality_rules.rule_order(docs)
    t = F.coalesce("text", F.lit(""))
    rules = quality_rules.text_rules(t)
    assert sorted(order) == sorted(rules)
    verdicts = [quality_rules.cascade(rules, o).isNull() for o in (order, order[::-1], sorted(order))]
    for r in docs.select(*[v.alias(f"v{i}") for i, v in enumerate(verdicts)]).collect():
        assert len(set(r)) == 1
    assert quality_rules.good_documents(docs).count() == docs.where(verdicts[0]).count()


# 6 ------------------------------------------------------------------------------------------------

PAGE = ("<!DOCTYPE html><html><head><title>t &amp; t</title><script>if (a<b) x('<p>')</script></head><body>"
        "<header><h2>Site {i}</h2></header><nav><ul><li><a href='/a>b'>menu {i}</a></ul></nav>"
        "<div class='layout-{i}'><aside>side {i}</aside><div class=main-text><h1>Title {i}</h1>"
        "<p>First <b>bold</b>er &amp; &lt;b&gt; {i}<p>second\n  line &nbsp; {w}<br>third<div class='tip'>Same on all</div>"
        "</div><form>Your mail</form><div id='comments'><p>Nice {i}</div></div><footer>&copy; {i}</footer>")
CONTENT = "Title {i} First bolder & <b> {i} second line {w} third"


def test_template_extraction(spark):
    rng = random.Random(2)
    rows, want = [], []
    for i in range(40):
        w = " ".join(rng.choice("abcdefgh") * 5 for _ in range(rng.randint(10, 30)))
        rows.append((i, "http://WWW.site.org:80/p?x=1", PAGE.format(i=i, w=w)))
        want.append((i, CONTENT.format(i=i, w=w)))
    rows += [(100, None, "<article>own <i>a</i>rticle<!-- no --></article><p>rest"), (101, "odd", None), (102, "", ""),
             (103, "x://y/", "plain &am text <b"), (None, "http://z/", "<main>in main</main> out"), (0, rows[0][1], rows[0][2])]
    want += [(100, "own article"), (101, ""), (102, ""), (103, "plain &am text"), (None, "in main"), want[0]]
    got = html_template.extract(spark.createDataFrame(
        [(*r, "extra") for r in rows], "page_id long, url string, html string, text string"))
    assert Counter((r[0], r[2]) for r in got.collect()) == Counter(want)


def test_copies_of_a_page_are_no_template(spark):
    rng = random.Random(6)

    def words(n):
        return " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    page = "<html><body><nav>menu</nav><article><h1>{h}</h1><p>{p}</p>{more}</article><p>note {i}</p></body></html>"
    one = page.format(h="The title", p="Its only paragraph", more="", i=0)
    rows = [(i, "http://one/", one, "The title Its only paragraph") for i in range(25)]
    # each page again with another note beside the article
    rows += [(100 + i, "http://notes/", page.format(h="The title", p="Its only paragraph", more="", i=i),
              "The title Its only paragraph") for i in range(25)]
    for i in range(40):
        h, p = words(4), words(20)
        rows.append((200 + i, "http://mixed/", page.format(h=h, p=p, more="", i=i), f"{h} {p}"))
    lone = page.format(h="With table", p="above", more="<blockquote>quoted</blockquote><h3>below</h3>", i=0)
    rows += [(300 + i, "http://mixed/", lone, "With table above quoted below") for i in range(20)]
    got = html_template.extract(spark.createDataFrame(
        [r[:3] for r in rows], "page_id long, url string, html string").repartition(4)).collect()
    assert {r["page_id"]: r["text"] for r in got} == {r[0]: r[3] for r in rows}
    assert len(got) == len(rows)


@pytest.mark.parametrize("attrs", ['style="overflow:hidden"', 'title="Hidden costs"', "style='a:b; overflow: hidden' id=x",
                                   'data-x = "hidden" data-hidden', "href=/hidden/hidden", 'title="""hidden"'])
def test_hidden_in_a_value_hides_nothing(attrs):
    page = html_template.Page(f"<body><article {attrs}><p>shown</p></article><p>rest</p>")
    assert page.text(set(), set(), set()) == "shown"


@pytest.mark.parametrize("attrs", ["hidden", "HIDDEN=''", 'class=a hidden="until-found"', 'title="x"hidden'])
def test_hidden_elements_are_left_out(attrs):
    page = html_template.Page(f"<body><article><p {attrs}>not this</p><p>shown</p></article>")
    assert page.text(set(), set(), set()) == "shown"


def test_class_in_a_value_is_no_class():
    a, b = (html_template.Page(f"<div {x}class='one'>x</div>").tokens for x in ("title='my class' ", ""))
    assert a.keys() == b.keys()


LAYOUTS = ['<body class="single-post has-sidebar"><article><p>{t}</p></article>',
           '<body><article class="post comment-open"><p>{t}</p></article>',
           '<body><div id="search-results"><article><p>{t}</p></article></div>',
           '<body><div class="skip-ad"><div class="widget-wrap"><main><p>{t}</p></main></div></div>',
           '<body><div class="page-with-sidebar"><div class="text"><p>{t}</p></div></div>',
           '<body><article><div class="share-box"><p>{t}</p></div></article>']
BESIDE = ('<div id="comments"><article class="comment"><p>Nice {i}</p></article></div>'
          '<div class="related"><p>See also {i}</p></div>')


@pytest.mark.parametrize("layout", LAYOUTS)
def test_listed_words_never_take_out_the_content(layout):
    text = "the text of the page " * 5
    for page in (layout, layout + BESIDE.replace("article", "section")):
        got = html_template.Page(page.format(t=text, i=1)).text(set(), set(), set())
        assert got == text.strip()


def test_slots_decide_before_listed_words(spark):
    rng = random.Random(7)
    rows = []
    for n, layout in enumerate(LAYOUTS):
        for i in range(30):
            t = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(30))
            beside = BESIDE if "<article" in layout and "search" not in layout else BESIDE.replace("article", "section")
            page = "<html>" + (layout + beside + "<footer>{i}</footer>").format(t=t, i=i)
            rows.append((n * 100 + i, f"http://h{n}/", page, t))
    got = html_template.extract(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in got.collect()} == {r[0]: r[3] for r in rows}


def _plain(source):
    return html_template.Page(source).text([], set(), set())


def test_only_blocks_part_texts():
    assert _plain("<p>super<wbr>cali<img src=x>fragi<x-y>listic</x-y> a<script>b<p></script>c "
                  "<ruby>d<rt>e</rt></ruby>f</p><p>g</p>") == "supercalifragilistic ac def g"
    assert _plain("<p>for <math><mi>x</mi><mo>=</mo><mn>2</mn></math> only</p>") == "for x=2 only"
    assert _plain("<p>before<button>press <b>me</b></button> after <select><option>1<option>2</select>end</p>") == "before after end"


def test_a_form_around_the_page_is_no_form():
    body = "<div><h1>title</h1><p>" + "word " * 50 + "</p></div>"
    assert _plain(f"<body><form id=aspnet>{body}<input></form></body>") == "title " + ("word " * 50).strip()
    assert _plain(f"<body>{body}<form>search this <input></form></body>") == "title " + ("word " * 50).strip()


def test_hidden_texts_and_comments_go():
    long = "word " * 40
    page = (f"<article><p>{long}</p><div style='color:red; display: none'>hidden</div><section class=replies><p>r</p></section>"
            "<article><p>a reader</p></article><div id=discussion>d</div></article>")
    assert _plain(page) == long.strip()
    assert _plain(f"<article><article><p>{long}</p></article></article>") == long.strip()


def test_deep_pages_take_linear_time():
    n = 20_000
    deep = "".join(f"<div>t{i}" for i in range(n)) + "</span></section>" * n
    start = time.process_time()
    page = html_template.Page(deep)
    assert page.text([{1, 2}], {3}, {4}).split() == [f"t{i}" for i in range(n)]
    assert page.tokens[0][4] == sum(len(f"t{i}") for i in range(n))
    articles = "<article class=comment>x" * 5000
    assert len(html_template.Page(articles).blocks) == 5000
    assert time.process_time() - start < 2


def test_deep_and_broken_markup():
    page = html_template.Page("<div>" * 2000 + "x" + "</p></section>" + "<td>y<td>z" + "<" * 50)
    assert page.text([], set(), set()).startswith("x y z")


# 8 ------------------------------------------------------------------------------------------------

def test_token_files(docs, doc_rows, library):
    got = token_files.token_files(docs, PATH, 1, with_ids=True).collect()
    want, start = {}, 0
    assert len(got) == len(doc_rows)
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    want = Counter((r[0], *library.encode(r[1] or "", add_special_tokens=False).ids, 1) for r in doc_rows)
    assert Counter((r["doc_id"], *r["ids"]) for r in got) == want


# 9 ------------------------------------------------------------------------------------------------

def test_records_have_the_fields_that_the_format_requires():
    import re as _re
    a = warc.record("response", 7, "http://h/x", b"body", "d", None, "2024-01-01T00:00:00Z", "f:0")
    b = warc.record("revisit", None, None, b"body", "d", 7, "2024-01-01T00:00:00Z", "f:0")
    c = warc.record("revisit", None, None, b"body", "d", 7, "2024-01-01T00:00:00Z", "f:99")
    for r in (a, b, c):
        fields, _ = warc.parse(r)
        assert _re.fullmatch(r"<urn:[^<>]+>", fields["WARC-Record-ID"])
        assert {"WARC-Type", "WARC-Date", "Content-Length", "WARC-Payload-Digest"} <= set(fields)
    ids = [warc.parse(r)[0]["WARC-Record-ID"] for r in (a, b, c)]
    assert len(set(ids)) == 3 and warc.parse(b)[0]["WARC-Refers-To"] == ids[0]


@pytest.mark.parametrize("split", [97, 4096, 1 << 22])
def test_warc_round_trip(spark, split):
    rng = random.Random(4)
    body = "".join(chr(rng.randint(97, 122)) for _ in range(3000))
    rows = [(i, f"http://h/{i}", body if i % 3 else body[i:] + "é") for i in range(30)]
    rows += [(50, None, None), (51, "u", ""), (52, "u\r\nX: y", "short"), (53, "u", "short"), (None, "u", body), (1, "u", body)]
    df = spark.createDataFrame([(*r, "extra", "extra") for r in rows],
                               "page_id long, url string, html string, digest string, first string").repartition(2)
    got = warc.round_trip(df, split_bytes=split, payload=True).collect()
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, x in rows if x == h and j is not None]
        refers = min(same) if len(data) >= 100 and same and i != min(same) else None
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == Counter(want)
    assert all(r["html"] is None if r["record_type"] == "revisit" else
               hashlib.sha256(r["html"].encode()).hexdigest() == r["payload_digest"] for r in got)


# empty tables -------------------------------------------------------------------------------------

def test_empty_tables(spark, no_docs):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert secrets.find_secrets(no_docs).count() == 0
    assert simhash_vp.near_duplicates(no_docs).count() == 0
    assert winnowing.contamination(no_docs, items).count() == 0
    assert winnowing.contamination(some, items).first()["n_hit"] == 0
    assert bpe.encode_documents(no_docs, PATH).count() == 0
    assert quality_rules.good_documents(no_docs).count() == 0
    assert html_template.extract(pages).count() == 0
    assert token_files.token_files(no_docs, PATH, 1).count() == 0
    assert warc.round_trip(pages).count() == 0
