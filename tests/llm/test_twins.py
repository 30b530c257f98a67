"""Plain twins of the methods that SQL cannot express: battery and false-discovery control, template, classifiers."""

import math
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from vitals.llm import compress_classifier, html_template, secrets, toxicity_cnn

from . import brute as B


# 1 ------------------------------------------------------------------------------------------------

def _tail(z):
    z = max(z, 0.0)
    if z > 30:
        return (z * z / 2 + math.log(z * math.sqrt(2 * math.pi))) / math.log(10)
    return -math.log10(math.erfc(z / math.sqrt(2)) / 2)


def _battery(token):
    """(stratum, -log10 p) of a candidate, by plain sums."""
    core = token.rstrip("=")
    if re.fullmatch("[0-9]*", core):
        return None
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", core):
        size, canon = 16, core.lower()
    elif re.fullmatch("[A-Z2-7]+", core):
        size, canon = 32, core
    elif re.fullmatch("[A-Za-z0-9+/_-]+", core):
        size, canon = 64, core.replace("-", "+").replace("_", "/")
    else:
        return None
    n = len(canon)
    if n < 20:
        return None
    alphabet = secrets.ALPHABETS[size]
    counts = Counter(canon)
    squares = sum(c * c for c in counts.values())
    z_chi = (size * squares / n - n - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n)
    half = [alphabet.index(c) >= size // 2 for c in canon]
    ones = sum(half)
    both = 2 * ones * (n - ones)
    runs = 1 + sum(a != b for a, b in zip(half, half[1:]))
    spread = both * (both - n) / (n * n * (n - 1))
    z_runs = abs(runs - both / n - 1) / math.sqrt(spread) if spread > 0 else 99.0
    values = [alphabet.index(c) + 1 for c in canon]
    mean = sum(values) / n
    var = sum((v - mean) ** 2 for v in values)
    z_serial = abs(sum((a - mean) * (b - mean) for a, b in zip(values, values[1:])) / var + 1 / n) * math.sqrt(n) if var else 99.0
    worst = max(_tail(z_chi), _tail(z_runs) - math.log10(2), _tail(z_serial) - math.log10(2)) - math.log10(3)
    k2, k3 = secrets.TEXT_MOMENTS[size]
    same = (squares - n) / (n * (n - 1))
    sd = math.sqrt((4 * (n - 2) * (k3 - k2 * k2) + 2 * (k2 - k2 * k2)) / (n * (n - 1)))
    p = 0.0 if worst > 3 else _tail((k2 - same) / sd)
    return size * 100 + int(math.log2(n)), p


def _tokens():
    rng = random.Random(2)
    out = []
    for k in (20, 33, 64, 130):
        for letters in (string.hexdigits[:16], secrets.ALPHABETS[32], secrets.ALPHABETS[64], "abcdefghij", "etaoin" * 5 + string.ascii_letters):
            out += ["".join(rng.choices(letters, k=k)) for _ in range(12)]
    return out + ["a" * 30, "ab" * 20, "1234567890" * 3, "internationalisation-of-words", "AAAABBBBCCCCDDDDEEEEFFFF"]


def test_battery_by_plain_sums(spark):
    tokens = _tokens()
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.battery(F.col("t")).alias("b")).collect()
    for r in got:
        want = _battery(r["t"])
        if want is None:
            assert r["b"] is None
        else:
            assert r["b"]["stratum"] == want[0]
            assert abs(r["b"]["bin"] - min(800, math.floor(want[1] * 20))) <= 1, r["t"]  # a bin is 0.05


def test_cutoffs_are_those_of_sorted_p_values(spark):
    tokens = _tokens()
    docs = spark.createDataFrame([(i, f"x {t} y {t}") for i, t in enumerate(tokens)], "doc_id long, text string")
    bins = defaultdict(list)
    for r in docs.select(F.explode(secrets.candidates(F.col("text"))).alias("c")).select("c.*").collect():
        bins[r["stratum"]].append(r["bin"])
    want = {}
    for stratum, own in bins.items():
        ps = sorted(10 ** (-b / 20) for b in own)
        passed = [k for k, p in enumerate(ps, 1) if p <= 0.01 * k / len(ps)]
        if passed:
            want[stratum] = min(b for b in own if 10 ** (-b / 20) <= ps[max(passed) - 1] * (1 + 1e-12))
    assert secrets.cutoffs(docs) == want and want


# 6 ------------------------------------------------------------------------------------------------

def _pages():
    rng = random.Random(4)
    rows = []
    for host, kind, n in (("a.org", "article", 14), ("b.org", "main", 12), ("c.org", "div", 12), ("a.org", "main", 12), ("few.org", "article", 2)):
        for i in range(n):
            text = " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(60))
            menu = "".join(f"<li><a href=/{x}>{x}</a></li>" for x in ("home", "news", "about"))
            body = f"<{kind} class=c><h1>t{i}{kind}</h1><h6>share this</h6><p>{text}</p></{kind}>"
            rows.append((len(rows), f"http://{host}/{kind}{i}",
                         f"<html><body><div class=top><ul>{menu}</ul></div>{body}<div class=end><p>all rights</p><p>x{i}</p></div></body></html>"))
    return rows + [(len(rows), rows[0][1], rows[0][2])]


def _template(pages):
    """Slots and constant texts of one host's distinct pages, from whole occurrence vectors."""
    vector, info = defaultdict(Counter), {}
    parsed = [html_template.Page(p) for p in pages]
    articles = defaultdict(set)
    for i, page in enumerate(parsed):
        bit = page.article_bit()
        for k, (parent, name, outside, count, chars, links) in page.tokens.items():
            vector[k][i] += count
            old = info.setdefault(k, [parent, name, False, True, 0, 0])
            old[2] |= outside
            old[3] &= k in page.listed
            old[4] += chars
            old[5] += links
        for key, outside, text in page.blocks:
            if not outside:
                k = html_template.text_key(key, text)
                vector[k][i] += 1
                info.setdefault(k, [key, "#text", False, False, 0, 0])
                articles[k].add(bit)
    n = len(pages)
    frequent = {k for k, v in vector.items() if len(v) >= (10 if info[k][1] == "#text" else 3) and len(v) >= min(n * 0.05, 50)}
    classes = Counter(tuple(sorted(vector[k].items())) for k in frequent)
    large = {k for k in frequent if classes[tuple(sorted(vector[k].items()))] >= 2}
    if 0 not in large:
        return None
    whole = info[0][4]
    cut, level = {0: False}, [0]
    while level:
        below = [k for k in large if k != 0 and info[k][1] != "#text" and info[k][0] in level]
        for k in below:
            cut[k] = cut[info[k][0]] or (info[k][3] and not info[k][4] >= 0.6 * whole)
        level = below
    inside = [k for k in cut if k and not info[k][2] and not cut[k]]
    kind = {k: 1 if info[k][1] == "article" else 2 if info[k][1] == "main" else
            3 if info[k][4] >= 0.6 * whole and info[k][1] not in ("html", "body") else None for k in inside}
    least = min((info[k][4] for k in inside if kind[k] == 3), default=None)
    roots = [sorted(k for k in inside if kind[k] == x and (x < 3 or info[k][4] == least)) for x in (1, 2, 3)]
    menus = sorted(k for k in inside if info[k][5] >= 0.8 * info[k][4] > 0 and len(vector[k]) >= 0.5 * n
                   and kind[k] is None and info[k][1] not in ("html", "body"))
    constant = sorted(k for k in large if info[k][1] == "#text" and len(articles[k]) >= 5 and info[k][0] in cut
                      and vector[k] == vector[info[k][0]])
    return roots, menus, constant


def test_templates_from_whole_vectors(spark):
    rows = _pages()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    src = pages.select("html", html_template.host_of(F.col("url")).alias("host")).distinct()
    got = {r["host"]: ([sorted(x) for x in r["roots"]], sorted(r["menus"]), sorted(r["constant"] or [])) for r in
           html_template.templates(html_template.token_vectors(src.withColumn("page", F.xxhash64("html")))).collect()}
    by_host = defaultdict(set)
    for _, url, source in rows:
        by_host[url.split("/")[2]].add(source)
    want = {h: t for h, t in ((h, _template(sorted(p))) for h, p in by_host.items()) if t is not None}
    assert got == want and {"a.org", "b.org", "c.org"} <= set(got)
    assert got["a.org"][0][0] and got["a.org"][0][1] and got["b.org"][0][1] and got["c.org"][0][2] and got["b.org"][2]
    texts = {r["page_id"]: r["text"] for r in html_template.extract(pages).collect()}
    for i, url, source in rows:
        t = want.get(url.split("/")[2])
        roots, menus, constant = t or ([], [], [])
        assert texts[i] == html_template.Page(source).text([set(r) for r in roots], set(menus), set(constant))
        assert "all rights" not in texts[i] and "home" not in texts[i] and ("share" not in texts[i] or "few" in url)


# 7, 10 ----------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["".join(rng.choices("aeioubcdlmnrst", k=rng.randint(2, 8))) for _ in range(200)] + ["été", "日本"]
    out = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(60)]
    return [t.upper() + "!!" if i % 3 == 0 else t for i, t in enumerate(out)]


def _fitted(spark, module, label, texts):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    model = module.train(docs, labels, label, F.lit(True))
    scored = {r["doc_id"]: r["score"] for r in module.score(docs.unionByName(
        spark.createDataFrame([(-1, None, None), (-2, "", "en")], docs.schema)), model).collect()}
    return model, scored


def test_quality_scores_from_two_plain_sizes(spark, texts):
    model, scored = _fitted(spark, compress_classifier, "quality", texts)
    for i, t in [*enumerate(texts), (-1, ""), (-2, "")]:
        raw = t.encode()
        sizes = [len(zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False,
                                              write_checksum=False, write_dict_id=False).compress(raw)) if raw else 0
                 for d in (model.bad, model.good)]
        total = max(sum(sizes), 1)
        diff, ratio = (sizes[0] - sizes[1]) / total, min(sizes) / max(len(raw), 1)
        x = [diff, diff * math.sqrt(total), ratio, ratio * ratio, diff * ratio, math.log1p(len(raw))]
        z = sum(w * (v - m) / s for w, v, m, s in zip(model.weights, x, model.mean, model.scale)) + model.weights[-1]
        assert scored[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_toxicity_scores_from_plain_convolutions(spark, texts):
    model, scored = _fitted(spark, toxicity_cnn, "toxic", texts)

    def rows_of(word):
        raw = word.encode()
        h, first, _ = toxicity_cnn.padded_buckets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return h[:, first[0]]
    pad = 2 * model.embed[toxicity_cnn.PAD_ROW]
    for i, t in [*enumerate(texts[:25]), (-1, ""), (-2, "")]:
        vectors = [model.embed[a] + model.embed[b] for a, b in map(rows_of, B.bench_words(t))]
        n, most = len(vectors), max(toxicity_cnn.WIDTHS)
        vectors += [pad] * (2 * most)
        z = model.const
        for k, (conv, bias) in enumerate(zip(model.conv, model.bias)):
            for f in range(len(conv)):
                acts = [sum(float(vectors[p + j] @ conv[f, j]) for j in range(conv.shape[1])) for p in range(n + most - 1)]
                z += max(max(acts) + bias[f], 0) * model.out[k * len(conv) + f]
        z = z * model.calibration[0] + model.calibration[1]
        assert scored[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)
