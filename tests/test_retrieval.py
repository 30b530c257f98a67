"""RRF fusion, BM25 ordering, exact vector ranks on tiny corpora."""

import pytest
from pyspark.sql import functions as F

from vitals.operators.retrieval import rrf_fuse, text_search, vector_search


def test_rrf_both_and_single_leg(spark):
    v = spark.createDataFrame([(1, "a", 1, "va"), (1, "b", 2, "vb")],
                              "query_id long, artifact_url string, rank long, excerpt string")
    t = spark.createDataFrame([(1, "b", 1, "tb"), (1, "c", 2, "tc")],
                              "query_id long, artifact_url string, rank long, excerpt string")
    out = {r["artifact_url"]: r for r in rrf_fuse(v, t, k=5).collect()}
    assert out["b"]["rrf_score"] == pytest.approx(1 / 62 + 1 / 61)
    assert out["a"]["rrf_score"] == pytest.approx(1 / 61)
    assert out["c"]["rrf_score"] == pytest.approx(1 / 62)
    assert out["b"]["excerpt"] == "vb" and out["c"]["excerpt"] == "tc"
    assert out["b"]["rank"] == 1


def _chunks(spark, texts, vecs=None):
    rows = [(i, 0, texts[i], "org/r", "pull_request", f"u{i}", (vecs[i] if vecs else None))
            for i in range(len(texts))]
    return spark.createDataFrame(rows, "artifact_id long, chunk_index long, text string, repo_name string, "
                                       "artifact_type string, artifact_url string, embedding array<float>")


def test_bm25_and_semantics(spark):
    ch = _chunks(spark, ["alpha beta gamma", "alpha alpha delta", "beta only here", "alpha beta beta"])
    q = spark.createDataFrame([(1, "org/r", "alpha beta"), (2, "org/r", "alpha -gamma")],
                              "query_id long, repo_name string, query_text string")
    res = text_search(q, ch, 10).collect()
    q1 = sorted((r["rank"], r["artifact_url"]) for r in res if r["query_id"] == 1)
    assert {u for _, u in q1} == {"u0", "u3"}          # AND of both terms
    assert q1[0][1] == "u3"                             # tf 2 for beta ranks first
    q2 = {r["artifact_url"] for r in res if r["query_id"] == 2}
    assert q2 == {"u1", "u3"}                           # -gamma excludes u0


def test_vector_ranks(spark):
    vecs = [[1.0, 0.0], [0.6, 0.8], [0.0, 1.0]]
    ch = _chunks(spark, ["x", "y", "z"], vecs)
    q = spark.createDataFrame([(7, "org/r", [1.0, 0.1])], "query_id long, repo_name string, query_vec array<float>")
    res = sorted((r["rank"], r["artifact_url"]) for r in vector_search(q, ch, 2).collect())
    assert res == [(1, "u0"), (2, "u1")]


def test_websearch_syntax(spark):
    from vitals.operators.retrieval import split_websearch
    assert split_websearch('or a "b c" or d -e OR') == [
        {"clause": 0, "alt": 0, "neg": False, "text": "a"},
        {"clause": 0, "alt": 1, "neg": False, "text": "b c"},
        {"clause": 1, "alt": 0, "neg": False, "text": "d"},
        {"clause": 1, "alt": 1, "neg": True, "text": "e"}]
    texts = ["fix the parser bug today", "parser fix bug", "the bug in parser", "memory leak fixed", "leak parser"]
    ch = _chunks(spark, texts)
    qs = {1: '"parser bug"', 2: '"fix the parser"', 3: "leak or bug", 4: "parser -bug", 5: "parser leak or today",
          6: "fix bug or memory", 7: "-parser", 8: "leak or -bug -parser", 9: "the -the", 10: ""}
    q = spark.createDataFrame([(i, "org/r", t) for i, t in qs.items()],
                              "query_id long, repo_name string, query_text string")
    got = {}
    for r in text_search(q, ch, 10).collect():
        got.setdefault(r["query_id"], set()).add(r["artifact_url"])
    assert got[1] == {"u0"}
    assert got[2] == {"u0"}
    assert got[3] == {"u0", "u1", "u2", "u3", "u4"}
    assert got[4] == {"u4"}
    assert got[5] == {"u0", "u4"}
    assert got[6] == {"u0", "u1", "u3"}                 # AND binds tighter than or
    assert got[7] == {"u3"}                             # only negated items
    assert got[8] == {"u3", "u4"}
    assert 9 not in got and 10 not in got               # nothing indexed


def test_zero_vectors_match_nothing_in_blocks_of_any_size(spark, monkeypatch):
    from vitals.operators import vectors
    vecs = [[1.0, 0.0], [0.0, 0.0], [0.6, 0.8], None]
    ch = _chunks(spark, ["w", "x", "y", "z"], vecs)
    q = spark.createDataFrame([(7, "org/r", [1.0, 0.1]), (8, "org/r", [0.0, 0.0]), (9, "org/r", None), (6, "org/r", [0.0, 2.0])],
                              "query_id long, repo_name string, query_vec array<float>")
    rows = [sorted((r["query_id"], r["rank"], r["artifact_url"]) for r in vector_search(q, ch, 5).collect())]
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 1)
    rows.append(sorted((r["query_id"], r["rank"], r["artifact_url"]) for r in vector_search(q, ch, 5).collect()))
    assert rows[0] == rows[1] == [(6, 1, "u2"), (6, 2, "u0"), (7, 1, "u0"), (7, 2, "u2")]


def test_the_best_chunk_need_not_be_the_first(spark):
    from vitals.operators.embedding import embed_chunks, embed_text
    from vitals.operators.retrieval import chunk_artifacts
    body = "alpha beta gamma delta " * 120 + "zebra quagga okapi " * 60
    art = spark.createDataFrame([(1, "org/r", "pull_request", 1, "t", body, "u1"), (2, "org/r", "pull_request", 2, "t", "alpha beta", "u2")],
                                "artifact_id long, repo_name string, type string, number long, title string, body string, url string")
    chunks = embed_chunks(chunk_artifacts(art)).checkpoint()
    assert chunks.select("embedding").distinct().count() == chunks.count() == 4
    q = embed_text(spark.createDataFrame([(5, "org/r", "zebra quagga okapi")], "query_id long, repo_name string, query_text string"),
                   "query_text", "query_vec")
    best = vector_search(q, chunks, 2).where("rank = 1").first()
    assert best["artifact_url"] == "u1" and best["chunk_index"] > 0


def test_embedding_hook_and_nulls(spark):
    from vitals.operators.embedding import embed_chunks, embed_text, token_slot
    df = spark.createDataFrame([(1, "B a b"), (2, None), (3, "")], "id long, text string")
    got = {r["id"]: r["v"] for r in embed_text(df, "text", "v", 8).collect()}
    want = [0.0] * 8
    for t in (b"b", b"a", b"b"):
        slot, sign = token_slot(t, 8)
        want[slot] += sign
    assert got == {1: want, 2: None, 3: [0.0] * 8}
    hooked = embed_chunks(df.where("text is not null"), lambda texts: [[len(t), 1] for t in texts], batch_size=1)
    assert {r["id"]: r["embedding"] for r in hooked.collect()} == {1: [5.0, 1.0], 3: [0.0, 1.0]}


def test_append_missing_embeds_each_artifact_once(spark, tmp_path):
    from vitals.operators.embedding import append_missing
    schema = "artifact_id long, repo_name string, type string, number long, title string, body string, url string"
    rows = [(i, "org/r", "pull_request", i, "t", f"text {i}" if i != 3 else " ", f"u{i}") for i in range(6)]
    seen = []
    path = str(tmp_path / "store")
    for upto in (2, 6, 6):
        before = spark.read.parquet(path).count() if seen else 0
        store = append_missing(spark, spark.createDataFrame(rows[:upto], schema), path)
        seen.append((before, store.count()))
    assert seen == [(0, 2), (2, 5), (5, 5)]
    assert sorted(r[0] for r in store.select("artifact_id").collect()) == [0, 1, 2, 4, 5]


def test_coded_search_finds_the_nearest_and_ranks_few(spark):
    import numpy as np
    from vitals.operators.vectors import Codebook, ann_recall
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    rows = [(i, 0, "t", f"org/r{i % 2}", "pull_request", f"u{i:04d}", x[i].tolist()) for i in range(3000)]
    rows.append((9999, 0, "t", "org/r0", "pull_request", "zero", [0.0] * 32))
    ch = spark.createDataFrame(rows, "artifact_id long, chunk_index long, text string, repo_name string, "
                                     "artifact_type string, artifact_url string, embedding array<float>")
    q = spark.createDataFrame([(j, f"org/r{j % 2}", (x[j] + rng.normal(size=32) * 0.7).tolist()) for j in range(20)],
                              "query_id long, repo_name string, query_vec array<float>")
    got = ann_recall(q, ch, 10).collect()
    assert len(got) == 20 and all(r["n_exact"] == 10 for r in got)
    assert sum(r["recall"] for r in got) / 20 >= 0.9
    assert all(r["share_ranked"] < 0.1 for r in got)
    book = Codebook(x[:2000].astype(np.float64), 8)
    codes = book.encode(x[:50].astype(np.float64))
    assert codes.shape == (50, 8)
    for v, c in zip(x[:50].astype(np.float64), codes):  # a table adds up the product with the decoded vector
        decoded = np.concatenate([cs[i] for cs, i in zip(book.centres, c)])
        assert book.table(v)[np.arange(8), c].sum() == pytest.approx(decoded @ v / np.linalg.norm(v))


def test_coded_search_without_vectors(spark):
    from vitals.operators.vectors import ann_search
    ch = _chunks(spark, ["x", "y"])
    q = spark.createDataFrame([(7, "org/r", [1.0, 0.1])], "query_id long, repo_name string, query_vec array<float>")
    assert ann_search(q, ch).collect() == []


def test_lists_against_brute_force_over_many_blocks(spark, monkeypatch):
    """Terms, phrases, negation and clauses; every block size and any number of results."""
    import random
    from vitals.operators import fulltext
    from vitals.operators.retrieval import build_directory, build_lists
    rng = random.Random(4)
    vocab = ["red", "green", "blue", "cyan", "the", "black", "white"]
    docs = [" ".join(rng.choices(vocab, weights=[9, 6, 4, 1, 5, 2, 1], k=rng.randint(1, 25))) for _ in range(300)]
    rows = [(i // 2, i % 2, d, f"org/r{i // 2 % 2}", "pull_request", f"u{i // 2:03d}", None) for i, d in enumerate(docs)]
    ch = spark.createDataFrame(rows, "artifact_id long, chunk_index long, text string, repo_name string, "
                                     "artifact_type string, artifact_url string, embedding array<float>").repartition(3)
    texts = ["red green", '"red green"', '"blue the red"', "cyan -black", "white or cyan", "-red -green", '-"red green" blue',
             '"red red red" or "white cyan" or black white', "nothing", "red nothing or cyan", "the"]
    q = spark.createDataFrame([(i, f"org/r{i % 2}", t) for i, t in enumerate(texts)],
                              "query_id long, repo_name string, query_text string")
    full = {}
    for span, k in ((1024, 400), (8, 400), (8, 3)):
        monkeypatch.setattr(fulltext, "BLOCK_SPAN", span)
        got = {}
        for r in text_search(q, ch, k, lists=build_lists(ch).checkpoint(), directory=build_directory(ch).checkpoint()).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["artifact_url"], r["chunk_index"], r["score"]))
        got = {i: sorted(v) for i, v in got.items()}
        full[span, k] = got
    assert full[1024, 400] == full[8, 400]
    assert full[8, 3] == {i: v[:3] for i, v in full[8, 400].items()}

    def occurs(item, words):
        item = [(o, w) for o, w in enumerate(item.split()) if w != "the"]
        return any(all(0 <= s + o < len(words) and words[s + o] == w for o, w in item) for s in range(-3, len(words)))
    for i, t in enumerate(texts):
        want = set()
        clauses = fulltext.split_websearch(t)
        for r in rows:
            words = r[2].split()
            for c in {x["clause"] for x in clauses}:
                items = [x for x in clauses if x["clause"] == c and set(x["text"].split()) - {"the"}]
                if items and r[3] == f"org/r{i % 2}" and all(occurs(x["text"], words) != x["neg"] for x in items):
                    want.add(r[5])
        assert {u for _, u, _, _ in full[8, 400].get(i, [])} == want, t


def test_rare_terms_keep_lists_unread(spark, monkeypatch):
    from vitals.operators import fulltext
    from vitals.operators.retrieval import build_directory, build_lists
    monkeypatch.setattr(fulltext, "BLOCK_SPAN", 10)
    ch = _chunks(spark, ["common words here" + (" rare" if i == 57 else "") for i in range(100)])
    q = spark.createDataFrame([(1, "org/r", "common rare words"), (2, "org/r", "common words")],
                              "query_id long, repo_name string, query_text string")
    got = {r["query_id"]: (r["n_lists"], r["n_read"]) for r in
           fulltext.lists_read(q, build_lists(ch).checkpoint(), build_directory(ch).checkpoint()).collect()}
    assert got == {1: (21, 3), 2: (20, 20)}


def test_stems_match_inflections(spark):
    ch = _chunks(spark, ["he was connecting cables", "the connection failed", "connected again", "nothing here"])
    q = spark.createDataFrame([(1, "org/r", "connects"), (2, "org/r", '"connect cable"'), (3, "org/r", "connects -failing")],
                              "query_id long, repo_name string, query_text string")
    plain = {(r["query_id"], r["artifact_url"]) for r in text_search(q, ch, 10).collect()}
    stems = {(r["query_id"], r["artifact_url"]) for r in text_search(q, ch, 10, stem=True).collect()}
    assert plain == set()
    assert stems == {(1, "u0"), (1, "u1"), (1, "u2"), (2, "u0"), (3, "u0"), (3, "u2")}


def test_render_hits_and_label_json(spark):
    from vitals.functions.json_paths import label_names_json
    from vitals.operators.retrieval import render_hits
    h = spark.createDataFrame([(1, 2, "u2", 0.0161, "b"), (1, 1, "u1", 0.03252, "a")],
                              "query_id long, rank long, artifact_url string, rrf_score double, excerpt string")
    assert render_hits(h).first()["text"] == "[score=0.0325] u1\na\n\n---\n\n[score=0.0161] u2\nb"
    lab = spark.createDataFrame([([("bug",), ("docs",)],), (None,)], "labels array<struct<name:string>>")
    assert [r[0] for r in lab.select(label_names_json("labels")).collect()] == ['["bug","docs"]', "[]"]


def test_lists_and_directory_shuffle_once(spark):
    """The text goes to its block once; packed lists stay there, and lengths are counted before the shuffle."""
    from vitals.operators.retrieval import build_directory, build_lists
    ch = spark.createDataFrame([(1, 0, "org/r", "u1", "red fox the red"), (1, 1, "org/r", "u1", None), (2, 0, "org/r", "u2", "the of"),
                                (2000, 0, "org/r", "u3", "blue fox")],
                               "artifact_id long, chunk_index long, repo_name string, artifact_url string, text string")
    for df in (build_lists(ch), build_directory(ch)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    lists = build_lists(ch)
    assert lists.orderBy("term", "block").select("term", "block", "n", "max_tf", "ats", "tfs", "positions").collect() == [
        ("blue", 1, 1, 1, [0], [1], [0]), ("fox", 0, 1, 1, [0], [1], [1]), ("fox", 1, 1, 1, [0], [1], [1]), ("red", 0, 1, 2, [0], [2], [0, 3])]
    d = build_directory(ch).orderBy("block").select("block", "n", "min_dl", "sum_dl", "artifact_ids", "chunk_indexes", "urls", "dls").collect()
    assert d == [(0, 3, 0, 3, [1, 1, 2], [0, 1, 0], ["u1", "u1", "u2"], [3, 0, 0]), (1, 1, 2, 2, [2000], [0], ["u3"], [2])]


def test_stemmed_lists_shuffle_once_and_store_nothing(spark):
    """Terms are stemmed on their way to the packed lists, whatever blocks a task has."""
    import os
    from vitals.operators.retrieval import build_lists
    from vitals.session import ensure_checkpoint_dir
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = os.listdir(folder)
    ch = spark.createDataFrame([(1, 0, "org/r", "connected foxes the connection fox"), (1, 1, "org/r", None), (2, 0, "org/r", "the of"),
                                (3, 0, "org/r", "foxes connects"), (2000, 0, "org/r", "connecting"), (2000, 0, None, "x1 connecting")],
                               "artifact_id long, chunk_index long, repo_name string, text string")
    lists = build_lists(ch, stem=True)
    assert lists._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert os.listdir(folder) == before
    got = lists.orderBy("term", "repo_name", "block").select("term", "repo_name", "block", "n", "max_tf", "ats", "tfs", "positions").collect()
    assert got == [
        ("connect", None, 1, 1, 1, [0], [1], [1]), ("connect", "org/r", 0, 2, 2, [0, 3], [2, 1], [0, 3, 1]),
        ("connect", "org/r", 1, 1, 1, [0], [1], [0]), ("fox", "org/r", 0, 2, 2, [0, 3], [2, 1], [1, 4, 0]),
        ("x1", None, 1, 1, 1, [0], [1], [0])]


def test_stemmed_lists_of_many_blocks_and_few_remembered_terms(spark, monkeypatch):
    """The lists of a stem are those of its terms, however many terms a task remembers and whatever blocks it has."""
    import random
    from vitals.operators import fulltext
    from vitals.operators.retrieval import build_lists
    from vitals.operators.stemming import with_stems
    monkeypatch.setattr(fulltext, "BLOCK_SPAN", 4)
    rng = random.Random(6)
    words = ["connect", "connects", "connected", "fox", "foxes", "the", "running", "run", "runs", "x1", "日本", "skies", "sky"]
    docs = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(90)]
    ch = spark.createDataFrame([(i // 2, i % 2, f"org/r{i % 3}", d) for i, d in enumerate(docs)],
                               "artifact_id long, chunk_index long, repo_name string, text string").coalesce(1)
    stems = {r["term"]: r["stem"] for r in with_stems(spark.createDataFrame([(w,) for w in words], "term string")).collect()}
    at, want = {}, {}
    for i, d in enumerate(docs):  # artifacts in order, so chunks are numbered as they come
        block = f"org/r{i % 3}", i // 2 // 4
        at[block] = at.get(block, -1) + 1
        for p, w in enumerate(d.split()):
            if w != "the":
                want.setdefault((stems[w], *block), {}).setdefault(at[block], []).append(p)
    want = {k: (list(v), [len(p) for p in v.values()], [x for p in v.values() for x in p]) for k, v in want.items()}
    for limit in (262_144, 9, 1):
        monkeypatch.setattr(fulltext, "STEM_TERMS", limit)
        rows = build_lists(ch, stem=True).collect()
        assert {(r["term"], r["repo_name"], r["block"]): (r["ats"], r["tfs"], r["positions"]) for r in rows} == want
        assert len(rows) == len(want)


def test_artifact_heads_shuffle_no_text(spark):
    from vitals.sources.bindings import artifacts_from_events
    ev = spark.createDataFrame([("PullRequestEvent", "org/repo1", "a", "2024-01-02 00:00:00", '{"action": "opened", "number": 3}')],
                               "type string, repo_name string, actor_login string, created_at string, payload string") \
        .selectExpr("type", "repo_name", "actor_login", "cast(created_at as timestamp_ntz) created_at", "payload")
    docs = spark.createDataFrame([(103, "x" * 100, "en", "web")], "doc_id long, text string, lang string, source string")
    whole = artifacts_from_events(ev, docs)
    heads = whole.drop("body")
    assert [r.title for r in heads.collect()] == ["x" * 80] and [r.body for r in whole.collect()] == ["x" * 100]
    joined = heads._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[1]
    assert "AS title" in joined and "body" not in joined  # cut below the join
