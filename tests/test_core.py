"""Operators against brute force and by hand."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from lodestone.functions import parsing as Y, questions as Q, text as T
from lodestone.functions.vectors import cosine
from lodestone.operators import anchors as H, arbitration as A, chains as C, extract as X, graph as G, index as I, ingest as N, metrics as M, proofs as V, ranking as R, search as S
from lodestone.plans import catalogue as K, evidence  # noqa: F401  (evidence registers its queries)
from lodestone.sources import corpus, loaders


def one(spark, column, **values):
    names = ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column).first()[0]


@pytest.mark.parametrize(
    ("pred", "gold", "f1"), [("The Cat", "cat", 1.0), ("", "", 1.0), (None, "x", 0.0), ("a b b", "b b c", 0.8), ("x", "y", 0.0), ("U.S.", "us", 1.0)]
)
def test_token_f1(spark, pred, gold, f1):
    assert one(spark, T.token_f1(F.col("p"), F.col("g")), p=pred, g=gold) == pytest.approx(f1)


def test_uncertain_and_substance(spark):
    rows = spark.createDataFrame([("Unknown",), (None,), (" ",), ("Paris",), ("I don't know",)], "a string").select(T.is_uncertain(F.col("a")), T.has_substance(F.col("a"))).collect()
    assert [tuple(r) for r in rows] == [(True, False), (True, False), (False, False), (False, True), (True, False)]


def pack(text, size, overlap):
    import re

    parts = [s for s in re.split(r"(?<=[.!?])[ \t\r\n]+", text.strip(" ")) if s.strip()]
    done, now = [], []
    for s in parts:
        n = len(s.split())
        if now and sum(len(x.split()) for x in now) + n > size:
            done.append(" ".join(now))
            kept, total = [], 0
            for x in reversed(now):
                if total + len(x.split()) > overlap:
                    break
                kept.insert(0, x)
                total += len(x.split())
            now = kept
        now.append(s)
    return done + [" ".join(now)] if now else done


def test_sentence_packing(spark):
    rng = random.Random(3)
    texts = [" ".join(" ".join(rng.choices("alpha beta gamma".split(), k=rng.randint(1, 9))) + rng.choice(".!?") for _ in range(rng.randint(0, 25))) for _ in range(40)] + ["", "   ", "One long " + "word " * 90 + "."]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "i int, t string").select("i", N.pack_sentences(F.col("t"), 12, 4)).collect()
    for i, chunks in got:
        assert chunks == (pack(texts[i], 12, 4) if i != 999 else [])


def test_paragraph_packing(spark):
    t = "a" * 60 + "\n\n" + "b" * 60 + "\n\n" + "c" * 200 + "\n \n" + "d" * 10
    assert one(spark, N.pack_paragraphs(F.col("t"), 20, 150), t=t) == ["a" * 60 + "\n\n" + "b" * 60, "c" * 200 + "\n\n" + "d" * 10]
    assert one(spark, N.pack_paragraphs(F.col("t")), t=None) == []


def test_exact_percentiles(spark):
    rng = random.Random(1)
    rows = [("hot", float(rng.randint(0, 50))) for _ in range(900)] + [("cold", rng.random()) for _ in range(7)] + [("none", None)]
    got = {(r.g, r.p): r.v for r in M.exact_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.0, 0.5, 0.99, 1.0]).collect()}
    for g in ("hot", "cold"):
        v = sorted(x for k, x in rows if k == g)
        assert all(got[g, p] == v[math.floor(p * (len(v) - 1))] for p in (0.0, 0.5, 0.99, 1.0))
    assert ("none", 0.5) not in got


def test_bootstrap_makes_a_thousand_draws(spark):
    rng = random.Random(7)
    rows = [(g, i, rng.random()) for g, n in (("a", 60), ("b", 25)) for i in range(n)] + [("a", 900, None), ("single", 1, 0.25)]
    got = {r.g: (r.mean, r.low, r.high) for r in M.bootstrap(spark.createDataFrame(rows, "g string, i int, v double"), "g", "i", "v").collect()}
    assert got["single"] == (0.25, 0.25, 0.25)  # a draw of one row is often empty
    for g in ("a", "b"):
        own, means = [(i, v) for h, i, v in rows if h == g and v is not None], []
        for draw in range(1, 1001):
            w = [sum(int(hashlib.md5(f"{i}:{draw}".encode()).hexdigest()[:8], 16) / 2**32 >= c for c in M.POISSON) for i, _ in own]
            means.append(sum(x * v for x, (_, v) in zip(w, own)) / sum(w))
        means.sort()
        assert got[g] == pytest.approx((sum(v for _, v in own) / len(own), means[25], means[975]), abs=2e-6)


def test_exact_search_is_exact(spark):
    rng = random.Random(5)
    data = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(900, None), (901, [1.0]), (902, [0.0] * 8), (903, [float("nan")] * 8)]
    df = spark.createDataFrame(data, "id bigint, vector array<double>")
    got = {(r.query_id, r["rank"]): r.id for r in S.exact_top_k(df.where("id % 50 = 0"), df, 5, 8).collect()}
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v in data[:300]}
    for q in range(0, 300, 50):
        best = sorted((i for i in unit if i != q), key=lambda i: (-round(sum(a * b for a, b in zip(unit[q], unit[i])), 9), i))[:5]
        assert [got[q, r] for r in range(1, 6)] == best
    assert S.exact_top_k(df.where("id < 0"), df, 5, 8).count() == 0


def test_bm25_keeps_common_terms(spark, monkeypatch):
    rng = random.Random(12)
    texts = [" ".join(["the"] * rng.randint(1, 4) + ["saint"] * (i % 3 > 0) + rng.choices("abbey bridge cloister dome elm fern".split(), k=rng.randint(0, 9))) for i in range(40)] + ["", None]
    asked = {1: "the", 2: "The Saint", 3: "saint abbey of the dome", 4: "unknown"}
    words = [t.split() for t in texts if t]
    df = {t: sum(t in w for w in words) for w in words for t in w}
    idf = {t: math.log((len(words) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    floor, mean = 0.25 * sum(idf.values()) / len(idf), sum(map(len, words)) / len(words)
    want = {}
    for q, text in asked.items():
        score = {}
        for d, w in enumerate(words):
            for t in set(text.lower().split()) & set(w):
                tf = w.count(t)
                score[d] = score.get(d, 0) + (idf[t] if idf[t] >= 0 else floor) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
        for r, d in enumerate(sorted(score, key=lambda d: (-round(score[d], 9), d))[:5], 1):
            want[q, r] = (d, round(score[d], 8))
    monkeypatch.setattr(S, "DOC_BLOCK", 15)
    docs, queries = (spark.createDataFrame(list(x), "id bigint, text string") for x in (enumerate(texts), asked.items()))
    assert {(r.query_id, r["rank"]): (r.doc, round(r.score, 8)) for r in S.bm25(queries, docs, 5).collect()} == want
    assert (1, 1) in want and S.bm25(queries, docs.where("id < 0"), 5).count() == 0



def test_bm25_of_many_questions(spark, monkeypatch):
    rng = random.Random(31)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [x + y for x in letters for y in letters[:8]]
    texts = [" ".join(["of"] * (i % 4 > 0) + rng.choices(letters, [30 - 1.1 * j for j in range(26)], k=rng.randint(1, 12)) + rng.choices(names, k=3)) for i in range(700)]
    asked = {i: " ".join(["of"] * (i % 2) + rng.choices(letters, k=rng.randint(0, 3)) + rng.choices(names, k=i % 3)) for i in range(150)} | {900: "of a", 901: "a of"}
    words = [t.split() for t in texts]
    df = {t: sum(t in w for w in words) for w in words for t in w}
    idf = {t: math.log((len(words) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    floor, mean = 0.25 * sum(idf.values()) / len(idf), sum(map(len, words)) / len(words)
    want = {}
    for q, text in asked.items():
        score = {}
        for d, w in enumerate(words):
            for t in set(text.split()) & set(w):
                tf = w.count(t)
                score[d] = score.get(d, 0) + (idf[t] if idf[t] >= 0 else floor) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
        for r, d in enumerate(sorted(score, key=lambda d: (-round(score[d], 9), d))[:5], 1):
            want[q, r] = (d, round(score[d], 8))
    docs, queries = (spark.createDataFrame(list(x), "id bigint, text string") for x in (enumerate(texts), asked.items()))
    for blocks in ({"RUN": 8}, {"RUN": 8, "WIDE": 10**6, "ASKED_BLOCK": 40}, {"WIDE": 4, "DOC_BLOCK": 300}):
        for name, value in blocks.items():
            monkeypatch.setattr(S, name, value)
        assert {(r.query_id, r["rank"]): (r.doc, round(r.score, 8)) for r in S.bm25(queries, docs, 5).collect()} == want


def test_neighbourhoods_of_all_questions(spark):
    asked = {r[0] for r in K.load(spark, SMALL, "selective_answers").select("answer_id", T.lookup_key(F.col("question"))).distinct().collect() if r[1]}
    found = {r.query_id for r in K.QUERIES["neighbourhood_rerank"](spark, SMALL).collect()}
    assert found <= asked and len(found) > 0.9 * len(asked) and any(q % 100 for q in found)


def test_pit_ties(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 3), ("b", 9)], "g string, v int")
    assert sorted((r.g, r.v, r.p) for r in R.pit(df, ["g"], "v", "p").collect()) == [("a", 1, pytest.approx(1 / 3)), ("a", 1, pytest.approx(1 / 3)), ("a", 3, pytest.approx(2.5 / 3)), ("b", 9, 0.5)]


def test_arbitration_defaults_and_ties(spark):
    arms = spark.createDataFrame([(1, "b", "x", None), (1, "a", "x", None), (2, "a", "unknown", 1.0), (2, "b", "i don't know", 1.0), (3, "a", "no answer?", 0.1), (3, "b", "yes", 1.0), (4, "a", "y", 7.0), (4, "b", "z", -2.0)], "k int, arm string, answer string, gamma double")
    arms = arms.withColumns({"agree": F.lit(None).cast("double"), "faith": F.lit(None).cast("double"), "p": F.lit(None).cast("double")})
    assert {r.k: (r.arm, r.score, r.signal) for r in A.arbitrate(arms, "k").collect()} == {1: ("a", 1.3, "gamma"), 2: ("b", 0.0, "fallback"), 3: ("b", 1.3, "gamma"), 4: ("a", 1.3, "gamma")}


def test_pool_ignores_arms_that_did_not_fire(spark):
    rows = [(1, "a", "x", 0.2, True, False), (1, "b", "x", 0.9, True, False), (1, "c", "x y z", 1.0, False, False), (1, "d", "", 1.0, True, False), (1, "e", "x", 1.0, True, True), (2, "a", None, 1.0, True, False)]
    arms = spark.createDataFrame(rows, "k int, arm string, answer string, gamma double, applicable boolean, is_fallback boolean").withColumns({"faith": F.lit(None).cast("double"), "p": F.lit(1.0)})
    whole = {r.k: tuple(r) for r in A.arbitrate_pool(arms, "k").collect()}
    assert whole[1][1:3] == ("b", "x") and whole[2] == (2, "", "", 0.0, "fallback")
    assert {r.k: tuple(r) for r in A.arbitrate_pool(arms.where("arm IN ('a', 'b') OR k = 2"), "k").collect()} == whole


def test_probable_modes(spark):
    rows = [(1, "iter", "Lyon", 0.4), (1, "v3bu", "Paris", 0.4), (1, "decompose", "the paris", 0.1), (2, "v3bu", "unknown", 0.9), (2, "iter", "none", 0.2), (3, "v3bu", None, 1.0), (4, "iter", "b", 0.45), (4, "v3bu", "c", 0.3), (4, "decompose", "C", 0.2)]
    arms = spark.createDataFrame(rows, "k int, arm string, answer string, p double")
    got = {m: {r.k: (r.answer, r.reason) for r in A.probable(arms, "k", m, 0.42).collect()} for m in ("argmax", "subset", "weighted_mix")}
    assert got["argmax"] == {1: ("Paris", "argmax:v3bu"), 2: ("unknown", "all_uncertain:v3bu"), 3: ("", "no_answers"), 4: ("b", "argmax:iter")}
    assert got["subset"][1] == ("Paris", "subset_fallback_argmax:v3bu") and got["subset"][4] == ("b", "subset:iter")
    assert got["weighted_mix"][1][0] == "Paris" and got["weighted_mix"][4][0] == "c"
    with pytest.raises(ValueError):
        A.probable(arms, "k", "other")


@pytest.mark.parametrize(("a", "b", "c", "want"), [("x", "x", "y", "x"), ("x", "y", "y", "y"), ("x", "y", "z", None), ("x", "y", "x", "x"), ("", "", "x", None), (None, "q", "q", "q"), ("p", "p", "p", "p")])
def test_consensus(spark, a, b, c, want):
    assert one(spark, A.consensus(F.col("a"), F.col("b"), F.col("c"), lambda x, y: x == y), a=a, b=b, c=c) == want


def test_index_changes(spark):
    index = spark.createDataFrame([("a#0", "a", "x"), ("a#1", "a", "y"), ("b#0", "b", "z")], "chunk_id string, doc_id string, text string")
    fresh = spark.createDataFrame([("a#0", "a", "new")], index.schema)
    assert sorted(r.text for r in I.upsert(index, fresh, "chunk_id").collect()) == ["new", "y", "z"]
    assert sorted(r.text for r in I.replace_documents(index, fresh).collect()) == ["new", "z"]
    assert I.delete(index, spark.createDataFrame([("zz",)], "chunk_id string"), "chunk_id").count() == 3


def test_pagerank_sums_to_one(spark):
    t = spark.createDataFrame([(1, "a", "r", "b", "c1", None), (2, "b", "r", "c", "c1", 0.5), (3, None, "r", "c", "c1", 0.5), (4, "hub", "r", "a", "c2", float("nan"))], "triple_id int, subject string, predicate string, object string, source_chunk_id string, confidence double")
    e = G.edges(t)
    assert {r.confidence for r in e.collect()} == {0.7, 0.5}
    rank = {r.node: r.score for r in G.pagerank(e, spark.createDataFrame([("a",)], "node string"), 4).collect()}
    assert sum(rank.values()) == pytest.approx(1.0) and max(rank, key=rank.get) == "a"


def test_anchor_paths_cross_chunks(spark):
    rng = random.Random(2)
    names, rows = [f"n{i}" for i in range(14)] + ["hub"] * 5, []
    for i in range(120):
        rows.append((i, rng.choice(names), rng.choice(["r", "s"]), rng.choice(names), f"c{i}", rng.choice([None, 0.0, 0.5, 0.9, 1.0, 1.7, float("nan")])))
    rows += [(200, "", "r", "n1", "c", 1.0), (201, "n1", "", "n2", "c", 1.0), (202, None, "r", "n1", "c", 1.0)]
    table, seen = {}, set()
    for _, s, p, o, _, c in rows:
        edge = f"{min(s or '', o)}|{p}|{max(s or '', o)}"
        if s and p and edge not in seen:
            seen.add(edge)
            for node in {s, o}:
                table.setdefault(node, []).append((edge, o if node == s else s, 0.7 if c is None or c != c else min(c, 1.0)))

    def walks(node, edges, confidence, depth):
        for edge, other, c in table.get(node, []) if depth else []:
            if edge not in edges:
                yield [*edges, edge], confidence * c
                yield from walks(other, [*edges, edge], confidence * c, depth - 1)

    t = spark.createDataFrame(rows, "triple_id int, subject string, predicate string, object string, source_chunk_id string, confidence double")
    anchors = spark.createDataFrame([(n,) for n in [*sorted(set(names)), "nowhere"]], "anchor string")
    for depth in (1, 2, 3):
        paths = G.anchor_paths(G.walk_edges(t), anchors, depth, 8)
        got, want = {}, {}
        for r in paths.collect():
            got[r.anchor, r["rank"]] = (r.path, round(r.confidence, 9))
        for n in set(names):
            for i, (edges, c) in enumerate(sorted(walks(n, [], 1.0, depth), key=lambda w: (-w[1], "->".join(w[0])))[:8], 1):
                want[n, i] = ("->".join(edges), round(c, 9))
        assert got == want
    ids = sorted(e for (n, _), (path, _) in want.items() if n == "hub" for e in path.split("->"))
    traversal = {r.anchor: r.traversal for r in G.path_hashes(paths, "anchor").collect()}
    assert traversal["hub"] == hashlib.sha1("".join(i + "\0" for i in ids).encode()).hexdigest()


def test_pagerank_of_each_question(spark):
    rng = random.Random(9)
    pairs = [(f"n{rng.randint(0, 12)}", f"n{rng.randint(0, 12)}") for _ in range(18)] + [("p", "q"), ("q", "p")]
    e = spark.createDataFrame([(a, b) for a, b in pairs if a != b], "subject string, object string")
    links = {(a, b) for x in pairs for a, b in (x, x[::-1]) if a != b}
    nodes = sorted({a for a, _ in links})
    seeds = {1: [nodes[0]], 2: [nodes[1], nodes[2]], 3: ["p"]}
    got = {(r.query_id, r.node): r.score for r in G.pagerank(e, spark.createDataFrame([(q, n) for q, ns in seeds.items() for n in ns], "query_id int, node string"), key="query_id").collect()}
    for q, ns in seeds.items():
        score = dict.fromkeys(nodes, 0.0)
        for _ in range(300):
            score = {n: 0.15 * (n in ns) / len(ns) + 0.85 * sum(score[a] / sum(x == a for x, _ in links) for a, b in links if b == n) for n in nodes}
        assert all(got.get((q, n), 0.0) == pytest.approx(score[n], abs=1e-7) for n in nodes)
    assert (3, nodes[0]) not in got


def test_pagerank_writes_no_ranks_down(spark, monkeypatch):
    rng = random.Random(11)
    pairs = {("hub", f"n{i}") for i in range(40)} | {(f"n{rng.randint(0, 39)}", f"m{rng.randint(0, 25)}") for _ in range(60)} | {("p", "q"), ("q", "p")} | {(f"c{i}", f"c{i + 1}") for i in range(200)}
    e = spark.createDataFrame(sorted(pairs), "subject string, object string")
    seeds = spark.createDataFrame([("a", "n1"), ("b", "n2"), ("b", "hub"), ("c", "p"), ("d", "n1"), ("f", "nowhere"), ("f", "q"), ("g", "c0"), *[(f"x{i}", f"m{i}") for i in range(12) if any(f"m{i}" in x for x in pairs)]], "k string, node string")
    kept, cuts = G.cut, []
    show = lambda df: {(r.k, r.node): r.score for r in df.collect()}
    with monkeypatch.context() as m:
        m.setattr(G, "cut", lambda df: cuts.append(1) or kept(df))
        m.setattr(G, "LAYERS", 4)
        m.setattr(G, "AT_ONCE", 3)
        m.setattr(G, "ROWS_AT_ONCE", 7)
        found = G.pagerank(e, seeds, key="k")
        assert len(cuts) == 1 and found.count() == found.select("k", "node").distinct().count()
        got, few = show(found), show(G.pagerank(e, seeds, 3, key="k"))
    assert sum(k == "g" for k, _ in got) == 201  # the far end of a chain, which no score reaches, too
    monkeypatch.setattr(G, "GRAPH_BYTES", -1)
    for mine, shuffled in ((got, show(G.pagerank(e, seeds, key="k"))), (few, show(G.pagerank(e, seeds, 3, key="k")))):
        assert shuffled.keys() <= mine.keys() and all(s == pytest.approx(shuffled.get(k, 0.0), abs=1e-7) for k, s in mine.items())
    assert few.keys() == shuffled.keys()


def test_pagerank_of_all_questions(spark, monkeypatch):
    asked = {r.answer_id for r in K.QUERIES["entity_links"](spark, SMALL).select("answer_id").distinct().collect()}
    show = lambda df: {(r.query_id, r.node): r.score for r in df.collect()}
    found = show(K.QUERIES["personalised_pagerank"](spark, SMALL))
    assert {q for q, _ in found} == asked and any(q % 100 for q in asked)
    own = {}
    for (q, _), score in found.items():
        own[q] = own.get(q, 0) + score
    assert all(abs(x - 1) < 1e-6 for x in own.values())
    monkeypatch.setattr(G, "KEYS_PER_SALT", 1)
    assert show(K.QUERIES["personalised_pagerank"](spark, SMALL)) == pytest.approx(found, abs=2e-9)


def test_cosine_of_zero(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b"))).first()
    assert row[0] is None


def test_loaders(spark, tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    (tmp_path / "A.TXT").write_bytes(b"caf\xe9")
    (tmp_path / "sub" / "b.md").write_text("# head")
    (tmp_path / "sub" / "deep" / "c.json").write_text('[\n {"text": "one", "k": 1},\n "two", 5, {"x": 2}\n]')
    (tmp_path / "sub" / "d.json").write_text('{\n "body": "solo", "source": "mine"}')
    (tmp_path / "e.JSONL").write_text('{"text": " ", "body": "from body"}\n\n"plain"\n[1]\n{"x": 1}\nbroken{')
    (tmp_path / "f.html").write_text("<html><head><title>t</title></head><body><nav>menu</nav><p>Hello &amp; bye</p><script>x</script></body></html>")
    (tmp_path / "g.docx").write_text("left out")
    found = {r.text: r.metadata for r in loaders.load(spark, str(tmp_path)).collect()}
    assert set(found) == {"caf\ufffd", "# head", "one", "two", '{"x":2}', "solo", "from body", "plain", '{"x": 1}', "Hello & bye"}
    assert found["solo"]["source"] == "mine" and found["one"]["k"] == "1" and found["one"]["index"] == "0" and found["# head"]["format"] == "markdown"
    assert [r.text for r in loaders.load(spark, str(tmp_path / "sub" / "b.md")).collect()] == ["# head"]
    with pytest.raises(NotImplementedError):
        loaders.load(spark, str(tmp_path / "g.docx"))
    (tmp_path / "h.xyz").write_text("x")
    with pytest.raises(ValueError):
        loaders.load(spark, str(tmp_path / "h.xyz"))
    (tmp_path / "empty").mkdir()
    assert loaders.load(spark, str(tmp_path / "empty")).count() == 0


def test_texts_from_memory(spark, tmp_path):
    (tmp_path / "a.txt").write_text("from a file")
    assert [r.text for r in loaders.from_texts(spark, str(tmp_path / "a.txt")).collect()] == ["from a file"]
    assert [r.text for r in loaders.from_texts(spark, "just a text").collect()] == ["just a text"]
    assert sorted((r.text, r.metadata.get("k")) for r in loaders.from_texts(spark, ["x", {"text": "y", "metadata": {"k": 1}}]).collect()) == [("x", None), ("y", "1")]
    with pytest.raises(TypeError):
        loaders.from_texts(spark, [3])


def test_question_sets_and_resume(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"id": "m1", "question": "q", "answer": "a", "paragraphs": [{"idx": 0, "title": "T", "paragraph_text": "x", "is_supporting": True}, {"idx": 1, "title": "U", "paragraph_text": "x", "is_supporting": False}]}]}))
    (tmp_path / "q.jsonl").write_text(json.dumps({"_id": "w1", "question": "q", "answer": "a", "supporting_facts": [["T", 3]]}) + "\n")
    q = corpus.normalize_questions(corpus.load_questions(spark, str(tmp_path / "q.json")), "paragraphs").first()
    assert (q.qid, q.aliases, [tuple(s) for s in q.supporting]) == ("m1", [], [("T", 0)])
    w = corpus.normalize_questions(corpus.load_questions(spark, str(tmp_path / "q.jsonl")), "evidence").first()
    assert (w.qid, [tuple(s) for s in w.supporting]) == ("w1", [("T", 3)])
    with pytest.raises(ValueError):
        corpus.normalize_questions(corpus.load_questions(spark, str(tmp_path / "q.jsonl")), "other")
    rows = spark.createDataFrame([("a", 1.0, 0.5), ("b", 0.0, 0.1)], "qid string, em double, f1 double")
    assert corpus.write_results(rows, str(tmp_path / "run")).first().n == 2
    left, sums = corpus.resume(spark.createDataFrame([("a",), ("c",)], "qid string"), rows)
    assert [r.qid for r in left.collect()] == ["c"] and tuple(sums.first()) == (1.0, 0.6)
    assert corpus.resume(left, None)[1].first().em == 0.0


def test_corpus_goes_on_where_it_stopped(spark, tmp_path):
    def write(docs):
        e = spark.createDataFrame([(d, d, "entity", "") for d in docs], corpus.ENTITY)
        r = spark.createDataFrame([("x", d, "triple", "r") for d in docs] * 2, corpus.EDGE)
        c = spark.createDataFrame([(f"{d}{i}", "t", d, [d]) for d in docs for i in range(2)], corpus.CHUNK)
        return {x.table: x.rows for x in corpus.write_corpus(e, r, c, str(tmp_path / "c")).collect()}

    assert write(["a", "b"]) == {"entities": 2, "edges": 2, "chunks": 4}
    assert write(["a", "b", "c"]) == {"entities": 1, "edges": 1, "chunks": 2}


def test_parsing(spark):
    get = lambda c, **v: one(spark, c, **v)
    raw = F.col("r")
    assert get(Y.sub_questions(raw), r='```json\n["a?", " b? "]\n```') == ["a?", "b?"] and get(Y.sub_questions(raw), r='["a", 3]') == [] and get(Y.sub_questions(raw), r=None) == []
    assert get(Y.text_list(raw, 2), r='x ["A", 3, "a", "b", "c"]') == ["A", "b"]
    assert get(Y.judge_scores(raw, F.lit(4)), r="[9, 40, \"x\"] ok") == [9.0, 10.0, 5.0, 5.0] and get(Y.judge_scores(raw, F.lit(2)), r="none") == [5.0, 5.0]
    assert tuple(get(Y.two_entities(raw), r='so {"e1": " A "}')) == ("A", "")
    assert get(Y.named_entities(raw), r='ok {"named_entities": ["A", "B"]} x') == ["A", "B"]
    assert get(Y.listed_triples(raw), r='{"triples": [["a", "b", "c"], ["d", "e"]]}') == [["a", "b", "c"]]
    assert get(Y.final_answer(raw), r="think\nFinal answer: Rome.\nmore") == "Rome" and get(Y.final_answer(raw), r="x\nParis. \n") == "Paris"
    step = get(Y.intermediate(raw), r="1. EXTRACT\n- f1\n* f2\n2. INTEGRATE\n- no\nMISSING: the year\nNEXT_QUERY: when")
    assert (step.answer, step.missing, step.next_query, step.facts) == (None, "the year", "when", ["f1", "f2"])
    assert get(Y.resolve(raw, F.array(F.lit("A$1"), F.lit("B"))), r="who is {prev} of {1} and {3}?") == "who is B of A$1 and ?"
    assert get(Y.balanced_object(raw), r='say {"a": "}{", "b": {"c": 1}} and {') == '{"a": "}{", "b": {"c": 1}}' and get(Y.balanced_object(raw), r="{ open") is None
    assert get(Y.seeded_query(raw, F.lit("Who met Ann Lee")), r="q") == "q Ann Lee" and get(Y.next_query(raw, F.array(F.lit("X")), F.lit("c")), r="q") == "q (entities seen: X, focus: c)"
    assert get(T.surface_key("r"), r="Café-Ünal ﬁ 東") == "cafe unal fi" and get(T.slug(raw), r=" Ann's  Big-Day! ") == "anns-big-day" and get(T.slug(raw), r="!?") == "unknown"


def test_proofs(spark):
    passages = spark.createDataFrame([("d1", "Rome is the capital of Italy. Italy is in Europe."), ("d1", "")], "doc_id string, text string")
    look = lambda n, s, o, span, doc="d1": (n, "lookup", "located_in", s, o, f"{s} {o}", doc, span, [], None)
    rule = lambda n, r, inputs, tag=None, p="located_in": (n, r, p, "Rome", "Europe", "c", None, None, inputs, tag)
    good = [look(1, "Rome", "Italy", "capital of  ITALY"), look(2, "Italy", "Europe", "Italy is in Europe")]
    trees = [
        ("chain", [*good, rule(3, "conjunction", [1, 2]), rule(4, "transitivity", [1, 2]), rule(5, "comparison_before", [1, 2], "temporal")], True, "Europe"), ("open", good, False, "x"),
        ("typed", [*good, rule(3, "transitivity", [1, 2], None, "likes")], True, "Europe"), ("late", [rule(1, "conjunction", [2, 3]), look(2, "Rome", "Italy", "Italy"), look(3, "Rome", "Italy", "Italy")], True, "zzz"),
        ("no span", [look(1, "Rome", "Italy", "not there")], True, "Italy"), ("no source", [look(1, "Rome", "Italy", "x", None)], True, "Italy"), ("unknown", [look(1, "Rome", "Italy", "x", "d9")], True, "Italy"),
        ("subject", [look(1, "Paris", "Italy", "capital of Italy")], True, "Italy"), ("object", [look(1, "Rome", "Spain", "capital of Italy")], True, "Italy"),
        ("refused", [rule(1, "negation_as_failure", [])], False, "REFUSE_NO_PROOF"), ("none", [], True, "x"), ("odd", [rule(1, "guess", [])], True, "x"),
    ]
    df = spark.createDataFrame(trees, f"k string, steps array<{V.STEP}>, is_complete boolean, answer string")
    got = {r.k: (r.status, r.liberal, [c.reason for c in r.checked]) for r in V.verify(df, "k", passages).collect()}
    assert got["chain"] == ("valid", "valid", ["valid"] * 5) and got["open"][0] == "partial"
    assert got["typed"][:2] == ("invalid", "valid") and got["late"][:2] == ("invalid", "invalid") and got["late"][2][0] == "invalid"
    assert {k: got[k][2] for k in ("no span", "no source", "unknown", "subject", "object")} == {"no span": ["span not found"], "no source": ["no source"], "unknown": ["unknown source"], "subject": ["subject not grounded"], "object": ["object not grounded"]}
    assert got["refused"][:2] == ("refuse", "refuse") and got["none"][:2] == ("valid", "invalid") and got["odd"][0] == "invalid"
    relaxed = spark.createDataFrame([("r", [look(1, "Rome", "Europe", "Rome is the capital")], True, "x")], df.schema)
    assert V.verify(relaxed, "k", passages).first().status == "invalid" and V.verify(relaxed, "k", passages, relaxed=True).first().status == "valid"
    tree = one(spark, V.parse_tree(F.col("r")), r=json.dumps({"steps": [{"step": 1, "rule": "lookup", "subject": "a", "source": {"doc_id": "d", "span_text": "s"}}, "bad", {"step": 2, "rule": "lookup", "sources": ["d2"]}], "is_complete": True, "naturalised_answer": "n"}))
    assert [(s.step, s.doc_id, s.span) for s in tree.steps] == [(1, "d", "s"), (2, "d2", "")] and tree.is_complete and tree.answer == "n"


def test_reach_against_brute_force(spark):
    rng = random.Random(4)
    names = [f"n{i}" for i in range(15)]
    rows = [(rng.choice(names), rng.choice(names), rng.choice([1.0, 0.9, 0.7, 0.5])) for _ in range(60)]
    e = spark.createDataFrame([(a, "r", b, "c", w) for a, b, w in rows if a != b], "subject string, predicate string, object string, chunk string, confidence double")
    near = {}
    for a, b, w in rows:
        if a != b:
            for x, y in ((a, b), (b, a)):
                near.setdefault(x, {})[y] = max(w, near.get(x, {}).get(y, 0))
    for k in (2, 5):
        got = {}
        for r in G.reach(e, spark.createDataFrame([(n,) for n in [*names, "nowhere"]], "source string"), 3, k).collect():
            got.setdefault(r.source, []).append((r["rank"], r.node, round(r.confidence, 9)))
        for n in near:
            best, frontier = {n: (0.0 - 1, 0)}, {n: 1.0}
            found, walks = {}, [(n, 1.0)]
            for hop in range(1, 4):
                walks = [(y, c * w) for x, c in walks for y, w in near[x].items() if y != n]
                for y, c in walks:
                    found[y] = min(found.get(y, (0, 9)), (-round(c, 12), hop))
            want = sorted((v[0], v[1], y) for y, v in found.items())[:k]
            assert [(y, round(c, 9)) for _, y, c in sorted(got[n])] == [(y, round(-c, 9)) for c, _, y in want], (n, k)
    assert "nowhere" not in got


def test_reach_without_paths_and_salts(spark, monkeypatch):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(30)]
    rows = [(a, "r", b, "c", rng.choice([1.0, 0.9, 0.7, 0.5])) for a in names for b in ["hub", *rng.sample(names, 2)] if a != b]
    e, src = spark.createDataFrame(rows, "subject string, predicate string, object string, chunk string, confidence double"), spark.createDataFrame([(n,) for n in names], "source string")
    show = lambda df: {(r.source, r["rank"]): (r.node, round(r.confidence, 9)) for r in df.collect()}
    kept, cuts = G.cut, []
    want = show(G.reach(e, src, 3, 6))
    monkeypatch.setattr(G, "PATHS_PER_SALT", 3)
    monkeypatch.setattr(G, "cut", lambda df: cuts.append(kept(df)) or cuts[-1])
    assert show(G.reach(e, src, 3, 6, paths=False)) == want == show(G.reach(e, src, 3, 6))
    assert cuts[0].columns == ["from", "to", "c"] and cuts[0].count() == cuts[0].distinct().count() and all("path" not in x.columns for x in cuts[:4])


def test_neighbourhood_as_reach(spark, monkeypatch):
    rng = random.Random(6)
    names = [f"n{i}" for i in range(30)] + ["ñandú"]
    rows = [(a, "r", b, "c", rng.choice([1.0, 0.9, 0.7, 0.5])) for a in names for b in ["hub", *rng.sample(names, 2)] if a != b]
    e, src = spark.createDataFrame(rows, "subject string, predicate string, object string, chunk string, confidence double"), spark.createDataFrame([(n,) for n in [*names, "hub", "nowhere"]], "source string")
    for hops, k in ((1, 3), (2, 6), (3, 40)):
        show = lambda df: {(r.source, r.node) for r in df.collect()}
        want = show(G.reach(e, src, hops, k))
        assert show(G.neighbourhood(e, src, hops, k)) == want and len(want) > 60
        monkeypatch.setattr(G, "GRAPH_BYTES", 0)
        assert show(G.neighbourhood(e, src, hops, k)) == want
        monkeypatch.undo()


def test_chain_coherence_and_spine(spark):
    hops = spark.createDataFrame([("q", 1, "Ann Lee", "x"), ("q", 2, "Rome", "where Ann Lee lived"), ("q", 3, "1901", "nothing"), ("one", 1, "a", None), ("bad", 1, None, "x"), ("bad", 2, "y", "z")], "k string, hop int, answer string, context string")
    assert {r.k: (r.coherent, r.broken_at) for r in C.coherence(hops, "k").collect()} == {"q": (False, 2), "one": (True, None), "bad": (False, 1)}
    p = spark.createDataFrame([("q", 1, "none"), ("q", 2, "B here"), ("q", 3, "a and b"), ("q", 4, None)], "k string, place int, text string").withColumn("spine", F.array(F.lit("A and"), F.lit("b")))
    assert [r.place for r in C.along_spine(p, "k", "spine", "text", "place").orderBy("position").collect()] == [3, 2, 1, 4]


def test_anchor_groups_and_routes(spark):
    rng = random.Random(8)
    rows = [(f"c{i}", i % 3, [rng.gauss(i % 2 * 9, 0.1), 1.0, rng.random()]) for i in range(24)] + [("lone", 9, [1.0, 0.0, 0.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id int, vector array<double>")
    parts = {r.chunk_id: (r.doc_id, r.part) for r in H.chunk_groups(chunks, 3).collect()}
    assert len(parts) == 24 and all(0 <= p < 3 for _, p in parts.values())
    top = spark.createDataFrame([(1, 1, "a", 3, "p", 0.9), (2, 1, "a", 4, None, 0.8), (3, 1, "a", 2, None, 0.5), (3, 2, "b", 2, None, 0.4), (4, 1, "a", 2, None, 0.1), (4, 2, "t", 1, None, 0.1), (5, 1, "a", 2, None, 0.1)], "query_id int, rank int, anchor string, layer int, parent string, score double")
    got = {r.query_id: (r.route, r.anchors) for r in H.route(top, spark.createDataFrame([("a", 10)], "anchor string, n bigint")).collect()}
    assert got == {1: ("escalate-parent", ["p", "a"]), 2: ("high-conf", ["a"]), 3: ("warm-up", ["a", "b"]), 4: ("fallback-l1", ["t", "a"]), 5: ("low-conf-no-l1", ["a"])}


def test_linear_percentiles(spark):
    rng = random.Random(2)
    rows = [("a", float(rng.randint(0, 9))) for _ in range(57)] + [("b", 3.5), (None, 1.0), (None, 2.0)]
    got = {(r.g, r.p): r.v for r in M.exact_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.25, 0.5, 0.99], linear=True).collect()}
    for g in ("a", "b", None):
        v = sorted(x for k, x in rows if k == g)
        for p in (0.25, 0.5, 0.99):
            at = p * (len(v) - 1)
            assert got[g, p] == pytest.approx(v[math.floor(at)] + (at - math.floor(at)) * (v[math.ceil(at)] - v[math.floor(at)]))


def test_question_features_in_hard_cases(spark):
    rows = spark.createDataFrame([(None,), ("",), ("¿Quién?",), ("Is Ann older than Bob?",), ("Who is Ann Lee's maternal grandfather?",), ("Who is the spouse of the director of the film of Jim?",)], "q string")
    f = Q.features(F.col("q"))
    got = [r.c for r in rows.select(Q.class_v2(f).alias("c")).collect()]
    assert got == ["semantic_rich"] * 4 + ["semantic_rich", "chain_deep"]
    assert [r.p for r in rows.select(Q.is_polar(F.col("q")).alias("p")).collect()] == [False, False, False, True, False, False]
    assert [r.x for r in rows.select(Q.features(F.col("q"))["is_kinship_possessive"].alias("x")).collect()][4]


def test_infobox_nests(spark):
    text = "{{Infobox person\n| name = [[Ann Lee|Ann]]\n| birth_date = {{birth date|1900|{{x|2}}|df=y}}\n| image = a.jpg\n| spouse = <!-- none -->\n| known for = a {{b|c}} d\n}} tail | no = row"
    rows = {(r.subject, r.attribute): r.value for r in X.infobox_triples(spark.createDataFrame([(1, text), (2, None), (3, "infobox"), (4, "{{infobox\n| x = [[Q]]")], "doc_id int, text string")).collect()}
    assert rows == {("Ann", "birth_date"): "1900 2", ("Ann", "known for"): "a c d"}
    keys = spark.createDataFrame([("Date of birth",), ("Spouses",), ("HQ",), (None,)], "a string").select(X.attribute_key(F.col("a")).alias("k")).collect()
    assert [r.k for r in keys] == ["born", "spouse", "headquarters", ""]
