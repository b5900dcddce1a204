"""The operators for training data against brute force, round trips, constructed cases and hostile tables."""

import base64
import datetime
import os
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from lodestone.llm import mixing, names, neighbours, qa_pairs, quantiles, queries, sentences, tokens, truncation
from lodestone.session import cut as keep

WORD_LISTS = ["plain words here", "it's I'll we've", "  two  blanks\n\n\ttabs ", "数字123と漢字。", "naïve café ŒUVRE", "<|endoftext|> is text", "a" * 400, "👍🏽 emoji 👩‍👩‍👧", "สวัสดีครับ", "x y　z", "١٢٣ ½ ²", "\r\n", " "]


def encoder():
    tiktoken = pytest.importorskip("tiktoken")
    path = os.path.join(tokens.TOKENIZERS, tokens.VOCABULARY)
    if not os.path.exists(path):
        pytest.skip("no vocabulary")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


# 6


def test_ids_equal_the_public_encoder(spark):
    enc = encoder()
    texts = [*WORD_LISTS, "", None, *(r["text"] for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist())]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(0, texts[0], "again", 2)], "doc_id bigint, text string, ids string, word int")
    got = tokens.token_ids(docs)
    rows = got.withColumn("back", tokens.decode_ids(F.col("ids"), tokens.read_ranks())).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == enc.encode_ordinary(texts[r.doc_id] or "") and r.back == (texts[r.doc_id] or "")
    assert tokens.token_ids(docs.where("doc_id < 0")).count() == 0


def test_long_word(spark):
    word = "".join(random.Random(1).choices("abcdefgh", k=3000))
    ids = tokens.token_ids(spark.createDataFrame([(1, word)], "doc_id bigint, text string")).first().ids
    assert ids == encoder().encode_ordinary(word)


# 7


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, "big" if i % 3 else "small" if i % 2 else None, rng.randint(1, 400)) for i in range(6000)] + [(9000, "big", 0), (9001, "none", 0)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("m", "big", 0.5, 2, 0.8), ("m", "small", 0.3, 4, 0.8), ("m", "none", 0.1, 9, 0.8), ("m", "gone", 0.1, 3, 0.8), ("m", "gone", 0.1, 3, 0.8), ("n", "big", None, 1, 1.0), ("n", "small", 0.9, None, 1.0)], "mix_id string, source string, target_share double, max_repeats int, budget_ratio double")
    solved = mixing.solve(sizes, targets)
    copies = mixing.copies(sizes, solved)
    total = sum(n for _, _, n in rows)
    shares = {(r.mix_id, r.source): r for r in mixing.shares(solved, copies).collect()}
    assert len(shares) == 6
    for s, share in (("big", 0.5), ("small", 0.3)):
        assert abs(shares["m", s].tokens - share * 0.8 * total) < 0.005 * total
    assert not shares["m", "gone"].reachable and not shares["m", "none"].reachable and not shares["n", "small"].reachable
    assert shares["n", "big"].tokens == 0
    assert copies.where("(source = 'big' AND copies > 2) OR (source = 'small' AND copies > 4)").count() == 0
    assert mixing.solve(sizes.where("doc_id < 0"), targets).count() == 6
    assert mixing.solve(sizes, targets.where("mix_id = 'x'")).count() == 0


# 5


def test_relative_rank_error(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.lognormal(3, 2, 60_000), np.repeat(5.0, 20_000)])
    parts = [spark.createDataFrame([(("hot" if i % 3 else "cold"), float(v)) for i, v in enumerate(values[k::4])], "g string, v double") for k in range(4)]
    sketches = [quantiles.merge(quantiles.sketch(p.repartition(3), ["g"], "v"), ["g"]) for p in parts]
    both = sketches[0].unionByName(sketches[1]).unionByName(sketches[2].unionByName(sketches[3]))
    ps = [0.5, 0.9, 0.99, 0.999]
    got = {r.g: r for r in quantiles.percentiles(quantiles.merge(both, ["g"]), ["g"], ps).collect()}
    exact = {g: np.sort([v for k in range(4) for i, v in enumerate(values[k::4]) if ("hot" if i % 3 else "cold") == g]) for g in ("hot", "cold")}
    for g, v in exact.items():
        assert got[g].n == len(v)
        for p, x in zip(ps, got[g].percentiles):
            want, low, high = int(np.ceil(p * len(v))), np.searchsorted(v, x, "left") + 1, np.searchsorted(v, x, "right")
            assert max(0, low - want, want - high) <= 0.03 * (len(v) - want + 1) + 1


def test_measured_values_only(spark):
    day = datetime.datetime(2024, 1, 2, 3)
    rows = [(1, "a", "Multi-Hop", 5.0, 1.0), (1, "a", "Multi-Hop", 5.0, 1.0), (2, "a", "multihop", float("nan"), None), (3, "a", None, -1.0, 2.0), (4, None, "", 7.0, float("inf"))]
    df = spark.createDataFrame([(*r, day, "x") for r in rows], "run_id bigint, arm string, category string, latency_ms double, cost_cents double, run_at timestamp, value string")
    got = sorted((r.arm or "", r.category, r.metric, r.value) for r in quantiles.measured(df).collect())
    assert got == [("", "unknown", "latency_ms", 7.0), ("a", "multihop", "cost_cents", 1.0), ("a", "multihop", "latency_ms", 5.0), ("a", "unknown", "cost_cents", 2.0)]
    assert quantiles.rollup(quantiles.daily_sketches(df.where("run_id < 0"))).count() == 0


# 1


def test_neighbours_of_all_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 16))
    x = np.concatenate([base, base[:60] + 0.05 * rng.normal(size=(60, 16)), np.repeat(base[:1], 20, axis=0)])
    rows = [(i, [float(c) for c in v], "z") for i, v in enumerate(x)] + [(5, [float(c) for c in x[5]], "twice"), (1000, None, ""), (1001, [0.0] * 16, ""), (1002, [1.0] * 3, ""), (1003, [float("nan")] * 16, ""), (None, [1.0] * 16, "")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, s string")
    got = neighbours.similar(df, "vec_id", "embedding", 16, k=10).groupBy("id").agg(F.collect_set("neighbour").alias("n"), F.max("rank").alias("k")).collect()
    assert len(got) == len(x) and all(r.k == 10 for r in got)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 6)
    np.fill_diagonal(s, -2)
    hits = sum(len(set(np.lexsort((np.arange(len(x)), -s[r.id]))[:10]) & set(r.n)) for r in got)
    assert hits >= 0.98 * 10 * len(x)
    assert neighbours.similar(df.where("vec_id = 1000"), "vec_id", "embedding", 16).count() == 0


def test_least_cosine_is_tested_in_double_precision(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 2, 64)).astype(np.float32)
    x[:, 1] = x[:, 0] + 0.6 * x[:, 1]
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=2, keepdims=True)
    exact = np.einsum("ij,ij->i", unit[:, 0], unit[:, 1])
    single = np.einsum("ij,ij->i", unit[:, 0].astype(np.float32), unit[:, 1].astype(np.float32))
    for i in np.argsort(single - exact)[:2]:  # single precision is below the exact cosine
        least = float(exact[i] - 1e-12)
        df = spark.createDataFrame([(n, [float(c) for c in x[i, n]]) for n in (0, 1)], "vec_id bigint, embedding array<float>")
        got = neighbours.similar(df, "vec_id", "embedding", 64, least=least, probes=queries.P1_PROBES).collect()
        assert sorted((r.id, r.neighbour) for r in got) == [(0, 1), (1, 0)] and got[0].similarity == pytest.approx(exact[i], abs=1e-12)


def test_recall_holds_with_more_parts():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(1000, 32))
    x = (np.repeat(centres, 8, axis=0) + 0.25 * rng.normal(size=(8000, 32))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = neighbours.neighbour_graph(x, 10)
    true = ((x[:, None, :] * x[graph]).sum(axis=2) >= 0.85).ravel()
    recall = {}
    for parts in (16, 64, 128):
        w, b = neighbours.train(x, graph, neighbours.balanced_parts(x, graph, parts), parts)
        order = np.argsort(-(x @ w + b), axis=1)
        at = np.take_along_axis(np.argsort(order, axis=1), order[graph, 0], axis=1).ravel()
        recall[parts] = (at < neighbours.probed(queries.P1_PROBES, parts))[true].mean()
    assert recall[16] > 0.97 and min(recall[64], recall[128]) >= recall[16]


def test_crowded_groups_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 16))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(neighbours, "BLOCK", 150)
    got = {(r.id, r["rank"]): r.neighbour for r in neighbours.similar(df, "vec_id", "embedding", 16, k=5, queries=F.col("vec_id") % 10 == 0).collect()}
    s = (u := x / np.linalg.norm(x, axis=1, keepdims=True)) @ u.T
    np.fill_diagonal(s, -2)
    assert got == {(i, r + 1): n for i in range(0, 500, 10) for r, n in enumerate(np.argsort(-s[i])[:5])}


def test_parts_of_parts(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(400, 16))
    x = (np.repeat(centres, 10, axis=0) + 0.2 * rng.normal(size=(4000, 16))).astype(np.float32)
    x[:1300] = (centres[0] + 0.5 * rng.normal(size=(1300, 16))).astype(np.float32)  # a third of all rows lies together
    df = keep(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>"))
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    true = {(i, n) for i in range(len(x)) for n in np.argsort(-s[i])[:10] if s[i, n] >= 0.85}
    monkeypatch.setattr(neighbours, "PART_ROWS", 32)
    monkeypatch.setattr(neighbours, "MOST_PARTS", 8)
    monkeypatch.setattr(neighbours, "BLOCK", 700)
    member = neighbours.usable(df, "vec_id", "embedding", 16)
    model = neighbours.fit(member, 16, len(x))
    assert model.w.shape == (16, 8) and model.ws.shape == (8, 16, 8) and model.parts == 64
    assert np.bincount(model.best(unit.astype(np.float32), 1)[1], minlength=64).max() < 800
    share = {}
    for most in (8, 64):  # two levels, and one
        monkeypatch.setattr(neighbours, "MOST_PARTS", most)
        found = {(r.id, r.neighbour) for r in neighbours.similar(df, "vec_id", "embedding", 16, k=10, least=0.85, probes=queries.P1_PROBES).collect()}
        assert all(s[i, n] >= 0.85 for i, n in found)
        share[most] = len(true & found) / len(true)
    assert share[8] >= 0.93 and share[8] >= share[64] - 0.03
    monkeypatch.setattr(neighbours, "MOST_PARTS", 8)
    every = {(r.id, r.neighbour) for r in neighbours.similar(df, "vec_id", "embedding", 16, k=10, least=0.85, probes=64).collect()}
    assert every == true


def test_learned_parts_are_balanced_and_found():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = (np.repeat(centres, 50, axis=0) + 0.2 * rng.normal(size=(2000, 16))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = neighbours.neighbour_graph(x, 10)
    part = neighbours.balanced_parts(x, graph, 16)
    assert np.bincount(part, minlength=16).min() >= 0.9 * 2000 / 16
    w, b = neighbours.train(x, graph, part, 16)
    top = np.argsort(-(x @ w + b), axis=1)[:, :3]
    stored = np.argmax(x @ w + b, axis=1)
    assert np.mean([(stored[g] [:, None] == t[None, :]).any(axis=1).mean() for g, t in zip(graph, top)]) > 0.9


# 3


def test_cut_texts(spark):
    rng = random.Random(0)
    nouns, places = "bridge tower harbour library museum".split(), "Arden Bolwick Carrow Dunmore".split()
    sentence = lambda: f"The {rng.choice(nouns)} of {rng.choice(places)} was {rng.choice(['rebuilt', 'closed', 'founded'])} in {rng.randint(1500, 1999)} by the council."
    whole = [" ".join(sentence() for _ in range(rng.randint(1, 6))) for _ in range(400)]
    spiked = [(" ".join(sentence() for _ in range(9)))[:300] for _ in range(60)]
    torn = [w[: len(w) - 12] for w in whole[:30]]
    rows = [(i, "a", t) for i, t in enumerate(whole)] + [(1000 + i, "b", t) for i, t in enumerate(spiked)] + [(2000 + i, None, t) for i, t in enumerate(torn)]
    rows += [(3000, "a", None), (3001, "a", ""), (3002, "a", " \n"), (3003, "a", '{"answer": "x", "why": "the'), (3004, "a", "Arden Bolwick"), (3005, "a", "1620"), (3006, "a", '{"answer": "x"}'), (0, "a", whole[0])]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "response_id bigint, provider string, text string, n_output_tokens int, word string")
    got = {r.response_id: r.cut for r in truncation.find_cut(df).collect()}
    assert len(got) == len(rows) - 1
    assert not any(got[i] for i in range(400)) and not any(got[i] for i in (3000, 3001, 3002, 3004, 3005, 3006)) and got[3003]
    open_ended = [i for i, t in enumerate(spiked) if not t.endswith(".")]
    assert sum(got[1000 + i] for i in open_ended) >= 0.95 * len(open_ended)
    assert sum(got[2000 + i] for i in range(30)) >= 27
    assert truncation.find_cut(df.where("response_id < 0")).count() == 0
    assert {r.provider: r.n for r in truncation.rates(truncation.find_cut(df)).collect()}[None] == 30


# 2


def test_defects_on_made_pairs(spark):
    rng = random.Random(4)
    towns = "Arden Bolwick Carrow Dunmore Elsby Farrow".split()
    rows, want = [], {}
    for i in range(600):
        q = f"Why did {rng.choice(towns)} Smith leave the old town of {rng.choice(towns)}?"
        good = f"{rng.choice(towns)} Smith left because the {rng.choice(['tower', 'library', 'harbour'])} had been sold to the council in {rng.randint(1500, 1900)}."
        kind = i % 12
        bad = {0: "  ", 1: good[: len(good) // 2], 2: "The passages do not say.", 3: f'"{q}"', 4: "Город был основан очень давно.", 5: None}.get(kind, good)
        rows.append((i, q, bad, good, None, None, "x"))
        want[i] = {0: "empty", 1: "truncated", 2: "refusal", 3: "copied_question", 4: "other_language", 5: "empty"}.get(kind)
    rows += [(9000, None, None, None, None, None, "x"), (1, *rows[1][1:])]
    df = spark.createDataFrame(rows, "answer_id bigint, question string, pred string, gold string, v3bu_pred string, dec_pred string, side string")
    got = {}
    for r in qa_pairs.find_defects(df).collect():
        got.setdefault((r.answer_id, r.side), set()).add(r.defect)
    right = sum(got.get((i, "pred"), set()) == ({w} if w else set()) for i, w in want.items())
    assert right >= 0.95 * len(want)
    assert sum(bool(got.get((i, "gold"))) for i in want) <= 6
    assert got[9000, "pred"] == {"empty"}
    assert qa_pairs.find_defects(df.where("answer_id < 0")).count() == 0


# 4


def test_common_keys_lose_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(2)
    letters = list("abdeilmnorst")
    base = {"".join(rng.choice(letters, size=int(rng.integers(4, 26)))) + "burg" for _ in range(60)}
    words = set(base)
    for w in base:
        for edits in (1, 2):
            v = list(w)
            for _ in range(edits):
                i, how = int(rng.integers(0, len(v))), int(rng.integers(0, 3))
                v[i : i + 1] = [[], [v[i], "x"], ["x"]][how]
            words.add("".join(v))
    rows = [(w, 9 if w in base else 1, 9) for w in sorted(words)]
    df = keep(spark.createDataFrame(rows, "w string, spellings bigint, n bigint"))
    none = spark.createDataFrame([], "w string, p string")
    got = []
    for common in (10**6, 1):
        monkeypatch.setattr(names, "COMMON", common)
        got.append({tuple(r) for r in names.respell(df, none).collect()})
    assert got[0] == got[1] and len(got[0]) > 60
    assert {r[0] for r in spark.createDataFrame([("abc",)], "w string").select(F.explode(names.rests(F.col("w")))).collect()} == {"abc", "bc", "ac", "ab"}


def test_variants_link_and_relatives_do_not(spark):
    groups = [
        ["Eleanor Vaburofenku", "Eleanor Vaburofenku ", "ELEANOR VABUROFENKU", "Nell Vaburofenku", "Vaburofenku, Eleanor", "E. Vaburofenku", "Eleanor Vabrofenku", "Dr. Eleanor Vaburofenku", "Eleanor Vaburo fenku"],
        ["Richard Vaburofenku", "Dick Vaburofenku", "R. Vaburofenku", "Richard Váburofenku"],
        ["Saint Dufenbririmi", "St. Dufenbririmi", "Dufenbririmi, Saint", "Saint Dufenbririmi (town)"],
        ["Dufenbririmi Academy of Letters", "Academy of Letters, Dufenbririmi", "Dufenbririmi Acad. of Letters", "Dufenbririmi A.o.L."],
        ["The Road of Zeminukelvin", "Zeminukelvin's Road", "Road of Zeminukelvin, The"],
    ]
    every = [n for g in groups for n in g]
    openie = spark.createDataFrame([("c", every + [None, "", every[0]]), ("d", None), ("e", [])], "chunk_id string, entities array<string>")
    triples = spark.createDataFrame([(None, "1899"), (every[0], ""), ("12 inhabitants", "12  inhabitants")], "subject string, object string")
    got = {(r.name_a, r.name_b) for r in names.variants(names.entities(names.table_names(openie, triples))).collect()}
    want = {(min(a, b), max(a, b)) for g in groups for a in g for b in g if a != b}
    assert not got - want
    assert len(got & want) >= 0.9 * len(want)
    assert names.entities(names.table_names(openie.where("chunk_id = 'e'"), triples.where("subject = 'x'"))).count() == 0


# 8

CASES = [
    ["Dr. Ann B. Lee left at 5 p.m. with J. K. Roe.", "She met Mr. Poe (see p. 4).", '"Why not?" Lee asked.', "It cost 3.5 million."],
    ["他说“不！”就离开了。", "他回答：“也许明天。”", "真的吗？！"],
    ["« Où est la gare ? » demanda Paul.", "Quel hiver !"],
    ["Какая это была зима!", "Дом № 5 по ул. им. Попова сгорел в 1649 г.", "Музей открыт с 2.30 до 17.00."],
    ["यह नगर नदी के किनारे है।", "पुल की लंबाई 26.6 कि.मी. है।"],
    ["Ποιος πούλησε τον μύλο;", "Τι χειμώνας!"],
]


@pytest.mark.parametrize("case", CASES)
def test_sentence_boundaries(case):
    model = sentences.Model()
    text = ("" if case[0][0] > "　" else " ").join(case)
    assert [text[a:b] for a, b in model.units(text)] == case


def test_units_cover_everything(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n "), (-4, "no end " * 3000), (-5, "== H ==\n- a\n- b\n\nQ: x? y?\nA: z.")], "doc_id bigint, text string")
    every = docs.select("doc_id", "text").unionByName(extra)
    units = {}
    for r in sentences.sentence_units(every.unionByName(extra)).collect():
        units.setdefault(r.doc_id, []).append((r.sent_start, r.sent_end))
    for d, t in every.collect():
        spans, at = sorted(units.get(d, [])), 0
        for a, b in spans:
            assert a < b and t[at:a].strip() == "" and t[a:b] == t[a:b].strip()
            at = b
        assert (t or "")[at:].strip() == ""
    assert len(units[-5]) == 5 and not {-1, -2, -3} & set(units)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    assert df.count() > 0 or name == "p7_found"


def test_edges_are_counted_over_all_texts():
    texts = ["Dr. Lee came. He left.", "Dr. Ray sat.\n\n== Head ==\n\nHe saw Dr. Fox. Then he ate.", ""]
    counts = sentences.edge_counts(texts)
    assert counts["end", "dr"] == [0, 3] and counts["end", "left"] == [1, 0] and counts["end", "came"] == [0, 1] and ("end", "head") not in counts
    scores = sentences.edge_scores([("end", "dr", 0, 60), ("end", "ate", 40, 20), ("end", "rare", 0, 1)])
    assert scores["end"]["dr"] < -2 < 0 < scores["end"]["ate"] and "rare" not in scores["end"]


def test_copies_of_a_text_are_decoded_once(spark):
    docs = spark.createDataFrame([(1, "One is here. Two is there."), (2, "One is here. Two is there."), (2, "One is here. Two is there."), (3, " "), (4, None)], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in sentences.sentence_units(docs).collect()) == [(1, 0, 12), (1, 13, 26), (2, 0, 12), (2, 13, 26)]


def test_names_with_digits(spark):
    strings = ["Apollo 11", "apollo 11", "APOLLO  11.", "Apollo 12", "12 May 1914", "12 may 1914", "May 12, 1914", "13945 inhabitants", "ca. 1958", "4.0 km", "1914", ""]
    found = names.collect_names(spark.createDataFrame([(s,) for s in strings], "n string"))
    assert {r.name for r in found.collect()} == {"Apollo 11", "apollo 11", "APOLLO  11.", "Apollo 12"}
    pairs = {tuple(r) for r in names.variants(names.entities(found)).collect()}
    assert pairs == {("APOLLO  11.", "Apollo 11"), ("APOLLO  11.", "apollo 11"), ("Apollo 11", "apollo 11")}


def test_short_forms_follow_from_the_corpus(spark):
    strings = ["Marvirokowen Shipping Co.", "Marvirokowen Shipg. Co.", "Gobugafene Printing Co.", "Gobugafene Prtg Co.", "Olvirasten Timber Co.", "Olvirasten Tmbr. Co."]
    found = {tuple(r) for r in names.variants(names.entities(names.collect_names(spark.createDataFrame([(s,) for s in strings], "n string")))).collect()}
    assert ("Marvirokowen Shipg. Co.", "Marvirokowen Shipping Co.") in found and ("Olvirasten Timber Co.", "Olvirasten Tmbr. Co.") in found
    assert ("Gobugafene Printing Co.", "Gobugafene Prtg Co.") in found and len(found) == 3


def test_sketches_merge_in_a_tree(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(quantiles, "FAN", 24)
    monkeypatch.setattr(quantiles, "CHUNK_SKETCHES", 50)
    values = np.random.default_rng(5).lognormal(size=30_000)
    df = spark.createDataFrame([("hot" if i % 3 else f"k{i % 40}", float(v)) for i, v in enumerate(values)], "k string, v double").repartition(12)
    got = {r.k: (r.n, r.percentiles) for r in quantiles.percentiles(quantiles.merge(quantiles.sketch(df, ["k"], "v"), ["k"]), ["k"], [0.5, 0.99, 0.999]).collect()}
    hot = sorted(v for i, v in enumerate(values) if i % 3)
    assert got["hot"][0] == len(hot) == 20_000 and sum(n for n, _ in got.values()) == 30_000
    for p, x in zip((0.5, 0.99, 0.999), got["hot"][1]):
        assert abs(sum(v > x for v in hot) - (1 - p) * len(hot)) <= 0.06 * (1 - p) * len(hot) + 1


def test_planted_pairs_stay_out_of_the_counts(spark):
    rows = [("was the mill old", False), ("der alte Turm und das Tor", False)] + [("los ríos de la tierra y el mar", True)] * 50
    known = {r.text: r.spoken for r in qa_pairs.languages(spark.createDataFrame(rows, "text string, planted boolean")).collect()}
    assert known["der alte Turm und das Tor"] == "de" and known["los ríos de la tierra y el mar"] == "es"
    ends = qa_pairs._ends(spark.createDataFrame([("It was near the mill", True)] * 30 + [("the mill closed", False)], "text string, planted boolean"))
    assert {r.text for r in ends.collect()} == {"It was near the mill", "the mill closed"} and not any(r.no_end for r in ends.collect())
