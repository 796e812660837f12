import hashlib
import itertools
import math
import re
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/", 1)[0])

import data  # noqa: E402
from sparkprep.llm import charnet, forest, lattice_lm, resampling, warc  # noqa: E402
from sparkprep.llm.common import held_out  # noqa: E402

with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
    PIECES = file.read()


def nearest(vectors, query_id, k):
    own = [v for i, v in vectors if i == query_id][0]
    found = [(-float((np.array(v, dtype=float) * np.array(own, dtype=float)).sum()), i) for i, v in vectors if i != query_id]
    return sorted(found)[:k]


def test_forest_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    points = centres[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    vectors = [(i, [float(np.float32(x)) for x in p]) for i, p in enumerate(points)]
    vectors += [(3000 + i, vectors[7][1]) for i in range(400)]  # a hot vector
    odd = [(5001, None), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [None] * 16), (5005, [1.0, 2.0]), (5006, [float("inf")] * 16), (None, vectors[1][1])]
    table = spark.createDataFrame([(i, v, 1, 2, 0.0) for i, v in vectors + odd], "vec_id long, embedding array<float>, rank int, d long, score double")
    got = {}
    for r in forest.search(table, F.col("id") % 100 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {i for i, _ in vectors if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        want = nearest(vectors, q, 20)
        assert len(found) == 20 and q not in {i for i, _ in found}
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in found} & {i for _, i in want})
    assert hits >= 0.9 * 20 * len(got)


def test_forest_small_and_empty(spark):
    schema = "vec_id long, embedding array<double>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 2.0])], schema)
    rows = [tuple(r) for r in forest.search(few, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert rows == [(0, 1, 20, 0.5), (0, 2, 3, 0.0), (20, 1, 3, 1.0), (20, 2, 0, 0.5)]
    assert forest.search(spark.createDataFrame([], schema), F.col("id") % 20 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0, 0.0])], schema)
    assert forest.search(alone, F.col("id") % 20 == 0).count() == 0


def brute_lattice(model: lattice_lm.Lattice, word: str) -> float:
    """Sum over all ways to cut the word."""
    spelled = lattice_lm.START + word
    total = 0.0
    for cuts in itertools.product((0, 1), repeat=len(spelled) - 1):
        pieces, last = [], 0
        for i, cut in enumerate([*cuts, 1], 1):
            if cut:
                pieces.append(spelled[last:i])
                last = i
        chance = 1.0
        for p in pieces:
            if p in model.pieces:
                chance *= math.exp(model.pieces[p])
            elif len(p) == 1 and p not in model.single:
                chance *= math.exp(sum(model.bytes[b] for b in p.encode()))
            else:
                chance = 0.0
        total += chance
    return math.log(total) + model.stop


def test_lattice_sums_all_segmentations():
    size = lattice_lm.processor(PIECES).get_piece_size()
    model = lattice_lm.Lattice(PIECES, np.zeros(size), 10.0)
    for word in ("a", "the", "nation", "zq!x", "été", "\U0001f600a"):
        assert model.log_probability(word) == pytest.approx(brute_lattice(model, word))
    assert model.log_probability("x" * 5000) < -3000
    steps = sum(map(math.exp, model.pieces.values())) + sum(map(math.exp, model.bytes)) + math.exp(model.stop)
    assert steps <= 1 + 1e-9


def test_document_scores(spark):
    docs = data.documents(spark)
    marked = held_out("doc_id", 7)
    got = lattice_lm.score(docs, marked, PIECES, block_chars=2000)
    counts, out = Counter(), {r.doc_id for r in docs.where(marked).collect()}
    n_docs = 0
    for r in data.rows():
        if r[0] not in out:
            counts.update(lattice_lm.lower_words(r[1] or ""))
            n_docs += 1
    total, kinds = sum(counts.values()) + n_docs, len(counts) + 1
    whole = {r.doc_id: r for r in lattice_lm.score(docs, marked, PIECES).collect()}
    for r in got.collect():
        words = lattice_lm.lower_words(next(x[1] for x in data.rows() if x[0] == r.doc_id) or "")
        assert r.held_out == (r.doc_id in out)
        assert (r.n_tokens, r.train_tokens) == (len(words) + 1, total)
        assert r.n_known == sum(counts[w] > 0 for w in words) + 1
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words) + math.log10((n_docs + 1) / (total + kinds + 1))
        assert r.base_score == pytest.approx(base)
        assert r.score < 0 and r.score == pytest.approx(whole[r.doc_id].score)
    assert got.count() == docs.count()
    assert lattice_lm.score(data.empty(spark), marked, PIECES).count() == 0


def test_document_score_is_a_chain_of_urn_draws():
    p, n = np.log(np.array([0.2, 0.05])), np.array([3, 1])
    want, drawn = 0.0, [0, 0]
    for i in (0, 0, 1, 0):
        want += math.log10((drawn[i] + 100 * math.exp(p[i])) / (sum(drawn) + 100))
        drawn[i] += 1
    assert lattice_lm.document_score(p, n, 100.0) == pytest.approx(want)


def test_unseen_everything(spark):
    """Nothing to learn from: the lattice alone decides."""
    docs = spark.createDataFrame([(1, "the cat"), (2, None)], "doc_id long, text string")
    rows = lattice_lm.score(docs, F.lit(True), PIECES).orderBy("doc_id").collect()
    assert [(r.train_tokens, r.n_known, r.n_tokens) for r in rows] == [(0, 0, 3), (0, 0, 1)]
    assert rows[0].score < rows[1].score < 0


def test_lattice_score_is_the_product_over_all_words(spark):
    docs = spark.createDataFrame([(1, "the cat the"), (2, None)], "doc_id long, text string")
    model = lattice_lm.Lattice(PIECES, np.zeros(lattice_lm.processor(PIECES).get_piece_size()), 0.0)
    got = {r.doc_id: r.lattice_score for r in lattice_lm.score(docs, F.lit(True), PIECES).collect()}
    want = 2 * brute_lattice(model, "the") + brute_lattice(model, "cat") + model.stop
    assert got == {1: pytest.approx(want / math.log(10)), 2: pytest.approx(model.stop / math.log(10))}


def rule_spans(text):
    """The rules word for word: find all, then drop what is too short."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def test_base_spans_follow_the_rules():
    rng = np.random.default_rng(3)
    parts = ["password", "toKEN", "api_key", "apikey", "=", ": ", '"', "AKIA", "ABCDEFGH12", "0123456789abcdef", "deadbeef", " ", "é", "ſecret=abcdefghijklm", "x.y-z_", "short", "\n"]
    for _ in range(5000):
        text = "".join(rng.choice(parts, rng.integers(0, 12)))
        assert charnet.base_spans(text) == rule_spans(text)


def test_network_learns_findings(spark):
    docs = data.documents(spark, 600)
    net = charnet.fit(docs)
    got = charnet.find(docs, net).collect()
    texts = {r[0]: r[1] or "" for r in data.rows(600)}
    for r in got:
        base = rule_spans(texts[r.doc_id])
        listed = ",".join(f"{charnet.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for _, k, _ in base) for kind in range(3)]
    # mail addresses and network addresses are candidates, and are left alone
    assert sum(r.n_model for r in got) <= 2
    assert charnet.scan("set passphrase=9f86d081884c7d659a2f5 now", net)[1]
    assert charnet.redact('x password="abcdef0123456789abcdef" y', net) == 'x [SECRET]" y'
    assert charnet.find(docs, net).orderBy("doc_id").collect() == charnet.find(docs.repartition(5), charnet.fit(docs)).orderBy("doc_id").collect()


def test_threshold_keeps_the_recall():
    """Findings that score low lower the threshold, whatever that costs in precision."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 16)) for _ in range(400)]
    x = np.concatenate([charnet.windows("say " + w, [(4, 20)]) for w in words])
    net = charnet.train(x, rng.integers(0, 2, 400).astype(float))
    assert net.recall >= charnet.RECALL and net.threshold < 0.9
    assert 0.2 < net.precision < 0.9


def test_every_candidate_trains(spark, monkeypatch):
    """No candidate and no character is left out of training, calibration and threshold, however many there are."""
    rng = np.random.default_rng(8)
    tail = "".join(rng.choice(list("ghijkl"), 700))
    docs = [(i, f"see {i}.example.com/{tail}{i} or token={i:014x}Zz", "en") for i in range(4500)]
    docs += [(0, docs[0][1], "en")] * 3
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    found = charnet._labelled(table)
    assert sorted(found.groupBy("secret").agg(F.sum("n")).collect()) == [(False, 4503), (True, 4503)]
    packed = charnet._sharded(found, 7).toPandas()
    shards = list(charnet._unpacked([packed]))
    assert sum(n.sum() for *_, n in shards) == 9006
    want = charnet.windows(docs[9][1], charnet.candidates(docs[9][1]))
    assert set(want) <= {row for _, rows, _, _ in shards for row in rows} and len(want[0]) > 700
    seen = []
    calibrate = charnet._calibrate

    def watched(net, total):
        seen.append(total(lambda raw, y, n: np.array([n.sum(), (n * (y == 1)).sum()])).tolist())
        return calibrate(net, total)

    monkeypatch.setattr(charnet, "_calibrate", watched)
    net = charnet.fit(table)
    # every secret counts twice, once blanked
    assert seen == [[3 * 4503, 2 * 4503]]
    assert net.recall >= charnet.RECALL and net.precision > 0.9


def test_shards_are_spread_over_tasks(spark, monkeypatch):
    """A task trains on few shards, however many there are."""
    docs = [(i, f"see {i}.example.com/{i * i} or token={i:014x}Zz") for i in range(400)]
    monkeypatch.setattr(charnet, "SHARD_BYTES", 2000)
    monkeypatch.setattr(charnet, "_calibrate", lambda net, total: net)
    shards, tasks = [], []

    def watched(df, part):
        shards.append(df.count())
        tasks.append(df.rdd.getNumPartitions())
        return np.zeros(3 * len(charnet._flat(charnet.fresh())), dtype="i8")

    monkeypatch.setattr(charnet, "_sum_by_slot", watched)
    charnet.fit(spark.createDataFrame(docs, "doc_id long, text string"))
    assert len(shards) == charnet.ROUNDS and min(shards) > 20 and min(n * 8 for n in tasks) >= max(shards)


def test_calibration_by_sums():
    """The threshold is the exact rank, and the logistic fit the optimum, from sums over any parts."""
    rng = np.random.default_rng(9)
    y = (rng.random(5000) < 0.2).astype(float)
    raw = (rng.normal(size=5000) + 2 * y - 1).astype("f4")
    raw[:9] = [0.0, -0.0, 1e-30, -1e-30, 40, -40, 1, 1, 1]
    n = rng.integers(1, 4, 5000)
    net = charnet._calibrate(charnet.fresh(), lambda part: sum(part(raw[i::3], y[i::3], n[i::3]) for i in range(3)))
    every, labels = np.repeat(raw, n), np.repeat(y, n)
    found = np.sort(every[labels == 1])
    least = found[int((1 - charnet.RECALL) * len(found) + 1e-9)]
    assert net.threshold == net.calibrated(least)
    assert net.recall == (found >= least).mean() and net.precision == pytest.approx(labels[every >= least].mean())
    assert net.calibrated(every).mean() == pytest.approx(labels.mean(), abs=1e-3)


def test_network_gradients():
    rows = list(charnet.windows('a 0123456789abcdefXY "', [(2, 20)])) + list(charnet.windows("x" * 9000 + " " + "9" * 40, [(0, 9000)]))
    y, weight, net = np.array([1.0, 0.0]), np.array([1.0, 2.0]), charnet.fresh()
    for name, gradient in charnet._gradients(net, rows, y, weight).items():
        at = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        loss = []
        for step in (0.01, -0.01):
            moved = getattr(net, name).copy()
            moved[at] += step
            raw = charnet.replace(net, **{name: moved})._forward(rows, 1000)[3]
            loss.append((weight * (np.logaddexp(0, raw) - y * raw)).mean())
        assert gradient[at] == pytest.approx((loss[0] - loss[1]) / 0.02, rel=0.02)


def test_whole_candidates_are_judged():
    class Found:
        threshold = 0.5

        def chance(self, x):
            return np.ones(len(x))

    key = "sk_live_XX0123456789abcdefYY"
    assert charnet.redact(f"key {key} end", Found()) == "key [SECRET] end"
    assert charnet.redact("the QWxhZGRpbjpvcGVuIHNlc2FtZQ end", Found()) == "the [SECRET] end"
    assert charnet.redact("the AbCdEfGhIjKlMnOp end", Found()) == "the [SECRET] end"
    net = charnet.train(np.concatenate([charnet.windows("a " * 9 + v, [(18, 18 + len(v))]) for v in ["abcdefghijkl", "0123456789AB"] * 20]), np.array([0.0, 1.0] * 20))

    def score(text, end=None):
        return net.raw(charnet.windows(text, [(0, end or len(text))]))[0]

    # what stands far behind a candidate's start counts, and so does the text after it
    for n in (50, 3000, 4 * charnet.SEGMENT + 7):
        assert score("a" * n + "0123456789AB") > score("a" * (n + 12)) + 0.1
        assert score("a" * n + ' "0123456789AB"', n) != score("a" * n + " in the end", n)
    # segments change nothing
    x = charnet.windows("ab1" * 2000 + " = x", [(0, 6000)])
    assert net.raw(x)[0] == pytest.approx(net._forward(x)[3][0])


def test_no_findings_no_network(spark):
    clean = spark.createDataFrame([(1, "plain words only"), (2, None)], "doc_id long, text string")
    assert charnet.fit(clean) is None
    assert [r.spans for r in charnet.find(clean, None).collect()] == ["", ""]
    assert charnet.find(data.empty(spark), charnet.fit(data.empty(spark))).count() == 0


def test_resampling_prefers_the_target(spark):
    docs = data.documents(spark, 300)
    good = docs.where("lang = 'fr'").select("doc_id")
    got = resampling.resample(docs, good, share=0.4)
    rows = got.collect()
    assert len(rows) == docs.count()
    french = {r[0] for r in data.rows(300) if r[2] == "fr"}
    mean = [np.mean([r.log_weight for r in rows if (r.doc_id in french) == flag and r.n_grams > 50]) for flag in (True, False)]
    assert mean[0] > mean[1] + 5
    chosen = sorted((r.score for r in rows), reverse=True)[: round(0.4 * len(rows))]
    assert {r.doc_id for r in rows if r.selected} == {r.doc_id for r in rows if r.score >= chosen[-1]}
    counts = Counter(itertools.chain.from_iterable(resampling.bins(r[1] or "").tolist() for r in data.rows(300)))
    target = Counter(itertools.chain.from_iterable(resampling.bins(r[1] or "").tolist() for r in data.rows(300) if r[2] == "fr"))
    a, b = sum(target.values()) + resampling.BINS, sum(counts.values()) + resampling.BINS
    first = next(r for r in rows if r.doc_id == 0)
    want = sum(math.log((target[x] + 1) / a) - math.log((counts[x] + 1) / b) for x in resampling.bins(data.rows(300)[0][1]).tolist())
    assert first.log_weight == pytest.approx(want)


def test_resampling_without_target(spark):
    docs = data.documents(spark)
    got = resampling.resample(docs, data.empty(spark))
    assert {r.log_weight for r in got.collect()} == {0.0}
    assert resampling.resample(data.empty(spark), data.empty(spark)).count() == 0


PAGE = """<html><head><title>A &amp; B</title><style>p{}</style></head><body><!-- <a href="/no"> --><h1>Head</h1>
<p>One <b>two</b>&nbsp;three<br>four</p><script>var x = "<p>"; </script><a href="/in?q=1">in</a><img src='pic.png'></body></html>"""


def test_warc_derivatives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://h.example/a/b", PAGE), (2, None, None), (3, "http://[bad", "<p>x"), (3, "http://[bad", "<p>x")], "page_id long, url string, html string")
    found = warc.responses(pages)
    derived = warc.derive(found)
    origin = {r.page_id: r for r in found.collect()}
    rows = derived.collect()
    assert len(rows) == 8
    for r in rows:
        source = origin[r.page_id]
        assert (r.refers_to, r.target_uri, r.date, r.payload_digest) == (source.record_id, source.target_uri, source.date, source.payload_digest)
        assert r.source_headers["Content-Length"] == str(len((source.content or "").encode()))
        assert r.block_digest == warc.digest(r.content.encode())
    one = {r.record_type: r for r in rows if r.page_id == 1}
    assert one["conversion"].content == "Head\nOne two three\nfour\nin"
    assert "title: A & B\r\n" in one["metadata"].content
    assert "outlink: https://h.example/in?q=1 A@/href\r\n" in one["metadata"].content
    assert "outlink: https://h.example/a/pic.png IMG@/src\r\n" in one["metadata"].content
    assert {r.target_uri for r in rows if r.page_id == 2} == {"urn:page:2"}
    path = str(tmp_path / "warc")
    every = found.drop("page_id").unionByName(derived.drop("page_id", "n_links"))
    warc.save(every, path)
    back = {(r.fields["WARC-Record-ID"], bytes(r.block)) for r in warc.read(spark, path).collect()}
    want = {(r.record_id, ((warc.http_head(r.source_headers) if r.record_type == "response" else "") + r.content).encode()) for r in every.collect()}
    assert back == want
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derive(warc.responses(none)).count() == 0
