import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/", 1)[0])

import data  # noqa: E402
from sparkprep.llm import bpe, langid, mixing  # noqa: E402
from sparkprep.llm.common import WORDS, held_out  # noqa: E402


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    """Clip and share the excess again until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(cap * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return share | {s: cap * sizes[s] for s in full}
        full |= over


def test_mix_meets_targets(spark):
    docs = data.documents(spark)
    got = [r.asDict() for r in mixing.mix(docs, keep=True).collect()]
    assert len(got) == docs.count()
    sizes = defaultdict(int)
    for r in data.rows():
        sizes[r[3]] += len(WORDS.findall(r[1] or ""))
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        source = r["document"]["source"]
        assert r["size"] == len(WORDS.findall(r["document"]["text"] or ""))
        assert r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(want[source])
        assert r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    for source, words in taken.items():
        assert abs(words - want[source]) <= 1
    again = mixing.mix(docs).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_mix_positions_follow_the_schedule(spark):
    """Of a source, the words placed before time t are the integral of its schedule up to t."""
    rows = [(i, "w " * 10, "en", "abc"[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, weights=(1,)).withColumn("p", F.explode("positions")).join(docs.select("doc_id", "source"), "doc_id")
    for t in (0.25, 0.5, 0.75):
        early = {r.source: r.n for r in got.where(f"p < {t}").groupBy("source").agg(F.count("*").alias("n")).collect()}
        # integrals of 1.5 - t, of 1, and of 0.5 + 0.5 t up to one half and -0.5 + 2.5 t after it, over its area 1
        late = 0.5 * t + 0.25 * t * t if t <= 0.5 else 0.3125 + (t - 0.5) * (0.75 + (0.75 + 2.5 * (t - 0.5))) / 2
        for source, share in (("a", 1.5 * t - t * t / 2), ("b", t), ("c", late)):
            assert early[source] == pytest.approx(100 * share, abs=3)


def test_training_order_repeats_and_cuts(spark):
    docs = data.documents(spark)
    out = mixing.training_order(docs)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.source] += len(WORDS.findall(r.text))
    taken = defaultdict(int)
    for r in mixing.mix(docs, keep=True).collect():
        taken[r.document.source] += r.taken
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}


def test_mix_of_nothing(spark):
    assert mixing.mix(data.empty(spark)).count() == 0
    assert mixing.training_order(data.empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "x"), (2, "  ", None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0.0, 0)] * 2


RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ENC = bpe.encoding(RANKS, public_tokenizers.PATTERN)


def test_tree_equals_plain_encoding():
    rng = random.Random(5)
    letters = " \n\t'sreltvdm aébZ1-9.!? 　日本😀\x1c\x85"
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        ids = bpe.encode_text(ENC, text, piece=rng.choice([1, 2, 3, 5, 9]))
        assert ids == ENC.encode_ordinary(text)
        assert bpe.decode_ids(ENC, ids, piece=4) == text.encode()


def test_long_runs_of_white_space():
    text = "a" + " " * 60_000 + "b" + "\n" * 70_000
    assert bpe.encode_text(ENC, text) == ENC.encode_ordinary(text)
    endless = " " * 1_200_000 + "a"
    assert bpe.decode_ids(ENC, bpe.encode_text(ENC, endless)) == endless.encode()


def test_digests_and_columns(spark):
    docs = data.documents(spark)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()}
    want = set()
    for r in data.rows():
        ids = ENC.encode_ordinary(r[1] or "")
        want.add((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == want
    tokens = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(tokens, RANKS, public_tokenizers.PATTERN).select("text", "decoded").collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back)
    assert bpe.digests(data.empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0
    assert isinstance(ENC, tiktoken.Encoding)


def test_language_of_held_out_texts(spark):
    docs = data.documents(spark, 180).withColumn("out", held_out("doc_id", 4))
    assert {r.doc_id for r in docs.where("out").collect()} == {r[0] for r in data.rows(180) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2}
    model = langid.fit(docs.where("not out"))
    got = langid.predict(docs, model)
    assert got.columns == [*docs.columns, "lang_pred", "lang_score"]
    for r in got.collect():
        assert 0 <= r.lang_score <= 1
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert (r.lang_pred, r.lang_score) == ("und", 0.0)
    fair = [r for r in got.where("out and doc_id < 180").collect()]
    assert sum(r.lang == r.lang_pred for r in fair) >= 0.95 * len(fair)


def test_backoff_goes_from_words_to_shorter_pieces(spark):
    docs = spark.createDataFrame([(1, "house mouse", "en"), (2, "haus maus", "de")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.word("house")[1] > model.word("house")[0]
    # unseen, but its ending is known in one language only
    assert model.languages[int(model.word("grouse").argmax())] == "en"
    assert model.languages[int(model.word("laus").argmax())] == "de"
    assert model.predict("²³") == ("und", 0.0)


def test_words_met_are_forgotten_in_time(spark, monkeypatch):
    docs = data.documents(spark).where("doc_id < 60")
    model = langid.fit(docs)
    texts = [r.text for r in docs.collect()] + [f"grouse{i} laus{i} unsound" for i in range(40)]
    want = [model.predict(t) for t in texts]
    use = langid.Predictor(model)
    assert [use.predict(t) for t in texts] == want
    monkeypatch.setattr(langid, "CACHED_WORDS", 2)
    assert [use.predict(t) for t in texts] == want


def test_language_without_labels(spark):
    model = langid.fit(data.empty(spark))
    got = langid.predict(data.documents(spark), model).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in got] == ["und"]
    assert langid.predict(data.empty(spark), model).count() == 0
