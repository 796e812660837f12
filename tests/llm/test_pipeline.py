"""The corpus pipeline as a whole, stage by stage, on a table with every awkward case."""

import hashlib

import corpus_pipeline
import pytest
import tiktoken
from data import DOCS, rows
from pyspark.sql import functions as F

from sparkprep.llm.queries import ranks

CLASHES = ["guess", "nth", "order", "masked", "own_digest", "class_digest", "__guess", "__masked", "__nth", "position", "Guess_"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The result of every stage, as the pipeline writes and reads it."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame(rows(), DOCS).withColumns({c: F.lit(c) for c in CLASHES})
    docs.write.parquet(f"{folder}/documents.parquet")
    out, docs = {"documents": spark.read.parquet(f"{folder}/documents.parquet")}, None
    for name, stage in corpus_pipeline.STAGES:
        before = out["documents"] if docs is None else docs
        stage(spark, before, folder).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def test_stages_keep_the_columns(stages):
    columns = stages["documents"].columns
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == columns
        assert stages[name].where(" or ".join(f"`{c}` <> '{c}'" for c in CLASHES)).count() == 0


def test_texts_without_letters_go_and_no_clean_document(stages):
    kept = {(r["doc_id"], r["text"]) for r in stages["language_id"].collect()}
    given = {(r["doc_id"], r["text"]) for r in stages["documents"].collect()}
    assert kept <= given
    assert {d for d, t in given - kept if t is None or not any(c.isalpha() for c in t)} == {10102, 10103, 10104, 10106}
    assert all(d is None or d >= 10100 for d, _ in given - kept)


def test_one_of_equal_and_near_texts_stays(stages):
    before, after = stages["language_id"].collect(), stages["near_dedup"].collect()
    texts = [r["text"] for r in after]
    assert len(texts) == len(set(texts)) and {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    left = {r["doc_id"] for r in after}
    assert 0 in left and 10100 not in left and 10101 not in left
    assert {r["doc_id"] for r in before if r["doc_id"] is not None and r["doc_id"] < 60} <= left


def test_secrets_are_masked_and_nothing_else_changes(stages):
    before = {(r["doc_id"], r["text"]) for r in stages["near_dedup"].collect()}
    after = stages["secret_scan"].collect()
    assert len(after) == len(before)
    texts = dict(before)
    for r in after:
        assert r["n_chars"] == len(r["text"])
        if r["doc_id"] is not None and r["doc_id"] < 60 and r["doc_id"] % 10 == 4:
            secret = texts[r["doc_id"]].split('password="')[1].split('"')[0]
            assert secret not in r["text"] and "mail user" in r["text"]
        elif r["doc_id"] is not None and r["doc_id"] < 60:
            assert r["text"] == texts[r["doc_id"]]


def test_the_mix_repeats_whole_documents(stages):
    before = {r["text"] for r in stages["secret_scan"].collect()}
    mixed = stages["mix"].collect()
    whole = [r for r in mixed if r["text"] in before]
    # each source's target cuts one copy at most
    assert len(mixed) - len(whole) <= len({r["source"] for r in mixed}) and {r["text"] for r in whole} <= before


def test_tokens_are_those_of_the_library(stages):
    import base64

    import public_tokenizers

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks().splitlines() if line)}
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    want = sorted(hashlib.sha256(" ".join(map(str, library.encode_ordinary(r["text"]))).encode()).hexdigest() for r in stages["mix"].collect())
    assert sorted(r["ids_sha256"] for r in stages["tokens"].collect()) == want


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
