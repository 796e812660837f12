"""The operators' queries over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.llm import (
    bpe,
    charnet,
    chat_events,
    forest,
    langid,
    lattice_lm,
    mixing,
    order_minhash,
    prefix_trie,
    resampling,
    spotsigs,
    sql,
    structure_repair,
    warc,
)
from sparkprep.llm.common import held_out, table

BPE_FILE = "byte_bpe_50k.tiktoken"
PIECES_FILE = "piece_bpe_32k.model"


def ranks() -> bytes:
    return bpe.read_ranks(public_tokenizers.path(BPE_FILE))


def op1_curriculum_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's share in the mix, in training order; documents not taken come first."""
    mixed = mixing.mix(table(spark, folder, "documents"))
    rows = mixed.select("doc_id", "size", "source_size", "target", "taken", F.try_element_at("positions", F.lit(1)).alias("first_position"), F.size("positions").alias("copies"))
    return rows.orderBy("first_position", "doc_id")


def op2_rp_forest(spark: SparkSession, folder: str) -> DataFrame:
    return forest.search(table(spark, folder, "embeddings"), F.col("id") % 20 == 0, k=20)


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), ranks(), public_tokenizers.PATTERN)


def op4_lattice_lm(spark: SparkSession, folder: str) -> DataFrame:
    with open(public_tokenizers.path(PIECES_FILE), "rb") as file:
        model = file.read()
    return lattice_lm.score(table(spark, folder, "documents"), held_out("doc_id", 7), model)


def op5_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.classes(table(spark, folder, "documents")).select("doc_id", "class_id", "class_key")


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    marked = docs.select("doc_id", "text", "lang", held_out("doc_id", 4).alias("held_out"))
    model = langid.fit(marked.where("not held_out"))
    return langid.predict(marked, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op7_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    good = table(spark, folder, "labels").where("quality = 1").select("doc_id")
    return resampling.resample(table(spark, folder, "documents"), good)


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return charnet.find(docs, charnet.fit(docs))


def op9_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    return spotsigs.compared(table(spark, folder, "documents"))


def op10_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    """Derived records of every page, with digests in place of the texts."""
    derived = warc.derive(warc.responses(table(spark, folder, "pages")))
    facts = ["page_id", "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest", "payload_digest"]
    source = [F.col("source_headers")[h].alias(a) for h, a in (("Content-Type", "source_content_type"), ("Content-Length", "source_content_length"))]
    return derived.select(*facts, *source, "n_links", F.char_length("content").cast("long").alias("n_chars"))


PLANTED = [(-7, turn, role, r"\### Assistant: </turn> ok", f"planted:{turn}") for turn, role in enumerate(("user", "assistant"))]


def op11_chat_events(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, logged as events, folded, rendered and read back; one more says the template's own marks."""
    rows = table(spark, folder, "conversations")
    row = F.concat_ws(":", "_metadata.file_name", "_metadata.row_index").alias("row")
    rows = rows.select("conv_id", "turn", "role", "text", row)
    rows = rows.union(spark.createDataFrame(PLANTED, rows.schema))
    return chat_events.read_back(chat_events.format_log(chat_events.as_log(rows)))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the trie of conversations that begin with turns of the first of five neighbouring ids."""
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    turns = prefix_trie.turns_of(table(spark, folder, "conversations"))
    nodes = prefix_trie.trie(*prefix_trie.rebuilt(turns, shared, F.expr("conv_id - conv_id % 5"), 8))
    return nodes.drop("k1", "k2")


def op13_structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation after damage: its faults and its cheapest repair."""
    rows = table(spark, folder, "conversations").where("conv_id is not null")
    found = structure_repair.summary(structure_repair.repair(structure_repair.damaged(rows)))
    counts = {c: F.coalesce(c, F.lit(0).cast("long")) for c in found.columns if c not in ("conv_id", "audit", "repaired_sha256")}
    nothing = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}
    return rows.select("conv_id").distinct().join(found, "conv_id", "left").withColumns(counts | nothing)


QUERIES = {
    f.__name__: f
    for f in (
        op1_curriculum_mix,
        op2_rp_forest,
        op3_byte_bpe,
        op4_lattice_lm,
        op5_order_minhash,
        op6_language_id,
        op7_importance_resampling,
        op8_secret_scan,
        op9_spotsigs,
        op10_warc_derivatives,
        op11_chat_events,
        op12_prefix_trie,
        op13_structure_repair,
    )
}

ORACLES: dict[str, str] = {
    "op11_chat_events": sql.CHAT_EVENTS,
    "op12_prefix_trie": sql.PREFIX_TRIE,
    "op13_structure_repair": sql.STRUCTURE_REPAIR,
}
