"""The registered queries of the subpackage, one for each operator, and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmere.llm import exact, fingerprints, lattice, lines, mixing, packing, pii, repair, resample, simhash, sqltext, substring, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page URLs: the longest host rule, else the classifier."""
    model = url_filter.train(url_filter.labelled_urls(spark))
    found = url_filter.judged(_table(spark, sf_dir, "pages").select("page_id", "url"), model)
    return found.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict", "score")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edits, with likeness to the edit and to the next document."""
    return fingerprints.against_edits(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without the 20-word windows that also start earlier."""
    left = substring.dedup(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised and packed into sequences of at most 2048 tokens."""
    return packing.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the component of each under links of at most two bits."""
    found = simhash.near_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and digest of plain spans, and all spans with disguised ones."""
    found = pii.find(_table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a classifier fitted on the labels of rows that are not held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    model = toxicity.train(docs, labels, remainder != 0)
    scored = docs.select("doc_id", (remainder == 0).alias("held_out"), toxicity.score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for every document, by equality after deleting ASCII white space."""
    return exact.exact_dedup(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents with one line of each group of near-equal lines."""
    left = lines.dedup(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as the corpus has, drawn to the target weights in at most three epochs."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), mixing.source_levels(), mixing.tree_of, max_epochs=3)
    level = lambda i, name: F.get("leaf", F.lit(i)).alias(name)
    return mixed.select(F.col("row.doc_id").alias("doc_id"), level(0, "domain"), level(1, "lang"), level(2, "source"), "epoch", "n_tokens", "take_tokens")


def op11_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and verdict for all embeddings, by cosine 0.98 within a label."""
    return lattice.near_components(_table(spark, sf_dir, "embeddings"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after seeded damage: faults, the cheapest edits and the digest of the repaired turns."""
    return repair.digests(repair.repair(repair.damaged(_table(spark, sf_dir, "conversations"))))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed by likeness to the benchmark texts, and the rank of the quarter drawn."""
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_fingerprints": op2_fingerprints,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_packing": op4_packing,
    "op5_simhash": op5_simhash,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_mixing": op10_mixing,
    "op11_lattice": op11_lattice,
    "op12_repair": op12_repair,
    "op13_resample": op13_resample,
}

ORACLES: dict[str, str] = {
    "op3_substring_dedup": r"""
        with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
        starts as (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from w where len(ws) >= 20),
        again as (select doc_id, i from (
            select doc_id, i, row_number() over (partition by array_to_string(ws[i:i + 19], ' ') order by doc_id, i) as n from starts) where n > 1),
        gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from again),
        words as (select doc_id, unnest(range(1, len(ws) + 1)) as p, unnest(ws) as x from w),
        kept as (select doc_id, count(*) as n, string_agg(x, ' ' order by p) as t from words anti join gone using (doc_id, p) group by doc_id)
        select doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
        from w left join kept using (doc_id)
    """,
    "op8_exact_dedup": r"""
        with b as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm, length(coalesce(text, '')) as n from documents)
        select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size,
               row_number() over w = 1 as kept, sha256(norm) as text_sha256
        from b window w as (partition by norm order by n desc, doc_id)
    """,
    "op11_lattice": sqltext.LINKED_VECTORS,
    "op12_repair": sqltext.REPAIRED_CONVERSATIONS,
    "op13_resample": sqltext.RESAMPLED_DOCUMENTS,
}
