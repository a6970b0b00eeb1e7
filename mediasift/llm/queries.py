"""The thin queries over the operators of this package, each over its whole table, with check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.llm import (
    exact_dedup,
    fingerprints,
    lexical_rank,
    licenses,
    mixing,
    neighbours,
    piece_bpe,
    secret_scan,
    sharding,
    simhash,
    toxicity,
    url_filter,
    whitening,
)
from mediasift.sources.shared import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_toxic_spans")
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = toxicity.held_out(F.col("doc_id"))
    scored = toxicity.scored(docs, toxicity.train(docs, labels.where(~held_out)))
    span = lambda x: F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string"))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", "predicted", F.array_join(F.transform("spans", span), ",").alias("spans")
    )


@_query("op2_minhash")
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.edited_pairs(_table(spark, sf_dir, "documents"))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("packed")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_packed")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        fingerprints.likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )


@_query("op3_licenses")
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan(_table(spark, sf_dir, "documents"))
    named = scanned.withColumn("licenses", licenses.licenses_of(F.col("matches")))
    return named.select(
        "doc_id",
        F.size("known").cast("long").alias("n_sentences"),
        F.array_join(F.transform("known", lambda x: F.concat_ws(":", x["id"], x["at"].cast("string"))), ",").alias("sentences"),
        F.array_join("matches", ",").alias("matches"),
        F.array_join("licenses", ",").alias("licenses"),
        licenses.kind_of(F.col("licenses")).alias("kind"),
    )


@_query("op4_sharding")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.records(_table(spark, sf_dir, "documents"))
    folder = new_folder(spark, "sharding-map")
    sharding.write_map(sharding.even_map(24), spark, folder)
    sharding.rebalance(rows, folder)
    placed = sharding.placed(rows, sharding.read_map(spark, folder))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
    )


@_query(
    "op5_exact_dedup",
    """
    WITH t AS (
        SELECT doc_id, length(coalesce(text, '')) AS n,
               sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
        FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           doc_id = first_value(doc_id) OVER w AS kept, text_sha256
    FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
    """,
)
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.duplicate_groups(exact_dedup.text_keys(_table(spark, sf_dir, "documents")))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@_query("op6_sentencepiece")
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_bpe.token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query("op7_url_filter")
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_table(spark, sf_dir, "pages"))


@_query("op8_soft_mixing")
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, domains = mixing.mixed(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    shares = [F.col("posterior")[k].alias(d) for k, d in enumerate(domains)]
    return out.select("doc_id", "tokens", "rate", "copies", *shares, "missed")


@_query("op9_simhash")
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(simhash.fingerprinted(_table(spark, sf_dir, "documents")))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query("op10_secret_ownership")
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, repository=F.struct("source", "lang"), owner=F.col("source"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == secret_scan.KINDS.index(kind))).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < secret_scan.KINDS.index("named"))
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secret_scan.written(base), 256).alias("base_sha256"),
        secret_scan.written(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda x: ~x["live"])).cast("long").alias("n_example"),
    )


@_query("op11_neighbours")
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_groups(_table(spark, sf_dir, "embeddings"))


_TERMS = (
    "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)


@_query(
    "op12_lexical_rank",
    f"""
    WITH d AS (SELECT doc_id, {_TERMS.format("text")} AS terms FROM documents WHERE text IS NOT NULL),
    size AS (SELECT doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
    whole AS (SELECT count(*)::BIGINT AS all_docs, sum(n)::BIGINT AS all_terms FROM size),
    held AS (SELECT doc_id, term, count(*)::BIGINT AS tf
             FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY doc_id, term),
    wanted AS (SELECT item_id, term, count(*)::BIGINT AS repeats
               FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark WHERE text IS NOT NULL)
               GROUP BY item_id, term),
    weighed AS (SELECT term, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
                FROM held, whole WHERE term IN (SELECT term FROM wanted) GROUP BY term, all_docs),
    scored AS (
        SELECT item_id, doc_id,
               sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * all_docs) // all_terms))))::BIGINT AS score
        FROM wanted JOIN weighed USING (term) JOIN held USING (term) JOIN size USING (doc_id), whole
        GROUP BY item_id, doc_id),
    placed AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
               FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
    """,
)
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_rank.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op13_whitening")
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))
