"""The registered queries of this subpackage, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, lexical, spelling
from .chat_format import read_chat, with_control, write_chat
from .decontaminate import find_matches, judge
from .language_id import fit, identify, public_pieces
from .mixing import fit_domains, mixing_rates
from .secrets import digest, find_secrets, joined
from .shared import fresh_path, set_small_batches, table
from .simhash import near_duplicates
from .token_files import read_tokens, write_tokens
from .topk import quantised, top_inner
from .url_filter import filter_urls
from .warc import read_warc, write_warc

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    read = read_warc(spark, path, with_payload=False)
    return read.select(F.col("key").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"), "url", "error")


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "chat")
    write_chat(with_control(table(spark, sf_dir, "conversations")), path)
    return read_chat(spark.read.parquet(path))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("vector"))
    return top_inner(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


#: Domains of the labels table, and the shares of all tokens that the mixture aims at. Posteriors are soft, so a share of
#: exactly 0 could be met only without all documents whose toxic posterior isn't 0; 2 % leaves out the toxic ones.
DOMAINS = ["high", "low", "toxic"]
TARGETS = {"high": 0.88, "low": 0.1, "toxic": 0.02}


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr("doc_id", "case when toxic = 1 then 'toxic' when quality = 1 then 'high' when quality = 0 then 'low' end as domain")


def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing_rates(docs, fit_domains(docs, domain_labels(spark, sf_dir), DOMAINS), TARGETS)


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [[(s["start"], s["end"], s["kind"]) for s in spans] for spans in batch["spans"].to_pylist()]
            counts = [pa.array([sum(s[2] == k for s in spans) for spans in rows], pa.int64()) for k in ("assign", "access", "hex")]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *counts, pa.array(map(digest, rows), pa.string()), pa.array(map(joined, rows), pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return found.mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path)


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 4 == 2


def language_model(docs: DataFrame):
    train = docs.where(~held_out()).select("doc_id", "text", "lang")
    return fit(train, public_pieces(public_tokenizers.path("piece_bpe_32k.model")))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, language_model(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    set_small_batches(spark)  # texts, their ids and the texts again are in a task at once
    file = tokenizer_file()
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), file).select("doc_id", "ids")
    back = bpe.decode(ids, file, text="decoded")
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), damage=199)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc_round_trip,
    "op2_chat_format": chat_format,
    "op3_url_filter": url_filter,
    "op4_top_k": top_k,
    "op5_mixing": mixing,
    "op6_secret_scan": secret_scan,
    "op7_simhash": simhash_classes,
    "op8_token_files": token_files,
    "op9_decontaminate": decontaminate,
    "op10_language_id": language_id,
    "op11_bpe": bpe_round_trip,
    "op12_lexical_search": lexical_search,
    "op13_spelling_variants": spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rule_host, rule_path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(rules.verdict, length(rule_host || rule_path)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT parts.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)""",
    "op12_lexical_search": r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
counted AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf) AS n FROM counted GROUP BY 1),
total AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM lengths),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (SELECT term, floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counted, total GROUP BY term, nn),
lent AS (SELECT doc_id, (10 + (90 * n::BIGINT * nn) // ll)::BIGINT AS m FROM lengths, total),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN counted USING (term) JOIN weights USING (term) JOIN lent USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0) WHERE place <= 10""",
}
