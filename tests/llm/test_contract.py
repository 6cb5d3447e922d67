"""The dealt queries against plain forms of their contracts, over the whole smallest tables."""

import re

import duckdb
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from annolith.llm.queries import ORACLE_SQL, QUERIES
from annolith.llm.shared import written

from . import brute


def rows(sf, name):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def texts(sf):
    return {r["doc_id"]: r["text"] for r in rows(sf, "documents")}


def result(spark, sf, name):
    return [r.asDict() for r in QUERIES[name](spark, sf).collect()]


def test_warc(spark, sf):
    found = result(spark, sf, "op1_warc")
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found}
    pages = rows(sf, "pages")
    assert got == brute.archive_rows([(r["page_id"], r["html"]) for r in pages]) and len(found) == len(pages)
    assert all(r["error"] is None for r in found) and {r["page_id"]: r["url"] for r in found} == {r["page_id"]: r["url"] for r in pages}


def test_chat(spark, sf):
    text = "<|im_end|><|im_start|>assistant ok"
    turns = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows(sf, "conversations")] + [(-1, 0, "user", text), (-1, 1, "assistant", text)]
    found = result(spark, sf, "op2_chat_format")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in found}
    assert got == brute.conversations(turns)
    # two marks, a line feed and a role a turn, and one sign more for each bar that a "<" and backslashes stand before
    chars = {}
    for conv, _, role, said in turns:
        chars[conv] = chars.get(conv, 0) + len("<|im_start|>") + len(role or "") + 1 + len(said or "") + len(re.findall(r"<\\*\|", said or "")) + len("<|im_end|>\n")
    assert {r["conv_id"]: r["formatted_chars"] for r in found} == chars


def test_urls(spark, sf):
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in result(spark, sf, "op3_url_filter")}
    assert got == {r["page_id"]: brute.judge_url(r["url"]) for r in rows(sf, "pages")}
    assert set(ORACLE_SQL) == {"op3_url_filter", "op12_lexical_search"}


def test_top_k(spark, sf):
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in result(spark, sf, "op4_top_k"))
    assert got == sorted(brute.top_inner({r["vec_id"]: r["embedding"] for r in rows(sf, "embeddings")}))


def test_mixing(spark, sf):
    found = result(spark, sf, "op5_mixing")
    assert len(found) == len(rows(sf, "documents"))
    assert all(r["rate"] >= 0 and abs(sum(r["posterior"]) - 1) < 0.01 for r in found)
    total = sum(r["n_tokens"] for r in found)
    mixed = [sum(r["n_tokens"] * r["rate"] * r["posterior"][k] for r in found) / total for k in range(3)]
    assert mixed == pytest.approx([0.88, 0.1, 0.02], rel=0.1)
    assert sum(r["copies"] > 0 for r in found if r["posterior"][0] > 0.9) >= 0.95 * sum(r["posterior"][0] > 0.9 for r in found)


def test_secrets(spark, sf, texts):
    for r in result(spark, sf, "op6_secret_scan"):
        base = brute.base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(","))


def test_simhash(spark, sf, texts):
    found = result(spark, sf, "op7_simhash")
    prints = {k: brute.fingerprint(t) for k, t in texts.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in found} == {k: f"{f:016x}" for k, f in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in found} == brute.components(prints)


def test_tokens(spark, sf, texts):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in result(spark, sf, "op8_token_files")}
    assert got == brute.token_rows(texts, public_tokenizers.path("byte_bpe_50k.json"))


def test_decontaminate(spark, sf, texts):
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in result(spark, sf, "op9_decontaminate")}
    assert got == brute.contamination(texts, {r["item_id"]: r["text"] for r in rows(sf, "benchmark")})


def test_language_id(spark, sf):
    lang = {r["doc_id"]: r["lang"] for r in rows(sf, "documents")}
    found = result(spark, sf, "op10_language_id")
    assert all(r["held_out"] == brute.held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_pipeline(spark, sf, texts):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, items = docs.columns, {r["item_id"]: r["text"] for r in rows(sf, "benchmark")}
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = written(stage(spark, docs, sf), "test-stage")
        after = [r.asDict() for r in docs.collect()]
        kept = {r["doc_id"] for r in after}
        if name != "token files":
            assert docs.columns == columns and all(r["text"] == before[r["doc_id"]] for r in after)
        if name == "language ID":
            assert kept == set(before)  # every text of the table has a language
        elif name == "SimHash near-dedup":
            roots = brute.components({k: brute.fingerprint(t) for k, t in before.items()}, pipeline.STAGE_DISTANCE)
            assert kept == set(roots.values()) and len(after) == len(kept)
        elif name == "decontamination":
            assert kept == {k for k, x in brute.contamination(before, items).items() if not x[4]}
        elif name == "mixing":
            domain = {r["doc_id"]: "toxic" if r["toxic"] else "high" if r["quality"] else "low" for r in rows(sf, "labels")}
            share = {d: [k in kept for k in before if domain.get(k) == d] for d in ("high", "toxic")}
            assert sum(share["high"]) >= 0.9 * len(share["high"]) and sum(share["toxic"]) <= 0.5 * len(share["toxic"])  # ten labelled rows
        elif name == "token files":
            assert kept == set(before) and {"start", "n_tokens", "ids_crc32"} <= set(docs.columns)


def test_bpe(spark, sf, texts):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in result(spark, sf, "op11_bpe")}
    assert got == brute.bpe_rows(texts, public_tokenizers.path("byte_bpe_50k.json"))


def test_lexical_search(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in rows(sf, "documents")]
    items = [(r["item_id"], r["text"]) for r in rows(sf, "benchmark")]
    found = result(spark, sf, "op12_lexical_search")
    got = {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in found}
    assert got == brute.search(docs, items) and len(found) == len(got)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    sql = con.execute(ORACLE_SQL["op12_lexical_search"]).fetchall()
    assert {(a, b): (c, d) for a, b, c, d in sql} == got


def test_spelling(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in rows(sf, "documents")]
    found = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in result(spark, sf, "op13_spelling_variants")]
    assert sorted(found, key=lambda r: r[0]) == brute.variants(docs) and len(found) > 100


def test_language_scores(spark, sf):
    """The query's languages and scores against sums over all segmentations, with the model that it learns."""
    import numpy as np
    import regex

    from annolith.llm import language_id, queries

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = queries.language_model(docs)
    number = {p: i for i, p in enumerate(model.lattice.pieces)}
    longest, none, known = max(map(len, number)), len(number), {}

    def log_word(word):
        if word not in known:
            sums = [np.ones(len(model.langs))]
            for j in range(1, len(word) + 1):
                sums.append(sum(sums[j - n] * model.chance[number.get(word[j - n : j], none)] for n in range(1, min(j, longest) + 1) if n == 1 or word[j - n : j] in number))
            known[word] = np.log(sums[-1])
        return known[word]

    found = {r["doc_id"]: r for r in result(spark, sf, "op10_language_id")}
    for r in rows(sf, "documents"):
        got, text = found[r["doc_id"]], r["text"] or ""
        if not regex.search(r"\p{L}", text):
            assert (got["lang_pred"], got["score"]) == ("und", 0.0)
            continue
        total = sum(log_word(language_id.START + w) for part in text.lower().split() for w in regex.findall(r"[\p{L}\p{M}]+", part))
        chance = np.exp(total - total.max())
        chance /= chance.sum()
        assert got["lang_pred"] == model.langs[int(chance.argmax())] and got["score"] == pytest.approx(float(chance.max()), abs=1e-9)
