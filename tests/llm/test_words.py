"""BPE, ranked search and spelling variants on their special cases, against brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from annolith.llm import bpe, lexical, spelling

from . import brute

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "aa", " ", "  ", "\n", "'s", "'LL", "é", "中", "文", "😀", "1", "23", ".", "..", "the", " the", "\x00", "\t", "ſ", "<|endoftext|>", "<|end", "ing", " ", "　", "٣", "Ω", "--", " \n", "aaaaaaaa", "‍", "́"]


@pytest.fixture(scope="module")
def coder():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Coder(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(coder, library, texts):
    flat, counts = coder.encode(texts)
    ends = np.cumsum(counts)
    want = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [flat[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == want
    assert coder.decode(flat, counts) == [t or "" for t in texts]


def test_random_texts(coder, library):
    r = random.Random(1)
    same(coder, library, [None, "", *("".join(r.choice(PARTS) for _ in range(r.randrange(40))) for _ in range(4000))])


def test_words_that_the_guess_gets_wrong(coder, library):
    r = random.Random(2)
    words = ["".join(r.choice("abcdeinorstuwy") for _ in range(r.randrange(1, 90))) for _ in range(4000)]
    texts = [w.encode() for w in words]
    sizes = np.array(list(map(len, texts)))
    tokens, counts = coder.greedy(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, np.cumsum(sizes))
    right = coder.verified(tokens, counts)
    ends = np.cumsum(counts)
    exact = [library.encode(w, add_special_tokens=False).ids for w in words]
    guess = [coder.ids[tokens[e - n : e]].tolist() == x for e, n, x in zip(ends, counts, exact, strict=True)]
    assert right.tolist() == guess and 0 < sum(guess) < len(words)  # verified are just the right ones
    same(coder, library, words)


def test_every_token_and_pairs_of_tokens(coder, library):
    texts = [t.decode("utf-8", "replace") for t in coder.texts[::7]]
    same(coder, library, texts)
    r = random.Random(3)
    same(coder, library, [r.choice(texts) + r.choice(texts) for _ in range(5000)])


def test_long_words(coder, library):
    same(coder, library, ["a" * 50_000, "ab" * 20_000, "the" * 10_000, "=" * 5000, " " * 3000, "\n" * 999 + "x", "中文" * 4000])


def test_decode_of_any_ids(coder, library):
    r = random.Random(4)
    lists = [[r.randrange(-3, 50_300) for _ in range(r.randrange(12))] for _ in range(2000)]
    got = coder.decode(np.array(sum(lists, []), np.int64), np.array(list(map(len, lists))))
    assert got == [library.decode([x for x in own if x >= 0], skip_special_tokens=False) for own in lists]


def test_forgetting(coder, monkeypatch, library):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 10)
    for k in range(3):
        same(coder, library, [f"words number {k} {j} of many{j}" for j in range(30)])
        coder.forget()
        assert len(coder.names) <= 10


def test_files_of_other_kinds():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        content = f.read()
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Coder(content)


def test_bpe_columns(spark, library):
    with open(PATH, encoding="utf-8") as f:
        file = f.read()
    rows = [(1, None, 5, "i"), (1, "", 5, "i"), (None, "x y", 5, "i"), (2, "é" * 3000, 5, "i"), (2, "é" * 3000, 5, "i")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `a.b` int, ids string")
    out = bpe.encode(docs, file)
    assert out.columns == ["doc_id", "text", "a.b", "ids"]
    back = bpe.decode(out, file, text="again.text").collect()
    assert len(back) == 5 and all(r["again.text"] == (r["text"] or "") and r["a.b"] == 5 and list(r["ids"]) == library.encode(r["text"] or "").ids for r in back)
    assert bpe.encode(docs.where("false"), file).count() == 0
    holes = spark.createDataFrame([(1, None), (2, [64, None, 99_999])], "k int, ids array<int>")
    assert {r.k: r.text for r in bpe.decode(holes, file).collect()} == {1: "", 2: library.decode([64])}


# ---- ranked search


def ranked(spark, docs, items, **options):
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    found = lexical.search(frame, asked, **options).collect()
    got = {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in found}
    assert len(got) == len(found)
    return got


def test_search_random(spark):
    r = random.Random(5)
    word = lambda: r.choice(["the", "a", "A", "x9", "É", "é", "中", "rare", "be"]) if r.random() < 0.7 else f"w{int(r.paretovariate(0.8)) % 500}"
    docs = [(i if i % 50 else None, " ".join(word() for _ in range(r.randrange(60)))) for i in range(900)]
    docs += [(7, "the rare one"), (7, "the rare one"), (5, None), (6, ""), (8, "--- \n")] + [(2000 + i, "many copies of the same rare w1 w2") for i in range(60)]
    items = [(i, " ".join(word() for _ in range(r.randrange(25)))) for i in range(40)] + [(100, None), (101, ""), (102, "unknown words"), (103, "the rare rare RARE w1 many")]
    want = brute.search(docs, items)
    assert len(want) > 200
    for options in ({}, {"shard_docs": 37}, {"shard_bytes": 700}, {"block_terms": 50}):
        assert ranked(spark, docs, items, **options) == want
    assert ranked(spark, docs, items, k=3) == brute.search(docs, items, 3)


def test_search_prunes_and_stays_exact(monkeypatch):
    """Small ranges: the non-essential lists grow and candidates are probed; each result equals the full sums."""
    monkeypatch.setattr(lexical, "RANGE_DOCS", 64)
    r = np.random.default_rng(6)
    n, terms = 3000, 12
    lists = [np.sort(r.choice(n, int(n * p), False)) for p in np.linspace(0.9, 0.01, terms)]
    tf = [r.integers(1, 9, len(x)) for x in lists]
    shard = lexical.Shard(np.arange(n), np.ones(n, bool), r.integers(1, 300, n), np.arange(terms, dtype=np.int32), np.cumsum(list(map(len, lists))), np.concatenate(lists).astype(np.int32), np.concatenate(tf).astype(np.int32))
    known = lexical.Statistics(n, int(shard.lengths.sum()), np.array([100 * (i + 1) for i in range(terms)]))
    search = lexical.Search(shard, known)
    full = np.zeros(n, np.int64)
    np.add.at(full, shard.docs, search.gain)
    order = np.lexsort((np.arange(n), -full))
    for k in (1, 10, 50):
        docs, scores = search.top(np.arange(terms), k, 1)
        assert docs.tolist() == order[:k].tolist() and scores.tolist() == full[order[:k]].tolist()
        docs, scores = search.top(np.arange(terms), k, int(full[order[k // 2]]))  # a floor that others set
        assert docs.tolist() == [d for d in order[:k].tolist() if full[d] >= full[order[k // 2]]]


def test_search_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 1, 2)], "doc_id bigint, text string, `a.b` int, score int")
    items = spark.createDataFrame([("x", "b c")], "`the.item` string, question string")
    out = lexical.search(docs, items, item="the.item", item_text="question")
    assert out.columns == ["the.item", "rank", "doc_id", "score"] and [r[0] for r in out.collect()] == ["x"]
    assert lexical.search(docs.where("false"), items, item="the.item", item_text="question").count() == 0
    assert lexical.search(docs, items.where("false"), item="the.item", item_text="question").count() == 0


def test_search_of_shards_without_postings(spark):
    """Many shards, of which most hold no term of the items; and items none of whose terms any shard holds."""
    docs = [(i, "nothing of it" if i % 7 else f"rare word {i}") for i in range(200)]
    items = [(1, "rare"), (2, "unknown"), (3, "word 14")]
    assert ranked(spark, docs, items, shard_docs=2) == brute.search(docs, items)
    assert ranked(spark, docs, [(2, "unknown")], shard_docs=2) == {}


# ---- spelling variants


def spelled(spark, docs, **options):
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    return sorted(map(tuple, spelling.variants(frame, **options).collect()), key=lambda r: r[0])


def test_crc():
    r = np.random.default_rng(7)
    data = r.integers(0, 256, 4000).astype(np.uint8)
    sizes = np.array([0, 1, 5, 5, 900, 3, 0, 17])
    begins = np.array([0, 3999, 7, 100, 50, 2000, 4, 1000])
    start = np.array([zlib.crc32(str(i).encode()) for i in range(len(sizes))], np.uint32)
    want = [zlib.crc32(data[b : b + n].tobytes(), int(s)) for b, n, s in zip(begins, sizes, start, strict=True)]
    assert spelling.crcs(data, begins, sizes, start).tolist() == want


def test_runs():
    texts = ["Abc Ünï×÷ĀßÿZ", None, "", "x", "yzÀ", "9", "Ã" * 3, "abc\x00abc"]
    data, begins, sizes, letters, of = spelling.runs_of(pa.array(texts), 3)
    got = [(int(k), data[b : b + n].tobytes().decode(), int(m)) for k, b, n, m in zip(of, begins, sizes, letters, strict=True)]
    assert got == [(0, "abc", 3), (0, "Ünï×÷", 5), (0, "ßÿz", 3), (4, "yzÀ", 3), (6, "ÃÃÃ", 3), (7, "abc", 3), (7, "abc", 3)]


def test_neighbours():
    """Each neighbour once, in words with runs of equal letters."""
    r = random.Random(8)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randrange(1, 9))) for _ in range(300)})
    trie = spelling.Trie.of(words, [1] * len(words))
    sizes = np.array(list(map(len, words)))
    flat = np.frombuffer(("".join(words) + "\0").encode("utf-32-le"), np.uint32).astype(np.int64)
    q, w = trie.neighbours(flat, np.cumsum(sizes) - sizes, sizes)
    edits = lambda x: {x[:i] + x[i + 1 :] for i in range(len(x))} | {x[:i] + c + x[i + 1 :] for i in range(len(x)) for c in "ab"} | {x[:i] + c + x[i:] for i in range(len(x) + 1) for c in "ab"}
    want = sorted((i, j) for i, x in enumerate(words) for j, y in enumerate(words) if y != x and y in edits(x))
    assert sorted(zip(q.tolist(), w.tolist(), strict=True)) == want


def test_variants_random(spark):
    r = random.Random(9)
    heads = ["".join(r.choice("abcdeéÿ") for _ in range(r.randrange(6, 10))) for _ in range(30)]
    weights = [int(2000 / (k + 1)) + 6 for k in range(30)]

    def word():
        w = r.choices(heads, weights)[0]
        for _ in range(r.choice([0, 0, 0, 0, 0, 1, 1, 2])):
            i = r.randrange(len(w))
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("ab") + w[i:], w[:i] + r.choice("ab") + w[i + 1 :]])
        return w.upper() if r.random() < 0.1 and w.isascii() else w

    docs = [(i if i % 9 else None, " ".join(word() for _ in range(250))) for i in range(120)] + [(1, None), (2, ""), (3, "z" * 5000), (3, ("z" * 5000 + " ") * 6)]
    want = brute.variants(docs, 7)
    assert sum(r[2] not in (r[0], r[1]) for r in want) > 0  # chains of forms
    for options in ({}, {"trie_words": 40, "tries_bytes": 1 << 12}, {"trie_letters": 9}):
        assert spelled(spark, docs, damage=7, **options) == want
    assert spelled(spark, docs) == brute.variants(docs, None)
    assert spelled(spark, docs, least_letters=3, least_count=2, ratio=2) == brute.variants(docs, None, 3, 2, 2)


def test_variants_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "wordly " * 5, 1)], "`doc.id` bigint, `the.text` string, word int")
    assert [tuple(r) for r in spelling.variants(docs, "doc.id", "the.text").collect()] == [("wordly", None, "wordly", 5, 0, None)]
    assert spelling.variants(docs.where("false"), "doc.id", "the.text").count() == 0
    with pytest.raises(ValueError, match="twice"):
        spelling.variants(docs, ratio=1)


def test_groups():
    assert spelling.groups([(1, 5), (2, 5), (3, 11), (4, 1)], 10) == [[1, 2], [3], [4]]
