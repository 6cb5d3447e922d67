"""Plain forms of the contracts, one row at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def judge_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = ascii_lower(re.split(r"[/?#]", rest, maxsplit=1)[0])
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def base_spans(text):
    text = text or ""
    found = []
    for k, (pattern, least, group) in enumerate(((r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2), (r"AKIA[A-Z0-9]+", 18, 0), (r"[0-9a-f]+", 16, 0))):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, distance=4):
    """prints: {key: fingerprint}. {key: least key reachable}"""
    root = {k: k for k in prints}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: top(k) for k in keys}


def contamination(docs, items):
    """docs, items: {key: text}. {doc: (n_words, n_hit, n_items, sha, contaminated)}"""

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))

    windows = {}
    for k, text in items.items():
        own = words(text)
        for i in range(max(1, len(own) - 12)) if own else ():
            windows.setdefault(tuple(own[i : i + 13]), set()).add(str(k))
    sizes = {len(w) for w in windows}
    out = {}
    for k, text in docs.items():
        own, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(own) - n + 1):
                if (w := tuple(own[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[w]
        out[k] = (len(own), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(own))
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def archive_rows(pages):
    """pages: [(page_id, html)]. {page_id: (payload_bytes, digest, type, refers_to)}"""
    import base64

    first = {}
    for k, html in pages:
        first[html or ""] = min(k, first.get(html or "", k))
    out = {}
    for k, html in pages:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out[k] = (len(data), digest, "response", None) if first[html or ""] == k else (len(data), digest, "revisit", first[html or ""])
    return out


def conversations(turns):
    """turns: [(conv_id, turn, role, text)]. {conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)}"""
    out = {}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: t[1])
        learned = "".join(t[3] or "" for t in own if t[2] == "assistant")
        out[conv] = (len(own), sha("".join(f"{t[2]}\n{t[3] or ''}\n" for t in own)), len(learned), sha(learned))
    return out


def token_rows(docs, file):
    """docs: {doc_id: text}. {doc_id: (start, n_tokens, crc)}"""
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer, out, start = Tokenizer.from_file(file), {}, 0
    for k in sorted(docs):
        ids = [*tokenizer.encode(docs[k] or "", add_special_tokens=False).ids, 2]
        out[k] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def top_inner(vectors, k=20):
    """vectors: {id: array}. [(query, rank, id, score)] for ids divisible by 20"""
    import numpy as np

    whole = {i: np.floor(64 * np.asarray(v, float)).astype(np.int64) for i, v in vectors.items()}
    out = []
    for q in sorted(i for i in whole if i % 20 == 0):
        scores = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return out


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def search(docs, items, k=10):
    """op12: {(item, rank): (key, score)} of documents [(key, text)] and items [(item, text)]."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    rows = [(key, Counter(terms(t))) for key, t in docs]
    rows = [(key, tf) for key, tf in rows if tf]
    n_docs, n_words = len(rows), sum(sum(tf.values()) for _, tf in rows)
    df = Counter(t for _, tf in rows for t in tf)
    out = {}
    for item, text in items:
        scores = []
        for key, tf in rows:
            m = 10 + (90 * sum(tf.values()) * n_docs) // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in set(terms(text)) if tf[t])
            if score > 0:
                scores.append((-score, key is None, key or 0))
        for rank, (score, empty, key) in enumerate(sorted(scores)[:k], 1):
            out[item, rank] = (None if empty else key, -score)
    return out


def variants(texts, damage=199, letters=6, least=5, ratio=5):
    """op13: rows (word, form, root, n, n_near, form_n) of texts [(key, text)]."""
    counts = Counter()
    for key, text in texts:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= letters and n >= least}
    by_gap = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by_gap[w[:i] + "*" + w[i + 1 :]].add(w)
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            near[w] |= by_gap[w[:i] + "*" + w[i + 1 :]] - {w}
            short = w[:i] + w[i + 1 :]
            if short in words:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= ratio * n:
            form[w] = best
    rows = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(rows)


def bpe_rows(texts, path):
    """op11: {key: (n_tokens, ids_sha256, decoded_sha256)} by the library."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    out = {}
    for key, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        out[key] = (len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))
    return out
