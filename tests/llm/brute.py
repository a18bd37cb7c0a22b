"""Brute-force results of the contracts, row by row and without Spark."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import tiktoken
import xxhash
from tokenizers import Tokenizer

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def held(doc_id, parts, rest):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % parts == rest


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=4):
    """Component label of each fingerprint."""
    nodes = sorted(set(fps))
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array(nodes, np.uint64)
    for i, x in enumerate(nodes):
        differ = np.unpackbits((values[i + 1 :] ^ np.uint64(x)).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1)
        for j in np.flatnonzero(differ <= radius):
            a, b = root(x), root(nodes[i + 1 + int(j)])
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def simhash(rows):
    """doc_id -> fingerprint, component."""
    fps = [(i, fingerprint(t)) for i, t in rows]
    label = components([f for _, f in fps])
    least = {}
    for i, f in fps:
        least[label[f]] = min(i, least.get(label[f], i))
    return {i: (f"{f:016x}", least[label[f]]) for i, f in fps}


def similar(rows):
    """doc_id -> smallest id that links of Jaccard similarity 0.8 or more between sets of five-word shingles reach."""
    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = WORDS.findall(low)
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                old, new = label[i], label[j]
                label = [new if k == old else k for k in label]
    least = {}
    for (i, _), k in zip(rows, label, strict=True):
        least[k] = min(i, least.get(k, i))
    return {i: least[k] for (i, _), k in zip(rows, label, strict=True)}


def rules(text):
    words = WORDS.findall(text or "")
    n = len(words)
    at = defaultdict(list)
    for i in range(n - 7):
        at[tuple(words[i : i + 8])].append(i)
    marked = {i + k for found in at.values() if len(found) > 1 for i in found for k in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    failed = n < 20 or 100 * len(marked) > 30 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(marked), failed


def bpe(texts):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in texts:
        ids = coder.encode_ordinary(text or "")
        packed = np.array(ids, "<u4").tobytes()
        yield len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def byte_words(texts):
    """Count, digest of the ids and digest of the decoded text, by the library itself."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    for text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        yield len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def word_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def check_pieces(rows, texts_by_id):
    """Pieces of unique documents: every id once, gapless sequences within the capacity. Gives padding and windows."""
    ids = dict(zip(texts_by_id, word_ids(texts_by_id.values()), strict=True))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] > 0 and zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"]
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(ids[doc])
    assert set(by_doc) == set(ids)
    fill = []
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        fill.append(at)
    return sum(4096 - x for x in fill), fill


def top_k(rows, k=20):
    """(query row, rank) -> id, score; `rows` are (id, vector)."""
    good = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not good:
        return []
    width = max(len(v) for _, v in good)
    m = np.stack([np.pad(v, (0, width - len(v))) for _, v in good])
    ids = np.array([i for i, _ in good])
    out = []
    for n, (i, _) in enumerate(good):
        if i % 20 == 0:
            s, other = m @ m[n], ids != i
            order = np.lexsort((ids[other], -s[other]))[:k]
            out += [(i, r + 1, int(ids[other][j]), int(s[other][j])) for r, j in enumerate(order)]
    return sorted(out)


def pages(rows):
    """page_id -> bytes, digest, type, refers_to."""
    groups = defaultdict(list)
    for i, html in rows:
        raw = (html or "").encode()
        groups[raw].append(i)
    out = {}
    for raw, ids in groups.items():
        first = max((i for i in ids if i is not None), default=None)
        for i in ids:
            revisit = len(raw) >= 1000 and i is not None and i != first
            out[i] = (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None)
    return out


def whitening(rows, k=8):
    """(id, component) -> n, deviation, |whitened|, explained; `rows` are (id, vector)."""
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dims = max((len(v) for _, v in good), default=0)
    x = np.array([[*v, *[0.0] * (dims - len(v))] for _, v in good], np.float64).reshape(len(good), dims)
    x = np.floor(1024 * x).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for (i, _), row, c in zip(good, x, centred, strict=True):
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total, strict=True))
        for j in range(min(k, dims)):
            if values[j] > 1e-11 * values[0] > 0:
                out.append((i, j + 1, n, deviation, abs(c @ vectors[:, j]) / np.sqrt(values[j]), values[j] / values.sum()))
    return out


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(fields):
    return _h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def _levels(digests):
    """Each leaf's siblings (left, right) up the tree, and the top."""
    ways, members, nodes = [[] for _ in digests], [[i] for i in range(len(digests))], list(digests)
    while len(nodes) > 1:
        upper, above = [], []
        for a in range(0, len(nodes), 3):
            run = nodes[a : a + 3]
            for k in range(len(run)):
                for i in members[a + k]:
                    ways[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            upper.append(_h(*run))
            above.append([i for m in members[a : a + 3] for i in m])
        nodes, members = upper, above
    return ways, nodes[0] if nodes else None


def merkle(rows):
    """Sorted rows of the manifest; `rows` are (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        tampered = r
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
            tampered = (*r[:4], r[4].replace("\n", ""))
        groups[r[1]].append(((r[0] is not None, r[0] or 0, _leaf(r)), r[0], _leaf(r), _leaf(tampered)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort()
        trees[s] = _levels([x[2] for x in groups[s]])
    above, root = _levels([trees[s][1] for s in order])
    out = []
    for s, way in zip(order, above, strict=True):
        for (_, i, leaf, tampered), own in zip(groups[s], trees[s][0], strict=True):
            steps, d = own + way, tampered
            for left, right in steps:
                d = _h(left, d, right)
            out.append((i, leaf, trees[s][1], root, _h(*(x for step in steps for x in step)), d, d == root))
    return out
