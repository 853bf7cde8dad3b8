"""Plain-Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from textwarden.llm.tokens import default_vocabulary

_tokenizer = None


def ids_of(text):
    global _tokenizer
    if _tokenizer is None:
        _tokenizer = Tokenizer.from_file(default_vocabulary())
        _tokenizer.encode_special_tokens = True
    return [*_tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def shingles(words, n):
    if not words:
        return frozenset()
    k = min(n, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def components(rows, n, num, den):
    """rows: (doc_id, text); doc_id -> (set size, smallest doc_id reachable)."""
    sets = {d: shingles(blank_words(t), n) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def leaks(docs, items, num=4, den=5, n=5):
    """(doc_id, item_id, size of the item, common shingles)."""
    out = set()
    for item, text in items:
        words = plain_words(text)
        s = shingles(words, n)
        for d, t in docs:
            w = plain_words(t)
            k = min(n, len(words))
            have = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
            if s and den * len(s & have) >= num * len(s):
                out.add((d, item, len(s), len(s & have)))
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def runs(words, least=12):
    """(start, length, period) of every maximal run with its smallest period, by start and period."""
    out = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q - i), q)  # the smallest period of a stretch comes first
            i = j
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def collocations(rows, support=30, longest=4, limit=2000, percent=80):
    """rows: (lang, text); the contract of the phrases, by counting every phrase."""
    n, f = Counter(), {}
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang or "und", Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        gone = {q for p, a in found.items() for q in (p[:-1], p[1:]) if len(q) > 1 and 100 * a >= percent * counts[q]}
        best = []
        for p, a in found.items():
            if p not in gone:
                score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, p, left, right) in enumerate(sorted(best)[:limit]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)
