"""The trigram model of tessera.llm.language_model in plain Python, for tests."""

import math
import re
import zlib
from collections import Counter, defaultdict

from tessera.llm.language_model import discounts

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), ("end",)]


def scores(docs):
    """docs: (id, text) pairs; returns id -> (held_out, n_tokens, n_known, N, base, score)."""
    out_of = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    uni, tri = Counter(), Counter()
    pad = ("start",)
    grams = lambda t: list(zip([pad, pad, *t], [pad, *t], t))
    for i, text in docs:
        if not out_of[i]:
            t = tokens(text)
            uni.update(t)
            tri.update(grams(t))
    n, v = sum(uni.values()), len(uni)
    two = Counter((b, c) for _, b, c in tri)  # distinct words before each pair
    one = Counter(c for _, c in two)  # distinct words before each word
    of = lambda counts: discounts(*[sum(1 for c in counts.values() if c == k) for k in (1, 2, 3, 4)])
    d1, d2, d3 = of(one), of(two), of(tri)
    cut = lambda c, d: max(c - d[min(c, 3) - 1], 0) if c else 0
    total, succ = Counter(), defaultdict(Counter)
    for counts in (two, tri):
        for k, c in counts.items():
            total[k[:-1]] += c
            succ[k[:-1]][min(c, 3)] += 1
    pairs = sum(one.values())
    left = sum(d1[min(c, 3) - 1] for c in one.values()) / pairs if pairs else 1.0

    def level(context, gram, counts, d, low):
        if not total[context]:
            return low
        return cut(counts[gram], d) / total[context] + sum(d[k - 1] * succ[context][k] for k in (1, 2, 3)) / total[context] * low

    def p(a, b, c):
        low = (cut(one[c], d1) / pairs if pairs else 0) + left / (v + 1)
        return level((a, b), (a, b, c), tri, d3, level((b,), (b, c), two, d2, low))

    out = {}
    for i, text in docs:
        t = tokens(text)
        base = sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        out[i] = (out_of[i], len(t), sum(x in uni for x in t), n, base, sum(math.log10(p(*g)) for g in grams(t)))
    return out
