"""Small corpora with planted copies, passages, junk and edge rows."""

import random

SYLLABLES = "an ba co de er fi gu ha in jo ka le mo na or pe ri sa te un é ñ ü".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, bucket int, rep long, h1 long, key string, _text string, a long, b long"


def sentence(r, low=4, high=14):
    w = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
    return " ".join(w).capitalize() + r.choice([". ", ".\n", "! "])


def text(r, n):
    return "".join(sentence(r) for _ in range(n)).strip()


def corpus(seed=5, n=60):
    """(doc_id, text) pairs."""
    r = random.Random(seed)
    docs = [text(r, r.randint(1, 30)) for _ in range(n)]
    passage = text(r, 6)
    docs += [docs[3], docs[3], docs[5]]
    for k in (7, 8, 9):
        w = docs[k].split(" ")
        w[len(w) // 2] = "changed"
        docs.append(" ".join(w))
    docs += [text(r, 4) + " " + passage + " " + text(r, 5) for _ in range(4)]
    docs += ["", "   ", "one", "one two three", "One two three", "x " * 400, "aaaa" * 60, "aaaa" * 60 + "b", "*** $$$ " * 30, None, "ab\x00cd é" * 20, "\n\n.\n"]
    docs.append(" ".join(f"w{k}" for k in range(6000)))
    return [(k * 3 % 1009, t) for k, t in enumerate(docs)]


def table(spark, rows, repeat=()):
    full = [(i, t, None, None, len(t) if t else None, 1, 2, 3, 4, "k", "x", 5, 6) for i, t in [*rows, *repeat]]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
