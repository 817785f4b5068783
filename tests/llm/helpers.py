"""Small tables with every awkward case, and plain-Python versions of what the operators compute."""

import random
import re

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, component_id long, n_hit long"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def docs(spark, rows):
    """rows of (doc_id, text[, source]); the other columns have names that operators might use inside."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), 7, "x", 5, 3) for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


def random_texts(n, seed, vocabulary=60, length=40):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(vocabulary)]
    return [" ".join(r.choice(words) for _ in range(r.randint(0, length))) for _ in range(n)]


def edited(text, r, share):
    words = text.split(" ")
    for i in range(len(words)):
        if r.random() < share:
            words[i] = "new" + str(r.randint(0, 99))
    return " ".join(words)


def ascii_lower(text):
    return text.translate(ASCII_LOWER)


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def smallest_reachable(nodes, links):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
