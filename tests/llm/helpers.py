"""Small tables and brute-force models."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np

WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """A documents table of (doc_id, text)."""
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS)


def saved(spark, tmp_path, rows, labels=()):
    """The folder of a documents and a labels table with these rows, and with extra columns whose names operators use themselves."""
    extra = ["doc", "score", "kept", "n_words", "digest", "band", "root", "class", "gone", "asked", "line", "s", "t", "l", "__x"]
    df = documents(spark, rows)
    from pyspark.sql import functions as F

    df.withColumns({c: F.lit("clash") for c in extra}).coalesce(2).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").withColumn("y", F.lit(5)).write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def words(text):
    return re.findall(WORD, text or "")


def windows_removed(rows, size=20):
    seen, out = set(), {}
    for d, t in ordered(rows):
        w, gone = words(t), set()
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if k in seen:
                gone.update(range(i, i + size))
            seen.add(k)
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


def within_one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = max(a, b, key=len), min(a, b, key=len)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def lines_removed(rows, least=20):
    before, out = [], {}
    for d, t in ordered(rows):
        pieces, gone = (t or "").split("\n"), []
        for i, x in enumerate(pieces):
            x = x.strip(" \t\n\x0b\x0c\r")
            if len(x) >= least:
                if any(within_one_edit(x, y) for y in before):
                    gone.append(i)
                before.append(x)
        kept = "\n".join(x for i, x in enumerate(pieces) if i not in gone)
        out[d] = (len(pieces) if t else 0, len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def weighted_shingles(text):
    w = words(text)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    return {k: 1 + np.log(v) for k, v in c.items()}


def probability_jaccard(x, y):
    both = set(x) | set(y)
    return sum(1 / sum(max(x.get(q, 0) / x[i], y.get(q, 0) / y[i]) for q in both) for i in set(x) & set(y))


def near_classes(rows, threshold=0.8):
    sets = {d: weighted_shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if set(sets[a]) & set(sets[b]) and probability_jaccard(sets[a], sets[b]) >= threshold:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def exact_groups(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", t or ""), []).append((-len(t or ""), d))
    out = {}
    for n, g in groups.items():
        for _, d in g:
            out[d] = (min(g)[1], len(g), min(g)[1] == d, hashlib.sha256(n.encode()).hexdigest())
    return out


def prose(rng, n, vocabulary="abcdefghijklmnop"):
    return [rng.choice(vocabulary) * rng.randint(1, 4) for _ in range(n)]


def copies(seed=1):
    """Texts with near copies, exact copies, shared passages, blanks and nulls."""
    rng = random.Random(seed)
    base, rows = prose(rng, 120), []
    for i in range(40):
        x = base[:]
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(len(x))] = f"w{rng.randrange(1000)}"
        rows.append((i, " ".join(x)))
    for i in range(40, 70):
        rows.append((i, " ".join(prose(rng, rng.randint(0, 60)))))
    for i in range(70, 90):
        other = rows[rng.randrange(70)][1].split()
        at = rng.randrange(len(other) + 1)
        rows.append((i, " ".join(prose(rng, 30) + other[at : at + rng.randint(10, 60)] + prose(rng, 5))))
    for i in range(90, 110):
        rows.append((i, rows[rng.randrange(90)][1].replace(" ", rng.choice([" ", "  ", "\n"]))))
    return rows + [(200, ""), (201, None), (202, " \n"), (203, "one two"), (204, "one  two"), (205, "x " * 70), (206, "é 🙂 " + "x " * 45)]
