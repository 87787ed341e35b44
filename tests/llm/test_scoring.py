"""Classifiers by held-out accuracy, counts by brute force, ids by the library, mixing and links by hand."""

import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chalkline.llm import licenses, mixing, quality, quotes, sentencepiece_fst, toxicity
from chalkline.llm.kernels import Words, blocks

from . import helpers as h

SF = "/root/testdata/sf0.1"


def base_counts(text):
    text = text or ""
    w, seen, dup = h.words(text), set(), 0
    for line in text.split("\n"):
        if h.words(line):
            dup += line in seen
            seen.add(line)
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return [len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)]


def test_quality_counts():
    rng = random.Random(1)
    texts = ["", None, " ", "a b a b a b", "x\n\nx\n x\nx", "é ü\n\té#*", "\n"] + ["".join(rng.choice("ab \n#é") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    got = []
    for _, _, data, offsets in blocks(pa.array(texts), 999):
        c = quality.base_counts(Words(data, offsets))
        got += [list(x) for x in zip(*(c[k].tolist() for k in c))]
    assert got == [base_counts(t) for t in texts]


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    test = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    model = quality.fit(quality.labelled_sample(docs, labels.where(~test), "quality", 600))
    out = quality.quality(docs, model).join(labels.where(test), "doc_id").collect()
    right = [r.kept == (r.quality == 1) for r in out if not r.base_failed]
    assert sum(right) / len(right) > 0.95
    good = [r.kept for r in out if r.quality == 1 and not r.base_failed]
    assert sum(good) / len(good) > 0.97


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.trained(docs, labels)
    out = toxicity.toxicity(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in out)
    assert sum(r.predicted == r.toxic for r in out) / len(out) > 0.95
    harmless = [r.predicted for r in out if r.toxic == 0]
    assert sum(harmless) / len(harmless) < 0.02
    score = lambda *texts: [float(x) for _, _, d, o in blocks(pa.array(texts)) for x in model.score(d, o)]
    plain, spaced, marked, doubled, clean, empty = score("You are an idiot.", "You are an i d i o t.", "You are an id*iot.", "You are an idioot.", "The of and to.", "")
    assert min(plain, spaced, marked, doubled) > 10 * max(clean, empty)


def test_toxicity_without_labels(spark):
    docs = h.documents(spark, [(1, "x"), (2, None)])
    model = toxicity.trained(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r.predicted for r in toxicity.toxicity(docs, model).collect()] == [0, 0]


TEXTS = ["", None, "MIT  License", "cc\nby", "gnu-general public,license GNU General\tPublic License", "cc by cc by cc", "É MIT license", "the apachelicense", "Licensed under the Apache License, Version 2.0.", "Released under CC BY-NC 4.0"]


def test_license_base_places(spark):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choice(["cc", "by", "mit", "license", "gnu", "general", "public", "apache", "É", "x"]) for _ in range(rng.randint(0, 30))) for _ in range(100)]
    out = licenses.licenses(h.documents(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    for t, r in zip(texts, out):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}


def test_license_priority_and_containment():
    found = licenses.scan("licensed under the gnu lesser general public license, version 2.1. released under cc by-nc-sa 4.0")
    assert [d[0] for d in found] == ["lgpl", "cc-by-nc-sa"]
    assert licenses.scan("spdx-license-identifier: apache-2.0")[0][::3] == ("apache", 1.0)
    assert licenses.scan("the of and") == [] and len(licenses.rules()) > 200


def wrapped(pattern, pick):
    """A text that the pattern matches, with every run of white space broken over two lines; of alternatives it takes the one numbered pick."""
    import re._parser as parser

    def some(parsed):
        out = ""
        for op, arg in parsed:
            op = str(op)
            if op == "LITERAL":
                out += chr(arg)
            elif op == "IN":
                kind, value = str(arg[0][0]), arg[0][1]
                out += chr(value) if kind == "LITERAL" else {"CATEGORY_SPACE": " \n ", "CATEGORY_DIGIT": "2", "CATEGORY_WORD": "x"}[str(value)]
            elif op == "BRANCH":
                out += some(arg[1][pick % len(arg[1])])
            elif op == "SUBPATTERN":
                out += some(arg[3])
            elif op == "MAX_REPEAT":
                out += some(arg[2]) * arg[0]
            else:
                assert op == "AT"
        return out

    return some(parser.parse(pattern))


def test_no_gate_hides_a_wrapped_match():
    for r in licenses.rules():
        for pick in range(3):
            text = wrapped(r.pattern.pattern, pick)
            match = r.pattern.search(text)
            assert match, (r, text)
            assert any(g in text.encode() for g in licenses.GATES), (r.label, text)
            assert any(s <= match.start() and match.end() <= e for _, s, e, _ in licenses.scan(text)), (r.label, text)


def test_license_phrases_broken_at_a_line_end(spark):
    texts = ["GNU Lesser General\nPublic License", "All\nrights  reserved", "This program is free\n   software; you can redistribute it", "Creative  Commons\nZero"]
    out = licenses.licenses(h.documents(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [r.labels for r in out] == ["lgpl", "proprietary", "gpl", "cc0"] and all(r.score > 0 for r in out)


def test_ids_are_those_of_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL_PATH)
    with open(sentencepiece_fst.MODEL_PATH, "rb") as f:
        fst = sentencepiece_fst.Transducer.load(f.read())
    rng = random.Random(3)
    texts = ["", " ", "  ", "a  b   c", "x" * 500, "def f(x):\n\treturn x  # ?", "日本語テキスト", "3.14", "The quick brown fox", "▁a ▁▁"]
    texts += ["".join(rng.choice("abcdeintr  \n\té▁汉🙂") for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    for t in texts:
        ids = fst.encode(t)
        assert ids == library.encode(t)
        assert fst.decode(ids) == t.replace("▁", " ")


def test_unigram_takes_the_lightest_path():
    pieces = ["<unk>", "▁", "a", "b", "ab", "▁a", "▁ab", "c"]
    scores = [0.0, -2.0, -3.0, -3.0, -3.5, -2.5, -7.0, -1.0]
    fst = sentencepiece_fst.Transducer(pieces, scores, [2, 1, 1, 1, 1, 1, 1, 1], bpe=False, byte_fallback=False, dummy_prefix=True, collapse=True)

    def brute(text):
        text, best = fst.normalise(text), {0: (0.0, [])}
        for i in range(1, len(text) + 1):
            best[i] = min((best[j][0] - scores[k], best[j][1] + [k]) for j in range(i) for k, p in enumerate(pieces) if k and text[j:i] == p)
        return best[len(text)][1]

    for text in ("ab", "a b", "abc ab", "cab  b", "aab"):
        assert fst.encode(text) == brute(text)
    assert fst.encode("xya") == [1, 0, 2]  # neighbouring unknown characters are one piece


def test_mixing_meets_the_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(h.prose(rng, rng.randint(20, 60))) + rng.choice(["", " ?", " @"]), rng.choice(["en", "en", "en", "de", "fr"]), rng.choice(["a"] * 5 + ["b", "c"]), 0) for i in range(3000)]
    rows += [(9000, None, None, None, None), (9001, "", "en", "a", 0), (9002, "one", None, None, None)]
    out = mixing.mixed(spark.createDataFrame(rows, h.DOCS), budget=0.2).collect()
    assert len(out) == len(rows) and not any(r.selected for r in out if r.doc_id in (9000, 9001))
    total = sum(r.n_tokens for r in out)
    assert sum(r.n_tokens * r.probability for r in out) == pytest.approx(0.2 * total, rel=0.01)
    part = [r for r in out if r.selected]
    assert sum(r.n_tokens for r in part) == pytest.approx(0.2 * total, rel=0.1)
    share = lambda key, value: sum(r.n_tokens * r.probability for r in out if getattr(r, key) == value) / (0.2 * total)
    weights = {k: v for k, v in mixing.LANGUAGES.items() if k != "es"}
    for k, v in weights.items():
        assert share("lang", k) == pytest.approx(v / sum(weights.values()), abs=0.01)  # one token of other languages can't hold their share


def test_mixing_gives_every_source_its_target(spark):
    rows = [(i, "one two three four", "en", f"s{i}", 0) for i in range(300)]
    out = mixing.mixed(spark.createDataFrame(rows, h.DOCS)).collect()
    assert len(out) == 300 and all(r.probability == pytest.approx(0.8) for r in out)


CHAT = [
    (1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "On Monday you wrote:\n> how ARE you\nFine."), (1, 2, "user", "> > Hello, there\n> Fine.\nGood"), (1, 3, "user", "> unknown line\n> Good"),
    (1, 1500, "user", ">Good\nlate"), (2, 0, "user", None), (2, 0, "user", "Good"), (None, 1, "user", "> x"),
]


def test_quotes(spark):
    out = quotes.linked(spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.turn, r.text): (r.seq, r.parent_turn, r.n_quoted) for r in out.collect()}
    assert got == {
        (1, 0, "Hello there\nHow are you?"): (0, -1, 0), (1, 1, "Fine."): (1, 0, 1), (1, 2, "Good"): (2, 1, 2), (1, 3, ""): (3, 2, 2),
        (1, 1500, "late"): (4, 2, 1), (2, 0, ""): (0, -1, 0), (2, 0, "Good"): (1, -1, 0), (None, 1, ""): (None, -1, 1),
    }


def test_a_passage_counts_as_a_whole(spark):
    """A line that many say links to the message that says the passage, not to the latest one with the line."""
    chat = [(1, 0, "a", "Shall we?\nThanks"), (1, 1, "b", "No"), (1, 2, "c", "Thanks"), (1, 3, "b", "> Shall we?\n> Thanks\nYes"), (1, 4, "a", "> Thanks\nWelcome"), (1, 5, "a", "x wrote:\n>> Shall we?\n> Yes\nGood")]
    frame = spark.createDataFrame(chat, "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.parent_turn, r.n_linked, r.text) for r in quotes.linked(frame).collect()}
    assert got == {0: (-1, 0, "Shall we?\nThanks"), 1: (0, 0, "No"), 2: (1, 0, "Thanks"), 3: (0, 3, "Yes"), 4: (2, 1, "Welcome"), 5: (3, 3, "Good")}
    parts = quotes.threads(frame).collect()
    assert [(p.conv_id, p.part, [m.turn for m in p.messages]) for p in parts] == [(1, 0, [0, 1, 2, 3, 4, 5])]


def test_chat_query_on_empty_and_odd_tables(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string, seq string, passage string, level string"
    odd = [(None, None, None, None, "x", "x", "x"), (1, None, "a", "> x", "x", "x", "x"), (1, 0, None, None, "x", "x", "x"), (1, 1, "a", "z " * 3000 + "\n" + "> q\n" * 3000, "x", "x", "x"), (1, 1, "a", "z " * 3000 + "\n" + "> q\n" * 3000, "x", "x", "x")]
    for rows in ([], odd):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
        out = quotes.op7_chat_formatting(spark, str(tmp_path)).collect()
        assert len(out) == len(rows) and all((r.seq is None) == (r.conv_id is None or r.turn is None) for r in out)


def test_quotes_equal_the_sql(spark):
    import duckdb

    rng = random.Random(12)
    own = ["thanks", "see you", "Shall we meet?", "yes", "no", "the plan is good", ""]
    rows = []
    for conv in range(24):
        said = []
        for turn in range(rng.choice([1, 5, 30])):
            lines = []
            for _ in range(rng.randint(0, 4)):
                if said and rng.random() < 0.6:
                    block, level = rng.choice(said).split("\n"), rng.randint(1, 8)
                    lines += [rng.choice([">" * level + " ", " > " * level]) + x for x in block[: rng.randint(1, 3)]]
                else:
                    lines.append(rng.choice([*own, "x wrote:"]))
            said.append("\n".join(lines))
            rows.append((conv if rng.random() < 0.97 else None, turn * rng.choice([1, 1, 400]), rng.choice(["user", "assistant"]), said[-1] if rng.random() < 0.95 else None))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    duck = duckdb.connect()
    table = frame.toArrow()
    duck.register("conversations", table)
    out = quotes.linked(frame)
    got = duck.execute(f"SELECT {', '.join(out.columns)} FROM ({quotes.SQL})").fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, out.collect())) == sorted(map(key, got))
    assert sum(r.n_linked > 0 for r in out.collect()) > 10


def test_license_prefilter_hides_no_match():
    import random

    from chalkline.llm.license_rules import gates, rules
    from chalkline.llm.licenses import scan

    random.seed(5)
    cases = {
        "redistribution\nand use in source and binary forms": {"bsd"}, "permission  to use, copy, modify, and distribute this software": {"isc"},
        "released under the gnu lesser general\n * public license": {"lgpl"}, "sil open\nfont license": {"ofl"}, "creative\ncommons attribution 4.0": {"cc-by"},
        "this program is free\nsoftware; you can redistribute it": {"gpl"}, "creative commons attribution-noncommercial 4.0": {"cc-by-nc"}, "creative commons attribution-sharealike": {"cc-by-sa"},
        "apache 2.0 license": {"apache"}, "the simplified license": set(), "cc by-nc-nd and cc by 4.0": {"cc-by-nc-nd", "cc-by"}, "all\nrights reserved": {"proprietary"}, "": set(),
    }
    for text, labels in cases.items():
        assert {d[0] for d in scan(text)} == labels, text
        assert scan(text) == scan(text, prefilter=False)
        assert not labels or any(g.decode() in text for g in gates())
    words = sorted({w for text in cases for w in text.split()} | {"license", "version", "2.0", "mit", "bsd", "gnu", "public", "domain", "under", "the", "commons", "zero"})
    for _ in range(300):
        text = "".join(random.choice(words) + random.choice([" ", "  ", "\n", "\n * ", "-"]) for _ in range(40))
        assert scan(text) == scan(text, prefilter=False)
    assert len(rules()) > 200 and all(r.keywords for r in rules())


def test_license_intervals_do_not_overlap():
    from chalkline.llm.licenses import scan

    got = scan("licensed under the apache license, version 2.0 (the \"license\"); attribution-noncommercial-sharealike 4.0, gnu gpl v3 or gnu general public license v2 or later")
    assert all(a[2] <= b[1] for a, b in zip(got, got[1:])) and len(got) >= 4


def test_query_ids_are_those_of_the_library_and_decode(spark, tmp_path):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL_PATH)
    rows = [(1, None), (2, ""), (3, "  two  blanks "), (4, "a\n\tb\r\n c"), (5, "日本語 テスト 🙂 naïve"), (6, "mark▁inside ▁"), (7, "y" * 5000), (8, " "), (9, "x" * 39 + " " + "é" * 41), (None, "Hello world"), (1, "again")]
    folder = h.saved(spark, tmp_path, rows)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for table in (spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), docs):
        out = sentencepiece_fst.tokens(table).collect()
        texts = sorted((r.doc_id or -1, r.text or "") for r in table.collect())
        assert sorted((r.doc_id or -1, list(r.ids)) for r in out) == sorted((d, library.encode(t)) for d, t in texts)
        assert all(r.round_trip for r in out) and all(r.n_tokens == len(r.ids) for r in out)
        back = sentencepiece_fst.texts(sentencepiece_fst.tokens(table)).collect()
        assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((d, t.replace("▁", " ")) for d, t in texts)


def test_forgetful_encoder_gives_the_same_ids(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from chalkline.llm.kernels import blocks

    with open(sentencepiece_fst.MODEL_PATH, "rb") as f:
        fst = sentencepiece_fst.Transducer.load(f.read())
    texts = ["one two three", "two  three four\n", "", "three two"] * 5
    monkeypatch.setattr(sentencepiece_fst, "REMEMBERED", 2)
    monkeypatch.setattr(sentencepiece_fst, "PAIRS", 3)
    encoder, got = sentencepiece_fst.Encoder(fst), []
    for _, _, data, offsets in blocks(pa.array(texts, pa.large_string()), size=20):
        ids, counts, _ = encoder.encode(data, offsets)
        got += [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [fst.encode(t) for t in texts]


def test_shortest_path_equals_all_paths():
    """A unigram model: the weight of the path is the least of all segmentations."""
    pieces = ["<unk>", "▁", "a", "b", "ab", "▁a", "ba", "▁ab"]
    scores = [0.0, -1.0, -2.0, -2.5, -3.1, -2.2, -4.0, -5.6]
    fst = sentencepiece_fst.Transducer(pieces, scores, [2, 1, 1, 1, 1, 1, 1, 1], bpe=False)

    def least(text):
        return 0.0 if not text else min(-scores[i] + least(text[len(p):]) for i, p in enumerate(pieces) if i and text.startswith(p))

    for text in ("▁ab", "▁abba", "ababab▁a", "▁▁bab"):
        assert abs(sum(-scores[i] for i in fst.shortest(text)) - least(text)) < 1e-9


BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
u AS (SELECT doc_id, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
i AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d),
g AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM i),
r AS (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT g.doc_id, unnest([g.i, g.i + 1, g.i + 2]) AS p FROM g JOIN r ON r.doc_id = g.doc_id AND r.g = g.g) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
       coalesce((SELECT sum(n - 1) FROM u WHERE u.doc_id = d.doc_id), 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN c USING (doc_id)"""


def test_base_counts_of_the_query_equal_sql(spark):
    import duckdb

    duck = duckdb.connect()
    duck.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = quality.op4_quality_rules(spark, "/root/testdata/sf0.001")
    got = sorted(tuple(r) for r in out.select(*names).collect())
    assert got == sorted(duck.execute(f"SELECT {', '.join(names)} FROM ({BASE_SQL})").fetchall())
    assert not out.where("base_failed AND kept").count()


def test_character_ngrams_are_of_characters():
    import numpy as np
    import pyarrow as pa

    from chalkline.llm.kernels import Words, blocks

    texts = ["añb", "", "日本語テスト", "ab", "éééé x"]
    for _, _, data, offsets in blocks(pa.array(texts, pa.large_string())):
        families = list(quality._grams(Words(data, offsets)))
    for k, (bucket, first) in ((3, families[2]), (4, families[3])):
        assert list(np.diff(first)) == [max(0, len(t) - k + 1) for t in texts] and len(bucket) == first[-1]


def test_kernel_equals_all_subsequences():
    from itertools import combinations

    import numpy as np

    def features(word):
        out = {}
        for at in combinations(range(len(word)), toxicity.ORDER):
            key = bytes(word[i] for i in at)
            out[key] = out.get(key, 0.0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    def kernel(s, t):
        a, b = features(s), features(t)
        dot = lambda x, y: sum(v * y.get(k, 0.0) for k, v in x.items())
        return dot(a, b) / max(1e-12, dot(a, a) * dot(b, b)) ** 0.5

    words = [toxicity.unit(w) for w in (b"idiot", b"ixdiot", b"idiots", b"toidi", b"banana", b"abc", b"loser", b"closers")]
    got = toxicity._kernel(words, toxicity.Landmarks(words))
    assert np.abs(got - np.array([[kernel(s, t) for t in words] for s in words])).max() < 1e-5
    assert np.linalg.eigvalsh(got.astype(float)).min() > -1e-6  # a positive-definite kernel


def test_disguised_insults_are_found(spark):
    """Recall by the number of letters inserted into insults that were learnt plain."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.trained(docs, labels)
    rng = random.Random(11)

    def inserted(word, n):
        s = list(word)
        for at in sorted(rng.sample(range(1, len(word)), n), reverse=True):
            s.insert(at, rng.choice("abcdefghijklmnopqrstuvwxyz"))
        return "".join(s)

    found = {}
    for n in range(4):
        texts = [f"You are a {inserted(rng.choice(['idiot', 'stupid', 'scum', 'trash', 'clown']), n)} and more" for _ in range(200)]
        found[n] = sum(int(x >= 0.5) for _, _, d, o in blocks(pa.array(texts)) for x in model.score(d, o)) / 200
    assert found[0] > 0.95 and found[1] > 0.75 and found[2] > 0.4, found


def test_vocabulary_of_the_fit_holds_little_memory():
    rng = np.random.default_rng(5)
    some = ["".join(map(chr, rng.integers(97, 123, 8))) for _ in range(5000)]
    texts = [" ".join(some[i] for i in rng.integers(0, len(some), 400)) for _ in range(600)]
    tracemalloc.start()
    try:
        count, contexts = toxicity._vocabulary(texts, contexts=True)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert len(count) == len(contexts) == 5000 and sum(count.values()) == sum(len(set(x.split())) for x in texts)
    assert max(contexts.values()) <= max(count.values()) and peak < 80, peak
