"""Spelling variants against a brute force over sets of strings."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillmark.llm import spelling
from rillmark.llm.queries import QUERIES


def brute(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{key}:{run}".encode()) if key is not None else 1
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    gaps = {}
    for w in words:  # words that share all but one place, or that the other has one letter more than
        for i in range(len(w)):
            gaps.setdefault((len(w), i, w[:i] + w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = top if top is not None and words[top] >= 10 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, words[w], len(near[w]), None if form[w] is None else words[form[w]])
    return out


def check(got, rows):
    found = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got.collect()]
    assert {r[0]: r for r in found} == brute(rows) and len({r[0] for r in found}) == len(found)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aabcß"), min_size=1, max_size=6), st.sets(st.sampled_from("abcßÿ"), min_size=1))
def test_neighbourhood_is_each_candidate_once(word, alphabet):
    letters = np.array(sorted(ord(c) for c in alphabet), np.uint8)
    h, row, edit, at = spelling.neighbourhood(spelling._code(word + word).reshape(2, -1), letters)
    made = [spelling.apply_edit(word, e, p) for e, p in zip(edit.tolist(), at.tolist(), strict=True)]
    expected = {word[:i] + word[i + 1 :] for i in range(len(word))}
    expected |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet} - {word}
    expected |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    for k in (0, 1):
        own = [m for m, r in zip(made, row, strict=True) if r == k]
        assert sorted(own) == sorted(expected)
    assert np.array_equal(h, spelling.hashes(made))


@pytest.mark.parametrize("bits", [1 << 27, 1 << 10])
def test_variants_of_invented_words(spark, monkeypatch, bits):
    monkeypatch.setattr(spelling, "MOST_BITS", bits)  # a filter too small lets more through, and nothing else
    rnd = random.Random(5)
    stems = ["".join(rnd.choice("abeéÿ") for _ in range(rnd.randrange(6, 11))) for _ in range(60)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rnd.randrange(30)):
            w = stems[int(rnd.random() ** 4 * 60)]
            if rnd.random() < 0.1:
                at = rnd.randrange(len(w))
                w = w[:at] + rnd.choice(["", "a", "b" + w[at], "É"]) + w[at + 1 :]
            words.append(w.upper() if rnd.random() < 0.1 and w.isascii() else w)
        rows.append((i if i % 40 else None, rnd.choice([" ", "-", "1"]).join(words)))
    rows += [(900, None), (901, ""), (902, "x"), rows[3], rows[3], (903, "aaaaaaa " * 3000 + "aaaaaaaa " * 20 + "aaaaaaba aaaaaaba")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "key", "source", "form")})
    check(spelling.variants(docs.repartition(3)), rows)


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string")).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(QUERIES["op11_spelling"](spark, sf), rows)
