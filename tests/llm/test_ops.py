"""The ten operators against brute force, on small tables with nulls, ties, repeats and odd texts."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
import re
import time
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillmark.llm import bpe, chat, components, decontaminate, exact_dedup, html_extract, jaccard_join, language, lm_score, token_files, warc, words

DOCS = "doc_id long, text string, lang string, row_id long, body string"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))


def some_texts(seed=5, n=60):
    draw = random.Random(seed)
    vocabulary = ["the", "of", "Été", "naïve", "Zug", "ÜBER", "x1", "don't", "日本", "data", "spark", "7", "a-b"]
    texts = [" ".join(draw.choice(vocabulary) for _ in range(draw.choice([1, 3, 4, 5, 9, 40, 120]))) for _ in range(n)]
    for i in range(0, n, 6):  # near copies
        parts = texts[i].split()
        parts[draw.randrange(len(parts))] = "changed"
        texts.append(" ".join(parts))
    return [*texts, texts[0], texts[3], texts[3], None, "", "   \n\t ", "word " * 3000, "a" * 5000, " x ", "A B\x0bC\x0cD"]


def documents(spark, texts=None):
    texts = some_texts() if texts is None else texts
    rows = [(i, t, ["en", "fr", None][i % 3], i * 7, "other") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "null id", None, None, None), rows[0] if rows else (0, None, None, None, None)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def pairs(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


# ---- shared parts ---------------------------------------------------------------------------


def test_word_hashes_tell_words_apart_in_any_chunking():
    texts = some_texts()
    column = pa.array(texts, pa.string())
    seen = {}
    for chunk in (7, 100, 1 << 20):
        for part in words.words(column, chunk):
            for i in range(len(part.at) - 1):
                own = part.hashes[part.at[i] : part.at[i + 1]].tolist()
                expected = split(texts[part.first + i])
                assert len(own) == len(expected)
                for h, w in zip(own, expected):
                    assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_word_hashes_of_slices_and_nulls():
    column = pa.array(["a b", None, "c", "d e f"]).slice(1)
    assert [len(p) for p in ([np.diff(x.at).tolist() for x in words.words(column)])] == [3]
    assert list(words.words(pa.array([], pa.string()))) == []


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(80), draw.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


# ---- 1 chat ---------------------------------------------------------------------------------


def test_chat_events_fold(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"),
        (1, 1, 1, "message", "assistant", "draft"),
        (1, 1, 2, "delta", None, " more"),
        (1, 2, 3, "message", "user", "gone"),
        (1, 1, 4, "regenerate", "assistant", "new"),
        (1, 1, 5, "delta", None, " text"),
        (1, 2, 6, "message", "user", "again"),
        (1, 2, 7, "edit", None, "edited"),
        (2, None, None, "message", None, None),
        (2, 0, 1, "delta", "assistant", "<|im_end|>\\|<|"),
    ]
    draw = random.Random(2)
    draw.shuffle(log)
    frame = spark.createDataFrame([(*x, "extra") for x in log], "conv_id long, message long, seq long, event string, role string, text string, piece string")
    rows = sorted((r["conv_id"], r["piece"], r["formatted"], r["loss_from"], r["loss_to"]) for r in chat.format_chats(frame).collect())
    text = {c: "".join(r[2] for r in rows if r[0] == c) for c in (1, 2)}
    assert chat.read_turns(text[1]) == [("user", "hi"), ("assistant", "new text"), ("user", "edited")]
    assert chat.read_turns(text[2]) == [("", ""), ("assistant", "<|im_end|>\\|<|")]
    assert [chat.unescape(r[2][r[3] : r[4]]) for r in rows if r[4] > r[3]] == ["new text", "<|im_end|>\\|<|"]


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|x<|im_end|>", "<", "|", "<|im_start|>user\nx<|im_end|>\n", "<<||>>\\"])
def test_chat_escape_is_reversible(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
    rendered, start, end = chat.render("assistant", text)
    assert chat.read_turns(rendered * 2) == [("assistant", text)] * 2 and chat.unescape(rendered[start:end]) == text
    assert chat.read_turns(chat.render("a\\n\n" + text, text)[0]) == [("a\\n\n" + text, text)]


def test_chat_digests_and_empty(spark):
    turns = spark.createDataFrame([(5, 1, "assistant", "two"), (5, 0, "user", None), (5, 1, "assistant", "two"), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digest_chats(chat.format_chats(chat.log_of_turns(turns))).collect()}
    expected = hashlib.sha256(b"user\n\nassistant\ntwo\nassistant\ntwo\n").hexdigest()
    assert got[5]["turns_sha256"] == expected and got[5]["n_turns"] == 3 and got[5]["loss_chars"] == 6
    assert got[5]["loss_sha256"] == hashlib.sha256(b"twotwo").hexdigest() and got[None]["n_turns"] == 1
    assert chat.digest_chats(chat.format_chats(chat.log_of_turns(turns.limit(0)))).count() == 0


def test_chat_streamed_log_folds_back(spark):
    draw = random.Random(6)
    rows = [(c, t, draw.choice(["user", "assistant", "system", None]), draw.choice(["", "x", None, "é<|im_end|>\n", "<\\|im_start|>assistant ok", "longer text of it"])) for c in range(12) for t in range(draw.randrange(1, 9))]
    rows += [(3, 0, "user", "tie"), (3, 0, "assistant", "tie"), (3, 0, "user", "tie"), (None, None, None, None), (None, 2, "assistant", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    key = lambda f: sorted(map(repr, chat.digest_chats(chat.format_chats(f)).collect()))
    assert key(chat.streamed_log(turns)) == key(chat.log_of_turns(turns.fillna("", ["role", "text"])))
    assert chat.streamed_log(turns).filter("event in ('regenerate', 'edit', 'delta')").count() > 60


# ---- 2 BPE ----------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_bpe_equals_tiktoken(name):
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path(name))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.BytePairCodec(ranks, public_tokenizers.PATTERN)
    draw = random.Random(9)
    odd = [" x", "x ", "a  b c", "a \n b", "a\n  \n  b", " ", "   ", "it's we'll I'M", "  x", "a" * 3000, " " * 500 + "z", "".join(draw.choice("etaoinshr") for _ in range(2000)), "".join(chr(draw.choice([draw.randrange(33, 127), draw.randrange(161, 900), draw.randrange(0x4E00, 0x9FFF), 0x1F600])) for _ in range(3000))]
    odd += ["".join(draw.choice(["a", " ", "\n", "b.", "\t", "7", "'s", " "]) for _ in range(40)) for _ in range(200)]
    for text in [t or "" for t in some_texts()] + odd:
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_bpe_letters_behind_a_space_need_no_pattern():
    """What str.isalpha takes for letters, the pattern takes for one piece; marks behind it are another."""
    own = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha()]
    assert own.pattern.findall(" " + "".join(letters)) == [" " + "".join(letters)]

    class Never:
        def findall(self, text):
            raise AssertionError(text)

    other = bpe.BytePairCodec(own.ranks, public_tokenizers.PATTERN)
    pieces = ["lanreque", "\u00cbnciar", "Stberen,", "la.", "x!"]
    expected = [b"".join(own._packed(p) for p in own.pattern.findall(" " + x)) for x in pieces]
    other.pattern = Never()
    assert [other._behind_space(x) for x in pieces] == expected
    plain = bpe.BytePairCodec(own.ranks, r"\S|\s")
    assert plain.decode(plain.encode("ab cd, e")) == b"ab cd, e" and len(plain.encode("ab cd, e")) == 4 * 8


def test_bpe_long_text_in_pieces(monkeypatch):
    own = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = "one two  three\n\n four " * 60_000
    whole = own.encode(text)
    monkeypatch.setattr(bpe, "PIECES_AT_ONCE", 1000)
    assert own.encode(text) == whole and own.decode(whole) == text.encode()


def test_bpe_frames(spark):
    docs = documents(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert both.columns == [*docs.columns, "token_ids", "decoded"]
    for r in both.collect():
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode(empty(spark), path, public_tokenizers.PATTERN, decoded=True).count() == 0


# ---- 3 HTML ---------------------------------------------------------------------------------


def test_html_blocks():
    page = "<!DOCTYPE html><head><title>t</title></head><script>var x='</p>';</script><p>a &amp; b&nbsp; c<br>d<p><b>e<p>f</b> g<!-- no --><ul><li>h<li>i</ul><div class='Menu'>j<"
    assert [b.text for b in html_extract.blocks(page)] == ["a & b c d", "e", "f g", "h", "i", "j<"]
    for odd in ("", "<", "<p", "</p></div>", "<a href='x>y", "<div " * 50, "text only", "<script>never closed", "<p class=\"x>unclosed"):
        list(html_extract.blocks(odd))


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p title=it's>one</p><p>two</p><p>that's three</p>", ["one", "two", "that's three"]),
        ("<p>a</p><!--><p>b</p><p>c</p>", ["a", "b", "c"]),
        ("<p>a</p><!---><p>b</p><!-- <p>x --!><p>c", ["a", "b", "c"]),
        ("<p>x<a href=foo/>y</a>z</p><p class = \"a>b\" id=3>q</p>", ["xyz", "q"]),
        ("<p>1 < 2 and 3 > 2</p><p data-a=\"1\"'x>t</p>", ["1 < 2 and 3 > 2", "t"]),
        ("<p>kept</p><a href='x>gone", ["kept"]),
        ("<script>if (a < b) '</p>'</SCRIPT ><p>after", ["after"]),
    ],
)
def test_html_reads_as_browsers_do(page, texts):
    assert [b.text for b in html_extract.blocks(page)] == texts


@pytest.mark.parametrize("part", ["<a ", "<!", "<a x=\"", "<div>", "<b><p>", "<p>x</p>", "<script>", "<div></x>", "&amp", "<p title="])
def test_html_reading_is_linear(part):
    page = part * (1_000_000 // len(part))
    begin = time.perf_counter()
    for _ in html_extract.blocks(page):
        pass
    assert time.perf_counter() - begin < 5  # a second or less where nothing else runs


@pytest.fixture(scope="session")
def labeller():
    return html_extract.trained()


def test_html_gradients_are_right():
    model = html_extract.Labeller(6, 3, 1)
    draw = np.random.default_rng(0)
    x, lengths, y = draw.normal(size=(9, 6)), np.array([4, 2, 3]), np.array([1, 0, 1, 1, 0, 0, 1, 0, 1.0])
    _, slopes = model.gradients(x, lengths, y)
    for key, slope in slopes.items():
        place = tuple(0 if n == 1 else n // 2 for n in model.p[key].shape)
        kept = model.p[key][place]
        losses = []
        for shift in (1e-5, -1e-5):
            model.p[key][place] = kept + shift
            losses.append(model.gradients(x, lengths, y)[0])
        model.p[key][place] = kept
        assert abs((losses[0] - losses[1]) / 2e-5 - slope[place]) < 1e-6, key


def test_html_held_out_accuracy(labeller):
    wrong = total = 0
    for page in html_extract.layouts(4242, 150):
        found = list(html_extract.blocks(page))
        if found:
            [odds] = labeller.odds([found], 20_000)
            wrong += int(((odds >= 0.5) != np.array([b.label for b in found])).sum())
            total += len(found)
    assert wrong <= 0.02 * total


def test_html_whole_page(spark, labeller):
    page = "<html><body><header><a href='/'>Site</a></header><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><div class='cookie-banner'>We use cookies.</div><article><h1>The title of it</h1><p>First paragraph, with some words in it. And more.</p><div class='ad'>Buy now!</div><p>Second &amp; last.</p></article><section id='comments' class='comments'><div class='comment'><p>I liked reading this.</p></div></section><aside class='sidebar'><h3>Related</h3><ul><li><a href='/c'>Other</a></li></ul></aside><footer>&copy; 2024 Site</footer></body></html>"
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (1, "u", page, "x"), (4, "u", page.replace("Second", "Second" + " long words." * 20_000), "x")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, main string"), keep=["page_id", "main"]).collect()
    expected = "The title of it\nFirst paragraph, with some words in it. And more.\nSecond & last."
    assert [r["main_text"] for r in got if r["page_id"] == 1] == [expected] * 2
    assert all(r["main_text"] == "" and r["n_chars"] == 0 for r in got if r["page_id"] in (2, 3))
    assert [r["n_chars"] for r in got if r["page_id"] == 4] == [len(expected) + 12 * 20_000]


def test_html_head_without_end_tag():
    head = "<html><head><meta charset='u'><title>T</title><script>var a;</script><noscript><img src='x'></noscript>"
    for rest in ("<body><p>Text of it.</p></body></html>", "<p>Text of it.</p>", "<a href='/'></a><p>Text of it.", "Text of it.", "<template><p>Not this.</p></template><body>Text of it.", "</head><body><p>Text of it.</p>"):
        assert [b.text for b in html_extract.blocks(head + rest)] == ["Text of it."], rest
    assert list(html_extract.blocks(head)) == []


# ---- 4 language model -----------------------------------------------------------------------


def test_lm_counts_and_base(spark):
    docs = documents(spark)
    held = F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False))
    got = lm_score.score(docs.withColumn("held", held), F.col("held")).collect()
    rows = [(i, [*split(t), None]) for i, t in pairs(docs)]
    counts = Counter(w for i, ws in rows if i is None or i % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = sorted(((i is None, i or 0), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in rows)
    assert sorted(((r["row_id"] is None, r["row_id"] or 0), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == expected
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert lm_score.score(empty(spark).withColumn("held", F.lit(False)), F.col("held")).count() == 0
    none = lm_score.score(docs.withColumn("held", F.lit(True)), F.col("held")).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and np.isfinite(r["score"]) for r in none)


def test_lm_automaton_is_a_distribution_and_equals_plain_backoff():
    draw = np.random.default_rng(3)
    symbols = 7
    data = draw.integers(0, symbols, 4000)
    data[1::3] = (data[0::3][: len(data[1::3])] + 1) % symbols
    order, bits = lm_score.ORDER, lm_score.BITS
    grams = {m: Counter(tuple(data[i - m + 1 : i + 1]) for i in range(order - 1, len(data))) for m in range(1, order + 1)}
    pack = lambda g: int(sum(int(x) << bits * (len(g) - 1 - i) for i, x in enumerate(g)))
    arcs, contexts = [], []
    for m in range(2, order + 1):
        kept = sorted((pack(g), c) for g, c in grams[m].items() if c >= 4)
        total, kinds = Counter(), Counter()
        for g, c in grams[m].items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        used = sorted((pack(g), total[g], kinds[g]) for g in total if total[g] >= 4)
        arcs.append((m, *(np.array(x) for x in zip(*kept))))
        contexts.append((m - 1, *(np.array(x) for x in zip(*used))))
    machine = lm_score.Automaton(arcs, contexts, np.array([grams[1][(s,)] for s in range(symbols)], float))
    for state in range(len(machine.fail)):
        logs, _ = machine.step(np.full(symbols, state), np.arange(symbols))
        assert abs((10**logs).sum() - 1) < 1e-4
    whole = machine.traverse(data, np.array([order - 1]), np.array([len(data)]))
    state, logs = np.zeros(1, np.int64), np.zeros(len(data))
    for i, s in enumerate(data):
        step, state = machine.step(state, np.array([s]))
        logs[i] = step[0]
    assert np.allclose(whole[order - 1 :], logs[order - 1 :])


def test_lm_learns_rare_words_and_ngrams_of_a_large_corpus(spark):
    common = " ".join(f"w{i * i % 23} w{i % 7}" for i in range(65_000))
    rare = "Zyx quov blim zyx trenk quov blim"
    rows = [(0, common, False), (1, rare, False), (2, "trenk " + rare, True), (3, "zyx new quov blim w1", True), (4, None, True), (5, "quov blim w1 w2", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(3)
    held = {i: [*split(t), None] for i, t, _ in rows}
    grams, occurring, kinds = Counter(), Counter(), Counter()
    for i, _, out in rows:
        padded = [None, None, *held[i]]
        for j in range(2, len(padded)) if not out else ():
            for m in (1, 2, 3):
                g = (m, *padded[j - m + 1 : j + 1])
                kinds[g[:-1]] += g not in grams
                grams[g] += 1
                occurring[g[:-1]] += 1
    n, v = occurring[1,], kinds[1,]

    def plain(g):
        if len(g) == 1:
            return (grams[1, *g] + 0.5) / (n + 0.5 * (v + 1))
        context = (len(g), *g[:-1])
        below = plain(g[1:])
        return (grams[len(g), *g] + kinds[context] * below) / (occurring[context] + kinds[context]) if occurring[context] else below

    expected = {}
    for i, ws in held.items():
        padded = [None, None, *ws]
        expected[i] = sum(log10(plain(tuple(padded[j - 2 : j + 1]))) for j in range(2, len(padded)))
    got = {r["row_id"]: r["score"] for r in lm_score.score(docs, F.col("held")).collect()}
    assert got.keys() == expected.keys()
    for i in got:
        assert abs(got[i] - expected[i]) < 1e-4 * max(1, len(held[i]) / 100), i


def test_lm_packed_keys_take_what_their_spread_needs():
    """Noise in lower bytes doesn't keep the upper ones from being compressed."""
    draw = np.random.default_rng(5)
    keys = np.sort(draw.integers(0, 2**64, 2_000_000, dtype=np.uint64, endpoint=False))[900_000:920_000]
    body = lm_score._packed_keys(keys)
    assert np.array_equal(lm_score._unpacked_keys(body), keys)
    assert len(body) < 5.75 * len(keys)
    for x in ([], [0], [0, 0], [255, 256], [2**63 - 1, 0, 5], [1 << 40] * 3):
        assert lm_score._unpacked(lm_score._packed(np.array(x, np.int64))).tolist() == x
    for x in ([], [0], [2**64 - 1], [0, 2**64 - 1], [7, 7, 9]):
        assert lm_score._unpacked_keys(lm_score._packed_keys(np.array(x, np.uint64))).tolist() == x


# ---- 5 Jaccard ------------------------------------------------------------------------------


def brute_components(rows):
    def shingles(text):
        w = split(text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if None not in (x[0], y[0]) and x[1] and y[1] and 100 * len(x[1] & y[1]) >= 80 * len(x[1] | y[1]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i is None, i or 0), len(s), least.get(find(k)) if i is not None else None) for k, (i, s) in enumerate(sets))


def test_jaccard_components(spark):
    docs = documents(spark)
    got = sorted(((r["row_id"] is None, r["row_id"] or 0), r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect())
    assert got == brute_components(pairs(docs))
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0


def test_jaccard_chains_families_and_shared_passages(spark):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(4):  # families: a chain of edits drifts away from its start
        current = [word() for _ in range(80)]
        for _ in range(15):
            current = list(current)
            current[draw.randrange(80)] = word()
            texts.append(" ".join(current))
    texts += [" ".join([*passage, *(word() for _ in range(30))]) for _ in range(40)]
    texts += [" ".join([*passage, word()]) for _ in range(30)]
    draw.shuffle(texts)
    docs = documents(spark, texts)
    got = sorted(((r["row_id"] is None, r["row_id"] or 0), r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect())
    assert got == brute_components(pairs(docs))


def test_jaccard_large_family_at_the_threshold(spark):
    """2,000 copies of one text, most pairs of them near the threshold on either side of it."""
    draw = random.Random(12)
    base = [f"w{i}" for i in range(110)]
    texts = []
    for i in range(2000):
        own = list(base)
        for j in draw.sample(range(110), draw.choice([1, 1, 2, 2, 2, 3])):
            own[j] = f"x{i}y{j}"
        texts.append(" ".join(own))
    texts += [" ".join(f"z{i}k{j}" for j in range(60)) for i in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocabulary: dict = {}
    sets = [sorted(vocabulary.setdefault(g, len(vocabulary)) for g in {tuple(w[i : i + 5]) for w in [split(t)] for i in range(len(w) - 4)}) for t in texts]
    shared = [g for g, n in Counter(g for s in sets for g in s).items() if n > 1]
    place = {g: k for k, g in enumerate(shared)}
    held = np.zeros((len(sets), len(shared)), np.float32)
    for i, own in enumerate(sets):
        held[i, [place[g] for g in own if g in place]] = 1
    common = held @ held.T
    size = np.array([len(s) for s in sets])
    linked = 100 * common >= 80 * (size[:, None] + size[None, :] - common)
    assert 0.05 < linked[:2000, :2000].mean() < 0.95
    np.fill_diagonal(linked, True)
    least = np.arange(len(sets))
    while True:
        now = np.array([least[linked[i]].min() for i in range(len(sets))])
        if (now == least).all():
            break
        least = now
    got = {r["row_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == dict(enumerate(least.tolist()))


def test_jaccard_drops_rows_not_identifiers(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "a"), (1, "something else altogether, which stays", "b"), (2, long + " x", "c"), (2, "another clean text of more than five words", "d"), (None, long, "e"), (3, None, "f"), (3, "", "g"), (4, long, "h"), (4, long, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    left = sorted((r["gone"]) for r in jaccard_join.drop_near_copies(docs).collect())
    assert left == ["a", "b", "d", "e", "f", "g"]
    assert jaccard_join.drop_near_copies(docs).columns == docs.columns


# ---- 6 language -----------------------------------------------------------------------------


def test_language(spark):
    draw = random.Random(4)
    stems = {"en": ["the", "and", "th", "ing", "tion"], "de": ["der", "und", "sch", "ung", "ß"], "fr": ["le", "et", "eau", "ç", "é"]}
    rows = []
    for i in range(240):
        lang = ["en", "de", "fr"][i % 3]
        rows.append((i, " ".join("".join(draw.choice(stems[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(25)), lang, 0, "x"))
    rows += [(900, None, "en", 0, ""), (901, "123 ... !", "fr", 0, ""), (902, "", None, 0, ""), (903, "the thing and the nation " * 20_000, None, 0, "")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("held", F.col("doc_id") % 4 == 2)
    got = {r["doc_id"]: r for r in language.identify(docs, F.col("held"), keep=["doc_id", "held", "lang"]).collect()}
    held = [r for i, r in got.items() if i < 240 and r["held"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unlabelled, F.col("held")).collect()} == {"und"}
    assert language.identify(docs.limit(0), F.col("held")).count() == 0


def test_language_learns_from_texts_of_every_length(spark):
    draw = random.Random(9)
    stems = {"en": ["the", "and", "th", "ing", "tion"], "de": ["der", "und", "sch", "ung", "ß"]}
    long = lambda lang: " ".join("".join(draw.choice(stems[lang]) for _ in range(3)) for _ in range(1500))
    rows = [(i, long(["en", "de"][i % 2]), ["en", "de"][i % 2], 0, "x") for i in range(40)]
    rows += [(100 + i, "the thing and the nation", "en", 0, "x") for i in range(20)]  # de has long texts only
    docs = spark.createDataFrame(rows, DOCS)
    assert all(len(r[1]) > 8000 for r in rows[:40])
    got = language.identify(docs, F.lit(False), keep=["doc_id", "lang"]).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)
    assert language.drop_untold(docs.filter("doc_id < 100"), 0.3).count() == 40
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string")).unionByName(spark.createDataFrame([(500, "12 ...", None, 0, "x"), (501, None, None, 0, "x")], DOCS))
    assert language.drop_untold(unlabelled, 0.3).count() == 60


def test_language_equals_an_explicit_kernel_ridge():
    """Landmarks are all rows here, so the Nystroem map is exact: unhashed kernel, dual ridge."""
    draw = random.Random(14)
    stems = {"en": ["the", "and", "th", "ing"], "de": ["der", "und", "sch", "ung"], "fr": ["le", "et", "eau", "ent"]}
    said = lambda lang, n: " ".join("".join(draw.choice(stems[lang] + ["re", "on"]) for _ in range(draw.randrange(1, 4))) for _ in range(n))
    langs = [["de", "en", "fr"][i % 3] for i in range(45)]
    texts, asked = [said(lang, 12) for lang in langs], [said(lang, draw.choice([2, 5, 30])) for lang in langs]

    def grams(text):
        data = text.encode().lower()
        return {data[i : i + n] for n in language.ORDERS for i in range(len(data) - n + 1)}

    def kernel(a, b):
        return np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in b] for x in a])

    known = [grams(t) for t in texts]
    k, q = kernel(known, known), kernel([grams(t) for t in asked], known)
    names = sorted(set(langs))
    y = np.array([[1.0 if lang == name else -1.0 for name in names] for lang in langs])
    mean = k.mean(0)
    # ridge in the kernel's own space: f = centred features, every language of weight one in all
    scale = np.array([1 / langs.count(lang) for lang in langs])
    centre = k - mean
    beta = np.linalg.solve(centre.T @ (centre * scale[:, None]) + language.RIDGE / len(names) * k, centre.T @ (y * scale[:, None]))
    expected = q @ beta + ((y * scale[:, None]).sum(0) / scale.sum() - mean @ beta)
    found_names, weights, offset = language.fit(texts, langs, [True] * len(texts))
    got = language.margins(asked, weights, offset)
    assert found_names == names and (got.argmax(1) == expected.argmax(1)).mean() >= 0.97
    assert np.abs(got - expected).mean() < 0.1 and np.corrcoef(got.ravel(), expected.ravel())[0, 1] > 0.97


def test_language_of_very_long_texts_is_as_clear_as_of_short_ones():
    draw = random.Random(4)
    stems = {"en": ["the", "and", "th", "ing"], "de": ["der", "und", "sch", "ung"]}
    word = lambda lang: "".join(draw.choice(stems[lang]) + draw.choice("abcdefghijklmnopqrstuvwxyz") * draw.randrange(3) for _ in range(draw.randrange(1, 4)))
    langs = ["en", "de"] * 40
    _, weights, offset = language.fit([" ".join(word(lang) for _ in range(30)) for lang in langs], langs, [True] * 80)
    long = " ".join(word("de") for _ in range(150_000))
    few, many = language.margins([long[:3000], long], weights, offset)
    assert few.argmax() == many.argmax() == 0 and many[0] - many[1] > 0.8 * (few[0] - few[1])


def test_language_presence_counts_each_gram_once():
    x = language.presence(pa.array(["abcabc", "abc", None, "é" * 3]))
    assert (x[0] & x[1]).sum() == x[1].sum() and x[2].sum() == 0
    assert 0 < x[1].sum() <= 6


# ---- 7 decontamination ----------------------------------------------------------------------


def brute_hits(docs, items, window=10):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII))
    grams = {}
    for item, text in items:
        w = word(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = word(text), set(), set()
        for gram, owners in grams.items():
            for i in range(len(w) - len(gram) + 1):
                if tuple(w[i : i + len(gram)]) == gram:
                    hit |= set(range(i, i + len(gram)))
                    found |= owners
        out.append(((doc is None, doc or 0), len(w), len(hit), sorted(found)))
    return sorted(out)


def test_decontaminate(spark):
    draw = random.Random(6)
    vocabulary = ["alpha", "Beta", "gamma", "Éta", "éta", "d3lta", "x"]
    long = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(1, long(14)), (2, long(10)), (3, long(25)), (4, "one two three"), (5, None), (6, " - "), (10, "zeta"), (11, "Zeta")]
    items.append((7, items[0][1].upper()))
    texts = [long(40) + " " + items[0][1] + "! " + long(5), items[1][1].replace(" ", ", "), " ".join(items[2][1].split()[5:15]), " ".join(items[2][1].split()[5:14]), "say One, two\nthree now", "zeta", None, "", items[0][1][:-2], "one two", long(3000)]
    docs = documents(spark, texts)
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(5)).withColumn("words", F.lit("x"))
    expected = brute_hits(pairs(docs), items)
    rows = decontaminate.decontaminate(docs, benchmark).collect()
    assert sorted(((r["row_id"] is None, r["row_id"] or 0), r["n_words"], r["n_hit"], r["items"]) for r in rows) == expected
    assert decontaminate.decontaminate(empty(spark), benchmark).count() == 0
    assert all(r["n_hit"] == 0 for r in decontaminate.decontaminate(docs, benchmark.limit(0)).collect())
    decontaminate.BROADCAST_ROWS, kept = 0, decontaminate.BROADCAST_ROWS  # the shuffled way
    try:
        rows = decontaminate.decontaminate(docs, benchmark).collect()
    finally:
        decontaminate.BROADCAST_ROWS = kept
    assert sorted(((r["row_id"] is None, r["row_id"] or 0), r["n_words"], r["n_hit"], r["items"]) for r in rows) == expected


# ---- 8 exact dedup --------------------------------------------------------------------------


@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 4), 2, "0"))])
@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(spark, keep, digest):
    docs = documents(spark)
    rows = pairs(docs)
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    pick = min if keep == "min" else max
    kept = {t: pick((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    got = exact_dedup.exact_dedup(docs, keep=keep, digest=digest, memtable_rows=7).collect()
    key = lambda i: (i is None, i or 0)
    assert sorted((key(r["row_id"]), key(r["keep_id"]), r["group_size"]) for r in got) == sorted((key(i), key(kept[t]), len(groups[t])) for i, t in rows)
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_drop_copies(spark):
    docs = documents(spark)
    stay = exact_dedup.drop_copies(docs, keep="max")
    assert stay.columns == docs.columns
    texts = [r["text"] or "" for r in stay.collect()]
    assert sorted(texts) == sorted({t for _, t in pairs(docs)})
    odd = spark.createDataFrame([(5, None, "a"), (5, "", "b"), (5, "x", "c"), (5, "x", "d"), (4, "x", "e"), (None, "y", "f"), (None, "y", "g")], "doc_id long, text string, digest string")
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in exact_dedup.drop_copies(odd).collect()) == [(0, "y"), (5, ""), (5, "x")]


# ---- 9 WARC ---------------------------------------------------------------------------------


def test_warc_long_header(spark):
    draw = random.Random(8)
    url = "http://x/" + "".join(chr(draw.randrange(33, 400)) for _ in range(800_000))
    pages = spark.createDataFrame([(1, url, "text"), (2, "u", "other")], "page_id long, url string, html string").repartition(1)
    got = {r["page_id"]: r for r in warc.read_archives(spark, warc.write_archives(pages), 1000).collect()}
    assert got[1]["url"] == url and got[2]["payload_bytes"] == 5 and len(got) == 2


@pytest.mark.parametrize("range_bytes", [50, 777, 1 << 20])
def test_warc_round_trip(spark, range_bytes):
    draw = random.Random(3)
    long = lambda: "".join(chr(draw.randrange(32, 400)) for _ in range(1500))
    same, other = long(), "é" * 500
    rows = [(i, f"http://x/{i}?a=b c%20é\r\n", draw.choice([same, other, long(), "", "short", None])) for i in range(40)]
    rows += [(100, None, same), (100, None, same), (None, "u", same), (50, "u", "1f8b " * 400)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.read_archives(spark, warc.write_archives(pages), range_bytes).collect()
    payload = [(i, u, (h or "").encode()) for i, u, h in rows]
    key = lambda i: -1 if i is None else i
    expected = []
    for i, u, p in payload:
        last = max(key(j) for j, _, q in payload if q == p)
        revisit = len(p) >= 1000 and key(i) != last
        expected.append((key(i), u or "", "revisit" if revisit else "response", last if revisit else -1, len(p), hashlib.sha1(p).hexdigest(), b"" if revisit else p))
    assert sorted((key(r["page_id"]), r["url"] or "", r["record_type"], key(r["refers_to"]), r["payload_bytes"], r["payload_digest"], bytes(r["payload"] or b"")) for r in got) == sorted(expected)


def test_warc_false_magic_and_foreign_tools(spark):
    one = warc.record_bytes(1, "u", b"x" * 100, hashlib.sha1(b"x" * 100).hexdigest(), None, False)
    two = warc.record_bytes(2, None, b"", hashlib.sha1(b"").hexdigest(), None, False)
    noise = b"\x1f\x8b\x08 no member" + gzip.compress(b"not a record")
    data = noise + one + noise + two + b"\x1f\x8b"
    for size in (1, 13, 64, 10_000):
        found = [h["warc-record-id"] for s in range(0, len(data), size) for h, _ in warc.read_range(io.BytesIO(data), s, min(s + size, len(data)))]
        assert found == ["<urn:page:1>", "<urn:page:2>"]
    assert gzip.decompress(one).startswith(b"WARC/1.1\r\n")
    assert warc.read_archives(spark, warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


# ---- 10 token files -------------------------------------------------------------------------


def test_token_blocks_round_trip():
    draw = np.random.default_rng(5)
    cases = [draw.integers(0, 50_000, 900), np.full(2048, 49_999), draw.zipf(1.4, 2048) % 50_000, np.tile(np.arange(7), 100), np.array([0]), np.array([65_535])]
    cases.sort(key=len, reverse=True)
    cases = [c.astype(np.int64) for c in cases]
    for digits, scale in ((4, 1), (5, 15), (8, 60_000)):
        own = [c * scale for c in cases]
        coded = token_files.encode_blocks(own, digits)
        for a, b in zip(own, token_files.decode_blocks(coded, [len(c) for c in own], digits)):
            assert (a == b).all()
        sizes = {len(c): len(x) for c, x in zip(own, coded)}
        assert sizes[700] < 0.3 * 1400 * digits / 4


def test_token_blocks_are_smaller_than_deflated_ones(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    ids = np.concatenate([[*found.ids, 2] for found in library.encode_batch(texts, add_special_tokens=False)])
    blocks = [ids[i : i + token_files.BLOCK] for i in range(0, len(ids), token_files.BLOCK)]
    mixed = sum(map(len, token_files.encode_blocks(blocks, 4)))
    assert mixed < sum(len(zlib.compress(b.astype("<u2").tobytes(), 6)) for b in blocks)


def _token_file(documents):
    file = token_files._File.__new__(token_files._File)
    file.kind, file.digits, file.path, file.total, file.held, file.index, file.out = np.dtype("<u2"), 4, "", 0, bytearray(), [], io.BytesIO()
    file.out.close = lambda: None
    file.out.write(token_files.MAGIC)
    for key, ids in documents:
        file.add(key, np.array(ids, "<u2").tobytes())
    file.close(0, 0)
    return file.out.getvalue()


def test_token_file_detects_damage():
    documents = [(1, range(300)), (None, [2]), (7, range(200, 400))]
    whole = _token_file(documents)
    assert [(k, ids.tolist()) for k, ids in token_files.read_file(io.BytesIO(whole))] == [(k, list(ids)) for k, ids in documents]
    damaged = bytearray(whole)
    damaged[-5] ^= 0x40
    for data in (bytes(damaged), whole[:-1], b"x" + whole[1:]):
        with pytest.raises(ValueError):
            list(token_files.read_file(io.BytesIO(data)))


def test_token_files(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "BLOCK", 256)
    monkeypatch.setattr(token_files, "FILE_TOKENS", 2000)
    monkeypatch.setattr(token_files, "INDEX_DOCUMENTS", 3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = documents(spark, [*some_texts(), "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|im_end|>  y "])
    got = sorted(((r["row_id"] is not None, r["row_id"] or 0), r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_tokens(spark, token_files.write_tokens(docs, path, 2)).collect())
    start, expected = 0, []
    for i, text in sorted(pairs(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        expected.append(((i is not None, i or 0), start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(expected)
    assert token_files.read_tokens(spark, token_files.write_tokens(empty(spark), path, 2)).count() == 0
