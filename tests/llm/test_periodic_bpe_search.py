"""Runs, byte-level BPE and ranked search against plain versions on small tables."""

import base64
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusweave.llm import bpe, search
from corpusweave.llm.periodic import collapse_runs, runs_of
from corpusweave.llm.search import ranked

TOKENIZER = bpe.Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


# --- Runs ----------------------------------------------------------------------------------------


def all_runs(words, least=6, periods=4):
    """Every distance on its own, then the least one of equal stretches."""
    found = {}
    for q in range(1, len(words) // periods + 1):
        at = 0
        while at < len(words) - q:
            to = at
            while to < len(words) - q and words[to] == words[to + q]:
                to += 1
            if to - at + q >= max(least, periods * q):
                found.setdefault((at, to - at + q), q)
            at = max(to, at + 1)
    return sorted((start, length, q) for (start, length), q in found.items())


def kept_words(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return [w for i, w in enumerate(words) if i not in gone]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=5), st.sampled_from([(6, 4), (1, 3), (12, 5)]))
def test_runs_equal_all_distances(texts, rule):
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    code = np.array([w for t in texts for w in t], dtype=np.int64)
    found = list(zip(*(c.tolist() for c in runs_of(code, first, *rule))))
    wanted = [(s + first[i], n, q) for i, t in enumerate(texts) for s, n, q in all_runs(t, *rule)]
    assert found == wanted


def test_one_word_a_million_times_is_one_run():
    found = runs_of(np.zeros(1_000_000, dtype=np.int64), np.array([0, 1_000_000]))
    assert [c.tolist() for c in found] == [[0], [1_000_000], [1]]


def test_collapse_runs_takes_any_rows(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "a a a a a a", "x y x y x y x y z", "é é é é é é é", "long " + "w " * 50_000]
    for _ in range(40):
        words = [rng.choice("abc") for _ in range(rng.randrange(60))]
        at = rng.randrange(len(words) + 1)
        texts.append(" ".join(words[:at] + words[at : at + 5] * rng.randrange(7)))
    rows = [(i if i % 7 else None, t, "k", 1) for i, t in enumerate(texts)] + [(5, texts[5], "k", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, runs int")
    found = collapse_runs(docs.repartition(3)).collect()
    wanted = []
    for id_, text, *_ in rows:
        words = (text or "").split()
        runs = all_runs(words) if len(words) < 1000 else [(1, 50_000, 1)]
        wanted.append((id_, len(words), runs, " ".join(kept_words(words, runs))))
    order = lambda r: (r[0] is None, r[0] or 0, r[1], str(r[2]), r[3])
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.kept_text) for r in found]
    assert sorted(got, key=order) == sorted(wanted, key=order)
    assert collapse_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        collapse_runs(docs, periods=2)


# --- BPE -----------------------------------------------------------------------------------------

TEXTS = [
    None,
    "",
    "Plain words, and 'quoted' ones: we'll see it's 12345 times.",
    "  two  spaces\n\n\nlines \t tabs\r\n end   ",
    "a  b 　  \n c\u0085 d  e  f",
    "Größe naïve Ärger — “quotes” … привет мир 你好，世界 🎉🎉 é",
    "x" * 3000 + " " * 500 + "!?" * 400,
    "<|endoftext|> is plain text",
    "\x00\x01\x1c\x1f ' 's 'S ''s 12'll",
    "the same words " * 2000,
]


def reference():
    lines = open(TOKENIZER.ranks, "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("whole", pat_str=TOKENIZER.pattern, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library_and_decodes_to_the_text(spark, monkeypatch):
    rng = random.Random(5)
    letters = "ab'sé \n\t.,1 中'"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = [(i if i % 9 else None, t, i, "r") for i, t in enumerate(texts)] + [(4, TEXTS[4], 4, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, segment int, row string").repartition(3).cache()
    coded = bpe.encode(docs, TOKENIZER)
    encoding = reference()
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    wanted = sorted(((id_, encoding.encode_ordinary(t or "")) for id_, t, *_ in rows), key=order)
    assert sorted(((r.doc_id, r.ids) for r in coded.collect()), key=order) == wanted
    back = bpe.decode(coded.selectExpr("doc_id", "ids", "1 as decoded", "'x' as c0"), TOKENIZER).collect()
    assert back[0].asDict().keys() == {"doc_id", "decoded", "c0"}
    texts = sorted((bytes(r.decoded) for r in back))
    assert texts == sorted((t or "").encode() for _, t, *_ in rows)
    assert bpe.encode(docs.limit(0), TOKENIZER).collect() == []


def test_small_segments_and_buckets_change_nothing(spark, monkeypatch):
    found = []
    for path in range(2):
        texts = [((f"w{i % 7} the " * (i % 5)) + "\n", i) for i in range(60)]
        docs = spark.createDataFrame(texts, "text string, doc_id int").coalesce(2)
        rows = list(docs.toLocalIterator())
        batch = bpe.pa.RecordBatch.from_pylist([{"text": r.text} for r in rows])
        size = [64, bpe.SEGMENT_BYTES][path]
        found.append([])
        for part, data, offsets in bpe.slices(batch.column("text"), size):
            counts, code, words = bpe._pieces(data, offsets, bpe.regex.compile(TOKENIZER.pattern).findall)
            ends = np.cumsum(counts)
            names = words.to_pylist()
            found[-1] += [[names[c] for c in code[e - n : e]] for e, n in zip(ends, counts)]
    assert found[0] == found[1] == [bpe.regex.findall(TOKENIZER.pattern, r.text) for r in rows]


def test_decoding_defines_empty_and_unknown_tokens(spark):
    coded = spark.createDataFrame([(1, None), (2, []), (3, [11, 262])], "id int, ids array<int>")
    got = {r.id: bytes(r.decoded) for r in bpe.decode(coded, TOKENIZER).collect()}
    assert got == {1: b"", 2: b"", 3: b", the"}
    for wrong in ([50_256], [-1], [None]):
        with pytest.raises(Exception, match="table does not hold"):
            bpe.decode(spark.createDataFrame([(wrong,)], "ids array<int>"), TOKENIZER).collect()


@given(st.lists(st.lists(st.integers(0, 2**40), max_size=5), max_size=6))
@settings(deadline=None)
def test_packed_numbers_come_back(lists):
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    column = bpe._packed(np.array([v for x in lists for v in x], dtype=np.int64), first)
    values, bounds = bpe._unpacked(bpe.pa.chunked_array([column]))
    assert [values[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == lists


# --- Search --------------------------------------------------------------------------------------


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain_ranks(docs, items, top=10):
    counted = [(id_, Counter(terms_of(t))) for id_, t, *_ in docs]
    counted = [(id_, c) for id_, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for id_, text in items:
        scored = []
        for doc, c in counted:
            m = 100 - 75 + 75 * sum(c.values()) * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms_of(text)
                if t in c
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(id_, at + 1, None if null else doc, -s) for at, (s, null, doc) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def search_tables(seed):
    rng = random.Random(seed)
    words = ["Ab", "ab", "c3", "d", "é", "É", "zz", "über", "日本", "x"] + [f"w{i}" for i in range(20)]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", " ", ", ", "\n"]) for _ in range(n))
    docs = [(i, text(rng.randrange(30)), 0) for i in range(80)]
    docs += [(None, text(9), 0), (None, "zz zz", 0), (3, None, 0), (4, "", 0), (5, "... !", 0), (7, docs[7][1], 0)]
    docs += [(100 + i, docs[8][1], 0) for i in range(30)]
    shared = text(6)
    items = [(i, shared + text(rng.randrange(8))) for i in range(12)] + [(50, None), (51, "?!"), (52, "absent"), (0, "ab Ab AB zz")]
    return docs, items


@pytest.mark.parametrize("held", [1 << 21, 40])
@pytest.mark.parametrize("block", [1 << 20, 15])
def test_search_equals_plain_scores(spark, monkeypatch, held, block):
    monkeypatch.setattr(search, "_HELD", held)
    monkeypatch.setattr(search, "BLOCK_TERMS", block)
    docs, items = search_tables(2)
    table = spark.createDataFrame(docs, "doc_id long, text string, score int").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    found = ranked(table, asked)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_ranks(docs, items)


def test_search_of_nothing_finds_nothing(spark):
    docs, items = search_tables(2)
    table = spark.createDataFrame(docs, "doc_id long, text string, score int")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert ranked(table, asked.limit(0)).collect() == []
    assert ranked(table.limit(0), asked).collect() == []
    assert ranked(table, asked).dtypes == ranked(table, asked.limit(0)).dtypes


@settings(max_examples=100, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 9), st.integers(1, 3), max_size=8), min_size=1, max_size=6))
def test_shared_accumulators_sum_to_the_items(items):
    sharing = search.share(items, 10)
    rng = np.random.default_rng(1)
    term, doc = np.nonzero(rng.random((10, 5)) < 0.5)
    value = rng.integers(1, 100, len(term))
    held = {(t, d): v for t, d, v in zip(term.tolist(), doc.tolist(), value.tolist())}
    wanted = {}
    for at, item in enumerate(items):
        for d in range(5):
            score = sum(times * held.get((t, d), 0) for t, times in item.items())
            if score:
                wanted[at, d] = score
    item, where, score = search.combine(sharing, term, doc, value, 5)
    assert {(i, d): s for i, d, s in zip(item.tolist(), where.tolist(), score.tolist())} == wanted


def test_terms_that_items_share_are_one_node():
    items = [{0: 1, 1: 1, 2: 1, 3: 2}, {0: 1, 1: 1, 2: 1, 4: 1}, {0: 1, 1: 1, 2: 1, 3: 2}]
    sharing = search.share(items, 5)
    parts = {}
    for child, parent, times in (step for steps in sharing.steps for step in zip(*(s.tolist() for s in steps))):
        parts.setdefault(parent, []).append((child, times))
    shared = next(node for node, below in parts.items() if sorted(below) == [(0, 1), (1, 1), (2, 1)])
    assert sum(child == shared for below in parts.values() for child, _ in below) >= 2
    assert all(child >= 3 for node in range(sharing.items, sharing.nodes) for child, _ in parts[node])
