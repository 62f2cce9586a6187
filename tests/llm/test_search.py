"""Ranked search, BPE and the filter audit against plain versions and the public library."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from windowguard.llm import bpe, filter_audit, queries, ranked_search, span_table

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@given(st.lists(st.sampled_from([b"", b"a", b"ab", b"abcdefgh", b"abcdefgi", b"x" * 70, b"x" * 69 + b"y", "é".encode()]), max_size=40))
@settings(max_examples=60, deadline=None)
def test_equal_spans(words):
    data = np.frombuffer(b"|".join(words) + b"|", np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
    starts = ends - np.array([len(w) for w in words], np.int64)
    group = np.arange(len(words)) % 3
    assert span_table.first_equal(data, starts, ends).tolist() == [words.index(w) for w in words]
    seen = [(g, w) for g, w in zip(group.tolist(), words, strict=True)]
    assert span_table.first_equal(data, starts, ends, group).tolist() == [seen.index(x) for x in seen]


def test_spans_of_equal_hash(monkeypatch):
    monkeypatch.setattr(span_table.arrays, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    words = [b"one", b"two", b"one", b"six", b"two", b"onex"]
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - np.array([len(w) for w in words])
    assert span_table.first_equal(data, starts, ends).tolist() == [words.index(w) for w in words]


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges.read(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


HARD = [
    "",
    "<|endoftext|>",
    "a<|endoftext|>b <|endoftext|><|endoftext|",
    "  \n\t  x",
    "\x00\x01\x85  \x1c x",
    "a" * 5000,
    "ab" * 3001,
    " " * 3000 + "x",
    "é" * 777,
    "日本語テキスト" * 50,
    "🙂🙃" * 40,
    "xᲉy Ɤ1",
    "it's we'll I'd'd'd 's's",
]


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_encode_like_the_library(merges, library):
    dice = random.Random(5)
    texts = [*HARD, "".join(chr(dice.randrange(32, 1000)) for _ in range(3000))]
    texts += [" ".join("".join(dice.choices("abcdefgh", k=dice.randrange(1, 30))) for _ in range(400)) for _ in range(3)]
    got = [ids_of(r) for r in bpe.Encoder(merges).encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_encode_any_text(merges, library, text):
    assert ids_of(bpe.Encoder(merges).encode([text])[0]) == library.encode(text, add_special_tokens=False).ids


def test_both_trees_merge_alike(merges):
    dice = random.Random(7)
    pieces = ["".join(dice.choices("etaoins ", k=dice.randrange(1, 64))).encode() for _ in range(600)]
    alone = [bpe.merge_alone(merges.byte_ids[np.frombuffer(p, np.uint8)].tolist(), merges) for p in pieces]
    assert [ids_of(r) for r in bpe.encode_pieces(pieces, merges)] == alone


def test_known_pieces_stay_bounded(merges, library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 50)
    encoder = bpe.Encoder(merges)
    for i in range(20):
        text = " ".join(f"w{i}x{j}" for j in range(20)) + " " + "y" * 100
        assert ids_of(encoder.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) <= 101 and max(map(len, encoder.known)) <= bpe.KNOWN_LETTERS


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="no plain byte-level"):
        bpe.Merges.read(public_tokenizers.path("word_bpe_49k.json"))


def test_round_trip(spark, documents, texts, merges, library):
    got = Counter(map(tuple, bpe.round_trip(documents.withColumn("tokens", F.lit(1)), merges).collect()))
    want = Counter()
    for doc, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        spelt = library.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, "<u4").tobytes()
        want[doc, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(spelt.encode()).hexdigest()] += 1
    assert got == want
    assert bpe.round_trip(documents.limit(0), merges).count() == 0


def test_decode_odd_ids(spark, merges, library):
    rows = [(1, library.encode("é").ids[:1]), (2, [99999999, library.encode("a").ids[0]]), (3, []), (4, None), (5, [50256, 64, None])]
    rows = spark.createDataFrame(rows, "doc_id long, tokens array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(rows, merges).collect()}
    assert got[1] == library.decode(library.encode("é").ids[:1], skip_special_tokens=False)
    assert (got[2], got[3], got[4], got[5]) == ("a", "", "", "<|endoftext|>a")


def brute_search(texts, items, k):
    docs = [(d, Counter(TERM.findall(lower(t)))) for d, t in texts]
    n_docs = sum(1 for _, c in docs if c)
    n_terms = sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(TERM.findall(lower(text)))
    out = []
    for item, terms in wanted.items():
        scored = []
        for doc, counts in docs:
            m = 10 + (90 * sum(counts.values()) * n_docs) // max(1, n_terms)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * counts[t]) // (1000 * counts[t] + 8 * m))
                for t in terms
                if t in counts
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        scored.sort(key=lambda x: x[:3])
        out += [(item, i + 1, doc, -score) for i, (score, _, _, doc) in enumerate(scored[:k])]
    return Counter(out)


@pytest.fixture(scope="module")
def items(texts):
    long = texts[7][1].split()
    return [
        (1, " ".join(long[100:140])),
        (2, "LA la, la la!"),
        (3, None),
        (4, "?!"),
        (5, "nothing-of-this zzz"),
        (7, " ".join(long[5:9])),
        (7, " ".join(long[200:230])),
        (8, texts[0][1]),
        (8, texts[0][1]),
        (None, "é w1 one"),
    ]


@pytest.mark.parametrize("shard_bytes, limit", [(1 << 23, 1 << 20), (1500, 400)])
def test_search(spark, documents, texts, items, shard_bytes, limit):
    index = ranked_search.build_index(documents, shard_bytes)
    found = ranked_search.search(index, spark.createDataFrame(items, "item_id long, text string"), 5, limit)
    assert Counter(map(tuple, found.collect())) == brute_search(texts, items, 5)


def test_search_of_nothing(spark, documents, items):
    asked = spark.createDataFrame(items, "item_id long, text string")
    empty = ranked_search.build_index(documents.limit(0))
    assert ranked_search.search(empty, asked).count() == 0
    assert ranked_search.search(ranked_search.build_index(documents), asked.limit(0)).count() == 0


def test_numbers_come_back():
    values = np.array([0, 1, 127, 128, 300, 1 << 14, (1 << 21) - 1, 1 << 28, (1 << 35) - 1, 0])
    packed, size = ranked_search.pack_numbers(values)
    assert ranked_search.unpack_numbers(packed).tolist() == values.tolist() and size.sum() == len(packed)


def test_block_bounds_are_exact():
    dice = np.random.default_rng(3)
    block, tf, length = np.sort(dice.integers(0, 30, 900)), dice.integers(1, 9, 900), dice.integers(9, 500, 900)
    best = ranked_search.outermost(block, tf, length)
    for n_docs, n_terms in ((10, 100), (1000, 90000)):
        scores = ranked_search.impact(tf, length, n_docs, n_terms)
        for b in np.unique(block):
            assert scores[best[block[best] == b]].max() == scores[block == b].max()


@pytest.mark.parametrize("seed", range(6))
def test_pruned_search_equals_full(monkeypatch, seed):
    """Small blocks and spans, so that bounds reject blocks; nothing that may be among the best is lost."""
    monkeypatch.setattr(ranked_search, "BLOCK", 4)
    monkeypatch.setattr(ranked_search, "SPAN", 32)
    dice = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    odds = [1 / (i + 1) for i in range(40)]
    texts = [" ".join(dice.choices(words, odds, k=dice.randrange(1, 60))) for _ in range(400)]
    shard = ranked_search.Shard(0)
    shard.add(pa.array(range(len(texts))), pa.array(texts))
    kinds = "shard long, term string, df long, blocks binary, outer binary, postings binary, doc_ids list, lengths list"
    types = [pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * 3, pa.list_(pa.int64()), pa.list_(pa.int64())]
    schema = pa.schema([pa.field(n.split()[0], t) for n, t in zip(kinds.split(", "), types, strict=True)])
    rows = pa.Table.from_batches(list(shard.rows(schema))).to_pylist()
    lengths = np.array(rows[0]["lengths"])
    n_docs, n_terms = len(texts), int(lengths.sum())
    lists = {r["term"]: ranked_search.Posting.read(r["blocks"], r["outer"], r["postings"], n_docs, n_terms) for r in rows[1:]}
    df = {r["term"]: r["df"] for r in rows[1:]}
    unpacked = []
    read = ranked_search.ShardSearch.block
    monkeypatch.setattr(ranked_search.ShardSearch, "block", lambda s, t, a, b: unpacked.append(b - a) or read(s, t, a, b))
    for terms in (dice.sample(words, 6) for _ in range(20)):
        weights = {t: ranked_search.weight(n_docs, df[t]) for t in terms if t in df}
        search = ranked_search.ShardSearch(lists, lengths, n_docs, n_terms)
        docs, scores = search.best(weights, 3, 0)
        got = sorted(zip((-scores).tolist(), docs.tolist(), strict=True))[:3]
        full = np.zeros(len(texts), np.int64)
        for t, w in weights.items():
            doc, value = read(search, t, 0, len(lists[t].first))
            full[doc] += w * value
        want = sorted((-s, i) for i, s in enumerate(full.tolist()) if s > 0)[:3]
        assert got == want
    assert sum(unpacked) < 20 * 6 * 100 / 2


def brute_audit(rows, labels):
    seen, fails = {}, []
    for doc, _, text in rows:
        if doc is not None:
            seen.setdefault(text or "", set()).add(doc)
    for doc, lang, text in rows:
        text = text or ""
        words = WORD.findall(text)
        own = set()
        own |= {"A"} if len(words) < 200 else set()
        own |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        own |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        own |= {"D"} if re.search("[#$%&*|]", text) else set()
        own |= {"E"} if doc is not None and min(seen[text]) < doc else set()
        said = [x for x in labels if doc is not None and x[0] == doc]
        fails.append((lang or "", own, any(x[1] == 1 for x in said), any(x[2] == 1 for x in said)))
    out = []
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        removed_by = Counter()
        steps = []
        for order in permutations("ABCDE"):
            left = mine
            for i, name in enumerate(order):
                gone = [f for f in left if name in f[1]]
                before = [f for f in mine if name in f[1] and f not in gone and f[1] & set(order[:i])]
                left = [f for f in left if name not in f[1]]
                removed_by[name] += len(gone)
                only = sum(f[1] == {name} for f in mine)
                good, toxic = sum(f[2] for f in gone), sum(f[3] for f in gone)
                steps.append((part, "".join(order), i + 1, len(left), len(gone), len(before), only, good, toxic, name))
        out += [(*s[:-1], removed_by[s[-1]]) for s in steps]
    return Counter(out)


def test_audit(spark, texts):
    rows = [(d, [None, "en", "de"][i % 3], t) for i, (d, t) in enumerate(texts)]
    rows += [(40, "en", "A# " * 250), (41, "de", "A# " * 250), (41, "de", "A# " * 250), (39, "fr", "A# " * 250)]
    rows += [(50 + i, "en", " ".join(f"{'$' if i % 2 else ''}w{i % 3}x{j}" for j in range(200 + i % 2))) for i in range(8)]
    rows += [(60, "en", ""), (None, "en", "A# " * 250)]
    labels = [(40, 1, 0), (41, 1, 1), (41, 0, None), (50, None, 1), (53, 0, 1), (None, 1, 1), (999, 1, 1), (1, 1, 0), (3, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, lang string, text string, mask int, part string")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = Counter(map(tuple, filter_audit.audit(docs, said).collect()))
    assert got == brute_audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), said).count() == 0
    assert sum(r.kept for r in filter_audit.audit(docs, said.limit(0)).where("step = 1").collect()) > 0


def test_measured_counts(spark):
    texts = ["", None, "é" * 600, "🙂 " * 300, "a" * 255 + "é b", "x y x", " a ", "#A" * 300, "日本 語" * 101, "z" * 20000 + " " + "Q|" * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: r for r in filter_audit.measure(docs).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        words = WORD.findall(text)
        want = [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))]
        assert [got[i].n_words, got[i].n_distinct, got[i].n_capitals, got[i].n_chars, got[i].n_symbols] == want
        assert bytes(got[i].text_sha256) == hashlib.sha256(text.encode()).digest()


def test_registered_parameters():
    assert queries.HITS == 10 and len(filter_audit.steps()) == 600
