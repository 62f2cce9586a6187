"""Deduplication operators against brute force, on texts with every odd case."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import functions as F

from windowguard.llm import components, hamming, line_dedup, simhash_dedup, substring_dedup, suffix_dedup
from windowguard.session import shared_dir, stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ordered(texts):
    return sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def brute_windows(texts, k):
    seen, out = set(), []
    for doc, text in texts:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - k + 1):
            window = tuple(words[i : i + k])
            if window in seen:
                gone[i : i + k] = [True] * k
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), sum(gone), kept))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def test_repeated_windows(documents, texts):
    # Rows without an id come first, in an order of their own: those texts must not repeat here.
    rows = [r for r in texts if r[0] is not None or r[1] is None or len(r[1]) < 300]
    frame = documents.where("doc_id is not null or text is null or length(text) < 300")
    got = [tuple(r) for r in substring_dedup.remove_repeats(frame).collect()]
    assert sorted(got, key=key) == sorted(brute_windows(ordered(rows), 20), key=key)
    assert sum(r[2] for r in got) > 4000


def test_repeated_windows_among_rows_without_id(documents):
    got = substring_dedup.remove_repeats(documents.where("doc_id is null or doc_id = 1"))
    lost = {(r.doc_id, r.n_words): r.n_removed for r in got.collect()}
    assert lost == {(None, 120): 0, (None, 40): 0, (None, 0): 0, (1, 120): 120}


def test_window_of_one_word(documents, texts):
    rows = [r for r in texts if r[0] is not None and r[0] < 8]
    got = substring_dedup.remove_repeats(documents.where("doc_id < 8"), window=1).collect()
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute_windows(ordered(rows), 1), key=key)


def brute_strings(texts, length):
    raw = [(d, (t or "").encode()) for d, t in texts]
    count = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for doc, data in raw:
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            if count[data[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return out


def test_repeated_strings(documents, texts):
    got = [(*r[:4], bytes(r[4])) for r in suffix_dedup.remove_repeated_bytes(documents).collect()]
    want = brute_strings(texts, suffix_dedup.LENGTH)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert 0 < sum(r[2] for r in want) < sum(r[1] for r in want)


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprint_classes(documents, texts):
    got = simhash_dedup.fingerprint_classes(documents).collect()
    prints = {(d, t): brute_fingerprint(t) for d, t in texts}
    roots = brute_roots(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(list)
    for (doc, _), fp in prints.items():
        least[roots[fp]].append(doc)
    ids = {r: min((d for d in docs if d is not None), default=None) for r, docs in least.items()}
    want = Counter((d, prints[d, t], ids[roots[prints[d, t]]]) for d, t in texts)
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert [r[0] for r in simhash_dedup.fingerprint_classes(documents).select(simhash_dedup.hex64(F.lit(-2).cast("long"))).take(1)] == ["f" * 15 + "e"]


def random_prints(n, groups):
    """Signed fingerprints around few centres, up to four bits off."""
    import numpy as np

    dice = np.random.default_rng(5)
    centres = dice.integers(-(2**63), 2**63 - 1, groups)
    values = set()
    for _ in range(n):
        value = int(centres[dice.integers(groups)]) & (1 << 64) - 1
        for _ in range(dice.integers(0, 5)):
            value ^= 1 << int(dice.integers(64))
        values.add(value - (1 << 64) if value >> 63 else value)
    return sorted(values)


def test_links_of_crowded_and_small_buckets(spark):
    prints = random_prints(400, 3) + random_prints(60, 40)
    prints = sorted(set(prints))
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = brute_roots(prints, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    for keyed in (simhash_dedup.golay_keys(frame), hamming.block_keys(frame)):
        linked = components.components(hamming.links_within_two(keyed), "a", "b").collect()
        assert {r.node: r.root for r in linked} == {n: r for n, r in roots.items() if list(roots.values()).count(r) > 1}


def test_components_of_a_long_chain_and_odd_links(spark):
    chain = [(i + 1, i) for i in range(60)] + [(5, 5), (None, 3), (100, 101), (101, 100)]
    got = components.components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()
    assert {r.node: r.root for r in got} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def shingles(text, k=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_near_copies(documents, texts):
    got = {(r.doc_id, r.t1): r.keep for r in simhash_dedup.near_copies(documents).collect()}
    by_text = {(r.doc_id, r.t1): r.text for r in documents.select("doc_id", F.xxhash64("text").alias("t1"), "text").collect()}
    sets = {k: shingles(t) for k, t in by_text.items()}

    def near(a, b):
        common = len(sets[a] & sets[b])
        union = len(sets[a] | sets[b])
        return union == 0 or common >= 0.8 * union

    names = list(sets)
    roots = brute_roots(list(range(len(names))), lambda a, b: near(names[a], names[b]))
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            assert (got[a] == got[b]) == (roots[i] == roots[j]), (a, b)


def edited(words, dice, n):
    out = list(words)
    for i in dice.sample(range(len(out)), n):
        out[i] = f"e{dice.randrange(10**9)}"
    return " ".join(out)


def test_parity_sketches_never_overstate_the_difference(monkeypatch):
    monkeypatch.setattr(simhash_dedup, "SKETCH_ROWS", 3)
    dice = np.random.default_rng(5)
    pool = dice.integers(0, 1 << 63, 900, np.uint64)
    sets = [dice.choice(pool, n, replace=False) for n in (0, 1, 2, 30, 400, 890, 5, 0, 700)]
    sets += [np.unique(np.concatenate((sets[4][:380], pool[-40:]))), sets[4], sets[3][1:]]
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    sketches = simhash_dedup.parity_sketches(np.concatenate(sets), first)
    for a, x in zip(sets, sketches, strict=True):
        for b, y in zip(sets, sketches, strict=True):
            unlike = len(set(a.tolist()) ^ set(b.tolist()))
            apart = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
            assert apart <= unlike and (unlike - apart) % 2 == 0
            assert unlike or not apart


def test_star_of_copies_that_are_near_their_original_only(spark):
    dice = random.Random(3)
    words = [f"s{dice.randrange(10**6)}" for _ in range(300)]
    # Five replaced words change up to 25 of 296 shingles: 0.84 to the original, about 0.72 to each other.
    texts = [" ".join(words)] + [edited(words, dice, 5) for _ in range(300)]
    far = [edited(words, dice, 40) for _ in range(5)]
    rows = list(enumerate(texts + far))
    sets = [shingles(t) for _, t in rows]

    def near(a, b):
        common = len(sets[a] & sets[b])
        return 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common)

    roots = brute_roots(range(len(rows)), near)
    assert len(set(roots.values())) == 6 and sum(near(a, b) for a in range(1, 301) for b in range(1, a)) < 2000
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.keep.doc_id for r in simhash_dedup.near_copies(frame).collect()}
    assert got == roots


def test_copy_that_says_a_passage_again(spark):
    dice, rows = random.Random(4), []
    for i in range(10):
        words = [f"w{dice.randrange(10**6):x}" for _ in range(800)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:400] + words[360:400] * 8 + words[400:]))]
    got = simhash_dedup.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.keep.doc_id == r.doc_id // 2 * 2 for r in got)


def test_keys_of_copies_move_as_two_numbers_and_name_all_holders(spark, documents):
    marked = simhash_dedup.signatures(documents.select("doc_id", "text"))
    nodes = marked.dropDuplicates(["node"]).cache()
    keyed = simhash_dedup.copy_keys(nodes)
    assert [f.dataType.simpleString() for f in keyed.schema] == ["bigint", "bigint"]
    marks = {r.mark: bytes(r.node) for r in nodes.select(F.xxhash64("node").alias("mark"), "node").collect()}
    holders = defaultdict(set)
    for r in keyed.collect():
        holders[r.key].add(marks[r.mark])
    want = {(k, len(h), n) for k, h in holders.items() if len(h) > 1 for n in h}
    got = simhash_dedup.copy_buckets(nodes).collect()
    assert want and {(r.key, r.n, bytes(r.node)) for r in got} == want and len(got) == len(want)
    sketches = {bytes(r.node): (r.prints[0], r.size, r.sketch) for r in nodes.collect()}
    assert all(sketches[bytes(r.node)] == (r.first, r.size, r.sketch) for r in got)


def test_dropping_near_copies_keeps_one_row_of_each_group(documents):
    kept = simhash_dedup.drop_copies(documents)
    assert kept.columns == documents.columns
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect())
    # The text of 1, 3 and 7 also stands in a row without id, 4 and others have no words.
    assert ids.count((True, 15)) == 1 and (True, 1) not in ids and (True, 7) not in ids
    assert [i for _, i in ids if i in (10, 11)] == [10]
    assert ids.count((False, 0)) == 3


def test_lines(documents, texts):
    rows = [r for r in texts if r[0] is not None]
    got = line_dedup.report(documents.where("doc_id is not null")).collect()
    assert len(got) == len(rows)
    lost = {r.doc_id: r.removed_lines for r in got}
    assert lost[13] == "1,2,3" and lost[3] == "0" and lost[1] == "" and lost[9] == "1"
    assert lost[4] == lost[5] == lost[6] == ""
    assert {r.doc_id: r.n_lines for r in got}[6] == 2 and {r.doc_id: r.n_lines for r in got}[4] == 0


def letters(i: int) -> str:
    return "".join(chr(97 + i // 26**p % 26) for p in range(3))


def test_fuzzy_lines_are_linked_when_near_and_kept_when_not(spark):
    base = " ".join(f"word{letters(i)}" for i in range(1500))
    near = base.replace("wordfba", "wordfbx", 1)
    far = " ".join(reversed(base.split()))
    rows = [(1, f"{base}\n\nshort"), (2, near), (3, far), (4, "Short!"), (None, f"{base.upper()} 12")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.removed_lines for r in line_dedup.report(frame).collect()}
    # The row without id comes first and keeps its line; reversing the words leaves the fingerprint.
    assert got == {None: "", 1: "0", 2: "0", 3: "", 4: "0"}
    cleaned = {r.doc_id: r.text for r in line_dedup.without_repeats(frame).collect()}
    assert cleaned[3] == far and cleaned[4] == "" and cleaned[1] == "\nshort"


def edit_distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def test_edited_lines_of_all_lengths(spark):
    dice = random.Random(6)
    words = ["".join(dice.choice("abcdefghijklmnop") for _ in range(dice.randint(3, 9))) for _ in range(500)]
    lines = []
    for n in (2, 3, 5, 6, 8, 11, 12, 20, 40, 80, 130):
        for _ in range(8):
            line = dice.sample(words, n)
            new, at = list(line), dice.randrange(n)
            new[at] = "z" + new[at][1:] if n < 12 else dice.choice(words)
            lines += [" ".join(line), " ".join(new)]
    # One template: the fields of most lines differ too much, so a key holds many lines apart.
    lines += [f"record of {' '.join(dice.sample(words, 3))} was stored by the server" for _ in range(80)]
    lines += [lines[-1][:-1] + "x", lines[-20][:-1] + "x"]

    def near(a, b):
        x, y = lines[a], lines[b]
        most = max(len(x), len(y)) // 10
        return abs(len(x) - len(y)) <= most and (x == y or len(set(x.split()) ^ set(y.split())) < 20 and edit_distance(x, y) <= most)

    roots = brute_roots(range(len(lines)), near)
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    lost = {r.doc_id for r in line_dedup.report(frame).where("n_removed > 0").collect()}
    want = {i for i in roots if roots[i] != i}
    assert len(want) > 85 and lost == want


def test_frequent_words_do_not_make_lines_meet(spark, monkeypatch):
    dice = random.Random(9)
    common = "the of to in and is".split()
    lines = []
    for _ in range(400):
        rare = ["".join(dice.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(5)]
        lines.append(" ".join(f"{w} {' '.join(dice.sample(common, 2))}" for w in rare))
    lines += [line[:-1] + "z" for line in lines[:20]]
    compared = []

    def counted(df, name):
        staged = stage(df, name)
        if name in ("line-pairs", "line-rest"):
            compared.append(staged.count())
        return staged

    monkeypatch.setattr(line_dedup, "stage", counted)
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    lost = {r.doc_id for r in line_dedup.report(frame).where("n_removed > 0").collect()}
    assert lost == set(range(400, 420)) and len(compared) == 2 and sum(compared) < 200


def test_lines_leave_one_table(spark, documents):
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before, codec = set(folder.iterdir()), spark.conf.get("spark.sql.parquet.compression.codec")
    got = line_dedup.report(documents.where("doc_id is not null"))
    left = [p.name for p in set(folder.iterdir()) - before]
    assert len(left) == 1 and left[0].startswith("line-removed-") and got.where("n_removed > 0").count() > 3
    assert spark.conf.get("spark.sql.parquet.compression.codec") == codec


def test_normal_lines(spark):
    text = "A,b\n c..  D-1234\tE \n\n...\r\n\u00c4\u03a3 \u03a3x9 8\u0663 ,\n-q"
    frame = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {(r.doc_id, r.line_no): r.normal for r in line_dedup.lines(frame).collect()}
    assert got == {(1, 0): "a b", (1, 1): "c d 0 e", (1, 4): "\u00e4\u03c2 \u03c3x0 0\u0663", (1, 5): "q"}


def test_empty_tables(no_documents):
    assert substring_dedup.remove_repeats(no_documents).count() == 0
    assert suffix_dedup.remove_repeated_bytes(no_documents).count() == 0
    assert simhash_dedup.fingerprint_classes(no_documents).count() == 0
    assert simhash_dedup.drop_copies(no_documents).count() == 0
    assert line_dedup.report(no_documents).count() == 0


def test_digest_of_kept_text(documents):
    kept = substring_dedup.remove_repeats(documents.where("doc_id = 8"))
    row = kept.select(F.sha2("text", 256), "text").first()
    assert row[0] == hashlib.sha256(row[1].encode()).hexdigest() and len(WORD.findall(row[1])) == 4000
