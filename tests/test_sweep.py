"""The sweep of trees against a plain tree for each pair."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from windowguard.operators import sweep, textmodels


def in_train(seq, plan):
    digits = hashlib.md5(f"{plan.seed}:{seq}".encode()).hexdigest()[:8]
    return int(digits, 16) / 16**8 >= plan.fraction


def plain_bins(cells, max_bins):
    """{(seq, token): bin} by ranks of the values of each token."""
    bins = {}
    for token in {t for _, t in cells}:
        values = sorted((v, s) for (s, t), v in cells.items() if t == token and v > 0)
        kinds = sorted({v for v, _ in values})
        for v, s in values:
            if len(kinds) <= max_bins:
                bins[s, token] = kinds.index(v) + 1
            else:
                bins[s, token] = sum(x < v for x, _ in values) * max_bins // len(values) + 1
    return bins


def purity(p, n):
    return (p * p + (n - p) * (n - p)) / n


def plain_tree(train, bins, tokens, depth, node=1):
    """{node: (token, bin)} of one tree over [(seq, label)]."""
    n, p = len(train), sum(y for _, y in train)
    if depth == 0 or p in (0, n):
        return {}
    options = []
    for token in tokens:
        for cut in {bins[s, token] for s, _ in train if (s, token) in bins}:
            right = [y for s, y in train if bins.get((s, token), 0) >= cut]
            if len(right) < n and sum(right) * n != p * len(right):
                options.append((-(purity(sum(right), len(right)) + purity(p - sum(right), n - len(right))), token, cut))
    if not options:
        return {}
    _, token, cut = min(options)
    sides = [[x for x in train if (bins.get((x[0], token), 0) >= cut) == side] for side in (False, True)]
    below = [plain_tree(side, bins, tokens, depth - 1, 2 * node + i) for i, side in enumerate(sides)]
    return {node: (token, cut), **below[0], **below[1]}


def leaf(seq, tree, bins):
    node = 1
    while node in tree:
        token, cut = tree[node]
        node = 2 * node + (bins.get((seq, token), 0) >= cut)
    return node


def drawn(rows, plan):
    """{(error, service): [(seq, label)]} with the runs of each pair in hash order."""
    out = {}
    for error, service in {(t, s) for _, _, t, s in rows if t != plan.normal}:
        runs = {r for _, r, t, s in rows if (t, s) == (error, service)}
        runs = sorted(runs, key=lambda r: (hashlib.md5(f"{plan.seed}|{error}|{service}|{r}".encode()).hexdigest(), r))[: plan.n_runs]
        members = {(q, int(t == error)) for q, r, t, s in rows if s == service and r in runs and t in (error, plan.normal)}
        out[error, service] = sorted(members)
    return out


@pytest.mark.parametrize("plan", [sweep.Sweep(n_runs=5, max_depth=4, max_bins=3), sweep.Sweep(n_runs=3, max_depth=2, seed=7)])
def test_sweep_equals_plain_trees(spark, plan):
    dice = random.Random(plan.seed)
    words = [f"w{i}" for i in range(8)]
    rows, cells = [], {}
    for run in range(7):
        for service in ("user", "token"):
            for test in ("correct", "e1", "e2", "e3"):
                if test == "e3" and service == "token":
                    continue
                for copy in range(3 if test == "correct" else 2):
                    seq = f"{run}-{service}-{test}-{copy}"
                    rows.append((seq, f"r{run}", test, service))
                    mean = {"correct": 2, "e1": 4, "e2": 2, "e3": 7}[test]
                    for word in words[: 2 + run]:
                        count = dice.randrange(mean + 1)
                        if count:
                            cells[seq, word] = count
    rows.append(("shared", "r1", "correct", "user"))
    cells["shared", "w0"] = 3
    counted = spark.createDataFrame([(s, t, n) for (s, t), n in cells.items()], "seq string, token string, n int")
    sequences = spark.createDataFrame([*rows, rows[0], (None, "r1", "e1", "user"), ("x", "r1", None, "user")], "seq string, run string, test_name string, service string")
    scores, trees = sweep.tree_sweep(counted, sequences, "seq", plan)
    bins = plain_bins(cells, plan.max_bins)
    want_trees, want = Counter(), Counter()
    for pair, members in drawn(rows, plan).items():
        train = [m for m in members if in_train(m[0], plan)]
        tree = plain_tree(train, bins, words, plan.max_depth)
        want_trees.update((*pair, node, token, cut) for node, (token, cut) in tree.items())
        at = {}
        for seq, label in train:
            at.setdefault(leaf(seq, tree, bins), []).append(label)
        for seq, label in members:
            if not in_train(seq, plan):
                here = at.get(leaf(seq, tree, bins))
                want[*pair, seq, float(label), sum(here) / len(here) if here else None] += 1
    assert Counter(tuple(r) for r in trees.select("error_type", "service", "node", "token", "bin").collect()) == want_trees
    assert Counter(tuple(r) for r in scores.collect()) == want


def test_bins_by_rank(spark):
    plan = sweep.Sweep(max_bins=4)
    cells = {(f"s{i}", "many"): i % 11 + 1 for i in range(50)} | {(f"s{i}", "few"): i % 3 for i in range(50)}
    counted = spark.createDataFrame([(s, t, n) for (s, t), n in cells.items()], "seq string, token string, n int")
    got = {(r["seq"], r["token"]): r["bin"] for r in sweep.binned(counted, "seq", "n", plan).collect()}
    assert got == plain_bins(cells, 4) and max(got.values()) == 4


def test_separable_pairs_are_learnt(spark):
    from windowguard.operators.evaluate import ranking_metrics

    texts = {"correct": "ok fine", "e1": "ok broken", "e2": "ok odd odd odd"}
    rows = [(f"{t}{i}", f"r{i}", t, "user", texts[t].split()) for t in texts for i in range(20)]
    df = spark.createDataFrame(rows, "seq string, run string, test_name string, service string, words array<string>")
    counted = textmodels.sequence_tokens(df, "seq", "words")
    scores, trees = sweep.tree_sweep(counted, df, "seq")
    assert trees.count() == 2
    got = ranking_metrics(scores, "score", "label", sweep.PAIR).collect()
    assert {(r["error_type"], r["auroc"]) for r in got} == {("e1", 1.0), ("e2", 1.0)}
    weighted = textmodels.vector_cells(counted, counted, "seq").withColumnRenamed("weight", "n")
    assert {r["score"] for r in sweep.tree_sweep(weighted, df, "seq")[0].collect()} == {0.0, 1.0}


def test_empty_sweep(spark):
    counted = spark.createDataFrame([], "seq string, token string, n int")
    sequences = spark.createDataFrame([("a", "r", "correct", "s")], "seq string, run string, test_name string, service string")
    scores, trees = sweep.tree_sweep(counted, sequences, "seq")
    assert scores.count() == 0 and trees.count() == 0
    one = sequences.unionByName(sequences.select(F.lit("b").alias("seq"), "run", F.lit("e").alias("test_name"), "service"))
    scores, trees = sweep.tree_sweep(counted, one, "seq")
    assert trees.count() == 0 and scores.count() <= 2


def test_jobs_do_not_grow_with_pairs(spark):
    def jobs(n):
        rows = [(f"{t}-{i}-{c}", f"r{i}", t, "s") for t in ["correct", *(f"e{k}" for k in range(n))] for i in range(4) for c in range(4)]
        sequences = spark.createDataFrame(rows, "seq string, run string, test_name string, service string")
        counted = spark.createDataFrame([(r[0], r[2], 1) for r in rows], "seq string, token string, n int")
        group = f"sweep-{n}"
        spark.sparkContext.setJobGroup(group, group)
        sweep.tree_sweep(counted, sequences, "seq", sweep.Sweep(max_depth=1))[0].collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(12) == jobs(2)


def test_few_cells_move_in_the_sweep(spark):
    from test_entry import plan

    cells = [(i, f"t{j}", float(1 + (i * j) % 3)) for i in range(30) for j in range(40) if (i + j) % 4]
    tokens = spark.createDataFrame([*cells, (1, "one", 5.0), (2, None, 1.0), (3, None, 2.0)], "seq long, token string, n double")
    seen = {}
    for _, t, v in [*cells, (1, "one", 5.0)]:
        seen.setdefault(t, set()).add(v)
    want = sorted((i, t, 1 + sorted(seen[t]).index(v)) for i, t, v in [*cells, (1, "one", 5.0)])
    got = sweep.binned(tokens, "seq", "n", sweep.Sweep())
    assert sorted(map(tuple, got.collect())) == want

    members = spark.createDataFrame([("e", "s", i, i % 2, True, 1) for i in range(30)], "error_type string, service string, seq long, label int, train boolean, node long")
    splits = spark.createDataFrame([("e", "s", 1, "t5", 2, 30, 15)], "error_type string, service string, node long, token string, bin int, n long, positive long")
    moved = sweep.descend(members, splits, got)
    high = {i for i, t, b in want if t == "t5" and b >= 2}
    assert {r["seq"]: r["node"] for r in moved.collect()} == {i: 3 if i in high else 2 for i in range(30)}
    assert "LeftSemi" in plan(moved)  # cells of tokens that split nothing are left behind
