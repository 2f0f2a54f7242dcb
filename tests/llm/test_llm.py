"""Operators of the training-data subpackage against brute force, exact round trips and stated edge cases."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import abuse, cooccurrence, leakage, mapping, mixture, neardup, neighbours
from corvane.operators.components import components

WORD = re.compile("[a-z0-9]+")


def brute_groups(texts, width, similarity, least):
    sets = {i: {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} for i, t in texts.items() if t and len(w := WORD.findall(t.lower())) >= max(least, width)}
    root = {i: i for i in sets}
    links = Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    out = defaultdict(set)
    for i in sets:
        out[find(i)].add(i)
    return {frozenset(v) for v in out.values()}, links


def edited(rng, words):
    w = list(words)
    for _ in range(rng.randint(0, 9)):
        k = rng.randrange(len(w))
        move = rng.random()
        if move < 0.4:
            w[k] = f"z{rng.randrange(999)}"
        elif move < 0.7:
            w.insert(k, f"y{rng.randrange(999)}")
        else:
            w.append(w.pop(k))
    return " ".join(w)


@pytest.mark.parametrize("width, similarity, least", [(3, 0.5, 25), (5, 0.8, 1)])
def test_near_duplicates_match_brute_force(spark, width, similarity, least):
    rng = random.Random(width)
    texts, n = {}, 0
    for _ in range(25):
        base = [f"w{rng.randrange(120)}" for _ in range(rng.choice([12, 30, 60, 150]))]
        for _ in range(rng.randint(1, 5)):
            texts[f"r{n:03d}"] = edited(rng, base)
            n += 1
    texts |= {"n0": None, "n1": "", "n2": "too short", "long": " ".join(f"q{i}" for i in range(30_000))}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(i, t, "later") for i, t in list(texts.items())[:9]], "id string, body string, toks string")
    got = neardup.near_duplicates(df, "id", "body", width, similarity, least).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.group_id].add(r.id)
    wanted, links = brute_groups(texts, width, similarity, least)
    assert {frozenset(g) for g in groups.values()} == wanted
    assert all(k == min(g) for k, g in groups.items())
    assert all((r.links > 0) == (len(groups[r.group_id]) > 1) for r in got)


def test_records_without_allocation_are_scanned(spark, monkeypatch):
    real = neardup._allocate

    def none(n, *a):
        level, enough = real(n, *a)
        return np.zeros_like(level), np.zeros_like(enough)

    monkeypatch.setattr(neardup, "_allocate", none)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(40)]
    texts = {f"r{i}": edited(rng, base) for i in range(12)} | {f"s{i}": " ".join(f"v{rng.randrange(500)}" for _ in range(40)) for i in range(12)}
    df = spark.createDataFrame(list(texts.items()), "id string, t string")
    groups = defaultdict(set)
    for r in neardup.near_duplicates(df, "id", "t", 3, 0.5, 25).collect():
        groups[r.group_id].add(r.id)
    assert {frozenset(g) for g in groups.values()} == brute_groups(texts, 3, 0.5, 25)[0]


def test_hot_keys_are_dealt_out_and_lose_nothing(spark, monkeypatch):
    rng = random.Random(4)
    shared = [f"b{i}" for i in range(30)]  # half of every record
    texts = {f"r{i:03d}": " ".join(shared + [f"w{rng.randrange(900)}" for _ in range(rng.randint(10, 45))]) for i in range(260)}
    texts |= {f"s{i:03d}": edited(rng, texts[f"r{i:03d}"].split()) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "id string, t string")
    wanted = brute_groups(texts, 3, 0.5, 25)[0]
    real = neardup._deal
    monkeypatch.setattr(neardup._Costs, "of", lambda self, keys, table: np.ones(len(keys)))  # costs do not avoid the hot keys
    monkeypatch.setattr(neardup, "HOT", 0.001)
    groups = defaultdict(set)
    for r in neardup.near_duplicates(df, "id", "t", 3, 0.5, 25).collect():
        groups[r.group_id].add(r.id)
    assert {frozenset(g) for g in groups.values()} == wanted
    n = 200_000
    key = np.where(np.arange(n) % 2 == 0, np.uint64(7 << 44), neardup._mix(np.arange(n).astype(np.uint64)))
    flag = np.full(n, 3, np.uint8)
    flag[::4] = 2
    k, who, f, bucket = real(key, np.arange(n), flag, np.arange(n), np.where(key == np.uint64(7 << 44), 32, 1), 64)
    held = np.bincount(bucket[(f & 2) > 0], minlength=64)
    assert held.max() <= 3 * np.median(held) and held.sum() == n
    assert ((f & 1) > 0).sum() == ((flag & 1) > 0)[key != np.uint64(7 << 44)].sum() + 32 * ((flag & 1) > 0)[key == np.uint64(7 << 44)].sum()


def test_many_lone_records_of_one_partition_are_all_scanned(spark, monkeypatch):
    real = neardup._allocate

    def none(n, *a):
        level, enough = real(n, *a)
        return np.zeros_like(level), np.zeros_like(enough)

    monkeypatch.setattr(neardup, "_allocate", none)
    monkeypatch.setattr(neardup, "SCAN_BLOCK", 150)
    rng = random.Random(2)
    texts = {}
    for g in range(200):  # numbers 194 to 244 begin with a byte that leads a character in UTF-8
        base = [f"w{rng.randrange(5000)}" for _ in range(40)]
        texts |= {f"r{g:03d}a": " ".join(base), f"r{g:03d}b": " ".join(base[:-3] + ["x", "y"])}
    df = spark.createDataFrame(list(texts.items()), "id string, t string").coalesce(1)
    groups = defaultdict(set)
    for r in neardup.near_duplicates(df, "id", "t", 3, 0.5, 25).collect():
        groups[r.group_id].add(r.id)
    assert {frozenset(g) for g in groups.values()} == brute_groups(texts, 3, 0.5, 25)[0]


def test_one_short_record_makes_no_long_ones_scanned(spark, monkeypatch):
    def scanned(*a):
        raise AssertionError("records were compared with all others")

    monkeypatch.setattr(neardup, "_scan", scanned)
    rng = random.Random(3)
    texts = {f"r{i:03d}": " ".join(f"v{rng.randrange(3000)}" for _ in range(rng.randint(120, 161))) for i in range(60)}
    texts |= {f"s{i:03d}": edited(rng, texts[f"r{i:03d}"].split()) for i in range(20)}
    texts |= {"t0": " ".join(f"u{i}" for i in range(81)), "t1": " ".join(f"u{i}" for i in range(155))}  # linked across the bands
    groups = defaultdict(set)
    for r in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "id string, t string"), "id", "t", 3, 0.5, 25).collect():
        groups[r.group_id].add(r.id)
    assert {frozenset(g) for g in groups.values()} == brute_groups(texts, 3, 0.5, 25)[0]
    assert {"t0", "t1"} in groups.values()


def test_few_pairs_of_one_vocabulary_are_compared(monkeypatch):
    import pyarrow as pa

    rng = random.Random(6)
    names = [f"a{rng.randrange(60)} b{i}" for i in range(260)]
    texts = ["job posting for " + " ".join(rng.sample(names, 22)) for _ in range(3000)]
    texts += [edited(rng, t.split()) for t in texts[:100]]
    _, n, tok = neardup._Shingler(3, 25, 0)(texts)
    order, compared, found = neardup._Order(np.repeat(np.arange(len(n)), n), tok), [], set()
    real = neardup._passes
    monkeypatch.setattr(neardup, "_passes", lambda xa, *a: compared.append(len(xa)) or real(xa, *a))
    ends = np.cumsum(n)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n, pa.int32()), pa.array([neardup._pack40(tok[e - k : e]) for k, e in zip(n, ends)], pa.binary())], names=["rid", "n", "toks"])
    for out in neardup._sign(order, 3, set(neardup._band(n).tolist()), {}, 1 / 3, 0.5)(iter([batch])):
        for b in neardup._meet(1 / 3, 0.5)(iter([out])):
            found |= set(zip(b["a"].to_pylist(), b["b"].to_pylist()))
    sets = [set(tok[e - k : e].tolist()) for k, e in zip(n, ends)]
    assert all((i, 3000 + i) in found for i in range(100) if 2 * len(sets[i] & sets[3000 + i]) >= len(sets[i] | sets[3000 + i]))
    assert sum(compared) < 0.02 * len(n) ** 2 / 2


def test_many_copies_are_one_group(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.range(3000).select(F.format_string("c%05d", "id").alias("id"), F.lit(text).alias("t"))
    got = neardup.near_duplicates(df, "id", "t", 3, 0.5, 25)
    assert got.groupBy("group_id", "links").count().collect()[0] == ("c00000", 1, 3000)
    assert neardup.near_duplicates(df.where(F.lit(False)), "id", "t").count() == 0


def test_match_takes_runs_longer_than_a_block(monkeypatch):
    monkeypatch.setattr(neardup, "PAIR_BLOCK", 7)
    first, count = np.array([0, 5, 9]), np.array([3, 20, 2])
    got = [(int(r), int(p)) for rows, at in neardup._expand(first, count) for r, p in zip(rows, at)]
    assert got == [(i, p) for i in range(3) for p in range(first[i], first[i] + count[i])]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}


def test_cooccurrence_matches_brute_force_in_small_runs(spark):
    rng = random.Random(3)
    rows = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))] for _ in range(400)] + [["hot", "a"]] * 200 + [None, [], [None], ["a", None, "a"]]
    df = spark.createDataFrame([(r, "x") for r in rows], "s array<string>, code string")
    sets = [set(x for x in r if x is not None) for r in rows if r]
    sets = [s for s in sets if s]
    single, both = Counter(x for s in sets for x in s), Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
    got = {(r.item_a, r.item_b): r for r in cooccurrence.cooccurrence(df, "s", 5, 0.01, run_codes=64).collect()}
    least = max(5, -(-len(sets) // 100))
    assert {k: r.n_both for k, r in got.items()} == {k: v for k, v in both.items() if v >= least}
    for (a, b), r in got.items():
        assert (r.n_a, r.n_b, r.n) == (single[a], single[b], len(sets))
        c = both[a, b]
        odds = (c + 0.5) * (len(sets) - single[a] - single[b] + c + 0.5) / ((single[a] - c + 0.5) * (single[b] - c + 0.5))
        assert abs(r.odds_ratio - odds) < 1e-9 and abs(r.lift - c * len(sets) / single[a] / single[b]) < 1e-9
    assert cooccurrence.cooccurrence(df.where(F.lit(False)), "s").count() == 0


@pytest.mark.parametrize("most", [1 << 16, 20])
def test_all_pairs_of_a_vocabulary_with_and_without_a_dictionary(spark, monkeypatch, most):
    monkeypatch.setattr(cooccurrence, "MAX_ITEMS", most)
    rng = random.Random(4)
    rows = [[f"s{rng.randrange(60)}" for _ in range(rng.randint(0, 6))] for _ in range(300)] + [None, [], [None], ["s1", None, "s1"], ["é", "z", "\U0001f600", "\uffee"]]
    df = spark.createDataFrame([(r,) for r in rows], "s array<string>")
    sets = [s for r in rows if r and (s := {x for x in r if x is not None})]
    single, both = Counter(x for s in sets for x in s), Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
    got = cooccurrence.cooccurrence(df, "s", 1, 0.0, run_codes=64).collect()
    assert len(got) == len(both) and {(r.item_a, r.item_b): (r.n_both, r.n_a, r.n_b, r.n) for r in got} == {(a, b): (c, single[a], single[b], len(sets)) for (a, b), c in both.items()}


def test_pair_measures_has_rare_pairs(spark):
    import os

    from corvane.llm import catalogue
    from corvane.plans import packed_queries

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    sets = [{x.strip().lower() for x in r[0]} for r in packed_queries.demand_skills(spark, sf).select("all_skills").collect() if r[0]]
    both = Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
    got = {(r.skill_a, r.skill_b): r.n_both for r in catalogue.p2_pair_measures(spark, sf).select("skill_a", "skill_b", "n_both").collect()}
    print("pairs", len(got), "of", len(both), "frequent", sum(c >= max(5, 0.005 * len(sets)) for c in both.values()))
    assert got == both


def test_runs_merge_across_batches():
    import pyarrow as pa

    batch = lambda codes, n: pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])
    out = [r for b in cooccurrence._merge(iter([batch([1, 1, 2], [1, 2, 1]), batch([2, 2], [5, 1]), batch([], []), batch([2, 9], [1, 1])])) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert out == [(1, 3), (2, 8), (9, 1)]


def clusters(n, dim=32, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((n // 10, dim))
    return np.repeat(c, 10, axis=0) + 0.25 * rng.standard_normal((n // 10 * 10, dim))


def test_nearest_recall_and_invalid_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 150)
    x = clusters(1200)
    rows = [(f"v{i:04d}", r.astype(float).tolist(), "n") for i, r in enumerate(x)]
    rows += [("bad1", None, ""), ("bad2", [0.0] * 32, ""), ("bad3", [1.0] * 31, ""), ("bad4", [float("nan")] * 32, ""), ("bad5", [float("inf")] + [1.0] * 31, ""), ("bad6", [None] + [1.0] * 31, ""), (None, [1.0] * 32, "")] + rows[:5]
    got = neighbours.nearest(spark.createDataFrame(rows, "id string, vec2 array<double>, vec string"), "id", "vec2", 32, 5).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    wanted = {(f"v{i:04d}", f"v{j:04d}") for i in range(len(x)) for j in np.argsort(-s[i])[:5]}
    mine = {(r.id, r.near_id) for r in got}
    assert len(wanted & mine) / len(wanted) >= 0.9 and not any("bad" in a + b for a, b in mine)
    assert Counter(r.id for r in got) == {f"v{i:04d}": 5 for i in range(len(x))}


def test_search_goes_on_in_deep_trees_until_the_test_holds(spark, monkeypatch):
    real = neighbours.Forest.__init__
    monkeypatch.setattr(neighbours, "LEAF", 20)
    monkeypatch.setattr(neighbours.Forest, "__init__", lambda self, sample, total, trees, dims=neighbours.DIMS, leaf=20: real(self, sample, total, trees, dims, 20))
    x = clusters(3000, 32, 4)  # trees of depth 8
    df = spark.createDataFrame([(f"v{i:04d}", r.astype(float).tolist()) for i, r in enumerate(x)], "id string, v array<double>")
    mine = {(r.id, r.near_id) for r in neighbours.nearest(df, "id", "v", 32, 5).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    wanted = {(f"v{i:04d}", f"v{j:04d}") for i in range(len(x)) for j in np.argsort(-s[i])[:5]}
    recall = len(wanted & mine) / len(wanted)
    print("recall", recall)
    assert len(mine) == 5 * len(x) and recall >= 0.97


def test_leaves_to_see_leave_no_more_than_the_chance_allowed():
    x = clusters(3000, 32, 5).astype(np.float32)
    f = neighbours.Forest(x, len(x), 1, leaf=20)
    d = np.full(40, 2, np.float32)
    row, leaf, lost = f.visits(0, x[:40], d, np.full(40, 0.1), 256)
    assert (lost <= 0.1 + 1e-9).all() and len(set(zip(row, leaf))) == len(row)
    row, leaf, lost = f.visits(0, x[:40], d, np.full(40, 0.1), 3)
    assert (np.bincount(row) <= 3).all() and (lost > 0.1).any()
    row, _, lost = f.visits(0, x[:40], d, np.zeros(40), 256)
    assert (np.bincount(row) == 256).all() and (lost < 1e-6).all()


def test_copies_are_each_others_neighbours(spark):
    rows = [(f"c{i:02d}", [1.0, 2.0, 3.0]) for i in range(40)] + [("d0", [2.0, 4.0, 7.0]), ("d1", [-1.0, 0.0, 0.0])]
    got = defaultdict(list)
    for r in sorted(neighbours.nearest(spark.createDataFrame(rows, "id string, v array<double>"), "id", "v", 3, 5).collect(), key=lambda r: (r.id, r["rank"])):
        got[r.id].append(r.near_id)
    assert got["c30"] == [f"c{i:02d}" for i in range(5)] and got["c02"] == ["c00", "c01", "c03", "c04", "c05"] and got["d0"] == [f"c{i:02d}" for i in range(5)]
    two = spark.createDataFrame(rows[-2:], "id string, v array<double>")
    assert neighbours.nearest(two, "id", "v", 3, 5).count() == 2 and neighbours.nearest(two.where(F.lit(False)), "id", "v", 3, 5).count() == 0


REFS = [("skill", 1, "python", False), ("skill", 2, "client/server design", False), ("skill", 3, "stream processing", False), ("skill", 4, "java", False), ("skill", 3, "event pipelines", True), ("skill", 5, "c#", False), ("title", 1, "data engineer", False), ("title", 2, "health and safety officer", False), ("city", 1, "Ostgothafield", False), ("city", 2, "San Wenport", False), ("city", 1, "Veliny", True)]


@pytest.mark.parametrize(
    "domain, typed, ref",
    [
        ("skill", "pyhton", 1), ("skill", "Pythоn", 1), ("skill", "strong python (expert)", 1), ("skill", "python v2", 1), ("skill", "design client/server", 2), ("skill", "client_server_design!", 2),
        ("skill", "stre. processing", 3), ("skill", "processing of stream", 3), ("skill", "event pipelines", 3), ("skill", "C# knowhow", 5), ("skill", "falcon taming", 0), ("skill", "n/a", 0), ("skill", "java!", 4),
        ("title", "sr. data eng.", 1), ("title", "engineer, data", 1), ("title", "part time data enginer - san wenport", 1), ("title", "2 x Data Engineer (m/f/d)", 1), ("title", "royal jester", 0),
        ("city", "o s t g o t h a f i e l d", 1), ("city", "OSTGOTHAFEILD / hybrid", 1), ("city", "Metro San Wenport, Sarmonia", 2), ("city", "veliny city", 1), ("city", "remote", 0),
        # qualifiers that stand in no list and beside no other name here
        ("title", "experienced data engineer", 1), ("title", "Chief Data Engineer", 1), ("title", "Werkstudent Data Engineer", 1), ("title", "data engineer, night shift", 1), ("title", "Data Engineer - Urgent Backfill", 1),
        ("skill", "5 yrs python", 1), ("skill", "python ninja", 1), ("skill", "pythn programming skills", 1),
    ],
)
def test_mapping(mapped, domain, typed, ref):
    assert mapped[domain, typed] == ref


@pytest.fixture(scope="module")
def mapped(spark):
    cases = next(m for m in test_mapping.pytestmark if m.name == "parametrize").args[1]
    rows = [(d, "r", t) for d, t, _ in cases] + [("skill", "r", None), ("skill", "r", "  "), ("skill", "r", " PYTHON "), ("city", "a", "remote")]
    refs = spark.createDataFrame(REFS, "domain string, ref_id int, name string, alias boolean")
    out = mapping.map_values(spark.createDataFrame(rows, "domain string, record_id string, item string"), refs).collect()
    assert len(out) == len(cases) + 1  # exact names, nulls and blanks are left out; repeats stay
    return {(r.domain, r.item): r.ref_id for r in out}


def test_leaks_match_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 20, 60])))) for i in range(40)]
    docs = []
    for d in range(80):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 50, 200]))]
        if d % 3 == 0:
            source = items[rng.randrange(40)][1].split()
            n = rng.choice([12, 13, 14, 40])
            k = rng.randrange(max(1, len(source) - n + 1))
            words[5:5] = source[k : k + n]
        docs.append((d, ", ".join(words).upper()))
    docs += [(900, None), (901, ""), (902, items[1][1]), (902, items[1][1]), (903, "x " * 40_000)]
    gram = lambda t: {tuple(w[k : k + 13]) for w in [WORD.findall((t or "").lower())] for k in range(len(w) - 12)}
    wanted = Counter((d, i) for d, t in docs for i, s in items if gram(t) & gram(s))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + [(99, None)], "item_id long, text string")
    assert Counter((r.doc_id, r.item_id) for r in leakage.leaked(df, it).collect()) == wanted
    assert Counter((r.doc_id, r.item_id) for r in leakage.leaked(df, it, max_index=7).collect()) == wanted
    assert leakage.leaked(df, it.where(F.lit(False))).count() == 0 and leakage.leaked(df.where(F.lit(False)), it).count() == 0


def test_mixture_reaches_targets_within_repeats(spark, tmp_path):
    import os

    if not os.path.exists(f"{mixture.TOKENIZERS}/{mixture.VOCABULARY}"):
        pytest.skip("no tokenizer files")
    docs = [(i, f"word{i} " * (5 + i % 7), "big" if i % 3 else "small") for i in range(600)] + [(900, None, "big"), (901, "", "big"), (902, "x y", "other"), (903, "x y", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("tokens", F.lit(7))
    targets = spark.createDataFrame([("big", 0.3, 1), ("small", 0.6, 2), ("absent", 0.1, 5), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    rows, report = mixture.mixture(df, targets)
    got, shares = rows.collect(), {r.source: r for r in report.collect()}
    assert abs(shares["big"].share - 1 / 3) < 0.01 and abs(shares["small"].share - 2 / 3) < 0.01 and shares["absent"].share == 0
    assert max(Counter(r.doc_id for r in got).values()) <= 2 and {r.source for r in got} == {"big", "small"}
    p = [r.position for r in got]
    assert p == sorted(p) and 0 <= p[0] and p[-1] <= 1
    early = Counter()
    for r in got:
        if r.position < 0.25:
            early[r.source] += r.tokens
    assert early["big"] / sum(early.values()) > shares["big"].share  # the curated source comes later
    empty, none = mixture.mixture(df.where(F.lit(False)), targets)
    assert empty.count() == 0 and none.count() == 3


WORDS = Counter({w: 50 for w in "the weather is fine and your order of trash bags report policy forbids insults nude uploads before release dog shelter needs breeder who knows bitches from males".split()} | {"x": 20_000})
TRIGRAMS = Counter()
for _w, _c in WORDS.items():
    for _k in range(len(_w) + 1):
        TRIGRAMS[f"^^{_w}$"[_k : _k + 3]] += _c
SCORER = abuse.Scorer(TRIGRAMS, WORDS)


@pytest.mark.parametrize("text", ["You are an idiot", "you 1d10t, get lost", "Y.o.u are a p-a-t-h-e-t-i-c moron", "Du bist ein Schwa*hkopf", "CÁLLATE, CABRÓN", "Ferme ta gueule", "Lowlander people are born th13v3$ and ought to be locked away", "Just $h0w me your t1t$", "go drop dead, you bitttttch", "<p>Alle Lowlander sind Ungeziefer</p>"])
def test_abuse_is_found(text):
    assert SCORER.score("The weather is fine. " + text + ". The order is fine.")[0] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", ["You are an id" + "i" * 60 + "ot", "Let me\ngrope you", "Just show me\r\nyour body", "Let me <b>grope</b> you"])
def test_abuse_in_stretched_words_and_across_lines_is_found(text):
    assert SCORER.score("The weather is fine. " + text + ". The order is fine.")[0] >= abuse.THRESHOLD


def test_sentences_and_new_lines_stay_apart():
    assert abuse.plain("You are.\nidiot\nIdiot\n- idiot\n1. x") == "you are.\nidiot\nidiot\n- idiot\n1. x"


@pytest.mark.parametrize("text", [None, "", "  ", "The policy forbids insults.", "Moderators screen nude uploads before release.", "The dog shelter needs a breeder who knows bitches from males.", "Pay was trash", "c# and a/b testing, 3d, 5s, v2", "Lowlander applicants are warmly encouraged."])
def test_neutral_texts_are_not(text):
    assert SCORER.score(text)[0] < abuse.THRESHOLD


def test_scores_of_a_table(spark):
    df = spark.createDataFrame([(1, "you are an idiot", "a"), (1, "you are an idiot", "a"), (2, None, "b"), (3, "fine " * 60_000, None)], "doc_id long, text string, kind string").withColumn("source", F.lit("s"))
    got = abuse.score_documents(df.drop("kind"), keep=("source",)).collect()
    assert sorted((r.doc_id, r.score >= 0.5) for r in got) == [(1, True), (1, True), (2, False), (3, False)]
    assert abuse.score_documents(df.where(F.lit(False)).drop("kind")).count() == 0


# Written after the rules and never used to change them before the rates in the README were taken (0.84 found, 0.88 right).
UNSEEN_ABUSE = """Everyone knows Mexicans are thieves and rapists.
You disgust me, you fat lazy slob.
If you come near my desk again I will smash your skull.
Honestly, the intern is dumb as a brick and an ugly freak.
Old people are useless and ought to be got rid of.
Come to my room tonight and let me lick you all over.
I bet your wife is a filthy whore.
Someone should shoot that manager in the head.
G0 k1ll y0urself, l0ser.
s.l.u.t, that is what she is
You're a pathetic little worm.
Muslims are terrorists and must be deported.
Nice ass, want to have some fun in the back of the car?
Drecksau, ich hau dir aufs Maul!
Flüchtlinge sind Ungeziefer, alle raus!
Willst du mit mir ins Bett, Süße?
Ihr seid alle Idioten und Versager.
Je vais te tuer, salope.
Les Arabes sont des voleurs, dehors !
Tu as un beau cul, viens dans mon lit.
Ferme ta grande gueule, minable.
Los negros son unos vagos y unos ladrones.
Cállate, pedazo de imbécil.
Ojalá te atropelle un coche y te mueras.
Quiero follarte en la oficina.""".splitlines()
UNSEEN_CLEAN = """Our shop sells dog food, cat litter and fish tanks.
He killed the server by mistake and felt stupid about it.
The novel is about a thief who steals from criminals.
Please do not call customers names such as stupid or ugly.
You will be beaten on price by nobody.
The gym helps fat and lazy people like me get fit.
Women are underpaid in this industry and that must change.
She works with disabled people and loves it.
Nurses wash naked patients with dignity and respect.
The course explains how to report sexual harassment.
They should be fired up about the launch!
I hope you die laughing at our team quiz.
We must exclude foreign transactions from the report.
The company treats its staff like garbage and lies about pay.
A killer feature that will blow your mind.
Der Hund ist faul, aber lieb.
Die Frauen müssen gleich bezahlt werden.
Wir schlagen Ihnen einen Termin vor.
Les chiens et les porcs sont élevés en plein air.
Il faut tuer les bactéries avant de servir.
Nous souhaitons une femme ou un homme motivé.
La enfermedad se trata en la clínica con medicinas.
Los inmigrantes deben presentar su permiso de trabajo.
Hay que matar el proceso y reiniciar.
The bed is dirty and the hotel room smells.""".splitlines()


def test_unseen_phrasings():
    right = sum(SCORER.score(t)[0] >= abuse.THRESHOLD for t in UNSEEN_ABUSE)
    wrong = sum(SCORER.score(t)[0] >= abuse.THRESHOLD for t in UNSEEN_CLEAN)
    assert right >= 0.8 * len(UNSEEN_ABUSE) and right / (right + wrong) >= 0.8


def test_ordinary_words_compete_with_the_lexicon():
    words = Counter({"halt": 900, "dog": 900, "shift": 2_000, "tosses": 3, "x": 1_000_000})
    d = abuse.Decoder(TRIGRAMS + Counter({"^^x": 1_000_000}), words)
    assert d.word("sh1ft") == "shift" and d.word("d*g") != "dig" and d.word("tosses") == "tosses" and d.word("1d10t") == "idiot" and d.word("b1tch") == "bitch" and d.word("iddiiiiot") == "idiot"


def test_weights_follow_reviews_but_keep_their_sense():
    s = abuse.Scorer(TRIGRAMS, WORDS)
    assert (abuse.fit(s, [], []) == abuse.PRIOR).all()
    got = abuse.fit(s, ["Ferme ta gueule", "The order is fine."] * 30, [0, 0] * 30)
    assert abuse.PRIOR[1 + [n for n, _, _ in abuse.FEATURES].index("dismissed")] > got[1 + [n for n, _, _ in abuse.FEATURES].index("dismissed")] > 0
