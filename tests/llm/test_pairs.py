"""Near duplicates and names against brute force."""

import itertools
import random
import re
import time
from collections import Counter

import numpy as np

from webloom.llm import graphs, names, neardup

W = re.compile(r"[^\W_]+")


def brute(rows, run=3, least=500, similarity=0.6):
    sets = {}
    for i, t in rows:
        if t and len(t) >= least:
            w = W.findall(t.lower())
            sets[i] = (t, set(zip(*[w[k:] for k in range(run)])))
    out = set()
    for (i, (s, a)), (j, (t, b)) in itertools.combinations(sorted(sets.items()), 2):
        if s == t or (a and b and min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b)):
            out.add((i, j))
    return out


def test_pairs_match_brute_force(spark, sf):
    items = spark.read.parquet(f"{sf}/scraped_items.parquet")
    rows = [(r.id, r.content) for r in items.select("id", "content").collect()]
    got = [tuple(r) for r in neardup.similar_pairs(items).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_pairs_match_brute_force_larger(spark):
    """Recall over the pairs of sf0.01 is 1."""
    items = spark.read.parquet("/root/testdata/sf0.01/scraped_items.parquet")
    rows = [(r.id, r.content) for r in items.select("id", "content").collect()]
    assert {tuple(r) for r in neardup.similar_pairs(items).collect()} == brute(rows)


def test_short_texts_edits_and_edges(spark):
    word = lambda n: "".join(chr(97 + (n * 7 + k * n * n) % 26) for k in range(24)) + str(n)
    base = [word(n) for n in range(30)]
    edited = base[:14] + ["other"] + base[15:]
    long = " ".join(word(n) for n in range(100, 500))
    moved = " ".join([*(word(n) for n in range(300, 500)), *(word(n) for n in range(100, 300))])
    rows = [(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join(base[::-1])), (4, long), (5, moved), (6, long), (7, long.upper()), (8, None), (9, ""), (10, "x" * 600), (11, "x" * 600), (12, "- " * 400)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "id BIGINT, content STRING, class STRING")
    assert {tuple(r) for r in neardup.similar_pairs(df).collect()} == brute(rows)
    got = {r.id: (r.group_id, r.links) for r in neardup.groups(df).collect()}
    assert got[1] == (1, 1) and got[2] == (1, 1) and got[3] == (3, 0) and got[4][0] == got[7][0] == 4 and got[10][0] == got[11][0] == 10 and 8 not in got
    assert neardup.similar_pairs(df.limit(0)).count() == 0


GROUPS = [
    ["Rebecca Belildavan", "Becky Belildavan", "BELILDAVAN Rebecca", "Belildavan, R.", "By Rebecca Belildavan", "Rebecca  Belildavan", "Rebecca K. Belildvan", "r.belildavan", "Dr. Rebecca Belildávan", "Rebecca Belildavan, Senior Reporter"],
    ["Galonkadal Press Association", "Galonkadal Press Assoc.", "Press Association Galonkadal", "Galonkadal-Press Asociation", "Galonkadal PressAssociation", "Galonkadal Press Association Ltd", "Galonkadal Press Association / foreign desk"],
    ["Galonkadal Research Institute", "GALONKADAL RESEARCH INSTITUTE"],
    ["Agnes Halubiski", "Agnes Halubbiski", "A. Halubiski"],
    ["Lidia Halubiski", "Halubiski, Lidia"],
]


def test_names(spark):
    nobody = ["Staff", "", "  ", None, "La rédaction", "Agnes Halubiski & Rebecca Belildavan", "Agnes Halubiski, Rebecca Belildavan", "Newsroom"]
    data = [(n, "x") for g in GROUPS for n in g] + [(n, "x") for n in nobody] + [(GROUPS[0][0], "y")]
    df = spark.createDataFrame(data, "author STRING, entity STRING")
    want = {tuple(sorted(p)) for g in GROUPS for p in itertools.combinations(g, 2)}
    got = [tuple(r) for r in names.variant_pairs(df).collect()]
    assert set(got) == want and len(got) == len(want)
    assert names.variant_pairs(df.limit(0)).count() == 0


LONG = [
    ["Maria del Carmen Lopez Garcia Torres", "Maria del Carmen Lopez Garcia Tores", "Torres Garcia Lopez, Maria del Carmen"],
    ["International Union for Nature Water and Soil Research Institute", "International Union for Nature Water and Soil Reserch Institute", "International Union for Nature, Water, and Soil Research Institute"],
    ["John Smithers Browning", "Jonh Smtihers Browning", "Browning, John Smithers", "J. S. Browning"],
    ["Lununkalek Press Service", "Lununkalek PressS ervice", "Lununkalek Pres sService"],
    ["Ronald Reuel Tolkamien", "Tolkamien, R. R.", "Tolkamien, Ronald Reuel, Jr."],
]


def test_long_names_and_several_typos(spark):
    df = spark.createDataFrame([(n,) for g in LONG for n in g], "author STRING")
    got = {tuple(r) for r in names.variant_pairs(df).collect()}
    want = {tuple(sorted(p)) for g in LONG for p in itertools.combinations(g, 2)}
    assert got <= want and {p for p in want - got} <= {p for p in want if "Torres Garcia Lopez, Maria del Carmen" in p}


def test_assignment_is_the_best():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 5)
        table = [[rng.choice([0, 0.01, 1, 9, rng.random()]) for _ in range(n)] for _ in range(n)]
        assert abs(names.assignment(table) - min(sum(table[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))) < 1e-9


def test_components_of_a_long_chain(spark):
    order = list(range(3000))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])] + [(5000, 5001), (7, 7)], "a BIGINT, b BIGINT")
    nodes = spark.range(3001).selectExpr("id AS node", "id + 5 AS label")
    assert sorted(map(tuple, graphs.components(nodes, edges).groupBy("label").count().collect())) == [(5, 3000), (3005, 1)]
    assert graphs.components(nodes, edges.limit(0)).where("label <> node + 5").count() == 0


def test_ambiguous_initials_stay_apart(spark):
    df = spark.createDataFrame([("Daria Coremomin",), ("Dagny Coremomin",), ("D. Coremomin",)], "author STRING")
    assert names.variant_pairs(df).count() == 0


def edited_texts():
    rows = []
    for i, (n, every) in enumerate([(100, 12), (150, 12), (150, 13), (300, 14), (900, 13), (2500, 12), (130, 11), (60, 13)]):
        base = [f"word{i}x{k}" for k in range(n)]
        rows += [(10 * i, " ".join(base)), (10 * i + 1, " ".join("other" + w if k % every == every // 2 else w for k, w in enumerate(base)))]
        rows += [(10 * i + 2, " ".join(base[: int(0.62 * n)])), (10 * i + 3, " ".join(base + [f"more{i}x{k}" for k in range(int(0.6 * n))]))]
    return rows


def test_evenly_spread_edits(spark):
    """Similar texts without a common run of 12 words, of all sizes and mixed widths."""
    rows = edited_texts()
    df = spark.createDataFrame(rows, "id BIGINT, content STRING")
    want = brute(rows)
    assert (10, 11) in want and (30, 31) in want and (50, 51) in want
    assert {tuple(r) for r in neardup.similar_pairs(df).collect()} == want


def test_levels_and_parts_lose_nothing(spark, monkeypatch):
    """As many parts as large collections have, and every level of prefixes."""
    assert neardup.part_count(600_000) == 16 and neardup.part_count(33_000_000) == 6050
    rows = edited_texts()
    df = spark.createDataFrame(rows, "id BIGINT, content STRING")
    want = brute(rows)
    monkeypatch.setattr(neardup, "part_count", lambda texts: 60)
    for cost in (0.0, 1e9):
        monkeypatch.setattr(neardup, "CANDIDATE", cost)
        assert {tuple(r) for r in neardup.similar_pairs(df).collect()} == want


def shuffled(spark):
    """Bytes of the shuffle files that stand on the disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = [files.apply(k) for k in range(files.size())]
    return sum(f.length() for f in found if f.getName().startswith("shuffle_"))


def test_many_parts_are_joined_in_rounds(spark, sf, monkeypatch):
    """Copies of bitmaps for many parts do not stand on the disk at once, nor after the join."""
    items = spark.read.parquet(f"{sf}/scraped_items.parquet")
    rows = [(r.id, r.content) for r in items.select("id", "content").collect()]
    monkeypatch.setattr(neardup, "part_count", lambda texts: 400)
    before, sizes, at_once = shuffled(spark), [], neardup._in_parts

    def noted(rows, parts, join):
        row = rows.selectExpr("part", *(f"length({c}) AS {c}" for c in rows.columns[1:])).collect()
        sizes.append((sum(sum(r[1:]) for r in row), {r["part"] for r in row}))
        return at_once(rows, parts, join)

    monkeypatch.setattr(neardup, "_in_parts", noted)
    _, links = neardup.similar_classes(items)
    for _ in range(50):
        if shuffled(spark) - before < max(n for n, _ in sizes):
            break
        time.sleep(0.1)
    assert shuffled(spark) - before < max(n for n, _ in sizes)
    assert len(sizes) > 3 and max(n for n, _ in sizes) < 0.3 * sum(n for n, _ in sizes)
    assert all(max(p) < -(-400 // len(sizes)) for _, p in sizes)
    assert {tuple(r) for r in neardup.similar_pairs(items).collect()} == brute(rows)


def test_all_runs_are_counted(spark):
    """The order of runs counts every class, also what more than 255 of a task share."""
    texts = [f"the same three words {k} and{k} other{k}" for k in range(700)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts + texts[:50])], "id BIGINT, content STRING").coalesce(1)
    counts, classes = neardup.run_order(neardup.classes(df, "id", "content", 1), 3)
    want: Counter = Counter()
    for s in neardup._sets(*neardup.Hasher().words(texts), 3):
        want.update((s >> np.uint64(64 - neardup.COUNTER_BITS)).tolist())
    assert classes == 700 and max(want.values()) >= 700
    assert {int(k): int(counts[k]) for k in np.flatnonzero(counts)} == dict(want)
