"""Near duplicates and decontamination against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wardline.llm import decontaminate, neardup

from .test_texts_and_rules import EXTRA_SCHEMA, extra_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_groups(rows, threshold=0.8):
    """key -> (smallest key of the group, smallest key of equal texts, copies, links)."""
    words = {k: tuple(WORD.findall(t or "")) for k, t in rows}
    rep = {}
    for k in sorted(words):
        rep.setdefault(words[k], k)
    sets = {r: {w[i : i + 5] for i in range(len(w) - 4)} or {w} for w, r in rep.items() if w}
    held = defaultdict(list)
    for r, s in sets.items():
        for g in s:
            held[g].append(r)
    common = Counter()
    for own in held.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                common[min(a, b), max(a, b)] += 1
    parent = {r: r for r in rep.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for (a, b), c in common.items():
        if c >= threshold * (len(sets[a]) + len(sets[b]) - c):
            links[a] += 1
            links[b] += 1
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    copies = Counter(words.values())
    return {k: (find(rep[w]), rep[w], copies[w], links[rep[w]]) for k, w in words.items()}


def planted(seed=4):
    """Random texts, copies, a large group of near copies and chains of edits."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3_000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(60)] + ["", None, " ", "one two", "one two", "a b c d"]
    base = rng.choices(words, k=150)
    for _ in range(90):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    chain = rng.choices(words, k=200)
    for i in range(12):
        chain[i * 15] = rng.choice(words)
        texts.append(" ".join(chain))
    texts += [texts[3]] * 25
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("tile_rows,tile_grams", [(256, 2_000_000), (16, 2_000_000), (256, 3_000)])
def test_near_duplicates_equal_brute_force(spark, tile_rows, tile_grams):
    rows = planted()
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), options=neardup.JoinOptions(tile_rows=tile_rows, tile_grams=tile_grams))
    got = {r["doc_id"]: (r["class_id"], r["copy_id"], r["n_copies"], r["n_links"]) for r in found.collect()}
    assert got == brute_groups(rows)


def test_one_of_each_group_stays(spark):
    rows = planted(5)
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows] + [(0, rows[0][1], "x")], "doc_id long, text string, `odd.name` string")
    kept = neardup.keep_one(docs, neardup.near_duplicates(docs))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({g[0] for g in brute_groups(rows).values()})


def test_near_duplicates_of_odd_rows(spark):
    frame = spark.createDataFrame(extra_rows() * 2, EXTRA_SCHEMA)
    assert neardup.near_duplicates(frame).count() == 2 * len(extra_rows())
    kept = neardup.keep_one(frame, neardup.near_duplicates(frame))
    assert kept.count() == len({tuple(WORD.findall(r[1] or "")) for r in extra_rows()})
    assert neardup.near_duplicates(frame.limit(0)).count() == 0


def test_bands_reach_the_recall():
    options = neardup.JoinOptions()
    bands, rows = neardup.choose_bands(options)
    assert 1 - (1 - options.threshold**rows) ** bands >= options.recall and bands * rows <= options.most_hashes


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in neardup.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found.get(i, 0) == 0 for i in range(31)) and all(found[i] == 100 for i in range(101, 140))


QUESTION = "Then Alice has 12 apples and Bob walks 5 km to the old market with 12 friends today."
DOCS = [
    (1, "Intro text. Then Carol has 7 apples and Dave walks 9km to the old market with 7 friends today. More"),
    (2, "Then Carol has 7 apples and Dave walks 9 km to the old market with 8 friends today."),
    (3, "then alice has 12 apples and bob walks 5 km to the old market with 12 friends today"),
    (4, None), (5, "x Only, four words; HERE y"), (None, QUESTION), (7, "--- 5 %%%  ... a"), (8, ""), (9, "to the old market with nothing else at all in it"),
    (10, QUESTION + " " + QUESTION.replace("12", "30")),
]


@pytest.mark.parametrize("broadcast_rows", [1_000, 1])
def test_templates_find_other_parameters_and_reject_contradictions(spark, broadcast_rows):
    items = spark.createDataFrame([(1, QUESTION, "x"), (2, "", "x"), (3, None, "x"), (4, "only four words here", "x")], "item_id long, text string, doc_id string")
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    found = decontaminate.find_leaks(docs, items, decontaminate.DecontaminationOptions(broadcast_rows=broadcast_rows)).collect()
    assert {(r["doc_id"], r["item_id"]): r["altered"] for r in found} == {(1, 1): True, (3, 1): False, (None, 1): False, (5, 4): False, (10, 1): False}
    left = decontaminate.drop_leaks(docs, decontaminate.find_leaks(docs, items))
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 4, 7, 8, 9]


def test_leaks_equal_brute_force_over_the_tables(spark, folder):
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    clean = lambda t: [w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", w).lower() for w in t.split()) if w]
    windows = lambda t: [tuple(t[i : i + 8]) for i in range(len(t) - 7)]
    wanted = {r["item_id"]: windows(clean(r["text"])) for r in items.collect()}
    expected = set()
    for r in docs.collect():
        have = set(windows(clean(r["text"])))
        expected |= {(r["doc_id"], i) for i, own in wanted.items() if 2 * sum(w in have for w in own) >= len(own)}
    assert expected
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, items).collect()} == expected


def test_decontamination_of_odd_and_no_rows(spark):
    frame = spark.createDataFrame(extra_rows(), EXTRA_SCHEMA)
    items = spark.createDataFrame([(1, "la " * 20, 1)], "item_id long, text string, kept int")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(frame, items).collect()] == [(13, 1)]
    assert decontaminate.find_leaks(frame, items.limit(0)).count() == 0
    assert decontaminate.find_leaks(frame.limit(0), items).count() == 0
    assert decontaminate.drop_leaks(frame, decontaminate.find_leaks(frame, items)).count() == len(extra_rows()) - 1


def leaks_of(spark, texts, item):
    found = decontaminate.find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    return {r["doc_id"]: r for r in found.collect()}


def test_long_quotes_below_half_of_an_item_are_found(spark):
    words = [f"{a}{b}" for a in "qwrtpsdfghjklz" for b in "aeiouyäöüéèêàáí"][:200]
    quote = lambda n: "before it " + " ".join(words[40 : 40 + n]) + " after it"
    found = leaks_of(spark, [quote(60), quote(13), quote(12), "nothing of it at all"], " ".join(words))
    assert {k: (r["matched"], r["windows"]) for k, r in found.items()} == {0: (53, 193), 1: (6, 193)}


def test_a_contradicted_value_only_costs_its_own_windows(spark):
    words = [f"{a}{b}" for a in "qwrtpsdfghjklz" for b in "aeiouyäöüéè"][:150]
    words[30], words[110] = "12", "12"
    other = [*words[:30], "7", *words[31:]]
    row = leaks_of(spark, [" ".join(other)], " ".join(words))[0]
    assert (row["matched"], row["windows"], row["altered"]) == (135, 143, True)


def test_windows_that_cannot_match_with_placeholders_do_not_count(spark):
    numbers = lambda start: " ".join(str(start + 17 * i) for i in range(40))
    item = "what comes after the last of all these numbers here " + numbers(100) + " if they go on"
    row = leaks_of(spark, [item.replace(numbers(100), numbers(1_001)), "what comes after the last of all these other numbers " + numbers(5)], item)
    assert list(row) == [0] and row[0]["altered"] and row[0]["coverage"] == 1


def test_names_that_open_a_sentence_are_read_both_ways(spark):
    item = "Natalia sold clips to 48 of her friends in April. Natalia then sold half as many clips to others in May. How many clips did she sell?"
    renamed = lambda name, number, months: item.replace("Natalia", name).replace("48", number).replace("April", months[0]).replace("May", months[1])
    texts = [
        renamed("Carlos", "60", ("June", "July")), "As she told us, Carlos sold clips to 60 of her friends in June. Carlos then sold half as many clips to others in July.",
        renamed("Natalia", "48", ("April", "May")).lower(), "Natalia sold her house in May. How many friends did she then tell?",
    ]
    found = leaks_of(spark, texts, item)
    assert {k: r["altered"] for k, r in found.items()} == {0: True, 1: True, 2: False}


@pytest.mark.parametrize("window", [8, 3])
def test_anchors_lose_nothing(spark, folder, window):
    """Odd windows: numbers only, names only, openers only, words of several runs of letters, signs between words."""
    items = [
        (1, "1 2 3 4 5 6 7 8 9"), (2, "see New York Los Angeles San Diego Palo Alto Las Vegas now"), (3, "Go. Stop. Wait. Run. Sit. Stand. Turn. Look. Speak."),
        (4, "don't can't won't it's they're we've I'm you'd 5km a5b"), (5, "½ ⅓ ¼ ¾ ⅛ ½ ⅓ ¼ ¾"), (6, "mixed 1 Anna 2 Ben 3 km 4 day with few words"), (7, "tiny one"), (8, QUESTION),
    ]
    texts = [t for _, t in items] + [t.upper() for _, t in items] + [t.replace(" ", " -- ").replace("1", "77") for _, t in items] + [t.lower() for _, t in items] + ["", None, "nothing here"]
    docs = spark.createDataFrame([(i, None if t is None else f"before {t} after") for i, t in enumerate(texts)], "doc_id long, text string")
    docs = docs.unionByName(spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id") + 1_000, "text").toDF("doc_id", "text"))
    bench = spark.createDataFrame(items, "item_id long, text string").unionByName(spark.read.parquet(f"{folder}/benchmark.parquet").select(F.col("item_id") + 100, "text").toDF("item_id", "text"))
    rows = lambda anchors: sorted(decontaminate.find_leaks(docs, bench, decontaminate.DecontaminationOptions(window=window, anchors=anchors)).collect())
    every = rows(0)
    assert every and rows(50_000) == every


def test_window_hashes_are_made_once_and_slots_after_the_join(spark):
    frame = spark.createDataFrame([(1, "Anna paid 12 dollars for 3 apples. Then Bob sold 7 of them to Carl for 2 euros each"), (2, ""), (3, None)], "id long, text string")
    plan = decontaminate.every_window(frame, [8])._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("zip_with(") <= 9  # three lengths of three readings
    items = frame.select(F.col("id").alias("item_id"), "text")
    leaks = decontaminate.find_leaks(frame.withColumnRenamed("id", "doc_id"), items)
    assert [(r["doc_id"], r["item_id"], r["coverage"]) for r in leaks.collect()] == [(1, 1, 1.0)]
    steps = leaks._jdf.queryExecution().optimizedPlan().toString().splitlines()
    slots = max(i for i, line in enumerate(steps) if "array_join(filter(slice(" in line)
    assert any("Join Inner" in line and "hash" in line for line in steps[slots:])
