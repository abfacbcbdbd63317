"""Edges between datasets and classes of columns against plain loops."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from deskflume.functions import columns, values
from deskflume.operators import catalog, edges, records


def plain_signature(items, salt):
    mask, out = 2**32 - 1, []
    for i in range(128):
        a, b, c, d = (int.from_bytes(hashlib.sha256(f"perm:{i}".encode()).digest()[k : k + 4], "big") for k in (0, 4, 8, 12))
        best = mask
        for v in items:
            digest = hashlib.sha256(f"{salt}\0{v}".encode()).digest()
            x = (int.from_bytes(digest[:4], "big") * (a | 1) + int.from_bytes(digest[4:8], "big") * (b | 1) + c) & mask
            x = ((x ^ x >> 16) * 0x85EBCA6B) & mask
            x = ((x ^ x >> 13) * 0xC2B2AE35) & mask
            best = min(best, ((x ^ x >> 16) + d) & mask)
        out.append(best)
    return out


def test_signatures_and_error(spark):
    sets = {"a": range(0, 300), "b": range(100, 400), "c": range(0, 300), "d": range(900, 1000)}
    rows = [(k, "f", str(v)) for k, s in sets.items() for v in s] * 2
    sigs = edges.signatures(spark.createDataFrame(rows, "dataset string, field string, value string"), "s")
    got = {r.dataset: r for r in sigs.collect()}
    assert got["a"].n == 300 and list(got["d"].sig) == plain_signature([str(v) for v in sets["d"]], "s")
    estimate = {(r.a, r.b): r.jaccard for r in edges.containments(spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d")], "a string, b string"), sigs).collect()}
    assert estimate["a", "c"] == 1 and estimate["a", "d"] == 0
    assert ("a", "c") in {(r.a, r.b) for r in edges.candidates(edges.bands(sigs)).collect()}


def test_error_of_many_pairs(spark):
    """The mean error of estimates stays under 0.05."""
    rows = [(f"{k}{side}", "f", f"{k}-{v}") for k in range(20) for side, s in (("x", range(0, 100)), ("y", range(10 * (k % 10), 100 + 10 * (k % 10)))) for v in s]
    sigs = edges.signatures(spark.createDataFrame(rows, "dataset string, field string, value string"), "s")
    pairs = spark.createDataFrame([(f"{k}x", f"{k}y") for k in range(20)], "a string, b string")
    errors = [abs(r.jaccard - (100 - 10 * (int(r.a[:-1]) % 10)) / (100 + 10 * (int(r.a[:-1]) % 10))) for r in edges.containments(pairs, sigs).collect()]
    assert len(errors) == 20 and sum(errors) / 20 < 0.05


def test_empty_values(spark):
    none = spark.createDataFrame([], "dataset string, field string, value string")
    sigs = edges.signatures(none, "s")
    assert sigs.count() == 0 and edges.value_edges(edges.containments(edges.candidates(edges.bands(sigs)), sigs), sigs).count() == 0
    nulls = spark.createDataFrame([(None, "x"), ("d", None)], "k string, v string")
    assert edges.field_values(nulls, F.col("k"), v=F.col("v")).count() == 0


def plain_jaro_winkler(a, b):
    a, b = a.lower(), b.lower()
    if a == b:
        return 1.0
    reach, used, left = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, c in enumerate(a):
        for j in range(max(i - reach, 0), min(i + reach + 1, len(b))):
            if j not in used and b[j] == c:
                used.add(j)
                left.append(c)
                break
    if not left:
        return 0.0
    m, moved = len(left), sum(x != b[j] for x, j in zip(left, sorted(used))) / 2
    base = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((n for n in range(4) if a[n : n + 1] != b[n : n + 1] or n >= min(len(a), len(b))), 4)
    return base if base < 0.7 else base + prefix * 0.1 * (1 - base)


def test_name_edges_lose_none(spark):
    names = ["orders", "order", "orders_old", "Orders", "customer", "customers", "costumer", "martha", "marhta", "dwayne", "duane", "a", "ab", "", "zzzz", "invoice lines", "invoice line", "lines invoice"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "dataset long, name string")
    got = {(r.a, r.b): r.weight for r in edges.name_edges(df).collect()}
    want = {(i, j): 0.35 * w for (i, a), (j, b) in itertools.combinations(enumerate(names), 2) if a and b and (w := plain_jaro_winkler(a, b)) >= 0.9}
    assert got == pytest.approx(want) and len(want) > 5


def test_span_edges(spark):
    rows = [("a", "2000-01-01", "2003-01-01"), ("b", "2001-01-01", "2003-01-01"), ("c", "2005-01-01", "2006-01-01"), ("d", None, "2006-01-01"), ("e", "2000-06-01", "2000-01-01")]
    df = spark.createDataFrame(rows, "dataset string, since string, until string").select("dataset", *[F.col(c).cast("timestamp").alias(c) for c in ("since", "until")])
    got = {(r.a, r.b): r.weight for r in edges.span_edges(df).where("weight > 0").collect()}
    assert got == pytest.approx({("a", "b"): 0.2 * 730 / 1096}, abs=1e-6)


def test_sharing_two(spark):
    sets = {1: "abc", 2: "bcd", 3: "abc", 4: "xyz", 5: "ay", 6: "abcd", 7: ""}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id long, tokens array<string>")
    got = {(r.a, r.b): r.common for r in catalog.sharing_two(df, lambda n: n / 10).collect()}
    reps = {k: v for k, v in sets.items() if k != 3}
    assert got == {(i, j): n for i, j in itertools.combinations(reps, 2) if (n := len(set(reps[i]) & set(reps[j]))) >= 2}
    assert {(r.id, r["class"]) for r in catalog.classes(df).collect()} == {(k, 1 if k == 3 else k) for k in sets}


def test_classes_of_columns(spark):
    rows = [(f"u{i}@example.org", f"{4000000000000000 + i}", "x" * 50 + str(i), "OPEN" if i % 2 else "CLOSED", float(i), None) for i in range(30)]
    df = spark.createDataFrame(rows, "contact_email string, card string, notes string, status string, net_pay double, nothing string")
    got = {r.name: (r.type, r.confidence, r.shown) for r in columns.classified(columns.column_rates(columns.cells(df))).collect()}
    assert got == {"contact_email": ("EMAIL", 0.95, False), "card": ("CARD", 0.95, False), "notes": ("FREE_TEXT", 0.7, False), "status": ("ENUM", 0.65, True), "net_pay": ("COMPENSATION", 0.95, False)}


def test_whole_refuses(spark):
    df = spark.range(3)
    assert records.whole(df, 3).count() == 3
    for rows, most in ((df, 2), (df.where("id < 0"), 9)):
        with pytest.raises(ValueError):
            records.whole(rows, most)


def test_strings_only(spark):
    df = spark.createDataFrame([('["a", 1, "b", null]',), ("{}",), ("no",), (None,), ("[]",)], "t string")
    assert [r[0] for r in df.select(values.strings_only(F.col("t"))).collect()] == [["a", "b"], [], [], [], []]


def test_sharing_two_deals_out_frequent_pairs(spark, monkeypatch):
    monkeypatch.setattr(catalog, "POSTED", 4)
    sets = {k: sorted({"a", "b", f"c{k % 3}", f"d{k % 5}", f"e{k}"}) for k in range(40)}
    found = catalog.sharing_two(spark.createDataFrame(list(sets.items()), "id long, tokens array<string>"), lambda n: n / 10)
    got = [(r.a, r.b, r.common) for r in found.collect()]
    assert sorted(got) == [(i, j, len(set(sets[i]) & set(sets[j]))) for i, j in itertools.combinations(sets, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "part#" in plan and plan.count("array_intersect(") == 1  # in parts, and counted once


def test_parts_do_not_grow_with_the_input(spark):
    """What is sent for frequent tokens, their count times their parts, doubles where the counts do."""
    counts = [5000, 40000, 90000, 100000]
    sent = []
    for times in (1, 2, 16):
        frequent = spark.createDataFrame([(i, n * times) for i, n in enumerate(counts)], "x long, count long")
        found = catalog.token_parts(frequent, 16).join(frequent, "x").collect()
        sent.append(sum(r["count"] * r.parts for r in found) / times)
    assert len(set(sent)) == 1 and 0 < sent[0] <= sum(counts) * 4  # the root of the tasks


def test_sharing_two_posts_a_set_under_all_tokens_but_one(spark, monkeypatch):
    monkeypatch.setattr(catalog, "POSTED", 1)
    draw = random.Random(4)
    sets = {k: sorted(draw.sample("abcdefghijklmnop", 8)) for k in range(60)} | {60: ["a", "b"], 61: ["a"], None: ["a", "b", "c"]}
    df = spark.createDataFrame(list(sets.items()), "id long, tokens array<string>")
    seen, inline = [], catalog.F.inline
    monkeypatch.setattr(catalog.F, "inline", lambda c: seen.append(c) or inline(c))
    found = catalog.sharing_two(df, lambda n: n / 10)
    first = {}
    for k, v in sets.items():
        if k is not None:
            first.setdefault(tuple(v), k)
    want = [(i, j, n) for (s, i), (t, j) in itertools.combinations(first.items(), 2) if (n := len(set(s) & set(t))) >= 2]
    assert sorted((r.a, r.b, r.common) for r in found.collect()) == sorted(want)
    posted = spark.createDataFrame([(list(range(8)),)], "ts array<long>").select(inline(seen[0])).collect()
    assert [r.x for r in posted] == list(range(7)) and all(len(r.before) + len(r.behind) == 7 for r in posted)


def test_sharing_two_with_frequent_and_rare_tokens(spark):
    """Frequent tokens are counted by bits, the others by their numbers; sets share some of both."""
    draw = random.Random(5)
    sets = {k: sorted({*(f"f{draw.randrange(120):03}" for _ in range(5)), *(f"r{draw.randrange(90):03}" for _ in range(5))}) for k in range(400)}
    found = catalog.sharing_two(spark.createDataFrame(list(sets.items()), "id long, tokens array<string>"), lambda n: n / 10)
    want = [(i, j, n) for i, j in itertools.combinations(sets, 2) if (n := len(set(sets[i]) & set(sets[j]))) >= 2]
    assert sorted((r.a, r.b, r.common) for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bit_count(") == 2 and plan.count("array_intersect(") == 1
