"""The filter audit and its tries against brute-force versions."""

import random
import re
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import filter_audit
from tideline.llm.common import saved
from tideline.llm.filter_audit import _front_coded, _spelled
from tideline.llm.radix_trie import RadixTrie, shared

SCHEMA = "doc_id bigint, text string, lang string, part string, mask int, slice bigint, first string"
LABELS = "doc_id bigint, quality int, toxic int, part string, mask int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

strings = st.lists(st.sampled_from([b"a", b"b", b"ab", b"\0", b"\xff", b"abc" * 5]), max_size=6).map(b"".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(strings, st.none() | st.integers(-5, 5)), max_size=25))
def test_trie_keeps_the_smallest_id(rows):
    trie, numbers, least = RadixTrie(), {}, {}
    for text, number in rows:
        assert trie.insert(text, number) == numbers.setdefault(text, len(numbers))
        if number is not None:
            least[text] = min(least.get(text, number), number)
    assert [(k, t, v) for k, t, v in trie.terminals()] == [(numbers[t], t, least.get(t)) for t in sorted(numbers)]
    assert trie.least() == [least.get(t) for t in numbers]


@settings(max_examples=300, deadline=None)
@given(strings, strings, st.lists(strings))
def test_shared_prefixes(a, b, many):
    n = shared(a, b)
    assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])
    assert _spelled(_front_coded(sorted(many))) == sorted(many)


def documents():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)] + ["ÄÖ", "naïve"]
    prose = lambda n, k=500: " ".join(rng.choice(words[:k]) for _ in range(n))
    head = prose(150)
    texts = [None, "", " \n", "ABC DEF", "A" * 9 + "é" * 81, "A" * 9 + "é" * 80, "price # 5", prose(99), prose(100), "x" * 400_000, prose(90_000)]
    texts += [prose(300, 80), prose(120).upper(), prose(200) + " $$"] * 3 + [head] * 150 + [f"{head} tail {k % 40}" for k in range(120)]
    texts += ["w1 " * 120, "a\x1cb " * 100, "same words " + prose(110)]
    rows = [(i - 20, t, rng.choice(["en", "de", None, ""]), "p", 3, 7, "f") for i, t in enumerate(texts)]
    rows += [rows[30], rows[30], (None, head, "en", "", 1, 1, ""), (None, "alone", "fr", "", 1, 1, ""), (200, "another text", "en", "", 0, 0, "")]
    rng.shuffle(rows)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1]), "x", 1) for i in range(-20, 200, 2)] + [(4, 1, 1, "x", 1), (4, 0, 0, "x", 1), (None, 1, 1, "x", 1)]
    return rows, labels


def brute_masks(rows):
    out = []
    for doc, text, lang, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        smaller = [r for r in rows if r[0] is not None and doc is not None and r[0] < doc and (r[1] or "") == text]
        fails = [
            len(words) < 100,
            100 * len(set(words)) < 80 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            bool(re.search(r"[#$%&*|]", text)),
            bool(smaller),
        ]
        out.append((doc, lang or "", "".join(x for x, f in zip("ABCDE", fails) if f)))
    return out


def brute_audit(masks, labels):
    good = {d for d, q, *_ in labels if d is not None and q == 1}
    bad = {d for d, _, t, *_ in labels if d is not None and t == 1}
    out, shapley = {}, {}
    for part in {p for _, p, _ in masks}:
        own = [(d, f) for d, p, f in masks if p == part]
        for order in map("".join, permutations("ABCDE")):
            left, gone = own, []
            for step, x in enumerate(order, 1):
                here = [(d, f) for d, f in left if x in f]
                redundant = sum(x in f for _, f in gone)
                left = [(d, f) for d, f in left if x not in f]
                gone = gone + here
                only = sum(f == x for _, f in own)
                out[part, order, step] = [len(left), len(here), redundant, only, sum(d in good for d, _ in here), sum(d in bad for d, _ in here)]
                shapley[part, x] = shapley.get((part, x), 0) + len(here)
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


@pytest.mark.parametrize("trie_bytes, range_bytes", [(2000, 3000), (32 << 20, 64 << 20), (1, 50_000)])
def test_audit_equals_brute_force(spark, trie_bytes, range_bytes, monkeypatch):
    rows, labels = documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    masks = saved(filter_audit.failed_masks(docs, docs["lang"], trie_bytes, range_bytes))
    expected = brute_masks(rows)
    spelled = lambda m: "".join(x for k, x in enumerate("ABCDE") if m >> k & 1)
    assert sorted(str((r.doc_id, r.part, spelled(r.mask))) for r in masks.collect()) == sorted(map(str, expected))
    got = filter_audit.audit(filter_audit.mask_counts(masks, spark.createDataFrame(labels, LABELS)))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == brute_audit(expected, labels)


def test_ranges_split_texts_that_begin_alike(spark):
    rows, _ = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    local = filter_audit.local_texts(docs, docs["lang"])
    starts = filter_audit.boundaries(local.where("mask is null"), 2000)
    assert starts == sorted(starts) and len(starts) > 3
    # A boundary inside the group that shares 150 words is longer than these.
    assert max(map(len, starts)) > 400
    assert filter_audit.boundaries(local.where("mask is null"), 1 << 30) == []


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    masks = filter_audit.failed_masks(docs, docs["lang"])
    assert filter_audit.audit(filter_audit.mask_counts(masks, spark.createDataFrame([], LABELS))).collect() == []
