"""The corpus operators against brute-force versions on small tables with every awkward case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from tideline.llm import (
    bpe,
    exact_dedup,
    license_scan,
    line_dedup,
    mixing,
    ngram_join,
    quality_rules,
    registry,
    secret_scan,
    substring_dedup,
)
from tideline.llm.common import saved
from tideline.llm.components import components
from tideline.llm.perfect_hash import PerfectHash
from tideline.llm.quotient_filter import CountingQuotientFilter

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, row bigint, label string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def corpus():
    """Copies, near copies, shared passages and lines, nulls, empties, ties, a very long text, and foreign white space."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["Über", "naïve", "x y", "İstanbul"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = prose(60), "a common line of text " + prose(4)
    texts = [None, "", " \n\t ", "one", "one two three four", "one two three four", "One TWO three four"]
    for _ in range(6):
        base = prose(120)
        texts += [base, base, base.upper() if base.isascii() else base]
        for edits in (1, 2, 5, 30):
            words = base.split(" ")
            for _ in range(edits):
                words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    for k in range(8):
        texts.append(prose(20 + k) + " " + passage + "\n" + line + "\n  " + line.upper() + " \n" + prose(15))
    texts += [line, f"{line}\n{line}", "a b c " * 200, "### $$$ " * 80, "x" * 3000, prose(4000), "tail 123\r\nnext\x0bline\x1cend"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src7", "x", None]), 1, True, 9, "z") for i, t in enumerate(texts)]
    rows += [rows[9], rows[-3], (3, "another text under a used id " + passage, "en", "src0", 1, False, 1, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return saved(spark.createDataFrame(rows, SCHEMA).repartition(5))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def test_exact_dedup(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r[1] or "")].append(r[0])
    for bits in (64, 3):  # few bits force clashes that byte verification must undo
        got = exact_dedup.exact_dedup(docs, bits).drop("fp").collect()
        assert len(got) == len(rows)
        expected = Counter((i, max(ids), len(ids), sha(t)) for t, ids in groups.items() for i in ids)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
        kept = Counter(r.text_sha256 for r in got if r.kept)
        assert kept == Counter(sha(t) for t in groups)
    left = exact_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    assert Counter(lowered(r.text or "") for r in left.collect()) == Counter(groups.keys())


def test_null_ids_in_exact_dedup(spark):
    df = spark.createDataFrame([(None, "a"), (None, "A"), (4, "a"), (None, "b")], "doc_id bigint, text string")
    got = exact_dedup.exact_dedup(df).collect()
    assert sorted((r.keep_id is None, r.group_size, r.kept) for r in got) == [
        (False, 3, False), (False, 3, False), (False, 3, True), (True, 1, True)
    ]


def test_quotient_filter():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    values[:300] = values[0]
    values = np.r_[values, np.uint64([0, 2**64 - 1, 2**64 - 1])]
    parts = [CountingQuotientFilter.of(p) for p in np.array_split(values, 7)]
    whole = CountingQuotientFilter.from_bytes(parts[0].merged(*parts[1:]).to_bytes())
    found, counts = whole.items()
    expected, n = np.unique(values, return_counts=True)
    assert (found == expected).all() and (counts == n).all()
    big = CountingQuotientFilter.of(np.uint64([7, 9]), np.uint64([1 << 62, 3]))
    assert CountingQuotientFilter.from_bytes(big.to_bytes()).items()[1].tolist() == [1 << 62, 3]
    assert CountingQuotientFilter.of(np.uint64([])).items()[0].size == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(4).integers(0, 2**64, 3000, dtype=np.uint64))
    index = PerfectHash.from_bytes(PerfectHash.of(keys).to_bytes())
    assert sorted(index.numbers(keys)) == list(range(len(keys)))
    assert (index.numbers(keys + np.uint64(1)) < len(keys)).all()
    assert PerfectHash.of(np.uint64([])).numbers(keys[:3]).tolist() == [-1] * 3


def shingles(text):
    words = WORD.findall(lowered(text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def smallest_reachable(ids, sets):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        same = len(sets[i] & sets[j])
        if same and 100 * same >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, doc in enumerate(ids):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return [least[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("frequent", [65_536, 10, 1])
def test_ngram_join(docs, rows, frequent):
    sets = [shingles(r[1]) for r in rows]
    ids = [r[0] for r in rows]
    expected = Counter(zip(ids, map(len, sets), smallest_reachable(ids, sets)))
    got = ngram_join.linked_components(docs, frequent)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == expected


def test_family_of_near_copies(spark):
    """Chains and stars of near copies, where links are not transitive."""
    rng = random.Random(11)
    words = [f"v{i}" for i in range(100)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        words = list(words)
        words[rng.randrange(100)] = f"n{i}"
        if i % 20 == 19:
            words = [f"z{i}_{j}" for j in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in ngram_join.linked_components(df).collect()}
    expected = smallest_reachable([r[0] for r in rows], [shingles(r[1]) for r in rows])
    assert [got[i] for i in range(60)] == expected
    assert ngram_join.representatives(df).count() == len(set(expected))


def test_links_across_components(spark):
    """Families around a common passage, of sizes at the limits, where the groups of a shingle lie in many components."""
    rng = random.Random(23)
    passage, texts = [f"p{i}" for i in range(40)], []
    for family in range(6):
        base = [f"f{family}_{i}" for i in range(rng.choice([10, 60, 90]))]
        for _ in range(25):
            words = base + passage if rng.random() < 0.7 else passage + base
            for _ in range(rng.choice([0, 1, 2, 3, 4])):
                words[rng.randrange(len(words))] = f"e{rng.randrange(40)}"
            texts.append(" ".join(words + [f"t{rng.randrange(9)}" for _ in range(rng.randrange(25))]))
    texts += [" ".join(f"s{i}" for i in range(n)) for n in (5, 6, 8, 9, 14, 24, 28, 29, 34, 40, 41, 49, 104, 129, 130)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    expected = smallest_reachable([r[0] for r in rows], [shingles(t) for t in texts])
    assert len(set(expected)) > 20
    for frequent in (65_536, 3):
        got = {r.doc_id: r.component_id for r in ngram_join.linked_components(df, frequent).collect()}
        assert [got[i] for i in range(len(rows))] == expected


def test_representatives_of_shared_ids(spark):
    """A near copy does not take along other texts under its id."""
    prose = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [
        (1, prose("a")), (3, prose("a") + " end"), (3, prose("b")), (5, prose("b") + " end"), (3, prose("b") + " more"),
        (4, ""), (4, None), (6, prose("c")), (None, prose("a")),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = Counter(tuple(r) for r in ngram_join.representatives(df).collect())
    twins = [r for r in kept if r[0] == 3]
    assert len(twins) == 1 and twins[0] in (rows[2], rows[4])
    assert kept == Counter([rows[0], twins[0], *rows[5:]])


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, rng.randrange(101, 160)) for _ in range(50)] + [(200, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(41)} == {0}
    assert {v for k, v in got.items() if k >= 100} == {100}


def test_substrings(docs, rows):
    words = [WORD.findall(r[1] or "") for r in rows]
    first = {}
    for r, w in zip(rows, words):
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            first[key] = min(r[0], first.get(key, r[0]))
    expected = Counter()
    for r, w in zip(rows, words):
        gone = {i + k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < r[0] for k in range(13)}
        expected[(r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    for most in (4_000_000, 300, 3):  # small groups force long prefixes and the path for frequent windows
        got = substring_dedup.without_repeats(docs, most=most)
        assert Counter(map(tuple, got.collect())) == expected


def test_lines(docs, rows):
    key = lambda line: lowered(line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            held[key(line)].add(r[0])
    gone = lambda doc, line: len(key(line)) >= 20 and len(held[key(line)]) >= 3 and max(held[key(line)]) != doc
    expected = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        left = [x for x in lines if not gone(r[0], x)]
        expected[(r[0], len(lines), len(lines) - len(left), "\n".join(left))] += 1
    for size in (500_000, 2):
        assert Counter(map(tuple, line_dedup.deduplicated_lines(docs, size).collect())) == expected


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path(registry.TOKENIZER))


def test_bpe(docs, rows, ranks):
    official = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    got = Counter((r.doc_id, tuple(r.ids)) for r in ids.collect())
    assert got == Counter((r[0], tuple(official.encode_ordinary(r[1] or ""))) for r in rows)
    back = ids.select("doc_id", bpe.decoded(ids["ids"], ranks).alias("b"))
    assert Counter((r.doc_id, bytes(r.b)) for r in back.collect()) == Counter((r[0], (r[1] or "").encode()) for r in rows)


def test_rank_map():
    pieces = [b"a", b"b", b"c", b"ab", b"bc", b"abc", b"aa", b"cab"]
    ranks = {piece: rank for rank, piece in enumerate(pieces)}
    size = bpe.edge(ranks) + 1
    starts, cells = bpe.packed(bpe.pair_rows(ranks), size)
    for a in range(size):
        for b in range(size):
            joined = (pieces + [b"?"])[a] + (pieces + [b"?"])[b]
            found = cells[starts[a] + b] ^ (a << bpe.BITS)
            assert found == ranks[joined] if joined in ranks else found >= 1 << bpe.BITS
    assert len(bpe.packed({}, 1)[0]) == 1


def test_pairs_that_are_reached(ranks):
    pieces = [b"a", b"b", b"c", b"ab", b"bc", b"abc", b"aa", b"cab"]
    own = {piece: rank for rank, piece in enumerate(pieces)}
    assert bpe.reached(own) == {0: {1: 3, 0: 6}, 1: {2: 4}, 3: {2: 5}, 2: {3: 7}}
    assert bpe.reached({}) == {}
    every = bpe.pair_rows(ranks)
    assert all(every[a][b] == rank for a, row in bpe.reached(ranks).items() for b, rank in row.items())


def test_pieces_in_shards(spark, docs, rows, ranks):
    cut = saved(bpe.cut_pieces(docs, ranks, public_tokenizers.PATTERN))
    find = regex.compile(public_tokenizers.PATTERN).findall
    unknown = {p for r in rows for p in find(r[1] or "") if p.encode() not in ranks}
    for shards in (1, 8):
        got = bpe.split_pieces(cut, shards).collect()
        assert len({(r.slice, r.shard) for r in got}) == len(got) and all(0 <= r.shard < shards for r in got)
        assert {p.decode() for r in got for p in bpe._items(r.pieces)} == unknown
        for c in cut.collect():
            mine = sorted((r for r in got if r.slice == c.slice), key=lambda r: r.shard)
            assert [p for r in mine for p in bpe._items(r.pieces)] == bpe._items(c.pieces)


def test_pieces_are_merged(spark, ranks):
    official = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    words = ["".join(rng.choice("aeinst qzéü漢0\n") for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    words += ["a" * n for n in (2, 3, 4, 5, 31, bpe.LONG, bpe.LONG + 1)]
    words = [w for w in words if w.encode() not in ranks]
    got = bpe.merged_pieces(spark.createDataFrame([(3, i, w.encode()) for i, w in enumerate(words)], "shard int, i int, piece binary"), ranks).collect()
    assert sorted(r.i for r in got) == list(range(len(words))) and {r.shard for r in got} == {3}
    assert {words[r.i]: r.ids for r in got} == {w: official.encode_ordinary(w) for w in words}


def test_decoding_in_levels(spark, ranks):
    names = {rank: piece for piece, rank in ranks.items()}
    rng, values = random.Random(6), list(ranks.values())
    lists = [[rng.choice(values) for _ in range(n)] for n in (0, 1, 63, 64, 65, 4096, 4097, 300_000)]
    df = spark.createDataFrame([(i, ids) for i, ids in enumerate(lists)], "i int, ids array<int>")
    got = df.select("i", bpe.decoded(df["ids"], ranks).alias("b")).collect()
    assert {r.i: bytes(r.b) for r in got} == {i: b"".join(names[x] for x in ids) for i, ids in enumerate(lists)}
    with pytest.raises(Exception, match="id without a piece"):
        spark.createDataFrame([([99_999_999],)], "ids array<int>").select(bpe.decoded(F.col("ids"), ranks)).collect()


def test_bpe_digests(docs, rows, ranks):
    official = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def digest(text):
        ids = official.encode_ordinary(text)
        return len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registry.bpe_digests(docs).collect())
    assert got == Counter((r[0], *digest(r[1] or "")) for r in rows)


def test_pieces_travel_once(docs, ranks):
    """After the pieces are made distinct, only numbers and ids move: neither pieces nor texts go through Python again."""
    ids = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    plan = ids._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "\nMapInArrow" not in plan and " MapInArrow" not in plan
    for r in ids.collect():
        assert np.frombuffer(r.data, "<u4").tolist() == r.ids
    digests = registry.bpe_digests(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert " MapInArrow" not in digests and not digests.startswith("MapInArrow")


def test_text_of_the_rank_map(spark, ranks):
    """Every description of the plan holds the map's text on the driver: 1.3 MB, where empty cells took 1.2 MB more."""
    rows = bpe.merged_pieces(spark.createDataFrame([(0, 0, b"abc")], "shard int, i int, piece binary"), ranks)
    assert len(rows._jdf.queryExecution().executedPlan().toString()) < 1_500_000


def test_plans_without_constants(spark, docs, ranks):
    """Neither the rank map nor the pieces of all ids are in a plan's text; each is read once, not copied to rows."""
    rows = bpe.merged_pieces(spark.createDataFrame([(0, 0, b"abc")], "shard int, i int, piece binary"), ranks)
    for df, constants in ((rows, ("_starts", "_cells")), (registry.bpe_digests(docs), ("_names",))):
        execution = df._jdf.queryExecution()
        assert len(execution.executedPlan().toString()) < 30_000
        body = execution.optimizedPlan().toString()
        assert body.count("scalar-subquery") == len(constants) and not any(f" AS {c}#" in body for c in constants)


def test_decoding_of_no_piece(spark, ranks):
    """An id above the last one, also the one that fills up inside, raises; null stays null; no id is no byte."""
    column = lambda ids: bpe.decoded(ids, ranks).alias("b")
    frame = lambda rows: spark.createDataFrame(rows, "ids array<int>")
    assert [r.b for r in frame([(None,), ([],)]).select(column(F.col("ids"))).collect()] == [None, b""]
    for ids in ([bpe.edge(ranks)], [-1], [5, None]):
        with pytest.raises(Exception, match="id without a piece"):
            frame([(ids,)]).select(column(F.col("ids"))).collect()


def test_pieces_without_a_merge(spark, ranks):
    """One part, no part and no piece; further columns come along."""
    rows = [(0, 0, b"a", 7), (0, 1, b"", 8), (0, 2, None, 9), (0, 3, b"\x00\xff\x00", 1)]
    got = bpe.merged_pieces(spark.createDataFrame(rows, "shard int, i int, piece binary, more bigint"), ranks).collect()
    official = [[ranks[b"a"]], [], [], bpe.merged(b"\x00\xff\x00", ranks)]
    assert {(r.i, r.more): r.ids for r in got} == {(r[1], r[3]): x for r, x in zip(rows, official)}


def test_byte_parts(ranks):
    edge = bpe.edge(ranks)
    unknown = "zqzqx".encode()
    own = next(iter(ranks))
    assert unknown not in ranks
    parts = bpe.byte_parts([unknown, b"x" * (bpe.LONG + 1), own, unknown], ranks).to_pylist()
    spelled = [edge, *(ranks[bytes([x])] for x in unknown), edge]
    assert parts == [spelled, None, [edge, ranks[own], edge], spelled]
    assert bpe.byte_parts([], ranks).to_pylist() == []


def test_heap_merges(ranks):
    official = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    for n in (1, 2, 3, 50, 700):
        for alphabet in ("ab", "etaoin ", "aé漢 \n0"):
            piece = "".join(rng.choice(alphabet) for _ in range(n))
            assert bpe.merged(piece.encode(), ranks) == official.encode_ordinary(piece)


def test_quality_rules(docs, rows):
    expected = Counter()
    for r in rows:
        text = r[1] or ""
        words = WORD.findall(text)
        seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeat = len({i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)})
        lines = [x for x in text.split("\n") if WORD.search(x)]
        chars, symbols = sum(map(len, words)), sum(c in "#*$%&|<>" for c in text)
        dup = len(lines) - len(set(lines))
        n = len(words)
        base = n < 50 or 100 * repeat > 50 * n
        more = 100 * symbols > 30 * n or 100 * dup > 30 * len(lines) or not 20 * n <= 10 * chars <= 150 * n
        expected[(r[0], n, chars, symbols, dup, repeat, base, not (base or more))] += 1
    for rules in (None, quality_rules.RULES, quality_rules.RULES[::-1]):
        assert Counter(map(tuple, quality_rules.judged(docs, rules).collect())) == expected
        left = quality_rules.passed(docs, rules)
        assert left.columns == docs.columns
        assert left.count() == sum(n for key, n in expected.items() if key[-1])


def test_mixing(docs, rows):
    for mix in (registry.MIX, mixing.Mix(budget_percent=50, max_epochs=1, seed=3)):
        got = mixing.assigned(docs, registry.mix_path(docs), mix).collect()
        assert len(got) == len(rows)
        size, taken = defaultdict(int), defaultdict(int)
        for r in got:
            size[r["_d0"], r["_d1"], r["_d2"]] += r.n_tokens
            taken[r["_d0"], r["_d1"], r["_d2"]] += r.n_tokens * r["_epochs"]
        budget = sum(size.values()) * mix.budget_percent // 100
        expected = filled_tree(size, budget, mix)
        longest = max(r.n_tokens for r in got)
        for leaf, quota in expected.items():
            assert quota - longest < taken[leaf] <= quota
        assert mixing.mixed(docs, registry.mix_path(docs), mix).columns == docs.columns


def test_mixing_spends_the_quota(spark):
    """A document longer than what is left gives its first tokens."""
    rng = random.Random(3)
    rows = [(i, "\n ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([3, 40, 900]))) + " ", "en", f"src{i % 7}", 1) for i in range(60)]
    rows += [(100, "lead  in\tand more of it " * 500, "de", "src8", 1), (101, "a b c d e f g", "fr", "src9", 1)]
    rows += [(None, f"{'no id ' * 30}{k}", "es", "src2", 1) for k in range(9)]
    rows += [(200, "twice the same row " * 9, "es", "src1", 1)] * 2
    docs = saved(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    for mix in (registry.MIX, mixing.Mix(budget_percent=50, max_epochs=1, seed=3), mixing.Mix(budget_percent=30, max_epochs=2)):
        size, given, drawn = defaultdict(int), defaultdict(int), Counter()
        for r in mixing.assigned(docs, registry.mix_path(docs), mix).collect():
            leaf = r["_d0"], r["_d1"], r["_d2"]
            size[leaf] += r.n_tokens
            given[leaf] += r.n_tokens * r["_whole"] + r["_part"]
            assert 0 <= r["_part"] <= r.n_tokens
        for leaf, quota in filled_tree(size, sum(size.values()) * mix.budget_percent // 100, mix).items():
            assert quota - given[leaf] in ((0, 1) if leaf[1:] == ("es", "src1") else (0,))
        texts = defaultdict(set)
        for r in rows:
            texts[r[0]].add(r[1])
        for r in mixing.mixed(docs, registry.mix_path(docs), mix).collect():
            drawn[r.lang, r.source] += len(WORD.findall(r.text))
            if r.text not in texts[r.doc_id]:
                assert any(t.startswith(r.text) for t in texts[r.doc_id]) and r.n_chars == len(r.text)
        assert drawn == Counter({leaf[1:]: n for leaf, n in given.items()})


def filled_tree(size, budget, mix):
    """Water filling by repeated rounds: what full children leave goes to their siblings."""

    def fill(prefix, amount):
        depth = len(prefix)
        if depth == 3:
            return {prefix: amount}
        names = sorted({leaf[depth] for leaf in size if leaf[:depth] == prefix})
        cap = {n: mix.max_epochs * sum(v for k, v in size.items() if k[: depth + 1] == (*prefix, n)) for n in names}
        weight = {n: mix.weights[depth].get(n, 1) for n in names}
        open_, given, left = set(names), {}, amount
        while open_:
            total = sum(weight[n] for n in open_)
            full = {n for n in open_ if cap[n] * total <= weight[n] * left}
            if not full:
                given |= {n: left * weight[n] // total for n in open_}
                break
            first = min(full, key=lambda n: cap[n] / weight[n])
            given[first] = cap[first]
            left -= cap[first]
            open_.discard(first)
        return {k: v for n in names for k, v in fill((*prefix, n), given[n]).items()}

    return fill((), budget)


def token_with_checksum(prefix):
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    return f"{prefix}{body}{secret_scan.base62(zlib.crc32(body.encode()), 6)}"


def test_secret_scan(spark):
    good = token_with_checksum("ghp_")
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    texts = [
        None, "", "password = 'abc123'", "PassWord:\"x\" token=short", "tokentoken=abcdef1 token==abcdefg",
        "apikey=KEY123456 api_key : 'zzzzzz' API-key=nothing", f"ü é {good} {bad} {token_with_checksum('npm_')}x",
        f"漢字 secret={good}", "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 14 + " akia" + "A" * 20, "0123456789abcdef" * 3,
        "f" * 23 + " " + "f" * 24 + "g" + "0" * 30, "passwd=secret=token=abcdefgh", "ſecret=abcdefgh toKen=abcdefgh",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    base = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    for r in secret_scan.scan(df).collect():
        text = texts[r.doc_id] or ""
        spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(base) for m in p.finditer(text) if ok(m))
        found = [(s.start, s.kind, s.end) for s in r.found]
        assert [x for x in found if x[1] in secret_scan.BASE] == [(a, base[k][0], b) for a, k, b in spans]
        forge = [text[a:b] for a, k, b in found if k == "forge"]
        assert forge == ([good] if good in text else [])
        assert not any(k == "package" for _, k, _ in found)


def test_license_scan(spark):
    texts = [
        None, "", "Released under the MIT License.", "x\n  released UNDER the mit-license\nAll rights reserved",
        "This work is licensed under the GNU General Public License, version 2.",
        "This work is licensed under the GNU Lesser General Public License, version 3", "all all all rights rights reserved",
        "prose " * 400, "Released under the MIT License. And much more that follows it on the line, so it is no statement.",
    ]

    def dice(block, template):
        def pairs(t):
            w = re.findall("[0-9a-z]+", re.sub("[^0-9A-Za-z]", " ", t).lower())
            return Counter(zip(w, w[1:]))

        a, b = pairs(block), pairs(template)
        return 200 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in license_scan.scan(df).collect():
        expected = []
        for at, line in enumerate((texts[r.doc_id] or "").split("\n"), 1):
            share, name = max(((dice(line, t), -k) for k, (_, t) in enumerate(license_scan.TEMPLATES)))
            if share >= 80:
                expected.append((at, license_scan.TEMPLATES[-name][0], int(share)))
        assert [tuple(x) for x in r.found] == expected


def test_empty_tables(nothing, ranks):
    assert exact_dedup.exact_dedup(nothing).count() == 0
    assert exact_dedup.deduplicated(nothing).count() == 0
    assert ngram_join.linked_components(nothing).count() == 0
    assert substring_dedup.without_repeats(nothing).count() == 0
    assert line_dedup.deduplicated_lines(nothing).count() == 0
    assert bpe.encode(nothing, ranks, public_tokenizers.PATTERN).count() == 0
    assert quality_rules.judged(nothing).count() == 0
    assert mixing.assigned(nothing, registry.mix_path(nothing), registry.MIX).count() == 0
    assert secret_scan.scan(nothing).count() == 0
    assert license_scan.scan(nothing).count() == 0
