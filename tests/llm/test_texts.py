import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import conversations as conv
from tessera.llm import encode, groups, lexicon, near, packing, split

# ---------------------------------------------------------------- splitting


def check_pieces(text, limit, overlap):
    p = split.pieces_of(text, limit, overlap)
    assert "".join(text[s + o : e] for s, e, o in p) == text
    assert all(e - s <= limit and 0 <= o <= overlap for s, e, o in p)
    assert p[0][2] == 0 and all(o <= b - a for (a, b, _), (_, _, o) in zip(p, p[1:]))
    return p


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n!é😀", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_give_back_the_text(text, limit, overlap):
    check_pieces(text, limit, overlap)


def test_pieces_end_at_the_strongest_boundary():
    t = ("word " * 40 + "end.\n\n") * 5
    p = check_pieces(t, 450, 20)
    assert all(t[:e].endswith("\n\n") for _, e, _ in p)
    assert len(check_pieces("x" * 10_001, 4000, 200)) == 3
    assert len(check_pieces("a b" * 30_000, 4000, 200)) <= 26


def least_within(text, limit, overlap):
    """The least number of cuts within words, by trying all cuts."""
    ends = {m.end() for b in split.BOUNDARIES for m in b.finditer(text)}
    n, core = len(text), max(1, limit - overlap)
    least = {n: 0}
    for a in range(n - 1, -1, -1):
        least[a] = min(least[b] + (b not in ends and b < n) for b in range(a + 1, min(n, a + (core if a else limit)) + 1))
    return least[0], ends


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aaab .\n", max_size=150), st.integers(5, 30), st.integers(0, 4))
def test_words_are_cut_only_where_they_must_be(text, limit, overlap):
    least, ends = least_within(text, limit, overlap) if text else (0, set())
    assert sum(c not in ends for c in split.cuts(text, limit, overlap)[:-1]) == least


def test_boundaries_far_from_the_target_count():
    for text, n in (("a" * 804 + " " + "b" * 7217, 2), ("b" * 7400 + " " + "a" * 700, 2), ("a" * 100 + " " + "b" * 7790 + " " + "c" * 7700, 2)):
        p = check_pieces(text, 8000, 200)
        assert len(p) == n and all(text[e - 1] == " " for _, e, _ in p[:-1])
    assert len(check_pieces("a" * 100 + " " + "b" * 9000, 8000, 200)) == 2


def test_split_rows(spark):
    df = spark.createDataFrame([("a", "x " * 3000, 1), ("b", None, 2), ("c", "", 3), ("d", "y" * 4000, 4), ("e", "é" * 4001, 5)], "id string, text string, piece int")
    got = {}
    for r in split.split(df, "id", "text", 4000).collect():
        got.setdefault(r["item_id"], []).append(r)
    assert set(got) == {"a", "e"} and all(len(r["text"]) <= 4000 for v in got.values() for r in v)
    assert split.split(df.limit(0), "id", "text", 4000).count() == 0
    with pytest.raises(ValueError):
        split.split(df, "id", "text", 10, 10)


# ---------------------------------------------------------------- conversations


def broken(rows):
    """Whether a conversation is to be dropped, by a plain reading of the rules."""
    seen = {}
    for i, role, text in rows:
        seen.setdefault((i, role.strip().lower() if role else None, text), None)
    t = sorted(seen, key=lambda x: (x[0] is None, x[0] or 0))
    blank = lambda s: s is None or not s.strip()
    if [x[0] for x in t] != list(range(len(t))) or any(r not in ("user", "assistant", "tool", "system") for _, r, _ in t):
        return True
    if not any(r == "user" and not blank(s) for _, r, s in t):
        return True
    turns = [(r, blank(s)) for _, r, s in t if r != "system"]
    if turns[0][0] != "user":
        return True
    k = 0
    while k < len(turns):
        answered = False
        while k < len(turns) and turns[k][0] == "user":
            k += 1
        while k < len(turns) and turns[k][0] != "user":
            answered |= turns[k] == ("assistant", False)
            k += 1
        if not answered:
            return True
    return False


def test_automaton_against_the_rules(spark, monkeypatch):
    monkeypatch.setattr(conv, "PART", 3)
    rng = random.Random(2)
    rows, want = [], {}
    for s in range(250):
        n = rng.randint(1, 9)
        t = [(i, ("user" if i % 2 == 0 else "assistant") if rng.random() < 0.85 else rng.choice(["user", "tool", "system", " Assistant", "robot", None]), rng.choice(["hi", "yo", "ok", " \u2003\n", None]) if rng.random() < 0.2 else "x") for i in range(n)]
        if rng.random() < 0.1:
            t.append((rng.choice([None, 0, n + 3]), "user", "again"))
        t += [t[0]] * rng.randint(0, 2)
        want[f"s{s}"] = broken(t)
        rows += [(f"s{s}-{i}", f"s{s}", i, r, x) for i, r, x in t]
    rows.append(("x", None, 0, "user", "lost"))
    df = spark.createDataFrame(rows, "id string, session_id string, idx int, role string, text string")
    got = {r["session_id"]: not r["valid"] for r in conv.verdicts(df).collect()}
    assert got == want and any(want.values()) and not all(want.values())
    parts = conv.conversations(df).collect()
    assert {r["session_id"] for r in parts} == {k for k, v in want.items() if not v}
    assert all(len(r["turns"]) <= 3 and [x["idx"] for x in r["turns"]] == sorted(x["idx"] for x in r["turns"]) for r in parts)
    assert conv.verdicts(df.limit(0)).count() == 0


# ---------------------------------------------------------------- groups


@pytest.mark.parametrize("bound", [5, 1000])
def test_groups_against_a_search(spark, bound):
    rng = random.Random(4)
    pairs = [(f"{rng.randrange(150):03d}", f"{rng.randrange(150):03d}") for _ in range(110)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)] + [("h", f"h{i}") for i in range(30)]
    pairs += [(b, a) for a, b in pairs[:20]] + [("007", "007"), (None, "001"), ("001", None)]
    near_ = {}
    for a, b in pairs:
        if a and b and a != b:
            near_.setdefault(a, set()).add(b)
            near_.setdefault(b, set()).add(a)
    want = {}
    for x in sorted(near_):
        if x not in want:
            todo = [x]
            while todo:
                y = todo.pop()
                if y not in want:
                    want[y] = x
                    todo += near_[y]
    df = spark.createDataFrame(pairs, "a string, b string").repartition(3)
    got = {r["id"]: r["group_id"] for r in groups.connected(df, bound=bound).collect()}
    assert got == want
    assert groups.connected(df.limit(0), bound=bound).count() == 0


def test_split_is_that_of_the_pattern():
    import regex

    rng = random.Random(0)
    pattern = regex.compile(lexicon.PATTERN)
    for top in (128, 0x250, 0xD800, 0x110000):
        for _ in range(800):
            t = "".join(chr(rng.choice([rng.randrange(min(top, 0xD800)), 0x1C, 0x85, 0xA0, 32, 10, 39, 115, 65, 48, top - 1 if top > 0xE000 or top <= 0xD800 else 65])) for _ in range(40))
            assert lexicon.split(t) == pattern.findall(t)


def test_one_component_of_many_partitions(spark):
    """A path and a star of ten times the bound, in shuffled order, and a hub that joins them; no task holds more than the bound."""
    rng = random.Random(9)
    ids = [f"{x:04d}" for x in rng.sample(range(10_000), 500)]
    pairs = list(zip(ids[:250], ids[1:250])) + [(ids[250], x) for x in ids[251:]]
    rng.shuffle(pairs)
    df = spark.createDataFrame(pairs, "a string, b string").repartition(4)
    got = {r["id"]: r["group_id"] for r in groups.connected(df, bound=24).collect()}
    assert got == {x: min(ids[:250]) for x in ids[:250]} | {x: min(ids[250:]) for x in ids[250:]}
    joined = df.unionByName(spark.createDataFrame([(ids[3], ids[250])], "a string, b string"))
    assert {r["group_id"] for r in groups.connected(joined, bound=24).collect()} == {min(ids)}


def test_concept_groups_ignore_other_links(spark):
    c = spark.createDataFrame([("1", "x"), ("2", "x"), ("2", "x"), ("3", "x"), (None, "x")], "id string, kind string")
    l = spark.createDataFrame([("2", "1", "same_as"), ("1", "9", "same_as"), ("3", "1", "variant_of"), ("3", "3", "same_as"), (None, "1", "same_as")], "a string, b string, kind string")
    assert {tuple(r) for r in groups.concept_groups(c, l).collect()} == {("1", "1"), ("2", "1")}
    assert groups.all_concept_groups(c, l).count() == 3


# ---------------------------------------------------------------- tokens


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=lexicon.PATTERN, mergeable_ranks=lexicon.ranks(lexicon.tokenizer_file()), special_tokens={})


def test_transducer_round_trip():
    rng = random.Random(1)
    words = {bytes(rng.choices(b"abc", k=rng.randint(1, 7))): [rng.randrange(99) for _ in range(rng.randint(0, 3))] for _ in range(400)}
    lex = lexicon.compile_words(words)
    assert all(lex.get(w) == ids for w, ids in words.items())
    assert all(lex.get(w + b"z") is None for w in words) and lex.get(b"") is None
    assert len(lex.first) - 1 < sum(map(len, words))  # suffixes are shared
    assert lexicon.compile_words({}).get(b"a") is None and lexicon.compile_words({b"": [1]}).get(b"") == [1]


def test_merges_are_exact(reference):
    rank = lexicon.ranks(lexicon.tokenizer_file())
    rng = random.Random(2)
    for _ in range(300):
        w = "".join(rng.choices("aeinorst hé漢😀0'", k=rng.randint(1, 40)))
        for x in lexicon.split(w):
            assert lexicon.merge(x.encode(), rank) == reference.encode_ordinary(x)
    long = "abcde" * 8000
    assert lexicon.merge(long.encode(), rank) == reference.encode_ordinary(long)


def test_encode_rows(spark, reference):
    texts = ["Hello world", "", None, "<|endoftext|> x", "  \n\t ", "naïve 漢字 😀 don't", "x" * 70 + " y", "a b\r\nc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "1 as ids")
    got = {r["doc_id"]: r["ids"] for r in encode.encode(df, k=3).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in enumerate(texts)}
    n = {r["doc_id"]: r["n_tokens"] for r in encode.token_counts(df).collect()}
    assert n == {i: len(g) for i, g in got.items()}
    assert encode.encode(df.limit(0)).count() == 0


# ---------------------------------------------------------------- containers


def check_packing(rows, capacity):
    used = {}
    for i, piece, start, size, box in rows:
        used[box] = used.get(box, 0) + size
    assert max(used.values(), default=0) <= capacity
    return used


def test_packing(spark):
    rng = random.Random(3)
    sizes = [rng.choice([rng.randint(0, 40), rng.randint(30, 70), rng.randint(60, 100), 50, 350]) for _ in range(600)]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)] + [(1000, None, "x")], "doc_id long, n_tokens int, piece string")
    rows = [tuple(r) for r in packing.pack(df, capacity=100).collect()]
    used = check_packing(rows, 100)
    per = {}
    for i, piece, start, size, _ in rows:
        per.setdefault(i, []).append((piece, start, size))
    assert all(sum(s for _, _, s in per[i]) == n for i, n in enumerate(sizes)) and per[1000] == [(0, 0, 0)]
    assert all(len(v) == 1 for i, v in per.items() if i < 600 and sizes[i] <= 100)
    large = sum(1 for n in sizes for s in [100] * (n // 100) + [n % 100] if s > 50)
    least = max(-(-sum(sizes) // 100), large)
    full = [b for b, u in used.items() if u]
    assert len(full) <= least * 1.05 + 1
    c = packing.containers(packing.pack(df, capacity=100), 100).agg({"used": "max", "unused": "min"}).first()
    assert c[0] <= 100 and c[1] >= 0
    assert packing.pack(df.limit(0), capacity=100).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
def test_plan_is_whole_and_fits(counts):
    table, total = packing.plan(counts, 60)
    used, given_ = np.zeros(total, np.int64), {}
    for size in counts:
        rows = table[table[:, 0] == size]
        rows = rows[np.argsort(rows[:, 1])]
        for k, (s, rank, first, each) in enumerate(rows):
            end = rows[k + 1][1] if k + 1 < len(rows) else counts[size]
            for r in range(rank, end):
                used[first + (r - rank) // each] += size
            given_[size] = end
    assert given_ == counts and (used <= 60).all() and (used > 0).all()
    low = -(-sum(s * n for s, n in counts.items()) // 60)
    assert total <= 1.5 * max(low, sum(n for s, n in counts.items() if s > 30)) + 2


# ---------------------------------------------------------------- near duplicates


def words_of(t):
    import re

    return set(re.findall(r"[^\W_]+", (t or "").lower()))


@pytest.mark.parametrize("run", [2048, 40, 2])
def test_near_duplicates_against_all_pairs(spark, run):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = []
    for i in range(60):
        base = rng.sample(vocabulary, 40)
        for j in range(rng.choice([1, 2, 4])):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(40)] = rng.choice(vocabulary)
            rng.shuffle(w)
            rows.append((f"{i}-{j}", "", " ".join(w)))
    rows += [("copy", "", rows[0][2]), ("copy", "", rows[0][2]), ("short", "a b", "c"), ("null", None, None), (None, "x", rows[0][2])]
    df = spark.createDataFrame(rows, "id string, title string, summary string").selectExpr("*", "1 as rid", "'k' as table_code")
    pairs, members = near.similar({"t": (df, "id", ["title", "summary"])}, 0.7, 20, run)
    got = {(r["a"], r["b"]) for r in near.pairs_of(pairs, members).collect()}
    sets = {i: words_of(f"{t or ''} {s or ''}") for i, t, s in rows if i}
    want = {(a, b) for a in sets for b in sets if a < b and min(len(sets[a]), len(sets[b])) >= 20 and 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}
    assert got == want and ("0-0", "copy") in got
    g = {r["id"]: r["group_id"] for r in near.groups_of(pairs, members).collect()}
    assert all(g[a] == g[b] for a, b in got) and set(g) == {x for p in got for x in p}
    none = near.similar({"t": (df.limit(0), "id", ["title"])}, 0.7, 20)
    assert near.pairs_of(*none).count() == 0


def near_pairs(spark, texts, t=0.7, run=near.RUN):
    """The pairs found and the pairs there are."""
    df = spark.createDataFrame(texts, "id string, summary string").repartition(3)
    got = {(r["a"], r["b"]) for r in near.pairs_of(*near.similar({"t": (df, "id", ["summary"])}, t, 20, run)).collect()}
    sets = [(i, words_of(x)) for i, x in sorted(texts)]
    return got, {(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if min(len(x), len(y)) >= 20 and len(x & y) >= t * len(x | y) - 1e-9}


@pytest.mark.parametrize("run", [2048, 20, 4])
def test_variants_of_a_text_that_fills_a_third(spark, run):
    rng = random.Random(7)
    hot = [f"h{i}" for i in range(40)]
    texts = [(f"c{i:03d}", " ".join(hot)) for i in range(80)]
    texts += [(f"v{n:02d}-{k}", " ".join(hot + [f"n{n}x{k}x{i}" for i in range(n)])) for n in range(18) for k in range(2)]
    texts += [(f"f{i:03d}", " ".join(rng.sample([f"w{j}" for j in range(3000)], 30))) for i in range(124)]
    got, want = near_pairs(spark, texts, run=run)
    assert got == want and ("c000", "v17-1") in got and ("v08-0", "v08-1") in got and ("v12-0", "v08-1") not in got


@pytest.mark.parametrize("run", [2048, 30, 3])
def test_edits_that_fall_on_telling_words(spark, run):
    rng = random.Random(8)
    common, vocabulary = [f"c{i}" for i in range(20)], [f"w{i}" for i in range(4000)]
    texts = []
    for i in range(150):
        own = rng.sample(vocabulary, 15)
        texts += [(f"{i:03d}a", " ".join(common + own[:10])), (f"{i:03d}b", " ".join(common + own[5:]))]
    got, want = near_pairs(spark, texts, run=run)
    assert got == want and len(want) >= 150  # 25 of 35 words


def test_sets_of_few_words_may_meet_in_one(spark):
    sets = [[1, 2], [2, 3], [4, 5, 6], [6, 7], [8]]
    flat, off = np.array(sum(sets, []), np.uint64), np.cumsum([0, *map(len, sets)])
    met = {}
    for keys, rows, _, _ in near.variants(flat, off, near.Frequent(np.zeros(0, np.uint64), 0), np.zeros(len(sets), np.uint64), 0.25):
        for k, r in zip(keys.tolist(), rows.tolist()):
            met.setdefault(k, set()).add(r)
    assert {tuple(sorted(x)) for x in met.values() if len(x) > 1} == {(0, 1), (2, 3)}


def test_bound_never_drops_a_true_pair():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.integers(1, 2**62, rng.integers(20, 70)).astype(np.uint64)
        keep = rng.random(len(a)) < 0.85
        b = np.concatenate([a[keep], rng.integers(1, 2**62, rng.integers(0, 8)).astype(np.uint64)])
        j = keep.sum() / (len(a) + len(b) - keep.sum())
        flat = np.concatenate([a, b])
        b1, b2 = near.bitmaps(flat, np.array([0, len(a), len(flat)]))
        if j >= 0.7:
            assert near.possible((b1[:1], b2[:1]), (b1[1:], b2[1:]), 0.7)[0]
            x, y = zip(*near._tile(np.arange(2), b1, b2, 0.7))
            assert sum(map(len, x)) == 1


def test_places_of_leading_words_come_in_blocks(monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 10)
    for m in range(2, 20):
        got = [(int(x), int(y)) for i, j in near._leads(m) for x, y in zip(i, j)]
        assert got == [(i, j) for i in range(m) for j in range(i + 1, m)]
