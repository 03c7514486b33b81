"""Operators 1 and 2 against brute force, their SQL, and odd rows."""

import hashlib

import numpy as np
import pytest
from tests.compare import same
from hypothesis import given, settings
from hypothesis import strategies as st

from pointwright.llm import jaccard_join, queries, substring_dedup
from pointwright.llm.automaton import SuffixAutomaton, spans_above

from .conftest import DOCS, odd_rows, sentence, words


def cut_brute(rows, length):
    """Row -> kept words, by the definition."""
    least = {}
    split = [words(t) for _, t in rows]
    for (i, _), w in zip(rows, split, strict=True):
        for p in range(len(w) - length + 1):
            k = tuple(w[p : p + length])
            least[k] = min(i, least.get(k, i))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = set()
        for p in range(len(w) - length + 1):
            if least[tuple(w[p : p + length])] < i:
                gone |= set(range(p, p + length))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out)


def cut_rows(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in df.collect())


@given(st.lists(st.lists(st.integers(0, 2), max_size=12), min_size=1, max_size=5), st.lists(st.integers(0, 2), max_size=15))
@settings(max_examples=150, deadline=None)
def test_automaton_statistics(references, text):
    a = SuffixAutomaton()
    for r in references:
        a.add(r)
    found = {tuple(r[i:j]) for r in references for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
    want = [max((n for n in range(e + 1) if not n or tuple(text[e - n : e]) in found), default=0) for e in range(1, len(text) + 1)]
    assert a.statistics(text) == want
    assert {p for s, e in spans_above(want, 2) for p in range(s, e)} == {p for e, n in enumerate(want, 1) if n >= 2 for p in range(e - 2, e)}


@pytest.mark.parametrize("length,gram", [(13, 5), (6, 3), (2, 1)])
def test_cut_is_brute_force(random_docs, length, gram):
    rows, df = random_docs
    assert cut_rows(substring_dedup.remove_repeated(df, length=length, gram=gram)) == cut_brute([(r[0], r[1]) for r in rows], length)


@pytest.mark.parametrize("hot,local", [(2, 2), (1000, 3), (3, 1000)])
def test_cut_with_hot_anchors(random_docs, monkeypatch, hot, local):
    rows, df = random_docs
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "LOCAL_HOT", local)
    assert cut_rows(substring_dedup.remove_repeated(df, length=6, gram=3)) == cut_brute([(r[0], r[1]) for r in rows], 6)


def test_cut_of_odd_rows(odd, clashing, none):
    want = cut_brute([(r[0], r[1]) for r in odd_rows() if r[0] is not None], 13)
    assert cut_rows(substring_dedup.remove_repeated(odd)) == want
    assert cut_rows(substring_dedup.remove_repeated(clashing)) == want
    assert substring_dedup.remove_repeated(none).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_repeated(clashing, carry=("th",))


def test_spans_and_untouched_texts(odd):
    for r in substring_dedup.remove_repeated(odd, untouched="original", carry=("source",)).collect():
        assert sum(e - s for s, e in zip(r.span_starts, r.span_ends, strict=True)) == r.n_removed
        if r.doc_id == 6:
            assert r.kept_text == " \t\n "


def test_remove_against_a_reference(spark, random_docs):
    rows, df = random_docs
    reference = [r[1] for r in rows[:40]]
    seen = {tuple(w[p : p + 6]) for w in map(words, reference) for p in range(len(w) - 5)}
    for r in substring_dedup.remove_against(df, spark.createDataFrame([(t,) for t in reference], "text string"), length=6).collect():
        w = words(next(t for i, t, *_ in rows if i == r.doc_id))
        want = {q for p in range(len(w) - 5) if tuple(w[p : p + 6]) in seen for q in range(p, p + 6)}
        assert {q for s, e in zip(r.span_starts, r.span_ends, strict=True) for q in range(s, e)} == want


def join_brute(rows, k, percent):
    """doc_id -> (size, component), by the definition."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(lower))
        sets[i] = sets.get(i, set()) | ({tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def join_rows(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize("k,percent", [(5, 75), (2, 50)])
def test_join_is_brute_force(random_docs, k, percent):
    rows, df = random_docs
    assert join_rows(jaccard_join.link(df, words=k, percent=percent)) == join_brute([(r[0], r[1]) for r in rows], k, percent)


def near_copies(n, seed, edits=3):
    """Copies of one text, each with its own edits: links form chains, not a clique."""
    rng = np.random.default_rng(seed)
    base = sentence(rng, 60, 10_000).split()
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(int(rng.integers(0, edits + 1))):
            w[int(rng.integers(len(w)))] = f"e{int(rng.integers(40))}"
        rows.append((i * 3 + 1, " ".join(w), "en", "s", 1))
    return rows


@pytest.mark.parametrize("few,chunk,block,local", [(8, 256, 1024, 64), (2, 8, 16, 4), (1000, 256, 8, 1000)])
def test_join_of_large_groups(spark, monkeypatch, few, chunk, block, local):
    for name, value in (("FEW", few), ("CHUNK", chunk), ("BLOCK", block), ("LOCAL_HOT", local)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = near_copies(120, 8) + [(10_000 + i, r[1], "en", "s", 1) for i, r in enumerate(near_copies(40, 9, 1))]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    assert join_rows(jaccard_join.link(df)) == join_brute([(r[0], r[1]) for r in rows], 5, 75)


def test_join_of_odd_rows(odd, clashing, none):
    want = join_brute([(r[0], r[1]) for r in odd_rows() if r[0] is not None], 5, 75)
    assert join_rows(jaccard_join.link(odd)) == want
    assert join_rows(jaccard_join.link(clashing)) == want
    assert jaccard_join.link(none).count() == 0


def test_join_merges_rows_of_one_id(spark):
    rows = [(1, "a b c d e f", "", "", 0), (1, "g h i j k l", "", "", 0), (2, "a b c d e f", "", "", 0)]
    assert join_rows(jaccard_join.link(spark.createDataFrame(rows, DOCS))) == [(1, 4, 1), (2, 2, 2)]


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op2_jaccard_join", "op3_license_scan"])
def test_queries_equal_their_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), duck, queries.ORACLE_SQL[name])


def test_digest_of_kept_text(spark):
    for r in queries.op1_substring_dedup(spark, "/root/testdata/sf0.001").limit(3).collect():
        assert len(r.kept_sha256) == len(hashlib.sha256(b"").hexdigest())




def test_links_and_their_numbers_against_brute_force(spark, random_docs, odd, clashing, none):
    """Every link between different sets, and every document's number of links, by plain sets."""
    rows, df = random_docs
    for docs, table in ((rows, df), ([r for r in odd.collect() if r[0] is not None and r[0] != 9], odd.where("doc_id <> 9"))):
        sets = {}
        for r in docs:
            w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or ""))
            sets[r[0]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        near = {(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
        got = {r.doc_id: r.n_links for r in jaccard_join.count_links(table).collect()}
        assert got == {i: sum(i in p for p in near) for i in sets}
        pairs, member = jaccard_join.links(table)
        least = {r.doc_id: r.class_id for r in member.collect()}
        assert least == {i: min([i, *(j for j in sets if sets[i] and sets[j] == sets[i])]) for i in sets}
        assert sorted(map(tuple, pairs.collect())) == sorted(p for p in near if least[p[0]] == p[0] and least[p[1]] == p[1] and sets[p[0]] != sets[p[1]])
    assert {r.doc_id: r.component_id for r in jaccard_join.count_links(df).collect()} == {r.doc_id: r.component_id for r in jaccard_join.link(df).collect()}
    assert jaccard_join.count_links(none).count() == 0 and jaccard_join.count_links(clashing).count() == 14  # ids, not rows
