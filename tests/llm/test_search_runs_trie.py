"""Benchmark search, periodic runs and the conversation trie against brute force and on odd rows."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from revspan.llm import conversation_trie, decontaminate, periodic_runs, queries
from tests.conftest import SF
from tests.oracle_check import connect, duck_rows, spark_rows

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")

DOCS = "doc_id long, text string"
CLASHING = ("body", "spans", "items", "runs", "best", "words", "place", "a", "k1", "seq", "depth", "part", "row", "base", "h")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def with_clashes(df):
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHING])


@needs_data
@pytest.mark.parametrize("name", ["op11_decontaminate", "op12_periodic_runs", "op13_conversation_trie"])
def test_against_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == duck_rows(connect(SF), queries.ORACLES[name])


# Benchmark search

def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_hits(text, items, size):
    words, hit, found = words_of(text), set(), set()
    for item_id, item in items:
        own = words_of(item)
        k = min(size, len(own))
        for i in range(len(own) - k + 1) if own else ():
            for at in range(len(words) - k + 1):
                if words[at: at + k] == own[i: i + k]:
                    hit.update(range(at, at + k))
                    found.add(item_id)
    return len(words), hit, sorted(str(i) for i in found if i is not None)


def random_text(rng, n, letters):
    return "".join(rng.choice(letters) + rng.choice([" ", " ", "-", "\n", ", ", "\x00", " É "]) for _ in range(n))


@pytest.mark.parametrize("part_words", [1_000_000, 4])
@pytest.mark.parametrize("letters", [["a", "B"], ["ab", "ba", "Bc", "ß", "9", "x"]])
def test_search_matches_brute_force(spark, letters, part_words):
    rng = random.Random(len(letters))
    items = [(i // 2, random_text(rng, rng.choice([0, 1, 2, 3, 5, 12]), letters)) for i in range(14)]
    items += [(None, "only here"), (90, None), (91, ""), (92, " .. "), (93, items[5][1]), (93, items[5][1])]
    docs = [(i, random_text(rng, rng.choice([0, 1, 4, 9, 60]), letters)) for i in range(60)]
    docs += [(None, None), (7, None), (8, ""), (None, "xx Only-HERE yy"), (60, items[11][1]), (60, items[11][1])]
    rows = with_clashes(spark.createDataFrame(docs, DOCS))
    benchmark = with_clashes(spark.createDataFrame(items, "item_id long, text string"))
    found = decontaminate.benchmark_passages(rows, benchmark, size=5, part_words=part_words).collect()
    expected = []
    for doc_id, text in docs:
        n, hit, ids = brute_hits(text, items, 5)
        expected.append((doc_id, n, tuple(sorted(hit)), tuple(ids)))
    got = [(r.doc_id, r.n_words, tuple(i for s in r.spans for i in range(s.start, s.end)), tuple(r["items"])) for r in found]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert all(a.end < b.start for r in found for a, b in zip(r.spans, r.spans[1:]))


def test_search_moves_over_words_that_are_in_no_string():
    tables = decontaminate.build_tables(["a b c d e f g h i j k l"])
    (table,) = tables
    assert table.length == 10 and len(table.buckets) == 3 and max(table.shift.values()) == 7

    class Probed(list):
        reads = 0

        def __getitem__(self, at):
            Probed.reads += isinstance(at, slice)
            return super().__getitem__(at)

    text = Probed([b"z"] * 8_000 + list(map(bytes, b"bcdefghijkl".split())) + [b"z"] * 8_000)
    assert decontaminate.search(text, tables)[0] == []
    assert Probed.reads < 16_000 / 7


def test_contamination_digests_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two three " * 4), (2, None), (3, "z " * 300_000 + "one two three")], DOCS)
    items = spark.createDataFrame([(10, "One, TWO"), (9, "three")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.contamination(decontaminate.benchmark_passages(docs, items)).collect()}
    assert tuple(rows[1]) == (1, 12, 12, 2, sha("10,9"), True)
    assert tuple(rows[2]) == (2, 0, 0, 0, sha(""), False)
    assert (rows[3].n_words, rows[3].n_hit, rows[3].n_items) == (300_003, 3, 2)
    none = decontaminate.contamination(decontaminate.benchmark_passages(docs, items.where("false"))).collect()
    assert {(r.n_hit, r.n_items, r.contaminated) for r in none} == {(0, 0, False)}
    assert decontaminate.benchmark_passages(docs.where("false"), items).count() == 0


# Periodic runs

def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if i > start and length >= max(24, 3 * q):
                found.setdefault((start, length), q)
            i = max(i, start + 1)
    return sorted((s, k, q) for (s, k), q in found.items())


def repetitive(rng):
    words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.choice([0, 1, 5, 23, 24, 25, 60, 150, 400]))]
    for _ in range(rng.randrange(4)):
        if words:
            at = rng.randrange(len(words))
            unit = words[at: at + rng.randrange(1, 40)]
            words[at:at] = unit * rng.randrange(2, 12) + unit[: rng.randrange(len(unit))]
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] = b"z"
    return words


def test_runs_match_brute_force():
    rng = random.Random(4)
    for _ in range(120):
        texts = [repetitive(rng) for _ in range(rng.randrange(1, 6))]
        assert [[tuple(r) for r in runs] for runs in periodic_runs.text_runs(texts)] == [
            [(s, k, q) for s, k, q in sorted(brute_runs(t), key=lambda r: (r[0], r[2]))] for t in texts]


@pytest.mark.parametrize("period", [1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33, 100, 1000])
@pytest.mark.parametrize("shift", [0, 1, 13])
def test_every_period_is_caught_at_every_place(period, shift):
    unit = [b"u%d" % i for i in range(period)]
    words = [b"x%d" % i for i in range(shift)] + unit * max(3, -(-24 // period)) + [b"end"] * 2
    assert [tuple(r) for r in periodic_runs.text_runs([words])[0]] == [
        (shift, period * max(3, -(-24 // period)), period)]
    assert periodic_runs.text_runs([words[:shift] + unit * 2 + unit[:-1]]) == [[]] or period < 12


def test_run_rows_and_digests(spark):
    spam = "buy now " * 15
    docs = [(1, spam), (1, spam), (2, None), (3, ""), (None, "x " + spam + "y"), (None, None), (4, "word " * 200_000), (5, "no run here")]
    rows = with_clashes(spark.createDataFrame(docs, DOCS))
    found = periodic_runs.periodic_runs(rows)
    got = sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in found.collect())
    assert got == sorted([
        ("1", [(0, 30, 2)], "buy now"), ("1", [(0, 30, 2)], "buy now"), ("2", [], ""), ("3", [], ""), ("None", [], ""),
        ("None", [(1, 30, 2)], "x buy now y"), ("4", [(0, 200_000, 1)], "word"), ("5", [], "no run here")])
    one = periodic_runs.run_digests(found).where("doc_id = 1").first()
    assert tuple(one) == (1, 1, 0, 30, 2, 15_000, sha("0,30,2\n"), sha("buy now"))
    none = periodic_runs.run_digests(found).where("doc_id = 2").first()
    assert tuple(none) == (2, 0, None, None, None, None, sha(""), sha(""))
    assert periodic_runs.run_digests(periodic_runs.periodic_runs(rows.where("false"))).count() == 0


def test_the_strongest_run_and_planted_tails():
    run = periodic_runs.Run
    assert periodic_runs.strongest([run(0, 30, 10), run(5, 24, 8), run(9, 31, 10)]) == run(9, 31, 10)
    assert periodic_runs.strongest([run(0, 24, 8), run(0, 36, 12)]) == run(0, 24, 8)
    words = [b"%d" % i for i in range(200)]
    for doc_id in range(300):
        h = zlib.crc32(str(doc_id).encode())
        new = periodic_runs.repeat_tail(words, doc_id)
        if h % 10:
            assert new == words
        else:
            a, p = (h // 10) % 200, 1 + (200 - (h // 10) % 200) // (3 + h // 10 % 8)
            assert new == [words[i if i < a else a + (i - a) % p] for i in range(200)]


# Conversation trie

def brute_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        turns[c].append((role or "", text or ""))
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out = []
    for node, convs in members.items():
        below = [p for p in members if p[: len(node)] == node]
        children = [p for p in below if len(p) == len(node) + 1]
        leaves = [p for p in below if not any(q[:-1] == p and q for q in members)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = sorted(c for c in convs if len(whole[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), len(leaves),
                    saved, sha(",".join(map(str, ends)))))
    return sorted(out, key=str)


CONVERSATIONS = "conv_id long, turn int, role string, text string"


@pytest.mark.parametrize("chunk_bits", [12, 1])
def test_trie_matches_brute_force(spark, monkeypatch, chunk_bits):
    monkeypatch.setattr(conversation_trie, "CHUNK_BITS", chunk_bits)
    rng = random.Random(chunk_bits)
    rows = []
    for c in rng.sample(range(600), 90) + [0, 200, 300, 305, 306]:
        for turn in range(rng.choice([1, 1, 2, 3, 6, 9])):
            role, text = rng.choice(["user", "user", "bot", None]), rng.choice(["a", "a", "bb", "é" * 5, "", None])
            rows.append((c, turn if turn else None, role, text))
    rows += [(None, 1, "user", "lost"), (None, None, None, None)]
    df = with_clashes(spark.createDataFrame(rng.sample(rows, len(rows)), CONVERSATIONS))
    got = conversation_trie.conversation_trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows)


def test_copies_long_conversations_and_empty_tables(spark):
    copies = [(c, t, "user", f"turn {t}") for c in range(1_000, 1_040) for t in range(3)]
    long_one = [(7_700, t, "bot", "x" * (1 + t % 3)) for t in range(9_000)]
    alike = [(8_800, 1, "user", "same"), (8_800, 1, "user", "same"), (-5, 1, None, None)]
    rows = copies + long_one + alike
    got = conversation_trie.conversation_trie(spark.createDataFrame(rows, CONVERSATIONS)).collect()
    root = next(r for r in got if r.depth == 0)
    assert (root.conv_id, root.n_convs, root.parent_conv_id) == (-5, 43, None)
    deepest = max(got, key=lambda r: r.depth)
    assert (deepest.conv_id, deepest.depth, deepest.n_convs, deepest.saved_tokens) == (7_700, 9_000, 1, 0)
    assert conversation_trie.conversation_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
