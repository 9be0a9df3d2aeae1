"""Operators 2, 4, 5, 7 and 10 against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from tests.llm.conftest import plain

from emulsa.llm import op2_spotsigs, op4_lines, op5_jaccard, op7_exact, op10_suffix
from emulsa.llm.common import mix

TABLES = pytest.mark.parametrize("table", ["docs", "edges", "empty"])


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# --- op2 ----------------------------------------------------------------------------------------------
def signatures(text):
    """Chains of an anchor and the next two content words."""
    common = set(op2_spotsigs.COMMON)
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    content = [w for w in words if w not in common]
    out, k = set(), 0
    for w in words:
        if w in common:
            if k < len(content):
                out.add((w, *content[k : k + 2]))
        else:
            k += 1
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@TABLES
def test_edits(table, request):
    df = request.getfixturevalue(table)
    got = op2_spotsigs.compare_edits(df).collect()
    rows = in_order(plain(df))
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows)
    unique = {d: k for k, (d, _) in enumerate(rows) if sum(x == d for x, _ in rows) == 1}
    prints = {}
    for r in got:
        if r.doc_id not in unique:
            continue
        k = unique[r.doc_id]
        text, after = rows[k][1], rows[(k + 1) % len(rows)]
        n = len(text) // 4
        assert r.n_chars == len(text)
        if after[0] in unique:  # rows that share an id may come in either order
            edited = text[: len(text) - n] + after[1][:n]
            assert r.edited_sha256 == sha(edited)
            assert prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        a, b = (set(re.findall("." * op2_spotsigs.DIGITS, x)) for x in (r.fingerprint, r.edited_fingerprint))
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        made = signatures(text)
        if len(made) > 3 and text.isascii():
            assert len(a) == len(made)
    for r in got:
        if r.doc_id in unique and (after := rows[(unique[r.doc_id] + 1) % len(rows)])[0] in unique:
            a, b = (set(re.findall("." * op2_spotsigs.DIGITS, x)) for x in (r.fingerprint, prints[after[1]]))
            assert r.near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_near_duplicate_fingerprints(docs):
    sigs = {r.doc_id: frozenset(r.sigs) for r in op2_spotsigs.fingerprint(docs).collect() if r.sigs}
    first = {}
    for d in sorted(sigs):
        first.setdefault(sigs[d], d)
    reps = sorted(first.values())
    want = {(a, b) for i, a in enumerate(reps) for b in reps[i + 1 :] if len(sigs[a] & sigs[b]) / len(sigs[a] | sigs[b]) >= 0.75}
    assert want and {(r.a_id, r.b_id) for r in op2_spotsigs.near_duplicates(docs).collect()} == want
    assert {r.doc_id: r.class_id for r in op2_spotsigs.classes(docs).collect() if r.doc_id in sigs} == {d: first[s] for d, s in sigs.items()}


# --- op4 ----------------------------------------------------------------------------------------------
@TABLES
def test_line_chunks(table, request):
    df = request.getfixturevalue(table)
    rows = plain(df)
    bodies, seen = defaultdict(list), {}
    for d, t in rows:
        lines = t.split("\n")
        r = []
        for i in range(len(lines)):  # mixed hash of each line and the one before it
            x = sum(xxhash.xxh3_64_intdigest(lines[j]) * 0x9E3779B97F4A7C15 ** (i - j) for j in range(max(0, i - 1), i + 1)) % (1 << 64)
            r.append(int(mix(np.array([x], np.uint64))[0]))
        ends = [i + 1 for i in range(1, len(lines) - 1) if r[i] < r[i - 1] and r[i] < r[i + 1]]
        cuts = list(zip([0, *ends], [*ends, len(lines)], strict=True))
        assert op4_lines.chunks(lines) == cuts
        seen[d, t] = [(k, e - s, "\n".join(lines[s:e]), lines[s:e]) for k, (s, e) in enumerate(cuts)]
        for k, n, body, _ in seen[d, t]:
            if n > 1:
                bodies[body].append((d is not None, d or 0, t, k))
    want = []
    for d, t in rows:
        kept = []
        for k, n, body, own in seen[d, t]:
            first = min(bodies[body], key=lambda p: (p[0], p[1], p[3])) if n > 1 else None
            if first is None or first == (d is not None, d or 0, t, k):
                kept += own
        want.append((str(d), len(t.split("\n")), len(t.split("\n")) - len(kept), "\n".join(kept)))
    got = op4_lines.deduplicate(df).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_removed, r.text) for r in got) == sorted(want)
    assert all(r.kept_sha256 == sha(r.text) for r in got)


def test_chunks_survive_insertions():
    rnd = random.Random(2)
    lines = [f"line {rnd.random()}" for _ in range(400)]
    cut = lambda ls: {"\n".join(ls[s:e]) for s, e in op4_lines.chunks(ls)}
    assert len(cut(lines) & cut([*lines[:200], "new", *lines[200:]])) >= len(cut(lines)) - 3


def test_shared_passages_in_different_texts(spark):
    """Passages of twelve lines inside otherwise different texts go but for their ends; a hot one goes everywhere but once."""
    rnd = random.Random(5)
    own = lambda k: [f"own {rnd.random()}" for _ in range(k)]
    passage = own(12)
    rows = [(k, "\n".join(own(rnd.randrange(3, 9)) + passage + own(rnd.randrange(3, 9)))) for k in range(40)]
    got = {r.doc_id: r for r in op4_lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_removed == 0 and got[0].text == rows[0][1]
    removed = {got[k].n_removed for k in range(1, 40)}
    assert all(4 <= n <= 12 for n in removed)
    assert all(set(rows[k][1].split("\n")) - set(got[k].text.split("\n")) <= set(passage) for k in range(40))


# --- op5 ----------------------------------------------------------------------------------------------
def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(root(i)))) for i, (d, _) in enumerate(rows))


def test_join_components(docs):
    got = op5_jaccard.join_components(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == components(plain(docs))


def test_join_edges(edges, empty):
    # two rows of id 9 with one text are one node; the row of id 9 with another text has its own component
    got = op5_jaccard.join_components(edges).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == components(plain(edges))
    assert op5_jaccard.join_components(empty).count() == 0


def test_join_chains_and_large_groups(spark):
    rnd = random.Random(4)
    rows = []
    for _ in range(12):  # chains whose ends lie far apart, stars, and copies
        words = [f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(5, 90))]
        for _ in range(rnd.randrange(1, 14)):
            words = words[:]
            for _ in range(rnd.randrange(3)):
                words[rnd.randrange(len(words))] = f"w{rnd.randrange(400)}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = op5_jaccard.join_components(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == components(rows)


def test_join_divides_large_cells(spark, monkeypatch):
    """Families of many members around the threshold, with cells and blocks small enough to be divided."""
    monkeypatch.setattr(op5_jaccard, "LEAF", 6)
    monkeypatch.setattr(op5_jaccard, "PIVOTS", 3)
    monkeypatch.setattr(op5_jaccard, "BLOCK_NODES", 5)
    rnd = random.Random(11)
    rows = []
    for family in range(3):
        base = [f"f{family}w{rnd.randrange(5000)}" for _ in range(120)]
        for _ in range(40):
            words = base[:]
            for _ in range(rnd.randrange(1, 9)):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = op5_jaccard.join_components(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == components(rows)


def test_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 6000))).astype(np.uint64) for _ in range(9)]
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in sets[2:]] for x in sets[:5]]
    assert op5_jaccard.intersections(sets[:5], sets[2:]).tolist() == want


# --- op7 ----------------------------------------------------------------------------------------------
@TABLES
@pytest.mark.parametrize("heavy", [1, 1000])
def test_exact(table, heavy, request):
    df = request.getfixturevalue(table)
    groups = defaultdict(list)
    for d, t in plain(df):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((d, t))
    want = []
    for text, rows in groups.items():
        keep = min(rows, key=lambda r: (-len(r[1]), r[0] is not None, r[0] or 0))[0]
        want += [(str(d), str(keep), len(rows), d == keep, sha(text)) for d, _ in rows]
    got = op7_exact.deduplicate(df, heavy, 1024).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == sorted(want)


def test_exact_sql(docs, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    got = op7_exact.deduplicate(docs)
    assert sorted(con.execute(f"select {', '.join(got.columns)} from ({op7_exact.ORACLE})").fetchall()) == sorted(map(tuple, got.collect()))


# --- op10 ---------------------------------------------------------------------------------------------
def repeats(rows, length=100):
    """(id, bytes, removed, runs, hash of the rest), the order of rows given."""
    seen, out = set(), []
    for d, t in rows:
        raw = t.encode()
        gone = np.zeros(len(raw) + 2, np.int8)
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i + 1 : i + length + 1] = 1
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone[1:], strict=False) if not g)
        out.append((str(d), len(raw), int(gone.sum()), int((np.diff(gone) == 1).sum()), sha(kept)))
    return sorted(out)


def suffix(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op10_suffix.deduplicate(df).collect())


def test_suffix(docs, edges, empty):
    assert suffix(docs) == repeats(plain(docs))
    assert suffix(edges) == repeats(in_order(plain(edges)))
    assert suffix(empty) == []


def test_suffix_overlaps(spark):
    rnd = random.Random(6)
    base = ["".join(rnd.choice("ab") for _ in range(600)), "ä" * 300, "".join(rnd.choice("xyz ü") for _ in range(900))]
    rows = []
    for k in range(60):
        text = ""
        for _ in range(rnd.randrange(4)):
            b = rnd.choice(base)
            i = rnd.randrange(len(b))
            text += b[i : i + rnd.randrange(250)] + rnd.choice(["", "#", "mid"])
        rows.append((k, text))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert suffix(df) == repeats(rows)


def test_deep_shallow_order():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 2, (500, 68), np.uint8)
    text[100:300, :60] = text[5, :60]
    text[400:] = text[7]
    group = rng.integers(0, 3, 500)
    order, common = op10_suffix.deep_shallow(group, text)
    keys = [(int(g), t.tobytes()) for g, t in zip(group, text, strict=True)]
    assert [keys[k] for k in order] == sorted(keys)
    for k in range(1, 500):
        a, b = keys[order[k - 1]], keys[order[k]]
        assert common[k] == (-1 if a[0] != b[0] else next((i for i in range(68) if a[1][i] != b[1][i]), 68))
