"""Operators on texts against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from evirank.llm import components, decontaminate, exact_dedup, licenses, line_dedup, mixing, simhash, substring_dedup
from pyspark.sql import functions as F

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def union_find(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_chain_and_star(spark):
    rng = np.random.default_rng(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [tuple(map(int, rng.integers(200, 260, 2))) for _ in range(40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "src long, dst long")).collect()}
    want = union_find({x for p in links for x in p}, links)
    assert got == {n: r for n, r in want.items() if n in got} and set(got) == {x for a, b in links if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_sainte_lague_is_the_highest_quotient_rule():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = int(rng.integers(1, 6))
        w, caps, seats = [int(x) for x in rng.integers(0, 50, n)], [int(x) for x in rng.integers(0, 30, n)], int(rng.integers(0, 60))
        got, want = mixing.sainte_lague(w, seats, caps), [0] * n
        for _ in range(seats):
            able = [i for i in range(n) if w[i] and want[i] < caps[i]]
            if not able:
                break
            want[max(able, key=lambda i: (w[i] / (2 * want[i] + 1), -i))] += 1
        assert got == want, (w, caps, seats)


def test_mix_targets_limits_and_reruns(spark, odd_docs, no_docs):
    got = mixing.mix(odd_docs).collect()
    assert len(got) == odd_docs.count()
    texts = defaultdict(list)
    for r in odd_docs.collect():
        texts[r.doc_id].append(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert r.size in texts[r.doc_id] and 0 <= r.taken <= 3 * r.size
        by[r.source][0] += r.size
        by[r.source][1] += r.taken
        by[r.source][2] = r.target
    sizes = sorted(by, key=lambda s: (s is None, s or ""))
    assert [by[s][0] for s in sizes] == [next(r.source_size for r in got if r.source == s) for s in sizes]
    assert mixing.targets_of([by[s][0] for s in sizes], [(5, 2, 1)[i % 3] for i in range(len(sizes))], 3) == pytest.approx([by[s][2] for s in sizes])
    for _, taken, target in by.values():
        assert abs(taken - target) <= max(2, 0.01 * target)
    again = mixing.mix(odd_docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter((r.doc_id, r.size, r.taken) for r in again)
    assert mixing.mix(no_docs).count() == 0
    assert mixing.targets_of([100, 10, 1], [5, 2, 1], 3) == pytest.approx([111 - 30 - 3, 30, 3]) and mixing.targets_of([0, 0], [5, 2], 3) == [0, 0]
    with pytest.raises(ValueError):
        mixing.mix(odd_docs, max_sources=2)


def test_golomb_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 100, 3000):
        x = np.unique(rng.integers(0, 1 << 60, n, np.uint64))
        assert (exact_dedup.golomb_decode(*exact_dedup.golomb_encode(x, 60), len(x)) == x).all()
    x = np.array([0, 1, 2, 2**60 - 1], np.uint64)
    assert (exact_dedup.golomb_decode(*exact_dedup.golomb_encode(x, 60), 4) == x).all()


@pytest.mark.parametrize("owner_bits", [0, 3, None])
def test_exact_dedup(odd_docs, no_docs, owner_bits):
    rows = odd_docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    got = Counter(tuple(r) for r in exact_dedup.exact_dedup(odd_docs, owner_bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == want
    if owner_bits is None:
        assert exact_dedup.exact_dedup(no_docs).count() == 0


def lines_brute(rows, min_chars=40, min_docs=5):
    key = lambda x: low(x.strip(SPACE))
    holders = defaultdict(set)
    for r in rows:
        for x in (r.text or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(r.doc_id)
    lose = {k: max(v, key=lambda i: -1 if i is None else i) for k, v in holders.items() if len(v) >= min_docs}
    out = Counter()
    for r in rows:
        split = (r.text or "").split("\n")
        stay = [x for x in split if lose.get(key(x), r.doc_id) == r.doc_id]
        out[r.doc_id, len(split), len(split) - len(stay), "\n".join(stay)] += 1
    return out


def test_line_dedup(odd_docs, no_docs):
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in line_dedup.dedup_lines(odd_docs).collect())
    assert got == lines_brute(odd_docs.collect()) and sum(1 for k in got if k[2]) == 6
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_line_index_is_reversible(spark, odd_docs):
    a, b = odd_docs.where("doc_id < 12"), odd_docs.where("doc_id >= 12 or doc_id is null")
    empty = line_dedup.LineIndex.empty(spark, "bigint", shards=4)
    state = lambda x: (sorted(map(tuple, x.refs.select("key", "n_docs", "keeper").collect())), sorted(tuple(r) for r in x.postings.select("key", "doc_id").collect()))
    both = empty.insert(a).insert(b)
    assert state(both) == state(empty.insert(odd_docs)) and state(both.insert(a)) == state(both)
    back = both.delete(b.select("doc_id"))
    assert state(back) == state(empty.insert(a))
    filters = {r.shard: line_dedup.Cuckoo.load(r.filter) for r in both.filters.collect()}
    for r in both.refs.collect():
        assert filters[r.shard].contains(np.frombuffer(r.key, np.uint64).reshape(1, 2)).all()


def test_common_lines_by_join_are_the_same(spark, odd_docs, monkeypatch):
    """Beyond the bound of the broadcast."""
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in line_dedup.dedup_lines(odd_docs).collect())
    assert got == lines_brute(odd_docs.collect())


def test_lines_are_asked_of_the_filter(spark, odd_docs):
    """A damaged filter loses drops: it is on the way of every line."""
    rows = line_dedup.LineIndex.empty(spark, "bigint").insert(odd_docs).refs.where("n_docs >= 5").select("key", "keeper").toArrow()
    keepers = line_dedup.Keepers.of(rows)
    line = [rows["key"][0].as_py()]
    assert keepers.lost(line_dedup.Cuckoo.load(keepers.filter), line, [-1]).tolist() == [True]
    assert keepers.lost(line_dedup.Cuckoo.load(keepers.filter), line, [rows["keeper"][0].as_py()]).tolist() == [False]
    assert keepers.lost(line_dedup.Cuckoo(10), line, [-1]).tolist() == [False]


def test_many_inserts_outgrow_a_filter(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('line number ', id % 300, ' that is longer than forty characters\n', 'own line ', id, ' that is longer than forty characters') AS text")
    index = line_dedup.LineIndex.empty(spark, "bigint", shards=2)
    for low_, high in ((0, 10), (10, 120), (120, 400)):
        index = index.insert(docs.where(f"doc_id >= {low_} and doc_id < {high}"))
    whole = line_dedup.LineIndex.empty(spark, "bigint", shards=2).insert(docs)
    counts = lambda x: Counter(tuple(r) for r in x.refs.collect())
    assert counts(index) == counts(whole) and index.filters.count() == 2
    filters = {r.shard: line_dedup.Cuckoo.load(r.filter) for r in index.filters.collect()}
    assert all(filters[r.shard].contains(np.frombuffer(r.key, np.uint64).reshape(1, 2)).all() for r in index.refs.collect())
    assert counts(index.delete(docs.where("doc_id >= 10"))) == counts(line_dedup.LineIndex.empty(spark, "bigint", shards=2).insert(docs.where("doc_id < 10")))


def test_cuckoo_fills_and_forgets():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**63, (20_000, 2), np.uint64)
    f = line_dedup.Cuckoo(20_000)
    f.insert(keys)
    assert f.contains(keys).all() and f.contains(rng.integers(0, 2**63, (20_000, 2), np.uint64)).mean() < 0.01
    f.delete(keys[:500])
    assert line_dedup.Cuckoo.load(f.dump()).contains(keys[500:]).all() and f.contains(keys[:500]).mean() < 0.01
    with pytest.raises(KeyError):
        line_dedup.Cuckoo(10).delete(keys[:1])


def fingerprint(text, k, seed=42):
    words = low(text).encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), seed) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(odd_docs, no_docs):
    rows = [r for r in odd_docs.collect() if r.doc_id is not None]
    fps = {r.doc_id: fingerprint(r.text, 3) for r in rows}
    want = union_find(fps, [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3])
    got = simhash.near_duplicates(odd_docs.where("doc_id is not null")).collect()
    assert {(r.doc_id, r.fps[0] % 2**64, r.component_id) for r in got} == {(i, fps[i], want[i]) for i in fps} and len(got) == len(rows)
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.near_duplicates(odd_docs).count() == odd_docs.count()


@pytest.mark.parametrize("bits", [0, 2, 3, 5, 7])
def test_index_links_all_near_pairs(spark, bits):
    from itertools import combinations

    sets = simhash.position_sets(bits)
    assert all(any(not set(d) & set(s) for s in sets) for d in combinations(range(8), min(bits, 7)))
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 30, np.uint64)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 9)), replace=False)) for x in base for _ in range(6)]
    fps = sorted({int(x) for x in base} | set(near))
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    links = simhash.links(spark.createDataFrame([(0, x) for x in signed], "w int, fp long"), bits).collect()
    want = union_find(signed, [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= bits])
    assert union_find(signed, [(r.src, r.dst) for r in links]) == want
    assert all(bin((r.src ^ r.dst) & (2**64 - 1)).count("1") <= bits for r in links)


def hits_brute(text, items, window=10):
    w, cover, found = ALNUM.findall(low(text)), set(), set()
    for i, t in items:
        v = ALNUM.findall(low(t))
        n = min(window, len(v))
        grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in grams:
                cover |= set(range(k, k + n))
                found.add(i)
    return len(w), len(cover), sorted(found)


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_decontamination(spark, odd_docs, no_docs, block_bytes):
    text = next(r.text for r in odd_docs.collect() if r.doc_id == 20)
    items = [("a", " ".join(text.split()[5:30])), ("b", "PLAIN text, of"), ("c", None), ("d", "?!"), ("a", "one document"), ("e", "absent words here"), ("f", " ".join(text.split()[20:29]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.matches(odd_docs, bench, block_bytes=block_bytes, shard_words=50).collect()
    texts = Counter((r.doc_id, *map(str, hits_brute(r.text, items))) for r in odd_docs.collect())
    assert Counter((r.doc_id, str(r.n_words), str(r.n_hit), str(r.items)) for r in got) == texts
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_hit
        for m in r.matches:
            assert m.words >= 1 and any(s.start <= m.doc_start and m.doc_start + m.words <= s.end for s in r.spans)
    kept = decontaminate.decontaminate(odd_docs, bench)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.doc_id is None or not r.n_hit} - {6}
    assert decontaminate.matches(no_docs, bench).count() == 0 and decontaminate.matches(odd_docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(6)
    for top, depth in ((3, 20), (70_000, 6)):
        text = np.concatenate((rng.integers(0, top, 500), [0])).astype(np.int32)
        sa = decontaminate.suffix_array(text, depth)

        def suffix(i, text=text, depth=depth):
            part = text[i : i + depth].tolist()
            return part[: part.index(0)] if 0 in part else part

        keys = [suffix(i) for i in sa]
        assert sorted(sa.tolist()) == np.flatnonzero(text).tolist() and keys == sorted(keys)


def test_licenses(spark, no_docs):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0."), (2, "mit license mit license MIT-License"), (3, None), (4, "CC BY\nlicensed under cc by nc 4 0 maybe"),
        (5, "the GNU\n General: Public License!"), (5, "nothing here"), (6, "permission is hereby granted free of charge to any person obtaining a copy of software and documentation files"), (None, "cc by"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = Counter()
    for i, t in rows:
        w = ALNUM.findall(low(t))
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        labels, best = {x for _, x in at}, 0.0
        for line in low(t).split("\n"):
            b = set(ALNUM.findall(line))
            for label, template in licenses.TEMPLATES:
                s = set(licenses.tokens(template))
                if len(s & b) / len(s) >= 0.8:
                    labels.add(label)
                    best = max(best, len(s & b) / len(s))
        places = [k for k, _ in at]
        want[i, len(w), len(at), min(places, default=None), max(places, default=None), str(sorted({x for _, x in at})), str(sorted(labels)), round(best, 6)] += 1
    got = licenses.license_scan(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, str(r.base_labels), str(r.labels), round(r.score, 6)) for r in got) == want
    assert any("apache-2.0" in r.labels for r in got) and any("mit-license" in r.labels for r in got)
    assert licenses.license_scan(no_docs).count() == 0
    sets = licenses.template_sets(licenses.TEMPLATES, 0.8)
    for part in (licenses.license_scan(docs), licenses.scan_once(docs, licenses.PHRASES, sets, licenses.span_of(licenses.TEMPLATES)), licenses.template_matches(docs)):
        plan = part._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert licenses.template_matches(no_docs).count() == 0
    found = {(r.doc_id, r.block, r.label) for r in licenses.template_matches(docs).collect()}
    assert (1, 0, "apache-2.0") in found and (6, 0, "mit-license") in found and not any(i == 3 for i, _, _ in found)


def test_compact_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(7)
    for n, width, top in ((200, 5, 1000), (300, 8, 6), (3, 5, 9), (64, 64, 50)):
        v = rng.integers(1, top, n).astype(np.uint64)
        v[rng.integers(0, n, 3)] = 0
        want = set()
        for c in range(n):
            if not v[c]:
                continue
            lo, hi = c, c
            while lo > 0 and v[lo - 1] > v[c]:
                lo -= 1
            while hi + 1 < n and v[hi + 1] >= v[c]:
                hi += 1
            if hi - lo + 1 >= width:
                want.add((lo, c, hi))
        assert set(zip(*map(np.ndarray.tolist, substring_dedup.compact_windows(v, width)), strict=True)) == want


def test_substring_dedup(spark, odd_docs, no_docs):
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(f"r{int(x)}" for x in rng.integers(0, 10**6, n))
    passage, other = word(70), word(60)
    near = passage.split()
    near[35] = "changed"
    docs = [(1, f"{word(30)} {passage} {word(80)}"), (2, f"{passage} {word(10)}"), (3, f"{word(90)} {' '.join(near)}"), (4, word(300)), (5, f"{word(5)} {other} {word(5)}"), (6, other), (7, other), (8, f"{word(40)} {' '.join(passage.split()[:30])}"), (9, "a few words"), (10, "a few words")]
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert {i: r.class_id for i, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 5, 8: 8, 9: 9, 10: 10}
    assert [got[i].n_links > 0 for i in range(1, 9)] == [True, True, True, False, True, True, True, False]
    assert 65 <= got[1].repeated_words <= 75 and got[4].spans == [] and got[7].repeated_words == 60
    odd = {r.doc_id: r for r in substring_dedup.substring_dedup(odd_docs).collect()}
    assert odd[20].class_id == odd[21].class_id == 20 and odd[5].class_id == 5 and len(odd) == len({r.doc_id for r in odd_docs.collect()} - {None})
    assert substring_dedup.substring_dedup(no_docs).count() == 0
