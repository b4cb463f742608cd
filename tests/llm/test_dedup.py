import hashlib
import itertools
import pathlib
import random
import time
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lintel.llm import batches, components, jaccard, queries, suffixes, units, vectors

from .conftest import prose


def least_by_links(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("small", [0, 1000])
def test_components(spark, small):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(40)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)] + [(7, 7), (9, None)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint").repartition(5), small).collect()}
    real = [(a, b) for a, b in links if b is not None and a != b]
    assert found == least_by_links({x for p in real for x in p}, real)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=60))
def test_least_reachable(links):
    nodes, label = components.least_reachable(*np.array(links).T)
    assert dict(zip(nodes.tolist(), label.tolist(), strict=True)) == least_by_links({x for p in links for x in p}, links)


# --- n-gram Jaccard join


def shingled(text, size):
    words = (text or "").translate(units.LOWER).split()
    words = [w for w in "".join(c if c not in "\x0b\x0c\r\t\n" else " " for c in (text or "").translate(units.LOWER)).split(" ") if w]
    return frozenset(zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else frozenset([tuple(words)]) if words else frozenset()


def brute_join(rows, size, num, den):
    sets = defaultdict(set)
    for r in rows:
        sets[r.doc_id].add(shingled(r.text, size))
    nodes = [d for d in sets if d is not None]
    links = [(a, b) for a in nodes for b in nodes if a < b and any(s and t and den * len(s & t) >= num * len(s | t) for s in sets[a] for t in sets[b])]
    return least_by_links(nodes, links)


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join("edit" + str(rng.randrange(10**6)) if rng.random() < share else w for w in text.split(" "))


@pytest.mark.parametrize(("size", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 70, 100)])
def test_join_finds_every_link(spark, size, num, den):
    rows = [(i, prose(i, 3 + i % 70)) for i in range(60)]
    for k in range(6):
        base = prose(1000 + k, [8, 20, 40, 90, 200, 500][k]).replace("\n", " ")
        rows += [(1000 + 100 * k + j, edited(base, share, j)) for j, share in enumerate([0, 0, 0.004, 0.01, 0.01, 0.02, 0.02, 0.03, 0.05, 0.2])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    expected = brute_join(docs.collect(), size, num, den)
    found = jaccard.joined(docs, size, num, den).collect()
    assert {r.doc_id: r.component_id for r in found} == expected
    assert len(set(expected.values())) < len(expected)
    assert all(r.n_shingles == len(shingled(dict(rows)[r.doc_id], size)) for r in found)


@pytest.mark.parametrize(("block", "sets", "tile", "pivots"), [(200, 128, 1024, 8), (200_000, 7, 5, 2), (150, 9, 6, 1)])
def test_join_in_blocks(spark, monkeypatch, block, sets, tile, pivots):
    """Large signatures and groups, of near copies and of texts with a shared passage, in small tiles."""
    for name, value in (("BLOCK", block), ("SETS", sets), ("TILE", tile), ("PIVOTS", pivots)):
        monkeypatch.setattr(jaccard, name, value)
    base, other = prose(5, 60).replace("\n", " "), prose(6, 40).replace("\n", " ")
    rows = [(i, edited(base, 0.02, i)) for i in range(50)] + [(100 + i, f"{other} {prose(200 + i, 5 + i % 9)}") for i in range(40)] + [(300 + i, prose(300 + i, 20)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in jaccard.joined(docs, 3, 90, 100).collect()} == brute_join(docs.collect(), 3, 90, 100)
    assert {r.doc_id: r.component_id for r in jaccard.joined(docs, 5, 80, 100).collect()} == brute_join(docs.collect(), 5, 80, 100)


def test_chance_signatures_are_rare():
    """Of unrelated sets no signature is shared by many, for empty choices count together."""
    rng = np.random.default_rng(6)
    n, size = 60_000, 40
    hashes = np.sort(rng.integers(0, 2**63, (n, size)).astype(np.uint64), 1).ravel()
    _, sigs = jaccard.signatures(np.arange(n + 1) * size, hashes, jaccard.Bands(80, 100))
    _, counts = np.unique(sigs, return_counts=True)
    assert counts.max() < 30 and len(sigs) < 60 * n


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([(90, 100), (80, 100), (70, 100)]))
def test_sets_that_link_share_a_signature(seed, threshold):
    num, den = threshold
    rng = np.random.default_rng(seed)
    bands = jaccard.Bands(num, den)
    n = int(rng.integers(2, 300))
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    b = a.copy()
    while len(b) > 1:
        c = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 else np.unique(np.append(b, rng.integers(0, 2**63, 1).astype(np.uint64)))
        both = len(np.intersect1d(a, c))
        if den * both < num * (len(a) + len(c) - both):
            break
        b = c
    row, sigs = jaccard.signatures(np.array([0, len(a), len(a) + len(b)]), np.concatenate((a, b)), bands)
    assert np.array_equal(a, b) or set(sigs[row == 0]) & set(sigs[row == 1])


def test_join_of_hard_texts(hard_docs, no_docs):
    rows = jaccard.joined(hard_docs).collect()
    assert len(rows) == hard_docs.count()
    expected = brute_join(hard_docs.collect(), 5, 80, 100)
    assert all(r.component_id == expected.get(r.doc_id) for r in rows)
    assert jaccard.joined(no_docs).count() == 0


# --- suffixes


def brute_repeats(rows, span):
    seen, out = set(), {}
    for doc, text in rows:
        data, cut = (text or "").encode(), []
        for p in range(len(data) - span + 1):
            w = data[p : p + span]
            if w not in seen:
                seen.add(w)
            elif cut and p <= cut[-1][1]:
                cut[-1][1] = p + span
            else:
                cut.append([p, p + span])
        out[doc] = (len(data), sum(b - a for a, b in cut), len(cut), hashlib.sha256(suffixes.without(data, [tuple(c) for c in cut])).hexdigest())
    return out


def digested(docs, span=100):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digests(docs, span).collect()}


def test_repeats_are_exactly_those_of_brute_force(spark):
    passages = [prose(900 + k, 40) for k in range(4)]
    rows = [(i, prose(i, 30) + passages[i % 4][i : 150 + i] + prose(i + 500, 10)) for i in range(40)]
    rows += [(50, "ab" * 400), (51, "a" * 130), (52, prose(3, 30) * 3), (53, None), (54, ""), (55, "é" * 300), (56, rows[3][1]), (57, rows[3][1][7:])]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert digested(docs) == brute_repeats(sorted(rows), 100)


def test_hashes_of_many_contents_are_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "MANY", 3)
    line = prose(77, 30)
    rows = [(i, prose(i, 12) + line + prose(i + 300, 12)) for i in range(30)] + [(40, line * 2), (41, "z" * 260)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert digested(docs) == brute_repeats(rows, 100)


def test_long_texts_are_hashed_in_windows(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HASHED", 700)
    text = prose(5, 900)
    rows = [(1, text), (2, prose(6, 20) + text[333:2900] + prose(7, 300)), (3, text[-650:] * 3), (4, "ab" * 900), (5, "short"), (6, text[690:790] + "|" + text[700:799])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert digested(docs) == brute_repeats(rows, 100)


def test_repeats_come_from_the_index(spark, monkeypatch):
    """Without it, only runs that are repeated as a whole are found."""
    line = prose(77, 40)
    rows = [(i, prose(i, 12) + line + prose(i + 300, 12)) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    whole = digested(docs)
    monkeypatch.setattr(suffixes, "later", lambda doc, start, strings, span: (doc[:0], start[:0]))
    assert digested(docs) != whole == brute_repeats(rows, 100)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=60), min_size=1, max_size=6))
def test_index_matches_brute_force(texts):
    strings = [t.encode() for t in texts]
    text = np.frombuffer(bytes([suffixes.SEPARATOR]).join(strings) or b"\xff", np.uint8)
    order = suffixes.suffix_order(text)
    data = text.tobytes()
    assert [data[i:] for i in order] == sorted(data[i:] for i in range(len(data)))

    def shared(i, j):
        n = 0
        while i + n < len(data) and j + n < len(data) and data[i + n] == data[j + n]:
            n += 1
        return n

    index = suffixes.RunIndex(text)
    behind, length = index.streamed()
    for i, j in zip(order, order[1:], strict=False):
        assert (behind[j], length[j]) == (i, shared(i, j))
    # one sample for each run of the transform
    before = [data[i - 1] if i else -1 for i in order]
    assert len(index.at) == len([*itertools.groupby(before)])
    for span in (1, 3, 8):
        assert index.earliest(span).tolist() == [data.find(data[i : i + span]) if i + span <= len(data) else i for i in range(len(data))]
    where, start = suffixes.later(np.arange(len(strings)), np.zeros(len(strings), np.int64), strings, 8)
    seen, expected = set(), set()
    for d, s in enumerate(strings):
        for p in range(len(s) - 7):
            if s[p : p + 8] in seen:
                expected.add((d, p))
            seen.add(s[p : p + 8])
    assert set(zip(where.tolist(), start.tolist(), strict=True)) == expected


def test_repeats_in_hard_texts(hard_docs, no_docs):
    once = hard_docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted((r.doc_id, r.text) for r in once.select("doc_id", "text").collect())
    assert digested(once) == brute_repeats(rows, 100)
    assert suffixes.digests(hard_docs).count() == hard_docs.count()
    kept = suffixes.shortened(hard_docs)
    assert kept.columns == hard_docs.columns and kept.count() == hard_docs.count()
    assert all(r.text is None or len(r.text) == r.n_chars for r in kept.collect())
    assert suffixes.digests(no_docs).count() == 0 == suffixes.shortened(no_docs).count()


def test_one_of_repeated_rows_keeps_its_text(spark, hard_docs):
    from pyspark.sql import functions as F

    text = prose(11, 60)
    docs = spark.createDataFrame([(7, text), (7, text), (8, text), (9, prose(12, 50)), (9, prose(13, 40))], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_removed) for r in suffixes.digests(docs).collect()) == [(7, 0), (7, len(text)), (8, len(text)), (9, 0), (9, 0)]
    kept = [(r.doc_id, r.text) for r in suffixes.shortened(docs).collect()]
    assert sorted(kept) == sorted([(7, text), (7, ""), (8, ""), (9, prose(12, 50)), (9, prose(13, 40))])
    rows = sorted((r.doc_id, r.h, r.text or "") for r in hard_docs.filter("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("h")).collect())
    expected = brute_repeats([(i, r[2]) for i, r in enumerate(rows)], 100)
    found = [tuple(r) for r in suffixes.digests(hard_docs).collect() if r.doc_id is not None]
    assert sorted(found) == sorted((r[0], *expected[i]) for i, r in enumerate(rows))


def test_shortened_keeps_whole_characters(spark):
    passage = "ñ" * 20 + prose(7, 40)
    docs = spark.createDataFrame([(1, "ä" + passage + "x", 5), (2, "ä" + passage + "é", 5)], "doc_id bigint, text string, n_chars bigint")
    rows = {r.doc_id: r for r in suffixes.shortened(docs).collect()}
    assert rows[1].text == "ä" + passage + "x" and rows[2].text in ("é", "") and rows[2].n_chars == len(rows[2].text)


# --- units


def test_units_keep_the_first(spark, hard_docs, no_docs):
    long = "one two three four five six seven eight nine."
    rows = [(1, f"Start here. {long}\nshort line\n"), (2, f"{long.upper()} tail"), (0, f"x y\n  One  two three four five six seven eight nine.\n{long}"), (3, "short line\nshort line")]
    found = {r.doc_id: r for r in units.digests(spark.createDataFrame(rows, "doc_id bigint, text string"), "sentence", 8).collect()}
    text = dict(rows)
    assert {d: r.n_removed for d, r in found.items()} == {0: 1, 1: 1, 2: 1, 3: 0}
    a, b = map(int, found[1].removed.split("-"))
    assert text[1][a:b].strip() == long and found[1].kept_md5 == hashlib.md5((text[1][:a] + text[1][b:]).encode()).hexdigest()
    assert units.digests(hard_docs).count() == hard_docs.count() and units.digests(no_docs).count() == 0
    lines = {r.doc_id: r.n_removed for r in units.digests(spark.createDataFrame(rows, "doc_id bigint, text string"), "line", 2).collect()}
    assert lines[3] == 2


def test_paragraphs_are_units(spark):
    rows = [(1, "one two\nthree\n\nother"), (2, "new\n \nOne  two\nthree\n\n\n\nother\n"), (3, None)]
    found = {r.doc_id: (r.n_removed, r.n_chars_removed) for r in units.digests(spark.createDataFrame(rows, "doc_id bigint, text string"), "paragraph").collect()}
    assert found == {1: (0, 0), 2: (2, len("One  two\nthree\n\n") + len("other\n")), 3: (0, 0)}


def test_lines_of_any_length_and_script_are_units(spark, tmp_path):
    rows = [(1, "a b\n\n \t\n東京都は日本の首都です\nShort one. Short two.\n"), (2, "東京都は日本の首都です\nA  b\n\n \nnew"), (3, "x\nx\nshort one. short two."), (4, None), (5, ""), (6, "\n\n\n")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, queries.op2_line_dedup(spark, str(tmp_path)).collect()))
    assert [r[1] for r in found] == [0, 2, 2, 0, 0, 0]
    with duckdb.connect() as sql:
        sql.execute(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
        assert found == sorted(sql.sql(queries.LINE_DEDUP).fetchall())


# --- disk


def test_a_checkpoint_in_use_keeps_no_shuffle_files(spark):
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    batches.released(spark.range(1))
    time.sleep(1)
    files = lambda: {str(f) for f in pathlib.Path(folder).rglob("shuffle_*.data")}
    before = files()
    kept = batches.checkpointed(spark.range(100_000).select("id", F.xxhash64("id").alias("h")).repartition(5, "h"))
    end = time.time() + 20
    while files() - before and time.time() < end:
        batches.released(kept)
        time.sleep(0.2)
    assert not files() - before
    assert kept.count() == 100_000
    assert spark.conf.get(batches.CLEANUP, None) in (None, "false")


# --- vectors


def brute_vectors(rows, threshold):
    good = [(k, lab, np.array(v, float)) for k, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, n = [], defaultdict(int)
    for i, (a, la, x) in enumerate(good):
        for b, lb, y in good[:i]:
            if la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links.append((a, b))
                n[a] += 1
                n[b] += 1
    least = least_by_links([r[0] for r in rows], links)
    return {k: (n[k], least[k], least[k] == k) for k, _, _ in rows}


@pytest.mark.parametrize(("cell", "block", "step"), [(4096, 2048, 32 << 20), (20, 7, 32 << 20), (20, 7, 200)])
def test_vectors_lose_no_link(spark, monkeypatch, cell, block, step):
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "STEP_BYTES", step)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * [0.05, 0.2, 0.4][i % 3]).astype(np.float32).tolist(), i % 2) for i in range(150)]
    rows += [(200 + i, rows[0][1], 0) for i in range(5)] + [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] + [1.0] * 7, 1), (303, [None] + [1.0] * 7, 1), (304, rows[1][1], None), (305, [1.0, 2.0], 1), (306, [2.0, 4.0], 1), (307, [], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(4)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.deduplicated(df).collect()} == brute_vectors(rows, 0.93)


def test_rounds_lose_no_link_and_bound_what_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 100)
    monkeypatch.setattr(vectors, "BLOCK", 20)
    monkeypatch.setattr(vectors, "SHUFFLE_BYTES", 0)
    rng, shuffled, tiled = np.random.default_rng(8), [], vectors.tiled
    base = rng.normal(size=(100, 12))
    rows = [(i, (base[i % 100] + rng.normal(size=12) * 0.3 * (i >= 100)).astype(np.float32).tolist(), 0) for i in range(400)]

    def counted(*args):
        shuffled.append(tiled(*args).agg(F.sum(F.length("data"))).first()[0] or 0)
        return tiled(*args)

    monkeypatch.setattr(vectors, "tiled", counted)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.deduplicated(df).collect()} == brute_vectors(rows, 0.93)
    # without structure each vector is copied many times in all, but about once in a round
    assert sum(shuffled) > 5 * 400 * 48 and max(shuffled) <= 2 * 400 * 48


def test_centroids_do_not_depend_on_the_steps():
    x = vectors.unit([v.tobytes() for v in np.random.default_rng(3).normal(size=(500, 16))])
    assert np.allclose(vectors.centroids(x, 40, 1), vectors.centroids(x, 40, 1 << 20))


def test_no_vectors(spark):
    assert vectors.deduplicated(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_ties_of_a_group_come_in_proportion_to_it_however_many_tasks_have_signatures_of_it(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(400)]
    texts = []
    for i in range(300):
        own = list(base)
        for at in rng.integers(0, 400, 3):
            own[at] = f"x{i}_{at}"
        texts.append((i, " ".join(own)))
    docs = spark.createDataFrame(texts, "node bigint, text string").repartition(4)
    sketched = jaccard.described(docs, 5).select(F.col("f1").alias("node"), "n", "sketch").distinct()
    settings_ = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings_}
    try:
        for k, v in settings_.items():
            spark.conf.set(k, v)
        found = jaccard.checkpointed(jaccard.ties(jaccard.signed(docs, 5, 80, 100), sketched, 80, 100))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    tied = components.components(found).agg(F.count("*"), F.countDistinct("component")).first()
    assert tuple(tied) == (300, 1)
    # 3943 ties here; with all pairs met at once, 14341, which is once in each of the 48 tasks
    assert found.count() <= 48 * 300 // 2
