import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from lintel.llm import batches, hmm, langid, rules, toxicity

from ..conftest import DATA
from .conftest import FIELDS, prose


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet").cache()


# --- language


def test_languages_of_texts_not_learnt_from(docs):
    rows = langid.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_language_is_learnt_only_from_the_rest(spark, docs):
    """Wrong languages of held-out rows change nothing."""
    from pyspark.sql import functions as F

    wrong = docs.withColumn("lang", F.when(batches.remainder("doc_id", 4) == 2, "xx").otherwise(F.col("lang")))
    assert sorted(langid.predicted(wrong).collect()) == sorted(langid.predicted(docs).collect())


def test_cosines_are_those_of_whole_bundles(monkeypatch):
    """Against vectors added up one trigram at a time."""
    monkeypatch.setattr(langid, "TOGETHER", 3)
    monkeypatch.setattr(langid, "AT_ONCE", 50)
    langs = {k: langid.bundle(*grams(t))[0] for k, t in (("a", prose(1, 50)), ("b", prose(2, 50).replace("k", "w")))}
    profiles = langid.Profiles(langs)
    texts = [prose(5, 30), "", "x", "Ñandú 12 über, über!", prose(6, 400), None, prose(7, 3)]
    found, n = profiles.cosines(pa.array([t or "" for t in texts]))
    for own, count, text in zip(found, n, texts, strict=True):
        vector = np.zeros(langid.DIMENSIONS)
        runs = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        for word in runs:
            points = [langid.EDGE, *map(ord, word), langid.EDGE]
            for x, y, z in zip(points, points[1:], points[2:], strict=False):
                vector += np.roll(langid.letter_vector(x), 2).astype(int) * np.roll(langid.letter_vector(y), 1) * langid.letter_vector(z)
        assert count == sum(map(len, runs))
        assert np.allclose(own, profiles.matrix @ vector / max(np.linalg.norm(vector), 1e-9), atol=1e-5)


def grams(text):
    _, codes, vocabulary = batches.words(pa.array([text]))
    at, own = langid.trigrams(vocabulary)
    each = np.concatenate([own[at[c] : at[c + 1]] for c in codes])
    values, n = np.unique(each, return_counts=True)
    return values, n[:, None].astype(float)


def test_languages_of_hard_texts(hard_docs, no_docs):
    rows = langid.predicted(hard_docs).collect()
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert len(rows) == hard_docs.count() and {0, 1, 2, 8, 9} <= und and 3 not in und
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert langid.predicted(no_docs).count() == 0
    assert {r.lang_pred for r in langid.predicted(hard_docs.withColumn("lang", hard_docs["lang"].substr(9, 1)).replace("", None)).collect()} >= {"und"}


# --- toxicity


def test_toxicity_of_texts_not_learnt_from(docs, labels):
    rows = toxicity.scored(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    clean = [r for r in held if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in held if a.toxic for b in clean]
    assert np.mean(pairs) > 0.8


def brute_grams(word):
    """The padded ORDER-grams of a word as tuples of symbols."""
    own = [ord(c) - 94 if "a" <= c <= "z" else 29 + ord(c) * 11 % 35 for c in word.lower()]
    padded = [toxicity.PAD] * (toxicity.ORDER - 1) + own + [toxicity.END]
    return [tuple(padded[i : i + toxicity.ORDER]) for i in range(len(own) + 1)]


def test_grams_of_words_with_control_characters():
    words = ["good", "a\x01b", "\x02", "x\x02y\x02z", "".join(map(chr, [*range(1, 9), *range(14, 32), 127])), "İi", "vile"]
    at, keys = toxicity.spelt(pa.array(words))
    found = [[tuple(int(k) >> toxicity.BITS * s & 63 for s in range(toxicity.ORDER - 1, -1, -1)) for k in keys[a:b]] for a, b in zip(at[:-1], at[1:], strict=True)]
    assert found == [brute_grams(w) for w in words]


def test_ratios_are_those_of_a_plain_kneser_ney_model():
    rng = np.random.default_rng(4)
    by_class = {y: ["".join(rng.choice(list("abc\x02"), rng.integers(1, 5))) for _ in range(60)] for y in (0, 1)}
    counts = {y: Counter(g for w in ws for g in brute_grams(w)) for y, ws in by_class.items()}
    grams = set(counts[0]) | set(counts[1])
    d = toxicity.DISCOUNT
    ending = [{g[-n:] for g in grams} for n in range(toxicity.ORDER + 1)]

    def continued(gram):
        """Probability of the last symbol by continuation counts, interpolated down to the uniform one."""
        if not gram:
            return 1 / 64
        size = len(gram)
        after = Counter(g[-size:] for g in ending[size + 1] if g[-size:-1] == gram[:-1])
        if not after:
            return continued(gram[1:])
        total = sum(after.values())
        return max(after[gram] - d, 0) / total + d * len(after) / total * continued(gram[1:])

    def likely(y, gram):
        after = {g: n for g, n in counts[y].items() if g[:-1] == gram[:-1]}
        total, back = sum(after.values()), continued(gram[1:])
        return max(after.get(gram, 0) - d, 0) / total + d * len(after) / total * back if total else back

    import pandas as pd

    number = lambda g: sum(x << toxicity.BITS * i for i, x in enumerate(g[::-1]))
    model = toxicity.Ratios.fit(pd.DataFrame([(number(g), counts[1][g], counts[0][g]) for g in grams], columns=["gram", "n1", "n0"]))
    words = [*by_class[0][:20], *by_class[1][:20], "abcabc", "zzz", "\x02\x01"]
    expected = [sum(math.log(likely(1, g) / likely(0, g)) for g in brute_grams(w)) for w in words]
    assert model.of_words(pa.array(words)) == pytest.approx(expected, abs=1e-5)


def test_control_characters_move_no_scores(spark):
    rows = [(i, ("good day " if i % 2 else "vile day ") * 5 + ("" if i % 3 else "\x02 \x01x " + "".join(map(chr, range(1, 32)))), None, None, 1) for i in range(60)]
    docs = spark.createDataFrame(rows, FIELDS)
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(60)], "doc_id bigint, quality int, toxic int")
    found = {r.doc_id: r.score for r in toxicity.scored(docs, labels).collect()}
    assert all((found[i] > 0.5) == (i % 2 == 0) for i in found)


def test_least_hashes(spark):
    from pyspark.sql import functions as F

    df = spark.range(20_000).withColumn("h", F.xxhash64("id"))
    every = sorted((r.h, r.id) for r in df.collect())
    assert sorted((r.h, r.id) for r in batches.least_hashed(df, "h", "id", 500, 20_000).collect()) == every[:500]
    assert batches.least_hashed(df, "h", "id", 30_000, 20_000).count() == 20_000


def test_ratios_leave_rare_expressions_to_the_shared_backoff():
    at, keys = toxicity.spelt(pa.array(["good", "day", "vile"]))
    import pandas as pd

    counts = pd.DataFrame({"gram": keys, "n1": [50] * at[2] + [40] * (len(keys) - at[2]), "n0": [50] * at[2] + [0] * (len(keys) - at[2])}).groupby("gram", as_index=False).sum()
    good, vile, unseen = toxicity.Ratios.fit(counts).of_words(pa.array(["good", "vile", "xyzzy"]))
    assert abs(good) < 0.5 < 1 < vile and abs(unseen) < 0.5


def test_other_characters_use_all_symbols_left():
    text = "".join(chr(i) for i in range(0x430, 0x450))
    # a letter and the end behind it
    assert len(np.unique(toxicity.spelt(pa.array(list(text)))[1])) == 2 * len(text)


def test_expressions_seen_once_count(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    at, keys = toxicity.spelt(pa.array(["good", "vile"]))
    counts = pd.DataFrame({"gram": keys, "n1": [50] * at[1] + [1] * (len(keys) - at[1]), "n0": [50] * at[1] + [0] * (len(keys) - at[1])}).groupby("gram", as_index=False).sum()
    model = toxicity.Ratios.fit(counts)
    assert set(keys) == set(model.grams) and model.of_words(pa.array(["vile"]))[0] > 0.1
    rows = spark.createDataFrame([(1, 0, "good vile"), (0, 1, "good day")], "y int, fold int, text string")
    found = toxicity.class_counts(rows, "y", "fold", "text").agg(F.count("*")).first()[0]
    assert found == len(set(toxicity.spelt(pa.array(["good", "vile", "day"]))[1]))


def test_toxicity_of_hard_texts(spark, hard_docs, no_docs, labels):
    some = spark.createDataFrame([(100, 0, 1), (100, 0, 1), (101, 1, 0), (102, 1, None), (None, 1, 1), (7, 1, 0), (7, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity.scored(hard_docs, some).count() == hard_docs.count()
    assert toxicity.scored(hard_docs, labels.limit(0)).filter("score = 0").count() == hard_docs.count()
    assert toxicity.scored(no_docs, labels).count() == 0
    model = toxicity.Toxicity.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    assert model.score(hard_docs, extra=tuple(hard_docs.columns), name="score_").count() == hard_docs.count()


# --- rules


def brute_features(text):
    words = [w for w in "".join(" " if c in rules.SPACES else c for c in text or "").split(" ") if w]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.strip(rules.SPACES)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_counts_of_texts(docs, hard_docs, no_docs):
    for table in (docs, hard_docs):
        texts = sorted((r.doc_id if r.doc_id is not None else -1, *brute_features(r.text)) for r in table.select("doc_id", "text").collect())
        rows = sorted((r.doc_id if r.doc_id is not None else -1, *(r[c] for c in rules.COUNTS)) for r in rules.features(table).collect())
        assert rows == texts
    assert rules.features(no_docs).count() == 0


def test_verdicts(docs, labels, hard_docs, no_docs):
    rows = rules.judged(docs, labels).join(labels, "doc_id").collect()
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)
    assert np.mean([r.kept == (r.quality == 1) for r in rows if not r.base_failed]) > 0.95
    assert rules.judged(hard_docs, labels).count() == hard_docs.count()
    assert rules.judged(no_docs, labels).count() == 0
    assert rules.judged(docs, labels.limit(0)).filter("kept = base_failed").count() == 0


def test_covering_finds_a_conjunction(spark):
    rng = np.random.default_rng(1)
    x = {"a": rng.random(2000), "b": rng.random(2000), "c": rng.random(2000)}
    y = np.where((x["a"] > 0.7) & (x["b"] <= 0.4) | (x["c"] > 0.95), 0, 1)
    found = rules.learn(x, y)
    hit = np.zeros(2000, bool)
    for rule in found:
        hit |= rules.covered(rule.conditions, x)
    assert np.mean(hit == (y == 0)) > 0.97 and all(len(r.conditions) <= 4 for r in found)


# --- hidden Markov model


def test_base_scores_are_exact_and_the_chain_is_better(docs):
    rows = hmm.judged(docs).collect()
    tokens = {r.doc_id: [*(w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in rules.SPACES else c for c in r.text or "").split(" ") if w), "\n"] for r in docs.collect()}
    c = Counter(w for d, ws in tokens.items() if crc(d) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in rows:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id) % 7 == 2, len(own), sum(w in c for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def random_chain(rng, events):
    chain = hmm.Chain(*(rng.random(s) for s in [hmm.STATES, (hmm.STATES, hmm.STATES), (events, hmm.STATES)]))
    return hmm.Chain(chain.start / chain.start.sum(), chain.step / chain.step.sum(1, keepdims=True), chain.emit / chain.emit.sum(0))


def test_forward_is_the_sum_over_all_paths():
    chain = random_chain(np.random.default_rng(2), 5)
    texts = [[1, 4], [0, 2, 3], [4]]
    offsets = np.cumsum([0, *map(len, texts)])
    got, _, _ = chain.forward(offsets, np.concatenate(texts))

    def likelihood(text):
        total = 0.0
        for path in np.ndindex(*[hmm.STATES] * len(text)):
            p = chain.start[path[0]] * chain.emit[text[0], path[0]]
            for t in range(1, len(text)):
                p *= chain.step[path[t - 1], path[t]] * chain.emit[text[t], path[t]]
            total += p
        return math.log(total)

    assert got == pytest.approx([likelihood(t) for t in texts], rel=1e-10)


@pytest.mark.parametrize("few", [0, 2, 64])
def test_texts_scaled_now_and_then_count_as_in_a_plain_recursion(monkeypatch, few):
    monkeypatch.setattr(hmm, "FEW", few)
    chain, rng = random_chain(np.random.default_rng(4), 6), np.random.default_rng(6)
    texts = [rng.integers(0, 6, n) for n in (20, 1, 8, 9, 2, 33)]
    offsets = np.cumsum([0, *map(len, texts)])
    likelihood, start, moves, emitted = 0.0, np.zeros(hmm.STATES), np.zeros((hmm.STATES,) * 2), np.zeros((6, hmm.STATES))
    for text in texts:
        alpha, beta = [chain.start * chain.emit[text[0]]], [np.ones(hmm.STATES)]
        for e in text[1:]:
            alpha.append(alpha[-1] @ chain.step * chain.emit[e])
        for e in text[:0:-1]:
            beta.insert(0, chain.step @ (chain.emit[e] * beta[0]))
        total = alpha[-1].sum()
        likelihood += np.log(total)
        start += alpha[0] * beta[0] / total
        for t, e in enumerate(text):
            emitted[e] += alpha[t] * beta[t] / total
            if t:
                moves += alpha[t - 1][:, None] * chain.step * (chain.emit[e] * beta[t]) / total
    got = chain.judged(offsets, np.concatenate(texts))
    for a, b in zip(got, (likelihood, start, moves, emitted), strict=True):
        assert np.allclose(a, b, rtol=1e-11, atol=0)
    scales = chain.forward(offsets, np.concatenate(texts))[2]
    # only places 0, 8, 16, 24 and 32 of texts that are as long; before, all were scaled
    assert (scales != 1).sum() == sum(-(-len(text) // hmm.SCALED) for text in texts)


def test_training_never_lowers_the_likelihood():
    rng = np.random.default_rng(3)
    chain = random_chain(rng, 6)
    offsets, events = np.array([0, 7, 9, 30]), rng.integers(0, 6, 30)
    before = chain.forward(offsets, events)[0].sum()
    for _ in range(5):
        start, moves, emitted = chain.expected(offsets, events)
        assert emitted.sum() == pytest.approx(30) and moves.sum() == pytest.approx(27) and start.sum() == pytest.approx(3)
        chain = hmm.Chain(start / start.sum(), moves / moves.sum(1, keepdims=True), emitted / emitted.sum(0))
        after = chain.forward(offsets, events)[0].sum()
        assert after >= before - 1e-9
        before = after


def test_rounds_over_all_texts_settle(docs):
    vocabulary = hmm.Vocabulary.of(hmm.word_counts(docs, "text"))
    chain = hmm.trained(docs, vocabulary)
    offsets, events, _, _ = vocabulary.read(pa.array([r.text or "" for r in docs.select("text").collect()]))
    before = chain.forward(offsets, events)[0].sum()
    after = hmm.Chain.of(*chain.expected(offsets, events), vocabulary).forward(offsets, events)[0].sum()
    assert after - before <= 1e-3 * abs(before)


def test_a_round_hands_on_few_rows_and_reads_texts_as_laid(docs, monkeypatch):
    made = []
    monkeypatch.setattr(hmm, "map_arrow", lambda *args: made.append(batches.map_arrow(*args)) or made[-1])
    vocabulary = hmm.Vocabulary.of(hmm.word_counts(docs, "text"))
    del made[:]
    hmm.trained(docs, vocabulary)
    coded, of_tasks = made[0].collect(), made[1]
    # before, a row for each event that a task had met
    assert of_tasks.count() <= of_tasks.rdd.getNumPartitions() * (vocabulary.events // 512 + 2) < vocabulary.events
    sizes = [np.frombuffer(r.sizes, np.int32) for r in coded]
    offsets, events, _, _ = vocabulary.read(pa.array([r.text or "" for r in docs.select("text").collect()]))
    assert sorted(np.concatenate(sizes)) == sorted(np.diff(offsets)) and all((np.diff(x) <= 0).all() for x in sizes)
    chain = hmm.Chain.first(vocabulary)
    own = [chain.counted(hmm.places(x), np.frombuffer(r.events, vocabulary.code())) for x, r in zip(sizes, coded, strict=True)]
    for part, whole in zip(zip(*own, strict=True), chain.judged(offsets, events), strict=True):
        assert np.allclose(sum(part), whole, rtol=1e-11, atol=0)


def test_tables_of_tasks_are_added_up(spark):
    tables = [np.random.default_rng(k).integers(-3, 4, (1300, hmm.STATES)) * (np.arange(1300) % (k + 2) == 0)[:, None] / 4 for k in range(4)] + [np.zeros((1300, hmm.STATES))]
    rows = [row for t in tables for row in zip(*(x if isinstance(x, list) else x.tolist() for x in hmm.parted(t).values()), strict=True)]
    assert np.array_equal(hmm.added(spark.createDataFrame(rows, hmm.PARTED), 1300), sum(tables))


def test_rare_words_are_joined(docs, monkeypatch):
    before = {r.doc_id: r for r in hmm.judged(docs).collect()}
    monkeypatch.setattr(hmm, "KNOWN", 500)
    monkeypatch.setattr(hmm, "HEAD", 300)
    for r in hmm.judged(docs).collect():
        assert r.n_known == before[r.doc_id].n_known and r.base_score == pytest.approx(before[r.doc_id].base_score, rel=1e-9)


def test_language_model_of_hard_texts(spark, hard_docs, no_docs):
    rows = hmm.judged(hard_docs).collect()
    assert len(rows) == hard_docs.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert hmm.judged(no_docs).count() == 0
    only_held = spark.createDataFrame([(i, "a b", "en", "s", 3) for i in range(200) if crc(i) % 7 == 2], FIELDS)
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in hmm.judged(only_held).collect())
