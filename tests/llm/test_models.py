from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from orderloom.llm import quality, toxicity
from orderloom.llm.queries import LLM_QUERIES
from tests.llm.helpers import ODD, docs, nothing, sample

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("query", "column", "least"), [("op7_quality", "quality", 0.9), ("op9_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, query, column, least):
    got = {r.doc_id: r for r in LLM_QUERIES[query](spark, SF).collect()}
    assert len(got) == sample(spark, "documents", "sf0.01").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    labels = sample(spark, "labels", "sf0.01").collect()
    judged = [got[r.doc_id].predicted == r[column] for r in labels if got[r.doc_id].held_out]
    assert len(judged) > 50 and np.mean(judged) >= least


def test_held_out_labels_change_nothing(spark):
    """Flipping the labels that may not be learnt from leaves the weights as they are."""
    table, labels = sample(spark, "documents", "sf0.01"), sample(spark, "labels", "sf0.01")
    allowed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    flipped = labels.withColumn("toxic", F.when(allowed, F.col("toxic")).otherwise(1 - F.col("toxic")))
    weights = [toxicity.train(table, rows, allowed=allowed) for rows in (labels, flipped)]
    assert np.array_equal(*weights)


def test_scores_of_odd_documents(spark):
    labels = spark.createDataFrame([(7, 0), (9, 1), (9, None), (None, 1), (99, 1)], "doc_id long, quality int")
    weights = quality.train(docs(spark), labels)
    got = quality.score(docs(spark), weights)
    assert got.count() == len(ODD) and set(got.columns) == set(docs(spark).columns)
    empty = {r.score for r in got.collect() if not (r.text or "").strip()}
    assert len(empty) == 1 and 0 <= min(empty) <= max(empty) <= 1
    assert quality.score(nothing(spark), weights).count() == 0
    no_labels = quality.train(docs(spark), labels.limit(0))
    assert {r.score for r in quality.score(docs(spark), no_labels).collect()} == {0.5}


def test_sentences_of_odd_documents(spark):
    weights = np.zeros(1 << toxicity.SETTINGS.bits)
    got = toxicity.score(docs(spark), weights).collect()
    assert len(got) == len(ODD)
    assert {r.score for r in got if not (r.text or "").strip()} == {0.0}
    assert all(r.offences == [] for r in got)
    assert toxicity.score(nothing(spark), weights).count() == 0
    kept = toxicity.drop_toxic(docs(spark), weights)
    assert kept.columns == docs(spark).columns and kept.count() == len(ODD)


def test_offending_sentences_are_located(spark):
    clean = "The day was fine. We went out and came home. It rained later."
    rows = [(i, f"{clean} Number {i} passed by. Then we left.", "s") for i in range(200)]
    rows += [(1000 + i, f"{clean} You are a grumbleton, number {i}! Then we left.", "s") for i in range(60)]
    labels = [(i, 0) for i in range(200)] + [(1000 + i, 1) for i in range(60)]
    table = docs(spark, rows, clashing=False)
    weights = toxicity.train(table, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scored = toxicity.score(table, weights).collect()
    assert all((r.score >= 0.5) == (r.doc_id >= 1000) for r in scored)
    for r in scored:
        if r.doc_id >= 1000:
            (offence,) = r.offences
            words = r.text.split()[offence.first_word : offence.first_word + offence.n_words]
            assert offence.sentence == 3 and words[:4] == ["You", "are", "a", "grumbleton,"]


def test_noisy_or():
    got = toxicity.noisy_or(np.array([0.5, 0.5, 0.1]), np.array([0, 0, 2]), 4)
    assert got == pytest.approx([0.75, 0.0, 0.1, 0.0])


# Against plain versions ---------------------------------------------------------------------------

ALL = (1 << 64) - 1


def plain_mixed(x):
    x ^= x >> 31
    x = x * 0x9E3779B97F4A7C15 & ALL
    x ^= x >> 29
    x = x * 0xBF58476D1CE4E5B9 & ALL
    return x ^ (x >> 32)


def digest(word, seed=0):
    return xxhash.xxh64_intdigest(word, seed)


class PlainFtrl:
    """Per-coordinate follow-the-regularised-leader, with dictionaries."""

    def __init__(self, settings):
        self.s, self.z, self.n = settings, defaultdict(float), defaultdict(float)

    def weight(self, place):
        z = self.z[place]
        if abs(z) <= self.s.l1 or self.s.only_positive and z > 0:
            return 0.0
        return -(z - math.copysign(self.s.l1, z)) / ((self.s.beta + math.sqrt(self.n[place])) / self.s.alpha + self.s.l2)

    def step(self, gradients):
        weights = {place: self.weight(place) for place in gradients}
        for place, g in gradients.items():
            sigma = (math.sqrt(self.n[place] + g * g) - math.sqrt(self.n[place])) / self.s.alpha
            self.z[place] += g - sigma * weights[place]
            self.n[place] += g * g


def sigmoid(x):
    return 1 / (1 + math.exp(-min(max(x, -40), 40)))


def in_training_order(rows, labels):
    """(label, text) in the order of the hash of the id that training uses."""
    order = []
    for i, text, _ in rows:
        h = digest(b"train", digest(i.to_bytes(8, "little"), 42))
        order.append((h - (1 << 64) if h >> 63 else h, text, labels[i]))
    return [(label, text) for _, text, label in sorted(order, key=lambda r: r[:2])]


def plain_quality_features(text, bits):
    words = text.encode().split()
    hashes = [digest(w) for w in words]
    pairs = list(zip(hashes, hashes[1:], strict=False))
    kinds = [
        Counter(hashes),
        Counter((plain_mixed(a) * 3 + b) & ALL for a, b in pairs),
        Counter(digest(re.sub(rb"(.)\1+", rb"\1", bytes(map(kind_of, w))), 1) for w in words),
        Counter(1 + (a == b) for a, b in pairs),
    ]
    found = {0: 1.0}
    for counts in kinds:
        for hashed, n in counts.items():
            place = plain_mixed(hashed) % ((1 << bits) - 1) + 1
            assert place not in found  # so few features do not meet
            found[place] = math.sqrt(n / sum(counts.values()))
    return found


def kind_of(c):
    return 65 if 65 <= c < 91 else 97 if 97 <= c < 123 or c > 127 else 48 if 48 <= c < 58 else c


def small_corpus(n):
    rng = random.Random(12)
    good, bad = ["The", "house", "stands", "nearby,", "Öfter", "is"], ["BUY", "now!!!", "$$$", "click", "x1"]
    rows, labels = [], {}
    for i in range(n):
        labels[i] = rng.randrange(2)
        words = rng.choices(good if labels[i] else bad, k=rng.randrange(1, 9)) + rng.choices(good + bad, k=2)
        rows.append((i, " ".join(words), "s"))
    return rows, labels


def test_quality_against_plain_ftrl(spark):
    rows, labels = small_corpus(80)
    settings = quality.SETTINGS
    model = PlainFtrl(settings)
    ordered = [(label, plain_quality_features(text, settings.bits)) for label, text in in_training_order(rows, labels)]
    for _ in range(settings.passes):
        for label, features in ordered:
            p = sigmoid(sum(model.weight(place) * v for place, v in features.items()))
            model.step({place: (p - label) * v for place, v in features.items()})
    table = docs(spark, rows, clashing=False)
    weights = quality.train(table, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in quality.score(table, weights).collect()}
    for i, text, _ in rows:
        features = plain_quality_features(text, settings.bits)
        assert got[i] == pytest.approx(sigmoid(sum(model.weight(place) * v for place, v in features.items())), abs=1e-4)
    assert np.mean([(got[i] >= 0.5) == bool(labels[i]) for i in labels]) > 0.9


def plain_sentences(text):
    """Sentences as lists of words: they end with a line or with a word that ends with a full stop or the like."""
    found = []
    for line in (text or "").split("\n"):
        now = []
        for word in line.encode().split():
            now.append(word)
            if word.rstrip(b"\"')]}\xbb").endswith((b".", b"!", b"?")):
                found.append(now)
                now = []
        found.append(now)
    return [s for s in found if s]


def plain_places(word, bits):
    bare = word.strip(b".,;:!?\"'()[]{}|*&%$#<>").decode().casefold()
    hashes = [digest(bare.encode()), *(digest(bare[:k].encode(), k) for k in toxicity.BEGINNINGS)]
    return [plain_mixed(h) % (1 << bits) for h in hashes]


def plain_sentence_scores(text, weight, bits):
    return [
        sigmoid(toxicity.PRIOR + sum(weight(p) for word in set(s) for p in plain_places(word, bits))) for s in plain_sentences(text)
    ]


def test_toxicity_against_plain_multiple_instance_learning(spark):
    rng = random.Random(13)
    words = ["one", "Two,", "three", "four", "Fünf", "six"]
    rows, labels = [], {}
    for i in range(60):
        labels[i] = int(i % 4 == 0)
        sentences = [" ".join(rng.choices(words, k=rng.randrange(1, 6))) + rng.choice([".", "!\n", ".) ", "\n"]) for _ in range(3)]
        if labels[i]:
            sentences.insert(rng.randrange(3), "you " + rng.choice(["rotter", "Rotters"]) + "! ")
        rows.append((i, " ".join(sentences), "s"))
    settings = toxicity.SETTINGS
    model = PlainFtrl(settings)
    for _ in range(settings.passes):
        for label, text in in_training_order(rows, labels):
            p = plain_sentence_scores(text, model.weight, settings.bits)
            none = math.prod(1 - x for x in p)
            slopes = [-x * none / (1 - none) if label else x for x in p]  # of the loss, by each sentence's log-odds
            gradients = defaultdict(float)
            for sentence, slope in zip(plain_sentences(text), slopes, strict=True):
                for word in set(sentence):
                    for place in plain_places(word, settings.bits):
                        gradients[place] += slope
            model.step(gradients)
    table = docs(spark, rows, clashing=False)
    weights = toxicity.train(table, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(table, weights).collect()}
    for i, text, _ in rows:
        p = plain_sentence_scores(text, model.weight, settings.bits)
        assert got[i].score == pytest.approx(1 - math.prod(1 - x for x in p), abs=1e-6)
        assert [o.sentence for o in got[i].offences] == [k for k, x in enumerate(p) if x >= 0.5]
        assert (got[i].score >= 0.5) == bool(labels[i])


def test_a_column_of_offences_that_is_there_is_replaced(spark):
    table = docs(spark).selectExpr("*", "'mine' as offences")
    got = toxicity.score(table, np.zeros(1 << toxicity.SETTINGS.bits))
    assert got.columns.count("offences") == 1 and got.count() == len(ODD)
    kept = toxicity.drop_toxic(table, np.zeros(1 << toxicity.SETTINGS.bits))
    assert kept.columns == table.columns and {r.offences for r in kept.collect()} == {"mine"}
