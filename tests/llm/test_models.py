"""License scan, language, toxicity and language-model scores: brute force, held-out accuracy, edges."""

import math
import random
import zlib
from collections import Counter

import pytest

from fieldstream.llm import langid, licences, maxent_lm, toxicity

DOCS = "doc_id long, text string, lang string, source string, score int"


def test_license_of_several_in_one_file(spark):
    notices = [t.passage for t in licences.TEMPLATES]
    texts = [" and then other plain prose ".join(notices), *["plain prose of another kind"] * 60]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, component_id string")
    rows = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    assert rows[0]["labels"].split(",") == sorted({t.label for t in licences.TEMPLATES}) and rows[1]["labels"] == ""


def brute_licences(text, templates, idf, rare, rare_words=8, least=0.5, slack=4):
    """Labels and score by trying every template at every place, word by word."""
    ws = licences.words((text or "").encode())
    present = {w for w in ws if rare.get(w)}
    labels, best = set(), 0.0
    for t in templates:
        passage = licences.words(t.passage.encode())
        whole = sum(sorted((idf[w] for w in set(passage) if rare[w]), reverse=True)[:rare_words])
        for start in range(-len(passage), len(ws)):
            agreed = {w for q, w in enumerate(passage) if rare[w] and 0 <= start + q < len(ws) and ws[start + q] == w}
            if not agreed or (len(agreed) < 2 and len(present) > 1) or sum(idf[w] for w in agreed) / whole < least:
                continue
            near = ws[max(0, start - slack) : start + len(passage) + slack]
            keys = [licences.words(k.encode()) for k in t.key_phrases]
            if all(any(near[i : i + len(k)] == k for i in range(len(near))) for k in keys):
                labels.add(t.label)
                best = max(best, min(1.0, sum(idf[w] for w in agreed) / whole))
    base = {label for phrase, label in licences.BASE for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.encode().split()}
    return labels | base, best if best or not base else 0.5


def test_license_scan_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(licences, "WINDOW", 64)
    rng = random.Random(11)
    plain = "the of and software license permission is copy use under terms plain words that say little".split()
    texts = []
    for i in range(60):
        ws = [rng.choice(plain) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            passage = rng.choice(licences.TEMPLATES).passage.split()
            if rng.random() < 0.5:  # some words lost or changed
                passage = [w if rng.random() < 0.93 else "changed" for w in passage]
            at = rng.randint(0, len(ws))
            ws[at:at] = passage
        texts.append(" ".join(ws) if i else None)
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], DOCS)
    index = licences.Index(licences.TEMPLATES, licences.BASE)
    total, counts = licences.document_counts(docs, index)
    assert total == len(texts) and {w: int(counts[i]) for w, i in index.ids.items()} == {w: sum(w in licences.words((t or "").encode()) for t in texts) for w in index.ids}
    idf = {w: math.log((total + 1) / (counts[i] + 1)) + 1e-3 for w, i in index.ids.items()}
    flags = licences.rare_words_of(index, licences.np.array([idf[w] for w in index.vocabulary]), -math.log(0.1))
    rare = {w: bool(flags[i]) for w, i in index.ids.items()}
    found = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    for i, t in enumerate(texts):
        labels, score = brute_licences(t, licences.TEMPLATES, idf, rare)
        assert found[i]["labels"] == ",".join(sorted(labels)) and abs(found[i]["score"] - score) < 1e-9, (i, t)
        assert found[i]["n_words"] == len(licences.words((t or "").encode()))


def test_license_scan_of_a_long_text():
    import tracemalloc

    index = licences.Index(licences.TEMPLATES, licences.BASE)
    idf = licences.np.ones(len(index.vocabulary))
    passage = next(t.passage for t in licences.TEMPLATES if t.label == "zlib")
    ids, _ = index.numbered([(("permission software license the granted use " * 40_000) + passage).encode()])
    tracemalloc.start()
    labels, score = licences.aligned(index, idf, idf > 0, ids[:-1], 8, 0.5, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert labels == {"zlib"} and score == 1.0 and peak < 60 << 20


def test_license_base_and_labels(spark):
    texts = ["Released under the MIT License.", "see the Apache-License and MIT license; mit license", None, "", "GNU General Public License", "Licensed under CC BY-NC 4.0.", "the of and to", "plain words " * 50, "mit  license" * 3]
    docs = spark.createDataFrame([(i, t, None, None, 1) for i, t in enumerate(texts)], DOCS)
    rows = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    assert (rows[0]["n_base"], rows[0]["first_word"], rows[0]["last_word"], rows[0]["base_labels"]) == (1, 3, 3, "mit")
    assert (rows[1]["n_base"], rows[1]["base_labels"], rows[1]["first_word"], rows[1]["last_word"]) == (3, "apache,mit", 2, 7)
    assert rows[2]["n_words"] == 0 and rows[2]["first_word"] is None and rows[2]["labels"] == "" and rows[2]["score"] == 0
    assert rows[4]["base_labels"] == "gpl" and rows[5]["labels"] == "cc-by-nc" and rows[6]["labels"] == ""
    assert rows[8]["n_base"] == 0  # its words are mit, licensemit, licensemit, license
    assert licences.scan(docs.limit(0)).count() == 0


def sentence(rng, language):
    stems = {"en": ("the", "ing", "wh", "tion", "ed", "of"), "de": ("sch", "ein", "ung", "cht", "der", "ü"), "fr": ("eau", "oi", "que", "é", "ment", "le"), "es": ("ción", "os", "ñ", "ado", "lla", "el")}[language]
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 40)))


def test_language_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang := rng.choice(["en", "de", "fr", "es"])), lang, "s", 1) for i in range(600)] + [(1000, None, "en", "s", 1), (1001, "123 !?", "en", "s", 1), (1002, "", None, None, None), (None, "the of ing", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    found = langid.predict(docs, langid.fit(docs)).collect()
    held = [r for r in found if r["held_out"] and r["doc_id"] < 600]
    truth = {r[0]: r[2] for r in rows}
    assert len(held) > 80 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) > 0.95 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found if r["doc_id"] is not None)
    by_id = {r["doc_id"]: r for r in found}
    assert [by_id[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in found)


def test_language_equals_machines_by_hand(spark, monkeypatch):
    """Scores from n-grams counted one by one, of texts longer than a piece."""
    monkeypatch.setattr(langid, "PIECE_BYTES", 100)
    rng = random.Random(5)
    langs = ["en", "de", "fr", "es"]
    docs = spark.createDataFrame([(i, sentence(rng, langs[i % 4]), langs[i % 4], "s", 1) for i in range(200)], DOCS)
    model = langid.fit(docs)
    texts = [sentence(rng, langs[i % 4]) * (1 + i % 5) for i in range(40)] + ["", "12", "ü", None]
    best, score, _ = langid.predict_texts(model, [None if t is None else t.encode() for t in texts])
    shift = 32 - (langid.BUCKETS.bit_length() - 1)
    for t, own, own_score in zip(texts, best, score, strict=True):
        if not any(c.isalpha() for c in t or ""):
            assert (own, own_score) == ("und", 0.0)
            continue
        data = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in t.encode()) + b"    "
        counts = Counter()
        for at in range(len(data) - 3):
            for n in range(1, 5):
                gram = int.from_bytes(data[at : at + n], "little")
                counts[((gram * langid._SPREAD[n - 1] + ((n - 1) * 0x9E3779B1)) % 2**32) >> shift] += 1
        size = len(t.encode()) + 1
        margin = [langid._SCALE * sum(float(model["weights"][b, j]) * c for b, c in counts.items()) / size + float(model["weights"][-1, j]) for j in range(len(model["jobs"]))]
        sure = [1 / (1 + math.exp(-2 * m)) for m in margin]
        heads = [(margin[j], name, sure[j]) for j, (kind, name, _) in enumerate(model["jobs"]) if kind == "family"]
        _, family, head = max(heads)
        own_langs = [x for x in model["languages"] if langid.family(x) == family]
        votes = {x: sum(sure[j] if a == x else 1 - sure[j] for j, (kind, a, b) in enumerate(model["jobs"]) if kind == "pair" and x in (a, b)) for x in own_langs}
        assert own == max(votes, key=votes.get) and abs(own_score - head * votes[own] / (len(own_langs) - 1)) < 1e-4 and 0 <= own_score <= 1


def test_language_sample_of_a_machine_is_bounded(spark):
    rng = random.Random(9)
    langs = ["en", "de", "fr", "es"]
    docs = spark.createDataFrame([(i, sentence(rng, langs[i % 4]), langs[i % 4], "s", 1) for i in range(400)], DOCS)
    model = langid.fit(docs, machine_rows=60)  # fewer of other families' rows; the languages still come apart
    found = langid.predict(docs, model).where("held_out").collect()
    assert sum(r["lang_pred"] == langs[r["doc_id"] % 4] for r in found) > 0.9 * len(found)


def test_language_and_license_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    assert langid.predict(docs, langid.fit(docs)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.predict(docs, toxicity.fit(docs, labels)).count() == 0


def test_long_texts_and_repeated_ids(spark):
    long = "plain words that go on and on " * 40_000
    docs = spark.createDataFrame([(1, long, "en", "s", 1), (1, "other words", "en", "s", 1), (1, "grimly vile", "en", "s", 1), (2, "x" * 1_000_000, "de", None, 1), *[(i, "grimly said" if i % 2 else "kindly said", "de", "s", 1) for i in range(10, 60)]], DOCS)
    labels = spark.createDataFrame([(1, 0), (1, 0), *[(i, i % 2) for i in range(10, 60)]], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = toxicity.predict(docs, model).collect()
    assert len(found) == 54 and all(not r["toxic"] for r in found if r["doc_id"] >= 10 and r["doc_id"] % 2 == 0)
    assert langid.predict(docs, langid.fit(docs)).count() == 54
    assert {r["n_words"] for r in licences.scan(docs).where("doc_id = 1").collect()} == {280_000, 2}
    scored = {r["n_tokens"]: r for r in maxent_lm.scored(docs).where("doc_id <= 2").collect()}
    assert set(scored) == {280_001, 3, 2}


def test_toxicity_equals_sums_by_hand(spark):
    rng = random.Random(3)
    bad = ["grimly", "grimtop", "vilest"]
    rows = [(i, sentence(rng, "en") + (" " + rng.choice(bad) if i % 4 == 0 else ""), "en", "s", 1) for i in range(300)] + [(900, None, None, None, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int"))
    found = {r["doc_id"]: r for r in toxicity.predict(docs, model).collect()}
    for i, text, *_ in rows:
        ws = toxicity.words((text or "").encode())
        counts, strong = Counter(f for w in ws for f in toxicity.stems(w) if f in model.at), 0
        for w in ws:
            strong += any(model.strong[model.at[f]] for f in toxicity.stems(w) if f in model.at)
        z = sum(model.weights[model.at[f]] * (1 + 0.25 * math.log(n)) for f, n in counts.items())
        above = [1 / (1 + math.exp(-(z - t))) for t in model.thresholds]
        assert abs(found[i]["severity"] - sum(above)) < 1e-9 and abs(found[i]["toxic_probability"] - above[0]) < 1e-9
        assert found[i]["toxic"] == (above[0] >= 0.5) and found[i]["n_strong"] == strong


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "words", None, None, 1)], DOCS)
    assert langid.predict(docs, langid.fit(docs)).first()["lang_pred"] == "und"
    one = spark.createDataFrame([(i, "words here", "en", None, 1) for i in range(10)], DOCS)
    assert {r["lang_pred"] for r in langid.predict(one, langid.fit(one)).collect()} == {"en"}


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    bad = ["grimly", "grimtop", "grimness", "vilest", "vileness"]
    rows, labels = [], []
    for i in range(700):
        toxic = i % 7 == 0
        words = sentence(rng, "en").split() + (rng.sample(bad, rng.randint(1, 3)) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "s", 1))
        if i % 2:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (5000, None, None, None, 1), (5001, "", None, None, 1)], DOCS)
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (99999, 1), (None, 1), (3, None)], "doc_id long, toxic int"))
    found = {r["doc_id"]: r for r in toxicity.predict(docs, model).collect()}
    unseen = [i for i in range(700) if i % 2 == 0]
    assert sum(found[i]["toxic"] == (i % 7 == 0) for i in unseen) > 0.97 * len(unseen)
    assert not found[5000]["toxic"] and not found[5001]["toxic"] and found[7]["severity"] > found[9]["severity"]
    assert (sorted(model.thresholds) == list(model.thresholds)) and toxicity.keep(docs, model).columns == docs.columns
    none = toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert toxicity.predict(docs, none).where("toxic").count() == 0


def test_language_model_base_and_gain(spark):
    rng = random.Random(4)
    pairs = {"a": "b", "b": "c", "c": "d", "d": "a"}
    rows = []
    for i in range(400):
        w, out = rng.choice("abcd"), []
        for _ in range(rng.randint(0, 60)):
            out.append(w)
            w = pairs[w] if rng.random() < 0.9 else rng.choice("abcd")
        rows.append((i, " ".join(out), None, None, 1))
    rows += [(1001, None, None, None, 1), (1002, "neverseen Word", None, None, 1), (1002, "neverseen Word", None, None, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    found = maxent_lm.scored(docs).collect()
    assert len(found) == len(rows)
    tokens = lambda t: (t or "").lower().split() + [None]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(x for i, t, *_ in rows if not held(i) for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    text = {r[0]: r[1] for r in rows}
    for r in found:
        own = tokens(text[r["doc_id"]])
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own)
        assert abs(base - r["base_score"]) < 1e-6 and r["n_tokens"] == len(own) and r["train_tokens"] == n and r["held_out"] == held(r["doc_id"])
        assert r["n_known"] == sum(counts[x] > 0 for x in own)
    unseen = [r for r in found if r["held_out"] and r["doc_id"] < 400]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_language_model_is_normalised():
    import numpy as np

    model = maxent_lm.Model(np.random.default_rng(1).random(256) * 100)
    model.class_weights[:] = np.random.default_rng(2).normal(size=model.class_weights.shape)
    model.group_weights[:] = np.random.default_rng(3).normal(size=model.group_weights.shape)
    history = np.array([5, 9, 11], np.uint32)
    total = 0.0
    for g in range(256):
        hashed = [h[-1:] for h in model.features(np.append(history, 0).astype(np.uint32), np.zeros(1, np.int64))]
        total += 10 ** (model.score(np.array([g << 14], np.int32), hashed)[0]) * model.mass[g]
    assert abs(total - 1) < 1e-4


def test_language_model_holds_one_mini_batch_of_features(monkeypatch):
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(maxent_lm, "ROUNDS", 1)
    rng = np.random.default_rng(5)
    sizes = np.append(rng.integers(1, 900, 3000), [1, 1, 20_000]).astype(np.int32)
    ids = rng.integers(0, 5000, int(sizes.sum()))
    table = rng.integers(1, 1 << 32, 5000).astype(np.uint32)
    model = maxent_lm.Model(np.ones(256))
    codes = maxent_lm.coded(table, np.zeros(0, np.int64))[ids]
    whole = model.features(codes.astype(np.uint32) & np.uint32(0x3FFF), np.cumsum(sizes) - sizes)
    steps = list(model.steps(codes, sizes))
    assert (np.concatenate([c for c, _ in steps]) == codes).all() and max(len(c) for c, _ in steps) <= maxent_lm.STEP_TOKENS
    assert all((np.concatenate([h[i] for _, h in steps]) == whole[i]).all() for i in range(maxent_lm.FEATURES))

    chunk = pa.RecordBatch.from_arrays([pa.array([[False] * len(sizes)]), pa.array([sizes], pa.list_(pa.int32())), pa.array([maxent_lm.packed(ids)], pa.binary()), pa.array([maxent_lm.packed(table)], pa.binary())], names=["held_out", "sizes", "ids", "codes"])
    run = maxent_lm._train(SimpleNamespace(value=(model, np.zeros(0, np.int64))), 0, 0.1)
    tracemalloc.start()
    (found,) = run(iter([chunk]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 2 * maxent_lm._PARTS and peak < 25 * len(codes)  # ids, codes and weights, but no features of the whole chunk


def test_language_model_trains_in_one_python_step(spark, monkeypatch):
    seen = []
    averaged = maxent_lm._averaged
    monkeypatch.setattr(maxent_lm, "_averaged", lambda changes, model: seen.append(changes._jdf.queryExecution().executedPlan().toString()) or averaged(changes, model))
    assert maxent_lm.scored(spark.createDataFrame([(i, "a b c", None, None, 1) for i in range(9)], DOCS)).count() == 9
    assert len(seen) == maxent_lm.ROUNDS and all(p.count("MapInArrow") == 1 and "weights" in p and "part#" in p for p in seen)  # rows of pieces come from the step that trains


def test_language_model_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    assert maxent_lm.scored(docs).count() == 0


def test_lm_trains_in_three_rounds():
    assert maxent_lm.ROUNDS == 3


def test_languages_are_bounded_and_bad_bytes_have_a_result(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"{'der die das und' if i % 2 else 'the and of with'} word{i}", "de" if i % 2 else f"x{i % 4}") for i in range(60)], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        langid.fit(docs)
    model = langid.fit(docs, least=20)
    assert model["languages"] == ["de"]
    bad = docs.limit(2).select(F.col("doc_id"), F.expr("CASE doc_id WHEN 0 THEN cast(x'ff80' AS string) ELSE cast(x'ff61' AS string) END AS text"))
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(bad, model).collect()} == {0: "und", 1: "de"}
