"""Filter audit, language identification and periodic runs against brute force and SQL."""

import hashlib
import random
import zlib
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from citegrain.llm import filter_audit, languages, registry, runs, training

DATA = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


def words(text):
    for c in SPACES:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


# --- 11


def brute_audit(docs, labels):
    quality, toxic = ({i for i, *y in labels if y[k] == 1 and i is not None} for k in (0, 1))
    rows = []
    for i, text, lang in docs:
        text = text or ""
        w = words(text)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        rows.append((lang or "", {f for f in fails if fails[f]}, i in quality, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [r for r in mine if f in r[1] and not r[1] & before]
                out[part, "".join(order), k + 1] = (
                    sum(not r[1] & (before | {f}) for r in mine), len(gone), sum(f in r[1] and bool(r[1] & before) for r in mine), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone),
                )
    removed = {}
    for (part, order, step), row in out.items():
        removed[part, order[step - 1]] = removed.get((part, order[step - 1]), 0) + row[1]
    return {key: (*row, removed[key[0], key[1][key[2] - 1]]) for key, row in out.items()}


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_filter_audit_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(filter_audit, "BROADCAST_HASHES", broadcast)
    monkeypatch.setattr(filter_audit, "GROUP_ROWS", 2)
    rng = random.Random(3)
    long = lambda n, of: " ".join(f"w{rng.randrange(of)}" for _ in range(n))
    texts = [None, "", "A b", "a b", "a$ b", long(150, 5000), long(150, 60), long(150, 60).upper(), long(120, 9000) + " 50%", "\n\x0b ", "É" * 20 + "AB", "x\x1cy " * 120]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(120)] + [(k, "copy " * 10, "en") for k in range(50, 80)]
    labels = [(rng.choice([None, *range(80)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id bigint, text string, lang string, hash int, bits int")
    got = filter_audit.filter_audit(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    columns = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in columns) for r in got.collect()} == brute_audit(docs, labels)
    assert filter_audit.filter_audit(d.limit(0), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).count() == 0


def test_filter_audit_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got = registry.QUERIES["op11_filter_audit"](spark, DATA)
    want = con.sql(registry.ORACLES["op11_filter_audit"]).to_arrow_table()
    assert sorted(got.columns) == sorted(want.column_names)
    assert sorted(tuple(r[c] for c in want.column_names) for r in got.collect()) == sorted(tuple(r.values()) for r in want.to_pylist())


# --- 13


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q) and (start, i + q) not in found:
                found[start, i + q] = q
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_kept(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_texts(seed, count):
    rng = random.Random(seed)
    texts = [None, "", " \n", "a", "a " * 5, "a " * 6, "a b " * 4, "a b a b a b a", "a " * 5000, "ab " * 30 + "x " * 7]
    for _ in range(count):
        told = []
        for _ in range(rng.randint(1, 5)):
            block = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 12))] if rng.random() < 0.6 else [f"w{rng.randrange(300)}" for _ in range(rng.randint(10, 200))]
            told += (block * 12)[: int(len(block) * rng.choice([0.7, 1, 1, 3.9, 4, 4.5, 8, 11]))]
            told += [f"u{rng.randrange(50)}" for _ in range(rng.randint(0, 20))]
        texts.append(rng.choice(SPACES).join(told))
    return texts


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    texts = periodic_texts(seed, 60)
    for text, (found, kept) in zip(texts, runs.collapse([t or "" for t in texts])):
        w = words(text)
        assert sorted(found) == brute_runs(w) and kept == brute_kept(w, found)


def test_runs_of_nested_and_two_letter_words():
    fibonacci = ["a", "b"]
    for _ in range(11):
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    blocks = ["ab" * 20 + "c", "abab" * 9 + "ab" * 3 + "a", fibonacci[-1] * 5, "aab" * 40 + "aac"]
    for block in [*blocks, *("".join(b * 5 for b in blocks) for _ in range(1)), *(b * 6 for b in blocks)]:
        assert sorted(runs.collapse([" ".join(block)])[0][0]) == brute_runs(list(block))


def test_run_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, t) for i, t in enumerate(periodic_texts(9, 40))] + [(1000 + i, " ".join(f"v{rng.randrange(40)}" for _ in range(rng.randint(1, 300)))) for i in range(80)] + [(None, "a " * 9), (3, "b " * 9)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, runs int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, registry.QUERIES["op13_runs"](spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, text in rows:
        w = words(text)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = brute_runs(w)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        told = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda r: (r[0], r[2])))
        collapsed = brute_kept(w, found) if found or (h % 10 == 0) else " ".join(w)
        want.append((i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(told), sha(collapsed)))
    assert got == sorted(want, key=str)
    kept = runs.periodic_runs(df)
    assert kept.columns == ["doc_id", "text", "runs", "collapsed"] and runs.periodic_runs(df.limit(0)).count() == 0


# --- 12


def test_grams_of_blocks_are_those_of_the_whole(monkeypatch):
    text = " ".join(["hällo", "wörld", "日本語"] * 30)
    whole = languages.gram_counts(text)
    assert whole[1].sum() == sum(len(text) - k + 1 for k in languages.ORDERS)
    monkeypatch.setattr(languages, "BLOCK", 7)
    assert all((a == b).all() for a, b in zip(whole, languages.gram_counts(text)))


def test_leader_keeps_weights_sparse_and_follows_its_formula():
    rng = np.random.default_rng(2)
    leader, z, n = languages.Leader(3), np.zeros((4, 3)), np.zeros((4, 3))
    rows = [(np.array([0, 2]), rng.normal(size=2), 1), (np.array([1, 2, 3]), rng.normal(size=3), 0), (np.array([0, 3]), rng.normal(size=2), 2)] * 4
    bias_z, bias_n = np.zeros(3), np.zeros(3)
    for features, values, label in rows:
        leader.learn(features, values, label)
        w = np.array([[0.0 if abs(z[f, k]) <= leader.l1 else -(z[f, k] - np.sign(z[f, k]) * leader.l1) / ((leader.beta + n[f, k] ** 0.5) / leader.alpha + leader.l2) for k in range(3)] for f in features])
        bias = -bias_z / ((leader.beta + np.sqrt(bias_n)) / leader.alpha)
        p = np.exp(values @ w + bias)
        error = p / p.sum() - np.eye(3)[label]
        for j, f in enumerate(features):
            g = values[j] * error
            z[f] += g - (np.sqrt(n[f] + g**2) - np.sqrt(n[f])) / leader.alpha * w[j]
            n[f] += g**2
        bias_z += error - (np.sqrt(bias_n + error**2) - np.sqrt(bias_n)) / leader.alpha * bias
        bias_n += error**2
    assert np.allclose(leader.z[:4], z) and np.allclose(leader.n[:4], n) and np.allclose(leader.z[-1], bias_z)
    weights = leader.weights()
    assert (weights[(np.abs(leader.z) <= leader.l1)] == 0).all() and (weights[:4] != 0).any()


def test_temperature_is_the_likeliest():
    rng = np.random.default_rng(4)
    logits = rng.normal(size=(400, 3)) * 6
    labels = np.array([rng.choice(3, p=languages.softmax(z / 3)) for z in logits])
    told = lambda t: -np.log(languages.softmax(logits / t)[np.arange(400), labels]).mean()
    best = languages.temperature(logits, labels)
    assert 2 < best < 4.5 and told(best) <= min(told(best * 0.97), told(best * 1.03))


def test_inverse_frequencies_count_every_row(spark):
    texts = [" ab ", " abc ", None, " ab ", " 日 "]
    df = spark.createDataFrame([(t,) for t in texts], "letters string").repartition(3)
    idf = languages.inverse_frequencies(df)
    for text in (" ab ", " 日 "):
        for feature in languages.gram_counts(text)[0]:
            n = sum(t is not None and feature in languages.gram_counts(t)[0] for t in texts)
            assert idf[feature] == pytest.approx(np.log(5 / (1 + n)) + 1)


def test_languages_of_held_out_documents(spark):
    got = registry.QUERIES["op12_language"](spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in held]) > 0.97
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in truth[r.doc_id][1] or "")) and 0 <= r.score <= 1 for r in got)


def test_languages_of_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (2, "le chat et le chien", "fr"), (4, None, "en"), (5, "12 §", "fr"), (None, "the bird", "en"), (7, "and the", None), (8, "the " * 400_000, "en")]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id bigint, text string, lang string, lang_pred string, score double")
    model = languages.train(df, F.lit(True))
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in languages.identify(df, model, ["doc_id", "lang_pred"]).collect()}
    assert model.names == ["en", "fr"] and {(4, "und", False), (5, "und", False), (2, "fr", True), (8, "en", True)} <= got
    one = languages.train(df.where("lang = 'fr'"), F.lit(True))
    assert {(r.lang_pred, r.score) for r in languages.identify(df, one, ["doc_id"]).collect()} == {("und", 0.0), ("fr", 1.0)}
    none = languages.train(df.limit(0), F.lit(True))
    assert {r.lang_pred for r in languages.identify(df, none, ["doc_id"]).collect()} == {"und"}


def test_row_sample_bounds_repeated_rows_and_long_texts(spark):
    rows = [(1, "a" * 9, "p")] * 500 + [(2, "b" * 30, "q"), (3, None, "p"), (None, "c", "q"), (4, "d" * 9, "p"), (1, "other", "q")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    texts, langs = training.row_sample(df, "lang", 100, 29)
    assert sorted(zip(map(str, texts), langs)) == sorted([("a" * 9, "p"), ("None", "p"), ("c", "q"), ("d" * 9, "p"), ("other", "q")])
    assert len(training.row_sample(df, "lang", 2, 1000)[0]) == 2
