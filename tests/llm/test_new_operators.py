"""Operators 11 to 13 against brute force: nulls, empty and long texts, repeated rows, clashing columns, empty tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shipshape.llm import licences as lic, queries, spelling, whitening

DOCS = "doc_id long, text string, id long, key long, word string, n long, t int, text2 string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows, columns="doc_id long, text string"):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, 2, "x", 3, 4, "y") for i, t in rows], DOCS)


# ---- 11 ----

def expected_variants(rows, least=5, often=3, every=97, times=2):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % every == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= often}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    around = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, xs in around.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {w: (form[w], root(w), n[w], len(around[w]), n[form[w]] if form[w] else None) for w in n}


def variants_of(df):
    out = df.collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in out}
    assert len(got) == len(out)
    return got


def spelled_corpus(seed=5):
    rng = random.Random(seed)
    words = ["receive", "colour", "color", "naïveté", "ÿÿÿÿÿ", "aaaaaa", "strasse", "straße", "bookkeeper"]
    rows = []
    for i in range(120):
        out = []
        for _ in range(60):
            w = rng.choice(words)
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("eiouéz") + w[at:], w[:at] + rng.choice("eioué") + w[at + 1:], w.upper()])
            out.append(w)
        rows.append((i, rng.choice([" ", ", ", "_7"]).join(out)))
    long = "ab" * 3000
    rows += [(250, "abcdefgh " * 4 + "bcdefgh " * 9 + "bcdefghi " * 20)]
    return rows + [(200, None), (201, ""), (None, "colour colour colours"), (7, rows[7][1]), (7, rows[7][1])] + [(300 + i, f"{long} {long[1:]} {'q' * 70}") for i in range(6)]


@pytest.mark.parametrize("filter_bytes", [32 << 20, 256])
def test_variants_equal_brute_force(spark, monkeypatch, filter_bytes):
    """Also with filters so small that the vocabulary is probed in many parts."""
    monkeypatch.setattr(spelling, "FILTER_BYTES", filter_bytes)
    monkeypatch.setattr(spelling, "LOT", 500)
    rows = spelled_corpus()
    expected = expected_variants(rows)
    assert any(r != f and f for f, r, *_ in expected.values())
    assert variants_of(spelling.variants(table(spark, rows))) == expected


def test_long_chains_reach_their_roots(spark):
    chain = ["abcdefgh", "bcdefgh", "bcdefghi", "cdefghi", "cdefghij", "defghij"]
    rows = [(i, " ".join([w] * 3 * 2 ** i)) for i, w in enumerate(chain)]
    out = variants_of(spelling.variants(table(spark, rows), every=10 ** 12))
    assert {w: r for w, (_, r, *_) in out.items()} == dict.fromkeys(chain, chain[-1])


def test_filters_hold_every_word_and_few_others(spark):
    rng = random.Random(1)
    words = list({"".join(rng.choice("abcdef") for _ in range(rng.choice([5, 6, 7, 80]))) for _ in range(4000)})
    vocab = spelling.vocabulary(spark.createDataFrame([(w, 3) for w in words[:2000]], "word string, n long"))
    shards = spelling.Shards.of(Counter(len(w) for w in words[:2000]))
    lanes = spelling.filled(vocab, shards, 0)
    p = spelling.places(words)
    hit = set(spelling.held(lanes, shards, spelling.key(p.whole, p.length), p.length).tolist())
    assert hit >= set(range(2000)) and len(hit) < 2000 + 0.02 * (len(words) - 2000)


def test_variants_of_empty_tables(spark):
    assert spelling.variants(table(spark, [])).collect() == []
    assert spelling.variants(table(spark, [(1, "once only here"), (2, None)])).collect() == []


def test_variants_query_on_given_documents(spark, tmp_path):
    """The registered query on a part of the given documents, brute force beside it."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(25)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert variants_of(queries.op11_spelling_variants(spark, str(tmp_path))) == expected_variants(rows)


# ---- 12 ----

VECS = "vec_id long, embedding array<float>, id int, v string, component int, n int, deviation int, c int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3, 4, 5) for i, v in rows], VECS)


def check_whitened(out, rows, k=8):
    fine = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(1024 * np.array([v for _, v in fine], np.float32).astype(float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    held = min(k, int((values > values[0] * 1e-11).sum()))
    assert len(out) == n * held
    deviation = {}
    for (i, _), row in zip(fine, x.tolist()):
        deviation.setdefault(i, []).append(sum((n * a - int(s)) ** 2 for a, s in zip(row, sums)))
    got = {}
    for r in out:
        got.setdefault((r["vec_id"], r["component"]), []).append(r)
        assert r["n"] == n and r["identity_error"] <= 1e-9 and int(r["deviation"]) in deviation[r["vec_id"]]
        assert abs(r["explained"] - values[r["component"] - 1] / np.trace(cov)) <= 1e-9
    for j in range(held):
        project = centred @ axes[:, j] / np.sqrt(values[j])
        own = {}
        for (i, _), p in zip(fine, project):
            own.setdefault(i, []).append(p)
        for sign in (1, -1):
            if all(np.allclose(sorted(sign * q for q in qs), sorted(r["whitened"] for r in got[i, j + 1]), atol=1e-7) for i, qs in own.items()):
                break
        else:
            raise AssertionError(j)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) + 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5, x[5].tolist()), (None, x[9].tolist()), (400, None), (401, [None] * 12), (402, [float("nan")] + [0.0] * 11), (403, [float("inf")] * 12), (404, [1e20] * 12), (405, []), (406, [1.0])]
    rows_used = [(i, v) for i, v in rows if i not in (404, 405, 406)]
    check_whitened(whitening.whiten(vectors(spark, rows).repartition(5)).collect(), rows_used)
    # exact sums: another partitioning gives the same bits
    one, two = (sorted(map(str, whitening.whiten(vectors(spark, rows).repartition(p)).drop("identity_error").collect())) for p in (1, 7))
    assert one == two


def test_whitening_of_large_entries_is_exact(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(40, 3)) * 1e6 + 1e7).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    check_whitened(whitening.whiten(vectors(spark, rows)).collect(), rows)


def test_whitening_of_degenerate_tables(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None)])).collect() == []
    assert whitening.whiten(vectors(spark, [(i, [1.0, 2.0]) for i in range(4)])).collect() == []
    line = [(i, [float(i), 2.0 * i, 0.5]) for i in range(9)]  # one direction only
    check_whitened(whitening.whiten(vectors(spark, line)).collect(), line)


def test_whitening_query_on_given_embeddings(spark):
    src = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{src}/embeddings.parquet").collect()]
    check_whitened(queries.op12_embedding_whitening(spark, src).collect(), rows)


@pytest.mark.parametrize("kind", ["random", "clusters", "diagonal", "equal", "graded", "blocks"])
def test_eigensolver(kind):
    rng = np.random.default_rng(6)
    n = 30
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    values = {"random": rng.uniform(0, 5, n), "clusters": np.repeat([9.0, 4, 1], 10) + 1e-13 * rng.normal(size=n), "diagonal": np.arange(n) + 1.0, "equal": np.ones(n),
              "graded": 10.0 ** -np.arange(n), "blocks": np.arange(n) + 1.0}[kind]
    a = np.diag(values) if kind == "diagonal" else (q * values) @ q.T
    if kind == "blocks":
        a[:15, 15:] = a[15:, :15] = 0
    a = (a + a.T) / 2
    e, v = whitening.eigen(a, 8)
    assert np.allclose(e, np.sort(np.linalg.eigvalsh(a))[::-1][:8], atol=1e-13 * max(1, np.abs(a).max()) * n)
    assert np.abs(v.T @ v - np.eye(8)).max() < 1e-12
    assert np.abs(a @ v - v * e).max() < 1e-12 * np.abs(a).max() * n
    assert whitening.eigen(np.zeros((3, 3)), 8)[0].tolist() == [0, 0, 0] and whitening.eigen(np.array([[2.0]]), 8)[0].tolist() == [2]


# ---- 13 ----

def file_words(text):
    return [w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))]


def expected_licences(rows):
    texts = [file_words(t) for _, t in rows]
    df = Counter(w for ws in texts for w in set(ws))
    notices = []
    for label, passage, phrases in lic.NOTICES:
        words = file_words(passage)
        rare = sorted(set(words), key=lambda w: (df[w], w))[:min(8, (len(set(words)) + 1) // 2)]
        keys = [file_words(p) for p in phrases or [passage]]
        notices.append((label, words, rare, [(next(i for i in range(len(words)) if words[i:i + len(k)] == k), k) for k in keys]))
    out = []
    for (i, _), words in zip(rows, texts):
        places = [(label, s) for label, k, _, _ in notices[:3] for s in range(len(words)) if words[s:s + len(k)] == k]
        score, labels = 0.0, set()
        for label, passage, rare, keys in notices:
            step = len(passage) // 4 + 1 if len(passage) >= 12 else 1
            votes = {(at - p) // step - back: set() for at, w in enumerate(words) if w in rare for p, x in enumerate(passage) if x == w for back in range(2 if step > 1 else 1)}
            for at, w in enumerate(words):
                for p, x in enumerate(passage):
                    if w == x and w in rare:
                        for back in range(2 if step > 1 else 1):
                            votes[(at - p) // step - back].add(w)
            for r, seen in votes.items():
                if len(seen) < max(min(2, len(rare)), (len(rare) + 1) // 2):
                    continue
                stand = [any(words[s:s + len(k)] == k and r <= (s - p) // step <= r + (step > 1) for s in range(len(words))) for p, k in keys]
                score = max(score, (len(seen) + sum(stand)) / (len(rare) + len(keys)))
                if all(stand):
                    labels.add(label)
        starts = [s for _, s in places]
        out.append((i, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in places})), ",".join(sorted(labels)), round(score, 9)))
    return sorted(out, key=str)


def licence_rows(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in df.collect()), key=str)


def licence_corpus():
    rng = random.Random(9)
    plain = "the river stone was under public copy software of free use notice general source".split()
    prose = [" ".join(rng.choice(plain) for _ in range(rng.choice([3, 40, 90]))) for _ in range(20)]
    rows = list(enumerate(prose))
    for j, (_, passage, _) in enumerate(lic.NOTICES):
        rows.append((100 + j, f"{prose[j % 20]}\n{passage.upper()} {prose[j % 7]}"))
        words = passage.split()
        rows.append((200 + j, " ".join(words[:len(words) // 2] + ["Jane", "Doe"] + words[len(words) // 2:])))  # a name put in
        rows.append((300 + j, " ".join(words[:-1])))
    rows += [(400, None), (401, ""), (402, "Under/the-MIT.License under the MIT licence; cc by\x00nc CC_BY_NC"), (403, "l'été under the mit license é" * 3), (None, "under the MIT License"),
             (404, "GNU " * 3000 + "under the MIT license " * 500), (405, "cc by nc"), (405, "cc by nc"), (406, "under the mit"), (407, "license version 2 apache")]
    return rows


def test_licences_equal_brute_force(spark):
    rows = licence_corpus()
    expected = expected_licences(rows)
    assert {x for r in expected for x in r[6].split(",")} >= {n[0] for n in lic.NOTICES}
    assert licence_rows(lic.licences(table(spark, rows))) == expected
    assert lic.licences(table(spark, [])).collect() == []


def test_license_query_on_given_documents(spark):
    src = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{src}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.op13_license_scan(spark, src)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
    assert licence_rows(out) == expected_licences(rows)
    assert sum(r[2] > 0 for r in licence_rows(out)) > 0
