"""Vector codes, PPM scores and importance resampling against plain versions of what they compute."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from dealwright.llm import codes, importance, ppm, queries

EXTRA = "row n_words weight word code n vector label_error part entry times p salt k1 occurrences rank range place line".split()


def clashing(df):
    """``df`` with further columns named like those that operators make."""
    return df.select("*", *(F.lit("x").alias(c) for c in EXTRA if c not in df.columns))


# --- vector codes


def plain_codes(rows, parts, entries, rounds):
    """vec_id -> (code, error), and the codebooks, by full scans over Python integers."""
    kept = [
        (i, label, [math.floor(256 * x) for x in v])
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    size = len(kept[0][2]) // parts
    cut = [[tuple(v[p * size : (p + 1) * size]) for p in range(parts)] for _, _, v in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][2]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for v in cut:
                members[nearest(v[p], books[p])[1]].append(v[p])
            for k, m in members.items():
                books[p][k] = tuple(sum(x) // len(m) for x in zip(*m, strict=True))
    found = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, label, _), e in zip(kept, errors, strict=True):
        by_label[label] += e
    flat = ",".join(str(x) for book in books for e in book for x in e)
    digest = hashlib.sha256(flat.encode()).hexdigest()
    return sorted(
        [(k[0], "".join(f"{c:02x}" for _, c in f), e, by_label[k[1]], digest) for k, f, e in zip(kept, found, errors, strict=True)],
        key=str,
    )


def vector_rows(seed, n, width=8):
    rng = random.Random(seed)
    near = [[rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5]) for _ in range(width)] for _ in range(9)]
    rows = [(i * 3, [x + rng.gauss(0, 0.1) for x in rng.choice(near)], rng.choice([None, 1, 2])) for i in range(n)]
    rows += [(i + 1, near[i % 9], 2) for i in range(0, 90, 3)]  # ties and repeated vectors
    rows += [rows[5], rows[5], (None, near[0], None), (2, None, 1), (5, [None] + [0.0] * (width - 1), 1)]
    return [*rows, (8, [math.nan] * width, 1), (11, [math.inf] + [0.0] * (width - 1), None)]


@pytest.mark.parametrize("parts, entries, rounds", [(4, 6, 2), (2, 64, 3), (8, 1, 1), (4, 500, 2)])
def test_codes_are_those_of_full_scans(spark, parts, entries, rounds):
    rows = vector_rows(parts, 120)
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3))
    got = codes.compress(df, parts=parts, entries=entries, rounds=rounds).collect()
    assert sorted(map(tuple, got), key=str) == plain_codes(rows, parts, entries, rounds)


def test_reassignment_by_moved_entries_is_a_full_scan():
    rng = np.random.default_rng(3)
    for _ in range(50):
        part, old = rng.integers(-3, 3, (200, 2)), rng.integers(-3, 3, (12, 2))
        moved = rng.random(12) < rng.random()
        new = np.where(moved[:, None], rng.integers(-3, 3, (12, 2)), old)
        got = codes.reassign(part, new, moved, *codes.assign(part, old))
        for have, want in zip(got, codes.assign(part, new), strict=True):
            assert (have == want).all()


def test_codes_of_no_vectors_odd_widths_and_large_components(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert codes.compress(spark.createDataFrame([], schema)).count() == 0
    assert codes.compress(spark.createDataFrame([(1, None, 1)], schema)).count() == 0
    mixed = spark.createDataFrame([(1, [0.5] * 16, 1), (2, [0.5] * 15, 1), (3, [1.0] * 32, 1), (4, [0.25] * 16, 1)], schema)
    assert [r["vec_id"] for r in codes.compress(mixed).orderBy("vec_id").collect()] == [1, 4]
    with pytest.raises(Exception, match="would not fit a long"):
        codes.compress(spark.createDataFrame([(1, [1e9] * 16, 1)], schema)).count()


# --- PPM


def plain_ppm(training, texts, order):
    """log10 of each text's bytes by a trie of dictionaries, symbol by symbol with explicit exclusion."""
    end = 0xFF

    def sequence(text):
        return [end] * order + [*b" ".join((text or "").encode().translate(ppm._LOWER).split()), end]

    seen = [defaultdict(Counter) for _ in range(order + 1)]
    for text in training:
        run = sequence(text)
        for i in range(order, len(run)):
            for k in range(order, -1, -1):
                context = tuple(run[i - k : i])
                new = run[i] not in seen[k][context]
                seen[k][context][run[i]] += 1
                if not new:  # shorter contexts count only what is new to the longer one
                    break
    result = []
    for text in texts:
        run, total = sequence(text), 0.0
        for i in range(order, len(run)):
            excluded = set()
            for k in range(order, -1, -1):
                symbols = {s: n for s, n in seen[k].get(tuple(run[i - k : i]), {}).items() if s not in excluded}
                whole = sum(symbols.values())
                if run[i] in symbols:
                    total += math.log10((symbols[run[i]] - 0.5) / whole)
                    break
                if symbols:
                    total += math.log10(0.5 * len(symbols) / whole)
                excluded |= set(symbols)
            else:
                total -= math.log10(ppm.SYMBOLS - len(seen[0].get((), {})))
        result.append(total)
    return result


def texts_of(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 5))) for _ in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 40))) + rng.choice(["", "\n", " ZZ"]) for _ in range(n)]
    odd = [None, "", " \n\t ", "A", "a a\x0ba\x1ca", "q" * 300, "\x00 €😀", texts[0], texts[0], "novel WORDS xyz " * 40]
    return texts + odd


@pytest.mark.parametrize("resident, words, piece", [(3_000_000, 300_000, 1 << 20), (40, 5, 64), (0, 0, 1 << 20)])
def test_scores_are_those_of_a_trie_of_dictionaries(spark, monkeypatch, resident, words, piece):
    monkeypatch.setattr(ppm, "RESIDENT", resident)
    monkeypatch.setattr(ppm, "RESIDENT_WORDS", words)
    monkeypatch.setattr(ppm, "SLICE", piece)
    texts = texts_of(7, 60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    training = [t for t, o in zip(texts, out, strict=True) if not o]
    tokens = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(ppm._LOWER)) + [None] for t in texts]
    counts = Counter(w for own, o in zip(tokens, out, strict=True) if not o for w in own)
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in ppm.score(clashing(df)).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(plain_ppm(training, texts, ppm.ORDER)):
        r = got[i]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[i])
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (out[i], len(tokens[i]), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in tokens[i])
        assert r["base_score"] == pytest.approx(base, abs=1e-8)
        assert r["score"] == pytest.approx(want, abs=1e-8)


def test_what_every_task_needs_passes_neither_the_driver_nor_a_broadcast(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("the resident model went through the driver")

    df = spark.createDataFrame(list(enumerate(texts_of(5, 30))), "doc_id long, text string").repartition(3)
    for name in ("toArrow", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(type(df), name, refused)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refused)
    assert ppm.score(df).count() == 40


def test_scores_without_training_documents_or_documents(spark):
    schema = "doc_id long, text string"
    assert ppm.score(spark.createDataFrame([], schema)).count() == 0
    (r,) = ppm.score(spark.createDataFrame([(None, "ab")], schema)).collect()
    assert r["held_out"] and (r["n_tokens"], r["n_known"], r["train_tokens"]) == (2, 0, 0)
    assert r["score"] == pytest.approx(-3 * math.log10(ppm.SYMBOLS)) and r["base_score"] == 0


def test_probabilities_of_all_symbols_sum_to_one(spark):
    texts = texts_of(9, 20)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    trie = ppm.Trie(ppm.counts(df).where("code IS NOT NULL").select("code", "n"))
    for context in (b"\xff" * ppm.ORDER, b"\xff\xff\xffa a"[-ppm.ORDER :], b"zzzzzz", "xx é a".encode()[-ppm.ORDER :]):
        start = int.from_bytes(context, "big") << 8
        rows = spark.createDataFrame([(start + s, 1) for s in range(256)], "code long, times long")
        p = np.array([10 ** r["p"] for r in trie.scored(rows).orderBy("code").collect()])
        seen = {r["code"] for r in trie.symbols[0].collect()}
        known = [s in seen for s in range(256)]
        # what no context has seen shares one rest among the symbols that UTF-8 can have
        rest = p[~np.array(known)]
        assert p[known].sum() + rest.mean() * trie.unseen == pytest.approx(1)


# --- importance resampling


def plain_resampling(docs, target, s):
    def runs(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        return words, [" ".join(words[i : i + n]) for n in range(1, s.max_n + 1) for i in range(len(words) - n + 1)]

    def bucket(run):
        return zlib.crc32(run.encode()) % s.buckets

    found = [runs(t) for _, t in docs]
    have = Counter(bucket(f) for _, fs in found for f in fs)
    want = Counter(bucket(f) for t in target for f in runs(t)[1])
    up, down = sum(have.values()) + s.buckets, sum(want.values()) + s.buckets
    gain = [math.floor(1000 * math.log((want[b] + 1) * up / ((have[b] + 1) * down))) for b in range(s.buckets)]
    rows = []
    for (i, _), (words, features) in zip(docs, found, strict=True):
        weight = sum(gain[bucket(f)] for f in features)
        h = int(hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([i, len(features), weight, score, None, len(words)])
    order = sorted((r for r in rows if r[5] >= s.min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(order[: s.percent * len(order) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("max_n, buckets", [(1, 10_000), (1, 7), (3, 500)])
def test_resampling_is_that_of_all_features(spark, max_n, buckets):
    rng = random.Random(max_n)
    words = ["".join(rng.choices("abXÉ9", k=rng.randint(1, 4))) for _ in range(50)]
    lines = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(80)] + ["one very common line"] * 60
    docs = [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 9)))) for i in range(150)]
    docs += [(None, "a b " * 30), (None, None), (151, ""), (152, "\n\n"), (153, "x" * 5000 + " é\x00z y " * 3000), docs[3], docs[3]]
    target = [" ".join(rng.choices(words[:10], k=30)) for _ in range(5)] + [None]
    settings = importance.Settings(max_n=max_n, buckets=buckets)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    other = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(clashing(df), clashing(other), settings).collect()
    assert sorted(map(tuple, got), key=str) == plain_resampling(docs, target, settings)


def test_resampling_of_and_towards_empty_tables(spark):
    docs, target = "doc_id long, text string", "text string"
    assert importance.resample(spark.createDataFrame([], docs), spark.createDataFrame([("a",)], target)).count() == 0
    rows = [(i, "word " * 25) for i in range(20)]
    got = importance.resample(spark.createDataFrame(rows, docs), spark.createDataFrame([], target)).collect()
    assert sorted(map(tuple, got), key=str) == plain_resampling(rows, [], importance.Settings())
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2]


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_resampling"])
def test_queries_agree_with_sql(spark, name):
    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.sql(queries.CHECKS[name])
    columns = sorted(want.columns)
    got = queries.QUERIES[name](spark, folder).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.select(*columns).fetchall(), key=str)
