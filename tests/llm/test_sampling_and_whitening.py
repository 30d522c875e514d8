"""Importance resampling, embedding whitening and the mix of sources, against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lineforge.llm import importance, source_mix, whitening

xxhash = pytest.importorskip("xxhash")

ODD_TEXTS = [None, "", " \n\t", "One", "a" * 200 + " b", "ä-ö ß9 Ü", "x.y,z", ("long " * 30_000), "a b " * 15, "tie tie"]


def documents(spark, texts, start=0):
    rows = [(start + i, t, f"s{i % 4}" if i % 5 else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


# Importance resampling.


def plain_features(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def plain_resample(docs, targets, percent=25, least=20):
    corpus, wanted, known = Counter(), Counter(), []
    for key, text in docs:
        n, found = plain_features(text)
        corpus.update(found)
        known.append((key, n, found))
    for text in targets:
        wanted.update(plain_features(text)[1])
    s_all, t_all = sum(corpus.values()), sum(wanted.values())

    def gain(b):
        return math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10_000) / ((corpus[b] + 1) * (t_all + 10_000))))

    rows = []
    for key, n, found in known:
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([key, len(found), weight, score, n >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = defaultdict(list)
    for place, row in enumerate(able[: percent * len(able) // 100], 1):
        ranks[row[0], row[3]].append(place)
    for row in rows:
        row[4] = ranks[row[0], row[3]].pop(0) if row[4] and ranks[row[0], row[3]] else None
    return sorted(map(tuple, rows), key=repr)


def test_checksums_of_spans_are_zlibs():
    data = np.frombuffer(b"a bc def " + b"q" * 300 + b" z", dtype=np.uint8)
    starts, ends = np.array([0, 2, 5, 9, 310, 3, 9]), np.array([1, 4, 8, 309, 311, 3, 57])
    expected = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert importance.checksums(data, starts, ends).tolist() == expected


def test_features_are_words_and_pairs_of_whole_texts():
    bucket, row, n_words = importance.features(pa.array(ODD_TEXTS))
    for i, text in enumerate(ODD_TEXTS):
        n, expected = plain_features(text)
        assert n_words[i] == n and Counter(bucket[row == i].tolist()) == Counter(expected)


def test_resampling_equals_the_plain_version(spark, small):
    given = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    odd = documents(spark, [*ODD_TEXTS, *["same words " * 12] * 3], 10_000).select("doc_id", "text")
    again = given.where("doc_id % 7 = 0")
    nameless = spark.createDataFrame([(None, "no id " * 20), (None, None)], "doc_id long, text string")
    docs = given.unionByName(odd).unionByName(again).unionByName(nameless)
    target = spark.read.parquet(f"{small}/benchmark.parquet")
    found = importance.resample(spark, docs, target).select("doc_id", "n_features", "weight", "score", "rank")
    expected = plain_resample([tuple(r) for r in docs.collect()], [r["text"] for r in target.collect()])
    assert sorted(map(tuple, found.collect()), key=repr) == expected


@pytest.mark.parametrize("shape", ["spread", "hot", "one"])
def test_cutoff_is_exact_at_any_place(spark, shape):
    value = {"spread": "hash(id) % 5000", "hot": "if(id % 3 = 0, 77, hash(id) % 50)", "one": "5"}[shape]
    scores = spark.range(20_000).selectExpr(f"cast({value} as long) as score")
    values = sorted((r[0] for r in scores.collect()), reverse=True)
    for place in (1, 4_999, 7_003, 20_000):
        assert importance.cutoff(scores, place, sorted_at_once=50) == values[place - 1]
    assert importance.cutoff(scores, 0) is None and importance.cutoff(scores, 20_001) is None


def test_resampling_of_nothing_and_of_odd_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(spark, empty, empty).collect() == []
    clash = spark.createDataFrame([(1, "word " * 30, 9), (2, "other " * 30, 9)], "rank long, score string, weight int")
    rows = importance.resample(spark, clash, empty, "score", "rank", percent=50)
    assert rows.columns == ["_rank", "n_features", "weight", "score", "rank"]
    assert sorted(r["rank"] or 0 for r in rows.collect()) == [0, 1]


# Whitening.


def plain_whitening(vectors, wanted=16):
    x = np.floor(64 * np.asarray(vectors, dtype=float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    c = (n * fit - total) / n
    values, turn = np.linalg.eigh(c.T @ c / n)
    values, turn = values[::-1][:wanted], turn[:, ::-1][:, :wanted]
    d = n * x - total
    return n, (d * d).sum(1), (d / n) @ turn / np.sqrt(values), values / (np.square(c).sum() / n)


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def compare(found, ids, vectors, wanted=16, within=1e-6):
    n, deviation, whitened, explained = plain_whitening(vectors, wanted)
    at = {i: r for r, i in enumerate(ids)}
    signs = {}
    assert len(found) == len(ids) * len(explained)
    for row in sorted(found, key=lambda r: r["vec_id"]):
        r, k = at[row["vec_id"]], row["component"] - 1
        value = whitened[r, k]
        if abs(value) > 1e-3:
            signs.setdefault(k, np.sign(row["whitened"] * value))
        assert abs(row["whitened"] - signs.get(k, 1) * value) < within
        assert (row["n"], row["deviation"]) == (n, deviation[r])
        assert abs(row["explained"] / explained[k] - 1) < 1e-9 and row["identity_error"] < 1e-9


def test_whitening_equals_a_full_decomposition(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    found = whitening.op12_embedding_whitening(spark, small).collect()
    compare(found, [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_wide_vectors_with_close_eigenvalues_are_certified(spark):
    draw = np.random.default_rng(5)
    vectors = (draw.standard_normal((400, 120)) * np.linspace(1, 2, 120)).astype(np.float32)
    frame = vectors_of(spark, [(i, v.tolist(), 0) for i, v in enumerate(vectors)])
    whole = frame.select(whitening.as_whole(F.col("embedding")).alias("x"))
    fit = whitening.fit_list(spark, whole)
    found = whitening.leading(fit, 4, 8)
    assert found.residual <= whitening.GOOD_ENOUGH and found.passes > whitening.LANCZOS
    compare(whitening.whiten(spark, frame, wanted=4, guard=8).collect(), range(400), vectors, 4, 1e-5)


def test_odd_vectors(spark):
    draw = np.random.default_rng(6)
    good = [(i, draw.standard_normal(5).round(2).tolist(), 1) for i in range(40)]
    copies = [(100 + i, good[0][1], 1) for i in range(300)]
    odd = [(200, None, 1), (201, [], 1), (202, [1.0] * 4 + [None], 1), (203, [float("nan")] * 5, 1)]
    odd += [(204, [float("-inf")] + [0.0] * 4, 1), (205, [1.0] * 4, 1), (206, [1.0] * 6, 1)]
    found = whitening.whiten(spark, vectors_of(spark, good + copies + odd)).collect()
    used = good + copies
    compare(found, [i for i, _, _ in used], [v for _, v, _ in used], 5)


def test_vectors_without_variance_have_no_components(spark):
    assert whitening.whiten(spark, vectors_of(spark, [])).collect() == []
    assert whitening.whiten(spark, vectors_of(spark, [(1, [1.0, 2.0], 0)] * 3)).collect() == []
    line = whitening.whiten(spark, vectors_of(spark, [(i, [float(i), 2.0, float(-i)], 0) for i in range(9)])).collect()
    assert {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-9


def test_deviations_beyond_64_bits_are_null_and_sums_stay_exact(spark):
    rows = [(1, [2.0**40, 1.0], 0), (2, [-(2.0**40), 3.0], 0), (3, [0.0, 2.0], 0)]
    found = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark, vectors_of(spark, rows)).collect()}
    assert found[1] is None and found[2] is None and found[3] == 0


# Mix of sources.


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, budget = set(), share * sum(sizes.values())
    while True:
        rest = budget - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        now = {s for s in names if s in full or rest * weight[s] / free > most * sizes[s]} if free else full
        if now == full:
            return {s: most * sizes[s] if s in full else rest * weight[s] / free for s in names}
        full = now


def plain_mix(rows):
    """(key, size, source_size, target, taken) by sorting each source's ranks and trying each."""
    sized = [(k, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), t) for k, t, s in rows]
    sizes = defaultdict(int)
    for _, s, n, _ in sized:
        sizes[s] += n
    aims = plain_targets(sizes)
    out = []
    for source, target in aims.items():
        own = [r for r in sized if r[1] == source]
        ratio = target / sizes[source] if sizes[source] else 0.0
        certain, part = math.floor(ratio), ratio - math.floor(ratio)

        def rank(row):
            seed = xxhash.xxh64_intdigest(str("~" if row[0] is None else row[0]).encode(), 42)
            h = xxhash.xxh64_intdigest((row[3] or "").encode(), seed)
            u = ((h >> 11) + 0.5) / 2**53
            low, high = u * (1 - part), (1 - u) * part
            return math.floor(low / (low + high) * 2**48) if part else 0

        room = target - certain * sizes[source]
        for row in sorted(own, key=rank):
            extra = int(part > 0 and 0 < row[2] <= room)
            room -= extra * row[2]
            out.append((row[0], row[2], sizes[source], (certain + extra) * row[2]))
    return sorted(out, key=repr), aims


def test_the_mix_equals_the_plain_version(spark, small):
    given = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source")
    docs = given.unionByName(documents(spark, ODD_TEXTS, 20_000)).unionByName(given.where("doc_id % 5 = 0"))
    nameless = spark.createDataFrame([(None, "a b c", "s1"), (None, None, None)], "doc_id long, text string, source string")
    docs = docs.unionByName(nameless)
    expected, aims = plain_mix([tuple(r) for r in docs.collect()])
    found = source_mix.mix(spark, docs).collect()
    assert sorted(((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in found), key=repr) == expected
    assert {round(r["target"], 6) for r in found} == {round(t, 6) for t in aims.values()}
    assert all(r["taken"] <= 2 * r["size"] for r in found)


def test_targets_stop_at_twice_a_source(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 0, "é": 70, None: 40, "Z": 3}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in source_mix.targets(spark, frame).collect()}
    for name, target in plain_targets(sizes).items():
        assert found[name] == pytest.approx(target)
    assert sum(found.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_a_hot_source_is_narrowed_down_and_met(spark):
    docs = spark.range(12_000).selectExpr(
        "id as doc_id", "repeat('w ', cast(1 + pow(id % 97, 2) / 40 as int)) as text", "if(id % 3 = 0, 'hot', concat('s', id % 9)) as source"
    )
    first = source_mix.mix(spark, docs, few=8, fill=20)
    rows = first.collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        name = "hot" if r["doc_id"] % 3 == 0 else r["doc_id"] % 9
        taken[name] += r["taken"]
        target[name] = r["target"]
    assert all(-1e-6 <= t - taken[name] < max(5, 0.01 * t) for name, t in target.items())
    dealt_anew = source_mix.mix(spark, docs.repartition(7, F.col("text")), few=8, fill=20)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, dealt_anew.collect()), key=repr)


def test_equal_rows_are_taken_as_far_as_they_fit(spark):
    same = spark.range(0, 3000, 1, 6).selectExpr("7L as doc_id", "'one two three' as text", "'a' as source")
    other = spark.range(50).selectExpr("id as doc_id", "'x y' as text", "'b' as source")
    rows = source_mix.mix(spark, same.unionByName(other), weights=(1, 1), share=1.25, few=4).where("doc_id = 7 and size = 3").collect()
    target = rows[0]["target"]
    assert len(rows) == 3000 and -1e-6 <= target - sum(r["taken"] for r in rows) < 3
    assert Counter(r["copies"] for r in rows).keys() == {1, 2}


def test_own_odds_change_what_is_drawn(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('w', id) as text", "'s' as source", "if(id % 2 = 0, 4.0D, 1.0D) as p")
    rows = source_mix.mix(spark, docs, share=0.5, propensity="p").collect()
    drawn = Counter(r["doc_id"] % 2 for r in rows if r["copies"])
    # Odds of one, four times those of the other, at half of all.
    assert sum(drawn.values()) == 2000 and 1250 < drawn[0] < 1420


def test_the_mix_of_nothing_and_of_odd_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert source_mix.mix(spark, empty).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "taken long, text string, source string")
    rows = source_mix.mix(spark, blank, key="taken").collect()
    assert [tuple(r)[1:] for r in rows] == [(0, 0, 0.0, 0, 0)] * 2


def test_native_plan_of_the_mix(spark, small):
    plan = source_mix.op13_source_mix(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
