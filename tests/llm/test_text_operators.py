"""Operators on single documents: tokens, rules, classifier, pseudo-likelihood, chat."""

import hashlib
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineforge.llm import arrow, bpe, chat, names, pseudo_likelihood, quality_model, quality_rules, tokens
from lineforge.llm import token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

ODD = [
    None,
    "",
    " ",
    "\n\n",
    "one",
    "a  b\n\n c\t d <|endoftext|> e<|endoftext|>",
    "é  b   c\x1f d! 's 'll it's\r\n\r\n  q",
    "中文 字 　 a",
    "x" * 30_000,
    "word " * 20_000,
    "the same line\nthe same line\nand\n\nthe same line",
    "# * $ % & | < > mixed #*# IN UPPER",
]
SCHEMA = "doc_id long, text string, body string, stats string, ids string, n_words int"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, repeated rows, null ids and columns called like helpers."""
    rows = [(i, t, "b", "s", "i", -1) for i, t in enumerate(ODD)]
    rows += [rows[4], (None, "null id", None, None, None, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_of_slices_are_those_of_each_row():
    texts = [t or "" for t in ODD]
    data, offsets = arrow.text_bytes(pa.array(ODD))
    found = arrow.words(data, offsets)
    for i, text in enumerate(texts):
        spans = range(found.first[i], found.first[i + 1])
        got = [data[found.starts[k] : found.ends[k]].tobytes().decode() for k in spans]
        assert got == re.findall(r"[^\x20\x09-\x0D]+", text)


def test_equal_spans_have_equal_hashes_wherever_they_lie():
    data, offsets = arrow.text_bytes(pa.array(["ab ab abc", "x", "abc ab"]))
    found = arrow.words(data, offsets)
    hashes = arrow.SpanHashes(data).of(found.starts, found.ends)
    said = [data[a:b].tobytes() for a, b in zip(found.starts, found.ends)]
    for a, x in zip(said, hashes):
        for b, y in zip(said, hashes):
            assert (a == b) == (x == y)


def test_slices_cover_each_row_once_and_stay_small():
    batch = pa.RecordBatch.from_arrays([pa.array(ODD)], names=["t"])
    parts = list(arrow.by_bytes(batch, "t", 100))
    assert [x for p in parts for x in p.column(0).to_pylist()] == ODD
    assert all(p.num_rows == 1 or sum(len((x or "").encode()) for x in p.column(0).to_pylist()) <= 100 for p in parts)


def test_free_names():
    assert names.free_names(["a", "_A"], "a", "b") == ["__a", "b"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB1 \n\t\r.'’é中 \x1f\x85<|>endoftx", max_size=60), max_size=6))
def test_cut_texts_encode_as_whole_ones(texts):
    encoder = tokens.encoder(VOCABULARY)
    whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert encoder.ids(texts) == [np.array(w.ids, dtype="<u4").tobytes() for w in whole]
    assert encoder.counts(texts) == [len(w.ids) for w in whole]
    assert all("".join(tokens.cuts(t)) == t for t in texts)


def test_memory_forgets_but_never_lies():
    memory = tokens.Memory(3)
    for k in range(50):
        memory.put(k, k * 2)
        assert memory.get(k) == k * 2
        assert all(memory.get(j) in (None, j * 2) for j in range(k))


def test_token_counts_are_the_library_s(spark, odd, empty, library):
    got = token_counts.count_tokens(odd, VOCABULARY, keep=("doc_id", "text", "ids", "n_tokens_not_there")[:3])
    for row in got.collect():
        text = row["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (len(text.encode()), n, n > 512)
    assert got.count() == odd.count()
    assert token_counts.count_tokens(empty, VOCABULARY).count() == 0


def _chunk_texts():
    random.seed(3)
    passage = " ".join(random.choice(["alpha", "beta", "gamma,", "42", "delta."]) + str(random.random()) for _ in range(400))
    spaceless = "日本語" * 6000
    return [passage, "intro " + passage, passage + passage, spaceless, "a" * 20_000, "\n" * 9000 + "x" + " " * 5000 + "y"]


def test_chunks_cover_the_bytes_at_characters():
    for text in [*_chunk_texts(), *(t or "" for t in ODD)]:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        ends = bpe.chunks(data)
        assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == len(data)
        assert "".join(data[a:b].tobytes().decode() for a, b in zip([0, *ends], ends)) == text
        assert all(b - a <= bpe.LARGEST for a, b in zip([0, *ends], ends))


def test_equal_passages_share_chunks():
    passage = _chunk_texts()[0]
    encoder = bpe.ChunkEncoder(tokens.Encoder(VOCABULARY))

    def ids(text):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        return encoder.ids([(text.encode(), bpe.chunks(data))])

    ids(passage)
    first = encoder.encoded
    ids("something else before it. " + passage)
    assert encoder.reused >= first // 2


@settings(max_examples=60, deadline=None)
@given(
    st.lists(
        st.tuples(st.text(alphabet="ab1 \n.'é中<|>endoftx", max_size=40), st.integers(1, 60)), min_size=1, max_size=4
    )
)
def test_chunked_ids_are_exact(parts):
    text = "".join(t * n for t, n in parts)
    encoder = bpe.chunk_encoder(VOCABULARY)
    got = encoder.ids([(text.encode(), bpe.chunks(np.frombuffer(text.encode(), dtype=np.uint8)))])
    whole = tokens.encoder(VOCABULARY).tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(got[0], dtype="<u4").tolist() == whole


def test_a_full_memory_still_gives_exact_ids(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_CHUNKS", 3)
    encoder = bpe.ChunkEncoder(tokens.Encoder(VOCABULARY))
    texts = _chunk_texts()
    got = encoder.ids([(t.encode(), bpe.chunks(np.frombuffer(t.encode(), dtype=np.uint8))) for t in texts])
    whole = tokens.encoder(VOCABULARY).tokenizer.encode_batch(texts, add_special_tokens=False)
    assert got == [np.array(w.ids, dtype="<u4").tobytes() for w in whole]


def test_bpe_round_trip_and_digests(spark, odd, empty, library):
    encoded = bpe.encode(odd, VOCABULARY, keep=("doc_id", "text", "ids"))
    assert encoded.columns == ["doc_id", "text", "ids", "n_tokens"]
    back = bpe.decode(encoded, VOCABULARY, keep=("text",))
    assert all(r["decoded"] == (r["text"] or "") for r in back.collect())
    for row in bpe.digests(odd, VOCABULARY, keep=("text",)).collect():
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(empty, VOCABULARY).count() == 0


def test_the_pipeline_s_ids_give_the_texts_again(spark, odd, monkeypatch):
    staged = bpe.tokenize(spark, odd, None)
    texts = pa.array(["some text", None, "", "日本 é\n"])
    assert staged.count() == odd.count()
    assert bpe._reversible(texts, VOCABULARY) == bpe._encode(texts, VOCABULARY)
    right = bpe._encode
    monkeypatch.setattr(bpe, "_encode", lambda column, vocabulary: [x[:-4] for x in right(column, vocabulary)])
    with pytest.raises(ValueError, match="2 of 4 texts"):
        bpe._reversible(texts, VOCABULARY)


def _brute_measures(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(ws),
        "word_chars": sum(map(len, ws)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "n_upper": sum("A" <= c <= "Z" for c in text),
        "n_letters": sum("A" <= c <= "Z" or "a" <= c <= "z" for c in text),
    }


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abA é\n\t#|", max_size=50)), max_size=8))
def test_measures_by_brute_force(texts):
    got = quality_rules._measure(pa.array(texts, type=pa.string()))
    for i, text in enumerate(texts):
        assert dict(zip(quality_rules.MEASURES, (int(m[i]) for m in got))) == _brute_measures(text)


def test_lines_and_windows_that_share_a_hash_are_told_apart():
    """Sums over powers of two to the 64 can't tell these two words apart; their bytes can."""
    bits = [bin(k).count("1") % 2 for k in range(2048)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    text = f"w x y z {one}\nw x y z {other}\n{one}\n{other}\n{one}"
    dup, repeat = (quality_rules._measure(pa.array([text, text, "a"]))[k].tolist() for k in (3, 4))
    assert dup == [1, 1, 0] and repeat == [0, 0, 0]


def test_ledger_policies_and_ablations(spark, odd, empty):
    rows = quality_rules.ledger(quality_rules.measure(odd.where(F.length("text") < 1000), keep=("doc_id", "text")))
    found = rows.withColumn("ok", quality_rules.passes(quality_rules.STRICT)).collect()
    for row in found:
        m = _brute_measures(row["text"])
        failed = {
            "few_words": m["n_words"] < 10,
            "repeated_windows": 100 * m["n_repeat_words"] > 20 * m["n_words"],
            "symbols": 100 * m["n_symbols"] > 10 * m["n_words"],
            "repeated_lines": 100 * m["n_dup_lines"] > 50 * m["n_lines"],
            "short_words": 100 * m["word_chars"] < 200 * m["n_words"],
            "long_words": 100 * m["word_chars"] > 1400 * m["n_words"],
            "shouting": 100 * m["n_upper"] > 40 * m["n_letters"],
            "many_words": m["n_words"] > 1_000_000,
        }
        assert row["fail_bits"] == sum(1 << r.bit for r in quality_rules.RULES if failed[r.name])
        assert row["ok"] == (not any(failed[name] for name in quality_rules.STRICT.rules))
    counted = {r["rule"]: r for r in quality_rules.ablations(rows, quality_rules.STRICT).collect()}
    for rule in quality_rules.RULES:
        if rule.name in quality_rules.STRICT.rules:
            mask = quality_rules.STRICT.mask()
            assert counted[rule.name]["n_failed"] == sum(bool(r["fail_bits"] >> rule.bit & 1) for r in found)
            assert counted[rule.name]["n_only_this"] == sum(r["fail_bits"] & mask == 1 << rule.bit for r in found)
    nothing = quality_rules.ledger(quality_rules.measure(empty))
    assert nothing.count() == 0
    assert {r["n_failed"] for r in quality_rules.ablations(nothing, quality_rules.BASE).collect()} == {0}


def test_bits_are_distinct_and_stable():
    bits = [r.bit for r in quality_rules.RULES]
    assert bits == list(range(len(bits)))


def test_discriminant_is_the_textbook_one():
    random_ = np.random.default_rng(0)
    a = random_.multivariate_normal([0, 0], [[1, 0.3], [0.3, 2]], 500)
    b = random_.multivariate_normal([2, 1], [[2, -0.4], [-0.4, 1]], 700)
    moments = {c: (float(len(x)), x.sum(axis=0), x.T @ x) for c, x in enumerate((a, b))}
    model = quality_model.Discriminant.fit(moments, to_pooled=0, to_identity=0)
    x = random_.normal(size=(50, 2))

    def log_density(rows, sample):
        mean, cov = sample.mean(axis=0), np.cov(sample.T, bias=True)
        away = rows - mean
        return -0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away) - 0.5 * np.log(np.linalg.det(cov))

    odds = log_density(x, b) - log_density(x, a) + np.log(701 / 501)
    assert np.allclose(model.score(x, temperature=1.0), 1 / (1 + np.exp(-odds)), atol=1e-6)


def test_shrinkage_pulls_each_covariance_to_the_pooled_one_and_its_diagonal():
    random_ = np.random.default_rng(4)
    a = random_.multivariate_normal([0, 1, 0], np.diag([1, 3, 0.5]) + 0.2, 40)
    b = random_.multivariate_normal([1, 0, 2], np.diag([2, 1, 4]) - 0.1, 60)
    moments = {c: (float(len(x)), x.sum(axis=0), x.T @ x) for c, x in enumerate((a, b))}
    x = random_.normal(size=(30, 3))
    own = [np.cov(s.T, bias=True) for s in (a, b)]
    pooled = (40 * own[0] + 60 * own[1]) / 100
    for to_pooled, to_identity in ((0.5, 0.0), (0.0, 0.3), (0.3, 0.2), (1.0, 1.0)):
        shrunk = [
            (1 - to_identity) * ((1 - to_pooled) * c + to_pooled * pooled) + to_identity * np.diag(np.diag(pooled))
            for c in own
        ]
        density = []
        for sample, cov in zip((a, b), shrunk):
            away = x - sample.mean(axis=0)
            density.append(-0.5 * (away @ np.linalg.inv(cov) * away).sum(axis=1) - 0.5 * np.linalg.slogdet(cov)[1])
        odds = (density[1] - density[0]) / 2.5 + np.log(61 / 41)
        model = quality_model.Discriminant.fit(moments, to_pooled=to_pooled, to_identity=to_identity)
        assert np.allclose(model.score(x, temperature=2.5), 1 / (1 + np.exp(-odds)), atol=1e-9)


def test_a_missing_class_gives_the_smoothed_share():
    model = quality_model.Discriminant.fit({1: (3.0, np.zeros(2), np.eye(2))})
    assert np.allclose(model.score(np.zeros((2, 2))), 4 / 5)
    assert np.allclose(quality_model.Discriminant.fit({}).score(np.zeros((1, 2))), 0.5)


def plain_statistics(text):
    """The sixteen statistics from their definitions, text by text."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    lines = [line for line in (text or "").encode().split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")]
    sizes = [len(w) for w in words]
    mean = sum(sizes) / max(len(words), 1)
    spread = max(sum(x * x for x in sizes) / max(len(words), 1) - mean * mean, 0) ** 0.5
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    joined = b"".join(words)

    def share(part, whole):
        return math.log((min(part, whole) + 0.5) / (whole - min(part, whole) + 20.0))

    def among(chars):
        return sum(byte in chars for byte in joined)

    marks, upper = b"#*$%&|<>@^~=+_{}[]\\/", string.ascii_uppercase.encode()
    return [
        math.log1p(len(words)),
        math.log1p(mean),
        math.log1p(spread),
        share(len(set(words)), len(words)),
        share(max(Counter(words).values(), default=0), len(words)),
        share(len(windows) - len(set(windows)), len(words)),
        share(len(lines) - len(set(lines)), len(lines)),
        math.log1p(len(words) / max(len(lines), 1)),
        share(among(marks), len(joined)),
        share(among(b"!?"), len(joined)),
        share(among(b"."), len(joined)),
        share(among(b",;:"), len(joined)),
        share(among(b"0123456789"), len(joined)),
        share(among(upper), among(string.ascii_letters.encode())),
        share(sum(byte >= 128 for byte in joined), len(joined)),
        share(sum(w[-1] in marks + b"!?" for w in words), len(words)),
    ]


def test_statistics_by_their_definitions():
    rng = random.Random(12)
    parts = ["the", "the", "Große", "x1", "a,b;", "end.", "what?!", "#tag", "C:\\x/", "名前", "é\u00a0b", "{}", "\n", "\n\n", " \t", "\r"]
    texts = [None, "", " \n\t ", "one", "\n\n", "a b c d e a b c d e\na b c d e\na b c d e"]
    texts += [" ".join(rng.choices(parts, k=rng.randrange(1, 120))) for _ in range(150)]
    texts.append("long word " * 3000 + "y" * 70_000)
    found = quality_model.statistics(pa.array(texts, type=pa.string()))
    assert found.shape == (len(texts), len(quality_model.FEATURES))
    assert np.allclose(found, [plain_statistics(t) for t in texts], atol=1e-6)


def test_statistics_don_t_depend_on_neighbouring_rows():
    texts = [t for t in ODD if t is None or len(t) < 1000]
    together = quality_model.statistics(pa.array(texts))
    for row, text in zip(together, texts):
        assert np.allclose(row, quality_model.statistics(pa.array([text], type=pa.string()))[0])
    assert np.isfinite(together).all()


def test_classifier_on_held_out_rows(spark, small):
    got = quality_model.op3_quality_classifier(spark, small).toPandas()
    labels = spark.read.parquet(f"{small}/labels.parquet").toPandas()
    assert len(got) == 200 and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.7)).all()
    import zlib

    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.85


def test_classifier_on_odd_rows(spark, odd, empty, tmp_path):
    features = quality_model.featurise(odd, keep=("doc_id", "stats"))
    assert features.columns == ["doc_id", "stats"] and features.count() == odd.count()
    labels = spark.createDataFrame([(0, 1), (1, None), (4, 0), (4, 0), (None, 1), (99, 1), (8, 7)], "doc_id long, quality int")
    model = quality_model.fit(features, labels)
    scored = odd.select(quality_model.score_text(F.col("text"), model).alias("s")).collect()
    assert all(0 <= r["s"] <= 1 for r in scored)
    assert quality_model.fit(quality_model.featurise(empty), labels).prior == 0.5


def test_blocks_stop_at_text_ends():
    ids = np.arange(10, 19, dtype=np.int32)
    first = np.array([0, 3, 3, 5, 9])
    for size in (1, 2, 4, 100):
        seen = []
        for block in pseudo_likelihood.blocks(ids, first, size):
            for i, target in enumerate(block.target):
                around = [
                    None if i in block.outside[k] else int(block.ids[i + pseudo_likelihood.REACH + side])
                    for k, side in enumerate(pseudo_likelihood.SIDES)
                ]
                seen.append((int(target), around))
        expected = []
        for a, b in zip(first[:-1], first[1:]):
            own = list(range(10 + a, 10 + b))
            for i, w in enumerate(own):
                sides = [i + s for s in pseudo_likelihood.SIDES]
                expected.append((w, [own[j] if 0 <= j < len(own) else None for j in sides]))
        assert seen == expected


def test_weighted_sums_of_rows_of_equal_values():
    random_ = np.random.default_rng(2)
    many = pseudo_likelihood.MANY
    values = np.repeat([5, 0, 70_000, 9, 3], [1, many - 1, many, 3 * many, 2])
    random_.shuffle(values)
    rows = random_.standard_normal((len(values), 7)).astype(np.float32)
    weights = random_.random(len(values)).astype(np.float32)
    for below, kept in ((70_001, values), (1 << 16, values[values < 1 << 16])):
        mine, own = rows[: len(kept)], weights[: len(kept)]
        order = pseudo_likelihood._order(kept, below)
        found, begins = pseudo_likelihood._runs(kept[order])
        sums = pseudo_likelihood._sums(mine, order, begins, own)
        assert found.tolist() == sorted(set(kept.tolist()))
        expected = [(mine * own[:, None])[kept == v].sum(axis=0) for v in found]
        assert np.allclose(sums, expected, rtol=1e-4, atol=1e-5)


def test_each_neighbour_is_read_and_learned_from_once():
    random_ = np.random.default_rng(3)
    sides, width = pseudo_likelihood.SIDES, pseudo_likelihood.WIDTH
    ids = random_.choice([1, 5, 7, 4000], 60).astype(np.int32)  # some often enough for a product of their own
    first = np.array([0, 0, 1, 3, 20, 20, 60])
    for size in (1, 3, 64):
        network = pseudo_likelihood.Network.fresh(np.ones(pseudo_likelihood.VOCABULARY))
        table = network.parts["embedding"]
        for block in pseudo_likelihood.blocks(ids, first, size):
            n = len(block.target)
            for k, side in enumerate(sides):
                around = [-1 if i in block.outside[k] else block.ids[i + pseudo_likelihood.REACH + side] for i in range(n)]
                own = slice(k * width, (k + 1) * width)
                assert (table.reshape(-1, width)[block.near[k]] == table[around, own]).all()
            got = {}

            class Recorder(pseudo_likelihood.Trainer):
                def _step(self, name, gradient, rows=slice(None)):
                    got.setdefault(name, np.zeros(self.network.parts[name].shape))[rows] += gradient

            Recorder(network).learn(block)
            for k, side in enumerate(sides):  # every word has one neighbour at each side, a text's end among them
                at_side = got["embedding"][:, k * width : (k + 1) * width]
                assert np.allclose(at_side.sum(axis=0), got["bias"], rtol=1e-3, atol=1e-6)
                around = [-1 if i in block.outside[k] else block.ids[i + pseudo_likelihood.REACH + side] for i in range(n)]
                there = np.flatnonzero(np.abs(at_side).sum(axis=1))
                assert set(there) <= {i % len(table) for i in around}


def test_hashes_are_found_without_searching(monkeypatch):
    random_ = np.random.default_rng(8)
    spread = random_.integers(0, 2**64, 50_000, dtype=np.uint64)
    near = np.uint64(77 << 50) + np.arange(40, dtype=np.uint64)  # more than are passed one by one
    ends = np.array([0, 1, 2**64 - 2, 2**64 - 1], dtype=np.uint64)
    side = 64
    searched = []
    search = np.searchsorted

    def counted(sorted_, values, *rest, **named):
        searched.append(np.size(values))
        return search(sorted_, values, *rest, **named)

    for known in (spread[:0], ends[3:], ends[:1], near, np.concatenate([spread[::2], near[1::2], ends[1:3]])):
        known = np.unique(known)
        ids, shares = np.arange(len(known), dtype=np.int32), random_.random(len(known))
        counts = np.arange(side * side, dtype=float)
        vocabulary = pseudo_likelihood.Vocabulary(known, ids, shares, counts, "", 0)
        vocabulary.lookup(spread[:1])  # what is made once
        asked = np.concatenate([spread, near, ends])
        with monkeypatch.context() as m:
            m.setattr(np, "searchsorted", counted)
            got = vocabulary.lookup(asked)
        place = {int(h): k for k, h in enumerate(known)}
        at = np.array([place.get(int(h), -1) for h in asked])
        bucket = len(counts) - side + (asked % np.uint64(side)).astype(np.int64)
        assert (got[2] == (at >= 0)).all()
        assert (got[0] == np.where(at >= 0, at, bucket)).all()
        expected = np.append(shares, 0.0)[at]
        assert np.allclose(got[1], np.where(at >= 0, expected, -np.log(counts[bucket] + 1)))
    assert 0 < max(searched) <= len(near)


def test_gradients_by_differences():
    random_ = np.random.default_rng(1)
    network = pseudo_likelihood.Network.fresh(np.ones(pseudo_likelihood.VOCABULARY))
    ids = random_.integers(0, pseudo_likelihood.VOCABULARY, 40).astype(np.int32)
    (block,) = pseudo_likelihood.blocks(ids, np.array([0, 9, 9, 10, 40]), 64)
    taken = {}

    class Recorder(pseudo_likelihood.Trainer):
        def _step(self, name, gradient, rows=slice(None)):
            taken.setdefault(name, np.zeros(self.network.parts[name].shape))[rows] += gradient

    Recorder(network).learn(block)
    assert set(taken) == set(network.parts)
    for name, gradient in taken.items():
        place = np.unravel_index(np.argmax(np.abs(gradient)), gradient.shape)
        value, losses = network.parts[name][place], []
        for step in (1e-2, -1e-2):
            network.parts[name][place] = value + step
            losses.append(-network.forward(block)[0].mean())
        network.parts[name][place] = value
        assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(gradient[place], rel=0.05, abs=1e-4), name


def test_each_position_has_embeddings_of_its_own():
    assert pseudo_likelihood.VOCABULARY >= 4096
    network = pseudo_likelihood.Network.fresh(np.ones(pseudo_likelihood.VOCABULARY))
    tables = len(pseudo_likelihood.SIDES) * (pseudo_likelihood.VOCABULARY + 1) * pseudo_likelihood.WIDTH
    assert network.parts["embedding"].size == tables
    ids = np.arange(100, 109, dtype=np.int32)
    (block,) = pseudo_likelihood.blocks(ids, np.array([0, len(ids)]), 64)
    before = network.forward(block)[0]
    for k, side in enumerate(pseudo_likelihood.SIDES):  # word 104 as a neighbour at one side only
        changed = pseudo_likelihood.Network.unpack(network.pack())
        changed.parts["embedding"].reshape(-1, len(pseudo_likelihood.SIDES), pseudo_likelihood.WIDTH)[104, k] += 1
        assert np.flatnonzero(changed.forward(block)[0] != before).tolist() == [4 - side]


def test_probabilities_of_all_words_add_up_to_one():
    network = pseudo_likelihood.Network.fresh(np.arange(pseudo_likelihood.VOCABULARY))
    n = pseudo_likelihood.VOCABULARY
    total = 0.0
    for word in range(0, n, 500):
        ids = np.tile(np.array([1, 2, 0, 3, 4], dtype=np.int32), min(500, n - word))
        ids[2::5] = np.arange(word, min(word + 500, n))
        (block,) = pseudo_likelihood.blocks(ids, np.arange(0, len(ids) + 1, 5), len(ids))
        total += np.exp(network.forward(block)[0][2::5]).sum()
    assert total == pytest.approx(1, abs=1e-3)
    assert (pseudo_likelihood.Network.unpack(network.pack()).pack() == network.pack()).all()


@pytest.mark.parametrize("most", [1, 7, 40, 99, 100, 101, 5000])
def test_most_frequent_words_as_by_sorting(spark, most):
    draw = random.Random(most)
    rows = [(w, draw.choice([1, 1, 1, 2, 3, 50, 51, 52, 10_000])) for w in range(-50, 50)]
    frame = spark.createDataFrame(rows, "word long, n long")
    top, total = pseudo_likelihood._most_frequent(frame, most)
    assert [tuple(r) for r in top] == sorted(rows, key=lambda r: (-r[1], r[0]))[:most]
    assert total == sum(n for _, n in rows)
    assert pseudo_likelihood._most_frequent(frame.limit(0), most) == ([], 0)


def test_training_prefers_the_language_it_saw(spark):
    random_ = random.Random(5)
    steps = {"a": "b", "b": "c", "c": "d", "d": "a"}
    rows = []
    for i in range(300):
        word, text = random_.choice("abcd"), []
        for _ in range(200):
            text.append(word)
            word = steps[word]
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    vocabulary, network = pseudo_likelihood.train(spark, docs)
    shuffled = " ".join(random_.choice("abcd") for _ in range(200))
    tests = spark.createDataFrame([(0, rows[0][1]), (1, shuffled), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pseudo_likelihood.score(tests, vocabulary, network).collect()}
    assert got[0]["mean_log_likelihood"] > -0.7 > -1.3 > got[1]["mean_log_likelihood"]
    assert got[2]["log_likelihood"] == got[3]["log_likelihood"] == 0 and got[2]["mean_log_likelihood"] is None
    assert got[0]["log_likelihood"] == pytest.approx(got[0]["mean_log_likelihood"] * 200)


def test_scores_of_odd_and_no_rows(spark, odd, empty):
    vocabulary, network = pseudo_likelihood.train(spark, odd)
    got = pseudo_likelihood.score(odd, vocabulary, network, keep=("doc_id", "n_words"))
    assert got.columns == ["doc_id", "n_words", "log_likelihood", "mean_log_likelihood"]
    assert got.count() == odd.count()
    vocabulary, network = pseudo_likelihood.train(spark, empty)
    assert pseudo_likelihood.score(empty, vocabulary, network).count() == 0
    total = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    assert pseudo_likelihood.score(total, vocabulary, network).first()["log_likelihood"] < 0


@pytest.fixture(scope="module")
def rare():
    """Texts most of whose words are rare, and how often each word occurs."""
    draw = random.Random(21)
    words_ = ["".join(draw.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(20_000)]
    weights = [1 / (k + 50) for k in range(len(words_))]
    texts = [draw.choices(words_, weights, k=200) for _ in range(300)]
    counts = {}
    for word in (w for t in texts for w in t):
        counts[word] = counts.get(word, 0) + 1
    return texts, counts


def test_invented_and_shuffled_words_score_below_prose(spark, rare):
    texts, counts = rare
    assert len(counts) > 2 * pseudo_likelihood.VOCABULARY
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    vocabulary, network = pseudo_likelihood.train(spark, docs)
    draw = random.Random(4)
    shuffled = [["".join(draw.sample(w, len(w))) for w in t] for t in texts[:10]]
    invented = [["".join(draw.choice("qrstuvwxyz") for _ in range(9)) for _ in t] for t in texts[:10]]
    rows = [(k, " ".join(t)) for k, ts in enumerate((texts[:10], shuffled, invented)) for t in ts]
    scored = pseudo_likelihood.score(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary, network)
    means = {k: [r["mean_log_likelihood"] for r in scored.collect() if r["doc_id"] == k] for k in range(3)}
    assert min(means[0]) > max(means[1] + means[2])


def test_each_rest_word_has_its_share_of_a_bucket(spark, rare, monkeypatch):
    texts, counts = rare
    docs = spark.createDataFrame([(" ".join(t),) for t in texts], "text string")
    rows = [(w, w) for w in counts] + [("never", "never"), ("none", ""), ("null", None)]
    single = spark.createDataFrame(rows, "row string, text string")
    got = {}
    for known in (1, 6_000, 1 << 18):  # all rest words by the join, some, none
        monkeypatch.setattr(pseudo_likelihood, "KNOWN", known)
        vocabulary = pseudo_likelihood.learn_vocabulary(spark, docs)
        network = pseudo_likelihood.Network.fresh(vocabulary.counts)
        result = pseudo_likelihood.score(single, vocabulary, network, keep=("row",))
        assert result.columns == ["row", "n_words", "log_likelihood", "mean_log_likelihood"]
        got[known] = {r["row"]: r["log_likelihood"] for r in result.collect()}
    assert got[1] == pytest.approx(got[6_000]) and got[1] == pytest.approx(got[1 << 18])
    assert got[1]["none"] == got[1]["null"] == 0
    hashes = pseudo_likelihood._word_hashes(pa.array(list(counts) + ["never"]))[0]
    ids, _, _ = vocabulary.lookup(hashes)
    side = pseudo_likelihood.side_of(len(counts))
    own = side * side - side
    assert len(vocabulary.counts) == side * side
    totals = {}
    for (word, n), i in zip(counts.items(), ids):
        totals[i] = totals.get(i, 0) + n
    assert vocabulary.counts.tolist() == [totals.get(i, 0) for i in range(side * side)]
    # Alone in a text each word has the same neighbours, so one id has one probability.
    bare = {}
    for word, i in zip([*counts, "never"], ids):
        share = counts.get(word, 0.5) / (totals[i] + 1) if i >= own else 1
        bare.setdefault(int(i), []).append(got[1][word] - np.log(share))
    assert all(max(x) == pytest.approx(min(x), abs=1e-5) for x in bare.values())
    assert sum(np.exp(x[0]) for x in bare.values()) == pytest.approx(1, abs=1e-3)


def test_ids_follow_the_corpus():
    sides = [pseudo_likelihood.side_of(n) for n in (0, 1000, 404_216, 10**8, 10**10)]
    assert sides[0] == sides[1] == 64 < sides[2] < sides[3] < sides[4]
    for side in (1, 2, 64, 65, 72, 283):
        network = pseudo_likelihood.Network.fresh(np.ones(side * side))
        assert all(
            (x == y).all() for x, y in zip(network.parts.values(), pseudo_likelihood.Network.unpack(network.pack()).parts.values())
        )


CHAT = "conv_id long, turn long, role string, text string, turns string, n_turns int"


def test_chat_is_reversible_and_flags_what_is_learned(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|end|><|user|>\\l\\s\\", "", None, "\\p|\\\\l<", "日本\n"]
    rows = [(i, t, ("user", "assistant")[t % 2], nasty[(i + t) % 6], "x", 0) for i in range(6) for t in range(4)]
    rows += [(90, 0, "tool|<\\", "<|end|>", "x", 0), (90, 0, None, None, "x", 0), (90, None, "user", "first", "x", 0)]
    rows += [(91, 0, "user", "same", "x", 0)] * 2 + [(None, 1, "system", "s", None, None)]
    frame = spark.createDataFrame(rows, CHAT)
    chats = chat.format_chats(frame)
    whole = chats.select("conv_id", "segments", "valid", "error_turn", chat.formatted().alias("whole"))
    read = whole.withColumn("read", chat.read_turns(F.col("whole"))).collect()
    assert len(read) == 9
    for row in read:
        own = sorted(
            [r for r in rows if r[0] == row["conv_id"]], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
        )
        assert [(t["role"], t["text"]) for t in row["read"]] == [(r[2] or "", r[3] or "") for r in own]
        assert "".join(s["text"] for s in row["segments"]) == row["whole"]
        learned = [s["text"] for s in row["segments"] if s["loss"]]
        assert len(learned) == sum(r[2] == "assistant" for r in own)
        if row["conv_id"] is not None and row["conv_id"] < 6:
            assert row["valid"] and row["error_turn"] is None
    by_id = {r["conv_id"]: r for r in read}
    assert not by_id[90]["valid"] and by_id[90]["error_turn"] == 2
    assert not by_id[91]["valid"] and by_id[91]["error_turn"] == 2
    assert not by_id[None]["valid"] and by_id[None]["error_turn"] == 2
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_marks_must_be_protected():
    with pytest.raises(ValueError):
        chat.Template(open_mark="[")
