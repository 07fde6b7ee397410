"""Each operator on odd rows: nulls, empty and long texts, repeated rows, empty tables, clashing column names; against libraries or brute force."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldstone.llm import bpe, chat, common, jaccard, library_pieces, licenses, media, packing, pretokens, quality, token_counts, topk, toxicity

WORD, BYTE, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, node string"
ODD = ["Hello world, it's 42!", None, "", " ", "a" * 3000, "don't 'S x  y\n\n z ", "<|endoftext|> a<|startoftext|>", "é é ǅ 漢字 🙂", "Hello world, it's 42!", "x\x00y\x1cz"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i if i != 8 else None, t, "en" if i % 2 else None, "s", 1, 0.5, "n") for i, t in enumerate(ODD)], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, key="doc_id"):
    return sorted(df.collect(), key=lambda r: (r[key] is None, r[key]))


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pretoken_boundaries_match_the_pattern_on_random_texts():
    rnd, enc = random.Random(3), reference()
    codec = bpe.Codec(RANKS, pretokens.tiktoken_classes())
    pieces = codec.pieces()
    texts = ["".join(rnd.choice("ab'stremdvl S  \n\t.!1²é\x1c漢🙂") for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    for t, (ids, offsets, counts) in zip(texts, codec.encode(texts, pieces), strict=True):
        assert ids.tolist() == enc.encode_ordinary(t)
        assert bpe.decode(ids, RANKS) == t.encode()
        assert counts.sum() == len(ids) and (not len(offsets) or offsets[0] == 0)
    assert bpe.merge(b"ab" * 500, bpe.load_ranks(RANKS)) == enc.encode_ordinary("ab" * 500)


def test_codec_digests_and_round_trip(odd, none):
    enc = reference()
    got = rows(bpe.codec_digests(odd, RANKS))
    for r, (i, t) in zip(got, sorted(((i if i != 8 else None, t or "") for i, t in enumerate(ODD)), key=lambda x: (x[0] is None, x[0])), strict=True):
        ids = enc.encode_ordinary(t)
        assert (r.doc_id, r.n_tokens) == (i, len(ids))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    back = rows(bpe.decode_documents(bpe.encode_documents(odd, RANKS), RANKS))
    assert [bytes(r.decoded).decode() for r in back if r.doc_id is not None] == [t or "" for i, t in enumerate(ODD) if i != 8]
    assert bpe.codec_digests(none, RANKS).count() == 0


def test_token_counts_match_the_library(odd, none):
    lib = Tokenizer.from_file(WORD)
    for r in rows(token_counts.token_counts(odd, WORD, limit=3)):
        t = ODD[8 if r.doc_id is None else r.doc_id] or ""
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 3)
    assert token_counts.token_counts(none, WORD).count() == 0


def test_packing_covers_every_id_once_without_gaps(odd, none):
    lib = Tokenizer.from_file(BYTE)
    got = packing.pack_documents(odd, BYTE).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        assert [p.offset for p in parts] == list(np.cumsum([0, *[p.length for p in parts[:-1]]]))
        total = sum(p.length for p in parts)
        assert total <= 1024 and total & (total - 1) == 0
    for i, t in enumerate(ODD):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted((r for r in got if r.doc_id == (i if i != 8 else None)), key=lambda r: r.start)
        assert parts[0].doc_tokens == len(ids) == sum(p.length for p in parts)
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert packing.pack_documents(none, BYTE).count() == 0


def test_packing_balances_steps_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "STEP_TOKENS", 2048)
    docs = spark.createDataFrame([(i, "some words " * (i * 37 % 400)) for i in range(120)], "doc_id long, text string").repartition(5)
    steps, shards = {}, {}
    for r in packing.pack_documents(docs, BYTE).collect():
        steps.setdefault((r.tier, r.step_group), []).append(r.length)
        shards.setdefault((r.tier, r.step_group), set()).add(r.sequence_id >> 40)
    for tier in {t for t, _ in steps}:
        groups = sorted(g for t, g in steps if t == tier)
        assert [g & (1 << 40) - 1 for g in groups] == list(range(len(groups))) and {g >> 40 for g in groups} == {tier}
        assert [sum(steps[tier, g]) for g in groups[:-1]] == [2048] * (len(groups) - 1) and 0 < sum(steps[tier, groups[-1]]) <= 2048
    assert len(steps) > 5 and any(len(s) > 1 for s in shards.values())


@pytest.mark.parametrize("slots", [64, 1 << 12, 1 << 20])
def test_packing_looks_short_pretokens_up_in_arrays_and_gets_the_librarys_ids(monkeypatch, slots):
    rnd, lib, one_by_one = random.Random(5), Tokenizer.from_file(BYTE), []
    assert library_pieces.encoder(BYTE) is library_pieces.encoder(BYTE)
    monkeypatch.setattr(library_pieces.PieceIds, "SLOTS", slots)
    of = library_pieces.LibraryPieces.of
    monkeypatch.setattr(library_pieces.LibraryPieces, "of", lambda self, cut: one_by_one.extend(cut) or of(self, cut))
    pieces, classes = library_pieces.PieceIds(BYTE), pretokens.tokenizers_classes()
    specials = library_pieces.special_tokens(lib)
    words = ["a", "ab", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghabcdefg", "abcdefghabcdefgh", "abcdefghabcdefghi", "é" * 4, "漢" * 6, "x\0y", "!\0!", "\0", "!\0", "!\0\0", "!", "'s", "\n", "<|endoftext|>", "🙂" * 4, "9" * 17]
    for _ in range(20):
        texts = [t or "" for t in ODD] + ["".join(rnd.choice(words) + rnd.choice(["", " ", "  "]) + rnd.choice("abcß漢") * rnd.randint(0, 9) for _ in range(rnd.randint(0, 60))) for _ in range(30)]
        for t, ids in zip(texts, library_pieces.ids_of(texts, pieces, classes, specials), strict=True):
            assert ids.dtype == np.uint32 and ids.tolist() == lib.encode(t, add_special_tokens=False).ids
    assert one_by_one and all(len(p.encode()) > 16 or p.endswith("\0") for p in one_by_one)


def test_media_round_trip_equal_texts_and_retries(spark, odd, none, monkeypatch):
    stored = media.media_column(odd)
    got = rows(media.media_features(stored))
    for r in got:
        data = (ODD[8 if r.doc_id is None else r.doc_id] or "").encode()
        payload = media.padded(data)
        assert len(payload) % 64 == 0 and len(payload) > 0
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
    same = [r for r in got if r.doc_id in (0, None)]
    assert same[0].media_sha256 == same[1].media_sha256 and same[0].feature == same[1].feature
    assert media.media_column(none).count() == 0
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        z.writestr("0/v1", b"payload")
    info = zipfile.ZipFile(buffer).infolist()[0]

    class Flaky:
        opened = 0

        def open_input_file(self, path):
            Flaky.opened += 1
            return io.BytesIO(b"\0" * 10 if Flaky.opened < 3 else buffer.getvalue())

    assert media.member(Flaky(), "x", info) == b"payload" and Flaky.opened == 3
    media._OPEN.clear()
    Flaky.opened = -9
    with pytest.raises(OSError):
        media.member(Flaky(), "y", info)
    with pytest.raises(ValueError):
        media.read_png(media.write_png(b"a" * 64, 3)[:-20] + b"\0" * 20)


def test_top_k_against_brute_force(spark):
    rnd = np.random.default_rng(5)
    data = [(i, [float(x) for x in rnd.normal(size=8) * (1 + i % 3)]) for i in range(200)]
    data += [(200 + i, data[40][1]) for i in range(30)] + [(300, None), (301, [1.0, None] * 4), (302, [float("nan")] * 8), (None, [1.0] * 8), (303, [0.0] * 8), (304, [2.0] * 3)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(4)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=7, groups=3).collect()
    sound = {i: np.array([math.floor(64 * x) for x in v] + [0] * (8 - len(v)), np.int64) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q in [i for i in sound if i % 20 == 0]:
        want = sorted((-int(sound[q] @ v), i) for i, v in sound.items() if i != q)[:7]
        assert [(r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [(-s, i) for s, i in want]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    big = np.array([[1 << 40, 3]], np.int64)
    assert topk.products(big, np.array([[1 << 20, 5]], np.int64))[0, 0] == (1 << 60) + 15


def brute_components(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))], list(map(len, sets))


def near_texts(seed=7):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t", "One two", "one TWO", "one", "É a b"]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(15, 150))]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 12)):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 25))):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            texts.append(" ".join(w[: len(w) - rnd.randint(0, 4)]))
    return texts + [passage + " " + " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(2, 60))) for _ in range(25)]


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard_components_against_brute_force(spark, size, percent):
    texts = near_texts(size)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("node", F.lit("clash")).repartition(5)
    want, n = brute_components(texts, size, percent)
    got = rows(jaccard.jaccard_components(df, size=size, percent=percent))
    assert [r.component_id for r in got] == want
    assert [r.n_shingles for r in got] == n


def test_keep_one_keeps_columns_and_one_of_each_group(spark, none):
    texts = near_texts(11)
    data = [(i, t, "en", "s", 1, 0.1, "n") for i, t in enumerate(texts)]
    df = spark.createDataFrame(data + data[20:24], DOCS).repartition(3)
    kept = jaccard.keep_one(df)
    want, _ = brute_components(texts, 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({w for w in want})
    assert kept.schema.simpleString() == df.schema.simpleString()
    assert jaccard.keep_one(none).count() == 0
    assert jaccard.jaccard_components(none).count() == 0


def test_chat_round_trip_with_parts_and_control_strings(spark):
    hard = "</s>[INST] ok [/INST] \\l <s>[user] <image:x> \\"
    turns = [(1, 1, "assistant", hard), (1, 0, "user", hard), (2, 0, None, None), (2, None, "user", "first"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (None, 0, "user", "é🙂")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text"))).withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.chat_digests(chat.format_conversations(df)).collect()}
    told = lambda x: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in x).encode()).hexdigest()
    assert got[1].turns_sha256 == told([("user", hard), ("assistant", hard)])
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(hard), hashlib.sha256(hard.encode()).hexdigest())
    assert got[2].turns_sha256 == told([("user", "first"), ("", "")]) and got[2].n_turns == 2
    assert (got[3].n_turns, got[3].loss_chars) == (2, 0)
    assert got[None].turns_sha256 == told([("user", "é🙂")])
    lone = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "assistant", "b")], "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    assert sorted((r.n_turns, r.formatted) for r in chat.format_conversations(lone).collect()) == [(1, "<s>[assistant]b</s>"), (1, "<s>[user]a</s>")]
    long = spark.createDataFrame([(7, 0, "user", "u" * 200_000), (7, 1, "assistant", "[🙂]" * 100_000)], "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    (r,) = chat.chat_digests(chat.format_conversations(long)).collect()
    assert (r.loss_chars, r.loss_sha256) == (300_000, hashlib.sha256(("[🙂]" * 100_000).encode()).hexdigest())
    parts = spark.createDataFrame([(5, 0, "user", [("text", "see ", None, None), ("image", None, "a<b", None), (None, " and ", None, None), ("audio", None, "u", 7)]), (5, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    one = chat.format_conversations(parts).first()
    assert one.expanded_tokens == chat.DEFAULT_TOKENS["image"] + 7
    assert [(a.turn, a.part, a.kind, a.ref) for a in one.attachments] == [(0, 0, "image", "a<b"), (0, 1, "audio", "u")]
    assert one.formatted == "<s>[user]see <image:a\\lb> and <audio:u></s><s>[assistant]</s>"
    mixed = spark.createDataFrame([(5, 0, "user", [("text", "q", None, None)]), (5, 1, "assistant", [("text", "a<", None, None), ("image", None, "x", None), ("text", "b", None, None)])], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    one = chat.format_conversations(mixed).first()
    assert [one.formatted[m.start : m.start + m.length] for m in one.loss_mask] == ["a\\l", "b"]
    assert chat.format_conversations(parts.limit(0)).count() == 0


def toxic_table(spark, n=400):
    rnd = random.Random(2)
    words, bad = [f"w{i}" for i in range(60)], ["scum", "moron", "trash", "idiot"]
    data, labels = [], []
    for i in range(n):
        y = int(i % 4 == 0)
        t = [rnd.choice(words) for _ in range(40)]
        for b in rnd.sample(bad, 3) if y else []:
            t[rnd.randrange(40)] = b
        data.append((i, " ".join(t), "en", "s", 1, 0.1, "n"))
        labels.append((i, 1, y))
    data += [(n, None, None, None, None, None, None), (None, "scum moron", "en", "s", 1, 0.1, "n"), (0, "scum moron trash idiot", "en", "s", 1, 0.1, "n")]
    return spark.createDataFrame(data, DOCS).repartition(3), spark.createDataFrame([*labels, (3, None, 0), (None, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_leaves_held_out_rows_alone(spark, none):
    docs, labels = toxic_table(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted((r.doc_id or -1, r.score) for r in toxicity.toxicity(docs, flipped).collect()) == sorted((r.doc_id or -1, r.score) for r in got)
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.count() == sum(1 - r.predicted for r in got) and kept.schema.simpleString() == docs.schema.simpleString()
    assert toxicity.toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}


def test_ftrl_against_plain_sums():
    rnd = random.Random(5)
    data = [sorted(rnd.sample(range(30), rnd.randint(1, 8))) for _ in range(60)]
    y = [int(3 in r or 7 in r) for r in data]
    model = toxicity.Ftrl(l1=0.5, epochs=3)
    at, values, bias = model.fit([np.array(r, np.int32) for r in data], np.array(y, float), np.ones(60), seed=1)
    seen = [sum(f in r for r in data) for f in range(30)]
    z, n, order = dict.fromkeys([*range(30), "bias"], 0.0), dict.fromkeys([*range(30), "bias"], 0.0), np.random.default_rng(1)

    def weight(f):
        l1 = 0 if f == "bias" else 0.5
        return 0.0 if abs(z[f]) <= l1 else -(z[f] - math.copysign(l1, z[f])) / ((model.beta + math.sqrt(n[f])) / model.alpha + model.l2)

    for _ in range(3):
        for i in order.permutation(60).tolist():
            own = [f for f in data[i] if seen[f] >= model.min_rows] + ["bias"]
            w = {f: weight(f) for f in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y[i]
            for f in own:
                sigma = (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / model.alpha
                z[f] += g - sigma * w[f]
                n[f] += g * g
    told = dict(zip(at.tolist(), values.tolist()))
    assert {f for f in range(30) if weight(f)} == set(told) and 3 in told and 7 in told
    assert all(told[f] == pytest.approx(weight(f), rel=1e-5) for f in told) and bias == pytest.approx(weight("bias"), rel=1e-9)


def test_toxicity_scores_long_texts_whole_and_repeated_ids_once(spark):
    docs, labels = toxic_table(spark)
    more = docs.unionByName(docs.filter("doc_id = 4").crossJoin(spark.range(300)).drop("id"))
    at, values, bias = toxicity.train(more, labels)
    long = "w1 w2 " * 120_000 + "scum moron trash idiot"
    got = toxicity.toxicity(more.unionByName(spark.createDataFrame([(9000, long, "en", "s", 1, 0.1, "n")], DOCS)), labels).filter("doc_id = 9000").first()
    dense = toxicity._dense(at, values)
    _, feature = toxicity.features([long], toxicity.word_hashes())
    assert got.score == pytest.approx(1 / (1 + math.exp(-(bias + sum(dense[f] for f in set(feature.tolist()))))), rel=1e-6)
    plain = toxicity.train(docs, labels)
    assert (plain[0].tolist(), plain[1].tolist(), plain[2]) == (at.tolist(), values.tolist(), bias)


def test_toxicity_sample_comes_to_the_driver_by_partitions(spark, monkeypatch):
    docs, labels = toxic_table(spark)
    whole = type(docs).collect

    def collect(df):
        assert "features" not in df.columns
        return whole(df)

    monkeypatch.setattr(type(docs), "collect", collect)
    assert len(toxicity.train(docs, labels)[0])


def test_toxicity_learns_from_every_row_and_feature(spark, monkeypatch):
    """A long row's features and the texts of a repeated id all count; shards learn what a single one does."""
    whole = toxicity.Ftrl.learn
    held = []

    def learn(self, z, n, rows, labels, importance):
        whole(self, z, n, rows, labels, importance)
        held.append((sorted((r.tolist(), y) for r, y in zip(rows, labels, strict=True)), n[-1]))

    texts = [" ".join(f"v{i}" for i in range(5000)), "good words of the day", "other words of the day", "scum of the day", ""]
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1][:4]
    docs = spark.createDataFrame([(ids[0], texts[0]), (ids[1], texts[1]), (ids[1], texts[2]), (ids[1], texts[1]), (ids[2], texts[3]), (ids[3], texts[4])], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(ids[0], 1), (ids[1], 0), (ids[2], 1), (ids[3], 0)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "tidy", lambda run: run)
    monkeypatch.setattr(toxicity, "_summed", lambda spark, shards, work, parts: _dense_sums([work(k) for k in range(shards)]))
    monkeypatch.setattr(toxicity, "_sums", lambda told: told)
    monkeypatch.setattr(toxicity.Ftrl, "learn", learn)
    toxicity.train(docs, labels, model=toxicity.Ftrl(min_rows=1, epochs=1))
    hashes = toxicity.word_hashes()
    want = sorted((sorted(set(toxicity.features([t], hashes)[1].tolist())), y) for t, y in zip(texts, (1, 0, 0, 1, 0), strict=True))
    assert [rows for rows, _ in held] == [want] and max(len(r) for r, _ in want) > 8192


def _dense_sums(told):
    out = np.zeros((1 << toxicity.BITS) + 1), np.zeros((1 << toxicity.BITS) + 1)
    for at, a, b in told:
        out[0][at] += a
        out[1][at] += b
    return out


def test_toxicity_by_shards_is_the_mean_of_their_passes(spark, monkeypatch):
    docs, labels = toxic_table(spark)
    monkeypatch.setattr(toxicity, "PIECE_ROWS", 40)
    model = toxicity.Ftrl(l1=1.0, epochs=2)
    at, values, bias = toxicity.train(docs, labels, model=model, shard_rows=90)
    again = toxicity.train(docs.repartition(7), labels, model=model, shard_rows=90)
    assert (again[0].tolist(), again[1].tolist(), again[2]) == (at.tolist(), values.tolist(), bias)
    score = toxicity._scores(["w1 w2 scum w3 moron", "w1 w2 w3 w4"], toxicity._dense(at, values), bias, toxicity.word_hashes())
    assert len(at) and score[0] > 0.7 > score[1]


def test_toxicity_states_of_shards_leave_no_files(spark, monkeypatch, tmp_path):
    """What shards tell is added up without a shuffle, whose files would stay for all passes, and is deleted then."""
    number = spark._jsc.sc().newShuffleId
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    at, first = np.array([1, 70_000, 1 << 20]), number()
    told = toxicity._summed(spark, 3, lambda k: (at, np.array([1.0, 2.0, 3.0]), np.array([0.5 * k, 0.0, k])), 2)
    assert number() == first + 1
    assert [p.name for p in tmp_path.iterdir()] == [told.rsplit("/", 1)[1]]
    a, b = toxicity._sums(told)
    assert (a[at].tolist(), b[at].tolist(), np.count_nonzero(a), np.count_nonzero(b)) == ([1.5, 3.0, 4.5], [0.75, 0.0, 1.5], 3, 2)


def brute_nll(trusted, text):
    """Interpolated modified Kneser-Ney of order 4, as plainly as possible."""
    grams = {}
    for t in trusted:
        s = "\0\0\0" + t
        for i in range(3, len(s)):
            grams[s[i - 3 : i + 1]] = grams.get(s[i - 3 : i + 1], 0) + 1
    levels = {4: grams}
    for k in (3, 2, 1):
        levels[k] = {}
        for g in levels[k + 1]:
            levels[k][g[1:]] = levels[k].get(g[1:], 0) + 1
    discounts = {}
    for k, own in levels.items():
        n = [sum(1 for c in own.values() if c == i) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        discounts[k] = [0.0] + [max(0.0, min(float(i), i - (i + 1) * y * n[i + 1] / n[i])) if n[i] and n[i + 1] else 0.5 * i for i in (1, 2, 3)]

    def p(k, g):
        own, d = levels[k], discounts[k]
        below = p(k - 1, g[1:]) if k > 1 else 1 / (len(own) + 1)
        context = [c for x, c in own.items() if x[:-1] == g[:-1]]
        if not context:
            return below
        c = own.get(g, 0)
        return (c - d[min(c, 3)]) / sum(context) + sum(d[min(x, 3)] for x in context) / sum(context) * below

    s = "\0\0\0" + text
    return -sum(math.log(p(4, s[i - 3 : i + 1])) for i in range(3, len(s)))


def test_perplexity_against_plain_kneser_ney(spark):
    trusted = ["the cat sat on the mat", "the dog sat", "a cat and a dog ate", "é à la carte", ""]
    texts = ["the cat ate", "zzz qqq", "é à", "", None, "the cat ate"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(2)
    got = rows(quality.perplexities(df, spark.createDataFrame([(t,) for t in trusted], "text string")))
    for r in got:
        t = texts[r.doc_id] or ""
        assert r.chars == len(t) and r.nll == pytest.approx(brute_nll(trusted, t), rel=1e-9, abs=1e-9)


def test_quality_rejects_junk_and_keeps_clean_rows(spark, none):
    rnd = random.Random(4)
    clean = lambda: " ".join(rnd.choice(["the", "cat", "sat", "on", "a", "mat", "and", "ran"]) for _ in range(60))
    data = [(i, clean() if i % 5 else "#$%& | " * 40, "en" if i % 2 else None, "s", 1, 0.1, "n") for i in range(200)]
    data += [(900, None, "en", "s", 1, 0.1, "n"), (901, "", "xx", "s", 1, 0.1, "n"), (902, clean(), "xx", "s", 1, 0.1, "n"), (902, clean(), "xx", "s", 1, 0.1, "n"), (None, clean(), "en", "s", 1, 0.1, "n")]
    docs = spark.createDataFrame(data, DOCS).withColumn("nll", F.lit(1)).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 200, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(data)
    for r in got:
        junk = r.doc_id is not None and r.doc_id < 200 and r.doc_id % 5 == 0
        assert r.rejected == junk, r
    kept = quality.reject_poor(docs, labels)
    assert kept.count() == sum(not r.rejected for r in got) and kept.schema.simpleString() == docs.schema.simpleString()
    assert not any(r.rejected for r in quality.quality(docs, labels.limit(0)).collect())
    assert quality.quality(none, labels).count() == 0


def test_quality_spares_languages_with_few_trusted_texts(spark):
    rnd = random.Random(6)
    own = {"en": ["the", "cat", "sat", "on", "a", "mat", "and", "ran"], "es": ["el", "gato", "duerme", "sobre", "una", "mesa", "muy", "vieja", "hoy"]}
    clean = lambda lang, n: " ".join(rnd.choice(own[lang]) for _ in range(n))
    data = [(i, clean("en", rnd.randint(20, 80)), "en", "s", 1, 0.1, "n") for i in range(150)]
    data += [(1000 + i, clean("es", rnd.randint(20, 80)), "es", "s", 1, 0.1, "n") for i in range(120)]
    data += [(3000 + i, clean("es", 30), "pt", "s", 1, 0.1, "n") for i in range(5)]
    docs = spark.createDataFrame(data, DOCS).repartition(3)
    for n in (0, 1, 3):
        labels = spark.createDataFrame([(i, 1, 0) for i in [*range(150), *range(1000, 1000 + n)]], "doc_id long, quality int, toxic int")
        got = quality.quality(docs, labels).collect()
        assert len(got) == len(data) and not [r for r in got if r.rejected and r.lang != "en"]


def test_quality_scores_and_thresholds_come_from_models_without_the_text(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("abcdefghij ") for _ in range(rnd.randint(90, 150))) for _ in range(60)] + ["z" * 300 + "🙂𐍈" * 20]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    got = rows(quality.quality(docs, labels))
    hashes = [r.h for r in docs.orderBy("doc_id").select(F.xxhash64("text").alias("h")).collect()]
    costs = [brute_nll([x for x, g in zip(texts[:60], hashes) if g % 2 != h % 2], t) for t, h in zip(texts, hashes)]
    for r in [*got[:4], got[60]]:
        assert r.log_perplexity == pytest.approx(costs[r.doc_id] / len(texts[r.doc_id]), rel=1e-9)
    mean = sum(costs[:60]) / sum(map(len, texts[:60]))
    mixed = [(c + quality.PRIOR_CHARS * mean) / (len(t) + quality.PRIOR_CHARS) for c, t in zip(costs, texts)]
    limit = sorted(mixed[:60])[math.ceil(quality.QUANTILE * 60) - 1]
    assert all(r.threshold == pytest.approx(limit, rel=1e-9) for r in got)
    assert [r.rejected for r in got] == [m > limit * (1 + 1e-12) for m in mixed]


def test_licences_are_found_and_confirmed(spark, none):
    noise = "\n".join(f"plain words of paragraph {i} about the weather and of trees in the wood" for i in range(40))
    data = [(1, noise + "\nReleased under the MIT License.\n" + noise), (2, noise), (3, None), (4, ""), (5, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0."), (5, "Licensed under the Apache License, Version 2.0."), (6, "the license of the version of the work")]
    got = licenses.scan(spark.createDataFrame(data, "doc_id long, text string").withColumn("family", F.lit(0))).filter("confirmed").collect()
    assert sorted((r.doc_id, r.family) for r in got) == [(1, "mit"), (5, "apache-2.0"), (5, "apache-2.0")]
    assert next(r.paragraph for r in got if r.doc_id == 1) == 40
    assert licenses.scan(none).count() == 0


def test_licence_level_covers_all_paragraphs_with_repeats(spark):
    plain = "\n".join(f"plain words of paragraph {i} about the weather and of trees in the wood" for i in range(1500))
    odd = "mit license released project mit license terms released mit license"
    data = [(1, plain), (2, "\n".join([odd] * 6)), (3, "Released under the MIT License.")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = licenses.scan(df, background=20).collect()
    assert [r.doc_id for r in got if r.confirmed] == [3]
    assert sum(not r.confirmed for r in got) <= licenses.FALSE_SHARE * 1506


def test_licence_paragraphs_near_misses_and_wrapped_notices(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files, to deal in\nthe Software without restriction."
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation."
    data = [
        (1, "a 'MIT License' is one that we discussed under the tree"), (2, "This library is licensed under the GNU Lesser General Public License, version 3."),
        (3, "Some words.\n\n" + mit + "\n\nOther words."), (4, gpl), (5, "Licensed under the\nApache License,\nVersion 2.0."),
        (6, "Wind and rain. Released under the MIT License. The trees stood still."), (None, "Released under the MIT License."), (7, "x" * 400_000 + "\nReleased under the MIT License.\n" + "y z " * 100_000),
    ]
    got = [r for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect() if r.confirmed]
    told = sorted(((r.doc_id or 0, r.family, r.paragraph, r.last_line) for r in got))
    assert told == [(0, "mit", 0, 0), (2, "lgpl", 0, 0), (3, "mit", 2, 4), (4, "gpl", 0, 2), (5, "apache-2.0", 0, 2), (6, "mit", 0, 0), (7, "mit", 1, 1)]
    assert all(any(a in t.lower() for a in licenses.ANCHORS) for ts in licenses.TEMPLATES.values() for t in ts)


def test_licence_paragraphs_of_texts_without_an_anchor(spark):
    cut_off = "free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."
    assert not any(a in cut_off.lower() for a in licenses.ANCHORS)
    df = spark.createDataFrame([(1, cut_off), (2, "Rain fell on the hills.\n" + cut_off + "\nWind came."), (3, "Rain fell on the hills.")], "doc_id long, text string")
    assert {(r.doc_id, r.family, r.paragraph) for r in licenses.scan(df).collect() if r.confirmed} == {(1, "mit", 0), (2, "mit", 1)}


def test_licence_paragraphs_of_pieces_that_do_not_speak(spark):
    """A long sentence that names a licence has too few pairs of the templates to speak, but the classifier knows it: it gives a row
    once there are so many other paragraphs that the level leaves room for it."""
    prose = "\n".join(f"plain words of paragraph {i} about weather and hills" for i in range(2200))
    long = "After weeks of long talks between all of our old friends in town we are glad that today it was at last released under a new, kind, short, friendly text, that is the MIT one, says everyone who came to see us"
    df = spark.createDataFrame([(1, prose), (2, long), (3, "Released under the MIT License.")], "doc_id long, text string")
    assert licenses.paragraphs(df, "doc_id", "text").filter("id = 2").count() == 0
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert set(got) == {2, 3} and (got[2].family, got[2].confirmed, got[2].paragraph, got[2].text) == ("mit", False, 0, long)
    assert [r.doc_id for r in licenses.scan(df.filter("doc_id > 1")).collect()] == [3]


def test_licence_pieces_below_the_bound_are_not_scored(spark, monkeypatch):
    """The bound never leaves out what the classifier would give to a family, and few pieces of prose come to the classifier."""
    rnd, scored = random.Random(4), []
    terms = licenses.vocabulary(spark)
    known = sorted({w for t in terms.vocabulary for w in t.split(" ")})
    texts = [" ".join(rnd.choice(terms.vocabulary if k % 2 else known) for _ in range(1 + k % 9)) for k in range(400)]
    prose = [f"plain words about weather, rain and hills, told by number{i}" for i in range(300)]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts + prose)], "id long, paragraph int, text string").withColumn("agrees", F.col("id") < 400)
    vocabulary, model, _ = licenses.train(df, background=100)
    told = licenses._top(model.transform(licenses._features(df, vocabulary))).select("id", (F.col("top.probability") >= licenses.LEAST).alias("likely"), licenses._bound(vocabulary, model)(licenses.words(F.col("text"))).alias("near")).collect()
    assert all(r.near for r in told if r.likely) and 20 < sum(r.likely for r in told) < 400
    assert not any(r.near for r in told if r.id >= 400)
    top = licenses._top
    monkeypatch.setattr(licenses, "_top", lambda df: (scored.append(df.count()), top(df))[1])
    licenses._others(spark.createDataFrame([(1, "\n".join(prose)), (2, None), (3, "")], "doc_id long, text string"), "doc_id", "text", vocabulary, model)
    assert scored == [0]


def test_licence_notices_of_one_word_a_line_and_side_by_side(spark):
    dual = "Released under the MIT License.\nLicensed under CC BY 4.0.\nSPDX-License-Identifier: EPL-2.0"
    data = [(1, "Rain fell.\nReleased\nunder\nthe\nMIT\nLicense."), (2, "Licensed under the\nApache\nLicense, Version 2.0."), (3, dual), (None, dual), (3, dual), (4, "Rain\nfell\non\nthe\nhills")]
    got = [r for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect() if r.confirmed]
    told = sorted((r.doc_id or 0, r.paragraph, r.last_line, r.family) for r in got)
    three = [(0, 0, "mit"), (1, 1, "cc-by"), (2, 2, "epl")]
    assert told == [(0, *x) for x in three] + [(1, 1, 5, "mit"), (2, 0, 2, "apache-2.0")] + [(3, *x) for x in three for _ in range(2)]


def test_licence_scores_and_agreement_against_plain_sums(spark):
    import re

    texts = [t for ts in licenses.TEMPLATES.values() for t in ts][::3] + licenses.NEGATIVES[:4] + ["Released under the MIT license terms of the project"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def terms(t):
        w = [x for x in re.split(r"[^\w.]+|\.(?=\s|$)", t.lower().replace("_", " ")) if x]
        return w, [f"{a} {b}" for a, b in zip(w, w[1:])] if len(w) > 1 else w

    def agreement(t, family):
        found = set(terms(t)[1])
        sets = [set(terms(x)[1]) for x in licenses.TEMPLATES[family]]
        return max(len(found & s) / len(s) for s in sets), len(found & set().union(*sets)) / len(found)

    found = licenses.paragraphs(docs, "doc_id", "text").withColumn("agrees", F.lit(False))
    vocabulary, model, _ = licenses.train(found, background=5)
    place = {t: i for i, t in enumerate(vocabulary.vocabulary)}
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    scored = model.transform(licenses._features(found, vocabulary)).collect()
    assert len(scored) >= 10
    for r in scored:
        x = np.zeros(len(place))
        x[[place[t] for part in terms(r.text) for t in part if t in place]] = 1
        z = weights @ x + bias
        assert r.probability.toArray() == pytest.approx(np.exp(z - z.max()) / np.exp(z - z.max()).sum(), abs=1e-9)
    for r in licenses.scan(docs).collect():
        forward, backward = agreement(r.text, r.family)
        assert r.similarity == pytest.approx(forward)
        assert not r.confirmed or (forward >= licenses.FORWARD and backward >= licenses.BACKWARD and forward >= max(agreement(r.text, f)[0] for f in licenses.TEMPLATES))
