"""The pipeline's stages on a small table, each against what it should leave."""

import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import corpus_pipeline
import numpy as np
import pyarrow as pa
from fieldstone.llm import common, jaccard, toxicity
from fieldstone.llm.common import cut
from tests.llm.test_operators import brute_components


def test_stages_in_order(spark, tmp_path):
    rnd = random.Random(9)
    words = ["the", "cat", "sat", "on", "a", "mat", "and", "ran", "home", "then", "by", "night"]
    bad = ["scum", "moron", "trash", "idiot"]
    data, labels = [], []
    for i in range(300):
        t = [rnd.choice(words) for _ in range(50)]
        if i % 6 == 0:
            for b in rnd.sample(bad, 3):
                t[rnd.randrange(50)] = b
        text = "%$ | ## " * 30 if i % 10 == 1 else " ".join(t)
        data.append((i, text, "en", "s", len(text)))
        labels.append((i, int(i % 10 != 1), int(i % 6 == 0)))
    data += [(1000 + i, data[i * 6 + 2][1], "en", "s", 5) for i in range(20)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, str(tmp_path)), name)
        left[name] = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sum(i % 6 == 0 for i in left["toxicity"] if i < 300) <= 2 and sum(i % 6 != 0 for i in left["toxicity"] if i < 300) >= 248
    assert not any(i % 10 == 1 for i in left["quality"] if i < 300) and len(left["quality"]) >= len(left["toxicity"]) - 31
    before = sorted(left["quality"].items())
    groups, _ = brute_components([t for _, t in before], 5, 80)
    assert sorted(left["near_duplicates"]) == sorted({before[g][0] for g in groups})
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(left["near_duplicates"])


DOCS, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"


def _put(spark, folder, docs, labels):
    spark.createDataFrame(docs, DOCS).repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")


def test_odd_rows_pass_every_stage(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and ids: nothing is rejected without labels, and one of each group stays."""
    long = " ".join(f"w{i % 7919}x{i}" for i in range(60_000))
    rows = [
        (None, None, None, None, None), (None, None, None, None, None), (1, "", "en", "s", 0), (2, None, None, "s", None), (3, long, "en", None, 9), (4, long + " end", None, "s", 9),
        (5, "one two three four five six", "en", "s", 5), (5, "one two three four five six", "en", "s", 5), (None, "one two three four five six", None, None, 5), (6, "alone", "de", "s", 5), (7, "alone", "de", "s", 5),
    ]
    _put(spark, tmp_path, rows, [(None, None, None)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, str(tmp_path)), name)
    left = sorted(((r.doc_id is None, r.doc_id or 0, len(r.text or "")) for r in docs.collect()))
    assert left == [(False, 1, 0), (False, 2, 0), (False, 3, len(long)), (False, 5, 27), (False, 6, 5), (True, 0, 0), (True, 0, 0)]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = {r.doc_id: r.doc_tokens for r in pieces}
    assert set(whole) == {None, 1, 2, 3, 5, 6} and all(sum(r.length for r in pieces if r.doc_id == i) == n for i, n in whole.items() if i is not None)
    assert [r.doc_tokens for r in pieces if r.doc_id is None] == [1, 1]


def test_empty_tables(spark, tmp_path):
    _put(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_tables_between_stages_send_python_small_batches(spark):
    """10,000 long texts as one batch were what the JVM held outside its heap, several times over, for each task."""
    key = common.BATCH[0]

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    texts = spark.range(0, 9000, 1, 1).selectExpr("repeat('x', 4000) as text")
    told = texts.mapInArrow(sizes, "n long, size long")
    got = cut(told, "sizes").collect()
    assert sum(r.n for r in got) == 9000 and max(r.size for r in got) < 5 << 20
    assert spark.conf.get(key, None) is None
    spark.conf.set(key, "8m")
    try:
        own = cut(told, "sizes").collect()
        assert sum(r.n for r in own) == 9000 and 6 << 20 < max(r.size for r in own) < 9 << 20 and spark.conf.get(key) == "8m"
    finally:
        spark.conf.unset(key)


def test_memory_is_released_around_each_partition(monkeypatch):
    seen = []
    monkeypatch.setattr(common, "release", lambda: seen.append("released"))

    def run(batches):
        for b in batches:
            seen.append(b)
            yield b

    assert list(common.tidy(run)([1, 2])) == [1, 2] and seen == ["released", 1, 2, "released"]


def test_the_driver_releases_what_training_took(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(common, "release", lambda: seen.append("released"))
    docs = spark.createDataFrame([(i, "ab cd") for i in range(9)], "doc_id long, text string")
    weights = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, toxic int"))
    assert len(weights) == 3 and seen == ["released"]


def test_a_portion_of_shingles_is_in_memory_about_once(monkeypatch):
    """Each worker held a portion as sets, joined, ordered and numbered at once: 2,097,152 shingles took 130 MB and more of an executor."""
    monkeypatch.setattr(jaccard, "PORTION", 1 << 18)
    monkeypatch.setattr(jaccard, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    rnd = random.Random(5)
    texts = [" ".join(str(rnd.randrange(10**6)) for _ in range(2000)) for _ in range(400)]
    texts += texts[:40]
    batches = [pa.record_batch([pa.array(texts[i : i + 20])], ["text"]) for i in range(0, len(texts), 20)]
    frame = SimpleNamespace(mapInArrow=lambda run, schema: run)
    none = SimpleNamespace(read=lambda part, columns: None)
    list(jaccard._portions(batches[:1], 3, set(), 0))  # what is made once a worker

    def peak(run, take):
        tracemalloc.start()
        try:
            for batch in run(iter(batches)):
                take(batch)
                del batch
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    spread, reduced = [], []
    most = peak(jaccard._spread(frame, 3, none, 4), spread.append)
    rows = pa.Table.from_batches(spread)
    told = pa.concat_tables([jaccard._told(rows.filter(pa.compute.equal(rows.column("bucket"), b))) for b in range(16)])
    own = SimpleNamespace(read=lambda part, columns: told.select(columns) if part == 3 else None)
    most = max(most, peak(jaccard._reduced(frame, 3, 90, none, own), reduced.append))
    assert rows.num_rows == 4 * 16 and most < 48 * jaccard.PORTION

    want = Counter(x for t in texts for x in jaccard.shingle_sets([t], 3)[0].tolist())
    got = Counter()
    for r in rows.to_pylist():
        for low, n in zip(np.frombuffer(r["keys"], np.uint32).tolist(), np.frombuffer(r["counts"], np.uint8).tolist(), strict=True):
            got[r["bucket"] << 32 | low] += n
    assert got == Counter({k: sum(n for _, n in g) for k, g in _grouped((x >> 28, n) for x, n in want.items())})
    nodes = [r for b in reduced for r in b.to_pylist()]
    assert Counter(r["node"] for r in nodes) == Counter(jaccard.node_of(jaccard.shingle_sets([t], 3)[0]) for t in texts[:40] + texts[400:])
    assert all(r["n"] == 1998 and r["alone"] == 0 and set(r["magnitudes"]) == {2} for r in nodes)


def _grouped(pairs):
    found = {}
    for k, n in pairs:
        found.setdefault(k, []).append((k, n))
    return found.items()
