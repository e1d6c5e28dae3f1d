"""Classifiers on held-out rows, neighbours against brute force, records by a round trip, personal data
against plain matching, and the pipeline."""

import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyfield.llm import ann, pii, quality, records, registered, toxicity
from tallyfield.llm.common import table
from tallyfield.llm.labelled import first_by_hash
from tallyfield.llm.tokens import Encoder
from tests.llm import cases

SF = "/root/testdata/sf0.1"  # enough labels to learn from


def held_out_accuracy(spark, scores, label, held, folds):
    labels = table(spark, SF, "labels").select("doc_id", F.col(label).alias("label"))
    rows = scores.join(labels, "doc_id").where("held_out").collect()
    assert rows and all(cases.in_fold(r.doc_id, folds) == held for r in rows)
    return np.mean([r.predicted == r.label for r in rows])


def test_quality_of_held_out_rows(spark):
    scores = registered.op10_quality(spark, SF)
    assert scores.count() == table(spark, SF, "documents").count()
    assert held_out_accuracy(spark, scores, "quality", 1, 3) >= 0.97


def test_toxicity_of_held_out_rows(spark):
    scores = registered.op2_toxicity(spark, SF)
    assert scores.count() == table(spark, SF, "documents").count()
    assert held_out_accuracy(spark, scores, "toxic", 0, 5) >= 0.95


@pytest.mark.parametrize(
    "run,label,folds,held",
    [(quality.quality_scores, "quality", 3, 1), (toxicity.toxicity_scores, "toxic", 5, 0)],
)
def test_held_out_labels_are_not_used(spark, run, label, folds, held):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    is_held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held
    changed = labels.withColumn(label, F.when(is_held, 1 - F.col(label)).otherwise(F.col(label)))
    assert sorted(run(docs, labels).collect()) == sorted(run(docs, changed).collect())


def test_samples_are_of_distinct_ids(spark):
    """One id in most rows takes one place of a sample, and few rows are compared for it."""
    ids = spark.range(3_000).selectExpr("if(id % 3 = 0, 7, id) AS doc_id").union(spark.sql("SELECT NULL"))
    found = [r.doc_id for r in first_by_hash(ids, 100, "s").collect()]
    assert len(set(found)) == len(found) == 100
    all_ = [r.doc_id for r in first_by_hash(ids, 5_000, "s").collect()]
    assert len(set(all_)) == len(all_) == 2_000 and set(found) < set(all_)
    place = F.xxhash64(F.lit("s"), "doc_id")
    first = ids.where("doc_id is not null").distinct().orderBy(place).limit(100)
    assert sorted(found) == sorted(r.doc_id for r in first.collect())


def test_one_id_in_many_rows_does_not_fill_the_sample(spark):
    docs = [(5, f"text {i}") for i in range(300)] + [(i, f"good plain words {i % 9}") for i in range(10, 200)]
    labels = [(i, i % 2, i % 2) for i in range(10, 200)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_scores(cases.documents(spark, docs), frame, most_unlabelled=100).collect()
    again = toxicity.toxicity_scores(cases.documents(spark, docs).repartition(5), frame, most_unlabelled=100).collect()
    assert len(rows) == len(docs) and sorted(rows) == sorted(again)


@pytest.mark.parametrize("run", [quality.quality_scores, toxicity.toxicity_scores])
def test_scores_of_odd_documents(spark, run):
    labels = spark.createDataFrame(
        [(1, 1, 1), (2, 0, 0), (2, 1, 0), (6, None, None), (None, 1, 1), (8, 0, 1), (99, 1, 0)],
        "doc_id long, quality int, toxic int",
    ).withColumn("text", F.lit("clash"))
    rows = run(cases.odd(spark), labels).collect()
    assert len(rows) == len(cases.ODD_ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert run(cases.empty(spark), labels).count() == 0
    assert len(run(cases.odd(spark), labels.where("false")).collect()) == len(cases.ODD_ROWS)


def test_toxicity_sample_is_bounded_in_rows(spark, monkeypatch):
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda p, u, prior: seen.append((len(p), len(u))) or fit(p, u, prior))
    hot = next(i for i in range(100) if not cases.in_fold(i, 5) == 0)
    docs = cases.documents(spark, [(hot, f"text number {k}") for k in range(60)], False)
    labels = spark.createDataFrame([(hot, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(docs, labels, most_positive=1, most_unlabelled=5).count() == 60
    assert seen[0][0] == 1 and 0 < seen[0][1] <= 5


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = np.zeros((4_000, len(quality.FEATURES)))
    x[:, :3] = rng.random((4_000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3_000], y[:3_000])
    assert (0, 1) in [(i, j) for i, j, _ in model.pairs]
    assert ((model.score(x[3_000:]) >= 0.5) == y[3_000:]).mean() > 0.95


def brute(vectors: dict, query: int, k: int) -> list[tuple]:
    q = np.array(vectors[query], float)
    scored = [(-(q * np.array(v, float)).sum(), i) for i, v in vectors.items() if i != query]
    return [(i, -s) for s, i in sorted(scored)[:k]]


def test_neighbours_against_brute_force(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    vectors = {r.vec_id: r.embedding for r in df.collect()}
    rows = registered.op4_ann(spark, "/root/testdata/sf0.1").collect()
    found: dict = {}
    for r in sorted(rows):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    assert set(found) == {i for i in vectors if i % 20 == 0}
    hits = total = 0
    for query, near in found.items():
        assert len(near) == 20
        best = brute(vectors, query, 20)
        hits += len({i for i, _ in best} & {i for i, _ in near})
        total += 20
        for i, score in near:
            exact = (np.array(vectors[query], float) * np.array(vectors[i], float)).sum()
            assert abs(exact - score) < 1e-12
    assert hits / total >= 0.95


def brute_rows(rows: list, k: int = 20) -> list[tuple]:
    """(query id, rank, id, score) of every row that is a query, among all other rows."""
    found = []
    for at, (i, v) in enumerate(rows):
        if i % 20 == 0:
            scored = [(-float((np.array(v) * np.array(w)).sum()), j) for n, (j, w) in enumerate(rows) if n != at]
            found += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(found)


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), 1.0, 0.5]) for i in range(1, 200)]
    rows += [(20, [6.0, 1.0, 0.5]), (20, [6.0, 1.0, 0.5]), (40, [0.0, 0.0, 1.0])]  # repeated rows and ids
    odd = [(200, None), (220, [0.0, 0.0, 0.0]), (240, [1.0, None, 1.0]), (260, [nan, 1.0, 1.0]), (280, [inf, 1.0, 1.0])]
    odd += [(300, [1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    df = df.withColumns({c: F.lit("clash") for c in ("row", "block", "cell", "bound", "visited", "reached", "group", "part")})
    found = ann.nearest(df, F.col("vec_id") % 20 == 0, block_rows=50, query_rows=3).collect()
    assert sorted(map(tuple, found)) == brute_rows(rows)
    assert ann.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.nearest(df.where("vec_id in (21, 22) or vec_id = 60"), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(60, 1, 22), (60, 2, 21)]


@pytest.mark.parametrize("kind", ["clustered", "random"])
def test_neighbours_over_many_blocks(spark, monkeypatch, kind):
    """Recall over many blocks, and the share of blocks that queries visit."""
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((6_000, 24))
    if kind == "clustered":
        vectors = 3 * rng.standard_normal((40, 24))[rng.integers(0, 40, 6_000)] + 0.3 * vectors
        vectors /= np.sqrt((vectors**2).sum(axis=1))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    visits, plain = [], ann.stored

    def stored(df, name):
        out = plain(df, name)
        visits.extend([out] if name == "ann-visits" else [])
        return out

    monkeypatch.setattr(ann, "stored", stored)
    rows = ann.nearest(df, F.col("vec_id") % 20 == 0, block_rows=100).collect()
    scores = vectors[::20] @ vectors.T
    scores[np.arange(300), np.arange(0, 6_000, 20)] = -np.inf
    best = {20 * q: set(np.argsort(-row)[:20].tolist()) for q, row in enumerate(scores)}
    hits = sum(r.vec_id in best[r.query_id] for r in rows)
    assert len(rows) == 6_000 and hits / 6_000 >= 0.95
    share = sum(v.count() for v in visits) / (300 * 64)
    print(kind, "recall", hits / 6_000, "visits per query, as a share of 64 blocks", share)
    assert kind == "random" or share <= 0.35


def test_upper_levels_deal_evenly():
    points = np.random.default_rng(9).standard_normal((4_096, 8))
    sides, places = ann.upper_levels(points, 64)
    cells = ann.cell_of(points, sides, places)
    assert np.bincount(cells, minlength=64).tolist() == [64] * 64
    same = ann.upper_levels(np.ones((50, 8)), 8)
    assert len(set(ann.cell_of(np.ones((50, 8)), *same).tolist())) == 1
    assert ann.cell_of(points, *ann.upper_levels(points[:0], 1)).max() == 0


@functools.cache
def plain_tokenizer() -> Tokenizer:
    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def plain_tokens(text):
    return plain_tokenizer().encode(text or "", add_special_tokens=False).ids


TOKEN_PARTS = [
    "a", "the", "Word", " ", "  ", "\n", "\n\n", "\t", "don't", "'s", "é", "\u00a0", "\u3000", "12", "!!", "<|endoftext|>", "\x1c",
    "\u200b", "x\ny", ",", ".", "end.", "中文", "😀", "_", "\x00", "\r\n", "e\u0301",
]


def token_texts() -> list[str | None]:
    rng = random.Random(1)
    texts = ["".join(rng.choice(TOKEN_PARTS) for _ in range(rng.randrange(30))) for _ in range(3_000)]
    return [*texts, None, "", " ", "a ", " a", "a b", "a  b", "a \nb", "\nb", "a\n", "a\n\nb", "a\n\n\nb", "x" * 50_000]


@pytest.mark.parametrize("most", [400_000, 3])
@pytest.mark.parametrize("special_as_text", [False, True])
@pytest.mark.parametrize("blank", [False, True])
def test_pieces_give_the_ids_of_whole_texts(most, special_as_text, blank):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = special_as_text
    encoder, texts = Encoder(path, special_as_text, most_pieces=most), token_texts()
    assert encoder.by_pieces
    for start in range(0, len(texts), 70):
        some = texts[start : start + 70]
        for text, ids in zip(some, encoder.encode(some, blank), strict=True):
            assert ids.tolist() == plain.encode(" " * blank + (text or ""), add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("most", [400_000, 3])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("special_as_text", [False, True])
def test_columns_give_the_ids_of_whole_texts(most, name, special_as_text):
    path = str(public_tokenizers.path(name))
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = special_as_text
    encoder, texts = Encoder(path, special_as_text, most_pieces=most), token_texts()
    texts = texts if name.startswith("byte") else texts[-400:]
    for start in range(0, len(texts), 70):
        some = texts[start : start + 70]
        for text, ids in zip(some, encoder.encode_column(pa.array(["", *some])[1:]), strict=True):
            assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)
    assert encoder.encode_column(pa.array([], pa.string())) == []
    assert [x.tolist() for x in encoder.encode_column(pa.array([None, ""], pa.string()))] == [[], []]


def test_recurring_words_and_signs_reach_the_library_once(monkeypatch):
    """Words in many texts, each with many runs of signs behind it: only the words and the runs are new."""
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    words = [f"{a}{b}" for a in ("Wort", "mél", "zq", "the") for b in ("", "x", "yé", "tion")]
    runs = ["", *",.;!'", "!!", "***", "%&%", "'.", "-" * 8, "-" * 9]
    lines = [[f"{w}{r}" for w in words] for r in runs]
    texts = [f"0 {' '.join(line)}\n{' '.join(reversed(line))}" for line in lines for _ in range(3)]
    given, encoder = [], Encoder(path)
    plain_words, plain_whole = encoder._of_words, encoder._whole
    monkeypatch.setattr(encoder, "_of_words", lambda some, before: given.extend(some) or plain_words(some, before))
    monkeypatch.setattr(encoder, "_whole", lambda some: given.extend(some) or plain_whole(some))
    found = [encoder.encode_column(pa.array(some)) for some in (texts[:20], texts[20:])]
    assert [ids.tolist() for some in found for ids in some] == [plain_tokens(t) for t in texts]
    given = [g for g in given if g != "0"]  # first pieces are encoded by themselves
    long, lines_begun = len(words) + 1, 1  # the run of nine signs stays with its words
    assert len(given) <= len(words) + len(runs) + long + lines_begun


def test_rows_are_encoded_in_runs_of_bounded_size(monkeypatch):
    monkeypatch.setattr(records, "_AT_ONCE", 3)
    monkeypatch.setattr(records, "_BYTES_AT_ONCE", 10)
    texts = [None, "", "a", "b", "éééé", "ccc", "d" * 50, "e", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    found = [some.column(1).to_pylist() for some in records._cut(batch)]
    assert found == [[None, "", "a"], ["b", "éééé"], ["ccc"], ["d" * 50], ["e", None]]
    assert list(records._cut(batch.slice(0, 0))) == []


def test_special_tokens_in_a_text_are_the_librarys():
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    assert 50256 in Encoder(path).encode(["one<|endoftext|>two"])[0]
    assert 50256 not in Encoder(path, special_as_text=True).encode(["one<|endoftext|>two"])[0]


def test_other_tokenizers_encode_whole_texts():
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    plain, encoder = Tokenizer.from_file(path), Encoder(path)
    assert not encoder.by_pieces
    texts = token_texts()[-400:]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_records_of_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    start = 0
    expected = []
    for r in table(spark, sf, "documents").orderBy("doc_id").collect():
        ids = np.array([*plain_tokens(r.text), 2], "<u4")
        expected.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, registered.op5_records(spark, sf).collect())) == expected


def test_records_of_odd_documents(spark, tmp_path):
    path, index = str(tmp_path / "records"), str(tmp_path / "index")
    records.write_records(cases.odd(spark), path, shard_bytes=5_000, partitions=3)
    records.write_index(spark, path, index)
    rows = records.read_records(spark, path, index, shuffle_seed=3).collect()
    ids = lambda r: np.frombuffer(r.ids, "<u4").tolist()
    plain = sorted(((i, [*plain_tokens(t), 2]) for i, t, _ in cases.ODD_ROWS), key=str)
    assert sorted(((r.doc_id, ids(r)) for r in rows), key=str) == plain
    placed = sorted(rows, key=lambda r: (r.shard, r.record))
    assert [r.doc_id for r in placed] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i))
    start = 0
    for r in placed:
        assert r.start == start
        start += len(r.ids) // 4
    assert len({r.shard for r in rows}) > 3
    in_file = [r.record for r in rows if r.shard == placed[-1].shard]
    assert in_file == list(range(len(in_file))) or len(in_file) > 1


def test_records_of_nothing(spark, tmp_path):
    path, index = str(tmp_path / "records"), str(tmp_path / "index")
    records.write_records(cases.empty(spark), path)
    records.write_index(spark, path, index)
    assert records.read_records(spark, path, index).count() == 0


def test_damage_is_noticed():
    payload = records.payload_of(5, np.arange(10, dtype="<u2"))
    whole = records.frame(payload) + records.MARK
    assert bytes(records.unframe(memoryview(whole), 0)[0]) == payload
    for at in range(len(whole)):
        broken = bytearray(whole)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(memoryview(bytes(broken)), 0)
    with pytest.raises(ValueError):
        records.unframe(memoryview(whole[:-1]), 0)


def personal_texts() -> list[str]:
    rng = random.Random(9)
    parts = [
        "a@b.c", "x.y@z-1.example.com", "@", ".", "_", "+", " ", "-", "1.2.3.4", "256.1.1.1", "01.002.3.255", "1.2.3.4.5",
        "4111111111111111", "4111 1111-1111 1111", "4111  1111", "5500005555555559", "1", "23", "+1 (476) 555-1234", "+49", "(030)",
        "éü😀", "the", "\n", "0" * 25, "+12345678", "mail", "foo@bar", "%",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(800)]
    return [*texts, "9" * 50_000, "a" * 50_000 + "@", "1 " * 20_000, "+" + "1-" * 20_000, "1.2.3.4 " * 3_000]


def test_base_spans_as_by_plain_matching(spark):
    rows = list(enumerate(personal_texts()))
    found = pii.personal_data(cases.documents(spark, rows)).collect()
    assert len(found) == len(rows)
    expected = {i: cases.plain_spans(t) for i, t in rows}
    for r in found:
        assert r.base_spans == ",".join(expected[r.doc_id]), rows[r.doc_id]
        for kind in pii.KINDS:
            assert r[f"n_{kind}"] == sum(s.startswith(kind + ":") for s in expected[r.doc_id])
        assert set(expected[r.doc_id]) <= set(filter(None, r.spans.split(",")))


UNSEEN = [
    "reach me at phone 415 555 2222 or later",  # three groups of digits with blanks
    "reach me at phone (030) 901 820, or later",
    "reach me at phone 4711 or later",  # a short number
    "reach me at phone 4155552222 or later",
    "please write to client77[at]mail.example.com about it",
    "please write to anna(at)site.org about it",
    "please write to " + "x" * 300 + "_at_home about it",
]
FOUND = ["phone:18:30", "phone:18:31", "phone:18:22", "phone:18:28", "email:16:44", "email:16:32", "email:16:324"]


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"please write to client{i}@mail.example.com about it") for i in range(12)]
    rows += [(50 + i, f"reach me at phone +1 415 555 {2000 + i} or later") for i in range(12)]
    rows += [(100 + i, text) for i, text in enumerate(UNSEEN)]
    rows += [(200 + i, f"the number {10_000_000 + i} of it was long, as is {i}") for i in range(12)]
    found = {r.doc_id: r for r in pii.personal_data(cases.documents(spark, rows)).collect()}
    assert [found[100 + i].spans for i in range(len(UNSEEN))] == FOUND
    assert all(found[100 + i].n_found == 1 for i in range(len(UNSEEN)))
    assert all(found[200 + i].spans == "" for i in range(12))
    assert all(found[i].n_email == 1 and found[i].spans == found[i].base_spans for i in range(12))


def test_added_spans_as_by_a_plain_graph(spark):
    rng = random.Random(12)
    slots = {"email": ["write to {}", "mail {} now", "from <b> {} today"], "phone": ["call {} soon", "phone: {}", "tel\n{} or"]}
    words = ["the", "a", "of", "call", "to", "mail", "12", "7.5", "x_1", "write"]
    rows = []
    for i in range(400):
        kind = rng.choice(list(slots))
        known = rng.random() < 0.6
        number = rng.randrange(60)
        value = {
            "email": f"c{number}@m.example.com" if known else rng.choice([f"c{number}[at]m.com", f"{number}"]),
            "phone": f"+1 415 555 {2000 + number}" if known else rng.choice([f"415 555 {number}", f"{number}00"]),
        }[kind]
        text = " ".join([*rng.choices(words, k=3), rng.choice(slots[kind]).format(value), *rng.choices(words, k=2)])
        rows.append((i, text))
    found = pii.personal_data(cases.documents(spark, rows)).collect()
    expected = cases.plain_personal_data(rows)
    assert {r.doc_id: r.spans for r in found} == expected
    assert sum(r.n_found for r in found) > 20


def test_no_span_is_added_without_contexts(spark):
    """On the given texts identifiers stand among random words: nothing is added, so nothing wrongly."""
    found = pii.personal_data(table(spark, SF, "documents").select("doc_id", "text"))
    assert found.agg(F.sum("n_found")).first()[0] <= 2


def test_personal_data_of_odd_documents(spark):
    rows = pii.personal_data(cases.odd(spark)).collect()
    assert len(rows) == len(cases.ODD_ROWS)
    assert all(r.spans == "" for r in rows)
    assert pii.personal_data(cases.empty(spark)).count() == 0


def test_personal_data_is_native(spark):
    df = pii.personal_data(cases.odd(spark))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline_stage_by_stage(spark):
    """Each stage against a plain version of its decision, on what the stage before kept."""
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "near dedup", "decontamination", "mixing", "sharding"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, sf)
        rows = out.collect()
        kept[name] = len(rows)
        if name == "near dedup":
            group = cases.plain_components(before, 5, (80, 100))
            assert sorted(r.doc_id for r in rows) == sorted(set(group.values()))
        if name == "decontamination":
            items = [cases.shingles(r.text, 5) for r in table(spark, sf, "benchmark").collect()]
            clean = [i for i, t in before if not any(100 * len(s & cases.shingles(t, 5)) >= 80 * len(s) for s in items)]
            assert sorted(r.doc_id for r in rows) == sorted(clean)
        if name != "sharding":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(rows, out.schema)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))


def test_pipeline_of_odd_documents(spark):
    labels_dir = "/root/testdata/sf0.001"
    for docs in (cases.odd(spark), cases.empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, labels_dir)
        docs.count()
