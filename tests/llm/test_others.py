import random

import numpy as np
import pytest

from tianguis.llm import chat, embedding_dedup, registry

T = chat.Template()
PIECES = ["user", "assistant", "#", "##", "###", "### ", ":", ": ", "\\", " ", "</turn>", " </turn>\n", "\n", "é", "<"]


def test_texts_come_back_whatever_they_hold():
    r = random.Random(3)
    for _ in range(4000):
        turns = [("".join(r.choice(PIECES) for _ in range(r.randrange(4))), "".join(r.choice(PIECES) for _ in range(r.randrange(9)))) for _ in range(r.randrange(4))]
        pieces = T.segments(turns)
        assert T.read("".join(p for p, _ in pieces)) == turns
        assert "".join(T.unescape(p) for p, loss in pieces if loss) == "".join(t for role, t in turns if role == "assistant")


def test_order_of_turns():
    for roles, want in {("user", "assistant"): (True, 2), ("system", "user", "assistant", "tool", "assistant"): (True, 5), ("assistant",): (False, 0), ("user", "user"): (False, 1), ("user",): (False, 1), (): (False, 0)}.items():
        assert T.check(list(roles)) == want
    with pytest.raises(ValueError):
        T.read("no turn")


def test_conversations_with_awkward_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "b"), (1, None, "system", "s"), (2, 0, None, "x"), (None, 0, "user", "q"), (None, 1, "assistant", "a"), (3, 0, "user", "x" * 50_000), (3, 1, "assistant", "y"), (3, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert {k: (r.n_turns, r.loss_chars, r.valid) for k, r in got.items()} == {1: (3, 1, True), 2: (1, 0, False), None: (2, 1, True), 3: (3, 2, False)}
    assert chat.format_conversations(df.where("false")).count() == 0


def test_near_vectors_equal_brute_force(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 16))
    x = [centres[i % 40] + r.normal(size=16) * [0.05, 0.12, 0.3][i % 3] for i in range(600)]
    x = [v.astype(np.float32) for v in x] + [centres[0].astype(np.float32)] * 5
    rows = [(i, [float(c) for c in v], i % 2) for i, v in enumerate(x)]
    rows += [(700, None, 0), (701, [0.0] * 16, 0), (702, [float("nan")] * 16, 0), (703, [None] * 16, 0), (704, [float(c) for c in x[0]], None), (705, [1.0, 2.0], 0), (706, [1.0, 2.0], 0), (707, [-0.0, 1.0], 1), (708, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {v.vec_id: v for v in embedding_dedup.near_vectors(df).collect()}
    unit = np.array([v / np.linalg.norm(v) for v in np.array(x, dtype=np.float64)])
    near = (unit @ unit.T >= 0.93) & (np.add.outer(np.arange(len(x)), np.arange(len(x))) % 2 == 0)
    true, found = near.sum() - len(x), sum(got[i].n_links for i in range(len(x)))
    assert true > 300 and 0.97 * true <= found <= true and all(got[i].n_links <= near[i].sum() - 1 for i in range(len(x)))
    for i in (700, 701, 702, 703, 704):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[706].n_links, got[706].component_id, got[708].component_id) == (1, 705, 707)
    assert embedding_dedup.near_vectors(df.where("false")).count() == 0


def test_each_length_of_vectors_is_searched(spark):
    r = np.random.default_rng(5)
    rows, want = [], {}
    for dim in (1, 2, 3, 8):
        x = np.repeat(r.normal(size=(6, dim)), 4, axis=0) * (1 + r.normal(size=(24, dim)) * 0.01)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        for i, n in enumerate((unit @ unit.T >= 0.93).sum(axis=1) - 1):
            rows.append((100 * dim + i, x[i].tolist(), "a"))
            want[100 * dim + i] = n
    rows += [(-1, [1.0, 2.0], "b"), (-1, [1.0, 2.001], "b"), (None, [1.0, 2.0], "b")]
    got = [(v.vec_id, v.n_links, v.component_id) for v in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(3)).collect()]
    assert {i: n for i, n, _ in got if i and i > 0} == want and [x for x in got if x[0] is None or x[0] < 0].count((-1, 1, -1)) == 2 and (None, 0, None) in got


def test_small_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "MEMBERS", 7)
    monkeypatch.setattr(embedding_dedup, "PROBES", 5)
    r = np.random.default_rng(2)
    x = np.repeat(r.normal(size=(10, 8)), 12, axis=0) + r.normal(size=(120, 8)) * 0.05
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {v.vec_id: v.n_links for v in embedding_dedup.near_vectors(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == dict(enumerate(((unit @ unit.T >= 0.93).sum(axis=1) - 1).tolist()))


def test_every_operator_has_a_query():
    names = registry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n != "pipeline"} == set(range(1, 11)) and "pipeline" in names


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline as p

    def prose(seed, n=90):
        r = random.Random(seed)
        return " ".join(r.choice("lo mi ker tan ba sel vo xu de fin".split()) + r.choice("ra ti zem no ".split(" ")) for _ in range(n))

    texts = [prose(k) for k in range(12)] + [prose(3), prose(4) + "\nmás", None, "123 456", prose(5) + " cola"]
    rows = [(i, t, "aa", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for k, (name, stage) in enumerate(p.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert set(kept["language_id"]) == set(range(17)) - {14, 15}
    lines = kept["line_dedup"]
    assert 12 not in lines and lines[13].text == "más" and 16 not in lines and all(lines[i].text == texts[i] for i in range(12))
    assert set(kept["minhash_near_dedup"]) == set(lines) == set(kept["mix_sources"]) == set(kept["bpe"])
    assert {r.doc_id: r.n_tokens for r in p.run(spark, str(tmp_path)).collect()} == {i: r.n_tokens for i, r in kept["bpe"].items()}
