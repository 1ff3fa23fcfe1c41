"""Awkward rows and names for every operator and stage: columns named like what they make or
use, null and repeated ids, null and empty texts, a long text, and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tianguis.llm import bpe, chat, embedding_dedup, exact_dedup, langid, line_dedup, minhash, mixing, pii, toxicity

NAMES = (
    "kept component_id n_shingles _gone gone _kept _id _key _some id key row own own_key own_source some new same marks place line line_no text_key class_id mix_slot mix_source mix_position _source _rank _named "
    "nth lang_pred score rejected n_links spans n_email tokens ids n_tokens decoded grade severity toxic keep_id group_size n a b x y m part pivot task tasks _row _text valid formatted"
).split()


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice("lo mi ker tan ba sel vo xu de fin".split()) + r.choice("ra ti zem no".split()) for _ in range(n))


TEXTS = [prose(1), prose(2), prose(3), prose(1), None, "", " ", "x" * 200_000, prose(4, 20_000), "a@b.co 1.2.3.4"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 1 else None, t, "aa", f"s{i % 2}" if i else None) for i, t in enumerate(TEXTS)] + [(2, prose(9), "aa", "s0"), (2, prose(9), "aa", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(NAMES)]).repartition(3)


def same(f):
    return lambda spark, df: f(spark, df, "")


MODELS = {}


def model(spark, kind):
    if kind not in MODELS:
        plain = spark.createDataFrame([(i, prose(i) + (" grunkel" if i % 3 == 0 else ""), "aa", int(i % 3 == 0)) for i in range(60)], "doc_id long, text string, lang string, toxic int")
        MODELS[kind] = langid.train(plain) if kind == "lang" else toxicity.train(plain.select("doc_id", "text"), plain.select("doc_id", "toxic"))
    return MODELS[kind]


OPERATORS = {
    "pii": lambda spark, df: pii.find_pii(df),
    "mix": lambda spark, df: mixing.mix_sources(df),
    "bpe": lambda spark, df: bpe.bpe_encode(df, bpe.default_vocabulary()),
    "minhash": lambda spark, df: minhash.near_duplicates(df),
    "toxicity": lambda spark, df: toxicity.grade_toxicity(df, model(spark, "toxic")),
    "language": lambda spark, df: langid.identify(df, model(spark, "lang")),
    "exact": lambda spark, df: exact_dedup.exact_duplicates(df),
}
STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_give_a_row_for_each_row(spark, docs, name):
    out = OPERATORS[name](spark, docs)
    assert out.count() == len(TEXTS) + 2 and len(set(out.columns)) == len(out.columns)
    assert OPERATORS[name](spark, docs.where("false")).count() == 0


@pytest.mark.parametrize("name", [n for n in STAGES if n != "bpe"])
def test_stages_keep_columns_and_clean_rows(spark, docs, name):
    out = STAGES[name](spark, docs, "")
    assert out.columns == docs.columns
    got = [r.text for r in out.select("text").collect()]
    assert {prose(2), prose(3)} <= set(got) and len(got) <= len(TEXTS) + 2
    first = out.select(*[F.col(f"`{c}`") for c in NAMES]).distinct().collect()
    assert [tuple(r) for r in first] == [tuple(range(len(NAMES)))]
    assert STAGES[name](spark, docs.where("false"), "").count() == 0


def test_lines(spark, docs):
    got = line_dedup.line_classes(docs).collect()
    assert len(got) == len(TEXTS) + 2 - 3 and sum(not r.kept for r in got) == 1  # prose(1) comes again; the rows of id 2 that are equal share their fate


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (2, None, 0), (3, [0.0, 0.0], 0), (4, [1.0, 0.01], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", *[F.lit(k).alias(c) for k, c in enumerate(NAMES) if c not in ("label",)])
    got = sorted((r.vec_id or 0, r.n_links, r.kept) for r in embedding_dedup.near_vectors(df).collect())
    assert got == [(0, 0, True), (1, 2, True), (1, 2, True), (2, 0, True), (3, 0, True), (4, 2, False)]


def test_conversations(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (None, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit(k).alias(c) for k, c in enumerate(NAMES)])
    assert chat.read_back(chat.format_conversations(df)).count() == 2
