import pytest
from conftest import COLA, OIL, listing
from pyspark.sql import functions as F

from tianguis.operators.matching import match, pairs, prepare_observations, prepare_targets, relevant, tokens

CASES = [
    (COLA, {"title": "Refresco cola Coca-Cola 330 ml"}, "EXACT", "MISMA"),
    (COLA, {"title": "Refresco cola Coca Cola 1.5 L"}, "MEDIUM", "DIFERENTE"),
    (COLA, {"title": "Refresco cola 330 ml", "brand": "Tukola"}, "NO_MATCH", "DESCONOCIDA"),
    (COLA, {"title": "Refresco cola 330 ml"}, "HIGH", "MISMA"),
    (COLA, {"title": "Refresco cola Coca-Cola"}, "MEDIUM", "DESCONOCIDA"),
    (OIL, {"title": "Aceite de girasol Ole 1 L"}, "EXACT", "MISMA"),
    (OIL, {"title": "Aceite de girasol Ole 1000 ml"}, "EXACT", "MISMA"),
    (OIL, {"title": "Aceite Ole 1 L"}, "LOW", "MISMA"),
    (OIL, {"title": "Aceite de girasol Ole 2 kg"}, "NO_MATCH", "DIFERENTE"),
    ({"name": "arroz"}, {"title": "Arroz 5 lb"}, "HIGH", "NO_ESPECIFICADA"),
    ({"name": "leche polvo entera nestle"}, {"title": "Leche en polvo entera"}, "HIGH", "NO_ESPECIFICADA"),
    ({"name": "leche polvo entera"}, {"title": "Leche en polvo"}, "MEDIUM", "NO_ESPECIFICADA"),
    ({"name": "celular", "exclude_keywords": ["funda"]}, {"title": "Funda de celular"}, "NO_MATCH", "DESCONOCIDA"),
    ({"name": "bicicleta", "condition": "nuevo"}, {"title": "Bicicleta", "condition": "usado"}, "LOW", "NO_ESPECIFICADA"),
]


def test_levels(observations, targets):
    t, o = prepare_targets(targets(*[c[0] for c in CASES])), prepare_observations(observations([listing(i, **{"brand": None, **c[1]}) for i, c in enumerate(CASES)]))
    got = {r.row_uid: r for r in match(pairs(t, o, prefilter=False)).where("target_id = concat('t', row_uid)").collect()}
    for i, (_, given, level, status) in enumerate(CASES):
        assert (got[i].match_level, got[i].presentation_status) == (level, status), given
    assert got[12].match_reasons == ["contiene palabra excluyente 'funda'"]
    assert got[0].match_reasons[:2] == ["marca: confirmada", "cobertura de términos: 100% de 1"]


def test_prefilter_makes_the_relevant_pairs(observations, targets):
    t, o = prepare_targets(targets(OIL, COLA, {"name": "x", "brand": "Ole"})), prepare_observations(observations([listing(0), listing(1, title="Ventilador"), listing(2, title="Refresco 330 ml")]))
    key = lambda df: {(r.target_id, r.row_uid, r.match_level) for r in df.collect()}
    assert key(relevant(match(pairs(t, o)))) == key(relevant(match(pairs(t, o, prefilter=False))))


def test_too_many_targets_need_the_prefilter(observations, targets):
    with pytest.raises(ValueError):
        pairs(prepare_targets(targets(OIL, COLA)), prepare_observations(observations([listing(0)])), prefilter=False, max_targets=1)


def test_tokens(spark):
    got = spark.createDataFrame([("Galletas de chocolate 6x 1.5l 24 x 330ml, tipo-A del Mar", )], "x string").select(tokens(F.col("x")).alias("t")).first().t
    assert got == ["galleta", "chocolate", "mar"]
    assert spark.range(1).select(tokens(F.lit(None).cast("string")).alias("t")).first().t == []


def test_a_small_index_goes_to_the_observations(spark, observations, targets, monkeypatch):
    """Pairs come without a shuffle of observations, each once, and equal those by shuffle."""
    from tianguis.operators import matching

    t = prepare_targets(targets(OIL, COLA, {**OIL, "brand": None}, {"name": "aceite cola ole", "quantity": None, "unit": None}))
    o = prepare_observations(observations([listing(0), listing(1, title="Refresco cola Coca-Cola cola 330 ml", brand="Ole"), listing(2, title="Ventilador"), listing(3, title=None), listing(4, title="cola de aceite ole ole")]))
    near = pairs(t, o)
    assert "Exchange hashpartitioning" not in near._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(matching, "INDEXED", -1)
    far = pairs(t, o)
    shown = sorted(far.columns)
    assert sorted(near.columns) == shown and near.count() > 8
    assert sorted(map(str, near.select(*shown).collect())) == sorted(map(str, far.select(*shown).collect()))


def test_repeated_texts_are_worked_out_once(spark, targets, observations, tmp_path, monkeypatch):
    """With few distinct products they are matched by themselves; rows get the same as one by one."""
    from tianguis.operators import matching
    from tianguis.operators.components import Scratch

    given = [{}, {"seller": None, "province": "  la habana"}, {"title": None}, {"brand": "Ole", "quantity": 0.0}, {"quantity": float("nan"), "unit": "ml"}, {"currency": "$"}, {"currency": None, "price": None},
             {"title": "Refresco cola 330 ml", "condition": "Nuevo", "availability": "AGOTADO"}, {"url": "https://www.a.cu/x?b=2&a=1#z"}, {"url": "https://www.a.cu/y/#z?q"}, {"title": "Ventilador"}, {"pack_count": 6}]
    rows = observations([listing(12 * k + i, **g) for k in range(3) for i, g in enumerate(given)])
    rows.write.parquet(str(tmp_path / "rows"))
    rows, wanted, scratch = spark.read.parquet(str(tmp_path / "rows")), prepare_targets(targets(OIL, COLA)), Scratch(spark)
    once, few = matching.matched(wanted, rows, scratch)
    every, _ = matching.matched(wanted, rows, scratch, prefilter=False)
    monkeypatch.setattr(matching, "REPEATED", 0)
    by_row, many = matching.matched(wanted, rows, scratch)
    assert few and not many and set(once.columns) == set(by_row.columns)

    def all_of(df):
        return sorted(repr(r) for r in df.select(*sorted(by_row.columns)).collect())

    assert all_of(once) == all_of(by_row) and every.count() == 2 * rows.count()
    scratch.drop()
