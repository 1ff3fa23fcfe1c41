import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from conftest import NOW, listing
from pyspark.sql import functions as F

from tianguis.config import MarketConfig
from tianguis.operators import dedup, rates, signals, stats, temporal
from tianguis.operators.components import connected_components
from tianguis.operators.matching import prepare_observations


def numbers(spark, groups):
    return spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "g string, price double")


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_price_summary(spark):
    r = stats.price_summary(numbers(spark, {"a": [100, 200, 300, 400]}), ["g"]).first()
    assert (r.price_median, r.price_range, r.price_spread_pct, r.p25, r.p75) == (250, 300, 120.0, 175, 325)
    few = stats.price_summary(numbers(spark, {"a": [5]}), ["g"]).first()
    assert few.n == 1 and few.price_spread_pct is None and few.iqr is None and few.coefficient_of_variation is None


def test_outliers(spark):
    groups = {"far": [1000, 1010, 990, 1005, 995, 9000], "two": [10, 1000], "near": [1080, 1085, 1090, 1085, 900], "flat": [10, 10, 10, 10, 10, 31], "three": [10, 11, 100], "neg": [-5, -5, -4]}
    got = defaultdict(list)
    for r in stats.outliers(numbers(spark, groups), ["g"]).collect():
        got[r.g].append((r.price, r.outlier and r.outlier.direction, r.outlier_method))
    assert [x for x in got["far"] if x[1]] == [(9000.0, "ALTO", "mad_zscore")]
    assert {x[1:] for x in got["two"]} == {(None, "no_evaluado_muestra_insuficiente")}
    assert not any(x[1] for x in got["near"])
    assert [x for x in got["flat"] if x[1]] == [(31.0, "ALTO", "iqr")]
    assert [x for x in got["three"] if x[1]] == [(100.0, "ALTO", "ratio_mediana")]
    assert {x[2] for x in got["neg"]} == {"no_evaluado_mediana_no_positiva"}


def test_scaling_prices_scales_what_is_reported(spark):
    values = [random.Random(3).uniform(1, 100) for _ in range(40)]
    a, b = (stats.price_summary(numbers(spark, {"a": v}), ["g"]).first() for v in (values, [8 * x for x in values]))
    assert b.price_median == 8 * a.price_median and b.coefficient_of_variation == pytest.approx(a.coefficient_of_variation)


def test_concentration(spark):
    rows = spark.createDataFrame([(1, s) for s in ["a", "a", "a", "b", None]] + [(2, "a"), (2, None)], "g int, seller_norm string")
    got = {r.g: r for r in stats.concentration(rows, ["g"]).collect()}
    assert (got[1].top_seller_share_pct, got[1].level, got[1].listings_without_seller, got[1].hhi) == (75.0, "ALTA", 1, 6250.0)
    assert got[2].hhi is None and got[2].listings_without_seller == 1


SERIES = [
    ([100], "INSUFICIENTE", None), ([100, 120], "CAMBIO_PUNTUAL", "ALZA"), ([100, 103], "ESTABLE", "ESTABLE"), ([100, 110, 120, 130], "TENDENCIA", "ALZA"),
    ([100, 101, 99, 125], "MOVIMIENTO_RECIENTE", "ALZA"), ([0, 0, 5], "APARICION", "ALZA"), ([5, 4, 0], "DESAPARICION", "BAJA"), ([130, 120, 110, 100], "TENDENCIA", "BAJA"),
    ([100, None, 120, None], "CAMBIO_PUNTUAL", "ALZA"), ([], "INSUFICIENTE", None), ([0, 0], "INSUFICIENTE", None), ([100, 150, 95, 96], "SIN_PATRON_CLARO", "ESTABLE"),
]


def test_classify(spark):
    df = spark.createDataFrame([(i, [None if v is None else float(v) for v in s]) for i, (s, _, _) in enumerate(SERIES)], "i int, s array<double>")
    got = df.select("i", temporal.classify(F.col("s"), 10).alias("c")).orderBy("i").collect()
    assert [(r.c.classification, r.c.direction) for r in got] == [(k, d) for _, k, d in SERIES]
    assert got[7].c.change_pct_total == pytest.approx(-23.0769, abs=1e-3)


def direct(values, threshold, least=3):
    """The decision list, read off plainly."""
    p = [v for v in values if v is not None]
    pct = lambda new, old: None if old == 0 else (new - old) / old * 100
    way = lambda c: "ESTABLE" if abs(c) < threshold else "ALZA" if c > 0 else "BAJA"
    if len(p) < 2:
        return "INSUFICIENTE", None
    if p[0] == 0 and p[-1] > 0:
        return "APARICION", "ALZA"
    if p[-1] == 0 and p[-2] > 0:
        return "DESAPARICION", "BAJA"
    total, last = pct(p[-1], p[0]), pct(p[-1], p[-2])
    if total is None or last is None:
        return "INSUFICIENTE", None
    if len(p) == 2:
        return ("ESTABLE" if way(total) == "ESTABLE" else "CAMBIO_PUNTUAL"), way(total)
    sign = (total > 0) - (total < 0)
    share = sum((b > a and sign > 0) or (b < a and sign < 0) for a, b in zip(p, p[1:])) / (len(p) - 1)
    early = pct(p[-2], p[0])
    if abs(total) >= threshold and share >= 2 / 3 and early is not None and early * sign >= threshold / 2 and len(p) >= least:
        return "TENDENCIA", way(total)
    if abs(last) >= threshold:
        return "MOVIMIENTO_RECIENTE", way(last)
    if abs(total) < threshold and all(abs(pct(b, a)) < threshold for a, b in zip(p, p[1:]) if a):
        return "ESTABLE", "ESTABLE"
    return "SIN_PATRON_CLARO", way(total)


def test_classify_against_the_plain_list(spark):
    rng = random.Random(5)
    series = [[rng.choice([None, 0.0, 100.0, float(rng.randrange(80, 140))]) for _ in range(rng.randrange(0, 7))] for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(series)), "i int, s array<double>")
    for r in df.select("i", temporal.classify(F.col("s"), 10).alias("c")).collect():
        assert (r.c.classification, r.c.direction) == direct(series[r.i], 10), series[r.i]


def test_periods(spark):
    df = spark.createDataFrame([(datetime(2026, 9, 30, 12),)], "t timestamp")
    for g, begin, end in (("day", "2026-09-30", "2026-10-01"), ("week", "2026-09-28", "2026-10-05"), ("month", "2026-09-01", "2026-10-01")):
        start = temporal.period_start(F.col("t"), g)
        assert df.select(start.cast("date").cast("string"), temporal.period_end(start, g).cast("date").cast("string")).first()[:] == (begin, end)
    with pytest.raises(ValueError):
        temporal.period_start(F.col("t"), "year")


def test_unusual(spark):
    df = spark.createDataFrame([(1, [10.0, 11.0, 9.0, 10.0, 12.0, 50.0]), (2, [10.0, 11.0, 9.0, 10.0, 12.0, 11.0]), (3, [10.0, 10.0, 10.0, 10.0, 10.0, 99.0]), (4, [1.0, 9.0])], "i int, s array<double>")
    got = {r.i: r.u for r in df.select("i", temporal.unusual(F.col("s")).alias("u")).collect()}
    assert got[1].last == 50 and got[1].median == 10 and got[2] is None and got[3] is None and got[4] is None


def dedup_rows(observations, rows):
    df = prepare_observations(observations(rows)).withColumn("scope", F.lit("w"))
    return {r.row_uid: r for r in dedup.deduplicate(df, ["scope"]).collect()}, df


def test_dedup_by_url_and_replica(observations):
    got, _ = dedup_rows(observations, [
        listing(0, url="https://www.site.cu/anuncio/1?utm_source=x", seller="a"), listing(1, url="http://site.cu/anuncio/1", seller="b"),
        listing(2, seller="Tienda X", title="Aceite"), listing(3, seller="TIENDA x", title="ACEITE", source_id="s2"), listing(4, seller="c", listing_id="9"), listing(5, seller="d", listing_id="9", source_id="s2"),
    ])
    assert [got[i].is_canonical for i in range(6)] == [True, False, True, False, True, True]
    assert got[1].duplicate_reasons == ["misma URL"] and got[1].canonical_id == "s1:0"


def test_dedup_keeps_the_latest_and_chains(observations):
    got, _ = dedup_rows(observations, [
        listing(0, listing_id="1", seller="a", image_id="p"), listing(1, listing_id="1", seller="b", captured_at=NOW), listing(2, seller="a", image_id="p", title="otro", price=5.0), listing(3, seller="b", title="Aceite de girasol Ole 1 L"),
    ])
    assert [got[i].is_canonical for i in range(4)] == [False, True, False, False]
    assert {got[i].canonical_uid for i in range(4)} == {1}


def test_dedup_against_union_find(observations):
    rng = random.Random(2)
    rows = [listing(i, url=f"u{rng.randrange(60)}" if rng.random() < 0.4 else None, listing_id=str(rng.randrange(80)) if rng.random() < 0.4 else None, seller=f"v{rng.randrange(30)}", price=float(rng.randrange(3)), image_id=str(rng.randrange(30)) if rng.random() < 0.2 else None) for i in range(300)]
    parent = list(range(300))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    first = {}
    for i, r in enumerate(rows):
        keys = [("u", r["url"])] * bool(r["url"]) + [("l", r["listing_id"])] * bool(r["listing_id"]) + [("i", r["image_id"], r["seller"])] * bool(r["image_id"]) + [("s", r["seller"], r["price"])]
        for k in keys:
            a, b = find(i), find(first.setdefault(k, i))
            parent[max(a, b)] = min(a, b)
    got, _ = dedup_rows(observations, rows)
    assert {i: got[i].canonical_uid for i in got} == {i: find(i) for i in range(300)}


def test_weak_duplicates_are_marked(observations):
    _, df = dedup_rows(observations, [listing(0, seller="A"), listing(1, seller="B"), listing(2, price=None), listing(3, price=None)])
    got = dedup.weak_duplicates(df, ["scope"]).collect()
    assert len(got) == 1 and got[0].ids == ["s1:0", "s1:1"]


def rate_table(spark, *rows):
    return spark.createDataFrame([(a, b, float(r), NOW - timedelta(days=d), "x") for a, b, r, d in rows], "from_currency string, to_currency string, rate double, as_of timestamp, source string")


def test_rates(spark):
    t = rate_table(spark, ("usd", "CUP", 380, 3), ("USD", "CUP", 400, 1), ("CUP", "EUR", 0.002, 2), ("CUP", "USD", 0.1, 0))
    got = {r.currency: r.factor for r in rates.picked_rates(t, "cup").collect()}
    assert got == {"USD": 400.0, "EUR": 500.0}
    assert [r.rate for r in rates.lookup(t, "cup", "usd").collect()] == [0.1, 400.0, 380.0]
    rows = spark.createDataFrame([(1, NOW - timedelta(days=2), "USD"), (2, NOW, "USD"), (3, NOW - timedelta(days=9), "USD"), (4, NOW, "MLC")], "i int, at timestamp, c string")
    assert {r.i: r.rate for r in rates.as_of(rows, t, "at", "c", "CUP", ["i"]).collect()} == {1: 380.0, 2: 400.0, 3: None, 4: None}
    with pytest.raises(Exception, match="positive and dated"):
        rates.valid_rates(rate_table(spark, ("USD", "CUP", 0, 1))).collect()


def test_confidence_only_falls(spark):
    df = spark.createDataFrame([("HIGH", "LOW"), ("LOW", "HIGH"), ("MEDIUM", None), ("MEDIUM", "HIGH")], "a string, b string")
    assert [r[0] for r in df.select(signals.lower_confidence(F.col("a"), F.col("b"))).collect()] == ["LOW", "LOW", "MEDIUM", "MEDIUM"]


def test_breakdown_and_gap(spark):
    rows = [("CUP", p, "s", v) for p, vs in {"A": [10, 12, 14], "B": [20, 20, 20], "C": [1, 1], None: [99, 99, 99]}.items() for v in vs]
    df = spark.createDataFrame([(c, p, s, float(v)) for c, p, s, v in rows], "c string, province string, source_id string, price double")
    b = stats.breakdown(df, ["c"], ["province", "source_id"])
    got = {(r.dimension, r.bucket): (r.n, r.price_median) for r in b.collect()}
    assert got == {("province", "A"): (3, 12.0), ("province", "B"): (3, 20.0), ("province", "C"): (2, 1.0), ("province", "desconocida"): (3, 99.0), ("source_id", "s"): (11, 20.0)}
    g = stats.max_gap(b.where("dimension = 'province'"), ["c"]).first()
    assert (g.low, g.high, round(g.gap_pct, 1)) == ("A", "B", 66.7)


def test_supply_levels():
    assert MarketConfig().availability_low_max == 3


def test_only_replicated_rows_are_told(spark, observations):
    from tianguis.operators.components import Scratch

    rows = [listing(0, url="https://a.cu/1"), listing(1, url="http://www.a.cu/1/"), listing(2, url="https://a.cu/2"), listing(3, url="https://a.cu/1")]
    df, scratch = prepare_observations(observations(rows)).withColumns({"scope": F.lit("w"), "week": F.when(F.col("row_uid") == 3, "w")}), Scratch(spark)
    got = {r.row_uid: r for r in dedup.replicated(df, ["scope", "week"], scratch).collect()}
    whole = {r.row_uid: r for r in dedup.deduplicate(df, ["scope", "week"]).collect()}
    assert set(got) == {0, 1} and got == {k: whole[k] for k in (0, 1)} and [whole[k].is_canonical for k in range(4)] == [True, False, True, True]
    turned = df.withColumns({"scope": F.col("week"), "week": F.when(F.col("row_uid") != 3, "w")})
    assert not dedup.replicated(turned.where("row_uid in (0, 3)"), ["scope", "week"], scratch).count()
    scratch.drop()
