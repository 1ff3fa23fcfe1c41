import hashlib
import hmac
import json
import time
from datetime import datetime, timedelta

import pytest
from conftest import NOW, OIL, listing
from pyspark.sql import functions as F

from tianguis.sources import catalog, files, history, pages, payloads, robots


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


RECORDS = [{"title": "Aceite 1 L", "price": "1.500,50", "captured_at": "2026-09-29T10:00:00Z", "extra": 1}, {"product": "Arroz", "captured_at": None}, {"title": "Viejo", "captured_at": "2026-01-01T00:00:00Z", "source_id": "x"}]


def test_files(spark, tmp_path):
    lines = write(tmp_path / "uno.jsonl", "\n".join(map(json.dumps, RECORDS)) + "\n\n")
    whole = write(tmp_path / "dos.json", json.dumps({"observations": RECORDS}))
    listed = write(tmp_path / "tres.json", json.dumps(RECORDS))
    for path, stem in ((lines, "uno"), (whole, "dos"), (listed, "tres")):
        got = {r.title: r for r in files.read_listings(spark, path).collect()}
        assert set(got) == {"Aceite 1 L", "Arroz", "Viejo"} and got["Aceite 1 L"].price == 1500.5
        assert got["Arroz"].source_id == stem and got["Viejo"].source_id == "x" and json.loads(got["Aceite 1 L"].raw)["extra"] == 1
    assert got["Arroz"].observation_id == "tres:1"
    assert {r.title for r in files.read_listings(spark, lines, since=datetime(2026, 9, 1), until=NOW).collect()} == {"Aceite 1 L", "Arroz"}
    assert files.read_listings(spark, str(tmp_path)).count() == 9


def test_broken_files_fail(spark, tmp_path):
    path = write(tmp_path / "x.jsonl", '{"title": "a"}\n{broken\n')
    with pytest.raises(Exception):
        files.read_listings(spark, path).collect()


def test_rate_files(spark, tmp_path):
    path = write(tmp_path / "r.json", json.dumps({"rates": [{"from": "usd", "to": "cup", "rate": "400", "as_of": "2026-09-29T00:00:00Z"}]}))
    r = files.read_rates(spark, path).first()
    assert (r.from_currency, r.to_currency, r.rate, r.source) == ("USD", "CUP", 400.0, "no_especificada")


def test_a_failing_source_is_a_status(spark, observations, targets):
    def broken(spark, since, until):
        raise TimeoutError("timeout")

    good = files.Source("s1", lambda s, a, b: observations([listing(0), listing(1, title="Ventilador")]))
    late = files.Source("late", lambda s, a, b: s.range(1).select(F.raise_error(F.lit("cut off")).alias("title")))
    rows, status = files.fetch_all(spark, [good, files.Source("s2", broken), files.Source("s3", lambda s, a, b: observations([])), late], targets(OIL))
    got = {r.source_id: r for r in status.collect()}
    assert rows.count() == 1 and (got["s1"].status, got["s1"].discarded_by_prefilter) == ("ok", 1)
    assert got["s2"].error == "TimeoutError: timeout" and got["s3"].status == "vacia" and got["late"].status == "error"


def test_history(spark, observations, tmp_path):
    path = str(tmp_path / "h")
    captures = observations([listing(0), listing(1, captured_at=None), listing(2, captured_at=NOW - timedelta(days=40))])
    assert history.record_and_read(spark, captures, path, since=NOW - timedelta(days=7)).count() == 1
    history.append_history(observations([listing(0, captured_at=NOW, price=5.0)]), path)
    latest = history.latest(history.read_history(spark, path), ["observation_id"], "captured_at", "row_uid").where("row_uid = 0").first()
    assert latest.price == 5.0


def test_fetch_plan(spark):
    listed = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",)], "url string")
    known = spark.createDataFrame([("a", NOW - timedelta(hours=1)), ("b", NOW - timedelta(hours=24)), ("d", NOW - timedelta(days=9)), ("z", NOW)], "url string, last_ts timestamp")
    got = {r.url: r.action for r in catalog.fetch_plan(listed, known, "url", NOW, max_fetches=2).collect()}
    assert got == {"a": "fresh", "c": "fetch", "d": "fetch", "b": "waiting", "z": "removed"}


ROBOTS = """User-agent: *
Allow: /
Disallow: /search
Disallow: /*.pdf$
Allow: /search/help

User-agent: other
Disallow: /
"""


def test_robots(spark):
    rules = robots.parse_robots(ROBOTS, "mybot")
    urls = {"https://a.b/x": True, "https://a.b/search?q=1": False, "https://a.b/search/help": True, "https://a.b/f.pdf": False, "https://a.b/f.pdf?x": True, "https://a.b": True}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.ok for r in df.select("u", robots.can_fetch(F.col("u"), rules).alias("ok")).collect()} == urls
    assert robots.parse_robots(ROBOTS, "The-Other/1") == [(False, "/")]
    assert df.select(robots.can_fetch(F.col("u"), []).alias("ok")).distinct().first().ok is True
    assert spark.createDataFrame([("Just a moment...",), ("ok",)], "p string").where(robots.is_challenge(F.col("p"))).count() == 1


def payload(spark, value, **more):
    return spark.createDataFrame([(json.dumps(value), NOW, "La Habana", "Plaza", "Precio USD")], "payload string, captured_at timestamp, province string, municipality string, page_text string")


def test_marketplace(spark):
    value = {"list": [{"id": 1, "name": "Bodega", "slug": "b", "currency": "USD", "offers": [{"offerId": 7, "offerName": "Aceite 1 L", "price": 4.5}, {"offerId": 8, "offerName": ""}]}, {"id": 2, "name": "Vacía", "offers": []}]}
    got = payloads.marketplace(payload(spark, value), "m", site="https://x/").collect()
    assert [(r.listing_id, r.price, r.currency, r.seller, r.url) for r in got] == [("7", 4.5, "USD", "Bodega", "https://x/b")]


def test_shipped_goods(spark):
    variants = [{"id": 11, "price": 105.09, "slug": "s", "qty_available": 0, "shipping": [{"carrier_name": "a", "carrier_price": 27.55}, {"carrier_name": "b", "carrier_price": 30.0}]}, {"id": 12, "shipping": []}]
    value = {"data": {"elements": [{"id": 5, "title": "Split", "price": 100.0, "currency": "USD", "variants": variants}, {"id": 6, "title": "Sin variantes", "price": 9.0, "variants": []}, {"id": 7, "title": "Sin precio"}]}}
    got = {r.listing_id: r for r in payloads.shipped_goods(payload(spark, value), "e", "Envíos").collect()}
    assert set(got) == {"11@la habana", "12@la habana", "6@la habana"}
    assert got["11@la habana"].price == 132.64 and got["11@la habana"].availability == "agotado" and got["12@la habana"].price is None


def test_shop_page(spark):
    value = {"data": {"products": [{"id": 3, "name": "Café", "salePrice": 5.0, "commercialName": "T", "isOutOfStock": True, "tags": [{"name": "x"}]}, {"id": None, "name": "no"}]}}
    r = payloads.shop_page(payload(spark, value), "c").collect()
    assert [(x.listing_id, x.currency, x.availability) for x in r] == [("3@plaza", "USD", "agotado")]


def test_rate_payload(spark):
    value = {"date": "2026-09-29", "hour": 10, "minutes": 22, "seconds": 5, "tasas": {"USD": 400, "ECU": 430.5, "BTC": 1, "MLC": 0, "EUR": "x"}}
    got = {r.from_currency: (r.rate, r.as_of) for r in payloads.rate_payload(payload(spark, value), "CUP", "s").collect()}
    assert got == {"USD": (400.0, datetime(2026, 9, 29, 14, 22, 5)), "EUR": (430.5, datetime(2026, 9, 29, 14, 22, 5))}


def test_sitemap_and_pseudonym(spark):
    df = spark.createDataFrame([("<urlset><url><loc> https://x/a?b=1&amp;c=2 </loc></url><url><loc>https://x/b</loc></url></urlset>",)], "xml string")
    assert sorted(r.url for r in payloads.sitemap(df).collect()) == ["https://x/a?b=1&c=2", "https://x/b"]
    for key in (b"clave", b"k" * 100):
        want = "vendedor-" + hmac.new(key, "53ñ1".encode(), hashlib.sha256).hexdigest()[:12]
        assert spark.range(1).select(payloads.pseudonym(F.lit("53ñ1"), key).alias("p")).first().p == want


def html_of(*scripts):
    return "<html>" + "".join(f"<script{a}>{b}</script>" for a, b in scripts) + "</html>"


def page_table(spark, *rows):
    return spark.createDataFrame([(u, "https://site.cu", NOW, h) for u, h in rows], "url string, base string, captured_at timestamp, html string")


def test_state_pages(spark):
    state = {
        "ROOT_QUERY": {"adsPerPage({})": {"edges": [{"node": {"__ref": "AdType:1"}}, {"node": {"__ref": "AdType:1"}}, {"node": None}]}, "promotedAds": {"edges": [{"node": {"id": 2, "title": "Otro", "price": 3}}]}, "x": 1},
        "AdType:1": {"id": 1, "title": "Aceite 1 L", "price": 900, "currency": "CUP", "permalink": "/a/1", "provinceId": 9, "phoneInfo": {"firstPhone": {"prefix": "53", "number": "555"}}, "mainImage": {"gcsKey": "img"}},
        "ProvinceType:9": {"id": 9, "name": "La Habana"},
    }
    doc = html_of((' id="__NEXT_DATA__" type="application/json"', json.dumps({"props": {"pageProps": {"__APOLLO_STATE__": state}}})))
    got = {r.listing_id: r for r in pages.page_listings(page_table(spark, ("u", doc), ("v", "<html></html>"), ("w", None)), "classifieds", "cl", seller_key=b"k").collect()}
    assert set(got) == {"1", "2"} and got["1"].province == "La Habana" and got["1"].url == "https://site.cu/a/1" and got["1"].image_id == "img"
    assert got["1"].seller == "vendedor-" + hmac.new(b"k", b"53555", hashlib.sha256).hexdigest()[:12] and "555" not in got["1"].raw.replace("vendedor", "")
    assert json.loads(got["2"].raw)["promoted"] is True


def test_generic_pages(spark):
    ads = {"edges": [{"node": {"id": "7", "title": "Arroz 5 lb", "price": {"amount": "350", "currency": "CUP"}, "permalink": "/r", "province": {"name": "Matanzas"}, "user": {"name": "Ana"}, "createdAt": 1790000000000}}, {"node": {"title": "Precio", "price": "Precio"}}]}
    linked = [{"@type": "Thing", "name": "Silla", "price": 20, "sku": "S1"}]
    stream = 'self.__next_f.push([1,"' + json.dumps('1:{"id":"9","title":"Mesa","price":50}')[1:-1] + '"])'
    doc = html_of((' id="__NEXT_DATA__"', json.dumps(ads)), (' type="application/ld+json"', json.dumps(linked)), ("", stream), ("", "var broken = {"))
    got = {r.title: r for r in pages.page_listings(page_table(spark, ("u", doc)), "classifieds", "cl").collect()}
    assert set(got) == {"Arroz 5 lb", "Silla", "Mesa"}
    assert (got["Arroz 5 lb"].price, got["Arroz 5 lb"].currency, got["Arroz 5 lb"].seller, got["Arroz 5 lb"].province) == ("350", "CUP", "Ana", "Matanzas")
    assert got["Arroz 5 lb"].published_at.startswith("2026-09-21")


def in_time(df, seconds=60):
    began = time.monotonic()
    rows = df.collect()
    assert time.monotonic() - began < seconds
    return rows


def test_large_generic_page(spark):
    """A page takes time by its ads and not by their square; of a repeated id the first ad stays, in the page's order."""
    ids = [(7 * i) % 2000 for i in range(2000)]
    ads = [{"id": str(k), "title": f"Silla {k}", "price": k + 1} for k in ids] + [{"id": str(k), "title": "Otra vez", "price": 1} for k in ids[:500]]
    doc = html_of((' id="__NEXT_DATA__"', json.dumps({"ads": ads})))
    got = in_time(pages.page_listings(page_table(spark, ("u", doc)), "classifieds", "g").select("listing_id", "title", "price"))
    assert [(r.listing_id, r.title, r.price) for r in got] == [(str(k), f"Silla {k}", str(k + 1)) for k in ids]


def test_large_state_page(spark):
    """References and places are found by halving: whole, in the page's order, and in time by the page's ads."""
    ids = [(7 * i) % 2000 for i in range(2000)]
    state = {f"AdType:{k}": {"id": k, "title": f"Mesa {k}", "price": k + 1, "provinceId": k % 50, "municipalityId": 99} for k in ids}
    state |= {f"ProvinceType:{k}": {"id": k, "name": f"P{k}"} for k in range(49)}
    edges = [{"node": {"__ref": f"AdType:{k}"}} for k in [*ids, *ids[:500], 5000]]
    state["ROOT_QUERY"] = {"adsPerPage({})": {"edges": edges}, "promotedAds": {"edges": [{"node": {"id": 6000, "title": "Propio", "price": 3, "__ref": "AdType:x"}}, *edges[:3]]}}
    doc = html_of((' id="__NEXT_DATA__" type="application/json"', json.dumps({"props": {"pageProps": {"__APOLLO_STATE__": state}}})))
    got = in_time(pages.page_listings(page_table(spark, ("u", doc)), "classifieds", "cl").select("listing_id", "title", "price", "province", "municipality", F.get_json_object("raw", "$.promoted").alias("promoted")))
    want = [(str(k), f"Mesa {k}", str(k + 1), f"P{k % 50}" if k % 50 < 49 else None, None, "false") for k in ids]
    assert [tuple(r) for r in got] == [*want, ("6000", "Propio", "3", None, None, "true")]


def test_product_pages(spark):
    product = {"@graph": [{"@type": ["Product"], "name": "Aceite", "sku": "K1", "brand": {"name": "Vendido por Tienda Uno"}, "offers": {"@type": "AggregateOffer", "lowPrice": "4.50", "priceCurrency": "USD", "availability": "https://schema.org/InStock", "itemCondition": "https://schema.org/NewCondition"}}]}
    doc = html_of((' type="application/ld+json"', json.dumps(product)))
    r = pages.page_listings(page_table(spark, ("https://site.cu/p/1", doc), ("x", "<p>")), "product", "pr").collect()
    assert len(r) == 1 and (r[0].seller, r[0].brand, r[0].price, r[0].availability, r[0].condition, r[0].listing_id) == ("Tienda Uno", None, "4.50", "disponible", "nuevo", "K1")
    assert r[0].observation_id == "pr:K1:2026-09-30T12:00:00Z"


def test_pages_and_payloads_become_observations(spark):
    from tianguis.schema import as_observations

    doc = html_of((' type="application/ld+json"', json.dumps({"@type": "Product", "name": "Café 250 g", "offers": {"price": 3}})))
    o = as_observations(pages.page_listings(page_table(spark, ("https://site.cu/p/2", doc)), "product", "pr")).first()
    assert (o.title, o.price, o.listing_id, o.captured_at) == ("Café 250 g", 3.0, "2", NOW)


def test_command_line(spark, tmp_path, capsys):
    from tianguis.__main__ import main

    rows = [{"title": "Aceite de girasol Ole 1 L", "price": 1000 + 10 * i, "currency": "CUP", "seller": f"v{i}", "captured_at": "2026-09-29T10:00:00Z"} for i in range(6)]
    path = write(tmp_path / "uno.jsonl", "\n".join(map(json.dumps, rows)))
    main(["analyze", "--targets", json.dumps(OIL), "--source", f"{path}:s1", "--source", str(tmp_path / "missing.json"), "--end", "2026-09-30T12:00:00", "--cost", "800:CUP"], spark)
    got = json.loads(capsys.readouterr().out)
    assert got["by_currency"][0]["n"] == 6 and got["margin"]["status"] == "CALCULADO" and {s["status"] for s in got["sources"]} == {"ok", "error"}
