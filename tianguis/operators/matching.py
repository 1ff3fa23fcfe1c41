"""Matching listings with target products, many targets in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tianguis.functions.numbers import percent_label, short_number
from tianguis.functions.text import (
    looks_like_instructions,
    normalize_availability,
    normalize_currency,
    normalize_location,
    normalize_seller,
    normalize_text,
    normalize_url,
)
from tianguis.functions.units import UNITS, build_presentation, known, observation_presentation, same_presentation, unit_price
from tianguis.operators.components import Scratch
from tianguis.schema import MATCH_LEVELS

# Words that say nothing about which product it is.
STOPWORDS = "de del la el los las en con para y o a x × un una por sin al tipo".split()
UNIT_WORDS = [name for name, _, _ in UNITS]
RANK = {name: k for k, name in enumerate(MATCH_LEVELS)}


def stem(t: Column) -> Column:
    n = F.length(t)
    return F.when((n > 4) & t.endswith("es"), F.substring(t, F.lit(1), n - 2)).when((n > 3) & t.endswith("s"), F.substring(t, F.lit(1), n - 1)).otherwise(t)


def tokens(text: Column) -> Column:
    """The stems that identify a product: no stopwords, units, bare numbers or sizes."""
    words = F.split(F.trim(F.translate(normalize_text(text), ",-", "  ")), " +")
    bare = F.transform(words, lambda t: F.regexp_replace(t, r"^[.\-]+|[.\-]+$", ""))
    size = rf"^(?:\d+(?:[.,]\d+)?(?:{'|'.join(UNIT_WORDS)}|x|×)|[x×]\d+)$"
    kept = F.filter(bare, lambda t: (t != "") & ~t.isin(STOPWORDS + UNIT_WORDS) & ~(t.rlike("[0-9]") & ~t.rlike("[a-z]")) & ~t.rlike(size))
    return F.transform(kept, stem)


#: What of an observation decides how it matches, and its columns that are normalised each by itself; a null's normal form is null.
PRODUCT = ["title", "brand", "condition", "quantity", "unit", "pack_count"]
ALONE = {"currency": normalize_currency, "seller": normalize_seller, "province": normalize_location, "availability": normalize_availability}
#: Distinct products, values of a column and pairs of product and target that are worked out once and broadcast, at most.
REPEATED = 100_000


def _products(obs: DataFrame) -> DataFrame:
    return (
        obs.withColumn("title_norm", normalize_text(F.col("title")))
        .withColumn("presentation", observation_presentation(F.col("quantity"), F.col("unit"), F.col("pack_count"), F.col("title")))
        .withColumn("tokens", F.array_union(tokens(F.col("title")), tokens(F.col("brand"))))
        .withColumn("condition_norm", normalize_text(F.col("condition")))
    )


def _by_row(obs: DataFrame) -> DataFrame:
    return (
        obs.withColumn("url_norm", F.nullif(normalize_url(F.col("url")), F.lit("")))
        .withColumn("price_valid", F.coalesce(F.col("price") > 0, F.lit(False)))
        .withColumn("unit_price", unit_price(F.col("price"), F.col("presentation")))
        .withColumn("injected", looks_like_instructions(F.col("title"), F.col("description"), F.col("seller")))
    )


def prepare_observations(obs: DataFrame) -> DataFrame:
    """Every normalised column that later steps read, worked out once a row."""
    return _by_row(_products(obs).withColumns({c + "_norm": norm(F.col(c)) for c, norm in ALONE.items()}))


def matched(targets: DataFrame, obs: DataFrame, scratch: Scratch, prefilter: bool = True) -> tuple[DataFrame, bool]:
    """Prepared targets matched with a table of observations, and whether texts were worked out once for all their rows.

    Captures repeat their products, sellers and places. Where distinct ones are few they are
    normalised and matched once, in ``scratch``, and joined to their rows by broadcast;
    otherwise every row is by itself. The result is the same, without irrelevant pairs if ``prefilter``.
    """

    def judged(prepared):
        out = match(pairs(targets, prepared, prefilter))
        return relevant(out) if prefilter else out

    product = F.xxhash64(*PRODUCT)
    about = obs.agg(F.approx_count_distinct(product).alias("_product"), *[F.approx_count_distinct(c).alias(c) for c in ALONE]).first()
    found = None
    if about["_product"] <= REPEATED:
        each = scratch.keep(obs.select(*PRODUCT).distinct().withColumn("row_uid", F.monotonically_increasing_id()))
        found = scratch.keep(judged(_products(each)).drop("row_uid").withColumn("_product", product))
    if found is None or found.count() > REPEATED:
        return judged(prepare_observations(obs)), False
    out = obs
    for c, norm in ALONE.items():
        if about[c] <= REPEATED:
            known_ = scratch.keep(obs.select(F.col(c).alias("_own")).where(F.col("_own").isNotNull()).distinct().withColumn(c + "_norm", norm(F.col("_own"))))
            out = out.join(F.broadcast(known_), F.col(c) == F.col("_own"), "left").drop("_own")
        else:
            out = out.withColumn(c + "_norm", norm(F.col(c)))
    found = found.withColumnsRenamed({c: "_p_" + c for c in PRODUCT})
    same = product == F.col("_product")
    for c in PRODUCT:
        same = same & F.col(c).eqNullSafe(F.col("_p_" + c))
    return _by_row(out.join(F.broadcast(found), same).drop("_product", *["_p_" + c for c in PRODUCT])), True


def prepare_targets(targets: DataFrame) -> DataFrame:
    """A target's size comes from its fields alone, never from its name."""
    parts = F.concat(F.array("name", "model", "variant"), F.coalesce("keywords", F.array().cast("array<string>")))
    every = F.flatten(F.transform(parts, tokens))
    return (
        targets.withColumn("t_brand_tokens", F.array_distinct(tokens(F.col("brand"))))
        .withColumn("t_tokens", F.array_except(F.array_distinct(every), F.col("t_brand_tokens")))
        .withColumn("t_presentation", build_presentation(F.col("quantity"), F.col("unit"), F.col("pack_count"), F.lit("")))
        .withColumn("t_excluded", F.coalesce("exclude_keywords", F.array().cast("array<string>")))
        .withColumn("t_provinces", F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("provinces", F.array().cast("array<string>")), normalize_location), lambda p: p.isNotNull()))))
        .select("target_id", F.col("name").alias("t_name"), F.col("brand").alias("t_brand"), F.col("model").alias("t_model"), F.col("variant").alias("t_variant"),
                F.col("condition").alias("t_condition"), F.col("keywords").alias("t_keywords"), "t_brand_tokens", "t_tokens", "t_presentation", "t_excluded", "t_provinces")
    )


#: Tokens of targets that are broadcast, at most; beyond that the index is joined by shuffle.
INDEXED = 20_000


def pairs(targets: DataFrame, obs: DataFrame, prefilter: bool = True, max_targets: int = 1000) -> DataFrame:
    """Prepared targets joined with prepared observations.

    With ``prefilter`` through an index of tokens: pairs that share no token of the target's
    name or brand cannot match and are not made. Without it every pair, for at most
    ``max_targets`` targets, which is checked.
    """
    if not prefilter:
        few = targets.limit(max_targets + 1).count()
        if few > max_targets:
            raise ValueError(f"more than {max_targets} targets need the prefilter")
        return obs.join(F.broadcast(targets), F.lit(True))
    named = F.array_union("t_tokens", "t_brand_tokens")
    if targets.select(F.size(named).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] <= INDEXED:
        # a small index goes to the observations, which stay where they are; the first token that both have makes the pair
        index = targets.select("*", named.alias("_named"), F.explode(named).alias("_token"))
        each = obs.select("*", F.explode(F.array_distinct("tokens")).alias("_own"))
        found = each.join(F.broadcast(index), F.col("_own") == F.col("_token"))
        return found.where(F.get(F.array_intersect("tokens", "_named"), F.lit(0)) == F.col("_own")).drop("_own", "_token", "_named")
    wanted = targets.select("target_id", F.explode(named).alias("token"))
    found = obs.select("row_uid", F.explode("tokens").alias("token")).join(wanted, "token").select("target_id", "row_uid").distinct()
    return obs.join(found, "row_uid").join(targets, "target_id")


def _cap(rank: Column, top: str, when: Column) -> Column:
    return F.when(when, F.least(rank, F.lit(RANK[top]))).otherwise(rank)


def match(joined: DataFrame) -> DataFrame:
    """Adds ``match_rank, match_level, token_coverage, presentation_status, match_reasons``."""
    t, o = F.col("t_presentation"), F.col("presentation")
    wanted, have = F.col("t_tokens"), F.col("tokens")
    hit = F.filter("t_excluded", lambda k: (normalize_text(k) != "") & F.contains(F.col("title_norm"), normalize_text(k)))
    excluded = F.get(hit, F.lit(0))
    branded = F.coalesce(F.col("t_brand"), F.lit("")) != ""
    confirmed = branded & (F.size("t_brand_tokens") > 0) & (F.size(F.array_except("t_brand_tokens", have)) == 0)
    conflict = branded & ~confirmed & F.col("brand").isNotNull()
    unverified = branded & ~confirmed & F.col("brand").isNull()
    n, hits = F.size(wanted), F.size(F.array_intersect(wanted, have))
    coverage = F.when(n > 0, hits / n).otherwise(F.when(confirmed, 1.0).otherwise(0.0))
    graded = (
        F.when(coverage >= 1, RANK["EXACT"])
        .when((n <= 2) | (n - hits > 1), F.when(coverage >= 0.25, RANK["LOW"]).otherwise(RANK["NO_MATCH"]))
        .when(coverage >= 0.75, RANK["HIGH"]).otherwise(RANK["MEDIUM"])
    )
    other_condition = (F.coalesce(F.col("t_condition"), F.lit("")) != "") & F.col("condition").isNotNull() & (normalize_text(F.col("t_condition")) != F.col("condition_norm"))
    unsized, same = ~known(t), same_presentation(t, o)
    unknown = ~unsized & same.isNull()
    other_dimension = ~unsized & ~unknown & (o["dimension"] != t["dimension"])
    other_size = ~unsized & ~unknown & ~other_dimension & ~same
    rank = _cap(graded, "HIGH", unverified)
    rank = _cap(rank, "LOW", other_condition)
    rank = _cap(rank, "HIGH", unsized)
    rank = _cap(rank, "MEDIUM", unknown | other_size)
    rank = F.when(other_dimension, RANK["NO_MATCH"]).otherwise(rank)
    stopped = excluded.isNotNull() | conflict
    status = F.when(stopped, "DESCONOCIDA").when(unsized, "NO_ESPECIFICADA").when(unknown, "DESCONOCIDA").when(same, "MISMA").otherwise("DIFERENTE")

    def shown(p):
        return F.concat(short_number(p["standard_quantity"]), F.lit(" "), p["standard_unit"])

    brand_state = F.when(~branded, "no_requerida").when(confirmed, "confirmada").otherwise("no_verificable")
    said = F.array_compact(
        F.array(
            F.concat(F.lit("marca: "), brand_state),
            F.concat(F.lit("cobertura de términos: "), percent_label(coverage), F.lit(" de "), n.cast("string")),
            F.when(other_condition, F.concat(F.lit("estado distinto: '"), F.col("condition"), F.lit("' vs '"), F.col("t_condition"), F.lit("'"))),
            F.when(unsized, "presentación del objetivo no especificada: EXACT no verificable"),
            F.when(unknown, "presentación de la observación desconocida"),
            F.when(other_dimension, F.concat(F.lit("dimensión distinta ("), o["dimension"], F.lit(" vs "), t["dimension"], F.lit(")"))),
            F.when(other_size, F.concat(F.lit("presentación distinta ("), shown(o), F.lit(" vs "), shown(t), F.lit("); solo comparable por unidad estándar"))),
        )
    )
    reasons = (
        F.when(excluded.isNotNull(), F.array(F.concat(F.lit("contiene palabra excluyente '"), excluded, F.lit("'"))))
        .when(conflict, F.array(F.concat(F.lit("marca distinta: '"), F.col("brand"), F.lit("' vs '"), F.col("t_brand"), F.lit("'"))))
        .otherwise(said)
    )
    final = F.when(stopped, RANK["NO_MATCH"]).otherwise(rank)
    return joined.withColumns(
        {
            "match_rank": final,
            "match_level": F.element_at(F.array(*[F.lit(x) for x in MATCH_LEVELS]), final + 1),
            "token_coverage": F.when(stopped, 0.0).otherwise(coverage),
            "presentation_status": status,
            "match_reasons": reasons,
        }
    )


def relevant(matched: DataFrame) -> DataFrame:
    """Without the pairs that have nothing in common; conflicts of brand and excluded words go too."""
    return matched.where(~((F.col("match_rank") == 0) & (F.col("token_coverage") == 0)))
