"""Personal data: base patterns, and spans from weak supervision, in DataFrame operations only.

Candidates for added spans are long mixed runs of letters and digits, as keys and passwords
are, what a word announces as a secret, and what begins with an issuer's prefix. Labelers vote on each candidate (+1, -1, or 0 where they abstain): patterns, a gazetteer
of issuers' prefixes, and the words before the candidate. Expectation-maximisation estimates
how reliable each labeler is from all candidates of the corpus, without gold labels, and its
posteriors train the final classifier, a logistic model on the candidate's own features.
Only the counts of vote and feature patterns, of which there are a bounded number, reach the
driver; the classifier goes back into the scan as an expression.

Places of matches: between split pieces stand the matches, so running sums of the lengths of
both give each match's begin. Sums run over blocks, so that they stay linear for long texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tianguis.llm.tables import table

# Each pattern finds what its plain form finds: a match begins where the last one ended or
# where no longer run could have begun, and possessive loops give nothing back, which keeps
# the search linear and off the stack.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

#: Characters before a candidate that the context labelers read.
CONTEXT = 24
BLOCK = 128

# What announces a secret, what announces other identifiers, issuers' prefixes.
SECRET_WORDS = "password passwd pwd passphrase secret token key apikey auth bearer credential"
OTHER_WORDS = "id uuid guid sha md5 commit hash rev version checksum etag"
PREFIXES = "AKIA ASIA ghp_ gho_ sk_live_ sk_test_ xoxb xoxp AIza glpat"
#: Of the words for secrets, those that hardly announce anything else.
SURE_WORDS = "password passwd pwd passphrase"


def _words(words: str) -> str:
    return "|".join(words.split())


# What an announcing word and "=" or ":" are followed by, at least 6 characters; after a mere
# space it must have a digit. The cheap looks back come first.
_VALUE = r"[A-Za-z0-9_/+][A-Za-z0-9_/+=.-]{4,}[A-Za-z0-9_/+=]"
_ASSIGNED = rf"(?<=[=:]\s{{0,2}}[\"']?)(?<=(?i:{_words(SECRET_WORDS)})s?[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?){_VALUE}"
_AFTER_SPACE = rf"(?<=\s)(?=[A-Za-z_/+=.-]*+[0-9])(?<=(?i:{_words(SECRET_WORDS)})\s){_VALUE}"
_ISSUED = rf"(?<![A-Za-z0-9_-])(?:{_words(PREFIXES)})[A-Za-z0-9_-]{{8,}}+"
#: Letters, digits and underscores, at least 16, of which some are letters and some digits.
_MIXED = r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{16,}+"
CANDIDATE = f"{_ASSIGNED}|{_AFTER_SPACE}|{_ISSUED}|{_MIXED}"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    back = F.reverse(digits)

    def step(total, i):
        d = F.ascii(F.substring(back, i, F.lit(1))) - 48
        doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid_card(m: Column) -> Column:
    d = _digits(m)
    return F.length(d).between(16, 19) & luhn(d)


def _valid_phone(m: Column) -> Column:
    return F.length(_digits(m)).between(8, 15)


def _valid_ip(m: Column) -> Column:
    return m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")


#: kind, pattern, test that a text may hold a match, test of a match
KINDS: list[tuple[str, str, Callable, Callable]] = [
    ("email", EMAIL, lambda t: t.contains("@"), lambda m: F.lit(True)),
    ("ip", IP, lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _valid_ip),
    ("card", CARD, lambda t: t.rlike(r"(?:[0-9][\x20-]?+){16}"), _valid_card),
    ("phone", PHONE, lambda t: t.rlike(r"\+[0-9]"), _valid_phone),
]
_SPAN = "struct<kind:string,start:bigint,end:bigint>"


def _placed(text: Column, pattern: str) -> Column:
    """Every match with its begin and the characters before it, as an array of structs."""
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.struct(F.length(p).cast("long").alias("gap"), F.length(m).cast("long").alias("long"), m.alias("m"), F.right(p, F.lit(CONTEXT)).alias("before")))
    return F.when(F.size(matches) == 0, None).otherwise(steps)


def _summed(steps: Column) -> Column:
    """Begins from the gaps and lengths that _placed gives."""
    total = F.aggregate
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(steps, b * BLOCK + 1, BLOCK), F.lit(0).cast("long"), lambda a, s: a + s["gap"] + s["long"]))
    offsets = F.transform(F.sequence(F.lit(0), F.size(blocks) - 1), lambda b: F.when(b == 0, F.lit(0).cast("long")).otherwise(total(F.slice(blocks, F.lit(1), F.greatest(b, F.lit(1))), F.lit(0).cast("long"), lambda a, n: a + n)))
    return offsets


def _begin(steps: Column, offsets: Column, i: Column) -> Column:
    inside = F.when(i % BLOCK == 0, F.lit(0).cast("long")).otherwise(
        F.aggregate(F.slice(steps, i - i % BLOCK + 1, F.greatest(i % BLOCK, F.lit(1))), F.lit(0).cast("long"), lambda a, s: a + s["gap"] + s["long"])
    )
    return F.element_at(offsets, F.floor(i / BLOCK).cast("int") + 1) + inside


def _spans(df: DataFrame, text: str, name: str, pattern: str, may: Column) -> DataFrame:
    """Adds the column ``name``: array of (start, end, m, before) of all matches."""
    steps, offsets = f"_{name}_steps", f"_{name}_offsets"
    df = df.withColumn(steps, F.when(may, _placed(F.col(text), pattern)))
    df = df.withColumn(offsets, F.when(F.col(steps).isNotNull(), _summed(F.col(steps))))

    def place(s, i):
        begin = _begin(F.col(steps), F.col(offsets), i) + s["gap"]
        return F.struct(begin.alias("start"), (begin + s["long"]).alias("end"), s["m"].alias("m"), s["before"].alias("before"))

    empty = F.array().cast("array<struct<start:bigint,end:bigint,m:string,before:string>>")
    return df.withColumn(name, F.coalesce(F.transform(steps, place), empty)).drop(steps, offsets)


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``email, ip, card, phone``: arrays of (kind, start, end) of the valid matches."""
    for kind, pattern, may, valid in KINDS:
        df = _spans(df, text, f"_{kind}", pattern, may(F.col(text)))
        df = df.withColumn(kind, _named(kind, F.filter(f"_{kind}", _on_match(valid)))).drop(f"_{kind}")
    return df


def _on_match(valid: Callable) -> Callable:
    return lambda s: valid(s["m"])


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_candidates``, the candidates for added spans that no base span overlaps."""
    df = _spans(df, text, "_found", CANDIDATE, F.col(text).rlike(CANDIDATE))
    base = F.concat(*[F.col(k) for k, *_ in KINDS])
    free = F.filter("_found", lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return df.withColumn("_candidates", free).drop("_found")


#: Small letters, capitals and digits.
_THREE_SORTS = "(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])"


def labelers(m: Column, before: Column) -> dict[str, Column]:
    """The votes of each labeler on a candidate: +1 secret, -1 other, 0 abstains."""
    share = F.length(_digits(m)) / F.length(m)
    return {
        "hex": F.when(m.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), 1).otherwise(0),
        "capitals": F.when(m.rlike("^[A-Z0-9]+$"), 1).otherwise(0),
        "gazetteer": F.when(m.rlike(f"^(?:{_words(PREFIXES)})"), 1).otherwise(0),
        "announced": F.when(before.rlike(rf"(?i)(?:{_words(SECRET_WORDS)})[\"'\s]*[=:]?[\"'\s]*$"), 1).otherwise(0),
        "sure": F.when(before.rlike(rf"(?i)(?:{_words(SURE_WORDS)})[\"']?\s*[=:][\"'\s]*$"), 1).otherwise(0),
        "other_name": F.when(before.rlike(rf"(?i)(?:^|[^a-z])(?:{_words(OTHER_WORDS)})[\"'\s]*[=:#/]?[\"'\s]*$"), -1).otherwise(0),
        "mixed": F.when(m.rlike(_THREE_SORTS), 1).otherwise(0),
        "words": F.when(m.rlike("[a-z]{7,}"), -1).otherwise(0),
        "digits": F.when(share.between(0.15, 0.85), 1).when((share > 0.85) | ((share > 0) & (F.length(m) >= 16) & m.rlike("^[A-Za-z0-9_]+$")), -1).otherwise(0),
    }


def span_features(m: Column, before: Column) -> dict[str, Column]:
    """What the final classifier sees of a candidate, as 0 or 1."""
    n = F.length(m)
    tests = {
        "assigned": before.rlike(r"[=:][\"'\s]*$"),
        "quoted": before.rlike("[\"']$"),
        "announced": before.rlike(rf"(?i)(?:{_words(SECRET_WORDS)})[\"'\s]*[=:]?[\"'\s]*$"),
        "sure": before.rlike(rf"(?i)(?:{_words(SURE_WORDS)})[\"']?\s*[=:][\"'\s]*$"),
        "mixed": m.rlike(_THREE_SORTS),
        "digitless": ~m.rlike("[0-9]"),
        "hex": m.rlike("^[0-9a-f]+$|^[0-9A-F]+$"),
        "capitals": m.rlike("^[A-Z0-9]+$"),
        "prefix": m.rlike(f"^(?:{_words(PREFIXES)})"),
        "wordlike": m.rlike("[a-z]{7,}"),
        "changes": m.rlike("(?:[0-9][A-Za-z]|[A-Za-z][0-9]).*(?:[0-9][A-Za-z]|[A-Za-z][0-9]).*(?:[0-9][A-Za-z]|[A-Za-z][0-9])"),
        "long": n > 20,
        "longer": n > 40,
    }
    return {k: v.cast("int") for k, v in tests.items()}


def _is_sure(votes: dict[str, int]) -> bool:
    """Whether labelers that are hardly ever wrong agree on a secret, and none says that it is something else."""
    return votes["other_name"] == 0 and (votes["sure"] == 1 or votes["gazetteer"] == 1 or (votes["announced"] == votes["mixed"] == 1 and votes["words"] == 0))


def estimate(counted: list[tuple[tuple, int]], rounds: int = 100, sure: list[bool] | None = None) -> list[float]:
    """For each vote pattern the probability of a secret, by expectation-maximisation.

    ``counted`` are vote patterns with their numbers. Labelers count as independent given the
    class; a labeler's chance of each vote in each class is estimated with a small prior that
    it is right more often than wrong. Patterns that are ``sure`` stay at 0.95 at least.
    """
    width = len(counted[0][0]) if counted else 0
    post = [min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for v, _ in counted]
    for _ in range(rounds):
        weight = [sum(n * p for (_, n), p in zip(counted, post)), sum(n * (1 - p) for (_, n), p in zip(counted, post))]
        prior = (weight[0] + 1) / (sum(weight) + 2)
        chance = []
        for j in range(width):
            by_class = []
            for c in (1, 0):
                got = {1: 2.0 if c else 1.0, 0: 1.0, -1: 1.0 if c else 2.0}
                for (v, n), p in zip(counted, post):
                    got[v[j]] += n * (p if c else 1 - p)
                total = sum(got.values())
                by_class.append({k: x / total for k, x in got.items()})
            chance.append(by_class)
        following = []
        for v, _ in counted:
            odds = math.log(prior / (1 - prior)) + sum(math.log(chance[j][0][v[j]] / chance[j][1][v[j]]) for j in range(width))
            following.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        if sure:
            following = [max(0.95, p) if known else p for p, known in zip(following, sure)]
        if max(abs(a - b) for a, b in zip(post, following)) < 1e-9:
            break
        post = following
    return post


def fit_logistic(rows: list[tuple[tuple, float, int]], rounds: int = 500) -> list[float]:
    """Weights, the constant last, for (features, probability, number) rows; a small ridge."""
    width = len(rows[0][0]) + 1 if rows else 1
    w, m, v = [0.0] * width, [0.0] * width, [0.0] * width
    total = sum(n for *_, n in rows) or 1
    for step in range(1, rounds + 1):
        grad = [-1e-3 * x for x in w]
        for f, p, n in rows:
            x = (*f, 1)
            s = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x))))))
            for j, a in enumerate(x):
                if a:
                    grad[j] += n * (p - s) / total
        for j, g in enumerate(grad):
            m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
            w[j] += 0.1 * (m[j] / (1 - 0.9**step)) / (math.sqrt(v[j] / (1 - 0.999**step)) + 1e-9)
    return w


def train(found: DataFrame) -> list[float] | None:
    """The classifier's weights from the column ``_candidates``; None without candidates."""
    each = found.where(F.size("_candidates") > 0).select(F.explode("_candidates").alias("c")).select("c.m", "c.before")
    m, before = F.col("m"), F.col("before")
    votes, features = labelers(m, before), span_features(m, before)
    patterns = each.select(F.array(*votes.values()).alias("votes"), F.array(*features.values()).alias("features")).groupBy("votes", "features").agg(F.count("*").alias("n")).collect()
    if not patterns:
        return None
    by_votes: dict[tuple, int] = {}
    for r in patterns:
        by_votes[tuple(r["votes"])] = by_votes.get(tuple(r["votes"]), 0) + r["n"]
    counted = sorted(by_votes.items())
    post = dict(zip([v for v, _ in counted], estimate(counted, sure=[_is_sure(dict(zip(votes, v))) for v, _ in counted])))
    return fit_logistic(sorted((tuple(r["features"]), post[tuple(r["votes"])], r["n"]) for r in patterns))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, email, ip, card, phone, secret)``, one row for each row of ``docs``: arrays of
    (kind, start, end) by start, in code points, the end exclusive.

    The first four are the base spans: leftmost matches of a kind that do not overlap, where
    one that fails its test (address parts above 255, digits, check digit) is dropped and its
    characters are not searched again. Spans of different kinds may overlap. ``secret`` are
    the added spans; they overlap no base span.

    Null and empty texts have no spans. Repeated and null ids are separate rows. An empty
    table gives an empty table; other columns are neither read nor returned. Texts of any
    length are searched whole.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = candidates(base_spans(slim))
    weights = train(found)
    if weights is None:
        return found.select("doc_id", *[k for k, *_ in KINDS], F.array().cast(f"array<{_SPAN}>").alias("secret"))

    def accepted(c):
        score = F.lit(weights[-1])
        for w, f in zip(weights, span_features(c["m"], c["before"]).values()):
            score = score + f * F.lit(w)
        return score >= 0

    return found.select("doc_id", *[k for k, *_ in KINDS], _named("secret", F.filter("_candidates", accepted)).alias("secret"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    kinds = [k for k, *_ in KINDS]
    base = _joined(F.concat(*kinds))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in [*kinds, "secret"]]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), _joined(F.concat(*kinds, "secret")).alias("spans"))
