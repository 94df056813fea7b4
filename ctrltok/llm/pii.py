"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Strong patterns (email, IP address, payment card, phone) are reported as found and seed a graph: instances
(identifier texts) on one side, lexical patterns (the one or two words before an instance) on the other.  Scores
go back and forth a few times: a pattern's confidence for a kind is the score of its distinct instances over their smoothed
number, an instance's score is that of its best pattern with enough seeds.  Identifier-like tokens (digits or
``@``) that no strong pattern covers and that follow a confident pattern are reported as ``ctx_<kind>``.

Copies of a document add nothing to the graph, which counts distinct instances; aggregations are partial before every shuffle.

Defined results: null text is empty; repeated rows are scanned alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctrltok.llm.common import keyed, stored
from ctrltok.llm.spans import covered, found, listed

# fixed values: the strong patterns.  Possessive loops and the guard before a run (not inside a run unless the previous
# match ended there) keep long runs linear and match the same text
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]
NAMES = [*KINDS, *(f"ctx_{k}" for k in KINDS)]
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]++"
SPANS = "array<struct<kind:int,start:int,stop:int,value:string,before:string>>"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn's check of a digit string."""
    backwards = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.transform(backwards, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def is_ip(m: Column, _: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)


def is_card(m: Column, _: Column) -> Column:
    number = digits(m)
    return F.when(F.char_length(number).between(13, 19), luhn(number)).otherwise(False)


def is_phone(m: Column, _: Column) -> Column:
    return F.char_length(digits(m)).between(9, 15)


def is_identifier(m: Column, _: Column) -> Column:
    """Tokens that may be an identifier: four digits or more, or text on both sides of an @."""
    return (F.char_length(m) <= 64) & ((F.char_length(digits(m)) >= 4) | m.rlike(r"[A-Za-z0-9]@[A-Za-z0-9]"))


def of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"),
                                                 s["value"].alias("value"), s["before"].alias("before")))


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id, did, tag, base, tokens`` of every row: strong spans by kind and start, identifier-like tokens."""
    number = F.col("text").rlike("[0-9]")
    strong = [found("text", EMAIL, lambda m, g: F.lit(True), 0, F.col("text").contains("@")),
              found("text", IP, is_ip, 0, number & F.col("text").contains(".")),
              found("text", CARD, is_card, 0, number),
              found("text", PHONE, is_phone, 0, number & F.col("text").contains("+"))]
    tokens = found("text", TOKEN, is_identifier, 0, F.col("text").rlike("[0-9]{2}") | F.col("text").contains("@"))
    return keyed(docs).select("doc_id", "did", "tag", F.concat(*[of_kind(s, k) for k, s in enumerate(strong)]).alias("base"),
                              of_kind(tokens, -1).alias("tokens"))


def patterns(before: Column) -> Column:
    """The one and two words before an instance, lower-cased, digits as 0."""
    words = F.filter(F.split(F.regexp_replace(F.lower(before), "[0-9]", "0"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    one = F.when(n >= 1, F.concat(F.lit("1 "), F.element_at(words, -1)))
    two = F.when(n >= 2, F.concat(F.lit("2 "), F.element_at(words, -2), F.lit(" "), F.element_at(words, -1)))
    return F.filter(F.array(one, two), lambda p: p.isNotNull())


def score_patterns(edges: DataFrame, rounds: int = 2, least_seeds: int = 5, smooth: float = 2.0) -> DataFrame:
    """``pattern, seeds, confidence`` (one confidence per kind) from distinct ``(pattern, instance, kind)`` edges, kind -1
    where no strong pattern knows the instance."""
    def confidences(scored: DataFrame) -> DataFrame:
        return scored.groupBy("pattern").agg(
            F.count(F.when(F.col("kind") >= 0, 1)).alias("seeds"),
            F.array(*[F.sum(F.element_at("score", k + 1)) / (F.count("*") + smooth) for k in range(len(KINDS))]).alias("confidence"))

    seed = F.array(*[F.when(F.col("kind") == k, 1.0).otherwise(0.0) for k in range(len(KINDS))])
    found_ = stored(confidences(edges.withColumn("score", seed)), "pattern-scores")
    unknown = edges.filter("kind < 0")
    for _ in range(rounds):
        trusted = found_.filter(F.col("seeds") >= least_seeds)
        best = unknown.join(trusted, "pattern").groupBy("instance").agg(
            F.array(*[F.max(F.element_at("confidence", k + 1)) for k in range(len(KINDS))]).alias("best"))
        scored = edges.join(best, "instance", "left").withColumn(
            "score", F.when(F.col("kind") >= 0, seed).otherwise(F.coalesce("best", seed)))
        found_ = stored(confidences(scored), "pattern-scores")
    return found_.filter(F.col("seeds") >= least_seeds)


def discovered(scans: DataFrame, least_confidence: float = 0.6, **parameters) -> DataFrame:
    """``did, tag, added``: tokens that no strong span touches after a confident pattern, by kind and start."""
    spans = scans.select("did", "tag", F.explode(F.concat("base", "tokens")).alias("s")).select(
        "did", "tag", F.col("s.kind").alias("kind"), F.col("s.start").alias("start"), F.col("s.stop").alias("stop"),
        F.xxhash64(F.lower("s.value")).alias("instance"), patterns(F.col("s.before")).alias("patterns"))
    free = covered(spans, "start", "stop", F.col("kind") >= 0).filter(~F.col("covered"))
    places = free.select("did", "tag", "kind", "start", "stop", "instance", F.explode("patterns").alias("pattern"))
    places = stored(places, "pii-places")
    edges = stored(places.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "pii-edges")
    top = F.array_max("confidence")
    sure = (score_patterns(edges, **parameters).filter(top >= least_confidence)
            .select("pattern", top.alias("confidence"), (F.array_position("confidence", top) - 1).cast("int").alias("as")))
    hits = places.filter("kind < 0").join(sure, "pattern").groupBy("did", "tag", "start", "stop").agg(
        F.max_by("as", F.struct("confidence", "as")).alias("as"))
    span = F.struct((F.col("as") + len(KINDS)).alias("kind"), "start", "stop")
    return hits.groupBy("did", "tag").agg(F.sort_array(F.collect_list(span)).alias("added"))


def personal_data(docs: DataFrame, **parameters) -> DataFrame:
    """``doc_id, base, added`` for every row: span arrays by kind, then start."""
    scans = stored(scanned(docs), "pii-scan")
    none = F.expr("cast(array() as array<struct<kind:int,start:int,stop:int>>)")
    return scans.join(discovered(scans, **parameters), ["did", "tag"], "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def digests(docs: DataFrame, **parameters) -> DataFrame:
    """Counts and digest of the strong spans and all spans as a string, for every row."""
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    base, added = listed(F.col("base"), NAMES), listed(F.col("added"), NAMES)
    spans = F.concat_ws(",", F.when(base != "", base), F.when(added != "", added))
    return personal_data(docs, **parameters).select("doc_id", *map(count, range(len(KINDS))), F.sha2(base.cast("binary"), 256).alias("base_sha256"),
                                                    spans.alias("spans"))
