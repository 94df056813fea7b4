"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong patterns (assignments, access keys, long hex) are reported as found.  Weak parts (an identifier
such as ``client_id=..``, a short or oddly named secret, an endpoint) are reported only when their complement is within ``reach``
code points in the same document: an identifier needs a secret, a secret needs an identifier or an endpoint,
an endpoint needs both.  Parts are dealt to scopes (document and stretch of ``reach`` code points), the earlier of a
pair by its end and to the next scope too, the later by its start, and joined there; spans of a pattern do not
overlap, so a scope holds a bounded number of ends and starts.

Defined results: null text is empty; repeated rows are scanned alike; rows that repeat a doc_id with other text
are linked one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctrltok.llm.common import keyed, stored
from ctrltok.llm.spans import covered, found, listed, marked

# fixed values: the strong patterns
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "identifier", "weak_secret", "endpoint"]

# names may be part of a longer one (DB_USER, aws-secret-access-key, PASSWORD_2) unless its end says that the value is something else
BEGIN = r"(?<![A-Za-z0-9])"
SUFFIX = (r"(?:[_-](?!(?:agent|type|count|length|size|limit|expir[a-z]*|ttl|ur[il]|file|path|method|status|group|role|mode)(?![A-Za-z0-9]))"
          r"[A-Za-z0-9]++){0,3}+")
IDENTIFIER = (rf"""(?i:{BEGIN}(?:access_?key_?id|client_?id|account_?id|user_?name|user|login){SUFFIX})["']?\x20*[:=]\x20*["']?"""
              r"""([A-Za-z0-9._@-]{3,})|\bA[KS]IA[A-Z0-9]{4,11}\b""")
WEAK_SECRET = (rf"""(?i:{BEGIN}(?:pwd|pass|passphrase|auth|private_?key|signature|password|passwd|secret_?access_?key|secret|token|api_?key){SUFFIX})"""
               r"""["']?\x20*[:=]\x20*["']?([^\s"',;]{4,})|(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])""")
ENDPOINT = (rf"""(?i:{BEGIN}(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://)[^\s"'<>,;]{{3,}}|"""
            rf"""(?i:{BEGIN}(?:host|hostname|endpoint|server){SUFFIX})["']?\x20*[:=]\x20*["']?([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++)""")
IDENTIFIERS, SECRETS, ENDPOINTS = 0, 1, 2
CLASS_OF = [SECRETS, IDENTIFIERS, SECRETS, IDENTIFIERS, SECRETS, ENDPOINTS]


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id, did, tag, base, weak``: sorted ``struct(start, kind, stop)`` arrays of every row."""
    assigned = F.col("text").contains("=") | F.col("text").contains(":")
    base = [found("text", ASSIGN, lambda m, g: F.char_length(g) >= 8, 2, assigned),
            found("text", ACCESS, lambda m, g: F.char_length(m) >= 16, 0, F.col("text").contains("AKIA")),
            found("text", HEX, lambda m, g: F.lit(True))]
    some = F.lit(True)
    weak = [found("text", IDENTIFIER, lambda m, g: some, 0, assigned | F.col("text").contains("IA")),
            found("text", WEAK_SECRET, lambda m, g: some),
            found("text", ENDPOINT, lambda m, g: some, 0, assigned)]
    return keyed(docs).select(
        "doc_id", "did", "tag",
        F.array_sort(F.concat(*[marked(b, k) for k, b in enumerate(base)])).alias("base"),
        F.concat(*[marked(w, k) for k, w in enumerate(weak, 3)]).alias("weak"))


def linked(scans: DataFrame, reach: int = 300) -> DataFrame:
    """``did, tag, added``: weak parts with a complement in reach, sorted."""
    classes = F.array(*[F.lit(c) for c in CLASS_OF])
    parts = (scans.filter(F.size("weak") > 0).select("did", "tag", F.explode(F.concat("base", "weak")).alias("p")).distinct()
             .select("did", "tag", "p", F.element_at(classes, F.col("p.kind") + 1).alias("class")))
    later = parts.select("did", "tag", F.col("p").alias("q"), F.col("class").alias("other"), F.floor(F.col("p.start") / reach).alias("scope"))
    # a start within reach after an end lies in the end's scope or the next
    scope = F.floor(F.col("p.stop") / reach)
    apart = F.col("q.start") - F.col("p.stop")
    pairs = (parts.withColumn("scope", F.explode(F.array(scope, scope + 1))).join(later, ["did", "tag", "scope"])
             .filter((apart >= 0) & (apart <= reach) & (F.col("class") != F.col("other"))))
    both = F.array(F.struct("p", "class", "other"), F.struct(F.col("q").alias("p"), F.col("other").alias("class"), F.col("class").alias("other")))
    met = pairs.select("did", "tag", F.inline(both)).filter(F.col("p.kind") >= 3)
    has = met.groupBy("did", "tag", "p", "class").agg(*[F.max(F.col("other") == c).alias(f"c{c}") for c in range(3)])
    whole = (F.when(F.col("class") == IDENTIFIERS, F.col("c1")).when(F.col("class") == SECRETS, F.col("c0") | F.col("c2"))
             .otherwise(F.col("c0") & F.col("c1")))
    return has.filter(whole).groupBy("did", "tag").agg(F.sort_array(F.collect_list("p")).alias("added"))


def apart(scans: DataFrame, links: DataFrame) -> DataFrame:
    """``did, tag, added``: the linked parts that no strong span touches, sorted."""
    base = scans.select("did", "tag", "base").join(links.select("did", "tag"), ["did", "tag"], "left_semi").distinct()
    both = links.select("did", "tag", F.explode("added").alias("p")).union(base.select("did", "tag", F.explode("base")))
    rows = both.select("did", "tag", "p", F.col("p.start").alias("start"), F.col("p.stop").alias("stop"))
    free = covered(rows, "start", "stop", F.col("p.kind") < 3).filter(~F.col("covered") & (F.col("p.kind") >= 3))
    return free.groupBy("did", "tag").agg(F.sort_array(F.collect_list("p")).alias("added"))


def secrets(docs: DataFrame, reach: int = 300) -> DataFrame:
    """``doc_id, base, added``: span arrays of every row, each sorted by start, then kind; parts that lie on a strong span
    are evidence for others and not reported again."""
    scans = stored(scanned(docs), "secret-scan")
    found_ = apart(scans, stored(linked(scans, reach), "secret-links"))
    return scans.join(found_, ["did", "tag"], "left").select(
        "doc_id", "base", F.coalesce("added", F.expr("cast(array() as array<struct<start:int,kind:int,stop:int>>)")).alias("added"))


def digests(docs: DataFrame, reach: int = 300) -> DataFrame:
    """Counts and digest of the strong spans and all spans as a string, for every row."""
    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    every = F.array_sort(F.concat("base", "added"))
    return secrets(docs, reach).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"), listed(every, KINDS).alias("spans"))
