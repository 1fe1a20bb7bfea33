"""Secret scans with corpus-wide ownership of every candidate.

Candidates are found by pattern; a hash of each value is counted by distinct
repositories and owners. What many owners have is a copied example; what one
owner alone has, and looks random, is reported as live. Everything is DataFrame
functions, and positions come from the gaps between matches by a running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltpoint.llm.common import staged

# The base patterns and the least length of what they find.
_KEYWORD = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = _KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LENGTH = 12
#: The method's own candidates: a run of 20 or more with a digit and both cases
#: or, at 32 or more, a digit and a letter. Possessive, so linear in the run.
RUN = r"[A-Za-z0-9+/_-]{20,}+"
KINDS = ("assign", "access", "hex", "live")
#: A candidate that at most this many owners have is theirs.
MAX_OWNERS = 1


def _looks_random(value: Column) -> Column:
    digit, lower, upper = value.rlike("[0-9]"), value.rlike("[a-z]"), value.rlike("[A-Z]")
    return digit & ((lower & upper) | ((F.length(value) >= 32) & (lower | upper)))


_MATCHES = "array<struct<kind:string,at:int,gap:int,size:int,value:string>>"


def _matches(text: Column, kind: str, pattern: str, group: int | None = None) -> Column:
    """``kind, at, gap, size, value`` of every match: ``gap`` characters lie
    between it and the match before. Most texts have none, which one search
    tells; the others are taken apart."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    values = found if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.transform(
        F.arrays_zip(found.alias("found"), F.slice(gaps, F.lit(1), F.size(found)).alias("gaps"), values.alias("values")),
        lambda m, at: F.struct(
            F.lit(kind).alias("kind"),
            at.alias("at"),
            F.char_length(m["gaps"]).alias("gap"),
            F.char_length(m["found"]).alias("size"),
            m["values"].alias("value"),
        ),
    )
    return F.when(text.rlike(pattern), rows.cast(_MATCHES)).otherwise(F.array().cast(_MATCHES))


def candidates(docs: DataFrame, repo: str = "source", owner: str = "source") -> DataFrame:
    """A row for each distinct document and match, and one for a document
    without: ``doc_id, h, repo, owner, copies, kind, at, start, stop, secret,
    random``. ``copies`` counts equal rows; ``secret`` is a hash of the value."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select("doc_id", F.col(repo).alias("repo"), F.col(owner).alias("owner"), text.alias("text"))
    found = F.concat(
        _matches(F.col("text"), "assign", ASSIGN, 1),
        _matches(F.col("text"), "access", ACCESS),
        _matches(F.col("text"), "hex", HEX),
        _matches(F.col("text"), "live", RUN),
    )
    rows = named.select(
        "doc_id", F.struct(F.xxhash64("text").alias("x"), F.octet_length("text").alias("n")).alias("h"), "repo", "owner", F.explode_outer(found).alias("m")
    ).select(
        "doc_id",
        "h",
        "repo",
        "owner",
        F.col("m.kind").alias("kind"),
        F.col("m.at").alias("at"),
        F.col("m.gap").alias("gap"),
        F.col("m.size").alias("size"),
        F.sha2("m.value", 256).alias("secret"),
        F.char_length("m.value").alias("length"),
        F.coalesce(_looks_random(F.col("m.value")), F.lit(False)).alias("random"),
    )
    # Equal rows become one with a count, so that sums run over each once.
    once = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    before = Window.partitionBy("doc_id", "h", "repo", "owner", "kind").orderBy("at")
    stop = F.sum(F.col("gap") + F.col("size")).over(before)
    placed = once.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("size"))
    wanted = F.col("kind").isNull() | (F.col("kind") != "assign") | (F.col("length") >= ASSIGN_LENGTH)
    return placed.withColumn("kind", F.when(wanted, F.col("kind"))).drop("gap", "size", "length")


def ownership(found: DataFrame) -> DataFrame:
    """``secret, repos, owners, documents`` of every candidate value, counted
    over the whole corpus in steps that combine before they shuffle."""
    by_place = found.where("kind is not null").groupBy("secret", "owner", "repo").agg(F.sum("copies").alias("documents"))
    by_owner = by_place.groupBy("secret", "owner").agg(F.count("*").alias("repos"), F.sum("documents").alias("documents"))
    return by_owner.groupBy("secret").agg(
        F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("documents").alias("documents")
    )


def scan(docs: DataFrame, repo: str = "source", owner: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """``doc_id, copies`` and ``spans``: an array of ``start, rank, stop, kind,
    owners, repos, live`` in order of start and kind, for each distinct row.

    Spans are in code points, ends exclusive. Base kinds are all kept; a span of
    kind ``live`` is added for a random-looking run that at most ``max_owners``
    owners have. ``live`` on a base span says the same of its value. Null texts
    are empty. Ids that are null or repeat are told apart by the text; equal
    rows count as copies. A null owner or repository is one of its own."""
    found = staged(candidates(docs, repo, owner), "candidates")
    owned = staged(ownership(found), "owners")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    live = (F.col("random") | (F.col("kind") != "live")) & (F.col("owners") <= max_owners)
    judged = (
        found.where("kind is not null")
        .join(owned, "secret")
        .withColumn("live", live)
        .where("kind <> 'live' or live")
        .select("doc_id", "h", "repo", "owner", F.struct("start", rank.alias("rank"), "stop", "kind", "owners", "repos", "live").alias("span"))
    )
    every = found.groupBy("doc_id", "h", "repo", "owner").agg(F.max("copies").alias("copies"))
    rows = every.select("doc_id", "h", "repo", "owner", "copies", F.lit(None).cast(judged.schema["span"].dataType).alias("span"))
    all_rows = rows.unionByName(judged.withColumn("copies", F.lit(None).cast("bigint")))
    return all_rows.groupBy("doc_id", "h", "repo", "owner").agg(
        F.max("copies").alias("copies"), F.array_sort(F.collect_list("span")).alias("spans")
    )


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256,
    spans, n_live, n_copied``. Of the base spans, ``n_live`` have a value that
    one owner alone has, ``n_copied`` one that several have."""
    found = scan(docs)
    base = F.filter("spans", lambda s: s["kind"] != "live")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.size(F.filter(base, lambda s: s["live"])).cast("bigint").alias("n_live"),
        F.size(F.filter(base, lambda s: s["owners"] > MAX_OWNERS)).cast("bigint").alias("n_copied"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"),
    ).drop("copy")
