"""Secret scan with ownership frequency over the corpus, with DataFrame functions only.

Base candidates are found by fixed patterns: assignments, access keys, long hexadecimal runs. Further candidates, ``key``,
are long runs of letters and digits, of any length, that mix cases and digits as generated credentials do. The secret of every
candidate is hashed, and hashes are aggregated over the corpus by distinct repositories and distinct owners. A repository is a
text, so copies of one document under several owners are one repository (or what a column names). Both counts decide, measured
against all owners and repositories: a secret is a widely copied example if many owners hold it in as many
repositories (``OWNERS_SHARE`` of all owners, ``OWNERS_LEAST`` at least), or if more repositories hold it than any
owner keeps one secret in (``REPOSITORIES_SHARE`` of all, ``REPOSITORIES_LEAST`` at least). All others look live: they belong
to one owner or a few. Candidates ``key`` become spans ``owned`` if they look live and overlap no base span; base spans always
stay, marked live or example.

Positions of all matches: the pieces of a split at a pattern and the matches of the same pattern alternate, so running sums
of their lengths, in code points, are the places.

Defined cases: a null or empty text has no candidates; a null owner is an owner of its own, and so is a null repository;
rows that repeat a repository count once for a secret, and every row has its own result; candidates that repeat in a text
share their class; a document without candidates has the empty list; a text of any length is matched as a whole, in one
task; columns other than the named ones are not read, so they may have any names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import written

# The base patterns and their order. The runs of access and hex are bounded below in the pattern, which gives
# the same spans as dropping short runs, for a run of one character class is never split.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
    "[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ASSIGN_CHARS = 6
#: Candidates that only ownership turns into spans: whole runs of 24 or more letters and digits with a digit and both cases.
KEY = "[A-Za-z0-9]{24,}"
#: From so many owners on, each with a repository, a secret is an example: hundredths of all owners, and a least number.
OWNERS_SHARE, OWNERS_LEAST = 1, 3
#: From so many repositories on it is one whoever owns them: ten-thousandths of all repositories, and a least number.
REPOSITORIES_SHARE, REPOSITORIES_LEAST = 1, 20
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "key": KEY}

SPAN = "array<struct<start: bigint, kind: int, end: bigint, secret: string>>"


def spans_of(text: Column, kind: str) -> Column:
    """Spans of one kind as array of (start, kind, end, secret), in code points, end exclusive; empty without a match."""
    pattern, number = PATTERNS[kind], KINDS.index("owned" if kind == "key" else kind)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    secrets = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else hits
    # One gap more than matches: the last one gets nulls.
    both = F.zip_with(F.split(text, pattern, -1), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("n")))
    both = F.zip_with(both, secrets, lambda x, secret: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), secret.alias("secret")))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("found"))

    def wanted(secret: Column) -> Column:
        if kind == "assign":
            return F.length(secret) >= ASSIGN_CHARS
        if kind == "key":
            return secret.rlike("[0-9]") & secret.rlike("[a-z]") & secret.rlike("[A-Z]")
        return F.lit(True)

    def step(st: Column, x: Column) -> Column:
        start = st["at"] + x["gap"]
        end = start + x["n"]
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), x["secret"].alias("secret"))
        found = F.when(wanted(x["secret"]), F.concat(st["found"], F.array(span).cast(SPAN))).otherwise(st["found"])
        return F.struct(end.cast("long").alias("at"), found.alias("found"))

    found = F.aggregate(F.filter(both, lambda x: x["n"].isNotNull()), state, step, lambda st: st["found"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """Column ``__spans``: all spans of all kinds of a document, candidates ``key`` included, in order."""
    body = F.coalesce(F.col(text), F.lit(""))
    kinds = [spans_of(body, kind) for kind in PATTERNS]
    return docs.withColumn("__spans", F.array_sort(F.concat(*kinds)))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repositories, n_owners) of all candidates (hash, owner, repository), each counted distinct.

    Repeated pairs go before the shuffle and by the shuffle on both columns, so a hash of a third of all documents is spread
    until only its distinct repositories are left, which are added up by partial sums.
    """
    def distinct(column: str) -> DataFrame:
        return found.select("hash", column).distinct().groupBy("hash").agg(F.count(F.lit(1)).alias(f"n_{column}"))

    counts = distinct("repository").join(distinct("owner"), "hash")
    return counts.withColumnsRenamed({"n_repository": "n_repositories", "n_owner": "n_owners"})


def thresholds(rows: DataFrame) -> tuple[int, int]:
    """(owners, repositories) from which on a secret is an example, for rows (owner, repository)."""
    owners, repositories = (rows.select(c).distinct().count() for c in ("owner", "repository"))
    return max(OWNERS_LEAST, -(-owners * OWNERS_SHARE // 100)), max(REPOSITORIES_LEAST, -(-repositories * REPOSITORIES_SHARE // 10_000))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None) -> DataFrame:
    """One row per document: doc_id, spans.

    ``spans`` is an array of (start, kind, end, secret, n_repositories, n_owners, live), in the order of start and kind;
    kinds are numbers into ``KINDS``. ``repository``: a column that names it; None takes the text itself.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(owner).alias("owner"),
        (F.col(repository) if repository else F.md5(F.coalesce(F.col(text), F.lit("")))).alias("repository"), F.col(text).alias("text"),
    )
    # Written once: texts are matched once, and row numbers stay the same if a task runs again.
    rows = written(candidates(rows, "text").drop("text"), "secrets")
    each = rows.select("row", "owner", "repository", F.explode("__spans").alias("s")).select(
        "row", "owner", "repository", "s", F.sha2(F.col("s.secret"), 256).alias("hash")
    )
    counted = ownership(each.select("hash", "owner", "repository"))
    of_owners, of_repositories = thresholds(rows)
    copied = (F.col("n_owners") >= of_owners) & (F.col("n_repositories") >= of_owners) | (F.col("n_repositories") >= of_repositories)
    # The side of the documents is the large one, and AQE splits a hash that many of them hold.
    marked = each.join(counted, "hash").withColumn("live", ~copied)
    span = F.struct(*(F.col(f"s.{c}").alias(c) for c in ("start", "kind", "end", "secret")), "n_repositories", "n_owners", "live")
    marked = marked.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("__marked"))
    result = rows.select("row", "doc_id").join(marked, "row", "left")
    owned = len(KINDS) - 1
    base = F.filter(F.col("__marked"), lambda x: x["kind"] < owned)
    extra = F.filter(
        F.col("__marked"),
        lambda x: (x["kind"] == owned) & x["live"] & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])),
    )
    spans = F.array_sort(F.concat(base, extra))
    empty = F.array().cast(result.select(spans.alias("x")).schema["x"].dataType)
    return result.select("doc_id", F.coalesce(spans, empty).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(scanned: DataFrame) -> DataFrame:
    """Counts and digests of a scan, by document; ``most_`` are the largest counts of its secrets."""
    spans = F.col("spans")

    def of(kind: str) -> Column:
        return F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))

    base = F.filter(spans, lambda x: x["kind"] < len(KINDS) - 1)
    return scanned.select(
        "doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(spans).alias("spans"),
        F.size(F.filter(base, lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter(base, lambda x: ~x["live"])).cast("long").alias("n_example"),
        *(F.coalesce(F.array_max(F.col(f"spans.n_{c}")), F.lit(0)).cast("long").alias(f"most_{c}") for c in ("repositories", "owners")),
    )
