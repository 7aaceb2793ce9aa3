"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Each pattern's matches get their places from the pieces between them (split) and their own lengths. The base kinds are
assign, access and hex. Besides these, long mixed tokens are candidates. Candidate strings are hashed and counted by
distinct repositories and owners over the whole corpus: one that COPIED_OWNERS owners share, or two with COPIED_REPOS
repositories between them, is a copied example; one that few have, or one owner in however many repositories, is
live-looking. Live-looking mixed tokens outside base spans are added as spans of kind `live`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, join_hot

#: The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # what AKIA[A-Z0-9]+ of 18 characters or more finds
HEX = r"[0-9a-f]{16,}"  # runs are maximal either way
VALUE = r"""^(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: Long tokens with a letter and a digit; e-mail addresses, URLs and file names have other characters.
MIXED = r"(?<![A-Za-z0-9_@./-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_@./-])"
ORDER = ("assign", "access", "hex", "live")
#: A secret with at least so many owners, or two owners and so many repositories, is a copied example.
COPIED_OWNERS, COPIED_REPOS = 3, 4


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once: an expression that is written twice, or within a lambda, is computed again each time."""
    return F.get(F.transform(F.array(value), use), 0)


def _running(values: Column, op) -> Column:
    """Running totals of an array under an associative op: shifts by 1, 2, 4, ..., each one pass over the array."""
    shifts = F.array(*[F.lit(1 << k) for k in range(31)])
    step = lambda a, s: F.transform(a, lambda x, i: F.when(i >= s, op(F.get(a, i - s), x)).otherwise(x))
    return _let(values, lambda v: F.reduce(F.filter(shifts, lambda s: s < F.size(v)), v, step))


def _spans(text: Column, pattern: str, kind: int, value: Column | None = None, least: int = 0) -> Column:
    """array<struct<start,kind,end,secret>> of the pattern's matches; `least`: characters of the secret. Places are code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    secret = (lambda m: F.regexp_replace(m, VALUE, "")) if value is not None else (lambda m: m)
    pairs = _let(found, lambda f: F.zip_with(f, F.slice(between, 1, F.size(f)), lambda m, g: F.struct(m.alias("text"), g.alias("gap"), F.length(m).alias("n"))))
    placed = lambda p, ends: F.zip_with(p, ends, lambda x, end: F.struct((end - x.n).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), secret(x.text).alias("secret")))
    spans = _let(pairs, lambda p: _let(_running(F.transform(p, lambda x: x.gap + x.n), lambda a, b: a + b), lambda ends: placed(p, ends)))
    if least:
        spans = F.filter(spans, lambda s: F.length(s.secret) >= least)
    none = F.array().cast("array<struct<start:int,kind:int,end:int,secret:string>>")
    return F.when(text.rlike(pattern), spans).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """docs: doc_id, repo, owner, text. Adds base (sorted spans of the base kinds) and mixed (candidates outside them)."""
    text = F.col("text")
    spans = docs.select(
        "doc_id", "repo", "owner", _spans(text, ASSIGN, 0, text, 12).alias("a"), _spans(text, ACCESS, 1).alias("k"), _spans(text, HEX, 2).alias("h"), _spans(text, MIXED, 3).alias("m")
    )
    base = F.array_sort(F.concat("a", "k", "h"))
    apart = F.filter("m", lambda m: ~F.exists(F.concat("a", "k", "h"), lambda b: (b.start < m.end) & (m.start < b.end)))
    return spans.select("doc_id", "repo", "owner", base.alias("base"), apart.alias("mixed"))


def ownership(scanned: DataFrame) -> DataFrame:
    """Of each candidate's hash: documents, distinct repositories and distinct owners. Counts are pre-aggregated by (hash, repository, owner)."""
    rows = scanned.select("repo", "owner", F.explode(F.concat("base", "mixed")).alias("s")).select(F.sha2(F.col("s.secret"), 256).alias("hash"), "repo", "owner")
    once = rows.groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"))
    repos = once.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("r"))
    return repos.groupBy("hash").agg(F.sum("n").alias("n_found"), F.sum("r").alias("n_repos"), F.count("*").alias("n_owners"))


def judged(docs: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """doc_id, uid, spans (sorted; start, kind, end, copied) of documents: base ones, and live-looking mixed ones."""
    scanned = cut(scan(docs).withColumn("uid", F.monotonically_increasing_id()))
    copied = cut(ownership(scanned).select("hash", ((F.col("n_owners") >= copied_owners) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= copied_repos))).alias("copied")))
    rows = scanned.select("uid", F.explode(F.concat("base", "mixed")).alias("s")).withColumn("hash", F.sha2(F.col("s.secret"), 256))
    rows = join_hot(rows, copied, ["hash"], by="uid").filter((F.col("s.kind") < 3) | ~F.col("copied"))
    spans = rows.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("s.start", "s.kind", "s.end", "copied"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,copied:boolean>>")
    return scanned.select("doc_id", "uid").join(spans, "uid", "left").select("doc_id", "uid", F.coalesce("spans", none).alias("spans"))


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source") -> DataFrame:
    """Digest of the spans of every document, with counts of copied base spans and of added ones.

    A repository is one of repo_col's values (nulls are one of their own), an owner one of owner_col's. Null texts are empty and have no
    spans. Very long texts are scanned whole. Spans that start together come in the order of kinds. Repeated rows count as further copies within their repository and each keep a row. An empty table gives an empty result.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[repo_col].cast("string").alias("repo"), docs[owner_col].cast("string").alias("owner"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    base = F.filter("spans", lambda s: s.kind < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    return judged(rows).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        count(3).alias("n_live"), F.size(F.filter(base, lambda s: s.copied)).cast("long").alias("n_copied"),
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span that isn't a copied example replaced by a mark, overlapping spans by one; n_chars follows.

    Texts are scanned and counted over the whole table; only documents with such spans change. Null and empty texts stay as
    they are, equal rows change alike, and other columns are kept under their names. An empty table gives an empty result.
    """
    text, cols = F.col("text"), docs.columns
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit(""))), 256)
    repo = F.concat_ws("/", "source", "lang") if "lang" in cols else F.col("source")
    rows = docs.select(key.alias("doc_id"), repo.alias("repo"), F.col("source").alias("owner"), F.coalesce(text, F.lit("")).alias("text"))
    live = F.filter("spans", lambda s: ~s.copied)
    hits = cut(judged(rows).select(F.col("doc_id").alias("__key"), live.alias("__spans")).filter(F.size("__spans") > 0).dropDuplicates(["__key"]))
    spans = F.col("__spans")

    def cleaned(reach):  # reach: where the spans up to each end
        before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))
        kept = F.transform(spans, lambda s, i: F.when((i > 0) & (s.start < before(i)), F.lit("")).otherwise(F.concat(F.substring(text, before(i) + 1, s.start - before(i)), F.lit(mark))))
        return F.concat(F.array_join(kept, ""), F.substring(text, F.element_at(reach, -1) + 1, F.length(text)))

    new = F.when(spans.isNotNull(), _let(_running(F.transform(spans, lambda s: s.end), F.greatest), cleaned)).otherwise(text)
    out = docs.withColumn("__key", key).join(hits, "__key", "left").withColumn("text", new)
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.when(spans.isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*cols)


def query(spark, sf_dir):
    """These tables have sources only: a source is an owner, its part in one language a repository."""
    docs = documents(spark, sf_dir)
    return find_secrets(docs.withColumn("repo", F.concat_ws("/", "source", "lang")), repo_col="repo")
