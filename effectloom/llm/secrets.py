r"""Secret scans judged by who owns each value in the whole corpus.

Every whole text is scanned for three base kinds (assignments of passwords and
tokens, access keys, long hex strings) and for further candidate kinds.  A
candidate's value is hashed and counted over the corpus by distinct repositories
and owners.  A value that several owners carry is a copied example; one that a
single owner has, in few repositories, and that mixes letters and digits is a
live-looking credential.  Base spans are always reported; further candidates
become spans only when they look live.

Only Spark SQL functions are used.  A text is split at its matches, so a match
begins after all earlier gaps and matches; these running lengths are summed over
exploded matches, keyed by a row number made once and written down.  Counting
pre-aggregates by (value, owner, repository), and the verdict is joined back on
salted hashes, as one value may be in a third of all documents.

null text: as empty, no spans.  Null owners and repositories count as one.  Rows
with a null or repeated id are kept and judged one by one; an empty table gives
an empty result; columns not named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_spans, staged, text_or_empty


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: kind, pattern, group of the value, least length of the value (of all matches, shorter ones are dropped)
BASE = [
    ("assign", rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # a failing match of these two runs to the end of its characters, so a minimum inside the pattern finds the same
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
EXTRA = [
    ("prefixed", r"(?:gh[pousr]_|glpat-|sk_live_|rk_live_|xox[abpr]-)[A-Za-z0-9_-]{16,}", 0, 20),
    ("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 20),
    ("userinfo", r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9_.-]+:([^\x20\x09-\x0D/@:]+)@", 1, 6),
    ("keyblock", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----([A-Za-z0-9+/=\x0A]+)", 1, 24),
]
SALTS = 16


def scanned(docs: DataFrame, kinds: Sequence[tuple], id_col: str, text_col: str, owner: Sequence[str], repo: Sequence[str]) -> DataFrame:
    """row, id, owner, repo and all matches of each document: (kind, order, nth, gap, hit, value)."""
    text = F.col("text")

    def found(order: int, kind: str, pattern: str, group: int) -> Column:
        p = F.lit(pattern)
        parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"),
                             F.regexp_extract_all(text, p, F.lit(group)).alias("value"))
        cut = F.transform(parts, lambda x, i: F.struct(
            F.lit(kind).alias("kind"), F.lit(order).alias("order"), i.alias("nth"), F.length(x["gap"]).alias("gap"), x["hit"].alias("hit"), x["value"].alias("value")))
        return F.when(text.rlike(pattern), F.filter(cut, lambda x: x["hit"].isNotNull())).otherwise(F.array().cast("array<struct<kind:string,order:int,nth:int,gap:int,hit:string,value:string>>"))

    def joined(cols: Sequence[str]) -> Column:
        return F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(cols)]))

    base = docs.select(F.col(id_col).alias("id"), joined(owner).alias("owner"), joined(repo).alias("repo"), text_or_empty(text_col).alias("text"))
    return staged(base.select(F.monotonically_increasing_id().alias("row"), "id", "owner", "repo", F.concat(
        *[found(i, k, p, g) for i, (k, p, g, _) in enumerate(kinds)]).alias("matches")), "matches")


def ownership(hits: DataFrame) -> DataFrame:
    """hash, n_docs, n_owners, n_repos of every value in the corpus."""
    by_repo = hits.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_found"), F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))


def secret_spans(docs: DataFrame, max_owners: int = 1, max_repos: int = 3, min_distinct: int = 8, id_col: str = "doc_id", text_col: str = "text",
                 owner_cols: Sequence[str] = ("source",), repo_cols: Sequence[str] = ("source", "lang")) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): every document as (row, id), and its spans as (row, kind, order,
    begin, end, base, live, n_owners, n_repos); code points, end exclusive."""
    kinds = [*BASE, *EXTRA]
    matches = scanned(docs, kinds, id_col, text_col, owner_cols, repo_cols)
    each = matches.select("row", "owner", "repo", F.explode("matches").alias("m")).select("row", "owner", "repo", "m.*")
    upto = Window.partitionBy("row", "order").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("hit")).over(upto)
    least = F.element_at(F.array(*[F.lit(k[3]) for k in kinds]), F.col("order") + 1)
    hits = staged(each.withColumn("end", end).filter(F.length("value") >= least).select(
        "row", "owner", "repo", "kind", "order", (F.col("end") - F.length("hit")).alias("begin"), "end", F.sha2("value", 256).alias("hash"),
        # looks random: letters and digits, and enough different characters
        (F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split("value", ""))) >= min_distinct)).alias("random")), "hits")
    salted = hits.withColumn("salt", F.pmod(F.xxhash64("row", "begin"), F.lit(SALTS)).cast("int"))
    verdict = ownership(hits).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    live = F.col("random") & (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    spans = salted.join(verdict, ["hash", "salt"]).select(
        "row", "kind", "order", "begin", "end", (F.col("order") < len(BASE)).alias("base"), live.alias("live"), "n_owners", "n_repos")
    return matches.select("row", "id"), spans.filter("base OR live")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied."""
    ids, spans = secret_spans(docs, id_col=id_col, **how)
    place = F.struct("begin", "order", F.concat_ws(":", "kind", "begin", "end").alias("span"))
    listed = spans.groupBy("row").agg(
        *[F.count_if(F.col("kind") == k[0]).alias(f"n_{k[0]}") for k in BASE],
        F.collect_list(F.when(F.col("base"), place)).alias("base_places"), F.collect_list(place).alias("places"),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_copied"))

    def text(places: str) -> Column:
        return F.coalesce(F.array_join(F.transform(F.array_sort(places), lambda x: x["span"]), ","), F.lit(""))

    return ids.join(listed, "row", "left").select(
        F.col("id").alias(id_col), *[F.coalesce(f"n_{k[0]}", F.lit(0)).cast("long").alias(f"n_{k[0]}") for k in BASE],
        F.sha2(text("base_places"), 256).alias("base_sha256"), text("places").alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def redact(docs: DataFrame, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with every span of its documents replaced; equal (id, text) rows are treated alike."""
    key = F.struct(F.col(id_col), F.xxhash64(text_or_empty(text_col)))
    ids, spans = secret_spans(docs.withColumn(id_col, key), id_col=id_col, text_col=text_col, **how)
    places = spans.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("places"))
    by_key = ids.join(places, "row").groupBy(F.col("id").alias("key")).agg(F.first("places").alias("places"))
    t = F.col("doc")[text_col]
    cut = cut_spans(t, F.col("places"), mark)
    out = docs.select(F.struct(*docs.columns).alias("doc"), key.alias("key")).join(by_key, "key", "left")
    return out.select(*[F.when(F.col("places").isNotNull(), cut).otherwise(t).alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns])


def _found_sql(order: int, kind: str, pattern: str, group: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, source, lang, '{kind}' AS kind, {order} AS k, string_split_regex(t, {p}) AS gaps,
 regexp_extract_all(t, {p}, 0) AS hits, regexp_extract_all(t, {p}, {group}) AS vals FROM d WHERE regexp_matches(t, {p})"""


SECRETS_SQL = f"""WITH d AS (SELECT doc_id, coalesce(source,'~null') AS source, coalesce(lang,'~null') AS lang, coalesce(text,'') AS t FROM documents),
m AS ({" UNION ALL ".join(_found_sql(i, k, p, g) for i, (k, p, g, _) in enumerate([*BASE, *EXTRA]))}),
x AS (SELECT doc_id, source, lang, kind, k, unnest(range(1, len(hits) + 1)) AS i, hits, vals, gaps FROM m),
e AS (SELECT doc_id, source, lang, kind, k, hits[i] AS hit, vals[i] AS val,
 sum(length(gaps[i]) + length(hits[i])) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM x),
h AS (SELECT *, e - length(hit) AS b, sha256(val) AS hash,
 regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]') AND len(list_distinct(string_split(val, ''))) >= 8 AS random
 FROM e WHERE length(val) >= [{", ".join(str(k[3]) for k in [*BASE, *EXTRA])}][k + 1]),
o AS (SELECT hash, count(DISTINCT source) AS owners, count(DISTINCT source || ' ' || lang) AS repos FROM h GROUP BY hash),
s AS (SELECT h.*, random AND owners <= 1 AND repos <= 3 AS live, kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT) AS span FROM h JOIN o USING (hash)),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
 string_agg(span, ',' ORDER BY b, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY b, k) AS spans,
 count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM s WHERE k < 3 OR live GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
 sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
 FROM d LEFT JOIN g USING (doc_id)"""
