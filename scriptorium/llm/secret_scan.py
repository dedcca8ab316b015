"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Kinds in the order in which equal starts are listed. The first three are the base rules.
KINDS = {
    "assign": r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:\s*Proc-Type:[^\n]*\n)?(?:\s*DEK-Info:[^\n]*\n)?[^-]*-----END [A-Z ]*PRIVATE KEY-----",
    "opaque": r"[A-Za-z0-9+/_-]{24,}",
}
#: What stands around the body of a key: its first and last line and white space.
_PEM_FRAME = r"-----[A-Z ]*-----|\s"
#: What precedes the value in an assignment.
_KEY = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""
#: Cheap tests that a text has any match worth keeping.
_HINT = {
    "assign": r"(?i:passw|secret|token|api_?key)",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "pem": r"-----BEGIN ",
    "opaque": r"[A-Za-z0-9+/_-]{24}",
}


def _value(kind: str, match: Column) -> Column:
    """What is hashed: an assigned value, a key's body, else the match."""
    if kind == "pem":
        return F.regexp_replace(match, _PEM_FRAME, "")
    return F.regexp_replace(match, _KEY, "") if kind == "assign" else match


def _keep(kind: str, value: Column) -> Column:
    if kind == "opaque":  # three classes of characters: neither words nor plain numbers
        return value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")
    return F.length(value) >= {"assign": 6, "access": 20, "hex": 24, "pem": 16}[kind]


#: Values of a block of _running(), and code points of a block of a text.
BLOCK, CHUNK = 256, 4096


def _let(value: Column, body) -> Column:
    """body of a value that is evaluated once, however often body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, step) -> Column:
    """Running sums or maxima of an array of non-negative integers, from 0: blocks first, so that the work grows with the length and not with its square."""
    grow = lambda x: F.aggregate(x, F.array(F.lit(0)), lambda acc, v: F.concat(acc, F.array(step(F.element_at(acc, -1), v))))

    def in_blocks(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: grow(F.slice(x, b * BLOCK + 1, F.lit(BLOCK))))
        return F.when(F.size(x) > 0, blocks).otherwise(F.array().cast("array<array<int>>"))

    def joined(inner: Column) -> Column:
        offsets = F.slice(grow(F.transform(inner, lambda b: F.element_at(b, -1))), F.lit(1), F.size(inner))
        return F.flatten(F.zip_with(inner, offsets, lambda b, o: F.transform(F.slice(b, F.lit(2), F.size(b)), lambda v: step(v, o))))

    return _let(values, lambda x: _let(in_blocks(x), joined))


def _spans(text: Column, kind: str, order: int) -> Column:
    """Leftmost non-overlapping matches of a kind: array of (start, ord, end, value), in code points.

    The pieces between the matches give the offsets, so one split and one extraction yield all spans.
    """
    pattern = KINDS[kind]
    if kind == "hex":  # a run of 24 or more is found whole; shorter runs fail anyway
        pattern = "[0-9a-f]{24,}"
    none = F.array().cast("array<struct<start:int,ord:int,end:int,value:string>>")

    def located(found: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda gap, m: F.length(gap) + F.length(m))
        span = lambda end, m: F.struct((end - F.length(m)).alias("start"), F.lit(order).alias("ord"), end.alias("end"), _value(kind, m).alias("value"))
        return F.zip_with(_running(steps, lambda a, b: a + b), found, span)

    all_spans = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)
    return F.when(text.rlike(_HINT[kind]), F.filter(all_spans, lambda s: _keep(kind, s["value"]))).otherwise(none)


def find_candidates(docs: DataFrame, text: str = "text", into: str = "found") -> DataFrame:
    """Adds a column with the candidates of all kinds by start and kind. Null text is an empty text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(into, F.array_sort(F.flatten(F.array(*[_spans(body, k, i) for i, k in enumerate(KINDS)]))))


def _frequencies(some: DataFrame) -> DataFrame:
    """(_hash, _repos, _owners): distinct repositories and owners of each candidate hash."""
    who = some.select("_hash", F.struct("_owner", "_repo").alias("r"), F.struct("_owner").alias("o")).distinct()
    return cut(who.groupBy("_hash").agg(F.count_distinct("r").alias("_repos"), F.count_distinct("o").alias("_owners")))


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "lang", copied_owners: int = 3) -> DataFrame:
    """One row per document: its secret spans, judged by who else has the same value.

    Candidate values are hashed and counted by distinct repositories (owner and `repository` together)
    and distinct owners over the whole corpus. Base matches (assign, access, hex) always stay. The other
    kinds are added where at most `copied_owners` owners have the value: a widely copied example isn't a
    live credential. `live` counts owner-specific spans and `copied` those of widely copied values.

    Null text: no spans. Texts of any length are scanned whole, in time that grows with the length. Spans of one start
    are listed by kind. Null owner or repository: a group of its own. Rows that repeat are scanned and
    returned each. An empty table gives no rows; further columns of docs are ignored, whatever their names.
    Columns: the key, found, spans, live, copied, repositories, owners (maxima over the row's values).
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(owner).cast("string").alias("_owner"), F.col(repository).cast("string").alias("_repo"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = find_candidates(rows, "_text").drop("_text").withColumn("_rid", F.monotonically_increasing_id())
    rows = cut(rows)  # the texts are read once; what follows handles candidates only
    some = rows.where(F.size("found") > 0).select("_rid", "_key", "_owner", "_repo", F.explode("found").alias("c"))
    some = some.withColumn("_hash", F.sha2(F.col("c.value"), 256))
    judged = some.join(_frequencies(some), "_hash").withColumn("_live", F.col("_owners") <= copied_owners)
    per_row = judged.groupBy("_rid").agg(
        F.first("_key").alias("_key"),
        F.array_sort(F.collect_list(F.when((F.col("c.ord") < 3) | F.col("_live"), F.col("c")))).alias("found"),
        F.sum(F.col("_live").cast("long")).alias("live"), F.sum((~F.col("_live")).cast("long")).alias("copied"),
        F.max("_repos").alias("repositories"), F.max("_owners").alias("owners"),
    ).drop("_rid")
    zero = F.lit(0).cast("long")
    none = rows.where(F.size("found") == 0).select("_key", "found", zero.alias("live"), zero.alias("copied"), zero.alias("repositories"), zero.alias("owners"))
    out = per_row.unionByName(none)
    return out.select(F.col("_key").alias(key), "found", span_text(F.col("found")).alias("spans"), "live", "copied", "repositories", "owners")


def span_text(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["start"], s["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """The digest columns of scan_secrets()."""
    out = scan_secrets(docs)
    count = lambda i: F.size(F.filter("found", lambda s: s["ord"] == i)).cast("long")
    base = F.filter("found", lambda s: s["ord"] < 3)
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(span_text(base), 256).alias("base_sha256"), "spans", "live", "copied", "repositories", "owners")


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", owner: str = "source", repository: str = "lang", copied_owners: int = 3) -> DataFrame:
    """docs with every base span of a text, and every private key and opaque string judged live, replaced by the mark; other texts stay as they are.

    Keys, from their first line to their last, and opaque strings are judged as scan_secrets() does, by the owners of their
    value over all of docs: what many owners have is a sample that stays. Base spans go however many have them, as a
    password that was copied is none the safer. Overlapping spans are replaced as one. Only rows with a span to be judged are joined with
    the judgement. Null and empty texts stay; long ones take time in proportion. Rows that repeat are treated each; an empty
    table gives no rows. All columns of docs are returned, whatever their names; n_chars, if there is one, follows the text.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"), F.col(owner).cast("string").alias("_owner"), F.col(repository).cast("string").alias("_repo"))
    rows = cut(find_candidates(rows, into="found").withColumn("_rid", F.monotonically_increasing_id()).drop("text"))
    some = rows.where(F.size("found") > 0).select("_rid", "_owner", "_repo", F.explode("found").alias("c"))
    some = some.withColumn("_hash", F.sha2(F.col("c.value"), 256))
    live = some.where(F.col("c.ord") >= 3).join(_frequencies(some), "_hash").where(F.col("_owners") <= copied_owners)
    live = live.groupBy("_rid").agg(F.collect_list("c").alias("live"))
    open_ = F.exists("found", lambda s: s["ord"] >= 3)
    sure = F.filter("found", lambda s: s["ord"] < 3)
    judged = rows.where(open_).join(live, "_rid", "left")
    judged = judged.withColumn("spans", F.when(F.col("live").isNull(), sure).otherwise(F.array_sort(F.concat(sure, F.col("live")))))
    out = rows.where(~open_).withColumn("spans", sure).select("row", "spans").unionByName(judged.select("row", "spans"))
    text = F.when(F.size("spans") > 0, _without(F.col("row.text"), F.col("spans"), mark)).otherwise(F.col("row.text"))
    out = out.withColumn("text", text)
    changed = {"text": F.col("text"), "n_chars": F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("text")}
    return out.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns])


def _without(text: Column, spans: Column, mark: str) -> Column:
    """The text with the union of sorted spans replaced, run by run. It is read in blocks, as finding a code point takes time in proportion to its place."""
    reach = _running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    begins = F.concat(F.array(F.lit(0)), reach)  # what the spans before each one have reached
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    gaps = F.filter(F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda g: g["a"] <= g["b"])

    def piece(chunks: Column, g: Column) -> Column:
        part = lambda c: F.substring(F.get(chunks, c), F.greatest(g["a"] - c * CHUNK, F.lit(0)) + 1, g["b"] - F.greatest(g["a"], c * CHUNK))
        within = F.sequence(F.floor(g["a"] / CHUNK).cast("int"), F.floor((g["b"] - 1) / CHUNK).cast("int"))
        return F.when(g["a"] < g["b"], F.concat_ws("", F.transform(within, part))).otherwise(F.lit(""))

    chunks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))
    return F.array_join(_let(chunks, lambda c: F.transform(gaps, lambda g: piece(c, g))), mark)
