"""Which findings an earlier investigation already covers, and what may reopen them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import patterns as P
from tracewell.functions import identity as I
from tracewell.functions import regex as rx
from tracewell.functions import text as T
from tracewell.operators import scan
from tracewell.operators.ledger import latest, members
from tracewell.session import cut_lineage

MAX_REFERENCES = 3
MIN_QUOTE, MAX_QUOTE = 20, 3000
ID_CHUNK = 1_000_000


def identity(host: Column, profile: Column, provider: Column, model: Column, target: Column, text: Column,
             severity: Column, impact: Column, aliases: dict[str, str] | None = None) -> dict[str, Column]:
    """scope_key, covered text and signature. Resource names, error details, durations and
    impact stay in: similar text without the same scope never covers."""
    steps = [(P.LEADING_STAMP, ""), (P.SCHEDULED_RUN, "[$1_<RUN>]"), (P.COOLDOWN_EXPIRY, "$1<TIME>"), (P.ISO_ANYWHERE, "<TIMESTAMP>"),
             (P.ATTEMPT_COUNT, "attempt <N>"), (P.FRAME_REFERENCE, 'File "<FRAME>", line'), (P.IDENTITY_PREFIX, ""), (r"\s+", " ")]
    # no step makes a word that the text does not hold, so without these words the steps that need them change nothing
    framed, scheduled = text.contains('File "'), text.contains("[cron_")
    worded = framed | scheduled | text.contains("will skip it until ") | F.lower(text).contains("attempt")
    bare = F.when(framed, F.regexp_replace(text, P.FRAME_REFERENCE, "")).otherwise(text)

    def found(test: Column, values: Column) -> Column:
        """Nothing where the test fails; unknown for an unknown text."""
        return F.when(test, values).when(text.isNotNull(), F.array().cast("array<string>"))

    paths = F.array_sort(F.array_distinct(F.concat(found(bare.contains("/"), rx.every(bare, P.POSIX_PATH, 2)), found(bare.contains(":\\"), rx.every(bare, P.WINDOWS_PATH)))))
    jobs = found(scheduled, F.array_sort(rx.distinct(text, P.SCHEDULED_RUN, 1)))
    scope = I.digest(T.canonical_host(host, aliases), F.coalesce(F.nullif(profile, F.lit("")), F.lit("UNKNOWN")), provider, model, target,
                     I.packed_list(paths), I.packed_list(jobs))
    plain = F.trim(F.when(worded, T._replace_all(text, steps)).otherwise(T._replace_all(text, [steps[0], steps[3], *steps[6:]])))
    return {
        "scope_key": scope,
        "concrete": (F.size(jobs) > 0) | (F.size(paths) > 0) | (provider.isNotNull() & model.isNotNull()),
        "covered_text": plain,
        "signature": I.digest(scope, plain, F.coalesce(severity, F.lit("watch")), impact),
    }


def _cutoffs(coverage: DataFrame) -> DataFrame:
    """Per finding the last investigation that was reopened; only later ones count."""
    return coverage.filter("reopened_at IS NOT NULL").groupBy(F.col("finding_id").alias("id")).agg(F.max("history_id").alias("cutoff"))


def basis(evidence: DataFrame, findings: DataFrame, coverage: DataFrame) -> DataFrame:
    """Current evidence of the findings that matter: undecided, approved, or covered before. id, evidence_id, signature,
    scope_key, concrete and impact; no text.

    Every question below starts from it, so it is reduced once and kept (a reliable checkpoint): evidence is read once.
    """
    relevant = findings.filter("decision IS NULL OR decision = 'rca'").select("id").union(
        coverage.select(F.col("finding_id").alias("id"))).distinct()
    # coverage may name findings that no longer exist
    known = relevant.join(findings.select("id"), "id", "left_semi")
    newest = latest(evidence.select("gid", "ts", "id", "signature", "scope_key", "concrete", "impact")).drop("ts")
    return cut_lineage(newest.withColumnRenamed("id", "evidence_id").withColumnRenamed("gid", "id").join(known, "id", "left_semi"))


def covered(current: DataFrame, coverage: DataFrame) -> DataFrame:
    """id, history_id: the earliest investigation whose evidence signature is the current one of a finding of ``basis``.

    It must not be reopened and must be later than the finding's own cutoff. Findings without a cutoff only need the
    earliest link of their signature: one row per signature, joined back to any number of findings in salted parts. For
    the few with a cutoff the distinct (signature, cutoff) are answered by a running minimum over history ids. So no pairs of
    findings and investigations are ever formed, and a signature that a third of all findings have is no task of its own.
    """
    c = F.col
    asked = current.select("id", "signature").join(_cutoffs(coverage), "id", "left")
    links = coverage.filter("reopened_at IS NULL").select(
        "signature", c("history_id").alias("at"), F.struct("completed_at", "history_id").alias("candidate"))
    earliest = links.groupBy("signature").agg(F.min("candidate").alias("first"))
    plain = scan.salted_join(asked.filter("cutoff IS NULL").select("id", "signature"), earliest, ["signature"], how="inner")
    late = asked.filter("cutoff IS NOT NULL").withColumn("at", c("cutoff") + 1).select("id", "signature", "at")
    places = late.select("signature", "at").distinct()
    wanted = links.join(places.select("signature").distinct(), "signature", "left_semi").withColumn("asked", F.lit(False))
    nothing = F.lit(None).cast(links.schema["candidate"].dataType)
    found = scan.running_min(
        wanted.unionByName(places.select("signature", "at", nothing.alias("candidate"), F.lit(True).alias("asked"))),
        ["signature"], "at", c("candidate"), "first", ID_CHUNK)
    answers = found.filter("asked AND first IS NOT NULL").select("signature", "at", "first")
    behind = scan.salted_join(late, answers, ["signature", "at"], how="inner")
    return plain.select("id", c("first.history_id").alias("history_id")).union(behind.select("id", "first.history_id"))


def _references(coverage: DataFrame, key: str) -> DataFrame:
    """Per key: the earliest link's scope and impact, and up to three investigation ids.

    The ids are cut to three per key before they are collected.
    """
    c = F.col
    earliest = coverage.groupBy(key).agg(F.min_by(F.struct("scope_key", "impact", "history_id"), F.struct("completed_at", "history_id")).alias("prior"))
    lowest = Window.partitionBy(key).orderBy("history_id")
    few = coverage.select(key, "history_id").distinct().withColumn("_rank", F.row_number().over(lowest)).filter(c("_rank") <= MAX_REFERENCES)
    return earliest.join(few.groupBy(key).agg(F.array_sort(F.collect_list("history_id")).alias("history_ids")), key)


def uncertain(current: DataFrame, findings: DataFrame, coverage: DataFrame, covered_by: DataFrame) -> DataFrame:
    """Findings of ``basis`` that are not covered, but have prior investigations of their own or of the same concrete scope.

    state is 'uncertain' with up to three references, or 'reopen' when the
    scope or the impact changed since the earliest of them.
    """
    c = F.col
    open_ = findings.filter("decision IS NULL OR decision = 'rca'").select("id")
    now = current.join(open_, "id", "left_semi").join(covered_by.select("id"), "id", "left_anti").join(
        _cutoffs(coverage), "id", "left_anti")
    own = _references(coverage.withColumn("id", c("finding_id")), "id").select("id", c("prior").alias("_own"), c("history_ids").alias("_own_ids"))
    shared = _references(coverage.filter("concrete").withColumn("_scope", c("scope_key")), "_scope").select(
        c("_scope").alias("scope_key"), c("prior").alias("_shared"), c("history_ids").alias("_shared_ids"))
    joined = scan.salted_join(now.join(own, "id", "left"), shared, ["scope_key"]).withColumns({
        "_prior": F.coalesce("_own", "_shared"), "history_ids": F.coalesce("_own_ids", "_shared_ids")}).filter("_prior IS NOT NULL")
    same = c("scope_key").eqNullSafe(c("_prior.scope_key")) & c("impact").eqNullSafe(c("_prior.impact"))
    return joined.select("id", F.when(same, "uncertain").otherwise("reopen").alias("state"), "history_ids", c("_prior.history_id").alias("prior_id"))


def held(batches: DataFrame) -> DataFrame:
    """Members of running and blocked batches."""
    return members(batches.filter("status IN ('running', 'blocked')")).select("id").distinct()


def busy(ids: DataFrame, current: DataFrame) -> DataFrame:
    """``ids``, and every finding of ``basis`` whose signature equals one of theirs."""
    signatures = current.join(ids.select("id").distinct(), "id", "left_semi").select("signature").distinct()
    return ids.select("id").union(current.select("id", "signature").join(signatures, "signature", "left_semi").select("id")).distinct()


def relations(claims: DataFrame, history: DataFrame) -> DataFrame:
    """Adds ``holds`` to claims that two findings are one problem.

    The scopes must match; the quote (30 to 3000 characters) must stand in the
    cited report, have relation wording before a mention of the other finding, and not hedge.
    """
    c = F.col
    cited = history.select(c("id").alias("relationship_history_id"), c("finding_id").alias("report_finding"), "report_text")
    joined = claims.join(cited, "relationship_history_id", "left")
    quote = c("quote")
    other = F.when(c("report_finding") == c("history_finding"), c("finding_id")).otherwise(c("history_finding"))
    fits = (
        (c("scope_key") == c("history_scope_key")) & c("concrete") & c("report_finding").isin(c("finding_id"), c("history_finding"))
        & F.length("quote").between(30, 3000) & c("report_text").contains(quote) & quote.contains(other)
        & ~quote.rlike(P.RELATION_HEDGE)
    )
    # The wording stands at most 250 characters before some mention of the other finding.
    pieces = F.split(quote, F.concat(F.lit(r"\Q"), other, F.lit(r"\E")), F.lit(-1))
    said = F.exists(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: p.rlike(P.RELATION_CLAIM + r"[^\n]{0,250}\z"))
    return joined.withColumn("holds", F.coalesce(fits & said, F.lit(False))).drop("report_finding", "report_text")


def reopenings(claims: DataFrame, evidence: DataFrame, coverage: DataFrame) -> DataFrame:
    """Adds ``accepted``: the claim cites the finding's newest evidence with a quote of 20 to 3000
    characters that no covered text has, or an owner's reference of at least 12 characters."""
    c = F.col
    newest = latest(evidence.select("gid", "ts", "id", "text")).select(
        c("gid").alias("finding_id"), c("id").alias("_current"), c("text").alias("_text"))
    joined = claims.join(newest, "finding_id", "left")
    # A quote is looked up by its first characters among all places of its finding's covered texts; only texts that hold
    # them are compared with the whole quote, so no pairs of claims and texts are formed.
    asked = joined.filter(F.length("quote") >= MIN_QUOTE).select(
        "claim_id", c("finding_id").alias("_finding"), "quote", F.xxhash64(F.left("quote", F.lit(MIN_QUOTE))).alias("_start"))
    texts = coverage.select("finding_id", "evidence_text").distinct().join(
        asked.select(c("_finding").alias("finding_id")).distinct(), "finding_id", "left_semi")
    places = F.sequence(F.lit(1), F.length("evidence_text") - (MIN_QUOTE - 1))
    held = texts.filter(F.length("evidence_text") >= MIN_QUOTE).select("finding_id", "evidence_text", F.explode(F.array_distinct(
        F.transform(places, lambda i: F.xxhash64(F.substr("evidence_text", i, F.lit(MIN_QUOTE)))))).alias("_place"))
    repeated = asked.join(held, (c("_finding") == c("finding_id")) & (c("_start") == c("_place")) & c("evidence_text").contains(c("quote")), "left_semi").select(
        "claim_id", F.lit(True).alias("_known")).distinct()
    cites = (c("_current") == c("evidence_id")) & F.length("quote").between(MIN_QUOTE, MAX_QUOTE) & c("_text").contains(c("quote")) & c("_known").isNull()
    authorised = F.length("owner_authorization") >= 12
    reasoned = F.length("reason").between(20, 1000)
    verdict = reasoned & F.when(F.coalesce("owner_authorization", F.lit("")) != "", authorised).otherwise(cites)
    return joined.join(repeated, "claim_id", "left").withColumn("accepted", F.coalesce(verdict, F.lit(False))).drop("_current", "_text", "_known")


# --- reports ----------------------------------------------------------------
def missing_sections(report: Column) -> Column:
    return F.array_compact(F.array(*[F.when(~rx.has(report, p), F.lit(name)) for name, p in P.REPORT_SECTIONS]))


def validate_reports(history: DataFrame, text: str = "report_text") -> DataFrame:
    """Adds missing_sections and valid: at least 100 characters and all nine sections."""
    body = F.coalesce(F.col(text), F.lit(""))
    return history.withColumn("missing_sections", missing_sections(body)).withColumn(
        "valid", (F.length(F.trim(body)) >= 100) & (F.size("missing_sections") == 0))


def report_outcome(history: DataFrame, text: str = "report_text") -> DataFrame:
    """Adds the headings, the root-cause excerpt and what the report concludes."""
    c = F.col
    excerpt = F.regexp_extract(c(text), r"(?is)(?:^|\n)#{2,6}[ \t]*(?:\d+[.)][ \t]*)?root cause[^\n]*\n(.*?)(?:\n#+ |\z)", 1)
    headings = F.regexp_extract_all(c(text), F.lit(r"(?:^|\n)##\s+([^\n]+)"), F.lit(1))
    staged = history.withColumns({"cause_excerpt": F.left(excerpt, F.lit(2000)), "headings": headings})
    return staged.withColumn("outcome", F.when(c("cause_excerpt").rlike(P.INCONCLUSIVE), "inconclusive")
                             .when(c("cause_excerpt").rlike(P.DIAGNOSED), "diagnosed").otherwise("investigated"))
