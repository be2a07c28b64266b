"""Where findings come from: spans of pages, semantic roles within them, display segments.

Texts of a document are its spans joined by one character.  Offsets are running sums by chunks of
ordinals, ranges meet spans by buckets of offsets, and segments are one pass over sorted borders
with a counter for each role that is open; so a document may have any number of spans, and no
range is compared with spans or segments elsewhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import match_spans, once, stable_id

# --- fixed values: roles in their order, their patterns, statuses ------------------------------
ROLES = {
    "amount_or_rate": (r"\d+(?:[.,]\d+)?\s*%", r"(?i)(?:KRW\s*)?[0-9][0-9,]*(?:\s*)(?:원|만원|억원|krw)"),
    "timing_or_term": (r"\d+\s*(?:일|개월|년)\s*(?:이내|내|후|전|간)?", r"매\s*(?:월|분기|반기|년)", r"(?i)\d+\s*(?:days?|months?|years?)", r"(?i)(?:payment\s+due|due\s+within)\s+\d+\s*days?"),
    "deduction_recoupment_or_liability": (
        r"일반\s*경비", r"(?:공제|차감)(?:\s*항목|\s*대상|할\s*수\s*있다|한다)?", r"(?i)(?:선급금|미니멈\s*개런티|MG)\s*(?:회수|상계)?", r"(?:위약금|손해배상|책임|배상책임)",
        r"(?i)\b(?:deductions?|recoup(?:ment)?|liability|penalty)\b",
    ),
    "rights_scope_or_exclusivity": (
        r"(?:저작권|2차적저작물|이차적저작물|부가\s*권리)", r"(?:포괄\s*양도|독점|전속|자동\s*갱신)", r"(?i)\b(?:copyright|secondary\s+rights?|derivative\s+works?|exclusive|exclusivity)\b",
    ),
    "ambiguity_or_missing_bound": (
        r"일반\s*경비", r"(?:기타|그\s*밖의?)\s*(?:비용|경비|공제|수수료)", r"회사(?:가|의)?\s*정(?:한|하는)", r"할\s*수\s*있다", r"(?:포괄|제한\s*없(?:이|는)|상한\s*없(?:이|는))",
        r"(?i)\b(?:other|general)\s+(?:costs?|fees?|expenses?|deductions?)\b", r"(?i)\b(?:sole\s+discretion|as\s+determined|without\s+limit)\b",
    ),
}
VALIDATED, MISSING = "exact_span_validated", "missing_exact_span"
# ---------------------------------------------------------------------------------------------

#: Ordinals of a chunk of running sums, and characters of a bucket of offsets.
CHUNK, BUCKET = 4096, 8192


def running_before(rows: DataFrame, keys: list[str], ordinal: str, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """Adds the sum of ``value`` over the rows of lower ``ordinal`` with the same keys.  Sums of
    chunks are summed up first, so that a task sorts a chunk at most, or a row for each chunk."""
    part = F.floor(F.col(ordinal) / chunk)
    parts = rows.withColumn("_part", part).withColumn("_v", value)
    sums = parts.groupBy(*keys, "_part").agg(F.sum("_v").alias("_s"))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_part", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, "_part").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(sums, [*keys, "_part"]).withColumn(name, F.col("_base") + F.coalesce(F.sum("_v").over(within), F.lit(0)))
    return out.drop("_part", "_v", "_base")


def effective_spans(spans: DataFrame) -> DataFrame:
    """Spans of pages (span_id, page_index, text, corrected_text, text_source of the page,
    confidence) as a lookup: a correction replaces the text and is noted, a page of mixed sources
    tells a span's by its id, and a box is real for spans read by OCR with some doubt."""
    page = F.lower(F.trim(F.coalesce("text_source", F.lit(""))))
    by_id = F.when(F.col("span_id").contains(":ocr-"), "ocr").when(F.col("span_id").contains(":text-"), "text_layer").otherwise("mixed")
    source = F.when(page == "mixed", by_id).when(page.isin("ocr", "text_layer"), page).otherwise("text_layer")
    corrected = F.col("corrected_text").isNotNull()
    sure = F.coalesce("confidence", F.lit(1.0))
    return spans.withColumns({"text": F.coalesce("corrected_text", "text", F.lit("")), "is_user_corrected": corrected, "text_source": source, "has_real_bbox": (source == "ocr") & (sure < 1)}).drop("corrected_text")


def placed_spans(clause_spans: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """The spans of each clause (keys, ordinal, span_id) that the lookup knows, with their place in
    the clause's text: global_start and global_end."""
    known = clause_spans.join(spans, "span_id")
    placed = running_before(known, keys, "ordinal", F.length("text") + 1, "global_start")
    return placed.withColumn("global_end", F.col("global_start") + F.length("text"))


def located(ranges: DataFrame, spans: DataFrame, keys: list[str], bucket: int = BUCKET) -> DataFrame:
    """Ranges (keys, ..., start, end) of global offsets with the spans (keys, span_id, ...,
    global_start, global_end) that they lie in: a row for each piece, a range that crosses spans
    being cut at their borders, with piece_start and piece_end.

    Ranges and spans meet in the buckets of offsets that both touch; a piece counts in the bucket
    where it begins.  Characters between spans belong to none, nor do empty ranges.
    """

    def buckets(start, end):
        return F.explode(F.sequence(F.floor(start / bucket), F.floor((end - 1) / bucket))).alias("_bucket")

    r = ranges.filter("start < end").select("*", buckets(F.col("start"), F.col("end")))
    s = spans.filter("global_start < global_end").select("*", buckets(F.col("global_start"), F.col("global_end")))
    begin, end = F.greatest("start", "global_start"), F.least("end", "global_end")
    both = r.join(s, [*keys, "_bucket"]).filter((begin < end) & (F.floor(begin / bucket) == F.col("_bucket")))
    return both.withColumns({"piece_start": begin, "piece_end": end}).drop("_bucket")


def role_candidates(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, exact_text, roles): matches of role patterns in a span's text; equal ranges
    are one candidate with all their roles, in the order of roles.  Blank matches and null texts
    give none.  A text is looked through for a pattern's matches only if it has any."""
    t, none = F.col("text"), F.array().cast("array<string>")
    scans = {f"m{i}": (k, "(?U)" + p) for i, (k, p) in enumerate((k, p) for k, patterns in enumerate(ROLES.values()) for p in patterns)}
    # texts are scanned once, and matches placed once, each step behind a generator
    rows = once(spans, [*keys, "text"], **{n: F.coalesce(F.when(t.rlike(p), F.regexp_extract_all(t, F.lit(p), F.lit(0))), none) for n, (_, p) in scans.items()})
    rows = rows.filter(reduce(lambda x, y: x + y, (F.size(n) for n in scans)) > 0)

    def ranked(name: str, rank: int, pattern: str) -> Column:
        return F.transform(match_spans(t, pattern, F.col(name)), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("exact_text"), F.lit(rank).alias("rank")))

    rows = rows.select(*keys, F.explode(F.concat(*(ranked(n, k, p) for n, (k, p) in scans.items()))).alias("m")).select(*keys, "m.*").filter(F.trim("exact_text") != "")
    names = F.array(*map(F.lit, ROLES))
    by = rows.groupBy(*keys, "start", "end", "exact_text").agg(F.array_sort(F.collect_set("rank")).alias("_ranks"))
    return by.select(*keys, "start", "end", "exact_text", F.transform("_ranks", lambda k: F.get(names, k)).alias("roles"))


def valid_candidates(candidates: DataFrame, findings: DataFrame, clause_spans: DataFrame, spans: DataFrame) -> DataFrame:
    """Candidates (finding_id, clause_id, span_id, start, end, exact_text, roles) that hold: the
    finding is known, the clause is known and has the span, the span has a text, the range is in
    it and not empty, the text at the range is that of the candidate, and a known role is left
    (unknown ones go, the others stand in their order).  All others fall away."""
    c = candidates.join(findings.select("finding_id").distinct(), "finding_id", "left_semi")
    c = c.join(clause_spans.select("clause_id", "span_id").distinct(), ["clause_id", "span_id"], "left_semi")
    c = c.join(spans.filter("text IS NOT NULL").select("span_id", F.col("text").alias("_t")), "span_id")
    same = F.substring(F.col("_t"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("exact_text")
    roles = F.array_intersect(F.array(*map(F.lit, ROLES)), "roles")
    return c.filter((F.col("start") >= 0) & (F.col("end") <= F.length("_t")) & (F.col("start") < F.col("end")) & same).withColumn("roles", roles).filter(F.size("roles") > 0).drop("_t")


def role_segments(ranges: DataFrame, lengths: DataFrame, keys: list[str], bucket: int = BUCKET) -> DataFrame:
    """(keys, start, end, roles, n_ranges): texts of a ``length`` cut at the borders of their ranges
    (start, end, roles), each segment with the roles that cover it (none where none does) and the
    number of ranges that begin with it.

    A border adds to and takes from the counters of five roles.  Borders are summed by place, then
    by bucket of places, so that sorted passes cover a bucket, or a row for each bucket.
    """
    counters = [f"_r{k}" for k in range(len(ROLES))]
    sums = [*counters, "n_ranges"]

    def border(at, sign):
        return F.struct(at.cast("long").alias("at"), *((F.array_contains("roles", r).cast("int") * sign).alias(c) for c, r in zip(counters, ROLES)), F.lit(int(sign > 0)).alias("n_ranges"))

    def edge(at):
        return F.struct(at.cast("long").alias("at"), *(F.lit(0).alias(c) for c in sums))

    borders = ranges.select(*keys, F.inline(F.array(border(F.col("start"), 1), border(F.col("end"), -1))))
    borders = borders.unionByName(lengths.select(*keys, F.inline(F.array(edge(F.lit(0)), edge(F.col("length"))))))
    borders = borders.groupBy(*keys, "at").agg(*(F.sum(c).alias(c) for c in sums)).withColumn("_b", F.floor(F.col("at") / bucket))
    totals = borders.groupBy(*keys, "_b").agg(*(F.sum(c).alias(c) for c in counters), F.min("at").alias("_first"))
    over = Window.partitionBy(*keys).orderBy("_b")
    ahead = over.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_b", F.lead("_first").over(over).alias("_next"), *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_open") for c in counters))
    inner = Window.partitionBy(*keys, "_b").orderBy("at")
    run = inner.rowsBetween(Window.unboundedPreceding, 0)
    rows = borders.join(totals, [*keys, "_b"])
    open_ = [F.when(F.col(f"{c}_open") + F.sum(c).over(run) > 0, F.lit(r)) for c, r in zip(counters, ROLES)]
    out = rows.select(*keys, F.col("at").alias("start"), F.coalesce(F.lead("at").over(inner), "_next").alias("end"), F.array_compact(F.array(*open_)).alias("roles"), "n_ranges")
    return out.filter("end IS NOT NULL")


def source_highlights(findings: DataFrame, clause_spans: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources of findings and their display segments.

    findings (finding_id, clause_id), clause_spans (clause_id, ordinal, span_id), spans as of
    ``effective_spans``.  The first table has a row for each finding: anchor_id, status (VALIDATED if
    a segment is highlighted), page_index (of the first span), text_source (that of all spans, else
    mixed, or missing), is_user_corrected, has_real_bbox, n_spans, text_length, n_candidates,
    n_segments, n_highlighted, focus_start (of the first highlighted segment) and roles (in the order
    of roles).  A finding whose clause isn't known, or has no text, has the status MISSING and no
    segments.  The second has the segments of each clause: clause_id, start, end, roles, span_id and
    page_index of highlighted ones.  A clause's segments are made once, however many findings it has.
    """
    asked = clause_spans.join(findings.select("clause_id").distinct(), "clause_id", "left_semi")
    placed = placed_spans(asked, spans, ["clause_id"])
    candidates = role_candidates(placed.select("clause_id", "span_id", "global_start", "text"), ["clause_id", "span_id", "global_start"])
    ranges = candidates.select("clause_id", (F.col("global_start") + F.col("start")).alias("start"), (F.col("global_start") + F.col("end")).alias("end"), "roles")
    sources = F.sort_array(F.collect_set("text_source"))
    meta = placed.groupBy("clause_id").agg(
        F.max("global_end").alias("text_length"), F.count("*").alias("n_spans"), F.min_by("page_index", "ordinal").alias("page_index"),
        F.when(F.size(sources) == 1, sources[0]).otherwise("mixed").alias("_source"), F.bool_or("is_user_corrected").alias("is_user_corrected"), F.bool_or("has_real_bbox").alias("has_real_bbox"),
    ).filter("text_length > 0")
    meta = meta.withColumn("text_source", F.when(F.col("_source").isin("ocr", "text_layer"), F.col("_source")).otherwise("mixed")).drop("_source")
    parts = role_segments(ranges, meta.select("clause_id", F.col("text_length").alias("length")), ["clause_id"])
    # a highlighted segment lies in one span, and begins in one bucket of offsets
    touched = F.sequence(F.floor(F.col("global_start") / BUCKET), F.floor((F.col("global_end") - 1) / BUCKET))
    homes = placed.filter("global_start < global_end").select(F.col("clause_id").alias("_c"), "span_id", "page_index", "global_start", "global_end", F.explode(touched).alias("_b"))
    inside = (F.col("clause_id") == F.col("_c")) & (F.floor(F.col("start") / BUCKET) == F.col("_b")) & F.col("start").between(F.col("global_start"), F.col("global_end") - 1) & (F.size("roles") > 0)
    segments = parts.join(homes, inside, "left").select("clause_id", "start", "end", "roles", "span_id", "page_index", "n_ranges")
    shown = F.size("roles") > 0
    of = segments.groupBy("clause_id").agg(
        F.count("*").alias("n_segments"), F.sum("n_ranges").alias("n_candidates"), F.count_if(shown).alias("n_highlighted"), F.min(F.when(shown, F.col("start"))).alias("focus_start"),
        *(F.bool_or(F.array_contains("roles", r)).alias(f"_{r}") for r in ROLES),
    )
    of = of.withColumn("roles", F.array_compact(F.array(*(F.when(F.col(f"_{r}"), F.lit(r)) for r in ROLES)))).drop(*(f"_{r}" for r in ROLES))
    out = findings.join(meta.join(of, "clause_id"), "clause_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    none = F.array().cast("array<string>")
    return out.select(
        "finding_id", "clause_id", stable_id("source", F.col("finding_id"), F.col("clause_id")).alias("anchor_id"), F.when(F.col("n_highlighted") > 0, VALIDATED).otherwise(MISSING).alias("status"), "page_index",
        F.coalesce("text_source", F.lit("missing")).alias("text_source"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("is_user_corrected", "has_real_bbox")),
        *(zero(c) for c in ("n_spans", "text_length", "n_candidates", "n_segments", "n_highlighted")), "focus_start", F.coalesce("roles", none).alias("roles"),
    ), segments.drop("n_ranges")
