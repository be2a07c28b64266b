"""Financial terms with offsets, by scanning patterns in the JVM; no UDF.

A text is scanned once for each pattern of the families asked for, and of those that mask them:
ranges mask single values, dates mask durations.  What is left becomes a row for each match, with
the words near it but without the text; there its value is computed once, and the words name its
feature (the first rule that fits) and tell whether it is open-ended.  Steps are separated by
generators (``once``), so that the optimizer doesn't write a step into every place that uses it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_spans, once

# --- fixed values: patterns, rules, units and confidences that results depend on ------------
NUMBER = r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+(?:\.[0-9]+)?)"
BETWEEN = r"\s*(?:~|–|-|\bto\b|\bthrough\b|부터|에서)\s*"
KRW = r"(?:억\s*원|만\s*원|천\s*원|원|KRW|won)"
PERCENT = r"(?:%|percent|per\s+cent|퍼센트|프로)"
DAYS, MONTHS, YEARS = r"(?:business\s+days?|days?|영업일|일)", r"(?:months?|개월)", r"(?:years?|년)"
AFTER_TIME = r"(?=\s|$|[.,;:)\\\]]|[가-힣])"
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH = "(?:" + "|".join([*MONTH_NAMES, "sept", *(m[:3] for m in MONTH_NAMES if len(m) > 3)]) + ")"
YEAR = "(?:19|20)[0-9]{2}"
DATES = (
    YEAR + r"\s*년\s*[0-9]{1,2}\s*월\s*[0-9]{1,2}\s*일",
    YEAR + r"[./-][0-9]{1,2}[./-][0-9]{1,2}",
    rf"\b{MONTH}\.?\s+[0-9]{{1,2}}(?:,\s*|\s+){YEAR}\b",
    rf"\b[0-9]{{1,2}}\s+{MONTH}\.?\s+{YEAR}\b",
)
MONTH_ALONE = (YEAR + r"\s*년\s*[0-9]{1,2}\s*월\s*(?:중|말|초|경)", rf"\b{MONTH}\.?\s+{YEAR}\b")
OPEN_ENDED = (
    r"(?<![가-힣])약\s*[0-9]|내외|대략|추정|별도\s*(?:정|합의|협의)|회사.{0,12}(?:정하는|정한|재량)|기타|그\s*밖|등|actual\s+costs?|as\s+determined|to\s+be\s+determined|"
    r"including\s+but\s+not\s+limited|etc\.?|approximately|about|around|at\s+least|or\s+more|or\s+less|more\s+than|less\s+than|이상|초과|미만"
)
OPEN_PHRASE = (
    r"(?:기타|그\s*밖|등)[^.。;\n]{0,40}(?:비용|공제|수수료)|(?:비용|수수료|공제\s*항목)[^.。;\n]{0,40}(?:별도|협의|회사.{0,12}정)|"
    r"(?:other|additional)[^.。;\n]{0,40}(?:fees|costs|deductions|expenses)|(?:fees|costs|deductions|expenses)[^.。;\n]{0,40}(?:as\s+determined|to\s+be\s+determined)"
)
RULES = {
    "money": (
        (r"minimum\s+guarantee|미니멈|개런티|\bMG\b", "MINIMUM_GUARANTEE"),
        (r"advance|선급금|선불", "ADVANCE_AMOUNT"),
        (r"liability\s+cap|책임\s*상한|손해배상\s*한도", "LIABILITY_CAP"),
        (r"penalt|위약금|손해배상", "PENALTY_AMOUNT"),
        (r"net\s+sales|순매출", "NET_SALES"),
        (r"refund|환불", "REFUNDS"),
        (r"marketing|마케팅", "MARKETING_COST"),
        (r"fixed\s+fee|원고료|고정\s*금|정산금", "FIXED_FEE"),
        (r"gross\s+sales|총매출|매출", "GROSS_SALES"),
    ),
    "percent": (
        (r"translation|번역", "TRANSLATION_RIGHTS_SHARE"),
        (r"secondary\s+rights?|2차|이차|부가\s*권리", "SECONDARY_RIGHTS_SHARE"),
        (r"tax|withholding|원천징수", "TAX_WITHHOLDING"),
        (r"payment\s+processing|결제\s*수수료", "PAYMENT_PROCESSING_FEE"),
        (r"platform|플랫폼", "PLATFORM_FEE"),
        (r"deduct|공제", "DEDUCTION_RATE"),
        (r"recoup|회수", "RECOUPMENT_RATE"),
        (r"revenue\s+share|creator\s+receives|수익\s*배분|배분율|작가\s*몫", "REVENUE_SHARE_RATE"),
    ),
    "days": (
        (r"delay|late|지연|연체", "PAYMENT_DELAY_DAYS"),
        (r"termination|notice|해지|통지", "TERMINATION_NOTICE_DAYS"),
        (r"payment|due|지급|기일", "PAYMENT_DUE_DAYS"),
    ),
    "months": (
        (r"renew|갱신|연장", "RENEWAL_DURATION_MONTHS"),
        (r"exclusive|독점", "EXCLUSIVITY_DURATION_MONTHS"),
        (r"contract|term|기간|계약", "CONTRACT_DURATION_MONTHS"),
    ),
    "date": (
        (r"payment|due|지급|기일", "PAYMENT_DUE_DATE"),
        (r"termination|해지", "TERMINATION_DATE"),
        (r"effective|시행|효력|발효", "EFFECTIVE_DATE"),
    ),
}
DEFAULTS = {"money": "GROSS_SALES", "percent": "REVENUE_SHARE_RATE", "days": "PAYMENT_DUE_DAYS", "months": "CONTRACT_DURATION_MONTHS", "date": "CONTRACT_DATE"}
UNITS = {"money": "krw", "percent": "frac", "days": "days", "months": "months", "date": "none"}
SCALES = {"억원": 100_000_000, "만원": 10_000, "천원": 1_000, "thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
NEAR_FEATURE, NEAR_OPEN = 72, 40
SURE, UNSURE, BAD_DATE, PHRASE = 1.0, 0.85, 0.95, 0.75
# ---------------------------------------------------------------------------------------------

#: Case is ignored; white space and word borders are those of Unicode.
ANY_CASE = "(?iuU)"
#: What is scanned for: family, shape and patterns.
SCANS = {
    "date": DATES, "month_alone": MONTH_ALONE, "open_phrase": (OPEN_PHRASE,),
    "money_range": (NUMBER + BETWEEN + NUMBER + r"\s*" + KRW,), "percent_range": (NUMBER + BETWEEN + NUMBER + r"\s*" + PERCENT,),
    "time_range": (NUMBER + BETWEEN + NUMBER + rf"\s*(?:{DAYS}|{MONTHS}|{YEARS})",),
    "money": (NUMBER + r"\s*(?:thousand|million|billion)\s*(?:KRW|won)", r"(?:KRW|₩)\s*" + NUMBER, NUMBER + r"\s*" + KRW),
    "percent": (NUMBER + r"\s*" + PERCENT,), "time": tuple(NUMBER + r"\s*" + unit + AFTER_TIME for unit in (DAYS, MONTHS, YEARS)),
}
_SPAN = "array<struct<start:int,end:int,value:string>>"
#: Families of patterns whose matches mask those of a family.
MASKS = {
    "date": (), "month_alone": ("date",), "money_range": (), "percent_range": (), "time_range": ("date", "month_alone"), "money": ("money_range", "percent_range", "time_range"),
    "percent": ("money_range", "percent_range", "time_range"), "time": ("money_range", "percent_range", "time_range", "date", "month_alone"),
}
#: Families that give terms of a unit.
GIVES = {"krw": ("money_range", "money"), "frac": ("percent_range", "percent"), "days": ("time_range", "time"), "months": ("time_range", "time"), "none": ("date", "month_alone", "open_phrase")}
#: What a text must hold for a family to occur in it.
HINTS = {"money": KRW + "|₩", "money_range": KRW, "percent": PERCENT, "percent_range": PERCENT, "time": f"{DAYS}|{MONTHS}|{YEARS}", "time_range": f"{DAYS}|{MONTHS}|{YEARS}"}


def near(text: Column, m: Column, width: int) -> Column:
    """The text from ``width`` characters before a match to as many after it."""
    begin = F.greatest(F.lit(0), m["start"] - width)
    return F.substring(text, begin + 1, m["end"] + width - begin)


def feature(words: Column, family: Column, families) -> Column:
    """The first rule of the family that fits the words."""

    def of(f):
        (pattern, name), *more = RULES[f]
        return reduce(lambda acc, r: acc.when(words.rlike(ANY_CASE + r[0]), r[1]), more, F.when(words.rlike(ANY_CASE + pattern), name)).otherwise(DEFAULTS[f])

    return reduce(lambda acc, f: acc.when(family == f, of(f)), families[1:], F.when(family == families[0], of(families[0])))


def overlaps(m: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (m["start"] < s["end"]) & (m["end"] > s["start"]))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def number(raw: Column) -> Column:
    return F.replace(F.regexp_extract(raw, NUMBER, 0), F.lit(","), F.lit("")).try_cast("decimal(28,6)")


def money_value(raw: Column) -> Column:
    unit = F.lower(F.regexp_replace(raw, r"(?U)\s", ""))
    factor = reduce(lambda acc, kv: acc.when(unit.contains(kv[0]), kv[1]), list(SCALES.items())[1:], F.when(unit.contains("억원"), SCALES["억원"])).otherwise(1)
    return number(raw) * factor


def percent_value(raw: Column) -> Column:
    return number(raw) / 100


def months_value(raw: Column) -> Column:
    return number(raw) * F.when(raw.rlike(ANY_CASE + YEARS), 12).otherwise(1)


def date_value(raw: Column) -> Column:
    """yyyymmdd, or null where there is no such day."""
    named = F.array_position(F.array(*(F.lit(m[:3]) for m in MONTH_NAMES)), F.lower(F.regexp_extract(raw, "[A-Za-z]{3}", 0))).cast("string")
    parts = bound(F.regexp_extract_all(raw, F.lit("[0-9]+"), F.lit(0)), lambda n: F.when(F.size(n) == 2, F.array(F.get(n, F.lit(1)), named, F.get(n, F.lit(0)))).otherwise(n))
    padded = bound(parts, lambda x: F.concat_ws("-", F.get(x, F.lit(0)), F.lpad(F.get(x, F.lit(1)), 2, "0"), F.lpad(F.get(x, F.lit(2)), 2, "0")))
    return F.date_format(F.try_to_date(padded, "yyyy-MM-dd"), "yyyyMMdd").cast("decimal(38,6)")


def is_months(m: Column) -> Column:
    return m["value"].rlike(ANY_CASE + f"{MONTHS}|{YEARS}")


def _needed(units) -> list[str]:
    """Families to scan for, in the order of SCANS; open phrases are masked by all terms."""
    wanted = {f for u in units for f in GIVES[u]}
    wanted |= set(SCANS) if "open_phrase" in wanted else set()
    wanted |= {m for f in wanted for m in MASKS.get(f, ())}
    wanted |= {m for f in wanted for m in MASKS.get(f, ())}
    return [f for f in SCANS if f in wanted]


def extract_terms(clauses: DataFrame, keys: list[str], confidence: Column | None = None, units=tuple(GIVES)) -> DataFrame:
    """A row for each term of each clause (keys, text), in the order of start and end:
    position, feature_id, value_raw, unit, value_norm (null if open-ended), is_open_ended and
    extraction_confidence.  Null texts have no terms.  With ``units`` only terms of these units
    come, positions being those among them; nothing else is scanned for."""
    t, keep, families = F.col("text"), [*keys, "_conf"], _needed(units)
    rows = clauses.filter("text IS NOT NULL").select(*keys, "text", (confidence if confidence is not None else F.lit(1.0)).alias("_conf"))
    # scans, then places of what was found
    scans = [(f"{family}_{k}", ANY_CASE + p, family) for family in families for k, p in enumerate(SCANS[family])]
    none, no_span = F.array().cast("array<string>"), F.array().cast(_SPAN)
    asks = once(rows, [*keep, "text"], digits=t.rlike("[0-9]"))
    asks = once(asks, [*keep, "text"], **{f"has_{f}": F.col("digits") & t.rlike(ANY_CASE + HINTS[f]) if f in HINTS else (F.lit(True) if f == "open_phrase" else F.col("digits")) for f in families})
    rows = once(asks, [*keep, "text"], **{n: F.when(F.col(f"has_{f}"), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none) for n, p, f in scans})
    placed = {f: F.concat(*(F.when(F.size(n) > 0, match_spans(t, p, F.col(n))).otherwise(no_span) for n, p, g in scans if g == f)) for f in families}
    rows = once(rows, [*keep, "text"], **placed)

    def free(family: str) -> Column:
        masks = [m for m in MASKS[family] if m in families]
        return F.filter(family, lambda m: ~reduce(lambda a, b: a | b, (overlaps(m, F.col(x)) for x in masks))) if masks else F.col(family)

    # masks are masked themselves before they mask others
    for step in (("month_alone",), ("time_range",), ("money", "percent", "time")):
        if some := [f for f in step if f in families]:
            rows = once(rows, [*keep, "text", *(f for f in families if f not in some)], **{f: free(f) for f in some})

    def matches(spans, family, source):
        return F.transform(
            spans, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(source).alias("source"), family(m).alias("family"), m["value"].alias("value"), near(t, m, NEAR_FEATURE).alias("words"), near(t, m, NEAR_OPEN).alias("close"))
        )

    months = lambda m: F.when(is_months(m), "months").otherwise("days")
    kinds = {"date": "date", "month_alone": "date", "money_range": "money", "money": "money", "percent_range": "percent", "percent": "percent"}
    valued = [f for f in families if f != "open_phrase"]
    found = [matches(F.col(f), (lambda m, f=f: F.lit(kinds[f])) if f in kinds else months, f) for f in valued]
    if "open_phrase" in families:
        found.append(matches(F.filter("open_phrase", lambda m: ~reduce(lambda a, b: a | b, (overlaps(m, F.col(x)) for x in valued))), lambda m: F.lit("phrase"), "open_phrase"))
    rows = once(rows, keep, found=F.array_sort(F.filter(F.concat(*found), lambda m: m["family"].isin(*(f for f, u in (*UNITS.items(), ("phrase", UNITS["date"])) if u in units)))))
    rows = rows.select(*keep, F.posexplode("found").alias("position", "m")).select(*keep, "position", "m.*")

    # a row for each match
    v, family, source = F.col("value"), F.col("family"), F.col("source")
    given = ~source.isin("month_alone", "money_range", "percent_range", "time_range", "open_phrase")
    values = {"money": money_value, "percent": percent_value, "days": number, "months": months_value, "date": date_value}
    kept = [f for f, u in UNITS.items() if u in units]
    value = reduce(lambda acc, f: acc.when(given & (family == f), values[f](v).cast("decimal(38,6)")), kept[1:], F.when(given & (family == kept[0]), values[kept[0]](v).cast("decimal(38,6)")))
    rows = once(rows, [*keep, "position", "start", "end", "source", "family", "value", "words", "close"], norm=value)
    norm = F.col("norm")
    vague = norm.isNull() | ((family != "date") & F.col("close").rlike(ANY_CASE + OPEN_ENDED)) | ((family == "percent") & ~norm.between(0, 1))
    named = feature(F.col("words"), family, kept)
    rows = once(rows, [*keep, "position", "start", "end", "source", "family", "value", "norm"], feature_id=F.coalesce(named, F.lit("OPEN_ENDED_NUMERIC_TERMS")), vague=F.coalesce(vague, F.lit(True)))
    vague = F.col("vague")
    scale = F.when(source == "open_phrase", PHRASE).when((source == "date") & vague, BAD_DATE).when(vague, UNSURE).otherwise(SURE)
    unit = reduce(lambda acc, kv: acc.when(family == kv[0], kv[1]), list(UNITS.items())[1:], F.when(family == "money", UNITS["money"])).otherwise(UNITS["date"])
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_conf") * scale))
    return rows.select(
        *keys, "position", "start", "end", "feature_id", F.trim("value").alias("value_raw"), unit.alias("unit"), F.when(~vague, norm).alias("value_norm"), vague.alias("is_open_ended"), F.round(sure, 6).alias("extraction_confidence")
    )


def exact_matches(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Of (kind, key) rows: multiset matches, counts and accuracy matches / max(gold,
    predicted) for each kind."""
    g = gold.groupBy("kind", "key").agg(F.count("*").alias("g"))
    p = predicted.groupBy("kind", "key").agg(F.count("*").alias("p"))
    both = g.join(p, ["kind", "key"], "full_outer").fillna(0, ["g", "p"])
    sums = both.groupBy("kind").agg(F.sum("g").alias("gold"), F.sum("p").alias("predicted"), F.sum(F.least("g", "p")).alias("matched"))
    return sums.withColumn("accuracy", F.round(F.col("matched") / F.greatest("gold", "predicted"), 6))
