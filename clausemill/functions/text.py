"""Text functions as Column builders; all run in the JVM but error rates, which go through Arrow."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dims import EMBEDDING_WORDS, TIER_ORDER

TOKEN = "[a-z0-9]+|[가-힣]+"


def grams(token: Column, n: int) -> Column:
    """The n-grams of a string; none if it is shorter."""
    count = F.length(token) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(token, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Lower-cased ASCII words and Hangul runs in order; a run is followed by its 2- and
    3-grams, so a word of two syllables occurs twice.  Null gives no token.  Words are looked
    through for Hangul only if the text has some."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    wide = lambda w: F.when(w.rlike("^[가-힣]"), F.concat(F.array(w), grams(w, 2), grams(w, 3))).otherwise(F.array(w))
    return F.when(text.rlike("[가-힣]"), F.flatten(F.transform(words, wide))).otherwise(words)


def once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and new columns, as the output of a generator: each is evaluated there once,
    however often later steps refer to it."""
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


_MARK = "\x01"


def match_spans(text: Column, pattern: str, found: Column) -> Column:
    """Of the matches ``found`` of a pattern, struct(start, end, value) each, offsets from 0.
    Gaps and matches are zipped and their lengths summed up.  ``pattern`` must not match the
    empty string.  Matches are replaced by a mark to split at, unless a text holds it: ``split`` compiles
    its pattern for each text, but for a single character, and ``regexp_replace`` once."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["g"])
        end = begin + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("value")))).alias("out"))

    gaps = F.when(F.contains(text, F.lit(_MARK)), F.split(text, pattern, -1)).otherwise(F.split(F.regexp_replace(text, pattern, _MARK), _MARK, -1))
    # one gap more than matches; the last pair has no match
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    pairs = F.filter(pairs, lambda x: x["m"].isNotNull())
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, step)["out"]).otherwise(start["out"])


def find_all(text: Column, pattern: str) -> Column:
    """Every match of a pattern as struct(start, end, value)."""
    return match_spans(text, pattern, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def any_match(text: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns), F.lit(False))


def hit_count(text: Column, patterns) -> Column:
    return reduce(lambda a, b: a + b, (text.rlike(p).cast("int") for p in patterns), F.lit(0))


def clause_text(*parts: Column) -> Column:
    """Parts that aren't blank, as they are, joined by line feeds."""
    return F.concat_ws("\n", *(F.when(F.trim(p) != "", p) for p in parts))


def language_tag(text: Column) -> Column:
    ko, en = text.rlike("[가-힣]"), text.rlike("[A-Za-z]")
    return F.when(ko & en, "mixed").when(ko, "ko").when(en, "en").otherwise("num")


def split_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[;,|]"), lambda x: F.trim(x)), lambda x: x != "")


def lenient_bool(text: Column) -> Column:
    t = F.lower(F.trim(text))
    bad = F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean")
    return F.when(t.isin("true", "1", "yes", "y"), True).when(t.isin("false", "0", "no", "n", ""), False).when(t.isNotNull(), bad)


def source_tier(source_ids: Column) -> Column:
    """Tier of a list of ids like ``B-12``: the one prefix, or the sorted prefixes joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(source_ids, lambda s: F.substring_index(s, "-", 1)))), "/")


def hierarchy(tier: Column, source_ids: Column, categories: Column, chunk_id: Column) -> Column:
    return F.array(F.concat(F.lit("tier:"), tier), F.concat(F.lit("source:"), F.array_join(source_ids, "|")), F.concat(F.lit("risk:"), F.array_join(categories, "|")), F.concat(F.lit("chunk:"), chunk_id))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def snippet(text: Column, n: int = 80) -> Column:
    t = squeeze(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("…"))).otherwise(t)


def slug(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and twelve hex digits; a null part reads ``None``."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(joined, 256), 1, 12))


def _ids(*sequences) -> list[np.ndarray]:
    """Numbers for the members of sequences, equal ones for equal members."""
    ids: dict = {}
    return [np.fromiter((ids.setdefault(x, len(ids)) for x in xs), np.int64, len(xs)) for xs in sequences]


def _edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Levenshtein distance of two arrays of ids.  What both begin and end with is cut off.  As many
    edits are needed as one side has members that the other lacks, and as many do as places differ;
    where these agree, they are the distance.  All else goes through the table by Myers' bit
    vectors, a column being one whole number, so memory grows with the length alone."""
    most = min(len(a), len(b))
    differ = np.flatnonzero(a[:most] != b[:most])
    head = int(differ[0]) if len(differ) else most
    a, b = a[head:], b[head:]
    most = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - most :][::-1] != b[len(b) - most :][::-1])
    tail = int(differ[0]) if len(differ) else most
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return max(len(a), len(b))
    if len(a) > len(b):
        a, b = b, a
    n = max(int(a.max()), int(b.max())) + 1
    surplus = np.bincount(b, minlength=n) - np.bincount(a, minlength=n)
    enough = len(b) - len(a) + int(np.count_nonzero(a != b[: len(a)]))
    if int(surplus[surplus > 0].sum()) == enough:
        return enough
    return _by_bits(a, b)


def _by_bits(a: np.ndarray, b: np.ndarray) -> int:
    """Myers' columns.  Places of a member in ``a`` are kept as bits if there are many, so that all
    of these take no more than len(a) / 512 times the length, and as a list otherwise."""
    m, order = len(a), np.argsort(a, kind="stable")
    members, begin = np.unique(a[order], return_index=True)
    where = dict(zip(members.tolist(), np.split(order, begin[1:])))

    def bits(at) -> int:
        marks = np.zeros(m, bool) if len(at) > 64 else bytearray(m // 8 + 1)
        if len(at) > 64:
            marks[at] = True
            return int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")
        for k in at.tolist():
            marks[k >> 3] |= 1 << (k & 7)
        return int.from_bytes(marks, "little")

    places = {x: bits(at) for x, at in where.items() if len(at) > 64}
    full, up, down, score = (1 << m) - 1, (1 << m) - 1, 0, m
    for x in b.tolist():
        at = (places[x] if x in places else bits(where[x]) if x in where else 0) | down
        same = (((at & up) + up) ^ up) | at
        rise, fall = down | (full & ~(same | up)), same & up
        score += ((rise >> (m - 1)) & 1) - ((fall >> (m - 1)) & 1)
        rise = ((rise << 1) | 1) & full
        up, down = ((fall << 1) | (full & ~(same | rise))) & full, rise & same
    return score


@F.pandas_udf(T.DoubleType())
def _char_error_rate(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(reference, hypothesis):
        if a is None or b is None:
            out.append(None)
            continue
        # code points, as Spark counts characters
        both = np.unique(np.frombuffer((a + b).encode("utf-32-le"), np.uint32), return_inverse=True)[1]
        x, y = both[: len(a)], both[len(a) :]
        out.append(_edit_distance(x, y) / len(a) if a else float(len(b) > 0))
    return pd.Series(out, dtype="float64")


def char_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of characters over the number of reference characters, white space squeezed; of
    an empty reference 0 or 1.  Null if one is null."""
    return _char_error_rate(squeeze(reference), squeeze(hypothesis))


@F.pandas_udf(T.DoubleType())
def word_error_rate(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Edit distance of words over the number of reference words; of an empty reference 0 or 1.
    Null if one is null."""
    out = []
    for a, b in zip(reference, hypothesis):
        if a is None or b is None:
            out.append(None)
            continue
        a, b = a.split(), b.split()
        x, y = _ids(a, b)
        out.append(_edit_distance(x, y) / len(a) if a else float(len(b) > 0))
    return pd.Series(out, dtype="float64")


def jaccard(a: Column, b: Column, empty: float | None = None) -> Column:
    """Overlap of two arrays as sets; of two empty ones ``empty`` or 0."""
    size = F.size(F.array_union(a, b))
    value = F.size(F.array_intersect(a, b)) / F.greatest(size, F.lit(1))
    return value if empty is None else F.when(size == 0, F.lit(empty)).otherwise(value)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def keyword_embedding(text: Column, words=EMBEDDING_WORDS) -> Column:
    """Counts of the words over their sum (at least 1), to 6 places."""
    t = F.lower(text)
    counts = F.array(*(((F.length(t) - F.length(F.replace(t, F.lit(w)))) / len(w)).cast("double") for w in words))
    total = F.greatest(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x), F.lit(1.0))
    return F.transform(counts, lambda x: F.round(x / total, 6))


def tier_order(tier: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(tier == kv[0], kv[1]), list(TIER_ORDER.items())[1:], F.when(tier == "A0", 0)).otherwise(99)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x)), lambda s: s != "")


def distinct_sentences(rows: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """(key, text): of sentences that differ in white space and end marks alone the first is
    kept, and of these the first ``limit``."""
    parts = rows.select(key, F.posexplode(sentences(F.col("text"))).alias("i", "x"))
    same = F.regexp_replace("x", r"[\s.!?]", "")
    kept = parts.groupBy(key, same.alias("_k")).agg(F.min(F.struct("i", "x")).alias("s"))
    ordered = F.array_sort(F.collect_list("s"))
    ordered = F.slice(ordered, 1, limit) if limit else ordered
    return kept.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["x"]), " ").alias("text"))


def mask_personal(text: Column) -> Column:
    """Mail addresses, IPv4 addresses and long digit runs become marks."""
    t = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[mail]")
    t = F.regexp_replace(t, r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[ip]")
    return F.regexp_replace(t, r"[0-9]{7,}", "[number]")


def source_year(*values: Column) -> Column:
    """The first year 19xx or 20xx in the values, in their order."""
    return F.coalesce(*(F.regexp_extract(v, r"((?:19|20)[0-9]{2})", 1).try_cast("int") for v in values))


#: Openers that models put before an answer, and how often they are looked for.
PREAMBLES = (
    r"^\s*창작자님[\s,，.]*",
    r"^\s*(?:창작자님?의?\s*)?질문에\s*대(?:한|해)\s*답(?:변|하)[^\n]*?다음과\s*같습니다\s*[:：.]*\s*",
    r"^\s*답변은\s*다음과\s*같습니다\s*[:：.]*\s*",
    r"^\s*(?:아래|다음)(?:와|과)?\s*같(?:이|습니다)\s*[:：.]*\s*",
    r"^\s*답변\s*[:：]\s*",
    r"^\s*[^.!?\n]{0,40}?에\s*대해\s*(?:물어보세요|문의하세요|여쭤보세요)[.!]?\s*",
    r"(?i)^\s*(?:Here(?:'s| is)|The answer(?: to your question)? is)[^:.\n]*[:.]\s*",
)
PASSES = 4


def without_preamble(text: Column) -> Column:
    """The text without openers, each pass taking one of each kind from its start; trimmed.  A pass
    that changes nothing is followed by such alone, so the passes are a fixpoint with a bound.  A
    text of nothing but openers stays, trimmed; null is empty."""
    whole = F.coalesce(text, F.lit(""))
    out = F.regexp_replace(whole, r"(?U)^\s+", "")
    for _ in range(PASSES):
        out = reduce(lambda t, p: F.regexp_replace(F.regexp_replace(t, "(?U)" + p, ""), r"(?U)^\s+", ""), PREAMBLES, out)
    trimmed = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    # most texts have no opener, and need none of the passes
    opened = reduce(lambda a, b: a | b, (whole.rlike("(?U)" + p) for p in PREAMBLES))
    return F.when(opened, F.coalesce(F.nullif(trimmed(out), F.lit("")), trimmed(whole))).otherwise(trimmed(whole))
