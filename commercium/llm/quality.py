"""Rules for text quality: a table of thresholds compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Very common words of the languages served, as plain text.
STOP_WORDS = (
    "the of and to in that is it for with as was on be at by this are or from an not have has "
    "le la les de des du et en un une que qui dans pour est sur au par avec pas ne "
    "der die das und den von zu mit ist im dem auf eine ein nicht sich des für als auch "
    "el los las y por con del se para una su al lo como más no"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text if ``low`` * under <= 1000 * over <= ``high`` * under; None leaves a side open."""

    name: str
    over: str
    under: str
    low: int | None = None
    high: int | None = None


#: Thresholds in thousandths, compared in whole numbers, so that every engine agrees.
RULES = (
    Rule("word length", "word_chars", "n_words", 2000, 15000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("stop words", "n_stop_words", "n_words", 10, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 300),
)

_SPLIT = r"[ \t\n\x0B\f\r]+"
_BLANK = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id with the counts the rules use. NULL and empty texts count 0 everywhere.

    ``n_repeat_words`` counts the words inside three-word windows that occur twice
    or more in their text, found by sorting the hashed windows of each text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        F.col("doc_id"),
        F.filter(F.split(text, _SPLIT), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")).alias("lines"),
        F.length(_without(text, _BLANK)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, _SYMBOLS))).cast("long").alias("n_symbols"),
    )
    n = F.greatest(F.size("words") - 2, F.lit(0))
    windows = F.arrays_zip(*[F.slice("words", k, n).alias(f"w{k}") for k in (1, 2, 3)])
    stops = F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS)))
    hashed = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        stops.cast("long").alias("n_stop_words"),
        F.transform(windows, lambda w: F.xxhash64(w)).alias("hashes"),
    )
    # Only texts with a repeated window are sorted.
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    sorted_windows = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    ranked = hashed.select("*", F.when(repeats, sorted_windows).otherwise(none).alias("ranked")).drop("hashes")
    pairs = F.arrays_zip(
        F.slice("ranked", 1, F.greatest(F.size("ranked") - 1, F.lit(0))).alias("a"),
        F.slice("ranked", 2, F.greatest(F.size("ranked") - 1, F.lit(0))).alias("b"),
    )
    equal = F.filter(pairs, lambda p: p["a"]["h"] == p["b"]["h"])
    places = F.flatten(F.transform(equal, lambda p: F.array(p["a"]["i"], p["b"]["i"])))
    covered = F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))
    return ranked.select(
        *[c for c in ranked.columns if c != "ranked"],
        F.size(F.array_distinct(covered)).cast("long").alias("n_repeat_words"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The rules as one boolean expression over measured columns."""
    keep = F.lit(True)
    for rule in rules:
        over, under = F.col(rule.over) * 1000, F.col(rule.under)
        if rule.low is not None:
            keep = keep & (over >= under * rule.low)
        if rule.high is not None:
            keep = keep & (over <= under * rule.high)
    return keep


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, ``base_failed`` and ``kept``.

    A text of fewer than 50 words, or with over half of its words in repeated
    windows, fails; so NULL, empty and blank texts do. Repeated rows are judged
    alike. Further columns of ``docs`` are ignored. An empty table gives no rows.
    """
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return measure(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_stop_words",
        "n_lines",
        failed.alias("base_failed"),
        (~failed & verdict(rules)).alias("kept"),
    )


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same result as SQL."""
    tests = []
    for rule in rules:
        if rule.low is not None:
            tests.append(f"{rule.over} * 1000 >= {rule.under} * {rule.low}")
        if rule.high is not None:
            tests.append(f"{rule.over} * 1000 <= {rule.under} * {rule.high}")
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
split as (
  select doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from texts),
placed as (
  select doc_id, unnest(words) as w, generate_subscripts(words, 1) as i from split),
grams as (
  select doc_id, i, w || ' ' || lead(w, 1) over t || ' ' || lead(w, 2) over t as g
  from placed window t as (partition by doc_id order by i)),
again as (
  select doc_id, i, g is not null and count(*) over (partition by doc_id, g) > 1 as twice from grams),
covered as (
  select doc_id, twice or coalesce(lag(twice, 1) over t, false) or coalesce(lag(twice, 2) over t, false) as c
  from again window t as (partition by doc_id order by i)),
repeated as (select doc_id, count(*) filter (where c) as n from covered group by doc_id),
counts as (
  select s.doc_id, len(words)::bigint as n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(r.n, 0)::bigint as n_repeat_words,
    len(list_filter(words, lambda w: lower(w) in ({stops})))::bigint as n_stop_words,
    len(lines)::bigint as n_lines
  from split s left join repeated r on s.doc_id = r.doc_id),
judged as (
  select *, n_words < 50 or n_repeat_words * 100 > n_words * 50 as base_failed from counts)
select *, not base_failed and {" and ".join(tests)} as kept from judged
"""
