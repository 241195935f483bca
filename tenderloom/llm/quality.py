"""Quality rules from a table of thresholds, compiled into one projection of built-in expressions.

A rule bounds one ratio (or count) of measures of a text. `score_quality` adds the measures, the names of the rules a
text breaks, and `kept`. Each row is judged on its own, so there is no shuffle and no group.

Words are runs of characters other than blank, tab and line ends. Null and empty texts have no words and break
`n_words`. Ratios with a zero denominator count as 0. The ratio of stop words is asked of texts in Latin letters only (at
least 0.67 characters a byte of UTF-8; other scripts take two bytes or more a letter), and counts words of all listed
languages together. Repeated rows are judged alike; other columns are kept, and
columns that have the name of a result are replaced.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8

# Frequent function words of languages in Latin letters.
STOP_WORDS = {
    "en": "the of and to in a is that it was for on are as with his they at be this from or had by not but what all",
    "fr": "de la le et les des en un une que est pour qui dans a par plus pas au sur ne se ce il sont avec son elle",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin",
    "it": "di che il la per un non sono del con si da una in le dei nel della alla più anche come ma al gli",
    "pt": "de que não do da em um para com uma os no se na por mais as dos como mas ao das foi ou são",
    "nl": "de het een van en in is dat op te zijn met voor niet aan er om ook als dan door bij maar uit",
    "pl": "nie się na jest do że to co jak za od po ale dla przez tym był oraz jego są być tego ich",
    "sv": "och att det som en på är av för med den till inte om ett men var från vid kan när ska har",
    "da": "og det at en den til er som på de med for af ikke der var har om et fra men kan eller ved",
    "fi": "ja on ei se että oli hän mutta ovat kun niin joka myös sen mitä tai vain ole kuin jos siitä",
    "tr": "ve bir bu da de için ile çok gibi daha en olarak olan ne sonra kadar var ama değil her şey",
    "cs": "se na je že to do si ve za jsem ale jako tak po jak od byl aby ze pro která jeho není jen",
    "ro": "și de în la cu nu pe care un din este mai pentru ce au prin sau dar fost fi după această lui",
    "hu": "az és hogy nem is egy ez de ha meg csak volt van mint már vagy még el ki azt amely sem be",
    "id": "yang dan di ini dengan untuk tidak dari dalam itu pada adalah ke akan juga saya kita ada atau bisa",
    "vi": "và của là có cho không được một các trong người với này đã những khi để ra từ như đến",
}


@dataclasses.dataclass(frozen=True)
class Rule:
    """`low` <= top / bottom <= `high`; without `bottom` the bounds hold for `top` itself. With `only` the rule is asked of texts
    whose first measure is that share of the second, or more."""

    name: str
    top: str
    bottom: str | None = None
    low: float | None = None
    high: float | None = None
    only: tuple[str, str, float] | None = None


BASE_RULES = (
    Rule("n_words", "n_words", low=20),
    Rule("repeated_words", "n_repeat_words", "n_words", high=0.3),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2, high=20),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("open_lines", "n_ellipsis_lines", "n_lines", high=0.3),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=0.9),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02, only=("n_chars", "n_bytes", 0.67)),
)
MEASURES = (
    "n_words word_chars n_symbols n_lines n_dup_lines n_ellipsis_lines n_bullet_lines n_stop_words "
    "n_chars n_bytes n_repeat_words"
).split()


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed a single time however often it is used."""
    return F.transform(F.array(value), use)[0]


def window_hashes(words: Column) -> Column:
    """One hash for each window of eight words."""
    return once(
        F.transform(words, lambda word: F.xxhash64(word)),
        lambda hashes: F.transform(
            F.sequence(F.lit(0), F.size(hashes) - WINDOW),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]),
        ),
    )


def words_inside(windows: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more."""
    by_hash = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    alike = lambda row, other: F.coalesce(row["h"] == other["h"], F.lit(False))
    found = once(
        by_hash,
        lambda rows: F.filter(rows, lambda row, k: alike(row, F.get(rows, k - 1)) | alike(row, F.get(rows, k + 1))),
    )
    return F.aggregate(
        F.array_sort(F.transform(found, lambda row: row["i"])),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda seen, i: F.struct(i.alias("last"), (seen["n"] + F.least(F.lit(WINDOW), i - seen["last"])).alias("n")),
        lambda seen: seen["n"],
    )


def measure(docs: DataFrame, text: str, stop_words: Sequence[str]) -> DataFrame:
    """Adds all measures. Arrays that several measures need are columns of their own, so that each is made once and
    the measures are compiled code."""
    count = lambda items, test: F.size(F.filter(items, test))
    words, lines, windows, body = F.col("__words"), F.col("__lines"), F.col("__windows"), F.col("__body")
    docs = (
        docs.withColumn("__body", F.coalesce(F.col(f"`{text}`"), F.lit("")))
        .withColumn("__trimmed", F.btrim(body, F.lit(SPACES)))
        .withColumn(
            "__words",
            F.when(F.col("__trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("__trimmed", SPACE)),
        )
        .withColumn("__lines", F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != ""))
        .withColumn("__windows", F.when(F.size(words) >= WINDOW, window_hashes(words)))
    )
    found = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.length(body) - F.length(F.regexp_replace(body, "[#*$%&|<>]", "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_ellipsis_lines": count(lines, lambda line: line.rlike("(…|[.]{3})[\\x20\\x09-\\x0D]*$")),
        "n_bullet_lines": count(lines, lambda line: line.rlike("^[\\x20\\x09]*[-•*‣◦]\\x20")),
        "n_stop_words": count(words, lambda word: F.lower(word).isin(*stop_words)),
        "n_chars": F.length(body),
        "n_bytes": F.octet_length(body),
        "n_repeat_words": F.when(windows.isNull(), 0)
        .when(F.size(F.array_distinct(windows)) == F.size(windows), 0)
        .otherwise(words_inside(windows)),
    }
    return docs.withColumns({name: found[name].cast("long") for name in MEASURES}).drop(
        "__body", "__trimmed", "__words", "__lines", "__windows"
    )


def broken(rule: Rule) -> Column:
    """Whether the measures break a rule. Products instead of quotients keep whole numbers exact."""
    top = F.col(rule.top).cast("double")
    bottom = F.col(rule.bottom).cast("double") if rule.bottom else F.lit(1.0)
    breaks = F.lit(False)
    if rule.low is not None:
        breaks = breaks | (top * 100 < bottom * round(rule.low * 100, 6))
    if rule.high is not None:
        breaks = breaks | (top * 100 > bottom * round(rule.high * 100, 6))
    if rule.only:
        part, whole, share = rule.only
        breaks = breaks & (F.col(part).cast("double") * 100 >= F.col(whole).cast("double") * round(share * 100, 6))
    return breaks & (bottom > 0)


def score_quality(
    docs: DataFrame,
    text: str = "text",
    rules: Sequence[Rule] = RULES,
    base: Sequence[Rule] = BASE_RULES,
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """Adds the measures, `broken_rules` (comma-joined names), `base_failed` and `kept` to each row."""
    stop_words = sorted(stop_words or {w for words in STOP_WORDS.values() for w in words.split()})
    results = [*MEASURES, "broken_rules", "base_failed", "kept"]
    flat = measure(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in results]), text, stop_words)
    failed = F.concat_ws(",", *[F.when(broken(rule), F.lit(rule.name)) for rule in (*base, *rules)])
    base_failed = F.lit(False)
    for rule in base:
        base_failed = base_failed | broken(rule)
    return (
        flat.withColumn("broken_rules", failed)
        .withColumn("base_failed", base_failed)
        .withColumn("kept", F.col("broken_rules") == "")
    )
