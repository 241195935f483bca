"""Personal data in texts, and the other words of a text that give it away.

E-mail addresses, IP addresses, card and phone numbers are found by pattern. Each different one is an entity to protect.
A word reveals an entity as far as knowing the word makes the entity less surprising: by

    log2(n(entity, word) * n / (n(entity) * n(word))) / log2(n / n(entity))

where n counts documents: 1 if the word never comes without the entity, 0 if the two have nothing to do with each other.
Words that reach `threshold` for an entity of their text, seen together in `least_texts` different texts or more, are
generalised to their first `prefix` letters if those stay below the threshold, and else removed. Counts are over all
documents. Copies of a text count as documents, but they are no second witness. An entity that occurs in fewer
different texts than that has no statistics; it is found and hidden, and reveals nothing about words.

Entities that occur in the very same texts (an address and a number of one person, say) are one entity: their counts are
the same with every word, so a list of a thousand addresses costs its words once. Texts that hold personal data are kept
once per different text; what is found in them goes back to the documents by digest.

All of it is built of Spark's own functions. Positions follow from the pieces between matches: their lengths are added
up in blocks, so a text with many matches takes no quadratic time, and patterns do not go back over what they have read.

Spans are code points, end exclusive. Spans of one kind do not overlap; those of two kinds may. Words are runs of letters,
marks and digits, three or more, compared in lower case, outside the personal data. Null and empty texts have no spans and
no words. Repeated rows and null ids are documents of their own. An empty table gives an empty one. Texts are read whole.
In `clean_text` the control characters 1 to 4 become blanks. Other columns are kept; those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import once
from .shared import written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
RESULTS = (*(f"n_{kind}" for kind in KINDS), "n_generalised", "n_removed", "base_spans", "spans", "clean_text")

# The stated patterns, written so that a failing start is not tried again inside the same run of characters.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WORD = r"[\p{L}\p{M}\p{N}]++"
_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"
_SHORTEST = 3
_CUT = "…"  # ends a generalised word; no letter, so no word has it
_SPAN = "array<struct<start:int,end:int,at:int,value:string>>"
_MARKS = "\x01\x02\x03\x04"  # one a kind, in place of each character of a span


def _may_hold(kind: str, body: Column) -> Column:
    """A quick test that is true for every text with a match that counts."""
    return {
        "email": body.contains("@"),
        "ip": body.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        "card": body.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
        "phone": body.contains("+"),
    }[kind]


def _luhn(digits: Column) -> Column:
    padded = F.lpad(digits, 19, "0")
    # From the right every second digit is doubled, and the digits of the double are added.
    twice = F.translate(padded, "0123456789", "0246813579")
    at = F.sequence(F.lit(1), F.lit(19))
    total = F.aggregate(
        at, F.lit(0), lambda sum_, k: sum_ + F.substring(F.when(k % 2 == 0, twice).otherwise(padded), k, F.lit(1)).cast("int")
    )
    return total % 10 == 0


def _counts(kind: str, value: Column) -> Column:
    """Whether a match of a kind's pattern is personal data."""
    if kind == "ip":
        return value.rlike(_OCTETS)
    if kind == "card":
        return once(F.translate(value, " -", ""), lambda digits: F.length(digits).between(16, 19) & _luhn(digits))
    if kind == "phone":
        return F.length(F.translate(value, "+ ().-", "")).between(8, 15)
    return F.lit(True)


def running_sums(widths: Column, use: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """use(before), where before(i) is the sum of the first i widths: whole blocks of them, then the rest one by one."""
    add = lambda items: F.aggregate(items, F.lit(0), lambda total, x: total + x)
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(widths))).cast("int"))

    def with_blocks(block: Column) -> Column:
        sums = F.transform(
            F.sequence(F.lit(0), F.floor(F.size(widths) / block).cast("int")),
            lambda b: add(F.slice(widths, b * block + 1, block)),
        )
        starts = once(sums, lambda found: F.transform(found, lambda _, b: add(F.slice(found, F.lit(1), b))))

        def before(at: Callable[[Column], Column]) -> Column:
            return once(
                starts,
                lambda first: at(
                    lambda i: F.get(first, F.floor(i / block).cast("int"))
                    + add(F.slice(widths, F.floor(i / block).cast("int") * block + 1, i % block))
                ),
            )

        return before(use)

    return once(size, with_blocks)


def _placed(gaps: Column, found: Column, wanted: Column) -> Column:
    """Spans of the wanted of all matches (index and value), in characters, and `at` in bytes."""
    widths = lambda length: F.transform(found, lambda value, i: length(value) + length(F.get(gaps, i)))

    def spans(chars: Callable[[Column], Column], size: Callable[[Column], Column]) -> Column:
        def span(match: Column) -> Column:
            gap = F.get(gaps, match["i"])
            start = chars(match["i"]) + F.length(gap)
            return F.struct(
                start.alias("start"),
                (start + F.length(match["value"])).alias("end"),
                (size(match["i"]) + F.octet_length(gap)).alias("at"),
                match["value"].alias("value"),
            )

        return F.transform(wanted, span)

    return once(
        widths(F.length),
        lambda by_char: once(
            widths(F.octet_length),
            lambda by_byte: running_sums(by_char, lambda c: running_sums(by_byte, lambda b: spans(c, b))),
        ),
    )


def located(body: Column, pattern: str, wanted: Callable[[Column], Column]) -> Column:
    """Spans of the matches for which `wanted` holds."""
    pieces = F.struct(
        F.split(body, pattern, -1).alias("gaps"), F.regexp_extract_all(body, F.lit(pattern), F.lit(0)).alias("found")
    )

    def place(cut: Column) -> Column:
        indexed = F.transform(cut["found"], lambda value, i: F.struct(i.alias("i"), value.alias("value")))
        chosen = F.filter(indexed, lambda match: wanted(match["value"]))
        return once(chosen, lambda kept: F.when(F.size(kept) > 0, _placed(cut["gaps"], cut["found"], kept)))

    return F.coalesce(once(pieces, place).cast(_SPAN), F.array().cast(_SPAN))


def base_spans(body: Column) -> Column:
    """A struct with the spans of each kind."""
    none = F.array().cast(_SPAN)
    found = {
        kind: F.when(_may_hold(kind, body), located(body, _PATTERNS[kind], lambda value, k=kind: _counts(k, value)))
        for kind in KINDS
    }
    return F.struct(*[F.coalesce(found[kind], none).alias(kind) for kind in KINDS])


def _all_spans(base: Column) -> Column:
    return F.concat(*[base[kind] for kind in KINDS])


def entities(base: Column) -> Column:
    """The different entities of a text: kind and value, the value without what does not tell two apart."""
    shapes = {
        "email": F.lower,
        "ip": lambda value: value,
        "card": lambda value: F.translate(value, " -", ""),
        "phone": lambda value: F.translate(value, "+ ().-", ""),
    }

    def named(kind: str) -> Column:
        return F.transform(base[kind], lambda span: F.concat(F.lit(f"{kind}:"), shapes[kind](span["value"])))

    return F.array_distinct(F.concat(*[named(kind) for kind in KINDS]))


def words(body: Column) -> Column:
    """The different words of a text."""
    found = F.regexp_extract_all(F.lower(body), F.lit(_WORD), F.lit(0))
    return F.array_distinct(F.filter(found, lambda word: F.length(word) >= _SHORTEST))


def general(word: Column, prefix: int) -> Column:
    """What a word is generalised to; null for one that is no longer than that."""
    return F.when(F.length(word) > prefix, F.concat(F.substring(word, 1, prefix), F.lit(_CUT)))


def terms(body: Column, prefix: int) -> Column:
    """The different words of a text and what they generalise to."""
    cut = lambda found: F.array_distinct(F.array_compact(F.transform(found, lambda w: general(w, prefix))))
    return once(words(body), lambda found: F.concat(found, cut(found)))


def protected_texts(bodies: DataFrame) -> DataFrame:
    """The different texts of `body` that hold personal data: digest, copies, body, base and entities."""
    # Spans go through a generator: Spark would work them out again for a filter that it moves below a projection.
    marked = bodies.select("body", F.inline(F.array(F.struct(base_spans(F.col("body")).alias("base")))))
    held = marked.where(F.size(_all_spans(F.col("base"))) > 0)
    return (
        held.groupBy(F.sha2("body", 256).alias("digest"))
        .agg(F.count(F.lit(1)).alias("copies"), F.first(F.struct("body", "base")).alias("text"))
        .select("digest", "copies", "text.body", "text.base", entities(F.col("text.base")).alias("entities"))
    )


def entity_classes(texts: DataFrame, least_texts: int) -> DataFrame:
    """The entities of each text (digest) that occur in enough different texts. `a` and `b` name those that occur in the
    same ones: 128 bits over the set of their digests."""
    held = texts.select("digest", "copies", F.explode("entities").alias("entity"))
    # Digests are uniform, so parts of them do for the two halves.
    part = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    known = (
        held.groupBy("entity")
        .agg(
            F.count(F.lit(1)).alias("n_texts"),
            F.sum("copies").alias("n_entity"),
            F.bit_xor(part(1)).alias("a"),
            F.bit_xor(part(17)).alias("b"),
        )
        .where(F.col("n_texts") >= least_texts)
        .drop("n_texts")
    )
    return held.select("digest", "entity").join(known, "entity").select("digest", "a", "b", "n_entity").distinct()


def disclosing_terms(
    texts: DataFrame, classes: DataFrame, bodies: DataFrame, n: int, threshold: float, least_texts: int, prefix: int
) -> DataFrame:
    """Terms that reveal an entity (a, b) to `threshold` or more."""
    held = classes.join(texts.select("digest", "copies", "body"), "digest")
    together = (
        held.select("a", "b", "n_entity", "copies", F.explode(terms(F.col("body"), prefix)).alias("term"))
        .groupBy("a", "b", "n_entity", "term")
        .agg(F.sum("copies").alias("n_both"), F.count(F.lit(1)).alias("n_texts"))
        .where(F.col("n_texts") >= least_texts)
    )
    often = bodies.select(F.explode(terms(F.col("body"), prefix)).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n_term")
    )
    whole = F.lit(float(n))
    shared = F.log2(F.col("n_both") * whole / (F.col("n_entity").cast("double") * F.col("n_term")))
    strength = shared / F.log2(whole / F.col("n_entity"))
    return (
        together.where(F.col("n_entity") < n)
        .join(often, "term")
        .where(strength >= threshold)
        .select("a", "b", "term", strength.alias("strength"))
    )


def replacements(disclosing: DataFrame, prefix: int) -> DataFrame:
    """For each revealing word what stands in its place: its general form, or nothing if that reveals too much too."""
    is_word = ~F.col("term").endswith(_CUT)
    revealing = disclosing.where(~is_word).select("a", "b", F.col("term").alias("form"), F.lit("").alias("instead"))
    found = disclosing.where(is_word).withColumn("form", general(F.col("term"), prefix))
    return found.join(revealing, ["a", "b", "form"], "left").select(
        "a", "b", "term", F.coalesce("instead", "form", F.lit("")).alias("instead")
    )


def _masked(body: Column, base: Column) -> Column:
    """The text with every character of a span replaced by its kind's mark: as long, in characters and in bytes."""
    text = F.translate(body, _MARKS, " " * len(_MARKS))
    for mark, kind in zip(_MARKS, KINDS):
        text = _masked_kind(text, base[kind], mark)
    return text


def _masked_kind(text: Column, spans: Column, mark: str) -> Column:
    width = lambda span: span["end"] - span["start"]

    def cut(raw: Column) -> Column:
        def piece(span: Column, i: Column) -> Column:
            before = F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["at"] + width(F.get(spans, i - 1)))
            between = F.substring(raw, before + 1, span["at"] - before).cast("string")
            return F.concat(between, F.repeat(F.lit(mark), width(span)))

        last = F.get(spans, F.size(spans) - 1)
        rest = F.substring(raw, last["at"] + width(last) + 1, F.octet_length(raw)).cast("string")
        return F.concat(F.array_join(F.transform(spans, piece), ""), rest)

    return F.when(F.size(spans) == 0, text).otherwise(once(text.cast("binary"), cut))


def _cleaned(masked: Column, instead: Column) -> Column:
    """The masked text with words replaced and spans named by their kind."""
    pieces = F.struct(
        F.split(masked, _WORD, -1).alias("gaps"), F.regexp_extract_all(masked, F.lit(_WORD), F.lit(0)).alias("found")
    )
    shown = lambda word: F.coalesce(F.element_at(instead, F.lower(word)), word)
    text = once(
        pieces,
        lambda cut: F.concat(
            F.array_join(F.transform(cut["found"], lambda w, i: F.concat(F.get(cut["gaps"], i), shown(w))), ""),
            F.element_at(cut["gaps"], -1),
        ),
    )
    text = F.when(F.size(instead) == 0, masked).otherwise(text)
    for mark, kind in zip(_MARKS, KINDS):
        text = F.regexp_replace(text, f"{mark}+", f"[{kind}]")
    return text


def _shown(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def _described(texts: DataFrame, flagged: DataFrame) -> DataFrame:
    """The results of each different text. `flagged` has the words to replace by digest."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    joined = texts.join(flagged, "digest", "left").withColumn("instead", F.coalesce("instead", none))
    masked = joined.withColumn("masked", _masked(F.col("body"), F.col("base")))
    revealing = lambda word: F.map_contains_key("instead", F.lower(word))
    found = located(F.col("masked"), _WORD, revealing)
    instead = F.transform("revealed", lambda s: F.element_at(F.col("instead"), F.lower(s["value"])))
    base = F.concat(*[_shown(kind, F.col("base")[kind]) for kind in KINDS])
    return (
        masked.withColumn("revealed", F.when(F.size("instead") > 0, found).otherwise(F.array().cast(_SPAN)))
        .withColumn("replaced", instead)
        .select(
            "digest",
            *[F.size(F.col("base")[kind]).cast("long").alias(f"n_{kind}") for kind in KINDS],
            F.size(F.filter("replaced", lambda w: w != "")).cast("long").alias("n_generalised"),
            F.size(F.filter("replaced", lambda w: w == "")).cast("long").alias("n_removed"),
            F.array_join(base, ",").alias("base_spans"),
            F.array_join(F.concat(base, _shown(TERM, F.col("revealed"))), ",").alias("spans"),
            _cleaned(F.col("masked"), F.col("instead")).alias("clean_text"),
        )
    )


def sanitise(
    docs: DataFrame, text: str = "text", threshold: float = 0.9, least_texts: int = 2, prefix: int = 3
) -> DataFrame:
    """`docs` with the number of spans of each kind, words generalised and removed, `base_spans` and `spans` (kind:start:end,
    comma-joined, by kind, then start; words that reveal an entity are of the kind `term`, the last), and `clean_text`."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    bodies = docs.select(body.alias("body"))
    texts = written(protected_texts(bodies), "protected-texts")
    classes = written(entity_classes(texts, least_texts), "entity-classes")
    found = disclosing_terms(texts, classes, bodies, docs.count(), threshold, least_texts, prefix)
    instead = replacements(written(found, "disclosing-terms"), prefix)
    flagged = (
        classes.join(texts.select("digest", "body"), "digest")
        .select("digest", "a", "b", F.explode(words(F.col("body"))).alias("term"))
        .join(instead, ["a", "b", "term"])
        .groupBy("digest", "term")
        .agg(F.min("instead").alias("instead"))
        .groupBy("digest")
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "instead"))).alias("instead"))
    )
    kept = [name for name in docs.columns if name not in RESULTS]
    given = docs.select(*[F.col(f"`{name}`") for name in kept], body.alias("__body"))
    results = _described(texts, flagged).withColumnRenamed("digest", "__digest")
    joined = given.withColumn("__own", F.sha2("__body", 256)).join(results, F.col("__own") == F.col("__digest"), "left")
    counts = [name for name in RESULTS if name.startswith("n_")]
    return joined.select(
        *[F.col(f"`{name}`") for name in kept],
        *[F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in counts],
        *[F.coalesce(name, F.lit("")).alias(name) for name in ("base_spans", "spans")],
        F.coalesce("clean_text", F.translate("__body", _MARKS, " " * len(_MARKS))).alias("clean_text"),
    )
