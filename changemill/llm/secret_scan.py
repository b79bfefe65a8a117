"""Secrets in texts: three patterns, and the entropy of windows that slide over candidate strings.

A candidate is a run of 20 or more characters that a token may be made of; signs cut it into parts.
A window of 20 slides over it; its character counts and the sum of c log c over them are carried
along, and a step changes only the counts of the character that leaves and of the one that enters.
The window's own characters (hexadecimal, letters of one case and digits, both cases, signs too) set its
threshold. A candidate with a window that reaches it is a span, unless a form of the allow-list
explains the parts that the window touches (identifiers, dates, words joined by signs,
placeholders); other parts of the candidate do not matter. Base spans are never suppressed.

Everything happens within a row by built-in expressions: no shuffle, whatever the texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changemill.llm.common import fresh, let, starts_of, whole

#: Fixed patterns of the base kinds, in their order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Bits a character that a window must reach, by class of the window. 99 of 100 random windows of hexadecimal digits, of base
#: 32 and 36, of base 62 and 64 do. Signs between letters of one case are rather words than base 64.
HEX_BITS, ONE_CASE_BITS, MIXED_BITS, SIGNS_BITS = 2.9, 3.35, 3.65, 3.9
IDENTIFIER = r"(?<![A-Za-z0-9])[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![A-Za-z0-9])"
#: Forms of a part that suppress the windows that touch it.
PLACEHOLDERS = (r"(?i)example|placeholder|changeme|dummy|redacted", r"(?i)(.)\1{7}|0123456789|abcdefghij")
MASK = "[SECRET]"


def _matches(text: Column, pattern: str, keep) -> Column:
    """Leftmost non-overlapping matches with their code points: what lies between them and what
    they hold add up to their places. ``keep``: condition on the matched string."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<at:bigint,hit:string>>")

    def placed(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        sizes = F.zip_with(between, found, lambda a, b: F.length(a) + F.length(b))
        ends = F.zip_with(starts_of(sizes), between, lambda at, gap: at + F.length(gap))
        return F.zip_with(ends, found, lambda at, hit: F.struct(at.alias("at"), hit.alias("hit")))

    def passing(found: Column, passes: Column) -> Column:
        chosen = F.filter(placed(found), lambda _, i: F.get(passes, i))
        return F.when(F.exists(passes, lambda x: x), chosen).otherwise(none)

    return let(hits, lambda h: let(F.transform(h, keep), lambda passes: passing(h, passes)))


#: Units of a bit in which sums are carried: whole numbers do not drift, however long a candidate is.
_UNIT = 1 << 40


def _over_windows(chars: Column, window: int, zero: Column, see) -> Column:
    """Aggregate over the windows of a candidate's characters: ``see(so_far, sum of c log2 c, start)``.

    The counts of the window's characters are carried along; a step changes that of the character that
    leaves and that of the one that enters.
    """
    terms = F.array(*[F.lit(round(c * math.log2(c) * _UNIT) if c else 0).cast("long") for c in range(window + 2)])
    term = lambda count: F.get(terms, count)

    def slide(codes: Column, alphabet: Column) -> Column:
        first = F.slice(codes, 1, window)
        begin_counts = F.transform(alphabet, lambda _, k: F.size(F.filter(first, lambda x: x == k)))
        n = F.size(codes)
        steps = F.when(n > window, F.sequence(F.lit(window), n - 1)).otherwise(F.array().cast("array<int>"))
        state = lambda total, counts, seen: F.struct(total.alias("sum"), counts.alias("counts"), seen.alias("seen"))

        def step(s: Column, i: Column) -> Column:
            pair = F.struct(F.get(codes, i - window).alias("out"), F.get(codes, i).alias("new"))

            def moved(p: Column) -> Column:
                left, entered = F.get(s["counts"], p["out"]), F.get(s["counts"], p["new"])
                total = s["sum"] - term(left) + term(left - 1) - term(entered) + term(entered + 1)
                counts = F.transform(s["counts"], lambda c, k: c + F.when(k == p["new"], 1).when(k == p["out"], -1).otherwise(0))
                same = p["out"] == p["new"]
                return let(
                    F.when(same, s["sum"]).otherwise(total),
                    lambda v: state(v, F.when(same, s["counts"]).otherwise(counts), see(s["seen"], v, i - window + 1)),
                )

            return let(pair, moved)

        def begin(counts: Column) -> Column:
            total = F.aggregate(counts, F.lit(0).cast("long"), lambda t, c: t + term(c))
            return let(total, lambda t: state(t, counts, see(zero, t, F.lit(0))))

        return F.aggregate(steps, let(begin_counts, begin), step, lambda s: s["seen"])

    def coded(alphabet: Column) -> Column:
        return let(F.transform(chars, lambda c: F.array_position(alphabet, c).cast("int") - 1), lambda codes: slide(codes, alphabet))

    return let(F.array_distinct(chars), coded)


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, "", -1), lambda x: x != "")


def _bits(total: Column, window: int) -> Column:
    return F.lit(math.log2(window)) - total / (window * _UNIT)


def best_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy, in bits a character, of the windows of a candidate."""
    highest = lambda seen, total, at: F.greatest(seen, _bits(total, window))
    return let(_characters(candidate), lambda chars: _over_windows(chars, window, F.lit(0.0), highest))


def _threshold(text: Column) -> Column:
    """Bits that a window must reach; null for one without letters or without digits."""
    has = lambda pattern: text.rlike(pattern)
    bits = (
        F.when(has("^[0-9a-fA-F]+$"), HEX_BITS)
        .when(has("^([a-z0-9]+|[A-Z0-9]+)$"), ONE_CASE_BITS)
        .when(has("[a-z]") & has("[A-Z]"), MIXED_BITS)
        .otherwise(SIGNS_BITS)
    )
    return F.when(has("[0-9]") & has("[A-Za-z]"), bits)


def _parts(candidate: Column) -> Column:
    """A letter for each character of a candidate: s(ign), x (identifier or placeholder), w(ord or
    number), m (letters and digits in one part)."""
    found = F.regexp_extract_all(F.regexp_replace(candidate, IDENTIFIER, "~" * 36), F.lit("[A-Za-z0-9]+|~+|[-_/+=]+"), F.lit(0))

    def letter(part: Column) -> Column:
        explained = part.startswith("~")
        for form in PLACEHOLDERS:
            explained = explained | part.rlike(form)
        kind = F.when(part.rlike("^[-_/+=]"), "s").when(explained, "x").when(part.rlike("^([A-Za-z]+|[0-9]+)$"), "w")
        return F.repeat(kind.otherwise("m"), F.length(part))

    return F.array_join(F.transform(found, letter), "")


def _is_secret(candidate: Column) -> Column:
    def scanned(parts: Column, chars: Column) -> Column:
        def see(seen: Column, total: Column, at: Column) -> Column:
            window = lambda values: F.slice(values, at + 1, F.lit(WINDOW))
            free = let(window(parts), lambda p: F.array_contains(p, "m") & ~F.array_contains(p, "x"))
            # Below the least threshold the characters do not matter.
            near = _bits(total, WINDOW) >= HEX_BITS
            return seen | F.coalesce(near & free & (_bits(total, WINDOW) >= let(F.array_join(window(chars), ""), _threshold)), F.lit(False))

        return _over_windows(chars, WINDOW, F.lit(False), see)

    def held(parts: Column) -> Column:
        scan = let(_characters(parts), lambda p: let(_characters(candidate), lambda c: scanned(p, c)))
        return F.when(parts.contains("m"), scan).otherwise(False)

    return let(_parts(candidate), held)


def spans_of(text: Column) -> Column:
    """Spans of a text by start, then kind: struct of start, kind_no, end (code points, end
    exclusive), kind."""
    span = lambda m, no: F.struct(
        m["at"].alias("start"), F.lit(no).alias("kind_no"), (m["at"] + F.length(m["hit"])).alias("end"), F.lit(KINDS[no]).alias("kind")
    )
    rules = [
        (ASSIGN, lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 6),
        (ACCESS, lambda hit: F.length(hit) >= 20),
        # Runs of 24 and more are the runs of any length that pass, found without the others.
        (HEX.replace("+", "{24,}+"), lambda hit: F.length(hit) >= 24),
    ]
    of_kind = lambda no, found: F.transform(found, lambda m: span(m, no))
    base = F.concat(*[of_kind(no, _matches(text, pattern, keep)) for no, (pattern, keep) in enumerate(rules)])
    more = F.transform(_matches(text, CANDIDATE, _is_secret), lambda m: span(m, 3))

    def joined(found: Column) -> Column:
        new = F.filter(more, lambda s: ~F.exists(found, lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
        return F.array_sort(F.concat(found, new))

    return let(base, joined)


def scan(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``df`` with the spans of its whole texts in ``out``, an array that replaces a column of that
    name. Null and empty texts have none; rows are scanned one by one, repeated or not; a candidate takes time
    in proportion to its length; an empty table gives an empty one."""
    return df.withColumn(out, spans_of(whole(text)))


def redact(df: DataFrame, text: str = "text", mask: str = MASK) -> DataFrame:
    """``df`` with each span of its texts, overlapping ones as one, replaced by ``mask``. A text
    without spans, a null one too, stays as it is."""
    found, body = fresh(df, "found"), F.col(text)
    empty = "array<struct<start:bigint,end:bigint>>"

    def merged(spans: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            last = F.get(s, F.size(s) - 1)
            joins = (F.size(s) > 0) & (x["start"] < last["end"])
            grown = F.concat(
                F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))),
                F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))),
            )
            alone = F.concat(s, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))
            return F.when(joins, grown).otherwise(alone)

        return F.aggregate(spans, F.array().cast(empty), step)

    def masked(spans: Column) -> Column:
        begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
        ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(body).cast("long")))
        return F.array_join(F.zip_with(begins, ends, lambda a, b: F.substr(body, (a + 1).cast("int"), (b - a).cast("int"))), mask)

    rows = df.withColumn(found, spans_of(whole(text)))
    return rows.withColumn(text, F.when(F.size(found) > 0, let(merged(F.col(found)), masked)).otherwise(body)).drop(found)


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
