"""Operator 1: personal data by patterns, checksums and context words, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

THRESHOLD = 0.6  # added kinds count from this score on
NEAR = 40  # characters on each side in which context words are looked for

# Patterns of the base kinds, fixed values in meaning. Each is written so that the
# engine's leftmost matches are the same but never start inside a run that has
# failed before, and never backtrack into one: long texts cost linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
# Only runs of 16 to 19 digits can pass, and a match is always a whole run.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
# Added kinds.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
LOCAL = r"(?<![0-9+(.-])(?:\([0-9]{3}\)[\x20-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"

# Published formats of access keys, fixed values.
KEY = (
    r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|AIza[A-Za-z0-9_-]{35}|xox[abprs]-[A-Za-z0-9-]{10,250}"
    r"|[rs]k_(?:live|test)_[A-Za-z0-9]{16,99}|eyJ[A-Za-z0-9_-]{10,4000}\.eyJ[A-Za-z0-9_-]{10,4000}\.[A-Za-z0-9_-]{10,1000})(?![A-Za-z0-9_-])"
)
SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,256}+(?![A-Za-z0-9+/_-])"
LEAST_BITS = 3.0  # entropy a character that a secret has at least


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(values: Column, block: int = 256) -> Column:
    """Sums of each prefix of an array of longs; blockwise, so long arrays stay cheap."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def prefixes(part: Column, ahead: Column) -> Column:
        return F.transform(part, lambda x, i: ahead + total(F.slice(part, 1, i + 1)))

    count = F.ceil(F.size(values) / block).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(numbers, lambda b: F.slice(values, b * block + 1, F.lit(block)))

    def joined(parts: Column) -> Column:
        sums = F.transform(parts, total)
        ahead = let(sums, lambda s: F.transform(s, lambda _, i: total(F.slice(s, 1, i))))
        return F.flatten(F.zip_with(parts, ahead, prefixes))

    return let(blocks, joined)


def located(text: Column, pattern: str) -> Column:
    """All leftmost matches of ``pattern``: ``array<struct<start, end, found, near>>`` in code points."""

    def placed(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            steps = F.flatten(
                F.transform(found, lambda m, i: F.array(F.length(F.get(gaps, i)).cast("long"), F.length(m).cast("long")))
            )

            def spans(ends: Column) -> Column:
                return F.transform(
                    found,
                    lambda m, i: F.struct(
                        F.get(ends, 2 * i).alias("start"),
                        F.get(ends, 2 * i + 1).alias("end"),
                        m.alias("found"),
                        F.lower(F.concat(F.right(F.get(gaps, i), F.lit(NEAR)), F.lit(" "), F.left(F.get(gaps, i + 1), F.lit(NEAR)))).alias("near"),
                    ),
                )

            return let(running_sums(steps), spans)

        # A pattern's gaps are taken only where it matches at all.
        return let(F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")), with_gaps)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.transform(
        F.split(F.reverse(number), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number, its first four characters moved to the end, is 1 modulo 97."""
    plain = F.replace(code, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))

    def step(a: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55  # A is 10
        return F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).when(c.rlike("[A-Z]"), (a * 100 + letter) % 97).otherwise(a)

    rest = F.aggregate(F.split(turned, ""), F.lit(0), step)
    return (rest == 1) & F.length(plain).between(15, 34)


def entropy(found: Column) -> Column:
    """Shannon entropy of a string's characters, in bits a character."""
    size = F.length(found)

    def bits(sum_: Column, c: Column) -> Column:
        share = (size - F.length(F.replace(found, c, F.lit("")))) / size
        return sum_ - share * F.log2(share)

    return F.aggregate(F.array_remove(F.array_distinct(F.split(found, "")), ""), F.lit(0.0), bits)


def random_like(found: Column) -> Column:
    """Letters and digits mixed, of the entropy of a random string."""
    return found.rlike("[A-Za-z]") & found.rlike("[0-9]") & (entropy(found) >= LEAST_BITS)


# kind: (pattern, check, score of a confirmed match, score added by a context word, context words)
BASE = {
    "email": (EMAIL, lambda m: F.lit(True), 0.9, 0.1, "mail|contact|write"),
    "ip": (IP, lambda m: m.rlike(OCTETS), 0.7, 0.2, "ip|server|host|address|login"),
    "card": (CARD, lambda m: luhn(digits(m)), 0.8, 0.2, "card|visa|credit|debit|payment|karte|carte|tarjeta"),
    "phone": (PHONE, lambda m: F.length(digits(m)).between(8, 15), 0.7, 0.2, "tel|phone|call|fax|mobile|contact"),
}
ADDED = {
    "iban": (IBAN, mod97, 0.8, 0.2, "iban|bank|account|konto|compte|cuenta"),
    "ssn": (SSN, lambda m: F.lit(True), 0.4, 0.4, "ssn|social security|security number|taxpayer"),
    "local": (LOCAL, lambda m: F.lit(True), 0.4, 0.4, "tel|phone|call|fax|mobile|dial"),
    "key": (KEY, lambda m: entropy(m) >= LEAST_BITS, 0.8, 0.2, "key|token|secret|credentials?"),
    "secret": (
        SECRET, lambda m: random_like(m) & ~m.rlike(KEY), 0.4, 0.4,
        "password|passwd|pwd|secret|token|bearer|credentials?|api[ _-]?key|(?:secret|access|private|auth)[ _-]?(?:key|token)",
    ),
}


def confirmed(text: Column, kind: str, rule: tuple) -> Column:
    """Spans of one kind that pass its check, scored."""
    pattern, check, score, bonus, words = rule
    near = rf"\b(?:{words})\b"
    return F.transform(
        F.filter(located(text, pattern), lambda s: check(s["found"])),
        lambda s: F.struct(
            F.lit(kind).alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.round(F.lit(score) + F.when(s["near"].rlike(near), bonus).otherwise(0.0), 2).alias("score"),
        ),
    )


def unused(docs: DataFrame, *others: str) -> str:
    """A prefix with which no column of ``docs``, and none of ``others``, begins."""
    prefix = "_pii"
    while any(c.lower().startswith(prefix) for c in (*docs.columns, *others)):
        prefix = "_" + prefix
    return prefix


def find_pii(docs: DataFrame, text_col: str = "text", name: str = "pii") -> DataFrame:
    """``docs`` with ``pii``: ``array<struct<kind, start, end, score>>``, by kind as listed, then start.

    Patterns propose spans, checksums (Luhn, modulo 97), ranges and entropy confirm them,
    context words within 40 characters raise the score. Confirmed spans of the
    base kinds (email, ip, card, phone) always stay; those of the added kinds
    (iban, ssn, local, key, secret) stay from score 0.6 on unless they touch a base span.
    Positions are code points, the end exclusive. A NULL or empty text has no
    spans. All columns are kept; one named as the result (``name``) is replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = unused(docs, name)
    found = docs.withColumns({f"{own}_{kind}": confirmed(text, kind, rule) for kind, rule in (BASE | ADDED).items()})
    base = F.concat(*[F.col(f"{own}_{k}") for k in BASE])
    found = found.withColumn(f"{own}_base", base)
    added = F.concat(*[F.col(f"{own}_{k}") for k in ADDED])
    clear = F.filter(
        added,
        lambda s: (s["score"] >= THRESHOLD)
        & ~F.exists(f"{own}_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    drop = [f"{own}_{k}" for k in (*BASE, *ADDED)] + [f"{own}_base"]
    return found.withColumn(name, F.concat(f"{own}_base", clear)).drop(*drop)


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each found span replaced by its kind in angle brackets; where spans touch, by the first one's.

    Texts without spans, NULL and empty ones stay as they are. All columns are kept.
    """
    listed_in = f"{unused(docs)}_spans"
    found = find_pii(docs, text_col, listed_in)
    text = F.col(text_col)
    spans = F.array_sort(F.transform(listed_in, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        mark = F.when(s["start"] >= acc["at"], F.concat(gap, F.lit("<"), s["kind"], F.lit(">"))).otherwise("")
        return F.struct(F.concat(acc["done"], mark).alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))

    masked = F.aggregate(
        spans, start, step, lambda acc: F.concat(acc["done"], F.substr(text, (acc["at"] + 1).cast("int")))
    )
    return found.withColumn(text_col, F.when(F.size(listed_in) > 0, masked).otherwise(text)).drop(listed_in)


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and the list of all spans of each document."""
    found = find_pii(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    is_base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    counts = [F.array_size(F.filter("pii", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(is_base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
