"""Synthetic labelled corpora: seeded sentences with generated values that pass their checks, and their gold spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sentences by class; {} is the value.
TEMPLATES = {
    "email": ("Please write to {} today.", "Kontakt: {}"),
    "custom:credit_card": ("Card on file: {} (exp. 11/30).", "Karte {} wurde belastet."),
    "custom:ip_address": ("Login from {} refused.", "Host {} antwortet nicht."),
    "custom:iban": ("IBAN: {}, due Friday.", "Konto {} bitte prüfen."),
    "custom:phone": ("Call me at {} please.", "Phone {}"),
}


def _draw(seed: int, what: str, n: int) -> Column:
    """A number below n, by row, seed and purpose."""
    return F.pmod(F.xxhash64("doc_id", F.lit(f"{seed}:{what}")), F.lit(n))


def _digits(seed: int, what: str, n: int) -> Column:
    return F.lpad(_draw(seed, what, 10**n).cast("string"), n, "0")


def _luhn_digit(body: Column) -> Column:
    """The digit that completes a number."""
    each = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))).otherwise(c.cast("int")))
    return ((10 - F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10) % 10).cast("string")


def _iban(body: Column) -> Column:
    """A German account number with its check digits."""
    rest = F.aggregate(F.split(F.concat(body, F.lit("131400")), ""), F.lit(0), lambda s, c: (s * 10 + c.cast("int")) % 97)
    return F.concat(F.lit("DE"), F.lpad((98 - rest).cast("string"), 2, "0"), body)


def build(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """doc_id, text, spans (start, end, label, in bytes) of ``n`` texts of two sentences each, the same for the same seed."""
    rows = spark.range(n).select(F.col("id").alias("doc_id"))
    for part in ("a", "b"):
        key = lambda what: f"{part}:{what}"  # noqa: B023, E731
        card = F.concat(F.lit("4"), _digits(seed, key("card"), 14))
        card = F.regexp_replace(F.concat(card, _luhn_digit(card)), "([0-9]{4})(?=[0-9])", "$1 ")
        values = {
            "email": F.concat(F.lit("user"), _draw(seed, key("mail"), 9000).cast("string"), F.lit("@mail.example.org")),
            "custom:credit_card": card,
            "custom:ip_address": F.concat_ws(".", F.lit("10"), *(_draw(seed, key(f"ip{i}"), 256).cast("string") for i in range(3))),
            "custom:iban": _iban(_digits(seed, key("iban"), 18)),
            "custom:phone": F.concat(F.lit("(212) 555-"), _digits(seed, key("phone"), 4)),
        }
        classes = sorted(values)
        cls = F.element_at(F.array(*map(F.lit, classes)), (_draw(seed, key("class"), len(classes)) + 1).cast("int"))
        value, frame = F.lit(""), F.lit("")
        for c in classes:
            value = F.when(F.col(f"c_{part}") == c, values[c]).otherwise(value)
            frame = F.when(F.col(f"c_{part}") == c, F.element_at(F.array(*map(F.lit, TEMPLATES[c])), (_draw(seed, key("frame"), 2) + 1).cast("int"))).otherwise(frame)
        rows = rows.withColumn(f"c_{part}", cls).withColumn(f"v_{part}", value).withColumn(f"f_{part}", frame)
        rows = rows.withColumn(f"s_{part}", F.octet_length(F.substring_index(f"f_{part}", "{}", 1))).withColumn(f"t_{part}", F.expr(f"replace(f_{part}, '{{}}', v_{part})"))
    shift = F.octet_length("t_a") + 1
    spans = F.array(
        F.struct(F.col("s_a").alias("start"), (F.col("s_a") + F.octet_length("v_a")).alias("end"), F.col("c_a").alias("label")),
        F.struct((shift + F.col("s_b")).alias("start"), (shift + F.col("s_b") + F.octet_length("v_b")).alias("end"), F.col("c_b").alias("label")),
    )
    return rows.select("doc_id", F.concat_ws("\n", "t_a", "t_b").alias("text"), spans.alias("spans"))
