"""FF3 / FF3-1 format-preserving encryption of digit strings as native columns.

The published eight-round Feistel network (NIST SP 800-38G), radix 10. The rounds are one
``aggregate`` over the round numbers, so the whole cipher is one expression whose size does
not grow when filters are pushed through it. The key and tweak columns come from the policy
table. Halves of up to 28 digits are decimals of 38 digits, so 56 digits in all, as the
published method allows; longer values give null and the caller fails closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MIN_DIGITS, MAX_DIGITS = 6, 56
ROUNDS = 8
SHORT_DIGITS = 28  # halves of up to 14 digits: their arithmetic fits longs
WHOLE = "decimal(38,0)"


def _swap_bytes(hexed: Column) -> Column:
    """Reverse the byte order of a hex string."""
    return F.reverse(F.regexp_replace(hexed, "(.)(.)", "$2$1"))


def _round_value(half: Column, index: Column, short: bool) -> Column:
    """AES of (tweak half xor round, other half) as byte-reversed hex."""
    if short:
        number = F.lpad(F.hex(F.reverse(half).cast("long")), 24, "0")
    else:
        number, base = F.reverse(half).cast(WHOLE), F.lit(1 << 48).cast(WHOLE)
        low = number % base
        number = F.concat(*[F.lpad(F.hex(x.cast("long")), 12, "0") for x in ((number - low) / base, low)])
    block = F.concat(_swap_bytes(number), F.element_at("round_tweaks", index + 1))
    cipher = F.aes_encrypt(F.unhex(block), F.col("fpe_key"), F.lit("ECB"), F.lit("PKCS"))
    return _swap_bytes(F.left(F.hex(cipher), F.lit(32)))


def _fold(hexed: Column, modulus: Column, short: bool) -> Column:
    """128-bit hex number modulo ``modulus``, a few hex digits at a time.

    A remainder of a long value has up to 28 digits and 2^32 has ten, so every product fits 38
    digits; one of a short value has 14 and 2^16 has five, so every product fits a long.
    """
    width, kind = (4, "long") if short else (8, WHOLE)
    return F.aggregate(
        F.regexp_extract_all(hexed, F.lit(f".{{{width}}}"), F.lit(0)),
        F.lit(0).cast(kind),
        lambda acc, part: ((acc * F.lit(16**width).cast(kind) + F.conv(part, 16, 10).cast(kind)) % modulus).cast(kind),
    )


def spread_digits(value: Column, digits: Column) -> Column:
    """Put ``digits`` back at the digit positions of ``value``.

    The digits ride in the state, so that they are computed once and not per character.
    """
    return F.aggregate(
        F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)),
        F.struct(digits.alias("left"), F.lit("").alias("out")),
        lambda acc, ch: F.when(
            ch.between("0", "9"),
            F.struct(
                F.substring(acc["left"], F.lit(2), F.length(acc["left"])).alias("left"),
                F.concat(acc["out"], F.left(acc["left"], F.lit(1))).alias("out"),
            ),
        ).otherwise(F.struct(acc["left"].alias("left"), F.concat(acc["out"], ch).alias("out"))),
        lambda acc: acc["out"],
    )


def fpe(df: DataFrame, value: str, out: str, decrypt: bool = False) -> DataFrame:
    """Add ``out``: ``value`` with its digits encrypted (or decrypted) in place.

    ``df`` carries ``fpe_key`` and ``round_tweaks``. Fewer than six digits are padded on
    the left and trimmed back on the right (not invertible, the vault reverses those).
    Null when there is no digit at all or more than ``MAX_DIGITS``.
    """
    digits = F.regexp_replace(F.col(value), "[^0-9]", "")
    padded = F.when(F.length(digits) < MIN_DIGITS, F.lpad(digits, MIN_DIGITS, "0")).otherwise(digits)
    size = F.greatest(F.length(digits), F.lit(MIN_DIGITS))
    upper, lower = F.ceil(size / 2).cast("int"), F.floor(size / 2).cast("int")

    rounds = range(ROUNDS - 1, -1, -1) if decrypt else range(ROUNDS)

    def made(short: bool) -> Column:
        """All rounds; values of up to ``SHORT_DIGITS`` in whole longs, longer ones in decimals."""
        kind = "long" if short else WHOLE

        def power(n: Column) -> Column:
            return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast(kind)

        start = F.struct(
            F.left(padded, upper).alias("a"),
            F.right(padded, lower).alias("b"),
            upper.alias("u"),
            lower.alias("v"),
            power(upper).alias("pu"),
            power(lower).alias("pv"),
        )

        def step(acc: Column, i: Column) -> Column:
            width = F.when(i % 2 == 0, acc["u"]).otherwise(acc["v"])
            modulus = F.when(i % 2 == 0, acc["pu"]).otherwise(acc["pv"])
            keep, turn = (acc["a"], acc["b"]) if decrypt else (acc["b"], acc["a"])
            added, old = _fold(_round_value(keep, i, short), modulus, short), F.reverse(turn).cast(kind)
            total = F.pmod(old - added, modulus) if decrypt else (old + added) % modulus
            fresh = F.reverse(F.lpad(total.cast("string"), width, F.lit("0")))
            a, b = (fresh, keep) if decrypt else (keep, fresh)
            return F.struct(a.alias("a"), b.alias("b"), *[acc[c].alias(c) for c in ("u", "v", "pu", "pv")])

        return F.aggregate(F.array(*[F.lit(i) for i in rounds]), start, step, lambda acc: F.concat(acc["a"], acc["b"]))

    whole = F.when(size <= SHORT_DIGITS, made(True)).otherwise(made(False))
    return df.withColumn(
        out,
        F.when(
            F.length(digits).between(1, MAX_DIGITS),
            # the last digits; ``right`` would name the cipher twice
            spread_digits(F.col(value), F.substring(whole, -F.length(digits), F.length(digits))),
        ),
    )
