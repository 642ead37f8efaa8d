"""Tokens of a value's own shape that can be undone without a vault.

The digits of a value are one number, its small and its capital letters two more. A keyed Feistel network permutes each among the numbers
of the same length: halves take turns, and each round adds a keyed hash of one to the other. Other signs stay where they are, so
a token has the shape of its value, no two values of a shape share one, and the rounds run backwards give the value back. The
rounds are keyed by SHA-256 over a secret; this is the construction of published format-preserving ciphers, not one of them to the letter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Digits of conv() in the order of an alphabet.
_DIGITS = "0123456789abcdefghijklmnop"
#: (signs, pattern of all others, most of them in one number): a half fits a long.
CLASSES = (("0123456789", "[^0-9]", 34), ("abcdefghijklmnopqrstuvwxyz", "[^a-z]", 24), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "[^A-Z]", 24))


def _number(signs: Column, alphabet: str) -> Column:
    digits = F.translate(signs, alphabet, _DIGITS[: len(alphabet)])
    return F.coalesce(F.conv(digits, len(alphabet), 10).cast("long"), F.lit(0).cast("long"))


def _signs(number: Column, size: Column, alphabet: str) -> Column:
    digits = F.lower(F.conv(number.cast("string"), 10, len(alphabet)))
    return F.when(size > 0, F.lpad(F.translate(digits, _DIGITS[: len(alphabet)], alphabet), size, alphabet[0])).otherwise("")


def _permuted(signs: Column, tweak: Column, secret: str, alphabet: str, undo: bool) -> Column:
    """The signs, of one number, as another number of that length; or, if undo, the number that became it."""
    powers = F.array(*(F.lit(len(alphabet) ** k).cast("long") for k in range(1 + (17 if len(alphabet) == 10 else 12))))
    way = -1 if undo else 1

    def moved(part: Column, by: Column, i: Column) -> Column:
        size = F.length(part)
        all_ = F.element_at(powers, size + 1)
        key = F.concat_ws("|", F.lit(secret), tweak, i.cast("string"), by)
        drawn = F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("long")
        return _signs(F.pmod(_number(part, alphabet) + way * (drawn % all_), all_), size, alphabet)

    def forth(acc: Column, i: Column) -> Column:
        return F.struct(acc["b"].alias("a"), moved(acc["a"], acc["b"], i).alias("b"))

    def back(acc: Column, i: Column) -> Column:
        return F.struct(moved(acc["b"], acc["a"], i).alias("a"), acc["a"].alias("b"))

    half = F.floor(F.length(signs) / 2).cast("int")
    start = F.struct(F.substring(signs, F.lit(1), half).alias("a"), F.substring(signs, half + 1, F.length(signs)).alias("b"))
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    out = F.aggregate(rounds, start, back if undo else forth, lambda acc: F.concat(acc["a"], acc["b"]))
    return F.when(F.length(signs) > 1, out).otherwise(moved(signs, F.lit(""), F.lit(0)))  # one sign has no halves


def _class_permuted(text: Column, kind: Column, secret: str, alphabet: str, rest: str, most: int, undo: bool) -> Column:
    """The signs of one class in a value, permuted piece by piece."""
    own = F.regexp_replace(text, rest, "")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.length(own) - 1, F.lit(0)), F.lit(most)), lambda at: F.substring(own, at + 1, F.lit(most)))

    def piece(p: Column, i: Column) -> Column:
        tweak = F.concat_ws("|", kind, F.lit(alphabet[0]), i.cast("string"))
        return F.when(p == "", "").otherwise(_permuted(p, tweak, secret, alphabet, undo))

    return F.array_join(F.transform(pieces, piece), "")


def shaped(text: Column, kind: Column, secret: str, undo: bool = False) -> Column:
    """The value's token, or with undo the value of a token. Equal values of a type have equal tokens; null stays null.

    Signs but digits and the letters a to z of either case stay. A value with more of a class than fit one number is permuted piece by piece.
    """
    other = [_class_permuted(text, kind, secret, alphabet, rest, most, undo) for alphabet, rest, most in CLASSES]

    def sign(at: Column, c: Column, i: Column) -> Column:
        upto = F.substring(at["text"], F.lit(1), i + 1)
        out = c
        for k, (_, rest, _) in enumerate(CLASSES):
            nth = F.length(F.regexp_replace(upto, rest, ""))
            out = F.when(F.rlike(c, F.lit(rest.replace("^", ""))), F.substring(at[f"of{k}"], nth, F.lit(1))).otherwise(out)
        return out

    # One row in an array, so that each class is permuted once and not for each sign.
    once = F.array(F.struct(text.alias("text"), *(signs.alias(f"of{k}") for k, signs in enumerate(other))))
    joined = F.transform(once, lambda at: F.array_join(F.transform(F.split(at["text"], ""), lambda c, i: sign(at, c, i)), ""))[0]
    return F.when(text == "", "").when(text.isNotNull(), joined)


def shaped_spans(spans: DataFrame, secret: str) -> DataFrame:
    """Adds token, the span's text in its own shape."""
    return spans.withColumn("token", shaped(F.col("text"), F.col("pii_type"), secret))


def unshaped_spans(spans: DataFrame, secret: str) -> DataFrame:
    """Adds text, the value of a token; no table of values is needed."""
    return spans.withColumn("text", shaped(F.col("token"), F.col("pii_type"), secret, undo=True))
