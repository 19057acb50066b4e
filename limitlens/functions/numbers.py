"""Number grammars and exact decimal parsing."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T

from limitlens.functions.text import WHITE_SPACE
from limitlens.schema import AMOUNT, FINE, RATIO

# The two accepted number formats. White space may surround the number,
# thousands separators may stand anywhere after the first digit; the sign leads or trails,
# not both.
_DIGITS = r"(?:[0-9][0-9,]*(?:\.[0-9]*)?|\.[0-9]+)"
_EXPONENT = r"(?:[eE][+-]?[0-9]+)?"
_TRAILING = r"[ \t-\r]*[+-]"
PLAIN_NUMBER = rf"(?U)\A\s*(?:[+-]?{_DIGITS}|{_DIGITS}{_TRAILING})\s*\z"
EXPONENT_NUMBER = rf"(?U)\A\s*(?:[+-]?{_DIGITS}{_EXPONENT}|{_DIGITS}{_EXPONENT}{_TRAILING})\s*\z"
# Fixed value: largest magnitude of a 96-bit decimal.
MAX_DECIMAL = "79228162514264337593543950335"
# The most decimals that leave room for its 29 integer digits.
PROFILE_NUMBER = T.DecimalType(38, 9)

# The usual spelling, cast as it is; everything else takes the long way.
_SIMPLE = r"\A[+-]?[0-9]{1,28}(?:\.[0-9]{0,9})?\z"
# Units of a fine part (the tenth to the 28th decimal) in one unit of the ninth decimal.
_FINE_UNITS = Decimal(10**19)
# Exponents beyond this leave the range, or every decimal, of any number.
_FAR = 99


def _sign_first(raw: Column) -> Column:
    digits = F.translate(raw, WHITE_SPACE + ",", "")
    return F.regexp_replace(digits, r"\A(.*)([+-])\z", "$2$1")


def _parse(value: Column | str, grammar: str, target: T.DataType) -> Column:
    raw = F.col(value) if isinstance(value, str) else value
    return F.when(raw.rlike(_SIMPLE), raw.try_cast(target)).when(raw.rlike(grammar), _sign_first(raw).try_cast(target))


def _two_parts(value: Column | str, grammar: str) -> Column:
    """struct(amount, fine) of a number: nine decimals, and what follows up to the 28th as whole units.

    Both are cut, not rounded, and have the number's sign, so numbers compare as their parts
    do. NULL for other text and beyond a 96-bit decimal. fine is NULL where it is zero.
    """
    raw = F.col(value) if isinstance(value, str) else value

    def split(text: Column) -> Column:
        part = lambda pattern: F.regexp_extract(text, pattern, 1)
        before = part(r"\A[+-]?([0-9]*)")
        far = F.when(text.rlike("[eE]-"), -_FAR).when(text.rlike("[eE]"), _FAR).otherwise(0)
        power = F.coalesce(part(r"[eE]([+-]?[0-9]+)").try_cast("int"), far)
        return F.struct(
            F.when(text.startswith("-"), F.lit("-")).otherwise("").alias("sign"),
            F.concat(before, part(r"\.([0-9]*)")).alias("digits"),
            (F.length(before) + F.greatest(F.least(power, F.lit(_FAR)), F.lit(-_FAR))).alias("point"),
        )

    def placed(p: Column) -> Column:
        whole = F.when(p["point"] > 0, F.rpad(F.substr(p["digits"], F.lit(1), p["point"]), p["point"], F.lit("0"))).otherwise("0")
        rest = F.when(p["point"] >= 0, F.substr(p["digits"], p["point"] + 1, F.lit(28))).otherwise(F.concat(F.repeat(F.lit("0"), -p["point"]), p["digits"]))
        return F.struct(p["sign"].alias("sign"), F.regexp_replace(whole, r"\A0+(?=[0-9])", "").alias("whole"), F.rpad(rest, F.lit(28), F.lit("0")).alias("decimals"))

    def cut(p: Column) -> Column:
        amount = F.concat(p["sign"], p["whole"], F.lit("."), F.substr(p["decimals"], F.lit(1), F.lit(9))).try_cast(AMOUNT)
        fine = F.concat(p["sign"], F.substr(p["decimals"], F.lit(10), F.lit(19))).try_cast(FINE)
        return F.struct(amount.alias("amount"), F.nullif(fine, F.lit(0).cast(FINE)).alias("fine"))

    # Each step's result is held by a lambda variable, so that the expression does not multiply.
    steps = F.array(_sign_first(raw))
    for step in (split, placed, cut):
        steps = F.transform(steps, step)
    # One more than the largest whole number of a 96-bit decimal.
    inside = F.lit(Decimal(MAX_DECIMAL[:-1] + "6"))
    long = F.get(F.filter(steps, lambda p: F.abs(p["amount"]) < inside), F.lit(0))
    short = F.struct(raw.try_cast(AMOUNT).alias("amount"), F.lit(None).cast(FINE).alias("fine"))
    return F.when(raw.rlike(_SIMPLE), short).when(raw.rlike(grammar), long)


def parse_exact(value: Column | str) -> Column:
    """struct(amount, fine) of an amount without exponent; NULL when the text is not a number."""
    return _two_parts(value, PLAIN_NUMBER)


def parse_exact_profile(value: Column | str) -> Column:
    """struct(amount, fine) of a number with optional exponent."""
    return _two_parts(value, EXPONENT_NUMBER)


def parse_amount(value: Column | str) -> Column:
    """Amount without exponent, nine decimals; NULL when the text is not a number."""
    return parse_exact(value)["amount"]


def plain_text(amount: Column, fine: Column) -> Column:
    """A two-part number as digits, without zeros at its end."""
    units = F.abs(F.coalesce(fine, F.lit(0).cast(FINE)))
    whole = F.floor(F.abs(amount))
    nine = F.lpad((F.abs(amount) % 1 * F.lit(Decimal(10**9))).cast("decimal(9,0)").cast("string"), 9, "0")
    decimals = F.regexp_replace(F.concat(nine, F.lpad(units.cast("string"), 19, "0")), "0+$", "")
    sign = F.when((amount < 0) | (F.coalesce(fine, F.lit(0).cast(FINE)) < 0), F.lit("-")).otherwise("")
    return F.concat(sign, whole.cast("string"), F.when(decimals == "", F.lit("")).otherwise(F.concat(F.lit("."), decimals)))


def carried(amount: Column, fine: Column) -> Column:
    """struct(amount, fine) of sums of both parts: fine within one unit of the ninth decimal, both of one sign."""
    ninth, wide = F.lit(Decimal("0.000000001")), "decimal(30,0)"

    def split(p: Column) -> Column:
        over = F.floor(p["fine"] / F.lit(_FINE_UNITS)).cast("decimal(18,0)")
        left = (p["fine"] - over * F.lit(_FINE_UNITS)).cast(wide)  # 0 or more
        return F.struct(difference(p["amount"], -over * ninth).alias("amount"), left.alias("fine"))

    def signed(p: Column) -> Column:
        # A negative amount takes one unit back, so that both parts are negative or zero.
        back = (p["amount"] < 0) & (p["fine"] > 0)
        units = F.when(back, p["fine"] - F.lit(_FINE_UNITS)).otherwise(p["fine"]).try_cast(FINE)
        return F.struct(
            F.when(back, difference(p["amount"], -ninth)).otherwise(p["amount"]).alias("amount"),
            F.nullif(units, F.lit(0).cast(FINE)).alias("fine"),
        )

    steps = F.array(F.struct(amount.alias("amount"), F.coalesce(fine.cast(wide), F.lit(0).cast(wide)).alias("fine")))
    for step in (split, signed):
        steps = F.transform(steps, step)
    return steps[0]


def parse_profile_number(value: Column | str) -> Column:
    """Number with optional exponent inside the 96-bit decimal range, else NULL."""
    parsed = _parse(value, EXPONENT_NUMBER, PROFILE_NUMBER)
    bound = F.lit(MAX_DECIMAL).cast(T.DecimalType(38, 0))
    return F.when(F.abs(parsed) <= bound, parsed)


def parse_profile_double(value: Column | str) -> Column:
    """The same number as a double, for text already known to be a number or missing."""
    return _parse(value, EXPONENT_NUMBER, T.DoubleType())


def amount_column(df: DataFrame, name: str) -> Column:
    """struct(amount, fine) of a physical column: numeric types are cast, text is parsed."""
    kind = next(f.dataType for f in df.schema.fields if f.name.lower() == name.lower())
    column = F.col(f"`{name}`")
    if isinstance(kind, T.DecimalType) and kind.scale > AMOUNT.scale:
        return parse_exact(F.format_string(f"%.{kind.scale}f", column))
    if isinstance(kind, T.NumericType):
        return F.struct(column.try_cast(AMOUNT).alias("amount"), F.lit(None).cast(FINE).alias("fine"))
    return parse_exact(column)


# Operands whose sums, differences and small multiples fit 38 digits with every decimal. From
# 25 integer digits on a 96-bit decimal has four decimals at most.
_ORDINARY = T.DecimalType(35, 9)
_LARGE = T.DecimalType(33, 4)
# Operands whose quotient keeps 16 decimals: below 10^18 with four, below 10^13 with nine.
_DIVIDED = (T.DecimalType(22, 4), T.DecimalType(22, 9))


def _exactly(a: Column, b: Column, calculate: Callable[[Column, Column], Column]) -> Column:
    """``calculate`` on both amounts in the first type that holds them."""
    return F.coalesce(*[calculate(a.try_cast(kind), b.try_cast(kind)) for kind in (_ORDINARY, _LARGE)])


def difference(a: Column, b: Column) -> Column:
    """``a - b`` of two amounts."""
    return _exactly(a, b, lambda x, y: (x - y).try_cast(AMOUNT))


def held(fields: dict[str, Column], calculate: Callable[[Column], Column]) -> Column:
    """``calculate`` on a struct of the fields, kept out of the generated code: for what is rarely needed."""
    row = F.struct(*[c.alias(n) for n, c in fields.items()])
    return F.get(F.transform(F.array(row), calculate), F.lit(0))


def is_positive(amount: Column, fine: Column) -> Column:
    return (amount > 0) | ((amount == 0) & F.coalesce(fine > 0, F.lit(False)))


def exceeds(used: Column, used_fine: Column, limit: Column, limit_fine: Column) -> Column:
    """Whether ``used`` is more than ``limit``, to the 28th decimal; neither is negative."""
    zero = F.lit(0).cast(FINE)
    return (used > limit) | ((used == limit) & (F.coalesce(used_fine, zero) > F.coalesce(limit_fine, zero)))


def nine_tenths_reached(used: Column, limit: Column) -> Column:
    """Whether ``used`` is at least 90 % of ``limit``; without division."""
    return _exactly(used, limit, lambda x, y: x * 10 >= y * 9)


def nine_tenths_reached_exactly(used: Column, used_fine: Column, limit: Column, limit_fine: Column) -> Column:
    """The same to the 28th decimal: the fine parts decide where nine decimals leave less than they can change."""
    zero = F.lit(0).cast(FINE)
    left = _exactly(used, limit, lambda x, y: (x * 10 - y * 9).try_cast(AMOUNT))
    units = (left.try_cast("decimal(12,9)") * F.lit(Decimal(10**9))).cast("decimal(6,0)") * F.lit(_FINE_UNITS)
    fine = F.coalesce(used_fine, zero) * 10 - F.coalesce(limit_fine, zero) * 9
    return F.when(F.abs(left) < F.lit(Decimal("0.00000002")), units + fine >= 0).otherwise(left > 0)


def quotient(used: Column, limit: Column) -> Column:
    """``used / limit`` with 16 decimals; NULL for a zero limit.

    Amounts too large or too fine for a decimal quotient of that scale are divided as doubles.
    """
    def divided(kind: T.DecimalType) -> Column:
        x, y = used.try_cast(kind), limit.try_cast(kind)
        return F.when((x == used) & (y == limit), F.try_divide(x, y).try_cast(RATIO))

    rough = F.try_divide(used.cast("double"), limit.cast("double")).try_cast(RATIO)
    return F.coalesce(*map(divided, _DIVIDED), rough)


def quotient_of_parts(used: Column, used_fine: Column, limit: Column, limit_fine: Column) -> Column:
    """``used / limit`` of two-part amounts, divided as doubles."""
    rough = lambda amount, fine: amount.cast("double") + F.coalesce(fine.cast("double") * 1e-28, F.lit(0.0))
    return F.try_divide(rough(used, used_fine), rough(limit, limit_fine)).try_cast(RATIO)


def round_half_up(value: Column, places: int) -> Column:
    """Spark's ``round`` is half-up and sign-symmetric, i.e. half away from zero."""
    return F.round(value, places)
