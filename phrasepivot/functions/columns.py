"""Column builders: counts, features, alignments, number formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACES = " \t\n\r\v\f"


def strip(col: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.trim(col, F.lit(_SPACES))


def tokens(phrase: Column) -> Column:
    """Words of a phrase: split at every single space."""
    return F.split(phrase, " ")


def _geometric(a: Column, b: Column) -> Column:
    return F.sqrt(a.cast("double") * b.cast("double"))


def _arithmetic(a: Column, b: Column) -> Column:
    return (a.cast("double") + b.cast("double")) / 2.0


#: How the co-occurrence count of a bridged pair comes from its two sides' counts.
COUNT_FUNCTIONS: dict[str, Callable[[Column, Column], Column]] = {
    "min": F.least,
    "max": F.greatest,
    "a-mean": _arithmetic,
    "g-mean": _geometric,
}
COUNT_FUNCTIONS |= {"minimum": F.least, "maximum": F.greatest, "arithmetic-mean": _arithmetic, "geometric-mean": _geometric}


def cooccurrence(how: str, a: Column, b: Column) -> Column:
    """As double; 0 where a side's count is missing."""
    both = a.isNotNull() & b.isNotNull()
    return F.coalesce(F.when(both, COUNT_FUNCTIONS[how](a, b).cast("double")), F.lit(0.0))


def ratio(x: Column, y: Column) -> Column:
    """x / y; 0 where y is 0 or either is missing."""
    return F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))


def clip(x: Column) -> Column:
    return F.least(x, F.lit(1.0))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def compose_alignments(a: Column, b: Column) -> Column:
    """(source word, target word) of all that meet on a word of the bridging phrase, sorted and distinct.

    a and b: (bridging word, source word) and (bridging word, target word)."""
    pairs = F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: y.s == x.s), lambda y: F.struct(x.t.alias("s"), y.t.alias("t")))))
    return F.array_sort(F.array_distinct(pairs))


def union_alignments(align: Column) -> Column:
    """Aggregate: the distinct points of a group's alignments, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(align))))


def unaligned(phrase: Column, align: Column, side: str) -> Column:
    """Places of the words that no point of the alignment names; side: s or t."""
    places = F.sequence(F.lit(0), F.size(tokens(phrase)) - 1)
    return F.array_except(places, F.transform(align, lambda p: p[side]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _product_error(a: Column, b: Column, product: Column) -> Column:
    """a * b - product, exact, for a product rounded to double: by halves of both factors."""

    def halves(x: Column) -> tuple[Column, Column]:
        wide = x * 134217729.0  # 2**27 + 1
        high = wide - (wide - x)
        return high, x - high

    (ah, al), (bh, bl) = halves(a), halves(b)
    return ((ah * bh - product) + ah * bl + al * bh) + al * bl


def _six_digits(x: Column) -> Column:
    """Of a positive number: struct of n, its six leading digits as a whole number, rounded as its exact
    binary value says and to even in a tie, and e, the exponent of the first of them."""

    def scaled(e: Column) -> Column:
        power = F.pow(F.lit(10.0), F.abs(5 - e).cast("double"))

        def rounded(v: Column) -> Column:
            up = (v.p - F.floor(v.p) > 0.5) | ((v.p - F.floor(v.p) == 0.5) & ((v.err > 0) | ((v.err == 0) & (F.floor(v.p) % 2 == 1))))
            n = F.floor(v.p) + F.when(up, 1).otherwise(0)
            return F.struct(F.when(n >= 1000000, F.lit(100000)).otherwise(n).cast("string").alias("n"), F.when(n >= 1000000, e + 1).otherwise(e).alias("e"))

        product, quotient = x * power, x / power
        back = quotient * power
        up = F.struct(product.alias("p"), _product_error(x, power, product).alias("err"))
        down = F.struct(quotient.alias("p"), ((x - back) - _product_error(quotient, power, back)).alias("err"))
        return let(F.when(e <= 5, up).otherwise(down), rounded)

    return let(F.substring_index(F.format_string("%.16e", x), "e", -1).cast("int"), scaled)


def format_g6(x: Column) -> Column:
    """As C's %.6g: six significant digits, no trailing zeros, an exponent below 1e-4 and from 1e6 on.

    Numbers beyond 1e-16 and 1e27 round decimal ties up."""

    def text(v: Column) -> Column:
        whole = F.when(v.e >= 0, F.concat(F.substr(v.n, F.lit(1), v.e + 1), F.lit("."), F.substr(v.n, v.e + 2)))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-v.e - 1, F.lit(0))), v.n)
        sci = F.concat(F.regexp_replace(F.concat(F.substr(v.n, F.lit(1), F.lit(1)), F.lit("."), F.substr(v.n, F.lit(2))), r"[.]?0+$", ""), F.format_string("e%+03d", v.e))
        return F.when(v.e.between(-4, 5), F.regexp_replace(F.coalesce(whole, small), r"[.]?0*$", "")).otherwise(sci)

    size = F.abs(x)
    java = F.format_string("%.5e", size)
    far = F.concat(F.regexp_replace(F.substring_index(java, "e", 1), r"[.]?0+$", ""), F.lit("e"), F.substring_index(java, "e", -1))
    body = F.when((size >= 1e-16) & (size < 1e27), let(_six_digits(size), text)).otherwise(far)
    return F.when(x.isNull(), None).when(x == 0, "0").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), body))


def format_f7(x: Column) -> Column:
    return F.format_string("%.7f", x)


def show_alignment(align: Column) -> Column:
    """Points as s-t, joined by spaces."""
    return F.array_join(F.transform(align, lambda p: F.concat(p.s.cast("string"), F.lit("-"), p.t.cast("string"))), " ")


def line_key() -> Column:
    """Orders rows as their written lines do, byte by byte."""
    return F.concat(F.col("src"), F.lit(" ||| "), F.col("tgt"), F.lit(" ||| "))
