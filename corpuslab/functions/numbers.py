"""Cardinal numbers in Russian words, with gender and plural agreement."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: number words
UNITS = "ноль один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать".split()
TENS = "двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split()
HUNDREDS = "сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split()
FEMININE = {1: "одна", 2: "две"}
THOUSAND = ("тысяча", "тысячи", "тысяч")
MILLIONS = "миллион миллиард триллион квадриллион квинтиллион секстиллион септиллион".split()

LONGEST = 24  # digits; longer runs are read digit by digit


def _agreement(n: int) -> int:
    """0 for 1, 1 for 2 to 4, 2 for the rest; what ends in 11 to 19 belongs to the rest."""
    if n % 100 // 10 == 1:
        return 2
    return {1: 0, 2: 1, 3: 1, 4: 1}.get(n % 10, 2)


def _below_thousand(n: int, feminine: bool) -> str:
    words = [HUNDREDS[n // 100 - 1]] if n >= 100 else []
    n %= 100
    if n >= 20:
        words.append(TENS[n // 10 - 2])
        n %= 10
    if n:
        words.append(FEMININE[n] if feminine and n in FEMININE else UNITS[n])
    return " ".join(words)


def cardinal(value: int) -> str:
    """The cardinal of a whole number, masculine unless it counts thousands."""
    if value < 0:
        return "минус " + cardinal(-value)
    if value < 1000:
        return _below_thousand(value, False) if value else UNITS[0]
    if value >= 1000 ** (len(MILLIONS) + 2):
        return digit_by_digit(str(value))
    parts = []
    for power in range(len(MILLIONS) + 1, -1, -1):
        n = value // 1000**power % 1000
        if not n:
            continue
        form = _agreement(n)
        if power == 0:
            name = ""
        elif power == 1:
            name = THOUSAND[form]
        else:
            name = MILLIONS[power - 2] + ("", "а", "ов")[form]
        parts += [_below_thousand(n, power == 1), name]
    return " ".join(p for p in parts if p)


def digit_by_digit(run: str) -> str:
    return " ".join(UNITS[int(c)] for c in run)


def spoken(run: str) -> str:
    """How a run of digits is read: leading zeros and very long runs digit by digit."""
    if len(run) > LONGEST or (run[0] == "0" and run.strip("0")):
        return digit_by_digit(run)
    return cardinal(int(run))


@F.pandas_udf(T.StringType())
def cardinals(value: pd.Series) -> pd.Series:
    return value.map(lambda v: None if pd.isna(v) else cardinal(int(v)), na_action=None)


def cardinal_words(run: Column) -> Column:
    """How many words the cardinal of a run of digits has, by arithmetic on its groups of three."""
    digits = F.regexp_replace(run, "^0+(?=.)", "")
    groups = F.ceil(F.length(digits) / 3).cast("int")
    padded = F.lpad(digits, groups * 3, "0")

    def of_group(k: Column) -> Column:
        n = F.substr(padded, k * 3 + 1, F.lit(3)).cast("int")
        rest = n % 100
        own = (n >= 100).cast("int") + (rest > 0).cast("int") + ((rest > 20) & (rest % 10 > 0)).cast("int")
        return own + ((n > 0) & (k < groups - 1)).cast("int")

    total = F.aggregate(F.sequence(F.lit(0), groups - 1), F.lit(0), lambda s, k: s + of_group(k))
    return F.when(groups > len(MILLIONS) + 2, F.length(digits)).otherwise(F.greatest(total, F.lit(1)))
