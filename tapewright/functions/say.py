"""Numbers as words with Indian grouping, in English and Hindi."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: number words
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = ("", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
HINDI = (
    "शून्य एक दो तीन चार पाँच छह सात आठ नौ "
    "दस ग्यारह बारह तेरह चौदह पंद्रह सोलह सत्रह अठारह उन्नीस "
    "बीस इक्कीस बाईस तेईस चौबीस पच्चीस छब्बीस सत्ताईस अट्ठाईस उनतीस "
    "तीस इकतीस बत्तीस तैंतीस चौंतीस पैंतीस छत्तीस सैंतीस अड़तीस उनतालीस "
    "चालीस इकतालीस बयालीस तैंतालीस चौवालीस पैंतालीस छियालीस सैंतालीस अड़तालीस उनचास "
    "पचास इक्यावन बावन तिरपन चौवन पचपन छप्पन सत्तावन अट्ठावन उनसठ "
    "साठ इकसठ बासठ तिरसठ चौंसठ पैंसठ छियासठ सड़सठ अड़सठ उनहत्तर "
    "सत्तर इकहत्तर बहत्तर तिहत्तर चौहत्तर पचहत्तर छिहत्तर सतहत्तर अठहत्तर उनासी "
    "अस्सी इक्यासी बयासी तिरासी चौरासी पचासी छियासी सत्तासी अट्ठासी नवासी "
    "नब्बे इक्यानवे बानवे तिरानवे चौरानवे पंचानवे छियानवे सत्तानवे अट्ठानवे निन्यानवे"
).split()
UNITS = ((10**7, "crore", "करोड़"), (10**5, "lakh", "लाख"), (10**3, "thousand", "हज़ार"), (100, "hundred", "सौ"))
MINUS = {"en": "minus", "hi": "ऋण"}


def _small(n: int, lang: str) -> str:
    if lang == "hi":
        return HINDI[n]
    return ONES[n] if n < 20 else TENS[n // 10] + (f"-{ONES[n % 10]}" if n % 10 else "")


def words(n: int, lang: str) -> str:
    """A whole number not below zero; crores beyond ninety-nine are numbers themselves."""
    if n < 100:
        return _small(n, lang)
    parts = []
    for size, en, hi in UNITS:
        if k := n // size:
            parts.append(f"{words(k, lang)} {hi if lang == 'hi' else en}")
        n %= size
    if n:
        parts.append(("and " if lang == "en" else "") + _small(n, lang))
    return " ".join(parts)


def say(value: float, lang: str = "en") -> str:
    """Halves away from zero; languages without words keep digits."""
    n = int(abs(value) + 0.5)
    if lang not in MINUS:
        return str(-n if value < 0 and n else n)
    return f"{MINUS[lang]} {words(n, lang)}" if value < 0 and n else words(n, lang)


@F.pandas_udf(T.StringType())
def say_column(value: pd.Series, lang: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or v != v else say(v, x or "en") for v, x in zip(value, lang)])
