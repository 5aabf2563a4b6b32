"""Numbers of claims and evidence as normalised tokens; column expressions, all inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words, and a number that is no part of an identifier, with the brace around it if there is one.
NUMBER_WORDS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
NUMBER = r"[-+]?(?:\d{1,3}(?:[,   ]\d{3})+|\d+)(?:\.\d+)?(?:\s*[×xX%])?"
IN_PLACE = r"(?U)(?:(\{)\s*)?(?<![A-Za-z0-9.\-])(" + NUMBER + r")(?:(?=\s*(\})))?"
BARE = r"(?U)(?=[-+\d])(?<![A-Za-z0-9.\-])(" + NUMBER + r")"
GROUPED = r"(?U)^[-+]?\d{1,3}(,\d{3})+(\.\d+)?$"


def normalized_numbers(x: Column) -> Column:
    """Distinct numbers of a text in order: no blanks or commas inside, × for x, a percent or × sign kept; number words last.

    Commas separate numbers where they do not group thousands, or where braces enclose the list.  Null gives no numbers.
    """
    x = F.coalesce(x, F.lit(""))
    group = lambda k: F.regexp_extract_all(x, F.lit(IN_PLACE), F.lit(k))
    # few texts have braces; the arrays of the others are padded with nulls
    brace = lambda k: F.when(x.contains("{"), group(k)).otherwise(F.array().cast("array<string>"))
    found = F.arrays_zip(brace(1).alias("open"), group(2).alias("raw"), brace(3).alias("shut"))

    def tokens(m):
        body = F.regexp_replace(m["raw"], "[×xX% ]+$", "")
        sign = F.substring(m["raw"], F.length(body) + 1, F.length(m["raw"]))
        listed = body.contains(",") & (F.coalesce((m["open"] != "") & (m["shut"] != ""), F.lit(False)) | ~body.rlike(GROUPED))
        # a sign after a list goes with its last part
        return F.when(listed, F.split(F.concat(body, sign), ",")).otherwise(F.array(F.concat(body, sign)))

    # without a comma nothing is listed: a number is what it says, blanks aside
    parts = F.when(x.contains(","), F.flatten(F.transform(found, tokens))).otherwise(F.regexp_extract_all(x, F.lit(BARE), F.lit(1)))
    clean = F.transform(parts, lambda t: F.replace(F.lower(F.regexp_replace(t, r"[\s,  -  　]", "")), F.lit("x"), F.lit("×")))
    lower = F.lower(x)
    some = reduce(or_, [lower.contains(w) for w in NUMBER_WORDS])
    spelt = F.array_distinct(F.regexp_extract_all(lower, F.lit(rf"(?U)\b({'|'.join(NUMBER_WORDS)})\b"), F.lit(1)))
    values = F.create_map(*[F.lit(v) for pair in NUMBER_WORDS.items() for v in pair])
    known = F.array(*map(F.lit, NUMBER_WORDS))
    words = F.when(some, F.transform(F.array_intersect(known, spelt), lambda w: F.element_at(values, w))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(clean, words))
