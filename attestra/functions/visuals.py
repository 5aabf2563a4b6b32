"""Labels of tables and figures in canonical form, and what makes one of them relevant to a question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.functions import relevance as R

# The shape of object labels, and the kinds of visuals with their standing where a question names none.
OBJECT_LABEL = r"(?i)^\s*(table|figure|fig\.?|chart|diagram)\s*(?:no\.?\s*)?((?:[A-Za-z]\.)?\d+(?:\.\d+)*(?:[A-Za-z])?|[A-Za-z]\d+|[IVXLCDM]+)\b"
KINDS = {"table": 5, "chart": 4, "figure": 3, "diagram": 3, "caption": 2}
ROMAN = r"^M*(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
ROMAN_DIGITS = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def roman_number(x: Column) -> Column:
    """The value of a canonical Roman number of any case; null for others."""
    up = F.upper(x)
    values = F.create_map(*[F.lit(v) for pair in ROMAN_DIGITS.items() for v in pair])
    digits = F.transform(F.filter(F.split(up, ""), lambda c: c != ""), lambda c: F.try_element_at(values, c))
    value = F.aggregate(digits, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda s, v: F.struct((s["sum"] + v - F.when(s["last"] < v, 2 * s["last"]).otherwise(0)).alias("sum"), v.alias("last")))["sum"]
    return F.when((up != "") & up.rlike(ROMAN), value)


def object_locator(label: Column, kind: Column, element_id: Column) -> Column:
    """struct(key, label): 'Table IV' is table-04 and Table 4, 'Fig. A.1' figure-a-01 and Figure A.1.

    A visual without a label is named by its kind and a digest of its element."""
    part = lambda k: F.regexp_extract(_text(label), OBJECT_LABEL, k)
    canonical = lambda x: F.when(F.regexp_replace(F.lower(x), r"\.+$", "").isin("table", "chart", "diagram"), F.regexp_replace(F.lower(x), r"\.+$", "")).otherwise("figure")
    raw = F.regexp_replace(part(2), r"^\.+|\.+$", "")
    pad = lambda n: F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n)
    plain = lambda n: F.regexp_replace(n, "^0+(?=[0-9])", "")
    roman, only_roman = roman_number(raw), raw.rlike("(?i)^[IVXLCDM]+$")
    tail, head = F.regexp_extract(raw, r"^(\d+)([A-Za-z])$", 1), F.regexp_extract(raw, r"^([A-Za-z])(\d+)$", 2)
    pieces = F.regexp_extract_all(raw, F.lit(r"[A-Za-z]+|\d+"), F.lit(0))
    key = (
        F.when(only_roman & roman.isNotNull(), pad(roman.cast("string"))).when(only_roman, F.lower(raw))
        .when(tail != "", F.concat(pad(plain(tail)), F.lower(F.substring(raw, -1, 1)))).when(head != "", F.concat(F.lower(F.substring(raw, 1, 1)), F.lit("-"), pad(plain(head))))
        .otherwise(F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d+$"), pad(plain(p))).otherwise(F.lower(p))), "-"))
    )
    shown = (
        F.when(only_roman & roman.isNotNull(), roman.cast("string")).when(only_roman, F.upper(raw)).when(tail != "", F.concat(plain(tail), F.lower(F.substring(raw, -1, 1))))
        .when(head != "", F.concat(F.upper(F.substring(raw, 1, 1)), plain(head))).otherwise(F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d+$"), plain(p)).otherwise(F.upper(p))), "."))
    )
    own = canonical(part(1))
    digest = F.concat(canonical(_text(kind)), F.lit("-unlabeled-"), F.substring(F.sha2(_text(element_id), 256), 1, 10))
    return F.when(part(1) != "", F.struct(F.concat(own, F.lit("-"), key).alias("key"), F.concat(F.initcap(own), F.lit(" "), shown).alias("label"))).otherwise(F.struct(digest.alias("key"), F.lit(None).cast("string").alias("label")))


def visual_references(x: Column) -> Column:
    """The tables and figures that a text names, as kind:LABEL, each once."""
    group = lambda k: F.regexp_extract_all(_text(x), F.lit(f"(?i){R.VISUAL_REFERENCE}"), F.lit(k))
    found = F.arrays_zip(group(1).alias("kind"), group(2).alias("label"), group(3).alias("kind2"), group(4).alias("label2"))

    def name(m):
        kind = F.regexp_replace(F.lower(F.concat(m["kind"], m["kind2"])), r"\.+$", "")
        return F.concat(F.when(kind.isin("table", "표"), "table").otherwise("figure"), F.lit(":"), F.upper(F.concat(m["label"], m["label2"])))

    return F.array_distinct(F.transform(found, name))


def numeric_terms(x: Column) -> Column:
    found = F.regexp_extract_all(_text(x), F.lit(f"(?i){R.NUMBER}"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.lower(F.replace(F.regexp_replace(t, r"[\s,]", ""), F.lit("×"), F.lit("x")))))


def question_words(x: Column) -> Column:
    """Lower-case words that are no stop words, and plurals of over four letters without their s too."""
    words = F.transform(F.regexp_extract_all(_text(x), F.lit(R.LEXICAL_TOKEN), F.lit(0)), lambda w: F.lower(w))
    kept = F.filter(words, lambda w: ~w.isin(*R.STOP_WORDS))
    return F.array_distinct(F.concat(kept, F.transform(F.filter(kept, lambda w: (F.length(w) > 4) & w.endswith("s")), lambda w: F.substring(w, F.lit(1), F.length(w) - 1))))


def visual_score(query: Column, item: Column) -> Column:
    """struct by which visuals are ranked for a question, greatest first; null for one that it does not call for.

    ``item``: struct of kind, object_label, section, text, has_cells, has_crop, has_box.  A question that names tables or figures
    takes only these; another one has to ask for numbers or visuals, and to share a number or a word.
    """
    asked = visual_references(query)
    text = F.concat_ws("\n", *[F.when(item[c] != "", item[c]) for c in ("object_label", "section", "text")])
    exact = F.size(F.array_intersect(asked, visual_references(text)))
    numbers = F.size(F.array_intersect(numeric_terms(query), numeric_terms(text)))
    words = F.size(F.array_intersect(question_words(query), question_words(text)))
    kind = item["kind"]
    wants = lambda k: F.exists(asked, lambda r: r.startswith(f"{k}:"))
    align = (
        F.when(wants("table"), F.when(kind == "table", 5).when(kind == "caption", 3).otherwise(0)).when(wants("figure"), F.when(kind.isin("figure", "chart", "diagram"), 5).when(kind == "caption", 3).otherwise(0))
        .otherwise(F.try_element_at(F.create_map(*[F.lit(v) for pair in KINDS.items() for v in pair]), kind))
    )
    flag = lambda c: F.coalesce(item[c], F.lit(False))
    precision = F.when((kind == "table") & flag("has_cells"), 4).when(flag("has_crop"), 3).when(flag("has_box"), 2).when(_text(item["object_label"]) != "", 1).otherwise(0)
    named = F.size(asked) > 0
    fits = kind.isin(*KINDS) & ((named & (exact > 0)) | (~named & R.visual_intent(query) & ((numbers > 0) | (words > 0))))
    return F.when(fits, F.struct(exact.alias("exact"), numbers.alias("numbers"), words.alias("words"), (align * 10 + precision).alias("place")))
