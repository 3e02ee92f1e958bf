"""Text functions as native column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Broken words and their repairs, applied in this order, each to the result of the one before.
OCR_REPAIRS = (
    ("Si gma", "Sigma"), ("Si gma's", "Sigma's"), ("financ ial", "financial"), ("financi al", "financial"), ("du ty", "duty"), ("dut y", "duty"),
    ("bind s", "binds"), ("proceed ings", "proceedings"), ("proceedin gs", "proceedings"), ("establish ed", "established"), ("invest ment", "investment"),
    ("stemmi ng", "stemming"), ("dur ing", "during"), ("du ring", "during"), ("whos e", "whose"), ("there fore", "therefore"), ("appell ant", "appellant"),
    ("circ uit", "circuit"), ("brou ght", "brought"), ("br ought", "brought"), ("serv ices", "services"), ("particu lar", "particular"),
    ("argu ments", "arguments"), ("applic ation", "application"), ("corr ect", "correct"), ("th e ", "the "), ("tha t", "that"), ("Cour t", "Court"),
    ("Suprem e", "Supreme"), ("provi sions", "provisions"), ("provis ions", "provisions"), ("credit ors", "creditors"), ("realis ation", "realisation"),
    ("discre tion", "discretion"), ("circumst ances", "circumstances"), ("consider ation", "consideration"), ("Intellig ence", "Intelligence"),
    ("judg ment", "judgment"), ("para graph", "paragraph"), ("pro ceedings", "proceedings"), ("re spect", "respect"), (" gma", "gma"),
)


def strip(text: Column) -> Column:
    """text without white space at its ends, as Unicode has it."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def label_key(text: Column) -> Column:
    """A label in lower case, its runs of anything but a-z and 0-9 as single underscores, none at its ends."""
    return F.btrim(F.regexp_replace(F.lower(strip(text)), "[^a-z0-9]+", "_"), F.lit("_"))


def sanitize_control(text: Column) -> Column:
    """Control characters other than tab and line ends as spaces."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")


def clean_ocr(text: Column) -> Column:
    """text with the known broken words repaired."""
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), OCR_REPAIRS, text)


def excerpt(text: Column, n: int, mark: str = "...") -> Column:
    """The first n characters, with a mark when there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def find(text: Column, part: Column) -> Column:
    """Place from 0 of part in text, by case if it is there so, else without; -1 if it is not there."""
    exact, folded = F.position(part, text), F.position(F.lower(part), F.lower(text))
    return F.coalesce(F.nullif(exact, F.lit(0)), F.nullif(folded, F.lit(0)), F.lit(0)) - 1


def triple_string(head: Column, relation: Column, tail: Column) -> Column:
    return F.concat(F.lit("("), head, F.lit(") --["), relation, F.lit("]--> ("), tail, F.lit(")"))


def unfenced(text: Column) -> Column:
    """What a fenced block at the start of text holds, or text."""
    stripped = strip(text)
    return F.when(F.startswith(stripped, F.lit("```")), F.regexp_extract(stripped, r"(?s)^```[A-Za-z]*\s*(.*?)```", 1)).otherwise(stripped)


def json_span(text: Column) -> Column:
    """The widest bracketed span from the first bracket or brace, or text."""
    found = F.regexp_extract(text, r"(?s)(\[.*\]|\{.*\})", 1)
    return F.when(found == "", text).otherwise(found)


def response_value(text: Column) -> Column:
    """What a model's response says, as a variant; null if it is no JSON."""
    return F.try_parse_json(json_span(unfenced(text)))


def value_items(value: Column, any_key: bool = False) -> Column:
    """The items of a response's value, a column of its own so that it is parsed once: a list, an object's list under a usual key, or the object.

    any_key: of an object without a usual key the first list under any key counts, keys in the order that the value keeps.
    """
    lists = [F.try_variant_get(value, f"$.{k}", "array<variant>") for k in ("items", "triples", "data", "results", "extractions")]
    if any_key:
        fields = F.map_values(F.try_variant_get(value, "$", "map<string,variant>"))
        found = F.filter(fields, lambda x: F.startswith(F.schema_of_variant(x), F.lit("ARRAY")))
        lists.append(F.try_variant_get(F.get(found, F.lit(0)), "$", "array<variant>"))
    kind = F.schema_of_variant(value)
    listed = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.array(value))
    return F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get(value, "$", "array<variant>")).when(F.startswith(kind, F.lit("OBJECT")), listed).when(value.isNotNull(), F.array().cast("array<variant>"))


def response_items(text: Column) -> Column:
    """The items of a model's response as an array of variants; null if it is no JSON."""
    return value_items(response_value(text))


def item_field(item: Column, name: str) -> Column:
    """A field of a response's item: its own, that of its attributes, or, if those are null or absent, that of an object that its extraction_text spells out."""
    text = strip(F.try_variant_get(item, "$.extraction_text", "string"))
    spelled = F.when(F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}")), F.try_parse_json(text))
    return F.coalesce(*[F.try_variant_get(v, f"$.{p}{name}", "string") for v, p in ((item, ""), (item, "attributes."), (spelled, ""))])


def render_prompt(template: str, record_json: Column, guidance: str) -> Column:
    """The template with guidance and then the record in their places; guidance follows at the end where the template has no place for it."""
    if "{{schema_constraints}}" in template:
        whole = template.replace("{{schema_constraints}}", guidance)
    else:
        whole = f"{template}\n\n{guidance}" if guidance else template
    return F.replace(F.lit(whole), F.lit("{{record_json}}"), record_json)
