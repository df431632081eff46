"""The check of answers that already stand in a column, as an expression over parsed JSON."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import FieldSpec, typed_default
from .answers import _FALSE, _TRUE
from .columns import is_refusal, whole_json

#: What the two JSON readers see differently: halves of surrogate pairs, and the sign of zero.
_UNSURE = r"\\u[dD][89a-fA-F]|[:,\[\s]-0"
_PLAIN_NUMBER = r"^-?[0-9]{1,15}(\.[0-9]{1,15})?$"


def _checked(value: Column, kind: Column, spec: FieldSpec) -> tuple[Column, Column]:
    """A field's typed value, and whether it surely passes."""
    text = F.try_variant_get(value, "$", "string")
    is_text = kind == "STRING"
    if spec.enum or spec.type in ("String", "Date"):
        sure = is_text & text.isin(*spec.enum) if spec.enum else is_text
        made = F.when(is_refusal(text), F.lit(typed_default(spec))).otherwise(text) if spec.has_default else text
        return made, sure
    if spec.type == "Number":
        number = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
        return F.try_variant_get(value, "$", "double"), number | is_text & text.rlike(_PLAIN_NUMBER)
    if spec.type == "Boolean":
        word = F.lower(text)
        true, false = word.isin(*sorted(_TRUE)), word.isin(*sorted(_FALSE))
        plain = kind.isin("BOOLEAN", "BIGINT", "STRING")
        return F.when(true, True).when(false, False), plain & (true | false)
    if spec.type == "List[String]":
        texts = F.try_variant_get(value, "$", "array<string>")
        return texts, kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(texts, lambda x: x.isNull())
    return text, F.lit(False)


def checked_answer(content: Column, specs: dict[str, FieldSpec]) -> Column:
    """The fields of a strict answer as a struct, defaults in place of refusals; null where this can't be sure that it passes.

    Where it isn't null it equals what a model step makes of the same text.
    It is null for every answer that fails the check and for some that pass:
    numbers and booleans in unusual words, text with halves of surrogate pairs,
    numbers that begin with ``-0``, keys given twice, and all answers with a field of type JSON, whose
    canonical text only Python writes.  Null and empty texts give null.
    """
    fields = F.try_variant_get(whole_json(content), "$", "map<string,variant>")
    values, sure = [], [~content.rlike(_UNSURE), F.array_sort(F.map_keys(fields)) == F.array(*(F.lit(n) for n in sorted(specs, key=str.encode)))]
    for name, spec in specs.items():
        value = F.element_at(fields, name)
        made, passes = _checked(value, F.schema_of_variant(value), spec)
        values.append(made.cast(spec.spark_type).alias(name))
        sure.append(passes)
    return F.when(F.coalesce(reduce(and_, sure), F.lit(False)), F.struct(*values))
