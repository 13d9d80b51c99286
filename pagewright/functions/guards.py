"""Guards of JSON texts: closed sets of keys, patterns of values, bounds of lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls


@dataclass(frozen=True)
class Field:
    """What a key's value must be: a text that fits ``pattern``, a whole number from ``least`` to ``most``, or a boolean."""

    kind: str
    pattern: str = ""
    least: int = 0
    most: int = 2**53 - 1
    required: bool = True


def problems(json: Column, fields: dict[str, Field]) -> Column:
    """What is wrong with a JSON object: not_an_object, unknown:key, missing:key or invalid:key, sorted; empty for one that is as it should be."""
    keys = F.json_object_keys(json)
    unknown = F.transform(F.filter(keys, lambda k: ~k.isin(list(fields))), lambda k: F.concat(F.lit("unknown:"), k))
    parsed = F.try_parse_json(json)

    def told(name: str, f: Field) -> Column:
        has = F.array_contains(keys, name)
        value = F.try_variant_get(parsed, f"$['{name}']", "variant")
        kind = F.schema_of_variant(value)
        if f.kind == "string":
            fits = (kind == "STRING") & F.try_variant_get(parsed, f"$['{name}']", "string").rlike(f.pattern)
        elif f.kind == "boolean":
            fits = kind == "BOOLEAN"
        else:
            fits = (kind == "BIGINT") & F.try_variant_get(parsed, f"$['{name}']", "long").between(f.least, f.most)
        missing = F.when(~has, F.lit(f"missing:{name}")) if f.required else F.lit(None).cast("string")
        return F.coalesce(missing, F.when(has & ~F.coalesce(fits, F.lit(False)), F.lit(f"invalid:{name}")))

    found = F.filter(F.concat(unknown, F.array(*[told(n, f) for n, f in fields.items()])), lambda p: p.isNotNull())
    return urls.let(F.when(keys.isNull(), F.array(F.lit("not_an_object"))).otherwise(found), lambda p: F.array_sort(p))


# Types of actions and the keys that each needs besides id and type.
ACTION_FIELDS = {"click": ["selector"], "hover": ["selector"], "scroll": ["y"], "type": ["selector", "text"], "wait": ["ms"]}
MOST_ACTIONS = 32


def action_list_problems(json: Column) -> Column:
    """What is wrong with a list of actions: not_a_list, too_many, repeated_id, unknown_type or missing_field; empty for one that is as it should be."""
    parsed = F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")
    get = lambda a, k: F.try_variant_get(a, f"$.{k}", "string")

    def judged(x: Column) -> Column:
        a = x["a"]
        ids = F.transform(a, lambda e: F.coalesce(get(e, "id"), F.lit("")))
        lacks = lambda kind, name: lambda e: (get(e, "type") == kind) & get(e, name).isNull()
        needs = F.lit(False)
        for kind, names in ACTION_FIELDS.items():
            for name in names:
                needs = needs | F.exists(a, lacks(kind, name))
        named = F.array(
            F.when(F.size(a) > MOST_ACTIONS, F.lit("too_many")), F.when(F.size(F.array_distinct(ids)) < F.size(ids), F.lit("repeated_id")),
            F.when(F.exists(a, lambda e: ~F.coalesce(get(e, "type").isin(list(ACTION_FIELDS)), F.lit(False))), F.lit("unknown_type")), F.when(needs, F.lit("missing_field")),
        )
        return F.filter(named, lambda p: p.isNotNull())

    return F.when(parsed.isNull(), F.array(F.lit("not_a_list"))).otherwise(urls.let(F.struct(parsed.alias("a")), judged))
