"""Descent through JSON values of any shape as column expressions over VARIANT: no schema, no Python worker, no shuffle.

A fold over the depth holds the values of one level and replaces them by their children; the values visited are kept with the place where they
stand (``at``: the ordinals on the way from the root, objects' members in the order of their names).  Sorting by ``at`` gives the order of a
walk that meets a value before its children.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_DEPTH = 24
# Members, in lower case, whose content is postings; fields that mark a posting by themselves.
JOB_CONTAINERS = ("jobs", "joblist", "job_list", "jobpostings", "job_postings", "openings", "positions", "roles", "results", "departments")
JOB_FIELDS = ("jobTitle", "job_title", "positionTitle")

_NODE = "struct<at: array<int>, inside: boolean, value: variant>"
_NODES = f"array<{_NODE}>"


def member(value: Column, *names: str) -> Column:
    """The value at a path of member names; null where it is absent."""
    return F.try_variant_get(value, "$" + "".join(f"['{n}']" for n in names), "variant")


def members(value: Column) -> Column:
    """An object's members as a map; null for other values."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def elements(value: Column) -> Column:
    """An array's elements; null for other values."""
    return F.try_variant_get(value, "$", "array<variant>")


def kind(value: Column) -> Column:
    """object, array, or the type of a scalar; null for no value."""
    return F.when(members(value).isNotNull(), "object").when(elements(value).isNotNull(), "array").otherwise(F.schema_of_variant(value))


def plain(value: Column) -> Column:
    """The text of a string that is not blank, trimmed, or of a whole number; null for all other values."""
    text = F.nullif(F.trim(F.try_variant_get(value, "$", "string")), F.lit(""))
    return F.when(F.schema_of_variant(value).isin("STRING", "BIGINT"), text)


def raw(value: Column) -> Column:
    """A string's text, other values as JSON."""
    return F.try_variant_get(value, "$", "string")


def first_text(value: Column, fields: Sequence[str]) -> Column:
    """The first of an object's fields with a plain text."""
    return F.coalesce(*[plain(member(value, f)) for f in fields])


def has_type(value: Column, name: str) -> Column:
    """Whether an object's ``@type`` is, or holds, this name in any case."""
    of = member(value, "@type")
    one = F.lower(raw(of)) == name.lower()
    some = F.exists(F.transform(elements(of), lambda t: F.lower(raw(t))), lambda t: t == name.lower())
    return F.coalesce(F.when(elements(of).isNotNull(), some).otherwise(one), F.lit(False))


def _below(node: Column, containers: Sequence[str]) -> Column:
    child = lambda i, inside, value: F.struct(F.array_append(node["at"], i).alias("at"), inside.alias("inside"), value.alias("value"))
    of_object = F.transform(F.map_entries(members(node["value"])), lambda e, i: child(i, node["inside"] | F.lower(e["key"]).isin(*containers), e["value"]))
    of_array = F.transform(elements(node["value"]), lambda e, i: child(i, node["inside"], e))
    return F.coalesce(of_object, of_array, F.array().cast(_NODES))


def objects(value: Column, containers: Sequence[str] = JOB_CONTAINERS, most_depth: int = MOST_DEPTH) -> Column:
    """array(struct(at, inside, value)) of all objects down to ``most_depth`` steps below the root, in the order of a walk.

    ``inside`` says whether one of the members on the way is named as a container.  Null and scalar values have none.
    """
    root = F.struct(F.array().cast("array<int>").alias("at"), F.lit(False).alias("inside"), value.alias("value"))
    start = F.struct(F.array(root).cast(_NODES).alias("level"), F.array().cast(_NODES).alias("found"))
    deeper = lambda acc: F.struct(
        F.flatten(F.transform(acc["level"], lambda n: _below(n, containers))).alias("level"),
        F.concat(acc["found"], F.filter(acc["level"], lambda n: members(n["value"]).isNotNull())).alias("found"),
    )
    step = lambda acc, _: F.when(F.size(acc["level"]) > 0, deeper(acc)).otherwise(acc)
    found = F.aggregate(F.sequence(F.lit(0), F.lit(most_depth)), start, step, lambda acc: acc["found"])
    order = lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)
    return F.array_sort(found, order)


def job_records(value: Column, containers: Sequence[str] = JOB_CONTAINERS, most_depth: int = MOST_DEPTH) -> Column:
    """The objects that stand in a container of postings or are postings by their type or fields."""
    explicit = lambda n: (F.lower(raw(member(n["value"], "@type"))) == "jobposting") | F.arrays_overlap(F.map_keys(members(n["value"])), F.array(*map(F.lit, JOB_FIELDS)))
    return F.transform(F.filter(objects(value, containers, most_depth), lambda n: n["inside"] | F.coalesce(explicit(n), F.lit(False))), lambda n: n["value"])
